import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from relpoint.llm import quality
from relpoint.llm.common import remainder
from relpoint.llm.quality import Network, chunks, keep_good, op9_quality, sample, train, with_score
from tests.llm.fixtures import documents, words


def test_chunks_cover_the_text():
    for n in (0, 1, 511, 512, 513, 959, 960, 961, 5000):
        text = bytes(random.Random(n).randrange(1, 256) for _ in range(n))
        got = chunks(text)
        back = bytearray(len(got) * quality.STEP + quality.CHUNK)
        for k, row in enumerate(got):
            back[k * quality.STEP : k * quality.STEP + quality.CHUNK] = row[: quality.CHUNK].tobytes()
        assert bytes(back[:n]) == text and not any(back[n:])


def slow_score(network, text):
    pooled = []
    for chunk in chunks(text):
        best = np.full(quality.FILTERS, -np.inf)
        for at in range(0, quality.CHUNK, quality.HOP):
            window = np.concatenate([network.embed[b] for b in chunk[at : at + quality.WIDTH]])
            best = np.maximum(best, window @ network.filters)
        pooled.append(np.maximum(best + network.offset, 0))
    doc = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])
    return 1 / (1 + np.exp(-(doc @ network.weights + network.bias[0])))


def test_scores_match_brute_force_in_any_batch(monkeypatch):
    rng = random.Random(1)
    network = Network.new()
    network.bias[0] = 0.3
    texts = [b"", b"a", words(rng, 40).encode(), words(rng, 700).encode(), "é ü 🙂".encode() * 90]
    expected = [slow_score(network, t) for t in texts]
    np.testing.assert_allclose(network.scores(texts), expected, rtol=1e-4)
    blocks = Network._blocks
    monkeypatch.setattr(Network, "_blocks", staticmethod(lambda documents: blocks(documents, 3)))
    np.testing.assert_allclose(network.scores(texts), expected, rtol=1e-4)


def test_gradient_is_the_slope_of_the_loss():
    rng = random.Random(2)
    network = Network.new()
    for name in ("embed", "filters", "offset", "weights", "bias"):
        setattr(network, name, getattr(network, name).astype(np.float64))
    texts = [words(rng, n).encode() for n in (30, 200, 400)]
    labels = np.array([1.0, 0.0, 1.0])
    block = np.concatenate([chunks(t) for t in texts])
    owners = np.repeat(np.arange(3), [len(chunks(t)) for t in texts])

    def loss():
        p = network.scores(texts)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    for p, g in zip(network.parameters(), network.gradient(block, owners, labels)):
        for at in np.argsort(-np.abs(g), axis=None)[:4]:
            place, step = np.unravel_index(at, p.shape), 1e-5
            kept = p[place]
            p[place] = kept + step
            up = loss()
            p[place] = kept - step
            slope = (up - loss()) / (2 * step)
            p[place] = kept
            assert abs(slope - g[place]) < 1e-3 * max(1e-2, abs(g[place])) + 1e-6


def labelled(spark, n=160):
    rng = random.Random(3)
    rows = [(k, words(rng, 60) if k % 2 else " ".join(f"{w}$$$" for w in words(rng, 40).split())) for k in range(n)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(n)] + [(5, None, 0), (None, 1, 0), (99_999, 1, 0)], "doc_id long, quality int, toxic int")
    return documents(spark, [*rows, (1000, None), (1001, ""), (None, "x y")]), labels


def test_sample_leaves_the_held_out_part_aside(spark):
    docs, labels = labelled(spark)
    blocks, quality_ = sample(docs, labels)
    kept = [k for k in range(160) if zlib.crc32(str(k).encode()) % 5]
    assert len(blocks) == len(kept) and quality_.sum() == sum(k % 2 for k in kept)
    assert len(sample(docs, labels, rows=10)[0]) == 10


def test_held_out_documents_are_told_apart(spark):
    docs, labels = labelled(spark)
    network = train(docs, labels, steps=120)
    scored = with_score(docs, network, "score").withColumn("held_out", remainder("doc_id", 5) == 0)
    rows = scored.where("doc_id < 160 and held_out").collect()
    assert len(rows) > 20 and all((r["score"] >= 0.3) == (r["doc_id"] % 2 == 1) for r in rows)
    assert scored.where(F.col("score").between(0, 1)).count() == docs.count()


def test_rejected_documents_go(spark):
    docs, labels = labelled(spark)
    docs = docs.withColumn("SCORE", F.lit(1))
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.where("doc_id < 160").select("doc_id").collect()}
    assert len(ids ^ {k for k in range(160) if k % 2}) <= 2


def test_no_labels_and_no_documents(spark):
    docs, labels = labelled(spark, 10)
    assert keep_good(docs, labels.limit(0)).count() == docs.count()
    assert keep_good(docs.limit(0), labels).count() == 0


def test_query_on_the_driver_tables(spark, sf):
    found = op9_quality(spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert len(found) == docs
    for r in found:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert r["predicted"] == int(r["score"] >= 0.3)


def test_long_texts_are_learned_whole_within_the_bytes(spark):
    ids = [k for k in range(40) if zlib.crc32(str(k).encode()) % 5]
    text = {k: "".join(chr(97 + (k + i) % 26) for i in range(30_000)) for k in ids}
    labels = spark.createDataFrame([(k, k % 2, 0) for k in ids], "doc_id long, quality int, toxic int")
    docs = documents(spark, [*text.items(), (ids[0], text[ids[0]]), (ids[1], None)])
    blocks, _ = sample(docs, labels)
    assert sorted(len(b) for b in blocks) == [1] + [67] * len(ids)
    flat = {b"".join(bytes(row[:448]) for row in b)[:30_000].decode() for b in blocks if len(b) > 1}
    assert flat == set(text.values())
    # 30,000 bytes a row: the fourth reaches 100,000.
    assert sum(len(b) > 1 for b in sample(docs, labels, size=100_000)[0]) == 4
