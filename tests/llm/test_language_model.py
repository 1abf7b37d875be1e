import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from relpoint.llm.language_model import Lookup, grams, op2_language_model, score, train
from tests.llm.fixtures import corpus

END = 0xFF


def stream(text):
    return [END] * 4 + list((text or "").encode()) + [END]


class Trie:
    """Counts by context, for each length from 0 to 4."""

    def __init__(self, texts):
        self.counts = {}
        for text in texts:
            flat = stream(text)
            for at in range(4, len(flat)):
                for k in range(5):
                    self.counts.setdefault(tuple(flat[at - k : at]), Counter())[flat[at]] += 1

    def log10(self, context, symbol):
        total, excluded = 0.0, set()
        for k in range(4, -1, -1):
            own = self.counts.get(tuple(context[4 - k :]))
            left = {s: n for s, n in (own or {}).items() if s not in excluded}
            if not left:
                continue
            n, t = sum(left.values()), len(left)
            if symbol in left:
                return total + math.log10(left[symbol] / (n + t))
            total += math.log10(t / (n + t))
            excluded |= set(left)
        return total - math.log10(256 - len(excluded))

    def score(self, text):
        flat = stream(text)
        return sum(self.log10(flat[at - 4 : at], flat[at]) for at in range(4, len(flat)))


def plain(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    return [w for w in lower.split(" ") if w]


def held(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0


def expected(rows):
    known = [(i, t) for i, t in rows if not held(i)]
    counts = Counter(w for _, t in known for w in [*plain(t), None])
    total, distinct, trie = sum(counts.values()), len(counts), Trie([t for _, t in known])
    found = []
    for i, t in rows:
        own = [*plain(t), None]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in own)
        found.append((repr(i), held(i), len(own), sum(counts[w] > 0 for w in own), total, base, trie.score(t)))
    return sorted(found)


def frame(spark, rows):
    rows = [(i, held(i), t) for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, held_out boolean, text string").repartition(3)


@pytest.mark.parametrize("words,grams_", [(300_000, 1_000_000), (20, 30), (0, 0)])
def test_scores_match_brute_force(spark, words, grams_):
    rows = [r for r in corpus() if r[0] != 400] + [(k, f"Other téxt {k} \x00\x7f z{k % 3}!") for k in range(800, 830)]
    docs = frame(spark, rows)
    model = train(docs)
    got = score(docs, model, words=words, grams_=grams_).collect()
    assert sum(held(i) for i, _ in rows) > 5
    found = sorted(
        (repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], model.tokens, r["base_score"], r["score"]) for r in got
    )
    for a, b in zip(found, expected(rows), strict=True):
        assert a[:5] == b[:5]
        assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_probabilities_of_all_symbols_add_up_to_one():
    trie = Trie(["abracadabra", "banana", "", "é"])
    for context in ([END] * 4, list(b"abra"), list(b"zzzz"), list(b"xana"), list(b"zzza")):
        assert sum(10 ** trie.log10(context, s) for s in range(256)) == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    held_out = next(i for i in range(100) if held(i))
    docs = frame(spark, [(held_out, "ab"), (held_out, None)])
    got = score(docs, train(docs)).collect()
    assert sorted(r["score"] for r in got) == pytest.approx([-3 * math.log10(256), -math.log10(256)])
    assert all(r["n_known"] == 0 and r["base_score"] == pytest.approx(0) for r in got)
    empty = docs.limit(0)
    assert score(empty, train(empty)).count() == 0


def test_grams_stay_inside_their_text():
    keys, starts = grams([b"ab", b"", b"c"])
    own = [[END] * 4 + list(t) + [END] for t in (b"ab", b"", b"c")]
    expected_keys = [int.from_bytes(bytes(f[at - 4 : at + 1]), "big") for f in own for at in range(4, len(f))]
    assert keys.tolist() == expected_keys and starts.tolist() == [0, 3, 4]


def test_lookup_finds_what_is_there():
    rng = random.Random(1)
    keys = np.array(rng.sample(range(1 << 40), 5000) + [0])
    lookup = Lookup(keys, np.arange(5001.0))
    values, found = lookup(np.concatenate([keys, keys + 1]))
    assert found[:5001].all() and (values[:5001] == np.arange(5001)).all()
    assert (found[5001:] == np.isin(keys + 1, keys)).all()
    assert not Lookup(keys[:0], np.zeros(0))(keys)[1].any()


def test_query_scores_every_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = op2_language_model(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert all(r["score"] < 0 and 0 < r["n_known"] <= r["n_tokens"] for r in got)
