import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from relpoint.llm.packing import Tokens, pack, pack_documents, pieces, public_tokenizer, schedule
from tests.llm.fixtures import corpus, documents


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizer())


ODD = ["", " ", "It's 12,5 km; don't!!", "é e\u0301 ﬁ ß ẞ İ ΑΣ", "tab\tand\x0bother\x0cspaces\u00a0\u2003\u0085x", "a\x00b \x1f"]
ODD += ["<|endoftext|> <|startoftext|>x a<|endoftext|>b", "(a). b-c. d's, 'e' f'. g' 7. é. é! a_b_ <|endoftext|>. <|ENDOFTEXT|>, <|startoftext|>!", "日本語 テキスト 🙂🏽 \u200d", "\r\n\r\n", "x" * 3000, "A.B.C U.S.A. #1 @me http://a.b/c?d=e"]


def test_runs_give_the_tokenizers_own_ids(tokenizer, sf):
    import pyarrow.parquet as pq

    texts = pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist()
    tokens = Tokens(public_tokenizer(), memory=500)
    for at in range(0, len(ODD + texts), 7):
        part = (ODD + texts)[at : at + 7]
        for text, ids in zip(part, tokens.ids([t.encode() for t in part]), strict=True):
            assert np.frombuffer(ids, dtype="<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text[:80]


def test_pieces_hold_every_token(spark, tokenizer):
    rows = corpus() + list(enumerate(ODD, 700))
    got = {}
    for r in pieces(documents(spark, rows), public_tokenizer(), 64, with_ids=True).collect():
        got.setdefault(r["id"], []).append(r)
    for i, text in dict(rows).items():
        if i is None or i == 3:
            continue
        own = sorted(got[i], key=lambda r: r["piece"])
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        assert [x for r in own for x in r["ids"]] == ids
        assert [r["start"] for r in own] == list(range(0, len(ids), 64))
        for r in own:
            assert r["length"] == len(r["ids"]) and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())


def whole(rows, capacity):
    """Sequences are filled from 0 without holes or overlap, within the capacity."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def first_fit(lengths, capacity):
    free = []
    for n in sorted(lengths, reverse=True):
        place = min((i for i, f in enumerate(free) if f >= n), key=lambda i: free[i], default=None)
        if place is None:
            free.append(capacity - n)
        else:
            free[place] -= n
    return len(free)


@pytest.mark.parametrize("seed", range(4))
def test_packing_is_as_dense_as_best_fit(spark, seed):
    rng = random.Random(seed)
    kinds = [lambda: rng.randrange(1, 101), lambda: min(100, int(rng.expovariate(0.05)) + 1), lambda: rng.choice([34, 51, 33, 100]), lambda: 40]
    lengths = [kinds[seed]() for _ in range(1500)]
    rows = spark.createDataFrame(list(enumerate(lengths)), "id long, length long").repartition(5)
    got = pack(rows, 100).collect()
    assert sorted((r["id"], r["length"]) for r in got) == list(enumerate(lengths))
    assert whole(got, 100) <= first_fit(lengths, 100) * 1.02 + 1


def test_schedule_covers_every_rank_once():
    counts = {1: 1000, 7: 13, 50: 4, 51: 6, 100: 2}
    plan = schedule(counts, 100)
    for length, n in counts.items():
        own = sorted((first, size) for at, first, size, _, _ in plan.tolist() if at == length)
        at = 0
        for first, size in own:
            assert first == at
            at += size
        assert at == n
    assert schedule({}, 100).shape == (0, 5)


def test_documents_pack_whole_with_odd_rows(spark):
    rows = corpus()
    clash = documents(spark, rows).selectExpr("*", "1 as length", "2 as id", "3 as rank", "4 as slice")
    got = pack_documents(clash, public_tokenizer(), 256).collect()
    assert len({(r["id"], r["piece"]) for r in got} & {(300, 0), (301, 0), (302, 0), (400, 5)}) == 4
    whole(got, 256)
    assert pack_documents(documents(spark, []), public_tokenizer()).count() == 0


def test_repeated_rows_get_places_of_their_own(spark):
    docs = documents(spark, [(1, "same words")] * 50)
    got = pack_documents(docs, public_tokenizer(), 16)
    assert got.select("sequence_id", "offset").distinct().count() == got.count() == 50
    assert got.agg(F.max("offset")).first()[0] < 16


def test_worker_gives_memory_back():
    # Memory after 120,000 runs, in a process of its own: what is known of them, not what the tokenizer needed.
    code = """
import re, sys
from relpoint.llm.packing import Tokens
import public_tokenizers
held = lambda: int(re.search(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read())[1]) / 1024
tokens = Tokens(str(public_tokenizers.path("word_bpe_49k.json")))
texts = [[f"wo{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}{k} x{i}y{k},".encode() for i in range(15000)] for k in range(4)]
before = held()
for some in texts:
    tokens.ids(some)
print(held() - before, len(tokens.known))
"""
    repo = Path(__file__).resolve().parents[2]
    got = subprocess.run([sys.executable, "-c", code], cwd=repo, capture_output=True, text=True, timeout=120, check=True)
    grown, known = map(float, got.stdout.split())
    assert known > 120_000 and grown < 33


def test_a_small_memory_gives_the_same_pieces(spark):
    tokenizer = public_tokenizer()
    rows = [(i, f"word{i % 7} x{i}y{i * i % 101}, and {i} more" * (i % 5)) for i in range(700)] + [(900, None)]
    docs = documents(spark, rows).coalesce(1)
    want = pieces(docs, tokenizer, 64, with_ids=True).collect()
    got = pieces(docs, tokenizer, 64, with_ids=True, memory=50, at_once=30).collect()
    assert sorted(got, key=str) == sorted(want, key=str)
    few, all_runs = Tokens(tokenizer, memory=50), Tokens(tokenizer)
    for at in range(0, len(rows), 30):
        for tokens in (few, all_runs):
            tokens.ids([(text or "").encode() for _, text in rows[at : at + 30]])
    assert len(few.known) < len(all_runs.known) / 5
