import random

import pytest
import xxhash
from pyspark.sql import functions as F

from relpoint.llm import simhash
from relpoint.llm.simhash import drop_near, fingerprint, links, near_groups
from tests.llm.fixtures import corpus, documents
from tests.llm.test_components import by_search


def slow_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_match_brute_force():
    for _, text in corpus() + [(0, "a b"), (0, "a b c"), (0, "x y z " * 700)]:
        assert fingerprint((text or "").encode()) == slow_fingerprint(text)


def test_shingle_hash_is_the_engines_own(spark):
    [row] = spark.range(1).select(F.xxhash64(F.lit("one two three"))).collect()
    assert row[0] % 2**64 == fingerprint(b"one TWO three")


def close_pairs(fps):
    return {(a, b) for a in fps for b in fps if a < b and bin((a ^ b) % 2**64).count("1") <= 2}


@pytest.mark.parametrize("cell", [2, 16])
def test_links_connect_what_is_close(spark, cell):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(150)} | {0, 2**64 - 1, 1, 3, 7}
    for f in list(fps)[:40]:
        for _ in range(rng.randrange(6)):
            f ^= 1 << rng.randrange(64)
            fps.add(f)
    centre = rng.getrandbits(64)
    fps |= {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(80)}
    signed = {f - 2**64 if f >> 63 else f for f in fps}
    frame = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
    found = {(r["a"], r["b"]) for r in links(frame, cell=cell).collect()}
    assert found <= close_pairs(signed)
    assert by_search(found) == by_search(close_pairs(signed))


def expected(rows):
    fps = [slow_fingerprint(t) for _, t in rows]
    component = by_search([(a, b) for a in fps for b in fps if bin(a ^ b).count("1") <= 2])
    least = {}
    for (i, _), f in zip(rows, fps):
        if i is not None:
            least[component[f]] = min(i, least.get(component[f], i))
    return sorted(((i, f, least.get(component[f])) for (i, _), f in zip(rows, fps)), key=repr)


def test_groups_match_brute_force(spark):
    rows = corpus()
    found = [(r["id"], r["fp"] % 2**64, r["component"]) for r in near_groups(documents(spark, rows)).collect()]
    assert sorted(found, key=repr) == expected(rows)
    assert near_groups(documents(spark, [])).count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = [(i, t) for i, t in corpus() if i is not None]
    unique = list(dict(rows).items())
    clash = documents(spark, unique).selectExpr("*", "1 as fp", "2 as id", "3 as component")
    kept = drop_near(clash)
    assert kept.columns == clash.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in expected(unique)}


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d e"), (1, "a b c d e"), (1, "quite another text of words"), (0, "quite another text of words")]
    rows += [(None, "without an id one"), (None, "without an id one"), (2, "a b c d e")]
    kept = drop_near(documents(spark, rows)).collect()
    assert sorted((repr(r["doc_id"]), r["text"]) for r in kept) == [
        ("0", "quite another text of words"),
        ("1", "a b c d e"),
        ("None", "without an id one"),
    ]


def test_constants_fit_the_star():
    assert simhash.DISTANCE == 2
