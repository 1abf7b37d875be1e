import random

import numpy as np
import pytest

from relpoint.llm import minhash
from relpoint.llm.line_dedup import dedup_lines, line_classes, line_units, lines
from relpoint.llm.minhash import minima, near, runs_of, shingle_hashes, signatures, word_hashes
from relpoint.llm.paragraph_dedup import dedup_paragraphs, paragraph_classes, paragraph_units, paragraphs
from tests.llm.fixtures import corpus, documents, words
from tests.llm.test_components import by_search


def test_minima_are_shared_as_often_as_shingles():
    rng = random.Random(1)
    how = line_units(bands=100)
    one = words(rng, 60).encode()
    other = one[:200] + b"another end" + one[230:]
    found = signatures([one, other, b"x", b"", one], how)
    share = np.mean(found[0] == found[1])
    exact = how.jaccard(how.shingles(one), how.shingles(other))
    assert abs(share - exact) < 0.1 and (found[0] == found[4]).all() and (found[2] != found[3]).any()


@pytest.mark.parametrize("how", [line_units(), paragraph_units(), line_units(threshold=0.5), line_units(shingle=1)])
def test_pairs_are_verified_exactly(how):
    rng = random.Random(7)
    for _ in range(300):
        one = words(rng, rng.randrange(1, rng.choice([60, 900])), rng.choice([3, 50, 5000])).split()
        other = list(one)
        for _ in range(rng.randrange(12)):
            other[rng.randrange(len(other))] = f"e{rng.randrange(99)}"
        if rng.random() < 0.5:
            other = other[: rng.randrange(1, len(other) + 1)] + one[: rng.randrange(9)]
        a, b = " ".join(one).encode(), " ".join(other).encode()
        exact = how.jaccard(how.shingles(a), how.shingles(b)) >= how.threshold
        x, y = shingle_hashes([a, b], how)
        assert (len(x), len(y)) == (len(how.shingles(a)), len(how.shingles(b)))
        assert near(x, y, how.threshold) == near(y, x, how.threshold) == exact


def test_words_are_hashed_by_their_bytes_alone():
    rng = random.Random(8)
    own = words(rng, 3000, 900).encode().split() + [b"x" * 300_000, "é".encode(), b"\x00", b"\x00\x00", b"ab", b"ba"]
    gaps = [rng.choice([b" ", b"\n", b"\t \x0b", b"\r\n"]) for _ in own]
    text = b"".join(g + w for g, w in zip(gaps, own))
    found, starts, stops = word_hashes(text)
    assert [text[a:b] for a, b in zip(starts, stops)] == text.split() == own
    number = {w: int(h) for w, h in zip(own, found)}
    assert [number[w] for w in own] == found.tolist() and len(set(number.values())) == len(number)
    assert word_hashes(own[7])[0].tolist() == [number[own[7]]]
    assert all(len(a) == 0 for t in (b"", b" \n") for a in word_hashes(t))


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 13])
def test_runs_are_equal_where_values_are(size):
    values = np.random.default_rng(size).integers(0, 3, 400).astype(np.uint64)
    runs = runs_of(values, size)
    number = {}
    for k, run in enumerate(runs.tolist()):
        assert number.setdefault(tuple(values[k : k + size].tolist()), run) == run
    assert len(runs) == 400 - size + 1 and len(set(number.values())) == len(number)

def test_long_units_are_hashed_in_blocks(monkeypatch):
    rng = random.Random(2)
    how = line_units()
    units = [words(rng, 300).encode(), words(rng, 5).encode(), words(rng, 900).encode()]
    expected = minima(*how.symbols(units), how.size, 30)
    monkeypatch.setattr("relpoint.llm.minhash.BLOCK", 100)
    assert (signatures(units, how) == expected).all()


def slow_classes(rows, split, how):
    """Class of each unit by comparing all pairs; ids are unique here."""
    units = [((i, n), u) for i, t in rows for n, u in split((t or "").encode())]
    texts = sorted({u for _, u in units})
    sets = [how.shingles(u) for u in texts]
    pairs = [(a, b) for a in range(len(texts)) for b in range(a) if how.jaccard(sets[a], sets[b]) >= how.threshold]
    root = by_search(pairs)
    number = {u: root.get(k, k) for k, u in enumerate(texts)}
    classes = {}
    for place, u in units:
        classes.setdefault(number[u], []).append(place)
    return {place: (min(classes[number[u]]), len(classes[number[u]])) for place, u in units}


def families(seed, least=3):
    """Documents whose lines are copies, near copies at many distances, chains and one large family."""
    rng = random.Random(seed)
    stems = [words(rng, rng.randrange(30, 60), 5000) for _ in range(12)]
    pool = []
    for s in stems:
        own = s.split()
        for _ in range(rng.randrange(1, 6)):
            own = list(own)
            for _ in range(rng.randrange(3)):
                own[rng.randrange(len(own))] = f"e{rng.randrange(10_000)}"
            pool.append(" ".join(own))
    hub = words(rng, 80, 5000).split()
    for k in range(60):
        own = list(hub)
        own[rng.randrange(80)] = f"h{k}"
        own[rng.randrange(80)] = f"g{k}"
        pool.append(" ".join(own))
    pool += [words(rng, 40, 5000) for _ in range(20)] + ["short", "", " x ", stems[0].upper(), "é ü ß " * 12]
    rng.shuffle(pool)
    rows, k = [], 0
    while pool:
        n = rng.randrange(1, 5)
        rows.append((k, "\n".join(pool[:n])))
        pool, k = pool[n:], k + 1
    return rows + [(900, rows[0][1]), (901, None), (902, "")]


CASES = [(line_classes, lines, line_units), (paragraph_classes, paragraphs, paragraph_units)]


@pytest.mark.parametrize("classes,split,units", CASES)
def test_classes_match_all_pairs(spark, classes, split, units):
    rows = families(3)
    clash = documents(spark, rows).selectExpr("*", "1 as key", "2 as unit", "3 as id", "4 as bands")
    got = {(r["id"], r["unit"]): ((r["first_id"], r["first_unit"]), r["class_size"]) for r in classes(clash).collect()}
    assert got == slow_classes(rows, split, units())


def test_full_buckets_lose_no_link(spark, monkeypatch):
    # One hash a band: most lines of a family meet in most buckets, with other families among them.
    monkeypatch.setattr(minhash, "SMALL", 4)
    monkeypatch.setattr(minhash.links_across, "__defaults__", (7,))
    rows = families(4)
    got = {(r["id"], r["unit"]): ((r["first_id"], r["first_unit"]), r["class_size"]) for r in line_classes(documents(spark, rows), rows=1).collect()}
    assert got == slow_classes(rows, lines, line_units())


@pytest.mark.parametrize("classes", [line_classes, paragraph_classes])
def test_odd_rows(spark, classes):
    got = classes(documents(spark, corpus())).collect()
    assert {r["id"] for r in got} >= {400} and not {300, 301, 302} & {r["id"] for r in got}
    assert classes(documents(spark, [])).count() == 0
    assert classes(documents(spark, [(1, None), (2, "")])).count() == 0


def test_one_line_of_each_class_stays(spark):
    long = " ".join(f"p{k}" for k in range(40))
    rows = [(1, f"first line here\n{long}\nend"), (2, f"FIRST  line here\nown words of two\n{long} more"), (3, None), (4, "")]
    docs = documents(spark, rows).selectExpr("*", "1 as own", "2 as gone", "3 as i")
    kept = dedup_lines(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in kept.collect()} == {1: rows[0][1], 2: "own words of two", 3: None, 4: ""}
    kept = {r["doc_id"]: r["text"] for r in dedup_paragraphs(docs).collect()}
    assert kept == {1: rows[0][1], 2: "FIRST  line here\nown words of two", 3: None, 4: ""}
