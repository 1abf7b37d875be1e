import random
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from relpoint.llm.collocations import chunks, collocations, frequent_phrases, occurrences, scored, split
from tests.llm.fixtures import corpus, documents

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def slow_counts(rows, longest=5):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    return counts, total


def slow(rows, least, longest=5, top=2000, cover=100):
    counts, total = slow_counts(rows, longest)
    found = []
    for lang, own in counts.items():
        frequent = {p: f for p, f in own.items() if f >= least and len(p) > 1}
        kept = []
        for p, a in frequent.items():
            cuts = [(1000 * a * total[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            around = [
                f for q, f in frequent.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
            ]
            if not any(100 * f >= cover * a for f in around):
                kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (score, a, text, left, right) in enumerate(sorted(kept)[:top], 1):
            found.append((lang, rank, text.decode(), -a, left, right, total[lang], -score))
    return sorted(found)


def texts():
    rng = random.Random(12)
    rows = [(i, t) for i, t in corpus()]
    stock = ["new york city", "New York", "in the new york", "a a a a a a", "é Ünï çode", "x\ty\tz", "the end. of", "ß? ü!"]
    for k in range(120):
        rows.append((1000 + k, " ".join(rng.choice(stock) + rng.choice(["", ".", ",", "\x0b", "\n"]) for _ in range(30))))
    return rows


def read(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_matches_brute_force(spark):
    rows = texts()
    docs = documents(spark, rows).selectExpr("*", "1 as a", "2 as block", "3 as f", "4 as word", "5 as score", "6 as N")
    plain = [(r["lang"], r["text"]) for r in docs.collect()]
    for least, top, cover in ((5, 2000, 100), (3, 4, 60)):
        assert read(collocations(docs, least, 5, top, cover)) == slow(plain, least, 5, top, cover)
    assert {r[0] for r in slow(plain, 5)} == {"en", "und"}


def test_parts_of_long_texts_overlap(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice(["aa", "bb", "cc", "dd,", "é"]) for _ in range(3000))
    docs = spark.createDataFrame([(1, text, "und"), (2, text, "x"), (3, text, "x")], "doc_id long, text string, lang string")
    counts, _ = slow_counts([("und", text)])
    for size in (10, 64, 1000):
        parts = list(chunks(text.encode(), size, 4))
        assert [w for words, own in parts for w in words[:own]] == split(text.encode())
        found = occurrences(docs.select("lang", "text"), 5, size).where("lang = 'und'")
        ones = found.select(F.inline("entries")).groupBy("word").agg(F.sum("n").alias("n")).collect()
        assert {r["word"]: r["n"] for r in ones if r["n"]} == {w[0]: f for w, f in counts["und"].items() if len(w) == 1}


def test_long_texts_count_across_parts(spark, monkeypatch):
    from relpoint.llm import collocations as module

    rng = random.Random(4)
    rows = [(None, " ".join(rng.choice("abcde") for _ in range(2000))), ("fr", "p q r s t u " * 300)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    monkeypatch.setattr(module.occurrences, "__defaults__", (5, 50))
    assert read(collocations(docs, 20)) == slow(rows, 20)


def test_products_pass_64_bits(spark):
    big = 3_000_000_000_000
    phrases = spark.createDataFrame(
        [("x", ["p"], big + 7), ("x", ["q"], big + 1), ("x", ["p", "q"], big - 1)], "lang string, words array<string>, f long"
    )
    totals = spark.createDataFrame([("x", 10 * big + 3)], "lang string, n long")
    [row] = scored(phrases, totals).collect()
    assert row["score"] == 1000 * (big - 1) * (10 * big + 3) // ((big + 7) * (big + 1))


def test_empty_tables(spark):
    docs = documents(spark, [])
    assert collocations(docs).count() == 0
    assert collocations(documents(spark, [(1, None), (2, ""), (3, " .,\n\t")]), 1).count() == 0
    phrases, totals = frequent_phrases(documents(spark, [(1, "one two. three")]), 1)
    assert {tuple(r["words"]) for r in phrases.collect()} == {("one",), ("two",), ("three",), ("one", "two")}
    assert [r["n"] for r in totals.collect()] == [3]


def test_pairs_travel_without_their_place(spark):
    # One row per block and pair is shuffled: what differs from row to row decides the bytes.
    from relpoint.llm import collocations as module

    groups = spark.createDataFrame([(1, 7, 8, 3), (2, 7, 8, 2), (1, 7, 9, 4), (2, 9, 7, 9)], "block long, a long, b long, n long")
    found = module._frequent_pairs(groups, 5)
    assert "place" not in found.columns and "own" not in found.columns
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    rows = found.collect()
    assert {(r["block"], r["a"], r["b"]) for r in rows} == {(1, 7, 8), (2, 7, 8), (2, 9, 7)}
    assert sorted(r["f"] for r in rows if r["f"]) == [5, 9] and len({r["id"] for r in rows}) == 2
