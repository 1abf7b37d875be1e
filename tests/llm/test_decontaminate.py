import random
import re

import pytest

from relpoint.llm.automaton import SuffixAutomaton
from relpoint.llm.decontaminate import decontaminate, hit_words, with_matches
from tests.llm.fixtures import corpus, documents, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def slow(text, items, window=10):
    own, hit, found = plain(text), set(), set()
    for name, item in items:
        parts = plain(item)
        size = min(window, len(parts))
        for at in range(len(parts) - size + 1) if size else ():
            for k in range(len(own) - size + 1):
                if own[k : k + size] == parts[at : at + size]:
                    hit.update(range(k, k + size))
                    found |= {str(name)} - {"None"}
    return len(own), len(hit), sorted(found)


def case(seed=2):
    rng = random.Random(seed)
    items = [(k, words(rng, rng.randrange(12, 40))) for k in range(12)]
    items += [(20, "short Item"), (21, "of Three words"), (22, ""), (23, None), (None, "w1 w2"), (None, words(rng, 30)), (3, items[3][1]), (24, "three WORDS")]
    items += [(25, items[0][1] + " tail of it"), (26, "tie tie")]
    rows = corpus()
    for k in range(12):
        parts = items[k][1].split(" ")
        a = rng.randrange(len(parts) - 9)
        piece = ", ".join(parts[a : a + rng.randrange(8, 14)]).upper()
        rows.append((500 + k, words(rng, 20) + " " + piece + ". " + words(rng, 9)))
    rows += [(600, "a SHORT item! of three words"), (601, items[0][1] + " " + items[1][1]), (602, "tie tie tie tie")]
    # Windows of items without id: one short, one of ten words.
    rows += [(603, "x w1, W2 y"), (604, "a b " + " ".join(items[17][1].split()[5:20]))]
    return rows, items


@pytest.mark.parametrize("block_bytes", [2_000_000, 400])
def test_hits_match_brute_force(spark, block_bytes):
    rows, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    clash = documents(spark, rows).selectExpr("*", "1 as item", "2 as block")
    found = with_matches(clash, bench, ["n", "ids", "spans"], block_bytes=block_bytes)
    got = found.select("doc_id", "text", "n", hit_words(found["spans"]).alias("hit"), "ids", "spans").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n"], r["hit"], list(r["ids"])) == slow(r["text"], items), r["text"]
        flat = (r["text"] or "").encode()
        for s in r["spans"]:
            assert plain(flat[s["start"] : s["end"]].decode()) == plain(r["text"])[s["first"] : s["last"] + 1]


def test_clean_documents_stay_and_leaks_go(spark):
    rows, items = case()
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, rows).selectExpr("*", "'x' as spans", "1 as items", "2 as N_words")
    kept = decontaminate(docs, bench)
    assert kept.columns == docs.columns
    clean = sorted((repr(i), t or "") for i, t in rows if not slow(t, items)[1])
    assert sorted((repr(r["doc_id"]), r["text"] or "") for r in kept.collect()) == clean


def test_spans_are_cut_below_the_coverage_limit(spark):
    leak = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(1, leak)], "item_id long, text string")
    rows = [(1, "Vor é " + leak + " nach " * 30), (2, leak + " only"), (3, "clean é text"), (4, None)]
    kept = {r["doc_id"]: r["text"] for r in decontaminate(documents(spark, rows), bench, max_coverage=0.5).collect()}
    assert kept == {1: "Vor é " + " nach " * 30, 3: "clean é text", 4: None}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = documents(spark, [(1, "a b c")])
    assert [tuple(r)[0] for r in decontaminate(docs, none).collect()] == [1]
    assert decontaminate(documents(spark, []), none).count() == 0


def test_automaton_accepts_all_runs_and_no_others():
    rng = random.Random(6)
    for _ in range(30):
        items = [[b"%d" % rng.randrange(3) for _ in range(rng.randrange(0, 9))] for _ in range(4)]
        auto = SuffixAutomaton(items)
        runs = {tuple(i[a:b]) for i in items for a in range(len(i)) for b in range(a + 1, len(i) + 1)}
        text = [b"%d" % rng.randrange(4) for _ in range(40)]
        lengths = {at: n for at, _, n in auto.statistics(text, 1)}
        for at in range(len(text)):
            longest = max((n for n in range(1, at + 2) if tuple(text[at + 1 - n : at + 1]) in runs), default=0)
            assert lengths.get(at, 0) == longest
