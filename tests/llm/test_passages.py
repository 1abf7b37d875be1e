import random

import numpy as np

from relpoint.llm.paragraph_dedup import WINDOW, op5_paragraph_dedup, passage_classes, passage_units, passages
from tests.llm.fixtures import corpus, documents, words
from tests.llm.test_minhash import slow_classes


def wrapped(text, rng, low, high):
    parts, lines = text.split(), []
    while parts:
        n = rng.randrange(low, high)
        lines.append(" ".join(parts[:n]))
        parts = parts[n:]
    return "\n".join(lines)


def test_any_fifty_shared_words_share_a_window():
    rng = random.Random(1)
    for _ in range(300):
        shared = words(rng, 50, 5000)
        one, other = (f"{words(rng, rng.randrange(90), 9)} {shared} {words(rng, rng.randrange(90), 7)}" for _ in range(2))
        assert {u for _, u in passages(one.encode())} & {u for _, u in passages(other.encode())}
    assert passages(b"a b c d") == [] and passages(b"A b c\nd e") == [(0, b"a b c d e")]


def test_windows_lie_where_they_say():
    rng = random.Random(2)
    own = words(rng, 700).encode().split()
    found = passages(b"\n".join(own))
    assert all(u == b" ".join(own[n : n + WINDOW]) for n, u in found)
    assert [n for n, _ in found] == sorted({n for n, _ in found}) and np.diff([n for n, _ in found]).max() <= 31


def planted():
    """Wrapped copies, one with an edit, and a passage inside two longer paragraphs; (ids that share it, rows)."""
    rng = random.Random(3)
    short, inner = words(rng, 64, 5000), words(rng, 59, 5000)
    edited = short.split()
    edited[3] = "edited"
    rows = [(1, wrapped(short, rng, 3, 25)), (2, wrapped(short, rng, 3, 25)), (3, wrapped(" ".join(edited), rng, 2, 9))]
    rows += [(4, f"{words(rng, 40, 5000)} {inner} {words(rng, 44, 5000)}"), (5, f"{words(rng, 60, 5000)} {inner} {words(rng, 19, 5000)}")]
    rows += [(6, words(rng, 300, 5000)), (7, "A notice of six short words"), (8, "a notice of six  short words\nx")]
    return [{1, 2, 3}, {4, 5}, {7, 8}], rows


def test_query_finds_wrapped_and_embedded_passages(spark, tmp_path):
    groups, rows = planted()
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op5_paragraph_dedup(spark, str(tmp_path)).collect()
    classes = {}
    for r in got:
        classes.setdefault((r["class_doc_id"], r["class_paragraph"]), set()).add(r["doc_id"])
    joined = [set().union(*(c for c in classes.values() if c & g)) for g in groups]
    assert joined == groups and 6 not in {r["doc_id"] for r in got}
    assert all((r["paragraph"] < 0) == (r["class_paragraph"] < 0) for r in got)


def test_classes_match_all_pairs(spark):
    rows = [r for r in corpus() if r[0] is not None and r[0] != 400]
    rows = list(dict(rows).items()) + [(900 + i, t) for i, t in planted()[1]]
    got = {(r["id"], r["unit"]): ((r["first_id"], r["first_unit"]), r["class_size"]) for r in passage_classes(documents(spark, rows)).collect()}
    assert got == slow_classes(rows, passages, passage_units())


def test_texts_that_repeat_few_words_have_few_windows():
    for period in (1, 2, 7, 19, 30):
        own = [f"w{k % period}".encode() for k in range(1000)]
        found = passages(b" ".join(own))
        assert len(found) <= 981 // min(31, period + 31) + 981 // 31 + 2 and len({u for _, u in found}) <= 2
        assert np.diff([n for n, _ in found]).max() <= 31


def test_shared_runs_of_repetitive_texts_share_a_window():
    rng = random.Random(5)
    for _ in range(400):
        shared = words(rng, 50, rng.choice([1, 2, 3, 5]))
        one, other = (f"{words(rng, rng.randrange(90), 2)} {shared} {words(rng, rng.randrange(90), 3)}" for _ in range(2))
        assert {u for _, u in passages(one.encode())} & {u for _, u in passages(other.encode())}


def test_all_runs_of_fifty_words_that_documents_share(spark, sf):
    """Recall against every run of 50 words of the given table, by plain comparison."""
    rows = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    units = {i: {u for _, u in passages(t)} for i, t in rows}
    owners = {}
    for i, t in rows:
        own = t.lower().split()
        for k in range(len(own) - 49):
            owners.setdefault(b" ".join(own[k : k + 50]), set()).add(i)
    pairs = {(a, b) for ids in owners.values() for a in ids for b in ids if a < b}
    assert pairs and all(units[a] & units[b] for a, b in pairs)


def test_classes_inside_one_document_are_left_out(spark, tmp_path):
    rng = random.Random(9)
    refrain, common = words(rng, 40, 5000), words(rng, 60, 5000)
    rows = [(1, "\n".join([refrain, words(rng, 30, 5000)] * 3)), (2, f"{words(rng, 30, 5000)}\n{common}"), (3, f"{common}\n{words(rng, 20, 5000)}")]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r["doc_id"] for r in op5_paragraph_dedup(spark, str(tmp_path)).collect()} == {2, 3}
