import hashlib
import uuid

from relpoint.llm.digest_index import DigestIndex, digests, drop_exact, exact_groups
from tests.llm.fixtures import corpus, documents


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    found = []
    for i, t in rows:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        found.append((i, keep, len(own), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return found


def order(rows):
    return sorted(map(tuple, rows), key=repr)


def test_groups_match_brute_force(spark):
    rows = corpus()
    assert order(exact_groups(documents(spark, rows)).collect()) == order(expected(rows))


def test_empty_table_and_clashing_columns(spark):
    assert exact_groups(documents(spark, [])).count() == 0
    rows = [(1, "a"), (2, "a"), (3, "b")]
    clash = documents(spark, rows).selectExpr("*", "1 as digest", "2 as keep_id", "'x' as kept", "3 as id", "4 as digest_key")
    assert order(exact_groups(clash).collect()) == order(expected(rows))
    kept = drop_exact(clash)
    assert kept.columns == clash.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]


def test_one_row_of_each_text_stays(spark):
    rows = corpus()
    kept = drop_exact(documents(spark, rows)).select("doc_id", "text").collect()
    assert len(kept) == len({t or "" for _, t in rows}) == len({r["text"] or "" for r in kept})
    keep = {hashlib.sha256((t or "").encode()).hexdigest(): k for (_, t), (_, k, *_) in zip(rows, expected(rows))}
    for r in kept:
        assert keep[hashlib.sha256((r["text"] or "").encode()).hexdigest()] == r["doc_id"]


def test_later_batches_meet_the_index(spark, tmp_path):
    name = f"index_{uuid.uuid4().hex}"
    index = DigestIndex(spark, name, f"file://{tmp_path}/index", buckets=4)
    first = exact_groups(documents(spark, [(1, "a"), (2, "b"), (3, "b")]), index).collect()
    assert {r["doc_id"] for r in first if r["kept"]} == {1, 3}
    second = exact_groups(documents(spark, [(9, "a"), (8, "c"), (3, "b")]), index).collect()
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in second} == {(9, 1, False), (8, 8, True), (3, 3, True)}
    table = spark.table(name)
    assert {(r["keep_id"], r["group_size"]) for r in table.collect()} == {(1, 1), (3, 2), (8, 1)}
    described = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE FORMATTED {name}").collect()}
    assert described["Num Buckets"] == "4" and described["Sort Columns"] == "[`digest`]"
    spark.sql(f"DROP TABLE {name}")


def test_new_digests_merge_without_moving_the_index(spark, tmp_path):
    name = f"index_{uuid.uuid4().hex}"
    index = DigestIndex(spark, name, f"file://{tmp_path}/index", buckets=4)
    exact_groups(documents(spark, corpus()), index).collect()
    known = spark.table(name)
    new = digests(documents(spark, [(1, "a"), (2, "b")])).repartition(4, "digest")
    plan = new.join(known.hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and plan.split("Scan parquet")[0].count("Exchange hashpartitioning") == 1
    spark.sql(f"DROP TABLE {name}")
