from datetime import datetime

import pytest
from pyspark.sql import functions as F

from relpoint.functions.ordered import running_share, running_totals, with_row_id
from relpoint.functions.scalars import finite_or_null
from relpoint.operators.fit import soft_label_rows
from relpoint.operators.model_inputs import (
    InputLayout,
    align_labels,
    alignment_faults,
    category_codes,
    coerce_keys,
    encode,
    select_features,
    trainable_rows,
    with_class_weights,
)
from relpoint.operators.profile import (
    ManifestSource,
    column_statistics,
    manifest,
    manifest_columns,
    manifest_summary,
    profile_sample,
    top_values,
)
from relpoint.sources.frames import frame_statistics, read_frame, write_frame
from relpoint.sources.tables import (
    assert_unique,
    pick_column,
    register_views,
    resolve_columns,
    with_amount,
)

A, B = datetime(2020, 1, 1), datetime(2020, 2, 1)


def test_select_and_freeze(spark):
    train = spark.createDataFrame(
        [(1, "United States", 2, A, 0.5), (2, None, 3, A, 1.0)],
        "fac_facility_id bigint, fac_country string, std_phase_count bigint, timestamp timestamp_ntz, target double",
    )
    test = spark.createDataFrame([(3, None, None), (4, "Canada", 1)], "x int, fac_country string, std_phase_count bigint")
    shared = train.withColumn("my_label", F.lit(1))
    columns = select_features([shared.schema, shared.schema], "target", numeric_only=False)
    assert columns == ["fac_country", "std_phase_count"]
    assert select_features([shared.schema], "target") == ["std_phase_count"]
    layout = InputLayout.fit(train.schema, columns)
    assert layout.categorical_indices == [0]
    rows = [tuple(r) for r in layout.apply(test).collect()]
    assert rows == [("__missing__", 0.0), ("Canada", 1.0)]


def test_layout_coerces_later_types(spark):
    first = spark.createDataFrame([("a", 1.0)], "category string, amount double")
    later = spark.createDataFrame([(1, "3.0"), (2, "not-numeric")], "category bigint, amount string")
    layout = InputLayout.fit(first.schema, ["category", "amount"])
    assert [tuple(r) for r in layout.apply(later).collect()] == [("1", 3.0), ("2", 0.0)]
    missing = layout.apply(later.drop("amount")).collect()
    assert [r["amount"] for r in missing] == [0.0, 0.0]


def test_codes_and_infinity(spark):
    train = spark.createDataFrame([("b",), ("b",), ("a",), (None,)], "c string")
    codes = category_codes(train, ["c"])
    assert {r["value"]: r["code"] for r in codes.collect()} == {"a": 0, "b": 1}
    val = spark.createDataFrame([("a", 1.0), ("unknown", float("inf"))], "c string, x double")
    assert {tuple(r) for r in encode(val, codes, ["c"], ["x"]).collect()} == {(0, 1.0), (None, None)}
    assert [r[0] for r in val.select(finite_or_null(F.col("x"))).collect()] == [1.0, None]


def test_alignment(spark):
    features = spark.createDataFrame([(A, 1, 5), (B, 1, 6)], "cutoff timestamp_ntz, id bigint, f int")
    labels = spark.createDataFrame([(A, "1", 1), (A, "2", 0), (B, "x", 0)], "cutoff timestamp_ntz, e string, y int")
    got = {(r["cutoff"], r["e"]): r["f"] for r in align_labels(features, labels, "id", "e", as_text=True).collect()}
    assert got == {(A, "1"): 5, (A, "2"): None, (B, "x"): None}
    assert coerce_keys(labels, "e").count() == 2
    assert alignment_faults(features, labels, "id", "e").count() == 0
    faults = alignment_faults(features, labels.union(labels), "id", "e").collect()
    assert {r["side"] for r in faults} == {"labels"} and len(faults) == 3


def test_weights_and_usable_cutoffs(spark):
    df = spark.createDataFrame([(A, 1), (A, 0), (A, 0), (A, 0), (B, 1)], "cutoff timestamp_ntz, y int")
    assert {(r["y"], r["weight"]) for r in with_class_weights(trainable_rows(df, "y"), "y").collect()} == {
        (0, 1.0), (1, 3.0),
    }
    stats = frame_statistics(df, "y").first()
    assert (stats["n_rows"], stats["target_nunique"]) == (5, 2)


def test_profile(spark):
    rows = [(i, i % 7, datetime(2019 + i % 3, 1, 1), f"type {i % 2}", "same", f"value {i}") for i in range(1002)]
    schema = "id bigint, nct_id bigint, date timestamp_ntz, outcome_type string, constant string, high string"
    df = spark.createDataFrame(rows, schema)
    sample = profile_sample(df, "id", "date", datetime(2020, 1, 1), 10_000)
    assert sample.count() == 334 and sample.agg(F.max("date")).first()[0] < datetime(2020, 1, 1)
    with pytest.raises(ValueError):
        profile_sample(df, "id", "date", A, 0)
    source = ManifestSource("id", "date", ("nct_id",))
    found = manifest(df, source)
    assert set(manifest_columns(found)) == {"id", "nct_id", "date", "outcome_type"}
    assert tuple(manifest_summary(found).first()) == (6, 4, 1)
    approx = {r["column"]: r for r in column_statistics(df, exact=False).collect()}
    assert approx["constant"]["n_distinct"] == 1 and approx["id"]["n_rows"] == 1002
    top, left_out = top_values(df, ["outcome_type", "high"], 1, 50)
    assert top == {"outcome_type": ("type 0",)} and left_out == ("high",)


def test_columns_and_views(spark):
    assert pick_column(["UserID", "x"], ["user_id", "userid"]) == "UserID"
    assert pick_column(["x"], ["y"], required=False) is None
    with pytest.raises(ValueError):
        pick_column(["x"], ["y"])
    assert resolve_columns(["ID", "Date", "v"], ["id"], ["DATE", "none"]) == ["ID", "Date"]
    df = spark.createDataFrame([(2, 1), (1, 2), (1, 1)], "`Unnamed: 0` int, v int")
    views = register_views({"t": df}, {"t": "t_src"}, {"t": ("rid", ["v", "Unnamed: 0"])})
    assert {(r["rid"], r["v"]) for r in views["t_src"].collect()} == {(1, 1), (2, 1), (3, 2)}
    dropped = register_views({"t": df}, {"t": "t_src"}, None, {"t": ["Unnamed: 0"]})
    assert dropped["t_src"].columns == ["v"] and spark.table("t_src").count() == 3
    with pytest.raises(ValueError):
        assert_unique(df, ["v"])
    assert_unique(df, ["v", "Unnamed: 0"])


def test_amount_fallback(spark):
    events = spark.createDataFrame([(1, "2.5"), (1, "bad"), (2, None)], "k int, price string")
    items = spark.createDataFrame([(1, 7.0)], "id int, p double")
    amounts = [r["a"] for r in with_amount(events, items, "k", "id", "a", "price", "p").collect()]
    assert sorted(amounts) == [0.0, 2.5, 7.0]


def test_frame_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(A, 1, 2), (B, 1, 3)], "cutoff timestamp_ntz, e int, f int")
    path = str(tmp_path / "frame")
    write_frame(df, path)
    write_frame(df.where(F.col("e") == 1).where(f"f = 3").withColumn("f", F.lit(9)), path)
    back = {(r["cutoff"], r["f"]) for r in read_frame(spark, path, columns=["cutoff", "f"]).collect()}
    assert back == {(A, 2), (B, 9)}
    one = read_frame(spark, path, [B])
    assert [r["f"] for r in one.collect()] == [9]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cutoff" in plan or "PartitionFilters: [cutoff" in plan


def test_row_ids_with_a_heavy_value(spark):
    rows = [(0 if i % 3 else i, i) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = {r["row_id"]: (r["a"], r["b"]) for r in with_row_id(df, ["a", "b"], partitions=5).collect()}
    assert got == dict(enumerate(sorted(rows), start=1))


def test_running_totals(spark):
    rows = [("g" if i % 3 else "h", i * i % 97 + i / 1000, i % 5) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, x double, w int")
    for r in running_totals(df, ["g"], "x", ["w"], slices=8).collect():
        group = [y for y in rows if y[0] == r["g"]]
        assert r["w_before"] == sum(w for _, x, w in group if x < r["x"])
        assert r["w_total"] == sum(w for _, _, w in group)
    for r in running_share(df, ["g"], "x", "w", "s").collect():
        group = [y for y in rows if y[0] == r["g"]]
        assert r["s"] == sum(w for _, x, w in group if x <= r["x"]) / sum(w for _, _, w in group)


def test_soft_labels(spark):
    df = spark.createDataFrame([(0.25,), (1.0,)], "y double")
    rows = {(r["y"], r["__label"], r["__weight"]) for r in soft_label_rows(df, "y").collect()}
    assert rows == {(0.25, 1.0, 0.25), (0.25, 0.0, 0.75), (1.0, 1.0, 1.0)}
    with pytest.raises(Exception, match="0, 1"):
        soft_label_rows(spark.createDataFrame([(1.5,)], "y double"), "y").collect()
