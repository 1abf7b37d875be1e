"""Folding before copying: two-sided cells below timed lookups, intervals below hops, stacked peer ranks."""

import random
from dataclasses import replace
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from relpoint import CompressionGraph, Edge, Relation, compile_graph
from relpoint.functions.timegrid import CUT
from relpoint.operators.reduce import KEY, Feature, Reduction, versions
from relpoint.plans.compiler import frame
from relpoint.spec import BASE_STATS
from tests.test_frames import assert_same, rows_of

START = datetime(2020, 1, 1)
CUTS = tuple(START + timedelta(days=2 * d) for d in range(1, 51))


def moment(rng, days=110):
    return None if rng.random() < 0.05 else START + timedelta(hours=rng.randrange(days * 24))


def tables(spark, seed=1):
    """Users, links with a hot user, places and owners with clocks of their own (some null), visits."""
    rng = random.Random(seed)
    users = spark.createDataFrame([(i,) for i in range(6)], "uid bigint")
    links = [
        (i, 0 if i % 3 == 0 else rng.choice([None, 1, 2, 3, 4]), rng.randrange(25), moment(rng), rng.randrange(3), rng.choice([None, 1.5, -2.0, 4.25]))
        for i in range(250)
    ]
    links = spark.createDataFrame(links, "id bigint, u bigint, p bigint, at timestamp_ntz, peer int, x double")
    places = [
        (i, rng.choice([None, *range(8)]), moment(rng), rng.choice([None, 5.0, 7.5, -1.25]), rng.choice(["a", "b", None]), rng.choice([True, False, None]), i * 3)
        for i in range(20)
    ]
    places = spark.createDataFrame(places, "pid bigint, owner bigint, born timestamp_ntz, size double, kind string, ok boolean, rooms int")
    owners = spark.createDataFrame(
        [(i, moment(rng), float(i)) for i in range(7)], "oid bigint, since timestamp_ntz, age double"
    )
    visits = spark.createDataFrame(
        [(i, rng.randrange(25), moment(rng), rng.choice(["x", "y", None]), rng.choice([None, 1.0, 2.5])) for i in range(120)],
        "vid bigint, p bigint, at timestamp_ntz, mood string, paid double",
    )
    trips = spark.createDataFrame([(i, rng.randrange(8), moment(rng)) for i in range(60)], "tid bigint, o bigint, at timestamp_ntz")
    return users, links, places, owners, visits, trips


def graph(spark, clock="at", **options):
    users, links, places, owners, visits, trips = tables(spark)
    link = Relation(
        "links", links, "id", "l", clock, columns=("x",), stats=BASE_STATS,
        families=("base", "semantic", "conditional", "temporal", "context") if clock else ("base", "semantic"),
        windows=(5, 21) if clock else (), context_keys=("peer",), context_rank=True, unique_pk=True, top_k=3, cardinality_threshold=50,
    )
    relations = (
        Relation("users", users, "uid", "u"),
        link,
        Relation("places", places, "pid", "p", "born", columns=("size", "kind", "ok", "rooms"), categories={"kind": ("a", "b")}),
        Relation("owners", owners, "oid", "o", "since", columns=("age",)),
        Relation("visits", visits, "vid", "v", "at", columns=("mood", "paid"), stats=("count", "sum", "max", "mode", "recency")),
        Relation("trips", trips, "tid", "t", "at", columns=(), stats=("count", "sum")),
    )
    edges = (
        Edge("users", "links", "uid", "u"),
        Edge("links", "places", "p", "pid", reduce=False),
        Edge("places", "owners", "owner", "oid", reduce=False),
        Edge("places", "visits", "pid", "p"),
        Edge("owners", "trips", "oid", "o"),
    )
    settings = dict(hops_back=4, hop_stats=("sum", "avg", "min", "max"))
    settings.update(options)
    return CompressionGraph("users", relations, edges, CUTS, **settings)


@pytest.mark.parametrize(
    "clock,options",
    [("at", {}), ("at", {"inclusive": True, "lookback_days": 15}), (None, {}), ("at", {"cutoffs": CUTS[20:21]})],
)
def test_two_sided_cells_equal_copies(spark, clock, options):
    options = dict(options)
    cutoffs = options.pop("cutoffs", CUTS[::4])
    base = replace(graph(spark, clock, **options), cutoffs=cutoffs)
    frozen = compile_graph(base)
    expand = rows_of(frame(replace(base, strategy="expand"), frozen))
    bucket = rows_of(frame(replace(base, strategy="bucket"), frozen))
    assert len(expand) == len(cutoffs) * 6
    assert_same(expand, bucket)
    names = next(iter(expand.values()))
    wanted = {"p_size_sum", "p_kind_mode", "p_ok_share", "o_age_max", "v_n_rows_sum", "v_mood_mode_mode", "v_paid_max_avg", "t_n_rows_max"}
    assert wanted <= set(names), sorted(names)
    for name in wanted:
        assert len({r[name] for r in expand.values()}) > 1 or len(cutoffs) == 1, name


def explodes(df):
    """For each copy over cutoffs, whether its input is aggregated before any table is reached."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().split("\n")
    found = []
    for k, line in enumerate(lines):
        if "Generate explode(sequence(" in line:
            below = lines[k + 1 :]
            leaf = next(i for i, x in enumerate(below) if "Relation" in x or "LogicalRDD" in x)
            found.append(any("Aggregate" in x for x in below[:leaf]))
    return found


def test_nothing_is_copied_raw(spark):
    base = graph(spark)
    frozen = compile_graph(base)
    many = explodes(frame(replace(base, strategy="auto"), frozen))
    # The entity's own copies have constant ends; all that lies below it is folded first.
    assert all(many) and len(many) >= 5
    assert explodes(frame(replace(base, strategy="expand"), frozen)).count(False) > 5


def test_versions_cover_all_cutoffs(spark):
    rows = [(1, 2, 5), (1, 3, 5), (1, 4, 6), (1, 7, 6), (2, 0, None), (2, 1, None), (2, 9, 1), (3, 0, 4)]
    df = spark.createDataFrame([(k, c, v) for k, c, v in rows], f"{KEY} int, {CUT} int, n int")
    got = versions(Reduction(df, (Feature("n"),), True), 9).collect()
    by_key = {}
    for r in got:
        by_key.setdefault(r[KEY], []).append((r["since"], r["until"], r["n"]))
    assert sorted(by_key[1]) == [(0, 1, None), (2, 3, 5), (4, 4, 6), (5, 6, None), (7, 7, 6), (8, 9, None)]
    assert sorted(by_key[2], key=str) == [(0, 1, None), (2, 8, None), (9, 9, 1)]
    assert sorted(by_key[3]) == [(0, 0, 4), (1, 9, None)]


def test_versions_follow_changes_not_cutoffs(spark):
    rows = [(k, c, c // 25) for k in range(4) for c in range(50)]
    df = spark.createDataFrame(rows, f"{KEY} int, {CUT} int, n int")
    assert versions(Reduction(df, (Feature("n"),), True), 49).count() == 8


def test_ranks_of_many_columns_share_one_pass(spark):
    """As many shuffles for four columns as for one, and the same ranks."""
    rng = random.Random(2)
    users = spark.createDataFrame([(i,) for i in range(5)], "uid bigint")
    rows = [(i, rng.randrange(5), moment(rng), rng.randrange(3), *(rng.choice([None, rng.random() * 10**k]) for k in range(4))) for i in range(200)]
    facts = spark.createDataFrame(rows, "id bigint, u bigint, at timestamp_ntz, peer int, a double, b double, c double, d double")

    def ranked(*columns):
        fact = Relation(
            "facts", facts, "id", "f", "at", columns=columns, stats=("count",), families=("base", "context"),
            context_keys=("peer",), context_rank=True, unique_pk=True,
        )
        return frame(CompressionGraph("users", (Relation("users", users, "uid", "u"), fact), (Edge("users", "facts", "uid", "u"),), CUTS[::5]))

    def exchanges(df):
        return df._jdf.queryExecution().sparkPlan().toString().count("Aggregate")

    one, four = ranked("c"), ranked("a", "b", "c", "d")
    assert exchanges(one) == exchanges(four)
    for key, row in rows_of(four).items():
        seen = [r for r in rows if r[2] is not None and r[2] < key[0]]
        for at, name in ((4, "a"), (6, "c"), (7, "d")):
            mine = [r for r in seen if r[1] == key[1] and r[at] is not None]
            shares = []
            for r in mine:
                peers = [q[at] for q in seen if q[3] == r[3] and q[at] is not None]
                shares.append(sum(x <= r[at] for x in peers) / len(peers))
            expected = sum(shares) / len(shares) if shares else None
            got = row[f"f_{name}_peer_rank"]
            assert got is expected or abs(got - expected) < 1e-9


def test_entry_of_a_missing_clock(spark):
    from relpoint.functions.timegrid import CutoffGrid

    grid = CutoffGrid(CUTS[:3], inclusive=False, lookback_days=1)
    df = spark.createDataFrame(
        [(None,), (START,), (CUTS[0],), (CUTS[1] - timedelta(hours=1),), (CUTS[2],)], "t timestamp_ntz"
    )
    found = [r[0] for r in df.select(grid.entry(F.col("t"), df.schema["t"].dataType)).collect()]
    assert found == [3, 0, 1, 1, 3]
