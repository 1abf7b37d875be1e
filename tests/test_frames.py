import math
import random
from collections import Counter
from dataclasses import replace
from datetime import datetime, timedelta
from statistics import pstdev

import pytest
from pyspark.sql import functions as F

from relpoint import CompressionGraph, Edge, FrozenPlan, Relation, compile_graph
from relpoint.operators.profile import ManifestSource, with_manifests
from relpoint.plans.compiler import assert_keys, frame, shared_columns
from relpoint.spec import BASE_STATS, FAMILIES, normalize_families

START = datetime(2020, 1, 1)
CUTS = tuple(START + timedelta(days=d) for d in (10, 20, 21, 30, 35, 40))


def make_rows(n=400, seed=1):
    """Nulls everywhere, ties in time, one key with a third of all rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = 0 if i % 3 == 0 else rng.choice([None, 1, 2, 3, 4, 5])
        t = None if rng.random() < 0.03 else START + timedelta(hours=rng.randrange(0, 45 * 24, 3))
        x = None if rng.random() < 0.1 else round(rng.uniform(-50, 50), 2)
        kind = rng.choice(["a", "b", "b b", None])
        rows.append((i, key, t, x, kind, rng.choice([True, False, None]), rng.randrange(4), rng.randrange(30)))
    return rows


SCHEMA = "id bigint, k bigint, t timestamp_ntz, x double, kind string, ok boolean, peer int, episode int"


def graph(spark, rows, **options):
    users = spark.createDataFrame([(i,) for i in range(7)], "uid bigint")
    facts = spark.createDataFrame(rows, SCHEMA)
    settings = dict(
        columns=("x", "kind", "ok"),
        annotations={"big": "{x} > 10"},
        families=FAMILIES,
        windows=(3, 9),
        context_keys=("peer",),
        context_rank=True,
        episode_keys=("episode", "peer"),
        gated=(("x", "kind"),),
        stats=BASE_STATS,
        top_k=5,
        cardinality_threshold=50,
        unique_pk=True,
    )
    settings.update(options)
    fact = Relation("facts", facts, "id", "f", "t", **settings)
    user = Relation("users", users, "uid", "u")
    return CompressionGraph("users", (user, fact), (Edge("users", "facts", "uid", "k"),), CUTS)


def rows_of(df):
    return {(r["cutoff"], r["u_uid"]): r.asDict() for r in df.collect()}


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


def assert_same(left, right):
    assert left.keys() == right.keys()
    for key, row in left.items():
        for name, value in row.items():
            assert same(value, right[key][name]), (key, name, value, right[key][name])


@pytest.mark.parametrize("inclusive,lookback", [(False, None), (True, 12)])
def test_expand_equals_bucket(spark, inclusive, lookback):
    base = replace(graph(spark, make_rows()), inclusive=inclusive, lookback_days=lookback)
    frozen = compile_graph(base)
    expand = rows_of(frame(replace(base, strategy="expand"), frozen))
    bucket = rows_of(frame(replace(base, strategy="bucket"), frozen))
    assert len(expand) == len(CUTS) * 7
    assert_same(expand, bucket)


def brute(rows, key, cut, days=None):
    floor = None if days is None else cut - timedelta(days=days)
    return [r for r in rows if r[1] == key and r[2] is not None and r[2] < cut and (floor is None or r[2] >= floor)]


def test_against_brute_force(spark):
    rows = make_rows()
    got = rows_of(frame(graph(spark, rows)))
    for (cut, key), out in got.items():
        seen = brute(rows, key, cut)
        xs = [r[3] for r in seen if r[3] is not None]
        assert out["f_n_rows"] == len(seen) == out["f_pk_nunique"]
        assert out["f_big_count"] == sum(x > 10 for x in xs)
        assert same(out["f_x_std"], pstdev(xs) if xs else None)
        assert same(out["f_x_avg"], sum(xs) / len(xs) if xs else None)
        for w in (3, 9):
            inside = brute(rows, key, cut, w)
            wx = [r[3] for r in inside if r[3] is not None]
            assert out[f"f_n_rows_{w}d"] == len(inside)
            assert out[f"f_x_max_{w}d"] == (max(wx) if wx else None)
            assert same(out[f"f_x_sum_{w}d"], sum(wx) if wx else None)
            assert same(out[f"f_ok_share_{w}d"], sum(r[5] is True for r in inside) / len(inside) if inside else None)
            assert out[f"f_kind_b_count_{w}d"] == sum(r[4] == "b" for r in inside)
        kinds = Counter(r[4] for r in seen if r[4])
        assert out["f_kind_nunique"] == len(kinds)
        assert out["f_kind_mode"] == (min(kinds, key=lambda v: (-kinds[v], v)) if kinds else None)
        total = sum(kinds.values())
        assert same(out["f_kind_concentration"], sum(n * n for n in kinds.values()) / total**2 if kinds else None)
        times = sorted(r[2] for r in seen)
        gaps = [(b - a) / timedelta(days=1) for a, b in zip(times, times[1:])]
        assert same(out["f_gap_mean"], sum(gaps) / len(gaps) if gaps else None)
        assert same(out["f_gap_std"], pstdev(gaps) if gaps else None)
        assert out["f_gap_min"] == (min(gaps) if gaps else None)
        assert out["f_active_days"] == len({t.date() for t in times})
        assert out["f_episodes"] == len({(r[7], r[6]) for r in seen})
        assert out["f_days_since_last"] == ((cut.date() - times[-1].date()).days if times else None)


def test_context_against_brute_force(spark):
    rows = make_rows()
    got = rows_of(frame(graph(spark, rows)))
    for (cut, key), out in got.items():
        visible = [r for r in rows if r[1] is not None and r[2] is not None and r[2] < cut and r[3] is not None]
        peers = {}
        for r in visible:
            peers.setdefault(r[6], []).append(r[3])
        mine = [r for r in visible if r[1] == key]
        if not mine:
            assert out["f_x_peer_diff"] is None
            continue
        mean = {p: sum(v) / len(v) for p, v in peers.items()}
        diffs = [r[3] - mean[r[6]] for r in mine]
        shares = [sum(x <= r[3] for x in peers[r[6]]) / len(peers[r[6]]) for r in mine]
        zs = [(r[3] - mean[r[6]]) / pstdev(peers[r[6]]) for r in mine if pstdev(peers[r[6]]) > 0]
        assert math.isclose(out["f_x_peer_diff"], sum(diffs) / len(diffs), abs_tol=1e-9)
        assert math.isclose(out["f_x_peer_rank"], sum(shares) / len(shares), abs_tol=1e-9)
        assert same(out["f_x_peer_z"], sum(zs) / len(zs) if zs else None)


def test_future_rows_do_not_change_a_frame(spark):
    rows = make_rows()
    base = graph(spark, rows)
    last = CUTS[2]
    early = replace(base, cutoffs=CUTS[:3])
    frozen = compile_graph(early)
    noise = [(10_000 + i, i % 6, last + timedelta(hours=i), 999.0, "zzz", True, 0, 0) for i in range(50)]
    kept = [r for r in rows if r[2] is not None and r[2] < last]
    changed = replace(graph(spark, kept + noise), cutoffs=CUTS[:3])
    assert compile_graph(changed) == frozen
    assert_same(rows_of(frame(early, frozen)), rows_of(frame(changed, frozen)))


def test_row_order_does_not_matter(spark):
    rows = make_rows()
    mixed = rows[:]
    random.Random(5).shuffle(mixed)
    base = graph(spark, rows)
    frozen = compile_graph(base)
    assert compile_graph(graph(spark, mixed)) == frozen
    assert_same(rows_of(frame(base, frozen)), rows_of(frame(graph(spark, mixed), frozen)))


def test_frozen_plan_round_trip_and_replay(spark):
    base = graph(spark, make_rows())
    frozen = compile_graph(base)
    assert FrozenPlan.from_json(frozen.to_json()) == frozen
    other = graph(spark, [(1, 1, START, 1.0, "new", True, 1, 1)])
    assert frame(other, frozen).columns == frame(base, frozen).columns


def test_options(spark):
    assert normalize_families(["temporal", "base", "temporal"]) == ("temporal", "base")
    with pytest.raises(ValueError):
        normalize_families(["base", "magic"])
    with pytest.raises(ValueError, match="top_k"):
        compile_graph(graph(spark, make_rows(), top_k=None))
    narrow = compile_graph(graph(spark, make_rows(), cardinality_threshold=2)).columns["facts"]
    assert narrow.left_out == ("f_kind",) and not narrow.categories
    with pytest.raises(ValueError, match="no row is visible"):
        compile_graph(graph(spark, make_rows()), at=START)
    static = Relation("s", spark.createDataFrame([(1,)], "a int"), "a", "s", families=("base", "sequence"))
    assert static.families == ("base",)
    for odd in ({"windows": ()}, {"families": ("base",)}):
        with pytest.raises(ValueError, match="windows"):
            graph(spark, make_rows(), **odd)
    with pytest.raises(ValueError):
        graph(spark, make_rows(), annotations={"bad": "{nothing} > 1"}).relation("facts").prepared()
    with pytest.raises(ValueError):
        Relation("s", spark.createDataFrame([(1,)], "a int"), "missing", "s")


def test_hop_limit_prunes(spark):
    base = graph(spark, make_rows())
    assert frame(replace(base, hops_back=0)).columns == ["cutoff", "u_uid"]


def test_keys_restrict_rows(spark):
    base = graph(spark, make_rows())
    schema = "cutoff timestamp_ntz, uid bigint"
    keys = spark.createDataFrame([(CUTS[1], 2), (CUTS[4], 0), (CUTS[2], 99)], schema)
    whole, part = rows_of(frame(base)), rows_of(frame(base, keys=keys))
    assert set(part) == {(CUTS[1], 2), (CUTS[4], 0)}
    assert_same(part, {k: whole[k] for k in part})
    for how in ("inner", "left"):
        unknown = spark.createDataFrame([(CUTS[1], 2), (START, 1)], schema)
        with pytest.raises(Exception, match="graph lacks"):
            frame(base, keys=unknown, how=how).collect()
        twice = spark.createDataFrame([(CUTS[1], 2), (CUTS[1], 3), (CUTS[1], 2)], schema)
        with pytest.raises(Exception, match="more than once"):
            frame(base, keys=twice, how=how).collect()


def test_lookup_by_a_repeated_key_is_an_error(spark):
    links = spark.createDataFrame([(1, 10, START)], "u bigint, p bigint, at timestamp_ntz")
    places = spark.createDataFrame([(10, 1.0), (10, 2.0)], "pid bigint, size double")
    users = spark.createDataFrame([(1,)], "uid bigint")
    full = CompressionGraph(
        "users",
        (
            Relation("users", users, "uid", "u"),
            Relation("links", links, "u", "l", "at", columns=(), stats=("count",)),
            Relation("places", places, "pid", "p", columns=("size",)),
        ),
        (Edge("users", "links", "uid", "u"), Edge("links", "places", "p", "pid", reduce=False)),
        CUTS[:1],
        hops_back=2,
    )
    with pytest.raises(Exception, match="not unique"):
        frame(full).collect()


@pytest.mark.parametrize("strategy", ["expand", "bucket"])
def test_nothing_below_a_lookup_counts_before_it_is_visible(spark, strategy):
    """entity <- child -> parent born later <- grandchildren."""
    users = spark.createDataFrame([(1,)], "uid bigint")
    links = spark.createDataFrame([(1, 10, START)], "u bigint, p bigint, at timestamp_ntz")
    places = spark.createDataFrame([(10, CUTS[2], 5.0)], "pid bigint, born timestamp_ntz, size double")
    visits = spark.createDataFrame([(1, 10, START, "x"), (2, 10, START, "y"), (3, 10, CUTS[3], "y")], "vid bigint, p bigint, at timestamp_ntz, kind string")
    full = CompressionGraph(
        "users",
        (
            Relation("users", users, "uid", "u"),
            Relation("links", links, "u", "l", "at", columns=(), stats=("count", "sum")),
            Relation("places", places, "pid", "p", "born", columns=("size",)),
            Relation("visits", visits, "vid", "g", "at", columns=("kind",), stats=("count", "mode")),
        ),
        (
            Edge("users", "links", "uid", "u"),
            Edge("links", "places", "p", "pid", reduce=False),
            Edge("places", "visits", "pid", "p"),
        ),
        CUTS,
        hops_back=3,
        strategy=strategy,
    )
    got = rows_of(frame(full))
    seen = [(got[c, 1]["g_n_rows_sum"], got[c, 1]["g_kind_mode_mode"], got[c, 1]["p_size_sum"]) for c in CUTS]
    late = [(2, "x", 5.0), (3, "y", 5.0), (3, "y", 5.0)]
    assert seen == [(0, None, None)] * 3 + late


def test_shared_columns():
    assert shared_columns([["first", "shared", "x"], ["shared", "first"], ["first", "shared", "y"]]) == ["first", "shared"]


def test_plan_shape(spark, sf):
    """Literal time bounds reach the scan; no nested-loop or Cartesian join appears."""
    from relpoint.catalog.frames import customer_frame_schedule

    df = customer_frame_schedule(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert "LessThan(o_orderdate" in plan
    assert "o_orderpriority" not in plan
    assert df.select(F.count(F.lit(1))).first()[0] > 0


def test_keys_are_checked(spark):
    base = graph(spark, make_rows())
    assert_keys(base)
    doubled = make_rows() + make_rows()[:1]
    with pytest.raises(ValueError, match="not unique"):
        assert_keys(graph(spark, doubled))


def test_manifests_narrow_relations(spark):
    rows = make_rows()
    base = graph(spark, rows)
    fact = base.relation("facts")
    wide = replace(fact, df=fact.df.withColumn("constant", F.lit(1)), columns=None)
    again = wide.role("again", "g")
    both = replace(
        base,
        relations=(base.relation("users"), wide, again),
        edges=(*base.edges, Edge("users", "again", "uid", "k")),
    )
    source = ManifestSource("id", "t", ("k",), excluded=("episode",))
    narrowed = with_manifests(both, {"facts": source}, CUTS[2], {"again": "facts"})
    for name in ("facts", "again"):
        assert set(narrowed.relation(name).columns) == {"id", "k", "t", "x", "kind", "ok", "peer"}


def test_labels_are_carried(spark):
    base = graph(spark, make_rows())
    labels = [(CUTS[1], 2, 0.5), (CUTS[4], 99, 1.0), (CUTS[0], 1, 2.0)]
    keys = spark.createDataFrame(labels, "cutoff timestamp_ntz, uid bigint, y double")
    whole, got = rows_of(frame(base)), rows_of(frame(base, keys=keys, how="left"))
    assert {k: r["y"] for k, r in got.items()} == {(c, e): y for c, e, y in labels}
    assert got[CUTS[4], 99]["f_n_rows"] == 0 and got[CUTS[4], 99]["f_x_sum"] is None
    assert_same({k: {c: v for c, v in r.items() if c != "y"} for k, r in got.items() if k in whole},
                {k: whole[k] for k in got if k in whole})


@pytest.mark.parametrize("clock", [None, "at"])
def test_looked_up_columns_appear_with_their_own_time(spark, clock):
    """A lookup is masked until it is visible, also below a relation without a clock."""
    users = spark.createDataFrame([(1, 10), (2, 11)], "uid bigint, home bigint")
    links = spark.createDataFrame([(1, 10, START), (1, 11, START), (2, 10, START)], "u bigint, p bigint, at timestamp_ntz")
    places = spark.createDataFrame([(10, CUTS[0], 5.0), (11, CUTS[2], 7.0)], "pid bigint, born timestamp_ntz, size double")
    user = Relation("users", users, "uid", "u", columns=())
    link = Relation("links", links, "u", "l", clock, columns=(), stats=("count", "sum"))
    place = Relation("places", places, "pid", "p", "born", columns=("size",))
    home = place.role("home", "h")
    edges = (
        Edge("users", "links", "uid", "u"),
        Edge("links", "places", "p", "pid", reduce=False),
        Edge("users", "home", "home", "pid", reduce=False),
    )
    full = CompressionGraph("users", (user, link, place, home), edges, CUTS[:4], hops_back=2)
    keys = spark.createDataFrame([(CUTS[1], 1), (CUTS[0], 2)], "cutoff timestamp_ntz, uid bigint")
    for strategy in ("auto", "bucket"):
        got = rows_of(frame(replace(full, strategy=strategy)))
        size = {k: (r["l_n_rows"], r["p_size_sum"], r["h_size"]) for k, r in got.items()}
        assert [size[c, 1] for c in CUTS[:4]] == [(2, None, None), (2, 5.0, 5.0), (2, 5.0, 5.0), (2, 12.0, 5.0)]
        assert [size[c, 2][2] for c in CUTS[:4]] == [None, None, None, 7.0]
    left = rows_of(frame(full, keys=keys, how="left"))
    assert left[CUTS[1], 1]["h_size"] == 5.0 and left[CUTS[0], 2]["h_size"] is None
