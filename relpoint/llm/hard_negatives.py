"""Hard negatives by an inverted multi-index.

Each half of the space has a codebook; the pairs of codes are cells, and every vector lies in one. An anchor's
score with a vector of a cell is at most the sum of two half bounds (score with the code plus the half's norm
times the code's radius), so a heap over the two sorted lists of half bounds visits the cells by falling bound.
A window (scores between two limits) is certified once it holds what it asks for, and the next bound is lower.
Then no cell left can change it: results are exact, the codebooks only decide how much is read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relpoint.llm.common import arrow_map, one_row_batches, read, small_batches, store

#: Codes of a half (the index has the square of it as cells), rows that the codebooks are fitted on, and rows of
#: a block. Larger tables are better off with more codes.
CODES, SAMPLE, BLOCK = 16, 8192, 1024
#: Cells that the first round visits; each later one goes four times as far.
FIRST_CELLS = 8
#: Scaled vectors shorter than this have components that fit into an int and scores that fit into a long.
NORM = 2.0**30
LEAST, MOST = -(2**63), 2**63 - 1


class Half(NamedTuple):
    """Components [first, last) of a vector (None: to the end), their codes, and the largest distance to each."""

    first: int
    last: int | None
    codes: np.ndarray
    radius: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        """This half of the rows of x; missing components are zero."""
        part, width = x[:, self.first : self.last], self.codes.shape[1]
        return np.pad(part, ((0, 0), (0, max(width - part.shape[1], 0))))

    def wide(self, part: np.ndarray) -> np.ndarray:
        """The codes with zeros for components that only ``part`` has."""
        return np.pad(self.codes, ((0, 0), (0, part.shape[1] - self.codes.shape[1])))


def fitted(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """k-means codes of the rows of x; fewer rows than k are codes themselves."""
    if not x.size:
        return np.zeros((1, x.shape[1]))
    rows = np.unique(x, axis=0)
    if len(rows) <= k:
        return rows
    codes = rows[np.random.default_rng(11).choice(len(rows), k, replace=False)]
    for _ in range(rounds):
        near = nearest(x, codes)
        sums = np.zeros_like(codes)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=k)[:, None]
        codes = np.where(n > 0, sums / np.maximum(n, 1), codes)
    return codes


def nearest(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.argmin((codes**2).sum(1) - 2 * x @ codes.T, axis=1)


def matrix(lists: pa.ListArray, dtype: type = np.float64) -> np.ndarray:
    """Rows of a list column; shorter ones end in zeros."""
    sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat, width = lists.flatten().to_numpy(zero_copy_only=False), int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(dtype)
    out = np.zeros((len(sizes), width), dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def quantised(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = 256
) -> DataFrame:
    """``id, label, q`` (floor of scale times each component) of the rows that take part, one per id.

    Rows with a null label or vector, or a component that is null or not finite, take no part; nor do rows
    without an id, which can't be named, and vectors of a norm of 2^30 or more once scaled, whose scores
    might leave the long type. Of rows that share an id the one with the largest label, then vector, counts.
    """
    vector = F.transform(F.col(vector_col), lambda v: v.cast("double"))
    whole = F.forall("v", lambda v: v.isNotNull() & (F.abs(v) < F.lit(float("inf"))))
    found = rows.select(
        F.col(id_col).cast("long").alias("id"),
        (F.col("label") if label is None else label).cast("long").alias("label"),
        vector.alias("v"),
    ).where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & whole)
    scaled = F.transform("v", lambda v: v * F.lit(float(scale)))
    found = found.withColumn("v", scaled).where(
        F.aggregate("v", F.lit(0.0), lambda n, v: n + v * v) < F.lit(NORM**2)
    )
    found = found.select("id", "label", F.transform("v", lambda v: F.floor(v).cast("int")).alias("q"))
    one = F.max(F.struct("label", "q")).alias("one")
    return found.groupBy("id").agg(one).select("id", "one.label", "one.q")


class Index(NamedTuple):
    """Blocks of the rows of each cell, and the halves with their radii. ``filled``: the cells with rows."""

    blocks: DataFrame
    halves: tuple[Half, Half]
    filled: frozenset[int]

    @property
    def codes(self) -> int:
        return len(self.halves[1].codes)


def build(rows: DataFrame, codes: int = CODES, sample: int = SAMPLE, block: int = BLOCK) -> Index:
    """Index of all rows of ``id, label, q``.

    Codebooks are fitted on the ``sample`` rows of smallest hash; radii and cells come from all rows. A cell
    is dealt to as many blocks as its rows ask for, so a cell that holds a third of the rows is many blocks.
    """
    spark = rows.sparkSession
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("q").toArrow().column(0).combine_chunks()
    x = matrix(drawn)
    middle = x.shape[1] // 2
    bare = [(0, middle, fitted(x[:, :middle], codes)), (middle, None, fitted(x[:, middle:], codes))]
    shared = spark.sparkContext.broadcast([Half(a, b, c, np.zeros(len(c))) for a, b, c in bare])
    width = len(bare[1][2])

    def assign(batch: pa.RecordBatch) -> list[pa.Array]:
        x, cell, apart = matrix(batch.column(2)), 0, []
        for half in shared.value:
            part = half.of(x)
            wide = half.wide(part)
            near = nearest(part, wide)
            cell = cell * width + near
            apart.append(pa.array(np.sqrt(((part - wide[near]) ** 2).sum(1))))
        return [pa.array(cell, pa.int64()), *apart]

    placed = store(arrow_map(rows, assign, "cell long, apart1 double, apart2 double", rows.columns), "cells")
    stats = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("apart1").alias("r1"), F.max("apart2").alias("r2"))
    stats = stats.collect()  # one row a cell
    radii = [np.zeros(len(c)) for _, _, c in bare]
    for r in stats:
        for radius, code, far in zip(radii, divmod(r["cell"], width), (r["r1"], r["r2"])):
            radius[code] = max(radius[code], far)
    shares = [(r["cell"], -(-r["n"] // block)) for r in stats]
    dealt = F.broadcast(spark.createDataFrame(shares, "cell long, shares long"))  # one row a cell
    placed = placed.join(dealt, "cell").withColumn("part", F.pmod(F.xxhash64("id"), "shares"))
    rows_of = F.collect_list(F.struct("id", "label", "q")).alias("members")
    blocks = store(placed.groupBy("cell", "part").agg(rows_of), "cell-blocks")
    halves = tuple(Half(a, b, c, r) for (a, b, c), r in zip(bare, radii))
    return Index(blocks, halves, frozenset(r["cell"] for r in stats))


def by_bound(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """Pairs (bound, i, j) by falling sum first[i] + second[j]: the multi-sequence walk over two sorted lists."""
    rows, columns = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap, seen = [(-(first[rows[0]] + second[columns[0]]), 0, 0)], {(0, 0)}
    while heap:
        bound, a, b = heapq.heappop(heap)
        yield -bound, int(rows[a]), int(columns[b])
        for place in ((a + 1, b), (a, b + 1)):
            if place[0] < len(rows) and place[1] < len(columns) and place not in seen:
                seen.add(place)
                heapq.heappush(heap, (-(first[rows[place[0]]] + second[columns[place[1]]]), *place))


WINDOWS = "array<struct<w:int,low:long,high:long,last:long,last_id:long,filled:boolean>>"
ASK = ("id", "label", "q", "windows")


def _visits(asks: DataFrame, index: Index, start: int, stop: int) -> DataFrame:
    """Cells number start to stop of each ask's walk that one of its windows still needs."""
    halves, filled = index.halves, index.filled
    at = {c: i for i, c in enumerate(asks.columns)}

    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        x = matrix(batch.column(at["q"]))
        bounds = []
        for half in halves:
            part = half.of(x)
            norm = np.sqrt((part**2).sum(1))[:, None]
            # Scores are integers and the sums are not exact: one is added.
            exact = part @ half.wide(part).T + norm * half.radius
            bounds.append(exact + np.abs(exact) * 1e-9 + 1)
        cells = []
        for windows, first, second in zip(batch.column(at["windows"]).to_pylist(), *bounds):
            floor = min(max(w["low"], w["last"]) if w["filled"] else w["low"] for w in windows)
            mine = []
            for number, (bound, i, j) in enumerate(by_bound(first, second)):
                if bound < floor or number >= stop:
                    break
                if number >= start and i * len(second) + j in filled:
                    mine.append(i * len(second) + j)
            cells.append(mine)
        return [pa.array(cells, pa.list_(pa.int64()))]

    found = arrow_map(asks, each, "cells array<long>", asks.columns)
    return found.select("*", F.explode("cells").alias("cell")).drop("cells")


def _best(scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray, want: int) -> list[tuple[int, int]]:
    """(row, column) of the ``want`` allowed entries of each row: highest scores first, ties by id."""
    if scores.shape[1] > 4 * want:
        # Entries below a row's want-th best can't be among them.
        kth = np.partition(np.where(allowed, scores, LEAST), -want, axis=1)[:, -want]
        allowed = allowed & (scores >= kth[:, None])
    rows, columns = np.nonzero(allowed)
    order = np.lexsort((ids[columns], -scores[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    starts = np.searchsorted(rows, rows)
    kept = np.arange(len(rows)) - starts < want
    return list(zip(rows[kept].tolist(), columns[kept].tolist()))


def _scored(pairs: DataFrame, want: int, same: bool) -> DataFrame:
    """``id, w, other_id, score``: what each pair of blocks adds to the windows of its asks."""
    at = {c: i for i, c in enumerate(pairs.columns)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                asks, members = batch.column(at["asks"])[k].values, batch.column(at["members"])[k].values
                (ids, labels, a), (other, kinds, b) = (
                    (x.field("id").to_numpy(), x.field("label").to_numpy(), matrix(x.field("q"))) for x in (asks, members)
                )
                width = min(a.shape[1], b.shape[1])
                a, b = a[:, :width], b[:, :width]
                if (a**2).sum(1).max() * (b**2).sum(1).max() < 2.0**104:
                    scores = (a @ b.T).astype(np.int64)  # sums stay below 2^52, so they are exact
                else:
                    scores = a.astype(np.int64) @ b.astype(np.int64).T
                kind = (labels[:, None] == kinds) == same
                kind &= ids[:, None] != other
                windows = asks.field("windows")
                owner = np.repeat(np.arange(len(ids)), windows.value_lengths().to_numpy())
                low, high, last, last_id, w = (
                    windows.flatten().field(c).to_numpy() for c in ("low", "high", "last", "last_id", "w")
                )
                full = windows.flatten().field("filled").to_numpy(zero_copy_only=False)
                s = scores[owner]
                better = (s > last[:, None]) | ((s == last[:, None]) & (other < last_id[:, None]))
                allowed = kind[owner] & (s >= low[:, None]) & (s <= high[:, None]) & (better | ~full[:, None])
                found = _best(s, other, allowed, want)
                if found:
                    r, c = (np.array(x) for x in zip(*found))
                    columns = ids[owner[r]], w[r].astype(np.int32), other[c], s[r, c]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["id", "w", "other_id", "score"])

    return pairs.mapInArrow(run, "id long, w int, other_id long, score long")


def search(index: Index, asks: DataFrame, want: int, same: bool, block: int = BLOCK) -> DataFrame:
    """``id, w, rank, other_id, score``: the best ``want`` rows of each window of each ask.

    ``asks``: ``id, label, q`` and ``windows``, an array of ``w, low, high``; rows of the same label count
    (``same``) or those of other labels, never the row itself. Rounds visit cells in the order of their bounds; what was
    found so far tells the next round which windows are certified and which scores are too low. An
    ask meets only the cells that it needs, in blocks of asks and rows, so no task holds a whole cell.
    """
    spark = asks.sparkSession
    slots = max(1, -(-asks.count() // block))
    best: DataFrame | None = None
    start, stop = 0, FIRST_CELLS
    cells = len(index.halves[0].codes) * len(index.halves[1].codes)
    while start < cells:
        visits = _visits(_with_state(asks, best, want), index, start, stop)
        slot = F.pmod(F.xxhash64("id"), F.lit(slots)).alias("slot")
        packed = visits.groupBy("cell", slot).agg(F.collect_list(F.struct(*ASK)).alias("asks"))
        packed = store(packed, "cell-asks")
        if packed.isEmpty():
            break
        with one_row_batches(spark):
            found = store(_scored(packed.join(index.blocks, "cell").select("asks", "members"), want, same), "cell-scores")
        order = Window.partitionBy("id", "w").orderBy(F.col("score").desc(), "other_id")
        found = found if best is None else found.unionByName(best.drop("rank"))
        best = store(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= want), "best-scores")
        start, stop = stop, stop * 4
    if best is None:
        best = spark.createDataFrame([], "id long, w int, other_id long, score long, rank int")
    return best.select("id", "w", "rank", "other_id", "score")


def _with_state(asks: DataFrame, best: DataFrame | None, want: int) -> DataFrame:
    """Asks whose windows know their last place so far: its score and id, and whether all places are taken."""
    empty = "struct(x.w as w, x.low as low, x.high as high, {} as last, {} as last_id, {} as filled)"
    if best is None:
        fresh = empty.format(f"{MOST}L", f"{MOST}L", "false")
        return asks.select("id", "label", "q", F.expr(f"transform(windows, x -> {fresh})").alias("windows"))
    ends = best.where(F.col("rank") == want).groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("w", F.struct("score", "other_id")))).alias("ends")
    )
    known = empty.format(f"coalesce(ends[x.w].score, {MOST}L)", f"coalesce(ends[x.w].other_id, {MOST}L)", "ends[x.w] is not null")
    state = F.expr(f"transform(windows, x -> {known})").alias("windows")
    none = F.expr("map_from_entries(cast(array() as array<struct<w:int,s:struct<score:bigint,other_id:bigint>>>))")
    joined = asks.join(ends, "id", "left").withColumn("ends", F.coalesce("ends", none))
    return joined.select("id", "label", "q", state)


def hard_negatives(
    rows: DataFrame,
    anchors: Column | None = None,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    codes: int = CODES,
    sample: int = SAMPLE,
    block: int = BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for ``id, label, q``.

    Each anchor's first ``positives`` other rows of its label, and for each of them the first ``negatives`` rows
    of other labels that score between ``low`` and ``high`` hundredths of the positive. Higher scores
    come first, ties go to the smaller id; copies of a vector are rows of their own. Vectors of different
    length meet in the components that both have. An anchor without a positive, or a positive without a
    negative in its window (as with a score below zero), gives no rows; so does an empty table.
    """
    rows = store(rows.select("id", "label", "q"), "vectors")
    index = build(rows, codes, sample, block)
    asks = rows.where(anchors if anchors is not None else F.col("id") % 100 == 0)
    every = F.expr(f"array(struct(0 as w, cast({LEAST + 1}L as bigint) as low, {MOST}L as high))")
    near = search(index, asks.withColumn("windows", every), positives, True, block)
    near = near.select("id", F.col("rank").alias("w"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    p = F.col("positive_score").cast("decimal(19,0)")
    window = F.struct(
        "w", F.ceil(p * low / 100).cast("long").alias("low"), F.floor(p * high / 100).cast("long").alias("high")
    )
    near = near.withColumn("window", window)
    windows = near.groupBy("id").agg(F.collect_list("window").alias("windows"))  # at most one a positive
    far = search(index, asks.join(windows, "id"), negatives, False, block)
    return near.join(far, ["id", "w"]).select(
        F.col("id").alias("anchor_id"),
        "positive_id",
        "rank",
        F.col("other_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    table = read(spark, folder, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(quantised(table, label=label))


OP11_SQL = """
WITH v AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
),
s AS (
  SELECT a.id, b.id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.id <> b.id
  WHERE a.id % 100 = 0
),
p AS (
  SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, other) <= 5
),
n AS (
  SELECT p.id AS anchor_id, p.other AS positive_id, s.other AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.id, p.other ORDER BY s.score DESC, s.other) AS rank
  FROM p JOIN s ON s.id = p.id AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
"""

QUERIES = {"op11_hard_negatives": op11_hard_negatives}
SQL = {"op11_hard_negatives": OP11_SQL}
