"""SimHash near-dedup: fingerprints on a grid of per-segment bit counts, verified bit by bit."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relpoint.llm.common import arrow_map, fresh, read, small_batches, spaced_words, store, texts
from relpoint.llm.components import components
from relpoint.llm.minhash import Units, joined_units

#: Words of a shingle; differing bits of a link. The grid's radius and the star links rest on 2.
SHINGLE = 3
DISTANCE = 2
#: Segments of the grid: 16 segments of 4 bits tell about 2^32 cells apart.
SEGMENTS = 16
#: Fingerprints of a cell that are compared pair by pair. Fuller cells are embedded anew, one bit a segment.
CELL = 16

# For each byte, its 8 bits as the 8 bytes of an integer: 255 of them add up without a carry.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8").ravel()
_BITS = np.uint64(1) << np.arange(64, dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Integer whose bits are set in over half of the hashes."""
    total = np.zeros(64, dtype=np.int64)
    for start in range(0, len(hashes), 255 * 256):
        block = _SPREAD[hashes[start : start + 255 * 256].view(np.uint8).reshape(-1, 8)]
        sums = np.add.reduceat(block, np.arange(0, len(block), 255), axis=0)
        total += sums.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(_BITS[2 * total > len(hashes)].sum(dtype=np.uint64))


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of the word shingles, repeats included; fewer words make one shingle, none give 0."""
    words = spaced_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: -shingle] + 1]).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())]
    return majority(np.array(hashes, dtype="<u8"))


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``docs`` and the fingerprint (64 bits as long) of each whole text."""
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        found = [fingerprint(x, shingle) for x in texts(batch.column(place))]
        return [pa.array(np.array(found, dtype=np.uint64).view(np.int64))]

    return arrow_map(docs, each, f"`{name}` long", docs.columns)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``id`` and ``fp`` of each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return with_fingerprint(rows, "fp", "text", shingle).select("id", "fp")


def counts_vector(fp: Column, segments: int = SEGMENTS) -> Column:
    """Bits set in each segment, one digit per segment; the distance of two vectors bounds that of the bits."""
    size = 64 // segments
    width, mask = size.bit_length(), (1 << size) - 1
    total = F.lit(0).cast("long")
    for i in range(segments):
        ones = F.bit_count(F.shiftrightunsigned(fp, size * i).bitwiseAND(F.lit(mask).cast("long")))
        total = total + F.shiftleft(ones.cast("long"), width * i)
    return total


def cells(fps: DataFrame, segments: int = SEGMENTS) -> DataFrame:
    """Each fingerprint in the cells at Manhattan distance 1 or less of its vector.

    Two vectors at a distance of 2 or less have such a cell in common: the one half way.
    """
    size = 64 // segments
    width = size.bit_length()
    based = fps.select("fp", counts_vector(F.col("fp"), segments).alias("base"))
    near = [F.col("base")]
    for i in range(segments):
        digit = F.shiftrightunsigned("base", width * i).bitwiseAND(F.lit((1 << width) - 1).cast("long"))
        one = F.lit(1 << (width * i)).cast("long")
        near += [F.when(digit < size, F.col("base") + one), F.when(digit > 0, F.col("base") - one)]
    return based.select("fp", F.explode(F.array(*near)).alias("cell")).where("cell is not null")


def links(fps: DataFrame, segments: int = SEGMENTS, cell: int = CELL) -> DataFrame:
    """Edges ``a``, ``b`` that connect the distinct fingerprints ``fp`` at 2 or fewer differing bits.

    A cell of two is compared as it is aggregated; cells of up to ``cell`` members pair by pair, with the
    bits as the join's condition. Members of fuller cells are embedded again with one bit a segment,
    where distances are exact: all of a cell (65 at most) differ from its centre in one bit at most, so
    a star connects them. Every link between two fingerprints is in a cell of one of the three kinds.
    """
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    placed = cells(fps, segments)
    counted = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")
    )
    counted = store(counted.where((F.col("n") > 2) | ((F.col("n") == 2) & near)), "simhash-cells")
    of_two = counted.where("n = 2").select("a", "b")
    members = placed.join(counted.where("n > 2").select("cell", "n"), "cell")
    members = store(members, "simhash-members")
    some = members.where(F.col("n") <= cell)
    of_some = (
        some.select("cell", F.col("fp").alias("a"))
        .join(some.select("cell", F.col("fp").alias("b")), "cell")
        .where((F.col("a") < F.col("b")) & near)
        .select("a", "b")
    )
    many = members.where(F.col("n") > cell).select("fp").distinct()
    flips = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(int(x)).cast("long")) for x in _BITS.view(np.int64)]
    stars = (
        many.select("fp", F.explode(F.array(*flips)).alias("centre"))
        .groupBy("centre")
        .agg(F.collect_list("fp").alias("fps"))  # 65 at most
        .where(F.size("fps") > 1)
    )
    of_many = stars.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a < b")
    return of_two.union(of_some).union(of_many).distinct()


def whole(text: bytes) -> list[tuple[int, bytes]]:
    """The words of a text as one unit; none without words."""
    words = spaced_words(text)
    return [(0, b" ".join(words))] if words else []


def similar_texts(shingle: int = 5, threshold: float = 0.8) -> Units:
    return Units(whole, shingle, True, threshold=threshold)


def similar_links(docs: DataFrame, how: Units, text_col: str = "text") -> DataFrame:
    """Edges ``a``, ``b`` that connect the fingerprints of texts with similar shingles, at any bit distance."""
    rows = docs.select(F.col(text_col).alias("text"))
    found = joined_units(with_fingerprint(rows, "fp"), how, "fp", "text")
    return found.where("id <> first_id").select(F.col("first_id").alias("a"), F.col("id").alias("b")).distinct()


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    segments: int = SEGMENTS,
    cell: int = CELL,
    similar: Units | None = None,
) -> DataFrame:
    """``id``, ``fp`` and ``component`` (smallest id reachable over links) for each row of ``docs``.

    Equal fingerprints are linked, so the search runs on distinct ones only. Null and blank texts have
    fingerprint zero. A null id is passed over by the minimum (a group of nulls has component null);
    repeated rows share their group; an empty table gives no rows. Other columns are ignored.
    With ``similar``, texts whose shingles have its Jaccard similarity are linked too: near copies differ in
    more bits than cells of any small radius reach, so MinHash bands find them and exact counts decide.
    """
    rows = store(fingerprints(docs, id_col, text_col), "simhash-rows")
    fps = store(rows.groupBy("fp").agg(F.min("id").alias("least")), "simhash-fps")
    edges = links(fps.select("fp"), segments, cell)
    if similar:
        edges = edges.union(similar_links(docs, similar, text_col))
    joined = store(components(edges), "simhash-joined")
    named = fps.join(joined.toDF("fp", "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = store(named, "simhash-named")
    least = store(named.groupBy("root").agg(F.min("least").alias("component")), "simhash-least")
    labels = store(named.join(least, "root").select("fp", "component"), "simhash-labels")
    return rows.join(labels, "fp").select("id", "fp", "component")


def drop_near(
    docs: DataFrame, segments: int = SEGMENTS, cell: int = CELL, similar: Units | None = None
) -> DataFrame:
    """``docs`` with the smallest doc_id of each group, columns unchanged.

    A group whose ids are all null keeps one row for each fingerprint. Where rows share an id, they are
    told apart by fingerprint, and of rows equal in both one stays.
    """
    groups = store(near_groups(docs, segments=segments, cell=cell, similar=similar), "simhash-groups")
    fp, gone, gone_fp = fresh(docs, "fp", "gone", "gone_fp")
    drop = groups.where(~F.col("id").eqNullSafe(F.col("component")))
    drop = drop.select(F.col("id").alias(gone), F.col("fp").alias(gone_fp)).distinct()
    same = docs["doc_id"].eqNullSafe(F.col(gone))
    if groups.groupBy("id").count().where("count > 1").isEmpty():
        return docs.join(drop, same, "left_anti")
    keyed = with_fingerprint(docs, fp)
    same = keyed["doc_id"].eqNullSafe(F.col(gone)) & (F.col(fp) == F.col(gone_fp))
    return keyed.join(drop, same, "left_anti").dropDuplicates(["doc_id", fp]).drop(fp)


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = near_groups(read(spark, folder, "documents"))
    return groups.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


QUERIES = {"op4_simhash": op4_simhash}
#: XXH64 with a seed isn't in the SQL of the check.
SQL: dict[str, str] = {}
