"""Near-equal units of text (lines, paragraphs): MinHash banding, exact Jaccard, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relpoint.llm.common import arrow_map, fresh, small_batches, store, texts
from relpoint.llm.components import components, union_find

#: Symbols hashed at once, bytes of text verified at once, and the bits of the filter that spares the join most texts.
BLOCK = 1 << 17
VERIFIED = 1 << 22
FILTER_BITS = 1 << 26
#: Units of a bucket up to which those apart are compared pair by pair; units of a block beyond, and the
#: shingles that two blocks are compared by at once.
SMALL, PART, COLUMNS = 16, 256, 4096

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


# What each byte adds to its word's hash, and the power a byte's place is weighed with; it is odd, so it has an inverse.
_BYTES = np.random.default_rng(21).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE, _INVERSE = np.uint64(0x2545F4914F6CDD1D), np.uint64(pow(0x2545F4914F6CDD1D, -1, 2**64))
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    found = np.full(n, base, dtype=np.uint64)
    found[0] = 1
    return np.multiply.accumulate(found)


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of a text, by its bytes alone, and where the words start and stop.

    Bytes weighed by powers of their place are summed up over the whole text; the sums at a word's ends give its
    own, which is freed of the place by the inverse power.
    """
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, dtype=bool)
    np.logical_not(_BLANK[data], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = edges[::2], edges[1::2]
    room = max(1 << 18, 1 << len(data).bit_length())
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTES[data] * _powers(int(_BASE), room)[: len(data)], out=sums[1:])
    found = (sums[stops] - sums[starts]) * _powers(int(_INVERSE), room)[starts]
    found ^= found >> np.uint64(32)
    found *= _MIX
    found ^= found >> np.uint64(29)
    return found, starts, stops


@dataclass(frozen=True)
class Units:
    """How texts are split and compared.

    ``split`` gives the units of a text, normalised; ``words`` shingles of ``size`` words, else of
    characters; ``bands`` of ``rows`` hashes: a pair of similarity s shares a bucket with probability
    1 - (1 - s^rows)^bands. A unit shorter than a shingle is one shingle.
    """

    split: Callable[[bytes], list[tuple[int, bytes]]]
    size: int
    words: bool
    bands: int = 10
    rows: int = 3
    threshold: float = 0.8

    def symbols(self, units: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols (hashed words or characters) of all units in a row, and how many each has."""
        if self.words:
            counts = np.fromiter((u.count(b" ") + 1 for u in units), np.int64, len(units))
            return word_hashes(b" ".join(units))[0], counts
        whole = b"".join(units)
        if whole.isascii():
            return np.frombuffer(whole, np.uint8).astype(np.uint64), np.fromiter(map(len, units), np.int64, len(units))
        counts = np.fromiter((len(u.decode()) for u in units), np.int64, len(units))
        return np.frombuffer(whole.decode().encode("utf-32-le"), "<u4").astype(np.uint64), counts

    def shingles(self, unit: bytes) -> set:
        parts = unit.split(b" ") if self.words else unit.decode()
        if len(parts) <= self.size:
            return {tuple(parts) if self.words else parts}
        if self.words:
            return set(zip(*(parts[i:] for i in range(self.size))))
        return {parts[i : i + self.size] for i in range(len(parts) - self.size + 1)}

    def jaccard(self, one: set, other: set) -> float:
        both = len(one & other)
        return both / (len(one) + len(other) - both)


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(20)
    return draw.integers(0, 2**32, n, dtype=np.uint32), draw.integers(0, 2**31, n, dtype=np.uint32) * 2 + 1


def runs_of(flat: np.ndarray, size: int) -> np.ndarray:
    """A polynomial of each ``size`` values in a row, from those of half as many."""
    runs, span = flat.copy(), 1
    for bit in bin(size)[3:]:
        runs = runs[:-span] * np.uint64(pow(int(_STEP), span, 2**64)) + runs[span:]
        span *= 2
        if bit == "1":
            runs = runs[:-1] * _STEP + flat[span:]
            span += 1
    return runs


def rolled(flat: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A 64-bit hash of each run of ``size`` symbols, and where the runs of each sequence start and stop.

    A sequence shorter than that counts as one run, filled up with zeros. Between two sequences' runs lie some
    that cross over; they belong to no sequence.
    """
    short = np.maximum(size - counts, 0)
    lengths = counts + short
    starts = np.cumsum(lengths) - lengths
    if short.any():
        full = np.zeros(int(lengths.sum()), dtype=np.uint64)
        full[np.arange(len(flat)) + np.repeat(np.cumsum(short) - short, counts)] = flat
        flat = full
    runs = runs_of(flat, size)
    runs ^= runs >> np.uint64(29)
    runs *= _MIX
    return runs, starts, starts + lengths - size + 1


def minima(flat: np.ndarray, counts: np.ndarray, size: int, n: int) -> np.ndarray:
    """For each of the sequences of symbols in ``flat``, the least value of each of n hashes over its shingles."""
    runs, starts, stops = rolled(flat, counts, size)
    short = np.append((runs >> np.uint64(32)).astype(np.uint32), np.uint32(0))
    # What lies between the shingles of two sequences is passed over.
    bounds = np.stack([starts, stops], axis=1).ravel()
    change, factor = _coefficients(n)
    found = np.empty((len(counts), n), dtype=np.uint32)
    mixed = np.empty_like(short)
    for i in range(n):
        np.bitwise_xor(short, change[i], out=mixed)
        np.multiply(mixed, factor[i], out=mixed)
        found[:, i] = np.minimum.reduceat(mixed, bounds)[::2]
    return found


def blocks(sizes: Iterable[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of places whose sizes are ``most`` or less in all; a larger one stands alone."""
    start = stop = total = 0
    for size in sizes:
        if total and total + size > most:
            yield start, stop
            start, total = stop, 0
        total += size
        stop += 1
    if start < stop:
        yield start, stop


def signatures(units: Sequence[bytes], how: Units) -> np.ndarray:
    """Minima of each unit, computed in blocks of bounded size; long units are cut with overlap."""
    n = how.bands * how.rows
    found = np.empty((len(units), n), dtype=np.uint32)
    for start, stop in blocks(map(len, units), BLOCK):
        flat, counts = how.symbols(units[start:stop])
        if stop - start > 1 or len(flat) <= BLOCK:
            found[start:stop] = minima(flat, counts, how.size, n)
            continue
        cuts = (flat[at : at + BLOCK + how.size - 1] for at in range(0, max(1, len(flat) - how.size + 1), BLOCK))
        found[start] = np.min([minima(c, np.array([len(c)]), how.size, n)[0] for c in cuts], axis=0)
    return found


def shingle_hashes(units: Sequence[bytes], how: Units) -> list[np.ndarray]:
    """The distinct shingles of each unit as sorted 64-bit hashes."""
    found = []
    for start, stop in blocks(map(len, units), BLOCK):
        flat, counts = how.symbols(units[start:stop])
        runs, starts, stops = rolled(flat, counts, how.size)
        for a, b in zip(starts.tolist(), stops.tolist()):
            own = np.sort(runs[a:b])
            fresh_run = own[1:] != own[:-1]
            found.append(own if fresh_run.all() else own[np.r_[True, fresh_run]])
    return found


def near(one: np.ndarray, other: np.ndarray, threshold: float) -> bool:
    """Whether two units of these ``shingle_hashes`` have a Jaccard similarity of the threshold or more.

    Sizes tell some dissimilar units; of long ones, the lower third of one's hashes, which is a random part of its
    shingles, tells most: more outside the other than a similar unit can have in all rule the link out.
    """
    few, many = (one, other) if len(one) <= len(other) else (other, one)
    if len(few) < threshold * len(many) - 1e-6:
        return False
    outside = len(few) - threshold * (len(few) + len(many)) / (1 + threshold)
    for part in (few[: len(few) // 3], few) if len(few) > 300 else (few,):
        places = many.searchsorted(part)
        places[places == len(many)] = 0
        missing = len(part) - int(np.count_nonzero(many[places] == part))
        if missing > outside + 1e-6:
            return False
    both = len(few) - missing
    return both >= threshold * (len(few) + len(many) - both) - 1e-9


def buckets(found: np.ndarray, how: Units) -> np.ndarray:
    """One number for each unit and band."""
    keys = np.empty((len(found), how.bands), dtype=np.uint64)
    for band in range(how.bands):
        key = np.full(len(found), band + 1, dtype=np.uint64)
        for row in range(how.rows):
            key = (key ^ found[:, band * how.rows + row]) * _STEP
            key ^= key >> np.uint64(31)
        keys[:, band] = key * _MIX
    return keys.view(np.int64)


def with_units(docs: DataFrame, how: Units, id_col: str, text_col: str) -> DataFrame:
    """``id``, ``unit`` (its number in the text), ``key`` (XXH64 of the unit) and ``bands``.

    ``bands`` is empty for a unit that its batch of rows already had.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = T.StructType([rows.schema["id"], *T.StructType.fromDDL("unit long, key long, bands array<long>").fields])
    names = schema.fieldNames()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, numbers, keys, first, new = [], [], [], {}, []
            for row, text in enumerate(texts(batch.column(1))):
                for number, unit in how.split(text):
                    key = xxhash.xxh64_intdigest(unit)
                    if key not in first:
                        first[key] = len(keys)
                        new.append(unit)
                    source.append(row)
                    numbers.append(number)
                    keys.append(key)
            if not keys:
                continue
            own = buckets(signatures(new, how), how)
            offsets = np.zeros(len(keys) + 1, dtype=np.int32)
            places = np.fromiter(first.values(), np.int64, len(first))
            offsets[places + 1] = how.bands
            bands = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(own.ravel()))
            arrays = [
                batch.column(0).take(pa.array(source)),
                pa.array(numbers, pa.int64()),
                pa.array(np.array(keys, dtype=np.uint64).view(np.int64)),
                bands,
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(cut, schema)


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bloom filter of the keys in FILTER_BITS bits, whatever their number: 8 MB in words of 64 bits.

    Keys are hashes, so their lower bits and those above 2^32 are its two hash functions.
    """
    mask = F.lit(FILTER_BITS - 1).cast("long")
    places = F.array(F.col("key").bitwiseAND(mask), F.shiftright("key", 32).bitwiseAND(mask))
    words = keys.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 6).alias("w"))
    got = words.agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits")).toArrow()
    found = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    found[got["w"].to_numpy()] = got["bits"].to_numpy()
    return found


def unit_texts(docs: DataFrame, keys: DataFrame, how: Units, text_col: str) -> DataFrame:
    """``key`` and ``text`` of the units whose key is in ``keys`` (distinct).

    A filter of fixed size leaves out most other units before the shuffle; the join is exact.
    """
    rows = docs.select(F.col(text_col).alias("text"))
    lookup = docs.sparkSession.sparkContext.broadcast(key_filter(keys))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {}
            for text in texts(batch.column(0)):
                for _, unit in how.split(text):
                    found.setdefault(xxhash.xxh64_intdigest(unit), unit)
            own = np.fromiter(found, np.uint64, len(found)).view(np.int64)
            keep = np.ones(len(own), dtype=bool)
            for at in (own & (FILTER_BITS - 1), (own >> 32) & (FILTER_BITS - 1)):
                keep &= (lookup.value[at >> 6] >> (at & 63)) & 1 == 1
            if keep.any():
                units = [u for u, k in zip(found.values(), keep) if k]
                yield pa.RecordBatch.from_arrays([pa.array(own[keep]), pa.array(units, pa.binary())], names=["key", "text"])

    some = rows.mapInArrow(cut, "key long, text binary")
    return some.join(keys.hint("merge"), "key", "left_semi").groupBy("key").agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, known: DataFrame, how: Units) -> DataFrame:
    """The pairs ``a``, ``b`` whose units have a Jaccard similarity of the threshold or more.

    Pairs are taken in blocks of bounded text; a text that a block has several times is shingled once.
    """
    a, b = (known.toDF(n, f"text_{n}") for n in "ab")
    joined = pairs.join(b.hint("merge"), "b").join(a.hint("merge"), "a").select("a", "b", "text_a", "text_b")

    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        one, other, texts_one, texts_other = (batch.column(i).to_pylist() for i in range(4))
        found = []
        for start, stop in blocks((len(x) + len(y) for x, y in zip(texts_one, texts_other)), VERIFIED):
            part = slice(start, stop)
            held = dict(zip(one[part], texts_one[part])) | dict(zip(other[part], texts_other[part]))
            hashes = dict(zip(held, shingle_hashes(list(held.values()), how)))
            found += [near(hashes[a], hashes[b], how.threshold) for a, b in zip(one[part], other[part])]
        return [pa.array(found, pa.bool_())]

    return arrow_map(joined, each, "same boolean", ["a", "b"]).where("same").select("a", "b")


def central(members: DataFrame) -> DataFrame:
    """``bucket`` and its ``centre``: the member that meets most others, over all of its buckets."""
    weights = members.groupBy("key").agg(F.sum("n").alias("w"))
    weighed = members.select("bucket", "key").join(weights.hint("merge"), "key")
    best = F.max(F.struct("w", (-F.col("key")).alias("k")))
    return store(weighed.groupBy("bucket").agg((-best["k"]).alias("centre")), "centres")


def links_across(
    members: DataFrame, parts: DataFrame, done: DataFrame, known: DataFrame, how: Units, block: int = PART
) -> DataFrame:
    """Verified pairs ``a``, ``b`` of units that share a bucket but not a part, enough to connect them.

    Buckets of up to SMALL units are compared pair by pair. In larger ones, units outside the largest
    part are dealt to blocks of about ``block`` by a hash, as are those of the largest part, and a task
    compares two blocks at once: each pair of blocks of the former, and each of the former with each of
    the latter. It returns a spanning forest of the links, so no list of pairs is ever made.
    """
    placed = members.join(parts.toDF("key", "part").hint("merge"), "key", "left")
    placed = store(placed.withColumn("part", F.coalesce("part", "key")), "placed")
    by_part = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("size"))
    split = by_part.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("size").alias("all"), F.max(F.struct("size", "part")).alias("top")
    )
    split = split.where("parts > 1").select("bucket", "all", F.col("top.size").alias("most"), F.col("top.part").alias("top"))
    apart = placed.select("bucket", "key", "part").join(store(split, "split").hint("merge"), "bucket")
    apart = store(apart.withColumn("inside", F.col("part") == F.col("top")), "apart")

    few = apart.where(F.col("all") <= SMALL)
    one = few.where("not inside").select("bucket", F.col("key").alias("a"), F.col("part").alias("part_a"))
    other = few.select("bucket", F.col("key").alias("b"), F.col("part").alias("part_b"), "inside")
    across = (F.col("part_a") != F.col("part_b")) & (F.col("inside") | (F.col("a") < F.col("b")))
    pairs = one.join(other.hint("merge"), "bucket").where(across)
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    done = done.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    of_few = verified(store(pairs.join(done.hint("merge"), ["a", "b"], "left_anti"), "across"), known, how)

    many = apart.where(F.col("all") > SMALL).join(known.hint("merge"), "key")
    blocks_in = F.ceil(F.col("most") / block).cast("int")
    blocks_out = F.ceil((F.col("all") - F.col("most")) / block).cast("int")
    number = F.xxhash64("key", F.lit(3))
    own = F.pmod(number, F.when(F.col("inside"), blocks_in).otherwise(blocks_out)).cast("int")
    many = many.withColumns({"own": own, "ins": blocks_in, "outs": blocks_out})
    outside = F.transform(F.sequence(F.lit(0), F.col("outs") - 1), lambda j: F.struct(
        F.least("own", j).alias("i"), F.greatest("own", j).alias("j"), F.lit(False).alias("with_top")
    ))
    to_top = F.transform(F.sequence(F.lit(0), F.col("ins") - 1), lambda j: F.struct(
        F.col("own").alias("i"), j.alias("j"), F.lit(True).alias("with_top")
    ))
    from_top = F.transform(F.sequence(F.lit(0), F.col("outs") - 1), lambda i: F.struct(
        i.alias("i"), F.col("own").alias("j"), F.lit(True).alias("with_top")
    ))
    meets = F.when(F.col("inside"), from_top).otherwise(F.concat(outside, to_top))
    dealt = many.select("bucket", "key", "part", "text", F.col("own"), F.col("inside"), F.explode(meets).alias("m"))
    second = F.when(F.col("m.with_top"), F.col("inside")).otherwise(F.col("own") == F.col("m.j"))
    dealt = dealt.select("bucket", "m.i", "m.j", "m.with_top", "key", "part", "text", second.alias("second"))
    found = dealt.groupBy("bucket", "i", "j", "with_top").applyInArrow(
        lambda table: compared(table, how), "a long, b long"
    )
    return of_few.union(found)


def compared(table: pa.Table, how: Units) -> pa.Table:
    """Spanning forest of the links between two blocks (or inside one) of ``key, part, text, second``."""
    keys, parts = (table[n].to_numpy() for n in ("key", "part"))
    second = table["second"].to_numpy(zero_copy_only=False)
    sets = shingle_hashes(table["text"].to_pylist(), how)
    right = np.flatnonzero(second)
    left = right if second.all() else np.flatnonzero(~second)
    sizes = np.array([len(s) for s in sets])
    ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
    owners = np.repeat(np.arange(len(sets)), sizes)
    both = np.ones(len(ids), dtype=bool)
    for side in (left, right):
        seen = np.zeros(len(ids), dtype=bool)
        seen[flat[np.isin(owners, side)]] = True
        both &= seen
    column = np.cumsum(both) - 1
    shared = both[flat]
    flat, owners = column[flat[shared]], owners[shared]
    row = np.full(len(sets), -1)
    overlap = np.zeros((len(left), len(right)), dtype=np.float32)
    for start in range(0, int(both.sum()), COLUMNS):
        inside = (flat >= start) & (flat < start + COLUMNS)
        sides = []
        for side in (left, right):
            row[:] = -1
            row[side] = np.arange(len(side))
            mine = inside & (row[owners] >= 0)
            marks = np.zeros((len(side), COLUMNS), dtype=np.float32)
            marks[row[owners[mine]], flat[mine] - start] = 1
            sides.append(marks)
        overlap += sides[0] @ sides[1].T
    total = sizes[left][:, None] + sizes[right][None, :] - overlap
    links = (overlap + 1e-6 >= how.threshold * total) & (parts[left][:, None] != parts[right][None, :])
    x, y = np.nonzero(links)
    if len(x):
        nodes, root = union_find(keys[left[x]], keys[right[y]])
        nodes, root = nodes[nodes != root], root[nodes != root]
    else:
        nodes = root = np.zeros(0, dtype=np.int64)
    return pa.table({"a": pa.array(root, pa.int64()), "b": pa.array(nodes, pa.int64())})


def bucketed(units: DataFrame) -> DataFrame:
    """``bucket``, ``key``, ``n`` and ``other`` of the buckets that hold several units; ``n`` counts their rows.

    A bucket of two rows is one row, its smaller key and the ``other``; a larger one has a row for each key. All
    buckets are shuffled once; the window of a bucket spills.
    """
    bucket = Window.partitionBy("bucket")
    banded = units.select("key", F.explode("bands").alias("bucket"))
    seen = banded.select(
        "bucket",
        "key",
        F.count(F.lit(1)).over(bucket).alias("n"),
        F.min("key").over(bucket).alias("a"),
        F.max("key").over(bucket).alias("b"),
    )
    several = seen.where("a < b and (n > 2 or key = a)")
    return several.select("bucket", "key", "n", F.when(F.col("n") == 2, F.col("b")).alias("other")).distinct()


def joined_units(docs: DataFrame, how: Units, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each unit: ``id, unit, key, class_key, first_id, first_unit, class_size, across, kept``.

    Equal units have one key and are compared once. In each bucket all units are compared with a central
    one, which joins families of copies at a cost in proportion to their size. Units of a bucket that are
    then still apart are compared across the parts (``links_across``), so no link of a bucket is passed
    over, and no pairs inside a part are made.
    A class is kept in the row with the smallest id and unit number (null ids come first). ``across`` tells that
    it has units of several ids.
    """
    small_batches(docs.sparkSession)
    units = store(with_units(docs, how, id_col, text_col), "units")
    placed = store(bucketed(units), "members")
    members = placed.where("n > 2").select("bucket", "key", "n")
    centres = central(members)
    of_many = members.join(centres.hint("merge"), "bucket").where("key <> centre")
    of_many = of_many.select(F.col("centre").alias("a"), F.col("key").alias("b"))
    of_two = placed.where("n = 2").select(F.col("key").alias("a"), F.col("other").alias("b"))
    stars = store(of_two.union(of_many).distinct(), "stars")
    keys = store(stars.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "keys")
    known = store(unit_texts(docs, keys, how, text_col), "texts")
    edges = store(verified(stars, known, how), "links")
    parts = store(components(edges), "parts")

    more = store(links_across(members, parts, stars, known, how), "links")
    if not more.isEmpty():
        parts = store(components(edges.union(more)), "parts")

    firsts = units.groupBy("key").agg(
        F.min(F.struct("id", "unit")).alias("first"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n")
    )
    classed = store(firsts.join(parts.toDF("key", "part"), "key", "left"), "classed")
    across = ~F.col("first.id").eqNullSafe(F.col("last_id"))
    # Most units are linked to no other and are a class as they stand; only the rest is grouped and joined.
    alone = classed.where("part is null").select(
        "key", F.col("key").alias("part"), "first", F.col("n").alias("size"), across.alias("across")
    )
    linked = classed.where("part is not null")
    classes = linked.groupBy("part").agg(
        F.min("first").alias("first"), F.max("last_id").alias("last_id"), F.sum("n").alias("size")
    )
    classes = store(classes.select("part", "first", "size", across.alias("across")), "classes")
    of_linked = linked.select("key", "part").join(classes.hint("merge"), "part")
    labels = alone.union(of_linked.select("key", "part", "first", "size", "across"))
    found = units.select("id", "unit", "key").join(labels.hint("merge"), "key")
    return found.select(
        "id",
        "unit",
        "key",
        F.col("part").alias("class_key"),
        F.col("first.id").alias("first_id"),
        F.col("first.unit").alias("first_unit"),
        F.col("size").alias("class_size"),
        "across",
        F.struct("id", "unit").eqNullSafe(F.col("first")).alias("kept"),
    )


def without_units(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the units that aren't kept, columns unchanged; units are the lines of the text.

    Ids tell documents apart: rows that repeat an id lose the same lines, rows without one stay as they are.
    """
    own, gone = fresh(docs, "own", "gone")
    drop = found.where("not kept").groupBy("id").agg(F.collect_set("unit").alias(gone)).withColumnRenamed("id", own)
    joined = docs.join(drop, docs[id_col] == drop[own], "left")
    lines = F.filter(F.split(text_col, "\n", -1), lambda _, i: ~F.array_contains(gone, i.cast("long")))
    left = F.when(F.col(gone).isNull(), F.col(text_col)).otherwise(F.array_join(lines, "\n"))
    return joined.withColumn(text_col, left).select(*[F.col(f"`{c}`") for c in docs.columns])
