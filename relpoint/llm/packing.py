"""Best-fit packing of tokenized documents into sequences of bounded length, in synchronous rounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relpoint.llm.common import BATCH_ROWS, give_back, parts, read, small_batches, store, texts

CAPACITY = 2048
#: Word pieces that a task remembers between texts, and those that go to the tokenizer at once.
MEMORY, LEARNED = 500_000, 1 << 13

_SPACE = bytes.maketrans(b"\n\t\r", b"   ")
_MARKS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


class Tokens:
    """Token ids of texts as little-endian 32-bit integers, by a tokenizer file.

    The tokenizer drops white space, ignores case and never joins what they part, so texts are tokenized
    run by run and each distinct run once: the runs of a batch that are new go to it together. Marks
    that follow a letter or digit are a run of their own. Special tokens are left as they stand.
    """

    def __init__(self, path: str, memory: int = MEMORY):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memory, self.known = memory, {b"": b""}
        size = self.tokenizer.get_vocab_size()
        self.last = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def _learn(self, runs: set[bytes]) -> None:
        """Ids of runs that aren't known yet."""
        known, ends, plain = self.known, {}, []
        for run in runs:
            base = run.rstrip(_MARKS)
            if base and base != run and base[-1:].isalnum() and b"<|" not in run:
                ends[run] = (base, run[len(base) :])
            else:
                plain.append(run)
        plain += {part for pair in ends.values() for part in pair if part not in known and part not in runs}
        # What the tokenizer tells of a token takes far more room than its id.
        words = [r for r in plain if one_word(r)]
        for at in range(0, len(words), LEARNED):
            some = words[at : at + LEARNED]
            self._keep(some, self._by_words(some))
        others = [r for r in plain if r not in known]
        for at in range(0, len(others), LEARNED):
            some = others[at : at + LEARNED]
            self._keep(some, self._by_runs(some))
        for run, (base, marks) in ends.items():
            known[run] = known[base] + known[marks]

    def _keep(self, runs: list[bytes], found: tuple[np.ndarray, np.ndarray] | None) -> None:
        if found is not None:
            ids, bounds = found
            flat, places = ids.astype("<u4").tobytes(), bounds.tolist()
            self.known.update((run, flat[4 * a : 4 * b]) for run, a, b in zip(runs, places, places[1:]))

    def _by_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and bounds of runs that are one word each: every word ends with a token marked so."""
        if not words:
            return None
        [found] = self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)
        ids = np.array(found.ids, dtype=np.int64)
        ends = np.flatnonzero(self.last[ids]) + 1
        return (ids, np.r_[0, ends]) if len(ends) == len(words) and ends[-1] == len(ids) else None

    def _by_runs(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids and bounds of any runs, by the word that the tokenizer names for each token."""
        if not runs:
            return None
        found = self.tokenizer.encode([r.decode() for r in runs], is_pretokenized=True, add_special_tokens=False)
        owners = np.array(found.word_ids, dtype=np.int64)
        return np.array(found.ids, dtype=np.int64), np.searchsorted(owners, np.arange(len(runs) + 1))

    def ids(self, documents: list[bytes]) -> list[bytes]:
        split = [(d if b"<|" in d else d.lower()).translate(_SPACE).split(b" ") for d in documents]
        if len(self.known) > self.memory:
            self.known = {b"": b""}
        new = {r for runs in split for r in runs}.difference(self.known)
        if new:
            self._learn(new)
            give_back()
        known = self.known
        return [b"".join([known[r] for r in runs]) for runs in split]


def one_word(run: bytes) -> bool:
    """Whether the run has letters of the Latin script only, which the tokenizer doesn't part."""
    if run.isascii():
        return run.isalpha()
    text = run.decode()
    return text.isalpha() and max(text) < "\u0250"


@lru_cache(maxsize=2)
def tokens_of(path: str, memory: int = MEMORY) -> Tokens:
    """One for each Python worker, which keeps what it has learned from task to task."""
    return Tokens(path, memory)


def pieces(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    id_col: str = "doc_id",
    with_ids: bool = False,
    memory: int = MEMORY,
    at_once: int = BATCH_ROWS,
) -> DataFrame:
    """Pieces of each document: ``id, piece, start, length, ids_crc32`` (and ``ids``, on request).

    A document is its token ids, then id 0; longer ones are cut every ``capacity`` ids. A null or blank
    text is the id 0 alone. ``tokenizer`` is a path that every executor can open. ``memory`` and ``at_once``
    bound a worker's room, not what is read: the runs it remembers and the texts it splits at a time.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col("text"))
    fields = [rows.schema["id"], *(T.StructField(n, T.LongType()) for n in ("piece", "start", "length", "ids_crc32"))]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    names = [f.name for f in fields]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(tokenizer, memory)
        for batch in (b.slice(at, at_once) for b in batches for at in range(0, b.num_rows, at_once)):
            source, found = [], []
            for row, ids in enumerate(tokens.ids(texts(batch.column(1)))):
                ids += b"\0\0\0\0"
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    source.append(row)
                    found.append((piece, at // 4, len(own) // 4, zlib.crc32(own)) + ((own,) if with_ids else ()))
            if not found:
                continue
            columns = list(zip(*found))
            arrays = [batch.column(0).take(pa.array(source)), *(pa.array(c, pa.int64()) for c in columns[:4])]
            if with_ids:
                ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in columns[4]]
                arrays.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return rows.mapInArrow(cut, T.StructType(fields))


class Run(NamedTuple):
    """Sequences first, first+1, … of equal free space, at most so many."""

    free: int
    first: int
    n: int


def sweep(lengths: np.ndarray, left: np.ndarray, gaps: list[Run]) -> tuple[list[tuple[int, int, Run]], list[Run]]:
    """One round: each gap takes at most one document, the largest that fits and isn't taken.

    Documents and gaps stand in one order by size, as runs: (length, number left) and gaps. Walking up,
    a gap's best fit is the nearest document below that no smaller gap has taken, so documents wait on a
    stack; of documents or gaps that want the same one, the first by rank get it. Returns the matches
    (length, documents matched, run of sequences) and the gaps that stay as they are.
    """
    waiting: list[list[int]] = []
    matched, idle, at = [], [], 0
    for gap in sorted(gaps):
        while at < len(lengths) and lengths[at] <= gap.free:
            if left[at]:
                waiting.append([int(lengths[at]), int(left[at])])
            at += 1
        while gap.n and waiting:
            length, n = waiting[-1]
            took = min(n, gap.n)
            matched.append((length, took, Run(gap.free, gap.first, took)))
            gap = Run(gap.free, gap.first + took, gap.n - took)
            if took == n:
                waiting.pop()
            else:
                waiting[-1][1] -= took
        if gap.n:
            idle.append(gap)
    return matched, idle


def schedule(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Where the documents of each length go: rows (length, first rank, number, sequence, offset).

    ``counts`` has the number of documents by length, at most ``capacity`` entries whatever their
    number. A round matches all open sequences with the documents left (sweep), then updates the gaps.
    When no document fits any gap, as many sequences are opened as the documents left fill at least; the
    largest documents go first.
    """
    lengths = np.array(sorted(counts), dtype=np.int64)
    left = np.array([counts[n] for n in lengths.tolist()], dtype=np.int64)
    place = {n: i for i, n in enumerate(lengths.tolist())}
    rank = np.zeros(len(lengths), dtype=np.int64)
    gaps: list[Run] = []
    rows: list[tuple[int, int, int, int, int]] = []
    opened = 0
    while left.any():
        matched, idle = sweep(lengths, left, gaps)
        if not matched:
            # No two documents of over half the capacity share a sequence; the rest fill whole ones.
            large = int(left[2 * lengths > capacity].sum())
            need = max(large, -(-int((left * lengths).sum()) // capacity), 1)
            gaps.append(Run(capacity, opened, need))
            opened += need
            continue
        gaps = idle
        for length, n, run in matched:
            i = place[length]
            rows.append((length, int(rank[i]), n, run.first, capacity - run.free))
            rank[i] += n
            left[i] -= n
            if run.free > length:
                gaps.append(Run(run.free - length, run.first, n))
        smallest = lengths[left > 0].min() if left.any() else capacity
        gaps = [g for g in gaps if g.free >= smallest]
    return np.array(rows, dtype=np.int64).reshape(-1, 5)


def ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``rank``: their number, from 0, among the rows of the same ``length``.

    Lengths are hot keys. Each is dealt to slices by a hash of the order; rows are numbered inside their
    slice and the slices of a length start where the one before ends.
    """
    slices = max(parts(rows.sparkSession), 1)
    rows = rows.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    sizes = rows.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "slice", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "slice").orderBy(*order))
    numbered = rows.withColumn("own", own).join(starts, ["length", "slice"])
    return numbered.withColumn("rank", F.col("before") + F.col("own") - 1).drop("before", "own", "slice")


def pack(rows: DataFrame, capacity: int = CAPACITY, order: list[str] | None = None) -> DataFrame:
    """``rows`` (each with a ``length`` of 1 to ``capacity``) with ``sequence_id`` and ``offset``.

    Sequences hold ``capacity`` at most and have no holes. Rows of equal length are interchangeable, so
    the rounds run on the numbers by length (``capacity`` entries at most) and give ranges of ranks;
    rows are ranked and looked up in parallel. ``order`` fixes ranks: all columns unless given. Rows
    equal in all columns of the order may swap places. An empty table gives an empty result.
    """
    order = order or rows.columns
    rows = store(rows, "pieces")
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = schedule(counts, capacity)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    found = ranked(rows, order)
    schema = T.StructType(
        [*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    lookup = rows.sparkSession.sparkContext.broadcast(plan)
    own, names = len(rows.columns), schema.fieldNames()

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = lookup.value
        keys = (plan[:, 0] << 48) + plan[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (batch.column(own + i).to_numpy() for i in (0, 1))
            at = plan[np.searchsorted(keys, (length << 48) + rank, side="right") - 1]
            new = [pa.array(at[:, 3] + rank - at[:, 1]), pa.array(at[:, 4])]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(own)), *new], names=names)

    chosen = found.select(*rows.columns, F.col("length").alias("__length"), F.col("rank").alias("__rank"))
    return chosen.mapInArrow(place, schema)


def public_tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = CAPACITY,
    with_ids: bool = False,
    memory: int = MEMORY,
    at_once: int = BATCH_ROWS,
) -> DataFrame:
    """Pieces of all documents, each with its place in a sequence; see ``pieces`` and ``pack``."""
    order = ["id", "piece", "start", "ids_crc32"]
    found = pieces(docs, tokenizer, capacity, with_ids=with_ids, memory=memory, at_once=at_once)
    return pack(found, capacity, order)


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = pack_documents(read(spark, folder, "documents"), public_tokenizer())
    return packed.select(
        F.col("id").alias("doc_id"),
        F.col("piece").cast("int").alias("piece"),
        "start",
        "length",
        "ids_crc32",
        "sequence_id",
        "offset",
    )


QUERIES = {"op8_packing": op8_packing}
#: A tokenizer isn't in SQL.
SQL: dict[str, str] = {}
