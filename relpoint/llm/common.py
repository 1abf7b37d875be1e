"""Words, stored intermediate tables and Arrow helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relpoint.session import shared_folder

#: Rows that go to Python at once. Texts can be long, so the batches are small.
BATCH_ROWS = 1000

# A-Z to a-z, other ASCII but digits and a-z to a space; bytes of longer characters stay.
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def spaced_words(text: bytes) -> list[bytes]:
    """Runs of bytes other than 0x20 and 0x09-0x0D, with A-Z in lower case."""
    return text.lower().split()


def plain_words(text: bytes) -> list[bytes]:
    """Runs of digits, letters and non-ASCII characters, with A-Z in lower case."""
    return text.translate(_PLAIN).split()


def plain_offsets(text: bytes, words: Sequence[bytes]) -> list[tuple[int, int]]:
    """Byte range of each of plain_words(text)."""
    flat, place, found = text.translate(_PLAIN), 0, []
    for word in words:
        start = flat.index(word, place)
        place = start + len(word)
        found.append((start, place))
    return found


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


@contextmanager
def one_row_batches(spark: SparkSession) -> Iterator[None]:
    """For rows that hold a block of rows each: they go to Python one by one."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(key: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the frame doesn't have, compared without case."""
    taken, found = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


@lru_cache(maxsize=1)
def _trim() -> Callable[[int], int]:
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError, TypeError):  # only glibc has it
        return lambda _: 0


def give_back() -> None:
    """Return freed memory to the system: Python workers live on, and keep theirs, while other stages run."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def arrow_map(
    df: DataFrame, each: Callable[[pa.RecordBatch], Sequence[pa.Array]], added: str | T.StructType, keep: Sequence[str]
) -> DataFrame:
    """The columns of keep and, computed batch by batch, the added ones."""
    added = T.StructType.fromDDL(added) if isinstance(added, str) else added
    schema = T.StructType([df.schema[c] for c in keep] + list(added.fields))
    names = [f.name for f in schema.fields]
    place = [df.columns.index(c) for c in keep]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                arrays = [*(batch.column(i) for i in place), *each(batch)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    if any("." in c for c in df.columns):
        df = df.toDF(*(f"c{i}" for i in range(len(df.columns))))  # mapInArrow takes a dot for a field's
    return df.mapInArrow(run, schema)
