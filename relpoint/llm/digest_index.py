"""Exact dedup against a persistent index of text digests, bucketed and sorted by hash."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relpoint.llm.common import fresh, parts, read, store
from relpoint.session import shared_folder


def digest(text: Column) -> Column:
    """SHA-256 of the text in UTF-8, as it stands; null is empty."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256))


class DigestIndex:
    """Table of the digests seen so far, with the id that was kept for each.

    ``digest`` binary, ``keep_id``, ``group_size`` (rows of the batch that brought the digest) and
    ``same_id`` (rows of that batch with the kept id). The table is bucketed and sorted by digest, so a
    new batch is reduced to one row per digest, shuffled once and merged with the index in place.
    With a ``path`` the table outlives the session; ``buckets`` and the id's type must then stay.
    """

    def __init__(self, spark: SparkSession, name: str, path: str | None = None, buckets: int | None = None):
        self.spark, self.name, self.path = spark, name, path
        self.buckets = buckets or parts(spark)

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def open(self, id_type: str) -> DataFrame:
        """The index; an empty one is made where there is none."""
        if not self.exists():
            self.spark.sql(
                f"CREATE TABLE {self.name} (digest BINARY, keep_id {id_type}, group_size BIGINT, same_id BIGINT)"
                f" USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS"
                + (f" LOCATION '{self.path}'" if self.path else "")
            )
        return self.spark.table(self.name)

    def add(self, rows: DataFrame) -> DataFrame:
        """Append the digests of ``rows`` (``digest``, ``id``) that the index lacks; decide on all of them.

        Returns one row per digest of ``rows``: ``digest, keep_id, group_size, same_id``. Of equal digests
        that are new the largest id is kept (null only where all are null); known ones keep their id.
        """
        known = self.open(dict(rows.dtypes)["id"]).select("digest", F.col("keep_id").alias("known_id"))
        per_id = rows.groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n"))
        groups = per_id.groupBy("digest").agg(
            F.max("id").alias("keep_id"),
            F.sum("n").alias("group_size"),
            F.max(F.struct("id", "n"))["n"].alias("same_id"),
        )
        groups = store(groups.repartition(self.buckets, "digest"), "digest-groups")
        old = groups.join(known.hint("merge"), "digest").withColumn("keep_id", F.col("known_id")).drop("known_id")
        new = groups.join(known.hint("merge"), "digest", "left_anti")
        old, new = store(old, "digest-old"), store(new, "digest-new")
        (
            new.repartition(self.buckets, "digest")
            .write.format("parquet")
            .mode("append")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name, **({"path": self.path} if self.path else {}))
        )
        return new.union(old)


def decide(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """``rows`` with the columns of their digest's group and ``kept``.

    A digest may own a third of the rows. Both sides are shuffled here, so that such a partition is split.
    """
    found = rows.join(groups.hint("merge"), "digest")
    return found.withColumn("kept", F.col("id").eqNullSafe(F.col("keep_id")))


def new_index(spark: SparkSession, buckets: int | None = None) -> DigestIndex:
    """Empty index under a name of its own in the session's shared folder."""
    name = f"digest_index_{uuid.uuid4().hex}"
    return DigestIndex(spark, name, shared_folder(spark, name), buckets)


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"))


def exact_groups(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical; null counts as empty. Without an index (or with an empty one) the
    largest doc_id of equal texts is kept; texts that the index knows keep its id, so all their rows in
    ``docs`` are dropped unless the id is the same. A null doc_id is smaller than any other. Rows that
    repeat id and text are all reported as kept; ``drop_exact`` lets one of them through. An empty table
    gives no rows; other columns are ignored.
    """
    index = index or new_index(docs.sparkSession)
    rows = digests(docs)
    return decide(rows, index.add(rows)).select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, index: DigestIndex | None = None) -> DataFrame:
    """``docs`` with one row per text, columns unchanged: the largest doc_id, of repeated rows any one.

    Rows that go are found on ids and digests alone; texts meet only the list of what to drop.
    """
    index = index or new_index(docs.sparkSession)
    rows = digests(docs)
    groups = index.add(rows)
    drop = decide(rows, groups).where(~F.col("kept")).select("id", "digest").distinct()
    [key] = fresh(docs, "digest_key")
    keyed = docs.withColumn(key, digest(F.col("text")))
    kept = keyed.join(
        drop, (keyed[key] == drop["digest"]) & keyed["doc_id"].eqNullSafe(drop["id"]), "left_anti"
    )
    if not groups.where("same_id > 1").isEmpty():
        kept = kept.dropDuplicates([key])
    return kept.drop(key)


def op7_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_groups(read(spark, folder, "documents"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents
WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

QUERIES = {"op7_exact_dedup": op7_exact_dedup}
SQL = {"op7_exact_dedup": OP7_SQL}
