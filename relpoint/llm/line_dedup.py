"""Fuzzy line dedup: MinHash of character shingles; one line of each class of near-equal lines stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relpoint.llm.common import read
from relpoint.llm.minhash import Units, joined_units, without_units

#: Characters of a shingle and the Jaccard similarity of a link. Ten bands of three hashes find a pair of
#: that similarity with probability 0.9992.
SHINGLE, THRESHOLD, BANDS, ROWS = 8, 0.8, 10, 3


def lines(text: bytes) -> list[tuple[int, bytes]]:
    """Numbered lines that aren't blank, with A-Z in lower case and single spaces."""
    found = ((n, b" ".join(line.split())) for n, line in enumerate(text.lower().split(b"\n")))
    return [(n, line) for n, line in found if line]


def line_units(shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> Units:
    return Units(lines, shingle, False, bands, rows, threshold)


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Class of each line that isn't blank; see ``joined_units`` for the columns.

    Lines are near-equal if the sets of their character shingles have a Jaccard similarity of the
    threshold or more; a shorter line is one shingle. Classes are the connected components. Null texts
    have no lines; repeated lines are one class; an empty table gives no rows; other columns are ignored.
    """
    return joined_units(docs, line_units(**options), id_col, text_col)


def dedup_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one line of each class, in the document with the smallest id; columns unchanged."""
    return without_units(docs, line_classes(docs, **options))


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every line with its class: the place of the class's first line, its size, and whether this one stays."""
    found = line_classes(read(spark, folder, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.col("unit").alias("line"),
        F.col("first_id").alias("class_doc_id"),
        F.col("first_unit").alias("class_line"),
        F.col("class_size").alias("class_lines"),
        "kept",
    )


QUERIES = {"op1_line_dedup": op1_line_dedup}
#: MinHash and components aren't in SQL.
SQL: dict[str, str] = {}
