"""Substring dedup: lines and passages that repeat, exactly or nearly, by MinHash banding of word shingles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relpoint.llm.common import read
from relpoint.llm.minhash import Units, joined_units, runs_of, without_units, word_hashes

#: Words of a shingle and the Jaccard similarity of a link. Ten bands of three hashes find a pair of that
#: similarity with probability 0.9992.
SHINGLE, THRESHOLD, BANDS, ROWS = 5, 0.8, 10, 3
#: Words from which a line or text has units: those of a shingle. What is shorter has no shingle to compare.
LEAST_WORDS = SHINGLE
#: Passages: windows of WINDOW words that start where the hash of a shingle is the least of REACH ones in a row.
#: Any run of WINDOW + REACH - 1 = 50 words that two texts share gives both the same window in it.
WINDOW, REACH = 20, 31
#: A window's shingles are 16, so a pair of the threshold is nearly equal; four bands of two find it with 0.98.
PASSAGE_BANDS, PASSAGE_ROWS = 4, 2

_MIX = np.uint64(0xBF58476D1CE4E5B9)


def paragraphs(text: bytes) -> list[tuple[int, bytes]]:
    """Numbered lines of enough words, with A-Z in lower case and single spaces."""
    found = ((n, line.split()) for n, line in enumerate(text.lower().split(b"\n")))
    return [(n, b" ".join(words)) for n, words in found if len(words) >= LEAST_WORDS]


def anchors(words: np.ndarray, window: int = WINDOW, reach: int = REACH, shingle: int = SHINGLE) -> list[int]:
    """First words of the windows of a text, from its words' hashes; they depend on words near them only, not on lines.

    Of ``reach`` windows in a row one with the least hash is taken. Equal hashes are equal windows, so of several any
    will do: the one taken before stays while it is in reach, else the last one is taken (robust winnowing,
    Schleimer et al. 2003). A text that repeats a few words thus has a window per reach, not per word.
    """
    places = len(words) - window + 1
    if places < 2:
        return [0]
    runs = runs_of(words, shingle)
    whole = runs[:places].copy()
    for j in (*range(shingle, window - shingle, shingle), window - shingle):
        whole ^= whole >> np.uint64(31)
        whole *= _MIX
        whole += runs[j : j + places]
    whole ^= whole >> np.uint64(29)
    whole *= _MIX
    if places <= reach:
        return [int(whole.argmin())]
    # A window is the least of some reach if the greatest of the least values of its reaches is its own.
    low = _slide(np.minimum, whole, reach)
    edge = np.zeros(reach - 1, dtype=np.uint64)
    taken = np.flatnonzero(_slide(np.maximum, np.concatenate([edge, low, edge]), reach) == whole)
    if (whole[taken[1:]] != whole[taken[:-1]]).all():
        return taken.tolist()
    return _robust(whole, low, reach)


def _slide(best: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """The best of each ``width`` values in a row, from the best of 2, 4, 8 and so on."""
    span = 1
    while 2 * span <= width:
        values = best(values[:-span], values[span:])
        span *= 2
    rest = width - span
    return best(values[: len(values) - rest], values[rest:]) if rest else values


def _robust(whole: np.ndarray, low: np.ndarray, reach: int) -> list[int]:
    view = np.lib.stride_tricks.sliding_window_view(whole, reach)
    last = reach - 1 - view[:, ::-1].argmin(axis=1) + np.arange(len(low))
    at, taken = 0, [int(last[0])]
    while True:
        held = taken[-1]
        lower = np.flatnonzero(low[at + 1 : held + 1] < whole[held])
        at = at + 1 + int(lower[0]) if len(lower) else held + 1
        if at >= len(low):
            return taken
        taken.append(int(last[at]))


def passages(text: bytes) -> list[tuple[int, bytes]]:
    """Windows over the words of the whole text, numbered by their first word; a short text is one window."""
    text = text.lower()
    words, starts, stops = word_hashes(text)
    if len(words) < LEAST_WORDS:
        return []
    found = []
    for n in anchors(words):
        run = text[starts[n] : stops[min(n + WINDOW, len(words)) - 1]]
        found.append((n, b" ".join(run.split())))
    return found


def paragraph_units(shingle: int = SHINGLE, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS) -> Units:
    return Units(paragraphs, shingle, True, bands, rows, threshold)


def passage_units(bands: int = PASSAGE_BANDS, rows: int = PASSAGE_ROWS, threshold: float = THRESHOLD) -> Units:
    return Units(passages, SHINGLE, True, bands, rows, threshold)


def paragraph_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Class of each paragraph; see ``joined_units`` for the columns.

    Paragraphs are linked if the sets of their word shingles have a Jaccard similarity of the threshold or
    more, and classes are the connected components. Null texts have no paragraphs; repeated ones are one
    class; an empty table gives no rows; other columns are ignored.
    """
    return joined_units(docs, paragraph_units(**options), id_col, text_col)


def passage_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Class of each passage, as ``paragraph_classes``; ``unit`` is the passage's first word in the text."""
    return joined_units(docs, passage_units(**options), id_col, text_col)


def dedup_paragraphs(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one paragraph of each class, in the document with the smallest id; columns unchanged."""
    return without_units(docs, paragraph_classes(docs, **options))


def op5_paragraph_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every unit that other documents repeat: its class, the class's first place and size, and whether it stays.

    Classes inside one document are left out: a refrain isn't a copy. ``paragraph`` is a line's number, or -1 - n for the passage that starts at word n, wherever lines break.
    """
    docs = read(spark, folder, "documents")
    lines = paragraph_classes(docs).where("across")
    runs = passage_classes(docs).where("across")
    runs = runs.withColumns({"unit": -1 - F.col("unit"), "first_unit": -1 - F.col("first_unit")})
    return lines.unionByName(runs).select(
        F.col("id").alias("doc_id"),
        F.col("unit").alias("paragraph"),
        F.col("first_id").alias("class_doc_id"),
        F.col("first_unit").alias("class_paragraph"),
        F.col("class_size").alias("class_paragraphs"),
        (~F.col("kept")).alias("removed"),
    )


QUERIES = {"op5_paragraph_dedup": op5_paragraph_dedup}
#: MinHash and components aren't in SQL.
SQL: dict[str, str] = {}
