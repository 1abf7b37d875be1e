"""Phrase collocations by SETM: sorted occurrence relations, extended by one word a round.

R(k) holds the occurrences of k-word phrases, persisted in the order of (piece, position) and cut into blocks
of bounded size. A round counts the groups of R(k), semi-joins R(k) with the frequent ones and merge-joins the
rest with itself at adjacent positions, which gives R(k+1): two k-word phrases that overlap in all but one
word. Only groups travel: once per block and phrase, not once per occurrence, and without their place in the
block, which is found again in the block's sorted list.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from relpoint.llm.common import one_row_batches, parts, read, store, texts

#: Occurrences that make a phrase frequent, words of the longest phrase, phrases reported per language, and
#: the share of a phrase (in hundredths) that a longer one has to reach to stand for it.
LEAST, LONGEST, TOP, COVER = 100, 5, 2000, 100
#: Positions in the buffers of one task, distinct words in one buffer, and bytes of text that are split at once.
BLOCK_WORDS, BLOCK_DISTINCT, CHUNK_BYTES = 1 << 22, 1 << 20, 1 << 23

#: A word's number is a long: task (23 bits), block of the task (16 bits), place in the block (24 bits).
BLOCK_BITS, PLACE_BITS = 16, 24

RELATION = "block long, lang string, own int, groups array<int>, entries array<struct<{}n:long>>"

# Every separator becomes a full stop, which therefore is no word; A-Z to a-z, tabs to spaces.
_MARK, _END = b".", re.compile(rb"[\x09-\x0d .,;:!?]")
_FLAT = bytes(
    b + 32 if 65 <= b <= 90 else 46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256)
)


def split(text: bytes) -> list[bytes]:
    """Words of a text in order, with a full stop wherever a piece ends."""
    return text.translate(_FLAT).replace(_MARK, b" . ").split()


def chunks(text: bytes, size: int, ahead: int) -> Iterator[tuple[list[bytes], int]]:
    """(words, number of own ones): a long text in parts that end between words, each with ``ahead`` more words."""
    start = 0
    while True:
        end = _END.search(text, start + size)
        if end is None:
            words = split(text[start:])
            yield words, len(words)
            return
        stop = end.start()
        words = split(text[start:stop])
        yield words + _first(text, stop, ahead), len(words)
        start = stop


def _first(text: bytes, start: int, n: int) -> list[bytes]:
    """The first n words at a place, however long they are."""
    size = 256
    while True:
        found = split(text[start : start + size])
        if len(found) > n or start + size >= len(text):
            return found[:n]
        size *= 8


class _Buffer:
    """Positions of one language: local numbers of words in order, -1 between pieces."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[_MARK]  # number 0
        self.runs: list[np.ndarray] = []
        self.size = 0

    def add(self, words: list[bytes]) -> None:
        run = np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words))
        self.runs += [run, np.zeros(1, np.int32)]
        self.size += len(run) + 1

    def entries(self, own: int | None = None) -> tuple[int, np.ndarray, list[dict]]:
        groups = np.concatenate(self.runs) - 1
        own = len(groups) if own is None else own
        inside = groups[:own]
        counts = np.bincount(inside[inside >= 0], minlength=len(self.numbers) - 1)
        words = [w.decode("utf-8", "replace") for w in self.numbers][1:]
        return own, groups.astype(np.int32), [{"word": w, "n": int(n)} for w, n in zip(words, counts)]


def _row(block: int, lang: str, own: int, groups: np.ndarray, entries: pa.Array, kind: pa.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([block], pa.int64()),
            pa.array([lang]),
            pa.array([own], pa.int32()),
            pa.ListArray.from_arrays(pa.array([0, len(groups)], pa.int32()), pa.array(groups, pa.int32())),
            pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), entries.cast(kind)),
        ],
        names=["block", "lang", "own", "groups", "entries"],
    )


def occurrences(docs: DataFrame, longest: int = LONGEST, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """R(1) of ``lang, text``: blocks of one language, with the words and counts of each."""
    kind = pa.struct([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, buffers = TaskContext.get().partitionId() << BLOCK_BITS, {}

        def emit(lang: str, buffer: _Buffer, own: int | None = None) -> pa.RecordBatch:
            nonlocal number
            number += 1
            own, groups, entries = buffer.entries(own)
            return _row(number, lang, own, groups, pa.array(entries, kind), kind)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), texts(batch.column(1))):
                for words, own in chunks(text, chunk_bytes, longest - 1):
                    if own < len(words):
                        # Words ahead belong to the next part; phrases that start there are counted there.
                        buffer = _Buffer()
                        buffer.add(words)
                        yield emit(lang, buffer, own)
                        continue
                    buffer = buffers.setdefault(lang, _Buffer())
                    buffer.add(words)
                    if len(buffer.numbers) > BLOCK_DISTINCT or sum(b.size for b in buffers.values()) > BLOCK_WORDS:
                        full = max(buffers, key=lambda x: buffers[x].size)
                        yield emit(full, buffers.pop(full))
        for lang, buffer in buffers.items():
            yield emit(lang, buffer)

    return docs.mapInArrow(run, RELATION.format("word:string,"))


def _places(a: np.ndarray, b: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Where the pairs (first, second) stand among the sorted pairs (a, b), which have all of them."""
    left, right = np.unique(a), np.unique(b)

    def code(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.searchsorted(left, x) * len(right) + np.searchsorted(right, y)

    return np.searchsorted(code(a, b), code(first, second))


def extended(joined: DataFrame) -> DataFrame:
    """R(k+1) from R(k) and the frequent groups of each block: common ``ids``, and ``places`` in the block's list
    or, from pairs on, the pairs ``first, second`` to find in it (``a, b``)."""
    kind = pa.struct([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])
    at = {c: i for i, c in enumerate(joined.columns)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block, lang, own = (batch.column(at[c])[k].as_py() for c in ("block", "lang", "own"))

                def array(name: str) -> np.ndarray:
                    return batch.column(at[name])[k].values.to_numpy(zero_copy_only=False)

                groups, number = array("groups"), array("ids")
                place = array("places") if "places" in at else _places(*map(array, ("a", "b", "first", "second")))
                # In the order of the common numbers, so that neighbours in the shuffle are alike.
                order = np.argsort(number)
                place, number = place[order], number[order]
                # Semi-join: other groups, and the -1 between pieces, become -1.
                kept = np.full(max(int(groups.max()), int(place.max())) + 2, -1, np.int64)
                kept[place] = np.arange(len(place))
                here = kept[groups]
                # Merge-join with itself at the next position.
                first, second = here[:-1], here[1:]
                both = np.flatnonzero((first >= 0) & (second >= 0))
                pairs, which = np.unique(first[both] * len(place) + second[both], return_inverse=True)
                if not len(pairs):
                    continue
                new = np.full(len(groups), -1, np.int32)
                new[both] = which
                counts = np.bincount(which[both < own], minlength=len(pairs))
                a, b = number[pairs // len(place)], number[pairs % len(place)]
                entries = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (a, b, counts)], ["a", "b", "n"])
                yield _row(block, lang, own, new, entries, kind)

    return joined.mapInArrow(run, RELATION.format("a:long,b:long,"))


def _persist(relation: DataFrame, buckets: int) -> str:
    """Table bucketed by block, so that no later step shuffles occurrences; dropped when the next one stands."""
    name = f"setm_{uuid.uuid4().hex}"
    writer = relation.write.format("parquet").option("compression", "zstd").bucketBy(buckets, "block").sortBy("block")
    writer.saveAsTable(name)
    return name


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(``lang, words, f``) of the phrases of up to ``longest`` words that occur ``least`` times, and ``lang, n``.

    Every part of a frequent phrase is frequent, so nothing is lost by extending frequent ones only. A phrase
    is the pair of its first and last k words, both named by the number of their group: no hash decides. A
    word's number is the smallest of the numbers (block and place in it) that it has in the blocks.
    """
    spark = docs.sparkSession
    buckets = parts(spark)
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    names = [_persist(occurrences(rows, longest), buckets)]
    levels: list[DataFrame] = []
    totals = None
    for k in range(1, longest + 1):
        relation = spark.table(names[-1])
        if k == 1:
            groups = relation.select("block", "lang", F.posexplode("entries").alias("i", "e"))
            totals = store(groups.groupBy("lang").agg(F.sum("e.n").alias("n")), "setm-totals")
            found = store(_frequent_words(groups, least), "setm-groups")
        else:
            found = store(_frequent_pairs(relation.select("block", F.inline("entries")), least), "setm-groups")
        levels.append(_spelled(found.where("f IS NOT NULL"), levels[-1] if levels else None))
        if k < longest:
            # Which groups of a block are frequent: bounded by the block. Lists of one aggregation are in the
            # same order, and half as wide as one of structs.
            listed = {"ids": "id", "places": "place"} if k == 1 else {"ids": "id", "first": "a", "second": "b"}
            mine = found.groupBy("block").agg(*(F.collect_list(c).alias(name) for name, c in listed.items()))
            own = [] if k == 1 else [F.col(f"entries.{c}").alias(c) for c in "ab"]
            joined = relation.select("block", "lang", "own", "groups", *own).join(mine.hint("merge"), "block")
            with one_row_batches(spark):
                names.append(_persist(extended(joined), buckets))
        spark.sql(f"DROP TABLE {names[k - 1]}")
    return reduce(DataFrame.unionByName, (level.select("lang", "words", "f") for level in levels)), totals


def _frequent_words(groups: DataFrame, least: int) -> DataFrame:
    """Words of the blocks that are frequent in all: ``block, place`` and common number; word and count once.

    One shuffle by word serves the count and the semi-join. A word has one row per block, however often it occurs.
    """
    same = Window.partitionBy("lang", "word")
    own = F.shiftleft("block", PLACE_BITS).bitwiseOR(F.col("i").cast("long")).alias("own")
    rows = groups.select(own, "lang", "e.word", "e.n")
    rows = rows.withColumns({"f": F.sum("n").over(same), "id": F.min("own").over(same)}).where(F.col("f") >= least)
    block, place = F.shiftright("own", PLACE_BITS).alias("block"), (F.col("own") % (1 << PLACE_BITS)).cast("int")
    once = (F.when(F.col("own") == F.col("id"), F.col(c)).alias(c) for c in ("f", "lang", "word"))
    return rows.select(block, place.alias("place"), "id", *once)


def _frequent_pairs(groups: DataFrame, least: int) -> DataFrame:
    """The same of pairs, ``block, a, b`` and common number; the count once. What travels is a block's pairs in order.

    Rows are numbered where they have come together, and a pair has the smallest number of its rows: only this
    table, once stored, has the numbers.
    """
    same = Window.partitionBy("a", "b")
    rows = groups.repartition("a", "b").withColumn("row", F.monotonically_increasing_id())
    rows = rows.withColumns({"f": F.sum("n").over(same), "id": F.min("row").over(same)}).where(F.col("f") >= least)
    return rows.select("block", "a", "b", "id", F.when(F.col("row") == F.col("id"), F.col("f")).alias("f"))


def _spelled(found: DataFrame, shorter: DataFrame | None) -> DataFrame:
    """Frequent groups with their language and words, stored."""
    if shorter is None:
        named = found.select("id", "lang", F.array("word").alias("words"), "f")
    else:
        first = shorter.select(F.col("id").alias("a"), "lang", F.col("words").alias("head"))
        last = shorter.select(F.col("id").alias("b"), F.array(F.element_at("words", -1)).alias("tail"))
        named = found.join(first, "a").join(last, "b").select("id", "lang", F.concat("head", "tail").alias("words"), "f")
    return store(named, "setm-phrases")


def phrase(words: Column) -> Column:
    return F.array_join(words, " ")


def scored(phrases: DataFrame, totals: DataFrame) -> DataFrame:
    """Phrases of two words and more with the cut of the lowest score: ``lang, words, phrase, a, l, r, n, score``.

    Products pass 64 bits, so they are decimals; the division of decimals by ``div`` is exact.
    """
    parts_ = phrases.select("lang", phrase(F.col("words")).alias("part"), "f")
    cuts = phrases.where(F.size("words") > 1).withColumn("cut", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
    cuts = cuts.withColumns(
        {
            "first": phrase(F.slice("words", F.lit(1), F.col("cut"))),
            "rest": phrase(F.slice("words", F.col("cut") + 1, F.size("words"))),
        }
    )
    cuts = cuts.join(parts_.select("lang", F.col("part").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts_.select("lang", F.col("part").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(totals, "lang")
    score = "(CAST(1000 * CAST(f AS DECIMAL(18, 0)) AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(18, 0))) DIV (CAST(l AS DECIMAL(18, 0)) * CAST(r AS DECIMAL(18, 0)))"
    best = F.min(F.struct(F.expr(score).alias("score"), "cut", "l", "r")).alias("best")
    return cuts.groupBy("lang", "words", F.col("f").alias("a"), "n").agg(best).select(
        "lang", "words", phrase(F.col("words")).alias("phrase"), "a", "best.l", "best.r", "n", "best.score"
    )


def uncovered(candidates: DataFrame, cover: int = COVER) -> DataFrame:
    """Candidates without a longer one around them that has ``cover`` hundredths of their occurrences."""
    size = F.size("words")
    inner = candidates.where(size > 2).withColumn("long", F.explode(F.sequence(F.lit(2), size - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), size - F.col("long") + 1)))
    inner = inner.select("lang", phrase(F.slice("words", F.col("at"), F.col("long"))).alias("phrase"), "a")
    longer = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    found = candidates.join(longer, ["lang", "phrase"], "left")
    return found.where(F.col("around").isNull() | (F.col("around") * 100 < F.col("a") * cover)).drop("around")


def collocations(
    docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, cover: int = COVER
) -> DataFrame:
    """Each language's ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    ``docs`` needs ``lang`` and ``text``; other columns are ignored. A null language is ``und``; null, empty and
    blank texts have no words; repeated rows count each time. Equal scores go by occurrences, then by the
    phrase's bytes, so ranks are unique. A text of any length is read whole: parts of it overlap by the words
    that the longest phrase needs. An empty table, or one without frequent phrases, gives no rows.
    """
    phrases, totals = frequent_phrases(docs, least, longest)
    kept = uncovered(store(scored(phrases, totals), "setm-scores"), cover)
    rank = "row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)"
    ranked = kept.withColumn("rank", F.expr(rank)).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(read(spark, folder, "documents").select("lang", "text"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM pieces
),
total AS (SELECT lang, sum(len(ws)) AS n FROM worded GROUP BY lang),
grams AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase
  FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM worded, range(1, 6) r(k) WHERE len(ws) >= k)
),
found AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM found WHERE k > 1),
cuts AS (
  SELECT c.lang, c.k, c.phrase, c.a, x.f AS l, y.f AS r, t.n::BIGINT AS n, cut,
         ((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM candidates c
  JOIN range(1, 5) s(cut) ON cut < c.k
  JOIN found x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[1:cut], ' ')
  JOIN found y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[cut + 1:c.k], ' ')
  JOIN total t ON t.lang = c.lang
),
lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
),
kept AS (
  SELECT * FROM lowest c WHERE NOT EXISTS (
    SELECT 1 FROM candidates b
    WHERE b.lang = c.lang AND b.k > c.k AND 100 * b.a >= 100 * c.a AND contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' ')
  )
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::INTEGER AS rank,
       phrase, a, l, r, n, score
FROM kept
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""

QUERIES = {"op12_collocations": op12_collocations}
SQL = {"op12_collocations": OP12_SQL}
