"""LM scoring: prediction by partial matching over bytes, pretrained on the corpus, and a word base line."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relpoint.llm.common import arrow_map, fresh, read, remainder, small_batches, spaced_words, store, texts

#: Bytes of context. A gram (context and symbol) is an integer of ORDER + 1 bytes, the symbol last.
ORDER = 4
#: Start and end of a text; the byte doesn't occur in UTF-8.
EDGE = 0xFF
#: Entries that tasks get as a table at most: the most frequent words and grams. Others are joined.
HOT_WORDS, HOT_GRAMS = 300_000, 1_000_000
#: Entries that a task adds up before it passes them on.
HELD = 500_000
HELD_OUT = 10

WORD, GRAM = 0, 1


def grams(documents: list[bytes], order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Grams of all texts, ends included, and where those of each text start.

    A text stands between ``order`` edges and one more; each of its bytes and the end is a symbol.
    """
    edge = bytes([EDGE]) * order
    flat = np.frombuffer(b"".join([edge + d + edge[:1] for d in documents]), dtype=np.uint8)
    sizes = np.array([len(d) + 1 for d in documents])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    keys = np.zeros(len(flat) - order, dtype=np.int64)
    for j in range(order + 1):
        keys <<= 8
        keys |= flat[j : j + len(keys)]
    # Behind each text, the grams that reach into the next one's edge are left out.
    inner = np.ones(len(keys), dtype=bool)
    for j in range(order):
        inner[(starts[1:] + order * np.arange(1, len(sizes)) - 1 - j)] = False
    return keys[inner], starts


def _counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and the sums of their counts (1 each unless given)."""
    if counts is None:
        keys = np.sort(keys)
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[starts], np.diff(np.r_[starts, len(keys)])
    place = np.argsort(keys, kind="stable")
    keys, counts = keys[place], counts[place]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(counts, starts)


def word_key(word: bytes) -> int:
    key = xxhash.xxh64_intdigest(word)
    return key - (1 << 64) if key >> 63 else key


def count_corpus(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """``kind, key, n`` over ``rows`` (``held_out``, ``text``).

    Words are counted in training texts, by XXH64; grams have their count in training texts, 0 for those
    that only held-out texts have. Tasks add up before they pass on, and Spark once more before the shuffle.
    """
    small_batches(rows.sparkSession)

    def out(kind: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys), pa.array(counts.astype(np.int64))]
        return pa.RecordBatch.from_arrays(arrays, names=["kind", "key", "n"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush_words() -> pa.RecordBatch:
            keys = np.array([word_key(w) for w in words], dtype=np.int64)
            counts = np.fromiter(words.values(), np.int64, len(words))
            words.clear()
            return out(WORD, keys, counts)

        def merged() -> None:
            if len(held) > 1:
                both = _counted(np.concatenate([k for k, _ in held]), np.concatenate([n for _, n in held]))
                held[:] = [both]

        for batch in batches:
            if not batch.num_rows:
                continue
            documents = texts(batch.column(1))
            aside = batch.column(0).to_pylist()
            for known in (False, True):
                own = [d for d, held_out in zip(documents, aside) if held_out != known]
                if not own:
                    continue
                for part in _parts(own):
                    keys, counts = _counted(grams(part, order)[0])
                    held.append((keys, counts if known else np.zeros_like(counts)))
                    merged()
                    if len(held[0][0]) > HELD:
                        yield out(GRAM, *held.pop())
                if known:
                    for d in own:
                        words.update(spaced_words(d))
                        if len(words) > HELD:
                            yield flush_words()
        if words:
            yield flush_words()
        if held:
            yield out(GRAM, *held.pop())

    counted = rows.select("held_out", "text").mapInArrow(run, "kind int, key long, n long")
    return counted.groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _parts(documents: list[bytes], size: int = 1 << 22) -> Iterator[list[bytes]]:
    """Texts in lists of about ``size`` bytes, a longer text alone."""
    held, total = [], 0
    for d in documents:
        held.append(d)
        total += len(d)
        if total >= size:
            yield held
            held, total = [], 0
    if held:
        yield held


def suffix(key: str, size: int) -> Column:
    """The last bytes of a gram: the same symbol after a shorter context."""
    return F.col(key).bitwiseAND(F.lit((1 << (8 * size)) - 1).cast("long"))


def code_lengths(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """``key, n, value``: log10 of the probability of each gram's symbol after its context.

    The trie is a table for each length k of context: symbols' counts, and for each context their sum n
    and number T. A symbol that the context has seen has probability count / (n + T); one that it hasn't
    escapes, with T / (n + T), to the next shorter context, where the symbols that the longer one has seen
    are excluded from n and T. A context with nothing new is passed over, and so is one never seen. What no
    context has seen is one of the bytes left, all alike. ``counts`` has ``key`` and ``n`` of the longest
    grams; those with n = 0 get a value, but add nothing to the trie.
    """
    levels, contexts = {}, {}
    seen = counts.where("n > 0")
    for k in range(order, -1, -1):
        levels[k] = store(seen.groupBy(suffix("key", k + 1).alias("key")).agg(F.sum("n").alias("n")), f"trie-{k}")
        seen = levels[k]
    for k in range(order, -1, -1):
        own = levels[k].withColumn("context", F.shiftright("key", 8))
        sums = [F.sum("n").alias(f"n{k}"), F.count(F.lit(1)).alias(f"t{k}")]
        if k:
            # What this context's symbols weigh in the context one byte shorter.
            shorter = small(levels[k - 1].toDF("shorter", "less"), k)
            own = own.withColumn("shorter", suffix("key", k)).join(shorter, "shorter")
            sums.append(F.sum("less").alias(f"x{k - 1}"))
        contexts[k] = store(own.groupBy("context").agg(*sums).withColumnRenamed("context", f"context{k}"), f"contexts-{k}")

    found = counts.withColumnRenamed("n", f"c{order}")
    for k in range(order, -1, -1):
        found = found.withColumn(f"context{k}", F.shiftright(suffix("key", k + 1), 8))
        found = found.join(small(contexts[k], k), f"context{k}", "left")
        if k < order:
            found = found.withColumn(f"gram{k}", suffix("key", k + 1))
            found = found.join(small(levels[k].toDF(f"gram{k}", f"c{k}"), k + 1), f"gram{k}", "left")
    value = -F.log10(F.greatest(F.lit(256) - F.coalesce(F.col("t0"), F.lit(0)), F.lit(1)).cast("double"))
    for k in range(order + 1):
        n, t, c = F.col(f"n{k}"), F.col(f"t{k}"), F.col(f"c{k}")
        if k < order:
            n = n - F.coalesce(F.col(f"x{k}"), F.lit(0))
            t = t - F.coalesce(F.col(f"t{k + 1}"), F.lit(0))
        value = (
            F.when(c > 0, F.log10(c / (n + t)))
            .when(F.coalesce(t, F.lit(0)) == 0, value)
            .otherwise(F.log10(t / (n + t)) + value)
        )
    return found.select("key", F.col(f"c{order}").alias("n"), value.alias("value"))


def small(table: DataFrame, size: int) -> DataFrame:
    """The table of grams or contexts of ``size`` bytes; sent to all tasks where it has 65,536 rows at most."""
    return F.broadcast(table) if size <= 2 else table


def hot(table: DataFrame, most: int) -> Column:
    """Condition for the rows of highest n, ``most`` of them at most; chosen by powers of two."""
    class_of = F.length(F.bin("n"))
    sizes = table.where("n > 0").groupBy(class_of.alias("c")).count().collect()  # 64 rows at most
    total, least = 0, 64
    for row in sorted(sizes, reverse=True):
        total += row["count"]
        if total > most:
            break
        least = row["c"]
    return (F.col("n") > 0) & (F.length(F.bin("n")) >= least)


class Lookup:
    """Values by integer key, in a table with open addressing, for many keys at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(3 * len(keys)).bit_length())
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.values = np.zeros(1 << self.bits, dtype=np.float64)
        left = np.arange(len(keys))
        place = self._first(keys)
        while len(left):
            free = self.keys[place] == -1
            self.keys[place[free]] = keys[left[free]]
            won = self.keys[place] == keys[left]
            self.values[place[won]] = values[left[won]]
            left, place = left[~won], (place[~won] + 1) & (len(self.keys) - 1)

    def _first(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values (0 where there is none) and whether there is one; keys aren't negative."""
        place = self._first(keys)
        there = self.keys[place]
        values = np.where(there == keys, self.values[place], 0.0)
        found = there == keys
        left = np.flatnonzero(~found & (there != -1))
        at = place[left]
        while len(left):
            at = (at + 1) & (len(self.keys) - 1)
            there = self.keys[at]
            hit = there == keys[left]
            values[left[hit]] = self.values[at[hit]]
            found[left[hit]] = True
            go = ~hit & (there != -1)
            left, at = left[go], at[go]
        return values, found


class Corpus(NamedTuple):
    """What the training texts have: tables of words (key, n) and grams (key, n, value), tokens, words + end."""

    words: DataFrame
    grams: DataFrame
    tokens: int
    distinct: int
    ends: int


def train(rows: DataFrame, order: int = ORDER) -> Corpus:
    """Counts and code lengths from the rows (``held_out``, ``text``) that aren't held out."""
    counted = store(count_corpus(rows, order), "corpus")
    words = counted.where(F.col("kind") == WORD).select("key", "n")
    known = store(code_lengths(counted.where(F.col("kind") == GRAM).select("key", "n"), order), "code-lengths")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    ends = rows.where("not held_out").count()
    return Corpus(words, known, total[0] + ends, total[1] + (ends > 0), ends)


def score(rows: DataFrame, corpus: Corpus, order: int = ORDER, words: int = HOT_WORDS, grams_: int = HOT_GRAMS) -> DataFrame:
    """``rows`` (with ``text``; it goes) and ``n_tokens, n_known, base_score, score``.

    Frequent words and grams are looked up where the text is read; each text's other ones, counted, are
    joined with the tables. What tasks hold is bounded; all words and grams of all texts count. The rows
    must be among those that the corpus was made from, held out or not: it has a value for their grams.
    """
    spark = rows.sparkSession
    small_batches(spark)
    hot_words = corpus.words.where(hot(corpus.words, words)).toArrow()
    hot_grams = corpus.grams.where(hot(corpus.grams, grams_)).select("key", "value").toArrow()
    unit, floor = corpus.tokens + 0.1 * (corpus.distinct + 1), 0.1
    logs_of_words = np.log10((hot_words["n"].to_numpy() + floor) / unit)
    table = spark.sparkContext.broadcast(
        (
            dict(zip(hot_words["key"].to_pylist(), logs_of_words.tolist())),
            Lookup(hot_grams["key"].to_numpy(), hot_grams["value"].to_numpy()),
        )
    )
    [number] = fresh(rows, "row_number")
    numbered = rows.withColumn(number, F.monotonically_increasing_id())
    place = numbered.columns.index("text")
    keep = [c for c in numbered.columns if c != "text"]

    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        known_words, lookup = table.value
        documents = texts(batch.column(place))
        tokens, known, base, value, rare = [], [], [], [], []
        for d in documents:
            counted = Counter(spaced_words(d))
            total, sure, logs, other = 0, 0, 0.0, []
            for word, n in counted.items():
                total += n
                key = word_key(word)
                log = known_words.get(key)
                if log is None:
                    other.append((WORD, key, n))
                else:
                    sure += n
                    logs += n * log
            tokens.append(total)
            known.append(sure)
            base.append(logs)
            rare.append(other)
        row = 0
        for part in _parts(documents):
            keys, starts = grams(part, order)
            values, found = lookup(keys)
            value.extend(np.add.reduceat(values, starts).tolist())
            missing = np.flatnonzero(~found)
            owners = np.searchsorted(starts, missing, side="right") - 1 + row
            for (owner, key), n in Counter(zip(owners.tolist(), keys[missing].tolist())).items():
                rare[owner].append((GRAM, key, n))
            row += len(part)
        kind = pa.list_(pa.struct([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())]))
        lists = pa.array([[dict(zip(("kind", "key", "n"), x)) for x in r] for r in rare], kind)
        return [pa.array(tokens, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(value), lists]

    added = "n_tokens long, n_known long, base_score double, score double, rare array<struct<kind:int,key:long,n:long>>"
    looked = store(arrow_map(numbered, each, added, keep), "scored")
    rare = looked.select(number, F.explode("rare").alias("r")).select(number, "r.kind", "r.key", "r.n")
    words_ = corpus.words.select("key", F.col("n").alias("c")).hint("merge")
    of_words = rare.where(F.col("kind") == WORD).join(words_, "key", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    of_words = of_words.select(
        number,
        F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"),
        (F.col("n") * F.log10((F.col("c") + floor) / F.lit(unit))).alias("base"),
        F.lit(0.0).alias("value"),
    )
    values = corpus.grams.select("key", "value").hint("merge")
    of_grams = rare.where(F.col("kind") == GRAM).join(values, "key")
    of_grams = of_grams.select(number, F.lit(0).cast("long"), F.lit(0.0), F.col("n") * F.col("value"))
    sums = of_words.union(of_grams).groupBy(number)
    sums = sums.agg(*(F.sum(c).alias(f"more_{c}") for c in ("known", "base", "value")))
    end = float(np.log10((corpus.ends + floor) / unit)) if unit else 0.0
    joined = looked.drop("rare").join(sums.hint("merge"), number, "left")
    more = {c: F.coalesce(F.col(f"more_{c}"), F.lit(0)) for c in ("known", "base", "value")}
    return joined.select(
        *[c for c in keep if c != number],
        (F.col("n_tokens") + 1).alias("n_tokens"),
        (F.col("n_known") + more["known"] + F.lit(int(corpus.ends > 0))).alias("n_known"),
        (F.col("base_score") + more["base"] + F.lit(end)).alias("base_score"),
        (F.col("score") + more["value"]).alias("score"),
    )


def op2_language_model(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all documents by what those outside the held-out tenth teach; null texts are empty.

    A null id counts as the empty text in the split; repeated rows are scored alike. Words of the base are
    told apart by a 64-bit hash.
    """
    docs = read(spark, folder, "documents")
    rows = docs.select("doc_id", (remainder("doc_id", HELD_OUT) == 0).alias("held_out"), "text")
    corpus = train(rows)
    scored = score(rows, corpus)
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(corpus.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


QUERIES = {"op2_language_model": op2_language_model}
#: Escapes and exclusion over a trie aren't in SQL.
SQL: dict[str, str] = {}
