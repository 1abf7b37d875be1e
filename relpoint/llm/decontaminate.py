"""Benchmark decontamination: matching statistics against a suffix automaton of the test items."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relpoint.llm.automaton import SuffixAutomaton
from relpoint.llm.common import arrow_map, fresh, plain_offsets, plain_words, read, small_batches, store, texts

#: Consecutive item words that count as a leak; shorter items count as a whole.
WINDOW = 10
#: Bytes of item text in one automaton. Larger benchmarks are matched in blocks, one after the other.
BLOCK_BYTES = 2_000_000

MATCHES = "n_words long, items array<string>, spans array<struct<first:long,last:long,start:long,end:long>>"


def blocks(items: DataFrame, item_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> Iterator[list]:
    """(item id as text, words) of the items, in lists of bounded size.

    Items are dealt to as many blocks as their total size asks for, by a hash of id and text; a block
    that still is too large for its items' sake holds one item at least. An item without id is None.
    """
    rows = items.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("binary").alias("text"))
    rows = rows.where("text is not null")
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = -(-total // block_bytes) if total > block_bytes else 1
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))
    for k in range(n):
        part = dealt.where(F.col("block") == k).select("item", "text").collect()
        yield [(r["item"], plain_words(bytes(r["text"]))) for r in part]


class Matcher:
    """Words of a text that an occurrence of an item's window covers, and the items that have one."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window, self.names = window, [name for name, _ in items]
        self.automaton = SuffixAutomaton([words for _, words in items])
        short = [len(w) for _, w in items if 0 < len(w) < window]
        self.least = min([window, *short])
        self.anchor = self.automaton.at_length(window)
        self.full = self.automaton.items_at(window)
        suffixes = self.automaton.whole_suffixes() if short else []
        self.short = {s: x for s, found in enumerate(suffixes) if (x := [y for y in found if y[0] < window])}

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans of hit words (first and last, apart and in order), and the names of the items."""
        spans: list[list[int]] = []
        states, numbers = set(), set()
        for place, state, length in self.automaton.statistics(words, self.least):
            reach = 0
            if length >= self.window:
                reach = self.window
                states.add(self.anchor[state])
            for size, number in self.short.get(state, ()):
                if size <= length:
                    reach = max(reach, size)
                    numbers.add(number)
            if reach:
                first = place - reach + 1
                # A longer reach can start before the spans found so far.
                while spans and spans[-1][0] >= first:
                    spans.pop()
                if spans and spans[-1][1] >= first - 1:
                    spans[-1][1] = place
                else:
                    spans.append([first, place])
        numbers.update(*(self.full[s] for s in states))
        return [(a, b) for a, b in spans], {self.names[n] for n in numbers} - {None}


def united(spans: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    """Spans (first, last, start, end) joined where they touch or overlap."""
    found: list[tuple[int, ...]] = []
    for span in sorted(spans):
        if found and span[0] <= found[-1][1] + 1:
            last = found[-1]
            found[-1] = (last[0], max(last[1], span[1]), last[2], max(last[3], span[3]))
        else:
            found.append(span)
    return found


def with_matches(
    docs: DataFrame,
    items: DataFrame,
    names: list[str],
    item_col: str = "item_id",
    text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with ``n_words``, the ids of matching items and the spans they cover, under ``names``.

    Spans count words and bytes of the text in UTF-8 (end exclusive). A null text has no words; items
    without words match nothing; an item without id hits words but has no name to list; items that repeat
    count once by id. An empty benchmark matches
    nothing. One automaton is held at a time; between blocks the rows are stored.
    """
    small_batches(docs.sparkSession)
    own, place = docs.columns, docs.columns.index(text_col)
    fields = [f.split(" ", 1)[1] for f in ("n_words long", "items array<string>", MATCHES.split(", ", 2)[2])]
    ddl = ", ".join(f"`{n}` {kind}" for n, kind in zip(names, fields))
    found = docs
    for k, block in enumerate(blocks(items, item_col, text_col, block_bytes)):
        matcher = docs.sparkSession.sparkContext.broadcast(Matcher(block, window))

        def each(batch: pa.RecordBatch, matcher=matcher, later: bool = k > 0) -> list[pa.Array]:
            lengths, ids, covered = [], [], []
            for i, text in enumerate(texts(batch.column(place))):
                words = plain_words(text)
                spans, named = matcher.value.match(words)
                where = plain_offsets(text, words) if spans else []
                whole = [(a, b, where[a][0], where[b][1]) for a, b in spans]
                if later:
                    whole += [tuple(s.values()) for s in batch.column(len(own) + 2)[i].as_py()]
                    named |= set(batch.column(len(own) + 1)[i].as_py())
                lengths.append(len(words))
                ids.append(sorted(named))
                covered.append([dict(zip(("first", "last", "start", "end"), s)) for s in united(whole)])
            kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")]))
            return [pa.array(lengths, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(covered, kind)]

        found = arrow_map(store(found, "matches") if k else found, each, ddl, own)
    return found


def hit_words(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"] + 1)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    max_span: int = 0,
    max_coverage: float = 0.0,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` without leaked passages, columns unchanged.

    A document of whose words more than the share ``max_coverage`` is hit goes as a whole. In the others,
    spans of more than ``max_span`` words are cut from the text (as bytes between word bounds, so UTF-8
    stays valid). The defaults remove every document with a hit. Texts without a hit stay as they are.
    """
    n, ids, spans = fresh(docs, "n_words", "items", "spans")
    found = with_matches(docs, items, [n, ids, spans], window=window, block_bytes=block_bytes)
    hits = hit_words(F.col(spans))
    found = found.where((hits == 0) | (hits <= F.col(n) * F.lit(max_coverage)))
    if max_coverage <= 0:
        return found.select(*[F.col(f"`{c}`") for c in docs.columns])
    place = {c: i for i, c in enumerate(found.columns)}

    def cut(batch: pa.RecordBatch) -> list[pa.Array]:
        whole = texts(batch.column(place["text"]))
        kept = []
        for text, is_null, found_spans in zip(
            whole, batch.column(place["text"]).is_null().to_pylist(), batch.column(place[spans]).to_pylist()
        ):
            pieces, at = [], 0
            for s in found_spans:
                if s["last"] - s["first"] + 1 > max_span:
                    pieces.append(text[at : s["start"]])
                    at = s["end"]
            kept.append(None if is_null else b"".join([*pieces, text[at:]]).decode())
        return [pa.array(kept, pa.string())]

    [new] = fresh(found, "cut")
    done = arrow_map(found, cut, f"`{new}` string", docs.columns)
    return done.select(*[F.col(f"`{new}`").alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])


def op3_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Leaked words and matching items of each document, as with_matches states; repeated rows stay rows."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    found = with_matches(docs, read(spark, folder, "benchmark"), ["n_words", "items", "spans"])
    return found.select(
        "doc_id",
        "n_words",
        hit_words(F.col("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
        F.transform("spans", lambda s: s["last"] - s["first"] + 1).alias("span_words"),
    )


QUERIES = {"op3_decontaminate": op3_decontaminate}
#: Overlapping windows of whole texts against all items are too slow in SQL on whole tables.
SQL: dict[str, str] = {}
