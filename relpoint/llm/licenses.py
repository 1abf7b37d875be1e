"""License scans: matching statistics against an automaton of licence words, chained into spans."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relpoint.llm.automaton import SuffixAutomaton
from relpoint.llm.common import arrow_map, plain_offsets, plain_words, read, small_batches, texts

#: Words of a match that can stand in a chain, words between two matches of a chain, and the share of a
#: template that a chain covers before it gives the template's label.
MATCH, GAP, SHARE = 3, 8, 0.6
#: Words from which a template without a name counts by its share; shorter ones have to be covered whole.
LONG = 10
#: Words that tell licences apart: a chain has to cover those of its template, whatever its share.
NAMES = frozenset((b"mit", b"apache", b"bsd", b"gnu", b"cc", b"commons", b"mozilla", b"reserved"))

# The phrases of the contract, each counted wherever it stands.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}

# Notices of public licences, by label.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the Software), to deal in the Software without restriction, including "
        "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
        "copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    (
        "apache",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http www apache org licenses LICENSE 2 0",
    ),
    (
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met",
    ),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    (
        "gpl",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version",
    ),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by", "Licensed under CC BY-NC 4.0"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("reserved", "Copyright (c) All rights reserved."),
)


class Span(NamedTuple):
    """Words of a text that a chain of matches with one template covers."""

    label: str
    first: int
    last: int
    covered: int
    share: float


class Scanner:
    """Finds phrases and templates in a sequence of words."""

    def __init__(
        self,
        phrases: dict[str, str] = PHRASES,
        templates: Sequence[tuple[str, str]] = TEMPLATES,
        names: frozenset[bytes] = NAMES,
    ):
        pairs = [(plain_words(p.encode()), label) for p, label in phrases.items()]
        pairs += [(plain_words(t.encode()), label) for label, t in templates]
        self.items = [words for words, _ in pairs]
        self.labels = [label for _, label in pairs]
        self.phrases = len(phrases)
        self.names = [[k for k, word in enumerate(words) if word in names] for words in self.items]
        self.automaton = SuffixAutomaton(self.items)
        short = [len(w) for w in self.items[: self.phrases]]
        self.least = min([MATCH, *short])
        whole = self.automaton.whole_suffixes()
        self.found = {s: y for s, x in enumerate(whole) if (y := [(n, i) for n, i in x if i < self.phrases])}
        self.ends = self._ends()

    def _ends(self) -> list[set[tuple[int, int]]]:
        """For each state, where in the templates its runs end: (template, place of the last word)."""
        auto = self.automaton
        found: list[set[tuple[int, int]]] = [set() for _ in auto.length]
        for number in range(self.phrases, len(self.items)):
            state = 0
            for place, word in enumerate(self.items[number]):
                # The whole prefix is in the automaton, so the way through it never fails.
                state = auto.next[state][auto.ids[word]]
                found[state].add((number, place))
        for s in sorted(range(1, len(found)), key=auto.length.__getitem__, reverse=True):
            found[auto.link[s]] |= found[s]
        return found

    def scan(self, words: Sequence[bytes]) -> tuple[list[tuple[int, str]], list[Span]]:
        """Places of the phrases (first word, label), and the best covered spans of the templates."""
        places, runs = [], []
        for at, state, length in self.automaton.statistics(words, self.least):
            for size, number in self.found.get(state, ()):
                if size <= length:
                    places.append((at - size + 1, self.labels[number]))
            if length >= MATCH:
                if runs and runs[-1][0] == at - 1 and runs[-1][2] == length - 1:
                    runs.pop()  # the match goes on
                runs.append((at, state, length))
        return places, self._chains(runs)

    def _chains(self, runs: list[tuple[int, int, int]]) -> list[Span]:
        """Chains of the longest matches, in order in text and template, with small gaps in the text."""
        # template: first word, last word, place in the template, covered, names covered
        open_: dict[int, list[int]] = {}
        spans = []

        def close(number: int) -> None:
            first, last, _, covered, named = open_.pop(number)
            size, names = len(self.items[number]), len(self.names[number])
            share = covered / size
            if named == names and share >= (SHARE if names or size >= LONG else 1):
                spans.append(Span(self.labels[number], first, last, covered, share))

        def names(number: int, place: int, length: int) -> int:
            return sum(place - length < k <= place for k in self.names[number])

        for at, state, length in runs:
            by_template: dict[int, list[int]] = {}
            for number, place in self.ends[state]:
                by_template.setdefault(number, []).append(place)
            for number, where in by_template.items():
                chain = open_.get(number)
                if chain and at - length - chain[1] <= GAP:
                    later = [p for p in where if p > chain[2]]
                    if later and at > chain[1]:
                        place = min(later)
                        gained = min(length, at - chain[1], place - chain[2])
                        named = chain[4] + names(number, place, gained)
                        open_[number] = [chain[0], at, place, chain[3] + gained, named]
                        continue
                if chain:
                    close(number)
                place = min(where)
                open_[number] = [at - length + 1, at, place, length, names(number, place, length)]
        for number in list(open_):
            close(number)
        return sorted(spans, key=lambda s: (s.first, s.last, s.label))


SCAN = (
    "n_words long, places array<struct<word:long,label:string>>, "
    "spans array<struct<label:string,first:long,last:long,start:long,end:long,share:double>>"
)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: dict[str, str] = PHRASES,
    templates: Sequence[tuple[str, str]] = TEMPLATES,
) -> DataFrame:
    """``id``, ``n_words``, ``places`` of phrases and ``spans`` of templates, for each whole text.

    Phrases and templates are a stated list, so the automaton is as large as that list. Spans count words
    and bytes in UTF-8 (end exclusive). A null or blank text has no words and nothing is found in it;
    overlapping places all count; repeated rows are scanned alike; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    scanner = docs.sparkSession.sparkContext.broadcast(Scanner(phrases, templates))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    place = pa.struct([("word", pa.int64()), ("label", pa.string())])
    span = pa.struct(
        [("label", pa.string()), *((n, pa.int64()) for n in ("first", "last", "start", "end")), ("share", pa.float64())]
    )

    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        lengths, places, spans = [], [], []
        for text in texts(batch.column(1)):
            words = plain_words(text)
            at, chains = scanner.value.scan(words)
            where = plain_offsets(text, words) if chains else []
            lengths.append(len(words))
            places.append([{"word": w, "label": label} for w, label in sorted(at)])
            spans.append(
                [
                    {
                        "label": s.label,
                        "first": s.first,
                        "last": s.last,
                        "start": where[s.first][0],
                        "end": where[s.last][1],
                        "share": s.share,
                    }
                    for s in chains
                ]
            )
        return [pa.array(lengths, pa.int64()), pa.array(places, pa.list_(place)), pa.array(spans, pa.list_(span))]

    return arrow_map(rows, each, SCAN, ["id"])


def joined(labels: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(labels)), ",")


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licenses(read(spark, folder, "documents"))
    best = F.array_max(F.col("spans.share"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.word").alias("first_word"),
        F.array_max("places.word").alias("last_word"),
        joined(F.col("places.label")).alias("base_labels"),
        joined(F.concat("places.label", "spans.label")).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.least(F.coalesce(best, F.lit(0.0)), F.lit(1.0))).alias("score"),
        F.size("spans").alias("n_spans"),
    )


QUERIES = {"op6_licenses": op6_licenses}
#: Chains of matches aren't in SQL.
SQL: dict[str, str] = {}
