"""URL filter: rules by host and path, and boosted trees on lexical features for what no rule judges."""

from __future__ import annotations

import string
from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relpoint.llm.common import read, store

#: Distinct labelled URLs that the trees are fitted on at most, half of them for each verdict: those with
#: the smallest hash. Their weights stand for all labelled rows of the verdict.
SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, SEED = 20, 4, 0.2, 5
#: Probability from which a URL without a rule is blocked.
BLOCK = 0.5
#: Labelled URLs that a suffix counts for before its own are seen.
PRIOR = 20.0

FEATURES = (
    "url_length",
    "host_length",
    "path_length",
    "depth",
    "host_labels",
    "digit_ratio",
    "hyphens",
    "entropy",
    "parameters",
    "query_length",
    "has_fragment",
    "secure",
    "suffix_urls",
    "suffix_block_rate",
)


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


# The rules of the contract.
RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)


def lowered(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    return lowered(F.regexp_extract(rest(url), r"^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    return F.regexp_extract(rest(url), r"^[^/?#]*(/[^?#]*)?", 1)


def fits(rule: Rule, host: Column, path: Column) -> Column:
    own = (host == rule.host) | host.endswith("." + rule.host)
    return own & path.startswith(rule.path)


def first_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """Struct of ``rule`` and ``verdict`` of the longest rule that fits; of equal ones the first by text."""
    chosen = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule in sorted(rules, key=lambda r: (-len(r.text), r.text), reverse=True):
        this = F.struct(F.lit(rule.text).alias("rule"), F.lit(rule.verdict).alias("verdict"))
        chosen = F.when(fits(rule, host, path), this).otherwise(chosen)
    return chosen


def entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    bits = F.aggregate(letters, F.lit(0.0), lambda total, c: total - share(c) * F.log2(share(c)))
    return F.when(n > 0, bits).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the URL itself, by name; never null."""
    whole = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(whole, r"\?([^#]*)", 1)
    size = lambda text: F.length(text).cast("double")
    times = lambda text, pattern: F.regexp_count(text, F.lit(pattern)).cast("double")
    return {
        "url_length": size(whole),
        "host_length": size(host),
        "path_length": size(path),
        "depth": times(path, "/[^/]"),
        "host_labels": times(host, "[^.]+"),
        "digit_ratio": F.when(F.length(whole) > 0, times(whole, "[0-9]") / F.length(whole)).otherwise(0.0),
        "hyphens": times(host, "-"),
        "entropy": entropy(whole),
        "parameters": times(query, "[^&]+"),
        "query_length": size(query),
        "has_fragment": F.instr(whole, "#").cast("boolean").cast("double"),
        "secure": whole.startswith("https").cast("double"),
    }


def with_features(pages: DataFrame, id_col: str, url_col: str, rules: Sequence[Rule]) -> DataFrame:
    """``id``, ``url``, ``host``, ``path``, ``rule``, ``verdict`` and all features of each row.

    Suffix statistics (URLs under the last label of the host, and the share of blocked ones among its
    labelled URLs) are counted over all rows. A suffix can own a third of them: rows are added up before
    the shuffle, and the join that brings the counts back can split its partitions.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    rows = rows.withColumns({"host": host_of(F.coalesce("url", F.lit(""))), "path": path_of(F.coalesce("url", F.lit("")))})
    rows = rows.withColumn("found", first_rule(F.col("host"), F.col("path"), rules))
    rows = rows.withColumns({"rule": F.col("found.rule"), "ruled": F.col("found.verdict")}).drop("found")
    rows = rows.withColumn("suffix", F.regexp_extract("host", r"[^.]*$", 0))
    counts = rows.groupBy("suffix").agg(
        F.count(F.lit(1)).alias("urls"),
        F.count("ruled").alias("labelled"),
        F.count(F.when(F.col("ruled") == "block", True)).alias("blocked"),
    )
    statistics = store(
        counts.select(
            "suffix",
            F.log1p("urls").alias("suffix_urls"),
            ((F.col("blocked") + PRIOR / 2) / (F.col("labelled") + PRIOR)).alias("suffix_block_rate"),
        ),
        "url-suffixes",
    )
    features = lexical(F.col("url"), F.col("host"), F.col("path"))
    return rows.join(statistics, "suffix").withColumns(features).drop("suffix")


def training_rows(known: DataFrame, rows: int = SAMPLE_ROWS) -> tuple[set[float], DataFrame]:
    """Labels (1 for block) among all ruled rows, and ``label, weight`` and features of the URLs to learn from.

    Copies of a URL are counted before anything is chosen, so they neither crowd out others nor enter or
    miss the sample together. A verdict with more than ``rows`` / 2 distinct URLs (told apart by a 64-bit
    hash) sends those of the smallest hash, and their weights are raised to all rows of the verdict.
    """
    ruled = known.where("ruled is not null").select(
        (F.col("ruled") == "block").cast("double").alias("label"), F.xxhash64("url").alias("h"), *FEATURES
    )
    urls = store(ruled.groupBy("label", "h").agg(F.count(F.lit(1)).alias("copies")), "labelled-urls")
    total = {r["label"]: r["n"] for r in urls.groupBy("label").agg(F.sum("copies").alias("n")).collect()}
    picked = [urls.where(F.col("label") == label).orderBy("h").limit(max(1, rows // 2)) for label in sorted(total)]
    sample = store(reduce(DataFrame.union, picked, urls.limit(0)), "url-sample")
    held = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.sum("copies").alias("n")).collect()}
    share = F.lit(1.0)
    for label, n in total.items():
        share = F.when(F.col("label") == label, F.lit(n / held[label])).otherwise(share)
    weights = sample.select("label", "h", (F.col("copies") * share).alias("weight"))
    # At most ``rows`` URLs: small enough to be sent to the labelled rows.
    mine = ruled.join(F.broadcast(weights), ["label", "h"])
    chosen = mine.groupBy("label", "h", "weight").agg(*(F.first(c).alias(c) for c in FEATURES)).drop("h")
    return set(total), store(chosen, "url-features")


def judged(
    pages: DataFrame,
    rules: Sequence[Rule] = RULES,
    id_col: str = "page_id",
    url_col: str = "url",
    rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """``id, host, path, rule, verdict, score`` of each row; ``score`` is the trees' probability of a block.

    URLs that a rule judges are the labelled ones: boosted trees learn from them (training_rows) and judge
    the others. Where all labels agree, the others get the same verdict; without any, they are allowed
    (score 0). A null or a URL without ``://`` has an empty host and path and is judged by the trees.
    Repeated rows are judged alike; an empty table gives no rows; other columns are ignored.
    """
    known = with_features(pages, id_col, url_col, rules)
    labels, chosen = training_rows(known, rows)
    if len(labels) == 2:
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="vector")
        trees = GBTClassifier(
            featuresCol="vector", labelCol="label", weightCol="weight",
            maxIter=TREES, maxDepth=DEPTH, stepSize=RATE, seed=SEED,
        ).fit(assembler.transform(chosen.coalesce(4)))
        scored = trees.transform(assembler.transform(known))
        score = vector_to_array("probability")[1]
    else:
        scored, score = known, F.lit(1.0 if labels == {1.0} else 0.0)
    verdict = F.coalesce("ruled", F.when(score >= BLOCK, "block").otherwise("allow"))
    return scored.select("id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))


def keep_allowed(pages: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``pages`` whose URL is allowed, columns unchanged; null ids count as one id."""
    blocked = judged(pages, rules).where("verdict = 'block'").select("id").distinct()
    return pages.join(blocked, pages["page_id"].eqNullSafe(blocked["id"]), "left_anti")


def op10_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path, rule and verdict of every page; nulls, repeats and empty tables as ``judged`` states."""
    found = judged(read(spark, folder, "pages"))
    return found.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", "score")


QUERIES = {"op10_url_filter": op10_url_filter}
#: The trees' verdicts aren't in SQL; tests hold host, path and rule against brute force.
SQL: dict[str, str] = {}
