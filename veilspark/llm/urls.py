"""URL filters: rules first, gradient-boosted trees on lexical features for the rest.

The trees learn from URLs that a rule decides. Features are expressions over the URL alone
plus statistics of its host's suffix over all labelled rows; nothing here runs Python on the
executors.
"""

from __future__ import annotations

import string
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000  # labelled URLs that the trees are grown on, at most
TREES, DEPTH, SEED = 20, 4, 7
CELLS = 4096  # hash cells that suffixes are counted in, so their table has a known bound
SMOOTH = 20.0  # labelled URLs that a suffix needs before its own rate counts half
FEATURES = (
    "url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "hyphens", "entropy",
    "parameters", "fragment", "secure", "extension", "suffix_rate", "suffix_log_count",
)


@dataclass(frozen=True)
class Rule:
    """``org/`` fits the host org and its subdomains, and paths that start with ``/``."""

    text: str
    allow: bool

    @property
    def fits(self) -> Column:
        host, path = self.text[: self.text.index("/")], self.text[self.text.index("/") :]
        at_home = (F.col("host") == host) | F.col("host").endswith("." + host)
        return at_home & F.col("path").startswith(path)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null and for a URL without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), path


def _count(text: Column, letter: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(letter), F.lit("")))


def _lexical(url: Column) -> dict[str, Column]:
    """Features of the URL itself; null counts as empty."""
    url = F.coalesce(url, F.lit(""))
    host, path, size = F.col("host"), F.col("path"), F.greatest(F.length(url), F.lit(1))
    digits = F.length(url) - F.length(F.regexp_replace(url, "[0-9]", ""))

    def share(letter: Column) -> Column:
        p = (F.length(url) - F.length(F.replace(url, letter, F.lit("")))) / size
        return -p * F.log2(p)

    letters = F.array_distinct(F.filter(F.split(url, ""), lambda c: c != ""))
    return {
        "url_length": F.length(url),
        "host_length": F.length(host),
        "path_length": F.length(path),
        "depth": _count(path, "/"),
        "labels": _count(host, "."),
        "digit_ratio": digits / size,
        "hyphens": _count(url, "-"),
        "entropy": F.aggregate(F.transform(letters, share), F.lit(0.0), lambda a, x: a + x),
        "parameters": _count(url, "="),
        "fragment": (F.instr(url, "#") > 0).cast("int"),
        "secure": url.startswith("https://").cast("int"),
        "extension": F.length(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1)),
    }


def judge(pages: DataFrame, rules: list[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row: ``id_col``, ``host``, ``path``, ``rule`` (null if none fits),
    ``verdict`` (allow or block) and ``p_block``, the trees' probability.

    The longest fitting rule decides; without one the trees do, blocking from one half. They
    are grown on at most SAMPLE labelled rows in the order of a hash of the URL; suffix
    statistics are counted over all labelled rows. If rules label no row, or all alike,
    unruled URLs get that one verdict (allow for none) and ``p_block`` 0 or 1. Null URLs have
    empty host and path. Repeated rows are judged alike; other columns are not carried.
    """
    url = F.col(url_col)
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col).alias("id"), url.alias("url"), host.alias("host"), path.alias("path"))
    rule = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        rule = F.when(r.fits, r.text).otherwise(rule)
        verdict = F.when(r.fits, "allow" if r.allow else "block").otherwise(verdict)
    rows = rows.select(
        "id", "host", "path", rule.alias("rule"), verdict.alias("ruled"),
        F.pmod(F.xxhash64(F.regexp_extract("host", r"([^.]*)$", 1)), F.lit(CELLS)).alias("suffix"), F.xxhash64("url").alias("order"),
        *[c.cast("double").alias(n) for n, c in _lexical(F.col("url")).items()],
    )
    labelled = rows.where(F.col("ruled").isNotNull()).withColumn("label", (F.col("ruled") == "block").cast("double"))
    by_suffix = labelled.groupBy("suffix").agg(F.sum("label").alias("blocked"), F.count("*").alias("n"))
    total = by_suffix.agg(F.sum("blocked").alias("blocked"), F.sum("n").alias("n")).first()
    out = [F.col("id").alias(id_col), "host", "path", "rule"]
    if not total["n"] or total["blocked"] in (0, total["n"]):
        p = 1.0 if total["n"] and total["blocked"] else 0.0
        default = F.lit("block" if p else "allow")
        return rows.select(*out, F.coalesce("ruled", default).alias("verdict"), F.lit(p).alias("p_block"))
    rate = total["blocked"] / total["n"]
    suffixes = by_suffix.select(
        "suffix",
        ((F.col("blocked") + SMOOTH * rate) / (F.col("n") + SMOOTH)).alias("suffix_rate"),
        F.log1p("n").alias("suffix_log_count"),
    )  # CELLS rows at most

    def full(df: DataFrame) -> DataFrame:
        joined = df.join(F.broadcast(suffixes), "suffix", "left").fillna({"suffix_rate": rate, "suffix_log_count": 0.0})
        return VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(joined)

    sample = full(labelled.orderBy("order").limit(SAMPLE)).select("features", "label")
    trees = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=SEED, checkpointInterval=-1).fit(sample)
    judged = trees.transform(full(rows)).withColumn("p_block", vector_to_array("probability")[1])
    method = F.when(F.col("p_block") >= 0.5, "block").otherwise("allow")
    return judged.select(*out, F.coalesce("ruled", method).alias("verdict"), "p_block")
