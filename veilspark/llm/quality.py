"""Quality by weak supervision.

Rules vote good or bad on a text or abstain. Expectation-maximisation estimates, without
labels, how often each rule is right and how common good texts are; a text is kept if its
posterior probability of being good reaches a threshold, whatever single rules say. Votes
take one of 3 ** rules patterns, so the estimation works on a table of pattern counts over
all texts that no input can make larger.

Everything is DataFrame expressions: measures and votes in the row, one grouped count.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import private, staged

BLANKS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """Votes bad from ``bad`` on, good up to ``good``, and abstains between them.

    ``share`` is an SQL expression over the measures."""

    name: str
    share: str
    good: float
    bad: float


# A text without words has no shares: every rule but the first abstains on it.
RULES = (
    Rule("few words", "1.0 / greatest(n_words, 1)", 1 / 25, 1 / 9.5),
    Rule("symbols among letters", "n_symbols / nullif(word_chars, 0)", 0.005, 0.04),
    Rule("symbols a word", "n_symbols / nullif(n_words, 0)", 0.05, 0.3),
    Rule("repeated lines", "n_dup_lines / nullif(n_words, 0)", 0.001, 0.03),
    Rule("repeated words", "n_repeat_words / nullif(n_words, 0)", 0.05, 0.2),
    Rule("odd word length", "abs(word_chars / nullif(n_words, 0) - 5.5)", 2.5, 6.0),
)
KEEP_FROM = 0.5


def _bound(value: Column, body) -> Column:
    """``body`` over ``value`` computed once a row (a lambda's variable is not inlined)."""
    return F.transform(F.array(value), body)[0]


def _without(text: Column, letters: str) -> Column:
    """Plain replacements: many times faster than translate, which looks up each letter."""
    for letter in letters:
        text = F.replace(text, F.lit(letter), F.lit(""))
    return text


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: F.btrim(line, F.lit(BLANKS)) != "")
    return _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _repeat_words(words: Column) -> Column:
    """Words under windows of five words that the text has twice or more."""
    last = F.size(words) - WINDOW
    windows = F.transform(
        F.slice(words, 1, F.greatest(last + 1, F.lit(0))),
        lambda w, i: F.xxhash64(w, *[F.get(words, i + k) for k in range(1, WINDOW)]),
    )

    def covered(win: Column) -> Column:
        ordered = F.sort_array(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def twice(o: Column) -> Column:
            same = lambda k, j: F.coalesce(F.get(o, j)["h"] == F.get(o, k)["h"], F.lit(False))
            return F.sort_array(
                F.transform(
                    F.filter(o, lambda _, k: same(k, k - 1) | same(k, k + 1)),
                    lambda x: x["i"],
                )
            )

        def width(at: Column) -> Column:
            gaps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0), lambda a, x: a + x)

        return F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(
            _bound(_bound(ordered, twice), width)
        )

    return _bound(windows, covered)


def measured(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the five measures as longs; columns of these names are replaced. Null text: none."""
    text = private(docs, "text")
    words = private(docs, "words")
    trimmed = F.btrim(F.col(text), F.lit(BLANKS))
    kept = [c for c in docs.columns if c.lower() not in MEASURES]
    letters = F.length(_without(F.col(text), BLANKS))
    plain = F.length(_without(F.col(text), SYMBOLS))

    def count(w: Column) -> Column:
        return F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r"))

    split = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))
    rows = docs.withColumn(text, F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    rows = rows.withColumn(words, _bound(split, count))
    return rows.select(
        *kept,
        F.col(words)["n"].cast("long").alias("n_words"),
        letters.cast("long").alias("word_chars"),
        (F.length(text) - plain).cast("long").alias("n_symbols"),
        _dup_lines(F.col(text)).cast("long").alias("n_dup_lines"),
        F.col(words)["r"].cast("long").alias("n_repeat_words"),
    )


def vote(rule: Rule) -> Column:
    """0 abstains, 1 is good, 2 is bad."""
    share = F.expr(rule.share)
    return F.when(share >= rule.bad, 2).when(share <= rule.good, 1).otherwise(0)


def pattern(rules=RULES) -> Column:
    """All votes of a row as one number in base 3."""
    return sum((vote(r) * 3**i for i, r in enumerate(rules)), F.lit(0))


def estimate(counts: dict[int, int], n_rules: int, rounds: int = 100) -> list[float]:
    """Posterior probability of good for each pattern, by expectation-maximisation.

    Starts from rules that are right four times of five; a rule is right or wrong on good and
    on bad texts with rates of their own, and abstaining says nothing. One text of each kind
    is added throughout, so that no rate is 0 or 1; without rows the start decides.
    """
    votes = list(itertools.product(range(3), repeat=n_rules))
    votes = [v[::-1] for v in votes]  # the first rule is the lowest digit
    prior, right = 0.7, [[0.8, 0.8] for _ in range(n_rules)]  # on good texts, on bad texts

    def posterior(v) -> float:
        odds = math.log(prior / (1 - prior))
        for k, x in enumerate(v):
            if x:
                good, bad = right[k][0], right[k][1]
                odds += math.log(good / (1 - bad)) if x == 1 else math.log((1 - good) / bad)
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))

    for _ in range(rounds):
        p = {c: posterior(votes[c]) for c in counts}
        good, total = sum(p[c] * n for c, n in counts.items()), sum(counts.values())
        prior = (good + 1) / (total + 2)
        for k in range(n_rules):
            tally = [[1.0, 1.0], [1.0, 1.0]]  # [good text?][right?]
            for c, n in counts.items():
                if x := votes[c][k]:
                    tally[0][x == 1] += p[c] * n
                    tally[1][x == 2] += (1 - p[c]) * n
            # a rule is never taken to be wrong more often than right
            right[k] = [max(0.5, t[1] / (t[0] + t[1])) for t in tally]
            right[k] = [min(r, 1 - 1e-6) for r in right[k]]
    return [posterior(v) for v in votes]


def judged(docs: DataFrame, rules=RULES, keep_from: float = KEEP_FROM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: ``id_col``, the five measures, ``base_failed``, ``quality`` (the
    posterior) and ``kept``.

    ``base_failed``: under ten words, or over a fifth of the words in repeated windows; such
    texts are never kept. Null and empty texts have no words and fail. Repeated rows and ids
    are judged each for itself; other columns are not carried. An empty table gives no rows.
    """
    rows = measured(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text").drop("_text")
    rows = staged(rows.withColumn("_votes", pattern(rules)), "quality")
    counts = {r["_votes"]: r["count"] for r in rows.groupBy("_votes").count().collect()}  # 3 ** rules at most
    chance = F.array(*[F.lit(p) for p in estimate(counts, len(rules))])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select(
        F.col("_id").alias(id_col),
        *MEASURES,
        failed.alias("base_failed"),
        chance[F.col("_votes")].alias("quality"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= keep_from))
