"""Quality by weak supervision: rules vote or abstain, EM weighs them, a posterior decides.

``text_stats`` measures a text, ``rules`` turn the measures into votes (+1 good, -1 bad,
0 abstain), ``fit`` counts vote patterns over *all* rows with one aggregate (at most
3 ** len(RULES) patterns reach the driver, whatever the input) and runs EM on these counts,
and ``with_posterior`` adds the probability of good quality as a plain column expression.

Defined cases: a null or empty text has zero of everything, fails the base rules and is not
kept; repeated rows are judged alike; an empty table gives the start values of EM.  All
columns of the input stay, and the added names must be free.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from simplexflow.llm.tables import SPACES, small_batches, spare

#: Symbols that the base rules count; fixed values of the contract.
SYMBOLS = "#*$%&|<>"

#: Frequent function words of four languages.
FUNCTION_WORDS = frozenset(w.encode() for w in (
    "the of and to in that is was for it with as on be at by this are from an or he have not they which you "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch es "
    "le la les de des et un une du que est pas pour dans qui par au avec sur ce plus ne se "
    "el los las y del por con una su para al lo como más pero sus no").split())

UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123))

STATS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_bangs",
         "n_runs", "n_function")
STATS_TYPE = StructType([StructField(name, LongType(), False) for name in STATS])


def measure(text: str | None, window: int = 5) -> tuple[int, ...]:
    """The values of ``STATS`` for one whole text."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    repeated = 0
    grams = list(zip(*(words[i:] for i in range(window))))
    if len(set(grams)) < len(grams):
        counts = Counter(grams)
        end = 0
        for i, gram in enumerate(grams):
            if counts[gram] > 1:
                repeated += i + window - max(i, end)
                end = i + window
    return (
        len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines), len(lines) - len(set(lines)),
        repeated, len(raw) - len(raw.translate(None, LETTERS)), len(raw) - len(raw.translate(None, UPPER)), text.count("!"),
        sum(map(eq, words, words[1:])), sum(map(FUNCTION_WORDS.__contains__, raw.lower().split())),
    )


@F.pandas_udf(STATS_TYPE)
def _text_stats(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=list(STATS))


#: Not pushed below or beside a filter, so each text is measured once.
text_stats = _text_stats.asNondeterministic()


def share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def vote(enough: Column, bad: Column, good: Column) -> Column:
    return F.when(~enough, 0).when(bad, -1).when(good, 1).otherwise(0)


def rules(prefix: str = "") -> dict[str, Column]:
    """Votes by name, from the measures below ``prefix``."""
    c = lambda name: F.col(prefix + name)
    s = lambda part, whole: share(prefix + part, prefix + whole)
    some, many = c("n_words") > 0, c("n_words") >= 20
    return {
        "length": vote(F.lit(True), c("n_words") < 10, c("n_words") >= 25),
        "symbols": vote(some, s("n_symbols", "word_chars") > 0.04, s("n_symbols", "word_chars") < 0.01),
        "repeats": vote(some, s("n_repeat_words", "n_words") > 0.2, s("n_repeat_words", "n_words") < 0.1),
        "lines": vote(c("n_lines") >= 4, s("n_dup_lines", "n_lines") > 0.3, s("n_dup_lines", "n_lines") < 0.1),
        "case": vote(c("n_letters") >= 20, s("n_upper", "n_letters") > 0.3, s("n_upper", "n_letters") < 0.15),
        "bangs": vote(some, s("n_bangs", "n_words") > 0.1, s("n_bangs", "n_words") < 0.03),
        "runs": vote(many, s("n_runs", "n_words") > 0.1, s("n_runs", "n_words") < 0.03),
        "function": vote(many, s("n_function", "n_words") < 0.04, s("n_function", "n_words") > 0.1),
        "word_length": vote(many, s("word_chars", "n_words") > 14, (s("word_chars", "n_words") < 10) & (s("word_chars", "n_words") > 2)),
    }


RULES = ("length", "symbols", "repeats", "lines", "case", "bangs", "runs", "function", "word_length")


@dataclass(frozen=True)
class VoteModel:
    """Share of good rows, and for each rule how often its vote is right on good and on bad rows."""

    prior: float
    right_good: dict[str, float]
    right_bad: dict[str, float]
    steps: int


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], names: tuple[str, ...], max_steps: int = 500,
                             tolerance: float = 1e-10) -> VoteModel:
    """Two-class EM on vote patterns and their counts; abstentions say nothing.

    The start values and pseudo-counts (19 right of 20 on good rows, 3 right of 10 on bad ones)
    fix which class is which and keep every rate inside (0, 1).
    """
    patterns = sorted(patterns)
    prior, good, bad = 0.9, dict.fromkeys(names, 0.99), dict.fromkeys(names, 0.3)
    step = 0
    for step in range(1, max_steps + 1):
        weight = 0.0
        total = 0
        sums = {n: [0.0, 0.0, 0.0, 0.0] for n in names}  # right and all on good rows, right and all on bad rows
        for votes, count in patterns:
            odds = math.log(prior / (1 - prior))
            for n, v in zip(names, votes):
                odds += v and (math.log(good[n] / (1 - bad[n])) if v > 0 else math.log((1 - good[n]) / bad[n]))
            p = 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))
            weight += p * count
            total += count
            for n, v in zip(names, votes):
                if v:
                    cell = sums[n]
                    cell[0] += p * count * (v > 0)
                    cell[1] += p * count
                    cell[2] += (1 - p) * count * (v < 0)
                    cell[3] += (1 - p) * count
        before = (prior, *good.values(), *bad.values())
        prior = (weight + 9) / (total + 10)
        for n, (a, b, c, d) in sums.items():
            good[n], bad[n] = (a + 19) / (b + 20), (c + 3) / (d + 10)
        if max(abs(x - y) for x, y in zip(before, (prior, *good.values(), *bad.values()))) < tolerance:
            break
    return VoteModel(prior, good, bad, step)


def fit(stats: DataFrame, prefix: str = "") -> VoteModel:
    """``stats`` has the measures as columns (below ``prefix``); one grouped count over all rows.

    Rows that fail the base rules are decided already and would only blur the bad class.
    """
    names = RULES
    votes = stats.where(~base_failed(prefix)).select(*[v.alias(n) for n, v in rules(prefix).items()]).groupBy(*names).agg(F.count(F.lit(1)).alias("n_rows"))
    return expectation_maximisation([(tuple(r[n] for n in names), r["n_rows"]) for r in votes.collect()], names)


def posterior(model: VoteModel, prefix: str = "") -> Column:
    """Probability of good quality."""
    odds = F.lit(math.log(model.prior / (1 - model.prior)))
    for n, v in rules(prefix).items():
        up = math.log(model.right_good[n] / (1 - model.right_bad[n]))
        down = math.log((1 - model.right_good[n]) / model.right_bad[n])
        odds = odds + F.when(v == 1, F.lit(up)).when(v == -1, F.lit(down)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-odds))


def base_failed(prefix: str = "") -> Column:
    words, repeats = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    return (words < 10) | (100 * repeats > 20 * words)


def judged(stats: DataFrame, prefix: str = "", threshold: float = 0.5) -> DataFrame:
    """Measured rows plus ``base_failed``, ``quality`` (posterior) and ``kept``."""
    model = fit(stats, prefix)
    return (stats.withColumn("base_failed", base_failed(prefix)).withColumn("quality", posterior(model, prefix))
            .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)))


def keep_good(docs: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of good quality, with the columns of ``docs``.

    Texts are measured twice, once for the counts and once for the decision; that costs less
    than shuffling them, and needs no key.
    """
    small_batches(docs.sparkSession)
    name = spare(docs, "measured")
    measured = docs.withColumn(name, text_stats(F.col(text)))
    model = fit(docs.select(text_stats(F.col(text)).alias(name)), f"{name}.")
    kept = measured.where(~base_failed(f"{name}.") & (posterior(model, f"{name}.") >= threshold))
    return kept.drop(name)
