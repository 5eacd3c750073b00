"""URL filter: rules by host suffix and path prefix, else logistic regression on hashed character n-grams.

Only DataFrame and SQL functions and Spark's own estimators are used; no Python runs on the executors.

Defined cases: a null url, or one without ``://``, has empty host and path, fits no rule and is judged by
the model on an empty text; repeated rows are judged alike; with an empty labelled table every url is
allowed, with labels of one kind only that kind is the verdict; an empty table stays empty; further
columns pass through, and the added names must be free.
"""

from __future__ import annotations

import string

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simplexflow.llm.tables import spare

#: (host, path prefix, verdict); fixed values of the contract.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def host(url: str) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    found = F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return F.coalesce(found, F.lit(""))


def path(url: str) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def longest_rule(rules: tuple[tuple[str, str, str], ...], host_col: str = "host", path_col: str = "path") -> Column:
    """Struct ``rule``, ``verdict`` of the longest rule that fits host or parent domain and path, else nulls."""
    given = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p"), F.lit(v).alias("v"))
                      for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))])
    fits = F.filter(given, lambda r: ((F.col(host_col) == r["h"]) | F.endswith(F.col(host_col), F.concat(F.lit("."), r["h"])))
                    & F.startswith(F.col(path_col), r["p"]))
    first = F.get(fits, F.lit(0))
    return F.struct(F.concat(first["h"], first["p"]).alias("rule"), first["v"].alias("verdict"))


def grams(low: int, high: int, host_col: str = "host", path_col: str = "path") -> Column:
    """Character n-grams of ``^host|path$``, all sizes from low to high."""
    text = F.concat(F.lit("^"), F.col(host_col), F.lit("|"), F.col(path_col), F.lit("$"))
    sizes = [F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i, n=n: F.substring(text, i, F.lit(n))))
             .otherwise(F.array().cast("array<string>")) for n in range(low, high + 1)]
    return F.concat(*sizes)


def with_parts(df: DataFrame, url: str = "url", rules: tuple = RULES) -> DataFrame:
    """Adds ``host``, ``path`` and ``rule_`` (struct of rule and verdict)."""
    taken = {"host", "path", "rule", "verdict"} & {c.lower() for c in df.columns}
    if taken:
        raise ValueError(f"columns exist: {sorted(taken)}")
    return df.withColumn("host", host(url)).withColumn("path", path(url)).withColumn("rule_", longest_rule(rules))


#: Words of unwanted and of ordinary hosts; the labelled table below is made of pairs of them.
UNWANTED = ("casino", "poker", "slots", "bets", "betting", "pills", "pharma", "viagra", "adult", "porn", "xxx", "escort", "spam", "ads", "track",
            "popup", "loans", "crack", "warez", "win", "cheap", "free", "farm", "clicks")
ORDINARY = ("library", "garden", "news", "school", "weather", "museum", "kitchen", "travel", "history", "science", "music", "forum", "docs", "city",
            "river", "bakery", "health", "sports", "books", "energy", "market", "studio", "church", "family")
#: Frequent letter pairs and endings of English; ordinary invented names are made of three of them.
PAIRS = ("th", "he", "in", "er", "an", "re", "nd", "at", "on", "nt", "ha", "es", "st", "en", "ed", "to", "it", "ou", "ea", "hi", "is", "or", "ti", "as",
         "tion", "ble", "ing", "ent", "ly", "wh")
#: Every name of either kind stands in each of these forms, so that they tell nothing.
SITES = ("{}.example.com", "www.{}.example.net", "m.{}.example.org", "blog.{}.example.com", "{}.example.net", "www.{}.example.org", "m.{}.example.com")
PLACES = ("en", "de", "fr", "es")
ENDS = ("", "/", ".html")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The small labelled table: ``host``, ``path``, ``verdict``; each word pairs with the next ones of its list.

    Ordinary names made of letter pairs keep the model from taking any unknown name for unwanted.
    """
    n = len(PAIRS)
    names = [(f"{w}-{UNWANTED[(i + 3 * k + 1) % len(UNWANTED)]}", "block") for i, w in enumerate(UNWANTED) for k in range(5)]
    names += [(f"{w}-{ORDINARY[(i + k + 1) % len(ORDINARY)]}", "allow") for i, w in enumerate(ORDINARY) for k in range(2)]
    names += [(a + PAIRS[(5 * i + k) % n] + PAIRS[(7 * i + 11 * k + 3) % n], "allow") for i, a in enumerate(PAIRS) for k in range(6)]
    names += [(a + a + PAIRS[(i + k) % n], "allow") for i, a in enumerate(PAIRS) for k in range(2)]
    rows = [(site.format(name), f"/{PLACES[(i + k) % len(PLACES)]}/{(7919 * (i % 9) + 104729 * k) % 9973}{ENDS[(i + k) % len(ENDS)]}", verdict)
            for i, (name, verdict) in enumerate(names) for k, site in enumerate(SITES)]
    return spark.createDataFrame(rows, "host string, path string, verdict string")


def train(labelled: DataFrame, n_features: int = 1 << 14, low: int = 2, high: int = 4, reg: float = 0.001) -> LogisticRegressionModel | None:
    """``labelled``: host, path, verdict; None if it is empty.  The table is small by contract, so it is held in one partition."""
    table = labelled.select(grams(low, high).alias("grams"), (F.col("verdict") == "block").cast("double").alias("label"), "host", "path")
    table = table.coalesce(1).sortWithinPartitions("host", "path", "label")
    rows = HashingTF(inputCol="grams", outputCol="features", numFeatures=n_features).transform(table).select("features", "label").persist()
    try:
        if rows.isEmpty():
            return None
        return LogisticRegression(regParam=reg, maxIter=60, standardization=False).fit(rows)
    finally:
        rows.unpersist()


def judged(df: DataFrame, url: str = "url", rules: tuple = RULES, labelled: DataFrame | None = None, n_features: int = 1 << 14, low: int = 2,
           high: int = 4) -> DataFrame:
    """``df`` with ``host``, ``path``, ``rule``, ``block_probability`` and ``verdict``."""
    parts = with_parts(df, url, rules)
    model = train(labelled_urls(df.sparkSession) if labelled is None else labelled, n_features, low, high)
    if model is None:
        scored = parts.withColumn("block_probability", F.lit(0.0))
    else:
        g, v = spare(parts, "grams"), spare(parts, "vector")
        raw, out, guess = spare(parts, "raw_score"), spare(parts, "class_probability"), spare(parts, "guess")
        model = model.setFeaturesCol(v).setRawPredictionCol(raw).setProbabilityCol(out).setPredictionCol(guess)
        hashed = HashingTF(inputCol=g, outputCol=v, numFeatures=n_features).transform(parts.withColumn(g, grams(low, high)))
        scored = model.transform(hashed)
        p = vector_to_array(F.col(out))
        scored = scored.withColumn("block_probability", F.coalesce(F.get(p, F.lit(1)), F.lit(0.0))).drop(g, v, raw, out, guess)
    own = F.when(F.col("block_probability") >= 0.5, "block").otherwise("allow")
    return (scored.withColumn("rule", F.col("rule_.rule")).withColumn("verdict", F.coalesce(F.col("rule_.verdict"), own)).drop("rule_"))
