"""Panels built from the given tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from simplexflow.plans.lineage import cut


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def quarter(c: str) -> Column:
    return (F.year(c) * 4 + F.quarter(c) - 1).cast("double")


def long_rows(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """Rows ``subject, time, taxon, amount`` of a named panel before aggregation."""
    if name in ("events", "users"):
        who = F.col("user_id") % 10 if name == "events" else F.col("user_id")
        return table(spark, sf, "events").select(
            who.cast("string").alias("subject"), F.unix_date(F.to_date("ts")).cast("double").alias("time"),
            F.col("event_type").alias("taxon"), F.lit(1.0).alias("amount"))
    if name in ("brand", "type"):
        column = "p_brand" if name == "brand" else "p_type"
        sales = table(spark, sf, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_shipdate")
        shop = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
        part = table(spark, sf, "part").select("p_partkey", column)
        joined = sales.join(shop, F.col("l_suppkey") == F.col("s_suppkey")).join(part, F.col("l_partkey") == F.col("p_partkey"))
        return joined.select(F.col("s_nationkey").cast("string").alias("subject"), quarter("l_shipdate").alias("time"),
                             F.col(column).alias("taxon"), F.col("l_quantity").alias("amount"))
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_orderpriority")
    buyer = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    joined = orders.join(buyer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select(F.col("c_nationkey").cast("string").alias("subject"), quarter("o_orderdate").alias("time"),
                         F.col("o_orderpriority").alias("taxon"), F.lit(1.0).alias("amount"))


def build(spark: SparkSession, sf: str, name: str) -> tuple[DataFrame, DataFrame]:
    """(panel, samples) of a named panel; the counts are aggregated once."""
    rows = long_rows(spark, sf, name)
    cells = cut(rows.groupBy("subject", "time", "taxon").agg(F.sum("amount").alias("count")))
    key = F.concat_ws("|", "subject", F.col("time").cast("bigint").cast("string"))
    panel = cells.select(key.alias("sample"), "taxon", "count")
    return panel, cells.select(key.alias("sample"), "subject", "time").distinct()


_QUARTER = "CAST(year({c}) * 4 + quarter({c}) - 1 AS DOUBLE)"
_LONG = {
    "events": "SELECT CAST(user_id % 10 AS VARCHAR) AS subject, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS DOUBLE) AS time, event_type AS taxon, 1.0::DOUBLE AS amount FROM events",
    "users": "SELECT CAST(user_id AS VARCHAR) AS subject, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS DOUBLE) AS time, event_type AS taxon, 1.0::DOUBLE AS amount FROM events",
    "brand": f"SELECT CAST(s_nationkey AS VARCHAR) AS subject, {_QUARTER.format(c='l_shipdate')} AS time, p_brand AS taxon, l_quantity AS amount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey",
    "type": f"SELECT CAST(s_nationkey AS VARCHAR) AS subject, {_QUARTER.format(c='l_shipdate')} AS time, p_type AS taxon, l_quantity AS amount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey",
    "priority": f"SELECT CAST(c_nationkey AS VARCHAR) AS subject, {_QUARTER.format(c='o_orderdate')} AS time, o_orderpriority AS taxon, 1.0::DOUBLE AS amount FROM orders JOIN customer ON o_custkey = c_custkey",
}


def panel_sql(name: str, tag: str = "") -> str:
    """CTEs ``panel``, ``samples`` and ``dense`` (with ``lib`` and ``ra``), names suffixed by ``tag``."""
    return f"""long{tag} AS ({_LONG[name]}),
panel{tag} AS (SELECT subject || '|' || CAST(CAST(time AS BIGINT) AS VARCHAR) AS sample, taxon, sum(amount) AS count FROM long{tag} GROUP BY subject, time, taxon),
samples{tag} AS (SELECT DISTINCT subject || '|' || CAST(CAST(time AS BIGINT) AS VARCHAR) AS sample, subject, time FROM long{tag}),
taxa{tag} AS (SELECT DISTINCT taxon FROM panel{tag}),
filled{tag} AS (SELECT s.sample, s.subject, s.time, t.taxon, coalesce(p.count, 0.0) AS count FROM samples{tag} s CROSS JOIN taxa{tag} t LEFT JOIN panel{tag} p ON p.sample = s.sample AND p.taxon = t.taxon),
dense{tag} AS (SELECT *, sum(count) OVER (PARTITION BY sample) AS lib, count / sum(count) OVER (PARTITION BY sample) AS ra FROM filled{tag})"""


def r6(c: Column | str) -> Column:
    """Six decimals, with no negative zero; the shift settles exact halves the same way everywhere."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) < 5e-7, F.lit(0.0)).otherwise(F.round(c + F.lit(1e-9), 6))


def rounded(df: DataFrame, keys: list[str], floats: list[str]) -> DataFrame:
    return df.select(*keys, *[r6(c).alias(c) for c in floats])


def rounded_sql(ctes: str, source: str, keys: list[str], floats: list[str]) -> str:
    q = [f'"{k}"' for k in keys]
    f = [f'CASE WHEN abs("{c}") < 5e-7 THEN 0.0::DOUBLE ELSE round("{c}"::DOUBLE + 1e-9, 6) END AS "{c}"' for c in floats]
    return f"WITH {ctes} SELECT {', '.join(q + f)} FROM {source}"
