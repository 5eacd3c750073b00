"""Queries on sources, taxon filters, composition steps, time merging and multiple testing."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog.panels import build, long_rows, panel_sql, rounded, rounded_sql, table
from simplexflow.functions import scalars
from simplexflow.operators import association as A
from simplexflow.operators import compose as C
from simplexflow.operators import multitest
from simplexflow.operators import pairs as P
from simplexflow.operators import timeaxis as X
from simplexflow.operators.weights import cumulative_fdr
from simplexflow.plans.lineage import cut
from simplexflow.plans.screen import screen
from simplexflow.sources import panel as S


def read_query():
    """Panel and metadata read under other column names; timestamps become days."""
    def run(spark, sf):
        e = table(spark, sf, "events")
        meta = S.read_samples(e, subject_col="user_id", time_col="ts", sample_col="event_id")
        counts = S.read_panel(e, sample="event_id", taxon="event_type", count="value")
        return rounded(counts.join(meta, "sample"), ["sample", "subject", "taxon"], ["time", "count"])

    ctes = "e AS (SELECT CAST(event_id AS VARCHAR) AS sample, CAST(user_id AS VARCHAR) AS subject, event_type AS taxon, epoch_us(ts) / 86400e6 AS time, value AS count FROM events)"
    return run, rounded_sql(ctes, "e", ["sample", "subject", "taxon"], ["time", "count"])


def melt_query(orient):
    """A wide matrix of monthly order lines, melted from rows of samples or rows of parts."""
    def run(spark, sf):
        l = table(spark, sf, "lineitem")
        flags = ["A", "N", "R"]
        if orient == "samples":
            wide = l.groupBy(F.col("l_suppkey").cast("string").alias("id")).agg(
                *[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0)).alias(f) for f in flags])
        else:
            wide = l.groupBy(F.col("l_returnflag").alias("id")).agg(
                *[F.sum(F.when(F.col("l_linenumber") == k, F.col("l_quantity")).otherwise(0.0)).alias(f"line{k}") for k in range(1, 8)])
        return rounded(S.melt_panel(wide, orient, "id"), ["sample", "taxon"], ["count"])

    if orient == "samples":
        ctes = "w AS (SELECT CAST(s.l_suppkey AS VARCHAR) AS sample, f AS taxon, sum(CASE WHEN l_returnflag = f THEN l_quantity ELSE 0.0 END) AS count FROM lineitem s CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS f) GROUP BY ALL)"
    else:
        ctes = "w AS (SELECT 'line' || k AS sample, l_returnflag AS taxon, sum(CASE WHEN l_linenumber = k THEN l_quantity ELSE 0.0 END) AS count FROM lineitem CROSS JOIN (SELECT unnest(range(1, 8)) AS k) GROUP BY ALL)"
    return run, rounded_sql(ctes, "w", ["sample", "taxon"], ["count"])


def dense_query():
    """Dense grid with library size and relative abundance."""
    def run(spark, sf):
        panel, samples = build(spark, sf, "users")
        dense = S.densify(panel, samples, panel.select("taxon"))
        return rounded(S.with_library(dense), ["sample", "taxon"], ["count", "lib", "ra"])

    return run, rounded_sql(panel_sql("users"), "dense", ["sample", "taxon"], ["count", "lib", "ra"])


def joined_query():
    def run(spark, sf):
        panel, samples = build(spark, sf, "brand")
        return rounded(S.join_samples(panel, samples), ["sample", "subject", "taxon"], ["time", "count"])

    ctes = f"{panel_sql('brand')}, o AS (SELECT p.sample, subject, taxon, time, count FROM panel p JOIN samples s ON p.sample = s.sample)"
    return run, rounded_sql(ctes, "o", ["sample", "subject", "taxon"], ["time", "count"])


def taxa_query():
    """Parts with enough mean share and prevalence over all samples."""
    def run(spark, sf):
        panel, samples = build(spark, sf, "brand")
        cells = S.with_library(panel)
        kept = S.filter_taxa(cells, samples.agg(F.count("*").alias("n")), 0.04, 0.9)
        return rounded(kept.groupBy("taxon").agg(F.sum("ra").alias("total")), ["taxon"], ["total"])

    ctes = f"{panel_sql('brand')}, o AS (SELECT taxon, sum(ra) AS total FROM dense GROUP BY taxon HAVING avg(ra) >= 0.04 AND avg(CASE WHEN ra > 0 THEN 1.0 ELSE 0.0 END) >= 0.9)"
    return run, rounded_sql(ctes, "o", ["taxon"], ["total"])


def requested_query():
    """Only requested parts that exist (brands ending in 1 or 2)."""
    def run(spark, sf):
        panel, _ = build(spark, sf, "brand")
        wanted = table(spark, sf, "part").filter(F.col("p_brand").rlike("[12]$")).select(F.col("p_brand").alias("taxon"))
        kept = S.require_taxa(panel, wanted, 2)
        return rounded(kept.groupBy("taxon").agg(F.sum("count").alias("total")), ["taxon"], ["total"])

    ctes = f"{panel_sql('brand')}, o AS (SELECT taxon, sum(count) AS total FROM panel WHERE right(taxon, 1) IN ('1', '2') GROUP BY taxon)"
    return run, rounded_sql(ctes, "o", ["taxon"], ["total"])


def align_query():
    """Two panels on shared samples, and whether their metadata disagree."""
    def run(spark, sf):
        a, sa = build(spark, sf, "brand")
        b, sb = build(spark, sf, "priority")
        first, second = S.align_panels(a, b)
        both = first.select("sample", "taxon", "count", F.lit("a").alias("panel")).unionByName(
            second.select("sample", "taxon", "count", F.lit("b").alias("panel")))
        shifted = sb.withColumn("time", F.when(F.col("subject") == "3", F.col("time") + 1).otherwise(F.col("time")))
        meta = S.merge_metadata(sa, shifted)
        return rounded(both.join(meta, "sample"), ["sample", "taxon", "panel", "subject", "conflict"], ["time", "count"])

    ctes = f"""{panel_sql('brand', '_a')}, {panel_sql('priority', '_b')},
s AS (SELECT sample FROM samples_a INTERSECT SELECT sample FROM samples_b),
o AS (SELECT p.sample, taxon, panel, subject, subject = '3' AS conflict, time, count FROM (SELECT *, 'a' AS panel FROM panel_a UNION ALL SELECT *, 'b' FROM panel_b) p
  JOIN s ON p.sample = s.sample JOIN samples_a m ON m.sample = p.sample)"""
    return run, rounded_sql(ctes, "o", ["sample", "taxon", "panel", "subject", "conflict"], ["time", "count"])


def mix_query():
    def run(spark, sf):
        a, _ = build(spark, sf, "type")
        b, _ = build(spark, sf, "priority")
        a, b = S.align_panels(a, b)
        mixed = C.mix_compositions(S.with_library(a), S.with_library(b), (2, 3))
        return rounded(mixed, ["sample", "panel", "taxon"], ["ra"])

    ctes = f"""{panel_sql('type', '_a')}, {panel_sql('priority', '_b')}, s AS (SELECT sample FROM samples_a INTERSECT SELECT sample FROM samples_b),
o AS (SELECT sample, 'a' AS panel, taxon, 0.4 * ra AS ra FROM dense_a WHERE count > 0 AND sample IN (SELECT sample FROM s)
 UNION ALL SELECT sample, 'b', taxon, 0.6 * ra FROM dense_b WHERE count > 0 AND sample IN (SELECT sample FROM s))"""
    return run, rounded_sql(ctes, "o", ["sample", "panel", "taxon"], ["ra"])


def eps_query():
    """Log-ratios with an added constant, for every pair in every sample."""
    def run(spark, sf):
        panel, samples = build(spark, sf, "events")
        axis = cut(X.time_groups(samples))
        libs = panel.groupBy("sample").agg(F.sum("count").alias("lib"))
        seats = X.assign_chunks(axis.join(libs, "sample"))
        members = S.grid_join(samples.select("subject").distinct(), panel.select("taxon").distinct(), "taxon")
        rows = C.log_ratio_eps(C.triplet(P.pair_rows(P.dense_series(panel, seats, members))), 1e-6)
        return rounded(rows, ["i", "j", "sample"], ["x", "y"])

    ctes = f"""{panel_sql('events')}, o AS (SELECT a.taxon AS i, b.taxon AS j, a.sample, ln(a.ra + 1e-6) - ln(greatest(0.0, (a.lib - a.count - b.count) / a.lib) + 1e-6) AS x,
  ln(b.ra + 1e-6) - ln(greatest(0.0, (a.lib - a.count - b.count) / a.lib) + 1e-6) AS y FROM dense a JOIN dense b ON a.sample = b.sample AND a.taxon < b.taxon)"""
    return run, rounded_sql(ctes, "o", ["i", "j", "sample"], ["x", "y"])


def merge_query(how, tol):
    """Event values merged at equal or near times for each user."""
    def run(spark, sf):
        e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("subject"),
                                              (F.unix_date(F.to_date("ts")) * 24 + F.hour("ts")).cast("double").alias("time"), "value")
        return rounded(X.merge_times(e, "time", ["subject"], ["value"], how, tol), ["subject"], ["time", "value"])

    pick = "median(value)" if how == "median" else "avg(value)"
    base = "e AS (SELECT CAST(user_id AS VARCHAR) AS subject, CAST(epoch_us(ts) // 3600000000 AS DOUBLE) AS time, value FROM events)"
    if tol is None:
        ctes = f"{base}, o AS (SELECT subject, time, {pick} AS value FROM e GROUP BY subject, time)"
    else:
        ctes = f"""{base}, g AS (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY subject ORDER BY time) <= {tol} THEN 0 ELSE 1 END AS s FROM e),
h AS (SELECT *, sum(s) OVER (PARTITION BY subject ORDER BY time ROWS UNBOUNDED PRECEDING) AS grp FROM g), o AS (SELECT subject, avg(time) AS time, {pick} AS value FROM h GROUP BY subject, grp)"""
    return run, rounded_sql(ctes, "o", ["subject"], ["time", "value"])


def axis_query(tol):
    """Positions, group times and sizes of samples, with near days in one group."""
    keys = ["subject", "sample", "pos", "group_n", "n_groups"]

    def run(spark, sf):
        _, samples = build(spark, sf, "users")
        out = X.time_groups(samples, tol, slice_rows=7)
        typed = {c: F.col(c).cast("bigint") for c in keys[2:]}
        return rounded(out.withColumns(typed), keys, ["time", "group_time"])

    limit = 0 if tol is None else tol
    ctes = f"""{panel_sql('users')}, g AS (SELECT *, CASE WHEN time - lag(time) OVER (PARTITION BY subject ORDER BY time) <= {limit} THEN 0 ELSE 1 END AS s FROM samples),
h AS (SELECT *, CAST(sum(s) OVER (PARTITION BY subject ORDER BY time ROWS UNBOUNDED PRECEDING) - 1 AS BIGINT) AS pos FROM g),
o AS (SELECT subject, sample, time, pos, count(*) OVER (PARTITION BY subject, pos) AS group_n, avg(time) OVER (PARTITION BY subject, pos) AS group_time FROM h),
z AS (SELECT *, CAST(max(pos) OVER (PARTITION BY subject) + 1 AS BIGINT) AS n_groups FROM o)"""
    return run, rounded_sql(ctes, "z", keys, ["time", "group_time"])


def interpolate_query():
    """Brand counts missing in a quarter, filled on a line between known quarters."""
    def run(spark, sf):
        panel, samples = build(spark, sf, "brand")
        grid = S.grid_join(samples, panel.select("taxon").distinct(), "taxon").join(panel, ["sample", "taxon"], "left")
        return rounded(X.interpolate(grid, ["subject", "taxon"], "time", "count"), ["sample", "taxon"], ["count"])

    ctes = f"""{panel_sql('brand')}, g AS (SELECT s.sample, s.subject, s.time, t.taxon, p.count FROM samples s CROSS JOIN taxa t LEFT JOIN panel p ON p.sample = s.sample AND p.taxon = t.taxon),
h AS (SELECT *, max(CASE WHEN count IS NOT NULL THEN time END) OVER (PARTITION BY subject, taxon ORDER BY time ROWS UNBOUNDED PRECEDING) AS t0,
  min(CASE WHEN count IS NOT NULL THEN time END) OVER (PARTITION BY subject, taxon ORDER BY time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM g),
o AS (SELECT h.sample, h.taxon, coalesce(h.count, a.count + (h.time - t0) / (t1 - t0) * (b.count - a.count), a.count, b.count) AS count FROM h
  LEFT JOIN g a ON a.subject = h.subject AND a.taxon = h.taxon AND a.time = h.t0 LEFT JOIN g b ON b.subject = h.subject AND b.taxon = h.taxon AND b.time = h.t1)"""
    return run, rounded_sql(ctes, "o", ["sample", "taxon"], ["count"])


def rank_query():
    """Average-tie ranks of quantities per return flag: few large groups with many ties."""
    def run(spark, sf):
        l = table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_quantity")
        ranked = A.average_rank(l, ["l_returnflag"], "l_quantity", slice_rows=500)
        out = ranked.groupBy("l_returnflag", "l_quantity").agg(F.max("l_quantity_rank").alias("rank"), F.count("*").alias("n"))
        return rounded(out, ["l_returnflag", "n"], ["l_quantity", "rank"])

    ctes = """r AS (SELECT l_returnflag, l_quantity, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rk FROM lineitem),
o AS (SELECT l_returnflag, l_quantity, max(rk) AS rank, count(*) AS n FROM r GROUP BY l_returnflag, l_quantity)"""
    return run, rounded_sql(ctes, "o", ["l_returnflag", "n"], ["l_quantity", "rank"])


def detrend_query():
    """Monthly order value of each customer segment and nation without its straight line."""
    def run(spark, sf):
        o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        series = o.groupBy("c_nationkey", (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("double").alias("time")).agg(
            F.sum("o_totalprice").alias("x"))
        out = A.detrend(series.withColumn("x", F.col("x") / 1e6), ["c_nationkey"], "time", ["x"])
        return rounded(out, ["c_nationkey"], ["time", "x"])

    ctes = """s AS (SELECT c_nationkey, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS DOUBLE) AS time, sum(o_totalprice) / 1e6 AS x0 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
o AS (SELECT c_nationkey, time, CASE WHEN count(*) OVER w >= 3 THEN x0 - regr_intercept(x0, time) OVER w - regr_slope(x0, time) OVER w * time ELSE x0 END AS x FROM s WINDOW w AS (PARTITION BY c_nationkey))"""
    return run, rounded_sql(ctes, "o", ["c_nationkey"], ["time", "x"])


def correlation_query():
    """Aggregate correlation that stays null on constant groups."""
    def run(spark, sf):
        l = table(spark, sf, "lineitem")
        out = l.groupBy("l_orderkey").agg(scalars.safe_corr("l_quantity", "l_discount").alias("r"), F.count("*").alias("n"))
        return rounded(out, ["l_orderkey", "n"], ["r"])

    ctes = "o AS (SELECT l_orderkey, count(*) AS n, CASE WHEN stddev_samp(l_quantity) > 0 AND stddev_samp(l_discount) > 0 THEN covar_samp(l_quantity, l_discount) / (stddev_samp(l_quantity) * stddev_samp(l_discount)) END AS r FROM lineitem GROUP BY l_orderkey)"
    return run, rounded_sql(ctes, "o", ["l_orderkey", "n"], ["r"])


def line_p():
    """A number in [0, 1) for each order line, null for the seventh line."""
    return F.when(F.col("l_linenumber") != 7, F.pmod(F.col("l_extendedprice") * 100, F.lit(9973.0)) / 9973.0)


P_SQL = "CASE WHEN l_linenumber <> 7 THEN ((l_extendedprice * 100) % 9973.0) / 9973.0 END"


def step_up_query(method):
    """Adjusted p over every order line, with many ties and with nulls."""
    def run(spark, sf):
        l = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", line_p().alias("p0"))
        l = l.withColumn("p", F.round("p0", 4))
        done = multitest.adjust(l, "p", method)
        out = done.groupBy("p").agg(F.count("*").alias("n"), F.min("q").alias("q_low"), F.max("q").alias("q_high"))
        return rounded(out, ["n"], ["p", "q_low", "q_high"])

    factor = "(SELECT sum(1.0 / k) FROM range(1, CAST((SELECT count(p) FROM l) AS BIGINT) + 1) t(k))" if method == "BY" else "1.0"
    ctes = f"""l AS (SELECT round({P_SQL}, 4) AS p FROM lineitem),
a AS (SELECT p, CASE WHEN p IS NOT NULL THEN {factor} * p * count(p) OVER () / count(p) OVER (ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS q0 FROM l),
b AS (SELECT p, CASE WHEN p IS NOT NULL THEN least(1.0, min(q0) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS q FROM a),
o AS (SELECT p, count(*) AS n, min(q) AS q_low, max(q) AS q_high FROM b GROUP BY p)"""
    return run, rounded_sql(ctes, "o", ["n"], ["p", "q_low", "q_high"])


def cumulative_query():
    """Running mean of sorted rates over orders, ties in key order within one value."""
    def run(spark, sf):
        o = table(spark, sf, "orders").select("o_orderkey", (F.round(F.pmod(F.col("o_totalprice"), F.lit(500.0)) / 1000, 3)).alias("lfsr"))
        done = cumulative_fdr(o, "lfsr", ["o_orderkey"])
        out = done.groupBy("lfsr").agg(F.count("*").alias("n"), F.min("q_lfsr").alias("low"), F.max("q_lfsr").alias("high"))
        return rounded(out, ["n"], ["lfsr", "low", "high"])

    ctes = """o AS (SELECT o_orderkey, round((o_totalprice % 500.0) / 1000, 3) AS lfsr FROM orders),
c AS (SELECT lfsr, avg(lfsr) OVER (ORDER BY lfsr, o_orderkey ROWS UNBOUNDED PRECEDING) AS q FROM o),
z AS (SELECT lfsr, count(*) AS n, min(q) AS low, max(q) AS high FROM c GROUP BY lfsr)"""
    return run, rounded_sql(ctes, "z", ["n"], ["lfsr", "low", "high"])


def effective_query(method):
    """Effective length of quantity and price series of each supplier over its months."""
    def run(spark, sf):
        l = table(spark, sf, "lineitem")
        s = l.groupBy("l_suppkey", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("double").alias("time")).agg(
            F.avg("l_quantity").alias("x"), F.avg("l_discount").alias("y"))
        out = A.effective_n(s, by=["l_suppkey"], method=method)
        return rounded(out, ["l_suppkey", "n"], ["n_eff"])

    bound = {"nw": "greatest(1, floor(4 * pow(n / 100.0, 2.0 / 9.0)))", "bartlett": "floor(sqrt(n))", "ar1": "1"}[method]
    value = "n * (1 - greatest(-0.95, least(0.95, s1))) / (1 + greatest(-0.95, least(0.95, s1)))" if method == "ar1" else "n / greatest(1e-6, 1 + 2 * sw)"
    ctes = f"""s AS (SELECT l_suppkey, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS DOUBLE) AS time, avg(l_quantity) AS x, avg(l_discount) AS y FROM lineitem GROUP BY 1, 2),
d AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY time) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n, x - avg(x) OVER (PARTITION BY l_suppkey) AS dx, y - avg(y) OVER (PARTITION BY l_suppkey) AS dy FROM s),
b AS (SELECT l_suppkey, count(*) AS n, {bound.replace('n ', 'count(*) ').replace('sqrt(n)', 'sqrt(count(*))')} AS lags, sum(dx * dx) AS cx, sum(dy * dy) AS cy FROM d GROUP BY l_suppkey),
r AS (SELECT a.l_suppkey, k.k, greatest(-0.99, least(0.99, sum(a.dx * c.dx) / max(cx))) * greatest(-0.99, least(0.99, sum(a.dy * c.dy) / max(cy))) AS rr, max(lags) AS lags
  FROM d a JOIN b USING (l_suppkey) JOIN (SELECT unnest(range(1, (SELECT CAST(max(lags) AS BIGINT) + 1 FROM b))) AS k) k ON k.k <= lags JOIN d c ON c.l_suppkey = a.l_suppkey AND c.rn = a.rn + k.k GROUP BY a.l_suppkey, k.k),
t AS (SELECT l_suppkey, sum((1 - k / (lags + 1.0)) * rr) AS sw, sum(CASE WHEN k = 1 THEN rr END) AS s1 FROM r GROUP BY l_suppkey),
o AS (SELECT l_suppkey, n, CASE WHEN n >= 5 THEN greatest(4.0, least(n, {value})) END AS n_eff FROM b JOIN t USING (l_suppkey))"""
    return run, rounded_sql(ctes, "o", ["l_suppkey", "n"], ["n_eff"])


def bundle_query():
    """Result tables written as parquet and read back."""
    def run(spark, sf):
        panel, samples = build(spark, sf, "type")
        tables = screen(panel, samples)
        base = spark.sparkContext.getCheckpointDir()
        path = f"{base}/bundle-{uuid.uuid4().hex}"
        S.write_bundle({"meta": tables["meta"], "log": tables["log"]}, path, {"meta": "k"})
        meta = spark.read.parquet(f"{path}/meta")
        log = spark.read.parquet(f"{path}/log").select("i", "j", "n_dropped")
        return rounded(meta.join(log.withColumnRenamed("n_dropped", "dropped"), ["i", "j"]).withColumn("k", F.col("k").cast("bigint")), ["i", "j", "k", "dropped"], ["r_pooled", "q"])

    from catalog.screening import meta_sql
    from simplexflow.plans.screen import ScreenOptions

    base = meta_sql("type", ScreenOptions(all_columns=True))
    return run, rounded_sql(f"{base}, o AS (SELECT i, j, k, n_dropped AS dropped, r_pooled, q FROM meta)", "o", ["i", "j", "k", "dropped"], ["r_pooled", "q"])


def subjectwise_query():
    """Per-subject output beside the pooled one."""
    def run(spark, sf):
        panel, samples = build(spark, sf, "events")
        out = screen(panel, samples, return_subjectwise=True)
        joined = out["subjectwise"].join(out["meta"].select("i", "j", "r_pooled"), ["i", "j"])
        return rounded(joined, ["i", "j", "subject", "n"], ["r", "r_pooled"])

    from catalog.screening import meta_sql
    from simplexflow.plans.screen import ScreenOptions

    base = meta_sql("events", ScreenOptions(all_columns=True))
    return run, rounded_sql(f"{base}, o AS (SELECT s.i, s.j, s.subject, s.n, s.r, m.r_pooled FROM subj s JOIN meta m ON s.i = m.i AND s.j = m.j)", "o", ["i", "j", "subject", "n"], ["r", "r_pooled"])


def raw_rows_query():
    """Panel totals straight from the given tables."""
    def run(spark, sf):
        rows = long_rows(spark, sf, "priority")
        return rounded(rows.groupBy("subject", "taxon").agg(F.sum("amount").alias("total")), ["subject", "taxon"], ["total"])

    ctes = f"{panel_sql('priority')}, o AS (SELECT subject, taxon, sum(count) AS total FROM dense GROUP BY subject, taxon HAVING sum(count) > 0)"
    return run, rounded_sql(ctes, "o", ["subject", "taxon"], ["total"])


QUERIES = {
    "read_panel_and_samples": read_query(),
    "panel_totals": raw_rows_query(),
    "melt_rows_of_samples": melt_query("samples"),
    "melt_rows_of_parts": melt_query("taxa"),
    "densify_and_close": dense_query(),
    "join_metadata": joined_query(),
    "filter_mean_and_prevalence": taxa_query(),
    "filter_requested": requested_query(),
    "align_two_panels": align_query(),
    "mix_two_panels": mix_query(),
    "log_ratio_added_eps": eps_query(),
    "merge_equal_times_median": merge_query("median", None),
    "merge_near_times_mean": merge_query("mean", 6.0),
    "time_axis_exact": axis_query(None),
    "time_axis_tolerance": axis_query(1.0),
    "interpolate_gaps": interpolate_query(),
    "average_rank_large_groups": rank_query(),
    "detrend_series": detrend_query(),
    "safe_correlation": correlation_query(),
    "effective_n_nw": effective_query("nw"),
    "effective_n_bartlett": effective_query("bartlett"),
    "effective_n_ar1": effective_query("ar1"),
    "adjust_bh_lines": step_up_query("BH"),
    "adjust_by_lines": step_up_query("BY"),
    "cumulative_fdr_orders": cumulative_query(),
    "bundle_write_read": bundle_query(),
    "subjectwise_output": subjectwise_query(),
}
