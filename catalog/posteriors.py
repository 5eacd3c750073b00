"""Queries on loaded draws, diagnostics gates, scores and model weights."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from catalog.panels import build, rounded, rounded_sql, table
from catalog.regression import PLAIN, inputs_sql
from simplexflow.operators import draws as D
from simplexflow.operators import weights as B
from simplexflow.plans.fit import pair_inputs
from simplexflow.plans.rank import rank_edges
from simplexflow.sources.panel import grid_join
from simplexflow.sources.draws import read_draws, read_sampler_diag

ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"]


def wide_lines(spark, sf):
    """Order lines as draws: an edge is a block of 500 orders and a return flag."""
    l = table(spark, sf, "lineitem").select(*ORDER, "l_returnflag", "l_quantity", "l_discount", "l_tax")
    l = l.withColumns({"from": F.concat(F.lit("o"), F.floor(F.col("l_orderkey") / 500).cast("string")), "to": F.col("l_returnflag"),
                       "chain": F.col("l_linenumber") % 4})
    w = W.partitionBy("from", "to", "chain").orderBy(*ORDER)
    return l.withColumn("iter", F.row_number().over(w).cast("bigint")).select(
        "from", "to", "chain", "iter", (F.col("l_discount") - 0.05).alias("a_ij"), (F.col("l_tax") - 0.04).alias("a_ii"),
        (0.1 + F.col("l_discount")).alias("sigma"), F.col("l_quantity").alias("not_a_parameter"),
        F.col("l_quantity").alias("energy"), (F.col("l_quantity") == 50).cast("int").alias("divergent"),
        (F.col("l_quantity") / 5).cast("int").alias("treedepth"))


LINES = """wide AS (SELECT 'o' || CAST(l_orderkey // 500 AS VARCHAR) AS "from", l_returnflag AS "to", l_linenumber % 4 AS chain,
  row_number() OVER (PARTITION BY l_orderkey // 500, l_returnflag, l_linenumber % 4 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS iter,
  l_discount - 0.05 AS a_ij, l_tax - 0.04 AS a_ii, 0.1 + l_discount AS sigma, l_quantity AS energy, CASE WHEN l_quantity = 50 THEN 1 ELSE 0 END AS divergent, CAST(floor(l_quantity / 5) AS INT) AS treedepth FROM lineitem)"""
DRAWS = LINES + """, draws AS (SELECT "from", "to", chain, iter, 'a_ij' AS variable, a_ij AS value FROM wide UNION ALL SELECT "from", "to", chain, iter, 'a_ii', a_ii FROM wide UNION ALL SELECT "from", "to", chain, iter, 'sigma', sigma FROM wide)"""


def read_query():
    def run(spark, sf):
        out = read_draws(wide_lines(spark, sf)).groupBy("from", "to", "variable").agg(
            F.count("*").alias("n"), F.sum("value").alias("total"))
        return rounded(out, ["from", "to", "variable", "n"], ["total"])

    return run, rounded_sql(DRAWS + ', o AS (SELECT "from", "to", variable, count(*) AS n, sum(value) AS total FROM draws GROUP BY ALL)', "o", ["from", "to", "variable", "n"], ["total"])


SUMMARY_SQL = """, s AS (SELECT "from", "to", variable, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, 0.025) AS q2_5, quantile_cont(value, 0.975) AS q97_5,
  least(1.0, 2 * least(avg(CASE WHEN value > 1e-12 THEN 1.0 ELSE 0.0 END), avg(CASE WHEN value < -1e-12 THEN 1.0 ELSE 0.0 END))) AS p_sign2 FROM {src} GROUP BY "from", "to", variable)"""


def summary_query():
    def run(spark, sf):
        draws = read_draws(wide_lines(spark, sf)).withColumn("value", F.when(F.abs("value") < 1e-12, 0.0).otherwise(F.col("value")))
        return rounded(D.summarise_draws(draws), ["from", "to", "variable"], ["mean", "sd", "q2_5", "q97_5", "p_sign2"])

    return run, rounded_sql(DRAWS + SUMMARY_SQL.format(src="draws"), "s", ["from", "to", "variable"], ["mean", "sd", "q2_5", "q97_5", "p_sign2"])


def summary_large_query():
    """The same summary where a few groups hold all rows: ranked slice by slice."""
    def run(spark, sf):
        l = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("from"), F.col("l_linestatus").alias("to"), F.lit("a_ij").alias("variable"),
                                                (F.col("l_extendedprice") / 1000 - 30).alias("value"))
        return rounded(D.summarise_draws(l), ["from", "to", "variable"], ["mean", "sd", "q2_5", "q97_5", "p_sign2"])

    ctes = """l AS (SELECT l_returnflag AS "from", l_linestatus AS "to", 'a_ij' AS variable, l_extendedprice / 1000 - 30 AS value FROM lineitem)"""
    return run, rounded_sql(ctes + SUMMARY_SQL.format(src="l"), "s", ["from", "to", "variable"], ["mean", "sd", "q2_5", "q97_5", "p_sign2"])


def counts_query():
    keys = ["from", "to", "divergences", "treedepth_hits", "n_draws"]

    def run(spark, sf):
        return D.sampler_counts(read_sampler_diag(wide_lines(spark, sf)), 9).select(*keys)

    return run, rounded_sql(LINES + ', o AS (SELECT "from", "to", CAST(sum(divergent) AS BIGINT) AS divergences, CAST(sum(CASE WHEN treedepth >= 9 THEN 1 ELSE 0 END) AS BIGINT) AS treedepth_hits, count(*) AS n_draws FROM wide GROUP BY ALL)', "o", keys, [])


EBFMI = """, st AS (SELECT "from", "to", chain, energy, energy - lag(energy) OVER (PARTITION BY "from", "to", chain ORDER BY iter) AS d FROM wide),
ch AS (SELECT "from", "to", chain, CASE WHEN count(*) >= 3 AND var_samp(energy) > 0 THEN avg(d * d) / var_samp(energy) END AS e FROM st GROUP BY ALL),
eb AS (SELECT "from", "to", min(e) AS ebfmi_min, median(e) AS ebfmi_median FROM ch GROUP BY "from", "to")"""


def energy_query():
    def run(spark, sf):
        return rounded(D.energy_fraction(read_sampler_diag(wide_lines(spark, sf))), ["from", "to"], ["ebfmi_min", "ebfmi_median"])

    return run, rounded_sql(LINES + EBFMI, "eb", ["from", "to"], ["ebfmi_min", "ebfmi_median"])


def convergence_query():
    def run(spark, sf):
        lines = wide_lines(spark, sf)
        out = D.diagnose(read_draws(lines), read_sampler_diag(lines), 9)
        return rounded(out, ["from", "to", "divergences", "treedepth_hits", "n_draws"], ["rhat", "ess_bulk", "ess_tail", "ebfmi_min"])

    return run, None


def gate_figures():
    return {
        "rhat": 1 + F.avg("l_discount") * 0.8, "ess_bulk": F.sum("l_quantity") * 0.5, "ess_tail": F.sum("l_quantity") * 0.4,
        "divergences": F.sum((F.col("l_quantity") >= 48).cast("int")), "treedepth_hits": F.sum((F.col("l_tax") > 0.06).cast("int")),
        "ebfmi_min": F.avg("l_tax") * 9, "n_draws": F.count("*"),
    }


GATE_SQL = """g AS (SELECT l_suppkey AS id, 1 + avg(l_discount) * 0.8 AS rhat, sum(l_quantity) * 0.5 AS eb, sum(l_quantity) * 0.4 AS et, sum(CASE WHEN l_quantity >= 48 THEN 1 ELSE 0 END) AS dv,
  sum(CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END) AS td, avg(l_tax) * 9 AS e, count(*) AS n FROM lineitem GROUP BY l_suppkey),
o AS (SELECT id, rhat < 1.05 AND eb > 400 AND et > 400 AND dv <= 8 AND td <= 80 AND e >= 0.3 AS moderate, rhat < 1.01 AND eb > 1000 AND et > 1000 AND dv <= 0 AND td <= 0 AND e >= 0.4 AS strict,
  rhat < 1.05 AND eb > 400 AND et > 400 AND dv <= ceil(n * 0.001) AND td <= ceil(n * 0.01) AND e >= 0.3 AS scaled, dv > 0 OR e < 0.3 OR td > 0 OR rhat >= 1.05 OR eb < 400 AS bad FROM g)"""


def gate_query():
    """The diagnostics gates and the bad-fold flag on figures of each supplier."""
    def run(spark, sf):
        g = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(*[v.alias(k) for k, v in gate_figures().items()])
        return g.select("id", D.diag_ok("moderate").alias("moderate"), D.diag_ok("strict").alias("strict"), D.diag_ok("scaled").alias("scaled"), D.fold_bad().alias("bad"))

    return run, rounded_sql(GATE_SQL, "o", ["id", "moderate", "strict", "scaled", "bad"], [])


def label_query():
    """Sign label and local false sign rate per supplier."""
    def run(spark, sf):
        g = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", (F.pmod(F.abs("s_acctbal"), F.lit(10.0)) / 8).alias("p"))
        return rounded(g.select("s_suppkey", D.sign_label(F.col("s_acctbal")).alias("sign"), D.local_false_sign(F.col("p")).alias("lfsr")), ["s_suppkey", "sign"], ["lfsr"])

    ctes = "o AS (SELECT s_suppkey, CASE WHEN s_acctbal > 0 THEN '+' WHEN s_acctbal < 0 THEN '-' ELSE '0' END AS sign, least(0.5, greatest(0.0, (abs(s_acctbal) % 10.0) / 16)) AS lfsr FROM supplier)"
    return run, rounded_sql(ctes, "o", ["s_suppkey", "sign"], ["lfsr"])


def log_mean_query():
    def run(spark, sf):
        l = table(spark, sf, "lineitem").withColumn("x", -F.col("l_extendedprice") / 100)
        return rounded(D.log_mean_exp(l, ["l_suppkey"], "x"), ["l_suppkey"], ["lme"])

    ctes = """l AS (SELECT l_suppkey, -l_extendedprice / 100 AS x FROM lineitem), m AS (SELECT l_suppkey, max(x) AS top FROM l GROUP BY 1),
o AS (SELECT l.l_suppkey, max(top) + ln(avg(exp(x - top))) AS lme FROM l JOIN m USING (l_suppkey) GROUP BY 1)"""
    return run, rounded_sql(ctes, "o", ["l_suppkey"], ["lme"])


def edge_draws(spark, sf):
    """Parts of each size class as draws for every edge of the event panel."""
    p = table(spark, sf, "part")
    draws = p.select((F.col("p_partkey") % 4).cast("int").alias("chain"), F.floor(F.col("p_partkey") / 4).cast("bigint").alias("iter"),
                     (F.col("p_size") / 500).alias("r0"), (-F.col("p_retailprice") / 4000).alias("a_ii"), ((F.col("p_size") - 25) / 100).alias("a_ij"),
                     (0.3 + F.col("p_size") / 200).alias("sigma"), (0.2 + F.col("p_size") / 300).alias("sd_ou"), (0.3 + F.col("p_size") / 100).alias("phi"))
    types = table(spark, sf, "events").select("event_type").distinct()
    ends = types.select(F.col("event_type").alias("from"))
    edges = grid_join(ends, types.select(F.col("event_type").alias("to")), "to").filter(F.col("from") != F.col("to"))
    return grid_join(draws, edges, "to", blocks=4)


EDGE_DRAWS = """ed AS (SELECT a.event_type AS "from", b.event_type AS "to", p_partkey % 4 AS chain, p_partkey // 4 AS iter, p_size / 500.0 AS r0, -p_retailprice / 4000 AS a_ii, (p_size - 25) / 100.0 AS a_ij,
  0.3 + p_size / 200.0 AS sigma, 0.2 + p_size / 300.0 AS sd_ou FROM part CROSS JOIN (SELECT DISTINCT event_type FROM events) a JOIN (SELECT DISTINCT event_type FROM events) b ON a.event_type <> b.event_type)"""


def score_independent_query(nu):
    """Held-in scores of each subject under draws, without autocorrelation."""
    def run(spark, sf):
        panel, samples = build(spark, sf, "events")
        inputs = pair_inputs(panel, samples, smooth=False)
        out = D.score_subjects(edge_draws(spark, sf), inputs, "indep", nu=nu)
        return rounded(out, ["from", "to", "subject", "n_obs", "elpd_method"], ["elpd", "elpd_ppd"])

    sd = "sqrt(sigma * sigma + sd_ou * sd_ou)"
    if nu is None:
        ll = f"-0.5 * (ln(2 * pi()) + 2 * ln({sd}) + pow((y - r0 - a_ii * xi - a_ij * xj) / {sd}, 2))"
    else:
        scale = f"({sd} * sqrt({nu - 2.0} / {nu}))"
        ll = f"lgamma({(nu + 1) / 2}) - lgamma({nu / 2}) - 0.5 * ln({nu} * pi()) - ln({scale}) - {(nu + 1) / 2} * ln(1 + pow((y - r0 - a_ii * xi - a_ij * xj) / {scale}, 2) / {nu})"
    ctes = f"""{inputs_sql('events', PLAIN)}, {EDGE_DRAWS},
ll AS (SELECT i."from", i."to", i.subject, d.chain, d.iter, count(*) AS n, sum({ll}) AS ll FROM inputs i JOIN ed d ON i."from" = d."from" AND i."to" = d."to" GROUP BY ALL),
tp AS (SELECT "from", "to", subject, max(ll) AS top FROM ll GROUP BY ALL),
o AS (SELECT ll."from", ll."to", ll.subject, max(n) AS n_obs, 'indep' AS elpd_method, max(top) + ln(avg(exp(ll - top))) AS elpd, (max(top) + ln(avg(exp(ll - top)))) / max(n) AS elpd_ppd
  FROM ll JOIN tp ON ll."from" = tp."from" AND ll."to" = tp."to" AND ll.subject = tp.subject GROUP BY ALL)"""
    return run, rounded_sql(ctes, "o", ["from", "to", "subject", "n_obs", "elpd_method"], ["elpd", "elpd_ppd"])


def replicate_query(nu):
    """Log-likelihood of every row under every draw, summed per edge, and moments of replicated rows."""
    def run(spark, sf):
        panel, samples = build(spark, sf, "events")
        inputs = pair_inputs(panel, samples, smooth=False)
        wide = D.wide_draws(edge_draws(spark, sf)).withColumn("pred_sd", D.predictive_sd("wn"))
        if nu is None:
            rows = D.replicate(wide, inputs, nu)
            return rounded(rows.groupBy("from", "to").agg(F.count("*").alias("n"), F.avg("ll").alias("ll")), ["from", "to", "n"], ["ll"])
        return rounded(D.replicate_moments(wide, inputs, nu), ["from", "to", "n"], ["ll", "rep_mean", "rep_sd"])

    ctes = f"""{inputs_sql('events', PLAIN)}, {EDGE_DRAWS},
o AS (SELECT i."from", i."to", count(*) AS n, avg(-0.5 * pow((y - r0 - a_ii * xi - a_ij * xj) / sigma, 2) - ln(sigma) - 0.5 * ln(2 * pi())) AS ll
  FROM inputs i JOIN ed d ON i."from" = d."from" AND i."to" = d."to" GROUP BY i."from", i."to")"""
    return run, rounded_sql(ctes, "o", ["from", "to", "n"], ["ll"]) if nu is None else None


def score_kalman_query():
    def run(spark, sf):
        panel, samples = build(spark, sf, "events")
        inputs = pair_inputs(panel, samples, smooth=False)
        out = D.score_subjects(edge_draws(spark, sf), inputs, "auto")
        return rounded(out, ["from", "to", "subject", "n_obs", "elpd_method"], ["elpd", "elpd_ppd"])

    return run, None


def scores(spark, sf):
    """Subject scores: event types as models of each weekday, one score missing on purpose."""
    e = table(spark, sf, "events").withColumn("day", F.dayofweek("ts").cast("string"))
    s = e.groupBy(F.col("day").alias("to"), F.col("event_type").alias("from"), (F.col("user_id") % 10).cast("string").alias("subject")).agg(
        (-F.avg("value") / 10).alias("elpd"), F.count("*").alias("n_obs"))
    gone = (F.col("to") == "2") & (F.col("from") == "click") & (F.col("subject") == "4")
    return s.withColumn("elpd", F.when(~gone, F.col("elpd"))).withColumn("elpd_ppd", F.col("elpd") / F.col("n_obs") * 2)


SCORES = """sc0 AS (SELECT CAST(dayofweek(ts) + 1 AS VARCHAR) AS "to", event_type AS "from", CAST(user_id % 10 AS VARCHAR) AS subject, -avg(value) / 10 AS e, count(*) AS n_obs FROM events GROUP BY ALL),
sc AS (SELECT "to", "from", subject, n_obs, CASE WHEN "to" = '2' AND "from" = 'click' AND subject = '4' THEN NULL ELSE e END AS elpd FROM sc0),
md AS (SELECT "to", count(DISTINCT "from") AS m FROM sc GROUP BY "to"),
fs AS (SELECT "to", subject FROM sc JOIN md USING ("to") WHERE elpd IS NOT NULL GROUP BY "to", subject, m HAVING count(*) = m AND m >= 2)"""


def pseudo_query(per_row):
    def run(spark, sf):
        return rounded(B.pseudo_bma(scores(spark, sf), per_row=per_row), ["to", "from"], ["weight"])

    s = "2 * elpd" if per_row else "elpd"
    ctes = f"""{SCORES}, z AS (SELECT "to", "from", sum({s}) AS z FROM sc JOIN fs USING ("to", subject) GROUP BY ALL),
o AS (SELECT "to", "from", exp(z - max(z) OVER (PARTITION BY "to")) / sum(exp(z)) OVER (PARTITION BY "to") * exp(max(z) OVER (PARTITION BY "to")) AS weight FROM z)"""
    return run, rounded_sql(ctes, "o", ["to", "from"], ["weight"])


def common_query():
    def run(spark, sf):
        return rounded(B.common_subjects(scores(spark, sf)), ["to", "from", "subject"], ["s"])

    ctes = f'{SCORES}, o AS (SELECT "to", "from", subject, elpd AS s FROM sc JOIN fs USING ("to", subject))'
    return run, rounded_sql(ctes, "o", ["to", "from", "subject"], ["s"])


def plus_query():
    def run(spark, sf):
        return rounded(B.pseudo_bma(scores(spark, sf), 1000), ["to", "from"], ["weight"])

    return run, None


def stacking_query():
    def run(spark, sf):
        return rounded(B.stacking_weights(scores(spark, sf)), ["to", "from"], ["weight"])

    return run, None


def rank_loaded_query():
    """Edges from loaded draws with the sampler diagnostics gate, sign, rate and weights."""
    def run(spark, sf):
        lines = wide_lines(spark, sf)
        s = D.summarise_draws(read_draws(lines).filter("variable = 'a_ij'"))
        edges = s.select("from", "to", F.col("mean").alias("a_mean"), F.col("q2_5").alias("a_q2_5"), F.col("q97_5").alias("a_q97_5"), "p_sign2")
        diag = D.diagnose(read_draws(lines), read_sampler_diag(lines), 10)
        points = table(spark, sf, "lineitem").groupBy(
            F.concat(F.lit("o"), F.floor(F.col("l_orderkey") / 500).cast("string")).alias("from"), F.col("l_returnflag").alias("to"),
            (F.col("l_suppkey") % 5).cast("string").alias("subject")).agg((-F.avg("l_tax") * 100).alias("elpd"), F.count("*").alias("n_obs"))
        points = points.withColumn("elpd_ppd", F.col("elpd") / F.col("n_obs"))
        out = rank_edges({"edges": edges, "diagnostics": diag, "pointwise": points}, alpha=0.4, bootstrap=100)
        return rounded(out, ["from", "to", "sign", "diag_ok", "pass_bayes_fdr"], ["a_mean", "bayes_fdr", "w_pseudobma", "w_stacking"])

    return run, None


QUERIES = {
    "draws_read": read_query(),
    "draws_summary": summary_query(),
    "draws_summary_large_groups": summary_large_query(),
    "draws_sampler_counts": counts_query(),
    "draws_energy_fraction": energy_query(),
    "draws_convergence": convergence_query(),
    "gate_flags": gate_query(),
    "sign_labels": label_query(),
    "log_mean_exp": log_mean_query(),
    "score_independent_normal": score_independent_query(None),
    "score_independent_student": score_independent_query(5.0),
    "row_log_likelihood": replicate_query(None),
    "replicated_rows": replicate_query(5.0),
    "score_kalman": score_kalman_query(),
    "weights_common_subjects": common_query(),
    "weights_pseudo_bma": pseudo_query(False),
    "weights_pseudo_bma_per_row": pseudo_query(True),
    "weights_pseudo_bma_plus": plus_query(),
    "weights_stacking": stacking_query(),
    "rank_loaded_edges": rank_loaded_query(),
}
