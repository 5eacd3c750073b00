"""Queries on regression rows, folds, smoothing and fits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.panels import build, panel_sql, r6, rounded, rounded_sql
from simplexflow.operators import inputs as I
from simplexflow.operators import kfold as K
from simplexflow.operators import smooth, summary
from simplexflow.operators import timeaxis as X
from simplexflow.plans.across import fit_pairs_across, pair_inputs_across
from simplexflow.plans.fit import FitOptions, fit_pairs, pair_inputs
from simplexflow.plans.rank import rank_edges
from simplexflow.sources import panel as S

ROW_KEYS = ["from", "to", "subject"]
ROW_FLOATS = ["time", "y", "xi", "xj"]


def rows_from_triplet(o: FitOptions, source: str = "pr0", guard: bool = True) -> str:
    """CTEs from open triplets (i, j, subject, time, lib, pi, pj, pr, nz_i, nz_j) to ``inputs``."""
    third = ", CASE WHEN pr > 0 THEN pr END" if o.minpos_base == "triplet" else ""
    low = f"least(CASE WHEN pi > 0 THEN pi END, CASE WHEN pj > 0 THEN pj END{third})"
    eps = {
        "minpos_time": f"coalesce({o.minpos_alpha} * {low}, {o.eps_fixed})",
        "minpos_subject": f"coalesce({o.minpos_alpha} * min({low}) OVER (PARTITION BY i, j, subject), {o.eps_fixed})",
        "lib": f"greatest({o.lib_eps_c} / greatest(lib, 1.0), {o.eps_fixed})",
        "fixed": f"{o.eps_fixed}",
    }[o.zero_mode]
    cap = "1e300" if o.cap_mode == "none" else f"{o.alr_cap}"
    if o.cap_mode == "dynamic":
        cap = f"least({o.alr_cap}, greatest(0.0, CASE WHEN eps_s < 0.5 THEN ln((1 - 2 * eps_s) / eps_s) ELSE 0.0 END))"
    li, lj = ("x", "y") if o.transform == "alr" else ("ra_i", "ra_j")
    lag = o.lag
    keep = f"""keep AS (SELECT "from", "to" FROM rows GROUP BY "from", "to" HAVING count(*) >= {o.min_pairs} AND stddev_samp(xi) >= 1e-12 AND stddev_samp(xj) >= 1e-12),
inputs AS (SELECT rows.* FROM rows JOIN keep USING ("from", "to"))""" if guard else "inputs AS (SELECT * FROM rows)"
    return f"""e1 AS (SELECT *, {eps} AS eps, pi AS ra_i, pj AS ra_j FROM {source}),
e2 AS (SELECT * EXCLUDE (pi, pj, pr), CASE WHEN pi <= 0 THEN eps ELSE pi END AS pi, CASE WHEN pj <= 0 THEN eps ELSE pj END AS pj, greatest(CASE WHEN pr <= 0 THEN eps ELSE pr END, {o.rest_floor_frac} * eps) AS pr FROM e1),
e3 AS (SELECT *, ln(pi / (pi + pj + pr)) - ln(pr / (pi + pj + pr)) AS x0, ln(pj / (pi + pj + pr)) - ln(pr / (pi + pj + pr)) AS y0, eps / (pi + pj + pr) AS eps_s FROM e2),
e4 AS (SELECT *, greatest(-({cap}), least({cap}, x0)) AS x, greatest(-({cap}), least({cap}, y0)) AS y FROM e3),
stamp AS (SELECT subject, time, time - lag(time, {lag}) OVER (PARTITION BY subject ORDER BY time) AS gap FROM (SELECT DISTINCT subject, time FROM {source})),
usual AS (SELECT subject, median(gap) AS g FROM stamp WHERE gap > 0 GROUP BY subject),
gaps AS (SELECT subject, time, CASE WHEN gap > 0 THEN greatest(gap, 0.25 * g) END AS dt FROM stamp JOIN usual USING (subject)),
lagged AS (SELECT e4.*, dt, lag(x, {lag}) OVER w AS lx, lag(y, {lag}) OVER w AS ly, lag({li}, {lag}) OVER w AS pxi, lag({lj}, {lag}) OVER w AS pxj FROM e4 JOIN gaps USING (subject, time)
  WINDOW w AS (PARTITION BY i, j, e4.subject ORDER BY e4.time)),
rows AS (SELECT j AS "from", i AS "to", subject, time, (x - lx) / dt AS y, pxi AS xi, pxj AS xj FROM lagged WHERE dt IS NOT NULL AND lx IS NOT NULL AND nz_j >= {o.nz_partner_min_frac}
  UNION ALL SELECT i, j, subject, time, (y - ly) / dt, pxj, pxi FROM lagged WHERE dt IS NOT NULL AND lx IS NOT NULL AND nz_i >= {o.nz_partner_min_frac}),
{keep}"""


def inputs_sql(name: str, o: FitOptions, guard: bool = True) -> str:
    """CTE chain ending in ``inputs`` for one panel without smoothing."""
    return f"""{panel_sql(name)},
spot AS (SELECT *, row_number() OVER (PARTITION BY subject, taxon ORDER BY time) AS rn, count(*) OVER (PARTITION BY subject, taxon) AS nn FROM dense),
nz AS (SELECT subject, taxon, sum(CASE WHEN ra > 0 AND rn <= nn - {o.lag} THEN 1.0 ELSE 0.0 END) / greatest(max(nn) - {o.lag}, 1) AS nz FROM spot GROUP BY subject, taxon),
kept_cells AS (SELECT d.*, nz.nz FROM dense d JOIN nz USING (subject, taxon)),
pr0 AS (SELECT a.taxon AS i, b.taxon AS j, a.subject, a.time, a.lib, a.count / a.lib AS pi, b.count / b.lib AS pj, greatest(0.0, (a.lib - a.count - b.count) / a.lib) AS pr, a.nz AS nz_i, b.nz AS nz_j
  FROM kept_cells a JOIN kept_cells b ON a.sample = b.sample AND a.taxon < b.taxon),
{rows_from_triplet(o, guard=guard)}"""


def inputs_query(name: str, **options):
    o = FitOptions(smooth=False, **options)

    def run(spark, sf):
        panel, samples = build(spark, sf, name)
        return rounded(pair_inputs(panel, samples, smooth=False, **options), ROW_KEYS, ROW_FLOATS)

    return run, rounded_sql(inputs_sql(name, o), "inputs", ROW_KEYS, ROW_FLOATS)


def across_inputs_query():
    """Two panels on shared samples, mixed three to one."""
    o = FitOptions(smooth=False)

    def run(spark, sf):
        a, sa = build(spark, sf, "type")
        b, _ = build(spark, sf, "priority")
        return rounded(pair_inputs_across(a, b, sa, mix=(3, 1), smooth=False), ROW_KEYS, ROW_FLOATS)

    def side(tag, label):
        return f"""spot{tag} AS (SELECT d.*, '{label}|' || d.taxon AS name, row_number() OVER (PARTITION BY d.subject, d.taxon ORDER BY d.time) AS rn, count(*) OVER (PARTITION BY d.subject, d.taxon) AS nn FROM dense{tag} d WHERE d.sample IN (SELECT sample FROM both_s)),
nz{tag} AS (SELECT subject, taxon, sum(CASE WHEN ra > 0 AND rn < nn THEN 1.0 ELSE 0.0 END) / greatest(max(nn) - 1, 1) AS nz FROM spot{tag} GROUP BY subject, taxon),
part{tag} AS (SELECT s.*, n.nz FROM spot{tag} s JOIN nz{tag} n ON n.subject = s.subject AND n.taxon = s.taxon)"""

    ctes = f"""{panel_sql('type', '_a')},
{panel_sql('priority', '_b')},
both_s AS (SELECT sample FROM samples_a INTERSECT SELECT sample FROM samples_b),
{side('_a', 'k1')},
{side('_b', 'k2')},
pr0 AS (SELECT a.name AS i, b.name AS j, a.subject, a.time, a.lib, 0.75 * a.count / a.lib AS pi, 0.25 * b.count / b.lib AS pj,
  greatest(0.0, 0.75 * (a.lib - a.count) / a.lib + 0.25 * (b.lib - b.count) / b.lib) AS pr, a.nz AS nz_i, b.nz AS nz_j FROM part_a a JOIN part_b b ON a.sample = b.sample),
{rows_from_triplet(o)}"""
    return run, rounded_sql(ctes, "inputs", ROW_KEYS, ROW_FLOATS)


PLAIN = FitOptions(smooth=False)


def plain_inputs(spark, sf):
    panel, samples = build(spark, sf, "events")
    return pair_inputs(panel, samples, smooth=False)


def scale_subject():
    def run(spark, sf):
        return rounded(I.zscore(plain_inputs(spark, sf), ["from", "to", "subject"], ["xi", "xj", "y"], 1.5), ROW_KEYS, ROW_FLOATS)

    w = 'OVER (PARTITION BY "from", "to", subject)'
    z = 'greatest(-1.5, least(1.5, ({c} - avg({c}) {w}) / (CASE WHEN stddev_samp({c}) {w} > 0 THEN stddev_samp({c}) {w} ELSE 1.0 END))) AS {c}'
    ctes = f"""{inputs_sql('events', PLAIN)},
z AS (SELECT "from", "to", subject, time, {z.format(c='y', w=w)}, {z.format(c='xi', w=w)}, {z.format(c='xj', w=w)} FROM inputs)"""
    return run, rounded_sql(ctes, "z", ROW_KEYS, ROW_FLOATS)


def fixed_splits(rows):
    """Folds 1 to 5 from the subject number (subjects of this panel are 0 to 9)."""
    return rows.select("subject").distinct().select(
        F.lit(1).alias("rep"), (F.col("subject").cast("int") % 5 + 1).alias("fold"), "subject")


def scale_global():
    def run(spark, sf):
        rows = plain_inputs(spark, sf)
        scales = I.scale_table(rows, ["from", "to"])
        return rounded(I.apply_scale(rows, scales, ["from", "to"]), ROW_KEYS, ROW_FLOATS)

    ctes = f"""{inputs_sql('events', PLAIN)},
sc AS (SELECT "from", "to", avg(xi) AS mi, stddev_samp(xi) AS si, avg(xj) AS mj, stddev_samp(xj) AS sj, avg(y) AS my, stddev_samp(y) AS sy FROM inputs GROUP BY "from", "to"),
z AS (SELECT "from", "to", subject, time, (y - my) / sy AS y, (xi - mi) / si AS xi, (xj - mj) / sj AS xj FROM inputs JOIN sc USING ("from", "to"))"""
    return run, rounded_sql(ctes, "z", ROW_KEYS, ROW_FLOATS)


def scale_train():
    """Held-out rows of fold 2 under the means and sds of the training rows."""
    def run(spark, sf):
        rows = plain_inputs(spark, sf)
        train, test = K.train_test(rows, fixed_splits(rows), 1, 2)
        return rounded(I.apply_scale(test, I.scale_table(train, ["from", "to"]), ["from", "to"]), ROW_KEYS, ROW_FLOATS)

    ctes = f"""{inputs_sql('events', PLAIN)},
sc AS (SELECT "from", "to", avg(xi) AS mi, stddev_samp(xi) AS si, avg(xj) AS mj, stddev_samp(xj) AS sj, avg(y) AS my, stddev_samp(y) AS sy FROM inputs WHERE CAST(subject AS INT) % 5 <> 1 GROUP BY "from", "to"),
z AS (SELECT "from", "to", subject, time, (y - my) / sy AS y, (xi - mi) / si AS xi, (xj - mj) / sj AS xj FROM inputs JOIN sc USING ("from", "to") WHERE CAST(subject AS INT) % 5 = 1)"""
    return run, rounded_sql(ctes, "z", ROW_KEYS, ROW_FLOATS)


def fold_status_query():
    keys = ["from", "to", "rep", "fold", "n_train", "n_test", "fold_status"]

    def run(spark, sf):
        panel, samples = build(spark, sf, "users")
        rows = pair_inputs(panel, samples, smooth=False)
        splits = samples.select("subject").distinct().select(
            F.lit(1).cast("bigint").alias("rep"), (F.col("subject").cast("bigint") % 7 + 1).alias("fold"), "subject")
        out = K.fold_status(rows, splits)
        return out.select("from", "to", "rep", "fold", F.col("n_train").cast("bigint"), F.col("n_test").cast("bigint"), "fold_status")

    ctes = f"""{inputs_sql('users', PLAIN)},
tot AS (SELECT "from", "to", count(*) AS n FROM inputs GROUP BY "from", "to"),
held AS (SELECT "from", "to", CAST(subject AS BIGINT) % 7 + 1 AS fold, count(*) AS h FROM inputs GROUP BY ALL),
folds AS (SELECT DISTINCT CAST(subject AS BIGINT) % 7 + 1 AS fold FROM samples),
st AS (SELECT t."from", t."to", CAST(1 AS BIGINT) AS rep, f.fold, CAST(n - coalesce(h, 0) AS BIGINT) AS n_train, CAST(coalesce(h, 0) AS BIGINT) AS n_test,
  CASE WHEN coalesce(h, 0) = 0 THEN 'empty_test' WHEN n = h THEN 'empty_train' WHEN n - h < 4 THEN 'short_train' ELSE 'ok' END AS fold_status
  FROM tot t CROSS JOIN folds f LEFT JOIN held USING ("from", "to", fold))"""
    return run, rounded_sql(ctes, "st", keys, [])


def split_check():
    """Each subject is held out once per repeat and fold sizes differ by at most one."""
    def run(spark, sf):
        _, samples = build(spark, sf, "users")
        sizes = K.kfold_splits(samples, 5, 3).groupBy("rep", "fold").agg(F.count("*").alias("n"), F.count_distinct("subject").alias("u"))
        return sizes.groupBy("rep").agg(F.sum("n").cast("bigint").alias("subjects"), F.sum("u").cast("bigint").alias("distinct_subjects"),
                                        (F.max("n") - F.min("n") <= 1).alias("balanced")).select(
            F.col("rep").cast("bigint").alias("rep"), "subjects", "distinct_subjects", "balanced")

    return run, "SELECT r.rep, count(DISTINCT user_id) AS subjects, count(DISTINCT user_id) AS distinct_subjects, true AS balanced FROM events CROSS JOIN (SELECT unnest(range(1, 4)) AS rep) r GROUP BY r.rep"


def held_out_query():
    def run(spark, sf):
        _, samples = build(spark, sf, "users")
        return K.held_out_counts(K.kfold_splits(samples, 4, 2)).select("subject", F.col("n_test").cast("bigint").alias("n_test"))

    return run, "SELECT DISTINCT CAST(user_id AS VARCHAR) AS subject, CAST(2 AS BIGINT) AS n_test FROM events"


def link_query():
    keys, floats = ["subject", "row", "prev"], ["time", "dt"]

    def run(spark, sf):
        _, samples = build(spark, sf, "users")
        out = X.previous_link(samples, ["subject"])
        return rounded(out.withColumns({"row": F.col("row").cast("bigint"), "prev": F.col("prev").cast("bigint")}), keys, floats)

    ctes = f"""{panel_sql('users')}, l AS (SELECT subject, time, row_number() OVER w AS row, row_number() OVER w - 1 AS prev,
  CASE WHEN row_number() OVER w = 1 THEN 0.0 WHEN time - lag(time) OVER w > 0 THEN time - lag(time) OVER w ELSE 1e-6 END AS dt FROM samples WINDOW w AS (PARTITION BY subject ORDER BY time))"""
    return run, rounded_sql(ctes, "l", keys, floats)


def unit_query():
    def run(spark, sf):
        _, samples = build(spark, sf, "users")
        return rounded(X.time_unit(X.previous_link(samples, ["subject"]), ["subject"]), ["subject"], ["unit"])

    ctes = f"""{panel_sql('users')}, l AS (SELECT subject, time - lag(time) OVER (PARTITION BY subject ORDER BY time) AS dt FROM samples),
u AS (SELECT subject, coalesce(avg(CASE WHEN dt > 0 THEN dt END), 1.0) AS unit FROM l GROUP BY subject)"""
    return run, rounded_sql(ctes, "u", ["subject"], ["unit"])


def interval_query():
    def run(spark, sf):
        _, samples = build(spark, sf, "brand")
        return rounded(X.next_interval(samples), ["subject"], ["time", "next_time", "dt"])

    ctes = f"""{panel_sql('brand')}, l AS (SELECT subject, time, lead(time) OVER (PARTITION BY subject ORDER BY time) AS next_time FROM samples),
u AS (SELECT *, next_time - time AS dt FROM l WHERE next_time IS NOT NULL AND next_time - time > 1e-8)"""
    return run, rounded_sql(ctes, "u", ["subject"], ["time", "next_time", "dt"])


def fit_query(name, table, columns, keys, **options):
    def run(spark, sf):
        panel, samples = build(spark, sf, name)
        return rounded(fit_pairs(panel, samples, **options)[table], keys, columns)

    return run, None


EDGE_VALUES = ["a_mean", "a_sd", "a_q2_5", "a_q97_5", "p_sign2", "a_self_mean", "phi_mean", "sigma_pred_mean", "grid_edge_mass"]


def across_fit():
    def run(spark, sf):
        a, sa = build(spark, sf, "type")
        b, _ = build(spark, sf, "priority")
        out = fit_pairs_across(a, b, sa, mix=(5, 5))
        return rounded(out["edges"], ["from", "to", "from_panel", "to_panel", "n_rows"], ["a_mean", "p_sign2", "elpd_mean"])

    return run, None


def ranked(which):
    def run(spark, sf):
        panel, samples = build(spark, sf, "type")
        bundle = fit_pairs(panel, samples, smooth=False)
        out = rank_edges(bundle, alpha=0.05, which=which)
        keys = ["from", "to"] if which == "cross" else ["pair_i", "pair_j", "taxon"]
        mean = "a_mean" if which == "cross" else "a_self_mean"
        return rounded(out, [*keys, "sign", "diag_ok", "pass_bayes_fdr"], [mean, "bayes_fdr", "w_pseudobma", "w_pseudobma_plus", "w_stacking"])

    return run, None


def smooth_query():
    """Smoothed shares of every (nation, brand) series."""
    def run(spark, sf):
        panel, samples = build(spark, sf, "brand")
        cells = S.with_library(S.join_samples(panel, samples))
        out = smooth.smooth_shares(cells, ["subject", "taxon"], "time", "ra")
        return rounded(out, ["subject", "taxon", "sample"], ["ra_s", "edf"])

    return run, None


def hook_query():
    """A builder hook that drops the first half of every series."""
    def later(rows):
        return rows.filter(F.col("pos") >= 14)

    def run(spark, sf):
        panel, samples = build(spark, sf, "type")
        out = fit_pairs(panel, samples, builder=later, smooth=False, compute_elpd=False)
        return out["edges"].select("from", "to", "n_rows")

    o = FitOptions(smooth=False)
    ctes = f"""{inputs_sql('type', o, guard=False)},
firsts AS (SELECT subject, time, row_number() OVER (PARTITION BY subject ORDER BY time) - 1 AS pos FROM samples),
c AS (SELECT "from", "to", count(*) AS n_rows FROM inputs JOIN firsts USING (subject, time) WHERE pos >= 14 GROUP BY "from", "to")"""
    return run, rounded_sql(ctes, "c", ["from", "to", "n_rows"], [])


def pointwise_query():
    def run(spark, sf):
        panel, samples = build(spark, sf, "events")
        out = fit_pairs(panel, samples, smooth=False)["pointwise"]
        again = summary.unnest_scores(summary.nest_scores(out))
        return rounded(again, ["from", "to", "subject", "n_obs", "n_test", "elpd_method"], ["elpd", "elpd_ppd"])

    return run, None


def folds_query():
    def run(spark, sf):
        panel, samples = build(spark, sf, "events")
        out = fit_pairs(panel, samples, smooth=False)["folds"]
        return rounded(out, ["from", "to", "rep", "fold", "n_train", "n_test", "fold_ok"], ["grid_edge_mass"])

    return run, None


QUERIES = {
    "inputs_default": inputs_query("events"),
    "inputs_users_sparse": inputs_query("users"),
    "inputs_library_zero": inputs_query("users", zero_mode="lib", min_pairs=12),
    "inputs_subject_zero_triplet": inputs_query("users", zero_mode="minpos_subject", minpos_base="triplet"),
    "inputs_fixed_zero_capped": inputs_query("users", zero_mode="fixed", cap_mode="fixed", alr_cap=3.0),
    "inputs_dynamic_cap": inputs_query("users", cap_mode="dynamic", alr_cap=8.0),
    "inputs_raw_lag2": inputs_query("brand", transform="raw", lag=2),
    "inputs_two_panels": across_inputs_query(),
    "scale_by_subject": scale_subject(),
    "scale_global": scale_global(),
    "scale_train_on_test": scale_train(),
    "fold_status": fold_status_query(),
    "fold_balance": split_check(),
    "held_out_counts": held_out_query(),
    "previous_link": link_query(),
    "time_unit": unit_query(),
    "next_interval": interval_query(),
    "builder_hook": hook_query(),
    "fit_edges_smoothed": fit_query("type", "edges", EDGE_VALUES + ["elpd_mean", "elpd_sd", "elpd_se"], ["from", "to", "n_rows", "n_subjects", "folds_ok"]),
    "fit_edges_brand": fit_query("brand", "edges", EDGE_VALUES + ["elpd_mean", "elpd_sd", "elpd_se"], ["from", "to", "n_rows", "n_subjects", "folds_ok"]),
    "fit_edges_brand_no_folds": fit_query("brand", "edges", EDGE_VALUES, ["from", "to", "n_rows"], compute_elpd=False),
    "fit_edges_white_noise": fit_query("type", "edges", EDGE_VALUES, ["from", "to", "n_rows"], resid_mode="wn", smooth=False, compute_elpd=False),
    "fit_edges_subject_scaled": fit_query("events", "edges", EDGE_VALUES, ["from", "to", "n_rows"], smooth=False, compute_elpd=False),
    "fit_edges_smooth_log_ratio": fit_query("events", "edges", EDGE_VALUES, ["from", "to", "n_rows"], smooth_scale="alr", compute_elpd=False),
    "fit_pairs_wide": fit_query("events", "pairs", ["a_mean_ij", "a_mean_ji", "p_sign2_ij", "p_sign2_ji"], ["i", "j"], smooth=False, use_student_t=False),
    "fit_self_effects": fit_query("events", "self_effects", ["a_self_mean", "a_self_sd", "p_sign2_self"], ["pair_i", "pair_j", "taxon"], smooth=False),
    "fit_pointwise": pointwise_query(),
    "fit_folds": folds_query(),
    "fit_two_panels": across_fit(),
    "smooth_shares": smooth_query(),
    "rank_cross": ranked("cross"),
    "rank_self": ranked("self"),
}
