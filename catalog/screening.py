"""Screen queries and the SQL that rebuilds each step from its formula."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.panels import build, panel_sql, rounded, rounded_sql
from simplexflow.operators import multitest, pooling
from simplexflow.plans.screen import ScreenOptions, screen, subject_table

SUBJECT_KEYS = ["i", "j", "subject", "n", "floor_hits", "cap_hits"]
SUBJECT_FLOATS = ["r", "n_eff", "cozero_frac", "z", "v"]


def subject_sql(name: str, o: ScreenOptions) -> str:
    """CTE chain ending in ``subj``: one row per (pair, subject)."""
    low_pair = "least(a.low, b.low)"
    rest_low = ""
    if o.zero_minpos_base == "triplet":
        rest_low = ", min(CASE WHEN greatest(0.0, (a.lib - a.count - b.count) / a.lib) > 0 THEN greatest(0.0, (a.lib - a.count - b.count) / a.lib) END) OVER (PARTITION BY a.taxon, b.taxon, a.subject) AS rest_low"
    series_low = "low" if not rest_low else "least(low, rest_low)"
    parts = "CASE WHEN pi > 0 THEN pi END, CASE WHEN pj > 0 THEN pj END"
    if o.zero_minpos_base == "triplet":
        parts += ", CASE WHEN pr > 0 THEN pr END"
    eps = {
        "minpos_subject": f"coalesce({o.zero_minpos_alpha} * {series_low}, 1e-8)",
        "minpos_time": f"coalesce({o.zero_minpos_alpha} * least({parts}), 1e-8)",
        "lib": f"greatest({o.zero_lib_pseudo} / greatest(lib, 1.0), 1e-12)",
    }[o.zero_mode]
    cap = {"dynamic": f"least({o.cap_value}, greatest(0.0, CASE WHEN eps_s < 0.5 THEN ln((1 - 2 * eps_s) / eps_s) ELSE 0.0 END))",
           "fixed": f"{o.cap_value}", "none": "1e300"}[o.cap_mode]
    touching = ""
    ctes = f"""{panel_sql(name)},
members AS (SELECT subject, taxon, min(CASE WHEN ra > 0 THEN ra END) AS low FROM dense GROUP BY subject, taxon
  HAVING count(*) >= {o.min_n} AND var_samp(ra) >= 1e-16 AND avg(CASE WHEN ra > 0 THEN 1.0 ELSE 0.0 END) >= {o.nz_partner_min_frac}),
kept_cells AS (SELECT d.*, m.low FROM dense d JOIN members m ON d.subject = m.subject AND d.taxon = m.taxon),
pr0 AS (SELECT a.taxon AS i, b.taxon AS j, a.subject, a.time, a.lib, a.count AS ci, b.count AS cj, {low_pair} AS low,
  a.count / a.lib AS pi, b.count / b.lib AS pj, greatest(0.0, (a.lib - a.count - b.count) / a.lib) AS pr{rest_low}
  FROM kept_cells a JOIN kept_cells b ON a.sample = b.sample AND a.taxon < b.taxon{touching}),
"""
    if o.transform == "alr":
        ctes += f"""pr1 AS (SELECT *, {eps} AS eps, pr AS rest FROM pr0),
pr2 AS (SELECT i, j, subject, time, ci, cj, rest, eps, CASE WHEN pi <= 0 THEN eps ELSE pi END AS pi, CASE WHEN pj <= 0 THEN eps ELSE pj END AS pj, CASE WHEN pr <= 0 THEN eps ELSE pr END AS pr FROM pr1),
pr3 AS (SELECT i, j, subject, time, ci, cj, rest, pi / (pi + pj + pr) AS pi, pj / (pi + pj + pr) AS pj, pr / (pi + pj + pr) AS pr, eps / (pi + pj + pr) AS eps_s FROM pr2),
pr4 AS (SELECT *, {o.rest_floor_frac} * eps_s AS fl FROM pr3),
pr5 AS (SELECT i, j, subject, time, ci, cj, rest, eps_s, CASE WHEN pr < fl THEN 1 ELSE 0 END AS floor_hit,
  CASE WHEN pr < fl THEN pi * (1 - fl) / (pi + pj) ELSE pi END AS pi, CASE WHEN pr < fl THEN pj * (1 - fl) / (pi + pj) ELSE pj END AS pj, greatest(pr, fl) AS pr FROM pr4),
pr6 AS (SELECT *, ln(pi) - ln(pr) AS x0, ln(pj) - ln(pr) AS y0, {cap} AS cap FROM pr5),
pr7 AS (SELECT *, CAST(abs(x0) > cap + 1e-9 AS INT) + CAST(abs(y0) > cap + 1e-9 AS INT) AS cap_hit, greatest(-cap, least(cap, x0)) AS x1, greatest(-cap, least(cap, y0)) AS y1 FROM pr6),
"""
    else:
        ctes += "pr7 AS (SELECT *, pr AS rest, 0 AS floor_hit, 0 AS cap_hit, pi AS x1, pj AS y1 FROM pr0),\n"
    if o.detrend:
        w = "OVER (PARTITION BY i, j, subject)"
        ctes += f"pr8 AS (SELECT *, x1 - regr_intercept(x1, time) {w} - regr_slope(x1, time) {w} * time AS x, y1 - regr_intercept(y1, time) {w} - regr_slope(y1, time) {w} * time AS y FROM pr7),\n"
    else:
        ctes += "pr8 AS (SELECT *, x1 AS x, y1 AS y FROM pr7),\n"
    ranked = o.method == "spearman" or (o.partial_rest and o.partial_method == "matrix")
    def rank(c):
        return f"rank() OVER (PARTITION BY i, j, subject ORDER BY round({c}, 9)) + (count(*) OVER (PARTITION BY i, j, subject, round({c}, 9)) - 1) / 2.0"
    u, v, s = ("rx", "ry", "rz") if ranked else ("x", "y", "rest")
    ctes += f"rk AS (SELECT *, row_number() OVER (PARTITION BY i, j, subject ORDER BY time) AS rn, {rank('x')} AS rx, {rank('y')} AS ry, {rank('rest')} AS rz FROM pr8),\n"
    # The series whose autocorrelation counts: ranks under Spearman, and residuals given the rest.
    eu, ev, es = ("rx", "ry", "rz") if o.method == "spearman" else ("x", "y", "rest")
    held = o.partial_rest and o.transform == "raw" and not (o.method == "spearman" and o.partial_method == "matrix")
    def residual(c):
        w = "OVER (PARTITION BY i, j, subject)"
        line = f"{c} - regr_intercept({c}, {es}) {w} - regr_slope({c}, {es}) {w} * {es}"
        return f"CASE WHEN var_samp(rest) {w} >= 1e-12 AND count(*) {w} >= 3 THEN coalesce({line}, {c}) ELSE {c} END" if held else c
    ctes += f"rs AS (SELECT *, {residual(eu)} AS ex, {residual(ev)} AS ey FROM rk),\n"
    corr = "CASE WHEN var_pop({a}) > 0 AND var_pop({b}) > 0 THEN greatest(-1.0, least(1.0, covar_pop({a}, {b}) / sqrt(var_pop({a}) * var_pop({b})))) END"
    plain = corr.format(a=u, b=v)
    ctes += f"""base AS (SELECT i, j, subject, count(*) AS n, avg(ex) AS mx, avg(ey) AS my, {plain} AS rxy, {corr.format(a=u, b=s)} AS rxz, {corr.format(a=v, b=s)} AS ryz, var_samp(rest) AS vr,
  sum(ex * ex) - count(*) * avg(ex) * avg(ex) AS c0x, sum(ey * ey) - count(*) * avg(ey) * avg(ey) AS c0y,
  avg(CASE WHEN ci = 0 AND cj = 0 THEN 1.0 ELSE 0.0 END) AS cozero_frac, sum(floor_hit) AS floor_hits, sum(cap_hit) AS cap_hits FROM rs GROUP BY i, j, subject HAVING count(*) >= {o.min_n}),
"""
    bound = {"nw": "greatest(1, floor(4 * pow(n / 100.0, 2.0 / 9.0)))", "bartlett": "floor(sqrt(n))", "ar1": "1"}[o.effn_method]
    ctes += f"""acv AS (SELECT a.i, a.j, a.subject, k.k, sum((a.ex - b.mx) * (c.ex - b.mx)) AS cx, sum((a.ey - b.my) * (c.ey - b.my)) AS cy FROM rs a
  JOIN base b ON a.i = b.i AND a.j = b.j AND a.subject = b.subject JOIN (SELECT unnest(range(1, 40)) AS k) k ON k.k <= {bound.replace('n', 'b.n') if o.effn_method != 'ar1' else 1}
  JOIN rs c ON c.i = a.i AND c.j = a.j AND c.subject = a.subject AND c.rn = a.rn + k.k GROUP BY a.i, a.j, a.subject, k.k),
rho AS (SELECT a.i, a.j, a.subject, a.k, b.n, CASE WHEN c0x > 0 THEN greatest(-0.99, least(0.99, cx / c0x)) ELSE 0.0 END AS px, CASE WHEN c0y > 0 THEN greatest(-0.99, least(0.99, cy / c0y)) ELSE 0.0 END AS py
  FROM acv a JOIN base b ON a.i = b.i AND a.j = b.j AND a.subject = b.subject),
"""
    bound = bound.replace("floor", "FLOOR")
    if o.effn_method == "ar1":
        limit = min(o.effn_phi_cap, 0.95)
        raw = f"max(n * (1 - greatest(-{limit}, least({limit}, px * py))) / (1 + greatest(-{limit}, least({limit}, px * py))))"
    else:
        raw = f"max(n) / greatest(1e-6, 1 + 2 * sum((1 - k / ({bound} + 1.0)) * px * py))"
    ctes += f"""neff AS (SELECT i, j, subject, CASE WHEN max(n) >= 5 THEN greatest(4.0, least(max(n), {raw})) END AS raw FROM rho GROUP BY i, j, subject),
"""
    r = "rxy"
    if o.partial_rest and o.transform == "raw":
        floor = "1e-12" if o.partial_method == "matrix" else "1e-300"
        r = f"CASE WHEN vr >= 1e-12 AND b.n >= 3 THEN greatest(-1.0, least(1.0, (rxy - rxz * ryz) / sqrt(greatest(1 - rxz * rxz, {floor}) * greatest(1 - ryz * ryz, {floor})))) ELSE rxy END"
    n_eff = "CAST(b.n AS DOUBLE)"
    if o.acf_correction:
        mixed = f"coalesce({o.effn_blend} * raw + {1 - o.effn_blend} * b.n, b.n)"
        n_eff = f"greatest(3.0, floor(greatest({mixed}, {o.effn_min_frac} * b.n)))"
    label = pooling.variance_label(o.var_method, o.method)
    top = {"fisherz": "1.0", "bonett": "1 + r * r / 2", "fhp": "1.06"}[label]
    keep = f" WHERE cozero_frac < {o.cozero_tol}" if o.cozero_check and o.cozero_action == "exclude" else ""
    ctes += f"""s0 AS (SELECT b.i, b.j, b.subject, CAST(b.n AS BIGINT) AS n, {r} AS r, {n_eff} AS n_eff, cozero_frac, CAST(floor_hits AS BIGINT) AS floor_hits, CAST(cap_hits AS BIGINT) AS cap_hits
  FROM base b LEFT JOIN neff e ON b.i = e.i AND b.j = e.j AND b.subject = e.subject),
subj AS (SELECT *, atanh(greatest(-1 + 1e-12, least(1 - 1e-12, r))) AS z, CASE WHEN n_eff > 3 AND r IS NOT NULL THEN ({top}) / (n_eff - 3) END AS v FROM s0{keep})"""
    return ctes


T_P = """CASE WHEN df % 2 = 1 THEN 1 - 2 / pi() * (th + CASE WHEN df > 1 THEN sin(th) * cos(th) * list_sum(list_transform(range(0, CAST((df - 1) / 2 AS BIGINT)), lambda q: exp(lgamma(q + 1.0) - lgamma(q + 1.5)) * sqrt(pi()) / 2 * pow(cos(th), 2 * q))) ELSE 0 END)
 ELSE 1 - sin(th) * list_sum(list_transform(range(0, CAST(df / 2 AS BIGINT)), lambda q: exp(lgamma(q + 0.5) - lgamma(q + 1.0)) / sqrt(pi()) * pow(cos(th), 2 * q))) END"""


def _reml_sql() -> str:
    """Fisher scoring of the restricted likelihood over lists of effects: 400 steps from the moment estimate."""
    w = "(1 / (vs[q] + t))"
    total = lambda term: f"list_sum(list_transform(range(1, len(vs) + 1), lambda q: {term}))"
    a, c, d = total(w), total(f"{w} * {w}"), total(f"{w} * {w} * {w}")
    mu = f"({total(f'{w} * zs[q]')} / {a})"
    excess = f"({total(f'{w} * {w} * zs[q] * zs[q]')} - 2 * {mu} * {total(f'{w} * {w} * zs[q]')} + {mu} * {mu} * {c} - ({a} - {c} / {a}))"
    step = f"greatest(0.0, t + {excess} / ({c} - 2 * {d} / {a} + ({c} / {a}) * ({c} / {a})))"
    return f"""SELECT i, j, list_reduce(list_concat([t0], list_transform(range(400), lambda s: 0.0::DOUBLE)), lambda t, s: {step}) AS t2 FROM (
  SELECT i, j, list(v ORDER BY v, z) AS vs, list(z ORDER BY v, z) AS zs, greatest(0.0, var_samp(z) - avg(v)) AS t0 FROM ok GROUP BY i, j HAVING count(*) >= 2)"""


REML_SQL = _reml_sql()


def pooled_sql(o: ScreenOptions) -> str:
    """CTEs from ``subj`` to ``pooled``: DerSimonian-Laird with the Knapp-Hartung interval."""
    tau2 = "CASE WHEN c > 0 THEN greatest(0.0, (q - (k - 1)) / c) ELSE 0.0 END"
    if o.meta_method == "REML":
        tau2 = f"(SELECT t2 FROM ({REML_SQL}) r WHERE r.i = d2.i AND r.j = d2.j)"
    return f"""ok AS (SELECT i, j, z, v, 1 / v AS w FROM subj WHERE z IS NOT NULL AND v IS NOT NULL),
d1 AS (SELECT i, j, count(*) AS k, sum(w) AS sw, sum(w * w) AS sww, sum(w * z) / sum(w) AS mu0 FROM ok GROUP BY i, j),
d2 AS (SELECT ok.i, ok.j, max(k) AS k, max(sw) AS sw, max(sw - sww / sw) AS c, sum(w * (z - mu0) * (z - mu0)) AS q FROM ok JOIN d1 ON ok.i = d1.i AND ok.j = d1.j GROUP BY ok.i, ok.j),
d3 AS (SELECT *, {tau2} AS t2 FROM d2),
d4 AS (SELECT ok.i, ok.j, sum(1 / (v + t2)) AS sws, sum(z / (v + t2)) / sum(1 / (v + t2)) AS mu FROM ok JOIN d3 ON ok.i = d3.i AND ok.j = d3.j GROUP BY ok.i, ok.j),
d5 AS (SELECT ok.i, ok.j, sum((z - mu) * (z - mu) / (v + t2)) AS ss FROM ok JOIN d3 ON ok.i = d3.i AND ok.j = d3.j JOIN d4 ON ok.i = d4.i AND ok.j = d4.j GROUP BY ok.i, ok.j),
d6 AS (SELECT d3.i, d3.j, CAST(k AS BIGINT) AS k, mu AS z_pooled, {"sqrt(ss / ((k - 1) * sws))" if o.use_knha else "sqrt(1 / sws)"} AS se, tanh(mu) AS r_pooled, t2 AS tau2,
  100 * t2 / ((k - 1) / c + t2) AS i2, q AS q_stat FROM d3 JOIN d4 ON d3.i = d4.i AND d3.j = d4.j JOIN d5 ON d3.i = d5.i AND d3.j = d5.j WHERE k >= {o.min_k}),
pooled AS (SELECT *, {T_P} AS p FROM (SELECT *, k - 1 AS df, atan(abs(z_pooled / se) / sqrt(k - 1)) AS th FROM d6))"""


def meta_sql(name: str, o: ScreenOptions) -> str:
    """CTEs up to ``meta``: pooled rows of all pairs with length columns and q values."""
    weight = {"k": "k", "n_median": "n_median", "n_effin_median": "n_effin_median", "none": "1.0"}[o.q_weight_by]
    weighted = o.q_method.startswith("w")
    used = f"least(1.0, p / (({weight}) / avg({weight}) OVER ()))" if weighted else "p"
    factor = {"BY": "(SELECT sum(1.0 / k) FROM range(1, CAST((SELECT count(p) FROM m0) AS BIGINT) + 1) t(k))"}.get(o.q_method, "1.0")
    if o.q_method in ("qvalue", "wqvalue"):
        terms = " + ".join(f"({c!r}) * avg(CASE WHEN pw >= {lam} THEN 1.0 ELSE 0.0 END) / {1 - lam!r}" for c, lam in zip(multitest.smoother_row(), multitest.LAMBDAS))
        factor = f"(SELECT CASE WHEN v > 0 THEN least(v, 1.0) ELSE 1.0 END FROM (SELECT {terms} AS v FROM m1 WHERE pw IS NOT NULL))"
    return f"""{subject_sql(name, o)},
{pooled_sql(o)},
lens AS (SELECT i, j, min(n)::DOUBLE AS n_min, median(n)::DOUBLE AS n_median, max(n)::DOUBLE AS n_max, min(n_eff) AS n_effin_min, median(n_eff) AS n_effin_median, max(n_eff) AS n_effin_max,
  median(cozero_frac) AS cozero_median, max(cozero_frac) AS cozero_max, avg(CASE WHEN cozero_frac >= {o.cozero_tol} THEN 1.0 ELSE 0.0 END) >= {o.cozero_min_subject_frac} AS cozero_flag,
  CAST(sum(floor_hits) AS BIGINT) AS floor_hits, CAST(sum(cap_hits) AS BIGINT) AS cap_hits, CAST(sum(CASE WHEN z IS NULL OR v IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped FROM subj GROUP BY i, j),
kk AS (SELECT i, j, count(*) FILTER (WHERE z IS NOT NULL AND v IS NOT NULL) AS k0 FROM subj GROUP BY i, j),
m0 AS (SELECT a.taxon AS i, b.taxon AS j, coalesce(k0, 0) AS k, z_pooled, se, r_pooled, tau2, i2, q_stat, p, lens.* EXCLUDE (i, j) FROM taxa a JOIN taxa b ON a.taxon < b.taxon
  LEFT JOIN pooled ON pooled.i = a.taxon AND pooled.j = b.taxon LEFT JOIN lens ON lens.i = a.taxon AND lens.j = b.taxon LEFT JOIN kk ON kk.i = a.taxon AND kk.j = b.taxon),
m1 AS (SELECT *, {used} AS pw FROM m0),
m2 AS (SELECT *, CASE WHEN pw IS NOT NULL THEN {factor} * pw * count(pw) OVER () / count(pw) OVER (ORDER BY pw RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS q0 FROM m1),
meta AS (SELECT *, CASE WHEN pw IS NOT NULL THEN least(1.0, min(q0) OVER (ORDER BY pw RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS q FROM m2)"""


META_KEYS = ["i", "j", "k", "floor_hits", "cap_hits", "n_dropped"]
META_FLOATS = ["z_pooled", "se", "r_pooled", "tau2", "i2", "q_stat", "p", "q", "n_min", "n_median", "n_max", "n_effin_min",
               "n_effin_median", "n_effin_max", "cozero_median", "cozero_max"]


def meta_query(name: str, **options):
    o = ScreenOptions(**options, all_columns=True)

    def run(spark, sf):
        panel, samples = build(spark, sf, name)
        return rounded(screen(panel, samples, **options, all_columns=True)["meta"], META_KEYS, META_FLOATS)

    sql = rounded_sql(meta_sql(name, o), "meta", META_KEYS, META_FLOATS)
    return run, sql


def subject_query(name: str, **options):
    o = ScreenOptions(**options)

    def run(spark, sf):
        panel, samples = build(spark, sf, name)
        return rounded(subject_table(panel, samples, o=o), SUBJECT_KEYS, SUBJECT_FLOATS)

    return run, rounded_sql(subject_sql(name, o), "subj", SUBJECT_KEYS, SUBJECT_FLOATS)


def filtered_query():
    """q values over all pairs first, then the filters on k and r."""
    def run(spark, sf):
        panel, samples = build(spark, sf, "events")
        meta = screen(panel, samples, k_filter=5, r_abs_min=0.2)["meta"]
        return rounded(meta, ["i", "j", "k"], ["r_pooled", "p", "q"])

    base = meta_sql("events", ScreenOptions())
    return run, rounded_sql(base, "meta WHERE k >= 5 AND abs(r_pooled) >= 0.2", ["i", "j", "k"], ["r_pooled", "p", "q"])


def cozero_query():
    """Pair-level co-zero flag on a sparse panel, co-zero subjects kept."""
    o = ScreenOptions(cozero_check=True, cozero_action="flag", cozero_tol=0.3, all_columns=True)
    keys = ["i", "j", "k", "cozero_flag"]

    def run(spark, sf):
        panel, samples = build(spark, sf, "users")
        meta = screen(panel, samples, cozero_check=True, cozero_action="flag", cozero_tol=0.3, all_columns=True)["meta"]
        return rounded(meta, keys, ["cozero_median", "cozero_max"])

    return run, rounded_sql(meta_sql("users", o), "meta", keys, ["cozero_median", "cozero_max"])


def interesting_query():
    """Pairs touching one part (the most frequent event type), scored as usual."""
    def run(spark, sf):
        panel, samples = build(spark, sf, "events")
        top = panel.groupBy("taxon").agg(F.sum("count").alias("s")).orderBy(F.desc("s"), "taxon").limit(1).select("taxon")
        meta = screen(panel, samples, interesting=top)["meta"]
        return rounded(meta, ["i", "j", "k"], ["r_pooled", "p"])

    base = meta_sql("events", ScreenOptions())
    top = "(SELECT taxon FROM panel GROUP BY taxon ORDER BY sum(count) DESC, taxon LIMIT 1)"
    return run, rounded_sql(base, f"meta WHERE i = {top} OR j = {top}", ["i", "j", "k"], ["r_pooled", "p"])


def reml_query():
    def run(spark, sf):
        panel, samples = build(spark, sf, "events")
        return rounded(screen(panel, samples, meta_method="REML")["meta"], ["i", "j", "k"], ["r_pooled", "tau2", "p", "ci_low", "ci_high", "q_stat_p"])

    return run, None


def reml_pooled_query(name: str, **options):
    o = ScreenOptions(meta_method="REML", **options)

    def run(spark, sf):
        panel, samples = build(spark, sf, name)
        return rounded(screen(panel, samples, meta_method="REML", **options)["meta"], ["i", "j", "k"], ["z_pooled", "se", "r_pooled", "tau2", "i2", "p"])

    return run, rounded_sql(meta_sql(name, o), "meta", ["i", "j", "k"], ["z_pooled", "se", "r_pooled", "tau2", "i2", "p"])


QUERIES = {
    "screen_events": meta_query("events"),
    "screen_brand": meta_query("brand"),
    "screen_users_sparse": meta_query("users", min_k=3),
    "screen_spearman_bonett": meta_query("events", method="spearman"),
    "screen_fhp_wald": meta_query("type", method="spearman", var_method="fhp"),
    "screen_raw_partial": meta_query("type", transform="raw", partial_rest=True),
    "screen_by_bartlett": meta_query("type", q_method="BY", effn_method="bartlett"),
    "screen_weighted_bh": meta_query("brand", q_method="wBH", q_weight_by="n_effin_median"),
    "screen_storey": meta_query("brand", q_method="qvalue"),
    "screen_weighted_storey": meta_query("users", q_method="wqvalue", q_weight_by="k"),
    "screen_filters_after_q": filtered_query(),
    "screen_cozero_flag": cozero_query(),
    "screen_interesting": interesting_query(),
    "screen_reml": reml_query(),
    "screen_reml_pooled": reml_pooled_query("events"),
    "screen_reml_bonett": reml_pooled_query("type", method="spearman"),
    "subject_alr_default": subject_query("users"),
    "subject_zero_time_triplet": subject_query("users", zero_mode="minpos_time", zero_minpos_base="triplet"),
    "subject_zero_subject_triplet": subject_query("users", zero_minpos_base="triplet", rest_floor_frac=2.0),
    "subject_zero_library": subject_query("users", zero_mode="lib", cap_mode="fixed", cap_value=2.0),
    "subject_no_cap": subject_query("users", cap_mode="none", rest_floor_frac=3.0),
    "subject_detrend": subject_query("events", detrend=True),
    "subject_spearman": subject_query("users", method="spearman", effn_method="ar1"),
    "subject_raw_pearson": subject_query("users", transform="raw", acf_correction=False),
    "subject_raw_partial": subject_query("users", transform="raw", partial_rest=True),
    "subject_raw_partial_ranks": subject_query("users", transform="raw", partial_rest=True, method="spearman"),
    "subject_rank_matrix_ar1": subject_query("events", transform="raw", partial_rest=True, partial_method="matrix", method="spearman", effn_method="ar1"),
    "subject_raw_partial_matrix": subject_query("users", transform="raw", partial_rest=True, partial_method="matrix"),
    "subject_cozero_exclude": subject_query("users", cozero_check=True, cozero_tol=0.4),
}
