"""Spark operators: hand-made edge cases, properties and chunk invariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplexflow.functions.scalars import clamp, finite, mix_weights, safe_corr
from simplexflow.operators import association, compose, draws, inputs, kfold, multitest, pairs, pooling, quantiles, timeaxis, weights
from simplexflow.plans.fit import fit_pairs, pair_inputs
from simplexflow.plans.rank import rank_edges
from simplexflow.plans.screen import ScreenOptions, screen, subject_table
from simplexflow.sources import panel as S


def table(df, keys):
    pdf = df.toPandas()
    return pdf.sort_values(keys).reset_index(drop=True)


def same(a, b, keys, cols, **tol):
    a, b = table(a, keys), table(b, keys)
    assert len(a) == len(b) and len(a) > 0
    for c in cols:
        assert np.allclose(a[c].astype(float), b[c].astype(float), equal_nan=True, **(tol or {"atol": 1e-9})), c


def test_finite_and_clamp(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),), (None,), (-3.0,)], "x double")
    rows = df.select(finite("x").alias("f"), clamp("x", -1.0, 1.0).alias("c")).collect()
    assert [r.f for r in rows] == [True, False, False, False, True]
    assert rows[3].c is None and rows[4].c == -1.0


def test_constant_series_has_no_correlation(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (1, 2.0, 5.0), (2, 1.0, 1.0), (2, 2.0, 2.0)], "g int, x double, y double")
    got = {r.g: r.r for r in df.groupBy("g").agg(safe_corr("x", "y").alias("r")).collect()}
    assert got[1] is None and got[2] == pytest.approx(1.0)


def test_mix_weights():
    assert mix_weights((5, 5)) == [0.5, 0.5]
    assert mix_weights(0.2) == [0.2, 0.8]
    for bad in ((0, 0), (-1, 2), (float("nan"), 1)):
        with pytest.raises(ValueError):
            mix_weights(bad)


def test_bad_counts_become_missing(spark):
    df = spark.createDataFrame([("s", "t", float("nan")), ("s", "u", float("inf")), ("s", "v", 2.0)], "a string, b string, c double")
    got = {r.taxon: r["count"] for r in S.read_panel(df, "a", "b", "c").collect()}
    assert got == {"t": None, "u": None, "v": 2.0}


def test_empty_library_counts_as_one(spark):
    df = spark.createDataFrame([("s", "t", 0.0), ("r", "t", None)], "sample string, taxon string, count double")
    rows = S.with_library(df).collect()
    assert all(r.lib == 1.0 and r.ra == 0.0 for r in rows)


def test_too_few_taxa_or_samples(spark):
    df = spark.createDataFrame([("s", "t", 1.0)], "sample string, taxon string, count double")
    with pytest.raises(ValueError):
        S.require_taxa(df, None, 2)
    with pytest.raises(ValueError):
        S.align_panels(df, df)


def test_grid_join_is_complete(spark):
    left, right = spark.range(7).withColumnRenamed("id", "a"), spark.range(9).withColumnRenamed("id", "b")
    assert S.grid_join(left, right, "b").distinct().count() == 63


def test_sliced_ranks_equal_plain_ranks(spark):
    df = spark.range(400).select((F.col("id") % 2).alias("g"), F.pmod(F.col("id") * 37, F.lit(50)).cast("double").alias("x"))
    plain = association.average_rank(df, ["g"], "x").groupBy("g", "x").agg(F.max("x_rank").alias("r"))
    sliced = association.average_rank(df, ["g"], "x", slice_rows=16).groupBy("g", "x").agg(F.max("x_rank").alias("r"))
    same(plain, sliced, ["g", "x"], ["r"])


def test_quantiles_of_a_hot_group(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 900, "hot").otherwise("cold").alias("g"), F.pmod(F.col("id") * 7919, F.lit(613)).cast("double").alias("x"))
    got = table(quantiles.exact_quantiles(df, ["g"], "x", {"lo": 0.025, "hi": 0.975}, slice_rows=50), ["g"])
    pdf = df.toPandas()
    for k, g in enumerate(["cold", "hot"]):
        x = pdf[pdf.g == g].x
        assert got.lo[k] == pytest.approx(np.quantile(x, 0.025)) and got.hi[k] == pytest.approx(np.quantile(x, 0.975))


def test_chunks_carry_a_halo(spark, small_panel):
    _, samples = small_panel
    axis = timeaxis.time_groups(samples)
    seats = timeaxis.assign_chunks(axis, 10, 3).toPandas()
    own = seats[~seats.halo]
    assert len(own) == axis.count() and set(own[own.subject == "a"].chunk) == {0, 1, 2, 3}
    spill = seats[seats.halo & (seats.subject == "a")]
    assert sorted(spill.pos) == [7, 8, 9, 17, 18, 19, 27, 28, 29]


def test_near_times_form_one_group(spark):
    rows = [("a", "s", 1.0), ("b", "s", 1.4), ("c", "s", 1.8), ("d", "s", 5.0), ("e", "s", None)]
    df = spark.createDataFrame(rows, "sample string, subject string, time double")
    got = table(timeaxis.time_groups(df, 0.5, slice_rows=1), ["sample"])
    assert list(got.pos) == [0, 0, 0, 1] and got.group_time[0] == pytest.approx(1.4)


def test_closure_sums_to_one_and_ignores_depth(spark):
    rows = [(0.0, 0.0, 10.0), (3.0, 7.0, 10.0), (2.0, 3.0, 20.0), (0.0, 5.0, 9.0)]
    df = spark.createDataFrame(rows, "ci double, cj double, lib double")
    eps = compose.pseudo_count("minpos_time", base="triplet")

    def closed(frame):
        return compose.log_ratio(compose.close_triplet(compose.triplet(frame), eps, 2.0))

    one = closed(df)
    assert all(abs(r.pi + r.pj + r.pr - 1) < 1e-12 for r in one.collect())
    more = closed(df.select(*[(F.col(c) * 8).alias(c) for c in df.columns]))
    assert np.allclose(one.toPandas()[["x", "y"]], more.toPandas()[["x", "y"]])


def test_each_pair_and_sample_once(spark, small_panel):
    panel, samples = small_panel
    axis = timeaxis.assign_chunks(timeaxis.time_groups(samples), 10)
    members = S.grid_join(samples.select("subject").distinct(), panel.select("taxon").distinct(), "taxon")
    rows = pairs.pair_rows(pairs.dense_series(panel, axis, members), blocks=3)
    assert rows.count() == 6 * 91 == rows.select("i", "j", "sample").distinct().count()
    assert rows.filter("i >= j").count() == 0


@pytest.mark.parametrize("options", [
    {}, {"method": "spearman"}, {"detrend": True}, {"zero_mode": "minpos_time"}, {"zero_minpos_base": "triplet"},
    {"transform": "raw", "partial_rest": True, "partial_method": "matrix"},
])
def test_chunked_screen_equals_whole(spark, small_panel, options):
    panel, samples = small_panel
    whole = subject_table(panel, samples, o=ScreenOptions(**options))
    cut = subject_table(panel, samples, o=ScreenOptions(**options, chunk_rows=9))
    same(whole, cut, ["i", "j", "subject"], ["r", "n", "n_eff_raw", "n_eff", "cozero_frac", "v"])


def test_repeated_times_are_merged(spark, small_panel):
    panel, samples = small_panel
    twice = samples.unionByName(samples.withColumn("sample", F.concat("sample", F.lit("x"))))
    double = panel.unionByName(panel.withColumn("sample", F.concat("sample", F.lit("x"))))
    one = subject_table(panel, samples)
    two = subject_table(double, twice)
    same(one, two, ["i", "j", "subject"], ["r", "n", "n_eff"])


def test_screen_properties(spark, small_panel):
    panel, samples = small_panel
    meta = table(screen(panel, samples, all_columns=True)["meta"], ["i", "j"])
    assert len(meta) == 6 and meta.q.dropna().between(0, 1).all() and (meta.q.dropna() >= meta.p.dropna() - 1e-12).all()
    assert (meta[meta.i == "t0"].k == 2).all() and (meta[meta.i != "t0"].k == 3).all()
    lonely = table(screen(panel, samples, min_k=4)["meta"], ["i", "j"])
    assert len(lonely) == 6 and lonely.r_pooled.isna().all()


def test_options_are_checked(spark):
    for bad in ({"method": "kendall"}, {"transform": "clr"}, {"cozero_action": "drop"}, {"effn_method": "x"}):
        with pytest.raises(ValueError):
            ScreenOptions(**bad)
    with pytest.warns(UserWarning):
        ScreenOptions(partial_rest=True)


def test_step_up_against_numpy(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.uniform(0, 1, 300) ** 3, 3)
    df = spark.createDataFrame([(float(v),) for v in p] + [(None,)], "p double")
    got = multitest.adjust(df, "p", "BH").toPandas()
    order = np.argsort(p)
    q = np.minimum.accumulate((p[order] * 300 / np.arange(1, 301))[::-1])[::-1]
    want = dict(zip(p[order], np.minimum(q, 1)))
    assert got.q.isna().sum() == 1
    for v, q in zip(got.p.dropna(), got.q.dropna()):
        assert q == pytest.approx(want[v])


def test_reml_maximises_the_restricted_likelihood(spark):
    z, v = [0.1, 0.5, 0.9, -0.2, 0.4], [0.02, 0.05, 0.03, 0.04, 0.02]
    df = spark.createDataFrame([("a", "b", a, b) for a, b in zip(z, v)], "i string, j string, z double, v double")
    tau2 = pooling.pool_effects(df, method="REML").first().tau2

    def restricted(t):
        w = 1 / (np.array(v) + t)
        mu = (w * z).sum() / w.sum()
        return -0.5 * (np.log(np.array(v) + t).sum() + np.log(w.sum()) + (w * (np.array(z) - mu) ** 2).sum())

    grid = np.linspace(0, 1, 20001)
    assert tau2 == pytest.approx(grid[np.argmax([restricted(t) for t in grid])], abs=1e-4)


def test_folds_are_balanced(spark):
    people = spark.range(23).select(F.col("id").cast("string").alias("subject"))
    splits = kfold.kfold_splits(people, 5, 3).toPandas()
    assert (splits.groupby("subject").size() == 3).all()
    assert set(splits.groupby(["rep", "fold"]).size()) == {4, 5}
    with pytest.raises(ValueError):
        kfold.kfold_splits(people, 24, 1)


def test_mostly_absent_partner_is_left_out(spark, small_panel):
    panel, samples = small_panel
    rows = pair_inputs(panel, samples, smooth=False)
    seen = rows.filter("`from` = 't0'").select("subject").distinct().toPandas().subject
    assert set(seen) == {"a", "b"}
    assert rows.filter("`to` = 't0' and subject = 'c'").count() > 0


def test_guard_drops_short_and_flat_edges(spark):
    rows = [("a", "b", 1.0, float(k)) for k in range(5)] + [("b", "a", float(k), 1.0 - k) for k in range(5)] + [("c", "a", 0.0, 1.0)]
    df = spark.createDataFrame(rows, "`from` string, `to` string, xi double, xj double")
    assert inputs.guard_edges(df).select("from").distinct().toPandas()["from"].tolist() == ["b"]


FIT = {"smooth": False, "kfold_k": 3, "kfold_r": 2, "n_phi": 6, "n_q": 6, "n_rho": 3}


def test_streamed_fit_equals_one_pass(spark, small_panel):
    panel, samples = small_panel
    one = fit_pairs(panel, samples, **FIT)
    two = fit_pairs(panel, samples, **FIT, task_series=1)
    same(one["edges"], two["edges"], ["from", "to"], ["a_mean", "a_sd", "elpd_mean"])
    same(one["pointwise"], two["pointwise"], ["from", "to", "subject"], ["elpd"])
    held = one["pointwise"].toPandas()
    assert (held.n_test == 2).all()


def test_chunked_fit_is_close_to_whole(spark, small_panel):
    panel, samples = small_panel
    one = fit_pairs(panel, samples, **FIT)
    cut = fit_pairs(panel, samples, **FIT, chunk_rows=15)
    same(one["edges"], cut["edges"], ["from", "to"], ["n_rows"])
    same(one["edges"], cut["edges"], ["from", "to"], ["a_mean"], atol=0.02)


def test_ranking(spark, small_panel):
    panel, samples = small_panel
    bundle = fit_pairs(panel, samples, **FIT)
    out = rank_edges(bundle, alpha=0.05, bootstrap=50).toPandas()
    assert out.bayes_fdr.is_monotonic_increasing and out.bayes_fdr.between(0, 0.5).all()
    for w in ("w_pseudobma", "w_pseudobma_plus", "w_stacking"):
        sums = out.dropna(subset=[w]).groupby("to")[w].sum()
        assert np.allclose(sums, 1)
    own = rank_edges(bundle, which="self").toPandas()
    assert len(own) == len(out) and own.w_stacking.isna().all()
    with pytest.raises(ValueError):
        rank_edges({"edges": out_missing(bundle)})


def out_missing(bundle):
    return bundle["edges"].drop("p_sign2")


def test_stacking_by_passes_equals_local(spark):
    rng = np.random.default_rng(4)
    rows = [("t", f"m{m}", f"s{s}", float(rng.normal(-1 - 0.1 * m, 1))) for m in range(3) for s in range(20)]
    df = spark.createDataFrame(rows, "`to` string, `from` string, subject string, elpd double")
    df = df.withColumns({"elpd_ppd": F.col("elpd"), "n_obs": F.lit(1)})
    local = weights.stacking_weights(df, steps=6, tol=0.0)
    spread = weights.stacking_weights(df, steps=6, tol=0.0, task_cells=1)
    same(local, spread, ["to", "from"], ["weight"], atol=1e-6)


def test_missing_subject_is_left_out_for_all_models(spark):
    rows = [("t", m, s, None if (m, s) == ("a", "x") else -1.0, 1) for m in "ab" for s in "xyz"] + [("u", "a", "x", -1.0, 1)]
    df = spark.createDataFrame(rows, "`to` string, `from` string, subject string, elpd double, n_obs int").withColumn("elpd_ppd", F.col("elpd"))
    kept = weights.common_subjects(df).toPandas()
    assert set(kept.subject) == {"y", "z"} and set(kept.to) == {"t"}


def test_kalman_score_matches_dense(spark):
    rng = np.random.default_rng(6)
    n = 8
    t = np.cumsum(rng.uniform(0.5, 1.5, n))
    xi, xj, y = rng.normal(size=(3, n))
    rows = [("a", "b", "s", float(t[k]), float(y[k]), float(xi[k]), float(xj[k])) for k in range(n)]
    inp = spark.createDataFrame(rows, "`from` string, `to` string, subject string, time double, y double, xi double, xj double")
    par = {"r0": 0.1, "a_ii": -0.3, "a_ij": 0.2, "sigma": 0.5, "sd_ou": 0.4, "phi": 0.6, "tau_r": 0.3}
    long = spark.createDataFrame([("a", "b", 1, 1, k, v) for k, v in par.items()], "`from` string, `to` string, chain int, iter bigint, variable string, value double")
    got = draws.score_subjects(long, inp, "auto").first()
    cov = 0.25 * np.eye(n) + 0.16 * 0.6 ** np.abs(t[:, None] - t[None, :]) + 0.09
    e = y - 0.1 + 0.3 * xi - 0.2 * xj
    want = -0.5 * (n * np.log(2 * np.pi) + np.linalg.slogdet(cov)[1] + e @ np.linalg.solve(cov, e))
    assert got.elpd == pytest.approx(want) and got.elpd_method == "kalman"
    fallback = draws.score_subjects(long, inp, "auto", parameters=["r0", "sigma"]).first()
    assert fallback.elpd_method == "indep"


def test_registered_queries_have_checks():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 90
