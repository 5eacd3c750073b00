"""Cases of the fourth round of findings."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplexflow.operators import association, draws, weights
from simplexflow.plans.screen import ScreenOptions, subject_table


def test_rank_sums_are_exact_in_any_order(spark):
    """r of ranks does not depend on the order in which the rows are added."""
    rng = np.random.default_rng(3)
    ranks = [[float(np.mean(np.flatnonzero(np.sort(v) == k)) + 1) for k in v] for v in rng.integers(0, 6, (3, 27))]
    cols = ["x", "y", "z"]
    for seed in range(3):
        order = np.random.default_rng(seed).permutation(27)
        df = spark.createDataFrame([tuple(r[k] for r in ranks) for k in order], "x double, y double, z double").repartition(4)
        got = df.agg(*[c.alias(k) for k, c in association.rank_sums(cols).items()]).first()
        assert got["n"] == 27
        for a, b in [("x", "x"), ("x", "y"), ("y", "z"), ("z", "z")]:
            u, v = ([Fraction(t) - 14 for t in ranks[cols.index(c)]] for c in (a, b))
            assert Fraction(got[f"s_{a}{b}"]) == sum(p * q for p, q in zip(u, v))


def test_an_autocorrelation_of_zero_keeps_the_whole_length(spark):
    """both autocorrelations of ``a`` are exactly 0, so the effective length is the length and not the number below it."""
    counts = [(0, 0, 5), (1, 1, 1), (0, 0, 2), (0, 0, 2), (0, 1, 1), (1, 0, 1), (0, 0, 1), (0, 0, 2), (0, 0, 1), (0, 0, 2), (0, 1, 0), (1, 0, 2), (1, 0, 4),
              (0, 0, 2), (0, 0, 1), (0, 0, 2), (1, 0, 2), (0, 1, 2), (0, 0, 1), (1, 0, 4), (0, 0, 2), (0, 0, 2), (0, 0, 2), (0, 0, 1), (0, 0, 1)]
    cells = [(f"s|{k}", t, float(c)) for k, row in enumerate(counts) for t, c in zip("abc", row) if c]
    panel = spark.createDataFrame(cells, "sample string, taxon string, count double")
    samples = spark.createDataFrame([(f"s|{k}", "s", float(k)) for k in range(len(counts))], "sample string, subject string, time double")
    o = ScreenOptions(zero_mode="minpos_time", zero_minpos_base="triplet")
    row = subject_table(panel, samples, o=o).filter("i = 'a' AND j = 'b'").first()
    assert (row["n"], row["n_eff_raw"], row["n_eff"]) == (25, 25.0, 25.0)


@pytest.mark.parametrize("options", [{}, {"transform": "raw", "partial_rest": True}, {"method": "spearman", "transform": "raw", "partial_rest": True}])
def test_centred_series_equal_additive_sums(spark, small_panel, options):
    """the centred lag products are those that chunks of a long series add up."""
    whole, cut = ({(r.i, r.j, r.subject): r for r in subject_table(*small_panel, o=ScreenOptions(**options, chunk_rows=c)).collect()} for c in (16384, 10))
    assert whole and whole.keys() == cut.keys()
    for k, r in whole.items():
        assert r.n_eff_raw == pytest.approx(cut[k].n_eff_raw, rel=1e-9) and r.r == pytest.approx(cut[k].r, rel=1e-9)


def test_stacking_does_not_depend_on_the_size_of_a_target(spark, monkeypatch):
    """both paths take the same steps and stop at the same one, target by target."""
    rng = np.random.default_rng(8)
    rows = [(t, f"m{m}", f"s{s}", float(v)) for t, models, spread in (("a", 3, 2.0), ("b", 2, 0.3), ("c", 4, 1.0))
            for m in range(models) for s, v in enumerate(rng.normal(0.2 * m, spread, 12))]
    rows += [("d", m, f"s{s}", -1.0) for m in ("flat", "same") for s in range(5)]
    df = spark.createDataFrame(rows, "`to` string, `from` string, subject string, elpd double")
    local, spread = ({(r["to"], r["from"]): r["weight"] for r in weights.stacking_weights(df, tol=3e-3, task_cells=c).collect()} for c in (10**6, 1))
    assert len(local) == 11 and local.keys() == spread.keys()
    assert all(spread[k] == pytest.approx(v, abs=1e-12) for k, v in local.items())
    asked = []
    monkeypatch.setattr(weights, "stack_by_passes", lambda scores, steps, tol: asked.append(steps) or scores.selectExpr("`to`", "`from`", "s AS weight"))
    weights.stacking_weights(df, task_cells=1)
    assert asked == [5000]


@pytest.fixture(scope="module")
def drawn(spark):
    rng = np.random.default_rng(12)
    inputs = spark.createDataFrame([("a", "b", s, float(t), *map(float, rng.normal(size=3))) for n, s in enumerate("xyz") for t in range(4 + n)],
                                   "`from` string, `to` string, subject string, time double, y double, xi double, xj double")
    rows = [("a", "b", k % 2, 3000 * k, 0.1 * k, -0.2, None if k == 5 else 0.3, 0.5 + k % 3, 0.4, 0.3 + 0.1 * (k % 4), 0.2 * (k % 2)) for k in range(9)]
    wide = spark.createDataFrame(rows, "`from` string, `to` string, chain int, iter bigint, r0 double, a_ii double, a_ij double, sigma double, sd_ou double, phi double, tau_r double")
    return inputs, wide


def test_a_block_of_draws_is_scored_once(spark, drawn):
    """the mean over draws comes from one scoring, and equals the one over a row per draw."""
    inputs, wide = drawn
    for method, nu in (("kalman", None), ("kalman", 5.0), ("indep", 5.0)):
        out = draws.score_subjects(wide, inputs, method, nu=nu)
        assert out._jdf.queryExecution().executedPlan().toString().count("MapInPandas") == 1
        turned = draws.wide_draws(wide).withColumn("pred_sd", draws.predictive_sd("ou"))
        rows = draws.score_kalman(turned, inputs, nu) if method == "kalman" else draws.score_independent(turned, inputs, nu)
        want = {r.subject: [] for r in rows.collect()}
        for r in rows.collect():
            want[r.subject] += [] if r.ll is None else [r.ll]
        got = {r.subject: r.elpd for r in out.collect()}
        assert {len(v) for v in want.values()} == {8}
        assert got == {s: pytest.approx(np.logaddexp.reduce(v) - np.log(8), rel=1e-12) for s, v in want.items()}


@pytest.mark.parametrize("nu", [None, 5.0])
def test_moments_of_replicates_equal_those_of_their_rows(spark, drawn, nu):
    """the blocks make the same replicates as the rows, to the last hash."""
    inputs, wide = drawn
    wide = draws.wide_draws(wide).withColumn("pred_sd", draws.predictive_sd("wn"))
    rows = draws.replicate(wide, inputs, nu).groupBy("from", "to").agg(
        F.count("*").alias("n"), F.avg("ll").alias("ll"), F.avg("y_rep").alias("rep_mean"), F.stddev_samp("y_rep").alias("rep_sd")).first()
    got = draws.replicate_moments(wide, inputs, nu).first()
    assert got["n"] == rows["n"] == 9 * 15
    assert [got[c] for c in ("ll", "rep_mean", "rep_sd")] == pytest.approx([rows[c] for c in ("ll", "rep_mean", "rep_sd")], rel=1e-10)


def test_the_series_of_a_variable_go_through_one_transform(monkeypatch):
    """one transform there and one back for bulk and both tails; chains that stand still apart never agree."""
    seen = []
    whole = np.fft.rfft
    monkeypatch.setattr(np.fft, "rfft", lambda *a, **o: seen.append(a) or whole(*a, **o))
    rhat, bulk, tail = draws.convergence([np.sin(np.arange(90.0) * k) for k in (1, 2, 3)])
    assert len(seen) == 1 and np.isfinite([rhat, bulk, tail]).all()
    assert draws.convergence([np.full(9, 0.1), np.full(8, 0.3)])[0] == np.inf and np.isnan(draws.convergence([np.full(9, 0.1)])[0])


def test_ranking_works_out_the_diagnostics_once(spark):
    """every weight reads the finished diagnostics and scores."""
    worked = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        worked.add(1)
        return x

    pairs = [("a", "t"), ("b", "t"), ("c", "t")]
    edges = spark.createDataFrame([(*p, 0.5, 0.1, 0.9, 0.02) for p in pairs], "`from` string, `to` string, a_mean double, a_q2_5 double, a_q97_5 double, p_sign2 double")
    diag = spark.createDataFrame([(*p, 1.0, 900.0, 900.0, 0, 0, 0.9, 2000) for p in pairs],
                                 "`from` string, `to` string, rhat double, ess_bulk double, ess_tail double, divergences int, treedepth_hits int, ebfmi_min double, n_draws int")
    points = spark.createDataFrame([(*p, f"s{s}", -1.0 - 0.1 * n * s, 4) for n, p in enumerate(pairs) for s in range(4)], "`from` string, `to` string, subject string, elpd double, n_obs int")
    points = points.withColumn("elpd_ppd", F.col("elpd") / 4)
    from simplexflow.plans.rank import rank_edges

    out = rank_edges({"edges": edges, "diagnostics": diag.withColumn("rhat", counted("rhat")), "pointwise": points}, bootstrap=3).collect()
    assert len(out) == 3 and all(r.w_stacking is not None for r in out)
    assert worked.value <= 2 * len(pairs)  # a plan may use the column twice in a row, four weights read it
