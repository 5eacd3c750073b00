"""Cases of the third round of findings."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from simplexflow.operators import association, draws, kfold, pairs, timeaxis
from simplexflow.plans.screen import ScreenOptions, subject_table
from simplexflow.sources import panel as S


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_grid_is_never_broadcast(spark):
    left, right = spark.range(40).withColumnRenamed("id", "a"), spark.range(3).withColumnRenamed("id", "b")
    grid = S.grid_join(left, right, "b")
    assert "Broadcast" not in plan(grid)
    assert sorted((r.a, r.b) for r in grid.collect()) == [(a, b) for a in range(40) for b in range(3)]


def test_log_mean_exp_reads_its_rows_once(spark):
    far = {"a": [-2000.0, -1.5, -499.9], "b": [1400.0, 3.0], "c": [-5e5, -5e5], "d": [float("-inf"), 0.0]}
    df = spark.createDataFrame([(g, v) for g, vs in far.items() for v in [*vs, None]], "g string, x double")
    out = draws.log_mean_exp(df.coalesce(1), ["g"], "x")
    got = {r.g: r.lme for r in out.collect()}
    assert got == {g: pytest.approx(np.logaddexp.reduce(vs) - np.log(len(vs)), rel=1e-12) for g, vs in far.items()}
    for join in [part for part in plan(out).split("Join")[1:]]:  # the join is of one row per bin and group, not of the rows
        assert "HashAggregate" in join


def test_student_scores_are_the_same_in_blocks_and_rows(spark, monkeypatch):
    rng = np.random.default_rng(11)
    inputs = spark.createDataFrame([("a", "b", s, float(t), *map(float, rng.normal(size=3))) for s in "xyz" for t in range(6)],
                                   "`from` string, `to` string, subject string, time double, y double, xi double, xj double")
    wide = spark.createDataFrame([("a", "b", k % 2, k, 0.1 * k, -0.2, None if k == 5 else 0.3, 0.5 + k) for k in range(9)],
                                 "`from` string, `to` string, chain int, iter bigint, r0 double, a_ii double, a_ij double, pred_sd double")
    for nu in (2.0, 5.0):
        blocks = draws.score_independent(wide, inputs, nu)
        assert "ArrowEvalPython" in plan(blocks) or "MapInPandas" in plan(blocks)
        monkeypatch.setattr(draws, "SERIES_ROWS", 2)
        rows = draws.score_independent(wide, inputs, nu)
        monkeypatch.undo()
        a, b = ({(r.subject, r.chain, r.iter): (r.n_obs, r.ll) for r in df.collect()} for df in (blocks, rows))
        assert len(a) == 27 and a.keys() == b.keys()
        assert all(a[k][0] == b[k][0] and (a[k][1] is None) == (b[k][1] is None) == (k[2] == 5) for k in a)
        assert all(a[k][1] == pytest.approx(b[k][1]) for k in a if k[2] != 5)


def test_partial_correlation_of_shares_that_fill_up_to_one(spark):
    rng = np.random.default_rng(4)
    x, y = 0.3 + 1e-4 * rng.normal(size=(2, 400))
    df = spark.createDataFrame([("s", *map(float, v)) for v in zip(x, y, 1 - x - y)], "s string, x double, y double, z double")
    sums = df.groupBy("s").agg(F.variance("z").alias("v"), *[c.alias(k) for k, c in association.moment_sums(["x", "y", "z"]).items()])
    flat = sums.withColumn("v", F.lit(1.0))
    assert association.with_rest_correlation(flat, "x", "y", "z", "v", 1e-300).first().r == pytest.approx(-1.0, abs=1e-11)
    level = df.withColumn("x", F.lit(0.1)).groupBy("s").agg(*[c.alias(k) for k, c in association.moment_sums(["x", "y"]).items()])
    assert level.select(association.plain_correlation("x", "y")).first()[0] is None


def test_ranks_order_distinct_values_only(spark):
    rows = [("g", float(v % 5)) for v in range(60)] + [("g", None), ("g", None), ("h", 2.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    sliced = association.average_rank(df, ["g"], "x", slice_rows=2)
    for window in plan(sliced).split("Window [")[1:]:
        assert "_ties" in window.split("\n")[0] or "_rows" in window.split("\n")[0]
    key = lambda r: (r.g, r.x is not None, r.x or 0.0, r.x_rank)
    assert sorted(map(key, sliced.collect())) == sorted(map(key, association.average_rank(df, ["g"], "x").collect()))


def test_normal_quantiles_are_worked_out_once(monkeypatch):
    seen = []
    chains = [np.repeat([0.01, 0.02, 0.03, 0.04], 25)] * 4
    want = draws.convergence(chains)
    whole = draws._inv_cdf
    monkeypatch.setattr(draws, "_inv_cdf", lambda p: seen.append(np.size(p)) or whole(p))
    assert draws.convergence(chains) == want and sum(seen) <= 8


def test_fold_status_reads_its_rows_once(spark):
    rows = spark.range(30).selectExpr("'a' AS `from`", "'b' AS `to`", "cast(id % 3 AS string) AS subject", "id").where("id > -12345")
    splits = spark.createDataFrame([(1, 1, "0"), (1, 2, "1"), (1, 3, "2"), (1, 3, "9")], "rep int, fold int, subject string")
    out = kfold.fold_status(rows, splits)
    assert "-12345" not in plan(out)
    assert sorted((r.fold, r.n_train, r.n_test, r.fold_status) for r in out.collect()) == [(k, 20, 10, "ok") for k in (1, 2, 3)]


def test_time_groups_sort_few_rows_a_task(spark, monkeypatch):
    """the tasks follow the rows, not the session's setting; groups of slices, copies and long chains as counted by hand."""
    monkeypatch.setattr(timeaxis, "TASK_ROWS", 10)
    times = {"a": [0, 0, 1, 2, 9, 10, 20], "b": [float(k) for k in range(50)], "c": [3], "d": [float(3 * k) for k in range(40)], "e": [float("nan"), 5, 7]}
    rows = [(f"{s}{n}", s, float(t)) for s, ts in times.items() for n, t in enumerate(ts)] + [("none", None, 1.0), ("hole", "a", None)]
    df = spark.createDataFrame(rows, "sample string, subject string, time double")
    for tol in (1.0, None):
        want = {}
        for s, ts in times.items():
            groups = []
            for t in sorted(t for t in ts if t == t):
                if groups and t - groups[-1][-1] <= (tol or 0.0):
                    groups[-1].append(t)
                else:
                    groups.append([t])
            for n, t in enumerate(ts):
                want |= {f"{s}{n}": (p, sum(g) / len(g), len(g), len(groups)) for p, g in enumerate(groups) if t in g}
        for slice_rows in (3, 1000):
            out = timeaxis.time_groups(df, tol, slice_rows=slice_rows)
            got = {r["sample"]: (r["pos"], r["group_time"], r["group_n"], r["n_groups"]) for r in out.collect()}
            assert got == want
            assert out.rdd.getNumPartitions() == 10  # 99 distinct times


def test_effective_length_steps_are_few(spark):
    """F15 to F17: positions and means come from one sort, so a task holds few of its rows at once; long series give the same by slices."""
    rng = np.random.default_rng(1)
    rows = [(f"s{s}", float(t), float(rng.normal()), float(rng.normal())) for s in range(6) for t in range(5 + 9 * s)]
    df = spark.createDataFrame([*rows, ("one", 1.0, 2.0, 3.0)], "subject string, time double, x double, y double")
    for method in association.EFFN_METHODS:
        out = association.effective_n(df, method=method)
        assert out._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 2  # sums with sums, never rows with rows
        short = {r["subject"]: (r["n"], r["n_eff"]) for r in out.collect()}
        long = {r["subject"]: (r["n"], r["n_eff"]) for r in association.effective_n(df, method=method, slice_rows=7).collect()}
        assert short.keys() == long.keys() and len(short) == 7 and short["one"] == (1, None)
        for s, (n, value) in short.items():
            assert n == long[s][0] and (value == long[s][1] or abs(value - long[s][1]) < 1e-9)


def test_one_sort_serves_the_series_minimum_and_its_lags(spark):
    values = [0.5, None, 0.25, 0.75, 0.5]
    rows = spark.createDataFrame([(s, 0, 0, 0, "a", "b", k, v) for s in "xy" for k, v in enumerate(values)],
                                 "subject string, chunk int, bi int, bj int, i string, j string, pos int, pr double")
    low = pairs.series_stats(rows.repartition(4, *pairs.TILE), {"low": F.min("pr")}, timeaxis.AxisProfile(5, False, 16))
    out = association.lagged_values(low, ["pr"], 1)
    assert plan(out).count("Sort [") == 1
    assert {(r.pos, r.pr, r.low, r._pr1) for r in out.collect()} == {(k, v, 0.25, values[k - 1] if k else None) for k, v in enumerate(values)}


@pytest.mark.parametrize("options", [{"zero_minpos_base": "triplet", "rest_floor_frac": 2.0}, {"method": "spearman"}])
def test_few_parts_of_many_subjects_stay_in_one_block(spark, monkeypatch, options):
    rng = np.random.default_rng(5)
    cells = [(f"s{s}|{k}", f"t{p}", float(c)) for s in range(80) for k in range(8) for p, c in enumerate(rng.poisson(2.0, 4)) if c > 0]
    panel = spark.createDataFrame(cells, "sample string, taxon string, count double")
    samples = spark.createDataFrame([(f"s{s}|{k}", f"s{s}", float(k)) for s in range(80) for k in range(8)], "sample string, subject string, time double")
    profile = timeaxis.profile_axis(timeaxis.time_groups(samples))
    assert pairs.blocks_for(panel, profile) == 1
    assert pairs.blocks_for(panel, timeaxis.AxisProfile(8, False, 16384, 10)) == pairs.BLOCKS  # few subjects
    assert pairs.blocks_for(panel, timeaxis.AxisProfile(1 << 20, False, 1 << 20, 80)) == pairs.BLOCKS  # large tiles

    def table():
        return sorted((r.i, r.j, r.subject, r.n, round(r.r, 12) if r.r is not None else None, r.n_eff, r.floor_hits) for r in subject_table(panel, samples, o=ScreenOptions(**options)).collect())

    one = table()
    monkeypatch.setattr(pairs, "TASK_TILES", 10 ** 6)
    assert pairs.blocks_for(panel, profile) == pairs.BLOCKS
    assert len(one) > 80 and one == table()
