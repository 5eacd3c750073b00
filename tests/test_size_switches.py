"""Answers that must not depend on how a series is cut, and joint scoring against one pair at a time."""

import numpy as np
import pytest

from simplexflow.operators import pooling
from simplexflow.plans.fit import pair_inputs


def test_subject_scores_do_not_depend_on_chunks(spark, small_panel):
    def rows(**o):
        made = pair_inputs(*small_panel, guard=False, standardize_by_subject=True, compute_elpd=False, smooth=False, **o)
        return {(r["from"], r["to"], r["subject"], r["time"]): (r["y"], r["xi"], r["xj"]) for r in made.collect()}

    whole, cut = rows(), rows(chunk_rows=10)
    assert whole and whole.keys() == cut.keys()
    assert all(cut[k] == pytest.approx(v, rel=1e-9, abs=1e-9) for k, v in whole.items())


def test_joint_reml_equals_a_search_pair_by_pair(spark):
    rng = np.random.default_rng(9)
    data = []
    for pair in range(30):
        k = [0, 1, 2, 3, 8, 40][pair % 6]
        v = rng.uniform(0.02, 0.3, k)
        z = rng.normal(0.3, np.sqrt(v + [0, 0.05, 2.0][pair % 3]))
        data += [(f"a{pair}", "b", float(x), float(y)) for x, y in zip(z, v)]
    got = {r["i"]: r["tau2"] for r in pooling.pool_effects(spark.createDataFrame(data, "i string, j string, z double, v double"), method="REML").collect()}

    def loss(t, z, v):
        w = 1 / (v + t)
        mu = (w * z).sum() / w.sum()
        return (np.log(v + t).sum() + np.log(w.sum()) + (w * (z - mu) ** 2).sum()) / 2

    for pair in range(30):
        own = np.array([(z, v) for i, _, z, v in data if i == f"a{pair}"])
        if len(own) < 2:
            assert got.get(f"a{pair}") is None
            continue
        tau2, (z, v) = got[f"a{pair}"], own.T
        here = loss(tau2, z, v)
        assert all(here <= loss(t, z, v) + 1e-9 for t in np.r_[0, tau2 + 1e-4, max(0, tau2 - 1e-4), np.geomspace(1e-4, 20, 60)])
