"""Compositional time-series panels on Spark DataFrames."""

from simplexflow.plans.across import fit_pairs_across
from simplexflow.plans.fit import fit_pairs, pair_inputs
from simplexflow.plans.rank import rank_edges
from simplexflow.plans.screen import screen

__all__ = ["screen", "fit_pairs", "fit_pairs_across", "pair_inputs", "rank_edges"]
