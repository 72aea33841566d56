"""Checked queries over the given tables."""

from checks.registry import CHECKS
from checks import columns_and_sources, fitted_profiles, ranking_and_policy, runs_and_summaries, support_and_joins  # noqa: F401

__all__ = ["CHECKS"]
