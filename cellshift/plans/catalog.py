"""Imports every module that registers queries."""

from __future__ import annotations

import cellshift.plans.views  # noqa: F401
from cellshift.plans import queries_contracts, queries_decisions, queries_entities, queries_features, queries_folds, queries_graph, queries_metrics, queries_models  # noqa: F401
from cellshift.plans.registry import ORACLES, QUERIES, resolved_sql


def all_queries():
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    return {name: resolved_sql(name) for name in ORACLES}
