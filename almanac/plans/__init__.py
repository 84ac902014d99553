"""Registered queries over the driver's tables, with their SQL counterparts."""

from __future__ import annotations

from almanac.plans import aggregates, confounds, controls, event_study, inference, joins, mechanisms, portfolios, robustness, rules, samples, selections, streams, texts  # noqa: F401
from almanac.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
