"""All registered queries and the flagship."""

from __future__ import annotations

from tapewright.plans import q_bars, q_data, q_engine, q_levels, q_panel, q_portfolio, q_signals, q_stream, q_studies  # noqa: F401
from tapewright.plans.q_signals import flagship  # noqa: F401
from tapewright.plans.registry import CHECKS, QUERIES, with_parts


def queries():
    return dict(QUERIES)


def checks():
    return {name: with_parts(body) for name, body in CHECKS.items()}
