"""All registered queries."""

from linklens.checks import extract_checks, flow_checks, risk_checks, rollup_checks, search_checks, store_checks, stream_checks  # noqa: F401
from linklens.checks.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
