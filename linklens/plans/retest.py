"""Retest jobs (T8, RISK3, RISK4): the periodic cycle, the regression audit and the retest of whole domains.

The verdicts come from a join with response bodies and feed several tables, so
they are stored once: the bodies are read once per job, and what that shuffles is gone before the next step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from linklens.operators import merge as M
from linklens.operators import risk as K
from linklens.operators import rollup as R
from linklens.operators import search as S
from linklens.session import stored

KEY = ["task_id", "domain", "page_url"]


def _verdicts(tickets: DataFrame, queue: DataFrame | None, responses: DataFrame, run_ts: Column) -> DataFrame:
    due = tickets if queue is None else tickets.join(queue.select(*KEY), KEY, "left_semi")
    return stored(K.retest_pages(due, responses, run_ts), "verdicts")


def retest_all(tickets: DataFrame, domains: DataFrame, responses: DataFrame, run_ts: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Test every ticket that has a fresh response; next tickets, next domains, verdicts."""
    verdicts = _verdicts(tickets, None, responses, run_ts)
    after = M.apply_page_verdicts(tickets, verdicts, run_ts)
    return after, M.close_domains(domains, after, verdicts), verdicts


def retest_cycle(tickets: DataFrame, domains: DataFrame, tasks: DataFrame, responses: DataFrame,
                 run_ts: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Test open tickets against fresh responses; next tickets, next domains, cycle statistics."""
    verdicts = _verdicts(tickets, S.retest_queue(tickets, tasks), responses, run_ts)
    after = M.apply_page_verdicts(tickets, verdicts, run_ts)
    return after, M.close_domains(domains, after, verdicts), R.cycle_stats(verdicts)


def rollback_audit(tickets: DataFrame, domains: DataFrame, tasks: DataFrame, responses: DataFrame,
                   run_ts: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Test closed tickets again; regressions are reopened, all other verdicts applied as in a cycle."""
    verdicts = _verdicts(tickets, S.rollback_queue(tickets, tasks), responses, run_ts)
    after = M.apply_page_verdicts(tickets, verdicts, run_ts)
    after, reopened = M.mark_rollbacks(after, M.close_domains(domains, after, verdicts), verdicts, run_ts)
    return after, reopened, R.rollback_stats(verdicts)


def retest_domains(domains: DataFrame, tickets: DataFrame, urls: DataFrame, responses: DataFrame, run_ts: Column,
                   max_urls: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Test whole domains on their evidence pages; next domains, next tickets, verdicts per scan, status per domain."""
    results = stored(K.retest_page_results(urls, responses, max_urls), "results")
    verdicts = R.domain_verdicts(results, "task_id", "domain")
    d, t = M.apply_domain_verdicts(domains, tickets, verdicts, results, run_ts)
    return d, t, verdicts, R.overall_status(verdicts, "domain")
