"""Lists, filters, look-ups and paging (Q1-Q21).

Every list is a filtered, ordered DataFrame; `page` cuts one page out of it with
limit/offset, which Spark runs as a distributed top-k.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens import fixed_values as v
from linklens.functions import text as T
from linklens.operators import joins as J
from linklens.operators import rollup as R


def contains(text: str, *columns: str) -> Column:
    """`LIKE %text%` over any of the columns; % and _ of the user stay wildcards."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.col(c).like(f"%{text}%"), F.lit(False))
    return hit


def ordered(df: DataFrame, sort_by: str, order: str, allowed: list[str], *ties: Column) -> DataFrame:
    """Q19: order by an allowed column (the first one when unknown), then by the ties."""
    col = F.col(sort_by if sort_by in allowed else allowed[0])
    return df.orderBy(col.asc() if order.upper() == "ASC" else col.desc(), *ties)


def page(df: DataFrame, limit: int = 50, offset: int = 0) -> DataFrame:
    """Q18."""
    return df.offset(offset).limit(limit) if offset else df.limit(limit)


def page_count(total: int, page_size: int) -> int:
    return -(-total // page_size)


def total_of(df: DataFrame) -> DataFrame:
    """Q17: the total beside a page."""
    return df.agg(F.count("*").alias("total"))


def of_task(df: DataFrame, task_id: int | None) -> DataFrame:
    """Rows of one scan, or of all when no scan is named."""
    return df if task_id is None else df.where(F.col("task_id") == task_id)


def list_pages(pages: DataFrame, task_id: int | None = None, depth: int | None = None, status_code: int | None = None,
               search: str | None = None) -> DataFrame:
    """Q1."""
    out = of_task(pages, task_id)
    if depth is not None:
        out = out.where(F.col("depth") == depth)
    if status_code is not None:
        out = out.where(F.col("status_code") == status_code)
    if search:
        out = out.where(contains(search, "url", "title"))
    return out.orderBy("depth", "id")


def list_external_domains(domains: DataFrame, task_id: int | None = None, has_link: bool | None = None, has_text: bool | None = None,
                          source_type: str | None = None, root_domain: str | None = None, search: str | None = None,
                          risk_level: str | None = None, verify_status: str | None = None,
                          sort_by: str = "occurrence_count", order: str = "DESC",
                          occurrences: DataFrame | None = None) -> DataFrame:
    """Q2, Q3 and Q19."""
    out = of_task(domains, task_id)
    if has_link is not None:
        out = out.where(F.col("has_link") == F.lit(has_link))
    if has_text is not None:
        out = out.where(F.col("has_text") == F.lit(has_text))
    if risk_level == "risk_only":
        out = out.where(F.col("risk_level").isin(*v.TOP_RISK_LEVELS))
    elif risk_level:
        out = out.where(F.col("risk_level") == risk_level)
    if verify_status:
        out = out.where(F.col("verify_status") == verify_status)
    if root_domain:
        out = out.where(F.col("root_domain") == root_domain)
    if search:
        out = out.where(contains(search, "domain", "root_domain"))
    if source_type == "asset":
        out = J.with_asset_evidence(out, of_task(occurrences, task_id))
    return ordered(out, sort_by, order, ["occurrence_count", "domain", "root_domain", "risk_level", "verify_status", "id"],
                   F.desc("id"))


def list_subdomains(subdomains: DataFrame, task_id: int | None = None, has_link: bool | None = None, has_text: bool | None = None,
                    search: str | None = None, sort_by: str = "occurrence_count", order: str = "DESC") -> DataFrame:
    """Q4."""
    out = of_task(subdomains, task_id)
    if has_link is not None:
        out = out.where(F.col("has_link") == F.lit(has_link))
    if has_text is not None:
        out = out.where(F.col("has_text") == F.lit(has_text))
    if search:
        out = out.where(contains(search, "domain"))
    return ordered(out, {"subdomain": "domain"}.get(sort_by, sort_by), order, ["occurrence_count", "domain", "id"], F.desc("id"))


def list_tasks(tasks: DataFrame) -> DataFrame:
    """Q5."""
    return R.live_tasks(tasks).orderBy(F.desc("task_id"))


def search_tasks(tasks: DataFrame, text: str = "", status: str = "all") -> DataFrame:
    """Q6: case-insensitive."""
    out = tasks if status == "all" else tasks.where(F.col("status") == status)
    if text.strip():
        needle = text.strip().lower()
        out = out.where(F.lower("name").contains(needle) | F.lower("target_url").contains(needle))
    return out


def recent_logs(logs: DataFrame, task_id: int | None = None, n: int = 100) -> DataFrame:
    """Q7: the newest n of one scan, or of every scan, oldest first."""
    if task_id is not None:
        return logs.where(F.col("task_id") == task_id).orderBy(F.desc("id")).limit(n).orderBy("id")
    return R.top_per_task(logs, n, F.desc("id")).drop("rank").orderBy("task_id", "id")


def logs_of_level(logs: DataFrame, level: str) -> DataFrame:
    """Q8."""
    return logs.where(T.log_level(F.col("level")) == level.upper())


def evidence_of(occurrences: DataFrame, task_id: int, domain: str) -> DataFrame:
    """Q9."""
    return occurrences.where((F.col("task_id") == task_id) & (F.col("domain") == domain)).orderBy(F.desc("seq"))


def evidence_urls(occurrences: DataFrame, domains: DataFrame) -> DataFrame:
    """Q10: distinct evidence pages per scan and domain, the sample page where there are none."""
    urls = occurrences.where(F.coalesce("page_url", F.lit("")) != "").select("task_id", "domain", "page_url").distinct()
    out = domains.select("task_id", "domain", "sample_page_url").join(urls, ["task_id", "domain"], "left")
    return (out.withColumn("page_url", F.coalesce("page_url", F.nullif("sample_page_url", F.lit(""))))
            .where(F.col("page_url").isNotNull()).select("task_id", "domain", "page_url"))


def list_global(grouped: DataFrame, sort_by: str = "total_occurrences", order: str = "DESC") -> DataFrame:
    """Q11: order of the cross-scan list (see rollup.global_domains)."""
    return ordered(grouped, sort_by, order, ["total_occurrences", "task_count", "domain", "root_domain", "risk_level",
                                             "first_seen_at", "last_seen_at"], F.col("domain").asc())


def list_rules(rules: DataFrame, search: str | None = None, risk_level: str | None = None) -> DataFrame:
    """Q12 (page counts: joins.rule_page_counts)."""
    out = rules
    if search:
        out = out.where(contains(search.strip(), "domain", "remark", "category"))
    if risk_level:
        out = out.where(F.col("risk_level") == risk_level)
    return out.orderBy(F.desc("id"))


def rule_list(rules: DataFrame, root_counts: DataFrame, domain_counts: DataFrame, tickets: DataFrame, domains: DataFrame,
              search: str | None = None, risk_level: str | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """Q12 with J10: one page of the rules with the pages they touch; only its rules' targets are counted."""
    listed = list_rules(rules, search, risk_level)
    listed = listed if limit is None else page(listed, limit, offset)
    return J.rule_page_counts(listed, root_counts, domain_counts, tickets, domains).orderBy(F.desc("id"))


def tasks_of_page(listed: DataFrame, domains: DataFrame, tasks: DataFrame) -> DataFrame:
    """A12 for the rows of one page of the global list: the lists of scans of other domains are never built."""
    key = ["domain", "root_domain"]
    rows = R.on_live_tasks(domains.join(listed.select(*key), key, "left_semi"), tasks, "name")
    lists = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("task_id", F.col("name").alias("task_name"), "occurrence_count"))).alias("associated_tasks"))
    return listed.join(lists, key, "left")


def filter_tickets(tickets: DataFrame, tasks: DataFrame, task_id: int | None = None, risk_level: str | None = None,
                   verify_status: str | None = None, manual_status: str | None = None, search: str | None = None) -> DataFrame:
    out = tickets
    if task_id:
        out = out.where(F.col("task_id") == task_id)
    if risk_level == "all_risk":
        out = out.where(F.col("risk_level").isin(*v.RISKY_LEVELS))
    elif risk_level:
        out = out.where(F.col("risk_level") == risk_level)
    if verify_status == "pending_only":
        out = out.where(F.col("verify_status").isin(*v.OPEN_STATES))
    elif verify_status:
        out = out.where(F.col("verify_status") == verify_status)
    if manual_status:
        out = out.where(F.col("manual_status") == manual_status)
    out = R.on_live_tasks(out, tasks, F.col("name").alias("task_name"), F.col("target_url").alias("target_site_url"))
    if search:
        columns = [c for c in ("page_url", "domain", "page_title", "task_name") if c in out.columns]
        out = out.where(contains(search.strip(), *columns))
    return out


def list_tickets(tickets: DataFrame, tasks: DataFrame, **filters) -> DataFrame:
    """Q13: failed first, then unverified, newest first."""
    rank = F.when(F.col("verify_status") == "verified_failed", 1).when(F.col("verify_status") == "unverified", 2).otherwise(3)
    return filter_tickets(tickets, tasks, **filters).orderBy(rank, F.desc("id"))


QUEUE = ["id", "task_id", "domain", "page_url", "source_type", "last_verified_at", "raw_match"]


def _queue(tickets: DataFrame, tasks: DataFrame, states: list[str]) -> DataFrame:
    rows = R.on_live_tasks(tickets.where(F.col("verify_status").isin(*states) & (F.col("manual_status") != "ignored")), tasks)
    return rows.select(*QUEUE).orderBy(F.asc_nulls_first("last_verified_at"), "id")


def retest_queue(tickets: DataFrame, tasks: DataFrame) -> DataFrame:
    """Q14: open tickets, never tested ones first."""
    return _queue(tickets, tasks, v.OPEN_STATES)


def rollback_queue(tickets: DataFrame, tasks: DataFrame) -> DataFrame:
    """Q15: closed tickets for the regression audit."""
    return _queue(tickets, tasks, v.CLOSED_STATES)


def look_up(df: DataFrame, **key) -> DataFrame:
    """Q16: rows by equality; the filter reaches the scan."""
    for c, value in key.items():
        df = df.where(F.col(c) == value)
    return df


def pending_delete(tasks: DataFrame) -> DataFrame:
    """Q20."""
    return tasks.where(F.col("status") == "deleting").select("task_id")


def known_domains(domains: DataFrame, evidence: DataFrame) -> DataFrame:
    """(task_id, domain) of the stored domains and of new evidence, each once."""
    key = ["task_id", "domain"]
    return domains.select(*key).unionByName(evidence.select(*key)).distinct()


def distinct_test_urls(evidence: DataFrame) -> DataFrame:
    """The pages on which a scan's domain is to be tested, each once."""
    return evidence.select("task_id", "domain", "page_url").distinct()
