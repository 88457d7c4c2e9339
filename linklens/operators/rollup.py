"""Aggregates (A1-A31).  Hash or sort aggregates with map-side partials; no unpartitioned windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linklens import fixed_values as v
from linklens.functions import text as T


def first_by_severity(c: Column, order: list[str], default: str | None = None) -> Column:
    """Most severe value of a group: the first of `order` that occurs."""
    out = None
    for value in order:
        hit = F.bool_or(c == value)
        out = F.when(hit, F.lit(value)) if out is None else out.when(hit, F.lit(value))
    return out.otherwise(F.lit(default or order[-1]))


def effective_risk(c: Column) -> Column:
    return first_by_severity(c, v.RISK_LEVELS[:-1], v.RISK_LEVELS[-1])


def effective_verify(c: Column) -> Column:
    return first_by_severity(c, v.VERIFY_STATES[:-1], v.VERIFY_STATES[-1])


def counts_by_value(c: Column, values: list[str], prefix: str = "") -> list[Column]:
    """One zero-filled count column per value."""
    return [F.count_if(F.coalesce(c == value, F.lit(False))).alias(prefix + value) for value in values]


def live_tasks(tasks: DataFrame) -> DataFrame:
    return tasks.where(F.col("status") != "deleting")


def on_live_tasks(rows: DataFrame, tasks: DataFrame, *task_columns: str | Column) -> DataFrame:
    """Rows of scans that are not being deleted, with columns of the scan."""
    return rows.join(live_tasks(tasks).select("task_id", *task_columns), "task_id")


def domain_rollup(hits: DataFrame) -> DataFrame:
    """A1 / A2: per scan and domain the count, the kinds of evidence and a sample page.

    Counts and flags go through a partial hash aggregate, so a domain that is on
    every page leaves each map task as one row.
    """
    return hits.groupBy("task_id", "domain", "root_domain").agg(
        F.count("*").alias("occurrence_count"), F.bool_or("is_link").alias("has_link"),
        F.bool_or(~F.col("is_link")).alias("has_text"), F.min("page_url").alias("sample_page_url"))


def task_domain_stats(domains: DataFrame) -> DataFrame:
    """A3 and A4 in one pass per scan: totals, level and verification counts.

    Counts are taken per root first and summed, so that distinct roots expand no rows.
    """
    per_root = domains.groupBy("task_id", "root_domain").agg(
        F.count("*").alias("total_unique_domains"), F.count_if("has_link").alias("link_domains"), F.count_if("has_text").alias("text_domains"),
        *counts_by_value(F.col("risk_level"), v.RISK_LEVELS),
        F.count_if(F.col("risk_level").isin(*v.TOP_RISK_LEVELS)).alias("total_risk"),
        *counts_by_value(F.col("verify_status"), v.VERIFY_STATES, "verify_"))
    sums = [c for c in per_root.columns if c not in ("task_id", "root_domain", "total_unique_domains")]
    return per_root.groupBy("task_id").agg(F.sum("total_unique_domains").alias("total_unique_domains"), F.count("root_domain").alias("unique_root_domains"),
                                           *[F.sum(c).alias(c) for c in sums])


def top_per_task(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """First n rows of every scan; the rank limit is applied below the exchange."""
    w = Window.partitionBy("task_id").orderBy(*order)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_roots_per_task(domains: DataFrame, n: int = 10) -> DataFrame:
    """A5."""
    roots = domains.groupBy("task_id", "root_domain").agg(
        F.count("*").alias("domain_count"), F.sum("occurrence_count").alias("total_occurrences"))
    return top_per_task(roots, n, F.desc("total_occurrences"), F.asc("root_domain"))


def top_domains_per_task(domains: DataFrame, n: int = 10) -> DataFrame:
    """A6."""
    rows = domains.select("task_id", "domain", "root_domain", "occurrence_count", "has_link", "has_text", "risk_level")
    return top_per_task(rows, n, F.desc("occurrence_count"), F.asc("domain"))


def subdomain_stats(subdomains: DataFrame) -> DataFrame:
    """A7."""
    return subdomains.groupBy("task_id").agg(
        F.count("*").alias("total_subdomains"), F.count_if("has_link").alias("link_subdomains"),
        F.count_if("has_text").alias("text_subdomains"))


def global_domains(domains: DataFrame, tasks: DataFrame, search: str | None = None, root_domain: str | None = None,
                   has_link: bool | None = None, has_text: bool | None = None, risk_level: str | None = None,
                   verify_status: str | None = None, min_tasks: int | None = None, with_tasks: bool = True) -> DataFrame:
    """Domains over all live scans.

    Flag filters apply before grouping and so change the sums; level, status
    and task-count filters apply to the grouped rows.  A domain occurs once per
    scan, so the task list of a group is bounded by the number of scans.
    """
    rows = on_live_tasks(domains, tasks, "name")
    if search:
        pattern = f"%{search.strip()}%"
        rows = rows.where(F.col("domain").like(pattern) | F.col("root_domain").like(pattern))
    if root_domain:
        rows = rows.where(F.col("root_domain") == root_domain.strip())
    if has_link is not None:
        rows = rows.where(F.col("has_link") == F.lit(has_link))
    if has_text is not None:
        rows = rows.where(F.col("has_text") == F.lit(has_text))
    measures = [
        F.sum("occurrence_count").alias("total_occurrences"),
        # (task_id, domain) is unique, so a count of rows is the count of scans
        F.count("*").alias("task_count"),
        F.bool_or("has_link").alias("has_link"), F.bool_or("has_text").alias("has_text"),
        F.min("created_at").alias("first_seen_at"), F.max("created_at").alias("last_seen_at"),
        F.min("sample_page_url").alias("sample_page_url"),
        effective_risk(F.col("risk_level")).alias("risk_level"),
        effective_verify(F.col("verify_status")).alias("verify_status")]
    if "risk_tags" in domains.columns:
        measures += [F.max(F.to_json("risk_tags")).alias("risk_tags"), F.max("risk_remark").alias("risk_remark")]
    if "verify_time" in domains.columns:
        measures.append(F.max("verify_time").alias("verify_time"))
    if with_tasks:
        measures.append(F.array_sort(F.collect_list(F.struct(
            "task_id", F.col("name").alias("task_name"), "occurrence_count"))).alias("associated_tasks"))
    out = rows.groupBy("domain", "root_domain").agg(*measures)
    if risk_level == "risk_only":
        out = out.where(F.col("risk_level").isin(*v.TOP_RISK_LEVELS))
    elif risk_level:
        out = out.where(F.col("risk_level") == risk_level)
    if verify_status:
        out = out.where(F.col("verify_status") == verify_status)
    if min_tasks and min_tasks > 1:
        out = out.where(F.col("task_count") >= min_tasks)
    return out


def global_totals(domains: DataFrame, tasks: DataFrame) -> DataFrame:
    """Totals over every stored domain; scans being deleted only leave the task count."""
    per_domain = domains.groupBy("domain", "root_domain").agg(
        F.sum("occurrence_count").alias("n"), F.count("*").alias("tasks"))
    totals = per_domain.agg(
        F.countDistinct("domain").alias("total_unique_domains"), F.countDistinct("root_domain").alias("unique_root_domains"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_occurrences"), F.count_if(F.col("tasks") >= 2).alias("shared_domains_count"))
    scans = live_tasks(tasks).agg(F.count("*").alias("total_tasks"))
    both = totals.unionByName(scans, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def global_risk_histogram(domains: DataFrame) -> DataFrame:
    """Effective level per domain, then counts of all levels and statuses."""
    per_domain = domains.groupBy("domain").agg(
        effective_risk(F.col("risk_level")).alias("risk_level"), effective_verify(F.col("verify_status")).alias("verify_status"))
    return per_domain.agg(
        *counts_by_value(F.col("risk_level"), v.RISK_LEVELS),
        F.count_if(F.col("risk_level").isin(*v.TOP_RISK_LEVELS)).alias("total_risk"),
        *counts_by_value(F.col("verify_status"), v.VERIFY_STATES, "verify_"))


def top_roots(domains: DataFrame, n: int = 10) -> DataFrame:
    """A15."""
    return (domains.groupBy("root_domain")
            .agg(F.countDistinct("domain").alias("domain_count"), F.sum("occurrence_count").alias("total_occurrences"),
                 F.countDistinct("task_id").alias("task_coverage"))
            .orderBy(F.desc("total_occurrences"), "root_domain").limit(n))


def top_shared_domains(domains: DataFrame, n: int = 10) -> DataFrame:
    """A domain stands once in each scan, so its rows are its scans."""
    return (domains.groupBy("domain")
            .agg(F.max("root_domain").alias("root_domain"), F.count("task_id").alias("task_count"),
                 F.sum("occurrence_count").alias("total_occurrences"))
            .orderBy(F.desc("task_count"), F.desc("total_occurrences"), "domain").limit(n))


def is_pending_ticket() -> Column:
    return F.col("verify_status").isin(*v.OPEN_STATES) & (F.col("manual_status") != "ignored")


def ticket_metrics(tickets: DataFrame, tasks: DataFrame) -> DataFrame:
    """A17."""
    rows = on_live_tasks(tickets, tasks)
    return rows.agg(
        F.count("*").alias("total_items"), F.count_if(is_pending_ticket()).alias("pending_count"),
        F.count_if(F.col("verify_status") == "verified_failed").alias("failed_count"),
        F.count_if(F.col("verify_status") == "unverified").alias("unverified_count"),
        F.count_if(F.col("verify_status").isin(*v.CLOSED_STATES)).alias("clean_count"),
        F.countDistinct(F.when(is_pending_ticket(), F.col("task_id"))).alias("tasks_affected"),
        F.countDistinct("domain").alias("unique_risk_domains"), F.countDistinct("page_url").alias("unique_pages"))


def pending_by_level(tickets: DataFrame, tasks: DataFrame) -> DataFrame:
    """Zero-filled."""
    return on_live_tasks(tickets, tasks).where(is_pending_ticket()).agg(*counts_by_value(F.col("risk_level"), v.RISKY_LEVELS))


def pending_by_task(tickets: DataFrame, tasks: DataFrame, n: int = 20) -> DataFrame:
    """A19."""
    counts = tickets.where(is_pending_ticket()).groupBy("task_id").agg(F.count("*").alias("pending_count"))
    return (on_live_tasks(counts, tasks, "name").select("task_id", F.col("name").alias("task_name"), "pending_count")
            .orderBy(F.desc("pending_count"), "task_id").limit(n))


def root_page_counts(occurrences: DataFrame) -> DataFrame:
    """Exact distinct pages per root; duplicates fall away before the second exchange."""
    return (occurrences.select("root_domain", "page_url").distinct()
            .groupBy("root_domain").agg(F.count("*").alias("page_count")))


def domain_page_counts(occurrences: DataFrame, log2: int = 14) -> DataFrame:
    """Approximate distinct pages per domain (one exchange of sketches, standard error 1.04 / 2**(log2 / 2)).

    With 0.8 percent an estimate lies within five percent of the exact count for any
    number of domains; a sketch is as small as its pages until they are about a thousand.
    """
    return occurrences.groupBy("domain", "root_domain").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("page_url", log2)).alias("page_count"))


def ticket_page_counts(tickets: DataFrame, key: str) -> DataFrame:
    """Distinct ticket pages per `root_domain` or `domain`."""
    return tickets.select(key, "page_url").distinct().groupBy(key).agg(F.count("*").alias("page_count"))


def domain_verdicts(page_results: DataFrame, *key: str) -> DataFrame:
    """Verdict per key over all retested pages with `found` true / false / null."""
    n, still = F.col("tested_count"), F.col("still_present_count")
    counts = page_results.groupBy(*key).agg(
        F.count("url").alias("tested_count"), F.count_if("found").alias("still_present_count"),
        F.count_if(~F.col("found")).alias("cleared_count"),
        F.count_if(F.col("found").isNull() & F.col("url").isNotNull()).alias("error_count"))
    status = (F.when(n == 0, "unverified").when(still > 0, "verified_failed")
              .when(F.col("cleared_count") > 0, "verified_clean").otherwise("error"))
    summary = (F.when(n == 0, F.lit(v.VERDICT_NONE)).when(still > 0, T.fill(v.VERDICT_FAILED, n, still))
               .when(F.col("cleared_count") > 0, T.fill(v.VERDICT_CLEAN, n)).otherwise(T.fill(v.VERDICT_ERROR, n)))
    return counts.withColumn("verify_status", status).withColumn("summary", summary)


def cycle_stats(results: DataFrame) -> DataFrame:
    """Outcome of a retest cycle with repaired and failed percentages."""
    st = F.col("verify_status")
    out = results.agg(
        F.count("*").alias("total_tested"), F.count_if(st == "verified_clean").alias("cleaned_count"),
        F.count_if(st == "verified_failed").alias("failed_count"), F.count_if(st == "page_removed").alias("removed_count"),
        F.count_if(st == "error").alias("error_count"))
    total = F.nullif(F.col("total_tested"), F.lit(0))

    def pct(x):
        return F.coalesce(F.round(100.0 * x / total, 1), F.lit(0.0))
    return (out.withColumn("cleaned_ratio", pct(F.col("cleaned_count") + F.col("removed_count")))
            .withColumn("failed_ratio", pct(F.col("failed_count"))))


def rollback_stats(results: DataFrame) -> DataFrame:
    """A25."""
    st = F.col("verify_status")
    return results.agg(
        F.count("*").alias("total_tested"), F.count_if(st == "verified_clean").alias("clean_preserved"),
        F.count_if(st == "verified_failed").alias("rollback_detected"), F.count_if(st == "page_removed").alias("page_removed"),
        F.count_if(st == "error").alias("error_count"))


def overall_status(verdicts: DataFrame, *key: str) -> DataFrame:
    """One status per key over the scans' verdicts."""
    st = F.col("verify_status")
    return verdicts.groupBy(*key).agg(
        F.count("*").alias("task_count"),
        F.when(F.bool_or(st == "verified_failed"), "verified_failed").when(F.bool_and(st == "verified_clean"), "verified_clean")
        .otherwise("unverified").alias("overall_status"))


def dashboard_totals(tasks: DataFrame) -> DataFrame:
    """A27."""
    return tasks.agg(
        F.count_if(F.col("status") == "running").alias("running_tasks"),
        *[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(f"total_{c}")
          for c in ("pages_crawled", "external_domains_count", "subdomains_count")])


def tasks_by_status(tasks: DataFrame) -> DataFrame:
    """A28."""
    return tasks.groupBy("status").agg(F.count("*").alias("task_count"))


def occurrences_by(domains: DataFrame, key: str) -> DataFrame:
    """Occurrences per root or domain, the last fallback of rule page counts."""
    return domains.groupBy(key).agg(F.sum("occurrence_count").alias("total_occurrences"))


def unresolved_pages(tickets: DataFrame) -> DataFrame:
    """Pages not yet cleared per scan and domain; 0 closes the domain."""
    return tickets.groupBy("task_id", "domain").agg(
        F.count_if(~F.col("verify_status").isin(*v.CLOSED_STATES)).alias("remaining"))


def pages_per_depth(pages: DataFrame) -> DataFrame:
    """G8."""
    return pages.groupBy("task_id", "depth").agg(F.count("*").alias("page_count"))
