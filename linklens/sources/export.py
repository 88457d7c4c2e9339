"""Exports (S10-S23): ordered rows with their file layout, and the writers.

Rows are written by all tasks; a range sort keeps part files in order.  JSON is
written as one object per line: a single document would have to be built in one
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens import fixed_values as v
from linklens.functions import text as T
from linklens.functions import urls as U
from linklens.operators import joins as J
from linklens.operators import rollup as R
from linklens.operators import search as S
from linklens.session import numbered

BOM = "﻿"


def _text(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit(""))


def _tags(sep: str, c: str = "risk_tags") -> Column:
    return F.coalesce(F.array_join(c, sep), F.lit(""))


def _or_blank(df: DataFrame, name: str) -> Column:
    return _text(name) if name in df.columns else F.lit("")


def _first(rows: DataFrame, limit: int | None) -> DataFrame:
    return rows if limit is None else rows.limit(limit)


def names_text(rows: DataFrame, name: str = "domain", count: str = "occurrence_count") -> DataFrame:
    """One name per line, most frequent first."""
    return rows.orderBy(F.desc(count), name).select(F.col(name).alias("value"))


def domain_csv(domains: DataFrame) -> DataFrame:
    """S14."""
    rows = domains.orderBy(F.desc("occurrence_count"), "domain")
    return rows.select(
        "domain", "root_domain", "occurrence_count", T.label(F.col("risk_level"), v.RISK_LABELS), _tags(" / "), _or_blank(rows, "risk_remark"),
        T.label(F.col("verify_status"), v.VERIFY_LABELS), _or_blank(rows, "verify_time"), T.yes_no(F.col("has_link")), T.yes_no(F.col("has_text")),
        _text("sample_page_url"), _text("created_at")).toDF(*v.DOMAIN_HEADER)


def json_lines(rows: DataFrame) -> DataFrame:
    """One JSON object per row, nested columns included, in the order of the rows."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def domain_json(domains: DataFrame) -> DataFrame:
    """Most frequent first."""
    return json_lines(domains.orderBy(F.desc("occurrence_count"), "domain"))


def global_json(grouped: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows of rollup.global_domains with their scans nested, most frequent first."""
    return json_lines(_first(S.list_global(grouped), limit))


def export_meta(domains: DataFrame, tasks: DataFrame) -> DataFrame:
    """The head of the JSON export per scan: its url and the number of domains."""
    counts = domains.groupBy("task_id").agg(F.count("*").alias("total_domains"))
    return tasks.select("task_id", "target_url").join(counts, "task_id", "left").na.fill(0, ["total_domains"])


def evidence_rows(occurrences: DataFrame, tasks: DataFrame, domain: str, task_id: int | None = None, limit: int | None = None) -> DataFrame:
    """Evidence of one domain, newest first, with its scan."""
    ev = _first(S.of_task(occurrences, task_id).where(F.col("domain") == domain).orderBy(F.desc("created_at"), F.desc("seq"), "page_url", "task_id"), limit)
    rows = R.on_live_tasks(ev, tasks, "name", "target_url")
    return rows.select("domain", "task_id", "name", "target_url", "source_type", "page_url", "raw_match", "context_snippet",
                       _text("created_at")).toDF(*v.EVIDENCE_HEADER)


def subdomain_csv(subdomains: DataFrame) -> DataFrame:
    """S17."""
    return subdomains.orderBy(F.desc("occurrence_count"), "domain").select(
        "domain", "root_domain", "occurrence_count", T.yes_no(F.col("has_link")), T.yes_no(F.col("has_text")),
        _text("sample_page_url"), _text("created_at")).toDF(*v.SUBDOMAIN_HEADER)


def sitemap_xml(pages: DataFrame) -> DataFrame:
    """Lines of one sitemap document per scan; columns task_id, part, depth, id, line give the order."""
    ct, url = F.lower(F.coalesce("content_type", F.lit(""))), F.lower("url")
    ok = pages.where(F.col("status_code").between(200, 399) & ~ct.contains("javascript") & ~ct.contains("css")
                     & ~url.endswith(".js") & ~url.endswith(".css"))
    day = F.date_format("crawled_at", "yyyy-MM-dd")
    entry = F.concat(F.lit("  <url>\n    <loc>"), T.xml_escape(F.col("url")), F.lit("</loc>\n"),
                     F.when(F.col("crawled_at").isNotNull(), F.concat(F.lit("    <lastmod>"), day, F.lit("</lastmod>\n"))).otherwise(F.lit("")),
                     F.lit("  </url>"))
    scans = pages.select("task_id").distinct()

    def edge(part, lines):
        return scans.select("task_id", F.lit(part).alias("part"), F.lit(-1).alias("depth"), F.lit(-1).cast("long").alias("id"), F.lit("\n".join(lines)).alias("line"))
    body = ok.select("task_id", F.lit(1).alias("part"), "depth", F.col("id").cast("long").alias("id"), entry.alias("line"))
    return edge(0, v.SITEMAP_HEADER).unionByName(body).unionByName(edge(2, v.SITEMAP_FOOTER)).orderBy("task_id", "part", "depth", "id")


def page_csv(pages: DataFrame) -> DataFrame:
    """S19."""
    return pages.orderBy("depth", "id").select("id", "url", "path", "depth", "status_code", _text("title"), _text("crawled_at")).toDF(*v.PAGE_HEADER)


def global_csv(grouped: DataFrame, limit: int | None = None) -> DataFrame:
    """Rows of rollup.global_domains, most frequent first, with the scans as text."""
    rows = _first(S.list_global(grouped), limit)
    summary = F.array_join(F.transform("associated_tasks", lambda x: T.fill(
        v.TASK_SUMMARY, x["task_name"], x["task_id"], x["occurrence_count"])), " | ")
    tags = F.array_join(T.decode_tags(F.col("risk_tags")), " / ") if "risk_tags" in rows.columns else F.lit("")
    return rows.select(
        "domain", "root_domain", T.label(F.col("risk_level"), v.RISK_LABELS), tags, _or_blank(rows, "risk_remark"),
        T.label(F.col("verify_status"), v.VERIFY_LABELS), _or_blank(rows, "verify_time"), "total_occurrences", "task_count",
        T.yes_no(F.col("has_link")), T.yes_no(F.col("has_text")), _text("first_seen_at"), _text("last_seen_at"), _text("sample_page_url"),
        summary).toDF(*v.GLOBAL_HEADER)


def cross_task_csv(domains: DataFrame, tasks: DataFrame, occurrences: DataFrame) -> DataFrame:
    """One row per evidence, one summary row for scans without any."""
    rows = J.evidence_per_task(domains, tasks, occurrences, per_task=None)
    return rows.select(
        "domain", "root_domain", "task_id", "name", "target_url", "status", "occurrence_count", T.yes_no(F.col("has_link")), T.yes_no(F.col("has_text")),
        _text("sample_page_url"), _text("source_type"), _text("page_url"), _text("raw_match"), _text("context_snippet"),
        _text(F.coalesce("evidence_at", "created_at"))).toDF(*v.CROSS_TASK_HEADER)


def ticket_csv(tickets: DataFrame, tasks: DataFrame, task_id: int | None = None, verify_status: str | None = "pending_only",
               risk_level: str | None = None) -> DataFrame:
    """Numbered over (task, level, id)."""
    status = None if verify_status == "all" else verify_status
    level = None if risk_level == "all_risk" else risk_level
    rows = S.filter_tickets(tickets, tasks, task_id=task_id, verify_status=status, risk_level=level)
    rows = numbered(rows, "no", "task_id", "risk_level", "id")
    return rows.orderBy("no").select(
        "no", "task_id", "task_name", "target_site_url", "page_url", _or_blank(rows, "page_title"), "domain", "root_domain",
        T.label(F.col("risk_level"), v.TICKET_RISK_LABELS), _tags("、"), _or_blank(rows, "risk_remark"), "source_type", _text("context_snippet"),
        T.label(F.col("verify_status"), v.TICKET_VERIFY_LABELS), _text("last_verified_at"), _or_blank(rows, "last_verify_detail"),
        "manual_status", T.remediation_guide(F.col("source_type"), F.col("domain"))).toDF(*v.TICKET_HEADER)


def rule_text(rules: DataFrame) -> DataFrame:
    """The lines ingest.parse_rules reads back, newest rule first."""
    def plain(c):
        return F.btrim(F.replace(F.translate(F.coalesce(c, F.lit("")), "\r\n", "  "), F.lit(","), F.lit("，")))
    tags = F.array_join(F.filter(F.transform("tags", lambda t: F.replace(F.btrim(t), F.lit(","), F.lit("，"))), lambda t: t != ""), "/")
    name = F.btrim("domain")
    line = F.concat_ws(",", F.when(F.col("match_type") == "root", F.concat(F.lit("*."), name)).otherwise(name),
                       F.coalesce(F.nullif("risk_level", F.lit("")), F.lit("high")), plain(F.col("category")), tags, plain(F.col("remark")))
    return rules.where(name != "").orderBy(F.desc("id")).select(line.alias("value"))


def evidence_batch(hits: DataFrame, run_ts: Column) -> DataFrame:
    """Evidence rows as stored: texts cut, id from the natural key, month for the partition."""
    return hits.select(
        T.evidence_id().alias("id"), "task_id", "domain", "root_domain",
        "page_url", "seq", "source_type", T.cut_raw_match(F.col("raw_match")).alias("raw_match"), T.cut_snippet(F.col("context_snippet")).alias("context_snippet"),
        "is_link", run_ts.alias("created_at"), F.date_format(run_ts, "yyyyMM").alias("month"))


def page_batch(pages: DataFrame) -> DataFrame:
    """Page rows as stored (upsert: merge.merge_pages)."""
    return pages.withColumn("url", U.safe_url(F.col("url"))).withColumn("month", F.date_format("crawled_at", "yyyyMM"))


def log_batch(logs: DataFrame) -> DataFrame:
    """Levels in upper case, month for the partition."""
    return logs.withColumn("level", T.log_level(F.col("level"))).withColumn("month", F.date_format("created_at", "yyyyMM"))


def append(df: DataFrame, path: str) -> None:
    """Append partitioned by month; rows of a scan stay together inside a file for min/max skipping."""
    df.sortWithinPartitions("task_id").write.mode("append").partitionBy("month").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with header and a byte order mark at the head of each part."""
    df.withColumnRenamed(df.columns[0], BOM + df.columns[0]).write.mode("overwrite").csv(path, header=True, escape='"')


def write_lines(df: DataFrame, path: str) -> None:
    df.select(df.columns[-1]).write.mode("overwrite").text(path)
