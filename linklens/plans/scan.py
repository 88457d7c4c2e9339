"""Plans that chain operators: responses -> evidence -> domains -> risk -> tickets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.functions import text as T
from linklens.operators import extract as X
from linklens.operators import risk as K
from linklens.operators import rollup as R


def site_domains(hits: DataFrame, rules: DataFrame, run_ts: Column) -> DataFrame:
    """External domains of a scan with their risk, as first inserted."""
    rolled = R.domain_rollup(hits.where(F.col("side") == "external"))
    rated = K.evaluate_rollup(rolled, rules).withColumn("verify_status", F.lit("unverified")).withColumn("created_at", run_ts)
    return with_domain_id(rated)


def with_domain_id(rows: DataFrame) -> DataFrame:
    """Stable id of a scan's domain."""
    return rows.select(T.row_id(F.col("task_id"), F.col("domain")).alias("id"), *rows.columns)


def site_subdomains(hits: DataFrame, run_ts: Column) -> DataFrame:
    return with_domain_id(R.domain_rollup(hits.where(F.col("side") == "subdomain")).withColumn("created_at", run_ts))


def site_evidence(hits: DataFrame, run_ts: Column, per_domain: int | None = None) -> DataFrame:
    """Evidence rows to append: at most `per_domain` of each page and domain (None: all), texts cut, stable ids."""
    kept = hits if per_domain is None else X.cap_evidence(hits, per_domain)
    return kept.select(
        T.evidence_id("fetch").alias("id"), "task_id", "domain", "root_domain", "page_url", F.lit("").alias("page_title"), "seq", "source_type",
        T.cut_raw_match(F.col("raw_match")).alias("raw_match"), T.cut_snippet(F.col("context_snippet")).alias("context_snippet"),
        "is_link", run_ts.alias("created_at"))


HITS = ("task_id INT, page_url STRING, domain STRING, root_domain STRING, source_type STRING, raw_match STRING, "
        "context_snippet STRING, is_link BOOLEAN, seq BIGINT, fetch BIGINT, side STRING")


def fetched_hits(pages: DataFrame) -> DataFrame:
    """Hits with the fingerprint of the page as fetched, so that a url a scan has stored twice gives two identities."""
    return X.extract_hits(pages.withColumn("fetch", F.xxhash64("html")), keep=("fetch",))


def write_scan(pages: DataFrame, rules: DataFrame, run_ts: Column, folder: str,
               per_domain: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Batch job: hits written once, then external domains, subdomains and evidence over the written table.

    The pages are parsed a single time although three tables follow from them;
    each of these reads only the columns and the side it needs.
    """
    fetched_hits(pages).write.mode("overwrite").partitionBy("side").parquet(f"{folder}/hits")
    hits = pages.sparkSession.read.schema(HITS).parquet(f"{folder}/hits")
    return site_domains(hits, rules, run_ts), site_subdomains(hits, run_ts), site_evidence(hits, run_ts, per_domain)


def risky_domains(pages: DataFrame, rules: DataFrame, n: int | None = None) -> DataFrame:
    """Flagship: from stored pages to the cross-scan list of external domains with their risk.

    Two roll-ups (scan and domain, then domain), one rule match per distinct
    domain; with `n` a distributed top-n at the end.
    """
    hits = X.extract_hits(pages, snippets=False).where(F.col("side") == "external")
    per_task = hits.groupBy("task_id", "domain", "root_domain").agg(
        F.count("*").alias("occurrence_count"), F.bool_or("is_link").alias("has_link"), F.bool_or(~F.col("is_link")).alias("has_text"))
    per_domain = per_task.groupBy("domain", "root_domain").agg(
        F.sum("occurrence_count").alias("total_occurrences"), F.count("*").alias("task_count"),
        F.bool_or("has_link").alias("has_link"), F.bool_or("has_text").alias("has_text"))
    listed = K.evaluate_rollup(per_domain, rules)
    rows = listed.select("domain", "root_domain", "total_occurrences", "task_count", "has_link", "has_text", "risk_level")
    rows = rows.orderBy(F.desc("total_occurrences"), "domain")
    return rows if n is None else rows.limit(n)
