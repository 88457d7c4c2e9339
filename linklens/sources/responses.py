"""Stored responses as the input of extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens import fixed_values as v
from linklens.functions import urls as U
from linklens.functions.domains import with_target_root
from linklens.functions.text import html_title
from linklens.schemas import RESPONSES


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The response corpus with its declared schema; column pruning and filters reach the files."""
    return spark.read.format(fmt).schema(RESPONSES).load(path)


def is_text_content(content_type: Column, url: Column) -> Column:
    """Is the body text worth keeping?"""
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    by_type = (ct == "")
    for part in ("text/", "javascript", "ecmascript", "xml", "json"):
        by_type = by_type | ct.contains(part)
    by_path = F.lower(U.raw_path(url)).rlike(r"\.(" + "|".join(v.TEXT_PATH_SUFFIXES) + r")$")
    return by_type | by_path


def keep_text_bodies(responses: DataFrame) -> DataFrame:
    """Blank the body of binary responses."""
    return responses.withColumn("html", F.when(is_text_content(F.col("content_type"), F.col("url")), F.col("html")).otherwise(F.lit("")))


def resource_kind(content_type: Column, url: Column) -> Column:
    """S3: js, css or html - scripts and styles by type or path suffix."""
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    p = F.lower(U.raw_path(url))
    return (F.when(ct.contains("javascript") | ct.contains("ecmascript") | p.endswith(".js"), "js")
            .when(ct.contains("text/css") | p.endswith(".css"), "css").otherwise("html"))


def is_html(content_type: Column) -> Column:
    ct = F.lower(F.coalesce(content_type, F.lit("")))
    return ct.contains("text/html") | ct.contains("application/xhtml")


def guard_assets(responses: DataFrame, max_bytes: int = v.ASSET_BYTES) -> DataFrame:
    """No body for assets that failed or are too large, the reason in `error`."""
    failed = F.col("status_code") != 200
    too_big = F.octet_length("html") > max_bytes
    return responses.withColumn(
        "error", F.when(failed, F.concat(F.lit("HTTP "), F.col("status_code").cast("string")))
        .when(too_big, F.lit(v.ERROR_ASSET_SIZE)).otherwise(F.col("error"))
    ).withColumn("html", F.when(failed | too_big, F.lit("")).otherwise(F.col("html")))


def page_record(responses: DataFrame) -> DataFrame:
    """Page row of a response: path and the title shown for assets."""
    kind = resource_kind(F.col("content_type"), F.col("url"))
    p = U.path(F.col("url"))
    title = F.when(kind == "js", F.concat(F.lit("[JS] "), p)).when(kind == "css", F.concat(F.lit("[CSS] "), p)).otherwise(
        html_title(F.col("html")))
    return responses.select("task_id", U.safe_url(F.col("url")).alias("url"), p.alias("path"), "status_code",
                            "content_type", title.alias("title"), "response_time_ms", "error")


def prepare_pages(responses: DataFrame, tasks: DataFrame) -> DataFrame:
    """Responses with the host of the site they were fetched for, as extraction wants them.

    `tasks` is joined without a hint: Spark broadcasts it only when its size
    statistics are under the threshold.
    """
    sites = with_target_root(tasks.select(F.col("task_id"), U.host(F.col("target_url")).alias("target_host")), "target_host")
    return (
        responses.withColumn("resource", resource_kind(F.col("content_type"), F.col("url")))
        .select("task_id", F.col("url").alias("page_url"), "html", "resource")
        .join(sites, "task_id"))
