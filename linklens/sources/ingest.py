"""Text inputs: robots.txt, sitemaps, seed lists and rule files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens import fixed_values as v
from linklens.functions import urls as U
from linklens.functions.domains import strip
from linklens.operators import graph
from linklens.operators.extract import all_matches, decode_entities
from linklens.operators.merge import keep_first


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files with increasing positions."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), F.col("value").alias("line"))


def robots_sitemaps(robots: DataFrame) -> DataFrame:
    """Urls named in `Sitemap:` lines; `robots` is task_id, body."""
    lines = robots.select("task_id", F.explode(F.split("body", r"\r\n|\r|\n")).alias("line"))
    return lines.select("task_id", strip(F.regexp_extract("line", r"(?i)^\s*sitemap:(.*)$", 1)).alias("url")).where(F.col("url") != "")


def default_sitemaps(tasks: DataFrame) -> DataFrame:
    """Where a site's sitemap usually is."""
    root = F.concat(U.scheme(F.col("target_url")), F.lit("://"), U.netloc(F.col("target_url")))
    paths = F.explode(F.array(*[F.lit(p) for p in ("/sitemap.xml", "/sitemap_index.xml", "/robots.txt")])).alias("p")
    return tasks.select("task_id", root.alias("root"), paths).select("task_id", F.concat("root", "p").alias("url"))


def _locations(xml, parent: str):
    """Texts of parent/loc, whatever the namespace prefix."""
    pattern = rf"(?is)<(?:\w+:)?{parent}\b[^>]*>.*?<(?:\w+:)?loc\b[^>]*>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</(?:\w+:)?loc\s*>"
    return F.filter(F.transform(all_matches(xml, pattern, 1), lambda x: decode_entities(strip(x))), lambda x: x != "")


def sitemap_links(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S6 for one document each: page urls of url sets, child documents of indexes; `documents` is task_id, url, body."""
    d = documents.select("task_id", F.col("url").alias("src"), "body")
    pages = d.select("task_id", "src", F.explode_outer(_locations(F.col("body"), "url")).alias("url")).where(F.col("url").isNotNull())
    children = d.select("task_id", "src", F.explode_outer(_locations(F.col("body"), "sitemap")).alias("dst")).where(F.col("dst").isNotNull())
    return pages, children


def sitemap_urls(candidates: DataFrame, documents: DataFrame) -> DataFrame:
    """Page urls of the candidates and of all indexes below them, each document read once.

    candidates: task_id, url; documents: stored responses task_id, url, status_code, body.
    """
    pages, children = sitemap_links(documents.where(F.col("status_code") == 200).select("task_id", "url", "body"))
    read = graph.walk(candidates.select("task_id", "url", F.lit(0).alias("depth")), children)
    return pages.join(read.select("task_id", F.col("url").alias("src")), ["task_id", "src"], "left_semi").select("task_id", "url").distinct()


def parse_seeds(lines: DataFrame, prefix: str = "") -> DataFrame:
    """Start urls of a seed list (line_no, line): no blanks or # lines, scheme added, first of equal urls."""
    line = strip(F.col("line"))
    rows = lines.select("line_no", line.alias("line")).where((F.col("line") != "") & ~F.col("line").startswith("#"))
    rows = rows.select("line_no", U.ensure_scheme(F.col("line")).alias("target_url"))
    host = F.substring_index(U.netloc(F.col("target_url")), ":", 1)
    host = F.when(host == "", F.col("target_url")).otherwise(host)
    name = F.concat(F.lit(prefix.strip() + "_"), host) if prefix.strip() else F.concat(host, F.lit(v.TASK_NAME_SUFFIX))
    return keep_first(rows, ["target_url"], "line_no").select("line_no", "target_url", name.alias("name"), F.lit("pending").alias("status"))


def parse_rules(lines: DataFrame, source: str = "import") -> DataFrame:
    """Rules of `domain,level,category,tag/tag,remark` lines (line_no, line); comment lines of our own export are skipped."""
    parts = F.split(strip(F.col("line")), ",")

    def part(i):
        return strip(F.coalesce(F.get(parts, F.lit(i)), F.lit("")))
    rows = lines.where(~strip(F.col("line")).startswith("#")).select(
        "line_no", F.lower(part(0)).alias("raw"), part(1).alias("level"), part(2).alias("category"),
        F.filter(F.transform(F.split(part(3), "/"), strip), lambda x: x != "").alias("tags"), part(4).alias("remark"))
    return rows.select(
        "line_no", F.ltrim("raw", F.lit("*.")).alias("domain"),
        F.when(F.col("raw").startswith("*."), "root").otherwise("exact").alias("match_type"),
        F.when(F.col("level") == "", "high").otherwise(F.col("level")).alias("risk_level"),
        "category", "tags", F.lit(source).alias("source"), "remark").where(F.col("domain") != "")
