"""Breadth-first walk over the stored link graph.

A driver loop of joins, one per level.  Links and reached urls are stored tables,
bucketed alike by (task_id, url): only the urls that a level finds are shuffled, links
and reached urls never are.  Reached urls are appended level by level.  While a level
is small, the buckets without one of its urls are not read, so a long chain costs as
much as it has links, not as often as it has levels.  Every level is written out, and a
lost executor costs a part of one level.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.functions import domains as D
from linklens.functions import public_suffix as ps
from linklens.functions import urls as U
from linklens.operators import rollup as R
from linklens.session import ensure_checkpoint_dir

KEY = ["task_id", "url"]


def new_urls(found: DataFrame, known: DataFrame) -> DataFrame:
    """Found urls that are not known yet."""
    return found.select(*KEY).distinct().join(known.select(*KEY), KEY, "left_anti")


#: Rows of a level up to which it is sent to all tasks, and only its buckets are read.
SMALL = 10_000


class Bucketed:
    """A stored table bucketed by KEY, in the folder of spark.checkpoint.dir; the catalog knows it until `close`."""

    def __init__(self, spark, buckets: int, name: str):
        self.spark, self.buckets = spark, buckets
        self.name = f"{name}_{uuid.uuid4().hex}"
        self.folder = f"{ensure_checkpoint_dir(spark)}/{self.name}"

    def append(self, df: DataFrame, *parts: str) -> None:
        """Rows as one file for each bucket they have (and each value of `parts`)."""
        writer = df.repartition(self.buckets, *KEY).write.mode("append").option("path", self.folder)
        writer = writer.partitionBy(*parts) if parts else writer
        writer.bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(self.name)

    def whole(self) -> DataFrame:
        return self.spark.table(self.name)

    def bucket(self):
        """The bucket that Spark puts a row in."""
        return F.pmod(F.hash(*KEY), F.lit(self.buckets))

    def some(self, buckets: set[int]) -> DataFrame:
        """The rows of some buckets; the others' files are not read."""
        whole = self.whole()
        files = [f for f in whole.inputFiles() if int(re.search(r"_(\d{5,})\.c\d+", f).group(1)) in buckets]
        if not files:
            return whole.limit(0)
        return self.spark.read.schema(whole.schema).option("basePath", self.folder).parquet(*files)

    def close(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")  # external: the files stay


def found_from(links: Bucketed, level: DataFrame, rows: int, buckets: set[int]) -> DataFrame:
    """Urls that a level links to."""
    if rows <= SMALL:
        return links.some(buckets).join(F.broadcast(level.select(*KEY)), KEY).select("task_id", F.col("dst").alias("url"))
    return links.whole().join(level.select(*KEY), KEY).select("task_id", F.col("dst").alias("url"))


def not_reached(found: DataFrame, reached: Bucketed, rows: int | None, buckets: set[int] = frozenset()) -> DataFrame:
    """Distinct found urls that no level holds; `rows` and buckets of `found` if it is stored."""
    if rows is None or rows > SMALL:
        return found.select(*KEY).distinct().join(reached.whole().select(*KEY), KEY, "left_anti")
    seen = reached.some(buckets).select(*KEY).join(F.broadcast(found), KEY, "left_semi")
    return found.join(F.broadcast(seen), KEY, "left_anti")


def measured(df: DataFrame, table: Bucketed) -> tuple[int, set[int]]:
    """Rows and buckets of a stored level; as many numbers as there are buckets."""
    counts = df.groupBy(table.bucket().alias("b")).count().collect()
    return sum(r["count"] for r in counts), {r["b"] for r in counts}


def walk(seeds: DataFrame, edges: DataFrame, max_depth: int = 0, max_pages: int = 0) -> DataFrame:
    """Urls with their depth.

    seeds: task_id, url, depth; edges: task_id, src, dst.  `max_depth` 0 means no
    limit.  `max_pages` keeps the first pages of each scan by (depth, url).
    """
    spark = seeds.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    links, reached, starts = (Bucketed(spark, buckets, n) for n in ("links", "reached", "starts"))
    try:
        # dealt by source first, then distinct: the page's links are together anyway
        links.append(edges.select("task_id", F.col("src").alias("url"), "dst").repartition(buckets, *KEY).dropDuplicates(["task_id", "url", "dst"]))
        # seeds may start at different depths (site root 0, sitemap urls 1)
        starts.append(seeds.groupBy(*KEY).agg(F.min("depth").cast("int").alias("depth")))
        depths = sorted(r["depth"] for r in starts.whole().select("depth").distinct().collect())  # a handful of start depths
        reached.append(starts.whole().limit(0), "depth")
        frontier, rows, depth = None, 0, depths[0] if depths else 0
        while True:
            level, stored, held = None, None, set()
            if rows:
                level = found_from(links, frontier, rows, own)
                if rows <= SMALL:  # its size decides how the reached urls are read
                    step = f"{reached.folder}-found/depth={depth}"
                    level.distinct().write.parquet(step)
                    level = spark.read.schema(level.schema).parquet(step)
                    stored, held = measured(level, reached)
            if depth in depths:
                start = starts.whole().where(F.col("depth") == depth).select(*KEY)
                level, stored = start if level is None else level.unionByName(start), None
            if level is not None:
                new = not_reached(level, reached, stored, held)
                reached.append(new.withColumn("depth", F.lit(depth)), "depth")
            frontier = reached.whole().where(F.col("depth") == depth)
            rows, own = measured(frontier, reached) if level is not None else (0, set())
            waiting = any(d > depth for d in depths)
            if (not rows and not waiting) or (max_depth and depth >= max_depth):
                break
            if max_pages and not waiting and _all_full(reached.whole(), max_pages):
                break
            depth += 1
        out = spark.read.schema(reached.whole().schema).parquet(reached.folder)
    finally:
        for table in (links, reached, starts):
            table.close()
    if max_depth:
        out = out.where(F.col("depth") <= max(max_depth, *depths, 0))
    if max_pages:
        out = R.top_per_task(out, max_pages, F.asc("depth"), F.asc("url")).drop("rank")
    return out


def _all_full(reached: DataFrame, max_pages: int) -> bool:
    counts = reached.groupBy("task_id").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") < max_pages).isEmpty()


def reach_assets(pages: DataFrame, asset_edges: DataFrame, import_edges: DataFrame) -> DataFrame:
    """Each asset once per scan with the smallest depth of a page using it, imports included.

    pages: task_id, url, depth; edges: task_id, src, dst.  Imported style sheets take
    the depth of the importing one.  Rounds only append what they found or found at a
    smaller depth, until one finds nothing; the smallest depth of each is taken once, at
    the end.  Imports are stored once each and bucketed like the assets found, so no
    round shuffles them.
    """
    buckets = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    imports, reached = (Bucketed(pages.sparkSession, buckets, n) for n in ("imports", "assets"))

    def step(edges: DataFrame, level: DataFrame) -> DataFrame:
        return edges.join(level, KEY).groupBy("task_id", F.col("dst").alias("url")).agg(F.min("depth").alias("depth"))

    def links(edges: DataFrame) -> DataFrame:
        return edges.select("task_id", F.col("src").alias("url"), "dst")

    try:
        imports.append(links(import_edges).distinct())
        reached.append(step(links(asset_edges), pages.select(*KEY, "depth")).withColumn("round", F.lit(0)), "round")
        n = 0
        while not (frontier := reached.whole().where(F.col("round") == n).select(*KEY, "depth")).isEmpty():
            found = step(imports.whole(), frontier)
            known = reached.whole().groupBy(*KEY).agg(F.min("depth").alias("known"))
            better = found.join(known, KEY, "left").where(F.col("known").isNull() | (F.col("depth") < F.col("known")))
            n += 1
            reached.append(better.select(*KEY, "depth", F.lit(n).alias("round")), "round")
        out = pages.sparkSession.read.schema(reached.whole().schema).parquet(reached.folder)
    finally:
        for table in (imports, reached):
            table.close()
    return out.groupBy(*KEY).agg(F.min("depth").alias("depth"))


def seeds_with_sitemap(tasks: DataFrame, sitemap_urls: DataFrame) -> DataFrame:
    """Start urls at depth 0 and the site's own sitemap urls at depth 1.

    tasks: task_id, target_url; sitemap_urls: task_id, url.
    """
    start = tasks.select("task_id", F.col("target_url").alias("url"), F.lit(0).alias("depth"))
    sites = D.with_target_root(tasks.select("task_id", U.host(F.col("target_url")).alias("target_host")), "target_host")
    found = sitemap_urls.join(sites, "task_id").withColumn("h", U.host(F.col("url"))).withColumn("n", ps.suffix_length("h"))
    found = D.sealed(found.withColumn("r", ps.root_from_suffix_length("h", "n")), "r")
    own = found.where(D.is_internal(F.col("h"), F.col("r"), F.col("target_host"), F.col("target_root")))
    return start.unionByName(own.select("task_id", "url", F.lit(1).alias("depth")))
