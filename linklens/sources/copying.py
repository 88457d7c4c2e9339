"""Bulk copy between stores."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.functions import domains as D
from linklens.functions import text as T
from linklens.functions import urls as U
from linklens.operators.merge import keep_first

#: A range of ids; a mark says that the range is copied below `done_until`, and which attempt holds the last part.
RANGES = "range_no INT, low BIGINT, high BIGINT"
MARKS = "range_no INT, done_until BIGINT, row_count BIGINT, seconds DOUBLE, attempt STRING, step INT"


def read_jdbc(spark: SparkSession, url: str, table: str, upper_id: int, parts: int, **options) -> DataFrame:
    """A table read by id ranges in parallel."""
    return (spark.read.format("jdbc").option("url", url).option("dbtable", table).option("partitionColumn", "id")
            .option("lowerBound", 0).option("upperBound", upper_id).option("numPartitions", parts).options(**options).load())


def without_nul(df: DataFrame) -> DataFrame:
    return df.withColumns({f.name: F.replace(F.col(f.name), F.lit("\x00"), F.lit("")) for f in df.schema if f.dataType.typeName() == "string"})


def rows_to_copy(source: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Rows after the target's last id whose key is not there yet, cleaned.

    The last id is one number, looked up first so that it becomes a pushed-down filter.
    """
    last = target.agg(F.max("id")).first()[0]
    rows = source if last is None else source.where(F.col("id") > last)
    rows = without_nul(rows)
    if "url" in rows.columns:
        rows = rows.withColumn("url", U.safe_url(F.col("url")))
    return keep_first(rows, key, "id").join(target.select(*key), key, "left_anti").select(*source.columns)


@dataclass(frozen=True)
class RangedCopy:
    """S24 for a large table: ranges of ids copied side by side, each with its own high-water mark.

    A step copies the next `chunk` ids of every range that isn't finished, in one job,
    and then writes the marks.  What a broken step wrote is named by no mark and is
    never read.  A copy that goes on later, in another session too, only reads the ids
    above the marks.

        ranges/     the plan
        data/<attempt>/range_no=R/      rows
        marks/step=S/       marks of the ranges that step S has moved
    """

    source: DataFrame
    folder: str

    @property
    def spark(self) -> SparkSession:
        return self.source.sparkSession

    def ranges(self, parts: int = 16) -> dict[int, tuple[int, int]]:
        """Number to bounds (upper one exclusive); planned once, from the ids that there are then."""
        try:
            rows = self.spark.read.schema(RANGES).parquet(f"{self.folder}/ranges").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            low, high = self.source.agg(F.min("id"), F.max("id")).first()
            width = 0 if low is None else -(-(high - low + 1) // parts)
            plan = [] if low is None else [(i, low + i * width, min(low + (i + 1) * width, high + 1)) for i in range(parts) if low + i * width <= high]
            rows = self.spark.createDataFrame(plan, RANGES).coalesce(1)
            rows.write.parquet(f"{self.folder}/ranges")
            rows = rows.collect()
        return {r["range_no"]: (r["low"], r["high"]) for r in rows}

    def marks(self) -> DataFrame:
        """One row for each step and range that it moved."""
        try:
            return self.spark.read.schema(MARKS).parquet(f"{self.folder}/marks")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], MARKS)

    def unfinished(self) -> dict[int, tuple[int, int]]:
        """What is left of each range."""
        done = {r["range_no"]: r["m"] for r in self.marks().groupBy("range_no").agg(F.max("done_until").alias("m")).collect()}  # as many as ranges
        left = {n: (max(low, done.get(n, low)), high) for n, (low, high) in self.ranges().items()}
        return {n: (low, high) for n, (low, high) in left.items() if low < high}

    def step(self, chunk: int, only: list[int] | None = None) -> bool:
        """Copy the next ids of the unfinished ranges (of some of them); False if there were none."""
        todo = {n: (low, min(low + chunk, high)) for n, (low, high) in self.unfinished().items() if only is None or n in only}
        if not todo:
            return False
        start, attempt = time.perf_counter(), uuid.uuid4().hex
        number, within = F.lit(None).cast("int"), F.lit(False)
        for n, (low, high) in todo.items():
            here = (F.col("id") >= low) & (F.col("id") < high)
            number, within = F.when(here, n).otherwise(number), within | here
        rows = without_nul(self.source.where(within)).withColumn("range_no", number)
        place = f"{self.folder}/data/{attempt}"
        rows.write.partitionBy("range_no").parquet(place)
        counts = self.spark.read.schema("range_no INT").option("basePath", place).parquet(place).groupBy("range_no").count().collect()
        seconds, held = time.perf_counter() - start, {r["range_no"]: r["count"] for r in counts}
        moved = [(n, high, held.get(n, 0), seconds / len(todo), attempt) for n, (_, high) in todo.items()]
        last = self.marks().agg(F.max("step")).first()[0]
        marks = self.spark.createDataFrame(moved, MARKS.rsplit(",", 1)[0]).coalesce(1)
        marks.write.mode("error").parquet(f"{self.folder}/marks/step={0 if last is None else last + 1}")
        return True

    def run(self, chunk: int, steps: int | None = None, only: list[int] | None = None) -> None:
        """Go on until everything is copied, or for a number of steps."""
        while (steps is None or steps > 0) and self.step(chunk, only):
            steps = None if steps is None else steps - 1

    def copied(self) -> DataFrame:
        """All rows that a mark names."""
        marks = self.marks().where("row_count > 0").select("attempt", "range_no").collect()  # ranges times steps
        paths = [f"{self.folder}/data/{r['attempt']}/range_no={r['range_no']}" for r in marks]
        if not paths:
            return self.source.limit(0)
        return self.spark.read.schema(self.source.schema).parquet(*paths)

    def report(self) -> DataFrame:
        """Rows, finished or not, and rows a second of each range."""
        done = self.marks().groupBy("range_no").agg(F.sum("row_count").alias("row_count"), F.max("done_until").alias("done_until"), F.sum("seconds").alias("seconds"))
        plan = self.spark.read.schema(RANGES).parquet(f"{self.folder}/ranges")
        rows = F.coalesce("row_count", F.lit(0))
        return plan.join(done, "range_no", "left").select("range_no", "low", "high", rows.alias("row_count"),
                                                          F.coalesce(F.col("done_until") >= F.col("high"), F.lit(False)).alias("finished"), (rows / F.col("seconds")).alias("rows_per_second"))


def compare_counts(pairs: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Rows per table on both sides."""
    out = None
    for name, (source, target) in pairs.items():
        both = source.select(F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(target.select(F.lit(0).alias("s"), F.lit(1).alias("t")))
        one = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("source_rows"), F.coalesce(F.sum("t"), F.lit(0)).alias("target_rows"))
        one = one.select(F.lit(name).alias("table_name"), "source_rows", "target_rows", (F.col("source_rows") == F.col("target_rows")).alias("same"))
        out = one if out is None else out.unionByName(one)
    return out


def reshape_evidence(rows: DataFrame, run_ts: Column) -> DataFrame:
    """Evidence for the columnar store: last-two-label root, coarse link flag, parsed time, no nulls."""
    def text(c):
        return F.coalesce(F.col(c), F.lit(""))
    return rows.select(
        "id", "task_id", text("domain").alias("domain"), D.naive_root(text("domain")).alias("root_domain"), text("page_url").alias("page_url"),
        F.lit("").alias("page_title"), text("source_type").alias("source_type"), T.cut_raw_match(text("raw_match")).alias("raw_match"),
        T.cut_snippet(text("context_snippet")).alias("context_snippet"), T.olap_link_flag(F.col("source_type")).alias("is_link"),
        T.parse_time(F.col("created_at").cast("string"), run_ts).alias("created_at"))


def reshape_pages(rows: DataFrame, run_ts: Column) -> DataFrame:
    """Pages without nulls."""
    def text(c, default=""):
        return F.coalesce(F.nullif(c, F.lit("")), F.lit(default)).alias(c)

    def number(c):
        return F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c)
    have = set(rows.columns)
    texts = [text(c, "/" if c == "path" else "") for c in ("url", "path", "content_type", "title", "error") if c in have]
    numbers = [number(c) for c in ("depth", "status_code", "response_time_ms", "external_domains_count") if c in have]
    return rows.select("id", "task_id", *texts, *numbers, T.parse_time(F.col("crawled_at").cast("string"), run_ts).alias("crawled_at"))


def reshape_logs(rows: DataFrame, run_ts: Column) -> DataFrame:
    """Logs with upper-case levels."""
    return rows.select("id", "task_id", T.log_level(F.nullif("level", F.lit(""))).alias("level"), F.coalesce("message", F.lit("")).alias("message"),
                       T.parse_time(F.col("created_at").cast("string"), run_ts).alias("created_at"))
