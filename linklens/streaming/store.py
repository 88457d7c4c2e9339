"""A log-structured store of tables that micro-batches add to.

    <table>/batch_id=N/     what batch N added; a replay of the batch overwrites it
    commits/batch_id=N/     written last: batch N is complete in all tables
    bases/<table>-<id>/     batches folded into one table by a compaction
    manifest/generation=G/  for each table its base and the first batch after it

The current table is the base of the newest generation and the committed batches from
its first live one on.  A compaction folds the batches that are committed when it
starts, writes new bases and then the next generation; the stream goes on writing
batches meanwhile and needs not know.  Readers that began with the old generation find
its files until `vacuum` deletes them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "table_name STRING, base STRING, first_live BIGINT, generation BIGINT"
COMMIT = "table_name STRING, batch_id BIGINT"
Fold = Callable[[DataFrame], DataFrame]


def write_delta(df: DataFrame, store: str, table: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{store}/{table}/batch_id={batch_id}")


def commit(spark: SparkSession, store: str, tables: list[str], batch_id: int) -> None:
    spark.createDataFrame([(t,) for t in tables], "table_name STRING").coalesce(1).write.mode("overwrite").parquet(f"{store}/commits/batch_id={batch_id}")


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    """A folder that may not be there yet."""
    try:
        return spark.read.schema(schema).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def newest(spark: SparkSession, store: str) -> tuple[int, dict[str, tuple[str, int]]]:
    """The newest generation, and base and first live batch of each table."""
    found = _read(spark, f"{store}/manifest", MANIFEST)
    rows = [] if found is None else found.collect()  # a row for each table and compaction
    last = max((r["generation"] for r in rows), default=-1)
    return last, {r["table_name"]: (r["base"], r["first_live"]) for r in rows if r["generation"] == last}


def live_batches(spark: SparkSession, store: str, table: str, first: int) -> list[int]:
    """Committed batches that no base holds; as many as came since the last compaction."""
    commits = _read(spark, f"{store}/commits", COMMIT)
    if commits is None:
        return []
    return sorted(r[0] for r in commits.where((F.col("table_name") == table) & (F.col("batch_id") >= first)).select("batch_id").distinct().collect())


def _current(spark: SparkSession, store: str, table: str, schema: str, base: tuple[str, int] | None, batches: list[int]) -> DataFrame:
    """Rows of a base and of some batches, with `batch_id` as last column of the schema."""
    out = spark.createDataFrame([], schema) if base is None else spark.read.schema(schema).parquet(f"{store}/bases/{base[0]}")
    if batches:
        paths = [f"{store}/{table}/batch_id={n}" for n in batches]
        out = out.unionByName(spark.read.schema(schema).option("basePath", f"{store}/{table}").parquet(*paths)) if base is not None else (
            spark.read.schema(schema).option("basePath", f"{store}/{table}").parquet(*paths))
    return out


def current(spark: SparkSession, store: str, table: str, schema: str) -> DataFrame:
    """All rows of a table that are committed now, not folded."""
    base = newest(spark, store)[1].get(table)
    return _current(spark, store, table, schema, base, live_batches(spark, store, table, 0 if base is None else base[1]))


def compact(spark: SparkSession, store: str, tables: dict[str, tuple[str, Fold]]) -> int | None:
    """Fold what is committed now into new bases; the new generation, None if there was nothing to fold.

    `tables`: schema and fold of each table.  A fold keeps `batch_id`, so that what is
    folded can be folded again with later batches.
    """
    generation, bases = newest(spark, store)
    live = {t: live_batches(spark, store, t, bases[t][1] if t in bases else 0) for t in tables}
    if not any(live.values()):
        return None
    rows = []
    for table, (schema, fold) in tables.items():
        name = f"{table}-{uuid.uuid4().hex}"
        folded = fold(_current(spark, store, table, schema, bases.get(table), live[table]))
        folded.hint("rebalance").write.parquet(f"{store}/bases/{name}")  # files of the advisory size
        rows.append((table, name, live[table][-1] + 1 if live[table] else bases[table][1] if table in bases else 0))
    # only one of two compactions at the same moment gets its generation
    spark.createDataFrame(rows, MANIFEST.rsplit(",", 1)[0]).coalesce(1).write.mode("error").parquet(f"{store}/manifest/generation={generation + 1}")
    return generation + 1


def vacuum(spark: SparkSession, store: str) -> list[str]:
    """Delete bases of older generations and the batches that the newest one holds."""
    generation, bases = newest(spark, store)
    found = _read(spark, f"{store}/manifest", MANIFEST)
    old = [] if found is None else [r["base"] for r in found.where(F.col("generation") < generation).collect()]
    gone = [f"{store}/bases/{b}" for b in old]
    for table, (_, first) in bases.items():
        gone += [f"{store}/{table}/batch_id={n}" for n in live_batches(spark, store, table, 0) if n < first]
    out = []
    for path in gone:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True):
            out.append(path)
    return out
