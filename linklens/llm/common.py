"""Helpers that several operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.session import ensure_checkpoint_dir

#: White space of the word and text rules, as a character class body.
BLANK = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """Each stored row with a key of its own: repeated rows and ids stay apart.

    The key is the position in one execution's scan.  Another execution may split the
    files elsewhere, so what is scanned more than once takes its keys from `placed`.
    """
    return docs.select(F.monotonically_increasing_id().alias("row"), *columns)


def on_disk(docs: DataFrame) -> DataFrame:
    """The table itself if it is a plain scan of Parquet files, else a stored copy."""
    plan = docs._jdf.queryExecution().analyzed().toString().strip()
    return docs if plan.startswith("Relation [") and plan.endswith(" parquet") and "\n" not in plan else stored(docs, "copy")


def placed(docs: DataFrame, *columns: str | Column) -> DataFrame:
    """As `keyed`, with a key that all executions agree on: the number of the row's file and its place there.

    Of a table that isn't on disk a copy is made; who calls this more than once passes one `on_disk`.
    """
    docs = on_disk(docs)
    path = F.col("_metadata.file_path").alias("path")
    files = sorted(r.path for r in docs.select(path).distinct().collect())  # as many as the driver has listed for the scan
    numbers = docs.sparkSession.createDataFrame(list(enumerate(files)), "file long, path string")
    rows = docs.select(path, F.col("_metadata.row_index").alias("place"), F.struct(*columns).alias("columns"))
    key = (F.shiftleft("file", 40) + F.col("place")).alias("row")
    return rows.join(F.broadcast(numbers), "path").select(key, "columns.*")


def text_of(docs: DataFrame) -> DataFrame:
    """row, doc_id, text; a null text is empty, other columns are left out."""
    return keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def placed_texts(docs: DataFrame) -> DataFrame:
    """As `text_of`, with the keys of `placed`."""
    return placed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def keep_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of a table on disk whose keys (of `placed`) `rows` lists, with all their columns."""
    whole = placed(docs, F.struct("*").alias("whole"))  # a column of the table may be called row as well
    return whole.join(rows.select("row"), "row", "left_semi").select("whole.*")


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder of spark.checkpoint.dir; survives lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the value as text, modulo n; null stays null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def stored(df: DataFrame, name: str) -> DataFrame:
    """A table written to the folder of spark.checkpoint.dir and read again: cuts lineage as a checkpoint does, compressed.

    The folder is one for each application; it can be deleted when the application has ended.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/tables-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)
