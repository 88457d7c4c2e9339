"""Session helpers."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Bytes of files, and of small shuffle partitions put together, up to which one task takes them.
TASK_BYTES = 8 << 20
BOUNDS = ["spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"]


def bound_tasks(spark: SparkSession) -> None:
    """Let no task take more than 8 MB of files or of small shuffle partitions; smaller settings of the session stay.

    Spark's 64 MB and 128 MB are bytes as compressed.  Sorted for a join or aggregated in
    the same task they are fifteen times as much memory and more, on each core of an executor.
    """
    for name in BOUNDS:
        number, unit = re.fullmatch(r"(\d+)([a-z]?)b?", spark.conf.get(name).strip().lower()).groups()
        if int(number) << {"k": 10, "m": 20, "g": 30, "t": 40}.get(unit, 0) > TASK_BYTES:
            spark.conf.set(name, str(TASK_BYTES))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Directory for reliable checkpoints, as the session names it in spark.checkpoint.dir.

    Only a local session without the setting (tests) gets a directory of its own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    current = spark.sparkContext.getCheckpointDir()
    if configured:
        if current is None:
            spark.sparkContext.setCheckpointDir(configured)
        return configured
    if current is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="linklens-checkpoint-"))
    return spark.sparkContext.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Has Spark delete the shuffle files of a query when the query ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """As `checkpointed`, for tables too large for it: compressed columns, and the shuffle files it took go once it is written.

    A Parquet table in the folder of spark.checkpoint.dir, which can be deleted when the application has ended.
    """
    spark = df.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/tables-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(folder)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(folder)


def delete_stored(df: DataFrame) -> None:
    """Delete a table of `stored` that nothing will read any more."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(spark.sparkContext._jvm.java.net.URI(folder))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """Consecutive numbers 1.. over a total order without a single-task window.

    Range-partition and sort, fix the partitions with a checkpoint, count each
    partition and add the running offset.  Only the counts, one row per
    partition, meet in one place.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    ranged = checkpointed(ranged.withColumn("__p", F.spark_partition_id()).withColumn(
        "__i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))))
    counts = ranged.groupBy("__p").agg(F.count("*").alias("__n"))
    running = F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__p", F.coalesce(running, F.lit(0)).alias("__o"))
    out = ranged.join(F.broadcast(offsets), "__p")  # one row per shuffle partition
    return out.select((F.col("__o") + F.col("__i") + 1).alias(name), *df.columns)
