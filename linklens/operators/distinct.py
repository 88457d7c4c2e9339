"""Distinct counts that are kept and merged: exact ones as bitmaps over integer ids, approximate ones as sketches.

A day's rows give one small table of bitmaps or sketches; tables of days are merged
without the rows.  Bitmaps have 4 KB for each 32,768 ids of a group, so they are for
counts over few groups (a whole store, the largest roots); for a count of each of many
groups take the sketches, which are small for small groups.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.session import numbered

IDS = "value STRING, id BIGINT"


@dataclass(frozen=True)
class ValueIds:
    """A stored dictionary of values and dense ids from 1 on; ids never change, new values get the following ones."""

    spark: SparkSession
    folder: str

    def table(self) -> DataFrame:
        try:
            return self.spark.read.schema(IDS).parquet(f"{self.folder}/ids")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], IDS)

    def extend(self, values: Column, rows: DataFrame) -> None:
        """Give an id to every value that has none; numbered by a range sort, not in one task."""
        known = self.table()
        last = known.agg(F.max("id")).first()[0] or 0
        new = rows.select(values.cast("string").alias("value")).where("value is not null").distinct().join(known.select("value"), "value", "left_anti")
        out = numbered(new, "no", "value").select("value", (F.col("no") + last).alias("id"))
        out.write.parquet(f"{self.folder}/ids/added={last}-{uuid.uuid4().hex}")

    def of(self, rows: DataFrame, column: str, name: str) -> DataFrame:
        """`rows` with the id of a column; all its values must be known."""
        return rows.join(self.table().select(F.col("value").alias(column), F.col("id").alias(name)), column, "left")


def bitmaps(rows: DataFrame, ids: dict[str, str], *group: str) -> DataFrame:
    """group, kind, bucket, bitmap: for each kind of `ids` (name to id column) the ids that occur.

    One pass: a row gives one small struct for each kind, and tasks combine bitmaps
    before the shuffle.
    """
    each = F.explode(F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(column).alias("id")) for kind, column in ids.items()]))
    one = rows.select(*group, each.alias("e")).select(*group, "e.kind", "e.id").where("id is not null")
    return one.groupBy(*group, "kind", F.bitmap_bucket_number("id").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("id")).alias("bitmap"))


def merged_counts(days: DataFrame, *group: str) -> DataFrame:
    """Distinct ids of each group and kind over the bitmaps of any number of days."""
    whole = days.groupBy(*group, "kind", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    return whole.groupBy(*group, "kind").agg(F.sum(F.bitmap_count("bitmap")).alias("n"))


def by_kind(counts: DataFrame, names: dict[str, str], *group: str) -> DataFrame:
    """One column for each kind; 0 where a kind has no ids."""
    columns = [F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(name) for kind, name in names.items()]
    return counts.groupBy(*group).agg(*columns) if group else counts.agg(*columns)


def sketches(rows: DataFrame, value: str, *group: str, log2: int = 12) -> DataFrame:
    """group, sketch: mergeable sketches of a value, standard error 1.04 / 2**(log2 / 2)."""
    return rows.groupBy(*group).agg(F.hll_sketch_agg(value, log2).alias("sketch"))


def estimates(days: DataFrame, name: str, *group: str) -> DataFrame:
    """Estimated distinct values of each group over the sketches of any number of days."""
    return days.groupBy(*group).agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias(name))


def identity(*key: str) -> Column:
    """128-bit identity of a natural key as 32 hexadecimal digits.

    Nulls, empty texts and separators inside of values can't make two keys alike.
    """
    return F.md5(F.to_json(F.struct(*[F.col(c).cast("string").alias(f"k{i}") for i, c in enumerate(key)]), {"ignoreNullFields": "false"}))


def identity_report(rows: DataFrame, key: list[str], id_column: str) -> DataFrame:
    """Distinct keys, distinct ids, and keys that share an id with another one (collisions)."""
    pairs = rows.select(*key, id_column).distinct()
    shared = pairs.groupBy(id_column).agg(F.count("*").alias("keys"))
    return shared.agg(F.coalesce(F.sum("keys"), F.lit(0)).alias("distinct_keys"), F.count("*").alias("distinct_ids"),
                      F.coalesce(F.sum(F.when(F.col("keys") > 1, F.col("keys"))), F.lit(0)).alias("colliding_keys"))


def top_roots(domains: DataFrame, ids: ValueIds, n: int = 10) -> DataFrame:
    """A15 over a stored dictionary: the roots are chosen by their sums, and only their ids are counted."""
    sums = domains.groupBy("root_domain").agg(F.sum("occurrence_count").alias("total_occurrences")).orderBy(F.desc("total_occurrences"), "root_domain").limit(n)
    theirs = ids.of(domains.join(F.broadcast(sums.select("root_domain")), "root_domain"), "domain", "domain_id").withColumn("task", F.col("task_id").cast("long"))
    counts = by_kind(merged_counts(bitmaps(theirs, {"domain": "domain_id", "task": "task"}, "root_domain"), "root_domain"),
                     {"domain": "domain_count", "task": "task_coverage"}, "root_domain")
    return sums.join(counts, "root_domain").select("root_domain", "domain_count", "total_occurrences", "task_coverage")

