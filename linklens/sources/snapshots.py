"""Versions of a keyed table in hash buckets: a batch rewrites only the buckets it touches.

A table is a folder:

    table/                  one row: key, grouping columns, numbers of buckets, columns
    data/<attempt>/bucket=B/    rows of bucket B as one write left them; never changed again
    manifest/version=V/     for every bucket the attempt that holds its rows in version V

The manifest is written last, so a version is there as a whole or not at all.  Readers
of older versions are not disturbed, a write that died half-way leaves files that no
manifest names, and of two writers of one version one gets a VersionConflict.

Rows of one group (a scan) lie in `spread` buckets at most.  A batch over a few scans
touches few buckets, and a scan that holds a third of all rows is still split.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from linklens.session import checkpointed

#: A bucket without rows has no place; a row with bucket -1 names the batch of the version.
MANIFEST = "bucket INT, place STRING, batch STRING, attempt STRING, version BIGINT"
SETTINGS = "settings STRING, columns STRING"


class VersionConflict(RuntimeError):
    """Another writer has committed the version meanwhile: read again and repeat the batch."""


@dataclass(frozen=True)
class BucketedTable:
    """A stored table; `key` identifies a row, `group` (part of the key) is what the rows of a batch have in common."""

    spark: SparkSession
    folder: str
    key: tuple[str, ...]
    group: tuple[str, ...]
    groups: int
    spread: int
    schema: StructType

    @staticmethod
    def create(df: DataFrame, folder: str, key: list[str], group: list[str] | None = None, groups: int = 64, spread: int = 4) -> BucketedTable:
        """Version 0 with the rows of `df`, one for each key."""
        table = BucketedTable(df.sparkSession, folder, tuple(key), tuple(group or key[:1]), groups, spread, df.schema)
        settings = json.dumps(dict(key=key, group=table.group, groups=groups, spread=spread))
        df.sparkSession.createDataFrame([(settings, df.schema.json())], SETTINGS).coalesce(1).write.mode("error").parquet(f"{folder}/table")
        table._commit(0, "create", *table._write(df, range(groups * spread)), {})
        return table

    @staticmethod
    def open(spark: SparkSession, folder: str) -> BucketedTable:
        row = spark.read.schema(SETTINGS).parquet(f"{folder}/table").first()
        s = json.loads(row["settings"])
        return BucketedTable(spark, folder, tuple(s["key"]), tuple(s["group"]), s["groups"], s["spread"], StructType.fromJson(json.loads(row["columns"])))

    def _hashed(self, columns: tuple[str, ...], n: int) -> Column:
        return F.pmod(F.xxhash64(*[F.col(c).cast("string") for c in columns]), F.lit(n))  # alike for INT and BIGINT keys

    def bucket(self) -> Column:
        """Bucket of a row, fixed by its key."""
        return (self._hashed(self.group, self.groups) * self.spread + self._hashed(self.key, self.spread)).cast("int")

    def _manifests(self) -> DataFrame:
        return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")

    def version(self) -> int:
        """The newest version."""
        return self._manifests().agg(F.max("version")).first()[0]

    def places(self, version: int | None = None) -> dict[int, str]:
        """Where the rows of each bucket are; as many entries as there are buckets with rows."""
        rows = self._manifests().where((F.col("version") == (self.version() if version is None else version)) & F.col("place").isNotNull())
        found = rows.select("attempt", "bucket", "place").collect()
        first = min((r["attempt"] for r in found), default=None)  # of two writers at the same moment one counts
        return {r["bucket"]: r["place"] for r in found if r["attempt"] == first}

    def read(self, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The table as of a version, or the rows of some buckets; files of the others are neither listed nor read."""
        return self._read(self.places(version), buckets)

    def _read(self, places: dict[int, str], buckets: list[int] | None) -> DataFrame:
        paths = [f"{self.folder}/data/{p}/bucket={b}" for b, p in sorted(places.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def of_groups(self, groups: DataFrame) -> DataFrame:
        """The rows of some groups, from their buckets alone."""
        asked = groups.select(*self.group).distinct()
        numbers = [r[0] for r in asked.select(self._hashed(self.group, self.groups)).distinct().collect()]  # `groups` at most
        return self.read(buckets=[n * self.spread + s for n in numbers for s in range(self.spread)]).join(asked, list(self.group), "left_semi")

    def _write(self, df: DataFrame, buckets: range | list[int]) -> tuple[str, dict[int, str | None]]:
        """Rows as files of one attempt; the place of each of the buckets, None for an empty one."""
        attempt = uuid.uuid4().hex
        place = f"{self.folder}/data/{attempt}"
        # files of a bounded size, a large bucket in several
        df.withColumn("bucket", self.bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(place)
        held = self.spark.read.schema("bucket INT").option("basePath", place).parquet(place).select("bucket").distinct().collect()
        full = {r["bucket"] for r in held}
        return attempt, {b: attempt if b in full else None for b in buckets}

    def _commit(self, version: int, batch: str, attempt: str, written: dict[int, str | None], before: dict[int, str]) -> None:
        places = {**before, **written}
        rows = [(-1, None, batch, attempt), *((b, p, None, attempt) for b, p in sorted(places.items()))]
        try:
            self.spark.createDataFrame(rows, MANIFEST.rsplit(",", 1)[0]).coalesce(1).write.mode("error").parquet(f"{self.folder}/manifest/version={version}")
        except AnalysisException as e:
            raise VersionConflict(f"version {version} of {self.folder}") from e
        if self._manifests().where(F.col("version") == version).agg(F.min("attempt")).first()[0] != attempt:
            raise VersionConflict(f"version {version} of {self.folder}")

    def has(self, batch: str) -> bool:
        """Whether a batch of this name is part of the table."""
        return not self._manifests().where((F.col("bucket") == -1) & (F.col("batch") == batch)).isEmpty()

    def upsert(self, batch: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], name: str | None = None) -> list[int]:
        """The next version: `merge(old rows, batch)` over the buckets that the batch touches, which are returned.

        `merge` is one of operators.merge; it may add, change and drop rows of keys of the
        batch.  A batch with a name that the table has already is left out, so that a
        replay does no harm.
        """
        if name is not None and self.has(name):
            return []
        version = self.version()
        before = self.places(version)
        batch = checkpointed(batch)  # read for its buckets and for the merge
        touched = sorted(r[0] for r in batch.select(self.bucket()).distinct().collect())  # as many as there are buckets
        old = self._read(before, touched)
        self._commit(version + 1, name or f"version {version + 1}", *self._write(merge(old, batch).select(*self.schema.names), touched), before)
        return touched

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete the rows that none of the last `keep` versions needs, and the manifests of older ones."""
        last = self.version()
        oldest = max(0, last - keep + 1)
        needed = {(p, b) for v in range(oldest, last + 1) for b, p in self.places(v).items()}
        old = self._manifests().where((F.col("version") < oldest) & F.col("place").isNotNull()).select("place", "bucket").distinct().collect()  # attempts times buckets
        gone = [f"{self.folder}/data/{r['place']}/bucket={r['bucket']}" for r in old if (r["place"], r["bucket"]) not in needed]
        versions = [r[0] for r in self._manifests().where(F.col("version") < oldest).select("version").distinct().collect()]
        for path in gone + [f"{self.folder}/manifest/version={v}" for v in versions]:
            hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        return gone
