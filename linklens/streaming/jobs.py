"""Structured Streaming jobs.

State lives in Spark's checkpoints and in a log-structured store of per-batch deltas (see
store.py).  A delta is overwritten when its batch is replayed, so a restart neither
loses nor doubles anything.
"""

from __future__ import annotations

import contextlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from linklens.functions import text as T
from linklens.operators import extract as X
from linklens.operators import risk as K
from linklens.operators import rollup as R
from linklens.plans import scan
from linklens.session import numbered
from linklens.streaming import store as S

DOMAIN_DELTA = ("task_id INT, domain STRING, root_domain STRING, occurrence_count BIGINT, has_link BOOLEAN, has_text BOOLEAN, "
                "sample_page_url STRING, risk_level STRING, risk_tags ARRAY<STRING>, risk_remark STRING, risk_source STRING, batch_id BIGINT")
EVIDENCE_DELTA = ("id BIGINT, task_id INT, domain STRING, root_domain STRING, page_url STRING, page_title STRING, seq BIGINT, source_type STRING, raw_match STRING, "
                  "context_snippet STRING, is_link BOOLEAN, created_at TIMESTAMP, batch_id BIGINT")
SUBDOMAIN_DELTA = ("task_id INT, domain STRING, root_domain STRING, occurrence_count BIGINT, has_link BOOLEAN, has_text BOOLEAN, "
                   "sample_page_url STRING, batch_id BIGINT")


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = 50, **options) -> DataFrame:
    """A folder as a stream; with None a micro-batch takes every file that is there."""
    if files_per_batch is not None:
        options["maxFilesPerTrigger"] = files_per_batch
    return spark.readStream.schema(schema).options(**options).parquet(path)


def first_responses(stream: DataFrame, time: str = "fetched_at", late: str = "1 hour") -> DataFrame:
    """Each (task, url) once; state is dropped after the watermark."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(["task_id", "url"])


def page_rate(pages: DataFrame, time: str = "crawled_at", span: str = "5 seconds", step: str = "1 second") -> DataFrame:
    """Pages per sliding window and scan; the same code for a stream (with watermark) and a table."""
    return pages.groupBy(F.window(time, span, step).alias("w"), "task_id").agg(F.count("*").alias("pages")).select(
        "task_id", F.col("w.start").alias("window_start"), "pages")


@contextlib.contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB: on local disk and in the checkpoint, not in executor memory."""
    key, before = "spark.sql.streaming.stateStore.providerClass", None
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def timed_finds(pages: DataFrame, time: str = "fetched_at") -> DataFrame:
    """Domains found in a stream of pages, with the time of the page: task_id, side, domain, `time`."""
    return X.extract_hits(pages, snippets=False, keep=(time,)).select("task_id", "side", "domain", time)


def write_new_domains(finds: DataFrame, store: str, checkpoint: str, time: str = "fetched_at", late: str = "1 hour") -> DataStreamWriter:
    """T4, exact: domains that a scan had not found before, counted as a delta of each batch.

    State is one key for each distinct domain of a scan and side; it has to stay as
    long as the scan runs, so use rocksdb_state.
    """
    new = finds.withWatermark(time, late).dropDuplicates(["task_id", "side", "domain"])

    def each(batch: DataFrame, batch_id: int) -> None:
        S.write_delta(batch.groupBy("task_id", "side").agg(F.count("*").alias("domains")), store, "new_domains", batch_id)
        S.commit(batch.sparkSession, store, ["new_domains"], batch_id)
    return new.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def domain_counts(spark: SparkSession, store: str) -> DataFrame:
    """Distinct domains of each scan and side so far."""
    deltas = S.current(spark, store, "new_domains", "task_id INT, side STRING, domains BIGINT, batch_id BIGINT")
    return deltas.groupBy("task_id", "side").agg(F.sum("domains").alias("domains"))


def write_sketches(hits: DataFrame, store: str, batch_id: int, log2: int = 14) -> None:
    """T4, approximate: one mergeable sketch of a batch's domains for each scan and side; replays and overlaps count once."""
    S.write_delta(hits.groupBy("task_id", "side").agg(F.hll_sketch_agg("domain", log2).alias("sketch")), store, "sketches", batch_id)
    S.commit(hits.sparkSession, store, ["sketches"], batch_id)


def sketched_domains(spark: SparkSession, store: str) -> DataFrame:
    sketches = S.current(spark, store, "sketches", "task_id INT, side STRING, sketch BINARY, batch_id BIGINT")
    return sketches.groupBy("task_id", "side").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("domains"))


def live_counts(hits: DataFrame) -> DataFrame:
    """T4: running distinct domains per scan as sketches (update mode); exact: current_domains."""
    def n(side):
        return F.approx_count_distinct(F.when(F.col("side") == side, F.col("domain")), 0.02)
    return hits.groupBy("task_id").agg(n("external").alias("external_domains"), n("subdomain").alias("subdomains"))


def log_stream(logs: DataFrame, level: str | None = None) -> DataFrame:
    """T5: normalised logs, of one level if given."""
    out = logs.withColumn("level", T.log_level(F.col("level")))
    return out if level is None else out.where(F.col("level") == level.upper())


def significant_pages(pages: DataFrame, every: int = 25) -> DataFrame:
    """Pages with finds, and every n-th page of a scan, of one micro-batch.

    Numbers come from a range sort, not from a window over one scan's rows.
    """
    n = numbered(pages, "no", "task_id", "crawled_at", "url")
    first = n.groupBy("task_id").agg(F.min("no").alias("first_no"))
    n = n.join(first, "task_id")
    keep = (F.col("external_count") > 0) | (F.col("subdomain_count") > 0) | ((F.col("no") - F.col("first_no") + 1) % every == 0)
    return n.where(keep).select(*pages.columns)


def rules_as_of(versions: DataFrame, batch_id: int) -> DataFrame:
    """The rules that hold for a batch, of versions with `valid_from` and (exclusive, null: open) `valid_to`."""
    open_ = F.col("valid_to").isNull() | (F.col("valid_to") > batch_id)
    return versions.where((F.col("valid_from") <= batch_id) & open_).drop("valid_from", "valid_to")


def write_batch(pages: DataFrame, batch_id: int, store: str, rules: DataFrame | None, run_ts: Column, per_domain: int | None = None) -> None:
    """Hits, roll-ups and evidence of one micro-batch as deltas (risk as of this batch, T9).

    The pages are parsed once, into the delta of hits; the others are made from it.
    """
    spark = pages.sparkSession
    scan.fetched_hits(pages).write.mode("overwrite").partitionBy("side").parquet(f"{store}/hits/batch_id={batch_id}")
    hits = spark.read.schema(scan.HITS).parquet(f"{store}/hits/batch_id={batch_id}")
    rolled = R.domain_rollup(hits.where(F.col("side") == "external"))
    if rules is not None:
        rolled = K.evaluate_rollup(rolled, rules)
    else:
        rolled = rolled.withColumns({"risk_level": F.lit("pending"), "risk_tags": F.array().cast("array<string>"), "risk_remark": F.lit(""), "risk_source": F.lit("pending")})
    S.write_delta(rolled, store, "domains", batch_id)
    S.write_delta(R.domain_rollup(hits.where(F.col("side") == "subdomain")), store, "subdomains", batch_id)
    S.write_delta(scan.site_evidence(hits, run_ts, per_domain), store, "evidence", batch_id)
    S.commit(spark, store, list(TABLES), batch_id)


def scan_stream(pages: DataFrame, store: str, checkpoint: str, rules_path: str | None = None, run_ts: Column | None = None,
                per_domain: int | None = None) -> DataStreamWriter:
    """Pages (as extraction wants them, each once: first_responses) into the store.

    The rules are read anew for every micro-batch; if they are versions, those of the
    batch hold.  `per_domain` caps the evidence of a page and domain.
    """
    def each(batch: DataFrame, batch_id: int) -> None:
        rules = batch.sparkSession.read.parquet(rules_path) if rules_path else None
        if rules is not None and "valid_from" in rules.columns:
            rules = rules_as_of(rules, batch_id)
        write_batch(batch, batch_id, store, rules, F.current_timestamp() if run_ts is None else run_ts, per_domain)
    return pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def _fold(deltas: DataFrame) -> DataFrame:
    """Counts add, flags accumulate, the sample page and the risk stay from the first batch."""
    first = [F.min_by(c, "batch_id").alias(c) for c in deltas.columns if c.startswith("risk_")]
    folded = deltas.groupBy("task_id", "domain", "root_domain").agg(
        F.sum("occurrence_count").alias("occurrence_count"), F.bool_or("has_link").alias("has_link"), F.bool_or("has_text").alias("has_text"),
        F.min_by("sample_page_url", "batch_id").alias("sample_page_url"), *first, F.min("batch_id").alias("batch_id"))
    return folded.select(*deltas.columns)


def _sorted(evidence: DataFrame) -> DataFrame:
    """Evidence is appended for ever; a base holds it in fewer files, by scan and domain."""
    return evidence.sortWithinPartitions("task_id", "domain", "page_url", "seq")


#: Tables of a store with their columns, and how batches are folded.
TABLES = {"domains": (DOMAIN_DELTA, _fold), "subdomains": (SUBDOMAIN_DELTA, _fold), "evidence": (EVIDENCE_DELTA, _sorted)}


def current_domains(spark: SparkSession, store: str) -> DataFrame:
    """Domains of all committed batches."""
    return _fold(S.current(spark, store, "domains", DOMAIN_DELTA)).drop("batch_id")


def current_subdomains(spark: SparkSession, store: str) -> DataFrame:
    return _fold(S.current(spark, store, "subdomains", SUBDOMAIN_DELTA)).drop("batch_id")


def current_evidence(spark: SparkSession, store: str, per_domain: int | None = None) -> DataFrame:
    """Evidence of all committed batches; `per_domain` caps that of a page which came in several batches, too."""
    rows = S.current(spark, store, "evidence", EVIDENCE_DELTA)
    if per_domain is not None:
        w = Window.partitionBy("task_id", "page_url", "domain").orderBy("seq", "batch_id", "id")
        rows = rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_domain).drop("rank")
    return rows.drop("batch_id")


def compact(spark: SparkSession, store: str) -> int | None:
    """Fold the committed batches of all tables, while the stream goes on."""
    return S.compact(spark, store, TABLES)


def write_updates(df: DataFrame, store: str, table: str, checkpoint: str) -> DataStreamWriter:
    """The changed rows of each micro-batch as a delta (update mode)."""
    def each(batch: DataFrame, batch_id: int) -> None:
        S.write_delta(batch, store, table, batch_id)
        S.commit(batch.sparkSession, store, [table], batch_id)
    return df.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)


def latest_updates(spark: SparkSession, store: str, table: str, schema: str, key: list[str]) -> DataFrame:
    """The last state of each key; `schema` ends with `batch_id BIGINT`."""
    rows = S.current(spark, store, table, schema)
    rest = [c for c in rows.columns if c not in (*key, "batch_id")]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch_id").alias("last")).select(*key, "last.*")
