"""Stored versions, bitmaps, sketches and copies against the SQL of what works on whole tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens.checks import risk_checks as K
from linklens.checks.registry import check, check_like
from linklens.checks.stream_checks import run_folder
from linklens.operators import distinct as X
from linklens.operators import merge as M
from linklens.operators import rollup as R
from linklens.sources.copying import RangedCopy
from linklens.sources.snapshots import BucketedTable
from linklens.streaming import store as S


def in_batches(t, old: DataFrame, batch: DataFrame, key: list[str], merge, groups: int = 8, spread: int = 2) -> DataFrame:
    """The newest version of a bucketed table after the batch came in two parts, the second of them twice."""
    table = BucketedTable.create(old, f"{run_folder(t)}/table", key, groups=groups, spread=spread)
    part = F.pmod(F.col("task_id"), F.lit(2))
    table.upsert(batch.where(part == 0), merge)
    for _ in range(2):
        table.upsert(batch.where(part == 1), merge, name="odd scans")
    return BucketedTable.open(t.spark, table.folder).read()


check_like("m1_bucketed_page_upsert", lambda t: in_batches(t, *K.pages_and_batch(t), ["task_id", "url"], M.merge_pages).select(
    "task_id", "url", "path", "depth", "status_code", "title"), "m1_s10_page_upsert")
check_like("m2_m3_bucketed_domain_upsert", lambda t: in_batches(t, *K.domains_and_batch(t), ["task_id", "domain"], M.merge_domains), "m2_m3_domain_upsert")


def bucketed_tickets(t) -> DataFrame:
    old = K.stale_tickets(t)
    batch = M.ticket_batch(old.schema, t.fx_occurrences, K.domains(t), t.fx_tasks, K.run_ts())
    return K.synced(in_batches(t, old, batch, M.TICKET_KEY, M.merge_tickets))


check_like("m12_bucketed_ticket_sync", bucketed_tickets, "m12_ticket_sync")

DAYS = 3


def in_days(t, rows: DataFrame, summary, schema: str) -> DataFrame:
    """The summaries of three days (by scan), each stored when its day is over."""
    out = f"{run_folder(t)}/store"
    for day in range(DAYS):
        S.write_delta(summary(rows.where(F.pmod(F.col("task_id"), F.lit(DAYS)) == day)), out, "days", day)
        S.commit(t.spark, out, ["days"], day)
    return S.current(t.spark, out, "days", schema)


def kept(t, rows: DataFrame) -> DataFrame:
    """Rows that several jobs read, written out once instead of being put together again by each of them."""
    folder = f"{run_folder(t)}/rows"
    rows.write.parquet(folder)
    return t.spark.read.schema(rows.schema).parquet(folder)


def bitmap_totals(t) -> DataFrame:
    """Distinct domains and roots from merged bitmaps, sums and shared domains from one roll-up by domain."""
    ids = X.ValueIds(t.spark, run_folder(t))
    domains = kept(t, t.fx_external_domains.select("task_id", "domain", "root_domain", "occurrence_count"))

    def day(rows):
        for c in ("domain", "root_domain"):
            ids.extend(F.col(c), rows)
        known = ids.of(ids.of(rows, "domain", "d"), "root_domain", "r")
        return X.bitmaps(known, {"domain": "d", "root": "r"})
    counts = X.by_kind(X.merged_counts(in_days(t, domains, day, "kind STRING, bucket BIGINT, bitmap BINARY, batch_id BIGINT")),
                       {"domain": "total_unique_domains", "root": "unique_root_domains"})
    per_domain = domains.groupBy("domain").agg(F.sum("occurrence_count").alias("n"), F.count("*").alias("tasks"))
    sums = per_domain.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_occurrences"), F.count_if(F.col("tasks") >= 2).alias("shared_domains_count"))
    scans = R.live_tasks(t.fx_tasks).agg(F.count("*").alias("total_tasks"))
    both = counts.unionByName(sums, allowMissingColumns=True).unionByName(scans, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


check_like("a13_bitmap_totals", bitmap_totals, "a13_global_totals")


def bitmap_roots(t) -> DataFrame:
    ids = X.ValueIds(t.spark, run_folder(t))
    domains = kept(t, t.fx_external_domains.select("task_id", "domain", "root_domain", "occurrence_count"))
    ids.extend(F.col("domain"), domains)
    return X.top_roots(domains, ids)


check_like("a15_bitmap_top_roots", bitmap_roots, "a15_top_roots")


def bitmap_metrics(t) -> DataFrame:
    """Three distinct counts from merged bitmaps beside plain counts."""
    ids = X.ValueIds(t.spark, run_folder(t))
    live = kept(t, R.on_live_tasks(t.fx_tickets, t.fx_tasks).select("task_id", "domain", "page_url", "verify_status", "manual_status"))

    def day(rows):
        for c in ("domain", "page_url"):
            ids.extend(F.col(c), rows)
        known = ids.of(ids.of(rows, "domain", "d"), "page_url", "p").withColumn("open", F.when(R.is_pending_ticket(), F.col("task_id").cast("long")))
        return X.bitmaps(known, {"domain": "d", "page": "p", "task": "open"})
    counts = X.by_kind(X.merged_counts(in_days(t, live, day, "kind STRING, bucket BIGINT, bitmap BINARY, batch_id BIGINT")),
                       {"task": "tasks_affected", "domain": "unique_risk_domains", "page": "unique_pages"})
    plain = live.agg(F.count("*").alias("total_items"), F.count_if(R.is_pending_ticket()).alias("pending_count"),
                     F.count_if(F.col("verify_status") == "verified_failed").alias("failed_count"), F.count_if(F.col("verify_status") == "unverified").alias("unverified_count"),
                     F.count_if(F.col("verify_status").isin("verified_clean", "page_removed")).alias("clean_count"))
    both = counts.unionByName(plain, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


check_like("a17_bitmap_metrics", bitmap_metrics, "a17_ticket_metrics")


def near_exact(t, found: DataFrame) -> DataFrame:
    """Whether an estimate lies within five percent of the exact count, or one off."""
    exact = t.fx_occurrences.select("domain", "root_domain", "page_url").distinct().groupBy("domain", "root_domain").agg(F.count("*").alias("exact"))
    both = found.join(exact, ["domain", "root_domain"], "full_outer")
    near = F.abs(F.col("page_count") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.05)
    return both.select("domain", "root_domain", F.coalesce(near, F.lit(False)).alias("close"))


CLOSE = "select distinct domain, root_domain, true as close from fx_occurrences"
check("a21_domain_page_counts_approx", lambda t: near_exact(t, R.domain_page_counts(t.fx_occurrences)), CLOSE)
check("a21_stored_page_sketches", lambda t: near_exact(t, X.estimates(in_days(
    t, t.fx_occurrences, lambda rows: X.sketches(rows, "page_url", "domain", "root_domain"), "domain STRING, root_domain STRING, sketch BINARY, batch_id BIGINT"),
    "page_count", "domain", "root_domain")), CLOSE)

KEY = ["task_id", "domain", "page_url", "source_type", "raw_match"]
check("f21_identity", lambda t: X.identity_report(t.fx_occurrences.withColumn("id", X.identity(*KEY)), KEY, "id"),
      f"with k as (select distinct {', '.join(KEY)} from fx_occurrences) select count(*) as distinct_keys, count(*) as distinct_ids, 0 as colliding_keys from k")


def ranged_copy(t) -> RangedCopy:
    """A copy that stopped after a step, went on with one range, lost a step half-way, and went on."""
    pages = t.fx_sitemap_pages.select("id", "task_id", "url", F.concat("title", F.lit("\x00")).alias("title"))
    copy = RangedCopy(pages, f"{run_folder(t)}/copy")
    bounds = copy.ranges(4)
    chunk = max(1, -(-(bounds[0][1] - bounds[0][0]) // 3)) if bounds else 1
    copy.run(chunk, steps=1)
    copy.run(chunk, only=[2])
    pages.where("id % 2 = 0").withColumn("range_no", F.lit(0)).write.partitionBy("range_no").parquet(f"{copy.folder}/data/broken")
    copy.run(chunk)
    return copy


check("s24_ranged_copy", lambda t: ranged_copy(t).copied(), "select id, task_id, url, title from fx_sitemap_pages")
check("s24_copy_report", lambda t: ranged_copy(t).report().select("range_no", "low", "high", "row_count", "finished"),
      """with b as (select min(id) as a, max(id) as z, ceil((max(id) - min(id) + 1) / 4.0)::bigint as w from fx_sitemap_pages),
      r as (select i as range_no, a + i * w as low, least(a + (i + 1) * w, z + 1) as high from b, (select unnest([0, 1, 2, 3]) as i) where a + i * w <= z)
      select range_no, low, high, (select count(*) from fx_sitemap_pages where id >= low and id < high) as row_count, true as finished from r""")
