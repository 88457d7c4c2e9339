"""Streams run to the end of the given tables, against the batch result in SQL."""

import uuid

from pyspark.sql import functions as F

from linklens import fixed_values as v
from linklens import schemas
from linklens.checks.extract_checks import HITS
from linklens.checks.registry import check
from linklens.checks.risk_checks import RETEST_SQL, at_rest, domains, run_ts, tickets
from linklens.operators import extract as X
from linklens.operators import merge as M
from linklens.plans import retest, scan
from linklens.session import ensure_checkpoint_dir
from linklens.sources import export as E
from linklens.streaming import jobs as J
from linklens.streaming import store as S

EVENTS = "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def run_folder(t) -> str:
    return f"{ensure_checkpoint_dir(t.spark)}/stream-{uuid.uuid4().hex}"


SCANNED = "page_id BIGINT, task_id INT, page_url STRING, html STRING, resource STRING, target_host STRING, fetched_at TIMESTAMP"
BATCHES = 4
#: Batch of a page in the streamed queries: pages of all scans come in each.
PAGE_BATCH = "((page_id // 3) % 4)"


def scanned_pages(t):
    """Pages as a scan delivers them, with the number of their batch."""
    return t.fx_pages.select("page_id", "task_id", F.col("url").alias("page_url"), "html", F.lit("html").alias("resource"), "target_host",
                             F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id")).alias("fetched_at"), F.expr("div(page_id, 3) % 4").alias("batch"))


def finished(writer) -> None:
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()


def fed(rows, part, folder: str) -> None:
    """The files of one more batch of a stream's source, written side by side."""
    rows.where(F.col("batch") == part).drop("batch").write.mode("append").parquet(folder)


def streamed_store(t, compactions=(1,), **options) -> str:
    """A store after four batches, the stream stopped and started again after each, with compactions between."""
    out = run_folder(t)
    pages = scanned_pages(t)
    for n in range(BATCHES):
        fed(pages, n, f"{out}/src")
        finished(J.scan_stream(J.read_stream(t.spark, f"{out}/src", SCANNED, files_per_batch=None), f"{out}/store", f"{out}/ck", run_ts=run_ts(), **options))
        if n in compactions:
            J.compact(t.spark, f"{out}/store")
    return f"{out}/store"


check("t1_t7_streamed_domains", lambda t: J.current_domains(t.spark, streamed_store(t)).select("task_id", "domain", "occurrence_count", "has_link", "has_text"),
      HITS + """select task_id, domain, count(*) as occurrence_count, bool_or(source_type <> 'plain_text') as has_link, bool_or(source_type = 'plain_text') as has_text
      from hits where side = 'external' group by 1, 2""")
check("t7_compacted_subdomains", lambda t: J.current_subdomains(t.spark, streamed_store(t, (0, 2))).select("task_id", "domain", "occurrence_count"),
      HITS + "select task_id, domain, count(*) as occurrence_count from hits where side = 'subdomain' group by 1, 2")
check("t7_compacted_evidence", lambda t: J.current_evidence(t.spark, streamed_store(t, (1, 2, 3))).groupBy("task_id", "page_url", "domain", "source_type").agg(
    F.count("*").alias("n"), F.countDistinct("id").alias("ids")),
      HITS + "select task_id, page_url, domain, source_type, count(*) as n, count(*) as ids from hits group by 1, 2, 3, 4")
check("t7_streamed_capped_evidence", lambda t: J.current_evidence(t.spark, streamed_store(t, per_domain=2), per_domain=2).groupBy("page_url", "domain").agg(F.count("*").alias("n")),
      HITS + "select page_url, domain, least(count(*), 2) as n from hits group by 1, 2")


#: Rules of three sites over the batches; valid_to is exclusive.
RULE_VERSIONS = [(1, "example.com", "critical", 0, 2), (1, "example.com", "low", 2, None), (2, "example.net", "medium", 1, 3), (3, "*.example.org", "high", 3, None)]


def rules_over_time(t):
    """Risk of each batch's domains while rules change."""
    out = run_folder(t)
    versions = [(i, d, "root", lv, "", [], "m", "", a, b) for i, d, lv, a, b in RULE_VERSIONS]
    t.spark.createDataFrame(versions, "id INT, domain STRING, match_type STRING, risk_level STRING, category STRING, tags ARRAY<STRING>, source STRING, remark STRING, "
                            "valid_from BIGINT, valid_to BIGINT").write.parquet(f"{out}/rules")
    store = streamed_store(t, (), rules_path=f"{out}/rules")
    return S.current(t.spark, store, "domains", J.DOMAIN_DELTA).select("batch_id", "task_id", "domain", "risk_level")


check("t9_rules_over_time", rules_over_time,
      HITS + f"""select distinct {PAGE_BATCH} as batch_id, hits.task_id, domain, coalesce(r.level, 'pending') as risk_level from hits join fx_pages on fx_pages.url = hits.page_url
      left join (values {", ".join(f"('{d.lstrip('*.')}', '{lv}', {a}, {'null' if b is None else b})" for _, d, lv, a, b in RULE_VERSIONS)}) r(root, level, a, b)
       on r.root = hits.root_domain and {PAGE_BATCH} >= a and ({PAGE_BATCH} < b or b is null) where side = 'external'""")
def exact_counts(t):
    """Distinct domains of each scan, counted by keyed state, over four batches and a restart after each."""
    out = run_folder(t)
    pages = scanned_pages(t)
    with J.rocksdb_state(t.spark):
        for n in range(BATCHES):
            fed(pages, n, f"{out}/src")
            finds = J.timed_finds(J.read_stream(t.spark, f"{out}/src", SCANNED, files_per_batch=None))
            finished(J.write_new_domains(finds, f"{out}/store", f"{out}/ck"))
    return J.domain_counts(t.spark, f"{out}/store")


check("t4_exact_live_counts", exact_counts,
      HITS + "select task_id, side, count(distinct domain) as domains from hits group by 1, 2")


def sketched_counts(t):
    """Sketches of the batches, united; the estimate has to lie within five percent."""
    out = run_folder(t)
    pages = scanned_pages(t)
    for n in range(BATCHES):
        J.write_sketches(X.extract_hits(pages.where(F.col("batch") == n).drop("batch")), f"{out}/store", n)
    found = J.sketched_domains(t.spark, f"{out}/store")
    exact = X.extract_hits(pages.drop("batch")).groupBy("task_id", "side").agg(F.countDistinct("domain").alias("exact"))
    return found.join(exact, ["task_id", "side"], "full_outer").select("task_id", "side", (F.abs(F.col("domains") - F.col("exact")) <= F.col("exact") * 0.05).alias("close"))


check("t4_live_counts", sketched_counts, HITS + "select distinct task_id, side, true as close from hits")


def page_stream_table(t):
    return t.fx_pages.select("task_id", F.col("url").alias("page_url"), "html", F.lit("html").alias("resource"), "target_host")


def written_scan(t, i, **options):
    rules = t.fx_profiles.withColumn("tags", F.split("tags_text", "/"))
    return scan.write_scan(page_stream_table(t), rules, run_ts(), run_folder(t), **options)[i]


check("scan_job_domains", lambda t: written_scan(t, 0).select("task_id", "domain", "occurrence_count", "sample_page_url", "risk_level", "verify_status"),
      HITS + """select task_id, domain, count(*) as occurrence_count, min(page_url) as sample_page_url, 'pending' as risk_level, 'unverified' as verify_status from hits where side = 'external' group by 1, 2""")
check("scan_job_subdomains", lambda t: written_scan(t, 1).select("task_id", "domain", "occurrence_count"),
      HITS + "select task_id, domain, count(*) as occurrence_count from hits where side = 'subdomain' group by 1, 2")
check("scan_job_evidence", lambda t: written_scan(t, 2, per_domain=5).groupBy("page_url", "domain").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids")),
      HITS + "select page_url, domain, least(count(*), 5) as n, least(count(*), 5) as ids from hits group by 1, 2")


def tickets_of_pages(t):
    """pages -> scan -> tickets -> retest, every step on the tables that the one before wrote."""
    levels = F.when(F.col("id") == 1, "critical").when(F.col("id") == 2, "medium").otherwise("low")
    name = F.when(F.col("id") == 1, "example.com").when(F.col("id") == 2, "example.net").otherwise("example.org")
    rules = t.fx_profiles.where("id in (1, 2, 3)").withColumns({"domain": name, "match_type": F.lit("root"), "risk_level": levels, "tags": F.split("tags_text", "/")})
    pages = page_stream_table(t)
    tasks = pages.select("task_id").distinct().withColumns({"name": F.lit("scan"), "target_url": F.lit("https://www.example.com/"), "status": F.lit("completed")})
    found, _, evidence = scan.write_scan(pages, rules, run_ts(), run_folder(t), per_domain=None)
    fresh = M.sync_tickets(t.spark.createDataFrame([], schemas.TICKETS), evidence, found, tasks, run_ts())
    responses = t.fx_pages.select("url", F.lit(200).alias("status_code"), F.col("html").alias("body"), F.lit("").alias("error"))
    after, _, _ = retest.retest_cycle(fresh, found, tasks, responses, run_ts())
    numbered = E.ticket_csv(after, tasks, verify_status="all")
    listed = numbered.select(F.col(numbered.columns[4]).alias("page_url"), F.col(numbered.columns[6]).alias("domain"))
    return after.join(listed, ["page_url", "domain"]).groupBy("task_id", "domain", "page_url", "risk_level", "manual_status").agg(F.countDistinct("id").alias("ids"))


check("chain_pages_to_tickets", tickets_of_pages,
      HITS + """select distinct task_id, domain, page_url, case root_domain when 'example.com' then 'critical' when 'example.net' then 'medium' else 'low' end as risk_level,
      'pending' as manual_status, 1 as ids from hits where side = 'external' and root_domain in ('example.com', 'example.net', 'example.org')""")


def refreshed_counts(t):
    out = run_folder(t)
    M.refresh_page_counts(t.fx_occurrences, f"{out}/roots", f"{out}/domains")
    return t.spark.read.schema("root_domain STRING, page_count BIGINT").parquet(f"{out}/roots")


def refreshed_domain_counts(t):
    """The approximate table: within five percent of the exact counts, or one off."""
    out = run_folder(t)
    M.refresh_page_counts(t.fx_occurrences, f"{out}/roots", f"{out}/domains")
    found = t.spark.read.schema("domain STRING, root_domain STRING, page_count BIGINT").parquet(f"{out}/domains")
    exact = t.fx_occurrences.select("domain", "root_domain", "page_url").distinct().groupBy("domain", "root_domain").agg(F.count("*").alias("exact"))
    near = F.abs(F.col("page_count") - F.col("exact")) <= F.greatest(F.lit(1.0), F.col("exact") * 0.05)
    return found.join(exact, ["domain", "root_domain"], "full_outer").select("domain", "root_domain", F.coalesce(near, F.lit(False)).alias("close"))


check("m26_domain_count_table", refreshed_domain_counts, "select distinct domain, root_domain, true as close from fx_occurrences")


def stored_responses(t):
    """Responses written out, read with their schema and made ready for extraction."""
    from linklens.sources import responses as P

    out = run_folder(t)
    kind = F.when(F.col("page_id") % 7 == 0, "image/png").when(F.col("page_id") % 7 == 1, "").otherwise("text/html; charset=utf-8")
    t.fx_pages.select("task_id", "url", F.lit(200).alias("status_code"), kind.alias("content_type"), "html", F.lit(5).alias("response_time_ms"), F.lit("").alias("error"),
                      F.lit(None).cast("timestamp").alias("fetched_at"), F.lit("x").alias("not_in_the_schema")).write.parquet(f"{out}/responses")
    return P.keep_text_bodies(P.read_responses(t.spark, f"{out}/responses")).select("task_id", "url", "content_type", F.length("html").alias("n"), F.md5("html").alias("html_md5"))


check("s1_read_responses", stored_responses,
      """select task_id, url, case page_id % 7 when 0 then 'image/png' when 1 then '' else 'text/html; charset=utf-8' end as content_type,
      case when blank then 0 else length(html) end as n, md5(case when blank then '' else html end) as html_md5
      from (select *, page_id % 7 = 0 and not regexp_matches(url, '(?i)^[^?#]*\\.(' || '{}' || ')([?#]|$)') as blank from fx_pages)""".format("|".join(v.TEXT_PATH_SUFFIXES)))
check("m26_page_count_tables", refreshed_counts, "select root_domain, count(distinct page_url) as page_count from fx_occurrences group by 1")


def event_pages(df):
    return df.select(F.col("ts").cast("timestamp").alias("crawled_at"), F.col("user_id").cast("int").alias("task_id"), F.col("props").alias("url"))


RATE = """select task_id, strftime(make_timestamp(s * 1000000), '%Y-%m-%d %H:%M:%S') as window_start, count(*) as pages from
 (select cast(user_id as int) as task_id, unnest(range(cast(floor(epoch(ts)) as bigint) - 4, cast(floor(epoch(ts)) as bigint) + 1)) as s from events) group by 1, 2"""


def rate_text(df):
    return df.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm:ss"))


check("t3_page_rate", lambda t: rate_text(J.page_rate(event_pages(t.events))), RATE)


def streamed_rate(t):
    """Changed windows of each micro-batch as deltas, read back as the last state of each window."""
    out = run_folder(t)
    events = event_pages(J.read_stream(t.spark, t.sf_dir, EVENTS, pathGlobFilter="events.parquet"))
    finished(J.write_updates(J.page_rate(events.withWatermark("crawled_at", "1 hour")), f"{out}/store", "rates", f"{out}/ck"))
    return rate_text(J.latest_updates(t.spark, f"{out}/store", "rates", "task_id INT, window_start TIMESTAMP, pages BIGINT, batch_id BIGINT", ["task_id", "window_start"]))


check("t3_streamed_page_rate", streamed_rate, RATE)


def streamed_logs(t):
    out = run_folder(t)
    logs = J.read_stream(t.spark, t.sf_dir, EVENTS, pathGlobFilter="events.parquet").select(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "signup", F.lit(None)).otherwise("Info").alias("level"))
    finished(J.log_stream(logs, "info").writeStream.format("parquet").option("path", f"{out}/logs").option("checkpointLocation", f"{out}/ck"))
    return t.spark.read.schema("id BIGINT, level STRING").parquet(f"{out}/logs")


check("t5_streamed_logs", streamed_logs, "select event_id as id, 'INFO' as level from events where event_type <> 'error'")


#: Responses arrive by quarter of the month; each tenth comes two quarters late, each seventh twice, each eleventh once more in the next quarter.
ARRIVALS = """e as (select event_id, ts, least(3, (day(ts) - 1) // 8) as q from events),
 arrivals as (select event_id, ts, q + case when event_id % 10 = 0 then 2 else 0 end as batch from e union all select event_id, ts, q + case when event_id % 10 = 0 then 3 else 1 end from e where event_id % 11 = 0),
 marks as (select b.batch, (select max(epoch_ms(a.ts)) - 3600000 from arrivals a where a.batch < b.batch) as mark from (select distinct batch from arrivals) b)"""


def deduplicated(t):
    """Each response once, with keyed state in RocksDB, a restart after each batch, and rows too late for the watermark left out."""
    out = run_folder(t)
    quarter = F.least(F.lit(3), F.floor((F.dayofmonth("ts") - 1) / 8)).cast("int")
    late = F.col("event_id") % 10 == 0
    events = t.events.select("event_id", F.col("user_id").cast("int").alias("task_id"), F.concat(F.lit("u"), "event_id").alias("url"), F.col("ts").cast("timestamp").alias("fetched_at"),
                             (quarter + F.when(late, 2).otherwise(0)).alias("batch"))
    twice = events.withColumn("copies", F.explode(F.when(F.col("event_id") % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copies")
    again = events.where("event_id % 11 = 0").withColumn("batch", F.col("batch") + 1)
    arriving = twice.unionByName(again)
    schema = "event_id BIGINT, task_id INT, url STRING, fetched_at TIMESTAMP"
    with J.rocksdb_state(t.spark):
        for n in range(7):
            fed(arriving, n, f"{out}/src")
            stream = J.first_responses(J.read_stream(t.spark, f"{out}/src", schema, files_per_batch=None))
            finished(stream.select("task_id", "event_id").writeStream.format("parquet").option("path", f"{out}/d").option("checkpointLocation", f"{out}/ck"))
    return t.spark.read.schema("task_id INT, event_id BIGINT").parquet(f"{out}/d")


check("t2_streamed_first_responses", deduplicated,
      f"""with {ARRIVALS} select distinct cast(user_id as int) as task_id, a.event_id from arrivals a join marks m on m.batch = a.batch join events on events.event_id = a.event_id
      where m.mark is null or epoch_us(a.ts) > m.mark * 1000""")
check("t6_significant_pages", lambda t: J.significant_pages(t.fx_sitemap_pages.select(
    "task_id", "url", "crawled_at", F.when(F.col("status_code") == 404, 1).otherwise(0).alias("external_count"), F.lit(0).alias("subdomain_count"))).select("task_id", "url"),
      """select task_id, url from (select *, row_number() over (partition by task_id order by crawled_at, url) as rn from fx_sitemap_pages) where status_code = 404 or rn % 25 = 0""")
CYCLE = f"""with vd as ({RETEST_SQL}), q as (select vd.* from vd join fx_tickets r on r.id = vd.id join fx_tasks t on t.task_id = r.task_id where t.status <> 'deleting' and r.manual_status <> 'ignored' and r.verify_status in ({{0}}))
"""


def retest_cycle(t):
    return retest.retest_cycle(tickets(t), domains(t), t.fx_tasks, t.fx_responses, run_ts())


def rollback_audit(t):
    return retest.rollback_audit(tickets(t), domains(t), t.fx_tasks, t.fx_responses, run_ts())


check("t8_q14_retest_cycle_stats", lambda t: retest_cycle(t)[2].select("total_tested", "cleaned_count", "failed_count", "removed_count", "error_count"),
      CYCLE.format("'unverified','verified_failed'") + """select count(*) as total_tested, count(*) filter (where verify_status = 'verified_clean') as cleaned_count, count(*) filter (where verify_status = 'verified_failed') as failed_count,
      count(*) filter (where verify_status = 'page_removed') as removed_count, count(*) filter (where verify_status = 'error') as error_count from q""")
check("t8_retest_cycle_domains", lambda t: retest_cycle(at_rest(t))[1].select("task_id", "domain", "verify_status"),
      CYCLE.format("'unverified','verified_failed'") + """, a as (select r.task_id, r.domain, coalesce(q.verify_status, r.verify_status) as s, q.id is not null as hit from fx_tickets r left join q on q.id = r.id),
      g as (select task_id, domain, bool_or(hit and s = 'verified_failed') as f, bool_or(hit and s in ('verified_clean','page_removed')) and bool_and(s in ('verified_clean','page_removed')) as c from a group by 1, 2)
      select ed.task_id, ed.domain, case when f then 'verified_failed' when c then 'verified_clean' else verify_status end as verify_status from fx_external_domains ed left join g on g.task_id = ed.task_id and g.domain = ed.domain""")
check("t8_q15_rollback_audit_tickets", lambda t: rollback_audit(at_rest(t))[0].select("id", "verify_status", "manual_status"),
      CYCLE.format("'verified_clean','page_removed'") + """select r.id, coalesce(q.verify_status, r.verify_status) as verify_status, case when q.verify_status = 'verified_failed' then 'pending' when q.verify_status in ('verified_clean','page_removed') then 'resolved'
      else r.manual_status end as manual_status from fx_tickets r left join q on q.id = r.id""")
