"""Aggregates, joins and windows against SQL."""

from pyspark.sql import functions as F

from linklens.checks.registry import check
from linklens.operators import extract as X
from linklens.operators import joins as J
from linklens.operators import merge as M
from linklens.operators import rollup as R
from linklens.operators import search as S

LEVELS = ["critical", "high", "medium", "low", "safe", "pending"]
STATES = ["verified_failed", "verified_clean", "error", "unverified"]
LEVEL_COUNTS = ", ".join(f"count(*) filter (where risk_level = '{x}') as {x}" for x in LEVELS)
STATE_COUNTS = ", ".join(f"count(*) filter (where verify_status = '{x}') as verify_{x}" for x in STATES)
TOTAL_RISK = "count(*) filter (where risk_level in ('critical','high','medium')) as total_risk"
EFF_RISK = "case " + " ".join(f"when bool_or(ed.risk_level = '{x}') then '{x}'" for x in LEVELS[:-1]) + " else 'pending' end"
EFF_STATE = "case " + " ".join(f"when bool_or(ed.verify_status = '{x}') then '{x}'" for x in STATES[:-1]) + " else 'unverified' end"
PENDING = "r.verify_status in ('unverified','verified_failed') and r.manual_status <> 'ignored'"


def text_ts(df, *cols):
    for c in cols:
        df = df.withColumn(c, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
    return df


check("a1_domain_rollup", lambda t: R.domain_rollup(t.fx_occurrences),
      """select task_id, domain, root_domain, count(*) as occurrence_count, bool_or(is_link) as has_link, bool_or(not is_link) as has_text,
      min(page_url) as sample_page_url from fx_occurrences group by all""")
check("a2_subdomain_rollup", lambda t: R.domain_rollup(t.fx_occurrences)
      .withColumnRenamed("domain", "subdomain"),
      """select task_id, domain as subdomain, root_domain, count(*) as occurrence_count, bool_or(is_link) as has_link, bool_or(not is_link) as has_text,
      min(page_url) as sample_page_url from fx_occurrences group by all""")
check("a3_a4_task_domain_stats", lambda t: R.task_domain_stats(t.fx_external_domains),
      f"""select task_id, count(*) as total_unique_domains, count(distinct root_domain) as unique_root_domains,
      count(*) filter (where has_link) as link_domains, count(*) filter (where has_text) as text_domains, {LEVEL_COUNTS}, {TOTAL_RISK}, {STATE_COUNTS}
      from fx_external_domains group by task_id""")
check("a5_top_roots_per_task", lambda t: R.top_roots_per_task(t.fx_external_domains),
      """select * from (select task_id, root_domain, count(*) as domain_count, cast(sum(occurrence_count) as bigint) as total_occurrences,
      row_number() over (partition by task_id order by sum(occurrence_count) desc, root_domain) as rank
      from fx_external_domains group by task_id, root_domain) where rank <= 10""")
check("a6_top_domains_per_task", lambda t: R.top_domains_per_task(t.fx_external_domains),
      """select * from (select task_id, domain, root_domain, occurrence_count, has_link, has_text, risk_level,
      row_number() over (partition by task_id order by occurrence_count desc, domain) as rank from fx_external_domains) where rank <= 10""")
check("a7_subdomain_stats", lambda t: R.subdomain_stats(t.fx_subdomains),
      """select task_id, count(*) as total_subdomains, count(*) filter (where has_link) as link_subdomains,
      count(*) filter (where has_text) as text_subdomains from fx_subdomains group by task_id""")

GLOBAL = f"""select ed.domain, ed.root_domain, cast(sum(ed.occurrence_count) as bigint) as total_occurrences, count(distinct ed.task_id) as task_count,
 bool_or(ed.has_link) as has_link, bool_or(ed.has_text) as has_text, cast(min(ed.created_at) as varchar) as first_seen_at,
 cast(max(ed.created_at) as varchar) as last_seen_at, min(ed.sample_page_url) as sample_page_url, {EFF_RISK} as risk_level, {EFF_STATE} as verify_status
 from fx_external_domains ed join fx_tasks t on ed.task_id = t.task_id where t.status <> 'deleting' {{where}} group by ed.domain, ed.root_domain {{having}}"""


def global_list(t, **kw):
    return text_ts(R.global_domains(t.fx_external_domains, t.fx_tasks, with_tasks=False, **kw), "first_seen_at", "last_seen_at")


check("a8_global_domains", lambda t: global_list(t), GLOBAL.format(where="", having=""))
check("a9_global_risk_only", lambda t: global_list(t, risk_level="risk_only"),
      GLOBAL.format(where="", having="having bool_or(ed.risk_level in ('critical','high','medium'))"))
check("a9_global_safe", lambda t: global_list(t, risk_level="safe"), GLOBAL.format(
    where="", having="having bool_or(ed.risk_level = 'safe') and not bool_or(ed.risk_level in ('critical','high','medium','low'))"))
check("a9_global_low", lambda t: global_list(t, risk_level="low"), GLOBAL.format(
    where="", having="having bool_or(ed.risk_level = 'low') and not bool_or(ed.risk_level in ('critical','high','medium'))"))
check("a10_global_verified_clean", lambda t: global_list(t, verify_status="verified_clean"), GLOBAL.format(
    where="", having="having bool_or(ed.verify_status = 'verified_clean') and not bool_or(ed.verify_status = 'verified_failed')"))
check("a10_global_unverified", lambda t: global_list(t, verify_status="unverified"), GLOBAL.format(
    where="", having="having not bool_or(ed.verify_status in ('verified_clean','verified_failed','error'))"))
check("a11_global_min_tasks", lambda t: global_list(t, min_tasks=60),
      GLOBAL.format(where="", having="having count(distinct ed.task_id) >= 60"))
check("a8_global_links_search", lambda t: global_list(t, has_link=True, search=".co.uk"),
      GLOBAL.format(where="and ed.has_link and (ed.domain like '%.co.uk%' or ed.root_domain like '%.co.uk%')", having=""))
check("a12_associated_tasks", lambda t: R.global_domains(t.fx_external_domains, t.fx_tasks).select(
    "domain", "root_domain", F.array_join(F.transform("associated_tasks", lambda x: F.concat_ws(
        ":::", x["task_id"].cast("string"), x["task_name"], x["occurrence_count"].cast("string"))), ";;;").alias("tasks_summary")),
      """select domain, root_domain, string_agg(ed.task_id || ':::' || t.name || ':::' || ed.occurrence_count, ';;;' order by ed.task_id) as tasks_summary
      from fx_external_domains ed join fx_tasks t on ed.task_id = t.task_id where t.status <> 'deleting' group by domain, root_domain""")
check("a13_global_totals", lambda t: R.global_totals(t.fx_external_domains, t.fx_tasks),
      """select count(distinct domain) as total_unique_domains, count(distinct root_domain) as unique_root_domains,
      cast(coalesce(sum(occurrence_count), 0) as bigint) as total_occurrences,
      (select count(*) from (select domain from fx_external_domains group by domain having count(distinct task_id) >= 2)) as shared_domains_count,
      (select count(*) from fx_tasks where status <> 'deleting') as total_tasks from fx_external_domains""")
check("a14_global_risk_histogram", lambda t: R.global_risk_histogram(t.fx_external_domains),
      f"""select {LEVEL_COUNTS}, {TOTAL_RISK}, {STATE_COUNTS} from
      (select domain, {EFF_RISK} as risk_level, {EFF_STATE} as verify_status from fx_external_domains ed group by domain)""")
check("a15_top_roots", lambda t: R.top_roots(t.fx_external_domains),
      """select root_domain, count(distinct domain) as domain_count, cast(sum(occurrence_count) as bigint) as total_occurrences,
      count(distinct task_id) as task_coverage from fx_external_domains group by root_domain order by 3 desc, 1 limit 10""")
check("a16_top_shared_domains", lambda t: R.top_shared_domains(t.fx_external_domains),
      """select domain, max(root_domain) as root_domain, count(distinct task_id) as task_count, cast(sum(occurrence_count) as bigint) as total_occurrences
      from fx_external_domains group by domain order by 3 desc, 4 desc, 1 limit 10""")
LIVE_TICKETS = "from fx_tickets r join fx_tasks t on r.task_id = t.task_id where t.status <> 'deleting'"
check("a17_ticket_metrics", lambda t: R.ticket_metrics(t.fx_tickets, t.fx_tasks),
      f"""select count(*) as total_items, count(*) filter (where {PENDING}) as pending_count,
      count(*) filter (where r.verify_status = 'verified_failed') as failed_count, count(*) filter (where r.verify_status = 'unverified') as unverified_count,
      count(*) filter (where r.verify_status in ('verified_clean','page_removed')) as clean_count,
      count(distinct case when {PENDING} then r.task_id end) as tasks_affected, count(distinct r.domain) as unique_risk_domains,
      count(distinct r.page_url) as unique_pages {LIVE_TICKETS}""")
check("a18_pending_by_level", lambda t: R.pending_by_level(t.fx_tickets, t.fx_tasks),
      f"""select {", ".join(f"count(*) filter (where r.risk_level = '{x}') as {x}" for x in LEVELS[:4])} {LIVE_TICKETS} and {PENDING}""")
check("a19_pending_by_task", lambda t: R.pending_by_task(t.fx_tickets, t.fx_tasks),
      f"""select r.task_id, t.name as task_name, count(*) as pending_count {LIVE_TICKETS} and {PENDING} group by 1, 2 order by 3 desc, 1 limit 20""")
check("a20_root_page_counts", lambda t: R.root_page_counts(t.fx_occurrences),
      "select root_domain, count(distinct page_url) as page_count from fx_occurrences group by 1")
check("a22_ticket_pages_per_root", lambda t: R.ticket_page_counts(t.fx_tickets, "root_domain"),
      "select root_domain, count(distinct page_url) as page_count from fx_tickets group by 1")
check("a22_ticket_pages_per_domain", lambda t: R.ticket_page_counts(t.fx_tickets, "domain"),
      "select domain, count(distinct page_url) as page_count from fx_tickets group by 1")
check("a24_cycle_stats", lambda t: R.cycle_stats(t.fx_tickets),
      """select count(*) as total_tested, count(*) filter (where verify_status = 'verified_clean') as cleaned_count,
      count(*) filter (where verify_status = 'verified_failed') as failed_count, count(*) filter (where verify_status = 'page_removed') as removed_count,
      count(*) filter (where verify_status = 'error') as error_count,
      round(100.0 * count(*) filter (where verify_status in ('verified_clean','page_removed')) / count(*), 1)::double as cleaned_ratio,
      round(100.0 * count(*) filter (where verify_status = 'verified_failed') / count(*), 1)::double as failed_ratio from fx_tickets""")
check("a25_rollback_stats", lambda t: R.rollback_stats(t.fx_tickets.where(F.col("manual_status") != "ignored")),
      """select count(*) as total_tested, count(*) filter (where verify_status = 'verified_clean') as clean_preserved,
      count(*) filter (where verify_status = 'verified_failed') as rollback_detected, count(*) filter (where verify_status = 'page_removed') as page_removed,
      count(*) filter (where verify_status = 'error') as error_count from fx_tickets where manual_status <> 'ignored'""")
check("a26_overall_status", lambda t: R.overall_status(t.fx_external_domains, "domain"),
      """select domain, count(*) as task_count, case when bool_or(verify_status = 'verified_failed') then 'verified_failed'
      when bool_and(verify_status = 'verified_clean') then 'verified_clean' else 'unverified' end as overall_status from fx_external_domains group by 1""")
check("a27_dashboard_totals", lambda t: R.dashboard_totals(t.fx_tasks),
      """select count(*) filter (where status = 'running') as running_tasks, cast(sum(pages_crawled) as bigint) as total_pages_crawled,
      cast(sum(external_domains_count) as bigint) as total_external_domains_count, cast(sum(subdomains_count) as bigint) as total_subdomains_count from fx_tasks""")
check("a28_tasks_by_status", lambda t: R.tasks_by_status(t.fx_tasks), "select status, count(*) as task_count from fx_tasks group by 1")
check("a29_occurrences_by_root", lambda t: R.occurrences_by(t.fx_external_domains, "root_domain"),
      "select root_domain, cast(sum(occurrence_count) as bigint) as total_occurrences from fx_external_domains group by 1")
check("a30_unresolved_pages", lambda t: R.unresolved_pages(t.fx_tickets),
      """select task_id, domain, count(*) filter (where verify_status not in ('verified_clean','page_removed')) as remaining from fx_tickets group by 1, 2""")
check("g8_pages_per_depth", lambda t: R.pages_per_depth(t.fx_sitemap_pages),
      "select task_id, depth, count(*) as page_count from fx_sitemap_pages group by 1, 2")

# joins
check("j1_domains_of_live_tasks", lambda t: R.on_live_tasks(t.fx_external_domains, t.fx_tasks, "name").select("task_id", "domain", "name", "risk_level"),
      "select ed.task_id, domain, name, risk_level from fx_external_domains ed join fx_tasks t on ed.task_id = t.task_id where status <> 'deleting'")
check("j2_risky_evidence", lambda t: J.risky_evidence(t.fx_occurrences, t.fx_external_domains, t.fx_tasks)
      .select("task_id", "domain", "page_url", "seq", "risk_level", "risk_root"),
      """select o.task_id, o.domain, o.page_url, o.seq, ed.risk_level, ed.root_domain as risk_root from fx_occurrences o
      join fx_external_domains ed on o.task_id = ed.task_id and o.domain = ed.domain join fx_tasks t on ed.task_id = t.task_id
      where t.status <> 'deleting' and ed.risk_level in ('critical','high','medium','low')""")
check("j3_domains_with_asset_evidence", lambda t: J.with_asset_evidence(t.fx_external_domains, t.fx_occurrences).select("task_id", "domain", "sample_page_url"),
      r"""select task_id, domain, sample_page_url from fx_external_domains ed where sample_page_url like '%.js' or sample_page_url like '%.js?%'
      or sample_page_url like '%.css' or sample_page_url like '%.css?%' or (task_id, domain) in (select (task_id, domain) from fx_occurrences
      where source_type like '%\_file\_%' escape '\' or page_url like '%.js%' or page_url like '%.css%')""")
check("j4_j5_orphan_tickets", lambda t: J.without_risky_domain(
    t.fx_tickets, t.fx_external_domains.withColumn("risk_level", F.when(F.col("verify_status") == "error", "safe").otherwise(F.col("risk_level"))))
    .select("id", "task_id", "domain", "page_url"),
      """select id, task_id, domain, page_url from fx_tickets r where not exists (select 1 from fx_external_domains ed where ed.task_id = r.task_id
      and ed.domain = r.domain and case when ed.verify_status = 'error' then 'safe' else ed.risk_level end in ('critical','high','medium','low'))""")
check("j9_w3_evidence_per_task", lambda t: J.evidence_per_task(t.fx_external_domains, t.fx_tasks, t.fx_occurrences)
      .select("task_id", "name", "domain", "occurrence_count", "page_url", "raw_match", "seq"),
      """with ranked as (select *, row_number() over (partition by task_id, domain order by seq) as rn from fx_occurrences)
      select ed.task_id, t.name, ed.domain, ed.occurrence_count, o.page_url, o.raw_match, o.seq from fx_external_domains ed
      join fx_tasks t on ed.task_id = t.task_id left join ranked o on o.task_id = ed.task_id and o.domain = ed.domain and o.rn <= 3
      where t.status <> 'deleting'""")
check("j10_rule_page_counts", lambda t: J.rule_page_counts(
    t.fx_profiles, R.root_page_counts(t.fx_occurrences.where(F.col("is_link"))),
    t.fx_occurrences.where(~F.col("is_link")).groupBy("domain", "root_domain").agg(F.countDistinct("page_url").alias("page_count")),
    t.fx_tickets, t.fx_external_domains).select("id", "domain", "match_type", "page_count"),
      r"""with r as (select *, ltrim(lower(trim(domain)), '*.') as target from fx_profiles),
      rc as (select root_domain, count(distinct page_url) as n from fx_occurrences where is_link group by 1),
      dc as (select domain, max(n) as n from (select domain, root_domain, count(distinct page_url) as n from fx_occurrences where not is_link group by 1, 2) group by 1),
      tr as (select root_domain, count(distinct page_url) as n from fx_tickets group by 1), td as (select domain, count(distinct page_url) as n from fx_tickets group by 1),
      er as (select root_domain, sum(occurrence_count) as n from fx_external_domains group by 1), ed as (select domain, sum(occurrence_count) as n from fx_external_domains group by 1)
      select id, r.domain, match_type, cast(coalesce(case when match_type <> 'exact' then rc.n end, dc.n,
       case match_type when 'root' then tr.n when 'exact' then td.n end, case match_type when 'root' then er.n when 'exact' then ed.n end, 0) as bigint) as page_count
      from r left join rc on rc.root_domain = target left join dc on dc.domain = target left join tr on tr.root_domain = target
      left join td on td.domain = target left join er on er.root_domain = target left join ed on ed.domain = target""")
check("j13_tickets_with_task", lambda t: R.on_live_tasks(t.fx_tickets, t.fx_tasks, "name", "target_url").select("id", "task_id", "name", "target_url", "domain"),
      f"select r.id, r.task_id, t.name, t.target_url, r.domain {LIVE_TICKETS}")
check("j14_rule_propagation", lambda t: J.suffix_matches(
    t.fx_external_domains, t.fx_profiles.select(F.col("id").alias("rule_id"), F.ltrim("domain", F.lit("*.")).alias("target")))
    .select("task_id", "domain", "rule_id"),
      """with r as (select id as rule_id, ltrim(domain, '*.') as target from fx_profiles)
      select task_id, ed.domain, rule_id from fx_external_domains ed join r on ed.root_domain = target or ed.domain = target or suffix(ed.domain, '.' || target)""")

# windows and sets
check("w1_evidence_cap", lambda t: X.cap_evidence(
    t.fx_occurrences.withColumn("side", F.lit("external"))).select("task_id", "page_url", "domain", "seq", "raw_match"),
      """select task_id, page_url, domain, seq, raw_match from (select *, row_number() over (partition by task_id, page_url, domain order by seq) as rn
      from fx_occurrences) where rn <= 5""")
check("w2_longest_snippet", lambda t: M.longest_snippet(t.fx_occurrences).select("task_id", "domain", "page_url", "context_snippet", "seq"),
      """select task_id, domain, page_url, context_snippet, seq from (select *, row_number() over (partition by task_id, domain, page_url
      order by length(context_snippet) desc, seq) as rn from fx_occurrences) where rn = 1""")
check("w4_keep_last_version", lambda t: M.keep_last(t.fx_occurrences, ["task_id", "page_url", "source_type"], "seq")
      .select("task_id", "page_url", "source_type", "seq", "raw_match"),
      """select task_id, page_url, source_type, seq, raw_match from (select *, row_number() over (partition by task_id, page_url, source_type
      order by seq desc) as rn from fx_occurrences) where rn = 1""")
check("u1_known_domains", lambda t: S.known_domains(t.fx_external_domains, t.fx_occurrences),
      "select task_id, domain from fx_external_domains union select task_id, domain from fx_occurrences")
check("u3_distinct_test_urls", lambda t: S.distinct_test_urls(t.fx_occurrences),
      "select distinct task_id, domain, page_url from fx_occurrences")
