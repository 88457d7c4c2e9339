"""Lists, filters and paging against SQL."""

from pyspark.sql import functions as F

from linklens.checks.registry import check
from linklens.checks.rollup_checks import text_ts
from linklens.operators import rollup as R
from linklens.operators import search as S

ED = ["task_id", "domain", "root_domain", "occurrence_count", "risk_level", "verify_status"]
ED_SQL = ", ".join(ED)

check("q1_pages_by_depth_and_search", lambda t: S.list_pages(t.fx_sitemap_pages, depth=2, status_code=200, search="/o/1")
      .select("id", "task_id", "url", "depth", "status_code"),
      """select id, task_id, url, depth, status_code from fx_sitemap_pages where depth = 2 and status_code = 200
      and (url like '%/o/1%' or title like '%/o/1%') order by depth, id""")
check("q2_domains_risk_only", lambda t: S.list_external_domains(t.fx_external_domains, has_link=True, risk_level="risk_only", verify_status="unverified").select(*ED),
      f"select {ED_SQL} from fx_external_domains where has_link and risk_level in ('critical','high','medium') and verify_status = 'unverified'")
check("q2_domains_by_root_and_search", lambda t: S.list_external_domains(t.fx_external_domains, has_text=True, search="s1%.gov", risk_level="low", sort_by="domain", order="ASC").select(*ED),
      f"select {ED_SQL} from fx_external_domains where has_text and risk_level = 'low' and (domain like '%s1%.gov%' or root_domain like '%s1%.gov%')")
check("q2_domains_of_root", lambda t: S.list_external_domains(t.fx_external_domains, root_domain="widelyused.net").select(*ED),
      f"select {ED_SQL} from fx_external_domains where root_domain = 'widelyused.net'")
check("q3_domains_from_assets", lambda t: S.list_external_domains(t.fx_external_domains, source_type="asset", occurrences=t.fx_occurrences, risk_level="high").select(*ED),
      f"""select {ED_SQL} from fx_external_domains ed where risk_level = 'high' and (sample_page_url like '%.js' or sample_page_url like '%.js?%' or sample_page_url like '%.css'
      or sample_page_url like '%.css?%' or exists (select 1 from fx_occurrences o where o.task_id = ed.task_id and o.domain = ed.domain
      and (contains(source_type, '_file_') or page_url like '%.js%' or page_url like '%.css%')))""")
check("q4_subdomains", lambda t: S.list_subdomains(t.fx_subdomains, has_link=True, search="o.s", sort_by="subdomain", order="ASC")
      .select("task_id", "domain", "occurrence_count"),
      "select task_id, domain, occurrence_count from fx_subdomains where has_link and domain like '%o.s%'")
check("q5_tasks", lambda t: S.list_tasks(t.fx_tasks).select("task_id", "name", "status"),
      "select task_id, name, status from fx_tasks where status <> 'deleting' order by task_id desc")
check("q6_task_search", lambda t: S.search_tasks(t.fx_tasks, "SITE 1", "completed").select("task_id", "name", "status"),
      "select task_id, name, status from fx_tasks where status = 'completed' and (contains(lower(name), 'site 1') or contains(lower(target_url), 'site 1'))")
check("q7_recent_logs", lambda t: text_ts(S.recent_logs(t.fx_logs, n=5), "created_at").select("task_id", "id", "message", "created_at"),
      """select task_id, id, message, strftime(created_at, '%Y-%m-%d %H:%M:%S') as created_at from (select *, row_number() over (partition by task_id order by id desc) as rn from fx_logs) where rn <= 5""")
check("q8_logs_of_level", lambda t: S.logs_of_level(t.fx_logs, "warn").select("id", "task_id", "message"),
      "select id, task_id, message from fx_logs where upper(coalesce(level, 'INFO')) = 'WARN'")
check("q9_evidence_of_domain", lambda t: S.look_up(t.fx_occurrences, domain="cdn.widelyused.net").orderBy(F.desc("seq")).select("task_id", "seq", "page_url", "raw_match"),
      "select task_id, seq, page_url, raw_match from fx_occurrences where domain = 'cdn.widelyused.net'")
check("q10_evidence_urls", lambda t: S.evidence_urls(t.fx_occurrences, t.fx_external_domains),
      """with u as (select distinct task_id, domain, page_url from fx_occurrences)
      select ed.task_id, ed.domain, coalesce(u.page_url, ed.sample_page_url) as page_url from fx_external_domains ed left join u on u.task_id = ed.task_id and u.domain = ed.domain""")
check("q11_global_list_page", lambda t: S.page(S.list_global(R.global_domains(
    t.fx_external_domains, t.fx_tasks, with_tasks=False)), 50, 50).select("domain", "total_occurrences", "task_count"),
      """select domain, cast(sum(occurrence_count) as bigint) as total_occurrences, count(*) as task_count from fx_external_domains ed join fx_tasks t on t.task_id = ed.task_id
      where t.status <> 'deleting' group by domain, root_domain order by 2 desc, 1 limit 50 offset 50""")
check("q12_rules", lambda t: S.list_rules(t.fx_profiles, search="note", risk_level="high").select("id", "domain", "remark"),
      "select id, domain, remark from fx_profiles where (domain like '%note%' or remark like '%note%' or category like '%note%') and risk_level = 'high'")
check("q12_j10_rule_list", lambda t: S.rule_list(
    t.fx_profiles, R.root_page_counts(t.fx_occurrences), t.fx_occurrences.groupBy("domain", "root_domain").agg(F.countDistinct("page_url").alias("page_count")), t.fx_tickets, t.fx_external_domains,
    limit=40, offset=10).select("id", "domain", "match_type", "page_count"),
      r"""with r as (select *, ltrim(lower(trim(domain)), '*.') as target from fx_profiles order by id desc limit 40 offset 10)
      select id, domain, match_type, coalesce(case when match_type <> 'exact' then (select count(distinct page_url) from fx_occurrences o where o.root_domain = r.target having count(*) > 0) end,
       (select max(n) from (select count(distinct page_url) as n from fx_occurrences o where o.domain = r.target group by o.root_domain)),
       case when match_type = 'root' then (select count(distinct page_url) from fx_tickets o where o.root_domain = r.target having count(*) > 0) when match_type = 'exact' then (select count(distinct page_url) from fx_tickets o where o.domain = r.target having count(*) > 0) end,
       case when match_type = 'root' then (select sum(occurrence_count) from fx_external_domains o where o.root_domain = r.target) when match_type = 'exact' then (select sum(occurrence_count) from fx_external_domains o where o.domain = r.target) end, 0)::bigint as page_count from r""")
check("a12_tasks_of_page", lambda t: S.tasks_of_page(S.page(S.list_global(R.global_domains(t.fx_external_domains, t.fx_tasks, with_tasks=False)), 50, 50), t.fx_external_domains, t.fx_tasks).select(
    "domain", "total_occurrences", F.array_join(F.transform("associated_tasks", lambda x: F.concat_ws(":::", x["task_id"].cast("string"), x["task_name"], x["occurrence_count"].cast("string"))), ";;;").alias("tasks_summary")),
      """select domain, cast(sum(occurrence_count) as bigint) as total_occurrences, string_agg(ed.task_id || ':::' || t.name || ':::' || ed.occurrence_count, ';;;' order by ed.task_id) as tasks_summary
      from fx_external_domains ed join fx_tasks t on ed.task_id = t.task_id where t.status <> 'deleting' group by domain, root_domain order by 2 desc, 1 limit 50 offset 50""")
check("q13_tickets", lambda t: S.list_tickets(t.fx_tickets, t.fx_tasks, risk_level="all_risk", verify_status="pending_only", manual_status="pending", search="Site 1")
      .select("id", "task_id", "task_name", "domain", "verify_status"),
      """select r.id, r.task_id, t.name as task_name, r.domain, r.verify_status from fx_tickets r join fx_tasks t on r.task_id = t.task_id
      where t.status <> 'deleting' and r.risk_level in ('critical','high','medium','low') and r.verify_status in ('unverified','verified_failed')
      and r.manual_status = 'pending' and (r.page_url like '%Site 1%' or r.domain like '%Site 1%' or t.name like '%Site 1%')""")
QUEUE = """select r.id, r.task_id, r.domain, r.page_url, r.source_type, strftime(r.last_verified_at, '%Y-%m-%d %H:%M:%S') as last_verified_at, r.raw_match
 from fx_tickets r join fx_tasks t on r.task_id = t.task_id where t.status <> 'deleting' and r.manual_status <> 'ignored' and r.verify_status in ({0})"""
check("q14_retest_queue", lambda t: text_ts(S.retest_queue(t.fx_tickets, t.fx_tasks), "last_verified_at"), QUEUE.format("'unverified','verified_failed'"))
check("q15_rollback_queue", lambda t: text_ts(S.rollback_queue(t.fx_tickets, t.fx_tasks), "last_verified_at"), QUEUE.format("'verified_clean','page_removed'"))
check("q14_retest_queue_head", lambda t: S.page(S.retest_queue(t.fx_tickets, t.fx_tasks), 100).select("id"),
      QUEUE.format("'unverified','verified_failed'").replace("select r.id, r.task_id, r.domain, r.page_url, r.source_type, strftime(r.last_verified_at, '%Y-%m-%d %H:%M:%S') as last_verified_at, r.raw_match", "select r.id")
      + " order by r.last_verified_at asc nulls first, r.id limit 100")
check("q16_rule_by_domain", lambda t: S.look_up(t.fx_profiles, domain="widelyused.net").select("id", "domain", "risk_level"),
      "select id, domain, risk_level from fx_profiles where domain = 'widelyused.net'")
check("q17_total_beside_page", lambda t: S.total_of(S.list_external_domains(t.fx_external_domains, risk_level="medium")),
      "select count(*) as total from fx_external_domains where risk_level = 'medium'")
check("q18_page_three", lambda t: S.page(S.list_external_domains(t.fx_external_domains), 20, 40).select("task_id", "domain", "occurrence_count"),
      "select task_id, domain, occurrence_count from fx_external_domains order by occurrence_count desc, id desc limit 20 offset 40")
check("q19_unknown_sort_column", lambda t: S.page(S.list_external_domains(t.fx_external_domains, sort_by="drop table", order="asc"), 30).select("task_id", "domain", "occurrence_count"),
      "select task_id, domain, occurrence_count from fx_external_domains order by occurrence_count asc, id desc limit 30")
check("q20_pending_delete", lambda t: S.pending_delete(t.fx_tasks), "select task_id from fx_tasks where status = 'deleting'")
