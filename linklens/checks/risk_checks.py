"""Rules, retests and mutations against SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens import fixed_values as v
from linklens.checks.registry import check
from linklens.operators import merge as M
from linklens.operators import risk as K
from linklens.operators import rollup as R
from linklens.plans import retest

RUN = "2030-01-01 00:00:00"


def run_ts():
    return F.lit(RUN).cast("timestamp")


def quoted(values) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in values)


def domains(t) -> DataFrame:
    return (t.fx_external_domains.withColumn("risk_tags", F.array(F.lit("old"))).withColumn("risk_remark", F.lit("before"))
            .withColumn("verify_time", F.col("created_at").cast("timestamp")).withColumn("verify_detail", F.lit("")))


def tickets(t) -> DataFrame:
    return (t.fx_tickets.withColumn("page_title", F.lit("")).withColumn("risk_tags", F.array(F.lit("old"))).withColumn("risk_remark", F.lit("before"))
            .withColumn("last_verify_detail", F.lit("")).withColumn("last_verified_at", F.col("last_verified_at").cast("timestamp"))
            .withColumn("created_at", F.col("created_at").cast("timestamp")).withColumn("updated_at", F.col("created_at")))


def rules(t) -> DataFrame:
    return (t.fx_profiles.withColumn("tags", F.split("tags_text", "/")).withColumn("source", F.lit("manual"))
            .withColumn("created_at", F.lit("2020-01-01 00:00:00").cast("timestamp")).withColumn("updated_at", F.col("created_at")).drop("tags_text"))


def at_rest(t, *more: str):
    """The tables with what a retest reads written out, as a store has it."""
    return t.once(*more, "fx_external_domains", "fx_responses", "fx_tickets")


def retested(t) -> DataFrame:
    return K.retest_pages(tickets(t), t.fx_responses, run_ts())


def tags(df: DataFrame, c: str = "risk_tags") -> DataFrame:
    return df.withColumn(c, F.array_join(c, "/"))


RULES_SQL = "r as (select *, ltrim(lower(trim(domain)), '*.') as target from fx_profiles)"
SAFE = " or ".join(f"{c} in ({quoted(v.SAFE_ROOTS)}) or " + " or ".join(f"suffix({c}, '.{s}')" for s in v.SAFE_ROOTS)
                   + f" or suffix({c}, '.gov.cn') or suffix({c}, '.edu.cn')" for c in ("n.domain", "n.root_domain"))
EVALUATED = f"""with {RULES_SQL}, n as (select distinct domain, root_domain from fx_external_domains),
 hits as (select n.domain, n.root_domain, r.*, row_number() over (partition by n.domain, n.root_domain order by case when n.domain = target then 1 else 2 end, id) as rn
  from n join r on n.domain = target or (match_type in ('root','wildcard') and (n.root_domain = target or suffix(n.domain, '.' || target)))),
 best as (select domain as d, root_domain as rd, id, domain_1 as rule, risk_level, category, tags_text, remark from hits where rn = 1),
 ev as (select n.domain, n.root_domain, case when id is not null then best.risk_level when {SAFE} then 'safe' else 'pending' end as risk_level,
  case when id is not null then case when list_contains(string_split(tags_text, '/'), category) then tags_text else category || '/' || tags_text end
   when {SAFE} then '{v.TAG_SAFE}' else '' end as risk_tags,
  case when id is not null then case when remark = '' then '{v.REMARK_RULE_HIT}' || rule else remark end when {SAFE} then '{v.REMARK_SAFE}' else '' end as risk_remark,
  case when id is not null then 'intel_rule' when {SAFE} then 'builtin_rule' else 'pending' end as risk_source
  from n left join best on best.d = n.domain and best.rd = n.root_domain)
"""

check("risk1_j6_j7_w5_evaluate_domains", lambda t: tags(K.evaluate(t.fx_external_domains.select("task_id", "domain", "root_domain"), rules(t))),
      EVALUATED + """select ed.task_id, ev.* from fx_external_domains ed join ev on ed.domain = ev.domain and ed.root_domain = ev.root_domain""")
check("j6_w5_first_matching_rule", lambda t: K.match_rules(t.fx_external_domains, rules(t)).select("domain", F.col("rule.id").alias("rule_id")),
      f"""with {RULES_SQL}, n as (select distinct domain, root_domain from fx_external_domains)
      select d as domain, id as rule_id from (select n.domain as d, id, row_number() over (partition by n.domain order by case when n.domain = target then 1 else 2 end, id) as rn
      from n join r on n.domain = target or (match_type in ('root','wildcard') and (n.root_domain = target or suffix(n.domain, '.' || target)))) where rn = 1""")
check("f32_j7_allow_listed", lambda t: K.allow_listed(t.fx_external_domains).select("task_id", "domain"),
      f"select task_id, domain from fx_external_domains n where {SAFE}")

FOUND = "(contains(lower(body), lower(r.domain)) or (length(r.raw_match) > 6 and contains(lower(body), lower(r.raw_match))))"
RETEST_SQL = f"""select r.id, r.task_id, r.domain, r.page_url,
 case when error = 'Connection Failed' then 'page_removed' when error <> '' then 'error' when status_code in (404, 410) or (status_code >= 400 and contains(body, '404')) then 'page_removed'
  when status_code >= 500 then 'error' when {FOUND} then 'verified_failed' else 'verified_clean' end as verify_status
 from fx_tickets r join fx_responses p on p.url = r.page_url"""
check("risk2_retest_pages", lambda t: retested(t).select("id", "task_id", "domain", "page_url", "verify_status"), RETEST_SQL)
check("risk2_retest_texts", lambda t: retested(t).select("id", "verify_detail", F.coalesce("context_snippet", F.lit("-")).alias("context_snippet"),
                                                         F.coalesce("page_title", F.lit("-")).alias("page_title")),
      f"""with x as (select r.id, lower(r.domain) as d, status_code as code, error, body, {FOUND} as found,
       error = '' and status_code not in (404, 410) and not (status_code >= 400 and contains(body, '404')) and status_code < 500 as seen,
       greatest(0, strpos(lower(body), lower(r.domain)) - 61) as a, least(length(body), strpos(lower(body), lower(r.domain)) - 1 + length(r.domain) + 60) as z
       from fx_tickets r join fx_responses p on p.url = r.page_url)
      select id, case when error = 'Request Timeout' then '{v.PAGE_TIMEOUT}' when error = 'Connection Failed' then '{v.PAGE_UNREACHABLE.replace("{0}", "ConnectError")}'
       when error <> '' then '{v.PAGE_OTHER_ERROR.replace("{0}", "")}' || left(error, 120)
       when code in (404, 410) then replace('{v.PAGE_GONE}', '{{0}}', code::varchar) when code >= 400 and contains(body, '404') then replace('{v.PAGE_GONE_BODY}', '{{0}}', code::varchar)
       when code >= 500 then replace('{v.PAGE_SERVER_ERROR}', '{{0}}', code::varchar)
       when found then replace(replace('{v.PAGE_STILL_THERE}', '{{0}}', code::varchar), '{{1}}', d) else replace(replace('{v.PAGE_CLEARED}', '{{0}}', code::varchar), '{{1}}', d) end as verify_detail,
       case when seen and found then (case when a > 0 then '...' else '' end) || substr(body, a + 1, z - a) || (case when z < length(body) then '...' else '' end) else '-' end as context_snippet,
       case when seen then left(regexp_replace(trim(regexp_extract(body, '<title[^>]*>(.*?)</title>', 1)), '\\s+', ' ', 'g'), 150) else '-' end as page_title from x""")

RESULTS = f"""u as (select distinct task_id, domain, page_url as url from fx_occurrences),
 res as (select u.*, case when error is null or error <> '' then null else status_code not in (404, 410) and contains(lower(body), lower(domain)) end as found
 from u left join fx_responses p on p.url = u.url),
 c as (select task_id, domain, count(*) as tested_count, count(*) filter (where found) as still_present_count, count(*) filter (where not found) as cleared_count,
 count(*) filter (where found is null) as error_count from res group by 1, 2),
 verdict as (select *, case when still_present_count > 0 then 'verified_failed' when cleared_count > 0 then 'verified_clean' else 'error' end as verify_status from c)
"""
check("risk3_a23_retest_domains", lambda t: K.retest_domains(t.fx_occurrences, t.fx_responses),
      f"""with {RESULTS} select *, case when still_present_count > 0 then replace(replace('{v.VERDICT_FAILED}', '{{0}}', tested_count::varchar), '{{1}}', still_present_count::varchar)
      when cleared_count > 0 then replace('{v.VERDICT_CLEAN}', '{{0}}', tested_count::varchar) else replace('{v.VERDICT_ERROR}', '{{0}}', tested_count::varchar) end as summary from verdict""")
check("risk3_page_results", lambda t: K.retest_page_results(t.fx_occurrences, t.fx_responses).select("task_id", "domain", "url", "status", "found"),
      f"""with {RESULTS} select task_id, domain, res.url, case when found is null then 'error' when status_code in (404, 410) then 'page_removed'
      when found then 'domain_still_present' else 'domain_cleared' end as status, found from res left join fx_responses p on p.url = res.url""")
check("risk3_quick_batch_form", lambda t: K.retest_domains(t.fx_occurrences, t.fx_responses, max_urls=5).select("task_id", "domain", "verify_status", "tested_count"),
      f"""with w as (select task_id, domain, url, row_number() over (partition by task_id, domain order by url) as rn from (select distinct task_id, domain, page_url as url from fx_occurrences)),
      res as (select w.*, case when error <> '' then null else status_code not in (404, 410) and contains(lower(body), lower(domain)) end as found from w join fx_responses p on p.url = w.url where rn <= 5)
      select task_id, domain, case when bool_or(found) then 'verified_failed' when count(*) filter (where not found) > 0 then 'verified_clean' else 'error' end as verify_status,
      count(*) as tested_count from res group by 1, 2""")
check("risk3_verdict_details", lambda t: K.verdict_details(K.retest_page_results(t.fx_occurrences, t.fx_responses)).select(
    "task_id", "domain", F.size("details").cast("long").alias("n"), F.col("details")[0]["url"].alias("first_url")),
      "select task_id, domain, least(count(distinct page_url), 200) as n, min(page_url) as first_url from fx_occurrences group by 1, 2")
check("risk4_a26_domain_over_tasks", lambda t: K.retest_domain_over_tasks(t.fx_occurrences, t.fx_responses),
      f"""with {RESULTS} select domain, count(*) as task_count, case when bool_or(verify_status = 'verified_failed') then 'verified_failed'
      when bool_and(verify_status = 'verified_clean') then 'verified_clean' else 'unverified' end as overall_status from verdict group by 1""")

check("risk4_domain_retest_job", lambda t: domain_verdicts_applied(t, 3),
      f"""with {RESULTS} select domain, count(*) as task_count, case when bool_or(verify_status = 'verified_failed') then 'verified_failed'
      when bool_and(verify_status = 'verified_clean') then 'verified_clean' else 'unverified' end as overall_status from verdict group by 1""")

# mutations
def pages_and_batch(t) -> tuple[DataFrame, DataFrame]:
    """Stored pages, and a batch that brings known and new ones."""
    return (t.fx_sitemap_pages.where("status_code <> 404").select("id", "task_id", "url", "path", "depth", "status_code", "title", "crawled_at"),
            t.fx_sitemap_pages.where("status_code <> 200").select(
                "id", "task_id", "url", F.lit("/new").alias("path"), F.lit(9).alias("depth"), F.lit(599).alias("status_code"), F.concat("title", F.lit("!")).alias("title"), "crawled_at"))


def domains_and_batch(t) -> tuple[DataFrame, DataFrame]:
    return (t.fx_external_domains.withColumn("sample_page_url", F.when(F.col("has_link"), F.col("sample_page_url")).otherwise(F.lit("")))
            .select("task_id", "domain", "root_domain", "occurrence_count", "has_link", "has_text", "sample_page_url", "risk_level"),
            R.domain_rollup(t.fx_occurrences.where(~F.col("is_link"))).withColumn("risk_level", F.lit("new")))


def stale_tickets(t) -> DataFrame:
    short = F.when(F.col("manual_status") == "pending", "short").otherwise(F.col("context_snippet"))
    return tickets(t).where("verify_status <> 'error'").withColumn("context_snippet", short).withColumn("risk_level", F.lit("stale"))


def synced(df: DataFrame) -> DataFrame:
    return df.select("task_id", "domain", "page_url", "risk_level", "context_snippet", "verify_status", "manual_status", F.date_format("updated_at", "yyyy").alias("updated"))


check("m1_s10_page_upsert", lambda t: M.merge_pages(*pages_and_batch(t)).select("task_id", "url", "path", "depth", "status_code", "title"),
      """select task_id, url, case when status_code = 404 then '/new' else path end as path, case when status_code = 404 then 9 else depth end as depth,
      case when status_code = 200 then 200 else 599 end as status_code, case when status_code = 200 then title else title || '!' end as title from fx_sitemap_pages""")
check("m2_m3_domain_upsert", lambda t: M.merge_domains(*domains_and_batch(t)),
      """with n as (select task_id, domain, count(*) as n, min(page_url) as p from fx_occurrences where not is_link group by 1, 2)
      select ed.task_id, ed.domain, root_domain, occurrence_count + coalesce(n, 0) as occurrence_count, has_link, has_text or n.n is not null as has_text,
      case when has_link then sample_page_url else coalesce(p, '') end as sample_page_url, risk_level from fx_external_domains ed left join n on n.task_id = ed.task_id and n.domain = ed.domain""")
check("m4_manual_risk", lambda t: M.set_manual_risk(domains(t), 7, "cdn.widelyused.net", "critical", ["x", "y"], "seen").select("task_id", "domain", "risk_level", "risk_source", "risk_remark"),
      """select task_id, domain, case when h then 'critical' else risk_level end as risk_level, case when h then 'manual' else risk_source end as risk_source, case when h then 'seen' else 'before' end as risk_remark
      from (select *, task_id = 7 and domain = 'cdn.widelyused.net' as h from fx_external_domains)""")
check("m5_manual_risks", lambda t: tags(M.set_manual_risks(domains(t), t.fx_subdomains.where("has_link").select(
    "task_id", "domain", F.lit("low").alias("new_level"), F.array(F.lit("k")).alias("new_tags"), F.lit("bulk").alias("new_remark"))))
      .select("task_id", "domain", "risk_level", "risk_tags", "risk_remark", "risk_source"),
      """select task_id, domain, case when has_link then 'low' else risk_level end as risk_level, case when has_link then 'k' else 'old' end as risk_tags,
      case when has_link then 'bulk' else 'before' end as risk_remark, case when has_link then 'manual' else risk_source end as risk_source from fx_external_domains""")
check("m6_rule_propagation", lambda t: M.propagate_rule(domains(t), "s7.edu.cn", "root", "high", ["p"]).select("task_id", "domain", "risk_level", "risk_remark", "risk_source"),
      f"""select task_id, domain, case when h then 'high' else risk_level end as risk_level, case when h then '{v.REMARK_RULE_INHERITED}s7.edu.cn' else 'before' end as risk_remark,
      case when h then 'intel_rule' else risk_source end as risk_source from (select *, (root_domain = 's7.edu.cn' or domain like '%.s7.edu.cn') and risk_source <> 'manual' as h from fx_external_domains)""")
check("m7_rule_upsert", lambda t: M.upsert_rules(rules(t), rules(t).where("match_type = 'root'").select(
    F.when(F.col("risk_level") == "high", F.upper("domain")).otherwise(F.concat(F.lit("*.x-"), F.ltrim("domain", F.lit("*.")))).alias("domain"),
    (F.col("id") + 100000).alias("id"), F.lit("exact").alias("match_type"), F.lit("low").alias("risk_level"), "category", "tags", F.lit("import").alias("source"), F.lit("r").alias("remark")), run_ts())
      .select("id", "domain", "match_type", "risk_level", "source", "remark", F.date_format("created_at", "yyyy").alias("created"), F.date_format("updated_at", "yyyy").alias("updated")),
      """with o as (select * from fx_profiles), n as (select case when risk_level = 'high' then lower(ltrim(domain, '*.')) else 'x-' || ltrim(domain, '*.') end as domain, id + 100000 as id
      from fx_profiles where match_type = 'root')
      select case when o.domain is null then n.id else o.id end as id, coalesce(o.domain, n.domain) as domain, case when n.domain is null then match_type else 'exact' end as match_type,
      case when n.domain is null then risk_level else 'low' end as risk_level, case when o.domain is null then 'import' else 'manual' end as source, case when n.domain is null then remark else 'r' end as remark,
      case when o.domain is null then '2030' else '2020' end as created, case when n.domain is null then '2020' else '2030' end as updated from o full join n on o.domain = n.domain""")
SYNC = f"""with {RULES_SQL.replace("*, ", "id, match_type, risk_level, tags_text, remark, ")},
 n as (select domain, root_domain from fx_external_domains union select domain, root_domain from fx_tickets),
 m as (select n.domain, n.root_domain, r.* from n join r on (match_type = 'root' and (n.root_domain = target or n.domain = target or suffix(n.domain, '.' || target))) or n.domain = target),
 e as (select domain, root_domain, arg_max(risk_level, id) as lv, arg_max(tags_text, id) as tg, arg_max(case when remark = '' then '{v.REMARK_RULE_HIT}' || target else remark end, id) as rm,
  bool_or(risk_level in ('safe','pending')) as harmless from m group by 1, 2),
 d as (select ed.task_id, ed.domain, ed.root_domain, case when h then lv else risk_level end as risk_level, case when h then tg else 'old' end as risk_tags, case when h then rm else 'before' end as risk_remark,
  case when h then 'intel_rule' else risk_source end as risk_source from (select ed.*, lv, tg, rm, lv is not null and risk_source <> 'manual' as h from fx_external_domains ed left join e using (domain, root_domain)) ed)
"""
check("m9_rule_sync_domains", lambda t: tags(M.sync_rules(domains(t), tickets(t), rules(t))[0]).select("task_id", "domain", "risk_level", "risk_tags", "risk_remark", "risk_source"),
      SYNC + "select task_id, domain, risk_level, risk_tags, risk_remark, risk_source from d")
check("m9_j5_rule_sync_tickets", lambda t: tags(M.sync_rules(domains(t), tickets(t), rules(t))[1]).select("id", "domain", "risk_level", "risk_tags", "risk_remark"),
      SYNC + """select r.id, r.domain, coalesce(lv, r.risk_level) as risk_level, coalesce(tg, 'old') as risk_tags, coalesce(rm, 'before') as risk_remark
      from fx_tickets r left join e on e.domain = r.domain and e.root_domain = r.root_domain where not coalesce(harmless, false)
      and exists (select 1 from d where d.task_id = r.task_id and d.domain = r.domain and d.risk_level in ('critical','high','medium','low'))""")
def new_tickets(t) -> DataFrame:
    return M.sync_rules_and_tickets(domains(t), tickets(t).where("verify_status <> 'error'"), rules(t), t.fx_occurrences, t.fx_tasks, run_ts())[1]


check("m9_m12_rule_sync_new_tickets", lambda t: new_tickets(t.once("fx_occurrences", "fx_external_domains", "fx_tickets")).select(
    "task_id", "domain", "page_url", "risk_level", "context_snippet", "manual_status", F.date_format("updated_at", "yyyy").alias("updated")),
      SYNC + """, kept as (select r.*, coalesce(lv, r.risk_level) as lv2 from fx_tickets r left join e on e.domain = r.domain and e.root_domain = r.root_domain
       where r.verify_status <> 'error' and not coalesce(harmless, false)
       and exists (select 1 from d where d.task_id = r.task_id and d.domain = r.domain and d.risk_level in ('critical','high','medium','low'))),
      cand as (select x.task_id, x.domain, x.page_url, d.risk_level, x.context_snippet, row_number() over (partition by x.task_id, x.domain, x.page_url order by length(x.context_snippet) desc, x.seq) as rn
       from fx_occurrences x join d on x.task_id = d.task_id and x.domain = d.domain join fx_tasks t on t.task_id = x.task_id
       where t.status <> 'deleting' and d.risk_level in ('critical','high','medium','low')), fresh as (select * from cand where rn = 1)
      select coalesce(o.task_id, n.task_id) as task_id, coalesce(o.domain, n.domain) as domain, coalesce(o.page_url, n.page_url) as page_url, case when n.domain is null then o.lv2 else n.risk_level end as risk_level,
      case when o.domain is null or (n.domain is not null and length(o.context_snippet) < 10) then n.context_snippet else o.context_snippet end as context_snippet,
      coalesce(o.manual_status, 'pending') as manual_status, case when n.domain is null then strftime(o.created_at, '%Y') else '2030' end as updated
      from kept o full join fresh n on o.task_id = n.task_id and o.domain = n.domain and o.page_url = n.page_url""")
GONE = "select *, (root_domain = 'widelyused.net' or domain = 'widelyused.net' or domain like '%.widelyused.net') as h from"
check("m10_rule_delete_domains", lambda t: M.delete_rule(domains(t), tickets(t), rules(t), 0)[1].select("task_id", "domain", "risk_level", "risk_source", "verify_status"),
      f"""select task_id, domain, case when h and risk_source <> 'manual' then 'pending' else risk_level end as risk_level, case when h and risk_source <> 'manual' then '' else risk_source end as risk_source,
      case when h and risk_source <> 'manual' then 'unverified' else verify_status end as verify_status from ({GONE} fx_external_domains)""")
check("m10_j4_rule_delete_tickets", lambda t: M.delete_rule(domains(t), tickets(t), rules(t), 0)[2].select("id", "task_id", "domain"),
      f"""select id, task_id, domain from ({GONE} fx_tickets) r where not h or exists (select 1 from fx_external_domains ed where ed.task_id = r.task_id and ed.domain = r.domain
      and ed.risk_source = 'manual' and ed.risk_level in ('critical','high','medium','low'))""")
check("m11_reevaluate", lambda t: tags(M.reevaluate(domains(t), rules(t))).select("task_id", "domain", "risk_level", "risk_tags", "risk_source"),
      EVALUATED + """select ed.task_id, ed.domain, case when ed.risk_source = 'manual' then ed.risk_level else ev.risk_level end as risk_level,
      case when ed.risk_source = 'manual' then 'old' else ev.risk_tags end as risk_tags, case when ed.risk_source = 'manual' then 'manual' else ev.risk_source end as risk_source
      from fx_external_domains ed join ev on ed.domain = ev.domain and ed.root_domain = ev.root_domain""")
def ticket_sync(t) -> DataFrame:
    return M.sync_tickets(stale_tickets(t), t.fx_occurrences, domains(t), t.fx_tasks, run_ts())


check("m12_ticket_sync", lambda t: synced(ticket_sync(t.once("fx_occurrences", "fx_external_domains", "fx_tickets"))),
      """with c as (select o.task_id, o.domain, o.page_url, ed.risk_level, ed.verify_status, context_snippet, row_number() over (partition by o.task_id, o.domain, o.page_url order by length(context_snippet) desc, seq) as rn
       from fx_occurrences o join fx_external_domains ed on o.task_id = ed.task_id and o.domain = ed.domain join fx_tasks t on t.task_id = o.task_id
       where t.status <> 'deleting' and ed.risk_level in ('critical','high','medium','low')), n as (select * from c where rn = 1),
      o as (select *, case when manual_status = 'pending' then 'short' else context_snippet end as s from fx_tickets where verify_status <> 'error')
      select coalesce(o.task_id, n.task_id) as task_id, coalesce(o.domain, n.domain) as domain, coalesce(o.page_url, n.page_url) as page_url,
      case when n.domain is null then 'stale' else n.risk_level end as risk_level, case when o.domain is null or (n.domain is not null and length(o.s) < 10) then n.context_snippet else o.s end as context_snippet,
      coalesce(o.verify_status, n.verify_status) as verify_status, coalesce(o.manual_status, 'pending') as manual_status, case when n.domain is null then strftime(o.created_at, '%Y') else '2030' end as updated
      from o full join n on o.task_id = n.task_id and o.domain = n.domain and o.page_url = n.page_url""")
APPLIED = f"""with vd as ({RETEST_SQL}), a as (select r.id, r.task_id, r.domain, vd.verify_status,
 case when vd.verify_status in ('verified_clean','page_removed') and manual_status <> 'ignored' then 'resolved' when vd.verify_status = 'verified_failed' and manual_status = 'resolved' then 'pending' else manual_status end as manual_status,
 case when vd.verify_status in ('verified_clean','page_removed') and manual_status <> 'ignored' and (manual_remark = '' or contains(manual_remark, '{v.REMARK_REOPENED_MARK}')) then '{v.REMARK_PAGE_CLEARED}'
  when vd.verify_status = 'verified_failed' and manual_status = 'resolved' then '{v.REMARK_REAPPEARED}' else manual_remark end as manual_remark
 from fx_tickets r join vd on vd.id = r.id)
"""
def page_verdicts_applied(t) -> DataFrame:
    return M.apply_page_verdicts(tickets(t), retested(t), run_ts())


check("m13_page_verdicts_applied", lambda t: page_verdicts_applied(at_rest(t)).select("id", "task_id", "domain", "verify_status", "manual_status", "manual_remark"),
      APPLIED + "select * from a")
def all_retested(t):
    return retest.retest_all(tickets(t), domains(t), t.fx_responses, run_ts())


check("m14_a30_domains_closed", lambda t: all_retested(at_rest(t))[1].select("task_id", "domain", "verify_status"),
      APPLIED + """, s as (select task_id, domain, bool_or(verify_status = 'verified_failed') as f, bool_and(verify_status in ('verified_clean','page_removed')) as c from a group by 1, 2)
      select ed.task_id, ed.domain, case when f then 'verified_failed' when c then 'verified_clean' else verify_status end as verify_status from fx_external_domains ed left join s on s.task_id = ed.task_id and s.domain = ed.domain""")


def domain_verdicts_applied(t, i):
    t = at_rest(t, "fx_occurrences")
    return retest.retest_domains(domains(t), tickets(t), t.fx_occurrences, t.fx_responses, run_ts())[i]


check("m15_domain_verdict_on_domains", lambda t: domain_verdicts_applied(t, 0).select("task_id", "domain", "verify_status"),
      f"with {RESULTS} select task_id, domain, verify_status from verdict")
check("m15_domain_verdict_on_tickets", lambda t: domain_verdicts_applied(t, 1).select("id", "verify_status", "manual_status", "manual_remark"),
      f"""with {RESULTS}, p as (select r.id, manual_status as ms, manual_remark as mr, case when verdict.verify_status = 'verified_clean' then 'verified_clean' when not found then 'verified_clean' when found then 'verified_failed' else 'error' end as s
      from fx_tickets r join verdict on verdict.task_id = r.task_id and verdict.domain = r.domain join res on res.task_id = r.task_id and res.domain = r.domain and res.url = r.page_url)
      select id, s as verify_status, case when s = 'verified_clean' and ms <> 'ignored' then 'resolved' when s = 'verified_failed' and ms = 'resolved' then 'pending' else ms end as manual_status,
      case when s = 'verified_clean' and ms <> 'ignored' and (mr = '' or contains(mr, '{v.REMARK_REOPENED_MARK}')) then '{v.REMARK_DOMAIN_CLEARED}' when s = 'verified_failed' and ms = 'resolved' then '{v.REMARK_REAPPEARED}' else mr end as manual_remark from p""")

check("m15_ticket_details", lambda t: domain_verdicts_applied(t, 1).select(
    "id", F.get_json_object("last_verify_detail", "$.url").alias("url"), F.get_json_object("last_verify_detail", "$.found").alias("found"),
    F.get_json_object("last_verify_detail", "$.still_present_count").alias("still"), F.date_format("updated_at", "yyyy").alias("updated")),
      f"""with {RESULTS} select r.id, case when verdict.verify_status <> 'verified_clean' then r.page_url end as url, case when verdict.verify_status <> 'verified_clean' then cast(found as varchar) end as found,
      case when verdict.verify_status = 'verified_clean' then cast(still_present_count as varchar) end as still, '2030' as updated
      from fx_tickets r join verdict on verdict.task_id = r.task_id and verdict.domain = r.domain join res on res.task_id = r.task_id and res.domain = r.domain and res.url = r.page_url""")


def rollback(t, i):
    closed = tickets(t).where(F.col("verify_status").isin(*v.CLOSED_STATES) & (F.col("manual_status") != "ignored"))
    return M.mark_rollbacks(tickets(t), domains(t), K.retest_pages(closed, t.fx_responses, run_ts()), run_ts())[i]


ROLLED = f"""with vd as ({RETEST_SQL}), f as (select vd.id, vd.task_id, vd.domain from vd join fx_tickets r on r.id = vd.id where vd.verify_status = 'verified_failed'
 and r.verify_status in ('verified_clean','page_removed') and r.manual_status <> 'ignored')
"""
check("m16_rollback_tickets", lambda t: rollback(t, 0).select("id", "verify_status", "manual_status", "manual_remark"),
      ROLLED + f"""select r.id, case when f.id is not null then 'verified_failed' else verify_status end as verify_status, case when f.id is not null then 'pending' else manual_status end as manual_status,
      case when f.id is not null then '{v.REMARK_ROLLBACK}' else manual_remark end as manual_remark from fx_tickets r left join f on f.id = r.id""")
check("m16_rollback_domains", lambda t: rollback(t, 1).select("task_id", "domain", "verify_status"),
      ROLLED + """select ed.task_id, ed.domain, case when exists (select 1 from f where f.task_id = ed.task_id and f.domain = ed.domain) then 'verified_failed' else verify_status end as verify_status
      from fx_external_domains ed""")
check("m17_reconcile_tickets", lambda t: M.reconcile_tickets(tickets(t), run_ts()).select("id", "verify_status", "manual_status", "manual_remark"),
      f"""select id, verify_status, case when c then 'resolved' when f then 'pending' else manual_status end as manual_status,
      case when c then coalesce(nullif(manual_remark, ''), '{v.REMARK_PAGE_CLEARED}') when f then '{v.REMARK_REAPPEARED}' else manual_remark end as manual_remark
      from (select *, verify_status in ('verified_clean','page_removed') and manual_status not in ('resolved','ignored') as c, verify_status = 'verified_failed' and manual_status = 'resolved' as f from fx_tickets)""")
check("m17_reconcile_counts", lambda t: M.reconcile_counts(t.fx_tickets),
      """select count(*) filter (where verify_status in ('verified_clean','page_removed') and manual_status not in ('resolved','ignored')) as auto_resolved,
      count(*) filter (where verify_status = 'verified_failed' and manual_status = 'resolved') as reopened from fx_tickets""")
check("m18_ticket_batch_status", lambda t: M.set_ticket_status(tickets(t), t.fx_tickets.where("risk_level = 'low'"), "ignored", "bulk", run_ts()).select("id", "manual_status", "manual_remark"),
      """select id, case when risk_level = 'low' then 'ignored' else manual_status end as manual_status, case when risk_level = 'low' then 'bulk' else manual_remark end as manual_remark from fx_tickets""")
def with_bad_names(df):
    return df.withColumn("domain", F.when(F.col("risk_level") == "low", F.concat("domain", F.lit(".window.open"))).when(F.col("risk_level") == "safe", F.concat("domain", F.lit(".js"))).otherwise(F.col("domain")))


def purged(t, i):
    d = with_bad_names(t.fx_external_domains)
    occ = with_bad_names(t.fx_occurrences.join(t.fx_external_domains.select("task_id", "domain", "risk_level"), ["task_id", "domain"]))
    return M.purge_invalid(d, occ.select("task_id", "domain", "seq"), None)[i]


check("m19_invalid_domain_purge", lambda t: purged(t, 0).select("task_id", "domain"),
      "select task_id, domain from fx_external_domains where risk_level not in ('low','safe')")
check("m19_invalid_evidence_purge", lambda t: purged(t, 1).select("task_id", "seq"),
      "select o.task_id, o.seq from fx_occurrences o join fx_external_domains ed on ed.task_id = o.task_id and ed.domain = o.domain where risk_level not in ('low','safe')")
check("m20_task_purge", lambda t: M.purge_tasks(t.fx_occurrences, t.fx_tasks.where("status = 'deleting'")).select("task_id", "seq"),
      "select task_id, seq from fx_occurrences where task_id not in (select task_id from fx_tasks where status = 'deleting')")
check("m21_task_reset", lambda t: M.reset_task(t.fx_tasks, 11).select("task_id", "status", "pages_crawled", "pages_total"),
      """select task_id, case when task_id = 11 then 'pending' else status end as status, case when task_id = 11 then 0 else pages_crawled end as pages_crawled,
      case when task_id = 11 then 0 else pages_total end as pages_total from fx_tasks""")
check("m22_status_change", lambda t: M.change_status(
    t.fx_tasks.withColumn("started_at", F.when(F.col("pages_crawled") > 5, F.lit("2021-01-01 00:00:00").cast("timestamp"))).withColumn("finished_at", F.lit(None).cast("timestamp")).withColumn("error_message", F.lit("old")),
    t.fx_tasks.select("task_id", F.when(F.col("status") == "running", "completed").when(F.col("status") == "completed", "running").alias("new_status"), F.lit(None).cast("string").alias("new_error")), run_ts())
      .select("task_id", "status", F.date_format("started_at", "yyyy").alias("started"), F.date_format("finished_at", "yyyy").alias("finished"), "error_message"),
      """select task_id, case status when 'running' then 'completed' when 'completed' then 'running' else status end as status,
      case when pages_crawled > 5 then '2021' when status = 'completed' then '2030' end as started, case when status = 'running' then '2030' end as finished, case when status <> 'completed' then 'old' end as error_message from fx_tasks""")
check("m23_soft_delete", lambda t: M.soft_delete(t.fx_tasks, t.fx_tasks.where("status = 'running'")).select("task_id", "status"),
      "select task_id, case when status = 'running' then 'deleting' else status end as status from fx_tasks")
check("m24_t10_log_ttl", lambda t: M.expire_logs(t.fx_logs, F.lit("2024-04-05 00:00:00").cast("timestamp_ntz")).select("id"),
      "select id from fx_logs where created_at >= timestamp '2024-04-05 00:00:00' - interval 90 days")
check("m25_progress", lambda t: M.write_progress(t.fx_tasks, t.fx_tasks.where("status = 'running'").select(
    "task_id", (F.col("pages_crawled") + 1).alias("pages_crawled"), F.lit(None).cast("int").alias("subdomains_count"))).select("task_id", "pages_crawled", "subdomains_count"),
      "select task_id, case when status = 'running' then pages_crawled + 1 else pages_crawled end as pages_crawled, subdomains_count from fx_tasks")
check("a31_m19_purge_summary", lambda t: purged(t, 2),
      """with x as (select *, risk_level in ('low','safe') as bad from fx_external_domains)
      select task_id, count(*) filter (where bad) as deleted_domains_count, cast(sum(case when bad then occurrence_count else 0 end) as bigint) as deleted_occurrences_count,
      count(*) filter (where not bad) as remaining_domains_count from x group by task_id having count(*) filter (where bad) > 0""")
