"""Link graph, text inputs, exports and copies against SQL."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens import fixed_values as v
from linklens.checks.extract_checks import labels_sql
from linklens.checks.registry import check
from linklens.checks.risk_checks import rules, run_ts, tickets
from linklens.operators import graph as G
from linklens.operators import merge as M
from linklens.operators import rollup as R
from linklens.sources import copying as C
from linklens.sources import export as E
from linklens.sources import ingest as I


def edges(t) -> DataFrame:
    """Part tree with back links to suppliers: cycles, hubs and several paths to a node; one graph per line number."""
    li = t.lineitem.select(F.col("l_linenumber").cast("int").alias("task_id"), "l_partkey", "l_suppkey")
    down = li.select("task_id", F.concat(F.lit("n"), F.floor(F.col("l_partkey") / 6)).alias("src"), F.concat(F.lit("n"), "l_partkey").alias("dst"))
    back = li.select("task_id", F.concat(F.lit("n"), "l_partkey").alias("src"), F.concat(F.lit("n"), "l_suppkey").alias("dst"))
    return down.unionByName(back)


def seeds(t) -> DataFrame:
    return t.lineitem.select(F.col("l_linenumber").cast("int").alias("task_id"), F.lit("n0").alias("url"), F.lit(0).alias("depth")).distinct()


WALK = """with recursive e as (select l_linenumber as task_id, 'n' || (l_partkey // 6) as src, 'n' || l_partkey as dst from lineitem union
  select l_linenumber, 'n' || l_partkey, 'n' || l_suppkey from lineitem),
 w(task_id, url, depth) as (select distinct l_linenumber, 'n0', 0 from lineitem union select w.task_id, e.dst, w.depth + 1 from w join e on e.task_id = w.task_id and e.src = w.url where w.depth < {0}),
 b as (select task_id, url, cast(min(depth) as int) as depth from w group by 1, 2)
"""
check("g1_g2_g4_walk", lambda t: G.walk(seeds(t), edges(t)), WALK.format(14) + "select * from b")
check("g2_walk_to_depth_two", lambda t: G.walk(seeds(t), edges(t), max_depth=2), WALK.format(2) + "select * from b")
check("g3_walk_page_limit", lambda t: G.walk(seeds(t), edges(t), max_pages=25),
      WALK.format(14) + "select task_id, url, depth from (select *, row_number() over (partition by task_id order by depth, url) as rn from b) where rn <= 25")
check("u2_new_urls", lambda t: G.new_urls(
    t.lineitem.select(F.col("l_linenumber").alias("task_id"), F.concat(F.lit("n"), "l_partkey").alias("url")),
    t.lineitem.select(F.col("l_linenumber").alias("task_id"), F.concat(F.lit("n"), "l_suppkey").alias("url"))),
      "select l_linenumber as task_id, 'n' || l_partkey as url from lineitem except select l_linenumber, 'n' || l_suppkey from lineitem")


def assets(t) -> DataFrame:
    li = t.lineitem.select(F.col("l_linenumber").cast("int").alias("task_id"), "l_orderkey", "l_partkey", "l_suppkey", "l_quantity")
    pages = li.select("task_id", F.concat(F.lit("p"), "l_suppkey").alias("url"), F.col("l_quantity").cast("int").alias("depth"))
    pages = pages.groupBy("task_id", "url").agg(F.min("depth").alias("depth"))
    used = li.select("task_id", F.concat(F.lit("p"), "l_suppkey").alias("src"), F.concat(F.lit("a"), "l_partkey").alias("dst"))
    imports = li.select("task_id", F.concat(F.lit("a"), "l_partkey").alias("src"), F.concat(F.lit("i"), F.floor(F.col("l_partkey") / 3)).alias("dst"))
    deeper = li.select("task_id", F.concat(F.lit("i"), F.floor(F.col("l_partkey") / 3)).alias("src"), F.concat(F.lit("j"), F.floor(F.col("l_partkey") / 9)).alias("dst"))
    return G.reach_assets(pages, used, imports.unionByName(deeper))


check("g5_g6_assets_with_imports", assets,
      """with p as (select l_linenumber as task_id, l_suppkey as s, min(cast(l_quantity as int)) as depth from lineitem group by 1, 2),
      a as (select l_linenumber as task_id, l_partkey as k, min(depth) as depth from lineitem join p on p.task_id = l_linenumber and p.s = l_suppkey group by 1, 2)
      select task_id, 'a' || k as url, depth from a union all select task_id, 'i' || (k // 3), min(depth) from a group by all union all select task_id, 'j' || (k // 9), min(depth) from a group by all""")
check("g7_seeds_with_sitemap", lambda t: G.seeds_with_sitemap(
    t.fx_pages.groupBy("task_id").agg(F.min(F.concat(F.lit("https://"), "target_host", F.lit("/"))).alias("target_url")), t.fx_pages.select("task_id", "url")),
      r"""select distinct task_id, 'https://' || target_host || '/' as url, 0 as depth from fx_pages union all
      select task_id, url, 1 from fx_pages where suffix(regexp_extract(url, '://([^/?#:]*)', 1), target_root)""")

# text inputs
check("s5_robots_sitemap_lines", lambda t: I.robots_sitemaps(t.fx_tasks.select("task_id", F.concat(
    F.lit("User-agent: *\r\n  SiteMap: "), "target_url", F.lit("sm.xml \nDisallow: /x\nsitemap:\nSitemap: https://x.test/b.xml")).alias("body"))),
      "select task_id, unnest([target_url || 'sm.xml', 'https://x.test/b.xml']) as url from fx_tasks")
check("s7_default_sitemaps", lambda t: I.default_sitemaps(t.fx_tasks.withColumn("target_url", F.concat("target_url", F.lit("deep/page?x#y")))),
      "select task_id, target_url || unnest(['sitemap.xml', 'sitemap_index.xml', 'robots.txt']) as url from fx_tasks")


def sitemap_documents(t) -> DataFrame:
    """Per scan an index of child documents, one per depth, and one url set each."""
    sm = t.fx_sitemap_pages
    child = sm.select("task_id", "depth").distinct().withColumn("loc", F.concat(F.lit("<sitemap><loc> https://m.test/"), "depth", F.lit(".xml </loc></sitemap>")))
    index = child.groupBy("task_id").agg(F.array_join(F.array_sort(F.collect_list("loc")), "\n").alias("b")).select(
        "task_id", F.lit("https://m.test/sitemap.xml").alias("url"), F.concat(F.lit("<sitemapindex xmlns='x'>"), "b", F.lit("</sitemapindex>")).alias("body"))
    sets = sm.select("task_id", F.concat(F.lit("https://m.test/"), "depth", F.lit(".xml")).alias("url"), F.concat(
        F.lit("<urlset><url>\n<loc>"), F.replace(F.replace("url", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</loc><lastmod>x</lastmod></url></urlset>")).alias("body"))
    return index.unionByName(sets).withColumn("status_code", F.lit(200))


check("s6_sitemap_urls", lambda t: I.sitemap_urls(t.fx_tasks.select("task_id", F.lit("https://m.test/sitemap.xml").alias("url")), sitemap_documents(t)),
      "select distinct task_id, url from fx_sitemap_pages where task_id in (select task_id from fx_tasks)")
check("s8_w6_seed_list", lambda t: I.parse_seeds(t.fx_raw_links.select(F.col("id").alias("line_no"), F.when(F.col("kind") == 0, "").when(F.col("kind") == 4, F.lit(" # note ")).otherwise(
    F.concat(F.lit("  "), F.when(F.col("kind") % 2 == 1, F.lit("http://")).otherwise(F.lit("")), F.lit("h"), "k", F.lit(".com:81/x "))).alias("line"))),
      """select min(id) as line_no, u as target_url, 'h' || k || '.com_扫描' as name, 'pending' as status from (select *, case when kind % 2 = 1 then 'http://' else 'https://' end || 'h' || k || '.com:81/x' as u
      from fx_raw_links where kind not in (0, 4)) group by u, k""")
check("s9_rule_lines", lambda t: I.parse_rules(t.fx_profiles.select(F.col("id").alias("line_no"), F.concat(
    F.when(F.col("match_type") == "root", F.lit("*.")).otherwise(F.lit("")), F.ltrim("domain", F.lit("*.")), F.lit(","), F.when(F.col("risk_level") == "high", "").otherwise(F.col("risk_level")),
    F.lit(", "), "category", F.lit(" ,"), "tags_text", F.lit("//,"), "remark").alias("line"))).withColumn("tags", F.array_join("tags", "/")),
      """select id as line_no, ltrim(domain, '*.') as domain, case when match_type = 'root' then 'root' else 'exact' end as match_type, risk_level, category, tags_text as tags, 'import' as source, trim(remark) as remark from fx_profiles""")
check("m8_rule_import", lambda t: M.import_rules(
    rules(t), I.parse_rules(rules(t).select(F.col("id").alias("line_no"), F.concat(F.lit("*.bulk"), F.col("id") % 7, F.lit(".net,low,c,t,line "), "id").alias("line"))), run_ts())
      .select("domain", "match_type", "risk_level", "remark"),
      """select domain, match_type, risk_level, remark from fx_profiles union all select 'bulk' || k || '.net', 'root', 'low', 'line ' || n from (select id % 7 as k, max(id) as n from fx_profiles group by 1)""")

# exports
EFF_LEVEL = "case " + " ".join(f"when bool_or(ed.risk_level = '{x}') then '{x}'" for x in v.RISK_LEVELS[:-1]) + " else 'pending' end"
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
YES = "case when {0} then '是' else '否' end"


def header(names, exprs) -> str:
    return ", ".join(f'{e} as "{n}"' for n, e in zip(names, exprs, strict=True))


check("s13_domain_names", lambda t: E.names_text(t.fx_external_domains), "select domain as value from fx_external_domains")
check("s13_subdomain_names", lambda t: E.names_text(t.fx_subdomains), "select domain as value from fx_subdomains")
check("s13_global_names", lambda t: E.names_text(R.global_domains(t.fx_external_domains, t.fx_tasks, with_tasks=False), count="total_occurrences"),
      "select distinct domain as value from fx_external_domains ed join fx_tasks t on t.task_id = ed.task_id where status <> 'deleting'")
ED_CSV = header(v.DOMAIN_HEADER, ["domain", "root_domain", "occurrence_count", labels_sql("risk_level", v.RISK_LABELS), "'a / b'", "''", labels_sql("verify_status", v.VERIFY_LABELS), "''",
                                  YES.format("has_link"), YES.format("has_text"), "sample_page_url", TS.format("created_at")])
check("s14_domain_csv", lambda t: E.domain_csv(t.fx_external_domains.withColumn("risk_tags", F.array(F.lit("a"), F.lit("b")))), f"select {ED_CSV} from fx_external_domains")
check("s15_domain_json", lambda t: E.domain_json(t.fx_external_domains.select("task_id", "domain", "occurrence_count", "risk_level")),
      """select '{"task_id":' || task_id || ',"domain":"' || domain || '","occurrence_count":' || occurrence_count || ',"risk_level":"' || risk_level || '"}' as value from fx_external_domains""")
check("s17_subdomain_json", lambda t: E.json_lines(t.fx_subdomains.select("task_id", "domain", "has_link").orderBy("domain")),
      """select '{"task_id":' || task_id || ',"domain":"' || domain || '","has_link":' || has_link || '}' as value from fx_subdomains""")
check("s20_global_json", lambda t: E.global_json(R.global_domains(t.fx_external_domains, t.fx_tasks).select("domain", "root_domain", "total_occurrences", "task_count", "risk_level", "first_seen_at", "last_seen_at", "associated_tasks")
      .withColumns({"first_seen_at": F.date_format("first_seen_at", "yyyy"), "last_seen_at": F.date_format("last_seen_at", "yyyy")})),
      f"""with g as (select ed.domain, ed.root_domain, {EFF_LEVEL} as lv, cast(sum(occurrence_count) as bigint) as n, count(*) as k, min(created_at) as a, max(created_at) as z,
      string_agg('{{"task_id":' || t.task_id || ',"task_name":"' || t.name || '","occurrence_count":' || occurrence_count || '}}', ',' order by t.task_id) as s from fx_external_domains ed join fx_tasks t on t.task_id = ed.task_id where status <> 'deleting' group by 1, 2)
      select '{{"domain":"' || domain || '","root_domain":"' || root_domain || '","total_occurrences":' || n || ',"task_count":' || k || ',"risk_level":"' || lv || '","first_seen_at":"' || strftime(a, '%Y') || '","last_seen_at":"' || strftime(z, '%Y') || '","associated_tasks":[' || s || ']}}' as value from g""")
check("s15_export_head", lambda t: E.export_meta(t.fx_external_domains, t.fx_tasks),
      "select t.task_id, t.target_url, count(domain) as total_domains from fx_tasks t left join fx_external_domains ed on ed.task_id = t.task_id group by 1, 2")
check("s16_evidence_csv", lambda t: E.evidence_rows(t.fx_occurrences, t.fx_tasks, "o.s2.gov.cn"),
      f"""select {header(v.EVIDENCE_HEADER, ["domain", "o.task_id", "name", "target_url", "source_type", "page_url", "raw_match", "context_snippet", TS.format("created_at")])}
      from fx_occurrences o join fx_tasks t on t.task_id = o.task_id where domain = 'o.s2.gov.cn' and status <> 'deleting'""")
check("s17_subdomain_csv", lambda t: E.subdomain_csv(t.fx_subdomains),
      f"""select {header(v.SUBDOMAIN_HEADER, ["domain", "root_domain", "occurrence_count", YES.format("has_link"), YES.format("has_text"), "sample_page_url", TS.format("created_at")])} from fx_subdomains""")
check("s18_sitemap_xml", lambda t: E.sitemap_xml(t.fx_sitemap_pages).select("task_id", "part", "id", "line"),
      """select task_id, 1 as part, id, '  <url>' || chr(10) || '    <loc>' || replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</loc>' || chr(10) || '    <lastmod>' || strftime(crawled_at, '%Y-%m-%d')
      || '</lastmod>' || chr(10) || '  </url>' as line from fx_sitemap_pages where status_code between 200 and 399 and not contains(content_type, 'javascript') and not contains(content_type, 'css') and not suffix(url, '.js') and not suffix(url, '.css')
      union all select distinct task_id, 0, -1, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">' from fx_sitemap_pages
      union all select distinct task_id, 2, -1, '</urlset>' from fx_sitemap_pages""")
check("s19_page_csv", lambda t: E.page_csv(t.fx_sitemap_pages), f"""select {header(v.PAGE_HEADER, ["id", "url", "path", "depth", "status_code", "title", TS.format("crawled_at")])} from fx_sitemap_pages""")
EFF = "case " + " ".join(f"when bool_or(ed.risk_level = '{x}') then '{x}'" for x in v.RISK_LEVELS[:-1]) + " else 'pending' end"
EFV = "case " + " ".join(f"when bool_or(ed.verify_status = '{x}') then '{x}'" for x in v.VERIFY_STATES[:-1]) + " else 'unverified' end"
check("s20_global_csv", lambda t: E.global_csv(R.global_domains(t.fx_external_domains, t.fx_tasks)),
      f"""with g as (select ed.domain, ed.root_domain, {EFF} as lv, {EFV} as vs, cast(sum(occurrence_count) as bigint) as n, count(*) as k, bool_or(has_link) as hl, bool_or(has_text) as ht, min(created_at) as a, max(created_at) as z, min(sample_page_url) as p,
      string_agg(t.name || ' (ID:' || t.task_id || ', ' || occurrence_count || '次)', ' | ' order by t.task_id) as s from fx_external_domains ed join fx_tasks t on t.task_id = ed.task_id where status <> 'deleting' group by 1, 2)
      select {header(v.GLOBAL_HEADER, ["domain", "root_domain", labels_sql("lv", v.RISK_LABELS), "''", "''", labels_sql("vs", v.VERIFY_LABELS), "''", "n", "k", YES.format("hl"), YES.format("ht"), TS.format("a"), TS.format("z"), "p", "s"])} from g""")
check("s21_j9_cross_task_csv", lambda t: E.cross_task_csv(t.fx_external_domains, t.fx_tasks, t.fx_occurrences),
      f"""select {header(v.CROSS_TASK_HEADER, ["ed.domain", "ed.root_domain", "ed.task_id", "t.name", "t.target_url", "t.status", "ed.occurrence_count", YES.format("ed.has_link"), YES.format("ed.has_text"), "ed.sample_page_url", "coalesce(source_type, '')",
      "coalesce(page_url, '')", "coalesce(raw_match, '')", "coalesce(context_snippet, '')", TS.format("coalesce(o.created_at, ed.created_at)")])} from fx_external_domains ed join fx_tasks t on t.task_id = ed.task_id
      left join fx_occurrences o on o.task_id = ed.task_id and o.domain = ed.domain where t.status <> 'deleting'""")
GUIDE = "replace(case when st like '%script%' then '{0}' when st like '%a%' or st like '%href%' then '{1}' else '{2}' end, '{{0}}', domain)".format(*[x.replace("'", "''") for x in (v.GUIDE_SCRIPT, v.GUIDE_LINK, v.GUIDE_OTHER)])
check("s22_w7_ticket_csv", lambda t: E.ticket_csv(tickets(t).drop("updated_at"), t.fx_tasks),
      f"""with x as (select r.*, t.name, t.target_url, source_type as st, row_number() over (order by r.task_id, r.risk_level, r.id) as no from fx_tickets r join fx_tasks t on t.task_id = r.task_id
      where t.status <> 'deleting' and r.verify_status in ('unverified','verified_failed'))
      select {header(v.TICKET_HEADER, ["no", "task_id", "name", "target_url", "page_url", "''", "domain", "root_domain", labels_sql("risk_level", v.TICKET_RISK_LABELS), "'old'", "'before'", "source_type", "context_snippet",
      labels_sql("verify_status", v.TICKET_VERIFY_LABELS), f"coalesce({TS.format('last_verified_at')}, '')", "''", "manual_status", GUIDE])} from x""")
check("s23_rule_text", lambda t: E.rule_text(rules(t).withColumn("remark", F.concat("remark", F.lit(", x")))),
      """select case when match_type = 'root' then '*.' || domain else domain end || ',' || risk_level || ',' || category || ',' || tags_text || ',' || trim(replace(remark || ', x', ',', '，')) as value from fx_profiles""")
check("s11_evidence_batch", lambda t: E.evidence_batch(t.fx_occurrences, run_ts()).select("task_id", "domain", "page_url", "raw_match", "month"),
      "select task_id, domain, page_url, raw_match, '203001' as month from fx_occurrences")
check("s12_log_batch", lambda t: E.log_batch(t.fx_logs).select("id", "level", "month"), "select id, upper(coalesce(level, 'INFO')) as level, strftime(created_at, '%Y%m') as month from fx_logs")

# copies
check("s24_resumed_copy", lambda t: C.rows_to_copy(
    t.fx_sitemap_pages.select("id", "task_id", "url", F.concat("title", F.lit("\x00")).alias("title")),
    t.fx_sitemap_pages.select(F.floor(F.col("id") / 2).alias("id"), "task_id", F.when(F.col("status_code") == 404, F.col("url")).otherwise(F.concat("url", F.lit("#old"))).alias("url")), ["task_id", "url"]),
      """select id, task_id, url, title from fx_sitemap_pages where id > (select max(id // 2) from fx_sitemap_pages) and status_code <> 404""")
check("s25_row_counts", lambda t: C.compare_counts({
    "pages": (t.fx_sitemap_pages, t.orders), "evidence": (t.fx_occurrences, t.fx_tickets), "logs": (t.fx_logs, t.events)}),
      """select 'pages' as table_name, (select count(*) from fx_sitemap_pages) as source_rows, (select count(*) from orders) as target_rows, true as same
      union all select 'evidence', (select count(*) from fx_occurrences), (select count(*) from fx_tickets), false union all select 'logs', (select count(*) from fx_logs), (select count(*) from events), true""")
check("s26_reshape_evidence", lambda t: C.reshape_evidence(t.fx_occurrences.withColumn("id", F.col("seq")), run_ts()).select("id", "domain", "root_domain", "is_link", F.date_format("created_at", "yyyy-MM-dd").alias("day")),
      "select seq as id, domain, array_to_string(string_split(domain, '.')[-2:], '.') as root_domain, contains(source_type, 'link') as is_link, strftime(created_at, '%Y-%m-%d') as day from fx_occurrences")
check("s26_reshape_pages", lambda t: C.reshape_pages(t.fx_sitemap_pages.withColumn("path", F.when(F.col("depth") == 1, F.lit(None)).otherwise(F.col("path"))), run_ts()).select("id", "path", "depth", "status_code"),
      "select id, case when depth = 1 then '/' else path end as path, depth, status_code from fx_sitemap_pages")
check("s26_reshape_logs", lambda t: C.reshape_logs(t.fx_logs, run_ts()).select("id", "level", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("at")),
      "select id, upper(coalesce(level, 'INFO')) as level, strftime(created_at, '%Y-%m-%d %H:%M:%S') as at from fx_logs")
