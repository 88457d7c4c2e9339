"""Scalar functions, responses and extraction against SQL."""

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linklens import fixed_values as v
from linklens.checks.registry import check
from linklens.functions import domains as D
from linklens.functions import public_suffix as ps
from linklens.functions import text as T
from linklens.functions import urls as U
from linklens.operators import extract as X
from linklens.plans import scan
from linklens.sources import responses as S


def quoted(values) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in values)


@functools.lru_cache
def suffix_rules() -> str:
    return f"psl as (select unnest([{quoted(ps.load_rules())}]) as rule), tld as (select unnest([{quoted(sorted(ps.tlds()))}]) as tld)"


EXT, WORDS, DICT, RESERVED = (quoted(x) for x in (v.FILE_EXTENSIONS, v.CODE_WORDS, v.DICTIONARY_TLDS, v.RESERVED_DOMAINS))
CLEAN = r"trim(regexp_extract(regexp_replace(lower(trim({0})), '^.*?://', ''), '^([^/?#:]*)', 1), '. ')"
SYNTAX = r"^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?(\.[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)+$"


def cleaned(raw: str) -> str:
    c = CLEAN.format(raw)
    return (f"case when regexp_matches({c}, '{SYNTAX}') and not regexp_matches({c}, '^\\d{{1,3}}(\\.\\d{{1,3}}){{3}}$') "
            f"and {c} not in ({RESERVED}) then {c} end")


def parts_of(names: str) -> str:
    """CTEs from a relation `names`(raw, from_url) to `parts`(raw, from_url, d, valid, root)."""
    return f"""{suffix_rules()}, cl as (select distinct raw, from_url, {cleaned('raw')} as d from {names}),
 lab as (select *, string_split(d, '.') as l from cl where d is not null),
 val as (select *, length(d) <= 253 and l[-1] in (select tld from tld) and l[-1] not in ({EXT}) and (from_url or not (
   (len(l) = 2 and l[-1] in ({DICT}) and (l[1] in ({WORDS}) or length(l[1]) <= 3)) or (len(l) >= 3 and l[-2] in ({WORDS}) and l[-1] in ({DICT})))) as valid from lab),
 pos as (select distinct d, l, unnest(range(1, len(l) + 1)) as i from val where valid),
 suf as (select d, l, i, array_to_string(l[i:], '.') as s, array_to_string(l[i + 1:], '.') as s1 from pos),
 hit as (select d, l, min(i) filter (where p.rule is not null or w.rule is not null) as i, max(i) filter (where x.rule is not null) as ix from suf
  left join psl p on p.rule = s left join psl w on w.rule = '*.' || s1 left join psl x on x.rule = '!' || s group by d, l),
 st as (select d, l, coalesce(ix + 1, i) as i from hit), rt as (select d, case when i >= 2 then array_to_string(l[i - 1:], '.') end as root from st),
 parts as (select val.raw, val.from_url, val.d, valid, root from val left join rt using (d))"""


def with_parts(df: DataFrame, from_url: bool) -> DataFrame:
    return D.with_domain_parts(df, F.col("raw"), from_url)


check("f1_clean_domain", lambda t: t.fx_raw_names.select("id", D.clean_domain(F.col("raw")).alias("domain")),
      f"select id, {cleaned('raw')} as domain from fx_raw_names")
check("f2_domain_syntax", lambda t: t.fx_raw_names.select("id", D.has_domain_syntax(F.col("raw")).alias("ok")),
      f"select id, length(raw) <= 253 and regexp_matches(lower(raw), '{SYNTAX}') as ok from fx_raw_names")
check("f3_known_tld", lambda t: t.fx_raw_names.select("id", ps.is_tld("substring_index(lower(raw), '.', -1)").alias("ok")),
      f"with {suffix_rules()} select id, string_split(lower(raw), '.')[-1] in (select tld from tld) as ok from fx_raw_names")
for mode, flag in (("text", False), ("url", True)):
    check(f"f4_f5_j12_domain_parts_from_{mode}", lambda t, flag=flag: with_parts(t.fx_raw_names, flag).select("id", "domain", "root_domain"),
          f"with nm as (select raw, {str(flag).lower()} as from_url from fx_raw_names), {parts_of('nm')} select id, case when root is not null then d end as domain, root as root_domain from fx_raw_names left join parts using (raw)")
check("f6_naive_root", lambda t: t.fx_occurrences.select("seq", D.naive_root(F.col("domain")).alias("root")),
      "select seq, array_to_string(string_split(domain, '.')[-2:], '.') as root from fx_occurrences")
check("f7_normalize_link", lambda t: U.with_normalized_link(t.fx_raw_links, "base", F.col("raw"), "url").select("id", "url"),
      """select id, case kind when 0 then 'https://h' || k || '.com/a/p' || k when 1 then 'https://h' || k || '.com/a/b/q' || k || '?z=1' when 2 then 'https://h' || k || '.com/a/b/c.html?s=' || k
      when 3 then 'https://cdn' || k || '.org/x' when 6 then 'http://e' || k || '.net/' when 7 then 'https://h' || k || '.com/abs/' || k when 8 then 'https://h' || k || '.com/a/b/r' || k || '/s.pdf'
      when 10 then raw when 12 then 'http://I' || k || '.io/P' when 13 then 'https://h' || k || '.com/' end as url from fx_raw_links""")
check("f7_page_links", lambda t: U.with_normalized_link(t.fx_pages.select("page_id", "url", F.explode(X.all_matches(F.col("html"), r'href="([^"]*)"', 1)).alias("raw")), "url", F.col("raw"), "link").select("page_id", "link"),
      r"""select page_id, regexp_extract(url, '^(https?://[^/?#]*)', 1) || regexp_replace(h, '#.*$', '') as link from (select page_id, url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) as h from pages)""")
check("f8_crawlable", lambda t: t.fx_raw_links.select("id", U.is_crawlable(F.col("raw")).alias("ok")),
      "select id, kind not in (8, 10) or (kind = 8 and raw like '% ') as ok from fx_raw_links")
check("f9_f10_internal_and_subdomain", lambda t: D.with_target_root(with_parts(t.fx_pages.withColumn("raw", U.host(F.col("url"))), True), "target_host", "troot").select(
    "page_id", D.is_internal(F.col("raw"), F.col("root_domain"), F.col("target_host"), F.col("troot")).alias("internal"),
    D.is_internal(F.col("raw"), F.col("root_domain"), F.col("target_host"), F.col("troot"), "exact_host").alias("internal_exact"),
    D.is_subdomain(F.col("root_domain"), F.col("troot")).alias("subdomain")),
      r"""select page_id, suffix(h, target_root) as internal, h = target_host as internal_exact, suffix(h, target_root) and h <> 'example.com' and h <> 'example.org' as subdomain
      from (select page_id, regexp_extract(url, '://([^/?#:]*)', 1) as h, target_host, target_root from fx_pages)""")


def cut(text: str, target: str, before: int, after: int, none: str, trim: bool) -> str:
    at = f"strpos(lower({text}), lower({target}))"
    a, z = f"greatest(0, {at} - 1 - {before})", f"least(length({text}), {at} - 1 + length({target}) + {after})"
    body = f"translate(substr({text}, {a} + 1, {z} - {a}), chr(13) || chr(10), '  ')"
    body = f"trim({body}, {WS})" if trim else body
    return (f"case when {at} = 0 then {none} else (case when {a} > 0 then '...' else '' end) || {body} || (case when {z} < length({text}) then '...' else '' end) end")


WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
DOCS_SQL = "(select doc_id, text, source, substr(text, length(text) // 2, 6) as target from documents)"


def docs(t):
    return t.documents.withColumn("target", F.expr("substring(text, int(length(text) div 2), 6)"))


check("f11_make_snippet", lambda t: docs(t).select("doc_id", T.make_snippet(F.col("text"), F.col("target")).alias("s"), T.make_snippet(F.col("text"), F.lit("~none~")).alias("s0")),
      f"select doc_id, {cut('text', 'target', 60, 60, 'left(text, 120)', True)} as s, trim(left(text, 120), {WS}) as s0 from {DOCS_SQL}")
check("f12_verdict_snippet", lambda t: docs(t).select("doc_id", T.verdict_snippet(F.col("text"), F.col("target")).alias("s")),
      f"select doc_id, {cut('text', 'target', 40, 60, 'left(text, 150)', False)} as s from {DOCS_SQL}")
check("f13_context_around", lambda t: docs(t).select("doc_id", T.context_around(F.col("text"), F.col("target")).alias("s"), T.context_around(F.col("text"), F.lit("~none~")).alias("s0")),
      f"select doc_id, {cut('text', 'target', 60, 60, chr(39) * 2, False)} as s, '' as s0 from {DOCS_SQL}")
check("f14_html_title", lambda t: t.pages.select("page_id", T.html_title(F.col("html")).alias("title")),
      r"select page_id, left(regexp_replace(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '\s+', ' ', 'g'), 150) as title from pages")
check("f15_safe_url", lambda t: t.documents.select("doc_id", U.safe_url(F.concat(F.lit("https://x.com/"), F.col("text"))).alias("url")),
      """with u as (select doc_id, 'https://x.com/' || text as u from documents), k as (select doc_id, max(n) as n from (select doc_id, u, unnest(range(500, 2001)) as n from u) where strlen(left(u, n)) <= 2000 group by 1)
      select u.doc_id, case when length(u) > 800 and strlen(u) > 2000 then left(u, k.n) else u end as url from u left join k using (doc_id)""")
check("f16_evidence_truncation", lambda t: t.documents.select("doc_id", T.cut_raw_match(F.col("text")).alias("raw"), T.cut_snippet(F.col("text")).alias("snippet")),
      "select doc_id, left(text, 500) as raw, left(text, 1000) as snippet from documents")
check("f17_url_path", lambda t: t.pages.select("page_id", U.path(F.col("url")).alias("path")),
      r"select page_id, case when regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) = '' then '/' else regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) end as path from pages")
check("f18_rule_target", lambda t: t.fx_profiles.select("id", D.rule_target(F.concat(F.lit(" "), F.upper("domain"))).alias("target")),
      "select id, ltrim(domain, '*.') as target from fx_profiles")
check("f19_parse_time", lambda t: t.fx_logs.select("id", F.date_format(T.parse_time(F.when(F.col("level").isNull(), F.lit("bad")).otherwise(F.col("created_at").cast("string")), F.lit("2030-01-01 00:00:00").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("at")),
      "select id, case when level is null then '2030-01-01 00:00:00' else strftime(created_at, '%Y-%m-%d %H:%M:%S') end as at from fx_logs")
check("f20_decode_tags", lambda t: t.fx_profiles.select("id", F.array_join(T.decode_tags(
    F.when(F.col("remark") == "", "").when(F.col("match_type") == "exact", F.col("tags_text")).otherwise(F.to_json(F.split("tags_text", "/")))), "|").alias("tags")),
      "select id, case when remark = '' then '' when match_type = 'exact' then tags_text else replace(tags_text, '/', '|') end as tags from fx_profiles")
check("f21_row_id", lambda t: t.fx_occurrences.select("seq", T.row_id(F.col("task_id"), F.col("domain"), F.col("page_url"), F.col("source_type"), F.col("raw_match")).alias("id")))
check("f22_olap_link_flag", lambda t: t.fx_occurrences.select("seq", T.olap_link_flag(F.col("source_type")).alias("flag")),
      "select seq, contains(source_type, 'link') or source_type = 'href' as flag from fx_occurrences")
check("f23_remediation_guide", lambda t: t.fx_tickets.select("id", T.remediation_guide(
    F.when(F.col("risk_level") == "low", F.lit("iframe")).when(F.col("risk_level") == "high", "IMG_src").when(F.col("manual_status") == "ignored", "").otherwise(F.col("source_type")), F.col("domain")).alias("guide")),
      f"""select id, replace(case when st like '%script%' or st like '%js%' then '{v.GUIDE_SCRIPT.replace("'", "''")}' when st like '%iframe%' then '{v.GUIDE_IFRAME.replace("'", "''")}'
      when st like '%img%' or st like '%image%' then '{v.GUIDE_IMAGE.replace("'", "''")}' when st like '%href%' or st like '%a%' then '{v.GUIDE_LINK.replace("'", "''")}' else '{v.GUIDE_OTHER.replace("'", "''")}' end, '{{0}}', domain) as guide
      from (select id, domain, lower(case when risk_level = 'low' then 'iframe' when risk_level = 'high' then 'IMG_src' when manual_status = 'ignored' then '' else source_type end) as st from fx_tickets)""")


def labels_sql(c, labels):
    return f"case {c} " + " ".join(f"when '{k}' then '{x}'" for k, x in labels.items()) + f" else {c} end"


check("f24_labels", lambda t: t.fx_tickets.select("id", T.label(F.col("risk_level"), v.RISK_LABELS).alias("risk"), T.label(F.col("verify_status"), v.TICKET_VERIFY_LABELS).alias("verify"),
                                                  T.label(F.col("verify_status"), v.VERIFY_LABELS).alias("domain_verify"), T.yes_no(F.col("manual_status") == "ignored").alias("flag")),
      f"""select id, {labels_sql('risk_level', v.RISK_LABELS)} as risk, {labels_sql('verify_status', v.TICKET_VERIFY_LABELS)} as verify, {labels_sql('verify_status', v.VERIFY_LABELS)} as domain_verify,
      case when manual_status = 'ignored' then '是' else '否' end as flag from fx_tickets""")
check("f25_xml_escape", lambda t: t.fx_sitemap_pages.select("id", T.xml_escape(F.col("url")).alias("loc")),
      "select id, replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as loc from fx_sitemap_pages")
check("f26_average_speed", lambda t: t.fx_sitemap_pages.groupBy("task_id").agg(F.count("*").alias("n"), F.min("crawled_at").alias("a"), F.max("crawled_at").alias("z")).select(
    "task_id", T.average_speed(F.col("n") * 1000000, F.col("a").cast("timestamp"), F.col("z").cast("timestamp")).alias("speed")),
      "select task_id, round(count(*) * 1000000 / greatest(0.5, epoch(max(crawled_at)) - epoch(min(crawled_at))), 1) as speed from fx_sitemap_pages group by 1")
check("f27_progress_percent", lambda t: t.fx_tasks.select("task_id", T.progress_percent(F.col("pages_crawled"), F.when(F.col("status") == "running", 0).otherwise(F.col("pages_total")), F.col("status")).alias("pct")),
      "select task_id, case when status = 'running' then 0 else cast(least(100, floor(100.0 * pages_crawled / pages_total + 0.5)) as int) end as pct from fx_tasks")
check("f28_verify_progress", lambda t: t.fx_tasks.select("task_id", T.verify_progress(F.to_json(F.struct(F.col("pages_total").alias("total_pages"), F.col("pages_crawled").alias("cleared_count"), F.col("name").alias("summary")))).alias("p")).select("task_id", "p.*"),
      "select task_id, pages_total as total_pages, pages_crawled as cleared_count, 0 as still_present_count, name as verify_summary, pages_crawled || '/' || pages_total as verify_progress from fx_tasks")
check("f29_shares", lambda t: t.fx_external_domains.select("task_id", "domain", T.share_of_total(F.col("occurrence_count"), F.lit(700)).alias("of_total"), T.share_of_top(F.col("occurrence_count"), F.lit(150)).alias("of_top")),
      "select task_id, domain, round(100.0 * occurrence_count / 700, 1)::double as of_total, cast(least(100, floor(100.0 * occurrence_count / 150 + 0.5)) as int) as of_top from fx_external_domains")
check("f30_suggested_rule_target", lambda t: t.fx_external_domains.select("task_id", "domain", D.suggested_rule_target(F.concat(F.lit("*."), F.when(F.col("has_link"), F.concat(F.lit("deep."), F.col("domain"))).otherwise(F.col("domain"))), F.col("root_domain")).alias("target")),
      "select task_id, domain, case when has_link then domain else root_domain end as target from fx_external_domains")
check("f31_preset_level", lambda t: t.fx_external_domains.select("task_id", "domain", T.preset_level(F.when(F.col("risk_level") == "high", F.lit("死链404")).when(F.col("risk_level") == "low", F.lit("恶意C2")).otherwise(F.lit("?"))).alias("level")),
      "select task_id, domain, case risk_level when 'high' then 'low' when 'low' then 'critical' end as level from fx_external_domains")
check("f33_log_level", lambda t: t.fx_logs.select("id", T.log_level(F.col("level")).alias("level")), "select id, upper(coalesce(level, 'INFO')) as level from fx_logs")
check("f34_ensure_scheme", lambda t: t.pages.select("page_id", U.ensure_scheme(F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))).alias("url")),
      "select page_id, case when page_id % 2 = 0 then 'https://' || regexp_replace(url, '^https?://', '') else url end as url from pages")
check("f35_page_state", lambda t: t.fx_responses.select("url", T.page_state(F.col("status_code"), F.col("body")).alias("state")),
      "select url, case when status_code in (404, 410) or (status_code >= 400 and contains(body, '404')) then 'page_removed' when status_code >= 500 then 'error' end as state from fx_responses")

# responses
KIND = "case when contains(content_type, 'javascript') or suffix(regexp_extract(url, '^[^?#]*'), '.js') then 'js' when contains(content_type, 'text/css') then 'css' else 'html' end"
check("s1_s3_response_kinds", lambda t: t.fx_sitemap_pages.select("id", S.resource_kind(F.col("content_type"), F.col("url")).alias("kind"), S.is_html(F.col("content_type")).alias("is_html")),
      f"select id, {KIND} as kind, contains(content_type, 'text/html') as is_html from fx_sitemap_pages")
check("s2_text_gate", lambda t: t.fx_sitemap_pages.select("id", S.is_text_content(F.when(F.col("depth") < 3, F.lit("image/png")).otherwise(F.col("content_type")), F.col("url")).alias("keep")),
      "select id, depth >= 3 or suffix(url, '.js') as keep from fx_sitemap_pages")
check("s4_asset_guard", lambda t: S.guard_assets(t.pages.select("page_id", "html", F.when(F.col("page_id") % 5 == 0, 404).otherwise(200).alias("status_code"), F.lit(None).cast("string").alias("error")), 5000)
      .select("page_id", "error", F.length("html").alias("n")),
      """select page_id, case when page_id % 5 = 0 then 'HTTP 404' when strlen(html) > 5000 then 'Asset exceeds max size limit' end as error,
      case when page_id % 5 = 0 or strlen(html) > 5000 then 0 else length(html) end as n from pages""")

# extraction
NO_BODIES_SQL = r"(?is)<!--.*?-->|(<script\b[^>]*>).*?(</script\s*>)|(<style\b[^>]*>).*?(</style\s*>)"
INVISIBLE_SQL = (r"(?is)<!--.*?-->|<!doctype[^>]*>|<head\b.*?</head\s*>|<title\b.*?</title\s*>|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
                 r"|<noscript\b.*?</noscript\s*>|<svg\b.*?</svg\s*>")


def decoded(x: str) -> str:
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


BODY = decoded(rf"regexp_replace(regexp_replace(html, '{INVISIBLE_SQL}', ' ', 'g'), '(?s)</?[a-zA-Z][^>]*>', ' ', 'g')")
DOUBLED = r"regexp_replace({0}, '([^a-zA-Z0-9_\-/.])', '\1\1', 'g')"
LAB = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
NAKED_SQL = rf"(?i)(?:^|[^a-z0-9_\-/.])({LAB}(?:\.{LAB})*\.[a-z]{{2,24}}(?:::\d+)?(?:[^a-z0-9_\-]|$))"
URL_SQL = r"""(?i)(?:https?:)?//[a-z0-9][-a-z0-9]*(?:\.[a-z0-9][-a-z0-9]*)+(?::\d+)?(?:/[^\s"''<>{}|\\^`\[\]]*)?"""


def text_names(rel: str, key: str, text: str) -> str:
    """CTE `found`(key, raw, from_url) of the URLs and naked names of a text."""
    return f"""fu as (select {key} as key, unnest(regexp_extract_all({text}, '{URL_SQL}')) as m from {rel}),
 fn as (select {key} as key, unnest(regexp_extract_all({DOUBLED.format(text)}, '{NAKED_SQL}', 1)) as m from {rel}),
 found as (select key, regexp_extract(m, '//([^/:]*)', 1) as raw, true as from_url from fu union all
  select key, regexp_extract(m, '^[a-zA-Z0-9.-]*[a-zA-Z0-9]') as raw, false as from_url from fn where regexp_matches(m, '::\\d') or not regexp_matches(m, '[(=\\[{{;`<>]$'))"""


def pages(t) -> DataFrame:
    rows = t.fx_pages.select("task_id", F.col("url").alias("page_url"), "html", F.lit("html").alias("resource"), "target_host")
    return rows


def texts(t, table: str, key: str) -> DataFrame:
    df = getattr(t, table)
    rows = df.select(F.lit(1).alias("task_id"), F.col(key).cast("string").alias("page_url"), F.col("text").alias("html"),
                     F.lit("text").alias("resource"), F.lit("none.test").alias("target_host"))
    return rows


check("x1_title", lambda t: X.parse_pages(pages(t)).select("page_url", "title"),
      f"select url as page_url, {decoded(chr(116) + 'rim(regexp_extract(html, ' + repr('(?is)<title[^>]*>(.*?)</title>') + ', 1))')} as title from pages")
check("x2_link_hrefs", lambda t: X.page_finds(pages(t)).where("source_type = 'link_href'").select("page_url", "raw", "find_host"),
      rf"""select url as page_url, {decoded('h')} as raw, regexp_extract(url, '://([^/?#:]*)', 1) as find_host from (select url, unnest(regexp_extract_all(regexp_replace(html, '{NO_BODIES_SQL}', '\1\2\3\4', 'g'),
      '(?is)<(?:a|area)\b[^>]*?href\s*=\s*"([^"]*)"', 1)) as h from pages)""")
check("x8_comments", lambda t: X.parse_pages(pages(t)).select("page_url", F.explode("comments").alias("comment")),
      "select url as page_url, unnest(regexp_extract_all(html, '(?s)<!--(.*?)-->', 1)) as comment from pages")
check("x9_inline_scripts", lambda t: X.parse_pages(pages(t)).select("page_url", F.explode("scripts").alias("code")),
      r"select url as page_url, unnest(regexp_extract_all(html, '(?is)<script>(.*?)</script\s*>', 1)) as code from pages")
check("x6_style_bodies", lambda t: X.parse_pages(pages(t)).select("page_url", F.explode("styles").alias("css")),
      r"select url as page_url, unnest(regexp_extract_all(html, '(?is)<style\b[^>]*>(.*?)</style\s*>', 1)) as css from pages")
check("x11_visible_text", lambda t: X.parse_pages(pages(t)).select("page_url", F.md5("body").alias("body_md5"), F.length("body").alias("n")),
      f"select url as page_url, md5({BODY}) as body_md5, length({BODY}) as n from pages")
for table, key in (("documents", "doc_id"),):
    check(f"x12_x13_names_in_{table}", lambda t, table=table, key=key: X.extract_hits(texts(t, table, key)).groupBy("page_url", "domain", "root_domain").agg(F.count("*").alias("n")),
          f"with {text_names(table, key, 'text')}, {parts_of('found')} select cast(key as varchar) as page_url, d as domain, root as root_domain, count(*) as n from found join parts using (raw, from_url) where root is not null group by all")
HITS = f"""with src as (select url, target_root, regexp_extract(url, '://([^/?#:]*)', 1) as host, {BODY} as body, html from fx_pages),
 hrefs as (select url, host as raw, true as from_url, 'link_href' as source_type from (select url, host, unnest(regexp_extract_all(regexp_replace(html, '{NO_BODIES_SQL}', '\\1\\2\\3\\4', 'g'),
  '(?is)<(?:a|area)\\b[^>]*?href\\s*=\\s*"([^"]*)"', 1)) as h from src) where h <> '' and h not like '#%'),
 {text_names('src', 'url', 'body')}, allfinds as (select url, host as raw, true as from_url, 'page_host' as source_type from src union all select * from hrefs
  union all select key, raw, from_url, 'plain_text' from found),
 {parts_of('allfinds')},
 hits as (select a.url as page_url, fx_pages.task_id, d as domain, root as root_domain, source_type, case when root = target_root then 'subdomain' else 'external' end as side
  from allfinds a join parts using (raw, from_url) join fx_pages on fx_pages.url = a.url where root is not null and not (source_type = 'page_host' and root <> target_root))
"""
check("x2_x14_extract_hits", lambda t: X.extract_hits(pages(t)).groupBy("task_id", "page_url", "side", "domain", "root_domain", "source_type").agg(F.count("*").alias("n")),
      HITS + "select task_id, page_url, side, domain, root_domain, source_type, count(*) as n from hits group by all")
check("x21_page_rollup", lambda t: X.page_rollup(X.extract_hits(pages(t), snippets=False)),
      HITS + "select task_id, page_url, side, domain, root_domain, count(*) as hit_count, bool_or(source_type <> 'plain_text') as has_link, bool_or(source_type = 'plain_text') as has_text from hits group by all")
check("x22_evidence_per_page", lambda t: X.cap_evidence(X.extract_hits(pages(t))).groupBy("page_url", "domain").agg(F.count("*").alias("n")),
      HITS + "select page_url, domain, least(count(*), 5) as n from hits group by all")
check("x23_external_count_per_page", lambda t: X.page_external_counts(X.extract_hits(pages(t), snippets=False)),
      HITS + "select task_id, page_url, count(distinct domain) as external_domains_count from hits where side = 'external' group by all")
check("x19_internal_page_links", lambda t: X.discover_links(pages(t)).where("kind = 'page'").select("task_id", "page_url", "url"),
      r"""select distinct task_id, url as page_url, regexp_extract(url, '^(https?://[^/?#]*)', 1) || regexp_replace(h, '#.*$', '') as url from (select task_id, url, target_root, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*"([^"]*)"', 1)) as h from fx_pages)
      where h <> '' and h not like '#%' and suffix(regexp_extract(url, '://([^/?#:]*)', 1), target_root) and not contains(lower(h), 'download')""")
check("x15_names_in_scripts", lambda t: X.extract_hits(t.documents.select(F.lit(1).alias("task_id"), F.col("doc_id").cast("string").alias("page_url"),
      F.concat(F.lit("var t = `"), F.translate("text", "`\\", "  "), F.lit("`; fetch('https://api.s.io/v'); open.window")).alias("html"), F.lit("js").alias("resource"), F.lit("none.test").alias("target_host")))
      .groupBy("page_url", "domain", "source_type").agg(F.count("*").alias("n")),
      f"""with s as (select doc_id, replace(replace(text, '`', ' '), '\\', ' ') as text from documents), {text_names('s', 'doc_id', 'text')}, {parts_of('found')}
      select cast(key as varchar) as page_url, d as domain, 'script_code' as source_type, count(*) as n from found join parts using (raw, from_url) where root is not null group by all
      union all select cast(doc_id as varchar), 'api.s.io', unnest(['script_code', 'script_endpoint']), 1 from documents""")
check("x16_x18_names_in_styles", lambda t: X.extract_hits(t.documents.select(F.lit(1).alias("task_id"), F.col("doc_id").cast("string").alias("page_url"),
      F.concat(F.lit("@import 'https://i.s.io/a.css'; p{b:url(\"//u.s.io/x.png\")} "), F.col("text")).alias("html"), F.lit("css").alias("resource"), F.lit("none.test").alias("target_host")))
      .select("page_url", "domain", "source_type"),
      f"""with s as (select doc_id, '@import ''https://i.s.io/a.css''; p{{b:url("//u.s.io/x.png")}} ' || text as text from documents), {text_names('s', 'doc_id', 'text')}, {parts_of('found')}
      select cast(key as varchar) as page_url, d as domain, 'css_file_text' as source_type from found join parts using (raw, from_url) where root is not null
      union all select cast(doc_id as varchar), unnest(['i.s.io', 'u.s.io']), unnest(['css_file_import', 'css_file_url']) from documents""")
check("x3_x5_x7_x10_x17_x20_tagged_pages", lambda t: X.extract_hits(t.fx_pages.select("task_id", F.col("url").alias("page_url"), F.concat(F.lit(
    '<meta http-equiv="refresh" content="1;url=https://m.a1.io/"><link rel="canonical" href="https://c.example.com/"><img data-src="https://i.a2.io/p" src=//j.a3.io/q?u=https%3A%2F%2Fz.a4.io%2F&d=y.a5.io>'
    '<script src="https://s.a6.io/x.js"></script><script>location.replace("https://n.a7.io/"); $.get("https://g.a8.io/"); x = {url: "https://p.a9.io/"}</script>'
    '<style>b{background:url(https://b.b1.io/)}</style><iframe src="https://f.b2.io"></iframe><form action="https://o.b3.io/"></form><object data="https://d.b4.io/"></object><video src="https://v.b5.io/"></video><embed src="https://e.b6.io/">'),
    "html").alias("html"), F.lit("html").alias("resource"), "target_host")).select("page_url", "domain", "source_type"),
      HITS + """select page_url, domain, source_type from hits union all select url, 'c.example.com', 'canonical' from fx_pages where target_root = 'example.com' union all select url, 'c.example.com', 'link_href' from fx_pages union all
      select url as page_url, unnest(['m.a1.io','i.a2.io','j.a3.io','z.a4.io','y.a5.io','s.a6.io','n.a7.io','n.a7.io','g.a8.io','g.a8.io','p.a9.io','p.a9.io','b.b1.io','f.b2.io','o.b3.io','d.b4.io','v.b5.io','e.b6.io']) as domain,
      unnest(['meta_refresh','link_data-src','link_src','query_param_url','query_param_domain','link_src','script_code','script_endpoint','script_code','script_endpoint','script_code','script_endpoint','css_url','link_src','link_action','link_data','link_src','link_src']) as source_type from pages""")
check("x4_canonical", lambda t: X.extract_hits(t.fx_pages.select("task_id", F.col("url").alias("page_url"), F.concat(F.lit('<link rel="canonical" href="https://c.example.com/">'), "html").alias("html"), F.lit("html").alias("resource"), "target_host"))
      .select("page_url", "domain", "side", "source_type"),
      HITS + "select page_url, domain, side, source_type from hits union all select url, 'c.example.com', 'subdomain', 'canonical' from fx_pages where target_root = 'example.com' union all select url, 'c.example.com', case target_root when 'example.com' then 'subdomain' else 'external' end, 'link_href' from fx_pages")
check("x20_assets", lambda t: X.discover_links(t.fx_pages.select("task_id", F.col("url").alias("page_url"), F.concat(F.lit('<script src="/a.js"></script><link rel=stylesheet href="s/b.css?v=1"><script src="https://other.io/c.js"></script>'), "html").alias("html"), F.lit("html").alias("resource"), "target_host"))
      .select("page_url", "kind", F.regexp_extract("url", "[^/]*$", 0).alias("file")),
      r"""select url as page_url, unnest(['js','css']) as kind, unnest(['a.js','b.css?v=1']) as file from fx_pages where suffix(regexp_extract(url, '://([^/?#:]*)', 1), target_root) union all
      select page_url, 'page', regexp_extract(url, '[^/]*$') from (
       select distinct url as page_url, regexp_extract(url, '^(https?://[^/?#]*)', 1) || regexp_replace(h, '#.*$', '') as url from (select url, target_root, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?href\s*=\s*"([^"]*)"', 1)) as h from fx_pages)
       where h <> '' and h not like '#%' and suffix(regexp_extract(url, '://([^/?#:]*)', 1), target_root) and not contains(lower(h), 'download'))""")
check("k2_exact_host_scope", lambda t: X.extract_hits(pages(t), scope="exact_host").groupBy("page_url", "domain", "side", "source_type").agg(F.count("*").alias("n")),
      HITS + """select page_url, domain, s as side, source_type, count(*) as n from (select page_url, domain, source_type, unnest(case when side = 'external' then ['external']
      when source_type = 'link_href' and domain <> (case task_id when 0 then 'www.example.com' when 1 then 'www.example.net' else 'www.example.org' end) then ['subdomain', 'external'] else ['subdomain'] end) as s from hits) group by all""")
SITE_LEVELS = {"example.com": "critical", "example.net": "medium", "example.org": "low"}


def site_rules(t) -> DataFrame:
    """The stored rules, and one for each of two sites and a subdomain of the third."""
    kept = ["id", "domain", "match_type", "risk_level", "category", "remark"]
    own = t.fx_profiles.where("id in (1, 2, 3)")
    name = F.when(F.col("id") == 1, "example.com").when(F.col("id") == 2, "*.example.net").otherwise("Example.org")
    level = F.when(F.col("id") == 1, "critical").when(F.col("id") == 2, "medium").otherwise("low")
    own = own.withColumns({"domain": name, "match_type": F.lit("root"), "risk_level": level, "id": F.col("id") + 1000})
    return t.fx_profiles.unionByName(own).select(*kept, F.split("tags_text", "/").alias("tags"))


check("flagship_risky_domains_of_pages", lambda t: scan.risky_domains(pages(t), site_rules(t)),
      HITS + """select domain, root_domain, count(*) as total_occurrences, count(distinct task_id) as task_count, bool_or(source_type <> 'plain_text') as has_link,
      bool_or(source_type = 'plain_text') as has_text, case root_domain when 'example.com' then 'critical' when 'example.net' then 'medium' when 'example.org' then 'low' else 'pending' end as risk_level
      from hits where side = 'external' group by 1, 2""")
