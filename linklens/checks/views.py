"""Adapter views: the given tables in the shapes of a scan store.

One SQL text per view serves Spark and the comparison engine.  Every view reads
its tables whole; keys are derived, nothing is filtered.  One domain
(`cdn.widelyused.net`) holds more than a quarter of all evidence on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linklens.operators.joins import with_risky_domain

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
               "benchmark labels conversations").split()

SUFFIX = "case l_suppkey % 4 when 0 then '.com' when 1 then '.co.uk' when 2 then '.gov.cn' else '.edu.cn' end"

VIEWS = {
    # one scanned site per nation and market segment
    "fx_tasks": """
select cast(c_nationkey * 5 + case c_mktsegment when 'MACHINERY' then 0 when 'BUILDING' then 1 when 'AUTOMOBILE' then 2
  when 'FURNITURE' then 3 else 4 end as int) as task_id, concat('Site ', cast(c_nationkey as varchar(9)), ' ', c_mktsegment) as name,
 concat('https://c', cast(c_nationkey as varchar(9)), '-', lower(c_mktsegment), '.test/') as target_url,
 case c_mktsegment when 'MACHINERY' then 'deleting' when 'BUILDING' then 'running' else 'completed' end as status,
 cast(count(*) as int) as pages_total, cast(sum(case when c_acctbal > 0 then 1 else 0 end) as int) as pages_crawled,
 cast(max(c_custkey) % 1000 as int) as external_domains_count, cast(min(c_custkey) % 100 as int) as subdomains_count
 from customer group by c_nationkey, c_mktsegment""",
    "fx_occurrences": """
select cast(c.c_nationkey * 5 + case c.c_mktsegment when 'MACHINERY' then 0 when 'BUILDING' then 1 when 'AUTOMOBILE' then 2
  when 'FURNITURE' then 3 else 4 end as int) as task_id,
 case when l.l_discount >= 0.08 then 'cdn.widelyused.net' else concat(lower(l.l_linestatus), '.s', cast(l.l_suppkey as varchar(12)), SUFFIX) end as domain,
 case when l.l_discount >= 0.08 then 'widelyused.net' else concat('s', cast(l.l_suppkey as varchar(12)), SUFFIX) end as root_domain,
 concat('https://c', cast(c.c_nationkey as varchar(9)), '-', lower(c.c_mktsegment), '.test/o/', lower(substr(o.o_orderpriority, 1, 1)),
  case o.o_orderstatus when 'P' then '.js' when 'F' then '.html' else '' end) as page_url,
 case l.l_returnflag when 'A' then 'link_href' when 'N' then 'plain_text' else 'script_code' end as source_type,
 concat('raw-', cast(l.l_partkey as varchar(12))) as raw_match, concat('ctx ', cast(l.l_partkey as varchar(12)), ' ', l.l_linestatus) as context_snippet,
 l.l_returnflag = 'A' as is_link, ((l.l_orderkey * 10 + l.l_linenumber) * 100000 + l.l_partkey) * 1000 + l.l_suppkey as seq, l.l_shipdate as created_at
 from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey""".replace("SUFFIX", SUFFIX),
    "fx_external_domains": """
select task_id, domain, root_domain, occurrence_count, has_link, has_text, sample_page_url, created_at,
 case greatest(case when m = 0 then 0 when m < 4 then 1 when m < 10 then 2 when m < 21 then 3 when m < 51 then 4 else 5 end, num % 6)
  when 0 then 'critical' when 1 then 'high' when 2 then 'medium' when 3 then 'low' when 4 then 'safe' else 'pending' end as risk_level,
 case greatest(case when u < 2 then 0 when u < 9 then 1 when u < 21 then 2 else 3 end, num % 4)
  when 0 then 'verified_failed' when 1 then 'verified_clean' when 2 then 'error' else 'unverified' end as verify_status,
 case when task_id % 5 = 3 then 'manual' else 'intel_rule' end as risk_source, id
 from (select task_id, domain, root_domain, count(*) as occurrence_count, bool_or(is_link) as has_link, bool_or(not is_link) as has_text,
        min(page_url) as sample_page_url, min(created_at) as created_at, min(seq) as id,
        (task_id * 7 + count(*)) % 97 as m, (task_id * 5 + count(*)) % 89 as u, length(domain) as num
       from fx_occurrences group by task_id, domain, root_domain) g""",
    "fx_subdomains": """
select task_id, domain, root_domain, count(*) as occurrence_count, bool_or(is_link) as has_link, bool_or(not is_link) as has_text,
 min(page_url) as sample_page_url, min(created_at) as created_at, min(seq) as id
 from fx_occurrences group by task_id, domain, root_domain""",
    "fx_profiles": """
select cast(s_suppkey as int) as id,
 case when s_suppkey = 0 then 'widelyused.net' when s_suppkey % 3 = 0 then concat('o.s', cast(l_suppkey as varchar(12)), SUFFIX)
  when s_suppkey % 3 = 1 then concat('s', cast(l_suppkey as varchar(12)), SUFFIX) else concat('*.unused', cast(l_suppkey as varchar(12)), '.net') end as domain,
 case when s_suppkey > 0 and s_suppkey % 3 = 0 then 'exact' when s_suppkey % 6 = 1 then 'wildcard' else 'root' end as match_type,
 case when s_acctbal < 0 then 'critical' when s_acctbal < 2500 then 'high' when s_acctbal < 5000 then 'medium' when s_acctbal < 7500 then 'low' else 'safe' end as risk_level,
 concat('cat', cast(s_nationkey % 3 as varchar(9))) as category,
 concat('t', cast(s_nationkey % 4 as varchar(9)), '/cat', cast(s_nationkey % 5 as varchar(9))) as tags_text,
 case when s_nationkey % 2 = 0 then '' else concat('note ', s_name) end as remark
 from (select *, s_suppkey as l_suppkey from supplier) s""".replace("SUFFIX", SUFFIX),
    "fx_tickets": """
select o.id, o.task_id, o.domain, o.root_domain, o.page_url, o.source_type, o.raw_match, o.context_snippet, ed.risk_level,
 case o.n % 5 when 0 then 'unverified' when 1 then 'verified_failed' when 2 then 'verified_clean' when 3 then 'page_removed' else 'error' end as verify_status,
 case when o.m % 4 = 0 then 'ignored' when o.m % 4 = 1 then 'resolved' when o.m % 4 = 2 then 'in_progress' else 'pending' end as manual_status,
 case when o.m % 3 = 0 then '' when o.m % 3 = 1 then 'checked' else '【复测告警】检测到违规外链再次出现，工单重新打开待处置' end as manual_remark,
 case when o.task_id % 7 = 0 then null else o.last_seen end as last_verified_at, o.first_seen as created_at
 from (select task_id, domain, root_domain, page_url, min(seq) as id, sum(seq) as n, max(seq) as m, max(created_at) as last_seen,
        min(created_at) as first_seen, min(source_type) as source_type, min(raw_match) as raw_match, min(context_snippet) as context_snippet
       from fx_occurrences group by task_id, domain, root_domain, page_url) o
 join fx_external_domains ed on o.task_id = ed.task_id and o.domain = ed.domain
 where ed.risk_level in ('critical','high','medium','low')""",
    "fx_logs": """
select event_id as id, cast(user_id as int) as task_id, case event_type when 'error' then 'ERROR' when 'purchase' then 'warn' when 'signup' then null else 'info' end as level,
 props as message, ts as created_at from events""",
    "fx_sitemap_pages": """
select o_orderkey as id, cast(c.c_nationkey * 5 + case c.c_mktsegment when 'MACHINERY' then 0 when 'BUILDING' then 1 when 'AUTOMOBILE' then 2
  when 'FURNITURE' then 3 else 4 end as int) as task_id,
 concat('https://c', cast(c.c_nationkey as varchar(9)), '-', lower(c.c_mktsegment), '.test/o/', cast(o_orderkey as varchar(12)),
  case o_orderpriority when '1-URGENT' then '.js' when '5-LOW' then '?a=1&b=<2>' else '' end) as url,
 concat('/o/', cast(o_orderkey as varchar(12))) as path, cast(o_orderkey % 6 as int) as depth,
 case o_orderstatus when 'F' then 200 when 'O' then 301 else 404 end as status_code,
 case o_orderpriority when '1-URGENT' then 'application/javascript' when '2-HIGH' then 'text/css' else 'text/html' end as content_type,
 o_orderpriority as title, o_orderdate as crawled_at from orders o join customer c on o.o_custkey = c.c_custkey""",
    # each stored page belongs to a scan of one of three sites; the hosts of the others are external to it
    "fx_pages": """
select page_id, cast(page_id % 3 as int) as task_id, url, html,
 case page_id % 3 when 0 then 'www.example.com' when 1 then 'www.example.net' else 'www.example.org' end as target_host,
 case page_id % 3 when 0 then 'example.com' when 1 then 'example.net' else 'example.org' end as target_root from pages""",
    # raw names and links of many shapes, one per order
    "fx_raw_names": """
select o_orderkey as id, case o_orderkey % 16 when 0 then concat(' HTTPS://Www.A', k, '.Co.Uk:8080/p?q#f ') when 1 then concat('b', k, '.com.') when 2 then concat('10.0.', k, '.1')
  when 3 then 'example.com' when 4 then concat('sub', k, '.example.com') when 5 then concat('-bad', k, '.com') when 6 then concat('a..b', k, '.net') when 7 then concat('x', k, '.js')
  when 8 then concat('window', k, '.open') when 9 then concat('a.city', k, '.kawasaki.jp') when 10 then 'city.kawasaki.jp' when 11 then concat('n', k, '.gov.cn')
  when 12 then concat('e.', case when o_orderkey % 3 = 0 then 'target' else 'map' end, '.top') when 13 then concat('u_', k, '.org') when 14 then concat('t', k, '.nosuchtld') else concat('d.e', k, '.io/x') end as raw
 from (select o_orderkey, cast(o_orderkey % 200 as varchar(9)) as k from orders) o""",
    "fx_raw_links": """
select o_orderkey as id, o_orderkey % 14 as kind, k, concat('https://h', k, '.com/a/b/c.html?x=1#t') as base,
 case o_orderkey % 14 when 0 then concat('../p', k) when 1 then concat('./q', k, '?z=1') when 2 then concat('?s=', k) when 3 then concat('//cdn', k, '.org:443/x#f') when 4 then '#top'
  when 5 then concat('mailto:u', k, '@x.com') when 6 then concat('http://e', k, '.net:80') when 7 then concat('/abs/./x/../', k) when 8 then concat(' r', k, '/s.pdf ') when 9 then 'javascript:void(0)'
  when 10 then concat('https://f', k, '.de/download/1') when 11 then concat('ftp://g', k, '/x') when 12 then concat('HTTP://I', k, '.io/P') else '../../../..' end as raw
 from (select o_orderkey, cast(o_orderkey % 200 as varchar(9)) as k from orders) o""",
    # a later response for every ticket page: the page may be gone, broken, cleared or still show the domain
    "fx_responses": """
select page_url as url, case n % 11 when 0 then 404 when 1 then 410 when 2 then 500 when 3 then 403 when 4 then 0 when 5 then 0 when 6 then 0 else 200 end as status_code,
 case n % 11 when 4 then 'Request Timeout' when 5 then 'Connection Failed' when 6 then 'broken pipe' else '' end as error,
 case n % 11 when 3 then 'Error 404 page' else concat('<html><title> Page  ', cast(n % 11 as varchar(9)), ' </title>see ', upper(lo), ' and ', hi, '</html>') end as body
 from (select page_url, sum(seq) as n, min(domain) as lo, max(domain) as hi from fx_occurrences group by page_url) g""",
}

NEEDS = {
    "fx_external_domains": ["fx_occurrences"],
    "fx_subdomains": ["fx_occurrences"],
    "fx_tickets": ["fx_occurrences", "fx_external_domains"],
    "fx_responses": ["fx_occurrences"],
}


def _closure(names: tuple[str, ...]) -> list[str]:
    out: list[str] = []
    for n in names:
        for d in [*_closure(tuple(NEEDS.get(n, ()))), n]:
            if d not in out:
                out.append(d)
    return out


def with_views(*names: str) -> str:
    """Leading part of a statement that uses the named views."""
    return "with " + ",\n".join(f"{n} as ({VIEWS[n]})" for n in _closure(names)) + "\n"


def base(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: A sum of 64-bit numbers is a 64-bit number in Spark, and a wider one in the comparison engine.
WIDE_SUM = ("sum(seq)", "sum(cast(seq as decimal(38, 0)))")

#: Orders meet their customers first in Spark, which joins as written: a row of lineitem is shuffled once, not twice.
ORDERS_FIRST = ("lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey",
                "lineitem l join (orders o join customer c on o.o_custkey = c.c_custkey) on l.l_orderkey = o.o_orderkey")

#: Places of views that were written out, by data directory and name.
STORED: dict[tuple[str, str], str] = {}


def store(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """Write every view out once, so that later queries measure their own work and not the views'."""
    for name in VIEWS:
        df = view(spark, sf_dir, name)
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        STORED[sf_dir, name] = f"{folder}/{name}"


def view(spark: SparkSession, sf_dir: str, name: str, placed: dict[str, DataFrame] | None = None) -> DataFrame:
    """A view as a DataFrame over the parquet files of `sf_dir`; views it is made from are taken from `placed` if they are there."""
    if (sf_dir, name) in STORED:
        return spark.read.parquet(STORED[sf_dir, name])
    placed = {k: df for k, df in (placed or {}).items() if k in NEEDS.get(name, ())}
    if name == "fx_tickets" and len(placed) == 2:  # evidence of other domains would be grouped and moved in vain
        placed["fx_occurrences"] = with_risky_domain(placed["fx_occurrences"], placed["fx_external_domains"])
    made = [n for n in _closure((name,)) if n not in placed and (n == name or any(n in _closure((d,)) for d in NEEDS[name] if d not in placed))]
    needed = [t for t in BASE_TABLES if any(t in VIEWS[n] for n in made)]
    tables = [f"{t} as (select * from parquet.`{sf_dir}/{t}.parquet`)" for t in needed] + [f"{n} as (select * from {{{n}}})" for n in placed]
    texts = [f"{n} as ({VIEWS[n].replace(*WIDE_SUM).replace(*ORDERS_FIRST)})" for n in made]
    return spark.sql(f"with {',\n'.join(tables + texts)}\nselect * from {name}", **placed)
