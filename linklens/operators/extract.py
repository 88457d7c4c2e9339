"""Page -> evidence rows.

One pass over the response table: every extractor works on the same row, their
finds are put into one array in scan order and exploded once.  From the scan to
the evidence rows nothing is shuffled and no page is read twice; the first
exchange is the roll-up on (task_id, domain).

Expected input columns: task_id, page_url, html, resource ('html'|'js'|'css'),
target_host and, if it is known already, target_root.
`sources.responses.prepare_pages` makes them from responses and tasks.
"""

from __future__ import annotations

import functools
import html.entities

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linklens import fixed_values as v
from linklens.functions import domains as D
from linklens.functions import public_suffix as ps
from linklens.functions import text as T
from linklens.functions import urls as U

# --- fixed values: patterns (possessive where text may be long) ---
ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
SCANNED_TAGS = "a|area|base|meta|link|img|script|iframe|frame|video|audio|source|track|form|object|embed"
TAG = rf"(?is)<(?:{SCANNED_TAGS})\b{ATTRS}>(?:[^<]{{0,200}}</[a-z]+\s*>)?"
COMMENT = r"<!--.*?-->"
SCRIPT = rf"<script\b{ATTRS}>.*?(?:</script\s*>|$)"
STYLE = r"<style\b[^>]*>.*?(?:</style\s*>|$)"
COMMENT_TEXT = rf"(?is)<!--(.*?)-->|{SCRIPT}|{STYLE}"
NOT_COMMENT = rf"(?is){COMMENT}|({SCRIPT}|{STYLE})"
SCRIPT_BLOCK = rf"(?is)<script\b{ATTRS}>.*?(?:</script\s*>|$)"
SCRIPT_OPEN = rf"(?is)^<script\b{ATTRS}>"
SCRIPT_CLOSE = r"(?i)</script\s*>$"
STYLE_BODY = r"(?is)<style\b[^>]*>(.*?)(?:</style\s*>|$)"
NO_BODIES = (rf"(?is){COMMENT}|(<script\b{ATTRS}>).*?(</script\s*>|$)|(<style\b[^>]*>).*?(</style\s*>|$)"
             r"|(<(?:textarea|title)\b[^>]*>).*?(</(?:textarea|title)\s*>)")
INVISIBLE = (r"(?is)<(?:!--.*?-->|!doctype[^>]*>|head\b.*?</head\s*>|title\b.*?</title\s*>|script\b.*?(?:</script\s*>|$)"
             r"|style\b.*?(?:</style\s*>|$)|noscript\b.*?(?:</noscript\s*>|$)|svg\b.*?(?:</svg\s*>|$))")
ANY_TAG = rf"(?s)</?[a-zA-Z]{ATTRS}>"
URL_IN_TEXT = (r"(?i)(?:https?:)?//[a-z0-9][-a-z0-9]*+(?:\.[a-z0-9][-a-z0-9]*+)++(?::\d+)?"
               r"(?:/[^\s\"'<>{}|\\^`\[\]]*)?")
WORD = r"(?![a-z0-9_\-])"
DNS_LABEL = rf"(?!-)[a-z0-9-]{{1,63}}+(?<!-){WORD}"
DNS_TLD = rf"[a-z]{{2,24}}+{WORD}"
NAKED_DOMAIN = (rf"(?i)(?<![a-z0-9_\-/.]){DNS_LABEL}(?:(?:\.(?!{DNS_TLD}){DNS_LABEL})*+\.{DNS_TLD})++"
                rf"(?::\d++{WORD}|(?![(=\[{{;`<>]))")
JS_TOKEN = r"""/\*[\s\S]*?\*/|//[^\r\n]*|"(?:\\[^\n]|[^"\\])*+"|'(?:\\[^\n]|[^'\\])*+'|`(?:\\[^\n]|[^`\\])*+`"""
JS_NAV = r"""(?i)(?:window\.)?(?:location(?:\.href|\.assign|\.replace)?|open)\s*\(?\s*['"][^'"]+['"]"""
JS_FETCH = r"""(?i)(?:fetch|\$\.(?:get|post|ajax)|axios(?:\.get|\.post)?)\s*\(\s*['"][^'"]+['"]"""
JS_PROP = r"""(?i)(?:url|path|endpoint|baseURL|apiUrl|targetUrl)\s*:\s*['"][^'"]+['"]"""
QUOTED_TAIL = r"""['"]([^'"]+)['"]$"""
CSS_URL = r"""(?i)url\(\s*['"]?[^'")]+['"]?\s*\)"""
CSS_URL_VALUE = r"""(?i)url\(\s*['"]?([^'")]+)['"]?\s*\)"""
CSS_IMPORT = r"""(?i)@import\s+['"][^'"]+['"]"""
META_URL = r"""(?i)url\s*=\s*['"]?([^'";\s]+)"""


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def decode_entities(c: Column) -> Column:
    """Character references: numeric and named ones; `&amp;` last.  Text without an ampersand is left as it is."""
    return F.when(c.contains("&"), T.let(c, all_references)).otherwise(c)


def all_references(c: Column) -> Column:
    def character(part):
        number = F.regexp_extract(part, r"(?i)^&#(x[0-9a-f]{1,6}|[0-9]{1,7});", 1)
        digits = F.when(F.lower(F.left(number, F.lit(1))) == "x", F.conv(F.substr(number, F.lit(2)), 16, 10)).otherwise(number)
        code = F.try_to_number(F.nullif(digits, F.lit("")), F.lit("99999999")).cast("long")
        legal = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        decoded = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        rest = F.regexp_replace(part, r"^&#[0-9a-zA-Z]+;", "")
        return F.when(legal, F.concat(decoded, rest)).otherwise(part)
    c = F.when(c.contains("&#"), F.array_join(F.transform(F.split(c, "(?=&#)"), character), "")).otherwise(c)
    for name, ch in v.NAMED_REFERENCES:
        if name != "amp":
            c = F.replace(c, F.lit(f"&{name};"), F.lit(ch))
    return T.let(c, lambda x: F.when(x.rlike("&[a-zA-Z]"), other_references(x)).otherwise(x))


@functools.lru_cache
def reference_table() -> str:
    """The public table of named character references as an SQL map."""
    pairs = [f"{name[:-1]}\x01{ch}" for name, ch in sorted(html.entities.html5.items()) if name.endswith(";")]
    return "str_to_map('" + "\x02".join(pairs).replace("\\", "\\\\").replace("'", "\\'") + "', '\x02', '\x01')"


def other_references(c: Column) -> Column:
    """All named references of a text, each once, so that `&amp;lt;` becomes `&lt;`."""
    def character(part):
        name = F.regexp_extract(part, "^&([a-zA-Z][a-zA-Z0-9]*);", 1)
        ch = F.when(name == "amp", "&").when(name != "", F.element_at(F.expr(reference_table()), name))
        return F.when(ch.isNotNull(), F.concat(ch, F.substr(part, F.length(name) + 3))).otherwise(part)
    return F.array_join(F.transform(F.split(c, "(?=&)"), character), "")


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of one tag, entities decoded; '' when absent."""
    value = rf"""(?is)[\s"'/]{name}\s*=\s*["']?+((?<=")[^"]*|(?<=')[^']*|(?<!["'])[^\s>]+)"""
    return decode_entities(F.regexp_extract(tag, value, 1))


def is_tag(tag: Column, names: str) -> Column:
    return tag.rlike(rf"(?i)^<(?:{names})\b")


def visible_text(html: Column) -> Column:
    """X11: text outside of scripts, styles, noscript, svg, head and comments."""
    return decode_entities(F.regexp_replace(F.regexp_replace(html, INVISIBLE, " "), ANY_TAG, " "))


def find(source_type: str, mode: str, token: Column, snippet: Column) -> Column:
    kind = F.lit(mode)
    if mode == "link_asset":
        kind = F.when(token.rlike(r"(?is)[\s\"'/]rel\s*=\s*(?:\"[^\"]*\bstylesheet\b|'[^']*\bstylesheet\b|stylesheet\b)"), "style_asset").otherwise(mode)
    return F.struct(F.lit(source_type).alias("source_type"), kind.alias("mode"),
                    token.alias("token"), snippet.alias("snippet"))


def tag_finds(tags: Column, keep, *targets: tuple[str, str]) -> Column:
    """One find per kept tag and (source type, mode); the attribute is read after the explode."""
    return F.flatten(F.transform(F.filter(tags, keep), lambda t: F.array(
        *[find(st, mode, t, F.lit(None).cast("string")) for st, mode in targets])))


def text_finds(source_type: str, text: Column, lowered: Column | None) -> Column:
    """X12 then X13: URLs, then naked domain names of a text; without the lowered text no snippets are made."""
    return F.concat(*[_matches_of(source_type, mode, text, lowered, pattern)
                      for mode, pattern in (("text_url", URL_IN_TEXT), ("text_name", NAKED_DOMAIN))])


def _matches_of(source_type: str, mode: str, text: Column, lowered: Column | None, pattern: str) -> Column:
    return F.transform(all_matches(text, pattern), lambda m: find(
        source_type, mode, m, F.lit(None).cast("string") if lowered is None else T.bound_snippet(text, lowered, m)))


def short_text_finds(source_type: str, texts: Column, snippets: bool = True) -> Column:
    """X12 and X13 over an array of texts; texts without a dot cannot hold a name."""
    found = (lambda t: T.let(F.lower(t), lambda low: text_finds(source_type, t, low))) if snippets else (lambda t: text_finds(source_type, t, None))
    return F.flatten(F.transform(F.filter(texts, lambda t: t.contains(".")), found))


def token_content(token: Column) -> Column:
    """Inside of a quoted literal or a comment."""
    cut = F.length(token) - 2
    return (F.when(token.rlike(r"""(?s)^(["'`]).*\1$""") & (cut >= 0), F.substr(token, F.lit(2), cut))
            .when(token.startswith("//"), F.substr(token, F.lit(3)))
            .when(token.startswith("/*") & token.endswith("*/"), F.substr(token, F.lit(3), F.greatest(cut - 2, F.lit(0))))
            .otherwise(token))


def pattern_finds(source_type: str, mode: str, text: Column, pattern: str) -> Column:
    return F.transform(all_matches(text, pattern), lambda m: find(source_type, mode, m, F.lit(None).cast("string")))


def script_finds(script: Column, snippets: bool = True) -> Column:
    """Literals and comments of a script, then its endpoints."""
    tokens = F.filter(F.transform(all_matches(script, JS_TOKEN), token_content), lambda t: F.length(t) > 3)
    return F.concat(short_text_finds("script_code", tokens, snippets),
                    *[pattern_finds("script_endpoint", "page_link", script, p) for p in (JS_NAV, JS_FETCH, JS_PROP)])


def built_once(build):
    """Keep a built column for the life of the session; its lambdas take thousands of calls to put together."""
    made: dict = {}

    @functools.wraps(build)
    def get(*args, **kwargs):
        key = (id(SparkContext._active_spark_context), args, tuple(sorted(kwargs.items())))
        if key not in made:
            made[key] = build(*args, **kwargs)
        return made[key]
    return get


@built_once
def find_column(assets: bool, text: bool, snippets: bool) -> Column:
    """The finds of a page by its kind of resource."""
    return (F.when(F.col("resource") == "js", script_finds(F.col("html"), snippets))
            .when(F.col("resource") == "css", css_finds(F.col("html"), snippets))
            .when(F.col("resource") == "text", short_text_finds("plain_text", F.array("html"), snippets))
            .otherwise(html_finds(assets, text, snippets)))


def html_finds(assets: bool = True, text: bool = True, snippets: bool = True) -> Column:
    """Finds of an HTML page in scan order, over the columns `parse_pages` adds."""
    tags = F.col("tags")
    parts = [
        F.array(find("page_host", "host", F.col("page_host"), F.col("page_url"))),
        tag_finds(tags, lambda t: is_tag(t, "a|area"), ("link_href", "page_link")),
        tag_finds(tags, lambda t: is_tag(t, "meta") & t.rlike(r"(?is)http-equiv\s*=\s*[\"']?refresh\b"), ("meta_refresh", "page_link")),
        F.slice(tag_finds(tags, lambda t: is_tag(t, "link") & t.rlike(r"(?is)\brel\s*=\s*(?:\"[^\"]*canonical|'[^']*canonical|canonical)"),
                          ("canonical", "canonical")), 1, 1),
    ]
    if assets:
        grouped: dict[str, list[str]] = {}
        for names, attr in v.ASSET_SPECS:
            grouped.setdefault(names, []).append(attr)
        modes = {"script": "script_asset", "link": "link_asset", "iframe|frame": "page_asset", "form": "page_asset"}
        parts += [tag_finds(tags, lambda t: is_tag(t, names), *[(f"link_{a}", modes.get(names, "asset")) for a in attrs])
                  for names, attrs in grouped.items()]
        parts.append(F.flatten(F.transform(F.col("styles"), lambda s: pattern_finds("css_url", "asset_link", s, CSS_URL))))
    if text:
        parts.append(short_text_finds("comment", F.col("comments"), snippets))
        parts.append(F.flatten(F.transform(F.col("scripts"), lambda s: script_finds(s, snippets))))
        parts.append(text_finds("plain_text", F.col("body"), F.col("body_lower") if snippets else None))
    return F.concat(*parts)


def css_finds(css: Column, snippets: bool = True) -> Column:
    """Imports, urls and names of a style sheet."""
    return F.concat(pattern_finds("css_file_import", "import_link", css, CSS_IMPORT),
                    pattern_finds("css_file_url", "asset_link", css, CSS_URL),
                    short_text_finds("css_file_text", F.array(css), snippets))


def parse_pages(pages: DataFrame) -> DataFrame:
    """Split each page once into tags, comments, scripts, styles and visible text."""
    html, is_html = F.col("html"), F.col("resource") == "html"
    open_ = F.regexp_replace(html, NOT_COMMENT, " $1")  # scripts and styles inside comments are comment text
    inline = F.filter(all_matches(open_, SCRIPT_BLOCK), lambda b: ~F.regexp_extract(b, SCRIPT_OPEN, 0).rlike(
        r"(?i)[\s\"'/]src\s*(?:=|>|\s)"))
    code = F.transform(inline, lambda b: F.regexp_replace(F.regexp_replace(b, SCRIPT_OPEN, ""), SCRIPT_CLOSE, ""))
    parsed = pages.withColumns({"html": F.coalesce(html, F.lit("")), "page_host": U.host(F.col("page_url"))})
    parsed = parsed.withColumns({
        "title": F.when(is_html, decode_entities(D.strip(F.regexp_extract(open_, r"(?is)<title[^>]*>(.*?)</title>", 1)))),
        "tags": F.when(is_html, all_matches(F.regexp_replace(html, NO_BODIES, " $1$2$3$4$5$6"), TAG)),
        "comments": F.when(is_html, F.filter(all_matches(html, COMMENT_TEXT, 1), lambda c: c != "")),
        "scripts": F.when(is_html, code),
        "styles": F.when(is_html, all_matches(open_, STYLE_BODY, 1)),
        "body": F.when(is_html, visible_text(html))})
    parsed = parsed.withColumn("body_lower", F.lower(F.col("body")))
    return with_effective_base(parsed)


def with_effective_base(parsed: DataFrame) -> DataFrame:
    """The first <base href> resolved against the page, if that gives http(s)."""
    tag = F.get(F.filter(F.col("tags"), lambda t: is_tag(t, "base") & t.rlike(r"(?i)[\s\"'/]href\s*=")), F.lit(0))
    df = parsed.withColumn("__base", attribute(tag, "href"))
    df = U.with_normalized_link(df, "page_url", F.col("__base"), "base_url").drop("__base")
    return df.withColumn("base_url", F.coalesce("base_url", "page_url"))


def find_value() -> Column:
    """Raw match of a find: attribute value, quoted target or the match itself."""
    token, st = F.col("token"), F.col("source_type")
    attrs = dict.fromkeys(a for _, a in v.ASSET_SPECS)
    raw = F.when(st == "canonical", attribute(token, "href"))
    raw = raw.when(st == "meta_refresh", F.regexp_extract(attribute(token, "content"), META_URL, 1))
    raw = raw.when(st.isin("css_url", "css_file_url"), D.strip(F.regexp_extract(token, CSS_URL_VALUE, 1)))
    raw = raw.when(st.isin("css_file_import", "script_endpoint"), D.strip(F.regexp_extract(token, QUOTED_TAIL, 1)))
    for a in attrs:
        raw = raw.when(st == f"link_{a}", attribute(token, a))
    return raw.otherwise(token)


def query_values(link: Column) -> Column:
    """Parameter values of a link, decoded twice, that hold a URL or a dotted name."""
    pairs = F.filter(F.split(U.query(link), "&"), lambda p: p.contains("="))
    first = F.transform(pairs, lambda p: T.let(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1),
                                               lambda x: F.coalesce(F.try_url_decode(x), x)))
    second = F.transform(F.filter(first, lambda x: F.length(x) >= 4), lambda x: D.strip(
        F.coalesce(F.try_url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))), x)))

    def value(x):
        return (F.when(x.rlike("^(?:https?:)?//"), named("query_param_url", "url_value", x, U.host(x)))
                .when(x.contains(".") & ~x.contains("/"), named("query_param_domain", "name_value", x, x)))
    return F.filter(F.transform(second, value), lambda x: x.isNotNull())


def named(source_type, mode, raw: Column, host: Column) -> Column:
    st = F.lit(source_type) if isinstance(source_type, str) else source_type
    md = F.lit(mode) if isinstance(mode, str) else mode
    return F.struct(st.alias("source_type"), md.alias("mode"), raw.alias("raw"), host.alias("find_host"))


@built_once
def named_finds() -> Column:
    """Raw match and named host of a find, followed by what its query string holds."""
    st, mode, token = F.col("source_type"), F.col("mode"), F.col("token")
    none = F.array().cast("array<struct<source_type:string,mode:string,raw:string,find_host:string>>")

    def of_link(raw, link):
        itself = F.array(named(st, mode, raw, U.link_host(link, F.col("base_url"))))
        with_query = st.startswith("link_") & link.contains("?")
        return F.when(with_query, F.concat(itself, query_values(link))).otherwise(itself)

    def of_raw(raw):
        dead = (st == "script_endpoint") & U.starts_with_any(raw, v.DEAD_ENDPOINT_PREFIXES)
        return T.let(U.usable_link(raw), lambda link: F.when(link.isNull() | dead, none).otherwise(of_link(raw, link)))

    return (
        F.when(mode == "host", F.array(named(st, mode, token, token)))
        .when(mode == "text_url", F.array(named(st, mode, token, F.regexp_extract(token, r"//([^/:]*)", 1))))
        .when(mode == "text_name", F.array(named(st, mode, token, F.substring_index(token, ":", 1))))
        .otherwise(T.let(find_value(), of_raw)))


def page_finds(pages: DataFrame, assets: bool = True, text: bool = True, snippets: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """Every find of every page with its position in scan order; narrow.

    The first explode yields tags, literals and text matches, the second one
    reads attribute values and query strings.  Outer explodes: for inner ones
    the optimizer adds a filter that evaluates the whole array a second time.
    """
    page_columns = ["task_id", "page_url", "target_host", "target_root", "base_url", "resource", *keep]
    if "target_root" not in pages.columns:
        pages = D.with_target_root(pages, "target_host")
    df = parse_pages(pages).select(*page_columns, F.posexplode_outer(find_column(assets, text, snippets)).alias("pos", "find"))
    df = df.select(*page_columns, "pos", "find.*")
    df = df.select(*page_columns, "pos", "token", "snippet", F.posexplode_outer(named_finds()).alias("part", "value"))
    df = df.where(F.col("part").isNotNull())
    seq = F.col("pos").cast("long") * 1000000 + F.col("part")
    df = df.select(*page_columns, seq.alias("seq"), "token", "snippet", "value.*")
    if not snippets:
        return df.drop("token")
    return df.withColumn("snippet", F.when(F.col("mode").isin("text_url", "text_name"), F.col("snippet")).when(
        F.col("mode") == "host", T.make_snippet(F.col("snippet"), F.col("raw"))).otherwise(
        T.make_snippet(F.left("token", F.lit(200)), F.col("raw")))).drop("token")


def extract_hits(pages: DataFrame, scope: str = "root_domain", assets: bool = True, text: bool = True,
                 own_attachments_as_external: bool = False, snippets: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per hit, `side` telling external domains from the site's own subdomains.

    The first exchange after this is the caller's: everything here is narrow.  Who only
    counts does without `snippets` (they are null then); `keep` names columns of the
    pages to go along with their hits.
    """
    finds = page_finds(pages, assets, text, snippets, keep)
    hits = D.with_domain_parts(finds, F.col("find_host"), ~F.col("mode").isin("name_value", "text_name"))
    hits = hits.where(F.col("domain").isNotNull())
    own = D.is_subdomain(F.col("root_domain"), F.col("target_root"))
    inside = D.is_internal(F.col("domain"), F.col("root_domain"), F.col("target_host"), F.col("target_root"), scope)
    from_text = F.col("mode").isin("url_value", "name_value", "text_url", "text_name")
    own_only = F.col("mode").isin("host", "canonical")
    outside = ~inside & ~own_only & ~(from_text & own)
    if own_attachments_as_external:
        hits = U.with_normalized_link(hits, "base_url", F.col("raw"), "url")
        outside = outside | ((F.col("mode") == "page_link") & inside & ~U.is_crawlable(F.col("url")))
    if scope == "exact_host" or own_attachments_as_external:
        hits = hits.withColumn("side", F.explode_outer(F.array_compact(F.array(
            F.when(own, F.lit("subdomain")), F.when(outside, F.lit("external"))))))
    else:
        hits = hits.withColumn("side", F.when(own, F.lit("subdomain")).when(outside, F.lit("external")))
    return hits.where(F.col("side").isNotNull()).select(
        "task_id", "page_url", "domain", "root_domain", "side", "source_type",
        F.col("raw").alias("raw_match"), F.col("snippet").alias("context_snippet"),
        T.is_link_type(F.col("source_type")).alias("is_link"), "seq", *keep)


def discover_links(pages: DataFrame, scope: str = "root_domain") -> DataFrame:
    """Internal page urls and js/css asset urls found on each page."""
    finds = page_finds(pages, text=True, snippets=False).where(F.col("mode").isin(
        "page_link", "canonical", "page_asset", "script_asset", "link_asset", "style_asset", "asset_link", "import_link"))
    links = U.with_normalized_link(finds, "base_url", F.col("raw"), "url").where(F.col("url").isNotNull())
    links = links.withColumn("url_host", U.host(F.col("url"))).withColumn("__n", ps.suffix_length("url_host"))
    links = D.sealed(links.withColumn("url_root", ps.root_from_suffix_length("url_host", "__n")).drop("__n"), "url_root")
    inside = D.is_internal(F.col("url_host"), F.col("url_root"), F.col("target_host"), F.col("target_root"), scope)
    p, from_tag = F.lower(U.raw_path(F.col("url"))), F.col("mode") == "link_asset"
    kind = (
        F.when(F.col("mode") == "script_asset", "js")
        .when((F.col("mode") == "style_asset") | from_tag & p.endswith(".css"), "css")
        .when(from_tag & p.endswith(".js"), "js")
        .when(F.col("mode") == "import_link", "css")
        .when((F.col("mode") == "asset_link") & (F.col("resource") == "html") & F.col("url").endswith(".css"), "css")
        .when(F.col("mode").isin("page_link", "canonical", "page_asset") & U.is_crawlable(F.col("url")), "page"))
    return (links.where(inside).withColumn("kind", kind).where(F.col("kind").isNotNull())
            .select("task_id", "page_url", "url", "kind").distinct())


def page_rollup(hits: DataFrame) -> DataFrame:
    """Per page and domain the count and the kinds of evidence."""
    return hits.groupBy("task_id", "page_url", "side", "domain", "root_domain").agg(
        F.count("*").alias("hit_count"), F.bool_or("is_link").alias("has_link"),
        F.bool_or(~F.col("is_link")).alias("has_text"))


def page_external_counts(hits: DataFrame) -> DataFrame:
    """Distinct external domains per page."""
    ext = hits.where(F.col("side") == "external").groupBy("task_id", "page_url", "domain").agg(F.lit(1).alias("one"))
    return ext.groupBy("task_id", "page_url").agg(F.count("*").alias("external_domains_count"))


def cap_evidence(hits: DataFrame, per_domain: int = v.EVIDENCE_PER_DOMAIN) -> DataFrame:
    """The first hits of each (page, domain) in scan order.

    The rank filter is pushed below the exchange (group limit), so at most
    `per_domain` rows of a key leave each map task however hot the key is.
    """
    w = Window.partitionBy("task_id", "page_url", "domain").orderBy("seq", "side")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_domain).drop("rank")
