"""URL expressions (F7, F8, F15, F17, F34) as built-in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.fixed_values import DEAD_LINK_PREFIXES, NON_HTML_SUFFIXES, URL_BYTES, URL_CHECK_CHARS
from linklens.functions.domains import sealed, strip

SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.-]*):"


def scheme(u: Column) -> Column:
    return F.lower(F.regexp_extract(u, SCHEME, 1))


def netloc(u: Column) -> Column:
    return F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)


def host_of_netloc(n: Column) -> Column:
    h = F.substring_index(n, "@", -1)
    return F.lower(F.when(h.startswith("["), F.regexp_extract(h, r"^\[([^\]]*)\]", 1))
                   .otherwise(F.substring_index(h, ":", 1)))


def host(u: Column) -> Column:
    """Lower-case host of an absolute or protocol-relative URL, '' if there is none."""
    return host_of_netloc(netloc(u))


def raw_path(u: Column) -> Column:
    return F.regexp_extract(u, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def path(u: Column) -> Column:
    """path, '/' when empty."""
    p = raw_path(u)
    return F.when(p == "", F.lit("/")).otherwise(p)


def query(u: Column) -> Column:
    return F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1)


def starts_with_any(c: Column, prefixes) -> Column:
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | c.startswith(p)
    return hit


def usable_link(raw: Column) -> Column:
    """Trimmed link without control characters; null if it cannot lead to a web page."""
    alive = rf"(?s)^(?!{'|'.join(DEAD_LINK_PREFIXES)}).+$"
    return F.nullif(F.regexp_extract(F.regexp_replace(strip(raw), r"[\t\r\n]", ""), alive, 0), F.lit(""))


def link_host(link: Column, base: Column) -> Column:
    """Host a (usable) link resolves to; null unless the result is http(s)."""
    s = scheme(link)
    absolute = link.rlike(r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//")
    web = (s == "") | s.isin("http", "https")
    return F.when(link.isNotNull() & web,
                  F.when(absolute, host(link)).when((s == "") | (s == scheme(base)), host(base)).otherwise(F.lit("")))


def _fold_dots(p: Column) -> Column:
    """Resolve '.' and '..' segments; only paths that have some pay for the fold."""
    segments = F.split(p, "/")
    folded = F.aggregate(
        segments, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when((s == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == "..", acc)
        .otherwise(F.array_append(acc, s)))
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit(""))
    out = F.concat(F.array_join(folded, "/"), tail)
    out = F.when(out.startswith("/"), out).otherwise(F.concat(F.lit("/"), out))
    out = F.when(out == "//", F.lit("/")).otherwise(out)
    return F.when(p.rlike(r"(^|/)\.{1,2}(/|$)"), out).otherwise(p)


def with_normalized_link(df: DataFrame, base: str, raw: Column, out: str) -> DataFrame:
    """add `out`, the absolute http(s) URL of a link found on column `base`, without fragment and default port.

    Written as a chain of projections so that every part is computed once.
    """
    c, keep = F.col, df.columns
    own_host = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//"
    absolute = r"^[a-zA-Z][a-zA-Z0-9+.-]*://"
    directory = F.regexp_replace(F.regexp_extract(c("__b"), r"^(.*/)?", 0), r"(?<=/)/+", "")
    steps = [
        {"__l": F.regexp_replace(usable_link(raw), r"#.*$", ""), "__bs": scheme(c(base)), "__b": raw_path(c(base))},
        {"__rel": (scheme(c("__l")) == c("__bs")) & ~c("__l").rlike(absolute)},
        {"__l": F.when(c("__rel"), F.regexp_replace(c("__l"), SCHEME, "")).otherwise(c("__l"))},
        {"__s": F.when(c("__rel"), F.lit("")).otherwise(scheme(c("__l"))), "__p": raw_path(c("__l")), "__q": query(c("__l")), "__dir": directory},
        {"__own": c("__l").rlike(own_host) | (c("__s") != ""), "__os": F.when(c("__s") == "", c("__bs")).otherwise(c("__s")),
         "__abs": F.when(c("__p").startswith("/"), c("__p")).otherwise(F.concat(
             F.when(c("__dir") == "", F.lit("/")).otherwise(c("__dir")), F.regexp_replace(c("__p"), r"/{2,}", "/")))},
        {"__n": F.when(c("__own"), netloc(c("__l"))).otherwise(netloc(c(base))),
         "__path": F.when(c("__own"), c("__p")).when(c("__p") == "", c("__b")).otherwise(_fold_dots(c("__abs"))),
         "__q": F.when(~c("__own") & (c("__p") == "") & (c("__q") == ""), query(c(base))).otherwise(c("__q"))},
        {"__port": F.when((c("__os") == "http") & c("__n").endswith(":80"), 3).when(
            (c("__os") == "https") & c("__n").endswith(":443"), 4).otherwise(0)},
        {out: F.when(
            c("__l").isNotNull() & c("__os").isin("http", "https"),
            F.concat(c("__os"), F.lit("://"), F.left(c("__n"), F.length(c("__n")) - c("__port")),
                     F.when(c("__path") == "", F.lit("/")).otherwise(c("__path")),
                     F.when(c("__q") != "", F.concat(F.lit("?"), c("__q"))).otherwise(F.lit(""))))},
    ]
    for step in steps:
        df = df.withColumns(step)
    return sealed(df.select(*[k for k in keep if k != out], out), out)


def is_crawlable(u: Column) -> Column:
    """F8: could the URL be an HTML page rather than a file or a download?"""
    p, q = F.lower(raw_path(u)), F.lower(query(u))
    attachment = p.rlike(r"\.(" + "|".join(NON_HTML_SUFFIXES) + r")$") | p.contains("download")
    download = q.contains("downloadattach") | q.contains("urltype=news.download")
    return F.coalesce((u != "") & ~attachment & ~download, F.lit(False))


def safe_url(u: Column) -> Column:
    """urls over the index limit cut to 2,000 bytes at a character boundary."""
    too_long = (F.length(u) > URL_CHECK_CHARS) & (F.octet_length(u) > URL_BYTES)
    # a UTF-8 character has at most four bytes, so one of four cut points is a boundary
    cuts = [F.try_validate_utf8(F.substring(F.encode(u, "UTF-8"), 1, URL_BYTES - k).cast("string")) for k in range(4)]
    return F.when(too_long, F.coalesce(*cuts)).otherwise(u)


def ensure_scheme(u: Column, default: str = "https") -> Column:
    """F34."""
    return F.when(u.startswith("http://") | u.startswith("https://"), u).otherwise(F.concat(F.lit(default + "://"), u))


def request_url(u: Column) -> Column:
    """URL a retest asks for: trimmed, http:// in front when no scheme is given."""
    t = strip(u)
    return F.when(t.startswith("http://") | t.startswith("https://"), t).otherwise(
        F.concat(F.lit("http://"), F.ltrim(t, F.lit("/"))))
