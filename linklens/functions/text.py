"""Text, label and number expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from linklens import fixed_values as v
from linklens.functions.domains import WHITESPACE, strip


def fill(template: str, *args: Column) -> Column:
    """Concatenate a fixed text with columns at {0}, {1}, ..."""
    parts, rest = [], template
    while rest:
        i = min((rest.find("{%d}" % k) for k in range(len(args)) if "{%d}" % k in rest), default=-1)
        if i < 0:
            parts.append(F.lit(rest))
            break
        if i:
            parts.append(F.lit(rest[:i]))
        parts.append(F.coalesce(args[int(rest[i + 1])].cast("string"), F.lit("")))
        rest = rest[i + 3:]
    return F.concat(*parts)


def _one_line(c: Column) -> Column:
    return F.translate(c, "\r\n", "  ")


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it many times, where only a single expression is allowed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _cut(text: Column, at: Column, target: Column, before: int, after: int, fallback: Column, trim: bool) -> Column:
    start = F.greatest(F.lit(0), at - 1 - before)
    end = F.least(F.length(text), at - 1 + F.length(target) + after)
    body = _one_line(F.substr(text, start + 1, end - start))
    body = F.btrim(body, F.lit(WHITESPACE)) if trim else body
    return F.when(at == 0, fallback).otherwise(F.concat(
        F.when(start > 0, F.lit("...")).otherwise(F.lit("")), body,
        F.when(end < F.length(text), F.lit("...")).otherwise(F.lit(""))))


def make_snippet(text: Column, target: Column, width: int = 120) -> Column:
    """evidence snippet around the first case-insensitive match, '...' where it was cut."""
    at = F.position(F.lower(target), F.lower(text))
    return _cut(text, at, target, width // 2, width // 2, strip(F.left(text, F.lit(width))), True)


def bound_snippet(text: Column, lowered: Column, target: Column, width: int = 120) -> Column:
    """F11 for use inside a lambda: long text is searched once."""
    return let(F.position(F.lower(target), lowered), lambda at: _cut(
        text, at, target, width // 2, width // 2, strip(F.left(text, F.lit(width))), True))


def verdict_snippet(text: Column, target: Column, width: int = 150) -> Column:
    """40 characters before and 60 after, the beginning of the text when not found."""
    at = F.position(F.lower(target), F.lower(text))
    return _cut(text, at, target, 40, 60, F.left(text, F.lit(width)), False)


def context_around(text: Column, target: Column, window: int = 60) -> Column:
    """empty when not found."""
    at = F.position(F.lower(target), F.lower(text))
    return _cut(text, at, target, window, window, F.lit(""), False)


def html_title(html: Column) -> Column:
    """first title, whitespace collapsed, at most 150 characters."""
    t = strip(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    return F.left(F.regexp_replace(t, r"\s+", " "), F.lit(150))


def cut_raw_match(c: Column) -> Column:
    """F16."""
    return F.left(c, F.lit(v.RAW_MATCH_CHARS))


def cut_snippet(c: Column) -> Column:
    """F16."""
    return F.left(c, F.lit(v.SNIPPET_CHARS))


def parse_time(text: Column, run_ts: Column) -> Column:
    """first 19 characters as a timestamp, the run time when they are none."""
    return F.coalesce(F.try_to_timestamp(F.left(text, F.lit(19)), F.lit("yyyy-MM-dd HH:mm:ss")), run_ts)


def decode_tags(text: Column) -> Column:
    """JSON array of tags; other text is one tag, blank text is none."""
    parsed = F.from_json(text, "array<string>")
    is_array = strip(text).startswith("[") & parsed.isNotNull()
    return (F.when(F.coalesce(text, F.lit("")) == "", F.array().cast("array<string>"))
            .when(is_array, parsed).otherwise(F.array(text)))


def row_id(*key: Column) -> Column:
    """64-bit id of the natural key, the same in every run."""
    return F.xxhash64(*key)


def evidence_id(*more: str) -> Column:
    """Id of an evidence row from its identity and content, and from `more` columns that tell rows apart."""
    return row_id(*[F.col(c) for c in ("task_id", "domain", "page_url", "seq", "source_type", "raw_match", *more)])


def is_link_type(source_type: Column) -> Column:
    """Link evidence: every source type but the text ones."""
    return ~source_type.isin(*v.TEXT_SOURCE_TYPES)


def olap_link_flag(source_type: Column) -> Column:
    """the coarser flag of the columnar copy."""
    return F.coalesce(source_type.contains("link") | (source_type == "href"), F.lit(False))


def remediation_guide(source_type: Column, domain: Column) -> Column:
    """first matching kind of carrier decides."""
    st = F.lower(F.coalesce(source_type, F.lit("")))
    d = F.coalesce(domain, F.lit(""))
    return (
        F.when(st.contains("script") | st.contains("js"), fill(v.GUIDE_SCRIPT, d))
        .when(st.contains("iframe"), fill(v.GUIDE_IFRAME, d))
        .when(st.contains("img") | st.contains("image"), fill(v.GUIDE_IMAGE, d))
        .when(st.contains("href") | st.contains("a"), fill(v.GUIDE_LINK, d))
        .otherwise(fill(v.GUIDE_OTHER, d)))


def label(c: Column, labels: dict[str, str]) -> Column:
    """label of an enum value, the value itself when it has none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*labels.items())]), c), c)


def yes_no(c: Column) -> Column:
    return F.when(c, F.lit(v.YES)).otherwise(F.lit(v.NO))


def xml_escape(c: Column) -> Column:
    """F25."""
    for raw, esc in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(esc))
    return c


def average_speed(pages: Column, started: Column, finished: Column) -> Column:
    """pages per second of a finished scan, at least half a second counted."""
    secs = F.greatest(F.lit(0.5), F.unix_micros(finished) / 1e6 - F.unix_micros(started) / 1e6)
    known = started.isNotNull() & finished.isNotNull() & (pages > 0)
    return F.when(known, F.round(pages / secs, 1)).otherwise(F.lit(0.0))


def progress_percent(crawled: Column, total: Column, status: Column) -> Column:
    """0..100; with nothing planned a completed scan counts as 100."""
    pct = F.least(F.lit(100), F.floor(100.0 * crawled / F.nullif(total, F.lit(0)) + 0.5).cast("int"))
    return F.when(total == 0, F.when(status == "completed", 100).otherwise(0)).otherwise(pct)


VERDICT_SCHEMA = "total_pages INT, cleared_count INT, still_present_count INT, summary STRING"


def verify_progress(detail: Column) -> Column:
    """struct of the counts in a verdict text and 'cleared/total' progress."""
    d = F.from_json(detail, VERDICT_SCHEMA)
    total = F.coalesce(d["total_pages"], F.lit(0))
    cleared = F.coalesce(d["cleared_count"], F.lit(0))
    return F.struct(
        total.alias("total_pages"), cleared.alias("cleared_count"),
        F.coalesce(d["still_present_count"], F.lit(0)).alias("still_present_count"),
        F.coalesce(d["summary"], F.lit("")).alias("verify_summary"),
        F.when(total > 0, F.concat_ws("/", cleared.cast("string"), total.cast("string"))).otherwise(F.lit(""))
        .alias("verify_progress"))


def share_of_total(n: Column, total: Column) -> Column:
    """percentage with one decimal, 0 without a base."""
    return F.when((F.coalesce(total, F.lit(0)) == 0) | (F.coalesce(n, F.lit(0)) == 0), F.lit(0.0)).otherwise(
        F.round(100.0 * n / F.nullif(total, F.lit(0)), 1))


def share_of_top(n: Column, top: Column) -> Column:
    """whole percentage of the largest value, at most 100."""
    base = F.when(F.coalesce(top, F.lit(0)) == 0, F.lit(1)).otherwise(top)
    return F.least(F.lit(100), F.floor(100.0 * n / base + 0.5).cast("int"))


def preset_level(tag: Column) -> Column:
    """default level of a preset tag, null for other tags."""
    return F.try_element_at(F.create_map(*[F.lit(x) for _, t, lv in v.PRESET_TAGS for x in (t, lv)]), tag)


def log_level(c: Column) -> Column:
    """F33."""
    return F.upper(F.coalesce(c, F.lit("INFO")))


def page_state(status: Column, body: Column) -> Column:
    """page_removed / error by status code, null when the content has to be looked at."""
    return (
        F.when(status.isin(404, 410), F.lit("page_removed"))
        .when((status >= 400) & body.contains("404"), F.lit("page_removed"))
        .when(status >= 500, F.lit("error")))
