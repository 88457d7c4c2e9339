"""Threat rules, allow-list and retests (J6, J7, W5, RISK1-RISK4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linklens import fixed_values as v
from linklens.functions import domains as D
from linklens.functions import text as T
from linklens.functions import urls as U
from linklens.operators import joins as J
from linklens.operators import rollup as R
from linklens.session import checkpointed

RULE_FIELDS = ["id", "domain", "match_type", "risk_level", "category", "tags", "remark"]


def match_rules(names: DataFrame, rules: DataFrame) -> DataFrame:
    """The rule of each distinct (domain, root_domain): equal name first, then roots, lowest id wins.

    `names` are made distinct before matching, so a domain known to a thousand
    scans is matched once.  The closing aggregate keeps the partitioning of the
    distinct step.
    """
    targets = rules.select(D.rule_target(F.col("domain")).alias("target"), F.struct(*RULE_FIELDS).alias("rule"))
    pairs = J.suffix_matches(names.select("domain", "root_domain").distinct(), targets)
    same = F.lower("domain") == F.col("target")
    wide = F.col("rule.match_type").isin("root", "wildcard")
    found = pairs.where(same | wide).withColumn("order", F.struct(F.when(same, 1).otherwise(2), F.col("rule.id")))
    return found.groupBy("domain", "root_domain").agg(F.min_by("rule", "order").alias("rule"))


def rule_verdict(rule: Column) -> Column:
    """RISK1 for one row (domain, root_domain): rule, else allow-list, else pending."""
    tags = F.coalesce(rule["tags"], F.array().cast("array<string>"))
    category = F.coalesce(rule["category"], F.lit(""))
    tags = F.when((category != "") & ~F.array_contains(tags, category), F.array_prepend(tags, category)).otherwise(tags)
    remark = F.coalesce(F.nullif(rule["remark"], F.lit("")), F.concat(F.lit(v.REMARK_RULE_HIT), rule["domain"]))

    def verdict(level, t, r, source):
        return F.struct(level.alias("risk_level"), t.alias("risk_tags"), r.alias("risk_remark"), F.lit(source).alias("risk_source"))
    return (
        F.when(rule.isNotNull(), verdict(F.coalesce(rule["risk_level"], F.lit("high")), tags, remark, "intel_rule"))
        .when(D.is_allow_listed("domain", "root_domain"),
              verdict(F.lit("safe"), F.array(F.lit(v.TAG_SAFE)), F.lit(v.REMARK_SAFE), "builtin_rule"))
        .otherwise(verdict(F.lit("pending"), F.array().cast("array<string>"), F.lit(""), "pending")))


VERDICT = ("risk_level", "risk_tags", "risk_remark", "risk_source")


def evaluate(domains: DataFrame, rules: DataFrame) -> DataFrame:
    """RISK1 for a stored table: `domains` with the four risk columns set for every row.

    The distinct names, a small part of the table, are matched and joined back;
    only name columns are read for that.
    """
    rest = [c for c in domains.columns if c not in VERDICT]
    out = domains.select(*rest).join(match_rules(domains, rules), ["domain", "root_domain"], "left")
    return out.withColumn("v", rule_verdict(F.col("rule"))).select(*rest, "v.*")


def evaluate_rollup(domains: DataFrame, rules: DataFrame) -> DataFrame:
    """RISK1 for a roll-up that is still to be computed.

    It is checkpointed, so that what it is made from is read once, and then evaluated
    as a stored table: only matching names meet the rules, and rows are joined back by
    name, not put together again from all of their columns.
    """
    return evaluate(checkpointed(domains), rules)


def allow_listed(domains: DataFrame) -> DataFrame:
    """Rows under an allow-listed name."""
    return domains.where(D.is_allow_listed("domain", "root_domain"))


def retest_pages(tickets: DataFrame, responses: DataFrame, run_ts: Column) -> DataFrame:
    """RISK2: verdict of every ticket whose page has a fresh response.

    `responses`: url, status_code, body, error.  The join key is the page; the
    body is looked at and dropped in the same stage.
    """
    fresh = responses.select(F.col("url").alias("page_url"), "status_code", F.coalesce("body", F.lit("")).alias("body"),
                             F.coalesce("error", F.lit("")).alias("error"))
    c = F.col
    df = tickets.select("id", "task_id", "domain", "page_url", "raw_match").join(fresh, "page_url")
    df = (df.withColumn("target", F.lower(D.strip(c("domain"))))
          .withColumn("raw", F.lower(D.strip(F.coalesce("raw_match", F.lit("")))))
          .withColumn("low", F.lower("body"))
          .withColumn("found", c("low").contains(c("target")) | ((F.length("raw") > 6) & c("low").contains(c("raw"))))
          .withColumn("state", T.page_state(c("status_code"), c("body"))))
    failed = c("error") != ""
    status = (
        F.when(failed, F.when(c("error") == v.ERROR_CONNECT, "page_removed").otherwise("error"))
        .when(c("state").isNotNull(), c("state")).when(c("found"), "verified_failed").otherwise("verified_clean"))
    code = c("status_code")
    detail = (
        F.when(c("error") == v.ERROR_TIMEOUT, F.lit(v.PAGE_TIMEOUT))
        .when(c("error") == v.ERROR_CONNECT, T.fill(v.PAGE_UNREACHABLE, F.lit("ConnectError")))
        .when(failed, T.fill(v.PAGE_OTHER_ERROR, F.left("error", F.lit(120))))
        .when(code.isin(404, 410), T.fill(v.PAGE_GONE, code))
        .when(c("state") == "page_removed", T.fill(v.PAGE_GONE_BODY, code))
        .when(c("state") == "error", T.fill(v.PAGE_SERVER_ERROR, code))
        .when(c("found"), T.fill(v.PAGE_STILL_THERE, code, c("target")))
        .otherwise(T.fill(v.PAGE_CLEARED, code, c("target"))))
    seen = ~failed & c("state").isNull()
    around = F.coalesce(F.nullif(T.context_around(c("body"), c("target")), F.lit("")), T.context_around(c("body"), c("raw")))
    return df.select(
        "id", "task_id", "domain", "page_url", status.alias("verify_status"), detail.alias("verify_detail"),
        F.when(seen & c("found"), around).alias("context_snippet"),
        F.when(seen, T.html_title(c("body"))).alias("page_title"), run_ts.alias("verify_time"))


def retest_page_results(urls: DataFrame, responses: DataFrame, max_urls: int | None = None) -> DataFrame:
    """Per (task, domain, url): is the domain still in the page?  `found` is null when the page could not be read.

    `max_urls` is the optional limit of the quick batch form, ranked per domain.
    """
    distinct = urls.where(F.coalesce(D.strip(F.col("page_url")), F.lit("")) != "").select("task_id", "domain", "page_url").distinct()
    if max_urls is not None:
        w = Window.partitionBy("task_id", "domain").orderBy("page_url")
        distinct = distinct.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_urls).drop("rank")
    fresh = responses.select("url", "status_code", F.coalesce("body", F.lit("")).alias("body"), F.coalesce("error", F.lit("")).alias("error"))
    df = distinct.withColumn("url", U.request_url(F.col("page_url"))).join(fresh, "url", "left")
    c, code = F.col, F.col("status_code")
    failed = code.isNull() | (c("error") != "")
    gone = code.isin(404, 410)
    found = F.lower("body").contains(F.lower("domain"))
    status = (F.when(failed, "error").when(gone, "page_removed").when(found, "domain_still_present").otherwise("domain_cleared"))
    snippet = (
        F.when(c("error") == v.ERROR_TIMEOUT, F.lit(v.DOMAIN_PAGE_TIMEOUT))
        .when(failed, T.fill(v.DOMAIN_PAGE_ERROR, F.left(F.coalesce("error", F.lit("")), F.lit(150))))
        .when(gone, T.fill(v.DOMAIN_PAGE_GONE, code))
        .when(found, T.verdict_snippet(c("body"), c("domain")))
        .otherwise(T.fill(v.DOMAIN_PAGE_CLEARED, code)))
    return df.select("task_id", "domain", "url", F.coalesce(code, F.lit(0)).alias("status_code"), status.alias("status"),
                     F.when(~failed, ~gone & found).alias("found"), snippet.alias("snippet"))


def retest_domains(urls: DataFrame, responses: DataFrame, max_urls: int | None = None) -> DataFrame:
    """RISK3: verdict per scan and domain."""
    return R.domain_verdicts(retest_page_results(urls, responses, max_urls), "task_id", "domain")


def verdict_details(results: DataFrame, n: int = 200) -> DataFrame:
    """The listed page results of each verdict: the first n by url, ranked below the exchange."""
    w = Window.partitionBy("task_id", "domain").orderBy("url")
    top = results.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return top.groupBy("task_id", "domain").agg(F.array_sort(F.collect_list(
        F.struct("url", "status_code", "status", "found", "snippet"))).alias("details"))


def retest_domain_over_tasks(urls: DataFrame, responses: DataFrame, max_urls: int | None = None) -> DataFrame:
    """RISK4: one status per domain over all its scans."""
    return R.overall_status(retest_domains(urls, responses, max_urls), "domain")
