"""Mutations as functions from table versions to the next version.

Each returns a DataFrame; the caller writes it as the next snapshot.  Times are
parameters.  Joins are keyed and carry no broadcast hints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linklens import fixed_values as v
from linklens.functions import domains as D
from linklens.functions import text as T
from linklens.operators import joins as J
from linklens.operators import risk
from linklens.operators import rollup as R
from linklens.session import stored

NO_TAGS = "array<string>"


def keep_last(df: DataFrame, key: list[str], *version: str) -> DataFrame:
    """Newest version of each key; all but one row per key and task drop out before the exchange."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in version])
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == 1).drop("rank")


def keep_first(df: DataFrame, key: list[str], *position: str) -> DataFrame:
    """First row of each key."""
    w = Window.partitionBy(*key).orderBy(*position)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == 1).drop("rank")


def longest_snippet(evidence: DataFrame) -> DataFrame:
    """Per scan, domain and page the evidence with the longest snippet."""
    w = Window.partitionBy("task_id", "domain", "page_url").orderBy(
        F.desc(F.length(F.coalesce("context_snippet", F.lit("")))), "seq")
    return evidence.withColumn("rank", F.row_number().over(w)).where(F.col("rank") == 1).drop("rank")


def _merged(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Full outer join with the two sides as structs `o` and `n` (null when absent)."""
    o = old.select(*key, F.struct(*old.columns).alias("o"))
    n = new.select(*key, F.struct(*new.columns).alias("n"))
    return o.join(n, key, "full_outer")


def merge_pages(old: DataFrame, new: DataFrame, *version: str) -> DataFrame:
    """M1: last write wins; id, path and depth stay those of the first write.  `new` may repeat a url."""
    key, at = ["task_id", "url"], F.struct(*(version or ["crawled_at"]))
    stay = [c for c in ("id", "path", "depth") if c in old.columns]
    rest = [c for c in old.columns if c not in (*key, *stay)]
    last = new.groupBy(*key).agg(F.min_by(F.struct(*stay), at).alias("f"), F.max_by(F.struct(*rest), at).alias("l"))
    last = last.select(*key, "f.*", "l.*").select(*old.columns)
    out = _merged(old, last, ["task_id", "url"])
    columns = [F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) if c in stay
               else F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c)
               for c in old.columns if c not in ("task_id", "url")]
    return out.select("task_id", "url", *columns).select(*old.columns)


def merge_domains(old: DataFrame, new: DataFrame) -> DataFrame:
    """M2 / M3: counts add, flags accumulate, a sample page is kept once set, all else stays from the first insert.

    `new` holds one row per key (see rollup.domain_rollup).  The rule is
    associative, so batches may be merged in any order.
    """
    key = ["task_id", "domain"]
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))
    special = {
        "occurrence_count": F.coalesce(o("occurrence_count"), F.lit(0)) + F.coalesce(n("occurrence_count"), F.lit(0)),
        "has_link": F.coalesce(o("has_link"), F.lit(False)) | F.coalesce(n("has_link"), F.lit(False)),
        "has_text": F.coalesce(o("has_text"), F.lit(False)) | F.coalesce(n("has_text"), F.lit(False)),
        "sample_page_url": F.coalesce(F.nullif(o("sample_page_url"), F.lit("")), n("sample_page_url"), o("sample_page_url")),
    }
    columns = [special[c].alias(c) if c in special else F.when(F.col("o").isNotNull(), o(c)).otherwise(n(c)).alias(c)
               for c in old.columns if c not in key]
    return _merged(old, new, key).select(*key, *columns).select(*old.columns)


def _with(df: DataFrame, cond: Column, **values) -> DataFrame:
    """Set columns where the condition holds; missing columns are left out."""
    return df.withColumns({c: F.when(F.coalesce(cond, F.lit(False)), x if isinstance(x, Column) else F.lit(x)).otherwise(F.col(c))
                           for c, x in values.items() if c in df.columns})


def tag_array(tags) -> Column:
    return F.array(*[F.lit(t) for t in tags or []]).cast(NO_TAGS)


def set_manual_risk(domains: DataFrame, task_id: int, domain: str, level: str, tags=None, remark: str = "") -> DataFrame:
    """M4."""
    hit = (F.col("task_id") == task_id) & (F.col("domain") == domain)
    return _with(domains, hit, risk_level=level, risk_tags=tag_array(tags), risk_remark=remark, risk_source="manual")


def set_manual_risks(domains: DataFrame, changes: DataFrame) -> DataFrame:
    """M5: `changes` is task_id, domain, new_level, new_tags, new_remark with one row per key."""
    out = domains.join(changes, ["task_id", "domain"], "left")
    hit = F.col("new_level").isNotNull()
    return _with(out, hit, risk_level=F.col("new_level"), risk_tags=F.col("new_tags"), risk_remark=F.col("new_remark"),
                 risk_source="manual").select(*domains.columns)


def under(domain: str, with_root: bool = True) -> Column:
    """Rows at or below a name."""
    return ((F.col("root_domain") == domain) if with_root else F.lit(False)) | (F.col("domain") == domain) | F.col("domain").endswith("." + domain)


def not_manual() -> Column:
    return F.coalesce(F.col("risk_source"), F.lit("")) != "manual"


def propagate_rule(domains: DataFrame, target: str, match_type: str, level: str, tags=None) -> DataFrame:
    """M6: rows of all scans that nobody judged by hand inherit a new global rule."""
    hit = (under(target) if match_type == "root" else F.col("domain") == target) & not_manual()
    return _with(domains, hit, risk_level=level, risk_tags=tag_array(tags), risk_remark=v.REMARK_RULE_INHERITED + target,
                 risk_source="intel_rule")


def upsert_rules(rules: DataFrame, new: DataFrame, run_ts: Column) -> DataFrame:
    """M7: by clean domain; id, source and creation time of a known rule stay.  One row per domain in `new`."""
    fresh = new.withColumn("domain", D.rule_target(F.col("domain")))
    for c in ("created_at", "updated_at"):
        if c in rules.columns:
            fresh = fresh.withColumn(c, run_ts)
    stay = ("id", "source", "created_at")
    columns = [F.when(F.col("n").isNull() | (F.col("o").isNotNull() & F.lit(c in stay)), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
               for c in rules.columns if c != "domain"]
    return _merged(rules, fresh.select(*rules.columns), ["domain"]).select("domain", *columns).select(*rules.columns)


def import_rules(rules: DataFrame, lines: DataFrame, run_ts: Column) -> DataFrame:
    """M8: batch import (see sources.ingest.parse_rules); the last line of a domain wins."""
    last = keep_last(lines, ["domain"], "line_no")
    return upsert_rules(rules, last.withColumnRenamed("line_no", "id"), run_ts)


def _rule_effects(names: DataFrame, rules: DataFrame) -> DataFrame:
    """Last matching rule (highest id) of each distinct name, and whether any matching rule is harmless."""
    r = rules.withColumn("target", D.rule_target(F.col("domain"))).where(F.col("target") != "")
    remark = F.coalesce(F.nullif("remark", F.lit("")), F.concat(F.lit(v.REMARK_RULE_HIT), F.col("target")))
    r = r.select("target", "match_type", F.struct(F.col("id"), F.col("risk_level"), F.col("tags"), remark.alias("remark")).alias("rule"))
    pairs = J.suffix_matches(names.select("domain", "root_domain").distinct(), r)
    pairs = pairs.where((F.col("match_type") == "root") | (F.col("domain") == F.col("target")))
    return pairs.groupBy("domain", "root_domain").agg(
        F.max_by("rule", F.col("rule.id")).alias("rule"), F.bool_or(F.col("rule.risk_level").isin("safe", "pending")).alias("harmless"))


def sync_rules(domains: DataFrame, tickets: DataFrame, rules: DataFrame, full_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """M9: apply rules to everything stored; returns the next domains and tickets.

    Set-based: where several rules match, the last one by id wins; a ticket goes
    when any matching rule is harmless.  A full run leaves manual rows alone and
    drops tickets of domains that are no longer risky; a run over a few rules
    (pass only those) does neither.
    """
    effects = _rule_effects(domains.select("domain", "root_domain").unionByName(tickets.select("domain", "root_domain")), rules)
    d = domains.join(effects, ["domain", "root_domain"], "left")
    hit = F.col("rule").isNotNull() & (not_manual() if full_run else F.lit(True))
    d = _with(d, hit, risk_level=F.col("rule.risk_level"), risk_tags=F.coalesce("rule.tags", F.array().cast(NO_TAGS)),
              risk_remark=F.col("rule.remark"), risk_source="intel_rule").select(*domains.columns)
    t = tickets.join(effects, ["domain", "root_domain"], "left").where(~F.coalesce("harmless", F.lit(False)))
    t = _with(t, F.col("rule").isNotNull(), risk_level=F.col("rule.risk_level"), risk_tags=F.coalesce("rule.tags", F.array().cast(NO_TAGS)),
              risk_remark=F.col("rule.remark")).select(*tickets.columns)
    return d, (J.with_risky_domain(t, d).select(*tickets.columns) if full_run else t)


def sync_rules_and_tickets(domains: DataFrame, tickets: DataFrame, rules: DataFrame, occurrences: DataFrame, tasks: DataFrame, run_ts: Column,
                           full_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """M9 whole: as sync_rules, and if one of the rules is risky the evidence of risky domains becomes tickets.

    A run over a few rules makes tickets of the domains and roots named by these only.
    """
    d, t = sync_rules(domains, tickets, rules, full_run)
    if rules.where(F.col("risk_level").isin(*v.RISKY_LEVELS)).isEmpty():
        return d, t
    named = d
    if not full_run:
        targets = rules.select(D.rule_target(F.col("domain")).alias("target")).where("target <> ''").distinct()
        by = lambda c: d.select("domain", "root_domain").distinct().join(targets, F.col(c) == F.col("target"), "left_semi")
        named = d.join(by("domain").unionByName(by("root_domain")).distinct(), ["domain", "root_domain"], "left_semi")
    return d, merge_tickets(t, stored(ticket_batch(t.schema, occurrences, named, tasks, run_ts), "batch"))


def delete_rule(domains: DataFrame, tickets: DataFrame, rules: DataFrame, rule_id: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop a rule and revert or re-point what it had set; returns rules, domains, tickets.

    The deleted rule and its replacement are two single rows looked up on the driver.
    Kept as it is: names only below the rule are not re-pointed when another
    rule takes over, and allow-listed names become pending.
    """
    gone = rules.where(F.col("id") == rule_id).select(D.rule_target(F.col("domain")).alias("d"), "match_type").first()
    if gone is None:
        return rules, domains, tickets
    remaining = rules.where(F.col("id") != rule_id)
    name, by_root = gone["d"], gone["match_type"] == "root"
    spark = rules.sparkSession
    one = spark.range(1).select(F.lit(name).alias("domain"), F.lit(name).alias("root_domain"))
    then = risk.evaluate(one, remaining).first()
    from_rule = F.coalesce("risk_source", F.lit("")).isin("intel_rule", "")
    if then["risk_level"] not in v.RISKY_LEVELS:
        touched = under(name) if by_root else F.col("domain") == name
        d = _with(domains, touched & from_rule, risk_level="pending", risk_tags=tag_array([]), risk_remark="", risk_source="",
                  verify_status="unverified", verify_time=F.lit(None), verify_detail="")
        kept = tickets.where(~touched)
        still = J.with_risky_domain(tickets.where(touched), d)
        return remaining, d, kept.unionByName(still.select(*tickets.columns))
    touched = ((F.col("root_domain") == name) | (F.col("domain") == name)) if by_root else F.col("domain") == name
    values = dict(risk_level=then["risk_level"], risk_tags=tag_array(then["risk_tags"]), risk_remark=then["risk_remark"])
    return remaining, _with(domains, touched & from_rule, **values, risk_source="intel_rule"), _with(tickets, touched, **values)


def reevaluate(domains: DataFrame, rules: DataFrame, task_id: int | None = None) -> DataFrame:
    """RISK1 for all rows not judged by hand, of one scan or of all."""
    fields = [c for c in ("risk_level", "risk_tags", "risk_remark", "risk_source") if c in domains.columns]
    fresh = risk.evaluate(domains.withColumn("__old", F.struct(*fields)), rules)
    hit = F.coalesce(F.col("__old.risk_source"), F.lit("")) != "manual"
    if task_id is not None:
        hit = hit & (F.col("task_id") == task_id)
    rest = [c for c in domains.columns if c not in fields]
    return fresh.select(*rest, *[F.when(hit, F.col(c)).otherwise(F.col(f"__old.{c}")).alias(c) for c in fields]).select(*domains.columns)


def evidence_tickets(occurrences: DataFrame, domains: DataFrame, tasks: DataFrame) -> DataFrame:
    """J2 + W2: one candidate ticket per scan, risky domain and page."""
    return longest_snippet(J.risky_evidence(occurrences, domains, tasks))


def ticket_batch(schema, occurrences: DataFrame, domains: DataFrame, tasks: DataFrame, run_ts: Column) -> DataFrame:
    """M12, first half: the candidate tickets in the columns of the stored ones (`schema` of these)."""
    fresh = evidence_tickets(occurrences, domains, tasks)
    values = {
        "id": T.row_id(F.col("task_id"), F.col("domain"), F.col("page_url")), "root_domain": F.col("risk_root"), "page_title": F.lit(""),
        "source_type": F.coalesce("source_type", F.lit("href")), "raw_match": F.coalesce("raw_match", F.lit("")),
        "context_snippet": F.coalesce("context_snippet", F.lit("")), "manual_status": F.lit("pending"), "manual_remark": F.lit(""),
        "last_verified_at": F.col("verify_time") if "verify_time" in domains.columns else F.lit(None),
        "last_verify_detail": F.coalesce("verify_detail", F.lit("")) if "verify_detail" in domains.columns else F.lit(""),
        "created_at": F.coalesce("created_at", run_ts), "updated_at": run_ts}
    return fresh.select(*[F.col(f.name).cast(f.dataType) if f.name in TICKET_KEY else
                          values.get(f.name, F.col(f.name) if f.name in fresh.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


TICKET_KEY = ["task_id", "domain", "page_url"]


def merge_tickets(tickets: DataFrame, fresh: DataFrame) -> DataFrame:
    """M12, second half: known tickets take over the risk, and snippet or title only if they lacked one."""
    o, n = (lambda c: F.col(f"o.{c}")), (lambda c: F.col(f"n.{c}"))

    def column(c):
        if c in ("risk_level", "risk_tags", "risk_remark", "updated_at"):
            kept = F.when(F.col("n").isNotNull(), n(c)).otherwise(o(c))
        elif c == "context_snippet":
            kept = F.when(F.col("n").isNotNull() & (F.length(o(c)) < 10), n(c)).otherwise(o(c))
        elif c == "page_title":
            kept = F.when(F.col("n").isNotNull() & (o(c) == ""), n(c)).otherwise(o(c))
        else:
            kept = o(c)
        return F.when(F.col("o").isNull(), n(c)).otherwise(kept).alias(c)
    return _merged(tickets, fresh, TICKET_KEY).select(*TICKET_KEY, *[column(c) for c in tickets.columns if c not in TICKET_KEY]).select(*tickets.columns)


def sync_tickets(tickets: DataFrame, occurrences: DataFrame, domains: DataFrame, tasks: DataFrame, run_ts: Column) -> DataFrame:
    """New tickets start pending; known ones take over the risk, and snippet or title only if they lacked one.

    The batch is stored, so that what was shuffled to find it, all evidence, is gone before the tickets are.
    """
    return merge_tickets(tickets, stored(ticket_batch(tickets.schema, occurrences, domains, tasks, run_ts), "batch"))


def _ticket_transition(status: Column, cleared_remark: str) -> tuple[Column, Column]:
    """Manual status and remark after a verdict: cleared resolves, reappeared reopens."""
    ms, mr = F.col("manual_status"), F.col("manual_remark")
    cleared, failed = status.isin(*v.CLOSED_STATES), status == "verified_failed"
    replaceable = (F.coalesce(mr, F.lit("")) == "") | mr.contains(v.REMARK_REOPENED_MARK)
    new_status = (F.when(cleared & (ms != "ignored"), "resolved").when(failed & (ms == "resolved"), "pending").otherwise(ms))
    new_remark = (F.when(cleared & (ms != "ignored") & replaceable, cleared_remark)
                  .when(failed & (ms == "resolved"), v.REMARK_REAPPEARED).otherwise(mr))
    return new_status, new_remark


def apply_page_verdicts(tickets: DataFrame, verdicts: DataFrame, run_ts: Column) -> DataFrame:
    """`verdicts` as risk.retest_pages gives them, one per ticket."""
    key = ["task_id", "domain", "page_url"]
    vd = verdicts.select(*key, F.struct("verify_status", "verify_detail", "context_snippet", "verify_time").alias("vd"))
    out = tickets.join(vd, key, "left")
    ms, mr = _ticket_transition(F.col("vd.verify_status"), v.REMARK_PAGE_CLEARED)
    return _with(out, F.col("vd").isNotNull(), manual_status=ms, manual_remark=mr, verify_status=F.col("vd.verify_status"),
                 last_verified_at=F.col("vd.verify_time"), last_verify_detail=F.col("vd.verify_detail"),
                 context_snippet=F.coalesce(F.nullif("vd.context_snippet", F.lit("")), F.col("context_snippet")),
                 updated_at=run_ts).select(*tickets.columns)


def close_domains(domains: DataFrame, tickets: DataFrame, verdicts: DataFrame) -> DataFrame:
    """After page verdicts, `tickets` being the updated ones: reopen on a failure, close when nothing is left open."""
    touched = verdicts.groupBy("task_id", "domain").agg(
        F.max_by(F.struct("verify_time", "verify_detail"), F.when(F.col("verify_status") == "verified_failed", F.col("id"))).alias("failure"),
        F.bool_or(F.col("verify_status") == "verified_failed").alias("failed"),
        F.bool_or(F.col("verify_status").isin(*v.CLOSED_STATES)).alias("cleared"), F.max("verify_time").alias("cleared_at"))
    state = touched.join(R.unresolved_pages(tickets), ["task_id", "domain"], "left")
    out = domains.join(state, ["task_id", "domain"], "left")
    out = _with(out, F.col("failed"), verify_status="verified_failed", verify_time=F.col("failure.verify_time"),
                verify_detail=F.col("failure.verify_detail"))
    closed = ~F.col("failed") & F.col("cleared") & (F.col("remaining") == 0)
    return _with(out, closed, verify_status="verified_clean", verify_time=F.col("cleared_at"),
                 verify_detail=v.DETAIL_ALL_CLEARED).select(*domains.columns)


def apply_domain_verdicts(domains: DataFrame, tickets: DataFrame, verdicts: DataFrame, results: DataFrame,
                          run_ts: Column) -> tuple[DataFrame, DataFrame]:
    """A domain verdict with its page results to the domain row and to its tickets.

    A clean verdict closes all tickets of the domain; otherwise each listed page
    decides its own ticket; without listed pages the verdict itself does.
    """
    vd = verdicts.select("task_id", "domain", F.col("verify_status").alias("v_status"), F.col("tested_count").alias("v_tested"), F.to_json(F.struct(
        "verify_status", "summary", "tested_count", F.col("tested_count").alias("total_pages"), "still_present_count",
        "cleared_count", "error_count")).alias("v_detail"))
    known = F.col("v_status").isNotNull()
    d = _with(domains.join(vd, ["task_id", "domain"], "left"), known, verify_status=F.col("v_status"), verify_time=run_ts,
              verify_detail=F.col("v_detail")).select(*domains.columns)
    per_page = results.select("task_id", "domain", F.col("url").alias("page_url"), F.lit(True).alias("p_tested"),
                              F.when(~F.col("found"), "verified_clean").when(F.col("found"), "verified_failed").otherwise("error").alias("p_status"),
                              F.to_json(F.struct("url", "status_code", "status", "found", "snippet")).alias("p_detail"))
    t = tickets.join(vd, ["task_id", "domain"], "left").join(per_page, ["task_id", "domain", "page_url"], "left")
    whole = (F.col("v_status") == "verified_clean") | (F.col("v_tested") == 0)
    status = F.when(whole, F.col("v_status")).otherwise(F.col("p_status"))
    ms, mr = _ticket_transition(status, v.REMARK_DOMAIN_CLEARED)
    mr = F.when(F.col("v_tested") == 0, F.col("manual_remark")).otherwise(mr)
    return d, _with(t, known & status.isNotNull(), manual_status=ms, manual_remark=mr, verify_status=status, last_verified_at=run_ts,
                    last_verify_detail=F.when(whole, F.col("v_detail")).otherwise(F.col("p_detail")),
                    updated_at=run_ts).select(*tickets.columns)


def mark_rollbacks(tickets: DataFrame, domains: DataFrame, verdicts: DataFrame, run_ts: Column) -> tuple[DataFrame, DataFrame]:
    """Closed tickets that show the domain again are reopened together with their domain."""
    failed = verdicts.where(F.col("verify_status") == "verified_failed").withColumn(
        "verify_detail", F.concat(F.lit(v.DETAIL_ROLLBACK), F.col("verify_detail")))
    key = ["task_id", "domain", "page_url"]
    vd = failed.select(*key, F.struct("verify_time", "verify_detail", "context_snippet").alias("vd"))
    t = _with(tickets.join(vd, key, "left"), F.col("vd").isNotNull(), verify_status="verified_failed", manual_status="pending",
              manual_remark=v.REMARK_ROLLBACK, last_verified_at=F.col("vd.verify_time"), last_verify_detail=F.col("vd.verify_detail"),
              context_snippet=F.coalesce("vd.context_snippet", "context_snippet"), updated_at=run_ts).select(*tickets.columns)
    dom = failed.groupBy("task_id", "domain").agg(F.max_by(F.struct("verify_time", "verify_detail"), "id").alias("vd"))
    d = _with(domains.join(dom, ["task_id", "domain"], "left"), F.col("vd").isNotNull(), verify_status="verified_failed",
              verify_time=F.col("vd.verify_time"), verify_detail=F.col("vd.verify_detail")).select(*domains.columns)
    return t, d


def reconcile_tickets(tickets: DataFrame, run_ts: Column) -> DataFrame:
    """Verdicts and manual states brought in line; a second run changes nothing."""
    cleared = F.col("verify_status").isin(*v.CLOSED_STATES) & ~F.col("manual_status").isin("resolved", "ignored")
    again = (F.col("verify_status") == "verified_failed") & (F.col("manual_status") == "resolved")
    values = {
        "manual_remark": F.when(cleared, F.coalesce(F.nullif("manual_remark", F.lit("")), F.lit(v.REMARK_PAGE_CLEARED)))
        .when(again, v.REMARK_REAPPEARED).otherwise(F.col("manual_remark")),
        "manual_status": F.when(cleared, "resolved").when(again, "pending").otherwise(F.col("manual_status"))}
    if "updated_at" in tickets.columns:
        values["updated_at"] = F.when(cleared | again, run_ts).otherwise(F.col("updated_at"))
    return tickets.withColumns(values)


def reconcile_counts(tickets: DataFrame) -> DataFrame:
    """How many tickets a reconcile resolves and reopens."""
    return tickets.agg(
        F.count_if(F.col("verify_status").isin(*v.CLOSED_STATES) & ~F.col("manual_status").isin("resolved", "ignored")).alias("auto_resolved"),
        F.count_if((F.col("verify_status") == "verified_failed") & (F.col("manual_status") == "resolved")).alias("reopened"))


def set_ticket_status(tickets: DataFrame, ids: DataFrame, status: str, remark: str | None, run_ts: Column) -> DataFrame:
    """`ids` has one column id."""
    out = tickets.join(ids.select("id").distinct().withColumn("__hit", F.lit(True)), "id", "left")
    values = {"manual_status": status, "updated_at": run_ts}
    if remark is not None:
        values["manual_remark"] = remark
    return _with(out, F.col("__hit"), **values).select(*tickets.columns)


def purge_invalid(domains: DataFrame, occurrences: DataFrame, task_id: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Drop names that are no domains with their evidence; also what went per scan."""
    scoped = F.lit(True) if task_id is None else F.col("task_id") == task_id
    bad = scoped & ~D.is_public_domain("domain", False)
    dropped = domains.where(bad).select("task_id", "domain").distinct()
    kept = domains.where(~bad)
    evidence = occurrences.join(dropped, ["task_id", "domain"], "left_anti").select(*occurrences.columns)
    gone = dropped.groupBy("task_id").agg(F.count("*").alias("deleted_domains_count"))
    gone_evidence = (occurrences.groupBy("task_id", "domain").agg(F.count("*").alias("n")).join(dropped, ["task_id", "domain"])
                     .groupBy("task_id").agg(F.sum("n").alias("deleted_occurrences_count")))
    left = kept.groupBy("task_id").agg(F.count("*").alias("remaining_domains_count"))
    summary = gone.join(gone_evidence, "task_id", "left").join(left, "task_id", "left").na.fill(0)
    return kept, evidence, summary


def purge_tasks(table: DataFrame, tasks: DataFrame) -> DataFrame:
    """Rows of a child table without those of scans to delete (all child tables alike)."""
    return table.join(tasks.select("task_id"), "task_id", "left_anti").select(*table.columns)


COUNTERS = ("pages_crawled", "pages_total", "external_domains_count", "subdomains_count")


def reset_task(tasks: DataFrame, task_id: int) -> DataFrame:
    """Back to pending with zero counters (children: purge_tasks)."""
    return _with(tasks, F.col("task_id") == task_id, status="pending", **{c: 0 for c in COUNTERS}, current_url="",
                 started_at=F.lit(None), finished_at=F.lit(None), error_message=F.lit(None))


def change_status(tasks: DataFrame, changes: DataFrame, run_ts: Column) -> DataFrame:
    """`changes` is task_id, new_status, new_error."""
    out = tasks.join(changes, "task_id", "left")
    s, end = F.col("new_status"), F.col("new_status").isin("completed", "failed", "stopped")
    run = s == "running"
    values = {
        "started_at": F.when(run, F.coalesce("started_at", run_ts)).otherwise(F.col("started_at")),
        "finished_at": F.when(end, run_ts).otherwise(F.col("finished_at")),
        "error_message": F.when(run, F.lit(None)).when(end, F.coalesce("new_error", "error_message")).otherwise(F.col("error_message")),
        "status": F.coalesce(s, F.col("status"))}
    return out.withColumns({c: x for c, x in values.items() if c in tasks.columns}).select(*tasks.columns)


def soft_delete(tasks: DataFrame, ids: DataFrame) -> DataFrame:
    """M23."""
    out = tasks.join(ids.select("task_id").distinct().withColumn("__hit", F.lit(True)), "task_id", "left")
    return _with(out, F.col("__hit"), status="deleting").select(*tasks.columns)


def expire_logs(logs: DataFrame, run_ts: Column, days: int = v.LOG_TTL_DAYS) -> DataFrame:
    """A filter on the partition time."""
    return logs.where(F.col("created_at") >= run_ts - F.expr(f"INTERVAL {days} DAYS"))


def write_progress(tasks: DataFrame, progress: DataFrame) -> DataFrame:
    """Counters of a scan; null counters keep the stored value."""
    cols = [c for c in progress.columns if c != "task_id"]
    out = tasks.join(progress.select("task_id", *[F.col(c).alias(f"__{c}") for c in cols]), "task_id", "left")
    return out.withColumns({c: F.coalesce(F.col(f"__{c}"), F.col(c)) for c in cols}).select(*tasks.columns)


def refresh_page_counts(occurrences: DataFrame, root_path: str, domain_path: str) -> None:
    """Rewrite both page-count tables."""
    R.root_page_counts(occurrences).write.mode("overwrite").parquet(root_path)
    R.domain_page_counts(occurrences).write.mode("overwrite").parquet(domain_path)
