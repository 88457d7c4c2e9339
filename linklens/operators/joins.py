"""Join patterns.

No join carries a broadcast hint: rule, task and suffix tables are broadcast by
Spark itself while their size statistics stay under the session's threshold and
are shuffled beyond it.  Suffix (`LIKE '%.d'`) matches become equi joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linklens.fixed_values import RISKY_LEVELS
from linklens.functions import domains as D
from linklens.operators import rollup as R


#: Words of the filter of rule names: 2**18 rows of 64 bits, about 10 MB at most however many rules there are.
FILTER_WORDS = 1 << 18


def rule_suffixes(names: DataFrame, rules: DataFrame, domain: str = "domain", root: str = "root_domain", key: str = "target") -> DataFrame:
    """The names under those of their parents (and their root) at which a rule may stand, as column `__parent`.

    The names where rules stand are the nodes of a tree of reversed labels.  They are
    kept as bits of a table of fixed size that goes to every task, so a parent without
    a rule, such as a top-level label that half of all names share, drops out where the
    names are exploded and is never a join key.  A bit set by another name lets a parent
    pass in vain; the join that follows is exact.
    """
    word, bit = (lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_WORDS))), (lambda c: F.pmod(F.xxhash64(F.lit(1), c), F.lit(64)).cast("int"))
    bits = rules.select(word(F.col(key)).alias("__word"), F.expr("1L").alias("__one"), bit(F.col(key)).alias("__bit"))
    bits = bits.groupBy("__word").agg(F.bit_or(F.call_function("shiftleft", "__one", "__bit")).alias("__bits"))
    parents = F.array_distinct(F.array_append(D.parent_names(F.lower(F.col(domain))), F.lower(F.col(root))))
    exploded = names.withColumn("__parent", F.explode_outer(parents)).withColumn("__word", word(F.col("__parent")))
    kept = exploded.join(F.broadcast(bits), "__word").where(F.getbit("__bits", bit(F.col("__parent"))) == 1)  # of fixed size
    return kept.select(*names.columns, "__parent")


def suffix_matches(names: DataFrame, rules: DataFrame, domain: str = "domain", root: str = "root_domain",
                   key: str = "target") -> DataFrame:
    """Every (name, rule) pair where the rule equals the name, its root or a parent of it.

    An equi join on those parents alone at which a rule stands.
    """
    return rule_suffixes(names, rules, domain, root, key).join(rules, F.col("__parent") == rules[key]).drop("__parent")


def with_asset_evidence(domains: DataFrame, occurrences: DataFrame) -> DataFrame:
    """Domains seen on scripts or style sheets, by sample page or by evidence."""
    on_asset = (F.col("source_type").like(r"%\_file\_%") | F.col("page_url").like("%.js%") | F.col("page_url").like("%.css%"))
    evidence = occurrences.where(on_asset).select("task_id", "domain").distinct().withColumn("__asset", F.lit(True))
    s = F.col("sample_page_url")
    sample = s.like("%.js") | s.like("%.js?%") | s.like("%.css") | s.like("%.css?%")
    return domains.join(evidence, ["task_id", "domain"], "left").where(
        sample | F.coalesce("__asset", F.lit(False))).drop("__asset")


def without_risky_domain(tickets: DataFrame, domains: DataFrame) -> DataFrame:
    """Tickets whose domain is no longer risky in their scan."""
    risky = domains.where(F.col("risk_level").isin(*RISKY_LEVELS)).select("task_id", "domain")
    return tickets.join(risky, ["task_id", "domain"], "left_anti")


def with_risky_domain(tickets: DataFrame, domains: DataFrame) -> DataFrame:
    """Tickets whose domain is still risky in their scan."""
    risky = domains.where(F.col("risk_level").isin(*RISKY_LEVELS)).select("task_id", "domain")
    return tickets.join(risky, ["task_id", "domain"], "left_semi")


def risky_evidence(occurrences: DataFrame, domains: DataFrame, tasks: DataFrame) -> DataFrame:
    """Evidence of risky domains of live scans, with the risk of the domain."""
    extra = [c for c in ("risk_tags", "risk_remark", "verify_status", "verify_time", "verify_detail") if c in domains.columns]
    risky = R.on_live_tasks(domains.where(F.col("risk_level").isin(*RISKY_LEVELS)), tasks).select(
        "task_id", "domain", F.col("root_domain").alias("risk_root"), "risk_level", *extra)
    return occurrences.join(risky, ["task_id", "domain"])


def evidence_per_task(domains: DataFrame, tasks: DataFrame, occurrences: DataFrame, per_task: int | None = 3) -> DataFrame:
    """Scans of each domain with their first pieces of evidence; scans without any keep one row."""
    rows = R.on_live_tasks(domains, tasks, "name", "target_url", "status")
    ev = occurrences.select("task_id", "domain", "page_url", "source_type", "raw_match", "context_snippet",
                            F.col("created_at").alias("evidence_at"), "seq")
    if per_task is not None:
        w = Window.partitionBy("task_id", "domain").orderBy("seq")
        ev = ev.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_task).drop("rank")
    return rows.join(ev, ["task_id", "domain"], "left")


def rule_page_counts(rules: DataFrame, root_counts: DataFrame, domain_counts: DataFrame, tickets: DataFrame,
                     domains: DataFrame) -> DataFrame:
    """Pages a rule touches: root counts, domain counts, tickets, occurrences, else 0.

    Every source is read once: a row names its root and its domain, and only names that
    are a rule's target go on.  All counts of a target meet in one aggregate and one join.
    """
    r = rules.withColumn("target", D.rule_target(F.col("domain")))
    targets = r.select("target").distinct()

    def named(df, *columns):
        names = F.explode(F.array(F.struct(F.lit("root").alias("kind"), F.col("root_domain").alias("target")), F.struct(F.lit("domain").alias("kind"), F.col("domain").alias("target"))))
        return df.select(names.alias("n"), *columns).select("n.kind", "n.target", *columns).join(targets, "target", "left_semi")

    def counts(df, source, kind, target, n):
        return df.select(F.lit(source).alias("source"), F.lit(kind).alias("kind") if kind else F.col("kind"), F.col(target).alias("target"), F.col(n).cast("long").alias("n"))
    pages = named(tickets, "page_url").distinct().groupBy("kind", "target").agg(F.count("*").alias("n"))
    found = named(domains, "occurrence_count").groupBy("kind", "target").agg(F.sum("occurrence_count").alias("n"))
    known = counts(root_counts, "pages", "root", "root_domain", "page_count").unionByName(counts(domain_counts, "pages", "domain", "domain", "page_count"))
    every = known.join(targets, "target", "left_semi").unionByName(counts(pages, "tickets", None, "target", "n")).unionByName(counts(found, "found", None, "target", "n"))
    one = lambda source, kind: F.max(F.when((F.col("source") == source) & (F.col("kind") == kind), F.col("n")))
    by_target = every.groupBy("target").agg(*[one(s, k).alias(f"{s}_{k}") for s in ("pages", "tickets", "found") for k in ("root", "domain")])
    exact, root = F.col("match_type") == "exact", F.col("match_type") == "root"
    count = F.coalesce(
        F.when(~exact, F.col("pages_root")), F.col("pages_domain"),
        F.when(root, F.col("tickets_root")).when(exact, F.col("tickets_domain")),
        F.when(root, F.col("found_root")).when(exact, F.col("found_domain")), F.lit(0))
    return r.join(by_target, "target", "left").select(*rules.columns, count.cast("long").alias("page_count"))
