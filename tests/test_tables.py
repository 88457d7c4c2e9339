"""Invariants of merges, rules, tickets, walks, numbering, streams and round trips."""

import collections
import os

import pytest
from pyspark.sql import functions as F

from linklens import fixed_values as v
from linklens.operators import extract as X
from linklens.operators import graph as G
from linklens.operators import joins as J_
from linklens.operators import merge as M
from linklens.operators import risk as K
from linklens.operators import rollup as R
from linklens.session import numbered
from linklens.sources import export as E
from linklens.sources import ingest as I
from linklens.sources import responses as S
from linklens.streaming import jobs as J

DOMAINS = "task_id INT, domain STRING, root_domain STRING, occurrence_count BIGINT, has_link BOOLEAN, has_text BOOLEAN, sample_page_url STRING, risk_level STRING"
RULES = "id INT, domain STRING, match_type STRING, risk_level STRING, category STRING, tags ARRAY<STRING>, source STRING, remark STRING"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_domain_merge_is_associative_and_keeps_the_first_risk(spark):
    def batch(*r):
        return spark.createDataFrame([(1, d, d, n, link, not link, u, lv) for d, n, link, u, lv in r], DOMAINS)
    a, b, c = batch(("x.com", 1, True, "", "high")), batch(("x.com", 2, False, "p2", "low"), ("y.com", 1, True, "q", "safe")), batch(("x.com", 4, True, "p3", "safe"))
    left = M.merge_domains(M.merge_domains(a, b), c)
    right = M.merge_domains(a, M.merge_domains(b, c))
    assert rows(left) == rows(right) == [(1, "x.com", "x.com", 7, True, True, "p2", "high"), (1, "y.com", "y.com", 1, True, False, "q", "safe")]
    assert rows(M.merge_domains(a.limit(0), b)) == rows(b)


def test_page_merge_keeps_first_depth_and_last_status(spark):
    schema = "id BIGINT, task_id INT, url STRING, path STRING, depth INT, status_code INT, crawled_at INT"
    old = spark.createDataFrame([(1, 1, "u", "/u", 2, 200, 1)], schema)
    new = spark.createDataFrame([(5, 1, "u", "/z", 9, 500, 3), (6, 1, "u", "/z", 9, 404, 2), (7, 1, "w", "/w", 1, 200, 5), (8, 1, "w", "/v", 3, 301, 6)], schema)
    assert rows(M.merge_pages(old, new)) == [(1, 1, "u", "/u", 2, 500, 3), (7, 1, "w", "/w", 1, 301, 6)]


def test_rule_precedence(spark):
    rules = spark.createDataFrame([
        (1, "*.evil.com", "root", "high", "c", ["t"], "m", ""), (2, "a.evil.com", "exact", "low", "", ["c"], "m", "r"), (3, "b.evil.com", "wildcard", "critical", "t", ["t"], "m", ""),
        (4, "EVIL.com", "exact", "safe", "", None, "m", "late")], RULES)
    names = [("a.evil.com", "evil.com", "low"), ("x.b.evil.com", "evil.com", "high"), ("evil.com", "evil.com", "high"), ("b.evil.com", "evil.com", "critical"),
             ("notevil.com", "notevil.com", "pending"), ("x.gov.cn", "x.gov.cn", "safe"), ("a.google.com", "google.com", "safe")]
    df = spark.createDataFrame([(1, d, r) for d, r, _ in names], "task_id INT, domain STRING, root_domain STRING")
    for evaluate in (K.evaluate, K.evaluate_rollup):
        got = {r["domain"]: r for r in evaluate(df, rules).collect()}
        assert {d: got[d]["risk_level"] for d in got} == {d: lv for d, _, lv in names}
        assert got["x.b.evil.com"]["risk_tags"] == ["c", "t"] and got["b.evil.com"]["risk_tags"] == ["t"]
        assert got["evil.com"]["risk_remark"] == v.REMARK_RULE_HIT + "*.evil.com" and got["a.evil.com"]["risk_remark"] == "r"
        assert got["x.gov.cn"]["risk_source"] == "builtin_rule" and got["notevil.com"]["risk_source"] == "pending"


def test_deleted_rule_hands_over_to_the_next(spark):
    rules = spark.createDataFrame([(1, "evil.com", "root", "high", "", [], "m", ""), (2, "evil.com", "root", "low", "k", [], "m", "second")], RULES)
    d = spark.createDataFrame([(1, "evil.com", "evil.com", "high", "intel_rule"), (1, "a.evil.com", "evil.com", "high", "manual")], "task_id INT, domain STRING, root_domain STRING, risk_level STRING, risk_source STRING")
    t = spark.createDataFrame([(1, 1, "evil.com", "evil.com", "high")], "id INT, task_id INT, domain STRING, root_domain STRING, risk_level STRING")
    left, d2, t2 = M.delete_rule(d, t, rules, 1)
    assert left.count() == 1 and rows(d2.select("domain", "risk_level")) == [("a.evil.com", "high"), ("evil.com", "low")] and t2.first()["risk_level"] == "low"
    left, d3, t3 = M.delete_rule(d2, t2, left, 2)
    assert left.count() == 0 and rows(d3.select("domain", "risk_level", "risk_source")) == [("a.evil.com", "high", "manual"), ("evil.com", "pending", "")] and t3.count() == 0


def test_ticket_reconcile_is_idempotent(spark):
    states = [(s, m, r) for s in [*v.VERIFY_STATES, "page_removed"] for m in v.MANUAL_STATES for r in ("", "x")]
    t = spark.createDataFrame([(i, *s) for i, s in enumerate(states)], "id INT, verify_status STRING, manual_status STRING, manual_remark STRING")
    once = M.reconcile_tickets(t, F.lit("2030-01-01").cast("timestamp"))
    assert rows(once) == rows(M.reconcile_tickets(once, F.lit("2030-01-01").cast("timestamp")))
    assert tuple(M.reconcile_counts(once).first()) == (0, 0)


def test_retest_states(spark):
    run = F.lit("2030-01-01 00:00:00").cast("timestamp")
    cases = {"gone": (404, "x", ""), "gone2": (500, "error 404", ""), "broken": (503, "x", ""), "there": (200, "see BAD.com", ""), "raw": (403, "has RAW-MATCH", ""), "clear": (200, "ok", ""),
             "slow": (0, "", v.ERROR_TIMEOUT), "down": (0, "", v.ERROR_CONNECT), "odd": (0, "", "boom"), "null": (200, None, None)}
    t = spark.createDataFrame([(i, 1, "bad.com", k, "raw-match") for i, k in enumerate(cases)], "id INT, task_id INT, domain STRING, page_url STRING, raw_match STRING")
    r = spark.createDataFrame([(k, *c) for k, c in cases.items()], "url STRING, status_code INT, body STRING, error STRING")
    got = {x["page_url"]: x["verify_status"] for x in K.retest_pages(t, r, run).collect()}
    assert got == {"gone": "page_removed", "gone2": "page_removed", "broken": "error", "there": "verified_failed", "raw": "verified_failed", "clear": "verified_clean", "slow": "error",
                   "down": "page_removed", "odd": "error", "null": "verified_clean"}


@pytest.mark.parametrize("depth,pages", [(0, 0), (2, 0), (0, 7)])
def test_walk_equals_queue(spark, depth, pages):
    links = [(t, f"n{i}", f"n{(i * k + t) % 40}") for t in (1, 2) for i in range(40) for k in (2, 3)] + [(1, "hub", f"h{i}") for i in range(500)] + [(1, "n3", "hub")]
    seeds = [(1, "n0", 0), (2, "n1", 0), (2, "n39", 1)]
    want = set()
    for t in (1, 2):
        seen = {u: d for s, u, d in seeds if s == t}
        queue = collections.deque(sorted(((d, u) for u, d in seen.items())))
        while queue:
            d, u = queue.popleft()
            if depth and d >= depth:
                continue
            for s, a, b in links:
                if s == t and a == u and (b not in seen or seen[b] > d + 1):
                    seen[b] = d + 1
                    queue.append((d + 1, b))
        order = sorted((d, u) for u, d in seen.items())
        want |= {(t, u, d) for d, u in (order[:pages] if pages else order)}
    got = G.walk(spark.createDataFrame(seeds, "task_id INT, url STRING, depth INT"), spark.createDataFrame(links, "task_id INT, src STRING, dst STRING"), depth, pages)
    assert {tuple(r) for r in got.select("task_id", "url", "depth").collect()} == want


def test_numbers_are_consecutive_over_hot_keys(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"), "id")
    got = numbered(df, "no", "k", "id").orderBy("no").collect()
    assert [r["no"] for r in got] == list(range(1, 5001))
    assert [(r["k"], r["id"]) for r in got] == sorted((r["k"], r["id"]) for r in got)


def test_rule_file_round_trip(spark, tmp_path):
    rules = spark.createDataFrame([(1, "a.com", "root", "high", "c,d", ["x", "y,z"], "m", "line\nbreak"), (2, "b.com", "exact", "safe", "", [], "m", "")], RULES)
    path = str(tmp_path / "rules")
    E.write_lines(E.rule_text(rules), path)
    back = I.parse_rules(I.read_lines(spark, path))
    assert rows(back.select("domain", "match_type", "risk_level", "category", "tags", "remark")) == [
        ("a.com", "root", "high", "c，d", ["x", "y，z"], "line break"), ("b.com", "exact", "safe", "", [], "")]


def test_csv_has_a_mark_and_order(spark, tmp_path):
    d = spark.createDataFrame([(1, f"d{i}.com", "r", i, True, False, "p", "low") for i in range(50)], DOMAINS).withColumn("risk_tags", F.array(F.lit("t"))).withColumn(
        "verify_status", F.lit("error")).withColumn("created_at", F.lit("x"))
    path = str(tmp_path / "csv")
    E.write_csv(E.domain_csv(d), path)
    parts = sorted(f for f in os.listdir(path) if f.endswith(".csv"))
    text = "".join(open(os.path.join(path, f), encoding="utf-8").read() for f in parts)
    assert text.startswith(E.BOM + v.DOMAIN_HEADER[0])
    names = [line.split(",")[0] for line in text.splitlines() if line.startswith("d")]
    assert names == [f"d{i}.com" for i in range(49, -1, -1)]


def test_sitemap_index_is_followed(spark):
    docs = spark.createDataFrame([
        (1, "https://s/a.xml", "<x:sitemapindex xmlns:x='n'><x:sitemap><x:loc>https://s/b.xml</x:loc></x:sitemap><x:sitemap><x:loc>https://s/a.xml</x:loc></x:sitemap></x:sitemapindex>", 200),
        (1, "https://s/b.xml", "<urlset><url><lastmod>x</lastmod><loc><![CDATA[https://s/1?a=1]]></loc></url><url><loc> https://s/2&amp;b </loc></url><url></url></urlset>", 200),
        (1, "https://s/c.xml", "<urlset><url><loc>https://s/unlinked</loc></url></urlset>", 200), (1, "https://s/d.xml", "broken", 200)], "task_id INT, url STRING, body STRING, status_code INT")
    start = spark.createDataFrame([(1, "https://s/a.xml"), (1, "https://s/d.xml"), (1, "https://s/missing.xml")], "task_id INT, url STRING")
    assert rows(I.sitemap_urls(start, docs)) == [(1, "https://s/1?a=1"), (1, "https://s/2&b")]


def test_responses_to_pages(spark, tmp_path):
    r = spark.createDataFrame([(1, "https://www.site.com/a.js?v", 200, "", "fetch('https://api.x.io/')", 5, None, None), (1, "https://www.site.com/i.png", 200, "image/png", "bin y.io", 5, None, None),
                               (1, "https://www.site.com/p", 200, "text/html", "<title> A  b </title>z.io", 5, None, None)],
                              "task_id INT, url STRING, status_code INT, content_type STRING, html STRING, response_time_ms INT, error STRING, fetched_at TIMESTAMP")
    r.write.parquet(str(tmp_path / "r"))
    tasks = spark.createDataFrame([(1, "https://www.site.com/")], "task_id INT, target_url STRING")
    stored = S.keep_text_bodies(S.read_responses(spark, str(tmp_path / "r")))
    hits = X.extract_hits(S.prepare_pages(stored, tasks))
    assert {x["domain"] for x in hits.where("side = 'external'").collect()} == {"api.x.io", "z.io"}
    assert {x["title"] for x in S.page_record(stored).collect()} == {"[JS] /a.js", "", "A b"}


def page_file(spark, path, urls):
    spark.createDataFrame([(1, u, '<a href="https://p.io/">x</a> q.io', "html", "www.site.com") for u in urls],
                          "task_id INT, page_url STRING, html STRING, resource STRING, target_host STRING").coalesce(1).write.mode("append").parquet(path)


def test_stream_resumes_without_loss_or_doubling(spark, tmp_path):
    src, store, ck = (str(tmp_path / x) for x in ("src", "store", "ck"))
    rules = str(tmp_path / "rules")
    spark.createDataFrame([(1, "p.io", "root", "low", "", [], "m", "")], RULES).write.parquet(rules)
    schema = "task_id INT, page_url STRING, html STRING, resource STRING, target_host STRING"

    def run():
        q = J.scan_stream(J.read_stream(spark, src, schema, files_per_batch=1), store, ck, rules).trigger(availableNow=True).start()
        q.awaitTermination()
    page_file(spark, src, ["https://www.site.com/1", "https://www.site.com/2"])
    run()
    spark.createDataFrame([(1, "p.io", "root", "high", "", [], "m", "")], RULES).write.mode("overwrite").parquet(rules)
    page_file(spark, src, ["https://www.site.com/3"])
    page_file(spark, src, ["https://www.site.com/4"])
    run()
    run()

    def current(at):
        return {r["domain"]: (r["occurrence_count"], r["risk_level"]) for r in J.current_domains(spark, at).collect()}
    assert current(store) == {"p.io": (4, "low"), "q.io": (4, "pending")}
    # a replayed batch overwrites its own delta
    again = spark.read.parquet(src).where(F.col("page_url") == "https://www.site.com/3")
    J.write_batch(again, 1, store, spark.read.parquet(rules), F.current_timestamp())
    assert current(store) == {"p.io": (4, "low"), "q.io": (4, "pending")}
    assert J.compact(spark, store) == 0 and J.compact(spark, store) is None
    assert current(store) == {"p.io": (4, "low"), "q.io": (4, "pending")}
    assert {r["domain"]: r["occurrence_count"] for r in J.current_subdomains(spark, store).collect()} == {"www.site.com": 4}


def test_page_count_tables(spark, tmp_path):
    occ = spark.createDataFrame([("a.x.io", "x.io", f"p{i % 50}") for i in range(400)] + [("b.x.io", "x.io", "p1")], "domain STRING, root_domain STRING, page_url STRING")
    roots, names = str(tmp_path / "r"), str(tmp_path / "d")
    M.refresh_page_counts(occ, roots, names)
    assert rows(spark.read.parquet(roots)) == [("x.io", 50)]
    approx = {r["domain"]: r["page_count"] for r in spark.read.parquet(names).collect()}
    assert approx["b.x.io"] == 1 and abs(approx["a.x.io"] - 50) <= 3


def test_verdict_without_pages(spark):
    res = spark.createDataFrame([(1, "a.io", None, None)], "task_id INT, domain STRING, url STRING, found BOOLEAN")
    r = R.domain_verdicts(res, "task_id", "domain").first()
    assert (r["verify_status"], r["summary"], r["tested_count"]) == ("unverified", v.VERDICT_NONE, 0)


def test_live_counts_of_a_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    page_file(spark, src, ["https://www.site.com/1", "https://a.site.com/2"])
    schema = "task_id INT, page_url STRING, html STRING, resource STRING, target_host STRING"
    counts = J.live_counts(X.extract_hits(J.read_stream(spark, src, schema)))
    q = counts.writeStream.outputMode("complete").format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("live").collect()] == [(1, 2, 2)]


def test_duplicate_responses_are_dropped_within_the_watermark(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    times = ["2024-01-01 00:00:00", "2024-01-01 00:10:00", "2024-01-01 00:20:00"]
    spark.createDataFrame([(1, "u", t) for t in times] + [(2, "u", times[0])], "task_id INT, url STRING, t STRING").select(
        "task_id", "url", F.col("t").cast("timestamp").alias("fetched_at")).write.parquet(src)
    stream = J.first_responses(J.read_stream(spark, src, "task_id INT, url STRING, fetched_at TIMESTAMP"))
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(out).select("task_id", "url")) == [(1, "u"), (2, "u")]


def test_only_names_with_a_rule_reach_the_rule_join(spark):
    """A top-level label that all names share, or a root without a rule, is no join key."""
    names = spark.range(5000).select(F.concat(F.lit("a.b.s"), F.col("id"), F.lit(".Com")).alias("domain"), F.concat(F.lit("s"), "id", F.lit(".com")).alias("root_domain"))
    rules = spark.createDataFrame([(f"s{i}.com",) for i in range(0, 50, 5)] + [("b.s7.com",), ("other.org",)], "target STRING")
    keys = J_.rule_suffixes(names, rules)
    matches = J_.suffix_matches(names, rules)
    assert matches.count() == 11
    assert keys.count() <= 13 and keys.where("__parent = 'com'").isEmpty()
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    everywhere = spark.createDataFrame([("com",)], "target STRING")
    assert J_.suffix_matches(names, everywhere).count() == 5000
    assert J_.suffix_matches(names, rules.limit(0)).count() == 0
