"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The adapter views are written out before the clock starts.  `queries` holds the time
of planning and running, `planning` the part of it before the first job.
"""

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "flagship_risky_domains_of_pages", "x22_evidence_per_page", "x12_x13_names_in_documents", "a1_domain_rollup", "a8_global_domains",
    "a14_global_risk_histogram", "a20_root_page_counts", "j2_risky_evidence", "j10_rule_page_counts", "risk1_j6_j7_w5_evaluate_domains",
    "risk2_retest_pages", "w1_evidence_cap", "m2_m3_domain_upsert", "m9_j5_rule_sync_tickets", "m12_ticket_sync", "m13_page_verdicts_applied",
    "g1_g2_g4_walk", "s22_w7_ticket_csv", "q14_retest_queue", "t3_page_rate",
]


def copy_rate(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """Rows a second of a ranged copy of all evidence, marks and their commits included."""
    from linklens.checks.registry import Tables
    from linklens.checks.stream_checks import run_folder
    from linklens.sources.copying import RangedCopy

    t = Tables(spark, sf_dir)
    source = t.fx_occurrences.withColumnRenamed("seq", "id")
    start = time.perf_counter()
    copy = RangedCopy(source, f"{run_folder(t)}/copy")
    copy.ranges(4)
    copy.run(1 << 62)
    seconds = time.perf_counter() - start
    rows = copy.copied().count()
    return {"copied_rows": rows, "copy_seconds": round(seconds, 3), "copy_rows_per_second": round(rows / seconds)}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("linklens-bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.adaptive.enabled", "true")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_CHECKPOINT_DIR") or tempfile.mkdtemp(prefix="bench-checkpoint-"))
        .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from linklens.checks import catalog, views

    # start-up: JIT, file listing and the suffix rules are not part of a query
    catalog.QUERIES["f4_f5_j12_domain_parts_from_url"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    only = os.environ.get("BENCH_ONLY")
    views.store(spark, sf_dir, tempfile.mkdtemp(prefix="bench-views-"))
    times, planning = {}, {}
    for name in HEADLINE if not only else only.split(","):
        start = time.perf_counter()
        df = catalog.QUERIES[name](spark, sf_dir)
        planning[name] = round(time.perf_counter() - start, 3)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    extra = {} if only else copy_rate(spark, sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "planning": planning, "extra": extra,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
