"""Batches of many files, and a page that comes in two batches."""

import os

from pyspark.sql import functions as F

from linklens.checks import stream_checks as C
from linklens.streaming import jobs as J


def test_a_batch_is_written_side_by_side_and_read_as_one(spark, tmp_path):
    rows = spark.range(80).repartition(4).withColumn("batch", (F.col("id") % 2).cast("int"))
    seen = []
    for n in range(2):
        C.fed(rows, n, f"{tmp_path}/src")
        stream = J.read_stream(spark, f"{tmp_path}/src", "id BIGINT", files_per_batch=None)
        C.finished(stream.writeStream.foreachBatch(lambda df, i: seen.append((i, df.count()))).option("checkpointLocation", f"{tmp_path}/ck"))
    assert seen == [(0, 40), (1, 40)]
    assert len([f for f in os.listdir(f"{tmp_path}/src") if f.endswith(".parquet")]) == 8


def test_the_cap_holds_for_a_page_of_two_batches(spark, tmp_path):
    html = '<a href="https://a.io/1{0}">x</a><a href="https://a.io/2{0}">x</a><a href="https://a.io/3{0}">x</a>'
    schema = "page_id BIGINT, task_id INT, page_url STRING, html STRING, resource STRING, target_host STRING"
    for n, mark in enumerate("xy"):
        page = spark.createDataFrame([(n, 1, "https://www.site.com/p", html.format(mark), "html", "www.site.com")], schema)
        J.write_batch(page, n, f"{tmp_path}/store", None, F.lit("2030-01-01").cast("timestamp"), per_domain=2)
    a = lambda df: df.where("domain = 'a.io'").count()
    assert a(J.current_evidence(spark, f"{tmp_path}/store")) == 4
    assert a(J.current_evidence(spark, f"{tmp_path}/store", per_domain=2)) == 2
