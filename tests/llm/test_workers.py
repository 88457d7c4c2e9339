"""Operators on workers that can't import the package: the driver finds it by its own path only."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).parent.parent.parent
CODE = """
import sys, tempfile
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2")
         .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="tests-checkpoint-")).getOrCreate())
spark.sparkContext.setLogLevel("ERROR")
def found(batches):
    import importlib.util
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([importlib.util.find_spec("linklens") is not None] * b.num_rows)], names=["x"])
assert not spark.range(1).mapInArrow(found, "x boolean").first().x
import importlib
module = importlib.import_module("linklens.llm." + {module!r})
docs = "conversations" if {module!r} in ("op7_role_repair", "op12_audited_repair") else "documents"
print("rows", module.QUERIES[{module!r}](spark, "/root/testdata/sf0.001").count(), spark.read.parquet("/root/testdata/sf0.001/" + docs + ".parquet").count())
if {module!r} == "op3_toxic_spans":
    print("rows", module.drop_toxic(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")).count() > 0, True)
"""


@pytest.mark.parametrize("module", ["op3_toxic_spans", "op4_phrase_automata", "op10_language_masks", "op11_prefix_tokens", "op12_audited_repair", "op13_phrase_tries"])
def test_without_the_package_on_workers(module, tmp_path):
    run = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), module=module)], cwd=tmp_path, capture_output=True, text=True, timeout=300, check=False)
    assert run.returncode == 0, run.stderr[-3000:]
    lines = [line.split()[1:] for line in run.stdout.splitlines() if line.startswith("rows")]
    assert lines and all(x[0] != "0" for x in lines)
    if module in ("op3_toxic_spans", "op4_phrase_automata", "op10_language_masks", "op11_prefix_tokens"):
        assert all(a == b for a, b in lines)
