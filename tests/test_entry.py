"""The entry module in copies of the repository without the optional parts."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).parent.parent
COUNT = "import __spark_entry__ as e; print(len(e.queries()), sum(k.startswith('op') or k == 'pipeline' for k in e.queries()), len(e.oracle_sql()))"


def copy(tmp_path):
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path / name)
    shutil.copytree(ROOT / "linklens", tmp_path / "linklens", ignore=shutil.ignore_patterns("__pycache__", "llm"))
    return tmp_path


def counted(folder, code=COUNT):
    run = subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True, timeout=120, check=False)
    assert run.returncode == 0, run.stderr
    return [int(x) for x in run.stdout.split()]


def test_without_the_folder(tmp_path):
    folder = copy(tmp_path)
    n, optional, oracles = counted(folder)
    assert n > 200 and optional == 0 and 0 < oracles <= n


def test_without_the_folder_and_the_pipeline(tmp_path):
    folder = copy(tmp_path)
    if (folder / "corpus_pipeline.py").exists():
        (folder / "corpus_pipeline.py").unlink()
    assert counted(folder)[1] == 0


def test_library_of_the_folder_missing(tmp_path):
    folder = copy(tmp_path)
    (folder / "linklens" / "llm").mkdir()
    (folder / "linklens" / "llm" / "__init__.py").write_text("")
    (folder / "linklens" / "llm" / "catalog.py").write_text("import a_library_that_is_not_there\n")
    assert counted(folder)[1] == 0
