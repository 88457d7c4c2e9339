"""Registrable domain of a host by the Public Suffix List.

The rule list (ICANN part, about 7,400 rules, a size fixed by the file) is read
once on the driver from the Spark distribution and put into the plan as IN
lists, which Catalyst turns into hash sets.  The look-up is therefore a narrow,
code-generated expression: no join, no shuffle, no Python worker.
"""

from __future__ import annotations

import functools
import glob
import os
import zipfile

import pyspark
from pyspark.sql import Column
from pyspark.sql import functions as F

LIST_ENTRY = "mozilla/public-suffix-list.txt"


def _candidate_jars() -> list[str]:
    homes = [os.environ.get("SPARK_HOME"), os.path.dirname(pyspark.__file__)]
    return [j for h in homes if h for j in sorted(glob.glob(os.path.join(h, "jars", "httpclient-*.jar")))]


@functools.lru_cache(maxsize=4)
def load_rules(path: str | None = None) -> tuple[str, ...]:
    """ICANN rules in lower-case ASCII form, from `path` or from Spark's own jars."""
    text = None
    if path:
        with open(path, encoding="utf-8") as f:
            text = f.read()
    else:
        for jar in _candidate_jars():
            with zipfile.ZipFile(jar) as z:
                if LIST_ENTRY in z.namelist():
                    text = z.read(LIST_ENTRY).decode("utf-8")
                    break
    if text is None:
        raise FileNotFoundError("no public suffix list: pass a path or keep httpclient among Spark's jars")
    rules, icann = [], False
    for line in text.splitlines():
        line = line.strip()
        if "===BEGIN ICANN" in line:
            icann = True
        elif "===END ICANN" in line:
            break
        elif icann and line and not line.startswith("//"):
            mark = "!" if line.startswith("!") else ""
            try:
                labels = [p if p == "*" else p.encode("idna").decode("ascii") for p in line.lstrip("!").split(".")]
            except UnicodeError:
                continue
            rules.append(mark + ".".join(labels).lower())
    return tuple(dict.fromkeys(rules))


@functools.lru_cache(maxsize=4)
def tlds(path: str | None = None) -> frozenset[str]:
    return frozenset(r.lstrip("!").split(".")[-1] for r in load_rules(path))


def _in(expr: str, values) -> str:
    return f"{expr} IN ({', '.join(repr(v) for v in sorted(values))})" if values else "false"


@functools.lru_cache(maxsize=16)
def _suffix_length_sql(host: str, path: str | None) -> str:
    plain, wild, exempt = {}, {}, {}
    for r in load_rules(path):
        if r.startswith("!"):
            exempt.setdefault(r.count(".") + 1, set()).add(r[1:])
        elif r.startswith("*."):
            wild.setdefault(r.count(".") + 1, set()).add(r[2:])
        else:
            plain.setdefault(r.count(".") + 1, set()).add(r)
    n = f"(length({host}) - length(replace({host}, '.', '')) + 1)"

    def tail(k):
        return f"substring_index({host}, '.', -{k})"

    arms = [f"WHEN {n} >= {k} AND {_in(tail(k), v)} THEN {k - 1}" for k, v in sorted(exempt.items(), reverse=True)]
    for k in range(max([*plain, *wild]), 0, -1):
        tests = []
        if k in plain:
            tests.append(_in(tail(k), plain[k]))
        if k in wild:
            tests.append(_in(tail(k - 1), wild[k]))
        if tests:
            arms.append(f"WHEN {n} >= {k} AND ({' OR '.join(tests)}) THEN {k}")
    return f"CASE {' '.join(arms)} END"


def suffix_length(host: str, path: str | None = None) -> Column:
    """Number of labels of the public suffix of column `host` (a lower-case name); null if no rule fits."""
    return F.expr(_suffix_length_sql(host, path))


def root_from_suffix_length(host: str, length: str) -> Column:
    """Suffix plus one label; null when the host is itself a suffix."""
    return F.expr(
        f"CASE WHEN length({host}) - length(replace({host}, '.', '')) >= {length} "
        f"THEN substring_index({host}, '.', -({length} + 1)) END"
    )


def is_tld(label: str, path: str | None = None) -> Column:
    """is the SQL expression `label` a known top-level domain?"""
    return F.expr(_in(label, tlds(path)))
