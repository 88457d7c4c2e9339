"""Domain-name expressions.

All are built-in column expressions.  Patterns that could backtrack over long
input use possessive quantifiers, so text of any length is safe.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linklens.fixed_values import (
    CODE_WORDS, DICTIONARY_TLDS, FILE_EXTENSIONS, RESERVED_DOMAINS, SAFE_ROOTS, SAFE_SUFFIXES,
)
from linklens.functions import public_suffix as ps

WHITESPACE = " \t\r\n\f\x0b"
LABEL = r"(?!-)[a-z0-9-]{1,63}+(?<!-)"
DOMAIN_SYNTAX = rf"^{LABEL}(?:\.{LABEL})++$"
IPV4 = r"^\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}$"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def last_label(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def label_count(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("."), F.lit(""))) + 1


def sealed(df: DataFrame, *names: str) -> DataFrame:
    """Compute the named columns once: later filters are not pushed into their expressions.

    The optimizer copies the expression of a filtered column into the filter.
    For the long chains built here that would multiply the work, so the columns
    pass through a one-row generator, which it does not look through.
    """
    rest = [c for c in df.columns if c not in names]
    return df.select(*rest, F.inline_outer(F.array(F.struct(*names))))


def clean_domain(raw: Column) -> Column:
    """bare lower-case domain name, or null if it cannot be one."""
    d = F.regexp_replace(F.lower(strip(raw)), r"(?s)^.*?://", "")
    d = F.btrim(F.regexp_extract(d, r"^([^/?#:]*)", 1), F.lit(". "))
    ok = d.rlike(DOMAIN_SYNTAX) & ~d.rlike(IPV4) & ~d.isin(*RESERVED_DOMAINS)
    return F.when(ok, d)


def has_domain_syntax(d: Column) -> Column:
    """at most 253 characters, two or more well-formed labels."""
    return F.coalesce((F.length(d) <= 253) & F.lower(d).rlike(DOMAIN_SYNTAX), F.lit(False))


def one_of(expr: str, values) -> str:
    """SQL membership test; Catalyst turns the list into a hash set."""
    return f"{expr} IN ({', '.join(repr(x) for x in values)})"


def _code_like_sql(d: str) -> str:
    """Dotted code identifiers: a word TLD after a code word or after a very short first label."""
    n = f"(length({d}) - length(replace({d}, '.', '')) + 1)"
    first, before_tld = f"substring_index({d}, '.', 1)", f"substring_index(substring_index({d}, '.', -2), '.', 1)"
    return (f"({one_of(f'substring_index({d}, {chr(39)}.{chr(39)}, -1)', DICTIONARY_TLDS)} AND "
            f"(({n} = 2 AND (length({first}) <= 3 OR {one_of(first, CODE_WORDS)})) OR ({n} >= 3 AND {one_of(before_tld, CODE_WORDS)})))")


def is_public_domain(name: str, from_url: str | bool) -> Column:
    """F4 of a column by name: syntax, known TLD, no file suffix, and unless it came from a URL no code-like name.

    `from_url` is a boolean or the name of a boolean column.
    """
    d = f"trim(TRAILING '.' FROM lower(trim({name})))"
    tld = f"substring_index({d}, '.', -1)"
    usable = sorted(ps.tlds() - set(FILE_EXTENSIONS))
    url = from_url if isinstance(from_url, str) else str(from_url).lower()
    syntax = DOMAIN_SYNTAX.replace("\\", "\\\\")
    return F.expr(f"coalesce(length({d}) <= 253 AND {d} RLIKE '{syntax}' AND {one_of(tld, usable)} AND ({url} OR NOT {_code_like_sql(d)}), false)")


def with_domain_parts(df: DataFrame, raw: Column, from_url: Column | bool,
                      domain: str = "domain", root: str = "root_domain") -> DataFrame:
    """add `domain` and `root_domain`; both null when `raw` names no public domain.

    One narrow pass: the suffix rules are hash sets in the plan, so repeated
    hosts cost a look-up, not a shuffle to make them distinct first.
    """
    url = from_url if isinstance(from_url, Column) else F.lit(from_url)
    df = df.withColumns({"__d": clean_domain(raw), "__u": url})
    df = df.withColumn("__d", F.when(is_public_domain("__d", "__u"), F.col("__d"))).withColumn("__n", ps.suffix_length("__d"))
    df = df.withColumn(root, ps.root_from_suffix_length("__d", "__n"))
    df = df.withColumn(domain, F.when(F.col(root).isNotNull(), F.col("__d"))).drop("__d", "__n", "__u")
    return sealed(df, domain, root)


def with_target_root(df: DataFrame, host: str, root: str = "target_root") -> DataFrame:
    """Root of a scanned site; the host itself when the suffix list does not know it."""
    df = (
        df.withColumn("__n", ps.suffix_length(host))
        .withColumn(root, F.coalesce(ps.root_from_suffix_length(host, "__n"), F.col(host)))
        .drop("__n")
    )
    return sealed(df, root)


def naive_root(d: Column) -> Column:
    """last two labels."""
    return F.substring_index(d, ".", -2)


def is_internal(host: Column, root: Column, target_host: Column, target_root: Column,
                scope: str = "root_domain") -> Column:
    """does the host belong to the scanned site?"""
    h = F.lower(strip(F.substring_index(host, ":", 1)))
    if scope == "exact_host":
        inside = h == target_host
    else:
        inside = F.when(root.isNotNull(), root == target_root).otherwise(
            (h == target_host) | h.endswith(F.concat(F.lit("."), target_host)))
    return F.when(F.coalesce(host, F.lit("")) == "", F.lit(True)).otherwise(F.coalesce(inside, F.lit(False)))


def is_subdomain(root: Column, target_root: Column) -> Column:
    """valid (root known) and under the scanned site's root."""
    return F.coalesce(root == target_root, F.lit(False))


def rule_target(d: Column) -> Column:
    """rule text without its wildcard prefix."""
    return F.ltrim(F.lower(strip(d)), F.lit("*."))


def parent_names(d: Column) -> Column:
    """The name and every parent of it: a.b.c -> [a.b.c, b.c, c]."""
    labels = F.split(d, r"\.")
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))


def is_allow_listed(domain: str, root: str) -> Column:
    """F32 of two columns by name: under an allow-listed root or an authority suffix.

    A name lies under an entry when one of its suffixes equals it, so one set
    look-up per suffix length decides.
    """
    deepest = max(s.count(".") + 1 for s in SAFE_ROOTS)
    tests = []
    for c in (f"lower({domain})", f"lower({root})"):
        for k in range(2, deepest + 1):
            tests.append(one_of(f"substring_index({c}, '.', -{k})", [s for s in SAFE_ROOTS if s.count(".") + 1 == k]))
        tests += [f"endswith({c}, '{s}')" for s in SAFE_SUFFIXES]
    return F.expr(f"coalesce({' OR '.join(tests)}, false)")


def suggested_rule_target(domain: Column, root: Column) -> Column:
    """name to offer for a rule: one label less, never shorter than the root."""
    def bare(c):
        c = strip(c)
        return F.when(c.startswith("*."), F.substr(c, F.lit(3))).when(c.startswith("."), F.substr(c, F.lit(2))).otherwise(c)

    d = bare(F.when(F.coalesce(domain, F.lit("")) != "", domain).otherwise(F.coalesce(root, F.lit(""))))
    has_root = F.coalesce(root, F.lit("")) != ""
    labels = F.filter(F.split(d, r"\."), lambda x: x != "")
    shorter = F.array_join(F.slice(labels, 2, F.size(labels)), ".")
    return (
        F.when((F.size(labels) > 2) & has_root & (F.length(shorter) < F.length(bare(root))), bare(root))
        .when(F.size(labels) > 2, shorter)
        .when(has_root, root)
        .otherwise(d)
    )
