"""Names, suffixes and links."""

from urllib.parse import urldefrag, urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from linklens import fixed_values as v
from linklens.functions import domains as D
from linklens.functions import text as T
from linklens.functions import urls as U
from tests import brute

VALID = ["shop.site.com", "a.b.gov.cn", "x.co.uk", "city.kawasaki.jp", "my-host.io", "xn--fiq228c.com", "news.bbc.co.uk", "q.www.ck"]
INVALID_TEXT = ["window.open", "e.target", "video.play", "btn.click", "a.top", "x.js", "obj.data", "style.css", "1.2.3.4", "localhost", "example.com",
                "-a.com", "a-.com", "a..com", "under_score.com", "nodots", "a.nosuchtld", "", "  ", "x" * 64 + ".com", "a.map.open"]


def test_names(spark):
    rows = [(n, True) for n in VALID] + [(n, False) for n in INVALID_TEXT]
    df = D.with_domain_parts(spark.createDataFrame(rows, "raw STRING, ok BOOLEAN"), F.col("raw"), False)
    for r in df.collect():
        assert (r["domain"] is not None) == r["ok"], r
        want = brute.parts(r["raw"], False)
        assert (r["domain"], r["root_domain"]) == (want or (None, None)), r


def test_word_tlds_are_fine_from_urls(spark):
    df = spark.createDataFrame([("window.open",), ("a.top",)], "raw STRING")
    assert [r["domain"] for r in D.with_domain_parts(df, F.col("raw"), True).collect()] == ["window.open", "a.top"]


def test_allow_list(spark):
    rows = [("cdn.jsdelivr.net", "jsdelivr.net", True), ("notjsdelivr.net", "notjsdelivr.net", False), ("a.b.gov.cn", "b.gov.cn", True), ("x.edu.cn", "x.edu.cn", True),
            ("beian.miit.gov.cn", "miit.gov.cn", True), ("evil.com", "evil.com", False), ("a.sina.com.cn", "sina.com.cn", True)]
    df = spark.createDataFrame(rows, "domain STRING, root STRING, ok BOOLEAN")
    assert df.where(D.is_allow_listed("domain", "root") != F.col("ok")).count() == 0


def test_fixed_lists_are_small_and_unique():
    for values in (v.FILE_EXTENSIONS, v.CODE_WORDS, v.DICTIONARY_TLDS, v.SAFE_ROOTS):
        assert len(values) == len(set(values)) <= 200


BASES = ["http://a.com/x/y/z.html?q=1#f", "https://b.org", "http://c.net/d/", "http://d.com:80/a/b"]
LINKS = ["", "#x", "/p", "p", "./p", "../p", "../../../p", "?s=1", "//cdn.x.com/a.js", "http://e.com:80/x", "https://e.com:443", "HTTP://E.com/a/../b", "p/./q/..", ".", "..",
         "a//b", "/a//b", "/a/../../b", "ftp://x/y", "http:foo", "javascript:void(0)", "x y", "p?u=http://z.com/a#b", "/a/b/..", "mailto:x@y.z", "../", "foo:bar", " /trim "]


def resolve(base, raw):
    raw = raw.strip()
    if not raw or any(raw.startswith(p) for p in v.DEAD_LINK_PREFIXES):
        return None
    u = urlsplit(urldefrag(urljoin(base, raw))[0])
    if u.scheme not in ("http", "https"):
        return None
    port = {"http": ":80", "https": ":443"}[u.scheme]
    return f"{u.scheme}://{u.netloc.removesuffix(port)}{u.path or '/'}{'?' + u.query if u.query else ''}"


def test_links(spark):
    df = spark.createDataFrame([(b, x) for b in BASES for x in LINKS], "base STRING, raw STRING")
    for r in U.with_normalized_link(df, "base", F.col("raw"), "url").collect():
        assert r["url"] == resolve(r["base"], r["raw"]), r


@pytest.mark.parametrize("char", ["x", "é", "汉", "😀"])
def test_safe_url_cuts_at_a_character(spark, char):
    for pad in range(4):
        url = "https://h.com/" + "y" * pad + char * 2100
        got = spark.createDataFrame([(url,)], "u STRING").select(U.safe_url(F.col("u"))).first()[0]
        assert got == url.encode()[:2000].decode("utf-8", "ignore")
    short = "https://h.com/" + char * 100
    assert spark.createDataFrame([(short,)], "u STRING").select(U.safe_url(F.col("u"))).first()[0] == short


def test_fill_and_tags(spark):
    df = spark.createDataFrame([("a", 3, '["x","y"]'), (None, None, "raw"), ("b", 1, "")], "s STRING, n INT, t STRING")
    rows = df.select(T.fill("<{0}|{1}>", F.col("s"), F.col("n")).alias("f"), T.decode_tags(F.col("t")).alias("t")).collect()
    assert [tuple(r) for r in rows] == [("<a|3>", ["x", "y"]), ("<|>", ["raw"]), ("<b|1>", [])]
