"""Extraction against the plain Python model, and long or broken input."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from linklens.operators import extract as X
from linklens.operators import rollup as R
from tests import brute

PAGES = [
    ("https://www.site.com/a/b?x=1", """<!DOCTYPE html><html><head><title> T &amp; x </title><base href="/docs/">
<meta http-equiv="refresh" content="5; url=https://go.redir.net/x"><link rel="canonical" href="https://www.site.com/c">
<link rel=stylesheet href="//cdn.styles.io/a.css"><style>p{background:url('https://img.bg.org/x.png')}</style>
<script src="https://js.lib.net/a.js?u=https%3A%2F%2Fhid.den.com%2Fp&d=naked.value.org"></script>
<script>var u="https://api.third.io/v1"; window.open("/p2"); fetch('https://f.etch.dev/x'); // see comment.site.org
e.target; a.href="x.click"; location.replace('//nav.io/'); t = {url: "rel/p", endpoint:'https://e.nd.co.uk'}</script></head>
<body><a href="guide.html">g</a> <a href='https://sub.site.com/x.pdf'>pdf</a>
<a href="https://partner.org/p?to=//inner.red.com/x&amp;q=abc&amp;d=short.io">partner</a><!-- old.cdn.com and http://c.omm.ent/x -->
<img src=https://pic.host.cn/1.png data-src="/l.png" data-original='https://lazy.host.cn/2.png'>
<iframe src="https://frame.co.uk"></iframe><form action="/post"></form><area href="https://area.gov.cn/">
<video src="https://v.media.tv/m"><source src="https://s.media.tv/m"></video><object data="https://obj.net/o"></object><embed src="https://emb.net/e">
<noscript>hidden.noscript.com</noscript><svg><text>hidden.svg.com</text></svg>
Visit www.text.com, mail bob@mail.host.com and foo.com.au( or window.open( x.html y.js 1.2.3.4 a.top
https://plain.url.com:8080/p/q?x=1 www.site.com, naked.org:8443 dash-.com -lead.com under_score.com path/inner.com
sub.a.b.city.kawasaki.jp item.show data.map.page deep.co.uk trailing.net. </body></html>"""),
    ("http://other.example.net/", "<p>no body tag: see me@x.example.net, y.example.org and HTTPS://Upper.CASE.com/Path</p><a href=//proto.rel.io/x>x</a><a>none</a><a href=''>e</a><a href=mailto:q@w.com>m</a>"),
    ("https://broken.site.com/", "<a href='https://ok.one.com'>1<a href=\"https://ok.two.com\">2</a>"),
    ("https://empty.site.com/", ""),
    ("not a url", "<a href='/x'>x</a> text.only.org"),
]


def frame(spark, pages):
    rows = [(1, u, h, "html", "www.site.com") for u, h in pages]
    return spark.createDataFrame(rows, "task_id INT, page_url STRING, html STRING, resource STRING, target_host STRING")


def found(spark, pages):
    rows = X.extract_hits(frame(spark, pages)).groupBy("page_url", "side", "domain", "source_type").count().collect()
    return Counter({(r["page_url"], r["side"], r["domain"], r["source_type"]): r["count"] for r in rows})


def expected(pages):
    out = Counter()
    for u, h in pages:
        for (side, domain, source), n in brute.hits(u, h, "site.com").items():
            out[(u, side, domain, source)] += n
    return out


@pytest.mark.parametrize("page", PAGES, ids=lambda p: p[0])
def test_pages(spark, page):
    assert found(spark, [page]) == expected([page])


def test_unclosed_script_is_read_to_the_end(spark):
    rows = found(spark, [("https://www.site.com/", "<p>x</p><script>var a = 'https://uno.tres.io/x';")])
    assert ("https://www.site.com/", "external", "uno.tres.io", "script_code") in rows


def test_random_texts(spark):
    rnd = random.Random(7)
    pieces = ["a.com", "b-c.org", "x_y.net", "www.site.com", ".", "..", "-", "_", "/", "//", "http://", "https://q.io", ":", ":80", ":8a", "(", "=", ";", "`", " ", " ", "\n",
              "1.2", "e.top", "window.open", "co.uk", "x.co.uk", "@", "é", "www", "com", "A.B.Com", "z.js", ",", "'", '"', "?q=1", "#f"]
    pages = []
    for i in range(300):
        text = "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 30))).replace("<", "")
        pages.append((f"https://www.site.com/{i}", f"<body>{text}</body>"))
    assert found(spark, pages) == expected(pages)


def test_long_input_does_not_overflow(spark):
    long_name = ".".join(["a"] * 60000) + ".com"
    html = (f"<p>{long_name} {'1.' * 60000}x {'a-' * 60000} real.one.com</p><script>var s = \"{'x' * 200000}\\\\\" + 'two.real.net'; /*{'*' * 100000}*/</script>"
            f"<a href=\"https://three.io/{'p' * 100000}\">{'t' * 100000}</a><!--{'-' * 100000} four.org-->")
    rows = found(spark, [("https://www.site.com/long", html)])
    assert {k[2] for k in rows} == {"www.site.com", "real.one.com", "two.real.net", "three.io", "four.org"}


def test_page_with_very_many_links_keeps_them_all(spark):
    html = "".join(f'<a href="https://h{i}.com/">x</a>' for i in range(20000))
    hits = X.extract_hits(frame(spark, [("https://www.site.com/hub", html)]))
    assert hits.where("side = 'external'").select("domain").distinct().count() == 20000


def test_counts_are_whole_and_evidence_is_capped(spark):
    html = '<a href="https://many.io/">x</a>' * 50
    hits = X.extract_hits(frame(spark, [("https://www.site.com/1", html), ("https://www.site.com/2", html)])).where("domain = 'many.io'")
    assert R.domain_rollup(hits).first()["occurrence_count"] == 100
    capped = X.cap_evidence(hits)
    assert capped.count() == 10
    assert capped.agg(F.max("seq")).first()[0] < hits.agg(F.max("seq")).first()[0]


def test_attachments_of_the_own_site_can_count_as_external(spark):
    page = frame(spark, [("https://www.site.com/", '<a href="/f.pdf">f</a><a href="/p">p</a>')])
    sides = lambda **kw: Counter(r["side"] for r in X.extract_hits(page, **kw).where("source_type = 'link_href'").collect())
    assert sides() == {"subdomain": 2}
    assert sides(own_attachments_as_external=True) == {"subdomain": 2, "external": 1}


def test_snippets(spark):
    html = "<body>" + "w" * 100 + " here.com\nand " + "v" * 100 + "</body>"
    row = X.extract_hits(frame(spark, [("https://www.site.com/", html)])).where("domain = 'here.com'").first()
    text = " " + "w" * 100 + " here.com\nand " + "v" * 100 + " "
    i = text.index("here.com")
    assert row["context_snippet"] == "..." + text[i - 60:i + 68].replace("\n", " ").strip() + "..."


#: Pages with the rows they must give, written out: (side, domain, source_type) of all hits but the page's own host.
PROBES = [
    ('<!-- c -->Source: <a href="https://lost1.org/x">x</a>', {("external", "lost1.org", "link_href")}),
    ('<!-- c -->Link to <a href="https://lost2.org/x">x</a>', {("external", "lost2.org", "link_href")}),
    ('<!-- <script>var u = "https://insc.org/a";</script> -->', {("external", "insc.org", "comment")}),
    ('<!-- <style>p{background:url(https://incss.org/a.png)}</style> -->', {("external", "incss.org", "comment")}),
    ('<textarea><a href="https://area.org/x">x</a></textarea>', set()),  # no link: the content is text, and its tags are taken off
    ('<a href="https&#58;//numeric.org/&#x61;">x</a>', {("external", "numeric.org", "link_href")}),
    ('<a href="https:&sol;&sol;named.org/">x</a>', {("external", "named.org", "link_href")}),
    ('<script>var a = "<!-- https://kept.org/x -->";</script>', {("external", "kept.org", "script_code")}),
]


@pytest.mark.parametrize("html,rows", PROBES, ids=lambda x: x[:30] if isinstance(x, str) else "")
def test_probe_pages(spark, html, rows):
    got = {(side, domain, source) for _, side, domain, source in found(spark, [("https://www.site.com/", html)]) if source != "page_host"}
    assert got == rows


def test_probe_links(spark):
    pages = frame(spark, [("https://www.site.com/", '<!-- c -->Link to <a href="/inner">x</a><link rel="stylesheet" href="/theme.php?v=1"><link rel=icon href="/i.php">')])
    got = {(r["url"], r["kind"]) for r in X.discover_links(pages).collect()}
    assert got == {("https://www.site.com/inner", "page"), ("https://www.site.com/theme.php?v=1", "css")}


def test_named_references(spark):
    import html

    texts = ["&copy; &eacute;&Eacute; &notin; &NotEqualTilde; x", "&amp;lt; &amp;amp;copy;", "&nosuchname; & &; &amp", "a&lt;b&gt;c&#233;&copy;&#xe9;", "it&apos;s &quot;q&quot; &middot;", "back\\slash &bsol; &apos; '"]
    df = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING").select("i", X.decode_entities(F.col("t")).alias("d"))
    got = {r.i: r.d for r in df.collect()}
    assert got == {i: html.unescape(t) if "&amp" != t[-4:] else t for i, t in enumerate(texts)}


def test_evidence_of_a_page_stored_twice_has_its_own_ids(spark, tmp_path):
    from linklens.plans import scan

    html = '<a href="https://a.io/{0}">x</a><a href="https://a.io/2{0}">x</a>'
    pages = spark.createDataFrame([(1, "https://www.site.com/p", html.format(n), "html", "www.site.com") for n in "xy"],
                                  "task_id INT, page_url STRING, html STRING, resource STRING, target_host STRING")
    rules = spark.createDataFrame([], "id INT, domain STRING, match_type STRING, risk_level STRING, category STRING, tags ARRAY<STRING>, remark STRING")
    run = F.lit("2030-01-01").cast("timestamp")
    rows = scan.write_scan(pages, rules, run, str(tmp_path), per_domain=5)[2].collect()
    assert len(rows) == 6 and len({r.id for r in rows}) == 6
