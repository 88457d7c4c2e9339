"""Slow, plain Python model of page extraction for the tests: a real HTML parser and one pass per rule."""

import re
from collections import Counter
from html.parser import HTMLParser
from urllib.parse import parse_qsl, unquote, urljoin, urlsplit

from linklens import fixed_values as v
from linklens.functions.public_suffix import load_rules, tlds

RULES, TLDS = set(load_rules()), tlds()
LABEL = re.compile(r"[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?")


def registrable(host):
    labels = host.split(".")
    best = None
    for i in range(len(labels)):
        name = ".".join(labels[i:])
        if "!" + name in RULES:
            best = i + 1
            break
        if best is None and (name in RULES or "*." + ".".join(labels[i + 1:]) in RULES):
            best = i
    return ".".join(labels[best - 1:]) if best else None


def parts(raw, from_url):
    d = raw.strip().lower().split("://")[-1]
    d = re.split(r"[/?#:]", d)[0].strip(". ")
    labels = d.split(".")
    if len(labels) < 2 or len(d) > 253 or not all(LABEL.fullmatch(x) for x in labels) or d in v.RESERVED_DOMAINS:
        return None
    if re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", d) or labels[-1] not in TLDS or labels[-1] in v.FILE_EXTENSIONS:
        return None
    if not from_url and labels[-1] in v.DICTIONARY_TLDS:
        if len(labels) == 2 and (labels[0] in v.CODE_WORDS or len(labels[0]) <= 3):
            return None
        if len(labels) > 2 and labels[-2] in v.CODE_WORDS:
            return None
    root = registrable(d)
    return (d, root) if root else None


class Page(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.tags, self.scripts, self.styles, self.text, self.stack = [], [], [], [], []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        attrs = dict(attrs)
        self.tags.append((tag, attrs))
        if tag in ("script", "style", "noscript", "svg", "head", "title"):
            self.stack.append((tag, attrs))
        self.text.append(" ")

    def handle_endtag(self, tag):
        if self.stack and self.stack[-1][0] == tag:
            self.stack.pop()
        self.text.append(" ")

    def handle_data(self, data):
        if self.stack:
            tag, attrs = self.stack[-1]
            if tag == "script" and "src" not in attrs:
                self.scripts.append(data)
            if tag == "style":
                self.styles.append(data)
        else:
            self.text.append(data)


URL = re.compile(r"(?:https?:)?//([a-zA-Z0-9][-a-zA-Z0-9]*(?:\.[a-zA-Z0-9][-a-zA-Z0-9]*)+)(?::\d+)?(?:/[^\s\"'<>{}|\\^`\[\]]*)?", re.I)
RUN = re.compile(r"[a-zA-Z0-9.\-]+")


def text_hosts(text):
    """Hosts of URLs, then dotted names that stand alone; names are read off maximal runs of name characters."""
    out = [(m.group(1), True) for m in URL.finditer(text)]
    taken = 0
    for m in RUN.finditer(text):
        run, start = m.group(0), m.start()
        if start < taken:
            continue
        before = text[start - 1] if start else " "
        lead = len(run) - len(run.lstrip(".-"))
        if lead or before in "_/":
            continue
        labels, good, pos = run.split("."), None, 0
        for i, label in enumerate(labels):
            if not re.fullmatch(r"[a-zA-Z0-9]([a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?", label):
                break
            pos += len(label) + (1 if i else 0)
            after = text[start + pos] if start + pos < len(text) else " "
            if after == "_":
                break
            if i and re.fullmatch(r"[a-zA-Z]{2,24}", label):
                good = pos
        if good:
            after = text[start + good] if start + good < len(text) else " "
            port = re.compile(r":\d+(?![a-zA-Z0-9_-])").match(text, start + good)
            taken = port.end() if port else 0
            if after not in "(=[{;`<>":
                out.append((run[:good], False))
    return out


def hits(url, html, target_root):
    page, found = Page(html), Counter()
    base = next((urljoin(url, a["href"]) for t, a in page.tags if t == "base" and a.get("href")), url)

    def add(raw_host, from_url, source, external=True):
        p = parts(raw_host or "", from_url)
        if p and (external or p[1] == target_root):
            found[("subdomain" if p[1] == target_root else "external", p[0], source)] += 1

    def link(raw, source, query=True, external=True):
        raw = (raw or "").strip()
        if not raw or any(raw.startswith(x) for x in v.DEAD_LINK_PREFIXES):
            return
        full = urlsplit(urljoin(base, raw))
        if full.scheme not in ("http", "https"):
            return
        add(full.hostname, True, source, external)
        for _, val in parse_qsl(full.query) if query else []:
            val = unquote(val).strip() if len(val) >= 4 else ""
            if re.match(r"(https?:)?//", val):
                add(urlsplit(val).hostname, True, "query_param_url")
            elif "." in val and "/" not in val:
                add(val, False, "query_param_domain")

    add(urlsplit(url).hostname, True, "page_host", external=False)
    for t, a in page.tags:
        if t in ("a", "area"):
            link(a.get("href"), "link_href")
        if t == "meta" and (a.get("http-equiv") or "").lower() == "refresh":
            m = re.search(r"url\s*=\s*['\"]?([^'\";\s]+)", a.get("content") or "", re.I)
            if m:
                link(m.group(1), "meta_refresh", query=False)
        for names, attr in v.ASSET_SPECS:
            if t in names.split("|"):
                link(a.get(attr), f"link_{attr}")
    canonical = next((a for t, a in page.tags if t == "link" and "canonical" in (a.get("rel") or "")), {})
    link(canonical.get("href"), "canonical", query=False, external=False)
    for s in page.styles:
        for m in re.finditer(r"url\(\s*['\"]?([^'\")]+)['\"]?\s*\)", s, re.I):
            link(m.group(1), "css_url", query=False)
    for c in re.findall(r"<!--(.*?)-->", html, re.S):
        for h, u in text_hosts(c):
            add(h, u, "comment")
    for s in page.scripts:
        for m in re.finditer(r"/\*[\s\S]*?\*/|//[^\r\n]*|\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`", s):
            tok = m.group(0)
            inner = tok[1:-1] if tok[0] in "\"'`" else tok[2:-2] if tok.startswith("/*") else tok[2:]
            if len(inner) > 3:
                for h, u in text_hosts(inner):
                    add(h, u, "script_code")
        for pattern in (r"(?:window\.)?(?:location(?:\.href|\.assign|\.replace)?|open)\s*\(?\s*['\"]([^'\"]+)['\"]",
                        r"(?:fetch|\$\.(?:get|post|ajax)|axios(?:\.get|\.post)?)\s*\(\s*['\"]([^'\"]+)['\"]",
                        r"(?:url|path|endpoint|baseURL|apiUrl|targetUrl)\s*:\s*['\"]([^'\"]+)['\"]"):
            for m in re.finditer(pattern, s, re.I):
                if not m.group(1).strip().startswith(tuple(v.DEAD_ENDPOINT_PREFIXES)):
                    link(m.group(1), "script_endpoint", query=False)
    for h, u in text_hosts("".join(page.text)):
        add(h, u, "plain_text")
    return found
