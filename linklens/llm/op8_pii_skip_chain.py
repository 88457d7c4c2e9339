"""Personal data: fixed patterns, and a skip-chain conditional random field for their repetitions.

The base patterns give spans of four kinds.  Tokens that hold an `@` or several
digits are the nodes of a random field over the document.  Neighbouring tokens are
linked (chain), and so are distant tokens that are alike: the same last digits, or
the same name before the `@` (skip links, from each occurrence to the next, so that
their number is linear).  Nodes inside base spans are observed; the others get their
labels by loopy belief propagation, which carries the label of an address or number
to its repetitions in forms that no pattern matches.  Node weights are a multinomial
logistic regression and link weights log odds of label pairs, both learnt from the
base spans of a bounded sample of documents.  Nothing but the sample is shuffled.

Defined results: null and empty texts have no spans; a method span never overlaps a
base span; a document without an unobserved node has base spans only; counts are
those of the base; repeated rows are rows of their own.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.llm import common as C
from linklens.llm import words as W

KINDS = ("email", "ip", "card", "phone")
#: Documents with a digit or an @ that the weights are learnt from, at most.
SAMPLE = 2000
#: Digits that make a token a node; digits that make two nodes alike; rounds of messages; least marginal.
NODE_DIGITS, ALIKE_DIGITS, ROUNDS, CERTAIN = 4, 7, 12, 0.9
# patterns as fixed by the contract; atomic where that can't change a match, so that long runs cost linear time
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
EDGE = ".,;:!?\"'<>[]{}"
SCHEMA = "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each @: a name can't hold one."""
    limit, at = 0, text.find("@")
    while at >= 0:
        start = limit + len(text[limit:at].rstrip(LOCAL))
        found = DOMAIN.match(text, at) if start < at else None
        if found:
            yield start, found.end()
        limit = found.end() if found else at + 1
        at = text.find("@", limit)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind and start."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append((3, *m.span()))
    return out


@dataclass
class Node:
    start: int
    end: int
    number: int  # of its token
    text: str
    label: int = 0  # 1 + kind inside a base span, else 0


FEATURES = 16


def features(node: Node) -> np.ndarray:
    t, out = node.text, np.zeros(FEATURES)
    digits = [c for c in t if "0" <= c <= "9"]
    n, letters = len(digits), any(c.isalpha() for c in t)
    out[[0, 1 + (n > 6) + (n > 8) + (n > 12) + (n > 19)]] = 1
    out[6:16] = ("@" in t, n == len(t), letters, t.count(".") == 3, t.count(".") in (1, 2), t.startswith("+"), "-" in t, "(" in t or ")" in t, "=" in t,
                 13 <= n <= 19 and luhn("".join(digits)))
    return out


def likeness(node: Node) -> list[str]:
    """Keys that make nodes alike."""
    digits = "".join(c for c in node.text if "0" <= c <= "9")
    name = node.text.partition("@")[0].lower() if "@" in node.text else ""
    return ([f"d{digits[-ALIKE_DIGITS:]}"] if len(digits) >= NODE_DIGITS else []) + ([f"n{name}"] if name else [])


def links(nodes: list[Node]) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain links of neighbouring tokens, skip links of each node with the next one that is alike."""
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1].number == nodes[i].number + 1]
    last: dict[str, int] = {}
    skip = []
    for i, node in enumerate(nodes):
        for key in likeness(node):
            if key in last:
                skip.append((last[key], i))
            last[key] = i
    return chain, skip


@dataclass
class Field:
    weights: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels, log potentials
    skip: np.ndarray

    def marginals(self, nodes: list[Node]) -> np.ndarray:
        """Loopy belief propagation with observed nodes held."""
        k = len(KINDS) + 1
        own = np.stack([features(n) for n in nodes]) @ self.weights
        for i, n in enumerate(nodes):
            if n.label:
                own[i] = np.where(np.arange(k) == n.label, 0.0, -50.0)
        chain, skip = links(nodes)
        pairs = chain + skip
        if not pairs:
            p = np.exp(own - own.max(axis=1, keepdims=True))
            return p / p.sum(axis=1, keepdims=True)
        a = np.array([p[0] for p in pairs] + [p[1] for p in pairs])
        b = np.array([p[1] for p in pairs] + [p[0] for p in pairs])
        m = len(pairs)
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        one = np.concatenate([np.repeat(self.chain[None], len(chain), 0), np.repeat(self.skip[None], len(skip), 0)])
        potential = np.exp(np.concatenate([one, one.transpose(0, 2, 1)]))
        messages = np.zeros((2 * m, k))
        for _ in range(ROUNDS):
            belief = own.copy()
            np.add.at(belief, b, messages)
            x = belief[a] - messages[back]
            x = np.exp(x - x.max(axis=1, keepdims=True))
            new = np.log(np.einsum("ei,eij->ej", x, potential) + 1e-300)
            new -= new.max(axis=1, keepdims=True)
            if np.abs(new - messages).max() < 1e-6:
                break
            messages = 0.5 * messages + 0.5 * new
        np.add.at(own, b, messages)
        p = np.exp(own - own.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def nodes_of(text: str, tokens: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[Node]:
    """Nodes from (start, end, number) of tokens, with the label of the base span they touch."""
    out = []
    for start, end, number in tokens:
        raw = text[start:end]
        left = len(raw) - len(raw.lstrip(EDGE))
        word = raw.strip(EDGE)
        if word:
            out.append(Node(start + left, start + left + len(word), number, word))
    spans = sorted((a, b, kind) for kind, a, b in base)
    k = 0
    for node in out:
        while k < len(spans) and spans[k][1] <= node.start:
            k += 1
        for a, b, kind in spans[k:]:
            if a >= node.end:
                break
            if b > node.start:
                node.label = 1 + kind
                break
    return out


def tokens_of(data: np.ndarray, bounds: np.ndarray) -> tuple[W.Words, np.ndarray, np.ndarray]:
    """Words of a slice, which of them are nodes, and the code point at each byte."""
    words = W.Words(data, bounds)
    digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    ats = np.concatenate([[0], np.cumsum(data == 64)])
    some = np.flatnonzero((digits[words.ends] - digits[words.starts] >= NODE_DIGITS) | (ats[words.ends] > ats[words.starts]))
    return words, some, np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])


def fit(texts: list[str]) -> Field:
    """Weights from the base spans of some documents."""
    k = len(KINDS) + 1
    x, y, chain, skip = [], [], np.ones((k, k)), np.ones((k, k))
    for text in texts:
        data = np.frombuffer(text.encode(), dtype=np.uint8)
        words, some, points = tokens_of(data, np.array([0, len(data)]))
        nodes = nodes_of(text, [(int(points[words.starts[i]]), int(points[words.ends[i]]), int(i)) for i in some], base_spans(text))
        x += [features(n) for n in nodes]
        y += [n.label for n in nodes]
        for pairs, counts in zip(links(nodes), (chain, skip), strict=True):
            for i, j in pairs:
                counts[nodes[i].label, nodes[j].label] += 1
                counts[nodes[j].label, nodes[i].label] += 1
    weights = np.zeros((FEATURES, k))
    if x:
        x, y = np.stack(x), np.eye(k)[y]
        for step in range(600):
            p = np.exp(x @ weights)
            p /= p.sum(axis=1, keepdims=True)
            weights += 2.0 / (1 + step / 200) * (x.T @ (y - p) / len(x) - 1e-4 * weights)
    else:
        weights[0, 0] = 10

    def odds(counts: np.ndarray) -> np.ndarray:
        joint = counts / counts.sum()
        return np.log(joint / np.outer(joint.sum(axis=1), joint.sum(axis=0)))

    return Field(weights, odds(chain), odds(skip))


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def find_batches(batches: Iterator[pa.RecordBatch], model: Field) -> Iterator[pa.RecordBatch]:
    empty = hashlib.sha256(b"").hexdigest()
    for batch in batches:
        for low, high, data, bounds in W.slices(batch.column("text")):
            words, some, points = tokens_of(data, bounds)
            marks = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57) | (data == 64))])
            open_ = np.flatnonzero(np.diff(marks[bounds]))
            counts, digests, spans = np.zeros((len(KINDS), high - low), dtype=np.int64), [empty] * (high - low), [""] * (high - low)
            edges = np.searchsorted(words.doc[some], np.arange(high - low + 1))
            raw = data.tobytes()
            for d in open_.tolist():
                text = raw[bounds[d]:bounds[d + 1]].decode()
                base = base_spans(text)
                for kind, _, _ in base:
                    counts[kind, d] += 1
                all_ = list(base)
                own, begin = some[edges[d]:edges[d + 1]], points[bounds[d]]
                if len(own):
                    tokens = zip((points[words.starts[own]] - begin).tolist(), (points[words.ends[own]] - begin).tolist(), own.tolist(), strict=True)
                    nodes = nodes_of(text, list(tokens), base)
                    if any(not n.label for n in nodes):
                        for node, p in zip(nodes, model.marginals(nodes), strict=True):
                            label = int(np.argmax(p))
                            if not node.label and label and p[label] >= CERTAIN:
                                all_.append((label - 1, node.start, node.end))
                digests[d], spans[d] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_)
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(low, high - low), batch.column("doc_id").slice(low, high - low), *(pa.array(c) for c in counts),
                                              pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                                             names=["row", "doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])


def fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled weights of all rows of a task, in the order of the rows."""
    rows = sorted(r for b in batches for r in zip(b.column("row").to_pylist(), b.column("text").to_pylist(), strict=True))
    model = fit([text for _, text in rows])
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.weights, model.chain, model.skip))], pa.binary())], names=["model"])


def fit_on(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Weights from the first documents by hash, of those with a digit or an @; one task fits, the driver gets the weights."""
    texts = C.text_of(docs)
    marked = texts.where(F.col("text").rlike("[0-9@]"))
    chosen = marked.select("row").orderBy(F.xxhash64("row"), "row").limit(sample)
    found = texts.join(F.broadcast(chosen), "row").select("row", "text")  # as many rows as the sample has at most
    found = found.repartition(1).mapInArrow(fit_batches, "model binary").first()
    return fit([]) if found is None else Field(*pickle.loads(found.model))


def personal_data(docs: DataFrame, model: Field) -> DataFrame:
    """Counts, digest of the base spans and all spans of every row."""
    return C.text_of(docs).mapInArrow(lambda batches: find_batches(batches, model), SCHEMA)


def op8_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return personal_data(docs, fit_on(docs)).drop("row")


QUERIES = {"op8_pii_skip_chain": op8_pii_skip_chain}
ORACLES: dict[str, str] = {}
