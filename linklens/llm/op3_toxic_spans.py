"""Toxic spans and document scores from a linear-chain conditional random field.

Documents are labelled, tokens are not.  On a bounded sample of labelled documents
the features (word, prefixes) that set toxic documents apart are chosen greedily,
each for the toxic documents that no earlier one explains; the tokens that carry a
chosen feature in a toxic document are the labelled tokens.  A chain of two states
is then trained on them by gradient steps on the conditional likelihood, and every
document of the table is tagged with its marginals by the forward-backward
recursions.  A document's score is the calibrated marginal of its most toxic token,
which, unlike the chance of any toxic token, doesn't grow with the length; the
offending offsets are the tokens with a marginal of at least one half.

The recursions run on blocks of tokens of all documents of a slice at once: the
transfer matrices of the blocks are multiplied first, then chained, so that a long
document costs no more a token than a short one.  Nothing of the corpus is
shuffled but the sample, which one task fits on; the driver sees only weights.

Defined results: null and empty texts have no tokens, no spans and the score of a
document without a toxic token; a null doc_id is not held out; without labelled
rows of both classes every score is the one label there is, or 0; the same doc_id
labelled twice counts as toxic if either row says so.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.llm import common as C
from linklens.llm import words as W

#: Labelled documents of each class that the model is fitted on, at most.
SAMPLE = {1: 1200, 0: 2400}
HELD_OUT_MOD = 5
#: Weights are kept in 2**FEATURE_BITS places; prefixes are counted in bytes.
FEATURE_BITS, PREFIXES = 18, (4, 5, 6)
#: A feature labels tokens if toxic documents have it so many times as often, and if
#: it explains so many of them that no feature chosen before does.
RATIO, NEW_DOCUMENTS = 20.0, 3
BLOCK, EPOCHS, UPDATES, BATCH, RATE, DECAY = 64, 3, 300, 50, 0.5, 1e-6
SCHEMA = "row long, doc_id long, score double, starts array<long>, ends array<long>, marginals array<double>"


class Tokens:
    """Tokens of a slice and the numbers of their features, one column for each kind."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, powers: W.Powers):
        low = W.lower_ascii(data)
        words = W.Words(low, bounds, W.ALNUM)
        rolled = W.Rolling(low.astype(np.uint64) + np.uint64(1), powers)
        self.data, self.starts, self.ends, self.first, self.doc = low, words.starts, words.ends, words.first, words.doc
        kinds = [rolled.stretch(self.starts, self.ends)] + [rolled.stretch(self.starts, np.minimum(self.starts + n, self.ends)) for n in PREFIXES]
        self.features = np.stack([W.mix(h, i) >> np.uint64(64 - FEATURE_BITS) for i, h in enumerate(kinds)], axis=1).astype(np.int64) if len(self.starts) else np.zeros((0, 1 + len(PREFIXES)), np.int64)


def tokens_of(texts: list[str], powers: W.Powers, together: int = 100) -> SimpleNamespace:
    """Feature numbers and documents of the tokens of a list of texts."""
    parts = []
    for low in range(0, len(texts), together):
        raw = [t.encode() for t in texts[low:low + together]]
        parts.append(Tokens(np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64), powers))
    counts = np.concatenate([np.diff(p.first) for p in parts])
    return SimpleNamespace(features=np.concatenate([p.features.astype(np.int32) for p in parts]), first=np.concatenate([[0], np.cumsum(counts)]),
                           doc=np.repeat(np.arange(len(texts)), counts))


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    #: log potentials of start (2) and of transitions (2 x 2); state 1 is toxic
    start: np.ndarray
    moves: np.ndarray
    scale: float = 1.0
    shift: float = 0.0

    def emission(self, features: np.ndarray) -> np.ndarray:
        return self.bias + self.weights[features].sum(axis=1)

    def score(self, odds: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * odds + self.shift, -500, 500)))


def plain(model: Model) -> tuple:
    """A model as arrays and numbers: an executor without this package could not read an instance from a broadcast."""
    return model.weights, model.bias, model.start, model.moves, model.scale, model.shift


def chain(first: np.ndarray, emission: np.ndarray, model: Model, pairs: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic state, log odds of each document's largest, and expected counts of the moves."""
    lengths = np.diff(first)
    blocks = -(-lengths // BLOCK)
    base = np.concatenate([[0], np.cumsum(blocks)])
    n = int(base[-1])
    odds = np.full(len(lengths), -30.0)
    counts = np.zeros((2, 2))
    if n == 0:
        return np.zeros(0), odds, counts
    doc = np.repeat(np.arange(len(lengths)), lengths)
    place = base[doc] * BLOCK + np.arange(len(emission)) - first[doc]
    x = np.exp(np.clip(emission, -40, 40))
    m, s = np.exp(model.moves), np.exp(model.start)
    # step matrices; padding is the identity, the first token of a document comes from a start state
    step = np.zeros((2, 2, n * BLOCK))
    step[0, 0] = step[1, 1] = 1
    step[0, 0, place], step[0, 1, place], step[1, 0, place], step[1, 1, place] = m[0, 0], m[0, 1] * x, m[1, 0], m[1, 1] * x
    has = lengths > 0
    opening = place[first[:-1][has]]
    step[0, 0, opening], step[0, 1, opening], step[1, 0, opening], step[1, 1, opening] = s[0], s[1] * x[first[:-1][has]], 0, 0
    step = np.ascontiguousarray(step.reshape(2, 2, n, BLOCK).transpose(3, 0, 1, 2))
    whole = np.zeros((2, 2, n))
    whole[0, 0] = whole[1, 1] = 1
    for t in range(BLOCK):
        a = step[t]
        whole = np.stack([whole[:, 0] * a[0, 0] + whole[:, 1] * a[1, 0], whole[:, 0] * a[0, 1] + whole[:, 1] * a[1, 1]], axis=1)
        whole /= whole.max(axis=(0, 1))
    entry, leave = np.zeros((2, n)), np.zeros((2, n))
    order = np.argsort(-blocks, kind="stable")
    v = np.zeros((2, len(lengths)))
    v[0] = 1
    deepest = int(blocks.max())
    many = np.searchsorted(-blocks[order], -np.arange(deepest), "left")  # documents with more blocks than k
    for k in range(deepest):
        docs = order[:many[k]]
        at = base[docs] + k
        entry[:, at] = v[:, docs]
        w = v[0, docs] * whole[0][:, at] + v[1, docs] * whole[1][:, at]
        v[:, docs] = w / w.sum(axis=0)
    u = np.ones((2, len(lengths)))
    for k in range(deepest - 1, -1, -1):
        docs = order[:many[k]]
        at = base[docs] + k
        leave[:, at] = u[:, docs]
        w = whole[:, 0][:, at] * u[0, docs] + whole[:, 1][:, at] * u[1, docs]
        u[:, docs] = w / w.sum(axis=0)
    before, forward, backward = np.zeros((BLOCK, 2, n)), np.zeros((BLOCK, 2, n)), np.zeros((BLOCK, 2, n))
    a = entry
    for t in range(BLOCK):
        before[t] = a
        a = a[0] * step[t, 0] + a[1] * step[t, 1]
        a /= a.sum(axis=0)
        forward[t] = a
    b = leave
    for t in range(BLOCK - 1, -1, -1):
        backward[t] = b
        b = step[t, :, 0] * b[0] + step[t, :, 1] * b[1]
        b /= b.sum(axis=0)
    both = forward * backward
    toxic = (both[:, 1] / both.sum(axis=1)).T.reshape(-1)[place]
    if pairs:
        joint = before[:, :, None] * step * backward[:, None]
        joint /= joint.sum(axis=(1, 2), keepdims=True)
        inner = np.ones(len(emission), dtype=bool)
        inner[first[:-1][has]] = False
        counts = joint.transpose(1, 2, 3, 0).reshape(2, 2, -1)[:, :, place[inner]].sum(axis=2)
    top = np.clip(np.maximum.reduceat(toxic, first[:-1][has]), 1e-13, 1 - 1e-13)
    odds[has] = np.log(top / (1 - top))
    return toxic, odds, counts


def chosen_features(tokens: SimpleNamespace, toxic: np.ndarray) -> np.ndarray:
    """Which features label tokens: far more frequent in toxic documents, and needed to explain some of them."""
    kinds, docs = tokens.features.shape[1], len(toxic)
    pairs = np.unique(np.concatenate([np.unique(tokens.features[:, k].astype(np.int64) * docs + tokens.doc) for k in range(kinds)]))
    feature, doc = pairs // docs, pairs % docs
    size = 1 << FEATURE_BITS
    in_toxic = np.bincount(feature, weights=toxic[doc], minlength=size)
    in_clean = np.bincount(feature, weights=1 - toxic[doc], minlength=size)
    n1, n0 = toxic.sum(), docs - toxic.sum()
    ratio = ((in_toxic + 0.5) / (n1 + 1)) / ((in_clean + 0.5) / (n0 + 1))
    able = np.flatnonzero((ratio >= RATIO) & (in_toxic >= NEW_DOCUMENTS))
    able = able[np.argsort(-in_toxic[able], kind="stable")]
    open_, out = toxic.astype(bool).copy(), np.zeros(size, dtype=bool)
    low, high = np.searchsorted(feature, able, "left"), np.searchsorted(feature, able, "right")
    for f, a, b in zip(able, low, high, strict=True):
        new = doc[a:b][open_[doc[a:b]]]
        if len(new) >= NEW_DOCUMENTS:
            out[f] = True
            open_[new] = False
    return out


def one_of_each(tokens: SimpleNamespace, docs: int) -> np.ndarray:
    """Documents of the sample without near copies: the first of those with the same smallest five-word hash."""
    h = W.mix(tokens.features[:, 0].astype(np.uint64))
    five = W.Rolling(h, W.Powers(W.WORD_BASE)).windows(5) if len(h) >= 5 else np.zeros(0, np.uint64)
    five = W.mix(five)
    key = np.arange(docs, dtype=np.uint64)
    for d in range(docs):
        a, b = tokens.first[d], tokens.first[d + 1] - 4
        if b > a:
            key[d] = five[a:b].min()
    keep = np.zeros(docs, dtype=bool)
    keep[np.unique(key, return_index=True)[1]] = True
    return keep


def fit(texts: list[str], toxic: np.ndarray, seed: int = 0) -> Model:
    """Weights from labelled texts; toxic: 0 or 1 for each."""
    size = 1 << FEATURE_BITS
    model = Model(np.zeros(size), -3.0, np.zeros(2), np.array([[0.0, 0.0], [0.0, 0.0]]))
    if len(set(toxic.tolist())) < 2:
        model.scale, model.shift = 0.0, 700.0 if len(toxic) and toxic[0] else -700.0
        return model
    powers = W.Powers(W.BYTE_BASE)

    keep = one_of_each(tokens_of(texts, powers), len(texts))
    texts, toxic = [t for t, k in zip(texts, keep, strict=True) if k], toxic[keep]
    if len(set(toxic.tolist())) < 2:
        return fit([], toxic[:1])
    tokens = tokens_of(texts, powers)
    names = chosen_features(tokens, toxic)
    tagged = names[tokens.features].any(axis=1) & (toxic[tokens.doc] == 1)
    squares, rng = np.full(size, 1e-2), np.random.default_rng(seed)
    small = np.full(7, 1e-2)  # bias, start of the toxic state, moves
    batches = max(1, len(texts) // BATCH)
    for _ in range(max(EPOCHS, -(-UPDATES // batches))):
        for some in np.array_split(rng.permutation(len(texts)), batches):
            at = np.concatenate([np.arange(tokens.first[d], tokens.first[d + 1]) for d in some])
            if not len(at):
                continue
            first = np.concatenate([[0], np.cumsum(np.diff(tokens.first)[some])])
            features, truth = tokens.features[at], tagged[at].astype(float)
            got, _, counts = chain(first, model.emission(features), model, pairs=True)
            error = truth - got
            g = np.bincount(features.ravel(), weights=np.repeat(error, features.shape[1]), minlength=size) - DECAY * model.weights
            squares += g * g
            model.weights += RATE * g / np.sqrt(squares)
            opening = first[:-1][np.diff(first) > 0]
            inner = np.setdiff1d(np.arange(1, len(at)), opening)
            seen = np.bincount((2 * truth[inner - 1] + truth[inner]).astype(int), minlength=4).reshape(2, 2)
            d = np.concatenate([[error.sum(), error[opening].sum()], (seen - counts).ravel()]) / len(at)
            small[:6] += d * d
            d = 0.1 * d / np.sqrt(small[:6])
            model.bias += d[0]
            model.start[1] += d[1]
            model.moves += d[2:].reshape(2, 2)
    odds = []
    for low in range(0, len(texts), BATCH):
        first = tokens.first[low:low + BATCH + 1]
        odds.append(chain(first - first[0], model.emission(tokens.features[first[0]:first[-1]]), model)[1])
    odds = np.concatenate(odds)
    a, b = 1.0, 0.0
    x = np.clip(odds, -30, 30) / 10
    for _ in range(2000):  # two parameters
        e = (toxic - 1 / (1 + np.exp(-(a * x + b)))) / len(toxic)
        a, b = a + 2 * (e @ x) - 1e-4 * a, b + 2 * e.sum()
    model.scale, model.shift = a / 10, b
    return model


def fit_on(docs: DataFrame, labels: DataFrame, mod: int = HELD_OUT_MOD, sample: dict[int, int] | None = None) -> Model:
    """Fits on a sample of the labelled documents that are not held out: the first by hash of the id, of each class."""
    marked = (labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
              .agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(C.crc_mod("doc_id", mod) != 0))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = [marked.where(F.col("toxic") == k).orderBy(*order).limit(n) for k, n in (sample or SAMPLE).items()]
    chosen = some[0].unionByName(some[1])
    rows = C.text_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "toxic", "text")  # as many ids as the sample has at most
    # where a doc_id repeats, one of its texts is taken, so that the bound holds; one task fits, the driver gets the weights
    found = rows.groupBy("doc_id", "toxic").agg(F.max("text").alias("text")).repartition(1).mapInArrow(fit_batches, "model binary").first()
    if found is None:  # no labelled document
        return fit([], np.zeros(0, dtype=np.int64))
    weights, *rest = pickle.loads(found.model)
    return Model(np.frombuffer(weights, dtype=np.float32), *rest)


def fit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pickled model of all rows of a task, in the order of their ids."""
    rows = sorted(r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "toxic", "text")), strict=True))
    model = fit([t for _, _, t in rows], np.array([k for _, k, _ in rows], dtype=np.int64))
    weights, *rest = plain(model)
    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((weights.astype(np.float32).tobytes(), *rest))], pa.binary())], names=["model"])


def tag_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    powers = W.Powers(W.BYTE_BASE)
    for batch in batches:
        for low, high, data, bounds in W.slices(batch.column("text"), 1 << 20):
            tokens = Tokens(data, bounds, powers)
            toxic, odds, _ = chain(tokens.first, model.emission(tokens.features), model)
            hit = np.flatnonzero(toxic >= 0.5)
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            begin = points[bounds[:-1]][tokens.doc[hit]]
            split = np.concatenate([[0], np.cumsum(np.bincount(tokens.doc[hit], minlength=high - low))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(split, pa.array(x)) for x in
                     (points[tokens.starts[hit]] - begin, points[tokens.ends[hit]] - begin, toxic[hit])]
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(low, high - low), batch.column("doc_id").slice(low, high - low),
                                              pa.array(model.score(odds)), *lists],
                                             names=["row", "doc_id", "score", "starts", "ends", "marginals"])


def toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """row, doc_id, score, and the code point offsets and marginals of the offending tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(plain(model))  # of the size of the weights, whatever the corpus
    return C.text_of(docs).mapInArrow(lambda batches: tag_batches(batches, Model(*sent.value)), SCHEMA)


def clean_batches(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """Whole rows with a score below one half."""
    powers = W.Powers(W.BYTE_BASE)
    for batch in batches:
        at = batch.schema.get_field_index("text")
        for low, high, data, bounds in W.slices(pc.fill_null(batch.column(at), ""), 1 << 20):
            tokens = Tokens(data, bounds, powers)
            _, odds, _ = chain(tokens.first, model.emission(tokens.features), model)
            yield batch.slice(low, high - low).filter(pa.array(model.score(odds) < 0.5))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score below one half, with all their columns; nothing but the sample is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(plain(fit_on(docs, labels)))
    return docs.mapInArrow(lambda batches: clean_batches(batches, Model(*sent.value)), docs.schema)


def op3_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    scored = toxicity(docs, fit_on(docs, C.table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(C.crc_mod("doc_id", HELD_OUT_MOD) == 0, F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("starts").cast("long").alias("n_spans"),
                         F.concat_ws(",", F.zip_with("starts", "ends", lambda a, b: F.concat_ws(":", a, b))).alias("spans"))


QUERIES = {"op3_toxic_spans": op3_toxic_spans}
ORACLES: dict[str, str] = {}
