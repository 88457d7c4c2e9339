"""Language identification by bit-sliced Bloom filters over letter n-grams.

Every n-gram (four bytes of a lower-cased word with its borders) is counted in each
language over all learnable documents.  It belongs to the languages in which its
relative frequency is high enough, also beside the language that has it most, so
that passages in another language don't spread n-grams.  One filter holds all
languages: a slot has a bit for each of them, and the conjunction of a few slots is
the set of languages that contain the n-gram.  A text's n-grams are looked up, the
set bits are counted for each language and corrected for the filter's known rate of
false positives; the language with the highest corrected count wins.

Counts travel as sums for each task; the filter's size is fixed, whatever the corpus.

Defined results: `und` and score 0 for a null text, a text without a letter, and all
texts if nothing can be learnt; a text with letters but no known n-gram has the
language of most learnt n-grams and score 0; ties go to the name first in order; a
null doc_id is neither learnt from nor held out; repeated rows count as often as
they stand.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.llm import common as C
from linklens.llm import words as W

MOD, HELD_OUT = 4, 2
#: Bytes of an n-gram, slots of the filter, slots for an n-gram.
GRAM, SLOT_BITS, PLACES = 4, 21, 3
#: An n-gram is in a language with at least this share of the language's n-grams, and
#: this fraction of the share in the language that has it most.
LEAST_SHARE, LEAST_OF_BEST = 1e-6, 0.2
#: Different n-grams that a task holds before it hands them on.
HELD = 1 << 20
LETTERS = W.byte_set((0x61, 0x7A), (0x80, 0xFF))
COUNTS = "lang string, gram long, n long"
SCHEMA = "row long, doc_id long, lang_pred string, score double"


def grams_of(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams of words set between one blank and two, and how many each word has (its bytes)."""
    sizes = ends - starts
    room = np.concatenate([[0], np.cumsum(sizes + 3)])
    padded = np.full(room[-1], 0x20, dtype=np.uint8)
    inner = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    padded[np.repeat(room[:-1] + 1, sizes) + inner] = data[np.repeat(starts, sizes) + inner]
    at = np.repeat(room[:-1], sizes) + inner
    out = np.zeros(len(at), dtype=np.uint64)
    for k in range(GRAM):
        out = out << np.uint64(8) | padded[at + k]
    return out, sizes


class Vocabulary:
    """Distinct words of a slice, for each of some classes of documents if given."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, powers: W.Powers, classes: np.ndarray | None = None):
        low = W.lower_ascii(data)
        self.words = words = W.Words(low, bounds, LETTERS, powers)
        key = words.hash if classes is None else W.mix(words.hash, 3) + classes[words.doc].astype(np.uint64) * np.uint64(W.WORD_BASE)
        _, self.at, self.number, self.times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        self.grams, self.sizes = grams_of(low, words.starts[self.at], words.ends[self.at])


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the n-grams of each language in a task's documents."""
    powers, names = W.Powers(W.BYTE_BASE), {}
    held = np.zeros((0, 2), dtype=np.uint64), np.zeros(0, dtype=np.int64)

    def merged(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        flat = np.concatenate(keys)
        joined, inverse = np.unique(flat[:, 0] << np.uint64(32) | flat[:, 1], return_inverse=True)
        return np.stack([joined >> np.uint64(32), joined & np.uint64(0xFFFFFFFF)], axis=1), np.bincount(inverse, weights=np.concatenate(counts), minlength=len(joined)).astype(np.int64)

    def batch_of(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        langs = np.array(list(names), dtype=object)[keys[:, 0].astype(np.int64)] if len(keys) else []
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys[:, 1].astype(np.int64)), pa.array(counts)], names=["lang", "gram", "n"])

    for batch in batches:
        codes = np.array([names.setdefault(x, len(names)) for x in batch.column("lang").to_pylist()], dtype=np.int64)
        for low, high, data, bounds in W.slices(batch.column("text")):
            own = codes[low:high]
            v = Vocabulary(data, bounds, powers, own)
            lang = own[v.words.doc[v.at]]
            keys = np.stack([np.repeat(lang, v.sizes).astype(np.uint64), v.grams], axis=1)
            held = merged([held[0], keys], [held[1], np.repeat(v.times, v.sizes)])
            if len(held[1]) > HELD:
                yield batch_of(*held)
                held = held[0][:0], held[1][:0]
    yield batch_of(*held)


@dataclass
class Filter:
    languages: list[str]
    #: words of 64 languages, slots
    masks: np.ndarray
    prior: int

    def __post_init__(self):
        n = len(self.languages)
        bits = [(self.masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1) for i in range(n)]
        self.false_rate = np.array([float(b.mean()) ** PLACES for b in bits])

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram a row with one for each language that contains it."""
        out = np.zeros((len(grams), len(self.languages)), dtype=np.int32)
        places = slots_of(grams)
        for w in range(len(self.masks)):
            found = self.masks[w][places[0]]
            for p in places[1:]:
                found = found & self.masks[w][p]
            for i in range(w * 64, min(len(self.languages), w * 64 + 64)):
                out[:, i] = (found >> np.uint64(i % 64)) & np.uint64(1)
        return out


def slots_of(grams: np.ndarray) -> list[np.ndarray]:
    return [(W.mix(grams, 50 + k) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for k in range(PLACES)]


def slot_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        grams = batch.column("gram").to_numpy().astype(np.uint64)
        for at in slots_of(grams):
            yield pa.RecordBatch.from_arrays([pa.array(at), batch.column("word"), batch.column("mask")], names=["slot", "word", "mask"])


def fit(learnable: DataFrame) -> Filter:
    """The filter of all languages from rows with `text` and `lang`."""
    counts = learnable.select("text", "lang").mapInArrow(count_batches, COUNTS)
    counts = C.checkpointed(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = sorted((r.lang, r.total) for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect())  # one row for each language
    if not totals:
        return Filter([], np.zeros((0, 1 << SLOT_BITS), dtype=np.uint64), 0)
    languages = [lang for lang, _ in totals]
    sizes = counts.sparkSession.createDataFrame([(lang, i, total) for i, (lang, total) in enumerate(totals)], "lang string, code int, total long")
    shares = counts.join(F.broadcast(sizes), "lang").select("gram", "code", (F.col("n") / F.col("total")).alias("share"))
    best = shares.groupBy("gram").agg(F.max("share").alias("best"), F.collect_list(F.struct("code", "share")).alias("all"))  # as many as languages
    kept = best.select("gram", "best", F.explode("all").alias("x")).where((F.col("x.share") >= LEAST_SHARE) & (F.col("x.share") >= F.col("best") * LEAST_OF_BEST))
    words = kept.groupBy("gram", F.floor(F.col("x.code") / 64).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("x.code") % 64)).alias("mask"))
    slots = words.mapInArrow(slot_batches, "slot long, word int, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask"))
    masks = np.zeros((-(-len(languages) // 64), 1 << SLOT_BITS), dtype=np.uint64)
    found = slots.toArrow()  # a row for each slot at most
    masks[found.column("word").to_numpy(), found.column("slot").to_numpy()] = found.column("mask").to_numpy().astype(np.uint64)
    return Filter(languages, masks, int(np.argmax([total for _, total in totals])))


def predict_batches(batches: Iterator[pa.RecordBatch], model: Filter) -> Iterator[pa.RecordBatch]:
    powers = W.Powers(W.BYTE_BASE)
    names = np.array([*model.languages, "und"], dtype=object)
    n = len(model.languages)
    for batch in batches:
        letters = batch.column("letters").to_numpy(zero_copy_only=False)
        for low, high, data, bounds in W.slices(batch.column("text")):
            v = Vocabulary(data, bounds, powers)
            sums = np.zeros((high - low, n))
            total = np.zeros(high - low)
            if n and len(v.number):
                each = np.add.reduceat(model.hits(v.grams), np.cumsum(v.sizes) - v.sizes, axis=0)
                doc = v.words.doc
                for i in range(n):
                    sums[:, i] = np.bincount(doc, weights=each[v.number, i], minlength=high - low)
                total = np.bincount(doc, weights=v.sizes[v.number], minlength=high - low)
            true = np.maximum((sums - total[:, None] * model.false_rate) / (1 - np.minimum(model.false_rate, 0.999999)), 0)
            pick, score = np.full(high - low, n), np.zeros(high - low)
            if n:
                pick = np.argmax(true, axis=1)
                ordered = np.sort(true, axis=1)
                top, second = ordered[:, -1], ordered[:, -2] if n > 1 else 0.0
                some = top > 0
                score[some] = (top / np.maximum(top + second, 1e-300))[some]
                pick = np.where(some, pick, model.prior)
            nothing = ~letters[low:high]
            pick, score = np.where(nothing, n, pick), np.where(nothing, 0.0, score)
            yield pa.RecordBatch.from_arrays([batch.column("row").slice(low, high - low), batch.column("doc_id").slice(low, high - low),
                                              pa.array(names[pick], pa.string()), pa.array(score)], names=["row", "doc_id", "lang_pred", "score"])


def languages(docs: DataFrame, model: Filter) -> DataFrame:
    """row, doc_id, lang_pred, score of every row."""
    # of fixed size; an executor without this package could not read an instance of a class from a broadcast
    sent = docs.sparkSession.sparkContext.broadcast((model.languages, model.masks, model.prior))
    texts = C.text_of(docs).withColumn("letters", F.col("text").rlike(r"\p{L}"))
    return texts.mapInArrow(lambda batches: predict_batches(batches, Filter(*sent.value)), SCHEMA)


def op10_language_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    learnable = docs.where((C.crc_mod("doc_id", MOD) != HELD_OUT) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    held = F.coalesce(C.crc_mod("doc_id", MOD) == HELD_OUT, F.lit(False)).alias("held_out")
    return languages(docs, fit(learnable)).select("doc_id", held, "lang_pred", "score")


QUERIES = {"op10_language_masks": op10_language_masks}
ORACLES: dict[str, str] = {}
