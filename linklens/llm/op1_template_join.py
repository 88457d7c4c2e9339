"""Benchmark decontamination by a hash join of canonical templates.

Tokens are canonicalised: one with a digit and number words become <num>, a unit
after a number <unit>, a capitalised token inside a sentence <name>, all others are
lower-cased.  Windows of five template tokens of the benchmark items and of the
documents are joined by their hashes.  Where windows meet, the placeholders' original
values are aligned, for each item and each shift between document and item: an item
value stands for the document value that it meets in more than half of its places, if
that meets it in more than half of its own.  A window counts if its values are the
item's, or if it has none, or if all of them stand for what they meet; a window with
another value doesn't, and takes no other window with it.  So a question with other
numbers and names is caught, and a chance meeting of placeholders isn't.  A document
is contaminated by an item if at least 80 per cent of the item's windows count, and
its kind is verbatim if none of these has a changed value.

Documents are scanned in place.  A Bloom filter of fixed size over the items'
windows lets only windows that may meet leave the scan; the join decides.

Defined results: null and empty texts match nothing; an item with fewer tokens than a
window is never matched, since so few words say nothing; items with equal texts are
reported each; a repeated document row is reported each time; a null doc_id or
item_id is kept as it is.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.llm import common as C
from linklens.llm import words as W

WINDOW, SHARE, FILTER_BITS = 5, 80, 24
# fixed values: number words and units
NUMBER_WORDS = ("one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty", "thirty", "forty", "fifty",
                "hundred", "thousand", "million", "half", "dozen")
UNITS = ("m", "km", "cm", "mm", "g", "kg", "mg", "l", "ml", "s", "ms", "h", "hour", "hours", "minute", "minutes", "second", "seconds", "day", "days", "week",
         "weeks", "month", "months", "year", "years", "mile", "miles", "foot", "feet", "inch", "inches", "pound", "pounds", "dollar", "dollars", "euro", "euros",
         "cent", "cents", "percent", "degrees", "meters", "metres", "kilometers", "kilograms", "grams", "liters", "litres")
NUM, UNIT, NAME = (np.uint64(0xA0761D6478BD642F + k) for k in range(3))
ROWS = "row long, id long, pos long, windows long, h1 long, h2 long, slots array<struct<at: int, word: string>>"

SLOTS = pa.list_(pa.struct([("at", pa.int32()), ("word", pa.string())]))


def hashes_of(words: tuple[str, ...], powers: W.Powers) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), dtype=np.uint8)
    return W.Words(data, np.array([0, len(data)]), W.ALNUM, powers).hash


class Templates:
    """Canonical tokens of a slice and the hashes of their windows."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, powers: tuple[W.Powers, W.Powers, W.Powers], numbers: np.ndarray, units: np.ndarray):
        alnum = W.ALNUM.copy()
        alnum[65:91] = True
        self.words = words = W.Words(W.lower_ascii(data), bounds, alnum, powers[0])
        self.whole, n = np.zeros(0, dtype=np.int64), len(words.starts)
        digits = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
        stops = np.concatenate([[0], np.cumsum(W.byte_set((0x0A, 0x0A), (0x21, 0x21), (0x2E, 0x2E), (0x3A, 0x3A), (0x3F, 0x3F))[data])])
        number = (digits[words.ends] > digits[words.starts]) | np.isin(words.hash, numbers)
        opens = np.ones(n, dtype=bool)
        opens[1:] = (words.doc[1:] != words.doc[:-1]) | (stops[words.starts[1:]] > stops[words.ends[:-1]])
        first = data[words.starts]
        second = data[np.minimum(words.starts + 1, max(len(data) - 1, 0))] if n else first
        capital = (first >= 65) & (first <= 90) | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
        after_number = np.zeros(n, dtype=bool)
        after_number[1:] = number[:-1] & (words.doc[1:] == words.doc[:-1])
        unit = after_number & ~number & np.isin(words.hash, units)
        name = capital & ~opens & ~number & ~unit
        self.slot = number | unit | name
        token = np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, words.hash)))
        if n >= WINDOW:
            self.whole = np.flatnonzero(words.left()[:n - WINDOW + 1] >= WINDOW)
            self.h1 = W.mix(W.Rolling(token, powers[1]).windows(WINDOW))[self.whole]
            self.h2 = W.mix(W.Rolling(W.mix(token, 5), powers[2]).windows(WINDOW), 7)[self.whole]
        self.windows = np.bincount(words.doc[self.whole], minlength=len(bounds) - 1)

    def slots(self, at: int, raw: bytes) -> list[tuple[int, str]]:
        """The places in the window at a word that are placeholders, and the original tokens behind them."""
        s, e = self.words.starts, self.words.ends
        return [(i - at, raw[s[i]:e[i]].decode()) for i in range(at, at + WINDOW) if self.slot[i]]


def window_batches(batches: Iterator[pa.RecordBatch], bits: bytes | None) -> Iterator[pa.RecordBatch]:
    """Windows of texts (row, id, text); with a filter, those that may be in it."""
    powers = W.Powers(W.BYTE_BASE), W.Powers(W.WORD_BASE), W.Powers(W.WORD_BASE_2)
    numbers, units = hashes_of(NUMBER_WORDS, powers[0]), hashes_of(UNITS, powers[0])
    known = W.Bits(FILTER_BITS, bits) if bits is not None else None
    for batch in batches:
        for low, _, data, bounds in W.slices(batch.column("text")):
            t = Templates(data, bounds, powers, numbers, units)
            some = np.arange(len(t.whole)) if known is None or not len(t.whole) else np.flatnonzero(known.has(t.h1))
            if not len(some):
                continue
            at, raw = t.whole[some], data.tobytes()
            docs = t.words.doc[at]
            rows, ids = (batch.column(c).take(pa.array(docs + low)) for c in ("row", "id"))
            yield pa.RecordBatch.from_arrays([
                rows, ids, pa.array(at - t.words.first[docs]), pa.array(t.windows[docs]), pa.array(t.h1[some].view(np.int64)), pa.array(t.h2[some].view(np.int64)),
                pa.array([[{"at": k, "word": w} for k, w in t.slots(i, raw)] for i in at.tolist()], SLOTS)], names=["row", "id", "pos", "windows", "h1", "h2", "slots"])


def filter_of(windows: DataFrame) -> bytes:
    """A Bloom filter of fixed size over the first hashes."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = W.Bits(FILTER_BITS)
        for batch in batches:
            bits.add(batch.column("h1").to_numpy().view(np.uint64))
        words = bits.data.view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(words[at])], names=["at", "bits"])

    found = windows.select("h1").mapInArrow(fill, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.tobytes()


def counted_batches(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """The windows of each shift that count, and whether one of them has a changed value."""
    for batch in batches:
        places, changed = [], []
        for met in batch.column("met"):
            windows = [(w["pos"], [(w["pos"] + i["at"], i["word"], d["word"]) for i, d in zip(w["item"], w["doc"], strict=True)]) for w in met.as_py()]
            filled = {at: (i, d) for _, slots in windows for at, i, d in slots}.values()  # a place once, in however many windows it is
            both, item, doc = Counter(filled), Counter(i for i, _ in filled), Counter(d for _, d in filled)
            stand = {(i, d) for (i, d), n in both.items() if 2 * n > item[i] and 2 * n > doc[d]}
            ok = [(pos, slots) for pos, slots in windows if all(i == d for _, i, d in slots) or all((i, d) in stand for _, i, d in slots)]
            places.append([pos for pos, _ in ok])
            changed.append(any(i != d for _, slots in ok for _, i, d in slots))
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(places, pa.list_(pa.int64())), pa.array(changed, pa.bool_())], names=[*keys, "places", "changed"])


def leaks(docs: DataFrame, items: DataFrame, share: int = SHARE) -> DataFrame:
    """row, doc_id, item_id, n_windows, item_windows, share, kind: the pairs of a document and an item that it holds."""
    texts = C.placed_texts(docs).withColumnRenamed("doc_id", "id")
    asked = C.keyed(items, F.col("item_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    wanted = asked.mapInArrow(lambda batches: window_batches(batches, None), ROWS)
    bits = docs.sparkSession.sparkContext.broadcast(filter_of(wanted))
    met = texts.mapInArrow(lambda batches: window_batches(batches, bits.value), ROWS)
    item = wanted.select(F.col("row").alias("item_row"), F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), F.col("windows").alias("item_windows"),
                         "h1", "h2", F.col("slots").alias("item_slots"))
    pairs = met.select("row", F.col("id").alias("doc_id"), "pos", "h1", "h2", "slots").join(item, ["h1", "h2"])
    key = ["row", "doc_id", "item_row", "item_id", "item_windows"]
    # a shift has each window of the item at most once, so its list is no longer than the item
    met = F.collect_set(F.struct(F.col("item_pos").alias("pos"), F.col("item_slots").alias("item"), F.col("slots").alias("doc"))).alias("met")
    shifts = pairs.groupBy(*key, (F.col("pos") - F.col("item_pos")).alias("shift")).agg(met).select(*key, "met")
    counted = shifts.mapInArrow(lambda batches: counted_batches(batches, key), ", ".join(f"{k} long" for k in key) + ", places array<long>, changed boolean")
    found = counted.groupBy(*key).agg(F.size(F.array_distinct(F.flatten(F.collect_set("places")))).cast("long").alias("n_windows"), F.bool_or("changed").alias("changed"))
    return found.where(F.col("n_windows") * 100 >= F.col("item_windows") * share).select(
        "row", "doc_id", "item_id", "n_windows", "item_windows", (F.col("n_windows") / F.col("item_windows")).alias("share"),
        F.when(F.col("changed"), "reparameterised").otherwise("verbatim").alias("kind"))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with all their columns."""
    docs = C.on_disk(docs)
    found = leaks(docs, items).select("row").distinct()
    whole = C.placed(docs, F.struct("*").alias("whole"))
    return whole.join(found, "row", "left_anti").select("whole.*")


def op1_template_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")).drop("row")


QUERIES = {"op1_template_join": op1_template_join}
ORACLES: dict[str, str] = {}
