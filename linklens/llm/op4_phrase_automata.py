"""Removal of passages that recur anywhere in the corpus, found with phrase automata.

A window is `WINDOW` consecutive words of one document.  Every word covered by a
window whose words also start anywhere else goes.

1. Anchors.  Among the eight-word grams of a window the one with the smallest hash is
   its anchor; equal windows have equal anchors.  Anchors are few, about one for
   fifteen words.  They are counted over the corpus, summed in each task first.
2. Confirmation.  Only windows whose anchor stands in two places can recur.  They are
   counted by 128-bit fingerprints, again summed in each task first, so that a passage
   in a third of all documents costs a row for each task and window.
3. Location.  Every document is read once more.  A window whose anchor and fingerprint
   pass their filters recurs, unless it is one of the few windows counted once that the
   filter lets pass as well; these are known exactly from the counts and sent along.
   The recurring passages of a slice of documents are compiled into Aho-Corasick
   automata of bounded size, and the slice's documents are streamed through them, which
   finds the occurrences by their text.  Nothing is shuffled for this.
4. Beyond `EXCEPTIONS` such windows (a filter that is too full) documents with a
   candidate are dealt by row into shards instead, with the fingerprints of the recurring
   windows of the shard from an exact join, and each shard is compiled and streamed.

What is broadcast has a fixed size: two Bloom filters and the exceptions.

Defined results: null and empty texts have no words; documents with fewer words than
a window keep all; repeated rows are different places of the same windows, so that
both lose them; windows are judged on the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.llm import common as C
from linklens.llm import words as W

WINDOW, GRAM = 35, 8
#: Bits of the two Bloom filters (2**27 bits are 16 MB).
ANCHOR_BITS, WINDOW_BITS = 27, 27
#: Packed bytes of the documents of a shard, on average at most; characters of the passages of one automaton.
SHARD, AUTOMATON = 2_000_000, 400_000
#: Windows a task holds before it hands their sums on.
HELD_WINDOWS = 1 << 19
#: Windows counted once that pass the filter, 16 bytes each, up to which they are sent to every task.
EXCEPTIONS = 1 << 20
RESULT = "row long, doc_id long, n_words long, n_removed long, kept_sha256 string"
HELD = "row long, doc_id long, n_words long, n_removed long, kept_sha256 string, packed binary"


class Passages:
    """Words of a slice with the hashes of their windows and anchors."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, powers: tuple[W.Powers, W.Powers, W.Powers]):
        self.words = words = W.Words(data, bounds, W.NOT_BLANK, powers[0])
        n = len(words.starts)
        self.whole = np.zeros(0, dtype=np.int64)
        if n < WINDOW:
            return
        rolled = W.Rolling(words.hash, powers[1])
        self.grams = W.mix(rolled.windows(GRAM))
        smallest = W.sliding_min(self.grams, WINDOW - GRAM + 1)
        self.whole = np.flatnonzero(words.left()[:len(smallest)] >= WINDOW)  # starts of windows inside one document
        self.anchor = smallest[self.whole]
        self.rolled, self.powers = rolled, powers

    def anchors(self) -> np.ndarray:
        """Hashes of the grams that are the anchor of a window, once for each place."""
        least = np.zeros(len(self.grams), dtype=np.uint64)  # largest minimum of the windows around each gram
        span = WINDOW - GRAM + 1
        minimum = np.zeros(len(self.grams) + span, dtype=np.uint64)
        minimum[self.whole + span - 1] = self.anchor
        least = ~W.sliding_min(~minimum, span)[:len(self.grams)]
        return self.grams[least == self.grams]

    def fingerprints(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent 64-bit hashes of the windows numbered by `some`."""
        starts = self.whole[some]
        second = W.Rolling(W.mix(self.words.hash, 5), self.powers[2])
        return W.mix(self.rolled.stretch(starts, starts + WINDOW)), W.mix(second.stretch(starts, starts + WINDOW), 7)


def tables() -> tuple[W.Powers, W.Powers, W.Powers]:
    return W.Powers(W.BYTE_BASE), W.Powers(W.WORD_BASE), W.Powers(W.WORD_BASE_2)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = tables()
    for batch in batches:
        found = []
        for _, _, data, bounds in W.slices(batch.column("text")):
            p = Passages(data, bounds, powers)
            if len(p.whole):
                found.append(p.anchors())
        if found:
            anchors, counts = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([signed(anchors), pa.array(counts)], names=["anchor", "n"])


def summed(found: list[np.ndarray]) -> pa.RecordBatch:
    both = np.concatenate(found)
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    at = np.flatnonzero(np.concatenate([[True], (both[1:] != both[:-1]).any(axis=1)]))
    return pa.RecordBatch.from_arrays([signed(both[at, 0].copy()), signed(both[at, 1].copy()), pa.array(np.diff(np.append(at, len(both))))], names=["h1", "h2", "n"])


def window_batches(batches: Iterator[pa.RecordBatch], bits: bytes) -> Iterator[pa.RecordBatch]:
    powers, known, held = tables(), W.Bits(ANCHOR_BITS, bits), []
    for batch in batches:
        for _, _, data, bounds in W.slices(batch.column("text")):
            p = Passages(data, bounds, powers)
            if len(p.whole):
                held.append(np.stack(p.fingerprints(np.flatnonzero(known.has(p.anchor))), axis=1))
            if sum(map(len, held)) >= HELD_WINDOWS:
                yield summed(held)
                held = []
    if sum(map(len, held)):
        yield summed(held)


def fill_batches(batches: Iterator[pa.RecordBatch], column: str, log2: int) -> Iterator[pa.RecordBatch]:
    """The set words of the Bloom filter of a task's hashes."""
    bits = W.Bits(log2)
    for batch in batches:
        bits.add(batch.column(column).to_numpy().view(np.uint64))
    words = bits.data.view(np.int64)
    at = np.flatnonzero(words)
    for low in range(0, len(at), 1 << 16):
        some = at[low:low + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some])], names=["at", "bits"])


def bloom(hashes: DataFrame, column: str, log2: int) -> bytes:
    """A Bloom filter of fixed size; a row of 64 bits each is summed by `or`."""
    words = hashes.select(column).mapInArrow(lambda batches: fill_batches(batches, column, log2), "at long, bits long")
    found = words.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (log2 - 6), dtype=np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.tobytes()


def candidate_batches(batches: Iterator[pa.RecordBatch], bits: bytes) -> Iterator[pa.RecordBatch]:
    """Documents without a candidate window with their result, the others with their text, packed."""
    powers, known, pack = tables(), W.Bits(WINDOW_BITS, bits), zstandard.ZstdCompressor()
    for batch in batches:
        for low, high, data, bounds in W.slices(batch.column("text")):
            p = Passages(data, bounds, powers)
            hit = np.zeros(high - low, dtype=bool)
            if len(p.whole):
                hit[p.words.doc[p.whole[known.has(p.fingerprints(np.arange(len(p.whole)))[0])]]] = True
            raw, count = data.tobytes(), np.diff(p.words.first)
            places = list(zip(hit.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            digests = [None if h else hashlib.sha256(b" ".join(raw[a:b].split())).hexdigest() for h, a, b in places]
            packed = pa.array([pack.compress(raw[a:b]) if h else None for h, a, b in places], pa.binary())
            yield pa.RecordBatch.from_arrays([
                batch.column("row").slice(low, high - low), batch.column("doc_id").slice(low, high - low), pa.array(count),
                pa.array(np.where(hit, -1, 0)), pa.array(digests, pa.string()), packed],
                names=["row", "doc_id", "n_words", "n_removed", "kept_sha256", "packed"])


def unpacked(texts: list[bytes]) -> pa.Array:
    unpack = zstandard.ZstdDecompressor()
    return pa.array([unpack.decompress(t).decode() for t in texts], pa.large_string())


def shard_batches(batches: Iterator[pa.RecordBatch], bits: bytes) -> Iterator[pa.RecordBatch]:
    """The candidate windows of each shard, once for each 2**20 of them."""
    powers, known, held = tables(), W.Bits(WINDOW_BITS, bits), []

    def once() -> pa.RecordBatch:
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        rows = rows[np.concatenate([[True], (rows[1:] != rows[:-1]).any(axis=1)])]
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0].astype(np.int32)), signed(rows[:, 1].copy()), signed(rows[:, 2].copy())], names=["shard", "h1", "h2"])

    for batch in batches:
        shards = batch.column("shard").to_numpy()
        for low, high, data, bounds in W.slices(unpacked(batch.column("packed").to_pylist())):
            p = Passages(data, bounds, powers)
            if len(p.whole):
                h1, h2 = p.fingerprints(np.arange(len(p.whole)))
                some = known.has(h1)
                held.append(np.stack([shards[low:high][p.words.doc[p.whole[some]]].astype(np.uint64), h1[some], h2[some]], axis=1))
            if sum(map(len, held)) >= HELD_WINDOWS:
                yield once()
                held.clear()
    if sum(map(len, held)):
        yield once()


def automata(passages: list[str], size: int = AUTOMATON) -> Iterator[ahocorasick.Automaton]:
    """Automata over passages, each of a bounded number of characters or of one passage."""
    one, held = ahocorasick.Automaton(ahocorasick.STORE_LENGTH), 0
    for passage in passages:
        one.add_word(passage)
        held += len(passage)
        if held >= size:
            one.make_automaton()
            yield one
            one, held = ahocorasick.Automaton(ahocorasick.STORE_LENGTH), 0
    if held:
        one.make_automaton()
        yield one


def pass_batches(batches: Iterator[pa.RecordBatch], bits: bytes) -> Iterator[pa.RecordBatch]:
    """Windows that pass the filter."""
    known = W.Bits(WINDOW_BITS, bits)
    for batch in batches:
        if batch.num_rows:
            yield batch.filter(pa.array(known.has(batch.column("h1").to_numpy().view(np.uint64))))


def without(h1: np.ndarray, h2: np.ndarray, exceptions: np.ndarray) -> np.ndarray:
    """Which fingerprints are none of the exceptions, rows (h1, h2) sorted by both."""
    out = np.ones(len(h1), dtype=bool)
    first = np.searchsorted(exceptions[:, 0], h1, "left")
    last = np.searchsorted(exceptions[:, 0], h1, "right")
    for i in np.flatnonzero(last > first).tolist():
        out[i] = not (exceptions[first[i]:last[i], 1] == h2[i]).any()
    return out


def covered_words(texts: list[bytes], runs: list[list[tuple[int, int]]]) -> list[np.ndarray]:
    """For each text which words an occurrence of a passage covers; `runs` are the first and last word of each text's own passages."""
    lines = [t.decode().split(" ") for t in texts]
    passages = {f" {' '.join(words[a:b])} ": None for words, own in zip(lines, runs, strict=True) for a, b in own}
    streams = [f" {' '.join(words)} " for words in lines]
    borders = [np.cumsum([0, *(len(w) + 1 for w in words)]) for words in lines]  # place of the blank before each word
    cover = [np.zeros(len(words) + 1, dtype=np.int32) for words in lines]
    for automaton in automata(list(passages)):
        for stream, border, count in zip(streams, borders, cover, strict=True):
            for end, length in automaton.iter(stream):
                first, last = np.searchsorted(border, (end - length + 1, end))
                count[first] += 1
                count[last] -= 1
    return [np.cumsum(c)[:-1] > 0 for c in cover]


def remove_batches(batches: Iterator[pa.RecordBatch], anchors: bytes, windows: bytes, exceptions: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Result rows, slice by slice."""
    powers, known_anchors, known = tables(), W.Bits(ANCHOR_BITS, anchors), W.Bits(WINDOW_BITS, windows)
    for batch in batches:
        for low, high, data, bounds in W.slices(batch.column("text")):
            p = Passages(data, bounds, powers)
            raw, counts, first = data.tobytes(), np.diff(p.words.first), p.words.first
            texts = [b" ".join(raw[a:b].split()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            runs: dict[int, list[tuple[int, int]]] = {}
            if len(p.whole):
                some = np.flatnonzero(known_anchors.has(p.anchor))
                h1, h2 = p.fingerprints(some)
                hit = known.has(h1)
                hit[hit] = without(h1[hit], h2[hit], exceptions)
                starts = p.whole[some[hit]]  # windows of consecutive words of one document make a passage
                if len(starts):
                    docs = p.words.doc[starts]
                    new = np.concatenate([[True], (np.diff(starts) != 1) | (np.diff(docs) != 0)])
                    begin = np.flatnonzero(new)
                    end = np.append(begin[1:], len(starts)) - 1
                    for a, b, d in zip(starts[begin].tolist(), (starts[end] + WINDOW).tolist(), docs[begin].tolist(), strict=True):
                        runs.setdefault(d, []).append((a - int(first[d]), b - int(first[d])))
            removed = np.zeros(high - low, dtype=np.int64)
            for d, gone in zip(runs, covered_words([texts[d] for d in runs], list(runs.values())), strict=True):
                removed[d] = gone.sum()
                texts[d] = b" ".join(w for w, g in zip(texts[d].split(b" "), gone.tolist(), strict=True) if not g)
            yield pa.RecordBatch.from_arrays([
                batch.column("row").slice(low, high - low), batch.column("doc_id").slice(low, high - low), pa.array(counts), pa.array(removed),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())], names=["row", "doc_id", "n_words", "n_removed", "kept_sha256"])


def locate(docs: pd.DataFrame, recurring: pd.DataFrame) -> pd.DataFrame:
    """Result rows of a shard's documents, given the recurring windows of the shard."""
    powers = tables()
    known = np.unique(recurring["h1"].to_numpy().view(np.uint64))  # joined by both hashes; among the few of a shard one tells them apart
    lines, passages = [], {}
    for packed in docs["packed"]:
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), dtype=np.uint8)
        p = Passages(data, np.array([0, len(data)]), powers)
        words = [data[a:b].tobytes().decode() for a, b in zip(p.words.starts.tolist(), p.words.ends.tolist(), strict=True)]
        lines.append(words)
        if not len(p.whole) or not len(known):
            continue
        h1, _ = p.fingerprints(np.arange(len(p.whole)))
        found = known[np.minimum(np.searchsorted(known, h1), len(known) - 1)] == h1
        edges = np.flatnonzero(np.diff(np.concatenate([[0], found, [0]])))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            passages[f" {' '.join(words[a:b - 1 + WINDOW])} "] = None
    covered = [np.zeros(len(words) + 1, dtype=np.int64) for words in lines]
    streams = [f" {' '.join(words)} " for words in lines]
    borders = [np.cumsum([0, *(len(w) + 1 for w in words)]) for words in lines]  # place of the blank before each word
    for automaton in automata(list(passages)):
        for stream, border, cover in zip(streams, borders, covered, strict=True):
            for end, length in automaton.iter(stream):
                first, last = np.searchsorted(border, (end - length + 1, end))
                cover[first] += 1
                cover[last] -= 1
    out = []
    for (row, doc_id), words, cover in zip(docs[["row", "doc_id"]].itertuples(index=False), lines, covered, strict=True):
        keep = np.cumsum(cover)[:-1] == 0
        digest = hashlib.sha256(" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k).encode()).hexdigest()
        out.append((row, doc_id, len(words), int(len(words) - keep.sum()), digest))
    frame = pd.DataFrame(out, columns=["row", "doc_id", "n_words", "n_removed", "kept_sha256"])
    return frame.astype({"doc_id": "Int64"})


def without_recurring(docs: DataFrame) -> DataFrame:
    """row, doc_id, n_words, n_removed, kept_sha256: one row per input row."""
    texts = C.text_of(docs)
    spark = docs.sparkSession
    anchors = texts.select("text").mapInArrow(anchor_batches, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    first = spark.sparkContext.broadcast(bloom(anchors, "anchor", ANCHOR_BITS))  # of fixed size, like the next
    windows = texts.select("text").mapInArrow(lambda batches: window_batches(batches, first.value), "h1 long, h2 long, n long")
    counts = C.stored(windows.repartition("h1").groupBy("h1", "h2").agg((F.sum("n") > 1).alias("again")), "windows")
    recurring = counts.where("again").select("h1", "h2")
    second = spark.sparkContext.broadcast(bloom(recurring, "h1", WINDOW_BITS))
    once = counts.where("not again").select("h1", "h2").mapInArrow(lambda batches: pass_batches(batches, second.value), "h1 long, h2 long")
    once = C.stored(once, "exceptions")
    if once.count() <= EXCEPTIONS:
        found = once.toArrow()
        pairs = np.stack([found.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2")], axis=1)
        third = spark.sparkContext.broadcast(pairs[np.lexsort((pairs[:, 1], pairs[:, 0]))])
        return texts.mapInArrow(lambda batches: remove_batches(batches, first.value, second.value, third.value), RESULT)
    return in_shards(texts, recurring, second)


def in_shards(texts: DataFrame, recurring: DataFrame, second) -> DataFrame:
    """Step 4: the documents with a candidate dealt into shards, with their recurring windows from an exact join."""
    spark = texts.sparkSession
    held = C.stored(texts.mapInArrow(lambda batches: candidate_batches(batches, second.value), HELD), "candidates")
    size = held.agg(F.sum(F.octet_length("packed"))).first()[0] or 0
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD))
    open_ = held.where("packed is not null").select("row", "doc_id", "packed", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"))
    of_shard = open_.select("packed", "shard").mapInArrow(lambda batches: shard_batches(batches, second.value), "shard int, h1 long, h2 long")
    of_shard = of_shard.join(recurring, ["h1", "h2"], "left_semi").select("shard", "h1")
    located = open_.groupBy("shard").cogroup(of_shard.groupBy("shard")).applyInPandas(locate, RESULT)
    return held.where("packed is null").select("row", "doc_id", "n_words", "n_removed", "kept_sha256").unionByName(located)


def op4_phrase_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_recurring(C.table(spark, sf_dir, "documents")).drop("row")


QUERIES = {"op4_phrase_automata": op4_phrase_automata}
ORACLES: dict[str, str] = {}
