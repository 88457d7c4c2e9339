"""Phrase collocations: frequent phrases of two and three words whose parts seldom stand alone.

Words are lower-cased (A-Z); texts are cut into pieces at `[.,;:!?]` and line ends, and
phrases don't cross a cut.  Everything is counted for each language by itself.

1. Safe candidates.  Phrases of one and two words, then those of three words whose two
   pairs may be frequent, are counted by 64-bit buckets.  A bucket's count is never less
   than a phrase's, and a phrase is never more frequent than its parts, so a phrase is
   a candidate if its bucket and those of all its parts reach the threshold, and none that
   is frequent is missed.  Tasks look buckets up in a Bloom filter of bounded size; what
   it lets pass wrongly is dropped by a join with the stored buckets.  A candidate's text
   is needed once, not from every task: one occurrence in `SHOWN` shows its text, and
   a second look finds the buckets that none has shown.  (Phrases that share a 64-bit
   bucket would be taken for one: odds of 3 in a hundred million among a million.)
2. Tries.  The candidates, sorted and dealt by range, become double-array tries of
   bounded size, built in tasks.  A node is a slot: a child's slot is its parent's base
   plus the byte, and as no two nodes have one base, the byte stored there tells whose
   child it is.
3. Counting.  Tries of at most `GROUP` bytes together are broadcast at a time.  The text
   positions of a slice stand at word starts; numpy moves all of them one byte on through
   a trie at once, level by level, and counts the states at word ends by bincount.  Counts
   of tasks are summed by Spark.  More tries than one group take another scan; beyond
   `SCANS` of them the phrases that tasks find are summed by a shuffle instead, exactly as
   well.
4. Scores are exact: products are decimals of 38 digits, enough for counts up to 10**14.

Defined results: a null text is empty, a null language is `und`; repeated rows count
again; an empty table, or one without frequent phrases, has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linklens.llm import common as C
from linklens.llm import words as W

#: Occurrences that make a phrase frequent, words of the longest, percent of a phrase's occurrences that a longer one has to explain, rows a language.
LEAST, LONGEST, EXPLAINED, TOP = 10, 3, 50, 2000
SCALE = 1_000_000
#: Hashes and phrases that a task holds before it passes them on.
HELD, HELD_PHRASES = 2 << 20, 120_000
#: Bytes of text that are worked on together, rows of an Arrow batch.
SLICE, ROWS = 1 << 19, 1 << 16
#: One occurrence in so many shows the text of its phrase.
SHOWN = 8
#: Buckets whose text a task remembers to have named.
NAMED = 1 << 20
#: Largest filter, as log2 of its bits.
FILTER_BITS = 27
#: Text of a trie, bytes of the tries that are broadcast together, scans.
TRIE, GROUP, SCANS = 3 << 20, 64 << 20, 8
#: A label that no text has: cuts are line feeds here.
FREE = 0x0B
BLANK = W.byte_set((0x20, 0x20), (0x09, 0x09))
CUT = W.byte_set((0x0A, 0x0D)) | np.isin(np.arange(256), [ord(c) for c in ".,;:!?"])
CANDIDATES = "lang string, phrase string, bucket long, n long"
TRIES = "trie long, size long, base binary, label binary, langs array<string>, roots array<int>, lang array<string>, phrase array<string>, slot array<int>"


class Stream:
    """Words of a slice of documents, each followed by one byte: a blank, or a line feed where a piece ends."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        docs = len(bounds) - 1
        text = np.full(len(data) + docs, 0x0A, dtype=np.uint8)  # every document ends a piece
        text[np.arange(len(data)) + np.repeat(np.arange(docs), np.diff(bounds))] = W.lower_ascii(data)
        cut = CUT[text]
        word = ~(cut | BLANK[text])
        edges = np.flatnonzero(np.diff(np.concatenate([[False], word, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        cuts = np.concatenate([[0], np.cumsum(cut)])
        following = np.append(starts[1:], len(text))
        self.joined = cuts[following] == cuts[ends]
        text[ends] = np.where(self.joined, 0x20, 0x0A)
        keep = word
        keep[ends] = True
        self.buffer = text[keep]
        self.ends = np.cumsum(ends - starts + 1) - 1
        self.starts = self.ends - (ends - starts)
        self.doc = np.searchsorted(bounds[1:] + np.arange(1, docs + 1), starts, "right")

    def beginning(self, n: int) -> np.ndarray:
        """Words that begin a phrase of n words."""
        out = np.ones(max(0, len(self.starts) - n + 1), dtype=bool)
        for i in range(n - 1):
            out &= self.joined[i:i + len(out)]
        return np.flatnonzero(out)

    def hashes(self, langs: np.ndarray, powers: W.Powers) -> list[np.ndarray]:
        """Bucket of the phrase of 1, 2 .. words at each word, whether it stands there or not."""
        rolling = W.Rolling(self.buffer.astype(np.uint64) + np.uint64(1), powers)
        own = langs[self.doc]
        out = []
        for n in range(1, LONGEST + 1):
            size = max(0, len(self.starts) - n + 1)
            out.append(W.mix(rolling.stretch(self.starts[:size], self.ends[n - 1:n - 1 + size]) ^ own[:size], n))
        return out


def language_hashes(langs: list[str]) -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(x) for x in langs], dtype=np.uint64)


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Stream, list[str]]]:
    for batch in batches:
        for low, high, data, bounds in W.slices(batch.column("text"), SLICE):
            stream = Stream(data, bounds)
            if len(stream.starts):
                yield stream, batch.column("lang").slice(low, high - low).to_pylist()


def signed(hashes: np.ndarray) -> pa.Array:
    return pa.array(hashes.view(np.int64))


def in_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for low in range(0, batch.num_rows, ROWS):
        yield batch.slice(low, ROWS)


def bucket_batches(batches: Iterator[pa.RecordBatch], sizes: tuple[int, ...], bits: bytes | None, log2: int) -> Iterator[pa.RecordBatch]:
    """Counts of the buckets of phrases of some sizes; of those whose parts may be frequent if a filter is given."""
    powers, held = W.Powers(W.BYTE_BASE), []
    known = None if bits is None else W.Bits(log2, bits)

    def counted() -> pa.RecordBatch:
        buckets, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([signed(buckets), pa.array(n)], names=["bucket", "n"])

    for stream, langs in streams(batches):
        hashes = stream.hashes(language_hashes(langs), powers)
        for n in sizes:
            at = stream.beginning(n)
            if known is not None:
                may = known.has(hashes[n - 2])
                at = at[may[at] & may[at + 1]]
            held.append(hashes[n - 1][at])
        if sum(map(len, held)) >= HELD:
            yield from in_rows(counted())
            held.clear()
    if held:
        yield from in_rows(counted())


def candidate_batches(batches: Iterator[pa.RecordBatch], bits: bytes, log2: int) -> Iterator[pa.RecordBatch]:
    """Phrases that pass the filter with all their parts, each with its number in the task, and the words of each language (a null phrase)."""
    powers, known = W.Powers(W.BYTE_BASE), W.Bits(log2, bits)
    found: dict[int, list] = {}
    total: dict[str, int] = {}

    def flushed() -> pa.RecordBatch:
        rows = [(lang, phrase, int(np.uint64(b).view(np.int64)), n) for b, (lang, phrase, n) in found.items()] + [(lang, None, 0, n) for lang, n in total.items()]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        found.clear()
        total.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "phrase", "bucket", "n"])

    for stream, langs in streams(batches):
        hashes, raw = stream.hashes(language_hashes(langs), powers), stream.buffer.tobytes()
        for doc, n in enumerate(np.bincount(stream.doc, minlength=len(langs)).tolist()):
            total[langs[doc]] = total.get(langs[doc], 0) + n
        parts = None
        for n in range(1, LONGEST + 1):
            hot = known.has(hashes[n - 1])
            if parts is not None:
                hot &= parts[:-1] & parts[1:]
            begins = np.zeros(len(hot), dtype=bool)
            begins[stream.beginning(n)] = True
            parts = hot & begins
            at = np.flatnonzero(parts)
            buckets, first, counts = np.unique(hashes[n - 1][at], return_index=True, return_counts=True)
            for bucket, w, count in zip(buckets.tolist(), at[first].tolist(), counts.tolist(), strict=True):
                row = found.get(bucket)
                if row is None:
                    found[bucket] = [langs[stream.doc[w]], raw[stream.starts[w]:stream.ends[w + n - 1]].decode(), count]
                else:
                    row[2] += count
        if len(found) >= HELD_PHRASES:
            yield from in_rows(flushed())
    yield from in_rows(flushed())


def phrase_texts(stream: Stream, first: np.ndarray, n: int) -> pa.Array:
    """The texts of the phrases of n words at the given words, without a Python object for each."""
    low, size = stream.starts[first], stream.ends[first + n - 1] - stream.starts[first]
    offsets = np.concatenate([[0], np.cumsum(size)])
    data = stream.buffer[np.arange(offsets[-1]) + np.repeat(low - offsets[:-1], size)]
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data))


def text_batches(batches: Iterator[pa.RecordBatch], bits: bytes, log2: int, shown: int = 1, parts_too: bool = True) -> Iterator[pa.RecordBatch]:
    """Texts of phrases that pass the filter (with all their parts), and the words of each language (a null phrase).

    One occurrence in `shown` is looked at.  What a task has named lately it does not name
    again: a table of fixed size holds whole buckets, and of two that share a place the
    later one stays, so a phrase may come twice and none is left out.
    """
    powers, known = W.Powers(W.BYTE_BASE), W.Bits(log2, bits)
    named = np.zeros(NAMED, dtype=np.uint64)
    total: dict[str, int] = {}
    for stream, langs in streams(batches):
        hashes = stream.hashes(language_hashes(langs), powers)
        for doc, n in enumerate(np.bincount(stream.doc, minlength=len(langs)).tolist()):
            total[langs[doc]] = total.get(langs[doc], 0) + n
        own, parts = pa.array(langs, pa.string()), None
        for n in range(1, LONGEST + 1):
            at = stream.beginning(n)
            if parts is not None and parts_too:
                at = at[parts[at] & parts[at + 1]]
            at = at[known.has(hashes[n - 1][at])]
            parts = np.zeros(len(stream.starts), dtype=bool)
            parts[at] = True
            if shown > 1:
                at = at[W.mix(hashes[n - 1][at] + at.astype(np.uint64)) % np.uint64(shown) == 0]
            buckets = hashes[n - 1][at]
            # an empty place holds 0: the bucket 0 is always named
            fresh = (named[buckets % np.uint64(NAMED)] != buckets) | (buckets == 0)
            buckets, first = np.unique(buckets[fresh], return_index=True)
            named[buckets % np.uint64(NAMED)] = buckets
            at = at[fresh][first]
            for low in range(0, len(at), ROWS):
                some = at[low:low + ROWS]
                yield pa.RecordBatch.from_arrays([own.take(pa.array(stream.doc[some])), phrase_texts(stream, some, n), signed(buckets[low:low + ROWS]), pa.nulls(len(some), pa.int64())], names=["lang", "phrase", "bucket", "n"])
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.nulls(len(total), pa.string()), pa.array([0] * len(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["lang", "phrase", "bucket", "n"])


def named_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bucket of each given phrase."""
    powers = W.Powers(W.BYTE_BASE)
    for batch in batches:
        buckets = []
        for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
            data = np.frombuffer(phrase.encode(), dtype=np.uint8)
            n = phrase.count(" ") + 1
            buckets.append(Stream(data, np.array([0, len(data)])).hashes(language_hashes([lang]), powers)[n - 1][0])
        yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("phrase"), signed(np.array(buckets, dtype=np.uint64))], names=["lang", "phrase", "bucket"])


def fill_batches(batches: Iterator[pa.RecordBatch], log2: int) -> Iterator[pa.RecordBatch]:
    """The words of the Bloom filter that a task's buckets set."""
    bits = W.Bits(log2)
    for batch in batches:
        bits.add(batch.column("bucket").to_numpy().view(np.uint64))
    words = bits.data.view(np.int64)
    at = np.flatnonzero(words)
    for low in range(0, len(at), 1 << 16):
        some = at[low:low + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(words[some])], names=["at", "bits"])


def bloom(buckets: DataFrame, n: int) -> tuple[bytes, int]:
    """A filter of ten bits a bucket, of 2**FILTER_BITS at most, and its log2."""
    log2 = min(FILTER_BITS, max(16, (10 * n).bit_length()))
    found = buckets.select("bucket").mapInArrow(lambda batches: fill_batches(batches, log2), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (log2 - 6), dtype=np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.tobytes(), log2


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Base and label of each slot, and the slot of each key; keys ascend and differ.

    Slot 0 is the root.  The children of one depth are placed together: first those of
    nodes with several, each at the next base where all of them fit, then single ones
    in the free slots.
    """
    data = np.frombuffer(b"".join(keys), dtype=np.uint8)
    size = np.array([len(k) for k in keys], dtype=np.int64)
    start = np.cumsum(size) - size
    room = 2 * len(data) + 1024
    base, label = np.full(room, -1, dtype=np.int32), np.full(room, FREE, dtype=np.uint8)
    taken, used = np.zeros(room, dtype=bool), np.zeros(room, dtype=bool)
    slot = np.zeros(len(keys), dtype=np.int64)
    taken[0] = used[0] = True
    state, low, free = np.zeros(len(keys), dtype=np.int64), 1, 1
    live, depth = np.arange(len(keys)), 0
    while True:
        slot[live[size[live] == depth]] = state[live[size[live] == depth]]
        live = live[size[live] > depth]
        if not len(live):
            break
        byte, parent = data[start[live] + depth].astype(np.int64), state[live]
        new_parent = np.concatenate([[True], parent[1:] != parent[:-1]])
        new_child = new_parent | np.concatenate([[True], byte[1:] != byte[:-1]])
        child_byte, child_parent = byte[new_child], parent[new_child]
        heads = np.flatnonzero(np.concatenate([[True], child_parent[1:] != child_parent[:-1]]))
        width = np.diff(np.append(heads, len(child_byte)))
        bases = np.zeros(len(heads), dtype=np.int64)
        needed = low + 2 * len(child_byte) + 1024
        if needed > len(base):
            more = needed - len(base) + (len(base) >> 1)
            base, label = np.concatenate([base, np.full(more, -1, np.int32)]), np.concatenate([label, np.full(more, FREE, np.uint8)])
            taken, used = np.concatenate([taken, np.zeros(more, bool)]), np.concatenate([used, np.zeros(more, bool)])
        for g in np.flatnonzero(width > 1).tolist():
            symbols = child_byte[heads[g]:heads[g] + width[g]]
            while True:
                if low + 256 >= len(base):
                    base, label = np.concatenate([base, np.full(len(base), -1, np.int32)]), np.concatenate([label, np.full(len(label), FREE, np.uint8)])
                    taken, used = np.concatenate([taken, np.zeros(len(taken), bool)]), np.concatenate([used, np.zeros(len(used), bool)])
                if not used[low] and not taken[low + symbols].any():
                    break
                low += 1
            bases[g], used[low] = low, True
            taken[low + symbols] = True
            low += 1
        open_ = np.flatnonzero(width == 1)
        while len(open_):
            while not (~taken[free:]).sum() > 2 * len(open_) + 512:
                base, label = np.concatenate([base, np.full(len(base), -1, np.int32)]), np.concatenate([label, np.full(len(label), FREE, np.uint8)])
                taken, used = np.concatenate([taken, np.zeros(len(taken), bool)]), np.concatenate([used, np.zeros(len(used), bool)])
            window = free + np.flatnonzero(~taken[free:free + 4 * len(open_) + 1024])
            places = window[:len(open_)]
            if not len(places):
                free += 4 * len(open_) + 1024
                continue
            some = open_[:len(places)]
            wanted = places - child_byte[heads[some]]
            good = wanted > 0
            good[good] = ~used[wanted[good]]
            _, first = np.unique(wanted, return_index=True)
            once = np.zeros(len(wanted), dtype=bool)
            once[first] = True
            good &= once
            bases[some[good]] = wanted[good]
            used[wanted[good]] = taken[places[good]] = True
            if not good.any():
                free = int(places[-1]) + 1  # these slots stay free
            open_ = np.concatenate([some[~good], open_[len(places):]])
        base[child_parent[heads]] = bases
        child = np.repeat(bases, width) + child_byte
        label[child] = child_byte
        state[live] = child[np.cumsum(new_child) - 1]
        depth += 1
    last = int(np.flatnonzero(taken)[-1]) + 1
    base, label = base[:last], np.concatenate([label[:last], np.full(256, FREE, dtype=np.uint8)])
    base[base < 0] = last  # a leaf's children lie in the margin
    return base, label, slot


def advance(base: np.ndarray, label: np.ndarray, buffer: np.ndarray, at: np.ndarray, state: np.ndarray) -> np.ndarray:
    """States at the ends of words that are reached from the positions `at`, each as often as it is reached."""
    margin = len(base)
    ends = []
    while len(at):
        byte = buffer[at]
        word_end = (byte == 0x20) | (byte == 0x0A)
        ends.append(state[word_end])
        state = base[state] + byte.astype(np.int32)
        alive = np.flatnonzero(label[state] == byte)
        state, at = state[alive], at[alive] + 1
        if len(state) and state.max() >= margin:
            raise AssertionError("a state in the margin")
    return np.concatenate(ends) if ends else np.zeros(0, dtype=np.int32)


def trie_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tries of the sorted phrases of a partition, of about TRIE bytes of text each."""
    rows: list[tuple[str, str]] = []
    held = made = part = 0

    def built() -> pa.RecordBatch:
        langs = sorted({lang for lang, _ in rows})
        number = {lang: i.to_bytes(4, "big") for i, lang in enumerate(langs)}
        # each language's own root is the place of the empty phrase
        keyed = sorted([(number[lang] + phrase.encode(), lang, phrase) for lang, phrase in rows] + [(number[lang], lang, "") for lang in langs])
        base, label, slots = double_array([k for k, _, _ in keyed])
        roots = {lang: s for (_, lang, phrase), s in zip(keyed, slots.tolist(), strict=True) if phrase == ""}
        known = [(lang, phrase, s) for (_, lang, phrase), s in zip(keyed, slots.tolist(), strict=True) if phrase != ""]
        columns = [[(part << 20) + made], [5 * len(base)], [base.tobytes()], [label.tobytes()], [langs], [[roots[x] for x in langs]], *([list(c)] for c in zip(*known, strict=True))]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in TRIES.split(", ")])

    for batch in batches:
        if batch.num_rows:
            part = batch.column("part")[0].as_py()
        for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist(), strict=True):
            rows.append((lang, phrase))
            held += len(phrase.encode()) + 1
            if held >= TRIE:
                yield built()
                rows.clear()
                held, made = 0, made + 1
    if rows:
        yield built()


def count_batches(batches: Iterator[pa.RecordBatch], tries: list[tuple[int, bytes, bytes, dict[str, int]]]) -> Iterator[pa.RecordBatch]:
    """How often each state of the tries is reached at the end of a word."""
    read = [(np.frombuffer(base, dtype=np.int32), np.frombuffer(label, dtype=np.uint8), roots) for _, base, label, roots in tries]
    counts = [np.zeros(len(base), dtype=np.int64) for base, _, _ in read]
    for stream, langs in streams(batches):
        for (base, label, roots), count in zip(read, counts, strict=True):
            root = np.array([roots.get(x, -1) for x in langs], dtype=np.int32)[stream.doc]
            own = root >= 0
            ends = advance(base, label, stream.buffer, stream.starts[own], root[own])
            if len(ends) * 8 > len(count):
                count += np.bincount(ends, minlength=len(count))
            else:
                np.add.at(count, ends, 1)
    for (trie, *_), count in zip(tries, counts, strict=True):
        at = np.flatnonzero(count)
        for low in range(0, len(at), 1 << 16):
            some = at[low:low + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), trie)), pa.array(some.astype(np.int32)), pa.array(count[some])], names=["trie", "slot", "n"])


def safe_candidates(texts: DataFrame) -> DataFrame:
    """lang, phrase, n: every phrase that may be frequent, with the sum that tasks found; the words of each language with a null phrase."""
    spark = texts.sparkSession

    def frequent(sizes: tuple[int, ...], bits: bytes | None = None, log2: int = 0) -> tuple[DataFrame, int]:
        sent = None if bits is None else spark.sparkContext.broadcast(bits)  # of bounded size
        counts = texts.mapInArrow(lambda batches: bucket_batches(batches, sizes, sent and sent.value, log2), "bucket long, n long")
        # a task names a bucket once or a few times, so nothing is summed again before the shuffle
        hot = C.stored(counts.repartition("bucket").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST).select("bucket"), "buckets")
        return hot, hot.count()

    hot, n = frequent((1, 2))
    for size in range(3, LONGEST + 1):
        bits, log2 = bloom(hot, n)
        longer, m = frequent((size,), bits, log2)
        hot, n = hot.unionByName(longer), n + m
    bits, log2 = bloom(hot, n)
    sent = spark.sparkContext.broadcast(bits)
    found = C.stored(texts.mapInArrow(lambda batches: text_batches(batches, sent.value, log2, SHOWN), CANDIDATES).repartition("bucket").groupBy("lang", "phrase", "bucket").agg(F.sum("n").alias("n")), "found")
    phrases = found.where("phrase is not null").join(hot, "bucket", "left_semi")
    hidden = C.stored(hot.join(phrases.select("bucket").distinct(), "bucket", "left_anti"), "hidden")
    m = hidden.count()
    if m:
        few, few_log2 = bloom(hidden, m)
        sent_few = spark.sparkContext.broadcast(few)
        rest = texts.mapInArrow(lambda batches: text_batches(batches, sent_few.value, few_log2, parts_too=False), CANDIDATES).where("phrase is not null")
        phrases = phrases.unionByName(rest.groupBy("lang", "phrase", "bucket").agg(F.sum("n").alias("n")).join(hidden, "bucket", "left_semi"))
    return C.stored(found.where("phrase is null").select("lang", "phrase", "n").unionByName(phrases.select("lang", "phrase", F.lit(None).cast("long").alias("n"))), "candidates")


def summed_frequencies(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """lang, phrase, n of the candidates by a shuffle of what tasks count: for more tries than can be sent around."""
    hot = C.stored(candidates.where("phrase is not null").select("lang", "phrase").mapInArrow(named_batches, "lang string, phrase string, bucket long"), "named")
    bits, log2 = bloom(hot, hot.count())
    sent = texts.sparkSession.sparkContext.broadcast(bits)
    counts = texts.mapInArrow(lambda batches: candidate_batches(batches, sent.value, log2), CANDIDATES).where("phrase is not null")
    return counts.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).join(hot.select("lang", "phrase"), ["lang", "phrase"], "left_semi")


def frequencies(texts: DataFrame, candidates: DataFrame) -> DataFrame:
    """lang, phrase, n of the phrases that occur, counted through the tries."""
    spark = texts.sparkSession
    phrases = candidates.where("phrase is not null").select("lang", "phrase")
    size = phrases.agg(F.sum(F.octet_length("phrase") + 1)).first()[0] or 0
    ranged = phrases.repartitionByRange(max(1, -(-size // TRIE)), "lang", "phrase").sortWithinPartitions("lang", "phrase")
    tries = C.stored(ranged.withColumn("part", F.spark_partition_id().cast("long")).mapInArrow(trie_batches, TRIES), "tries")
    groups, held = [], GROUP
    for trie, own in sorted(tuple(r) for r in tries.select("trie", "size").collect()):  # two numbers for each TRIE bytes of phrases
        if held + own > GROUP:
            groups.append([])
            held = 0
        groups[-1].append(trie)
        held += own
    if len(groups) > SCANS:
        return summed_frequencies(texts, candidates)
    counts = None
    for group in groups:
        rows = tries.where(F.col("trie").isin(group)).select("trie", "base", "label", "langs", "roots").collect()  # GROUP bytes at most
        sent = spark.sparkContext.broadcast([(r.trie, bytes(r.base), bytes(r.label), dict(zip(r.langs, r.roots, strict=True))) for r in rows])
        some = C.stored(texts.mapInArrow(lambda batches, sent=sent: count_batches(batches, sent.value), "trie long, slot int, n long").repartition("trie", "slot").groupBy("trie", "slot").agg(F.sum("n").alias("n")), "counts")
        counts = some if counts is None else counts.unionByName(some)
        sent.unpersist()
    named = tries.select("trie", F.explode(F.arrays_zip("lang", "phrase", "slot")).alias("p")).select("trie", "p.*")
    if counts is None:
        return candidates.where("phrase is not null")  # there is none
    return named.join(counts, ["trie", "slot"]).select("lang", "phrase", "n")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(SCALE * a * a / (l * r)) in decimals of 38 digits; at most SCALE."""
    wide = lambda c: c.cast("decimal(15,0)")
    top, bottom = wide(a) * wide(a) * F.lit(SCALE).cast("decimal(7,0)"), wide(left) * wide(right)
    # the remainder is exact, where a quotient would be rounded
    return ((top - top % bottom) / bottom).cast("long")


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's TOP phrases."""
    docs = C.on_disk(docs)
    texts = texts_of(docs)
    candidates = safe_candidates(texts)
    counts = C.stored(frequencies(texts, candidates).where(F.col("n") >= LEAST).withColumn("words", F.size(F.split("phrase", " "))), "frequencies")
    longer = counts.where("words > 1").select("lang", "phrase", F.col("n").alias("a"), "words")
    cut = longer.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"), "words")
    cut = cut.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("first"), F.expr("substring_index(phrase, ' ', k - words)").alias("rest"))
    part = lambda name, n: counts.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    parts = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    lowest = parts.withColumn("score", score(F.col("a"), F.col("l"), F.col("r"))).groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    # every shorter phrase in a longer one: words i.. of it
    inner = longer.where("words > 2").select("lang", F.col("a").alias("b"), F.explode(F.expr(
        "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("b").alias("b"))
    kept = lowest.join(inner, ["lang", "phrase"], "left").where(F.coalesce(F.col("b") * 100 < F.col("a") * EXPLAINED, F.lit(True)))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", rank.cast("long")).where(F.col("rank") <= TOP)
    totals = candidates.where("phrase is null").groupBy("lang").agg(F.sum("n").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_phrase_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(C.table(spark, sf_dir, "documents"))


QUERIES = {"op13_phrase_tries": op13_phrase_tries}
ORACLES = {"op13_phrase_tries": """
with pieces as (
  select coalesce(lang, 'und') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) as piece
  from documents),
worded as (select lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w : w <> '') as w from pieces),
zipped as (select lang, unnest(list_zip(w, w[2:], w[3:])) as z from worded),
following as (select lang, z[1] as w1, z[2] as w2, z[3] as w3 from zipped),
grams as materialized (
  select lang, w1 as phrase, 1 as k from following
  union all select lang, w1 || ' ' || w2, 2 from following where w2 is not null
  union all select lang, w1 || ' ' || w2 || ' ' || w3, 3 from following where w3 is not null),
f as materialized (select lang, phrase, k, count(*)::hugeint as a from grams group by all having count(*) >= 10),
totals as materialized (select lang, count(*) as n from grams where k = 1 group by lang),
cuts as (
  select lang, phrase, a, 1 as k, split_part(phrase, ' ', 1) as x, substr(phrase, length(split_part(phrase, ' ', 1)) + 2) as y from f where k >= 2
  union all
  select lang, phrase, a, 2, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2), split_part(phrase, ' ', 3) from f where k = 3),
scored as (
  select c.lang, c.phrase, c.a, c.k, x.a as l, y.a as r, (1000000 * c.a * c.a) // (x.a * y.a) as score
  from cuts c join f x on (x.lang, x.phrase) = (c.lang, c.x) join f y on (y.lang, y.phrase) = (c.lang, c.y)),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
inner_ as (
  select lang, p, max(a) as b from (
    select lang, split_part(phrase, ' ', 1) || ' ' || split_part(phrase, ' ', 2) as p, a from f where k = 3
    union all select lang, split_part(phrase, ' ', 2) || ' ' || split_part(phrase, ' ', 3), a from f where k = 3) group by all),
kept as (select o.* from lowest o left join inner_ i on i.lang = o.lang and i.p = o.phrase where i.b is null or 100 * i.b < 50 * o.a)
select lang, rank::bigint as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept) join totals using (lang)
where rank <= 2000
"""}
