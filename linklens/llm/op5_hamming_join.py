"""MinHash near-dedup with a multi-index Hamming join.

A document's set of word shingles gets a signature of 48 components of 16 bits, the
low bits of 48 minima.  Sets with a similarity of 0.8 differ in a fifth of the
components on average.  Signatures are split into twelve chunks of four components;
two signatures that differ in at most 23 components have, by pigeonhole, a chunk in
which they differ in at most one.  Each allowed error is enumerated: a chunk gives
four keys, each without one component.  So all pairs within that distance share a
key; a pair at similarity 0.8 exactly is farther apart five times in a million.

Documents with equal sets are one class with one representative.  Pairs aren't formed
within a bucket of a key: first each member is compared with the two hubs that it has
most keys in common with, and confirmed links join them into components.  A bucket whose
members are in several components may hold more links.  Its members meet by an exact
prefix filter: with the shingles of all of them ordered from rare to frequent, two sets
as similar as asked share one of the first shingles of both, and the longer the beginning
that they don't share the less can follow.  What a family of similar texts has in common
is frequent and comes last, so members that are not similar enough to be linked hardly
meet, however many they are.  Those that do are let through only if the parities of
their shingles' hash bits differ in no more places than the sets may; every shingle that
only one of two sets has changes one place.  No link between different components is
lost.  Pairs that are left are compared by their signatures, and the near ones confirmed on whole shingle sets,
recomputed from the texts of both sides.

Defined results: a null or empty text or one without words has an empty set and is
linked with nothing; with fewer words than a shingle the sequence is the one
shingle; repeated rows are equal sets; a null doc_id is last in order, and its row
is a component of its own if it is linked with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.llm import common as C
from linklens.llm import words as W

SIMILARITY = 80  # per cent
COMPONENTS, CHUNK = 48, 4
#: Signatures that differ in more components aren't compared on their texts; the join guarantees all up to 23.
FARTHEST = 27
#: More components, of 8 bits, that take no part in the join: a pair goes to its texts
#: if at most so many of all differ, six standard deviations above a similarity of 0.8.
MORE, FARTHEST_OF_ALL = 208, 90
#: Hubs that each member is compared with before components are compared.
HUBS = 2
#: Words of 64 parities of a set.
PARITIES = 16
#: Bits of the filter of the rows whose texts are needed (2**25 bits are 4 MB).
ROW_BITS = 25
SIGNED = "row long, doc_id long, n_shingles long, set1 long, set2 long, signature binary"


class Sets:
    """Distinct shingle hashes of each document of a slice: values, and where each document's begin."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, n: int, powers: tuple[W.Powers, W.Powers]):
        words = W.Words(W.lower_ascii(data), bounds, W.NOT_BLANK, powers[0])
        rolled = W.Rolling(words.hash, powers[1])
        counts = np.diff(words.first)
        sizes = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
        at = np.repeat(words.first[:-1] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        ends = np.minimum(at + n, np.repeat(words.first[1:], sizes))
        hashes, edges = W.mix(rolled.stretch(at, ends)), np.concatenate([[0], np.cumsum(sizes)])
        own = [np.unique(hashes[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
        self.sizes = np.array([len(x) for x in own], dtype=np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.values = np.concatenate(own) if own else hashes

    def of(self, i: int) -> np.ndarray:
        return self.values[self.first[i]:self.first[i + 1]]


def powers() -> tuple[W.Powers, W.Powers]:
    return W.Powers(W.BYTE_BASE), W.Powers(W.WORD_BASE)


def sign_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    tables = powers()
    factors = W.mix(np.arange(COMPONENTS + MORE, dtype=np.uint64), 99) | np.uint64(1)
    for batch in batches:
        for low, high, data, bounds in W.slices(batch.column("text")):
            sets = Sets(data, bounds, shingle, tables)
            some = np.flatnonzero(sets.sizes)
            out, more = np.zeros((high - low, COMPONENTS), dtype="<u2"), np.zeros((high - low, MORE), dtype=np.uint8)
            sums = np.zeros((2, high - low), dtype=np.uint64)
            if len(some):
                at = sets.first[some]
                for k, factor in enumerate(factors):
                    least = W.mix(np.minimum.reduceat(sets.values * factor, at))
                    if k < COMPONENTS:
                        out[some, k] = least >> np.uint64(48)
                    else:
                        more[some, k - COMPONENTS] = least >> np.uint64(56)
                for k in range(2):
                    sums[k, some] = np.add.reduceat(W.mix(sets.values, 7 + k), at)
            signatures = [out[i].tobytes() + more[i].tobytes() if sets.sizes[i] else None for i in range(high - low)]
            yield pa.RecordBatch.from_arrays([
                batch.column("row").slice(low, high - low), batch.column("doc_id").slice(low, high - low), pa.array(sets.sizes),
                *(pa.array(s.view(np.int64)) for s in sums), pa.array(signatures, pa.binary())], names=["row", "doc_id", "n_shingles", "set1", "set2", "signature"])


def key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The keys of each signature: a chunk without one of its components."""
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = signatures_of(batch.column("signature")).astype(np.uint64)
        rows = batch.column("rep")
        for chunk in range(COMPONENTS // CHUNK):
            for error in range(CHUNK):
                key = np.full(len(parts), chunk * CHUNK + error, dtype=np.uint64)
                for k in range(CHUNK):
                    if k != error:
                        key = W.mix(key << np.uint64(16) ^ parts[:, chunk * CHUNK + k])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), rows], names=["key", "rep"])


def signatures_of(column: pa.Array) -> np.ndarray:
    """The joined components of each row."""
    return np.ascontiguousarray(bytes_of(column)[:, :2 * COMPONENTS]).view("<u2")


def bytes_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(-1, 2 * COMPONENTS + MORE)


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two tables of signature bytes are near, judged by the joined components first."""
    width = 2 * COMPONENTS
    far = (np.ascontiguousarray(a[:, :width]).view("<u2") != np.ascontiguousarray(b[:, :width]).view("<u2")).sum(axis=1)
    out = far <= FARTHEST
    some = np.flatnonzero(out)
    out[some] = far[some] + (a[some, width:] != b[some, width:]).sum(axis=1) <= FARTHEST_OF_ALL
    return out


def near_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures are near, of columns a, b, sig_a, sig_b, n_a, n_b; sets too different in size aren't."""
    for batch in batches:
        if batch.num_rows:
            n, m = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            alike = np.minimum(n, m) * 100 >= np.maximum(n, m) * SIMILARITY
            keep = pa.array(near(bytes_of(batch.column("sig_a")), bytes_of(batch.column("sig_b"))) & alike)
            yield batch.select(["a", "b"]).filter(keep)


def shingle_batches(batches: Iterator[pa.RecordBatch], shingle: int, known: W.Bits) -> Iterator[pa.RecordBatch]:
    """The shingles of the rows of a filter."""
    tables = powers()
    for batch in batches:
        batch = batch.filter(pa.array(known.has(batch.column("row").to_numpy().view(np.uint64))))
        for low, high, data, bounds in W.slices(batch.column("text")):
            sets = Sets(data, bounds, shingle, tables)
            rows = np.repeat(batch.column("row").slice(low, high - low).to_numpy(), sets.sizes)
            for at in range(0, len(rows), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(rows[at:at + (1 << 16)]), pa.array(sets.values[at:at + (1 << 16)].view(np.int64))], names=["rep", "token"])


def prefix_pairs(tokens: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs a, b of different components whose sets can be as similar as asked.

    tokens: rep, token; nodes: rep, n_shingles, comp of the sets that are to meet.
    Shingles are ordered by (sets that have them, value); those of one set alone come
    first and only count as places.  Of two sets the shorter one shows fewer shingles:
    what it has in common with a set at least as long is at least 2t/(1+t) of it.
    """
    t = SIMILARITY
    often = tokens.groupBy("token").agg(F.count("*").alias("sets")).where("sets > 1")
    shared = tokens.join(often, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("held"))  # one document's shingles
    n = F.col("n_shingles")
    shown = n - F.ceil(n * t / 100) + 1
    short = n - F.ceil(n * (2 * t) / (100 + t)) + 1
    alone = n - F.size("held")
    one = F.call_function("shiftleft", F.expr("1L"), F.pmod(F.shiftright("token", 8), F.lit(64)).cast("int"))
    odd = [f"odd{k}" for k in range(PARITIES)]
    parities = tokens.groupBy("rep").agg(*[F.bit_xor(F.when(F.pmod("token", F.lit(PARITIES)) == k, one).otherwise(F.expr("0L"))).alias(c) for k, c in enumerate(odd)])
    first = nodes.join(shared, "rep").join(parities, "rep").select(*odd, "rep", "n_shingles", "comp", alone.alias("alone"), short.alias("short"), F.slice("held", F.lit(1), F.greatest(shown - alone, F.lit(0)).cast("int")).alias("held"))
    entries = first.select(*odd, "rep", "n_shingles", "comp", "short", "alone", F.posexplode("held").alias("at", "h"))
    entries = C.stored(entries.select(F.col("h.token").alias("token"), *odd, "rep", "n_shingles", "comp", (F.col("alone") + F.col("at")).alias("place"), (F.col("alone") + F.col("at") < F.col("short")).alias("early")), "prefixes")
    meeting = entries.groupBy("token").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.bool_or("early").alias("early")).where("low <> high and early").select("token")
    met = entries.join(meeting, "token", "left_semi")
    x, y = met.where("early").alias("x"), met.alias("y")
    longer = F.expr("x.n_shingles < y.n_shingles or (x.n_shingles = y.n_shingles and x.rep < y.rep)")
    alike = F.expr(f"x.comp <> y.comp and x.n_shingles * 100 >= y.n_shingles * {t}")
    # all that can still be common from this shingle on, if it is the first one that is
    enough = F.expr(f"least(x.n_shingles - x.place, y.n_shingles - y.place) * {100 + t} >= (x.n_shingles + y.n_shingles) * {t}")
    differ = " + ".join(f"bit_count(x.{c} ^ y.{c})" for c in odd)
    close = F.expr(f"({differ}) * {100 + t} <= (x.n_shingles + y.n_shingles) * {100 - t}")
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & longer & alike & enough & close)
    return pairs.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b")).distinct()


def confirm_batches(batches: Iterator[pa.RecordBatch], shingle: int) -> Iterator[pa.RecordBatch]:
    """The pairs whose whole sets are similar enough."""
    tables = powers()
    for batch in batches:
        texts_a, texts_b = batch.column("text_a"), batch.column("text_b")
        low = 0
        while low < batch.num_rows:
            high, held = low, 0
            while high < batch.num_rows and (high == low or held < W.SLICE):
                held += len(texts_a[high].as_buffer()) + len(texts_b[high].as_buffer())
                high += 1
            sides = []
            for texts in (texts_a, texts_b):
                raw = [texts[k].as_buffer().to_pybytes() for k in range(low, high)]
                place = {t: None for t in raw}
                for n, t in enumerate(place):
                    place[t] = n
                data = np.frombuffer(b"".join(place), dtype=np.uint8)
                sides.append((Sets(data, np.concatenate([[0], np.cumsum([len(t) for t in place])]).astype(np.int64), shingle, tables), [place[t] for t in raw]))
            (a, at_a), (b, at_b) = sides
            keep = np.zeros(high - low, dtype=bool)
            for k in range(high - low):
                x, y = a.of(at_a[k]), b.of(at_b[k])
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep[k] = both > 0 and 100 * both >= SIMILARITY * (len(x) + len(y) - both)
            yield batch.slice(low, high - low).select(["a", "b"]).filter(pa.array(keep))
            low = high


def row_bits(rows: DataFrame, log2: int = ROW_BITS) -> bytes:
    """A Bloom filter of row keys, of fixed size."""
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = W.Bits(log2)
        for batch in batches:
            bits.add(batch.column("row").to_numpy().view(np.uint64))
        words = bits.data.view(np.int64)
        at = np.flatnonzero(words)
        for low in range(0, len(at), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(at[low:low + (1 << 16)]), pa.array(words[at[low:low + (1 << 16)]])], names=["at", "bits"])

    found = rows.mapInArrow(fill, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << (log2 - 6), dtype=np.int64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy()
    return out.tobytes()


def needed_texts(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts of the given rows, and of few others, picked where they are read and stored."""
    bits = texts.sparkSession.sparkContext.broadcast(row_bits(rows))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = W.Bits(ROW_BITS, bits.value)
        for batch in batches:
            yield batch.filter(pa.array(known.has(batch.column("row").to_numpy().view(np.uint64))))

    return C.stored(texts.select("row", "text").mapInArrow(pick, "row long, text string"), "texts")


def components(edges: DataFrame) -> DataFrame:
    """node, comp of all nodes of the edges (a, b): each round joins every node with its first neighbour.

    The order of nodes is that of a hash, so that chains shrink by a constant factor a
    round as well.  Rounds end in a stored table, whose true size the next plan knows (a
    checkpoint keeps the estimate, which grows with every join); nothing is collected
    but whether edges are left.
    """
    maps = None
    edges = C.stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    number = 0
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(number)).alias("h"), F.col(c).alias("node"))  # noqa: E731, B023
        first = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["node"].alias("up"))
        first = C.stored(first, "first")
        maps = first.withColumnRenamed("up", "comp") if maps is None else C.stored(
            maps.join(first.withColumnRenamed("node", "comp"), "comp", "left").select("node", F.coalesce("up", "comp").alias("comp")), "maps")
        left = edges.join(first.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").select("x", "b")
        edges = left.join(first.select(F.col("node").alias("b"), F.col("up").alias("y")), "b").where("x <> y")
        edges = C.stored(edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        number += 1
    return maps if maps is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))


def near_groups(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """One row per input row: row, doc_id, n_shingles, component_id, and whether it is the row that stays."""
    texts = C.placed_texts(docs)
    signed = C.stored(texts.mapInArrow(lambda batches: sign_batches(batches, shingle), SIGNED), "signatures")
    first = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row")
    one_set = ["set1", "set2", "n_shingles"]
    classes = C.stored(signed.where("n_shingles > 0").groupBy(*one_set).agg(F.min("row").alias("rep"), F.min(first).alias("best"), F.max("signature").alias("signature")), "classes")
    # the signature is a function of the set, so any member's will do
    signs = classes.select("rep", "signature", "n_shingles")
    keys = signs.select("rep", "signature").mapInArrow(key_batches, "key long, rep long")
    rank = lambda n: F.min(F.struct(F.xxhash64("rep", F.lit(n)).alias("h"), F.col("rep").alias("hub")))
    hubs = keys.groupBy("key").agg(F.count("*").alias("n"), *(rank(n).alias(f"hub{n}") for n in range(HUBS))).where("n > 1")
    buckets = C.stored(keys.join(hubs.select("key", *(F.col(f"hub{n}.hub").alias(f"hub{n}") for n in range(HUBS))), "key"), "buckets")
    stored = needed_texts(texts, buckets.select(F.col("rep").alias("row")).distinct())

    def confirmed(pairs: DataFrame) -> DataFrame:
        side = lambda c: stored.select(F.col("row").alias(c), F.col("text").alias(f"text_{c}"))
        return C.stored(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(lambda batches: confirm_batches(batches, shingle), "a long, b long"), "links")

    def with_signs(pairs: DataFrame) -> DataFrame:
        side = lambda c: signs.select(F.col("rep").alias(c), F.col("signature").alias(f"sig_{c}"), F.col("n_shingles").alias(f"n_{c}"))
        return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(near_batches, "a long, b long")

    def labelled(df: DataFrame, comps: DataFrame, node: str, name: str) -> DataFrame:
        return df.join(comps.select(F.col("node").alias(node), F.col("comp").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))

    votes = F.explode(F.array(*(F.struct(F.lit(n).alias("order"), F.col(f"hub{n}").alias("hub")) for n in range(HUBS)))).alias("v")
    votes = buckets.select("rep", votes).select("rep", "v.*").where("rep <> hub").groupBy("rep", "order", "hub").agg(F.count("*").alias("keys"))
    stars = votes.groupBy("rep", "order").agg(F.max_by("hub", F.struct("keys", "hub")).alias("hub"))
    stars = stars.select(F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")).distinct()
    comps = components(confirmed(with_signs(stars)))
    members = C.stored(labelled(buckets.select("key", "rep"), comps, "rep", "comp"), "members")
    mixed = members.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("key")
    nodes = C.stored(members.join(mixed, "key", "left_semi").select("rep", "comp").distinct().join(signs.select("rep", "n_shingles"), "rep"), "nodes")
    bits = docs.sparkSession.sparkContext.broadcast(row_bits(nodes.select(F.col("rep").alias("row"))))
    tokens = stored.mapInArrow(lambda batches: shingle_batches(batches, shingle, W.Bits(ROW_BITS, bits.value)), "rep long, token long")
    tokens = C.stored(tokens.join(nodes.select("rep"), "rep", "left_semi"), "shingles")  # the filter lets some others pass
    close = with_signs(prefix_pairs(tokens, nodes))
    # what is linked now are components: their links join them once more
    links = labelled(labelled(confirmed(close), comps, "a", "ca"), comps, "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    named = labelled(classes.select("rep", "best", *one_set), comps, "rep", "part")
    named = labelled(named, components(links), "part", "comp").drop("part")
    best = named.groupBy("comp").agg(F.min("best").alias("head"))
    heads = named.join(best, "comp").select(*one_set, "head")
    joined = signed.join(heads, one_set, "left")
    alone = F.col("head").isNull()
    return joined.select("row", "doc_id", "n_shingles", F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("component_id"),
                         (alone | (F.col("row") == F.col("head.row"))).alias("stays"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies, with all its columns."""
    docs = C.on_disk(docs)
    return C.keep_rows(docs, near_groups(docs).where("stays"))


def op5_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(C.table(spark, sf_dir, "documents"), shingle=4)
    return groups.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


QUERIES = {"op5_hamming_join": op5_hamming_join}
ORACLES: dict[str, str] = {}
