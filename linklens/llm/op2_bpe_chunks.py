"""Byte-level BPE encoding with reuse of content-defined chunks, and decoding.

A document is cut where a rolling hash of its bytes says so.  Equal passages are
cut alike in every document, and a task encodes each distinct chunk once, whatever
document it comes from.  The tokens around a cut may be wrong, since a chunk ends
where the text goes on.  Each join is therefore repaired: the text between two sync
places, one or more before and after the cut, is encoded again, and its tokens must
agree exactly with those of the chunk on either side up to the next sync place;
if they don't, the repaired stretch is widened, at last to the whole document.

A sync place is a single space between two ASCII letters.  The splitting pattern
puts a border there whatever stands before or after, so tokens never cross it.

Chunks are shared within a task, not over the whole corpus: one dictionary for all
documents would move the text out to the dictionary and the tokens back, more than
twice the input, while nothing is shuffled here.  The dictionary is a cache of
bounded size; what falls out of it is encoded again.

Texts of Latin letters are encoded with tiktoken from the same vocabulary; chunks
with any other character, for which two libraries may disagree about letters and
white space, and very long stretches without a space with the tokenizers library.

Defined results: a null text is empty; an empty text has no tokens; repeated rows
are rows of their own; the special token's string in a text is that token.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.llm import common as C
from linklens.llm import words as W

VOCABULARY, RANKS = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken"
#: Bytes under the rolling hash; one place in 2**CUT_BITS is a cut.
WINDOW, CUT_BITS = 48, 11
#: Bytes of chunks and tokens a task remembers, in two generations.
REMEMBERED = 48 << 20
#: A longer stretch without a space is left to the library that merges in n log n.
LONG_PIECE = 2000
SCHEMA = "row long, doc_id long, n_tokens long, ids binary, decoded string"


def public_file(name: str) -> str:
    """Place of a vocabulary file; a name with a slash is a path already."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class Coder:
    """Encodes byte strings, remembering what it has seen; one per task."""

    def __init__(self, vocabulary: str, ranks: str, remembered: int = REMEMBERED):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(public_file(vocabulary))
        self.exact.no_truncation()
        self.exact.no_padding()
        self.special = {t.content: i for i, t in self.exact.get_added_tokens_decoder().items()}
        with open(public_file(ranks), "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens=self.special)
        self.marks = [s.encode() for s in self.special]
        size = max([*table.values(), *self.special.values()]) + 1
        self.lengths = np.zeros(size, dtype=np.int64)
        for token, rank in table.items():
            self.lengths[rank] = len(token)
        for token, rank in self.special.items():
            self.lengths[rank] = len(token.encode())
        self.young: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.old: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}
        self.size, self.limit, self.encoded, self.asked = 0, remembered // 2, 0, 0

    def plain(self, chunk: bytes, strange: bool) -> np.ndarray:
        if strange or len(chunk) > LONG_PIECE and max(map(len, chunk.split(b" "))) > LONG_PIECE:
            return np.array(self.exact.encode(chunk.decode(), add_special_tokens=False).ids, dtype=np.uint32)
        special = "all" if any(m in chunk for m in self.marks) else set()
        return self.fast.encode_to_numpy(chunk.decode(), allowed_special=special, disallowed_special=())

    def encode(self, chunk: bytes, strange: bool) -> tuple[np.ndarray, np.ndarray]:
        """Tokens and the byte after each."""
        self.asked += len(chunk)
        hit = self.young.get(chunk)
        if hit is None:
            hit = self.old.pop(chunk, None)
            if hit is None:
                ids = self.plain(chunk, strange)
                hit = ids, np.cumsum(self.lengths[ids])
                self.encoded += len(chunk)
            self.young[chunk] = hit
            self.size += len(chunk) + 12 * len(hit[0]) + 300
            if self.size > self.limit:
                self.old, self.young, self.size = self.young, {}, 0
        return hit

    def decode(self, ids: np.ndarray) -> str:
        return self.fast.decode_bytes(ids.tolist()).decode("utf-8", errors="replace")


def cuts(data: np.ndarray, bounds: np.ndarray, powers: W.Powers) -> np.ndarray:
    """Ascending places of the cuts in a slice, at starts of characters; document bounds are not among them."""
    if len(data) <= WINDOW:
        return np.zeros(0, dtype=np.int64)
    rolled = W.mix(W.Rolling(data.astype(np.uint64) + np.uint64(1), powers).windows(WINDOW))
    at = np.flatnonzero(rolled >> np.uint64(64 - CUT_BITS) == 0) + WINDOW
    start = bounds[np.searchsorted(bounds, at, "right") - 1]
    at = at[(at - start >= WINDOW) & (at < len(data))]
    for _ in range(3):
        inside = (data[np.minimum(at, len(data) - 1)] & 0xC0) == 0x80
        at = at + inside
    return np.setdiff1d(at, bounds)


def sync_places(data: np.ndarray) -> np.ndarray:
    letter = W.byte_set((65, 90), (97, 122))[data]
    return np.flatnonzero((data[1:-1] == 0x20) & letter[:-2] & letter[2:]) + 1


def strange_bytes(data: np.ndarray) -> np.ndarray:
    """Bytes of characters from U+0240 on and of the controls U+0080 to U+009F."""
    out = data >= 0xC9
    out[:-1] |= (data[:-1] == 0xC2) & (data[1:] < 0xA0)
    return out


def part(found: tuple[np.ndarray, np.ndarray], low: int, high: int) -> np.ndarray | None:
    """Tokens of the bytes from low to high of a chunk; None if a token crosses either place."""
    ids, ends = found
    i, j = np.searchsorted(ends, low, "right"), np.searchsorted(ends, high, "right")
    whole = (low == 0 or i > 0 and ends[i - 1] == low) and (high == 0 or j > 0 and ends[j - 1] == high)
    return ids[i:j] if whole else None


def encode_one(text: bytes, edges: list[int], sync: np.ndarray, strange: np.ndarray, coder: Coder) -> np.ndarray:
    """Tokens of a document from its chunks; `edges` from 0 to its length, `strange`: number of strange bytes before each place."""

    def code(low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        return coder.encode(text[low:high], bool(strange[high] > strange[low]))

    if len(edges) == 2:
        return code(0, len(text))[0]
    end, out, i, start = len(text), [], 0, 0
    chunk = code(edges[0], edges[1])
    while i < len(edges) - 2:
        cut, wide = edges[i + 1], 1
        before, after = int(np.searchsorted(sync, cut, "right")) - 1, int(np.searchsorted(sync, cut, "left"))
        while True:
            left = int(sync[before - wide]) if before >= wide else 0
            near_left = int(sync[before]) if before >= 0 else 0
            right = int(sync[after + wide]) if after + wide < len(sync) else end
            near_right = int(sync[after]) if after < len(sync) else end
            left, near_left = max(left, start), max(near_left, start)
            j = i + 1
            while edges[j + 1] < right:
                j += 1
            if edges[j] > near_right:
                near_right = right  # the next chunk begins past it: nothing to compare
            joined = code(left, right)
            kept = part(chunk, start - edges[i], left - edges[i])
            same_left = part(chunk, left - edges[i], near_left - edges[i])
            head = part(joined, 0, near_left - left)
            agree = kept is not None and same_left is not None and head is not None and np.array_equal(same_left, head)
            following = code(edges[j], edges[j + 1])
            if agree and right < end:
                same_right = part(following, near_right - edges[j], right - edges[j])
                tail = part(joined, near_right - left, right - left)
                agree = same_right is not None and tail is not None and np.array_equal(same_right, tail)
            if agree or left == start and right == end:
                break
            wide *= 2
        out += [kept if kept is not None else part(chunk, start - edges[i], left - edges[i]), joined[0]]
        if right == end:
            return np.concatenate(out)
        i, start, chunk = j, right, following
    out.append(part(chunk, start - edges[i], end - edges[i]))
    return np.concatenate(out)


def encode_batches(batches: Iterator[pa.RecordBatch], vocabulary: str, ranks: str) -> Iterator[pa.RecordBatch]:
    coder, powers = Coder(vocabulary, ranks), W.Powers(W.BYTE_BASE)
    for batch in batches:
        for low, high, data, bounds in W.slices(batch.column("text")):
            raw, at = data.tobytes(), cuts(data, bounds, powers)
            odd = np.concatenate([[0], np.cumsum(strange_bytes(data))])
            sync = sync_places(data)
            tokens = []
            for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = at[np.searchsorted(at, a):np.searchsorted(at, b)]
                mine = sync[np.searchsorted(sync, a, "right"):np.searchsorted(sync, b - 1)] - a
                tokens.append(encode_one(raw[a:b], [0, *(own - a).tolist(), b - a], mine, odd[a:b + 1], coder))
            yield pa.RecordBatch.from_arrays([
                batch.column("row").slice(low, high - low), batch.column("doc_id").slice(low, high - low), pa.array([len(t) for t in tokens], pa.int64()),
                pa.array([t.astype("<u4").tobytes() for t in tokens], pa.binary()), pa.array([coder.decode(t) for t in tokens], pa.string())],
                names=["row", "doc_id", "n_tokens", "ids", "decoded"])


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY, ranks: str = RANKS) -> DataFrame:
    """row, doc_id, n_tokens, ids (little-endian 32-bit), decoded: one row per input row, nothing is shuffled."""
    return C.text_of(docs).mapInArrow(lambda batches: encode_batches(batches, vocabulary, ranks), SCHEMA)


def op2_bpe_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(C.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op2_bpe_chunks": op2_bpe_chunks}
ORACLES: dict[str, str] = {}
