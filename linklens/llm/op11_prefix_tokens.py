"""SentencePiece BPE encoding by a table of each prefix's last token, and decoding.

A merge encoding has two properties: what it gives for a prefix of a text does not
depend on what follows a token's end, and a sequence of tokens is an encoding exactly
if every two neighbours are the encoding of their own two strings.  So every prefix of
a stretch of text has exactly one last token: the only piece that ends there (found by
an Aho-Corasick automaton over all pieces) and is compatible with the last token of the
prefix before it.  The table is filled from left to right, in time linear in the length
whatever the text, and the ids are read off backwards from its end.

Stretches are independent of each other at two kinds of places.  No piece of the
vocabulary has a space after another character, so a stretch is a run of spaces with
the word after it; a task remembers the ids of short ones in a cache of bounded size.
A character that is no piece takes part in no merge; it becomes its UTF-8 bytes.

Defined results: a null text is empty; an empty text has the end id alone; repeated
rows are rows of their own; strings that look like control pieces are ordinary text;
the character U+2581 is a space, as in the library.  A text of any length is encoded
whole; its table takes four bytes for each character of its longest stretch.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.llm import common as C
from linklens.llm import words as W

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
STRETCH = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Longest stretch that is remembered, stretches and pairs of tokens remembered in a generation.
SHORT, STRETCHES, PAIRS = 48, 200_000, 1_000_000
#: Characters from which a stretch's table is packed, four bytes each.
LONG = 4096
SCHEMA = "row long, doc_id long, ids array<int>, decoded string"


class Pieces:
    """Vocabulary of a BPE model file, its automaton, and what a task remembers."""

    def __init__(self, model: str = MODEL):
        import ahocorasick
        import public_tokenizers
        import sentencepiece

        read = sentencepiece.SentencePieceProcessor(model_file=model if "/" in model else public_tokenizers.path(model))
        every = range(read.get_piece_size())
        self.text = [read.id_to_piece(i) for i in every]
        self.byte = {int(self.text[i][3:5], 16): i for i in every if read.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.unknown, self.end = read.unk_id(), read.eos_id()
        self.silent = {i for i in every if read.is_control(i)}
        plain = {i for i in every if not (read.is_byte(i) or read.is_control(i) or read.is_unknown(i) or read.is_unused(i))}
        self.id = {self.text[i]: i for i in sorted(plain)}
        self.rank = {self.text[i]: -read.get_score(i) for i in sorted(plain)}
        if any(SPACE in p.lstrip(SPACE) for p in self.id):
            raise ValueError("a piece has a space after another character: words can't be encoded apart")
        self.alone = {p for p in self.id if len(p) == 1}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for p, i in self.id.items():
            self.automaton.add_word(p, (len(p), i))
        self.automaton.make_automaton()
        self.stretches: list[dict[str, bytes]] = [{}, {}]
        self.pairs: dict[int, bool] = {}
        self.split: dict[int, tuple[int, int]] = {}
        # rank at which a token is made, -1 for a character's; of each two tokens that may be joined, the rank of what they make
        self.made = [self.rank[t] if len(t) > 1 and i in plain else -1.0 for i, t in enumerate(self.text)]
        self.joins = {self.id[p[:k]] * len(self.text) + self.id[p[k:]]: r for p, r in self.rank.items() for k in range(1, len(p)) if p[:k] in self.id and p[k:] in self.id}
        self.blank = {i for p, i in self.id.items() if not p.strip(SPACE)}
        self.begins_blank = {i for p, i in self.id.items() if p.startswith(SPACE)}
        self.spoken = np.array([i not in self.silent for i in every])
        self.strange = np.array([i in self.byte_of or i == self.unknown for i in every])
        self.high = np.array([self.byte_of.get(i, 0) > 0x7F for i in every])
        # what an id alone is decoded to, after the first; bytes beyond ASCII depend on their neighbours
        self.shown = ["" if i in self.silent else chr(self.byte_of[i]) if i in self.byte_of else " ⁇ " if i == self.unknown else t.replace(SPACE, " ") for i, t in enumerate(self.text)]
        self.size = [len(t) for t in self.text]
        foreign = "".join(re.escape(c) for c in sorted(self.alone))
        self.runs = re.compile(f"[{foreign}]+|[^{foreign}]")

    def merged(self, text: str) -> list[str]:
        """Merges of a short string by rank, the leftmost of equals first; the definition that pairs are held against."""
        parts = list(text)
        while True:
            found = [(self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.id]
            if not found:
                return parts
            k = min(found)[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens that the last merge of a token joins; -1 for a character's."""
        found = self.split.get(token)
        if found is None:
            parts = list(self.text[token])
            while len(parts) > 2:
                k = min((self.rank[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.id)[1]
                parts[k:k + 2] = [parts[k] + parts[k + 1]]
            found = self.split[token] = (self.id[parts[0]], self.id[parts[1]]) if len(parts) == 2 else (-1, -1)
        return found

    def apart(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens of different ranks.

        The merges of both are undone, the later one first: the two parts then at the
        border stood there until the merge just undone, and must not join before it.
        """
        limit, same, joins, made, count = float("inf"), False, self.joins, self.made, len(self.text)
        while True:
            crossing = joins.get(left * count + right)
            if crossing is not None and (crossing < limit or same and crossing == limit):
                return False
            made_left, made_right = made[left], made[right]
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                limit, same, left = made_left, False, (self.split.get(left) or self.halves(left))[1]
            else:  # of equal merges the left one comes first
                limit, same, right = made_right, True, (self.split.get(right) or self.halves(right))[0]

    def compatible(self, before: int, token: int) -> bool:
        """Whether the two tokens are what their strings together are merged to; before < 0: the token alone."""
        if before >= 0 and before not in self.blank and token not in self.begins_blank:
            known = self.apart(before, token)
        else:  # all runs of spaces have one rank: merged in full
            left, right = self.text[before] if before >= 0 else "", self.text[token]
            known = self.merged(left + right) == ([left, right] if left else [right])
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[before * len(self.text) + token] = known
        return known

    def prefix_table(self, run: str) -> list[int]:
        """Last token of each prefix of a run of known characters; -1 for the empty one."""
        last = [-1] * (len(run) + 1) if len(run) < LONG else array("i", [-1]) * (len(run) + 1)
        pairs, count = self.pairs, len(self.text)
        found = -1
        for end, (size, token) in self.automaton.iter(run):
            if end != found:
                before = last[end + 1 - size]
                if before >= 0 or size == end + 1:
                    fits = pairs.get(before * count + token)
                    if fits or fits is None and self.compatible(before, token):
                        last[end + 1] = token
                        found = end
        return last

    def run_ids(self, run: str) -> list[int]:
        last, at, out = self.prefix_table(run), len(run), []
        while at:
            out.append(last[at])
            at -= self.size[last[at]]
        out.reverse()
        return out

    def stretch_ids(self, stretch: str) -> list[int]:
        out: list[int] = []
        for run in self.runs.findall(stretch):
            if run[0] in self.alone:
                out += self.run_ids(run)
            elif self.byte:
                out += [self.byte[b] for b in run.encode()]
            else:
                out.append(self.unknown)
        return out

    def stretch_bytes(self, stretch: str) -> bytes:
        young, old = self.stretches
        hit = young.get(stretch) or old.get(stretch)
        if hit is None:
            hit = array("i", self.stretch_ids(stretch)).tobytes()
        if len(stretch) <= SHORT and stretch not in young:
            young[stretch] = hit
            if len(young) >= STRETCHES:
                self.stretches = [{}, young]
        return hit

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text with the end id."""
        if not text:
            return np.array([self.end], dtype=np.int32)
        spaced = SPACE + text.replace(" ", SPACE)
        get = self.stretches[0].get
        parts = [get(s) or self.stretch_bytes(s) for s in STRETCH.findall(spaced)]
        parts.append(array("i", [self.end]).tobytes())
        return np.frombuffer(b"".join(parts), dtype=np.int32)

    def decode(self, ids: Sequence[int] | np.ndarray) -> str:
        """Text of any ids: bytes that are no UTF-8 become U+FFFD one by one, the first piece loses its leading space."""
        ids = np.asarray(ids, dtype=np.int64)
        out = list(map(self.shown.__getitem__, ids.tolist()))
        spoken = self.spoken[ids]
        first = int(spoken.argmax()) if len(ids) else 0
        if len(ids) and spoken[first] and not self.strange[ids[first]]:
            out[first] = self.text[ids[first]].removeprefix(SPACE).replace(SPACE, " ")
        # an ASCII byte is a character by itself, so only runs of other bytes are read together
        high = np.flatnonzero(self.high[ids])
        if len(high):
            for run in np.split(high, np.flatnonzero(np.diff(high) > 1) + 1):
                low, end = int(run[0]), int(run[-1]) + 1
                out[low:end] = [bytes_text(bytes(self.byte_of[i] for i in ids[low:end].tolist())), *[""] * (end - low - 1)]
        return "".join(out)


def bytes_text(data: bytes) -> str:
    """UTF-8 with each byte that belongs to no whole character as one U+FFFD."""
    out, at = [], 0
    while at < len(data):
        try:
            out.append(data[at:].decode())
            break
        except UnicodeDecodeError as e:
            out.append(data[at:at + e.start].decode() + "�")
            at += e.start + 1
    return "".join(out)


def encode_batches(batches: Iterator[pa.RecordBatch], model: str) -> Iterator[pa.RecordBatch]:
    pieces = Pieces(model)
    for batch in batches:
        for low, high, _, _ in W.slices(batch.column("text")):
            ids = [pieces.encode(t) for t in batch.column("text").slice(low, high - low).to_pylist()]
            ends = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("row").slice(low, high - low), batch.column("doc_id").slice(low, high - low),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids))), pa.array([pieces.decode(i) for i in ids], pa.string())],
                names=["row", "doc_id", "ids", "decoded"])


def encoded(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """row, doc_id, ids, decoded: one row per input row, nothing is shuffled.  `model` is a public file's name or a path."""
    return C.text_of(docs).mapInArrow(lambda batches: encode_batches(batches, model), SCHEMA)


def op11_prefix_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encoded(C.table(spark, sf_dir, "documents")).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op11_prefix_tokens": op11_prefix_tokens}
ORACLES: dict[str, str] = {}
