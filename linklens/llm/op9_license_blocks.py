"""License scan: known phrases, and an exact set-similarity join of text blocks with templates.

Base places are where a phrase's words stand one after the other.  The method's
labels come from templates: a block, that is a window of `BLOCK` words that moves by
half its length, matches a template if it holds at least `SHARE` per cent of the
template's different words.  The join is exact.  Template words are ordered by their
document frequency over the whole corpus, the rarest first.  A block that matches
holds one of the first |T| - ceil(t |T|) + 1 words of that order (prefix filter), is
not shorter than ceil(t |T|) different words (length filter), and if the first of its
words in that order stands at place i, at most |T| - i can be shared (positional
filter).  Only pairs that pass are verified, on whole sets.

Every window of `BLOCK` / 2 words is inside one block, and templates are shorter than
that, so no match hides between two blocks.  The templates are a parameter of a fixed
number of short texts; they and their order are all that is broadcast.  Documents are
read twice and never shuffled; word counts are summed in each task.

Defined results: null and empty texts have no words, no labels and score 0; first and
last word are null without a base place; repeated rows are rows of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linklens.llm import common as C
from linklens.llm import words as W

# fixed values: phrases and their labels
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Templates of the method's labels; longer notices are given by several sentences.
TEMPLATES = (
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
)
SHARE, BLOCK = 80, 64
SCHEMA = ("row long, doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
          "matches array<struct<label: string, first: long, share: double>>")


def word_hash(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    powers = W.Powers(W.BYTE_BASE)
    return W.Words(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]), W.ALNUM, powers).hash if words else np.zeros(0, dtype=np.uint64)


@dataclass
class Scanner:
    phrases: tuple[tuple[str, str], ...]
    templates: tuple[tuple[str, str], ...]
    share: int = SHARE
    block: int = BLOCK
    #: how often each template word stands in documents
    frequency: dict[str, int] = field(default_factory=dict)

    def __post_init__(self):
        self.labels = sorted({label for _, label in self.phrases} | {label for label, _ in self.templates})
        self.sets = [(label, sorted(set(text.split()), key=lambda w: (self.frequency.get(w, 0), w))) for label, text in self.templates]
        if any(len(text.split()) > self.block // 2 for _, text in self.templates):
            raise ValueError("a template is longer than half a block")
        self.vocabulary = sorted({w for _, words in self.sets for w in words})
        hashes = word_hash(self.vocabulary)
        self.order = np.argsort(hashes)
        self.known = hashes[self.order]
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.places = [(label, np.array([number[w] for w in words]), -(-self.share * len(words) // 100)) for label, words in self.sets]
        # prefix filter: which templates a word stands for, if it is among their rarest
        self.of_word: dict[int, list[int]] = {}
        for t, (_, words, least) in enumerate(self.places):
            for w in words[:len(words) - least + 1].tolist():
                self.of_word.setdefault(w, []).append(t)
        self.rare = np.array([w in self.of_word for w in range(len(self.vocabulary))] + [False])  # the last stands for code -1
        self.lines = [(label, word_hash(phrase.split())) for phrase, label in self.phrases]

    def codes(self, hashes: np.ndarray) -> np.ndarray:
        """Number of each word in the templates' vocabulary, -1 for all others."""
        if not len(self.known):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, self.order[at], -1)

    def base(self, words: W.Words) -> list[tuple[str, np.ndarray]]:
        """Label and first words of every place of a phrase."""
        out, left = [], words.left()
        for label, line in self.lines:
            n = len(words.hash) - len(line) + 1
            if n > 0:
                ok = left[:n] >= len(line)
                for k, h in enumerate(line):
                    ok &= words.hash[k:k + n] == h
                out.append((label, np.flatnonzero(ok)))
        return out

    def blocks(self, codes: np.ndarray, low: int, high: int) -> Iterator[tuple[str, int, float]]:
        """Label, first word and share of the matches among the blocks of one document's words."""
        step = self.block // 2
        asked = set()
        for at in np.flatnonzero(self.rare[codes[low:high]]).tolist():
            for number in {at // step, max(at // step - 1, 0)}:
                asked.update((number, t) for t in self.of_word[int(codes[low + at])])
        for number, t in sorted(asked):
            label, words, least = self.places[t]
            a, b = low + number * step, min(low + number * step + self.block, high)
            if b - a < least:  # length filter: no set of so few words is large enough
                continue
            held = np.isin(words, codes[a:b])
            first = int(np.argmax(held))
            if not held[first] or len(words) - first < least:  # positional filter
                continue
            both = int(held.sum())
            if both >= least:
                yield label, a - low, both / len(words)


def count_batches(batches: Iterator[pa.RecordBatch], scanner: Scanner) -> Iterator[pa.RecordBatch]:
    """In how many documents of a task each template word stands."""
    powers, counts = W.Powers(W.BYTE_BASE), np.zeros(len(scanner.vocabulary), dtype=np.int64)
    for batch in batches:
        for _, _, data, bounds in W.slices(batch.column("text")):
            words = W.Words(W.lower_ascii(data), bounds, W.ALNUM, powers)
            codes = scanner.codes(words.hash)
            some = codes >= 0
            pairs = np.unique(words.doc[some] * len(counts) + codes[some])
            counts += np.bincount(pairs % len(counts), minlength=len(counts)) if len(counts) else 0
    yield pa.RecordBatch.from_arrays([pa.array(scanner.vocabulary, pa.string()), pa.array(counts)], names=["word", "n"])


def scan_batches(batches: Iterator[pa.RecordBatch], scanner: Scanner) -> Iterator[pa.RecordBatch]:
    powers = W.Powers(W.BYTE_BASE)
    for batch in batches:
        for low, high, data, bounds in W.slices(batch.column("text")):
            words = W.Words(W.lower_ascii(data), bounds, W.ALNUM, powers)
            codes, n = scanner.codes(words.hash), high - low
            counts, first, last = np.zeros(n, dtype=np.int64), np.full(n, np.iinfo(np.int64).max), np.full(n, -1, dtype=np.int64)
            base: list[set[str]] = [set() for _ in range(n)]
            for label, at in scanner.base(words):
                docs = words.doc[at]
                np.add.at(counts, docs, 1)
                np.minimum.at(first, docs, at - words.first[docs])
                np.maximum.at(last, docs, at - words.first[docs])
                for d in np.unique(docs).tolist():
                    base[d].add(label)
            matches: list[list[dict]] = [[] for _ in range(n)]
            for d in np.unique(words.doc[scanner.rare[codes]]).tolist():
                matches[d] = [{"label": x, "first": f, "share": s} for x, f, s in scanner.blocks(codes, int(words.first[d]), int(words.first[d + 1]))]
            none = counts == 0
            yield pa.RecordBatch.from_arrays([
                batch.column("row").slice(low, n), batch.column("doc_id").slice(low, n), pa.array(np.diff(words.first)), pa.array(counts),
                pa.array(first, mask=none), pa.array(last, mask=none), pa.array([",".join(sorted(b)) for b in base], pa.string()),
                pa.array([",".join(sorted(b | {m["label"] for m in ms})) for b, ms in zip(base, matches, strict=True)], pa.string()),
                pa.array([1.0 if b else max((m["share"] for m in ms), default=0.0) for b, ms in zip(base, matches, strict=True)], pa.float64()),
                pa.array(matches, pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("share", pa.float64())])))],
                names=["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])


def licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, share: int = SHARE, block: int = BLOCK) -> DataFrame:
    """Labels, places and matching blocks of every row."""
    texts = C.text_of(docs)
    plain = Scanner(PHRASES, templates, share, block)
    counted = texts.select("text").mapInArrow(lambda batches: count_batches(batches, plain), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    scanner = Scanner(PHRASES, templates, share, block, {r.word: r.n for r in counted.collect()})  # a row for each template word
    return texts.mapInArrow(lambda batches: scan_batches(batches, scanner), SCHEMA)


def op9_license_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(C.table(spark, sf_dir, "documents")).drop("row", "matches")


QUERIES = {"op9_license_blocks": op9_license_blocks}
ORACLES: dict[str, str] = {}
