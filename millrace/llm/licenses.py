"""Operator 1, license scans: exact set-similarity join of text blocks with license templates.

A block is `width` consecutive words of a text (the whole text, if it has fewer).  A template matches a block
when the share of the template's distinct words that the block holds reaches the template's threshold.
Words are ordered by their frequency over the whole corpus, rarest first (counted for the templates' words
only, as no others can match).  Of a template's m words with `need` to be found, every matching block holds one
of the m - need + 1 rarest (prefix filter); texts of fewer than `need` words cannot match (length filter); and a
block whose rarest template word is the template's i-th can share m - i words at most, and no more than
the template words around it (positional filter).  Blocks that pass are counted exactly.  Base phrases are
templates with threshold 1 as wide as the phrase; their blocks are then compared word by word, in order.

Null and empty texts have no words and no labels; repeated rows give repeated results; a null id stays
null; ties in frequency are ordered by the word; empty tables give empty results; other columns are not read.  A very long text
is one slice, and takes its task some 60 bytes for each of its words.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_texts, record, texts
from millrace.llm.words import Words

#: Base phrases and their labels.
PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))
#: Opening words of license notices, and the share of their words that a block must hold.
NOTICES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction", 0.8),
    ("apache-2", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license", 0.8),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", 0.8),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", 0.8),
    ("gpl", "licensed under the gnu general public license version", 0.85),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", 0.85),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", 0.8),
    ("unlicense", "this is free and unencumbered software released into the public domain", 0.85),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", 0.85),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", 0.9),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", 0.9),
    ("reserved", "copyright all rights reserved no part of this publication may be reproduced", 0.85),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    threshold: float
    ordered: bool = False

    @property
    def width(self) -> int:
        return len(self.words) if self.ordered else len(self.words) * 5 // 4


def default_templates() -> list[Template]:
    return [*(Template(label, tuple(p.split()), 1.0, True) for label, p in PHRASES), *(Template(label, tuple(p.split()), t) for label, p, t in NOTICES)]


class Index:
    """Templates against the corpus frequencies of their words."""

    def __init__(self, templates: list[Template], frequency: dict[str, int]):
        self.vocabulary = sorted({w for t in templates for w in t.words})
        hashes = Words(pa.array([" ".join(self.vocabulary)])).hash
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order
        rank = {w: i for i, w in enumerate(sorted(self.vocabulary, key=lambda w: (frequency.get(w, 0), w)))}
        number = {w: i for i, w in enumerate(self.vocabulary)}
        self.templates = []
        for t in templates:
            own = sorted(set(t.words), key=rank.__getitem__)
            need = max(1, math.ceil(t.threshold * len(own) - 1e-9))
            place = np.full(len(self.vocabulary), -1)
            place[[number[w] for w in own]] = np.arange(len(own))
            self.templates.append((t, [number[w] for w in t.words], place, len(own), need))

    def tokens(self, words: Words) -> np.ndarray:
        """Each word's number in the vocabulary, or -1."""
        if not len(words) or not len(self.hashes):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.hashes, words.hash), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words.hash, self.number[at], -1)

    def find(self, words: Words) -> list[tuple[int, int, int, int, float]]:
        """(text, template, first word, end word, containment): every place of an ordered template, and of the others the blocks that begin at a word of theirs and reach the threshold."""
        out = []
        token = self.tokens(words)
        known = np.flatnonzero(token >= 0)
        if not len(known):
            return out
        text_of = np.searchsorted(words.first, known, "right") - 1
        kind = token[known]
        for n, (t, sequence, place, m, need) in enumerate(self.templates):
            rank = place[kind]
            prefix = np.flatnonzero((rank >= 0) & (rank <= m - need))  # prefix and positional filter on the template's side
            if not len(prefix):
                continue
            if t.ordered:
                offset = next(i for i, w in enumerate(sequence) if place[w] == 0)
                seq = np.array(sequence)
                for i in prefix.tolist():
                    a = int(known[i]) - offset
                    low, high = words.first[text_of[i]], words.first[text_of[i] + 1]
                    if a >= low and a + len(seq) <= high and (token[a : a + len(seq)] == seq).all() and self._same(words, a, t):
                        out.append((int(text_of[i]), n, a, a + len(seq), 1.0))
                continue
            mine = np.flatnonzero(rank >= 0)
            where, ranks, owner = known[mine], rank[mine], text_of[mine]
            done = -1
            for i in np.searchsorted(mine, prefix).tolist():
                text, p = int(owner[i]), int(where[i])
                if words.first[text + 1] - words.first[text] < need:  # length filter
                    continue
                a = int(np.searchsorted(where, max(p - t.width + 1, words.first[text])))
                b = int(np.searchsorted(where, min(p + t.width, words.first[text + 1])))
                if b - a < need or len(np.unique(ranks[a:b])) < need:  # positional filter on the text's side
                    continue
                for s in range(max(a, done + 1), i + 1):  # blocks that begin at a template word and reach p
                    done = s
                    e = int(np.searchsorted(where, min(int(where[s]) + t.width, words.first[text + 1])))
                    if e - s < need:
                        continue
                    found = {int(ranks[x]) for x in range(s, e) if self._same(words, int(where[x]), t, int(kind[mine[x]]))}
                    if len(found) >= need:
                        out.append((text, n, int(where[s]), int(where[e - 1]) + 1, len(found) / m))
        return out

    def _same(self, words: Words, a: int, t: Template, number: int | None = None) -> bool:
        """Words compared themselves, not their hashes."""
        if number is not None:
            return words.word(a) == self.vocabulary[number].encode()
        return all(words.word(a + k) == w.encode() for k, w in enumerate(t.words))


def frequencies(docs: DataFrame, templates: list[Template]) -> dict[str, int]:
    """How often each template word stands in the whole corpus."""

    def make():
        index = Index(templates, {})

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            token = index.tokens(Words(part.column("text")))
            n = np.bincount(token[token >= 0], minlength=len(index.vocabulary))
            return record(word=pa.array(index.vocabulary, pa.string()), n=pa.array(n, pa.int64()))

        return work

    counted = map_texts(docs.select("text"), make, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r.word: r.n for r in counted.collect()}  # one row a template word


def scan_licenses(docs: DataFrame, templates: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, and blocks (label, start, end, containment; in words)."""
    templates = default_templates() if templates is None else templates
    docs = texts(docs, id_col, text_col)
    frequency = frequencies(docs, templates)

    def make():
        index = Index(templates, frequency)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            words = Words(part.column("text"))
            n = len(words.first) - 1
            base: list[list] = [[] for _ in range(n)]
            blocks: list[list] = [[] for _ in range(n)]
            for text, k, a, b, share in index.find(words):
                t, low = templates[k], int(words.first[text])
                blocks[text].append({"label": t.label, "start": a - low, "end": b - low, "containment": share})
                if t.ordered:
                    base[text].append((a - low, t.label))
            names = [",".join(sorted({x["label"] for x in one})) for one in blocks]
            return record(
                doc_id=part.column("doc_id"), n_words=pa.array(words.counts(), pa.int64()), n_base=pa.array([len(x) for x in base], pa.int64()),
                first_word=pa.array([min(x)[0] if x else None for x in base], pa.int64()), last_word=pa.array([max(x)[0] if x else None for x in base], pa.int64()),
                base_labels=pa.array([",".join(sorted({k for _, k in x})) for x in base], pa.string()), labels=pa.array(names, pa.string()),
                score=pa.array([max((x["containment"] for x in one), default=0.0) for one in blocks], pa.float64()),
                blocks=pa.array(blocks, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))))

        return work

    return map_texts(docs, make, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<label: string, start: long, end: long, containment: double>>")
