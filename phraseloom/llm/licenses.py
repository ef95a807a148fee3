"""License scan: phrase places, and an exact set-similarity join of text blocks with license templates.

A block is a line, or a window of ``WINDOW`` words (every ``WINDOW // 2`` words) of a longer line; with ``wrapped``, as in the query, also such windows
of the whole document, so that a statement broken over lines is one block.  Templates are sentences of license texts and notices.  A block is a candidate for a template when it holds
at least ``CONTAINMENT`` of the template's distinct words.  This join is exact: template words are put in one global
order, rarest in the corpus first (their numbers are counted over all documents), and

* prefix filter: a template of n words that must share o of them meets every matching block in its first n - o + 1 words, so only
  blocks that hold one of those words are looked at;
* length filter: a block with fewer than o template words can't match;
* positional filter: after a common word at places i and j of the two ordered sets, at most
  min(n - i, m - j) words can still be common.

A candidate is a match when the words also stand in order: among ``SPREAD`` times as many words as the template has, at least ``CONTAINMENT`` of its words follow each other as in the
template, and among them stand the words that tell the license from others with the same phrasing (its names).  The score is the share of words in order.

The templates are a fixed small set (``TEMPLATES``), so their words and counts are bounded; documents never leave their
task and nothing is shuffled but one count per template word.

Defined cases: a null or empty text has no words, places or labels (empty strings, null first and last word, score 0).
Repeated rows give equal rows; templates with equal containment all label the block.  Extra columns are ignored.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import map_arrow, map_blocks, texts_of
from .textkernel import ALNUM, LOWER, WORD_HASH, blocks, owners, word_spans

CONTAINMENT = 0.8
WINDOW = 64
SPREAD = 2

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Sentences of license texts and notices, their labels, and the names without which they aren't that license's.
TEMPLATES = [
    ("this work is licensed under the gnu general public license version 3", "gpl", "gnu"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl", "gnu"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl", "gnu"),
    ("you should have received a copy of the gnu general public license along with this program", "gpl", "gnu"),
    ("everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "gpl", "verbatim"),
    ("licensed under the apache license version 2 0", "apache", "apache"),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache", "compliance"),
    ("unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis", "apache", "basis"),
    ("see the license for the specific language governing permissions and limitations under the license", "apache", "limitations"),
    ("released under the mit license", "mit", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit", "granted"),
    ("to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "mit", "sublicense"),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "mit", "portions"),
    ("the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability", "mit", "software"),
    ("licensed under cc by nc 4 0", "cc-by", "cc by"),
    ("this work is licensed under a creative commons attribution license", "cc-by", "creative commons"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by", "creative commons"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd", "redistribution"),
    ("redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "bsd", "redistributions"),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer", "bsd", "redistributions"),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd", "endorse"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl", "mozilla"),
    ("if a copy of the mpl was not distributed with this file you can obtain one at", "mpl", "mpl"),
    ("all rights reserved", "all-rights-reserved", "all rights reserved"),
    ("this work has been released into the public domain", "public-domain", "public domain"),
    ("this is free and unencumbered software released into the public domain", "public-domain", "public domain"),
]


def word_hashes(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw]).astype(np.int64)
    return WORD_HASH.words(np.frombuffer(b"".join(raw), np.uint8), ends - np.array([len(r) for r in raw], np.int64), ends)


def _words(data: np.ndarray, borders: np.ndarray):
    data = LOWER[data]
    starts, ends, first = word_spans(data, borders, ALNUM)
    return data, starts, first, WORD_HASH.words(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)


class Vocabulary:
    """The distinct words of the templates, by hash."""

    def __init__(self, templates=TEMPLATES):
        self.words = sorted({w for t, *_ in templates for w in t.split()})
        hashes = word_hashes(self.words)
        order = np.argsort(hashes)
        self.hashes, self.number = hashes[order], order

    def find(self, words: np.ndarray) -> np.ndarray:
        """Number of each word in ``self.words``, -1 for others."""
        at = np.minimum(np.searchsorted(self.hashes, words), len(self.hashes) - 1)
        return np.where(self.hashes[at] == words, self.number[at], -1)


def count_words(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """Occurrences of each template word in all documents."""

    def run(batches):
        counts = np.zeros(len(vocabulary.words), np.int64)
        for batch in batches:
            for _, _, data, borders in blocks(batch.column(0)):
                found = vocabulary.find(_words(data, borders)[3])
                counts += np.bincount(found[found >= 0], minlength=len(counts))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], ["word", "n"])

    counted = map_arrow(docs.select(F.col("text").cast("string").alias("text")), run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(vocabulary.words), np.int64)
    for r in counted:
        out[r.word] = r.n
    return out


class Join:
    """The templates in the global order, and the filters."""

    def __init__(self, counts: np.ndarray, vocabulary: Vocabulary, templates=TEMPLATES, threshold: float = CONTAINMENT):
        self.rank = np.empty(len(counts), np.int64)
        self.rank[np.lexsort((np.arange(len(counts)), counts))] = np.arange(len(counts))
        number = {w: i for i, w in enumerate(vocabulary.words)}
        self.templates, self.by_prefix, self.threshold = [], {}, threshold
        for t, (text, label, *names) in enumerate(templates):
            order = [int(self.rank[number[w]]) for w in text.split()]
            ranks = sorted(set(order))
            need = ceil(threshold * len(ranks) - 1e-9)
            self.templates.append((ranks, need, label, order, {int(self.rank[number[w]]) for x in names for w in x.split()}))
            for i, r in enumerate(ranks[: len(ranks) - need + 1]):
                self.by_prefix.setdefault(r, []).append((t, i))
        self.prefix = np.zeros(len(counts), bool)
        self.prefix[list(self.by_prefix)] = True

    def match(self, block: list[int]) -> list[tuple[str, float]]:
        """(label, share of words in order) of the templates that match a block, given the ranks of its words in text order (-1 for other words)."""
        found, seen = [], set()
        ordered = sorted({r for r in block if r >= 0})
        for j, r in enumerate(ordered):
            for t, i in self.by_prefix.get(r, ()):
                ranks, need, label, order, names = self.templates[t]
                if t in seen or len(ordered) < need or min(len(ranks) - i, len(ordered) - j) < need - i:
                    continue
                seen.add(t)
                if len(set(ranks).intersection(ordered)) >= need:
                    share = in_order(block, order, names)
                    if share >= self.threshold - 1e-9:
                        found.append((label, share))
        return found


def in_order(block: list[int], order: list[int], names: set[int]) -> float:
    """The largest share of the words of ``order`` that follow each other, in that order, within ``SPREAD`` times as many words of the block that hold all ``names``."""
    there = [(i, r) for i, r in enumerate(block) if r in set(order)]
    best = 0
    for k, (start, _) in enumerate(there):
        near = [r for i, r in there[k:] if i < start + SPREAD * len(order)]
        if len(near) > best and names <= set(near):
            row = [0] * (len(order) + 1)  # longest common subsequence of what was read so far and each head of the template
            for r in near:
                before = 0
                for j, w in enumerate(order, 1):
                    before, row[j] = row[j], before + 1 if w == r else max(row[j], row[j - 1])
            best = max(best, row[-1])
    return best / len(order)


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = CONTAINMENT, wrapped: bool = False) -> DataFrame:
    """A row for each document (``wrapped``: blocks cross line breaks too): n_words, n_base, first_word, last_word, base_labels, labels, score, n_blocks."""
    vocabulary = Vocabulary(templates)
    join = Join(count_words(docs, vocabulary), vocabulary, templates, threshold)
    wanted = [(word_hashes(p.split()), label) for p, label in phrases.items()]

    def kernel(rows, data, borders):
        data, starts, first, words = _words(data, borders)
        n = len(borders) - 1
        base, labels = [set() for _ in range(n)], [set() for _ in range(n)]
        n_base, score, n_blocks = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
        low, high = np.full(n, np.iinfo(np.int64).max), np.full(n, -1)
        for hashes, label in wanted:
            at = np.flatnonzero(words[: len(words) - len(hashes) + 1] == hashes[0]) if len(words) >= len(hashes) else np.zeros(0, np.int64)
            for k in range(1, len(hashes)):
                at = at[words[at + k] == hashes[k]]
            of = owners(first, at)
            ok = at + len(hashes) <= first[of + 1]
            at, of = at[ok], of[ok]
            np.add.at(n_base, of, 1)
            np.minimum.at(low, of, at - first[of])
            np.maximum.at(high, of, at - first[of])
            for d in set(of.tolist()):
                base[d].add(label)
                score[d] = 1.0
        if len(words):
            known = vocabulary.find(words)
            lines = np.searchsorted(np.union1d(np.flatnonzero(data == 10), borders), starts, side="right")
            cuts = np.flatnonzero(np.diff(lines, prepend=-1))  # the first word of each line
            hits = np.flatnonzero(known >= 0)
            hits = hits[join.prefix[join.rank[known[hits]]]]
            half, of_hit = WINDOW // 2, {}
            for begin in (cuts, np.unique(first[:-1][np.diff(first) > 0])) if wrapped else (cuts,):
                ends = np.append(begin[1:], len(words))
                for h, c in zip(hits.tolist(), (np.searchsorted(begin, hits, side="right") - 1).tolist()):
                    a, b = int(begin[c]), int(ends[c])
                    if b - a <= WINDOW:
                        of_hit[a, b] = None
                    else:
                        k = (h - a) // half
                        for s in (k - 1, k):
                            if s >= 0:
                                of_hit[a + s * half, min(b, a + s * half + WINDOW)] = None
            for a, b in of_hit:
                block = known[a:b]
                found = join.match(np.where(block >= 0, join.rank[block], -1).tolist())
                if found:
                    d = int(owners(first, np.array([a]))[0])
                    n_blocks[d] += 1
                    score[d] = max(score[d], *(c for _, c in found))
                    labels[d].update(x for x, _ in found)
        has = n_base > 0
        return [rows.column(0), np.diff(first), n_base, pa.array(low, mask=~has), pa.array(high, mask=~has), [",".join(sorted(x)) for x in base], [",".join(sorted(x | y)) for x, y in zip(base, labels)], score, n_blocks]

    return map_blocks(texts_of(docs), kernel, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, n_blocks long")


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), wrapped=True)
