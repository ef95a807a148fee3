"""Benchmark decontamination by greedy string tiling.

Words are runs of letters and digits, lower-cased (A-Z).  Every ``MIN_TILE``-word run of a benchmark item is a seed; a document that
shares seeds with an item is compared with it:  the longest run of words that both hold, outside earlier tiles, is marked
as a tile, again and again, down to ``MIN_TILE`` words.  Tiles never overlap, in the document or in the item, and may come in
any order, so a passage whose parts were moved about is still covered.  The longest length with a common run is found by bisection with
Karp-Rabin hashes of all unmarked runs of a length; hits are compared word by word (by 64-bit word hashes) before they are marked.
A document is contaminated by an item when tiles cover at least ``COVERAGE`` of the item's words.

Before tiling, a pair is dropped when even all of its seed places together couldn't reach that share: this bound loses nothing.

The seeds of the benchmark are broadcast in slices of at most ``SLICE_WORDS`` words; a larger benchmark takes one scan of the documents
for each slice.  Documents stay in their task, whole, and nothing of them is shuffled.

Defined cases: null and empty texts share nothing; an item with fewer words than ``MIN_TILE`` is one seed of all its words; an item without words never
matches; equal items are matched one by one; repeated rows give repeated rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import written as stored
from .frames import filter_blocks, map_blocks, texts_of
from .textkernel import ALNUM, KARP_RABIN, LOWER, WINDOW_HASH, WORD_HASH, window_hashes, word_spans

MIN_TILE = 5
COVERAGE = 0.6
SLICE_WORDS = 4_000_000


def _hashed(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = LOWER[data]
    starts, ends, first = word_spans(data, borders, ALNUM)
    return (WORD_HASH.words(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)), first


def _runs(words: np.ndarray, marked: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and Karp-Rabin hashes of the unmarked runs of ``size`` words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    taken = np.concatenate([[0], np.cumsum(marked)])
    at = np.flatnonzero(taken[size:] == taken[:-size])
    return at, KARP_RABIN.runs(words, at, at + size)


def tile(document: np.ndarray, item: np.ndarray, min_tile: int, marked: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (place in the document, place in the item, length), longest first."""
    in_doc = np.zeros(len(document), bool) if marked is None else marked.copy()
    in_item, tiles, size = np.zeros(len(item), bool), [], min(len(document), len(item))

    def common(n: int) -> bool:
        return bool(len(np.intersect1d(_runs(document, in_doc, n)[1], _runs(item, in_item, n)[1])))

    while size >= min_tile:
        low, high = min_tile - 1, size  # the longest common length lies in low..high
        while low < high:
            middle = (low + high + 1) // 2
            low, high = (middle, high) if common(middle) else (low, middle - 1)
        size = low
        if size < min_tile:
            break
        places, hashes = _runs(document, in_doc, size)
        order = np.argsort(hashes, kind="stable")
        places, hashes, before = places[order], hashes[order], len(tiles)
        for j, h in zip(*(x.tolist() for x in _runs(item, in_item, size))):
            if in_item[j : j + size].any():
                continue
            h = np.uint64(h)
            for i in places[np.searchsorted(hashes, h) : np.searchsorted(hashes, h, side="right")].tolist():
                if not in_doc[i : i + size].any() and (document[i : i + size] == item[j : j + size]).all():
                    in_doc[i : i + size] = in_item[j : j + size] = True
                    tiles.append((i, j, size))
                    break
        if len(tiles) == before:
            size -= 1
    return tiles


class Benchmark:
    """Items and their seeds, sorted by hash."""

    def __init__(self, ids: list[int], texts: list[str | None], min_tile: int = MIN_TILE):
        raw = [(t or "").encode() for t in texts]
        borders = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        words, first = _hashed(np.frombuffer(b"".join(raw), np.uint8), borders)
        self.ids, self.items = ids, [words[a:b] for a, b in zip(first[:-1], first[1:])]
        self.seeds: dict[int, tuple] = {}
        lengths = np.array([min(min_tile, len(i)) for i in self.items])
        for size in sorted(set(lengths.tolist()) - {0}):
            hashes, item, place = [], [], []
            for k in np.flatnonzero(lengths == size):
                at, h = window_hashes(self.items[k], np.array([0, len(self.items[k])]), size, WINDOW_HASH)
                hashes.append(h)
                item.append(np.full(len(at), k))
                place.append(at)
            hashes, item, place = map(np.concatenate, (hashes, item, place))
            order = np.argsort(hashes, kind="stable")
            self.seeds[size] = hashes[order], item[order], place[order]

    def matches(self, words: np.ndarray, first: np.ndarray, coverage: float) -> list[tuple]:
        """(document, item, tiles) of the pairs whose tiles cover enough of the item."""
        out = []
        for size, (hashes, item, place) in self.seeds.items():
            at, found = window_hashes(words, first, size, WINDOW_HASH)
            left = np.searchsorted(hashes, found)
            hit = np.flatnonzero(hashes[np.minimum(left, len(hashes) - 1)] == found)
            if not len(hit):
                continue
            at, left = at[hit], left[hit]
            n = np.searchsorted(hashes, found[hit], side="right") - left
            seed = np.repeat(left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at, n)
            doc, of, to = np.searchsorted(first, at, side="right") - 1, item[seed], place[seed]
            order = np.lexsort((at, of, doc))
            at, doc, of, to = at[order], doc[order], of[order], to[order]
            cut = np.flatnonzero((np.diff(doc, prepend=-1) != 0) | (np.diff(of, prepend=-1) != 0))
            for a, b in zip(cut, np.append(cut[1:], len(doc))):
                target = self.items[of[a]]
                need = coverage * len(target) - 1e-9
                reach = np.zeros(len(target) + size, bool)
                for k in range(size):
                    reach[to[a:b] + k] = True
                if reach[: len(target)].sum() < need:
                    continue
                base = first[doc[a]]
                used = np.unique(at[a:b, None] + np.arange(size)) - base  # only words in seeds can be in a tile
                gap = np.flatnonzero(np.diff(used) > 1) + 1
                part = np.insert(words[base + used], gap, 0)
                tiles = tile(part, target, size, np.insert(np.zeros(len(used), bool), gap, True))
                if sum(t[2] for t in tiles) >= need:
                    out.append((int(doc[a]), int(of[a]), tiles))
        return out


def slices(benchmark: DataFrame, most_words: int = SLICE_WORDS) -> tuple[int, Iterator[Benchmark]]:
    """The benchmark in parts of bounded size, and their number; the driver holds one at a time."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-total // (6 * most_words)) or 1

    def parts():
        for k in range(n):
            rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
            yield Benchmark([r.item_id for r in rows], [r.text for r in rows])

    return n, parts()


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """A row for each contaminated document and item: doc_id, item_id, n_tiles, longest, covered, item_words, coverage."""
    schema = "doc_id long, item_id long, n_tiles long, longest long, covered long, item_words long, coverage double"

    def scan(part: Benchmark) -> DataFrame:
        held = docs.sparkSession.sparkContext.broadcast(part)

        def kernel(rows, data, borders):
            bench = held.value
            found = bench.matches(*_hashed(data, borders), coverage)
            ids = rows.column(0).to_pylist()
            out = [(ids[d], bench.ids[k], len(t), max(x[2] for x in t), sum(x[2] for x in t), len(bench.items[k])) for d, k, t in found]
            return [*([r[c] for r in out] for c in range(6)), [r[4] / r[5] for r in out]]

        return map_blocks(texts_of(docs), kernel, schema)

    n, parts = slices(benchmark)
    return reduce(DataFrame.unionByName, (scan(p) if n == 1 else stored(scan(p), "matches") for p in parts))


def decontaminate(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents that no item contaminates, with all their columns; no shuffle.  With several slices each scan's documents are written before the next."""
    n, parts = slices(benchmark)
    for k, part in enumerate(parts):
        held = docs.sparkSession.sparkContext.broadcast(part)

        def clean(data, borders, held=held):
            keep = np.ones(len(borders) - 1, bool)
            for d, _, _ in held.value.matches(*_hashed(data, borders), coverage):
                keep[d] = False
            return keep

        docs = filter_blocks(docs, clean)
        if k + 1 < n:
            docs = stored(docs, "clean")
    return docs


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
