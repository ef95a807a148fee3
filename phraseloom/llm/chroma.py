"""Chroma audio fingerprints for media columns.

A recording is an array of samples.  Short overlapping windows are transformed (FFT) and their energy is folded into 12
pitch classes; the frames are normalised, so loudness doesn't matter.  Over the image of frames and pitch classes an integral image gives
any rectangle's sum in four look-ups; 16 rectangle filters, each quantised to two bits (Gray code), give one packed 32-bit code for
every filter position.

Search: recordings with equal codes are one class.  Keys are codes with one of their four pitch bands left out, so a key survives bit errors within a band.  Every key that a query class and
another class share votes for the offset at which it stands in both: the votes of a pair are its offset histogram.  At every offset with ``MIN_VOTES`` votes, and room for ``MIN_OVERLAP``
aligned codes, the bits of all aligned codes are compared; the pair links when the share of differing bits is at most ``MAX_BIT_ERROR`` at one of them.  The best offset, and the best
match, is the one whose errors stay furthest below the allowed number of bits, so a long alignment outweighs a short one.

Query keys are broadcast in slices of about ``SLICE_BYTES`` of codes; histograms are built where the classes are read, for as many classes at a time as give ``VOTES`` votes, and one row for each
query leaves a batch, so neither pairs nor keys are shuffled.  Codes in which every window of ``MIN_OVERLAP`` codes has errors in two bands of each code share no key and are missed: tests hold the recall at 0.9 or more of all pairs compared at every offset.

Queries are the rows whose id is divisible by 50, against all rows.

Defined cases: a null or too short recording has no code, and no class or link; samples that are null, NaN or infinite count
as 0; a recording of fewer codes than ``MIN_OVERLAP`` has no links; silence is a recording like any other; ties between offsets and between matches go to the smaller one; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import written as stored
from .frames import map_arrow, schema_of

MIN_VOTES = 1
#: Aligned codes and share of differing bits of a link.  Of pairs of unrelated vectors of ``embeddings``, 0.05 % are that close at one of their offsets.
MIN_OVERLAP = 13
MAX_BIT_ERROR = 0.1
QUERY_EVERY = 50
#: Bytes of query codes that are broadcast at a time, and votes that are counted at a time.
SLICE_BYTES = 4 << 20
VOTES = 1 << 20
PITCHES = 12
#: Log-ratio borders of the four levels of a filter.
LEVELS = (-0.35, 0.0, 0.35)


@dataclass(frozen=True)
class Audio:
    """Sample rate, window and hop in samples, lowest frequency, and frames under a filter."""

    rate: float = 11_025.0
    window: int = 4_096
    hop: int = 1_365
    low: float = 28.0
    span: int = 16

    def fold(self) -> np.ndarray:
        """Windows' bins to pitch classes."""
        out = np.zeros((self.window // 2 + 1, PITCHES))
        for k in range(1, len(out)):
            f = k * self.rate / self.window
            if f >= self.low:
                out[k, round(PITCHES * log2(f / self.low)) % PITCHES] = 1
        return out


#: The query's recordings are the 64-sample vectors of ``embeddings``.
SHORT = Audio(rate=64.0, window=32, hop=1, low=2.0, span=8)


def filters(span: int) -> list[list[tuple[int, int, int, int, int]]]:
    """16 filters by rule: signed rectangles (sign, first frame, frames, first pitch, pitches).

    For each of four pitch bands: against the band above, its first half against its last half in time, its middle against its edges, and a
    checkerboard.
    """
    out, band, half, quarter = [], PITCHES // 4, span // 2, span // 4
    for b in range(4):
        low, up = b * band, (b * band + band) % PITCHES
        out.append([(1, 0, span, low, band), (-1, 0, span, up, band)])
        out.append([(1, 0, half, low, band), (-1, half, half, low, band)])
        out.append([(1, quarter, half, low, band), (-1, 0, quarter, low, band), (-1, quarter + half, span - quarter - half, low, band)])
        out.append([(1, 0, half, low, band), (1, half, half, up, band), (-1, half, half, low, band), (-1, 0, half, up, band)])
    return out


def codes(samples: np.ndarray, audio: Audio) -> np.ndarray:
    """Packed codes (recordings x positions) of recordings of one length."""
    n_frames = (samples.shape[1] - audio.window) // audio.hop + 1 if samples.shape[1] >= audio.window else 0
    n = n_frames - audio.span + 1
    if n <= 0:
        return np.zeros((len(samples), 0), np.uint32)
    views = np.lib.stride_tricks.sliding_window_view(samples, audio.window, axis=1)[:, :: audio.hop]
    energy = np.abs(np.fft.rfft(views * np.hanning(audio.window), axis=2)) ** 2
    chroma = energy @ audio.fold()
    norm = np.linalg.norm(chroma, axis=2, keepdims=True)
    chroma = np.where(norm > 1e-12, chroma / np.maximum(norm, 1e-12), 0.0)
    image = np.zeros((len(samples), n_frames + 1, PITCHES + 1))
    image[:, 1:, 1:] = chroma.cumsum(axis=1).cumsum(axis=2)
    out, at = np.zeros((len(samples), n), np.uint32), np.arange(n)
    for parts in filters(audio.span):
        plus, minus = np.full((2, len(samples), n), 1e-3)
        for sign, t, width, p, height in parts:
            total = image[:, at + t + width, p + height] - image[:, at + t, p + height] - image[:, at + t + width, p] + image[:, at + t, p]
            if sign > 0:
                plus = plus + total
            else:
                minus = minus + total
        level = np.searchsorted(LEVELS, np.log(plus / minus)).astype(np.uint32)
        out = (out << np.uint32(2)) | (level ^ (level >> np.uint32(1)))
    return out


def fingerprints(media: DataFrame, id_column: str, samples: str, audio: Audio) -> DataFrame:
    """(id, codes): the codes of each recording as packed little-endian 32-bit integers; null without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                lists = part.column(1).to_pylist()
                found: list[bytes | None] = [None] * len(lists)
                for size in {len(x) for x in lists if x}:
                    rows = [i for i, x in enumerate(lists) if x and len(x) == size]
                    block = np.nan_to_num(np.array([lists[i] for i in rows], dtype=np.float64), nan=0.0, posinf=0.0, neginf=0.0)
                    for i, c in zip(rows, codes(block, audio)):
                        found[i] = c.astype("<u4").tobytes() or None
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.binary())], ["id", "codes"])

    return map_arrow(media.select(F.col(id_column).cast("long").alias("id"), F.col(samples).cast("array<double>").alias("samples")), run, "id long, codes binary")


def keys(codes: np.ndarray) -> np.ndarray:
    """Four keys of each code (a row each): the code without one of its pitch bands, and which one."""
    c, band = codes.astype(np.uint64)[:, None], np.arange(4, dtype=np.uint64)
    return (c & ~(np.uint64(0xFF) << (np.uint64(8) * band))) | (band << np.uint64(32))


class Flat:
    """Codes of many classes one after another."""

    def __init__(self, nodes: np.ndarray, raw: list[bytes]):
        self.nodes, self.codes = nodes, np.frombuffer(b"".join(raw), "<u4")
        self.size = np.array([len(x) // 4 for x in raw], np.int64)
        self.first = np.cumsum(self.size) - self.size
        self.of = np.repeat(np.arange(len(raw)), self.size)
        self.at = np.arange(len(self.codes)) - self.first[self.of]


class Index:
    """The keys of the query classes in order."""

    def __init__(self, asked: list[tuple[int, bytes]]):
        self.flat = Flat(np.array([q for q, _ in asked], np.int64), [c for _, c in asked])
        found = keys(self.flat.codes).ravel()
        order = np.argsort(found, kind="stable")
        self.keys, self.place = found[order], order // 4

    def runs(self, nodes: np.ndarray, raw: list[bytes]) -> Iterator[tuple[np.ndarray, list[bytes]]]:
        """The classes of a batch in runs of about ``VOTES`` votes, a class at least: what a histogram holds at once grows neither with the batch nor with the queries' number times it."""
        flat = Flat(nodes, raw)
        votes = np.zeros(len(raw), np.int64)
        for lo in range(0, len(flat.codes), VOTES // 4):
            of = slice(lo, lo + VOTES // 4)
            own = keys(flat.codes[of])
            met = np.searchsorted(self.keys, own, "right") - np.searchsorted(self.keys, own, "left")
            votes += np.bincount(flat.of[of], met.sum(axis=1), len(raw)).astype(np.int64)
        total, lo = np.cumsum(votes), 0
        while lo < len(raw):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + VOTES, "right")))
            yield nodes[lo:hi], raw[lo:hi]
            lo = hi

    def histogram(self, other: Flat) -> tuple[np.ndarray, ...]:
        """(query, class, offset, votes) of the offsets with ``MIN_VOTES`` votes and room for ``MIN_OVERLAP`` codes; a class's code at place k aligns with the query's at k less the offset."""
        own = keys(other.codes).ravel()
        low, high = np.searchsorted(self.keys, own, "left"), np.searchsorted(self.keys, own, "right")
        near = np.cumsum(high - low)
        span, q = int(other.size.max(initial=0) + self.flat.size.max(initial=0)) + 1, len(self.flat.nodes)
        votes, done, code, n = [], 0, np.zeros(0, np.int64), np.zeros(0, np.int64)
        while done < len(own):  # about ``VOTES`` votes at a time, added to what is counted
            stop = max(done + 1, int(np.searchsorted(near, (near[done - 1] if done else 0) + VOTES, "right")))
            count = (high - low)[done:stop]
            key = np.repeat(np.arange(done, stop), count)
            place = self.place[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + low[key]]
            shift = other.at[key // 4] - self.flat.at[place]
            c, a = other.of[key // 4], self.flat.of[place]
            room = np.minimum(self.flat.size[a], other.size[c] - shift) - np.maximum(0, -shift)
            ok = room >= MIN_OVERLAP
            votes.append(np.unique(((c * q + a) * span + shift + self.flat.size.max(initial=0))[ok], return_counts=True))
            done = stop
            if len(votes) > 16 or done == len(own):
                code, place = np.unique(np.concatenate([code, *(v for v, _ in votes)]), return_inverse=True)
                n = np.bincount(place, np.concatenate([n, *(m for _, m in votes)]), len(code)).astype(np.int64)
                votes = []
        code, n = code[n >= MIN_VOTES], n[n >= MIN_VOTES]
        pair, shift = np.divmod(code, span)
        c, a = np.divmod(pair, max(q, 1))
        return a, c, shift - self.flat.size.max(initial=0), n


def bit_errors(left: Flat, a: np.ndarray, right: Flat, b: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Differing bits and aligned codes of the pairs (a, b) at their offsets."""
    lo, hi = np.maximum(0, -shift), np.minimum(left.size[a], right.size[b] - shift)
    n = hi - lo
    row = np.repeat(np.arange(len(a)), n)
    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + lo[row]
    wrong = np.bitwise_count(left.codes[left.first[a[row]] + k] ^ right.codes[right.first[b[row]] + k + shift[row]])
    return np.bincount(row, wrong, len(a)).astype(np.int64), n


_LINKED = "q long, n_links long, margin double, m long, shift int, votes long, bit_error double"


def _best(index: Index, other: Flat) -> list[np.ndarray]:
    """A row for each query that aligns with any of the other classes: the query's place, how many align, and margin, class, shift, votes and share of differing bits of the best one."""
    a, b, shift, votes = index.histogram(other)
    found = [[np.zeros(0, t) for t in (np.int64, np.int64, np.float64, np.int64, np.int64, np.float64)]]
    for lo in range(0, len(a), VOTES // 16):
        of = slice(lo, lo + VOTES // 16)
        wrong, n = bit_errors(index.flat, a[of], other, b[of], shift[of])
        near = (wrong <= MAX_BIT_ERROR * 32 * n + 1e-9) & (index.flat.nodes[a[of]] != other.nodes[b[of]])
        found.append([x[near] for x in (a[of], other.nodes[b[of]], np.round(MAX_BIT_ERROR * 32 * n - wrong, 6), shift[of], votes[of], wrong / (32 * n))])
    a, m, margin, shift, votes, error = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((shift, -margin, m, a))  # the best offset of each pair
    order = order[_firsts(a[order], m[order])]
    return _merged([x[order] for x in (a, np.ones(len(a), np.int64), margin, m, shift, votes, error)])


def _merged(*parts: list[np.ndarray]) -> list[np.ndarray]:
    """One row for each query of such rows: their classes added up, and the best of them."""
    a, n, margin, m, *rest = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((m, -margin, a))
    first = _firsts(a[order])
    one = order[first]
    return [a[one], np.add.reduceat(n[order], first) if len(first) else n, margin[one], m[one], *(x[one] for x in rest)]


def _firsts(*sorted_by: np.ndarray) -> np.ndarray:
    """Places of rows that differ from the one before."""
    new = np.ones(len(sorted_by[0]), bool)
    if len(new):
        new[1:] = np.any([x[1:] != x[:-1] for x in sorted_by], axis=0)
    return np.flatnonzero(new)


def _links(classes: DataFrame, asked: list[tuple[int, bytes]]) -> DataFrame:
    """For the query classes ``asked`` (node, codes): how many of a batch's other classes align with each, and the best of them."""
    sent = classes.sparkSession.sparkContext.broadcast(asked)
    target = schema_of(classes.sparkSession, _LINKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(sent.value)
        for batch in batches:
            held = None
            for nodes, raw in index.runs(batch.column(0).to_numpy(), batch.column(1).to_pylist()):
                part = _best(index, Flat(nodes, raw))
                held = part if held is None else _merged(held, part)
            if held is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip((index.flat.nodes[held[0]], *held[1:]), target)], schema=target)

    return map_arrow(classes.select("node", "codes"), run, _LINKED)


def _slices(rows: Iterator, limit: int) -> Iterator[list[tuple[int, bytes]]]:
    """The rows (node, codes) in lists of about ``limit`` bytes."""
    held, size = [], 0
    for r in rows:
        held.append((r.node, bytes(r.codes)))
        size += len(held[-1][1])
        if size >= limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def align(media: DataFrame, id_column: str, samples: str, audio: Audio = Audio(), every: int = QUERY_EVERY) -> DataFrame:
    """A row for each recording: id, class_id (least id with equal codes), n_codes, is_query, and for rows of classes that hold a query:
    n_links (other classes aligned with it), best_match (class_id), shift, votes (shared keys) and bit_error of the best one."""
    marked = stored(fingerprints(media, id_column, samples, audio), "codes")
    query = F.coalesce(F.col("id") % every == 0, F.lit(False))
    classes = stored(marked.where("codes is not null and id is not null").groupBy("codes").agg(F.min("id").alias("node"), F.max(query).alias("asked")), "classes")
    found = None
    for asked in _slices(classes.where("asked").select("node", "codes").toLocalIterator(), SLICE_BYTES):
        part = stored(_links(classes, asked).groupBy("q").agg(F.sum("n_links").alias("n_links"), F.max(F.struct("margin", (-F.col("m")).alias("back"), (-F.col("shift")).alias("early"), "votes", "bit_error")).alias("best")), "links")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = classes.sparkSession.createDataFrame([], "q long, n_links long, best struct<margin:double,back:long,early:int,votes:long,bit_error:double>")
    found = found.select("q", "n_links", F.struct((-F.col("best.back")).alias("m"), (-F.col("best.early")).alias("shift"), "best.votes", "best.bit_error").alias("x"))
    known = classes.join(found, classes.node == found.q, "left").select(F.col("codes").alias("c"), F.col("node").alias("class_id"), F.when(F.col("asked"), F.coalesce("n_links", F.lit(0))).alias("n_links"), F.col("x.m").alias("best_match"), "x.shift", "x.votes", "x.bit_error")
    n_codes = F.coalesce(F.length("codes") / 4, F.lit(0)).cast("long")
    return marked.join(known, marked.codes == known.c, "left").select("id", "class_id", n_codes.alias("n_codes"), query.alias("is_query"), "n_links", "best_match", "shift", "votes", "bit_error")


def op9_chroma_fingerprints(spark, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", SHORT).withColumnRenamed("id", "vec_id")
