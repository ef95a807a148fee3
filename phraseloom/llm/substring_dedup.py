"""Substring dedup over a log-structured index of window fingerprints.

A window is ``WINDOW`` consecutive words of one document.  A word goes when a window that covers it has the same words as a
window that starts anywhere else, in the same document or another.

Passes over the texts (nothing but fingerprints is ever shuffled, and documents stay in the partition that reads them):

1. Each task hashes its windows, piece by piece (``PIECE`` windows), sorts and de-duplicates them, and sends every bucket
   (a range of the hash space) one packed sorted array; differences of sorted hashes take about five bytes a window.
   Copies inside a piece are counted before the shuffle, so a passage that a third of the corpus shares sends one hash
   per piece.  The task of a bucket merge-joins each batch of arrays with the sorted immutable runs so far, appends
   the batch as a new run, and compacts the runs when there are ``FANOUT`` of them.  The answer is one bit per hash.
2. Windows whose hash was met again are verified: the same exchange with an independent hash, for those windows only.
3. Windows that both exchanges confirm cover the words to remove.

With ``index_uri`` the compacted runs are kept: a later batch is merge-joined with the windows of all earlier ones, and
new runs are published by writing whole files and then the manifest, so a lost executor or a failed run leaves the old index.

The answers lie in the shared folder, one file per input partition, and the later passes read the file of their partition.
That needs an input whose partitions are the same in each pass: a frame that isn't a plain file scan is written
to the shared folder first, and every pass checks the number of hashes of each piece against the stored answer.

Defined cases: null, empty and blank texts have no words (the digest of the empty string); texts shorter than a window keep all
their words; repeated rows and rows without doc_id are documents of their own, so they remove each other's windows; an empty table gives no rows.
Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import written as stored
from .frames import filesystem, map_arrow, read_bytes, shared_folder, texts_of, write_bytes
from .textkernel import SPACE, WINDOW_HASH, WINDOW_HASH_2, WORD_HASH, WORD_HASH_2, blocks, window_hashes, word_spans

WINDOW = 35
PIECE = 1 << 20
FANOUT = 4
BATCH = 8


def pack(values: np.ndarray) -> bytes:
    """A sorted array of 64-bit values: byte planes of the differences, compressed."""
    gaps = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(packed: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


class Runs:
    """The sorted immutable runs of one bucket: (hashes, whether met again)."""

    def __init__(self, runs: list[tuple[np.ndarray, np.ndarray]] | None = None):
        self.runs = runs or []

    def append(self, hashes: np.ndarray, again: np.ndarray) -> None:
        """Adds a sorted batch; a hash that an earlier run holds is met again."""
        again = again.copy()
        for run, _ in self.runs:
            again |= _among(run, hashes)
        self.runs.append((hashes, again))
        if len(self.runs) >= FANOUT:
            self.compact()

    def compact(self) -> None:
        """Merges all runs into one."""
        if len(self.runs) > 1:
            self.runs = [merged(np.concatenate([r for r, _ in self.runs]), np.concatenate([a for _, a in self.runs]))]

    def ask(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash was met more than once; the runs are compacted first."""
        self.compact()
        run, again = self.runs[0]
        return again[np.searchsorted(run, hashes)]


def _among(run: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    if not len(run):
        return np.zeros(len(hashes), bool)
    return run[np.minimum(np.searchsorted(run, hashes), len(run) - 1)] == hashes


def merged(hashes: np.ndarray, again: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes; one that came twice, or was met again before, is met again."""
    order = np.argsort(hashes, kind="stable")
    hashes, again = hashes[order], again[order]
    first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(hashes)))
    return hashes[first], (np.logical_or.reduceat(again, first) if len(first) else again) | (n > 1)


class Piece:
    """Consecutive documents of a partition, up to about ``PIECE`` windows."""

    def __init__(self):
        self.ids, self.texts, self.first, self.at, self.h1, self.h2 = [], [], [np.zeros(1, np.int64)], [], [], []
        self.n_words = self.n_windows = 0

    def add(self, ids, data, borders, second: bool, texts: bool) -> None:
        starts, ends, first = word_spans(data, borders, ~SPACE)
        words = WORD_HASH.words(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        at, h1 = window_hashes(words, first, WINDOW, WINDOW_HASH)
        if second:
            words = WORD_HASH_2.words(data, starts, ends) if len(starts) else words
            self.h2.append(window_hashes(words, first, WINDOW, WINDOW_HASH_2)[1])
        self.ids.append(ids)
        if texts:
            self.texts.append((data.tobytes(), borders))
        self.first.append(first[1:] + self.n_words)
        self.at.append(at + self.n_words)
        self.h1.append(h1)
        self.n_words += int(first[-1])
        self.n_windows += len(at)


def pieces(batches: Iterator[pa.RecordBatch], second: bool = False, texts: bool = False) -> Iterator[Piece]:
    piece = Piece()
    for batch in batches:
        ids = batch.column(0)
        for lo, hi, data, borders in blocks(batch.column(1)):
            piece.add(ids.slice(lo, hi - lo), data, borders, second, texts)
            if piece.n_windows >= PIECE or piece.n_words >= 4 * PIECE:
                yield piece
                piece = Piece()
    if piece.ids:
        yield piece


_SENT = "part int, piece int, bucket int, n int, hashes binary, again binary"


def _send(hashes: np.ndarray, number: int, buckets: int) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """The packed rows of a piece, with its distinct hashes and the place of each window among them."""
    distinct, place, n = np.unique(hashes, return_inverse=True, return_counts=True)
    cut = np.searchsorted(distinct, np.array([-(-(b << 64) // buckets) for b in range(1, buckets)], dtype=np.uint64)) if buckets > 1 else np.zeros(0, np.int64)
    cut = np.concatenate([[0], cut, [len(distinct)]])
    rows = [(b, cut[b], cut[b + 1]) for b in range(buckets) if cut[b] < cut[b + 1]]
    part = TaskContext.get().partitionId()
    columns = [[part] * len(rows), [number] * len(rows), [b for b, _, _ in rows], [int(j - i) for _, i, j in rows], [pack(distinct[i:j]) for _, i, j in rows], [np.packbits(n[i:j] > 1).tobytes() for _, i, j in rows]]
    types = [pa.int32()] * 4 + [pa.binary()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [c.split()[0] for c in _SENT.split(", ")]), distinct, place


def _read_run(uri: str) -> tuple[np.ndarray, np.ndarray]:
    raw = read_bytes(uri)
    n = int.from_bytes(raw[:8], "little")
    hashes = unpack(raw[8 : 8 + n])
    return hashes, np.unpackbits(np.frombuffer(raw[8 + n :], np.uint8), count=len(hashes)).astype(bool)


def _write_run(uri: str, hashes: np.ndarray, again: np.ndarray) -> None:
    packed = pack(hashes)
    write_bytes(uri, len(packed).to_bytes(8, "little") + packed + np.packbits(again).tobytes())


def exchange(sent: DataFrame, buckets: int, answers: str, held: dict[str, str] | None = None, publish: str | None = None) -> None:
    """Finds the hashes that were met more than once and stores the answers, one file for each input partition.

    held: for each bucket the run file of earlier batches; publish: folder for the compacted runs of this one.
    """

    def answer(bucket: int, rows: list[tuple]) -> pa.RecordBatch:
        runs = Runs([_read_run(held[str(bucket)])] if held and str(bucket) in held else None)
        arrays = [unpack(r[4]) for r in rows]
        for i in range(0, len(rows), BATCH):
            again = [np.unpackbits(np.frombuffer(r[5], np.uint8), count=r[3]).astype(bool) for r in rows[i : i + BATCH]]
            runs.append(*merged(np.concatenate(arrays[i : i + BATCH]), np.concatenate(again)))
        bits = [np.packbits(runs.ask(a)).tobytes() for a in arrays]
        if publish:
            _write_run(f"{publish}/{bucket:06d}", *runs.runs[0])
        columns = [[r[0] for r in rows], [r[1] for r in rows], [bucket] * len(rows), [r[3] for r in rows], bits]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 4 + [pa.binary()])], ["part", "piece", "bucket", "n", "bits"])

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[2] != bucket:
                    if rows:
                        yield answer(bucket, rows)
                    bucket, rows = row[2], []
                rows.append(row)
        if rows:
            yield answer(bucket, rows)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []

        def store():
            write_bytes(f"{answers}/{part:07d}", _ipc(rows))

        n = 0
        for batch in batches:
            parts = batch.column(0).to_numpy()
            cuts = np.flatnonzero(np.diff(parts)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(parts)]):
                if b <= a:
                    continue
                if part is not None and parts[a] != part:
                    store()
                    rows, n = [], n + 1
                part = int(parts[a])
                rows.append(batch.slice(a, b - a))
        if rows:
            store()
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    dealt = sent.repartitionById(buckets, "bucket") if hasattr(sent, "repartitionById") else sent.repartition(buckets, "bucket")
    bits = map_arrow(dealt.sortWithinPartitions("bucket", "part", "piece"), reduce, "part int, piece int, bucket int, n int, bits binary")
    map_arrow(bits.repartition("part").sortWithinPartitions("part", "piece", "bucket"), keep, "n long").agg(F.sum("n")).collect()


def _ipc(rows: list[pa.RecordBatch]) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows[0].schema) as out:
        for r in rows:
            out.write_batch(r)
    return sink.getvalue().to_pybytes()


class Answers:
    """The stored answers of this task's partition."""

    def __init__(self, uri: str):
        path = f"{uri}/{TaskContext.get().partitionId():07d}"
        fs, name = filesystem(path)
        self.bits: dict[int, list] = {}
        if fs.get_file_info(name).is_file:
            table = pa.ipc.open_stream(pa.BufferReader(read_bytes(path))).read_all()
            for piece, n, bits in zip(*(table.column(c).to_pylist() for c in ("piece", "n", "bits"))):
                self.bits.setdefault(piece, []).append(np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool))

    def flags(self, number: int, n: int) -> np.ndarray:
        found = np.concatenate(self.bits.get(number, [np.zeros(0, bool)]))
        if len(found) != n:
            raise RuntimeError("the input's partitions changed between two passes")
        return found


def _stable(docs: DataFrame) -> DataFrame:
    """The frame if it is a plain file scan, else a written copy."""
    plan = docs._jdf.queryExecution().executedPlan().toString()
    if "Scan parquet" in plan and not any(x in plan for x in ("Exchange", "Python", "Arrow", "Pandas", "InMemory", "AdaptiveSparkPlan")):
        return docs
    return stored(docs, "texts")


def remove_repeats(docs: DataFrame, index_uri: str | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row; see the module's text.  ``index_uri``: an index of earlier batches, extended by this one."""
    spark = docs.sparkSession
    docs = _stable(texts_of(docs))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    first, second = shared_folder(spark, "repeats"), shared_folder(spark, "verified")
    index = _manifest(index_uri, buckets) if index_uri else None
    buckets = index["buckets"] if index else buckets

    def windows(batches):
        for number, piece in enumerate(pieces(batches)):
            yield _send(np.concatenate(piece.h1), number, buckets)[0]

    def candidates(batches):
        answers = Answers(first)
        for number, piece in enumerate(pieces(batches, second=True)):
            distinct, place = np.unique(np.concatenate(piece.h1), return_inverse=True)
            chosen = answers.flags(number, len(distinct))[place] if not index else slice(None)  # an index keeps every window
            yield _send(np.concatenate(piece.h2)[chosen], number, buckets)[0]

    def removal(batches):
        once, twice = Answers(first), Answers(second)
        for number, piece in enumerate(pieces(batches, second=True, texts=True)):
            distinct, place = np.unique(np.concatenate(piece.h1), return_inverse=True)
            hit = once.flags(number, len(distinct))[place]
            chosen = hit if not index else np.ones(len(hit), bool)
            distinct, place = np.unique(np.concatenate(piece.h2)[chosen], return_inverse=True)
            hit[chosen] &= twice.flags(number, len(distinct))[place]
            at = np.concatenate(piece.at)[hit]
            edge = np.zeros(piece.n_words + 1, np.int64)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + WINDOW, -1)
            gone = np.cumsum(edge[:-1]) > 0
            yield _kept(piece, np.concatenate(piece.first), gone)

    for kernel, answers, own in ((windows, first, "first"), (candidates, second, "second")):
        publish = f"{index_uri.rstrip('/')}/{own}-{answers.rpartition('-')[2]}" if index else None
        exchange(map_arrow(docs, kernel, _SENT), buckets, answers, index and index[own], publish)
        if index:
            index[own] |= _run_files(publish)
    if index:
        write_bytes(f"{index_uri.rstrip('/')}/manifest.json", json.dumps(index).encode())
    return map_arrow(docs, removal, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _kept(piece: Piece, first: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    n_words, digests, d = np.diff(first), [], 0
    removed = np.concatenate([[0], np.cumsum(gone)])
    removed = removed[first[1:]] - removed[first[:-1]]
    for raw, borders in piece.texts:
        for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()):
            words = raw[a:b].split()
            if removed[d]:
                words = compress(words, (~gone[first[d] : first[d + 1]]).tolist())
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            d += 1
    ids = pa.concat_arrays(piece.ids)
    return pa.RecordBatch.from_arrays([ids, pa.array(n_words), pa.array(removed), pa.array(digests)], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def _manifest(uri: str, buckets: int) -> dict:
    """Number of buckets, and for both hashes the run file of each bucket."""
    path = f"{uri.rstrip('/')}/manifest.json"
    fs, name = filesystem(path)
    return json.loads(read_bytes(path)) if fs.get_file_info(name).is_file else {"buckets": buckets, "first": {}, "second": {}}


def _run_files(uri: str) -> dict[str, str]:
    fs, name = filesystem(uri)
    found = fs.get_file_info(pafs.FileSelector(name, allow_not_found=True))
    return {str(int(f.base_name)): f"{uri}/{f.base_name}" for f in found if f.is_file and f.base_name.isdigit()}


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
