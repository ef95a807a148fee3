"""SimHash near-duplicates by a generalised pigeonhole search.

Fingerprints: bit i is set when it is set in over half the XXH64 hashes of a text's word shingles (repeats count).
Texts of one fingerprint collapse to one node before any search, so groups of copies cost nothing further.

Search for nodes at most ``max_bits`` apart (exact): the 64 bits are grouped into partitions, correlated bits together;
each partition p gets its own threshold t_p with sum(t_p + 1) = max_bits + 1, so that two near fingerprints are within t_p in at
least one of them (a partition with t_p = -1 is not probed).  The number of partitions and the thresholds come from a dynamic
program over estimated costs: signatures per node, and candidate pairs, estimated on ``SAMPLE`` nodes chosen by hash. The estimate
steers cost only, never the result.  A node puts out, for each partition, its bits with any up to t_p of its set bits
cleared: two nodes within t_p share such a signature.  Nodes of one signature are compared by exclusive-or in numpy, and only
the edges of a spanning forest leave the task, never all pairs of a group.  A signature with more than ``HOT``
nodes is dealt out over pairs of blocks, so no task ever holds a whole hot group, and no pair is lost.  Signatures and dealt rows beyond ``ROUND_ROWS`` a node go through the
shuffle in rounds, by hashes of their keys, and a round's shuffle files are removed before the next one.

Defined cases: null, empty and blank texts have fingerprint zero and link like any other; a row without doc_id takes the component of the rows with its fingerprint, null where none of them has an id, and links nothing; a text with fewer words than a shingle is
one shingle.  Repeated rows share a component; an empty table gives no rows.  Extra columns are ignored.

Nodes may have a second half ``fp2`` of their fingerprint: then the first half is probed, and a pair found is verified on all 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from functools import reduce
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import released
from ..sources.store import written as stored
from .components import components
from .frames import map_arrow, map_blocks, texts_of
from .textkernel import LOWER, mix64

SAMPLE = 1_500
#: Fewest bits of a partition: fewer would make every bucket hold a fixed share of all nodes.
MIN_WIDTH = 9
HOT = 4_096
#: Rows a node, of some 36 bytes, that a round shuffles on average.
ROUND_ROWS = 48
#: Bits of 128 in which a crowded key's nearest nodes differ; their links come first.
CLOSE = 8
#: Added to the bits of a pair that stands for others, which were left out: once to those of a spanning forest, twice to others.
PARTIAL = 1_000
#: Relative costs of a signature that is shuffled and sorted, and of a candidate pair that is compared.
SIGNATURE_COST, CANDIDATE_COST = 4.0, 0.008
_LOWER = bytes(LOWER)
#: The bits of a byte, first the highest, as counters in the bytes of a word.
SPREAD = np.array([sum(((b >> (7 - lane)) & 1) << (8 * lane) for lane in range(8)) for b in range(256)], dtype=np.uint64)


def fingerprint(text: bytes, size: int) -> bytes:
    """The 8 bytes of a text's fingerprint, highest bits first."""
    words = text.translate(_LOWER).split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n = max(1, len(words) - size + 1)
    last = ends[min(size, len(words)) - 1 :]
    digests = b"".join([xxhash.xxh64_digest(joined[a:b], 42) for a, b in zip(starts[:n].tolist(), last[:n].tolist())])
    lanes = np.add.reduceat(SPREAD[np.frombuffer(digests, np.uint8).reshape(-1, 8)], np.arange(0, n, 255), axis=0)
    counts = lanes.view(np.uint8).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > n).tobytes()


def fingerprints(docs: DataFrame, shingle_words: int = 4) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed 64-bit integer."""

    def kernel(rows, data, borders):
        raw = data.tobytes()
        found = b"".join(fingerprint(raw[a:b], shingle_words) for a, b in zip(borders[:-1].tolist(), borders[1:].tolist()))
        return [rows.column(0), np.frombuffer(found, ">i8").astype(np.int64)]

    return map_blocks(texts_of(docs), kernel, "doc_id long, fp long")


def bit_statistics(nodes: DataFrame) -> np.ndarray:
    """64 x 64 numbers of nodes that have both bits set, over all nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = np.zeros((64, 64))
        for batch in batches:
            bits = _bits(batch.column(0).to_numpy().view(np.uint64)).astype(np.float32)
            for i in range(0, len(bits), 50_000):
                both += bits[i : i + 50_000].T @ bits[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(4096)), pa.array(both.ravel().astype(np.int64))], ["at", "n"])

    out = np.zeros(4096)
    for r in map_arrow(nodes.select("fp"), run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[r["at"]] = r["n"]
    return out.reshape(64, 64)


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit i of each value in column i, bit 0 the lowest."""
    return np.unpackbits(values.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def partitions(both: np.ndarray, n: int, m: int) -> list[list[int]]:
    """The 64 bits in m groups of like size; a group grows by the bit most correlated with its members."""
    share = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-9))
    tie = np.abs((both / max(n, 1) - np.outer(share, share)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, groups = set(range(64)), []
    for k in range(m):
        size = 64 // m + (k < 64 % m)
        left = sorted(free)
        own = [max(left, key=lambda i: (tie[i, left].sum(), -i))]
        while len(own) < size:
            rest = sorted(free - set(own))
            own.append(max(rest, key=lambda i: (tie[i, own].sum(), -i)))
        free -= set(own)
        groups.append(sorted(own))
    return groups


def plan(both: np.ndarray, n: int, sample: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """(mask, threshold) of the partitions, by the dynamic program over estimated costs."""
    best = None
    for m in range(max(1, max_bits // 3), min(max_bits + 1, 64 // MIN_WIDTH) + 1):
        rows, masks = {0: (0.0, [])}, [sum(1 << b for b in g) for g in partitions(both, n, m)]
        for mask in masks:
            own = sample & np.uint64(mask)
            ones = float(np.bitwise_count(own).mean()) if len(own) else 0.0
            clear = np.bitwise_count(own[:, None] & ~own[None, :])
            apart = np.maximum(clear, clear.T)[np.triu_indices(len(own), 1)]
            near = np.bincount(apart, minlength=65)[:65].cumsum() / max(len(apart), 1)
            after = {}
            for t in range(-1, min(max_bits, 3) + 1):
                signatures = sum(comb(round(ones), k) for k in range(t + 1))
                cost = 0.0 if t < 0 else SIGNATURE_COST * n * signatures + CANDIDATE_COST * n * n / 2 * max(near[t], 2.0 ** -mask.bit_count())
                for s, (c, chosen) in rows.items():
                    total = min(s + t + 1, max_bits + 1)
                    if total not in after or c + cost < after[total][0]:
                        after[total] = (c + cost, [*chosen, (mask, t)])
            rows = after
        if max_bits + 1 in rows and (best is None or rows[max_bits + 1][0] < best[0]):
            best = rows[max_bits + 1]
    return [(mask, t) for mask, t in best[1] if t >= 0]


def _key(values: np.ndarray, p: int) -> np.ndarray:
    """The key of signatures of partition p; it tells partitions and signatures apart."""
    return mix64(values + np.uint64(0x9E3779B97F4A7C15 * (p + 1) % (1 << 64)))


def signatures(nodes: DataFrame, planned: list[tuple[int, int]], at: int = 0, rounds: int = 1) -> DataFrame:
    """(key, fp, fp2, node) for every partition and every way to clear up to its threshold of set bits; of ``rounds`` equal parts of the keys, that numbered ``at``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, *rest = (c.to_numpy() for c in batch.columns)
            for lo in range(0, len(whole), 20_000):
                values = whole[lo : lo + 20_000].view(np.uint64)
                keys, of = [], []
                for p, (mask, t) in enumerate(planned):
                    bits = [1 << b for b in range(64) if mask >> b & 1]
                    for k in range(t + 1):
                        for drop in map(sum, combinations(bits, k)):
                            own = np.flatnonzero(values & np.uint64(drop) == np.uint64(drop))
                            key = _key(values[own] & np.uint64(mask & ~drop), p)
                            if rounds > 1:
                                now = key % np.uint64(rounds) == np.uint64(at)
                                key, own = key[now], own[now]
                            keys.append(key)
                            of.append(own + lo)
                of = np.concatenate(of)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *(pa.array(x[of]) for x in (whole, *rest))], ["key", "fp", "fp2", "node"])

    return map_arrow(nodes.select("fp", "fp2", "node"), run, "key long, fp long, fp2 long, node long")


def _forest(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> list[tuple[int, int, int]]:
    """Edges (a, b) and their bits apart enough to connect what the edges connect, the nearest first."""
    up: dict[int, int] = {}

    def top(x):
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    kept = []
    order = np.argsort(apart, kind="stable")
    for x, y, d in zip(*(z[order].tolist() for z in (a, b, apart))):
        p, q = top(x), top(y)
        if p != q:
            up[p] = q
            kept.append((x, y, d))
    return kept


def _edges(u: np.ndarray, v: np.ndarray, d: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(d.astype(np.int32))], ["u", "v", "d"])


class _Linker:
    """Edges between the nodes of equal keys; the rows come sorted by key, and by block: a hot key's pair of blocks, doubled, and 1 more for the nodes of the second block.

    With the ``planned`` partitions a pair counts only at the first signature that its nodes share, so the many others don't repeat it.
    """

    def __init__(self, max_bits: int, max_all: int, planned: list[tuple[int, int]] | tuple = (), small: int = 24, dense: int = 6):
        self.max_bits, self.max_all, self.planned, self.small, self.dense = max_bits, max_all, planned, small, dense

    def first(self, key, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs of a and b, which share the signature ``key``, share no earlier one."""
        if not self.planned:
            return np.ones(len(a), bool)
        out, rest, key = np.zeros(len(a), bool), np.arange(len(a)), np.broadcast_to(key, len(a))
        for p, (mask, t) in enumerate(self.planned):
            x, y = a[rest] & np.uint64(mask), b[rest] & np.uint64(mask)
            both = x & y
            ok = np.maximum(np.bitwise_count(x ^ both), np.bitwise_count(y ^ both)) <= t
            out[rest[ok]] = _key(both[ok], p).view(np.int64) == key[rest[ok]]
            rest = rest[~ok]
            if not len(rest):
                break
        return out

    def near(self, fp, fp2, other, other2, most: int = 128) -> np.ndarray:
        apart, most = np.bitwise_count(fp ^ other), min(most, self.max_all)
        ok = apart <= min(self.max_bits, most)
        if most < 128 and ok.any():
            ok &= apart + np.bitwise_count(fp2 ^ other2) <= most
        return ok

    def breadth_first(self, key, cut, fp, fp2, most: int = 128) -> tuple[np.ndarray, np.ndarray]:
        """A spanning forest of one crowded key: each node is reached once, by a link of at most ``most`` bits; where ``cut`` nodes are of a first block, by one to the other block."""
        rest, todo, a, b = np.arange(len(fp)), [], [], []
        while len(rest):
            if not todo:
                todo, rest = [rest[0]], rest[1:]
            x = todo.pop()
            ok = self.near(fp[rest], fp2[rest], fp[x], fp2[x], most)
            if cut:
                ok &= (rest < cut) != (x < cut)
            at = np.flatnonzero(ok)
            at = at[self.first(key, fp[rest[at]], np.broadcast_to(fp[x], len(at)))]
            if len(at):
                a.append(np.full(len(at), x))
                b.append(rest[at])
                todo.extend(rest[at].tolist())
                rest = np.delete(rest, at)
        none = np.zeros(0, np.int64)
        return (np.concatenate(a), np.concatenate(b)) if a else (none, none)

    def square(self, key, cut, fp, fp2) -> tuple[np.ndarray, np.ndarray, bool]:
        """All near pairs of one key (where ``cut`` nodes are of a first block, those between it and the other) by blocks of rows, and False; a spanning forest instead, and True,
        when they are many."""
        a, b, n = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        for i in range(0, cut or len(fp), 256):
            j, end = cut or i, min(i + 256, cut or len(fp))
            x, y = np.nonzero(self.near(fp[i:end, None], fp2[i:end, None], fp[None, j:], fp2[None, j:]))
            x, y = x + i, y + j
            x, y = x[y > x], y[y > x]
            own = self.first(key, fp[x], fp[y])
            a.append(x[own])
            b.append(y[own])
            n += len(a[-1])
            if n > self.dense * len(fp):
                both = [self.breadth_first(key, cut, fp, fp2, most) for most in ([CLOSE, 128] if self.max_all < 128 else [128])]
                return *map(np.concatenate, zip(*both)), True
        return np.concatenate(a), np.concatenate(b), False

    def edges_of(self, keys, fp, fp2, node, block=None) -> pa.RecordBatch:
        block = np.zeros(len(keys), np.int64) if block is None else block
        begin = self.starts(keys, block)
        length = np.diff(np.append(begin, len(keys)))
        a, b, crowded = [], [], [np.zeros(0, np.int64)]
        for i, n in zip(begin[length > self.small].tolist(), length[length > self.small].tolist()):
            cut = n - int((block[i : i + n] & 1).sum())
            x, y, many = self.square(keys[i], cut if cut < n else 0, fp[i : i + n], fp2[i : i + n])
            a.append(x + i)
            b.append(y + i)
            if many:
                crowded.append(node[np.concatenate([x, y]) + i])
        of_small = np.flatnonzero(np.repeat(length <= self.small, length))
        group = np.repeat(np.arange(len(begin)), length)[of_small]
        side = block & 1
        paired = (np.minimum.reduceat(side, begin) < np.maximum.reduceat(side, begin))[group] if len(begin) else side.astype(bool)
        at = np.arange(len(of_small))
        for d in range(1, self.small):
            at = at[: np.searchsorted(at, len(of_small) - d)]
            at = at[group[at] == group[at + d]]
            if not len(at):
                break
            x, y = of_small[at], of_small[at + d]
            ok = self.near(fp[x], fp2[x], fp[y], fp2[y]) & (~paired[at] | (side[x] != side[y]))
            x, y = x[ok], y[ok]
            own = self.first(keys[x], fp[x], fp[y])
            a.append(x[own])
            b.append(y[own])
        kept = []
        if a:
            a, b = np.concatenate(a), np.concatenate(b)
            apart = np.bitwise_count(fp[a] ^ fp[b]).astype(np.int32) + np.bitwise_count(fp2[a] ^ fp2[b])
            if self.max_all < 128:
                return self.candidates(node[a], node[b], apart, np.unique(np.concatenate(crowded)))
            kept = _forest(node[a], node[b], apart)
        return _edges(*(np.array([e[k] for e in kept], np.int64) for k in range(3)))

    def candidates(self, a, b, apart, crowded) -> pa.RecordBatch:
        """The distinct pairs.  Of the pairs between two crowded nodes only the nearest to either end and a spanning forest, marked by ``PARTIAL``; a crowded node gets an edge to itself."""
        u, v, d = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), apart], axis=1), axis=0).T
        if len(u):
            end, of = np.concatenate([u, v]), np.tile(np.arange(len(u)), 2)
            order = np.lexsort((d[of], end))
            nodes, first, n = np.unique(end[order], return_index=True, return_counts=True)
            rank = np.arange(len(end)) - np.repeat(first, n)
            crowded = np.union1d(crowded, nodes[n > self.small])
            partial, keep = np.isin(u, crowded) & np.isin(v, crowded), np.zeros(len(u), bool)
            keep[of[order[rank < self.dense]]] = True
            keep |= ~partial
            forest = np.array(_forest(u[partial], v[partial], d[partial]), np.int64).reshape(-1, 3)
            u, v, d = np.unique(np.concatenate([np.stack([u, v, d + 2 * PARTIAL * partial], axis=1)[keep], forest + [0, 0, PARTIAL]]), axis=0).T
        return _edges(np.concatenate([u, crowded]), np.concatenate([v, crowded]), np.concatenate([d, np.zeros(len(crowded), np.int64)]))

    @staticmethod
    def starts(keys, block) -> np.ndarray:
        """Where the keys' groups begin."""
        return np.flatnonzero(np.concatenate([[True], (np.diff(keys) != 0) | (np.diff(block >> 1) != 0)]))

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64)]
        for batch in batches:
            held = [np.concatenate([h, c.to_numpy().view(h.dtype)]) for h, c in zip(held, batch.columns)]
            if not len(held[0]):
                continue
            last = int(self.starts(held[0], held[4])[-1])  # the last group may go on in the next batch
            if last:
                yield self.edges_of(*(h[:last] for h in held))
                held = [h[last:] for h in held]
        if len(held[0]):
            yield self.edges_of(*held)


def _dealt(keyed: DataFrame, n: int, hot: int) -> Iterator[DataFrame]:
    """The rows with ``block``, and those of keys with more than ``hot`` rows once for each pair of blocks; in frames of about ``ROUND_ROWS`` rows a node, of n nodes."""
    crowded = released(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("key", F.ceil(F.col("n") / hot).cast("long").alias("size"), "n"), "hot-keys")
    rows = crowded.agg(F.sum(F.col("size") * F.col("n"))).first()[0]
    columns = ["key", "fp", "fp2", "node"]
    if not rows:
        yield keyed.select(*columns, F.lit(0).cast("long").alias("block"))
        return
    size = F.coalesce("size", F.lit(1).cast("long"))
    told = keyed.join(F.broadcast(crowded.select("key", "size")), "key", "left").select(*columns, size.alias("size"), F.pmod(F.xxhash64("node", F.lit(7)), size).alias("own"))
    told = told.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1)).alias("other"))
    block = 2 * (F.least("own", "other") * F.col("size") + F.greatest("own", "other")) + (F.col("own") > F.col("other")).cast("long")
    dealt, passes = told.select(*columns, block.alias("block")), ceil(rows / (ROUND_ROWS * n))
    for k in range(passes):
        yield dealt.where(F.pmod(F.xxhash64("key", F.shiftright("block", 1), F.lit(3)), F.lit(passes)) == k) if passes > 1 else dealt


def near_edges(nodes: DataFrame, max_bits: int, max_all: int = 128, hot: int | None = None) -> DataFrame:
    """Edges (u, v, bits apart d) between ``nodes`` (node, fp, fp2) that connect exactly what links of at most max_bits bits in fp, and max_all in both, connect.

    With ``max_all`` the edges are to be verified, so all links are returned, but for those between two nodes of very many.  Such a node gets an edge to itself
    too, and the edges returned between such nodes connect what their links connect.
    """
    n = nodes.count()
    scale = 1 << 30
    sample = nodes.where(F.pmod(F.xxhash64("fp"), F.lit(scale)) <= int(scale * min(1, SAMPLE / max(n, 1)))).select("fp").limit(2 * SAMPLE).toPandas().fp.to_numpy(np.int64).view(np.uint64)
    planned = plan(bit_statistics(nodes), n, sample, max_bits)
    ones = [(np.bincount(np.bitwise_count(sample & np.uint64(mask)), minlength=1) / max(len(sample), 1), t) for mask, t in planned]
    rounds = max(1, ceil(sum(share * comb(b, k) for of, t in ones for b, share in enumerate(of.tolist()) for k in range(t + 1)) / ROUND_ROWS))
    linker, found = _Linker(max_bits, max_all, planned), []
    for at in range(rounds):
        dealt, last = _dealt(signatures(nodes, planned, at, rounds), n, hot or HOT), None
        for rows in dealt:
            if last is not None:
                found.append(released(last, "near"))
            last = map_arrow(rows.repartition("key", F.shiftright("block", 1)).sortWithinPartitions("key", "block"), linker, "u long, v long, d int")
        found.append(last if rounds == 1 and not found else released(last, "near"))
    return reduce(DataFrame.union, found)


def near_duplicates(docs: DataFrame, shingle_words: int = 4, max_bits: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): the least doc_id that links reach; two texts link when their fingerprints differ in at most max_bits bits."""
    marked = stored(fingerprints(docs, shingle_words), "fingerprints")
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null").withColumn("fp2", F.lit(0).cast("long")), "nodes")
    roots = components(near_edges(nodes, max_bits)).withColumnRenamed("node", "of")
    named = stored(nodes.join(roots, nodes.node == roots.of, "left").select(F.col("fp").alias("a"), F.coalesce("root", "node").alias("component_id")), "named")
    return marked.join(named, marked.fp == named.a, "left").select("doc_id", "fp", "component_id")


def op5_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 4, 4)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
