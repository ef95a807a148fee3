"""Near copies of texts: SimHash candidates, verified by the exact Jaccard similarity of their word shingles.

A text's set holds its distinct shingles of ``size`` lower-cased words (A-Z only); a text with fewer words is one shingle, and one without words has an
empty set.  Texts of equal sets are one class.  Two classes link when common / all shingles is at least ``SIMILARITY``.

Candidates are classes whose 128-bit fingerprints (bit i is set when it is set in over half the shingles' hashes) differ in at most ``PROBE_BITS`` bits of one half or the
other, and in at most ``ALL_BITS`` in all; the pigeonhole search of ``simhash`` finds them.  Candidates are verified in three rounds, and those whose ends the links found so far join are left out: the nearest candidates of
each class, the nearest of each two groups, and all others.  Between classes with very many candidates ("crowded" ones) the search returns only the nearest pairs and those that hold
their chain together.  Each chain of crowded classes is then dealt, with its sets, over pairs of bounded blocks; inside a pair of blocks every candidate whose ends are still in
different groups is verified in place, so no pair is ever a row, and no candidate is lost.  The blocks go through the shuffle in rounds of at most about the bytes of all sets.

Defined cases: null, empty and blank texts are one class.  Rows without doc_id take part like any other.  Rows with equal doc_id and different texts are documents of their own.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import released
from ..sources.store import written as stored
from .components import SENT_ROWS, components, merged
from .frames import map_arrow, map_blocks, texts_of
from .simhash import PARTIAL, SPREAD, near_edges
from .textkernel import LOWER, SPACE, WINDOW_HASH, WORD_HASH, mix64, window_hashes, word_spans

#: Similarity as a fraction.
SIMILARITY = (4, 5)
#: Two texts of similarity 0.8 differ in 9.7 bits of a half on average (deviation 2.9), and in 19.4 of all (4.1).
PROBE_BITS, ALL_BITS = 13, 25
#: Classes of a block of crowded classes on average, and hashes of their sets, unless one set has more.
BLOCK_CLASSES, BLOCK_HASHES = 256, 1 << 20
#: Bytes of sets that a round of blocks may shuffle, though all sets have fewer.
ROUND_BYTES = 1 << 28
#: Runs of 255 shingles whose bits are counted together.
RUNS = 64


def hashes(data: np.ndarray, borders: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of the texts, one text after the other, and their n+1 borders."""
    data = LOWER[data]
    starts, ends, first = word_spans(data, borders, ~SPACE)
    words = WORD_HASH.words(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
    n_words = np.diff(first)
    _, found = window_hashes(words, first, size, WINDOW_HASH)
    short = np.flatnonzero((n_words > 0) & (n_words < size))
    n = np.where((n_words > 0) & (n_words < size), 1, np.maximum(n_words - size + 1, 0))
    cuts = np.concatenate([[0], np.cumsum(n)])
    if len(short):
        own = [WINDOW_HASH.runs(words[first[i] : first[i + 1]], int(n_words[i])) for i in short.tolist()]
        found = np.insert(found, cuts[short] - np.arange(len(short)), np.concatenate(own))
    return found, cuts


def prints(found: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two halves of each text's fingerprint."""
    n = np.diff(cuts)
    runs = -(-n // 255)  # a byte counts up to 255
    owner = np.repeat(np.arange(len(n)), runs)
    begin = cuts[owner] + 255 * (np.arange(len(owner)) - np.repeat(np.cumsum(runs) - runs, runs))
    counts = np.zeros((len(n), 128), np.int64)
    for lo in range(0, len(begin), RUNS):
        at = begin[lo : lo + RUNS]
        end = begin[lo + RUNS] if lo + RUNS < len(begin) else cuts[-1]
        part = found[at[0] : end]
        raw = np.stack([mix64(part + np.uint64(0x632BE59BD9B4E019)), mix64(part ^ np.uint64(0x9E3779B97F4A7C15))], axis=1).view(np.uint8)
        lanes = np.add.reduceat(SPREAD[raw], at - at[0], axis=0)
        np.add.at(counts, owner[lo : lo + RUNS], lanes.view(np.uint8).reshape(len(at), 128))
    bits = np.packbits(2 * counts > n[:, None], axis=1).view(">u8").astype(np.uint64)
    return bits[:, 0], bits[:, 1]


def sets(data: np.ndarray, borders: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    found, cuts = hashes(data, borders, size)
    return [np.unique(found[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _class(own: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(own.tobytes())


def classes(docs: DataFrame, size: int) -> DataFrame:
    """(doc_id, hash, class, fp, fp2) of every row; hash is of the text as it is."""

    def kernel(rows, data, borders):
        found, cuts = hashes(data, borders, size)
        of = np.array([_class(np.unique(found[a:b])) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())], np.uint64)
        return [rows.column(0), rows.column(2), *(x.view(np.int64) for x in (of, *prints(found, cuts)))]

    return map_blocks(texts_of(docs, _hash(docs).alias("hash")), kernel, "doc_id long, hash long, class long, fp long, fp2 long")


def _hash(docs: DataFrame):
    return F.xxhash64(docs["text"].cast("string"))


def _joined(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The rows of docs with one of the ids (_id, _hash); these are broadcast if they are few."""
    same = docs["doc_id"].cast("long").eqNullSafe(ids["_id"]) & (_hash(docs) == ids["_hash"])
    return docs.join(F.broadcast(ids) if ids.count() <= SENT_ROWS else ids, same, how)


def _both_halves(by_print: DataFrame) -> DataFrame:
    swapped = by_print.withColumns({"fp": F.col("fp2"), "fp2": F.col("fp")})
    found = near_edges(by_print, PROBE_BITS, ALL_BITS).union(near_edges(swapped, PROBE_BITS, ALL_BITS))
    return found.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("d").alias("d"))


def _candidates(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, v, d): pairs of classes, u < v, whose fingerprints differ in d bits, and a pair (u, u) of a class of which pairs were left out; and (fp, fp2, node), a class of each
    fingerprint.  nodes has (class, fp, fp2)."""
    by_print = stored(nodes.groupBy("fp", "fp2").agg(F.min("class").alias("node")), "prints")
    same = nodes.join(by_print.withColumnsRenamed({"fp": "a", "fp2": "b"}), (F.col("fp") == F.col("a")) & (F.col("fp2") == F.col("b"))).where("class <> node")
    found = _both_halves(by_print).union(same.select("node", "class", F.lit(0).cast("int")))
    return stored(found, "candidates"), by_print


def _sets_of(pairs: DataFrame, docs: DataFrame, named: DataFrame, size: int) -> DataFrame:
    """(class, grams): the sets, as 32-bit hashes, of the classes in pairs; ``named`` has a row of each class."""
    ends = pairs.select(F.col("u").alias("class")).union(pairs.select("v")).distinct()
    wanted = stored(ends.join(named, "class").select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), F.col("class").alias("_class")), "wanted")

    def kernel(rows, data, borders):
        own = sets(data, borders, size)
        return [rows.column(1), np.array([_class(x) for x in own], np.uint64).view(np.int64), [np.unique(x >> np.uint64(32)).astype("<u4").tobytes() for x in own]]

    chosen = _joined(docs, wanted, "inner").select(docs["text"].cast("string").alias("text"), wanted["_class"].alias("class"))
    held = map_blocks(chosen, kernel, "class long, found long, grams binary").where("class = found")
    return stored(held.dropDuplicates(["class"]).select("class", "grams"), "shingle-sets")


def _links(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """(u, v): the groups p and q of the pairs (u, v, p, q) that link."""
    left, right = (held.select(F.col("class").alias(k), F.col("grams").alias(g)) for k, g in (("u", "a"), ("v", "b")))
    up, down = SIMILARITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3)):
                a, b = (np.frombuffer(x.as_buffer(), "<u4") for x in (a, b))
                near = down * min(len(a), len(b)) >= up * max(len(a), len(b))
                common = len(np.intersect1d(a, b, assume_unique=True)) if near else 0
                keep.append(down * common >= up * (len(a) + len(b) - common))
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.select("u", "v", "p", "q").join(left, "u").join(right, "v")
    return stored(map_arrow(joined.select(F.col("p").alias("u"), F.col("q").alias("v"), "a", "b"), run, "u long, v long"), "links")


def _block_links(side, fp, fp2, node, root, grams) -> tuple[list[int], list[int]]:
    """The ends of links between the classes of two blocks (or of one, if ``side`` is everywhere the same) that connect what all links of candidates
    with different roots connect."""
    up, down = SIMILARITY
    n = np.array([len(g) for g in grams])
    borders = np.concatenate([[0], np.cumsum(n)])
    flat = np.unique(np.concatenate(grams), return_inverse=True)[1].astype(np.int32)
    own, root, one = np.zeros(len(flat), bool), root.copy(), (side == side[0]).all()
    u, v = [], []
    for i in range(len(n) - 1):
        rest = slice(i + 1, None)
        first, second = np.bitwise_count(fp[i] ^ fp[rest]), np.bitwise_count(fp2[i] ^ fp2[rest])
        ok = (first + second <= ALL_BITS) & (np.minimum(first, second) <= PROBE_BITS) & (root[i] != root[rest])
        ok &= (down * np.minimum(n[i], n[rest]) >= up * np.maximum(n[i], n[rest])) & (one | (side[i] != side[rest]))
        at = np.flatnonzero(ok) + i + 1
        if not len(at):
            continue
        mine = flat[borders[i] : borders[i + 1]]
        own[mine] = True
        theirs = np.concatenate([flat[a:b] for a, b in zip(borders[at].tolist(), borders[at + 1].tolist())])
        common = np.add.reduceat(own[theirs], np.cumsum(n[at]) - n[at], dtype=np.int64)
        own[mine] = False
        for j in at[down * common >= up * (n[i] + n[at] - common)].tolist():
            if root[j] != root[i]:
                u.append(node[i])
                v.append(node[j])
                root[root == root[j]] = root[i]
    return u, v


def _crowded_links(near: DataFrame, crowded: DataFrame, by_print: DataFrame, held: DataFrame, roots: DataFrame) -> DataFrame:
    """(u, v): groups that links between their crowded classes (of) join; they connect what all such links connect."""
    spanning = near.where(F.col("d") < 2 * PARTIAL)  # the forests connect what the other pairs of crowded classes do
    both = spanning.join(crowded, F.col("u") == F.col("of"), "left_semi").join(crowded, F.col("v") == F.col("of"), "left_semi")
    chains = components(both).select("node", F.col("root").alias("chain"))
    known = chains.join(roots.select("node", "root"), "node", "left").select(F.col("node").alias("class"), "chain", F.coalesce("root", "node").alias("root"))
    known = stored(known.join(by_print.withColumnRenamed("node", "class"), "class").join(held, "class"), "crowded")
    sizes = known.groupBy("chain").agg(F.greatest(F.count("*") / BLOCK_CLASSES, F.sum(F.length("grams") / 4) / BLOCK_HASHES).alias("n"), F.sum(F.length("grams")).alias("bytes"), F.min("root").alias("a"), F.max("root").alias("b"))
    sizes = stored(sizes.where("a <> b").select("chain", F.ceil("n").cast("int").alias("n"), "bytes"), "chains")
    dealt_bytes, all_bytes = sizes.agg(F.sum(F.col("n") * F.col("bytes"))).first()[0] or 0, held.agg(F.sum(F.length("grams"))).first()[0] or 0
    rounds = max(1, ceil(dealt_bytes / max(all_bytes, ROUND_BYTES)))
    side = F.pmod(F.xxhash64("class", F.lit(7)), F.col("n")).cast("int")
    dealt = known.join(sizes.select("chain", "n"), "chain").withColumn("side", side).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    key = F.xxhash64("chain", F.least("side", "other"), F.greatest("side", "other")).alias("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the key that may go on

        def linked(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
            rows = pa.Table.from_batches(parts)
            side, fp, fp2, root = (rows.column(k).to_numpy() for k in range(1, 5))
            u, v = _block_links(side, fp.view(np.uint64), fp2.view(np.uint64), root, root, [np.frombuffer(g.as_buffer(), "<u4") for g in rows.column(5)])
            return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if held and held[-1].column(0)[0].as_py() != keys[a]:
                    yield linked(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield linked(held)

    packed = dealt.select(key, "side", "fp", "fp2", "root", "grams")
    parts = [packed.where(F.pmod("key", F.lit(rounds)) == at) if rounds > 1 else packed for at in range(rounds)]
    return reduce(DataFrame.union, [released(map_arrow(part.repartition("key").sortWithinPartitions("key"), run, "u long, v long"), "crowded-links") for part in parts])


def _settled(rest: DataFrame, held: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, root) of the groups after the pairs ``rest`` (u, v, d) are verified; those whose ends earlier links join are left out."""
    for choice in (["p", "q"], None):
        for end, root in (("u", "p"), ("v", "q")):
            rest = rest.join(roots.select(F.col("node").alias(end), F.col("root").alias(root)), end, "left").withColumn(root, F.coalesce(root, end))
        rest = stored(rest.where("p <> q").select("u", "v", "d", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q")), "rest")
        if not rest.limit(1).count():
            break
        chosen = rest
        if choice:
            chosen = stored(rest.groupBy(*choice).agg(F.min(F.struct("d", "u", "v")).alias("x")).select("x.u", "x.v", *choice), "chosen")
        roots = merged(roots, _links(chosen, held))
        rest = rest.select("u", "v", "d").join(chosen.select("u", "v"), ["u", "v"], "left_anti") if choice else rest
    return roots


def linked(docs: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """(node, root) of the classes that have a link; nodes has (class, fp, fp2, doc_id, hash), one row each."""
    pairs, by_print = _candidates(nodes)
    near, crowded = pairs.where("u <> v"), pairs.where("u = v").select(F.col("u").alias("of"))
    held = _sets_of(near, docs, nodes.select("class", "doc_id", "hash"), size)
    bits = F.when(F.col("d") < PARTIAL, F.col("d")).otherwise(F.col("d") % PARTIAL + PARTIAL)
    nearest = [near.groupBy(end).agg(F.min(F.struct(bits.alias("d"), "u", "v")).alias("x")).select("x.u", "x.v") for end in ("u", "v")]
    nearest = stored(nearest[0].union(nearest[1]).distinct(), "nearest")
    roots = stored(components(_links(nearest.select("u", "v", F.col("u").alias("p"), F.col("v").alias("q")), held)), "roots")
    roots = _settled(near.where(F.col("d") < PARTIAL), held, roots)
    if crowded.limit(1).count():
        roots = merged(roots, _crowded_links(near, crowded, by_print, held, roots))
    return roots


def without_near_copies(docs: DataFrame, size: int) -> DataFrame:
    """One row of each group of near copies: that with the least doc_id (null last), of those the one with the least hash of its text, once."""
    marked = stored(classes(docs, size), "classes")
    named = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash", "fp", "fp2")).alias("x")
    nodes = stored(marked.groupBy("class").agg(named).select("class", "x.fp", "x.fp2", "x.doc_id", "x.hash"), "nodes")
    roots = linked(docs, nodes, size)
    grouped = marked.join(roots, marked["class"] == roots.node, "left").select("doc_id", "hash", F.coalesce("root", "class").alias("root"))
    rows = stored(grouped.groupBy("root", "doc_id", "hash").agg(F.count("*").alias("n")), "rows")
    best = rows.groupBy(F.col("root").alias("_root")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "hash")).alias("best"))
    told = rows.join(best, F.col("root") == F.col("_root")).select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "n", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("hash") == F.col("best.hash"))).alias("kept"))
    told = stored(told, "told")
    gone, repeated = told.where("not kept").select("_id", "_hash"), told.where("kept and n > 1").select("_id", "_hash")
    if not repeated.limit(1).count():
        return _joined(docs, gone, "left_anti")
    once = _joined(docs, repeated, "inner").dropDuplicates(["_id", "_hash"]).select([docs[c] for c in docs.columns])
    return _joined(docs, stored(gone.union(repeated), "gone"), "left_anti").union(once)
