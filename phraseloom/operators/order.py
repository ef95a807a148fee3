"""The whole order of the suffixes, without keys on disk.

``ranges`` puts suffixes in order by their first ``depth`` symbols.  The numbers found lie by document (``CHUNK`` documents of ``windows`` in a row), and a suffix that is still equal to another sends those of the places
``depth``, 2 x ``depth`` and so on behind it, up to the end of its document, to the range of its rank, which puts equal ones in order by them: what is known grows ``1 + AHEAD`` times in a round.  Suffixes that are equal
up to the end of their documents are put in order by what the next documents hold, for which documents alone are put in order, one row each.  Ranges are ranks, so no range is larger than ``ROWS`` and
one group of equal keys.  Tables are written in groups of documents, and removed as the ones that follow from them are written.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import dropped, released, rows_at_a_time, running_total
from . import ranges, windows

if TYPE_CHECKING:
    from ..sources.corpus import Corpus

#: Ranks of a range, numbers that a suffix sends, groups of documents, and groups of ranges.
ROWS, AHEAD, GROUPS = 1 << 19, 3, 4
STATE = "chunk long, n long, n_docs long, docs binary, body binary, alive boolean"
FOUND = "chunk long, n long, piece binary"


def coder():
    """``packed``: columns of numbers as compressed planes of bytes; ``opened``: the columns again."""

    def packed(*columns):
        import numpy as np
        import pyarrow as pa

        return pa.compress(b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1).T).tobytes() for c in columns), codec="zstd", asbytes=True)

    def opened(piece, n, *kinds):
        import numpy as np
        import pyarrow as pa

        sizes = [np.dtype(k).itemsize for k in kinds]
        raw, lo, found = np.frombuffer(pa.decompress(piece, decompressed_size=n * sum(sizes), codec="zstd", asbytes=True), np.uint8), 0, []
        for kind, size in zip(kinds, sizes):
            found.append(np.ascontiguousarray(raw[n * lo : n * (lo + size)].reshape(size, n).T).view(kind).ravel())
            lo += size
        return found

    return packed, opened


def _by_chunk(chunk_docs: int):
    """What makes pieces (chunk, n, piece) from columns doc, pos, start, tied."""
    packed, _ = coder()

    def pieces(doc, pos, start, tied):
        import numpy as np
        import pyarrow as pa

        order = np.lexsort((pos, doc))
        doc, pos, start, tied = doc[order], pos[order].astype("<u4"), start[order].astype("<i8"), tied[order].astype("<u1")
        chunk, rows = doc // chunk_docs, []
        cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(doc)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                rows.append((int(chunk[a]), b - a, packed((doc[a:b] - chunk[a] * chunk_docs).astype("<u4"), pos[a:b], start[a:b], tied[a:b])))
        kinds = [("chunk", pa.int64()), ("n", pa.int64()), ("piece", pa.binary())]
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], names=[k for k, _ in kinds])

    return pieces


def _split(chunk_docs: int):
    """The kernel for rows (doc_id, pos, start, tied): pieces by chunk."""
    pieces = _by_chunk(chunk_docs)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield from pieces(*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))).to_batches()

    return run


def _read(chunk_docs: int):
    """What reads pieces by chunk: doc, pos, start, tied."""
    _, opened = coder()

    def read(table):
        import numpy as np

        found = [(c * chunk_docs, *opened(p, n, "<u4", "<u4", "<i8", "<u1")) for c, n, p in zip(*(table[k].to_pylist() for k in ("chunk", "n", "piece"))) if p is not None]
        if not found:
            return [np.zeros(0, np.int64)] * 4
        return [np.concatenate(c) for c in zip(*((base + doc.astype(np.int64), pos.astype(np.int64), start, tied) for base, doc, pos, start, tied in found))]

    return read


def _state():
    """``load``: documents, sizes, starts and tied of a row of numbers by document; ``rows``: such rows, of the documents that have open suffixes at a depth and of the others."""
    packed, opened = coder()

    def load(n, n_docs, docs, body):
        return *opened(docs, n_docs, "<i8", "<i8"), *opened(body, n, "<i8", "<u1")

    def rows(chunk, names, sizes, start, tied, depth):
        import numpy as np
        import pyarrow as pa

        out, kinds = [], [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_()]
        if len(names):
            row, end = np.repeat(np.arange(len(names)), sizes), np.repeat(np.cumsum(sizes), sizes)
            open_ = np.bincount(row, weights=(tied > 0) & (end - np.arange(len(row)) >= depth), minlength=len(names)) > 0
            for alive in (True, False):
                mine = open_ == alive
                if mine.any():
                    at = mine[row]
                    out.append((chunk, int(at.sum()), int(mine.sum()), packed(names[mine].astype("<i8"), sizes[mine].astype("<i8")), packed(start[at].astype("<i8"), tied[at].astype("<u1")), alive))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=["chunk", "n", "n_docs", "docs", "body", "alive"])

    return load, rows


def _gathered(chunk_docs: int, depth: int):
    """The kernel of a chunk: its pieces, which hold every word, as numbers by document."""
    read, (_, rows) = _read(chunk_docs), _state()

    def gathered(table):
        import numpy as np

        doc, pos, start, tied = read(table)
        order = np.lexsort((pos, doc))
        names, sizes = np.unique(doc, return_counts=True)
        return rows(table["chunk"][0].as_py(), names, sizes, start[order], tied[order], depth)

    return gathered


def _merged(chunk_docs: int):
    """What reads the numbers of a chunk (all its rows) with the pieces found since: chunk, documents, sizes, starts, tied."""
    read, (load, _) = _read(chunk_docs), _state()

    def merged(state, found):
        import numpy as np

        parts = [load(*r) for r in zip(*(state[c].to_pylist() for c in ("n", "n_docs", "docs", "body")))]
        names, sizes, start, tied = (np.concatenate(c) for c in zip(*parts))
        begin, order = np.cumsum(sizes) - sizes, names.argsort()
        doc, pos, new, still = read(found)
        at = begin[order[np.searchsorted(names[order], doc)]] + pos
        start[at], tied[at] = new, still
        return names, sizes, start, tied

    return merged


def _updated(chunk_docs: int, depth: int):
    """The kernel of a chunk: its numbers with those found in a round."""
    merged, (_, rows) = _merged(chunk_docs), _state()

    def updated(state, found):
        if not state.num_rows:
            return rows(0, [], None, None, None, 0)
        return rows(state["chunk"][0].as_py(), *merged(state, found), depth)

    return updated


def _asking(depth: int, ahead: int, low: int, high: int):
    """The kernel for numbers by document: pieces (part, n, piece) of the suffixes still equal, with the numbers behind them, for the ranges from ``low`` to below ``high``.

    Depth 0: what is equal up to the end of its document, with the number of that end (``ends``, beside the document ids).
    """
    (packed, opened), (load, _), size = coder(), _state(), ROWS

    def asked(n, n_docs, docs, body, ends):
        import numpy as np

        names, sizes, start, tied = load(n, n_docs, docs, body)
        row, end = np.repeat(np.arange(len(names)), sizes), np.repeat(np.cumsum(sizes), sizes)
        part, left = start // size, end - np.arange(n)
        at = np.flatnonzero((tied > 0) & (left >= depth) & (part >= low) & (part < high))
        at = at[start[at].argsort(kind="stable")]
        left, row, first, part = left[at], row[at], start[at], part[at]
        if depth:
            values = [np.where(depth * j < left, start[np.minimum(at + depth * j, n - 1)], 0) for j in range(1, ahead + 1)]
        else:
            every, number = opened(ends[4:], int.from_bytes(ends[:4], "little"), "<i8", "<i8")
            values = [number[np.searchsorted(every, names[row])]]
        pos = sizes[row] - left
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(at)]
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                yield int(part[a]), b - a, packed(first[a:b], names[row[a:b]], pos[a:b].astype("<u4"), *(v[a:b].astype("<i8") for v in values))

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("piece", pa.binary())])
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(5))):
                found = list(asked(*row))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    return run


def _resolved(chunk_docs: int, ahead: int):
    """The kernel of a range: new numbers of its equal suffixes, and whether they are equal still, in pieces by chunk."""
    (_, opened), sort, pieces = coder(), windows.sorter(), _by_chunk(chunk_docs)

    def resolved(table):
        import numpy as np

        found = [opened(p, n, "<i8", "<i8", "<u4", *["<i8"] * ahead) for n, p in zip(table["n"].to_pylist(), table["piece"].to_pylist())]
        start, doc, pos, *values = [np.concatenate(c) for c in zip(*found)]
        halves = lambda v: ((v >> 32).astype(np.uint32), (v & 0xFFFFFFFF).astype(np.uint32))
        order, same = sort([h for v in (start, *values) for h in halves(v)])
        start, n = start[order], np.arange(len(order))
        group = np.maximum.accumulate(np.where(np.append(True, start[1:] != start[:-1]), n, 0))
        run = np.maximum.accumulate(np.where(np.append(True, ~same), n, 0))
        return pieces(doc[order], pos[order].astype(np.int64), start + run - group, np.append(False, same) | np.append(same, False))

    return resolved


def _classed():
    """The kernel for numbers by document: doc_id and the number of its first suffix."""
    load, _ = _state()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                names, sizes, start, _ = load(*row)
                yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(start[np.cumsum(sizes) - sizes])], ["doc_id", "class"])

    return run


def _ends(chunk_docs: int):
    """The kernel of a chunk: the numbers of the ends of its documents (doc_id, number) in one row."""
    packed, _ = coder()

    def ends(table):
        import pyarrow as pa

        table = table.sort_by("doc_id")
        body = packed(*(table[c].to_numpy().astype("<i8") for c in ("doc_id", "number")))
        return pa.table({"chunk": [table["doc_id"][0].as_py() // chunk_docs], "ends": pa.array([table.num_rows.to_bytes(4, "little") + body], pa.binary())})

    return ends


def _chunked(chunk_docs: int):
    """The kernel for numbered texts (docs, sizes, n_words, codes): adds chunk."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            chunk = [int.from_bytes(d[:8], "little", signed=True) // chunk_docs for d in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(chunk, pa.int64()), *batch.columns], ["chunk", *batch.schema.names])

    return run


def _listed(chunk_docs: int, frequent):
    """The kernel of a chunk: rank, doc_id, pos, key of its suffixes, from its numbers, what was found last, and its words."""
    merged, shift = _merged(chunk_docs), windows.FREQUENT

    def listed(state, others):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        names_ = ["rank", "doc_id", "pos", "key"]
        if not state.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in names_})
        names, sizes, start, _ = merged(state, others)
        begin, known = dict(zip(names.tolist(), (np.cumsum(sizes) - sizes).tolist())), np.asarray([0, 0, *frequent.value[1]], np.uint32)
        found = []
        texts = others.filter(pc.is_valid(others["codes"]))
        for docs, size, n, packed in zip(*(texts[c].to_pylist() for c in ("docs", "sizes", "n_words", "codes"))):
            raw = np.frombuffer(pa.decompress(packed, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
            codes = np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").ravel()
            own, part = np.frombuffer(docs, "<i8"), np.frombuffer(size, "<i8")
            pos = np.arange(n) - np.repeat(np.cumsum(part) - part, part)
            rank = start[np.repeat([begin[d] for d in own.tolist()], part) + pos]
            key = np.where(codes >= shift + 2, codes - np.uint32(shift), known[np.minimum(codes, len(known) - 1)]).astype(np.int64)
            found.append(pa.table(dict(zip(names_, (rank, np.repeat(own, part), pos, key)))))
        return pa.concat_tables(found)

    return listed


def table(corpus: Corpus, depth: int, doubled: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """rank, doc_id, pos, key (the number of its first word) of every suffix that starts at a word, by documents.  ``doubled``: puts equal rows (gpos, start, depth, tied) in order by those behind them."""
    from .suffixes import _packed

    spark, size, totals = corpus.spark, windows.CHUNK, corpus.totals.first()
    n_docs, parts = int(totals.n_docs), (int(totals.n_docs) + int(totals.n_tokens or 0)) // ROWS + 1
    group = lambda chunk: F.pmod(chunk, F.lit(GROUPS)).cast("int").alias("grp")
    chunk = F.expr(f"doc_id div {size} - int(doc_id % {size} < 0)")
    numbered, frequent = windows.numbered_texts(corpus)
    first = ranges.starts(corpus, depth, ("part", "doc_id", "pos", "start", "tied", group(chunk)), (numbered, frequent), ("grp",))
    live, settled = [], [[] for _ in range(GROUPS)]

    def kept(rows, g):
        state = released(rows, "suffix-numbers", by=("alive",))
        settled[g].append(state.where("not alive"))
        return state.where("alive")

    for g in range(GROUPS):
        own = first.where(F.col("grp") == g).select("doc_id", "pos", "start", "tied").mapInArrow(_split(size), FOUND)
        live.append(kept(own.groupBy("chunk").applyInArrow(_gathered(size, depth), STATE), g))
        dropped(first, f"/grp={g}/")

    def round_(states, depth, ahead, ends):
        """What a round finds, by group of chunks; the shuffle files of one group of ranges are removed before the next."""
        rows, found = reduce(DataFrame.unionByName, states), []
        rows = (rows.join(F.broadcast(ends), "chunk") if ends is not None else rows.withColumn("ends", F.lit(None).cast("binary"))).select("n", "n_docs", "docs", "body", "ends")
        edges = sorted({parts * i // GROUPS for i in range(GROUPS + 1)})
        for low, high in zip(edges, edges[1:]):
            asked = rows.mapInArrow(_asking(depth, ahead, low, high), "part long, n long, piece binary")
            with rows_at_a_time(spark, 64):
                found.append(released(asked.repartition(high - low, "part").groupBy("part").applyInArrow(_resolved(size, ahead), FOUND).withColumn("grp", group(F.col("chunk"))), "suffix-found", by=("grp",)))
        return reduce(DataFrame.unionByName, found)

    while any(not s.isEmpty() for s in live):
        found, depth = round_(live, depth, AHEAD, None), depth * (AHEAD + 1)
        for g in range(GROUPS):
            old, own = live[g], found.where(F.col("grp") == g).select("chunk", "n", "piece")
            live[g] = kept(old.groupBy("chunk").cogroup(own.groupBy("chunk")).applyInArrow(_updated(size, depth), STATE), g)
            dropped(old, "/alive=true/")
            dropped(found, f"/grp={g}/")
    states = [reduce(DataFrame.unionByName, s) for s in settled]

    classes = reduce(DataFrame.unionByName, states).select("n", "n_docs", "docs", "body").mapInArrow(_classed(), "doc_id long, class long")
    docs = corpus.docs.select("doc_id", F.lit(1).alias("one")).join(classes, "doc_id", "left").select("doc_id", "one", F.coalesce("class", F.lit(1)).cast("long").alias("class"))  # 1: an empty document
    docs = running_total(docs, ["doc_id"], "one", "number", "document-numbers").select("doc_id", "number", "class")
    end = spark.createDataFrame([(n_docs, 0)], "gpos long, class long")  # the terminator
    order = doubled(docs.select(F.col("number").alias("gpos"), "class").unionByName(end)).select((F.col("gpos") - 1).alias("number"), F.col("start").alias("at"))
    behind = docs.join(order, "number").select("doc_id", F.col("at").alias("number"))  # of the document that follows
    ends = released(behind.withColumn("chunk", chunk).groupBy("chunk").applyInArrow(_ends(size), "chunk long, ends binary"), "document-ends")

    found, ranked = round_(states, 0, 1, ends), []
    none = lambda kind: F.lit(None).cast(kind)
    texts = numbered.select("docs", "sizes", "n_words", "codes").mapInArrow(_chunked(size), "chunk long, docs binary, sizes binary, n_words long, codes binary")
    for g in range(GROUPS):
        own = found.where(F.col("grp") == g).select("chunk", "n", "piece", *(none(k).alias(c) for c, k in (("docs", "binary"), ("sizes", "binary"), ("n_words", "long"), ("codes", "binary"))))
        others = own.unionByName(texts.where(group(F.col("chunk")) == g).select("chunk", none("long").alias("n"), none("binary").alias("piece"), "docs", "sizes", "n_words", "codes"))
        ranked.append(_packed(states[g].groupBy("chunk").cogroup(others.groupBy("chunk")).applyInArrow(_listed(size, frequent), "rank long, doc_id long, pos long, key long"), "suffixes"))
        for s in settled[g]:
            dropped(s, "/alive=false/")
        dropped(found, f"/grp={g}/")
    dropped(numbered)
    return reduce(DataFrame.unionByName, ranked)


def _neighbours(low: int, high: int, edges: bool):
    """The kernel of ``disorder`` for rows (rank, doc_id, pos, key): each with the rank of the row behind it in its document, where that row comes next, in pieces (block, n, piece) for the blocks from ``low`` to below ``high``.

    With ``edges``, instead, rows (side, rank, doc_id, pos, key) that aren't followed by the next word of their document (side 0), and rows that don't follow one (side 1).
    """
    (packed, _), size = coder(), ROWS

    def pieces(rank, key, behind):
        import numpy as np
        import pyarrow as pa

        rank, key, behind = (np.concatenate([c, c[rank % size == 0]]) for c in (rank, key, behind))
        block = rank // size
        block[len(rank) - int((rank % size == 0).sum()) // 2 :] -= 1  # the first row of a block is the last neighbour of the block before
        at = np.flatnonzero((block >= low) & (block < high))
        at = at[np.lexsort((rank[at], block[at]))]
        cuts, out = [0, *(np.flatnonzero(np.diff(block[at])) + 1).tolist(), len(at)], []
        for a, b in zip(cuts, cuts[1:]):
            if a < b:
                mine = at[a:b]
                out.append((int(block[mine[0]]), b - a, packed(np.diff(rank[mine], prepend=0).astype("<i8"), key[mine].astype("<i8"), behind[mine].astype("<i8"))))
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], ["block", "n", "piece"])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        held, before = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if held is not None:
                columns = [np.concatenate(c) for c in zip(held, columns)]
            yield from found(columns, before, False)
            before = [c[-2] for c in columns] if len(columns[0]) > 1 else before
            held = [c[-1:] for c in columns]
        if held is not None:
            yield from found(held, before, True)

    def found(columns, before, last):
        import numpy as np
        import pyarrow as pa

        rank, doc, pos, key = columns
        follows = np.append(before is not None and before[1] == doc[0] and before[2] + 1 == pos[0], (doc[1:] == doc[:-1]) & (pos[1:] == pos[:-1] + 1))
        n = len(rank) - (not last)  # the last row waits for the next batch
        if edges:
            followed = np.append(follows[1:], False)[:n]
            for side, at in ((0, np.flatnonzero(~followed)), (1, np.flatnonzero(~follows[:n] & (pos[:n] > 0)))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), side, np.int32)), *(pa.array(c[at]) for c in (rank, doc, pos, key))], ["side", "rank", "doc_id", "pos", "key"])
        else:
            at = np.flatnonzero(follows[1:])
            yield pieces(rank[at], key[at], rank[at + 1])

    def ends(batches):
        for batch in batches:
            if batch.num_rows:
                yield pieces(*(batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)))

    return run, ends


def _disordered():
    """The kernel of a block: neighbours that are not in order.  A rank behind of -1: there is none."""
    _, opened = coder()

    def disordered(table):
        import numpy as np
        import pyarrow as pa

        found = [opened(p, n, "<i8", "<i8", "<i8") for n, p in zip(table["n"].to_pylist(), table["piece"].to_pylist())]
        rank, key, behind = (np.concatenate(c) for c in zip(*((np.cumsum(r), k, b) for r, k, b in found)))
        order = rank.argsort(kind="stable")
        rank, key, behind = rank[order], key[order], behind[order]
        r, s, n, rank, symbol, behind = rank[1:], key[1:], behind[1:], rank[:-1], key[:-1], behind[:-1]
        wrong = (r != rank + 1) | (s < symbol) | ((s == symbol) & (n <= behind) & (behind >= 0))
        return pa.table({"wrong": pa.array([int(wrong.sum())], pa.int64())})

    return disordered


def disorder(corpus: Corpus) -> DataFrame:
    """``suffixes.disorder``: rows are read as they lie, by documents, in ``GROUPS`` rounds of blocks of ranks; only rows at the ends of what a reader has in a row are joined."""
    rows = corpus.suffixes.select("rank", "doc_id", "pos", "key")
    edges = released(rows.mapInArrow(_neighbours(0, 0, True)[0], "side int, rank long, doc_id long, pos long, key long"), "suffix-edges")
    behind = edges.where("side = 1").select("doc_id", (F.col("pos") - 1).alias("pos"), F.col("rank").alias("behind"))
    ends = released(edges.where("side = 0").join(behind, ["doc_id", "pos"], "left").select("rank", "key", F.coalesce("behind", F.lit(-1)).cast("long").alias("behind")), "suffix-ends")
    most, found = (rows.agg(F.max("rank")).first()[0] or 0) // ROWS + 1, []
    cuts = sorted({most * i // GROUPS for i in range(GROUPS + 1)})
    for low, high in zip(cuts, cuts[1:]):
        low = low - (low == 0)  # the first row of all has a block before
        kinds = "block long, n long, piece binary"
        run, own = _neighbours(low, high, False)
        pieces = rows.mapInArrow(run, kinds).unionByName(ends.mapInArrow(own, kinds))
        with rows_at_a_time(corpus.spark, 1 << 16):
            found.append(released(pieces.repartition(high - low, "block").groupBy("block").applyInArrow(_disordered(), "wrong long"), "suffix-disorder"))
    return reduce(DataFrame.unionByName, found).agg(F.coalesce(F.sum("wrong"), F.lit(0)).cast("long").alias("mismatches"))
