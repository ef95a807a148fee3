"""Right-maximal n-grams of 2 to ``LONGEST`` words without the suffix table: the first ``LONGEST`` + 1 symbols of every suffix are put in order by ranges, counted, and forgotten.

The words of a document are numbered where the document is: the most frequent ones by a table that is sent to all tasks, the others by one that meets the documents in groups.  In each of ``ROUNDS`` rounds, a group's
suffixes with the first words of the round are sorted there, cut at the bounds of the ranges (quantiles of a sample, which decides how the work is dealt out, never a result) and travel in packed pieces: what a suffix has in common with the
one before it is left out, and the symbols lie in planes of bytes.  A range merges its pieces, counts its runs, and only the runs are written.  Runs at the ends of ranges are added up.
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import released, rows_at_a_time

if TYPE_CHECKING:
    from ..sources.corpus import Corpus

#: Words of the longest n-grams.
LONGEST = 10
#: The most frequent words, which are sent to all tasks.
FREQUENT = 1 << 16
#: Documents of a group, words of it that are sorted at a time, and suffixes of a range.
CHUNK, WORDS, ROWS = 1_024, 1 << 19, 1 << 20
#: Rounds, each with the suffixes of its first words; only the pieces of one are on disk at a time.
ROUNDS = 8
#: Suffixes of the sample for a range.
SAMPLED = 64


def _rare(frequent, chunk_docs: int):
    """The kernel for rows (doc_id, w): chunk, term of the words that aren't among the frequent ones, once for each group and batch."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        terms = pa.array(frequent.value[0], pa.string())
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            coded = lists.flatten().dictionary_encode()
            if not len(coded):
                continue
            new = pc.is_null(pc.index_in(coded.dictionary, value_set=terms)).to_numpy(zero_copy_only=False)
            number = coded.indices.to_numpy().astype(np.int64)
            chunk = np.repeat(batch.column(0).to_numpy() // chunk_docs, size)
            at = np.flatnonzero(new[number])
            chunks, which = np.unique(chunk[at], return_inverse=True)
            which, number = np.divmod(np.unique(which * len(new) + number[at]), len(new))
            yield pa.RecordBatch.from_arrays([pa.array(chunks[which]), coded.dictionary.take(pa.array(number))], ["chunk", "term"])

    return run


def _numbered(frequent):
    """The kernel of a group: its words as numbers, about ``WORDS`` at a time, from its texts (``texts_in_groups``) and the numbers of its rarer words (chunk, term, term_id).

    A frequent word is 2 + its place by frequency, which packs well; another one ``FREQUENT`` + its term number.
    """
    limit, shift, opened = WORDS, FREQUENT, _opened()

    def numbered(texts, names):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        schema = pa.schema([("n_words", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary()), ("codes", pa.binary())])
        if not texts.num_rows:
            return schema.empty_table()
        words = frequent.value[0]
        vocabulary = pa.concat_arrays([pa.array(words, pa.string()), names["term"].combine_chunks().cast(pa.string())])
        codes = np.concatenate([np.arange(len(words)) + 2, names["term_id"].to_numpy() + shift]).astype(np.uint32)
        owners, text = opened(texts)
        lists = pc.split_pattern(text, " ")
        size = np.diff(lists.offsets.to_numpy()).astype(np.int64)
        total, lo, found = np.cumsum(size), 0, []
        while lo < len(size):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + limit, "right")))
            coded = lists.slice(lo, hi - lo).flatten().dictionary_encode()
            code = codes[pc.index_in(coded.dictionary.cast(pa.string()), value_set=vocabulary).to_numpy(zero_copy_only=False)][coded.indices.to_numpy()]
            planes = np.ascontiguousarray(code.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()
            found.append((len(code), owners[lo:hi].astype("<i8").tobytes(), size[lo:hi].astype("<i8").tobytes(), pa.compress(planes, codec="zstd", asbytes=True)))
            lo = hi
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    return numbered


def sorter():
    """What puts rows (columns of numbers of 32 bits) in order: their order, and whether each is equal to the next.  Only rows that are still equal look at further columns."""

    def sort(key):
        import numpy as np

        n = len(key[0])

        def pair(j, rows):
            high = key[j][rows].astype(np.uint64) << np.uint64(32)
            return high | key[j + 1][rows].astype(np.uint64) if j + 1 < len(key) else high

        value = pair(0, slice(None))
        order = value.argsort()
        value = value[order]
        same = value[1:] == value[:-1]
        for j in range(2, len(key), 2):
            if not same.any():
                break
            tied = np.zeros(n, bool)
            tied[1:] = same
            tied[:-1] |= same
            at = np.flatnonzero(tied)
            group, rows = np.cumsum(np.append(True, ~same))[at], order[at]
            value = pair(j, rows)
            own = value.argsort()
            own = own[group[own].argsort(kind="stable")]
            order[at], value = rows[own], value[own]
            same = np.zeros(n - 1, bool)
            same[at[1:][(value[1:] == value[:-1]) & (group[1:] == group[:-1])] - 1] = True
        return order, same

    return sort


def _cut(frequent, low: int, high: int, bounds, base: int):
    """The kernel of a round: of numbered texts the sorted suffixes whose first symbol is from ``low`` to below ``high``, in packed pieces, one for each range.

    Suffixes of other rounds have no word in common with these, so a document's neighbours are all here.
    """
    size_of, separator, shift, sort = LONGEST + 1, 1, FREQUENT, sorter()

    def pieces(n_words, docs, sizes, packed_codes):
        import numpy as np
        import pyarrow as pa

        raw = np.frombuffer(pa.decompress(packed_codes, decompressed_size=4 * n_words, codec="zstd", asbytes=True), np.uint8)
        codes = np.ascontiguousarray(raw.reshape(4, n_words).T).view("<u4").ravel()
        own, part = np.frombuffer(docs, "<i8"), np.frombuffer(sizes, "<i8")
        known = np.asarray([0, 0, *frequent.value[1]], np.uint32)
        ids = np.where(codes >= shift + 2, codes - np.uint32(shift), known[np.minimum(codes, len(known) - 1)]).astype(np.uint32)
        row = np.repeat(np.arange(len(part)), part)
        pos = np.arange(len(row)) - np.repeat(np.cumsum(part) - part, part)
        symbols, sent = (np.full(len(row) + len(part) + size_of, separator, np.uint32) for _ in range(2))
        at = np.arange(len(row)) + row  # a separator behind every document
        symbols[at], sent[at] = ids, codes
        kept = np.flatnonzero((ids >= low) & (ids < high))
        if not len(kept):
            return
        row, pos, at = row[kept], pos[kept], at[kept]
        left = part[row] - pos
        key = [np.where(left >= j, symbols[at + j], 0).astype(np.uint32) for j in range(size_of)]
        order, _ = sort(key)
        row, pos, at, left, key = row[order], pos[order], at[order], left[order], [k[order] for k in key]
        mine = np.argsort(row.astype(np.uint16) if len(part) < 1 << 16 else row, kind="stable")  # a document's suffixes in order
        shared, same = np.zeros(len(row), np.uint8), row[mine[1:]] == row[mine[:-1]]
        for k in key:
            same &= (k[mine[1:]] == k[mine[:-1]]) & (k[mine[1:]] > separator)
            shared[mine[1:]] += same
        common, same = np.zeros(len(row), np.uint8), np.ones(len(row) - 1, bool)
        for k in key:
            same &= k[1:] == k[:-1]
            common[1:] += same
        whole = np.stack(key, axis=1).astype(">u4").view(f"S{4 * size_of}").ravel()
        cuts = [0, *np.searchsorted(whole, bounds.value).tolist(), len(row)]
        key = [np.where(left >= j, sent[at + j], 0).astype(np.uint32) for j in range(size_of)]
        for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a == b:
                continue
            here = common[a:b].copy()
            here[0] = 0
            names, which = np.unique(row[a:b], return_inverse=True)
            planes = [np.where(here > j, 0, k[a:b]) for j, k in enumerate(key)] + [pos[a:b], which]
            body = [np.ascontiguousarray(p.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for p in planes]
            piece = pa.compress(b"".join([*body, here.tobytes(), shared[a:b].tobytes()]), codec="zstd", asbytes=True)
            yield base + number, b - a, own[names].astype("<i8").tobytes(), piece

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("part", pa.int32()), ("n", pa.int64()), ("docs", pa.binary()), ("piece", pa.binary())])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                found = list(pieces(*row))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    return run


def _counted(frequent):
    """The kernel of a range: for every m the groups of equal first m words with two or more different symbols behind, and the groups at its ends; and a row with m = 0 and the number of its suffixes."""
    longest, separator, shift, sort = LONGEST, 1, FREQUENT, sorter()
    names = ["part", "m", "head", "sp", "nocc", "ndoc", "low", "high", "border", "doc_id", "pos"]

    def counted(table):
        import numpy as np
        import pyarrow as pa

        n_planes, pieces, known = longest + 3, [], np.asarray([0, separator, *frequent.value[1]], np.uint32)
        for n, docs, piece in zip(table["n"].to_pylist(), table["docs"].to_pylist(), table["piece"].to_pylist()):
            raw = np.frombuffer(pa.decompress(piece, decompressed_size=n * (4 * n_planes + 2), codec="zstd", asbytes=True), np.uint8)
            planes = [np.ascontiguousarray(raw[4 * n * j : 4 * n * (j + 1)].reshape(4, n).T).view("<u4").ravel() for j in range(n_planes)]
            here, shared = raw[4 * n * n_planes : 4 * n * n_planes + n], raw[4 * n * n_planes + n :]
            for j in range(longest + 1):  # what was left out is what the suffix before has
                code = planes[j][np.maximum.accumulate(np.where(here > j, 0, np.arange(n)))]
                planes[j] = np.where(code >= shift + 2, code - np.uint32(shift), known[np.minimum(code, len(known) - 1)]).astype(np.uint32)
            pieces.append([*planes[:-1], np.frombuffer(docs, "<i8")[planes[-1]], shared])
        columns = [np.concatenate(c) for c in zip(*pieces)]
        del pieces
        order, _ = sort(columns[: longest + 1])
        columns = [c[order] for c in columns]
        key, pos, doc, shared = columns[: longest + 1], columns[-3].astype(np.int64), columns[-2], columns[-1]
        size, part = len(pos), table["part"][0].as_py()
        common, words = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        same, inside = np.ones(size - 1, bool), np.ones(size, bool)
        for k in key:
            same &= k[1:] == k[:-1]
            common[1:] += same
            inside &= k > separator
            words += inside
        found = []

        def add(m, heads, *values):
            n = len(heads)
            columns = [pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, m)), heads, *map(pa.array, values)]
            found.append(pa.Table.from_arrays(columns, names))

        zero = np.zeros(1, np.int64)
        add(0, pa.array([b""], pa.binary()), zero, np.array([size]), zero, zero, zero, np.zeros(1, bool), zero, zero)
        for m in range(2, longest + 1):
            start = np.flatnonzero(common < m)
            nocc = np.diff(np.append(start, size))
            ndoc = nocc - np.add.reduceat((shared >= m).astype(np.int64), start)
            low, high = np.minimum.reduceat(key[m], start), np.maximum.reduceat(key[m], start)
            border = np.zeros(len(start), bool)
            border[[0, -1]] = True
            kept = np.flatnonzero((words[start] >= m) & (border | ((nocc > 1) & (low < high))))
            s = start[kept]
            data = np.stack([k[s] for k in key[:m]], axis=1).astype(">u4").tobytes()
            heads = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer(np.arange(0, len(data) + 1, 4 * m, dtype=np.int32)), pa.py_buffer(data)])
            add(m, heads, s, nocc[kept], ndoc[kept], low[kept].astype(np.int64), high[kept].astype(np.int64), border[kept], doc[s], pos[s])
        return pa.concat_tables(found)

    return counted


def quantiles(corpus: Corpus, ranges: int, n_tokens: int, size: int) -> list[bytes]:
    """The bounds of so many ranges, ``size`` symbols packed, equal ones as often as they come: quantiles of suffixes at regular distances in their documents."""
    if ranges < 2:
        return []
    step = max(n_tokens // (ranges * SAMPLED), 1)
    at = F.expr(f"sequence(pmod(xxhash64(doc_id), {step}), size(w) - 1, {step}L)")
    sampled = corpus.split.where(F.expr(f"pmod(xxhash64(doc_id), {step}) < size(w)")).select("w", F.explode(at).alias("i")).select(F.slice("w", F.col("i").cast("int") + 1, size).alias("k"), (F.size("w") - F.col("i")).alias("left"))
    rows = sorted(([w.encode() for w in r.k], r.left) for r in sampled.collect())
    chosen = [rows[len(rows) * i // ranges] for i in range(1, ranges)] if rows else []
    asked = corpus.spark.createDataFrame(sorted({(w.decode(),) for k, _ in chosen for w in k}), "term string")
    number = {r.term.encode(): r.term_id for r in corpus.dictionary.join(F.broadcast(asked), "term").collect()} if chosen else {}
    return sorted(b"".join(x.to_bytes(4, "big") for x in [*(number[w] for w in k), *([1] if left < size else [])]).ljust(4 * size, b"\0") for k, left in chosen)


def _grouped(chunk_docs: int):
    """The kernel for rows (doc_id, text): of each group the documents of a batch in one row, their texts compressed."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("chunk", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary()), ("bytes", pa.int64()), ("texts", pa.binary())])
        for batch in batches:
            if not batch.num_rows:
                continue
            docs = batch.column(0).to_numpy()
            order = np.argsort(docs // chunk_docs, kind="stable")
            docs, texts = docs[order], [t.encode() for t in batch.column(1).take(pa.array(order)).to_pylist()]
            chunk, sizes, rows = docs // chunk_docs, np.array([len(t) for t in texts], "<i8"), []
            cuts = [0, *(np.flatnonzero(np.diff(chunk)) + 1).tolist(), len(docs)]
            for a, b in zip(cuts, cuts[1:]):
                whole = b"".join(texts[a:b])
                rows.append((int(chunk[a]), docs[a:b].astype("<i8").tobytes(), sizes[a:b].tobytes(), len(whole), pa.compress(whole, codec="zstd", asbytes=True)))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _opened():
    """What reads the rows of a group that ``_grouped`` makes: doc_ids and texts."""

    def opened(rows):
        import numpy as np
        import pyarrow as pa

        docs, sizes = (np.frombuffer(b"".join(rows[c].to_pylist()), "<i8") for c in ("docs", "sizes"))
        data = b"".join(pa.decompress(t, decompressed_size=n, codec="zstd", asbytes=True) for t, n in zip(rows["texts"].to_pylist(), rows["bytes"].to_pylist()))
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return docs, pa.Array.from_buffers(pa.string(), len(docs), [None, pa.py_buffer(ends), pa.py_buffer(data)])

    return opened


def texts_in_groups(corpus: Corpus) -> DataFrame:
    """chunk, docs, sizes, bytes, texts (the words, joined by spaces, compressed) of the documents with words, some of a group in a row."""
    texts = corpus.split.where(F.size("w") > 0).select("doc_id", F.array_join("w", " ").alias("text"))
    return texts.mapInArrow(_grouped(CHUNK), "chunk long, docs binary, sizes binary, bytes long, texts binary")


def _read(places: list[str]):
    """The kernel of a group: n-grams (chunk, doc_id, pos, m and more, of which ``places`` are left out) with their words, cut from the texts (``texts_in_groups``)."""
    opened = _opened()

    def read(texts, found):
        import numpy as np
        import pyarrow as pa

        docs, text = opened(texts)
        whole = [t.encode() for t in text.to_pylist()]
        data = b" ".join([*whole, b""])
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 32)  # of every word
        starts = np.concatenate([[0], ends[:-1] + 1])
        sizes = [t.count(b" ") + 1 for t in whole]
        begin = dict(zip(docs.tolist(), (np.cumsum(sizes) - sizes).tolist()))
        at = np.array([begin[d] for d in found["doc_id"].to_pylist()], np.int64) + found["pos"].to_numpy()
        gram = [data[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at + found["m"].to_numpy() - 1].tolist())]
        return found.drop_columns(places).append_column("gram", pa.array(gram, pa.string())) if len(gram) else None

    def kept(texts, found):
        import pyarrow as pa

        out = read(texts, found) if texts.num_rows and found.num_rows else None
        empty = found.drop_columns(places).slice(0, 0)
        return empty.append_column("gram", pa.array([], pa.string())) if out is None else out

    return kept


def with_texts(corpus: Corpus, found: DataFrame, *columns: str) -> DataFrame:
    """m, the columns asked for, and gram, the words at (doc_id, pos), m of them; texts travel as texts, each n-gram as its place."""
    chunk = F.expr(f"doc_id div {CHUNK} - int(doc_id % {CHUNK} < 0)")  # as the kernels round, for ids of any size
    rows = found.select(chunk.alias("chunk"), "doc_id", "pos", "m", *(c for c in columns if c not in ("doc_id", "pos")))
    places = [c for c in ("chunk", "doc_id", "pos") if c not in columns]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in places)
    return texts_in_groups(corpus).groupBy("chunk").cogroup(rows.groupBy("chunk")).applyInArrow(_read(places), f"{schema}, gram string")


def numbered_texts(corpus: Corpus):
    """n_words, docs, sizes, codes of the documents with words, in groups (``_numbered``), and the most frequent words with their numbers, as they are sent."""
    spark = corpus.spark
    top = corpus.term_stats.orderBy(F.desc("cf"), "term").limit(FREQUENT).select("term").join(corpus.dictionary, "term").collect()
    frequent = spark.sparkContext.broadcast(([r.term for r in top], [r.term_id for r in top]))
    rare = corpus.split.mapInArrow(_rare(frequent, CHUNK), "chunk long, term string").join(corpus.dictionary, "term").select("chunk", "term", "term_id")
    numbered = texts_in_groups(corpus).groupBy("chunk").cogroup(rare.groupBy("chunk")).applyInArrow(_numbered(frequent), "n_words long, docs binary, sizes binary, codes binary")
    with rows_at_a_time(spark, 2 * CHUNK):
        return released(numbered, "numbered-texts"), frequent


def grams(corpus: Corpus, least: int = 2) -> DataFrame:
    """m, head (the words, packed), sp, nocc, ndoc, doc_id, pos (of one occurrence) of the right-maximal n-grams of 2 to ``LONGEST`` words that occur ``least`` times or more."""
    import numpy as np

    from .suffixes import _packed

    spark, totals = corpus.spark, corpus.totals.first()
    ranges = max(-(-int(totals.n_tokens or 0) // ROWS), 1)
    numbered, frequent = numbered_texts(corpus)
    bounds = sorted(set(quantiles(corpus, ranges, int(totals.n_tokens or 0), LONGEST + 1)))
    kinds = "part int, m long, head binary, sp long, nocc long, ndoc long, low long, high long, border boolean, doc_id long, pos long"
    first = lambda b: int.from_bytes(b[:4], "big")
    edges = [2, *sorted({first(bounds[len(bounds) * i // ROUNDS]) for i in range(1, ROUNDS)} - {2}), 1 << 32] if bounds else [2, 1 << 32]
    rounds, base = [], 0
    for low, high in zip(edges, edges[1:]):  # the shuffle files of one round are removed before the next
        own = [b for b in bounds if low <= first(b) < high]
        sent = spark.sparkContext.broadcast(np.array(own, f"S{4 * (LONGEST + 1)}"))
        pieces = numbered.mapInArrow(_cut(frequent, low, high, sent, base), "part int, n long, docs binary, piece binary")
        rounds.append(_packed(pieces.repartition(len(own) + 1, "part").groupBy("part").applyInArrow(_counted(frequent), kinds), "gram-windows"))
        base += len(own) + 1
    found = reduce(DataFrame.unionByName, rounds)
    offset, offsets = int(totals.n_docs) + 1, []
    for r in found.where("m = 0").select("part", "nocc").orderBy("part").collect():  # one row for each range
        offsets.append((r.part, offset))
        offset += r.nocc
    ranks = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    found = found.where("m > 0").join(ranks, "part").withColumn("sp", F.col("sp") + F.col("before")).drop("part", "before")
    ends = found.where("border").groupBy("m", "head").agg(
        F.min("sp").alias("sp"), F.sum("nocc").alias("nocc"), F.sum("ndoc").alias("ndoc"), F.min("low").alias("low"), F.max("high").alias("high"), F.min(F.struct("doc_id", "pos")).alias("x")
    )
    ends = ends.select("m", "head", "sp", "nocc", "ndoc", "low", "high", "x.doc_id", "x.pos")
    every = found.where("not border").drop("border").unionByName(ends)
    return every.where((F.col("nocc") >= least) & (F.col("low") < F.col("high"))).drop("low", "high")
