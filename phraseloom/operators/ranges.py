"""Places of suffixes in order without the suffix table: the first symbols of every suffix are put in order by ranges, in rounds, and only its number comes back.

As in ``windows``, a group's suffixes are sorted where its words are and travel in packed pieces, of which one round's are on disk at a time.  Equal keys are always in one range, so a suffix's number in its range and
the sizes of the ranges before it are all that is asked.  A key that fills a range of its own is dealt out over tasks, as there is nothing to sort.
"""

from __future__ import annotations

from functools import reduce
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import dropped, rows_at_a_time
from . import windows

if TYPE_CHECKING:
    from ..sources.corpus import Corpus

#: Suffixes of a range, at most and at least (there are as many ranges as cores in a round).
ROWS, FEWEST = 1 << 19, 1 << 16
#: Rounds, each with some of the ranges.
ROUNDS = 16
#: Tasks of a key that fills a range.
SALTS = 16


def _cut(frequent, depth: int, bounds, low: bool, high: bool, base: int, heavy: set[int]):
    """The kernel of a round: of numbered texts the sorted suffixes between the first and last of ``bounds`` (no end where ``low`` or ``high`` is not set), in packed pieces, one for each range."""
    shift, sort, salts = windows.FREQUENT, windows.sorter(), SALTS

    def pieces(n_words, docs, sizes, packed_codes):
        import numpy as np
        import pyarrow as pa

        raw = np.frombuffer(pa.decompress(packed_codes, decompressed_size=4 * n_words, codec="zstd", asbytes=True), np.uint8)
        codes = np.ascontiguousarray(raw.reshape(4, n_words).T).view("<u4").ravel()
        own, part = np.frombuffer(docs, "<i8"), np.frombuffer(sizes, "<i8")
        known = np.asarray([0, 0, *frequent.value[1]], np.uint32)
        ids = np.where(codes >= shift + 2, codes - np.uint32(shift), known[np.minimum(codes, len(known) - 1)]).astype(np.uint32)
        first = [int.from_bytes(bytes(b)[:4], "big") for b in bounds.value]
        kept = np.flatnonzero((ids >= (first[0] if low else 0)) & (ids <= (first[-1] if high else 0xFFFFFFFF)))
        if not len(kept):
            return
        end = np.cumsum(part)
        row = np.searchsorted(end, kept, "right")
        left, pos = end[row] - kept, kept - (end - part)[row]

        def columns(values):
            padded = np.append(values, np.zeros(depth, np.uint32))
            return [np.where(left > j, padded[kept + j], left == j).astype(np.uint32) for j in range(depth)]  # 1, the separator, behind the last word

        key = columns(ids)
        order, _ = sort(key)
        key = [k[order] for k in key]
        whole = np.stack(key, axis=1).astype(">u4").view(f"S{4 * depth}").ravel()
        cuts = np.searchsorted(whole, bounds.value).tolist() if len(bounds.value) else []
        cuts = [*([] if low else [0]), *cuts, *([] if high else [len(order)])]
        common, same = np.zeros(len(order), np.uint8), np.ones(len(order) - 1, bool)
        for k in key:
            same &= k[1:] == k[:-1]
            common[1:] += same
        sent = [k[order] for k in columns(codes)]
        row, pos = row[order], pos[order]
        for number, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if a == b:
                continue
            here = common[a:b].copy()
            here[0] = 0
            names, which = np.unique(row[a:b], return_inverse=True)
            planes = [np.where(here > j, 0, k[a:b]) for j, k in enumerate(sent)] + [pos[a:b], which]
            body = [np.ascontiguousarray(p.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for p in planes]
            piece = pa.compress(b"".join([*body, here.tobytes()]), codec="zstd", asbytes=True)
            salt = int(own[names[0]]) // 64 % salts if base + number in heavy else 0
            yield base + number, salt, b - a, own[names].astype("<i8").tobytes(), piece

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("part", pa.int32()), ("salt", pa.int32()), ("n", pa.int64()), ("docs", pa.binary()), ("piece", pa.binary())])
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("n_words", "docs", "sizes", "codes"))):
                found = list(pieces(*row))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*found), schema.types)], schema=schema)

    return run


def _numbers(frequent, depth: int, heavy: set[int]):
    """The kernel of a range: part, doc_id, pos, start (the number of the first suffix with the same key in the range) and tied of its suffixes, by document and place, which packs well."""
    shift, sort = windows.FREQUENT, windows.sorter()

    def numbers(table):
        import numpy as np
        import pyarrow as pa

        n_planes, pieces, known = depth + 2, [], np.asarray([0, 1, *frequent.value[1]], np.uint32)
        for n, docs, piece in zip(table["n"].to_pylist(), table["docs"].to_pylist(), table["piece"].to_pylist()):
            raw = np.frombuffer(pa.decompress(piece, decompressed_size=n * (4 * n_planes + 1), codec="zstd", asbytes=True), np.uint8)
            planes = [np.ascontiguousarray(raw[4 * n * j : 4 * n * (j + 1)].reshape(4, n).T).view("<u4").ravel() for j in range(n_planes)]
            here = raw[4 * n * n_planes :]
            for j in range(depth):  # what was left out is what the suffix before has
                code = planes[j][np.maximum.accumulate(np.where(here > j, 0, np.arange(n)))]
                planes[j] = np.where(code >= shift + 2, code - np.uint32(shift), known[np.minimum(code, len(known) - 1)]).astype(np.uint32)
            pieces.append([*planes[:-1], np.frombuffer(docs, "<i8")[planes[-1]]])
        *key, pos, doc = [np.concatenate(c) for c in zip(*pieces)]
        del pieces
        order, same = sort(key)
        del key
        start = np.empty(len(order), np.int64)
        start[order] = np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(len(order)), 0))
        tied = np.empty(len(order), bool)
        part = table["part"][0].as_py()
        tied[order] = np.append(False, same) | np.append(same, False) | (part in heavy)
        by = np.lexsort((pos, doc))
        columns = [pa.array(np.full(len(by), part, np.int32)), *map(pa.array, (doc[by], pos[by].astype(np.int64), start[by], tied[by]))]
        return pa.Table.from_arrays(columns, ["part", "doc_id", "pos", "start", "tied"])

    return numbers


def _rounds(corpus: Corpus, depth: int):
    """The bounds of ranges by the first ``depth`` symbols, the first and last range of each round, and the ranges that hold one key."""
    n_tokens = int(corpus.totals.first().n_tokens or 0)
    ranges = max(-(-n_tokens // ROWS), min(ROUNDS * corpus.spark.sparkContext.defaultParallelism, -(-n_tokens // FEWEST)), 1)
    found = windows.quantiles(corpus, ranges, n_tokens, depth)
    often = {b for b in found if found.count(b) > 1}
    behind = {b: (int.from_bytes(b, "big") + 1).to_bytes(4 * depth, "big") for b in often}
    bounds = sorted({*found, *behind.values()})
    heavy = {i + 1 for i, b in enumerate(bounds) if b in often}
    edges = sorted({len(bounds) * i // ROUNDS for i in range(1, ROUNDS)} - {0})
    return bounds, list(zip([0, *edges], [*edges, len(bounds) + 1])), heavy


def starts(corpus: Corpus, depth: int, columns: tuple = ("part", "doc_id", "pos", "start"), texts=None, by: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, pos, start and, if asked for, tied and more of every suffix that starts at a word: the rank of the first one with the same ``depth`` symbols, up to the end of the document, and whether there is another.

    ``texts``: what ``numbered_texts`` has given, if it is there; ``by``: columns by which the rows lie in folders.
    """
    import numpy as np

    from .suffixes import _packed

    spark, (numbered, frequent) = corpus.spark, texts or windows.numbered_texts(corpus)
    bounds, rounds, heavy = _rounds(corpus, depth)
    found = []
    for a, b in rounds:  # ranges a to b - 1; the shuffle files of one round are removed before the next
        low, high = a > 0, b <= len(bounds)
        own = spark.sparkContext.broadcast(np.array(bounds[a - low : b - 1 + high], f"S{4 * depth}"))
        pieces = numbered.mapInArrow(_cut(frequent, depth, own, low, high, a, heavy), "part int, salt int, n long, docs binary, piece binary")
        ranged = pieces.repartition(b - a + SALTS * len(heavy & set(range(a, b))), "part", "salt").groupBy("part", "salt").applyInArrow(_numbers(frequent, depth, heavy), "part int, doc_id long, pos long, start long, tied boolean")
        with rows_at_a_time(spark, 64):
            found.append(_packed(ranged.select(*columns), "suffix-starts", by))
    if not texts:
        dropped(numbered)
    every = reduce(DataFrame.unionByName, found)
    offset, offsets = int(corpus.totals.first().n_docs) + 1, []
    for r in every.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # one row for each range
        offsets.append((r.part, offset))
        offset += r.n
    ranks = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    return every.join(ranks, "part").withColumn("start", F.col("start") + F.col("before")).drop("part", "before")
