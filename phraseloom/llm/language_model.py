"""Language-model scoring with a hierarchical Pitman-Yor model of word pairs.

The restaurant of a word serves the words that follow it; all these restaurants have one parent, the restaurant of single words, whose base is uniform over the V training words and one
unknown word.  A document is its lower-cased words and an end token, which is also the context of its first word.

Seating.  What prediction needs of a seating is the number of tables t of each dish, so that is what Gibbs sampling redraws: t of a dish with c customers has probability proportional to
S_d(c, t) times the product of the weights (theta + d (other tables + j)) r at which its tables were opened, where S_d are the generalised Stirling numbers of the discount d and r is the parent's probability.
Dishes of up to ``EXACT`` customers are drawn from that distribution; of larger ones the first ``EXACT`` customers are, and the others are seated in blocks of an eighth of those seated (a binomial number
opens tables).  Every table sends one customer to the parent.  Dishes of one sweep are redrawn side by side, with the tables of their restaurant and the parent as the last sweep left them.
Discounts are n1 / (n1 + 2 n2) of each level's first counts; strengths are ``STRENGTH``.  Probabilities are averaged over ``SAMPLES`` sweeps after ``BURN_IN`` others.

Where things are:

* Each task reads whole texts, about a million tokens (a piece) at a time, and sends every bucket (a hash of the pair) its distinct pairs with their training counts, packed.
* The task of a bucket merges them and stores pairs, counts and, for each piece, the places of its pairs.  No bucket holds a whole restaurant, so a word that follows or leads a third of all
  words is spread over all of them.
* In a sweep, buckets send ranges of words the sums of tables by context and by dish; the task of a range adds them up, seats the parent's customers, and answers.  Buckets then add this
  sample's probabilities to their averages and redraw their tables.
* At last every bucket answers the pieces' requests, one probability a pair; answers lie in a file for each input partition, and a pass over the texts adds them up by document.

All files lie in the shared folder and are written whole; draws are seeded by bucket and sweep, so a repeated task writes the same.  Words are told apart by 64 bits of hash.
The input's partitions must be the same in both passes; a frame that isn't a plain file scan is written first.

Defined cases: a null text is empty (its end token only); a row without doc_id is learned from, as it is in no held-out fold; repeated rows count again; without training rows V and N are 0 and every
probability is 1; an empty table gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import released
from .frames import filesystem, in_fold, map_arrow, read_bytes, scanned, shared_folder, write_bytes
from .substring_dedup import _ipc, pack, unpack
from .textkernel import LOWER, SPACE, WORD_HASH, blocks, mix64, word_spans

BURN_IN, SAMPLES = 2, 3
STRENGTH = 1.0
EXACT = 64
PIECE = 1 << 20
#: The end token, in the place of a word's hash.
END = np.uint64(0x0E4D0E4D0E4D0E4D)


# --- packed columns ------------------------------------------------------------------------------


def planes(values: np.ndarray) -> bytes:
    """Values of a fixed width, byte plane by byte plane, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes())


def from_planes(packed: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(dtype).ravel()


def framed(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def unframed(raw: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def pack_pairs(words: np.ndarray, left: np.ndarray, right: np.ndarray) -> bytes:
    """Pairs of numbers of sorted words, in ascending order."""
    return framed([pack(words), pack(left.astype(np.uint64)), planes(right.astype(np.uint32))])


def unpack_pairs(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words, left, right = unframed(raw)
    return unpack(words), unpack(left).astype(np.int64), from_planes(right, np.uint32).astype(np.int64)


def sums(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Integer sums of values by their place; every sum is below 2^53."""
    return np.bincount(at, values, n).astype(np.int64)


# --- seating -------------------------------------------------------------------------------------


def stirling(d: float, most: int = EXACT) -> np.ndarray:
    """Logarithms of S_d(c, t): the weight of all seatings of c customers at t tables, where a customer joins a table of n with weight n - d."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 2)
        stay = np.where(t <= c, np.log(np.maximum(c - d * t, 1e-300)), -np.inf)
        out[c + 1, 1 : c + 2] = np.logaddexp(out[c, : c + 1], out[c, 1 : c + 2] + stay)
    return out


def draw_tables(c: np.ndarray, weight: np.ndarray, r: np.ndarray, d: float, table: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Tables of dishes with c customers; weight: theta + d times the other tables of the restaurant; r: the parent's probability; table: ``stirling(d)``."""
    out = np.minimum(c, 1)
    small = np.minimum(c, EXACT)
    order = np.argsort(small, kind="stable")
    for size in np.unique(small[small > 1]).tolist():
        lo, hi = np.searchsorted(small[order], [size, size + 1])
        step, t = max(1, (1 << 20) // size), np.arange(size)
        for i in range(lo, hi, step):
            of = order[i : min(i + step, hi)]
            log_w = table[size, 1 : size + 1] + np.cumsum(np.log((weight[of, None] + d * t) * r[of, None]), axis=1)
            cdf = np.cumsum(np.exp(log_w - log_w.max(axis=1, keepdims=True)), axis=1)
            out[of] = 1 + (cdf[:, :-1] < (rng.random(len(of)) * cdf[:, -1])[:, None]).sum(axis=1)
    of = np.flatnonzero(c > EXACT)
    seated = np.full(len(of), EXACT)
    while len(of):
        block = np.minimum(seated // 8, c[of] - seated)
        opens = (weight[of] + d * out[of]) * r[of]
        out[of] += rng.binomial(block, opens / (opens + seated - d * out[of]))
        seated += block
        more = seated < c[of]
        of, seated = of[more], seated[more]
    return out


def discount(n1: int, n2: int) -> float:
    return float(min(0.95, max(0.05, n1 / (n1 + 2 * n2)))) if n1 + n2 else 0.75


class Model:
    """The numbers that all tasks of a sweep share: vocabulary, tokens, the parent's customers and tables, discounts."""

    def __init__(self, terms=0, tokens=0, customers=0, tables=0, n1=0, n2=0, k1=0, k2=0):
        self.terms, self.tokens, self.customers, self.tables = (int(x or 0) for x in (terms, tokens, customers, tables))
        self.d, self.d0 = discount(n1 or 0, n2 or 0), discount(k1 or 0, k2 or 0)

    def parent(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's probability of words with so many customers and tables."""
        return (customers - self.d0 * tables + (STRENGTH + self.d0 * self.tables) / (self.terms + 1)) / (STRENGTH + self.customers)

    def child(self, c, t, context_c, context_t, r) -> np.ndarray:
        return (c - self.d * t + (STRENGTH + self.d * context_t) * r) / (STRENGTH + context_c)


# --- pieces of texts -----------------------------------------------------------------------------


class Piece:
    """Consecutive documents of a partition, up to about ``PIECE`` tokens."""

    def __init__(self):
        self.ids, self.held, self.words, self.size, self.n = [], [], [], [], 0

    def add(self, ids: pa.Array, held: np.ndarray, data: np.ndarray, borders: np.ndarray) -> None:
        data = LOWER[data]
        starts, ends, first = word_spans(data, borders, ~SPACE)
        words = WORD_HASH.words(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        self.words.append(np.insert(words, first[1:], END))
        self.size.append(np.diff(first) + 1)
        self.ids.append(ids)
        self.held.append(held)
        self.n += len(words) + len(ids)

    def close(self) -> Piece:
        self.size, self.held, words = np.concatenate(self.size), np.concatenate(self.held), np.concatenate(self.words)
        self.borders = np.concatenate([[0], np.cumsum(self.size)])
        self.distinct, place = np.unique(words, return_inverse=True)
        before = np.empty(len(place), np.int64)
        before[1:] = place[:-1]
        before[self.borders[:-1]] = np.searchsorted(self.distinct, END)
        pairs, self.pair = np.unique(before * len(self.distinct) + place, return_inverse=True)
        self.left, self.right = np.divmod(pairs, len(self.distinct))
        return self

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """The pairs in the order of their buckets, and where each bucket starts among them."""
        hashed = mix64(self.distinct[self.left] * np.uint64(0x9E3779B97F4A7C15) + self.distinct[self.right]) % np.uint64(buckets)
        order = np.argsort(hashed, kind="stable")
        return order, np.searchsorted(hashed[order], np.arange(buckets + 1))


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    piece = Piece()
    for batch in batches:
        held = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
        for lo, hi, data, borders in blocks(batch.column(1)):
            piece.add(batch.column(0).slice(lo, hi - lo), held[lo:hi], data, borders)
            if piece.n >= PIECE:
                yield piece.close()
                piece = Piece()
    if piece.ids:
        yield piece.close()


def _rows(ddl: str, rows: list[tuple]) -> pa.RecordBatch:
    types = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows), fields, strict=True)], [n for n, _ in fields])


def _by_key(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[int, list[tuple]]]:
    """(key, its rows) of batches that are sorted by that column."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[at] != key and held:
                yield key, held
                held = []
            key = row[at]
            held.append(row)
    if held:
        yield key, held


_ASKED = "part int, piece int, bucket int, pairs binary, counts binary"
_WORDS = "bucket int, range int, words binary, stats binary, n1 long, n2 long"
_PARENT = "bucket int, range int, stats binary, terms long, tokens long, customers long, tables long, n1 long, n2 long, k1 long, k2 long"
_SCORES = "part int, piece int, bucket int, scores binary, known binary"


class Trainer:
    """Counts, sweeps and scores of one frame (doc_id, text, held) and its folder."""

    def __init__(self, docs: DataFrame):
        spark = docs.sparkSession
        self.docs, self.folder = docs, shared_folder(spark, "language-model")
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        self.ranges = -(-partitions // 4)  # words are far fewer than pairs, and every bucket sends a row to every range
        self.buckets = max(partitions, 2 * docs.rdd.getNumPartitions())
        self.model = Model()

    def counted(self) -> DataFrame:
        """The pieces' pairs, merged and stored by bucket; gives the buckets' words."""
        buckets, ranges, folder = self.buckets, self.ranges, self.folder

        def send(batches):
            part = TaskContext.get().partitionId()
            for number, piece in enumerate(pieces(batches)):
                order, cuts = piece.dealt(buckets)
                learned = sums(piece.pair, np.repeat(~piece.held, piece.size), len(piece.left))
                for b in np.flatnonzero(np.diff(cuts)).tolist():
                    of = order[cuts[b] : cuts[b + 1]]
                    words, place = np.unique(np.concatenate([piece.left[of], piece.right[of]]), return_inverse=True)
                    row = part, number, b, pack_pairs(piece.distinct[words], place[: len(of)], place[len(of) :]), planes(learned[of].astype(np.uint32))
                    yield _rows(_ASKED, [row])

        def merge(batches):
            for bucket, rows in _by_key(batches, 2):
                asked = [(*unpack_pairs(r[3]), from_planes(r[4], np.uint32)) for r in rows]
                words = np.unique(np.concatenate([a[0] for a in asked]))
                codes = [np.searchsorted(words, x)[le] * len(words) + np.searchsorted(words, x)[ri] for x, le, ri, _ in asked]
                pairs, place = np.unique(np.concatenate(codes), return_inverse=True)
                c = sums(place, np.concatenate([a[3] for a in asked]), len(pairs))
                left, right = np.divmod(pairs, len(words))
                write_bytes(f"{folder}/pairs/{bucket:07d}", framed([pack_pairs(words, left, right), planes(c)]))
                ends = np.cumsum([len(x) for x in codes])
                places = [b"".join(x.to_bytes(4, "little") for x in r[:2]) + pack(place[e - len(x) : e].astype(np.uint64)) for r, x, e in zip(rows, codes, ends)]
                write_bytes(f"{folder}/asked/{bucket:07d}", framed(places))
                t = np.minimum(c, 1)  # at first every dish has one table
                write_bytes(f"{folder}/seats-0/{bucket:07d}", framed([planes(t), b""]))
                stats = [sums(left, t, len(words)), sums(right, t, len(words)), sums(left, c, len(words)), sums(right, c, len(words))]
                yield _to_ranges(bucket, words, stats, ranges, int((c == 1).sum()), int((c == 2).sum()))

        sent = map_arrow(self.docs, send, _ASKED).repartitionById(buckets, "bucket").sortWithinPartitions("bucket", "part", "piece")
        return map_arrow(sent, merge, _WORDS)

    def swept(self, parent: DataFrame, number: int) -> DataFrame:
        """Adds the probabilities of the last sweep (after the burn-in) and redraws the tables of every bucket; gives the buckets' words."""
        model, folder, ranges = self.model, self.folder, self.ranges

        def sweep(batches):
            for bucket, rows in _by_key(batches, 0):
                state = Bucket(folder, bucket, number, rows, model)
                rng = np.random.default_rng([bucket, number])
                many = np.flatnonzero(state.c > 1)
                t, of, to = state.t.copy(), state.left[many], state.right[many]
                weight = STRENGTH + model.d * np.maximum(state.context_t[of] - t[many], 0)
                t[many] = draw_tables(state.c[many], weight, state.r[to], model.d, stirling(model.d), rng)
                mean = state.summed() if number > BURN_IN + 1 else None
                write_bytes(f"{folder}/seats-{number}/{bucket:07d}", framed([planes(t), b"" if mean is None else planes(mean)]))
                n = len(state.words)
                yield _to_ranges(bucket, state.words, [sums(state.left, t, n), sums(state.right, t, n)], ranges, 0, 0)

        return map_arrow(parent.repartitionById(self.buckets, "bucket").sortWithinPartitions("bucket", "range"), sweep, _WORDS)

    def seated(self, words: DataFrame, number: int) -> DataFrame:
        """The parent's customers of each word, seated; written, with the sums that make the next ``model``."""
        model, folder = self.model, self.folder

        def seat(batches):
            for range_, rows in _by_key(batches, 1):
                sent = [unpack(r[2]) for r in rows]
                words, place = np.unique(np.concatenate(sent), return_inverse=True)
                stats = [unframed(r[3]) for r in rows]
                total = [sums(place, np.concatenate([from_planes(s[i], np.int64) for s in stats]), len(words)) for i in range(len(stats[0]))]
                context_t, k = total[:2]
                if number:
                    rng, table = np.random.default_rng([range_, number, 0]), stirling(model.d0)
                    t = draw_tables(k, np.full(len(k), STRENGTH + model.d0 * model.tables), np.full(len(k), 1.0 / (model.terms + 1)), model.d0, table, rng)
                else:
                    t = np.minimum(k, 1)
                answer = [k, t, context_t, *total[2:]]
                tail = [int((total[3] > 0).sum()), int(total[3].sum())] if not number else [0, 0]
                tail += [int(k.sum()), int(t.sum()), sum(r[4] for r in rows), sum(r[5] for r in rows), int((k == 1).sum()), int((k == 2).sum())]
                ends, out = np.cumsum([len(s) for s in sent]), []
                for i, (row, x, e) in enumerate(zip(rows, sent, ends)):
                    of = place[e - len(x) : e]
                    out.append((row[0], range_, framed([planes(a[of]) for a in answer]), *(tail if not i else [0] * 8)))
                yield _rows(_PARENT, out)

        dealt = words.repartitionById(self.ranges, "range").sortWithinPartitions("range", "bucket")
        parent = released(map_arrow(dealt, seat, _PARENT), "parent")
        names = [f.split()[0] for f in _PARENT.split(", ")[3:]]
        found = parent.agg(*(F.sum(n).alias(n) for n in names)).first().asDict()
        if number:
            self.model.customers, self.model.tables = int(found["customers"] or 0), int(found["tables"] or 0)
            remove(f"{folder}/seats-{number - 1}")
        else:
            self.model = Model(**found)
        return parent

    def trained(self) -> DataFrame:
        parent = self.seated(self.counted(), 0)
        for number in range(1, BURN_IN + SAMPLES + 1):
            last, parent = parent, self.seated(self.swept(parent, number), number)
            for path in {f.rpartition("/")[0] for f in last.inputFiles()}:  # the sweep has used it up
                remove(path)
        return parent

    def answered(self, parent: DataFrame) -> str:
        """The pieces' requests answered, one file for each input partition; gives their folder."""
        model, folder, sweeps = self.model, self.folder, BURN_IN + SAMPLES

        def answer(batches):
            for bucket, rows in _by_key(batches, 0):
                state = Bucket(folder, bucket, sweeps + 1, rows, model)
                score, known = np.log10(state.summed() / SAMPLES).astype(np.float32), state.tokens[state.right]
                for raw in unframed(read_bytes(f"{folder}/asked/{bucket:07d}")):
                    part, piece = (int.from_bytes(raw[i : i + 4], "little") for i in (0, 4))
                    at = unpack(raw[8:]).astype(np.int64)
                    yield _rows(_SCORES, [(part, piece, bucket, planes(score[at]), planes(known[at]))])

        def keep(batches):
            n = 0
            for part, rows in _by_key(batches, 0):
                write_bytes(f"{folder}/scores/{part:07d}", _ipc([_rows(_SCORES, rows)]))
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

        dealt = parent.repartitionById(self.buckets, "bucket").sortWithinPartitions("bucket", "range")
        dealt = map_arrow(dealt, answer, _SCORES).repartition("part").sortWithinPartitions("part", "piece", "bucket")
        released(map_arrow(dealt, keep, "n long"), "kept")
        return f"{folder}/scores"

    def scored(self, scores: str) -> DataFrame:
        buckets, model = self.buckets, self.model
        ddl = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

        def add_up(batches):
            path, found = f"{scores}/{TaskContext.get().partitionId():07d}", {}
            if filesystem(path)[0].get_file_info(filesystem(path)[1]).is_file:
                for row in zip(*(c.to_pylist() for c in pa.ipc.open_stream(pa.BufferReader(read_bytes(path))).read_all().columns)):
                    found.setdefault(row[1], []).append(row)
            for number, piece in enumerate(pieces(batches)):
                rows, (order, cuts) = found.pop(number, []), piece.dealt(buckets)
                score, known = (np.concatenate([from_planes(r[i], t) for r in rows]) for i, t in ((3, np.float32), (4, np.int64)))
                if [r[2] for r in rows] != np.flatnonzero(np.diff(cuts)).tolist() or len(score) != len(order):
                    raise RuntimeError("the input's partitions changed between two passes")
                of = np.empty(len(order), np.int64)
                of[order] = np.arange(len(order))
                of = of[piece.pair]
                by_doc = lambda x: np.add.reduceat(x, piece.borders[:-1])
                base = np.log10((known[of] + 1) / (model.tokens + model.terms + 1))
                columns = [pa.concat_arrays(piece.ids), pa.array(piece.held), pa.array(piece.size), pa.array(by_doc((known[of] > 0).astype(np.int64)))]
                columns += [pa.array(np.full(len(piece.size), model.tokens)), pa.array(by_doc(base)), pa.array(by_doc(score[of].astype(np.float64)))]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in ddl.split(", ")])

        return map_arrow(self.docs, add_up, ddl)


class Bucket:
    """Pairs of a bucket, their counts and tables, and what the parent answered about their words."""

    def __init__(self, folder: str, bucket: int, number: int, rows: list[tuple], model: Model):
        pairs, c = unframed(read_bytes(f"{folder}/pairs/{bucket:07d}"))
        self.words, self.left, self.right = unpack_pairs(pairs)
        self.c = from_planes(c, np.int64)
        t, self.mean = unframed(read_bytes(f"{folder}/seats-{number - 1}/{bucket:07d}"))
        self.t, self.model = from_planes(t, np.int64), model
        stats = [np.concatenate(x) for x in zip(*([from_planes(p, np.int64) for p in unframed(r[2])] for r in rows))]
        k, tables, self.context_t = stats[:3]
        self.r = model.parent(k, tables)
        path = f"{folder}/words/{bucket:07d}"
        if len(stats) > 3:  # what doesn't change any more: customers of each context, and tokens of each word
            self.context_c, self.tokens = stats[3:]
            write_bytes(path, framed([planes(x) for x in stats[3:]]))
        else:
            self.context_c, self.tokens = (from_planes(x, np.int64) for x in unframed(read_bytes(path)))

    def summed(self) -> np.ndarray:
        """The probabilities of this sample's seating, added to those of earlier ones."""
        p = self.model.child(self.c, self.t, self.context_c[self.left], self.context_t[self.left], self.r[self.right]).astype(np.float32)
        return p + from_planes(self.mean, np.float32) if self.mean else p


def _to_ranges(bucket: int, words: np.ndarray, stats: list[np.ndarray], ranges: int, n1: int, n2: int) -> pa.RecordBatch:
    """A row for each range of the hash space with its words and their sums."""
    cuts = np.searchsorted(words, np.array([-(-(b << 64) // ranges) for b in range(1, ranges)], np.uint64)) if ranges > 1 else np.zeros(0, np.int64)
    cuts, rows = np.concatenate([[0], cuts, [len(words)]]), []
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        of = slice(cuts[b], cuts[b + 1])
        rows.append((bucket, b, pack(words[of]), framed([planes(s[of]) for s in stats]), *((n1, n2) if not rows else (0, 0))))
    return _rows(_WORDS, rows)


def remove(uri: str) -> None:
    fs, path = filesystem(uri)
    if fs.get_file_info(path).type.name != "NotFound":
        fs.delete_dir(path)


def score_texts(docs: DataFrame, held_out) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; learned from the rows where the column ``held_out`` is false."""
    text = F.col("text").cast("string").alias("text")
    trainer = Trainer(scanned(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text, held_out.alias("held")), "texts"))
    return trainer.scored(trainer.answered(trainer.trained()))


def op13_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, in_fold(docs["doc_id"], 7, 2))
