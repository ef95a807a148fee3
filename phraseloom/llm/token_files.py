"""Token-id shards with a minimal perfect hash index.

Documents are range-partitioned by doc_id, and each partition is one shard: the ids of its documents, in ascending doc_id
order, as raw little-endian integers (two bytes where the vocabulary allows, else four), followed by the index and a footer.

Shard file: ``MAGIC``, payload, then the parts named in ``PARTS``, then a JSON footer and its length in the last 8 bytes.

The index is a minimal perfect hash of the distinct keys (levels of bit arrays: a key settles on the first level on which nobody
shares its bit, and its number is the rank of that bit; the few keys left after the last level lie in a sorted list).  The slot of that
number has the key's 32-bit fingerprint, its first record and its number of records, and the record table has the token offsets:
one look-up, whatever the size of the shard.  The shard of a key is found in the manifest by its first and last keys.

Encoding: a text is cut at single spaces between two other characters.  The tokenizer never joins what stands on two sides of
such a border, so the pieces' ids, put together, are the text's ids, and a bounded memo of pieces, found by hash and compared byte by byte, saves encoding the same
piece again.  Pieces are encoded by the library; a new piece of plain letters goes straight to its BPE model, which skips what only whole texts need.

Tasks write under names of their own and only files named by the finished tasks enter the manifest, so lost executors leave no
half shard.  Defined cases: null and empty texts are just the end id; rows with equal doc_id lie side by side and their key finds all of
them; rows without doc_id come first and can't be looked up; an empty table has no shard.  Extra columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frames import filesystem, map_arrow, schema_of, shared_folder, texts_of
from .textkernel import WORD_HASH, blocks, equal_runs, mix64

MAGIC = b"TOKSHRD1"
PARTS = ("ids", "offsets", "slots", "sizes", "bits", "rest")
END_ID = 2
#: Most pieces of a memo, and about the most bytes of their texts.
MEMO, MEMO_BYTES = 400_000, 8 << 20
#: Bits a key of the levels of the minimal perfect hash, and their number.
GAMMA, LEVELS = 2.0, 24
#: A space and letters of Latin alphabets (U+0041 to U+024F, without signs), in UTF-8, up to the end of the piece, punctuation or a line break.
_LETTERS = re.compile(rb" (?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+(?=[\n!-/:-@\[-`{-~]|\Z)")
_SHOWN = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
#: The byte-level alphabet: bytes that show stand for themselves, the others are numbered from 256 on.
_ALPHABET = {b: b if b in _SHOWN else 256 + sum(c not in _SHOWN for c in range(b)) for b in range(256)}
#: Characters of the texts that are encoded together.
TOGETHER = 1 << 21
_U = np.uint64


class _Memo:
    """Ids of pieces: sorted hashes, the bytes of each piece, and runs in one array of ids."""

    def __init__(self, dtype):
        self.keys = np.zeros(0, np.uint64)
        self.start, self.length, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, dtype)
        self.place, self.size, self.text = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry of each key, -1 if there is none; and whether the entry is another piece, of equal hash."""
        if not len(self.keys):
            return np.full(len(keys), -1), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = np.flatnonzero(self.keys[at] == keys)
        found, other = np.full(len(keys), -1), np.zeros(len(keys), bool)
        own = at[hit]
        same = self.size[own] == size[hit]
        same[same] = equal_runs(self.text, self.place[own[same]], data, starts[hit[same]], size[hit[same]])
        found[hit[same]] = own[same]
        other[hit[~same]] = True
        return found, other

    def add(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, size: np.ndarray, ids: np.ndarray, length: np.ndarray) -> None:
        """Adds entries with new keys; ``ids`` holds their runs one after the other."""
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        start, place = len(self.ids) + np.cumsum(length) - length, len(self.text) + np.cumsum(size) - size
        held = (self.keys, keys), (self.start, start), (self.length, length), (self.place, place), (self.size, size)
        self.keys, self.start, self.length, self.place, self.size = (np.insert(own, at, new[order]) for own, new in held)
        self.ids = np.concatenate([self.ids, ids])
        self.text = np.concatenate([self.text, _runs(data, starts, size)])


def _runs(ids: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The runs ids[start : start + length], one after the other."""
    ends = np.cumsum(length)
    return ids[np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Texts to ids with a tokenizer given as JSON."""

    def __init__(self, tokenizer_json: str, end_id: int = END_ID, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the executor's cores have tasks of their own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.type = np.dtype("<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.end, self.most, self.hash = end_id, memo, WORD_HASH
        self.young, self.old = _Memo(self.type), _Memo(self.type)
        self.tails: dict[bytes, list[int]] = {}  # what follows the letters of a piece
        set_up = json.loads(tokenizer_json)
        split = set_up.get("pre_tokenizer") or {}
        #: A byte-level BPE that splits by the usual pattern: letters after a space are one word of its model.
        self.plain = not set_up.get("normalizer") and set_up["model"].get("type") == "BPE" and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")

    def _encode(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of pieces, by the model for a space and letters at the start of a piece, else by the whole library."""
        out, hard, tokenize, tails = [], [], self.tokenizer.model.tokenize, self.tails
        if len(tails) > self.most // 8:
            tails.clear()
        for k, piece in enumerate(pieces):
            found = self.plain and _LETTERS.match(piece)
            if not found:
                out.append(None)
                hard.append(k)
                continue
            ids = [t.id for t in tokenize(found[0].decode("latin-1").translate(_ALPHABET))]
            if tail := piece[found.end() :]:
                if tail not in tails:
                    tails[tail] = self.tokenizer.encode(tail.decode("utf-8"), add_special_tokens=False).ids
                ids += tails[tail]
            out.append(ids)
        for k, e in zip(hard, self.tokenizer.encode_batch_fast([pieces[k].decode("utf-8") for k in hard], add_special_tokens=False)):
            out[k] = e.ids
        return out

    def many(self, data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts between the borders, each with the end id, one after the other, and the number of each text's ids."""
        n, texts = len(data), np.flatnonzero(np.diff(borders) > 0)
        space, text_start, begins = _spaces(data), np.zeros(n + 1, bool), np.zeros(n, bool)
        text_start[borders] = True
        begins[borders[texts]] = True
        cut = np.flatnonzero(data[1:-1] == 0x20) + 1 if n > 2 else np.zeros(0, np.int64)
        begins[cut[~(space[cut - 1] | space[cut + 1] | text_start[cut] | text_start[cut + 1])]] = True  # a text's first or last character is no border
        starts = np.flatnonzero(begins)
        ends = np.append(starts[1:], n)[: len(starts)]
        owner = np.searchsorted(borders, starts, side="right") - 1
        size, raw = ends - starts, data.tobytes()
        keys = self.hash.words(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        keys, first, place = np.unique(keys, return_index=True, return_inverse=True)
        begin, long = starts[first], size[first]
        odd = size != long[place]  # pieces that are unlike another of equal hash: encoded outside the memo
        odd[~odd] = ~equal_runs(data, starts[~odd], data, begin[place[~odd]], size[~odd])

        def encoded(at, to):
            found = self._encode([raw[a:b] for a, b in zip(at.tolist(), to.tolist())])
            length = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter(chain.from_iterable(found), self.type, int(length.sum())), length

        if len(self.young.keys) + len(keys) > self.most or len(self.young.text) > MEMO_BYTES:
            self.old, self.young = self.young, _Memo(self.type)
        at, other = self.young.find(keys, data, begin, long)
        new = np.flatnonzero((at < 0) & ~other)
        if len(new):
            held, unlike = self.old.find(keys[new], data, begin[new], long[new])
            old, held = new[held >= 0], held[held >= 0]
            if len(old):
                self.young.add(keys[old], data, begin[old], long[old], _runs(self.old.ids, self.old.start[held], self.old.length[held]), self.old.length[held])
            fresh = np.setdiff1d(new, old)
            if len(fresh):
                self.young.add(keys[fresh], data, begin[fresh], long[fresh], *encoded(begin[fresh], begin[fresh] + long[fresh]))
            at[new] = np.searchsorted(self.young.keys, keys[new])
            at[at >= 0] = np.searchsorted(self.young.keys, keys[at >= 0])
        odd |= other[place]
        at = np.maximum(at, 0)[place]
        ids, begin, length = self.young.ids, self.young.start[at], self.young.length[at]
        if odd.any():
            more, n_more = encoded(starts[odd], ends[odd])
            begin[odd], length[odd] = len(ids) + np.cumsum(n_more) - n_more, n_more
            ids = np.concatenate([ids, more])
        total = np.bincount(owner, weights=length, minlength=len(borders) - 1).astype(np.int64) + 1
        out = np.full(int(total.sum()), self.end, self.type)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(total) - 1] = False
        out[keep] = _runs(ids, begin, length)
        return out, total

    def __call__(self, text: str | None) -> bytes:
        raw = np.frombuffer((text or "").encode(), np.uint8)
        return self.many(raw, np.array([0, len(raw)]))[0].tobytes()


def _spaces(data: np.ndarray) -> np.ndarray:
    """Bytes that belong to a white-space character or might."""
    space = (data <= 0x20) | (data == 0x7F)
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        three = data[np.minimum(lead[:, None] + np.arange(3), len(data) - 1)].astype(np.int64)
        two = three[:, 0] * 256 + three[:, 1]
        wide = (two == 0xC2A0) | (two == 0xC285) | (two == 0xE280) | (two == 0xE281) | (two == 0xE380) | (two == 0xE19A)
        for k in range(3):
            space[np.minimum(lead[wide] + k, len(data) - 1)] = True
    return space


def _level(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix64(keys ^ _U((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))) % _U(size)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys + _U(0x632BE59BD9B4E019)) >> _U(32)).astype("<u4")


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray, rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        ones = np.bitwise_count(bits).astype(np.int64)
        self.rank = np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        sizes, bits, left = [], [], keys
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, -(-int(GAMMA * len(left)) // 8) * 8)
            at = _level(left, level, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            bits.append(np.packbits(alone, bitorder="little"))
            left = left[~alone[at]]
        return cls(np.array(sizes, "<i8"), np.concatenate(bits) if bits else np.zeros(0, np.uint8), np.sort(left))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key; for a key outside the set some number, or -1."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for level, size in enumerate(self.sizes.tolist()):
            at = _level(keys[todo], level, size) + self.begin[level]
            byte, bit = at >> 3, (at & 7).astype(np.uint8)
            hit = (self.bits[byte] >> bit) & 1 == 1
            below = self.bits[byte[hit]] & ((1 << bit[hit].astype(np.int64)) - 1).astype(np.uint8)
            out[todo[hit]] = self.rank[byte[hit]] + np.bitwise_count(below)
            todo = todo[~hit]
            if not len(todo):
                return out
        if len(self.rest):
            at = np.minimum(np.searchsorted(self.rest, keys[todo]), len(self.rest) - 1)
            out[todo] = np.where(self.rest[at] == keys[todo], self.rank[-1] + at, -1)
        return out


_SLOT = np.dtype([("mark", "<u4"), ("n", "<u4"), ("first", "<i8")])


def _tail(ids: np.ndarray, n_null: int, lengths: np.ndarray, width: int) -> bytes:
    """Index and footer of a shard; ``ids`` ascending, without the leading rows that have none."""
    keys, first, n = np.unique(ids, return_index=True, return_counts=True)
    keys = keys.view(np.uint64)
    perfect = PerfectHash.build(keys)
    slots = np.zeros(len(keys), _SLOT)
    slots[perfect.find(keys)] = np.rec.fromarrays([fingerprints(keys), n.astype("<u4"), first + n_null], dtype=_SLOT)
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
    parts = [x.tobytes() for x in (ids.astype("<i8"), offsets, slots, perfect.sizes, perfect.bits, perfect.rest.astype("<u8"))]
    footer = json.dumps({"width": width, "n_null": n_null, "parts": [len(p) for p in parts]}).encode()
    return b"".join([*parts, footer, len(footer).to_bytes(8, "little")])


class Shard:
    """Keyed and sequential access to a shard file."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        n = int.from_bytes(self.file.read_at(8, size - 8), "little")
        footer = json.loads(self.file.read_at(n, size - 8 - n))
        at = size - 8 - n - sum(footer["parts"])
        raw = []
        for length in footer["parts"]:
            raw.append(self.file.read_at(length, at))
            at += length
        self.type = np.dtype(f"<u{footer['width']}")
        self.ids, self.offsets, self.slots = np.frombuffer(raw[0], "<i8"), np.frombuffer(raw[1], "<i8"), np.frombuffer(raw[2], _SLOT)
        self.hash = PerfectHash(np.frombuffer(raw[3], "<i8"), np.frombuffer(raw[4], np.uint8), np.frombuffer(raw[5], "<u8"))
        self.n_null = footer["n_null"]

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def tokens(self, record: int, until: int | None = None) -> np.ndarray:
        """Ids of one record, or of the records up to ``until``."""
        a, b = self.offsets[record], self.offsets[record + 1 if until is None else until]
        return np.frombuffer(self.file.read_at(int(b - a) * self.type.itemsize, len(MAGIC) + int(a) * self.type.itemsize), self.type)

    def locate(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key; -1 and 0 for keys that the shard doesn't hold."""
        keys = np.asarray(keys, np.int64).view(np.uint64)
        number = self.hash.find(keys)
        ok = number >= 0
        ok[ok] = self.slots["mark"][number[ok]] == fingerprints(keys[ok])
        first, n = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64)
        first[ok], n[ok] = self.slots["first"][number[ok]], self.slots["n"][number[ok]]
        return first, n

    def get(self, key: int) -> list[np.ndarray]:
        """The id arrays of the records with this key."""
        (first,), (n,) = self.locate(np.array([key]))
        if n and self.ids[first - self.n_null] != key:  # a foreign key with an equal fingerprint
            return []
        return [self.tokens(int(r)) for r in range(first, first + n)]


@lru_cache(maxsize=1)
def _encoder(tokenizer_json: str, end_id: int) -> Encoder:
    return Encoder(tokenizer_json, end_id)


_WRITTEN = "shard int, uri string, n_records long, n_tokens long, first_id long, last_id long"


def write_shards(docs: DataFrame, tokenizer_json: str, folder: str, end_id: int = END_ID, n_shards: int | None = None) -> list[dict]:
    """Writes the shards and the manifest; returns its entries in doc_id order, each with the number of ids before it."""
    spark = docs.sparkSession
    docs = texts_of(docs)
    n = n_shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    source = spark.sparkContext.broadcast(tokenizer_json)
    target = schema_of(spark, _WRITTEN)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(source.value, end_id)
        state = None

        def close():
            number, out, fs, path, ids, n_null, lengths = state
            out.write(_tail(np.concatenate(ids), n_null, np.concatenate(lengths), encode.type.itemsize))
            out.close()
            keys, total = np.concatenate(ids), int(sum(x.sum() for x in lengths))
            row = [number, path, sum(map(len, lengths)), total, *([int(keys[0]), int(keys[-1])] if len(keys) else [None, None])]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, target)], schema=target)

        for batch in batches:
            if not batch.num_rows:
                continue
            if state is None:
                number = TaskContext.get().partitionId()
                uri = f"{folder}/shard-{number:06d}-{uuid.uuid4().hex}"
                fs, path = filesystem(uri)
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                state = [number, fs.open_output_stream(path), fs, uri, [], 0, []]
                state[1].write(MAGIC)
            state[4].append(batch.column(0).drop_null().to_numpy())
            state[5] += batch.column(0).null_count
            for _, _, data, borders in blocks(batch.column(1), TOGETHER):
                ids, lengths = encode.many(data, borders)
                state[1].write(ids.tobytes())
                state[6].append(lengths)
        if state:
            yield close()

    dealt = docs.repartitionByRange(n, F.asc_nulls_first("doc_id")).sortWithinPartitions(F.asc_nulls_first("doc_id"))
    entries = sorted((r.asDict() for r in map_arrow(dealt, write, _WRITTEN).collect()), key=lambda r: r["shard"])  # one small row a shard
    before = 0
    for e in entries:
        e["start"], before = before, before + e["n_tokens"]
    fs, path = filesystem(f"{folder}/manifest.json")
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(json.dumps(entries).encode())
    return entries


def read_shards(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """A row for each record of the files: doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers), first_record and n_records of its key."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, first_record long, n_records long"
    target = schema_of(spark, schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                shard = Shard(uri)
                first, n = shard.locate(shard.ids)
                if not ((first <= np.arange(shard.n_null, len(shard))) & (np.arange(shard.n_null, len(shard)) < first + n)).all():
                    raise RuntimeError(f"the index of {uri} is damaged")
                pad = np.full(shard.n_null, -1)
                keys = pa.concat_arrays([pa.nulls(shard.n_null, pa.int64()), pa.array(shard.ids, pa.int64())])
                first, n = np.concatenate([pad, first]), np.concatenate([0 * pad, n])
                at = 0
                while at < len(shard):
                    end = max(at + 1, int(np.searchsorted(shard.offsets, shard.offsets[at] + (1 << 20))) - 1)
                    end = min(end, len(shard))
                    ids = shard.tokens(at, end).astype("<u4").tobytes()
                    offsets = shard.offsets[at : end + 1]
                    cut = ((offsets - offsets[0]) * 4).tolist()
                    crc = [zlib.crc32(ids[a:b]) for a, b in zip(cut[:-1], cut[1:])]
                    columns = [keys.slice(at, end - at), offsets[:-1] + start, np.diff(offsets), crc, first[at:end], n[at:end]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, target)], schema=target)
                    at = end

    listed = spark.createDataFrame([(i, e["uri"], e["start"]) for i, e in enumerate(entries)], "shard int, uri string, start long")
    return map_arrow(listed.repartitionById(max(1, len(entries)), "shard"), read, schema)


class TokenFiles:
    """Keyed access over all shards of a folder."""

    def __init__(self, folder: str):
        fs, path = filesystem(f"{folder}/manifest.json")
        with fs.open_input_stream(path) as src:
            self.entries = [e for e in json.loads(src.read()) if e["first_id"] is not None]
        self.last = [e["last_id"] for e in self.entries]
        self.open: dict[int, Shard] = {}

    def get(self, key: int) -> list[np.ndarray]:
        i = bisect_left(self.last, key)
        if i == len(self.last) or self.entries[i]["first_id"] > key:
            return []
        if i not in self.open:
            self.open[i] = Shard(self.entries[i]["uri"])
        return self.open[i].get(key)


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file's text; the driver reads it and broadcasts it."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as src:
        return src.read()


def op8_token_files(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    entries = write_shards(docs, tokenizer_json(), shared_folder(spark, "token-files"))
    return read_shards(spark, entries).select("doc_id", "start", "n_tokens", "ids_crc32")
