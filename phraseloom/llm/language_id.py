"""Language identification: multinomial naive Bayes over hashed character n-grams.

``train`` counts hashed 1- to 3-grams per language on a bounded, hash-chosen sample of the labelled rows
(``TRAIN_ROWS`` rows; counting runs on the executors and only languages x buckets sums come to the driver).
``predict`` broadcasts the log priors and the log-probability matrix (languages x 2**16 float32; the number of languages is checked against
``MAX_MODEL_BYTES`` before any count comes to the driver) and scores whole texts in numpy: every n-gram is one row index into the matrix and a
document's score is the sum of the rows it hits.

Defined cases: a null text, an empty text and a text without any letter give ``und`` with score 0; so does
every text when no labelled row exists.  Repeated rows are scored one by one; ties between languages go to
the one that sorts first.  A row without doc_id isn't held out.  Extra columns of the input are ignored.  Characters that aren't letters count as
one space, so runs of symbols carry no evidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import hashed_sample, in_fold, map_arrow, map_blocks, sums_by, texts_of
from .textkernel import blocks

ORDERS = (1, 2, 3)
BUCKET_BITS = 16
SMOOTHING = 0.5
TRAIN_ROWS = 8_000
MAX_MODEL_BYTES = 256 << 20
UNKNOWN = "und"
_PRIMES = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every n-gram, the n+1 borders of the documents' n-grams, and which documents have a letter."""
    texts = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), lengths)
    letter = _letters()[codes]
    has = np.zeros(len(texts), dtype=bool)
    has[owner[letter]] = True
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[:1] = True
    start = np.flatnonzero(np.diff(owner, prepend=-1))
    keep[start] = True  # the space before the first letter
    codes, owner = np.where(letter, codes, np.uint32(32))[keep], owner[keep]
    found, of = [], []
    for order in ORDERS:
        n = len(codes) - order + 1
        if n <= 0:
            continue
        mixed = np.zeros(n, dtype=np.uint32)
        for k in range(order):
            mixed = (mixed ^ codes[k : k + n]) * np.uint32(_PRIMES[k])
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        ok = owner[:n] == owner[order - 1 :]
        if order == 1:
            ok &= codes != 32
        found.append((mixed >> np.uint32(32 - BUCKET_BITS))[ok] ^ np.uint32(order * 0x5555 & 0xFFFF))
        of.append(owner[:n][ok])
    return found, of, has


def _decode(data: np.ndarray, borders: np.ndarray) -> list[str]:
    raw = data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]


def train(rows: DataFrame, most_rows: int = TRAIN_ROWS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their log priors and the log-probability matrix (buckets x languages) from the columns doc_id, text, lang."""
    rows = hashed_sample(texts_of(rows, "lang").where("lang is not null and text is not null"), most_rows)
    size = 1 << BUCKET_BITS
    most = MAX_MODEL_BYTES // (4 * size)
    share = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).collect()}
    if len(share) > most:
        raise ValueError(f"more than {most} languages need more than {MAX_MODEL_BYTES} bytes")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(2).to_pylist()
            for lo, hi, data, borders in blocks(batch.column(1)):
                found, of, _ = grams(_decode(data, borders))
                names = sorted(set(langs[lo:hi]))
                at = np.fromiter((names.index(x) for x in langs[lo:hi]), np.int64, hi - lo)
                for k, name in enumerate(names):
                    held = sums.setdefault(name, np.zeros(size, np.int64))
                    for g, o in zip(found, of):
                        held += np.bincount(g[at[o] == k], minlength=size)
        for name, held in sums.items():
            hit = np.flatnonzero(held)
            for i in range(0, len(hit), 20_000):
                part = hit[i : i + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(part), pa.array(held[part])], ["lang", "bucket", "n"])

    counted = map_arrow(rows, count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(share)
    priors = np.log(np.array([share[x] for x in langs]) / max(sum(share.values()), 1)) if langs else np.zeros(0)
    table = np.zeros((size, len(langs)))
    for k, name in enumerate(langs):
        own = counted[counted.lang == name]
        table[own.bucket.to_numpy(), k] = own.n
    table = np.log(table + SMOOTHING) - np.log(table.sum(axis=0) + SMOOTHING * size) if langs else table
    return langs, priors, table.astype(np.float32)


def predict(docs: DataFrame, langs: list[str], priors: np.ndarray, table: np.ndarray) -> DataFrame:
    """doc_id, lang_pred and score (the posterior of the chosen language)."""
    sc = docs.sparkSession.sparkContext
    model = sc.broadcast((langs, priors, [np.ascontiguousarray(table[:, k]) for k in range(len(langs))]))

    def kernel(rows, data, borders):
        names, first, columns = model.value
        found, of, has = grams(_decode(data, borders))
        n = len(borders) - 1
        if not names:
            return [rows.column(0), [UNKNOWN] * n, np.zeros(n)]
        total = np.tile(first, (n, 1))
        for g, o in zip(found, of):
            cut = np.searchsorted(o, np.arange(n + 1))
            for k, column in enumerate(columns):
                total[:, k] += sums_by(column[g].astype(np.float64), cut)
        best = total.argmax(axis=1)
        score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        return [rows.column(0), [names[b] if h else UNKNOWN for b, h in zip(best, has)], np.where(has, score, 0.0)]

    return map_blocks(texts_of(docs), kernel, "doc_id long, lang_pred string, score double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = in_fold(F.col("doc_id"), 3, 1)
    return predict(docs, *train(docs.where(~held_out))).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
