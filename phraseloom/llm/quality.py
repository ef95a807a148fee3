"""Quality: a compression classifier.

Two zstandard dictionaries are trained, one on good and one on bad labelled text.  A whole text is compressed with
each; the normalised difference of the two sizes becomes a score through a logistic calibration fitted on labelled rows, which knows the text's length besides.

Bounds (parameters): ``DICT_ROWS`` rows per class (drawn by a hash of their own, so as many at every size), whose whole texts, in pieces of ``PIECE`` bytes, are the dictionary
samples, and ``FIT_ROWS`` rows for the calibration, whose size pairs only come to the driver.  Scoring reads every
whole text, without a shuffle.

Defined cases: a null or empty text gets the share of good rows in the fit; when one class has no row, or too few
bytes to make a dictionary, every text gets that share (0.5 without any label, 0 or 1 where all labels are equal).  Repeated rows get equal scores; a row without doc_id isn't held out.
Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .calibrate import Logistic, fit_logistic
from .frames import hashed_sample, in_fold, labelled_rows, map_blocks, texts_of

DICT_ROWS = 1_500
DICT_BYTES = 112_640
PIECE = 2_048
FIT_ROWS = 12_000
LEVEL = 3


def dictionary(texts: list[bytes], size: int = DICT_BYTES) -> bytes | None:
    """A zstandard dictionary of the texts, whole, in pieces; None if there is too little text."""
    samples = [s for text in texts for i in range(0, len(text), PIECE) if len(s := text[i : i + PIECE]) >= 8]
    if len(samples) < 8:
        return None
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return None


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)


def features(n: np.ndarray, good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """The size difference normalised by both sizes and by the text's length, and how either counts at different lengths."""
    length, difference = np.log1p(n), np.stack([(bad - good) / np.maximum(good + bad, 1), (bad - good) / np.maximum(n, 1)])
    return np.stack([*difference, length, *(difference * length), length * length], axis=1)


def _sizes(docs: DataFrame, dictionaries: tuple[bytes, bytes], *more: str) -> DataFrame:
    pair = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def kernel(rows, data, borders):
        good, bad = map(_compressor, pair.value)
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]
        return [rows.column(0), np.diff(borders), [len(good.compress(t)) for t in texts], [len(bad.compress(t)) for t in texts], *(rows.column(2 + i) for i in range(len(more)))]

    return map_blocks(texts_of(docs, *more), kernel, "doc_id long, n long, good long, bad long" + "".join(f", {c} int" for c in more))


class QualityModel:
    """Dictionaries and calibration; ``score`` applies them."""

    def __init__(self, dictionaries: tuple[bytes, bytes] | None, calibration: Logistic | None, share: float):
        self.dictionaries, self.calibration, self.share = dictionaries, calibration, share

    def score(self, docs: DataFrame) -> DataFrame:
        if not self.dictionaries:
            return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lit(self.share).alias("score"))
        sc = docs.sparkSession.sparkContext
        pair, fitted, share = sc.broadcast(self.dictionaries), self.calibration, self.share

        def kernel(rows, data, borders):
            good, bad = map(_compressor, pair.value)
            raw, n = data.tobytes(), np.diff(borders)
            texts = [raw[a:b] for a, b in zip(borders[:-1].tolist(), borders[1:].tolist())]
            g = np.fromiter((len(good.compress(t)) for t in texts), np.float64, len(texts))
            b = np.fromiter((len(bad.compress(t)) for t in texts), np.float64, len(texts))
            return [rows.column(0), np.where(n > 0, fitted.predict(features(n, g, b)), share)]

        return map_blocks(texts_of(docs), kernel, "doc_id long, score double")


def train(rows: DataFrame) -> QualityModel:
    """From the columns doc_id, text and quality (1 good, 0 bad)."""
    rows = texts_of(rows, F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and length(text) > 0")
    texts = {}
    for label in (0, 1):
        own = rows.where(F.col("quality") == label)
        chosen = hashed_sample(own, DICT_ROWS, seed=3).orderBy("doc_id", "text").select("text")
        texts[label] = [r["text"].encode() for r in chosen.toLocalIterator()]
    pair = dictionary(texts[1]), dictionary(texts[0])
    seen = sum(map(len, texts.values()))
    share = len(texts[1]) / seen if seen else 0.5
    if None in pair:
        return QualityModel(None, None, share)
    fit = _sizes(hashed_sample(rows, FIT_ROWS, seed=2), pair, "quality").toPandas().sort_values(["doc_id", "n"])
    x = features(*(fit[c].to_numpy(np.float64) for c in ("n", "good", "bad")))
    return QualityModel(pair, fit_logistic(x, fit.quality.to_numpy(np.float64)), float(fit.quality.mean()))


def op6_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = in_fold(F.col("doc_id"), 3, 1)
    model = train(labelled_rows(docs, labels.where(~held_out), "quality", FIT_ROWS))
    return model.score(docs).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
