"""Small helpers for running kernels over document frames: Arrow mapping, the shared folder, stable samples."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import checkpoint_root, written
from .textkernel import blocks


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and further columns under their own names, whatever else the frame holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


_shipped: set[str] = set()


def map_arrow(frame: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package sent along, so that workers can import it wherever they start."""
    sc = frame.sparkSession.sparkContext
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        target = Path(tempfile.mkdtemp()) / f"{package.name}.zip"  # read by the driver only, which serves it to the executors
        with zipfile.ZipFile(target, "w") as out:
            for path in sorted(package.rglob("*.py")):
                out.write(path, path.relative_to(package.parent))
        sc.addPyFile(str(target))
        _shipped.add(sc.applicationId)
    return frame.mapInArrow(run, schema)


def map_blocks(docs: DataFrame, kernel: Callable, schema: str) -> DataFrame:
    """Runs ``kernel(rows, data, borders)`` on pieces of about one MB of text.

    rows is the Arrow batch of the piece, data and borders are the bytes of its texts; the kernel returns a dict or
    list of columns in the order of ``schema``.  No shuffle; memory is bounded by the Arrow batch and the longest text.
    """
    target = schema_of(docs.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, borders in blocks(batch.column(batch.schema.get_field_index("text"))):
                out = kernel(batch.slice(lo, hi - lo), data, borders)
                yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(out, target, strict=True)], schema=target)

    return map_arrow(docs, run, schema)


def filter_blocks(docs: DataFrame, keep: Callable) -> DataFrame:
    """The rows for which ``keep(data, borders)`` is true, with all columns; a frame without shuffle."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, borders in blocks(batch.column(at)):
                yield batch.slice(lo, hi - lo).filter(pa.array(keep(data, borders)))

    return map_arrow(docs, run, docs.schema)


def schema_of(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a URI; a path without a scheme is local."""
    if not urlparse(uri).scheme:
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def scanned(frame: DataFrame, name: str) -> DataFrame:
    """The frame if it reads files row by row, so that its partitions are the same in every pass, else a written copy."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    lines = [line.strip(" +-:*()0123456789") for line in plan.strip().splitlines()]
    return frame if all(line.startswith(("Project", "ColumnarToRow", "FileScan", "Filter")) for line in lines) else written(frame, name)


def write_bytes(uri: str, payload: bytes) -> None:
    """Writes beside the target and renames, so that a repeated task leaves one whole file."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(payload)
    fs.move(own, path)


def read_bytes(uri: str) -> bytes:
    fs, path = filesystem(uri)
    with fs.open_input_stream(path) as src:
        return src.read()


def in_fold(column, divisor: int, rest: int):
    """Whether the crc32 of the id, written as text, leaves ``rest``: the folds of the labelled rows.  A null id is in no fold."""
    return F.coalesce(F.crc32(F.encode(column.cast("string"), "UTF-8")) % F.lit(divisor) == rest, F.lit(False))


def hashed_sample(rows: DataFrame, most: int, seed: int = 1) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of all their columns: the same ones in every run, and no sort.  Rows without an id are told apart by their texts; rows that are equal throughout are taken together."""
    there = rows.count()
    if there <= most:
        return rows
    scale = 1 << 30
    return rows.where(F.pmod(F.xxhash64(F.lit(seed), *sorted(rows.columns)), F.lit(scale)) < int(scale * most / there))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, most: int) -> DataFrame:
    """doc_id, text and the 0/1 label of about ``most`` labelled rows.

    The labels are sampled first, so what is broadcast is bounded and no text is shuffled; the rows found are written, as they are read several times.
    """
    chosen = hashed_sample(labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias(label)).where(F.col(label).isin(0, 1)), most)
    return written(texts_of(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", label), "labelled")


def sums_by(values: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive borders; 0 for empty ranges."""
    prefix = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=prefix[1:])
    return prefix[borders[1:]] - prefix[borders[:-1]]
