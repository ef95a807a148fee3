"""The folder that driver and executors share, and tables written to it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset in local mode, a new folder that becomes the setting."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='phraseloom-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(frame: DataFrame, name: str, path: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """The frame written as Parquet (in folders by columns, if any) and read again: lineage is cut, and the files outlive an executor."""
    spark = frame.sparkSession
    path = path or f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    frame.write.partitionBy(*by).parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session with these settings, and with its own again behind the block."""
    conf = spark.conf
    before = {k: conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            conf.unset(k) if v is None else conf.set(k, v)


def rows_at_a_time(spark: SparkSession, n: int):
    """The session with at most ``n`` rows in a batch that goes to Python, for kernels whose memory follows the texts of a batch."""
    return settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": str(n)})


def dropped(frame: DataFrame, part: str = "") -> None:
    """Removes the files of a frame from ``written`` that nothing will read again: all, or those with ``part`` in their path."""
    jvm, conf = frame.sparkSession._jvm, frame.sparkSession._jsc.hadoopConfiguration()
    for name in frame.inputFiles():
        if part in name:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
            path.getFileSystem(conf).delete(path, False)


def released(frame: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """As ``written``, and the shuffle files that the write made are removed at once, not when the driver happens to collect its garbage."""
    with settings(frame.sparkSession, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}):
        return written(frame, name, by=by)


def running_total(frame: DataFrame, order: list[str], value: str, out: str, name: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows before each one in the order of ``order`` (a key).

    Rows are range-partitioned and written with their partition number; only one sum for each partition is ordered in a single task.
    """
    n = max(int(frame.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = written(frame.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), name)
    parts = ranged.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return ranged.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(F.broadcast(parts), "_part").withColumn(out, (F.col("_before") + F.col("_inside")).cast("long")).drop("_part", "_inside", "_before")
