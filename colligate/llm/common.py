"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that an Arrow step works on at once; a longer text is worked on alone.
SLICE_BYTES = 512 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share: ``spark.checkpoint.dir``, or else the one that
    was set by ``setCheckpointDir``.

    Only a session that runs in this process alone, as in tests, may have neither; it gets a temporary folder.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", top)
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: cuts its
    lineage and survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what ``stored`` has written, once nothing that is still to be computed reads it."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.stored_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, actions hand Python at most ``rows`` rows at once."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def text_column(name: str) -> Column:
    """The text of a column as string, null as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def within_share(number: Column, wanted: int, n: int) -> Column:
    """Whether a 64-bit hash is among the smallest, which about ``wanted`` of ``n`` different ones are."""
    if n <= wanted:
        return F.lit(True)
    return number < F.lit((wanted << 64) // n - (1 << 63))


def crc32_mod(name: str, n: int) -> Column:
    """crc32 of an id written as text, modulo ``n``."""
    return F.crc32(F.col(name).cast("string").cast("binary")) % n


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts with at most ``limit`` bytes of ``column``, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        total, ends = size.cumsum(), []
        start = before = 0
        while start < batch.num_rows:
            end = max(start + 1, int(total.searchsorted(before + limit, side="right")))
            ends.append((start, end))
            before, start = int(total[end - 1]), end
        for a, b in ends:
            yield batch.slice(a, b - a)
