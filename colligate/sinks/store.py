"""Tables that cut the lineage of repeated work."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colligate.errors import ColligateError


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or else the one that was set
    by ``setCheckpointDir``. Only a session that runs in this process alone may have neither; it
    gets a temporary folder."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ColligateError("spark.checkpoint.dir must name a folder that all executors share")
        top = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", top)
    return top.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
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


def numbered(rows: DataFrame, *order: str | Column) -> DataFrame:
    """Adds ``row``, 0 and on in the order given. Rows are numbered within sorted partitions and
    shifted by what the earlier ones hold, so no task gets them all."""
    parts = stored(rows.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "ordered")
    part, place = F.shiftright("_m", 33), F.col("_m").bitwiseAND((1 << 33) - 1)
    # a number per partition comes to the driver and goes back as a small table
    sizes = sorted(map(tuple, parts.groupBy(part.alias("p")).count().collect()))
    shifts, total = [], 0
    for p, n in sizes:
        shifts.append((p, total))
        total += n
    before = rows.sparkSession.createDataFrame(shifts, "_p long, _before long")
    return parts.withColumn("_p", part).join(F.broadcast(before), "_p").withColumn("row", F.col("_before") + place).drop("_m", "_p", "_before")
