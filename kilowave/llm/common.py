"""Shared plumbing: materialised tables, bounded Arrow slices, connected components."""

from __future__ import annotations

import contextlib
import gc
import os
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python operator holds as numpy arrays at a time (one longer text is a slice of its own).
SLICE_BYTES = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a folder for tests where that is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file:///tmp/checkpoints"
    return where.rstrip("/")


def materialise(df: DataFrame, made: list[DataFrame] | None = None) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back, which cuts lineage and survives lost executors. made: gets the table.

    The files go by discard(), or when the driver's file system object closes.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kilowave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    if made is not None:
        made.append(out)
    _drop_shuffles(spark)
    return out


def _drop_shuffles(spark: SparkSession) -> None:
    """Spark drops the shuffle files of a finished job once the driver has collected what refers to them: Python's plans, listeners' events, what the session keeps of its last query."""
    gc.collect()
    spark.range(0, 1, 1, 1).collect()
    with contextlib.suppress(Py4JJavaError):  # listeners that lag behind only let the files stay until the next time
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(2_000)
    spark.sparkContext._jvm.System.gc()


def discard(*tables: DataFrame) -> None:
    """Delete tables of materialise() that nothing reads any more: all that came from them has been written since."""
    for table in tables:
        spark = table.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._written)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: What makes a Python worker give memory back instead of keeping the most it ever had: settings of the C library and of Arrow.
WORKER_MEMORY = {"MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "MALLOC_TRIM_THRESHOLD_": str(16 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, so that a run of very long texts does not fill a Python worker; let workers on this machine find the package.

    This changes the session's two Arrow batch settings, and the environment of Python workers begun later, for good.
    """
    here = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    if here not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (here, environment.get("PYTHONPATH"))))
    for name, value in WORKER_MEMORY.items():
        environment.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches to row runs whose texts hold at most `limit` bytes, or a single longer text."""
    for batch in batches:
        sizes = batch.column(column).cast(pa.large_string())
        lens = pa.compute.fill_null(pa.compute.binary_length(sizes), 0).to_pylist()
        lo = held = 0
        for i, n in enumerate(lens):
            if i > lo and held + n > limit:
                yield batch.slice(lo, i - lo)
                lo, held = i, 0
            held += n
        if lo < len(lens):
            yield batch.slice(lo)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _fingerprint(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """Smallest reachable node of every node that has an edge: (node, root).

    edges: (u, v) longs, any direction, repeats and loops allowed. Alternating large-star and
    small-star rounds, each written to the shared folder in place of the one before; a round is two aggregations and two
    equi-joins, and no node's neighbours are ever gathered into one row. When this returns, edges is needed no more.
    """
    e = materialise(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _fingerprint(e)
    for _ in range(most_rounds):
        if not seen[0]:
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "w")
        small = large.join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        before, e = e, materialise(small.unionByName(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct())
        now = _fingerprint(e)
        discard(before)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
