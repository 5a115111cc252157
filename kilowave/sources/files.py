"""Files: JSON-lines readings in and out, text out, arrival-ordered batches, and a scratch folder."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def workers_find_package(spark: SparkSession) -> None:
    """Python workers on this machine look for the package where the driver has it; on a cluster it is shipped (--py-files)."""
    here, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if here not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, (here, environment.get("PYTHONPATH"))))


def scratch(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; where that is unset, under /tmp if driver and tasks share one machine."""
    return f"{shared(spark)}/kilowave-{uuid.uuid4().hex}"


def shared(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (where or "file:///tmp/checkpoints").rstrip("/")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines as raw records: no key, the line as value, the file's time as arrival."""
    lines = spark.read.text(path)
    return lines.select(F.lit(None).cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.col("_metadata.file_modification_time").alias("timestamp"))


def write_lines(df: DataFrame, path: str, column: str = "value") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.text(path)


def write_plan(df: DataFrame, path: str) -> None:
    """The formatted physical plan as text."""
    spark = df.sparkSession
    plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    spark.createDataFrame([(plan,)], "value string").write.text(path)
