"""Settings from the environment, and Kafka topics; the connector itself is not installed here, so reading and writing topics stays untested."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    servidores: str = "localhost:29092"
    topico_lecturas: str = "medicion.lecturas.v1"
    topico_consumo: str = "medicion.consumo.v1"
    topico_cuarentena: str = "medicion.cuarentena.v1"
    grupo: str = "kilowave"
    calendario: str = "config/franjas.toml"
    particiones: int = 8
    checkpoint: str = ""

    @classmethod
    def from_environment(cls, env=os.environ) -> Settings:
        names = {"servidores": "KAFKA_BOOTSTRAP_SERVERS", "topico_lecturas": "TOPICO_LECTURAS", "topico_consumo": "TOPICO_CONSUMO", "topico_cuarentena": "TOPICO_CUARENTENA", "grupo": "GRUPO", "calendario": "CALENDARIO_TARIFARIO", "particiones": "PARALELISMO", "checkpoint": "CHECKPOINT"}
        found = {k: env[v] for k, v in names.items() if env.get(v)}
        if "particiones" in found:
            found["particiones"] = int(found["particiones"])
        return cls(**found)


def kafka_options(s: Settings, topic: str, reading: bool = True) -> dict[str, str]:
    if reading:
        return {"kafka.bootstrap.servers": s.servidores, "subscribe": topic, "startingOffsets": "earliest", "includeHeaders": "true", "failOnDataLoss": "false"}
    return {"kafka.bootstrap.servers": s.servidores, "topic": topic, "kafka.acks": "all", "kafka.enable.idempotence": "true", "includeHeaders": "true"}


def read_kafka(spark: SparkSession, s: Settings, topic: str, stream: bool = True, most: int | None = None) -> DataFrame:
    """A topic from its beginning: as a stream (at most so many records a batch), or as a batch up to its end (the first so many)."""
    source = (spark.readStream if stream else spark.read).format("kafka").options(**kafka_options(s, topic))
    if stream:
        return (source.option("maxOffsetsPerTrigger", str(most)) if most else source).load()
    table = source.load()
    return table.orderBy("timestamp", "partition", "offset").limit(most) if most else table


#: What the errors of a topic or broker that is not there say.
ABSENT = ("UnknownTopicOrPartition", "TimeoutException", "No resolvable bootstrap urls")


def read_topic(spark: SparkSession, s: Settings, topic: str) -> DataFrame:
    """A whole topic as a batch; an empty table if topic or broker is not there."""
    table = read_kafka(spark, s, topic, stream=False)
    try:
        table.isEmpty()
    except Exception as e:
        if not any(x in str(e) for x in ABSENT):
            raise
        return table.sparkSession.createDataFrame([], table.schema)
    return table


def offset_count(records: DataFrame) -> DataFrame:
    """Records by the log's offsets: last less first and one, summed over partitions (columns partition, offset)."""
    own = records.groupBy("partition").agg((F.max("offset") - F.min("offset") + 1).alias("n"))
    return own.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def write_kafka(messages: DataFrame, s: Settings, topic: str) -> None:
    """key, value and, if there are, headers to a topic."""
    messages.select(*(c for c in ("key", "value", "headers") if c in messages.columns)).write.format("kafka").options(**kafka_options(s, topic, reading=False)).save()


def with_headers(readings: DataFrame) -> DataFrame:
    """key, value and headers of simulated or parsed readings (lote_id, instante, value, key), for a topic of raw readings."""
    trace = F.substring(F.sha2(F.concat_ws("|", "lote_id", "instante"), 256), 1, 16)
    headers = F.array(*(F.struct(F.lit(k).alias("key"), v.cast("binary").alias("value")) for k, v in (("schema_version", F.lit("1")), ("content_type", F.lit("application/json")), ("trace_id", trace))))
    return readings.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), headers.alias("headers"))
