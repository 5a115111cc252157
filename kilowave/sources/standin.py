"""Meter readings made from the table `events`, with deterministic faults; the same arithmetic is in SQL beside it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import epoch_micros

#: SQL of the readings, as common table expression r.
READINGS_SQL = """r AS (
  SELECT event_id, 'MED-' || lpad(CAST(user_id % 10 AS VARCHAR), 4, '0') AS medidor_id, 'CAB-' || CAST((user_id % 10) % 3 AS VARCHAR) AS cabina_id,
         ts AS instante, ts - INTERVAL 3 HOUR AS local, CAST(ts - INTERVAL 3 HOUR AS DATE) AS fecha_local, event_id AS llegada,
         1000 + sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS valor
  FROM events)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, medidor_id, cabina_id, instante, valor, llegada) of every event."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp_ntz").alias("instante"), (F.col("user_id") % 10).alias("m"), F.col("value").cast("decimal(18,2)").alias("v"))
    total = F.sum("v").over(Window.partitionBy("m").orderBy("instante", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    return events.select(
        "event_id",
        F.concat(F.lit("MED-"), F.lpad(F.col("m").cast("string"), 4, "0")).alias("medidor_id"),
        F.concat(F.lit("CAB-"), (F.col("m") % 3).cast("string")).alias("cabina_id"),
        "instante",
        (total + F.lit(1000)).cast("decimal(28,2)").alias("valor"),
        F.col("event_id").alias("llegada"),
    )


def aligned(df: DataFrame) -> DataFrame:
    """Readings moved back to the quarter of an hour: genuine duplicates, and readings on band edges."""
    quarter = F.date_trunc("HOUR", F.col("instante")).cast("timestamp_ntz") + F.make_dt_interval(mins=(F.floor(F.minute("instante") / 15) * 15).cast("int"))
    return df.withColumn("instante", quarter)


#: event_id % k = r of each fault, first match wins; 0 modulo 50 is published twice, 0 modulo 20 two hours late.
FAULTS = (("json", 211, 0), ("sin_medidor", 223, 1), ("ayer", 227, 2), ("sin_huso", 229, 3), ("sin_registro", 233, 4), ("reseteo", 997, 0))


def fault():
    out = None
    for name, k, r in FAULTS:
        hit = F.col("event_id") % k == r
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


FAULT_SQL = "CASE " + " ".join(f"WHEN event_id % {k} = {r} THEN '{name}'" for name, k, r in FAULTS) + " END"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The readings as raw records (key, value, timestamp, event_id, falla), faults included."""
    df = readings(spark, sf_dir).withColumn("falla", fault())
    is_ = lambda name: F.coalesce(F.col("falla") == name, F.lit(False))
    iso = F.date_format("instante", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    instant = F.when(is_("ayer"), "ayer").when(is_("sin_huso"), iso).otherwise(F.concat(iso, F.lit("Z")))
    value = F.when(is_("reseteo"), F.lit("1.0")).otherwise(F.col("valor").cast("string"))
    code = F.when(is_("sin_registro"), "1.8.0").otherwise("15.8.0")
    event = F.struct(
        F.lit(1).alias("schema_version"),
        F.when(~is_("sin_medidor"), F.col("medidor_id")).alias("medidor_id"),
        "cabina_id",
        instant.alias("instante_lectura"),
        F.array(F.struct(code.alias("obis"), F.lit("acumulado").alias("naturaleza"), value.alias("valor"), F.lit("kWh").alias("unidad"))).alias("registros"),
        F.lit("ok").alias("calidad"),
    )
    body = F.when(is_("json"), "esto no es json").otherwise(F.to_json(event))
    key = F.when(is_("sin_medidor"), "").otherwise(F.col("medidor_id"))
    copies = F.explode(F.when(F.col("event_id") % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copia")
    sent = df.select("event_id", "falla", "instante", key.cast("binary").alias("key"), body.cast("binary").alias("value"), copies)
    delay = (F.when(F.col("event_id") % 20 == 0, 7200).otherwise(2) + F.col("copia") * 60).cast("long")
    return sent.select("key", "value", F.timestamp_micros(epoch_micros(F.col("instante")) + delay * 1_000_000).alias("timestamp"), "event_id", "falla", "copia")
