"""The service: a source of raw records, a transform, and two sinks of messages, with checkpoint, replay and counters.

A transform takes the stream of raw records (key, value, timestamp) and gives the messages (key, value) for consumption, or a pair with
those for quarantine. The default is the chain of readings to cells; `passthrough` checks the wiring. Sources and sinks are topics or
folders; a folder's messages are written anew if a batch is repeated, so a restart leaves no message twice.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.calendar import Calendar
from .functions.scalars import cell_key
from .operators import ingest
from .operators.views import HORIZON_HOURS
from .sources.files import scratch
from .sources.settings import Settings, read_kafka, write_kafka
from .streaming import meter_day

MESSAGE = "key binary, value binary"
Sink = Callable[[DataFrame, int], None]


def folder_sink(path: str) -> Sink:
    """Messages as Parquet, a folder a batch."""
    return lambda messages, batch: messages.withColumn("lote", F.lit(batch)).write.mode("overwrite").parquet(f"{path}/parte={batch}")


def topic_sink(settings: Settings, topic: str) -> Sink:
    return lambda messages, batch: write_kafka(messages, settings, topic)


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """What a folder sink holds: (key, value, offset), the order of batches as offsets; empty if there is nothing yet."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], MESSAGE + ", offset long")
    return spark.read.schema(MESSAGE + ", lote long").option("recursiveFileLookup", "true").parquet(path).withColumnRenamed("lote", "offset")


def folder_source(spark: SparkSession, path: str, most_files: int | None = None) -> DataFrame:
    """A stream of raw records from Parquet files as they come."""
    source = spark.readStream.schema("key binary, value binary, timestamp timestamp")
    return (source.option("maxFilesPerTrigger", most_files) if most_files else source).parquet(path)


def passthrough(raw: DataFrame) -> DataFrame:
    return raw.select("key", "value")


def beyond_horizon(stamped: DataFrame, calendar: Calendar, hours: int = HORIZON_HOURS) -> DataFrame:
    """stamped with motivo `fuera_de_horizonte` for good readings that arrive when nothing can change their local day any more."""
    day = F.to_date(calendar.local(F.col("instante")))
    end = calendar.utc(F.date_add(day, 1).cast("timestamp_ntz")) + F.make_dt_interval(hours=F.lit(hours))
    arrived = F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col("timestamp").cast("timestamp_ntz"))
    return stamped.withColumn("motivo", F.coalesce("motivo", F.when(end <= arrived, "fuera_de_horizonte")))


def chain(raw: DataFrame, calendar: Calendar, perfil: str = "paridad", separar_tardias: bool = False) -> tuple[DataFrame, DataFrame]:
    """Raw records to cell messages and quarantine messages. separar_tardias: late readings go to quarantine instead of being dropped by the watermark."""
    stamped = ingest.ingest(raw.withColumn("llegada", F.unix_micros("timestamp")), perfil)
    if separar_tardias:
        stamped = beyond_horizon(stamped, calendar)
    stamped = stamped.observe("entrada", F.count("*").alias("mensajes"), F.count_if(F.col("motivo").isNotNull()).alias("cuarentena_ingreso"))
    out = meter_day.transform(meter_day.good_rows(stamped), calendar)
    key = cell_key(F.col("medidor_id"), F.col("fecha_local"), F.col("franja"))
    cells = out.where("destino = 'consumo'").select(key.cast("binary").alias("key"), F.col("celda").cast("binary").alias("value"))
    fallen = out.where("destino = 'cuarentena'").select("medidor_id", "motivo", F.lit(None).cast("string").alias("detalle"), F.col("detalle").alias("lectura"))
    return cells, ingest.quarantine_messages(fallen).unionByName(ingest.quarantine_messages(ingest.quarantine(stamped)))


def run(raw: DataFrame, transform: Callable, consumo: Sink, cuarentena: Sink | None = None, checkpoint: str | None = None) -> dict[str, int]:
    """Runs over all that the source has now, from the checkpoint on (a new one: from the beginning), and returns the counters of the run."""
    spark = raw.sparkSession
    meter_day.configure(spark)
    made = transform(raw)
    good, bad = made if isinstance(made, tuple) else (made, None)
    tagged = good.withColumn("malo", F.lit(False))
    if bad is not None:
        tagged = tagged.unionByName(bad.withColumn("malo", F.lit(True)))
    totals: Counter = Counter()

    def keep(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            sinks = [(False, consumo), (True, cuarentena)]
            for malo, sink in sinks:
                if sink:
                    sink(batch.where(F.col("malo") == malo).select("key", "value"), number)
            for r in batch.groupBy("malo").count().collect():
                totals["mensajes_cuarentena" if r.malo else "mensajes_consumo"] += r["count"]
        finally:
            batch.unpersist()

    query = tagged.writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", checkpoint or scratch(spark)).trigger(availableNow=True).start()
    query.awaitTermination()
    for p in query.recentProgress:
        observed = p.observedMetrics.get("entrada")
        if observed:  # a stream that is read by two branches is observed once in each
            totals.update({k: v for k, v in observed.asDict().items() if v})
        totals["tarde_descartadas"] += sum(o.numRowsDroppedByWatermark for o in p.stateOperators)
    return dict(totals)


def current(messages: DataFrame) -> DataFrame:
    """(clave, texto) of the last revision of each cell, without retracted ones."""
    from .operators.views import latest

    last = latest(messages.select(F.col("key").cast("string").alias("clave"), F.col("value").cast("string").alias("texto"), "offset"))
    return last.where("texto is not null").select("clave", "texto")


def replay(spark: SparkSession, raw: DataFrame, calendar: Calendar, out: str, perfil: str = "paridad") -> dict[str, int]:
    """The chain over a source from its beginning, without state, into new folders `out`/consumo and `out`/cuarentena."""
    return run(raw, partial(chain, calendar=calendar, perfil=perfil), folder_sink(f"{out}/consumo"), folder_sink(f"{out}/cuarentena"), scratch(spark))


def on_topics(spark: SparkSession, settings: Settings, calendar: Calendar) -> dict[str, int]:
    """The service between topics, its checkpoint where the settings say."""
    if not settings.checkpoint:
        raise ValueError("CHECKPOINT: falta la carpeta compartida del punto de control")
    raw = read_kafka(spark, settings, settings.topico_lecturas)
    return run(raw, partial(chain, calendar=calendar), topic_sink(settings, settings.topico_consumo), topic_sink(settings, settings.topico_cuarentena), settings.checkpoint)
