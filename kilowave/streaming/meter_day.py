"""The stream: one stateful operator per meter and local day, and its sinks.

State is the day's readings by instant (which is the deduplication) and the last value of each cell and each fall of the counter that went
out. A batch adds its readings and recomputes the day from the sorted set, so the answer does not depend
on the order of arrival and is the batch answer over the same readings. Changed cells go out as absolute
values; a cell that vanishes goes out empty, flagged `retirada`. A timer at the day's end on the 36-hour watermark drops the state.

Parsing and event time stay column expressions before the one exchange on (medidor_id, inicio_us).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.calendar import Calendar
from ..functions.scalars import epoch_micros
from ..operators import ingest
from ..sources.files import workers_find_package

MINUTE = 60_000_000
HORIZON = "36 hours"
OUT = "destino string, medidor_id string, fecha_local string, franja string, celda string, retirada boolean, motivo string, detalle string"


def day_cells(readings: list[tuple[int, float, str]], edges: list[tuple[str, int, int]], threshold_us: int) -> tuple[dict[str, dict], list[dict]]:
    """Cells by band, and falls of the counter, of one day's sorted (instant, value, cabinet); edges: (band, from, to) instants."""
    cells: dict[str, dict] = {}
    falls = []
    for (a, va, _), (b, vb, cabinet) in zip(readings, readings[1:], strict=False):
        if vb < va:
            falls.append({"desde_us": a, "hasta_us": b, "valor_desde": va, "valor_hasta": vb})
            continue
        for band, lo, hi in edges:
            part = min(b, hi) - max(a, lo)
            if part <= 0:
                continue
            c = cells.setdefault(band, {"kwh": 0.0, "cubiertos": 0, "indet": 0, "interpolada": False, "indeterminada": False, "sep": 0, "cabina_id": "", "usados": 0})
            cut = part < b - a
            c["sep"] = max(c["sep"], b - a)
            c["cabina_id"] = cabinet or c["cabina_id"]
            if cut and b - a > threshold_us:
                c["indeterminada"] = True
                c["indet"] += part
            else:
                c["kwh"] += (vb - va) * part / (b - a)
                c["cubiertos"] += part
                c["interpolada"] |= cut
                c["usados"] += 1
    out = {
        band: {
            "energia_kwh": round(c["kwh"], 6), "minutos_cubiertos": c["cubiertos"] / MINUTE, "minutos_indeterminados": c["indet"] / MINUTE, "interpolada": c["interpolada"],
            "indeterminada": c["indeterminada"], "separacion_maxima_minutos": c["sep"] / MINUTE, "cabina_id": c["cabina_id"], "intervalos_usados": c["usados"],
        }
        for band, c in cells.items()
    }
    return out, falls


def day_edges(calendar: Calendar, start_us: int) -> tuple[str, list[tuple[str, int, int]]]:
    """Local date, and the instants of each range of the local day that begins at start_us."""
    from datetime import datetime, timedelta
    from zoneinfo import ZoneInfo

    zone = ZoneInfo(calendar.zona)
    day = datetime.fromtimestamp(start_us / 1e6, zone).date()
    wall = datetime(day.year, day.month, day.day)
    at = lambda minute: round((wall + timedelta(minutes=minute)).replace(tzinfo=zone).timestamp() * 1e6)
    return day.isoformat(), [(r.franja, at(r.desde), at(r.hasta)) for r in calendar.rangos]


class MeterDay(StatefulProcessor):
    def __init__(self, calendar: Calendar, retractions: bool = True):
        self.calendar, self.retractions = calendar, retractions

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.readings = handle.getMapState("lecturas", "us long", "valor double, cabina_id string")
        self.sent = handle.getMapState("celdas", "franja string", "celda string")
        self.falls = handle.getMapState("retrocesos", "par string", "visto boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        meter, start = key[0], int(key[1])
        new = [r for pdf in rows for r in zip(pdf["llegada"], pdf["instante_us"], pdf["valor"], pdf["cabina_id"], pdf["lectura"], strict=True)]
        arrival = lambda r: (r[0], r[2] is None or r[2] != r[2], r[2] if r[2] == r[2] else 0, r[3] or "", r[4] or "")
        out = []
        if not self.readings.exists():
            day, edges = day_edges(self.calendar, start)
            self.handle.registerTimer(edges[-1][2] // 1000)
        for _, us, value, cabinet, text in sorted(new, key=arrival):
            if self.readings.containsKey((int(us),)):
                continue
            lost = value is None or value != value
            self.readings.updateValue((int(us),), (None if lost else float(value), cabinet or ""))
            if lost:
                out.append(("cuarentena", meter, None, None, None, False, "sin_registro_util", text))
        day, edges = day_edges(self.calendar, start)
        known = sorted((k[0], v[0], v[1]) for k, v in self.readings.iterator() if v[0] is not None)
        cells, falls = day_cells(known, edges, self.calendar.separacion_maxima * MINUTE)
        before = {k[0]: v[0] for k, v in self.sent.iterator()} if self.sent.exists() else {}
        for band, cell in cells.items():
            text = json.dumps(cell)
            if before.get(band) != text:
                self.sent.updateValue((band,), (text,))
                out.append(("consumo", meter, day, band, text, False, None, None))
        for band in before.keys() - cells.keys():
            self.sent.removeKey((band,))
            if self.retractions:
                out.append(("consumo", meter, day, band, None, True, None, None))
        for fall in falls:
            pair = f"{fall['desde_us']}|{fall['hasta_us']}"
            if not self.falls.containsKey((pair,)):
                self.falls.updateValue((pair,), (True,))
                out.append(("cuarentena", meter, day, None, None, False, "contador_retrocede", json.dumps({"medidor_id": meter} | fall)))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.readings.clear()
        self.sent.clear()
        self.falls.clear()
        yield from ()

    def close(self) -> None:
        pass


def keyed(good: DataFrame, calendar: Calendar) -> DataFrame:
    """Good stamped rows as the operator's input: watermark on event time, key (medidor_id, inicio_us)."""
    local = calendar.local(F.col("instante"))
    start = epoch_micros(calendar.utc(F.to_date(local).cast("timestamp_ntz")))
    rows = good.withColumn("evento", F.timestamp_micros(epoch_micros(F.col("instante")))).withWatermark("evento", HORIZON)
    return rows.select("medidor_id", start.alias("inicio_us"), epoch_micros(F.col("instante")).alias("instante_us"), F.col("valor").cast("double").alias("valor"), "cabina_id", "llegada", "lectura", "evento")


def transform(good: DataFrame, calendar: Calendar) -> DataFrame:
    """The stateful step over a stream of good rows (medidor_id, instante, valor, cabina_id, llegada, lectura as text)."""
    return keyed(good, calendar).groupBy("medidor_id", "inicio_us").transformWithStateInPandas(MeterDay(calendar), OUT, "Update", "EventTime")


def stream_chain(raw: DataFrame, calendar: Calendar, perfil: str = "paridad") -> DataFrame:
    """A stream of raw records to one of tagged rows (OUT): cells and what the stateful step quarantines."""
    return transform(good_rows(ingest.ingest(raw.withColumn("llegada", F.unix_micros("timestamp")), perfil)), calendar)


def good_rows(stamped: DataFrame) -> DataFrame:
    """The good ones of stamped rows, as transform takes them."""
    return ingest.good(stamped).select("medidor_id", "instante", "valor", "cabina_id", "llegada", F.to_json(F.col("lectura").dropFields("_corrupt")).alias("lectura"))


def configure(spark: SparkSession) -> None:
    """State in RocksDB. The number of shuffle partitions is fixed for the life of a checkpoint: set it before the first run."""
    workers_find_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_to_folder(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Runs a stream of tagged rows over all that is there now; each batch's rows go to `out`, overwritten if the batch is repeated."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("lote", F.lit(number)).write.mode("overwrite").parquet(f"{out}/lote={number}/")

    stream.writeStream.foreachBatch(lambda b, n: keep(b.drop("lote"), n)).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current_cells(spark: SparkSession, out: str) -> DataFrame:
    """The upserted view of a folder that run_to_folder filled: the last revision of each cell, without retracted ones."""
    rows = spark.read.schema(OUT + ", lote long").option("recursiveFileLookup", "true").parquet(out).where("destino = 'consumo'")
    last = rows.groupBy("medidor_id", "fecha_local", "franja").agg(F.max_by(F.struct("celda", "retirada"), F.col("lote")).alias("x")).where("not x.retirada")
    kinds = "energia_kwh double, minutos_cubiertos double, minutos_indeterminados double, interpolada boolean, indeterminada boolean, separacion_maxima_minutos double, cabina_id string, intervalos_usados long"
    return last.select("medidor_id", F.col("fecha_local").cast("date").alias("fecha_local"), "franja", F.from_json("x.celda", kinds).alias("c")).select("medidor_id", "fecha_local", "franja", "c.*")
