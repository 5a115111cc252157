"""The consumer's side: serialised cells, current and final views, comparisons and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import Calendar
from ..functions.scalars import cell_key, quality_label
from ..sources.schemas import CELL_VALUES

HORIZON_HOURS = 36


def serialise(cells: DataFrame) -> DataFrame:
    """(key, value): `meter|date|band` and the eight values as JSON, both binary."""
    key = cell_key(F.col("medidor_id"), F.col("fecha_local"), F.col("franja"))
    return cells.select(key.cast("binary").alias("key"), F.to_json(F.struct(*CELL_VALUES), {"ignoreNullFields": "false"}).cast("binary").alias("value"))


def split_contract(messages: DataFrame) -> DataFrame:
    """messages (key, value binary, ...) with clave and propia: three key parts, and an energy in the value."""
    key, value = F.col("key").cast("string"), F.col("value").cast("string")
    own = (F.size(F.split(key, "\\|")) == 3) & F.get_json_object(value, "$.energia_kwh").isNotNull()
    return messages.withColumn("clave", key).withColumn("texto", value).withColumn("propia", F.coalesce(own, F.lit(False)))


def latest(messages: DataFrame, key: str = "clave", order: str = "offset") -> DataFrame:
    """The last revision of each key: a partial maximum before the exchange, no window over all revisions."""
    others = [c for c in messages.columns if c != key]
    newest = messages.groupBy(key).agg(F.max_by(F.struct(*others), F.col(order)).alias("__last"))
    return newest.select(key, *(F.col(f"__last.{c}").alias(c) for c in others))


def changed(revisions: DataFrame, key: str = "clave", order: str = "offset", value: str = "texto") -> DataFrame:
    """The revisions that differ from the one before under the same key."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(order))
    return revisions.withColumn("__before", before).where(f"not (__before <=> {value})").drop("__before")


def final(cells: DataFrame, now, calendar: Calendar, horizon_hours: int = HORIZON_HOURS) -> DataFrame:
    """Cells of days that nothing can change any more: local day's end plus the horizon has passed at `now` (UTC timestamp_ntz column)."""
    end = calendar.utc((F.date_add("fecha_local", 1)).cast("timestamp_ntz")) + F.make_dt_interval(hours=F.lit(horizon_hours))
    return cells.where(end <= now)


def rows(cells: DataFrame, calendar: Calendar, rounded: bool = True) -> DataFrame:
    """The table for readers: quality label, and the error bound separation / band duration in percent (null for an unknown band)."""
    duration = None
    for name in calendar.franjas:
        duration = F.when(F.col("franja") == name, float(calendar.duration(name))) if duration is None else duration.when(F.col("franja") == name, float(calendar.duration(name)))
    bound, kwh = F.try_divide(F.col("separacion_maxima_minutos") * 100, duration), F.col("energia_kwh")
    if rounded:
        bound, kwh = F.round(bound, 1), F.round(kwh, 3)
    return cells.select("medidor_id", "fecha_local", "franja", kwh.alias("energia_kwh"), quality_label(F.col("indeterminada"), F.col("interpolada")).alias("calidad"), bound.alias("error_pct"), "minutos_cubiertos", "minutos_indeterminados")


def clock(minutes: Column) -> Column:
    """Minutes as h:mm."""
    whole = F.round(minutes, 0).cast("long")
    return F.concat(F.floor(whole / 60).cast("string"), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def board(messages: DataFrame, calendar: Calendar) -> DataFrame:
    """The dashboard's table of current cells from (clave, texto): key parts as columns, values rounded, times as h:mm, sorted by key."""
    part = lambda i: F.split("clave", "\\|")[i]
    cell = F.from_json("texto", "energia_kwh double, minutos_cubiertos double, minutos_indeterminados double, interpolada boolean, indeterminada boolean, separacion_maxima_minutos double")
    cells = messages.select(part(0).alias("medidor_id"), part(1).cast("date").alias("fecha_local"), part(2).alias("franja"), cell.alias("c")).select("medidor_id", "fecha_local", "franja", "c.*")
    out = rows(cells, calendar).withColumn("cubierto", clock(F.col("minutos_cubiertos"))).withColumn("indeterminado", clock(F.col("minutos_indeterminados")))
    return out.drop("minutos_cubiertos", "minutos_indeterminados").orderBy("medidor_id", "fecha_local", "franja")


def per_band(cells: DataFrame) -> DataFrame:
    """Energy per band, the largest first, with a bar of 28 characters for it."""
    total = cells.groupBy("franja").agg(F.round(F.sum("energia_kwh"), 3).alias("energia_kwh"), F.count("*").alias("celdas"))
    most = F.max("energia_kwh").over(Window.partitionBy(F.lit(0)))
    barred = total.withColumn("barra", F.repeat(F.lit("█"), F.when(most > 0, F.round(F.lit(28) * F.col("energia_kwh") / most, 0)).otherwise(0).cast("int")))
    return barred.orderBy(F.desc("energia_kwh"), "franja")


def trust(cells: DataFrame) -> DataFrame:
    """One row: cells by quality, total energy, widest separation."""
    label = quality_label(F.col("indeterminada"), F.col("interpolada"))
    counts = [F.count_if(label == name).alias(f"{name}s") for name in ("medida", "interpolada", "indeterminada")]
    return cells.agg(F.count("*").alias("celdas"), *counts, F.round(F.coalesce(F.sum("energia_kwh"), F.lit(0.0)), 3).alias("total_kwh"), F.coalesce(F.max("separacion_maxima_minutos"), F.lit(0.0)).alias("separacion_maxima"))


def by_reason(quarantine: DataFrame) -> DataFrame:
    """Quarantined rows per reason."""
    return quarantine.groupBy(F.coalesce("motivo", F.lit("sin motivo")).alias("motivo")).agg(F.count("*").alias("n"))


def reason_of(messages: DataFrame) -> DataFrame:
    """Reason in each quarantine message (value JSON): `sin motivo` if it has none, `json ilegible` if it can't be read."""
    text = F.col("value").cast("string")
    readable = F.try_parse_json(text).isNotNull()
    return messages.withColumn("motivo", F.when(F.coalesce(readable, F.lit(False)), F.coalesce(F.get_json_object(text, "$.motivo"), F.lit("sin motivo"))).otherwise("json ilegible"))


def compare(expected: DataFrame, actual: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Full outer comparison by key: (clave, esperado, obtenido, estado) with igual, distinto, falta or sobra."""
    both = expected.select("clave", F.col("energia_kwh").alias("esperado")).join(actual.select("clave", F.col("energia_kwh").alias("obtenido")), "clave", "full_outer")
    state = F.when(F.col("obtenido").isNull(), "falta").when(F.col("esperado").isNull(), "sobra").when(F.abs(F.col("esperado") - F.col("obtenido")) <= tolerance, "igual").otherwise("distinto")
    return both.withColumn("estado", state)


def merge(current: DataFrame, updates: DataFrame, key: str = "clave") -> DataFrame:
    """Upsert: rows of current whose key updates lacks, and updates."""
    return current.join(updates.select(key).distinct(), key, "left_anti").unionByName(updates)
