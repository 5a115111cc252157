"""The core: deduplicate, difference, split over the calendar, sum to cells.

One hash exchange on (medidor_id, fecha_local) serves dedup and difference; the cells' aggregation adds the band and
combines before its own exchange. The two local-day windows mean no state spans midnight unless `cruzar_medianoche` is set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import DAY, Calendar
from ..functions.scalars import micros_between
from .ingest import with_day

MINUTE = 60_000_000


#: What arrival order goes by, as far as readings have it: time of arrival, place in the log, then the row's own values, so that ties give one answer.
ARRIVAL = ("llegada", "particion", "desplazamiento", "valor", "cabina_id")


def _arrivals(readings: DataFrame, arrival: tuple[str, ...]):
    order = arrival or [c for c in ARRIVAL if c in readings.columns]
    return Window.partitionBy("medidor_id", "fecha_local", "instante").orderBy(*(F.col(c).asc_nulls_last() for c in order))


def deduplicate(readings: DataFrame, *arrival: str) -> DataFrame:
    """One reading per meter, local day and instant: the first to arrive. readings: with fecha_local."""
    return readings.withColumn("__n", F.row_number().over(_arrivals(readings, arrival))).where("__n = 1").drop("__n")


def divergent_duplicates(readings: DataFrame, *arrival: str) -> DataFrame:
    """Later arrivals whose value differs from the first's: the contract profile's `duplicado_divergente`."""
    w = _arrivals(readings, arrival)
    first = F.first("valor").over(w)
    return readings.withColumn("__n", F.row_number().over(w)).withColumn("__first", first).where("__n > 1 and not (valor <=> __first)").drop("__n", "__first")


def difference(readings: DataFrame, cruzar_medianoche: bool = False) -> DataFrame:
    """Intervals between neighbouring readings: (medidor_id, cabina_id, desde, hasta, valor_desde, valor_hasta, energia_kwh, separacion_us, motivo).

    The cabinet is the right reading's. A counter that falls gives motivo `contador_retrocede`.
    """
    keys = ["medidor_id"] if cruzar_medianoche else ["medidor_id", "fecha_local"]
    w = Window.partitionBy(*keys).orderBy("instante")
    right = [F.lead(c).over(w).alias(a) for c, a in (("instante", "hasta"), ("valor", "valor_hasta"), ("cabina_id", "cabina_id"))]
    pairs = readings.select("medidor_id", "fecha_local", F.col("instante").alias("desde"), F.col("valor").alias("valor_desde"), *right).where("hasta is not null")
    energy = F.col("valor_hasta") - F.col("valor_desde")
    return pairs.select(
        "medidor_id", "cabina_id", "fecha_local", "desde", "hasta", "valor_desde", "valor_hasta",
        energy.alias("energia_kwh"), micros_between(F.col("desde"), F.col("hasta")).alias("separacion_us"), F.when(energy < 0, "contador_retrocede").alias("motivo"),
    )


def jumps(intervals: DataFrame, salto_maximo_kw: float) -> DataFrame:
    """Intervals whose mean power exceeds a limit get motivo `salto_imposible`."""
    power = F.col("energia_kwh").cast("double") / (F.col("separacion_us") / F.lit(60.0 * MINUTE))
    return intervals.withColumn("motivo", F.coalesce(F.col("motivo"), F.when(power > salto_maximo_kw, "salto_imposible")))


def rounded(intervals: DataFrame, decimals_kwh: int = 3, decimals_minutes: int = 2) -> DataFrame:
    """Intervals as they are shown: (medidor_id, cabina_id, desde, hasta, energia_kwh, separacion_minutos), rounded."""
    minutes = F.col("separacion_us") / F.lit(float(MINUTE))
    return intervals.select("medidor_id", "cabina_id", "desde", "hasta", F.round(F.col("energia_kwh").cast("double"), decimals_kwh).alias("energia_kwh"), F.round(minutes, decimals_minutes).alias("separacion_minutos"))


def split(intervals: DataFrame, calendar: Calendar) -> DataFrame:
    """Parts of each interval by local day and band: (..., fecha_local, franja, parte_us, parte_kwh, interpolada)."""
    lo, hi = calendar.local(F.col("desde")), calendar.local(F.col("hasta"))
    days = F.sequence(F.to_date(lo), F.to_date(hi - F.make_dt_interval(secs=F.lit(0.000001))))
    dated = intervals.drop("fecha_local").withColumn("fecha_local", F.explode(days))
    ranged = dated.select("*", F.inline(calendar.literal()).alias("franja", "r_desde", "r_hasta"))
    midnight = F.col("fecha_local").cast("timestamp_ntz")
    edge = lambda minute: calendar.utc(midnight + F.make_dt_interval(mins=minute))
    start, end = F.greatest(F.col("desde"), edge(F.col("r_desde"))), F.least(F.col("hasta"), edge(F.col("r_hasta")))
    parts = ranged.withColumn("parte_us", micros_between(start, end)).where("parte_us > 0")
    share = F.col("energia_kwh").cast("double") * F.col("parte_us") / F.col("separacion_us")
    return parts.select("medidor_id", "cabina_id", "desde", "hasta", "separacion_us", "fecha_local", "franja", "parte_us", share.alias("parte_kwh"), (F.col("parte_us") < F.col("separacion_us")).alias("interpolada"))


def undetermined(threshold: float) -> Column:
    """A part that was cut out of an interval longer than the threshold in minutes."""
    return F.col("interpolada") & (F.col("separacion_us") > F.lit(int(threshold * MINUTE)))


def aggregate(parts: DataFrame, threshold: float) -> DataFrame:
    """Cells of the parts: energy and minutes measured, minutes undetermined, and how far to trust them."""
    unknown = undetermined(threshold)
    known = ~unknown
    minutes = lambda which: F.coalesce(F.sum(F.when(which, F.col("parte_us"))), F.lit(0)) / F.lit(float(MINUTE))
    return parts.groupBy("medidor_id", "fecha_local", "franja").agg(
        F.round(F.coalesce(F.sum(F.when(known, F.col("parte_kwh"))), F.lit(0.0)), 6).alias("energia_kwh"),
        minutes(known).alias("minutos_cubiertos"),
        minutes(unknown).alias("minutos_indeterminados"),
        F.coalesce(F.bool_or(F.when(known, F.col("interpolada"))), F.lit(False)).alias("interpolada"),
        F.bool_or(unknown).alias("indeterminada"),
        (F.max("separacion_us") / F.lit(float(MINUTE))).alias("separacion_maxima_minutos"),
        F.coalesce(F.max_by(F.nullif(F.col("cabina_id"), F.lit("")), F.when(F.col("cabina_id") != "", F.struct("hasta", "desde"))), F.lit("")).alias("cabina_id"),
        F.count_if(known).alias("intervalos_usados"),
    )


def cells(readings: DataFrame, calendar: Calendar, threshold: float | None = None, cruzar_medianoche: bool = False, salto_maximo_kw: float | None = None) -> DataFrame:
    """Readings (medidor_id, cabina_id, instante, valor, llegada) to cells."""
    once = deduplicate(with_day(readings, calendar)).where("valor is not null")
    intervals = difference(once, cruzar_medianoche)
    if salto_maximo_kw is not None:
        intervals = jumps(intervals, salto_maximo_kw)
    return aggregate(split(intervals.where("motivo is null"), calendar), calendar.separacion_maxima if threshold is None else threshold)


def with_arrival(raw: DataFrame) -> DataFrame:
    """raw with llegada and, of a log's records, particion and desplazamiento."""
    out = raw.withColumn("llegada", F.unix_micros("timestamp"))
    for name, own in (("partition", "particion"), ("offset", "desplazamiento")):
        if name in raw.columns:
            out = out.withColumn(own, F.col(name))
    return out


def counters(raw: DataFrame, calendar: Calendar, threshold: float | None = None) -> DataFrame:
    """One row: messages, quarantined rows, duplicates dropped, intervals, cells and undetermined cells of a batch of raw records.

    The records are parsed once and shuffled once: rows in quarantine, dealt by a hash of their payload, go along with the readings.
    """
    from .ingest import ingest

    stamped = with_day(ingest(with_arrival(raw)), calendar)
    bad = F.col("motivo").isNotNull()
    group = F.when(bad, F.concat(F.lit("?"), F.coalesce(F.xxhash64("value"), F.lit(0)).cast("string"))).otherwise(F.col("medidor_id"))
    order = [c for c in ARRIVAL if c in stamped.columns]
    rows = stamped.select(group.alias("medidor_id"), "fecha_local", "instante", *order, bad.alias("malo"))
    keys = ["medidor_id", "fecha_local"]
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(*keys, "instante").orderBy(*(F.col(c).asc_nulls_last() for c in order))))
    rows = rows.withColumn("repetido", ~F.col("malo") & (F.col("n") > 1)).withColumn("util", ~F.col("malo") & (F.col("n") == 1) & F.col("valor").isNotNull())
    line = Window.partitionBy(*keys).orderBy(F.desc("util"), "instante")
    ahead = F.lead(F.struct("util", "instante", "valor")).over(line)
    rows = rows.withColumn("sig", ahead).withColumn("par", F.col("util") & F.coalesce(F.col("sig.util"), F.lit(False)))
    rows = rows.withColumn("cae", F.col("par") & (F.col("sig.valor") < F.col("valor")))
    midnight, a, b = F.col("fecha_local").cast("timestamp_ntz"), F.col("instante"), F.col("sig.instante")
    edge = lambda minute: calendar.utc(midnight + F.make_dt_interval(mins=minute))
    part = lambda r: F.struct(r["franja"].alias("franja"), micros_between(F.greatest(a, edge(r["desde"])), F.least(b, edge(r["hasta"]))).alias("us"))
    parts = F.filter(F.transform(calendar.literal(), part), lambda p: p["us"] > 0)
    whole = micros_between(a, b)
    limit = int((calendar.separacion_maxima if threshold is None else threshold) * MINUTE)
    cut = rows.select(*keys, "malo", "repetido", "util", "par", "cae", whole.alias("sep"), F.posexplode_outer(F.when(F.col("par") & ~F.col("cae"), parts)).alias("k", "p"))
    head = F.coalesce(F.col("k") == 0, F.lit(True))
    count = lambda which, name: F.count_if(head & which).alias(name)
    per_cell = cut.groupBy(*keys, F.col("p.franja").alias("franja")).agg(
        count(F.lit(True), "mensajes"), count(F.col("malo") | ~F.col("malo") & ~F.col("repetido") & ~F.col("util") | F.col("cae"), "cuarentena_total"), count(F.col("repetido"), "duplicados_descartados"),
        count(F.col("par") & ~F.col("cae"), "consumos_emitidos"), F.max(F.col("p").isNotNull().cast("int")).alias("celdas_emitidas"),
        F.max(F.coalesce((F.col("p.us") < F.col("sep")) & (F.col("sep") > limit), F.lit(False)).cast("int")).alias("celdas_indeterminadas"),
    )
    return per_cell.agg(*(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in per_cell.columns[3:]))


def chain(raw: DataFrame, calendar: Calendar, perfil: str = "paridad", cruzar_medianoche: bool = False) -> tuple[DataFrame, DataFrame]:
    """Raw records to (cells, quarantine); quarantine: (medidor_id, motivo, detalle, lectura)."""
    from .ingest import good, ingest, quarantine

    stamped = ingest(with_arrival(raw), perfil)
    readings = with_day(good(stamped).select("medidor_id", "cabina_id", "instante", "valor", *(c for c in ARRIVAL[:3] if c in stamped.columns), "lectura"), calendar)
    once = deduplicate(readings)
    useless = once.where("valor is null").select("medidor_id", F.lit("sin_registro_util").alias("motivo"), F.lit(None).cast("string").alias("detalle"), F.to_json(F.col("lectura").dropFields("_corrupt")).alias("lectura"))
    intervals = difference(once.where("valor is not null"), cruzar_medianoche)
    fallen = F.to_json(F.struct("medidor_id", "desde", "hasta", "valor_desde", "valor_hasta"))
    backward = intervals.where("motivo is not null").select("medidor_id", "motivo", F.lit(None).cast("string").alias("detalle"), fallen.alias("lectura"))
    out = quarantine(stamped).unionByName(useless).unionByName(backward)
    if perfil == "contrato":
        twice = divergent_duplicates(readings).select("medidor_id", F.lit("duplicado_divergente").alias("motivo"), F.lit(None).cast("string").alias("detalle"), F.to_json(F.col("lectura").dropFields("_corrupt")).alias("lectura"))
        out = out.unionByName(twice)
    return aggregate(split(intervals.where("motivo is null"), calendar), calendar.separacion_maxima), out
