"""Queries over the driver's tables, and DuckDB SQL for each."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import scalars as S
from ..operators import energy, ingest, views
from ..sources import standin

CALENDAR = cal.example()
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# -- shared SQL

R = standin.READINGS_SQL
BAND = "CASE WHEN m < 420 THEN 'valle' WHEN m < 1080 THEN 'resto' WHEN m < 1320 THEN 'punta' ELSE 'resto' END"
QUARTER = "q AS (SELECT * EXCLUDE (instante, local), time_bucket(INTERVAL 15 MINUTE, instante) AS instante, time_bucket(INTERVAL 15 MINUTE, local) AS local FROM r)"
ONCE = "d AS (SELECT * FROM {src} QUALIFY row_number() OVER (PARTITION BY medidor_id, fecha_local, instante ORDER BY llegada) = 1)"
PAIRS = """p AS (
  SELECT * FROM (SELECT medidor_id, fecha_local, instante AS desde, valor AS valor_desde, local AS l_desde,
    lead(instante) OVER w AS hasta, lead(valor) OVER w AS valor_hasta, lead(cabina_id) OVER w AS cabina_id, lead(local) OVER w AS l_hasta
  FROM d WINDOW w AS (PARTITION BY {keys} ORDER BY instante)) WHERE hasta IS NOT NULL),
i AS (SELECT *, valor_hasta - valor_desde AS energia, date_diff('microsecond', desde, hasta) AS sep FROM p)"""
PARTS = """c(franja, lo, hi) AS (VALUES ('valle', 0, 420), ('resto', 420, 1080), ('punta', 1080, 1320), ('resto', 1320, 1440)),
days AS (SELECT i.* EXCLUDE (fecha_local), CAST(x AS DATE) AS fecha_local FROM (SELECT *, unnest(range(CAST(l_desde AS DATE), CAST(l_hasta - INTERVAL 1 MICROSECOND AS DATE) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS x FROM i WHERE energia >= 0) i),
parts AS (
  SELECT *, CAST(energia AS DOUBLE) * us / sep AS kwh, us < sep AS interp FROM (
    SELECT days.*, franja, date_diff('microsecond', greatest(l_desde, CAST(fecha_local AS TIMESTAMP) + lo * INTERVAL 1 MINUTE), least(l_hasta, CAST(fecha_local AS TIMESTAMP) + hi * INTERVAL 1 MINUTE)) AS us
    FROM days, c) WHERE us > 0)"""
CELLS = """cells AS (
  SELECT medidor_id, fecha_local, franja,
    round(coalesce(sum(kwh) FILTER (WHERE NOT unk), 0.0), 6) AS energia_kwh,
    coalesce(sum(us) FILTER (WHERE NOT unk), 0) / 60000000.0 AS minutos_cubiertos,
    coalesce(sum(us) FILTER (WHERE unk), 0) / 60000000.0 AS minutos_indeterminados,
    coalesce(bool_or(interp) FILTER (WHERE NOT unk), false) AS interpolada, bool_or(unk) AS indeterminada,
    max(sep) / 60000000.0 AS separacion_maxima_minutos, arg_max(cabina_id, hasta) AS cabina_id, count(*) FILTER (WHERE NOT unk) AS intervalos_usados
  FROM (SELECT *, interp AND sep > {t}::BIGINT * 60000000 AS unk FROM parts) GROUP BY ALL)"""


def chain_sql(src: str = "r", keys: str = "medidor_id, fecha_local", threshold: int = 90, quarter: bool = False) -> str:
    """WITH ... cells, from the readings."""
    steps = [R, *([QUARTER] if quarter else []), ONCE.format(src="q" if quarter else src), PAIRS.format(keys=keys), PARTS, CELLS.format(t=threshold)]
    return "WITH " + ",\n".join(steps)


def _cells(spark, sf_dir, **how) -> DataFrame:
    return energy.cells(standin.readings(spark, sf_dir), CALENDAR, **how)


def _clave(df: DataFrame) -> DataFrame:
    return df.withColumn("clave", S.cell_key(F.col("medidor_id"), F.col("fecha_local"), F.col("franja")))


def _us(name: str = "instante"):
    return S.epoch_micros(F.col(name))


def _intervals(spark, sf_dir) -> DataFrame:
    return energy.difference(energy.deduplicate(ingest.with_day(standin.readings(spark, sf_dir), CALENDAR)))


PAIRED = "WITH " + ",\n".join([R, ONCE.format(src="r"), PAIRS.format(keys="medidor_id, fecha_local")])

# -- sources, parsing, time


@query(f"WITH {R} SELECT medidor_id, cabina_id, epoch_us(instante) AS instante_us, CAST(valor AS DOUBLE) AS valor FROM r")
def leer_lecturas(spark, sf_dir):
    """The readings themselves."""
    return standin.readings(spark, sf_dir).select("medidor_id", "cabina_id", _us().alias("instante_us"), F.col("valor").cast("double").alias("valor"))


RAW_SQL = f"""{R}, x AS (SELECT *, {standin.FAULT_SQL} AS falla, unnest(CASE WHEN event_id % 50 = 0 THEN [0, 1] ELSE [0] END) AS copia,
  CASE WHEN event_id % 20 = 0 THEN 7200 ELSE 2 END AS tarda FROM r)"""


@query(f"""WITH {RAW_SQL} SELECT event_id, copia, CASE WHEN falla = 'json' THEN medidor_id WHEN falla = 'sin_medidor' THEN NULL ELSE medidor_id END AS medidor_id,
  CASE WHEN falla = 'json' THEN NULL WHEN falla = 'reseteo' THEN 1.0 WHEN falla = 'sin_registro' THEN NULL ELSE CAST(valor AS DOUBLE) END AS valor,
  CASE falla WHEN 'json' THEN 'json_invalido' WHEN 'sin_medidor' THEN 'sin_medidor_id' END AS motivo FROM x""")
def parsear_json(spark, sf_dir):
    """Raw records parsed: meter, counter and the first two reasons."""
    out = ingest.parse(standin.raw(spark, sf_dir))
    return out.select("event_id", "copia", "medidor_id", ingest.counter(F.col("lectura")).alias("valor"), "motivo")


@query(f"""WITH {RAW_SQL} SELECT event_id, copia, CASE WHEN falla IN ('json', 'sin_medidor', 'ayer') THEN NULL ELSE epoch_us(instante) END AS instante_us,
  CASE falla WHEN 'json' THEN 'json_invalido' WHEN 'sin_medidor' THEN 'sin_medidor_id' WHEN 'ayer' THEN 'instante_invalido' WHEN 'sin_huso' THEN 'instante_sin_huso' END AS motivo FROM x""")
def marcar_tiempo(spark, sf_dir):
    """Event time of raw records, or the reason there is none."""
    return ingest.stamp(ingest.parse(standin.raw(spark, sf_dir))).select("event_id", "copia", _us().alias("instante_us"), "motivo")


@query(f"WITH {R}, x AS (SELECT *, hour(local) * 60 + minute(local) AS m FROM r) SELECT event_id, fecha_local, CAST(m AS INT) AS minuto, {BAND} AS franja, CAST(CASE WHEN m < 420 THEN 420 WHEN m < 1080 THEN 1080 WHEN m < 1320 THEN 1320 ELSE 1440 END AS INT) AS borde FROM x")
def fecha_y_franja(spark, sf_dir):
    """Local date, band and next edge of each reading."""
    df = ingest.with_day(standin.readings(spark, sf_dir), CALENDAR).withColumn("minuto", S.minute_of_day(F.col("local")))
    return df.select("event_id", "fecha_local", "minuto", CALENDAR.band(F.col("minuto")).alias("franja"), CALENDAR.edge(F.col("minuto")).alias("borde"))


@query(f"WITH {R} SELECT medidor_id, fecha_local, count(*) AS lecturas, min(epoch_us(instante)) AS primera_us, epoch_us(CAST(fecha_local AS TIMESTAMP) + INTERVAL 3 HOUR) AS ventana_us FROM r GROUP BY ALL")
def ventana_diaria(spark, sf_dir):
    """Daily windows at local midnight."""
    df = standin.readings(spark, sf_dir).withColumn("t", F.timestamp_micros(_us()))
    zero = F.timestamp_micros(F.lit(0))
    w = F.window("t", "1 day", None, "3 hours")
    out = df.groupBy("medidor_id", w).agg(F.count("*").alias("lecturas"), F.min(_us()).alias("primera_us"))
    start = F.timestamp_diff("MICROSECOND", zero, F.col("window.start"))
    local = F.date_add(F.lit("1970-01-01").cast("date"), F.floor((start - F.lit(10_800_000_000)) / F.lit(86_400_000_000)).cast("int"))
    return out.select("medidor_id", local.alias("fecha_local"), "lecturas", "primera_us", start.alias("ventana_us"))


# -- core


@query("WITH " + ", ".join([R, QUARTER, ONCE.format(src="q")]) + " SELECT event_id, medidor_id, epoch_us(instante) AS instante_us FROM d")
def dedup_lecturas(spark, sf_dir):
    """First arrival of each instant, on readings moved to quarters of an hour."""
    df = ingest.with_day(standin.aligned(standin.readings(spark, sf_dir)), CALENDAR)
    return energy.deduplicate(df).select("event_id", "medidor_id", _us().alias("instante_us"))


INTERVAL_OUT = "medidor_id, cabina_id, fecha_local, epoch_us(desde) AS desde_us, epoch_us(hasta) AS hasta_us, CAST(energia AS DOUBLE) AS energia_kwh, sep AS separacion_us"


def _interval_out(df):
    return df.select("medidor_id", "cabina_id", "fecha_local", _us("desde").alias("desde_us"), _us("hasta").alias("hasta_us"), F.col("energia_kwh").cast("double").alias("energia_kwh"), "separacion_us")


@query(f"{PAIRED} SELECT {INTERVAL_OUT} FROM i WHERE energia >= 0")
def diferenciar(spark, sf_dir):
    """Intervals between neighbouring readings of a meter's day."""
    return _interval_out(_intervals(spark, sf_dir).where("motivo is null"))


def _with_resets(spark, sf_dir):
    df = standin.readings(spark, sf_dir)
    return df.withColumn("valor", F.when(F.col("event_id") % 97 == 0, F.lit(1).cast("decimal(28,2)")).otherwise(F.col("valor")))


RESETS = "s AS (SELECT * REPLACE (CASE WHEN event_id % 97 = 0 THEN 1 ELSE valor END AS valor) FROM r)"


@query("WITH " + ",\n".join([R, RESETS, ONCE.format(src="s"), PAIRS.format(keys="medidor_id, fecha_local")]) + " SELECT medidor_id, epoch_us(desde) AS desde_us, epoch_us(hasta) AS hasta_us, CAST(valor_desde AS DOUBLE) AS valor_desde, CAST(valor_hasta AS DOUBLE) AS valor_hasta FROM i WHERE energia < 0")
def contador_retrocede(spark, sf_dir):
    """Intervals over which the counter falls."""
    df = energy.difference(energy.deduplicate(ingest.with_day(_with_resets(spark, sf_dir), CALENDAR))).where("motivo = 'contador_retrocede'")
    return df.select("medidor_id", _us("desde").alias("desde_us"), _us("hasta").alias("hasta_us"), F.col("valor_desde").cast("double").alias("valor_desde"), F.col("valor_hasta").cast("double").alias("valor_hasta"))


@query("WITH " + ",\n".join([R, RESETS, ONCE.format(src="s"), PAIRS.format(keys="medidor_id, fecha_local"), "j AS (SELECT *, CAST(energia AS DOUBLE) / (sep / 3600000000.0) AS kw FROM i)"]) + " SELECT CASE WHEN energia < 0 THEN 'contador_retrocede' WHEN kw > 5000 THEN 'salto_imposible' ELSE 'bien' END AS motivo, count(*) AS n FROM j GROUP BY 1")
def salto_maximo(spark, sf_dir):
    """Intervals by reason, with a limit on mean power."""
    df = energy.jumps(energy.difference(energy.deduplicate(ingest.with_day(_with_resets(spark, sf_dir), CALENDAR))), 5000)
    return df.groupBy(F.coalesce("motivo", F.lit("bien")).alias("motivo")).agg(F.count("*").alias("n"))


@query(f"{PAIRED} SELECT {INTERVAL_OUT} FROM i")
def vigentes(spark, sf_dir):
    """Of the intervals from a reading to its next two, the shortest per left edge: what remains once late readings have come."""
    df = energy.deduplicate(ingest.with_day(standin.readings(spark, sf_dir), CALENDAR))
    w = Window.partitionBy("medidor_id", "fecha_local").orderBy("instante")
    right = [F.struct(*(F.lead(c, k).over(w).alias(c) for c in ("instante", "valor", "cabina_id"))) for k in (1, 2)]
    ahead = df.select("medidor_id", "fecha_local", F.col("instante").alias("desde"), F.col("valor").alias("v"), F.array(*right).alias("rs"))
    both = ahead.select("medidor_id", "fecha_local", "desde", "v", F.explode("rs").alias("r")).where("r.instante is not null")
    best = both.groupBy("medidor_id", "fecha_local", "desde").agg(F.min_by(F.struct("r", "v"), F.col("r.instante")).alias("x"))
    return _interval_out(best.select("medidor_id", F.col("x.r.cabina_id").alias("cabina_id"), "fecha_local", "desde", F.col("x.r.instante").alias("hasta"), (F.col("x.r.valor") - F.col("x.v")).alias("energia_kwh"), S.micros_between(F.col("desde"), F.col("x.r.instante")).alias("separacion_us")))


@query(f"{PAIRED},\n{PARTS} SELECT medidor_id, fecha_local, franja, epoch_us(desde) AS desde_us, us AS parte_us, round(kwh, 6) AS parte_kwh, interp AS interpolada FROM parts")
def repartir_por_franja(spark, sf_dir):
    """Parts of the intervals by band."""
    return energy.split(_intervals(spark, sf_dir).where("motivo is null"), CALENDAR).select("medidor_id", "fecha_local", "franja", _us("desde").alias("desde_us"), "parte_us", F.round("parte_kwh", 6).alias("parte_kwh"), "interpolada")


@query(f"{chain_sql()} SELECT * FROM cells")
def celdas(spark, sf_dir):
    """Energy per meter, local day and band: the flagship."""
    return _cells(spark, sf_dir)


@query(f"{chain_sql(threshold=45)} SELECT * FROM cells")
def celdas_umbral(spark, sf_dir):
    """Cells with a threshold of 45 minutes."""
    return _cells(spark, sf_dir, threshold=45)


@query(f"{chain_sql(keys='medidor_id')} SELECT * FROM cells")
def celdas_medianoche(spark, sf_dir):
    """Cells with intervals that span midnight."""
    return _cells(spark, sf_dir, cruzar_medianoche=True)


@query(f"{chain_sql(quarter=True)} SELECT * FROM cells")
def celdas_alineadas(spark, sf_dir):
    """Cells of readings on quarters of an hour."""
    return energy.cells(standin.aligned(standin.readings(spark, sf_dir)), CALENDAR)


# the chain over raw records, faults included
GOOD = f"""{RAW_SQL},
k AS (SELECT *, event_id AS e, instante + (tarda + 60 * copia) * INTERVAL 1 SECOND AS publicada FROM x),
g AS (SELECT * REPLACE (epoch_us(publicada) AS llegada, CASE falla WHEN 'reseteo' THEN 1 ELSE valor END AS valor) FROM k WHERE falla IS NULL OR falla IN ('reseteo', 'sin_registro')),
d0 AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY medidor_id, fecha_local, instante ORDER BY llegada) = 1),
d AS (SELECT * FROM d0 WHERE falla IS DISTINCT FROM 'sin_registro')"""
FULL = f"WITH {GOOD},\n{PAIRS.format(keys='medidor_id, fecha_local')},\n{PARTS},\n{CELLS.format(t=90)}"
REASONS = """q AS (
  SELECT CASE falla WHEN 'json' THEN 'json_invalido' WHEN 'sin_medidor' THEN 'sin_medidor_id' WHEN 'ayer' THEN 'instante_invalido' ELSE 'instante_sin_huso' END AS motivo,
         CASE WHEN falla = 'sin_medidor' THEN NULL ELSE medidor_id END AS medidor_id FROM k WHERE falla IN ('json', 'sin_medidor', 'ayer', 'sin_huso')
  UNION ALL SELECT 'sin_registro_util', medidor_id FROM d0 WHERE falla = 'sin_registro'
  UNION ALL SELECT 'contador_retrocede', medidor_id FROM i WHERE energia < 0)"""


@query(f"{FULL} SELECT * FROM cells")
def cadena_completa(spark, sf_dir):
    """Raw records to cells."""
    return energy.chain(standin.raw(spark, sf_dir), CALENDAR)[0]


@query(f"{FULL}, {REASONS} SELECT motivo, medidor_id, count(*) AS n FROM q GROUP BY ALL")
def union_cuarentena(spark, sf_dir):
    """Quarantined rows of all stages, by reason and meter."""
    return energy.chain(standin.raw(spark, sf_dir), CALENDAR)[1].groupBy("motivo", "medidor_id").agg(F.count("*").alias("n"))


@query(f"{FULL}, {REASONS} SELECT motivo, count(*) AS n FROM q GROUP BY ALL")
def cuarentena_por_motivo(spark, sf_dir):
    """Quarantined rows by reason."""
    return views.by_reason(energy.chain(standin.raw(spark, sf_dir), CALENDAR)[1])


@query(f"{FULL}, {REASONS} SELECT motivo, count(*) AS n FROM q GROUP BY ALL ORDER BY n DESC, motivo LIMIT 3")
def top_motivos(spark, sf_dir):
    """The three commonest reasons."""
    return views.by_reason(energy.chain(standin.raw(spark, sf_dir), CALENDAR)[1]).orderBy(F.desc("n"), "motivo").limit(3)


@query(f"{FULL}, {REASONS} SELECT count(*) AS mensajes, (SELECT count(*) FROM q) AS cuarentena_total, (SELECT count(*) FROM g) - (SELECT count(*) FROM d0) AS duplicados_descartados, (SELECT count(*) FROM i WHERE energia >= 0) AS consumos_emitidos, (SELECT count(*) FROM cells) AS celdas_emitidas, (SELECT count(*) FROM cells WHERE indeterminada) AS celdas_indeterminadas FROM k")
def contadores(spark, sf_dir):
    """The chain's counters, in one pass."""
    return energy.counters(standin.raw(spark, sf_dir), CALENDAR)


@query(f"WITH {GOOD} SELECT event_id, copia, CAST((epoch_us(publicada) - epoch_us(instante)) / 1000000 AS BIGINT) AS retraso_s FROM k WHERE falla IS NULL")
def retraso_publicacion(spark, sf_dir):
    """Seconds from reading to publication."""
    good = ingest.good(ingest.ingest(standin.raw(spark, sf_dir))).where("falla is null")
    return good.select("event_id", "copia", F.floor((F.timestamp_diff("MICROSECOND", F.timestamp_micros(F.lit(0)), F.col("timestamp")) - _us()) / 1_000_000).alias("retraso_s"))


@query(f"WITH {GOOD}, o AS (SELECT medidor_id, instante, max(instante) OVER (PARTITION BY medidor_id ORDER BY publicada, event_id, copia ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS antes FROM k WHERE falla IS NULL) SELECT medidor_id, count(*) AS mensajes, count(*) FILTER (WHERE instante < antes) AS desordenados FROM o GROUP BY ALL")
def orden_publicacion(spark, sf_dir):
    """Messages that come after a later reading of their meter, in order of publication."""
    good = ingest.good(ingest.ingest(standin.raw(spark, sf_dir))).where("falla is null")
    w = Window.partitionBy("medidor_id").orderBy("timestamp", "event_id", "copia").rowsBetween(Window.unboundedPreceding, -1)
    return good.withColumn("antes", F.max("instante").over(w)).groupBy("medidor_id").agg(F.count("*").alias("mensajes"), F.count_if(F.col("instante") < F.col("antes")).alias("desordenados"))


# -- output and consumer views


@query(f"{chain_sql()} SELECT medidor_id || '|' || CAST(fecha_local AS VARCHAR) || '|' || franja AS clave, energia_kwh, intervalos_usados, cabina_id FROM cells")
def serializar_celdas(spark, sf_dir):
    """Cells as messages, read back through the contract filter."""
    sent = views.split_contract(views.serialise(_cells(spark, sf_dir))).where("propia")
    return sent.select("clave", F.get_json_object("texto", "$.energia_kwh").cast("double").alias("energia_kwh"), F.get_json_object("texto", "$.intervalos_usados").cast("long").alias("intervalos_usados"), F.get_json_object("texto", "$.cabina_id").alias("cabina_id"))


def _messages(spark, sf_dir) -> DataFrame:
    """Revisions of counters as cell messages, with foreign ones between."""
    df = ingest.with_day(standin.readings(spark, sf_dir), CALENDAR)
    key = F.when(F.col("event_id") % 31 == 0, F.lit("ajena")).otherwise(S.cell_key(F.col("medidor_id"), F.col("fecha_local"), CALENDAR.band(S.minute_of_day(F.col("local")))))
    value = F.when(F.col("event_id") % 37 == 0, F.lit('{"otra": 1}')).otherwise(F.concat(F.lit('{"energia_kwh": '), F.floor(F.col("valor") / 100).cast("string"), F.lit("}")))
    return df.select(key.cast("binary").alias("key"), value.cast("binary").alias("value"), F.col("event_id").alias("offset"))


MESSAGES = f"""{R}, b AS (SELECT *, hour(local) * 60 + minute(local) AS m FROM r),
msg AS (SELECT event_id AS "offset", CASE WHEN event_id % 31 = 0 THEN 'ajena' ELSE medidor_id || '|' || CAST(fecha_local AS VARCHAR) || '|' || {BAND} END AS clave,
  CASE WHEN event_id % 37 = 0 THEN '{{"otra": 1}}' ELSE '{{"energia_kwh": ' || CAST(CAST(floor(valor / 100) AS BIGINT) AS VARCHAR) || '}}' END AS texto, event_id % 31 <> 0 AND event_id % 37 <> 0 AS propia FROM b)"""


@query(f"WITH {MESSAGES} SELECT count(*) AS mensajes, count(DISTINCT clave) FILTER (WHERE propia) AS celdas, count(*) FILTER (WHERE NOT propia) AS ajenos FROM msg")
def filtro_contrato(spark, sf_dir):
    """Messages, cells and foreign messages."""
    m = views.split_contract(_messages(spark, sf_dir))
    return m.agg(F.count("*").alias("mensajes"), F.count_distinct(F.when(F.col("propia"), F.col("clave"))).alias("celdas"), F.count_if(~F.col("propia")).alias("ajenos"))


@query(f'WITH {MESSAGES} SELECT clave, max("offset") AS ultimo, arg_max(texto, "offset") AS texto FROM msg WHERE propia GROUP BY clave')
def upsert_ultima_revision(spark, sf_dir):
    """The last revision of each cell."""
    m = views.split_contract(_messages(spark, sf_dir)).where("propia").select("clave", "texto", "offset")
    return views.latest(m).select("clave", F.col("offset").alias("ultimo"), "texto")


@query(f'WITH {MESSAGES}, z AS (SELECT *, lag(texto) OVER (PARTITION BY clave ORDER BY "offset") AS antes FROM msg WHERE propia) SELECT clave, "offset" AS revision, texto FROM z WHERE texto IS DISTINCT FROM antes')
def revisiones_cambiadas(spark, sf_dir):
    """Revisions that change their cell."""
    m = views.split_contract(_messages(spark, sf_dir)).where("propia").select("clave", "texto", "offset")
    return views.changed(m).select("clave", F.col("offset").alias("revision"), "texto")


@query(f"{chain_sql()}, t AS (SELECT franja, round(sum(energia_kwh), 3) AS energia_kwh, count(*) AS celdas FROM cells GROUP BY ALL) SELECT *, repeat('█', CAST(round(28 * energia_kwh / max(energia_kwh) OVER (), 0) AS INT)) AS barra FROM t")
def energia_por_franja(spark, sf_dir):
    """Energy per band and its bar."""
    return views.per_band(_cells(spark, sf_dir))


LABEL = "CASE WHEN indeterminada THEN 'indeterminada' WHEN interpolada THEN 'interpolada' ELSE 'medida' END"


@query(f"{chain_sql()} SELECT {LABEL} AS calidad, count(*) AS n FROM cells GROUP BY ALL")
def calidad_celdas(spark, sf_dir):
    """Cells per quality label."""
    return _cells(spark, sf_dir).groupBy(S.quality_label(F.col("indeterminada"), F.col("interpolada")).alias("calidad")).agg(F.count("*").alias("n"))


@query(f"{chain_sql()} SELECT count(*) AS celdas, count(*) FILTER (WHERE {LABEL} = 'medida') AS medidas, count(*) FILTER (WHERE {LABEL} = 'interpolada') AS interpoladas, count(*) FILTER (WHERE indeterminada) AS indeterminadas, round(sum(energia_kwh), 3) AS total_kwh, max(separacion_maxima_minutos) AS separacion_maxima FROM cells")
def resumen_confianza(spark, sf_dir):
    """How far the day's cells can be trusted."""
    return views.trust(_cells(spark, sf_dir))


@query(f"{chain_sql()} SELECT medidor_id, fecha_local, franja, {LABEL} AS calidad, separacion_maxima_minutos * 100 / CASE franja WHEN 'valle' THEN 420.0 WHEN 'resto' THEN 780.0 ELSE 240.0 END AS error_pct FROM cells")
def error_atribucion(spark, sf_dir):
    """Upper bound of the attribution error of each cell."""
    return views.rows(_cells(spark, sf_dir), CALENDAR, rounded=False).select("medidor_id", "fecha_local", "franja", "calidad", "error_pct")


@query(f"{chain_sql()} SELECT medidor_id, fecha_local, franja, energia_kwh FROM cells WHERE CAST(fecha_local + 1 AS TIMESTAMP) + INTERVAL 3 HOUR + INTERVAL 36 HOUR <= TIMESTAMP '2024-01-20 00:00:00'")
def vista_final(spark, sf_dir):
    """Cells that can't change any more on 20 January."""
    return views.final(_cells(spark, sf_dir), F.lit("2024-01-20 00:00:00").cast("timestamp_ntz"), CALENDAR).select("medidor_id", "fecha_local", "franja", "energia_kwh")


@query(f"""{chain_sql()}, a AS (SELECT medidor_id || '|' || CAST(fecha_local AS VARCHAR) || '|' || franja AS clave, energia_kwh, day(fecha_local) AS n FROM cells),
e AS (SELECT clave, energia_kwh AS esperado FROM a WHERE n % 5 <> 0), o AS (SELECT clave, CASE WHEN n % 7 = 0 THEN energia_kwh + 1 ELSE energia_kwh END AS obtenido FROM a WHERE n % 6 <> 0)
SELECT CASE WHEN obtenido IS NULL THEN 'falta' WHEN esperado IS NULL THEN 'sobra' WHEN abs(esperado - obtenido) <= 1e-6 THEN 'igual' ELSE 'distinto' END AS estado, count(*) AS n FROM e FULL JOIN o USING (clave) GROUP BY ALL""")
def comparar_esperado(spark, sf_dir):
    """Expected against actual cells, by outcome."""
    c = _clave(_cells(spark, sf_dir)).withColumn("n", F.dayofmonth("fecha_local"))
    changed = F.when(F.col("n") % 7 == 0, F.col("energia_kwh") + 1).otherwise(F.col("energia_kwh"))
    return views.compare(c.where("n % 5 <> 0"), c.where("n % 6 <> 0").withColumn("energia_kwh", changed)).groupBy("estado").agg(F.count("*").alias("n"))


@query(f"{chain_sql()} SELECT medidor_id || '|' || CAST(fecha_local AS VARCHAR) || '|' || franja AS clave, CASE WHEN day(fecha_local) % 4 = 0 THEN -1.0 ELSE energia_kwh END AS energia_kwh FROM cells")
def mezcla_upsert(spark, sf_dir):
    """A stored table merged with updates of some keys."""
    c = _clave(_cells(spark, sf_dir)).select("clave", "energia_kwh", "fecha_local")
    updates = c.where("day(fecha_local) % 4 = 0").withColumn("energia_kwh", F.lit(-1.0))
    return views.merge(c, updates).select("clave", "energia_kwh")


# -- measures


@query(f"{PAIRED} SELECT count(*) AS n, min(sep) / 60000000.0 AS minimo, max(sep) / 60000000.0 AS maximo, round(quantile_cont(sep, 0.5) / 60000000.0, 6) AS p50, round(quantile_cont(sep, 0.9) / 60000000.0, 6) AS p90, CAST(sum(CAST(floor(sep / 60000000.0) AS BIGINT)) AS BIGINT) AS suma_minutos FROM i WHERE energia >= 0")
def separacion_metricas(spark, sf_dir):
    """Distribution of the separation between readings."""
    m = F.col("separacion_us")
    return _intervals(spark, sf_dir).where("motivo is null").agg(
        F.count("*").alias("n"), (F.min(m) / 6e7).alias("minimo"), (F.max(m) / 6e7).alias("maximo"), F.round(F.percentile(m, 0.5) / 6e7, 6).alias("p50"), F.round(F.percentile(m, 0.9) / 6e7, 6).alias("p90"), F.sum(F.floor(m / 6e7).cast("long")).alias("suma_minutos")
    )


CROSS = f"{PAIRED},\n{PARTS}, cr AS (SELECT medidor_id, desde, any_value(sep) AS sep FROM parts WHERE interp GROUP BY ALL)"


def _crossings(spark, sf_dir):
    parts = energy.split(_intervals(spark, sf_dir).where("motivo is null"), CALENDAR).where("interpolada")
    return parts.groupBy("medidor_id", "desde").agg(F.first("separacion_us").alias("sep"))


@query(f"{CROSS} SELECT CAST(least(floor(sep / 900000000.0), 12) AS BIGINT) AS cubo, count(*) AS n FROM cr GROUP BY ALL")
def cruces_histograma(spark, sf_dir):
    """Intervals that cross a band edge, by quarter hours of separation; the thirteenth bucket is open."""
    return _crossings(spark, sf_dir).groupBy(F.least(F.floor(F.col("sep") / 9e8), F.lit(12)).alias("cubo")).agg(F.count("*").alias("n"))


@query(f"{CROSS} SELECT u AS umbral, count(*) FILTER (WHERE sep > u::BIGINT * 60000000) AS indeterminados, count(*) AS cruces FROM cr, (SELECT unnest([30, 45, 90, 120]) AS u) GROUP BY ALL")
def umbral_sensibilidad(spark, sf_dir):
    """Crossings left undetermined at several thresholds, counted in one pass."""
    cuts = F.explode(F.array(*(F.lit(u) for u in (30, 45, 90, 120))))
    rows = _crossings(spark, sf_dir).select("sep", cuts.alias("umbral"))
    return rows.groupBy("umbral").agg(F.count_if(F.col("sep") > F.col("umbral").cast("long") * 60_000_000).alias("indeterminados"), F.count("*").alias("cruces"))


@query("SELECT * FROM (VALUES ('valle', CAST(420 AS BIGINT)), ('resto', CAST(780 AS BIGINT)), ('punta', CAST(240 AS BIGINT))) t(franja, minutos)")
def duracion_franja(spark, sf_dir):
    """Minutes of each band."""
    return CALENDAR.table(spark).groupBy("franja").agg(F.sum(F.col("hasta") - F.col("desde")).alias("minutos"))


@query(f"{chain_sql()} SELECT medidor_id, fecha_local, count(*) AS franjas, sum(minutos_cubiertos) > 0 AS cubierta FROM cells GROUP BY ALL")
def cobertura_franja(spark, sf_dir):
    """Bands with cells, and whether any minute is covered, per meter and day."""
    return _cells(spark, sf_dir).groupBy("medidor_id", "fecha_local").agg(F.count("*").alias("franjas"), (F.sum("minutos_cubiertos") > 0).alias("cubierta"))


@query(f"WITH {R} SELECT event_id, substr(sha256(medidor_id || '|' || strftime(instante, '%Y-%m-%dT%H:%M:%S')), 1, 16) AS id FROM r")
def event_id_sha256(spark, sf_dir):
    """Identity of each reading."""
    return standin.readings(spark, sf_dir).select("event_id", S.event_id(F.col("medidor_id"), F.date_format("instante", "yyyy-MM-dd'T'HH:mm:ss")).alias("id"))


@query("SELECT DISTINCT 'MED-' || lpad(CAST(user_id % 10 AS VARCHAR), 4, '0') AS etiqueta, CAST('0x' || substr(sha256('2026|' || 'MED-' || lpad(CAST(user_id % 10 AS VARCHAR), 4, '0')), 1, 8) AS BIGINT) AS semilla FROM events")
def semilla_derivada(spark, sf_dir):
    """Seed of each meter."""
    return standin.readings(spark, sf_dir).select("medidor_id").distinct().select(F.col("medidor_id").alias("etiqueta"), S.derived_seed(F.lit(2026), F.col("medidor_id")).alias("semilla"))


@query("SELECT CAST(m AS INT) AS minuto, round(sum(kw) OVER (ORDER BY m) / 60, 6) AS kwh FROM (SELECT m, 0.18 + 0.55 * exp(-0.5 * pow((m / 60.0 - 7.5) / 1.3, 2)) + 0.3 * exp(-0.5 * pow((m / 60.0 - 13.0) / 1.8, 2)) + 1.45 * exp(-0.5 * pow((m / 60.0 - 20.0) / 1.9, 2)) AS kw FROM (SELECT unnest(range(0, 1440)) AS m))")
def curva_demanda_integral(spark, sf_dir):
    """Running integral of a household's demand over a day."""
    day = spark.range(1440).select(F.col("id").cast("int").alias("minuto"), S.demand_kw(F.col("id")).alias("kw"))
    w = Window.partitionBy(F.lit(0)).orderBy("minuto").rowsBetween(Window.unboundedPreceding, 0)
    return day.select("minuto", F.round(F.sum("kw").over(w) / 60, 6).alias("kwh"))


@query(f"WITH {R} SELECT medidor_id, epoch_us(instante) AS instante_us FROM r ORDER BY instante, event_id LIMIT 40")
def primeras_lecturas(spark, sf_dir):
    """The first forty readings."""
    return standin.readings(spark, sf_dir).orderBy("instante", "event_id").limit(40).select("medidor_id", _us().alias("instante_us"))


@query(f"WITH {R}, c AS (SELECT cabina_id, count(DISTINCT medidor_id) AS n FROM r GROUP BY ALL) SELECT count(*) AS cabinas, CAST(sum(n) AS BIGINT) AS medidores, min(n) AS minimo, list_sort(list(n))[len(list(n)) // 2 + 1] AS mediana, max(n) AS maximo, CAST(coalesce(sum(n) FILTER (WHERE n >= 30), 0) AS DOUBLE) / sum(n) AS en_grandes FROM c")
def resumen_parque(spark, sf_dir):
    """Cabinets, meters and cabinet sizes; the upper median; share of meters in cabinets of 30 or more."""
    c = standin.readings(spark, sf_dir).groupBy("cabina_id").agg(F.count_distinct("medidor_id").alias("n"))
    large = F.sum(F.when(F.col("n") >= 30, F.col("n")).otherwise(0)) / F.sum("n")
    return c.agg(F.count("*").alias("cabinas"), F.sum("n").alias("medidores"), F.min("n").alias("minimo"), S.upper_median("n").alias("mediana"), F.max("n").alias("maximo"), large.alias("en_grandes"))


@query("WITH " + ",\n".join([R, ONCE.format(src="r"), PAIRS.format(keys="medidor_id, fecha_local")]) + " SELECT medidor_id, epoch_us(desde) AS desde_us, epoch_us(hasta) AS hasta_us, round(CAST(energia AS DOUBLE), 3) AS energia_kwh, round(sep / 60000000.0, 2) AS separacion_minutos FROM i WHERE energia >= 0")
def intervalos_redondeados(spark, sf_dir):
    """Intervals as they are shown, rounded."""
    return energy.rounded(_intervals(spark, sf_dir).where("motivo is null")).select("medidor_id", _us("desde").alias("desde_us"), _us("hasta").alias("hasta_us"), "energia_kwh", "separacion_minutos")


@query(f"""{chain_sql()}, t AS (SELECT *, separacion_maxima_minutos * 100 / CASE franja WHEN 'valle' THEN 420.0 WHEN 'resto' THEN 780.0 ELSE 240.0 END AS e, CAST(round(minutos_cubiertos) AS BIGINT) AS c, CAST(round(minutos_indeterminados) AS BIGINT) AS u FROM cells)
SELECT medidor_id, fecha_local, franja, round(energia_kwh, 3) AS energia_kwh, {LABEL} AS calidad, round(e, 1) AS error_pct, (c // 60) || ':' || lpad(CAST(c % 60 AS VARCHAR), 2, '0') AS cubierto, (u // 60) || ':' || lpad(CAST(u % 60 AS VARCHAR), 2, '0') AS indeterminado
FROM t ORDER BY medidor_id, fecha_local, franja""")
def tabla_tablero(spark, sf_dir):
    """The dashboard's table from cell messages: key parts, label, error bound, times as h:mm, sorted by key."""
    sent = views.split_contract(views.serialise(_cells(spark, sf_dir))).where("propia")
    return views.board(sent, CALENDAR)


@query(f"""WITH {RAW_SQL}, k AS (SELECT *, CASE falla WHEN 'json' THEN 'json_invalido' WHEN 'sin_medidor' THEN 'sin_medidor_id' WHEN 'ayer' THEN 'instante_invalido' WHEN 'sin_huso' THEN 'instante_sin_huso' END AS motivo FROM x)
SELECT event_id, copia, CASE WHEN falla = 'sin_medidor' THEN '' ELSE medidor_id END AS clave, motivo, CASE WHEN falla = 'json' THEN '6573746F206E6F206573206A736F6E' END AS bytes, CASE WHEN falla <> 'json' THEN cabina_id END AS cabina_id FROM k WHERE motivo IS NOT NULL""")
def mensajes_cuarentena(spark, sf_dir):
    """Quarantined records as messages, read back: key, reason, payload in hex or the event."""
    bad = ingest.quarantine(ingest.ingest(standin.raw(spark, sf_dir)), "event_id", "copia")
    text = F.col("value").cast("string")
    sent = ingest.quarantine_messages(bad, "event_id", "copia")
    return sent.select("event_id", "copia", F.col("key").cast("string").alias("clave"), F.get_json_object(text, "$.motivo").alias("motivo"), F.get_json_object(text, "$.bytes").alias("bytes"), F.get_json_object(text, "$.lectura.cabina_id").alias("cabina_id"))


TIED = f"""{R}, t AS (SELECT *, llegada // 7 AS cuando, CASE WHEN event_id % 9 = 0 THEN valor + 5 ELSE valor END AS v, unnest(CASE WHEN event_id % 9 = 0 THEN [0, 1] ELSE [0] END) AS copia FROM r)"""


@query(f"""WITH {TIED} SELECT CASE WHEN event_id % 13 = 0 THEN 'M' || chr(65533) || CAST(event_id % 10 AS VARCHAR) ELSE medidor_id END AS medidor_id, epoch_us(instante) AS instante_us, min(CAST(CASE WHEN copia = 1 THEN v ELSE valor END AS DOUBLE)) AS valor FROM t GROUP BY 1, 2""")
def claves_y_empates(spark, sf_dir):
    """Readings whose key is no UTF-8, and two values of one instant that arrive at the same time: the lesser is first."""
    df = standin.readings(spark, sf_dir)
    odd = F.concat(F.encode(F.lit("M"), "UTF-8"), F.unhex(F.lit("FF")), F.encode((F.col("event_id") % 10).cast("string"), "UTF-8"))
    key = F.when(F.col("event_id") % 13 == 0, odd).otherwise(F.col("medidor_id").cast("binary"))
    copy = F.explode(F.when(F.col("event_id") % 9 == 0, F.array(F.lit(1), F.lit(0))).otherwise(F.array(F.lit(0)))).alias("copia")
    value = (F.col("valor") + F.when(F.col("copia") == 1, 5).otherwise(0)).cast("double")
    event = F.to_json(F.struct(F.date_format("instante", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("instante_lectura"), F.array(F.struct(F.lit("15.8.0").alias("obis"), value.alias("valor"))).alias("registros")))
    raw = df.select("instante", "event_id", "valor", key.alias("key"), copy).select("key", event.cast("binary").alias("value"), F.timestamp_seconds(F.floor(F.col("event_id") / 7)).alias("timestamp"))
    readings = ingest.with_day(ingest.good(ingest.ingest(energy.with_arrival(raw))), CALENDAR)
    return energy.deduplicate(readings).select("medidor_id", _us().alias("instante_us"), "valor")


# -- generators and the stream


def _stream_cells(spark, sf_dir, batches: int = 4) -> DataFrame:
    from ..sources.files import scratch
    from ..streaming import meter_day

    meter_day.configure(spark)
    top = scratch(spark)
    df = standin.readings(spark, sf_dir)
    ends = df.agg(F.min("llegada").alias("a"), F.max("llegada").alias("b")).first()
    step = -(-((ends.b or 0) - (ends.a or 0) + 1) // batches)
    rows = df.select("medidor_id", _us().alias("us"), F.col("valor").cast("double").alias("valor"), "cabina_id", "llegada")
    files = spark.sparkContext.defaultParallelism
    for k in range(batches):  # so many files a batch, in order of arrival; an empty one has a file of no rows
        part = rows.where((F.col("llegada") >= (ends.a or 0) + k * step) & (F.col("llegada") < (ends.a or 0) + (k + 1) * step))
        part.repartition(files, F.xxhash64("llegada")).write.option("maxRecordsPerFile", 0).mode("append").parquet(f"{top}/in/lote={k}")
    raw = spark.readStream.schema("medidor_id string, us long, valor double, cabina_id string, llegada long").option("maxFilesPerTrigger", files).parquet(f"{top}/in/lote=*")
    at = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("us") / F.lit(1_000_000).cast("decimal(20,6)"))
    good = raw.select("medidor_id", at.alias("instante"), "valor", "cabina_id", "llegada", F.lit("").alias("lectura"))
    meter_day.run_to_folder(meter_day.transform(good, CALENDAR), f"{top}/out", f"{top}/checkpoint")
    return meter_day.current_cells(spark, f"{top}/out")


@query(SQL["celdas"])
def flujo_celdas(spark, sf_dir):
    """The cells by way of the stream, readings in four micro-batches; same SQL as the batch."""
    return _stream_cells(spark, sf_dir)


@query(f"{FULL} SELECT * FROM cells")
def repeticion(spark, sf_dir):
    """The service over the raw records in files, replayed from their beginning without state: the cells that its messages leave; same SQL as the batch."""
    from .. import service
    from ..sources.files import scratch
    from ..sources.schemas import CELL

    top = scratch(spark)
    standin.raw(spark, sf_dir).select("key", "value", "timestamp").repartition(4, "timestamp").write.parquet(f"{top}/in")
    service.replay(spark, service.folder_source(spark, f"{top}/in", 2), CALENDAR, f"{top}/out")
    last = service.current(service.read_messages(spark, f"{top}/out/consumo"))
    part, kinds = F.split("clave", "\\|"), CELL.partition("franja string, ")[2]
    return last.select(part[0].alias("medidor_id"), part[1].cast("date").alias("fecha_local"), part[2].alias("franja"), F.from_json("texto", kinds).alias("c")).select("medidor_id", "fecha_local", "franja", "c.*")


@query(f"WITH {R} SELECT 1 + max(event_id) - min(event_id) AS n FROM events")
def conteo_desplazamientos(spark, sf_dir):
    """Records of a log by its offsets."""
    from ..sources.settings import offset_count

    return offset_count(standin.readings(spark, sf_dir).select(F.lit(0).alias("partition"), F.col("event_id").alias("offset")))


@query()
def escenario_simulador(spark, sf_dir):
    """Cells of a simulated day of three cabinets."""
    from datetime import datetime
    from zoneinfo import ZoneInfo

    from ..sources import simulator

    sent = simulator.scenario(spark, "A", 3, datetime(2026, 9, 22, tzinfo=ZoneInfo(CALENDAR.zona)))
    raw = sent.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.timestamp_micros("publicado_us").alias("timestamp"))
    return energy.chain(raw, CALENDAR)[0]


@query("""SELECT franja, energia_kwh::DOUBLE AS energia_kwh, cubiertos::DOUBLE AS minutos_cubiertos, indet::DOUBLE AS minutos_indeterminados, interpolada, usados::BIGINT AS intervalos_usados FROM (VALUES ('resto', 1.0, 20.0, 0.0, false, 2), ('punta', 0.8, 10.0, 0.0, false, 1)) t(franja, energia_kwh, cubiertos, indet, interpolada, usados)""")
def inyector_acciones(spark, sf_dir):
    """The injector's story: three readings, one again, one late on the edge."""
    from datetime import datetime
    from zoneinfo import ZoneInfo

    from ..sources import injector

    sent = injector.play(["normal", "normal", "normal", "duplicado", "tardia"], datetime(2026, 9, 30, tzinfo=ZoneInfo(CALENDAR.zona)))
    cells = energy.chain(injector.records(spark, sent), CALENDAR)[0]
    return cells.select("franja", "energia_kwh", "minutos_cubiertos", "minutos_indeterminados", "interpolada", "intervalos_usados")


@query("SELECT que, nombre, energia_kwh::DOUBLE AS energia_kwh, minutos::DOUBLE AS minutos, indeterminada FROM (VALUES ('celda', 'resto', 0.9, 5, true), ('celda', 'punta', 0.0, 95, true), ('cuarentena', 'contador_retrocede', NULL, NULL, NULL)) t(que, nombre, energia_kwh, minutos, indeterminada)")
def inyector_faltas(spark, sf_dir):
    """The injector's other story: two steps, a gap over the band's edge, the counter at zero."""
    from datetime import datetime
    from zoneinfo import ZoneInfo

    from ..sources import injector

    sent = injector.play(["normal", "normal", "hueco", "reseteo"], datetime(2026, 9, 30, tzinfo=ZoneInfo(CALENDAR.zona)))
    cells, bad = energy.chain(injector.records(spark, sent), CALENDAR)
    one = cells.select(F.lit("celda").alias("que"), F.col("franja").alias("nombre"), "energia_kwh", (F.col("minutos_indeterminados")).alias("minutos"), "indeterminada")
    none = lambda t: F.lit(None).cast(t)
    return one.unionByName(bad.select(F.lit("cuarentena").alias("que"), F.col("motivo").alias("nombre"), none("double").alias("energia_kwh"), none("double").alias("minutos"), none("boolean").alias("indeterminada")))
