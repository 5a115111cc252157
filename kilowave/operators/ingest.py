"""From raw records to readings: parsing, keys, event time and the first four reasons for quarantine.

Column expressions only, so the same plan serves a batch, a replay and a stream; a row carries `motivo`, null while it is
good, instead of going to a side output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import Calendar
from ..functions.scalars import iso_has_offset, iso_utc
from ..sources.schemas import ENERGY, EVENT

DETAIL_BYTES = 200


def parse(raw: DataFrame) -> DataFrame:
    """Raw (key, value, timestamp, ...) with lectura (the parsed event), medidor_id and motivo."""
    text = F.try_validate_utf8(F.col("value").cast("string"))
    event = F.from_json(text, EVENT, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    shaped = F.coalesce(text.rlike(r"^\s*\{"), F.lit(False))
    own = F.nullif(F.col("lectura.medidor_id"), F.lit(""))
    by_key = F.nullif(F.make_valid_utf8(F.col("key").cast("string")), F.lit(""))  # a bad byte becomes U+FFFD
    out = raw.withColumn("lectura", event).withColumn("medidor_id", F.coalesce(own, by_key))
    bad = ~shaped | F.col("lectura").isNull() | F.col("lectura._corrupt").isNotNull()
    return out.withColumn("motivo", F.when(bad, "json_invalido").when(F.col("medidor_id").isNull(), "sin_medidor_id"))


def stamp(parsed: DataFrame) -> DataFrame:
    """parsed with instante (UTC timestamp_ntz) and the two reasons about it."""
    text = F.col("lectura.instante_lectura")
    out = parsed.withColumn("instante", F.when(F.col("motivo").isNull(), iso_utc(text)))
    late = F.when(F.col("instante").isNull(), "instante_invalido").when(~iso_has_offset(text), "instante_sin_huso")
    return out.withColumn("motivo", F.coalesce(F.col("motivo"), late))


def register(event: Column, code: str = ENERGY) -> Column:
    """The first register with a code, or null."""
    return F.get(F.filter(event["registros"], lambda r: r["obis"] == code), F.lit(0))


def counter(event: Column) -> Column:
    """The counter's value, or null if there is none or it is no finite-or-infinite number."""
    value = register(event)["valor"].try_cast("double")
    return F.when(~F.isnan(value), value)


def contract_reason(known_versions: tuple[str, ...] = ("1",), future_minutes: int = 15) -> Column:
    """The first rule of the contract profile that a stamped event breaks, or null."""
    event, codes = F.col("lectura"), F.transform(F.col("lectura.registros"), lambda r: r["obis"])
    ahead = F.timestamp_diff("MINUTE", F.convert_timezone(F.lit("UTC"), F.lit("UTC"), F.col("publicado")), F.col("instante"))
    return (
        F.when(~F.coalesce(event["schema_version"], F.lit("")).isin(*known_versions), "version_desconocida")
        .when(F.coalesce(ahead > future_minutes, F.lit(False)), "instante_futuro")
        .when(F.coalesce(F.size(event["registros"]), F.lit(0)) <= 0, "sin_registros")
        .when(F.size(codes) > F.size(F.array_distinct(codes)), "obis_duplicado")
        .when(F.coalesce(event["calidad"], F.lit("")) == "truncada", "trama_truncada")
    )


def ingest(raw: DataFrame, perfil: str = "paridad") -> DataFrame:
    """Raw records with lectura, medidor_id, cabina_id, instante, valor and motivo.

    perfil `paridad` judges by the default reasons, `contrato` by the contract's as well.
    """
    if perfil not in ("paridad", "contrato"):
        raise ValueError(f"perfil desconocido: {perfil}")
    out = stamp(parse(raw))
    if perfil == "contrato":
        out = out.withColumn("publicado", iso_utc(F.col("lectura.publicado_at")))
        out = out.withColumn("motivo", F.coalesce(F.col("motivo"), contract_reason())).drop("publicado")
    return out.withColumn("cabina_id", F.coalesce(F.col("lectura.cabina_id"), F.lit(""))).withColumn("valor", counter(F.col("lectura")))


def good(stamped: DataFrame) -> DataFrame:
    return stamped.where("motivo is null")


def quarantine(stamped: DataFrame, *also: str) -> DataFrame:
    """(medidor_id, motivo, detalle, lectura, and columns `also`): unreadable payloads with their first bytes in hex, the rest with the event as JSON."""
    unreadable = F.col("motivo") == "json_invalido"
    detail = F.when(unreadable, F.hex(F.substring("value", 1, DETAIL_BYTES)))
    event = F.when(~unreadable, F.to_json(F.col("lectura").dropFields("_corrupt")))
    return stamped.where("motivo is not null").select("medidor_id", "motivo", detail.alias("detalle"), event.alias("lectura"), *also)


def quarantine_messages(bad: DataFrame, *also: str) -> DataFrame:
    """(key, value) of quarantined rows, both binary: the meter or nothing, and {motivo, detalle, bytes} of unreadable payloads or {motivo, lectura}."""
    unreadable = F.to_json(F.struct("motivo", F.lit("carga ilegible").alias("detalle"), F.col("detalle").alias("bytes")))
    event = F.concat(F.lit('{"motivo":"'), F.col("motivo"), F.lit('","lectura":'), F.coalesce("lectura", F.lit("null")), F.lit("}"))
    value = F.when(F.col("motivo") == "json_invalido", unreadable).otherwise(event)
    return bad.select(F.coalesce("medidor_id", F.lit("")).cast("binary").alias("key"), value.cast("binary").alias("value"), *also)


def with_day(readings: DataFrame, calendar: Calendar) -> DataFrame:
    """readings with local (wall time) and fecha_local."""
    local = calendar.local(F.col("instante"))
    return readings.withColumn("local", local).withColumn("fecha_local", F.to_date(local))
