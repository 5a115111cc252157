"""The tariff calendar: loading with validation, and Column expressions over it.

A calendar is a handful of ranges of local minutes. They become literals in the plan, so band lookups and interval
splits stay inside whole-stage code generation: no join, no broadcast, no Python.
"""

from __future__ import annotations

import tomllib
from dataclasses import dataclass
from pathlib import Path
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 1440
DEFAULT_THRESHOLD, DEFAULT_CADENCE = 45, 15


class CalendarError(ValueError):
    """The calendar can't be used; the text says why."""


@dataclass(frozen=True)
class Range:
    franja: str
    desde: int
    hasta: int


@dataclass(frozen=True)
class Calendar:
    """Ranges in order, without gaps from 0 to 1440, neighbours of one name merged."""

    zona: str
    rangos: tuple[Range, ...]
    separacion_maxima: int = DEFAULT_THRESHOLD
    cadencia: int = DEFAULT_CADENCE

    @property
    def franjas(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys(r.franja for r in self.rangos))

    def duration(self, franja: str) -> int:
        return sum(r.hasta - r.desde for r in self.rangos if r.franja == franja)

    def band_at(self, minute: int) -> str:
        return next(r.franja for r in self.rangos if r.desde <= minute < r.hasta)

    def next_edge(self, minute: int) -> int:
        """The first later minute with another band, at midnight 1440."""
        return next(r.hasta for r in self.rangos if r.desde <= minute < r.hasta)

    # -- expressions

    def literal(self) -> Column:
        """array<struct<franja, desde, hasta>> of the ranges."""
        return F.array(*(F.struct(F.lit(r.franja).alias("franja"), F.lit(r.desde).alias("desde"), F.lit(r.hasta).alias("hasta")) for r in self.rangos))

    def band(self, minute: Column) -> Column:
        """Band of a local minute of the day."""
        out = None
        for r in self.rangos[:-1]:
            out = F.when(minute < r.hasta, r.franja) if out is None else out.when(minute < r.hasta, r.franja)
        return F.lit(self.rangos[-1].franja) if out is None else out.otherwise(self.rangos[-1].franja)

    def edge(self, minute: Column) -> Column:
        """Next edge after a local minute of the day."""
        out = None
        for r in self.rangos[:-1]:
            out = F.when(minute < r.hasta, r.hasta) if out is None else out.when(minute < r.hasta, r.hasta)
        return F.lit(DAY) if out is None else out.otherwise(DAY)

    def local(self, utc: Column) -> Column:
        """Local wall time (timestamp_ntz) of a UTC timestamp_ntz; does not depend on the session's zone."""
        return F.convert_timezone(F.lit("UTC"), F.lit(self.zona), utc)

    def utc(self, local: Column) -> Column:
        return F.convert_timezone(F.lit(self.zona), F.lit("UTC"), local)

    def table(self, spark: SparkSession) -> DataFrame:
        """(franja, desde, hasta) rows."""
        return spark.createDataFrame([(r.franja, r.desde, r.hasta) for r in self.rangos], "franja string, desde int, hasta int")


def minutes(text: object) -> int:
    """Minutes of `HH:MM`; only the total, 0 to 1440, is checked."""
    parts = str(text).split(":")
    if len(parts) != 2 or not all(p.isdecimal() for p in parts):
        raise CalendarError(f"hora inválida: {text!r} (se espera HH:MM)")
    total = int(parts[0]) * 60 + int(parts[1])
    if total > DAY:
        raise CalendarError(f"hora fuera del día: {text!r}")
    return total


def clock(minute: int) -> str:
    return f"{minute // 60:02d}:{minute % 60:02d}"


def build(data: dict) -> Calendar:
    """A calendar from the parsed file."""
    zone = data.get("zona_horaria")
    if not zone:
        raise CalendarError("falta zona_horaria")
    try:
        ZoneInfo(zone)
    except Exception as e:
        raise CalendarError(f"zona horaria desconocida: {zone}") from e
    bands = data.get("franjas") or []
    if not bands:
        raise CalendarError("el calendario no tiene franjas")
    names = [b.get("nombre") for b in bands]
    if not all(names):
        raise CalendarError("hay una franja sin nombre")
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise CalendarError(f"franjas repetidas: {', '.join(twice)}")
    ranges = []
    for b in bands:
        for r in b.get("rangos", ()):
            lo, hi = minutes(r.get("desde")), minutes(r.get("hasta"))
            if hi <= lo:
                raise CalendarError(f"el rango {clock(lo)}-{clock(hi)} de {b['nombre']} no avanza")
            ranges.append(Range(b["nombre"], lo, hi))
    ranges.sort(key=lambda r: (r.desde, r.hasta))
    at, merged = 0, []
    for r in ranges:
        if r.desde < at:
            raise CalendarError(f"solapamiento a las {clock(r.desde)}: {merged[-1].franja} y {r.franja}")
        if r.desde > at:
            raise CalendarError(f"hueco sin franja de {clock(at)} a {clock(r.desde)}")
        at = r.hasta
        if merged and merged[-1].franja == r.franja:
            merged[-1] = Range(r.franja, merged[-1].desde, r.hasta)
        else:
            merged.append(r)
    if at < DAY:
        raise CalendarError(f"hueco sin franja de {clock(at)} a {clock(DAY)}")
    return Calendar(zone, tuple(merged), int(data.get("separacion_maxima_minutos", DEFAULT_THRESHOLD)), int(data.get("cadencia_objetivo_minutos", DEFAULT_CADENCE)))


def load(path: str | Path) -> Calendar:
    """The calendar in a TOML file."""
    try:
        raw = Path(path).read_bytes()
    except OSError as e:
        raise CalendarError(f"no se encuentra el calendario: {path}") from e
    try:
        return build(tomllib.loads(raw.decode()))
    except (tomllib.TOMLDecodeError, UnicodeDecodeError) as e:
        raise CalendarError(f"TOML inválido en {path}: {e}") from e


def example() -> Calendar:
    """The calendar in config/franjas.toml."""
    return load(Path(__file__).resolve().parents[2] / "config" / "franjas.toml")
