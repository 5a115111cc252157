"""Scalar expressions of the domain."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What ISO-8601 text may look like: date, optional time down to fractions, optional offset; extended or basic form.
ISO = r"^(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,9}))?)?)?)?(Z|[+-]\d{2}(?::?\d{2}(?::?\d{2})?)?)?$"
#: Its commonest form, which a plain cast reads: whole seconds or up to microseconds, an offset in hours and minutes.
COMMON_ISO = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|[+-]\d{2}:\d{2})$"


def upper_median(column: str) -> Column:
    """The median, the greater of the middle two: by counts of distinct values, no list of all."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY `{column}` DESC)").cast("long")


def epoch_micros(t: Column) -> Column:
    """Microseconds of a UTC timestamp_ntz since 1970, whatever the session's zone."""
    return micros_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t)


def micros_between(a: Column, b: Column) -> Column:
    """Microseconds from timestamp_ntz a to b."""
    return F.timestamp_diff("MICROSECOND", a, b)


def minutes_between(a: Column, b: Column) -> Column:
    return micros_between(a, b) / F.lit(60_000_000)


def minute_of_day(local: Column) -> Column:
    return F.hour(local) * 60 + F.minute(local)


def iso_has_offset(text: Column) -> Column:
    return F.when(text.rlike(COMMON_ISO), True).otherwise(F.regexp_extract(text, ISO, 8) != "")


def _shift(wall: Column, sign: Column, hours: Column, minutes: Column, seconds: Column) -> Column:
    number = lambda x: F.coalesce(x.try_cast("int"), F.lit(0))
    return wall - F.make_dt_interval(secs=F.when(sign == "-", -1).otherwise(1) * (number(hours) * 3600 + number(minutes) * 60 + number(seconds)))


def _iso_parts(text: Column) -> Column:
    """UTC of any ISO form: one match takes all parts, which are then bound once."""
    matched = F.split(F.regexp_replace(F.when(text.rlike(ISO), text), ISO, "$1,$2,$3,$4,$5,$6,$7,$8"), ",")

    def instant(p: Column) -> Column:
        two = lambda i: F.when(p[i] == "", "00").otherwise(p[i])
        wall = F.concat(p[0], F.lit("-"), p[1], F.lit("-"), p[2], F.lit(" "), two(3), F.lit(":"), two(4), F.lit(":"), two(5), F.lit("."), F.substring(F.rpad(p[6], 6, "0"), 1, 6))
        zone = F.regexp_replace(p[7], ":", "")
        return _shift(wall.try_cast("timestamp_ntz"), F.substring(zone, 1, 1), F.substring(zone, 2, 2), F.substring(zone, 4, 2), F.substring(zone, 6, 2))

    return F.transform(F.array(matched), instant)[0]


def iso_utc(text: Column) -> Column:
    """UTC timestamp_ntz of ISO text, an absent offset read as Z; null if it is no valid instant.

    Text of the common form is checked by one match and read by casts; other forms are taken apart.
    """
    zulu = text.endswith("Z")
    wall = F.when(zulu, F.rtrim(text, F.lit("Z"))).otherwise(F.substr(text, F.lit(1), F.length(text) - 6)).try_cast("timestamp_ntz")
    zone = F.right(text, F.lit(6))
    common = F.when(zulu, wall).otherwise(_shift(wall, F.substring(zone, 1, 1), F.substring(zone, 2, 2), F.substring(zone, 5, 2), F.lit("0")))
    return F.when(text.rlike(COMMON_ISO), common).otherwise(_iso_parts(text))


def event_id(meter: Column, instant: Column) -> Column:
    """Sixteen hex digits that identify a reading."""
    return F.substring(F.sha2(F.concat_ws("|", meter, instant), 256), 1, 16)


def derived_seed(seed: Column, label: Column) -> Column:
    """A seed for a label, from the first four bytes of a SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", seed.cast("string"), label), 256), 1, 8), 16, 10).cast("long")


def cell_key(meter: Column, day: Column, band: Column) -> Column:
    return F.concat_ws("|", meter, day.cast("string"), band)


#: Fixed values of the household demand curve: base kW, and hour, width in hours and height in kW of each bump.
DEMAND_BASE = 0.18
DEMAND_BUMPS = ((7.5, 1.3, 0.55), (13.0, 1.8, 0.30), (20.0, 1.9, 1.45))


def demand_kw(minute: Column, scale: Column | float = 1.0) -> Column:
    """Household demand at a local minute of the day."""
    hour, out = minute / F.lit(60.0), F.lit(DEMAND_BASE)
    for centre, width, height in DEMAND_BUMPS:
        z = (hour - centre) / width
        out = out + F.lit(height) * F.exp(F.lit(-0.5) * z * z)
    return out * scale


def quality_label(undetermined: Column, interpolated: Column) -> Column:
    return F.when(undetermined, "indeterminada").when(interpolated, "interpolada").otherwise("medida")
