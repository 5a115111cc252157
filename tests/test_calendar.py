import copy

import pytest
from pyspark.sql import functions as F

from kilowave.functions import calendar as C
from kilowave.functions import scalars as S

CAL = C.example()
DATA = {"zona_horaria": "America/Asuncion", "franjas": [{"nombre": "valle", "rangos": [{"desde": "00:00", "hasta": "07:00"}]}, {"nombre": "resto", "rangos": [{"desde": "07:00", "hasta": "18:00"}, {"desde": "22:00", "hasta": "24:00"}]}, {"nombre": "punta", "rangos": [{"desde": "18:00", "hasta": "22:00"}]}]}


def test_durations_cover_the_day():
    assert {f: CAL.duration(f) for f in CAL.franjas} == {"valle": 420, "resto": 780, "punta": 240}
    assert CAL.separacion_maxima == 90 and C.build(DATA).separacion_maxima == 45


@pytest.mark.parametrize(
    ("change", "said"),
    [
        (lambda d: d.pop("zona_horaria"), "zona_horaria"),
        (lambda d: d.update(zona_horaria="America/Inventada"), "Inventada"),
        (lambda d: d.update(franjas=[]), "franjas"),
        (lambda d: d["franjas"][0].pop("nombre"), "nombre"),
        (lambda d: d["franjas"][1].update(nombre="valle"), "repetidas"),
        (lambda d: d["franjas"][0]["rangos"][0].update(hasta="00:00"), "no avanza"),
        (lambda d: d["franjas"][0]["rangos"][0].update(hasta="6pm"), "6pm"),
        (lambda d: d["franjas"][0]["rangos"][0].update(hasta="06:00"), "hueco"),
        (lambda d: d["franjas"][1]["rangos"][1].update(hasta="23:00"), "hueco"),
        (lambda d: d["franjas"][2]["rangos"][0].update(desde="17:00"), "17:00"),
    ],
)
def test_bad_calendars_say_why(change, said):
    data = copy.deepcopy(DATA)
    change(data)
    with pytest.raises(C.CalendarError, match=said):
        C.build(data)


def test_missing_and_broken_files(tmp_path):
    with pytest.raises(C.CalendarError, match="no se encuentra"):
        C.load(tmp_path / "none.toml")
    (tmp_path / "bad.toml").write_text("a = [")
    with pytest.raises(C.CalendarError, match="TOML"):
        C.load(tmp_path / "bad.toml")


def test_bands_and_edges(spark):
    want = {180: "valle", 419: "valle", 420: "resto", 1079: "resto", 1080: "punta", 1319: "punta", 1320: "resto", 1439: "resto", 0: "valle"}
    edges = {1170: 1320, 180: 420, 1380: 1440}
    rows = spark.createDataFrame([(m,) for m in {*want, *edges}], "m int").select("m", CAL.band(F.col("m")).alias("b"), CAL.edge(F.col("m")).alias("e")).collect()
    for r in rows:
        assert r.b == want.get(r.m, r.b) == CAL.band_at(r.m) and r.e == edges.get(r.m, r.e) == CAL.next_edge(r.m)


def test_local_date_is_not_the_utc_date(spark):
    r = spark.sql("SELECT timestamp_ntz'2026-09-23 02:00:00' AS t").select(CAL.local(F.col("t")).alias("l")).first()
    assert str(r.l) == "2026-09-22 23:00:00"


@pytest.mark.parametrize(
    ("text", "utc", "offset"),
    [
        ("2026-09-22T08:00:00-03:00", "2026-09-22 11:00:00", True), ("2026-09-22T11:00:00Z", "2026-09-22 11:00:00", True), ("2026-09-22 08:00-03", "2026-09-22 11:00:00", True), ("20260922T080000-0300", "2026-09-22 11:00:00", True),
        ("2026-09-22T08:00:00.25+05:30", "2026-09-22 02:30:00.250000", True), ("2026-09-22T08:00:00", "2026-09-22 08:00:00", False), ("2026-09-22", "2026-09-22 00:00:00", False), ("ayer", None, False), ("2026-13-22T08:00:00Z", None, True), (None, None, None),
    ],
)
def test_iso(spark, text, utc, offset):
    r = spark.createDataFrame([(text,)], "t string").select(S.iso_utc(F.col("t")).alias("u"), S.iso_has_offset(F.col("t")).alias("o")).first()
    assert (str(r.u) if r.u else None) == utc and r.o == offset


def test_golden_seeds_and_ids(spark):
    r = spark.range(1).select(S.derived_seed(F.lit(2026), F.lit("MED-0001-000")).alias("a"), S.derived_seed(F.lit(2026), F.lit("CAB-0000")).alias("b"), S.event_id(F.lit("M"), F.lit("x")).alias("c")).first()
    assert (r.a, r.b, len(r.c)) == (2066509163, 221036554, 16)
