import itertools
import json
from datetime import datetime, timedelta

import pytest

from kilowave.functions.calendar import build, example
from kilowave.operators import energy, ingest, views
from kilowave.streaming.meter_day import day_cells, day_edges

CAL = example()
DAY = "2026-09-25"


def reading(clock, value, meter="MED-1", cabinet="CAB-07", day=DAY, offset="-03:00", **more):
    body = {"schema_version": 1, "medidor_id": meter, "cabina_id": cabinet, "instante_lectura": f"{day}T{clock}:00{offset}", "registros": [{"obis": "15.8.0", "naturaleza": "acumulado", "valor": value, "unidad": "kWh"}], "calidad": "ok"} | more
    return json.dumps({k: v for k, v in body.items() if v is not ...})


def raw(spark, values, keys=None):
    rows = [((keys[k] if keys else "MED-1").encode() if (keys is None or keys[k] is not None) else None, v.encode() if isinstance(v, str) else v, datetime(2026, 9, 25) + timedelta(seconds=k)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, "key binary, value binary, timestamp timestamp")


def run(spark, values, keys=None, calendar=CAL, **how):
    cells, bad = energy.chain(raw(spark, values, keys), calendar, **how)
    return {(str(r.fecha_local), r.franja): r for r in cells.collect()}, [(r.medidor_id, r.motivo) for r in bad.collect()]


def test_five_reading_story(spark):
    story = [("17:40", 100.0), ("17:55", 101.5), ("18:20", 105.5), ("17:55", 101.5), ("18:00", 102.4)]
    cells, bad = run(spark, [reading(c, v) for c, v in story])
    resto, punta = cells[DAY, "resto"], cells[DAY, "punta"]
    assert (resto.energia_kwh, punta.energia_kwh, bad) == (2.4, 3.1, [])
    assert (resto.minutos_cubiertos, resto.interpolada, resto.separacion_maxima_minutos, resto.intervalos_usados) == (20, False, 15, 2)
    assert (punta.minutos_cubiertos, punta.interpolada, punta.separacion_maxima_minutos, punta.cabina_id) == (20, False, 20, "CAB-07")


def test_border_is_split_in_proportion(spark):
    cells, _ = run(spark, [reading("17:55", 101.5), reading("18:20", 105.5)])
    assert {k[1]: (c.energia_kwh, c.minutos_cubiertos, c.interpolada) for k, c in cells.items()} == {"resto": (0.8, 5, True), "punta": (3.2, 20, True)}


@pytest.mark.parametrize(
    ("values", "want"),
    [
        ([("16:30", 100), ("19:30", 130)], {"resto": (0.0, True, 0, 90), "punta": (0.0, True, 0, 90)}),
        ([("13:00", 100), ("16:00", 130)], {"resto": (30.0, False, 180, 0)}),
        ([("19:00", 100), ("20:00", 104), ("23:30", 120)], {"punta": (4.0, True, 60, 120), "resto": (0.0, True, 0, 90)}),
    ],
)
def test_threshold(spark, values, want):
    cells, _ = run(spark, [reading(c, v) for c, v in values])
    assert {k[1]: (c.energia_kwh, c.indeterminada, c.minutos_cubiertos, c.minutos_indeterminados) for k, c in cells.items()} == want


def test_reasons(spark):
    values = ["esto no es json", reading("08:00", 1, meter=...), reading("08:00", 1, instante_lectura="ayer"), reading("08:00", 1, offset=""), reading("08:00", 1, meter="M2", registros=None), reading("08:00", 5000, meter="M3"), reading("08:30", 12, meter="M3"), "[1]", "5", None, b"\xff\xfe", reading("09:00", "no", meter="M4"), reading("09:00", 1, instante_lectura=...)]
    keys = ["", "", "K", "K", "", "", "", "", "", "", "", "", "K2"]
    cells, bad = run(spark, values, keys)
    assert not cells
    reasons = [(None, "json_invalido")] * 5 + [(None, "sin_medidor_id"), ("MED-1", "instante_invalido"), ("MED-1", "instante_sin_huso"), ("M2", "sin_registro_util"), ("M3", "contador_retrocede"), ("M4", "sin_registro_util"), ("MED-1", "instante_invalido")]
    assert sorted(map(str, bad)) == sorted(map(str, reasons))


def test_contract_profile(spark):
    values = [reading("08:00", 1, schema_version=9, meter="A"), reading("08:00", 1, publicado_at=f"{DAY}T07:00:00-03:00", meter="B"), reading("08:00", 1, registros=[], meter="C"), reading("08:00", 1, registros=[{"obis": "15.8.0", "valor": 1}] * 2, meter="D"), reading("08:00", 1, calidad="truncada", meter="E"), reading("08:00", 1, meter="F"), reading("08:00", 2, meter="F")]
    _, bad = run(spark, values, perfil="contrato")
    assert sorted(bad) == [("A", "version_desconocida"), ("B", "instante_futuro"), ("C", "sin_registros"), ("D", "obis_duplicado"), ("E", "trama_truncada"), ("F", "duplicado_divergente")]
    with pytest.raises(ValueError, match="perfil"):
        run(spark, values, perfil="otro")


@pytest.mark.parametrize("order", list(itertools.permutations([("08:00", 100), ("08:30", 5), ("09:00", 106)])))
def test_falling_counters_do_not_depend_on_order(spark, order):
    cells, bad = run(spark, [reading(c, v) for c, v in order])
    assert cells[DAY, "resto"].energia_kwh == 101 and [m for _, m in bad] == ["contador_retrocede"]


def test_one_instant_in_two_zones_is_one_reading(spark):
    cells, _ = run(spark, [reading("08:00", 100), reading("08:30", 103), reading("11:30", 103, offset="Z")])
    assert (cells[DAY, "resto"].energia_kwh, cells[DAY, "resto"].intervalos_usados) == (3, 1)


def test_midnight(spark):
    values = [reading("23:50", 100), reading("00:10", 102, day="2026-09-26")]
    assert run(spark, values)[0] == {}
    cells, _ = run(spark, values, cruzar_medianoche=True)
    assert {k: c.energia_kwh for k, c in cells.items()} == {(DAY, "resto"): 1.0, ("2026-09-26", "valle"): 1.0}


def test_meters_stay_apart_and_key_is_fallback(spark):
    cells, bad = run(spark, [reading("08:00", 1, meter=...), reading("08:30", 2, meter=...), reading("08:15", 9, meter="M2")], ["K", "K", "K"])
    assert [c.medidor_id for c in cells.values()] == ["K"] and not bad


def test_jump_limit(spark):
    df = spark.sql("SELECT 'M' AS medidor_id, 'C' AS cabina_id, timestamp_ntz'2026-09-25 12:00:00' + make_dt_interval(0, id) AS instante, double(id * 100) AS valor, id AS llegada FROM range(3)")
    assert energy.cells(df, CAL, salto_maximo_kw=50).count() == 0 and energy.cells(df, CAL, salto_maximo_kw=500).count() == 1


def test_messages_views_and_comparison(spark):
    cells, _ = energy.chain(raw(spark, [reading("17:40", 100.0), reading("17:55", 101.5)]), CAL)
    sent = views.split_contract(views.serialise(cells)).collect()
    assert [(r.clave, r.propia) for r in sent] == [(f"MED-1|{DAY}|resto", True)]
    assert json.loads(sent[0].texto) == {"energia_kwh": 1.5, "minutos_cubiertos": 15.0, "minutos_indeterminados": 0.0, "interpolada": False, "indeterminada": False, "separacion_maxima_minutos": 15.0, "cabina_id": "CAB-07", "intervalos_usados": 1}
    row = views.rows(cells, build({"zona_horaria": "UTC", "franjas": [{"nombre": "otra", "rangos": [{"desde": "00:00", "hasta": "24:00"}]}]})).first()
    assert row.calidad == "medida" and row.error_pct is None
    bad = spark.createDataFrame([(b'{"motivo": "x"}',), (b"{}",), (b"no",)], "value binary")
    assert sorted(r.motivo for r in views.reason_of(bad).collect()) == ["json ilegible", "sin motivo", "x"]


def test_stream_arithmetic_is_the_batch_arithmetic(spark):
    import random

    r = random.Random(4)
    for case in range(3):
        at = sorted(r.sample(range(1440), 40))
        values = list(itertools.accumulate(r.uniform(-0.2, 3) for _ in at))
        rows = [("M", f"C{k % 3}", datetime(2026, 9, 25, 3) + timedelta(minutes=m), v, k) for k, (m, v) in enumerate(zip(at, values, strict=True))]
        batch = {x.franja: x for x in energy.cells(spark.createDataFrame(rows, "medidor_id string, cabina_id string, instante timestamp_ntz, valor double, llegada long"), CAL).collect()}
        us = lambda t: round((t - datetime(1970, 1, 1)).total_seconds() * 1e6)
        day, edges = day_edges(CAL, us(datetime(2026, 9, 25, 3)))
        cells, _ = day_cells([(us(t), v, c) for _, c, t, v, _ in rows], edges, 90 * 60_000_000)
        assert day == "2026-09-25" and cells.keys() == batch.keys()
        for band, c in cells.items():
            for k, v in c.items():
                assert getattr(batch[band], k) == (pytest.approx(v, abs=2e-6) if isinstance(v, float) else v), (case, band, k)


def test_plan_has_one_exchange_before_the_aggregation(spark):
    df = spark.sql("SELECT 'M' AS medidor_id, 'C' AS cabina_id, timestamp_ntz'2026-09-25 12:00:00' AS instante, double(1) AS valor, id AS llegada FROM range(3)")
    plan = energy.difference(energy.deduplicate(ingest.with_day(df, CAL)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 2 and "Python" not in plan
