import itertools
import json
from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from kilowave.functions.calendar import example
from kilowave.operators import energy
from kilowave.sources import files, injector, simulator
from kilowave.sources.settings import Settings, kafka_options, with_headers
from kilowave.streaming import meter_day

from .test_energy import reading

CAL = example()
ZONE = ZoneInfo(CAL.zona)
RAW = "key binary, value binary, timestamp timestamp"


def stream(spark, tmp_path, batches):
    """Runs the stream over a file a batch; the revisions in order, and the current cells."""
    import time

    from kilowave.streaming.meter_day import configure

    configure(spark)
    for k, values in enumerate(batches):
        rows = [(b"MED-1", v.encode(), datetime(2026, 9, 25, 0, 0, k)) for v in values]
        spark.createDataFrame(rows, RAW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    raw = spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    meter_day.run_to_folder(meter_day.stream_chain(raw, CAL), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    out = spark.read.schema(meter_day.OUT + ", lote long").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/out")
    return out.orderBy("lote", "franja").collect(), {r.franja: r for r in meter_day.current_cells(spark, f"{tmp_path}/out").collect()}


def test_story_by_stream_then_restart(spark, tmp_path):
    story = [("17:40", 100.0), ("17:55", 101.5), ("18:20", 105.5), ("17:55", 101.5)]
    rows, cells = stream(spark, tmp_path, [[reading(c, v)] for c, v in story])
    assert [(r.franja, json.loads(r.celda)["energia_kwh"]) for r in rows] == [("resto", 1.5), ("punta", 3.2), ("resto", 2.3)]
    rows, cells = stream(spark, tmp_path, [[reading("18:00", 102.4)]])  # goes on from the checkpoint
    assert len(rows) == 5 and (cells["resto"].energia_kwh, cells["punta"].energia_kwh) == (2.4, 3.1)


def test_late_split_vanished_cells_and_falls(spark, tmp_path):
    rows, cells = stream(spark, tmp_path, [[reading("16:30", 100), reading("19:30", 130)], [reading("17:30", 90)], ["no json"]])
    assert {(r.destino, r.motivo) for r in rows} == {("consumo", None), ("cuarentena", "contador_retrocede")}
    assert all(c.indeterminada for c in cells.values()) and cells["resto"].minutos_indeterminados == 30
    rows, cells = stream(spark, tmp_path / "two", [[reading("16:30", 100), reading("17:00", 130)], [reading("16:45", 10)], [reading("16:50", 5), reading("16:55", 4), reading("17:00", 1)]])
    assert cells["resto"].energia_kwh == 126


def test_a_cell_that_vanishes_is_retracted(spark, tmp_path):
    rows, cells = stream(spark, tmp_path, [[reading("17:50", 100), reading("18:10", 101)], [reading("17:55", 200)]])
    assert [(r.franja, r.retirada) for r in rows if r.destino == "consumo"] == [("punta", False), ("resto", False), ("punta", True), ("resto", False)]
    assert {f: c.energia_kwh for f, c in cells.items()} == {"resto": 100}


def test_injector_sequence(spark):
    sent = injector.play(["normal", "normal", "normal", "duplicado", "tardia"], datetime(2026, 9, 30, tzinfo=ZONE))
    assert [(f"{s.instante:%H:%M}", s.valor) for s in sent] == [("17:40", 100.0), ("17:55", 100.9), ("18:10", 101.8), ("18:10", 101.8), ("18:00", 101.0)]
    cells, bad = energy.chain(injector.records(spark, sent), CAL)
    assert {r.franja: r.energia_kwh for r in cells.collect()} == {"resto": 1.0, "punta": 0.8} and bad.count() == 0
    cells, bad = energy.chain(injector.records(spark, injector.play(["normal", "hueco", "reseteo"], datetime(2026, 9, 30, tzinfo=ZONE))), CAL)
    assert [r.motivo for r in bad.collect()] == ["contador_retrocede"] and all(r.indeterminada for r in cells.collect())
    assert injector.sends("truncada", sent[0], datetime(2026, 9, 30, tzinfo=ZONE)).calidad == "truncada"


def test_simulated_fleet_is_the_published_one(spark):
    one = simulator.fleet(spark, 3)
    assert simulator.summary(one).first().medidores == 111
    start = datetime(2026, 9, 22, tzinfo=ZONE)
    a = simulator.readings(one, start).orderBy("publicado_us", "cabina_id", "orden").collect()
    b = simulator.readings(simulator.fleet(spark, 3).repartition(5), start).orderBy("publicado_us", "cabina_id", "orden").collect()
    assert a == b and 0.01 < 1 - len({(r.medidor_id, r.instante) for r in a}) / len(a) < 0.03
    eight = [dict(zip(("cabina_id", "n", "prob_caida", "latencia", "enlace_muerto", "m"), r, strict=True)) for r in simulator.fleet_rows(8, 2026)]
    marks = [q for c in eight for _, _, (*_, q, _) in simulator.cabinet_readings(c | {"medidores": [dict(zip(("medidor_id", "posicion", "modelo", "inicial", "escala"), m, strict=True)) for m in c["m"]]}, start, 1, 2026, simulator.Faults())]
    for quality, share in {"ok": 36.1, "checksum_no_verificado": 63.2, "truncada": 0.7}.items():
        assert 100 * marks.count(quality) / len(marks) == pytest.approx(share, abs=0.6)


def test_perfect_world_and_scenario_b(spark):
    start = datetime(2026, 9, 22, tzinfo=ZONE)
    b = simulator.scenario(spark, "B", 2, start, faults=simulator.Faults.none())
    per = b.groupBy("medidor_id").count().collect()
    assert {r["count"] for r in per} == {96} and b.where("calidad = 'truncada'").count() == 0
    values = [r.valor for r in b.where("medidor_id = 'MED-0000-000'").orderBy("instante").collect()]
    assert values == sorted(values)
    raw = b.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.timestamp_micros("publicado_us").alias("timestamp"))
    cells, bad = energy.chain(raw, CAL)
    assert bad.count() == 0 and cells.where("indeterminada").count() == 0
    with pytest.raises(ValueError, match="escenario"):
        simulator.scenario(spark, "C", 1, start)
    with pytest.raises(ValueError, match="zona"):
        simulator.readings(simulator.fleet(spark, 1), datetime(2026, 1, 1))


def test_files_headers_and_settings(spark, tmp_path):
    values = [reading("17:40", 100.0), reading("17:55", 101.5)]
    files.write_lines(spark.createDataFrame([(v,) for v in values], "value string"), f"{tmp_path}/lines")
    cells, _ = energy.chain(files.read_lines(spark, f"{tmp_path}/lines"), CAL)
    assert cells.first().energia_kwh == 1.5
    files.write_plan(cells, f"{tmp_path}/plan")
    assert "Exchange" in "".join(r.value for r in spark.read.text(f"{tmp_path}/plan").collect())
    h = with_headers(spark.createDataFrame([("M", "{}", "L", "x")], "key string, value string, lote_id string, instante string")).first()
    assert [x.key for x in h.headers] == ["schema_version", "content_type", "trace_id"] and len(h.headers[2].value) == 16
    s = Settings.from_environment({"KAFKA_BOOTSTRAP_SERVERS": "k:1", "PARALELISMO": "3"})
    assert (s.servidores, s.particiones, kafka_options(s, "t", False)["kafka.acks"]) == ("k:1", 3, "all")


def test_truncation_stays_a_number():
    import random

    for k, v in itertools.product(range(20), (1.0, 12.345, 14380.81)):
        assert simulator.truncate(v, random.Random(k)) <= v + 1e-9


def test_service_restart_quarantine_and_late_rows(spark, tmp_path):
    from functools import partial

    from kilowave import service
    from kilowave.__main__ import main

    def put(k, rows):
        spark.createDataFrame([(b"MED-1", v.encode(), t) for v, t in rows], RAW).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    on = datetime(2026, 9, 25, 21)
    put(0, [(reading("17:40", 100.0), on), ("no json", on), (reading("17:55", 101.5), on)])
    run = partial(service.run, service.folder_source(spark, f"{tmp_path}/in"), partial(service.chain, calendar=CAL, separar_tardias=True), service.folder_sink(f"{tmp_path}/c"), service.folder_sink(f"{tmp_path}/q"), f"{tmp_path}/checkpoint")
    assert run()["mensajes_cuarentena"] == 1
    put(1, [(reading("18:20", 105.5), on), (reading("18:30", 1.0), on), (reading("19:00", 106.0), datetime(2026, 9, 29))])
    counted = run()
    assert counted["mensajes_consumo"] == 2 and counted["mensajes_cuarentena"] == 2
    cells = {r.clave.split("|")[2]: json.loads(r.texto)["energia_kwh"] for r in service.current(service.read_messages(spark, f"{tmp_path}/c")).collect()}
    assert cells == {"resto": 2.3, "punta": 3.2}
    bad = [json.loads(r.value) for r in service.read_messages(spark, f"{tmp_path}/q").collect()]
    assert {b["motivo"] for b in bad} == {"json_invalido", "contador_retrocede", "fuera_de_horizonte"}
    assert next(b for b in bad if b["motivo"] == "json_invalido")["bytes"] == b"no json".hex().upper()
    same = service.run(service.folder_source(spark, f"{tmp_path}/in"), service.passthrough, service.folder_sink(f"{tmp_path}/p"))
    assert same["mensajes_consumo"] == 6 == service.read_messages(spark, f"{tmp_path}/p").count()
    assert service.read_messages(spark, f"{tmp_path}/none").count() == 0
    assert main(["demo"], spark) == 0


def test_cli_simulates_lines(spark, tmp_path):
    from kilowave.__main__ import main

    assert main(["simulate", f"{tmp_path}/lines", "--cabinas", "1", "--inicio", "2026-09-22", "--perfecto"], spark) == 0
    lines = [json.loads(r.value) for r in spark.read.text(f"{tmp_path}/lines").collect()]
    assert lines and {x["instante_lectura"][-6:] for x in lines} == {"-03:00"}
    assert [x["publicado_at"] for x in lines] == sorted(x["publicado_at"] for x in lines)


def test_a_key_that_is_no_utf8_and_ties(spark):
    from kilowave.operators import ingest

    body = json.loads(reading("17:40", 100.0))
    body.pop("medidor_id", None)
    rows = [(b"M\xff", json.dumps(body).encode(), datetime(2026, 9, 25)), (b"M\xff", json.dumps(body).replace("100.0", "90.0").encode(), datetime(2026, 9, 25))]
    for own in (rows, rows[::-1]):
        good = ingest.good(ingest.ingest(energy.with_arrival(spark.createDataFrame(own, RAW))))
        once = energy.deduplicate(ingest.with_day(good, CAL)).collect()
        assert [(r.medidor_id, r.valor) for r in once] == [("M\ufffd", 90.0)]
