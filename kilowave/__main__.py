"""python -m kilowave serve | replay IN OUT | simulate OUT | publish | board FOLDER | demo: the service, its tools and a demonstration that checks itself."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime
from zoneinfo import ZoneInfo

from pyspark.sql import SparkSession
from pyspark.sql import functions as F


def demo(spark: SparkSession) -> list[str]:
    """Five readings of one meter (a repeated one, a late one on the edge of a band) through the service; what differs from what is known of them."""
    from . import service
    from .functions.calendar import example
    from .operators import views
    from .sources import injector
    from .sources.files import scratch

    calendar, top = example(), scratch(spark)
    sent = injector.play(["normal", "normal", "normal", "duplicado", "tardia"], datetime(2026, 9, 30, tzinfo=ZoneInfo(calendar.zona)))
    for k, one in enumerate(sent):
        injector.records(spark, [one]).withColumn("timestamp", F.expr(f"timestamp + interval {k} seconds")).coalesce(1).write.mode("append").parquet(f"{top}/in")
    counted = service.replay(spark, service.folder_source(spark, f"{top}/in", 1), calendar, f"{top}/out")
    table = views.board(service.current(service.read_messages(spark, f"{top}/out/consumo")), calendar)
    table.show(truncate=False)
    got = {r.franja: r.energia_kwh for r in table.collect()}
    checks = {"celdas": got == {"resto": 1.0, "punta": 0.8}, "total": round(sum(got.values()), 3) == 1.8, "cuarentena": not counted.get("mensajes_cuarentena"), "revisiones": counted.get("mensajes_consumo", 0) > len(got)}
    return [name for name, ok in checks.items() if not ok]


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    from . import service
    from .functions.calendar import load
    from .operators import views
    from .sources import simulator
    from .sources.files import write_lines
    from .sources.settings import Settings, with_headers, write_kafka

    parser = argparse.ArgumentParser(prog="kilowave", description=__doc__)
    kinds = parser.add_subparsers(dest="what", required=True)
    kinds.add_parser("serve", help="topics to topics, by the environment's settings")
    kinds.add_parser("demo")
    again = kinds.add_parser("replay", help="a folder of raw records from its beginning")
    again.add_argument("entrada"), again.add_argument("salida")
    shown = kinds.add_parser("board", help="the current cells of a folder of messages")
    shown.add_argument("carpeta")
    for name in ("simulate", "publish"):
        made = kinds.add_parser(name, help="simulated readings to JSON lines, or to the topic of readings")
        if name == "simulate":
            made.add_argument("salida")
        made.add_argument("--escenario", choices="AB", default="A")
        made.add_argument("--cabinas", type=int, default=20)
        made.add_argument("--dias", type=int, default=1)
        made.add_argument("--semilla", type=int, default=2026)
        made.add_argument("--inicio", type=datetime.fromisoformat, default=None)
        made.add_argument("--perfecto", action="store_true")
    a = parser.parse_args(arguments)
    settings = Settings.from_environment()
    spark = spark or SparkSession.builder.appName("kilowave").getOrCreate()
    if a.what == "demo":
        wrong = demo(spark)
        print("bien" if not wrong else f"mal: {', '.join(wrong)}")
        return int(bool(wrong))
    calendar = load(settings.calendario)
    if a.what == "serve":
        print(service.on_topics(spark, settings, calendar))
    elif a.what == "replay":
        print(service.replay(spark, service.folder_source(spark, a.entrada), calendar, a.salida))
    elif a.what == "board":
        views.board(service.current(service.read_messages(spark, a.carpeta)), calendar).show(1000, truncate=False)
    else:
        start = a.inicio or datetime.now(ZoneInfo(calendar.zona)).replace(hour=0, minute=0, second=0, microsecond=0)
        start = start if start.tzinfo else start.replace(tzinfo=ZoneInfo(calendar.zona))
        sent = simulator.scenario(spark, a.escenario, a.cabinas, start, a.dias, a.semilla, simulator.Faults.none() if a.perfecto else simulator.Faults())
        sent = sent.orderBy("publicado_us", "cabina_id", "orden")
        if a.what == "simulate":
            write_lines(sent, a.salida)
        else:
            write_kafka(with_headers(sent), settings, settings.topico_lecturas)
    return 0


if __name__ == "__main__":
    sys.exit(main())
