"""Schemas of events, readings, cells and quarantine rows."""

from __future__ import annotations

#: A reading as it is parsed: numbers as text, so that a bad one is judged here and not by the JSON reader.
EVENT = (
    "schema_version string, event_id string, medidor_id string, cabina_id string, lote_id string, secuencia string, instante_lectura string, "
    "registros array<struct<obis: string, naturaleza: string, valor: string, unidad: string, instante: string>>, calidad string, publicado_at string, _corrupt string"
)
RAW = "key binary, value binary, timestamp timestamp"
READING = "medidor_id string, cabina_id string, instante timestamp_ntz, valor double, llegada long"
CELL = (
    "medidor_id string, fecha_local date, franja string, energia_kwh double, minutos_cubiertos double, minutos_indeterminados double, interpolada boolean, indeterminada boolean, "
    "separacion_maxima_minutos double, cabina_id string, intervalos_usados long"
)
CELL_VALUES = ("energia_kwh", "minutos_cubiertos", "minutos_indeterminados", "interpolada", "indeterminada", "separacion_maxima_minutos", "cabina_id", "intervalos_usados")
#: The code of the register that is a cumulative counter of energy.
ENERGY = "15.8.0"
#: Reasons for quarantine: the six of the default profile, then those of the contract profile, then the optional one.
REASONS = ("json_invalido", "sin_medidor_id", "instante_invalido", "instante_sin_huso", "sin_registro_util", "contador_retrocede")
CONTRACT_REASONS = ("version_desconocida", "instante_futuro", "sin_registros", "obis_duplicado", "trama_truncada", "duplicado_divergente")
