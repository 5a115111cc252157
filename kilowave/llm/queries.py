"""Queries of the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from .chat import OP7_SQL, op7_chat
from .decontamination import OP8_SQL, op8_decontamination
from .html_extraction import op2_html_extraction
from .language_id import op5_language_id
from .near_dedup import op3_near_dedup
from .packing import op4_packing
from .passages import op6_substring_dedup
from .quality_model import op10_quality_classifier
from .quality_rules import OP9_SQL, op9_quality_rules
from .sharding import op1_sharding

QUERIES = {q.__name__: q for q in (op1_sharding, op2_html_extraction, op3_near_dedup, op4_packing, op5_language_id, op6_substring_dedup, op7_chat, op8_decontamination, op9_quality_rules, op10_quality_classifier)}
SQL: dict[str, str] = {"op7_chat": OP7_SQL, "op8_decontamination": OP8_SQL, "op9_quality_rules": OP9_SQL}
