"""A table with everything an operator must stand: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

_R = random.Random(3)
VOCABULARY = ["".join(_R.choice(["ka", "lo", "mi", "ren", "tu", "sal", "ve"]) for _ in range(_R.randint(1, 4))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + r.choice(["", "", "", ",", ".", "\n"]) for _ in range(n))


BASE = prose(160, 1)
PASSAGE = prose(70, 2)
DOCS = [
    (1, BASE), (2, BASE), (3, BASE.replace(" ", "  ", 3)), (4, BASE + " final"), (5, prose(120, 5)), (6, prose(40, 6) + " " + PASSAGE + " " + prose(30, 7)), (7, PASSAGE + " " + prose(50, 8)),
    (8, None), (9, ""), (10, " \n\t "), (None, prose(60, 9)), (None, None), (11, prose(60, 10)), (11, prose(60, 10)), (11, prose(61, 11)), (12, "uno dos"), (13, prose(20_000, 12)), (14, "é ñ ü " * 30), (15, "#" * 5000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid string, `__uid` string, fp int, seed int, length string, piece int, `__cuts` string, component_id array<int>, `doc id` string"


def documents(spark):
    rows = [(i, t, None if k % 3 else "xx", None, None, "u", f"own{k}", 1, None, "l", 2, "c", [k], None) for k, (i, t) in enumerate(DOCS)]
    return spark.createDataFrame(rows, SCHEMA)
