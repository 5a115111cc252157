"""Chat formatting: token-level assembly of conversations.

Each turn's role and text are encoded on their own by a byte-level vocabulary, and reserved ids beyond it are spliced
in between, so no text can produce a control id; the loss mask is the running sum of +1 where an assistant's text
begins and -1 where it ends. In the formatted text the reserved ids are the strings of CONTROLS; where such a
string occurs in a text, a marker is put after its first character, and markers in texts are doubled, so
the text form is reversible as well.

    <s>  [INST] user [/INST]  [ANS] assistant </s>  [SYS] system [/SYS]  [ROLE] any other role [BODY] text [/ROLE]

(without the spaces; <s> once, at the start).

Scale: turns are encoded before the shuffle and streamed in order after it; a conversation passes through as sorted rows
and is never held as a whole, so its length is not bounded by memory. Ids and masks travel as bytes; a formatted table that is
still in the order it was made in is read back without another shuffle.

Defined cases: null texts and roles are empty; a null conv_id is a conversation of its own; turns go by turn
(null first), then role, then ids, which settles ties; repeated rows are turns each; very long texts are turns like others, and a very
long conversation is read turn by turn; an empty table gives an empty result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import bounded_batches, slices

#: Control strings in the order of their reserved ids.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ANS]", "[ROLE]", "[BODY]", "[/ROLE]")
FIRST_RESERVED = 50257
ID = {c: FIRST_RESERVED + i for i, c in enumerate(CONTROLS)}
#: Opening and closing control of each role; any other goes by [ROLE].
TURNS = {"user": ("[INST]", "[/INST]"), "system": ("[SYS]", "[/SYS]"), "assistant": ("[ANS]", "</s>")}
MARK = "␛"
_IN_TEXT = re.compile("|".join(map(re.escape, CONTROLS)) + "|" + MARK)
_MARKED = re.compile(MARK + "([01])")

#: A formatted turn; ids: little-endian unsigned 32-bit numbers, loss: a byte a token.
SEGMENT = "conv_id long, seq long, start long, ids binary, loss binary"


def escape(text: str) -> str:
    return _IN_TEXT.sub(lambda m: MARK + "0" if m[0] == MARK else m[0][0] + MARK + "1" + m[0][1:], text)


def unescape(text: str) -> str:
    return _MARKED.sub(lambda m: MARK if m[1] == "0" else "", text)


@cache
def _tokenizer(path: str) -> Tokenizer:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return t


def token_bytes(t: Tokenizer) -> dict[int, bytes]:
    """The bytes of each id of a byte-level vocabulary. In its token strings a printable Latin-1 byte is the character of its number, the others are those from 256 on."""
    plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 255 and c != 173]
    byte_of = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
    added = t.get_added_tokens_decoder()
    return {i: added[i].content.encode() if i in added else bytes(map(byte_of.__getitem__, s)) for s, i in t.get_vocab().items()}


@cache
def _table(path: str) -> dict[int, bytes]:
    return token_bytes(_tokenizer(path))


def as_bytes(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def assemble(role: str, role_ids: bytes, text_ids: bytes) -> tuple[bytes, bytes]:
    """Ids of a turn, and its loss mask."""
    if role in TURNS:
        opening, closing = (as_bytes([ID[c]]) for c in TURNS[role])
    else:
        opening, closing = as_bytes([ID["[ROLE]"]]) + role_ids + as_bytes([ID["[BODY]"]]), as_bytes([ID["[/ROLE]"]])
    ids = opening + text_ids + closing
    step = np.zeros(len(ids) // 4 + 1, np.int8)
    if role == "assistant":
        step[len(opening) // 4] += 1
        step[(len(opening) + len(text_ids)) // 4] -= 1
    return ids, np.cumsum(step[:-1], dtype=np.int8).tobytes()


def _vocabulary(path: str | None) -> str:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    return path


def format_conversations(turns: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """A row per turn, in order within its conversation: (conv_id, seq, start, ids, loss); start is the tokens before it."""
    path = _vocabulary(vocabulary)
    bounded_batches(turns.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _tokenizer(path)
        for batch in slices(batches, "text"):
            roles = [r or "" for r in batch.column("role").to_pylist()]
            texts = [escape(t or "") for t in batch.column("text").to_pylist()]
            names = {r: as_bytes(coder.encode(escape(r), add_special_tokens=False).ids) for r in set(roles)}
            made = [assemble(r, names[r], as_bytes(e.ids)) for r, e in zip(roles, coder.encode_batch_fast(texts, add_special_tokens=False), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(roles, pa.string()), pa.array([i for i, _ in made], pa.binary()), pa.array([m for _, m in made], pa.binary())],
                ["conv_id", "turn", "role", "ids", "loss"],
            )

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seq, at, begin = object(), 0, 0, as_bytes([ID["<s>"]])
        for batch in batches:
            seqs, starts, ids, loss = [], [], [], []
            for c, i, m in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "ids", "loss")), strict=True):
                if not seq or c != now:
                    now, seq, at = c, 0, 0
                    i, m = begin + i, b"\0" + m
                seqs.append(seq), starts.append(at), ids.append(i), loss.append(m)
                seq, at = seq + 1, at + len(m)
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), pa.array(seqs, pa.int64()), pa.array(starts, pa.int64()), pa.array(ids, pa.binary()), pa.array(loss, pa.binary())], ["conv_id", "seq", "start", "ids", "loss"]
            )

    rows = turns.select(*(F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))))
    coded = rows.mapInArrow(encode, "conv_id long, turn long, role string, ids binary, loss binary")
    return coded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "ids").mapInArrow(number, SEGMENT)


def _read_turn(table: dict[int, bytes], ids: bytes, loss: bytes) -> tuple[str, str, str, int]:
    """Role, text and text under the loss mask of a formatted turn, and its code points as text."""
    own = np.frombuffer(ids, "<u4")
    plain = lambda part: b"".join(map(table.__getitem__, part.tolist())).decode(errors="replace")
    at = np.flatnonzero(own >= FIRST_RESERVED).tolist()
    controls = [CONTROLS[own[k] - FIRST_RESERVED] for k in at]
    size = sum(map(len, controls))
    if controls[0] == "<s>":
        at, controls = at[1:], controls[1:]
    first, last = at[-2] + 1, at[-1]
    body = plain(own[first:last])
    if controls[0] == "[ROLE]":
        name = plain(own[at[0] + 1 : at[1]])
        role, size = unescape(name), size + len(name)
    else:
        role = next(r for r, (a, _) in TURNS.items() if a == controls[0])
    text = unescape(body)
    learned = np.flatnonzero(np.frombuffer(loss, np.int8))
    whole = len(learned) and len(learned) == last - first and learned[0] == first and learned[-1] == last - 1
    return role, text, text if whole else unescape(plain(own[learned])), size + len(body)


def read_back(formatted: DataFrame, vocabulary: str | None = None, in_order: bool = False) -> DataFrame:
    """What the formatted turns say: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation.

    in_order: formatted is as format_conversations made it, each conversation in one partition and in order.
    """
    path = _vocabulary(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, now, n = _table(path), None, 0
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def done() -> pa.RecordBatch:
            row = (now, n, turns.hexdigest(), under, loss.hexdigest(), size)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

        for batch in batches:
            for c, seq, i, m in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "seq", "ids", "loss")), strict=True):
                if seq == 0:
                    if n:
                        yield done()
                    now, n, under, size, turns, loss = c, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                role, text, learned, chars = _read_turn(coder, i, m)
                turns.update(f"{role}\n{text}\n".encode())
                loss.update(learned.encode())
                n, under, size = n + 1, under + len(learned), size + chars
        if n:
            yield done()

    dealt = formatted if in_order else formatted.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return dealt.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op7_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7, formatted and read back."""
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return read_back(format_conversations(turns.unionByName(own)), in_order=True)



def _size_sql() -> str:
    """Code points of an escaped text in SQL."""
    grown = " + ".join(f"2 * ((length({{0}}) - length(replace({{0}}, '{c}', ''))) // {len(c)})" for c in CONTROLS)
    return f"(length({{0}}) + {grown} + length({{0}}) - length(replace({{0}}, '{MARK}', '')))"


OP7_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(3 + sum({_size_sql().format("text")} + CASE {" ".join(f"WHEN role = '{r}' THEN {len(a) + len(b)}" for r, (a, b) in TURNS.items())} ELSE {len("[ROLE][BODY][/ROLE]")} + {_size_sql().format("role")} END) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
