"""Chat formatting: the turns of a conversation become one string with marked turns and a loss mask.

A batch of turns is assembled by columns: segments (marker, role, marker, text, marker) have lengths and cumulative
offsets, and one gather copies all their bytes into one preallocated Arrow buffer. In roles and texts a backslash
follows each byte that a marker or a common control string could begin with, so no control string survives inside a
text, and reading back is exact.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, MIDDLE, CLOSE = b"<|turn|>", b"<|text|>", b"<|end|>\n"
SPECIAL = b"<[\\"
TRAINED_ROLE = "assistant"
TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.DOTALL)
_INSERTED = re.compile(r"([<\[\\])\\")
_ESCAPED = np.zeros(256, dtype=bool)
_ESCAPED[list(SPECIAL)] = True


def unescape(text: str) -> str:
    return _INSERTED.sub(r"\1", text)


def escaped(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column with a backslash after each special byte; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]]
    special = _ESCAPED[raw]
    before = np.concatenate([[0], np.cumsum(special)])
    out = np.full(len(raw) + before[-1], ord("\\"), dtype=np.uint8)
    out[np.arange(len(raw)) + before[:-1]] = raw
    at = at - at[0]
    return out, at + before[at]


def assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Formatted strings and loss spans (code points) of consecutive conversations; conv: where each begins, and the end."""
    n = len(roles)
    role_bytes, role_at = escaped(roles)
    text_bytes, text_at = escaped(texts)
    marks = OPEN + MIDDLE + CLOSE
    pool = np.concatenate([np.frombuffer(marks, dtype=np.uint8), role_bytes, text_bytes])
    source = np.empty((n, 5), dtype=np.int64)
    length = np.empty((n, 5), dtype=np.int64)
    source[:, 0], length[:, 0] = 0, len(OPEN)
    source[:, 1], length[:, 1] = len(marks) + role_at[:-1], np.diff(role_at)
    source[:, 2], length[:, 2] = len(OPEN), len(MIDDLE)
    source[:, 3], length[:, 3] = len(marks) + len(role_bytes) + text_at[:-1], np.diff(text_at)
    source[:, 4], length[:, 4] = len(OPEN) + len(MIDDLE), len(CLOSE)
    flat = length.ravel()
    offset = np.concatenate([[0], np.cumsum(flat)])
    buffer = pa.allocate_buffer(int(offset[-1]))
    out = np.frombuffer(buffer, dtype=np.uint8)
    np.take(pool, np.arange(offset[-1]) - np.repeat(offset[:-1] - source.ravel(), flat), out=out)
    bounds = offset[conv * 5]
    formatted = pa.Array.from_buffers(pa.large_string(), len(conv) - 1, [None, pa.py_buffer(bounds.astype(np.int64)), buffer])
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    trained = np.flatnonzero(np.array(pc.fill_null(pc.equal(roles, TRAINED_ROLE), False)))
    home = np.searchsorted(conv, trained, "right") - 1
    begin = points[bounds[home]]
    spans = pa.StructArray.from_arrays([pa.array(points[offset[trained * 5 + k]] - begin) for k in (3, 4)], ["start", "end"])
    upto = np.searchsorted(home, np.arange(len(conv)))
    return formatted.cast(pa.string()), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), spans)


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, formatted, loss) for each conversation; loss: code point spans of the assistant texts, end exclusive.

    Turns stand in order of `turn` (null first), then role, then text; repeated turns repeat. Null roles and texts are
    empty. Rows with a null conv_id are one conversation. Other columns are left out; an empty table gives none.
    """
    kind = turns.select(F.col(conv_id)).schema[0].dataType.simpleString()
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def finished(table: pa.Table, last: bool):
        """Formats all conversations but, unless it is the last batch, the one that may go on."""
        ids = table.column("conv_id").combine_chunks()
        code = np.asarray(pc.fill_null(pc.dictionary_encode(ids).indices, -1))
        begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        whole = len(code) if last else begins[-1]
        if not whole:
            return None, table
        conv = np.concatenate([begins[begins < whole], [whole]])
        done = table.slice(0, whole)
        formatted, loss = assemble(conv, *(done.column(c).combine_chunks() for c in ("role", "text")))
        return pa.table({"conv_id": ids.take(pa.array(conv[:-1])), "formatted": formatted, "loss": loss}), table.slice(whole)

    def run(batches):
        rest = None
        for b in batches:
            if not b.num_rows:
                continue
            table = pa.Table.from_batches([b])
            table = table if rest is None else pa.concat_tables([rest, table])
            done, rest = finished(table, False)
            yield from done.to_batches() if done else ()
        if rest is not None:
            yield from finished(rest, True)[0].to_batches()

    return ordered.mapInArrow(run, f"conv_id {kind}, formatted string, loss array<struct<start:long,end:long>>")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in TURN.findall(formatted)]
