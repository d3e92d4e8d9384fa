"""Chat formatting by columnar byte assembly.

Turns of a conversation become one text: each turn is a header with its role, its text, and a footer. Control strings inside
roles and texts are escaped, so nothing a speaker writes can open or close a turn, and parsing gives back the very
turns. Lengths of all segments, their running offsets and the places they scatter to are computed in numpy; header, role, text and
footer bytes are then copied into one preallocated buffer, which becomes the Arrow column. Loss spans (of assistant texts) come from the same offsets.

A null text or role counts as empty, a null turn comes first; turns with equal numbers follow in order of role and text, rows that repeat a turn are turns of their own. A null
conv_id is a conversation like another. Conversations arrive sorted, and one that spans several batches is carried over and joined once, so memory is bounded by a batch and the longest
conversation. An empty table gives an empty result; extra columns are neither read nor returned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

# Marks of a turn, and control strings of common chat templates.
HEAD, MIDDLE, FOOT = "<|im_start|>", "\n", "<|im_end|>\n"
CONTROL = ("<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LOSS_ROLE = "assistant"
_UNSAFE = r"[\\]|" + "|".join(re.escape(c) for c in CONTROL)


def escape(texts: pa.Array) -> pa.Array:
    """A backslash after the first character of each control string, backslashes doubled."""
    if pc.any(pc.match_substring_regex(texts, _UNSAFE)).as_py():
        texts = pc.replace_substring(texts, "\\", "\\\\")
        for c in CONTROL:
            texts = pc.replace_substring(texts, c, f"{c[0]}\\{c[1:]}")
    return texts


def escape_role(roles: pa.Array) -> pa.Array:
    """As texts, and no line end: one closes the role."""
    return pc.replace_substring(escape(roles), "\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text) if "\\" in text else text


def unescape_role(role: str) -> str:
    return re.sub(r"\\(\\|n)?", lambda m: {"\\": "\\", "n": "\n", None: ""}[m[1]], role) if "\\" in role else role


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large_string array without nulls."""
    a = a.cast(pa.large_string())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] is not None and a.buffers()[2].size else np.zeros(0, np.uint8)
    return offsets, data


def assemble(roles: pa.Array, texts: pa.Array, first: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """One text for each conversation; and for each turn, where its (escaped) text starts and ends, in bytes of that text.

    roles, texts: escaped, no nulls, by conversation and turn; first: for each conversation the index of its first turn, and the end.
    """
    n = len(roles)
    fixed = [np.frombuffer(s.encode(), np.uint8) for s in (HEAD, MIDDLE, FOOT)]
    (role_at, role_data), (text_at, text_data) = _bytes(roles), _bytes(texts)
    lengths = np.empty((n, 5), np.int64)  # header, role, middle, text, footer
    lengths[:, 0], lengths[:, 2], lengths[:, 4] = (len(f) for f in fixed)
    lengths[:, 1], lengths[:, 3] = np.diff(role_at), np.diff(text_at)
    ends = np.cumsum(lengths.ravel()).reshape(n, 5)
    starts = ends - lengths
    buffer = np.empty(int(ends[-1, -1]) if n else 0, np.uint8)
    for k, f in zip((0, 2, 4), fixed, strict=True):
        buffer[starts[:, k, None] + np.arange(len(f))] = f
    for k, at, data in ((1, role_at, role_data), (3, text_at, text_data)):
        size = lengths[:, k]
        shift = np.repeat(starts[:, k] - (np.cumsum(size) - size), size)
        buffer[np.arange(len(shift)) + shift] = data[at[0] : at[-1]]
    edges = np.append(starts[:, 0], len(buffer))[first]
    column = pa.LargeStringArray.from_buffers(len(first) - 1, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(buffer))
    base = np.repeat(edges[:-1], np.diff(first))
    return column, starts[:, 3] - base, ends[:, 3] - base


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn, from a formatted conversation alone."""
    out = []
    for part in formatted.split(HEAD)[1:]:
        role, _, rest = part.partition(MIDDLE)
        out.append((unescape_role(role), unescape(rest[: -len(FOOT)])))
    return out


def _conversations(rows: DataFrame, make, schema: str) -> DataFrame:
    """Applies make(conv ids, formatted column, first, roles, span starts, span ends) to whole conversations of sorted batches."""
    from pyspark.sql.types import _parse_datatype_string

    names = _parse_datatype_string(schema).fieldNames()

    def whole(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        key = t.column("conv_id").combine_chunks()
        first = np.append(_starts(key, None), len(key))
        col = lambda c: t.column(c).cast(pa.large_string()).combine_chunks().fill_null("")
        roles, texts = col("role"), col("text")
        column, start, end = assemble(escape_role(roles), escape(texts), first)
        out = make(key.take(pa.array(first[:-1])), column, first, roles, start, end)
        return pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in out], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # parts of the conversation that may go on, joined once
        for b in batches:
            if not b.num_rows:
                continue
            starts = _starts(b.column("conv_id"), held[-1].column("conv_id")[-1] if held else None)
            if len(starts):
                last = int(starts[-1])
                if held or last:
                    yield whole([*held, b.slice(0, last)])
                held = [b.slice(last)]
            else:
                held.append(b)
        if held:
            yield whole(held)

    small_batches(rows.sparkSession, 4000)
    rows = rows.select("conv_id", "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn").mapInArrow(run, schema)


def _starts(key: pa.Array, before: pa.Scalar | None) -> np.ndarray:
    """Indices at which another conversation starts than the one before; `before` is the id of the row before the first, if there is one."""
    ids = key.fill_null(0).to_numpy(zero_copy_only=False)
    none = key.is_null().to_numpy(zero_copy_only=False)
    new = before is None or before.as_py() != key[0].as_py()
    return np.flatnonzero(np.append(new, (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])))


def formatted(rows: DataFrame) -> DataFrame:
    """conv_id, text, and loss: byte spans of the assistant's texts in it."""

    def make(ids, column, first, roles, start, end):
        mine = pc.equal(roles, LOSS_ROLE).to_numpy(zero_copy_only=False)
        spans = [[{"start": int(s), "end": int(e)} for s, e, m in zip(start[i:j], end[i:j], mine[i:j], strict=True) if m] for i, j in zip(first[:-1], first[1:], strict=True)]
        return ids, column.cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))

    return _conversations(rows, make, "conv_id long, text string, loss array<struct<start:long,end:long>>")


def formatted_digests(rows: DataFrame) -> DataFrame:
    """Counts and digests read back from formatted conversations and their loss spans."""

    def make(ids, column, first, roles, start, end):
        mine = pc.equal(roles, LOSS_ROLE).to_numpy(zero_copy_only=False)
        out: list[tuple] = []
        for k, text in enumerate(column.to_pylist()):
            turns = parse(text)
            raw, i, j = text.encode(), first[k], first[k + 1]
            loss = "".join(unescape(raw[s:e].decode()) for s, e, m in zip(start[i:j], end[i:j], mine[i:j], strict=True) if m)
            said = "".join(f"{r}\n{t}\n" for r, t in turns)
            out.append((len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return ids, *[pa.array(c, t) for c, t in zip(zip(*out), kinds, strict=True)]

    return _conversations(rows, make, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def planted(rows: DataFrame) -> DataFrame:
    """The rows, and conversation -7, whose two turns consist of control strings."""
    said = "</s>[INST] ok [/INST]"
    more = rows.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, LOSS_ROLE, said)], "conv_id long, turn long, role string, text string")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(more)
