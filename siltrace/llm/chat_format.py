"""Chat formatting by columnar byte assembly, and reading the result back.

A turn is ``<s>`` role ``[INST]`` text ``[/INST]</s>`` and a line end. Inside roles and texts a
backslash is doubled and one is put after the first character of each control string, so no
control string of the template, nor ``<<SYS>>`` and ``<</SYS>>``, can occur there.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltrace.llm.words import joined, text_parts

OPEN, TEXT, CLOSE = b"<s>", b"[INST]", b"[/INST]</s>\n"
_CONTROL = r"([<\[])(/?s>|</?SYS>>|/?INST\])"
_UNDO = re.compile(r"\\(\\?)")
FORMATTED = "part int, formatted string, loss array<bigint>, n_turns bigint"


def escaped(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(pc.replace_substring(column, "\\", "\\\\"), _CONTROL, r"\1\\\2")


def unescaped(text: str) -> str:
    return _UNDO.sub(r"\1", text)


def _scatter(out: np.ndarray, data: np.ndarray, at: np.ndarray, to: np.ndarray) -> None:
    """Copies each stretch ``data[at[i]:at[i + 1]]`` to ``out`` from ``to[i]`` on."""
    out[np.repeat(to - at[:-1], np.diff(at)) + np.arange(len(data))] = data


def _assembled(role: pa.Array, text: pa.Array, first: np.ndarray, learnt: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """One string for each run of turns that starts at ``first``, and its loss spans."""
    (rd, ra), (td, ta) = joined(escaped(role)), joined(escaped(text))
    n = len(role)
    sizes = len(OPEN) + np.diff(ra) + len(TEXT) + np.diff(ta) + len(CLOSE)
    at = np.concatenate([[0], np.cumsum(sizes)])
    out = np.empty(at[-1], np.uint8)
    to_role = at[:-1] + len(OPEN)
    to_text = to_role + np.diff(ra) + len(TEXT)
    for where, fixed in ((at[:-1], OPEN), (to_text - len(TEXT), TEXT), (at[1:] - len(CLOSE), CLOSE)):
        out[where[:, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    _scatter(out, rd, ra, to_role)
    _scatter(out, td, ta, to_text)
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
    part_of = np.searchsorted(first, np.arange(n), "right") - 1
    base = points[at[first]]
    rows = np.flatnonzero(learnt)
    start, end = points[to_text[rows]] - base[part_of[rows]], points[to_text[rows] + np.diff(ta)[rows]] - base[part_of[rows]]
    many = np.bincount(part_of[rows], minlength=len(first))
    spans = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(2 * many)]).astype(np.int32)), pa.array(np.stack([start, end], 1).ravel().astype(np.int64)))
    bounds = np.append(at[first], at[-1]).astype(np.int32)
    return pa.StringArray.from_buffers(len(first), pa.py_buffer(bounds), pa.py_buffer(out)), spans


def _formatted(batches, learn: str):
    last, part = (), 0  # the conversation that may go on in the next batch
    for batch in batches:
        for i, j in text_parts(batch.column(2)):
            some = batch.slice(i, j - i)
            ids = some.column(0).to_pylist()
            first = [k for k in range(len(ids)) if not k or ids[k] != ids[k - 1]]
            parts = [part + 1 if (ids[k],) == last else 0 for k in first]
            text, loss = _assembled(some.column(1), some.column(2), np.asarray(first), np.asarray(pc.equal(some.column(1), learn), bool))
            turns = np.diff(np.append(first, len(ids))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(first, pa.int64())), pa.array(parts, pa.int32()), text, loss, pa.array(turns)], names=["id", "part", "formatted", "loss", "n_turns"])
            last, part = (ids[-1],), parts[-1]


def format_conversations(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """``id, part, formatted, loss, n_turns``: each conversation's turns in order, as text.

    A conversation is one row, or several numbered parts that follow each other where it is
    long; so neither its turns nor its text are ever held whole. ``loss`` alternates the
    first code point and the one after the last of each text whose role is ``learn``. Null
    roles and texts are empty, rows with a null id are one conversation, equal turns are
    ordered by role and text, and repeated rows are repeated turns. Rows come sorted by id and
    part within partitions, and all parts of an id lie in one partition.
    """
    source = rows.select(F.col(id_col).alias("id"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(turn_col).alias("turn"))
    dealt = source.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")
    return dealt.mapInArrow(lambda batches: _formatted(batches, learn), f"id {source.schema['id'].dataType.simpleString()}, {FORMATTED}")


class _Reader:
    """Takes a conversation's parts in order and digests what they say."""

    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n_turns = self.loss_chars = self.chars = 0

    def add(self, formatted: str, loss: list[int]) -> None:
        at = 0
        while at < len(formatted):
            text = formatted.index("[INST]", at)
            end = formatted.index("[/INST]</s>\n", text)
            if not formatted.startswith("<s>", at):
                raise ValueError("a turn does not begin with its mark")
            role, said = unescaped(formatted[at + 3 : text]), unescaped(formatted[text + 6 : end])
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
            at = end + len(CLOSE)
        for a, b in zip(loss[::2], loss[1::2]):
            said = unescaped(formatted[a:b])
            self.loss.update(said.encode())
            self.loss_chars += len(said)
        self.chars += len(formatted)

    def row(self, key) -> tuple:
        return key, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


_DIGESTS = ("id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def _digested(batches, id_type: pa.DataType | None = None):
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    now: tuple = ()
    reader = None
    for batch in batches:
        id_type, out = batch.column(0).type, []
        for key, formatted, loss in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
            if (key,) != now:
                if reader:
                    out.append(reader.row(now[0]))
                now, reader = (key,), _Reader()
            reader.add(formatted.as_py(), loss.as_py())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (id_type, *kinds))], names=_DIGESTS)
    if reader:
        yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(reader.row(now[0]), (id_type, *kinds))], names=_DIGESTS)


def read_conversations(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """What formatted conversations say, one row each, parsed from their text alone.

    ``turns_sha256`` digests role, line end, text, line end for each turn; ``loss_sha256`` the
    text under the loss mask. Parts are sorted first unless ``in_order`` says that the rows
    come as ``format_conversations`` returns them.
    """
    rows = formatted if in_order else formatted.repartition("id").sortWithinPartitions("id", "part")
    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "part", "formatted", "loss").mapInArrow(_digested, f"id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
