r"""Chat formatting by columnar byte assembly.

All turns of a batch of conversations are laid out at once: segment lengths, their cumulative offsets and scatter indices
are numpy arrays, and headers, contents and ends are copied into one preallocated buffer, which becomes the Arrow column.

A turn is ``### ROLE\nTEXT</turn>\n``. In texts a backslash is doubled, and one is put after each ``#`` that begins ``###``
and after each ``<`` that begins ``</turn>``, so neither mark occurs in an escaped text, and dropping the first of
each pair of backslashes, or a single one, restores it. In roles a newline becomes ``\n`` besides.

Turns are ordered by turn, role and text, nulls first. A null text or role is empty; a null conv_id is a conversation of
its own; repeated rows are turns of their own. A formatted conversation has 2 GB at most, as any string in Spark: a longer one
fails the job, and nothing is cut.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .tables import partitions, small_batches

END = b"</turn>\n"
_END = np.frombuffer(END, np.uint8)
FORMATTED = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start: long, end: long>>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(s: str) -> str:
    return re.sub(r"<(?=/turn>)", r"<\\", re.sub(r"#(?=##)", r"#\\", s.replace("\\", "\\\\")))


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


def header(role: str) -> bytes:
    return f"### {escape(role).replace(chr(10), chr(92) + 'n')}\n".encode()


def role_of(line: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], line, flags=re.S)


def _begins(raw: np.ndarray, at: np.ndarray, mark: bytes) -> np.ndarray:
    """Where the mark begins, within one text."""
    n = len(raw) - len(mark) + 1
    if n <= 0:
        return np.empty(0, np.int64)
    p = np.flatnonzero(raw[:n] == mark[0])
    for k in range(1, len(mark)):
        p = p[raw[p + k] == mark[k]]
    end = at[np.searchsorted(at, p, "right")] if len(p) else p
    return p[p + len(mark) <= end]


def assemble(conv: np.ndarray, roles: list[str], texts: pa.Array, loss_role: str = "assistant") -> tuple[pa.Array, np.ndarray, pa.Array]:
    """The formatted conversations, the first turn of each, and the spans of characters under the loss mask. ``conv``: equal for the turns of one."""
    raw, at = X.utf8(texts)
    n = len(conv)
    added = np.zeros(len(raw) + 1, np.int64)
    marks = np.sort(np.concatenate([np.flatnonzero(raw == 0x5C), _begins(raw, at, b"###"), _begins(raw, at, b"</turn>")]))
    added[marks + 1] = 1
    added = np.cumsum(added)  # before each byte
    kinds = {r: k for k, r in enumerate(dict.fromkeys(roles))}
    heads = [np.frombuffer(header(r), np.uint8) for r in kinds]
    kind = np.array([kinds[r] for r in roles], np.int64)
    head_size = np.array([len(h) for h in heads], np.int64)[kind]
    text_size = np.diff(at) + added[at[1:]] - added[at[:-1]]
    start = np.zeros(n + 1, np.int64)
    np.cumsum(head_size + text_size + len(END), out=start[1:])
    out = np.empty(start[-1], np.uint8)
    for k, h in enumerate(heads):
        out[(start[:-1][kind == k])[:, None] + np.arange(len(h))] = h
    text_start = start[:-1] + head_size
    shift = text_start - at[:-1] - added[at[:-1]]
    to = np.arange(len(raw)) + added[:-1] + np.repeat(shift, np.diff(at))
    out[to] = raw
    out[to[marks] + 1] = 0x5C
    out[(start[1:] - len(END))[:, None] + np.arange(len(END))] = _END
    new = np.ones(n, bool)
    new[1:] = conv[1:] != conv[:-1]
    first = np.flatnonzero(new)
    edges = start[np.append(first, n)]
    formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(edges), pa.py_buffer(out)])
    chars = np.zeros(len(out) + 1, np.int64)
    np.cumsum((out & 0xC0) != 0x80, out=chars[1:])
    masked = np.flatnonzero(kind == kinds.get(loss_role, -1))
    own = np.cumsum(new)[masked] - 1
    base = chars[edges[own]]
    spans = pa.ListArray.from_arrays(
        pa.array(np.searchsorted(masked, np.append(first, n)), pa.int32()),
        pa.StructArray.from_arrays([pa.array(chars[text_start[masked]] - base), pa.array(chars[text_start[masked] + text_size[masked]] - base)], ["start", "end"]),
    )
    return formatted, first, spans


def _format(loss_role: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def made(rows: pa.RecordBatch) -> pa.RecordBatch:
            key = rows.column(0).fill_null(-(1 << 63)).to_numpy() if rows.column(0).null_count < rows.num_rows else np.zeros(rows.num_rows)
            formatted, first, spans = assemble(key, [r or "" for r in rows.column(1).to_pylist()], rows.column(2), loss_role)
            return pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(first)), pa.array(np.diff(np.append(first, rows.num_rows))), formatted.cast(pa.string()), spans], names=["conv_id", "n_turns", "formatted", "loss_spans"])

        for batch in batches:
            if not batch.num_rows:
                continue
            last = batch.column(0)[batch.num_rows - 1].as_py()
            ids = batch.column(0).to_pylist()
            cut = batch.num_rows
            while cut and ids[cut - 1] == last:
                cut -= 1
            if held and held[-1].column(0)[0].as_py() == ids[0] and cut == 0:
                held.append(batch)
                continue
            whole = pa.Table.from_batches([*held, batch.slice(0, cut)], schema=batch.schema).combine_chunks()
            for rows in whole.to_batches():
                if rows.num_rows:
                    yield made(rows)
            held = [batch.slice(cut)]
        if held:
            for rows in pa.Table.from_batches(held).combine_chunks().to_batches():
                yield made(rows)

    return run


def format_conversations(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (characters): one row for each conversation."""
    spark = conversations.sparkSession
    small_batches(spark)
    c = conversations
    turns = c.select(c["conv_id"].cast("long").alias("conv_id"), c["role"].cast("string").alias("role"), c["text"].cast("string").alias("text"), c["turn"].cast("long").alias("turn"))
    return turns.repartition(partitions(spark), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text").mapInArrow(_format(loss_role), FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out = []
    for turn in formatted.split(END.decode())[:-1]:
        line, text = turn.removeprefix("### ").split("\n", 1)
        out.append((role_of(line), unescape(text)))
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, formatted, spans in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
            turns = parse(formatted)
            loss = "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)
            rows.append((conv, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)))
        names = [f.split()[0] for f in READ.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what formatted conversations say when they are parsed again."""
    return formatted.mapInArrow(_read, READ)
