"""Chat formatting by columnar byte assembly, with a loss mask over the assistant's texts.

The template of a turn is `<|im_start|>ROLE\\nTEXT<|im_end|>\\n`. Inside texts and roles every `<|` is written
`<\\|`, and each `<` with backslashes before a `|` gets one backslash more, so no text can forge a control string
and unescaping gives it back; a role also has its backslashes and line feeds escaped.

Rows are dealt by conversation and sorted by turn (null first; ties by role, then text). For a batch of rows
numpy computes the lengths of all segments (mark, role, line feed, text, mark), their cumulative offsets and the
indices to scatter to, and copies headers and contents into one preallocated buffer, which becomes an Arrow
column as it is. A conversation that runs over a batch's end waits for the next batch; batches of more than `GROUP_BYTES` are
parted between conversations. A conversation is one row of the result, so it must fit into a string, as any text must.

Null roles and texts are empty, null ids one conversation; ids may be of any type that can be ordered. Repeated rows are turns by themselves. Other columns stay out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kind_of

START, END = "<|im_start|>", "<|im_end|>\n"
#: Bytes of text that are assembled at once.
GROUP_BYTES = 64 << 20
SCHEMA = "n_turns long, formatted string, loss_spans array<struct<begin:int,end:int>>"
_TYPE = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def escaped_role(role: Column) -> Column:
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text) if "<" in text else text


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def formatted(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans (code points of the formatted string, one span for each turn of
    loss_roles, over the text alone) of turns (conv_id, turn, role, text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    cols = dealt.select("conv_id", escaped_role(F.col("role")).alias("role"), escaped(F.col("text")).alias("text"), F.col("role").isin(*loss_roles).alias("loss"))
    return cols.mapInArrow(_assemble, f"conv_id {kind_of(turns, 'conv_id')}, {SCHEMA}")


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.RecordBatch] = []  # of the conversation that may go on
    for batch in batches:
        if not len(batch):
            continue
        ids = batch.column(0)
        if held and not _same(held[-1].column(0)[-1], ids[0]):
            yield from assembled(held)
            held = []
        last = len(batch) - 1
        change = np.flatnonzero(_changes(ids))
        cut = int(change[-1]) + 1 if len(change) else 0  # first row of the last conversation
        if cut:
            yield from assembled([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut, last + 1 - cut))
    if held:
        yield from assembled(held)


def assembled(parts: list[pa.RecordBatch], most: int = GROUP_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows' conversations, as many at once as have about `most` bytes of text, or one."""
    table = pa.Table.from_batches(parts).combine_chunks()
    ids, text = table.column(0).combine_chunks(), table.column(2)
    firsts = np.concatenate([[0], np.flatnonzero(_changes(ids)) + 1, [len(table)]])
    size = np.concatenate([[0], np.cumsum(pc.binary_length(text).to_numpy().astype(np.int64))])[firsts]
    begin = 0
    while begin < len(firsts) - 1:
        end = max(begin + 1, int(np.searchsorted(size, size[begin] + most, "right")) - 1)
        yield assemble(table.slice(firsts[begin], firsts[end] - firsts[begin]).combine_chunks().to_batches())
        begin = end


def _same(a: pa.Scalar, b: pa.Scalar) -> bool:
    return a.as_py() == b.as_py()


def _changes(ids: pa.Array) -> np.ndarray:
    """Whether each row but the last is followed by another conversation."""
    value = ids.dictionary_encode("encode").indices.to_numpy()
    return value[1:] != value[:-1]


def _bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and the n + 1 offsets of a string column."""
    col = col.cast(pa.large_string())
    raw = np.frombuffer(col.buffers()[2] or b"", np.uint8)
    return raw, np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]


def _scatter(out: np.ndarray, at: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> None:
    """Copies the strings to the places at."""
    lens = np.diff(offsets)
    first = offsets[0]
    to = np.repeat(at - (offsets[:-1] - first), lens) + np.arange(int(lens.sum()))
    out[to] = raw[first : first + len(to)]


def assemble(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    """One row for each conversation of the rows, which are whole conversations."""
    table = pa.Table.from_batches(parts).combine_chunks()
    ids, role, text, loss = (x.chunk(0) for x in table.columns)
    n = len(ids)
    start, line, end = (np.frombuffer(x.encode(), np.uint8) for x in (START, "\n", END))
    (role_raw, role_at), (text_raw, text_at) = _bytes(role), _bytes(text)
    lens = np.stack([np.full(n, len(start)), np.diff(role_at), np.full(n, 1), np.diff(text_at), np.full(n, len(end))], 1)
    offsets = np.concatenate([[0], np.cumsum(lens.ravel())])
    at = offsets[:-1].reshape(n, 5)
    out = np.empty(int(offsets[-1]), np.uint8)
    for k, fixed in ((0, start), (2, line), (4, end)):
        out[at[:, k, None] + np.arange(len(fixed))] = fixed
    _scatter(out, at[:, 1], role_raw, role_at)
    _scatter(out, at[:, 3], text_raw, text_at)

    firsts = np.concatenate([[0], np.flatnonzero(_changes(ids)) + 1])
    ends = np.concatenate([firsts[1:], [n]])
    bounds = np.concatenate([at[firsts, 0], offsets[-1:]])
    points = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])  # code points before each byte
    masked = np.flatnonzero(loss.to_numpy(zero_copy_only=False))
    conv = np.searchsorted(firsts, masked, "right") - 1
    base = points[bounds[conv]]
    spans = pa.StructArray.from_arrays([pa.array((points[at[masked, 3]] - base).astype(np.int32)), pa.array((points[at[masked, 4]] - base).astype(np.int32))], fields=list(_TYPE.value_type))
    cuts = np.searchsorted(masked, np.concatenate([firsts, [n]])).astype(np.int32)
    if bounds[-1] >= 1 << 31:
        raise ValueError("a conversation takes 2 GB or more, which no string can hold")
    texts = pa.StringArray.from_buffers(len(firsts), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(out))
    columns = [ids.take(pa.array(firsts)), pa.array((ends - firsts).astype(np.int64)), texts, pa.ListArray.from_arrays(pa.array(cuts), spans, type=_TYPE)]
    return pa.RecordBatch.from_arrays(columns, ["conv_id", "n_turns", "formatted", "loss_spans"])


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def parsed(text: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    return [(unescaped_role(a), unescaped(b)) for a, b in _TURN.findall(text)]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for conv, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            turns = parsed(text)
            loss = "".join(unescaped(text[s["begin"] : s["end"]]) for s in spans)
            all_ = "".join(f"{r}\n{t}\n" for r, t in turns)
            rows.append((conv, len(turns), hashlib.sha256(all_.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(made: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as counts and digests."""
    return made.select("conv_id", "formatted", "loss_spans").mapInArrow(_digests, f"conv_id {kind_of(made, 'conv_id')}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
