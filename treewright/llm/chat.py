"""Chat formatting by columnar byte assembly, and the reader of what it writes.

A turn is written as

    <|start|>role\\n text <|end|>\\n

(without the spaces). Control strings inside roles and texts, those of this
template and of other common ones, are escaped: a backslash goes in after the
opening bracket of every "<" or "[" that is followed by any backslashes and a
control string's rest, so that adding one and removing one undo each other.
Backslashes and newlines of roles are escaped too.

Rows are dealt by conversation and sorted by turn; a batch is then assembled as
columns: the lengths of all segments (headers, roles, texts, ends) give
cumulative offsets, the offsets scatter indices, and numpy copies every segment
into one buffer, allocated once, which becomes the Arrow column. A conversation
comes out in segments of about `segment` bytes of whole turns, numbered from 0,
so none has to fit into memory. mask_start and mask_length are the byte spans of
a segment's assistant texts, over which loss is taken.

Defined results: a null role or text counts as empty; turns are ordered by turn,
nulls first, then role and text, so ties and repeated rows have one order; a
null conv_id is a conversation of its own; other columns are ignored; no rows
give no rows.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import byte_list

START, MIDDLE, END = b"<|start|>", b"\n", b"<|end|>\n"
SEGMENT = 4 << 20
#: Bytes assembled at once.
AT_ONCE = 8 << 20
#: Bytes scattered by one array of indices.
SLICE = 1 << 20
SCHEMA = "conv_id long, segment long, n_turns long, formatted binary, mask_start array<long>, mask_length array<long>"
READ_SCHEMA = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

#: What follows the opening bracket of control strings.
_REST = rb"(?=\||/?s>|/?INST\]|/?SYS>|/?(?:start|end)_of_turn>|bos>|eos>|pad>|unk>)"
_ESCAPE = re.compile(rb"([<\[])(\\*)" + _REST)
_UNESCAPE = re.compile(rb"([<\[])\\(\\*)" + _REST)
_TURN = re.compile(rb"<\|start\|>([^\n]*)\n(.*?)<\|end\|>\n", re.DOTALL)


def escape(text: bytes) -> bytes:
    return _ESCAPE.sub(rb"\1\\\2", text) if b"<" in text or b"[" in text else text


def unescape(text: bytes) -> bytes:
    return _UNESCAPE.sub(rb"\1\2", text) if b"\\" in text else text


def escape_role(role: bytes) -> bytes:
    return escape(role).replace(b"\\", b"\\\\").replace(b"\n", b"\\n")


def unescape_role(role: bytes) -> bytes:
    return unescape(re.sub(rb"\\(.)", lambda m: b"\n" if m[1] == b"n" else m[1], role)) if b"\\" in role else role


def assemble(roles: list[bytes], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of some turns one after the other, each turn's start (and the end of all), and each text's start."""
    n = len(roles)
    fixed = [START, MIDDLE, END]
    source = np.frombuffer(b"".join([*fixed, *roles, *texts]), np.uint8)
    size = np.zeros((n, 5), np.int64)
    size[:, 0], size[:, 2], size[:, 4] = map(len, fixed)
    size[:, 1], size[:, 3] = list(map(len, roles)), list(map(len, texts))
    begin = np.zeros((n, 5), np.int64)
    begin[:, 2], begin[:, 4] = len(START), len(START) + len(MIDDLE)
    begin[:, 1] = sum(map(len, fixed)) + np.cumsum(size[:, 1]) - size[:, 1]
    begin[:, 3] = sum(map(len, fixed)) + size[:, 1].sum() + np.cumsum(size[:, 3]) - size[:, 3]
    flat = size.ravel()
    begin = begin.ravel()
    offset = np.concatenate([[0], np.cumsum(flat)])
    out = np.empty(offset[-1], np.uint8)
    at = 0
    while at < len(flat):  # scatter indices take eight times their bytes, so they are made for SLICE bytes at a time
        to = max(int(np.searchsorted(offset, offset[at] + SLICE, "right")) - 1, at + 1)
        here = out[offset[at] : offset[to]]
        if to == at + 1:
            here[:] = source[begin[at] : begin[at] + flat[at]]
        else:
            np.take(source, np.arange(len(here)) + np.repeat(begin[at:to] - offset[at:to] + offset[at], flat[at:to]), out=here)
        at = to
    return out, offset[::5], offset[3::5]


def _segments(ids: list, roles: list[bytes], texts: list[bytes], assistant: list[bool], state: dict, segment: int):
    """Rows of segments of some sorted turns; state holds the last conversation and its next segment."""
    if not ids:
        return
    buffer, turn, text = assemble(roles, texts)
    cuts = [0]
    for k in range(1, len(ids)):
        if ids[k] != ids[k - 1] or turn[k + 1] - turn[cuts[-1]] > segment:
            cuts.append(k)
    cuts.append(len(ids))
    numbers = []
    for a in cuts[:-1]:
        state["segment"] = state["segment"] + 1 if "id" in state and state["id"] == ids[a] else 0
        state["id"] = ids[a]
        numbers.append(state["segment"])
    starts, lengths = [], []
    for a, b in zip(cuts, cuts[1:]):
        mine = [k for k in range(a, b) if assistant[k]]
        starts.append([int(text[k] - turn[a]) for k in mine])
        lengths.append([len(texts[k]) for k in mine])
    at = np.array(cuts)
    formatted = pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer(turn[at].astype(np.int32)), pa.py_buffer(buffer)])
    lists = pa.list_(pa.int64())
    yield pa.RecordBatch.from_arrays(
        [pa.array([ids[a] for a in cuts[:-1]], pa.int64()), pa.array(numbers, pa.int64()), pa.array(np.diff(at)), formatted, pa.array(starts, lists), pa.array(lengths, lists)],
        ["conv_id", "segment", "n_turns", "formatted", "mask_start", "mask_length"],
    )


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", assistant: str = "assistant", segment: int = SEGMENT, at_once: int = AT_ONCE) -> DataFrame:
    """Segments of formatted conversations, in order within partitions; see the module."""
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    trained = assistant.encode()

    def run(batches):
        state: dict = {}
        for b in batches:
            ids = b.column(0).to_pylist()
            raw = byte_list(b.column(2))
            at = 0
            while at < len(ids):
                to, size = at, 0
                texts = []
                while to < len(ids) and size < at_once:  # a single text may be larger
                    texts.append(escape(byte_list(b.column(3).slice(to, 1))[0]))
                    size += len(texts[-1])
                    to += 1
                yield from _segments(ids[at:to], [escape_role(r) for r in raw[at:to]], texts, [r == trained for r in raw[at:to]], state, segment)
                at = to

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, SCHEMA)


def read_turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """(role, text) of each turn of a segment."""
    return [(unescape_role(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def digests(segments: DataFrame) -> DataFrame:
    """Read back per conversation: turns, their hash, the text under the loss mask and its hash, and the formatted characters.

    segments must come from format_chats, in its order.
    """

    def run(batches):
        held: dict = {}

        def flush():
            if held:
                yield held["id"], held["n"], held["turns"].hexdigest(), held["loss_chars"], held["loss"].hexdigest(), held["chars"]

        def batch(rows):
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in READ_SCHEMA.split(", ")])

        for b in batches:
            rows = []
            for k in range(b.num_rows):
                conv, segment, _, formatted, starts, lengths = (c[k].as_py() for c in b.columns)
                if segment == 0:
                    rows += flush()
                    held = {"id": conv, "n": 0, "turns": hashlib.sha256(), "loss_chars": 0, "loss": hashlib.sha256(), "chars": 0}
                for role, text in read_turns(formatted):
                    held["turns"].update(role + b"\n" + text + b"\n")
                    held["n"] += 1
                held["chars"] += len(formatted.decode())
                for a, n in zip(starts, lengths):
                    text = unescape(formatted[a : a + n])
                    held["loss"].update(text)
                    held["loss_chars"] += len(text.decode())
            if rows:
                yield batch(rows)
        rows = [*flush()]
        if rows:
            yield batch(rows)

    return segments.mapInArrow(run, READ_SCHEMA)
