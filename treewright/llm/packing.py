"""Order-preserving packing of token streams by dynamic programming.

Each task joins its documents in their order to one stream of token ids and cuts
it into windows of at most `window` ids. Cuts fall at document ends (no
penalty), at sentence ends (SENTENCE) or, where neither comes for over GAP ids,
at every STEP-th id inside a sentence (HARD). The cuts minimise the sum of padding and
penalties: with g(i) = cost(i) + i the best predecessor of a cut is the least g
in the last `window` ids, so a monotone queue gives each transition in constant
time. The stream goes through in blocks of BLOCK ids; what lies after a block's
best cut is carried into the next. The last window of a task is split at powers
of two, which need no padding. A window's number is the task's partition number
times 2**33 plus its place, so a repeated task gives the same rows.

Ids: byte-level BPE as the tokenizer file defines it. tiktoken applies the
file's own vocabulary in merge order, several times faster than the tokenizers
library; both are compared on PROBE when a worker starts, and a file for which
they differ is encoded by tokenizers itself, as is a text that tiktoken refuses
(runs of white space of about a million characters).

Defined results: a null text counts as empty and an empty text is its end id
alone; repeated rows and null ids are documents of their own; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 2048
END = 1
SENTENCE = 16
HARD = 64
GAP = 64
STEP = 16
BLOCK = 1 << 20
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"

#: The pre-tokenizer of byte-level BPE files, and the same without
#: look-ahead, equal on texts without two white-space characters in a row.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SINGLE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
PROBE = "Don't stop: l'été 2024 costs $5,000!!\n\n  Straße\t— ñandú   中文 👍🏽 they'll've  x86 \n"

_encoders: dict[int, Encoder] = {}


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins of bytes in such vocabularies: printable Latin-1 is itself, the rest follows from U+0100."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids of texts, for a tokenizer file's content."""

    def __init__(self, content: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_str(content)
        self.fast = self.single = None
        spec = json.loads(content)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        size = max([*self.special.values(), *spec["model"]["vocab"].values()]) + 1
        self.ends = np.zeros(size, bool)
        chars = _byte_of_char()
        if spec["model"].get("type") == "BPE" and all(c in chars for t in spec["model"]["vocab"] if t not in self.special for c in t):
            import tiktoken

            ranks = {bytes(chars[c] for c in t): k for t, k in spec["model"]["vocab"].items() if t not in self.special}
            self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self.special)
            self.single = tiktoken.Encoding("file-single", pat_str=SINGLE, mergeable_ranks=ranks, special_tokens=self.special)
            if self.fast.encode(PROBE, allowed_special="all") != self.slow.encode(PROBE, add_special_tokens=False).ids:
                self.fast = None
            for t, k in ranks.items():
                self.ends[k] = t.rstrip(b"\"')]")[-1:] in (b".", b"!", b"?", b"\n")
        else:
            for t, k in spec["model"]["vocab"].items():
                self.ends[k] = t.endswith((".", "!", "?", "\n"))
        self.ends[END] = True

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None:
            return self._slow(text)
        coder = self.fast if re.search(r"\s\s", text) else self.single
        try:
            if any(s in text for s in self.special):
                return np.array(coder.encode(text, allowed_special="all"), np.uint32)
            return np.frombuffer(coder._core_bpe.encode_to_tiktoken_buffer(text, set()), np.uint32)
        except ValueError:  # a run of about a million white-space characters is beyond its regular expressions
            return self._slow(text)

    def _slow(self, text: str) -> np.ndarray:
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(content: str) -> Encoder:
    key = hash(content)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(content)
    return _encoders[key]


def best_cuts(places: list[int], penalties: list[int], window: int) -> tuple[list[float], list[int]]:
    """cost and predecessor (an index, -1 for the start) of a cut at each of the rising places.

    No two neighbouring places, nor the start 0 and the first, are over window apart.
    """
    cost: list[float] = []
    before: list[int] = []
    queue_place, queue_g, queue_index, head = [0], [0], [-1], 0  # g rises from head on
    for j, place in enumerate(places):
        low = place - window
        while queue_place[head] < low:
            head += 1
        f = penalties[j] + window - place + queue_g[head]
        cost.append(f)
        before.append(queue_index[head])
        g = f + place
        k = len(queue_g) - 1
        while k >= head and queue_g[k] >= g:
            k -= 1
        del queue_place[k + 1 :], queue_g[k + 1 :], queue_index[k + 1 :]
        queue_place.append(place)
        queue_g.append(g)
        queue_index.append(j)
    return cost, before


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where a cut may fall in a stream, and their penalties."""
    after = np.flatnonzero(ends[ids]) + 1
    places = np.union1d(after, doc_ends)
    gaps = np.diff(np.concatenate([[0], places, [len(ids)]]))
    wide = np.flatnonzero(gaps > min(GAP, window))
    start = np.concatenate([[0], places])
    step = min(STEP, window)
    count = (gaps[wide] - 1) // step
    penalty = np.where(np.isin(places, doc_ends), 0, SENTENCE)
    if len(wide):
        more = np.repeat(start[wide], count) + step * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1)
        places, penalty = np.concatenate([places, more]), np.concatenate([penalty, np.full(len(more), HARD)])
        order = np.argsort(places)
        places, penalty = places[order], penalty[order]
    return places, penalty


class Packer:
    """Takes documents in order; gives rows of pieces."""

    def __init__(self, ends: np.ndarray, window: int, first_sequence: int, block: int):
        self.ends, self.window, self.sequence, self.block = ends, window, first_sequence, block
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int, int]] = []  # id, first id held, ids held, ids in all
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> list[tuple]:
        self.parts.append(ids)
        self.docs.append((doc_id, 0, len(ids), len(ids)))
        self.held += len(ids)
        return self._flush() if self.held >= self.block + self.window else []

    def _flush(self) -> list[tuple]:
        ids = np.concatenate(self.parts)
        doc_ends = np.cumsum([d[2] for d in self.docs])
        places, penalty = candidates(ids, doc_ends, self.ends, self.window)
        cost, before = best_cuts(places.tolist(), penalty.tolist(), self.window)
        last = int(np.searchsorted(places, len(ids) - self.window, "right"))
        at = min(range(last, len(places)), key=cost.__getitem__, default=len(places) - 1)
        cuts = []
        while at >= 0:
            cuts.append(int(places[at]))
            at = before[at]
        return self._emit(ids, doc_ends, cuts[::-1])

    def finish(self) -> list[tuple]:
        rows: list[tuple] = []
        if self.held > self.window:
            rows += self._flush()
        while self.held:  # the rest, at powers of two
            ids = np.concatenate(self.parts)
            doc_ends = np.cumsum([d[2] for d in self.docs])
            rows += self._emit(ids, doc_ends, [min(self.window, 1 << (len(ids).bit_length() - 1)) if len(ids) < self.window else self.window])
        return rows

    def _emit(self, ids: np.ndarray, doc_ends: np.ndarray, cuts: list[int]) -> list[tuple]:
        rows, stop = [], cuts[-1]
        doc_starts = np.concatenate([[0], doc_ends[:-1]])
        edges = np.union1d(np.concatenate([[0], cuts]), doc_starts[doc_starts < stop])
        doc = np.searchsorted(doc_ends, edges[:-1], "right").tolist()
        window = np.searchsorted(cuts, edges[:-1], "right").tolist()
        begin = [0, *cuts]
        little = ids.astype("<u4", copy=False)
        for a, b, d, w in zip(edges[:-1].tolist(), edges[1:].tolist(), doc, window):
            doc_id, first, _, total = self.docs[d]
            rows.append((doc_id, first + a - int(doc_starts[d]), b - a, little[a:b].tobytes(), total, self.sequence + w, a - begin[w]))
        self.sequence += len(cuts)
        d = int(np.searchsorted(doc_ends, stop, "right"))
        rest = []
        for k in range(d, len(self.docs)):
            doc_id, first, held, total = self.docs[k]
            gone = max(0, stop - int(doc_starts[k]))
            rest.append((doc_id, first + gone, held - gone, total))
        self.docs, self.parts = rest, [ids[stop:].copy()] if stop < len(ids) else []
        self.held = len(ids) - stop
        return rows


def pack(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, block: int = BLOCK) -> DataFrame:
    """Rows of pieces: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""
    with open(tokenizer_file, encoding="utf-8") as f:  # the driver's; its size doesn't grow with the data
        content = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(content.value)
        packer = Packer(encode.ends, window, TaskContext.get().partitionId() << 33, block)
        tail = np.array([end], np.uint32)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                rows = []
                part = b.slice(at, 256)
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    rows += packer.add(doc_id, np.concatenate([encode(text), tail]) if text else tail)
                yield from _batches(rows)
        yield from _batches(packer.finish())

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def _batches(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    for at in range(0, len(rows), 4096):
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows[at : at + 4096]), kinds)], names)
