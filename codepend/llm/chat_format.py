"""Chat formatting by columnar byte assembly.

Template of one turn:  ``### `` role ``: `` text ``</turn>`` newline. A conversation is its turns
in order. Inside roles and texts a backslash goes before every backslash, before the third ``#``
of any three and before the slash of ``</turn>``, so neither control string occurs in them and
taking away the first backslash of each escape gives the content back; roles also escape ``:``.

Defined cases: null text or role is empty; null turns come first; rows that repeat a turn are
ordered by their formatted rows (role, then text); a null conv_id is a conversation of its own; no rows give no rows;
other columns are ignored. Rows are formatted each by itself, so a very long conversation is never
one value; only its running digest goes through one sorted stream, in constant memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, ranges, string_buffers

OPEN, MIDDLE, CLOSE = b"### ", b": ", b"</turn>\n"
BACKSLASH = 92
FORMATTED = "conv_id long, turn long, formatted string, role_end int, text_start int, text_end int, in_loss boolean"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _marks(data: np.ndarray, offsets: np.ndarray, word: bytes, at: int) -> np.ndarray:
    """Position of byte number `at` of each occurrence of word that doesn't cross rows."""
    n = len(data) - len(word) + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    found = np.flatnonzero(data[:n] == word[0])
    for k in range(1, len(word)):
        found = found[data[found + k] == word[k]]
    row = np.searchsorted(offsets, found, side="right") - 1
    return found[found + len(word) <= offsets[row + 1]] + at


def escape(offsets: np.ndarray, data: np.ndarray, colon: bool) -> tuple[np.ndarray, np.ndarray]:
    """Lengths after escaping, and for each input byte how many backslashes stand before it in its own row, itself included."""
    hit = np.zeros(len(data) + 1, np.int64)
    hit[np.flatnonzero(data == BACKSLASH)] = 1
    hit[_marks(data, offsets, b"</turn>", 1)] = 1
    hit[_marks(data, offsets, b"###", 2)] = 1
    if colon:
        hit[np.flatnonzero(data == 58)] = 1
    before = np.concatenate([[0], np.cumsum(hit[:-1])])
    lengths = np.diff(offsets) + before[offsets[1:]] - before[offsets[:-1]]
    return lengths, before[1:] - np.repeat(before[offsets[:-1]], np.diff(offsets))


def assemble(roles: pa.Array, contents: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Formatted rows in one preallocated buffer, and the byte bounds (role end, text start, text end) in each row."""
    (ro, rd), (to, td) = string_buffers(roles), string_buffers(contents)
    n = len(roles)
    (rl, rb), (tl, tb) = escape(ro, rd, True), escape(to, td, False)
    segments = np.column_stack([np.full(n, len(OPEN)), rl, np.full(n, len(MIDDLE)), tl, np.full(n, len(CLOSE))]).astype(np.int64).reshape(n, 5)
    ends = np.cumsum(segments.ravel()).reshape(n, 5)
    starts = ends - segments
    total = int(ends[-1, -1]) if n else 0
    out = np.full(total, BACKSLASH, np.uint8)  # what no scatter writes is an escape
    for k, fixed in ((0, OPEN), (2, MIDDLE), (4, CLOSE)):
        out[(starts[:, k][:, None] + np.arange(len(fixed))).ravel()] = np.tile(np.frombuffer(fixed, np.uint8), n)
    for offsets, data, before, at in ((ro, rd, rb, starts[:, 1]), (to, td, tb, starts[:, 3])):
        out[ranges(at, np.diff(offsets)) + before] = data
    bounds = np.concatenate([[0], ends[:, 4]]) if n else np.zeros(1, np.int64)
    made = pa.LargeStringArray.from_buffers(n, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out))
    return made, np.column_stack([ends[:, 1], starts[:, 3], ends[:, 3]]) - bounds[:-1, None] if n else np.zeros((0, 3), np.int64)


def unescape(piece: bytes) -> bytes:
    """The content that an escaped piece stands for."""
    if BACKSLASH not in piece:
        return piece
    parts = piece.split(b"\\\\")
    return b"\\".join(p.replace(b"\\", b"") for p in parts)


def parse(row: bytes) -> tuple[bytes, bytes]:
    """Role and text, read from a formatted row alone."""
    at = len(OPEN)
    while row[at : at + 1] != b":":
        at += 1 + (row[at] == BACKSLASH)
    return unescape(row[len(OPEN) : at]), unescape(row[at + len(MIDDLE) : -len(CLOSE)])


def format_turns(conversations: DataFrame) -> DataFrame:
    """One formatted row for each row of conversations, with byte bounds of its parts; texts of assistants are under the loss mask."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, bounds = assemble(b.column("role"), b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("conv_id"), b.column("turn"), made.cast(pa.string()), *(pa.array(bounds[:, k].astype(np.int32)) for k in range(3)), pc.equal(b.column("role"), "assistant")],
                ["conv_id", "turn", "formatted", "role_end", "text_start", "text_end", "in_loss"],
            )

    bounded_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return rows.mapInArrow(work, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of every conversation, read from its formatted rows; the text under the loss mask is what the bounds and the mask of each row say."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, started, state, done = None, False, [], []

        def end() -> None:
            done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        for b in batches:
            for conv, text, i, j, in_loss in zip(*(b.column(c).to_pylist() for c in ("conv_id", "formatted", "text_start", "text_end", "in_loss"))):
                if not started or conv != key:
                    if started:
                        end()
                    key, started, state = conv, True, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                raw = text.encode()
                role, content = parse(raw)
                state[0] += 1
                state[1].update(role + b"\n" + content + b"\n")
                if in_loss:
                    under = unescape(raw[i:j])
                    state[2] += len(under.decode())
                    state[3].update(under)
                state[4] += len(text)
            if done:
                yield _digests(done)
                done = []
        if started:
            end()
            yield _digests(done)

    dealt = formatted.repartition(F.col("conv_id")).sortWithinPartitions(F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "formatted")
    return dealt.select("conv_id", "formatted", "text_start", "text_end", "in_loss").mapInArrow(work, DIGESTS)


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [f.split()[0] for f in DIGESTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def chat_digests(conversations: DataFrame) -> DataFrame:
    """Format all turns, then read every conversation back from the output."""
    return read_back(format_turns(conversations))
