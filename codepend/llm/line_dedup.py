"""Line dedup by winnowing over line hashes.

A window is the shortest run of whole lines, from a line with words on, that holds WORDS words or
more (words and blank lines as between ASCII white space). Each window selects the least of its line
hashes, the leftmost if tied and never a blank line's, as its fingerprint: equal windows select the
same line, so a repeated run of WORDS words or more cannot be missed. A line of LINE_WORDS words or
more that is shorter than a window is a fingerprint of its own, so that repeated boilerplate goes.

A row is written for each run that a selected position anchors. Positions whose fingerprint occurs once
are dropped, the others are joined on it. A match is then extended from the fingerprint both ways: to the window's ends, from there line by line to the right as far as the next
window would reach, and to the left over blank lines; each extent is a 128-bit hash of its lines, and
two positions match over the extents that they have in common. Of equal extents the first by
(doc_id, line) stays, and the lines of all later ones go, overlaps counted once: a maximal repeated
run of WORDS words or more goes whole, whichever earlier text it equals. What is compared is the
input, not what is left of it.

Groups are never listed: firsts are minima with map-side combine, joined back; keys that hold many of
the rows are joined by broadcast (their number is bounded), so no task gets all rows of a common line.

Defined cases: null text is empty, and empty text is one blank line; a null doc_id comes before all
others; rows that share a doc_id take their lines' numbers as positions, so equal rows with one
doc_id leave each other alone; shorter runs and lines stay; a text without a line left is empty; very
long texts are worked on whole, at a bounded multiple of their size; no rows give no rows; other
columns, whatever their names, are ignored or kept as they are. Lines end at line feeds only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, row_key, skewed_join, string_buffers, texts, written

WORDS = 10
#: The words from which on a repeated line goes by itself.
LINE_WORDS = 3
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
POSITIONS = "fp long, lead boolean, did long, rid long, start int, stop int, w1 long, w2 long"


def fingerprints(data: np.ndarray, words: int = WORDS, line_words: int = LINE_WORDS) -> list[tuple[int, list[tuple[int, int, int, int]]]]:
    """(fingerprint, runs) of each selected position of one text; a run is (first line, line after the last, hash in two parts)."""
    breaks = np.flatnonzero(data == 10)
    begin, end = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(data)]])
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    counted = np.concatenate([[0], np.cumsum(starts)])
    n = counted[end] - counted[begin]
    total = np.concatenate([[0], np.cumsum(n)])
    first = np.flatnonzero(n > 0)
    stop = np.searchsorted(total, total[first] + words, "left")
    whole = stop <= len(n)
    first, stop = first[whole].tolist(), stop[whole].tolist()
    alone = np.flatnonzero((n >= line_words) & (n < words)).tolist()
    if not first and not alone:
        return []
    raw = data.tobytes()
    begin, end, n, total = begin.tolist(), end.tolist(), n.tolist(), total.tolist()
    halves = lambda w: ((w >> 64) - 2**63, (w & (2**64 - 1)) - 2**63)
    grown = lambda w, side, k: xxhash.xxh3_128_intdigest(w.to_bytes(16, "big") + side + raw[begin[k] : end[k]])
    out: list[tuple[int, list]] = []
    for i in alone:  # under another seed, so that they don't meet windows
        line = raw[begin[i] : end[i]]
        out.append((xxhash.xxh3_64_intdigest(line, seed=1) - 2**63, [(i, i + 1, *halves(xxhash.xxh3_128_intdigest(line, seed=1)))]))
    hashes = [xxhash.xxh3_64_intdigest(raw[i:j]) if k else 2**64 for i, j, k in zip(begin, end, n)]
    last = -1
    for i, j in zip(first, stop):
        at = i if j == i + 1 else min(range(i, j), key=hashes.__getitem__)
        if at != last:
            out.append((hashes[at] - 2**63, []))
            last = at
        runs = out[-1][1]
        v = w = xxhash.xxh3_128_intdigest(raw[begin[i] : end[j - 1]])
        runs.append((i, j, *halves(w)))
        k = j
        while k < len(n) and total[k + 1] - total[i + 1] < words:
            v = grown(v, b">", k)
            k += 1
            runs.append((i, k, *halves(v)))
        v, k = w, i
        while k and not n[k - 1]:
            k -= 1
            v = grown(v, b"<", k)
            runs.append((k, j, *halves(v)))
    return out


def positions(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """The runs of all selected positions of docs (did, rid, text), with their fingerprint; lead is set once for each position."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = string_buffers(b.column("text"))
            did, rid = b.column("did").to_numpy(), b.column("rid").to_numpy()
            fp, size, row, flat = [], [], [], []
            for k, (i, j) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                for f, runs in fingerprints(data[i:j], words):
                    fp.append(f)
                    size.append(len(runs))
                    row.append(k)
                    flat += runs
            at = np.repeat(np.array(row, np.int64), size)
            lead = np.zeros(len(flat), bool)
            lead[np.cumsum(size, dtype=np.int64) - np.array(size, np.int64)] = True
            runs = np.array(flat, np.int64).reshape(-1, 4)
            cols = [np.repeat(np.array(fp, np.int64), size), lead, did[at], rid[at], runs[:, 0].astype(np.int32), runs[:, 1].astype(np.int32), runs[:, 2], runs[:, 3]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [f.split()[0] for f in POSITIONS.split(", ")])

    bounded_batches(docs.sparkSession)
    return docs.select("did", "rid", "text").mapInArrow(work, POSITIONS)


def later_runs(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(did, rid, runs): the line ranges of each row of docs that equal an earlier one."""
    found = written(positions(docs, words))
    shared = found.groupBy("fp").agg(F.count_if("lead").alias("n"), F.count(F.lit(1)).alias("many")).where("n > 1").drop("n")
    met = written(skewed_join(found.drop("lead"), shared, ["fp"], found.count()).select("did", "rid", "start", "stop", "w1", "w2"))
    met = met.withColumn("at", F.struct("did", "start"))
    firsts = met.groupBy("w1", "w2").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count(F.lit(1)).alias("many")).where("first <> last").drop("last")
    later = skewed_join(met, firsts, ["w1", "w2"], met.count()).where("at > first")
    return later.groupBy("did", "rid").agg(F.collect_set(F.struct("start", "stop")).alias("runs"))


def _left(text: str, runs: list | None) -> tuple[str, int, int, int]:
    """The text without the runs, its lines, the lines removed and their maximal runs."""
    lines = text.split("\n")
    if not runs:
        return text, len(lines), 0, 0
    drop = np.zeros(len(lines) + 2, bool)
    for x in runs:
        drop[x["start"] + 1 : x["stop"] + 1] = True
    return "\n".join(x for x, d in zip(lines, drop[1:]) if not d), len(lines), int(drop.sum()), int((drop[1:] & ~drop[:-1]).sum())


def shortened(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs with the text left (n_chars, where there is one, as its length); rows of which no line is left go. Null texts stay."""
    names = docs.columns
    did, rid, runs = (fresh(x, docs) for x in ("did", "rid", "runs"))
    gone = later_runs(texts(docs), words).withColumnsRenamed({"did": did, "rid": rid, "runs": runs})
    keyed = docs.withColumns(dict(zip((did, rid), row_key())))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [(t, 0, 0, 0) if t is None else _left(t, r) for t, r in zip(b.column("text").to_pylist(), b.column(runs).to_pylist())]
            cols = [b.column(n) for n in names]
            cols[names.index("text")] = pa.array([x[0] for x in new], pa.string())
            if "n_chars" in names:
                n = [None if x[0] is None else len(x[0]) for x in new]
                cols[names.index("n_chars")] = pa.array(n, pa.int64()).cast(b.column("n_chars").type)
            keep = [not x[2] or x[2] < x[1] for x in new]
            yield pa.RecordBatch.from_arrays(cols, names).filter(pa.array(keep, pa.bool_()))

    return keyed.join(gone, [did, rid], "left").select(*names, runs).mapInArrow(work, docs.schema)


def deduplicated(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, n_lines, n_removed, n_runs (maximal removed runs), kept_sha256 and the text left, for each row."""
    rows = texts(docs)
    joined = rows.join(later_runs(rows, words), ["did", "rid"], "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for t, r in zip(b.column("text").to_pylist(), b.column("runs").to_pylist()):
                left, n, gone, spans = _left(t, r)
                out.append((n, gone, spans, hashlib.sha256(left.encode()).hexdigest(), left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds))], ["doc_id", "n_lines", "n_removed", "n_runs", "kept_sha256", "text"])

    return joined.select("doc_id", "text", "runs").mapInArrow(work, "doc_id long, n_lines long, n_removed long, n_runs long, kept_sha256 string, text string")
