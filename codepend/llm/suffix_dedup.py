"""Removal of repeated byte strings by deep-shallow sorting of suffixes.

Every byte that a LENGTH-byte string covers goes if that string also starts earlier (smaller doc_id,
or same document and earlier start). Sorting all suffixes of a corpus would shuffle many times its
size, so suffixes that can't repeat are told apart first:

1. Each LENGTH-byte window takes as anchor the least hash of its GRAM-byte strings, so equal windows
   have equal anchors. Windows in a row with one anchor are a segment of the text: one row of hashes.
2. Segments meet by anchor. Of equal segments all but the first are repeats as a whole; a task
   settles its own ones before the shuffle, so a passage in every document sends one row per task.
3. Only where one anchor has different segments, windows may repeat in part: these segments' bytes
   are fetched, and their windows (suffixes cut to LENGTH bytes) sorted: multikey quicksort on 8-byte
   words down to SHALLOW bytes, then, in groups with longer common prefixes, blind tries. Of equal
   windows the first stays. An anchor with more than HOT different segments is settled without
   gathering it: its windows' 128-bit hashes meet in a minimum with map-side combine.

Defined cases: null text is empty; a null doc_id comes before all others; rows with one doc_id and
one text leave each other alone; texts under LENGTH bytes have no windows; no rows give no rows; other
columns are ignored; very long texts are worked on in one piece, at a bounded multiple of their size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG_MIN, bounded_batches, mix, ranges, release, slices, string_buffers, texts, written

LENGTH, GRAM, SHALLOW, HOT = 100, 24, 32, 4096
MOST_HOT = 10_000  # so many hot anchors are told by a list, more by a join
PIECE = 1 << 20
_STATE = np.random.RandomState(77)
_R1, _R2 = (_STATE.randint(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
_B1, _B2 = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    if len(_POWERS.get(base, ())) < n:
        with np.errstate(over="ignore"):
            _POWERS[base] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, PIECE + 1), np.uint64(base))]), dtype=np.uint64)
    return _POWERS[base][:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 2**64)


def _prefix(data: np.ndarray, table: np.ndarray, base: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([[np.uint64(0)], np.cumsum(table[data] * _powers(base, len(data)), dtype=np.uint64)])


def segments(offsets: np.ndarray, data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(row, start in the row, windows, anchor hash, segment hash) of all segments of some rows of bytes."""
    n, w = len(data), length - gram + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, np.uint64),) * 2
    lengths = np.diff(offsets)
    if n < length or lengths.max() < length:
        return none
    with np.errstate(over="ignore"):
        h1, h2 = _prefix(data, _R1, _B1), _prefix(data, _R2, _B2)
        grams = mix((h1[gram:] - h1[:-gram]) * _powers(_inverse(_B1), n - gram + 1))
        key = (grams & np.uint64(0xFFFFFFFF00000000)) | (np.uint64(0xFFFFFFFF) - np.arange(len(grams), dtype=np.uint64))
        have = 1
        while have < w:
            step = min(have, w - have)
            key = np.minimum(key[:-step], key[step:])
            have += step
        anchor = (np.uint64(0xFFFFFFFF) - (key & np.uint64(0xFFFFFFFF))).astype(np.int64)
        long_rows = np.flatnonzero(lengths >= length)
        first, last = offsets[long_rows], offsets[long_rows + 1] - length
        change = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        change[first] = True
        gate = np.zeros(len(anchor) + 1, np.int8)
        gate[first] += 1
        np.add.at(gate, last + 1, -1)
        begin = np.flatnonzero(change & (np.cumsum(gate[:-1]) > 0))
        row = long_rows[np.searchsorted(first, begin, "right") - 1]
        end = np.minimum(np.append(begin[1:], n), offsets[row + 1] - length + 1)  # after the last window
        size = end - begin + length - 1
        seg = mix((h2[begin + size] - h2[begin]) * _powers(_inverse(_B2), n)[begin] + size.astype(np.uint64) * np.uint64(_B1))
    return row, begin - offsets[row], end - begin, grams[anchor[begin]], seg


class BlindTrie:
    """A trie that keeps only the depths at which its strings branch, and the bytes there."""

    def __init__(self) -> None:
        self.root: list | None = None  # a leaf is [string, members]; a node [depth, {byte: child}]

    def insert(self, s: bytes, member: int) -> None:
        """Go down blindly to any leaf, find the true common prefix there, and branch where it ends."""
        if self.root is None:
            self.root = [s, [member]]
            return
        node = self.root
        while isinstance(node[1], dict):
            node = node[1].get(s[node[0]]) or next(iter(node[1].values()))
        if node[0] == s:
            node[1].append(member)
            return
        at = next(i for i, (x, y) in enumerate(zip(node[0], s)) if x != y)
        up, node = None, self.root
        while isinstance(node[1], dict) and node[0] < at:
            up, node = node, node[1][s[node[0]]]
        if isinstance(node[1], dict) and node[0] == at:
            node[1][s[at]] = [s, [member]]
            return
        any_leaf = node
        while isinstance(any_leaf[1], dict):
            any_leaf = next(iter(any_leaf[1].values()))
        new = [at, {any_leaf[0][at]: node, s[at]: [s, [member]]}]
        if up is None:
            self.root = new
        else:
            up[1][s[up[0]]] = new

    def in_order(self) -> Iterator[list[int]]:
        """Members of equal strings, in the strings' order."""
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if isinstance(node[1], dict):
                todo += [node[1][k] for k in sorted(node[1], reverse=True)]
            else:
                yield node[1]


def equal_suffixes(data: np.ndarray, starts: np.ndarray, group: np.ndarray, length: int = LENGTH, shallow: int = SHALLOW) -> np.ndarray:
    """A number for each suffix, shared by those in a group that agree in `length` bytes; -1 where there is no other.

    Multikey quicksort on words of 8 bytes as far as `shallow`; groups that still agree go to blind
    tries, after those equal to their group's first have been set aside.
    """
    out = np.full(len(starts), -1, np.int64)
    if not len(starts):
        return out
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    word = np.zeros(len(data), np.uint64)
    for i in range(8):
        word |= padded[i : i + len(data)] << np.uint64(56 - 8 * i)
    live, cls = np.arange(len(starts)), group.astype(np.int64)
    shallow = min(shallow, length) // 8 * 8
    for depth in range(0, shallow, 8):
        w = word[starts[live] + depth]
        order = np.lexsort((w, cls))
        live, c, w = live[order], cls[order], w[order]
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])])
        cls = np.cumsum(new)
        many = np.bincount(cls)[cls] > 1
        live, cls = live[many], cls[many]
        if not len(live):
            return out
    order = np.argsort(cls, kind="stable")
    live, cls = live[order], cls[order]
    edges = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
    leader = np.repeat(live[edges], np.diff(np.append(edges, len(live))))
    same = np.ones(len(live), bool)
    for depth in range(shallow, length - 7, 8):
        same &= word[starts[live] + depth] == word[starts[leader] + depth]
    for depth in range(length - length % 8, length):
        same &= data[starts[live] + depth] == data[starts[leader] + depth]
    out[live[same]] = leader[same]
    raw = data.tobytes()
    other = np.flatnonzero(~same)
    for block in np.split(other, np.flatnonzero(np.diff(cls[other])) + 1) if len(other) else []:
        trie = BlindTrie()
        for i in live[block].tolist():
            trie.insert(raw[starts[i] : starts[i] + length], i)
        for members in trie.in_order():
            out[members] = members[0]
    alone = np.bincount(out[out >= 0], minlength=len(out)) == 1
    out[(out >= 0) & alone[np.maximum(out, 0)]] = -1
    return out


SEGMENTS = "anchor long, seg long, doc long, rid long, pl long, others binary"
FOUND = "rid long, anchor long, doc long, s int, e int"


def find_segments(docs: DataFrame) -> DataFrame:
    """Segments of all rows (doc_id, rid, text), equal ones of a batch in one row; pl is start * 128 + windows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, rid = b.column("doc_id").fill_null(LONG_MIN).to_numpy(), b.column("rid").to_numpy()
            take = np.argsort(doc, kind="stable")
            offsets, data = string_buffers(b.column("text").take(pa.array(take)))
            doc, rid = doc[take], rid[take]
            parts, i = [], 0
            while i < len(doc):
                j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + PIECE, "right")) - 1)
                row, start, n, anchor, seg = segments(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]])
                parts.append((doc[i + row], rid[i + row], start * 128 + n, anchor, seg))
                i = j
            if not parts:
                continue
            d, r, pl, anchor, seg = (np.concatenate(x) for x in zip(*parts))
            if not len(d):
                continue
            with np.errstate(over="ignore"):
                order = np.argsort(anchor ^ (seg * np.uint64(_B1)), kind="stable")
            d, r, pl, anchor, seg = d[order], r[order], pl[order], anchor[order], seg[order]
            new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (seg[1:] != seg[:-1])])
            first = np.flatnonzero(new)
            later = np.column_stack([d[~new], r[~new], pl[~new]]).astype(np.int64)
            sizes = (np.diff(np.append(first, len(d))) - 1) * 24
            others = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(later))])
            yield pa.RecordBatch.from_arrays([pa.array(anchor[first].view(np.int64)), pa.array(seg[first].view(np.int64)), pa.array(d[first]), pa.array(r[first]), pa.array(pl[first]), others], ["anchor", "seg", "doc", "rid", "pl", "others"])

    bounded_batches(docs.sparkSession, 16)
    return docs.select("doc_id", "rid", "text").mapInArrow(work, SEGMENTS)


def _rows(rid, anchor, doc, s, e) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, t)) for x, t in zip((rid, anchor, doc, s, e), (np.int64, np.int64, np.int64, np.int32, np.int32))], ["rid", "anchor", "doc", "s", "e"])


def resolve(found: DataFrame) -> DataFrame:
    """Repeats (anchor 0: bytes s to e of the text) and segments to look into (anchor not 0: start s, windows e)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first segment of an anchor that has no other so far: (anchor, seg, doc, rid, pl)
        prev = None  # anchor, seg, doc, pl of the first row of the segment that the last batch ended in; anchor known to be shared
        shared_anchor = None
        for b in batches:
            if not b.num_rows:
                continue
            anchor, seg, doc, rid, pl = (b.column(c).to_numpy() for c in ("anchor", "seg", "doc", "rid", "pl"))
            n = len(anchor)
            new = np.concatenate([[prev is None or (anchor[0], seg[0]) != prev[:2]], (anchor[1:] != anchor[:-1]) | (seg[1:] != seg[:-1])])
            lead = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            fd, fp = np.where(lead >= 0, doc[lead], prev[2] if prev else 0), np.where(lead >= 0, pl[lead], prev[3] if prev else 0)
            later = (doc > fd) | (pl > fp)
            out = [(rid[later], pl[later] >> 7, (pl[later] >> 7) + (pl[later] & 127) + LENGTH - 1)]
            packed = b.column("others")
            o, raw = string_buffers(packed)
            if len(raw):
                x = np.frombuffer(raw.tobytes(), np.int64).reshape(-1, 3)
                owner = np.repeat(np.arange(n), np.diff(o) // 24)
                x = x[(x[:, 0] > fd[owner]) | (x[:, 2] > fp[owner])]
                out.append((x[:, 1], x[:, 2] >> 7, (x[:, 2] >> 7) + (x[:, 2] & 127) + LENGTH - 1))
            r, s, e = (np.concatenate(v) for v in zip(*out))
            if len(r):
                yield _rows(r, np.zeros(len(r)), np.zeros(len(r)), s, e)
            # segments' first rows, by anchor: all of them where an anchor has two or more
            f = np.flatnonzero(new)
            rows = [(anchor[f], doc[f], rid[f], pl[f])]
            if held is not None:
                rows.insert(0, tuple(np.array([v], np.int64) for v in held))
            a, d, r, p = (np.concatenate(v) for v in zip(*rows))
            if len(a):
                run = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                size = np.diff(np.append(run, len(a)))
                many = np.repeat(size > 1, size) | (a == shared_anchor if shared_anchor is not None else np.zeros(len(a), bool))
                if many.any():
                    yield _rows(r[many], a[many], d[many], p[many] >> 7, p[many] & 127)
                if many[-1]:
                    shared_anchor, held = a[-1], None
                else:
                    held = (a[-1], d[-1], r[-1], p[-1])
                    shared_anchor = None
            prev = (anchor[-1], seg[-1], fd[-1], fp[-1])

    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return found.repartition(n, "anchor").sortWithinPartitions("anchor", "seg", "doc", "pl").mapInArrow(work, FOUND)


def _lists(col: pa.Array) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Bounds (rows + 1) and the fields of all structs in a column of lists; a null list is empty."""
    sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False)
    flat = col.flatten()
    return np.concatenate([[0], np.cumsum(sizes)]), {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


def contents(joined: DataFrame, hot: list[int], only_hot: bool = False) -> DataFrame:
    """The bytes of segments to look into, but those of hot anchors, or of these only: (anchor, doc, rid, s, content)."""
    hot_anchors = np.array(sorted(hot), np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = string_buffers(b.column("text"))
            bounds, f = _lists(b.column("found"))
            row = np.repeat(np.arange(b.num_rows), np.diff(bounds))
            keep = f["anchor"] != 0
            keep &= np.isin(f["anchor"], hot_anchors) == only_hot
            row, anchor, doc, s, size = row[keep], f["anchor"][keep], f["doc"][keep], f["s"][keep], f["e"][keep].astype(np.int64) + LENGTH - 1
            content = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.py_buffer(data[ranges(offsets[row] + s, size)])])
            rid = b.column("rid").to_numpy()[row]
            yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(doc), pa.array(rid), pa.array(s), content], ["anchor", "doc", "rid", "s", "content"])

    return joined.where("found is not null").select("rid", "text", "found").mapInArrow(work, "anchor long, doc long, rid long, s int, content binary")


def sorted_repeats(inside: DataFrame) -> DataFrame:
    """(rid, s, e): the bytes of windows that equal an earlier one's under their anchor, by deep-shallow sorting."""

    def settle(anchor, doc, rid, s, content) -> pa.RecordBatch:
        offsets, data = string_buffers(content)
        n = np.diff(offsets) - LENGTH + 1
        seg = np.repeat(np.arange(len(n)), n)
        starts = ranges(offsets[:-1], n)
        cls = equal_suffixes(data, starts, anchor[seg])
        at = np.flatnonzero(cls >= 0)
        pos = s[seg[at]] + starts[at] - offsets[seg[at]]
        order = np.lexsort((pos, doc[seg[at]], cls[at]))
        at, pos = at[order], pos[order]
        c, d = cls[at], doc[seg[at]]
        head = np.maximum.accumulate(np.where(np.concatenate([[True], c[1:] != c[:-1]]) if len(c) else np.zeros(0, bool), np.arange(len(c)), 0))
        later = (d > d[head]) | (pos > pos[head])
        owner, pos = seg[at][later], pos[later]
        low, high = np.full(len(n), 2**31 - 1, np.int64), np.full(len(n), -1, np.int64)
        np.minimum.at(low, owner, pos)
        np.maximum.at(high, owner, pos)
        got = np.flatnonzero(high >= 0)  # windows of a segment overlap, so their union is one range
        return pa.RecordBatch.from_arrays([pa.array(rid[got]), pa.array(low[got].astype(np.int32)), pa.array((high[got] + LENGTH).astype(np.int32))], ["rid", "s", "e"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []

        def settled(t: pa.Table) -> pa.RecordBatch:
            return settle(*(t.column(c).combine_chunks().to_numpy() for c in ("anchor", "doc", "rid", "s")), t.column("content"))

        for b in batches:
            if not b.num_rows:
                continue
            kept.append(b)
            t = pa.Table.from_batches(kept)
            a = t.column("anchor").combine_chunks().to_numpy()
            whole = int(np.searchsorted(a, a[-1], "left"))  # the last anchor may go on
            if whole >= 2048:
                yield settled(t.slice(0, whole))
                kept = t.slice(whole).combine_chunks().to_batches()
        if kept:
            yield settled(pa.Table.from_batches(kept))

    n = int(inside.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return inside.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(work, "rid long, s int, e int")


def window_hashes(data: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the bytes from each start on, from running sums over the whole."""
    out = []
    with np.errstate(over="ignore"):
        for table, base in ((_R1, _B1), (_R2, _B2)):
            h = _prefix(data, table, base)
            out.append(mix((h[starts + length] - h[starts]) * _powers(_inverse(base), len(data) + 1)[starts]).view(np.int64))
    return out[0], out[1]


def hashed_repeats(inside: DataFrame) -> DataFrame:
    """The same for anchors with very many segments: windows meet as 128-bit hashes in a minimum with map-side combine."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = string_buffers(b.column("content"))
            doc, rid, s = (b.column(c).to_numpy() for c in ("doc", "rid", "s"))
            for i, j in slices(offsets, PIECE):
                own = offsets[i : j + 1] - offsets[i]
                n = np.diff(own) - LENGTH + 1
                seg, starts = np.repeat(np.arange(j - i), n), ranges(own[:-1], n)
                w1, w2 = window_hashes(data[offsets[i] : offsets[j]], starts)
                at = s[i + seg] + starts - own[seg]
                yield pa.RecordBatch.from_arrays([pa.array(w1), pa.array(w2), pa.array(doc[i + seg]), pa.array(rid[i + seg]), pa.array(at.astype(np.int32))], ["w1", "w2", "doc", "rid", "s"])

    w = inside.mapInArrow(work, "w1 long, w2 long, doc long, rid long, s int").withColumn("at", F.struct("doc", "s"))
    firsts = w.groupBy("w1", "w2").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first <> last").drop("last")
    return w.join(firsts, ["w1", "w2"]).where("at > first").select("rid", "s", (F.col("s") + LENGTH).alias("e"))


def repeats_removed(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row; with_text: the bytes left too."""
    rows = texts(docs).select("rid", "doc_id", "text")
    per_row = written(resolve(find_segments(rows)).groupBy("rid").agg(F.collect_list(F.struct("anchor", "doc", "s", "e")).alias("found")))
    release(docs.sparkSession)
    joined = rows.join(per_row, "rid", "left")
    anchors = per_row.select(F.explode(F.filter("found", lambda x: x["anchor"] != 0)["anchor"]).alias("anchor"))
    hot = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT).select("anchor")
    known = [r["anchor"] for r in hot.limit(MOST_HOT + 1).collect()]  # MOST_HOT numbers
    if len(known) <= MOST_HOT:
        partly = sorted_repeats(contents(joined, known))
        if known:
            partly = partly.union(hashed_repeats(contents(joined, known, True)))
    else:
        inside = contents(joined, [])
        partly = sorted_repeats(inside.join(hot, "anchor", "left_anti")).union(hashed_repeats(inside.join(hot, "anchor", "left_semi")))
    parts = partly.groupBy("rid").agg(F.collect_list(F.struct("s", "e")).alias("parts"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            offsets, data = string_buffers(b.column("text"))
            (at1, f), (at2, g) = _lists(b.column("found")), _lists(b.column("parts"))
            for k in range(b.num_rows):
                raw = data[offsets[k] : offsets[k + 1]]
                sure = f["anchor"][at1[k] : at1[k + 1]] == 0
                s = np.concatenate([f["s"][at1[k] : at1[k + 1]][sure], g["s"][at2[k] : at2[k + 1]]])
                e = np.concatenate([f["e"][at1[k] : at1[k + 1]][sure], g["e"][at2[k] : at2[k + 1]]])
                left, spans = raw, 0
                if len(s):
                    edge = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(edge, s, 1)
                    np.add.at(edge, e, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    left, spans = raw[~gone], int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                left = left.tobytes()
                out.append((len(raw), len(raw) - len(left), spans, hashlib.sha256(left).hexdigest(), left))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
            cols = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 5, kinds)][: 5 if with_text else 4]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", *names[: len(cols)]])

    whole = joined.join(parts, "rid", "left").select("doc_id", "text", "found", "parts")
    return whole.mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if with_text else ""))
