"""Near-duplicate documents by HyperMinHash.

A document's set holds the hashes of its distinct SHINGLE-word shingles; with fewer words, that of
the whole sequence; without words it is empty. Equal sets are one class from the start. A class
keeps, for each of REGISTERS buckets of the hash range, the least hash of the bucket as a count of
leading zeros and MANTISSA bits, 16 bits in all. Bands of ROWS registers deal out candidates: bands that
one class has are dropped first; in the group of any other, every member meets the group's least
and greatest doc_id (aggregates, no lists), so a large family shares its leaders over all bands.
Candidates pass an estimate of the Jaccard similarity from equal registers, less the equalities
expected by chance, with a margin of four standard errors, and are then confirmed on the full sets.
Groups that still hold several components are finished exactly: groups up to SMALL by pairs of
different components; larger ones are cut into blocks by the bytes of their sets. There only pairs
that aren't both of the group's largest component need be seen, so its members go to one block and
the others to all; tasks compare registers, then full sets, and give out links alone.

Defined cases: null text is empty; an empty set links with nothing; rows that share a doc_id are one
vertex; a null doc_id links with nothing, has a null component_id and is kept; no rows give no rows;
other columns are ignored; very long texts are hashed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_PART, bounded_batches, components, cut, mix, release, skewed_join, slices, string_buffers, texts, tidy

SHINGLE = 5
REGISTERS, MANTISSA, ROWS = 256, 10, 8
SMALL, BLOCK_BYTES = 32, 4 << 20
_RANDOM = np.random.RandomState(20240229).randint(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_P = np.uint64(0x9E3779B97F4A7C15)
_PLACE = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def word_hashes(offsets: np.ndarray, data: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all rows, and the number of words before each row's end (rows + 1, from 0)."""
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    first = offsets[:-1][np.diff(offsets) > 0]
    starts[first] = inside[first]
    begin = np.flatnonzero(starts)
    words = np.searchsorted(begin, offsets)
    if not len(begin):
        return np.zeros(0, np.uint64), words
    kept = np.flatnonzero(inside)
    at = np.searchsorted(kept, begin)
    length = np.diff(np.append(at, len(kept)))
    place = np.arange(len(kept)) - np.repeat(at, length)
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(int(length.max()), _P)]), dtype=np.uint64)
        letters = data[kept]
        value = _RANDOM[_FOLD[letters] if fold else letters] * power[place]
        return mix(np.add.reduceat(value, at) + length.astype(np.uint64) * _PLACE[60]), words


def shingle_sets(offsets: np.ndarray, data: np.ndarray, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    for i, j in slices(offsets):
        yield from _shingle_sets(offsets[i : j + 1] - offsets[i], data[offsets[i] : offsets[j]], size)


def _shingle_sets(offsets: np.ndarray, data: np.ndarray, size: int) -> Iterator[np.ndarray]:
    h, words = word_hashes(offsets, data)
    with np.errstate(over="ignore"):
        joined = mix(sum((h[k : len(h) - size + 1 + k] * _PLACE[k] for k in range(size)), np.zeros(max(0, len(h) - size + 1), np.uint64)))
        for i, j in zip(words[:-1].tolist(), words[1:].tolist()):
            if j - i >= size:
                own = np.sort(joined[i : j - size + 1])
                yield own[np.concatenate([[True], own[1:] != own[:-1]])]
            elif j > i:
                yield mix(np.array([(h[i:j] * _PLACE[: j - i]).sum() + np.uint64(j - i)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """Sorted distinct hashes to REGISTERS times (1 + leading zeros, mantissa), 0 for an empty bucket."""
    out = np.zeros(REGISTERS, np.uint16)
    if len(shingles):
        bucket = (shingles >> np.uint64(56)).astype(np.int64)
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        least = (shingles[at] & np.uint64(2**56 - 1)) >> np.uint64(3)
        m, e = np.frexp(least.astype(np.float64))
        out[bucket[at]] = ((54 - e) << MANTISSA) + np.where(least > 0, (m * 2 - 1) * 2**MANTISSA, 0).astype(np.int64)
    return out


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of rows of registers, corrected for chance equality, and the registers in use."""
    used = ((a > 0) | (b > 0)).sum(-1)
    equal = ((a == b) & (a > 0)).sum(-1)
    ratio = np.minimum(na, nb) / np.maximum(np.maximum(na, nb), 1)
    chance = 0.169919487159739 * used / 2**MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (equal - chance) / np.maximum(used, 1), used


def likely(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the estimate is within four standard errors of the similarity, and the sizes allow it."""
    j, used = estimate(a, b, na, nb)
    return (j >= similarity - 4 * np.sqrt(similarity * (1 - similarity) / np.maximum(used, 1))) & (np.minimum(na, nb) >= similarity * np.maximum(na, nb) - 1e-9)


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n, a 128-bit hash of the set and its registers, for every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2, regs = [], [], [], []
            for s in shingle_sets(*string_buffers(b.column("text"))):
                h = xxhash.xxh3_128_intdigest(s.tobytes())
                n.append(len(s))
                h1.append((h >> 64) - 2**63)
                h2.append((h & (2**64 - 1)) - 2**63)
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(regs, pa.binary())], ["doc_id", "n", "h1", "h2", "regs"])

    bounded_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(tidy(work), "doc_id long, n long, h1 long, h2 long, regs binary")


def bands(classes: DataFrame) -> DataFrame:
    """(key, band, doc_id, n) for each band that has a register in use."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            r = _by_band(np.frombuffer(b"".join(b.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS))
            if not len(r):
                continue
            with np.errstate(over="ignore"):
                key = mix((r.astype(np.uint64) * _PLACE[:ROWS]).sum(-1, dtype=np.uint64) + _PLACE[8] * np.arange(1, REGISTERS // ROWS + 1, dtype=np.uint64))
            used = (r > 0).any(-1)
            row, band = np.nonzero(used)
            yield pa.RecordBatch.from_arrays([pa.array(key[used].view(np.int64)), pa.array(band.astype(np.int32)), pa.array(b.column("doc_id").to_numpy()[row]), pa.array(b.column("n").to_numpy()[row])], ["key", "band", "doc_id", "n"])

    return classes.select("doc_id", "n", "regs").mapInArrow(tidy(work), "key long, band int, doc_id long, n long")


def _by_band(regs: np.ndarray) -> np.ndarray:
    return regs.reshape(*regs.shape[:-1], REGISTERS // ROWS, ROWS)


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(doc_id, set): the shingle hashes of the needed documents."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s.tobytes() for s in shingle_sets(*string_buffers(b.column("text")))], pa.binary())], ["doc_id", "set"])

    return docs.select("doc_id", "text").join(needed, "doc_id", "left_semi").mapInArrow(tidy(work), "doc_id long, set binary")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are as similar as that."""
    if min(len(x), len(y)) * 100 < percent * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(x) + len(y) - same)


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b), those whose full sets are similar enough."""
    similarity = percent / 100

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                ra, rb = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb"))
                keep = likely(ra, rb, b.column("na").to_numpy(), b.column("nb").to_numpy(), similarity)
                yield b.select(["a", "b"]).filter(pa.array(keep))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b.column("sa").to_pylist(), b.column("sb").to_pylist())]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    c = classes.select("doc_id", "n", "regs")
    pairs = pairs.join(c.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("regs").alias("ra")), "a").join(c.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("regs").alias("rb")), "b")
    near = cut(pairs.mapInArrow(tidy(filtered), "a long, b long").distinct())
    needed = near.select(F.col("a").alias("doc_id")).union(near.select("b")).distinct()
    full = cut(_sets(docs, needed))
    release(docs.sparkSession)  # shuffled texts and registers
    sized = near.join(full.select(F.col("doc_id").alias("a"), F.col("set").alias("sa")), "a").join(full.select(F.col("doc_id").alias("b"), F.col("set").alias("sb")), "b")
    return sized.mapInArrow(tidy(verified), "a long, b long")


def _block_links(members: DataFrame, classes: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) between different components c within large groups (key, band, doc_id, n, c)."""

    def work(key: tuple, t: pa.Table) -> pa.Table:
        i, j, band = key[2].as_py(), key[3].as_py(), t.column("band")[0].as_py()
        regs = np.frombuffer(b"".join(t.column("regs").to_pylist()), np.uint16).reshape(-1, REGISTERS)
        sets = [np.frombuffer(x, np.uint64) for x in t.column("set").to_pylist()]
        n, c, ids, block, minor = (t.column(x).to_numpy() for x in ("n", "c", "doc_id", "block", "minor"))
        label, by_band, found = np.unique(c, return_inverse=True)[1], _by_band(regs), []
        across = key[1].as_py() == 1
        right = np.flatnonzero(~minor.astype(bool) if across else block == j)
        for x in np.flatnonzero(minor.astype(bool) & (block == i)):
            y = right[(label[right] != label[x]) & (across | (i != j) | (right > x))]
            y = y[likely(regs[x], regs[y], n[x], n[y], percent / 100)] if len(y) else y
            if len(y):  # a pair is seen in the first of the bands that it shares
                y = y[((by_band[y] == by_band[x]).all(-1) & (by_band[x] > 0).any(-1)).argmax(1) == band]
            for z in y:
                if label[z] != label[x] and similar(sets[x], sets[z], percent):
                    found.append((ids[x], ids[z]))
                    label[label == label[z]] = label[x]
        pair = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pair.min(1), "b": pair.max(1)})

    needed = members.select("doc_id").distinct()
    full = cut(_sets(docs, needed).join(classes.select("doc_id", "regs"), "doc_id"))
    release(docs.sparkSession)  # shuffled sets
    by_component = members.groupBy("key", "c").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * 8 + 2 * REGISTERS).alias("bytes"))
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(size / BLOCK_BYTES)).cast("int")
    of_key = by_component.groupBy("key").agg(F.max(F.struct("k", "c", "bytes")).alias("top"), F.sum("bytes").alias("all"), F.sum("k").alias("many"))
    of_key = of_key.select("key", "many", F.col("top.c").alias("major"), blocks(F.col("top.bytes")).alias("majors"), blocks(F.col("all") - F.col("top.bytes")).alias("minors"))
    m = skewed_join(members, of_key, ["key"], members.count()).withColumn("minor", (F.col("c") != F.col("major")).cast("int"))
    m = m.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.when(F.col("minor") == 1, F.col("minors")).otherwise(F.col("majors"))).cast("int"))
    cells = F.expr("""if(minor = 1,
        concat(transform(sequence(0, minors - 1), q -> struct(0 as kind, least(block, q) as i, greatest(block, q) as j)), transform(sequence(0, majors - 1), q -> struct(1 as kind, block as i, q as j))),
        transform(sequence(0, minors - 1), q -> struct(1 as kind, q as i, block as j)))""")
    m = m.join(full, "doc_id").withColumn("cell", F.explode(cells))
    return m.select("key", "cell.*", "band", "block", "minor", "doc_id", "c", "n", "regs", "set").groupBy("key", "kind", "i", "j").applyInArrow(work, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) and kept, for each row."""
    docs = texts(docs).select("doc_id", "text")
    signed = cut(signatures(docs))
    live = signed.where("n > 0 and doc_id is not null")
    least = live.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("many"))
    owned = skewed_join(live, least, ["h1", "h2"], live.count()).drop("many")
    classes = cut(owned.where("doc_id = rep").dropDuplicates(["h1", "h2"]).select("doc_id", "n", "regs"))
    leaders = bands(classes).groupBy("key").agg(F.count(F.lit(1)).alias("many"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("many > 1")
    leaders, every = cut(leaders), bands(classes)
    # bands that hold much of the rows, HOT_PART at most, are told by a list, so that no join is needed to leave them out of the shuffle
    hot = [r["key"] for r in leaders.where(F.col("many") * HOT_PART >= classes.count() * (REGISTERS // ROWS)).select("key").collect()]
    is_hot = F.col("key").isin(hot)
    keyed = every.where(~is_hot).join(leaders.where(~is_hot), "key")
    keyed = cut(keyed.unionByName(every.where(is_hot).join(F.broadcast(leaders.where(is_hot)), "key")) if hot else keyed)
    release(docs.sparkSession)  # shuffled bands
    stars = keyed.select(F.explode(F.array("lo", "hi")).alias("l"), "doc_id").where("l <> doc_id").select(F.least("l", "doc_id").alias("a"), F.greatest("l", "doc_id").alias("b")).distinct()
    owned = owned.select("doc_id", "rep").distinct()
    shared = owned.groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id")
    same = owned.join(shared, "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    joined = cut(components(_confirmed(stars, classes, docs, percent).union(same)))
    placed = cut(keyed.join(joined, keyed.doc_id == joined.node, "left").select("key", "band", "doc_id", "n", "many", F.coalesce("component", "doc_id").alias("c")).where("many > 2"))
    open_keys = placed.groupBy("key", "many").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("key", "many")
    rest = cut(skewed_join(placed.drop("many"), open_keys, ["key"], keyed.count()))
    release(docs.sparkSession)  # placed bands
    if not rest.isEmpty():
        small = rest.where(F.col("many") <= SMALL)
        pairs = small.alias("p").join(small.alias("q"), F.expr("p.key = q.key and p.doc_id < q.doc_id and p.c <> q.c")).select(F.col("p.doc_id").alias("a"), F.col("q.doc_id").alias("b"))
        large = rest.where(F.col("many") > SMALL).select("key", "band", "doc_id", "n", "c")
        more = _confirmed(pairs.distinct(), classes, docs, percent).union(_block_links(large, classes, docs, percent))
        # joins of components, on the graph of components
        of = joined.select("node", "component")
        step = more.join(of.withColumnsRenamed({"node": "a", "component": "ca"}), "a", "left").join(of.withColumnsRenamed({"node": "b", "component": "cb"}), "b", "left").select(F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb"))
        up = components(step, "ca", "cb")
        every = of.union(up.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("own"))
        joined = cut(every.join(up.select(F.col("node").alias("own"), F.col("component").alias("top")), "own", "left").select("node", F.coalesce("top", "own").alias("component")))
    # vertices are the classes' smallest ids; a class passes its component on to all of its documents
    by_class = owned.join(joined, owned.rep == joined.node, "left").select("doc_id", F.coalesce("component", "rep").alias("component_id"))
    own = by_class.union(joined.select("node", "component")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    out = signed.select("doc_id", F.col("n").alias("n_shingles")).join(own, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def distinct_documents(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of docs that near_duplicates keeps: of each group the document with the smallest doc_id."""
    gone = near_duplicates(docs, percent).where("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
