"""Byte-level BPE over the distinct words of a corpus.

Rows are cut into blocks, in which those with the same text share it. One pass takes the distinct
pre-tokens of each block and deals them out by a hash of the word, packed by (bucket, block); in its bucket each distinct word of the whole
corpus is encoded once. Ids go back packed by block, where a second pass over the texts has left
its pre-tokens as positions into the block's word list; ids are put together by position, and the
token-byte table turns them back into bytes. So texts are never shuffled, and no task holds more than
one block or one bucket of words. Blocks carry a hash of their texts; a block whose words and
positions don't agree (its input changed between the passes) raises instead of giving wrong ids.

The broadcast vocabulary has a fixed size (the tokenizer's file).

Defined cases: null text is empty and gives no ids; each row gives a row, repeated ones too; very
long texts are blocks of their own; no rows give no rows; other columns are ignored; texts that
aren't valid UTF-8 can't occur in a Spark string.
"""

from __future__ import annotations

import base64
import hashlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LONG_MIN, bounded_batches, ranges, tidy

BLOCK_BYTES, BLOCK_ROWS = 16 << 20, 1 << 16
SPREAD = 4  # buckets of words for each shuffle partition
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to ids, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _zip(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(x)


def _unzip(x: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(x)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, list[int], list[str]]]:
    """(key, doc ids, the number of each row's text, distinct texts), a function of the rows alone."""

    def block(ids: list, which: list[int], rows: list[str]) -> tuple[int, list, list[int], list[str]]:
        h = xxhash.xxh3_64()
        for i, k in zip(ids, which):
            h.update(f"{i} {k} ".encode())
        for t in rows:
            h.update(f"{len(t)} ".encode())
            h.update(t.encode())
        return h.intdigest() - 2**63, ids, which, rows

    ids, which, index, size = [], [], {}, 0
    for b in batches:
        for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
            k = index.get(t)
            if ids and (len(ids) >= BLOCK_ROWS or (k is None and size + len(t) > BLOCK_BYTES)):
                yield block(ids, which, list(index))
                ids, which, index, size, k = [], [], {}, 0, None
            if k is None:
                k = index[t] = len(index)
                size += len(t)
            ids.append(i)
            which.append(k)
    if ids:
        yield block(ids, which, list(index))


def _positions(rows: list[str], pattern) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """The block's words by first appearance, the pre-tokens as numbers of words, and how many each text has."""
    index: dict[str, int] = defaultdict(count().__next__)
    at, n = [], []
    for t in rows:
        words = pattern.findall(t)
        n.append(len(words))
        at.append(np.fromiter(map(index.__getitem__, words), np.uint32, len(words)))
    return index, np.concatenate(at) if at else np.zeros(0, np.uint32), np.array(n, np.int64)


def encode_words(words: list[bytes], encode) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and all ids."""
    ids = [encode(w) for w in words]
    n = np.fromiter(map(len, ids), np.int64, len(ids))
    return n, np.fromiter((x for i in ids for x in i), np.uint32, int(n.sum()))


def decode(ids: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> bytes:
    """Bytes of a row of ids, gathered from the token-byte table."""
    ids = ids.astype(np.int64)
    return table[ranges(offsets[ids], offsets[ids + 1] - offsets[ids])].tobytes()


def tokenize(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Ids' and decoded bytes' digests of each row of docs (doc_id, text); with_ids: the ids themselves too."""
    spark = docs.sparkSession
    bounded_batches(spark)
    ranks = spark.sparkContext.broadcast(read_ranks(ranks_path))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = parts * SPREAD
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    packed = "block long, kind int, a binary, b binary, n long"

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        p = regex.compile(pattern)
        for key, _, _, texts in _blocks(batches):
            index, _, _ = _positions(texts, p)
            own = [w.encode() for w in index]
            bucket = np.fromiter((xxhash.xxh32_intdigest(w) for w in own), np.int64, len(own)) % buckets
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[order], prepend=-1)) if len(own) else np.zeros(0, np.int64)
            out = []
            for i, j in zip(edges, [*edges[1:], len(own)]):
                at = order[i:j]
                out.append((int(bucket[at[0]]), key, _zip(at.astype(np.uint32).tobytes()), _zip(np.array([len(own[k]) for k in at], np.uint32).tobytes()), _zip(b"".join(own[k] for k in at))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "block", "at", "lengths", "words"])

    def ids_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        table = ranks.value
        tok = tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})
        bucket, known = None, {}

        def encode(w: bytes) -> bytes:
            if (got := known.get(w)) is None:
                got = known[w] = np.array([table[w]] if w in table else tok.encode_ordinary(w.decode()), np.uint32).tobytes()
            return got

        for b in batches:
            out = []
            for r in b.to_pylist():
                if r["bucket"] != bucket:
                    bucket, known = r["bucket"], {}
                raw, lengths = _unzip(r["words"]), np.frombuffer(_unzip(r["lengths"]), np.uint32).astype(np.int64)
                ends = np.cumsum(lengths)
                ids = [encode(raw[i:j]) for i, j in zip((ends - lengths).tolist(), ends.tolist())]
                n = np.fromiter(map(len, ids), np.uint32, len(ids)) // 4
                out.append((r["block"], 0, r["at"], _zip(n.astype(np.uint32).tobytes() + b"".join(ids)), len(n)))
            yield _packed(out)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        p = regex.compile(pattern)
        for key, ids, which, texts in _blocks(batches):
            index, at, n = _positions(texts, p)
            head = np.array([len(ids), *(LONG_MIN if i is None else i for i in ids), *which], np.int64).tobytes()
            yield _packed([(key, 1, _zip(head + n.tobytes()), _zip(at.astype(np.uint32 if len(index) > 65536 else np.uint16).tobytes()), len(index))])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = sorted(ranks.value.items(), key=lambda x: x[1])
        length = np.zeros(tokens[-1][1] + 2, np.int64)
        for t, i in tokens:
            length[i + 1] = len(t)
        offsets, table = np.cumsum(length), np.frombuffer(b"".join(t for t, _ in tokens), np.uint8)
        block, at, n, ids = None, [], [], []
        for b in batches:
            for r in b.to_pylist():
                if r["block"] != block:
                    block, at, n, ids = r["block"], [], [], []
                if r["kind"] == 0:
                    a, raw = np.frombuffer(_unzip(r["a"]), np.uint32), np.frombuffer(_unzip(r["b"]), np.uint32)
                    at.append(a)
                    n.append(raw[: len(a)])
                    ids.append(raw[len(a) :])
                    continue
                head = np.frombuffer(_unzip(r["a"]), np.int64)
                rows = int(head[0])
                doc_ids, which, sizes = head[1 : rows + 1], head[rows + 1 : 2 * rows + 1], head[2 * rows + 1 :]
                where = np.frombuffer(_unzip(r["b"]), np.uint32 if r["n"] > 65536 else np.uint16)
                # the words of a block that occurs twice come twice, and alike
                begin, many = np.full(r["n"], -1, np.int64), np.zeros(r["n"], np.int64)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
                if at:
                    a, m = np.concatenate(at), np.concatenate(n).astype(np.int64)
                    if r["n"] <= a.max():
                        raise RuntimeError("a block's words don't agree with its positions")
                    begin[a], many[a] = np.cumsum(m) - m, m
                if (begin < 0).any():
                    raise RuntimeError("a block's words don't agree with its positions")
                made, done = [], 0
                for size in sizes.tolist():
                    w = where[done : done + size].astype(np.int64)
                    done += size
                    own = flat[ranges(begin[w], many[w])]
                    raw = own.astype("<u4").tobytes()
                    made.append((len(own), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decode(own, offsets, table)).hexdigest(), own.astype(np.int32) if with_ids else None))
                cols = [[None if i == LONG_MIN else i for i in doc_ids.tolist()], *zip(*(made[k] for k in which.tolist()))]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string()] + ([pa.list_(pa.int32())] if with_ids else [])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(kinds)])

    coded = rows.mapInArrow(tidy(words), "bucket int, block long, at binary, lengths binary, words binary").repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(tidy(ids_of), packed)
    whole = coded.union(rows.mapInArrow(tidy(frames), packed)).repartition(parts, "block").sortWithinPartitions("block", "kind")
    return whole.mapInArrow(tidy(together), DIGESTS + (", ids array<int>" if with_ids else ""))


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 5, kinds)], ["block", "kind", "a", "b", "n"])
