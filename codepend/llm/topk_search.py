"""Exact top-k inner-product search by norm buckets.

Every component x becomes floor(256 * x), x as double. Vectors are range-partitioned by falling
length and packed into buckets of at most BUCKET vectors. A query's k-th best score in the longest
bucket is its first threshold. In each bucket the local cosine threshold (threshold / |q| / longest
vector) chooses: above 1 the bucket is skipped; where it is high, candidates must lie in the
feasible range of the query's strongest coordinates; else only a prefix of the bucket, by length,
is looked at. What is left is verified by exact products. A block of queries whose thresholds all lie
above what the longest vector of a bucket can reach never meets that bucket.

Query blocks meet buckets through an equi-join on the range partition (a stated query set against
all rows, in blocks), so a task holds one bucket and one block of queries at a time; nothing is
broadcast or collected.

Defined cases: vectors that are null or hold null or non-finite components take no part, neither
as queries nor as candidates; vectors of unequal length are compared as if filled up with zeros;
an empty vector scores 0; a query never meets its own row's id; ties go to the smaller vec_id;
rows that repeat a vec_id are candidates each, equal ones once; a null vec_id takes no part;
components stay whole numbers of any size, and scores beyond 2^53 are summed exactly; as `score` is a
long, one that leaves its range is ranked by its true value and shown as the nearest long; components
whose 256-fold leaves the double range count as not finite; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut

BUCKET, BLOCK, COORDINATES = 4096, 512, 3
HIGH = 0.6  # local cosine threshold from which coordinates prune better than lengths
PACKED = "part int, seq int, n int, dim int, top double, ids binary, vectors binary"
LONG = 2**63


def integer_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id and the vector of floored components, without vectors that take no part; equal rows once."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where("vec_id is not null and x is not null")
    e = e.where("not exists(x, c -> c is null or isnan(c) or abs(256 * c) = double('infinity'))")
    # floor() gives a long; beyond 2^52 doubles are whole already
    return e.select("vec_id", F.expr("transform(x, c -> if(abs(256 * c) < 4503599627370496D, double(floor(256 * c)), 256 * c))").alias("v")).distinct()


def _pack(limit: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, ids, rows = TaskContext.get().partitionId(), 0, [], []

        def packed() -> pa.RecordBatch:
            dim = max(map(len, rows))
            m = np.zeros((len(rows), dim))
            for i, r in enumerate(rows):
                m[i, : len(r)] = r
            row = {"part": part, "seq": seq, "n": len(rows), "dim": dim, "top": float(_lengths(m).max()), "ids": np.array(ids, np.int64).tobytes(), "vectors": m.tobytes()}
            kinds = {"part": pa.int32(), "seq": pa.int32(), "n": pa.int32(), "dim": pa.int32(), "top": pa.float64(), "ids": pa.binary(), "vectors": pa.binary()}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema(list(kinds.items())))

        for b in batches:
            for i, v in zip(b.column("vec_id").to_pylist(), b.column("v")):
                ids.append(i)
                rows.append(v.values.to_numpy(zero_copy_only=False))
                if len(rows) == limit:
                    yield packed()
                    seq, ids, rows = seq + 1, [], []
        if rows:
            yield packed()

    return work


def _lengths(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((m * m).sum(1))


def _products(q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles: in doubles where no sum can leave 53 bits, else in Python's integers."""
    if not m.size or not q.size:
        return np.zeros(len(m), np.int64)
    with np.errstate(over="ignore"):
        small = np.abs(q).max() * np.abs(m).max() * len(q) < 2**53
    if small:
        return (m @ q).astype(np.int64)
    whole = [int(x) for x in q]
    scores = [sum(a * int(x) for a, x in zip(whole, r)) for r in m]
    return np.array(scores, np.int64 if not scores or max(map(abs, scores)) < LONG else object)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if scores.dtype == object:
        order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k]
        return ids[order], scores[order]
    if len(ids) > k:
        keep = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class Bucket:
    """Integer vectors in the order of falling length, with unit vectors for pruning."""

    def __init__(self, ids: bytes, vectors: bytes, n: int, dim: int):
        self.ids, self.m = np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.float64).reshape(n, dim)
        length = _lengths(self.m)
        order = np.argsort(-length, kind="stable")
        self.ids, self.m, self.length = self.ids[order], self.m[order], length[order]
        self.unit = np.ascontiguousarray((self.m / np.maximum(self.length, 1e-300)[:, None]).T)
        self.finite = bool(np.isfinite(length).all())

    def search(self, query: np.ndarray, own: int, k: int, threshold: float | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of at most k vectors, among them every one that can be among the best k with at least the threshold."""
        dim = max(len(query), self.m.shape[1])
        q = np.zeros(dim)
        q[: len(query)] = query
        m = self.m if self.m.shape[1] == dim else np.pad(self.m, ((0, 0), (0, dim - self.m.shape[1])))
        keep = self.ids != own
        ql = float(_lengths(q[None])[0])
        if threshold is not None and threshold > 0 and self.finite and np.isfinite(ql):
            if ql == 0 or not len(self.length) or self.length[0] == 0:
                return self.ids[:0], np.zeros(0, np.int64)
            local = threshold / ql / self.length[0] * (1 - 1e-9)
            if local > 1:
                return self.ids[:0], np.zeros(0, np.int64)
            if local >= HIGH:
                for f in np.argsort(-np.abs(q[: len(self.unit)]), kind="stable")[:COORDINATES]:
                    at = float(q[f]) / ql
                    slack = np.sqrt(max(0.0, (1 - at * at) * (1 - local * local))) + 1e-9
                    if -at < local:
                        keep &= self.unit[f] >= at * local - slack
                    if at < local:
                        keep &= self.unit[f] <= at * local + slack
            else:
                keep &= self.length >= threshold / ql * (1 - 1e-9)
        at = np.flatnonzero(keep)
        return _best(self.ids[at], _products(q, m[at]), k)


def top_k(embeddings: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of queries (vec_id, embedding) its k best of all other rows."""
    spark = embeddings.sparkSession
    bounded_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    data = integer_vectors(embeddings).withColumn("l2", F.expr("aggregate(v, 0D, (s, c) -> s + double(c) * c)"))
    dealt = data.repartitionByRange(parts, F.desc("l2"), "vec_id").sortWithinPartitions(F.desc("l2"), "vec_id")
    buckets = cut(dealt.select("vec_id", "v").mapInArrow(_pack(BUCKET), PACKED))
    blocks = integer_vectors(queries).mapInArrow(_pack(BLOCK), PACKED).select(*(F.col(c).alias(f"q_{c}") for c in ("n", "dim", "ids", "vectors")))

    def queries_of(r: dict) -> Iterator[tuple[int, np.ndarray]]:
        return zip(np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["q_vectors"], np.float64).reshape(r["q_n"], r["q_dim"]))

    def seed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, need = [], []
            for r in b.to_pylist():
                low = np.full(r["q_n"], -np.inf)
                if r["n"] is not None:
                    bucket = Bucket(r["ids"], r["vectors"], r["n"], r["dim"])
                    for at, (own, q) in enumerate(queries_of(r)):
                        _, s = bucket.search(q, own, k, None)
                        if len(s) >= k:  # a double just below, where the score isn't one
                            low[at] = np.nextafter(float(max(min(int(s[-1]), 10**300), -(10**300))), -np.inf) if abs(int(s[-1])) > 2**53 else float(s[-1])
                length = _lengths(np.frombuffer(r["q_vectors"], np.float64).reshape(r["q_n"], r["q_dim"]))
                with np.errstate(invalid="ignore", divide="ignore"):
                    least = np.where(low > 0, low / length, -1.0)  # the length that a vector must have
                found.append(low.tobytes())
                need.append(float(np.nan_to_num(least, nan=-1.0).min()) * (1 - 1e-9))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("q_n", "q_dim", "q_ids", "q_vectors")), pa.array(found, pa.binary()), pa.array(need, pa.float64())], ["q_n", "q_dim", "q_ids", "q_vectors", "low", "need"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple = (None, None)
        for b in batches:
            for r in b.to_pylist():
                if last[0] != (r["part"], r["seq"]):
                    last = (r["part"], r["seq"]), Bucket(r["ids"], r["vectors"], r["n"], r["dim"])
                query, vec, beyond, score = [], [], [], []
                for (own, q), t in zip(queries_of(r), np.frombuffer(r["low"])):
                    ids, scores = last[1].search(q, own, k, float(t))
                    query += [own] * len(ids)
                    vec += ids.tolist()
                    beyond += [None if -LONG < s < LONG else f"{int(s) + 10**700:0701d}" for s in scores]  # in the order of true values
                    score += [max(min(int(s), LONG - 1), -LONG) for s in scores]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((query, vec, beyond, score), (pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["query_id", "vec_id", "beyond", "score"])

    first = buckets.where("part = 0 and seq = 0").select("n", "dim", "ids", "vectors", F.col("seq").alias("first"))
    seeded = blocks.withColumn("first", F.lit(0)).join(F.broadcast(first), "first", "left").select("q_n", "q_dim", "q_ids", "q_vectors", "n", "dim", "ids", "vectors")  # one bucket: BUCKET vectors at most
    seeded = cut(seeded.mapInArrow(seed, "q_n int, q_dim int, q_ids binary, q_vectors binary, low binary, need double"))
    met = buckets.join(seeded.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))), "part").where("need <= top")
    found = met.select("part", "seq", "q_n", "q_dim", "q_ids", "q_vectors", "low", "n", "dim", "ids", "vectors").mapInArrow(probe, "query_id long, vec_id long, beyond string, score long")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc_nulls_last("beyond"), "vec_id")
    return found.distinct().withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
