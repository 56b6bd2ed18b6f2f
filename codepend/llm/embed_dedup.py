"""Embedding near-dedup on a robust-pruned flat graph.

Equal vectors are one class from the start. Centroids, fitted on at most SAMPLE classes, cut the
classes into overlapping shards: a vector is at home in its nearest and a guest in the next ones.
Each shard gives its members a robust-pruned adjacency list (nearest members and some random ones,
thinned so that none is much nearer to a chosen neighbour than to the member); lists of the same
vector from overlapping shards are united. Every home vector then searches its shard: a greedy beam
search from the shard's medoids and its own node, then an expansion through everything within RANGE
of it. Links are verified by cosines in double precision, and vectors linked to one another through
others are compared outright, so counts agree from both sides. A task gives counts and, for each
vector, the smallest of its local component: links themselves are never written out, so dense groups cost no
pairs. Shards beyond PIECE members are worked on in pieces, queries of one against the graph of
another, so a group of any size stays within memory.

An audit compares a bounded sample of all vectors, and one of those with links, with all others by brute
force; the recall is the least of three means: over the links of each sample, and over its vectors. Below
AIM the search is done again with twice the overlap of search and graph, until vectors are guests
everywhere; if it stays below LEAST, the query fails rather than give too few links. The recall measured
is a column of the result.

Defined cases: vectors that are null or zero or hold null or non-finite components have no links and
stand alone; vectors of unequal length never link; rows that share a vec_id are vectors of their own;
a null vec_id has no links, a null component_id and is kept; equal vectors link with each other; no rows give
no rows (recall 1 without links); other columns are ignored.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, components, cut, skewed_join

SAMPLE, SHARD, MOST_SHARDS = 20_000, 1000, 2048
OVERLAP, MARGIN, BUILD_OVERLAP = 6, 0.35, 2
PIECE, DEGREE, NEAREST, RANDOM, ALPHA, BEAM, MEDOIDS = 8192, 12, 24, 8, 1.2, 16, 4
RANGE = 0.05  # how far below the threshold the expansion goes on
AUDIT, AIM, LEAST = 128, 0.97, 0.9
PAIRS = 1 << 16  # pairs held at a time
LOG = logging.getLogger(__name__)


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    x = x / np.maximum(np.abs(x).max(-1, keepdims=True), 1e-300)
    return x / np.sqrt((x * x).sum(-1, keepdims=True))


def centroids(sample: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Unit centroids of spherical k-means, from evenly spread seeds."""
    x = sample.astype(np.float32)
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        new = np.zeros_like(c)
        np.add.at(new, near, x)
        size = np.linalg.norm(new, axis=1)
        c[size > 0] = new[size > 0] / size[size > 0, None]
    return c


def robust_prune(x: np.ndarray, members: np.ndarray, candidates: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """For each member at most `degree` of its candidates (row numbers, nearest first), -1 filled up: a candidate goes when a chosen one is alpha times nearer to it."""
    out = np.full((len(members), degree), -1, np.int32)
    for lo in range(0, len(members), 512):
        m, cand = members[lo : lo + 512], candidates[lo : lo + 512]
        v = x[cand]
        dist = np.maximum(0, 2 - 2 * np.einsum("ncd,nd->nc", v, x[m]))
        alive = cand != m[:, None]
        rows = np.arange(len(m))
        for r in range(degree):
            d = np.where(alive, dist, np.inf)
            best = d.argmin(1)
            have = np.isfinite(d[rows, best])
            out[lo : lo + 512][have, r] = cand[rows, best][have]
            between = np.maximum(0, 2 - 2 * np.einsum("ncd,nd->nc", v, v[rows, best]))
            alive &= ~((alpha * alpha * between <= dist) & have[:, None])
            alive[rows, best] = False
            if not have.any():
                break
    return out


def shard_graph(x: np.ndarray, members: np.ndarray, seed: int) -> np.ndarray:
    """Robust-pruned lists of the members (rows of x), their candidates being all rows."""
    n = len(x)
    rng = np.random.RandomState(seed & 0x7FFFFFFF)
    near = min(NEAREST, n)
    out = []
    for lo in range(0, len(members), 1024):
        m = members[lo : lo + 1024]
        sims = x[m] @ x.T
        top = np.argpartition(-sims, near - 1, 1)[:, :near] if near < n else np.tile(np.arange(n), (len(m), 1))
        out.append(robust_prune(x, m, np.concatenate([top, rng.randint(0, n, (len(m), RANDOM))], 1)))
    return np.concatenate(out) if out else np.zeros((0, DEGREE), np.int32)


def medoids(x: np.ndarray, k: int = MEDOIDS) -> np.ndarray:
    """The member nearest to the mean, and in turn the members farthest from those taken."""
    got = [int((x @ x.mean(0)).argmax())]
    best = x @ x[got[0]]
    while len(got) < min(k, len(x)):
        got.append(int(best.argmin()))
        best = np.maximum(best, x @ x[got[-1]])
    return np.array(got)


def range_search(x: np.ndarray, lists: np.ndarray, queries: np.ndarray, entry: np.ndarray, own: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query numbers, rows of x) met by queries with cosines near the threshold or above, in single precision, block by block.

    lists: neighbours of each row, -1 filled up; entry: rows to start from; own: a query's own row or -1.
    """
    n, low = len(x), threshold - RANGE
    for lo in range(0, len(queries), 256):
        q = queries[lo : lo + 256]
        k = len(q)
        rows = np.arange(k)
        seen = np.zeros((k, n + 1), bool)
        seen[:, n] = True
        start = np.concatenate([np.tile(entry, (k, 1)), np.where(own[lo : lo + 256] >= 0, own[lo : lo + 256], entry[0])[:, None]], 1)
        beam = np.full((k, BEAM + start.shape[1]), n, np.int64)
        beam[:, : start.shape[1]] = start
        np.put_along_axis(seen, start, True, 1)
        sims = np.full(beam.shape, -2, np.float32)
        sims[:, : start.shape[1]] = np.einsum("kbd,kd->kb", x[start], q)
        opened = np.zeros(beam.shape, bool)
        opened[:, start.shape[1] :] = True
        hits_q, hits_x = [np.repeat(rows, start.shape[1])[(sims[:, : start.shape[1]] >= low).ravel()]], [start[sims[:, : start.shape[1]] >= low]]
        for _ in range(4 * BEAM):
            d = np.where(opened, -3, sims)
            at = d.argmax(1)
            go = np.flatnonzero(d[rows, at] > -2)
            if not len(go):
                break
            opened[go, at[go]] = True
            nbr = lists[beam[go, at[go]]]
            nbr = np.where(nbr < 0, n, nbr)
            fresh = ~np.take_along_axis(seen[go], nbr, 1)
            np.put_along_axis(seen, np.where(fresh, nbr, n), True, 1) if len(go) == k else seen.__setitem__((np.repeat(go, nbr.shape[1]), nbr.ravel()), True)
            s = np.einsum("kbd,kd->kb", x[np.where(fresh, nbr, 0)], q[go])
            s = np.where(fresh, s, -2).astype(np.float32)
            w = s >= low
            hits_q.append(np.repeat(go, nbr.shape[1])[w.ravel()])
            hits_x.append(nbr[w])
            all_b, all_s, all_o = np.concatenate([beam[go], nbr], 1), np.concatenate([sims[go], s], 1), np.concatenate([opened[go], s <= -2], 1)
            keep = np.argpartition(-all_s, beam.shape[1] - 1, 1)[:, : beam.shape[1]]
            beam[go], sims[go], opened[go] = (np.take_along_axis(a, keep, 1) for a in (all_b, all_s, all_o))
        fq, fx = np.concatenate(hits_q), np.concatenate(hits_x)
        yield fq + lo, fx
        open_q, open_x = [fq], [fx]
        while open_q:  # expansion: neighbours of all that is within range, some pairs at a time
            fq, fx = open_q.pop(), open_x.pop()
            step = max(1, PAIRS * 8 // lists.shape[1])
            if len(fq) > step:
                open_q += [fq[step:], fq[:step]]
                open_x += [fx[step:], fx[:step]]
                continue
            nq, nx = np.repeat(fq, lists.shape[1]), lists[fx].ravel()
            new = nx >= 0
            new[new] = ~seen[nq[new], nx[new]]
            key = np.unique(nq[new] * np.int64(n + 1) + nx[new])
            nq, nx = key // (n + 1), key % (n + 1)
            seen[nq, nx] = True
            near = np.zeros(len(nq), bool)
            for at in range(0, len(nq), PAIRS):
                near[at : at + PAIRS] = np.einsum("pd,pd->p", x[nx[at : at + PAIRS]], q[nq[at : at + PAIRS]]) >= low
            if near.any():
                yield nq[near] + lo, nx[near]
                open_q.append(nq[near])
                open_x.append(nx[near])


def merge(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Labels after the labels x and y have become one, pair by pair: each becomes the least that it is joined with."""
    while True:
        lo, hi = np.minimum(x, y), np.maximum(x, y)
        differ = lo != hi
        if not differ.any():
            return label
        parent = np.arange(len(label))
        np.minimum.at(parent, hi[differ], lo[differ])
        while (parent[parent] != parent).any():
            parent = parent[parent]
        label, x, y = parent[label], parent[lo[differ]], parent[hi[differ]]


def settle(xd: np.ndarray, qd: np.ndarray, own: np.ndarray, weight: np.ndarray, found: Iterator[tuple[np.ndarray, np.ndarray]], threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Verified link weights of the queries, and a local component number of queries (first) and rows, -1 without a link.

    Pairs whose ends are in one component already needn't be verified: members of a component are compared outright in the end.
    """
    nq, n = len(qd), len(xd)
    known = np.flatnonzero(own >= 0)
    label = np.arange(nq + n)
    label[nq + own[known]] = known
    linked = np.zeros(nq + n, bool)
    for qs, xs in found:
        for at in range(0, len(qs), PAIRS):
            a, b = qs[at : at + PAIRS], xs[at : at + PAIRS]
            apart = label[a] != label[nq + b]
            a, b = a[apart], b[apart]
            real = np.einsum("pd,pd->p", qd[a], xd[b]) >= threshold
            a, b = a[real], b[real]
            linked[a] = True
            linked[nq + b] = True
            label = merge(label, label[a], label[nq + b])
    at = np.flatnonzero(linked)
    links, comp = np.zeros(nq, np.int64), np.full(nq + n, -1, np.int64)
    if not len(at):
        return links, comp
    twin = np.concatenate([known, nq + own[known]])
    linked[twin] |= linked[np.concatenate([nq + own[known], known])]
    at = np.flatnonzero(linked)
    comp[at] = label[at]
    order = at[np.argsort(comp[at], kind="stable")]
    for group in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
        a, b = group[group < nq], group[group >= nq] - nq
        for lo in range(0, len(a), 1024):
            part = a[lo : lo + 1024]
            near = qd[part] @ xd[b].T >= threshold
            near &= own[part][:, None] != b[None, :]
            links[part] = near @ weight[b]
    return links, comp


def clean(embeddings: DataFrame) -> DataFrame:
    """vec_id and vector of the rows that can link."""
    e = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x")).where("vec_id is not null and x is not null")
    return e.where("not exists(x, c -> c is null or isnan(c) or abs(c) = double('infinity')) and exists(x, c -> c <> 0)")


def _place(centers, overlap: int, build: int, margin: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centers.value
        for b in batches:
            out = []
            for i, many, x in zip(b.column("id").to_pylist(), b.column("many").to_pylist(), b.column("x")):
                v = unit(x.values.to_numpy(zero_copy_only=False))
                w = np.zeros(c.shape[1])
                w[: len(v)] = v[: c.shape[1]]
                s = c @ w
                top = np.argsort(-s, kind="stable")[:overlap]
                top = top[s[top] >= s[top[0]] - margin]
                out += [(len(v), int(k), r == 0, r < build, i, many, v.tobytes()) for r, k in enumerate(top)]
            kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(zip(*out) if out else [[]] * 7, kinds)], ["dim", "shard", "home", "build", "id", "many", "v"])

    return work


def _matrix(col) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.frombuffer(b"".join(col.to_pylist()), np.float64).reshape(len(col), -1)


def _build(key: tuple, t: pa.Table) -> pa.Table:
    ids, x = t.column("id").to_numpy(), _matrix(t.column("v")).astype(np.float32)
    order = np.argsort(ids)
    ids, x = ids[order], x[order]
    lists = shard_graph(x, np.arange(len(ids)), int(key[1].as_py()) * 131 + int(key[2].as_py()))
    return pa.table({"id": ids, "near": pa.array([ids[r[r >= 0]] for r in lists], pa.list_(pa.int64()))})


def _search(threshold: float, build: int):
    def work(key: tuple, t: pa.Table) -> pa.Table:
        is_query = t.column("query").to_numpy()
        m, q = t.filter(pa.array(~is_query)), t.filter(pa.array(is_query))
        empty = pa.table({"id": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.int64())})
        if not m.num_rows or not q.num_rows:
            return empty
        ids, order = np.unique(m.column("id").to_numpy(), return_index=True)
        xd, weight = _matrix(m.column("v"))[order], m.column("many").to_numpy()[order]
        near = m.column("near").combine_chunks()
        lists = np.full((len(ids), 2 * build * DEGREE), -1, np.int64)
        flat, bounds = near.values.to_numpy(), near.offsets.to_numpy()
        for r, o in enumerate(order):
            own = flat[bounds[o] : bounds[o + 1]]
            at = np.minimum(np.searchsorted(ids, own), len(ids) - 1)
            at = at[ids[at] == own][: lists.shape[1]]
            lists[r, : len(at)] = at
        # back edges, as far as there is room, so that what others don't point to is reached too
        src, dst = np.repeat(np.arange(len(ids)), (lists >= 0).sum(1)), lists[lists >= 0]
        room = (lists >= 0).sum(1)
        for a, b in zip(src.tolist(), dst.tolist()):
            if room[b] < lists.shape[1] and a not in lists[b, : room[b]]:
                lists[b, room[b]] = a
                room[b] += 1
        qid, qo = np.unique(q.column("id").to_numpy(), return_index=True)
        qd = _matrix(q.column("v"))[qo]
        at = np.minimum(np.searchsorted(ids, qid), len(ids) - 1)
        own = np.where(ids[at] == qid, at, -1)
        x = xd.astype(np.float32)
        found = range_search(x, lists, qd.astype(np.float32), medoids(x), own, threshold)
        links, comp = settle(xd, qd, own, weight, found, threshold)
        names = np.concatenate([qid, ids])
        got = np.flatnonzero(comp >= 0)
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, comp[got], names[got])
        node, first = np.unique(names[got], return_index=True)
        root = least[comp[got]][first]
        count = dict(zip(qid.tolist(), links.tolist()))
        return pa.table({"id": node, "links": pa.array([count.get(i, 0) for i in node.tolist()], pa.int64()), "root": root})

    return work


def _audit(classes: DataFrame, counted: DataFrame, threshold: float) -> float:
    """The recall on bounded samples of vectors, by brute force against all."""
    spark = classes.sparkSession
    by_class = counted.groupBy("id").agg(F.sum("links").alias("links"))
    some = lambda df, of: df.orderBy(F.xxhash64("id", F.lit(of))).limit(AUDIT).select("id", "x").collect()  # noqa: E731  AUDIT vectors
    general, linked_ = some(classes, 3), some(classes.join(by_class.where("links > 0"), "id", "left_semi"), 4)
    shared = spark.sparkContext.broadcast(sorted({(r["id"], tuple(r["x"])) for r in general + linked_}))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys((i for i, _ in shared.value), 0)
        by_dim: dict[int, tuple] = {}
        for i, v in shared.value:
            ids, vs = by_dim.setdefault(len(v), ([], []))
            ids.append(i)
            vs.append(unit(np.array(v)))
        for b in batches:
            rows: dict[int, list] = {}
            for i, many, x in zip(b.column("id").to_pylist(), b.column("many").to_pylist(), b.column("x")):
                rows.setdefault(len(x), []).append((i, many, unit(x.values.to_numpy(zero_copy_only=False))))
            for dim, (ids, vs) in by_dim.items():
                if dim in rows:
                    other, many, x = zip(*rows[dim])
                    near = (np.array(vs) @ np.array(x).T >= threshold) & (np.array(ids)[:, None] != np.array(other)[None, :])
                    for i, k in zip(ids, near @ np.array(many)):
                        total[i] += int(k)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], ["id", "k"])

    true = classes.select("id", "many", "x").mapInArrow(work, "id long, k long").groupBy("id").agg(F.sum("k").alias("k"))
    got = {r["id"]: (r["k"], min(r["k"], r["links"])) for r in true.where("k > 0").join(by_class, "id", "left").select("id", "k", F.coalesce("links", F.lit(0)).alias("links")).collect()}
    means = []
    for sample in (general, linked_):
        own = [got[r["id"]] for r in sample if r["id"] in got]
        if own:
            means += [sum(g for _, g in own) / sum(k for k, _ in own), sum(g / k for k, g in own) / len(own)]
    return min(means, default=1.0)


def _numbered(groups: DataFrame) -> tuple[DataFrame, int]:
    """groups of equal vectors with a number for each, and the seed under which no two groups share one."""
    for seed in range(5, 25):
        out = groups.withColumn("class", F.xxhash64("h1", "h2", F.lit(seed)))
        if out.groupBy("class").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
            return out, seed
    raise RuntimeError("no seed tells all vectors apart")


def linked(embeddings: DataFrame, threshold: float = 0.9) -> DataFrame:
    """vec_id, n_links, component_id, kept and the audited recall of every row."""
    spark = embeddings.sparkSession
    bounded_batches(spark, 8)
    live = clean(embeddings).withColumns({"h1": F.xxhash64("x"), "h2": F.xxhash64(F.lit(11), "x")})
    groups, seed = _numbered(cut(live.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("many"))))
    total = groups.count()
    owned = skewed_join(live, groups, ["h1", "h2"], live.count())
    classes = cut(owned.where("vec_id = rep").dropDuplicates(["h1", "h2"]).select(F.col("class").alias("id"), "rep", "many", "x"))
    counted, recall = spark.createDataFrame([], "id long, links long, root long"), 1.0
    if total:
        share = min(1.0, SAMPLE / total)
        rows = classes.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) <= F.lit(int(share * (1 << 30)))).select("x", "id").limit(2 * SAMPLE).collect()  # SAMPLE vectors, or twice as many at the most
        rows.sort(key=lambda r: r["id"])
        dim = max((len(r["x"]) for r in rows), default=1)
        sample = np.zeros((max(1, len(rows)), dim))
        for i, r in enumerate(rows):
            sample[i, : len(r["x"])] = unit(np.array(r["x"]))
        centers = spark.sparkContext.broadcast(centroids(sample, max(1, min(-(-total // SHARD), MOST_SHARDS, len(sample) // 8))).astype(np.float64))
        overlap, build, margin = OVERLAP, BUILD_OVERLAP, MARGIN
        while True:
            counted = cut(_found(classes, centers, overlap, build, margin, threshold))
            recall = _audit(classes, counted, threshold)
            LOG.info("recall of the link search on samples: %.4f at overlap %d", recall, overlap)
            if recall >= AIM or overlap >= len(centers.value) and margin >= 2:
                break
            overlap, build, margin = overlap * 2, build * 2, margin * 2
        if recall < LEAST:
            raise RuntimeError(f"the link search found a share of {recall:.3f} of the links of its sample")
    by_class = counted.groupBy("id").agg(F.sum("links").alias("links"))
    reps = classes.select("id", "rep")
    edges = counted.select("id", "root").distinct().join(reps, "id").join(reps.select(F.col("id").alias("root"), F.col("rep").alias("other")), "root").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    joined = components(edges)
    known = classes.select("id", "rep", "many").join(by_class, "id", "left").join(joined, F.col("rep") == joined.node, "left")
    known = cut(known.select("id", "many", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    every = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("x"))
    can = F.expr("vec_id is not null and x is not null and not exists(x, c -> c is null or isnan(c) or abs(c) = double('infinity')) and exists(x, c -> c <> 0)")
    keyed = every.withColumn("id", F.when(can, F.xxhash64(F.xxhash64("x"), F.xxhash64(F.lit(11), "x"), F.lit(seed)))).select("vec_id", "id")
    alone = keyed.where("id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = skewed_join(keyed.where("id is not null"), known, ["id"], known.agg(F.sum("many")).first()[0] or 1)
    out = out.select("vec_id", F.col("n_links").cast("long"), "component_id").union(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))).withColumn("recall", F.lit(float(recall)))


def _found(classes: DataFrame, centers, overlap: int, build: int, margin: float, threshold: float) -> DataFrame:
    """(id, links, root): links of classes counted at home, and the smallest local id that a class is linked to."""
    placed = cut(classes.select("id", "many", "x").mapInArrow(_place(centers, overlap, build, margin), "dim int, shard int, home boolean, build boolean, id long, many long, v binary"))
    sizes = placed.groupBy("dim", "shard").agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"), F.ceil(F.greatest(F.count_if("home"), F.lit(1)) / PIECE).cast("int").alias("blocks"))
    placed = placed.join(F.broadcast(sizes), ["dim", "shard"])  # a row for each shard: MOST_SHARDS for each length of vectors
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("id", F.lit(1)), F.col("pieces")).cast("int"))
    lists = placed.where("build").groupBy("dim", "shard", "piece").applyInArrow(_build, "id long, near array<long>")
    united = lists.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    members = placed.join(united, "id").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).select("dim", "shard", "piece", "block", F.lit(False).alias("query"), "id", "many", "v", "near")
    asked = placed.where("home").withColumn("block", F.pmod(F.xxhash64("id", F.lit(2)), F.col("blocks")).cast("int")).withColumn("piece", F.explode(F.expr("sequence(0, pieces - 1)")))
    asked = asked.select("dim", "shard", "piece", "block", F.lit(True).alias("query"), "id", "many", "v", F.array().cast("array<long>").alias("near"))
    return members.union(asked).groupBy("dim", "shard", "piece", "block").applyInArrow(_search(threshold, build), "id long, links long, root long")
