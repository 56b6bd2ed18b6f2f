"""Normalisation, outlier ceilings, and all-pairs dependence in one sparse self-join.

With psi_k = phi_k - phi_k(0), a feature of an absent count is zero, and covariances don't change; so
cov(i, j) = sum over cells that hold both of psi_i psi_j / N - m_i m_j, for N cells in all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import Matrix, stored

ORDERS = 6
TOP = 8.0


def normalised(counts: DataFrame) -> DataFrame:
    """counts with p, the share of the cell's total; 0 in a cell without one. Rows without a cell go."""
    lib = F.sum("x").over(W.partitionBy("cell_id"))
    return counts.where("cell_id is not null").withColumn("p", F.coalesce(F.try_divide(F.col("x"), lib), F.lit(0.0)))


def gene_moments(p: DataFrame, n: int | Column, value: str = "p") -> DataFrame:
    """Mean, population deviation and maximum of each gene over all n cells, absent ones as zeros."""
    n = n if isinstance(n, Column) else F.lit(float(n))
    s = p.groupBy("gene").agg(F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("q"), F.max(value).alias("top"), F.count(F.lit(1)).alias("nonzero"))
    return s.select("gene", (F.col("s") / n).alias("mean"), F.sqrt(F.greatest(F.col("q") / n - F.pow(F.col("s") / n, 2), F.lit(0.0))).alias("std"), "top", "nonzero")


def z_scores(p: DataFrame, moments: DataFrame) -> DataFrame:
    """p with z; a deviation of 0 counts as 1."""
    return p.join(F.broadcast(moments.select("gene", "mean", "std")), "gene").withColumn("z", (F.col("p") - F.col("mean")) / F.when(F.col("std") == 0, 1.0).otherwise(F.col("std")))


def top_k(p: DataFrame, k: int) -> DataFrame:
    """The k greatest rows of each gene, ranked. The rank limit is pushed below the shuffle by WindowGroupLimit."""
    return p.withColumn("rank", F.row_number().over(W.partitionBy("gene").orderBy(F.desc("p"), "cell_id"))).where(F.col("rank") <= k)


def elbow(ranked: DataFrame, key: str = "gene", value: str = "p", trim: float = 0.1) -> DataFrame:
    """(key, elbow, r): the 0-based rank of greatest curvature of the falling curve of each key's r values, for r of 3 or more.

    ranked has `rank` from 1. Both axes are scaled to [0, 1]; first and second derivatives are central
    differences, of second order at the ends too; the last floor(trim r) ranks aren't searched; the first maximum wins.
    """
    w = W.partitionBy(key).orderBy("rank")
    whole = W.partitionBy(key)
    e = ranked.withColumns({"r": F.count(F.lit(1)).over(whole), "lo_": F.min(value).over(whole), "hi_": F.max(value).over(whole)}).where("r >= 3")
    e = e.withColumns({"i": F.col("rank") - 1, "y0": (F.col(value) - F.col("lo_")) / (F.col("hi_") - F.col("lo_") + 1e-12), "h": F.lit(1.0) / (F.col("r") - 1 + 1e-12)})
    at = lambda c, k: F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w)
    for a, b in (("y0", "y1"), ("y1", "y2")):
        first = (-3 * F.col(a) + 4 * at(a, 1) - at(a, 2)) / (2 * F.col("h"))
        last = (3 * F.col(a) - 4 * at(a, -1) + at(a, -2)) / (2 * F.col("h"))
        e = e.withColumn(b, F.when(F.col("i") == 0, first).when(F.col("i") == F.col("r") - 1, last).otherwise((at(a, 1) - at(a, -1)) / (2 * F.col("h"))))
    e = e.withColumn("kappa", F.abs("y2") / F.pow(1 + F.col("y1") * F.col("y1"), 1.5)).where(F.col("i") < F.col("r") - F.floor(F.lit(trim) * F.col("r")))
    return e.groupBy(key).agg(F.min(F.struct((-F.col("kappa")).alias("k"), F.col("i")))["i"].alias("elbow"), F.max("r").alias("r"))


def ceilings(p: DataFrame, n: int, top_pct: float = 1.0, least: int = 100, more_than: int | None = None) -> DataFrame:
    """gene, mean, std, clip_idx, clip_val, clip_z, nnz_topk and the share of cells clipped.

    With k = int(top_pct / 100 * n), `least` at least: genes with more than `least` (or `more_than`) values among their top k are clipped at the
    elbow of these, others at their maximum. Too few cells for `least` altogether: nothing is clipped below 1.
    """
    m = gene_moments(p, n)
    k = int(top_pct / 100 * n)
    if k < least and n < least:
        return m.select("gene", "mean", "std", F.lit(None).cast("int").alias("clip_idx"), F.lit(1.0).alias("clip_val"), F.lit(0.0).alias("clip_z"), F.lit(0).cast("long").alias("nnz_topk"), F.lit(0.0).alias("clipped"))
    k = max(k, least)
    ranked = top_k(p, k)
    r = ranked.groupBy("gene").agg(F.count(F.lit(1)).alias("nnz_topk"))
    bends = elbow(ranked.join(r.where(F.col("nnz_topk") > (least if more_than is None else more_than)), "gene", "left_semi"))
    at = ranked.join(bends.select("gene", "elbow"), "gene").where(F.col("rank") == F.col("elbow") + 1).select("gene", "elbow", F.col("p").alias("val"))
    out = m.join(r, "gene", "left").join(at, "gene", "left")
    z = (F.col("val") - F.col("mean")) / F.when(F.col("std") == 0, 1.0).otherwise(F.col("std"))
    return out.select("gene", "mean", "std", F.col("elbow").cast("int").alias("clip_idx"), F.coalesce("val", "top", F.lit(0.0)).alias("clip_val"), F.coalesce(z, F.lit(0.0)).alias("clip_z"), F.coalesce("nnz_topk", F.lit(0)).alias("nnz_topk"), F.when(F.col("elbow").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.col("nnz_topk") - F.col("elbow") - 1) / float(n)).alias("clipped"))


def scaled(p: DataFrame, ceil: DataFrame) -> DataFrame:
    """p with y = min(p, ceiling) * 8 / ceiling, 0 where the ceiling is."""
    joined = p.join(F.broadcast(ceil.select("gene", "clip_val")), "gene")
    return joined.withColumn("y", F.coalesce(F.try_divide(F.least("p", "clip_val") * TOP, "clip_val"), F.lit(0.0))).drop("clip_val")


def hermite(y: Column, k: int, shifted: bool = True) -> Column:
    """phi_k(y) = y^k / sqrt(k!) exp(-y^2 / 2), less its value at 0 if shifted."""
    out = F.pow(y, F.lit(float(k))) * F.exp(-y * y / 2) / math.sqrt(math.factorial(k))
    return out - 1.0 if shifted and k == 0 else out


def features(y: DataFrame) -> DataFrame:
    return y.select("cell_id", "gene", "y", *(hermite(F.col("y"), k).alias(f"f{k}") for k in range(ORDERS)))


def feature_moments(f: DataFrame, n: int) -> DataFrame:
    """Means and inverse deviations over all n cells of the features f0..f5 and of y (fy); no deviation gives 0."""
    cols = [*(f"f{k}" for k in range(ORDERS)), "y"]
    s = f.groupBy("gene").agg(*(F.sum(c).alias(f"s_{c}") for c in cols), *(F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in cols))
    mean = {c: F.col(f"s_{c}") / n for c in cols}
    var = {c: F.col(f"q_{c}") / n - mean[c] * mean[c] for c in cols}
    return s.select("gene", *(mean[c].alias(f"m_{c}") for c in cols), *(F.when(var[c] < 1e-15, 0.0).otherwise(1 / F.sqrt(F.greatest(var[c], F.lit(1e-300)))).alias(f"i_{c}") for c in cols))


def pairs(y: DataFrame, n: int) -> DataFrame:
    """(g1, g2, cooc, ids, corr) for g1 < g2 that share a cell: one self-join on the cell gives all three.

    A cell's genes are gathered once, in one array by name; its pairs come from that array, so the
    rows are shuffled once by cell, and the 38 sums are combined before the shuffle by pair.
    """
    f = features(y)
    m = feature_moments(f, n)
    cols = [*(f"f{k}" for k in range(ORDERS)), "y"]
    row = F.struct("gene", *cols)
    cell = f.groupBy("cell_id").agg(F.array_sort(F.collect_list(row)).alias("g"))
    left = cell.select("g", F.posexplode("g").alias("i", "a"))
    both = left.select("a", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("b"))
    sums = [F.sum(F.col(f"a.f{i}") * F.col(f"b.f{j}")).alias(f"s{i}{j}") for i in range(ORDERS) for j in range(ORDERS)]
    s = both.groupBy(F.col("a.gene").alias("g1"), F.col("b.gene").alias("g2")).agg(F.count(F.lit(1)).alias("cooc"), *sums, F.sum(F.col("a.y") * F.col("b.y")).alias("sy"))
    return _scores(s, m, n)


#: Genes from which on tiles take less than a row for each pair in each cell.
WIDE_FROM = 2000
#: Genes of a tile, cells of a block, and pairs of nonzeros added up at a time. A task holds the sums of one pair of tiles, 38 TILE by TILE doubles, and the features of one block.
TILE, CELLS, AT_ONCE = 256, 512, 1 << 18
#: Pairs of nonzeros in a cell from which on a dense product of two tiles takes less time than adding up each pair.
DENSE_FROM = 320
BLOCK = "ti int, tj int, salt int, a binary, b binary"
GRAM = "ti int, tj int, sums binary"
SCORES = "k1 int, k2 int, cooc long, ids double, corr double"


def blocked_pairs(y: DataFrame, n: int, tile: int | None = None) -> DataFrame:
    """The same as pairs(), for wide matrices: sums of pairs of tiles of genes instead of a row for each pair in each cell.

    Genes are numbered, the most frequent first, and a cell's genes gathered. A block of cells is cut by tiles, and its nonzeros go to
    every pair of tiles that the block touches: each nonzero is shuffled once for each tile, not once for each other gene of its cell.
    A task adds up the products of features and the co-occurrences of one pair of tiles at a time: as dense products where
    its cells hold many pairs, which those of frequent genes do, else pair by pair. The scores are taken from the sums in the same task.
    Where there are fewer pairs of tiles than shuffle partitions, blocks are also dealt out by a salt, and the few
    sums by salt are added after another shuffle. Tiles are twice as wide from 10,000 genes on. y is read several times: give it as
    a table where it is dear.
    """
    m = feature_moments(features(y), n)
    # a row for each gene: its number, and its place by name
    axis = y.groupBy("gene").agg(F.count(F.lit(1)).alias("many"))
    axis = axis.select("gene", (F.row_number().over(W.orderBy(F.desc("many"), "gene")) - 1).cast("int").alias("k"), F.row_number().over(W.orderBy("gene")).alias("place"))
    axis = stored(axis)
    cols = [*(f"f{k}" for k in range(ORDERS)), "y"]
    by_gene = axis.join(F.broadcast(m), "gene").orderBy("k").select("place", *(f"m_{c}" for c in cols), *(f"i_{c}" for c in cols)).toPandas()  # a row for each gene
    tile = tile or (TILE if len(by_gene) < 10_000 else 2 * TILE)
    shared = y.sparkSession.sparkContext.broadcast(by_gene.to_numpy(float).T.copy())
    cell = y.join(F.broadcast(axis.select("gene", "k")), "gene").groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("k", "y"))).alias("g"))
    tiles = -(-len(by_gene) // tile)
    salts = max(1, int(y.sparkSession.conf.get("spark.sql.shuffle.partitions")) // max(1, tiles * (tiles + 1) // 2))
    width = ORDERS + 2  # the features, y, and whether the gene is there
    scale = [1 / math.sqrt(math.factorial(k)) for k in range(ORDERS)]

    def deal(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % salts
        for b in batches:
            col = b.column("g")
            for at in range(0, len(col), CELLS):
                part = col.slice(at, CELLS)
                flat = part.flatten()
                row = np.repeat(np.arange(len(part), dtype=np.uint16), np.diff(part.offsets.to_numpy()))
                k, v = flat.field("k").to_numpy(), flat.field("y").to_numpy()
                order = np.argsort(k // tile, kind="stable")
                ts, begin = np.unique((k // tile)[order], return_index=True)
                own = [order[i:j] for i, j in zip(begin, [*begin[1:], len(order)])]
                packed = [row[o].tobytes() + (k[o] % tile).astype(np.uint16).tobytes() + v[o].tobytes() for o in own]
                for i, t in enumerate(ts.tolist()):
                    rest = ts[i:].astype(np.int32)
                    cols = [pa.array(np.full(len(rest), t, np.int32)), pa.array(rest), pa.array(np.full(len(rest), salt, np.int32)), pa.array([packed[i]] * len(rest), pa.binary()), pa.array(packed[i:], pa.binary())]
                    yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in BLOCK.split(", ")])

    def scored(key, s):
        import numpy as np
        import pyarrow as pa

        i, j = np.nonzero(s[-1] > 0)
        k1, k2 = key[0] * tile + i, key[1] * tile + j
        up = k1 < k2
        i, j, k1, k2 = i[up], j[up], k1[up], k2[up]
        place, mean, inverse = shared.value[0], shared.value[1 : 2 + ORDERS], shared.value[2 + ORDERS :]
        corr = lambda x, a, b: (x[i, j] / n - mean[a][k1] * mean[b][k2]) * inverse[a][k1] * inverse[b][k2]
        ids = np.zeros(len(i))
        for a in range(ORDERS):
            for b in range(ORDERS):
                np.maximum(ids, np.abs(corr(s[a * ORDERS + b], a, b)), out=ids)
        turned = place[k1] > place[k2]
        cols = [pa.array(np.where(turned, k2, k1).astype(np.int32)), pa.array(np.where(turned, k1, k2).astype(np.int32)), pa.array(np.rint(s[-1][i, j]).astype(np.int64)), pa.array(ids), pa.array(corr(s[-2], ORDERS, ORDERS))]
        for at in range(0, len(i), 65536):
            yield pa.RecordBatch.from_arrays([c.slice(at, 65536) for c in cols], [c.split()[0] for c in SCORES.split(", ")])

    def multiply(batches):
        import numpy as np
        import pyarrow as pa

        key, s = None, None

        def entries(raw):
            many = len(raw) // 12
            return np.frombuffer(raw, np.uint16, many), np.frombuffer(raw, np.uint16, many, 2 * many), np.frombuffer(raw, np.float64, many, 4 * many)

        def values(x):
            decay = np.exp(-x * x / 2)
            return [*(x**o * scale[o] * decay - (o == 0) for o in range(ORDERS)), x, np.ones(len(x))]

        def dense(r, c, x, rows):
            out = np.zeros((rows, width, tile))
            for o, v in enumerate(values(x)):
                out[r, o, c] = v
            return out

        def by_pair(ca, xa, first, many, cb, xb):
            """Add up the pairs of each left entry with `many` right ones from `first` on."""
            va, vb = values(xa), values(xb)
            ends = np.cumsum(many)
            at = 0
            while at < len(many):
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
                k = many[at:to]
                left = np.repeat(np.arange(at, to), k)
                right = np.arange(len(left)) + np.repeat(first[at:to] - (np.cumsum(k) - k), k)
                flat = ca[left].astype(np.int64) * tile + cb[right]
                ls, rs = [v[left] for v in va[:-1]], [v[right] for v in vb[:-1]]
                add = lambda q, w: np.add(s[q].reshape(-1), np.bincount(flat, w, tile * tile), out=s[q].reshape(-1))  # noqa: E731, B023
                for a in range(ORDERS):
                    for b in range(ORDERS):
                        add(a * ORDERS + b, ls[a] * rs[b])
                add(-2, ls[ORDERS] * rs[ORDERS])
                add(-1, None)
                at = to

        def held(parts):
            """Entries of several blocks as one, by cell."""
            r, c, x = (np.concatenate([p[q] for p in parts]) for q in range(3))
            order = np.argsort(r, kind="stable")
            return r[order], c[order], x[order]

        def flush(a, b):
            (ra, ca, xa), (rb, cb, xb) = held(a), held(b)
            first = np.searchsorted(rb, ra, "left")
            many = np.searchsorted(rb, ra, "right") - first
            by_pair(ca, xa, first, many, cb, xb)

        def closed(a, b):
            if a:
                flush(a, b)
            if salts == 1:
                yield from scored(key, s)
            else:
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([s.tobytes()], pa.binary())], [c.split()[0] for c in GRAM.split(", ")])

        wait_a, wait_b, pending, blocks = [], [], 0, 0
        for b in batches:
            for ti, tj, salt, raw_a, raw_b in zip(*(b.column(c).to_pylist() for c in ("ti", "tj", "salt")), b.column("a"), b.column("b")):
                if key != (ti, tj, salt):
                    if key is not None:
                        yield from closed(wait_a, wait_b)
                    key, s = (ti, tj, salt), np.zeros((ORDERS * ORDERS + 2, tile, tile))
                    wait_a, wait_b, pending, blocks = [], [], 0, 0
                ea, eb = entries(raw_a.as_buffer()), entries(raw_b.as_buffer())
                na, nb = np.bincount(ea[0], minlength=CELLS), np.bincount(eb[0], minlength=CELLS)
                pairs_, cells = int((na * nb).sum()), np.flatnonzero(na * nb)
                if not pairs_:
                    continue
                if pairs_ >= DENSE_FROM * (tile / TILE) ** 2 * len(cells):
                    new = np.full(CELLS, -1)
                    new[cells] = np.arange(len(cells))
                    (ra, ca, xa), (rb, cb, xb) = ea, eb
                    ia, ib = new[ra] >= 0, new[rb] >= 0
                    left = dense(new[ra[ia]], ca[ia], xa[ia], len(cells))
                    right = left if ti == tj else dense(new[rb[ib]], cb[ib], xb[ib], len(cells))
                    s[:-2] += (left[:, :ORDERS].reshape(len(cells), -1).T @ right[:, :ORDERS].reshape(len(cells), -1)).reshape(ORDERS, tile, ORDERS, tile).transpose(0, 2, 1, 3).reshape(-1, tile, tile)
                    for o in (0, 1):
                        s[-1 - o] += left[:, ORDERS + 1 - o].T @ right[:, ORDERS + 1 - o]
                    continue
                wait_a.append((ea[0].astype(np.int64) + blocks * CELLS, *ea[1:]))
                wait_b.append((eb[0].astype(np.int64) + blocks * CELLS, *eb[1:]))
                blocks, pending = blocks + 1, pending + pairs_
                if pending >= 2 * AT_ONCE:
                    flush(wait_a, wait_b)
                    wait_a, wait_b, pending, blocks = [], [], 0, 0
        if key is not None:
            yield from closed(wait_a, wait_b)

    def add(batches):
        import numpy as np

        key, s = None, None
        for b in batches:
            for ti, tj, raw in zip(b.column("ti").to_pylist(), b.column("tj").to_pylist(), b.column("sums")):
                new = np.frombuffer(raw.as_buffer(), np.float64).reshape(-1, tile, tile)
                if key != (ti, tj):
                    if key is not None:
                        yield from scored(key, s)
                    key, s = (ti, tj), np.zeros(new.shape)
                s += new
        if key is not None:
            yield from scored(key, s)

    by = ["ti", "tj", "salt"]
    dealt = cell.select("g").mapInArrow(deal, BLOCK).repartition(*by).sortWithinPartitions(*by)
    if salts == 1:
        scores = dealt.mapInArrow(multiply, SCORES)
    else:
        scores = dealt.mapInArrow(multiply, GRAM).repartition("ti", "tj").sortWithinPartitions("ti", "tj").mapInArrow(add, SCORES)
    a, b = (F.broadcast(axis.select(F.col("gene").alias(g), F.col("k").alias(k))) for g, k in (("g1", "k1"), ("g2", "k2")))
    return scores.join(a, "k1").join(b, "k2").select("g1", "g2", "cooc", "ids", "corr")


def _scores(s: DataFrame, m: DataFrame, n: int) -> DataFrame:
    a = m.select(*(F.col(c).alias(f"a_{c}") for c in m.columns))
    b = m.select(*(F.col(c).alias(f"b_{c}") for c in m.columns))
    j = s.join(F.broadcast(a), s.g1 == F.col("a_gene")).join(F.broadcast(b), s.g2 == F.col("b_gene"))  # a row for each gene
    corr = lambda s_, x, y: (s_ / n - F.col(f"a_m_{x}") * F.col(f"b_m_{y}")) * F.col(f"a_i_{x}") * F.col(f"b_i_{y}")
    every = [F.abs(corr(F.col(f"s{i}{k}"), f"f{i}", f"f{k}")) for i in range(ORDERS) for k in range(ORDERS)]
    return j.select("g1", "g2", "cooc", F.greatest(*every).alias("ids"), corr(F.col("sy"), "y", "y").alias("corr"))


def cooccurrence(counts: DataFrame) -> DataFrame:
    """(g1, g2, cooc): in how many cells both genes are."""
    cell = counts.groupBy("cell_id").agg(F.array_sort(F.collect_set("gene")).alias("g"))
    left = cell.select("g", F.posexplode("g").alias("i", "g1"))
    return left.select("g1", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("g2")).groupBy("g1", "g2").agg(F.count(F.lit(1)).alias("cooc"))


def pearson(y: DataFrame, n: int) -> DataFrame:
    """(g1, g2, corr) alone, for pairs that share a cell."""
    v = lambda: F.greatest(F.col("q") / n - F.col("m") * F.col("m"), F.lit(0.0))
    m = y.groupBy("gene").agg((F.sum("y") / n).alias("m"), F.sum(F.col("y") * F.col("y")).alias("q")).select("gene", "m", F.when(v() < 1e-15, 0.0).otherwise(1 / F.sqrt(F.greatest(v(), F.lit(1e-300)))).alias("i"))
    cell = y.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("gene", "y"))).alias("g"))
    left = cell.select("g", F.posexplode("g").alias("k", "a"))
    s = left.select("a", F.explode(F.slice("g", F.col("k") + 2, F.size("g"))).alias("b")).groupBy(F.col("a.gene").alias("g1"), F.col("b.gene").alias("g2")).agg(F.sum(F.col("a.y") * F.col("b.y")).alias("s"))
    a, b = (F.broadcast(m.select(F.col("gene").alias(g), F.col("m").alias(f"m_{g}"), F.col("i").alias(f"i_{g}"))) for g in ("g1", "g2"))  # a row for each gene
    return s.join(a, "g1").join(b, "g2").select("g1", "g2", ((F.col("s") / n - F.col("m_g1") * F.col("m_g2")) * F.col("i_g1") * F.col("i_g2")).alias("corr"))


def truncated(ids: Column) -> Column:
    """Four decimals, cut off."""
    return F.floor(ids * 1e4) / 1e4


def weights(cells: DataFrame) -> DataFrame:
    """cells with N / n_c of their type: all types weigh the same together."""
    per = cells.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n_"))
    total = cells.agg(F.count(F.lit(1)).alias("all_"))
    w = per.join(F.broadcast(total)).select(F.col("cell_type").alias("t_"), (F.col("all_") / F.col("n_")).alias("weight"))  # a row for each type
    return cells.join(F.broadcast(w), cells.cell_type.eqNullSafe(F.col("t_"))).drop("t_")


def weighted_moments(values: DataFrame, cells: DataFrame, value: str = "p") -> DataFrame:
    """(gene, mean, var) over all cells by their weights (cell_id, weight), absent values as zeros."""
    total = cells.agg(F.sum("weight").alias("w_"))
    v = F.col(value)
    s = values.join(cells.select("cell_id", "weight"), "cell_id").groupBy("gene").agg(F.sum(F.col("weight") * v).alias("s_"), F.sum(F.col("weight") * v * v).alias("q_"))
    mean = F.col("s_") / F.col("w_")
    return s.join(F.broadcast(total)).select("gene", mean.alias("mean"), F.greatest(F.col("q_") / F.col("w_") - mean * mean, F.lit(0.0)).alias("var"))


def weighted_covariances(values: DataFrame, cells: DataFrame, value: str = "p") -> DataFrame:
    """(g1, g2, cov) over all cells by their weights, for pairs that share a cell; sums are combined before the shuffle by pair."""
    m = weighted_moments(values, cells, value).select("gene", "mean")
    total = cells.agg(F.sum("weight").alias("w_"))
    cell = values.groupBy("cell_id").agg(F.array_sort(F.collect_list(F.struct("gene", F.col(value).alias("v")))).alias("g")).join(cells.select("cell_id", "weight"), "cell_id")
    left = cell.select("g", "weight", F.posexplode("g").alias("i", "a"))
    both = left.select("a", "weight", F.explode(F.slice("g", F.col("i") + 2, F.size("g"))).alias("b"))
    s = both.groupBy(F.col("a.gene").alias("g1"), F.col("b.gene").alias("g2")).agg(F.sum(F.col("weight") * F.col("a.v") * F.col("b.v")).alias("s_"))
    a, b = (F.broadcast(m.select(F.col("gene").alias(g), F.col("mean").alias(f"m_{g}"))) for g in ("g1", "g2"))  # a row for each gene
    return s.join(a, "g1").join(b, "g2").join(F.broadcast(total)).select("g1", "g2", (F.col("s_") / F.col("w_") - F.col("m_g1") * F.col("m_g2")).alias("cov"))
