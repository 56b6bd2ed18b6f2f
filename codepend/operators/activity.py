"""Activity of programs in cells: loadings, weighted projection, tail scores, scalings and thresholds.

loadings: (pid, gene, w); activity: (cell_id, pid, x) with a row for every cell and program.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .dependence import elbow
from .ranks import percentiles, ranked

BINS = 256


def eigen_loadings(pairs: DataFrame, members: DataFrame, kind: str = "ids_eig") -> DataFrame:
    """(pid, gene, w, explained): first eigenvectors of the programs' matrices of sign(corr) ids, or of corr.

    A vector with less than half of its weights positive is turned. explained is the share of the
    first eigenvalue in the sum of the first ten. Programs are small groups of genes.
    """
    if kind not in ("ids_eig", "corr_eig"):
        raise ValueError(f"unknown kind of loadings: {kind}")
    value = F.col("corr") if kind == "corr_eig" else F.signum("corr") * F.col("ids")
    a, b = members.select("pid", F.col("gene").alias("g1")), members.select("pid", F.col("gene").alias("g2"))
    inside = pairs.withColumn("v", value).join(a, "g1").join(b, ["pid", "g2"]).select("pid", "g1", "g2", "v")
    rows = inside.union(members.select("pid", "gene", "gene", F.lit(1.0)))

    def work(t: pd.DataFrame) -> pd.DataFrame:
        genes = sorted(set(t["g1"]) | set(t["g2"]))
        at = {g: i for i, g in enumerate(genes)}
        m = np.eye(len(genes))
        for x, y, v in zip(t["g1"], t["g2"], t["v"]):
            m[at[x], at[y]] = m[at[y], at[x]] = v
        values, vectors = np.linalg.eigh(m)
        w = vectors[:, -1]
        if (w > 0).sum() < len(w) / 2:
            w = -w
        top = values[::-1][:10]
        return pd.DataFrame({"pid": t["pid"].iloc[0], "gene": genes, "w": w, "explained": float(top[0] / top.sum()) if top.sum() else 0.0})

    return rows.groupBy("pid").applyInPandas(work, f"pid {members.schema['pid'].dataType.simpleString()}, gene string, w double, explained double")


def weighted(y: DataFrame, cells: DataFrame, loadings: DataFrame) -> DataFrame:
    """(cell_id, pid, x): sum of y w over the root of the number of genes that the matrix has; 0 in cells without any."""
    own = loadings.join(y.select("gene").distinct(), "gene", "left_semi").select("pid", "gene", "w")
    size = own.groupBy("pid").agg(F.count(F.lit(1)).alias("g"))
    s = y.join(F.broadcast(own), "gene").groupBy("cell_id", "pid").agg(F.sum(F.col("y") * F.col("w")).alias("s"))  # own: a row for each gene of a program
    every = cells.select("cell_id").join(F.broadcast(size))
    return every.join(s, ["cell_id", "pid"], "left").select("cell_id", "pid", (F.coalesce("s", F.lit(0.0)) / F.sqrt(F.col("g").cast("double"))).alias("x"))


def tail_scores(y: DataFrame, n: int) -> DataFrame:
    """y with t = -log10 of the share of all n cells at or above the value, 0 where that is over 0.05."""
    by_value = y.groupBy("gene", "y").agg(F.count(F.lit(1)).alias("k"))
    above = F.sum("k").over(W.partitionBy("gene").orderBy(F.desc("y")))
    score = by_value.withColumn("f", above / float(n)).select("gene", "y", F.when(F.col("f") <= 0.05, -F.log10("f")).otherwise(0.0).alias("t"))
    return y.join(score, ["gene", "y"])


def co_expression(y: DataFrame, cells: DataFrame, n: int, loadings: DataFrame, weighting: str = "positive") -> DataFrame:
    """(cell_id, pid, x): mean tail score over the program's genes of loading 0 or more, or over all."""
    if weighting not in ("positive", "allgenes"):
        raise ValueError(f"unknown weighting: {weighting}")
    own = (loadings.where("w >= 0") if weighting == "positive" else loadings).join(y.select("gene").distinct(), "gene", "left_semi").select("pid", "gene")
    size = own.groupBy("pid").agg(F.count(F.lit(1)).alias("g"))
    t = tail_scores(y, n).where("t > 0").join(F.broadcast(own), "gene").groupBy("cell_id", "pid").agg(F.sum("t").alias("s"))
    every = cells.select("cell_id").join(F.broadcast(size))
    return every.join(t, ["cell_id", "pid"], "left").select("cell_id", "pid", (F.coalesce("s", F.lit(0.0)) / F.col("g")).alias("x"))


def _one(c: Column) -> Column:
    return F.when(c == 0, 1.0).otherwise(c)


def _clip(c: Column, most: float) -> Column:
    return F.greatest(F.lit(-most), F.least(F.lit(most), c))


SCALINGS = ("iqr", "clipped_robust_zscore", "clipped_raw_activity", "clipped_zscore", "curvature_clip", "subpop_trim", "robust_zscore", "robust_zscore_trimmed", "robust_zscore_symlog", "robust_zscore_symsqrt", "min_max", "quantile")


def scaled_activity(a: DataFrame, how: str = "curvature_clip", sizes: DataFrame | None = None, n: int | None = None) -> DataFrame:
    """a with x scaled within each program over all cells; an unknown name leaves x as it is.

    sizes: (pid, genes), and n: the cells of each program at most, both for curvature_clip. A spread of 0 counts as 1. a is read
    several times: give it as a table where it is dear.
    """
    x, p = F.col("x"), W.partitionBy("pid")
    attach = lambda *cols: a.join(F.broadcast(a.groupBy("pid").agg(*cols)), "pid")  # noqa: E731  a row for each program
    done = lambda df, c: df.select("cell_id", "pid", c.alias("x"))
    quart = None
    if how in ("iqr", "clipped_robust_zscore", "robust_zscore", "robust_zscore_symlog", "robust_zscore_symsqrt"):
        quart = a.join(F.broadcast(percentiles(a, "x", (0.25, 0.5, 0.75), ["pid"])), "pid")
    spread = _one(F.col("q")[2] - F.col("q")[0])
    robust = (x - F.col("q")[1]) / (spread / 1.349)
    if how == "iqr":
        return done(quart, (x - F.col("q")[0]) / spread)
    if how == "clipped_robust_zscore":
        return done(quart, _clip(robust, 5))
    if how == "clipped_raw_activity":
        return done(a, _clip(x, 8))
    z = (x - F.col("mean")) / _one(F.col("std"))
    moments = (F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    if how == "clipped_zscore":
        return done(attach(*moments), _clip(z, 5))
    if how == "curvature_clip":
        zs = attach(*moments, F.count(F.lit(1)).alias("n")).withColumn("z", z)
        n = a.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] if n is None else n
        # the literal limit is pushed below the shuffle
        top = zs.withColumn("rank", F.row_number().over(p.orderBy(F.desc("z"), "cell_id"))).where(F.col("rank") <= math.ceil((n or 0) * 0.01)).where(F.col("rank") <= F.ceil(F.col("n") * 0.01))
        bend = elbow(top.select("pid", "rank", "z"), "pid", "z", 0.0)
        cap = top.join(F.broadcast(bend), "pid").where(F.col("rank") == F.col("elbow") + 1).select("pid", F.col("z").alias("cap"))
        capped = zs.join(F.broadcast(cap), "pid", "left").withColumn("z", F.coalesce(F.least("z", "cap"), "z"))
        if sizes is not None:
            capped = capped.join(F.broadcast(sizes.select("pid", "genes")), "pid").withColumn("z", F.col("z") * F.sqrt(F.col("genes").cast("double")))
        return done(capped, F.col("z"))
    low = F.min("x").alias("lo")
    if how == "subpop_trim":
        kth = a.withColumn("k", F.row_number().over(p.orderBy(F.desc("x")))).where("k = 100").select("pid", F.col("x").alias("kth"))
        j = attach(low, F.max("x").alias("hi"), F.count(F.lit(1)).alias("n")).join(F.broadcast(kth), "pid", "left")
        cap = F.when(F.col("n") > 100, F.col("kth")).otherwise(F.col("hi"))
        return done(j, (F.least(x, cap) - F.col("lo")) / _one(cap - F.col("lo")))
    if how == "robust_zscore":
        return done(quart, robust)
    if how == "robust_zscore_trimmed":
        mid = percentiles(a, "x", (0.5,), ["pid"]).select("pid", F.col("q")[0].alias("med"))
        mid = a.sparkSession.createDataFrame(mid.collect(), mid.schema)  # a row for each program
        d = a.join(F.broadcast(mid), "pid").withColumn("d", F.abs(x - F.col("med")))
        mad = percentiles(d, "d", (0.5,), ["pid"]).select("pid", F.col("q")[0].alias("mad"))
        return done(d.join(F.broadcast(mad), "pid"), _clip((x - F.col("med")) / _one(1.4826 * F.col("mad")), 8))
    if how == "robust_zscore_symlog":
        return done(quart, F.signum(robust) * F.log1p(F.abs(robust)))
    if how == "robust_zscore_symsqrt":
        return done(quart, F.signum(robust) * F.sqrt(F.abs(robust)))
    if how == "min_max":
        return done(attach(low, F.max("x").alias("hi")), (x - F.col("lo")) / _one(F.col("hi") - F.col("lo")))
    if how == "quantile":
        some = ranked(a.where("x <> 0"), "x", "cell_id", ["pid"]).select("cell_id", "pid", (F.col("rank") / (F.col("size_") + 1)).alias("r"))
        return a.join(some, ["cell_id", "pid"], "left").select("cell_id", "pid", F.coalesce("r", F.lit(0.0)).alias("x"))
    return a.select("cell_id", "pid", "x")


def otsu(a: DataFrame, nonzero_only: bool = False) -> DataFrame:
    """(pid, threshold): the centre of the bin that best splits each program's values in two; one value alone: that value."""
    v = a.where("x > 0") if nonzero_only else a
    span = v.groupBy("pid").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count(F.lit(1)).alias("n"))
    b = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
    binned = v.join(F.broadcast(span.where("hi > lo")), "pid").groupBy("pid", b.alias("bin")).agg(F.count(F.lit(1)).alias("k"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("n").alias("n"))
    binned = binned.withColumn("c", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / BINS).withColumn("w", F.col("k") / F.col("n"))
    p = W.partitionBy("pid")
    up = p.orderBy("bin")
    s = binned.withColumns({"cw": F.sum("w").over(up), "cm": F.sum(F.col("w") * F.col("c")).over(up), "mt": F.sum(F.col("w") * F.col("c")).over(p)})
    split = F.col("cw") * (1 - F.col("cw"))
    s = s.withColumn("sigma", F.when(split <= 1e-12, 0.0).otherwise(F.pow(F.col("mt") * F.col("cw") - F.col("cm"), 2) / F.when(split <= 1e-12, 1.0).otherwise(split)))
    best = s.groupBy("pid").agg(F.min(F.struct((-F.round("sigma", 12)).alias("s"), "bin", "c"))["c"].alias("threshold"))
    every = a.select("pid").distinct().join(best, "pid", "left").join(span.select("pid", "lo"), "pid", "left")
    return every.select("pid", F.coalesce("threshold", "lo", F.lit(0.0)).alias("threshold"))


def high_calls(a: DataFrame, thresholds: DataFrame) -> DataFrame:
    """a with `high`: above the program's threshold."""
    return a.join(F.broadcast(thresholds), "pid").select("cell_id", "pid", "x", (F.col("x") > F.col("threshold")).alias("high"))


def program_counts(calls: DataFrame, loadings: DataFrame) -> DataFrame:
    """(pid, n_high, G, G_total): high cells, genes of loading 0 or more, and all genes."""
    g = loadings.groupBy("pid").agg(F.count_if(F.col("w") >= 0).alias("G"), F.count(F.lit(1)).alias("G_total"))
    return calls.groupBy("pid").agg(F.count_if("high").alias("n_high")).join(g, "pid")


def with_calls(raw: DataFrame, scaled: DataFrame, nonzero_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """(cell_id, pid, raw, x, high), x being scaled, and (pid, threshold): Otsu's threshold on x."""
    t = otsu(scaled, nonzero_only)
    both = raw.select("cell_id", "pid", F.col("x").alias("raw")).join(scaled, ["cell_id", "pid"])
    return both.join(F.broadcast(t), "pid").select("cell_id", "pid", "raw", "x", (F.col("x") > F.col("threshold")).alias("high")), t


def program_stats(calls: DataFrame, thresholds: DataFrame, loadings: DataFrame) -> DataFrame:
    """(pid, threshold, n_high, G, G_total) of every program."""
    return thresholds.join(program_counts(calls, loadings), "pid")


def plotted(calls: DataFrame) -> DataFrame:
    """(cell_id, pid, x): scaled activity where there is one, else raw."""
    return calls.select("cell_id", "pid", F.coalesce("x", "raw").alias("x"))


def program_activity(y: DataFrame, cells: DataFrame, n: int, loadings: DataFrame, how: str = "curvature_clip", weighting: str = "positive") -> tuple[DataFrame, DataFrame]:
    """Scaled weighted activity and co-expression scores, each with high calls."""
    raw = weighted(y, cells, loadings)
    sizes = loadings.groupBy("pid").agg(F.count(F.lit(1)).alias("genes"))
    scaled = scaled_activity(raw, how, sizes, n)
    tails = co_expression(y, cells, n, loadings, weighting)
    return high_calls(scaled, otsu(scaled)), high_calls(tails, otsu(tails, True))
