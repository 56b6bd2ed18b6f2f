"""Which pairs are significant: scaled beta null distributions, p-values, false-discovery control, edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.betafn import beta_cdf, beta_ppf, ks_statistic, ks_tail, log_beta
from ..sources.tables import stored

#: Shares in percent cut off below and above before a fit, in the order tried.
TRIMS = sorted(((lo, hi) for lo in (0, 0.5, 1, 1.5, 2) for hi in (0, 0.5, 1, 1.5, 2)), key=lambda t: (t[0] + t[1], t[0]))
FIT = "gene string, alpha double, beta double, scale double, mse_cdf double, num_nonzero int, ks_pval double"
#: Of a trim's values one in SEEN is looked at first.
SEEN = 64
TINY = float(np.finfo(np.float32).tiny)


def mirrored(pairs: DataFrame) -> DataFrame:
    """(gene, neighbor, ...) in both directions."""
    rest = [c for c in pairs.columns if c not in ("g1", "g2")]
    return pairs.select(F.col("g1").alias("gene"), F.col("g2").alias("neighbor"), *rest).union(pairs.select("g2", "g1", *rest))


def with_evidence(pairs: DataFrame, cooc: int = 100) -> DataFrame:
    """Pairs seen together in more than cooc cells."""
    return pairs.where((F.col("cooc") > cooc) & (F.col("g1") != F.col("g2")))


def observed(both: DataFrame, least: int = 100) -> DataFrame:
    """Rows whose gene and neighbor have `least` neighbours or more."""
    n = both.groupBy("gene").agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") >= least).select("gene")
    return both.join(n, "gene", "left_semi").join(n.select(F.col("gene").alias("neighbor")), "neighbor", "left_semi").select(*both.columns)


def fit_many(values: list[np.ndarray]) -> list[tuple[float, float, float, float, float]]:
    """(alpha, beta, scale, mse of the distribution function, KS p) of sorted positive values, for each list.

    For each trim, shape parameters come from the moments of the trimmed values over the scale, and
    the scale is the fixed point at which the greatest trimmed value stands at its rank's quantile.
    The first trim with a KS p above 0.01 wins, else the best.
    """
    jobs = []
    for g, v in enumerate(values):
        m = len(v)
        for lo, hi in TRIMS:
            a, b = int(np.ceil(m * lo / 100)), m - int(np.ceil(m * hi / 100))
            if b - a < 2:
                a, b = 0, m
            w = v[a:b]
            jobs.append((g, a, b, w.mean(), w.var(), w[-1], b / (m + 1)))
    g, a, b, mean, var, top, rank = (np.array(c) for c in zip(*jobs))
    scale = np.clip(1.5 * top, 1e-12, None)
    alpha, beta, live = np.ones(len(g)), np.ones(len(g)), np.arange(len(g))

    def shape(at: np.ndarray) -> None:
        mu, v = np.minimum(mean[at] / scale[at], 1 - 1e-9), np.maximum(var[at] / scale[at] ** 2, 1e-18)
        k = mu * (1 - mu) / v - 1
        alpha[at], beta[at] = np.maximum(mu * k, 1e-6), np.maximum((1 - mu) * k, 1e-6)

    for _ in range(30):
        shape(live)
        q = beta_ppf(rank[live], alpha[live], beta[live])
        new = np.clip(top[live] / np.maximum(q, 1e-12), np.minimum(1.001 * top[live], 1), 1)
        moved = np.abs(new - scale[live]) > 1e-6 * scale[live]
        scale[live] = new
        live = live[moved]
        if not len(live):
            break
    shape(np.arange(len(g)))
    out = []
    for k in range(len(values)):
        best, no_better = None, None
        for j in range(k * len(TRIMS), (k + 1) * len(TRIMS)):
            if best is not None:
                if no_better is None:
                    no_better = _bounds(values[k], *(c[k * len(TRIMS) : (k + 1) * len(TRIMS)] for c in (a, b, scale, alpha, beta)))
                if no_better[j - k * len(TRIMS)] <= min(best[4], 0.01):
                    continue  # neither better than the best nor good enough to end
            x = values[k][a[j] : b[j]] / scale[j]
            cdf = beta_cdf(x, alpha[j], beta[j], np.array(_norm(alpha[j], beta[j])))
            p = ks_tail(ks_statistic(cdf), len(x))
            if best is None or p > best[4]:
                best = (float(alpha[j]), float(beta[j]), float(scale[j]), float(((cdf - np.arange(1, len(x) + 1) / len(x)) ** 2).mean()), p)
            if p > 0.01:
                break
        out.append(best)
    return out


def _bounds(v: np.ndarray, a: np.ndarray, b: np.ndarray, scale: np.ndarray, alpha: np.ndarray, beta: np.ndarray) -> list[float]:
    """The KS p of each trim at most: from the distances at every SEEN-th value, which the distance at all of them isn't below."""
    at = [np.arange(i, j, SEEN) for i, j in zip(a, b)]
    many = [len(x) for x in at]
    wide = lambda c: np.repeat(c, many)
    cdf = beta_cdf(v[np.concatenate(at)] / wide(scale), wide(alpha), wide(beta), wide(np.array([_norm(x, y) for x, y in zip(alpha, beta)])))
    place, n = np.concatenate(at) - wide(a), wide(b - a)
    far = np.maximum((place + 1) / n - cdf, cdf - place / n)
    return [ks_tail(d, m) for d, m in zip(np.maximum.reduceat(far, np.cumsum(many) - many), b - a)]


def _norm(a: float, b: float) -> float:
    import math

    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def fits(both: DataFrame, value: str = "ids") -> DataFrame:
    """A scaled beta distribution for each gene's values; a gene has at most as many as there are genes."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for i in range(0, len(b), 256):
                part = b.iloc[i : i + 256]
                if len(part):
                    got = fit_many([np.asarray(v, float) for v in part["values"]])
                    yield pd.DataFrame([(gene, *f[:4], len(v), f[4]) for gene, v, f in zip(part["gene"], part["values"], got)], columns=[c.split()[0] for c in FIT.split(", ")])

    lists = both.where(F.col(value) > 0).groupBy("gene").agg(F.sort_array(F.collect_list(value)).alias("values")).where(F.size("values") >= 2)
    return lists.mapInPandas(work, FIT)


def quantile_vectors(both: DataFrame, value: str = "ids", below: float = 0.0, above: float = 0.0, k: int = 200) -> DataFrame:
    """(gene, q): k evenly spaced, interpolated quantiles of each gene's positive values, without that percentage of them below and above (two stay)."""
    v = both.where(F.col(value) > 0).groupBy("gene").agg(F.sort_array(F.collect_list(value)).alias("v"))  # a gene has at most as many as there are genes
    m = F.size("v")
    low, high = F.ceil(m * below / 100).cast("int"), F.ceil(m * above / 100).cast("int")
    few = m - low - high < 2
    v = v.withColumn("v", F.when(few, F.col("v")).otherwise(F.slice("v", low + 1, m - low - high)))
    at = lambda i: i / float(k - 1) * (F.size("v") - 1)
    pick = lambda i: F.element_at("v", i.cast("int") + 1)
    q = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: pick(F.floor(at(i))) + (at(i) - F.floor(at(i))) * (pick(F.ceil(at(i))) - pick(F.floor(at(i)))))
    return v.select("gene", q.alias("q"))


def p_values(both: DataFrame, fitted: DataFrame, value: str = "ids") -> DataFrame:
    """(gene, neighbor, p): upper tails of all values, under their gene's fit."""

    @F.pandas_udf("double")
    def tail(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        a, b = a.to_numpy(), b.to_numpy()
        begin = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
        norm = np.repeat(log_beta(a[begin], b[begin]), np.diff(np.append(begin, len(a))))  # once for each run of a gene's rows
        return pd.Series(np.clip(1 - beta_cdf(x.to_numpy(), a, b, norm), TINY, 1.0))

    j = both.join(fitted.select("gene", "alpha", "beta", "scale"), "gene")
    return j.select("gene", "neighbor", tail(F.least(F.col(value) / F.col("scale"), F.lit(1 - 1e-12)), "alpha", "beta").alias("p"))


def false_discovery(p: DataFrame, alpha: float = 0.05) -> DataFrame:
    """p with `significant`: Benjamini and Hochberg's rule within each gene; missing p-values are out."""
    known = p.where("p is not null and not isnan(p)")
    g = W.partitionBy("gene")
    r = known.withColumns({"rk": F.row_number().over(g.orderBy("p", "neighbor")), "m": F.count(F.lit(1)).over(g)})
    r = r.withColumn("k", F.max(F.when(F.col("p") <= alpha * F.col("rk") / F.col("m"), F.col("rk"))).over(g))
    return r.withColumn("significant", F.coalesce(F.col("rk") <= F.col("k"), F.lit(False))).drop("rk", "m", "k")


def hit_lists(judged: DataFrame) -> DataFrame:
    """(gene, num_hits, significant_hit_genes), genes without hits included."""
    return judged.groupBy("gene").agg(F.count_if("significant").cast("int").alias("num_hits"), F.sort_array(F.collect_list(F.when(F.col("significant"), F.col("neighbor")))).alias("significant_hit_genes"))


def acceptable(fitted: DataFrame, mse: float = 0.01, most: int = 1000) -> DataFrame:
    """fitted with `kept`: a good fit, more than one hit, not too many."""
    return fitted.withColumn("kept", (F.col("mse_cdf") < mse) & (F.col("num_hits") > 1) & (F.col("num_hits") <= most))


def directed_edges(fitted: DataFrame, mse: float = 0.01, most: int = 1000) -> DataFrame:
    """(src, dst) from the hit lists of acceptable genes."""
    return acceptable(fitted, mse, most).where("kept").select(F.col("gene").alias("src"), F.explode("significant_hit_genes").alias("dst"))


def undirected(directed: DataFrame) -> DataFrame:
    """(a, b) where either direction is there, both ways, without loops."""
    e = directed.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return e.union(e.select("b", "a")).where("a <> b").distinct()


def without_keywords(genes: DataFrame, words: tuple[str, ...] = ("RPL", "RPS", "MT-")) -> DataFrame:
    """Genes whose name holds none of the words, in either case."""
    return genes.where(~F.upper("gene").rlike("|".join(words)))


def significance(pairs: DataFrame, cooc: int = 100, least: int = 100, alpha: float = 0.05) -> DataFrame:
    """Fit records with hit lists, for all genes with enough evidence."""
    both = stored(observed(mirrored(with_evidence(pairs, cooc)), least))  # read by the fit and by the p-values
    fitted = stored(fits(both))
    return fitted.join(hit_lists(false_discovery(p_values(both, fitted), alpha)), "gene")
