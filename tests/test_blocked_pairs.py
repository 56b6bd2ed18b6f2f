"""Sums over pairs of tiles give the pairs of the join, and stay in the task that makes them."""

import numpy as np
from pyspark.sql import functions as F

from codepend.functions.betafn import beta_cdf, beta_ppf
from codepend.operators import dependence as dep


def _y(spark, cells, genes, held, seed=3):
    """Few genes in most cells, the others in few: the first tile is dense, the rest is sparse."""
    rng = np.random.default_rng(seed)
    rows = []
    for c in range(cells):
        mine = {*rng.choice(20, 12, replace=False).tolist(), *rng.choice(genes, held, replace=False).tolist()}
        rows += [(c, f"g{g}", float(v)) for g, v in zip(sorted(mine), rng.uniform(0.1, 8, len(mine)))]
    return spark.createDataFrame(rows, "cell_id long, gene string, y double").cache()


def test_same_pairs_as_the_join(spark):
    y = _y(spark, 300, 200, 12)
    want = {(r.g1, r.g2): r for r in dep.pairs(y, 300).collect()}
    for tile in (16, 40):  # more pairs of tiles than partitions, and salted ones
        got = {(r.g1, r.g2): r for r in dep.blocked_pairs(y, 300, tile).collect()}
        assert got.keys() == want.keys()
        for k, r in got.items():
            assert r.cooc == want[k].cooc and abs(r.ids - want[k].ids) < 1e-12 and abs(r.corr - want[k].corr) < 1e-12


def test_sums_of_many_genes_stay_in_the_task(spark):
    """With as many pairs of tiles as partitions, scores leave a task, not 38 sums for each pair of genes of two tiles."""
    got = dep.blocked_pairs(_y(spark, 200, 2500, 20), 200)
    assert got.agg(F.count(F.lit(1))).first()[0] > 20_000
    assert "sums" not in got._jdf.queryExecution().toString()


def test_quantiles_invert_the_distribution():
    rng = np.random.default_rng(5)
    p, a, b = rng.uniform(0.001, 0.999, 2000), 10 ** rng.uniform(-1, 3, 2000), 10 ** rng.uniform(-1, 3, 2000)
    x = beta_ppf(p, a, b)
    inside = (x > 1e-9) & (x < 1 - 1e-6)
    assert inside.sum() > 1500 and np.abs(beta_cdf(x, a, b) - p)[inside].max() < 1e-6
