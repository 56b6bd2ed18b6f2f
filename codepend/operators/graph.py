"""The significance graph as relations: cliques without subsets, densities between groups, peripheries, program metrics.

edges: (a, b) both ways, without loops; groups: (gid, genes) with sorted distinct arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def members(groups: DataFrame) -> DataFrame:
    return groups.select("gid", F.explode("genes").alias("gene"))


def distinct_groups(groups: DataFrame) -> DataFrame:
    """One group, the smallest gid, for each set of genes."""
    return groups.select("gid", F.array_sort(F.array_distinct("genes")).alias("genes")).groupBy("genes").agg(F.min("gid").alias("gid")).select("gid", "genes")


def shared_genes(groups: DataFrame) -> DataFrame:
    """(i, j, n) for i < j: how many genes two groups share, where any."""
    m = members(groups)
    return m.select(F.col("gid").alias("i"), "gene").join(m.select(F.col("gid").alias("j"), "gene"), "gene").where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))


def maximal_groups(groups: DataFrame) -> DataFrame:
    """distinct_groups without those that are a strict subset of another."""
    g = distinct_groups(groups)
    m = members(g)
    size = g.select("gid", F.size("genes").alias("size"))
    small, large = m.join(size, "gid").select(F.col("gid").alias("i"), "gene", F.col("size").alias("si")), m.join(size, "gid").select(F.col("gid").alias("j"), "gene", F.col("size").alias("sj"))
    inside = small.join(large, "gene").where("si < sj").groupBy("i", "j", "si").agg(F.count(F.lit(1)).alias("n")).where("n = si").select(F.col("i").alias("gid")).distinct()
    return g.join(inside, "gid", "left_anti")


def densities(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """(i, j, density) for i < j: edges between two groups over the product of their sizes; a shared gene has no edge to itself."""
    m = members(groups)
    left, right = m.select(F.col("gid").alias("i"), F.col("gene").alias("a")), m.select(F.col("gid").alias("j"), F.col("gene").alias("b"))
    n = left.join(edges, "a").join(right, "b").where("i < j").groupBy("i", "j").agg(F.count(F.lit(1)).alias("n"))
    size = groups.select("gid", F.size("genes").alias("s"))
    si, sj = size.select(F.col("gid").alias("i"), F.col("s").alias("si")), size.select(F.col("gid").alias("j"), F.col("s").alias("sj"))
    return n.join(si, "i").join(sj, "j").select("i", "j", (F.col("n") / (F.col("si") * F.col("sj"))).alias("density"))


def internal_density(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """(gid, density): edges within each group over its pairs; null below two genes."""
    m = members(groups)
    n = m.withColumnRenamed("gene", "a").join(edges, "a").join(m.withColumnRenamed("gene", "b"), ["gid", "b"]).where("a < b").groupBy("gid").agg(F.count(F.lit(1)).alias("n"))
    s = F.size("genes")
    return groups.join(n, "gid", "left").select("gid", F.when(s >= 2, F.coalesce("n", F.lit(0)) / (s * (s - 1) / 2)).alias("density"))


def peripheries(groups: DataFrame, edges: DataFrame, share: float = 0.5) -> DataFrame:
    """(gid, gene): genes outside a group that are adjacent to that share of it or more."""
    m = members(groups)
    near = m.withColumnRenamed("gene", "a").join(edges, "a").groupBy("gid", F.col("b").alias("gene")).agg(F.count(F.lit(1)).alias("n"))
    size = groups.select("gid", F.size("genes").alias("s"))
    return near.join(size, "gid").where(F.col("n") >= share * F.col("s")).select("gid", "gene").join(m, ["gid", "gene"], "left_anti")


def containments(groups: DataFrame, least: float = 0.7) -> DataFrame:
    """(i, j, ratio): pairs whose shared genes exceed that part of the smaller group."""
    size = groups.select("gid", F.size("genes").alias("s"))
    j = shared_genes(groups).join(size.select(F.col("gid").alias("i"), F.col("s").alias("si")), "i").join(size.select(F.col("gid").alias("j"), F.col("s").alias("sj")), "j")
    return j.select("i", "j", (F.col("n") / F.least("si", "sj")).alias("ratio")).where(F.col("ratio") > least)


def metrics(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: programs, their sizes, slots, unique genes and their share, overlap ratio, greatest Jaccard similarity with its pair, median internal density."""
    sizes = groups.agg(F.count(F.lit(1)).alias("program_count"), F.sum(F.size("genes")).alias("slots"))
    unique = members(groups).agg(F.countDistinct("gene").alias("unique_genes"))
    size = groups.select("gid", F.size("genes").alias("s"))
    j = shared_genes(groups).join(size.select(F.col("gid").alias("i"), F.col("s").alias("si")), "i").join(size.select(F.col("gid").alias("j"), F.col("s").alias("sj")), "j")
    part = (F.col("n") / (F.col("si") + F.col("sj") - F.col("n"))).alias("p")
    best = F.min(F.struct((-F.round(part, 9)).alias("p"), "i", "j"))  # the first pair, if tied
    most = j.agg(best.alias("b")).select(F.round(F.coalesce(-F.col("b.p"), F.lit(0.0)), 4).alias("max_jaccard"), F.col("b.i").alias("max_i"), F.col("b.j").alias("max_j"))
    dense = internal_density(groups, edges).agg(F.percentile("density", F.lit(0.5)).alias("median_density"))
    whole = edges.agg(F.countDistinct("a").alias("all_"))
    own = groups.agg(F.sort_array(F.collect_list(F.size("genes")), asc=False).alias("program_sizes"))  # a number for each program
    one = sizes.join(F.broadcast(unique)).join(F.broadcast(most)).join(F.broadcast(dense)).join(F.broadcast(whole)).join(F.broadcast(own))  # single rows
    share = F.round(F.try_divide(F.col("unique_genes"), F.col("all_")), 4)
    return one.withColumns({"overlap_ratio": F.round(F.col("slots") / F.col("unique_genes"), 3), "gene_coverage": share}).drop("all_")


def clique_graph(cliques: DataFrame, edges: DataFrame) -> tuple[list[list[str]], dict[tuple[int, int], float]]:
    """The maximal cliques, largest first, and the densities between them where above 0; only these reach the driver.

    cliques: a column genes. Subsets and densities are found by joins on genes.
    """
    numbered = maximal_groups(cliques.select(F.concat_ws("\x1f", F.array_sort("genes")).alias("gid"), "genes"))
    rows = sorted(((r["genes"], r["gid"]) for r in numbered.toLocalIterator()), key=lambda r: (-len(r[0]), r[0]))
    at = {gid: k for k, (_, gid) in enumerate(rows)}
    weights = {}
    for r in densities(numbered, edges).toLocalIterator():
        i, j = sorted((at[r["i"]], at[r["j"]]))
        weights[i, j] = r["density"]
    return [g for g, _ in rows], weights
