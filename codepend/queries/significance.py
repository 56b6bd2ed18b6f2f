"""Significance of pairs (B21-B23, F03-F07, G11-G13, P01-P05, S09, S10, W06, W08-W10). p-values of SQL twins are 1 - ids."""

from pyspark.sql import functions as F

from ..operators import dependence as dep
from ..operators import significance as sig
from ..registry import query
from ..sources.tables import document_tokens, stored
from .common import PAIRS, customer_p, customer_pairs, rounded, sql

#: The documents that a token stands in at least, as many as a pair's evidence; fixed, whatever the size of the table.
EVIDENCE = 100
BOTH = PAIRS + ", both_ as (select g1 as gene, g2 as neighbor, round(ids, 6) as ids, cooc from pairs union all select g2, g1, round(ids, 6), cooc from pairs)"
PV = BOTH + ", pv as (select gene, neighbor, (1 - ids) ** 40 as p from both_)"
BH = PV + """, rk as (select *, row_number() over (partition by gene order by p, neighbor) as rk, count(*) over (partition by gene) as m from pv),
bh as (select *, coalesce(rk <= max(case when p <= 5e-2 * rk / m then rk end) over (partition by gene), false) as significant from rk)"""
HITS = BH + ", h as (select gene, count(*) filter (significant)::integer as num_hits, list_sort(list(neighbor) filter (significant)) as hits from bh group by gene)"
EDGES = HITS + ", d as (select gene as src, unnest(hits) as dst from h where num_hits between 2 and 20), u as (select src as a, dst as b from d where src <> dst union select dst, src from d where src <> dst)"


def _both(spark, d):
    return sig.mirrored(customer_pairs(spark, d).withColumn("ids", F.round("ids", 6)))


def _judged(spark, d):
    return sig.false_discovery(_both(spark, d).select("gene", "neighbor", F.pow(1 - F.col("ids"), 40).alias("p")))


def _hits(spark, d):
    return sig.hit_lists(_judged(spark, d)).withColumn("mse_cdf", F.lit(0.0))


def _tokens(spark, d):
    """Pairs of all tokens that stand in EVIDENCE documents or more: no rarer one can be seen with another more often than that."""
    m = document_tokens(spark, d, EVIDENCE)
    n = m.cells.count()
    p = stored(dep.normalised(m.counts))  # texts are cut into words once
    y = stored(dep.scaled(p, dep.ceilings(p, n, 1.0, 20)))
    wide = y.select("gene").distinct().count() >= dep.WIDE_FROM
    return stored((dep.blocked_pairs if wide else dep.pairs)(y, n))


@query("b21_min_observations", sql(BOTH + ", x as (select * from both_ where cooc > (select median(cooc) from pairs)), k as (select gene from x group by gene having count(*) >= 12), r as (select gene, neighbor, ids from x where gene in (from k) and neighbor in (from k))", "ids", "gene neighbor"))
def b21(spark, d):
    p = customer_pairs(spark, d).withColumn("ids", F.round("ids", 6))
    most = p.agg(F.percentile("cooc", F.lit(0.5)).alias("t")).first()["t"]
    return rounded(sig.observed(sig.mirrored(sig.with_evidence(p, most)), 12).select("gene", "neighbor", "ids"))


@query("b22_fit_filter", sql(HITS + ", r as (select gene, num_hits, num_hits between 2 and 20 as kept from h)", "", "gene num_hits kept"))
def b22(spark, d):
    return sig.acceptable(_hits(spark, d), 0.01, 20).select("gene", "num_hits", "kept")


@query("b23_keyword_drop", "select distinct p_brand as gene from part where not regexp_matches(upper(p_brand), 'BRAND#2|#33')")
def b23(spark, d):
    g = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("gene")).distinct()
    return sig.without_keywords(g, ("BRAND#2", "#33"))


@query("f03_f04_beta_tails")
def f03(spark, d):
    """Tails and quantiles of beta distributions; tests compare with closed forms."""
    import numpy as np
    import pandas as pd

    from ..functions.betafn import beta_cdf, beta_ppf

    def work(batches):
        for b in batches:
            x, a, c = ((b["id"].to_numpy() % k + 1.0) for k in (97, 7, 5))
            q = beta_cdf(x / 98, a, c)
            yield pd.DataFrame({"id": b["id"], "cdf": q, "ppf": beta_ppf(np.clip(q, 1e-12, 1 - 1e-12), a, c)})

    return spark.range(500).mapInPandas(work, "id long, cdf double, ppf double")


@query("f05_ks_statistic", sql(BOTH + ", x as (select gene, ids, row_number() over (partition by gene order by ids, neighbor) as i, count(*) over (partition by gene) as n, max(ids) over (partition by gene) as top from both_), r as (select gene, max(greatest(i / n - ids / top, ids / top - (i - 1) / n)) as ks from x group by gene)", "ks", "gene"))
def f05(spark, d):
    """Distance of each gene's values from the uniform distribution up to their maximum."""
    from pyspark.sql import Window as W

    g = W.partitionBy("gene")
    x = _both(spark, d).withColumns({"i": F.row_number().over(g.orderBy("ids", "neighbor")), "n": F.count(F.lit(1)).over(g), "u": F.col("ids") / F.max("ids").over(g)})
    return rounded(x.groupBy("gene").agg(F.max(F.greatest(F.col("i") / F.col("n") - F.col("u"), F.col("u") - (F.col("i") - 1) / F.col("n"))).alias("ks")))


@query("f07_moment_parameters", sql(BOTH + ", m as (select gene, avg(ids) / max(ids) / 15e-1 as mu, var_pop(ids) / (max(ids) * 15e-1) ** 2 as v from both_ group by gene), r as (select gene, mu * (mu * (1 - mu) / v - 1) as alpha, (1 - mu) * (mu * (1 - mu) / v - 1) as beta from m)", "alpha beta", "gene", digits=3))
def f07(spark, d):
    """Shape parameters from the mean and variance of values over 1.5 times their maximum."""
    c = F.max("ids") * 1.5
    m = _both(spark, d).groupBy("gene").agg((F.avg("ids") / c).alias("mu"), (F.var_pop("ids") / c / c).alias("v"))
    k = F.col("mu") * (1 - F.col("mu")) / F.col("v") - 1
    return rounded(m.select("gene", (F.col("mu") * k).alias("alpha"), ((1 - F.col("mu")) * k).alias("beta")), 3)


@query("g11_neighbour_counts", sql(BOTH + ", r as (select gene, count(*) filter (ids > 0) as row_nnz from both_ group by gene)", "", "gene row_nnz"))
def g11(spark, d):
    return _both(spark, d).groupBy("gene").agg(F.count_if(F.col("ids") > 0).alias("row_nnz"))


@query("g12_hit_lists", sql(HITS + ", r as (select gene, num_hits, coalesce(array_to_string(hits, ','), '') as hits from h)", "", "gene num_hits hits"))
def g12(spark, d):
    return _hits(spark, d).select("gene", "num_hits", F.array_join("significant_hit_genes", ",").alias("hits"))


@query("g13_graph_density", sql(EDGES + ", r as (select 100 * (select count(*) from u) / nullif((select count(distinct a) from u), 0) ** 2 as density_pct)", "density_pct"))
def g13(spark, d):
    u = sig.undirected(sig.directed_edges(_hits(spark, d), most=20))
    return rounded(u.agg((F.try_divide(100 * F.count(F.lit(1)), F.pow(F.countDistinct("a"), F.lit(2.0)))).alias("density_pct")))


@query("p01_null_fits")
def p01(spark, d):
    return sig.fits(sig.mirrored(_tokens(spark, d)))


@query("p03_p_values")
def p03(spark, d):
    both = sig.mirrored(_tokens(spark, d))
    return sig.p_values(both, sig.fits(both))


@query("p05_directed_edges", sql(EDGES + ", r as (select * from d)", "", "src dst"))
def p05(spark, d):
    return sig.directed_edges(_hits(spark, d), most=20)


@query("s09_gene_universe", sql(EDGES + ", r as (select src as gene from d union select dst from d)", "", "gene"))
def s09(spark, d):
    e = sig.directed_edges(_hits(spark, d), most=20)
    return e.select(F.col("src").alias("gene")).union(e.select("dst")).distinct()


@query("s10_undirected_edges", sql(EDGES + ", r as (select * from u)", "", "a b"))
def s10(spark, d):
    return sig.undirected(sig.directed_edges(_hits(spark, d), most=20))


@query("step4_significance")
def step4(spark, d):
    """Evidence, fits, p-values, false discovery and hit lists in one."""
    return sig.significance(_tokens(spark, d))


@query("w06_bh_fdr", sql(BH + ", r as (select gene, neighbor, p, significant from bh)", "p", "gene neighbor significant"))
def w06(spark, d):
    return rounded(_judged(spark, d))


_TRIMMED = BOTH + """, l as (select gene, list_sort(list(ids)) as v from both_ where ids > 0 group by gene),
t as (select gene, case when len(v) - ceil(len(v) * 5e-3)::bigint - ceil(len(v) * 1e-2)::bigint < 2 then v else v[ceil(len(v) * 5e-3)::bigint + 1 : len(v) - ceil(len(v) * 1e-2)::bigint] end as v from l),
x as (select gene, v, k, k / 199e0 * (len(v) - 1) as p from t, range(200) s(k)),
r as (select gene, k::integer as k, v[floor(p)::bigint + 1] + (p - floor(p)) * (v[ceil(p)::bigint + 1] - v[floor(p)::bigint + 1]) as q from x)"""


@query("w08_quantile_vector", sql(_TRIMMED, "q", "gene k", digits=8))
def w08(spark, d):
    """200 quantiles of each gene's values, without half a percent below and one above."""
    q = sig.quantile_vectors(_both(spark, d), below=0.5, above=1.0)
    return rounded(q.select("gene", F.posexplode("q").alias("k", "q")), 8)


@query("w09_sorted_values", sql(BOTH + ", r as (select gene, array_to_string(list_transform(list_sort(list(ids)), lambda x: (round(x * 1e6))::bigint), ',') as packed from both_ where ids > 0 group by gene)", "", "gene packed"))
def w09(spark, d):
    lists = _both(spark, d).where("ids > 0").groupBy("gene").agg(F.sort_array(F.collect_list("ids")).alias("v"))
    return lists.select("gene", F.array_join(F.transform("v", lambda x: F.round(x * 1e6).cast("long").cast("string")), ",").alias("packed"))


@query("w10_ecdf_ranks", sql(BOTH + ", r as (select gene, neighbor, row_number() over (partition by gene order by ids, neighbor) / count(*) over (partition by gene) as ecdf from both_)", "ecdf", "gene neighbor"))
def w10(spark, d):
    from pyspark.sql import Window as W

    g = W.partitionBy("gene")
    return rounded(_both(spark, d).select("gene", "neighbor", (F.row_number().over(g.orderBy("ids", "neighbor")) / F.count(F.lit(1)).over(g)).alias("ecdf")))
