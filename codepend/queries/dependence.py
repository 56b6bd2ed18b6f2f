"""Joins, moments, ceilings and all-pairs dependence."""

from pyspark.sql import functions as F

from ..operators import dependence as dep
from ..registry import query
from ..sources.tables import customer_brand, order_brand
from .common import FEATURE_MOMENTS, FEATURES, MOMENTS, ORDER_BRAND, P, PAIRS, Y, customer_p, customer_pairs, customer_y, rounded, sql

#: Ranks, the elbow of the r greatest shares of each gene, and its ceiling, as SQL.
TOP = MOMENTS + ", k as (select greatest(floor(n / 100)::bigint, 100) as k from n), ranked as (select * from (select *, row_number() over (partition by gene order by p desc, cell_id) as rank from p) where rank <= (select k from k)), w as (select gene, count(*) as nnz_topk from ranked group by gene)"
_D = lambda a: f"case when i = 0 then (-3 * {a} + 4 * lead({a}, 1) over w_ - lead({a}, 2) over w_) / (2 * h) when i = r - 1 then (3 * {a} - 4 * lag({a}, 1) over w_ + lag({a}, 2) over w_) / (2 * h) else (lead({a}, 1) over w_ - lag({a}, 1) over w_) / (2 * h) end"
ELBOW = f"""e0 as (select gene, rank - 1 as i, count(*) over g as r, (p - min(p) over g) / (max(p) over g - min(p) over g + 1e-12) as y0, 1 / (count(*) over g - 1 + 1e-12) as h from ranked window g as (partition by gene)),
e1 as (select *, {_D('y0')} as y1 from e0 where r >= 3 window w_ as (partition by gene order by i)), e2 as (select *, {_D('y1')} as y2 from e1 window w_ as (partition by gene order by i)),
bend as (select gene, i as elbow, r from e2 where i < r - floor(r * 1e-1) qualify row_number() over (partition by gene order by abs(y2) / (1 + y1 * y1) ** 15e-1 desc, i) = 1)"""


@query("f01_hermite_features", sql(FEATURES + ", r as (select * from f)", "y f0 f1 f2 f3 f4 f5", "cell_id gene"))
def f01(spark, d):
    return rounded(dep.features(customer_y(spark, d)[1]))


@query("f02_z_scores", sql(MOMENTS + ", r as (select cell_id, gene, (p - mean) / case when std = 0 then 1 else std end as z from p join mom using (gene))", "z", "cell_id gene"))
def f02(spark, d):
    _, p, n = customer_p(spark, d)
    return rounded(dep.z_scores(p, dep.gene_moments(p, n)).select("cell_id", "gene", "z"))


@query("g01_counts", sql("r as (select gene, count(*) as cells, count(distinct x) as values from counts group by gene)", "", "gene cells values"))
def g01(spark, d):
    return customer_brand(spark, d).counts.groupBy("gene").agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("x").alias("values"))


@query("g02_g03_gene_moments", sql(MOMENTS + ", r as (select * from mom)", "mean std top", "gene nonzero"))
def g02(spark, d):
    _, p, n = customer_p(spark, d)
    return rounded(dep.gene_moments(p, n), 6)


_FM = "m_f0 m_f1 m_f2 m_f3 m_f4 m_f5 m_y i_f0 i_f1 i_f2 i_f3 i_f4 i_f5 i_y"


@query("g04_g05_g08_feature_moments", sql(FEATURE_MOMENTS + ", r as (select * from fm)", _FM, "gene"))
def g04(spark, d):
    _, y, n = customer_y(spark, d)
    return rounded(dep.feature_moments(dep.features(y), n))


@query("g06_ids_pairs", sql(PAIRS + ", r as (select * from pairs)", "ids corr", "g1 g2 cooc"))
def g06(spark, d):
    """IDS, Pearson correlation and co-occurrence of all pairs, in one self-join."""
    return rounded(customer_pairs(spark, d))


@query("g06_ids_orders", sql(PAIRS + ", r as (select * from pairs)", "ids corr", "g1 g2 cooc", ORDER_BRAND))
def g06o(spark, d):
    m = order_brand(spark, d)
    p, n = dep.normalised(m.counts), m.cells.count()
    ceil = dep.gene_moments(p, n).select("gene", F.col("top").alias("clip_val"))
    return rounded(dep.pairs(dep.scaled(p, ceil), n))


@query("g06_ids_blocked", sql(PAIRS + ", r as (select * from pairs)", "ids corr", "g1 g2 cooc"))
def g06b(spark, d):
    """The same from Gram matrices of tiles, the form for wide matrices."""
    _, y, n = customer_y(spark, d)
    return rounded(dep.blocked_pairs(y, n, 8))


@query("g10_weighted_moments", sql(P + """, wt as (select cell_id, count(*) over () / count(*) over (partition by cell_type) as w from cells), t as (select sum(w) as w from wt),
r as (select gene, sum(wt.w * p) / any_value(t.w) as mean, greatest(sum(wt.w * p * p) / any_value(t.w) - (sum(wt.w * p) / any_value(t.w)) ** 2, 0) as var from p join wt using (cell_id), t group by gene)""", "mean var", "gene", digits=9))
def g10m(spark, d):
    m, p, _ = customer_p(spark, d)
    return rounded(dep.weighted_moments(p, dep.weights(m.cells)), 9)


@query("g10_weighted_covariances", sql(P + """, wt as (select cell_id, count(*) over () / count(*) over (partition by cell_type) as w from cells), t as (select sum(w) as w from wt), q as (select cell_id, gene, p, wt.w from p join wt using (cell_id)),
m as (select gene, sum(q.w * p) / any_value(t.w) as mean from q, t group by gene), s as (select a.gene as g1, b.gene as g2, sum(a.w * a.p * b.p) as s from q a join q b on a.cell_id = b.cell_id and a.gene < b.gene group by all),
r as (select g1, g2, s / t.w - a.mean * b.mean as cov from s join m a on g1 = a.gene join m b on g2 = b.gene, t)""", "cov", "g1 g2", digits=9))
def g10c(spark, d):
    m, p, _ = customer_p(spark, d)
    return rounded(dep.weighted_covariances(p, dep.weights(m.cells)), 9)


@query("g07_pearson", sql(PAIRS + ", r as (select g1, g2, corr from pairs)", "corr", "g1 g2"))
def g07(spark, d):
    _, y, n = customer_y(spark, d)
    return rounded(dep.pearson(y, n))


@query("g09_population_max", sql(P + ", r as (select gene, max(p) as top from p group by gene)", "top", "gene"))
def g09(spark, d):
    return rounded(customer_p(spark, d)[1].groupBy("gene").agg(F.max("p").alias("top")))


@query("g10_category_weights", "select c_custkey as cell_id, c_mktsegment as cell_type, round(count(*) over () / count(*) over (partition by c_mktsegment), 6) + 0.0 as weight from customer")
def g10(spark, d):
    return rounded(dep.weights(customer_brand(spark, d).cells))


@query("j01_cooccurrence", sql("r as (select a.gene as g1, b.gene as g2, count(*) as cooc from counts a join counts b on a.cell_id = b.cell_id and a.gene < b.gene group by all)", "", "g1 g2 cooc"))
def j01(spark, d):
    return dep.cooccurrence(customer_brand(spark, d).counts)


@query("j02_stats_attached", sql(MOMENTS + ", r as (select cell_id, gene, p, mean, std from p join mom using (gene))", "p mean std", "cell_id gene"))
def j02(spark, d):
    _, p, n = customer_p(spark, d)
    return rounded(p.join(F.broadcast(dep.gene_moments(p, n)), "gene").select("cell_id", "gene", "p", "mean", "std"))


@query("j03_label_alignment", sql("""axis as (select gene, cell_type from (select distinct p_brand as gene from part), (select distinct c_mktsegment as cell_type from customer union all select 'none of these')),
s as (select gene, cell_type, sum(x) as x from counts join cells using (cell_id) group by all), r as (select axis.gene, axis.cell_type, coalesce(x, 0)::double as x from axis left join s on axis.gene = s.gene and axis.cell_type = s.cell_type)""", "x", "gene cell_type"))
def j03(spark, d):
    """Totals of brands by segment, aligned to all brands and all segments and one more; what is missing is 0."""
    m = customer_brand(spark, d)
    genes = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_brand").alias("gene")).distinct()
    types = m.cells.select("cell_type").distinct().union(spark.range(1).select(F.lit("none of these")))
    axis = genes.join(F.broadcast(types.agg(F.collect_set("cell_type").alias("t")))).select("gene", F.explode("t").alias("cell_type"))  # types are few
    s = m.counts.join(m.cells, "cell_id").groupBy("gene", "cell_type").agg(F.sum("x").alias("x"))
    return rounded(axis.join(s, ["gene", "cell_type"], "left").select("gene", "cell_type", F.coalesce("x", F.lit(0.0)).alias("x")))


@query("w01_top_k", sql(TOP + ", r as (select gene, rank::integer as rank, p from ranked)", "p", "gene rank"))
def w01(spark, d):
    _, p, n = customer_p(spark, d)
    return rounded(dep.top_k(p, max(int(0.01 * n), 100)).select("gene", "rank", "p"))


@query("w02_nonzero_in_top_k", sql(TOP + ", r as (select * from w)", "", "gene nnz_topk"))
def w02(spark, d):
    _, p, n = customer_p(spark, d)
    return dep.top_k(p, max(int(0.01 * n), 100)).groupBy("gene").agg(F.count(F.lit(1)).alias("nnz_topk"))


@query("w03_elbow", sql(TOP + "," + ELBOW + ", r as (select gene, elbow::integer as elbow from bend)", "", "gene elbow"))
def w03(spark, d):
    _, p, n = customer_p(spark, d)
    return dep.elbow(dep.top_k(p, max(int(0.01 * n), 100))).select("gene", F.col("elbow").cast("int"))


@query("w04_w05_ceilings", sql(TOP.replace(", 100) as k", ", 60) as k") + "," + ELBOW + """, r as (select mom.gene, mean, std, case when nnz_topk > 60 - 1 then elbow end::integer as clip_idx, case when nnz_topk > 60 - 1 then ranked.p else top end as clip_val,
  case when nnz_topk > 60 - 1 then (ranked.p - mean) / std else 0 end as clip_z, nnz_topk, case when nnz_topk > 60 - 1 then greatest(0, nnz_topk - elbow - 1) / n else 0 end as clipped
  from mom join w on mom.gene = w.gene join bend on mom.gene = bend.gene join ranked on ranked.gene = mom.gene and rank = elbow + 1, n)""", "mean std clip_val clip_z clipped", "gene clip_idx nnz_topk"))
def w04(spark, d):
    """Ceilings at elbows for genes with 60 values or more among the top k."""
    _, p, n = customer_p(spark, d)
    return rounded(dep.ceilings(p, n, 1.0, 60, more_than=59))


@query("y_scaled_counts", sql(Y + ", r as (select * from y)", "y", "cell_id gene"))
def y_(spark, d):
    return rounded(customer_y(spark, d)[1].select("cell_id", "gene", "y"))
