"""Sources, quality control, selection, predicates and projections (A, B, S04, G18)."""

from pyspark.sql import functions as F

from ..operators import dependence as dep
from ..operators import qc
from ..registry import query
from ..sources.tables import customer_brand
from .common import CUSTOMER_BRAND, P, PAIRS, Y, at_maximum, customer_p, customer_pairs, customer_y, rounded, sql

PREFIX = "Brand#1"
METRICS = f"""m as (select cells.cell_id, cell_type, coalesce(sum(x), 0)::double as total, count(x) filter (x > 0) as nonzero,
  coalesce(sum(x) filter (gene like '{PREFIX}%'), 0) / (coalesce(sum(x), 0) + 1e-10) as ratio from cells left join counts on cells.cell_id = counts.cell_id group by all),
lim as (select quantile_cont(nonzero, 1e-2) as least_nonzero, quantile_cont(ratio, 99e-2) as most_ratio from m)"""
JUDGED = METRICS + ", j as (select *, total > 3000 as ft, nonzero <= least_nonzero as fn, ratio > most_ratio as fr from m, lim)"


def _metrics(spark, d):
    return qc.cell_metrics(customer_brand(spark, d), PREFIX)


@query("a02_matrix_source", sql("r as (select cell_id, gene, x from counts)", "x", "cell_id gene"))
def a02(spark, d):
    return rounded(customer_brand(spark, d).counts)


@query("a03_row_chunks", "select ((rn - 1) // 100)::bigint as chunk, min(rn)::bigint as first_row, max(rn)::bigint as last_row from (select row_number() over (order by c_custkey) as rn from customer) group by 1")
def a03(spark, d):
    ids = customer_brand(spark, d).cells.withColumn("source", F.lit("a"))
    c = qc.chunked(ids, "source", 100).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("k"))
    chunk = F.col("chunk_id").cast("long") - 1
    return c.select(chunk.alias("chunk"), (chunk * 100 + 1).alias("first_row"), (chunk * 100 + F.col("k")).alias("last_row"))


@query("a07_chunk_ids", "select cell_id, cell_type, (before + k + 1)::integer as chunk_id from (select *, row_number() over (partition by cell_type order by cell_id) - 1 as rn from (select c_custkey as cell_id, c_mktsegment as cell_type from customer)) x join (select cell_type as t, sum(chunks) over (order by cell_type) - chunks as before from (select c_mktsegment as cell_type, (count(*) + 99) // 100 as chunks from customer group by 1)) y on x.cell_type = y.t, lateral (select rn // 100 as k)")
def a07(spark, d):
    return qc.chunked(customer_brand(spark, d).cells, "cell_type", 100)


@query("a08_gene_axis", sql("r as (select gene, (row_number() over (order by gene) - 1)::integer as gene_idx from (select distinct gene from counts))", "", "gene gene_idx"))
def a08(spark, d):
    return qc.gene_axis(customer_brand(spark, d).counts)


@query("b01_cell_qc_metrics", sql(METRICS + ", r as (select * from m)", "total ratio", "cell_id cell_type nonzero"))
def b01(spark, d):
    return rounded(_metrics(spark, d))


@query("b02_marker_genes", sql(f"r as (select distinct gene, gene like '{PREFIX}%' as marked from counts)", "", "gene marked"))
def b02(spark, d):
    return customer_brand(spark, d).counts.select("gene", qc.marker(PREFIX).alias("marked")).distinct()


@query("b03_qc_thresholds", sql(METRICS + ", r as (select * from lim)", "least_nonzero most_ratio"))
def b03(spark, d):
    return rounded(qc.thresholds(_metrics(spark, d)))


@query("b04_qc_filter", sql(JUDGED + ", r as (select * from j where not (ft or fn or fr))", "total ratio", "cell_id cell_type nonzero"))
def b04(spark, d):
    m = _metrics(spark, d)
    return rounded(qc.passing(m, qc.thresholds(m), 3000))


@query("b05_qc_attrition", sql(JUDGED + """, r as (select count(*) as cells, count(*) filter (ft) as fails_total, count(*) filter (fn) as fails_nonzero, count(*) filter (fr) as fails_ratio, count(*) filter (ft or fn or fr) as fails_any,
  avg(ft::int) as fails_total_share, avg(fn::int) as fails_nonzero_share, avg(fr::int) as fails_ratio_share, avg((ft or fn or fr)::int) as fails_any_share from j)""", "fails_total_share fails_nonzero_share fails_ratio_share fails_any_share", "cells fails_total fails_nonzero fails_ratio fails_any"))
def b05(spark, d):
    m = _metrics(spark, d)
    return rounded(qc.attrition(m, qc.thresholds(m), 3000))


@query("b06_histogram", sql(METRICS + ", r as (select least(floor((total - lo) / (hi - lo) * 30), 29)::integer as bin, count(*) as n from m, (select min(total) as lo, max(total) as hi from m) group by 1)", "", "bin n"))
def b06(spark, d):
    return qc.histogram(_metrics(spark, d), "total")


@query("b06_survival", sql(METRICS + ", r as (select total as value, sum(count(*)) over (order by total desc) / sum(count(*)) over () as share from m group by total)", "value share"))
def b06s(spark, d):
    return rounded(qc.survival(_metrics(spark, d), "total"))


@query("b07_category_filter", "select c_custkey as cell_id, c_mktsegment as cell_type from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def b07(spark, d):
    return qc.of_types(customer_brand(spark, d).cells, ["BUILDING", "MACHINERY"])


@query("b08_default_label", "select c_custkey as cell_id, 'unannotated' as cell_type from customer")
def b08(spark, d):
    return qc.labelled(customer_brand(spark, d).cells.select("cell_id"))


@query("b09_category_counts", "select c_mktsegment as cell_type, count(*) as n from customer group by 1")
def b09(spark, d):
    return qc.type_counts(customer_brand(spark, d).cells)


@query("b10_guarded_cast", sql("r as (select cell_id, gene, x::integer as x from counts)", "", "cell_id gene x"))
def b10(spark, d):
    return qc.guarded(customer_brand(spark, d).counts)


@query("b11_null_labels", "select c_custkey as cell_id, case when c_custkey % 4 in (0, 1, 2) then '' else c_mktsegment end as cell_type from customer")
def b11(spark, d):
    k = F.col("cell_id") % 4
    odd = F.when(k == 0, F.lit(None)).when(k == 1, "nan").when(k == 2, "<NA>").otherwise(F.col("cell_type"))
    return qc.labelled(customer_brand(spark, d).cells.withColumn("cell_type", odd))


@query("b13_gene_projection", sql("r as (select cell_id, gene, x from counts where gene in (select p_brand from part where p_size > 40))", "x", "cell_id gene"))
def b13(spark, d):
    genes = spark.read.parquet(f"{d}/part.parquet").where("p_size > 40").select(F.col("p_brand").alias("gene")).distinct()
    return rounded(qc.of_genes(customer_brand(spark, d).counts, genes)).select("cell_id", "gene", "x")


@query("b14_cell_subset", sql("r as (select cell_id, gene, x from counts where cell_id in (select c_custkey from customer where c_acctbal > 0))", "x", "cell_id gene"))
def b14(spark, d):
    some = spark.read.parquet(f"{d}/customer.parquet").where("c_acctbal > 0").select(F.col("c_custkey").alias("cell_id"))
    return rounded(qc.of_cells(customer_brand(spark, d), some).counts).select("cell_id", "gene", "x")


@query("b15_normalised", sql(P + ", r as (select * from p)", "p", "cell_id gene"))
def b15(spark, d):
    return rounded(customer_p(spark, d)[1].select("cell_id", "gene", "p"))


@query("b16_b18_clipped_scaled", sql(Y.replace("max(p) as top", "avg(p) as top") + ", r as (select * from y)", "y", "cell_id gene"))
def b16(spark, d):
    """Clipped at the mean of nonzero shares, so that clipping shows; scaled to 8."""
    _, p, _ = customer_p(spark, d)
    ceil = p.groupBy("gene").agg(F.avg("p").alias("clip_val"))
    return rounded(dep.scaled(p, ceil).select("cell_id", "gene", "y"))


@query("b19_truncated_ids", sql(PAIRS + ", r as (select g1, g2, floor(round(ids, 6) * 1e4) / 1e4 as ids from pairs)", "ids", "g1 g2"))
def b19(spark, d):
    return customer_pairs(spark, d).select("g1", "g2", dep.truncated(F.round("ids", 6)).alias("ids"))


@query("b20_evidence_mask", sql(PAIRS + ", r as (select g1, g2, cooc, ids from pairs where cooc > (select median(cooc) from pairs))", "ids", "g1 g2 cooc"))
def b20(spark, d):
    p = customer_pairs(spark, d)
    t = p.agg(F.percentile("cooc", F.lit(0.5)).alias("t_"))
    return rounded(p.join(F.broadcast(t)).where("cooc > t_").select("g1", "g2", "cooc", "ids"))


@query("g18_dataset_info", sql("r as (select count(*) as cells, (select count(distinct gene) from counts) as genes, count(distinct cell_type) as types from cells)", "", "cells genes types"))
def g18(spark, d):
    m = customer_brand(spark, d)
    genes = m.counts.agg(F.countDistinct("gene").alias("genes"))
    return m.cells.agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("cell_type").alias("types")).join(F.broadcast(genes)).select("cells", "genes", "types")
