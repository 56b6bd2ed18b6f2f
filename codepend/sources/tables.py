"""Count matrices in long form: `cells` (cell_id, cell_type) has every observation, `counts` (cell_id, gene, x) what is above zero.

A missing row of counts stands for zero, so the number of observations always comes from `cells`.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Matrix:
    cells: DataFrame
    counts: DataFrame


def read_matrix(spark: SparkSession, path: str) -> Matrix:
    """A matrix stored as the tables `cells` and `counts` in one folder."""
    return Matrix(spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/counts"))


def stored(df: DataFrame) -> DataFrame:
    """df, computed once for several readers: written as Parquet to the shared folder that spark.checkpoint.dir names, or kept by persist() where it names none."""
    sc = df.sparkSession.sparkContext
    named = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        return df.persist()
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    path = f"{sc.getCheckpointDir()}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def from_rows(rows: DataFrame, cell: str, gene: str, x: str, cells: DataFrame | None = None) -> Matrix:
    """Sum x for each cell and gene; partial sums are made before the shuffle, where there is one: rows dealt by cell stay where they are."""
    counts = rows.groupBy(F.col(cell).alias("cell_id"), F.col(gene).alias("gene")).agg(F.sum(x).cast("double").alias("x")).where("x > 0")
    return Matrix(counts.select("cell_id").distinct().withColumn("cell_type", F.lit("unannotated")) if cells is None else cells, counts)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customer_brand(spark: SparkSession, sf_dir: str) -> Matrix:
    """Customers x brands, quantity bought; the market segment is the type."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    # the many lines are never sorted: each join hashes a partition of the smaller side
    rows = lines.join(part.hint("shuffle_hash"), lines.l_partkey == part.p_partkey).join(orders.hint("shuffle_hash"), lines.l_orderkey == orders.o_orderkey)
    rows = rows.select("o_custkey", "p_brand", "l_quantity").repartition("o_custkey")
    cells = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cell_id"), F.col("c_mktsegment").alias("cell_type"))
    return from_rows(rows, "o_custkey", "p_brand", "l_quantity", cells)


def order_brand(spark: SparkSession, sf_dir: str) -> Matrix:
    """Orders x brands, quantity."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    part = _t(spark, sf_dir, "part").select("p_partkey", "p_brand")
    cells = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("cell_id"), F.col("o_orderstatus").alias("cell_type"))
    return from_rows(lines.join(part, lines.l_partkey == part.p_partkey), "l_orderkey", "p_brand", "l_quantity", cells)


def document_tokens(spark: SparkSession, sf_dir: str, least: int = 150) -> Matrix:
    """Documents x tokens [a-z]+ of lower-cased texts that occur in `least` documents or more."""
    d = _t(spark, sf_dir, "documents")
    words = d.select(F.col("doc_id").alias("cell_id"), F.explode(F.expr("regexp_extract_all(lower(text), '[a-z]+', 0)")).alias("gene"))
    counts = words.groupBy("cell_id", "gene").agg(F.count(F.lit(1)).cast("double").alias("x"))
    frequent = counts.groupBy("gene").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("gene")
    return Matrix(d.select(F.col("doc_id").alias("cell_id"), F.col("lang").alias("cell_type")), counts.join(frequent, "gene", "left_semi").select("cell_id", "gene", "x"))


#: The same matrices as SQL, to begin a WITH clause.
CUSTOMER_BRAND = """cells as (select c_custkey as cell_id, c_mktsegment as cell_type from customer),
counts as (select o_custkey as cell_id, p_brand as gene, sum(l_quantity)::double as x from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey group by 1, 2 having sum(l_quantity) > 0)"""
ORDER_BRAND = """cells as (select o_orderkey as cell_id, o_orderstatus as cell_type from orders),
counts as (select l_orderkey as cell_id, p_brand as gene, sum(l_quantity)::double as x from lineitem join part on l_partkey = p_partkey group by 1, 2 having sum(l_quantity) > 0)"""
