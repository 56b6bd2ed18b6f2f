"""Sums of new counts, added up as they come: a stream of cells keeps each gene's moments up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def partial_sums(counts: DataFrame) -> DataFrame:
    """(gene, n, s, q): mergeable sums of shares; a cell's counts must come in one batch."""
    lib = counts.groupBy("cell_id").agg(F.sum("x").alias("lib"))
    p = counts.join(lib, "cell_id").withColumn("p", F.try_divide("x", "lib"))
    return p.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))


def totals(parts: DataFrame, cells: int) -> DataFrame:
    """Mean and population deviation of each gene over all cells, from any number of partial sums."""
    t = parts.groupBy("gene").agg(F.sum("n").alias("nonzero"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / cells
    return t.select("gene", mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / cells - mean * mean, F.lit(0.0))).alias("std"), "nonzero")


def follow(counts: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    """A writer that keeps the partial sums of each batch under out/batch=N; a batch that is done again replaces its own."""
    return counts.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, k: partial_sums(df).write.mode("overwrite").parquet(f"{out}/batch={k}"))
