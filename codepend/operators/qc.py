"""Quality control of cells and selection of cells and genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..sources.tables import Matrix
from .ranks import percentiles, ranked, shares_from_above


def marker(prefix: str) -> Column:
    """Whether a gene's name begins with the prefix."""
    return F.col("gene").startswith(prefix)


def cell_metrics(m: Matrix, prefix: str) -> DataFrame:
    """total, nonzero and the share of marked genes of every cell, empty ones included."""
    got = m.counts.groupBy("cell_id").agg(F.sum("x").alias("total"), F.count_if(F.col("x") > 0).alias("nonzero"), F.sum(F.when(marker(prefix), F.col("x")).otherwise(0.0)).alias("marked"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return m.cells.join(got, "cell_id", "left").select("cell_id", "cell_type", zero("total").alias("total"), F.coalesce("nonzero", F.lit(0)).alias("nonzero"), (zero("marked") / (zero("total") + 1e-10)).alias("ratio"))


def thresholds(metrics: DataFrame, nonzero_pct: float = 1, ratio_pct: float = 99) -> DataFrame:
    """One row: interpolated percentiles over all cells."""
    q = lambda c, pct, name: percentiles(metrics, F.col(c).cast("double"), [pct / 100]).select(F.col("q")[0].alias(name))
    return q("nonzero", nonzero_pct, "least_nonzero").join(F.broadcast(q("ratio", ratio_pct, "most_ratio")))


def judged(metrics: DataFrame, limits: DataFrame, most_total: float = 30_000) -> DataFrame:
    """metrics with a flag for each criterion a cell fails; limits has one row."""
    return metrics.join(F.broadcast(limits)).withColumns({"fails_total": F.col("total") > most_total, "fails_nonzero": F.col("nonzero") <= F.col("least_nonzero"), "fails_ratio": F.col("ratio") > F.col("most_ratio")})


def passing(metrics: DataFrame, limits: DataFrame, most_total: float = 30_000) -> DataFrame:
    return judged(metrics, limits, most_total).where("not (fails_total or fails_nonzero or fails_ratio)").drop("fails_total", "fails_nonzero", "fails_ratio", *limits.columns)


def attrition(metrics: DataFrame, limits: DataFrame, most_total: float = 30_000) -> DataFrame:
    """How many cells fail each criterion and any of them, and their share."""
    fails = ("fails_total", "fails_nonzero", "fails_ratio")
    j = judged(metrics, limits, most_total).withColumn("fails_any", F.expr(" or ".join(fails)))
    return j.agg(F.count(F.lit(1)).alias("cells"), *(F.count_if(c).alias(c) for c in (*fails, "fails_any")), *(F.avg(F.col(c).cast("double")).alias(f"{c}_share") for c in (*fails, "fails_any")))


def histogram(values: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """(bin, n): equal bins from the least to the greatest value, the last one closed; empty ones are absent."""
    span = values.agg(F.min(column).alias("lo_"), F.max(column).alias("hi_"))
    place = F.least(F.floor((F.col(column) - F.col("lo_")) / F.nullif(F.col("hi_") - F.col("lo_"), F.lit(0.0)) * bins), F.lit(bins - 1))
    return values.join(F.broadcast(span)).groupBy(F.coalesce(place, F.lit(0)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def survival(values: DataFrame, column: str) -> DataFrame:
    """(value, share of values at or above it), once for each value."""
    return shares_from_above(values, column)


def of_types(cells: DataFrame, types: list[str]) -> DataFrame:
    """Cells of the types; none given: all."""
    return cells.where(F.col("cell_type").isin(types)) if types else cells


def labelled(cells: DataFrame, label: str = "cell_type") -> DataFrame:
    """cells with the chosen label as cell_type: `unannotated` without such a column; missing and nan-like ones empty."""
    if label not in cells.columns:
        return cells.withColumn("cell_type", F.lit("unannotated"))
    t = F.col(label).cast("string")
    return cells.withColumn("cell_type", F.when(t.isNull() | t.isin("nan", "NaN", "<NA>"), "").otherwise(t))


def type_counts(cells: DataFrame) -> DataFrame:
    return cells.groupBy("cell_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cell_type")


def guarded(counts: DataFrame, most: int = 65_535) -> DataFrame:
    """x as a whole number; raises where it is above `most`."""
    return counts.withColumn("x", F.when(F.col("x") > most, F.raise_error(F.concat(F.lit(f"a count is above {most}: "), F.col("x").cast("string")))).otherwise(F.col("x")).cast("int"))


def of_genes(counts: DataFrame, genes: DataFrame) -> DataFrame:
    return counts.join(genes.select("gene"), "gene", "left_semi")


def of_cells(m: Matrix, cells: DataFrame) -> Matrix:
    ids = cells.select("cell_id")
    return Matrix(m.cells.join(ids, "cell_id", "left_semi"), m.counts.join(ids, "cell_id", "left_semi"))


def gene_axis(counts: DataFrame) -> DataFrame:
    """Genes with their place in the order of names: one row for each gene, so one window task is enough."""
    return counts.select("gene").distinct().select("gene", (F.row_number().over(W.orderBy("gene")) - 1).alias("gene_idx"))


def chunked(cells: DataFrame, source: str, size: int = 100_000) -> DataFrame:
    """chunk_id from 1 on, at most `size` consecutive cells of one source each, by source and cell_id; a chunk never spans sources.

    Numbered cells are ranked by ranges, so no task sees all cells of a source; names are ranked by a window over their source.
    """
    if isinstance(cells.schema["cell_id"].dataType, NumericType):
        local = ranked(cells, "cell_id", "cell_id", [source], "place_").drop("size_")
    else:
        local = cells.withColumn("place_", F.row_number().over(W.partitionBy(source).orderBy("cell_id")))
    local = local.withColumn("local_", F.floor((F.col("place_") - 1) / size).cast("int")).drop("place_")
    per = cells.groupBy(source).agg(F.ceil(F.count(F.lit(1)) / size).alias("chunks_"))
    first = per.select(source, (F.sum("chunks_").over(W.orderBy(source)) - F.col("chunks_")).alias("before_"))  # a row for each source
    return local.join(F.broadcast(first), source).withColumn("chunk_id", (F.col("before_") + F.col("local_") + 1).cast("int")).select(*cells.columns, "chunk_id")


def working_name(types: list[str], given: str | None = None) -> str:
    """The name of the folder of a selection."""
    return given or "_".join(types) or "all"
