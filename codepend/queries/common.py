"""Helpers of the queries: rounding on both sides, and the matrices as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import dependence as dep
from ..sources.tables import CUSTOMER_BRAND, ORDER_BRAND, Matrix, customer_brand, stored

DIGITS = 6


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles to the digits that sums in another order agree on."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def sql(body: str, doubles: str = "", others: str = "", base: str = CUSTOMER_BRAND, digits: int = DIGITS) -> str:
    """WITH base, then body as the last CTE `r`, with its doubles rounded."""
    cols = [*others.split(), *(f"round({c}, {digits}) + 0.0 as {c}" for c in doubles.split())]
    return f"with {base + ',' if base else ''} {body} select {', '.join(cols)} from r"


#: p, the moments of genes, ceilings at their maxima, and y, as SQL.
P = "p as (select cell_id, gene, x / sum(x) over (partition by cell_id) as p from counts), n as (select count(*)::double as n from cells)"
MOMENTS = P + ", mom as (select gene, sum(p) / any_value(n) as mean, sqrt(greatest(sum(p * p) / any_value(n) - (sum(p) / any_value(n)) ** 2, 0)) as std, max(p) as top, count(*) as nonzero from p, n group by gene)"
Y = MOMENTS + ", y as (select cell_id, gene, least(p, top) * 8 / top as y from p join mom using (gene))"
_F = ", ".join(f"y ** {k} / sqrt({k}!) * exp(-y * y / 2){' - 1' if k == 0 else ''} as f{k}" for k in range(6))
FEATURES = Y + f", f as (select cell_id, gene, y, {_F} from y)"
_COLS = [*(f"f{k}" for k in range(6)), "y"]
FEATURE_MOMENTS = FEATURES + ", fm as (select gene, " + ", ".join(f"sum({c}) / any_value(n) as m_{c}, case when sum({c} * {c}) / any_value(n) - (sum({c}) / any_value(n)) ** 2 < 1e-15 then 0 else 1 / sqrt(sum({c} * {c}) / any_value(n) - (sum({c}) / any_value(n)) ** 2) end as i_{c}" for c in _COLS) + " from f, n group by gene)"
_SUMS = ", ".join(f"sum(a.f{i} * b.f{j}) as s{i}{j}" for i in range(6) for j in range(6))
_IDS = ", ".join(f"abs((s{i}{j} / n - a.m_f{i} * b.m_f{j}) * a.i_f{i} * b.i_f{j})" for i in range(6) for j in range(6))
PAIRS = FEATURE_MOMENTS + f""", s as (select a.gene as g1, b.gene as g2, count(*) as cooc, {_SUMS}, sum(a.y * b.y) as sy from f a join f b on a.cell_id = b.cell_id and a.gene < b.gene group by all),
pairs as (select g1, g2, cooc, greatest({_IDS}) as ids, (sy / n - a.m_y * b.m_y) * a.i_y * b.i_y as corr from s join fm a on g1 = a.gene join fm b on g2 = b.gene, n)"""


def customer_p(spark, sf_dir: str) -> tuple[Matrix, DataFrame, int]:
    """The customer x brand matrix, its shares, and the number of cells; the joins behind both run once."""
    m = customer_brand(spark, sf_dir)
    p = stored(dep.normalised(m.counts))
    return Matrix(m.cells, p.select("cell_id", "gene", "x")), p, m.cells.count()


def at_maximum(p: DataFrame, n: int) -> DataFrame:
    """Ceilings at the genes' maxima."""
    return dep.gene_moments(p, n).select("gene", F.col("top").alias("clip_val"))


def customer_y(spark, sf_dir: str) -> tuple[Matrix, DataFrame, int]:
    m, p, n = customer_p(spark, sf_dir)
    return m, dep.scaled(p, stored(at_maximum(p, n))), n


def customer_pairs(spark, sf_dir: str) -> DataFrame:
    """All pairs of brands, kept as a table: a few hundred rows that cost a pass over all cells."""
    _, y, n = customer_y(spark, sf_dir)
    return stored(dep.pairs(y, n))


__all__ = ["CUSTOMER_BRAND", "ORDER_BRAND"]
