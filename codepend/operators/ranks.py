"""Exact percentiles and ranks of columns of any length, without a task that sees a whole group.

Sketches of each group's values (mergeable, so combined before the shuffle) give bounds that cut it
into PARTS ranges of about equal size. Ranges are counted; an order statistic lies in a known range, and
only that range's rows are sorted. Bounds only decide who sorts what: results are exact whatever they are.
Values that repeat are counted before they are sorted, so ties don't make a range large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.tables import stored

PARTS, STEP = 256, 16


def _keyed(df: DataFrame, by: Sequence[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(by)) if by else (df.withColumn("all_", F.lit(0)), ["all_"])


def in_ranges(df: DataFrame, value: Column, by: Sequence[str], parts: int = PARTS) -> DataFrame:
    """df with v_, the value, and part_, the number of its range in its group. Groups are few: a program, a type."""
    df = df.withColumn("v_", value).where("v_ is not null")
    cuts = F.percentile_approx("v_", [k / parts for k in range(1, parts)], 10 * parts)
    sketch = df.groupBy(*by).agg(F.array_distinct(cuts).alias("cuts_"))
    # the first bound that is not below the value: every STEP-th is looked at, then those up to it
    steps = F.transform(F.sequence(F.lit(STEP), F.greatest(F.size("cuts_"), F.lit(STEP)), F.lit(STEP)), lambda i: F.get("cuts_", i - 1))
    sketch = sketch.withColumn("steps_", F.filter(steps, lambda c: c.isNotNull()))
    below = lambda c: c < F.col("v_")
    whole = F.size(F.filter("steps_", below)) * STEP
    part = whole + F.size(F.filter(F.slice("cuts_", whole + 1, STEP), below)) + 1
    return df.join(F.broadcast(sketch), list(by)).withColumn("part_", part).drop("cuts_", "steps_")


def _counted(df: DataFrame, value: Column, by: Sequence[str], parts: int) -> DataFrame:
    """(by, v_, k_, part_): each group's values, counted before they are dealt to ranges; df is read once."""
    once = stored(df.select(*by, value.alias("v_")).where("v_ is not null").groupBy(*by, "v_").agg(F.count(F.lit(1)).alias("k_")))
    return in_ranges(once, F.col("v_"), by, parts)


def _before(counted: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, part_, n_, before_, all_n_) from rows of ranges: a row for each range of each group."""
    per = counted.groupBy(*by, "part_").agg(F.sum("k_").alias("n_"))
    whole = W.partitionBy(*by)
    return per.withColumns({"before_": F.sum("n_").over(whole.orderBy("part_")) - F.col("n_"), "all_n_": F.sum("n_").over(whole)})


def percentiles(df: DataFrame, value: str | Column, shares: Sequence[float], by: Sequence[str] = (), parts: int = PARTS) -> DataFrame:
    """(by, q): the linearly interpolated percentiles of each group's values, nulls apart, as an array; no row for a group without values."""
    df, keys = _keyed(df, by)
    ranged = _counted(df, F.col(value) if isinstance(value, str) else value, keys, parts)
    before = _before(ranged, keys)
    wanted = before.withColumn("s_", F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(float(s)).alias("s")) for i, s in enumerate(shares)))))
    at = F.col("s_.s") * (F.col("all_n_") - 1)
    wanted = wanted.select(*keys, "part_", "before_", "n_", F.col("s_.i").alias("i_"), at.alias("at_"), F.explode(F.array(F.floor(at), F.ceil(at))).alias("rank_"))
    wanted = wanted.where("rank_ >= before_ and rank_ < before_ + n_").withColumn("rank_", F.col("rank_") - F.col("before_")).drop("before_", "n_").distinct()
    run = F.sum("k_").over(W.partitionBy(*keys, "part_").orderBy("v_"))
    sorted_ = ranged.join(F.broadcast(wanted.select(*keys, "part_").distinct()), [*keys, "part_"], "left_semi").withColumn("upto_", run)
    got = sorted_.join(F.broadcast(wanted), [*keys, "part_"]).where("rank_ < upto_ and rank_ >= upto_ - k_")
    # of the two neighbours of a position the lower one has the lower value
    one = got.groupBy(*keys, "i_", "at_").agg(F.min("v_").alias("lo_"), F.max("v_").alias("hi_"))
    one = one.withColumn("q_", F.col("lo_") + (F.col("at_") - F.floor("at_")) * (F.col("hi_") - F.col("lo_")))
    out = one.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("i_", "q_"))), lambda x: x["q_"]).alias("q"))
    return out.select(*by, "q")


def ranked(df: DataFrame, value: str, tie: str, by: Sequence[str] = (), name: str = "rank", parts: int = PARTS) -> DataFrame:
    """df with the place, from 1 on, of each row in its group by value and tie; and size_, the group's rows. value is a number and not null."""
    names = df.columns
    df, keys = _keyed(df, by)
    ranged = in_ranges(df, F.col(value), keys, parts)
    before = _before(ranged.withColumn("k_", F.lit(1)), keys).select(*keys, "part_", "before_", F.col("all_n_").alias("size_"))
    place = F.row_number().over(W.partitionBy(*keys, "part_").orderBy("v_", tie))
    return ranged.withColumn("place_", place).join(F.broadcast(before), [*keys, "part_"]).select(*names, (F.col("place_") + F.col("before_")).alias(name), "size_")


def shares_from_above(df: DataFrame, value: str, parts: int = PARTS) -> DataFrame:
    """(value, share of the rows at or above it), once for each value."""
    df, keys = _keyed(df.select(value), ())
    ranged = _counted(df, F.col(value), keys, parts)
    before = _before(ranged, keys)
    upto = F.sum("k_").over(W.partitionBy(*keys, "part_").orderBy("v_"))
    j = ranged.withColumn("upto_", upto).join(F.broadcast(before), [*keys, "part_"])
    return j.select(F.col("v_").alias("value"), ((F.col("all_n_") - F.col("before_") - F.col("upto_") + F.col("k_")) / F.col("all_n_")).alias("share"))
