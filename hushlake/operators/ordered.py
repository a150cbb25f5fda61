"""Ordered look-ups that stay spread out when one key holds most of the rows.

A plain window sorts all rows of a key in one task.  Here a key is cut into slices of its
order (a day, a thousand turns ...); the window runs inside (key, slice), and what has to
cross a slice border - the last value, the number of rows - is aggregated per slice first,
so the second window sees one row per slice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _with_slice_values(work: DataFrame, summary: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Null-safe join of a per-slice value, so rows with a NULL key are kept and served too."""
    on = [*keys, "__s"]
    side = summary.select(*[F.col(k).alias(f"__r_{k}") for k in on], out)
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in on])
    return work.join(side, cond, "left").drop(*[f"__r_{k}" for k in on])


def lag_sliced(df: DataFrame, keys: list[str], order: list[str], value: str, slice_: Column, out: str) -> DataFrame:
    """Value of the row before, per key.  ``slice_`` must not decrease along ``order``."""
    work = df.withColumn("__s", slice_)
    boxed = F.struct(F.col(value).alias("v"))
    ends = work.groupBy(*keys, "__s").agg(F.max_by(boxed, F.struct(*order)).alias("__end"))
    before = F.lag("__end").over(Window.partitionBy(*keys).orderBy("__s")).alias("__before")
    joined = _with_slice_values(work, ends.select(*keys, "__s", before), keys, "__before")
    inside = F.lag(boxed).over(Window.partitionBy(*keys, "__s").orderBy(*order))
    return joined.withColumn(out, F.coalesce(inside, F.col("__before"))["v"]).drop("__s", "__before")


def lead_sliced(df: DataFrame, keys: list[str], order: list[str], value: str, slice_: Column, out: str) -> DataFrame:
    """Value of the row behind, per key.  ``slice_`` must not decrease along ``order``."""
    work = df.withColumn("__s", slice_)
    boxed = F.struct(F.col(value).alias("v"))
    starts = work.groupBy(*keys, "__s").agg(F.min_by(boxed, F.struct(*order)).alias("__start"))
    behind = F.lead("__start").over(Window.partitionBy(*keys).orderBy("__s")).alias("__behind")
    joined = _with_slice_values(work, starts.select(*keys, "__s", behind), keys, "__behind")
    inside = F.lead(boxed).over(Window.partitionBy(*keys, "__s").orderBy(*order))
    return joined.withColumn(out, F.coalesce(inside, F.col("__behind"))["v"]).drop("__s", "__behind")


def row_number_sliced(df: DataFrame, keys: list[str], order: list[str], slice_: Column, out: str) -> DataFrame:
    """Position of a row within its key, from one.  ``slice_`` must not decrease along ``order``."""
    work = df.withColumn("__s", slice_)
    counts = work.groupBy(*keys, "__s").agg(F.count("*").alias("__c"))
    w = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(*keys, "__s", F.coalesce(F.sum("__c").over(w), F.lit(0)).alias("__base"))
    joined = _with_slice_values(work, base, keys, "__base")
    inside = F.row_number().over(Window.partitionBy(*keys, "__s").orderBy(*order))
    return joined.withColumn(out, F.col("__base") + inside).drop("__s", "__base")


def running_sliced(df: DataFrame, keys: list[str], order: list[str], value: Column, kind: str, slice_: Column, out: str) -> DataFrame:
    """Sum, maximum or last non-null ``value`` of the rows before a row, per key; null where there is none.

    ``kind`` is ``sum``, ``max`` or ``last``.  ``slice_`` must not decrease along ``order``.
    """
    work = df.withColumn("__s", slice_).withColumn("__v", value)
    rank = F.struct(*order)
    total = {"sum": F.sum("__v"), "max": F.max("__v"), "last": F.max_by("__v", F.when(F.col("__v").isNotNull(), rank))}[kind]
    per_slice = work.groupBy(*keys, "__s").agg(total.alias("__t"))

    def over(column: str, w: Window) -> Column:
        return {"sum": F.sum(column), "max": F.max(column), "last": F.last(column, ignorenulls=True)}[kind].over(w)

    earlier = Window.partitionBy(*keys).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    joined = _with_slice_values(work, per_slice.select(*keys, "__s", over("__t", earlier).alias("__base")), keys, "__base")
    inside = over("__v", Window.partitionBy(*keys, "__s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    joined = joined.withColumn("__in", inside)
    both = {
        "sum": F.when(F.col("__in").isNull(), F.col("__base")).otherwise(F.col("__in") + F.coalesce("__base", F.lit(0))),
        "max": F.greatest("__in", "__base"), "last": F.coalesce("__in", "__base"),
    }[kind]
    return joined.withColumn(out, both).drop("__s", "__v", "__in", "__base")
