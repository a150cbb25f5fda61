"""Removing detections that are repeated or dominated by better ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hushlake.operators.containment import contained
from hushlake.sources.scratch import stored


#: Changed roots of one page that a row may carry; pages with more are joined root by root.
ROOTS = 64


def first_of_each(items: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row of each key.  An aggregation (combined before the shuffle), not a window, so a hot key stays cheap."""
    rest = [c for c in items.columns if c not in keys]
    row = F.struct(*rest)
    picked = items.groupBy(*keys).agg(F.min_by(row, F.struct(*order)).alias("__row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"__row.{c}").alias(c) for c in items.columns])


def drop_dominated(items: DataFrame, scan: str) -> DataFrame:
    """Drop an item when another of its type is more confident at the same selector, or holds its value.

    Both tests look at distinct values with their best confidence.  The containment test finds holders through each
    value's rarest piece, in those groups of a scan and type only that have values of different lengths, so neither many
    values of one type nor long ones form all pairs or all substrings.
    """
    best = items.groupBy(scan, "type", "selector").agg(F.max("confidence").alias("__best"))
    top = items.join(best, [scan, "type", "selector"]).filter(F.col("confidence") >= F.col("__best")).drop("__best")
    values = items.groupBy(scan, "type", "value").agg(F.max("confidence").alias("__hc"))
    lengths = values.groupBy(scan, "type").agg(F.min(F.length("value")).alias("__least"), F.max(F.length("value")).alias("__most"))
    mixed = stored(values.join(lengths.filter("__least < __most").hint("merge"), [scan, "type"]))  # read six times
    holders = mixed.filter(F.length("value") > F.col("__least")).select(scan, "type", F.col("value").alias("__holder"), "__hc")
    inner = mixed.filter(F.length("value") < F.col("__most")).select(scan, "type", "value")
    pairs = contained(holders, inner, [scan, "type"], "__holder", "value").filter(F.length("__holder") > F.length("value"))
    held = pairs.join(holders.hint("merge"), [scan, "type", "__holder"]).groupBy(scan, "type", "value").agg(F.max("__hc").alias("__hc"))
    joined = top.join(held, [scan, "type", "value"], "left")
    return joined.filter(F.col("__hc").isNull() | (F.col("__hc") < F.col("confidence"))).select(*items.columns)


def auto_redact(items: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Very confident detections that are still open become redacted."""
    sure = (F.col("confidence") >= threshold) & (F.col("status") == "detected")
    return items.withColumn("status", F.when(sure, F.lit("redacted")).otherwise(F.col("status")))


def merge_incremental(previous: DataFrame, rescanned: DataFrame, changed: DataFrame, page: str) -> DataFrame:
    """Keep what lies outside the changed roots, add the rescanned items, one row per (type, value).

    ``changed`` has (page, root); an item lies under a root when its path is the root or
    starts with the root and a separator.  The roots of a page come to its items as an array, so items move by page only and
    are not copied; pages of more than ``ROOTS`` roots (counted before the plan is made) expand paths to their ancestors
    and join root by root.
    """
    crowded = changed.groupBy(page).agg(F.count("root").alias("__n")).filter(F.col("__n") > ROOTS).select(page)
    if crowded.isEmpty():
        kept = _outside_few(previous, changed, page)
    else:
        crowded = stored(crowded)
        few, many = (_outside_few(previous, changed.join(crowded, page, "left_anti"), page), changed.join(crowded, page, "left_semi"))
        kept = few.join(_under_many(previous, many, page), [page, "path"], "left_anti").select(*previous.columns)
    merged = kept.withColumn("__gen", F.lit(0)).unionByName(rescanned.withColumn("__gen", F.lit(1)))
    return first_of_each(merged, [page, "type", "value"], ["__gen", "ord"]).drop("__gen")


def _outside_few(items: DataFrame, changed: DataFrame, page: str) -> DataFrame:
    """The items under none of the changed roots of their page."""
    roots = changed.groupBy(page).agg(F.collect_set("root").alias("__roots"))
    under = F.exists("__roots", lambda root: (F.col("path") == root) | F.startswith(F.col("path"), F.concat(root, F.lit("/"))))
    return items.join(roots, page, "left").filter(~F.coalesce(under, F.lit(False))).select(*items.columns)


def _under_many(items: DataFrame, changed: DataFrame, page: str) -> DataFrame:
    """(page, path) under changed roots, found through the ancestors of the paths."""
    parts = F.split("path", "/")
    ancestors = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")
    )
    roots = changed.select(page, "root").distinct()
    paths = items.select(page, "path").join(roots.select(page).distinct(), page, "left_semi").distinct()
    return (
        paths.select(page, "path", F.explode(ancestors).alias("root")).join(roots, [page, "root"], "left_semi")
        .select(page, "path").distinct()
    )


def latest_per_key(rows: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """Newest ``n`` rows of each key (a capped log).  Pruned before the shuffle by the group limit."""
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc())
    return rows.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")
