"""Which texts hold which values, by an index on each value's rarest piece.

A value is known by one of its pieces (grams): the one that fewest texts of its scope have.  Long values have long pieces,
as a short one of, say, six digits recurs in texts that are numbered, and candidates would grow with texts times values.
Texts are cut into their distinct grams of the same lengths, joined with those pieces, and every candidate is verified.
Frequent pieces never become keys while a value has a rarer one, so values that begin alike, or texts that share most of
their characters, do not meet in one group.  Nothing is broadcast (the joins say so, since a side that looks small when
compressed may not fit the driver), and the number of values is not bounded.  Sizes of pieces that hardly any value has
cost more than they find: without a scope, a few values are looked for in each text instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a gram, the longest that a value can fill; a value shorter than all is its own gram.
GRAMS = (8, 16, 32)
#: Values, and their characters in all, that are looked for one by one.
FEW, FEW_CHARS = 128, 8192
#: Longer texts are cut by way of their characters, as a substring is found by counting from the text's beginning.
LONG = 256


def gram_size(value: Column) -> Column:
    """Characters of the grams by which a value is known."""
    size = F.least(F.length(value), F.lit(GRAMS[0]))
    for n in GRAMS[1:]:
        size = F.when(F.length(value) >= n, n).otherwise(size)
    return size


def grams(text: Column, size: Column) -> Column:
    """Hashes of the distinct pieces of ``size`` characters, in time linear in the text."""
    chars = F.split(text, "")
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    short = F.transform(starts, lambda i: F.xxhash64(F.substring(text, i, size), size))
    long = F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(chars, i, size), ""), size))
    return F.when((F.length(text) >= size) & (F.length(text) > 0), F.array_distinct(F.when(F.length(text) <= LONG, short).otherwise(long)))


def spread_grams(value: Column, size: Column) -> Column:
    """Hashes of pieces half a size apart, and of the last one: whatever is half a size long lies in one of them."""
    last = F.length(value) - size
    starts = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.greatest(F.lit(1), F.floor(size / 2).cast("int"))), F.array(last)))
    return F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.substring(value, i + 1, size), size)))


def contained(texts: DataFrame, values: DataFrame, scope: list[str], text: str, value: str) -> DataFrame:
    """Distinct (scope..., value, text) where the text holds the value; both are compared within their scope only.

    Empty and null values are held by nothing.  Rows with a null scope meet nothing, as in any join.
    """
    needles = values.filter(F.length(value) > 0).select(*scope, F.col(value).alias("__v")).distinct().withColumn("__s", gram_size(F.col("__v")))
    hays = texts.filter(F.length(text) > 0).select(*scope, F.col(text).alias("__t")).distinct()
    # one row for each size, GRAMS[0] + len(GRAMS) - 1 at most
    sizes = sorted(needles.groupBy("__s").agg(F.count("*").alias("n"), F.sum(F.length("__v")).alias("chars")).collect(), key=lambda r: r["n"])
    few, n, chars = [], 0, 0
    for r in sizes if not scope else []:
        n, chars = n + r["n"], chars + r["chars"]
        if n <= FEW and chars <= FEW_CHARS:
            few.append(r["__s"])
    many = sorted(r["__s"] for r in sizes if r["__s"] not in few)
    found = []
    if few:
        sought = F.array(*[F.lit(r["__v"]) for r in needles.filter(F.col("__s").isin(few)).select("__v").collect()])
        found.append(hays.select("__t", F.explode(F.filter(sought, lambda v: F.col("__t").contains(v))).alias("__v")))
    if many or not few:
        found.append(_indexed(hays, needles.filter(F.col("__s").isin(many)) if few else needles, many, scope))
    held = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    return held.select(*scope, F.col("__v").alias(value), F.col("__t").alias(text))


def _indexed(hays: DataFrame, needles: DataFrame, sizes: list[int], scope: list[str]) -> DataFrame:
    """(scope..., __v, __t) by way of the index."""
    hays = hays.withColumn("__id", F.struct(F.xxhash64("__t").alias("a"), F.xxhash64(F.lit(1), "__t").alias("b")))
    nothing = F.array().cast("array<bigint>")
    cut = F.array_distinct(F.concat(nothing, *[F.coalesce(grams(F.col("__t"), F.lit(n)), nothing) for n in sizes]))
    pieces = hays.select(*scope, "__id", F.explode(cut).alias("__g"))

    parts = needles.select(*scope, "__v", F.explode(spread_grams(F.col("__v"), F.col("__s"))).alias("__g"))
    on = [*scope, "__g"]
    counts = pieces.groupBy(*on).agg(F.count("*").alias("__n"))  # combined before the shuffle, however frequent a piece is
    # a piece that no text has rules its value out: such a value gets no key at all
    keys = parts.join(counts.hint("merge"), on, "left").groupBy(*scope, "__v").agg(
        F.min_by("__g", F.struct(F.coalesce("__n", F.lit(0)), "__g")).alias("__g"), F.min(F.coalesce("__n", F.lit(0))).alias("__n")
    ).filter("__n > 0").drop("__n")
    met = pieces.join(keys.hint("merge"), on).select(*scope, "__id", "__v")  # once each: a text has a piece once, a value one key
    return met.join(hays.hint("merge"), [*scope, "__id"]).filter(F.col("__t").contains(F.col("__v"))).select(*scope, "__v", "__t")
