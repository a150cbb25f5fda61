"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text without its white space is cut into chunks at places that its content decides.  Every distinct chunk
moves once per task to a dictionary, where chunks with one hash are compared byte by byte; the hash is the chunk's
identifier unless two different chunks share it, in which case their rank is added.  From then on a text is
its recipe, the ordered list of identifiers, some hundred times shorter than the text.  Recipes are grouped and
joined; long texts do not move again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: The six characters that do not count.
WHITE = r"[\x20\x09-\x0D]+"
#: From 1,024 characters on, a chunk ends after the next vowel that one of g to k follows, or after 8,192.
CHUNK = r"(?s).{1024,8192}?[aeiouAEIOU](?=[g-kG-K])|.{1,8192}"


def _normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def _chunks(normalised: Column) -> Column:
    return F.regexp_extract_all(normalised, F.lit(CHUNK), F.lit(0))


def _collisions(chunks: DataFrame) -> DataFrame | None:
    """The chunk dictionary's doubtful part: (h, chunk, rank) of different chunks that share a hash; None if there are none."""
    entries = chunks.groupBy("h", "chunk").agg(F.lit(1).alias("one"))
    shared = stored(entries.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "shared")
    if shared.isEmpty():  # every hash is verified: chunks need not move again
        return None
    texts = chunks.join(shared, "h").distinct()
    return texts.groupBy("h").agg(F.sort_array(F.collect_set("chunk")).alias("all")).selectExpr("h", "posexplode(all) AS (rank, chunk)")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hashed=F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after deleting space, tab, line feed, vertical tab, form feed and carriage
    return.  Null counts as empty, and all empty texts form a group.  Of a group the row with the most code
    points in its original text stays, then the smallest id; a null id loses against any other.  Repeated
    rows (one id, one text) each count in group_size and stay or go together.  Other columns are not read,
    and an empty table gives an empty result.  ``hashed`` makes a chunk's 64-bit hash.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cut = texts.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("size"), _normalised(F.col("text")).alias("norm"))
    recipes = stored(
        cut.select(
            "doc_id", "size", F.sha2("norm", 256).alias("text_sha256"),
            F.transform(_chunks(F.col("norm")), lambda c: hashed(c)).alias("recipe"),
        ),
        "recipes",
    )
    chunks = cut.select(F.explode(_chunks(F.col("norm"))).alias("chunk")).select(hashed("chunk").alias("h"), "chunk")
    doubtful = _collisions(chunks)
    if doubtful is None:
        recipes = recipes.withColumn("ranks", F.lit(""))
    else:
        recipes = recipes.join(_ranks(cut, stored(doubtful, "collisions"), hashed), "text_sha256", "left").withColumn("ranks", F.coalesce("ranks", F.lit("")))
    best = F.struct((-F.col("size")).alias("size"), F.col("doc_id").isNull().alias("no_id"), "doc_id")
    groups = recipes.groupBy("recipe", "ranks").agg(F.min(best).alias("best"), F.count("*").alias("group_size"))
    return recipes.join(groups, ["recipe", "ranks"]).select(
        "doc_id", F.col("best.doc_id").alias("keep_id"), "group_size",
        (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("size") == -F.col("best.size"))).alias("kept"),
        "text_sha256",
    )


def _ranks(cut: DataFrame, doubtful: DataFrame, hashed) -> DataFrame:
    """(text_sha256, ranks): for texts with doubtful chunks, which of the chunks with that hash stands where."""
    parts = cut.select(F.sha2("norm", 256).alias("text_sha256"), F.posexplode(_chunks(F.col("norm"))).alias("pos", "chunk"))
    found = parts.withColumn("h", hashed("chunk")).join(doubtful, ["h", "chunk"]).select("text_sha256", "pos", "rank").distinct()
    return found.groupBy("text_sha256").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "rank"))), lambda x: F.concat_ws(":", x["pos"], x["rank"])), ",").alias("ranks")
    )


EXACT_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS size, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents
), best AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY size DESC, doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id,
    max(size) OVER (PARTITION BY norm) AS most, count(*) OVER (PARTITION BY norm) AS group_size FROM t
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AND size = most AS kept, sha256(norm) AS text_sha256 FROM best
"""
