"""Benchmark decontamination by winnowing.

Of every six consecutive 5-word hashes the least is a fingerprint (all of them, if several are equal), so each
shared span of ten words holds a fingerprint on both sides.  Fingerprints of documents and benchmark are joined, and
a hit is extended word by word to both sides; runs of ten words and more count.  A fingerprint carries the
hashes of the five words before and after it, which is as far as the windows around it reach, so texts
themselves are never joined.  Benchmark items of fewer than ten words are looked up whole.

Where the benchmark has at most FILTER_MAX fingerprints they go to the tasks as a filter before anything leaves
them, and the join is a broadcast one; beyond that the filter is left out and Spark shuffles both sides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts_of, stored, trimmed
from .words import ALNUM, gram_hashes, hashed_words

#: Words of a window, of a fingerprint, and fingerprint positions of a window.
SPAN, GRAM = 10, 5
REACH = SPAN - GRAM
#: Keys (8 bytes each) that may be sent to every task.
FILTER_MAX = 1_000_000
HIT = "array<struct<key:bigint,pos:bigint,words:int,context:array<bigint>>>"
HIT_ARROW = pa.list_(pa.struct([("key", pa.int64()), ("pos", pa.int64()), ("words", pa.int32()), ("context", pa.list_(pa.int64()))]))


def _minima(grams: np.ndarray) -> np.ndarray:
    """Positions that are least in some window of REACH + 1 positions."""
    n = len(grams) - REACH
    if n <= 0:
        return np.zeros(0, dtype=np.int64)
    least = grams[:n].copy()
    for j in range(1, REACH + 1):
        np.minimum(least, grams[j : j + n], out=least)
    chosen = np.zeros(len(grams), dtype=bool)
    for j in range(REACH + 1):
        chosen[j : j + n] |= grams[j : j + n] == least
    return np.flatnonzero(chosen)


def _among(keys: np.ndarray, wanted: np.ndarray | None) -> np.ndarray:
    if wanted is None:
        return np.ones(len(keys), dtype=bool)
    if not len(wanted):
        return np.zeros(len(keys), dtype=bool)
    return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys


def _short_key(hashes: np.ndarray, n: int) -> np.ndarray:
    return gram_hashes(hashes, n) ^ np.uint64(n * 0x1F3D5B79)


def _hits(words: np.ndarray, lengths: list[int], wanted: np.ndarray | None) -> list[dict]:
    """Fingerprints of one text and its runs of the given short lengths."""
    out = []
    grams = gram_hashes(words, GRAM)
    at = _minima(grams)
    at = at[_among(grams[at], wanted)]
    signed = words.view(np.int64)
    for p in at.tolist():
        lo, hi = p - REACH, p + GRAM + REACH
        context = [None] * max(0, -lo) + signed[max(0, lo) : hi].tolist() + [None] * max(0, hi - len(words))
        out.append({"key": int(grams[p].astype(np.int64)), "pos": p, "words": 0, "context": context})
    for n in lengths:
        keys = _short_key(words, n)
        for p in np.flatnonzero(_among(keys, wanted)).tolist():
            out.append({"key": int(keys[p].astype(np.int64)), "pos": p, "words": n, "context": None})
    return out


def _fingerprints(rows: DataFrame, lengths: list[int], wanted: np.ndarray | None, own_short: bool) -> DataFrame:
    """(docs, hits) of (id, text): docs are (id, n_words) of a text with hits, or of all texts of a group that have none.

    So the many texts without hits are few rows in what follows.  ``own_short``: short texts give one key, for themselves as a whole.
    """
    id_type = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            for first, hashes, offsets in hashed_words(batch.column(1).to_pylist(), ALNUM):
                n = len(offsets) - 1
                found = [[] for _ in range(n)]
                if wanted is None or own_short:
                    busy = range(n)
                elif lengths:
                    busy = range(n)
                else:  # texts without any wanted key need no closer look
                    at = np.flatnonzero(_among(gram_hashes(hashes, GRAM), wanted))
                    busy = np.unique(np.searchsorted(offsets, at, side="right") - 1).tolist()
                for i in busy:
                    words = hashes[offsets[i] : offsets[i + 1]]
                    own = ([len(words)] if 0 < len(words) < SPAN else []) if own_short else lengths
                    found[i] = _hits(words, own, wanted)
                alone = [i for i in range(n) if found[i]]
                rest = [i for i in range(n) if not found[i]]
                order, ends = np.array(alone + rest, dtype=np.int64), [*range(len(alone) + 1), *([n] if rest else [])]
                texts = pa.StructArray.from_arrays([keys.slice(first, n).take(pa.array(order)), pa.array(np.diff(offsets)[order], pa.int64())], ["id", "n_words"])
                hits = pa.array([found[i] for i in alone] + ([[]] if rest else []), HIT_ARROW)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts), hits], ["docs", "hits"])

    return rows.mapInArrow(trimmed(run), f"docs array<struct<id:{id_type},n_words:bigint>>, hits {HIT}")


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(key, words, context, items): fingerprints of the benchmark; items with the same words share one entry."""
    rows = benchmark.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    prints = _fingerprints(rows, [], None, own_short=True).select(F.explode("docs").alias("d"), "hits")
    same = prints.groupBy("hits", "d.n_words").agg(F.collect_set("d.id").alias("items"))
    return same.select("items", F.explode("hits").alias("h")).select("h.key", "h.words", "h.context", "items")


def _run(side: list[Column]) -> Column:
    """How many of the conditions hold in a row from the first on."""
    out = F.lit(0)
    for same in reversed(side):
        out = F.when(same, out + 1).otherwise(0)
    return out


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", filter_max: int = FILTER_MAX,
) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, spans, items.

    Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case.  A word is hit if it lies in an
    occurrence of ten consecutive words of an item, or of a whole item of fewer words.  spans are the hit
    ranges of words, [from, to), merged; items are the ids (as text, sorted) of items with an occurring window.  A null or empty
    text has no words; an item without words, or without id, is never listed.  Repeated rows give a row each,
    repeated items are each listed.  Whole texts are read, other columns are not; empty tables are fine.
    """
    windows = stored(parts_of(benchmark, benchmark_windows(benchmark, item_col, item_text)), "windows")
    size = windows.agg(F.count("*").alias("n"), F.collect_set("words").alias("words")).first()
    lengths = sorted(n for n in size["words"] if n)
    small = size["n"] <= filter_max
    wanted = None
    if small:
        wanted = np.unique(np.array([r["key"] for r in windows.select("key").collect()], dtype=np.int64).view(np.uint64))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    prints = _fingerprints(rows, lengths, wanted, own_short=False).withColumn("row", F.monotonically_increasing_id())
    each = prints.select("row", "docs", F.explode_outer("hits").alias("h"))
    # rows without a fingerprint get a key of their own, so that they do not meet in one task
    each = each.select("row", "docs", F.coalesce("h.key", F.xxhash64("row")).alias("key"), F.coalesce("h.words", F.lit(-1)).alias("words"), F.col("h.pos").alias("pos"), F.col("h.context").alias("near"))
    right = windows.select("key", "words", F.col("context").alias("item_near"), "items")
    met = each.join(F.broadcast(right) if small else right, ["key", "words"], "left")

    def same(i: int) -> Column:
        return F.coalesce(F.get("near", F.lit(i)) == F.get("item_near", F.lit(i)), F.lit(False))

    left = _run([same(REACH - 1 - j) for j in range(REACH)])
    right_ = _run([same(REACH + GRAM + j) for j in range(REACH)])
    core = F.lit(True)
    for i in range(REACH, REACH + GRAM):
        core = core & same(i)
    found = met.withColumn("l", left).withColumn("r", right_)
    long_hit = (F.col("words") == 0) & core & (F.col("l") + F.col("r") + GRAM >= SPAN)
    hit = F.col("items").isNotNull() & (long_hit | (F.col("words") > 0))
    span = F.struct(
        F.when(F.col("words") > 0, F.col("pos")).otherwise(F.col("pos") - F.col("l")).alias("from"),
        F.when(F.col("words") > 0, F.col("pos") + F.col("words")).otherwise(F.col("pos") + GRAM + F.col("r")).alias("to"),
    )
    grouped = found.groupBy("row", "docs").agg(
        F.collect_set(F.when(hit, span)).alias("found"), F.collect_set(F.when(hit, F.col("items"))).alias("sets"),
    )
    ordered = F.array_sort("found")
    merged = F.aggregate(
        ordered, F.expr("CAST(array() AS array<struct<from:bigint,to:bigint>>)"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["to"] >= x["from"]),
            F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["from"].alias("from"), F.greatest(F.element_at(acc, -1)["to"], x["to"]).alias("to")))),
        ).otherwise(F.concat(acc, F.array(F.struct(x["from"].cast("long").alias("from"), x["to"].cast("long").alias("to"))))),
    )
    grouped = grouped.select("docs", merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"))
    out = grouped.select(F.explode("docs").alias("d"), "spans", "items").select(F.col("d.id").alias("doc_id"), "d.n_words", "spans", "items")
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["to"] - x["from"])
    return out.select("doc_id", "n_words", total.alias("n_hit"), "spans", "items")


DECONTAMINATE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM bw
), dw AS (
  SELECT rid, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)
), hits AS (SELECT rid, i, n, item FROM dw JOIN bw USING (n, words)
), words AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS j FROM (SELECT DISTINCT rid, i, n FROM hits)) GROUP BY rid
), items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hits WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""
