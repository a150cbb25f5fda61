"""Line dedup with a fixed-depth log-template tree, in DataFrame functions only.

A line's path in the tree is its number of tokens, then its three leading tokens (tokens with a digit count as
``<*>``), then a leaf.  Leaves are templates: the whole masked line, and for lines of nine tokens and more three
templates that each leave one third of the remaining tokens open, so lines that differ in one such
field meet in one leaf.  Lines with a recurring template are dropped wherever they stand.

A template recurs when enough independent texts hold it.  A line is shared if enough texts hold one of its templates, or its
beginning; a text is independent if a good part of its tokens stands in lines that are not shared.  Copies of a document,
edited or not, consist of shared lines, so all of them together count as one text: their body stays and is left to document dedup,
and they neither make a template recur nor hide one that does.

Only hashes of lines are grouped.  The corpus statistics cover every line of every text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, stored

#: Leading tokens on a line's path.
DEPTH = 3
#: Lines from this many tokens on also get templates with an open field.
OPEN_FROM = 9
#: Leading tokens by which an edited line is known as one of a copy.
BEGINNING = 5
#: More than a line's tokens.
WIDEST = 1 << 31
SPACE = r"[ \t\n\x0B\f\r]+"
VARIABLE = r"[^0-9 \t\n\x0B\f\r]*+[0-9][^ \t\n\x0B\f\r]*+"
#: Lines without these have no variable fields and only spaces between tokens.
SPECIAL = r"[0-9\t\x0B\f\r]"


def _tokens(line: Column) -> Column:
    masked = F.split(F.regexp_replace(line, VARIABLE, "<*>"), SPACE)
    return F.filter(F.when(line.rlike(SPECIAL), masked).otherwise(F.split(line, " ")), lambda t: t != "")


def _path(t: Column, pos: Column) -> Column:
    """Position, leaf-level path and hashes of the lead, the beginning and the three thirds of one line, from its tokens."""
    n = F.size(t)
    step = F.ceil((n - DEPTH) / 3).cast("int")
    thirds = [F.xxhash64(F.slice(t, F.lit(DEPTH + 1) + step * k, step)) for k in range(3)]
    return F.struct(
        pos.alias("pos"), n.alias("n"), F.xxhash64(n, F.slice(t, 1, DEPTH)).alias("path"),
        F.when(n >= OPEN_FROM, F.array(*thirds, F.xxhash64(F.lit(4), F.slice(t, 1, BEGINNING)))).otherwise(F.array(F.xxhash64(t))).alias("rest"),
    )


def _keys(x: Column) -> Column:
    """Keys of a line: all of it, and of a long one with each third left out; last its beginning, which is no template."""
    full = F.xxhash64(F.lit(0), x["path"], F.slice(x["rest"], 1, 3))
    out = [F.xxhash64(F.lit(k + 1), x["path"], *[x["rest"][j] for j in range(3) if j != k]) for k in range(3)]
    return F.when(x["n"] >= OPEN_FROM, F.array(full, *out, x["rest"][3])).otherwise(F.array(full))


def line_templates(texts: Column, min_tokens: int) -> Column:
    """Array of (pos, n, keys) of a text's lines of at least ``min_tokens`` tokens."""
    tokens = F.filter(F.transform(F.split(texts, "\n", -1), lambda line, i: F.struct(i.alias("pos"), _tokens(line).alias("t"))), lambda x: F.size(x["t"]) >= min_tokens)
    paths = F.transform(tokens, lambda x: _path(x["t"], x["pos"]))
    return F.transform(paths, lambda x: F.struct(x["pos"].alias("pos"), x["n"].alias("n"), _keys(x).alias("keys")))


def _key(text: Column) -> list[Column]:
    """128 bits that stand for a text; rows with one text share their decisions."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]


def shared_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """One row per text that has shared lines: (k1, k2, total, hits), from (k1, k2, total, line).

    A hit (pos, n, key, leaf) is a key of a line that at least ``min_docs`` texts hold; ``leaf`` says that it is a template.
    """
    keys = lines.select("k1", "k2", "total", "line.pos", "line.n", F.posexplode("line.keys").alias("at", "key"))
    held = keys.select("k1", "key").distinct().groupBy("key").agg(F.count("*").alias("texts")).filter(F.col("texts") >= min_docs)
    hits = keys.join(stored(held.select("key"), "held").hint("merge"), "key")  # too many to broadcast at size, so never
    hit = F.struct("pos", "n", "key", (F.col("at") < 4).alias("leaf"))
    return hits.groupBy("k1", "k2").agg(F.max("total").alias("total"), F.collect_set(hit).alias("hits"))


def recurring_templates(shared: DataFrame, min_docs: int, min_own: float, short_tokens: int, short_docs: int) -> DataFrame:
    """Keys of recurring templates, from the table of ``shared_lines``."""
    places = F.array_distinct(F.transform("hits", lambda h: h["pos"].cast("long") * WIDEST + h["n"]))  # numbers, as structs are compared pair by pair
    tokens = F.aggregate(places, F.lit(0).cast("long"), lambda a, x: a + x % WIDEST)
    leaves = [
        F.transform(F.array_distinct(F.transform(F.filter("hits", lambda h: h["leaf"] & ((h["n"] < short_tokens) == F.lit(short))), lambda h: h["key"])),
                    lambda key: F.struct(key.alias("key"), F.lit(short).alias("short")))  # noqa: B023
        for short in (False, True)
    ]
    alone = (F.col("total") - tokens >= F.col("total") * min_own).cast("int")
    texts = shared.select(alone.alias("alone"), F.concat(*leaves).alias("leaves"))  # before the explosion: once a text, not once a leaf
    each = texts.select("alone", F.explode("leaves").alias("leaf")).select("alone", "leaf.key", "leaf.short")
    counts = each.groupBy("key").agg((F.sum("alone") + F.max(1 - F.col("alone"))).alias("texts"), F.max("short").alias("short"))
    return counts.filter(F.col("texts") >= F.when(F.col("short"), short_docs).otherwise(min_docs)).select("key")


def drop_recurring_lines(
    docs: DataFrame, text_col: str = "text", min_docs: int = 3, min_own: float = 0.25,
    min_tokens: int = 2, short_tokens: int = 4, short_docs: int = 50,
) -> DataFrame:
    """``docs`` with recurring lines taken out of ``text_col``, plus n_lines and n_dropped.

    A template recurs when at least ``min_docs`` independent texts hold it.  A text is independent if lines that fewer than
    ``min_docs`` texts share hold at least ``min_own`` of its tokens; all other texts that hold the template count as one.  Lines of
    fewer than ``short_tokens`` tokens also meet by chance, so they need ``short_docs`` texts; lines of fewer than
    ``min_tokens`` tokens always stay and count for nothing.  None of these numbers depends on the size of the table.

    Lines end at a line feed.  Every row of the input is kept with all its columns, whatever their names; rows with
    one text get one result and count as one text.  A null text stays null with 0 lines, an empty one has 1 line; a text whose
    lines all recur becomes empty.  Very long texts are only bounded by the row.  An empty table stays empty.
    """
    texts = docs.select(F.col(text_col).alias("text")).filter("text IS NOT NULL")
    found = stored(texts.select(*_key(F.col("text")), line_templates(F.col("text"), min_tokens).alias("lines")).filter("size(lines) > 0"), "lines")
    total = F.aggregate("lines", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    lines = found.select("k1", "k2", total.alias("total"), "lines").select("k1", "k2", "total", F.explode("lines").alias("line"))
    shared = stored(shared_lines(lines, min_docs), "shared")
    bad = stored(recurring_templates(shared, min_docs, min_own, short_tokens, short_docs), "templates")
    hits = shared.select("k1", "k2", F.explode("hits").alias("hit")).filter("hit.leaf").select("k1", "k2", "hit.pos", "hit.key").join(bad, "key")
    drops = bounded(stored(hits.groupBy("k1", "k2").agg(F.collect_set("pos").alias("__drop")), "drops"), F.size("__drop") + 2)
    k1, k2 = _key(docs[text_col])
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("__row"), docs[text_col].alias("__text"), k1, k2)
    joined = whole.join(drops, ["k1", "k2"], "left")
    kept = F.array_join(
        F.filter(F.split("__text", "\n", -1), lambda line, i: ~F.array_contains("__drop", i)), "\n",
    )
    text = F.when(F.col("__drop").isNull(), F.col("__text")).otherwise(kept)
    return joined.select(
        *[(text if c == text_col else F.col(f"__row.`{c}`")).alias(c) for c in docs.columns],
        F.when(F.col("__text").isNull(), 0).otherwise(F.size(F.split("__text", "\n", -1))).cast("long").alias("n_lines"),
        F.when(F.col("__drop").isNull(), 0).otherwise(F.size("__drop")).cast("long").alias("n_dropped"),
    )


LINE_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, text, string_split(text, chr(10)) AS raw FROM documents
), l AS (
  SELECT rid, text, unnest(raw) AS line, unnest(range(len(raw))) AS pos FROM d WHERE text IS NOT NULL
), t AS (
  SELECT rid, text, pos, list_filter(regexp_split_to_array(regexp_replace(line, '[^ \t\n\x0B\f\r]*[0-9][^ \t\n\x0B\f\r]*', '<*>', 'g'), '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS t FROM l
), c AS (
  SELECT rid, text, pos, t, len(t) AS n, CAST(ceil((len(t) - 3) / 3.0) AS BIGINT) AS step, sum(len(t)) OVER (PARTITION BY rid) AS total
  FROM t WHERE len(t) >= 2
), k AS (
  SELECT rid, text, pos, n, total, unnest(CASE WHEN n >= 9 THEN [
    '0 ' || array_to_string(t, ' '),
    '1 ' || n || ' ' || array_to_string(t[1:3], ' ') || '|' || array_to_string(t[4 + step:], ' '),
    '2 ' || n || ' ' || array_to_string(t[1:3 + step], ' ') || '|' || array_to_string(t[4 + 2 * step:], ' '),
    '3 ' || n || ' ' || array_to_string(t[1:3 + 2 * step], ' ') || '|' || array_to_string(t[4 + 3 * step:], ' '),
    '4 ' || array_to_string(t[1:5], ' ')]
    ELSE ['0 ' || array_to_string(t, ' ')] END) AS key
  FROM c
), held AS (SELECT key FROM k GROUP BY key HAVING count(DISTINCT text) >= 3
), hits AS (SELECT k.* FROM k JOIN held USING (key)
), lone AS (
  SELECT rid, max(total) - sum(n) >= 0.25 * max(total) AS alone FROM (SELECT DISTINCT rid, pos, n, total FROM hits) GROUP BY rid
), bad AS (
  SELECT key FROM hits JOIN lone USING (rid) WHERE key[1] <> '4' GROUP BY key
  HAVING count(DISTINCT CASE WHEN alone THEN text END) + max(CASE WHEN alone THEN 0 ELSE 1 END) >= CASE WHEN min(n) >= 4 THEN 3 ELSE 50 END
), drops AS (SELECT rid, list(DISTINCT pos) AS drops FROM k JOIN bad USING (key) GROUP BY rid)
SELECT doc_id, CAST(coalesce(len(raw), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(drops), 0) AS BIGINT) AS n_dropped,
  sha256(CASE WHEN drops IS NULL THEN text ELSE array_to_string(list_filter(raw, lambda x, i: NOT list_contains(drops, i - 1)), chr(10)) END) AS text_sha256
FROM d LEFT JOIN drops USING (rid)
"""
