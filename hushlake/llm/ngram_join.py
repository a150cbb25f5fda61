"""Similarity join on word shingles by parity sketches.

A document's shingles are dealt into parts by their hash, and every shingle flips one of 64 bits of its part.  Sets of
sizes a <= b with Jaccard similarity t differ in at most d = a * (1 - t) / t members, so of P parts at least P - d hold equal
sets.  The number of parts belongs to a size band; a document takes part in its own band and in the next lower one,
where smaller partners are.  A part's key is its parity word together with the exclusive or of its shingles' hashes, so
parts of unlike sets do not agree by chance.  Documents that agree in a part are candidates; before their
shingles are compared, parity sketches of the whole sets (a bit for each shingle or more) are: their Hamming distance is
no more than the symmetric difference, so candidates that are too far apart fall without a look at their texts.

There are more parts than needed: s = P - d agreements are certain, and one is enough.  So a document may leave out its s - 1
most frequent keys: of s agreeing keys, the rarest has s - 1 more frequent ones beside it in both documents, and is left out
by neither.  Empty parts count as the most frequent; they are left out where there are fewer than s of them.  Passages that
many documents share thus make no large groups, and nothing is lost.

Documents with equal sets are one class.  Within a group of candidates each class is first compared with one member
only, the one that shares most parts with others.  Where that left several components in a group, classes outside
its largest component are compared with those of other components.  Classes that a chain of links joins already are not
compared again, so the work follows the number of documents and not the square of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, discard, stored, trimmed
from .components import connected_components
from .words import NON_SPACE, gram_hashes, hashed_words, mix

#: Least binary logarithm of a whole set's sketch.
LEAST_LEVEL = 7


def band_edges(percent: int, limit: int = 1 << 40) -> np.ndarray:
    """First sizes of the bands; a partner of a set in one band lies in that band or the next."""
    edges = [1]
    while edges[-1] < limit:
        edges.append(max(edges[-1] + 1, (edges[-1] - 1) * 100 // percent + 1))
    return np.array(edges, dtype=np.int64)


def _differ(edges: np.ndarray, band: int, percent: int) -> int:
    """Members in which linked sets of a band can differ."""
    return int((edges[band + 1] - 1) * (100 - percent) // percent)


def _spare(differ: int) -> int:
    """Agreements that are certain: more than a document usually has empty parts."""
    return 2 + -(-differ * 8 // 100)


def _keys(shingles: np.ndarray, band: int, differ: int) -> tuple[np.ndarray, int]:
    """Keys of the parts of a set in one band, and how many more of them may be left out."""
    spare = _spare(differ)
    parts = differ + spare
    where = ((mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(16)) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    placed, held = shingles[order], where[order]
    first = np.flatnonzero(np.concatenate([[True], held[1:] != held[:-1]]))
    full = held[first]
    words = np.bitwise_xor.reduceat(np.uint64(1) << (placed & np.uint64(63)), first)
    sums = np.bitwise_xor.reduceat(mix(placed ^ np.uint64(0x6A09E667F3BCC909)), first)
    place = mix(np.arange(parts, dtype=np.uint64) + np.uint64(band << 40))
    keys = mix(mix(words) ^ sums ^ place[full])
    empty = parts - len(full)
    if empty < spare:
        return keys, spare - 1 - empty
    blank = np.ones(parts, dtype=bool)
    blank[full] = False
    return np.concatenate([keys, mix(place[blank])]), spare - 1


def _whole(shingles: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Level and parities of the whole set in 2**level bits, and the same folded to half as many."""
    level = max(LEAST_LEVEL, int(len(shingles) - 1).bit_length())
    at = (mix(shingles ^ np.uint64(0x3C6EF372FE94F82B)) >> np.uint64(4)).astype(np.int64)

    def parity(bits: int) -> np.ndarray:
        odd = np.bincount(at & (bits - 1), minlength=bits) & 1
        return np.packbits(odd.astype(bool), bitorder="little").view("<i8")

    return level, parity(1 << level), parity(1 << (level - 1))


def _sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """Distinct shingle hashes of each text, sorted."""
    for _, hashes, offsets in hashed_words(texts, NON_SPACE):
        grams = gram_hashes(hashes, words)
        for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            n = end - start
            if n >= words:
                yield np.unique(grams[start : end - words + 1])
            elif n:
                yield gram_hashes(hashes[start:end], n)
            else:
                yield np.zeros(0, dtype=np.uint64)


def _digest(s: np.ndarray) -> tuple[int, int, int]:
    """Size and 128 bits that stand for a set."""
    if not len(s):
        return 0, 0, 0
    return len(s), int(np.bitwise_xor.reduce(s).astype(np.int64)), int(mix(s).sum(dtype=np.uint64).astype(np.int64))


_SKETCH = "struct<level:int,bits:array<bigint>,half:array<bigint>>"


def _signatures(rows: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, t1, t2, n, s1, s2, sketch, bands): 128 bits for the set, its sketch, and the keys of the bands it takes part in."""
    id_type = rows.schema["id"].dataType.simpleString()
    edges = band_edges(percent)
    longs = pa.list_(pa.int64())
    band_type = pa.list_(pa.struct([("allow", pa.int32()), ("band", pa.int32()), ("keys", longs)]))
    sketch_type = pa.struct([("level", pa.int32()), ("bits", longs), ("half", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sketches, bands = [], [], []
            for s in _sets(batch.column(3).to_pylist(), words):
                digests.append(_digest(s))
                level, bits, half = _whole(s)
                sketches.append({"level": level, "bits": bits, "half": half} if len(s) else None)
                band = int(np.searchsorted(edges, len(s), side="right")) - 1
                own = []
                for b in (band - 1, band):
                    if len(s) and b >= 0 and (differ := _differ(edges, b, percent)) > 0:
                        keys, allow = _keys(s, b, differ)
                        own.append({"allow": allow, "band": b, "keys": keys.view(np.int64)})
                bands.append(own)
            n, one, two = (pa.array([d[i] for d in digests], pa.int64()) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], n, one, two, pa.array(sketches, sketch_type), pa.array(bands, band_type)],
                ["id", "t1", "t2", "n", "s1", "s2", "sketch", "bands"],
            )

    schema = f"id {id_type}, t1 long, t2 long, n long, s1 long, s2 long, sketch {_SKETCH}, bands array<struct<allow:int,band:int,keys:array<bigint>>>"
    return rows.select("id", "t1", "t2", "text").mapInArrow(trimmed(run), schema)


def _shingles(texts: DataFrame, words: int) -> DataFrame:
    """(n, s1, s2, shingles) of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(_sets(batch.column(0).to_pylist(), words))
            digests = [_digest(s) for s in sets]
            columns = [pa.array([d[i] for d in digests], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["n", "s1", "s2", "shingles"])

    return texts.mapInArrow(trimmed(run), "n long, s1 long, s2 long, shingles array<bigint>")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The (a, b) of the stored ``pairs`` (a, b: classes) that are similar enough on their shingles."""
    ends = pairs.select(F.col("a").alias("s")).union(pairs.select("b")).distinct()
    wanted = stored(classes.join(ends, "s", "left_semi").select("s", "text.t1", "text.t2"), "wanted")
    chosen = texts.select("t1", "t2", "text").join(bounded(wanted.select("t1", "t2").distinct(), 2), ["t1", "t2"], "left_semi")
    found = _shingles(chosen.select("text"), words).withColumn("s", F.xxhash64("n", "s1", "s2"))
    sets = stored(found.select("s", "shingles").dropDuplicates(["s"]), "sets")
    left = sets.select(F.col("s").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("s").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y")).cast("long")
    both = pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", shared.alias("shared"), (F.size("x") + F.size("y")).cast("long").alias("all"))
    links = stored(both.filter(F.col("shared") * 100 >= (F.col("all") - F.col("shared")) * percent).select("a", "b"), "links")
    discard(wanted, sets)
    return links


def _close(percent: int, n: Column, m: Column, x: Column, y: Column) -> Column:
    """Whether sizes and whole sketches allow two sets to be linked."""
    fits = F.least(n, m) * 100 >= F.greatest(n, m) * percent
    one = F.when(x["level"] <= y["level"], x["bits"]).otherwise(x["half"])
    two = F.when(y["level"] <= x["level"], y["bits"]).otherwise(y["half"])
    apart = F.aggregate(F.zip_with(one, two, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda a, b: a + b)
    near = (F.abs(x["level"] - y["level"]) > 1) | (apart * (100 + percent) <= (n + m) * (100 - percent))
    return fits & near


def text_key(text: Column) -> list[Column]:
    """128 bits of a text, as two numbers."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _linked(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(signatures of all rows, (s, component) of the classes of sets that have links); s is a class, and so is a component."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *text_key(F.col(text_col)))
    rows = stored(_signatures(texts, words, percent), "signatures")
    # any text of a class may speak for it
    classes = stored(
        rows.filter("n > 0").groupBy("n", "s1", "s2").agg(F.min(F.struct("t1", "t2")).alias("text"), F.first("sketch").alias("sketch"))
        .select(F.xxhash64("n", "s1", "s2").alias("s"), "n", "text", "sketch"), "classes",
    )
    members = stored(_members(rows), "members")
    known = classes.select("s", "n", "sketch")

    def pairs_of(found: DataFrame) -> DataFrame:
        """(a, b) of those pairs of classes (s, t) whose sizes and sketches allow a link."""
        one = known.select("s", F.col("n").alias("na"), F.col("sketch").alias("x"))
        two = known.select(F.col("s").alias("t"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
        out = found.select(F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).distinct().join(one, "s").join(two, "t")
        return out.filter(_close(percent, F.col("na"), F.col("nb"), F.col("x"), F.col("y"))).select(F.col("s").alias("a"), F.col("t").alias("b"))

    stars = stored(pairs_of(members.filter("s <> pivot").select("s", F.col("pivot").alias("t"))), "stars")
    links = _verified(stars, classes, texts, words, percent)
    labels = connected_components(links)
    apart = stored(_apart(members, known, labels, percent).select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct(), "apart")
    rest = stored(apart.join(stars, ["a", "b"], "left_anti"), "rest")
    more = _verified(rest, classes, texts, words, percent)
    discard(members, stars, apart, rest)
    if not more.isEmpty():
        labels = connected_components(links.union(more))
    discard(links, more, classes)
    return rows, labels.select(F.col("node").alias("s"), "component")


def _grouped(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(id, t1, t2, n, group) of every row; rows that links connect share a group, empty sets have none."""
    rows, labels = _linked(docs, id_col, text_col, words, percent)
    slim = rows.select("id", "t1", "t2", "n", F.when(F.col("n") > 0, F.xxhash64("n", "s1", "s2")).alias("s"))
    return slim.join(labels, "s", "left").select("id", "t1", "t2", "n", F.coalesce("component", "s").alias("group"))


def shingle_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, percent: int = 90,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    A text's words are runs of anything but the six ASCII white space characters, A-Z in lower case; its set holds its
    distinct shingles of ``words`` words, or all its words as one if there are fewer.  Texts link when they share
    ``percent`` per cent of their union or more.  component_id is the smallest id that links lead to, the row's own
    included.  A null text, or one without words, has an empty set and links with nothing, not even its equal.
    Sets are told apart by 128 bits of their own, not by ids: rows that share an id, or have none, are compared like
    any other.  A row without id shows the smallest id of its group, or null.  Other columns are not read; empty
    tables give no rows.
    """
    rows = stored(_grouped(docs, id_col, text_col, words, percent), "groups")
    least = rows.filter("group IS NOT NULL").groupBy("group").agg(F.min("id").alias("least"))
    return rows.join(least, "group", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("group").isNull(), F.col("id")).otherwise(F.col("least")).alias("component_id"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Which rows a deduplication drops, by id and text key: (id, t1, t2) to drop, and those of which one row of several stays.

    Of each group the row with the smallest id stays (null ids last, then by the text's key).  Rows without words stay.
    """
    rows = stored(_grouped(docs, id_col, text_col, words, percent).filter("group IS NOT NULL"), "groups")
    key = F.struct(F.col("id").isNull().alias("unknown"), "id", "t1", "t2")
    each = stored(rows.groupBy("group", "id", "t1", "t2").agg(F.count("*").alias("rows")), "each")
    first = each.groupBy("group").agg(F.min(key).alias("first"), F.count("*").alias("texts"))
    marked = stored(each.join(first.filter("texts > 1"), "group", "left").select("id", "t1", "t2", "rows", F.coalesce(key != F.col("first"), F.lit(False)).alias("drop")), "marked")
    discard(rows, each)
    return marked.filter("drop").select("id", "t1", "t2"), marked.filter("NOT drop AND rows > 1").select("id", "t1", "t2")


def _members(rows: DataFrame) -> DataFrame:
    """(key, s, pivot): classes of each part key that several classes have, and the class to compare them with first."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(key, s, tag) of each class once a batch; the tag holds the band and how many keys may be left out."""
        for batch in batches:
            names, firsts = np.unique(batch.column(0).to_numpy(), return_index=True)
            chosen = batch.take(pa.array(firsts)).column(1)
            inner = chosen.flatten()
            keys = inner.field("keys")
            tags = inner.field("band").to_numpy().astype(np.int32) * 65536 + np.minimum(inner.field("allow").to_numpy(), 65535).astype(np.int32)
            per_band = np.asarray(pa.compute.list_value_length(keys))
            per_class = np.asarray(pa.compute.list_value_length(chosen))
            tags, of_band = np.repeat(tags, per_band), np.repeat(names, per_class)
            yield pa.RecordBatch.from_arrays([keys.flatten(), pa.array(np.repeat(of_band, per_band)), pa.array(tags)], ["key", "s", "tag"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows sorted by key and class: those of keys that several classes have, each once; holds one row back at most."""
        key = s = None  # the last row seen
        tag, told = 0, False  # its tag, and whether it has gone out
        for batch in batches:
            k, v, t = (batch.column(i).to_numpy() for i in range(3))
            if not len(k):
                continue
            if key is not None:
                k, v, t = np.concatenate([[key], k]), np.concatenate([[s], v]), np.concatenate([[tag], t])
            new = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])
            k, v, t = k[new], v[new], t[new]
            same = k[1:] == k[:-1]
            out = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            before = told and len(k) > 0 and key is not None
            key, s, tag, told = k[-1], v[-1], t[-1], bool(out[-1]) or (before and len(k) == 1)
            if before:
                out[0] = False
            yield pa.RecordBatch.from_arrays([pa.array(k[out]), pa.array(v[out]), pa.array(t[out].astype(np.int32))], ["key", "s", "tag"])

    schema = "key long, s long, tag int"
    each = rows.filter("n > 0").select(F.xxhash64("n", "s1", "s2").alias("s"), "bands").mapInArrow(trimmed(deal), schema)
    found = stored(each.repartition("key").sortWithinPartitions("key", "s").mapInArrow(trimmed(met), schema), "found")
    # a class leaves out its most frequent keys, as many as it may
    sizes = found.groupBy("key").agg(F.count("*").alias("size"))
    rank = F.row_number().over(Window.partitionBy("s", "tag").orderBy(F.col("size").desc(), "key"))
    kept = found.join(sizes, "key").withColumn("rank", rank).filter(F.col("rank") > F.pmod("tag", F.lit(65536))).select("key", "s", "size")
    kept = stored(kept, "kept")
    several = kept.groupBy("key").agg(F.count("*").alias("left")).filter("left > 1").select("key")
    kept = kept.join(several, "key")
    shares = kept.groupBy("s").agg(F.sum("size").alias("share"))
    pivots = kept.join(shares, "s").groupBy("key").agg(F.max_by("s", F.struct("share", "s")).alias("pivot"))
    return kept.select("key", "s").join(pivots, "key")


def _apart(members: DataFrame, known: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes (s, t) in one group but in different components, with sizes and sketches close enough."""
    placed = members.join(known, "s").join(labels, members.s == labels.node, "left").select("key", "s", "n", "sketch", F.coalesce("component", "s").alias("component"))
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("size"))
    mixed = parts.groupBy("key").agg(F.max_by("component", "size").alias("main"), F.count("*").alias("parts")).filter("parts > 1").select("key", "main")
    open_ = stored(placed.join(mixed, "key"), "open")
    x = open_.filter("component <> main").select("key", "s", "n", F.col("sketch").alias("x"), "component")
    y = open_.select("key", F.col("s").alias("t"), F.col("n").alias("m"), F.col("sketch").alias("y"), F.col("component").alias("other"), (F.col("component") == F.col("main")).alias("inside"))
    once = F.col("inside") | (F.col("s") < F.col("t"))
    close = _close(percent, F.col("n"), F.col("m"), F.col("x"), F.col("y"))
    return x.join(y, "key").filter((F.col("component") != F.col("other")) & once & close).select("s", "t").distinct()


JOIN_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS s FROM d
), e AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM s
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, min(a.n) + min(b.n) AS total FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM p WHERE 100 * shared >= 90 * (total - shared)
), lk AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (SELECT doc_id AS a, doc_id AS b FROM s UNION SELECT r.a, lk.b FROM r JOIN lk ON r.b = lk.a)
SELECT s.doc_id, len(s.s) AS n_shingles, least(s.doc_id, (SELECT min(b) FROM r WHERE r.a = s.doc_id)) AS component_id FROM s
"""
