"""Exact ranked search with geometric blocking of posting lists.

A document is a vector with one coordinate per term, a query a vector of repeats, and a score their inner product.
Documents are dealt into shards of bounded size.  Within a shard each term's posting list is clustered by the
similarity of its documents (on random projections of their vectors), and each cluster is a block with a summary: the
largest value of every coordinate in it.  The inner product of a query and a summary is no less than the score of any
document in the block, so a block is skipped only when that bound is below the score that the query's last place
needs.  A query's terms have an order, largest values first, and a document is looked for in the list of the first term
that it holds; so the bound of a block needs the coordinates from its own term on only, and lists of
frequent terms are seldom opened.  Values in summaries are rounded up to 255 steps per coordinate, so bounds hold exactly, in
whole numbers.  Lists of a few documents have no summary; the largest values in the shard bound them.

The index holds the terms of a block of queries, whose number of terms is bounded; larger query sets are
answered block by block.  All rows are indexed, and every row of the index is one shard, so the search is
row-local: a task carries the bars from shard to shard and gives back at most ``k`` documents for each query.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .words import ALNUM, hashed_words

#: Distinct terms that a block of queries may have, unless a single query has more.
BLOCK_TERMS = 8192
#: Documents times terms of a shard: the cells of its largest table in memory, one byte each.
CELLS = 1 << 22
SHARD_DOCS = 1024
#: Aim for documents in a block; lists of at most LIST_LEAST documents are always scored.
PER_BLOCK, LIST_LEAST = 128, 32
AXES = 16
#: A row of the index has some two MB: groups of rows are closed by size, so writers and readers hold 16 MB of them.
_SMALL_GROUPS = {"parquet.block.size": str(16 << 20), "parquet.page.size.row.check.min": "2"}

_INDEX = (
    "ids array<{id}>, lengths array<bigint>, starts array<int>, terms array<int>, counts array<int>, "
    "short_term array<int>, short_start array<int>, short_docs array<int>, "
    "block_term array<int>, block_start array<int>, block_docs array<int>, steps array<bigint>, summaries binary"
)


def _counted(texts: list[str | None], vocabulary: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(words, terms, counts) of each text, over a sorted vocabulary of word hashes."""
    size = len(vocabulary)
    for _, hashes, offsets in hashed_words(texts, ALNUM):
        at = np.minimum(np.searchsorted(vocabulary, hashes), max(size - 1, 0))
        known = np.flatnonzero(vocabulary[at] == hashes) if size else np.zeros(0, dtype=np.int64)
        doc = np.searchsorted(offsets, known, side="right") - 1
        keys, counts = np.unique(doc * max(size, 1) + at[known], return_counts=True)
        cuts = np.searchsorted(keys, np.arange(len(offsets)) * max(size, 1))
        for i, n in enumerate(np.diff(offsets).tolist()):
            part = slice(cuts[i], cuts[i + 1])
            yield n, (keys[part] - i * size).astype(np.int32), counts[part].astype(np.int32)


def query_terms(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n, hashes, counts) of each query with its distinct terms.

    Rows that are equal count once; different texts under one id are one query of all their terms.
    """
    rows = queries.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text IS NOT NULL").distinct()
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for _, hashes, offsets in hashed_words(batch.column(1).to_pylist(), ALNUM):
                found += [hashes[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            lists = pa.array([h.view(np.int64) for h in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["id", "term"])

    terms = rows.mapInArrow(run, f"id {kind}, term array<bigint>").select("id", F.explode("term").alias("term"))
    each = terms.groupBy("id", "term").agg(F.count("*").alias("repeats"))
    return each.groupBy("id").agg(F.count("*").alias("n"), F.collect_list(F.struct("term", "repeats")).alias("terms"))


def _blocks_of(queries: DataFrame, most: int) -> list[list]:
    """Queries in blocks of at most ``most`` distinct terms (or one query), without gathering more than a block at once."""
    parts, total = 1, queries.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total // most))
    out = []
    place = F.pmod(F.xxhash64("id"), F.lit(parts))
    for part in range(parts):
        block, seen = [], set()
        for r in queries.filter(place == part).toLocalIterator():
            terms = {t["term"]: t["repeats"] for t in r["terms"]}
            if block and len(seen | terms.keys()) > most:
                out.append(block)
                block, seen = [], set()
            block.append((r["id"], terms))
            seen |= terms.keys()
        if block:
            out.append(block)
    return out


def term_vectors(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(id, n, terms, counts): words of each whole text, and the terms of the vocabulary in it."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, terms, counts = [], [], []
            for words, t, c in _counted(batch.column(1).to_pylist(), vocabulary):
                n.append(words)
                terms.append(t)
                counts.append(c)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32()))],
                ["id", "n", "terms", "counts"],
            )

    return rows.mapInArrow(run, f"id {kind}, n long, terms array<int>, counts array<int>")


def weights(vectors: DataFrame, size: int) -> tuple[np.ndarray, int, int]:
    """Weight of each term, documents with a term, and terms with repeats, over all rows."""
    n, length = vectors.filter("n > 0").agg(F.count("*"), F.sum("n")).first()
    df = np.zeros(size, dtype=np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("c")).collect():
        df[r["t"]] = r["c"]
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for c in df.tolist()], dtype=np.int64), n, length or 1


def impacts(w: np.ndarray, terms: np.ndarray, counts: np.ndarray, lengths: np.ndarray, n: int, length: int) -> np.ndarray:
    """What each term of a document adds to the score of a query that has it once; ``lengths`` are the documents' words."""
    m = 25 + 75 * lengths * n // length
    return w[terms] * (1_000_000_000 * counts // (1000 * counts + 8 * m))


def _positions(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the entries of some rows of a table of ragged rows, and where each row begins among them."""
    sizes = starts[rows + 1] - starts[rows]
    first = np.concatenate([[0], np.cumsum(sizes)])
    return np.repeat(starts[rows] - first[:-1], sizes) + np.arange(first[-1]), first


def _clustered(docs: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """A posting list as clusters of similar documents: the nearest of a few of its own documents, spread along an axis."""
    k = -(-len(docs) // PER_BLOCK)
    if k == 1:
        return [docs]
    own = place[docs]
    chosen = np.argsort(own[:, 0], kind="stable")[np.linspace(0, len(docs) - 1, 2 * k + 1).astype(int)[1::2]]
    nearest = (own @ own[chosen].T).argmax(axis=1)
    order = np.argsort(nearest, kind="stable")
    cuts = np.flatnonzero(np.diff(nearest[order])) + 1
    return [np.sort(part) for part in np.split(docs[order], cuts)]


def _shard(rows: list[tuple], w: np.ndarray, n: int, length: int, axes: np.ndarray) -> tuple:
    """One row of the index from the vectors of some documents."""
    ids, lengths = [r[0] for r in rows], np.array([r[1] for r in rows], dtype=np.int64)
    sizes = np.array([len(r[2]) for r in rows])
    starts = np.concatenate([[0], np.cumsum(sizes)])
    terms, counts = np.concatenate([r[2] for r in rows]), np.concatenate([r[3] for r in rows])
    doc = np.repeat(np.arange(len(rows)), sizes)
    value = impacts(w, terms, counts.astype(np.int64), lengths[doc], n, length)

    most = np.zeros(len(w), dtype=np.int64)
    np.maximum.at(most, terms, value)
    steps = np.maximum(1, -(-most // 255))
    table = np.zeros((len(rows), len(w)), dtype=np.uint8)
    table[doc, terms] = -(-value // steps[terms])  # rounded up: a summary never promises too little

    place = np.zeros((len(rows), AXES), dtype=np.float32)
    full = np.flatnonzero(sizes)
    if len(full):
        place[full] = np.add.reduceat(axes[terms] * value[:, None].astype(np.float32), starts[full], axis=0)
    place /= np.maximum(np.linalg.norm(place, axis=1, keepdims=True), 1e-30)

    order = np.argsort(terms, kind="stable")
    lists = np.split(doc[order], np.flatnonzero(np.diff(terms[order])) + 1) if len(terms) else []
    names = np.unique(terms)
    short, blocks = [], []
    for t, docs in zip(names.tolist(), lists):
        if len(docs) <= LIST_LEAST:
            short.append((t, docs))
        else:
            blocks += [(t, part) for part in _clustered(docs, place)]
    summaries = np.zeros((len(blocks), len(w)), dtype=np.uint8)
    for i, (_, part) in enumerate(blocks):
        table[part].max(axis=0, out=summaries[i])
    out = [ids, lengths, starts, terms, counts]
    for group in (short, blocks):
        out += [[t for t, _ in group], np.cumsum([0, *(len(p) for _, p in group)]), np.concatenate([p for _, p in group]) if group else []]
    return (*out, steps, zlib.compress(summaries.tobytes(), 1))


def build_index(vectors: DataFrame, w: np.ndarray, n: int, length: int) -> DataFrame:
    """Shards of the rows of ``vectors``, all of them."""
    kind = vectors.schema["id"].dataType.simpleString()
    size = max(1, min(SHARD_DOCS, CELLS // max(1, len(w))))
    axes = np.random.default_rng(20240607).standard_normal((len(w), AXES)).astype(np.float32)
    schema = _INDEX.format(id=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        types = None

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in zip(_shard(rows, w, n, length, axes), types)], names)

        names = [c.split()[0] for c in schema.split(", ")]
        for batch in batches:
            whole, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
            types = [pa.list_(batch.column(0).type), whole, *[ints] * 9, whole, pa.binary()]
            ids, lengths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            columns = [(c.values.to_numpy(zero_copy_only=False), c.offsets.to_numpy()) for c in (batch.column(2), batch.column(3))]
            (terms, at), (counts, _) = columns
            for i, (key, words) in enumerate(zip(ids, lengths)):
                held.append((key, words, terms[at[i] : at[i + 1]], counts[at[i] : at[i + 1]]))
                if len(held) == size:
                    yield packed(held)
                    held = []
            held = [(a, b, c.copy(), d.copy()) for a, b, c, d in held]  # lets the batch go
        if held:
            yield packed(held)

    return vectors.filter("n > 0").mapInArrow(run, schema)


class _Best:
    """The best documents of one query so far: highest score first, then lowest id, nulls last."""

    def __init__(self, k: int):
        self.k, self.rows = k, []

    @property
    def bar(self) -> int:
        """Least score that may still enter."""
        return max(1, -self.rows[-1][0]) if len(self.rows) == self.k else 1

    def add(self, ids: list, docs: np.ndarray, scores: np.ndarray) -> None:
        good = np.flatnonzero(scores >= self.bar)
        if not len(good):
            return
        if len(good) > 4 * self.k:  # as many as share the last place stay in
            least = np.partition(scores[good], len(good) - self.k)[len(good) - self.k]
            good = good[scores[good] >= least]
        new = [(-s, ids[i] is None, 0 if ids[i] is None else ids[i]) for i, s in zip(docs[good].tolist(), scores[good].tolist())]
        self.rows = sorted(self.rows + new)[: self.k]


def _held(term: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the terms ``own`` in a table sorted by term, and which of ``own`` each belongs to."""
    low, high = np.searchsorted(term, own), np.searchsorted(term, own, side="right")
    which = np.repeat(np.arange(len(own)), high - low)
    return np.arange(len(which)) + np.repeat(low - np.concatenate([[0], np.cumsum(high - low)[:-1]]), high - low), which


def _search_shard(row: dict, queries: list[tuple[np.ndarray, np.ndarray]], best: list[_Best], w: np.ndarray, n: int, length: int) -> tuple[int, int]:
    """Takes a shard into account for every query; (blocks looked at, blocks skipped)."""
    ids, lengths = row["ids"], np.array(row["lengths"], dtype=np.int64)
    starts, terms, counts = (np.array(row[c], dtype=np.int64) for c in ("starts", "terms", "counts"))
    doc = np.repeat(np.arange(len(ids)), np.diff(starts))
    value = np.zeros((len(w), len(ids)), dtype=np.int64)
    value[terms, doc] = impacts(w, terms, counts, lengths[doc], n, length)
    short = [np.array(row[c], dtype=np.int64) for c in ("short_term", "short_start", "short_docs")]
    block = [np.array(row[c], dtype=np.int64) for c in ("block_term", "block_start", "block_docs")]
    steps = np.array(row["steps"], dtype=np.int64)
    summaries = np.frombuffer(zlib.decompress(row["summaries"]), dtype=np.uint8).reshape(len(block[0]), len(w))
    looked = skipped = 0
    for (own, repeats), top in zip(queries, best):
        order = np.argsort(-repeats * steps[own], kind="stable")
        own, repeats = own[order], repeats[order]
        step = repeats * steps[own]
        rest = np.cumsum(255 * step[::-1])[::-1]  # no document without the terms before has more than this
        rows, which = _held(short[0], own)
        blocks, term = _held(block[0], own)
        tail = np.where(np.arange(len(own)) >= term[:, None], summaries[np.ix_(blocks, own)], 0) @ step
        lists = [(short, rows, rest[which]), (block, blocks, tail)]
        done = np.zeros(len(ids), dtype=bool)
        for (_, first, docs), rows, bound in lists:
            order = np.argsort(-bound, kind="stable")
            rows, bound, i, size = rows[order], bound[order], 0, 8
            while i < len(rows) and bound[i] >= top.bar:
                upto = min(i + size, int(np.searchsorted(-bound, -top.bar, side="right")))
                fresh = np.zeros(len(ids), dtype=bool)
                fresh[docs[_positions(first, rows[i:upto])[0]]] = True
                new = np.flatnonzero(fresh & ~done)
                done[new] = True
                if len(new):
                    top.add(ids, new, repeats @ value[np.ix_(own, new)])
                i, size = upto, size * 3
        looked, skipped = looked + len(blocks), skipped + len(rows) - i
    return looked, skipped


def search_index(index: DataFrame, block: list, vocabulary: np.ndarray, w: np.ndarray, n: int, length: int, k: int, query_type: str) -> DataFrame:
    """(query, id, score): of every task's shards the ``k`` best documents for each query of the block."""
    kind = index.schema["ids"].dataType.elementType.simpleString()
    queries = []
    for _, terms in block:
        own = np.searchsorted(vocabulary, np.array(list(terms), dtype=np.int64).view(np.uint64))
        queries.append((own, np.array(list(terms.values()), dtype=np.int64)))
    names = [name for name, _ in block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in names]
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(j)[i].as_py() if c in ("ids", "summaries") else batch.column(j)[i].values.to_numpy(zero_copy_only=False) for j, c in enumerate(batch.schema.names)}
                _search_shard(row, queries, best, w, n, length)
        rows = [(name, None if null else key, -score) for name, top in zip(names, best) for score, null, key in top.rows]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(fields)], [f.name for f in fields])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = f"query {query_type}, id {kind}, score long"
    fields = list(to_arrow_schema(StructType.fromDDL(schema)))
    return index.mapInArrow(run, schema)


def ranked_search(
    docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text",
    query_id: str = "item_id", query_text: str = "text", block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """One row per query and place: query id, rank (from 1), document id, score; at most ``k`` a query, scores above 0.

    Terms are runs of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case, from whole texts;
    a term is known by a hash of 64 bits.  A query's terms count as often as they occur.  Equal scores rank by id, null ids
    last; repeated rows are documents of their own.  Null texts have no terms.  Equal query rows count once,
    different texts under one query id are one query; a query without terms has no rows, and so have empty tables.
    Other columns are not read.
    """
    spark = docs.sparkSession
    kinds = queries.schema[query_id].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    out = spark.createDataFrame([], f"query {kinds[0]}, id {kinds[1]}, score long")
    for block in _blocks_of(stored(query_terms(queries, query_id, query_text), "queries"), block_terms):
        vocabulary = np.unique(np.array([t for _, terms in block for t in terms], dtype=np.int64).view(np.uint64))
        vectors = stored(term_vectors(docs, vocabulary, id_col, text_col), "vectors")
        w, n, length = weights(vectors, len(vocabulary))
        index = stored(build_index(vectors, w, n, length), "index", **_SMALL_GROUPS)
        out = out.union(search_index(index, block, vocabulary, w, n, length, k, kinds[0]))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last()))
    ranked = out.withColumn("rank", place).filter(F.col("rank") <= k)
    return ranked.select(F.col("query").alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")


SEARCH_SQL = r"""
WITH d AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM documents
), q AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), tf AS (SELECT doc_id, t, count(*) AS tf FROM d GROUP BY 1, 2
), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY 1
), c AS (SELECT count(*) AS n, sum(n)::BIGINT AS l FROM n
), w AS (SELECT t, floor(1000 * ln((2 * c.n + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, c GROUP BY t, c.n
), v AS (
  SELECT tf.doc_id, tf.t, w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * n.n * c.n) // c.l))) AS v
  FROM tf JOIN n USING (doc_id) JOIN w USING (t), c
), s AS (
  SELECT item_id, doc_id, sum(r * v)::BIGINT AS score FROM (SELECT item_id, t, count(*) AS r FROM q GROUP BY 1, 2) JOIN v USING (t) GROUP BY 1, 2
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY rank <= 10
"""
