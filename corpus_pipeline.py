"""From raw documents to packed training sequences: five stages, each written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushlake.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from hushlake.llm.common import bounded, fold, stored, table
from hushlake.llm.queries import tokenizer_path

#: A document with this score or more is toxic.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject.  Rows without text or id are scored like any other."""
    labels = table(spark, sf_dir, "labels").filter(fold("doc_id", 4) != 2)
    model = toxicity.fit_toxicity(docs, labels)
    return docs.filter(toxicity.toxicity_score(model, F.col("text")) < TOXIC)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that recur across them; n_chars follows the text."""
    cleaned = line_dedup.drop_recurring_lines(docs).select(*docs.columns)
    if "n_chars" not in docs.columns:
        return cleaned
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links connect, the one with the smallest id.

    Texts link when they share 80 per cent of their shingles of five words; op7's own numbers belong to that query only.
    Documents without words stay.  Decisions belong to id and text together: rows that share an id, or have none, are
    told apart by their texts, and of repeated rows one stays.
    """
    names = {"id": "__near_id", "t1": "__near_1", "t2": "__near_2"}  # no column of the documents is called so
    keys = list(names.values())
    one, two = ngram_join.text_key(F.col("text"))
    keyed = docs.withColumns({"__near_id": F.struct(F.col("doc_id").alias("v")), "__near_1": one, "__near_2": two})
    others, repeated = (
        df.withColumn("id", F.struct(F.col("id").alias("v"))).withColumnsRenamed(names) for df in ngram_join.near_duplicates(docs, words=5, percent=80)
    )
    others, repeated = stored(others, "others"), stored(repeated, "repeated")
    kept = keyed.join(bounded(others, 3), keys, "left_anti")
    single = kept.join(bounded(repeated, 3), keys, "left_anti")
    once = kept.join(bounded(repeated, 3), keys, "left_semi").dropDuplicates(keys)
    return single.unionByName(once).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with the benchmark.  The decision belongs to the text, so ids don't matter."""
    key = F.struct(F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), "text").alias("k2"))
    keyed = docs.select(key.alias("key"), "text")
    found = decontaminate.find_contamination(keyed, table(spark, sf_dir, "benchmark"), id_col="key")
    leaks = stored(found.filter("n_hit > 0").select(F.col("doc_id").alias("__key")).distinct(), "leaks")
    return docs.withColumn("__key", key).join(bounded(leaks, 2), "__key", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences with their token ids."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]
#: The first stage is a learned model and the last needs a tokenizer's vocabulary: SQL has neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
