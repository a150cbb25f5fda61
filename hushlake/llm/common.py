"""What several operators share: the shared scratch folder, folds, bounded training samples."""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """This application's own folder below ``spark.checkpoint.dir``, which driver and executors share.

    Where the setting is missing (tests), a local temporary folder takes its place.  The folder goes when
    the application ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            base = tempfile.mkdtemp(prefix="hushlake-")
            spark.conf.set("spark.checkpoint.dir", base)
        _ROOTS[app] = f"{base.rstrip('/')}/hushlake-{uuid.uuid4().hex}"
        atexit.register(_remove, spark, _ROOTS[app])
    return _ROOTS[app]


def _remove(spark: SparkSession, folder: str) -> None:
    """Deletes the folder through Hadoop's file system, if the session still lives."""
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the gateway is gone: the cluster's own clean-up has the folder
        return


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: a cut in the lineage that survives lost executors.

    ``options`` go to the writer.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def parts_of(source: DataFrame, df: DataFrame) -> DataFrame:
    """``df`` in no more partitions than ``source``, a table as it is read.  For results that are smaller than their source.

    A partition costs a task and a file.  Without Hadoop's native library an executor starts a process for each file, and until it
    runs, that process counts as another one of the executor's size.
    """
    return df.coalesce(max(1, source.rdd.getNumPartitions()))


def discard(*frames: DataFrame) -> None:
    """Deletes tables made by ``stored``.  Only for those that nothing will read again, lost executors or not."""
    for df in frames:
        _remove(df.sparkSession, df.stored_path)


def give_back() -> None:
    """Returns memory that finished tasks have freed to the system; a worker is kept from task to task."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: it has its own ways
        return


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same step of ``mapInArrow`` in a worker that holds no more than it needs, before and after."""

    def wrapped(batches: Iterator) -> Iterator:
        give_back()
        yield from run(batches)
        give_back()

    return wrapped


#: Values (8 bytes each, some fifty in a hash table) that may be broadcast.
BROADCAST_VALUES = 1_000_000


def bounded(df: DataFrame, values: Column | int = 1) -> DataFrame:
    """Marks a stored table for broadcast if it holds at most BROADCAST_VALUES values; else Spark joins it as it sees fit.

    ``values`` counts the values of a row.
    """
    size = df.agg(F.sum(F.lit(values) if isinstance(values, int) else values).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= BROADCAST_VALUES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case and nothing else, whatever the locale."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as the text ''."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit(""))), F.lit(parts).cast("long"))


def _share(doc_id: Column, seed: int) -> Column:
    """A fixed pseudo-random number from 0 to 1 per id."""
    return F.pmod(F.xxhash64(doc_id.cast("string"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_bytes: int, seed: int = 7,
) -> tuple[list[tuple[str, object]], dict]:
    """At most about ``per_class`` whole texts for each label value, as (text, label) in a fixed order; and how many
    labelled ids each value has in all.

    ``labels`` (doc_id, label) holds the rows that may be learned from.  Rows without id, label or text are
    left out, and so are texts of more than ``max_bytes`` bytes: the sample is at most
    per_class * max_bytes bytes for each value, usually a few per cent of that.  A doc_id with several labels counts once, by the
    largest.  Only the ids are drawn first; then the documents are joined to that bounded list.
    """
    known = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
        .groupBy("doc_id").agg(F.max(label).alias("label"))
    )
    sizes = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    rate = F.lit(0.0)
    for value, n in sizes.items():
        rate = F.when(F.col("label") == value, F.lit(per_class / max(n, 1))).otherwise(rate)
    drawn = known.filter(_share(F.col("doc_id"), seed) < rate)
    rows = (
        docs.select("doc_id", "text").filter(F.octet_length("text") <= max_bytes)
        .join(F.broadcast(drawn), "doc_id").collect()
    )
    first = {(r["doc_id"], r["text"]): r["label"] for r in rows}
    return [(text, first[key, text]) for key, text in sorted(first, key=str)], sizes
