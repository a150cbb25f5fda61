"""Per-batch merges into a table, repeatable without effect.

The table lies in a shared folder as generations: a batch rewrites only the partitions (hash ranges of the key) that its rows
touch, into a folder of its own number, and then notes them in a manifest.  A partition's rows are those of its
newest generation.  A batch reads generations before its own only and overwrites its own folder, so running
it again, or after a loss half-way, gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: (rows so far of the touched partitions, the batch) -> the rows that replace them.
Merge = Callable[[DataFrame, DataFrame], DataFrame]
_MANIFEST = "part int, gen long"


class GenerationTable:
    """A keyed table of ``parts`` partitions below ``base``."""

    def __init__(self, spark: SparkSession, base: str, schema: str, key: str, parts: int = 64):
        self.spark, self.base, self.schema, self.key, self.parts = spark, base.rstrip("/"), schema, key, parts

    def _part(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def _newest(self, before: int | None) -> dict[int, int]:
        """Newest generation of each partition; at most ``parts`` entries."""
        notes = self.spark.read.schema(_MANIFEST).json(f"{self.base}/manifest/*")
        if before is not None:
            notes = notes.filter(F.col("gen") < before)
        return {r["part"]: r["gen"] for r in notes.groupBy("part").agg(F.max("gen").alias("gen")).collect()}

    def _rows(self, newest: dict[int, int], only: set[int] | None = None) -> DataFrame:
        by_gen: dict[int, list[int]] = {}
        for part, gen in newest.items():
            if only is None or part in only:
                by_gen.setdefault(gen, []).append(part)
        if not by_gen:
            return self.spark.createDataFrame([], self.schema)
        wanted = F.lit(False)
        for gen, parts in by_gen.items():
            wanted = wanted | ((F.col("__gen") == gen) & F.col("__part").isin(parts))
        rows = self.spark.read.schema(f"{self.schema}, __gen long, __part int").option("basePath", f"{self.base}/data")
        return rows.parquet(*[f"{self.base}/data/__gen={g}" for g in sorted(by_gen)]).filter(wanted).drop("__gen", "__part")

    def _write(self, rows: DataFrame, gen: int, touched: set[int]) -> None:
        rows.withColumn("__part", self._part()).repartition("__part").write.mode("overwrite").partitionBy("__part").parquet(f"{self.base}/data/__gen={gen}")
        notes = self.spark.createDataFrame([(p, gen) for p in sorted(touched)], _MANIFEST)
        notes.coalesce(1).write.mode("overwrite").json(f"{self.base}/manifest/gen={gen}")

    def load(self, rows: DataFrame) -> None:
        """First contents: generation 0; batches are 1 and on."""
        self._write(rows, 0, set(range(self.parts)))

    def upsert(self, batch: DataFrame, batch_id: int, merge: Merge) -> None:
        """Merges one batch; ``batch`` and the result of ``merge`` carry the key, and ``merge`` works key by key."""
        batch = batch.persist()
        try:
            touched = {r["p"] for r in batch.select(self._part().alias("p")).distinct().collect()}
            if touched:
                self._write(merge(self._rows(self._newest(batch_id + 1), touched), batch), batch_id + 1, touched)
        finally:
            batch.unpersist()

    def current(self) -> DataFrame:
        return self._rows(self._newest(None))

    def merge_stream(self, stream: DataFrame, merge: Merge, checkpoint: str) -> None:
        """Runs ``upsert`` for everything that is there, batch by batch."""
        query = (
            stream.writeStream.foreachBatch(lambda batch, number: self.upsert(batch, number, merge))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        )
        query.awaitTermination()
