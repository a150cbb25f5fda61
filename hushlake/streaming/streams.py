"""Structured Streaming forms of the event-driven operators.

The watermark and the gaps are parameters: the rules say how long a pause is, not how late
data may be.  Stateful operators keep bounded state per key (the last verdict, a capped log),
drop it after a key has been idle for ``idle_ms`` (for streams that keep running: a run over what is
there, ``availableNow``, would wait for the time-out), and rely on the query's checkpoint to survive lost
executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hushlake.operators import redact, spans, verify
from hushlake.operators.ordered import running_sliced
from hushlake.sources.scratch import shared_folder
from hushlake.streaming import sessions


def _expiry(idle_ms: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout


def detect_stream(stream: DataFrame, keys: list[str], text: str = "text", **options) -> DataFrame:
    """Spans of newly arriving rows; stateless, so it appends."""
    return spans.detect(stream, keys, text, **options)


def debounced(events: DataFrame, keys: list[str], ts: str, gap: str = "800 milliseconds", watermark: str = "10 minutes", latest: list[str] | None = None) -> DataFrame:
    """One row per burst of edits: the latest row of each session of at most ``gap`` between edits.

    Works on a stream and, without the watermark having an effect, on a table.
    """
    fields = [ts, *(latest or [])]
    windowed = events.withWatermark(ts, watermark) if events.isStreaming else events
    return windowed.groupBy(*keys, F.session_window(ts, gap).alias("session")).agg(
        F.max(F.struct(*fields)).alias("last"), F.count("*").alias("edits")
    ).select(*keys, F.col("session.start").alias("from"), "edits", *[F.col(f"last.{c}").alias(c) for c in fields])


def windowed_counts(detections: DataFrame, ts: str, window: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    rows = detections.withWatermark(ts, watermark) if detections.isStreaming else detections
    return rows.groupBy(F.window(ts, window).alias("w"), "type").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("from"), "type", "n"
    )


def changed_only(stream: DataFrame, key: str, hash_col: str, order: str, at: str | None = None, idle_ms: int | None = None) -> DataFrame:
    """Rows whose content hash differs from the last one seen for the key (see ``sessions``)."""
    return sessions.changed_rows(stream, key, hash_col, order, at, idle_ms)


def rolling_log(stream: DataFrame, key: str, order: str, value: str, size: int = 50, idle_ms: int | None = None) -> DataFrame:
    """Capped log per key, newest first, with a running total; state is at most ``size`` entries per key."""
    key_type = stream.schema[key].dataType.simpleString()

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        orders, values, total = (list(state.get[0]), list(state.get[1]), state.get[2]) if state.exists else ([], [], 0)
        entries = list(zip(orders, values))
        for pdf in batches:
            total += len(pdf)
            entries += list(zip(pdf[order].astype("int64"), pdf[value].astype(str)))
            entries = sorted(entries, reverse=True)[:size]
        state.update(([int(o) for o, _ in entries], [v for _, v in entries], total))
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({
            key: [k[0]] * len(entries), "rank": range(1, len(entries) + 1), "order": [int(o) for o, _ in entries],
            "value": [v for _, v in entries], "total": [total] * len(entries),
        })

    return stream.groupBy(key).applyInPandasWithState(
        run, f"{key} {key_type}, rank bigint, order bigint, value string, total bigint",
        "orders array<bigint>, vals array<string>, total bigint", "update", _expiry(idle_ms),
    )


def judge_edits(edits: DataFrame) -> DataFrame:
    """Row-local part of the send gate: detect, replace, verify.  Runs before any grouping, in the JVM.

    Adds ``redacted``, ``findings``, ``verified`` and the fingerprints of both texts.
    """
    from hushlake.functions.checks import fnv1a

    done = verify.residual_check(redact.redact_prompts(edits), "redacted", "spans")
    return done.select(
        *edits.columns, "redacted", F.size("spans").cast("long").alias("findings"), "verified",
        fnv1a(F.col("text")).alias("hash"), fnv1a(F.col("redacted")).alias("clean_hash"),
    )


def gate_verdict(judged: DataFrame) -> DataFrame:
    """State, permission and reason of each edit on its own (no later edit considered yet)."""
    empty = F.trim("text") == ""
    attached = F.col("attachment_state") == "VERIFIED"
    state = F.when(empty & attached, "READY").when(empty, "DISABLED").when(F.col("verified"), "READY").otherwise("FAILED")
    reason = (
        F.when(F.col("attachment_state").isin("FAILED", "PROCESSING"), "ATTACHMENT_BLOCKED")
        .when(empty & attached, "ATTACHMENT_ONLY").when(empty, "EMPTY").when(~F.col("verified"), "PLACEHOLDER_VERIFICATION_FAILED")
        .when(F.col("findings") > 0, "PRIVACY_VERIFIED").otherwise("NO_SENSITIVE_DATA")
    )
    return judged.withColumn("state", state).withColumn("reason", reason).withColumn(
        "allowed", F.col("reason").isin("ATTACHMENT_ONLY", "PRIVACY_VERIFIED", "NO_SENSITIVE_DATA")
    )


def send_gate(
    stream: DataFrame, key: str = "conv_id", order: str = "turn", scan: str = "scan_id", reset: str | None = None,
    at: str | None = None, late: str = "10 minutes", idle_ms: int | None = None,
) -> DataFrame:
    """Live send gate: every edit gets a verdict; results of older scans are dropped.

    The texts are judged before the shuffle, so only verdicts and fingerprints reach the
    keyed state, which is one scan number and one fingerprint per conversation.  ``reset`` names a column
    that marks navigations; with an event time ``at``, idle conversations expire on the watermark.
    """
    judged = gate_verdict(judge_edits(stream))
    return sessions.gate_rows(judged, key, order, scan, reset, at, late, idle_ms)


def send_gate_table(edits: DataFrame, key: str, order: str, scan: str, slice_: Column, reset: str | None = None) -> DataFrame:
    """The same verdicts for a table of edits, with windows in slices of a conversation's order.

    ``slice_`` must not decrease along ``order``.
    """
    judged = gate_verdict(judge_edits(edits)).withColumn("__mark", F.coalesce(F.col(reset), F.lit(False)) if reset else F.lit(False))
    slim = judged.select(key, order, scan, "__mark", *sessions.GATE_COLUMNS).withColumn("__slice", slice_)
    by = [order, scan]
    slim = running_sliced(slim, [key], by, F.col("__mark").cast("int"), "sum", F.col("__slice"), "__before")
    slim = slim.withColumn("__part", F.coalesce("__before", F.lit(0)) + F.col("__mark").cast("int")).drop("__before")
    parts = [key, "__part"]
    slim = running_sliced(slim, parts, by, F.when(~F.col("__mark"), F.col(scan)), "max", F.col("__slice"), "__newest")
    mark, stale = F.col("__mark"), F.coalesce(F.col(scan) < F.col("__newest"), F.lit(False))
    slim = slim.withColumn("__live", ~mark & ~stale)
    clean = F.when(F.col("__live"), F.struct(F.when(F.col("allowed"), F.col("clean_hash")).alias("h")))
    slim = running_sliced(slim, parts, by, clean, "last", F.col("__slice"), "__verified")
    live, known = F.col("__live"), F.col("__verified.h")
    return slim.select(
        key, F.col(order).cast("long").alias("turn"),
        F.when(mark, "IDLE").when(~live, "STALE").otherwise(F.col("state")).alias("state"),
        F.when(mark, "NAVIGATED").when(~live, "STALE_SCAN").otherwise(F.col("reason")).alias("reason"),
        (F.coalesce("allowed", F.lit(False)) & live).alias("allowed"),
        (live & F.coalesce(known != F.col("hash"), F.lit(False))).alias("relocked"),
    )


def run_to_table(stream: DataFrame, mode: str = "append", checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all data that is there and return its output as a table.

    Output and checkpoint are written below the shared checkpoint folder.  In update mode
    the caller picks the newest version of a row by ``batch``.
    """
    spark = stream.sparkSession
    base = shared_folder(spark, "run") if checkpoint is None else checkpoint.rstrip("/")
    out, ckpt = f"{base}/out", f"{base}/ckpt"

    def write(batch: DataFrame, batch_id: int) -> None:
        # Overwriting the folder of the batch makes a repeated batch harmless.
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{out}/part={batch_id}")

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(out).drop("part")


def read_stream(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A lake table as a stream of its files, be it one file or a folder of them."""
    folder = root.rstrip("/")
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # As a pattern the address may be that of one file too, which a stream takes only inside a folder.
    return spark.readStream.schema(schema).parquet(f"{folder}/{{{name}}}.parquet")
