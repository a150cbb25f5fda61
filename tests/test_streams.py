"""Stateful streams on hand-made logs and against their batch forms."""

import random

import pytest
from pyspark.sql import functions as F

from hushlake.operators import dedupe, reports
from hushlake.streaming import sessions, streams, upserts

SCHEMA = "conv_id long, turn long, scan_id long, text string, attachment_state string, reset boolean"
EDITS = [
    (1, 0, 2, "mail a@b.example.com", "NONE", False, ("READY", "PRIVACY_VERIFIED", True, False)),
    (1, 1, 1, "older scan", "NONE", False, ("STALE", "STALE_SCAN", False, False)),
    (1, 2, 3, "mail [EMAIL]", "NONE", False, ("READY", "NO_SENSITIVE_DATA", True, False)),
    (1, 3, 4, "mail [EMAIL] and more", "NONE", False, ("READY", "NO_SENSITIVE_DATA", True, True)),
    (1, 4, 5, " ", "NONE", False, ("DISABLED", "EMPTY", False, True)),
    (2, 0, 0, "", "VERIFIED", False, ("READY", "ATTACHMENT_ONLY", True, False)),
    (3, 0, 0, "fine", "FAILED", False, ("READY", "ATTACHMENT_BLOCKED", False, False)),
    (4, 0, 9, "first page", "NONE", None, ("READY", "NO_SENSITIVE_DATA", True, False)),
    (4, 1, 0, "", "NONE", True, ("IDLE", "NAVIGATED", False, False)),
    (4, 2, 1, "second page", "NONE", False, ("READY", "NO_SENSITIVE_DATA", True, False)),
    (4, 3, 0, "late", "NONE", False, ("STALE", "STALE_SCAN", False, False)),
]


def in_batches(spark, rows, schema, folder, size):
    """A stream that takes one file of ``size`` rows at a time."""
    for i in range(0, len(rows), size):
        spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def verdicts(df):
    return {(r["conv_id"], r["turn"]): (r["state"], r["reason"], r["allowed"], r["relocked"]) for r in df.collect()}


@pytest.mark.parametrize("size", [100, 2])
def test_send_gate_lifecycle(spark, tmp_path, size):
    live = streams.send_gate(in_batches(spark, [e[:6] for e in EDITS], SCHEMA, str(tmp_path / "edits"), size), reset="reset")
    out = streams.run_to_table(live, checkpoint=str(tmp_path / "run"))
    assert verdicts(out) == {(e[0], e[1]): e[6] for e in EDITS}


def test_send_gate_equals_its_table_form(spark, tmp_path, monkeypatch):
    """A hot conversation of several pieces, scans out of order, resets; in one batch and in many."""
    rng = random.Random(7)
    rows = [(0 if i % 3 else i % 5, i, rng.randint(0, i // 4 + 2), rng.choice(["a", "b c", "mail x@y.example.com", " ", ""]), rng.choice(["NONE", "VERIFIED", "FAILED"]), rng.random() < 0.06) for i in range(300)]
    table = spark.createDataFrame(rows, SCHEMA)
    want = verdicts(streams.send_gate_table(table, "conv_id", "turn", "scan_id", F.floor(F.col("turn") / 16), "reset"))
    assert len(want) == 300 and len({v[0] for v in want.values()}) == 4
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    monkeypatch.setattr(sessions, "SLICE", 32)
    try:
        for size in (300, 70):
            live = streams.send_gate(in_batches(spark, rows, SCHEMA, str(tmp_path / f"e{size}"), size), reset="reset")
            assert verdicts(streams.run_to_table(live, checkpoint=str(tmp_path / f"r{size}"))) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("size", [400, 90])
def test_tab_rows_equal_the_batch_form(spark, tmp_path, size):
    rng = random.Random(3)
    rows = [(rng.randint(0, 5), i // 2, i, rng.random() < 0.05) for i in range(400)]
    rng.shuffle(rows)  # late rows of all kinds
    schema = "tab long, at long, id long, nav boolean"
    want = reports.after_last_navigation(spark.createDataFrame(rows, schema), "tab", ["at", "id"], F.col("nav")).select("tab", "at", "id")
    live = sessions.tab_rows(in_batches(spark, rows, schema, str(tmp_path / "in"), size), "tab", ["at", "id"], "nav")
    out = streams.run_to_table(live, checkpoint=str(tmp_path / "run"))
    got = sessions.current_rows(out, "tab", ["at", "id"]).select("tab", "at", "id")
    assert sorted(got.collect()) == sorted(want.collect()) and want.count() > 20


def test_state_expires_on_event_time(spark, tmp_path):
    """Tab 1 is silent for hours while tab 2 goes on: its rows expire with the watermark, not with the clock."""
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    rows = [(1, 0, 0, False, start), (1, 1, 1, False, start + dt.timedelta(minutes=1))]
    rows += [(2, 2 + i, 2 + i, False, start + dt.timedelta(hours=i)) for i in range(6)] + [(1, 50, 50, False, start + dt.timedelta(hours=6))]
    schema = "tab long, at long, id long, nav boolean, ts timestamp"
    live = sessions.tab_rows(in_batches(spark, rows, schema, str(tmp_path / "in"), 1), "tab", ["at", "id"], "nav", "ts", "1 minute", 2 * 3600 * 1000)
    out = streams.run_to_table(live, checkpoint=str(tmp_path / "run"))
    gone = [(r["tab"], r["id"]) for r in out.filter("kind = 'expired'").collect()]
    assert (1, 1) in gone
    left = sorted((r["tab"], r["id"]) for r in sessions.current_rows(out, "tab", ["at", "id"]).collect())
    assert (1, 50) in left and not any(t == 1 and i < 50 for t, i in left)


def merge_pages(fresh):
    def merge(before, batch):
        pages = batch.select("page_id").distinct()
        new = fresh.join(pages, "page_id", "left_semi")
        return dedupe.merge_incremental(before, new, batch, "page_id")

    return merge


def test_batches_merge_once(spark, tmp_path):
    schema = "page_id long, ord long, type string, value string, path string"
    old = [(p, i, "EMAIL", f"v{p}-{i}", f"/b/d[{i % 3}]/p[{i}]") for p in range(40) for i in range(5)]
    new = [(p, i, "EMAIL", f"n{p}-{i}", f"/b/d[1]/p[{i}]") for p in range(40) for i in (7, 8)] + [(3, 9, "EMAIL", "v3-0", "/b/d[1]/p[9]")]
    roots = [(p, "/b/d[1]") for p in range(0, 40, 3)]
    before, fresh = spark.createDataFrame(old, schema), spark.createDataFrame(new, schema)
    table = upserts.GenerationTable(spark, str(tmp_path / "table"), schema, "page_id", 8)
    table.load(before)
    merge = merge_pages(fresh)
    stream = in_batches(spark, roots, "page_id long, root string", str(tmp_path / "roots"), 4)
    table.merge_stream(stream, merge, str(tmp_path / "ckpt"))
    changed = spark.createDataFrame(roots, "page_id long, root string")
    columns = ["page_id", "ord", "type", "value", "path"]
    want = sorted(dedupe.merge_incremental(before, fresh.join(changed, "page_id", "left_semi"), changed, "page_id").select(columns).collect())
    assert sorted(table.current().select(columns).collect()) == want
    # a batch that runs again changes nothing, be it the last one or one before
    table.upsert(spark.createDataFrame(roots[-2:], "page_id long, root string"), 3, merge)
    assert sorted(table.current().select(columns).collect()) == want
    touched = table._newest(None)
    assert len(set(touched.values())) > 1  # partitions without changes keep their generation
    table.upsert(changed.limit(0), 9, merge)
    assert table._newest(None) == touched


@pytest.mark.parametrize("parts", [1, 3])
@pytest.mark.parametrize("folder", [False, True])
def test_stream_of_a_table_in_one_file_or_a_folder(spark, tmp_path, folder, parts):
    at = tmp_path / "lake"
    rows = [(i, f"mail u{i}@example.com") for i in range(9)]
    written = str(at / "conversations.parquet") if folder else str(tmp_path / "once")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(parts if folder else 1).write.parquet(written)
    if not folder:
        at.mkdir()
        (one,) = (tmp_path / "once").glob("part-*.parquet")
        (at / "conversations.parquet").write_bytes(one.read_bytes())
    spark.createDataFrame([(100, "other")], "doc_id long, text string").write.parquet(str(at / "conversations2.parquet"))
    live = streams.read_stream(spark, f"file:{at}", "conversations")
    assert sorted(map(tuple, streams.run_to_table(live).drop("batch").collect())) == rows


def test_stream_merge_makes_its_rows_once(spark, tmp_path, monkeypatch):
    from hushlake.plans import screens

    spark.range(1, 21).select(F.col("id").alias("o_orderkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    made = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda v: (made.add(1), v)[1], "string").asNondeterministic()
    old = spark.range(1, 21).select(
        F.col("id").alias("page_id"), F.lit(2).cast("long").alias("ord"), F.lit("EMAIL").alias("type"),
        counted(F.concat(F.lit("v"), "id")).alias("value"), F.lit("/html/body/div[3]/p[2]").alias("path"),
    )
    monkeypatch.setattr(screens, "_items_at", lambda spark, root: old)
    got = {(r["page_id"], r["value"]) for r in screens.stream_merge(spark, str(tmp_path)).collect()}
    assert got == {(i, f"v{i}-new") for i in range(1, 21)} | {(i, f"v{i}") for i in range(1, 21) if i % 4 != 2}
    assert made.value == 20
