"""Every named query against DuckDB on the smallest data, and streams against their batch forms."""

import decimal

import duckdb
import pytest

from hushlake.plans import ORACLES, QUERIES
from hushlake.sources.files import screen_cases, write_reports

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def norm(v):
    return round(float(v), 9) if isinstance(v, (float, decimal.Decimal)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    assert got, "a query without rows checks nothing"
    if name not in ORACLES:
        return
    rel = duck.execute(ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    want = sorted((tuple(norm(r[i]) for i in order) for r in rel.fetchall()), key=str)
    assert got == want


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_debounce_on_a_stream(spark, tmp_path):
    from pyspark.sql import functions as F

    from hushlake.streaming import streams

    events = streams.read_stream(spark, SF, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    live = streams.run_to_table(streams.debounced(events, ["user_id"], "ts", "6 hours", "1 hour", ["event_id"]), checkpoint=str(tmp_path))
    batch = QUERIES["debounce_sessions"](spark, SF).withColumn("ts", F.col("ts").cast("timestamp"))
    keys = ["user_id", "edits", "event_id"]
    # Append mode emits a session once the watermark has passed it; the last ones stay open.
    assert live.count() > 0 and live.select(*keys).subtract(batch.select(*keys)).count() == 0


def test_case_files_and_report_sink(spark, tmp_path):
    screen = tmp_path / "screens.json"
    screen.write_text('[{"scenarioId": "s", "url": "https://e.example.com", "elements": [{"id": "a", "tagName": "INPUT",'
                      ' "boundingBox": {"x": 1, "y": 2, "width": 3, "height": 4}, "isSensitive": true, "isActionable": true}]}]')
    row = screen_cases(spark, str(screen)).first()
    assert (row["id"], row["width"], row["sensitive"]) == ("a", 3.0, True)
    out = str(tmp_path / "reports")
    write_reports(spark.createDataFrame([("h.example.com", 1)], "website string, total long"), out)
    assert spark.read.json(out).filter("website = 'h.example.com'").count() == 1
