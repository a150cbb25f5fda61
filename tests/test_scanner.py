"""The plain Python form of the prompt rules against the expressions of the engine."""

import random
import time

import pytest
from pyspark.sql import functions as F

from hushlake.operators import redact, spans, verify
from hushlake.sources.derived import SQL, derive

HEX = "0123456789abcdef0123456789abcdef"
PIECES = [
    "mail a.b+c@ex-ample.co.uk", "x@y", "(415) 555-0100", "+91 9876543210", "98765432101", "4111 1111 1111 1111", "4111-1111 1111-1112", "123-45-6789",
    "A12345678", "2345 6789 0123", "123456789012", "234567890124", "ABCDE1234F", "HDFC0123456", "sk" + "-proj-" + HEX, "sk" + "-ant-" + HEX, "gh" + "p_" + HEX,
    "AI" + "za" + HEX, "ey" + "J" + HEX + "." + HEX, "mongodb+srv://u:p%40@h.example.net:27017/d", "POSTGRES://svc:pw@10.0.0.1/x,", "mysql://r:t@h/s;", "redis://:p@c:6379/0",
    "AK" + "IA" + "ABCDEFGHIJKLMNOP", "AccountName=store;AccountKey=" + HEX, "sb" + "p_" + HEX, 'apiKey: "' + HEX + '"', "sk" + "_live_" + HEX, "rz" + "p_test_" + HEX,
    "My password is Hunter22!", 'pwd: "s3cret99".', "Pass = YOUR_PASSWORD1", "password: ......", "Zx9!abcdQ", "abcdefgh1!", "secret_key='" + HEX + "'", "Bearer " + HEX + ".;:",
    "Authorization: Bearer " + HEX, "-----BEGIN RSA PRI" + "VATE KEY-----\nx\n-----END RSA PRI" + "VATE KEY-----", "jdbc:mysql://db/x?user=a,", "sqlite://f.", "next.js react",
    "NEXT_PUBLIC_MAPS_KEY=", "DB_URL = \"", "export STRIPE_SECRET_KEY='", "token_name = ", "api_key:", "the token", "Key secreſ", HEX, HEX + " :", HEX + "=", "your_email", "[EMAIL]",
    "ab_cd=", "é", "😀", "İ", " ", "\u0085", "\x0b", "　", "\x01", "\"", "'", ".", ",", "\n", "\r\n", "\t", "  ", "",
]


def samples(n: int, seed: int) -> list:
    rng = random.Random(seed)
    mixed = ["".join(rng.choice(PIECES) + rng.choice(["", "", " ", " ", "\n", ", "]) for _ in range(rng.randint(1, 9))) for _ in range(n)]
    return [None, "", "\u0000", *PIECES, *(p + p for p in PIECES), *mixed, " ".join(PIECES) * 4]


@pytest.mark.parametrize("types, style", [(None, "prompt"), (["EMAIL", "API_KEY", "PHONE"], "bracket"), ([], "prompt"), (["PASSWORD", "DATABASE_URL"], "type")])
def test_both_forms_of_redaction_agree(spark, types, style):
    df = spark.createDataFrame([(i % 50, t) for i, t in enumerate(samples(1500, 9))], "id int, text string")
    found = redact.with_resolved(spans.with_spans(df, "text", "__raw", prompt_rules=True, types=types), "__raw", "s")
    want = redact.with_placeholders(found, "text", "s", "m", style)
    want = want.withColumn("r", redact.once(redact.splice("text", "s", "m")))
    both = spans.with_spans(redact.redact_prompts(want, style=style, types=types), "redacted", "again", prompt_rules=True)
    rows = verify.residual_check(both, "redacted", "spans").collect()
    wrong = [r for r in rows if (r.spans, r.placeholders, r.redacted, r.residuals) != (r.s, r.m, r.r, len(r.again))]
    assert not wrong, wrong[:2]
    assert not types or sum(len(r.spans) for r in rows) > 300


def test_texts_that_are_not_utf8(spark):
    df = spark.sql("select cast(x'61ff20626f6240782e6f7267' as string) as text union all select cast(x'ff' as string)")
    done = verify.residual_check(redact.redact_prompts(df), "redacted", "spans").collect()
    assert [(len(r.spans), r.verified) for r in done] == [(1, True), (0, True)] and "bob@x.org" not in done[0].redacted


def test_one_row_group_is_scanned_by_many_tasks(spark, tmp_path):
    """Documents and orders in one file each."""
    spark.range(2000).selectExpr("id AS doc_id", "concat('mail a', id, '@b.example.com') AS text", "'en' AS lang").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(2000).selectExpr("id AS o_orderkey", "'1-URGENT' AS o_orderpriority").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    corpus = derive(spark, str(tmp_path), "corpus")
    tasks = corpus.groupBy(F.spark_partition_id().alias("p"), (F.col("doc_id") < 1_000_000_000).alias("doc")).count().collect()
    assert sum(r["count"] for r in tasks) == 4000
    for doc in (True, False):
        some = [r["count"] for r in tasks if r["doc"] == doc]
        assert len(some) >= 8 and max(some) <= 500


def test_short_texts_cost_less_than_their_expressions(spark):
    """Redacting and scanning again takes less than 0.8 of the time that the two scans alone take as expressions of the engine."""
    orders = spark.range(0, 40_000, 1, 4).selectExpr("id AS o_orderkey", "'1-URGENT' AS o_orderpriority")
    notes = spark.sql(SQL["notes"], orders=orders).localCheckpoint()
    done = verify.residual_check(redact.redact_prompts(notes), "redacted", "spans").select("doc_id", "originals_left", "residuals", "verified")
    scanned = spans.with_spans(spans.with_spans(notes, prompt_rules=True), out="again", prompt_rules=True).select("spans", "again")

    def took(df) -> float:
        start = time.monotonic()
        df.write.format("noop").mode("overwrite").save()
        return time.monotonic() - start

    times = [(took(done), took(scanned)) for _ in range(2)]
    assert min(t[0] for t in times) < 0.8 * min(t[1] for t in times), times
