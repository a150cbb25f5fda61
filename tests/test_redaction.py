"""Golden prompts and properties of redaction and verification."""

import pytest
from pyspark.sql import functions as F

from hushlake.functions import placeholders as P
from hushlake.operators import redact, spans, verify

GOLDEN = [
    ("Reach me at ann@mail.example.com please", "Reach me at [EMAIL] please"),
    ("My password is Tr0ub4dor! ok", "My password is [PASSWORD] ok"),
    ("Call 9876543210 now", "Call [PHONE_NUMBER] now"),
    ("card 4111 1111 1111 1111.", "card [CREDIT_CARD]."),
    ("PAN ABCDE1234F", "PAN [PAN]"),
    ("DATABASE_URL=postgres://u:p@h.example.net/db", "DATABASE_URL=YOUR_DATABASE_URL"),
    ("a@b.example.com and ABCDE1234F", "[EMAIL] and [PAN]"),
    ("line one\nuse Zx9!abcdQ here\nline three", "line one\nuse [PASSWORD] here\nline three"),
    ("nothing to see, version 1.2.3", "nothing to see, version 1.2.3"),
    ("already [EMAIL] and YOUR_API_KEY", "already [EMAIL] and YOUR_API_KEY"),
]


def test_golden_prompts(spark):
    df = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(GOLDEN)], "id long, text string")
    got = {r["id"]: r["redacted"] for r in redact.redact_prompts(df).collect()}
    assert [got[i] for i in range(len(GOLDEN))] == [b for _, b in GOLDEN]


def test_redaction_is_idempotent_and_verified(spark):
    from hushlake.sources.derived import derive

    notes = derive(spark, "/root/testdata/sf0.001", "notes")
    once = redact.redact_prompts(notes)
    checked = verify.residual_check(once, "redacted", "spans").cache()
    clean = checked.filter("verified").select(F.col("doc_id"), F.col("redacted").alias("text"))
    again = redact.redact_prompts(clean).filter(F.col("redacted") != F.col("text"))
    assert clean.count() > 1000 and again.count() == 0
    safe, held = verify.split_quarantine(checked, "verified")
    assert safe.count() + held.count() == notes.count()


def test_resolved_spans_are_disjoint(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    kept = redact.redact_prompts(df)
    overlap = F.exists(
        F.expr("transform(spans, (s, i) -> i > 0 and s.start < element_at(spans, greatest(i, 1)).start - element_at(spans, greatest(i, 1)).neg_len)"),
        lambda b: b,
    )
    assert kept.filter(overlap).count() == 0


def test_replacement_keeps_the_assigned_name(spark):
    token = "gh" + "p_" + "a1" * 12
    df = spark.createDataFrame([(1, f"export GITHUB_TOKEN={token}\nplain {token} again")], "id long, text string")
    out = redact.sanitize_text(df).first()["sanitized"]
    assert out == "export GITHUB_TOKEN=YOUR_GITHUB_TOKEN\nplain YOUR_GITHUB_TOKEN again"


def test_variable_name_rules(spark):
    rows = [
        ("const foo = 'V1'", "V1", "foo"), ("process.env.DB_KEY = V2", "V2", "DB_KEY"), ("a.b.c: V3", "V3", "c"),
        ("letter=V4", "V4", "ter"), ("no name V5", "V5", None), ('"k1": "V6"', "V6", "k1"), ("x=\\E.*V7", "\\E.*V7", "x"),
    ]
    df = spark.createDataFrame(rows, "line string, v string, want string")
    got = df.select("want", P.variable_name(F.col("line"), F.col("v")).alias("got")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_nested_records(spark):
    df = spark.createDataFrame([(1, "a@b.example.com")], "id long, text string")
    rec = spans.with_spans(df).select(
        "spans", F.struct(F.col("text").alias("t"), F.array("text", F.lit("k")).alias("l"), F.lit(5).alias("n")).alias("r")
    )
    r = redact.sanitize_nested(rec, "spans", ["r"]).first()["r"]
    assert (r["t"], r["l"], r["n"]) == ("YOUR_EMAIL", ["YOUR_EMAIL", "k"], 5)


def test_page_text_is_left_alone(spark):
    df = spark.createDataFrame([("user", "a@b.example.com"), ("assistant", "a@b.example.com")], "role string, text string")
    out = {r["role"]: r["sanitized"] for r in redact.sanitize_outgoing(df, "text", F.col("role") == "user").collect()}
    assert out == {"user": "YOUR_EMAIL", "assistant": "a@b.example.com"}


def test_fail_closed_gate(spark):
    df = spark.createDataFrame([(1, True), (2, None)], "id long, safe boolean")
    with pytest.raises(Exception, match="POLICY_VIOLATION"):
        verify.fail_closed(df).collect()
    assert verify.fail_closed(df.filter("id = 1")).count() == 1


def test_server_rules(spark):
    df = spark.createDataFrame([("mail a@b.example.com",), ("fine",), ("2345 6789 0123",)], "t string")
    assert [r["h"] for r in df.select(verify.server_rule_hit(F.col("t")).alias("h")).collect()] == ["a@b.ex", None, "2345 6"]


def test_request_bodies(spark):
    from hushlake.operators.audits import repair_bodies

    rows = [(1, '{"prompt":"mail a@b.example.com","n":"1"}'), (2, '{"prompt":"fine","n":"1"}'), (3, "text a@b.example.com")]
    out = {r["id"]: (r["blocked"], r["sent_body"]) for r in repair_bodies(
        spark.createDataFrame(rows, "id long, body string")).collect()}
    assert out[1] == (True, '{"prompt":"mail YOUR_EMAIL","n":"1"}')
    assert out[2] == (False, rows[1][1]) and out[3] == (True, "text YOUR_EMAIL")


def test_request_bodies_of_any_shape(spark):
    from hushlake.operators.audits import repair_bodies

    mail = "joe@corp.example.com"
    bodies = {
        "unknown field": '{"prompt":"hi","other":"mail %s"}' % mail,
        "kept fields": '{"prompt":"mail %s", "keep":7, "e": 1.50, "z": null}' % mail,
        "messages": '{"messages":[{"role":"user","content":"a \\"quoted\\" %s\\n"},{"role":"system","content":"fine"}]}' % mail,
        "two fields": '{"prompt":"apiKey: \\"abc","n":"hello there\\" x"}',
        "number": '{"card": 4111111111111111}', "key": '{"%s": 1}' % mail, "clean": '[1, "two", {"x": []}]', "null": None,
    }
    frame = spark.createDataFrame(list(bodies.items()), "id string, body string")
    out = {r["id"]: (r["blocked"], r["held"], r["sent_body"]) for r in repair_bodies(frame).collect()}
    assert out["unknown field"] == (True, False, '{"prompt":"hi","other":"mail YOUR_EMAIL"}')
    assert out["kept fields"] == (True, False, '{"prompt":"mail YOUR_EMAIL", "keep":7, "e": 1.50, "z": null}')
    assert out["messages"] == (True, False, bodies["messages"].replace(mail, "YOUR_EMAIL"))
    assert out["two fields"] == (False, False, bodies["two fields"])
    assert out["number"] == out["key"] == (True, True, None)
    assert out["clean"] == (False, False, bodies["clean"]) and out["null"] == (False, False, None)


def test_policy_reads_labels_in_the_row(spark):
    schema = "key string, dom string, labels array<struct<selector:string,label:string>>, ocr string, task string, url string, unredacted long"
    rows = [
        (None, "", [("#a", "mail a@b.example.com")], "", "", "https://x.example.com", 0),
        ("k", "", [("#a", "nothing here"), ("#b", "mail a@b.example.com"), ("#c", "x@y.example.com")], "", "", "", 0), ("k", "", [], "", "", "", 0), ("k", "", None, None, None, None, None),
    ]
    out = verify.policy_violations(spark.createDataFrame(rows, schema), "key")
    got = [(r["key"], list(r["violations"]), r["safe"]) for r in out.collect()]
    message = "Raw EMAIL found in accessibility label for selector "
    assert got == [(None, [message + "#a"], False), ("k", [message + "#b", message + "#c"], False), ("k", [], True), ("k", [], True)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_nested_values_of_any_depth(spark):
    schema = "items array<struct<neg_len:int,type:string,value:string>>, a array<struct<x:string>>, b array<array<string>>, c map<string,struct<y:array<string>>>"
    row = ([(-5, "EMAIL", "a@b.c")], [("to a@b.c",)], [["a@b.c", None]], {"k": (["is a@b.c"],)})
    out = redact.sanitize_nested(spark.createDataFrame([row], schema), "items").first()
    assert out["a"][0]["x"] == "to YOUR_EMAIL" and out["b"] == [["YOUR_EMAIL", None]] and out["c"]["k"]["y"] == ["is YOUR_EMAIL"]
    with pytest.raises(TypeError):
        redact.sanitize_nested(spark.sql("select array(named_struct('neg_len', 1, 'type', 'x', 'value', 'y')) items, cast('a' as binary) z"), "items")


def test_filters_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "docs")
    spark.range(100).selectExpr("id AS doc_id", "concat('mail a', id, '@b.example.com') AS text").write.parquet(path)
    docs = spark.read.parquet(path)
    for out in (spans.detect(docs, ["doc_id"]), redact.redact_prompts(docs), redact.sanitize_text(docs)):
        plan = out.filter("doc_id = 5")._jdf.queryExecution().executedPlan().toString()
        assert "EqualTo(doc_id,5)" in plan and "Exchange" not in plan


def test_long_line_without_keyword(spark):
    line = ("abcdefghij0123456789xyz " * 220_000).strip()
    df = spark.createDataFrame([(1, line), (2, line[:60] + " token"), (3, "k" * 3_000_000)], "doc_id long, text string")
    got = spans.detect(df, ["doc_id"], types=["API_KEY"]).collect()
    assert sorted((r["doc_id"], r["start"], r["value"]) for r in got) == [(2, 0, "abcdefghij0123456789xyz"), (2, 24, "abcdefghij0123456789xyz")]


def test_many_spans_in_one_text(spark):
    """Blocks of spans give what one span at a time gives, and in time that grows in proportion."""
    import time

    from hushlake.operators import redact, spans

    rows, want = [], []
    for n in (0, 1, 127, 128, 129, 300, 20_000):
        part = [f"row {i}: MAIL_KEY=user{i}@mail.example.com" + ("\n" if i % 5 else " and ") for i in range(n)]
        rows.append((n, "ü" + "".join(part) + "end"))
        at, starts = 1, []
        for i, p in enumerate(part):
            starts.append((at + p.index("user"), f"user{i}@mail.example.com"))
            at += len(p)
        want.append(starts)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    started = time.monotonic()
    done = redact.redact_prompts(df, types=["EMAIL"]).orderBy("doc_id").collect()
    assert time.monotonic() - started < 60
    for (n, text), starts, r in zip(rows, want, done):
        assert [(s.start, s.value) for s in r.spans] == starts
        out, end = [], 0
        for (start, value), mark in zip(starts, r.placeholders):
            out += [text[end:start], mark]
            end = start + len(value)
        assert r.redacted == "".join(out) + text[end:]
    marks = {m for r in done for m in r.placeholders}
    alone = redact.redact_prompts(spark.createDataFrame([(1, "MAIL_KEY=user1@mail.example.com")], "doc_id long, text string"), types=["EMAIL"]).first()
    assert alone.placeholders[0] in marks and len(marks) <= 2
    keys = "\n".join(f"the token abcdefghij{i:010d}x is key" for i in range(1000))
    found = spans.with_spans(spark.createDataFrame([(1, keys)], "doc_id long, text string"), types=["API_KEY"]).first().spans
    assert [s.start for s in found] == [m.start() for m in __import__("re").finditer(r"abcdefghij\d+x", keys)]


def test_bodies_of_many_strings_take_linear_time(spark):
    import json
    import time

    from hushlake.operators.audits import repair_bodies

    parts = [f"mail u{i}@corp.example.com" if i % 50 == 0 else f"plain {i}" for i in range(1500)]
    started = time.time()
    out = repair_bodies(spark.createDataFrame([(json.dumps(parts),)], "body string")).first()
    assert json.loads(out["sent_body"]) == ["mail YOUR_EMAIL" if i % 50 == 0 else p for i, p in enumerate(parts)]
    assert time.time() - started < 60


def test_texts_made_of_orders_are_scanned_by_many_tasks(spark, tmp_path):
    from hushlake.sources.derived import derive

    rows = [(i, "1-URGENT") for i in range(64)]
    spark.createDataFrame(rows, "o_orderkey long, o_orderpriority string").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    notes = derive(spark, str(tmp_path), "notes")
    held = [len(part) for part in notes.select("doc_id").rdd.glom().collect()]
    assert sum(held) == 64 and max(held) < 32


def test_offsets_in_a_text_that_holds_the_mark(spark):
    text = "a\x01 joe@corp.example.com \x01\x01 ann@corp.example.com\x01 api: abcdefghij_abcdefghij\x01 key"
    for t in (text, text.replace("\x01", "-"), text.replace("\x01", "\n")):
        found = spans.with_spans(spark.createDataFrame([(t,)], "text string"), prompt_rules=True).first()["spans"]
        assert {"joe@corp.example.com", "ann@corp.example.com"} <= {s["value"] for s in found}
        assert all(t[s["start"]:s["start"] - s["neg_len"]] == s["value"] for s in found)


def test_allowlist_of_values_with_and_without_spaces(spark):
    from hushlake.functions import checks

    terms = ["new chat", "login", "sign"]
    cases = {
        "login": True, " Login\t": True, "NEW  chat": True, "login sign": True, "log": False, "loginlogin": False, "new": False,
        " login ": True, "": True, "  ": True, "login secretvalue": False, "your_x": True, None: True,
    }
    frame = spark.createDataFrame([(k,) for k in cases], "v string")
    got = {r["v"]: r["a"] for r in frame.select("v", checks.allowlisted(F.col("v"), terms).alias("a")).collect()}
    assert got == cases
