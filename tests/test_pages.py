"""Elements, fields, contexts and action checks on hand-made pages."""

from pyspark.sql import functions as F

from hushlake.functions import dims
from hushlake.functions import text as X
from hushlake.operators import audits, context, elements as E, reports

LOGIN = """<html><head><title>Shop</title></head><body><form id="login"><input name="email" type="email" value="a@b.example.com">
<input type="password" name="p" value="s3cret"><button>Sign in</button></form></body></html>"""
SETTINGS = "<html><body><h1>Settings</h1><input type='password' name='p'></body></html>"
CHAT = """<html><body><div role="log"><p>hello there you</p></div><textarea placeholder="Type a message"></textarea><button>Send</button></body></html>"""
OTP = "<html><body><h2>Enter verification code</h2><input name='otp'></body></html>"
FEED = """<html><body><div role="feed"><div data-testid="tweet">x</div></div></body></html>"""
PROMPT = """<html><body><textarea placeholder="Ask anything"></textarea><button aria-label="Send prompt">x</button></body></html>"""

PAGES = [
    (1, "https://shop.example.com/start", LOGIN, "AUTHENTICATION"), (2, "https://shop.example.com/settings", SETTINGS, "NORMAL"),
    (3, "https://shop.example.com/room", CHAT, "MESSAGING"), (4, "https://shop.example.com/x", OTP, "AUTHENTICATION"),
    (5, "https://shop.example.com/y", FEED, "SOCIAL_MEDIA"), (6, "https://shop.example.com/z", PROMPT, "AI_ASSISTANT"),
    (7, "not a url", "<p>x</p>", "UNKNOWN"), (8, "https://claude.ai/new", "<p>x</p>", "AI_ASSISTANT"),
    (9, "https://web.telegram.org/k", "<p>x</p>", "MESSAGING"), (10, "https://www.reddit.com/r/a", "<p>x</p>", "SOCIAL_MEDIA"),
]


def frame(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string, want string")


def test_contexts(spark):
    judged = context.with_context(E.page_signals(frame(spark)), dims.signature_dim(spark))
    assert {r["page_id"]: r["context"] for r in judged.collect()} == {p[0]: p[3] for p in PAGES}


def test_strict_assistant_rule(spark):
    df = spark.createDataFrame([(1, "https://x.example.com/?q=claude.ai")], "page_id long, url string")
    sig = dims.signature_dim(spark)
    assert context.with_context(df, sig).first()["context"] == "AI_ASSISTANT"
    assert context.with_context(df, sig, strict=True).first()["context"] == "NORMAL"


def test_fields_and_risk(spark):
    nodes = E.scannable(E.elements(frame(spark).filter("page_id = 1"), ["page_id"]))
    found = E.detect_fields(nodes, ["page_id"])
    assert sorted((r["type"], r["value"]) for r in found.collect()) == [("EMAIL", "a@b.example.com"), ("PASSWORD", "s3cret")]
    assert reports.risk_scores(found, ["page_id"]).first()["risk_score"] == 40


def test_ignored_containers_and_short_texts(spark):
    html = "<nav><p>navigation text</p></nav><p>short</p><p>long enough text</p><div style='display: none'><p>hidden long text</p></div><pre>code <b>block</b></pre>"
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    got = [r["text"] for r in E.scannable(E.elements(df, ["page_id"])).orderBy("idx").collect()]
    assert got == ["long enough text", "code block"]


def test_labels_and_regions(spark):
    html = ("<title>T</title><form aria-label='Pay'><label for='a'>Card  number</label><input id='a'><span id='l'>By ref</span>"
            "<input aria-labelledby='l'><input placeholder='ph'></form><div><h2>Head</h2><p>text here</p></div>")
    els = E.elements(spark.createDataFrame([(1, html)], "page_id long, html string"), ["page_id"])
    labels = [r["label"] for r in E.with_labels(els, "page_id").filter("tag = 'input'").orderBy("idx").collect()]
    assert labels == ["Card number", "By ref", "ph"]
    regions = {(r["tag"], r["region"]) for r in E.region_labels(els, "page_id").filter("tag in ('input', 'p')").collect()}
    assert regions == {("input", "Card  number"), ("input", "Pay"), ("input", "ph"), ("p", "Head")}


def test_skeleton_hides_values(spark):
    lines = [r["line"] for r in E.skeleton_lines(E.elements(frame(spark).filter("page_id = 1"), ["page_id"]), ["page_id"]).orderBy("at", "step").collect()]
    text = "\n".join(lines)
    assert "a@b" not in text and "s3cret" not in text
    assert 'data-placeholder="PASSWORD=YOUR_PASSWORD"' in text and "<button>Sign in</button>" in text


def test_skeleton_shape_and_limits(spark):
    card = "4111 1111 1111 1111"
    html = f"<html><body><div id='o'><p>{'x' * 110} {card} tail</p><svg><a>hidden</a></svg><a href='#'>{'y' * 30} {card}</a><section><div><input name='q'></div></section></div></body></html>"
    els = E.elements(spark.createDataFrame([(1, html)], "page_id long, html string"), ["page_id"])
    lines = [r["line"] for r in E.skeleton_lines(els, ["page_id"]).orderBy("at", "step").collect()]
    assert [x.split(">")[0].rstrip(" /") for x in lines] == [
        '  <div id="o"', "    <p", "    <a", "    <section", "      <div", '        <input name="q"', "      <" + "/div", "    <" + "/section", "  <" + "/div",
    ]
    assert "hidden" not in "".join(lines) and lines[1].endswith("tail</p>")
    short = E.skeleton_lines(els, ["page_id"], max_level=2, max_button=40, max_leaf=120).orderBy("at", "step").collect()
    text = "\n".join(r["line"] for r in short)
    assert "4111" not in text and "<input" not in text and all(len(r["line"]) < 140 for r in short)


def test_urls(spark):
    rows = [("HTTPS://User:pw@Shop.Example.com:443/a?x=1#t", "https://shop.example.com/a"), ("http://h:8080", "http://h:8080/"), ("nope", "nope")]
    df = spark.createDataFrame(rows, "u string, w string")
    assert [r["c"] for r in df.select(X.clean_url(F.col("u")).alias("c")).collect()] == [w for _, w in rows]
    bad = spark.createDataFrame([("chrome://x",), (None,), ("https://ok.example.com",)], "u string")
    assert [r["r"] for r in bad.select(X.restricted_url(F.col("u")).alias("r")).collect()] == [True, True, False]


def test_actions(spark):
    rows = [
        (1, "click", "#next", None, None, None, None, False), (2, "exec", "#x", None, None, None, None, False),
        (3, "click", "a[href='JavaScript:x']", None, None, None, None, False), (4, "submit", "#f", None, None, None, None, False),
        (5, "type", "#password", None, "abc", None, None, False), (6, "click", "#checkout", None, None, None, None, False),
        (7, "click", ".delete", None, None, None, None, False), (8, "type", "#q", None, None, None, "LOCAL_PIN", False),
    ]
    df = spark.createDataFrame(rows, "id long, action string, selector string, target string, text string, value string, value_ref string, requires_confirmation boolean")
    assert {r["id"] for r in audits.validate_actions(df).filter("not valid").collect()} == {2, 3}
    tiers = {r["id"]: r["tier"] for r in audits.confirmation_tiers(df).collect()}
    assert [tiers[i] for i in range(1, 9)] == [None, None, None, "submit", "credential", "payment", "destructive", "credential"]
    assert audits.harden_actions(df).filter("id = 5").select("value_ref", "text").first() == ("LOCAL_PASSWORD", None)


def test_latency_percentiles_are_nearest_rank(spark):
    import random

    rnd = random.Random(1)
    data = [("a", rnd.choice([1.0, 2.0, 2.0, 7.5, 100.0])) for _ in range(101)] + [("b", 3.0)] + [("c", float(i)) for i in range(10)]
    got = {r["k"]: r for r in reports.latency_stats(spark.createDataFrame(data, "k string, v double"), ["k"], "v").collect()}
    for k in "abc":
        vs = sorted(v for kk, v in data if kk == k)
        assert (got[k]["p50"], got[k]["p90"], got[k]["p95"]) == tuple(vs[int(len(vs) * p)] for p in (0.5, 0.9, 0.95))


def test_provenance(spark):
    html = """<body><div class="message-list"><p id="old">said before</p><div contenteditable="true" id="edit">past edit</div>
      <div class="composer-container"><textarea id="c1">draft</textarea></div></div>
      <div data-message-author-role="assistant"><p id="ans">an answer</p><textarea id="fake">x</textarea></div>
      <div contenteditable="" id="own"><p id="inner">my words</p></div><input id="i1"><input id="i2" readonly><input id="i3" type="submit">
      <textarea id="t2" disabled>x</textarea><p id="page">page text</p></body>"""
    els = E.elements(spark.createDataFrame([(1, html)], "page_id long, html string"), ["page_id"])
    got = {r["attrs"]["id"]: r["provenance"] == E.USER_INPUT for r in els.collect() if r["attrs"].get("id")}
    assert got == {
        "old": False, "edit": False, "c1": True, "ans": False, "fake": False, "own": True, "inner": True, "i1": True, "i2": False,
        "i3": False, "t2": False, "page": False,
    }


def test_redact_fields_keeps_the_boundary(spark):
    html = """<body><p id="shown">mail a@b.example.com</p><textarea name="note">DB_URL=postgres://u:pw@h.example.com/d
mail a@b.example.com and a@b.example.com</textarea><input type="password" value="s3cret-Pw!"><input name="q" value="">
      <div data-role="assistant"><textarea>mail a@b.example.com</textarea></div><div contenteditable="true">call a@b.example.com</div></body>"""
    els = E.elements(spark.createDataFrame([(1, html)], "page_id long, html string"), ["page_id"])
    items = E.page_items(E.scannable(els), "page_id")
    got = {r["path"].split("/")[-1]: r["text"] for r in E.redact_fields(E.stored_fields(els), items, "page_id").collect()}
    assert set(got) == {"textarea[1]", "div[2]"}
    assert "a@b" not in "".join(got.values()) and "pw@h" not in got["textarea[1]"] and got["textarea[1]"].startswith("DB_URL=YOUR_")
    by_hand = spark.createDataFrame(
        [(1, "/body[1]/input[2]", 1, "EMAIL", "x@y.example.com", "EMAIL=YOUR_EMAIL", "USER_INPUT"), (1, "/body[1]/p[1]", 1, "EMAIL", "a@b.example.com", "x", "USER_INPUT"),
         (1, "/body[1]/div[2]", 1, "EMAIL", "a@b.example.com", "x", "WEBPAGE_CONTENT"), (1, None, 1, "EMAIL", "a@b.example.com", "x", None)],
        "page_id long, path string, ord long, type string, value string, placeholder string, provenance string",
    )
    assert [r["text"] for r in E.redact_fields(E.stored_fields(els), by_hand, "page_id").collect()] == ["EMAIL=YOUR_EMAIL"]


def test_deep_pages_stay_small(spark):
    """Text is not stored once per ancestor: 1,000 levels, and 100 kB of text at the bottom."""
    html = "<div>" * 1000 + "<p>" + "word " * 20_000 + "</p>" + "</div>" * 1000
    rows = E.elements(spark.createDataFrame([(1, html)], "page_id long, html string"), ["page_id"]).collect()
    assert len(rows) == 1001 and sum(len(r["full_text"] or "") + len(r["text"]) for r in rows) < 3 * 100_001
    assert rows[0]["last"] == 1000 and rows[-1]["text"].startswith("word word")


def test_nearest_heading_and_form(spark):
    html = ("<h1>Top</h1><form id='f'><div><p id='a'>x</p></div></form><section><div><p id='b'>x</p></div><div><h2>Near</h2><h3>Second</h3></div></section>"
            "<section><p id='c'>x</p></section><label for='d'></label><input id='d'>")
    els = E.elements(spark.createDataFrame([(1, f"<html><body>{html}</body></html>")], "page_id long, html string"), ["page_id"])
    got = {r["path"].split("/")[3]: r["region"] for r in E.region_labels(els, "page_id").filter("tag in ('p', 'input')").collect()}
    assert got == {"form[1]": "f", "section[1]": "Near", "section[2]": "Top", "input[1]": "Top"}
    near = E.region_labels(els, "page_id", ancestors=1).filter("tag = 'p'").collect()
    assert {r["path"].split("/")[3]: r["region"] for r in near} == {"form[1]": "f", "section[1]": "Main Content", "section[2]": "Main Content"}


def test_elements_are_handed_over_in_bounded_chunks():
    import pyarrow as pa

    html = "<p id=a title=b>text</p>" * 4000
    sizes = [len(part) for part in E._parse_batches(iter([pa.array([html] * 40 + [None]), pa.array([], pa.string())]))]
    assert sum(sizes) == 41 and max(sizes) * len(html) <= E.CHUNK + len(html)


def test_pages_of_one_file_are_parsed_by_many_tasks(spark, tmp_path):
    rows = [(i, f"<p id=p{i}>page {i}</p>") for i in range(200)]
    spark.createDataFrame(rows, "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages"))
    els = E.elements(spark.read.parquet(str(tmp_path / "pages")), ["page_id"])
    tasks = els.select("page_id", "path", "text", F.spark_partition_id().alias("task")).collect()
    assert len({r["task"] for r in tasks}) >= 4
    assert sorted((r["page_id"], r["path"], r["text"]) for r in tasks) == [(i, "/p[1]", f"page {i}") for i in range(200)]


def test_bare_tags_skip_the_tests_on_attributes(monkeypatch):
    """Tags without attributes take over what their ancestors are; only tags with attributes are looked into."""
    seen = []
    for name in ("_ignored", "_hidden", "_chip"):
        monkeypatch.setattr(E, name, lambda *given, plain=getattr(E, name): seen.append(given) or plain(*given))
    page = '<body><nav><p>menu</p></nav><div style="display: none"><p>away</p></div><div class="composer-container"><textarea>mine</textarea></div><p>text</p></body>'
    rows = {r["path"]: r for r in E._parse(page)}
    assert [(r["ignored"], r["hidden"], r["provenance"]) for r in rows.values() if r["tag"] in ("p", "textarea")] == [
        (True, False, "WEBPAGE_CONTENT"), (False, True, "WEBPAGE_CONTENT"), (False, False, "USER_INPUT"), (False, False, "WEBPAGE_CONTENT"),
    ]
    assert all(given[-1] for given in seen) and len(seen) <= 6
