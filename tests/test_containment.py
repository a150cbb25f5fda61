"""The containment index, what is built on it, and line terminators in the key rule."""

import random
import time

import pytest
from pyspark.sql import functions as F

from hushlake.functions import dims
from hushlake.operators import containment, context, dedupe, redact, spans, verify


def test_contained_against_loop(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abü ") for _ in range(n))
    texts = [(i % 3, word(rng.randint(0, 30))) for i in range(150)] + [(0, None), (None, "abab"), (1, ""), (1, "aaaa" * 20)]
    values = [(i % 3, word(rng.randint(0, 9))) for i in range(150)] + [(0, None), (None, "ab"), (1, "aaaaaaaa"), (1, "zz"), (1, "aaaaaaaa")]
    got = containment.contained(spark.createDataFrame(texts, "s int, t string"), spark.createDataFrame(values, "s int, v string"), ["s"], "t", "v")
    want = {(a, v, t) for a, t in texts for b, v in values if a is not None and a == b and t and v and v in t}
    rows = [tuple(r) for r in got.select("s", "v", "t").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == want
    none = spark.createDataFrame([], "s int, v string")
    assert containment.contained(spark.createDataFrame(texts, "s int, t string"), none, ["s"], "t", "v").collect() == []


def test_dominance_of_long_values(spark):
    """Values of 3 kB beside values of 200 lengths in one scan."""
    rng = random.Random(6)
    base = ["".join(rng.choice("abcdefgh") for _ in range(3000)) for _ in range(20)]
    values = [(1, i, "API_KEY", v, f"#l{i}", 0.9) for i, v in enumerate(base)]
    for n in range(200):
        v = rng.choice(base)[n : 2 * n + 20] if n % 2 else "".join(rng.choice("abcdefgh") for _ in range(n + 20))
        values.append((1, 100 + n, "API_KEY", v, f"#s{n}", 0.8 if n % 3 else 0.95))
    start = time.time()
    got = dedupe.drop_dominated(spark.createDataFrame(values, "scan_id long, ord long, type string, value string, selector string, confidence double"), "scan_id").collect()
    took = time.time() - start
    keep = {o for _, o, _, v, s, c in values if not any(v in w and len(w) > len(v) and d >= c for *_, w, _, d in values)}
    assert {r["ord"] for r in got} == keep and 20 < len(keep) < 220
    assert took < 60, took


def test_registered_assistants_anywhere(spark):
    signatures = spark.createDataFrame(
        [("AI_ASSISTANT", "A", "bot.example.com", None, 1), ("AI_ASSISTANT", "B", "ai", "/chat", 2), ("SOCIAL_MEDIA", "C", "bot.example.com", None, 3), ("AI_ASSISTANT", "D", "", None, 4)],
        "context string, app string, domain string, path_rule string, ord int",
    )
    urls = [(1, "https://x.example.org/?next=BOT.example.com/a"), (2, "https://mail.example.org/chat"), (3, "https://mail.example.org/x"), (4, None), (5, "https://bot.example.com")]
    pages = context.with_url_parts(spark.createDataFrame(urls, "page_id long, url string"))
    hits = pages.select("page_id", "url").join(context.match_anywhere(pages, signatures), "url")
    assert sorted((r["page_id"], r["app"]) for r in hits.collect()) == [(1, "A"), (2, "B"), (5, "A")]
    both = context.register_signatures(dims.signature_dim(spark), signatures)
    assert context.match_anywhere(pages, both).count() == 3


TOKEN = "q7Zt" + "9xLmBv" * 4
BREAKS = {"line feed": "\n", "return": "\r", "next line": "\u0085", "line separator": " ", "paragraph": " ", "tab": "\t", "vertical tab": "\x0b", "form feed": "\x0c", "none": ""}


@pytest.mark.parametrize("name", sorted(BREAKS))
def test_key_rule_at_line_ends(spark, name):
    """A token before a keyword of its line is a key; only the four line ends part lines."""
    b = BREAKS[name]
    parts = name in ("line feed", "return", "line separator", "paragraph")
    rows = [(1, f"{TOKEN} is the token"), (2, f"{TOKEN}{b} the token"), (3, f"x{b} {TOKEN} is the token"), (4, f"{TOKEN} is the token{b} y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["value"], r["start"]) for r in spans.detect(df, ["doc_id"], types=["API_KEY"]).collect()}
    want = {i: (TOKEN, t.index(TOKEN)) for i, t in rows if not (i == 2 and parts)}
    assert got == want
    done = verify.residual_check(redact.redact_prompts(df), "redacted", "spans").collect()
    assert all(r["verified"] and ((TOKEN in r["redacted"]) == (r["doc_id"] not in want)) for r in done)
    raw = verify.residual_check(df.withColumn("spans", F.expr(spans.NO_SPANS)), "text", "spans").collect()
    assert {r["doc_id"] for r in raw if not r["verified"]} == set(want)


def test_many_values_are_never_broadcast(spark):
    texts = spark.range(3000).selectExpr("concat('https://shop.example.com/code=', id) as t")
    values = spark.range(3000).selectExpr("concat('example.com/code=', id) as v")
    held = containment.contained(texts, values, [], "t", "v").select("v", "t")
    assert len(held.collect()) == 3000 + sum(1 for t in range(3000) for n in (1, 2, 3) if len(str(t)) > n)
    assert "BroadcastExchange" not in held._jdf.queryExecution().executedPlan().toString()


def test_dominance_computes_its_distinct_values_once(spark):
    rows = [(i % 40, i, "API_KEY", "v" * (i % 7 + 1), f"#{i}", 0.9) for i in range(400)]
    seen = spark.sparkContext.accumulator(0)

    def count(v: str) -> str:
        seen.add(1)
        return v

    items = spark.createDataFrame(rows, "scan long, ord long, type string, value string, selector string, confidence double")
    items = items.withColumn("value", F.udf(count, "string").asNondeterministic()("value"))
    assert dedupe.drop_dominated(items, "scan").count() == sum(len(r[3]) == max(len(q[3]) for q in rows if q[0] == r[0]) for r in rows)
    assert seen.value <= 5 * len(rows)


def test_pages_are_scanned_once(spark):
    from hushlake.operators import elements as E

    seen = spark.sparkContext.accumulator(0)

    def count(html: str) -> str:
        seen.add(1)
        return html

    pages = spark.createDataFrame([(i, f"<input type=email value=u{i}@example.com><p>mail u{i}@example.com or xu{i}@example.com</p>") for i in range(50)], "page_id long, html string")
    found = E.page_scan(pages.withColumn("html", F.udf(count, "string")("html")), "page_id").collect()
    assert {r["value"] for r in found} >= {f"xu{i}@example.com" for i in range(50)}
    assert seen.value == 50


def _most_joined(spark) -> int:
    """Rows of the join that made most of them, in the last query."""
    store = spark._jsparkSession.sharedState().statusStore()
    last = store.executionsList().last().executionId()
    values, nodes, most = store.executionMetrics(last), store.planGraph(last).allNodes(), 0
    for i in range(nodes.size()):
        metrics = nodes.apply(i).metrics()
        for m in (metrics.apply(k) for k in range(metrics.size())):
            if "Join" in nodes.apply(i).name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


def test_numbered_values_meet_few_texts(spark):
    """Numbers put together from the same parts have all their short pieces in common; candidates may not grow with that."""
    part = [f"{7 * i + 1000}" for i in range(12)]
    codes = [a + b + c for a in part for b in part for c in part]
    texts = spark.createDataFrame([(f"https://shop.example.com/oauth/callback?code={c}",) for c in codes], "t string")
    values = spark.createDataFrame([(f"shop.example.com/oauth/callback?code={c}",) for c in codes], "v string")
    held = containment.contained(texts, values, [], "t", "v").collect()
    most = _most_joined(spark)
    assert sorted(r["t"] for r in held) == sorted("https://" + r["v"] for r in held) and len(held) == len(codes)
    assert 0 < most <= 6 * len(codes), most


def test_few_short_values_beside_many_long_ones(spark):
    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcü€") for _ in range(n))
    base = [word(n) for n in (7, 8, 31, 32, 33, 200, 256, 257, 400, 700)]
    cut = lambda t, n: (lambda i: t[i : i + n])(rng.randint(0, max(0, len(t) - n)))
    values = {cut(rng.choice(base), n) for n in list(range(1, 12)) + [rng.randint(12, 90) for _ in range(400)]} | {word(40) for _ in range(40)}
    texts = base + [word(5), "", None]
    got = containment.contained(
        spark.createDataFrame([(t,) for t in texts * 2], "t string"), spark.createDataFrame([(v,) for v in [*values, *values, "", None]], "v string"), [], "t", "v"
    )
    rows = [tuple(r) for r in got.select("v", "t").collect()]
    assert len(values) > containment.FEW and len(rows) == len(set(rows))
    assert set(rows) == {(v, t) for v in values for t in base + texts[-3:-2] if v and v in t}


@pytest.mark.parametrize("few", [0, 10_000])
def test_registered_hosts(spark, monkeypatch, few):
    """Domains that are parts of addresses are no hosts; any number of signatures gives the same hits."""
    monkeypatch.setattr(context, "FEW_SIGNATURES", few)
    signatures = spark.createDataFrame(
        [("SOCIAL_MEDIA", "A", "example.com", "/wall", 1), ("AI_ASSISTANT", "B", "a.example.com", None, 2), ("AI_ASSISTANT", "C", "example.com/wall", None, 0),
         ("AI_ASSISTANT", "D", "", None, 3), ("AI_ASSISTANT", "E", None, None, 4), ("AI_ASSISTANT", "F", "b.a.example.com", "/x", 1)],
        "context string, app string, domain string, path_rule string, ord int",
    )
    urls = [(1, "https://b.a.example.com/wall"), (2, "https://b.a.example.com/x"), (3, "https://example.com/wall"), (4, "no address"), (5, None), (6, "https://example.org/wall")]
    pages = context.with_url_parts(spark.createDataFrame(urls, "page_id long, url string"))
    first = context.match_signatures(pages, signatures)
    got = pages.select("page_id", "host", "path").join(first, ["host", "path"]).collect()
    assert sorted((r["page_id"], r["app"]) for r in got) == [(1, "A"), (1, "B"), (2, "F"), (3, "A"), (4, "D"), (5, "D")]
