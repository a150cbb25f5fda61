"""Ranked search, URL rules and whitening against brute force, with the odd cases of their tables."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from hushlake.llm import contour, ranked_search, url_filters, whitening

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, queries, k):
    """Plain loops over every query and document."""
    bags = [(i, words(t)) for i, t in docs]
    n, length = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = {}
    for _, b in bags:
        for t in set(b):
            df[t] = df.get(t, 0) + 1
    out = {}
    for q, text in queries:
        scores = []
        for i, b in bags:
            if not b:
                continue
            m = 100 - 75 + (75 * len(b) * n) // length
            score = 0
            for t in words(text):
                if tf := b.count(t):
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out[q] = [(r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scores)[:k])]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.item_id, r["rank"])):
        out.setdefault(r.item_id, []).append((r["rank"], r.doc_id, r.score))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(120)]
    topics = [rng.sample(vocabulary, 12) for _ in range(6)]
    docs = []
    for i in range(n):
        pool = topics[i % 6] if rng.random() < 0.8 else vocabulary
        docs.append((i, " ".join(rng.choice(pool) for _ in range(rng.randint(3, 40)))))
    return docs, [(j, " ".join(rng.sample(vocabulary, 5) + [vocabulary[j]] * 2)) for j in range(8)]


def test_search_against_loop(spark, monkeypatch):
    monkeypatch.setattr(ranked_search, "SHARD_DOCS", 200)
    monkeypatch.setattr(ranked_search, "PER_BLOCK", 16)
    monkeypatch.setattr(ranked_search, "LIST_LEAST", 4)
    docs, queries = corpus(1, 500)
    docs += [(900 + i, docs[3][1]) for i in range(60)] + [(None, docs[3][1]), (3, docs[3][1]), (700, None), (701, ""), (702, " .,- "), (703, "W1 w1 É" * 3000)]
    queries += [(20, docs[3][1]), (20, docs[3][1]), (21, None), (22, "nothing known"), (23, "w1 É w1"), (24, "?!")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "'x' AS id", "1 AS score", "2 AS rank", "3 AS n").repartition(3)
    got = ranked_search.ranked_search(frame, spark.createDataFrame(queries, "item_id long, text string").selectExpr("*", "1 AS terms"))
    want = brute_search(docs, dict(queries).items(), 10)
    assert found(got.collect()) == {q: rows for q, rows in want.items() if rows}


def test_search_in_blocks_of_queries(spark):
    docs, queries = corpus(2, 120)
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(queries, "item_id long, text string")
    want = {q: rows for q, rows in brute_search(docs, queries, 3).items() if rows}
    assert found(ranked_search.ranked_search(*frames, k=3, block_terms=9).collect()) == want
    none = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    for a, b in ((frames[0], none[1]), (none[0], frames[1]), none):
        got = ranked_search.ranked_search(a, b)
        assert got.collect() == [] and got.columns == ["item_id", "rank", "doc_id", "score"]


def test_summaries_bound_and_skip(monkeypatch):
    monkeypatch.setattr(ranked_search, "PER_BLOCK", 8)
    rng = np.random.default_rng(3)
    terms, size = 60, 600
    rows = []
    for i in range(size):  # six topics of ten terms
        own = np.sort(rng.choice(10, 6, replace=False) + 10 * (i % 6)).astype(np.int32)
        rows.append((i, 6 + i % 5, own, rng.integers(1, 4, 6).astype(np.int32)))
    rows[0] = (0, 10, np.arange(0, 60, 6, dtype=np.int32), np.full(10, 3, dtype=np.int32))
    w = rng.integers(100, 5000, terms)
    axes = rng.standard_normal((terms, ranked_search.AXES)).astype(np.float32)
    names = [c.split()[0] for c in ranked_search._INDEX.split(", ")]
    row = dict(zip(names, ranked_search._shard(rows, w, size, 5000, axes)))
    table = np.zeros((size, terms), dtype=np.int64)
    for i, n, own, counts in rows:
        table[i, own] = ranked_search.impacts(w, own, counts.astype(np.int64), np.full(len(own), n), size, 5000)
    sums = np.frombuffer(zlib.decompress(row["summaries"]), dtype=np.uint8).reshape(len(row["block_term"]), terms)
    for b, term in enumerate(row["block_term"]):
        docs = np.asarray(row["block_docs"])[row["block_start"][b] : row["block_start"][b + 1]]
        assert (table[docs] <= sums[b] * row["steps"]).all() and (table[docs, term] > 0).all()
    held = sorted(zip(np.repeat(row["block_term"], np.diff(row["block_start"])).tolist(), row["block_docs"]))
    held += sorted(zip(np.repeat(row["short_term"], np.diff(row["short_start"])).tolist(), row["short_docs"]))
    assert sorted(held) == sorted((int(t), i) for i, _, own, _ in rows for t in own)  # each posting in one block of its list

    queries = [(np.arange(0, 60, 6), np.ones(10, dtype=np.int64)), (np.arange(5), np.ones(5, dtype=np.int64))]
    best = [ranked_search._Best(1), ranked_search._Best(10)]
    looked, skipped = ranked_search._search_shard(row, queries, best, w, size, 5000)
    assert 0 < skipped < looked
    for (own, repeats), top in zip(queries, best):
        exact = table[:, own] @ repeats
        assert [-s for s, _, _ in top.rows] == sorted(exact.tolist(), reverse=True)[: top.k]


def brute_urls(urls, rules):
    out = []
    for key, url in urls:
        host = path = ""
        if url and "://" in url:
            rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
            host, slash, path = rest.partition("/")
            host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path
        fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in ((h, p or "", v) for h, p, v in rules if h is not None) if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, 0, 0, None, "allow"))
        out.append((key, host, path, best[3], best[4]))
    return sorted(out, key=str)


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
URLS = [
    (1, "http://a.example.net/en/1"), (2, "HTTP://A.Example.NET/en"), (3, "https://example.net"), (4, "http://net/"), (5, "http://xnet/"),
    (6, "http://b.net?x=/"), (7, "http://b.net/#/en/"), (8, "nothing"), (9, None), (10, ""), (11, "http://"), (12, "a://b.org/fr/c://x.net/"),
    (13, "http://b.org/fr"), (None, "http://b.org/fr/"), (1, "http://a.example.net/en/1"), (14, "http://example.com./de/"), (15, "http://.net/"),
    (16, "http://É.NET/\n/x"), (17, "http://" + "a." * 50_000 + "net/" + "d/" * 50_000), (18, "http://u@net:80/"), (19, "http://c.d.shop.com/a/b.html"),
]


@pytest.mark.parametrize("extra", [[], [("shop.com", "/a/b", "block"), ("d.shop.com", "/a", "allow"), ("c.d.shop.com", None, "block"), ("net", "/", "block"), (None, "/", "block"), ("shop.com", "/a/b", "allow")]])
def test_urls_against_loop(spark, extra):
    rules = RULES + extra
    pages = spark.createDataFrame(URLS, "page_id long, url string").selectExpr("*", "'h' AS host", "'p' AS path", "1 AS short", "2 AS verdict", "3 AS id")
    got = url_filters.judge_urls(pages, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_urls(URLS, rules)


def test_urls_without_rules_or_rows(spark):
    pages = spark.createDataFrame(URLS, "page_id long, url string")
    rules = spark.createDataFrame([], "host string, path string, verdict string")
    assert sorted((tuple(r) for r in url_filters.judge_urls(pages, rules).collect()), key=str) == brute_urls(URLS, [])
    assert url_filters.judge_urls(pages.limit(0), spark.createDataFrame(RULES, "host string, path string, verdict string")).collect() == []


@pytest.mark.parametrize("kind", ["random", "ties", "clusters", "low rank", "single"])
def test_contour_finds_all(kind):
    rng = np.random.default_rng(4)
    d = 40
    values = {
        "random": rng.random(d) * 50, "ties": np.repeat([9.0, 5.0, 1.0, 0.25], 10), "clusters": np.concatenate([3 + 1e-9 * rng.random(20), rng.random(20)]),
        "low rank": np.concatenate([np.array([7.0, 3.0, 1e-3]), np.zeros(d - 3)]), "single": np.eye(1, d)[0] * 4,
    }[kind]
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    v = (q * values) @ q.T
    v = (v + v.T) / 2
    got, x = contour.largest_eigenpairs(v, 32)
    want = np.sort(values[values > 1e-9])[::-1][:32]
    assert np.allclose(got, want, rtol=0, atol=1e-11) and np.allclose(x.T @ x, np.eye(len(got)), atol=1e-12)
    assert np.abs(v @ x - x * got).max() < 1e-10
    for s in (0.1, 2.0, 6.0):
        assert contour.positive_pivots(v - s * np.eye(d)) == (values > s).sum()


def test_whitening_against_numpy(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.standard_normal((300, 40)) @ rng.standard_normal((40, 40)) * 0.2).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    odd = [(900, None), (901, []), (902, [1.0] * 39), (903, [None] + [0.0] * 39), (904, [math.nan] + [0.0] * 39), (905, [math.inf] * 40), (None, rows[0][1]), (0, rows[0][1])]
    frame = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>").selectExpr("*", "1 AS id", "2 AS deviation", "3 AS whitened").repartition(5)
    got = whitening.whitened_components(frame).collect()
    x = np.floor(64 * np.array([*(r[1] for r in rows), rows[0][1], rows[0][1]], dtype=np.float32).astype(float)).astype(int) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    centred = x - s / n
    v = centred.T @ centred / n
    e, u = (a[..., ::-1] for a in np.linalg.eigh(v))
    want = centred @ u[:, :32] / np.sqrt(e[:32])
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    assert len(got) == n * 32 and len(by_id[0]) == 64 and len(by_id[None]) == 32
    sign = {r.component: np.sign(r.whitened * want[5, r.component - 1]) for r in by_id[5]}
    for i in range(1, 300):
        for r in by_id[i]:
            assert abs(r.whitened * sign[r.component] - want[i, r.component - 1]) < 1e-8
            assert r.n == n and r.deviation == sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s))
            assert abs(r.explained - e[r.component - 1] / np.trace(v)) < 1e-12 and r.identity_error < 1e-9


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened_components(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whitened_components(spark.createDataFrame([(1, None), (2, [])], schema)).collect() == []
    assert whitening.whitened_components(spark.createDataFrame([(1, [1.0, 2.0])] * 3, schema)).collect() == []  # no variance
    two = whitening.whitened_components(spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0])], schema)).collect()
    assert sorted((r.vec_id, r.component, r.n, r.deviation, round(abs(r.whitened), 9), round(r.explained, 9)) for r in two) == [(1, 1, 2, 128**2, 1.0, 1.0), (2, 1, 2, 128**2, 1.0, 1.0)]
    far = [(i, [1e17 * (i % 3), float(i)]) for i in range(6)]  # products beyond doubles' whole numbers
    wide = whitening.whitened_components(spark.createDataFrame(far, schema)).collect()
    assert all(r.deviation is None or r.deviation >= 0 for r in wide) and max(r.identity_error for r in wide) < 1e-4
