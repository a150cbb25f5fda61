"""The n-gram join against all pairs: both settings, shared passages, repeated and missing ids."""

import random

import numpy as np
import pytest

import corpus_pipeline
from hushlake.llm import ngram_join


def shingles(text, k):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").split()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def groups(texts, k, percent):
    """Group number of each row, or None for empty sets; by comparing all pairs."""
    sets = [shingles(t, k) for t in texts]
    of = [i if s else None for i, s in enumerate(sets)]
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]) and of[i] != of[j]:
                old, new = max(of[i], of[j]), min(of[i], of[j])
                of = [new if g == old else g for g in of]
    return of


def corpus(seed):
    """Unrelated texts that share a passage, groups of near copies of all degrees, short texts, repeated words."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    texts = []
    for i in range(90):
        own = [f"{i}v{rng.randint(0, 400)}" for _ in range(rng.randint(1, 260))]
        at = rng.randint(0, len(own))
        texts.append(own[:at] + passage + own[at:] if i % 2 else own)
    for i in range(0, 60, 2):
        for share in (0.01, 0.03, 0.08):
            copy = list(texts[i])
            for _ in range(max(1, int(len(copy) * share))):
                copy[rng.randrange(len(copy))] = f"n{rng.randint(0, 9)}"
            texts.append(copy)
    texts += [texts[0][: len(texts[0]) * 9 // 10], ["a"], ["A"], ["a", "b"], ["same"] * 50, ["same"] * 900, []]
    return [" ".join(t) for t in texts] + [None, "  "]


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_components_against_all_pairs(spark, k, percent):
    texts = corpus(k)
    of = groups(texts, k, percent)
    ids = [i // 2 if i % 5 == 0 else None if i % 7 == 0 else 1000 + i for i in range(len(texts))]  # some repeated, some missing
    least = {}
    for g, i in zip(of, ids):
        if g is not None and i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted(((i, len(shingles(t, k)), i if g is None else least.get(g)) for i, t, g in zip(ids, texts, of)), key=str)
    frame = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string").selectExpr("*", "1 AS s", "2 AS key", "3 AS n").repartition(5)
    got = ngram_join.shingle_components(frame, words=k, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert len({g for g in of if g is not None}) < len([g for g in of if g is not None]) - 20


def test_one_row_of_each_group_stays(spark):
    base = [f"w{i}" for i in range(100)]
    near = [" ".join(base[:i] + ["x"] + base[i + 1 :]) for i in (10, 30, 50, 70)]
    rows = [(None, near[0]), (None, near[1]), (7, near[2]), (7, " ".join(base)), (8, near[3]), (8, "something else that stands alone"), (9, "only once"), (9, "only once"), (None, None), (10, ""), (10, "")]
    frame = spark.createDataFrame([(i, t, "en", f"s{n}") for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string")
    kept = corpus_pipeline.drop_near_duplicates(spark, frame, "")
    assert kept.columns == frame.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    first = min([near[2], " ".join(base)], key=lambda t: [r for r in kept.collect() if r.text == t] == [])
    assert got == sorted([(7, first), (8, "something else that stands alone"), (9, "only once"), (None, None), (10, ""), (10, "")], key=str)
    assert corpus_pipeline.drop_near_duplicates(spark, frame.limit(0), "").count() == 0


def test_keys_keep_a_common_one():
    """Whatever linked sets differ in, a key that both keep agrees, also when each leaves out its most frequent ones."""
    rng = np.random.default_rng(9)
    edges = ngram_join.band_edges(80)
    for n in (4, 9, 25, 80, 400):
        for _ in range(60):
            a = rng.integers(1, 2**63, n, dtype=np.uint64)
            differ = ngram_join._differ(edges, int(np.searchsorted(edges, n, side="right")) - 1, 80)
            gone = int(rng.integers(0, differ + 1))
            new = int(rng.integers(0, differ - gone + 1))
            b = np.concatenate([a[gone:], rng.integers(1, 2**63, new, dtype=np.uint64)])
            if 100 * (n - gone) < 80 * (n + new) or differ == 0:
                continue
            small = min(len(a), len(b))
            band = int(np.searchsorted(edges, small, side="right")) - 1
            d = ngram_join._differ(edges, band, 80)
            (ka, allow_a), (kb, allow_b) = ngram_join._keys(np.unique(a), band, d), ngram_join._keys(np.unique(b), band, d)
            heat = {k: rng.integers(0, 5) for k in {*ka.tolist(), *kb.tolist()}}  # any order of frequency
            left = [set(sorted(k.tolist(), key=lambda x: (-heat[x], x))[allow:]) for k, allow in ((ka, allow_a), (kb, allow_b))]
            assert left[0] & left[1]
