"""Each operator against a plain loop, and on nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hushlake.llm import (
    components, decontaminate, exact_dedup, katz, language, licenses, line_dedup, ngram_join, packing, quality, toxicity,
)
from hushlake.llm.common import fold
from hushlake.llm.queries import tokenizer_path
from hushlake.llm.words import NON_SPACE, gram_hashes, hashed_words

SCHEMA = "doc_id long, text string, lang string, k1 long, row string, items string, language string"
LONG = " ".join(f"word{i}" for i in range(300_000))
ODD = [
    (1, None, "en", 1, "a", "b", "c"), (2, "", None, 1, "a", "b", "c"), (None, "some text without an id", "en", None, None, None, None),
    (3, "twice the same row", "en", 1, "a", "b", "c"), (3, "twice the same row", "en", 1, "a", "b", "c"),
    (4, " \t\n\x0b\f\r ", "en", 1, "a", "b", "c"), (5, "été ÉTÉ 日本語 \U0001f600", "fr", 1, "a", "b", "c"), (6, LONG, "en", 1, "a", "b", "c"),
    (7, "?!... 123", "en", 1, "a", "b", "c"), (8, "twice the same  row", "en", 1, "a", "b", "c"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# -- words ---------------------------------------------------------------------------------------

def test_hashed_words():
    texts = ["One two one", None, "", LONG, "été one"]
    hashes, seen = {}, []
    for first, found, offsets in hashed_words(texts, NON_SPACE):
        for i in range(len(offsets) - 1):
            words = lower(texts[first + i]).split()
            part = found[offsets[i] : offsets[i + 1]].tolist()
            assert len(words) == len(part)
            seen.append(first + i)
            for w, h in zip(words, part):
                assert hashes.setdefault(w, h) == h
    assert seen == list(range(5))
    assert len(set(hashes.values())) == len(hashes)
    assert len(gram_hashes(np.zeros(2, np.uint64), 3)) == 0


# -- 1 licences ----------------------------------------------------------------------------------

def test_licenses_against_all_comparisons(spark):
    mit = licenses.TEMPLATES["MIT"]
    texts = [
        "prose before\nReleased under the MIT License.\nprose after", mit, "intro line\n" + mit.replace(". ", ".\n\n") + "\nmore prose of another kind",
        mit.replace("software", "programme", 1), "Released by the MIT press.", "x", None, "", "This work is licensed under the GNU General Public License, version 3.",
    ]
    got = {r.doc_id: r.matches for r in licenses.scan_licenses(frame(spark, list(enumerate(texts)))).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        if text is None:
            assert got[i] == []
            continue
        for no, line in enumerate(text.split("\n")):
            a = licenses.bigrams(line)
            scores = {n: 2 * len(a & b) / (len(a) + len(b)) for n, t in licenses.TEMPLATES.items() if a and (b := licenses.bigrams(t))}
            best = max(scores.values(), default=0)
            want = {(n, round(s, 9)) for n, s in scores.items() if s == best >= 0.9}
            assert {(m["license"], round(m["dice"], 9)) for m in got[i] if m["kind"] == "line" and m["first_line"] == no} == want
    assert any(m["license"] == "MIT" and m["kind"] == "run" and m["first_line"] == 1 for m in got[2])
    assert got[4] == got[5] == []


def test_licenses_inside_lines(spark):
    mit = " ".join(licenses.TEMPLATES["MIT"].split())
    prose = lambda k, n: " ".join(f"{k}{i}" for i in range(n))
    texts = {
        "Apache-2.0 notice": "Copyright 2024 Example Ltd. Licensed under the Apache License, Version 2.0.",
        "MIT notice": "Some report text ends here. Released under the MIT License.",
        "All rights reserved": "Copyright (c) 2024 Acme. All rights reserved.",
        "MIT": f"{prose('a', 60)} {mit} {prose('b', 40)}",
        "GPL-2.0 notice": f"{prose('a', 9)} this work is licensed under\nthe GNU General Public License, version 2. {prose('b', 9)}",
        None: f"Released to {prose('a', 3)} under the {prose('b', 3)} MIT {prose('c', 3)} License. All the rights were reserved",
    }
    got = {r.doc_id: r.matches for r in licenses.scan_licenses(frame(spark, list(enumerate(texts.values())))).collect()}
    for i, name in enumerate(texts):
        assert [(m["license"], m["kind"], m["dice"]) for m in got[i]] == ([(name, "window", 1.0)] if name else [])
    twice = f"{prose('a', 5)} all rights reserved {prose('b', 5)} all rights reserved {prose('c', 5)}"
    (row,) = licenses.scan_licenses(frame(spark, [(1, f"Released under the MIT License.\n{twice}")])).collect()
    assert [(m["license"], m["kind"], m["first_line"]) for m in row.matches] == [("MIT notice", "line", 0)] + [("All rights reserved", "window", 1)] * 2


def test_full_texts_are_told_apart(spark):
    """Every full text is found as itself alone, in lines, as one line and inside prose; relatives are not mixed up."""
    names = [n for n, t in licenses.TEMPLATES.items() if len(t) > 1000]
    assert {"BSD-3-Clause", "Apache-2.0 text", "GPL-3.0 text", "AGPL-3.0 text", "LGPL-2.1 text", "MPL-2.0 text", "CC0-1.0 text", "BSL-1.0"} <= set(names)
    prose = " ".join(f"a{i}" for i in range(50))
    docs = [(n, form) for n in names for t in [licenses.TEMPLATES[n]] for form in (t, " ".join(t.split()), f"{prose} {' '.join(t.split())} {prose}")]
    rows = licenses.scan_licenses(frame(spark, docs, "doc_id string, text string").repartition(8)).collect()
    for r in rows:
        full = {m["license"] for m in r.matches if len(licenses.TEMPLATES[m["license"]]) > 1000}
        assert full == {r.doc_id}, [(r.doc_id, m) for m in r.matches if len(licenses.TEMPLATES[m["license"]]) > 1000]
    regents = licenses.TEMPLATES["BSD-3-Clause"].replace("COPYRIGHT HOLDERS AND", "REGENTS AND").replace("name of the copyright holder", "name of the University")
    (row,) = licenses.scan_licenses(frame(spark, [(1, f"Copyright 2020 A. Author.\n\n{regents}")])).collect()
    assert {m["license"] for m in row.matches} == {"BSD-3-Clause"}


def test_license_windows_against_all_windows():
    rng = random.Random(4)
    known = licenses.Templates({"x": "a b c d e f g h i j k", "y": "b c d q r s", "z": "p p p a p b"}, 0.7)
    for _ in range(150):
        words = [rng.choice("abcdefghpqrs") if rng.random() < 0.4 else "abcdefghijkbcdqrspppapb"[i % 23] for i in range(rng.randrange(2, 40))]
        best, found = {}, known.windows(words)
        for i, j in ((i, j) for i in range(len(words)) for j in range(i + 1, len(words))):
            own = frozenset(zip(words[i:j], words[i + 1 : j + 1]))
            for name, b in zip(known.names, known.sets):
                dice = 2 * len(own & b) / (len(own) + len(b))
                if dice >= 0.7:
                    best[i, j, name] = dice
        assert all(best[s, e, name] == pytest.approx(dice) for s, e, name, dice in found)
        covered = {k for s, e, _, _ in found for k in range(s, e + 1)}
        assert all(covered & set(range(i, j + 1)) for i, j, _ in best)


def test_many_copies_of_a_license_in_one_text():
    known = licenses.Templates(licenses.TEMPLATES, 0.9)
    text = licenses.TEMPLATES["GPL-3.0 text"]
    size = len(licenses._words(text))
    filler = " ".join(f"filler{i} word{i}" for i in range(3000))
    words = licenses._words(" ".join([text, filler] * 10))
    started = time.monotonic()
    found = known.windows(words)
    assert time.monotonic() - started < 30  # minutes, if every start were looked at
    assert [(s, e, name) for s, e, name, _ in found] == [(i * (size + 6000), i * (size + 6000) + size - 1, "GPL-3.0 text") for i in range(10)]


def test_licenses_odd(odd, none):
    assert [r.matches for r in licenses.scan_licenses(odd).collect()] == [[]] * len(ODD)
    assert licenses.scan_licenses(none).count() == 0
    assert licenses.scan_licenses(odd, templates={}).filter("size(matches) > 0").count() == 0


# -- 2 decontamination ---------------------------------------------------------------------------

def contamination(docs, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda t: word.findall(lower(t))
    windows = defaultdict(set)
    for item, text in items:
        w = split(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(item)
    out = []
    for doc, text in docs:
        w, hit, found = split(text), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[k]
        out.append((doc, len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return sorted(out, key=str)


@pytest.mark.parametrize("filter_max", [1_000_000, 0])
def test_contamination_against_loop(spark, filter_max):
    rng = random.Random(3)
    vocab = ["a", "b", "c", "dd", "été"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 6, 9, 10, 11, 25]))) for i in range(30)] + [(40, None), (41, "!!")]
    items = [x for x in items if len((x[1] or "").split()) not in (1, 3)] + [(50, items[4][1]), (None, text(12))]
    docs = [(i, text(rng.choice([0, 5, 12, 40]))) for i in range(40)] + [(100, None), (101, "")]
    for i, (_, t) in enumerate(items[:10]):
        docs.append((200 + i, f"{text(7)}, {(t or '').upper()}! {text(5)}"))
    got = decontaminate.find_contamination(frame(spark, docs), frame(spark, items, "item_id long, text string"), filter_max=filter_max).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == contamination(docs, items)


def test_contamination_odd(spark, odd, none):
    bench = frame(spark, [(1, "twice the same row"), (2, "word5 " + " ".join(f"word{i}" for i in range(6, 30)))], "item_id long, text string")
    got = sorted((str(r.doc_id), r.n_hit) for r in decontaminate.find_contamination(odd, bench).collect())
    assert got == sorted((str(i), n) for i, n in zip([1, 2, None, 3, 3, 4, 5, 6, 7, 8], [0, 0, 0, 4, 4, 0, 0, 25, 0, 4]))
    assert decontaminate.find_contamination(none, bench).count() == 0
    empty = frame(spark, [], "item_id long, text string")
    assert decontaminate.find_contamination(odd, empty).filter("n_hit > 0").count() == 0


def test_contamination_makes_few_files(spark, tmp_path):
    """However many shuffle partitions there are, windows and result come in no more files than benchmark and documents."""
    from hushlake.llm.queries import QUERIES

    text = lambda i: " ".join(f"w{i}x{j}" for j in range(14))
    items, docs = [(str(i), text(i)) for i in range(60)], [(i, f"before {text(i)} after") for i in range(0, 90, 2)]
    frame(spark, items, "item_id string, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    frame(spark, docs).coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    held = {"spark.sql.shuffle.partitions": "23", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    files = []
    plain = decontaminate.stored

    def stored(df, name):
        out = plain(df, name)
        files.append(len(out.inputFiles()))
        return out

    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(decontaminate, "stored", stored)
            found = QUERIES["op2_decontamination"](spark, str(tmp_path))
            found.write.parquet(f"{tmp_path}/out")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert files == [1] and len(out.inputFiles()) <= 2
    assert sorted((r.doc_id, r.n_words, r.n_hit, r.n_items) for r in out.collect()) == [(i, 16, 14 * (i < 60), int(i < 60)) for i, _ in docs]


def test_contamination_moves_few_rows(spark):
    """Documents without a fingerprint of the benchmark travel together, and still give a row each."""
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(12))
    docs = frame(spark, [(i if i % 7 else None, text(i)) for i in range(400)] + [(500, None), (501, "")], "id long, text string").coalesce(2)
    bench = frame(spark, [(1, text(1)), (2, text(2)), (3, "")], "item_id long, text string")
    keys = [r["key"] for r in decontaminate.benchmark_windows(bench).collect()]
    wanted = np.unique(np.array(keys, dtype=np.int64).view(np.uint64))
    assert decontaminate._fingerprints(docs, [], wanted, own_short=False).count() <= 2 + 2
    got = decontaminate.find_contamination(docs, bench, id_col="id").collect()
    want = [(i if i % 7 else None, 12, 12 * (i in (1, 2)), [str(i)] * (i in (1, 2))) for i in range(400)] + [(500, 0, 0, []), (501, 0, 0, [])]
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in got), key=str) == sorted(want, key=str)


# -- 3 exact dedup -------------------------------------------------------------------------------

@pytest.mark.parametrize("hashed", [F.xxhash64, lambda c: F.length(c).cast("long")])
def test_exact_against_loop(spark, hashed):
    rng = random.Random(1)
    base = ["".join(rng.choice("abcdefghijk ") for _ in range(n)) for n in (3, 40, 5000, 20000, 20000)]
    texts = [None, "", "  ", *base, *base, base[3][:-1] + "X", " " + base[4], base[4].replace("a", "a\n")]
    docs = [(100 - i, t) for i, t in enumerate(texts)] + [(None, base[1]), (50, base[1]), (50, base[1])]
    strip = lambda t: re.sub(r"[\x20\x09-\x0D]+", "", t or "")
    groups = defaultdict(list)
    for i, t in docs:
        groups[strip(t)].append((-len(t or ""), i is None, i or 0))
    want = []
    for i, t in docs:
        size, no_id, keep = min(groups[strip(t)])
        keep = None if no_id else keep
        want.append((i, keep, len(groups[strip(t)]), i == keep and -len(t or "") == size, hashlib.sha256(strip(t).encode()).hexdigest()))
    got = exact_dedup.exact_duplicates(frame(spark, docs), hashed=hashed).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_exact_odd(odd, none):
    got = {str(r.doc_id): (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(odd).collect()}
    assert got["1"] == got["2"] == (4, 3) and got["3"] == (8, 3) and got["None"] == (None, 1)
    assert exact_dedup.exact_duplicates(none).count() == 0


# -- 4 to 6 classifiers --------------------------------------------------------------------------

def test_language(spark, odd, none):
    sample = [("the cat and the dog are here", "en"), ("the house of the rising sun", "en"), ("le chat et le chien sont ici", "fr"), ("la maison de la rue", "fr")] * 3
    model = language.LanguageModel(sample)
    assert model.predict("the dog")[0] == "en" and model.predict("la rue et le chat")[0] == "fr"
    assert model.predict("housings")[0] == "en" and model.predict("maisonette")[0] == "fr"
    assert model.predict(None) == model.predict("12 !?") == ("und", 0.0)
    assert language.LanguageModel([]).predict("the dog") == ("und", 0.0)
    rows = language.identify_language(odd, model).collect()
    assert len(rows) == len(ODD) and {r.language.lang_pred for r in rows if r.doc_id in (1, 2, 4, 7)} == {"und"}
    assert language.identify_language(none, model).count() == 0
    assert language.fit_languages(none).languages == []


def test_counterfactual_penalty(spark, odd, none):
    rng = random.Random(5)
    noise = [f"w{chr(97 + i)}{chr(97 + i)}" for i in range(26)]
    slurs = [f"{chr(97 + i)}{chr(120 - i)}bad" for i in range(20)]
    sample = []
    for i in range(400):
        words = rng.sample(noise, 6)
        if i % 2:
            words += ["muslims", rng.choice(slurs)]
        elif rng.random() < 0.05:
            words += ["muslims"]
        elif rng.random() < 0.3:
            words += ["christians"]
        sample.append((" ".join(words), i % 2))
    neutral = "the muslims of the town " + " ".join(noise[:3])
    free = toxicity.ToxicityModel(sample, penalty=0.0, l1=1e-3)
    held = toxicity.ToxicityModel(sample, penalty=10.0, l1=1e-3)
    assert held.score(neutral) < 0.5 < free.score(neutral)
    assert abs(held._weight("muslims") - held._weight("christians")) < 0.1 * abs(free._weight("muslims") - free._weight("christians"))
    assert held.score(f"{slurs[0]} {slurs[1]} muslims") > 0.5 > held.score("christians and " + noise[0])
    assert held.score(None) == held.score("") == held.score("?")
    assert len(toxicity.ToxicityModel([]).weights) == 0
    scores = odd.select(toxicity.toxicity_score(held, F.col("text")).alias("s")).collect()
    assert len(scores) == len(ODD) and all(0 <= r.s <= 1 for r in scores)
    assert none.select(toxicity.toxicity_score(held, F.col("text"))).count() == 0
    assert toxicity.swapped({"women", "here"})[0] == {"men", "here"}


def test_byte_network_gradient_and_chunks(odd):
    net = quality.ByteNetwork(3)
    net.p["out"] = np.random.default_rng(0).normal(0, 0.3, 2 * quality.FILTERS).astype(np.float32)
    text = "abc é! " * 300
    grads = {k: np.zeros_like(v) for k, v in net.p.items()}
    net.gradient(text, 1.0, 1.0, grads)
    loss = lambda: -math.log(net.score(text))
    for name, at in (("filters", (3, 2)), ("embed", (97, 1)), ("out", (4,)), ("bias", (1,)), ("base", (0,))):
        keep, eps = float(net.p[name][at]), 2e-3
        net.p[name][at] = keep + eps
        up = loss()
        net.p[name][at] = keep - eps
        down = loss()
        net.p[name][at] = keep
        assert abs((up - down) / (2 * eps) - grads[name][at]) < 0.02 + 0.1 * abs(grads[name][at]), name
    texts = [None, "", "x", text, LONG, "y" * 513]
    assert np.allclose(net.scores(texts), [net.score(t) for t in texts], atol=1e-5)
    changed = LONG[:-900] + "\xff" * 900  # the end of a long text counts
    net.p["embed"][0xC3] += 5
    assert abs(net.score(LONG) - net.score(changed)) > 1e-6
    rows = odd.select(quality.quality_score(net, F.col("text")).alias("s")).collect()
    assert len(rows) == len(ODD) and all(0 <= r.s <= 1 for r in rows)
    assert quality.ByteNetwork().fit([]).score("x") == 0.5


def test_toxicity_penalty_acts_on_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    with_, without = (toxicity.fit_toxicity(docs, labels, penalty=p) for p in (toxicity.PENALTY, 0.0))
    assert with_.weights != without.weights
    lists = toxicity.IDENTITIES
    spread = lambda m: max(abs(m._weight(a) - m._weight(b)) for g in lists for a in g for b in g)
    assert spread(with_) < 0.5 * spread(without)
    texts = [r.text for r in docs.select("text").limit(60).collect()]
    got = [r.s for r in spark.createDataFrame([(t,) for t in texts], "t string").select(toxicity.toxicity_score(with_, F.col("t")).alias("s")).collect()]
    for t, s in zip(texts, got):  # the score again, feature by feature
        total = with_.base
        for w in {"".join(g) for g in re.findall(r"[^\W\d_]+", (t or "").lower())}:
            total += with_.weights.get(w, 0.0) + sum(with_.weights.get("^" + w[:n], 0.0) for n in (4, 5, 6, 7) if len(w) >= n)
        assert math.isclose(s, 1 / (1 + math.exp(-max(-30, min(30, total)))), rel_tol=1e-9)


def test_toxicity_names_from_a_table(spark):
    rows = [("a", "Kettles"), ("a", "spoons"), (None, "forks"), ("b", None), ("a", "spoons")]
    assert toxicity.name_lists(spark.createDataFrame(rows, "list string, name string")) == (("kettles", "spoons"),)
    names = toxicity.inserted([{"a"}, {"spoons"}, {"b"}, {"c"}], (("kettles", "spoons"), ("x",)))
    assert names == {0: ("kettles", "spoons"), 2: ("spoons", "kettles"), 3: ("x", "x")}
    assert toxicity.inserted([{"a"}], ()) == {}


# -- 7 similarity join ---------------------------------------------------------------------------

def linked(docs):
    sets = []
    for i, t in docs:
        w = lower(t).split()
        sets.append((i, {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()))
    top = {i: i for i, _ in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= 90 * len(x | y):
                p, q = sorted((find(i), find(j)))
                top[q] = p
    return sorted((i, len(s), find(i)) for i, s in sets)


def test_join_against_all_pairs(spark):
    rng = random.Random(9)
    docs, number = [], 1000
    for size in (12, 30, 80, 200, 600):
        for _ in range(4):
            base = [f"t{rng.randrange(5000)}" for _ in range(size)]
            for k in range(9):
                words = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2, size // 60, size // 40])):
                    at = rng.randrange(len(words))
                    if rng.random() < 0.5:
                        words[at] = f"n{rng.randrange(10**6)}"
                    else:
                        del words[at]
                docs.append((number := number - 1, " ".join(words)))
    docs += [(2000, "A b"), (1999, "a B"), (2001, None), (2002, ""), (2003, "one"), (1998, "one")]
    got = ngram_join.shingle_components(frame(spark, docs)).select("doc_id", "n_shingles", "component_id")
    assert sorted(map(tuple, got.collect())) == linked(docs)


def test_bands_hold_all_partners():
    edges = ngram_join.band_edges(90, 5000)
    band = lambda n: int(np.searchsorted(edges, n, side="right")) - 1
    for a in range(1, 3000):
        most = a * 100 // 90
        assert band(most) - band(a) <= 1
        assert ngram_join._differ(edges, band(a), 90) >= max(a + b - 2 * s for b in (a, most) for s in [-(-90 * (a + b) // 190)])


def test_join_odd(odd, none):
    got = sorted(((str(r.doc_id), r.n_shingles, r.component_id) for r in ngram_join.shingle_components(odd).collect()))
    assert ("3", 2, 3) in got and ("8", 2, 3) in got and ("1", 0, 1) in got and ("None", 3, None) in got and len(got) == len(ODD)
    assert ngram_join.shingle_components(none).count() == 0


def test_components_of_a_chain(spark):
    edges = frame(spark, [(i, i + 1) for i in range(0, 60)] + [(200, 100)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 200: 100}


# -- 8 language model ----------------------------------------------------------------------------

def katz_loop(docs, parts=7, rest=2):
    tokens = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % parts == rest, [*lower(t).split(), "</s>"]) for i, t in docs]
    uni, bi = Counter(), Counter()
    for _, held, t in tokens:
        if not held:
            uni.update(t)
            bi.update(zip(["<s>", *t[:-1]], t))
    stats = lambda c: [sum(c.values()), len(c), *(sum(x == r for x in c.values()) for r in range(1, 7))]
    words, d = katz.Words(stats(uni)), katz.discounts(stats(bi))
    p = lambda w: float(words.share(np.array([uni[w]]))[0])
    after = defaultdict(list)
    for (h, w), c in bi.items():
        after[h].append((w, c))
    alpha = {}
    for h, found in after.items():
        disc, mass = sum(d[min(c, 6)] * c for _, c in found), sum(p(w) for w, _ in found)
        below = max(sum(c for _, c in found), disc + 0.5)
        alpha[h] = ((1 - disc / below) / (1 - mass), below)
        assert abs(disc / below + alpha[h][0] * (1 - mass) - 1) < 1e-9
    n, v, out = sum(uni.values()), len(uni), []
    for i, held, t in tokens:
        score = 0.0
        for h, w in zip(["<s>", *t[:-1]], t):
            c = bi[h, w]
            score += math.log10(d[min(c, 6)] * c / alpha[h][1] if c else (alpha[h][0] if h in alpha else 1) * p(w))
        out.append((i, held, len(t), sum(uni[w] > 0 for w in t), n, sum(math.log10((uni[w] + 1) / (n + v + 1)) for w in t), score))
    return out


@pytest.mark.parametrize("block,keys", [(4_000_000, 1_000_000), (700, 500)])
def test_katz_against_loop(spark, block, keys):
    rng = random.Random(2)
    vocab = [f"w{int(rng.expovariate(0.05))}" for _ in range(300)]
    docs = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randrange(60)))) for i in range(150)] + [(500, None), (501, ""), (None, "w1 W1 unheard"), (7, "w1 w2"), (7, "w1 w2")]
    got = katz.score_documents(frame(spark, docs).repartition(3), fold("doc_id", 7) == 2, block=block, keys=keys).collect()
    order = lambda r: (str(r[0]), r[2], round(r[6], 6))
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(katz_loop(docs), key=order), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], abs=1e-8)


def test_discounts_are_good_turing():
    """Factors from a line fitted elsewhere, on counts of counts that copies made uneven and on even ones."""
    for n in ([900, 300, 120, 166, 60, 40], [14000, 3600, 1650, 1900, 800, 500], [1000, 250, 111, 62, 40, 28], [50, 0, 9, 4, 0, 2]):
        seen = [r for r in range(1, 7) if n[r - 1]]
        gaps = [(seen[i + 1] if i + 1 < len(seen) else 2 * r - seen[i - 1]) - (seen[i - 1] if i else 0) for i, r in enumerate(seen)]
        line = np.polyfit(np.log(seen), [math.log(2 * n[r - 1] / g) for r, g in zip(seen, gaps)], 1)
        fit = lambda r: math.exp(np.polyval(line, math.log(r)))
        share = 6 * fit(6) / fit(1)
        want = [((r + 1) * fit(r + 1) / (r * fit(r)) - share) / (1 - share) for r in range(1, 6)]
        got = katz.discounts([0, 0, *n])
        assert got[0] == 0 and got[6] == 1 and got[1:6].tolist() == pytest.approx(want)
        assert (np.diff(got) > 0).all() and not np.allclose(got[1:6], [1 - 0.5 / r for r in range(1, 6)], atol=0.01)
    for n in ([0] * 6, [7, 0, 0, 0, 0, 0], [5, 5, 5, 5, 5, 5], [0, 0, 0, 0, 0, 3]):
        assert katz.discounts([0, 0, *n]).tolist() == [0, 0.5, 0.75, 1 - 0.5 / 3, 0.875, 0.9, 1]


def test_katz_odd(odd, none):
    rows = katz.score_documents(odd, fold("doc_id", 7) == 2).collect()
    assert len(rows) == len(ODD) and all(math.isfinite(r.score) for r in rows)
    assert katz.score_documents(none, fold("doc_id", 7) == 2).count() == 0
    unlearned = katz.score_documents(odd, F.lit(True)).collect()
    assert all(r.score == 0 and r.train_tokens == 0 for r in unlearned)


# -- 9 line dedup --------------------------------------------------------------------------------

def test_lines(spark, odd, none):
    prose = lambda i, k: f"p{i} q{i * 7} line{k} of{i} its{k} own kind here {i}x{k}".replace("0", "o").translate(str.maketrans("123456789", "abcdefghi"))
    notice = "Downloaded on day {} by the user named {} under the terms of service"
    docs = [(i, "\n".join([prose(i, 1), notice.format(i, "nameless"), prose(i, 2), "Subscribe to our letter now", prose(i, 3)])) for i in range(6)]
    docs += [(10 + i, "\n".join(prose(99, k) for k in range(5))) for i in range(5)]  # copies are no boilerplate
    docs += [(20, None), (21, ""), (22, prose(7, 1) + "\n\n" + prose(7, 2)), (23, "Subscribe to our letter now")]
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(frame(spark, docs)).collect()}
    for i in range(6):
        assert got[i].text == "\n".join(prose(i, k) for k in (1, 2, 3)) and (got[i].n_lines, got[i].n_dropped) == (5, 2)
    assert all(got[10 + i].text == docs[6][1] for i in range(5))
    assert (got[20].text, got[20].n_lines, got[21].text, got[21].n_lines) == (None, 0, "", 1)
    assert got[22].text == docs[13][1] and got[23].text == ""
    out = line_dedup.drop_recurring_lines(odd)
    assert out.columns[: len(odd.columns)] == odd.columns and sorted(map(str, out.select(*odd.columns).collect())) == sorted(map(str, odd.collect()))
    assert line_dedup.drop_recurring_lines(none).count() == 0


def _prose(rng, lines: int, words: int = 14) -> list[str]:
    return [" ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(words)) for _ in range(lines)]


def test_blocks_of_lines_go_whole(spark):
    rng = random.Random(4)
    block = _prose(rng, 4)
    bodies = [_prose(rng, 6) for _ in range(30)]
    places = [0, 3, 6]  # top, middle, end
    docs = [(i, "\n".join(b[: places[i % 3]] + block + b[places[i % 3] :])) for i, b in enumerate(bodies)]
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(frame(spark, docs)).collect()}
    assert all(got[i].text == "\n".join(b) and got[i].n_dropped == 4 for i, b in enumerate(bodies))


def test_copies_count_once(spark):
    rng = random.Random(5)
    notice, shared = _prose(rng, 1)[0], _prose(rng, 12)
    alone = [_prose(rng, 5) for _ in range(8)]
    docs = [(i, "\n".join([*b, notice])) for i, b in enumerate(alone)]
    copies = []
    for _ in range(60):  # each copy has one line of its own and one edited word elsewhere
        body = list(shared)
        body[rng.randrange(12)] = _prose(rng, 1)[0]
        at = rng.randrange(12)
        words = body[at].split()
        words[rng.randrange(len(words))] = "edited" + "".join(rng.choice("qrstuvwxyz") for _ in range(5))
        body[at] = " ".join(words)
        copies.append(body)
    docs += [(100 + i, "\n".join([*b, notice])) for i, b in enumerate(copies)]
    got = {r.doc_id: r for r in line_dedup.drop_recurring_lines(frame(spark, docs)).collect()}
    assert all(got[i].text == "\n".join(b) for i, b in enumerate(alone))
    assert all(got[100 + i].text == "\n".join(b) for i, b in enumerate(copies))
    # without the eight others nothing recurs: copies alone are no boilerplate
    only = line_dedup.drop_recurring_lines(frame(spark, docs[8:])).agg(F.sum("n_dropped")).first()[0]
    assert only == 0


def test_short_lines_need_a_fixed_number_of_texts(spark):
    rng = random.Random(6)
    for n, dropped in ((49, 0), (50, 1)):
        docs = [(i, "\n".join([*_prose(rng, 2), "all rights"])) for i in range(n)]
        assert {r.n_dropped for r in line_dedup.drop_recurring_lines(frame(spark, docs)).collect()} == {dropped}


def test_lines_with_an_open_field(spark):
    names = ["alpha beta", "gamma delta", "epsilon zeta", "eta theta"]
    other = ["one thing", "two things there", "three of those other things", "four more"]
    docs = [(i, f"{other[i]} start\nThis page was printed by {n} at the reading room of our public library\nend of {other[i]}") for i, n in enumerate(names)]
    got = line_dedup.drop_recurring_lines(frame(spark, docs)).collect()
    assert all(r.n_dropped == 1 and "printed" not in r.text for r in got)


# -- 10 packing ----------------------------------------------------------------------------------

def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizer_path())
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    docs += [(5000 + i, t) for i, t in enumerate([
        None, "", "  ", "a<|endoftext|>b <|STARTOFTEXT|>", "x y\x1cz\x85w don't 'll I'M éÉ é ſß İI 12ab34 __x-y.. ​日本 ½", LONG[:200_000], "the!! the&&& l'été,###", "a|b ***) .x. 'S's",
    ])]
    rows = packing.pack_documents(frame(spark, docs).repartition(3), tokenizer_path(), pool=50_000).collect()
    text, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        text[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t in docs:
        want = plain.encode(t or "", add_special_tokens=False).ids + [2]
        pieces = sorted(text[i], key=lambda r: r.start)
        ids = b"".join(bytes(r.ids) for r in pieces)
        assert np.frombuffer(ids, "<u4").tolist() == want, i
        at = 0
        for r in pieces:
            assert (r.start, r.doc_tokens, r.length * 4) == (at, len(want), len(r.ids)) and zlib.crc32(bytes(r.ids)) == r.ids_crc32
            at += r.length
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0 and {r.tier for r in pieces} == {at}
    short = sum(r.length for r in rows if r.tier < 512)
    assert short < 3 * 512
    whole = Counter(r.doc_id for r in rows)
    assert sum(n == 1 for n in whole.values()) > 0.5 * len(whole)
    groups = defaultdict(set)
    for r in rows:
        groups[r.step_group, r.tier].add(r.sequence_id)
    assert len({g for g, _ in groups}) == len(groups) and all(len(s) * t <= max(t, packing.STEP_TOKENS) for (_, t), s in groups.items())


def test_packing_odd(odd, none):
    rows = packing.pack_documents(odd, tokenizer_path(), with_ids=False).collect()
    assert Counter(r.doc_id for r in rows if r.start == 0) == Counter(i for i, *_ in ODD)
    assert packing.pack_documents(none, tokenizer_path()).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(odd, tokenizer_path(), tiers=(100, 4096))


def test_workers_of_the_pipeline_give_memory_back(spark, monkeypatch):
    """Packing, toxicity and decontamination return what they freed, as a worker is kept for the steps after them."""
    from hushlake.llm import decontaminate, packing, toxicity
    from hushlake.llm.queries import tokenizer_path

    seen = []
    for module in (packing, toxicity, decontaminate):
        monkeypatch.setattr(module, "trimmed", lambda run, name=module.__name__, plain=module.trimmed: seen.append(name) or plain(run))
    docs = spark.createDataFrame([(i, f"some words of text {i} " * 9) for i in range(20)], "doc_id long, text string")
    assert packing.pack_documents(docs, tokenizer_path()).count() >= 20
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, toxic int"))
    assert docs.filter(toxicity.toxicity_score(model, docs["text"]) <= 1).count() == 20
    decontaminate.find_contamination(docs, docs.selectExpr("cast(doc_id as string) as item_id", "text"))
    assert {name.rsplit(".")[-1] for name in seen} == {"packing", "toxicity", "decontaminate"}
