"""Greedy box reductions against plain loops, including crowded pages and copies."""

import math
import random

from pyspark.sql import functions as F

from hushlake.functions.dims import PRIORITY
from hushlake.operators import boxes as B
from hushlake.operators import dedupe


def inter(a, b):
    w = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]))
    h = max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
    return w * h


def iou(a, b):
    i = inter(a, b)
    u = a[2] * a[3] + b[2] * b[3] - i
    return i / u if i and u > 0 else 0


def held(a, b):
    area = a[2] * a[3]
    return inter(a, b) / area > 0.7 if area else False


def rows(n=400, seed=5):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        page = 0 if i % 3 == 0 else rnd.randint(1, 6)
        if out and rnd.random() < 0.25:
            src = rnd.choice(out)
            page, box = src[0], src[5:]
        else:
            box = (float(rnd.randint(0, 600)), float(rnd.randint(0, 400)), float(rnd.choice([0, 20, 40, 90])), float(rnd.choice([0, 15, 30, 60])))
        out.append((page, i, rnd.choice(["EMAIL", "CARD", "FACE", "OTHER"]), rnd.choice(["dom", "ocr"]), rnd.randint(60, 99) / 100, *box))
    return out


SCHEMA = "page long, ord long, type string, source string, confidence double, x double, y double, width double, height double"


def test_fusion_matches_the_loop(spark):
    data = rows()
    want = []
    for page in {r[0] for r in data}:
        mine = sorted((r for r in data if r[0] == page), key=lambda r: r[1])
        done = set()
        for i, a in enumerate(mine):
            if i in done:
                continue
            done.add(i)
            box, kind, conf, src, n = list(a[5:]), a[2], a[4], {a[3]}, 1
            for j in range(i + 1, len(mine)):
                if j in done:
                    continue
                b = mine[j]
                o = b[5:]
                if iou(box, o) > 0.4 or held(o, box) or held(box, o):
                    done.add(j)
                    x, y = min(box[0], o[0]), min(box[1], o[1])
                    box = [x, y, max(box[0] + box[2], o[0] + o[2]) - x, max(box[1] + box[3], o[1] + o[3]) - y]
                    src.add(b[3])
                    conf, n = max(conf, b[4]), n + 1
                    if PRIORITY[b[2]] > PRIORITY[kind]:
                        kind = b[2]
            want.append((page, a[1], *box, kind, round(conf, 2), tuple(sorted(src)), n))
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    got = [(r["page"], r["region"], r["x"], r["y"], r["width"], r["height"], r["type"], r["confidence"], tuple(r["sources"]), r["members"])
           for r in B.fuse(df, "page").collect()]
    assert sorted(got) == sorted(want)


def test_suppression_matches_the_loop(spark):
    data = rows(seed=9)
    want = []
    for key in {(r[0], r[2]) for r in data}:
        kept = []
        for r in sorted((r for r in data if (r[0], r[2]) == key), key=lambda r: (-r[4], r[1])):
            if not any(iou(k[5:], r[5:]) > 0.5 for k in kept):
                kept.append(r)
        want += [(r[0], r[2], r[1]) for r in kept]
    got = [(r["page"], r["type"], r["ord"]) for r in B.suppress(spark.createDataFrame(data, SCHEMA), "page", "ord").collect()]
    assert sorted(got) == sorted(want)


def test_suppression_in_rounds_matches_the_fold(spark):
    rnd = random.Random(3)
    data = [(0 if i % 3 else 1, i, rnd.choice("AB"), "dom", rnd.randint(1, 5) / 10, rnd.uniform(-50, 300), rnd.uniform(0, 200),
             rnd.choice([1.0, 8.0, 16.0, 30.5, 64.0, 200.0]), rnd.choice([2.0, 8.0, 31.0, 64.0])) for i in range(500)]
    df = spark.createDataFrame(data, SCHEMA)
    for threshold in (0.3, 0.8):
        whole, parts = (sorted(tuple(r) for r in B.suppress(df, "page", "ord", threshold, region).select("page", "type", "ord").collect()) for region in (10**6, 60))
        assert whole == parts and len(whole) < 500


def test_one_crowded_region_is_reduced_in_rounds(spark):
    # A chain of boxes over the whole page, each in conflict with the next: one region, every second box stays.
    chain = [(0, i, "A", "dom", 1.0 - i / 10_000, 2.0 * i, 0.0, 10.0, 10.0) for i in range(16)]
    crowd = [(1, i, "A", "dom", 0.5 + (i * 7919 % 1000) / 3000, float(i % 97), float(i % 89), 40.0, 40.0) for i in range(3000)]
    got = [r["ord"] for r in B.suppress(spark.createDataFrame(chain, SCHEMA), "page", "ord", 0.5, 8).collect()]
    assert sorted(got) == list(range(0, 16, 2))
    df = spark.createDataFrame(crowd, SCHEMA)
    whole, parts = (sorted(r["ord"] for r in B.suppress(df, "page", "ord", 0.5, region).collect()) for region in (10**6, 1000))
    assert whole == parts


def test_stacked_boxes_give_rows_by_class(spark):
    stack = [(0, i, "A", "dom", 0.9, 5.0, 5.0, 10.0, 10.0) for i in range(2000)]
    near = [(0, 5000 + i, "A", "dom", 0.9, 8.0, 5.0, 10.0, 10.0) for i in range(3)]
    df = spark.createDataFrame(stack + near + [(0, 9000, "A", "dom", 0.9, 500.0, 5.0, 0.0, 10.0)], SCHEMA)
    classes = B.box_classes(df, "page", "ord")
    got = {(r["a_class_id"], r["b_class_id"]): (r["pairs"], round(r["iou"], 4)) for r in B.class_pairs(classes, "page").collect()}
    assert got == {(0, 0): (1999000, 1.0), (0, 5000): (6000, 0.5385), (5000, 5000): (3, 1.0)}
    links = B.class_members(df, classes, "page", "ord")
    assert links.count() == 2004 and links.filter("class_id = 0").count() == 2000


def test_huge_boxes_are_not_cut_into_cells(spark):
    rnd = random.Random(8)
    data = [(i % 2, i, "A", "dom", 0.9, rnd.uniform(0, 1e4), rnd.uniform(0, 1e4), 30.0 if i % 10 else 1e9, 30.0 if i % 15 else 1e9) for i in range(300)]
    want = sorted((a[1], b[1]) for a in data for b in data if a[0] == b[0] and a[1] < b[1] and inter(a[5:], b[5:]) > 0)
    got = sorted((r["a_ord"], r["b_ord"]) for r in B.overlap_pairs(spark.createDataFrame(data, SCHEMA), "page", "ord").collect())
    assert got == want


def test_regions_carry_the_placeholder_of_their_best_candidate(spark):
    data = [(0, 0, "PHONE", "dom", 0.9, 0.0, 0.0, 10.0, 10.0, "HOME_NUMBER"), (0, 1, "EMAIL", "ocr", 0.8, 1.0, 0.0, 10.0, 10.0, "WORK_MAIL"),
            (0, 2, "EMAIL", "ocr", 0.8, 50.0, 0.0, 10.0, 10.0, None), (0, 3, "CARD", "ocr", 0.8, 90.0, 0.0, 10.0, 10.0, "")]
    df = spark.createDataFrame(data, SCHEMA + ", placeholder string")
    got = {r["region"]: r["placeholder"] for r in B.fuse(df, "page").collect()}
    assert got == {0: "WORK_MAIL", 2: "YOUR_EMAIL", 3: "YOUR_CARD_NUMBER"}
    assert {r["placeholder"] for r in B.fuse(df.drop("placeholder"), "page").collect()} == {"YOUR_EMAIL", "YOUR_CARD_NUMBER"}


def test_grid_join_finds_each_pair_once(spark):
    data = rows(200, 2)
    want = sorted(
        (a[1], b[1]) for a in data for b in data if a[0] == b[0] and a[1] < b[1] and inter(a[5:], b[5:]) > 0
    )
    for cell in (16, 256):
        got = sorted((r["a_ord"], r["b_ord"]) for r in B.overlap_pairs(spark.createDataFrame(data, SCHEMA), "page", "ord", cell).collect())
        got = [p for p in got]
        solid = [p for p in got if p in set(want)]
        assert solid == want and len(got) == len(set(got))


def test_eye_band(spark):
    def turn(p, c, a):
        if abs(a) < 1e-6:
            return p
        dx, dy = p[0] - c[0], p[1] - c[1]
        return (math.floor(c[0] + dx * math.cos(a) - dy * math.sin(a) + 0.5), math.floor(c[1] + dx * math.sin(a) + dy * math.cos(a) + 0.5))

    faces = [(10.0, 20.0, 100.0, 120.0, 0.0), (30.0, 10.0, 80.0, 90.0, 0.3), (0.0, 0.0, 40.0, 50.0, -0.2)]
    got = spark.createDataFrame(faces, "x double, y double, width double, height double, roll double").coalesce(1).select(*B.eye_band()).collect()
    for (x, y, w, h, a), r in zip(faces, got):
        c, ey = (x + w / 2, y + h / 2), y + h * 0.40
        left, right = turn((x + w * 0.33, ey), c, a), turn((x + w * 0.67, ey), c, a)
        d = max(1, math.hypot(right[0] - left[0], right[1] - left[1]))
        length = math.floor(d + 2 * math.floor(d * 0.38 + 0.5) + 0.5)
        thick = math.floor(max(h * 0.22, d * 0.36, max(10, math.floor(h * 0.12 + 0.5)) * 1.8, 18) + 0.5)
        assert (r["length"], r["thickness"]) == (length, thick)
        assert abs(r["angle"] - math.atan2(right[1] - left[1], right[0] - left[0])) < 1e-9


def test_enclosing_and_clamp(spark):
    df = spark.createDataFrame([(1, 10.0, 20.0, 50.0, 40.0), (1, 30.0, 15.0, 60.0, 55.0)], "p long, x double, y double, width double, height double")
    r = B.enclosing(df, ["p"]).first()
    assert (r["x"], r["y"], r["width"], r["height"]) == (10, 15, 80, 55)
    c = spark.createDataFrame([(-5.4, 90.5, 500.0, 0.0)], "x double, y double, width double, height double").select(
        *B.clamp(F.col("x"), F.col("y"), F.col("width"), F.col("height"), F.lit(100.0), F.lit(100.0))).first()
    assert tuple(c) == (0.0, 91.0, 100.0, 1.0)


def test_dominance_matches_the_loop(spark):
    rnd = random.Random(4)
    data = [(rnd.randint(0, 2), i, rnd.choice("AB"), "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 6))), f"#{rnd.randint(0, 9)}", rnd.randint(6, 9) / 10)
            for i in range(150)]
    want = sorted(
        a[1] for a in data
        if not any(
            b[0] == a[0] and b[2] == a[2] and b[1] != a[1]
            and ((b[4] == a[4] and b[5] > a[5]) or (a[3] in b[3] and len(b[3]) > len(a[3]) and b[5] >= a[5]))
            for b in data
        )
    )
    df = spark.createDataFrame(data, "scan long, ord long, type string, value string, selector string, confidence double")
    assert sorted(r["ord"] for r in dedupe.drop_dominated(df, "scan").collect()) == want


def exchanges(df):
    """Shuffles in the plan of a frame."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_small_pages_move_once(spark):
    df = spark.createDataFrame(rows(60), SCHEMA)
    assert exchanges(B.suppress(df, "page", "ord")) <= 1
    assert exchanges(B.fuse(df, "page")) <= 2


def test_derived_boxes_move_once(spark, tmp_path):
    from hushlake.sources.derived import derive

    lines = [(k // 3, k, k % 7, k % 4 + 1, float(k % 50), float(k), "ANR"[k % 3], "O") for k in range(90)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string"
    spark.createDataFrame(lines, names).write.parquet(f"{tmp_path}/lineitem.parquet")
    boxes = derive(spark, str(tmp_path), "boxes")
    assert exchanges(B.suppress(boxes, "page_id", "ord")) == 1
    assert exchanges(B.fuse(boxes, "page_id")) == 2
    assert exchanges(boxes.groupBy("page_id", "type").count()) == 1


def odd_rows():
    """Copies, missing keys and places, boxes without an area, and numbers at their limits."""
    out = rows(300, 11)
    for i, box in enumerate([(None, 1.0, 5.0, 5.0), (1.0, None, 5.0, 5.0), (1.0, 1.0, None, 5.0), (1.0, 1.0, None, 0.0), (None, 1.0, 0.0, 5.0),
                             (0.0, 1.0, 5.0, 5.0), (-0.0, 1.0, 5.0, 5.0), (float("nan"), 1.0, 5.0, 5.0), (2.0**53, 1.0, 5.0, 5.0)]):
        out += [(page, 1000 + 10 * i + n, kind, "dom", 0.9, *box) for n, (page, kind) in enumerate([(50 + i, "EMAIL"), (50 + i, None), (None, "EMAIL"), (50, "EMAIL")])]
    return out


def test_small_pages_give_what_regions_give(spark, monkeypatch):
    df = spark.createDataFrame(odd_rows(), SCHEMA)
    got = []
    for whole in (64, 0, 10):
        monkeypatch.setattr(B, "WHOLE", whole)
        got.append([sorted(map(str, frame.collect())) for frame in (B.suppress(df, "page", "ord"), B.fuse(df, "page"))])
    assert got[0] == got[1] == got[2]
    assert len(got[0][0]) > 100


def paths(spark):
    """Detections of a few pages, among them missing pages and paths."""
    kinds = ["/a/b", "/a/b/c", "/a/bc", "/a", "", None, "a//b", "a/"]
    old = [(p, i, "EMAIL", f"v{i % 5}", path) for p in (1, 2, 3, None) for i, path in enumerate(kinds)]
    changed = [(1, "/a/b"), (1, "/a/b"), (1, None), (2, ""), (2, "a/"), (3, "/x"), (None, "/a"), (9, "/a")]
    names = "page long, ord long, type string, value string, path string"
    return spark.createDataFrame(old, names), spark.createDataFrame(old[:3], names), spark.createDataFrame(changed, "page long, root string")


def test_merge_keeps_what_lies_outside(spark, monkeypatch):
    old, fresh, changed = paths(spark)
    want = {}
    roots = [tuple(r) for r in changed.collect()]
    for gen, rows_ in ((0, old.collect()), (1, fresh.collect())):
        for r in rows_:
            under = any(p == r["page"] and root is not None and (r["path"] == root or r["path"].startswith(root + "/"))
                        for p, root in roots if p is not None and r["path"] is not None)
            if gen or not under:
                key = (r["page"], r["type"], r["value"])
                want[key] = min(want.get(key, (9, 0)), (gen, r["ord"]))
    for most in (64, 1, 0):
        monkeypatch.setattr(dedupe, "ROOTS", most)
        got = {(r["page"], r["type"], r["value"]): r["ord"] for r in dedupe.merge_incremental(old, fresh, changed, "page").collect()}
        assert got == {k: v[1] for k, v in want.items()}


def test_merge_moves_items_by_page_only(spark):
    plan = dedupe.merge_incremental(*paths(spark), "page")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "path" not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
