"""Box geometry: overlap joins, containment, clamping, suppression, fusion."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushlake.functions.dims import PRIORITY
from hushlake.functions.placeholders import type_placeholder
from hushlake.functions.text import round_half_up
from hushlake.sources.scratch import checkpointed

BOX = ["x", "y", "width", "height"]
#: Boxes over more grid cells than this meet the others by page instead of by cell.
LARGE = 64
#: Distinct boxes of one independent region that a task may fold; larger regions are reduced in rounds first.
REGION = 4096
#: Boxes of one page that are reduced at once; only larger pages are cut into independent regions first.
WHOLE = 64


def intersection_area(a: str, b: str) -> Column:
    """Shared area of two boxes given as column prefixes (``a_x`` ...)."""
    def side(p: str, size: str) -> Column:
        lo = F.greatest(f"{a}{p}", f"{b}{p}")
        hi = F.least(F.col(f"{a}{p}") + F.col(f"{a}{size}"), F.col(f"{b}{p}") + F.col(f"{b}{size}"))
        return F.greatest(F.lit(0.0), hi - lo)

    return side("x", "width") * side("y", "height")


def iou(a: str, b: str, shared: Column | None = None) -> Column:
    inter = intersection_area(a, b) if shared is None else shared
    union = F.col(f"{a}width") * F.col(f"{a}height") + F.col(f"{b}width") * F.col(f"{b}height") - inter
    return F.when((inter > 0) & (union > 0), inter / union).otherwise(F.lit(0.0))


def contained_share(inner: str, outer: str, shared: Column | None = None) -> Column:
    """Part of the inner box that lies in the outer one (0 for an empty inner box)."""
    inter = intersection_area(inner, outer) if shared is None else shared
    area = F.col(f"{inner}width") * F.col(f"{inner}height")
    return F.when(area != 0, inter / area).otherwise(F.lit(0.0))


def overlaps(a: str, b: str) -> Column:
    """Strict overlap (touching edges do not count)."""
    return (
        (F.col(f"{a}x") < F.col(f"{b}x") + F.col(f"{b}width"))
        & (F.col(f"{a}x") + F.col(f"{a}width") > F.col(f"{b}x"))
        & (F.col(f"{a}y") < F.col(f"{b}y") + F.col(f"{b}height"))
        & (F.col(f"{a}y") + F.col(f"{a}height") > F.col(f"{b}y"))
    )


def covers(outer: str, inner: str) -> Column:
    return (
        (F.col(f"{outer}x") <= F.col(f"{inner}x"))
        & (F.col(f"{outer}y") <= F.col(f"{inner}y"))
        & (F.col(f"{outer}x") + F.col(f"{outer}width") >= F.col(f"{inner}x") + F.col(f"{inner}width"))
        & (F.col(f"{outer}y") + F.col(f"{outer}height") >= F.col(f"{inner}y") + F.col(f"{inner}height"))
    )


def _prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def _cells(df: DataFrame, prefix: str, cell: int, table: int) -> DataFrame:
    """Every grid cell of every box, as (cell x, cell y, side).

    A box of more than ``LARGE`` cells gets a single row for the whole page, and every other box one more there to be met
    by it.  ``side`` is the table (1 or 2) whose large boxes a row is for, so two small boxes never meet by page.
    """
    def span(p: str, size: str) -> tuple[Column, Column]:
        lo = F.floor(F.col(f"{prefix}{p}") / cell)
        return lo, F.greatest(lo, F.floor((F.col(f"{prefix}{p}") + F.col(f"{prefix}{size}")) / cell))

    (x1, x2), (y1, y2) = span("x", "width"), span("y", "height")
    large = (x2 - x1 + 1.0) * (y2 - y1 + 1.0) > LARGE

    def entry(x: Column, y: Column, side: int) -> Column:
        return F.struct(x.cast("long").alias("__cx"), y.cast("long").alias("__cy"), F.lit(side).alias("__side"))

    def page(side: int) -> Column:
        return entry(F.lit(0), F.lit(0), side)

    grid = F.flatten(F.transform(F.sequence(x1, x2), lambda x: F.transform(F.sequence(y1, y2), lambda y: entry(x, y, 0))))
    own, other = (1, 2) if table == 1 else (2, 1)
    # A pair of two large boxes meets on side 1 only.
    as_large = F.array(page(1)) if own == 1 else F.array(page(1), page(2))
    rows = F.when(large, as_large).otherwise(F.concat(grid, F.array(page(other))))
    return df.withColumn("__c", F.explode(rows)).select("*", "__c.*").drop("__c")


def overlap_join(left: DataFrame, right: DataFrame, page: str, cell: int = 256) -> DataFrame:
    """Pairs of overlapping boxes of the same page, left columns ``a_*`` and right ``b_*``.

    A page is cut into grid cells and the join runs on (page, cell), so a crowded page is
    spread over many tasks and only near boxes meet.  A pair that shares several cells is
    produced once, in the cell that holds the corner of its intersection.  Boxes over very many cells are
    not cut; they meet the boxes of their page, and adaptive skew splitting divides those.
    """
    a = _cells(_prefixed(left, "a_", [page]), "a_", cell, 1)
    b = _cells(_prefixed(right, "b_", [page]), "b_", cell, 2)
    corner = (F.col("__cx") == F.floor(F.greatest("a_x", "b_x") / cell)) & (
        F.col("__cy") == F.floor(F.greatest("a_y", "b_y") / cell)
    )
    met = a.join(b, [page, "__cx", "__cy", "__side"]).filter((corner | (F.col("__side") > 0)) & overlaps("a_", "b_"))
    return met.drop("__cx", "__cy", "__side")


def overlap_pairs(boxes: DataFrame, page: str, ident: str, cell: int = 256) -> DataFrame:
    """Each unordered pair of overlapping boxes of a page once, with ``iou`` and both containment shares."""
    pairs = overlap_join(boxes, boxes, page, cell).filter(F.col(f"a_{ident}") < F.col(f"b_{ident}"))
    pairs = pairs.withColumn("shared", intersection_area("a_", "b_"))
    return (
        pairs.withColumn("iou", iou("a_", "b_", F.col("shared")))
        .withColumn("a_in_b", contained_share("a_", "b_", F.col("shared")))
        .withColumn("b_in_a", contained_share("b_", "a_", F.col("shared")))
    )


def box_classes(boxes: DataFrame, page: str, ident: str) -> DataFrame:
    """Classes of equal boxes of a page: smallest member as ``class_id``, the box, and how many ``copies`` there are."""
    return boxes.groupBy(page, *BOX).agg(F.min(ident).alias("class_id"), F.count("*").alias("copies"))


def class_members(boxes: DataFrame, classes: DataFrame, page: str, ident: str) -> DataFrame:
    """Link table of ``box_classes``: one row per box."""
    return boxes.select(page, ident, *BOX).join(classes.drop("copies"), [page, *BOX]).select(page, "class_id", ident)


def class_pairs(classes: DataFrame, page: str, cell: int = 256) -> DataFrame:
    """Overlaps between classes of equal boxes, and of a class with itself where it has copies.

    A stack of n equal boxes gives one row, not n * n / 2; ``pairs`` is the number of pairs of boxes that a row stands for.
    """
    across = overlap_pairs(classes, page, "class_id", cell).select(
        page, "a_class_id", "b_class_id", (F.col("a_copies") * F.col("b_copies")).alias("pairs"), "iou", "a_in_b", "b_in_a"
    )
    stacked = classes.filter((F.col("copies") > 1) & (F.col("width") > 0) & (F.col("height") > 0))
    n = F.col("copies")
    same = stacked.select(
        page, F.col("class_id").alias("a_class_id"), F.col("class_id").alias("b_class_id"),
        F.floor(n * (n - 1) / 2).alias("pairs"), *[F.lit(1.0).alias(c) for c in ("iou", "a_in_b", "b_in_a")],
    )
    return across.unionByName(same)


def clamp(x: Column, y: Column, width: Column, height: Column, frame_w: Column, frame_h: Column) -> list[Column]:
    """Box rounded (half up) and forced into the frame; at least one pixel in each direction."""
    cx = F.greatest(F.lit(0.0), F.least(round_half_up(x), frame_w))
    cy = F.greatest(F.lit(0.0), F.least(round_half_up(y), frame_h))
    cw = F.greatest(F.lit(1.0), F.least(round_half_up(width), frame_w - cx))
    ch = F.greatest(F.lit(1.0), F.least(round_half_up(height), frame_h - cy))
    return [cx.alias("x"), cy.alias("y"), cw.alias("width"), ch.alias("height")]


def pad(margin: float = 4.0) -> list[Column]:
    """Redaction box around a region; the origin does not leave the frame, the size always grows."""
    return [
        F.greatest(F.lit(0.0), F.col("x") - margin).alias("x"),
        F.greatest(F.lit(0.0), F.col("y") - margin).alias("y"),
        (F.col("width") + 2 * margin).alias("width"),
        (F.col("height") + 2 * margin).alias("height"),
    ]


def enclosing(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest box around all boxes of a group (combined on the map side)."""
    agg = boxes.groupBy(*keys).agg(
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        F.max(F.col("x") + F.col("width")).alias("__r"),
        F.max(F.col("y") + F.col("height")).alias("__b"),
        F.count("*").alias("boxes"),
    )
    return agg.select(
        *keys, "x", "y", (F.col("__r") - F.col("x")).alias("width"), (F.col("__b") - F.col("y")).alias("height"), "boxes"
    )


def stack_rank(boxes: DataFrame, page: str, order: str) -> DataFrame:
    """Number of earlier boxes in the same 10-pixel cell."""
    cell = [page, round_half_up(F.col("x") / 10), round_half_up(F.col("y") / 10)]
    rank = F.row_number().over(Window.partitionBy(*cell).orderBy(order)) - 1
    return boxes.filter((F.col("width") > 0) & (F.col("height") > 0)).withColumn("stack_rank", rank.cast("long"))


def islands(df: DataFrame, keys: list[str], low: Column, high: Column, out: str) -> DataFrame:
    """Number the maximal runs of intervals that touch each other within ``keys``.

    Boxes of different runs can never meet, however much the clusters inside a run grow, so
    greedy reductions may treat every run on its own.  Intervals are first widened to whole
    pixels and reduced to one row per starting pixel (combined on the map side), so the
    window that finds the gaps sees at most as many rows as the page has pixels along the
    axis - not the boxes of a crowded page.
    """
    work = df.withColumn("__lo", F.floor(low))
    points = work.groupBy(*keys, "__lo").agg(F.max(F.ceil(high)).alias("__hi"))
    w = Window.partitionBy(*keys).orderBy("__lo")
    reach = F.max("__hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = points.withColumn("__new", F.when(reach.isNull() | (F.col("__lo") >= reach), 1).otherwise(0))
    number = F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return work.join(flagged.select(*keys, "__lo", number.alias(out)), [*keys, "__lo"]).drop("__lo")


def _regular() -> Column:
    """Whether a box is far from the limits of numbers, where a box may meet others without sharing a pixel with them."""
    plain = [F.abs(F.col(c)) < 2.0**52 for c in BOX] + [F.col(c) > 2.0**-52 for c in ("width", "height")]
    return reduce(lambda a, b: a & b, plain)


def _placed(keys: list[str]) -> Column:
    """Whether a box has no area, or its keys and its place are known."""
    solid = (F.col("width") > 0) & (F.col("height") > 0)
    known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, "x", "y")])
    return ~solid | (solid & known)


def _crowded(boxes: DataFrame, keys: list[str], whole: int) -> DataFrame:
    """(keys, __n): pages that are not reduced at once, with their number of boxes."""
    odd = (F.col("width") > 0) & (F.col("height") > 0) & ~_regular()
    sizes = boxes.groupBy(*keys).agg(F.count("*").alias("__n"), F.count_if(odd).alias("__odd"))
    return sizes.filter((F.col("__n") > whole) | (F.col("__odd") > 0)).select(*keys, "__n")


def _independent(boxes: DataFrame, keys: list[str]) -> DataFrame:
    across = islands(boxes, keys, F.col("x"), F.col("x") + F.col("width"), "__ix")
    return islands(across, [*keys, "__ix"], F.col("y"), F.col("y") + F.col("height"), "__iy")


def _kept(boxes: str, threshold: float) -> str:
    """Greedy suppression of an array of solid boxes, the strongest first; exact copies always fall."""
    meet = (
        "greatest(0D, least(k.x + k.w, b.x + b.w) - greatest(k.x, b.x))"
        " * greatest(0D, least(k.y + k.h, b.y + b.h) - greatest(k.y, b.y))"
    )
    copy = "(k.x = b.x and k.y = b.y and k.w = b.w and k.h = b.h)"
    return (
        f"aggregate({boxes}, slice({boxes}, 1, 0), (kept, b) -> if(exists(kept, k -> "
        f"({meet}) / (k.w * k.h + b.w * b.h - ({meet})) > {threshold} or {copy}), kept, concat(kept, array(b))))"
    )


def _fold(regions: DataFrame, keys: list[str], order: str, threshold: float, region: tuple[str, ...] = ("__ix", "__iy")) -> DataFrame:
    """Greedy suppression inside each independent region, in one array; boxes without an area stay."""
    def number(c: str) -> str:
        return f"{c} + 0D" if regions.schema[c].dataType.simpleString() == "double" else c  # there is one zero

    x, y, w, h = map(number, BOX)
    entry = f"named_struct('r', -confidence, 'o', {order}, 'x', {x}, 'y', {y}, 'w', {w}, 'h', {h})"
    grouped = regions.groupBy(*keys, *region).agg(F.expr(f"array_sort(collect_list({entry}))").alias("b"))
    parts = grouped.select(*keys, F.expr("filter(b, k -> k.w > 0 and k.h > 0)").alias("s"), F.expr("filter(b, k -> not (k.w > 0 and k.h > 0))").alias("f"))
    rows = parts.select(*keys, F.explode(F.concat(F.expr(_kept("s", threshold)), "f")).alias("k"))
    k = F.col("k")
    return rows.select(
        *keys, k["x"].alias("x"), k["y"].alias("y"), k["w"].alias("width"), k["h"].alias("height"),
        (-k["r"]).alias("confidence"), k["o"].alias(order),
    )


_SLACK = 1e-6  # widens ranges against rounding; what is found in them is checked exactly


def _band(size: Column) -> Column:
    return F.floor(F.log2(size) + _SLACK).cast("int")


def _place(center: Column, band: Column) -> Column:
    return F.floor(center / F.pow(F.lit(2.0), band)).cast("long")


def _around(p: str, size: str, threshold: float) -> Column:
    """Bands and places, along one axis, of all boxes that can reach the threshold with a box.

    Sides of such boxes differ by less than the factor 1 / threshold, and their centres by less than
    (1 - threshold) of the longer side.
    """
    w, center = F.col(size), F.col(p) + F.col(size) / 2
    ratio = math.log2(threshold)
    bands = F.sequence(
        F.floor(F.log2(w) + ratio - _SLACK).cast("int"), F.floor(F.log2(w) - ratio + 3 * _SLACK).cast("int")
    )

    def places(band: Column) -> Column:
        longest = F.greatest(w, F.least(F.pow(F.lit(2.0), band + 1), w / threshold))
        reach = longest * (1 - threshold) * (1 + _SLACK) + _SLACK
        cells = F.sequence(_place(center - reach, band), _place(center + reach, band))
        return F.transform(cells, lambda g: F.struct(band.alias("band"), g.alias("place")))

    return F.flatten(F.transform(bands, places))


def _conflicts(live: DataFrame, keys: list[str], order: str, threshold: float) -> DataFrame:
    """(leader, box) for every undecided box that a bucket's strongest box is in conflict with, itself included.

    Buckets are made of boxes of like sides and centres; each has one leader, found by an aggregation, so a box meets
    a bounded number of leaders however crowded the place is.
    """
    rank = F.struct((-F.col("confidence")).alias("r"), F.col(order).alias("o"), *BOX)
    bucket = [
        _band(F.col("width")).alias("__bw"), _place(F.col("x") + F.col("width") / 2, _band(F.col("width"))).alias("__gx"),
        _band(F.col("height")).alias("__bh"), _place(F.col("y") + F.col("height") / 2, _band(F.col("height"))).alias("__gy"),
    ]
    boxes = live.select(*keys, *bucket, rank.alias("u"))
    leaders = boxes.groupBy(*keys, "__bw", "__gx", "__bh", "__gy").agg(F.min("u").alias("leader")).select(*keys, "leader", "leader.*")
    wide = leaders.select(*keys, "leader", "y", "height", F.explode(_around("x", "width", threshold)).alias("__h"))
    probes = wide.select(*keys, "leader", "__h", F.explode(_around("y", "height", threshold)).alias("__v")).select(
        *keys, "leader", F.col("__h.band").alias("__bw"), F.col("__h.place").alias("__gx"),
        F.col("__v.band").alias("__bh"), F.col("__v.place").alias("__gy"),
    )
    meet = reduce(
        lambda a, b: a * b,
        [
            F.greatest(F.lit(0.0), F.least(F.col(f"leader.{p}") + F.col(f"leader.{q}"), F.col(f"u.{p}") + F.col(f"u.{q}"))
                       - F.greatest(f"leader.{p}", f"u.{p}"))
            for p, q in (("x", "width"), ("y", "height"))
        ],
    )
    both = F.col("leader.width") * F.col("leader.height") + F.col("u.width") * F.col("u.height")
    met = boxes.join(probes, [*keys, "__bw", "__gx", "__bh", "__gy"]).filter(meet / (both - meet) > threshold)
    return met.select(*keys, "leader", "u")


def _in_rounds(live: DataFrame, keys: list[str], order: str, threshold: float, region: int) -> DataFrame:
    """Greedy suppression of crowded regions, in rounds over all of them at once.

    A leader that is in conflict with no stronger undecided box stays, and what it is in conflict with falls; this is what the
    greedy order does to them, too.  What is left falls apart into regions; those of at most ``region`` boxes are folded.
    """
    parts = []
    where = [*keys, "__ix", "__iy"]
    while True:
        regions = checkpointed(_independent(live, keys))
        sizes = checkpointed(regions.groupBy(*where).agg(F.count("*").alias("__n")).filter(F.col("__n") > region).select(*where))
        parts.append(_fold(regions.join(sizes, where, "left_anti"), keys, order, threshold))
        if sizes.isEmpty():
            return reduce(DataFrame.unionByName, parts)
        crowded = regions.join(sizes, where, "left_semi").drop("__ix", "__iy")
        found = checkpointed(_conflicts(crowded, keys, order, threshold))
        strongest = found.groupBy(*keys, "leader").agg(F.min("u").alias("__best"))
        winners = checkpointed(strongest.filter(F.col("__best") == F.col("leader")).select(*keys, "leader"))
        names = ["x", "y", "width", "height"]
        parts.append(winners.select(*keys, *[F.col(f"leader.{c}").alias(c) for c in names],
                                    (-F.col("leader.r")).alias("confidence"), F.col("leader.o").alias(order)))
        gone = found.join(winners, [*keys, "leader"], "left_semi").select(*keys, *[F.col(f"u.{c}").alias(c) for c in names]).distinct()
        live = crowded.join(gone, [*keys, *names], "left_anti")


def suppress(boxes: DataFrame, page: str, order: str, threshold: float = 0.5, region: int = REGION) -> DataFrame:
    """Non-maximum suppression per page and type: most confident first, ``order`` breaks ties.

    Pages of at most ``WHOLE`` boxes are reduced at once, one array for each type.  In others, exact copies fall to their
    best copy by an aggregation first, and the greedy rest runs inside independent regions only.  Regions
    of more than ``region`` distinct boxes are reduced in rounds, spread over tasks; whether there are such pages is counted
    before the plan is made.  ``threshold`` lies between 0 and 1.
    """
    if not 0 < threshold < 1:
        raise ValueError("the threshold of a suppression lies between 0 and 1")
    keys = [page, "type"]
    pick = F.min_by(F.struct("confidence", order), F.struct(-F.col("confidence"), F.col(order)))
    solid = (F.col("width") > 0) & (F.col("height") > 0)
    placed = boxes.filter(_placed(keys)).select(*keys, *BOX, "confidence", order)
    crowded = _crowded(placed, [page], min(WHOLE, region))
    if crowded.isEmpty():
        return _fold(placed, keys, order, threshold, ())
    crowded = checkpointed(crowded.select(page))
    best = _fold(placed.filter(F.col(page).isNotNull()).join(crowded, page, "left_anti"), keys, order, threshold, ())
    many = placed.join(crowded, page, "left_semi").unionByName(placed.filter(F.col(page).isNull()))
    copies = many.filter(solid).groupBy(*keys, *BOX).agg(pick.alias("s"))
    copies = copies.select(*keys, *BOX, F.col("s.confidence").alias("confidence"), F.col(f"s.{order}").alias(order))
    best = best.unionByName(many.filter(~solid))
    full = many.filter(solid).groupBy(*keys).agg(F.count("*").alias("__n")).filter(F.col("__n") > region).select(*keys)
    if full.isEmpty():
        return best.unionByName(_fold(_independent(copies, keys), keys, order, threshold))
    full = checkpointed(full)
    rest = _fold(_independent(copies.join(full, keys, "left_anti"), keys), keys, order, threshold)
    return best.unionByName(rest).unionByName(_in_rounds(copies.join(full, keys, "left_semi"), keys, order, threshold, region))


def _cluster_heads(x, y, r, b, ords) -> list[int]:
    """Cluster of each box of one independent region (boxes in candidate order), named after its first box."""
    n = len(ords)
    area = (r - x) * (b - y)
    head = np.full(n, -1, dtype=np.int64)
    for i in range(n):
        if head[i] >= 0:
            continue
        head[i] = ords[i]
        cx, cy, cr, cb = x[i], y[i], r[i], b[i]
        j = i + 1
        while j < n:
            inter = np.maximum(0, np.minimum(cr, r[j:]) - np.maximum(cx, x[j:])) * np.maximum(
                0, np.minimum(cb, b[j:]) - np.maximum(cy, y[j:])
            )
            own = (cr - cx) * (cb - cy)
            # Boxes and clusters have an area here, so no ratio divides by zero.
            joins = (inter / (own + area[j:] - inter) > 0.4) | (inter / area[j:] > 0.7) | (inter / own > 0.7)
            hits = np.flatnonzero(joins & (head[j:] < 0))
            if len(hits) == 0:
                break
            k = j + hits[0]
            head[k] = ords[i]
            cx, cy, cr, cb = min(cx, x[k]), min(cy, y[k]), max(cr, r[k]), max(cb, b[k])
            j = k + 1
    return head.tolist()


def _heads_batch(x: pd.Series, y: pd.Series, w: pd.Series, h: pd.Series, ords: pd.Series) -> pd.Series:
    return pd.Series(
        [None if o is None else _cluster_heads(a, b, a + c, b + d, o) for a, b, c, d, o in zip(x, y, w, h, ords)],
        dtype=object,
    )


def _page_heads(boxes: Iterator[tuple[float, float, float, float, int]]) -> list[int]:
    """The same for all boxes of a small page, in one pass: a box goes to the first cluster that takes it, or opens one.

    Flat boxes head themselves, and exact copies follow their first copy.
    """
    out, known, clusters = [], {}, []
    for x, y, w, h, o in boxes:
        if not (w and h and w > 0 and h > 0):
            out.append(o)
            continue
        head = known.get((x, y, w, h))
        if head is None:
            r, b = x + w, y + h
            area = (r - x) * (b - y)
            for c in clusters:
                cx, cy, cr, cb, own, name = c
                wide = (cr if cr < r else r) - (cx if cx > x else x)
                if wide <= 0:
                    continue
                high = (cb if cb < b else b) - (cy if cy > y else y)
                if high <= 0:
                    continue
                inter = wide * high
                if inter / (own + area - inter) > 0.4 or inter / area > 0.7 or inter / own > 0.7:
                    cx, cy, cr, cb = min(cx, x), min(cy, y), max(cr, r), max(cb, b)
                    c[:5] = cx, cy, cr, cb, (cr - cx) * (cb - cy)
                    head = name
                    break
            else:
                head = o
                clusters.append([x, y, r, b, area, o])
            known[x, y, w, h] = head
        out.append(head)
    return out


def _pages_batch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Heads of the boxes of each page (a list of structs); the boxes of a batch are read column by column."""
    for pages in batches:
        at = pages.value_lengths().fill_null(0).to_pylist()
        boxes = pages.flatten()
        rows = zip(*(boxes.field(c).to_pylist() for c in (*BOX, "ord")))
        heads = [_page_heads(islice(rows, n)) for n in at]
        yield pa.ListArray.from_arrays(pa.array([0, *accumulate(at)], pa.int32()), pa.array([h for page in heads for h in page], pa.int64()))


def _page_clusters(candidates: DataFrame, page: str) -> DataFrame:
    """The candidates of small pages with ``head``.  A page stays in its task from here to the regions."""
    entry = F.struct("ord", *BOX, "type", "source", "confidence", "placeholder")
    grouped = candidates.groupBy(page).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    heads = F.arrow_udf(_pages_batch, "array<bigint>")
    boxes = F.transform("e", lambda e: F.struct(*[e[c].alias(c) for c in BOX], e["ord"].cast("bigint").alias("ord")))
    named = grouped.withColumn("h", heads(boxes))
    rows = named.select(page, F.explode_outer(F.arrays_zip("e", "h")).alias("z")).select(page, "z.e.*", F.col("z.h").alias("head"))
    return rows.select(*candidates.columns, "head")


def _region_clusters(candidates: DataFrame, page: str) -> DataFrame:
    """The candidates of large pages with ``head``; only distinct boxes of one independent region meet in a task."""
    solid = (F.col("width") > 0) & (F.col("height") > 0)
    members = candidates.filter(solid)
    firsts = members.groupBy(page, *BOX).agg(F.min("ord").alias("ord"))
    regions = _independent(firsts, [page])
    entry = F.struct("ord", *BOX)
    grouped = regions.groupBy(page, "__ix", "__iy").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    heads = F.pandas_udf(_heads_batch, "array<bigint>")
    # Most regions hold one box, which heads itself; only the others are sent to Python.
    sent = [F.when(F.size("e") > 1, F.col(f"e.{c}")) for c in (*BOX, "ord")]
    named = grouped.withColumn("h", F.coalesce(heads(*sent), F.col("e.ord")))
    numbered = named.select(page, F.explode_outer(F.arrays_zip("e", "h")).alias("z")).select(
        page, *[F.col(f"z.e.{c}").alias(c) for c in BOX], F.col("z.h").alias("head")
    )
    flat = candidates.filter(~solid).withColumn("head", F.col("ord").cast("bigint"))
    return members.join(numbered, [page, *BOX]).select(*candidates.columns, "head").unionByName(flat)


def fuse(candidates: DataFrame, page: str) -> DataFrame:
    """Greedy fusion of overlapping detections of all sources, in candidate order.

    A candidate joins the cluster being built when IoU > 0.4 or either box holds more than
    70 % of the other; the cluster box grows while the page is scanned once.  Only the
    cluster membership is sequential, and only among distinct boxes of one independent
    region, or of a page of at most ``WHOLE`` candidates; whether there are larger pages is counted before the plan is made.
    Exact copies always follow their first copy, and everything else (enclosing
    box, best type, confidence, sources) is an ordinary aggregation afterwards.

    Expects ``page``, ``ord`` (unique per page), ``type``, ``source``, ``confidence`` and the
    box columns; ``placeholder``, where there is one, goes to the region with the type of its candidate.
    """
    given = F.col("placeholder") if "placeholder" in candidates.columns else F.lit(None).cast("string")
    candidates = candidates.select(page, "ord", *BOX, "type", "source", "confidence", given.alias("placeholder"))
    placed = candidates.filter(_placed([page]))
    crowded = _crowded(placed, [page], WHOLE)
    if crowded.isEmpty():
        clustered = _page_clusters(placed, page)
    else:
        crowded = checkpointed(crowded.select(page))
        few = placed.filter(F.col(page).isNotNull()).join(crowded, page, "left_anti")
        many = placed.join(crowded, page, "left_semi").unionByName(placed.filter(F.col(page).isNull()))
        clustered = _page_clusters(few, page).unionByName(_region_clusters(many, page))
    priority = F.create_map(*[F.lit(v) for kv in PRIORITY.items() for v in kv])
    rank = F.struct(-F.coalesce(F.try_element_at(priority, F.col("type")), F.lit(0)), F.col("ord"))
    top = clustered.groupBy(page, "head").agg(
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        F.max(F.col("x") + F.col("width")).alias("__r"),
        F.max(F.col("y") + F.col("height")).alias("__b"),
        F.min_by(F.struct("type", "placeholder"), rank).alias("__best"),
        F.round(F.max("confidence"), 2).alias("confidence"),
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.count("*").alias("members"),
    )
    return top.select(
        page, F.col("head").alias("region"), "x", "y",
        (F.col("__r") - F.col("x")).alias("width"), (F.col("__b") - F.col("y")).alias("height"),
        F.col("__best.type").alias("type"), "confidence", "sources", "members", F.lit(False).alias("redacted"),
        F.coalesce(F.when(F.col("__best.placeholder") != "", F.col("__best.placeholder")), type_placeholder(F.col("__best.type"))).alias("placeholder"),
    )


def eye_band(extension: float = 0.38, thickness_ratio: float = 0.36) -> list[Column]:
    """Privacy band over the eyes of a face box (``x, y, width, height, roll`` in radians)."""
    x, y, w, h, roll = (F.col(c) for c in ("x", "y", "width", "height", "roll"))
    px, py, eye_y = x + w / 2, y + h / 2, y + h * 0.40

    def turned(dx: Column) -> tuple[Column, Column]:
        ex, ey = dx - px, eye_y - py
        rx = round_half_up(px + (ex * F.cos(roll) - ey * F.sin(roll)))
        ry = round_half_up(py + (ex * F.sin(roll) + ey * F.cos(roll)))
        still = F.abs(roll) < 1e-6
        return F.when(still, dx).otherwise(rx), F.when(still, eye_y).otherwise(ry)

    lx, ly = turned(x + w * 0.33)
    rx, ry = turned(x + w * 0.67)
    dx, dy = rx - lx, ry - ly
    distance = F.greatest(F.lit(1.0), F.hypot(dx, dy))
    angle = F.atan2(dy, dx)
    cx, cy = round_half_up((lx + rx) / 2), round_half_up((ly + ry) / 2)
    length = round_half_up(distance + 2 * round_half_up(distance * extension))
    eye_height = F.greatest(F.lit(10.0), round_half_up(h * 0.12))
    face_height = F.when(h != 0, h).otherwise(distance * 2.2)
    thick = round_half_up(
        F.greatest(face_height * 0.22, distance * thickness_ratio, eye_height * 1.8, F.lit(18.0))
    )
    sx, sy = round_half_up(cx - length / 2 * F.cos(angle)), round_half_up(cy - length / 2 * F.sin(angle))
    ex, ey = round_half_up(cx + length / 2 * F.cos(angle)), round_half_up(cy + length / 2 * F.sin(angle))
    return [
        cx.alias("center_x"), cy.alias("center_y"), sx.alias("start_x"), sy.alias("start_y"),
        ex.alias("end_x"), ey.alias("end_y"), angle.alias("angle"), length.alias("length"), thick.alias("thickness"),
    ]


def visual_class(tag: Column, role: Column) -> list[Column]:
    """Visual class of an element and its confidence (NULL for other elements)."""
    t, r = F.lower(tag), F.lower(F.coalesce(role, F.lit("")))
    rules = [
        ((t == "form") | (r == "form"), "form", 0.95),
        ((t == "button") | (r == "button"), "button", 0.92),
        ((t == "table") | r.isin("table", "grid"), "table", 0.90),
        (r.isin("dialog", "alertdialog"), "dialog", 0.95),
        (t.isin("canvas", "svg"), "chart", 0.80),
        (t.isin("pre", "code"), "code", 0.88),
        (t.isin("input", "textarea", "select"), "input", 0.92),
    ]
    kind = conf = None
    for cond, name, c in rules:
        kind = F.when(cond, name) if kind is None else kind.when(cond, name)
        conf = F.when(cond, F.lit(c)) if conf is None else conf.when(cond, F.lit(c))
    return [kind.alias("visual_class"), conf.alias("class_confidence")]


def words_to_lines(words: DataFrame, page: str) -> DataFrame:
    """OCR words to text lines: top to bottom, a word joins while it is near the line's centre.

    A new line can only start below the reach of everything above it, so pages are first cut
    into independent vertical bands and the ordered fold sees one band at a time.
    """
    reach = F.col("y") + 2 * F.col("height") + 1
    bands = islands(words, [page], F.col("y"), reach, "__band")
    entry = "named_struct('y', y, 'x', x, 'o', ord, 'w', width, 'h', height, 't', text)"
    grouped = bands.groupBy(page, "__band").agg(F.expr(f"array_sort(collect_list({entry}))").alias("w"))
    box = "named_struct('x', w.x, 'y', w.y, 'w', w.w, 'h', w.h, 't', w.t)"
    fold = F.expr(
        f"aggregate(slice(transform(w, w -> {box}), 2, size(w)),"
        f" named_struct('done', slice(transform(w, w -> {box}), 1, 0), 'cur', element_at(transform(w, w -> {box}), 1)),"
        " (a, w) -> if(abs(w.y - (a.cur.y + a.cur.h / 2)) < a.cur.h * 0.6,"
        "  named_struct('done', a.done, 'cur', named_struct("
        "   'x', least(a.cur.x, w.x), 'y', a.cur.y,"
        "   'w', greatest(least(a.cur.x, w.x) + a.cur.w, w.x + w.w) - least(a.cur.x, w.x),"
        "   'h', greatest(a.cur.h, w.h), 't', concat(a.cur.t, ' ', w.t))),"
        "  named_struct('done', concat(a.done, array(a.cur)), 'cur', w)),"
        " a -> concat(a.done, array(a.cur)))"
    )
    line = F.col("l")
    rows = grouped.select(page, F.explode_outer(fold).alias("l")).filter(line.isNotNull())
    return rows.select(
        page, line["t"].alias("text"), line["x"].alias("x"), line["y"].alias("y"),
        line["w"].alias("width"), line["h"].alias("height"),
    )


