"""Scores, reports, statistics and logs over detections and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushlake.functions import dims
from hushlake.functions.text import preview, round_half_up, url_host, url_ok
from hushlake.operators.ordered import lag_sliced, row_number_sliced


def weight(type_: Column) -> Column:
    expr = None
    for w in sorted(set(dims.WEIGHT.values())):
        cond = type_.isin([t for t, v in dims.WEIGHT.items() if v == w])
        expr = F.when(cond, F.lit(w)) if expr is None else expr.when(cond, F.lit(w))
    return expr.otherwise(F.lit(dims.UNKNOWN_WEIGHT))


def risk_scores(items: DataFrame, keys: list[str]) -> DataFrame:
    """Risk of each scan from the types found in it.

    Detections are reduced to distinct types first, so the second step sees at most one row
    per scan and type however many detections a scan has.
    """
    types = items.groupBy(*keys, "type").agg(F.count("*").alias("__n"))
    t = F.col("type")
    agg = types.groupBy(*keys).agg(
        F.sum(t.isin(dims.SECRET_TYPES).cast("int")).alias("__secrets"),
        F.max(t.isin("CARD", "GOV_ID", "AADHAAR", "PAN").cast("int")).alias("__ids"),
        F.max((t == "PASSWORD").cast("int")).alias("__pw"),
        F.max((t == "EMAIL").cast("int")).alias("__mail"),
        F.max(weight(t)).alias("__weight"),
        F.sum("__n").alias("detections"),
    )
    score = (
        F.when(F.col("__secrets") > 1, 100).when(F.col("__secrets") == 1, 80).when(F.col("__ids") == 1, 75)
        .when((F.col("__pw") == 1) & (F.col("__mail") == 1), 40).when(F.col("__pw") == 1, 25)
        .when(F.col("__mail") == 1, 15).otherwise(F.col("__weight"))
    )
    return agg.select(*keys, F.least(score, F.lit(100)).cast("int").alias("risk_score"), "detections")


def risk_level(score: Column) -> Column:
    return F.when(score >= 70, "HIGH").when(score >= 40, "MEDIUM").otherwise("LOW")


def scan_reports(items: DataFrame, keys: list[str]) -> DataFrame:
    """Detections per scan: total, per-type counts (map), mean and lowest confidence to three places.

    Confidences are added as whole millionths, so the mean does not depend on the order in
    which partial sums meet.
    """
    micro = F.round(F.col("confidence") * 1000000).cast("long")
    per_type = items.groupBy(*keys, "type").agg(
        F.count("*").alias("n"), F.sum(micro).alias("s"), F.min("confidence").alias("m")
    )
    entries = F.array_sort(F.collect_list(F.struct("type", "n")))
    agg = per_type.groupBy(*keys).agg(
        F.sum("n").alias("total"), F.map_from_entries(entries).alias("categories"),
        F.sum("s").alias("__s"), F.min("m").alias("__m"),
    )
    return agg.select(
        *keys, "total", "categories",
        (round_half_up(F.col("__s") / (F.col("total") * 1000)) / 1000).alias("confidence_avg"),
        (round_half_up(F.col("__m") * 1000) / 1000).alias("confidence_min"),
    )


def website(url: Column) -> Column:
    """Host of an address; the address itself when it cannot be read."""
    return F.when(url_ok(url), url_host(url)).otherwise(url)


def category(type_: Column) -> Column:
    expr = None
    for c in dims.CATEGORY_ORDER:
        cond = type_.isin([t for t, v in dims.CATEGORY.items() if v == c])
        expr = F.when(cond, F.lit(c)) if expr is None else expr.when(cond, F.lit(c))
    return expr


def category_counts(items: DataFrame) -> DataFrame:
    """Non-empty categories with their share of the largest one (at most seven rows in the window)."""
    counts = items.groupBy(category(F.col("type")).alias("category")).agg(F.count("*").alias("n"))
    return counts.withColumn("ratio", F.col("n") / F.max("n").over(Window.partitionBy()))


def protection_stats(items: DataFrame, keys: list[str]) -> DataFrame:
    return items.groupBy(*keys).agg(
        F.count_if(F.col("status").isin("redacted", "blocked")).alias("protected"),
        F.count_if(F.col("status") == "blocked").alias("blocked"),
        F.count_if(F.col("confidence") < 0.8).alias("warnings"),
    )


def first_n(items: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """First ``n`` rows of each key; the group limit is applied before and after the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return items.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


#: Buckets of distinct values in a group when ranks are looked for.
BUCKETS = 128


def latency_stats(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, p50, p90, p95, min, max; a percentile is the value at rank floor(n*p) (from zero).  Null values don't count.

    Exact for groups of any size and any spread: values are counted first; a mergeable sketch of a group's distinct values
    gives the borders of buckets that hold about equally many, whatever the outliers; exact counts of the buckets tell in
    which one a rank lies, and only that bucket's values are sorted.  Borders only decide on the sizes, never on a result.
    """
    v = F.col("v")
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    shares = [i / BUCKETS for i in range(1, BUCKETS)]
    borders = counts.groupBy(*keys).agg(F.percentile_approx("v", shares, 10 * BUCKETS).alias("borders"))
    placed = counts.join(borders, keys).select(*keys, "v", "c", F.size(F.filter("borders", lambda x: x < v)).alias("b"))
    buckets = placed.groupBy(*keys, "b").agg(
        F.sum("c").alias("n"), F.sum(v * F.col("c")).alias("s"), F.min("v").alias("min"), F.max("v").alias("max")
    )
    groups = buckets.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("b", "n"))).alias("sizes"),  # at most BUCKETS of them
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("min").alias("min"), F.max("max").alias("max"),
    )
    start = F.struct(F.lit(0).alias("b"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("hi"))

    def bucket_of(k: Column) -> Column:
        """The bucket of rank ``k``, and how many values lie before it and up to its end."""
        return F.aggregate("sizes", start, lambda a, x: F.when(a["hi"] > k, a).otherwise(
            F.struct(x["b"].alias("b"), a["hi"].alias("lo"), (a["hi"] + x["n"]).alias("hi"))
        ))

    names = {"p50": 0.50, "p90": 0.90, "p95": 0.95}
    picks = [F.struct(F.lit(p).alias("name"), F.floor(F.col("n") * q).alias("k"), bucket_of(F.floor(F.col("n") * q)).alias("at")) for p, q in names.items()]
    wanted = groups.select(*keys, "n", "s", "min", "max", F.explode(F.array(*picks)).alias("w"))
    wanted = wanted.groupBy(*keys, F.col("w.at.b").alias("b"), F.col("w.at.lo").alias("lo")).agg(
        F.collect_list("w").alias("w"), *[F.first(c).alias(c) for c in ("n", "s", "min", "max")]
    )
    inside = Window.partitionBy(*keys, "b").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = placed.join(wanted, [*keys, "b"]).withColumn("to", F.col("lo") + F.sum("c").over(inside))
    hit = ranked.select("*", F.explode("w").alias("pick")).filter(
        (F.col("pick.k") < F.col("to")) & (F.col("pick.k") >= F.col("to") - F.col("c"))
    )
    out = hit.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("n", "s", "min", "max")],
        *[F.max(F.when(F.col("pick.name") == p, v)).alias(p) for p in names],
    )
    return out.select(
        *keys, F.col("n").alias("samples"), F.round(F.col("s") / F.col("n"), 3).alias("mean"),
        *[F.round(c, 3).alias(c) for c in (*names, "min", "max")],
    )


def stage_totals(stage_stats: DataFrame, local: list[str], remote: list[str], client: list[str]) -> DataFrame:
    """Composition of an end-to-end time from the median of each stage (few rows: one per stage)."""
    def part(stages: list[str]) -> Column:
        return F.coalesce(F.sum(F.when(F.col("stage").isin(stages), F.col("p50"))), F.lit(0.0))

    agg = stage_stats.groupBy().agg(
        part(local).alias("local_p50"), part(remote).alias("remote_p50"), part(client).alias("client_p50")
    )
    total = F.col("local_p50") + F.col("remote_p50") + F.col("client_p50")
    return agg.select(
        *[F.round(c, 2).alias(c) for c in ("local_p50", "remote_p50", "client_p50")], F.round(total, 2).alias("total_p50")
    )


def stage_shares(rows: DataFrame, scan: list[str], stage: str, ms: str) -> DataFrame:
    """Time of each stage of a scan, its share of the scan's slowest stage (of one millisecond at least) and its band.

    The slowest row of a stage counts, a missing time as 0.  Rows are brought to one per stage before the window over the scan.
    """
    stages = rows.groupBy(*scan, stage).agg(F.coalesce(F.max(ms), F.lit(0.0)).alias("ms"))
    slowest = F.greatest(F.max("ms").over(Window.partitionBy(*scan)), F.lit(1.0))
    return stages.withColumns({"share": F.round(F.col("ms") / slowest, 4), "band": latency_band(F.col("ms"))})


def latency_band(ms: Column) -> Column:
    return F.when(ms < 20, "fast").when(ms < 100, "medium").otherwise("slow")


def format_ms(ms: Column) -> Column:
    return (
        F.when(ms < 1, "<1ms").when(ms < 1000, F.concat(F.floor(ms + 0.5).cast("string"), F.lit("ms")))
        .otherwise(F.concat(F.format_number(ms / 1000, "0.00"), F.lit("s")))
    )


def explain(items: DataFrame, explanations: DataFrame, methods: DataFrame) -> DataFrame:
    """Why a detection was made, by which detector, how sure, and what to do about it."""
    out = items.join(F.broadcast(explanations), "type", "left").join(F.broadcast(methods), "method", "left")
    percent = F.floor(F.col("confidence") * 100 + 0.5).cast("string")
    why = F.coalesce("why", F.lit(dims.EXPLANATIONS["OTHER"][0]))
    rec = F.coalesce("recommendation", F.lit(dims.EXPLANATIONS["OTHER"][1]))
    reason = F.when(
        F.col("reliability").isNotNull(), F.concat(F.lit("Confidence "), percent, F.lit("% — "), F.col("reliability"))
    ).otherwise(F.concat(F.lit("Confidence: "), percent, F.lit("%")))
    return out.select(
        *items.columns, why.alias("why"), F.coalesce("detector", "method").alias("detector"),
        reason.alias("confidence_reason"), rec.alias("recommendation"),
    )


def enrich(items: DataFrame, types: DataFrame) -> DataFrame:
    """Weight, label, category and placeholders of each type (28 rows, broadcast) and a value preview."""
    return items.join(F.broadcast(types), "type", "left").withColumn("preview", preview(F.col("value")))


def payload_maps(items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Sanitized payload entries: key of the type, numbered from the second one on, and its placeholder.

    ``order`` is the whole-number position of a detection in its scan.
    Returns one row per entry; ``as_payload_map`` folds them into one map per scan.
    """
    from hushlake.functions.placeholders import choose_placeholder, payload_key

    sel = F.col("selector") if "selector" in items.columns else None
    keyed = items.withColumn("base", payload_key(F.col("type"), sel))
    keyed = row_number_sliced(keyed, [*keys, "base"], [order], F.floor(F.col(order) / 4096), "n")
    n = F.col("n")
    entry = F.when(n == 1, F.col("base")).otherwise(F.concat("base", F.lit("_"), n.cast("string")))
    return keyed.select(*keys, entry.alias("entry"), choose_placeholder(F.col("type"), F.col("base")).alias("placeholder"))


def as_payload_map(entries: DataFrame, keys: list[str]) -> DataFrame:
    return entries.groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("entry", "placeholder")))).alias("payload")
    )


def audit_rollup(log: DataFrame) -> DataFrame:
    """Totals of the audit log by event and context with subtotals (NULL = all)."""
    return log.cube("event", "context").agg(
        F.count("*").alias("records"),
        F.sum("detections").alias("detections"),
        F.sum("redactions").alias("redactions"),
        F.sum("raw_transmitted").alias("raw_transmitted"),
        F.round(F.avg(F.col("safe").cast("double")), 6).alias("safe_share"),
        F.grouping_id().cast("int").alias("level"),
    )


def navigation_changes(events: DataFrame, tab: str, ts: list[str], url: str) -> DataFrame:
    """Events at which the address of a tab differs from the one before (``ts``: time, then tie-breaks)."""
    day = F.to_date(ts[0])
    return lag_sliced(events, [tab], ts, url, day, "previous").filter(
        F.col("previous").isNotNull() & (F.col("previous") != F.col(url))
    )


def after_last_navigation(events: DataFrame, tab: str, order: list[str], is_nav: Column) -> DataFrame:
    """Rows of a tab behind its last navigation; tabs without one keep everything."""
    last = events.filter(is_nav).groupBy(tab).agg(F.max(F.struct(*order)).alias("__last"))
    joined = events.join(last, tab, "left")
    return joined.filter(F.col("__last").isNull() | (F.struct(*order) > F.col("__last"))).drop("__last")


def deadline(pending: DataFrame, results: DataFrame, key: str, ts: str, seconds: int) -> DataFrame:
    """Outcome of each pending item: the first result within the limit, otherwise blocked.

    Time is cut into slices as long as the limit, and a result is visible in its own slice
    and in the one before.  So the next result is looked up inside (key, slice), and neither
    a busy key nor a burst forms pairs.
    """
    slice_ = F.floor(F.unix_micros(F.col(ts).cast("timestamp")) / (seconds * 1_000_000))
    asked = pending.select(key, F.col(ts).alias("t"), "item", F.lit(None).cast("string").alias("outcome"), slice_.alias("s"))
    told = results.select(
        key, F.col(ts).alias("t"), F.lit(None).cast(pending.schema["item"].dataType).alias("item"), "outcome",
        F.explode(F.array(slice_, slice_ - 1)).alias("s"),
    )
    both = asked.unionByName(told)
    answer = F.when(F.col("item").isNull(), F.struct(F.col("t").alias("answered"), "outcome"))
    # From the latest row back, so that the frame only grows and each row is looked at once.
    ahead = Window.partitionBy(key, "s").orderBy(
        F.col("t").desc(), F.col("item").isNull().desc(), F.col("outcome").desc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("a", F.last(answer, ignorenulls=True).over(ahead)).filter(F.col("item").isNotNull())
    in_time = F.col("a.answered") <= F.col("t") + F.expr(f"interval {seconds} seconds")
    return found.select(
        "item", key, F.col("t").alias("asked"), F.when(in_time, F.col("a.answered")).alias("answered"),
        F.coalesce(F.when(in_time, F.col("a.outcome")), F.lit("blocked")).alias("outcome"),
    )
