"""Quality of detection and redaction against labelled cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions import catalog as C
from hushlake.operators import boxes as B
from hushlake.operators.spans import with_spans


def with_evaluation_spans(df: DataFrame, text: str = "text", out: str = "spans") -> DataFrame:
    """Detection with the evaluation's own rule table (strict checksum, short allowlist)."""
    return with_spans(
        df, text, out, detectors=C.evaluation_catalog(), allow_terms=list(C.EVAL_ALLOWLIST), exact_terms=True
    )


def _ratio(num: Column, den: Column) -> Column:
    return F.coalesce(num / F.nullif(den, F.lit(0)), F.lit(0.0))


def _scores(tp: Column, fp: Column, fn: Column) -> tuple[Column, Column, Column]:
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    f1 = F.coalesce(2 * precision * recall / F.nullif(precision + recall, F.lit(0.0)), F.lit(0.0))
    return precision, recall, f1


def detector_eval(cases: DataFrame) -> DataFrame:
    """Confusion matrix per category and overall (category NULL).  A sensitive case counts as found if anything fired.

    Expects ``category``, ``sensitive`` and ``detected``.
    """
    s, d = F.col("sensitive"), F.col("detected")
    agg = cases.rollup("category").agg(
        F.count("*").alias("total"), F.count_if(s & d).alias("tp"), F.count_if(~s & d).alias("fp"),
        F.count_if(s & ~d).alias("fn"), F.count_if(~s & ~d).alias("tn"),
    )
    precision, recall, f1 = _scores(F.col("tp"), F.col("fp"), F.col("fn"))
    return agg.select(
        "category", "total", "tp", "fp", "fn", "tn",
        F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"),
        F.round(_ratio(F.col("tp") + F.col("tn"), F.col("total")), 4).alias("accuracy"),
    )


def redaction_coverage(elements: DataFrame, redactions: DataFrame, page: str, ident: str, cell: int = 256) -> DataFrame:
    """Adds ``covered``: some redaction box of the page holds the element completely."""
    pairs = B.overlap_join(elements, redactions, page, cell).filter(B.covers("b_", "a_"))
    hit = pairs.select(page, F.col(f"a_{ident}").alias(ident)).distinct().withColumn("covered", F.lit(True))
    return elements.join(hit, [page, ident], "left").withColumn("covered", F.coalesce("covered", F.lit(False)))


def redaction_eval(covered: DataFrame) -> DataFrame:
    """Precision, recall and F1 of redaction: sensitive boxes covered, other boxes not."""
    s, c = F.col("sensitive"), F.col("covered")
    agg = covered.agg(
        F.count_if(s).alias("sensitive_regions"), F.count_if(s & c).alias("redacted"),
        F.count_if(s & ~c).alias("missed"), F.count_if(~s & c).alias("over_redacted"),
    )
    precision, recall, f1 = _scores(F.col("redacted"), F.col("over_redacted"), F.col("missed"))
    return agg.select(
        "*", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1")
    )


def structure_eval(elements: DataFrame) -> DataFrame:
    """Fidelity of the screen structure: 0.4 actionable recall + 0.3 role accuracy + 0.3 valid boxes."""
    tag = F.upper("tag")
    found = tag.isin("INPUT", "BUTTON", "A", "SELECT", "TEXTAREA")
    role = F.when(tag == "INPUT", "textbox").when(tag == "BUTTON", "button").when(tag == "A", "link").otherwise("paragraph")
    agg = elements.agg(
        F.count("*").alias("elements"),
        _ratio(F.count_if(F.col("actionable") & found), F.count_if(F.col("actionable"))).alias("r"),
        F.avg(F.coalesce(role == F.col("role"), F.lit(False)).cast("double")).alias("a"),
        F.avg(((F.col("width") > 0) & (F.col("height") > 0)).cast("double")).alias("v"),
    )
    return agg.select(
        "elements", F.round("r", 4).alias("actionable_recall"), F.round("a", 4).alias("role_accuracy"),
        F.round("v", 4).alias("valid_boxes"), F.round(F.col("r") * 0.4 + F.col("a") * 0.3 + F.col("v") * 0.3, 4).alias("fidelity"),
    )


def leak_rate(payloads: DataFrame, template: Column) -> DataFrame:
    """Share of payloads that are stopped once a raw value is put into them, per kind of value."""
    injected = payloads.withColumn("__text", template)
    return with_evaluation_spans(injected, "__text", "__hits").groupBy("kind").agg(
        F.count("*").alias("tested"), F.count_if(F.size("__hits") > 0).alias("blocked"),
    ).withColumn("block_rate", F.round(F.col("blocked") / F.col("tested"), 4))
