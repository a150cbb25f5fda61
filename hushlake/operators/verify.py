"""Proof that nothing raw is left: leak checks, payload policy, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions import catalog as C
from hushlake.functions.dims import EXCLUDED_CONTEXTS
from hushlake.functions.text import leak_preview, once, trim_spaces, url_ok, url_query
from hushlake.operators.spans import prompt_span_count, value_items, with_spans

VALUE_ATTRIBUTE = r"""(?i)value=["'][^"'\s\[\]]+["']"""


def value_attribute(html: Column) -> Column:
    return html.rlike(C.java(VALUE_ATTRIBUTE[4:], True))


def leak_check(payloads: DataFrame, items: DataFrame, key: str, payload: str) -> DataFrame:
    """Violations: a raw value of a scan found inside that scan's payload.

    Values are made distinct before the join, and the text leaves the plan right after it.
    A scan with very many values is split by adaptive skew handling, since the join is
    an ordinary equi-join on the scan.
    """
    raw = items.filter(
        (F.length("value") > 3) & ~F.col("value").isin("••••••••", "[face]")
    ).select(key, "type", "value").distinct()
    return (
        raw.join(payloads.select(key, payload), key)
        .filter(F.col(payload).contains(F.col("value")))
        .select(
            key,
            "type",
            F.concat(
                F.lit("Raw "), "type", F.lit(" value found: "), leak_preview(F.col("value"), 10, "…")
            ).alias("violation"),
        )
    )


def policy_violations(df: DataFrame, key: str) -> DataFrame:
    """Adds ``violations`` (ordered) and ``safe`` to outgoing payloads.

    Expects ``dom``, ``labels`` (array of selector/label structs), ``ocr``, ``task``,
    ``url`` and ``unredacted`` (number of sensitive regions without redaction).  All checks read
    one row, labels included, and add no shuffle; ``key`` is carried along, may repeat and may be NULL.
    """
    work = df.withColumn("__query", F.when(url_ok(F.col("url")), url_query(F.col("url"))))
    work = work.withColumn("__ocr", trim_spaces(F.col("ocr")))
    for col in ("dom", "ocr", "task", "__query"):
        work = with_spans(work, col, f"__{col}_spans")

    def label_violation(n: Column) -> Column:
        first = F.get(value_items(n["label"]), F.lit(0))["type"]
        return F.concat(F.lit("Raw "), first, F.lit(" found in accessibility label for selector "), n["selector"])

    long_labels = F.filter("labels", lambda n: F.length(n["label"]) > 4)
    labels = F.filter(F.transform(long_labels, label_violation), lambda m: m.isNotNull())

    none = F.expr("cast(array() as array<string>)")
    unredacted = F.when(
        F.col("unredacted") > 0,
        F.array(
            F.concat(
                F.lit("Unredacted sensitive regions detected: "),
                F.col("unredacted").cast("string"),
                F.lit(" region(s) missed pixel redaction"),
            )
        ),
    )
    dom = F.transform(
        "__dom_spans",
        lambda s: F.concat(
            F.lit("Raw "), s["type"], F.lit(" leaked into DOM skeleton: "), leak_preview(s["value"], 8)
        ),
    )
    attr = F.when(
        value_attribute(F.col("dom")), F.array(F.lit("Input value attribute detected in sanitized DOM structure"))
    )
    ocr = F.transform("__ocr_spans", lambda s: F.concat(F.lit("Raw "), s["type"], F.lit(" found in OCR text metadata")))
    task = F.transform(
        "__task_spans",
        lambda s: F.concat(
            F.lit("Raw "), s["type"], F.lit(" found in task description: "), leak_preview(s["value"], 8)
        ),
    )
    query = F.when(
        F.size("____query_spans") > 0,
        F.array(
            F.concat(
                F.lit("Sensitive parameter found in URL search query: "), F.get("____query_spans", F.lit(0))["type"]
            )
        ),
    )
    parts = [unredacted, dom, attr, labels, ocr, task, query]
    out = work.withColumn("violations", once(F.concat(*[F.coalesce(p, none) for p in parts])))
    return out.select(*df.columns, "violations", (F.size("violations") == 0).alias("safe"))


VIOLATION_TYPES = [
    (r"(?i)email", "EMAIL"),
    (r"(?i)aadhaar", "AADHAAR"),
    (r"(?i)pan", "PAN"),
    (r"(?i)card|credit", "CREDIT_CARD"),
    (r"(?i)password", "PASSWORD"),
    (r"(?i)phone", "PHONE"),
    (r"(?i)api[_\s]?key", "API_KEY"),
    (r"(?i)unredacted", "UNREDACTED_IMAGE"),
]


def violation_type(message: Column) -> Column:
    expr = None
    for pattern, name in VIOLATION_TYPES:
        cond = message.rlike(pattern)
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit("UNKNOWN"))


def split_quarantine(df: DataFrame, safe: str = "safe") -> tuple[DataFrame, DataFrame]:
    """(clean, quarantine); a row whose verdict is unknown is not clean."""
    ok = F.coalesce(F.col(safe), F.lit(False))
    return df.filter(ok), df.filter(~ok)


def fail_closed(df: DataFrame, safe: str = "safe") -> DataFrame:
    """Passes clean rows on and stops the job at the first row that is not."""
    ok = F.coalesce(F.col(safe), F.lit(False))
    return df.filter(F.when(ok, F.lit(True)).otherwise(F.raise_error(F.lit("POLICY_VIOLATION: unsafe payload")).cast("boolean")))


def residual_check(df: DataFrame, redacted: str, spans: str) -> DataFrame:
    """Adds ``originals_left``, ``residuals`` and ``verified`` to redacted texts.

    Verified means: there is a text, no original value is left in it, and a fresh scan with all rules finds
    nothing.
    """
    again = df.withColumn("__again", prompt_span_count(redacted))
    left = F.size(F.filter(spans, lambda s: F.col(redacted).contains(s["value"])))
    return (
        again.withColumn("originals_left", left.cast("long"))
        .withColumn("residuals", F.col("__again"))
        .withColumn("verified", F.col(redacted).isNotNull() & F.coalesce((F.col("originals_left") == 0) & (F.col("residuals") == 0), F.lit(False)))
        .drop("__again")
    )


def server_rule_hit(text: Column) -> Column:
    """First receiving-side rule that fires: its first six characters; NULL when clean."""
    hits = [F.regexp_extract(text, C.java(p), 0).substr(1, 6) for p in C.SERVER_RULES]
    return once(F.coalesce(*[F.nullif(h, F.lit("")) for h in hits]))


def context_allowed(context: Column) -> Column:
    return ~F.coalesce(F.upper(trim_spaces(context)).isin(EXCLUDED_CONTEXTS), F.lit(False))
