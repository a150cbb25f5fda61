"""Checks on logs and metadata: actions, references, attachments, request bodies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions import dims
from hushlake.functions.text import let, once
from hushlake.operators import boxes as B
from hushlake.operators.redact import replace_values
from hushlake.operators.spans import value_items, with_spans


def _any(conds: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds)


def validate_actions(actions: DataFrame) -> DataFrame:
    """Adds ``valid`` and ``reason``: known action, and no forbidden part in the selector (the first one is named)."""
    low = F.lower(F.coalesce("selector", F.lit("")))
    known = F.coalesce(F.col("action").isin(dims.ALLOWED_ACTIONS), F.lit(False))
    bad = F.coalesce(*[F.when(low.contains(p), F.lit(p)) for p in dims.FORBIDDEN_SELECTOR_PARTS])
    reason = F.when(~known, F.concat(F.lit("unsupported action: "), F.coalesce("action", F.lit("none")))).when(
        bad.isNotNull(), F.concat(F.lit("forbidden selector: "), bad)
    )
    server = _any([low.contains(p) for p in dims.SERVER_FORBIDDEN_SELECTOR_PARTS])
    return (
        actions.withColumn("reason", reason).withColumn("valid", F.col("reason").isNull())
        .withColumn("server_rejects", server)
    )


def confirmation_tiers(actions: DataFrame, targets: DataFrame | None = None, regions: DataFrame | None = None, page: str = "page_id") -> DataFrame:
    """Adds ``tier``: why an action needs a confirmation (NULL = it does not).

    ``targets`` (box of the target of each action) and ``regions`` (sensitive boxes) add the
    overlap rule; without them only the action itself is judged.
    """
    sel, ref = F.coalesce("selector", F.lit("")), F.upper(F.coalesce("value_ref", F.lit("")))
    overlap = F.lit(False)
    work = actions
    if targets is not None and regions is not None:
        hit = B.overlap_join(targets, regions, page).select(F.col("a_id").alias("id")).distinct()
        work = actions.join(hit.withColumn("__over", F.lit(True)), "id", "left")
        overlap = F.coalesce("__over", F.lit(False))
    target = F.lower(F.concat(sel, F.lit(" "), F.coalesce("target", F.lit(""))))
    server = _any([target.contains(w) for w in dims.SERVER_SENSITIVE_WORDS])
    tier = (
        F.when(F.col("requires_confirmation"), "requested").when(F.col("action") == "submit", "submit")
        .when(sel.rlike(dims.CONFIRM_CREDENTIAL) | ref.contains("PASSWORD") | ref.contains("PIN"), "credential")
        .when(sel.rlike(dims.CONFIRM_PAYMENT), "payment").when(sel.rlike(dims.CONFIRM_DESTRUCTIVE), "destructive")
        .when(overlap, "sensitive_region")
    )
    return work.select(
        *actions.columns, tier.alias("tier"), ((F.col("action") == "submit") | server).alias("server_confirms")
    )


def harden_actions(actions: DataFrame) -> DataFrame:
    """A plain text typed into a password target is replaced by a symbolic reference."""
    plain = (
        F.lower(F.coalesce("selector", F.lit(""))).contains("pass")
        & (F.coalesce("text", F.lit("")) != "")
        & (F.coalesce("value_ref", F.lit("")) == "")
    )
    return actions.withColumns({
        "value_ref": F.when(plain, "LOCAL_PASSWORD").otherwise(F.col("value_ref")),
        "text": F.when(plain, F.lit(None)).otherwise(F.col("text")),
    })


def resolve_refs(actions: DataFrame, tokens: DataFrame, allow_credentials: bool = True) -> DataFrame:
    """Value an action would use: the locally held one for its reference, else its text, else its value.

    ``tokens`` holds (value_ref, held); it joins by key, and adaptive execution broadcasts it
    when it is small.
    """
    out = actions.join(tokens, "value_ref", "left")
    held = F.when(F.lit(allow_credentials) & (F.col("held") != ""), F.col("held"))
    text = F.when(F.col("text") != "", F.col("text"))
    return out.withColumn("resolved", F.coalesce(held, text, F.col("value"), F.lit(""))).drop("held")


def match_attachments(files: DataFrame, sanitized: DataFrame) -> DataFrame:
    """Sanitized counterpart of each file, by id first and by name second."""
    by_id = sanitized.groupBy("file_id").agg(F.max_by("sanitized", "seq").alias("__by_id"))
    by_name = sanitized.groupBy("name").agg(F.max_by("sanitized", "seq").alias("__by_name"))
    out = files.join(by_id, "file_id", "left").join(by_name, "name", "left")
    return out.withColumn("replacement", F.coalesce("__by_id", "__by_name")).drop("__by_id", "__by_name")


def attachment_problem() -> Column:
    """First thing wrong with one attachment; NULL when it may be sent."""
    status = F.col("status")
    return (
        F.when(status == "PROCESSING", "pending").when(status.isin("FAILED", "BLOCKED"), "blocked")
        .when(~status.isin("VERIFIED", "NO_FACES"), "unverified").when(F.col("upload_hash").isNull(), "no_upload")
        .when(~F.col("upload_hash").eqNullSafe(F.col("sanitized_hash")), "not_the_sanitized_file")
        .when((status == "VERIFIED") & (F.col("upload_hash") == F.col("original_hash")), "raw_file")
        .when(F.col("size") <= 0, "empty").when(~F.col("mime").startswith("image/"), "not_an_image")
        .when((status == "VERIFIED") & (F.col("bands") < F.col("faces")), "uncovered_face")
    )


def attachment_gate(attachments: DataFrame, message: str) -> DataFrame:
    """A message may go out when all of its attachments may."""
    judged = attachments.withColumn("problem", attachment_problem())
    return judged.groupBy(message).agg(
        F.count("*").alias("attachments"), F.count("problem").alias("problems"),
        F.min("problem").alias("first_problem"), F.bool_and(F.col("problem").isNull()).alias("allowed"),
    )


def form_payload(fields: DataFrame, items: DataFrame, scan: str) -> DataFrame:
    """Form values with detected ones replaced by the placeholder of the field's name."""
    from hushlake.functions.placeholders import choose_placeholder

    first = items.groupBy(scan, "value").agg(F.min_by("type", "ord").alias("type"))
    out = fields.join(first, [scan, "value"], "left")
    return out.select(
        scan, "field", F.col("type").isNotNull().alias("replaced"),
        F.when(F.col("type").isNotNull(), choose_placeholder(F.col("type"), F.col("field"))).otherwise(F.col("value")).alias("output"),
    )


# A JSON string with its quotes.
JSON_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'


def repair_bodies(requests: DataFrame, body: str = "body") -> DataFrame:
    """Request bodies of any shape: an unsafe body is replaced by its sanitized form and flagged.

    Adds ``blocked``, ``held`` and ``sent_body``.  Every string of a JSON body is decoded, scanned for itself and
    written back in its place, so unknown fields, arrays, numbers and layout stay as they were.  What
    cannot be replaced holds the body back (``held``, ``sent_body`` NULL): a hit in a key or outside the strings,
    or a value that is still there afterwards.  A body that is not JSON is sanitized as text; a
    NULL body stays NULL.
    """
    strings = F.regexp_extract_all(body, F.lit(JSON_STRING), F.lit(0))
    work = requests.withColumn("__text", F.when(F.try_parse_json(body).isNull(), F.col(body)))
    work = work.withColumn("__between", F.when(F.col("__text").isNull(), F.split(body, JSON_STRING, -1)))
    decoded = F.transform(strings, lambda s: F.get(F.from_json(F.concat(F.lit("["), s, F.lit("]")), "array<string>"), F.lit(0)))
    work = work.withColumn("__strings", once(F.when(F.col("__text").isNull(), decoded)))
    work = work.withColumn("__items", once(F.transform("__strings", lambda s: value_items(s))))
    work = with_spans(work, "__text", "__text_items")

    def one(s: Column, i: Column) -> Column:
        items = F.get("__items", i)
        return F.when(F.size(items) > 0, replace_values(s, items)).otherwise(s)

    work = work.withColumn("__fixed", once(F.transform("__strings", one)))
    is_key = lambda i: F.coalesce(F.get("__between", i + 1).rlike(r"^\s*:"), F.lit(False))
    kept = F.exists(F.transform("__items", lambda x, i: (F.size(x) > 0) & (
        is_key(i) | F.exists(x, lambda s: F.get("__fixed", i).contains(s["value"]))
    )), lambda b: b)
    outside = F.exists("__between", lambda g: F.size(value_items(g)) > 0)
    json_hit = F.exists("__items", lambda x: F.size(x) > 0)
    work = work.withColumn("held", F.coalesce(kept | outside, F.lit(False)))

    def quoted(s: Column) -> Column:
        return let(F.to_json(F.array(s)), lambda q: q.substr(F.lit(2), F.length(q) - 2))

    # Arrays that are read by place are computed once; in a lambda they would be computed for every element again.
    written = let(strings, lambda original: F.transform(
        "__fixed", lambda s, i: F.when(F.size(F.get("__items", i)) > 0, quoted(s)).otherwise(F.get(original, i))
    ))
    sent_json = let(written, lambda w: F.array_join(F.transform("__between", lambda g, i: F.concat(g, F.coalesce(F.get(w, i), F.lit("")))), ""))
    text_hit = F.coalesce(F.size("__text_items"), F.lit(0)) > 0
    blocked = F.coalesce(json_hit, F.lit(False)) | text_hit | F.col("held")
    sent = (
        F.when(F.col("held"), F.lit(None)).when(text_hit, replace_values(F.col(body), F.col("__text_items")))
        .when(F.coalesce(json_hit, F.lit(False)), sent_json).otherwise(F.col(body))
    )
    return work.select(*requests.columns, blocked.alias("blocked"), "held", sent.alias("sent_body"))
