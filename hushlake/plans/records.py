"""Queries on scores, reports, logs, metadata and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushlake.functions import checks, dims
from hushlake.operators import audits, dedupe, evaluate, reports
from hushlake.operators.ordered import lag_sliced, lead_sliced
from hushlake.plans import sqlkit as K
from hushlake.plans.registry import query
from hushlake.sources.derived import SQL as _DERIVED
from hushlake.sources.derived import derive, duck
from hushlake.sources.tables import table
from hushlake.streaming import sessions, streams

ITEMS = duck("items")


def _items(spark, root):
    return derive(spark, root, "items")


def _types_list(kind: list[str]) -> str:
    return "(" + ", ".join(K.q(t) for t in kind) + ")"


# --- Dedupe ---------------------------------------------------------------------------
@query("dedupe_items", f"SELECT scan_id, type, selector, value, min(ord) AS ord FROM {ITEMS} i GROUP BY scan_id, type, selector, value")
def dedupe_items(spark, root):
    kept = dedupe.first_of_each(_items(spark, root), ["scan_id", "type", "selector", "value"], ["ord"])
    return kept.select("scan_id", "type", "selector", "value", "ord")


@query(
    "dominance_filter",
    f"""WITH i AS MATERIALIZED (SELECT * FROM {ITEMS} q) SELECT scan_id, ord, type, value FROM i a WHERE NOT EXISTS (SELECT 1 FROM i b WHERE b.scan_id = a.scan_id AND b.type = a.type AND b.ord <> a.ord
      AND ((b.selector = a.selector AND b.confidence > a.confidence) OR (contains(b.value, a.value) AND length(b.value) > length(a.value) AND b.confidence >= a.confidence)))""",
)
def dominance_filter(spark, root):
    """Detections that no better one of the same type makes superfluous."""
    return dedupe.drop_dominated(_items(spark, root), "scan_id").select("scan_id", "ord", "type", "value")


@query("auto_redact_status", f"SELECT scan_id, ord, CASE WHEN confidence >= 0.95 AND status = 'detected' THEN 'redacted' ELSE status END AS status FROM {ITEMS} i")
def auto_redact_status(spark, root):
    return dedupe.auto_redact(_items(spark, root)).select("scan_id", "ord", "status")


# --- Scores and reports ---------------------------------------------------------------
_WEIGHT = "CASE type " + " ".join(f"WHEN {K.q(t)} THEN {w}" for t, w in dims.WEIGHT.items()) + f" ELSE {dims.UNKNOWN_WEIGHT} END"
_RISK = f"""(SELECT scan_id, CASE WHEN s > 1 THEN 100 WHEN s = 1 THEN 80 WHEN ids THEN 75 WHEN pw AND mail THEN 40 WHEN pw THEN 25 WHEN mail THEN 15 ELSE w END AS risk_score, n AS detections
  FROM (SELECT scan_id, count(DISTINCT CASE WHEN type IN {_types_list(dims.SECRET_TYPES)} THEN type END) AS s, bool_or(type IN ('CARD', 'GOV_ID', 'AADHAAR', 'PAN')) AS ids,
    bool_or(type = 'PASSWORD') AS pw, bool_or(type = 'EMAIL') AS mail, max({_WEIGHT}) AS w, count(*) AS n FROM {ITEMS} i GROUP BY scan_id))"""


@query("risk_score", f"SELECT scan_id, CAST(risk_score AS BIGINT) AS risk_score, detections FROM {_RISK}")
def risk_score(spark, root):
    return reports.risk_scores(_items(spark, root), ["scan_id"]).select("scan_id", F.col("risk_score").cast("long").alias("risk_score"), "detections")


@query("risk_levels", f"SELECT CASE WHEN risk_score >= 70 THEN 'HIGH' WHEN risk_score >= 40 THEN 'MEDIUM' ELSE 'LOW' END AS level, count(*) AS scans FROM {_RISK} GROUP BY 1")
def risk_levels(spark, root):
    scores = reports.risk_scores(_items(spark, root), ["scan_id"])
    return scores.groupBy(reports.risk_level(F.col("risk_score")).alias("level")).agg(F.count("*").alias("scans"))


@query(
    "scan_report",
    f"""SELECT scan_id, CAST(sum(n) AS BIGINT) AS total, string_agg(type || '=' || CAST(n AS STRING), ',' ORDER BY type) AS categories, floor(sum(s) / (sum(n) * 1000) + 0.5) / 1000 AS confidence_avg,
      floor(min(m) * 1000 + 0.5) / 1000 AS confidence_min FROM (SELECT scan_id, type, count(*) AS n, sum(CAST(round(confidence * 1000000) AS BIGINT)) AS s, min(confidence) AS m FROM {ITEMS} i GROUP BY scan_id, type) GROUP BY scan_id""",
)
def scan_report(spark, root):
    """Report of each scan; the category map is written out as text for the comparison."""
    rows = reports.scan_reports(_items(spark, root), ["scan_id"])
    pairs = F.transform(F.map_entries("categories"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rows.select("scan_id", "total", F.array_join(pairs, ",").alias("categories"), "confidence_avg", "confidence_min")


@query(
    "category_counts",
    f"SELECT category, n, n / max(n) OVER () AS ratio FROM (SELECT t.category, count(*) AS n FROM {ITEMS} i JOIN {K.types()} t USING (type) GROUP BY t.category)",
)
def category_counts(spark, root):
    return reports.category_counts(_items(spark, root))


@query(
    "protection_stats",
    f"SELECT scan_id, count(*) FILTER (status IN ('redacted', 'blocked')) AS protected, count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (confidence < 0.8) AS warnings FROM {ITEMS} i GROUP BY scan_id",
)
def protection_stats(spark, root):
    return reports.protection_stats(_items(spark, root), ["scan_id"])


@query("scan_top5", f"SELECT scan_id, ord, replace(type, '_', ' ') || ' detected' AS action FROM {ITEMS} i QUALIFY row_number() OVER (PARTITION BY scan_id ORDER BY ord) <= 5")
def scan_top5(spark, root):
    first = reports.first_n(_items(spark, root), ["scan_id"], ["ord"], 5)
    return first.select("scan_id", "ord", F.concat(F.translate("type", "_", " "), F.lit(" detected")).alias("action"))


@query("latest_events", "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 6")
def latest_events(spark, root):
    """Newest six events of each user."""
    ev = table(spark, root, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"))
    return dedupe.latest_per_key(ev, ["user_id"], "at", 6).select("user_id", "event_id")


@query("audit_log", "SELECT event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 100")
def audit_log(spark, root):
    """Newest hundred records per kind of event, as the capped log shows them."""
    ev = table(spark, root, "events").select("event_type", "event_id", "ts", F.struct("ts", "event_id").alias("at"))
    return dedupe.latest_per_key(ev, ["event_type"], "at", 100).select("event_type", "event_id", "ts")


_STATS = """(SELECT event_type, count(*) AS samples, round(sum(CAST(round(value * 100) AS BIGINT)) / 100.0 / count(*), 3) AS mean,
  max(CASE WHEN rn = CAST(floor(n * 0.5) AS BIGINT) + 1 THEN value END) AS p50, max(CASE WHEN rn = CAST(floor(n * 0.9) AS BIGINT) + 1 THEN value END) AS p90,
  max(CASE WHEN rn = CAST(floor(n * 0.95) AS BIGINT) + 1 THEN value END) AS p95, min(value) AS min, max(value) AS max
  FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY event_type)"""


@query("latency_stats", f"SELECT event_type, samples, round(mean, 3) AS mean, round(p50, 3) AS p50, round(p90, 3) AS p90, round(p95, 3) AS p95, round(min, 3) AS min, round(max, 3) AS max FROM {_STATS}")
def latency_stats(spark, root):
    return reports.latency_stats(table(spark, root, "events"), ["event_type"], "value")


@query(
    "stage_totals",
    f"""SELECT round(l, 2) AS local_p50, round(r, 2) AS remote_p50, round(c, 2) AS client_p50, round(l + r + c, 2) AS total_p50 FROM (
      SELECT sum(CASE WHEN event_type IN ('view', 'error') THEN p50 ELSE 0 END) AS l, sum(CASE WHEN event_type IN ('purchase', 'signup') THEN p50 ELSE 0 END) AS r,
        sum(CASE WHEN event_type = 'click' THEN p50 ELSE 0 END) AS c FROM {_STATS})""",
)
def stage_totals(spark, root):
    """End-to-end composition with event kinds as stages."""
    stats = reports.latency_stats(table(spark, root, "events"), ["event_type"], "value").withColumnRenamed("event_type", "stage")
    return reports.stage_totals(stats, ["view", "error"], ["purchase", "signup"], ["click"])


@query(
    "latency_bands",
    "SELECT CASE WHEN value < 20 THEN 'fast' WHEN value < 100 THEN 'medium' ELSE 'slow' END AS band, count(*) AS n, min(value) AS lowest, max(value) AS highest FROM events GROUP BY 1",
)
def latency_bands(spark, root):
    ev = table(spark, root, "events")
    return ev.groupBy(reports.latency_band(F.col("value")).alias("band")).agg(
        F.count("*").alias("n"), F.min("value").alias("lowest"), F.max("value").alias("highest")
    )


@query(
    "stage_shares",
    """SELECT user_id, event_type, ms, round(ms / greatest(max(ms) OVER (PARTITION BY user_id), 1.0), 4) AS share,
      CASE WHEN ms < 20 THEN 'fast' WHEN ms < 100 THEN 'medium' ELSE 'slow' END AS band
    FROM (SELECT user_id, event_type, coalesce(max(value), 0.0) AS ms FROM events GROUP BY 1, 2)""",
)
def stage_shares(spark, root):
    """Users as scans, event kinds as stages."""
    return reports.stage_shares(table(spark, root, "events"), ["user_id"], "event_type", "value")


_LOG = """(SELECT event_type AS event, CASE event_id % 3 WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'AI_ASSISTANT' ELSE 'UNKNOWN' END AS context, event_id % 5 AS detections,
  event_id % 4 AS redactions, CASE WHEN event_id % 97 = 0 THEN 1 ELSE 0 END AS raw_transmitted, event_id % 97 <> 0 AS safe FROM events)"""


@query(
    "audit_rollup",
    f"SELECT event, context, count(*) AS records, CAST(sum(detections) AS BIGINT) AS detections, CAST(sum(redactions) AS BIGINT) AS redactions, CAST(sum(raw_transmitted) AS BIGINT) AS raw_transmitted,"
    f" round(avg(CASE WHEN safe THEN 1.0 ELSE 0.0 END), 6) AS safe_share, CAST(grouping_id(event, context) AS BIGINT) AS level FROM {_LOG} GROUP BY CUBE (event, context)",
)
def audit_rollup(spark, root):
    e = F.col("event_id")
    log = table(spark, root, "events").select(
        F.col("event_type").alias("event"), F.when(e % 3 == 0, "NORMAL").when(e % 3 == 1, "AI_ASSISTANT").otherwise("UNKNOWN").alias("context"),
        (e % 5).alias("detections"), (e % 4).alias("redactions"), F.when(e % 97 == 0, 1).otherwise(0).alias("raw_transmitted"), (e % 97 != 0).alias("safe"),
    )
    return reports.audit_rollup(log).withColumn("level", F.col("level").cast("long"))


_URLS = "'https://shop.example.com/' || event_type"


@query(
    "navigation_changes",
    f"SELECT user_id, event_id, url, previous FROM (SELECT user_id, event_id, {_URLS} AS url, lag({_URLS}) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) WHERE previous <> url",
)
def navigation_changes(spark, root):
    ev = table(spark, root, "events").select("user_id", "event_id", "ts", F.expr(_URLS).alias("url"))
    return reports.navigation_changes(ev, "user_id", ["ts", "event_id"], "url").select("user_id", "event_id", "url", "previous")


@query(
    "task_funnel",
    "SELECT event_type AS step, count(*) AS entered, count(next_ts) AS left_step, round(CAST(sum(CAST(epoch_us(next_ts) - epoch_us(ts) AS BIGINT)) AS DOUBLE) / count(next_ts) / 1000000, 3) AS avg_seconds, CAST(count(*) - count(next_ts) AS BIGINT) AS last_step"
    " FROM (SELECT event_type, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_ts FROM events) GROUP BY event_type",
)
def task_funnel(spark, root):
    """Progress log: how often a step was entered, left and was the last one, and how long it took."""
    ev = lead_sliced(table(spark, root, "events"), ["user_id"], ["ts", "event_id"], "ts", F.to_date("ts"), "next_ts")
    micros = F.unix_micros(F.col("next_ts").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))
    return ev.groupBy(F.col("event_type").alias("step")).agg(
        F.count("*").alias("entered"), F.count("next_ts").alias("left_step"),
        F.round(F.sum(micros).cast("double") / F.count("next_ts") / 1000000, 3).alias("avg_seconds"),
        (F.count("*") - F.count("next_ts")).alias("last_step"),
    )


# --- Evaluation -----------------------------------------------------------------------
_CASES = "(SELECT o_orderkey AS doc_id, text, o_orderkey % 32 < 30 AS sensitive, CASE WHEN o_orderkey % 32 < 2 THEN 'PII' WHEN o_orderkey % 32 < 8 THEN 'GOV_ID' WHEN o_orderkey % 32 < 30 THEN 'CREDENTIAL' ELSE 'NON_SENSITIVE' END AS category FROM orders JOIN " + duck("notes") + " n ON n.doc_id = o_orderkey)"


def _eval_spans(src: str, text: str = "text", key: str = "doc_id") -> str:
    from hushlake.functions.catalog import EVAL_ALLOWLIST, evaluation_catalog

    return K.spans(src, key=key, text=text, detectors=evaluation_catalog(), exact_terms=list(EVAL_ALLOWLIST))


def _scored(tp: str, fp: str, fn: str) -> str:
    p, r = f"coalesce({tp} / nullif({tp} + {fp}, 0), 0)", f"coalesce({tp} / nullif({tp} + {fn}, 0), 0)"
    return f"round({p}, 4) AS precision, round({r}, 4) AS recall, round(coalesce(2 * {p} * {r} / nullif({p} + {r}, 0), 0), 4) AS f1"


@query(
    "detector_eval",
    f"""SELECT category, total, tp, fp, fn, tn, {_scored('tp', 'fp', 'fn')}, round((tp + tn) / total, 4) AS accuracy FROM (
      SELECT category, count(*) AS total, count(*) FILTER (sensitive AND hit) AS tp, count(*) FILTER (NOT sensitive AND hit) AS fp, count(*) FILTER (sensitive AND NOT hit) AS fn,
        count(*) FILTER (NOT sensitive AND NOT hit) AS tn FROM (SELECT c.*, s.doc_id IS NOT NULL AS hit FROM {_CASES} c LEFT JOIN (SELECT DISTINCT doc_id FROM ({_eval_spans(duck('notes'))})) s USING (doc_id)) GROUP BY ROLLUP (category))""",
)
def detector_eval(spark, root):
    """Confusion matrix of the evaluation rules on labelled notes."""
    found = evaluate.with_evaluation_spans(derive(spark, root, "notes"))
    k = F.col("doc_id") % 32
    category = F.when(k < 2, "PII").when(k < 8, "GOV_ID").when(k < 30, "CREDENTIAL").otherwise("NON_SENSITIVE")
    cases = found.select(category.alias("category"), (k < 30).alias("sensitive"), (F.size("spans") > 0).alias("detected"))
    return evaluate.detector_eval(cases)


_INJECT = "(SELECT doc_id, CAST(doc_id % 32 AS BIGINT) AS kind, '{\"dom\": \"<div>Secret: ' || text || '</div>\"}' AS text FROM " + duck("notes") + " n)"


@query(
    "leak_rate",
    f"SELECT kind, count(*) AS tested, count(s.doc_id) AS blocked, round(count(s.doc_id) / count(*), 4) AS block_rate FROM {_INJECT} i LEFT JOIN (SELECT DISTINCT doc_id FROM ({_eval_spans(_INJECT)})) s USING (doc_id) GROUP BY kind",
)
def leak_rate(spark, root):
    """Share of payloads stopped after a raw value was put into them."""
    notes = derive(spark, root, "notes").withColumn("kind", F.col("doc_id") % 32)
    return evaluate.leak_rate(notes, F.concat(F.lit('{"dom": "<div>Secret: '), "text", F.lit('</div>"}')))


@query("eval_load", "SELECT CAST(o_orderkey AS STRING) AS id, text FROM orders JOIN " + duck("notes") + " n ON n.doc_id = o_orderkey")
def eval_load(spark, root):
    """Cases written as JSON and read back through the case-file source."""
    from hushlake.sources.files import text_cases

    path = streams.shared_folder(spark, "cases")
    notes = derive(spark, root, "notes")
    notes.select(
        F.col("doc_id").cast("string").alias("id"), "text", F.lit("EMAIL").alias("expected_type"), F.lit(True).alias("sensitive"), F.lit("PII").alias("category")
    ).write.json(path)
    return text_cases(spark, path, lines=True).select("id", "text")


# --- Logs and metadata ----------------------------------------------------------------
ACTIONS = duck("actions")
_LOW = "lower(coalesce(selector, ''))"
_BAD = "coalesce(" + ", ".join(f"CASE WHEN contains({_LOW}, {K.q(p)}) THEN {K.q(p)} END" for p in dims.FORBIDDEN_SELECTOR_PARTS) + ")"
_SRV = " OR ".join(f"contains({_LOW}, {K.q(p)})" for p in dims.SERVER_FORBIDDEN_SELECTOR_PARTS)


@query(
    "action_audit",
    f"SELECT id, reason, reason IS NULL AS valid, server_rejects FROM (SELECT id, CASE WHEN action NOT IN {_types_list(dims.ALLOWED_ACTIONS)} THEN 'unsupported action: ' || action"
    f" WHEN {_BAD} IS NOT NULL THEN 'forbidden selector: ' || {_BAD} END AS reason, ({_SRV}) AS server_rejects FROM {ACTIONS} a)",
)
def action_audit(spark, root):
    return audits.validate_actions(derive(spark, root, "actions")).select("id", "reason", "valid", "server_rejects")


@query(
    "resolve_refs",
    f"SELECT a.id, coalesce(nullif(t.held, ''), nullif(a.text, ''), a.value, '') AS resolved FROM {ACTIONS} a LEFT JOIN {duck('tokens')} t USING (value_ref)",
)
def resolve_refs(spark, root):
    return audits.resolve_refs(derive(spark, root, "actions"), derive(spark, root, "tokens")).select("id", "resolved")


@query(
    "harden_actions",
    f"SELECT id, CASE WHEN p THEN 'LOCAL_PASSWORD' ELSE value_ref END AS value_ref, CASE WHEN p THEN NULL ELSE text END AS text FROM (SELECT *, contains({_LOW}, 'pass') AND coalesce(text, '') <> '' AND coalesce(value_ref, '') = '' AS p FROM {ACTIONS} a)",
)
def harden_actions(spark, root):
    return audits.harden_actions(derive(spark, root, "actions")).select("id", "value_ref", "text")


ATT = duck("attachments")
_PROBLEM = """CASE WHEN status = 'PROCESSING' THEN 'pending' WHEN status IN ('FAILED', 'BLOCKED') THEN 'blocked' WHEN status NOT IN ('VERIFIED', 'NO_FACES') THEN 'unverified'
  WHEN upload_hash IS NULL THEN 'no_upload' WHEN upload_hash IS DISTINCT FROM sanitized_hash THEN 'not_the_sanitized_file' WHEN status = 'VERIFIED' AND upload_hash = original_hash THEN 'raw_file'
  WHEN size <= 0 THEN 'empty' WHEN NOT starts_with(mime, 'image/') THEN 'not_an_image' WHEN status = 'VERIFIED' AND bands < faces THEN 'uncovered_face' END"""


@query(
    "attachment_gate",
    f"SELECT msg_id, count(*) AS attachments, count(p) AS problems, min(p) AS first_problem, count(p) = 0 AS allowed FROM (SELECT msg_id, {_PROBLEM} AS p FROM {ATT} a) GROUP BY msg_id",
)
def attachment_gate(spark, root):
    return audits.attachment_gate(derive(spark, root, "attachments"), "msg_id")


@query(
    "attachment_match",
    f"""WITH s AS (SELECT file_id, name, sanitized_hash AS sanitized, msg_id * 10000 + size AS seq FROM {ATT} a WHERE status = 'VERIFIED'),
      i AS (SELECT file_id, max(seq) AS seq FROM s GROUP BY file_id), n AS (SELECT name, max(seq) AS seq FROM s GROUP BY name)
    SELECT a.msg_id, a.file_id, a.name, i.seq AS by_id, CASE WHEN i.seq IS NULL THEN n.seq END AS by_name FROM {ATT} a LEFT JOIN i USING (file_id) LEFT JOIN n ON n.name = a.name""",
)
def attachment_match(spark, root):
    """Which sanitized file stands for each attachment: matched by id, else by name (shown by its sequence number)."""
    files = derive(spark, root, "attachments")
    seq = F.col("msg_id") * 10000 + F.col("size")
    done = files.filter("status = 'VERIFIED'").select("file_id", "name", seq.alias("seq"), seq.alias("sanitized"))
    out = audits.match_attachments(files.select("msg_id", "file_id", "name"), done)
    ids = done.select("file_id").distinct().withColumn("has_id", F.lit(True))
    out = out.join(ids, "file_id", "left")
    return out.select(
        "msg_id", "file_id", "name", F.when(F.col("has_id"), F.col("replacement")).alias("by_id"),
        F.when(F.col("has_id").isNull(), F.col("replacement")).alias("by_name"),
    )


# --- Event-driven operators in batch form ---------------------------------------------
@query(
    "debounce_sessions",
    """WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      g AS (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS grp FROM s)
    SELECT user_id, min(ts) AS "from", count(*) AS edits, max(ts) AS ts, arg_max(event_id, ts) AS event_id FROM g GROUP BY user_id, grp""",
)
def debounce_sessions(spark, root):
    """Bursts of edits per user (gap six hours on this log) and their last edit."""
    ev = table(spark, root, "events").select("user_id", "ts", "event_id")
    return streams.debounced(ev, ["user_id"], "ts", "6 hours", latest=["event_id"])


_EDITS = duck("edits")


@query(
    "changed_only",
    f"SELECT conv_id, turn, h AS hash FROM (SELECT conv_id, turn, h, lag(h) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM (SELECT conv_id, turn, {K.fnv1a('text')} AS h FROM {_EDITS} e)) WHERE b IS DISTINCT FROM h",
)
def changed_only(spark, root):
    hashed = derive(spark, root, "edits").select("conv_id", "turn", checks.fnv1a(F.col("text")).alias("hash"))
    before = lag_sliced(hashed, ["conv_id"], ["turn"], "hash", F.floor(F.col("turn") / 1024), "b")
    return before.filter(~F.col("b").eqNullSafe(F.col("hash"))).drop("b")


@query("latest_scan", f"SELECT conv_id, scan_id, turn FROM {_EDITS} e QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY scan_id DESC, turn DESC) = 1")
def latest_scan(spark, root):
    """Only the newest scan of a conversation counts."""
    edits = derive(spark, root, "edits").select("conv_id", "scan_id", "turn")
    best = edits.groupBy("conv_id").agg(F.max(F.struct("scan_id", "turn")).alias("m"))
    return best.select("conv_id", "m.scan_id", "m.turn")


@query(
    "deadline_join",
    """WITH p AS (SELECT user_id, event_id AS item, ts AS asked FROM events WHERE event_type = 'signup'), r AS (SELECT user_id, ts AS answered, CASE WHEN event_id % 4 = 0 THEN 'failed' ELSE 'sanitized' END AS outcome FROM events WHERE event_type = 'purchase')
    SELECT p.user_id, item, asked, min(answered) AS answered, coalesce(arg_min(outcome, answered), 'blocked') AS outcome FROM p LEFT JOIN r ON r.user_id = p.user_id AND answered >= asked AND answered <= asked + INTERVAL 7200 SECOND GROUP BY p.user_id, item, asked""",
)
def deadline_join(spark, root):
    """Outcome of each pending item within its time limit; no answer means blocked."""
    ev = table(spark, root, "events")
    pending = ev.filter("event_type = 'signup'").select("user_id", "ts", F.col("event_id").alias("item"))
    outcome = F.when(F.col("event_id") % 4 == 0, "failed").otherwise("sanitized")
    answers = ev.filter("event_type = 'purchase'").select("user_id", "ts", outcome.alias("outcome"))
    return reports.deadline(pending, answers, "user_id", "ts", 7200)


@query(
    "reset_on_navigate",
    "SELECT e.user_id, e.event_id FROM events e LEFT JOIN (SELECT user_id, max((ts, event_id)) AS last FROM events WHERE event_type = 'view' GROUP BY user_id) n USING (user_id) WHERE n.last IS NULL OR (e.ts, e.event_id) > n.last",
)
def reset_on_navigate(spark, root):
    """What is left of a tab's state after its last navigation."""
    ev = table(spark, root, "events").select("user_id", "event_id", "ts", "event_type")
    return reports.after_last_navigation(ev, "user_id", ["ts", "event_id"], F.col("event_type") == "view").select("user_id", "event_id")


@query(
    "cached_result",
    "WITH v AS (SELECT user_id, event_type AS url, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id, event_type), c AS (SELECT user_id, max_by(event_type, (ts, event_id)) AS url FROM events GROUP BY user_id)"
    " SELECT c.user_id, c.url, CASE WHEN c.url = 'error' THEN NULL ELSE v.event_id END AS cached FROM c LEFT JOIN v USING (user_id, url)",
)
def cached_result(spark, root):
    """Latest result of a tab if it belongs to the address the tab shows now."""
    ev = table(spark, root, "events").select("user_id", F.col("event_type").alias("url"), "event_id", F.struct("ts", "event_id").alias("at"))
    now = ev.groupBy("user_id").agg(F.max_by("url", "at").alias("url"))
    known = ev.filter("url <> 'error'").groupBy("user_id", "url").agg(F.max_by("event_id", "at").alias("cached"))
    return now.join(known, ["user_id", "url"], "left").select("user_id", "url", "cached")


# --- Streams --------------------------------------------------------------------------
@query("stream_detect", f"SELECT doc_id, type, value, start FROM ({K.spans('documents', types=['EMAIL', 'CARD', 'PHONE'])})")
def stream_detect(spark, root):
    """Streaming detection over the files of the table; equals the batch result."""
    docs = streams.read_stream(spark, root, "documents").select("doc_id", "text")
    found = streams.detect_stream(docs, ["doc_id"], types=["EMAIL", "CARD", "PHONE"])
    return streams.run_to_table(found.select("doc_id", "type", "value", "start")).drop("batch")


_EMPTY = "trim(text) = ''"
_GATE_SQL = f"""WITH e AS MATERIALIZED (SELECT conv_id * 1000000 + turn AS doc_id, * FROM {duck('drafts')} d),
      kept AS MATERIALIZED (SELECT * FROM {K.resolved(K.spans('e', prompt=True))}), red AS MATERIALIZED (SELECT * FROM {K.redacted('e', 'kept')}),
      again AS MATERIALIZED (SELECT doc_id, redacted AS text FROM red),
      l AS (SELECT s.doc_id, sum(CASE WHEN contains(t.redacted, s.value) THEN 1 ELSE 0 END) AS n FROM kept s JOIN red t USING (doc_id) GROUP BY s.doc_id),
      x AS (SELECT doc_id, count(*) AS n FROM ({K.spans('again', prompt=True)}) GROUP BY doc_id),
      f AS (SELECT doc_id, count(*) AS n FROM kept GROUP BY doc_id),
      v AS (SELECT e.*, r.redacted, coalesce(f.n, 0) AS findings, coalesce(l.n, 0) = 0 AND coalesce(x.n, 0) = 0 AS verified
        FROM e JOIN red r USING (doc_id) LEFT JOIN l USING (doc_id) LEFT JOIN x USING (doc_id) LEFT JOIN f USING (doc_id)),
      j AS (SELECT *, {K.fnv1a('text')} AS h, {K.fnv1a('redacted')} AS ch,
        CASE WHEN {_EMPTY} AND attachment_state = 'VERIFIED' THEN 'READY' WHEN {_EMPTY} THEN 'DISABLED' WHEN verified THEN 'READY' ELSE 'FAILED' END AS state,
        CASE WHEN attachment_state IN ('FAILED', 'PROCESSING') THEN 'ATTACHMENT_BLOCKED' WHEN {_EMPTY} AND attachment_state = 'VERIFIED' THEN 'ATTACHMENT_ONLY' WHEN {_EMPTY} THEN 'EMPTY'
          WHEN NOT verified THEN 'PLACEHOLDER_VERIFICATION_FAILED' WHEN findings > 0 THEN 'PRIVACY_VERIFIED' ELSE 'NO_SENSITIVE_DATA' END AS reason FROM v),
      p AS (SELECT *, reason IN ('ATTACHMENT_ONLY', 'PRIVACY_VERIFIED', 'NO_SENSITIVE_DATA') AS ok,
        sum(CASE WHEN moved THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS part FROM j),
      n AS (SELECT *, max(CASE WHEN NOT moved THEN scan_id END) OVER (PARTITION BY conv_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM p),
      a AS (SELECT *, NOT moved AND NOT coalesce(scan_id < newest, false) AS live FROM n),
      k AS (SELECT *, last_value(CASE WHEN live THEN [CASE WHEN ok THEN ch END] END IGNORE NULLS)
        OVER (PARTITION BY conv_id, part ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)[1] AS known FROM a)
    SELECT conv_id, turn, CASE WHEN moved THEN 'IDLE' WHEN NOT live THEN 'STALE' ELSE state END AS state,
      CASE WHEN moved THEN 'NAVIGATED' WHEN NOT live THEN 'STALE_SCAN' ELSE reason END AS reason, ok AND live AS allowed,
      live AND coalesce(known <> h, false) AS relocked FROM k"""


def _draft_stream(spark, root):
    return spark.sql(_DERIVED["drafts"], conversations=streams.read_stream(spark, root, "conversations"))


@query("send_gate", _GATE_SQL)
def send_gate(spark, root):
    """Live send gate over a log of drafts, with navigations and scans that finish late."""
    return streams.run_to_table(streams.send_gate(_draft_stream(spark, root), reset="moved")).drop("batch")


@query("send_gate_table", _GATE_SQL)
def send_gate_table(spark, root):
    """The gate's verdicts over a finished log, with windows."""
    drafts = derive(spark, root, "drafts")
    return streams.send_gate_table(drafts, "conv_id", "turn", "scan_id", F.floor(F.col("turn") / 1024), "moved")


@query(
    "stream_reset",
    "SELECT e.user_id, e.event_id FROM events e LEFT JOIN (SELECT user_id, max((ts, event_id)) AS last FROM events WHERE event_type = 'view' GROUP BY user_id) n USING (user_id) WHERE n.last IS NULL OR (e.ts, e.event_id) > n.last",
)
def stream_reset(spark, root):
    """What is left of a tab after its last navigation, kept as streaming state; idle tabs would expire on event time."""
    ev = streams.read_stream(spark, root, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    rows = sessions.tab_rows(ev.withColumn("nav", F.col("event_type") == "view"), "user_id", ["at", "event_id"], "nav")
    return sessions.current_rows(streams.run_to_table(rows), "user_id", ["at", "event_id"]).select("user_id", "event_id")


@query(
    "rolling_log",
    "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rank, event_id AS \"order\", event_type AS value, count(*) OVER (PARTITION BY user_id) AS total FROM events QUALIFY rank <= 10",
)
def rolling_log(spark, root):
    """Capped log and running total per user, kept as streaming state."""
    ev = streams.read_stream(spark, root, "events").select("user_id", "event_id", "event_type")
    out = streams.run_to_table(streams.rolling_log(ev, "user_id", "event_id", "event_type", 10), "update")
    newest = out.groupBy("user_id").agg(F.max("batch").alias("batch"))
    return out.join(newest, ["user_id", "batch"]).drop("batch")


@query(
    "stream_changed",
    f"SELECT conv_id, turn AS \"order\", h AS hash FROM (SELECT conv_id, turn, h, lag(h) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM (SELECT conv_id, turn, {K.fnv1a('text')} AS h FROM conversations)) WHERE b IS DISTINCT FROM h",
)
def stream_changed(spark, root):
    """Rows whose content changed, with the last fingerprint kept as streaming state."""
    conv = streams.read_stream(spark, root, "conversations").select("conv_id", "turn", checks.fnv1a(F.col("text")).alias("hash"))
    return streams.run_to_table(streams.changed_only(conv, "conv_id", "hash", "turn")).drop("batch")
