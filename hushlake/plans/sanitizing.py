"""Queries on placeholders, redaction, verification and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushlake.functions import catalog as C
from hushlake.functions import checks
from hushlake.functions import dims
from hushlake.functions import placeholders as P
from hushlake.functions import text as X
from hushlake.operators import audits, redact, reports, spans, verify
from hushlake.operators.ordered import lag_sliced
from hushlake.plans import sqlkit as K
from hushlake.plans.registry import query
from hushlake.sources.derived import derive, duck
from hushlake.sources.tables import table, texts

CORPUS = duck("corpus")
NOTES = duck("notes")
_PROMPT = K.spans(CORPUS, prompt=True)
_RESOLVED = K.resolved(_PROMPT)
_REDACTED = K.redacted(CORPUS, _RESOLVED)


@query(
    "redact_spans",
    f"SELECT doc_id, CAST(n AS BIGINT) AS spans, md5(redacted) AS digest, length(redacted) AS chars FROM {_REDACTED} WHERE n > 0",
)
def redact_spans(spark, root):
    """Exact spans replaced by prompt placeholders (compared by the digest of the whole text)."""
    done = redact.redact_prompts(derive(spark, root, "corpus"))
    n = F.size("spans").cast("long")
    return done.select("doc_id", n.alias("spans"), F.md5("redacted").alias("digest"), F.length("redacted").cast("long").alias("chars")).filter(
        "spans > 0"
    )


_ITEMS_SQL = K.spans(CORPUS, types=["EMAIL", "CARD", "PHONE", "OPENAI_KEY", "GITHUB_TOKEN", "GOOGLE_KEY", "POSTGRES_URL"])
_ITEM_TYPES = ["EMAIL", "CARD", "PHONE", "OPENAI_KEY", "GITHUB_TOKEN", "GOOGLE_KEY", "POSTGRES_URL"]


@query(
    "redact_values",
    f"SELECT doc_id, md5(sanitized) AS digest, length(sanitized) AS chars FROM {K.replaced(CORPUS, _ITEMS_SQL)} WHERE n > 0",
)
def redact_values(spark, root):
    """Every occurrence of the values of the given detections replaced, longest first."""
    found = spans.with_spans(derive(spark, root, "corpus"), types=_ITEM_TYPES).filter(F.size("spans") > 0)
    done = found.withColumn("s", redact.replace_values(F.col("text"), F.col("spans")))
    return done.select("doc_id", F.md5("s").alias("digest"), F.length("s").cast("long").alias("chars"))


_ALL = K.spans(CORPUS)


@query("sanitize_text", f"SELECT doc_id, md5(sanitized) AS digest FROM {K.replaced(CORPUS, _ALL)} ")
def sanitize_text(spark, root):
    """Detection and replacement in one step, all texts (unchanged ones too)."""
    done = redact.sanitize_text(derive(spark, root, "corpus"))
    return done.select("doc_id", F.md5("sanitized").alias("digest"))


_OCR = "(SELECT page_id * 100 + ord AS doc_id, text FROM " + duck("ocr_words") + " w)"


@query(
    "sanitize_ocr",
    f"SELECT doc_id, sanitized FROM {K.replaced(_OCR, K.spans(_OCR))}",
)
def sanitize_ocr(spark, root):
    words = derive(spark, root, "ocr_words").select((F.col("page_id") * 100 + F.col("ord")).alias("doc_id"), "text")
    return redact.sanitize_text(words).select("doc_id", "sanitized")


@query(
    "ocr_spans",
    f"SELECT s.doc_id, s.type, s.value, least(s.confidence, w.conf / 100) AS confidence FROM ({K.spans(_OCR)}) s"
    f" JOIN (SELECT page_id * 100 + ord AS doc_id, text, conf FROM {duck('ocr_words')} z) w USING (doc_id)"
    " WHERE w.conf >= 40 AND length(w.text) >= 3",
)
def ocr_spans(spark, root):
    """Detections on recognised words; the confidence is the lower of rule and recognition."""
    words = derive(spark, root, "ocr_words").filter((F.col("conf") >= 40) & (F.length("text") >= 3))
    words = words.select((F.col("page_id") * 100 + F.col("ord")).alias("doc_id"), "text", "conf")
    found = spans.explode_spans(spans.with_spans(words), ["doc_id", "conf"])
    return found.select("doc_id", "type", "value", F.least("confidence", F.col("conf") / 100).alias("confidence"))


_NESTED = (
    "(SELECT doc_id, text, 'ref ' || text AS a, 'x' AS b, CAST(doc_id AS STRING) AS c FROM " + NOTES + " n0)"
)
_N_ITEMS = K.spans(_NESTED)


@query(
    "sanitize_nested",
    f"SELECT t.doc_id, t.sanitized AS plain, a.sanitized AS inner_text, a.sanitized || '|x' AS list_text, t.sanitized AS map_text"
    f" FROM {K.replaced(_NESTED, _N_ITEMS)} t JOIN {K.replaced(_NESTED, _N_ITEMS, text='a')} a USING (doc_id)",
)
def sanitize_nested(spark, root):
    """Strings inside structs, arrays and maps of a record, replaced along the schema."""
    notes = derive(spark, root, "notes")
    found = spans.with_spans(notes)
    record = found.select(
        "doc_id", "spans",
        F.struct(
            F.col("text").alias("plain"),
            F.struct(F.concat(F.lit("ref "), "text").alias("text"), F.lit(1).alias("n")).alias("inner"),
            F.array(F.concat(F.lit("ref "), "text"), F.lit("x")).alias("list"),
            F.create_map(F.lit("k"), F.col("text")).alias("map"),
        ).alias("r"),
    )
    clean = redact.sanitize_nested(record, "spans", ["r"])
    return clean.select(
        "doc_id", F.col("r.plain").alias("plain"), F.col("r.inner.text").alias("inner_text"),
        F.array_join("r.list", "|").alias("list_text"), F.col("r.map")["k"].alias("map_text"),
    )


_TURNS = (
    "(SELECT conv_id * 1000 + turn AS doc_id, role, text, CASE WHEN role = 'user' THEN text END AS scan FROM "
    + duck("edits") + " e0)"
)


@query(
    "directional_redact",
    f"SELECT doc_id, CASE WHEN role = 'user' THEN sanitized ELSE text END AS sanitized FROM {_TURNS} JOIN"
    f" {K.replaced(_TURNS, K.spans(_TURNS, text='scan'), by_line=False)} USING (doc_id)",
)
def directional_redact(spark, root):
    """Only what the user typed is changed; the other side of a conversation stays byte for byte."""
    turns = derive(spark, root, "edits").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), "role", "text")
    done = redact.sanitize_outgoing(turns, "text", F.col("role") == "user")
    return done.select("doc_id", "sanitized")


_VAR_TYPES = [
    "OPENAI_KEY", "ANTHROPIC_KEY", "GITHUB_TOKEN", "GOOGLE_KEY", "POSTGRES_URL", "AWS_KEY", "STRIPE_KEY", "FIREBASE_CONFIG",
    "AZURE_KEY", "EMAIL",
]
_VARS_SQL = (
    f"SELECT s.doc_id, s.type, s.start, {K.variable('line', 's.value')} AS variable FROM (SELECT s.*,"
    " coalesce(list_filter(string_split(d.text, chr(10)), lambda l: contains(l, s.value))[1], d.text) AS line"
    f" FROM ({K.spans(CORPUS, types=_VAR_TYPES)}) s JOIN {CORPUS} d USING (doc_id)) s"
)


def _variables(spark, root):
    found = spans.with_spans(derive(spark, root, "corpus"), types=_VAR_TYPES).filter(F.size("spans") > 0)
    rows = found.select("doc_id", "text", F.explode_outer("spans").alias("s")).filter(F.col("s").isNotNull())
    line = X.match_line(F.col("text"), F.col("s.value"))
    return rows.select(
        "doc_id", F.col("s.type").alias("type"), F.col("s.start").cast("long").alias("start"),
        P.variable_name(line, F.col("s.value")).alias("variable"),
    )


@query("variable_names", _VARS_SQL)
def variable_names(spark, root):
    """Name each value is assigned to in its line, if any."""
    return _variables(spark, root)


@query(
    "choose_placeholder",
    f"SELECT doc_id, type, start, coalesce(variable, '') AS variable, CASE WHEN variable IS NULL THEN {K.type_placeholder('type')}"
    f" ELSE variable || '=' || {K.choose('type', 'variable')} END AS placeholder FROM ({_VARS_SQL})",
)
def choose_placeholder(spark, root):
    """Full placeholder: with the name where there is one, by type otherwise."""
    v = _variables(spark, root)
    return v.select(
        "doc_id", "type", "start", F.coalesce("variable", F.lit("")).alias("variable"),
        P.full_placeholder(F.col("type"), F.col("variable")).alias("placeholder"),
    )


_NAME_PARTS = ["GOOGLE_MAPS_KEY", "supabase-url", "STRIPE.secret", "aws_access", "db_url", "api_key", "jwt", "password", "Client_Secret", "github_pat", "email"]
_NAMES_SQL = (
    "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'NEXT_PUBLIC_' WHEN 1 THEN 'process.env.' WHEN 2 THEN 'vite_' ELSE '' END || "
    "CASE p_partkey % 12 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAME_PARTS))
    + " ELSE 'my-' || replace(p_name, ' ', '.') END AS name FROM {part}"
)


@query(
    "name_placeholder",
    f"SELECT p_partkey, name, {K.name_placeholder('name')} AS placeholder FROM ({_NAMES_SQL.replace('{part}', 'part')})",
)
def name_placeholder(spark, root):
    names = spark.sql(_NAMES_SQL, part=table(spark, root, "part"))
    return names.withColumn("placeholder", P.name_placeholder(F.col("name")))


_FIELDS_SQL = (
    "SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'login-password-input' WHEN 1 THEN 'userEmail_box' WHEN 2 THEN 'stripe-api.key'"
    " WHEN 3 THEN 'telfield' WHEN 4 THEN '' ELSE p_name END AS field,"
    " CASE p_partkey % 5 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PASSWORD' WHEN 2 THEN 'PHONE' WHEN 3 THEN 'CARD' ELSE '' END AS type FROM {part}"
)


@query(
    "field_placeholder",
    "SELECT p_partkey, field, type, CASE WHEN contains(u, 'PASS') THEN 'PASSWORD=YOUR_PASSWORD' WHEN contains(u, 'EMAIL') THEN 'EMAIL=YOUR_EMAIL'"
    " WHEN contains(u, 'KEY') OR contains(u, 'API') THEN u || '=YOUR_' || u WHEN type = 'EMAIL' THEN 'EMAIL=YOUR_EMAIL'"
    " WHEN type = 'PASSWORD' THEN 'PASSWORD=YOUR_PASSWORD' WHEN type = 'PHONE' THEN 'PHONE=YOUR_PHONE' WHEN type = 'CARD' THEN 'CARD=YOUR_CARD_NUMBER'"
    " ELSE CASE WHEN type = '' THEN 'FIELD=YOUR_VALUE' ELSE type || '=YOUR_' || type END END AS placeholder FROM ("
    "SELECT *, translate(upper(regexp_replace(field, '(?i)[-_]?(input|textarea|field|box)\\z', '')), '-.', '__') AS u FROM ("
    + _FIELDS_SQL.replace("{part}", "part") + "))",
)
def field_placeholder(spark, root):
    fields = spark.sql(_FIELDS_SQL, part=table(spark, root, "part"))
    return fields.withColumn("placeholder", P.field_placeholder(F.col("type"), F.col("field")))


def _payload_case() -> str:
    whens = " ".join(f"WHEN {K.q(t)} THEN {K.q(k)}" for t, k in dims.PAYLOAD_KEY.items())
    return f"CASE type {whens} ELSE substr(selector, 2) END"


@query(
    "payload_map",
    "SELECT scan_id, CASE WHEN n = 1 THEN base ELSE base || '_' || CAST(n AS STRING) END AS entry, "
    + K.choose("type", "base")
    + f" AS placeholder FROM (SELECT *, row_number() OVER (PARTITION BY scan_id, base ORDER BY ord) AS n FROM (SELECT *, {_payload_case()} AS base FROM {duck('items')} i))",
)
def payload_map(spark, root):
    """Entries of the sanitized payload of each scan."""
    return reports.payload_maps(derive(spark, root, "items"), ["scan_id"], "ord")


@query(
    "clean_urls",
    f"SELECT page_id, CASE WHEN ok THEN lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*)://', 1)) || '://' || host"
    f" || CASE WHEN regexp_extract(url, {K.URL}, 3) IN (':80', ':') THEN '' ELSE regexp_extract(url, {K.URL}, 3) END || {K.url_path('url')} ELSE url END AS clean"
    f" FROM {K.url_parts(duck('visits'))}",
)
def clean_urls(spark, root):
    return derive(spark, root, "visits").select("page_id", X.clean_url(F.col("url")).alias("clean"))


# --- Verification ---------------------------------------------------------------------
@query(
    "residual_check",
    f"""WITH kept AS MATERIALIZED (SELECT * FROM {_RESOLVED}), red AS MATERIALIZED (SELECT * FROM {K.redacted(CORPUS, 'kept')}),
      again AS MATERIALIZED (SELECT doc_id, redacted AS text FROM red),
      l AS (SELECT s.doc_id, CAST(sum(CASE WHEN contains(t.redacted, s.value) THEN 1 ELSE 0 END) AS BIGINT) AS left_over
        FROM kept s JOIN red t USING (doc_id) GROUP BY s.doc_id),
      x AS (SELECT doc_id, count(*) AS n FROM ({K.spans('again', prompt=True)}) GROUP BY doc_id)
    SELECT r.doc_id, coalesce(l.left_over, 0) AS originals_left, coalesce(x.n, 0) AS residuals,
      coalesce(l.left_over, 0) = 0 AND coalesce(x.n, 0) = 0 AS verified
    FROM red r LEFT JOIN l USING (doc_id) LEFT JOIN x USING (doc_id)""",
)
def residual_check(spark, root):
    """Every redacted text scanned again with all rules."""
    done = redact.redact_prompts(derive(spark, root, "corpus"))
    return verify.residual_check(done, "redacted", "spans").select("doc_id", "originals_left", "residuals", "verified")


_RAW_ITEMS = K.spans(NOTES)


@query(
    "leak_check",
    "SELECT DISTINCT doc_id, type, 'Raw ' || type || ' value found: ' || substr(value, 1, 10) || '…' AS violation FROM"
    f" ({_RAW_ITEMS}) JOIN (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE regexp_replace(text, '[0-9@]', '*', 'g') END AS payload FROM {NOTES} n) p USING (doc_id)"
    " WHERE length(value) > 3 AND contains(payload, value)",
)
def leak_check(spark, root):
    """Raw values of a scan inside the payload that leaves it."""
    notes = derive(spark, root, "notes")
    items = spans.detect(notes, ["doc_id"]).select("doc_id", "type", "value")
    payloads = notes.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.regexp_replace("text", "[0-9@]", "*")).alias("payload"))
    return verify.leak_check(payloads, items, "doc_id", "payload").distinct()


_PAY = "pay"
_WITH_PAY = f"WITH pay AS MATERIALIZED (SELECT * FROM {duck('payloads')} p) "


def _first(field: str, types_only: bool = True) -> str:
    src = f"(SELECT payload_id, {field} AS text FROM {_PAY} p0)"
    return K.spans(src, key="payload_id")


_POLICY = f"""(
  SELECT payload_id, 1 AS part, 0 AS ord, 0 AS start, 'Unredacted sensitive regions detected: ' || CAST(unredacted AS STRING)
    || ' region(s) missed pixel redaction' AS msg FROM {_PAY} p1 WHERE unredacted > 0
  UNION ALL SELECT payload_id, 2, ord, start, 'Raw ' || type || ' leaked into DOM skeleton: ' || substr(value, 1, 8) || '...' FROM ({_first('dom')})
  UNION ALL SELECT payload_id, 3, 0, 0, 'Input value attribute detected in sanitized DOM structure' FROM {_PAY} p2
    WHERE regexp_matches(dom, {K.re2(verify.VALUE_ATTRIBUTE[4:], True)})
  UNION ALL SELECT payload_id, 4, 0, 0, 'Raw ' || t || ' found in accessibility label for selector #l' FROM (
    SELECT payload_id, arg_min(type, ord) AS t FROM ({K.spans(f"(SELECT payload_id, label AS text FROM {_PAY} p3 WHERE length(label) > 4)", key='payload_id')}) GROUP BY payload_id)
  UNION ALL SELECT payload_id, 5, ord, start, 'Raw ' || type || ' found in OCR text metadata' FROM ({_first(K.trim('ocr'))})
  UNION ALL SELECT payload_id, 6, ord, start, 'Raw ' || type || ' found in task description: ' || substr(value, 1, 8) || '...' FROM ({_first('task')})
  UNION ALL SELECT payload_id, 7, 0, 0, 'Sensitive parameter found in URL search query: ' || t FROM (
    SELECT payload_id, arg_min(type, ord * 100000 + start) AS t FROM ({K.spans(f"(SELECT payload_id, {K.url_query('url')} AS text FROM {_PAY} p4 WHERE {K.url_ok('url')})", key='payload_id')}) GROUP BY payload_id))"""
_VERDICT = (
    f"(SELECT payload_id, context, coalesce(v.violations, '') AS violations, v.violations IS NULL AS safe FROM {_PAY} p LEFT JOIN"
    f" (SELECT payload_id, string_agg(msg, '; ' ORDER BY part, ord, start) AS violations FROM {_POLICY} GROUP BY payload_id) v USING (payload_id))"
)


def _judged(spark, root):
    payloads = derive(spark, root, "payloads")
    label = F.array(F.struct(F.lit("#l").alias("selector"), F.col("label").alias("label")))
    return verify.policy_violations(payloads.withColumn("labels", label).drop("label"), "payload_id")


@query("policy_eval", f"{_WITH_PAY} SELECT payload_id, violations, safe FROM {_VERDICT}")
def policy_eval(spark, root):
    """All violations of each outgoing payload, in order."""
    return _judged(spark, root).select("payload_id", F.array_join("violations", "; ").alias("violations"), "safe")


@query(
    "violation_types",
    _WITH_PAY + "SELECT payload_id, msg AS message, CASE "
    + " ".join(f"WHEN regexp_matches(msg, {K.q(p)}) THEN {K.q(t)}" for p, t in verify.VIOLATION_TYPES)
    + f" ELSE 'UNKNOWN' END AS violation_type FROM {_POLICY}",
)
def violation_types(spark, root):
    rows = _judged(spark, root).select("payload_id", F.explode_outer("violations").alias("message")).filter("message is not null")
    return rows.withColumn("violation_type", verify.violation_type(F.col("message")))


@query(
    "quarantine_split",
    f"{_WITH_PAY} SELECT CASE WHEN safe THEN 'clean' ELSE 'quarantine' END AS side, count(*) AS payloads,"
    f" CAST(min(payload_id) AS BIGINT) AS first_id, CAST(max(payload_id) AS BIGINT) AS last_id FROM {_VERDICT} GROUP BY 1",
)
def quarantine_split(spark, root):
    """Payloads that may leave and those that are held back."""
    judged = _judged(spark, root).select("payload_id", "safe")
    clean, held = verify.split_quarantine(judged)
    both = clean.withColumn("side", F.lit("clean")).unionByName(held.withColumn("side", F.lit("quarantine")))
    return both.groupBy("side").agg(
        F.count("*").alias("payloads"), F.min("payload_id").alias("first_id"), F.max("payload_id").alias("last_id")
    )


@query(
    "value_attr_leak",
    "SELECT page_id FROM (SELECT page_id, html FROM pages UNION ALL SELECT 1000000 + page_id AS page_id, html FROM "
    + duck("forms") + f" f) WHERE regexp_matches(html, {K.re2(verify.VALUE_ATTRIBUTE[4:], True)})",
)
def value_attr_leak(spark, root):
    pages = table(spark, root, "pages").select("page_id", "html")
    forms = derive(spark, root, "forms").select((F.col("page_id") + 1000000).alias("page_id"), "html")
    return pages.unionByName(forms).filter(verify.value_attribute(F.col("html"))).select("page_id")


@query(
    "server_rules",
    "SELECT doc_id, hit FROM (SELECT doc_id, coalesce("
    + ", ".join(f"substr(nullif(regexp_extract(text, {K.re2(p)}, 0), ''), 1, 6)" for p in C.SERVER_RULES)
    + f") AS hit FROM {CORPUS} c) WHERE hit IS NOT NULL",
)
def server_rules(spark, root):
    """Texts the receiving side would refuse, with the first six characters of the reason."""
    hits = derive(spark, root, "corpus").withColumn("hit", verify.server_rule_hit(F.col("text")))
    return hits.filter("hit is not null").select("doc_id", "hit")


@query(
    "context_gate",
    f"{_WITH_PAY} SELECT payload_id, context FROM {_PAY} p WHERE context IS NULL OR upper({K.trim('context')}) NOT IN ('AUTHENTICATION', 'MESSAGING', 'SOCIAL_MEDIA')",
)
def context_gate(spark, root):
    return derive(spark, root, "payloads").filter(verify.context_allowed(F.col("context"))).select("payload_id", "context")


@query("content_hash", f"SELECT conv_id, turn, {K.fnv1a('text')} AS hash FROM conversations")
def content_hash(spark, root):
    turns = texts(spark, root, "conversations", ["conv_id", "turn", "text"])
    return turns.select("conv_id", "turn", checks.fnv1a(F.col("text")).alias("hash"))


_HASHED = f"(SELECT conv_id, turn, {K.fnv1a('text')} AS hash FROM {duck('edits')} e)"


@query(
    "needs_reverify",
    f"SELECT conv_id, turn, hash, lag(hash) OVER (PARTITION BY conv_id ORDER BY turn) IS DISTINCT FROM hash AS needs_reverify FROM {_HASHED}",
)
def needs_reverify(spark, root):
    """Content whose fingerprint differs from the one verified before.  Only the hash is shuffled, not the text."""
    hashed = derive(spark, root, "edits").select("conv_id", "turn", checks.fnv1a(F.col("text")).alias("hash"))
    before = lag_sliced(hashed, ["conv_id"], ["turn"], "hash", F.floor(F.col("turn") / 1024), "before")
    return before.withColumn("needs_reverify", ~F.col("before").eqNullSafe(F.col("hash"))).drop("before")


_CLEAN = "regexp_replace(text, '[\"\\\\\\n]', ' ', 'g')"
_BODY = f"(SELECT doc_id, doc_id % 5 = 0 AS plain, CASE WHEN doc_id % 5 = 0 THEN 'plain: ' || text ELSE {_CLEAN} END AS text FROM {NOTES} n)"


@query(
    "sanitize_bodies",
    "SELECT b.doc_id, r.n > 0 AS blocked, CASE WHEN b.plain THEN r.sanitized WHEN b.doc_id % 5 = 1 THEN"
    " '{\"model\":\"m\",\"messages\":[{\"role\":\"user\",\"content\":\"' || r.sanitized || '\"}],\"keep\":7}' ELSE '{\"prompt\":\"' || r.sanitized || '\",\"n\":\"1\"}' END AS sent_body"
    f" FROM {_BODY} b JOIN {K.replaced(_BODY, K.spans(_BODY))} r USING (doc_id)",
)
def sanitize_bodies(spark, root):
    """Request bodies: unsafe JSON is rewritten string by string, other unsafe text as a whole."""
    notes = derive(spark, root, "notes")
    clean = F.regexp_replace("text", r'["\\\n]', " ")
    message = F.struct(F.lit("user").alias("role"), clean.alias("content"))
    chat = F.to_json(F.struct(F.lit("m").alias("model"), F.array(message).alias("messages"), F.lit(7).alias("keep")))
    body = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("plain: "), "text")).when(F.col("doc_id") % 5 == 1, chat).otherwise(
        F.to_json(F.struct(clean.alias("prompt"), F.lit("1").alias("n")))
    )
    fixed = audits.repair_bodies(notes.select("doc_id", body.alias("body")))
    return fixed.select("doc_id", "blocked", "sent_body")


_FIELD_ROWS = (
    "SELECT scan_id, 'f' || CAST(ord AS STRING) || CASE WHEN ord % 2 = 0 THEN '_email' ELSE '_note' END AS field,"
    " CASE WHEN ord % 3 = 0 THEN 'free text' ELSE value END AS value FROM {items}"
)


@query(
    "form_payload",
    "SELECT f.scan_id, f.field, d.type IS NOT NULL AS replaced, CASE WHEN d.type IS NULL THEN f.value ELSE "
    + K.choose("d.type", "f.field")
    + " END AS output FROM (" + _FIELD_ROWS.replace("{items}", duck("items") + " i") + ") f LEFT JOIN"
    f" (SELECT scan_id, value, arg_min(type, ord) AS type FROM {duck('items')} i GROUP BY scan_id, value) d USING (scan_id, value)",
)
def form_payload(spark, root):
    """Form fields whose value was detected get a placeholder named after the field."""
    items = derive(spark, root, "items")
    fields = spark.sql(_FIELD_ROWS, items=items)
    return audits.form_payload(fields, items, "scan_id")


@query(
    "enrich_types",
    "SELECT i.scan_id, i.ord, i.type, t.weight, t.label, t.category, t.bracket, t.placeholder,"
    f" CASE WHEN length(i.value) <= 40 THEN i.value ELSE substr(i.value, 1, 40) || '…' END AS preview FROM {duck('items')} i JOIN {K.types()} t USING (type)",
)
def enrich_types(spark, root):
    items = derive(spark, root, "items").select("scan_id", "ord", "type", "value")
    out = reports.enrich(items, dims.type_dim(spark))
    return out.select("scan_id", "ord", "type", "weight", "label", "category", "bracket", "placeholder", "preview")


_EXPL = "(SELECT * FROM (VALUES " + ", ".join(f"({K.q(t)}, {K.q(w)}, {K.q(r)})" for t, (w, r) in dims.EXPLANATIONS.items()) + ") v(type, why, recommendation))"
_METH = "(SELECT * FROM (VALUES " + ", ".join(f"({K.q(m)}, {K.q(d)}, {K.q(r)})" for m, (d, r) in dims.METHODS.items()) + ") v(method, detector, reliability))"


@query(
    "explain_detections",
    "SELECT i.scan_id, i.ord, e.why, m.detector, 'Confidence ' || CAST(CAST(floor(i.confidence * 100 + 0.5) AS BIGINT) AS STRING) || '% — ' || m.reliability AS confidence_reason,"
    f" e.recommendation FROM {duck('items')} i JOIN {_EXPL} e USING (type) JOIN {_METH} m USING (method)",
)
def explain_detections(spark, root):
    items = derive(spark, root, "items").select("scan_id", "ord", "type", "method", "confidence")
    out = reports.explain(items, dims.explanation_dim(spark), dims.method_dim(spark))
    return out.select("scan_id", "ord", "why", "detector", "confidence_reason", "recommendation")


# --- Flagship --------------------------------------------------------------------------
_F_TYPES = ["EMAIL", "PHONE", "CARD"]
_F_KEPT = K.resolved(K.spans("documents", types=_F_TYPES))
_F_RED = K.redacted("documents", _F_KEPT)
_F_AGAIN = f"(SELECT doc_id, redacted AS text FROM {_F_RED})"


@query(
    "flagship",
    f"""WITH kept AS {_F_KEPT}, again AS (SELECT DISTINCT doc_id FROM ({K.spans(_F_AGAIN, types=_F_TYPES)})),
    scored AS (SELECT doc_id, count(*) AS n, CASE WHEN bool_or(type = 'CARD') THEN 75 WHEN bool_or(type = 'EMAIL') THEN 15 ELSE 10 END AS score
      FROM kept GROUP BY doc_id)
    SELECT d.lang, count(*) AS docs, count(s.doc_id) AS docs_with_findings, CAST(coalesce(sum(s.n), 0) AS BIGINT) AS spans,
      CAST(sum(CASE WHEN s.score >= 70 THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN s.score < 70 AND s.score >= 40 THEN 1 ELSE 0 END) AS BIGINT) AS medium,
      CAST(sum(CASE WHEN coalesce(s.score, 0) < 40 THEN 1 ELSE 0 END) AS BIGINT) AS low, count(a.doc_id) AS unverified,
      CAST(sum(length(r.redacted)) AS BIGINT) AS redacted_chars
    FROM documents d JOIN {_F_RED} r USING (doc_id) LEFT JOIN scored s USING (doc_id) LEFT JOIN again a USING (doc_id) GROUP BY d.lang""",
)
def flagship(spark, root):
    """Detect, resolve, redact and verify in one pass over the texts, then one small aggregation."""
    docs = texts(spark, root, "documents", ["doc_id", "lang", "text"])
    found = spans.with_spans(docs, types=_F_TYPES)
    found = redact.with_resolved(found, "spans", "spans")
    marked = redact.with_placeholders(found, "text", "spans", "marks")
    done = marked.withColumn("redacted", redact.splice("text", "spans", "marks"))
    again = spans.with_spans(done, "redacted", "left", types=_F_TYPES)
    has = {t: F.exists("spans", _is_type(t)) for t in ("CARD", "EMAIL")}
    n = F.size("spans")
    score = F.when(n == 0, 0).when(has["CARD"], 75).when(has["EMAIL"], 15).otherwise(10)
    rows = again.select(
        "lang", n.alias("n"), score.alias("score"), (F.size("left") > 0).alias("bad"), F.length("redacted").alias("chars")
    )
    return rows.groupBy("lang").agg(
        F.count("*").alias("docs"), F.count_if(F.col("n") > 0).alias("docs_with_findings"), F.sum("n").cast("long").alias("spans"),
        F.count_if(F.col("score") >= 70).alias("high"), F.count_if(F.col("score").between(40, 69)).alias("medium"),
        F.count_if(F.col("score") < 40).alias("low"), F.count_if("bad").alias("unverified"),
        F.sum("chars").cast("long").alias("redacted_chars"),
    )


def _is_type(name: str):
    return lambda s: s["type"] == name
