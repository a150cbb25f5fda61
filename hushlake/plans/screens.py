"""Queries on pages, addresses, elements and boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushlake.functions import dims
from hushlake.functions import text as X
from hushlake.functions.dims import PRIORITY
from hushlake.operators import audits, boxes as B, context as C, dedupe, elements as E, evaluate, spans
from hushlake.plans import sqlkit as K
from hushlake.plans.registry import ORACLES, query
from hushlake.sources.derived import derive, duck
from hushlake.sources.scratch import stored
from hushlake.sources.tables import table
from hushlake.streaming import streams, upserts

VISITS = duck("visits")
PARTS = K.url_parts(VISITS)


# --- Addresses and contexts -----------------------------------------------------------
_RESTRICTED = " OR ".join(
    [f"starts_with(u, {K.q(p)})" for p in dims.RESTRICTED_PREFIXES] + [f"contains(u, {K.q(p)})" for p in dims.RESTRICTED_PARTS]
)


@query("restricted_urls", f"SELECT page_id FROM (SELECT page_id, lower({K.trim('url')}) AS u FROM {VISITS} v) WHERE u = '' OR {_RESTRICTED}")
def restricted_urls(spark, root):
    return derive(spark, root, "visits").filter(X.restricted_url(F.col("url"))).select("page_id")


@query("watched_hosts", f"SELECT page_id, host FROM {PARTS} p WHERE host IN ({', '.join(K.q(h) for h in dims.WATCHED_HOSTS)})")
def watched_hosts(spark, root):
    """Requests to watched hosts (seven hosts, broadcast semi join)."""
    visits = derive(spark, root, "visits").select("page_id", X.url_host(F.col("url")).alias("host"))
    return visits.join(F.broadcast(dims.watched_dim(spark)), "host", "left_semi").select("page_id", "host")


_SIG = f"""(SELECT page_id, context, arg_min(app, ord) AS app, arg_min(domain, ord) AS domain FROM {PARTS} p JOIN {K.signatures()} s
    ON (p.host = s.domain OR ends_with(p.host, '.' || s.domain)) AND (s.path_rule IS NULL OR regexp_matches(p.path, s.path_rule))
    GROUP BY page_id, context)"""


def _pages(spark, root):
    return C.with_url_parts(derive(spark, root, "visits"))


@query("site_signature", f"SELECT page_id, context, app, domain FROM {_SIG}")
def site_signature(spark, root):
    """First signature of each kind that fits a page."""
    pages = _pages(spark, root)
    hits = C.match_signatures(pages, dims.signature_dim(spark), small=True)
    return pages.select("page_id", "host", "path").join(hits, ["host", "path"]).select("page_id", "context", "app", "domain")


_CUSTOM = """SELECT DISTINCT 'SOCIAL_MEDIA' AS context, 'Intranet ' || CAST(o_custkey % 20 AS STRING) AS app, 'intra' || CAST(o_custkey % 20 AS STRING) || '.corp.example.net' AS domain, '/wall' AS path_rule, CAST(o_custkey % 20 AS INT) AS ord FROM {orders}
  UNION ALL SELECT DISTINCT 'AI_ASSISTANT', 'Helper ' || CAST(o_custkey % 50 AS STRING), 'acme' || CAST(o_custkey % 50 AS STRING) || '.okta', CAST(NULL AS STRING), CAST(100 + o_custkey % 50 AS INT) FROM {orders}
  UNION ALL SELECT DISTINCT 'AI_ASSISTANT', 'Order desk ' || CAST(o_orderkey AS STRING), 'shop.example.com/oauth/callback?code=' || CAST(o_orderkey AS STRING), '/oauth', CAST(1000 + o_orderkey AS INT) FROM {orders}"""


@query(
    "custom_signatures",
    f"SELECT page_id, context, arg_min(app, ord) AS app FROM {PARTS} p JOIN (SELECT * FROM {K.signatures()} UNION ALL SELECT context, app, domain, path_rule, ord + 1000000 FROM ({_CUSTOM.replace('{orders}', 'orders')})) s"
    " ON (p.host = s.domain OR ends_with(p.host, '.' || s.domain) OR (s.context = 'AI_ASSISTANT' AND contains(lower(p.url), lower(s.domain))))"
    " AND (s.path_rule IS NULL OR regexp_matches(p.path, s.path_rule)) GROUP BY page_id, context",
)
def custom_signatures(spark, root):
    """Signatures with user-supplied ones behind them, whose number is not bounded; assistants count anywhere in an address."""
    extra = spark.sql(_CUSTOM, orders=table(spark, root, "orders"))
    both = stored(C.register_signatures(dims.signature_dim(spark), extra))  # read six times
    visits = derive(spark, root, "visits")
    seen = stored(C.with_url_parts(visits.select("url").distinct()).select("url", "host", "path"))  # read four times
    hits = C.host_hits(seen, both).unionByName(C.anywhere_hits(seen, both)).select(F.col("url").alias("__url"), "context", "app", "ord")
    first = hits.groupBy("__url", "context").agg(F.min_by("app", "ord").alias("app"), F.min("ord").alias("ord"))
    met = visits.join(first.hint("merge"), F.col("url").eqNullSafe(F.col("__url")))
    return met.groupBy("page_id", "context").agg(F.min_by("app", "ord").alias("app"))


def _case(subject: list[str], rules, column: int) -> str:
    whens = []
    for rule in rules:
        cond = " OR ".join(f"regexp_matches({s}, {K.q(rule[0])})" for s in subject)
        whens.append(f"WHEN {cond} THEN {K.q(rule[1]) if column == 1 else rule[2]}")
    return "CASE " + " ".join(whens) + (" END" if column == 1 else " ELSE 0 END")


_AUTH = f"""(SELECT *, {_case(['host'], dims.AUTH_HOST_RULES, 1)} AS hl, {_case(['path', 'lower(url)'], dims.AUTH_PATH_RULES, 1)} AS pl,
    {_case(['host'], dims.AUTH_HOST_RULES, 2)} AS hs, {_case(['path', 'lower(url)'], dims.AUTH_PATH_RULES, 2)} AS ps FROM {PARTS} a)"""
_AUTH_Q = f"(SELECT *, ok AND regexp_matches(query, {K.q(dims.AUTH_QUERY_RULE)}) AND NOT coalesce(starts_with(pl, 'URL_AUTH'), false) AS qm FROM {_AUTH})"
_ANYWHERE = "CASE " + " ".join(
    "WHEN " + " OR ".join(f"contains(lower(url), {K.q(d)})" for d in domains) + f" THEN {K.q(app)}"
    for context, app, domains, _ in dims.SIGNATURES if context == "AI_ASSISTANT"
) + " END"
_SCORED = f"""(SELECT v.*, sm.app AS msg_app, ss.app AS soc_app, CASE WHEN v.anywhere IS NOT NULL THEN v.anywhere ELSE sa.app END AS ai_app,
    hs + ps + CASE WHEN qm THEN 30 ELSE 0 END AS auth_score,
    CASE WHEN sa.app IS NOT NULL THEN 0 ELSE CASE WHEN sm.app IS NOT NULL THEN 90 ELSE 0 END
      + CASE WHEN regexp_matches(path, {K.q(dims.MESSAGING_PATH_RULE)}) THEN 25 ELSE 0 END END AS messaging_score,
    CASE WHEN ss.app IS NOT NULL THEN 95 ELSE 0 END + CASE WHEN regexp_matches(path, {K.q(dims.SOCIAL_PATH_RULE)}) THEN 20 ELSE 0 END AS social_score,
    CASE WHEN v.anywhere IS NOT NULL OR sa.app IS NOT NULL THEN 85 ELSE 0 END AS assistant_score
  FROM (SELECT *, {_ANYWHERE} AS anywhere FROM {_AUTH_Q}) v
  LEFT JOIN (SELECT * FROM {_SIG} WHERE context = 'MESSAGING') sm USING (page_id)
  LEFT JOIN (SELECT * FROM {_SIG} WHERE context = 'SOCIAL_MEDIA') ss USING (page_id)
  LEFT JOIN (SELECT * FROM {_SIG} WHERE context = 'AI_ASSISTANT') sa USING (page_id))"""
_STRONG = "(hl IS NOT NULL OR coalesce(pl IN ('URL_AUTH_LOGIN', 'URL_AUTH_SIGNUP', 'URL_PASSWORD_RESET', 'URL_ACCOUNT_RECOVERY', 'URL_MFA_OTP'), false))"
_IS_AUTH = f"((pl IS NOT NULL OR qm OR hl IS NOT NULL) AND (auth_score >= 55 OR {_STRONG}))"
_CONTEXT = f"""(SELECT page_id, auth_score, messaging_score, social_score, assistant_score,
    CASE WHEN {_IS_AUTH} THEN 'AUTHENTICATION' WHEN messaging_score >= 60 THEN 'MESSAGING' WHEN social_score >= 60 THEN 'SOCIAL_MEDIA'
      WHEN assistant_score >= 60 THEN 'AI_ASSISTANT' WHEN ok THEN 'NORMAL' ELSE 'UNKNOWN' END AS context,
    CASE WHEN {_IS_AUTH} THEN least(0.99, greatest(0.7, auth_score / 100)) WHEN messaging_score >= 60 THEN least(0.99, greatest(0.75, messaging_score / 100))
      WHEN social_score >= 60 THEN least(0.99, greatest(0.85, social_score / 100)) WHEN assistant_score >= 60 THEN least(0.99, greatest(0.75, assistant_score / 100))
      WHEN ok THEN 0.95 ELSE 0.5 END AS confidence,
    CASE WHEN {_IS_AUTH} THEN NULL WHEN messaging_score >= 60 THEN msg_app WHEN social_score >= 60 THEN soc_app WHEN assistant_score >= 60 THEN ai_app END AS app
  FROM {_SCORED})"""


def _context(spark, root):
    return C.with_context(derive(spark, root, "visits"), dims.signature_dim(spark), small=True)


for _name, _col in (("auth_score", "auth_score"), ("messaging_score", "messaging_score"), ("social_score", "social_score"), ("assistant_score", "assistant_score")):

    def _score(spark, root, col=_col):
        return _context(spark, root).select("page_id", F.col(col).cast("long").alias("score")).filter("score > 0")

    query(_name, f"SELECT page_id, CAST({_col} AS BIGINT) AS score FROM {_CONTEXT} WHERE {_col} > 0")(_score)


@query("page_context", f"SELECT page_id, context, round(CAST(confidence AS DOUBLE), 6) AS confidence, app FROM {_CONTEXT}")
def page_context(spark, root):
    """Context of each visit by its address."""
    return _context(spark, root).select("page_id", "context", F.round("confidence", 6).alias("confidence"), "app")


_POL = "(SELECT * FROM (VALUES " + ", ".join(f"({K.q(c)}, {K.q(p)}, {K.q(r)}, {str(ok).lower()})" for c, p, r, ok in dims.POLICIES) + ") v(context, policy, reason, ok))"


@query(
    "context_policy",
    f"SELECT c.context, p.policy, p.reason, p.ok AS allow_actions, p.policy = 'BLOCK_ALL' OR NOT p.ok AS agent_blocked, count(*) AS pages FROM {_CONTEXT} c JOIN {_POL} p USING (context) GROUP BY ALL",
)
def context_policy(spark, root):
    judged = C.with_policy(_context(spark, root), dims.policy_dim(spark))
    return judged.groupBy("context", "policy", "reason", "allow_actions", "agent_blocked").agg(F.count("*").alias("pages"))


@query("page_context_dom")
def page_context_dom(spark, root):
    """Context of stored pages and forms by address and elements together."""
    pages = table(spark, root, "pages").unionByName(derive(spark, root, "forms"))
    judged = C.with_context(E.page_signals(pages), dims.signature_dim(spark), small=True)
    return judged.select("page_id", "url", "context", "confidence", "app")


_TASKS = "SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'Please search for \"' || text || '\" now' WHEN 1 THEN text || '. Look up for shoes, please' WHEN 2 THEN text || '. find the search box and search something' ELSE text END AS task FROM {conversations}"


def _intent_sql(t: str) -> str:
    parts = []
    for p in C.SEARCH_RULES:
        raw = K.trim(f"regexp_extract({t}, {K.re2(p, True)}, 1)")
        phrase = K.trim(f"regexp_replace({raw}, '^[\"'']+|[\"'']+\\z', '', 'g')")
        parts.append(f"WHEN {phrase} <> '' THEN CASE WHEN lower({phrase}) IN ({', '.join(K.q(g) for g in C.SEARCH_GENERIC)}) THEN 'internships' ELSE {phrase} END")
    return "CASE " + " ".join(parts) + " ELSE 'internships' END"


@query("search_intent", f"SELECT conv_id, turn, {_intent_sql('task')} AS intent FROM ({_TASKS.replace('{conversations}', 'conversations')})")
def search_intent(spark, root):
    tasks = spark.sql(_TASKS, conversations=table(spark, root, "conversations"))
    return tasks.select("conv_id", "turn", C.search_intent(F.col("task")).alias("intent"))


# --- Elements -------------------------------------------------------------------------
def _both(spark, root):
    pages = table(spark, root, "pages").select("page_id", "html")
    forms = derive(spark, root, "forms").select((F.col("page_id") + 1000000).alias("page_id"), "html")
    return pages.unionByName(forms)


@query("page_text_nodes")
def page_text_nodes(spark, root):
    """Inputs and content texts worth scanning."""
    nodes = E.scannable(E.elements(_both(spark, root), ["page_id"]))
    return nodes.select("page_id", "idx", "tag", "path", "is_input", "input_type", "text")


@query("interactive_elements")
def interactive_elements(spark, root):
    from hushlake.operators.redact import sanitize_text

    rows = E.interactive(E.elements(_both(spark, root), ["page_id"]), "page_id")
    return sanitize_text(rows, "label", "clean_label").drop("label")


@query("element_labels")
def element_labels(spark, root):
    return E.with_labels(E.elements(_both(spark, root), ["page_id"]), "page_id").filter("label <> ''").select("page_id", "idx", "tag", "label")


@query("region_labels")
def region_labels(spark, root):
    return E.region_labels(E.elements(_both(spark, root), ["page_id"]), "page_id")


@query("page_skeleton")
def page_skeleton(spark, root):
    """Sanitized structure lines; one row per line keeps a huge page splittable."""
    return E.skeleton_lines(E.elements(_both(spark, root), ["page_id"]), ["page_id"])


_FIELD_SQL = """SELECT c_custkey AS page_id, 'EMAIL' AS type, 'cust' || CAST(c_custkey AS STRING) || '@example.com' AS value, '#mail' AS selector FROM customer
  UNION ALL SELECT c_custkey, 'NAME', c_name, 'input[name="fullname"]' FROM customer
  UNION ALL SELECT c_custkey, 'PASSWORD', 'Zq' || CAST(c_custkey AS STRING) || '!x', 'input[name="pwd"]' FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, 'PASSWORD', '••••••••', '#userpassword' FROM customer WHERE c_custkey % 3 = 1"""


@query("detect_fields", _FIELD_SQL)
def detect_fields(spark, root):
    """Detections that follow from form fields; the check knows the fields the forms were built from."""
    nodes = E.scannable(E.elements(derive(spark, root, "forms"), ["page_id"]))
    return E.detect_fields(nodes, ["page_id"]).select("page_id", "type", "value", "selector")


@query("detect_nodes")
def detect_nodes(spark, root):
    nodes = E.scannable(E.elements(_both(spark, root), ["page_id"]))
    return E.detect_nodes(nodes, ["page_id"])


_FORM = "'/html[1]/body[1]/form[1]/"
#: The scannable nodes of the forms, as they were built: page, path, selector, text, own name.
_NODES = f"""(SELECT c_custkey AS page_id, {_FORM}input[1]' AS path, '#mail' AS selector, 'cust' || CAST(c_custkey AS STRING) || '@example.com' AS text, 'contact' AS own, 'EMAIL' AS field FROM customer
  UNION ALL SELECT c_custkey, {_FORM}input[2]', 'input[name="fullname"]', c_name, 'fullname', 'NAME' FROM customer
  UNION ALL SELECT c_custkey, {_FORM}input[3]', 'input[name="pwd"]', 'Zq' || CAST(c_custkey AS STRING) || '!x', 'pwd', 'PASSWORD' FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT c_custkey, {_FORM}input[3]', '#userpassword', '', 'userpassword', 'PASSWORD' FROM customer WHERE c_custkey % 3 = 1
  UNION ALL SELECT c_custkey, {_FORM}textarea[1]', 'textarea[name="bio"]', 'Card 4' || lpad(CAST((c_custkey * 8191) % 1000000000 AS STRING), 15, '0') || ' on file', 'bio', NULL FROM customer
  UNION ALL SELECT c_custkey, {_FORM}p[1]', {_FORM}p[1]', 'The word password in plain text is fine for ' || c_mktsegment, NULL, NULL FROM customer)"""
_ITEM_SQL = f"""(WITH nodes AS MATERIALIZED (SELECT *, page_id || '|' || path AS doc_id FROM {_NODES}),
    scan AS MATERIALIZED (SELECT * FROM nodes WHERE field IS DISTINCT FROM 'PASSWORD'),
    found AS MATERIALIZED (
      SELECT doc_id, -1 AS ord, 0 AS start, field AS type, CASE WHEN text = '' THEN '••••••••' ELSE text END AS value, CASE field WHEN 'PASSWORD' THEN 1.0 WHEN 'EMAIL' THEN 0.98 ELSE 0.88 END AS confidence,
        'dom' AS method, field AS variable FROM nodes WHERE field IS NOT NULL
      UNION ALL SELECT s.doc_id, s.ord, s.start, s.type, s.value, s.confidence, 'regex',
        coalesce({K.variable("coalesce(list_filter(string_split(n.text, chr(10)), lambda line: contains(line, s.value))[1], n.text)", 's.value')}, own) FROM ({K.spans('scan')}) s JOIN scan n USING (doc_id)),
    firsts AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY doc_id, type, value ORDER BY ord, start) = 1)
  SELECT page_id, 'hl-' || substr(md5(concat_ws('|', CAST(page_id AS STRING), path, type, value)), 1, 16) AS item_id, path, selector, type, value, CAST(confidence AS DOUBLE) AS confidence, method, variable,
    CASE WHEN coalesce(variable, '') <> '' THEN variable || '=' || {K.choose('type', 'variable')} ELSE {K.choose('type', 'variable')} END AS placeholder,
    CASE WHEN own IS NULL THEN 'WEBPAGE_CONTENT' ELSE 'USER_INPUT' END AS provenance, text FROM firsts JOIN nodes USING (doc_id))"""


@query(
    "page_scan",
    f"""WITH i AS MATERIALIZED (SELECT * FROM {_ITEM_SQL})
    SELECT page_id, item_id, path, selector, type, value, confidence, method, variable, placeholder, provenance FROM i WHERE NOT EXISTS (
      SELECT 1 FROM i o WHERE o.page_id = i.page_id AND o.type = i.type AND ((o.selector = i.selector AND o.confidence > i.confidence)
        OR (contains(o.value, i.value) AND length(o.value) > length(i.value) AND o.confidence >= i.confidence)))""",
)
def page_scan(spark, root):
    """From raw pages to final items with names, provenance and ids; the check knows what the forms were built from."""
    return E.page_scan(derive(spark, root, "forms"), "page_id").drop("ord")


@query("page_scan_all")
def page_scan_all(spark, root):
    """The same over the lake's pages and the forms."""
    return E.page_scan(_both(spark, root), "page_id").drop("ord")


@query(
    "redact_fields",
    f"""WITH i AS MATERIALIZED (SELECT * FROM {_ITEM_SQL}), u AS (SELECT * FROM i WHERE provenance = 'USER_INPUT' AND type <> 'PASSWORD'),
      o AS (SELECT *, row_number() OVER (PARTITION BY page_id, path ORDER BY -length(value), type, value) AS rn, count(*) OVER (PARTITION BY page_id, path) AS n FROM u),
      t AS (SELECT * FROM (WITH RECURSIVE w AS (
        SELECT page_id, path, 0 AS rn, any_value(text) AS cur, CAST(count(*) AS BIGINT) AS n FROM u GROUP BY page_id, path
        UNION ALL SELECT w.page_id, w.path, o.rn, CASE WHEN contains(cur, o.value) THEN replace(cur, o.value, {K.choose('o.type', 'o.variable')}) ELSE cur END, w.n
        FROM w JOIN o ON o.page_id = w.page_id AND o.path = w.path AND o.rn = w.rn + 1) SELECT * FROM w WHERE rn = n))
    SELECT page_id, path, cur AS text, n AS items FROM t""",
)
def redact_fields(spark, root):
    """Detections of the forms, put back into the fields they came from; page text and password fields stay as they are."""
    els = E.elements(derive(spark, root, "forms"), ["page_id"])
    items = E.page_items(E.scannable(els), "page_id")
    return E.redact_fields(E.stored_fields(els), items, "page_id").select("page_id", "path", "text", "items")


_PATHS = "(SELECT page_id, ord, '/html/body/div[' || CAST(ord % 3 + 1 AS STRING) || ']/p[' || CAST(ord AS STRING) || ']' AS path FROM " + duck("boxes") + " b)"
_ROOTS = "(SELECT o_orderkey AS page_id, '/html/body/div[' || CAST(o_orderkey % 4 + 1 AS STRING) || ']' AS root FROM orders)"


def _paths(spark, root):
    return derive(spark, root, "boxes").select(
        "page_id", "ord", F.expr("'/html/body/div[' || CAST(ord % 3 + 1 AS STRING) || ']/p[' || CAST(ord AS STRING) || ']'").alias("path")
    )


def _roots(spark, root):
    return table(spark, root, "orders").select(
        F.col("o_orderkey").alias("page_id"), F.expr("'/html/body/div[' || CAST(o_orderkey % 4 + 1 AS STRING) || ']'").alias("root")
    )


@query("rescan_changed", f"SELECT p.page_id, p.ord FROM {_PATHS} p JOIN {_ROOTS} r ON p.page_id = r.page_id AND (p.path = r.root OR starts_with(p.path, r.root || '/'))")
def rescan_changed(spark, root):
    """Elements under a changed root."""
    els = _paths(spark, root).withColumn("idx", F.col("ord"))
    return E.rescan_roots(els, _roots(spark, root), "page_id").select("page_id", "ord")


_ITEMS_AT = (
    "(SELECT i.scan_id AS page_id, i.ord, i.type, i.value, '/html/body/div[' || CAST(i.ord % 3 + 1 AS STRING) || ']/p[' || CAST(i.ord AS STRING) || ']' AS path FROM "
    + duck("items") + " i)"
)


def _items_at(spark, root):
    return derive(spark, root, "items").select(
        F.col("scan_id").alias("page_id"), "ord", "type", "value",
        F.expr("'/html/body/div[' || CAST(ord % 3 + 1 AS STRING) || ']/p[' || CAST(ord AS STRING) || ']'").alias("path"),
    )


@query(
    "incremental_merge",
    f"""WITH old AS (SELECT * FROM {_ITEMS_AT} i), kept AS (SELECT o.*, 0 AS gen FROM old o WHERE NOT EXISTS (SELECT 1 FROM {_ROOTS} r WHERE r.page_id = o.page_id
      AND (o.path = r.root OR starts_with(o.path, r.root || '/')))), fresh AS (SELECT page_id, ord, type, value || '-new' AS value, path, 1 AS gen FROM old WHERE ord % 2 = 0)
    SELECT page_id, type, value, arg_min(ord, gen * 1000000 + ord) AS ord FROM (SELECT * FROM kept UNION ALL SELECT * FROM fresh) GROUP BY page_id, type, value""",
)
def incremental_merge(spark, root):
    """Current detections after some roots were scanned again."""
    old = _items_at(spark, root)
    fresh = old.filter("ord % 2 = 0").withColumn("value", F.concat("value", F.lit("-new")))
    return dedupe.merge_incremental(old, fresh, _roots(spark, root), "page_id").select("page_id", "type", "value", "ord")


@query("stream_merge", ORACLES["incremental_merge"])
def stream_merge(spark, root):
    """The same merge batch by batch: changed roots come as a stream, and each batch rewrites what it touches, once."""
    old = _items_at(spark, root).select("page_id", "ord", "type", "value", "path")
    target = upserts.GenerationTable(spark, streams.shared_folder(spark, "merge"), "page_id long, ord long, type string, value string, path string", "page_id")
    target.load(old)
    fresh = target.current().filter("ord % 2 = 0").withColumn("value", F.concat("value", F.lit("-new")))  # every batch reads it
    orders = streams.read_stream(spark, root, "orders")
    roots = orders.select(F.col("o_orderkey").alias("page_id"), F.expr("'/html/body/div[' || CAST(o_orderkey % 4 + 1 AS STRING) || ']'").alias("root"))

    def merge(before, batch):
        return dedupe.merge_incremental(before, fresh.join(batch.select("page_id").distinct(), "page_id", "left_semi"), batch, "page_id")

    target.merge_stream(roots, merge, streams.shared_folder(spark, "merge-checkpoint"))
    return target.current().select("page_id", "type", "value", "ord")


# --- Boxes ----------------------------------------------------------------------------
BOXES = duck("boxes")


def _boxes(spark, root):
    return derive(spark, root, "boxes")


_PAIRS = f"""(SELECT a.page_id, a.ord AS a_ord, b.ord AS b_ord, {K.area('a', 'b')} AS shared, a.width * a.height AS aa, b.width * b.height AS ba
    FROM {BOXES} a JOIN {BOXES} b ON a.page_id = b.page_id AND a.ord < b.ord AND {K.overlap('a', 'b')})"""


def _pairs(spark, root):
    return B.overlap_pairs(_boxes(spark, root), "page_id", "ord")


@query("iou_pairs", f"SELECT page_id, a_ord, b_ord, round(shared / (aa + ba - shared), 6) AS iou FROM {_PAIRS} WHERE shared / (aa + ba - shared) > 0.1")
def iou_pairs(spark, root):
    return _pairs(spark, root).filter("iou > 0.1").select("page_id", "a_ord", "b_ord", F.round("iou", 6).alias("iou"))


@query(
    "contained_pairs",
    f"SELECT page_id, a_ord, b_ord, round(shared / aa, 6) AS a_in_b, round(shared / ba, 6) AS b_in_a FROM {_PAIRS} WHERE shared / aa > 0.7 OR shared / ba > 0.7",
)
def contained_pairs(spark, root):
    hits = _pairs(spark, root).filter("a_in_b > 0.7 OR b_in_a > 0.7")
    return hits.select("page_id", "a_ord", "b_ord", F.round("a_in_b", 6).alias("a_in_b"), F.round("b_in_a", 6).alias("b_in_a"))


# Boxes of all screens of a customer group on one grid: stacks of equal boxes, one group holding a third of them.
_STACKED = (
    "(SELECT page_id % 60 * CAST(page_id % 3 > 0 AS BIGINT) AS page_id, page_id * 100 + ord AS ord, floor(x / 60) * 60 AS x, floor(y / 50) * 50 AS y,"
    f" ceil(width / 70) * 70 AS width, ceil(height / 30) * 30 + CASE WHEN page_id % 1000 = 7 THEN 9000 ELSE 0 END AS height FROM {BOXES} b)"
)
_CLASSES = f"(SELECT page_id, x, y, width, height, min(ord) AS id, count(*) AS copies FROM {_STACKED} s GROUP BY ALL)"


def _stacked(spark, root):
    snap = {"x": F.floor(F.col("x") / 60) * 60, "y": F.floor(F.col("y") / 50) * 50, "width": F.ceil(F.col("width") / 70) * 70}
    tall = F.when(F.col("page_id") % 1000 == 7, 9000).otherwise(0)
    return _boxes(spark, root).select(
        (F.col("page_id") % 60 * (F.col("page_id") % 3 > 0).cast("long")).alias("page_id"), (F.col("page_id") * 100 + F.col("ord")).alias("ord"),
        *[c.cast("double").alias(k) for k, c in snap.items()], (F.ceil(F.col("height") / 30) * 30 + tall).cast("double").alias("height"),
    )


@query(
    "class_pairs",
    f"""SELECT page_id, a_class_id, b_class_id, CAST(pairs AS BIGINT) AS pairs, round(shared / (aa + ba - shared), 6) AS iou, round(shared / aa, 6) AS a_in_b, round(shared / ba, 6) AS b_in_a FROM (
      SELECT a.page_id, a.id AS a_class_id, b.id AS b_class_id, CASE WHEN a.id = b.id THEN a.copies * (a.copies - 1) // 2 ELSE a.copies * b.copies END AS pairs,
        {K.area('a', 'b')} AS shared, a.width * a.height AS aa, b.width * b.height AS ba
      FROM {_CLASSES} a JOIN {_CLASSES} b ON a.page_id = b.page_id AND (a.id < b.id OR (a.id = b.id AND a.copies > 1)) AND {K.overlap('a', 'b')})""",
)
def class_pairs(spark, root):
    """Overlaps of stacked boxes, by classes of equal boxes instead of by boxes."""
    found = B.class_pairs(B.box_classes(_stacked(spark, root), "page_id", "ord"), "page_id")
    shares = [F.round(c, 6).alias(c) for c in ("iou", "a_in_b", "b_in_a")]
    return found.select("page_id", "a_class_id", "b_class_id", "pairs", *shares)


@query("class_members", f"SELECT page_id, min(ord) OVER (PARTITION BY page_id, x, y, width, height) AS class_id, ord FROM {_STACKED} s")
def class_members(spark, root):
    """The class of every box."""
    boxes = _stacked(spark, root)
    return B.class_members(boxes, B.box_classes(boxes, "page_id", "ord"), "page_id", "ord")


@query(
    "enclosing_box",
    f"SELECT page_id, min(x) AS x, min(y) AS y, max(x + width) - min(x) AS width, max(y + height) - min(y) AS height, count(*) AS boxes FROM {BOXES} b GROUP BY page_id",
)
def enclosing_box(spark, root):
    return B.enclosing(_boxes(spark, root), ["page_id"])


@query(
    "clamp_boxes",
    "SELECT page_id, ord, cx AS x, cy AS y, greatest(1, least(floor(w + 0.5), 300 - cx)) AS width, greatest(1, least(floor(h + 0.5), 200 - cy)) AS height FROM ("
    f"SELECT page_id, ord, greatest(0, least(floor(x * 1.3 - 20 + 0.5), 300)) AS cx, greatest(0, least(floor(y * 1.3 - 10 + 0.5), 200)) AS cy, width * 1.1 AS w, height * 1.1 AS h FROM {BOXES} b)",
)
def clamp_boxes(spark, root):
    c = F.col
    return _boxes(spark, root).select(
        "page_id", "ord",
        *B.clamp(c("x") * 1.3 - 20, c("y") * 1.3 - 10, c("width") * 1.1, c("height") * 1.1, F.lit(300.0), F.lit(200.0)),
    )


@query("pad_boxes", f"SELECT page_id, ord, greatest(0, x - 4) AS x, greatest(0, y - 4) AS y, width + 8 AS width, height + 8 AS height FROM {BOXES} b")
def pad_boxes(spark, root):
    return _boxes(spark, root).select("page_id", "ord", *B.pad())


@query(
    "stack_rank",
    f"SELECT page_id, ord, row_number() OVER (PARTITION BY page_id, floor(x / 10 + 0.5), floor(y / 10 + 0.5) ORDER BY ord) - 1 AS stack_rank FROM {BOXES} b WHERE width > 0 AND height > 0",
)
def stack_rank(spark, root):
    return B.stack_rank(_boxes(spark, root), "page_id", "ord").select("page_id", "ord", "stack_rank")


_REGIONS = f"(SELECT page_id, ord, x, y, width / 2 AS width, height / 2 AS height, type FROM {BOXES} b WHERE ord % 2 = 0)"


@query(
    "mask_labels",
    f"SELECT e.page_id, e.ord, coalesce(arg_min({K.type_placeholder('r.type')}, r.ord), 'label ' || CAST(e.ord AS STRING)) AS label FROM (SELECT * FROM {BOXES} b WHERE ord % 2 = 1) e"
    f" LEFT JOIN {_REGIONS} r ON r.page_id = e.page_id AND {K.overlap('e', 'r')} GROUP BY e.page_id, e.ord",
)
def mask_labels(spark, root):
    """Labels of elements that meet a sensitive region show that region's placeholder (the first region wins)."""
    from hushlake.functions.placeholders import type_placeholder

    all_boxes = _boxes(spark, root)
    els = all_boxes.filter("ord % 2 = 1")
    regions = all_boxes.filter("ord % 2 = 0").select("page_id", "ord", "x", "y", (F.col("width") / 2).alias("width"), (F.col("height") / 2).alias("height"), "type")
    hits = B.overlap_join(els, regions, "page_id").groupBy("page_id", F.col("a_ord").alias("ord")).agg(F.min_by("b_type", "b_ord").alias("t"))
    out = els.select("page_id", "ord").join(hits, ["page_id", "ord"], "left")
    label = F.when(F.col("t").isNotNull(), type_placeholder(F.col("t"))).otherwise(F.concat(F.lit("label "), F.col("ord").cast("string")))
    return out.select("page_id", "ord", label.alias("label"))


_COVER = f"""(SELECT e.page_id, e.ord, e.type IN ('EMAIL', 'PASSWORD', 'CARD') AS sensitive, EXISTS (SELECT 1 FROM {BOXES} s WHERE s.page_id = e.page_id AND s.type IN ('EMAIL', 'PASSWORD')
      AND greatest(0, s.x - 4) <= e.x AND greatest(0, s.y - 4) <= e.y AND greatest(0, s.x - 4) + s.width + 8 >= e.x + e.width AND greatest(0, s.y - 4) + s.height + 8 >= e.y + e.height) AS covered
    FROM {BOXES} e)"""


def _covered(spark, root):
    all_boxes = _boxes(spark, root)
    marked = all_boxes.withColumn("sensitive", F.col("type").isin("EMAIL", "PASSWORD", "CARD"))
    redactions = all_boxes.filter(F.col("type").isin("EMAIL", "PASSWORD")).select("page_id", "ord", *B.pad())
    return evaluate.redaction_coverage(marked, redactions, "page_id", "ord")


@query("redaction_coverage", f"SELECT page_id, ord, sensitive, covered FROM {_COVER}")
def redaction_coverage(spark, root):
    return _covered(spark, root).select("page_id", "ord", "sensitive", "covered")


@query(
    "redaction_eval",
    f"""SELECT n AS sensitive_regions, tp AS redacted, n - tp AS missed, fp AS over_redacted, round(tp / (tp + fp), 4) AS precision, round(tp / n, 4) AS recall,
      round(2 * (tp / (tp + fp)) * (tp / n) / (tp / (tp + fp) + tp / n), 4) AS f1
    FROM (SELECT count(*) FILTER (sensitive) AS n, count(*) FILTER (sensitive AND covered) AS tp, count(*) FILTER (NOT sensitive AND covered) AS fp FROM {_COVER})""",
)
def redaction_eval(spark, root):
    return evaluate.redaction_eval(_covered(spark, root))


_NMS = f"""WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id, type ORDER BY confidence DESC, ord) AS rn FROM {BOXES} b),
  r AS (SELECT page_id, type, rn, [{{'x': x, 'y': y, 'width': width, 'height': height, 'ord': ord}}] AS kept FROM o WHERE rn = 1
    UNION ALL
    SELECT o.page_id, o.type, o.rn, CASE WHEN len(list_filter(kept, lambda k: ({K.area('k', 'o')}) / (k.width * k.height + o.width * o.height - ({K.area('k', 'o')})) > 0.5)) > 0
      THEN kept ELSE list_append(kept, {{'x': o.x, 'y': o.y, 'width': o.width, 'height': o.height, 'ord': o.ord}}) END
    FROM r JOIN o ON o.page_id = r.page_id AND o.type = r.type AND o.rn = r.rn + 1)
  SELECT page_id, type, k.ord AS ord, k.x AS x, k.y AS y FROM (SELECT page_id, type, unnest(kept) AS k FROM (SELECT page_id, type, arg_max(kept, rn) AS kept FROM r GROUP BY page_id, type))"""


@query("box_nms", _NMS)
def box_nms(spark, root):
    """Boxes that survive suppression per page and type."""
    return B.suppress(_boxes(spark, root), "page_id", "ord").select("page_id", "type", "ord", "x", "y")


def _fuse_sql() -> str:
    """One candidate a step: it joins the open cluster or waits; with nobody left to ask, the first that waits opens the next."""
    weight = "CASE type " + " ".join(f"WHEN '{t}' THEN {w}" for t, w in PRIORITY.items()) + " ELSE 0 END"
    start = "{'head': %s.ord, 'x': %s.x, 'y': %s.y, 'r': %s.r, 'b': %s.b, 'type': %s.type, 'weight': %s.weight, 'confidence': %s.confidence, 'sources': [%s.source], 'members': 1}"
    inter = "(greatest(0, least(c.r, o.r) - greatest(c.x, o.x)) * greatest(0, least(c.b, o.b) - greatest(c.y, o.y)))"
    own, other = "((c.r - c.x) * (c.b - c.y))", "((o.r - o.x) * (o.b - o.y))"
    joins = f"{inter} / ({own} + {other} - {inter}) > 0.4 OR {inter} / {own} > 0.7 OR {inter} / {other} > 0.7"
    grown = (
        "{'head': c.head, 'x': least(c.x, o.x), 'y': least(c.y, o.y), 'r': greatest(c.r, o.r), 'b': greatest(c.b, o.b),"
        " 'type': CASE WHEN o.weight > c.weight THEN o.type ELSE c.type END, 'weight': greatest(c.weight, o.weight),"
        " 'confidence': greatest(c.confidence, o.confidence), 'sources': list_append(c.sources, o.source), 'members': c.members + 1}"
    )

    def opened(by: str) -> str:
        return start.replace("%s", by)

    return f"""WITH RECURSIVE pages AS (SELECT page_id, list({{'ord': ord, 'x': x, 'y': y, 'r': x + width, 'b': y + height, 'type': type, 'weight': {weight},
        'confidence': confidence, 'source': source}} ORDER BY ord) AS rest FROM {BOXES} b GROUP BY page_id),
      steps AS (SELECT page_id, {opened('rest[1]')} AS c, rest[2:] AS todo, rest[1:0] AS waiting FROM pages
        UNION ALL
        SELECT page_id, CASE WHEN o IS NULL THEN {opened('waiting[1]')} WHEN {joins} THEN {grown} ELSE c END,
          CASE WHEN o IS NULL THEN waiting[2:] ELSE todo[2:] END,
          CASE WHEN o IS NULL THEN waiting[1:0] WHEN {joins} THEN waiting ELSE list_append(waiting, o) END
        FROM (SELECT *, todo[1] AS o FROM steps WHERE len(todo) > 0 OR len(waiting) > 0))
      SELECT page_id, c.head AS region, c.x AS x, c.y AS y, c.r - c.x AS width, c.b - c.y AS height, t AS type, round(c.confidence, 2) AS confidence,
        array_to_string(list_sort(list_distinct(c.sources)), ',') AS sources, CAST(c.members AS BIGINT) AS members, false AS redacted, {K.type_placeholder('t')} AS placeholder
      FROM (SELECT *, c.type AS t FROM steps WHERE len(todo) = 0)"""


@query("fuse_regions", _fuse_sql())
def fuse_regions(spark, root):
    """Regions fused from the detections of all sources."""
    return B.fuse(_boxes(spark, root), "page_id").withColumn("sources", F.array_join("sources", ","))


def _eye_sql() -> str:
    """The band step by step, each level using the columns of the one before."""
    def turned(c: str) -> str:
        return (
            f"CASE WHEN abs(roll) < 1e-6 THEN {c} ELSE floor(px + (({c} - px) * cos(roll) - (ey - py) * sin(roll)) + 0.5) END AS {c}x,"
            f" CASE WHEN abs(roll) < 1e-6 THEN ey ELSE floor(py + (({c} - px) * sin(roll) + (ey - py) * cos(roll)) + 0.5) END AS {c}y"
        )

    faces = f"SELECT page_id, ord, x, y, width, height, (ord % 7 - 3) / 10 AS roll FROM {BOXES} b WHERE type = 'FACE'"
    base = f"SELECT *, x + width / 2 AS px, y + height / 2 AS py, y + height * 0.40::DOUBLE AS ey, x + width * 0.33::DOUBLE AS l, x + width * 0.67::DOUBLE AS r FROM ({faces})"
    eyes = f"SELECT *, {turned('l')}, {turned('r')} FROM ({base})"
    line = f"SELECT *, greatest(1, sqrt((rx - lx) * (rx - lx) + (ry - ly) * (ry - ly))) AS d, atan2(ry - ly, rx - lx) AS a, floor((lx + rx) / 2 + 0.5) AS cx, floor((ly + ry) / 2 + 0.5) AS cy FROM ({eyes})"
    size = (
        f"SELECT *, floor(d + 2 * floor(d * 0.38::DOUBLE + 0.5) + 0.5) AS n, floor(greatest(CASE WHEN height <> 0 THEN height ELSE d * 2.2::DOUBLE END * 0.22::DOUBLE,"
        f" d * 0.36::DOUBLE, greatest(10, floor(height * 0.12::DOUBLE + 0.5)) * 1.8::DOUBLE, 18) + 0.5) AS t FROM ({line})"
    )
    return (
        "SELECT page_id, ord, cx AS center_x, cy AS center_y, floor(cx - n / 2 * cos(a) + 0.5) AS start_x, floor(cy - n / 2 * sin(a) + 0.5) AS start_y,"
        f" floor(cx + n / 2 * cos(a) + 0.5) AS end_x, floor(cy + n / 2 * sin(a) + 0.5) AS end_y, round(a, 6) AS angle, n AS length, t AS thickness FROM ({size})"
    )


@query("eye_bands", _eye_sql())
def eye_bands(spark, root):
    faces = _boxes(spark, root).filter("type = 'FACE'").withColumn("roll", (F.col("ord") % 7 - 3) / 10)
    return faces.select("page_id", "ord", *B.eye_band()).withColumn("angle", F.round("angle", 6))


_TAGS = "SELECT l_orderkey AS page_id, l_linenumber, l_partkey, CASE l_partkey % 9 WHEN 0 THEN 'FORM' WHEN 1 THEN 'button' WHEN 2 THEN 'table' WHEN 3 THEN 'div' WHEN 4 THEN 'svg' WHEN 5 THEN 'pre' WHEN 6 THEN 'select' WHEN 7 THEN 'span' ELSE 'li' END AS tag, CASE l_suppkey % 6 WHEN 0 THEN 'Dialog' WHEN 1 THEN 'grid' WHEN 2 THEN 'button' ELSE NULL END AS role FROM {lineitem}"
_R = "lower(coalesce(role, ''))"


@query(
    "classify_elements",
    f"SELECT k AS visual_class, CASE k WHEN 'form' THEN 0.95 WHEN 'button' THEN 0.92 WHEN 'table' THEN 0.9 WHEN 'dialog' THEN 0.95 WHEN 'chart' THEN 0.8 WHEN 'code' THEN 0.88 WHEN 'input' THEN 0.92 END::DOUBLE AS class_confidence, count(*) AS n FROM ("
    f"SELECT CASE WHEN lower(tag) = 'form' OR {_R} = 'form' THEN 'form' WHEN lower(tag) = 'button' OR {_R} = 'button' THEN 'button' WHEN lower(tag) = 'table' OR {_R} IN ('table', 'grid') THEN 'table'"
    f" WHEN {_R} IN ('dialog', 'alertdialog') THEN 'dialog' WHEN lower(tag) IN ('canvas', 'svg') THEN 'chart' WHEN lower(tag) IN ('pre', 'code') THEN 'code' WHEN lower(tag) IN ('input', 'textarea', 'select') THEN 'input' END AS k"
    f" FROM ({_TAGS.replace('{lineitem}', 'lineitem')})) WHERE k IS NOT NULL GROUP BY k",
)
def classify_elements(spark, root):
    els = spark.sql(_TAGS, lineitem=table(spark, root, "lineitem"))
    return els.select(*B.visual_class(F.col("tag"), F.col("role"))).filter("visual_class is not null").groupBy(
        "visual_class", "class_confidence"
    ).agg(F.count("*").alias("n"))


# --- Recognised words -----------------------------------------------------------------
WORDS = duck("ocr_words")


@query("ocr_filter", f"SELECT page_id, ord, text, conf / 100 AS confidence FROM {WORDS} w WHERE conf >= 40 AND text <> ''")
def ocr_filter(spark, root):
    words = derive(spark, root, "ocr_words").filter((F.col("conf") >= 40) & (F.col("text") != ""))
    return words.select("page_id", "ord", "text", (F.col("conf") / 100).alias("confidence"))


@query(
    "ocr_region_offset",
    f"SELECT w.page_id, w.ord, w.x + r.x AS x, w.y + r.y AS y, w.width, w.height FROM {WORDS} w JOIN (SELECT page_id, ord, x, y FROM {BOXES} b) r ON r.page_id = w.page_id AND r.ord = w.region_id",
)
def ocr_region_offset(spark, root):
    """Words of a cropped region in the coordinates of the page."""
    words = derive(spark, root, "ocr_words")
    regions = _boxes(spark, root).select("page_id", F.col("ord").alias("region_id"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    out = words.join(regions, ["page_id", "region_id"])
    return out.select("page_id", "ord", (F.col("x") + F.col("rx")).alias("x"), (F.col("y") + F.col("ry")).alias("y"), "width", "height")


_LINES = f"""WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y, x, ord) AS rn FROM {WORDS} w),
  r AS (SELECT page_id, rn, 1 AS line, x, y, width, height, text FROM o WHERE rn = 1
    UNION ALL
    SELECT o.page_id, o.rn, CASE WHEN j THEN line ELSE line + 1 END, CASE WHEN j THEN least(r.x, o.x) ELSE o.x END, CASE WHEN j THEN r.y ELSE o.y END,
      CASE WHEN j THEN greatest(least(r.x, o.x) + r.width, o.x + o.width) - least(r.x, o.x) ELSE o.width END,
      CASE WHEN j THEN greatest(r.height, o.height) ELSE o.height END, CASE WHEN j THEN r.text || ' ' || o.text ELSE o.text END
    FROM (SELECT r.*, abs(n.y - (r.y + r.height / 2)) < r.height * 0.6 AS j FROM r JOIN o n ON n.page_id = r.page_id AND n.rn = r.rn + 1) r
    JOIN o ON o.page_id = r.page_id AND o.rn = r.rn + 1)
  SELECT page_id, arg_max(text, rn) AS text, arg_max(x, rn) AS x, arg_max(y, rn) AS y, arg_max(width, rn) AS width, arg_max(height, rn) AS height FROM r GROUP BY page_id, line"""


@query("ocr_lines", _LINES)
def ocr_lines(spark, root):
    return B.words_to_lines(derive(spark, root, "ocr_words"), "page_id")


@query(
    "structure_eval",
    """SELECT CAST(sum(els) AS BIGINT) AS elements, 1.0::DOUBLE AS actionable_recall, round(sum(good) / sum(els), 4) AS role_accuracy, round(sum(els - 1) / sum(els), 4) AS valid_boxes,
      round(1.0 * 0.4 + sum(good) / sum(els) * 0.3 + sum(els - 1) / sum(els) * 0.3, 4) AS fidelity FROM (
      SELECT CASE WHEN c_custkey % 3 = 2 THEN 6 ELSE 7 END AS els, CASE WHEN c_custkey % 3 = 2 THEN 4 ELSE 5 END AS good FROM customer)""",
)
def structure_eval(spark, root):
    """Fidelity of the element table of the form pages; the check counts the fields the forms were built from."""
    els = E.interactive(E.elements(derive(spark, root, "forms"), ["page_id"]), "page_id")
    rated = els.select(
        F.upper("tag").alias("tag"), "role", F.col("tag").isin("input", "button", "textarea").alias("actionable"),
        F.lit(10.0).alias("width"), F.when(F.col("tag") == "form", 0.0).otherwise(5.0).alias("height"),
    )
    return evaluate.structure_eval(rated)


_SEL = "coalesce(selector, '')"
_TGT = f"lower({_SEL} || ' ' || coalesce(target, ''))"
_TIERS = f"""SELECT a.id, a.action, CASE WHEN requires_confirmation THEN 'requested' WHEN action = 'submit' THEN 'submit'
    WHEN regexp_matches({_SEL}, {K.q(dims.CONFIRM_CREDENTIAL)}) OR contains(upper(coalesce(value_ref, '')), 'PASSWORD') OR contains(upper(coalesce(value_ref, '')), 'PIN') THEN 'credential'
    WHEN regexp_matches({_SEL}, {K.q(dims.CONFIRM_PAYMENT)}) THEN 'payment' WHEN regexp_matches({_SEL}, {K.q(dims.CONFIRM_DESTRUCTIVE)}) THEN 'destructive'
    WHEN h.id IS NOT NULL THEN 'sensitive_region' END AS tier, action = 'submit' OR {' OR '.join(f"contains({_TGT}, {K.q(w)})" for w in dims.SERVER_SENSITIVE_WORDS)} AS server_confirms
  FROM {duck('actions')} a LEFT JOIN (SELECT DISTINCT t.id FROM (SELECT id, user_id % 100 AS page_id, CAST(id % 60 * 5 AS DOUBLE) AS x, CAST(id % 40 * 5 AS DOUBLE) AS y, 20.0 AS width, 10.0 AS height
    FROM {duck('actions')} a2) t JOIN {BOXES} r ON r.page_id = t.page_id AND r.type = 'PASSWORD' AND {K.overlap('t', 'r')}) h ON h.id = a.id"""


@query("action_tiers", _TIERS)
def action_tiers(spark, root):
    """Why logged actions need a confirmation, with the overlap of their targets and sensitive regions."""
    actions = derive(spark, root, "actions")
    boxes = _boxes(spark, root)
    targets = actions.select(
        "id", (F.col("user_id") % 100).alias("page_id"), (F.col("id") % 60 * 5).cast("double").alias("x"),
        (F.col("id") % 40 * 5).cast("double").alias("y"), F.lit(20.0).alias("width"), F.lit(10.0).alias("height"),
    )
    regions = boxes.filter("type = 'PASSWORD'").select("page_id", "ord", "x", "y", "width", "height")
    return audits.confirmation_tiers(actions, targets, regions).select("id", "action", "tier", "server_confirms")
