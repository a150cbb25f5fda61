"""Queries on scans and span detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from hushlake.functions import checks
from hushlake.functions.text import match_line, preview
from hushlake.operators import redact, spans
from hushlake.plans import sqlkit as K
from hushlake.plans.registry import query
from hushlake.sources.derived import derive, duck
from hushlake.sources.tables import table, texts

COLS = ["doc_id", "type", "value", "start", "end", "confidence"]
SQL_COLS = 'doc_id, type, value, start, "end", confidence'


def documents(spark, root):
    return texts(spark, root, "documents", ["doc_id", "text"])


@query(
    "scan_documents",
    "SELECT lang, source, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars,"
    " CAST(sum(CASE WHEN length(text) >= 6 THEN 1 ELSE 0 END) AS BIGINT) AS scannable FROM documents GROUP BY lang, source",
)
def scan_documents(spark, root):
    """Volume of text to be scanned, per language and source."""
    docs = table(spark, root, "documents")
    return docs.groupBy("lang", "source").agg(
        F.count("*").alias("docs"), F.sum("n_chars").alias("chars"), F.count_if(F.length("text") >= 6).alias("scannable")
    )


@query("detect_spans", f"SELECT {SQL_COLS} FROM ({K.spans('documents')})")
def detect_spans(spark, root):
    return spans.detect(documents(spark, root), ["doc_id"]).select(*COLS)


def _register(name: str, types: list[str], prompt: bool = False) -> None:
    def run(spark, root):
        found = spans.detect(derive(spark, root, "corpus"), ["doc_id"], types=types, prompt_rules=prompt)
        return found.select(*COLS)

    run.__name__ = name
    query(name, f"SELECT {SQL_COLS} FROM ({K.spans(duck('corpus'), types=types, prompt=prompt)})")(run)


for _name, _types in {
    "detect_email": ["EMAIL"],
    "detect_phone": ["PHONE"],
    "detect_card": ["CARD"],
    "detect_gov_id": ["GOV_ID"],
    "detect_aadhaar": ["AADHAAR"],
    "detect_tax_id": ["PAN"],
    "detect_bank_code": ["IFSC"],
    "detect_generic_key": ["API_KEY"],
    "detect_vendor_keys": [
        "OPENAI_KEY", "ANTHROPIC_KEY", "GITHUB_TOKEN", "GOOGLE_KEY", "JWT_SECRET", "AWS_KEY", "AZURE_KEY",
        "SUPABASE_KEY", "FIREBASE_CONFIG", "STRIPE_KEY", "RAZORPAY_KEY",
    ],
}.items():
    _register(_name, _types)
_register("detect_db_urls", ["MONGODB_URL", "POSTGRES_URL", "MYSQL_URL", "REDIS_URL", "DATABASE_URL"], prompt=True)
_register("detect_pem", ["PRIVATE_KEY"], prompt=True)


def _register_rule(name: str, type_: str, ords: list[int], doc: str) -> None:
    """One rule out of those that share a type."""

    def run(spark, root):
        found = spans.detect(derive(spark, root, "corpus"), ["doc_id"], types=[type_], prompt_rules=True)
        return found.filter(F.col("ord").isin(ords)).select(*COLS)

    run.__name__, run.__doc__ = name, doc
    wanted = ", ".join(map(str, ords))
    query(
        name,
        f"SELECT {SQL_COLS} FROM ({K.spans(duck('corpus'), types=[type_], prompt=True)}) WHERE ord IN ({wanted})",
    )(run)


_P = spans.PROMPT_ORD
_register_rule("detect_password_phrase", "PASSWORD", [_P], "Values behind a password wording.")
_register_rule("detect_strong_token", "PASSWORD", [_P + 1], "Words that look like strong passwords.")
_register_rule("detect_assigned_key", "API_KEY", [_P + 2, _P + 3], "Keys by assignment and bearer tokens.")


def _address_oracle(src: str) -> str:
    from hushlake.functions.catalog import ADDRESS_RULES

    parts = []
    for i, (pattern, conf) in enumerate(ADDRESS_RULES):
        p = K.re2(pattern, True)
        parts.append(
            f"SELECT doc_id, {i} AS rule, unnest(range(1, len(ms) + 1)) AS k, {K.trim('unnest(ms)')} AS value, {conf} AS confidence"
            f" FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS ms FROM {src} a0)"
        )
    return (
        "SELECT doc_id, 'ADDRESS' AS type, value, CAST(confidence AS DOUBLE) AS confidence FROM (SELECT *, row_number() OVER"
        " (PARTITION BY doc_id, lower(value) ORDER BY rule, k) AS rn FROM (" + " UNION ALL ".join(parts) + ")"
        f" WHERE length(value) >= 3 AND NOT {K.allowlisted('value')}) WHERE rn = 1"
    )


@query("detect_address", _address_oracle(duck("corpus")))
def detect_address(spark, root):
    return spans.detect_addresses(derive(spark, root, "corpus"), ["doc_id"])


_CARD16 = "lpad(CAST((o_orderkey * 8191) % 1000000000 AS STRING), 15, '0')"
_NUM12 = "'3' || lpad(CAST((o_orderkey * 97) % 100000000000 AS STRING), 11, '0')"


@query("luhn_filter", f"SELECT o_orderkey, '4' || {_CARD16} AS digits FROM orders WHERE {K.luhn(chr(39) + '4' + chr(39) + ' || ' + _CARD16)}")
def luhn_filter(spark, root):
    numbers = table(spark, root, "orders").select("o_orderkey", F.expr(f"'4' || {_CARD16}").alias("digits"))
    return numbers.filter(checks.luhn(F.col("digits")))


@query("verhoeff_filter", f"SELECT o_orderkey, {_NUM12} AS digits FROM orders WHERE {K.verhoeff('(' + _NUM12 + ')')}")
def verhoeff_filter(spark, root):
    numbers = table(spark, root, "orders").select("o_orderkey", F.expr(_NUM12).alias("digits"))
    return numbers.filter(checks.verhoeff(F.col("digits")))


_WORDS = "regexp_extract_all(text, '[A-Za-z0-9]+', 0)"
_ALLOWED_SQL = ", ".join(K.q(t) for t in __import__("hushlake.functions.dims", fromlist=["dims"]).ALLOWED_TERMS)


@query(
    "allowlist_anti",
    "SELECT p_type, p_name, count(*) AS n FROM part WHERE NOT "
    + K.allowlisted("p_name")
    + " GROUP BY p_type, p_name UNION ALL SELECT 'note' AS p_type, w AS p_name, count(*) AS n FROM (SELECT unnest("
    + "string_split(regexp_replace(text, '[^A-Za-z0-9_\\[\\]=.]+', ' ', 'g'), ' ')) AS w FROM " + duck("notes") + " z) WHERE w <> '' AND NOT "
    + K.allowlisted("w") + " GROUP BY w",
)
def allowlist_anti(spark, root):
    """Candidate terms that are not allowlisted."""
    parts = table(spark, root, "part").groupBy("p_type", "p_name").agg(F.count("*").alias("n"))
    notes = derive(spark, root, "notes")
    words = F.split(F.regexp_replace("text", r"[^A-Za-z0-9_\[\]=.]+", " "), " ")
    tokens = notes.select(F.explode(words).alias("p_name")).filter("p_name <> ''")
    counted = tokens.groupBy("p_name").agg(F.count("*").alias("n")).select(F.lit("note").alias("p_type"), "p_name", "n")
    return parts.unionByName(counted).filter(~checks.allowlisted(F.col("p_name")))


@query("min_confidence", f"SELECT {SQL_COLS} FROM ({K.spans('documents')}) WHERE confidence >= 0.9")
def min_confidence(spark, root):
    return spans.detect(documents(spark, root), ["doc_id"]).filter(F.col("confidence") >= 0.9).select(*COLS)


_TOKENS = (
    "SELECT DISTINCT w FROM (SELECT unnest(string_split(regexp_replace(text, '[^A-Za-z0-9_\\-]+', ' ', 'g'), ' ')) AS w FROM "
    + duck("corpus") + " c) WHERE length(w) >= 16"
)


@query(
    "entropy_filter",
    "SELECT w AS token, round(h, 6) AS entropy FROM (SELECT w, -sum(n * 1.0 / t * log2(n * 1.0 / t)) AS h FROM ("
    "SELECT w, c, count(*) AS n, any_value(length(w)) AS t FROM (SELECT w, unnest(string_split(w, '')) AS c FROM ("
    + _TOKENS + ")) WHERE c <> '' GROUP BY w, c) GROUP BY w) WHERE h > 3.5",
)
def entropy_filter(spark, root):
    """Distinct long tokens with high entropy; entropy is computed inside the row."""
    words = F.split(F.regexp_replace("text", r"[^A-Za-z0-9_\-]+", " "), " ")
    corpus = derive(spark, root, "corpus").filter(F.col("text").rlike(r"[\w\-]{16}"))
    long = F.filter(words, lambda w: F.length(w) >= 16)
    tokens = corpus.select(F.explode_outer(F.array_distinct(long)).alias("token")).filter("token is not null").distinct()
    return tokens.withColumn("h", checks.shannon_entropy(F.col("token"))).filter("h > 3.5").select(
        "token", F.round("h", 6).alias("entropy")
    )


@query(
    "match_line",
    "SELECT s.doc_id, s.type, s.start, coalesce(list_filter(string_split(d.text, chr(10)), lambda l: contains(l, s.value))[1], d.text) AS line"
    f" FROM ({K.spans('documents', types=['EMAIL', 'CARD', 'PHONE'])}) s JOIN documents d USING (doc_id)",
)
def match_line_query(spark, root):
    """Line that holds each match, cut out while the text is still in the row."""
    found = spans.with_spans(documents(spark, root), types=["EMAIL", "CARD", "PHONE"])
    with_lines = found.select(
        "doc_id",
        F.explode_outer(
            F.transform(
                "spans",
                lambda s: F.struct(
                    s["type"].alias("type"), s["start"].cast("long").alias("start"),
                    match_line(F.col("text"), s["value"]).alias("line"),
                ),
            )
        ).alias("m"),
    )
    return with_lines.filter(F.col("m").isNotNull()).select("doc_id", "m.*")


@query(
    "value_preview",
    f"SELECT doc_id, type, start, CASE WHEN length(value) <= 12 THEN value ELSE substr(value, 1, 12) || '…' END AS preview"
    f" FROM ({K.spans('documents')})",
)
def value_preview(spark, root):
    found = spans.detect(documents(spark, root), ["doc_id"])
    return found.select("doc_id", "type", "start", preview(F.col("value"), 12).alias("preview"))


@query(
    "resolve_overlaps",
    f"SELECT {SQL_COLS} FROM {K.resolved(K.spans(duck('corpus'), types=['EMAIL', 'PHONE', 'CARD', 'GOV_ID', 'AADHAAR', 'PAN']))}",
)
def resolve_overlaps(spark, root):
    """Disjoint spans of the page detectors: leftmost, then longest."""
    types = ["EMAIL", "PHONE", "CARD", "GOV_ID", "AADHAAR", "PAN"]
    found = spans.with_spans(derive(spark, root, "corpus"), types=types)
    kept = found.withColumn("spans", redact.resolve_overlaps("spans"))
    return spans.explode_spans(kept, ["doc_id"]).select(*COLS)


@query(
    "distinct_types",
    f"SELECT doc_id, count(DISTINCT type) AS types, count(DISTINCT value) AS distinct_values, count(*) AS spans FROM ({K.spans('documents')}) GROUP BY doc_id",
)
def distinct_types(spark, root):
    found = spans.detect(documents(spark, root), ["doc_id"])
    return found.groupBy("doc_id").agg(
        F.countDistinct("type").alias("types"), F.countDistinct("value").alias("distinct_values"), F.count("*").alias("spans")
    )


@query("items_by_type", f"SELECT {SQL_COLS} FROM ({K.spans('documents', types=['CARD'])})")
def items_by_type(spark, root):
    """Detections of one type.  The filter is part of the plan: the other detectors are not even built."""
    return spans.detect(documents(spark, root), ["doc_id"], types=["CARD"]).select(*COLS)


@query(
    "union_detectors",
    f"SELECT doc_id, 'regex' AS method, type, value, confidence FROM ({K.spans(duck('corpus'), types=['EMAIL', 'CARD', 'PHONE'])})"
    f" UNION ALL SELECT doc_id, 'ner' AS method, type, value, confidence FROM ({_address_oracle(duck('corpus'))})",
)
def union_detectors(spark, root):
    """Detections of the pattern and the address rules with their origin."""
    corpus = derive(spark, root, "corpus")
    a = spans.detect(corpus, ["doc_id"], types=["EMAIL", "CARD", "PHONE"]).select("doc_id", "type", "value", "confidence")
    b = spans.detect_addresses(corpus, ["doc_id"])
    return a.withColumn("method", F.lit("regex")).unionByName(b.withColumn("method", F.lit("ner")))
