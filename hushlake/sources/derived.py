"""Tables that are derived row by row from the lake tables.

The statements use only SQL that Spark and DuckDB share, so the same text feeds a query and
its check.  ``{name}`` stands for an input table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from hushlake.functions.text import once
from hushlake.sources.tables import dealt, table

_K = "o_orderkey"
_H = f"md5(CAST({_K} AS STRING))"


def _n(expr: str, width: int | None = None) -> str:
    s = f"CAST({expr} AS STRING)"
    return s if width is None else f"lpad({s}, {width}, '0')"


def _letters(n: int) -> str:
    return f"translate(substr({_H}, 1, {n}), '0123456789abcdef', 'ABCDEFGHIJKLMNOP')"


# Every kind of value once, with key-like strings put together from parts.
_NOTES = [
    f"'Write to user' || {_n(_K)} || '@mail' || {_n(_K + ' % 7')} || '.example.com or user' || {_n(_K)} || '@mail.example.org'",
    f"'Call +91 98' || {_n(_K + ' % 100000000', 8)} || ' or (' || {_n(_K + ' % 900 + 100', 3)} || ') 555-' || {_n(_K + ' % 10000', 4)}",
    f"'Card 4' || {_n(_K + ' % 1000', 3)} || ' ' || {_n(f'({_K} * 7) % 10000', 4)} || ' ' || {_n(f'({_K} * 13) % 10000', 4)} || ' '"
    f" || {_n(f'({_K} * 31) % 10000', 4)} || ' or 4' || {_n(f'({_K} * 8191) % 1000000000', 15)}",
    f"'SSN ' || {_n(_K + ' % 800 + 100', 3)} || '-' || {_n(_K + ' % 100', 2)} || '-' || {_n(_K + ' % 10000', 4)} || ' passport '"
    f" || chr(CAST(65 + {_K} % 26 AS INT)) || {_n(_K + ' % 100000000', 8)}",
    f"'Aadhaar 2' || {_n(_K + ' % 1000', 3)} || ' ' || {_n(f'({_K} * 3) % 10000', 4)} || ' ' || {_n(f'({_K} * 17) % 10000', 4)}",
    f"'Number 3' || {_n(f'({_K} * 97) % 100000000000', 11)} || ' and 123456789012'",
    f"'PAN ' || {_letters(5)} || {_n(_K + ' % 10000', 4)} || 'K ok'",
    f"'Branch ' || {_letters(4)} || '0' || {_n(_K + ' % 1000000', 6)}",
    f"'OPENAI_API_KEY=' || 'sk' || '-proj-' || {_H}",
    f"'const anthropicKey = \"' || 'sk' || '-ant-' || {_H} || '\"'",
    f"'export GITHUB_TOKEN=' || 'gh' || 'p_' || {_H} || substr({_H}, 1, 4) || chr(10) || 'gitlab: gh' || 'p_short'",
    f"'NEXT_PUBLIC_GOOGLE_MAPS_API_KEY=\"' || 'AI' || 'za' || {_H} || '\"'",
    f"'session ey' || 'J' || {_H} || '.' || {_H} || '.' || substr({_H}, 1, 20) || ' end'",
    f"'mongo at mongodb+srv://app' || {_n(_K)} || ':pw' || {_H} || '@db' || {_n(_K + ' % 9')} || '.example.net:27017/main'",
    f"'DATABASE_URL=postgres://svc:' || substr({_H}, 1, 12) || '@10.0.0.' || {_n(_K + ' % 250')} || ':5432/prod'",
    f"'backup mysql://root:' || substr({_H}, 3, 10) || '@db.example.net/shop; done'",
    f"'cache redis://:' || substr({_H}, 1, 8) || '@cache' || {_n(_K + ' % 5')} || '.example.net:6379/0'",
    f"'AWS_ACCESS_KEY_ID=' || 'AK' || 'IA' || upper(substr({_H}, 1, 16))",
    f"'DefaultEndpointsProtocol=https;AccountName=store' || {_n(_K)} || ';AccountKey=' || {_H} || '=='",
    f"'supabase sb' || 'p_' || {_H}",
    f"'cfg = ' || chr(123) || ' apiKey: \"' || {_H} || '\", authDomain: \"app' || {_n(_K)} || '.example.com\" ' || chr(125)",
    f"'stripe_secret: ' || 'sk' || '_test_' || substr({_H}, 1, 24)",
    f"'pay with rz' || 'p_live_' || substr({_H}, 1, 20)",
    f"'Ship to ' || {_n(_K + ' % 9000 + 1')} || ' Oak Street Apt ' || {_n(_K + ' % 50')} || chr(10) || 'Dallas, TX ' || {_n(_K + ' % 100000', 5)}"
    f" || ' and DALLAS, TX ' || {_n(_K + ' % 100000', 5)}",
    f"'My password is Hunter' || {_n(_K)} || '! and pwd: \"s3cret' || {_n(_K)} || '\". Pass = YOUR_PASSWORD'",
    f"'use Zx9!' || substr({_H}, 1, 8) || 'Q here. Not abcdefgh1! but Ab1?' || substr({_H}, 2, 6) || ', ok'",
    f"'api_key: \"' || {_H} || '\" then Authorization: Bearer ' || {_H} || '.' || substr({_H}, 1, 6) || ' now'",
    f"'key:' || chr(10) || '-----BEGIN RSA PRI' || 'VATE KEY-----' || chr(10) || {_H} || chr(10) || '-----END RSA PRI' || 'VATE KEY-----' || chr(10) || 'end'",
    f"'jdbc:mysql://db' || {_n(_K)} || '.example.net/x?user=a, then mariadb://h' || {_n(_K)} || '/d.'",
    f"{_H} || ' is the access token of job ' || {_n(_K)} || chr(10) || 'some_rather_long_variable_name = value of a key'",
    "'EMAIL=YOUR_EMAIL, [PASSWORD] password: YOUR_PASSWORD1 and github settings ' || o_orderpriority",
    f"'Order ' || {_n(_K)} || ' with priority ' || o_orderpriority || ' was shipped'",
]

_NOTE_CASE = "CASE o_orderkey % 32 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_NOTES)) + " END"

SQL: dict[str, str] = {
    # One short text per order.
    "notes": f"SELECT o_orderkey AS doc_id, {_NOTE_CASE} AS text FROM {{orders}}",
    # Documents and notes together.
    "corpus": (
        "SELECT doc_id, text FROM {documents} UNION ALL "
        f"SELECT 1000000000 + o_orderkey AS doc_id, {_NOTE_CASE} AS text FROM {{orders}}"
    ),
    # A screen per order, a box per line item.
    "boxes": """
        SELECT l_orderkey AS page_id,
               CAST(row_number() OVER (PARTITION BY l_orderkey
                    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS ord,
               CASE l_partkey % 6 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PASSWORD' WHEN 2 THEN 'CARD'
                    WHEN 3 THEN 'PHONE' WHEN 4 THEN 'FACE' ELSE 'API_KEY' END AS type,
               CASE l_returnflag WHEN 'A' THEN 'dom' WHEN 'N' THEN 'regex' ELSE 'ocr' END AS source,
               CAST(60 + l_linenumber * 5 AS DOUBLE) / 100 AS confidence,
               CAST(l_partkey % 60 * 5 AS DOUBLE) AS x,
               CAST(l_suppkey % 40 * 5 AS DOUBLE) AS y,
               CAST(40 + l_quantity * 2 AS DOUBLE) AS width,
               CAST(20 + l_partkey % 13 * 3 AS DOUBLE) AS height
        FROM {lineitem}""",
    # Recognised words of a screen.
    "ocr_words": """
        SELECT l_orderkey AS page_id,
               CAST(row_number() OVER (PARTITION BY l_orderkey
                    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS ord,
               CASE l_partkey % 4
                    WHEN 0 THEN 'mail' || CAST(l_partkey AS STRING) || '@ocr.example.com'
                    WHEN 1 THEN '4' || lpad(CAST((l_partkey * 8191) % 1000000000 AS STRING), 15, '0')
                    WHEN 2 THEN 'supplier ' || CAST(l_suppkey AS STRING)
                    ELSE 'line' END AS text,
               CAST(25 + l_quantity AS DOUBLE) AS conf,
               CAST(l_partkey % 60 * 10 AS DOUBLE) AS x,
               CAST(l_linenumber * 14 + l_suppkey % 5 AS DOUBLE) AS y,
               CAST(30 + l_quantity AS DOUBLE) AS width,
               CAST(8 + l_partkey % 7 AS DOUBLE) AS height,
               CAST(l_suppkey % 3 AS BIGINT) AS region_id
        FROM {lineitem}""",
    # A form page per customer.
    "forms": """
        SELECT c_custkey AS page_id,
               'https://shop.example.com/profile/' || CAST(c_custkey AS STRING) AS url,
               '<html><head><title>Profile</title></head><body><form id="f' || CAST(c_custkey AS STRING) || '">'
               || '<label for="mail">E-mail address</label>'
               || '<input id="mail" name="contact" type="email" value="cust' || CAST(c_custkey AS STRING) || '@example.com">'
               || '<input name="fullname" type="text" value="' || c_name || '" aria-label="Your name">'
               || CASE WHEN c_custkey % 3 = 0 THEN '<input name="pwd" type="password" value="Zq' || CAST(c_custkey AS STRING) || '!x">'
                       WHEN c_custkey % 3 = 1 THEN '<input id="userpassword" type="text">' ELSE '' END
               || '<input type="hidden" name="owner" value="hidden owner">'
               || '<textarea name="bio">Card 4' || lpad(CAST((c_custkey * 8191) % 1000000000 AS STRING), 15, '0') || ' on file</textarea>'
               || '<p>The word password in plain text is fine for ' || c_mktsegment || '</p>'
               || '<button type="submit">Save</button></form></body></html>' AS html
        FROM {customer}""",
    # Addresses of many kinds, one per order.
    "visits": """
        SELECT o_orderkey AS page_id,
               CASE o_orderkey % 24
                 WHEN 0 THEN 'https://web.whatsapp.com/'
                 WHEN 1 THEN 'https://app.slack.com/client/T' || CAST(o_orderkey AS STRING)
                 WHEN 2 THEN 'https://www.facebook.com/messages/t/' || CAST(o_custkey AS STRING)
                 WHEN 3 THEN 'https://www.facebook.com/groups/' || CAST(o_custkey AS STRING)
                 WHEN 4 THEN 'https://m.youtube.com/feed/library'
                 WHEN 5 THEN 'https://www.youtube.com/watch?v=' || CAST(o_orderkey AS STRING)
                 WHEN 6 THEN 'https://chatgpt.com/c/' || CAST(o_orderkey AS STRING)
                 WHEN 7 THEN 'https://gemini.google.com/app'
                 WHEN 8 THEN 'https://shop.example.com/login?next=/cart'
                 WHEN 9 THEN 'https://accounts.example.com/start'
                 WHEN 10 THEN 'https://acme' || CAST(o_custkey % 50 AS STRING) || '.okta.com/home'
                 WHEN 11 THEN 'https://shop.example.com/oauth/callback?code=' || CAST(o_orderkey AS STRING)
                 WHEN 12 THEN 'https://shop.example.com/view?mode=login'
                 WHEN 13 THEN 'https://shop.example.com/inbox/' || CAST(o_orderkey AS STRING)
                 WHEN 14 THEN 'https://shop.example.com/feed/'
                 WHEN 15 THEN 'https://shop.example.com:8443/item/' || CAST(o_orderkey AS STRING) || '?email=u' || CAST(o_custkey AS STRING) || '@example.com#top'
                 WHEN 16 THEN 'chrome://settings/privacy'
                 WHEN 17 THEN 'not an address ' || CAST(o_orderkey AS STRING)
                 WHEN 18 THEN 'https://api.openai.com/v1/chat'
                 WHEN 19 THEN 'https://api.groq.com/openai/v1'
                 WHEN 20 THEN 'https://chromewebstore.google.com/detail/' || CAST(o_orderkey AS STRING)
                 WHEN 21 THEN 'https://search.example.com/?q=visit+claude.ai'
                 WHEN 22 THEN 'https://intra' || CAST(o_custkey % 20 AS STRING) || '.corp.example.net/wall/' || CAST(o_orderkey AS STRING)
                 ELSE 'http://user:pw@files.example.org:80/a/b?token=t' || CAST(o_orderkey AS STRING) END AS url
        FROM {orders}""",
    # Detections with a status and a selector, for the record-keeping operators.
    "items": """
        SELECT l_orderkey AS scan_id,
               CAST(row_number() OVER (PARTITION BY l_orderkey
                    ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS BIGINT) AS ord,
               CASE l_partkey % 8 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PASSWORD' WHEN 2 THEN 'CARD' WHEN 3 THEN 'PHONE'
                    WHEN 4 THEN 'NAME' WHEN 5 THEN 'API_KEY' WHEN 6 THEN 'PAN' ELSE 'FACE' END AS type,
               'val' || repeat('x', CAST(l_linenumber % 3 AS INT)) || CAST(l_suppkey % 5 AS STRING)
                     || repeat('y', CAST(l_quantity AS INT) % 3) AS value,
               '#f' || CAST(l_suppkey % 4 AS STRING) AS selector,
               CAST(55 + l_linenumber * 6 AS DOUBLE) / 100 AS confidence,
               CASE l_linestatus WHEN 'O' THEN 'detected' ELSE CASE l_returnflag WHEN 'A' THEN 'redacted'
                    WHEN 'N' THEN 'blocked' ELSE 'ignored' END END AS status,
               CASE l_returnflag WHEN 'A' THEN 'dom' WHEN 'N' THEN 'regex' ELSE 'ocr' END AS method
        FROM {lineitem}""",
    # A log of browser actions.
    "actions": """
        SELECT event_id AS id, ts, user_id,
               CASE event_type WHEN 'view' THEN 'scroll' WHEN 'purchase' THEN 'submit' WHEN 'error' THEN 'exec'
                    WHEN 'signup' THEN 'type' ELSE 'click' END AS action,
               CASE event_id % 9 WHEN 0 THEN '#login-form' WHEN 1 THEN 'a[href="JavaScript:void(0)"]'
                    WHEN 2 THEN '#card-number' WHEN 3 THEN 'button.delete' WHEN 4 THEN 'img[onerror]'
                    WHEN 5 THEN '#search-box' WHEN 6 THEN 'input[name=password]' WHEN 7 THEN NULL ELSE '#next' END AS selector,
               CASE event_id % 4 WHEN 0 THEN 'Submit order' ELSE 'Next page' END AS target,
               CASE WHEN event_type = 'signup' THEN 'typed ' || CAST(event_id AS STRING) END AS text,
               CASE WHEN event_id % 5 = 0 THEN 'v' || CAST(event_id AS STRING) END AS value,
               CASE event_id % 7 WHEN 0 THEN 'LOCAL_EMAIL' WHEN 1 THEN 'LOCAL_PASSWORD' WHEN 2 THEN 'LOCAL_USER_' || CAST(user_id AS STRING) END AS value_ref,
               event_id % 11 = 0 AS requires_confirmation
        FROM {events}""",
    # Values held locally for symbolic references, one per user and a few shared ones.
    "tokens": """
        SELECT 'LOCAL_USER_' || CAST(user_id AS STRING) AS value_ref, 'held-' || CAST(user_id AS STRING) AS held
        FROM {events} GROUP BY user_id
        UNION ALL
        SELECT CASE user_id % 2 WHEN 0 THEN 'LOCAL_EMAIL' ELSE 'LOCAL_PASSWORD' END AS value_ref,
               CASE user_id % 2 WHEN 0 THEN 'mail@example.com' ELSE '' END AS held
        FROM {events} GROUP BY user_id % 2""",
    # Metadata of attached images: message = order.
    "attachments": """
        SELECT l_orderkey AS msg_id,
               'f' || CAST(l_partkey AS STRING) || '-' || CAST(l_linenumber AS STRING) AS file_id,
               'img' || CAST(l_suppkey AS STRING) || '.png' AS name,
               CASE WHEN l_partkey % 29 = 0 THEN 'FAILED' WHEN l_partkey % 31 = 0 THEN 'PROCESSING'
                    WHEN l_partkey % 3 = 0 THEN 'NO_FACES' ELSE 'VERIFIED' END AS status,
               'o' || CAST(l_partkey AS STRING) AS original_hash,
               CASE WHEN l_partkey % 37 = 0 THEN 'o' ELSE 's' END || CAST(l_partkey AS STRING) AS sanitized_hash,
               CASE WHEN l_partkey % 41 = 0 THEN NULL WHEN l_partkey % 43 = 0 THEN 'x' WHEN l_partkey % 37 = 0 THEN 'o' ELSE 's' END
                    || CAST(l_partkey AS STRING) AS upload_hash,
               CASE WHEN l_suppkey % 47 = 0 THEN 'text/plain' ELSE 'image/png' END AS mime,
               CAST(l_quantity AS BIGINT) - 1 AS size,
               l_partkey % 4 AS faces,
               l_partkey % 4 - CASE WHEN l_suppkey % 17 = 0 THEN 1 ELSE 0 END AS bands
        FROM {lineitem}""",
    # Edits of prompts: conversations with a scan number and the state of their attachment.
    "edits": """
        SELECT conv_id, turn, role, turn - turn % 2 AS scan_id,
               CASE WHEN turn % 3 = 0 THEN text || ' mail c' || CAST(conv_id AS STRING) || '@example.com'
                    WHEN turn % 3 = 1 THEN text ELSE text || chr(10) || 'DB_URL=postgres://u:p@h' || CAST(conv_id AS STRING) || '/d' END AS text,
               CASE WHEN conv_id % 6 = 5 THEN 'VERIFIED' WHEN conv_id % 7 = 6 THEN 'FAILED' ELSE 'NONE' END AS attachment_state
        FROM {conversations}""",
    # Drafts in a tab: edits whose scans may finish out of order, with navigations in between.
    "drafts": """
        SELECT conv_id, turn, CASE WHEN turn % 7 = 3 THEN turn - 4 ELSE turn - turn % 2 END AS scan_id,
               CASE WHEN turn % 3 = 0 THEN text || ' mail c' || CAST(conv_id AS STRING) || '@example.com'
                    WHEN turn % 3 = 1 THEN text ELSE text || chr(10) || 'DB_URL=postgres://u:p@h' || CAST(conv_id AS STRING) || '/d' END AS text,
               CASE WHEN conv_id % 6 = 5 THEN 'VERIFIED' WHEN conv_id % 7 = 6 THEN 'FAILED' ELSE 'NONE' END AS attachment_state,
               turn % 6 = 5 AS moved
        FROM {conversations}""",
    # Outgoing payloads: one per order.
    "payloads": f"""
        SELECT o_orderkey AS payload_id,
               CASE o_orderkey % 6 WHEN 0 THEN 'NORMAL' WHEN 1 THEN 'AUTHENTICATION' WHEN 2 THEN ' messaging ' WHEN 3 THEN NULL
                    WHEN 4 THEN 'SOCIAL_MEDIA' ELSE 'AI_ASSISTANT' END AS context,
               'https://shop.example.com/p/' || CAST(o_orderkey AS STRING)
                 || CASE WHEN o_orderkey % 10 = 3 THEN '?mail=u' || CAST(o_orderkey AS STRING) || '@example.com' ELSE '?page=2' END AS url,
               CASE WHEN o_orderkey % 8 < 3 THEN '<div>' || {_NOTE_CASE} || '</div>'
                    WHEN o_orderkey % 8 = 3 THEN '<input name="q" value="plain">' ELSE '<div>[EMAIL] ok</div>' END AS dom,
               CASE WHEN o_orderkey % 9 = 0 THEN 'ocr mail' || CAST(o_orderkey AS STRING) || '@ocr.example.com' ELSE '  ' END AS ocr,
               CASE WHEN o_orderkey % 11 = 0 THEN 'find orders of task' || CAST(o_orderkey AS STRING) || '@example.com'
                    ELSE 'search for shoes' END AS task,
               CASE WHEN o_orderkey % 13 = 0 THEN 'label' || CAST(o_orderkey AS STRING) || '@example.com' ELSE 'Save' END AS label,
               o_orderkey % 15 % 4 AS unredacted
        FROM {{orders}}""",
}

#: Tables whose texts are scanned, which costs far more than moving the orders and documents that they are made of.
_SCANNED = ("notes", "corpus", "payloads")
_TABLES = re.compile(r"\{(\w+)\}")
#: The key by which a statement numbers the rows of its input.
_NUMBERED = re.compile(r"PARTITION BY (l_\w+)")


def derive(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A derived table as a DataFrame; nothing is computed before it is used."""
    sql = SQL[name]
    inputs = {t: table(spark, root, t) for t in set(_TABLES.findall(sql))}
    if name in _SCANNED:
        inputs |= {t: dealt(inputs[t].select("doc_id", "text") if t == "documents" else inputs[t]) for t in inputs}
    if key := _NUMBERED.search(sql):
        # The numbering needs this order of rows over tasks anyway.  Made here, below the key's new name, it serves what
        # groups or joins by that name as well, and the rows move once.
        inputs["lineitem"] = inputs["lineitem"].repartition(key[1])
    out = spark.sql(sql, **inputs)
    return out.withColumn("text", once(out["text"])) if name in ("notes", "corpus") else out


def duck(name: str) -> str:
    """The same table as a parenthesised subquery for DuckDB."""
    return "(" + _TABLES.sub(r"\1", SQL[name]) + ")"
