"""SQL fragments for the DuckDB side of a query.

The checks are written against the same definitions but on another engine with other
primitives: RE2 instead of java.util.regex, joins and recursion instead of array folds.
"""

from __future__ import annotations

from hushlake.functions import catalog as C
from hushlake.functions import dims
from hushlake.functions import placeholders as P
from hushlake.functions.checks import verhoeff_tables
from hushlake.functions.text import _URL


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strlist(values: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def re2(pattern: str, ignore_case: bool = False) -> str:
    return q(C.re2(pattern, ignore_case))


TRIM = re2(r"^\s+|\s+\z")
SPACES = re2(r"\s+")


def trim(e: str) -> str:
    return f"regexp_replace({e}, {TRIM}, '', 'g')"


def allowlisted(v: str, terms: list[str] | None = None) -> str:
    known = strlist(dims.ALLOWED_TERMS if terms is None else terms)
    c = f"lower(regexp_replace({trim(v)}, {SPACES}, ' ', 'g'))"
    return (
        f"({v} IS NULL OR {c} = '' OR starts_with({c}, 'your_') OR starts_with({c}, '[') OR ends_with({c}, ']')"
        f" OR regexp_matches({c}, '^[a-z0-9_]+=your_[a-z0-9_]+\\z') OR list_contains({known}, {c})"
        f" OR len(list_filter(string_split({c}, ' '), lambda w: NOT list_contains({known}, w))) = 0)"
    )


def digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def stripped(v: str) -> str:
    return f"regexp_replace({v}, {re2('[' + chr(92) + 's-]')}, '', 'g')"


def luhn(v: str) -> str:
    d = stripped(v)
    digit = f"CAST(substr({d}, CAST(length({d}) - i AS BIGINT), 1) AS INT)"
    return (
        f"CASE WHEN regexp_matches({d}, '^[0-9]{{13,19}}\\z') THEN"
        f" list_sum(list_transform(range(length({d})), lambda i: CASE WHEN i % 2 = 1 THEN"
        f" (CASE WHEN {digit} * 2 > 9 THEN {digit} * 2 - 9 ELSE {digit} * 2 END) ELSE {digit} END)) % 10 = 0"
        " ELSE false END"
    )


def verhoeff(v: str) -> str:
    product, permutation = verhoeff_tables()
    d = stripped(v)
    codes = (
        f"list_transform(range(12), lambda i: {permutation}[(i % 8) * 10 + CAST(substr({d}, CAST(12 - i AS BIGINT), 1) AS INT) + 1])"
    )
    return (
        f"CASE WHEN regexp_matches({d}, '^[2-9][0-9]{{11}}\\z') AND replace({d}, substr({d}, 1, 1), '') <> '' THEN"
        f" list_reduce(list_prepend(0, {codes}), lambda c, p: {product}[c * 10 + p + 1]) = 0 ELSE false END"
    )


def aadhaar(v: str) -> str:
    grouped = re2(r"^[1-9]\d{3}[\s-](\d{4})[\s-](\d{4})\z")
    return f"(regexp_matches({v}, {grouped}) OR {stripped(v)} = '123456789012' OR {verhoeff(v)})"


def _placed(src: str, key: str, pattern: str, text: str, group: int = 0) -> str:
    """Matches of one pattern with their start offset: key, text, k, m, g, start of the match."""
    inner = f"ms AS gs" if group == 0 else f"regexp_extract_all({text}, {pattern}, {group}) AS gs"
    return (
        f"SELECT {key}, {text} AS text, k, ms[k] AS m, gs[k] AS g,"
        " CAST(coalesce(list_sum(list_transform(gaps[1:k], lambda z: length(z))), 0)"
        " + coalesce(list_sum(list_transform(ms[1:k - 1], lambda z: length(z))), 0) AS BIGINT) AS mpos FROM ("
        f"SELECT *, unnest(range(1, len(ms) + 1)) AS k FROM (SELECT {key}, {text}, ms, {inner},"
        f" regexp_split_to_array({text}, {pattern}) AS gaps FROM ("
        f"SELECT {key}, {text}, regexp_extract_all({text}, {pattern}) AS ms FROM {src} s0) WHERE len(ms) > 0))"
    )


def _generic_keys(src: str, key: str, text: str, ord_: int, confidence: float) -> str:
    """Long tokens before a keyword of the line, without a lookahead.

    A token must end at or before the last keyword of its line.  So each line is cut there
    (and back to the previous boundary when the cut is inside a word), and an ordinary
    pattern runs on what is left; its end may stand for a boundary.
    """
    word = r"\b(?:[A-Za-z0-9_\-]{20,})(?:\b|\z)"
    breaks = q(r"[\n\r\x{2028}\x{2029}]")
    lines = (
        f"SELECT {key}, {text} AS text, lines[n] AS line, CAST(coalesce(list_sum(list_transform(lines[1:n - 1],"
        " lambda z: length(z) + 1)), 0) AS BIGINT) AS base FROM ("
        f"SELECT {key}, {text}, lines, unnest(range(1, len(lines) + 1)) AS n FROM (SELECT {key}, {text},"
        f" regexp_split_to_array({text}, {breaks}) AS lines FROM {src} s0"
        f" WHERE regexp_matches({text}, '[A-Za-z0-9_\\-]{{20}}')))"
    )
    cut = (
        f"SELECT *, regexp_replace(regexp_extract(line, '(?i)^(.*)(?:key|token|secret|api|access|auth)', 1),"
        " '[A-Za-z0-9_]+\\z', '') AS head FROM (" + lines + ") WHERE regexp_matches(line, '(?i)key|token|secret|api|access|auth')"
    )
    pattern = q(word)
    return (
        f"SELECT {key}, {ord_} AS ord, 'API_KEY' AS type, {confidence} AS confidence, m AS value, base + mpos AS start, whole AS text"
        f" FROM (SELECT {key}, base, whole, ms[k] AS m, CAST(coalesce(list_sum(list_transform(gaps[1:k], lambda z: length(z))), 0)"
        " + coalesce(list_sum(list_transform(ms[1:k - 1], lambda z: length(z))), 0) AS BIGINT) AS mpos FROM ("
        f"SELECT {key}, base, whole, ms, gaps, unnest(range(1, len(ms) + 1)) AS k FROM (SELECT {key}, base, text AS whole,"
        f" regexp_extract_all(head, {pattern}) AS ms, regexp_split_to_array(head, {pattern}) AS gaps FROM ({cut})) WHERE len(ms) > 0))"
        f" WHERE NOT regexp_matches(substr(whole, CAST(base + mpos + length(m) + 1 AS BIGINT), 10), {re2('^' + chr(92) + 's*[:=]')})"
    )


def _check(d: C.Detector) -> str:
    return {
        "luhn": luhn("m"), "aadhaar": aadhaar("m"), "verhoeff": verhoeff("m"),
        "phone": f"length({digits('m')}) BETWEEN 7 AND 15",
    }.get(d.check or "", "true")


def spans(
    src: str, key: str = "doc_id", text: str = "text", types: list[str] | None = None, prompt: bool = False,
    detectors: tuple[C.Detector, ...] = C.CATALOG, exact_terms: list[str] | None = None,
) -> str:
    """All validated spans: key, ord, type, confidence, value, start, end."""
    parts = []
    for i, d in enumerate(detectors):
        if types is not None and d.type not in types:
            continue
        if d.type == "API_KEY":
            parts.append(_generic_keys(src, key, text, i, d.confidence))
            continue
        parts.append(
            f"SELECT {key}, {i} AS ord, {q(d.type)} AS type, {d.confidence} AS confidence, m AS value, mpos AS start, text"
            f" FROM ({_placed(src, key, q(d.re2), text)}) WHERE {_check(d)}"
        )
    bad = (
        f"list_contains({strlist(exact_terms)}, lower({trim('value')}))" if exact_terms is not None else allowlisted("value")
    )
    rows = []
    if parts:
        rows.append("SELECT * FROM (" + " UNION ALL ".join(parts) + f") WHERE NOT {bad}")
    if prompt:
        rows += _prompt_parts(src, key, text, types)
    return (
        f'SELECT {key}, CAST(ord AS BIGINT) AS ord, type, CAST(confidence AS DOUBLE) AS confidence, value, start,'
        f' start + length(value) AS "end" FROM (' + " UNION ALL ".join(rows) + ")"
    )


def _prompt_parts(src: str, key: str, text: str, types: list[str] | None) -> list[str]:
    base = len(C.CATALOG)
    placeholder = (
        "((starts_with(value, '[') AND ends_with(value, ']')) OR starts_with(value, 'YOUR_')"
        " OR contains(value, 'YOUR_PASSWORD') OR contains(value, 'YOUR_API_KEY'))"
    )
    out = []
    rules = [
        ("PASSWORD", 0.95, C.PASSWORD_PHRASE, True, 1, 0),
        ("API_KEY", 0.95, C.ASSIGNED_KEY, True, 1, 2),
        ("API_KEY", 0.95, C.BEARER_TOKEN, True, 1, 3),
        ("PRIVATE_KEY", 1.0, C.PEM_BLOCK, False, 0, 4),
        ("DATABASE_URL", 0.98, C.DATABASE_URL, True, 0, 5),
    ]
    for type_, conf, pattern, ic, group, k in rules:
        if types is not None and type_ not in types:
            continue
        value = "regexp_replace(g, '[.,;:]+\\z', '')"
        quote = "CASE WHEN right(m, 1) IN ('\"', '''') THEN 1 ELSE 0 END"
        out.append(
            f"SELECT * FROM (SELECT {key}, {base + k} AS ord, {q(type_)} AS type, {conf} AS confidence, {value} AS value,"
            f" mpos + CASE WHEN {value} = '' THEN length(m) ELSE length(m) - length(g) - {quote} END AS start, text"
            f" FROM ({_placed(src, key, re2(pattern, ic), text, group)})) WHERE NOT {placeholder}"
        )
    if types is None or "PASSWORD" in types:
        # Strong tokens: blank-separated words are cut out first, so no lookahead is needed.
        token = re2(r"(?:^|\s)[A-Za-z\d]*[!@#$%^&*?][^\s]*")
        lead = re2(r"^\s")
        body = re2(rf"^({C.STRONG_TOKEN_CLASS}{{8,64}})(?:\z|[.,;:!?])")
        word = f"regexp_replace(m, {lead}, '')"
        out.append(
            f"SELECT * FROM (SELECT {key}, {base + 1} AS ord, 'PASSWORD' AS type, 0.9 AS confidence,"
            f" regexp_extract({word}, {body}, 1) AS value, mpos + length(m) - length({word}) AS start, text"
            f" FROM ({_placed(src, key, token, text)}))"
            " WHERE value <> '' AND regexp_matches(value, '[a-z]') AND regexp_matches(value, '[A-Z]')"
            f" AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[!@#$%^&*?]') AND NOT {placeholder}"
        )
    return out


def resolved(spans_sql: str, key: str = "doc_id") -> str:
    """Spans that survive leftmost-longest resolution."""
    return f"""(WITH RECURSIVE o AS (
        SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY start, -length(value), ord) AS rn FROM ({spans_sql})),
      r AS (SELECT {key}, rn, "end" AS reach, true AS kept FROM o WHERE rn = 1
        UNION ALL
        SELECT o.{key}, o.rn, CASE WHEN o.start >= r.reach THEN o."end" ELSE r.reach END, o.start >= r.reach
        FROM r JOIN o ON o.{key} = r.{key} AND o.rn = r.rn + 1)
      SELECT o.* FROM o JOIN r USING ({key}, rn) WHERE r.kept)"""


def name_placeholder(name: str) -> str:
    bare = f"regexp_replace({trim(name)}, '(?i)^(process\\.env\\.|window\\.env\\.|env\\.)', '')"
    bare = f"regexp_replace({bare}, '(?i)^(NEXT_PUBLIC_|VITE_|REACT_APP_|PUBLIC_)', '')"
    upper = f"translate(upper({bare}), '-.', '__')"
    whens = []
    for alternatives, value in dims.NAME_CONTAINS:
        cond = " OR ".join("(" + " AND ".join(f"contains(u, {q(p)})" for p in parts) + ")" for parts in alternatives)
        whens.append(f"WHEN {cond} THEN {q(value)}")
    for names, value in dims.NAME_EQUALS:
        whens.append(f"WHEN list_contains({strlist(names)}, u) THEN {q(value)}")
    case = "CASE " + " ".join(whens) + " ELSE 'YOUR_' || u END"
    return f"list_transform([{upper}], lambda u: {case})[1]"


def _case(key: str, table: dict[str, str], default: str) -> str:
    return f"CASE {key} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {default} END"


def type_placeholder(t: str) -> str:
    return _case(t, dims.DEFAULT_PLACEHOLDER, q(dims.FALLBACK_PLACEHOLDER))


def prompt_placeholder(t: str, prefix: str) -> str:
    plain = _case(t, dims.PROMPT_PLACEHOLDER, type_placeholder(t))
    marked = " OR ".join(f"contains(nm, {q(m)})" for m in dims.NAMED_MARKS)
    cond = (
        f"nm <> '' AND (contains(nm, '_') OR nm = upper(nm)) AND ({marked})"
        f" AND NOT list_contains({strlist(dims.NAMED_EXEMPT)}, {t})"
    )
    name = f"regexp_extract({prefix}, {re2(P.ASSIGNED_NAME)}, 1)"
    return f"list_transform([{name}], lambda nm: CASE WHEN {cond} THEN {name_placeholder('nm')} ELSE {plain} END)[1]"


def variable(context: str, value: str) -> str:
    found = f"regexp_extract({context}, {re2(P.NAME_BEFORE_VALUE, True)} || regexp_escape({value}), 1)"
    return f"nullif(string_split({found}, '.')[-1], '')"


def choose(t: str, var: str) -> str:
    return (
        f"list_transform([{var}], lambda vn: CASE WHEN length({trim('vn')}) > 1 THEN {name_placeholder('vn')}"
        f" ELSE {type_placeholder(t)} END)[1]"
    )


def line_prefix(text: str, start: str) -> str:
    return f"string_split(substr({text}, 1, {start}), chr(10))[-1]"


def redacted(src: str, kept_sql: str, key: str = "doc_id", text: str = "text") -> str:
    """Texts with their resolved spans replaced (prompt placeholders): key, redacted, n."""
    ph = prompt_placeholder("p.type", line_prefix(f"t.{text}", "p.start"))
    return f"""(SELECT {key}, any_value(n) AS n,
        CASE WHEN any_value(n) = 0 THEN any_value(text) ELSE
          string_agg(substr(text, prev + 1, start - prev) || ph, '' ORDER BY start, fin)
          || substr(any_value(text), max(fin) + 1) END AS redacted
      FROM (SELECT t.{key}, t.{text} AS text, p.start, p."end" AS fin, {ph} AS ph,
          count(p.start) OVER (PARTITION BY t.{key}) AS n,
          coalesce(lag(p."end") OVER (PARTITION BY t.{key} ORDER BY p.start, p."end"), 0) AS prev
        FROM {src} t LEFT JOIN {kept_sql} p ON p.{key} = t.{key}) GROUP BY {key})"""


def replaced(src: str, items_sql: str, key: str = "doc_id", text: str = "text", by_line: bool = True) -> str:
    """Texts with every occurrence of the items' values replaced, longest first: key, sanitized."""
    # ``by_line`` False is the directional form: one placeholder per value, from its first line.
    line_ph = choose("ty", variable("line", "val"))
    per_line = (
        f"array_to_string(list_transform(string_split(cur, chr(10)), lambda line: CASE WHEN contains(line, val)"
        f" THEN replace(line, val, {line_ph}) ELSE line END), chr(10))"
    )
    first = "coalesce(list_filter(string_split(cur, chr(10)), lambda line: contains(line, val))[1], cur)"
    once = f"replace(cur, val, {choose('ty', variable(first, 'val'))})"
    step = f"replace({per_line}, val, {type_placeholder('ty')})" if by_line else once
    return f"""(WITH RECURSIVE it AS (
        SELECT {key}, type AS ty, value AS val,
          row_number() OVER (PARTITION BY {key} ORDER BY -length(value), ord, start) AS rn FROM ({items_sql})),
      lim AS (SELECT {key}, max(rn) AS n FROM it GROUP BY {key}),
      w AS (SELECT {key}, 0 AS rn, {text} AS cur FROM {src} s1
        UNION ALL
        SELECT w.{key}, it.rn, CASE WHEN contains(cur, val) THEN {step} ELSE cur END
        FROM w JOIN it ON it.{key} = w.{key} AND it.rn = w.rn + 1)
      SELECT w.{key}, w.cur AS sanitized, coalesce(lim.n, 0) AS n
      FROM w LEFT JOIN lim ON lim.{key} = w.{key} WHERE w.rn = coalesce(lim.n, 0))"""


URL = q(_URL)


def url_ok(u: str) -> str:
    return f"coalesce(regexp_matches({u}, {URL}), false)"


def url_host(u: str) -> str:
    return f"lower(regexp_extract({u}, {URL}, 2))"


def url_path(u: str) -> str:
    rest = f"regexp_extract({u}, {q(_URL + '([^?#]*)')}, 4)"
    return f"CASE WHEN {rest} = '' THEN '/' ELSE {rest} END"


def url_query(u: str) -> str:
    qs = f"regexp_extract({u}, '^[^?#]*(\\?[^#]*)', 1)"
    return f"CASE WHEN {qs} = '?' THEN '' ELSE {qs} END"


def url_parts(src: str) -> str:
    """src plus ok, host, path (lower case) and query."""
    return (
        f"(SELECT *, {url_ok('url')} AS ok, CASE WHEN {url_ok('url')} THEN {url_host('url')} ELSE '' END AS host,"
        f" lower(CASE WHEN {url_ok('url')} THEN {url_path('url')} ELSE url END) AS path,"
        f" CASE WHEN {url_ok('url')} THEN {url_query('url')} ELSE '' END AS query FROM {src} u0)"
    )


def signatures() -> str:
    rows, n = [], 0
    for context, app, domains, rule in dims.SIGNATURES:
        for d in domains:
            rows.append(f"({q(context)}, {q(app)}, {q(d)}, {'NULL' if rule is None else q(rule)}, {n})")
            n += 1
    return "(SELECT * FROM (VALUES " + ", ".join(rows) + ") v(context, app, domain, path_rule, ord))"


def types() -> str:
    rows = [
        f"({q(t)}, {w}, {p}, {q(label)}, {q(cat)}, {q(b)}, {q(dims.DEFAULT_PLACEHOLDER.get(t, dims.FALLBACK_PLACEHOLDER))})"
        for t, w, p, label, cat, b, _ in dims.TYPES
    ]
    return "(SELECT * FROM (VALUES " + ", ".join(rows) + ") v(type, weight, priority, label, category, bracket, placeholder))"


def area(a: str, b: str) -> str:
    return (
        f"greatest(0, least({a}.x + {a}.width, {b}.x + {b}.width) - greatest({a}.x, {b}.x))"
        f" * greatest(0, least({a}.y + {a}.height, {b}.y + {b}.height) - greatest({a}.y, {b}.y))"
    )


def overlap(a: str, b: str) -> str:
    return (
        f"{a}.x < {b}.x + {b}.width AND {a}.x + {a}.width > {b}.x"
        f" AND {a}.y < {b}.y + {b}.height AND {a}.y + {a}.height > {b}.y"
    )


def fnv1a(e: str) -> str:
    """FNV-1a of a text inside the basic plane."""
    codes = f"list_transform(range(1, length({e}) + 1), lambda i: CAST(unicode({e}[i]) AS BIGINT))"
    return (
        f"CASE WHEN {e} = '' THEN '811c9dc5' ELSE ltrim(lower(hex(list_reduce(list_prepend(CAST(2166136261 AS BIGINT), {codes}),"
        " lambda h, c: (xor(h, c) * 16777619) & 4294967295))), '0') END"
    )
