"""Span detection: text columns to exact, validated matches.

Everything here is row-local: a text is turned into one array of spans by column
expressions and exploded at most once, so detection never shuffles and never leaves
the JVM.  Each detector costs at most one cheap anchor test on a text without
candidates, one pattern pass on a text with candidates, and a second pass (for the
offsets) only on texts that really have matches.  Redaction of prompts alone uses ``prompt_finder``, the same rules on one
text in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions import catalog as C
from hushlake.functions import checks, scanner
from hushlake.functions.text import let, once, positions, trim_spaces

# ``neg_len`` sits behind ``start`` so that the natural order of the struct is the
# leftmost-then-longest order, ``ord`` (catalogue position) breaking the last ties.
SPAN = "struct<start:int,neg_len:int,ord:int,type:string,value:string,confidence:double>"
NO_SPANS = f"cast(array() as array<{SPAN}>)"
PROMPT_ORD = len(C.CATALOG)


def _sql(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


# Tests shared by several detectors; each is evaluated at most once per text.
_SHARED = {
    C.DIGITS: ("__digits", lambda t: t.rlike("[0-9]{4}")),
    C.CAPITALS: ("__capitals", lambda t: t.rlike("[A-Z]{4}")),
    C.LONG_RUN: ("__long_run", lambda t: t.rlike(r"[\w\-]{20}")),
}
_LOWER = ("__lower", lambda t: F.lower(t))


def _anchor(text: Column, anchor: tuple[str, ...]) -> Column | None:
    cond = None
    for a in anchor:
        if a in _SHARED:
            c = F.col(_SHARED[a][0])
        elif a.startswith("lower:"):
            c = F.col(_LOWER[0]).contains(a[6:])
        else:
            c = text.contains(a)
        cond = c if cond is None else cond | c
    return cond


def _span(start: Column, value: Column, ord_: int, type_: str, confidence: float) -> Column:
    return F.struct(
        start.alias("start"), (-F.length(value)).alias("neg_len"), F.lit(ord_).alias("ord"), F.lit(type_).alias("type"),
        value.alias("value"), F.lit(float(confidence)).alias("confidence"),
    )


def _fold(hits: str, gaps: str, whole: str, start: str, value: str, type_: str, confidence: float, ord_: int) -> Column:
    """The gaps between matches and the matches as spans: their lengths add up to the offsets.

    The sum keeps numbers only, as a fold copies what it keeps in every step.
    """
    return F.expr(
        f"get(transform(array(zip_with({gaps}, {hits}, (g, h) -> named_struct('g', g, 'h', h))), f -> zip_with(f,"
        " aggregate(f, named_struct('pos', 0, 'out', cast(array() as array<int>)),"
        f" (a, z) -> named_struct('pos', a.pos + length(z.g) + length(z.{whole}), 'out', concat(a.out, array(a.pos))), a -> a.out),"
        f" (z, p) -> named_struct('start', p + length(z.g) + {start}, 'neg_len', -length({value}), 'ord', {ord_},"
        f" 'type', '{type_}', 'value', {value}, 'confidence', {float(confidence)}D))), 0)"
    )


#: Stands for a match in a text that does not hold this character.
_MARK = "\x01"


def _gaps(text: Column, pattern: str, hits: Column) -> Column:
    """What stands before each match.

    ``split`` compiles its pattern for every row; matches are replaced by a mark, with the pattern compiled once, and the
    text is split at the marks.  A text that holds the mark itself is split by the pattern.
    """
    marked = F.split(F.regexp_replace(text, pattern, _MARK), _MARK, -1)
    return F.slice(F.when(text.contains(_MARK), F.split(text, pattern, -1)).otherwise(marked), F.lit(1), F.size(hits))


def _sql_gaps(text: str, pattern: str, hits: str) -> str:
    marked = f"split(regexp_replace({text}, {pattern}, char(1)), char(1), -1)"
    return f"slice(if(contains({text}, char(1)), split({text}, {pattern}, -1), {marked}), 1, size({hits}))"


def _whole_spans(text: str, hits: str, d: C.Detector, ord_: int) -> Column:
    gaps = _sql_gaps(text, _sql(d.java), hits)
    return _fold(hits, gaps, "h", "0", "z.h", d.type, d.confidence, ord_)


def _grouped_spans(text: str, hits: str, pattern: str, group: int, type_: str, confidence: float, ord_: int) -> Column:
    """Prompt rules: the value is a group of the match, trailing punctuation is not part of it."""
    p = _sql(pattern)
    gaps = _sql_gaps(text, p, hits)
    inner = hits if group == 0 else f"regexp_extract_all({text}, {p}, {group})"
    pairs = f"zip_with({hits}, {inner}, (m, v) -> named_struct('m', m, 'v', v))"
    value = r"regexp_replace(z.h.v, '[.,;:]+\\z', '')"
    quoted = """if(endswith(z.h.m, '"') or endswith(z.h.m, "'"), 1, 0)"""
    start = f"if({value} = '', length(z.h.m), length(z.h.m) - length(z.h.v) - {quoted})"
    return _fold(pairs, gaps, "h.m", start, value, type_, confidence, ord_)


#: The generic key rule: a long token counts if one of these words follows on its line.
KEY_WORDS = "key|token|secret|api|access|auth"
_BREAKS = r"[\n\r\x{2028}\x{2029}]"


def _key_spans(text: Column, d: C.Detector, ord_: int) -> Column:
    """Spans of the generic key rule, in time linear in the text.

    A token has to end before the last keyword of its line.  So each line is cut there, and back to the
    previous boundary where that is inside a word; what is left is searched for long tokens.
    """
    long_token = C.java(r"\b[A-Za-z0-9_\-]{20,}(?:\b|\z)")

    def in_line(line: Column) -> Column:
        before = F.regexp_extract(line, rf"(?is)^(.*)(?:{KEY_WORDS})", 1)  # lines are cut already: a dot is any character
        return F.regexp_replace(before, r"(?<![A-Za-z0-9_])[A-Za-z0-9_]++\z", "")

    def placed(head: Column, base: Column) -> Column:
        hits = F.regexp_extract_all(head, F.lit(long_token), F.lit(0))
        pairs = F.zip_with(_gaps(head, long_token, hits), hits, lambda g, h: F.struct(g.alias("g"), h.alias("h")))

        def place(found: Column) -> Column:
            at = positions(found, lambda z: F.length(z["g"]) + F.length(z["h"]))
            return F.zip_with(found, at, lambda z, p: _span(base + p + F.length(z["g"]), z["h"], ord_, d.type, d.confidence))

        return let(pairs, place)

    def with_keys(line: Column) -> Column:
        return line.rlike(rf"(?i){KEY_WORDS}") & line.rlike(r"[A-Za-z0-9_\-]{20}")

    def by_line(lines: Column) -> Column:
        at = positions(lines, lambda line: F.length(line) + 1)
        kept = F.filter(F.arrays_zip(lines.alias("line"), at.alias("at")), lambda z: with_keys(z["line"]))
        return F.flatten(F.transform(kept, lambda z: placed(in_line(z["line"]), z["at"])))

    return let(F.when(text.rlike(_BREAKS), F.split(text, _BREAKS, -1)).otherwise(F.array(text)), by_line)


def _valid(text: Column, check: str):
    """The check of one detector on a placed span."""

    def keep(s: Column) -> Column:
        v = s["value"]
        if check == "luhn":
            return checks.luhn(v)
        if check == "aadhaar":
            return checks.aadhaar(v)
        if check == "verhoeff":
            return checks.verhoeff(v)
        if check == "phone":
            return checks.phone_length(v)
        tail = text.substr(s["start"] - s["neg_len"] + 1, F.lit(10))
        return ~tail.rlike(C.java(r"^\s*[:=]"))

    return keep


def _not_allowlisted(terms: list[str] | None, exact_terms: bool):
    def keep(s: Column) -> Column:
        if exact_terms:
            return ~F.array_contains(checks.term_list(terms), F.lower(trim_spaces(s["value"])))
        return ~checks.allowlisted(s["value"], terms)

    return keep


def with_spans(
    df: DataFrame,
    text: str = "text",
    out: str = "spans",
    types: Iterable[str] | None = None,
    detectors: tuple[C.Detector, ...] = C.CATALOG,
    allow_terms: list[str] | None = None,
    exact_terms: bool = False,
    prompt_rules: bool = False,
) -> DataFrame:
    """Add an array column with every match, in catalogue order.

    ``types`` prunes detectors when the plan is built, so a switched-off detector costs
    nothing.  ``prompt_rules`` adds the rules that only apply to prompts (password
    phrases, strong tokens, assigned and bearer keys, key blocks, database addresses).
    """
    wanted = None if types is None else set(types)
    chosen = [(i, d) for i, d in enumerate(detectors) if wanted is None or d.type in wanted]
    rules = [
        (k, r) for k, r in enumerate(_prompt_rules()) if prompt_rules and (wanted is None or r.type in wanted)
    ]
    t = F.col(text)
    anchors = [a for _, d in chosen for a in d.anchor] + [a for _, r in rules for a in r.anchor]
    shared = [test(t).alias(name) for key, (name, test) in _SHARED.items() if key in anchors]
    if any(a.startswith("lower:") for a in anchors):
        shared.append(_LOWER[1](t).alias(_LOWER[0]))
    work = df.select("*", *shared)
    name = f"`{text}`"

    hit_cols, span_cols, prompt_cols = [], [], []
    for i, d in chosen:
        generic = d.check == "not_a_name"
        hits = _key_spans(t, d, i) if generic else F.regexp_extract_all(t, F.lit(d.java), F.lit(0))
        guard = _anchor(t, d.anchor)
        guard = guard & t.rlike(rf"(?i){KEY_WORDS}") if generic else guard
        hit_cols.append((hits if guard is None else F.when(guard, hits)).alias(f"__h{i}"))
        placed = F.col(f"__h{i}") if generic else _whole_spans(name, f"__h{i}", d, i)
        if d.check:
            placed = F.filter(placed, _valid(t, d.check))
        span_cols.append(F.when(F.size(f"__h{i}") > 0, placed))
    for k, r in rules:
        hits = F.regexp_extract_all(t, F.lit(r.pattern), F.lit(0))
        hit_cols.append(F.when(_anchor(t, r.anchor), hits).alias(f"__p{k}"))
        placed = _grouped_spans(name, f"__p{k}", r.pattern, r.group, r.type, r.confidence, PROMPT_ORD + k)
        prompt_cols.append(F.when(F.size(f"__p{k}") > 0, F.filter(placed, _prompt_keep(r.strong))))

    empty = F.expr(NO_SPANS)
    if not span_cols + prompt_cols:
        return df.withColumn(out, empty)
    staged = work.select(*df.columns, *hit_cols)
    keep = [c for c in df.columns if c != out]
    parts = []
    if span_cols:
        found = F.concat(*[F.coalesce(c, empty) for c in span_cols])
        parts.append(F.filter(found, _not_allowlisted(allow_terms, exact_terms)))
    parts += [F.coalesce(c, empty) for c in prompt_cols]
    return staged.select(*keep, once(F.concat(*parts)).alias(out))


def prompt_finder(types: Iterable[str] | None = None):
    """What ``with_spans`` does with the prompt rules, as a Python function of one text."""
    wanted = None if types is None else set(types)
    chosen = [(i, d) for i, d in enumerate(C.CATALOG) if wanted is None or d.type in wanted]
    rules = [(PROMPT_ORD + k, tuple(r)) for k, r in enumerate(_prompt_rules()) if wanted is None or r.type in wanted]
    return scanner.scan(chosen, rules, KEY_WORDS)


def prompt_span_count(text: str) -> Column:
    """Number of spans that ``with_spans`` finds with the prompt rules, counted by plain Python in the workers.  To be used as a whole column."""
    return once(F.arrow_udf(scanner.on_texts(prompt_finder(), scanner.counts), "bigint")(F.make_valid_utf8(text)))


def _valid_value(text: Column, check: str):
    keep = _valid(text, check)
    return lambda v: keep({"value": v})


def _item(type_: str):
    return lambda v: F.struct((-F.length(v)).alias("neg_len"), F.lit(type_).alias("type"), v.alias("value"))


def value_items(x: Column, detectors: tuple[C.Detector, ...] = C.CATALOG) -> Column:
    """Matches of one string as (neg_len, type, value), in catalogue order, without offsets.

    An expression of the string alone, so it can be used inside ``transform`` on the strings of a
    nested value: no string is ever scanned together with its neighbours.
    """
    shared = {C.DIGITS: "[0-9]{4}", C.CAPITALS: "[A-Z]{4}", C.LONG_RUN: r"[\w\-]{20}"}

    def sought(a: str) -> str:
        return shared[a] if a in shared else f"(?i:{re.escape(a[6:])})" if a.startswith("lower:") else re.escape(a)

    none = F.expr("cast(array() as array<struct<neg_len:int,type:string,value:string>>)")
    parts = []
    for i, d in enumerate(detectors):
        if d.check == "not_a_name":
            spans = F.filter(_key_spans(x, d, i), _valid(x, d.check))
            values = F.transform(spans, lambda s: s["value"])
        else:
            values = F.regexp_extract_all(x, F.lit(d.java), F.lit(0))
            if d.check:
                values = F.filter(values, _valid_value(x, d.check))
        values = F.filter(values, lambda v: ~checks.allowlisted(v, None))
        items = F.transform(values, _item(d.type))
        guard = None
        for a in d.anchor:
            c = x.rlike(shared[a]) if a in shared else F.lower(x).contains(a[6:]) if a.startswith("lower:") else x.contains(a)
            guard = c if guard is None else guard | c
        parts.append(items if guard is None else F.when(guard, items).otherwise(none))
    if not parts or not all(d.anchor for d in detectors):
        return F.concat(*parts)
    # Most strings of a body hold no anchor at all: one test instead of one for each detector.
    anchors = sorted({sought(a) for d in detectors for a in d.anchor})
    return F.when(x.rlike("|".join(anchors)), F.concat(*parts)).otherwise(none)


def _prompt_keep(strong: bool):
    def keep(s: Column) -> Column:
        v = s["value"]
        ok = ~checks.already_placeholder(v)
        if strong:
            ok = (
                ok
                & ~F.lower(v).isin("password", "passwd", "secret", "token", "apikey", "bearer")
                & v.rlike("[a-z]")
                & v.rlike("[A-Z]")
                & v.rlike("[0-9]")
                & v.rlike("[!@#$%^&*?]")
            )
        return ok

    return keep


class _Rule(NamedTuple):
    type: str
    confidence: float
    pattern: str
    group: int
    anchor: tuple[str, ...]
    strong: bool = False


def _prompt_rules() -> list[_Rule]:
    symbols = tuple("!@#$%^&*?")
    return [
        _Rule("PASSWORD", 0.95, C.java(C.PASSWORD_PHRASE, True), 1, ("lower:pass", "lower:pwd")),
        _Rule("PASSWORD", 0.90, C.java(C.STRONG_TOKEN), 1, symbols, True),
        _Rule("API_KEY", 0.95, C.java(C.ASSIGNED_KEY, True), 1, ("lower:key", "lower:token", "lower:bearer")),
        _Rule("API_KEY", 0.95, C.java(C.BEARER_TOKEN, True), 1, ("lower:bearer",)),
        _Rule("PRIVATE_KEY", 1.0, C.java(C.PEM_BLOCK), 0, ("PRIVATE KEY-----",)),
        _Rule("DATABASE_URL", 0.98, C.java(C.DATABASE_URL, True), 0, ("://",)),
    ]


def explode_spans(df: DataFrame, keys: list[str], spans: str = "spans") -> DataFrame:
    """One row per span: keys, type, value, start, end, confidence, ord.  The text is dropped here."""
    s = F.col("s")
    # An inner explode makes the optimizer add a ``size(spans) > 0`` filter and push it below
    # the projection, which would run every pattern twice; the outer form keeps one pass.
    rows = df.select(*keys, F.explode_outer(spans).alias("s")).filter(s.isNotNull())
    return rows.select(
        *keys,
        s["type"].alias("type"),
        s["value"].alias("value"),
        s["start"].cast("long").alias("start"),
        (s["start"] - s["neg_len"]).cast("long").alias("end"),
        s["confidence"].alias("confidence"),
        s["ord"].alias("ord"),
    )


def detect(df: DataFrame, keys: list[str], text: str = "text", **options) -> DataFrame:
    """Detected spans of a text column as rows."""
    pruned = df.select(*keys, text)
    return explode_spans(with_spans(pruned, text, **options), keys)


def _address(confidence: float):
    return lambda v: F.struct(trim_spaces(v).alias("value"), F.lit(confidence).alias("confidence"))


def with_address_spans(df: DataFrame, text: str = "text", out: str = "addresses") -> DataFrame:
    """Street and city-state-zip matches; per text the first of equal values (case ignored) is kept."""
    t = F.col(text)
    parts = []
    for pattern, confidence in C.ADDRESS_RULES:
        hits = F.regexp_extract_all(t, F.lit(C.java(pattern, True)), F.lit(0))
        parts.append(F.transform(hits, _address(confidence)))
    found = F.filter(
        F.concat(*parts), lambda a: (F.length(a["value"]) >= 3) & ~checks.allowlisted(a["value"])
    )
    staged = df.withColumn("__found", F.when(t.rlike("[0-9]"), found))
    lowered = F.transform("__found", lambda a: F.lower(a["value"]))
    first = F.filter(
        F.col("__found"), lambda a, i: F.array_position(lowered, F.lower(a["value"])) == (i + 1)
    )
    return staged.withColumn(out, once(first)).drop("__found")


def detect_addresses(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    a = F.col("a")
    return (
        with_address_spans(df.select(*keys, text), text)
        .select(*keys, F.explode_outer("addresses").alias("a"))
        .filter(a.isNotNull())
        .select(*keys, F.lit("ADDRESS").alias("type"), a["value"].alias("value"), a["confidence"].alias("confidence"))
    )
