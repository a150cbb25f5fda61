"""Placeholders: what a secret is replaced with, and the names they are derived from."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushlake.functions.catalog import java
from hushlake.functions.dims import (
    BRACKET,
    DEFAULT_PLACEHOLDER,
    FALLBACK_PLACEHOLDER,
    NAME_CONTAINS,
    NAME_EQUALS,
    NAMED_EXEMPT,
    NAMED_MARKS,
    PAYLOAD_KEY,
    PROMPT_PLACEHOLDER,
)
from hushlake.functions.text import let, trim_spaces

# Fixed value: what may stand in front of a value that is assigned to a name.
NAME_BEFORE_VALUE = (
    r"(?:export\s+)?(?:const|let|var|env)?\s*(?:process\.env\.|window\.env\.)?"
    r"""["']?([A-Za-z0-9_\-\.]+)["']?\s*[:=]\s*["']?\s*"""
)
# Fixed value: a name assigned right in front of the end of a line prefix.
ASSIGNED_NAME = r"""([A-Za-z0-9_]{3,})\s*=\s*["']?\z"""


def _lookup(key: Column, table: dict[str, str], default: str) -> Column:
    groups: dict[str, list[str]] = {}
    for k, v in table.items():
        groups.setdefault(v, []).append(k)
    expr = None
    for value, keys in groups.items():
        cond = key.isin(keys)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr.otherwise(F.lit(default))


def type_placeholder(type_: Column) -> Column:
    return _lookup(type_, DEFAULT_PLACEHOLDER, FALLBACK_PLACEHOLDER)


def bracket_placeholder(type_: Column) -> Column:
    return _lookup(type_, BRACKET, "[REDACTED]")


def _all_in(name: Column, parts: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [name.contains(p) for p in parts])


def name_placeholder(name: Column) -> Column:
    """Ordered rules on a normalised variable name; ``YOUR_<NAME>`` when none applies."""
    bare = F.regexp_replace(trim_spaces(name), r"(?i)^(process\.env\.|window\.env\.|env\.)", "")
    bare = F.regexp_replace(bare, r"(?i)^(NEXT_PUBLIC_|VITE_|REACT_APP_|PUBLIC_)", "")
    return let(F.translate(F.upper(bare), "-.", "__"), _name_rules)


def _name_rules(upper: Column) -> Column:
    expr = None
    for alternatives, value in NAME_CONTAINS:
        cond = reduce(lambda a, b: a | b, [_all_in(upper, parts) for parts in alternatives])
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    for names, value in NAME_EQUALS:
        expr = expr.when(upper.isin(names), F.lit(value))
    return expr.otherwise(F.concat(F.lit("YOUR_"), upper))


def quote_regex(value: Column) -> Column:
    """A value as a literal inside a Java pattern."""
    return F.concat(F.lit("\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def variable_name(context: Column, value: Column) -> Column:
    """Name the value is assigned to in its line (last dotted part); NULL when there is none."""
    pattern = F.concat(F.lit(java(NAME_BEFORE_VALUE, True)), quote_regex(value))
    name = F.call_function("regexp_extract", context, pattern, F.lit(1))
    last = let(name, lambda n: F.when(n != "", F.element_at(F.split(n, r"\."), -1)))  # the pattern is compiled for each value
    return F.when(context.contains("=") | context.contains(":"), last)


def choose_placeholder(type_: Column, variable: Column | None = None, attribute: Column | None = None) -> Column:
    """Variable name, else attribute name, else the default of the type."""
    expr = None
    if variable is not None:
        return let(
            variable,
            lambda v: F.when(F.length(trim_spaces(v)) > 1, name_placeholder(v)).otherwise(
                choose_placeholder(type_, None, attribute)
            ),
        )
    if attribute is not None:
        clean = F.translate(F.regexp_replace(attribute, r"(?i)-(input|textarea|field|box)\z", ""), "-", "_")
        usable = (F.length(trim_spaces(attribute)) > 1) & ~F.lower(clean).isin(
            "text", "input", "password", "string", "value"
        )
        expr = F.when(usable, name_placeholder(clean)) if expr is None else expr.when(usable, name_placeholder(clean))
    return type_placeholder(type_) if expr is None else expr.otherwise(type_placeholder(type_))


def full_placeholder(type_: Column, variable: Column) -> Column:
    """``NAME=YOUR_NAME`` for an assigned value, otherwise the bare placeholder."""
    chosen = choose_placeholder(type_, variable)
    return F.when(F.coalesce(variable, F.lit("")) != "", F.concat(variable, F.lit("="), chosen)).otherwise(chosen)


def prompt_placeholder(type_: Column, line_prefix: Column) -> Column:
    """Bracket form; a configuration value keeps the meaning of the name it is assigned to."""
    plain = F.coalesce(_lookup_or_null(type_, PROMPT_PLACEHOLDER), type_placeholder(type_))

    def pick(name: Column) -> Column:
        marked = reduce(lambda a, b: a | b, [name.contains(m) for m in NAMED_MARKS])
        named = (name != "") & (name.contains("_") | (name == F.upper(name))) & marked & ~type_.isin(NAMED_EXEMPT)
        return F.when(named, name_placeholder(name)).otherwise(plain)

    return let(F.regexp_extract(line_prefix, java(ASSIGNED_NAME), 1), pick)


def _lookup_or_null(key: Column, table: dict[str, str]) -> Column:
    groups: dict[str, list[str]] = {}
    for k, v in table.items():
        groups.setdefault(v, []).append(k)
    expr = None
    for value, keys in groups.items():
        cond = key.isin(keys)
        expr = F.when(cond, F.lit(value)) if expr is None else expr.when(cond, F.lit(value))
    return expr


def field_placeholder(type_: Column, field: Column) -> Column:
    """Placeholder of a form field, by its name first and the detected type second."""
    clean = F.regexp_replace(F.coalesce(field, F.lit("")), r"(?i)[-_]?(input|textarea|field|box)\z", "")
    upper = F.translate(F.upper(clean), "-.", "__")
    kind = F.when(type_ == "", F.lit(None)).otherwise(type_)
    default = F.concat(F.coalesce(kind, F.lit("FIELD")), F.lit("=YOUR_"), F.coalesce(kind, F.lit("VALUE")))
    return (
        F.when(upper.contains("PASS"), F.lit("PASSWORD=YOUR_PASSWORD"))
        .when(upper.contains("EMAIL"), F.lit("EMAIL=YOUR_EMAIL"))
        .when(upper.contains("KEY") | upper.contains("API"), F.concat(upper, F.lit("=YOUR_"), upper))
        .when(type_ == "EMAIL", F.lit("EMAIL=YOUR_EMAIL"))
        .when(type_ == "PASSWORD", F.lit("PASSWORD=YOUR_PASSWORD"))
        .when(type_ == "PHONE", F.lit("PHONE=YOUR_PHONE"))
        .when(type_ == "CARD", F.lit("CARD=YOUR_CARD_NUMBER"))
        .otherwise(default)
    )


def payload_key(type_: Column, selector: Column | None = None) -> Column:
    """Key of a detection in the sanitized payload: by type, else by the element's id, else the type's name."""
    expr = None
    for t, key in PAYLOAD_KEY.items():
        expr = F.when(type_ == t, F.lit(key)) if expr is None else expr.when(type_ == t, F.lit(key))
    if selector is not None:
        ident = F.regexp_extract(selector, r"#([a-zA-Z0-9_\-]+)", 1)
        ident = F.lower(F.translate(F.regexp_replace(ident, r"(?i)-(input|textarea|field|box)\z", ""), "-", "_"))
        ident = F.when(ident == "pw", "password").when(ident == "apikey", "api_key").otherwise(ident)
        expr = expr.when(F.length(ident) > 1, ident)
    return expr.otherwise(F.lower(type_))
