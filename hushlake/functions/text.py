"""Small text, number and address helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushlake.functions.catalog import java

ELLIPSIS = "…"


def let(value: Column, fn) -> Column:
    """``fn`` of a value that is computed once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


#: Elements that an ordered fold takes together; a fold copies its result in every step.
BLOCK = 128


def blocks(items: Column, size: Column | int = BLOCK) -> Column:
    """An array, which must not be empty, cut into arrays of ``size``."""
    number = F.ceil(F.size(items) / size).cast("int")
    return F.transform(F.sequence(F.lit(0), number - 1), lambda k: F.slice(items, (k * size + 1).cast("int"), size))


def positions(items: Column, size) -> Column:
    """For each element, the sum of ``size`` over the elements before it."""
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
    return F.aggregate(
        items, start,
        lambda a, z: F.struct((a["at"] + size(z)).alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")), lambda a: a["out"],
    )


def once(value: Column) -> Column:
    """Keep the optimizer from copying an expensive column into filters that it pushes down.

    A filter on a derived column is normally pushed below the projection with the whole
    expression inlined, which would evaluate it twice per row.  A generator of one row is a
    barrier for that column alone: filters on its output stay above it, filters on other columns
    (keys, dates) still reach the scan.  To be used as a whole column of ``select`` or ``withColumn``.
    """
    return F.explode_outer(F.array(value))


def preview(value: Column, n: int = 40, mark: str = ELLIPSIS) -> Column:
    """At most ``n`` characters, marked when something was cut off."""
    return F.when(F.length(value) <= n, value).otherwise(F.concat(value.substr(1, n), F.lit(mark)))


def leak_preview(value: Column, n: int, mark: str = "...") -> Column:
    """First ``n`` characters, always marked, so that a log never shows a whole secret."""
    return F.concat(value.substr(1, n), F.lit(mark))


def trim_spaces(value: Column) -> Column:
    return F.regexp_replace(value, java(r"^\s+|\s+\z"), "")


def collapse_spaces(value: Column) -> Column:
    return F.regexp_replace(value, java(r"\s+"), " ")


def match_line(text: Column, value: Column) -> Column:
    """First line that holds the value; the whole text when the value spans lines."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.contains(value))
    return F.coalesce(F.get(lines, 0), text)


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("double")


# The shape a full address must have; anything else is treated as malformed.
_URL = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#@]*@)?([^/?#:]+)(:[0-9]*)?"


def url_ok(url: Column) -> Column:
    return F.coalesce(url.rlike(_URL), F.lit(False))


def url_host(url: Column) -> Column:
    """Lower-case host, '' when the address is malformed."""
    return F.lower(F.coalesce(F.regexp_extract(url, _URL, 2), F.lit("")))


def url_path(url: Column) -> Column:
    rest = F.regexp_extract(url, _URL + r"([^?#]*)", 4)
    return F.when(rest == "", F.lit("/")).otherwise(rest)


def url_query(url: Column) -> Column:
    """Query with its question mark, '' when there is none."""
    q = F.regexp_extract(url, r"^[^?#]*(\?[^#]*)", 1)
    return F.when(q == "?", F.lit("")).otherwise(q)


def clean_url(url: Column) -> Column:
    """Origin and path only: no credentials, query or fragment.  Malformed addresses stay as they are."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://", 1))
    port = F.regexp_extract(url, _URL, 3)
    default = ((scheme == "http") & (port == ":80")) | ((scheme == "https") & (port == ":443")) | (port == ":")
    origin = F.concat(scheme, F.lit("://"), url_host(url), F.when(default, F.lit("")).otherwise(port))
    return F.when(url_ok(url), F.concat(origin, url_path(url))).otherwise(url)


def host_suffixes(host: Column) -> Column:
    """A host and all of its parent domains: a.b.c -> [a.b.c, b.c, c]."""
    parts = F.split(host, r"\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n - i + 1), "."))


def restricted_url(url: Column) -> Column:
    from hushlake.functions.dims import RESTRICTED_PARTS, RESTRICTED_PREFIXES

    u = F.lower(trim_spaces(url))
    cond = url.isNull() | (url == "")
    for p in RESTRICTED_PREFIXES:
        cond = cond | u.startswith(p)
    for p in RESTRICTED_PARTS:
        cond = cond | u.contains(p)
    return F.coalesce(cond, F.lit(True))
