"""URL rules: expressions of each address, looked up by short hash prefixes and confirmed by full digests.

A rule names a host and the beginning of a path; it fits its host and all subdomains of it.  An address is expanded
into expressions, each a suffix of its host's labels and a directory of its path.  Rules are kept under the
expression of their host and directory: the first 32 bits of its SHA-256 are the join key, the whole digest
confirms, and the rest of the rule's path (behind its last slash) is compared at last.  Of the rules that fit, the
longest one decides.

No rule looks further than the longest host and path among the rules, so only that much of an address is expanded,
however long it is; that is a bound and no cut.  Addresses are reduced to their distinct (host, beginning of the path)
first, so a site that holds a third of all rows is looked up once for each beginning.  Decisions, of which there are
few, come back to the rows by (host, beginning, salt): no task gets all rows of a site.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii

#: Verdict of an address that no rule fits.
DEFAULT = "allow"
#: Hexadecimal digits of the digest that make the join key.
SHORT_DIGITS = 8

#: Each decision goes to so many places, and the rows of one site are dealt out over them.
SALTS = 64

_ADDRESS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of an address; both empty if it is null or has no ``://``."""
    known = F.coalesce(url, F.lit(""))
    return lower_ascii(F.regexp_extract(known, _ADDRESS, 1)), F.regexp_extract(known, _ADDRESS, 2)


def host_suffixes(host: Column, longest: int) -> Column:
    """The host and its parent domains, as far as they have at most ``longest`` characters."""
    tail = F.split(F.right(host, F.lit(longest + 1)), r"\.", -1)
    n = F.size(tail)
    parents = F.when(n > 1, F.transform(F.sequence(F.lit(2), n), lambda i: F.array_join(F.slice(tail, i, n - i + 1), ".")))
    own = F.when(F.length(host) <= longest, F.array(host))
    nothing = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(own, nothing), F.coalesce(parents, nothing)))


def directories(path: Column) -> Column:
    """The empty path, and the path up to each of its slashes."""
    parts = F.split(path, "/", -1)
    n = F.size(parts)
    each = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))
    return F.concat(F.array(F.lit("")), F.coalesce(each, F.array().cast("array<string>")))


def _keyed(df: DataFrame, expression: Column) -> DataFrame:
    return df.withColumn("digest", F.sha2(expression, 256)).withColumn("short", F.substring("digest", 1, SHORT_DIGITS))


def judge_urls(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT) -> DataFrame:
    """One row per input row: the id, host, path, rule and verdict.

    ``rules`` has host, path and verdict.  A rule fits if the address has its host or a subdomain of it and a path that
    starts with the rule's path.  The rule with the most characters (host and path) wins; among equals the one with
    the longer host, then ``block``.  rule is host and path of the winner, or null; the verdict is then ``default``.

    A null address, or one without ``://``, has an empty host and path.  A rule's host is compared in lower case;
    a null rule path counts as empty; rules without host or verdict are left out, repeated rules count once.  Rows
    may repeat, ids may be null, other columns are not read.  Without rules every address gets ``default``.
    """
    host, path = url_parts(F.col(url_col))
    pages = urls.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    known = rules.filter("host IS NOT NULL AND verdict IS NOT NULL").select(
        lower_ascii(F.col("host")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), F.col("verdict"),
    ).distinct()
    reach = known.agg(F.max(F.length("rule_host")).alias("host"), F.max(F.length("rule_path")).alias("path")).first()
    reach_host, reach_path = reach["host"] or 0, reach["path"] or 0

    pages = pages.withColumn("start", F.left("path", F.lit(reach_path)) if reach_path else F.lit(""))
    sites = pages.select("host", "start").distinct()
    each = sites.withColumn("suffix", F.explode(host_suffixes(F.col("host"), reach_host))).withColumn("directory", F.explode(directories(F.col("start"))))
    each = _keyed(each, F.concat("suffix", "directory")).select("host", "start", "digest", "short")
    listed = _keyed(known, F.concat("rule_host", F.regexp_extract("rule_path", "(?s)^(.*/)?", 0)))

    met = each.join(listed.withColumnRenamed("digest", "full"), "short").filter(
        (F.col("digest") == F.col("full")) & F.startswith("start", "rule_path")
    )
    order = F.struct(F.length("rule_host") + F.length("rule_path"), F.length("rule_host"), F.col("verdict") == "block")
    decided = met.groupBy("host", "start").agg(
        F.max_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), order).alias("won")
    )
    pages = pages.withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.lit(SALTS)).cast("int"))
    decided = decided.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.join(decided, ["host", "start", "salt"], "left").select(
        F.col("id").alias(id_col), "host", "path", F.col("won.rule").alias("rule"),
        F.coalesce("won.verdict", F.lit(default)).alias("verdict"),
    )


URL_SQL = r"""
WITH r(host, path, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), p AS (
  SELECT row_number() OVER () AS i, page_id,
    translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM pages
), m AS (
  SELECT p.i, arg_max(struct_pack(rule := r.host || r.path, verdict := r.verdict), length(r.host || r.path)) AS w
  FROM p JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY 1
)
SELECT p.page_id, p.host, p.path, m.w.rule AS rule, coalesce(m.w.verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (i)
"""
