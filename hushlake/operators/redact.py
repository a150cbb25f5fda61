"""Replacing detected values.  All of it is row-local: the text never enters a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hushlake.functions import placeholders as P
from hushlake.functions import scanner
from hushlake.functions.text import BLOCK, blocks, let, match_line, once
from hushlake.operators.spans import NO_SPANS, SPAN, prompt_finder, with_spans


def resolve_overlaps(spans: str) -> Column:
    """Leftmost span first, the longest of those, catalogue order last; later overlaps are dropped."""
    def reach(end: Column, s: Column) -> Column:
        return F.when(s["start"] >= end, s["start"] - s["neg_len"]).otherwise(end)

    def keep(part: Column, end: Column) -> Column:
        start = F.struct(end.alias("end"), F.expr(NO_SPANS).alias("kept"))
        return F.aggregate(
            part, start,
            lambda a, s: F.when(
                s["start"] >= a["end"],
                F.struct((s["start"] - s["neg_len"]).alias("end"), F.concat(a["kept"], F.array(s)).alias("kept")),
            ).otherwise(a),
            lambda a: a["kept"],
        )

    def in_blocks(parts: Column) -> Column:
        # Where the spans kept before each block end; then the blocks are independent.
        ends = F.aggregate(
            parts, F.struct(F.lit(-1).alias("end"), F.expr("cast(array() as array<int>)").alias("ends")),
            lambda a, part: F.struct(F.aggregate(part, a["end"], reach).alias("end"), F.concat(a["ends"], F.array(a["end"])).alias("ends")),
            lambda a: a["ends"],
        )
        return F.flatten(F.zip_with(parts, ends, keep))

    def resolve(ordered: Column) -> Column:
        return F.when(F.size(ordered) <= BLOCK, keep(ordered, F.lit(-1))).otherwise(let(blocks(ordered), in_blocks))

    return let(F.array_sort(spans), resolve)


def with_resolved(df: DataFrame, spans: str, out: str) -> DataFrame:
    """Add the resolved form of a span array; most texts have at most one span and skip the fold."""
    return df.withColumn(out, once(F.when(F.size(spans) > 1, resolve_overlaps(spans)).otherwise(F.col(spans))))


def line_prefix(text: Column, start: Column) -> Column:
    """What stands between the beginning of the line and a position."""
    return F.substring_index(text.substr(F.lit(1), start), "\n", -1)


def with_placeholders(df: DataFrame, text: str, spans: str, out: str, style: str = "prompt") -> DataFrame:
    """Placeholder of every (resolved) span, in the same order.

    ``prompt`` keeps the meaning of the assigned name or uses brackets, ``bracket`` is the
    plain bracket form, ``type`` the ``YOUR_`` form by type only.
    """
    t, found = F.col(text), F.col(spans)

    def in_stretch(part: Column) -> Column:
        """Prefixes are cut from the stretch of text from the line of a block's first span on."""
        base = F.get(part, 0)["start"]
        head = line_prefix(t, base)
        stretch = F.concat(head, F.substring(t, base + 1, F.element_at(part, -1)["start"] - base))
        return let(
            F.struct(stretch.alias("t"), (F.length(head) - base).alias("by")),
            lambda z: F.transform(part, lambda s: P.prompt_placeholder(s["type"], line_prefix(z["t"], s["start"] + z["by"]))),
        )

    if style == "prompt":
        marks = F.flatten(F.transform(blocks(found, _stretch(found)), in_stretch))
    else:
        marks = F.transform(found, lambda s: (P.bracket_placeholder if style == "bracket" else P.type_placeholder)(s["type"]))
    return df.withColumn(out, F.when(F.size(found) > 0, marks).otherwise(F.expr("cast(array() as array<string>)")))


def splice(text: str, spans: str, marks: str) -> Column:
    """The text with each resolved span cut out and its mark put in, in one pass over the spans.

    Many spans are taken in blocks, each with its own stretch of the text, as finding a place in a text means reading up to it.
    """
    def end(s: Column) -> Column:
        return s["start"] - s["neg_len"]

    def pieces(part: Column, names: Column, whole: Column, base: Column) -> Column:
        """What stands before each span, and its mark; ``whole`` begins at ``base``."""
        def piece(s: Column, i: Column) -> Column:
            before = F.when(i == 0, base).otherwise(end(F.get(part, i - 1)))
            return F.concat(F.substring(whole, before - base + 1, s["start"] - before), F.get(names, i))

        return F.array_join(F.transform(part, piece), "")

    def in_blocks(parts: Column) -> Column:
        size = _stretch(F.col(spans))

        def block(part: Column, k: Column) -> Column:
            base = F.when(k == 0, F.lit(0)).otherwise(end(F.element_at(F.get(parts, k - 1), -1)))
            stretch = F.substring(t, base + 1, F.element_at(part, -1)["start"] - base)
            names = F.slice(marks, (k * size + 1).cast("int"), size)
            return let(F.struct(stretch.alias("t"), names.alias("n"), base.alias("b")), lambda z: pieces(part, z["n"], z["t"], z["b"]))

        return F.array_join(F.transform(parts, block), "")

    t, found = F.col(text), F.col(spans)
    tail = F.substring(t, end(F.element_at(found, -1)) + 1, F.length(t))
    body = F.when(F.size(found) <= BLOCK, pieces(found, F.col(marks), t, F.lit(0))).otherwise(let(blocks(found, _stretch(found)), in_blocks))
    return F.when(F.size(found) == 0, t).otherwise(F.concat(body, tail))


def _stretch(spans: Column) -> Column:
    return F.greatest(F.lit(BLOCK), F.ceil(F.sqrt(F.size(spans).cast("double"))).cast("int"))


def redact_prompts(df: DataFrame, text: str = "text", style: str = "prompt", types=None, keep_spans: bool = True) -> DataFrame:
    """Detect with the prompt rules, resolve overlaps and replace the exact spans.

    Adds ``spans`` (resolved), ``placeholders`` and ``redacted``.  The same as ``with_spans``, ``with_resolved``,
    ``with_placeholders`` and ``splice`` one after the other, done by plain Python in the workers, text by text.
    """
    done = f"struct<spans:array<{SPAN}>,placeholders:array<string>,redacted:string>"
    redact = F.arrow_udf(scanner.on_texts(scanner.redactor(prompt_finder(types), style), scanner.redacted_rows), done)
    out = df.withColumn("__done", once(redact(F.make_valid_utf8(text))))
    changed = F.when(F.size("__done.spans") == 0, F.col(text)).otherwise(F.col("__done.redacted"))
    out = out.withColumns({"spans": F.col("__done.spans"), "placeholders": F.col("__done.placeholders"), "redacted": changed}).drop("__done")
    return out if keep_spans else out.drop("spans", "placeholders")


def replace_values(text: Column, items: Column, named: bool = False) -> Column:
    """Replace every occurrence of each item's value, longest value first, line by line.

    On a line where the value is assigned to a name, the placeholder keeps that name;
    what is left over (values that span lines) gets the placeholder of the type.  With ``named``
    the items carry a ``variable`` that stands in for the name where it is known.
    """
    ordered = F.array_sort(
        F.transform(
            items,
            lambda s, i: F.struct(
                s["neg_len"].alias("k"), i.alias("i"), s["type"].alias("type"), s["value"].alias("value"),
                *([s["variable"].alias("variable")] if named else []),
            ),
        )
    )

    def on_line(value: Column, type_: Column, given: Column | None):
        def name(line: Column) -> Column:
            found = P.variable_name(line, value)
            return found if given is None else F.coalesce(given, found)

        return lambda line: F.when(
            line.contains(value),
            F.replace(line, value, P.choose_placeholder(type_, name(line))),
        ).otherwise(line)

    def step(acc: Column, s: Column) -> Column:
        v, ty = s["value"], s["type"]
        by_line = F.array_join(F.transform(F.split(acc, "\n"), on_line(v, ty, s["variable"] if named else None)), "\n")
        return F.when(
            (v != "") & (v != "[face]") & acc.contains(v), F.replace(by_line, v, P.type_placeholder(ty))
        ).otherwise(acc)

    return F.aggregate(ordered, text, step)


def sanitize_text(df: DataFrame, text: str = "text", out: str = "sanitized", **options) -> DataFrame:
    """Detect and replace in one go; a text without matches passes unchanged."""
    found = with_spans(df, text, "__items", **options)
    clean = F.when(F.size("__items") > 0, replace_values(F.col(text), F.col("__items"))).otherwise(F.col(text))
    return found.withColumn(out, once(clean)).drop("__items")


def sanitize_outgoing(df: DataFrame, text: str, when: Column, out: str = "sanitized") -> DataFrame:
    """Directional form: only rows that satisfy ``when`` (user input) are changed.

    The placeholder is chosen once per value, from the first line that holds it.
    """
    t = F.col(text)
    scanned = df.withColumn("__scan", F.when(when, t))
    found = with_spans(scanned, "__scan", "__items")

    def step(acc: Column, s: Column) -> Column:
        v = s["value"]
        name = P.variable_name(match_line(acc, v), v)
        return F.when(acc.contains(v), F.replace(acc, v, P.choose_placeholder(s["type"], name))).otherwise(acc)

    ordered = F.array_sort(
        F.transform(
            "__items",
            lambda s, i: F.struct(s["neg_len"].alias("k"), i.alias("i"), s["type"].alias("type"), s["value"].alias("value")),
        )
    )
    return found.withColumn(
        out, F.when(when & (F.size("__items") > 0), F.aggregate(ordered, t, step)).otherwise(t)
    ).drop("__items", "__scan")


def sanitize_nested(df: DataFrame, items: str, columns: list[str] | None = None) -> DataFrame:
    """Replace values in every string of the given columns: structs, arrays and maps, however they are nested.

    The walk follows the schema, so the work stays in column expressions.  Map keys stay as they are.
    A column of a type whose strings cannot be reached along the schema (variant, binary) is an error.
    """
    it = F.col(items)

    def walk(c: Column, dt: T.DataType) -> Column:
        if isinstance(dt, T.StringType):
            return F.when(c.isNull() | (F.size(it) == 0), c).otherwise(replace_values(c, it))
        if isinstance(dt, T.StructType):
            inner = F.struct(*[walk(c[f.name], f.dataType).alias(f.name) for f in dt.fields])
            return F.when(c.isNotNull(), inner)
        if isinstance(dt, T.ArrayType):
            return F.transform(c, lambda x: walk(x, dt.elementType))
        if isinstance(dt, T.MapType):
            return F.transform_values(c, lambda k, v: walk(v, dt.valueType))
        if isinstance(dt, (T.VariantType, T.BinaryType)):
            raise TypeError(f"the strings of a {dt.simpleString()} column cannot be replaced")
        return c

    names = columns or [f.name for f in df.schema.fields if f.name != items]
    return df.select(
        *[
            walk(F.col(f.name), f.dataType).alias(f.name) if f.name in names else F.col(f.name)
            for f in df.schema.fields
        ]
    )
