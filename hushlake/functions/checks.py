"""Value checks as column expressions: checksums, allowlist, entropy, fingerprint."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hushlake.functions.catalog import java
from hushlake.functions.dims import ALLOWED_TERMS
from hushlake.functions.text import let

# Verhoeff tables, from their definition: multiplication in the dihedral group D5 and
# the powers of one fixed permutation.
_PERMUTATION = (1, 5, 7, 6, 2, 8, 3, 0, 9, 4)


def _dihedral(a: int, b: int) -> int:
    if a < 5:
        return (a + b) % 5 if b < 5 else 5 + (a + b - 5) % 5
    return 5 + (a - 5 - b) % 5 if b < 5 else (a - b) % 5


def verhoeff_tables() -> tuple[list[int], list[int]]:
    """(product table, permutation table), each flattened row by row."""
    product = [_dihedral(a, b) for a in range(10) for b in range(10)]
    rows = [list(range(10))]
    for _ in range(7):
        rows.append([rows[-1][_PERMUTATION[j]] for j in range(10)])
    return product, [v for row in rows for v in row]


def _ints(values: list[int]) -> Column:
    return F.expr("array(" + ",".join(map(str, values)) + ")")


def _digit(s: Column, i: Column) -> Column:
    return F.ascii(s.substr(i, F.lit(1))) - 48


def strip_separators(value: Column) -> Column:
    return F.regexp_replace(value, java(r"[\s-]"), "")


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """13 to 19 digits (blanks and dashes ignored) whose Luhn sum is a multiple of ten."""
    return let(strip_separators(value), _luhn)


def _luhn(d: Column) -> Column:
    n = F.length(d)

    def add(total: Column, i: Column) -> Column:
        x = _digit(d, i)
        twice = x * 2
        return total + F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)
    return F.when(d.rlike(r"^[0-9]{13,19}\z"), total % 10 == 0).otherwise(False)


def verhoeff(value: Column) -> Column:
    """12 digits, not led by 0 or 1, not one digit repeated, Verhoeff checksum zero."""
    return let(strip_separators(value), _verhoeff)


def _verhoeff(d: Column) -> Column:
    product, permutation = verhoeff_tables()

    def step(c: Column, i: Column) -> Column:
        p = F.element_at(_ints(permutation), ((i - 1) % 8) * 10 + _digit(d, 13 - i) + 1)
        return F.element_at(_ints(product), c * 10 + p + 1)

    check = F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(0), step)
    shape = d.rlike(r"^[2-9][0-9]{11}\z") & (F.replace(d, d.substr(1, 1), F.lit("")) != "")
    return F.when(shape, check == 0).otherwise(False)


def aadhaar(value: Column, strict: bool = False) -> Column:
    """Checksum; unless ``strict``, any 4-4-4 grouping and one documented sample also pass."""
    if strict:
        return verhoeff(value)
    grouped = value.rlike(java(r"^[1-9]\d{3}[\s-](\d{4})[\s-](\d{4})\z"))
    return grouped | (strip_separators(value) == "123456789012") | verhoeff(value)


def phone_length(value: Column) -> Column:
    return F.length(digits_only(value)).between(7, 15)


def normalise_term(value: Column) -> Column:
    trimmed = F.regexp_replace(value, java(r"^\s+|\s+\z"), "")
    spaced = F.lower(F.regexp_replace(trimmed, java(r"\s+"), " "))
    return F.when(value.rlike(r"^[!-~]+\z"), F.lower(value)).otherwise(spaced)  # most values hold no space


def placeholder_shaped(clean: Column) -> Column:
    return (
        clean.startswith("your_")
        | clean.startswith("[")
        | clean.endswith("]")
        | clean.rlike(r"^[a-z0-9_]+=your_[a-z0-9_]+\z")
    )


def term_list(terms: list[str]) -> Column:
    """A constant array; split from one literal, so that building the plan stays cheap."""
    return F.split(F.lit("|".join(terms)), r"\|")


def allowlisted(value: Column, terms: list[str] | None = None) -> Column:
    """Known term, placeholder, or nothing but known words."""
    chosen = ALLOWED_TERMS if terms is None else terms
    known = term_list(chosen)
    longest = max(map(len, "|".join(chosen).split("|")))

    def listed(word: Column) -> Column:
        return (F.length(word) <= longest) & F.array_contains(known, word)

    def test(clean: Column) -> Column:
        every_word = clean.contains(" ") & F.forall(F.split(clean, " "), listed)
        return (clean == "") | placeholder_shaped(clean) | listed(clean) | every_word

    return value.isNull() | let(normalise_term(value), test)


def characters(value: Column) -> Column:
    """The characters of a text in one pass (a substring per character would be quadratic)."""
    return F.filter(F.split(value, ""), lambda c: c != "")


def shannon_entropy(value: Column) -> Column:
    def total(chars: Column) -> Column:
        def add(h: Column, c: Column) -> Column:
            p = F.size(F.filter(chars, lambda x: x == c)) / F.size(chars)
            return h - p * F.log2(p)

        return F.aggregate(F.array_sort(F.array_distinct(chars)), F.lit(0.0), add)

    return let(characters(value), total)


def high_entropy(value: Column, threshold: float = 4.2) -> Column:
    return (F.length(value) >= 16) & (shannon_entropy(value) > threshold)


def fnv1a(value: Column) -> Column:
    """32-bit FNV-1a over UTF-16 code units, as lower-case hex without padding."""

    def mix(h: Column, unit: Column) -> Column:
        return (h.bitwiseXOR(unit) * F.lit(16777619).cast("long")).bitwiseAND(F.lit(4294967295).cast("long"))

    def step(h: Column, c: Column) -> Column:
        code = F.ascii(c).cast("long")
        high = F.lit(0xD800).cast("long") + F.shiftright(code - 0x10000, 10)
        low = F.lit(0xDC00).cast("long") + (code - 0x10000).bitwiseAND(F.lit(0x3FF).cast("long"))
        return F.when(code < 0x10000, mix(h, code)).otherwise(mix(mix(h, high), low))

    h = F.aggregate(characters(value), F.lit(2166136261).cast("long"), step)
    return F.lower(F.hex(h))


def already_placeholder(value: Column) -> Column:
    return (
        (value.startswith("[") & value.endswith("]"))
        | value.startswith("YOUR_")
        | value.contains("YOUR_PASSWORD")
        | value.contains("YOUR_API_KEY")
    )
