"""All rules on one text in plain Python: what ``spans.with_spans`` does with ``prompt_rules``, for tables that need it at scale.

The engine interprets nested array expressions node by node, which costs a short text far more than its patterns do.  The
patterns, anchors and checks come from the same tables; the tests hold both forms against each other.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa

from hushlake.functions import catalog as C
from hushlake.functions.checks import verhoeff_tables
from hushlake.functions.dims import (
    ALLOWED_TERMS,
    BRACKET,
    DEFAULT_PLACEHOLDER,
    FALLBACK_PLACEHOLDER,
    NAME_CONTAINS,
    NAME_EQUALS,
    NAMED_EXEMPT,
    NAMED_MARKS,
    PROMPT_PLACEHOLDER,
)

#: start, neg_len, ord, type, value, confidence
Span = tuple[int, int, int, str, str, float]
_FIELDS = {"start": pa.int32(), "neg_len": pa.int32(), "ord": pa.int32(), "type": pa.string(), "value": pa.string(), "confidence": pa.float64()}
#: Characters of texts whose spans are put together at a time.
CHUNK = 4_000_000


def portable(pattern: str, ignore_case: bool = False) -> re.Pattern:
    """A pattern of the catalogue (portable, or rendered for the engine) compiled for Python, ASCII as there."""
    body = C._expand(pattern.replace(C._BOUNDARY, r"\b"), r"\b").replace(r"\z", r"\Z")
    body = re.sub(r"\\x\{([0-9A-Fa-f]+)\}", lambda m: f"\\u{int(m[1], 16):04x}", body)
    return re.compile(body, re.A | (re.I if ignore_case else 0))


_SEPARATORS, _EDGES, _SPACES = portable(r"[\s-]"), portable(r"^\s+|\s+\z"), portable(r"\s+")
_GROUPED = portable(r"^[1-9]\d{3}[\s-](\d{4})[\s-](\d{4})\z")
_CARD, _TWELVE, _DIGIT = portable(r"^[0-9]{13,19}\z"), portable(r"^[2-9][0-9]{11}\z"), portable("[0-9]")
_PLAIN, _ASSIGNED, _NAMED = portable(r"^[!-~]+\z"), portable(r"^[a-z0-9_]+=your_[a-z0-9_]+\z"), portable(r"^\s*[:=]")
_TAIL = portable(r"[.,;:]+\z")
_PRODUCT, _PERMUTATION = verhoeff_tables()
_KNOWN = frozenset(ALLOWED_TERMS)
_STRONG = [portable(p) for p in ("[a-z]", "[A-Z]", "[0-9]", "[!@#$%^&*?]")]


def luhn(value: str) -> bool:
    digits = _SEPARATORS.sub("", value)
    if not _CARD.search(digits):
        return False
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def verhoeff(value: str) -> bool:
    digits = _SEPARATORS.sub("", value)
    if not _TWELVE.search(digits) or digits == digits[0] * 12:
        return False
    c = 0
    for i in range(12):
        c = _PRODUCT[c * 10 + _PERMUTATION[i % 8 * 10 + int(digits[11 - i])]]
    return c == 0


def aadhaar(value: str) -> bool:
    return bool(_GROUPED.search(value)) or _SEPARATORS.sub("", value) == "123456789012" or verhoeff(value)


def phone_length(value: str) -> bool:
    return 7 <= len(_DIGIT.findall(value)) <= 15


def allowlisted(value: str) -> bool:
    """Known term, placeholder, or nothing but known words."""
    clean = value.lower() if _PLAIN.search(value) else _SPACES.sub(" ", _EDGES.sub("", value)).lower()
    if clean == "" or clean in _KNOWN or clean.startswith(("your_", "[")) or clean.endswith("]") or _ASSIGNED.search(clean):
        return True
    return " " in clean and all(word in _KNOWN for word in clean.split(" "))


def _prompt_keep(value: str, strong: bool) -> bool:
    if (value.startswith("[") and value.endswith("]")) or value.startswith("YOUR_") or "YOUR_PASSWORD" in value or "YOUR_API_KEY" in value:
        return False
    if not strong:
        return True
    return value.lower() not in ("password", "passwd", "secret", "token", "apikey", "bearer") and all(p.search(value) for p in _STRONG)


_CHECKS: dict[str, Callable[[str], bool]] = {"luhn": luhn, "aadhaar": aadhaar, "verhoeff": verhoeff, "phone": phone_length}
_RUN = portable(r"(?<![\w\-])[\w\-]{20}")  # looked for where a run begins only
#: Shared anchors.
_SHARED: dict[str, Callable[[str], object]] = {
    C.DIGITS: portable("[0-9]{4}").search,
    C.CAPITALS: portable("[A-Z]{4}").search,
    C.LONG_RUN: lambda text: max(map(len, text.split()), default=0) >= 20 and _RUN.search(text),
}
#: What every match of a costly pattern of the catalogue holds.
_ENDS = {C.BY_TYPE["PHONE"].pattern: portable(r"[0-9]{3}[-.\s]?[0-9]{4}\b").search}
_BREAKS, _WORD_CHARACTERS = re.compile("[\n\r\u2028\u2029]"), "".join(map(chr, (*range(48, 58), *range(65, 91), 95, *range(97, 123))))


def _key_hits(words: str) -> Callable[[str], Iterator[tuple[int, str]]]:
    """Places and values of the generic key rule, in time linear in the text (see ``spans._key_spans``)."""
    any_word, last_word = portable(words, True), portable(rf"^((?s:.*))(?:{words})", True)
    run, token = portable(r"(?<![A-Za-z0-9_\-])[A-Za-z0-9_\-]{20}"), portable(r"\b[A-Za-z0-9_\-]{20,}(?:\b|\z)")

    def hits(text: str) -> Iterator[tuple[int, str]]:
        base = 0
        for line in _BREAKS.split(text):
            if any_word.search(line) and run.search(line):
                head = last_word.match(line)[1].rstrip(_WORD_CHARACTERS)
                for m in token.finditer(head):
                    yield base + m.start(), m[0]
            base += len(line) + 1

    return hits


def _held(anchor: tuple[str, ...]) -> Callable[[str, str], bool]:
    """The test of an anchor on a text and its lower-case form."""
    shared = [_SHARED[a] for a in anchor if a in _SHARED]
    lower = [a[6:] for a in anchor if a.startswith("lower:")]
    plain = [a for a in anchor if a not in _SHARED and not a.startswith("lower:")]
    if not anchor:
        return lambda text, low: True
    if len(anchor) == 1 and plain:
        (one,) = plain
        return lambda text, low: one in text
    if len(anchor) == 1 and lower:
        (one,) = lower
        return lambda text, low: one in low
    if all(len(a) == 1 for a in anchor):
        one_of = re.compile("[" + re.escape("".join(anchor)) + "]").search
        return lambda text, low: one_of(text) is not None

    def held(text: str, low: str) -> bool:
        for a in plain:
            if a in text:
                return True
        for a in lower:
            if a in low:
                return True
        for search in shared:
            if search(text):
                return True
        return False

    return held


def scan(detectors: list[tuple[int, C.Detector]], rules: list[tuple[int, tuple]], key_words: str) -> Callable[[str | None], list[Span]]:
    """A function that lists the spans of a text in catalogue order, then those of the prompt rules.

    ``detectors`` come with their place, ``rules`` are (ord, (type, confidence, pattern, group, anchor, strong)).
    """
    patterns = {i: portable((f"(?={d.lead})" if d.lead else "") + f"(?:{d.pattern})", d.ignore_case) for i, d in detectors}
    any_word, key_hits = portable(key_words, True), _key_hits(key_words)
    # detectors of equal anchors stand together, so that an anchor is looked for once
    groups: dict[tuple[str, ...], list] = {}
    for i, d in detectors:
        groups.setdefault(d.anchor, []).append((i, d.check, _CHECKS.get(d.check), patterns[i], _ENDS.get(d.pattern)))
    by_place = dict(detectors)
    finders = [(_held(anchor), members) for anchor, members in groups.items()]
    prompts = [(_held(anchor), o, t, c, portable(p), g, strong) for o, (t, c, p, g, anchor, strong) in rules]

    def spans(text: str | None) -> list[Span]:
        if not text:
            return []
        low, found = text.lower(), []
        for held, members in finders:
            if not held(text, low):
                continue
            for i, name, check, pattern, end in members:
                if end is not None and not end(text):
                    continue
                if name == "not_a_name":
                    if any_word.search(text):
                        for at, v in key_hits(text):
                            if not _NAMED.search(text[at + len(v) : at + len(v) + 10]) and not allowlisted(v):
                                found.append((i, at, v))
                    continue
                for m in pattern.finditer(text):
                    v = m[0]
                    if (check is None or check(v)) and not allowlisted(v):
                        found.append((i, m.start(), v))
        found.sort(key=lambda z: z[0])  # stable: places of one detector stay in order
        out = [(at, -len(v), i, by_place[i].type, v, by_place[i].confidence) for i, at, v in found]
        for held, o, type_, confidence, pattern, group, strong in prompts:
            if held(text, low):
                for m in pattern.finditer(text):
                    whole, inner = m[0], m[group]
                    v = _TAIL.sub("", inner)
                    if _prompt_keep(v, strong):
                        quoted = 1 if whole.endswith(('"', "'")) else 0
                        at = m.start() + (len(whole) if v == "" else len(whole) - len(inner) - quoted)
                        out.append((at, -len(v), o, type_, v, confidence))
        return out

    return spans


def resolve(spans: list[Span]) -> list[Span]:
    """Leftmost span first, the longest of those, catalogue order last; later overlaps are dropped."""
    if len(spans) < 2:
        return spans
    end, kept = -1, []
    for s in sorted(spans):
        if s[0] >= end:
            end = s[0] - s[1]
            kept.append(s)
    return kept


_BLANKS = frozenset(c for c in map(chr, range(0x10000)) if _SPACES.match(c)) - {"\n"}
_NAME = frozenset(_WORD_CHARACTERS)
_FRAMEWORK = portable("^(NEXT_PUBLIC_|VITE_|REACT_APP_|PUBLIC_)", True)


def assigned_name(text: str, start: int) -> str:
    """The name that the value at ``start`` is assigned to right there on its line; '' when there is none."""

    def back(at: int, chars: frozenset) -> int:
        while at > 0 and text[at - 1] in chars:
            at -= 1
        return at

    at = start - 1 if start > 0 and text[start - 1] in "\"'" else start
    at = back(at, _BLANKS)
    if at == 0 or text[at - 1] != "=":
        return ""
    end = back(at - 1, _BLANKS)
    name = text[back(end, _NAME) : end]
    return name if len(name) >= 3 else ""


def name_placeholder(name: str) -> str:
    upper = _FRAMEWORK.sub("", name).upper()
    for alternatives, value in NAME_CONTAINS:
        if any(all(p in upper for p in parts) for parts in alternatives):
            return value
    for names, value in NAME_EQUALS:
        if upper in names:
            return value
    return "YOUR_" + upper


def placeholder(style: str) -> Callable[[str, str, int], str]:
    """The mark of a span of a type at a place of a text; see ``redact.with_placeholders``."""
    if style == "bracket":
        return lambda type_, text, start: BRACKET.get(type_, "[REDACTED]")
    if style != "prompt":
        return lambda type_, text, start: DEFAULT_PLACEHOLDER.get(type_, FALLBACK_PLACEHOLDER)

    def mark(type_: str, text: str, start: int) -> str:
        if type_ not in NAMED_EXEMPT:
            name = assigned_name(text, start)
            if name and ("_" in name or name == name.upper()) and any(m in name for m in NAMED_MARKS):
                return name_placeholder(name)
        return PROMPT_PLACEHOLDER.get(type_) or DEFAULT_PLACEHOLDER.get(type_, FALLBACK_PLACEHOLDER)

    return mark


def redactor(find: Callable[[str | None], list[Span]], style: str) -> Callable[[str | None], tuple]:
    """A function that gives a text's resolved spans, their marks, and the text with marks; no text where nothing changes."""
    mark = placeholder(style)

    def redact(text: str | None) -> tuple:
        spans = resolve(find(text))
        if not spans:
            return spans, [], None
        marks, out, end = [mark(s[3], text, s[0]) for s in spans], [], 0
        for s, m in zip(spans, marks):
            out += (text[end : s[0]], m)
            end = s[0] - s[1]
        return spans, marks, "".join(out) + text[end:]

    return redact


def span_lists(texts: list[list[Span]]) -> pa.Array:
    """The spans of some texts as one array of lists."""
    flat = [s for spans in texts for s in spans]
    columns = [pa.array(c, t) for c, t in zip(zip(*flat) if flat else [()] * len(_FIELDS), _FIELDS.values())]
    return pa.ListArray.from_arrays(pa.array([0, *accumulate(map(len, texts))], pa.int32()), pa.StructArray.from_arrays(columns, list(_FIELDS)))


def in_chunks(texts: pa.Array, fn: Callable, made: Callable[[list], pa.Array]) -> Iterator[pa.Array]:
    """``made`` of ``fn`` of each text, some texts at a time."""
    some, size = [], 0
    for text in texts:
        text = text.as_py()
        some.append(fn(text))
        size += len(text or "")
        if size >= CHUNK:
            yield made(some)
            some, size = [], 0
    if some:
        yield made(some)


def redacted_rows(done: list[tuple]) -> pa.Array:
    """What ``redactor`` gives for some texts as one array of structs."""
    spans = [d[0] for d in done]
    at = pa.array([0, *accumulate(map(len, spans))], pa.int32())
    marks = pa.ListArray.from_arrays(at, pa.array([m for d in done for m in d[1]], pa.string()))
    return pa.StructArray.from_arrays([span_lists(spans), marks, pa.array([d[2] for d in done], pa.string())], ["spans", "placeholders", "redacted"])


def counts(spans: list[list[Span]]) -> pa.Array:
    return pa.array([len(s) for s in spans], pa.int64())


def on_texts(fn: Callable, made: Callable[[list], pa.Array]) -> Callable[[Iterator[pa.Array]], Iterator[pa.Array]]:
    """A function of batches of texts for ``arrow_udf``."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield from in_chunks(texts, fn, made)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run
