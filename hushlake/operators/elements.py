"""Pages to elements: one Arrow-batched parsing step, column expressions from there on."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hushlake.functions import catalog as C
from hushlake.functions.text import collapse_spaces, trim_spaces
from hushlake.operators.spans import with_spans
from hushlake.sources.tables import dealt

ELEMENT = (
    "struct<idx:int,parent:int,depth:int,nth:int,tag:string,path:string,text:string,full_text:string,"
    "children:int,attrs:map<string,string>,ignored:boolean,hidden:boolean,chip:boolean,editable:boolean,"
    "level:int,last:int,skipped:boolean,by_ref:string,by_for:string,form:int,head:int,head_steps:int,provenance:string>"
)

_FIELDS = [f.split(":")[0] for f in ELEMENT.removeprefix("struct<").replace("map<string,string>", "map").split(",")]

# Containers whose text is page furniture, not content.
IGNORED_TAGS = {"nav", "header", "footer", "aside", "title", "h1", "button", "a", "label"}
IGNORED_ROLES = {"navigation", "complementary", "button", "link"}
IGNORED_CLASSES = {
    "nav", "navbar", "header", "sidebar", "breadcrumb", "logo", "history", "chat-history", "title", "page-title",
    "gsi-material-button",
}
IGNORED_IDS = {"logo", "history"}
TEXT_TAGS = ["code", "pre", "p", "span", "div", "td", "li", "blockquote"]
NON_TEXT_INPUTS = ["hidden", "submit", "button", "reset", "image", "checkbox", "radio"]
INTERACTIVE_ROLES = [
    "button", "link", "textbox", "checkbox", "radio", "combobox", "listbox", "menuitem", "tab", "switch",
    "searchbox", "form", "dialog", "alertdialog",
]
INTERACTIVE_TAGS = ["button", "a", "input", "textarea", "select", "form", "details"]
NAME_HINTS = ["name", "fullname", "full_name", "full-name", "author", "firstname", "lastname", "owner"]

SKELETON_CONTAINERS = ["form", "main", "nav", "header", "footer", "section", "article", "div", "p", "pre", "code"]
SKELETON_INTERACTIVE = ["input", "button", "select", "textarea", "a"]
SKELETON_SKIPPED = ["script", "style", "noscript", "meta", "link", "svg"]

# Which elements hold answers, past messages, or what a user writes.  (attribute, test, value); a class by its name.
ASSISTANT_MARKS = [
    ("data-message-author-role", "is", "assistant"), ("data-testid", "has", "assistant"), ("class", "word", "agent-turn"),
    ("data-message-model-slug", "any", ""), ("class", "word", "font-claude-message"), ("data-is-streaming", "any", ""),
    ("class", "word", "response-content"), ("class", "word", "ai-response"), ("class", "word", "bot-message"),
    ("class", "word", "model-response"), ("data-author", "same", "assistant"), ("data-role", "same", "assistant"),
    ("class", "word", "assistant-message"), ("class", "word", "ai-turn"), ("class", "word", "model-turn"), ("class", "word", "chat-response"),
]
HISTORY_MARKS = [
    ("data-testid", "has", "conversation"), ("data-testid", "has", "chat-turn"), ("data-testid", "has", "message-bubble"),
    ("class", "word", "conversation-item"), ("class", "word", "chat-history"), ("class", "word", "thread-history"),
    ("role", "is", "log"), ("class", "word", "chat-log"), ("class", "word", "message-list"), ("class", "word", "chat-messages"),
    ("class", "word", "history-container"),
]
HISTORY_TAGS = [("article", "data-testid"), ("div", "data-message-id")]
COMPOSER_MARKS = [("id", "is", "prompt-textarea"), ("data-testid", "has", "composer"), ("data-testid", "has", "prompt-input")]
COMPOSER_HINTS = ["ask", "message", "prompt"]
COMPOSER_CONTAINER = "composer-container"
# --- end of fixed values

#: Characters of pages whose elements a task hands over at once: the bound of its memory besides one page.
CHUNK = 1 << 20
USER_INPUT, WEBPAGE_CONTENT = "USER_INPUT", "WEBPAGE_CONTENT"
_HEADINGS = {"h1", "h2", "h3", "h4", "legend"}
#: Elements whose whole text is asked for; that of all others stays in the parser.
_TEXT_OWNERS = {"code", "pre", "textarea", "button", "a", "title", "label", *_HEADINGS}

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES_P = {
    "address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4",
    "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
}
_SAME = {"li": {"ul", "ol"}, "option": {"select"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}}


_INHERITED = ("ignored", "hidden", "chip", "editable", "answer", "past", "boxed", "composer")
_FALSE = (False,) * len(_INHERITED)


class _Tree(HTMLParser):
    """Flat list of the elements of one page, in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[dict] = []
        self.open: list[int] = []
        self.pieces: list[str] = []
        self.kids: dict[tuple[int, str], int] = {}

    def updatepos(self, i, j):
        return j  # nobody asks for lines

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_P:
            self._close("p", {"button", "td", "th", "body"})
        if tag in _SAME:
            self._close(tag, _SAME[tag])
        parent = self.open[-1] if self.open else -1
        up = self.rows[parent] if parent >= 0 else None
        a = {k: v or "" for k, v in attrs}
        nth = self.kids[(parent, tag)] = self.kids.get((parent, tag), 0) + 1
        ignored, hidden, chip, editable, answer, past, boxed, composer = (up[k] for k in _INHERITED) if up else _FALSE
        composer = composer or _composer(tag, a, boxed)
        if a:  # most tests look at attributes only
            ignored, hidden, chip = ignored or _ignored(tag, a), hidden or _hidden(a), chip or _chip(tag, a)
            editable = editable or a.get("contenteditable", "no") in ("", "true")
            answer = answer or _any_mark(a, _ASSISTANT)
            past = past or _any_mark(a, _HISTORY) or any(tag == t and k in a for t, k in HISTORY_TAGS)
            boxed = boxed or _marked(a, "class", "word", COMPOSER_CONTAINER)
        row = {
            "idx": len(self.rows), "parent": parent, "depth": up["depth"] + 1 if up else 0, "nth": nth, "tag": tag,
            "path": f"{up['path'] if up else ''}/{tag}[{nth}]", "attrs": a, "own": [], "from": len(self.pieces), "children": 0,
            "ignored": ignored or tag in IGNORED_TAGS, "hidden": hidden, "chip": chip, "editable": editable,
            "level": 0 if tag == "body" else up["level"] + 1 if up and up["level"] >= 0 else -1,
            "skipped": bool(up and up["skipped"]) or tag in SKELETON_SKIPPED,
            "answer": answer, "past": past, "boxed": boxed, "composer": composer,
        }
        if up:
            up["children"] += 1
        self.rows.append(row)
        if tag not in _VOID:
            self.open.append(row["idx"])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.rows[self.open.pop()]["to"] = len(self.pieces)

    def handle_endtag(self, tag):
        self._close(tag, set())

    def handle_data(self, data):
        if self.open:
            self.rows[self.open[-1]]["own"].append(data)
            self.pieces.append(data)

    def _close(self, tag, stop):
        for k in range(len(self.open) - 1, -1, -1):
            name = self.rows[self.open[k]]["tag"]
            if name == tag:
                for i in self.open[k:]:
                    self.rows[i]["to"] = len(self.pieces)
                del self.open[k:]
                return
            if name in stop:
                return


def _ignored(tag: str, a: dict) -> bool:
    cls, label, test = a.get("class", "").lower(), a.get("aria-label", "").lower(), a.get("data-testid", "").lower()
    return (
        tag in IGNORED_TAGS
        or a.get("role") in IGNORED_ROLES
        or bool(cls) and bool(IGNORED_CLASSES.intersection(a["class"].split()))
        or a.get("id") in IGNORED_IDS
        or "history" in test
        or "history" in cls
        or bool(label) and any(w in label for w in ("history", "breadcrumb", "logo", "sign in with google"))
        or "gsi" in cls
        or "gsi" in a.get("id", "").lower()
    )


def _hidden(a: dict) -> bool:
    if "style" not in a:
        return False
    style = a["style"].replace(" ", "").lower()
    return "display:none" in style or "visibility:hidden" in style or style.rstrip(";").endswith("opacity:0")


def _chip(tag: str, a: dict) -> bool:
    return (
        "gsi" in a.get("class", "").lower()
        or "sign in with google" in a.get("aria-label", "").lower()
        or (tag == "iframe" and "google" in a.get("src", ""))
    )


def _marked(a: dict, name: str, test: str, value: str) -> bool:
    have = a.get(name)
    if have is None:
        return False
    if test == "word":
        return value in have.split()
    return {"any": True, "is": have == value, "same": have.lower() == value, "has": value in have.lower()}[test]


def _by_name(marks: list[tuple[str, str, str]]) -> dict[str, list[tuple[str, str, str]]]:
    return {name: [m for m in marks if m[0] == name] for name, _, _ in marks}


_ASSISTANT, _HISTORY, _COMPOSER = _by_name(ASSISTANT_MARKS), _by_name(HISTORY_MARKS), _by_name(COMPOSER_MARKS)


def _any_mark(a: dict, marks: dict[str, list[tuple[str, str, str]]]) -> bool:
    return not marks.keys().isdisjoint(a) and any(_marked(a, *m) for name in a if name in marks for m in marks[name])


def _composer(tag: str, a: dict, boxed: bool) -> bool:
    if not a:
        return boxed and tag == "textarea"
    editable, hint = a.get("contenteditable") == "true", a.get("placeholder", "").lower()
    return (
        _any_mark(a, _COMPOSER)
        or tag == "div" and ("rich-textarea" in a.get("class", "").split() or editable and ("ask" in a.get("data-placeholder", "").lower() or a.get("role") == "textbox"))
        or tag == "textarea" and ("data-id" in a or any(w in hint for w in COMPOSER_HINTS))
        or boxed and (tag == "textarea" or editable)
    )


def _provenance(r: dict) -> str:
    """Whose text an element holds: what a user writes, or what the page shows."""
    a, free = r["attrs"], "readonly" not in r["attrs"] and "disabled" not in r["attrs"]
    if r["answer"]:
        mine = False
    elif r["tag"] == "textarea":
        mine = free
    elif r["tag"] == "input":
        mine = free and a.get("type", "text").lower() not in NON_TEXT_INPUTS
    else:
        mine = r["editable"] and (r["composer"] or not r["past"]) or r["composer"]
    return USER_INPUT if mine and (r["composer"] or not r["past"]) else WEBPAGE_CONTENT


def _parse(html: str | None) -> list[dict]:
    """All elements of a page.  An element covers the places ``idx`` to ``last`` and the text pieces ``from`` to ``to``,
    so whole texts are put together only where they are needed, and nothing is stored for every ancestor."""
    tree = _Tree()
    if html:
        tree.feed(html)
        tree.close()
    rows, pieces = tree.rows, tree.pieces
    body = any(r["tag"] == "body" for r in rows)
    heads = [r["idx"] for r in rows if r["tag"] in _HEADINGS or r["attrs"].get("role") == "heading"]
    by_id: dict[str, int] = {}
    by_for: dict[str, int] = {}
    for r in rows:
        if r["attrs"].get("id"):
            by_id.setdefault(r["attrs"]["id"], r["idx"])
        if r["tag"] == "label" and "for" in r["attrs"]:
            by_for.setdefault(r["attrs"]["for"], r["idx"])
    for r in reversed(rows):
        r["last"] = max(r["idx"], r.get("last", 0))
        if r["parent"] >= 0:
            up = rows[r["parent"]]
            up["last"] = max(up.get("last", 0), r["last"])
        if not body:
            r["level"] = r["depth"]

    def whole(i: int) -> str:
        r = rows[i]
        return "" if r["tag"] in _VOID else "".join(pieces[r["from"] : r.get("to", len(pieces))])

    for r in rows:
        a, parent = r["attrs"], r["parent"]
        up = rows[parent] if parent >= 0 else None
        # the nearest form, and the first heading within the nearest ancestor that has one
        r["form"] = -1 if up is None else parent if up["tag"] == "form" else up["form"]
        r["head"], r["head_steps"] = -1, 0
        if up is not None:
            at = bisect_right(heads, parent)
            if at < len(heads) and heads[at] <= up["last"]:
                r["head"], r["head_steps"] = heads[at], 1
            elif up["head"] >= 0:
                r["head"], r["head_steps"] = up["head"], up["head_steps"] + 1
        ref, label = by_id.get(a.get("aria-labelledby") or ""), by_for.get(a["id"]) if a.get("id") else None
        owner = (
            r["tag"] in _TEXT_OWNERS or r["children"] == 0 or a.get("role") in ("button", "heading")
            or a.get("contenteditable", "no") in ("", "true")
        )
        full = whole(r["idx"]) if owner else None
        own = full.strip() if r["tag"] in ("code", "pre") else "".join(r["own"]).strip()
        r["text"] = own or (full.strip() if r["children"] == 0 else "")
        r["full_text"] = full
        r["by_ref"] = None if ref is None else whole(ref)
        r["by_for"] = None if label is None else whole(label)
        r["provenance"] = _provenance(r)
    return rows


_TYPES = {
    **dict.fromkeys(("idx", "parent", "depth", "nth", "children", "level", "last", "form", "head", "head_steps"), pa.int32()),
    **dict.fromkeys(("ignored", "hidden", "chip", "editable", "skipped"), pa.bool_()),
}


def _lists(pages: list[list[dict]]) -> pa.Array:
    """The elements of some pages as one array of lists, built column by column."""
    rows = [r for page in pages for r in page]
    columns = []
    for name in _FIELDS:
        values = [r[name] for r in rows]
        if name == "attrs":
            at = pa.array([0, *accumulate(map(len, values))], pa.int32())
            keys = pa.array([k for a in values for k in a], pa.string())
            columns.append(pa.MapArray.from_arrays(at, keys, pa.array([v for a in values for v in a.values()], pa.string())))
        else:
            columns.append(pa.array(values, _TYPES.get(name, pa.string())))
    at = pa.array([0, *accumulate(map(len, pages))], pa.int32())
    return pa.ListArray.from_arrays(at, pa.StructArray.from_arrays(columns, _FIELDS))


def _parse_batches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for htmls in batches:
        some, size = [], 0
        for html in htmls:
            html = html.as_py()
            some.append(_parse(html))
            size += len(html or "")
            if size >= CHUNK:
                yield _lists(some)
                some, size = [], 0
        if some:
            yield _lists(some)


def with_elements(pages: DataFrame, html: str = "html", out: str = "elements") -> DataFrame:
    """Array of the elements of each page, in document order.  Pages are dealt over all tasks and parsed one by one."""
    parse = F.arrow_udf(_parse_batches, f"array<{ELEMENT}>")
    return dealt(pages).withColumn(out, parse(html))


def elements(pages: DataFrame, keys: list[str], html: str = "html") -> DataFrame:
    """One row per element, as the parser hands them over: no arrays of elements are built and taken apart again."""
    asked = pages.select(*keys, html)
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in asked.schema.fields[: len(keys)])
    return dealt(asked).mapInArrow(_element_batches, f"{types}, {ELEMENT.removeprefix('struct<').removesuffix('>').replace(':', ' ')}")


def _element_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys and html to one row per element, some pages at a time; the html is the last column."""
    for batch in batches:
        keys, names = batch.columns[:-1], batch.schema.names[:-1]
        some, first, size = [], 0, 0
        for n, html in enumerate(batch.column(len(keys)), 1):
            html = html.as_py()
            some.append(_parse(html))
            size += len(html or "")
            if size >= CHUNK or n == batch.num_rows:
                rows = _lists(some).values
                at = pa.array([first + i for i, page in enumerate(some) for _ in page], pa.int64())
                yield pa.RecordBatch.from_arrays([*(key.take(at) for key in keys), *rows.flatten()], [*names, *_FIELDS])
                some, first, size = [], n, 0


def attr(name: str, attrs: Column | None = None) -> Column:
    return (F.col("attrs") if attrs is None else attrs)[name]


def enabled(els: DataFrame) -> Column:
    return ~F.col("hidden") & attr("disabled").isNull() & (F.coalesce(attr("aria-disabled"), F.lit("")) != "true")


def scannable(els: DataFrame) -> DataFrame:
    """Inputs, text areas, editables and content text of at least six characters, with their text.

    Adds ``is_input`` and ``input_type``; ``text`` becomes the value for inputs.
    """
    kind = F.lower(F.coalesce(attr("type"), F.lit("text")))
    is_field = (F.col("tag") == "input") & ~kind.isin(NON_TEXT_INPUTS)
    is_area = F.col("tag") == "textarea"
    is_edit = F.coalesce(attr("contenteditable").isin("", "true"), F.lit(False))
    content = F.col("tag").isin(TEXT_TAGS) & ~F.col("ignored") & (F.length("text") >= 6)
    rows = els.filter(enabled(els) & (is_field | is_area | is_edit | content))
    return (
        rows.withColumn("is_input", is_field | is_area | is_edit)
        .withColumn(
            "input_type",
            F.when(is_field, kind).when(is_area, F.lit("textarea")).when(is_edit, F.lit("contenteditable")),
        )
        .withColumn(
            "text",
            F.when(is_field, F.coalesce(attr("value"), F.lit(""))).when(is_area, F.col("full_text"))
            .when(is_edit, F.col("full_text")).otherwise(F.col("text")),
        )
    )


def selector(els: DataFrame) -> Column:
    """Short selector: id, else tag with name or role, else the path."""
    tag = F.col("tag")
    return (
        F.when(F.coalesce(attr("id"), F.lit("")) != "", F.concat(F.lit("#"), attr("id")))
        .when(F.coalesce(attr("name"), F.lit("")) != "", F.concat(tag, F.lit('[name="'), attr("name"), F.lit('"]')))
        .when(F.coalesce(attr("role"), F.lit("")) != "", F.concat(tag, F.lit('[role="'), attr("role"), F.lit('"]')))
        .otherwise(F.col("path"))
    )


def password_field() -> Column:
    auto = F.lower(F.coalesce(attr("autocomplete"), F.lit("")))
    name = F.coalesce(F.when(attr("name") != "", attr("name")), attr("id"), F.lit(""))
    low = F.lower(name)
    return (F.col("tag") == "input") & (
        (F.lower(F.coalesce(attr("type"), F.lit(""))) == "password")
        | auto.contains("password")
        | low.contains("password")
        | low.isin("pass", "pwd")
    )


def name_field() -> Column:
    cond = F.lit(False)
    for a in ("name", "id", "autocomplete", "placeholder", "aria-label"):
        low = F.lower(F.coalesce(attr(a), F.lit("")))
        for hint in NAME_HINTS:
            cond = cond | low.contains(hint)
    return cond


def detect_fields(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Detections that follow from the field itself: password, e-mail and name inputs."""
    from hushlake.functions.checks import allowlisted

    filled = (F.col("text") != "") & ~allowlisted(F.col("text"))
    is_pw = F.col("is_input") & password_field()
    email = (F.col("input_type") == "email") | F.coalesce(attr("autocomplete").contains("email"), F.lit(False))
    found = F.array(
        F.when(is_pw, _field("PASSWORD", F.when(F.col("text") == "", F.lit("••••••••")).otherwise(F.col("text")), 1.0)),
        F.when(F.col("is_input") & ~is_pw & email & filled, _field("EMAIL", F.col("text"), 0.98)),
        F.when(F.col("is_input") & ~is_pw & name_field() & filled, _field("NAME", F.col("text"), 0.88)),
    )
    # An allowlisted password value is dropped like any other, the mask never is.
    f = F.col("f")
    rows = nodes.select(*keys, selector(nodes).alias("selector"), F.explode(F.array_compact(found)).alias("f"))
    keep = (f["value"] == "••••••••") | ~allowlisted(f["value"])
    return rows.filter(keep).select(*keys, "selector", f["type"].alias("type"), f["value"].alias("value"), f["confidence"].alias("confidence"))


def _field(type_: str, value: Column, confidence: float) -> Column:
    return F.struct(F.lit(type_).alias("type"), value.alias("value"), F.lit(confidence).alias("confidence"))


def role(tag: Column) -> Column:
    kind = F.lower(F.coalesce(attr("type"), F.lit("text")))
    return (
        F.when(F.coalesce(attr("role"), F.lit("")) != "", F.lower(attr("role")))
        .when(tag == "button", "button")
        .when((tag == "a") & attr("href").isNotNull(), "link")
        .when(tag == "textarea", "textbox")
        .when(tag == "form", "form")
        .when(tag == "select", "combobox")
        .when((tag == "input") & kind.isin("button", "submit", "reset"), "button")
        .when((tag == "input") & kind.isin("checkbox", "radio"), kind)
        .when((tag == "input") & (kind == "search"), "searchbox")
        .when(tag == "input", "textbox")
        .otherwise("generic")
    )


def with_labels(els: DataFrame, page: str) -> DataFrame:
    """Accessible label: aria-label, labelled-by element, label-for element, placeholder, title, own text.

    The texts an element refers to come with it from the parser, so this is row-local.  Labels are whole; cut them
    only after they have been sanitized.
    """

    def given(c: Column) -> Column:
        return F.when(c != "", c)

    own = F.when(F.col("tag").isin("button", "a"), F.col("full_text"))
    label = F.coalesce(
        given(attr("aria-label")), given(F.col("by_ref")), given(F.col("by_for")), given(attr("placeholder")),
        given(attr("title")), given(own), F.lit(""),
    )
    return els.withColumn("label", collapse_spaces(trim_spaces(label)))


def interactive(els: DataFrame, page: str) -> DataFrame:
    """Interactive elements with role, label (not yet sanitized) and selector."""
    labelled = with_labels(els, page).withColumn("role", role(F.col("tag")))
    hidden = (F.coalesce(attr("aria-hidden"), F.lit("")) == "true") | attr("hidden").isNotNull()
    wanted = F.col("role").isin(INTERACTIVE_ROLES) | F.col("tag").isin(INTERACTIVE_TAGS)
    return labelled.filter(wanted & ~hidden).select(
        page, "idx", "path", "tag", "role", "label", selector(labelled).alias("selector")
    )


def region_labels(els: DataFrame, page: str, limit: int | None = None, ancestors: int | None = None) -> DataFrame:
    """Human-readable place of an element: its label, its own attributes, its form, nearest heading, tag, page title.

    A heading is looked for in the nearest ``ancestors`` (all by default) that contain one; labels are cut to
    ``limit`` characters if one is given.
    """
    near = F.lit(True) if ancestors is None else F.col("head_steps") <= ancestors
    forms = els.filter(F.col("tag") == "form").groupBy(page, F.col("idx").alias("form")).agg(
        F.first(F.coalesce(attr("aria-label"), attr("id"), F.lit(""))).alias("__form")
    )
    heads = els.filter(
        F.col("tag").isin(*sorted(_HEADINGS)) | (attr("role") == "heading")
    ).groupBy(page, F.col("idx").alias("head")).agg(F.first("full_text").alias("__head"))
    titles = els.filter(F.col("tag") == "title").groupBy(page).agg(F.min_by("full_text", "idx").alias("__title"))
    out = els.join(forms, [page, "form"], "left").join(heads, [page, "head"], "left").join(titles, page, "left")
    out = out.withColumn("__head", F.when(near, F.col("__head")))

    def cut(c: Column) -> Column:
        return trim_spaces(c) if limit is None else trim_spaces(c).substr(1, limit)

    label = (
        F.when(F.coalesce(F.col("by_for"), F.lit("")) != "", cut(F.col("by_for")))
        .when(F.coalesce(attr("aria-label"), attr("placeholder"), F.lit("")) != "",
              cut(F.coalesce(attr("aria-label"), attr("placeholder"))))
        .when(F.col("__form") != "", F.col("__form"))
        .when(F.col("__form").isNotNull(), F.lit("Form Input"))
        .when(F.coalesce(F.col("__head"), F.lit("")) != "", cut(F.col("__head")))
        .when(F.col("tag") == "textarea", "Textarea")
        .when(F.col("tag") == "input", "Input Field")
        .when(F.col("tag").isin("code", "pre") | F.array_contains(F.split(F.coalesce(attr("class"), F.lit("")), " "), "code-block"), "Code Block")
        .when(F.coalesce(F.col("__title"), F.lit("")) != "", cut(F.col("__title")))
        .otherwise("Main Content")
    )
    return out.select(page, "idx", "tag", "path", label.alias("region"))


def _ancestors() -> Column:
    parts = F.split(F.expr("substring(path, 2)"), "/")
    ups = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))),
        lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, F.lit(1), n), "/")),
    )
    return F.when(F.size(parts) > 1, ups).otherwise(F.expr("cast(array() as array<string>)"))


def skeleton_lines(
    els: DataFrame, keys: list[str], max_level: int | None = None, max_button: int | None = None, max_leaf: int | None = None,
) -> DataFrame:
    """Structure of each page below its body: a line per kept element, and a closing line after a container's content.

    Values are replaced and texts sanitized, and only then cut to ``max_button`` or ``max_leaf``
    characters; elements deeper than ``max_level`` below the body are left out.  There is no limit by default.
    Lines of a page follow each other by ``at`` and ``step``.
    """
    from hushlake.functions.placeholders import name_placeholder
    from hushlake.operators.redact import sanitize_text

    tag = F.col("tag")
    button = tag.isin("button", "a")
    leaf = tag.isin(SKELETON_CONTAINERS) & (F.col("children") == 0) & (trim_spaces(F.col("full_text")) != "")
    deep = F.lit(True) if max_level is None else F.col("level") <= max_level
    kept = els.filter(
        deep & (F.col("level") >= 0) & ~F.col("skipped") & (tag.isin(SKELETON_INTERACTIVE) | (tag.isin(SKELETON_CONTAINERS) & ((F.col("children") > 0) | leaf)))
    )
    raw = F.when(button | leaf, trim_spaces(F.col("full_text")))
    clean = sanitize_text(kept.withColumn("__raw", raw), "__raw", "__clean")
    for which, limit in ((button, max_button), (leaf & ~button, max_leaf)):
        if limit is not None:
            clean = clean.withColumn("__clean", F.when(which, F.substring("__clean", 1, limit)).otherwise(F.col("__clean")))

    def part(name: str) -> Column:
        value = attr(name)
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f' {name}="'), value, F.lit('"'))).otherwise("")

    head = F.concat(F.lit("<"), tag, part("id"), F.when(tag.isin(SKELETON_INTERACTIVE), F.concat(part("type"), part("name"))).otherwise(""), part("role"))
    kind, name = F.coalesce(attr("type"), F.lit("")), F.lower(F.coalesce(attr("name"), F.lit("")))
    ident = F.lower(F.coalesce(attr("id"), F.lit("")))
    var = F.coalesce(F.when(attr("name") != "", attr("name")), attr("id"))
    mark = (
        F.when(kind.contains("password") | name.contains("pass"), F.lit(' data-placeholder="PASSWORD=YOUR_PASSWORD"'))
        .when(kind.contains("email") | name.contains("email"), F.lit(' data-placeholder="EMAIL=YOUR_EMAIL"'))
        .when(name.contains("key") | ident.contains("key"), F.concat(F.lit(' data-placeholder="'), name_placeholder(var), F.lit('"')))
        .otherwise("")
    )
    closed = F.concat(head, F.lit(">"), F.coalesce("__clean", F.lit("")), F.lit("</"), tag, F.lit(">"))
    line = (
        F.when(button, closed)
        .when(tag.isin(SKELETON_INTERACTIVE), F.concat(head, mark, F.lit(" />")))
        .when(leaf, closed)
        .otherwise(F.concat(head, F.lit(">")))
    )
    indent = F.expr("repeat('  ', level)")
    opening = F.struct(F.col("idx").alias("at"), F.lit(0).alias("step"), F.concat(indent, line).alias("line"))
    closing = F.struct(F.col("last").alias("at"), (F.lit(1_000_000) - F.col("level")).alias("step"), F.concat(indent, F.lit("</"), tag, F.lit(">")).alias("line"))
    both = F.when(tag.isin(SKELETON_CONTAINERS) & (F.col("children") > 0), F.array(opening, closing)).otherwise(F.array(opening))
    return clean.select(*keys, "idx", F.explode(both).alias("l")).select(*keys, "idx", "l.at", "l.step", "l.line")


def page_signals(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds the element signals of each page as the struct ``signals``; row-local, the elements are not exploded."""
    from hushlake.operators.context import SIGNALS

    parsed = with_elements(pages, html, "__els")
    return parsed.withColumn("signals", F.expr(_SIGNAL_SQL).cast(SIGNALS)).drop("__els")


def _a(name: str) -> str:
    return f"lower(coalesce(e.attrs['{name}'], ''))"


def _has(*pairs: tuple[str, str]) -> str:
    return "(" + " or ".join(f"contains({_a(n)}, '{v}')" for n, v in pairs) + ")"


_EDIT = "e.attrs['contenteditable'] = 'true'"
_BUTTONISH = "(e.tag = 'button' or (e.tag = 'input' and e.attrs['type'] = 'submit') or (e.tag = 'a' and e.attrs['role'] = 'button'))"
_BTN_TEXT = r"lower(trim(if(e.full_text != '', e.full_text, coalesce(e.attrs['value'], ''))))"
_BTN_MARK = "lower(concat(coalesce(e.attrs['id'], ''), ' ', coalesce(e.attrs['class'], '')))"
# Wording of buttons and headings on authentication pages.
_LOGIN = r"\\b(sign\\s*in|log\\s*in|login|signin)\\b"
_SIGNUP = r"\\b(sign\\s*up|register|create\\s*(an\\s*)?account|join\\s*now)\\b"
_RESET = r"\\b(reset\\s*password|recover\\s*account|send\\s*otp|verify\\s*otp|verify\\s*code)\\b"
_HEADING = (
    r"\\b(sign\\s*in|log\\s*in|welcome\\s*back|create\\s*(your\\s*)?account|sign\\s*up|reset\\s*(your\\s*)?password"
    r"|forgot\\s*password|two[- ]factor\\s*authentication|2fa\\s*verification|enter\\s*verification\\s*code"
    r"|verify\\s*your\\s*identity|api\\s*keys?|personal\\s*access\\s*tokens?|manage\\s*credentials|api\\s*tokens?)\\b"
)
_ANY = "exists(__els, e -> {})"
_RULES = {
    "password_inputs": "size(filter(__els, e -> e.tag = 'input' and " + _a("type") + " = 'password'))",
    "user_input": "e.tag = 'input' and (" + _a("type") + " = 'email' or " + _has(
        ("autocomplete", "username"), ("autocomplete", "email"), ("name", "user"), ("name", "email"), ("id", "user"), ("id", "email")
    ) + ")",
    "otp_input": "e.tag = 'input' and " + _has(
        ("name", "otp"), ("autocomplete", "one-time-code"), ("id", "otp"), ("aria-label", "otp"), ("placeholder", "otp"),
        ("placeholder", "verification code"), ("placeholder", "passcode"),
    ),
    "auth_heading": f"(e.tag in ('h1', 'h2', 'h3', 'title') or e.attrs['role'] = 'heading') and lower(trim(e.full_text)) rlike '{_HEADING}'",
    "auth_form": "e.tag = 'form' and " + _has(
        ("action", "login"), ("action", "signin"), ("action", "auth"), ("id", "login"), ("id", "signin"), ("id", "signup"), ("class", "login")
    ),
    "composer": f"({_EDIT} and (" + _has(("aria-label", "message"), ("data-placeholder", "message")) + " or e.attrs['role'] = 'textbox'))"
    " or (e.tag = 'textarea' and " + _has(
        ("placeholder", "message"), ("placeholder", "chat"), ("aria-label", "message"), ("id", "chat"), ("name", "message"), ("id", "message")
    ) + ") or (e.tag = 'input' and " + _has(
        ("placeholder", "message"), ("placeholder", "chat"), ("name", "message"), ("id", "message"), ("id", "chat")
    ) + ") or " + _has(("data-testid", "chat-input")) + " or (e.tag = 'div' and (e.attrs['data-tab'] = '10' or e.attrs['data-slate-editor'] = 'true'))",
    "thread": "e.attrs['role'] = 'log' or " + _has(
        ("aria-label", "messages"), ("aria-label", "chat"), ("data-testid", "conversation"), ("data-testid", "chat"), ("data-testid", "message-list")
    ) + " or arrays_overlap(split(coalesce(e.attrs['class'], ''), ' '), array('messages-list', 'chat-messages', 'message-thread'))",
    "send_button": "(e.tag = 'button' or e.attrs['role'] = 'button' or (e.tag = 'input' and e.attrs['type'] = 'submit')) and ("
    + _a("aria-label") + " in ('send', 'send message') or lower(trim(e.full_text)) in ('send', 'send message') or "
    + _a("id") + " = 'send-btn' or " + _has(("id", "send-button"), ("class", "send-button"), ("data-testid", "send-button")) + ")",
    "editable": _EDIT,
    "feed": "(e.tag = 'div' and e.attrs['role'] = 'feed') or " + _has(("aria-label", "timeline"), ("aria-label", "feed")),
    "post": _has(("data-testid", "tweet"), ("data-testid", "post")),
    "interaction": _has(("data-testid", "retweet"), ("data-testid", "like")) + " or (e.tag = 'button' and " + _has(("aria-label", "repost"), ("aria-label", "retweet")) + ")",
    "ai_composer": f"e.attrs['id'] = 'prompt-textarea' or (e.tag = 'div' and (array_contains(split(coalesce(e.attrs['class'], ''), ' '), 'rich-textarea') or {_EDIT})) or e.tag = 'textarea'",
    "ai_send": "e.tag = 'button' and (e.attrs['data-testid'] = 'send-button' or " + _has(("aria-label", "send")) + " or array_contains(split(coalesce(e.attrs['class'], ''), ' '), 'send-button'))",
}
_BUTTON_SQL = (
    "get(filter(transform(filter(__els, e -> " + _BUTTONISH + "), e -> case"
    f" when {_BTN_TEXT} rlike '{_LOGIN}' or {_BTN_MARK} rlike 'login|signin' then 'login'"
    f" when {_BTN_TEXT} rlike '{_SIGNUP}' or {_BTN_MARK} rlike 'signup|register' then 'signup'"
    f" when {_BTN_TEXT} rlike '{_RESET}' then 'reset' end), b -> b is not null), 0)"
)


def _signal_sql() -> str:
    from hushlake.operators.context import DOM_FLAGS

    parts = []
    for f in DOM_FLAGS:
        if f == "password_inputs":
            expr = _RULES[f]
        elif f == "auth_button":
            expr = _BUTTON_SQL
        else:
            expr = f"cast(coalesce(exists(__els, e -> {_RULES[f]}), false) as int)"
        parts.append(f"'{f}', {expr}")
    return "named_struct(" + ", ".join(parts) + ")"


_SIGNAL_SQL = _signal_sql()


def detect_nodes(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """All detections of scannable nodes: field rules, then patterns on every text; password inputs are not scanned."""
    fields = detect_fields(nodes, keys).withColumn("method", F.lit("dom"))
    is_pw = F.col("is_input") & password_field()
    open_text = nodes.filter(~is_pw & ~(~F.col("is_input") & F.col("chip"))).select(
        *keys, selector(nodes).alias("selector"), "text"
    )
    s = F.col("s")
    found = with_spans(open_text, "text").select(*keys, "selector", F.explode_outer("spans").alias("s"))
    patterns = found.filter(s.isNotNull()).select(
        *keys, "selector", s["type"].alias("type"), s["value"].alias("value"), s["confidence"].alias("confidence"),
        F.lit("regex").alias("method"),
    )
    return fields.unionByName(patterns)


def page_items(nodes: DataFrame, page: str) -> DataFrame:
    """Detections of scannable nodes as complete items, row by row; nothing is shuffled.

    page, item_id, path, selector, ord, type, value, confidence, method, variable, placeholder, provenance.  Field rules come
    first and name their own variable; a pattern's match takes the name its line assigns it to, else the field's name
    or id.  A node gives an item of one type and value once.  item_id is a hash of page, path, type and value: the
    same detection has the same id in every scan.
    """
    from hushlake.functions import placeholders as P
    from hushlake.functions.checks import allowlisted
    from hushlake.functions.text import let, match_line, once

    is_pw = F.col("is_input") & password_field()
    text, filled = F.col("text"), (F.col("text") != "") & ~allowlisted(F.col("text"))
    email = (F.col("input_type") == "email") | F.coalesce(attr("autocomplete").contains("email"), F.lit(False))

    def item(type_: Column, value: Column, confidence: Column, method: str, variable: Column) -> Column:
        return F.struct(type_.alias("type"), value.alias("value"), confidence.alias("confidence"), F.lit(method).alias("method"), variable.alias("variable"))

    def field(name: str, value: Column, confidence: float) -> Column:
        return item(F.lit(name), value, F.lit(confidence), "dom", F.lit(name))

    shown = F.when(text == "", F.lit("••••••••")).otherwise(text)
    fields = F.array_compact(F.array(
        F.when(is_pw & ((text == "") | ~allowlisted(text)), field("PASSWORD", shown, 1.0)),
        F.when(F.col("is_input") & ~is_pw & email & filled, field("EMAIL", text, 0.98)),
        F.when(F.col("is_input") & ~is_pw & name_field() & filled, field("NAME", text, 0.88)),
    ))
    own = F.when(F.col("is_input"), F.coalesce(F.when(attr("name") != "", attr("name")), F.when(attr("id") != "", attr("id"))))
    scanned = nodes.withColumn("selector", selector(nodes)).withColumn("__fields", fields).withColumn("__own", own)
    scanned = scanned.withColumn("__scan", F.when(~is_pw & ~(~F.col("is_input") & F.col("chip")), text))
    found = with_spans(scanned, "__scan", "__spans")
    matches = F.transform(
        F.coalesce("__spans", F.expr("array()")),
        lambda s: item(s["type"], s["value"], s["confidence"], "regex", F.coalesce(P.variable_name(match_line(text, s["value"]), s["value"]), F.col("__own"))),
    )
    both = F.when(F.size("__spans") > 0, F.concat("__fields", matches)).otherwise(F.col("__fields"))
    keys = F.transform("__all", lambda i: F.struct(i["type"], i["value"]))
    first = let(keys, lambda k: F.filter("__all", lambda i, at: F.array_position(k, F.struct(i["type"], i["value"])) == at + 1))
    rows = found.withColumn("__all", once(both)).select(
        page, "idx", "path", "selector", "provenance", F.posexplode(F.filter(first, lambda i: i["confidence"] >= 0.6)).alias("at", "i"),
    )
    i = F.col("i")
    ident = F.md5(F.concat_ws("|", F.col(page).cast("string"), "path", i["type"], i["value"]))
    return rows.select(
        page, F.concat(F.lit("hl-"), F.substring(ident, 1, 16)).alias("item_id"), "path", "selector",
        (F.col("idx").cast("long") * 1_000_000 + F.col("at")).alias("ord"), i["type"].alias("type"), i["value"].alias("value"),
        i["confidence"].cast("double").alias("confidence"), i["method"].alias("method"), i["variable"].alias("variable"),
        P.full_placeholder(i["type"], i["variable"]).alias("placeholder"), "provenance",
    )


def page_scan(pages: DataFrame, page: str, html: str = "html") -> DataFrame:
    """A page's final items: elements, detection, first of each (type, selector, value), better matches win."""
    from hushlake.operators.dedupe import drop_dominated, first_of_each
    from hushlake.sources.scratch import stored

    items = page_items(scannable(elements(pages, [page], html)), page)
    return drop_dominated(stored(first_of_each(items, [page, "type", "selector", "value"], ["ord"])), page)  # pages are scanned once


def rescan_roots(els: DataFrame, changed: DataFrame, page: str) -> DataFrame:
    """Elements that lie at or under a changed root (an equi-join on the expanded ancestor paths)."""
    paths = els.select("*", F.explode(F.array_append(_ancestors(), F.col("path"))).alias("__root"))
    roots = changed.select(page, F.col("root").alias("__root")).distinct()
    hit = paths.join(roots, [page, "__root"], "left_semi").select(page, "idx").distinct()
    return els.join(hit, [page, "idx"], "left_semi")



def is_field(els: DataFrame) -> Column:
    """Elements whose stored text a user writes."""
    return (F.col("provenance") == USER_INPUT) & (F.col("tag").isin("input", "textarea") | F.col("editable"))


def stored_fields(els: DataFrame) -> DataFrame:
    """Fields with their stored text: the value of an input, the whole text of others."""
    value = F.when(F.col("tag") == "input", F.coalesce(attr("value"), F.lit(""))).otherwise(F.coalesce("full_text", F.col("text")))
    return els.filter(is_field(els)).withColumn("text", value)


def redact_fields(fields: DataFrame, items: DataFrame, page: str) -> DataFrame:
    """Stored fields with the values of ``items`` replaced: page, idx, path, text, items (how many were applied).

    ``items`` has page, path, ord, type, value and placeholder, and may have variable and provenance.  An item counts for
    the field at its path, and only if its provenance is a user's input or unknown; text that the page shows is never
    touched, whatever the items say.  Passwords in inputs stay as they are.  The longest values come first;
    a line that assigns the value to a name keeps the name, or the item's own variable.  An
    empty field gets the first item's placeholder.  Fields without items are not in the result.
    """
    from hushlake.operators.redact import replace_values

    have = items.columns
    variable = F.col("variable") if "variable" in have else F.lit(None).cast("string")
    theirs = F.coalesce(F.col("provenance"), F.lit(USER_INPUT)) if "provenance" in have else F.lit(USER_INPUT)
    one = F.struct(
        "ord", (-F.length("value")).alias("neg_len"), "type", "value", variable.alias("variable"), F.col("placeholder").alias("mark"),
    )
    per_field = items.filter((theirs == USER_INPUT) & F.col("path").isNotNull()).groupBy(page, "path").agg(F.array_sort(F.collect_list(one)).alias("__items"))
    met = fields.join(per_field, [page, "path"]).withColumn(
        "__items", F.when(F.col("tag").isin("input", "textarea"), F.filter("__items", lambda i: i["type"] != "PASSWORD")).otherwise(F.col("__items"))
    ).filter(F.size("__items") > 0)
    text = F.when(F.col("text") == "", F.get("__items", F.lit(0))["mark"]).otherwise(replace_values(F.col("text"), F.col("__items"), named=True))
    return met.select(page, "idx", "path", text.alias("text"), F.size("__items").cast("long").alias("items"))
