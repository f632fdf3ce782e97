"""Readers of pages that name several people, as table functions: one page in, one row out for each field, relative and picture.

``register`` names them ``memorial_rows`` and ``record_rows`` for SQL's LATERAL; ``memorials`` and ``records`` apply them to a table of
pages. A page is read by the task that holds it; a null or empty one gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf

from .pages import _VOID

#: The elements of a memorial page, by id, and the labels of what they hold.
MEMORIAL = {
    "bio-name": "Name", "birthDateLabel": "Birth Date", "birthLocationLabel": "Birth Place", "deathDateLabel": "Death Date", "deathLocationLabel": "Death Place",
    "plotValueLabel": "Plot", "inscriptionValue": "Inscription", "fullBio": "Biography", "memNumberLabel": "Memorial ID",
}
#: The parts of a burial place, from the smallest up.
CEMETERY = ("cemeteryNameLabel", "cemeteryCityName", "cemeteryCountyName", "cemeteryStateName", "cemeteryCountryName")

ROWS = "kind string, n int, section string, label string, value string, name string, role string, birth string, death string, url string"

_HIDES = re.compile(r"display:\s*none", re.I)
_NO_TEXT = {"script", "style", "template", "noscript"}
_APART = {"br", "p", "div", "td", "th", "li", "tr"}
#: An open element of the first kind ends where one of the second begins.
_ENDS = {"li": {"li"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "p": {"p", "table", "ul", "h1", "h2", "h3"}, "option": {"option"}}


class Element:
    __slots__ = ("attrs", "items", "tag")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.items = tag, attrs, []

    def elements(self) -> list[Element]:
        """This element and all below it, in page order; no recursion, so depth costs no stack."""
        out, todo = [], [self]
        while todo:
            e = todo.pop()
            out.append(e)
            if e.items:
                todo += [x for x in reversed(e.items) if x.__class__ is Element]
        return out

    def first(self, fits) -> Element | None:
        return next((e for e in self.elements() if fits(e)), None)

    def text(self, skip=lambda e: False) -> str:
        """Visible text in one line; ``skip`` leaves further elements out."""
        out, todo = [], [self]
        while todo:
            x = todo.pop()
            if x.__class__ is str:
                out.append(x)
            elif x.tag not in _NO_TEXT and (x is self or not skip(x)):
                todo += reversed(x.items)
                if x.tag in _APART:
                    todo.append(" ")
        return " ".join("".join(out).split())

    def hidden(self) -> bool:
        return bool(self.attrs) and bool(_HIDES.search(self.attrs.get("style") or ""))

    def has_class(self, name: str) -> bool:
        return name in (self.attrs.get("class") or "").split()


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Element("", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        while len(self.open) > 1 and tag in _ENDS.get(self.open[-1].tag, ()):
            self.open.pop()
        e = Element(tag, {k: v or "" for k, v in attrs})
        self.open[-1].items.append(e)
        if tag not in _VOID:
            self.open.append(e)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].items.append(Element(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return
            if self.open[k].tag == "table" and tag in ("tr", "td", "th"):
                return  # an end tag never closes a row of an outer table

    def handle_data(self, data):
        self.open[-1].items.append(data)


#: Plain pages: text, end tags and start tags with attributes without references or angle brackets. Anything else, and elements whose content is no markup, is left to ``_Builder``.
_PLAIN = re.compile(r"""([^<]+)|</([a-zA-Z][a-zA-Z0-9]*)[ \t\n\r\f]*>|<([a-zA-Z][a-zA-Z0-9]*)((?:[ \t\n\r\f]+[a-zA-Z][a-zA-Z0-9-]*(?:=(?:"[^"<>&\0]*"|'[^'<>&\0]*'|[a-zA-Z0-9_.:#-]+))?)*)[ \t\n\r\f]*>""")
_ATTRIBUTE = re.compile(r"""([a-zA-Z][a-zA-Z0-9-]*)(?:=(?:"([^"]*)"|'([^']*)'|([a-zA-Z0-9_.:#-]+)))?""")
_RAW = {"script", "style", "title", "textarea", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


def _parse_plain(html: str) -> Element | None:
    """What ``_Builder`` makes of a plain page, by one expression; null for any other page."""
    root = Element("", {})
    stack, items, at = [root], root.items, 0
    for m in _PLAIN.finditer(html):
        if m.start() != at:
            return None
        at = m.end()
        kind = m.lastindex
        if kind == 1:
            text = m[1]
            items.append(unescape(text) if "&" in text else text)
        elif kind == 2:
            tag = m[2].lower()
            for k in range(len(stack) - 1, 0, -1):
                name = stack[k].tag
                if name == tag:
                    del stack[k:]
                    break
                if name == "table" and tag in ("tr", "td", "th"):
                    break
            items = stack[-1].items
        else:
            tag = m[3].lower()
            if tag in _RAW:
                return None
            while len(stack) > 1 and tag in _ENDS.get(stack[-1].tag, ()):
                stack.pop()
            e = Element(tag, {k.lower(): x or y or z for k, x, y, z in _ATTRIBUTE.findall(m[4])} if m[4] else {})
            stack[-1].items.append(e)
            if tag not in _VOID:
                stack.append(e)
            items = stack[-1].items
    return root if at == len(html) else None


def parse(html: str | None) -> Element:
    html = html or ""
    if (root := _parse_plain(html)) is not None:
        return root
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def _row(kind: str, n: int | None = None, **held: str | None) -> tuple:
    return (kind, n, *((held.get(c) or None) for c in ("section", "label", "value", "name", "role", "birth", "death", "url")))


def memorial(html: str | None) -> Iterator[tuple]:
    """Rows of a memorial page: field (label, value), member (section, name, role: a birth surname, birth, death, url), source and picture."""
    root = parse(html)
    ids = {}
    for e in root.elements():
        if e.attrs.get("id"):
            ids.setdefault(e.attrs["id"], e)
    badge = lambda e: e.has_class("badge")
    at = lambda i: ids[i].text(badge) if i in ids else ""
    held = [(label, at(i)) for i, label in MEMORIAL.items()]
    held.insert(5, ("Burial Place", ", ".join(x for x in map(at, CEMETERY) if x)))
    for n, (label, value) in enumerate((x for x in held if x[1]), 1):
        yield _row("field", n, label=label, value=value)
    n = 0
    for ul in root.elements():
        if ul.tag != "ul" or "member-family" not in (ul.attrs.get("class") or ""):
            continue
        section = at(ul.attrs.get("aria-labelledby")) or "Family"
        for li in (x for x in ul.items if isinstance(x, Element) and x.tag == "li"):
            head = li.first(lambda e: e.tag == "h3")
            if head is None:
                continue
            n += 1
            link = li.first(lambda e: e.tag == "a" and e.attrs.get("href"))
            maiden = head.first(lambda e: e.tag == "i")
            said = lambda prop: (li.first(lambda e: e.attrs.get("itemprop") == prop) or Element("", {})).text()  # noqa: B023, E731
            yield _row("member", n, section=section, name=head.text(badge), role=maiden.text() if maiden else None, birth=said("birthDate"), death=said("deathDate"), url=link.attrs["href"] if link else None)
    for n, li in enumerate((x for x in (ids["source"].items if "source" in ids else ()) if isinstance(x, Element) and x.tag == "li"), 1):
        line = li.text()
        label = "citation" if "citation" in (li.attrs.get("class") or "") else "created" if line.startswith("Created by") else "added" if line.startswith("Added") else None
        if label:
            yield _row("source", n, label=label, value=re.sub(r"^Source (Hide|Show) citation ", "", line))
    for n, e in enumerate((x for x in root.elements() if x.has_class("viewer-item") and x.attrs.get("data-photo-id")), 1):
        img = e.first(lambda x: x.tag == "img")
        caption = e.first(lambda x: "photo-text" in (x.attrs.get("class") or "") and x.text())
        kind = re.search(r"Photo type:\s*(\w+)", e.text())
        yield _row("picture", n, label=kind[1] if kind else None, value=caption.text() if caption else None, url=(img.attrs.get("data-src") or img.attrs.get("src")) if img else None)


def _table_rows(table: Element) -> list[list[Element]]:
    """Cells of a table's own rows, not of a table inside it."""
    out, todo = [], [x for x in reversed(table.items) if isinstance(x, Element)]
    while todo:
        e = todo.pop()
        if e.tag == "tr":
            out.append([x for x in e.items if isinstance(x, Element) and x.tag in ("td", "th")])
        elif e.tag in ("thead", "tbody", "tfoot"):
            todo.extend(x for x in reversed(e.items) if isinstance(x, Element))
    return out


def _kept_below(cell: Element) -> list[str]:
    """What a cell keeps in its hidden parts: the text of each outermost element there that has text of its own."""
    out, todo = [], [(x, False) for x in reversed(cell.items) if isinstance(x, Element)]
    while todo:
        e, hidden = todo.pop()
        hidden = hidden or e.hidden()
        if hidden and any(isinstance(x, str) and x.strip() for x in e.items):
            out.append(e.text())
            continue
        todo.extend((x, hidden) for x in reversed(e.items) if isinstance(x, Element))
    return [x for x in out if x]


def _labelled(table: Element, kinds: tuple[str, str], n: int | None = None) -> Iterator[tuple]:
    for cells in _table_rows(table):
        if len(cells) >= 2 and cells[0].tag == "th" and (label := cells[0].text()):
            yield _row(kinds[0], n, label=label, value=cells[1].text(Element.hidden))
            for x in _kept_below(cells[1]):
                yield _row(kinds[1], n, label=label, value=x)


def record(html: str | None) -> Iterator[tuple]:
    """Rows of a record page: head (name, collection), document, field and alternate (label, value), and for each relative member (section,
    name, role, birth: a place, label: sex, value: age, url), member field and member alternate, all with the member's number.

    The page's own fields are its first table of labels and values before any heading but that of the citation; a table with rows of five cells lists relatives,
    and the row after a relative may hold a table of their fields. A value shown hides others that the field keeps: the alternates.
    """
    root = parse(html)
    main = root.first(lambda e: e.tag == "main") or root
    every = main.elements()
    title = next((e for e in every if e.tag == "h1"), None)
    heads = [e for e in every if e.tag == "h2"]
    banner = next((e for e in heads if e.text().startswith("Mentioned in the Record of")), None)
    if title is not None or heads:
        group = next((e.text() for e in heads if e is not banner), None)
        yield _row("head", name=title.text() if title else None, section=group)
    if banner is not None:
        link = banner.first(lambda e: e.tag == "a")
        yield _row("mentioned", name=link.text() if link else None, url=link.attrs.get("href") if link else None)
    section, own, n, inner = "", False, 0, set()
    for e in every:
        if e.tag == "h3":
            section = e.text()
        if e.tag != "table" or id(e) in inner:
            continue
        inner.update([id(x) for x in e.elements() if x.tag == "table"])
        rows = _table_rows(e)
        lists = any(len(r) >= 5 and r[0].tag == "th" for r in rows)
        if section.startswith("Document Information"):
            yield from _labelled(e, ("document", "document"))
        elif lists:
            for cells in rows:
                if len(cells) >= 5 and cells[0].tag == "th":
                    n += 1
                    link = cells[0].first(lambda x: x.tag == "a")
                    name = link.text() if link else cells[0].text()
                    role, rest = cells[0].text().replace(name, "", 1).strip(), cells[1:]
                    if not role and len(rest) >= 5:  # a column of its own for the relationship
                        role, rest = rest[0].text(), rest[1:]
                    said = lambda k: rest[k].text() if k < len(rest) else ""  # noqa: B023, E731
                    yield _row("member", n, section=section, name=name, role=role, label=said(0), value=said(1), birth=said(2), url=link.attrs.get("href") if link else None)
                elif len(cells) == 1 and n:
                    for x in cells[0].elements():
                        if x.tag == "table":
                            yield from _labelled(x, ("member field", "member alternate"), n)
        elif not own and (not section or section.startswith("Cite This Record")):
            found = list(_labelled(e, ("field", "alternate")))
            own = bool(found)
            yield from found


@udtf(returnType=ROWS)
class MemorialRows:
    def eval(self, html: str):
        yield from memorial(html)


@udtf(returnType=ROWS)
class RecordRows:
    def eval(self, html: str):
        yield from record(html)


def register(spark: SparkSession) -> None:
    spark.udtf.register("memorial_rows", MemorialRows)
    spark.udtf.register("record_rows", RecordRows)


#: Rows go back to Spark by so many pages.
PAGES = 500


def _applied(pages: DataFrame, read: Callable[[str | None], Iterator[tuple]]) -> DataFrame:
    """What the table function joined laterally gives, by batches of columns: a row each way through pickle costs more than reading it."""
    names = [x.split()[0] for x in ROWS.split(", ")]
    types = [pa.int32() if x.split()[1] == "int" else pa.string() for x in ROWS.split(", ")]

    def batches(them: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in them:
            for k in range(0, whole.num_rows, PAGES):
                b = whole.slice(k, PAGES)
                found = [(i, row) for i, html in enumerate(b.column(1).to_pylist()) for row in read(html)]
                if found:
                    at = pa.array([i for i, _ in found], pa.int32())
                    columns = [pa.array(x, t) for x, t in zip(zip(*(row for _, row in found), strict=True), types, strict=True)]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(at), *columns], ["page_id", *names])

    p = pages.select("page_id", "html")
    return p.mapInArrow(batches, f"page_id {p.schema['page_id'].dataType.simpleString()}, {ROWS}")


def memorials(pages: DataFrame) -> DataFrame:
    """(page_id, ROWS) of memorial pages (page_id, html); other columns are ignored, rows that repeat are read each."""
    return _applied(pages, memorial)


def records(pages: DataFrame) -> DataFrame:
    """(page_id, ROWS) of record pages (page_id, html)."""
    return _applied(pages, record)
