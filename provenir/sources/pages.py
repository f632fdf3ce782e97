"""HTML pages: kind, title, language, visible text, labelled table rows, links. The element walk uses the standard parser in tasks."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The elements without an end tag.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_HIDDEN = {"script", "style", "template", "noscript", "head"}


class _Page(HTMLParser):
    """Collects visible text, cells by row and link targets; ``display:none`` hides an element and all below it.

    Only counts of open elements are kept: ``inside`` of those from the hiding one on, ``around`` of those before it. Text shows
    again when the hiding element ends, or one around it does.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.hides: str | None = None
        self.inside, self.around = Counter(), Counter()
        self.in_title = False
        self.text: list[str] = []
        self.rows: list[list[str]] = []
        self.heads: list[bool] = []
        self.table_of: list[int] = []
        self.n_tables = 0
        self.cell: list[str] | None = None
        self.links: list[str] = []
        self.title, self.lang = "", None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "html":
            self.lang = a.get("lang")
        elif tag == "title":
            self.in_title = True
        elif tag == "a" and a.get("href"):
            self.links.append(a["href"])
        elif tag == "table":
            self.n_tables += 1
        elif tag == "tr":
            self._row()
        elif tag in ("td", "th"):
            self._end_cell()  # a cell that was left open ends here
            self.cell = []
            if self.rows:
                self.heads[-1] &= tag == "th"
        if tag in _VOID:
            return
        style = (a.get("style") or "").replace(" ", "").lower()
        if self.hides is None and (tag in _HIDDEN or "hidden" in a or "display:none" in style):
            self.hides, self.inside = tag, Counter()
        (self.around if self.hides is None else self.inside)[tag] += 1

    def _row(self):
        self._end_cell()
        self.rows.append([])
        self.heads.append(True)
        self.table_of.append(self.n_tables)

    def _end_cell(self):
        if self.cell is not None and self.rows:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
        self.cell = None

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._end_cell()
        self.in_title &= tag != "title"
        if self.hides is None:
            self.around[tag] -= self.around[tag] > 0
        elif self.inside[tag]:
            self.inside[tag] -= 1
            if tag == self.hides and not self.inside[tag]:
                self.hides = None
        elif self.around[tag]:
            self.around[tag] -= 1
            self.hides = None

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        if self.hides is None:
            self.text.append(data)
            if self.cell is not None:
                self.cell.append(data)


def _read(html: str | None) -> _Page:
    p = _Page()
    p.feed(html or "")
    p.close()
    p._end_cell()
    return p


SCHEMA = "page_id long, title string, lang string, text_length long, n_links long, host string, fields array<struct<label:string,value:string>>"


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, title, lang, text_length, n_links, host, fields); a page that is null or empty gives empty values."""

    def run(batches):
        for b in batches:
            out: dict[str, list] = {c: [] for c in ("page_id", "title", "lang", "text_length", "n_links", "host", "fields")}
            for i, html, host in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                p = _read(html)
                out["page_id"].append(i)
                out["title"].append(re.sub(r"\s+", " ", p.title).strip())
                out["lang"].append(p.lang)
                out["text_length"].append(len(" ".join("".join(p.text).split())))
                out["n_links"].append(len(p.links))
                out["host"].append(host)
                out["fields"].append([{"label": r[0].rstrip(":"), "value": r[1]} for r in p.rows if len(r) == 2])
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("label", pa.string()), ("value", pa.string())]))]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], list(out))

    return pages.select("page_id", "html", F.try_parse_url("url", F.lit("HOST"))).mapInArrow(run, SCHEMA)


def page_kind(html, markers: list[tuple[str, str]]):
    """Dispatch: the first kind whose marker the page has, else ``unknown``."""
    out = F.lit("unknown")
    for kind, pattern in reversed(markers):
        out = F.when(html.rlike(pattern), kind).otherwise(out)
    return out


LISTING = "page_id long, row int, cells map<string,string>"


def listings(pages: DataFrame) -> DataFrame:
    """(page_id, row, cells): the rows of tables that open with a row of headings alone, each as heading to value; row counts within the page.

    A row with another number of cells than its headings is none of the listing. Of equal headings the last counts. Pages without
    such a table give no rows; later rows of headings in one table replace the earlier ones.
    """

    def run(batches):
        kinds = [pa.int64(), pa.int32(), pa.map_(pa.string(), pa.string())]
        for b in batches:
            ids, at, cells = [], [], []
            for i, html in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p, names, table, n = _read(html), None, None, 0
                for row, head, k in zip(p.rows, p.heads, p.table_of, strict=True):
                    if k != table:
                        names, table = None, k
                    if head and row:
                        names = row
                    elif names and len(row) == len(names):
                        ids.append(i)
                        at.append(n)
                        cells.append(list(dict(zip(names, row, strict=True)).items()))
                        n += 1
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip((ids, at, cells), kinds, strict=True)], ["page_id", "row", "cells"])

    return pages.select("page_id", "html").mapInArrow(run, LISTING)
