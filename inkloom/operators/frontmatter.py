"""What a book says about itself: revision history, authors, legal notice, abstract and the info topics of its containers."""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.operators.markup import CONTAINERS, INFOS

#: Titles where a book gives none.
TITLES = {"Revision History": "Revision History", "Author Group": "Author Group", "Legal Notice": "Legal Notice", "Abstract": "Abstract"}
_OUT = "place int, kind string, spec_line string, title string, xml_id string, xml string"


class _Book:
    def __init__(self, root):
        self.root = root
        for e in root.iter():
            e.tag = e.tag.rpartition("}")[2]
        self.up = {c: p for p in root.iter() for c in p}

    def show(self, e, keep_id: bool = False) -> str:
        tail, e.tail, own = e.tail, None, e.attrib.pop("id", None)
        if keep_id and own is not None:
            e.attrib["id"] = own
        out = ElementTree.tostring(e, encoding="unicode")
        e.tail = tail
        if own is not None:
            e.attrib["id"] = own
        return out

    def drop(self, e) -> None:
        if (parent := self.up.get(e)) is not None:
            parent.remove(e)

    def title(self, e, default: str) -> str:
        t = e.find("title")
        return default if t is None else re.sub(r"^<title[^>]*>|</title>$", "", self.show(t, True)) if len(t) or t.text else default

    def history(self):
        """The first history with its box; the box goes wholly into it unless it holds other boxes."""
        h = next(self.root.iter("revhistory"), None)
        if h is None:
            return
        box = self.up.get(h)
        while box is not None and box.tag not in CONTAINERS:
            box = self.up.get(box)
        whole = box is not None and not any(e.tag in CONTAINERS for e in box.iter() if e is not box)
        title = self.title(box, TITLES["Revision History"]) if box is not None else TITLES["Revision History"]
        for d in h.iter("date"):
            text = "".join(d.itertext()).strip()
            d[:], d.text = [], text
        for n in h.iter("revnumber"):
            text = "".join(n.itertext())
            if re.fullmatch(r"\d+\.\d+", text.strip()):
                n[:], n.text = [], text.replace(".", "-")
        if whole:
            yield "revision_history", "Revision History = ", title, box.get("id"), self.show(box, True)
            self.drop(box)
        else:
            out = ElementTree.Element("appendix")
            ElementTree.SubElement(out, "title").text = title
            self.drop(h)
            h.tail = None
            out.append(h)
            yield "revision_history", "Revision History = ", title, None, self.show(out)

    def rows(self) -> Iterator[tuple]:
        yield from self.history()
        for kind, name, paths in (
            ("author_group", "Author Group", [".//authorgroup"]),
            ("legal_notice", "Legal Notice", [".//legalnotice"]),
            ("abstract", "Abstract", [".//bookinfo/abstract", ".//articleinfo/abstract"]),
        ):
            e = next((x for p in paths if (x := self.root.find(p)) is not None), None)
            if e is None and kind == "abstract" and self.root.tag in ("bookinfo", "articleinfo"):
                e = self.root.find("abstract")
            if e is not None and (kind != "author_group" or len(e) or (e.text or "").strip()):
                yield kind, f"{name} = ", self.title(e, TITLES[name]) if kind == "legal_notice" else TITLES[name], e.get("id"), self.show(e)
        for box in [e for e in self.root.iter() if e.tag in CONTAINERS]:
            yield from self.infos(box)

    def infos(self, box):
        """The first info of each name; its title goes to the box, which can't have its own beside it."""
        for name in INFOS:
            own = box.findall(name)
            if own:
                first = own[0]
                title = self.title(first, "Info")
                if (t := first.find("title")) is not None:
                    first.remove(t)
                yield "info", "Info", title if t is not None else "Info", first.get("id"), self.show(first)


def front_matter(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, place, kind, spec_line, title, xml_id, xml) of books, in the order in which an outline lists them.

    kind: revision_history, author_group, legal_notice, abstract, info. For info rows the title is what the container
    takes over. Revision numbers d.d become d-d, dates lose outer space. Books that aren't well formed have no rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, x in zip(frame["k"], frame["x"], strict=True):
                try:
                    rows = list(_Book(ElementTree.fromstring(x or "")).rows())
                except (ElementTree.ParseError, ValueError):
                    rows = []
                yield pd.DataFrame([[k, n, *r] for n, r in enumerate(rows)], columns=[key, "place", "kind", "spec_line", "title", "xml_id", "xml"])

    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}` AS k", f"`{xml}` AS x").mapInPandas(run, f"{key} {kind}, {_OUT}")


#: What stands for a missing product and version.
DEFAULTS = {"product": "Product", "version": "1"}
_FIELDS = {"title": "title", "subtitle": "subtitle", "edition": "edition", "pubsnumber": "pubsnumber", "product": "productname", "version": "productnumber"}


def _info(text: str | None) -> dict | None:
    try:
        book = _Book(ElementTree.fromstring(text or ""))
    except (ElementTree.ParseError, ValueError):
        return None

    def inner(e, name: str) -> str | None:
        t = None if e is None else e.find(name)
        return None if t is None else re.sub(r"\s+", " ", re.sub(r"^<[^>]*/>$|^<[^>]*>|</[^>]*>$", "", book.show(t)))

    first = lambda *names: next((e for n in names for e in book.root.iter(n)), None)
    root, info = first("book", "article"), first("bookinfo", "articleinfo", "info")
    out = {k: inner(root, k) for k in ("title", "subtitle")} | {"has_index": first("index") is not None}
    for k, name in _FIELDS.items():
        value = inner(info, name)
        if value is not None and (k != "version" or value.strip()):
            out[k] = value
    return out if info is None else DEFAULTS | out


def book_info(df: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, title, subtitle, edition, pubsnumber, product, version, has_index) of books.

    An info element overrides the root's own title and subtitle; product and version have defaults where there is an info
    element. Books that aren't well formed have a row of nulls.
    """
    columns = [key, *_FIELDS, "has_index"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [{key: k} | (_info(x) or {}) for k, x in zip(frame["k"], frame["x"], strict=True)]
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    kind = df.schema[key].dataType.simpleString()
    return df.selectExpr(f"`{key}` AS k", f"`{xml}` AS x").mapInPandas(run, f"{key} {kind}, {', '.join(f'{c} string' for c in _FIELDS)}, has_index boolean")


def declared_entities(texts: DataFrame, ignored: DataFrame) -> DataFrame:
    """(doc_id, name, declaration): the entities that the texts of a book declare, each declaration once, but those of ignored(name). texts(doc_id, text)."""
    found = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"""<!ENTITY\s+[^\s"']+\s+(?:"[^"\n]*"|'[^'\n]*')\s*>"""), F.lit(0))).alias("declaration")).distinct()
    named = found.withColumn("name", F.regexp_extract("declaration", r"<!ENTITY\s+(\S+)", 1))
    return named.join(ignored.select("name").distinct(), "name", "left_anti").select("doc_id", "name", "declaration")
