"""Markup to rows: parsed once, everything after is relational over the node table."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr, unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions.urls import absolute
from inkloom.operators.scratch import held
from inkloom.operators.stack import flat

#: Element names of the book dialect.
CONTAINERS = ["part", "chapter", "appendix", "preface", "section", "sect1", "sect2", "sect3", "sect4", "sect5", "simplesect"]
INFOS = ["sectioninfo", "chapterinfo", "partinfo", "appendixinfo", "prefaceinfo", "setinfo", "bookinfo", "articleinfo", "info"]
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Rows that a worker gathers before it hands them on; a document is never split.
ROWS = 20_000
#: And characters of text that it gathers.
TEXT = 4_000_000
NODES = "node_id int, parent_id int, post int, ord int, depth int, name string, attrs map<string,string>, text string"


class _Shredder(HTMLParser):
    """Tolerant: unclosed elements end with their parent, stray end tags are ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.open: list[int] = []
        self.children: dict[int, int] = {}
        self.posts = 0

    def add(self, name: str, attrs: dict | None, text: str | None) -> int:
        parent = self.open[-1] if self.open else -1
        ord_ = self.children[parent] = self.children.get(parent, 0) + 1
        self.rows.append([len(self.rows), parent if parent >= 0 else None, None, ord_, len(self.open), name, attrs, text])
        return len(self.rows) - 1

    def leave(self) -> None:
        self.rows[self.open.pop()][2] = self.posts
        self.posts += 1

    def handle_starttag(self, tag, attrs):
        node = self.add(tag, {k: v or "" for k, v in attrs}, None)
        self.open.append(node)
        if tag in VOID:
            self.leave()

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.leave()

    def handle_endtag(self, tag):
        if any(self.rows[n][5] == tag for n in self.open):
            while self.rows[self.open[-1]][5] != tag:
                self.leave()
            self.leave()

    def handle_data(self, data):
        if data.strip() or data and "\n" not in data:  # a space between two words counts, the layout of the source doesn't
            self.open.append(self.add("#text", None, data))
            self.leave()

    def handle_comment(self, data):
        self.open.append(self.add("#comment", None, data))
        self.leave()

    def parse_marked_section(self, i, report=1):
        """Sections that the parser doesn't know are comments up to the next >, as browsers take them; it would raise."""
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:
            return self.parse_bogus_comment(i)


#: References beyond the last character; Python refuses to read very long numbers.
_FAR_REFERENCE = re.compile(r"&#[0-9]{8,}")


def shred_html(text: str | None) -> list[list]:
    s = _Shredder()
    s.feed(_FAR_REFERENCE.sub("&#1114112", text or ""))
    s.close()
    while s.open:
        s.leave()
    return s.rows


def shred_xml(text: str | None) -> list[list] | None:
    """Rows of a well-formed document, None for any other."""
    try:
        root = ElementTree.fromstring(text or "")
    except (ElementTree.ParseError, ValueError):
        return None
    rows, posts = [], [0]

    def add(parent, ord_, depth, name, attrs, body):
        rows.append([len(rows), parent, None, ord_, depth, name, attrs, body])
        return len(rows) - 1

    def done(node):
        rows[node][2] = posts[0]
        posts[0] += 1

    stack = [(root, None, 1, 0, None)]
    while stack:  # no recursion: documents may nest deeply
        e, parent, ord_, depth, closing = stack.pop()
        if closing is not None:
            done(closing)
        elif isinstance(e, str):
            done(add(parent, ord_, depth, "#text", None, e))
        else:
            node = add(parent, ord_, depth, e.tag.rpartition("}")[2], {k.rpartition("}")[2]: v for k, v in e.attrib.items()}, None)
            parts = [e.text] if e.text and e.text.strip() else []
            for child in e:
                parts.append(child)
                if child.tail and child.tail.strip():
                    parts.append(child.tail)
            stack.append((None, None, 0, 0, node))
            stack += reversed([(p, node, k, depth + 1, None) for k, p in enumerate(parts, 1)])
    return rows


def nodes(df: DataFrame, key: str, text: str, xml: bool = False) -> DataFrame:
    """(key, node_id, parent_id, post, ord, depth, name, attrs, text): node_id is the preorder, post the postorder place."""

    def shown(keys: pa.Array, at: list[int], rows: list[list]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        columns[6] = [None if a is None else list(a.items()) for a in columns[6]]
        kinds = [*[pa.int32()] * 5, pa.string(), pa.map_(pa.string(), pa.string()), pa.string()]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[key, "node_id", "parent_id", "post", "ord", "depth", "name", "attrs", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, rows, size = batch.column("__key"), [], [], 0
            for k, t in enumerate(batch.column("__text")):  # one text at a time leaves the batch
                own = (shred_xml if xml else shred_html)(t.as_py()) or []
                rows += own
                at += [k] * len(own)
                size += len(t.as_py() or "")
                if len(rows) > ROWS or size > TEXT:
                    if rows:
                        yield shown(keys, at, rows)
                    at, rows, size = [], [], 0
            if rows:
                yield shown(keys, at, rows)

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("__key"), F.col(text).alias("__text")).mapInArrow(run, f"{key} {kind}, {NODES}")


def axis(table: DataFrame, key: str, name: str, left: str = "l", right: str = "r") -> Column:
    """The join condition of an XPath axis between two aliases of a node table: the right one lies on the axis of the left."""
    a, b = (lambda c: F.col(f"{left}.{c}")), (lambda c: F.col(f"{right}.{c}"))
    same = a(key) == b(key)
    under, over = (b("node_id") > a("node_id")) & (b("post") < a("post")), (b("node_id") < a("node_id")) & (b("post") > a("post"))
    sibling = a("parent_id").eqNullSafe(b("parent_id"))
    return same & {
        "self": a("node_id") == b("node_id"),
        "child": b("parent_id") == a("node_id"),
        "parent": a("parent_id") == b("node_id"),
        "descendant": under,
        "descendant-or-self": under | (a("node_id") == b("node_id")),
        "ancestor": over,
        "ancestor-or-self": over | (a("node_id") == b("node_id")),
        "following": (b("node_id") > a("node_id")) & (b("post") > a("post")),
        "preceding": (b("node_id") < a("node_id")) & (b("post") < a("post")),
        "following-sibling": sibling & (b("ord") > a("ord")),
        "preceding-sibling": sibling & (b("ord") < a("ord")),
    }[name]


def clamp_levels(levels: Column) -> Column:
    """min(level, previous + 1) along an array, from 0."""
    grown = F.aggregate(levels, F.array().cast("array<int>"), lambda acc, h: F.array_append(acc, F.least(h, F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + 1)))
    return grown


def headings(df: DataFrame, key: str, html: str) -> DataFrame:
    """(key, place, level, clamped, title): the headings of a page in order; leading section numbers are dropped."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>"), F.lit(0))
    levels = F.transform(found, lambda h: F.regexp_extract(h, "(?i)^<h([1-6])", 1).cast("int"))
    titles = F.transform(found, lambda h: F.regexp_replace(F.trim(F.regexp_replace(h, "(?s)<[^>]*>", "")), r"^[0-9]+(\.[0-9]+)*\.?[ ]*", ""))
    rows = df.select(key, levels.alias("levels"), titles.alias("titles"))
    out = rows.select(key, F.posexplode(F.arrays_zip("levels", clamp_levels(F.col("levels")).alias("clamped"), "titles")).alias("place", "h"))
    return out.select(key, "place", F.col("h.levels").alias("level"), F.col("h.clamped").alias("clamped"), F.col("h.titles").alias("title"))


def serialise(rows: list[list]) -> str:
    """The text of shredded rows: attributes in order, empty elements closed at once."""
    out, open_ = [], []
    for k, r in enumerate(rows):
        while open_ and open_[-1][0] != r[1]:
            out.append(f"</{open_.pop()[1]}>")
        if r[5] == "#text":
            out.append(escape(r[7]))
        elif r[5] == "#comment":
            out.append(f"<!--{r[7]}-->")
        else:
            inner = k + 1 < len(rows) and rows[k + 1][1] == r[0]
            out.append(f"<{r[5]}{''.join(f' {n}={quoteattr(v)}' for n, v in sorted(r[6].items()))}{'' if inner else '/'}>")
            if inner:
                open_.append((r[0], r[5]))
    return "".join(out) + "".join(f"</{name}>" for _, name in reversed(open_))


def parsed(df: DataFrame, key: str, xml: str, entities: bool = True) -> DataFrame:
    """(key, xml) with each text parsed and written anew, null where it isn't well formed. entities: general entities are kept as they are."""
    hide, show = (re.compile(r"&(?=[^;\s<&]*;)"), "\ue000") if entities else (re.compile("(?!)"), "\ue000")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for t in frame["xml"]:
                rows = shred_xml(hide.sub(show, t)) if t is not None else None
                out.append(serialise(rows).replace(show, "&") if rows else None)
            frame["xml"] = out
            yield frame

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(xml).alias("xml")).mapInPandas(run, f"{key} {kind}, xml string")


# HTML to sections.


def strip_number(title: str) -> str:
    """A heading without its section number."""
    return re.sub(r"^\d+(\.\d+)*\.?\s*", "", title)


#: Kinds of ordered lists.
NUMERATIONS = {"1": "arabic", "a": "loweralpha", "A": "upperalpha", "i": "lowerroman", "I": "upperroman"}
_SKIP = {"script", "style", "head", "nav", "footer"}
_MARKS = {"strong": "bold", "b": "bold", "em": "italic", "i": "italic", "u": "underline", "s": "strikethrough", "strike": "strikethrough"}


#: browsers' bounds of column and row spans.
MAX_SPAN, MAX_ROWS = 1000, 65534


def whole(value: str | None, most: int) -> int:
    """A number of an attribute: 1 where it is none, never under 1 or over ``most``."""
    if not value or not (value := value.strip()).isascii() or not value.isdigit():
        return 1
    return min(most, max(1, int(value))) if len(value) < 10 else most


class _Page:
    """Blocks of a page in order, made from its shredded rows."""

    def __init__(self, html: str | None, base: str):
        self.rows, self.base = shred_html(html), base
        self.kids: dict[int, list[int]] = {}
        for r in self.rows:
            if r[1] is not None:
                self.kids.setdefault(r[1], []).append(r[0])

    def inline(self, n: int):
        _, _, _, _, _, name, attrs, text = self.rows[n]
        if name == "#text":
            return escape(re.sub(r"\s+", " ", text))
        if name in _SKIP or name == "#comment":
            return ""
        body = yield self.inlines(self.kids.get(n, ()))
        if name == "a":
            return f"<ulink url={quoteattr(self.absolute(attrs.get('href', '')))}>{body}</ulink>" if "<mediaobject>" not in body else body
        if name == "img":
            return f"<mediaobject><imageobject><imagedata fileref={quoteattr(self.absolute(attrs.get('src', '')))}/></imageobject></mediaobject>"
        if name == "br":
            return "\n"
        return f'<emphasis role="{_MARKS[name]}">{body}</emphasis>' if name in _MARKS and body.strip() else body

    def inlines(self, nodes):
        out = []
        for k in nodes:
            out.append((yield self.inline(k)))
        return "".join(out)

    def absolute(self, url: str) -> str:
        return absolute(self.base, url)

    def items(self, n: int):
        out = []
        for k in self.kids.get(n, ()):
            if self.rows[k][5] == "li":
                inner = [c for c in self.kids.get(k, ()) if self.rows[c][5] in ("ul", "ol")]
                text = yield self.inlines([c for c in self.kids.get(k, ()) if c not in inner])
                out.append("<listitem>" + "".join(f"<para>{p.strip()}</para>" for p in text.split("\n") if p.strip()))
                for c in inner:
                    out.append((yield self.list(c)))
                out.append("</listitem>")
        return "".join(out)

    def list(self, n: int):
        name, kind = ("orderedlist", self.rows[n][6].get("type", "")) if self.rows[n][5] == "ol" else ("itemizedlist", "")
        numeration = f' numeration="{NUMERATIONS[kind]}"' if kind in NUMERATIONS else ""
        return f"<{name}{numeration}>{(yield self.items(n))}</{name}>"

    def find(self, n: int, name: str) -> list[int]:
        out, todo = [], [*reversed(self.kids.get(n, ()))]
        while todo:
            k = todo.pop()
            if self.rows[k][5] == name:
                out.append(k)
            elif self.rows[k][5] != "table":
                todo += reversed(self.kids.get(k, ()))
        return out

    def placed(self, rows: list[list[int]]) -> list[tuple[list[tuple[int, int, int, int]], int]]:
        """For each row of a group its cells as (column, width, height, node), and how many columns it fills, with those that cells above hold open."""
        out, held = [], {}
        for k, cells in enumerate(rows):
            at, line, filled, fresh = 1, [], set(held), {}
            for c in cells:
                while at in held:
                    at += 1
                attrs = self.rows[c][6]
                w, h = whole(attrs.get("colspan"), MAX_SPAN), min(whole(attrs.get("rowspan"), MAX_ROWS), len(rows) - k)
                line.append((at, w, h, c))
                own = range(at, at + w)
                filled.update(own)
                fresh |= dict.fromkeys(own, h)
                at += w
            out.append((line, len(filled)))
            held = {c: h - 1 for c, h in (held | fresh).items() if h > 1}
        return out

    def table(self, n: int, tag: str = "informaltable"):
        """A table as its grid: cells stand beside those that row spans hold open; a row span ends with its group of rows."""
        parts: list[tuple[list, list]] = []
        for r in self.find(n, "tr"):  # a header row among the others begins a new table
            cells = [c for c in self.kids.get(r, ()) if self.rows[c][5] in ("td", "th")]
            head = bool(cells) and all(self.rows[c][5] == "th" for c in cells)
            if not parts or head and parts[-1][1]:
                parts.append(([], []))
            parts[-1][0 if head else 1].append(cells)
        grids = [[(kind, self.placed(some)) for kind, some in zip(("thead", "tbody"), part, strict=True) if some] for part in parts]
        width = max((at + w - 1 for grid in grids for _, lines in grid for line, _ in lines for at, w, _, _ in line), default=0)
        out = []
        for grid in grids:
            shown = []
            for kind, lines in grid:
                made = []
                for line, filled in lines:
                    entries = []
                    for at, w, h, c in line:
                        attr = (f' namest="c{at}" nameend="c{at + w - 1}"' if w > 1 else "") + (f' morerows="{h - 1}"' if h > 1 else "")
                        inner = self.find(c, "table")
                        if inner:
                            entries.append((yield self.table(inner[0], "entrytbl")))
                        else:
                            text = yield self.inlines(self.kids.get(c, ()))
                            entries.append(f"<entry{attr}>{text.strip()}</entry>")
                    entries += ["<entry/>"] * (width - filled if kind == "thead" else 0)
                    made.append(f"<row>{''.join(entries)}</row>")
                shown.append(f"<{kind}>{''.join(made)}</{kind}>")
            group = "".join(f'<colspec colname="c{k}"/>' for k in range(1, width + 1)) + "".join(shown)
            out.append(f'<entrytbl cols="{width}">{group}</entrytbl>' if tag == "entrytbl" else f'<{tag}><tgroup cols="{width}">{group}</tgroup></{tag}>')
        return "".join(out)

    def blocks(self) -> Iterator[tuple[int, str | tuple[str, str]]]:
        """(heading level, title and initial text) or (0, markup)."""
        seen: set[int] = set()
        for r in self.rows:
            n, parent, name = r[0], r[1], r[5]
            if parent in seen or name in _SKIP or "toc" in (r[6] or {}).get("class", "").split():
                seen.add(n)
                continue
            if re.fullmatch("h[1-6]", name):
                yield int(name[1]), self.heading(n)
            elif name in ("ul", "ol"):
                yield 0, flat(self.list(n))
            elif name == "table":
                yield 0, flat(self.table(n))
            elif name == "pre":
                text = escape("".join(self.rows[k][7] or "" for k in self.under(n)))
                lang = r[6].get("class", "")
                yield 0, f"<programlisting{f' language={quoteattr(lang)}' if lang else ''}>{text}</programlisting>" if r[6].get("name") == "code" else f"<screen>{text}</screen>"
            elif name == "p":
                text = flat(self.inlines(self.kids.get(n, ()))).replace(" ", " ").strip()
                if text:
                    yield 0, f"<para>{text}</para>"
            else:
                continue
            seen.add(n)

    def under(self, n: int) -> Iterator[int]:
        todo = [*reversed(self.kids.get(n, ()))]
        while todo:
            yield (k := todo.pop())
            todo += reversed(self.kids.get(k, ()))

    def heading(self, n: int) -> tuple[str, str]:
        """The title, and what of it stands from the first link or image on, as a paragraph of the section."""
        title, rest, todo = [], [], [*reversed(self.kids.get(n, ()))]
        while todo:
            k = todo.pop()
            name = self.rows[k][5]
            if name in ("#text", "a", "img"):
                piece = flat(self.inline(k))
                (rest if rest or piece.startswith("<") else title).append(piece)
            elif name not in _SKIP:
                todo += reversed(self.kids.get(k, ()))
        text = strip_number(unescape("".join(title)).strip()).strip()
        return text or "Untitled", f"<para>{''.join(rest)}</para>" if rest else ""


def page_sections(html: str | None, url: str | None) -> list[tuple[int, int, str, str]]:
    """(place, level, title, body) of a page's sections.

    A level is at most one deeper than the one before. A heading without content is kept where a deeper one follows, as its
    container; else it goes, and with it the containers that it leaves empty. What comes before the first heading has no section.
    """
    out: list[tuple[int, str, list[str]]] = []

    def unwind(level: int) -> None:
        while out and not out[-1][2] and level <= out[-1][0]:
            out.pop()

    before = 0
    for level, part in _Page(html, url or "").blocks():
        if level:
            level = min(level, before + 1)
            unwind(level)
            title, initial = part
            out.append((level, title, [initial] if initial else []))
            before = level
        elif out:
            out[-1][2].append(part)
    unwind(0)
    return [(k, level, title, "".join(body)) for k, (level, title, body) in enumerate(out)]


def sections(df: DataFrame, key: str, html: str, url: str) -> DataFrame:
    """(key, place, level, kind, title, body): a section without text before a deeper one is a container, else a topic."""

    def shown(keys: pa.Array, at: list[int], found: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True))], names=[key, "place", "level", "title", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, at, found, size = batch.column("k"), [], [], 0
            for k, (h, u) in enumerate(zip(batch.column("h"), batch.column("u"), strict=True)):  # one page at a time leaves the batch
                own = page_sections(h.as_py(), u.as_py())
                found += own
                at += [k] * len(own)
                size += sum(len(s[-1]) for s in own)
                if len(found) > ROWS or size > TEXT:
                    yield shown(keys, at, found)
                    at, found, size = [], [], 0
            if found:
                yield shown(keys, at, found)

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(html).alias("h"), F.col(url).alias("u")).mapInArrow(run, f"{key} {kind}, place int, level int, title string, body string")
    deeper = F.lead("level").over(Window.partitionBy(key).orderBy("place")) > F.col("level")
    return rows.withColumn("kind", F.when((F.col("body") == "") & F.coalesce(deeper, F.lit(False)), "container").otherwise("topic"))


def _boxes(rows: list[list]) -> list[tuple]:
    """(node_id, kind, name, title, depth, xml_id, target_num) of the topics and containers among a book's shredded rows."""
    titles: dict[int, tuple[int, str]] = {}
    filled, holding = set(), set()
    for r in rows:
        parent, name = r[1], r[5]
        if parent is None:
            continue
        if name in CONTAINERS:
            holding.add(parent)
        elif name == "#text":
            above = rows[parent]
            if above[5] == "title" and (above[1] not in titles or r[3] < titles[above[1]][0]):
                titles[above[1]] = r[3], r[7]
        elif name not in ("title", "#comment", *INFOS):
            filled.add(parent)
    out, number = [], 0
    for r in rows:
        n, name = r[0], r[5]
        if name in CONTAINERS:
            is_box = n in holding or name in ("part", "chapter", "appendix", "preface") and n not in filled
            xml_id = r[6].get("id")
            number += is_box and xml_id is not None
            out.append((n, "container" if is_box else "topic", name, titles[n][1] if n in titles else "Untitled", r[4], xml_id, number if is_box and xml_id is not None else None))
    return out


def box_texts(rows: list[list]) -> dict[int, tuple[str, list[str]]]:
    """Of every box among a book's shredded rows its markup without boxes inside it and without its own id, and the ids in it."""
    box: list[int | None] = []
    parts: dict[int, list] = {}
    for r in rows:  # parents come before their children
        own = r[0] if r[5] in CONTAINERS else box[r[1]] if r[1] is not None else None
        box.append(own)
        if own is not None:
            parts.setdefault(own, []).append(r)
    out = {}
    for n, some in parts.items():
        ids = [v for r in some if (v := (r[6] or {}).get("id"))]
        root = [*some[0][:6], {a: v for a, v in some[0][6].items() if a != "id"}, some[0][7]]
        out[n] = serialise([root, *some[1:]]), ids
    return out


def shred_book(df: DataFrame, key: str, xml: str, texts: bool = False) -> DataFrame:
    """Topics and containers of books: (key, node_id, kind, name, title, depth, xml_id, target_num), in order of node_id; texts: and xml, ids as box_texts has them.

    A book is parsed once and only its boxes leave the task.
    """
    columns = [key, "node_id", "kind", "name", "title", "depth", "xml_id", "target_num", *(["xml", "ids"] if texts else [])]

    def shown(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=columns).astype({"target_num": "Int32"})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for frame in frames:
            for k, t in zip(frame["k"], frame["t"], strict=True):
                rows = shred_xml(t) or []
                held = box_texts(rows) if texts else {}
                out += [(k, *b, *held.get(b[0], ())) for b in _boxes(rows)]
                if len(out) > ROWS // 4:
                    yield shown(out)
                    out = []
        yield shown(out)

    kind = df.schema[key].dataType.simpleString()
    more = ", xml string, ids array<string>" if texts else ""
    return df.select(F.col(key).alias("k"), F.col(xml).alias("t")).mapInPandas(run, f"{key} {kind}, node_id int, kind string, name string, title string, depth int, xml_id string, target_num int{more}")


def root_element(xml: Column) -> Column:
    """The name of the document element, without its prefix; null without one."""
    bare = F.regexp_replace(xml, r"(?s)^(?:\s|<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>)+", "")
    return F.nullif(F.regexp_extract(bare, r"^<(?:[\w.-]+:)?([A-Za-z_][\w.-]*)", 1), F.lit(""))


def empty_boxes(table: DataFrame, key: str) -> DataFrame:
    """Containers of a node table that hold no text but that of their title and their revision history: (key, node_id, name)."""
    table = held(table, "nodes")
    boxes = table.where(F.col("name").isin(CONTAINERS)).select(key, "node_id", "post", "name")
    aside = table.where(F.col("name").isin("title", "revhistory")).alias("l")
    texts = table.where((F.col("name") == "#text") & (F.trim("text") != ""))
    told = texts.alias("r").join(aside, axis(table, key, "descendant"), "left_anti")
    return boxes.alias("l").join(told.alias("r"), axis(table, key, "descendant"), "left_anti").select(key, "node_id", "name")


_STEP = re.compile(r"(/{0,2})(?:(?:[\w.-]+:)?(\*|[\w.-]+)(?:\[@([\w.-]+)(?:=(?:'([^']*)'|\"([^\"]*)\"))?\])?)")


def _steps(path: str) -> list[tuple[str, str, str | None, str | None]]:
    """(axis, name, attribute, its value) of the steps of a path; prefixes don't count."""
    own, at, out = path.removeprefix("."), 0, []
    while at < len(own):
        m = _STEP.match(own, at)
        if m is None or m.end() == at:
            return []
        out.append(("descendant" if m[1] == "//" else "child", m[2], m[3], m[4] if m[4] is not None else m[5]))
        at = m.end()
    return out


def select_nodes(table: DataFrame, key: str, paths: dict[str, str]) -> DataFrame:
    """(key, path, node_id, value) of the nodes that paths name, whatever their namespace; value: the text below.

    A path is made of / and // steps with names, * and [@attribute] or [@attribute='value']; one that can't be read names nothing.
    Each step is a join of the nodes found with the node table, by parent or by the interval of the descendants.
    """
    found, table = None, held(table, "nodes")
    for name, path in paths.items():
        at = None
        for k, (kind, tag, attr, value) in enumerate(_steps(path)):
            fit = table.where(~F.col("name").startswith("#"))
            fit = fit if tag == "*" else fit.where(F.col("name") == tag)
            if attr:
                own = F.try_element_at("attrs", F.lit(attr))
                fit = fit.where(own.isNotNull() if value is None else own == value)
            if k == 0:
                at = fit if kind == "descendant" else fit.where("parent_id IS NULL" if path.startswith("/") else "depth = 1")
            else:
                at = fit.alias("r").join(at.select(key, "node_id", "post").alias("l"), axis(table, key, kind), "left_semi")
        if at is not None:
            one = at.select(key, F.lit(name).alias("path"), "node_id", "post")
            found = one if found is None else found.unionByName(one)
    if found is None:
        return table.select(key, F.lit("").alias("path"), "node_id", F.lit("").alias("value")).limit(0)
    texts = found.alias("l").join(table.where("name = '#text'").alias("r"), axis(table, key, "descendant"), "left")
    gathered = texts.groupBy(F.col(f"l.{key}").alias(key), "l.path", "l.node_id").agg(F.array_sort(F.collect_list(F.when(F.col("r.text").isNotNull(), F.struct("r.node_id", "r.text")))).alias("t"))
    return gathered.select(key, "path", "node_id", F.array_join(F.transform("t", lambda x: x["text"]), "").alias("value"))
