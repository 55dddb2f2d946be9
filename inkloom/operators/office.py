"""Office text (a ZIP with content.xml and styles.xml) to the sections that pages become."""

from __future__ import annotations

from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkloom.operators.markup import MAX_ROWS, MAX_SPAN, strip_number, whole
from inkloom.operators.stack import flat

#: Number formats of lists and marks of characters.
NUMERATION = {"a": "loweralpha", "A": "upperalpha", "i": "lowerroman", "I": "upperroman"}
MARKS = ["bold", "underline", "strikethrough"]
#: A run of spaces and a heading's level are no greater.
MAX_SPACES, MAX_LEVEL = 10_000, 100
_OUT = "place int, level int, title string, body string"


def _local(name: str) -> str:
    return name.rpartition("}")[2]


def _parse(text: str | None):
    try:
        root = ElementTree.fromstring(text or "")
    except (ElementTree.ParseError, ValueError):
        return None
    for e in root.iter():
        e.tag = _local(e.tag)
        e.attrib = {_local(k): v for k, v in e.attrib.items()}
    return root


class _Office:
    def __init__(self, content: str | None, styles: str | None, rules: list[dict]):
        self.root, self.rules = _parse(content), rules
        self.styles: dict[str, ElementTree.Element] = {}
        self.lists: dict[str, ElementTree.Element] = {}
        for root in (_parse(styles), self.root):  # those of the content win
            if root is not None:
                self.styles |= {e.get("name"): e for e in root.iter("style")}
                self.lists |= {e.get("name"): e for e in root.iter("list-style")}

    def font(self, *names: str | None) -> dict:
        """Properties of styles, the first wins; each style's own before its parents'."""
        out: dict = {}
        for name in names:
            seen = set()
            while name in self.styles and name not in seen:
                seen.add(name)
                style = self.styles[name]
                if (p := style.find("text-properties")) is not None:
                    line = lambda k: None if p.get(k) is None else p.get(k) != "none"  # noqa: B023, E731
                    own = {
                        "font": p.get("font-name") or p.get("font-family"),
                        "size": p.get("font-size"),
                        "bold": None if p.get("font-weight") is None else p.get("font-weight") == "bold",
                        "italics": None if p.get("font-style") is None else p.get("font-style") == "italic",
                        "underline": line("text-underline-style"),
                        "strikethrough": line("text-line-through-style"),
                    }
                    out = {k: v for k, v in own.items() if v is not None} | out
                name = style.get("parent-style-name")
        return out

    def rule(self, p) -> dict | None:
        """The first rule that a paragraph fits; fields that a rule leaves open fit anything."""
        spans = [s.get("style-name") for s in p.iter("span") if "".join(s.itertext()).strip()]
        outer = (p.text or "").strip() or len(spans) != 1
        font = self.font(*([] if outer else spans), p.get("style-name"))
        for r in self.rules:
            if all(r.get(k) is None or r[k] == font.get(k, False if isinstance(r[k], bool) else None) for k in ("font", "size", "bold", "italics", "underline", "strikethrough")):
                return r
        return None

    def plain(self, e) -> str:
        out, todo = [], [e]
        while todo:
            k = todo.pop()
            if isinstance(k, str):
                out.append(k)
            elif k.tag in ("s", "tab", "line-break"):
                out.append(" " * whole(k.get("c"), MAX_SPACES) if k.tag == "s" else "\t" if k.tag == "tab" else "\n")
            elif k.tag != "annotation":
                out.append(k.text or "")
                todo += [x for c in reversed(k) for x in (c.tail or "", c)]
        return "".join(out)

    def marked(self, text: str | None, styles: list, emphasis: bool) -> str:
        if not text or not text.strip() or not emphasis:
            return escape(text or "")
        font = self.font(*styles)
        mark = next((m for m in MARKS if font.get(m)), None)
        if mark is None and not font.get("italics"):
            return escape(text)
        return f"<emphasis{f' role={quoteattr(mark)}' if mark else ''}>{escape(text)}</emphasis>"

    def inline(self, e, styles: list, emphasis: bool = True, anchor: str | None = None):
        styles = [e.get("style-name"), *styles] if e.get("style-name") else styles
        out = [self.marked(e.text, styles, emphasis)]
        for k in e:
            if k.tag == "s":
                out.append(" " * whole(k.get("c"), MAX_SPACES))
            elif k.tag in ("tab", "line-break"):
                out.append("\t" if k.tag == "tab" else "\n")
            elif k.tag == "annotation":
                head = "".join(f"<emphasis>{escape(x.text or '')} </emphasis>" for n in ("creator", "date") if (x := k.find(n)) is not None)
                out.append(f"<remark>{head}{''.join(escape(''.join(p.itertext())) for p in k.findall('p'))}</remark>")
            elif k.tag == "a":
                text = escape("".join(k.itertext()))
                out.append(f"<ulink url={quoteattr(k.get('href'))}>{text}</ulink>" if text and k.get("href") is not None else text)
            elif k.tag == "image":
                if k.get("href") is not None:
                    name = "inlinemediaobject" if anchor == "as-char" else "mediaobject"
                    out.append(f"<{name}><imageobject><imagedata fileref={quoteattr(k.get('href').strip())}/></imageobject></{name}>")
            elif k.tag not in ("bookmark", "bookmark-start", "bookmark-end", "sequence-decls"):
                out.append((yield self.inline(k, styles, emphasis, k.get("anchor-type", anchor))))
            out.append(self.marked(k.tail, styles, emphasis))
        return "".join(out)

    def para(self, p) -> tuple[str, str, bool] | None:
        """(element, text, merges with a like neighbour), None if there is nothing."""
        rule = self.rule(p)
        text = escape(self.plain(p)) if rule else flat(self.inline(p, [])).replace("\xa0", " ").strip()
        return (rule["element"] if rule else "para", text, bool(rule and rule.get("merge"))) if text.strip() else None

    def flow(self, children, depth: int = 0, style: str | None = None):
        """Paragraphs, lists and tables in order; neighbours of one merging element are one, line by line."""
        out: list[list] = []
        for e in children:
            if e.tag == "p" and (x := self.para(e)):
                if x[2] and out and out[-1][0] == x[0]:
                    out[-1][1] += "\n" + x[1]
                else:
                    out.append([x[0] if x[2] else None, x[1] if x[2] else f"<{x[0]}>{x[1]}</{x[0]}>"])
            elif e.tag == "list":
                out.append([None, (yield self.list(e, depth + 1, style))])
            elif e.tag == "table":
                out.append([None, (yield self.table(e))])
        return "".join(t if name is None else f"<{name}>{t}</{name}>" for name, t in out)

    def list(self, e, depth: int = 1, style: str | None = None):
        style = style or e.get("style-name")
        number = None
        if style in self.lists:
            number = next((n for n in self.lists[style].findall("list-level-style-number") if n.get("level") == str(depth)), None)
        head, items = "", []
        for h in e.findall("list-header"):
            head += yield self.flow(h.findall("p"))
        for i in e.findall("list-item"):
            if x := (yield self.flow([k for k in i if k.tag in ("p", "list")], depth, style)):
                items.append(x)
        if not e.findall("list-item"):
            return head  # a list of a header alone is but a paragraph
        if not head and not items:
            return ""
        name = "itemizedlist" if number is None else "orderedlist"
        kind = "" if number is None else f' numeration="{NUMERATION.get(number.get("num-format"), "arabic")}"'
        return f"<{name}{kind}>{head}{''.join(f'<listitem>{x}</listitem>' for x in items)}</{name}>"

    def table(self, e, tag: str = "informaltable"):
        span = lambda c, k: whole(c.get(k), MAX_ROWS if "rows" in k else MAX_SPAN)
        heads = [r for h in e.findall("table-header-rows") for r in h.findall("table-row")]
        bodies = [r for k in e for r in ([k] if k.tag == "table-row" else k.findall("table-row") if k.tag in ("table-rows", "table-row-group") else [])]
        width = max((sum(span(c, "number-columns-spanned") for c in r.findall("table-cell")) for r in heads + bodies), default=0)
        if not width:
            return ""
        shown = []
        for kind, rows in (("thead", heads), ("tbody", bodies)):
            lines = []
            for r in rows:
                at, cells, under = 1, [], 0  # under: cells that one to their left covers
                for c in r:
                    if c.tag == "covered-table-cell":
                        under, at = (under - 1, at) if under else (0, at + 1)
                    elif c.tag == "table-cell":
                        w = span(c, "number-columns-spanned")
                        h = span(c, "number-rows-spanned")
                        attr = (f' namest="c{at}" nameend="c{at + w - 1}"' if w > 1 else "") + (f' morerows="{h - 1}"' if h > 1 else "")
                        inner = c.find("table")
                        cells.append((yield self.table(inner, "entrytbl")) if inner is not None else f"<entry{attr}>{(yield self.flow(c))}</entry>")
                        under, at = w - 1, at + w
                lines.append(f"<row>{''.join(cells)}</row>")
            if lines:
                shown.append(f"<{kind}>{''.join(lines)}</{kind}>")
        group = "".join(f'<colspec colname="c{k}"/>' for k in range(1, width + 1)) + "".join(shown)
        return f'<entrytbl cols="{width}">{group}</entrytbl>' if tag == "entrytbl" else f'<{tag}><tgroup cols="{width}">{group}</tgroup></{tag}>'

    def sections(self) -> Iterator[tuple[int, str, str]]:
        """(level, title, body): levels begin at 1 and grow by one at most; what stands before the first heading has no section."""
        body = None if self.root is None else self.root.find(".//body/text")
        if body is None:
            return
        todo, parts = [*reversed(body)], []
        while todo:
            e = todo.pop()
            if e.tag == "section":
                todo += reversed(e)
            elif e.tag == "h":
                level = whole(e.get("outline-level"), MAX_LEVEL)
                parts.append((level, strip_number(self.plain(e).strip()), []))
            elif parts:
                parts[-1][2].append(e)
        before = 1
        for level, title, blocks in parts:
            if not title and not blocks:
                continue
            before = min(level, before + 1)
            yield before, title, flat(self.flow(blocks))


def archives(files: DataFrame) -> DataFrame:
    """(source, content, styles) of the archives that hold both files. files(source, path, text)."""
    parts = files.where(F.col("path").isin("content.xml", "styles.xml")).groupBy("source")
    return parts.agg(*(F.max(F.when(F.col("path") == f"{n}.xml", F.col("text"))).alias(n) for n in ("content", "styles"))).where("content IS NOT NULL AND styles IS NOT NULL")


def office_sections(df: DataFrame, key: str, content: str, styles: str, rules: list[dict] | None = None) -> DataFrame:
    """(key, place, level, kind, title, body) of office texts, as markup.sections gives for pages.

    content and styles hold the two files of each archive; an unreadable content has no sections, unreadable styles count
    as none. rules, in order: dicts of font, size, bold, italics, underline, strikethrough (null: any), element, merge.
    One document at a time is held.
    """
    settings = list(rules or ())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k, c, s in zip(frame["k"], frame["c"], frame["s"], strict=True):
                yield pd.DataFrame([[k, n, *x] for n, x in enumerate(_Office(c, s, settings).sections())], columns=[key, "place", "level", "title", "body"])

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(content).alias("c"), F.col(styles).alias("s")).mapInPandas(run, f"{key} {kind}, {_OUT}")
    deeper = F.lead("level").over(Window.partitionBy(key).orderBy("place")) > F.col("level")
    return rows.withColumn("kind", F.when((F.col("body") == "") & F.coalesce(deeper, F.lit(False)), "container").otherwise("topic"))
