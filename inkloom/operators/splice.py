"""Included text put in its place, and links turned into injections."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkloom.functions.text import LINKS, linkend, linkends, strict_key
from inkloom.operators.stack import flat

#: Fixed values.
COMMON_CONTENT = re.compile(r"Common_Content")
XINCLUDE = "http://www.w3.org/2001/XInclude"

#: Letters of files, or texts, after which a task hands on what it has made.
LETTERS, ROWS = 4_000_000, 1000

#: Stands for the & of entities while a text is parsed.
_HIDDEN = "\ue000"
_MARK = re.compile(r"<!--.*?-->|<!\[CDATA\[.*?\]\]>|<xi:include\b[^>]*>|</xi:include\s*>", re.S)
_ATTR = re.compile(r"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_PREAMBLE = re.compile(r"^\s*(?:<\?xml.*?\?>)?\s*(?:<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>)?", re.S)
_FILEREF = re.compile(r"""(fileref\s*=\s*)(["'])(.*?)\2""")
#: The directives of the format.
_ADOC = re.compile(r"include::?([^\n\[\]]*)\[\]")
_ADOC_ATTR = re.compile(r"^:([^:\n]*):([^\n]*)$", re.M)


class Circular(ValueError):
    """A file that includes itself, directly or not."""


class _Files:
    """Files of one source: an exact name wins, else the last that differs in case only."""

    def __init__(self, files: dict[str, str | None]):
        self.exact, self.folded = files, {k.lower(): k for k in files}

    def find(self, name: str) -> str | None:
        return name if name in self.exact else self.folded.get(name.lower())

    def near(self, path: str, *hrefs: str) -> str | None:
        """The first of the references, relative to the folder of path, that exists."""
        for h in hrefs:
            if (found := self.find(posixpath.normpath(posixpath.join(posixpath.dirname(path), h)))) is not None:
                return found
        return None


def _attrs(tag: str) -> dict[str, str]:
    return {k: a or b for k, a, b in _ATTR.findall(tag)}


def _base(text: str) -> str:
    """xml:base of the root with a slash at its end; nothing for the folder itself."""
    root = re.search(r"<[A-Za-z][^>]*>", text)
    base = _attrs(root[0]).get("xml:base", "") if root else ""
    return "" if base in ("", ".", "./") else base if base.endswith("/") else base + "/"


def _tree(text: str):
    """The parsed text, or None where it isn't well formed; entities are hidden, not resolved."""
    body = re.sub(r"&(?=[^;\s]*;)", _HIDDEN, _PREAMBLE.sub("", text, count=1))
    if "xi:" in body and "xmlns:xi" not in body:
        body = re.sub(r"<([A-Za-z][\w:.-]*)", rf'<\1 xmlns:xi="{XINCLUDE}"', body, count=1)
    try:
        return ElementTree.fromstring(body)
    except (ElementTree.ParseError, ValueError):
        return None


_POINTER = re.compile(r"\s*(?:(xpointer|element)\((.*)\)|([A-Za-z_][\w.-]*))\s*", re.S)
_SEQUENCE = re.compile(r"([A-Za-z_][\w.-]*)?((?:/[0-9]{1,9})*)")


def _named(root, name: str):
    return next((e for e in root.iter() if name in (e.get("id"), e.get("{http://www.w3.org/XML/1998/namespace}id"))), None)


def _pointed(root, pointer: str) -> list | None:
    """The elements that a pointer names, None if it can't be read: an id, element() with an id or steps by number, xpointer() with a path as ElementTree has them."""
    m = _POINTER.fullmatch(pointer)
    if m is None:
        return None
    if m[3] and (e := _named(root, m[3])) is not None:
        return [e]
    holder = ElementTree.Element("holder")
    holder.append(root)
    if m[1] == "element":
        steps = _SEQUENCE.fullmatch(m[2].strip())
        if steps is None or not m[2].strip():
            return None
        at = _named(root, steps[1]) if steps[1] else holder
        for k in map(int, steps[2].split("/")[1:]):
            at = at[k - 1] if at is not None and 0 < k <= len(at) else None
        return [] if at is None or at is holder else [at]
    path = re.sub(r"\[\s*position\(\)\s*=\s*([0-9]+)\s*\]", r"[\1]", m[3] or m[2].strip())
    try:
        return holder.findall("." + path if path.startswith("/") else ".//" + path)
    except (SyntaxError, KeyError, ValueError, TypeError, IndexError):
        return None


def _select(root, pointer: str) -> str | None:
    """The text of the elements that a pointer names, whatever their namespaces; None if it can't be read."""
    for e in root.iter():
        if isinstance(e.tag, str):
            e.tag = e.tag.rpartition("}")[2]
    parts = _pointed(root, pointer)
    for e in parts or ():
        e.tail = None
    return None if parts is None else "".join(ElementTree.tostring(e, encoding="unicode") for e in parts).replace(_HIDDEN, "&")


def expand_xml(files: dict[str, str | None], path: str, unread: list[str] | None = None, done: dict[str, tuple[str, bool]] | None = None) -> str:
    """A file with everything that it includes, at any depth.

    Missing files give way to an inclusion in their fallback, else vanish, as do inclusions without href; common content
    stays as it is; parse="text" is escaped; xpointer selects, one that can't be read nothing (it goes to ``unread``); fileref of included files become paths of the source. Each file is expanded once, however many include it; ``done`` keeps
    that from one root of a source to the next.
    """
    store, done = _Files(files), {} if done is None else done

    def refs(text: str, at: str) -> str:
        base = _base(text)

        def put(m):
            name = re.sub(r"^\./", "", m[3])
            found = None if COMMON_CONTENT.match(m[3]) else store.near(at, name, base + name)
            return m[0] if found is None else f"{m[1]}{m[2]}{found}{m[2]}"

        return _FILEREF.sub(put, text)

    def include(tag: str, inner: str, at: str, base: str, trail: dict):
        attrs = _attrs(tag)
        href = attrs.get("href")
        if href is None:
            return ""
        if COMMON_CONTENT.match(href):
            return tag + ("" if tag.endswith("/>") else inner + "</xi:include>")
        name = re.sub(r"^\./", "", href)
        found = store.near(at, base + name, name)
        if found is None:
            fallback = re.search(r"<xi:fallback\b[^>]*>(.*)</xi:fallback\s*>", inner, re.S)
            first = next(_includes(fallback[1]), None) if fallback else None
            return (yield include(*first[:2], at, base, trail)) if first else ""
        if found in trail:
            raise Circular(" > ".join((*trail, found)))
        if found not in done:
            trail[found] = None
            text = files[found] or ""
            text = yield walk(refs(text, found), found, _base(text), trail)
            del trail[found]
            done[found] = text, _tree(text) is not None
        text, whole = done[found]
        if attrs.get("parse") == "text":
            return escape(_PREAMBLE.sub("", text, count=1) if whole else text)
        if not whole:
            return ""
        if "xpointer" not in attrs:
            return _PREAMBLE.sub("", text, count=1).strip()
        picked = _select(_tree(text), attrs["xpointer"])
        if picked is None and unread is not None:
            unread.append(attrs["xpointer"])
        return picked or ""

    def walk(text: str, at: str, base: str, trail: dict):
        out, last = [], 0
        for tag, inner, start, end in _includes(text):
            out += [text[last:start], (yield include(tag, inner, at, base, trail))]
            last = end
        return "".join(out) + text[last:]

    own = store.find(path)
    text = files[own] or "" if own is not None else ""
    return flat(walk(text, own or path, _base(text), {own or path: None}))


def _includes(text: str):
    """(tag, inner, start, end) of the outermost inclusions outside comments and character data."""
    depth, opened = 0, None
    for m in _MARK.finditer(text):
        if m[0].startswith("<!"):
            continue
        if m[0].startswith("</"):
            depth = max(0, depth - 1)
            if depth == 0 and opened is not None:
                yield opened[0], text[opened.end() : m.start()], opened.start(), m.end()
                opened = None
        elif m[0].endswith("/>"):
            if depth == 0:
                yield m[0], "", m.start(), m.end()
        else:
            opened = m if depth == 0 else opened
            depth += 1


def expand_asciidoc(files: dict[str, str | None], path: str) -> tuple[str, dict[str, str]]:
    """A file with its inclusions and the attributes defined on the way; those in comments are renamed, missing ones removed.

    An inclusion is ``include::target[]`` anywhere in a line, an attribute ``:name: value`` on a line of its own. Commented is
    what stands between two lines' worth of //// or behind // in its line. Attributes count from the file that defines them on.
    """
    store, names = _Files(files), {}

    def walk(at: str, trail: dict):
        text, out, last, fenced = files[at] or "", [], 0, 0
        names.update(_ADOC_ATTR.findall(text))
        for m in _ADOC.finditer(text):
            fenced += text.count("////", last, m.start())
            line = text[text.rfind("\n", 0, m.start()) + 1 : m.start()]
            out.append(text[last : m.start()])
            last = m.end()
            if fenced % 2 or "//" in line:
                out.append("includecomment" + m[0][len("include") :])
                continue
            target = m[1]
            for name, value in names.items():
                target = target.replace(f"{{{name}}}", value.strip())
            found = store.near(at, target.removeprefix("./")) if target.strip() else None
            if found in trail:
                raise Circular(" > ".join((*trail, found)))
            if found is not None:
                trail[found] = None
                out.append((yield walk(found, trail)))
                del trail[found]
        return "".join(out) + text[last:]

    own = store.find(path)
    return flat(walk(own, {own: None})) if own is not None else "", names


def expand(files: DataFrame, roots: DataFrame, kind: str = "xml") -> DataFrame:
    """(source, path, text, error) of every root: its text with all inclusions, or the circle that prevents it; also pointers that couldn't be read.

    files(source, path, text), roots(source, path). A source is one book: its files meet in one task because its text is
    one row anyway. A task streams through its sources, roots before files, and holds one source at a time; files of sources
    without a root are passed over. A null text counts as empty.
    """
    if kind not in ("xml", "asciidoc"):
        raise ValueError(f"no such kind: {kind}")

    def expanded(source, known: dict, starts: list) -> list[list]:
        out, done = [], {}
        for p in starts:
            try:
                unread: list[str] = []
                text = expand_xml(known, p, unread, done) if kind == "xml" else expand_asciidoc(known, p)[0]
                out.append([source, p, text, "unread pointers: " + ", ".join(dict.fromkeys(unread)) if unread else None])
            except Circular as e:
                out.append([source, p, None, str(e)])
        return out

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shown = lambda rows: pd.DataFrame(rows, columns=["source", "path", "text", "error"])
        now, known, starts, out, size = None, {}, [], [], 0
        for frame in frames:
            for file, source, path, text in zip(frame["file"], frame["source"], frame["path"], frame["text"], strict=True):
                if source != now:
                    out += expanded(now, known, starts)
                    size += sum(len(t or "") for t in known.values())
                    now, known, starts = source, {}, []
                    if size > LETTERS or len(out) > ROWS:
                        yield shown(out)
                        out, size = [], 0
                if not file:
                    starts.append(path)
                elif starts:
                    known[path] = text
        yield shown(out + expanded(now, known, starts))

    both = files.select("source", "path", "text", F.lit(1).alias("file")).unionByName(roots.select("source", "path", F.lit(None).cast("string").alias("text"), F.lit(0).alias("file")).distinct())
    return both.repartition("source").sortWithinPartitions("source", "file").mapInPandas(run, "source string, path string, text string, error string")


def inject(xml: Column, refs: Column) -> Column:
    """Links to known ids as injections. refs: map of linkend to a topic's id or a container's T<n>; others stay.

    A link to a topic keeps its own markup in a comment after the injection, so that its text isn't lost.
    """
    found = F.array_distinct(F.regexp_extract_all(xml, F.lit(LINKS), F.lit(0)))

    def put(acc, piece):
        ref = F.try_element_at(refs, linkend(piece))
        kept = F.when(piece.startswith("<link") & ~ref.startswith("T"), F.concat(F.lit("<!--"), piece, F.lit("-->"))).otherwise("")
        return F.when(ref.isNull(), acc).otherwise(F.replace(acc, piece, F.concat(F.lit("<!--Inject: "), ref, F.lit("-->"), kept)))

    return F.aggregate(found, xml, put)


def inject_links(topics: DataFrame, refs: DataFrame) -> DataFrame:
    """topics(doc_id, seq, xml) with their links as injections; refs(doc_id, linkend, ref), one row for each id.

    Only the ids that a topic uses travel to it: links are joined on (doc_id, linkend), then folded into one map for each topic.
    """
    used = topics.select("doc_id", "seq", F.explode(F.array_distinct(linkends(F.col("xml")))).alias("linkend"))
    maps = used.join(refs.select("doc_id", "linkend", "ref").where("ref IS NOT NULL").dropDuplicates(["doc_id", "linkend"]), ["doc_id", "linkend"])
    maps = maps.groupBy("doc_id", "seq").agg(F.map_from_entries(F.collect_list(F.struct("linkend", "ref"))).alias("__refs"))
    empty = F.create_map().cast("map<string,string>")
    return topics.join(maps, ["doc_id", "seq"], "left").withColumn("xml", inject(F.col("xml"), F.coalesce("__refs", empty))).drop("__refs")


def changed(stored: Column, written: Column) -> Column:
    """Whether an update altered a topic, beyond layout; an unreadable side counts as altered."""
    return F.coalesce(strict_key(stored) != strict_key(written), F.lit(True))

