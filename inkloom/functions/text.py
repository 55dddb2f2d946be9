"""Normalisation of markup and text as Column expressions; all stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f\x0B]"
ENTITY = r"&[^;]*?;"
#: The role of boilerplate paragraphs, what counts as the same quotation mark, containers without a meaning of their own, names of languages.
BOILERPLATE_ROLE = "RoleCreateBugPara"
VERBATIM = ("date", "screen", "programlisting", "literallayout", "synopsis", "address", "computeroutput")
UNCOMPARED = "xmlns|version|remap"
IGNORED_CONTAINERS = ("partintro",)
LISTING_LANGUAGES = {"ini": "INI Files", "json": "JavaScript"}


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def strip_preamble(xml: Column) -> Column:
    """Drop the XML declaration and the document type, internal subset included, at the start; later text (CDATA) stays."""
    bare = F.regexp_replace(xml, rf"(?s)^{SPACE}*<\?xml.*?\?>{SPACE}*", "")
    return F.regexp_replace(bare, rf"(?is)^{SPACE}*<!DOCTYPE[^\[>]*(?:\[.*?\]{SPACE}*)?>{SPACE}*", "")


def entities(xml: Column) -> Column:
    """Distinct entity references in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(xml, F.lit(ENTITY), F.lit(0)))


def _placeholder(i: Column) -> Column:
    return F.concat(F.lit("⁣e"), i.cast("string"), F.lit("⁣"))


def mask_entities(xml: Column, names: Column) -> Column:
    """Each entity of ``names`` becomes a numbered placeholder, everywhere."""
    return F.aggregate(F.transform(names, lambda n, i: F.struct(n.alias("n"), i.alias("i"))), xml, lambda acc, e: F.replace(acc, e["n"], _placeholder(e["i"])))


def unmask_entities(masked: Column, names: Column) -> Column:
    return F.aggregate(F.reverse(F.transform(names, lambda n, i: F.struct(n.alias("n"), i.alias("i")))), masked, lambda acc, e: F.replace(acc, _placeholder(e["i"]), e["n"]))


def fold_characters(text: Column) -> Column:
    """Straight and curly quotation marks and their entities as one."""
    return F.replace(F.replace(F.translate(text, "’“”", "'\"\""), F.lit("&apos;"), F.lit("'")), F.lit("&quot;"), F.lit('"'))


def strip_comments(xml: Column, keep_injections: bool = True) -> Column:
    kept = r"(?!\s*Inject[A-Za-z]*\s*:\s*T?\d+)" if keep_injections else ""
    return F.regexp_replace(xml, rf"(?s)<!--{kept}.*?-->", "")


def fold_injections(xml: Column) -> Column:
    return F.regexp_replace(xml, r"<!--\s*Inject\s*:\s*T?\d+\s*-->", "<!-- InjectPlaceholder: 0 -->")


def drop_xmlns(xml: Column) -> Column:
    return F.regexp_replace(xml, r"""\s+xmlns=(?:"http://docbook\.org/ns/docbook"|'http://docbook\.org/ns/docbook')""", "")


def rename_root(xml: Column, name: Column) -> Column:
    """Give the document element another name, at its start and end."""
    x = F.regexp_replace(xml, F.lit(r"^(\s*)<[A-Za-z_][\w.:-]*"), F.concat(F.lit("$1<"), name))
    return F.regexp_replace(x, F.lit(r"</[A-Za-z_][\w.:-]*(\s*>\s*)$"), F.concat(F.lit("</"), name, F.lit("$1")))


def root_name(is_info: Column, version: Column) -> Column:
    return F.when(~is_info, "section").when(version >= "5", "info").otherwise("sectioninfo")


def unwrap(xml: Column, names: tuple[str, ...] = IGNORED_CONTAINERS) -> Column:
    return F.regexp_replace(xml, rf"</?\s*(?:{'|'.join(names)})(?:\s[^>]*)?>", "")


def drop_boilerplate(xml: Column) -> Column:
    return F.regexp_replace(xml, rf"""(?s)<para\s[^>]*role=["']{BOILERPLATE_ROLE}["'][^>]*>.*?</para>""", "")


def listing_language(name: Column) -> Column:
    out = F.when(F.lit(False), name)
    for old, new in LISTING_LANGUAGES.items():
        out = out.when(name == old, new)
    return out.otherwise(name)


#: A comment, character data, a tag, or a run of text; a < that opens nothing stands alone.
PIECE = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[^<>]*>|[^<]+|<"
_NAME = r"[A-Za-z_][\w.:-]*"
_ATTRIBUTE = r"""\s([\w.:-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>]+))?)"""


def pieces(xml: Column) -> Column:
    return F.regexp_extract_all(xml, F.lit(PIECE), F.lit(0))


def order_attributes(tag: Column) -> Column:
    """A start tag with its attributes in order of their names, double quotes around their values; those that don't count are dropped."""
    value = lambda a: F.replace(F.regexp_extract(a, r"""(?s)=\s*["'](.*)["']$""", 1), F.lit('"'), F.lit("&quot;"))
    shown = lambda a: F.when(a.rlike(r"""=\s*["']"""), F.concat(F.regexp_extract(a, r"^([\w.:-]+)", 1), F.lit('="'), value(a), F.lit('"'))).otherwise(a)
    kept = F.filter(F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(1)), lambda a: ~a.rlike(f"^(?:{UNCOMPARED})"))
    attrs = F.array_sort(F.transform(kept, shown))
    return F.concat(F.regexp_extract(tag, f"^(<{_NAME})", 1), F.array_join(F.transform(attrs, lambda a: F.concat(F.lit(" "), a)), ""), F.when(tag.endswith("/>"), "/>").otherwise(">"))


def _compared(piece: Column) -> Column:
    start, end = piece.rlike(f"^<{_NAME}"), piece.startswith("</")
    text = ~piece.startswith("<") | piece.startswith("<![CDATA[")
    return F.when(text, fold_characters(piece)).when(start, order_attributes(piece)).when(end, F.regexp_replace(piece, r"\s+>$", ">")).otherwise(piece)


def compared(xml: Column, strict: bool = False, root: Column | str | None = "section") -> Column:
    """The pieces of a text as far as they count: without preamble and comments, attributes in order, quotation marks folded, empty elements closed at once, the root renamed.

    Injections are one placeholder, unless strict. root: the name that all document elements get, None to leave them.
    """
    x = strip_comments(strip_preamble(xml))
    x = x if strict else fold_injections(x)
    x = F.regexp_replace(x, rf"<({_NAME})((?:\s[^<>]*)?)></{_NAME}\s*>", "<$1$2/>")
    x = x if root is None else rename_root(x, F.lit(root) if isinstance(root, str) else root)
    return F.transform(pieces(x), _compared)


def squeeze(parts: Column) -> Column:
    """Pieces one to a line, whitespace squeezed and trimmed; blank ones vanish."""
    thin = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, rf"{SPACE}+", " ")))
    return F.array_join(F.filter(thin, lambda p: p != ""), "\n")


def verbatim(parts: Column) -> Column:
    """The elements of which the layout counts, letter by letter, by name."""
    return once(F.array_join(parts, ""), lambda raw: F.concat(*(F.regexp_extract_all(raw, F.lit(rf"(?s)<{n}(?:\s[^<>]*)?>.*?</{n}>"), F.lit(0)) for n in VERBATIM)))


def canonical(xml: Column, strict: bool = False, root: Column | str | None = "section") -> Column:
    """What two formattings of the same content share; the layout of verbatim elements, which counts, stands behind it."""
    holds = F.coalesce(xml.rlike(rf"<(?:{'|'.join(VERBATIM)})[\s>]"), F.lit(False))
    kept = lambda parts: F.concat(F.lit("\n\n"), F.array_join(verbatim(parts), "\n"))
    return once(compared(xml, strict, root), lambda parts: F.concat(squeeze(parts), F.when(holds, kept(parts)).otherwise("")))


def canonical_key(xml: Column, root: Column | str | None = "section") -> Column:
    return F.sha2(canonical(xml, root=root), 256)


def strict_key(xml: Column, root: Column | str | None = "section") -> Column:
    """Like canonical_key, but injections must be the same."""
    return F.sha2(canonical(xml, True, root), 256)


def escape_title(title: Column) -> Column:
    return F.trim(F.regexp_replace(title, r"([\[\]])", r"\\$1"))


def resolve_title(own: Column, info: Column) -> Column:
    blank = lambda c: F.when(F.trim(c) != "", c)
    return escape_title(F.coalesce(blank(own), blank(info), F.lit("Untitled")))


def escape_xml(text: Column) -> Column:
    """Decode the five predefined entities, then encode; curly quotation marks count as straight ones."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    text = F.translate(text, "’“”", "'\"\"")
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def escape_regex(text: Column) -> Column:
    return F.regexp_replace(text, r"([.*+?^${}()|\[\]/\\-])", r"\\$1")


def collapse_space(text: Column) -> Column:
    return F.regexp_replace(text, rf"{SPACE}+", " ")


def strip_numbering(title: Column) -> Column:
    return F.regexp_replace(title, r"^[0-9]+(\.[0-9]+)*\.?[ \t\n\r\f\x0B]*", "")


def percent(x: Column) -> Column:
    return F.concat(F.format_string("%.2f", x), F.lit("% "))


def xml_base(xml: Column) -> Column:
    base = F.nullif(F.regexp_extract(xml, r"""xml:base=["']([^"']*)["']""", 1), F.lit(""))
    return F.when(base.isin(".", "./"), None).when(base.endswith("/"), base).otherwise(F.concat(base, F.lit("/")))


def fill_attributes(text: Column, attributes: Column) -> Column:
    """Replace {name} by the trimmed value of each entry of a map."""
    return F.aggregate(F.map_entries(attributes), text, lambda acc, e: F.replace(acc, F.concat(F.lit("{"), e["key"], F.lit("}")), F.trim(e["value"])))


def revision_number(number: Column) -> Column:
    return F.when(number.rlike(r"^\d+\.\d+$"), F.replace(number, F.lit("."), F.lit("-"))).otherwise(number)


def indent(depth: Column) -> Column:
    return F.repeat(F.lit(" "), (depth * 2).cast("int"))


def element(name: Column, body: Column, xml_id: Column | None = None) -> Column:
    attr = F.coalesce(F.concat(F.lit(' id="'), xml_id, F.lit('"')), F.lit("")) if xml_id is not None else F.lit("")
    return F.concat(F.lit("<"), name, attr, F.lit(">"), body, F.lit("</"), name, F.lit(">"))


def container_name(name: Column, depth: Column, article: Column) -> Column:
    plain = F.when(name.rlike("^(sect[1-5]|simplesect|section)$"), "section").otherwise(name)
    return F.when((plain == "section") & (depth == 0) & ~article, "chapter").otherwise(plain)


def xpath_substring(text: Column, start: Column, length: Column) -> Column:
    """XPath 1.0: positions from start up to but without start + length, those below 1 lost."""
    first = F.floor(start + F.lit(0.5))
    stop = first + F.floor(length + F.lit(0.5))
    begin = F.greatest(first, F.lit(1))
    return F.substring(text, begin.cast("int"), F.greatest(stop - begin, F.lit(0)).cast("int"))


def xpath_round(x: Column) -> Column:
    return F.floor(x + F.lit(0.5))


def normalize_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r ]+", " "))


_LINKEND = r"""\blinkend=(?:"[^"]*"|'[^']*')"""
#: Links within a book, whole elements.
LINKS = rf"(?s)<xref\b[^>]*?{_LINKEND}[^>]*?(?:/>|>\s*</xref>)|<link\b[^>]*?{_LINKEND}[^>]*?(?:/>|>.*?</link>)"


def linkend(link: Column) -> Column:
    """The id that a link names, in either kind of quotation marks."""
    return F.regexp_extract(link, r"""\blinkend=["']([^"']*)["']""", 1)


def linkends(xml: Column) -> Column:
    """The ids that the links of a text name, in order."""
    return F.transform(F.regexp_extract_all(xml, F.lit(LINKS), F.lit(0)), linkend)


def injections(xml: Column) -> Column:
    """The topics that injections name, in order: 12, T3."""
    return F.regexp_extract_all(xml, F.lit(r"<!--\s*Inject\s*:\s*(T?\d+)\s*-->"), F.lit(1))


#: Elements of which the text is kept letter by letter.
LITERAL = "userinput|computeroutput"


def fold_xrefs(xml: Column, ids: Column) -> Column:
    """Links to ids of an array become the placeholder that injections fold to; a null array counts as empty."""
    known = F.coalesce(ids, F.array().cast("array<string>"))

    def put(acc, piece):
        return F.when(F.array_contains(known, linkend(piece)), F.replace(acc, piece, F.lit("<!-- InjectPlaceholder: 0 -->"))).otherwise(acc)

    return F.aggregate(F.array_distinct(F.regexp_extract_all(xml, F.lit(LINKS), F.lit(0))), xml, put)


def repair_comments(xml: Column) -> Column:
    """Comments begun again within a comment lose their second beginning."""
    broken = F.filter(F.array_distinct(F.regexp_extract_all(xml, F.lit("(?s)<!--.*?-->"), F.lit(0))), lambda c: F.contains(F.substring(c, 5, 1 << 30), F.lit("<!--")))
    return F.aggregate(broken, xml, lambda acc, c: F.replace(acc, c, F.concat(F.lit("<!--"), F.replace(F.substring(c, 5, 1 << 30), F.lit("<!--"), F.lit("")))))


def literal_text(xml: Column) -> Column:
    """Text under literal elements as character data, entities decoded; what is character data already stays."""

    def decode(t: Column) -> Column:
        for name, c in {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}.items():
            t = F.replace(t, F.lit(f"&{name};"), F.lit(c))
        return t

    def wrap(piece: Column) -> Column:
        runs = F.array_distinct(F.regexp_extract_all(piece, F.lit(r"(?s)(?<=>)[^<>]+(?=<)"), F.lit(0)))
        return F.aggregate(runs, piece, lambda acc, r: F.replace(acc, F.concat(F.lit(">"), r, F.lit("<")), F.concat(F.lit("><![CDATA["), decode(r), F.lit("]]><"))))

    pieces = F.filter(F.array_distinct(F.regexp_extract_all(xml, F.lit(rf"(?s)<({LITERAL})\b[^>]*>.*?</\1>"), F.lit(0))), lambda p: ~F.contains(p, F.lit("<![CDATA[")))
    return F.aggregate(pieces, xml, lambda acc, p: F.replace(acc, p, wrap(p)))


def strip_attributes(xml: Column, name: str | None = None, only: str | None = None) -> Column:
    """The first start tag (of that name, if given) without its attributes, or without one of them."""
    tag = F.regexp_extract(xml, rf"<{name or _NAME}(?=[\s/>])[^<>]*>", 0)
    bare = F.regexp_replace(tag, r"\s+[\w.:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*')" if only is None else rf"\s+{only}\s*=\s*(?:\"[^\"]*\"|'[^']*')", "")
    at = F.instr(xml, tag)
    return F.when(tag == "", xml).otherwise(F.concat(F.substring(xml, F.lit(1), at - 1), bare, F.substring(xml, at + F.length(tag), F.length(xml))))


def xml_format(book_type: Column, option: Column) -> Column:
    """The format of a book: that of its settings, else that of the kind of import."""
    return F.when(book_type.isNotNull(), F.when(book_type == "5.0", "5.0").otherwise("4.5")).when(option == "5.0", "5.0").otherwise("4.5")


def import_mode(spec_id: Column, reuse: Column) -> Column:
    """Whether an import updates an outline, reuses topics, or creates all of them."""
    return F.when(spec_id.isNotNull(), "updating").when(reuse, "reusing").otherwise("creating")


def _box(container: Column) -> Column:
    name = F.lower(container)
    return F.when(name.isin("chapter", "section"), name).otherwise(F.raise_error(F.lit("a container can only be a chapter or a section")))


def open_element(container: Column, title: Column, content: Column | None = None) -> Column:
    """The beginning of a chapter or section: its title and, given as an array of lines, its first content. Any other name fails."""
    lines = F.lit("") if content is None else F.concat(F.array_join(F.transform(content, lambda c: F.concat(c, F.lit("\n"))), ""), F.lit("\n"))
    return F.concat(F.lit("<"), _box(container), F.lit(">\n<title>"), escape_title(title), F.lit("</title>\n"), lines)


def close_element(container: Column) -> Column:
    return F.concat(F.lit("</"), _box(container), F.lit(">"))


def topic_element(title: Column, content: Column) -> Column:
    """A section of its own."""
    return F.concat(open_element(F.lit("section"), title, content), F.lit("</section>\n"))


def long_timestamp(ts: Column) -> Column:
    """Thursday, March 5th 2015, 4:07:09 pm."""
    day = F.dayofmonth(ts)
    suffix = F.when(day.between(11, 13), "th").otherwise(F.element_at(F.array(*(F.lit(x) for x in ("th", "st", "nd", "rd", "th", "th", "th", "th", "th", "th"))), day % 10 + 1))
    half = F.when(F.hour(ts) < 12, "am").otherwise("pm")
    return F.concat(F.date_format(ts, "EEEE, MMMM d"), suffix, F.date_format(ts, " yyyy, h:mm:ss "), half)


def flatten_paras(parts: Column, name: str = "para") -> Column:
    """An array of tags and texts inside a paragraph without paragraphs nested in it: the outer one ends before each and begins anew behind it."""
    start, end = f"<{name}>", f"</{name}>"
    opened = F.flatten(F.transform(parts, lambda p: F.when(p == start, F.array(F.lit(end), p)).when(p == end, F.array(p, F.lit(start))).otherwise(F.array(p))))
    return strip_empty(F.concat(F.array(F.lit(start)), opened, F.array(F.lit(end))), name)


def strip_empty(parts: Column, name: str = "para") -> Column:
    """An array of tags and texts without elements of that name that hold nothing."""
    start, end = f"<{name}>", f"</{name}>"
    walk = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when((p == end) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) == start), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, p)))
    return walk


def max_columns(rows: Column) -> Column:
    """The widest of a table's rows, each a list of cells."""
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))
