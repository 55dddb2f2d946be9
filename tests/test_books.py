"""Inclusion, injections, front matter, office texts and the rarer URL functions, on small fixtures."""

import pytest
from pyspark.sql import functions as F

from inkloom.functions import text as X
from inkloom.functions import urls as U
from inkloom.operators import frontmatter, office, rules, splice

XI = 'xmlns:xi="http://www.w3.org/2001/XInclude"'


def one(spark, expr, value):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


def test_xml_inclusion():
    files = {
        "en/Book.xml": f'<?xml version="1.0"?>\n<book {XI}><xi:include href="./a.xml"/><xi:include href="Common_Content/L.xml"/><xi:include/><!-- <xi:include href="a.xml"/> --><xi:include href="none.xml"><xi:fallback><xi:include href="n.txt" parse="text"/></xi:fallback></xi:include></book>',
        "en/A.xml": '<?xml version="1.0"?><!DOCTYPE chapter [<!ENTITY y "z">]>\n<chapter xml:base="sub"><para>&y;</para><imagedata fileref="i.png"/><xi:include href="b.xml" xpointer="xpointer(//para[@id=\'p\'])"/></chapter>',
        "en/sub/b.xml": '<section><para id="p">&y; in</para><para>out</para></section>',
        "en/sub/i.png": None,
        "en/n.txt": "1 < 2",
    }
    got = splice.expand_xml(files, "en/Book.xml")
    assert '<chapter xml:base="sub"><para>&y;</para><imagedata fileref="en/sub/i.png"/><para id="p">&y; in</para></chapter>' in got
    assert '<xi:include href="Common_Content/L.xml"/>' in got and '<!-- <xi:include href="a.xml"/> -->' in got
    assert got.endswith("1 &lt; 2</book>") and "<xi:include/>" not in got
    assert splice.expand_xml({"a": None}, "a") == "" and splice.expand_xml({}, "a") == ""


def test_inclusion_by_source(spark):
    files = spark.createDataFrame([("s", "a.xml", '<a><xi:include href="b.xml"/></a>'), ("s", "b.xml", '<b><xi:include href="a.xml"/></b>'), ("t", "a.xml", "<a/>"), ("u", "m.adoc", ":d: sub \ninclude::{d}/x.adoc[]\n// include::x.adoc[]\n////\ninclude::x.adoc[]\n////\ninclude::none[]!"), ("u", "sub/x.adoc", "$1")], "source string, path string, text string")
    roots = spark.createDataFrame([("s", "a.xml"), ("t", "a.xml")], "source string, path string")
    got = {r.source: r for r in splice.expand(files, roots).collect()}
    assert got["s"].error == "a.xml > b.xml > a.xml" and got["s"].text is None
    assert got["t"].text == "<a/>" and got["t"].error is None
    adoc = splice.expand(files, spark.createDataFrame([("u", "m.adoc")], "source string, path string"), "asciidoc").first()
    assert adoc.text == ":d: sub \n$1\n// includecomment::x.adoc[]\n////\nincludecomment::x.adoc[]\n////\n!"
    assert splice.expand(files.limit(0), roots.limit(0)).count() == 0
    with pytest.raises(ValueError):
        splice.expand(files, roots, "other")


def test_injections(spark):
    topics = spark.createDataFrame([(1, 1, '<p><xref linkend="a"/><link linkend="a">t</link><link linkend="c">u</link><xref linkend="z"/></p>'), (1, 2, None), (2, 1, "<p/>")], "doc_id int, seq int, xml string")
    refs = spark.createDataFrame([(1, "a", "7"), (1, "c", "T2"), (2, "z", "9")], "doc_id int, linkend string, ref string")
    got = {(r.doc_id, r.seq): r.xml for r in splice.inject_links(topics, refs).collect()}
    assert got[1, 1] == '<p><!--Inject: 7--><!--Inject: 7--><!--<link linkend="a">t</link>--><!--Inject: T2--><xref linkend="z"/></p>'
    assert got[1, 2] is None and got[2, 1] == "<p/>"
    pairs = spark.createDataFrame([("<a> b</a>", "<a>b</a>"), ("<a>b</a>", "<a>c</a>"), (None, "<a/>")], "x string, y string")
    assert [r[0] for r in pairs.select(splice.changed(F.col("x"), F.col("y"))).collect()] == [False, True, True]


def test_front_matter(spark):
    book = """<book><bookinfo><abstract id="ab"><para>A</para></abstract><authorgroup id="g"><author/></authorgroup><legalnotice><title>Terms</title></legalnotice></bookinfo>
    <chapter><chapterinfo id="i"><title>Lifted</title><date>1</date></chapterinfo><chapterinfo/><section/></chapter>
    <appendix id="r"><title>Changes</title><simplelist/><revhistory><revision><revnumber>1.2</revnumber><date> today </date></revision></revhistory></appendix></book>"""
    rows = frontmatter.front_matter(spark.createDataFrame([(1, book), (2, None), (3, "<a")], "k int, x string"), "k", "x").orderBy("place").collect()
    assert [(r.kind, r.title, r.xml_id) for r in rows] == [("revision_history", "Changes", "r"), ("author_group", "Author Group", "g"), ("legal_notice", "Terms", None), ("abstract", "Abstract", "ab"), ("info", "Lifted", "i")]
    assert "<revnumber>1-2</revnumber><date>today</date>" in rows[0].xml
    assert rows[3].xml == "<abstract><para>A</para></abstract>" and rows[4].xml == "<chapterinfo><date>1</date></chapterinfo>"
    nested = "<book><appendix><revhistory/><section/></appendix></book>"
    r = frontmatter.front_matter(spark.createDataFrame([(1, nested)], "k int, x string"), "k", "x").first()
    assert r.xml == "<appendix><title>Revision History</title><revhistory /></appendix>"


NS = 'xmlns:office="o" xmlns:text="t" xmlns:table="b" xmlns:style="s" xmlns:fo="f" xmlns:xlink="x" xmlns:draw="d" xmlns:dc="c"'


def test_office_text(spark):
    styles = f'<office:document {NS}><style:style style:name="Base"><style:text-properties fo:font-family="Mono" fo:font-weight="bold"/></style:style></office:document>'
    content = f"""<office:document {NS}><style:style style:name="C" style:parent-style-name="Base"><style:text-properties fo:font-weight="normal"/></style:style>
    <style:style style:name="B"><style:text-properties fo:font-weight="bold"/></style:style>
    <text:list-style style:name="L"><text:list-level-style-number text:level="1" style:num-format="a"/></text:list-style>
    <office:body><office:text><text:p>lost</text:p><text:h text:outline-level="1">1.2 One</text:h><text:section><text:h text:outline-level="4">Two</text:h></text:section>
    <text:p>a<text:s text:c="2"/><text:span text:style-name="B">b</text:span><text:a xlink:href="u&amp;v">l</text:a><office:annotation><dc:creator>Me</dc:creator><text:p>n</text:p></office:annotation></text:p>
    <text:p text:style-name="C">x&lt;</text:p><text:p text:style-name="C">y</text:p><text:p><draw:frame text:anchor-type="as-char"><draw:image xlink:href="i.png"/></draw:frame></text:p>
    <text:list text:style-name="L"><text:list-item><text:p>i</text:p><text:list><text:list-item><text:p>j</text:p></text:list-item></text:list></text:list-item></text:list>
    <table:table><table:table-row><table:table-cell table:number-columns-spanned="2"><text:p>c</text:p></table:table-cell><table:covered-table-cell/></table:table-row></table:table>
    </office:text></office:body></office:document>"""
    rules_ = [{"font": "Mono", "bold": False, "element": "screen", "merge": True}]
    files = spark.createDataFrame([("z", "content.xml", content), ("z", "styles.xml", styles), ("y", "content.xml", content)], "source string, path string, text string")
    rows = office.office_sections(office.archives(files), "source", "content", "styles", rules_).orderBy("place").collect()
    assert [(r.source, r.level, r.title, r.kind) for r in rows] == [("z", 1, "One", "container"), ("z", 2, "Two", "topic")]
    body = rows[1].body
    assert '<para>a  <emphasis role="bold">b</emphasis><ulink url="u&amp;v">l</ulink><remark><emphasis>Me </emphasis>n</remark></para>' in body
    assert "<screen>x&lt;\ny</screen>" in body and '<inlinemediaobject><imageobject><imagedata fileref="i.png"/>' in body
    assert '<orderedlist numeration="loweralpha"><listitem><para>i</para><itemizedlist><listitem><para>j</para></listitem></itemizedlist></listitem></orderedlist>' in body
    assert '<entry namest="c1" nameend="c2"><para>c</para></entry>' in body
    none = spark.createDataFrame([(1, None, None), (2, "<a", "")], "k int, c string, s string")
    assert office.office_sections(none, "k", "c", "s").count() == 0


def test_rarer_url_functions(spark):
    assert one(spark, lambda x: U.public_suffix(x, ["co.uk"]), "www.a.co.uk") == "co.uk"
    assert one(spark, lambda x: U.registered_domain(x, ["co.uk"]), "www.a.co.uk") == "a.co.uk"
    assert one(spark, lambda x: U.registered_domain(x, []), "localhost") == "localhost"
    assert one(spark, U.mime_type, "a/B.PNG") == "image/png" and one(spark, U.mime_type, "a.b/c") == "application/octet-stream"
    assert one(spark, lambda x: U.mime_type(x, {"adoc": "text/asciidoc"}), "x.adoc") == "text/asciidoc"
    assert one(spark, U.compact_ipv6, "[2001:db8:0:0:0:0:0:1]") == "[2001:db8::1]" and one(spark, U.compact_ipv6, "a.b") == "a.b" and one(spark, U.compact_ipv6, None) is None
    assert one(spark, U.to_punycode, "www.bücher.de") == "www.xn--bcher-kva.de" and one(spark, U.from_punycode, "www.xn--bcher-kva.de") == "www.bücher.de"
    values = F.create_map(F.lit("a"), F.lit("x y"), F.lit("p"), F.lit("/q"), F.lit("e"), F.lit(""))
    for template, want in {"{a}": "x%20y", "{+p}": "/q", "{#p}": "#/q", "{/a}": "/x%20y", "{?a,e,no}": "?a=x%20y&e=", "{;e}": ";e", "{a:1}!": "x!", "{no}": ""}.items():
        assert one(spark, lambda x: U.expand_template(x, values), template) == want


def test_repairs(spark):
    assert one(spark, X.repair_comments, "<a><!-- b <!-- c --> d <!-- e --></a>") == "<a><!-- b  c --> d <!-- e --></a>"
    ids = F.array(F.lit("a"))
    assert one(spark, lambda x: X.fold_xrefs(x, ids), '<p><xref linkend="a"/><link linkend="a">t</link><xref linkend="b"/></p>') == '<p><!-- InjectPlaceholder: 0 --><!-- InjectPlaceholder: 0 --><xref linkend="b"/></p>'
    assert one(spark, X.literal_text, "<p>x<userinput>a &lt; <b>c</b></userinput><userinput><![CDATA[<]]></userinput></p>") == "<p>x<userinput><![CDATA[a < ]]><b><![CDATA[c]]></b></userinput><userinput><![CDATA[<]]></userinput></p>"
    assert one(spark, X.repair_comments, None) is None and one(spark, X.literal_text, None) is None


def test_book_info(spark):
    books = [(1, "<book><title>Own</title><bookinfo><title>A  <b>b</b></title><productnumber> </productnumber><edition>2</edition></bookinfo><index/></book>"), (2, "<article><title>T</title></article>"), (3, "<a"), (4, None)]
    rows = frontmatter.book_info(spark.createDataFrame(books, "k int, x string"), "k", "x").orderBy("k").collect()
    assert tuple(rows[0]) == (1, "A <b>b</b>", None, "2", None, "Product", "1", True)
    assert tuple(rows[1]) == (2, "T", None, None, None, None, None, False)
    assert tuple(rows[2])[1:] == (None,) * 7 == tuple(rows[3])[1:]
