"""Operators that no table of the driver exercises, on small fixtures."""

import io
import random
import zipfile

from conftest import SF
from pyspark.sql import functions as F

from inkloom.functions import text as X
from inkloom.operators import graph, markup, matching, outline, rules
from inkloom.sources import files, store
from inkloom.streaming import ingest


def one(spark, expr, **cols):
    df = spark.range(1)
    for k, v in cols.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(expr).first()[0]


def test_canonical_forms(spark):
    a = '<section  xmlns="http://docbook.org/ns/docbook">\n  <title>It’s</title><!-- note --> </section>'
    b = "<section><title>It&apos;s</title></section>"
    ka, kb = (one(spark, X.canonical_key(F.col("x")), x=x) for x in (a, b))
    assert ka == kb
    inject = "<section><!-- Inject: %d --></section>"
    assert one(spark, X.canonical_key(F.col("x")), x=inject % 1) == one(spark, X.canonical_key(F.col("x")), x=inject % 2)
    assert one(spark, X.strict_key(F.col("x")), x=inject % 1) != one(spark, X.strict_key(F.col("x")), x=inject % 2)
    assert one(spark, X.canonical(X.canonical(F.col("x"))), x=a) == one(spark, X.canonical(F.col("x")), x=a)


def test_text_functions(spark):
    assert one(spark, X.strip_preamble(F.col("x")), x='<?xml version="1.0"?>\n<!DOCTYPE a [<!ENTITY b "c">]>\n<a><![CDATA[<?xml?>]]></a>') == "<a><![CDATA[<?xml?>]]></a>"
    assert one(spark, X.strip_comments(F.col("x")), x="a<!-- Inject: 12 -->b<!-- c -->d") == "a<!-- Inject: 12 -->bd"
    assert one(spark, X.fold_injections(F.col("x")), x="<!-- Inject: T3 -->") == "<!-- InjectPlaceholder: 0 -->"
    assert one(spark, X.unwrap(F.col("x")), x='<partintro id="a"><para/></partintro>') == "<para/>"
    assert one(spark, X.drop_boilerplate(F.col("x")), x='<para role="RoleCreateBugPara">x</para><para>y</para>') == "<para>y</para>"
    assert one(spark, X.xml_base(F.col("x")), x='<a xml:base="b/c"/>') == "b/c/"
    assert one(spark, X.xml_base(F.col("x")), x='<a xml:base="./"/>') is None
    assert one(spark, X.listing_language(F.col("x")), x="ini") == "INI Files"
    assert one(spark, X.revision_number(F.col("x")), x="1.2") == "1-2"
    assert one(spark, X.xpath_substring(F.col("x"), F.lit(0), F.lit(3)), x="12345") == "12"
    assert one(spark, outline.wrap_list(F.array(F.lit("a" * 119), F.lit("b"), F.lit("c")))) == "# " + "a" * 119 + ",\n# b, c"


def test_mask_roundtrip(spark):
    text = "&a; &b; &a; &aa; &;x"
    df = spark.createDataFrame([(text,)], "x string").withColumn("n", X.entities(F.col("x"))).withColumn("m", X.mask_entities(F.col("x"), F.col("n")))
    row = df.select("m", X.unmask_entities(F.col("m"), F.col("n")).alias("back")).first()
    assert row.back == text and "&a;" not in row.m


def test_shred_and_axes(spark):
    xml = "<a><b id='1'>t<c/></b><b/></a>"
    df = spark.createDataFrame([(1, xml), (2, "<broken"), (3, None)], "doc_id long, xml string")
    n = markup.nodes(df, "doc_id", "xml", xml=True).cache()
    assert [(r.name, r.depth) for r in n.orderBy("doc_id", "node_id").collect()] == [("a", 0), ("b", 1), ("#text", 2), ("c", 2), ("b", 1)]
    ends = {axis: n.alias("l").where("l.name = 'c'").join(n.alias("r"), markup.axis(n, "doc_id", axis)).count() for axis in ("ancestor", "parent", "following", "preceding", "preceding-sibling", "self", "descendant")}
    assert ends == {"ancestor": 2, "parent": 1, "following": 1, "preceding": 1, "preceding-sibling": 1, "self": 1, "descendant": 0}
    assert one(spark, X.canonical(F.col("x"), root=None), x="<a z=\"1\" b='2' version=\"5\"></a>") == "<a b=\"2\" z=\"1\"/>"


def test_page_sections():
    html = "<h1>1. One</h1><h3>Deep</h3><p>x <b>y</b> <a href='/z'>z</a></p><pre name='code' class='sh'>a &lt; b</pre><table><tr><th>H</th><th>I</th></tr><tr><td rowspan='2'>1</td><td>2</td></tr><tr><td>3</td></tr></table><ul><li>p<ol><li>q</li></ol></li></ul>"
    got = markup.page_sections(html, "http://h/")
    assert [(level, title) for _, level, title, _ in got] == [(1, "One"), (2, "Deep")]
    body = got[1][3]
    assert '<para>x <emphasis role="bold">y</emphasis> <ulink url="http://h/z">z</ulink></para>' in body
    assert '<programlisting language="sh">a &lt; b</programlisting>' in body
    assert 'morerows="1"' in body and "<thead><row><entry>H</entry><entry>I</entry></row></thead>" in body
    assert "<itemizedlist><listitem><para>p</para><orderedlist><listitem><para>q</para></listitem></orderedlist></listitem></itemizedlist>" in body


def test_book(spark):
    xml = "<book><title>B</title><chapter id='c1'><title>C</title><section id='s1'><title>S</title><para>x</para></section></chapter><chapter id='c2'><title>D</title><para>y</para></chapter></book>"
    got = markup.shred_book(spark.createDataFrame([(1, xml)], "doc_id long, xml string"), "doc_id", "xml").orderBy("node_id").collect()
    assert [(r.kind, r.title, r.xml_id, r.target_num) for r in got] == [("container", "C", "c1", 1), ("topic", "S", "s1", None), ("topic", "D", "c2", None)]


def test_archives_and_lookup(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("b/Main.xml", "<book >x</book>")
        z.writestr("a.xml", "<article>y</article>")
        z.writestr("publican.cfg", "# c\nmainfile: \"Main\"\nmainfile: Other\nurl: http://x\n")
    (tmp_path / "x.zip").write_bytes(buf.getvalue())
    (tmp_path / "bad.zip").write_bytes(b"no archive")
    got = files.read_archives(spark, str(tmp_path)).cache()
    assert got.where("error is not null").count() == 1
    ok = got.where("error is null").select("source_id", "path", "content")
    assert files.main_file(ok).first().main_file == "a.xml"
    wanted = ok.select("source_id").distinct().select("source_id", F.lit("B/MAIN.XML").alias("name"))
    assert files.lookup(ok, wanted, ignore_case=True).first().content == b"<book >x</book>"
    cfg = ok.where("path = 'publican.cfg'").select("path", F.decode("content", "UTF-8").alias("text"))
    assert {(r.name, r.value) for r in files.settings(cfg).collect()} == {("mainfile", "Main")}
    assert files.book_problems(ok, "en-US").first().problems == ["no text"]
    folder = tmp_path / "f"
    (folder / "d").mkdir(parents=True)
    (folder / "d" / "e.txt").write_text("z")
    assert [r.path for r in files.read_folder(spark, str(folder)).collect()] == ["d/e.txt"]


def test_store(spark):
    env = spark.createDataFrame([('{"size":1,"items":[{"item":{"id":7,"xml":"<a/>","xmlFormat":"5.0","locale":{"id":1}}}]}',)], "json string")
    assert tuple(store.from_envelope(env).first()) == (7, "<a/>", "5.0", 1)
    new = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "content string")
    old = spark.createDataFrame([(5, "b")], "store_id long, content string")
    got = store.create_or_match(new, old).collect()
    assert sorted((r.store_id, r.matched) for r in got) == [(5, True), (6, False), (7, False)]
    body = spark.createDataFrame([("throw 'x';\n" + '{"list":[{"content":{"text":"<p/>"}}]}',)], "body string")
    assert store.page_source(body).first().html == "<p/>"


def test_includes(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b"), ("a", "d")], "path string, child string")
    got = {(r.root, r.path, r.cyclic) for r in graph.include_closure(spark, edges).collect() if r.root == "a"}
    assert got == {("a", "b", True), ("a", "c", False), ("a", "d", False)}


def test_graph_resolution(spark):
    """A chain that holds, one that contradicts itself, a container that doesn't fit, a free topic."""
    t = "component long, topic_seq int, store_id long, dst_kind string, dst long, dst_target int, required_ref string"
    data = [
        (1, 1, 10, "topic", 2, None, "20"), (1, 2, 20, "topic", 1, None, "10"), (1, 2, 21, None, None, None, None),
        (2, 1, 10, "topic", 2, None, "20"), (2, 2, 21, None, None, None, None),
        (3, 1, 10, "container", 5, 3, "T4"), (3, 2, 11, "container", 5, 3, "T3"),
        (4, 1, 9, None, None, None, None), (4, 1, 8, None, None, None, None),
    ]
    got = {(r.component, r.topic_seq): r.store_id for r in graph.resolve(spark.createDataFrame(data, t)).collect()}
    assert got == {(1, 1): 10, (1, 2): 20, (2, 1): None, (2, 2): 21, (3, 1): None, (3, 2): 11, (4, 1): 8}


def test_similar_against_brute_force(spark):
    random.seed(3)
    texts = []
    for _ in range(30):
        w = [random.choice("abcdefghij") * random.randint(1, 3) for _ in range(random.randint(0, 60))]
        texts += [" ".join(w), " ".join(w[:-1] + ["zz"]), " ".join(w)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    pairs, classes = matching.similar(df, "id", "text")
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t in enumerate(texts)}
    rep = {i: min(j for j in sets if sets[j] == s) for i, s in sets.items() if s}
    assert {r.id: r.rep for r in classes.collect()} == rep
    reps = sorted(set(rep.values()))
    want = {(a, b) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])}
    assert {(r.a, r.b) for r in pairs.collect()} == want


def test_greedy(spark):
    """Exact matches first, then the first candidate left, then an equal topic of the batch, else new."""
    c = [(1, 1, 0, 5, False, "a"), (1, 2, 0, 5, True, "b"), (1, 1, 2, 6, False, "a"), (1, 1, 1, 7, False, "a"), (1, 3, 0, 7, False, "b"), (1, 4, 0, None, False, "x"), (1, 5, 0, None, False, "a"), (2, 1, 0, 5, False, None), (2, 2, 0, 5, False, None)]
    got = {(r.spec, r.topic_seq): (r.status, r.store_id) for r in matching.greedy(spark.createDataFrame(c, "spec long, topic_seq int, place int, store_id long, equivalent boolean, batch_key string")).collect()}
    assert got == {(1, 1): ("SIMILAR", 7), (1, 2): ("EXACT", 5), (1, 3): ("MATCHED", 5), (1, 4): ("NEW", None), (1, 5): ("MATCHED", 7), (2, 1): ("SIMILAR", 5), (2, 2): ("NEW", None)}


def test_rules_and_targets(spark):
    p = spark.createDataFrame([(1, 1, "x", True), (1, 2, "x", None)], "doc_id long, ord int, font string, bold boolean")
    r = spark.createDataFrame([(1, "x", True, "title", False), (2, "x", None, "para2", True)], "rule_no int, font string, bold boolean, element string, merge boolean")
    assert [x.element for x in rules.classify(p, r, ["font", "bold"]).orderBy("ord").collect()] == ["title", "para2"]
    c = spark.createDataFrame([(1, 2, "a", "x"), (1, 2, "a", "y"), (1, 3, "a", "x")], "topic_key long, store_id long, target_xml_id string, required_ref string")
    assert [tuple(r) for r in graph.conflicts(c).collect()] == [(1, 2)]


def test_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id long, text string")
    df.write.parquet(str(tmp_path / "in"))
    q = ingest.ingest(ingest.follow(spark, str(tmp_path / "in"), df.schema), lambda b: matching.reuse(b, "doc_id", "text"), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).where("status = 'REUSED'").count() == 1


def test_all_orders_are_resolved(spark):
    from inkloom.plans import catalog

    got = catalog.queries()["graph_resolution"](spark, SF)
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    assert got.count() == orders.count() and {r[0] for r in got.select("component").distinct().collect()} == {r[0] for r in orders.select("o_custkey").distinct().collect()}


def test_closure_of_all_parts(spark):
    from inkloom.plans import catalog

    got = {(r.root, r.path): r.depth for r in catalog.queries()["include_closure"](spark, "/root/testdata/sf0.1").collect()}
    keys = [r[0] for r in spark.read.parquet("/root/testdata/sf0.1/part.parquet").select("p_partkey").collect()]
    assert got == {(k, k >> d): d for k in keys for d in range(1, k.bit_length())}


def test_closure_equals_its_trails(spark):
    """Random graphs with circles, and a chain of more than 64 files."""
    random.seed(8)
    for _ in range(3):
        edges = {(random.randrange(9), random.randrange(9)) for _ in range(13)}
        want, todo = {}, [(a, a, (a,)) for a in {a for a, _ in edges}]
        while todo:
            root, at, trail = todo.pop()
            for a, b in edges:
                if a == at:
                    depth, met = want.get((root, b), (99, False))
                    want[root, b] = (min(depth, len(trail)), met or b in trail)
                    todo += [] if b in trail else [(root, b, (*trail, b))]
        got = {(r.root, r.path): (r.depth, r.cyclic) for r in graph.include_closure(spark, spark.createDataFrame(sorted(edges), "path long, child long")).collect()}
        assert got == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "path long, child long")
    assert graph.include_closure(spark, chain.where("path >= 0")).where("root = 0").agg(F.max("depth")).first()[0] == 70


def test_nothing_nests_too_deep():
    """Ten thousand levels of markup, lists and inclusions don't exhaust a stack."""
    from inkloom.operators import office, splice

    n = 10_000
    assert len(markup.page_sections("<h1>a</h1><p>" + "<b>" * n + "x", None)) == 1
    assert markup.page_sections("<h1>a</h1>" + "<ul><li>" * n + "x", None)[0][3].count("<listitem>") == n
    assert markup.page_sections("<h1>a</h1>" + "<table><tr><td>" * 500 + "x", None)[0][3].count("<entrytbl") == 499
    xml = "<a>" * n + "x" + "</a>" * n
    assert markup.serialise(markup.shred_xml(xml)) == xml
    chain = {f"f{i}": f'<a><xi:include href="f{i + 1}"/></a>' for i in range(2000)} | {"f2000": "<z/>"}
    assert splice.expand_xml(chain, "f0").count("<a>") == 2000
    adoc = {f"f{i}": f"a\ninclude::f{i + 1}[]" for i in range(2000)} | {"f2000": "z"}
    assert splice.expand_asciidoc(adoc, "f0")[0].endswith("a\nz")
    spans = "<t:span>" * 3000 + "x" + "</t:span>" * 3000
    content = f'<d xmlns:o="o" xmlns:t="t"><o:body><o:text><t:h>h</t:h><t:p>{spans}</t:p>{"<t:list><t:list-item>" * 1000}<t:p>y</t:p>{"</t:list-item></t:list>" * 1000}</o:text></o:body></d>'
    (section,) = office._Office(content, "", []).sections()
    assert section[2].startswith("<para>x</para>") and section[2].count("<listitem>") == 1000


def test_headings_unwind():
    got = markup.page_sections("<h1>A</h1><h2>B</h2><h3>C</h3><h2>D</h2><p>x</p><h3>E</h3><h1>F <img src='i'> g</h1>", "http://h/")
    assert [(level, title) for _, level, title, _ in got] == [(1, "A"), (2, "D"), (1, "F")]
    assert got[-1][3] == '<para><mediaobject><imageobject><imagedata fileref="http://h/i"/></imageobject></mediaobject> g</para>'
    assert markup.page_sections("<h2></h2><p>x</p><h1>none</h1>", None) == [(0, 1, "Untitled", "<para>x</para>")]


def test_asciidoc_inclusions():
    from inkloom.operators import splice

    files = {"m": ":dir: sub\ninclude::{dir}/a[]\n// include::x[]\n////\ninclude::y[]\n////\ninclude::none[]end", "sub/a": "A include::b[]", "sub/b": "B"}
    text, names = splice.expand_asciidoc(files, "m")
    assert text == ":dir: sub\nA B\n// includecomment::x[]\n////\nincludecomment::y[]\n////\nend" and names == {"dir": " sub"}


def test_rules_of_any_number(spark):
    paras = spark.range(50).selectExpr("1 AS doc_id", "id AS ord", "concat('f', id) AS font", "id % 2 = 0 AS bold")
    many = spark.range(20_000).selectExpr("id + 2 AS rule_no", "concat('f', id) AS font", "CAST(NULL AS BOOLEAN) AS bold", "concat('e', id) AS element", "false AS merge")
    first = spark.sql("SELECT 1L AS rule_no, CAST(NULL AS STRING) AS font, true AS bold, 'strong' AS element, true AS merge")
    got = {r.ord: (r.element, r.merge) for r in rules.classify(paras, many.unionByName(first), ["font", "bold"]).collect()}
    assert got == {k: ("strong", True) if k % 2 == 0 else (f"e{k}", False) for k in range(50)}
    assert {r.element for r in rules.classify(paras, many.limit(0), ["font", "bold"]).collect()} == {"para"}
    all_ = spark.sql("SELECT 0L AS rule_no, CAST(NULL AS STRING) AS font, CAST(NULL AS BOOLEAN) AS bold, 'any' AS element, false AS merge")
    assert {r.element for r in rules.classify(paras, many.unionByName(all_), ["font", "bold"]).collect()} == {"any"}


def test_builders_refuse_other_names(spark):
    import pytest

    with pytest.raises(Exception, match="chapter or a section"):
        one(spark, X.open_element(F.lit("part"), F.lit("t")))


def test_numbered(spark):
    from inkloom.operators import order

    df = spark.range(5000).selectExpr("id", "id % 3 AS k")
    got = [r.id for r in order.numbered(df, "k", F.desc("id")).orderBy("place").collect()]
    assert got == sorted(range(5000), key=lambda i: (i % 3, -i)) and order.numbered(df.limit(0), "k").count() == 0


def test_comparison_of_variants(spark):
    """What counts, and what doesn't, between two formattings."""
    same = [('<title a="1" b="2"/>', "<title b='2' a='1'></title>"), ("<section><p>x</p></section>", "<chapter>\n <p> x\t</p>\n</chapter>"), ('<?xml version="1.0"?><!DOCTYPE a [<!ENTITY b "c">]><a x="1" version="5">t</a>', '<a remap="q" x="1">t</a>'), ("<a>&nbsp;a<!-- c -->b</a>", "<a>&nbsp;ab</a>")]
    other = [("<p><screen>a  b</screen></p>", "<p><screen>a b</screen></p>"), ("<p x='a'/>", "<p x='b'/>"), ("<p>&nbsp;</p>", "<p>&mdash;</p>"), ("<p><date>1 </date></p>", "<p><date>1</date></p>")]
    df = spark.createDataFrame([(a, b, True) for a, b in same] + [(a, b, False) for a, b in other], "a string, b string, want boolean")
    bad = df.where((X.canonical_key(F.col("a")) == X.canonical_key(F.col("b"))) != F.col("want")).collect()
    assert not bad
