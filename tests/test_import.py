"""Odd texts, references, archives of many entries, the kept store, streams with state and the import run."""

import os
import random
import zipfile

import pytest

from pyspark.sql import functions as F

from inkloom.functions import urls as U
from inkloom.operators import book_import, markup, matching, office, splice
from inkloom.sources import files, store
from inkloom.streaming import ingest

# No text fails a job.


@pytest.mark.parametrize("html", ["<a href='http://[x'>l</a>", "<p>a <![foo[ x", "<p>a <![foo[ x ]]> b</p>", "<p>&#" + "9" * 5000 + ";</p>", "<td colspan='²'>", "<![if x]>", "<!", "<!-", "</", "<a b='&#" + "8" * 5000 + ";'>", "\x00<\x00>"])
def test_odd_pages(html):
    assert isinstance(markup.shred_html(html), list)
    assert isinstance(markup.page_sections(f"<h1>T</h1><p>{html}</p>", "http://h/"), list)
    assert isinstance(markup.page_sections(html, "http://[h"), list)


def test_spans_are_bounded():
    (_, _, _, body), *_ = markup.page_sections("<h1>T</h1><table><tr><td colspan='3000000' rowspan='99999999999999999999'>x</td></tr></table>", "")
    assert 'cols="1000"' in body and "morerows" not in body and len(body) < 40000
    assert [markup.whole(x, 9) for x in (None, "", "²", "x", "-3", "0", " 4 ", "12", "9" * 99)] == [1, 1, 1, 1, 1, 1, 4, 9, 9]


def test_odd_office_numbers(spark):
    t = "urn:oasis:names:tc:opendocument:xmlns:{}:1.0"
    head = f'<o:document-content xmlns:o="{t.format("office")}" xmlns:t="{t.format("text")}" xmlns:b="{t.format("table")}"><o:body><o:text>'
    text = '<t:h t:outline-level="two">A</t:h><t:p>x<t:s t:c="many"/>y</t:p><b:table><b:table-row><b:table-cell b:number-columns-spanned="1e3" b:number-rows-spanned=""><t:p>c</t:p></b:table-cell></b:table-row></b:table>'
    df = spark.createDataFrame([(1, head + text + "</o:text></o:body></o:document-content>", "<s/>")], "k long, c string, s string")
    rows = office.office_sections(df, "k", "c", "s").collect()
    assert [(r.level, r.title) for r in rows] == [(1, "A")] and "x y" in rows[0].body


@pytest.mark.parametrize(
    "pointer, want",
    [
        ("xpointer(//x[position()=1])", "<x>1</x><x>3</x>"),
        ("element(/1/2)", "<x>2</x>"),
        ("element(b/1)", "<x>3</x>"),
        ("element(/1/9)", ""),
        ("b", "<y id=\"b\"><x>3</x></y>"),
        ("x", "<x>1</x><x>2</x><x>3</x>"),
        ("xpointer(//x[)", None),
        ("xpointer(id('b'))", None),
        ("element()", None),
        ("what(ever", None),
    ],
)
def test_pointers(spark, pointer, want):
    files_ = [("s", "a.xml", f'<r xmlns:xi="http://www.w3.org/2001/XInclude"><xi:include href="b.xml" xpointer="{pointer}"/></r>'), ("s", "b.xml", '<q><x>1</x><x>2</x><y id="b"><x>3</x></y></q>')]
    df = spark.createDataFrame(files_, "source string, path string, text string")
    (got,) = splice.expand(df, spark.createDataFrame([("s", "a.xml")], "source string, path string")).collect()
    assert got.text == f'<r xmlns:xi="http://www.w3.org/2001/XInclude">{want or ""}</r>'
    assert (got.error is None) == (want is not None)


def test_shared_files_are_expanded_once(monkeypatch):
    """A part that 500 files include, each of them twice, is walked once; circles are found all the same."""
    head = '<r xmlns:xi="http://www.w3.org/2001/XInclude">{}</r>'
    inc = '<xi:include href="{}"/>'
    made = {"part.xml": "<p>shared</p>", "book.xml": head.format("".join(inc.format(f"f{k}.xml") for k in range(500)))}
    made |= {f"f{k}.xml": head.format(2 * inc.format("part.xml")) for k in range(500)}
    seen, tree = [], splice._tree
    monkeypatch.setattr(splice, "_tree", lambda text: seen.append(text) or tree(text))
    done: dict = {}
    text = splice.expand_xml(made, "book.xml", done=done)
    assert text.count("shared") == 1000 and len(seen) == 501 and splice.expand_xml(made, "f3.xml", done=done).count("shared") == 2 and len(seen) == 501
    made["part.xml"] = head.format(inc.format("f7.xml"))
    with pytest.raises(splice.Circular):
        splice.expand_xml(made, "book.xml")


def test_broken_escapes(spark):
    df = spark.createDataFrame([("a%ZZ",), ("%",), ("a%20b+c",), (None,)], "t string")
    assert [r[0] for r in df.select(U.decode_component(F.col("t"))).collect()] == [None, None, "a b+c", None]


# References.


def test_references(spark):
    base = "http://a/b/c/d;p?q"
    cases = {"g:h": "g:h", "g": "http://a/b/c/g", "./g": "http://a/b/c/g", "g/": "http://a/b/c/g/", "/g": "http://a/g", "//g": "http://g", "?y": "http://a/b/c/d;p?y", "g?y": "http://a/b/c/g?y", "#s": "http://a/b/c/d;p?q#s", "": base, ".": "http://a/b/c/", "..": "http://a/b/", "../g": "http://a/b/g", "../..": "http://a/", "../../../g": "http://a/g", "/./g": "http://a/g", "g.": "http://a/b/c/g.", "..g": "http://a/b/c/..g", "./g/.": "http://a/b/c/g/", "g/../h": "http://a/b/c/h", "g;x=1/../y": "http://a/b/c/y", "g#s/../x": "http://a/b/c/g#s/../x"}
    r = random.Random(8)
    odd = ["".join(r.choices("a/.?#:[]%\n ", k=r.randint(0, 9))) for _ in range(400)]
    pairs = [(base, u) for u in [*cases, *odd]] + [(f"x://h/{b}", u) for b, u in zip(odd, reversed(odd), strict=True)] + [(b, "a") for b in odd]
    df = spark.createDataFrame(pairs, "base string, url string")
    got = df.select("base", "url", U.absolute_to(F.col("url"), F.col("base")).alias("x"), U.relative_to(U.absolute_to(F.col("url"), F.col("base")), F.col("base")).alias("rel")).withColumn("again", U.absolute_to(F.col("rel"), F.col("base"))).collect()
    assert all(r.x == U.absolute(r.base, r.url) for r in got)
    for r in got:
        if r.base == base and r.url in cases:
            assert r.x == cases[r.url] and r.again == r.x
    there = spark.createDataFrame([("http://h/a/b/c.html?x#y", "http://h/a/d/e.html"), ("http://h/a/d/", "http://h/a/d/e.html"), ("http://i/a", "http://h/a"), ("http://h/a/d/x:y", "http://h/a/d/e")], "u string, b string")
    assert [r[0] for r in there.select(U.relative_to(F.col("u"), F.col("b"))).collect()] == ["../b/c.html?x#y", "./", "http://i/a", "./x:y"]


# Repeated keys.


def test_repeated_keys_give_one_row(spark):
    f = spark.createDataFrame([("s", "a", b"1"), ("s", "a", b"2")], "source_id string, path string, content binary")
    wanted = spark.createDataFrame([("s", "a"), ("s", "A"), ("s", "b")], "source_id string, name string")
    assert sorted((r.name, r.content and bytes(r.content)) for r in files.lookup(f, wanted).collect()) == [("A", None), ("a", b"2"), ("b", None)]
    assert sorted((r.name, r.content and bytes(r.content)) for r in files.lookup(f, wanted, True).collect()) == [("A", b"2"), ("a", b"2"), ("b", None)]
    topics = spark.createDataFrame([(1, "x", "t")], "store_id long, title string, xml string")
    changes = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (2, "c", 1)], "store_id long, title string, at int")
    assert [r.title for r in store.sparse_update(topics, changes, ["title"]).collect()] == ["b"]
    assert [r.title for r in store.sparse_update(topics, changes, ["title"], "at").collect()] == ["a"]
    specs = spark.createDataFrame([(1, "a"), (1, "b"), (None, "n")], "spec_id long, text string")
    assert sorted(r.spec_id for r in store.write_specs(specs, specs.where("text = 'a'")).collect()) == [1, 2]


def test_image_references(spark):
    t = spark.createDataFrame([(1, 1, "<i fileref='a.png'/><i fileref=\"a.png\"/><i fileref = 'b.svg'/>"), (1, 2, None)], "source int, key int, xml string")
    up = spark.createDataFrame([(1, "a.png", 7), (1, "a.png", 7)], "source int, fileref string, store_id long")
    got = {r.key: r.xml for r in store.rewrite_images(t, up).collect()}
    assert got == {1: "<i fileref='images/7.png'/><i fileref=\"images/7.png\"/><i fileref = 'b.svg'/>", 2: None}


# Archives.


def test_archives_by_range(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "STRETCH", 1 << 12)
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for k in range(3000):
            z.writestr(f"d/{k}.txt", f"text {k} " * (k % 50))
        z.writestr("stored.bin", os.urandom(5000), compress_type=zipfile.ZIP_STORED)
        with z.open("far.txt", "w", force_zip64=True) as f:
            f.write(b"far")
        z.writestr("other.txt", "x" * 100, compress_type=zipfile.ZIP_BZIP2)
        z.mkdir("empty")
    raw = bytearray((tmp_path / "a.zip").read_bytes())
    raw[40] ^= 255  # in the first entry's data or name
    (tmp_path / "b.zip").write_bytes(raw[:2000])
    (tmp_path / "c.zip").write_bytes(b"no archive")
    found = files.read_large_archives(spark, str(tmp_path)).cache()
    good = {r.path: bytes(r.content) for r in found.where("source_id LIKE '%a.zip' AND error IS NULL").collect()}
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert good == {n: z.read(n) for n in z.namelist() if n not in ("other.txt", "empty/")}
    assert {(r.source_id[-5:], r.path, r.error[:9]) for r in found.where("error IS NOT NULL").collect()} == {("a.zip", "other.txt", "method 12"), ("b.zip", None, "File is n"), ("c.zip", None, "File is n")}
    assert found.where("source_id LIKE '%a.zip'").select(F.spark_partition_id()).distinct().count() > 1


# The kept store and streams.


def test_store_batches(spark, tmp_path):
    path, schema = str(tmp_path / "s"), "store_id long, xml string"
    rows = lambda *x: spark.createDataFrame([*x], schema)
    read = lambda **k: sorted(map(tuple, store.load(spark, path, schema, **k).collect()))
    assert read() == [] and store.batches(spark, path) == []
    store.save(rows((1, "a"), (2, "b"), (2, "c")), path, schema, 1)
    store.save(rows((2, "d"), (3, None)), path, schema, 2)
    want = [(1, "a"), (2, "d"), (3, None)]
    assert read() == want
    store.save(rows((2, "d"), (3, None)), path, schema, 2)
    os.makedirs(f"{path}/batch=3")  # broke off
    assert read() == want and read(before=2) == [(1, "a"), (2, "c")] and store.batches(spark, path) == [1, 2]


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    docs = spark.createDataFrame([(k, f"<p>{k % 7}</p>" if k else None) for k in range(40)], "doc_id long, text string")
    part = lambda lo, hi: docs.where(F.col("doc_id").between(lo, hi)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: {(r.doc_id, r.survivor, r.status) for r in ingest.reused(spark, str(tmp_path / "in"), "doc_id", "text", str(tmp_path / "out"), str(tmp_path / "cp"), 1).collect()}
    part(0, 9)
    assert len(run()) == 10
    part(10, 24)
    part(25, 39)
    got = run()
    assert run() == got and len(got) == 40
    assert got == {(r.doc_id, r.survivor, r.status) for r in matching.reuse(docs, "doc_id", "text").collect()}


# The import run.

BOOK = """<book><bookinfo><title>B</title></bookinfo><chapter id="one"><title>First</title>
<section id="a"><title>A</title><para>a <xref linkend="b"/> and <xref linkend="one"/></para></section>
<section id="b"><title>B</title><para>b<footnote id="f">x</footnote></para></section>
<section><title>C</title><para>c <link linkend="f">to f</link> <xref linkend="nowhere"/></para></section></chapter>
<preface><title>P</title><para>same</para></preface><appendix><title>P</title><para>same</para></appendix></book>"""


def run_import(spark, stored, books=None):
    made = spark.createDataFrame(books or [(1, "Book", BOOK)], "doc_id long, title string, xml string")
    topics, written, outlines = book_import.import_books(made, spark.createDataFrame(stored, "store_id long, xml string"))
    return {(r.doc_id, r.node_id, r.title): (r.status, r.store_id) for r in topics.collect()}, {r.store_id: r.xml for r in written.collect()}, {r.doc_id: (r.text, r.report) for r in outlines.collect()}


def test_import_into_an_empty_store(spark):
    topics, written, outlines = run_import(spark, [])
    by = {}
    for (_, _, title), (status, n) in topics.items():
        assert status == "NEW"
        by.setdefault(title, set()).add(n)
    assert set(by) == {"A", "B", "C", "P"} and len(by["P"]) == 1 and sorted(written) == [1, 2, 3, 4]
    (a,), (b,), (c,) = by["A"], by["B"], by["C"]
    assert f"<!--Inject: {b}-->" in written[a] and "<!--Inject: T1-->" in written[a] and 'linkend="nowhere"' in written[c] and f"<!--Inject: {b}-->" in written[c]
    text, report = outlines[1]
    assert text.splitlines()[:5] == ["Title = Book", "Chapter: First [T1]", f"  A [{a}]", f"  B [{b}]", f"  C [{c}]"]
    assert "new topics were created" in report and "reused" not in report


def test_import_reuses_what_holds_together(spark):
    section = "<section><title>{}</title><para>{}</para></section>"
    a = lambda ref, target: section.format("A", f"a <!-- Inject: {ref} --> and <!-- Inject: {target} -->")
    b = '<section><title>B</title><para>b<footnote id="f">x</footnote></para></section>'
    good = [(10, a(20, "T1")), (20, b), (21, b)]
    topics, written, _ = run_import(spark, good)
    got = {t: x for (_, _, t), x in topics.items()}
    assert got["A"] == ("REUSED", 10) and got["B"] == ("REUSED", 20) and got["C"][0] == "NEW" and got["C"][1] > 21
    assert set(written) == {n for s, n in topics.values() if s == "NEW"}
    topics, _, _ = run_import(spark, [(10, a(20, "T9")), (12, a(21, "T1")), (20, b), (21, b)])
    got = {t: x for (_, _, t), x in topics.items()}
    assert got["A"] == ("REUSED", 12) and got["B"] == ("REUSED", 21)
    topics, _, _ = run_import(spark, [(10, a(99, "T1")), (20, b)])
    assert {t: s for (_, _, t), (s, _) in topics.items()}["A"] == "NEW"


def test_import_of_odd_books(spark):
    topics, written, outlines = run_import(spark, [], [(1, None, None), (2, "x", "<broken"), (3, None, "<book/>"), (4, None, "<chapter><title>T</title><para/></chapter>")])
    assert {k[0] for k in topics} == {4} and len(written) == 1 and set(outlines) == {4}
    assert outlines[4][0].startswith("Title = Unknown\n")


def test_hashed_pairs_recall(spark):
    """Pairs of known similarity from 0.6 on: nearly all are found, and none that is less."""
    r = random.Random(5)
    texts, n = [], 200
    for k in range(n):
        words = [f"w{k}x{j}" for j in range(60)]
        cut = r.randint(4, 14)  # both texts share 56 - cut of 56 shingles each
        texts += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[: 60 - cut] + [f"v{k}y{j}" for j in range(cut)]))]
    df = spark.createDataFrame([*texts, (9999, ""), (9998, None)], "id long, text string")
    pairs, classes = matching.similar_by_hash(df, "id", "text", threshold=0.6)
    sets = {i: {tuple(t.split()[j : j + 5]) for j in range(56)} for i, t in texts}
    want = {(2 * k, 2 * k + 1): len(sets[2 * k] & sets[2 * k + 1]) / len(sets[2 * k] | sets[2 * k + 1]) for k in range(n)}
    got = {(p.a, p.b): p.jaccard for p in pairs.collect()}
    real = {p: j for p, j in want.items() if j >= 0.6}
    assert set(got) <= set(real) and len(got) >= 0.99 * len(real) and len(real) > 50 and classes.count() == 2 * n
    assert all(abs(j - want[p]) < 1e-9 for p, j in got.items())
    exact, _ = matching.similar(df, "id", "text", threshold=0.6)
    assert {(p.a, p.b) for p in exact.collect()} == set(real)


