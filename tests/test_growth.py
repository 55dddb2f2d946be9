"""That work and what is moved grow no faster than the tables."""

from pyspark.sql import functions as F

from inkloom.functions import text as X


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_canonical_form_reads_a_text_once(spark):
    df = spark.createDataFrame([("<a><screen>a  b</screen></a>",), (None,)], "x string")
    shown = plan(df.select(X.canonical(F.col("x")).alias("c")))
    assert shown.count("CDATA\\[.*?\\]\\]>|<[^<>]*>") == 1
    assert [r.c for r in df.select(X.canonical(F.col("x")).alias("c")).collect()] == ["<section>\n<screen>\na b\n</screen>\n</section>\n\n<screen>a  b</screen>", None]


def test_comparison_is_spread_over_tasks(spark):
    from inkloom.plans import import_queries

    assert "RepartitionByExpression" in plan(import_queries._variants(spark, "/root/testdata/sf0.001"))


def watch(monkeypatch, module):
    """(tag, columns, rows) of all that a module writes from now on."""
    kept, seen = module.held, []

    def held(df, tag="held"):
        out = kept(df, tag)
        seen.append((tag, out.columns, out.count()))
        return out

    monkeypatch.setattr(module, "held", held)
    return seen


def test_roots_follow_circles_only(spark, monkeypatch):
    from inkloom.operators import graph

    # 0 is required by all of 1 to 200; 300 to 304 are a circle that requires 400, 400 requires 401.
    wants = [(k, 0) for k in range(1, 201)] + [(300 + k, 300 + (k + 1) % 5) for k in range(5)] + [(302, 400), (400, 401), (500, 600)]
    nodes = sorted({x for w in wants for x in w})
    cand = spark.createDataFrame([(1, t, t) for t in nodes], "component long, t long, s long")
    edges = spark.createDataFrame([(1, a, a, b, b) for a, b in wants], "component long, t long, s long, dt long, ds long")
    seen = watch(monkeypatch, graph)
    assert sorted(r.t for r in graph._roots(cand, edges).collect()) == [*range(1, 201), 300, 500]
    assert sum(n for tag, _, n in seen if tag == "pointers") < 60


def test_sources_stream_through_their_task(spark):
    from inkloom.operators import splice

    files = spark.createDataFrame([(s, p, t) for s in ("a", "b", "c") for p, t in (("m.xml", '<m xmlns:xi="http://www.w3.org/2001/XInclude"><xi:include href="t.txt" parse="text"/></m>'), ("t.txt", s), ("n.xml", None))], "source string, path string, text string")
    roots = spark.createDataFrame([("a", "m.xml"), ("b", "m.xml"), ("b", "n.xml"), ("b", "m.xml"), ("d", "m.xml")], "source string, path string")
    got = splice.expand(files, roots)
    assert "CoGroup" not in plan(got)
    head = '<m xmlns:xi="http://www.w3.org/2001/XInclude">'
    assert sorted(tuple(r) for r in got.collect()) == [("a", "m.xml", f"{head}a</m>", None), ("b", "m.xml", f"{head}b</m>", None), ("b", "n.xml", "", None), ("d", "m.xml", "", None)]


def test_classes_move_digests_only(spark, monkeypatch):
    from inkloom.operators import matching

    seen = watch(monkeypatch, matching)
    df = spark.createDataFrame([(3, "a b c d e f"), (2, "A b c d e  f"), (1, "a b"), (4, " "), (5, None)], "id long, t string")
    assert sorted(tuple(r) for r in matching.set_classes(df, "id", "t").collect()) == [(1, 1), (2, 2), (3, 2)]
    assert [c for _, c, _ in seen] == [["id", "k"]]


def test_styles_that_lack_nothing_are_not_joined_again(spark, monkeypatch):
    from inkloom.operators import rules

    n = 512  # a line of parents whose end are two that are each other's parent; only every 100th has a size, none a colour
    styles = spark.createDataFrame([(1, k, k - 1 if k else 1, "f" if k % 2 else None, k if k % 100 == 7 else None, None) for k in range(n)], "doc long, name long, parent long, font string, size long, colour string")
    seen = watch(monkeypatch, rules)
    got = {r.name: (r.font, r.size, r.colour) for r in rules.inherited(styles, "doc", ["font", "size", "colour"]).collect()}
    size = lambda k: (k - 7) // 100 * 100 + 7 if k >= 7 else None
    assert got == {k: ("f", size(k), None) for k in range(n)}
    assert sum(tag == "styles" for tag, _, _ in seen) < 10


def test_written_topics_are_made_once(spark, monkeypatch):
    from inkloom.plans import import_queries

    save, seen = import_queries.store.save, []
    monkeypatch.setattr(import_queries.store, "save", lambda rows, *more: (seen.append(plan(rows)), save(rows, *more)))
    got = import_queries.import_written(spark, "/root/testdata/sf0.001")
    assert len(seen) == 3 and not any("Join" in x or "Aggregate" in x for x in seen)
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    assert got.agg(F.sum("n")).first()[0] == orders.where("o_custkey % 4 <> 0").count()


def test_books_are_parsed_once(spark):
    from inkloom.operators import book_import

    xml = "<book><chapter id='c'><title>C</title><section id='s'><title/><para>x<emphasis id='e'/></para></section></chapter><appendix/></book>"
    got = book_import.shred(spark.createDataFrame([(1, xml), (2, "<broken")], "doc_id long, xml string"))
    assert plan(got).count("MapInPandas") == 1 and "Join" not in plan(got)
    assert sorted(tuple(r) for r in got.collect()) == [
        (1, 1, "container", "chapter", "C", 1, "c", 1, "<chapter><title>C</title></chapter>", ["c"]),
        (1, 4, "topic", "section", "Untitled", 2, "s", None, "<section><title/><para>x<emphasis id=\"e\"/></para></section>", ["s", "e"]),
        (1, 9, "container", "appendix", "Untitled", 1, None, None, "<appendix/>", []),
    ]


def near_texts(n):
    """Texts of which many are near copies or copies of others, all with some lines in common."""
    import random

    r = random.Random(7)
    own = [[f"w{r.randrange(3000)}" for _ in range(r.randrange(3, 60))] for _ in range(n)]
    common = [f"c{k}" for k in range(12)]
    for k in range(1, n):
        if k % 3 == 0:
            own[k] = [w if r.random() > 0.02 else "x" for w in own[k - 1]]
        elif k % 7 == 0:
            own[k] = list(own[k // 2])
    return [(k, " ".join(w + common)) for k, w in enumerate(own)] + [(n, None), (n + 1, " "), (n + 2, "two words"), (n + 3, "Two  words")]


def near_pairs(docs, threshold):
    """Pairs of different sets of five-word shingles, by comparing all, and the least id of each set."""
    sets, rep = {}, {}
    for k, t in docs:
        if w := (t or "").lower().split():
            sets[k] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
            rep.setdefault(sets[k], k)
    first = sorted(rep.values())
    found = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in first for b in first if a < b}
    return {p: round(j, 9) for p, j in found.items() if j >= threshold}, {k: rep[s] for k, s in sets.items()}


def test_sets_are_written_once(spark, monkeypatch):
    from inkloom.operators import matching

    docs = near_texts(300)
    df = spark.createDataFrame(docs, "id long, t string").repartition(5)
    for by, threshold in ((matching.similar, 0.75), (matching.similar, 0.7), (matching.similar_by_hash, 0.6)):
        with monkeypatch.context() as m:
            seen = watch(m, matching)
            pairs, classes = by(df, "id", "t", threshold=threshold)
            want, reps = near_pairs(docs, threshold)
            assert {(r.a, r.b): round(r.jaccard, 9) for r in pairs.collect()} == want and len(want) > 20
            assert {r.id: r.rep for r in classes.collect()} == reps
        assert sum("s" in columns for _, columns, _ in seen) == 1


def test_keys_too_many_to_send_are_joined(spark, monkeypatch):
    from inkloom.operators import matching

    docs = near_texts(60)
    df = spark.createDataFrame(docs, "id long, t string")
    monkeypatch.setattr(matching, "MOST_KEYS", 0)
    pairs, _ = matching.similar(df, "id", "t")
    assert {(r.a, r.b) for r in pairs.collect()} == set(near_pairs(docs, 0.75)[0])


def test_texts_leave_a_batch_one_at_a_time(spark):
    from inkloom.operators import markup

    long = "<h1>A</h1><p>" + "x " * (markup.TEXT // 3) + "</p>"
    df = spark.createDataFrame([("a", long), ("b", None), ("c", "<h2 id='i'>B<br></h2>y<!--z-->"), ("d", long), ("e", ""), ("f", "<h1>C</h1>")], "id string, t string").withColumn("u", F.lit("http://h/")).coalesce(1)
    nodes, found = markup.nodes(df, "id", "t"), markup.sections(df, "id", "t", "u")
    for made in (nodes, found):
        assert "MapInArrow" in plan(made) and "MapInPandas" not in plan(made)
    assert sorted((r.id, r.node_id, r.parent_id, r.post, r.ord, r.depth, r.name, r.attrs, r.text) for r in nodes.where("id IN ('c', 'f')").collect()) == [
        ("c", 0, None, 2, 1, 0, "h2", {"id": "i"}, None), ("c", 1, 0, 0, 1, 1, "#text", None, "B"), ("c", 2, 0, 1, 2, 1, "br", {}, None), ("c", 3, None, 3, 2, 0, "#text", None, "y"), ("c", 4, None, 4, 3, 0, "#comment", None, "z"),
        ("f", 0, None, 1, 1, 0, "h1", {}, None), ("f", 1, 0, 0, 1, 1, "#text", None, "C"),
    ]
    assert {r.id: r.n for r in nodes.groupBy("id").agg(F.count("*").alias("n")).collect()} == {"a": 4, "c": 5, "d": 4, "f": 2}
    assert sorted((r.id, r.place, r.level, r.title, r.body) for r in found.collect()) == sorted((r.id, *x) for r in df.collect() for x in markup.page_sections(r.t, r.u))
    assert markup.nodes(df.where("id = 'b'"), "id", "t").count() == 0


def test_closure_doubles_its_lengths(spark, monkeypatch):
    import random

    from inkloom.operators import graph

    r = random.Random(3)
    line = [(k, k + 1) for k in range(60)]
    edges = [*line, *((100 + a, 100 + b) for a, b in ((r.randrange(25), r.randrange(25)) for _ in range(40))), (200, 200), (201, 202), (202, 201), (203, None)]
    want, ahead = {}, {}
    for a, b in set(edges):
        ahead.setdefault(a, []).append(b)
    for root in ahead:
        at, depth = ahead[root], 1
        while at := [p for p in set(at) if (root, p) not in want]:
            want |= {(root, p): depth for p in at}
            at, depth = [c for p in at for c in ahead.get(p, ())], depth + 1
    seen = watch(monkeypatch, graph)
    got = graph._closure(spark.createDataFrame(edges, "path long, child long").distinct())
    assert {(x.root, x.path): x.depth for x in got.collect()} == want and got.count() == len(want)
    assert len(seen) < 10


def test_paths_shuffle_a_node_table_once(spark):
    from inkloom.operators import axes, markup
    from inkloom.operators.axes import LAST, Step
    from inkloom.plans import markup_queries

    docs = [(1, "<b><s i='1'>x<s i='2'>y</s></s><s i='3'/>z</b>"), (2, "<b/>"), (3, None), (4, "<s i='4'><t/>w</s>")]
    nodes = markup.nodes(spark.createDataFrame(docs, "doc long, xml string"), "doc", "xml", xml=True).withColumn("i", F.col("attrs")["i"])
    paths = {"any": [[Step("descendant", "s")]], "end": [[Step("child"), Step("descendant", "s", place=LAST)], [Step("descendant", "t"), Step("parent")]], "none": [[Step("child", "u")]], "up": [[Step("descendant", "s", lacking=((Step("child", "t"),),)), Step("ancestor", "s", place=1)]]}
    got = axes.with_values(axes.reached(nodes, "doc", paths), "doc", F.size("paths") > 0, "i", "paths")
    assert sorted((r.doc, r.i, r.paths, r.value) for r in got.collect()) == [(1, "1", ["any", "up"], "xy"), (1, "2", ["any"], "y"), (1, "3", ["any", "end"], ""), (4, "4", ["any", "end"], "w")]
    for df, shuffles in ((got, 1), (axes.walk(nodes, "doc", paths["up"][0]), 1), (markup_queries.axis_steps(spark, "/root/testdata/sf0.001"), 2)):
        shown = df.select("*")._jdf.queryExecution().executedPlan().toString()
        assert shown.count("Exchange ") == shuffles and "Join" not in shown and "REPARTITION_BY_NUM" in shown


def test_hashes_that_begin_alike_are_one_call(spark, tmp_path):
    from pyspark.sql import Row

    from inkloom.operators import matching
    from inkloom.streaming import ingest

    class Kept(dict):
        asked = 0
        exists = lambda self: bool(self)
        updateValue = dict.__setitem__  # noqa: N815

        def getValue(self, key):  # noqa: N802
            self.asked += 1
            return self.get(key)

    kept = Kept()
    first = ingest._first("bigint")
    first.init(type("Handle", (), {"getMapState": lambda self, *names: kept})())
    take = lambda *rows: sorted((r.key is None, r.key, r.survivor, r.status) for r in first.handleInputRows(("a",), iter([Row(__canon=c, __key=k) for c, k in rows]), None))
    assert take(("a1", 7), ("a2", 6), ("a1", 5), ("a2", None)) == [(False, 5, 5, "NEW"), (False, 6, 6, "NEW"), (False, 7, 5, "REUSED"), (True, None, 6, "REUSED")]
    assert kept == {("a1",): (5,), ("a2",): (6,)} and kept.asked == 0
    assert take(("a3", 1), ("a1", 2)) == [(False, 1, 1, "NEW"), (False, 2, 5, "REUSED")] and kept.asked == 2

    big = 2**53 + 1
    docs = spark.createDataFrame([(big, "x"), (None, "x"), (big + 2, "x"), *((k, f"t{k % 300}") for k in range(900))], "id long, t string")
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    got = ingest.reused(spark, str(tmp_path / "in"), "id", "t", str(tmp_path / "out"), str(tmp_path / "cp")).collect()
    assert {(r.id, r.survivor, r.status) for r in got} == {(r.id, r.survivor, r.status) for r in matching.reuse(docs, "id", "t").collect()} and len(got) == 903
