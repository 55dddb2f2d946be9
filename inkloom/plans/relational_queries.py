"""Joins, graphs, strings and rules over the star schema and the events."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from inkloom.functions import text as X
from inkloom.operators import graph, order, outline, rules
from inkloom.plans.catalog import query, table
from inkloom.streaming import ingest


@query("event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return ingest.windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query("edit_distance", "SELECT a.p_partkey, levenshtein(a.p_name, b.p_name)::INTEGER AS distance FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1")
def edit_distance(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("other"))
    return p.join(after, "p_partkey").select("p_partkey", F.levenshtein("p_name", "other").alias("distance"))


@query("scalar_strings", r"""SELECT p_partkey, reverse(p_name) AS reversed, regexp_replace(p_brand, '([.*+?^${}()|\[\]/\\-])', '\\\1', 'g') AS escaped, regexp_replace(p_type, '[ \t\n\r\f\v]+', ' ', 'g') AS collapsed,
    regexp_replace(concat(p_size, '.', p_partkey % 7, ' ', p_name), '^[0-9]+(\.[0-9]+)*\.?[ \t\n\r\f\v]*', '') AS unnumbered, printf('%.2f', p_size / 4.0) || '% ' AS percentage, to_base64(encode(p_name)) AS base64, repeat('  ', p_size % 4) || p_brand AS indented FROM part""")
def scalar_strings(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    numbered = F.concat(F.col("p_size").cast("string"), F.lit("."), (F.col("p_partkey") % 7).cast("string"), F.lit(" "), "p_name")
    return p.select("p_partkey", F.reverse("p_name").alias("reversed"), X.escape_regex(F.col("p_brand")).alias("escaped"), X.collapse_space(F.col("p_type")).alias("collapsed"), X.strip_numbering(numbered).alias("unnumbered"), X.percent(F.col("p_size") / 4.0).alias("percentage"), F.base64(F.encode("p_name", "UTF-8")).alias("base64"), F.concat(X.indent(F.col("p_size") % 4), "p_brand").alias("indented"))


@query("base64_roundtrip", "SELECT count(*) AS n, count(*) AS same FROM part")
def base64_roundtrip(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.agg(F.count("*").alias("n"), F.count_if(F.decode(F.unbase64(F.base64(F.encode("p_name", "UTF-8"))), "UTF-8") == F.col("p_name")).alias("same"))


@query("xpath_strings", "SELECT p_partkey, substr(p_name, 1, 2) AS from_zero, substr(p_name, 2, 3) AS inner_part, floor(p_retailprice / 10 + 0.5)::BIGINT AS rounded, trim(regexp_replace(p_type, '[ \\t\\n\\r]+', ' ', 'g')) AS normal, starts_with(p_type, 'S') AS starts, translate(p_brand, '#', '-') AS translated FROM part".replace("\\\\", "\\"))
def xpath_strings(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", X.xpath_substring(F.col("p_name"), F.lit(0), F.lit(3)).alias("from_zero"), X.xpath_substring(F.col("p_name"), F.lit(1.5), F.lit(2.6)).alias("inner_part"), X.xpath_round(F.col("p_retailprice") / 10).alias("rounded"), X.normalize_space(F.col("p_type")).alias("normal"), F.col("p_type").startswith("S").alias("starts"), F.translate("p_brand", "#", "-").alias("translated"))


@query("attribute_fill", "SELECT n_nationkey, n_name || ' of ' || r_name || ' and {other}' AS text FROM nation JOIN region ON n_regionkey = r_regionkey")
def attribute_fill(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    attributes = F.create_map(F.lit("nation"), F.concat(F.lit("  "), "n_name", F.lit(" ")), F.lit("region"), F.col("r_name"))
    return n.select("n_nationkey", X.fill_attributes(F.lit("{nation} of {region} and {other}"), attributes).alias("text"))


@query("array_shapes", "SELECT l_orderkey, list_sort(list_distinct(list(l_returnflag)))[1] AS least_flag, len(list_distinct(list(l_returnflag)))::INTEGER AS n_flags, sum(l_linenumber)::BIGINT AS total, max(l_linenumber) AS last_line FROM lineitem GROUP BY l_orderkey")
def array_shapes(spark, sf_dir):
    held = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("x"))
    flags = F.array_distinct(F.transform("x", lambda e: e["l_returnflag"]))
    return held.select("l_orderkey", F.array_min(flags).alias("least_flag"), F.size(flags).alias("n_flags"), F.aggregate("x", F.lit(0).cast("long"), lambda acc, e: acc + e["l_linenumber"]).alias("total"), F.element_at("x", -1)["l_linenumber"].alias("last_line"))


@query("zip_arrays", "SELECT user_id, count(*) AS n, min(k) AS first_k FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k, event_type FROM events WHERE event_type IN ('click', 'view')) a JOIN (SELECT user_id, k FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'view')) b USING (user_id, k) WHERE event_type = 'click' GROUP BY user_id")
def zip_arrays(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    pairs = graph.pair_by_place(e.where("event_type = 'click'"), e.where("event_type = 'view'"), "user_id", "event_id", "event_id", "event_id")
    return pairs.groupBy("user_id").agg(F.count("*").alias("n"), F.min("k").alias("first_k"))


@query("positional_join", "WITH x AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k FROM events) SELECT a.user_id, a.k, a.event_id AS left_value, b.event_id AS right_value FROM x a JOIN x b ON a.user_id = b.user_id AND a.k = b.k WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def positional_join(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return graph.pair_by_place(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), "user_id", "event_id", "event_id", "event_id").withColumn("k", F.col("k").cast("long"))


@query("xref_resolution", """WITH ids AS (SELECT 'k' || c_custkey % 1000 AS linkend, 'topic' AS dst_kind, c_custkey AS seq, 1 AS r FROM customer UNION ALL SELECT 'k' || s_suppkey % 1300, 'container', s_suppkey, 0 FROM supplier),
    b AS (SELECT linkend, dst_kind, seq, row_number() OVER (PARTITION BY linkend ORDER BY r DESC, seq DESC) AS n FROM ids)
    SELECT o_orderkey AS src, 'k' || o_custkey % 1500 AS linkend, dst_kind, seq AS dst FROM orders LEFT JOIN b ON linkend = 'k' || o_custkey % 1500 AND n = 1""")
def xref_resolution(spark, sf_dir):
    ids = lambda t, key, n: table(spark, sf_dir, t).select(F.lit(0).alias("doc_id"), F.col(key).alias("seq"), F.array(F.concat(F.lit("k"), (F.col(key) % n).cast("string"))).alias("xml_ids"))
    links = table(spark, sf_dir, "orders").select(F.lit(0).alias("doc_id"), F.col("o_orderkey").alias("src"), F.concat(F.lit("k"), (F.col("o_custkey") % 1500).cast("string")).alias("linkend"))
    return graph.resolve_targets(links, ids("customer", "c_custkey", 1000), ids("supplier", "s_suppkey", 1300)).drop("doc_id")


@query("include_closure", """WITH RECURSIVE i AS (SELECT p_partkey AS path, p_partkey // 2 AS child FROM part WHERE p_partkey // 2 > 0),
    r(root, path, depth) AS (SELECT path, path, 0 FROM i UNION ALL SELECT root, child, depth + 1 FROM r JOIN i USING (path)) SELECT root, path, min(depth)::INTEGER AS depth, FALSE AS cyclic FROM r WHERE depth > 0 GROUP BY root, path""")
def include_closure(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_partkey div 2 > 0").select(F.col("p_partkey").alias("path"), F.expr("p_partkey div 2").alias("child"))
    return graph.include_closure(spark, p)


_PARAS = "SELECT p_partkey, p_size % 3 AS size, p_brand AS font, p_size > 25 AS bold FROM part"


@query("font_rules", f"""WITH r(rule_no, size, font, bold, element) AS (VALUES (1, 0, NULL, TRUE, 'title'), (2, NULL, 'Brand#11', NULL, 'screen'), (3, 1, NULL, NULL, 'note')),
    p AS ({_PARAS}), h AS (SELECT p_partkey, element, row_number() OVER (PARTITION BY p_partkey ORDER BY rule_no) AS n FROM p JOIN r ON (r.size IS NULL OR r.size = p.size) AND (r.font IS NULL OR r.font = p.font) AND (r.bold IS NULL OR r.bold = p.bold))
    SELECT p_partkey AS ord, coalesce(element, 'para') AS element FROM p LEFT JOIN (SELECT * FROM h WHERE n = 1) USING (p_partkey)""")
def font_rules(spark, sf_dir):
    paras = table(spark, sf_dir, "part").select(F.lit(0).alias("doc_id"), F.col("p_partkey").alias("ord"), (F.col("p_size") % 3).alias("size"), F.col("p_brand").alias("font"), (F.col("p_size") > 25).alias("bold"))
    made = spark.sql("SELECT * FROM VALUES (1, 0, CAST(NULL AS STRING), true, 'title', false), (2, NULL, 'Brand#11', NULL, 'screen', true), (3, 1, NULL, NULL, 'note', false) AS r(rule_no, size, font, bold, element, merge)")
    return rules.classify(paras, made, ["size", "font", "bold"]).select("ord", "element")


@query("merged_paragraphs", """WITH p AS (SELECT user_id AS doc_id, event_id AS ord, event_type AS element, event_type IN ('click', 'view') AS merge FROM events),
    c AS (SELECT *, CASE WHEN merge AND lag(merge) OVER w AND lag(element) OVER w = element THEN 0 ELSE 1 END AS change FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
    r AS (SELECT *, sum(change) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM c) SELECT doc_id, run::BIGINT AS run, first(element) AS element, string_agg(ord::VARCHAR, chr(10) ORDER BY ord) AS text FROM r GROUP BY doc_id, run""")
def merged_paragraphs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"), F.col("event_type").alias("element"), F.col("event_type").isin("click", "view").alias("merge"), F.col("event_id").cast("string").alias("text"))
    return rules.merge_runs(e)


@query("outline_render", "SELECT o_custkey AS doc_id, string_agg(o_orderpriority || CASE WHEN o_orderstatus = 'O' THEN ' [' || o_orderkey || ']' ELSE '' END, chr(10) ORDER BY o_orderkey) AS text FROM orders GROUP BY o_custkey")
def outline_render(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    lines = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_no"), F.col("o_orderpriority").alias("text"))
    ids = o.where("o_orderstatus = 'O'").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("line_no"), F.col("o_orderkey").alias("store_id"), F.lit(False).alias("info"))
    return outline.render(outline.with_ids(lines, ids))


@query("outline_header", "SELECT s_suppkey, 'Title = ' || s_name || CASE WHEN s_acctbal > 0 THEN ';Edition = ' || s_nationkey ELSE '' END || ';Type = Book' AS header FROM supplier")
def outline_header(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    lines = outline.header({"Title": F.col("s_name"), "Edition": F.when(F.col("s_acctbal") > 0, F.col("s_nationkey").cast("string")), "Subtitle": F.lit(""), "Type": F.lit("Book")})
    return s.select("s_suppkey", F.array_join(lines, ";").alias("header"))


@query("graph_resolution", """SELECT o_custkey AS component, k::INTEGER AS topic_seq, CASE WHEN o_custkey % 3 = 0 AND k < n THEN 'NEW' ELSE 'REUSED' END AS status, CASE WHEN o_custkey % 3 = 0 AND k < n THEN NULL ELSE o_orderkey END AS store_id
    FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)""")
def graph_resolution(spark, sf_dir):
    """Each topic links to the next; in every third component the last link wants another topic than there is, so none before it can be reused."""
    o = table(spark, sf_dir, "orders")
    topic = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    t = o.select(F.col("o_custkey").alias("component"), topic.alias("topic_seq"), F.col("o_orderkey").alias("store_id"), F.count("*").over(Window.partitionBy("o_custkey")).alias("n"))
    wrong = (F.col("component") % 3 == 0) & (F.col("topic_seq") == F.col("n"))
    after = t.select("component", (F.col("topic_seq") - 1).alias("topic_seq"), F.col("topic_seq").cast("long").alias("dst"), (F.col("store_id") + wrong.cast("int")).cast("string").alias("required_ref"))
    linked = t.join(after, ["component", "topic_seq"], "left")
    return graph.resolve(linked.select("component", "topic_seq", "store_id", F.when(F.col("dst").isNotNull(), "topic").alias("dst_kind"), "dst", F.lit(None).cast("int").alias("dst_target"), "required_ref"))


@query("giant_resolution", """WITH o AS (SELECT o_orderkey AS k, 7 + (o_orderkey % 3 = 0)::INTEGER AS hub, o_orderkey % 5 = 0 AS spare FROM orders), h AS (SELECT arg_min(hub, k) AS hub FROM o),
    l AS (SELECT 2 * o_orderkey AS a, 2 * o_orderkey + 1 AS b, o_custkey + 1 AS c, o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 AS dead, o_orderkey % 11 = 0 AS twice FROM orders)
    SELECT 0::BIGINT AS component, 0 AS topic_seq, 'REUSED' AS status, hub::BIGINT AS store_id FROM h UNION ALL SELECT 0, (k + 1)::INTEGER, CASE WHEN o.hub = h.hub OR spare THEN 'REUSED' ELSE 'NEW' END, CASE WHEN o.hub = h.hub THEN k WHEN spare THEN k + 1000000000 END FROM o, h
    UNION ALL SELECT c, a::INTEGER, CASE WHEN dead THEN 'NEW' ELSE 'REUSED' END, CASE WHEN NOT dead THEN a END FROM l UNION ALL SELECT c, b::INTEGER, CASE WHEN dead AND NOT twice THEN 'NEW' ELSE 'REUSED' END, CASE WHEN twice THEN b + 1000000000 WHEN NOT dead THEN b END FROM l""")
def giant_resolution(spark, sf_dir):
    """One book in which every order wants the same topic, as 7 or as 8, so that the first one decides for all; some may fall back on an id without wishes.

    And a book for each customer of circles of two topics; some want another container than there is, some one topic as two things.
    """
    k = F.col("o_orderkey")
    orders = table(spark, sf_dir, "orders")
    row = lambda component, topic, store, kind=None, dst=None, target=None, ref=None: F.struct(F.lit(component).cast("long").alias("component") if isinstance(component, int) else component.cast("long").alias("component"), topic.cast("int").alias("topic_seq"), store.cast("long").alias("store_id"), F.lit(kind).alias("dst_kind"), (F.lit(None) if dst is None else dst).cast("long").alias("dst"), F.lit(target).cast("int").alias("dst_target"), (F.lit(None) if ref is None else ref).cast("string").alias("required_ref"))
    hub = orders.select(F.explode(F.array_compact(F.array(row(0, k + 1, k, "topic", F.lit(0), ref=7 + (k % 3 == 0).cast("int")), F.when(k % 5 == 0, row(0, k + 1, k + 1000000000)), row(0, F.lit(0), F.lit(7)), row(0, F.lit(0), F.lit(8))))).alias("r"))
    c, a, b = F.col("o_custkey") + 1, 2 * k, 2 * k + 1
    loops = orders.select(F.explode(F.array_compact(F.array(
        row(c, a, a, "topic", b, ref=b), row(c, b, b, "topic", a, ref=a), row(c, a, a, "container", F.lit(1), 5, F.when(k % 7 == 0, "T6").otherwise("T5")),
        F.when(k % 11 == 0, row(c, a, a, "topic", b, ref=b + 1000000000)), F.when(k % 11 == 0, row(c, b, b + 1000000000)),
    ))).alias("r"))
    made = hub.select("r.*").distinct().unionByName(loops.select("r.*"))
    return graph.resolve(made)


@query("sampled_events", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY md5('7:' || event_id), event_id) AS k FROM events) WHERE k <= 3")
def sampled_events(spark, sf_dir):
    return order.sampled(table(spark, sf_dir, "events"), ["user_id"], "event_id", 3, seed=7).select("user_id", "event_id")


@query("shuffled_orders", "SELECT o_orderkey, row_number() OVER (ORDER BY md5('1:' || o_orderkey), o_orderkey) AS place FROM orders")
def shuffled_orders(spark, sf_dir):
    return order.shuffled(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", seed=1)


@query("inherited_styles", """WITH RECURSIVE s AS (SELECT p_partkey AS name, CASE WHEN p_partkey = 1 THEN 3 WHEN p_partkey % 50 = 0 THEN -1 ELSE p_partkey // 2 END AS parent, CASE WHEN p_partkey % 3 = 0 THEN p_type END AS font, CASE WHEN p_partkey % 7 = 0 THEN p_size END AS size FROM part),
    r AS (SELECT name AS style, 0 AS depth, parent, font, size FROM s UNION ALL SELECT r.style, depth + 1, s.parent, s.font, s.size FROM r JOIN s ON s.name = r.parent WHERE depth < 25)
    SELECT style AS name, arg_min(font, depth) FILTER (font IS NOT NULL) AS font, arg_min(size, depth) FILTER (size IS NOT NULL) AS size FROM r GROUP BY style""")
def inherited_styles(spark, sf_dir):
    """Parts as styles, each with half its number as parent; two are each other's, some have none."""
    k = F.col("p_partkey")
    parent = F.when(k == 1, 3).when(k % 50 == 0, -1).otherwise(F.floor(k / 2))
    styles = table(spark, sf_dir, "part").select(F.lit(1).alias("doc"), k.alias("name"), parent.cast("long").alias("parent"), F.when(k % 3 == 0, F.col("p_type")).alias("font"), F.when(k % 7 == 0, F.col("p_size")).alias("size"))
    return rules.inherited(styles, "doc", ["font", "size"]).select("name", "font", "size")
