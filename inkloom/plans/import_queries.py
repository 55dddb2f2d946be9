"""Queries of an import: sources, settings, the store, comparison, links, outlines. Tables of the driver play the books."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from inkloom.functions import text as X
from inkloom.functions import urls as U
from inkloom.operators import book_import, frontmatter, graph, markup, matching, outline, rules, splice
from inkloom.operators.scratch import drop_held, held, shared_folder
from inkloom.plans.catalog import query, table
from inkloom.sources import files, store
from inkloom.streaming import ingest

# Sources. Each nation is a book of a few files.


def _entries(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    s = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    made = [
        (F.when(k % 2 == 0, F.lit("publican.cfg")), s("# of ", k, "\nmainfile: Main", k % 3, "\nbrand: 'b", k, "'\nbrand: late\na:b:c\n\n")),
        (F.lit("en-US/Book_Info.xml"), s("<bookinfo><title>Guide ", k % 4, "</title></bookinfo>")),
        (F.when(k % 5 != 0, s("en-US/Guide_", k % 4, ".xml")), s("<book><title>", F.col("n_name"), "</title></book>")),
        (F.when(k % 3 == 0, F.lit("en-US/Main0.xml")), F.lit("<article>x</article>")),
        (F.lit("en-US/images/A.PNG"), F.lit("png")),
        (F.lit("tmp/en-US/x.xml"), F.lit("<x/>")),
        (F.lit(".hidden"), F.lit("")),
        (F.when(k % 6 == 0, F.lit("content.xml")), F.lit("<c/>")),
        (F.when(k % 4 == 0, F.lit("styles.xml")), F.lit("<s/>")),
        (F.lit("en-US/note.adoc"), F.lit("= Note")),
    ]
    rows = n.select(F.col("n_name").alias("source_id"), F.explode(F.array(*(F.struct(p.alias("path"), t.alias("text")) for p, t in made))).alias("e")).select("source_id", "e.path", "e.text")
    return rows.where("path IS NOT NULL").withColumn("content", F.encode("text", "UTF-8"))


@query("archive_roundtrip", "SELECT 'a' || page_id % 7 AS source_id, lpad(page_id::VARCHAR, 9, '0') || '.html' AS path, md5(html) AS content_md5, octet_length(encode(html))::INTEGER AS n_bytes, TRUE AS crc_fits FROM pages")
def archive_roundtrip(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    made = p.select(F.concat(F.lit("a"), (F.col("page_id") % 7).cast("string")).alias("source_id"), F.concat(F.lpad(F.col("page_id").cast("string"), 9, "0"), F.lit(".html")).alias("path"), F.col("html").alias("content"))
    read = files.unpack(files.pack(made)).where("error IS NULL")
    return read.select("source_id", "path", F.md5(files.text_of(F.col("content"))).alias("content_md5"), F.octet_length("content").alias("n_bytes"), (F.crc32("content") == F.col("crc32")).alias("crc_fits"))


@query("listing_places", """WITH e AS (SELECT n_name AS source_id, unnest(['en-US/Book_Info.xml', 'en-US/images/A.PNG', 'tmp/en-US/x.xml', '.hidden', 'en-US/note.adoc'] || CASE WHEN n_nationkey % 2 = 0 THEN ['publican.cfg'] ELSE [] END || CASE WHEN n_nationkey % 5 <> 0 THEN ['en-US/Guide_' || n_nationkey % 4 || '.xml'] ELSE [] END
      || CASE WHEN n_nationkey % 3 = 0 THEN ['en-US/Main0.xml'] ELSE [] END || CASE WHEN n_nationkey % 6 = 0 THEN ['content.xml'] ELSE [] END || CASE WHEN n_nationkey % 4 = 0 THEN ['styles.xml'] ELSE [] END) AS path FROM nation)
    SELECT source_id, path, row_number() OVER (PARTITION BY source_id ORDER BY len(string_split(path, '/')), lower(path), path)::INTEGER AS place FROM e""")
def listing_places(spark, sf_dir):
    return files.listing(_entries(spark, sf_dir)).select("source_id", "path", "place")


@query("entry_exists", "SELECT n_name AS source_id, 'EN-US/BOOK_INFO.XML' AS name, TRUE AS found, FALSE AS exact FROM nation UNION ALL SELECT n_name, 'publican.cfg', n_nationkey % 2 = 0, n_nationkey % 2 = 0 FROM nation UNION ALL SELECT n_name, 'none', FALSE, FALSE FROM nation")
def entry_exists(spark, sf_dir):
    e = _entries(spark, sf_dir)
    wanted = e.select("source_id").distinct().select("source_id", F.explode(F.array(*map(F.lit, ("EN-US/BOOK_INFO.XML", "publican.cfg", "none")))).alias("name"))
    return files.exists(e, wanted, True).join(files.exists(e, wanted).withColumnRenamed("found", "exact"), ["source_id", "name"])


@query("book_settings", "SELECT n_name AS source_id, unnest(['mainfile', 'brand']) AS name, unnest(['Main' || n_nationkey % 3, 'b' || n_nationkey]) AS value FROM nation WHERE n_nationkey % 2 = 0")
def book_settings(spark, sf_dir):
    return files.settings(_entries(spark, sf_dir).where(F.col("path") == files.SETTINGS_FILE), "text", "source_id")


@query("book_main_file", """SELECT n_name AS source_id, CASE WHEN n_nationkey % 2 = 0 AND n_nationkey % 3 = 0 THEN 'en-US/Main0.xml' ELSE 'en-US/Guide_' || n_nationkey % 4 || '.xml' END AS main_file FROM nation WHERE n_nationkey % 6 = 0 OR n_nationkey % 5 <> 0""")
def book_main_file(spark, sf_dir):
    return files.main_file_of_book(_entries(spark, sf_dir), "en-US")


@query("sniffed_main_file", "SELECT n_name AS source_id, CASE WHEN n_nationkey % 5 <> 0 THEN 'en-US/Guide_' || n_nationkey % 4 || '.xml' ELSE 'en-US/Main0.xml' END AS main_file FROM nation WHERE n_nationkey % 5 <> 0 OR n_nationkey % 3 = 0")
def sniffed_main_file(spark, sf_dir):
    return files.main_file(_entries(spark, sf_dir), 25)


@query("main_file_candidates", "SELECT n_name AS source_id, 3 + (n_nationkey % 5 <> 0)::INTEGER + (n_nationkey % 3 = 0)::INTEGER + (n_nationkey % 6 = 0)::INTEGER + (n_nationkey % 4 = 0)::INTEGER - 1 AS n_xml, 3 + (n_nationkey % 2 = 0)::INTEGER + (n_nationkey % 5 <> 0)::INTEGER + (n_nationkey % 3 = 0)::INTEGER + (n_nationkey % 6 = 0)::INTEGER + (n_nationkey % 4 = 0)::INTEGER AS n_text FROM nation")
def main_file_candidates(spark, sf_dir):
    e = _entries(spark, sf_dir)
    counted = lambda kind, name: files.candidates(e, kind).groupBy("source_id").agg(F.count("*").cast("int").alias(name))
    return counted("xml", "n_xml").join(counted("asciidoc", "n_text"), "source_id")


@query("book_problems", "SELECT n_name AS source_id, CASE WHEN n_nationkey % 2 = 0 THEN '' ELSE 'no settings' END AS problems, n_nationkey % 12 = 0 AS is_office_text FROM nation")
def book_problems(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return files.book_problems(e, "en-US").select("source_id", F.array_join("problems", ",").alias("problems")).join(files.is_office_text(e), "source_id")


@query("config_names", r"""WITH f AS (SELECT p_partkey, p_brand AS source_id, CASE p_partkey % 5 WHEN 0 THEN 'publican.cfg' WHEN 1 THEN 'x' || p_partkey || '-publican.cfg' WHEN 2 THEN 'alpha' || p_partkey || '.cfg' WHEN 3 THEN p_partkey || '.cfg' ELSE 'bpublican' || p_partkey || '.cfg' END AS path FROM part)
    SELECT source_id, path, CASE p_partkey % 5 WHEN 0 THEN path WHEN 1 THEN path WHEN 2 THEN 'alpha' || p_partkey || '-publican.cfg' WHEN 4 THEN 'b' || p_partkey || '-publican.cfg' ELSE 'config' || row_number() OVER (PARTITION BY source_id, p_partkey % 5 ORDER BY path) || '-publican.cfg' END AS config_name FROM f""")
def config_names(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    path = F.when(F.col("p_partkey") % 5 == 0, "publican.cfg").when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("x"), k, F.lit("-publican.cfg"))).when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("alpha"), k, F.lit(".cfg"))).when(F.col("p_partkey") % 5 == 3, F.concat(k, F.lit(".cfg"))).otherwise(F.concat(F.lit("bpublican"), k, F.lit(".cfg")))
    return files.config_names(table(spark, sf_dir, "part").select(F.col("p_brand").alias("source_id"), path.alias("path")))


@query("config_lines", "SELECT p_partkey AS path, 'brand: ' || p_brand || chr(10) || 'size: ' || p_size AS lines FROM part")
def config_lines(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("\nbrand: "), "p_brand", F.lit("\nxml_lang: en\n  \nsize: "), F.col("p_size").cast("string"), F.lit("\ntype : x"))
    return files.config_lines(p.select(F.col("p_partkey").alias("path"), text.alias("text")), ["xml_lang", "type"]).select("path", F.array_join("lines", "\n").alias("lines"))


@query("source_names", "SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/')[1] AS name FROM pages")
def source_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.source_name(F.regexp_replace("url", "^[a-z]+://", "")).alias("name"))


# The store.


def _settings(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    item = F.struct(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("value"), F.lower("n_name").alias("translationValue"), F.concat(F.lit("b-"), "n_name").alias("buildValue")).alias("item"))
    return n.groupBy().agg(F.collect_list(item).alias("items")).select(F.to_json(F.struct(F.struct("items").alias("locales"), F.struct(F.lit(3).alias("id"), F.lit("x").alias("value")).alias("defaultLocale"))).alias("json"))


@query("locales", "SELECT n_nationkey AS locale_id, n_name AS value, lower(n_name) AS translation, 'b-' || n_name AS build, n_nationkey = 3 AS is_default FROM nation")
def locales(spark, sf_dir):
    return store.locales(_settings(spark, sf_dir))


@query("locale_lookup", "SELECT c_custkey, n_nationkey AS locale_id, n_name AS locale_value FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND c_custkey % 9 > 0")
def locale_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 9 > 0, F.col("c_nationkey")).otherwise(-1).alias("locale"))
    return store.with_locale(c, store.locales(_settings(spark, sf_dir)), "id").select("c_custkey", "locale_id", "locale_value")


@query("servers", "SELECT CASE WHEN p_partkey % 3 = 0 THEN 'Default (own.host)' ELSE 's' || p_partkey END AS name, CASE WHEN p_partkey % 3 = 0 THEN 'own.host' ELSE 'h' || p_partkey || '.org' END AS host FROM part")
def servers(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    listed = F.concat(F.lit('[{"serverName":"s'), k, F.lit('","restUrl":"http://h'), k, F.lit('.org:8080/rest"}]'))
    return store.servers(table(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 > 0, listed).when(F.col("p_partkey") % 2 == 0, "broken").alias("json")), "own.host")


@query("spec_topics", "WITH m AS (SELECT DISTINCT o_custkey AS spec, o_orderkey % 500 AS store_id FROM orders), u AS (SELECT store_id, count(*) AS n_specs FROM m GROUP BY store_id) SELECT spec, store_id, n_specs, s_name AS title FROM m JOIN u USING (store_id) JOIN supplier ON s_suppkey = store_id")
def spec_topics(spark, sf_dir):
    members = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("spec"), (F.col("o_orderkey") % 500).alias("store_id"))
    return store.in_spec(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("title")), members).select("spec", "store_id", "n_specs", "title")


@query("available_unique", "SELECT l_suppkey * 100 + l_partkey % 100 AS store_id FROM (SELECT DISTINCT l_orderkey, l_suppkey, l_partkey FROM lineitem) GROUP BY 1 HAVING count(*) = 1")
def available_unique(spark, sf_dir):
    members = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_partkey").distinct()
    return matching.available(members.select((F.col("l_suppkey") * 100 + F.col("l_partkey") % 100).alias("store_id")))


@query("topic_rows", "SELECT p_partkey AS key, CASE WHEN p_partkey % 7 > 0 THEN p_name END AS title, CASE WHEN p_partkey % 7 > 0 THEN p_name END AS description, CASE p_partkey % 3 WHEN 0 THEN 'DOCBOOK_45' WHEN 1 THEN 'DOCBOOK_50' END AS xml_format, p_size || ':1' AS tags FROM part")
def topic_rows(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    version = F.element_at(F.array(*map(F.lit, ("4.5", "5.0", "6.0"))), (F.col("p_partkey") % 3 + 1).cast("int"))
    rows = store.topic_rows(p.select(F.col("p_partkey").alias("key"), F.lit("<a/>").alias("xml"), F.when(F.col("p_partkey") % 7 > 0, F.col("p_name")).otherwise("").alias("title"), F.array("p_size").alias("tags"), version.alias("version")))
    return rows.select("key", "title", "description", "xml_format", F.array_join(F.transform("tags", lambda t: F.concat_ws(":", t["id"], t["state"])), ",").alias("tags"))


@query("created_topics", """WITH s AS (SELECT p_brand AS xml, min(p_partkey) AS store_id FROM part WHERE p_partkey % 2 = 0 GROUP BY p_brand), k AS (SELECT DISTINCT c_mktsegment AS xml FROM customer),
    n AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 4 = 1 THEN (SELECT min(xml) FROM k) ELSE p_brand END AS xml FROM part)
    SELECT key, CASE WHEN s.store_id IS NULL THEN -dense_rank() OVER (PARTITION BY s.store_id IS NULL ORDER BY n.xml) ELSE s.store_id END AS store_id, s.store_id IS NOT NULL AS matched FROM n LEFT JOIN s USING (xml)""")
def created_topics(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    least = table(spark, sf_dir, "customer").agg(F.min("c_mktsegment").alias("seg"))
    new = p.crossJoin(F.broadcast(least)).select(F.col("p_partkey").alias("key"), F.when(F.col("p_partkey") % 4 == 1, F.col("seg")).otherwise(F.col("p_brand")).alias("xml"), F.lit("t").alias("title"), F.array(F.lit(1)).alias("tags"), F.lit(3).alias("locale_id"), F.lit("5.0").alias("version"))
    known = p.where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("store_id"), F.col("p_brand").alias("xml"), F.lit("DOCBOOK_50").alias("xml_format"), F.lit(3).alias("locale_id"))
    made = store.create_topics(new, known).join(new.select("key", "xml"), "key")
    # New ids follow hashes; by content they are shown as -1, -2, ...
    rank = F.dense_rank().over(Window.partitionBy("matched").orderBy("xml"))
    return made.select("key", F.when(F.col("matched"), F.col("store_id")).otherwise(-rank).cast("long").alias("store_id"), "matched")


@query("matched_images", "WITH s AS (SELECT p_type AS content, min(p_partkey) AS store_id FROM part WHERE p_size > 25 GROUP BY p_type) SELECT count(*) AS contents, count(s.store_id) AS matched, sum(s.store_id)::BIGINT AS ids, (SELECT max(p_partkey) FROM part WHERE p_size > 25) + count(*) - count(s.store_id) AS top FROM (SELECT DISTINCT p_type AS content FROM part) LEFT JOIN s USING (content)")
def matched_images(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    known = p.where("p_size > 25").select(F.col("p_partkey").alias("store_id"), F.col("p_type").alias("content"))
    got = store.create_or_match(p.select(F.col("p_type").alias("content")), known)
    return got.agg(F.count("*").alias("contents"), F.count_if("matched").alias("matched"), F.sum(F.when(F.col("matched"), F.col("store_id"))).alias("ids"), F.greatest(F.max(F.when(~F.col("matched"), F.col("store_id"))), F.lit(0)).alias("t")).crossJoin(known.agg(F.max("store_id").alias("m"))).select("contents", "matched", "ids", F.greatest("t", "m").alias("top"))


@query("sparse_update", "SELECT p_partkey AS store_id, CASE WHEN p_partkey % 3 = 0 THEN 'new ' || p_size ELSE p_name END AS title, p_brand AS xml FROM part")
def sparse_update(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return store.sparse_update(p.select(F.col("p_partkey").alias("store_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("xml")), p.where("p_partkey % 3 = 0").select(F.col("p_partkey").alias("store_id"), F.concat(F.lit("new "), F.col("p_size").cast("string")).alias("title")), ["title"])


@query("written_specs", "SELECT s_suppkey AS spec_id, CASE WHEN s_suppkey % 2 = 0 THEN 'ID = ' || s_suppkey || chr(10) || s_name ELSE 'old' END AS text FROM supplier UNION ALL SELECT (SELECT max(s_suppkey) FROM supplier) + 1, 'fresh'")
def written_specs(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    new = s.where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("spec_id"), F.col("s_name").alias("text")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS spec_id, 'fresh' AS text"))
    return store.write_specs(new, s.select(F.col("s_suppkey").alias("spec_id"), F.lit("old").alias("text")))


@query("image_rewrite", """SELECT p_partkey AS key, '<imagedata fileref="' || CASE WHEN p_size % 2 = 0 THEN 'images/' || 1000 + p_size || '.png' ELSE 'a' || p_size || '.png' END || '"/><imagedata fileref="b.svg"/>' AS xml FROM part""")
def image_rewrite(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    name = F.concat(F.lit("a"), F.col("p_size").cast("string"), F.lit(".png"))
    up = p.where("p_size % 2 = 0").select(F.lit(1).alias("source"), name.alias("fileref"), (1000 + F.col("p_size")).alias("store_id")).distinct()
    topics = p.select(F.lit(1).alias("source"), F.col("p_partkey").alias("key"), F.concat(F.lit('<imagedata fileref="'), name, F.lit('"/><imagedata fileref="b.svg"/>')).alias("xml"))
    return store.rewrite_images(topics, up).select("key", "xml")


@query("page_bodies", "SELECT page_id, html FROM pages")
def page_bodies(spark, sf_dir):
    body = F.concat(F.lit("throw 'allowIllegalResourceCall is false.';\n"), F.to_json(F.struct(F.array(F.struct(F.struct(F.struct(F.col("html").alias("text")).alias("content")).alias("x"))["x"]).alias("list"))))
    return store.page_source(table(spark, sf_dir, "pages").select("page_id", body.alias("body"))).select("page_id", "html")


@query("envelope_topics", "SELECT p_partkey AS store_id, p_name AS xml, 'DOCBOOK_50' AS xml_format, p_size AS locale_id FROM part WHERE p_size = 7")
def envelope_topics(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    item = F.struct(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("xml"), F.lit("DOCBOOK_50").alias("xmlFormat"), F.struct(F.col("p_size").alias("id")).alias("locale")).alias("item"))
    rows = store.from_envelope(p.groupBy("p_brand").agg(F.collect_list(item).alias("items")).select(F.to_json(F.struct(F.size("items").alias("size"), "items")).alias("json")))
    return matching.same_kind(rows, "DOCBOOK_50", 7)


# Comparison.


def _variants(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey").repartition("p_partkey")  # keys are few bytes a row, and comparing is much work
    k = F.col("p_partkey").cast("string")
    a = F.concat(F.lit('<section b="1" a="'), k, F.lit('"><title>It\'s "x"</title><para>one two</para><screen>a  b</screen><!-- Inject: 5 --></section>'))
    swaps = {
        1: (' b="1" a=', " a="), 2: ("one two", "one \n\t two"), 3: ("a  b", "a b"), 4: ("Inject: 5", "Inject: T77"), 5: ("It's \"x\"", "It’s &quot;x”"), 6: ("section", "chapter"), 7: ("one two", "one three"), 8: ("<para>", "<!-- gone --><para remap=\"r\" xmlns=\"http://docbook.org/ns/docbook\">"), 9: ("<para>one two</para>", "<para>one two</para>\n  "),
    }
    b = a
    for n, (old, new) in swaps.items():
        changed = F.replace(a, F.lit(old), F.lit(new)) if n != 1 else F.replace(F.replace(a, F.lit(' b="1" a="'), F.lit(' a="')), F.lit("><title>"), F.lit(" b='1'><title>"))
        b = F.when(F.col("p_partkey") % 10 == n, changed).otherwise(b)
    return p.select("p_partkey", a.alias("a"), b.alias("b"))


@query("compared_variants", "SELECT p_partkey, p_partkey % 10 NOT IN (3, 7) AS lenient, p_partkey % 10 NOT IN (3, 4, 7) AS strict FROM part")
def compared_variants(spark, sf_dir):
    """Attributes in another order, layout, quotation marks, comments, the root's name count as nothing; words and the layout of a screen count; injections count if strict."""
    v = _variants(spark, sf_dir)
    return v.select("p_partkey", (X.canonical_key(F.col("a")) == X.canonical_key(F.col("b"))).alias("lenient"), (X.strict_key(F.col("a")) == X.strict_key(F.col("b"))).alias("strict"))


@query("topic_changed", "SELECT p_partkey, p_partkey % 10 IN (3, 4, 7) AS changed, p_partkey % 10 IN (3, 4, 7) AS updated FROM part")
def topic_changed(spark, sf_dir):
    v = _variants(spark, sf_dir)
    return v.select("p_partkey", splice.changed(F.col("a"), F.col("b")).alias("changed"), splice.changed(F.col("b"), F.col("a")).alias("updated"))


@query("parsed_texts", """SELECT p_partkey, CASE WHEN p_size % 5 > 0 THEN '<a k="' || p_size || '" z="&amp;"><b/>&nbsp;' || p_name || '</a>' END AS xml FROM part""")
def parsed_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("<a z='&amp;' k='"), F.col("p_size").cast("string"), F.lit("'><b></b>&nbsp;"), "p_name", F.when(F.col("p_size") % 5 > 0, "</a>").otherwise("</b>"))
    return markup.parsed(p.select("p_partkey", text.alias("xml")), "p_partkey", "xml")


@query("xpath_any_namespace", "SELECT p_partkey, p_name AS title, p_brand AS other, 2::BIGINT AS n_paras, 0::BIGINT AS n_none FROM part")
def xpath_any_namespace(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    xml = F.concat(F.lit('<d:book xmlns:d="http://docbook.org/ns/docbook"><d:title>'), "p_name", F.lit('</d:title><d:para/><sec xmlns="urn:x"><para role="r">'), "p_brand", F.lit("</para></sec></d:book>"))
    found = markup.select_nodes(markup.nodes(p.select("p_partkey", xml.alias("xml")), "p_partkey", "xml", xml=True), "p_partkey", {"title": "/docbook:book/title", "other": ".//docbook:para[@role]", "paras": "//para", "none": "//x/para"})
    counted = found.groupBy("p_partkey").agg(F.max(F.when(F.col("path") == "title", F.col("value"))).alias("title"), F.max(F.when(F.col("path") == "other", F.col("value"))).alias("other"), F.count_if(F.col("path") == "paras").alias("n_paras"), F.count_if(F.col("path") == "none").alias("n_none"))
    return counted


@query("folded_links", """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN '<p><!-- InjectPlaceholder: 0 --> and <!-- InjectPlaceholder: 0 --></p>' ELSE '<p><xref linkend="k' || p_size || '"/> and <link linkend=''k' || p_size || '''>x</link></p>' END AS xml FROM part""")
def folded_links(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    k = F.concat(F.lit("k"), F.col("p_size").cast("string"))
    xml = F.concat(F.lit('<p><xref linkend="'), k, F.lit("\"/> and <link linkend='"), k, F.lit("'>x</link></p>"))
    return p.select("p_partkey", X.fold_xrefs(xml, F.when(F.col("p_size") % 2 == 0, F.array(k))).alias("xml"))


@query("cleaned_markup", """SELECT p_partkey, '<para>' || p_name || '</para>' AS unwrapped, 'x' AS boilerplate, CASE p_size % 3 WHEN 0 THEN 'INI Files' WHEN 1 THEN 'JavaScript' ELSE p_brand END AS lang, CASE WHEN p_size % 2 = 0 THEN p_brand || '/' END AS base,
    '<section><title id="t">' || p_name || '</title></section>' AS no_id, '<section id="s"><title>' || p_name || '</title></section>' AS no_title_id, CASE WHEN p_size % 2 = 0 THEN p_size || '-' || p_partkey % 10 ELSE p_size || '.0.1' END AS revision FROM part""")
def cleaned_markup(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    size = F.col("p_size").cast("string")
    language = F.element_at(F.array(F.lit("ini"), F.lit("json"), F.col("p_brand")), (F.col("p_size") % 3 + 1).cast("int"))
    known = F.coalesce(X.listing_language(language), language)
    base = F.concat(F.lit('<a xml:base="'), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("./"), F.lit('"/>'))
    titled = F.concat(F.lit('<section id="s"><title id="t">'), "p_name", F.lit("</title></section>"))
    return p.select(
        "p_partkey", X.unwrap(F.concat(F.lit('<partintro id="i"><para>'), "p_name", F.lit("</para></partintro>"))).alias("unwrapped"), X.drop_boilerplate(F.concat(F.lit("x<para id='1' role='RoleCreateBugPara'>\n"), "p_name", F.lit("</para>"))).alias("boilerplate"),
        known.alias("lang"), X.xml_base(base).alias("base"), X.strip_attributes(titled).alias("no_id"), X.strip_attributes(titled, "title").alias("no_title_id"),
        X.revision_number(F.concat(size, F.lit("."), F.when(F.col("p_size") % 2 == 0, (F.col("p_partkey") % 10).cast("string")).otherwise("0.1"))).alias("revision"),
    )


@query("version_format", "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN '5.0' WHEN 1 THEN '4.5' WHEN 2 THEN '5.0' ELSE '4.5' END AS xml_format, CASE WHEN p_size % 4 = 0 THEN 'updating' WHEN p_size % 4 = 1 THEN 'reusing' ELSE 'creating' END AS mode FROM part")
def version_format(spark, sf_dir):
    n = F.col("p_size") % 4
    return table(spark, sf_dir, "part").select("p_partkey", X.xml_format(F.when(n == 0, "5.0").when(n == 1, "4.5"), F.when(n == 2, "5.0").otherwise("4.5")).alias("xml_format"), X.import_mode(F.when(n == 0, F.col("p_partkey")), n == 1).alias("mode"))


@query("built_topics", r"""SELECT p_partkey, '<section>' || chr(10) || '<title>\[' || p_name || '\]</title>' || chr(10) || p_brand || chr(10) || 'x' || chr(10) || chr(10) || '</section>' || chr(10) AS topic, '<chapter>' || chr(10) || '<title>' || p_name || '</title>' || chr(10) AS opened, '</chapter>' AS closed FROM part""")
def built_topics(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", X.topic_element(F.concat(F.lit("["), "p_name", F.lit("]")), F.array(F.col("p_brand"), F.lit("x"))).alias("topic"), X.open_element(F.lit("Chapter"), F.col("p_name")).alias("opened"), X.close_element(F.lit("Chapter")).alias("closed"))


@query("long_timestamps", "SELECT event_id, strftime(ts, '%A, %B %-d') || CASE WHEN day(ts) IN (1, 21, 31) THEN 'st' WHEN day(ts) IN (2, 22) THEN 'nd' WHEN day(ts) IN (3, 23) THEN 'rd' ELSE 'th' END || strftime(ts, ' %Y, ') || ((hour(ts) + 11) % 12 + 1) || strftime(ts, ':%M:%S ') || CASE WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END AS shown FROM events")
def long_timestamps(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", X.long_timestamp(F.col("ts")).alias("shown"))


@query("flat_paras", "SELECT p_partkey, '<para>' || p_name || '</para>' || CASE WHEN p_size % 2 = 0 THEN '<para>inner</para>' ELSE '' END || CASE WHEN p_size % 3 = 0 THEN '<para>tail</para>' ELSE '' END AS xml FROM part")
def flat_paras(spark, sf_dir):
    parts = F.array_compact(F.array(F.col("p_name"), F.lit("<para>"), F.when(F.col("p_size") % 2 == 0, "inner"), F.lit("</para>"), F.when(F.col("p_size") % 3 == 0, "tail")))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(X.flatten_paras(parts), "").alias("xml"))


# Matching.


@query("greedy_assignment", """WITH RECURSIVE c AS (SELECT l_suppkey AS spec, l_linenumber AS topic_seq, l_partkey AS store_id, min(l_orderkey) AS place, bool_or(l_discount >= 0.1) AS equivalent, l_linenumber % 5 AS batch_key FROM lineitem GROUP BY l_suppkey, l_linenumber, l_partkey),
    o AS (SELECT *, row_number() OVER (PARTITION BY spec ORDER BY pass, topic_seq, place, store_id) AS n FROM (SELECT *, 0 AS pass FROM c WHERE equivalent UNION ALL SELECT *, 1 FROM c) x),
    w(spec, n, topics, ids, how) AS (SELECT spec, 0::BIGINT, []::INTEGER[], []::BIGINT[], []::INTEGER[] FROM (SELECT DISTINCT spec FROM c) UNION ALL
      SELECT w.spec, o.n, CASE WHEN NOT list_contains(topics, o.topic_seq) AND NOT list_contains(ids, o.store_id) THEN list_append(topics, o.topic_seq) ELSE topics END, CASE WHEN NOT list_contains(topics, o.topic_seq) AND NOT list_contains(ids, o.store_id) THEN list_append(ids, o.store_id) ELSE ids END, CASE WHEN NOT list_contains(topics, o.topic_seq) AND NOT list_contains(ids, o.store_id) THEN list_append(how, o.pass) ELSE how END
      FROM w JOIN o ON o.spec = w.spec AND o.n = w.n + 1),
    e AS (SELECT spec, topics, ids, how FROM w WHERE n = (SELECT max(n) FROM o WHERE o.spec = w.spec)),
    d AS (SELECT spec, unnest(topics) AS topic_seq, unnest(ids) AS store_id, unnest(how) AS pass FROM e),
    t AS (SELECT DISTINCT spec, topic_seq, batch_key FROM c),
    k AS (SELECT d.*, batch_key FROM d JOIN t USING (spec, topic_seq))
    SELECT t.spec, t.topic_seq, CASE WHEN any_value(d.pass) = 0 THEN 'EXACT' WHEN any_value(d.pass) = 1 THEN 'SIMILAR' WHEN arg_min(k.store_id, k.topic_seq) IS NOT NULL THEN 'MATCHED' ELSE 'NEW' END AS status, coalesce(any_value(d.store_id), arg_min(k.store_id, k.topic_seq)) AS store_id
    FROM t LEFT JOIN d USING (spec, topic_seq) LEFT JOIN k ON k.spec = t.spec AND k.batch_key = t.batch_key AND (k.pass = 0 OR k.topic_seq < t.topic_seq) GROUP BY t.spec, t.topic_seq""")
def greedy_assignment(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    c = l.groupBy(F.col("l_suppkey").alias("spec"), F.col("l_linenumber").alias("topic_seq"), F.col("l_partkey").alias("store_id")).agg(F.min("l_orderkey").alias("place"), F.bool_or(F.col("l_discount") >= 0.1).alias("equivalent"))
    return matching.greedy(c.withColumn("batch_key", (F.col("topic_seq") % 5).cast("string")))


@query("removed_topics", "WITH m AS (SELECT DISTINCT l_suppkey AS spec, l_partkey AS store_id FROM lineitem) SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_suppkey = m.spec AND l.l_partkey = m.store_id AND l.l_returnflag = 'R')")
def removed_topics(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("spec"), F.col("l_partkey").alias("store_id"), "l_returnflag")
    return matching.removed(l.select("spec", "store_id").distinct(), l.where("l_returnflag = 'R'"))


@query("newest_candidates", "SELECT o_custkey AS topic_key, o_orderkey AS store_id, rn::INTEGER AS place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn <= 3")
def newest_candidates(spark, sf_dir):
    return matching.newest(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("topic_key"), F.col("o_orderkey").alias("store_id")), 3)


@query("lowest_candidate", "SELECT o_custkey AS topic_key, min(o_orderkey) AS store_id FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey")
def lowest_candidate(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return matching.lowest_candidate(o.select(F.col("o_custkey").alias("topic_key"), F.col("o_orderkey").alias("store_id"), (F.col("o_orderstatus") == "F").alias("equivalent")))


@query("import_counters", "SELECT l_returnflag AS kind, count(*) AS all_rows, count(*) FILTER (l_linestatus = 'O') AS new_rows, count(*) FILTER (l_linestatus <> 'O') AS matched_rows FROM lineitem GROUP BY ALL")
def import_counters(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return matching.counters(l.select(F.col("l_returnflag").alias("kind"), F.when(F.col("l_linestatus") == "O", "NEW").otherwise("REUSED").alias("status")), "kind")


# Links and structure.


def _linked(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a, b = (F.col("o_orderkey") % 97).cast("string"), (F.col("o_orderkey") % 53).cast("string")
    xml = F.concat(F.lit('<para><xref linkend="k'), a, F.lit("\"/><link linkend='k"), b, F.lit("'>x</link><xref linkend=\"none\"/></para>"))
    return o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("src"), xml.alias("xml"))


@query("link_edges", "SELECT o_custkey AS doc_id, o_orderkey AS src, unnest([0, 1, 2]) AS ord, unnest(['k' || o_orderkey % 97, 'k' || o_orderkey % 53, 'none']) AS linkend FROM orders")
def link_edges(spark, sf_dir):
    return graph.edges_of(_linked(spark, sf_dir))


_IDS = "(SELECT DISTINCT o_custkey AS doc_id, 'k' || o_orderkey % 60 AS linkend FROM orders)"


@query("known_edges", f"""SELECT doc_id, src, ord, linkend, (row_number() OVER (PARTITION BY doc_id, src ORDER BY ord) - 1)::INTEGER AS place FROM (SELECT o_custkey AS doc_id, o_orderkey AS src, unnest([0, 1]) AS ord, unnest(['k' || o_orderkey % 97, 'k' || o_orderkey % 53]) AS linkend FROM orders) JOIN {_IDS} USING (doc_id, linkend)""")
def known_edges(spark, sf_dir):
    ids = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("k"), (F.col("o_orderkey") % 60).cast("string")).alias("linkend"))
    return graph.edges_known(graph.edges_of(_linked(spark, sf_dir)), ids).select("doc_id", "src", "ord", "linkend", "place")


@query("stored_links", """SELECT o_custkey AS doc_id, o_orderkey AS src, o_orderkey + 1 AS store_id, unnest(['k' || o_orderkey % 97, 'k' || o_orderkey % 53, 'none'] || CASE WHEN o_orderkey % 2 = 0 THEN [NULL] ELSE [] END) AS linkend,
    unnest(['11', 'T' || o_orderkey % 9, '13'] || CASE WHEN o_orderkey % 2 = 0 THEN ['14'] ELSE [] END) AS required_ref, unnest([TRUE, TRUE, TRUE] || CASE WHEN o_orderkey % 2 = 0 THEN [FALSE] ELSE [] END) AS fits FROM orders""")
def stored_links(spark, sf_dir):
    t = _linked(spark, sf_dir)
    text = F.concat(F.lit("<p><!-- Inject: 11 --><!--Inject : T"), (F.col("src") % 9).cast("string"), F.lit("--><!-- Inject: 13 -->"), F.when(F.col("src") % 2 == 0, "<!-- Inject: 14 -->").otherwise("<!-- InjectText: 14 -->"))
    edges = graph.edges_of(t).withColumnRenamed("ord", "place")
    return graph.stored_links(edges, t.select("doc_id", "src", (F.col("src") + 1).alias("store_id"), text.alias("xml")))


@query("constraint_conflicts", "SELECT DISTINCT topic_key, store_id FROM (SELECT l_suppkey AS topic_key, l_partkey AS store_id, 'k' || l_linenumber % 3 AS t FROM lineitem GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1)")
def constraint_conflicts(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    return graph.conflicts(l.select(F.col("l_suppkey").alias("topic_key"), F.col("l_partkey").alias("store_id"), F.concat(F.lit("k"), (F.col("l_linenumber") % 3).cast("string")).alias("target_xml_id"), F.col("l_returnflag").alias("required_ref")))


@query("known_ids", """WITH i AS (SELECT c_nationkey AS doc_id, 0 AS r, c_custkey AS seq, unnest([0, 1]) AS pos, unnest(['k' || c_custkey % 40, 'm' || c_custkey % 7]) AS linkend FROM customer UNION ALL SELECT s_nationkey, 1, s_suppkey, 0, 'k' || s_suppkey % 50 FROM supplier),
    f AS (SELECT doc_id, linkend, min({'r': r, 'seq': seq, 'pos': pos}) AS first FROM i GROUP BY ALL) SELECT doc_id, linkend, row_number() OVER (PARTITION BY doc_id ORDER BY first)::INTEGER AS place FROM f""")
def known_ids(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    name = lambda p, col, n: F.concat(F.lit(p), (F.col(col) % n).cast("string"))
    topics = c.select(F.col("c_nationkey").alias("doc_id"), F.col("c_custkey").alias("seq"), F.lit("topic").alias("kind"), F.array(name("k", "c_custkey", 40), name("m", "c_custkey", 7)).alias("xml_ids"))
    boxes = s.select(F.col("s_nationkey").alias("doc_id"), F.col("s_suppkey").alias("seq"), F.lit("container").alias("kind"), F.array(name("k", "s_suppkey", 50)).alias("xml_ids"))
    return graph.known_ids(topics.unionByName(boxes))


@query("duplicate_ids", "SELECT c_nationkey AS doc_id, c_mktsegment AS linkend, count(*) AS n FROM customer GROUP BY ALL HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return graph.duplicate_ids(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("doc_id"), F.array("c_mktsegment").alias("xml_ids")))


@query("disallowed_topics", "SELECT doc_id, string_agg(topic_id, ',' ORDER BY topic_id) AS topics FROM (SELECT DISTINCT page_id % 10 AS doc_id, page_id AS topic_id FROM pages WHERE NOT (contains(url, 'example') AND contains(url, '/en/'))) GROUP BY doc_id")
def disallowed_topics(spark, sf_dir):
    return U.disallowed_topics(table(spark, sf_dir, "pages").select((F.col("page_id") % 10).alias("doc_id"), F.col("page_id").alias("topic_id"), "url"), ["example", "/en/"])


@query("valid_inputs", "SELECT p_partkey, p_partkey % 2 = 0 AS page, p_partkey % 3 = 0 AS spec, p_partkey % 5 = 0 AS archive FROM part")
def valid_inputs(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    url = F.concat(F.lit("https://h.org/docs/"), F.when(F.col("p_partkey") % 2 == 0, "DOC-").otherwise("PAGE-"), k)
    return table(spark, sf_dir, "part").select("p_partkey", U.is_valid(url, "page").alias("page"), U.is_valid(F.when(F.col("p_partkey") % 3 == 0, k).when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("a"), k)), "spec").alias("spec"), U.is_valid(F.concat(k, F.when(F.col("p_partkey") % 5 == 0, ".ZIP").otherwise(".zip.txt")), "archive").alias("archive"))


@query("spec_files", "SELECT p_partkey, p_partkey % 2 = 0 AND p_partkey % 3 > 0 AS is_file, p_partkey % 2 = 0 AS is_root FROM part")
def spec_files(spark, sf_dir):
    k = F.col("p_partkey")
    path = F.concat(F.when(k % 2 == 0, "en-US/files/a/").otherwise("en-US/files.d/"), F.when(k % 3 > 0, F.concat(k.cast("string"), F.lit(".txt"))).otherwise("."))
    root = F.concat(F.lit("<!-- c -->\n<"), F.when(k % 4 == 0, "book").when(k % 4 == 2, "article").otherwise("section"), F.lit(' id="x">'))
    return table(spark, sf_dir, "part").select("p_partkey", files.in_files_folder(path, "en-US").alias("is_file"), markup.root_element(root).isin("book", "article").alias("is_root"))


def _books(spark, sf_dir):
    """Each customer's orders are the sections of a book, in chapters by status; some are empty, some have infos."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    section = F.concat(F.lit("<section id='s"), k, F.lit("'><title>S [" ), k, F.lit("]</title>"), F.when(F.col("o_orderkey") % 3 > 0, "<para>x</para>").otherwise(""), F.lit("</section>"))
    per = o.groupBy(F.col("o_custkey").alias("doc_id"), "o_orderstatus").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", section.alias("x")))), lambda s: s["x"]), "").alias("x"))
    chapter = F.concat(F.lit("<chapter id='c"), "o_orderstatus", F.lit("'><title>"), "o_orderstatus", F.lit("</title>"), "x", F.lit("</chapter>"))
    return per.groupBy("doc_id").agg(F.concat(F.lit("<book><title>B</title><bookinfo><title>I</title></bookinfo>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderstatus", chapter.alias("x")))), lambda s: s["x"]), ""), F.lit("<appendix><title>A</title></appendix></book>")).alias("xml"))


@query("shredded_books", """WITH s AS (SELECT DISTINCT o_custkey AS doc_id, o_orderstatus AS st FROM orders), c AS (SELECT *, dense_rank() OVER (PARTITION BY doc_id ORDER BY st) AS t FROM s)
    SELECT doc_id, 'chapter' AS name, 'container' AS kind, st AS title, 1 AS depth, 'c' || st AS xml_id, t::INTEGER AS target_num FROM c
    UNION ALL SELECT o_custkey, 'section', 'topic', 'S [' || o_orderkey || ']', 2, 's' || o_orderkey, NULL FROM orders UNION ALL SELECT DISTINCT doc_id, 'appendix', 'container', 'A', 1, NULL, NULL FROM s""")
def shredded_books(spark, sf_dir):
    return markup.shred_book(_books(spark, sf_dir), "doc_id", "xml").select("doc_id", "name", "kind", "title", "depth", "xml_id", "target_num")


@query("book_outlines", r"""WITH s AS (SELECT o_custkey AS doc_id, o_orderstatus AS st, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS t, string_agg('  S \[' || o_orderkey || '\]', chr(10) ORDER BY o_orderkey) AS x FROM orders GROUP BY o_custkey, o_orderstatus)
    SELECT doc_id, string_agg('Chapter: ' || st || ' [T' || t || ']' || chr(10) || x, chr(10) ORDER BY st) || chr(10) || 'Appendix: A' AS text FROM s GROUP BY doc_id""")
def book_outlines(spark, sf_dir):
    return outline.render(outline.lines_of(markup.shred_book(_books(spark, sf_dir), "doc_id", "xml")))


@query("empty_containers", "SELECT DISTINCT o_custkey AS doc_id, 'appendix' AS name FROM orders UNION ALL SELECT o_custkey, 'chapter' FROM orders GROUP BY o_custkey, o_orderstatus HAVING bool_and(o_orderkey % 3 = 0)")
def empty_containers(spark, sf_dir):
    return markup.empty_boxes(markup.nodes(_books(spark, sf_dir), "doc_id", "xml", xml=True), "doc_id").where(F.col("name").isin("appendix", "preface", "chapter")).select("doc_id", "name")


@query("full_header", """SELECT s_suppkey, 'Title = ' || CASE WHEN s_suppkey % 5 = 0 THEN 'Unknown' ELSE s_name END || ';Product = Unknown;Format = DocBook 5.0' || CASE WHEN s_suppkey % 3 = 0 THEN ';Version = ' || s_suppkey ELSE '' END || ';Type = ' || CASE WHEN s_suppkey % 2 = 0 THEN 'Book' ELSE 'Article' END || CASE WHEN s_suppkey % 4 = 0 THEN '-Draft' ELSE '' END
    || ';Default Preface = Off' || CASE WHEN s_suppkey % 7 = 0 THEN ';[condition = c]' ELSE '' END || ';Copyright Holder = ' || CASE WHEN s_suppkey % 3 = 1 THEN s_name ELSE 'Nobody' END || CASE WHEN s_suppkey % 3 = 1 THEN ';Copyright Year = 20' || s_nationkey ELSE '' END
    || CASE WHEN s_suppkey % 3 = 1 THEN ';Entities = [;<!ENTITY P "p">;]' ELSE '' END AS header FROM supplier""")
def full_header(spark, sf_dir):
    s, k = table(spark, sf_dir, "supplier"), F.col("s_suppkey")
    declared = F.array(F.concat(F.lit('<!ENTITY HOLDER "'), "s_name", F.lit('">')), F.lit('<!ENTITY HOLDER "late">'), F.lit('<!ENTITY P "p">'), F.concat(F.lit("<!ENTITY YEAR '20"), F.col("s_nationkey").cast("string"), F.lit("'>")))
    lines = outline.spec_header({"Title": F.when(k % 5 > 0, F.col("s_name")), "Version": F.when(k % 3 == 0, k.cast("string")).otherwise(" ")}, F.when(k % 2 == 0, "book").otherwise("article"), F.when(k % 4 == 0, " draft ").otherwise("final"), F.lit("5.0"), F.when(k % 7 == 0, "c"), F.when(k % 3 == 1, declared).otherwise(F.array().cast("array<string>")), "Nobody")
    return s.select("s_suppkey", F.array_join(lines, ";").alias("header"))


@query("import_report", """SELECT s_nationkey AS doc_id, '#' || chr(10) || '# The following existing topics were reused during the import.' || chr(10) || '# ' || string_agg(s_suppkey, ', ' ORDER BY s_suppkey)
    || CASE WHEN s_nationkey % 2 = 0 THEN chr(10) || '#' || chr(10) || '# The following existing topics were discarded during the import.' || chr(10) || '# ' || s_nationkey ELSE '' END AS text FROM supplier GROUP BY s_nationkey""")
def import_report(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    reused = s.groupBy(F.col("s_nationkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list("s_suppkey")), lambda x: x.cast("string")).alias("items")).withColumn("kind", F.lit("reused"))
    gone = reused.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.array(F.col("doc_id").cast("string"))).otherwise(F.array().cast("array<string>")).alias("items"), F.lit("removed").alias("kind"))
    return outline.report(reused.unionByName(gone), "now", 1 << 20)


@query("wrapped_list", """WITH RECURSIVE x AS (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS n FROM supplier),
    w(k, n, text, line) AS (SELECT s_nationkey, n, '# ' || s_name, 2 + length(s_name) FROM x WHERE n = 1 UNION ALL
      SELECT k, x.n, CASE WHEN line > 120 THEN text || ',' || chr(10) || '# ' || s_name ELSE text || ', ' || s_name END, CASE WHEN line > 120 THEN 2 + length(s_name) ELSE line + 2 + length(s_name) END FROM w JOIN x ON x.s_nationkey = w.k AND x.n = w.n + 1)
    SELECT k AS s_nationkey, arg_max(text, n) AS text FROM w GROUP BY k""")
def wrapped_list(spark, sf_dir):
    held = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_name")).alias("names"))
    return held.select("s_nationkey", outline.wrap_list(F.col("names")).alias("text"))


@query("fonts_used", "SELECT p_brand AS doc_id, string_agg(DISTINCT p_type, ',' ORDER BY p_type) AS fonts, string_agg(DISTINCT p_size::VARCHAR, ',' ORDER BY p_size::VARCHAR) AS sizes, NULL IS NOT NULL AS none FROM part GROUP BY p_brand")
def fonts_used(spark, sf_dir):
    used = rules.sizes_and_fonts(table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_type").alias("font"), F.col("p_size").alias("size")))
    return used.select("doc_id", F.array_join("fonts", ",").alias("fonts"), F.array_join("sizes", ",").alias("sizes"), F.lit(False).alias("none"))


@query("font_families", "SELECT p_partkey, p_size % 3 < 2 AS fits FROM part")
def font_families(spark, sf_dir):
    n = F.col("p_size") % 3
    families = F.when(n == 0, F.concat(F.lit("'Sans', '"), "p_brand", F.lit("'"))).when(n == 2, "Serif")
    return table(spark, sf_dir, "part").select("p_partkey", rules.family_matches(families, F.concat(F.lit(" "), "p_brand")).alias("fits"))


@query("declared_entities", """SELECT n_regionkey AS doc_id, n_name AS name, '<!ENTITY ' || n_name || ' ' || CASE WHEN n_nationkey % 2 = 0 THEN '"' ELSE '''' END || n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN '"' ELSE '''' END || '>' AS declaration FROM nation WHERE n_nationkey % 5 > 0""")
def declared_entities(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    q = F.when(F.col("n_nationkey") % 2 == 0, '"').otherwise("'")
    own = F.concat(F.lit("<!ENTITY "), "n_name", F.lit(" "), q, F.col("n_nationkey").cast("string"), q, F.lit(">"))
    texts = n.select(F.col("n_regionkey").alias("doc_id"), F.concat(own, F.lit("\n<!ENTITY nbsp \"x\">\n"), own).alias("text"))
    ignored = n.where("n_nationkey % 5 = 0").select(F.col("n_name").alias("name")).unionByName(spark.sql("SELECT 'nbsp' AS name"))
    return frontmatter.declared_entities(texts, ignored)


@query("file_resolution", "SELECT p.p_partkey, coalesce('base/' || a.s_name, b.s_name) AS found FROM part p LEFT JOIN supplier a ON a.s_suppkey = p.p_partkey * 7 % 900 LEFT JOIN supplier b ON b.s_suppkey = p.p_partkey * 3 % 700")
def file_resolution(spark, sf_dir):
    """The name with the base first, then the plain one."""
    s = table(spark, sf_dir, "supplier")
    entries = s.select(F.concat(F.lit("a"), F.col("s_suppkey").cast("string")).alias("path"), F.concat(F.lit("base/"), "s_name").alias("value")).unionByName(s.select(F.concat(F.lit("b"), F.col("s_suppkey").cast("string")).alias("path"), F.col("s_name").alias("value")))
    wanted = table(spark, sf_dir, "part").select("p_partkey", F.array(F.concat(F.lit("a"), (F.col("p_partkey") * 7 % 900).cast("string")), F.concat(F.lit("b"), (F.col("p_partkey") * 3 % 700).cast("string"))).alias("names"))
    return files.first_found(entries, wanted, "p_partkey").select("p_partkey", F.col("value").alias("found"))


@query("uri_components", "SELECT page_id, replace(replace(replace(replace(url, ':', '%3A'), '/', '%2F'), '?', '%3F'), '=', '%3D') AS encoded, url AS decoded FROM (SELECT page_id, regexp_replace(url, '[^A-Za-z0-9:/?=.-]', '', 'g') AS url FROM pages)")
def uri_components(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("url", "[^A-Za-z0-9:/?=.-]", "").alias("url"))
    return p.select("page_id", U.encode_component(F.col("url")).alias("encoded"), U.decode_component(U.encode_component(F.col("url"))).alias("decoded"))


@query("url_edits", """SELECT page_id, 'http://h/p?a=1' || '&k=' || page_id || '#f' AS added, 'http://h/p#f' AS removed, TRUE AS has_a, FALSE AS has_z, '/x/' || page_id % 3 || '/' AS shared, 'http://a.org/' || page_id || '|ftp://b/c' AS found FROM pages""")
def url_edits(spark, sf_dir):
    k = F.col("page_id").cast("string")
    u = F.lit("http://h/p?a=1#f")
    path = F.concat(F.lit("/x/"), (F.col("page_id") % 3).cast("string"), F.lit("/"))
    text = F.concat(F.lit("see http://a.org/"), k, F.lit(", (ftp://b/c)."))
    return table(spark, sf_dir, "pages").select("page_id", U.add_query(u, F.lit("k"), k).alias("added"), U.remove_query(u, F.lit("a")).alias("removed"), U.has_query(u, F.lit("a")).alias("has_a"), U.has_query(u, F.lit("z")).alias("has_z"), U.common_path(F.concat(path, F.lit("q")), F.concat(path, F.lit("r/s"))).alias("shared"), F.array_join(U.find_urls(text), "|").alias("found"))


@query("ingested_events", "SELECT event_type AS key, count(*) AS n FROM events GROUP BY event_type")
def ingested_events(spark, sf_dir):
    """The events as a stream, taken up once and counted."""
    return ingest.taken_up(spark, f"{sf_dir}/events.parquet", "event_type")


@query("binary_text", "SELECT p_partkey, string_agg(printf('%02X', unicode(c) & 255), '' ORDER BY i) AS content FROM (SELECT p_partkey, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM (SELECT p_partkey, p_name || 'ÿĀ☃' || p_brand AS t FROM part)) GROUP BY p_partkey")
def binary_text(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.hex(files.bytes_of(F.concat("p_name", F.lit("ÿĀ☃"), "p_brand"))).alias("content"))


def _texts(df, source, named: dict[str, Column]):
    return df.select(source.cast("string").alias("source"), F.explode(F.array(*(F.struct(F.lit(p).alias("path"), t.alias("text")) for p, t in named.items()))).alias("f")).select("source", "f.path", "f.text")


@query("asciidoc_splice", """SELECT s_suppkey, ':dir: parts' || chr(10) || 'A ' || s_name || ' B' || chr(10) || '// includecomment::x[]' || chr(10) || CASE WHEN s_suppkey % 2 = 0 THEN 'C' ELSE '' END || chr(10) || 'end' AS text FROM supplier""")
def asciidoc_splice(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    named = {"main.adoc": F.lit(":dir: parts\ninclude::{dir}/a.adoc[]\n// include::x[]\ninclude::c.adoc[]\nend"), "parts/a.adoc": F.lit("A include::b.adoc[] B"), "parts/b.adoc": F.col("s_name")}
    entries = _texts(s, F.col("s_suppkey"), named).unionByName(_texts(s.where("s_suppkey % 2 = 0"), F.col("s_suppkey"), {"c.adoc": F.lit("C")}))
    got = splice.expand(entries, s.select(F.col("s_suppkey").cast("string").alias("source"), F.lit("main.adoc").alias("path")), "asciidoc")
    return got.select(F.col("source").cast("long").alias("s_suppkey"), "text")


@query("image_paths", """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE '<book xmlns:xi="http://www.w3.org/2001/XInclude"><xi:include href="Common_Content/x.xml"/><section xml:base="sub"><imagedata fileref="ch/images/i.png"/><imagedata fileref="none.png"/>' || s_name || '</section></book>' END AS text,
    CASE WHEN s_suppkey % 3 = 0 THEN 'book.xml > ch/one.xml > book.xml' END AS error FROM supplier""")
def image_paths(spark, sf_dir):
    """References of an included file become paths of the book; common content stays; a circle is reported."""
    s = table(spark, sf_dir, "supplier")
    circle = F.when(F.col("s_suppkey") % 3 == 0, "<xi:include href='../book.xml'/>").otherwise("")
    named = {
        "book.xml": F.lit('<book xmlns:xi="http://www.w3.org/2001/XInclude"><xi:include href="Common_Content/x.xml"/><xi:include href="ch/one.xml"/></book>'),
        "ch/one.xml": F.concat(F.lit('<section xml:base="sub"><imagedata fileref="./images/i.png"/><imagedata fileref="none.png"/>'), "s_name", circle, F.lit("</section>")),
        "ch/images/i.png": F.lit(""),
    }
    got = splice.expand(_texts(s, F.col("s_suppkey"), named), s.select(F.col("s_suppkey").cast("string").alias("source"), F.lit("book.xml").alias("path")))
    return got.select(F.col("source").cast("long").alias("s_suppkey"), "text", "error")


# One import. Each customer is a book of orders, each linking to the next; the store holds the topics of every second book, in
# every fourth without the last one, so that no topic before it can be reused.


def _import_inputs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    rows = o.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("k"), "o_orderpriority", F.lead("o_orderkey").over(w).alias("next"))
    text = F.concat(F.lit("<para>"), "o_orderpriority", F.lit(" "), F.col("k").cast("string"))
    titled = F.concat(F.lit("<title>T "), F.col("k").cast("string"), F.lit("</title>"))
    link = F.coalesce(F.concat(F.lit(' <xref linkend="s'), F.col("next").cast("string"), F.lit('"/>')), F.lit(""))
    section = F.concat(F.lit('<section id="s'), F.col("k").cast("string"), F.lit('">'), titled, text, link, F.lit("</para></section>"))
    books = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("k", section.alias("x")))).alias("s"))
    body = F.array_join(F.transform("s", lambda x: x["x"]), "")
    books = books.select("doc_id", F.concat(F.lit("Book "), F.col("doc_id").cast("string")).alias("title"), F.concat(F.lit('<book><chapter id="c"><title>All</title>'), body, F.lit("</chapter></book>")).alias("xml"))
    inject = F.coalesce(F.concat(F.lit(" <!-- Inject: "), F.col("next").cast("string"), F.lit(" -->")), F.lit(""))
    there = rows.where((F.col("doc_id") % 2 == 0) & ((F.col("doc_id") % 4 == 0) | F.col("next").isNotNull()))
    stored = there.select(F.col("k").alias("store_id"), F.concat(F.lit("<section>"), titled, text, inject, F.lit("</para></section>")).alias("xml"))
    return books, stored.unionByName(spark.sql("SELECT 1000000000L AS store_id, '<section/>' AS xml"))


_IMPORTED = """o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, o_custkey % 4 = 0 AS kept FROM orders)"""


@query("import_topics", f"WITH {_IMPORTED} SELECT doc_id, 'T ' || k AS title, CASE WHEN kept THEN 'REUSED' ELSE 'NEW' END AS status, CASE WHEN kept THEN k END AS store_id, TRUE AS numbered FROM o")
def import_topics(spark, sf_dir):
    """Of new ids it is shown that they come after those of the store."""
    topics, _, _ = book_import.import_books(*_import_inputs(spark, sf_dir))
    new = F.col("status") == "NEW"
    return topics.select("doc_id", "title", "status", F.when(~new, F.col("store_id")).alias("store_id"), (new == (F.col("store_id") > 1000000000)).alias("numbered"))


@query("import_outlines", f"""WITH {_IMPORTED} SELECT doc_id, 'Title = Book ' || doc_id || chr(10) || 'Chapter: All [T1]' || chr(10) || string_agg('  T ' || k || CASE WHEN kept THEN ' [' || k || ']' ELSE ' [new]' END, chr(10) ORDER BY k) AS outline,
    '#' || chr(10) || '# The following ' || CASE WHEN any_value(kept) THEN 'existing topics were reused' ELSE 'new topics were created' END || ' during the import.' AS report FROM o GROUP BY doc_id""")
def import_outlines(spark, sf_dir):
    _, _, outlines = book_import.import_books(*_import_inputs(spark, sf_dir))
    return outlines.select("doc_id", F.regexp_replace("text", r"\[1[0-9]{9}\]", "[new]").alias("outline"), F.regexp_extract("report", r"(?s)^(.*import\.)\n", 1).alias("report"))


@query("import_written", """WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, o_orderpriority AS p, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS next FROM orders)
    SELECT '<section><title>T ' || k || '</title><para>' || p || ' ' || k || CASE WHEN next IS NULL THEN '' ELSE ' <!--Inject: new-->' END || '</para></section>' AS xml, count(*) AS n FROM o WHERE doc_id % 4 <> 0 GROUP BY 1""")
def import_written(spark, sf_dir):
    """What is written is put over the kept store in two batches, the second one twice, and read back."""
    _, written, _ = book_import.import_books(*_import_inputs(spark, sf_dir))
    written = held(written, "written")  # each batch reads it
    path, schema = shared_folder(spark, "store"), "store_id long, xml string"
    half = F.col("store_id") % 2
    store.save(written.where(half == 0), path, schema, 1)
    for _ in range(2):
        store.save(written.where(half == 1), path, schema, 2)
    drop_held(written)
    kept = store.load(spark, path, schema)
    return kept.select(F.regexp_replace("xml", "Inject: 1[0-9]{9}", "Inject: new").alias("xml")).groupBy("xml").agg(F.count("*").alias("n"))
