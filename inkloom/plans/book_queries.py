"""Queries over books made from the tables: inclusion, injections, front matter, office texts, rarer URL functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.functions import text as X
from inkloom.functions import urls as U
from inkloom.operators import frontmatter, office, splice
from inkloom.plans.catalog import query, table

_ESCAPED = "replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query("include_splice", f"SELECT doc_id, md5('<book xmlns:xi=\"http://www.w3.org/2001/XInclude\"><section><screen>' || {_ESCAPED} || '</screen></section></book>') AS spliced FROM documents")
def include_splice(spark, sf_dir):
    """Each document as a text that a section includes that a book includes."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("source"), "text")
    fixed = {"book.xml": '<book xmlns:xi="http://www.w3.org/2001/XInclude"><xi:include href="s/one.xml"/></book>', "s/one.xml": '<section><screen><xi:include href="../two.txt" parse="text"/></screen></section>'}
    files = d.select("source", F.lit("two.txt").alias("path"), "text")
    for path, text in fixed.items():
        files = files.unionByName(d.select("source", F.lit(path).alias("path"), F.lit(text).alias("text")))
    got = splice.expand(files.withColumn("source", F.col("source").cast("string")), d.select(F.col("source").cast("string"), F.lit("book.xml").alias("path")))
    return got.select(F.col("source").cast("long").alias("doc_id"), F.md5("text").alias("spliced"))


@query("link_injection", """SELECT doc_id, '<p>' || CASE WHEN doc_id % 3 = 0 THEN '<!--Inject: T' || doc_id || '-->' ELSE '<!--Inject: ' || (doc_id + 1) || '-->' END
    || CASE WHEN doc_id % 3 = 0 THEN '<!--Inject: T' || doc_id || '-->' ELSE '<!--Inject: ' || (doc_id + 1) || '--><!--<link linkend="a">' || source || '</link>-->' END || '<xref linkend="b"/></p>' AS xml FROM documents""")
def link_injection(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    topics = d.select("doc_id", F.lit(1).alias("seq"), F.format_string('<p><xref linkend="a"/><link linkend="a">%s</link><xref linkend="b"/></p>', "source").alias("xml"))
    refs = d.select("doc_id", F.lit("a").alias("linkend"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("T"), F.col("doc_id"))).otherwise((F.col("doc_id") + 1).cast("string")).alias("ref"))
    return splice.inject_links(topics, refs).select("doc_id", "xml")


@query("book_front_matter", """SELECT doc_id, 0 AS place, 'revision_history' AS kind, 'Changes' AS title, 'r' || doc_id AS xml_id FROM documents
    UNION ALL SELECT doc_id, 1, 'legal_notice', 'Legal Notice', NULL FROM documents UNION ALL SELECT doc_id, 2, 'info', source, NULL FROM documents""")
def book_front_matter(spark, sf_dir):
    book = F.format_string("<book><bookinfo><legalnotice/></bookinfo><chapter><chapterinfo><title>%s</title></chapterinfo></chapter><appendix id='r%d'><title>Changes</title><revhistory/></appendix></book>", "source", "doc_id")
    return frontmatter.front_matter(table(spark, sf_dir, "documents").select("doc_id", book.alias("xml")), "doc_id", "xml").select("doc_id", "place", "kind", "title", "xml_id")


@query("office_sections", f"SELECT doc_id, 0 AS place, 1 AS level, source AS title, 'container' AS kind, md5('') AS body FROM documents UNION ALL SELECT doc_id, 1, 2, 'n' || doc_id, 'topic', md5(CASE WHEN trim(coalesce(text, ''), ' \t\r\n') = '' THEN '' ELSE '<screen>' || {_ESCAPED} || '</screen>' END) FROM documents")
def office_sections(spark, sf_dir):
    """Each document as the one paragraph, set in a fixed-width font, of an office text."""
    head = '<d xmlns:o="o" xmlns:t="t" xmlns:s="s" xmlns:f="f"><s:style s:name="M"><s:text-properties f:font-family="Mono"/></s:style><o:body><o:text><t:h t:outline-level="1">'
    escaped = F.expr(f"replace({_ESCAPED}, '\r', '&#13;')")
    content = F.concat(F.lit(head), "source", F.lit('</t:h><t:h t:outline-level="5">n'), "doc_id", F.lit('</t:h><t:p t:style-name="M">'), escaped, F.lit("</t:p></o:text></o:body></d>"))
    rules = [{"font": "Mono", "element": "screen", "merge": True}]
    d = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"), F.lit("").alias("styles"))
    return office.office_sections(d, "doc_id", "content", "styles", rules).withColumn("body", F.md5("body"))


_HOST = "regexp_extract(url, '^[A-Za-z]+://([^/?#:]*)', 1)"


@query("url_domains", f"""SELECT page_id, CASE WHEN lower(regexp_extract({_HOST}, '([^.]+[.][^.]+)$', 1)) IN ('co.uk', 'example.net') THEN regexp_extract({_HOST}, '([^.]+[.][^.]+)$', 1) ELSE regexp_extract({_HOST}, '([^.]+)$', 1) END AS suffix,
    coalesce(nullif(CASE WHEN lower(regexp_extract({_HOST}, '([^.]+[.][^.]+)$', 1)) IN ('co.uk', 'example.net') THEN regexp_extract({_HOST}, '([^.]+[.][^.]+[.][^.]+)$', 1) ELSE regexp_extract({_HOST}, '([^.]+[.][^.]+)$', 1) END, ''), {_HOST}) AS domain FROM pages""")
def url_domains(spark, sf_dir):
    host, levels = U.part(F.col("url"), "host"), ["co.uk", "example.net"]
    return table(spark, sf_dir, "pages").select("page_id", U.public_suffix(host, levels).alias("suffix"), U.registered_domain(host, levels).alias("domain"))


@query("url_templates", "SELECT page_id, '/p/' || page_id || '?id=' || page_id || '&q=a%20b' AS filled FROM pages")
def url_templates(spark, sf_dir):
    values = F.create_map(F.lit("id"), F.col("page_id").cast("string"), F.lit("q"), F.lit("a b"))
    return table(spark, sf_dir, "pages").select("page_id", U.expand_template(F.lit("/p{/id}{?id,q,none}"), values).alias("filled"))


@query("host_forms", "SELECT page_id, '[2001:db8::' || lower(to_hex(page_id % 65535 + 1)) || ']' AS short, 'xn--bcher-kva.' || page_id || '.de' AS ascii, TRUE AS restored FROM pages")
def host_forms(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    long = F.concat(F.lit("[2001:db8:0:0:0:0:0:"), F.lower(F.hex(F.col("page_id") % 65535 + 1)), F.lit("]"))
    name = F.concat(F.lit("bücher."), F.col("page_id").cast("string"), F.lit(".de"))
    return p.select("page_id", U.compact_ipv6(long).alias("short"), U.to_punycode(name).alias("ascii"), (U.from_punycode(U.to_punycode(name)) == name).alias("restored"))


@query("mime_types", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/xml' WHEN 2 THEN 'text/html' ELSE 'application/octet-stream' END AS mime FROM documents")
def mime_types(spark, sf_dir):
    suffix = F.element_at(F.array(*map(F.lit, [".PNG", ".xml", ".html", ""])), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", U.mime_type(F.concat(F.lit("images/"), F.col("doc_id").cast("string"), suffix)).alias("mime"))


@query("book_metadata", "SELECT doc_id, source AS title, lang AS product, '1' AS version, doc_id % 2 = 0 AS has_index FROM documents")
def book_metadata(spark, sf_dir):
    index = F.when(F.col("doc_id") % 2 == 0, "<index/>").otherwise("")
    book = F.concat(F.lit("<book><title>own</title><bookinfo><title>"), "source", F.lit("</title><productname>"), "lang", F.lit("</productname></bookinfo>"), index, F.lit("</book>"))
    return frontmatter.book_info(table(spark, sf_dir, "documents").select("doc_id", book.alias("xml")), "doc_id", "xml").select("doc_id", "title", "product", "version", "has_index")


@query("markup_repair", "SELECT doc_id, '<p><!-- a  ' || source || ' --><userinput><![CDATA[' || source || ' < 1]]></userinput>' || CASE WHEN doc_id % 2 = 0 THEN '<!-- InjectPlaceholder: 0 -->' ELSE '<xref linkend=\"d' || doc_id || '\"/>' END || '</p>' AS xml FROM documents")
def markup_repair(spark, sf_dir):
    xml = F.format_string('<p><!-- a <!-- %s --><userinput>%s &lt; 1</userinput><xref linkend="d%d"/></p>', "source", "source", "doc_id")
    ids = F.array(F.concat(F.lit("d"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).otherwise(-1).cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", X.fold_xrefs(X.literal_text(X.repair_comments(xml)), ids).alias("xml"))
