"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.functions import collections
from inkloom.functions import text as X
from inkloom.functions import urls as U
from inkloom.operators import markup, matching, order
from inkloom.operators.scratch import shared_folder
from inkloom.plans.catalog import query, table
from inkloom.sources import files
from inkloom.streaming import ingest

_NAME = r"[A-Za-z_][\w.:-]*"


def sql_canonical(source: str, key: str, text: str, strict: bool = False, root: str | None = "section") -> str:
    """DuckDB's own way to the canonical form: pieces as rows. Gives (key, canon)."""
    x = rf"regexp_replace(regexp_replace({text}, '(?s)^\s*<\?xml.*?\?>\s*', ''), '(?is)^\s*<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>\s*', '')"
    # RE2 has no look-ahead: comments that stay are hidden first.
    x = rf"replace(regexp_replace(regexp_replace({x}, '<!--(\s*Inject[A-Za-z]*\s*:\s*T?[0-9])', chr(1) || '\1', 'g'), '(?s)<!--.*?-->', '', 'g'), chr(1), '<!--')"
    if not strict:
        x = rf"regexp_replace({x}, '<!--\s*Inject\s*:\s*T?[0-9]+\s*-->', '<!-- InjectPlaceholder: 0 -->', 'g')"
    x = rf"regexp_replace({x}, '<({_NAME})((?:\s[^<>]*)?)></{_NAME}\s*>', '<\1\2/>', 'g')"
    if root:
        x = rf"regexp_replace(regexp_replace({x}, '^(\s*)<{_NAME}', '\1<{root}'), '</{_NAME}(\s*>\s*)$', '</{root}\1')"
    piece = r"(?s)<!--.*?-->|<!\[CDATA\[.*?\]\]>|<[^<>]*>|[^<]+|<"
    attrs = r"""regexp_extract_all(p, '\s([\w.:-]+(?:\s*=\s*(?:"[^"]*"|''[^'']*''|[^\s"''<>]+))?)', 1)"""
    shown = r"""CASE WHEN regexp_matches(a, '=\s*["'']') THEN regexp_extract(a, '^([\w.:-]+)', 1) || '="' || replace(regexp_extract(a, '(?s)=\s*["''](.*)["'']$', 1), '"', '&quot;') || '"' ELSE a END"""
    tag = f"""regexp_extract(p, '^(<{_NAME})', 1) || array_to_string(list_transform(list_sort(list_transform(list_filter({attrs}, lambda a: NOT regexp_matches(a, '^(?:{X.UNCOMPARED})')), lambda a: {shown})), lambda a: ' ' || a), '') || CASE WHEN ends_with(p, '/>') THEN '/>' ELSE '>' END"""
    exact = " || ".join(rf"regexp_extract_all(raw, '(?s)<{n}(?:\s[^<>]*)?>.*?</{n}>')" for n in X.VERBATIM)
    return rf"""SELECT key, coalesce(thin, '') || CASE WHEN regexp_matches(x, '<(?:{"|".join(X.VERBATIM)})[\s>]') THEN chr(10) || chr(10) || array_to_string({exact}, chr(10)) ELSE '' END AS canon
    FROM (SELECT {key} AS key, {x} AS x FROM {source}) LEFT JOIN (
      SELECT key, string_agg(p, '' ORDER BY i) AS raw, string_agg(t, chr(10) ORDER BY i) FILTER (t <> '') AS thin FROM (SELECT *, trim(regexp_replace(p, '[ \t\n\r\f\v]+', ' ', 'g'), ' ') AS t FROM (
        SELECT key, i, CASE WHEN NOT starts_with(p, '<') OR starts_with(p, '<![CDATA[') THEN replace(replace(translate(p, '’“”', '''""'), '&apos;', ''''), '&quot;', '"')
            WHEN regexp_matches(p, '^<{_NAME}') THEN {tag} WHEN starts_with(p, '</') THEN regexp_replace(p, '\s+>$', '>') ELSE p END AS p
        FROM (SELECT key, unnest(l) AS p, generate_subscripts(l, 1) AS i FROM (SELECT {key} AS key, regexp_extract_all({x}, '{piece}') AS l FROM {source})))) GROUP BY key) USING (key)"""


_DOCS = "(SELECT doc_id, source, coalesce(text, '') AS text FROM documents)"


@query("doc_reuse_report", f"""WITH c AS ({sql_canonical(_DOCS, "doc_id", "text")}), s AS (SELECT key, min(key) OVER (PARTITION BY canon) AS survivor FROM c)
    SELECT source, count(*) AS docs, count(*) FILTER (key = survivor) AS new_docs, count(*) FILTER (key <> survivor) AS reused_docs FROM s JOIN documents ON key = doc_id GROUP BY source""")
def doc_reuse_report(spark, sf_dir):
    found = matching.reuse(table(spark, sf_dir, "documents"), "doc_id", "text", keep=["source"])
    return matching.counters(found, "source").withColumnsRenamed({"all_rows": "docs", "new_rows": "new_docs", "matched_rows": "reused_docs"})


@query("doc_exact_equivalence", f"SELECT key AS doc_id, min(key) OVER (PARTITION BY canon) AS survivor, CASE WHEN key = min(key) OVER (PARTITION BY canon) THEN 'NEW' ELSE 'REUSED' END AS status FROM ({sql_canonical(_DOCS, "doc_id", "text")})")
def doc_exact_equivalence(spark, sf_dir):
    return matching.reuse(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("stream_reuse", f"SELECT key AS doc_id, min(key) OVER (PARTITION BY canon) AS survivor, CASE WHEN key = min(key) OVER (PARTITION BY canon) THEN 'NEW' ELSE 'REUSED' END AS status FROM ({sql_canonical(_DOCS, "doc_id", "text")})")
def stream_reuse(spark, sf_dir):
    """The same as a stream of files with state: where the table is one file, and so one batch, what it finds is what the batch query finds."""
    out = shared_folder(spark, "stream")
    return ingest.reused(spark, ingest.as_glob(f"{sf_dir}/documents.parquet"), "doc_id", "text", f"{out}/out", f"{out}/state")


@query("doc_strict_equivalence", f"SELECT key AS doc_id, min(key) OVER (PARTITION BY canon) AS survivor FROM ({sql_canonical(_DOCS, "doc_id", "text", True)})")
def doc_strict_equivalence(spark, sf_dir):
    return matching.reuse(table(spark, sf_dir, "documents"), "doc_id", "text", strict=True).select("doc_id", "survivor")


@query("page_canonical", f"SELECT key AS page_id, md5(canon) AS canon FROM ({sql_canonical('pages', 'page_id', 'html')})")
def page_canonical(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.canonical(F.col("html"))).alias("canon"))


@query("page_preamble_strip", r"SELECT page_id, md5(regexp_replace(regexp_replace(html, '(?s)^\s*<\?xml.*?\?>\s*', ''), '(?is)^\s*<!DOCTYPE[^\[>]*(?:\[.*?\]\s*)?>\s*', '')) AS bare FROM pages")
def page_preamble_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(X.strip_preamble(F.col("html"))).alias("bare"))


@query("page_comment_strip", r"SELECT page_id, length(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'))::INTEGER AS kept FROM pages")
def page_comment_strip(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(X.strip_comments(F.col("html"), keep_injections=False)).alias("kept"))


@query("page_entity_counts", "SELECT page_id, len(list_distinct(regexp_extract_all(html, '&[^;]*?;')))::INTEGER AS n_distinct, len(regexp_extract_all(html, '&[^;]*?;'))::INTEGER AS n FROM pages")
def page_entity_counts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.size(X.entities(F.col("html"))).alias("n_distinct"), F.regexp_count("html", F.lit(X.ENTITY)).alias("n"))


@query("page_entity_roundtrip", "SELECT page_id, TRUE AS restored, 0 AS left_over FROM pages")
def page_entity_roundtrip(spark, sf_dir):
    p = table(spark, sf_dir, "pages").withColumn("names", X.entities(F.col("html"))).withColumn("masked", X.mask_entities(F.col("html"), F.col("names")))
    return p.select("page_id", (X.unmask_entities(F.col("masked"), F.col("names")) == F.col("html")).alias("restored"), F.regexp_count("masked", F.lit(X.ENTITY)).alias("left_over"))


_TITLE = "regexp_extract(html, '<title>(.*?)</title>', 1)"


@query("title_escape", rf"SELECT page_id, coalesce(nullif(trim(regexp_replace({_TITLE}, '([\[\]])', '\\\1', 'g'), ' '), ''), 'Untitled') AS title FROM pages")
def title_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.resolve_title(F.lit(None).cast("string"), F.expr(_TITLE)).alias("title"))


@query("xml_escape", f"""WITH t AS (SELECT page_id, translate(replace(replace(replace(replace(replace({_TITLE}, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&'), '’“”', '''""') AS t FROM pages)
    SELECT page_id, replace(replace(replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM t""")
def xml_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", X.escape_xml(F.expr(_TITLE)).alias("escaped"))


@query("page_metadata", f"SELECT page_id, {_TITLE} AS title, regexp_extract(html, '<html lang=\"([a-z]+)\"', 1) AS lang, contains(html, '<article') AS has_article FROM pages")
def page_metadata(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.expr(_TITLE).alias("title"), F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.contains("html", F.lit("<article")).alias("has_article"))


@query("root_rename", '''SELECT doc_id, '<section id="' || doc_id || '">x</section>' AS xml FROM documents''')
def root_rename(spark, sf_dir):
    xml = F.concat(F.lit('<chapter xmlns="http://docbook.org/ns/docbook" id="'), F.col("doc_id").cast("string"), F.lit('">x</chapter>'))
    return table(spark, sf_dir, "documents").select("doc_id", X.rename_root(X.drop_xmlns(xml), F.lit("section")).alias("xml"))


@query("build_elements", "SELECT doc_id, '<section id=\"s' || doc_id || '\"><title>' || source || '</title></section>' AS xml, CASE WHEN doc_id % 2 = 0 THEN 'chapter' ELSE 'section' END AS container FROM documents")
def build_elements(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", X.element(F.lit("section"), X.element(F.lit("title"), F.col("source")), F.concat(F.lit("s"), F.col("doc_id").cast("string"))).alias("xml"), X.container_name(F.lit("sect2"), (F.col("doc_id") % 2).cast("int"), F.lit(False)).alias("container"))


# URLs.

_REST = "regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)"


@query("url_parts", f"""SELECT page_id, regexp_extract(url, '^([A-Za-z]+):', 1) AS protocol, {_REST} AS host, regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(url, '[?]([^#]*)', 1) AS query, regexp_extract(url, '#(.*)$', 1) AS fragment,
    regexp_extract({_REST}, '([^.]+)$', 1) AS tld, regexp_extract({_REST}, '([^.]+[.][^.]+)$', 1) AS domain, regexp_extract(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '([^/]*)$', 1) AS filename, regexp_extract(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '[.]([^./]*)$', 1) AS suffix FROM pages""")
def url_parts(spark, sf_dir):
    names = ["protocol", "host", "path", "query", "fragment", "tld", "domain", "filename", "suffix"]
    return table(spark, sf_dir, "pages").select("page_id", *(U.part(F.col("url"), n).alias(n) for n in names))


@query("url_query_params", "SELECT page_id, split_part(p, '=', 1) AS key, CASE WHEN contains(p, '=') THEN regexp_extract(p, '=(.*)$', 1) END AS value FROM (SELECT page_id, unnest(string_split(regexp_extract(url, '[?]([^#]*)', 1), '&')) AS p FROM pages) WHERE p <> ''")
def url_query_params(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.explode(U.parameters(F.col("url"))).alias("p"))
    return rows.select("page_id", "p.key", "p.value")


@query("url_normalise", f"SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+):', 1)) || '://' || lower({_REST}) || CASE WHEN regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) END || regexp_extract(url, '[?][^#]+') || regexp_extract(url, '#.+$') AS normal FROM pages")
def url_normalise(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.normalise(F.col("url")).alias("normal"))


@query("links_per_host", f"SELECT {_REST} AS host, count(*) AS n FROM pages GROUP BY 1")
def links_per_host(spark, sf_dir):
    return table(spark, sf_dir, "pages").groupBy(U.part(F.col("url"), "host").alias("host")).agg(F.count("*").alias("n"))


@query("outgoing_links_not_allowed", r"SELECT DISTINCT page_id, url FROM pages WHERE NOT regexp_matches(url, '\.example\.org') OR NOT regexp_matches(url, '/en/')")
def outgoing_links_not_allowed(spark, sf_dir):
    return table(spark, sf_dir, "pages").where(~U.allowed(F.col("url"), [r"\.example\.org", "/en/"])).select("page_id", "url").distinct()


@query("page_links", "SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def page_links(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


@query("entry_listing", f"SELECT page_id, row_number() OVER (ORDER BY len(string_split(url, '/')), lower(url), url, page_id) AS place FROM pages")
def entry_listing(spark, sf_dir):
    return order.numbered(table(spark, sf_dir, "pages").select("page_id", "url"), files.depth(F.col("url")), F.lower("url"), "url", "page_id").select("page_id", "place")


@query("strip_root", "SELECT page_id, regexp_replace(url, '^[^/]+/', '') AS path, regexp_extract(url, '([^/]*)$', 1) NOT IN ('') AND NOT starts_with(regexp_extract(url, '([^/]*)$', 1), '.') AS is_file FROM pages")
def strip_root(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", files.strip_root(F.col("url")).alias("path"), files.is_file(F.col("url")).alias("is_file"))


@query("point_lookup", "SELECT p.page_id, CASE WHEN p.page_id % 3 = 0 THEN upper(url) ELSE url END AS name, md5(html) AS found FROM pages p")
def point_lookup(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    entries = p.select(F.lit("s").alias("source_id"), F.concat(F.col("page_id").cast("string"), F.lit("|"), "url").alias("path"), F.col("html").alias("content"))
    name = F.when(F.col("page_id") % 3 == 0, F.upper("url")).otherwise(F.col("url"))
    wanted = p.select(F.lit("s").alias("source_id"), F.concat(F.col("page_id").cast("string"), F.lit("|"), name).alias("name"))
    found = files.lookup(entries, wanted, ignore_case=True)
    return found.select(F.split("name", r"\|")[0].cast("long").alias("page_id"), F.regexp_replace("name", r"^[0-9]+\|", "").alias("name"), F.md5("content").alias("found"))


# Structure.

_HEADS = r"""SELECT page_id, unnest(regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 1)) AS level, unnest(regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 2)) AS t,
    generate_subscripts(regexp_extract_all(html, '(?is)<h([1-6])[^>]*>(.*?)</h[1-6]>', 1), 1) - 1 AS place FROM pages"""


@query("page_headings", rf"""WITH RECURSIVE h AS ({_HEADS}), c(page_id, place, level, clamped) AS (SELECT page_id, place, level::INTEGER, least(level::INTEGER, 1) FROM h WHERE place = 0
      UNION ALL SELECT h.page_id, h.place, h.level::INTEGER, least(h.level::INTEGER, c.clamped + 1) FROM c JOIN h ON h.page_id = c.page_id AND h.place = c.place + 1)
    SELECT page_id, place::INTEGER AS place, c.level, clamped, regexp_replace(trim(regexp_replace(t, '(?s)<[^>]*>', '', 'g'), ' '), '^[0-9]+(\.[0-9]+)*\.?[ ]*', '') AS title FROM c JOIN h USING (page_id, place)""")
def page_headings(spark, sf_dir):
    return markup.headings(table(spark, sf_dir, "pages"), "page_id", "html")


@query("page_nodes")
def page_nodes(spark, sf_dir):
    n = markup.nodes(table(spark, sf_dir, "pages"), "page_id", "html")
    return n.groupBy("page_id", "name").agg(F.count("*").alias("n"), F.max("depth").alias("max_depth"))


@query("page_elements", r"SELECT page_id, name, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)(<script>|<style>).*?(</script>|</style>)', '\1\2', 'g'), '<([a-z][a-z0-9]*)', 1)) AS name FROM pages) GROUP BY ALL")
def page_elements(spark, sf_dir):
    n = markup.nodes(table(spark, sf_dir, "pages"), "page_id", "html").where(~F.col("name").startswith("#"))
    return collections.count_by(n, "page_id", "name")


@query("page_list_items_under_nav", "SELECT page_id, sum(len(regexp_extract_all(nav, '<li>')))::BIGINT AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<nav>.*?</nav>')) AS nav FROM pages) GROUP BY page_id HAVING n > 0")
def page_list_items_under_nav(spark, sf_dir):
    n = markup.nodes(table(spark, sf_dir, "pages"), "page_id", "html")
    l, r = n.where("name = 'nav'").alias("l"), n.where("name = 'li'").alias("r")
    return l.join(r, markup.axis(n, "page_id", "descendant")).groupBy(F.col("l.page_id").alias("page_id")).agg(F.count("*").alias("n"))


@query("page_sections")
def page_sections(spark, sf_dir):
    return markup.sections(table(spark, sf_dir, "pages"), "page_id", "html", "url")


_TABLE = '<informaltable><tgroup cols="2"><colspec colname="c1"/><colspec colname="c2"/><thead><row><entry>H</entry><entry>I</entry></row></thead><tbody><row><entry namest="c1" nameend="c2">\' || o_orderstatus || \'</entry></row></tbody></tgroup></informaltable>'
_LIST = '<orderedlist numeration="loweralpha"><listitem><para>p</para><para>q</para><itemizedlist><listitem><para>r</para></listitem></itemizedlist></listitem></orderedlist>'


@query("made_sections", f"""WITH RECURSIVE h AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey AS k, (o_orderkey % 4 + 1)::INTEGER AS level,
      CASE WHEN o_orderkey % 11 = 0 THEN '<para><ulink url="http://h/x">l</ulink> m</para>' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN '<para>x <emphasis role="bold">' || o_orderpriority || '</emphasis></para>' ELSE '' END || CASE WHEN o_orderkey % 5 = 0 THEN '<screen>a  &lt;' || chr(10) || 'b</screen>' ELSE '' END
      || CASE WHEN o_orderkey % 7 = 0 THEN '{_TABLE}' ELSE '' END || CASE WHEN o_orderkey % 13 = 0 THEN '{_LIST}' ELSE '' END AS body FROM orders),
    c(doc_id, n, level) AS (SELECT doc_id, n, 1 FROM h WHERE n = 1 UNION ALL SELECT h.doc_id, h.n, least(h.level, c.level + 1) FROM c JOIN h ON h.doc_id = c.doc_id AND h.n = c.n + 1),
    x AS (SELECT h.doc_id, h.n, h.k, c.level, h.body FROM h JOIN c USING (doc_id, n)),
    e AS (SELECT x.*, coalesce((SELECT min(y.n) FROM x y WHERE y.doc_id = x.doc_id AND y.n > x.n AND y.level <= x.level), 1000000) AS stop FROM x),
    kept AS (SELECT * FROM e WHERE body <> '' OR EXISTS (SELECT 1 FROM x y WHERE y.doc_id = e.doc_id AND y.n > e.n AND y.n < e.stop AND y.body <> ''))
    SELECT doc_id, (row_number() OVER w - 1)::INTEGER AS place, level, CASE WHEN body = '' AND coalesce(lead(level) OVER w > level, FALSE) THEN 'container' ELSE 'topic' END AS kind, 'T' || k AS title, body FROM kept WINDOW w AS (PARTITION BY doc_id ORDER BY n)""")
def made_sections(spark, sf_dir):
    """Each customer's orders as headings of a page, some with paragraphs, listings, tables and lists, many empty."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    level = (k % 4 + 1).cast("string")
    part = F.concat(
        F.lit("<h"), level, F.lit("><span>3.1 T"), k.cast("string"), F.lit("</span>"), F.when(k % 11 == 0, " <a href='/x'>l</a> <i></i>m").otherwise(""), F.lit("</h"), level, F.lit(">\n"),
        F.when(k % 3 == 0, F.concat(F.lit("<p>x <b>"), "o_orderpriority", F.lit("</b></p><p> &nbsp; </p>"))).otherwise(""), F.when(k % 5 == 0, "<pre>a  &lt;\nb</pre>").otherwise(""),
        F.when(k % 7 == 0, F.concat(F.lit("<table><tr><th>H</th><th>I</th></tr><tr><td colspan='2'>"), "o_orderstatus", F.lit("</td></tr></table>"))).otherwise(""), F.when(k % 13 == 0, "<div><ol type='a'><li>p<br>q<ul><li>r</li></ul></li></ol></div><ul class='a toc'><li>no</li></ul>").otherwise(""),
    )
    pages = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", part.alias("x")))), lambda s: s["x"]), "").alias("html"))
    return markup.sections(pages.withColumn("url", F.lit("http://h/")), "doc_id", "html", "url").select("doc_id", "place", "level", "kind", "title", "body")


# Near duplicates.

_SETS = r"""w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
    k AS (SELECT doc_id, string_agg(g, chr(1) ORDER BY g) AS k, count(*) AS n FROM s GROUP BY doc_id), c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY k) AS rep FROM k)"""


@query("doc_similar_pairs", f"""WITH {_SETS}, o AS (SELECT s.*, c.n FROM s JOIN c USING (doc_id) WHERE doc_id = rep),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard FROM o a JOIN o b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL) SELECT a, b, round(jaccard, 6) AS jaccard FROM p WHERE jaccard >= 0.75""")
def doc_similar_pairs(spark, sf_dir):
    pairs, _ = matching.similar(table(spark, sf_dir, "documents"), "doc_id", "text")
    return pairs.withColumn("jaccard", F.round("jaccard", 6))


@query("doc_hashed_pairs", f"""WITH {_SETS}, o AS (SELECT s.*, c.n FROM s JOIN c USING (doc_id) WHERE doc_id = rep),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) / (any_value(a.n) + any_value(b.n) - count(*)) AS jaccard FROM o a JOIN o b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL) SELECT a, b, round(jaccard, 6) AS jaccard FROM p WHERE jaccard >= 0.6""")
def doc_hashed_pairs(spark, sf_dir):
    """The similarity that the store is asked for, at its threshold: signatures, bands, exact verification."""
    pairs, _ = matching.similar_by_hash(table(spark, sf_dir, "documents"), "doc_id", "text", threshold=0.6)
    return pairs.withColumn("jaccard", F.round("jaccard", 6))


@query("doc_set_classes", f"WITH {_SETS} SELECT doc_id AS id, rep FROM c")
def doc_set_classes(spark, sf_dir):
    return matching.set_classes(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("verified_pairs", f"""WITH {_SETS}, o AS (SELECT s.*, c.n FROM s JOIN c USING (doc_id) WHERE doc_id = rep),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM o a JOIN o b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL HAVING count(*) / (any_value(a.n) + any_value(b.n) - count(*)) >= 0.75 UNION ALL SELECT rep, doc_id FROM c WHERE rep <> doc_id),
    lenient AS ({sql_canonical(_DOCS, "doc_id", "text")}), exact AS ({sql_canonical(_DOCS, "doc_id", "text", True)}) SELECT a, b, x.canon = y.canon AS equivalent, u.canon = v.canon AS strict FROM p JOIN lenient x ON x.key = a JOIN lenient y ON y.key = b JOIN exact u ON u.key = a JOIN exact v ON v.key = b""")
def verified_pairs(spark, sf_dir):
    return matching.verified(table(spark, sf_dir, "documents"), "doc_id", "text").select("a", "b", "equivalent", "strict")


@query("conversation_duplicates", "SELECT conv_id, turn, min(conv_id) OVER (PARTITION BY role, text) AS first_conv FROM conversations")
def conversation_duplicates(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    first = order.first_of_kind(t, ["role", "text"], "conv_id", "conv_id").withColumnRenamed("conv_id", "first_conv")
    return t.join(first, ["role", "text"]).select("conv_id", "turn", "first_conv")


@query("documents_per_language", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def documents_per_language(spark, sf_dir):
    return collections.count_by(table(spark, sf_dir, "documents"), "lang", "source")
