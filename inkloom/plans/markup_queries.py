"""Queries over node tables, table grids and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.functions import urls as U
from inkloom.operators import axes, markup
from inkloom.operators.axes import LAST, Step
from inkloom.plans.catalog import query, table

# Paths. Each customer is a book of orders; every third order holds another section.

_STATUS = lambda c: F.col("attrs")["st"] == c


def paths() -> dict[str, list[list[Step]]]:
    """Paths by name, each a union of one or more."""
    sect, nested = Step("descendant", "sect"), Step("descendant", "sect", where=_STATUS("N"))
    return {
        "second": [[Step("child", "book"), Step("child", "sect", place=2)]],
        "last": [[Step("child", "book"), Step("child", "sect", place=LAST)]],
        "after_open": [[Step("descendant", "sect", where=_STATUS("O")), Step("following-sibling", "sect", place=1)]],
        "outer": [[nested, Step("ancestor", "sect", place=1)]],
        "bare": [[Step("descendant", "sect", where=~_STATUS("N"), lacking=((Step("child", "sect"),),))]],
        "next": [[nested, Step("following", "sect", place=1)]],
        "before_filled": [[Step("descendant", "sect", where=_STATUS("F")), Step("preceding", "sect", where=_STATUS("N"))]],
        "urgent": [[Step("descendant", "sect", having=((Step("child", "p"), Step("child", "text()", where=F.col("text") == "1-URGENT")),))], [nested, Step("parent", "sect", place=1)]],
        "first_below": [[Step("child", "book"), sect, Step("descendant", "sect", place=1)]],
    }


@query("axis_steps", """WITH o AS (SELECT o_custkey AS doc_id, o_orderkey AS k, o_orderstatus AS st, o_orderpriority AS p, row_number() OVER w AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS z, lag(o_orderstatus) OVER w AS before, lag(o_orderkey) OVER w AS earlier,
      max(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END) OVER (PARTITION BY o_custkey) AS last_f FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    v AS (SELECT *, k::VARCHAR AS id, p || CASE WHEN k % 3 = 0 THEN 'in ' || k ELSE '' END AS value FROM o)
    SELECT doc_id, 'second' AS path, id, value FROM v WHERE n = 2 UNION ALL SELECT doc_id, 'last', id, value FROM v WHERE z = 1 UNION ALL SELECT doc_id, 'after_open', id, value FROM v WHERE before = 'O'
    UNION ALL SELECT doc_id, 'outer', id, value FROM v WHERE k % 3 = 0 UNION ALL SELECT doc_id, 'bare', id, value FROM v WHERE k % 3 <> 0 UNION ALL SELECT doc_id, 'next', id, value FROM v WHERE earlier % 3 = 0
    UNION ALL SELECT doc_id, 'before_filled', k || '.1', 'in ' || k FROM v WHERE k % 3 = 0 AND k < last_f UNION ALL SELECT doc_id, 'urgent', id, value FROM v WHERE p = '1-URGENT' OR k % 3 = 0
    UNION ALL SELECT doc_id, 'first_below', k || '.1', 'in ' || k FROM v WHERE k % 3 = 0""")
def axis_steps(spark, sf_dir):
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey").cast("string")
    inner = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit('<sect id="'), k, F.lit('.1" st="N"><p>in '), k, F.lit("</p></sect>"))).otherwise("")
    sect = F.concat(F.lit('<sect id="'), k, F.lit('" st="'), "o_orderstatus", F.lit('"><p>'), "o_orderpriority", F.lit("</p>"), inner, F.lit("</sect>"))
    books = o.groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", sect.alias("x")))).alias("s"))
    xml = books.select("doc_id", F.concat(F.lit("<book>"), F.array_join(F.transform("s", lambda x: x["x"]), ""), F.lit("</book>")).alias("xml"))
    nodes = markup.nodes(xml, "doc_id", "xml", xml=True).withColumn("id", F.col("attrs")["id"])
    found = axes.reached(nodes, "doc_id", paths())
    values = axes.with_values(found, "doc_id", F.size("paths") > 0, "id", "paths")
    return values.select("doc_id", F.explode("paths").alias("path"), "id", "value")


# Grids. Each supplier is a page with a table of one of four shapes.

_COLS = lambda n: f"list_reduce(list_transform(range(1, {n} + 1), lambda k: '<colspec colname=\"c' || k || '\"/>'), lambda a, b: a || b)"


@query("table_grids", f"""WITH s AS (SELECT s_suppkey, s_name AS a, s_nationkey::VARCHAR AS b FROM supplier)
    SELECT s_suppkey AS doc_id, CASE s_suppkey % 4
      WHEN 0 THEN '<informaltable><tgroup cols="3">' || {_COLS(3)} || '<tbody><row><entry morerows="1">' || a || '</entry><entry>x</entry><entry>y</entry></row><row><entry namest="c2" nameend="c3">' || b || '</entry></row><row><entry>1</entry><entry>2</entry><entry>3</entry></row></tbody></tgroup></informaltable>'
      WHEN 1 THEN '<informaltable><tgroup cols="1000">' || {_COLS(1000)} || '<tbody><row><entry namest="c1" nameend="c1000">' || a || '</entry></row></tbody></tgroup></informaltable>'
      WHEN 2 THEN '<informaltable><tgroup cols="3">' || {_COLS(3)} || '<thead><row><entry morerows="1">H</entry><entry>' || a || '</entry><entry/></row><row><entry>I</entry><entry/></row></thead><tbody><row><entry>p</entry><entry morerows="1">q</entry><entry>r</entry></row><row><entry>' || b || '</entry></row></tbody></tgroup></informaltable>'
      ELSE '<informaltable><tgroup cols="2">' || {_COLS(2)} || '<tbody><row><entrytbl cols="2">' || {_COLS(2)} || '<tbody><row><entry morerows="1">' || a || '</entry><entry>n</entry></row><row><entry>m</entry></row></tbody></entrytbl><entry>' || b || '</entry></row></tbody></tgroup></informaltable>' END AS body FROM s""")
def table_grids(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    a, b, k = F.col("s_name"), F.col("s_nationkey").cast("string"), F.col("s_suppkey") % 4
    tr = lambda *parts: F.concat(F.lit("<table>"), *(F.lit(p) if isinstance(p, str) else p for p in parts), F.lit("</table>"))
    html = (
        F.when(k == 0, tr("<tr><td rowspan='2'>", a, "</td><td>x</td><td>y</td></tr><tr><td colspan='2'>", b, "</td></tr><tr><td rowspan='²'>1</td><td rowspan='-3'>2</td><td>3</td></tr>"))
        .when(k == 1, tr("<tr><td colspan='3000000'>", a, "</td></tr>"))
        .when(k == 2, tr("<tr><th rowspan='9'>H</th><th>", a, "</th></tr><tr><th>I</th></tr><tr><td>p</td><td rowspan='2'>q</td><td>r</td></tr><tr><td>", b, "</td></tr>"))
        .otherwise(tr("<tr><td><table><tr><td rowspan='2'>", a, "</td><td>n</td></tr><tr><td>m</td></tr></table></td><td>", b, "</td></tr>"))
    )
    pages = s.select(F.col("s_suppkey").alias("doc_id"), F.concat(F.lit("<h1>T</h1>"), html).alias("html"), F.lit("http://h/").alias("url"))
    return markup.sections(pages, "doc_id", "html", "url").select("doc_id", "body")


# References of pages.

#: Forms of references.
_FORMS = ["g", "./g", "g/", "/g", "//g", "?y", "g?y", "#s", "g#s", "g?y#s", ";x", "", ".", "./", "..", "../", "../g", "../..", "../../g", "../../../../../../g", "/./g", "/../g", "g.", ".g", "..g", "./../g", "./g/.", "g/./h", "g/../h", "g;x=1/../y", "g?y/./x", "g#s/../x", "http:g", "mailto:a@b", "http://[x", "a%ZZ b", "HTTP://h/a/../b"]
_S = "^[A-Za-z][A-Za-z0-9+.-]*:"


@query("page_references", rf"""WITH r AS (SELECT page_id, url AS base, unnest([{", ".join(f"'{x}'" for x in _FORMS)}, regexp_extract(html, 'href="([^"]*)"', 1)]) AS ref FROM pages),
    p AS (SELECT *, regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS scheme, regexp_extract(base, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)', 1) AS side, regexp_extract(base, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS path, regexp_extract(base, '^[^?#]*(\?[^#]*)', 1) AS query,
      regexp_extract(ref, '^([A-Za-z][A-Za-z0-9+.-]*):', 1) AS rscheme, regexp_extract(ref, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(//[^/?#]*)', 1) AS rside, regexp_extract(ref, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS rpath, regexp_extract(ref, '^[^?#]*(\?[^#]*)', 1) AS rquery, regexp_extract(ref, '(#.*)$', 1, 's') AS frag FROM r),
    m AS (SELECT *, rscheme <> '' OR rside <> '' AS own, CASE WHEN rscheme <> '' OR rside <> '' OR starts_with(rpath, '/') THEN rpath ELSE CASE WHEN regexp_extract(path, '^(.*/)', 1) = '' AND side <> '' THEN '/' ELSE regexp_extract(path, '^(.*/)', 1) END || rpath END AS merged FROM p),
    d AS (SELECT *, string_split(merged, '/') AS steps FROM m),
    f AS (SELECT *, list_reduce(steps[2:], lambda acc, s: CASE WHEN s = '..' THEN regexp_replace(acc, '/[^/]*$', '') WHEN s = '.' THEN acc ELSE acc || '/' || s END, '') || CASE WHEN steps[-1] IN ('.', '..') THEN '/' ELSE '' END AS clean FROM d)
    SELECT page_id, ref, CASE WHEN scheme IS NULL OR scheme = '' THEN ref WHEN NOT own AND rpath = '' THEN scheme || ':' || side || path || CASE WHEN rquery <> '' THEN rquery ELSE query END || frag
      ELSE CASE WHEN rscheme <> '' THEN rscheme ELSE scheme END || ':' || CASE WHEN own THEN rside ELSE side END || CASE WHEN starts_with(merged, '/') THEN clean ELSE merged END || rquery || frag END AS url FROM f""")
def page_references(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    forms = F.array(*map(F.lit, _FORMS), F.regexp_extract("html", 'href="([^"]*)"', 1))
    each = p.select("page_id", F.col("url").alias("base"), F.explode(forms).alias("ref"))
    return each.select("page_id", "ref", U.absolute_to(F.col("ref"), F.col("base")).alias("url"))
