"""Collection functions and computations that depend on an order, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkloom.functions import collections as C
from inkloom.functions import text as X
from inkloom.operators import markup, order
from inkloom.plans.catalog import query, table

# Tables by key.


@query("topic_exists_semi", "SELECT c_custkey, c_nationkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')")
def topic_exists_semi(spark, sf_dir):
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf_dir, "customer").join(o.select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_nationkey")


@query("count_by", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
def count_by(spark, sf_dir):
    return C.count_by(table(spark, sf_dir, "customer"), "c_mktsegment")


@query("attribute_occurrences", "SELECT 'href' AS name, sum(len(regexp_extract_all(html, '<a\\s[^>]*href=')))::BIGINT AS n FROM pages UNION ALL SELECT 'lang', sum(len(regexp_extract_all(html, '<html\\s[^>]*lang=')))::BIGINT FROM pages".replace("\\\\", "\\"))
def attribute_occurrences(spark, sf_dir):
    n = markup.nodes(table(spark, sf_dir, "pages"), "page_id", "html")
    return C.count_by(n.where(F.col("name").isin("a", "html")).select(F.explode(F.map_keys("attrs")).alias("name")).where("name in ('href', 'lang')"), "name")


@query("index_by_last", "SELECT p_brand, arg_max(p_name, p_partkey) AS last_name, max(p_partkey) AS last_key FROM part GROUP BY p_brand")
def index_by_last(spark, sf_dir):
    return C.index_by(table(spark, sf_dir, "part"), "p_brand", "p_partkey", "p_name", "p_partkey").select("p_brand", F.col("p_name").alias("last_name"), F.col("p_partkey").alias("last_key"))


@query("bag_union", "SELECT c_nationkey AS k, 'c' AS kind FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier")
def bag_union(spark, sf_dir):
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    return C.union_all(c.select(F.col("c_nationkey").alias("k"), F.lit("c").alias("kind")), s.select(F.lit("s").alias("kind"), F.col("s_nationkey").alias("k")))


@query("union_distinct", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, sf_dir):
    return C.union(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("group_bounds", "SELECT p_brand, min(p_retailprice) AS least, max(p_retailprice) AS most FROM part GROUP BY p_brand")
def group_bounds(spark, sf_dir):
    return C.bounds(table(spark, sf_dir, "part"), "p_brand", "p_retailprice")


@query("every_some", "SELECT o_custkey, bool_and(o_totalprice > 1000) AS every, bool_or(o_totalprice > 200000) AS some FROM orders GROUP BY o_custkey")
def every_some(spark, sf_dir):
    return C.all_and_some(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_totalprice") > 1000, F.col("o_totalprice") > 200000)


@query("first_last_per_group", "SELECT user_id, min(event_id) AS first, max(event_id) AS last FROM events GROUP BY user_id")
def first_last_per_group(spark, sf_dir):
    return C.first_and_last(table(spark, sf_dir, "events"), "user_id", "event_id", "event_id")


# Arrays and maps: each order's line statuses, each part's words.


def _flags(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_suppkey"))).alias("x"))
    return l.select("l_orderkey", F.transform("x", lambda e: e["l_returnflag"]).alias("f"), F.transform("x", lambda e: e["l_suppkey"].cast("string")).alias("s"))


_FLAGS = "(SELECT l_orderkey, list(l_returnflag ORDER BY l_linenumber, l_returnflag, l_suppkey) AS f, list(l_suppkey::VARCHAR ORDER BY l_linenumber, l_returnflag, l_suppkey) AS s FROM lineitem GROUP BY l_orderkey)"


@query("array_parts", f"""SELECT l_orderkey, array_to_string(list_filter(f, lambda x: x <> 'N'), '') AS without, array_to_string(list_filter(f, lambda x: x = 'R'), '') AS yes, array_to_string(list_filter(f, lambda x: x <> 'R'), '') AS no, array_to_string(f[1:len(f) - 1], '') AS initial, array_to_string(f[2:], '') AS rest,
    coalesce(list_position(f, 'A'), 0)::INTEGER - 1 AS at, CASE WHEN list_contains(f, 'A') THEN len(f)::INTEGER - list_position(list_reverse(f), 'A')::INTEGER ELSE -1 END AS last_at, len(list_filter(f, lambda x: x < 'N'))::INTEGER AS belongs FROM {_FLAGS}""")
def array_parts(spark, sf_dir):
    f = F.col("f")
    text = lambda c: F.array_join(c, "")
    split = C.partition(f, lambda x: x == "R")
    return _flags(spark, sf_dir).select("l_orderkey", text(C.without(f, "N")).alias("without"), text(split["yes"]).alias("yes"), text(split["no"]).alias("no"), text(C.initial(f)).alias("initial"), text(C.rest(f)).alias("rest"), C.index(f, F.lit("A")).alias("at"), C.last_index(f, F.lit("A")).alias("last_at"), C.sorted_index(f, F.lit("N")).alias("belongs"))


@query("array_groups", f"""WITH a AS {_FLAGS}, x AS (SELECT l_orderkey, unnest(range(0, len(f))) AS k, f FROM a), p AS (SELECT l_orderkey, string_agg(array_to_string(f[k + 1:k + 2], ''), '|' ORDER BY k) FILTER (k % 2 = 0) AS slices, string_agg(array_to_string(f[k + 1:k + 2], ''), '|' ORDER BY k) FILTER (k + 2 <= len(f)) AS conses FROM x GROUP BY l_orderkey)
    SELECT l_orderkey, slices, coalesce(conses, '') AS conses, regexp_extract(array_to_string(f, ''), '^N*') AS taken, regexp_replace(array_to_string(f, ''), '^N*', '') AS dropped, reverse(array_to_string(f, '')) AS folded FROM a JOIN p USING (l_orderkey)""")
def array_groups(spark, sf_dir):
    f = F.col("f")
    text = lambda c: F.array_join(c, "")
    each = lambda c: F.array_join(F.transform(c, text), "|")
    return _flags(spark, sf_dir).select("l_orderkey", each(C.slices(f, 2)).alias("slices"), each(C.conses(f, 2)).alias("conses"), text(C.take_while(f, lambda x: x == "N")).alias("taken"), text(C.drop_while(f, lambda x: x == "N")).alias("dropped"), C.fold_right(f, F.lit(""), lambda acc, x: F.concat(acc, x)).alias("folded"))


@query("map_functions", """SELECT p_partkey, 'brand=' || p_brand || ',size=' || CASE WHEN p_size > 25 THEN 'L' ELSE p_size::VARCHAR END AS merged, 'brand' AS picked, 'size' AS omitted, 'brand,kind,size' AS filled, p_brand AS inverted FROM part""")
def map_functions(spark, sf_dir):
    base = F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))
    over = F.when(F.col("p_size") > 25, F.create_map(F.lit("size"), F.lit("L"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = C.merge(base, over)
    keys = lambda m: F.array_join(C.sorted_keys(m), ",")
    filled = C.defaults(base, F.create_map(F.lit("kind"), F.lit("k"), F.lit("size"), F.lit("none")))
    twice = F.create_map(F.lit("old"), F.lit("v"), F.col("p_brand"), F.lit("v"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.transform(C.sorted_keys(merged), lambda k: F.concat(k, F.lit("="), merged[k])), ",").alias("merged"), keys(C.pick(base, "brand")).alias("picked"), keys(C.omit(base, "brand")).alias("omitted"), keys(filled).alias("filled"), C.invert(twice)["v"].alias("inverted"))


@query("max_columns", "SELECT o_custkey, max(n)::INTEGER AS max_cols FROM (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey")
def max_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("cells"))
    held = rows.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.collect_list("cells").alias("rows"))
    return held.select("o_custkey", X.max_columns(F.col("rows")).alias("max_cols"))


# Order.


@query("sort_by_rank", "SELECT s_suppkey, row_number() OVER (ORDER BY s_nationkey, s_suppkey) AS place FROM supplier")
def sort_by_rank(spark, sf_dir):
    return order.numbered(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), "s_nationkey", "s_suppkey").select("s_suppkey", "place")


@query("each_slice", "SELECT (rn - 1) // 5 AS slice, count(*) AS n, min(o_orderkey) AS first_key FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rn FROM orders) GROUP BY 1")
def each_slice(spark, sf_dir):
    return order.sliced(table(spark, sf_dir, "orders").select("o_orderkey"), 5, "o_orderkey").groupBy("slice").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("first_key"))


@query("each_cons", "SELECT o_custkey, o_orderkey, string_agg(o_orderkey, ',') OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS cons FROM orders")
def each_cons(spark, sf_dir):
    rows = order.windows_of(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], "o_orderkey", "o_orderkey", 3)
    return rows.select("o_custkey", "o_orderkey", F.array_join(F.transform("cons", lambda x: x.cast("string")), ",").alias("cons"))


@query("target_counter", "SELECT o_custkey, o_orderkey, count(*) FILTER (o_orderstatus = 'F') OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS target_num FROM orders")
def target_counter(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return order.running(o, ["o_custkey"], "o_orderkey", F.col("o_orderstatus") == "F", "target_num").drop("o_orderstatus")


@query("consecutive_islands", """WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events), b AS (SELECT user_id, event_type, g, count(*) AS n, min(event_id) AS first FROM a GROUP BY ALL)
    SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY first) AS island, n, first FROM b""")
def consecutive_islands(spark, sf_dir):
    return order.islands(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type")


@query("neighbour_elements", "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS before, lead(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS after FROM events")
def neighbour_elements(spark, sf_dir):
    return order.neighbours(table(spark, sf_dir, "events"), ["user_id"], "event_id", "event_type").select("event_id", "before", "after")


@query("content_owner", "SELECT e.event_id, (SELECT max(v.event_id) FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'view' AND v.event_id <= e.event_id) AS heading_id FROM events e")
def content_owner(spark, sf_dir):
    return order.owner(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type") == "view", "event_id", "heading_id").select("event_id", "heading_id")


@query("first_of_kind", "SELECT DISTINCT ON (user_id, event_type) user_id, event_type, event_id, value FROM events ORDER BY user_id, event_type, event_id")
def first_of_kind(spark, sf_dir):
    return order.first_of_kind(table(spark, sf_dir, "events"), ["user_id", "event_type"], "event_id", "event_id", "value")
