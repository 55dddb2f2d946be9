"""The outline (content specification) and its report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def wrap_list(items: Column, width: int = 120, prefix: str = "# ") -> Column:
    """Items joined by commas; a line that has grown over ``width`` is broken, each line prefixed."""
    start = F.struct(F.lit(prefix).alias("text"), F.lit(len(prefix)).alias("line"), F.lit(0).alias("n"))

    def add(acc: Column, item: Column) -> Column:
        full = acc["line"] > width
        glue = F.when(acc["n"] == 0, "").when(full, ",\n" + prefix).otherwise(", ")
        line = F.when(full, len(prefix) + F.length(item)).otherwise(acc["line"] + F.length(glue) + F.length(item))
        return F.struct(F.concat(acc["text"], glue, item).alias("text"), line.cast("int").alias("line"), (acc["n"] + 1).alias("n"))

    return F.when(F.size(items) > 0, F.aggregate(items, start, add, lambda acc: acc["text"])).otherwise("")


def header(options: dict[str, Column]) -> Column:
    """``Name = value`` lines of the options that have a value, in order."""
    return F.array_compact(F.array(*(F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k} = "), v)) for k, v in options.items())))


def with_ids(lines: DataFrame, ids: DataFrame) -> DataFrame:
    """lines(doc_id, line_no, text) with `` [id]`` appended where ids(doc_id, line_no, store_id, info) has one."""
    joined = lines.join(ids, ["doc_id", "line_no"], "left")
    tag = F.when(F.col("info"), F.concat(F.lit(" [Info: "), F.col("store_id").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit(" ["), F.col("store_id").cast("string"), F.lit("]")))
    return joined.select("doc_id", "line_no", F.concat("text", F.coalesce(F.when(F.col("store_id").isNotNull(), tag), F.lit(""))).alias("text"))


def render(lines: DataFrame) -> DataFrame:
    """(doc_id, text): an outline is one text, so its lines meet in one row."""
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"]), "\n").alias("text"))


#: The kinds of metadata in their order, and the sections of the report.
METADATA = ("Title", "Product", "Format", "Version", "Subtitle", "Edition", "Pubsnumber", "Brand", "Type", "Default Preface", "Index")
REPORT = {
    "outgoing": "The following topics were added to this content specification with links that were not found in the white list.",
    "reused": "The following existing topics were reused during the import.",
    "new": "The following new topics were created during the import.",
    "updated": "The following existing topics were updated during the import.",
    "removed": "The following existing topics were discarded during the import.",
}


def spec_header(options: dict[str, Column], root: Column, status: Column, version: Column, condition: Column, entities: Column, holder: str = "Unknown") -> Column:
    """The lines before the outline itself.

    options: metadata by kind; Title and Product are Unknown if missing. root: book or article; status: draft marks the type.
    entities: declarations; those of HOLDER and YEAR become metadata, the first of each, the others a list.
    """
    value = lambda name: F.regexp_extract(F.get(F.filter(entities, lambda e: e.rlike(rf"<!ENTITY\s+{name}\s")), 0), rf"""<!ENTITY\s+{name}\s+["'](.*?)["']>""", 1)
    draft = F.when(F.trim(status) == "draft", "-Draft").otherwise("")
    kind = F.when(root.isin("book", "article"), F.concat(F.initcap(root), draft))
    fixed = {"Title": F.coalesce(options.get("Title", F.lit(None)), F.lit("Unknown")), "Product": F.coalesce(options.get("Product", F.lit(None)), F.lit("Unknown")), "Format": F.concat(F.lit("DocBook "), version), "Type": kind, "Default Preface": F.lit("Off")}
    shown = {k: F.when(F.trim(v) != "", v) for k in METADATA if (v := fixed.get(k, options.get(k))) is not None}
    others = F.transform(F.filter(entities, lambda e: ~e.rlike(r"<!ENTITY\s+(?:HOLDER|YEAR)\s")), lambda e: F.regexp_replace(e, r"([\[\]])", r"\\$1"))
    named = F.when(F.size(entities) > 0, F.concat(F.array(F.lit("Entities = [")), others, F.array(F.lit("]")))).otherwise(F.array().cast("array<string>"))
    legal = F.array_compact(F.array(F.concat(F.lit("[condition = "), condition, F.lit("]")), F.concat(F.lit("Copyright Holder = "), F.coalesce(F.nullif(value("HOLDER"), F.lit("")), F.lit(holder))), F.concat(F.lit("Copyright Year = "), F.nullif(value("YEAR"), F.lit("")))))
    return F.concat(header(shown), legal, named)


def lines_of(topics: DataFrame) -> DataFrame:
    """topics(doc_id, node_id, kind, name, title, depth, target_num) to outline lines (doc_id, line_no, text): indented titles, containers by kind, with their targets."""
    kind = F.when(F.col("name").rlike("^(sect[1-5]|simplesect|section)$"), "Section").otherwise(F.initcap("name"))
    label = F.when(F.col("kind") == "container", F.concat(kind, F.lit(": "))).otherwise("")
    target = F.coalesce(F.concat(F.lit(" [T"), F.col("target_num").cast("string"), F.lit("]")), F.lit(""))
    text = F.concat(F.repeat(F.lit("  "), (F.greatest(F.col("depth") - 1, F.lit(0))).cast("int")), label, F.trim(F.regexp_replace("title", r"([\[\]])", r"\\$1")), target)
    return topics.select("doc_id", F.col("node_id").alias("line_no"), text.alias("text"))


def report(lists: DataFrame, when: str, width: int = 120) -> DataFrame:
    """lists(doc_id, kind, items) to (doc_id, text): the report's sections, those with items, in order. when: the time that it speaks of."""
    order = {k: n for n, k in enumerate(REPORT)}
    rank = F.create_map(*(F.lit(x) for kv in order.items() for x in kv))
    title = F.create_map(*(F.lit(x) for kv in REPORT.items() for x in kv))
    intro = f"#\n# What became of the topics in the import of {when}. Later edits of topics or of this outline don't show here.\n"
    part = F.concat(F.when(F.col("kind") == "outgoing", intro).otherwise(""), F.lit("#\n# "), title[F.col("kind")], F.lit("\n"), wrap_list(F.col("items"), width))
    rows = lists.where(F.col("kind").isin(*REPORT) & (F.size("items") > 0)).select("doc_id", rank[F.col("kind")].alias("k"), part.alias("text"))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), "\n").alias("text"))
