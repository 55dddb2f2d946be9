"""Font rules: the first that fits decides what a paragraph is; neighbours of one kind merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.operators.scratch import drop_held, held

FIELDS = ["font", "size", "bold", "italics", "underline", "strikethrough"]


def classify(paras: DataFrame, rules: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """paras(doc_id, ord, ...) with element and merge of the first rule (by rule_no) of which every field is null or equal.

    Rules that leave the same fields open are one join by the others, so any number of them may be given; there are 2^fields
    kinds at most. A rule without any field fits all and is one row.
    """
    filled = F.concat_ws(",", *(F.when(F.col(f).isNotNull(), F.lit(f)) for f in fields))
    first = rules.withColumn("__kind", filled)
    hits = None
    for (kind,) in sorted(first.select("__kind").distinct().collect()):
        own = kind.split(",") if kind else []
        best = first.where(F.col("__kind") == kind).groupBy(*own).agg(F.min_by(F.struct("rule_no", "element", "merge"), "rule_no").alias("x"))
        hit = paras.join(best, own) if own else paras.crossJoin(F.broadcast(best))
        one = hit.select("doc_id", "ord", "x")
        hits = one if hits is None else hits.unionByName(one)
    if hits is None:
        return paras.withColumns({"element": F.lit("para"), "merge": F.lit(False)})
    least = hits.groupBy("doc_id", "ord").agg(F.min("x").alias("__x"))
    out = paras.join(least, ["doc_id", "ord"], "left")
    return out.select(*(c for c in paras.columns if c not in ("element", "merge")), F.coalesce("__x.element", F.lit("para")).alias("element"), F.coalesce("__x.merge", F.lit(False)).alias("merge"))


def sizes_and_fonts(paras: DataFrame) -> DataFrame:
    """(doc_id, fonts, sizes): those that a text uses, each once, in the order of their letters."""
    return paras.groupBy("doc_id").agg(F.array_sort(F.collect_set("font")).alias("fonts"), F.array_sort(F.collect_set(F.col("size").cast("string"))).alias("sizes"))


def family_matches(families: Column, family: Column) -> Column:
    """Whether a font's list of families names one; quotation marks and spaces around don't count. A font that isn't declared matches any, no font none."""
    names = F.transform(F.split(families, ","), lambda x: F.trim(F.replace(x, F.lit("'"), F.lit(""))))
    return F.when(family.isNull(), False).when(families.isNull(), True).otherwise(F.array_contains(names, F.trim(family)))


def merge_runs(paras: DataFrame) -> DataFrame:
    """(doc_id, run, element, text): consecutive paragraphs of one merging element become one, line by line."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    change = F.when(F.col("merge") & F.lag("merge").over(w) & (F.lag("element").over(w) == F.col("element")), 0).otherwise(1)
    runs = paras.withColumn("change", change).withColumn("run", F.sum("change").over(w))
    return runs.groupBy("doc_id", "run").agg(F.first("element").alias("element"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "\n").alias("text"))


def inherited(styles: DataFrame, by: str, properties: list[str]) -> DataFrame:
    """styles(by, name, parent, properties) with each property's first value along the style's parents, its own before theirs.

    Pointers are doubled: each round joins the styles that lack something yet with those their pointers have come to, so chains of
    any length take the logarithm of it in rounds. A parent that there isn't ends a chain. Once no style has gained anything in a
    round none will: what lies twice as far has been asked by what lies between, so circles need no bound. Of styles of one
    name the last by parent counts.
    """
    one = styles.groupBy(by, "name").agg(F.max(F.struct("parent", *properties)).alias("x")).select(by, "name", "x.*")
    lacks = F.lit(False)
    for p in properties:
        lacks = lacks | F.col(p).isNull()
    open_ = F.col("__up").isNotNull() & lacks
    at = held(one.withColumn("__up", F.col("parent")), "styles")
    closed, parts = at.where(~open_), [at]
    while True:
        every = closed.unionByName(at.where(open_))
        over = every.select(by, F.col("name").alias("__up"), F.col("__up").alias("__next"), *(F.col(p).alias(f"__{p}") for p in properties))
        gained = F.lit(False)
        for p in properties:
            gained = gained | F.col(p).isNull() & F.col(f"__{p}").isNotNull()
        far = at.where(open_).join(over.hint("merge"), [by, "__up"], "left")  # as large as the table: never sent to the driver
        new = held(far.select(by, "name", "parent", *(F.coalesce(p, f"__{p}").alias(p) for p in properties), F.col("__next").alias("__up"), gained.alias("__gained")), "styles")
        if new.where("__gained").isEmpty():
            out = held(every.drop("__up"), "inherited")
            drop_held(new, *parts)
            return out
        at = new.drop("__gained")
        closed = closed.unionByName(at.where(~open_))
        parts.append(new)
