"""The content store: envelopes in, topics, files and images out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ENVELOPE = "struct<size:int,items:array<struct<item:struct<id:bigint,xml:string,xmlFormat:string,locale:struct<id:int>>>>>"


def from_envelope(df: DataFrame, column: str = "json") -> DataFrame:
    """Rows of a JSON envelope's items."""
    items = df.select(F.explode(F.from_json(column, ENVELOPE)["items"]).alias("x"))
    return items.select(F.col("x.item.id").alias("store_id"), F.col("x.item.xml").alias("xml"), F.col("x.item.xmlFormat").alias("xml_format"), F.col("x.item.locale.id").alias("locale_id"))


def page_source(df: DataFrame, column: str = "body") -> DataFrame:
    """The text of a wiki answer: without the guard before the JSON, the first item's content."""
    bare = F.regexp_replace(column, r"(?s)^\s*throw [^;]*;\s*", "")
    return df.withColumn("html", F.get_json_object(bare, "$.list[0].content.text"))


def create_or_match(new: DataFrame, store: DataFrame, content: str = "content") -> DataFrame:
    """Ids for contents: those of equal contents in the store, else new ones after its largest. (sha, store_id, matched)

    New ids follow the order of the hashes, by prefix sums over 4096 hash ranges, so no task ranks all contents.
    """
    sha = F.sha2(F.col(content).cast("binary"), 256)
    wanted = new.select(sha.alias("sha")).distinct()
    known = store.groupBy(sha.alias("sha")).agg(F.min("store_id").alias("store_id"))
    both = wanted.join(known, "sha", "left").withColumn("range", F.substring("sha", 1, 3))
    fresh = both.where("store_id is null")
    counts = fresh.groupBy("range").agg(F.count("*").alias("n"))
    base = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    top = store.agg(F.coalesce(F.max("store_id"), F.lit(0)).alias("top"))
    numbered = fresh.withColumn("k", F.row_number().over(Window.partitionBy("range").orderBy("sha"))).join(F.broadcast(base), "range").crossJoin(F.broadcast(top))
    made = numbered.select("sha", (F.col("top") + F.col("base") + F.col("k")).alias("store_id"), F.lit(False).alias("matched"))
    return both.where("store_id is not null").select("sha", "store_id", F.lit(True).alias("matched")).unionByName(made)


def sparse_update(store: DataFrame, changes: DataFrame, columns: list[str], order: str | None = None) -> DataFrame:
    """Overwrite the listed columns of the topics named in changes; the rest stays. Of several changes of one topic the last by ``order`` wins, then the greatest."""
    values = F.struct(*columns)
    rank = F.struct(*([F.col(order)] if order else []), values)
    last = changes.groupBy("store_id").agg(F.max_by(values, rank).alias("__v"))
    c = last.select("store_id", F.lit(True).alias("__hit"), *(F.col("__v")[x].alias(f"__{x}") for x in columns))
    joined = store.join(c, "store_id", "left")
    return joined.select(*(F.when(F.col("__hit"), F.col(f"__{x}")).otherwise(F.col(x)).alias(x) if x in columns else F.col(x) for x in store.columns))


# A store that is kept: a folder for each batch, the whole table after it.


def batches(spark: SparkSession, path: str) -> list[int]:
    """The batches that were written to the end, in order."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [(f.getPath(), f.getPath().getName()) for f in fs.listStatus(root)]
    done = [(p, n) for p, n in names if n.startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n.removeprefix("batch=")) for _, n in done)


def load(spark: SparkSession, path: str, schema: str, before: int | None = None) -> DataFrame:
    """The table after its last batch, or after the last one before a number; empty if there is none."""
    done = [n for n in batches(spark, path) if before is None or n < before]
    return spark.read.schema(schema).parquet(f"{path}/batch={done[-1]}") if done else spark.createDataFrame([], schema)


def save(rows: DataFrame, path: str, schema: str, batch: int, key: str = "store_id") -> None:
    """Put rows over the table by key; of rows with one key the greatest counts.

    Batches come in the order of their numbers. One that is run again starts from the table before it and replaces its own folder,
    so it changes nothing; one that broke off left no mark of success and isn't read. Old folders stay until they are cleared.
    """
    spark = rows.sparkSession
    names = [f.name for f in spark.createDataFrame([], schema).schema.fields]
    rest = [n for n in names if n != key]
    last = rows.groupBy(key).agg(F.max(F.struct(*rest)).alias("__x")).select(key, *(F.col(f"__x.{n}").alias(n) for n in rest))
    old = load(spark, path, schema, before=batch)
    old.join(last.select(key), key, "left_anti").select(*names).unionByName(last.select(*names)).write.mode("overwrite").parquet(f"{path}/batch={batch}")


SETTINGS = "struct<locales:struct<items:array<struct<item:struct<id:int,value:string,translationValue:string,buildValue:string>>>>,defaultLocale:struct<id:int,value:string>,entities:map<string,string>>"
FORMATS = {"4.5": "DOCBOOK_45", "5.0": "DOCBOOK_50"}


def locales(df: DataFrame, column: str = "json") -> DataFrame:
    """(locale_id, value, translation, build, is_default) of a settings envelope."""
    s = F.from_json(column, SETTINGS)
    rows = df.select(F.explode(s["locales"]["items"]).alias("x"), s["defaultLocale"]["id"].alias("d"))
    return rows.select(F.col("x.item.id").alias("locale_id"), F.col("x.item.value").alias("value"), F.col("x.item.translationValue").alias("translation"), F.col("x.item.buildValue").alias("build"), (F.col("x.item.id") == F.col("d")).alias("is_default"))


def with_locale(df: DataFrame, dimension: DataFrame, by: str = "value") -> DataFrame:
    """df(locale, ...) with the locale's id and value, found by id or by value; of several the least id. The dimension is a table of settings."""
    name = "locale_id" if by == "id" else "value"
    one = dimension.groupBy(F.col(name).cast("string").alias("locale")).agg(F.min_by(F.struct("locale_id", "value"), "locale_id").alias("x"))
    return df.withColumn("locale", F.col("locale").cast("string")).join(one, "locale", "left").select(*df.columns, F.col("x.locale_id").alias("locale_id"), F.col("x.value").alias("locale_value"))


def servers(df: DataFrame, own_host: str, column: str = "json") -> DataFrame:
    """(name, host) of a list of servers; without a readable one the own host."""
    from inkloom.functions.urls import part

    listed = F.filter(F.from_json(column, "array<struct<serverName:string,restUrl:string>>"), lambda s: s["restUrl"].isNotNull())
    fallback = F.array(F.struct(F.lit(f"Default ({own_host})").alias("serverName"), F.lit(f"http://{own_host}/").alias("restUrl")))
    rows = df.select(F.explode(F.when(F.size(listed) > 0, listed).otherwise(fallback)).alias("s"))
    return rows.select(F.col("s.serverName").alias("name"), part(F.col("s.restUrl"), "host").alias("host"))


def in_spec(topics: DataFrame, members: DataFrame, spec: int | None = None) -> DataFrame:
    """The topics of a spec (of any, with its id, if spec is None), with ``n_specs``: how many specs use them. members(spec, store_id)."""
    uses = members.distinct().groupBy("store_id").agg(F.count("*").alias("n_specs"))
    own = members.distinct() if spec is None else members.where(F.col("spec") == spec).distinct()
    return own.join(uses, "store_id").join(topics, "store_id")


def topic_rows(new: DataFrame) -> DataFrame:
    """What a topic is written with: (xml, title, description, tags, locale_id, xml_format) from new(xml, title, tags, locale_id, version).

    A title is the description too, tags are added (state 1), and only known versions give a format.
    """
    title = F.when(F.col("title") != "", F.col("title"))
    known = F.create_map(*(F.lit(x) for kv in FORMATS.items() for x in kv))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<int>")), lambda t: F.struct(t.alias("id"), F.lit(1).alias("state")))
    return new.withColumns({"title": title, "description": title, "tags": tags, "xml_format": F.try_element_at(known, F.col("version").cast("string"))})


def create_topics(new: DataFrame, store: DataFrame, match: bool = True) -> DataFrame:
    """new(key, xml, title, tags, locale_id, version) to (key, store_id, matched): equal texts of one locale and format share an id.

    With match, texts that the store(store_id, xml, xml_format, locale_id) holds get its id.
    """
    same = lambda df: df.withColumn("content", F.to_json(F.struct("xml", F.coalesce("xml_format", F.lit("")).alias("f"), F.coalesce("locale_id", F.lit(-1)).alias("l"))))
    rows = same(topic_rows(new))
    known = same(store)
    ids = create_or_match(rows, known if match else known.withColumn("content", F.concat(F.lit("\x00"), "content")))
    return rows.select("key", F.sha2(F.col("content").cast("binary"), 256).alias("sha")).join(ids, "sha").select("key", "store_id", "matched")


def spec_text(text: Column, spec_id: Column) -> Column:
    """What an outline is written with: one that exists names its id first."""
    return F.when(spec_id.isNull(), text).otherwise(F.concat(F.lit("ID = "), spec_id.cast("string"), F.lit("\n"), text))


def write_specs(specs: DataFrame, store: DataFrame) -> DataFrame:
    """specs(spec_id, text) written over store(spec_id, text): ids stay, specs without one get those after the largest. Of several texts for one id the greatest counts."""
    top = store.agg(F.coalesce(F.max("spec_id"), F.lit(0)).alias("top"))
    fresh = specs.where("spec_id IS NULL").select(F.sha2("text", 256).alias("sha"), "text").distinct()
    counts = fresh.groupBy(F.substring("sha", 1, 3).alias("range")).agg(F.count("*").alias("n"))
    base = counts.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    made = fresh.withColumn("range", F.substring("sha", 1, 3)).withColumn("k", F.row_number().over(Window.partitionBy("range").orderBy("sha"))).join(F.broadcast(base), "range").crossJoin(F.broadcast(top))
    known = specs.where("spec_id IS NOT NULL").groupBy("spec_id").agg(F.max("text").alias("text"))
    old = store.join(known.select("spec_id"), "spec_id", "left_anti")
    return old.select("spec_id", "text").unionByName(known.select("spec_id", spec_text(F.col("text"), F.col("spec_id")).alias("text"))).unionByName(made.select((F.col("top") + F.col("base") + F.col("k")).alias("spec_id"), "text"))


def image_names(uploaded: DataFrame) -> DataFrame:
    """uploaded(source, fileref, store_id) with ``name``: where the image is found from now on."""
    return uploaded.withColumn("name", F.concat(F.lit("images/"), F.col("store_id").cast("string"), F.regexp_extract("fileref", r"(\.[^.]*)$", 1)))


#: A reference to an image, its quotation mark and its name.
FILEREF = r"""fileref\s*=\s*(["'])(.*?)\1"""


def image_refs(xml: Column) -> Column:
    """The image references of a text, in order, whatever their quotation marks."""
    return F.regexp_extract_all(xml, F.lit(FILEREF), F.lit(2))


def rewrite_images(topics: DataFrame, uploaded: DataFrame) -> DataFrame:
    """topics(source, key, xml) with the image references that were uploaded rewritten; only names that a topic uses travel to it."""
    used = topics.select("source", "key", F.explode(F.array_distinct(image_refs(F.col("xml")))).alias("fileref"))
    found = used.join(image_names(uploaded), ["source", "fileref"]).groupBy("source", "key").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("fileref", "name")))).alias("__names"))
    # Texts are cut at their references, so a name that a rewriting made is not rewritten again.
    refs = F.regexp_extract_all("xml", F.lit(FILEREF), F.lit(0))
    name = lambda r: F.try_element_at("__names", F.regexp_extract(r, FILEREF, 2))
    new = F.transform(refs, lambda r: F.when(name(r).isNull(), r).otherwise(F.concat(F.regexp_extract(r, r"^(fileref\s*=\s*[\"'])", 1), name(r), F.substring(r, -1, 1))))
    between = F.split("xml", FILEREF, -1)
    put = F.array_join(F.zip_with(between, new, lambda b, r: F.concat(b, F.coalesce(r, F.lit("")))), "")
    return topics.join(found, ["source", "key"], "left").withColumn("xml", F.when(F.col("__names").isNull(), F.col("xml")).otherwise(put)).drop("__names")
