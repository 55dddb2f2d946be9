"""One import of books: topics matched with a store, consistently reused or created, outlined and reported."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkloom.functions import text as X
from inkloom.operators import graph, markup, outline, splice
from inkloom.operators.scratch import held
from inkloom.sources import store as contents


def shred(books: DataFrame) -> DataFrame:
    """books(doc_id, xml) to the boxes of markup.shred_book with their xml and the ids inside them."""
    return markup.shred_book(books, "doc_id", "xml", texts=True)


def candidates(topics: DataFrame, links: DataFrame, stored: DataFrame) -> DataFrame:
    """(doc_id, src, store_id, xml): stored topics that are equal to a topic, its known links taken for injections.

    A topic that neither links nor is linked to asks nothing of an id, so the least one stands for all.
    """
    aims = graph.resolve_targets(links, topics.select("doc_id", F.col("node_id").alias("seq"), F.col("ids").alias("xml_ids")), topics.limit(0).select("doc_id", F.col("node_id").alias("seq"), F.col("ids").alias("xml_ids")))
    tied = aims.where("dst IS NOT NULL").select("doc_id", F.col("dst").alias("node_id")).unionByName(links.select("doc_id", F.col("src").alias("node_id"))).distinct().withColumn("tied", F.lit(True))
    known = links.groupBy("doc_id", F.col("src").alias("node_id")).agg(F.collect_set("linkend").alias("known"))
    keyed = topics.join(known, ["doc_id", "node_id"], "left").join(tied, ["doc_id", "node_id"], "left").select("doc_id", "node_id", F.coalesce("tied", F.lit(False)).alias("tied"), F.unhex(X.canonical_key(X.fold_xrefs(F.col("xml"), F.col("known")))).alias("canon"))
    there = held(stored.select("store_id", "xml", F.unhex(X.canonical_key(F.col("xml"))).alias("canon")), "stored")
    least = there.groupBy("canon").agg(F.min(F.struct("store_id", "xml")).alias("x")).select("canon", "x.store_id", "x.xml")
    found = keyed.where("tied").join(there, "canon").unionByName(keyed.where("NOT tied").join(least, "canon"))
    return found.select("doc_id", F.col("node_id").alias("src"), "store_id", "xml")


def requirements(topics: DataFrame, boxes: DataFrame, links: DataFrame, found: DataFrame) -> DataFrame:
    """What graph.resolve takes: each candidate with what its injections require of the topics and containers that the links name."""
    wants = graph.stored_links(links, found)
    ids = lambda df: df.select("doc_id", F.col("node_id").alias("seq"), F.col("ids").alias("xml_ids"))
    aimed = graph.resolve_targets(wants, ids(topics), ids(boxes)).join(boxes.select("doc_id", F.col("node_id").alias("dst"), F.col("target_num").alias("dst_target"), F.lit("container").alias("dst_kind")), ["doc_id", "dst", "dst_kind"], "left")
    asked = aimed.select("doc_id", "src", "store_id", F.when(F.col("fits"), F.coalesce("dst_kind", F.lit("missing"))).otherwise("missing").alias("dst_kind"), "dst", "dst_target", "required_ref")
    free = found.select("doc_id", "src", "store_id").join(wants.select("doc_id", "src", "store_id").distinct(), ["doc_id", "src", "store_id"], "left_anti")
    both = asked.unionByName(free, allowMissingColumns=True)
    return both.select(F.col("doc_id").alias("component"), F.col("src").alias("topic_seq"), "store_id", "dst_kind", "dst", "dst_target", "required_ref")


def import_books(books: DataFrame, stored: DataFrame, title: str = "title") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(topics with their status and id, topics to write, outlines with their reports) of books(doc_id long, title, xml) and stored(store_id, xml).

    A topic takes the id of an equal stored one where all that this one's injections require can be had together; the others get
    new ids, equal ones the same. What is to be written has its links as injections. The store itself isn't changed
    (``store.save`` does that). A book that can't be parsed has no topics and no outline.
    """
    every = held(shred(books), "boxes")
    topics, boxes = every.where("kind = 'topic'"), every.where("kind = 'container'")
    # A topic's own id counts; so does a container's.
    named = lambda df: df.withColumn("ids", F.array_distinct(F.array_compact(F.concat(F.col("ids"), F.array("xml_id")))))
    topics, boxes = named(topics.withColumn("xml", X.rename_root(F.col("xml"), F.lit("section")))), named(boxes)
    ids = graph.known_ids(every.select("doc_id", F.col("node_id").alias("seq"), "kind", F.col("ids").alias("xml_ids")))
    links = held(graph.edges_known(graph.edges_of(topics.select("doc_id", F.col("node_id").alias("src"), "xml")), ids), "links")
    found = held(candidates(topics, links, stored), "found")
    decided = held(graph.resolve(requirements(topics, boxes, links, found)).select(F.col("component").alias("doc_id"), F.col("topic_seq").alias("node_id"), "store_id"), "decided")
    placed = topics.join(decided, ["doc_id", "node_id"], "left")
    fresh = placed.where("store_id IS NULL").select(F.struct("doc_id", "node_id").alias("key"), "xml", "title", F.array().cast("array<int>").alias("tags"), F.lit(None).cast("int").alias("locale_id"), F.lit("").alias("version"))
    known = stored.select("store_id", "xml", F.lit(None).cast("string").alias("xml_format"), F.lit(None).cast("int").alias("locale_id"))
    made = held(contents.create_topics(fresh, known, match=False).select("key.doc_id", "key.node_id", F.col("store_id").alias("new_id")), "made")
    done = held(placed.join(made, ["doc_id", "node_id"], "left").select("doc_id", "node_id", "title", "xml", "ids", F.when(F.col("store_id").isNull(), "NEW").otherwise("REUSED").alias("status"), F.coalesce("store_id", "new_id").alias("store_id")), "done")
    refs = done.select("doc_id", F.explode("ids").alias("linkend"), F.col("store_id").cast("string").alias("ref"), F.lit(1).alias("r")).unionByName(boxes.select("doc_id", F.explode("ids").alias("linkend"), F.concat(F.lit("T"), F.col("target_num").cast("string")).alias("ref"), F.lit(0).alias("r")))
    one = refs.where("ref IS NOT NULL").groupBy("doc_id", "linkend").agg(F.max_by("ref", F.struct("r", "ref")).alias("ref"))
    linked = splice.inject_links(done.where("status = 'NEW'").select("doc_id", F.col("node_id").alias("seq"), "store_id", "xml"), one)
    written = linked.groupBy("store_id").agg(F.min("xml").alias("xml"))  # equal topics are one; which links they carry is the first's to say
    lines = outline.with_ids(outline.lines_of(every), done.select("doc_id", F.col("node_id").alias("line_no"), "store_id", F.lit(False).alias("info")))
    heads = books.select("doc_id", F.lit(-1).alias("line_no"), F.concat(F.lit("Title = "), F.coalesce(F.col(title), F.lit("Unknown"))).alias("text")).join(every.select("doc_id").distinct(), "doc_id", "left_semi")
    specs = outline.render(heads.unionByName(lines))
    lists = done.groupBy("doc_id", F.when(F.col("status") == "NEW", "new").otherwise("reused").alias("kind")).agg(F.array_sort(F.collect_set("store_id")).alias("s")).select("doc_id", "kind", F.transform("s", lambda x: x.cast("string")).alias("items"))
    reports = outline.report(lists, "the last one").withColumnRenamed("text", "report")
    return done.select("doc_id", "node_id", "title", "status", "store_id"), written, specs.join(reports, "doc_id", "left")
