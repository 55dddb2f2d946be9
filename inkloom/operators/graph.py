"""Cross-references: targets, constraints, closures and consistent reuse."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkloom.functions import text as X
from inkloom.operators.scratch import drop_held, held


def resolve_targets(links: DataFrame, topics: DataFrame, containers: DataFrame) -> DataFrame:
    """links(doc_id, src, ord, linkend) with dst_kind and dst: topics before containers, within a kind the last wins.

    topics and containers: (doc_id, seq, xml_ids).
    """
    ids = topics.select("doc_id", F.lit("topic").alias("dst_kind"), "seq", F.explode("xml_ids").alias("linkend")).unionByName(containers.select("doc_id", F.lit("container").alias("dst_kind"), "seq", F.explode("xml_ids").alias("linkend")))
    best = ids.groupBy("doc_id", "linkend").agg(F.max(F.struct((F.col("dst_kind") == "topic").alias("first"), "seq", "dst_kind")).alias("x"))
    return links.join(best, ["doc_id", "linkend"], "left").select(*links.columns, F.col("x.dst_kind").alias("dst_kind"), F.col("x.seq").alias("dst"))


def pair_by_place(left: DataFrame, right: DataFrame, key: str, order: str, left_value: str, right_value: str) -> DataFrame:
    """The k-th of one side with the k-th of the other, within a key."""
    w = Window.partitionBy(key).orderBy(order)
    a = left.select(key, F.row_number().over(w).alias("k"), F.col(left_value).alias("left_value"))
    b = right.select(key, F.row_number().over(w).alias("k"), F.col(right_value).alias("right_value"))
    return a.join(b, [key, "k"])


def known_ids(topics: DataFrame) -> DataFrame:
    """topics(doc_id, seq, kind, xml_ids) to (doc_id, linkend, place): each id once, those of topics before those of containers, in order."""
    rows = topics.select("doc_id", F.when(F.col("kind") == "topic", 0).otherwise(1).alias("r"), "seq", F.posexplode("xml_ids").alias("pos", "linkend"))
    first = rows.groupBy("doc_id", "linkend").agg(F.min(F.struct("r", "seq", "pos")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("doc_id").orderBy("at"))).select("doc_id", "linkend", "place")


def duplicate_ids(topics: DataFrame) -> DataFrame:
    """(doc_id, linkend, n) of ids that several places have, which no outline may hold. topics(doc_id, xml_ids)."""
    return topics.select("doc_id", F.explode("xml_ids").alias("linkend")).groupBy("doc_id", "linkend").agg(F.count("*").alias("n")).where("n > 1")


def edges_of(topics: DataFrame) -> DataFrame:
    """topics(doc_id, src, xml) to (doc_id, src, ord, linkend): the links of each topic, in order."""
    return topics.select("doc_id", "src", F.posexplode(X.linkends(F.col("xml"))).alias("ord", "linkend"))


def edges_known(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges to ids(doc_id, linkend) that exist, with their place among these."""
    there = edges.join(ids.select("doc_id", "linkend").distinct(), ["doc_id", "linkend"], "left_semi")
    return there.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "src").orderBy("ord")) - 1)


def stored_links(edges: DataFrame, stored: DataFrame) -> DataFrame:
    """The k-th known link of a topic with the k-th injection of each stored text that it may be: (doc_id, src, store_id, linkend, required_ref, fits).

    edges(doc_id, src, place, linkend), stored(doc_id, src, store_id, xml). fits is false, with a null linkend, where a stored text
    has more injections than the topic has links.
    """
    held = stored.select("doc_id", "src", "store_id", F.posexplode(X.injections(F.col("xml"))).alias("place", "required_ref"))
    both = held.join(edges.select("doc_id", "src", "place", "linkend"), ["doc_id", "src", "place"], "left")
    return both.select("doc_id", "src", "store_id", "linkend", "required_ref", F.col("linkend").isNotNull().alias("fits"))


def conflicts(constraints: DataFrame) -> DataFrame:
    """(topic_key, store_id) of candidates of which one target is required to be two things."""
    return constraints.groupBy("topic_key", "store_id", "target_xml_id").agg(F.countDistinct("required_ref").alias("n")).where("n > 1").select("topic_key", "store_id").distinct()


def _closure(edges: DataFrame) -> DataFrame:
    """(root, path, depth) for all that each path reaches and the fewest steps to it.

    Lengths double: what lies between m and 2m steps away is what lies up to m steps behind the nodes at exactly m. So
    rounds are few and what is known is compared with what is new once for each doubling.
    """
    found, m = held(edges.select(F.col("path").alias("root"), F.col("child").alias("path"), F.lit(1).alias("depth"))), 1
    while not (far := found.where(F.col("depth") == m)).isEmpty():
        behind = found.select(F.col("root").alias("via"), "path", F.col("depth").alias("more"))
        step = far.select("root", F.col("path").alias("via")).join(behind, "via").groupBy("root", "path").agg((F.min("more") + m).alias("depth"))
        found, m = found.unionByName(held(step.join(found, ["root", "path"], "left_anti"))), m * 2
    return found


def _met(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, path) where a trail from a start meets a path that it already holds. Only for edges within groups that reach each other."""
    trails = held(starts.select("start", F.col("start").alias("path"), F.array("start").alias("trail")))
    met = trails.select("start", "path").limit(0)
    while not trails.isEmpty():
        step = held(trails.join(edges, "path").select("start", "child", "trail", F.array_contains("trail", F.col("child")).alias("meets")))
        met = met.unionByName(step.where("meets").select("start", F.col("child").alias("path")).distinct())
        trails = step.where("NOT meets").select("start", F.col("child").alias("path"), F.array_append("trail", F.col("child")).alias("trail"))
    return met.distinct()


def include_closure(spark: SparkSession, includes: DataFrame) -> DataFrame:
    """includes(path, child) to (root, path, depth, cyclic): all that a file reaches; a path that meets itself is cyclic and goes no further.

    Depth has no bound. Trails are followed only inside groups of files that reach each other, since no circle leaves its group.
    """
    edges = held(includes.where("path IS NOT NULL").select("path", "child").distinct())
    found = _closure(edges)
    circles = found.where("root = path").select("path")
    if circles.isEmpty():
        return found.withColumn("cyclic", F.lit(False))
    back = found.select(F.col("root").alias("path"), F.col("path").alias("root"))
    group = held(found.select("root", "path").join(back, ["root", "path"]).groupBy("root").agg(F.min("path").alias("group")).withColumnRenamed("root", "node"))
    tied = edges.join(group.select(F.col("node").alias("path"), F.col("group").alias("from")), "path", "left").join(group.select(F.col("node").alias("child"), F.col("group").alias("to")), "child")
    within = held(tied.where("from = to").select("path", "child"))
    # Where a root enters a group: at itself, or by an edge from outside that it reaches.
    doors = tied.where("NOT from <=> to").select("path", F.col("child").alias("start"))
    reach = found.select("root", "path").unionByName(edges.select(F.col("path").alias("root"), "path").distinct())
    enters = held(reach.join(doors, "path").select("root", "start").unionByName(group.select(F.col("node").alias("root"), F.col("node").alias("start"))).distinct())
    met = enters.join(_met(within, enters.select("start").distinct()), "start").select("root", "path").distinct().withColumn("met", F.lit(True))
    return found.join(met, ["root", "path"], "left").select("root", "path", "depth", F.coalesce("met", F.lit(False)).alias("cyclic"))


# Consistent reuse. A candidate is a topic with an id that it might take; it may require ids of other topics.

#: Books of more rows than this are cut into connected parts, and parts of more rows are resolved by joins.
SMALL = 2000


def _network(start, edges):
    """What must hold if ``start`` = (topic, id) holds: a dict topic -> id, or None if that can't be."""
    net, todo = {}, [start]
    while todo:
        topic, store = todo.pop()
        if net.get(topic, store) != store:
            return None
        if topic in net:
            continue
        if (own := edges.get((topic, store))) is None:
            return None
        net[topic] = store
        todo += own
    return net


def choose(rows: list[tuple[int, int, int | None, int | None, bool]]) -> list[tuple[int, int | None]]:
    """One part's (topic, id or None) from rows (topic, id, required topic, required id, met): commit the largest consistent network, again and again; ties go to the lowest topic, then id.

    met is false where a requirement can't be met by any topic, true where there is none or it holds already.
    """
    edges: dict = {}
    topics, wanting, broken, least = set(), set(), set(), {}
    for topic, store, dst, ref, met in rows:
        own = edges.setdefault((topic, store), [])
        topics.add(topic)
        least[topic] = min(store, least.get(topic, store))
        if not met:
            broken.add((topic, store))
            wanting.add(topic)
        elif dst is not None:
            wanting.add(topic)
            if dst >= 0:
                own.append((dst, ref))
    for c in broken:
        del edges[c]
    fixed: dict = {}
    # Each candidate's network is followed once; what has been committed only rules networks out.
    open_ = [(c[0], net) for c in sorted(edges) if c[0] in wanting and (net := _network(c, edges))]
    while open_ := [(t, net) for t, net in open_ if t not in fixed and all(fixed.get(k, v) == v for k, v in net.items())]:
        fixed |= max(open_, key=lambda x: len(x[1]))[1]
    return [(t, fixed[t] if t in fixed else None if t in wanting else least[t]) for t in sorted(topics)]


_CHOSEN = "component long, topic_seq long, store_id long"


def _choose_many(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Part after part of rows that come sorted by component and part."""
    now, rows, out = None, [], []

    def done():
        if rows:
            out.extend((now[0], t, s) for t, s in choose(rows))

    for frame in frames:
        columns = [frame[c].astype(object).where(frame[c].notna(), None) for c in ("component", "part", "topic_seq", "store_id", "dst", "ref", "met")]
        for component, part, *row in zip(*columns, strict=True):
            if (component, part) != now:
                done()
                now, rows = (component, part), []
            rows.append(tuple(row))
        if len(out) > 10_000:
            yield pd.DataFrame(out, columns=["component", "topic_seq", "store_id"]).astype({"store_id": "Int64"})
            out = []
    done()
    yield pd.DataFrame(out, columns=["component", "topic_seq", "store_id"]).astype({"store_id": "Int64"})


def connected(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes(component, node) with ``part``: the least node that edges(component, a, b) join it with, in rounds.

    Labels fall to the least around, then to their label's own label, so long chains take about the logarithm of their length.
    """
    both = held(edges.select("component", "a", "b").unionByName(edges.select("component", F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = held(nodes.select("component", "node", F.col("node").alias("part")).distinct(), "labels")
    while True:
        near = both.join(labels.select("component", F.col("node").alias("b"), F.col("part").alias("p")), ["component", "b"]).groupBy("component", F.col("a").alias("node")).agg(F.min("p").alias("near"))
        low = labels.join(near, ["component", "node"], "left").select("component", "node", F.least("part", F.coalesce("near", "part")).alias("low"), F.col("part").alias("was"))
        jump = labels.select("component", F.col("node").alias("low"), F.col("part").alias("further"))
        new = held(low.join(jump, ["component", "low"]).select("component", "node", F.least("low", "further").alias("part"), (F.least("low", "further") != F.col("was")).alias("moved")), "labels")
        moved = not new.where("moved").isEmpty()
        drop_held(labels)
        labels = new.select("component", "node", "part")
        if not moved:
            drop_held(both)
            return labels


_CAND = ["component", "t", "s"]


def _as_target(df: DataFrame) -> DataFrame:
    return df.select("component", F.col("t").alias("dt"), F.col("s").alias("ds")).distinct()


def _prune(cand: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidates left when all go that require one that is not there, however far away, and the edges between them: what goes in one round is looked for in the next only."""
    gone = edges.join(_as_target(cand), ["component", "dt", "ds"], "left_anti").select(*_CAND).distinct()
    while True:
        gone = held(gone, "gone")
        if gone.isEmpty():
            drop_held(gone)
            return cand, edges
        fewer = held(cand.join(gone, _CAND, "left_anti"), "cand")
        rest = held(edges.join(gone, _CAND, "left_anti"), "edges")
        new = held(rest.join(_as_target(gone), ["component", "dt", "ds"], "left_semi").select(*_CAND).distinct(), "gone")
        drop_held(gone, cand, edges)
        cand, edges, gone = fewer, rest, new


def _roots(cand: DataFrame, edges: DataFrame) -> DataFrame:
    """Candidates from whose networks those of all others are parts: those that none requires, and one of each circle.

    Every other points to the least that requires it. Pointers are doubled; who points to one that none requires, or to one that
    did, is followed no further, so that what stays are circles and what they require, each with the least of its circle.
    """
    over = held(edges.groupBy("component", F.col("dt").alias("t"), F.col("ds").alias("s")).agg(F.min(F.struct(F.col("t"), F.col("s"))).alias("p")), "required")
    starts = cand.join(over, _CAND, "left_anti").select(*_CAND)
    at = held(cand.join(over, _CAND).select(*_CAND, F.col("p.t").alias("ut"), F.col("p.s").alias("us"), F.least(F.col("p"), F.struct("t", "s")).alias("low")), "pointers")
    span = 1
    while span <= at.count():
        far = at.select("component", F.col("t").alias("ut"), F.col("s").alias("us"), F.col("ut").alias("vt"), F.col("us").alias("vs"), F.col("low").alias("far"))
        new = held(at.join(far, ["component", "ut", "us"]).select(*_CAND, F.col("vt").alias("ut"), F.col("vs").alias("us"), F.least("low", "far").alias("low")), "pointers")
        drop_held(at)
        at, span = new, span * 2
    ends = at.select("component", F.col("ut").alias("t"), F.col("us").alias("s")).distinct()
    circles = at.join(ends, _CAND, "left_semi").select("component", F.col("low.t").alias("t"), F.col("low.s").alias("s"))
    found = held(starts.unionByName(circles).distinct(), "roots")
    drop_held(at, over)
    return found


def _networks(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, rt, rs, t, s): all that each root requires, itself included; each round follows what the last one found."""
    new = held(roots.select("component", F.col("t").alias("rt"), F.col("s").alias("rs"), "t", "s"), "nets")
    found, parts = new, [new]
    while not new.isEmpty():
        step = new.join(edges, _CAND).select("component", "rt", "rs", F.col("dt").alias("t"), F.col("ds").alias("s")).distinct()
        new = held(step.join(found, ["component", "rt", "rs", "t", "s"], "left_anti"), "nets")
        found = found.unionByName(new)
        parts.append(new)
    out = held(found, "nets")
    drop_held(*parts)
    return out


def _undisputed(nets: DataFrame) -> DataFrame:
    """(component, rt, rs) of the networks before all others that want a topic of theirs as something else or hold their root. nets(component, rt, rs, t, s, rank)."""
    by_id = nets.groupBy("component", "t", "s").agg(F.max("rank").alias("best"))
    ranked = by_id.withColumn("k", F.row_number().over(Window.partitionBy("component", "t").orderBy(F.desc("best"))))
    top = ranked.groupBy("component", "t").agg(F.max(F.when(F.col("k") == 1, F.struct("s", "best"))).alias("one"), F.max(F.when(F.col("k") == 2, F.col("best"))).alias("two"))
    rival = F.when(F.col("one.s") == F.col("s"), F.col("two")).otherwise(F.col("one.best"))
    met = nets.join(top, ["component", "t"]).join(by_id, ["component", "t", "s"])
    free = (rival.isNull() | (F.col("rank") > rival)) & ((F.col("t") != F.col("rt")) | (F.col("rank") >= F.col("best")))
    return met.groupBy("component", "rt", "rs").agg(F.bool_and(free).alias("free")).where("free").select("component", "rt", "rs")


def _resolve_large(rows: DataFrame) -> DataFrame:
    """What :func:`choose` does, for parts of any size, by joins.

    Networks are found for the roots only. While some contradict themselves their roots go. Then every network that none before
    it disputes is committed at once: that of the others which come first would be committed later changes nothing about them.
    """
    cand = held(rows.groupBy("component", F.col("topic_seq").alias("t"), F.col("store_id").alias("s")).agg(F.bool_and("met").alias("met"), F.bool_or(F.col("dst").isNotNull() | ~F.col("met")).alias("wants")), "all")
    topics = held(cand.groupBy("component", "t").agg(F.bool_or("wants").alias("wanting"), F.min("s").alias("least")), "topics")
    edges = held(rows.where("met AND dst >= 0").select("component", F.col("topic_seq").alias("t"), F.col("store_id").alias("s"), F.col("dst").alias("dt"), F.col("ref").alias("ds")).distinct().join(cand.where("met").select(*_CAND), _CAND, "left_semi"), "edges")
    alive = held(cand.where("met").select(*_CAND), "cand")
    fixed = held(alive.limit(0), "fixed")
    while True:
        alive, edges = _prune(alive, edges)
        free = held(alive.join(topics.where("wanting"), ["component", "t"], "left_semi").join(fixed.select("component", "t"), ["component", "t"], "left_anti"), "free")
        if free.isEmpty():
            break
        roots = _roots(free, edges.join(free, _CAND, "left_semi").join(_as_target(free), ["component", "dt", "ds"], "left_semi"))
        nets = _networks(roots, edges)
        torn = held(nets.groupBy("component", "rt", "rs", "t").agg((F.min("s") != F.max("s")).alias("torn")).where("torn").select("component", F.col("rt").alias("t"), F.col("rs").alias("s")).distinct(), "torn")
        if torn.isEmpty():
            sized = nets.join(nets.groupBy("component", "rt", "rs").agg(F.count("*").alias("n")), ["component", "rt", "rs"]).withColumn("rank", F.struct("n", (-F.col("rt")).alias("a"), (-F.col("rs")).alias("b")))
            first = _undisputed(sized)
            more = held(fixed.unionByName(nets.join(first, ["component", "rt", "rs"], "left_semi").select(*_CAND)).distinct(), "fixed")
            drop_held(fixed)
            fixed = more
            other = alive.join(fixed.select("component", "t", F.col("s").alias("taken")), ["component", "t"], "left").where("taken IS NULL OR taken = s").select(*_CAND)
        else:
            other = alive.join(torn, _CAND, "left_anti")
        fewer = held(other, "cand")
        rest = held(edges.join(fewer, _CAND, "left_semi"), "edges")
        drop_held(alive, edges, free, roots, nets, torn)
        alive, edges = fewer, rest
    chosen = topics.join(fixed, ["component", "t"], "left")
    out = held(chosen.select("component", F.col("t").alias("topic_seq"), F.coalesce("s", F.when(~F.col("wanting"), F.col("least"))).alias("store_id")), "resolved")
    drop_held(cand, topics, alive, edges, free, fixed)
    return out


def resolve(candidates: DataFrame, small: int = SMALL) -> DataFrame:
    """(component, topic_seq, status, store_id) from candidates with their requirements.

    candidates: (component, topic_seq, store_id, dst_kind, dst, dst_target, required_ref), one row for each requirement
    of a candidate, nulls for one without any. A requirement names a topic of the component and the id that it must take, or a
    container and T with its target. One without a reference, with another kind or with a reference that is no number can't be met.

    Books of up to ``small`` rows are resolved as they are, many to a batch. Larger ones are first cut into the parts that
    requirements join; parts that are still larger are resolved by joins in rounds. Rows without a topic or an id are left out.
    """
    number = F.when(F.col("required_ref").rlike("^[0-9]{1,18}$"), F.col("required_ref").cast("long"))
    none = F.col("dst_kind").isNull()
    container = F.coalesce((F.col("dst_kind") == "container") & (F.col("required_ref") == F.concat(F.lit("T"), F.col("dst_target").cast("string"))), F.lit(False))
    topic = F.coalesce((F.col("dst_kind") == "topic") & F.col("dst").isNotNull() & number.isNotNull(), F.lit(False))
    rows = candidates.where("topic_seq IS NOT NULL AND store_id IS NOT NULL").select(
        F.col("component").cast("long").alias("component"), F.col("topic_seq").cast("long").alias("topic_seq"), F.col("store_id").cast("long").alias("store_id"),
        F.when(topic, F.col("dst").cast("long")).when(~none, F.lit(-1).cast("long")).alias("dst"), F.when(topic, number).alias("ref"), (none | container | topic).alias("met"),
    )
    rows = held(rows, "candidates")
    sizes = rows.groupBy("component").agg(F.count("*").alias("n"))
    wide = held(sizes.where(F.col("n") > small).select("component"), "wide")
    many = rows.join(wide, "component", "left_anti").withColumn("part", F.lit(0).cast("long"))
    large = None
    if not wide.isEmpty():
        big = held(rows.join(wide, "component", "left_semi"), "big")
        parts = connected(big.where("dst >= 0").select("component", F.col("topic_seq").alias("a"), F.col("dst").alias("b")), big.select("component", F.col("topic_seq").alias("node")).unionByName(big.where("dst >= 0").select("component", F.col("dst").alias("node"))))
        told = held(big.join(parts.withColumnRenamed("node", "topic_seq"), ["component", "topic_seq"]), "parts")
        giants = held(told.groupBy("component", "part").agg(F.count("*").alias("n")).where(F.col("n") > small).select("component", "part"), "giants")
        many = many.unionByName(told.join(giants, ["component", "part"], "left_anti").select(*many.columns))
        if not giants.isEmpty():
            large = _resolve_large(told.join(giants, ["component", "part"], "left_semi"))
    found = many.repartition("component", "part").sortWithinPartitions("component", "part").select("component", "part", "topic_seq", "store_id", "dst", "ref", "met").mapInPandas(_choose_many, _CHOSEN)
    found = found if large is None else found.unionByName(large)
    return found.select("component", F.col("topic_seq").cast("int").alias("topic_seq"), F.when(F.col("store_id").isNull(), "NEW").otherwise("REUSED").alias("status"), "store_id")
