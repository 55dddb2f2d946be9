"""XPath's axes over a node table, a set of nodes at a time, by sorted sweeps within documents.

A path is a list of :class:`Step`. A node table is shuffled once, by document, for any number of paths: sets of nodes are flags
of its rows, and every step is a window within the document. No step compares nodes pair by pair: in document order the
greatest post number of the context nodes passed so far says whether a node lies below one of them, the least whether it
follows one, and alike from the end for those above and before. The k-th node on an axis is found by running counts: the
counts of a context node and of the node asked for differ by k. What a node asks of another, by number or by count, is a row
more that meets the other's in a window. Existence is tested backward, along the opposite axes. A document is one partition
of the sweeps (it was one row); nothing is as large as the square of its nodes.

The node table is that of ``markup.nodes``; its key may be any column. Null texts have no nodes.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Each axis and its opposite.
OPPOSITE = {"self": "self", "child": "parent", "parent": "child", "descendant": "ancestor", "ancestor": "descendant", "descendant-or-self": "ancestor-or-self", "ancestor-or-self": "descendant-or-self", "following": "preceding", "preceding": "following", "following-sibling": "preceding-sibling", "preceding-sibling": "following-sibling"}
LAST = -1


@dataclass(frozen=True)
class Step:
    """One step: an axis, a test (a name, *, text(), comment() or node()), a condition on the columns of the node table,
    paths that must and that mustn't lead anywhere from the node, and then its place on the axis (from 1, LAST for the last)."""

    axis: str = "child"
    test: str = "*"
    where: Column | None = None
    having: tuple[tuple[Step, ...], ...] = ()
    lacking: tuple[tuple[Step, ...], ...] = ()
    place: int | None = None


def passes(test: str) -> Column:
    inner = F.col("name").startswith("#")
    return {"*": ~inner, "node()": F.lit(True), "text()": F.col("name") == "#text", "comment()": F.col("name") == "#comment"}.get(test, F.col("name") == test)


def _end() -> Column:
    """The last node of a node's subtree, in document order."""
    return F.col("post") + F.col("depth")


class _Sheet:
    """A node table, a document to a partition, with sets of nodes as further columns, each true or false."""

    def __init__(self, table: DataFrame, key: str, steps: Sequence[Step]):
        tests, todo = {}, list(steps)
        for step in todo:
            todo += [inner for path in (*step.having, *step.lacking) for inner in path]
            test = passes(step.test) if step.where is None else passes(step.test) & step.where
            tests.setdefault((step.test, id(step.where)), test)
        names = {of: f"__test{k}" for k, of in enumerate(tests)}
        self.tests = {of: F.col(name) for of, name in names.items()}
        tasks = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # told, so that none are joined: sorted rows take far more than shuffled ones
        self.df = table.withColumns({names[of]: F.coalesce(test, F.lit(False)) for of, test in tests.items()}).repartition(tasks, key)
        self.key, self.made = key, 0

    def add(self, value: Column) -> Column:
        name, self.made = f"__set{self.made}", self.made + 1
        self.df = self.df.withColumn(name, value)
        return F.col(name)

    def over(self, *group: str, order: Column | None = None, ahead: bool = False) -> Window:
        """Rows of a document, or of a group in it; with an order, those up to a row, or those before it."""
        w = Window.partitionBy(self.key, *group)
        return w if order is None else w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1 if ahead else 0)

    def meet(self, own: Sequence[Column], asking: Column, asked: Sequence[Column], value: Column, found: Callable[[Column, list[str]], Column]) -> Column:
        """Each row that asks is there once more, in another place and with a value: found(value, place) looks at the values, null in a row's own place."""
        at = lambda place, v: F.struct(*(c.cast("long").alias(f"p{k}") for k, c in enumerate(place)), v.alias("v"))
        mine = at(own, F.lit(None).cast("long"))
        rows = F.when(asking, F.array(mine, at(asked, value.cast("long")))).otherwise(F.array(mine))
        df, name = self.df.select("*", F.explode(rows).alias("__m")), f"__set{self.made}"
        df = df.select(*self.df.columns, *(F.col(f"__m.p{k}").alias(f"__p{k}") for k in range(len(own))), F.col("__m.v").alias("__v"))
        df = df.withColumn(name, found(F.col("__v"), [f"__p{k}" for k in range(len(own))])).where("__v IS NULL")
        self.df, self.made = df.select(*self.df.columns, name), self.made + 1
        return F.col(name)

    def wanted(self, own: Sequence[Column], asking: Column, asked: Sequence[Column]) -> Column:
        """Whether any row of the document asks for a row's place."""
        return self.meet(own, asking, asked, F.lit(1), lambda v, place: F.max(v).over(self.over(*place)).isNotNull())

    def on_axis(self, axis: str, context: Column) -> Column:
        """The nodes that lie on an axis of any of the context nodes."""
        if axis == "self":
            return context
        if axis == "child":
            return self.wanted([F.col("parent_id")], context, [F.col("node_id")])
        if axis == "parent":
            return self.wanted([F.col("node_id")], context & F.col("parent_id").isNotNull(), [F.col("parent_id")])
        if axis.endswith("sibling"):
            order = F.asc("ord") if axis == "following-sibling" else F.desc("ord")
            return self.add(F.coalesce(F.max(context).over(self.over("parent_id", order=order, ahead=True)), F.lit(False)))
        order = F.asc("node_id") if axis.startswith(("descendant", "following")) else F.desc("node_id")
        under, post = axis.startswith("descendant") or axis == "preceding", F.when(context, F.col("post"))
        seen = self.add((F.max(post) if under else F.min(post)).over(self.over(order=order, ahead=True)))
        on = F.coalesce(seen > F.col("post") if under else seen < F.col("post"), F.lit(False))
        return self.add(on | context if axis.endswith("-or-self") else on)

    def fitting(self, step: Step) -> Column:
        """The nodes that pass a step's test and conditions."""
        fit = self.tests[step.test, id(step.where)]
        for path in step.having:
            fit = self.add(fit & self.leads(path))
        for path in step.lacking:
            fit = self.add(fit & ~self.leads(path))
        return fit

    def leads(self, steps: Sequence[Step]) -> Column:
        """The nodes from which a path leads anywhere: the last step's nodes, taken back along the opposite axes."""
        found = None
        for step in reversed(steps):
            if step.place is not None:
                raise ValueError("a path that is only tested has no places")
            fit = self.fitting(step)
            found = self.on_axis(OPPOSITE[step.axis], fit if found is None else fit & found)
        return found

    def placed(self, step: Step, context: Column, fit: Column) -> Column:
        """The fitting nodes that are the k-th, or last, on the axis of a context node."""
        axis, k, one = step.axis, step.place, fit.cast("int")
        if axis in ("self", "parent"):
            return self.on_axis(axis, context) & fit & F.lit(k in (1, LAST))
        if axis == "child":
            reached = self.add(self.on_axis(axis, context) & fit)
            place = self.add(F.sum(reached.cast("int")).over(self.over("parent_id", order=F.desc("ord") if k == LAST else F.asc("ord"))))
            return reached & (place == (1 if k == LAST else k))
        if axis == "preceding":
            raise ValueError("places on the preceding axis aren't counted")
        if axis.endswith("sibling"):
            run = self.add(F.sum(one).over(self.over("parent_id", order=F.asc("ord") if axis == "following-sibling" else F.desc("ord"))))
            if k == LAST:
                return self.last(fit, run, F.when(context, run), "parent_id")
            return self.wanted([F.col("parent_id"), run], context, [F.col("parent_id"), run + k]) & fit
        if axis.startswith("ancestor"):
            return self.above(step, context, fit)
        run = self.add(F.sum(one).over(self.over(order=F.asc("node_id"))))
        before = run - one if axis == "descendant-or-self" else run
        if axis.startswith("descendant") and k != LAST:  # one node has each count; it must lie in the subtree that asks for it
            end = self.meet([run], context, [before + k], _end(), lambda v, place: F.max(v).over(self.over(*place)))
            return fit & F.coalesce(end >= F.col("node_id"), F.lit(False))
        # The context nodes' counts are told to the last nodes of their subtrees.
        least = self.meet([F.col("node_id")], context, [_end()], before, lambda v, place: F.min(v).over(self.over(*place)))
        if axis.startswith("descendant"):
            return self.wanted([run], F.coalesce(least < run, F.lit(False)), [run]) & fit
        if k == LAST:
            return self.last(fit, run, F.when(least.isNotNull(), run))
        return self.wanted([run], least.isNotNull(), [run + k]) & fit

    def last(self, fit: Column, run: Column, asked: Column, *group: str) -> Column:
        """The last fitting node of a document, or group, if any node that asks has a smaller count."""
        total, least = self.add(F.max(run).over(self.over(*group))), self.add(F.min(asked).over(self.over(*group)))
        return fit & (run == total) & F.coalesce(least < total, F.lit(False))

    def above(self, step: Step, context: Column, fit: Column) -> Column:
        """The k-th fitting node above a context node: with a nodes fitting above it, it is the last one before it that has a - k above itself."""
        own, one = step.axis == "ancestor-or-self", fit.cast("int")
        closed = self.meet([F.col("node_id")], fit, [_end() + 1], F.lit(1), lambda v, place: F.coalesce(F.sum(v).over(self.over(*place)), F.lit(0)))
        opened = self.add(F.sum(one).over(self.over(order=F.asc("node_id"))) - one)
        above = self.add(opened - F.sum(closed).over(self.over(order=F.asc("node_id"))))
        most = above + one if own else above
        level = F.lit(1) if step.place == LAST else most - (step.place - 1)
        asking = context & (most >= (1 if step.place == LAST else step.place))
        line = lambda place: Window.partitionBy(self.key, place[0]).orderBy(place[1])
        return fit & self.meet([F.when(fit, above + 1), F.col("node_id") * 2], asking, [level, F.col("node_id") * 2 + int(own)], F.lit(1), lambda v, place: F.lead(v).over(line(place)).isNotNull())

    def walk(self, steps: Sequence[Step], start: Column | None = None) -> Column:
        at = start
        for step in steps:
            if step.axis not in OPPOSITE:
                raise ValueError(f"no such axis: {step.axis}")
            fit = self.fitting(step)
            if at is None:  # a document is above its root, and has no siblings
                at = fit & F.col("parent_id").isNull() if step.axis == "child" else fit if step.axis.startswith("descendant") else F.lit(False)
                if step.place is not None:
                    run = self.add(F.sum(at.cast("int")).over(self.over(order=F.desc("node_id") if step.place == LAST else F.asc("node_id"))))
                    at = at & (run == (1 if step.place == LAST else step.place))
            elif step.place is not None:
                at = self.placed(step, at, fit)
            else:
                at = self.on_axis(step.axis, at) & fit
            at = self.add(at)
        return F.lit(False) if at is None else at


def walk(table: DataFrame, key: str, steps: Sequence[Step], start: DataFrame | None = None) -> DataFrame:
    """The rows of a node table that a path reaches from start (rows of it), each once; without start, from the documents themselves."""
    if start is not None:
        table = table.join(start.select(key, "node_id", F.lit(True).alias("__start")).distinct(), [key, "node_id"], "left").withColumn("__start", F.coalesce("__start", F.lit(False)))
    sheet = _Sheet(table, key, steps)
    at = sheet.walk(steps, None if start is None else F.col("__start"))
    return sheet.df.where(at).select(*(c for c in table.columns if c != "__start"))


def reached(table: DataFrame, key: str, paths: Mapping[str, Sequence[Sequence[Step]]]) -> DataFrame:
    """A node table with the names of the paths, each a union of one or more, that reach a row from its document: an array, in the paths' order."""
    sheet = _Sheet(table, key, [step for several in paths.values() for steps in several for step in steps])
    names = F.array()
    for name, several in paths.items():
        on = reduce(or_, (sheet.walk(steps) for steps in several))
        names = sheet.add(F.when(on, F.array_append(names, F.lit(name))).otherwise(names))
    return sheet.df.select(*table.columns, names.cast("array<string>").alias("paths"))


def attributes(context: DataFrame, key: str, name: str | None = None) -> DataFrame:
    """The attribute axis: (key, node_id, name, value) of the nodes' attributes. Declarations of namespaces are attributes where the parser keeps them (HTML)."""
    rows = context.where("attrs IS NOT NULL").select(key, "node_id", F.explode("attrs").alias("name", "value"))
    return rows if name is None else rows.where(F.col("name") == name)


def string_values(table: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """(key, node_id, value): all text in the subtree of each node found, in order."""
    table = table.select(key, "node_id", "post", "name", "text")
    marked = table.join(found.select(key, "node_id", F.lit(True).alias("__f")).distinct(), [key, "node_id"], "left")
    return with_values(marked, key, F.coalesce("__f", F.lit(False)))


def with_values(table: DataFrame, key: str, found: Column, *kept: str) -> DataFrame:
    """(key, node_id, columns kept, value) of the rows found in a node table: value is all text in the node's subtree, in order.

    Texts are numbered in document order; those of a subtree have neighbouring numbers, the last of which is the number of
    texts up to the node by post number, as a text is above none. Each found node is laid beside its own texts by number.
    """
    own, of = (F.col("name") == "#text").cast("int"), lambda order: Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = table.select(key, "node_id", "post", own.alias("__own"), F.when(own == 1, F.col("text")).alias("__text"), found.alias("__found"), F.when(found, F.struct(*kept)).alias("__kept") if kept else F.lit(None).alias("__kept"))
    run = run.withColumn("__r", F.sum("__own").over(of("node_id"))).withColumn("__upto", F.sum("__own").over(of("post")))
    before = F.col("__r") - F.col("__own")
    asks = F.when(F.col("__found") & (F.col("__upto") > before), F.sequence(before + 1, "__upto")).otherwise(F.array().cast("array<bigint>"))
    row = lambda r, text, node, kept: F.struct(r.alias("r"), text.alias("text"), node.alias("node"), kept.alias("kept"))
    none = lambda c: F.lit(None).cast(run.schema[c].dataType)
    rows = F.concat(
        F.when(F.col("__own") == 1, F.array(row(F.col("__r"), F.col("__text"), none("node_id"), none("__kept")))).otherwise(F.array()),
        F.when(F.col("__found"), F.array(row(F.lit(None).cast("long"), none("__text"), F.col("node_id"), F.col("__kept")))).otherwise(F.array()),
        F.transform(asks, lambda r: row(r, none("__text"), F.col("node_id"), none("__kept"))),
    )
    each = run.select(key, F.explode(rows).alias("__e")).select(key, "__e.*")
    each = each.withColumn("text", F.max("text").over(Window.partitionBy(key, "r"))).where("node IS NOT NULL")
    value = F.array_sort(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("r", "text"))))
    out = each.groupBy(key, F.col("node").alias("node_id")).agg(F.array_join(F.transform(value, lambda x: x["text"]), "").alias("value"), F.first("kept", ignorenulls=True).alias("kept"))
    return out.select(key, "node_id", *(F.col("kept")[c].alias(c) for c in kept), "value")


def union(*found: DataFrame, key: str) -> DataFrame:
    """Node sets as one, each node once, in no order."""
    out = found[0]
    for other in found[1:]:
        out = out.unionByName(other)
    return out.dropDuplicates([key, "node_id"])
