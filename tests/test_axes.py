"""The axes against plain loops over random trees."""

import random

import pytest
from pyspark.sql import functions as F

from inkloom.operators import axes, markup
from inkloom.operators.axes import LAST, OPPOSITE, Step

TREES = 6


def random_tree(r, n):
    """XML of n nested elements a, b and c with some texts."""
    kids = {0: []}
    for k in range(1, n):
        parent = r.randrange(max(0, k - 4), k)
        kids.setdefault(parent, []).append(k)
        kids[k] = []
    write = lambda k: f"<{'abc'[k % 3]} i='{k}'{' x=' + chr(34) + '1' + chr(34) if k % 4 == 0 else ''}>{'t%d' % k if k % 5 == 0 else ''}{''.join(map(write, kids[k]))}</{'abc'[k % 3]}>"
    return write(0)


@pytest.fixture(scope="module")
def trees(spark):
    r = random.Random(4)
    docs = [(d, random_tree(r, r.randint(1, 30))) for d in range(TREES)] + [(90, None), (91, "<a"), (92, "<a/>")]
    table = markup.nodes(spark.createDataFrame(docs, "doc long, xml string"), "doc", "xml", xml=True).cache()
    return table, table.collect()


def plain(rows, axis, c):
    """The nodes on an axis of c, nearest first."""
    own = [n for n in rows if n.doc == c.doc]
    under = lambda a, b: b.node_id > a.node_id and b.post < a.post
    sibling = lambda n: n.parent_id == c.parent_id and n.parent_id is not None
    found = {
        "self": [c],
        "child": [n for n in own if n.parent_id == c.node_id],
        "parent": [n for n in own if n.node_id == c.parent_id],
        "descendant": [n for n in own if under(c, n)],
        "ancestor": [n for n in own if under(n, c)],
        "descendant-or-self": [c, *(n for n in own if under(c, n))],
        "ancestor-or-self": [c, *(n for n in own if under(n, c))],
        "following": [n for n in own if n.node_id > c.node_id and n.post > c.post],
        "preceding": [n for n in own if n.node_id < c.node_id and n.post < c.post],
        "following-sibling": [n for n in own if sibling(n) and n.ord > c.ord],
        "preceding-sibling": [n for n in own if sibling(n) and n.ord < c.ord],
    }[axis]
    return sorted(found, key=lambda n: n.node_id, reverse=axis.startswith(("ancestor", "preceding")))


def ids(df):
    return sorted((r.doc, r.node_id) for r in df.select("doc", "node_id").collect())


@pytest.mark.parametrize("axis", sorted(OPPOSITE))
@pytest.mark.parametrize("place", [None, 1, 2, LAST])
def test_axis(trees, axis, place):
    table, rows = trees
    if axis == "preceding" and place is not None:
        with pytest.raises(ValueError):
            axes.walk(table, "doc", [Step("descendant", "b"), Step(axis, "a", place=place)])
        return
    context = [n for n in rows if n.name == "b"]
    want = set()
    for c in context:
        fit = [n for n in plain(rows, axis, c) if n.name in "ac"]
        picked = fit if place is None else fit[place - 1 : place] if place > 0 else fit[-1:]
        want |= {(n.doc, n.node_id) for n in picked}
    got = axes.walk(table, "doc", [Step("descendant", "b"), Step(axis, where=F.col("name") != "b", place=place)])
    assert got.columns == table.columns and ids(got) == sorted(want)


def test_predicates_values_and_unions(trees):
    table, rows = trees
    having = axes.walk(table, "doc", [Step("descendant", "a", having=((Step("child", "b"), Step("following", "c")),), lacking=((Step("ancestor", "c"),),))])
    by = lambda axis, c, name: [n for n in plain(rows, axis, c) if n.name == name]
    want = [n for n in rows if n.name == "a" and any(by("following", x, "c") for x in by("child", n, "b")) and not by("ancestor", n, "c")]
    assert ids(having) == sorted((n.doc, n.node_id) for n in want)
    text = axes.walk(table, "doc", [Step("descendant", having=((Step("child", "text()", where=F.col("text") == "t5"),),))])
    assert {(r.doc, r.attrs["i"]) for r in text.collect()} <= {(n.doc, "5") for n in rows}
    values = {(r.doc, r.node_id): r.value for r in axes.string_values(table, "doc", table.where("name = 'c'")).collect()}
    assert values == {(n.doc, n.node_id): "".join(x.text for x in plain(rows, "descendant", n) if x.name == "#text") for n in rows if n.name == "c"}
    both = axes.union(axes.walk(table, "doc", [Step("descendant", "a")]), axes.walk(table, "doc", [Step("descendant", "*", where=F.col("attrs")["x"] == "1")]), key="doc")
    assert ids(both) == sorted((n.doc, n.node_id) for n in rows if n.name == "a" or n.attrs and "x" in n.attrs)
    named = axes.attributes(table.where("name = 'a'"), "doc", "x").collect()
    assert {(r.doc, r.node_id) for r in named} == {(n.doc, n.node_id) for n in rows if n.name == "a" and "x" in n.attrs} and {r.value for r in named} <= {"1"}


def test_odd_paths(trees):
    table, _ = trees
    assert axes.walk(table, "doc", []).count() == 0
    assert axes.walk(table, "doc", [Step("child", "none"), Step("ancestor")]).count() == 0
    assert axes.walk(table, "doc", [Step("following")]).count() == 0
    with pytest.raises(ValueError):
        axes.walk(table, "doc", [Step("sideways")])
    with pytest.raises(ValueError):
        axes.walk(table, "doc", [Step("child", having=((Step("child", place=1),),))])
    assert ids(axes.walk(table, "doc", [Step("child")])) == [(d, 0) for d in [*range(TREES), 92]]
