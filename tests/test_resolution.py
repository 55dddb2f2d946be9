"""Consistent reuse: small books, parts of large ones, and rounds of joins, against plain loops."""

import random

import pytest

from inkloom.operators import graph

SCHEMA = "component long, topic_seq int, store_id long, dst_kind string, dst long, dst_target int, required_ref string"


def random_rows(r, book):
    """Topics with a few candidates; circles, conflicts, containers and wishes that nobody can meet."""
    rows, topics = [], r.randint(1, 7)
    for t in range(topics):
        for s in range(t * 10, t * 10 + r.randint(1, 3)):
            wants = r.choice([0, 0, 1, 1, 2])
            if not wants:
                rows.append((book, t, s, None, None, None, None))
            for _ in range(wants):
                dst = r.randrange(topics)
                kind = r.random()
                if kind < 0.1:
                    rows.append((book, t, s, "container", 3, 5, r.choice(["T5", "T5", "T6", None])))
                elif kind < 0.14:
                    rows.append((book, t, s, "topic", dst, None, r.choice([None, "x", "T1", "99"])))
                elif kind < 0.16:
                    rows.append((book, t, s, "other", dst, None, "1"))
                else:
                    rows.append((book, t, s, "topic", dst, None, str(dst * 10 + r.randint(0, 1))))
    return rows


def plain(rows):
    """The largest consistent network first, written out plainly."""
    cands, needs, broken = {}, {}, set()
    for _b, t, s, kind, dst, target, ref in rows:
        cands.setdefault(t, set()).add(s)
        own = needs.setdefault((t, s), [])
        if kind == "topic" and ref and ref.isdigit():
            own.append((dst, int(ref)))
        elif kind is not None:
            own.append(None)
            if not (kind == "container" and ref == f"T{target}"):
                broken.add((t, s))

    def net(c):
        seen, todo = {}, [c]
        while todo:
            t, s = todo.pop()
            if seen.get(t, s) != s or (t, s) in broken or s not in cands.get(t, ()):
                return None
            if t not in seen:
                seen[t] = s
                todo += [x for x in needs[t, s] if x]
        return seen

    wanting = {t for (t, _), own in needs.items() if own}
    fixed = {}
    while True:
        best = None
        for t, s in sorted(needs):
            if t in wanting and t not in fixed and (n := net((t, s))) and all(fixed.get(k, v) == v for k, v in n.items()) and (best is None or len(n) > len(best)):
                best = n
        if best is None:
            return {t: fixed[t] if t in fixed else None if t in wanting else min(cands[t]) for t in cands}
        fixed |= best


@pytest.mark.parametrize("small", [graph.SMALL, 6, 0])
def test_random_books(spark, small):
    r = random.Random(11)
    books = {b: random_rows(r, b) for b in range(80 if small == graph.SMALL else 8)}
    got: dict = {}
    for x in graph.resolve(spark.createDataFrame([row for rows in books.values() for row in rows], SCHEMA), small=small).collect():
        assert x.topic_seq not in got.setdefault(x.component, {}) and x.status == ("NEW" if x.store_id is None else "REUSED")
        got[x.component][x.topic_seq] = x.store_id
    assert got == {b: plain(rows) for b, rows in books.items()}


def test_odd_tables(spark):
    assert graph.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, None, 1, None, None, None, None), (1, 1, None, None, None, None, None), (None, 1, 5, None, None, None, None), (1, 2, 4, "topic", None, None, "4"), (1, 3, 4, None, None, None, None), (1, 3, 2, None, None, None, None), (1, 3, 2, None, None, None, None)]
    got = sorted((x.component or -1, x.topic_seq, x.status, x.store_id) for x in graph.resolve(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, 1, "REUSED", 5), (1, 2, "NEW", None), (1, 3, "REUSED", 2)]


def test_connected(spark):
    nodes = spark.createDataFrame([(c, n) for c in (0, 1) for n in range(40)], "component long, node long")
    edges = spark.createDataFrame([(0, n, n + 1) for n in range(0, 38) if n != 20] + [(1, 39, 0), (1, 5, 5)], "component long, a long, b long")
    got = {(r.component, r.node): r.part for r in graph.connected(edges, nodes).collect()}
    assert got == {(0, n): 0 if n <= 20 else 21 if n <= 38 else 39 for n in range(40)} | {(1, n): 0 if n == 39 else n for n in range(40)}
