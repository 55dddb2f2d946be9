"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate as they should.

A conversation is a path through (row, state) nodes, where states say what the roles so far spell of ``(s?(ua)+)?``.
Arcs keep, rerole or delete a row, or insert one. Minimum costs backward from the end and forward from the start say for
every arc whether it lies on a cheapest path (it is tight); a walk with the set of nodes that the letters so far can
reach takes the least letter of all tight arcs at each step, so the letters are the least among all cheapest edits.
Costs are kept relative to their least. Such vectors are few, so both passes are table lookups, and a row needs two bytes (seven with its code, letter and role).

Texts are shuffled once. What the edits depend on (a row's role, its fault) is found on rows without their texts:
equal rows are summed before they are shuffled, and repeats are found by a join on the digest of role and text, which
Spark may split where one digest is frequent. Both kinds of rows are then sorted by conversation, the short ones first,
and read as a stream: the short rows give the edits, the texts are edited and hashed as they pass. A conversation's
hash and audit are one value each and its rows pass through one task, but never lie in memory.

Rows are taken by turn (nulls first), then role, then the text's first 64 characters, then its digest. A null role or text is
one space, a null conversation is one of its own. Equal rows all count. A role without a first letter fits no place. An
empty table gives an empty one; further columns don't matter.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import crc32_sql, table

SOLID = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
OK, BLANK, DUPLICATE, TRUNCATED = range(4)
KEEP, REROLE, DELETE, INSERT, LEFT_TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 20
#: States: nothing yet, after s, after u, after a; the next state by the letter s, u, a (any other fits nowhere).
NEXT = ((1, 2, None), (None, 2, None), (None, None, 3), (None, 2, None))
ENDS = (0, 3)
ROLES = {1: "user", 2: "assistant"}


def _arcs(code: int) -> list[tuple[int, str, int, int, int]]:
    """(cost, letter, from, to, new letter's number) of a row; its code is 4 * fault + number of its role's letter."""
    fault, letter = divmod(code, 4)
    out = [(DELETE, "D", q, q, 0) for q in range(4)]
    if fault in (OK, TRUNCATED):
        more = LEFT_TRUNCATED if fault == TRUNCATED else 0
        for q in range(4):
            if letter < 3 and NEXT[q][letter] is not None:
                out.append((KEEP + more, "K", q, NEXT[q][letter], 0))
            out += [(REROLE + more, "R", q, NEXT[q][x], x) for x in (1, 2) if NEXT[q][x] is not None]
    return out


_ARCS = [_arcs(code) for code in range(16)]
_INSERTS = [(INSERT, "I", q, NEXT[q][x], x) for q in range(4) for x in (1, 2) if NEXT[q][x] is not None]


class Repair:
    """Solves conversations given as codes; what it has worked out for a few vectors serves all rows."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple, tuple[int, int]] = {}
        self.moves: dict[tuple, tuple] = {}
        self.last, _ = self._number([0 if q in ENDS else FAR for q in range(4)], backward=True)
        self.first, _ = self._number([0 if q == 0 else FAR for q in range(4)], backward=False)

    def _number(self, cost: list[int], backward: bool) -> tuple[int, int]:
        """Costs with inserts at this place, as a vector's number and the cost that all of it has."""
        for _ in range(2):  # no cheapest path inserts more than two in a row without having come to all states
            for c, _letter, q, to, _x in _INSERTS:
                a, b = (q, to) if backward else (to, q)
                cost[a] = min(cost[a], cost[b] + c)
        least = min(cost)
        key = tuple(min(c - least, FAR) for c in cost)
        if key not in self.numbers:
            self.numbers[key] = len(self.vectors)
            self.vectors.append(key)
        return self.numbers[key], least

    def step(self, vector: int, code: int, backward: bool) -> tuple[int, int]:
        """The vector beyond a row, and how much dearer it is."""
        if (key := (vector, code, backward)) not in self.steps:
            have, cost = self.vectors[vector], [FAR] * 4
            for c, _letter, q, to, _x in _ARCS[code]:
                a, b = (q, to) if backward else (to, q)
                cost[a] = min(cost[a], have[b] + c)
            self.steps[key] = self._number(cost, backward)
        return self.steps[key]

    def move(self, forward: int, here: int, beyond: int, code: int, nodes: int) -> tuple[str, list[int], int]:
        """From a set of nodes before a row to that behind it: the letters of the steps, their roles' numbers, the set. Code -1: the end."""
        if (key := (forward, here, beyond, code, nodes)) not in self.moves:
            f, b, after = self.vectors[forward], self.vectors[here], self.vectors[beyond]
            node = min(x + y for x, y in zip(f, b, strict=True))
            inserts = [(letter, q, to, x, False) for c, letter, q, to, x in _INSERTS if f[q] + c + b[to] == node]
            rows = []
            if code >= 0:
                edge = min(f[q] + c + after[to] for c, _l, q, to, _x in _ARCS[code])
                rows = [(letter, q, to, x, True) for c, letter, q, to, x in _ARCS[code] if f[q] + c + after[to] == edge]
            letters, roles, at = "", [], {q for q in range(4) if nodes >> q & 1}
            while code >= 0 or not any(f[q] == node for q in at.intersection(ENDS)):
                tight = [arc for arc in [*rows, *inserts] if arc[1] in at]
                least = min(arc[0] for arc in tight)
                taken = [arc for arc in tight if arc[0] == least]
                letters, at = letters + least, {arc[2] for arc in taken}
                roles.append(taken[0][3])  # states tell roles apart, so all taken arcs have one
                if taken[0][4]:
                    break
            self.moves[key] = letters, roles, sum(1 << q for q in at)
        return self.moves[key]

    def solve(self, codes: bytes) -> tuple[int, str, bytes]:
        """Least cost, the least letters of all edits that cost so much, and for each letter the number of its new role, or 0."""
        back, vector, cost = array("H", [self.last]), self.last, 0
        for code in reversed(codes):
            vector, more = self.step(vector, code, True)
            cost += more
            back.append(vector)
        cost += self.vectors[vector][0]
        nodes, forward, letters, roles = 1, self.first, bytearray(), bytearray()
        for i, code in enumerate(codes):
            said, new, nodes = self.move(forward, back[-1 - i], back[-2 - i], code, nodes)
            letters += said.encode()
            roles += bytes(new)
            forward, _ = self.step(forward, code, False)
        said, new, nodes = self.move(forward, back[0], back[0], -1, nodes)
        return cost, letters.decode() + said, bytes(roles) + bytes(new)


#: Neighbours su, ua and au.
LEGAL = (b"\0\1", b"\1\2", b"\2\1")
SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Conversation:
    """One conversation as its rows pass: short ones first, then texts."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.codes = conv_id, bytearray()
        self.least = self.most = self.turn = None
        self.turns = 0
        self.audit, self.cost = None, 0

    def short(self, turn: int | None, code: int, times: int) -> None:
        self.codes.append(code)
        if times > 1:
            again = code if code // 4 == BLANK else 4 * DUPLICATE + code % 4
            self.codes += bytes([again]) * (times - 1)
        if turn is not None and turn != self.turn:
            self.turn, self.most = turn, turn
            self.least = turn if self.least is None else self.least
            self.turns += 1

    def _begin(self, repair: Repair) -> None:
        self.cost, self.audit, self.roles = repair.solve(bytes(self.codes))
        self.hash, self.at, self.lines = hashlib.sha256(), 0, 0

    def _line(self, role: str, text: str) -> None:
        self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
        self.lines += 1

    def _insert(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self._line(ROLES[self.roles[self.at]], "")
            self.at += 1

    def text(self, role: str, text: str, times: int, repair: Repair) -> None:
        if self.audit is None:
            self._begin(repair)
        for _ in range(times):
            self._insert()
            if (letter := self.audit[self.at]) != "D":
                self._line(role if letter == "K" else ROLES[self.roles[self.at]], text)
            self.at += 1

    def row(self, repair: Repair) -> dict:
        if self.audit is None:
            self._begin(repair)
        self._insert()
        faults = [0] * 4
        for code in range(16):
            faults[code // 4] += self.codes.count(code)
        kinds = self.codes.translate(bytes(i % 4 for i in range(256)))
        illegal = max(0, len(kinds) - 1) - sum(kinds.count(pair) for pair in LEGAL)
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return {"conv_id": self.conv_id, "gaps": gaps, "blank": faults[BLANK], "duplicate": faults[DUPLICATE], "truncated": faults[TRUNCATED], "illegal": illegal, "cost": self.cost, "audit": self.audit, "repaired_sha256": self.hash.hexdigest()}


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (c.split() for c in SCHEMA.split(", "))])
    repair, now, done = Repair(), None, []
    for batch in batches:
        for conv_id, kind, turn, role, text, code, times in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "turn", "role", "text", "code", "times")), strict=True):
            if kind == 0:  # each conversation has one such row, its first
                if now is not None:
                    done.append(now.row(repair))
                now = _Conversation(conv_id)
            elif kind == 1:
                now.short(turn, code, times)
            else:
                now.text(role, text, times, repair)
        if len(done) >= 1000:
            yield pa.RecordBatch.from_pylist(done, schema)
            done = []
    if now is not None:
        yield pa.RecordBatch.from_pylist([*done, now.row(repair)], schema)


def repair(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for each conversation of ``conversations`` (conv_id), with the faults of its ``rows`` and their cheapest repair.

    rows: conv_id, turn, role, text, times (a row stands for so many equal neighbours); role and text are not null.
    """
    start = F.substring("role", 1, 1)
    letter = F.when(start == "s", 0).when(start == "u", 1).when(start == "a", 2).otherwise(3)
    fault = F.when(~F.col("text").rlike(SOLID), BLANK).when(~F.col("text").rlike(ENDED), TRUNCATED).otherwise(OK)
    named = rows.select("conv_id", "turn", "role", "text", "times", F.substring("text", 1, 64).alias("head"), F.md5("text").alias("digest"))
    keys = ["conv_id", "turn", "role", "head", "digest"]
    short = named.groupBy(*keys, fault.alias("fault"), letter.alias("letter")).agg(F.sum("times").cast("int").alias("times"))
    seen = short.where(F.col("fault") != BLANK).groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("k")).where("k > 1")
    paired = short.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    again = (F.col("fault") != BLANK) & F.col("k").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    coded = paired.select(*keys, (F.when(again, DUPLICATE).otherwise(F.col("fault")) * 4 + F.col("letter")).alias("code"), "times", F.lit(1).alias("kind"))
    heads = conversations.select("conv_id").distinct().withColumn("kind", F.lit(0))
    texts = named.withColumn("kind", F.lit(2))
    both = texts.unionByName(coded, allowMissingColumns=True).unionByName(heads, allowMissingColumns=True)
    order = ["conv_id", "kind", "turn", "role", "head", "digest"]
    return both.repartition("conv_id").sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in order)).select("conv_id", "kind", "turn", "role", "text", "code", "times").mapInArrow(_stream, SCHEMA)


def _or_space(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows as :func:`repair` takes them, some of them spoilt by the checksum of their conversation and turn."""
    role, text = _or_space(F.col("role")), _or_space(F.col("text"))
    what = F.crc32(F.concat(_or_space(F.col("conv_id")), F.lit(":"), _or_space(F.col("turn"))).cast("binary")) % 20
    kept = conversations.where(what != 0)
    spoilt = F.when(what == 1, F.lit("")).when(what == 2, F.translate(text, ".!?", "")).otherwise(text)
    return kept.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(what == 4, F.lit("user")).otherwise(role).alias("role"), spoilt.alias("text"), F.when(what == 3, 2).otherwise(1).alias("times"))


def op13_turn_repair(spark, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair(damage(conversations), conversations)


def op13_sql() -> str:
    """The cheapest edits of each conversation from its last row to its first, as (cost, audit, lines) for each state."""
    keep = lambda to: f"{{'c': b{to}.c + 5 * (fault = 3)::BIGINT, 'a': 'K' || b{to}.a, 't': [role || ':' || text] || b{to}.t}}"
    rerole = lambda to, role: f"{{'c': b{to}.c + 1 + 5 * (fault = 3)::BIGINT, 'a': 'R' || b{to}.a, 't': ['{role}:' || text] || b{to}.t}}"
    drop = lambda q: f"{{'c': b{q}.c + 2, 'a': 'D' || b{q}.a, 't': b{q}.t}}"
    insert = lambda to, role: f"{{'c': {to}.c + 5, 'a': 'I' || {to}.a, 't': ['{role}:'] || {to}.t}}"
    on = lambda letter, to: f"CASE WHEN fault IN (0, 3) AND letter = '{letter}' THEN {keep(to)} END"
    may = lambda arc: f"CASE WHEN fault IN (0, 3) THEN {arc} END"
    row = {0: [on("s", 1), on("u", 2), may(rerole(2, "user"))], 1: [on("u", 2), may(rerole(2, "user"))], 2: [on("a", 3), may(rerole(3, "assistant"))], 3: [on("u", 2), may(rerole(2, "user"))]}
    moved = ", ".join(f"list_min([{', '.join([drop(q), *arcs])}]) AS x{q}" for q, arcs in row.items())
    nothing = "{'c': 0::BIGINT, 'a': '', 't': []::VARCHAR[]}"
    return rf"""
WITH RECURSIVE d AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS what FROM conversations),
e AS (SELECT conv_id, turn, CASE WHEN what = 4 THEN 'user' ELSE role END AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
      FROM d, (VALUES (1), (2)) AS copies(k) WHERE what <> 0 AND (k = 1 OR what = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), md5(text)) AS i, count(*) OVER (PARTITION BY conv_id) AS n, left(role, 1) AS letter FROM e),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM o),
f AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 3 ELSE 0 END AS fault,
             i > 1 AND lag(letter) OVER (PARTITION BY conv_id ORDER BY i) || letter NOT IN ('su', 'ua', 'au') AS illegal FROM p),
b AS (SELECT conv_id, n + 1 AS i, {nothing} AS b0, {insert("x", "user").replace("x.", "y.")} AS b1, y AS b2, {nothing} AS b3
      FROM (SELECT DISTINCT conv_id, n, {insert("z", "assistant").replace("z.c", "0::BIGINT").replace("z.a", "''").replace("z.t", "[]::VARCHAR[]")} AS y FROM f)
      UNION ALL
      SELECT conv_id, i, list_min([x0, {insert("x2", "user")}, {insert("y2", "user")}]) AS b0, list_min([x1, {insert("x2", "user")}, {insert("y2", "user")}]) AS b1,
             list_min([x2, y2]) AS b2, list_min([x3, {insert("x2", "user")}]) AS b3
      FROM (SELECT *, {insert("x3", "assistant")} AS y2 FROM (SELECT f.conv_id, f.i, {moved} FROM f JOIN b ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i - 1))),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
             count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY conv_id)
SELECT h.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(b0.c, 0) AS cost, coalesce(b0.a, '') AS audit, sha256(coalesce(array_to_string(b0.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS h LEFT JOIN s ON h.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN b ON h.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = 1
"""
