"""Perspective rotation of multi-party dialogues, in DataFrame functions only.

For every participant of a conversation the whole dialogue is rendered with that participant as the assistant, all
others as named users, and the spans of the assistant's words marked for the loss. Instruction roles (``system``) are
rendered as such and are nobody's perspective.

A rendering is one row, however many turns it has, unless the dialogue comes to more than ``part_chars`` characters.
Such a dialogue goes on in further rows (``part`` 0, 1, ...), cut between turns by size alone; every participant, silent
ones too, gets every part, and the parts laid end to end are the whole rendering. ``start`` is where a part begins in it and
spans count from the whole's beginning, so neither changes with the size of parts. A part is 2^18 characters because a
task holds all parts of a dialogue's participants one after another, each several times over while it is rendered and
written: some 5 MB a row. Turn numbers only order the turns.

Most dialogues are held by one row: those are collected by conversation, at most ``part_chars`` each. Longer ones, even
one that holds a third of all rows, are never gathered in a task: their turns are range-partitioned by (conversation,
turn, role, digest of the text) and a turn's place is the sum of what comes before it, by partition, then within it.

Exactly repeated rows count once. Rows with a null conversation id form no dialogue and are left out; null turns
sort first, null roles are ``unknown``, null texts are empty; turns that tie go by role, then by the text's MD5. Marks
of the template inside texts are broken up. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import cut, table

#: Characters of texts, roles and marks that a row's dialogue may come to; MARKS stands for a turn's marks.
PART_CHARS = 1 << 18
MARKS = 32
INSTRUCTIONS = ("system",)
END = "<|end|>\n"


def _header(role: Column, speaker: Column, instructions: tuple[str, ...]) -> Column:
    name = F.regexp_replace(role, r"[^0-9A-Za-z_-]", "_")
    return F.when(role == speaker, F.lit("<|assistant|>\n")).when(role.isin(*instructions), F.concat(F.lit("<|"), name, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))


def _long_parts(rows: DataFrame, part_chars: int) -> DataFrame:
    """(conv_id, part, m) of the distinct turns of long dialogues."""
    ordered = rows.select("*", F.col("m.turn").alias("__turn"), F.col("m.role").alias("__role"), F.col("m.digest").alias("__digest"))
    dealt = cut(ordered.repartitionByRange("conv_id", F.col("__turn").asc_nulls_first(), "__role", "__digest").dropDuplicates(["conv_id", "__turn", "__role", "__digest"]).withColumn("__range", F.spark_partition_id()), "turns")
    sums = dealt.groupBy("conv_id", "__range").agg(F.sum("size").alias("__all"))
    earlier = Window.partitionBy("conv_id").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("conv_id", "__range", F.coalesce(F.sum("__all").over(earlier), F.lit(0)).alias("__base"))
    before = Window.partitionBy("conv_id", "__range").orderBy("__turn", "__role", "__digest").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("__before", F.coalesce(F.sum("size").over(before), F.lit(0))).join(base, ["conv_id", "__range"])
    return placed.select("conv_id", F.floor((F.col("__base") + F.col("__before")) / part_chars).cast("long").alias("part"), "m")


def _starts(far: DataFrame, voices: DataFrame, instructions: tuple[str, ...]) -> DataFrame:
    """(conv_id, part, perspective, start) of long dialogues, from sums by part and role: a perspective's headers differ from the others' in its own turns only."""
    me, role = F.col("perspective"), F.col("m.role")
    other = _header(role, F.lit(""), instructions)
    roles = far.groupBy("conv_id", "part", role.alias("perspective")).agg(F.count("*").alias("n"), F.sum(F.length("m.text") + len(END) + F.length(other)).alias("size"))
    sums = roles.groupBy("conv_id", "part").agg(F.sum("size").alias("all"))
    each = voices.join(sums, "conv_id").join(roles.select("conv_id", "part", "perspective", "n"), ["conv_id", "part", "perspective"], "left")
    own = F.coalesce("n", F.lit(0)) * (F.length(_header(me, me, instructions)) - F.length(_header(me, F.lit(""), instructions)))
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return each.select("conv_id", "part", "perspective", F.coalesce(F.sum(F.col("all") + own).over(earlier), F.lit(0)).cast("long").alias("start"))


def rotate(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", part_chars: int = PART_CHARS, instructions: tuple[str, ...] = INSTRUCTIONS) -> DataFrame:
    """One row for each (conversation, perspective, part): ``rendered``, its ``start``, ``spans`` (start, end in characters of the whole rendering, end exclusive), ``n_turns``."""
    said = F.replace(F.coalesce(F.col(text), F.lit("")), F.lit("<|"), F.lit("< |"))
    rows = df.where(F.col(conv).isNotNull()).select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("unknown")).alias("role"), said.alias("text"))
    rows = rows.withColumn("size", (F.length("text") + F.length("role") + MARKS).cast("long")).select("conv_id", "size", F.struct("turn", "role", F.md5("text").alias("digest"), "text").alias("m"))
    long = rows.groupBy("conv_id").agg(F.sum("size").alias("size")).where(F.col("size") > part_chars).select("conv_id")
    none = long.isEmpty()
    long = long if none else cut(long, "long")
    part = lambda df: df.groupBy("conv_id", "part").agg(F.array_sort(F.collect_set("m")).alias("ms"))
    speaks = ~F.col("perspective").isin(*instructions)
    short = rows if none else rows.join(long, "conv_id", "left_anti")
    held = part(short.withColumn("part", F.lit(0).cast("long"))).withColumn("start", F.lit(0).cast("long"))
    turned = held.select("*", F.explode(F.array_distinct(F.transform("ms", lambda m: m["role"]))).alias("perspective")).where(speaks)
    if not none:
        far = cut(_long_parts(rows.join(long, "conv_id", "left_semi"), part_chars), "parts")
        voices = far.select("conv_id", F.col("m.role").alias("perspective")).where(speaks).distinct()
        turned = turned.unionByName(part(far).join(_starts(far, voices, instructions), ["conv_id", "part"]))
    me = F.col("perspective")
    shown = turned.withColumn("ms", F.transform("ms", lambda m: F.struct((m["role"] == me).alias("own"), _header(m["role"], me, instructions).alias("head"), F.concat(m["text"], F.lit(END)).alias("body"))))
    start = F.struct(F.col("start").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def walk(acc: Column, m: Column) -> Column:
        begin = acc["at"] + F.length(m["head"])
        stop = begin + F.length(m["body"])
        span = F.struct(begin.alias("start"), stop.alias("end"))
        return F.struct(stop.alias("at"), F.when(m["own"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return shown.select(
        "conv_id", "part", "perspective", "start",
        F.array_join(F.transform("ms", lambda m: F.concat(m["head"], m["body"])), "").alias("rendered"),
        F.aggregate("ms", start, walk, lambda acc: acc["spans"]).alias("spans"),
        F.size("ms").alias("n_turns"),
    )


def op3_chat_format(spark, sf_dir: str) -> DataFrame:
    out = rotate(table(spark, sf_dir, "conversations"))
    return out.select(
        "conv_id", "part", "perspective", "start", "n_turns",
        F.size("spans").alias("n_targets"),
        F.length("rendered").alias("n_chars"),
        F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"]).alias("target_chars"),
        F.md5("rendered").alias("rendered_md5"),
        F.md5(F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")).alias("spans_md5"),
    )


def op3_sql(part_chars: int = PART_CHARS) -> str:
    order = "turn NULLS FIRST, role, md5(text)"
    return f"""
WITH m AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, coalesce(sum(length(text) + length(role) + {MARKS}) OVER (PARTITION BY conv_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT // {part_chars} AS part FROM m),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM m WHERE role <> 'system'),
s AS (SELECT r.*, perspective, role = perspective AS own,
             CASE WHEN role = perspective THEN '<|assistant|>' WHEN role = 'system' THEN '<|system|>' ELSE '<|user name=' || regexp_replace(role, '[^0-9A-Za-z_-]', '_', 'g') || '|>' END || chr(10) AS head,
             text || '<|end|>' || chr(10) AS body FROM r JOIN p USING (conv_id)),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY {order} ROWS UNBOUNDED PRECEDING)::BIGINT AS stop FROM s)
SELECT conv_id, part, perspective, min(stop - length(head) - length(body)) AS start, CAST(count(*) AS INTEGER) AS n_turns, CAST(count(*) FILTER (own) AS INTEGER) AS n_targets, CAST(sum(length(head) + length(body)) AS INTEGER) AS n_chars,
       CAST(coalesce(sum(length(body)) FILTER (own), 0) AS BIGINT) AS target_chars, md5(string_agg(head || body, '' ORDER BY {order})) AS rendered_md5,
       md5(coalesce(string_agg(CAST(stop - length(body) AS BIGINT) || '-' || CAST(stop AS BIGINT), ',' ORDER BY {order}) FILTER (own), '')) AS spans_md5
FROM o GROUP BY ALL
"""
