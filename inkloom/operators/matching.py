"""Matching new content with a store: equality, similarity, availability, one-to-one assignment."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkloom.functions import text as X
from inkloom.operators.scratch import held


def reuse(df: DataFrame, key: str, text: str, strict: bool = False, keep: list[str] | None = None) -> DataFrame:
    """(key, the columns keep, survivor, status): equal canonical texts share their least key; the survivor is NEW, the others REUSED.

    Texts are read once, into hashes; only hashes that occur again are joined.
    """
    kind = X.strict_key if strict else X.canonical_key
    hashed = held(df.select(key, *(keep or []), F.unhex(kind(F.coalesce(F.col(text), F.lit("")))).alias("__canon")), "hashes")
    least = hashed.groupBy("__canon").agg(F.min(key).alias("survivor"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    survivor = F.coalesce("survivor", key)
    return hashed.join(least, "__canon", "left").select(key, *(keep or []), survivor.alias("survivor"), F.when(F.col(key) == survivor, "NEW").otherwise("REUSED").alias("status"))


def counters(found: DataFrame, by: str) -> DataFrame:
    """(by, all_rows, new_rows, matched_rows): what an import created and what it reused."""
    return found.groupBy(by).agg(F.count("*").alias("all_rows"), F.count_if(F.col("status") == "NEW").alias("new_rows"), F.count_if(F.col("status") != "NEW").alias("matched_rows"))


def shingles(text: Column, words: int) -> Column:
    """Distinct runs of lower-cased words; a shorter text is one run, an empty one none."""
    w = F.filter(F.split(F.lower(text), r"[ \t\n\r\f\x0B]+"), lambda x: x != "")
    n = F.size(w)
    # Shifted copies side by side: a lambda that named the words would split the text anew for every run.
    shifted = [F.slice(w, k, F.greatest(n, F.lit(1))) for k in range(1, words + 1)]
    runs = F.transform(F.arrays_zip(*(c.alias(f"w{k}") for k, c in enumerate(shifted))), lambda x: F.concat_ws(" ", *(x[f"w{k}"] for k in range(words))))
    return F.when(n > 0, F.array_distinct(F.slice(runs, 1, F.greatest(n - (words - 1), F.lit(1))))).otherwise(F.array().cast("array<string>"))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(hashes: pa.ListArray, words: int) -> pa.ListArray:
    """The sorted distinct shingles of each list of word hashes, as hashes; a shorter list is one shingle, an empty one none."""
    size = hashes.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = _mixed(hashes.flatten().to_numpy(zero_copy_only=False).view(np.uint64))
    starts = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    left = np.repeat(starts + size, size) - np.arange(len(flat))  # words from here to the list's end
    short = size[row] < words
    runs = np.zeros(len(flat), np.uint64)
    for k in range(words):
        there = left > k
        ahead = np.zeros(len(flat), np.uint64)
        ahead[there] = flat[np.flatnonzero(there) + k]
        runs = np.where(there, _mixed(runs * _STEP + ahead), runs)
    keep = (left >= words) | short & (left == size[row])
    runs, row = runs[keep].view(np.int64), row[keep]
    order = np.lexsort((runs, row))
    runs, row = runs[order], row[order]
    new = np.append(True, (runs[1:] != runs[:-1]) | (row[1:] != row[:-1]))[: len(runs)]
    ends = np.cumsum(np.bincount(row[new], minlength=len(size)))
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(runs[new]))


#: Rows that a worker unfolds at once.
_AT_ONCE = 1000


def _hashed(df: DataFrame, key: str, text: str, words: int, whole: bool) -> DataFrame:
    """(id, k) of each row with words, k the digest of its shingle set; whole: and (h, s), the digest's beginning as a number and the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for most in batches:
            for at in range(0, most.num_rows, _AT_ONCE):
                batch = most.slice(at, _AT_ONCE)
                s = shingle_hashes(batch.column("w"), words)
                ends, flat = s.offsets.to_numpy(), s.values.to_numpy()
                digests = [hashlib.sha256(flat[a:b].tobytes()).digest() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                out, names = [batch.column("id"), pa.array(digests, pa.binary())], ["id", "k"]
                if whole:
                    out, names = [*out, pa.array([int.from_bytes(d[:8], signed=True) for d in digests], pa.int64()), s], [*names, "h", "s"]
                yield pa.RecordBatch.from_arrays(out, names=names).filter(pc.greater(pc.list_value_length(s), 0))

    hashed = F.transform(F.split(F.lower(F.col(text)), r"[ \t\n\r\f\x0B]+"), lambda w: F.when(w != "", F.xxhash64(w)))
    rows = df.select(F.col(key).alias("id"), F.array_compact(hashed).alias("w"))
    return rows.mapInArrow(run, f"id {df.schema[key].dataType.simpleString()}, k binary" + (", h long, s array<long>" if whole else ""))


def _classes(member: DataFrame) -> DataFrame:
    rep = member.groupBy("k").agg(F.min("id").alias("rep"))
    return member.select("id", "k").join(rep, "k").select("id", "rep")


def set_classes(df: DataFrame, key: str, text: str, words: int = 5) -> DataFrame:
    """(id, rep): rows with words, and the least id of those with the same set of shingles. Digests alone are written and shuffled."""
    return _classes(held(_hashed(df, key, text, words, whole=False), "digests"))


def _fresh(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(h, sizes, shingles) of the sets of a task, some rows at a time; equal sets come once."""
    seen: set[bytes] = set()
    for whole in batches:
        for at in range(0, whole.num_rows, _AT_ONCE):
            batch = whole.slice(at, _AT_ONCE)
            new = [i for i, k in enumerate(batch.column("k").to_pylist()) if not (k in seen or seen.add(k))]
            if new:
                batch = batch.take(pa.array(new))
                yield batch.column("h").to_numpy(), pc.list_value_length(batch.column("s")).to_numpy().astype(np.int64), batch.column("s").flatten().to_numpy()


#: Shingles are counted by the first bits of their hash: 4 MiB, whatever the table.
_BUCKETS = 20
_SLICE = 1 << 14


def _bucket(t: np.ndarray) -> np.ndarray:
    return (t.view(np.uint64) >> np.uint64(64 - _BUCKETS)).astype(np.int64)


def _bucket_counts(member: DataFrame) -> np.ndarray:
    """How many shingles of all sets fall into each bucket: tasks count theirs, slices of the counts are added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << _BUCKETS, np.int64)
        for _, _, t in _fresh(batches):
            total += np.bincount(_bucket(t), minlength=len(total))
        if total.any():
            slices = len(total) // _SLICE
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(slices, dtype=np.int32)), pa.FixedSizeListArray.from_arrays(pa.array(total), _SLICE).cast(pa.list_(pa.int64()))], names=["slice", "n"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"slice": rows["slice"].iloc[:1], "n": [np.sum(np.stack(rows["n"]), axis=0)]})

    out = np.zeros(1 << _BUCKETS, np.int32)
    for r in member.select("k", "h", "s").mapInArrow(count, "slice int, n array<long>").groupBy("slice").applyInPandas(add, "slice int, n array<long>").toArrow().to_pylist():
        out[r["slice"] * _SLICE : (r["slice"] + 1) * _SLICE] = np.minimum(r["n"], 2**31 - 1)
    return out


def _sets(df: DataFrame, key: str, text: str, words: int) -> tuple[DataFrame, DataFrame]:
    """(id, k, h, s) of all rows with words, and (h, k, rep) of the classes of equal sets, rep the least id; texts are read once."""
    member = held(_hashed(df, key, text, words, whole=True), "sets")
    return member, held(member.groupBy("h", "k").agg(F.min("id").alias("rep")), "reps")


def _met(marks: DataFrame) -> DataFrame:
    """Of the rows (t, h, ...) those whose t different sets have, each once: one shuffle by t."""
    w = Window.partitionBy("t")
    return held(marks.withColumn("__one", F.min("h").over(w) == F.max("h").over(w)).where("NOT __one").drop("__one").distinct(), "met")


#: So many keys at most are sent to all tasks; more are joined by a shuffle.
MOST_KEYS = 1_000_000


def _few(keys: DataFrame) -> DataFrame:
    """Keys held, and sent to where the large side lies if they are few."""
    keys = held(keys, "keys")
    return F.broadcast(keys) if keys.count() <= MOST_KEYS else keys


def _checked(member: DataFrame, reps: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard) of the pairs (a, b) of h whose sets are at least so similar, a < b the classes' least ids. Only sets of pairs are moved."""
    pairs = held(pairs, "candidates")
    named = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    chosen = _few(reps.join(named, "h", "left_semi").select("k", "h", F.col("rep").alias("id")))
    own = member.select("id", "k", "s").join(chosen, ["id", "k"]).repartition("h").dropDuplicates(["h", "k"]).select("h", "id", "s")
    side = lambda x: own.select(F.col("h").alias(x), F.col("id").alias(f"i{x}"), F.col("s").alias(f"s{x}"))
    full = pairs.join(side("a"), "a").join(side("b"), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    jaccard = inter / (F.size("sa") + F.size("sb") - inter)
    return full.select(F.least("ia", "ib").alias("a"), F.greatest("ia", "ib").alias("b"), jaccard.alias("jaccard")).where(F.col("jaccard") >= threshold)


def _prefixes(member: DataFrame, threshold: float) -> DataFrame:
    """(t, h, n, i): the first n - ceil(t n) + 1 shingles of each set of n, those of rare buckets first, and their places."""
    counts = member.sparkSession.sparkContext.broadcast(_bucket_counts(member))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, size, t in _fresh(batches):
            row = np.repeat(np.arange(len(size)), size)
            t = t[np.lexsort((t, counts.value[_bucket(t)], row))]
            n, place = size[row], np.arange(len(t)) - np.repeat(np.cumsum(size) - size, size)
            keep = place <= n - np.ceil(n * threshold - 1e-9)
            yield pa.RecordBatch.from_arrays([pa.array(t[keep]), pa.array(h[row][keep]), pa.array(n[keep].astype(np.int32)), pa.array(place[keep].astype(np.int32))], names=["t", "h", "n", "i"])

    return member.select("k", "h", "s").mapInArrow(run, "t long, h long, n int, i int")


def similar(df: DataFrame, key: str, text: str, words: int = 5, threshold: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """(pairs of class representatives with their similarity, membership of rows in classes of equal sets).

    An exact prefix-filtered join: a set's shingles are ordered by the counts of their buckets, and two similar sets share
    one of the first n - ceil(t n) + 1. Frequent shingles stand last, so they rarely meet; the first that two sets share
    leaves enough behind it in both. Equal sets meet once, as one representative.
    """
    member, reps = _sets(df, key, text, words)
    met = _met(_prefixes(member, threshold))
    a, b = met.alias("a"), met.alias("b")
    size = (F.col("a.n") + F.col("b.n")) * (threshold / (1 + threshold)) - 1e-6
    left = F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i"))
    meet = (F.col("a.t") == F.col("b.t")) & (F.col("a.h") < F.col("b.h")) & (F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n") - 1e-6) & (left >= size)
    pairs = a.join(b, meet).select(F.col("a.h").alias("a"), F.col("b.h").alias("b")).distinct()
    return _checked(member, reps, pairs, threshold), member.select("id", "k").join(reps, "k").select("id", "rep")


#: MinHash signatures: bands of so many hashes each. At 0.6 a pair shares no band with a chance of 4 in 100,000, at 0.3 nearly one in three.
BANDS, ROWS = 42, 3


def _seeds(n: int) -> list[tuple[int, int]]:
    """Factors and summands of the hash permutations, from one rule."""
    return [(0x9E3779B97F4A7C15 * (2 * k + 1) & (1 << 64) - 1 | 1, 0xD1B54A32D192ED03 * (k + 7) & (1 << 64) - 1) for k in range(n)]


def signatures(member: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(t, h, n) from (k, h, s): of a set of n the least of its permuted hashes, for each permutation; those of a band, and which it is, are one number t."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for h, size, t in _fresh(batches):
            starts, values = np.cumsum(size) - size, t.view(np.uint64)
            out = np.repeat(_mixed(np.arange(1, bands + 1, dtype=np.uint64))[None, :], len(size), axis=0)
            for k, (a, b) in enumerate(_seeds(bands * rows)):
                least = np.minimum.reduceat(_mixed(values * np.uint64(a) + np.uint64(b)), starts)
                out[:, k // rows] = _mixed(out[:, k // rows] * _STEP + least)
            yield pa.RecordBatch.from_arrays([pa.array(out.reshape(-1).view(np.int64)), pa.array(np.repeat(h, bands)), pa.array(np.repeat(size, bands).astype(np.int32))], names=["t", "h", "n"])

    return member.select("k", "h", "s").mapInArrow(run, "t long, h long, n int")


def similar_by_hash(df: DataFrame, key: str, text: str, words: int = 5, threshold: float = 0.6, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """As :func:`similar`, for lower thresholds: candidates share a band of their MinHash signatures, each is verified exactly.

    What is found is exact; a pair at the threshold is missed with the chance (1 - threshold^rows)^bands.
    """
    member, reps = _sets(df, key, text, words)
    met = _met(signatures(member, bands, rows))
    a, b = met.alias("a"), met.alias("b")
    fit = (F.col("a.t") == F.col("b.t")) & (F.col("a.h") < F.col("b.h")) & (F.least("a.n", "b.n") >= threshold * F.greatest("a.n", "b.n") - 1e-6)
    pairs = a.join(b, fit).select(F.col("a.h").alias("a"), F.col("b.h").alias("b")).distinct()
    return _checked(member, reps, pairs, threshold), member.select("id", "k").join(reps, "k").select("id", "rep")


def available(usage: DataFrame, topic: str = "store_id") -> DataFrame:
    """Topics used exactly once."""
    return usage.groupBy(topic).agg(F.count("*").alias("uses")).where("uses = 1").select(topic)


def lowest_candidate(candidates: DataFrame) -> DataFrame:
    """(topic_key, store_id): of several equivalent candidates the least id."""
    return candidates.where("equivalent").groupBy("topic_key").agg(F.min("store_id").alias("store_id"))


def verified(df: DataFrame, key: str, text: str, words: int = 5, threshold: float = 0.75) -> DataFrame:
    """(a, b, jaccard, equivalent, strict): pairs of rows with similar texts, and whether their canonical forms are equal.

    Rows of one class of equal word sets meet through their representative only; so do the pairs of two classes.
    """
    pairs, classes = similar(df, key, text, words, threshold)
    own = classes.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("jaccard"))
    every = held(pairs.unionByName(own), "pairs")
    named = every.select(F.col("a").alias("id")).unionByName(every.select(F.col("b").alias("id"))).distinct()
    some = df.withColumn("id", F.col(key)).join(_few(named), "id", "left_semi")  # texts of pairs alone are compared, and moved only for many pairs
    forms = held(some.select("id", F.unhex(X.canonical_key(F.col(text))).alias("k"), F.unhex(X.strict_key(F.col(text))).alias("s")), "forms")
    side = lambda x: forms.select(F.col("id").alias(x), F.col("k").alias(f"k_{x}"), F.col("s").alias(f"s_{x}"))
    both = every.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "jaccard", (F.col("k_a") == F.col("k_b")).alias("equivalent"), (F.col("s_a") == F.col("s_b")).alias("strict"))


def greedy(candidates: DataFrame) -> DataFrame:
    """(spec, topic_seq, status, store_id): one to one within a spec, in source order: exact matches, then the first of the others, then equal topics of the batch.

    candidates(spec, topic_seq, place, store_id, equivalent, batch_key): place orders a topic's candidates; a topic without any
    has one row with a null store_id. A topic that is left without an id takes that of the first topic with the same batch_key
    that has one by then (MATCHED), else it is NEW. Each spec is one group; a spec is an outline, which a worker holds.
    """

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        used, ids, status = set(), {}, {}
        ordered = rows.sort_values(["topic_seq", "place", "store_id"], kind="stable")
        real = ordered[ordered["store_id"].notna()]
        keys = dict(zip(ordered["topic_seq"], ordered["batch_key"], strict=True))
        for r in real[real["equivalent"].astype(bool)].itertuples():
            if r.topic_seq not in ids and r.store_id not in used:
                ids[r.topic_seq], status[r.topic_seq] = int(r.store_id), "EXACT"
                used.add(r.store_id)
        near: dict = {}
        for r in real.itertuples():
            near.setdefault(r.topic_seq, []).append(r.store_id)
        for t in sorted(keys):
            if t in ids:
                continue
            free = next((i for i in near.get(t, ()) if i not in used), None)
            like = next((o for o in sorted(ids) if keys[t] is not None and keys[o] == keys[t]), None) if free is None else None
            if free is not None:
                ids[t], status[t] = int(free), "SIMILAR"
                used.add(free)
            elif like is not None:
                ids[t], status[t] = ids[like], "MATCHED"
            else:
                status[t] = "NEW"
        return pd.DataFrame([(rows["spec"].iloc[0], t, status[t], ids.get(t)) for t in sorted(keys)], columns=["spec", "topic_seq", "status", "store_id"]).astype({"store_id": "Int64"})

    return candidates.groupBy("spec").applyInPandas(assign, "spec long, topic_seq int, status string, store_id long")


def removed(members: DataFrame, reused: DataFrame) -> DataFrame:
    """members(spec, store_id) that no topic of the spec reuses."""
    return members.join(reused.select("spec", "store_id").where("store_id IS NOT NULL"), ["spec", "store_id"], "left_anti")


def newest(candidates: DataFrame, n: int | None = None) -> DataFrame:
    """candidates(topic_key, store_id) with ``place``, the largest id first; n: only so many."""
    ranked = candidates.withColumn("place", F.row_number().over(Window.partitionBy("topic_key").orderBy(F.desc("store_id"))))
    return ranked if n is None else ranked.where(F.col("place") <= n)


def same_kind(candidates: DataFrame, xml_format: str, locale_id: int) -> DataFrame:
    return candidates.where((F.col("xml_format") == xml_format) & (F.col("locale_id") == locale_id))
