"""Quality classification by a generalised additive model with pairwise interactions.

Features of whole texts (shapes of words and lines, shares of kinds of bytes, repetition) are binned by quantiles.
Cyclic boosting visits one feature after the other, again and again; each visit fits a tree of depth two to the
current gradients over that feature's bins and adds its leaves to the feature's lookup table. Then the pairs of
features that best explain what is left get tables over coarse bins by the same scheme. A score is a sum of looked-up
values. Labels, language, source and id are no features.

The model is fitted on at most ``MAX_FIT_ROWS`` labelled documents, chosen by a hash of their id, and has a fixed
size. Of rows that share an id the one with the least features counts. Scoring reads every text once and shuffles nothing. Null and empty texts have all-zero features and are
scored like any other. Rows are kept one to one. Without any label the score is 0.5; with labels of one class alone
it is that class's smoothed share.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import mix, slices, span_hashes, table, utf8_buffer, word_spans

MAX_FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, RIDGE = 80, 40, 0.15, 2.0
NAMES = ["log_words", "word_length", "word_length_sd", "upper", "digits", "punctuation", "exclamations", "bars", "runs", "non_ascii", "newlines", "repeated_lines", "distinct_words", "short_words", "log_line", "closed_words", "capital_words", "spaces"]


def _kinds() -> np.ndarray:
    kinds = np.zeros((7, 256), bool)
    kinds[0, ord("A") : ord("Z") + 1] = True
    kinds[1, ord("0") : ord("9") + 1] = True
    kinds[2, [c for c in range(33, 127) if not chr(c).isalnum()]] = True
    kinds[3, ord("!")] = kinds[4, ord("|")] = kinds[6, ord("\n")] = True
    kinds[5, 128:] = True
    return kinds


_KINDS = _kinds()


def features(column: pa.Array) -> np.ndarray:
    """A row of features for each text of an Arrow string column."""
    data, offsets = utf8_buffer(column)
    n = len(offsets) - 1
    size = np.diff(offsets)
    per_byte = 1 / np.maximum(size, 1)
    rows = np.repeat(np.arange(n), size)

    def total(mask: np.ndarray) -> np.ndarray:
        return np.bincount(rows[mask], minlength=n)

    upper, digits, punctuation, bang, bar, high, newline = (total(k[data]) for k in _KINDS)
    marks = _KINDS[2][data]
    run = np.zeros(len(data), bool)
    run[1:] = marks[1:] & (data[1:] == data[:-1]) & (rows[1:] == rows[:-1])
    starts, ends, at = word_spans(data, offsets)
    words = np.diff(at)
    owner = np.repeat(np.arange(n), words)
    per_word = 1 / np.maximum(words, 1)
    length = (ends - starts).astype(np.float64)
    mean = np.bincount(owner, length, n) * per_word
    spread = np.sqrt(np.maximum(np.bincount(owner, length**2, n) * per_word - mean**2, 0))
    share = lambda mask: np.bincount(owner[mask], minlength=n) * per_word

    def distinct(who: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        key = mix(span_hashes(data, starts, ends) + who.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))
        order = np.argsort(key)
        new = np.ones(len(key), bool)
        new[1:] = key[order][1:] != key[order][:-1]
        return np.bincount(who[order][new], minlength=n)

    breaks = np.nonzero(data == 10)[0]
    line_starts = np.unique(np.concatenate([offsets[:-1][size > 0], breaks + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.concatenate([line_starts[1:], [len(data)]])[: len(line_starts)]
    line_ends = line_ends - (data[line_ends - 1] == 10) if len(line_ends) else line_ends
    full = line_ends > line_starts
    line_starts, line_ends = line_starts[full], line_ends[full]
    line_owner = rows[line_starts] if len(line_starts) else np.zeros(0, np.int64)
    lines = np.bincount(line_owner, minlength=n)
    closed = np.zeros(len(starts), bool) if not len(starts) else marks[ends - 1]
    capital = np.zeros(len(starts), bool) if not len(starts) else _KINDS[0][data[starts]]
    out = np.stack([
        np.log1p(words), mean, spread, upper * per_byte, digits * per_byte, punctuation * per_byte, bang * per_byte, bar * per_byte, total(run) * per_byte, high * per_byte, newline * per_byte,
        1 - distinct(line_owner, line_starts, line_ends) / np.maximum(lines, 1), distinct(owner, starts, ends) * per_word, share(length <= 3), np.log1p(size / np.maximum(lines, 1)), share(closed), share(capital),
        (size - np.bincount(owner, length, n)) * per_byte,
    ], axis=1)
    out[size == 0] = 0
    return out


@dataclass
class Gam:
    prior: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.prior)
        for f, (edges, values) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += values[np.searchsorted(edges, x[:, f], side="right")]
        coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.pair_edges)]
        for (a, b), values in zip(self.pairs, self.pair_tables, strict=True):
            z += values[coarse[a], coarse[b]]
        return 1 / (1 + np.exp(-z))


def _cuts(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="higher"))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """The gain and the place of the best single cut through a row of bins."""
    if len(g) < 2:
        return 0.0, 0
    a, b = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = a**2 / (b + RIDGE) + (g.sum() - a) ** 2 / (h.sum() - b + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    k = int(np.argmax(gain))
    return max(0.0, float(gain[k])), k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf values over the bins of a tree of depth two."""
    out = np.empty(len(g))
    _, k = _best_cut(g, h)
    for lo, hi in ((0, k), (k, len(g))):
        if lo < hi:
            _, m = _best_cut(g[lo:hi], h[lo:hi])
            for s in (slice(lo, lo + m), slice(lo + m, hi)):
                out[s] = g[s].sum() / (h[s].sum() + RIDGE)
    return out


def _plane_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and leaf values of the best tree that cuts one axis, then the other on either side."""
    best, values = -1.0, np.zeros_like(g)
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for k in range(1, len(a)):
            gain, out = 0.0, np.zeros_like(a)
            for s in (slice(0, k), slice(k, len(a))):
                u, v = a[s].sum(0), b[s].sum(0)
                more, m = _best_cut(u, v)
                gain += more + u.sum() ** 2 / (v.sum() + RIDGE)
                for t in (slice(0, m), slice(m, None)):
                    out[s, t] = u[t].sum() / (v[t].sum() + RIDGE)
            if gain > best:
                best, values = gain, (out.T if turn else out)
    return best - float(g.sum() ** 2 / (h.sum() + RIDGE)), values


def fit_arrays(x: np.ndarray, y: np.ndarray) -> Gam:
    """Fit to a matrix of features and labels 0 and 1."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(prior=float(np.log(share / (1 - share))))
    if len(set(y.tolist())) < 2:
        return model
    order = np.lexsort((*x.T, y))  # the order in which rows arrived must not matter
    x, y = x[order], y[order].astype(np.float64)
    z = np.full(len(y), model.prior)
    model.edges = [_cuts(c, BINS) for c in x.T]
    binned = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T, strict=True)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    for _ in range(ROUNDS):
        for f, b in enumerate(binned):
            p = 1 / (1 + np.exp(-z))
            step = RATE * _tree(np.bincount(b, y - p, len(model.tables[f])), np.bincount(b, p * (1 - p), len(model.tables[f])))
            model.tables[f] += step
            z += step[b]
    model.pair_edges = [_cuts(c, PAIR_BINS) for c in x.T]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T, strict=True)]

    def plane(a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        shape = len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1
        at = coarse[a] * shape[1] + coarse[b]
        return at, np.bincount(at, y - p, shape[0] * shape[1]).reshape(shape), np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape)

    gains = sorted(((_plane_tree(*plane(a, b)[1:])[0], -a, -b) for a, b in combinations(range(x.shape[1]), 2)), reverse=True)
    model.pairs = [(-a, -b) for _, a, b in gains[:PAIRS]]
    model.pair_tables = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            at, g, h = plane(a, b)
            step = RATE * _plane_tree(g, h)[1]
            model.pair_tables[k] += step
            z += step.reshape(-1)[at]
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_FIT_ROWS) -> Gam:
    """Learn from labelled rows that are not held out, max_rows of them at most."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    # A document's labels that disagree count as the lower; the sample is bounded, so it may be broadcast.
    sample = known.groupBy("doc_id").agg(F.min("quality").alias("__label")).orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.col("text").alias("__text")).join(F.broadcast(sample), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), "__text", F.col("__label").cast("double").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                x = features(part.column("__text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c) for c in x.T), part.column("label")], names=["doc_id", *NAMES, "label"])

    made = rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in [*NAMES, "label"]))
    # However many rows share an id, one of them counts: so max_rows rows come to the driver at most.
    got = made.groupBy("doc_id").agg(F.min(F.struct(*NAMES, "label")).alias("x")).select("x.*").toPandas()
    return fit_arrays(got[NAMES].to_numpy(np.float64).reshape(-1, len(NAMES)), got["label"].to_numpy(np.float64))


def score(df: DataFrame, model: Gam, text: str = "text", keep: list[str] | None = None, at_least: float | None = None) -> DataFrame:
    """Add ``score`` to the columns ``keep`` (all by default); with at_least, drop the rows below it."""
    keep = [c for c in (keep if keep is not None else df.columns) if c != "score"]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                s = shared.value.score(features(part.column("__text")))
                out = pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(s)], names=[*keep, "score"])
                yield out if at_least is None else out.filter(pa.array(s >= at_least))

    return df.select(*keep, F.col(text).alias("__text")).mapInArrow(run, schema)


def op10_quality_gam(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    scored = score(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
