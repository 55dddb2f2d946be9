"""Benchmark decontamination: a BM25 inverted index of test items, queried by every passage of every document.

Every word of every item is indexed: items are cut into units of ``UNIT`` words, the last one ending with the item and
reaching back over the one before where the rest is shorter. Units are sorted by length and numbered; the posting list of
a term holds its units in order with their impacts (BM25, divided by the score that the unit gives itself, so one
threshold holds for all) and, for each block of ``BLOCK`` units that it touches, the greatest impact within. Documents
are cut into overlapping passages of whole texts. All units at or above the threshold are retrieved, there is no top k,
so block-max WAND's bar is the threshold from the start and its steps need no heap: passages whose lists' greatest
impacts together stay below the bar are dropped; then all blocks where the block maxima together stay below it are
skipped; only the postings of the blocks left are scored. The passages of a batch take each step together, as array
operations over the lists of their terms. Each retrieved item is then verified against the whole document: enough of the
three-word runs of its question and of its answer must occur in it. The question is what comes before the last sentence
(or up to the last question mark), the answer the rest.

Corpus statistics cover all items. Items are taken in groups of about ``GROUP_BYTES`` of text, each with a pass over the
documents; an index comes to some 20 bytes for a byte of text (``Checker.nbytes``), so what is broadcast at a time is
bounded. Nothing is shuffled but item lists and, with several groups, counts of terms.

Null and empty texts hit nothing; null or wordless items are never hit. Exactly repeated items count once; items that
share an id but not the text are checked each by its own text, and an item may have a null id. A document that leaks
several items has a row for each. Ties don't arise, as nothing is cut off.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import cut, slices, table

UNIT, BLOCK = 48, 8
PASSAGE, STRIDE = 64, 32
THRESHOLD = 0.4
QUESTION, ANSWER = 0.5, 0.4
RUN = 3
K1, B = 1.2, 0.75
GROUP_BYTES = 4 << 20
#: Passages of a batch times blocks of the index: what the step over block maxima holds at a time.
CELLS = 1 << 20
_WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[str, str]:
    """The two parts of an item; either may be empty."""
    at = text.rfind("?") + 1
    if not at or not words(text[at:]):
        ends = [m.end() for m in re.finditer(r"[.!?](?=\s)", text.rstrip())]
        at = ends[-1] if ends else 0
    return text[:at], text[at:]


def units_of(tokens: list) -> list[list]:
    """Runs of UNIT words that cover all of an item."""
    starts = [*range(0, len(tokens) - UNIT, UNIT), max(0, len(tokens) - UNIT)]
    return [tokens[k : k + UNIT] for k in starts] if tokens else []


class Statistics:
    """Numbers of all units: how many, their mean length, and how many hold each of the terms in use."""

    def __init__(self, n: int, mean: float, df: dict[str, int]):
        self.n, self.mean, self.df = n, mean, df

    @classmethod
    def of(cls, units: Iterable[list[str]]) -> Statistics:
        n, length, df = 0, 0, Counter()
        for u in units:
            n, length = n + 1, length + len(u)
            df.update(set(u))
        return cls(n, length / max(1, n), df)

    def idf(self, term: str) -> float:
        d = self.df.get(term, 0)
        return math.log(1 + (self.n - d + 0.5) / (d + 0.5))


def _spread(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges given by start and count: which range, and which place, each of their elements laid end to end has."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, np.arange(len(owner)) + np.repeat(start - np.cumsum(count) + count, count)


class Index:
    """Posting lists with block maxima. Terms are numbered by their place in ``terms``; that many stands for unknown words."""

    def __init__(self, units: list[tuple[int, list[str]]], stats: Statistics, terms: list[str] | None = None):
        units = sorted(units, key=lambda u: (len(u[1]), u[0], u[1]))
        terms = sorted({t for _, u in units for t in u}) if terms is None else terms
        number = {t: k for k, t in enumerate(terms)}
        idf = [stats.idf(t) for t in terms]
        self.items = np.array([i for i, _ in units], np.int64)
        self.unknown = len(terms)
        self.blocks = max(1, -(-len(units) // BLOCK))
        rows = []
        for k, (_, tokens) in enumerate(units):
            own = [(number[t], idf[number[t]] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(tokens) / stats.mean))) for t, tf in Counter(tokens).items()]
            whole = sum(v for _, v in own)
            rows += [(t, k, v / whole) for t, v in own]
        rows.sort()
        term, self.unit, self.impact = (np.array([r[k] for r in rows], kind) for k, kind in enumerate((np.int64, np.int32, np.float32)))
        # A list's postings within one block are neighbours; so are a list's blocks.
        key = term * self.blocks + self.unit // BLOCK
        first = np.nonzero(np.diff(key, prepend=-1))[0]
        self.postings = np.append(first, len(rows)).astype(np.int64)
        self.block = (key[first] % self.blocks).astype(np.int32)
        self.block_max = np.maximum.reduceat(self.impact, first) if len(first) else self.impact
        self.lists = np.searchsorted(term[first], np.arange(len(terms) + 1)).astype(np.int64)
        self.term_max = np.zeros(len(terms) + 1, np.float32)
        np.maximum.at(self.term_max, term, self.impact)

    def search(self, ids: np.ndarray, bounds: np.ndarray, threshold: float = THRESHOLD) -> list[tuple[int, int, float]]:
        """(document, item, score) of all units that some passage reaches; ids: terms of documents laid end to end, bounds: where they begin."""
        size = np.diff(bounds)
        count = np.where(size > 0, 1 + np.maximum(0, -(-(size - PASSAGE) // STRIDE)), 0)
        doc = np.repeat(np.arange(len(size)), count)
        start = bounds[:-1][doc] + STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count))
        stop = np.minimum(start + PASSAGE, bounds[1:][doc])
        total = np.concatenate([[0], np.cumsum(self.term_max[ids], dtype=np.float64)])
        bar = threshold * 0.9999
        live = np.nonzero(total[stop] - total[start] >= bar)[0]
        per = max(1, min(1024, CELLS // self.blocks))
        best: dict[tuple[int, int], float] = {}
        for lo in range(0, len(live), per):
            at = live[lo : lo + per]
            grid = start[at][:, None] + np.arange(PASSAGE)
            terms = np.where(grid < stop[at][:, None], ids[np.minimum(grid, len(ids) - 1)], self.unknown)
            terms.sort(1)
            new = terms != self.unknown
            new[:, 1:] &= terms[:, 1:] != terms[:, :-1]  # a term counts once
            new &= (self.term_max[terms] * new).sum(1, keepdims=True) >= bar
            passage, column = np.nonzero(new)
            t = terms[passage, column]
            pair, entry = _spread(self.lists[t], self.lists[t + 1] - self.lists[t])
            cell = passage[pair] * self.blocks + self.block[entry]
            reach = np.bincount(cell, self.block_max[entry], len(at) * self.blocks) >= bar
            stay = reach[cell]
            cells, where = np.unique(cell[stay], return_inverse=True)
            entry = entry[stay]
            pair, k = _spread(self.postings[entry], self.postings[entry + 1] - self.postings[entry])
            scores = np.bincount(where[pair] * BLOCK + self.unit[k] % BLOCK, self.impact[k], len(cells) * BLOCK)
            for h in np.nonzero(scores >= threshold)[0].tolist():
                p, b = divmod(int(cells[h // BLOCK]), self.blocks)
                key = int(doc[at[p]]), int(self.items[b * BLOCK + h % BLOCK])
                best[key] = max(best.get(key, 0.0), float(scores[h]))
        return [(d, i, s) for (d, i), s in sorted(best.items())]


class Checker:
    """The index of a group of items and the word runs of their questions and answers."""

    def __init__(self, items: list[tuple[int | None, str]], stats: Statistics):
        tokens = [words(text) for _, text in items]
        self.ids = [i for i, _ in items]
        terms = sorted({w for t in tokens for w in t})
        self.number = {w: k for k, w in enumerate(terms)}
        self.index = Index([(k, u) for k, t in enumerate(tokens) for u in units_of(t)], stats, terms)
        halves = [[self.numbers(words(x)) for x in question_and_answer(text)] for _, text in items]
        self.wide = np.int64(len(terms) + 1)
        #: All pairs of neighbours within a question or an answer; a longer run is the place of its first pair here and one more term.
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(p[:-1] * self.wide + p[1:] for h in halves for p in h)]))
        self.parts = [[(min(RUN, len(p)), self.runs(p, min(RUN, len(p)))) for p in h] for h in halves]

    def numbers(self, tokens: list[str]) -> np.ndarray:
        get, unknown = self.number.get, len(self.number)
        return np.fromiter((get(w, unknown) for w in tokens), np.int64, len(tokens))

    def runs(self, ids: np.ndarray, n: int) -> np.ndarray:
        """The distinct runs of n terms (up to three) that may occur in items, as numbers."""
        if n < 2:
            return np.unique(ids[ids < self.wide - 1]) if n else ids[:0]
        pair = ids[:-1] * self.wide + ids[1:]
        if n == 2:
            return np.unique(pair[np.isin(pair, self.pairs)])
        place = np.searchsorted(self.pairs, pair[:-1])
        held = np.nonzero(place < len(self.pairs))[0]
        held = held[self.pairs[place[held]] == pair[held]]
        return np.unique(place[held] * self.wide + ids[held + 2])

    @property
    def nbytes(self) -> int:
        """Bytes of the arrays and the dictionary of terms."""
        arrays = [*vars(self.index).values(), self.pairs, *(r for h in self.parts for _, r in h)]
        return sum(a.nbytes for a in arrays if isinstance(a, np.ndarray)) + sum(100 + len(w.encode()) for w in self.number)

    def check(self, texts: list[str | None]) -> list[tuple[int, int | None, float, float, float]]:
        """(document, item, score, question overlap, answer overlap) of the verified hits."""
        ids = [self.numbers(words(t)) for t in texts]
        bounds = np.cumsum([0, *map(len, ids)])
        if not bounds[-1] or not len(self.index.items):
            return []
        out, own = [], {}
        for d, i, s in self.index.search(np.concatenate(ids), bounds):
            if d not in own:
                own = {d: {n: self.runs(ids[d], n) for n in range(RUN + 1)}}  # hits come by document
            q, a = (float(np.isin(r, own[d][n]).mean()) if len(r) else 1.0 for n, r in self.parts[i])
            if q >= QUESTION and a >= ANSWER:
                out.append((d, self.ids[i], s, q, a))
        return out


def checkers(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", group_bytes: int = GROUP_BYTES) -> Iterator[Checker]:
    """One checker for each group of items within the bound."""
    items = benchmark.where(F.length(text) > 0).select(F.col(item_id).cast("long").alias("i"), F.col(text).alias("t")).distinct()
    groups = (items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // group_bytes + 1

    def held(g: int) -> list[tuple[int | None, str]]:
        got = items if groups == 1 else items.where(F.pmod(F.xxhash64("i", "t"), F.lit(groups)) == g)
        return sorted(map(tuple, got.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))

    if groups == 1:
        own = held(0)
        yield Checker(own, Statistics.of(u for _, t in own for u in units_of(words(t))))
        return

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [u for t in batch.column("t").to_pylist() for u in units_of(words(t))]
            df = Counter(w for u in units for w in set(u))
            yield pa.RecordBatch.from_arrays([pa.array(["", *df]), pa.array([len(units), *df.values()], pa.int64()), pa.array([sum(map(len, units)), *[0] * len(df)], pa.int64())], names=["w", "n", "length"])

    counts = cut(items.select("t").mapInArrow(count, "w string, n long, length long").groupBy("w").agg(F.sum("n").alias("n"), F.sum("length").alias("length")), "terms")
    whole = counts.where("w = ''").first()
    for g in range(groups):
        own = held(g)
        mine = items.sparkSession.createDataFrame([(w,) for w in sorted({w for _, t in own for w in words(t)})], "w string")
        df = {r.w: r.n for r in counts.join(mine, "w").collect()}  # the group's own terms only
        yield Checker(own, Statistics(whole.n, whole.length / max(1, whole.n), df))


def hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap), one row for each row of docs and item that it leaks."""
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", T.LongType()), *(T.StructField(c, T.DoubleType()) for c in ("score", "question_overlap", "answer_overlap"))])
    base, out = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")), None
    for checker in checkers(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(checker)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "__text"):
                    found = shared.value.check(part.column("__text").to_pylist())
                    cols = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.int64(), pa.int64(), *[pa.float64()] * 3))]
                    yield pa.RecordBatch.from_arrays([part.column("doc_id").take(cols[0]), *cols[1:]], names=schema.names)

        one = base.mapInArrow(run, schema)
        out = one if out is None else out.unionByName(one)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs, all columns, that leak no item."""
    for checker in checkers(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(checker)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text):
                    clean = np.ones(part.num_rows, bool)
                    clean[[f[0] for f in shared.value.check(part.column(text).to_pylist())]] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op2_bm25_decontam(spark, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
