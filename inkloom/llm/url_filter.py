"""URL filtering against sorted arrays of 64-bit digests.

Rules are (action, host, path) triples, a list or a table. Their ``host + path`` strings are hashed with xxhash64 and
written in the order of the digests into files of ``FILE_BYTES`` at most: sorted digests, the strings themselves and their
actions. A table of rules is sorted by Spark and streams through the driver, which never holds more than one file. Spark
copies the files to every executor, where workers memory-map them, so all workers of a machine share one copy in the page
cache. The URLs of a batch turn into candidate strings (each suffix of the host at a label's border with each prefix of
the path that is as long as some rule's path), each distinct one hashed once and looked up with a vectorised binary
search; full strings confirm each hit, so colliding digests change nothing. Of several rules that fit, the longest wins,
then the one with the longer host.

Of a rule given with both actions, block holds. Null URLs and those without ``://`` have an empty host and path and fit no
rule. Rows are kept one to one. Rules with a null in them are left out.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import table

FILE_BYTES = 1 << 28
SEED = 42  # that of Spark's xxhash64
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(s: str) -> int:
    return xxhash.xxh64_intdigest(s, seed=SEED)


class DigestArray:
    """One file: n, then n sorted digests, n + 1 offsets of the strings, n lengths of the hosts, n actions, the strings."""

    def __init__(self, place: str):
        n = int(np.fromfile(place, np.int64, 1)[0])
        at = 8
        parts = []
        for kind, size in ((np.uint64, n), (np.int64, n + 1), (np.int32, n), (np.uint8, n)):
            parts.append(np.memmap(place, kind, "r", at, (size,)) if size else np.zeros(0, kind))
            at += size * np.dtype(kind).itemsize
        self.digests, self.offsets, self.hosts, self.block = parts
        self.text = np.memmap(place, np.uint8, "r", at) if n and os.path.getsize(place) > at else np.zeros(0, np.uint8)

    @staticmethod
    def write(place: str, rows: list[tuple[int, str, int, bool]]) -> None:
        """rows: (digest, string, length of the host, whether it blocks), in the order of the digests."""
        text = [r[1].encode() for r in rows]
        with open(place, "wb") as f:
            for part, kind in (([len(rows)], np.int64), ([r[0] for r in rows], np.uint64), (np.cumsum([0, *map(len, text)]), np.int64), ([r[2] for r in rows], np.int32), ([r[3] for r in rows], np.uint8)):
                f.write(np.asarray(part, kind).tobytes())
            f.write(b"".join(text))

    def lookup(self, strings: list[str], hosts: list[int], keys: np.ndarray | None = None) -> np.ndarray:
        """The place of each string's rule, -1 where there is none; the split into host and path must agree too."""
        found = np.full(len(strings), -1, np.int64)
        if not len(self.digests) or not strings:
            return found
        keys = np.fromiter(map(digest, strings), np.uint64, len(strings)) if keys is None else keys
        at = np.searchsorted(self.digests, keys)
        for i in np.nonzero(self.digests[np.minimum(at, len(self.digests) - 1)] == keys)[0]:
            k = int(at[i])
            while k < len(self.digests) and self.digests[k] == keys[i]:
                if self.hosts[k] == hosts[i] and self.string(k) == strings[i]:
                    found[i] = k
                    break
                k += 1
        return found

    def string(self, k: int) -> str:
        return self.text[self.offsets[k] : self.offsets[k + 1]].tobytes().decode()


def suffixes(host: str) -> list[str]:
    out = [host] if host else []
    while (dot := host.find(".")) >= 0:
        host = host[dot + 1 :]
        if host:
            out.append(host)
    return out


def _sorted_rules(rules: list[tuple[str, str, str]] | DataFrame) -> tuple[Iterable[tuple[int, str, int, bool]], list[int]]:
    """Distinct rules in the order of their digests, and the lengths that their paths have."""
    if not isinstance(rules, DataFrame):
        block: dict[tuple[str, str], bool] = {}
        for action, host, path in rules:
            if action is not None and host is not None and path is not None:
                block[host, path] = block.get((host, path), False) or action == "block"
        return sorted((digest(h + p), h + p, len(h), b) for (h, p), b in block.items()), sorted({len(p) for _, p in block})
    action, host, path = (F.col(c) for c in rules.columns[:3])
    one = rules.select(action.alias("a"), host.alias("h"), path.alias("p")).dropna().groupBy("h", "p").agg(F.bool_or(F.col("a") == "block").alias("b"))
    lengths = sorted(r[0] for r in one.select(F.length("p")).distinct().collect())  # no more than the longest path has characters
    rows = one.select(F.xxhash64(F.concat("h", "p")).alias("d"), F.concat("h", "p").alias("s"), F.length("h").alias("n"), "b").orderBy(F.col("d").bitwiseXOR(F.lit(-(1 << 63))), "s", "n")
    return ((r.d % (1 << 64), r.s, r.n, r.b) for r in rows.toLocalIterator(prefetchPartitions=True)), lengths


def _files(rows: Iterable[tuple[int, str, int, bool]], file_bytes: int) -> list[str]:
    folder = tempfile.mkdtemp(prefix="rules-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)  # executors that come later fetch them from here
    places, held, size = [], [], 0

    def flush() -> None:
        if held:
            places.append(os.path.join(folder, f"rules-{uuid.uuid4().hex}.bin"))
            DigestArray.write(places[-1], held)

    for row in rows:
        if held and size + 4 * len(row[1]) + 21 > file_bytes:
            flush()
            held, size = [], 0
        held.append(row)
        size += 4 * len(row[1]) + 21
    flush()
    return places


_open: dict[str, DigestArray] = {}


def _array(name: str) -> DigestArray:
    if name not in _open:
        _open[name] = DigestArray(SparkFiles.get(name))
    return _open[name]


def _candidates(hosts: pa.Array, paths: pa.Array, lengths: list[int]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Distinct candidate strings with the lengths of their hosts, and the rows and strings of each candidate of a row."""
    coded = hosts.dictionary_encode()
    ends = [suffixes(h) for h in coded.dictionary.to_pylist()]
    names = {s: k for k, s in enumerate(dict.fromkeys(s for e in ends for s in e))}
    count = np.array([len(e) for e in ends], np.int64)
    begin, flat = np.cumsum(count) - count, np.array([names[s] for e in ends for s in e], np.int64)
    code = coded.indices.to_numpy(zero_copy_only=False)
    long = pc.utf8_length(paths).to_numpy(zero_copy_only=False)
    heads: list[str] = []
    of: list[list[np.ndarray]] = [[], [], []]
    for n in lengths:
        rows = np.nonzero(long >= n)[0]
        cut = pc.utf8_slice_codeunits(paths.take(pa.array(rows)), 0, n).dictionary_encode()
        some = count[code[rows]]
        owner = np.repeat(np.arange(len(rows)), some)
        of[0].append(rows[owner])
        of[1].append(flat[np.arange(len(owner)) + np.repeat(begin[code[rows]] - np.cumsum(some) + some, some)] if len(owner) else owner)
        of[2].append(len(heads) + cut.indices.to_numpy(zero_copy_only=False).astype(np.int64)[owner])
        heads += cut.dictionary.to_pylist()
    row, end, head = (np.concatenate([np.zeros(0, np.int64), *x]) for x in of)
    pair, which = np.unique(end * max(1, len(heads)) + head, return_inverse=True)
    ordered = list(names)
    split = [(ordered[e], heads[h]) for e, h in (divmod(x, max(1, len(heads))) for x in pair.tolist())]
    return [e + h for e, h in split], np.array([len(e) for e, _ in split], np.int64), row, which


def judge(df: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, url: str = "url", default: str = "allow", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Add ``host``, ``path``, ``rule`` (null where none fits) and ``verdict`` to all columns; those of these names give way.

    rules: (action, host, path), as a list or as a table's first three columns.
    """
    new = ("host", "path", "rule", "verdict")
    keep = [c for c in df.columns if c not in new]
    base = df.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    rows, lengths = _sorted_rules(rules)
    places = _files(rows, file_bytes)
    for place in places:
        df.sparkSession.sparkContext.addFile(place)
    files = [os.path.basename(p) for p in places]
    schema = T.StructType([*base.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            strings, ends, row, which = _candidates(batch.column("host"), batch.column("path"), lengths)
            keys = np.fromiter(map(digest, strings), np.uint64, len(strings))
            action = np.zeros(len(strings), np.int8)  # 0 no rule, 1 allow, 2 block
            for name in files:
                array = _array(name)
                found = array.lookup(strings, ends, keys)
                action[found >= 0] = 1 + array.block[found[found >= 0]]
            size = np.array([len(s) for s in strings], np.int64)
            hit = action[which] > 0
            row, which = row[hit], which[hit]
            order = np.lexsort((ends[which], size[which], row))
            row, which = row[order], which[order]
            last = np.append(row[1:] != row[:-1], True)[: len(row)]
            rule, verdict = np.full(batch.num_rows, None, object), np.full(batch.num_rows, default, object)
            rule[row[last]] = [strings[k] for k in which[last]]
            verdict[row[last]] = ["block" if action[k] == 2 else "allow" for k in which[last]]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rule.tolist(), pa.string()), pa.array(verdict.tolist(), pa.string())], names=[*batch.schema.names, "rule", "verdict"])

    return base.mapInArrow(run, schema)


RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = """
WITH rules(action, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
u AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT k, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM u),
hits AS (SELECT k, rh || rp AS rule, action, row_number() OVER (PARTITION BY k ORDER BY length(rh || rp) DESC, length(rh) DESC) AS n
         FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM p LEFT JOIN (SELECT * FROM hits WHERE n = 1) USING (k)
"""
