"""Exact Jaccard self-join of word-shingle sets by universe partitioning.

Two sets whose Jaccard similarity is at least 3/4 differ in at most (|R| + |S|) / 7 tokens. Sets are grouped into size
bands, each reaching to 4/3 of its lower end, so a pair lies in one band or in two neighbours. The band of the smaller
set fixes a scheme: tokens are hashed into m segments, q of which are indexed with their one-deletion neighbourhoods.
A plain segment stands for one unit, one with deletions for two; when the units come to more than the tokens that may
differ, some segment agrees (is equal, or equal but for one token). The split between plain segments and deletions is
allocated by cost for each band. A segment of which nothing is left says nothing and is not indexed; the schemes have
spare units for these, and a set that has used them up is indexed under another hash seed as well.

Equal sets are one node. Signatures travel in packed blocks by hash, so no band or segment meets in one task. A
signature that more than ``LOCAL`` nodes of one slice of texts share is combined before the shuffle: these nodes make a
group, and only the group's name goes on, so the task that gets a hot signature holds ``LOCAL`` names for each slice at
most. Signatures shared by few nodes give all their pairs; one shared by many nodes or by groups gives a star around its
least node and is kept aside. Candidates pass a bitmap of token parities (a lower bound of the difference) and are then verified on the
tokens. Verified links join nodes into components; after that only pairs of different components are looked at: the
candidates left over and, tile by tile, those of the signatures kept aside: of each the nodes that are not of its largest
component with all others, the likeliest pair of two components first. So a group of near copies costs about a star, and no
link is lost. Tokens are 64-bit hashes of five lower-cased words.

Defined results: a text with fewer than five words is one shingle, one without words has none, size 0 and no links;
null ids have no component; rows that share an id are one vertex; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import cut, drop_cut, mix, slices, span_hashes, table, utf8_buffer, word_spans
from .components import components

WORDS = 5
#: Similarity as a ratio of whole numbers.
NUM, DEN = 3, 4
FEW = 16  # nodes of a signature up to which all their pairs are candidates
LOCAL = 8  # nodes of a signature in one slice of texts that are sent one by one
ROWS_BYTES = 4 << 20
SIGNED_BYTES = 4 << 20  # of text whose signatures are combined before the shuffle
TILE = 1024
PAIRS = 500_000  # of tiles that a task holds
BLOCK_SIGNATURES = 4_000_000
SEEDS = 3
MAX_BROADCAST_IDS = 1_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


@lru_cache
def bands() -> list[int]:
    edges = [1]
    while edges[-1] < 1 << 40:
        edges.append(-(-edges[-1] * DEN // NUM))
        edges[-1] += edges[-1] == edges[-2]
    return edges


def differ(a: int, b: int) -> int:
    """The most tokens in which linked sets of these sizes differ."""
    return (a + b) * (DEN - NUM) // (DEN + NUM)


@lru_cache
def scheme(band: int) -> tuple[int, int, int]:
    """(segments, those with deletions, spare units) at the least expected number of signatures."""
    low, high = bands()[band], bands()[band + 1] - 1
    need = differ(high, high * DEN // NUM) + 1
    if need == 1:
        return 1, 0, 0
    best = (math.inf, need, 0, 0)
    for spare in sorted({0, 1, 2, 3, *(math.ceil(need * x) for x in (0.05, 0.08, 0.1, 0.12, 0.15, 0.2, 0.3))}):
        units = need + spare
        for share in (0, 0.1, 0.25, 0.5, 1):
            m = math.ceil(units / (1 + share))
            q = units - m
            if q > m or m < 1:
                continue
            fill = low / m
            empty = math.exp(-fill) if m > 1 else 0.0
            weak = (m - q) * empty + 2 * q * empty * (1 + fill)
            # Chance that more units than the spare ones are weak, from the Poisson distribution.
            term, below = math.exp(-weak), 0.0
            for k in range(spare + 1):
                below += term
                term *= weak / (k + 1)
            again = min(1.0, max(0.0, 1 - below))
            rows = (m - q) + q * (1 + high / m)
            cost = rows * (1 + again + 20 * again**SEEDS)
            if cost < best[0]:
                best = cost, m, q, spare
    return best[1:]


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    data, offsets = utf8_buffer(column)
    data = _LOWER[data]
    starts, ends, at = word_spans(data, offsets)
    words = span_hashes(data, starts, ends)
    joined = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k in range(WORDS):
        joined = mix(joined + words[k : k + len(joined)] + np.uint64(k + 1))
    out = []
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if hi - lo >= WORDS:
            s = np.sort(joined[lo : hi - WORDS + 1])
            if len(s) > 1:
                s = s[np.concatenate([[True], s[1:] != s[:-1]])]
        elif hi > lo:
            s = np.array([hi - lo], np.uint64)
            for w in words[lo:hi]:
                s = mix(s * np.uint64(31) + w)
        else:
            s = np.zeros(0, np.uint64)
        out.append(s)
    return out


def node_of(s: np.ndarray) -> int:
    """A 64-bit name of a set."""
    x = mix(np.array([s.sum(dtype=np.uint64) ^ np.uint64(len(s)), np.bitwise_xor.reduce(s)], np.uint64))
    return int(mix(x[:1] + x[1:] * np.uint64(3)).view(np.int64)[0])


def bitmap(s: np.ndarray) -> bytes:
    """Parities of the tokens by hash, in about two bits a token (a power of two)."""
    bits = max(64, 1 << (2 * len(s) - 1).bit_length())
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(a: np.ndarray, words: int) -> np.ndarray:
    while a.shape[-1] > words:
        half = a.shape[-1] // 2
        a = a[..., :half] ^ a[..., half:]
    return a


def signatures(s: np.ndarray, band: int) -> np.ndarray:
    """The 64-bit signatures of a set under a band's scheme."""
    m, q, spare = scheme(band)
    out = []
    for seed in range(SEEDS):
        tag = int(mix(np.array([band * SEEDS + seed + 1], np.uint64))[0])
        segment = ((((s * np.uint64(tag | 1)) >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
        total = np.zeros(m, np.uint64)
        np.add.at(total, segment, s)
        count = np.bincount(segment, minlength=m)
        name = mix(np.arange(m, dtype=np.uint64) + np.uint64(tag))
        out.append(mix(total + name)[count > 0])
        if q:
            part = segment[(segment < q) & (count[segment] > 1)]
            out.append(mix(total[part] - s[(segment < q) & (count[segment] > 1)] + name[part]))
        weak = int((count[q:] == 0).sum()) + 2 * int((count[:q] <= 1).sum()) if m > 1 else 0
        if weak <= spare:
            return np.concatenate(out)
    return np.concatenate([*out, mix(np.array([tag], np.uint64))])  # all sets of this band that no seed spreads


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary())], names=["doc_id", "n_shingles", "node", "bits"])


def _run_names(names: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit name for each run of nodes, whatever their order."""
    x = mix(names.view(np.uint64))
    total, odd = np.add.reduceat(x, first), np.bitwise_xor.reduceat(x, first)
    return mix(mix(total ^ size.astype(np.uint64)) + mix(odd) * np.uint64(3)).view(np.int64)


def _fold_hot(sig: np.ndarray, who: np.ndarray, names: np.ndarray, bands_: np.ndarray) -> tuple:
    """A slice's signatures with one entry for each that many of its nodes share.

    who is twice a node's place, plus one for the scheme of the band below. Returns the signatures left, their who,
    names and bands with those of the groups at the end, the groups' least nodes, and the places of their nodes by name.
    """
    order = np.argsort(sig, kind="stable")
    key = sig[order]
    first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
    size = np.diff(np.append(first, len(key)))
    order, size = order[np.repeat(size > LOCAL, size)], size[size > LOCAL]
    if not len(size):
        return sig, who, names, bands_, np.zeros(0, np.int64), {}
    first = np.cumsum(size) - size
    of = who[order] >> 1
    group = _run_names(names[of], first, size)
    band = bands_[of[first]] - (who[order[first]] & 1).astype(np.uint8)
    _, one, at = np.unique(mix(group.view(np.uint64) + band), return_index=True, return_inverse=True)
    members = {int(group[k]): of[first[k] : first[k] + size[k]] for k in one.tolist()}
    keep, who = np.ones(len(sig), bool), who.copy()
    keep[order] = False
    keep[order[first]] = True
    who[order[first]] = 2 * (len(names) + at)
    return sig[keep], who[keep], np.append(names, group[one]), np.append(bands_, band[one]), np.minimum.reduceat(names[of], first)[one], members


def _pack_groups(names: np.ndarray, members: dict[int, np.ndarray]) -> bytes:
    every = np.concatenate(list(members.values()))
    used = np.unique(every)
    kind = np.uint16 if len(used) < 1 << 16 else np.uint32
    sizes = np.array([len(m) for m in members.values()], np.int32)
    head = np.array([-1, len(used), len(members), kind().itemsize], np.int32)
    places = np.searchsorted(used, every).astype(kind)
    return b"".join(x.tobytes() for x in (head, names[used], np.array(list(members), np.int64), sizes, places))


def _unpack_groups(packed: bytes) -> list[tuple[int, np.ndarray]]:
    """Names of groups and their nodes, sorted."""
    _, used, n, width = np.frombuffer(packed, np.int32, 4).tolist()
    nodes = np.frombuffer(packed, np.int64, used, 16)
    names = np.frombuffer(packed, np.int64, n, 16 + 8 * used).tolist()
    ends = np.cumsum(np.frombuffer(packed, np.int32, n, 16 + 8 * (used + n)))
    places = np.frombuffer(packed, np.uint16 if width == 2 else np.uint32, -1, 16 + 8 * used + 12 * n)
    return [(name, np.sort(nodes[p])) for name, p in zip(names, np.split(places, ends[:-1]), strict=True)]


def _signed(blocks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edges = np.array(bands())
        for batch in batches:
            for part in slices(batch, "text", SIGNED_BYTES):
                nodes, band_of, sigs, counts = [], [], [], []
                seen: set[int] = set()
                for s in shingle_sets(part.column("text")):
                    if not len(s) or (node := node_of(s)) in seen:
                        continue
                    seen.add(node)
                    band = int(np.searchsorted(edges, len(s), side="right")) - 1
                    own = [signatures(s, b) for b in (band, band - 1) if b >= 0]
                    nodes.append(node)
                    band_of.append(band)
                    sigs += own
                    counts += [len(own[0]), len(own[1]) if band else 0]
                if not nodes:
                    continue
                found = np.concatenate(sigs), np.repeat(np.arange(len(counts)), counts)
                sig, who, names, bands_, least, members = _fold_hot(*found, np.array(nodes, np.int64), np.array(band_of, np.uint8))
                where = ((sig >> np.uint64(40)) % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(where, kind="stable")
                cuts = np.searchsorted(where[order], np.arange(blocks + 1))
                rows = [(nodes[0] % blocks, _pack_groups(names, members))] if members else []
                for k in np.nonzero(np.diff(cuts))[0].tolist():
                    at = order[cuts[k] : cuts[k + 1]]
                    each = np.bincount(who[at], minlength=2 * len(names)).reshape(-1, 2)  # of the own scheme and of the one below
                    used = np.nonzero(each.sum(1))[0]
                    groups = used[used >= len(nodes)] - len(nodes)
                    kind = np.uint8 if each.max() < 1 << 8 else np.uint32
                    head = np.array([len(used), len(at), kind().itemsize, len(groups)], np.int32)
                    rows.append((k, b"".join(x.tobytes() for x in (head, names[used], least[groups], bands_[used], each[used].astype(kind), sig[at[np.argsort(who[at], kind="stable")]].astype(np.uint32)))))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["block", "packed"])

    return run


def _unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures, the names of their nodes or groups, and the nodes or the groups' least nodes."""
    used, n, width, groups = np.frombuffer(packed, np.int32, 4).tolist()
    names = np.frombuffer(packed, np.int64, used, 16)
    least = np.concatenate([names[: used - groups], np.frombuffer(packed, np.int64, groups, 16 + 8 * used)])
    at = 16 + 8 * (used + groups)
    band = np.frombuffer(packed, np.uint8, used, at)
    each = np.frombuffer(packed, np.uint8 if width == 1 else np.uint32, 2 * used, at + used)
    sig = np.frombuffer(packed, np.uint32, n, at + (1 + 2 * width) * used)
    under = np.stack([band, band - np.minimum(band, 1)], 1).reshape(-1)
    all_of = lambda x: np.repeat(np.repeat(x, 2), each)
    return sig.astype(np.uint64) | (np.repeat(under, each).astype(np.uint64) << np.uint64(32)), all_of(names), all_of(least)


def _star(nodes: np.ndarray) -> np.ndarray:
    """Pairs of the least of sorted distinct nodes with each of the others."""
    return np.stack([np.full(len(nodes) - 1, nodes[0]), nodes[1:]], 1)


def _matches(key: np.ndarray, name: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Pairs of nodes that share a signature (all pairs of a few, else a star), and, under names of their own, the names of signatures that many or groups share."""
    order = np.argsort(key, kind="stable")
    key, name, node = key[order], name[order], node[order]
    again = np.zeros(len(key), bool)
    again[1:] = key[1:] == key[:-1]
    shared = again.copy()
    shared[:-1] |= again[1:]
    key, name, node = key[shared], name[shared], node[shared]
    order = np.lexsort((name, key))
    key, name, node = key[order], name[order], node[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (name[1:] != name[:-1])
    key, name, node = key[new], name[new], node[new]
    first = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0] if len(key) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([first, [len(key)]]))
    grouped = np.add.reduceat(name != node, first) > 0 if len(key) else np.zeros(0, bool)
    pairs, many = [np.zeros((0, 2), np.int64)], []
    for n in range(2, FEW + 1):
        at = first[(size == n) & ~grouped]
        i, j = np.triu_indices(n, 1)
        pairs.append(np.unique(np.stack([node[(at[:, None] + i).ravel()], node[(at[:, None] + j).ravel()]], 1), axis=0))
    large = (size > FEW) | (grouped & (size > 1))
    if large.any():
        runs, one = np.unique(_run_names(name, first, size)[large], return_index=True)
        for run, a, n in zip(runs.tolist(), first[large][one].tolist(), size[large][one].tolist(), strict=True):
            many.append((run, name[a : a + n]))
            pairs.append(_star(np.unique(node[a : a + n])))
    return np.unique(np.concatenate(pairs), axis=0), many


def _many_rows(many: list[tuple[int, np.ndarray]], upper: bool) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for k, (name, own) in enumerate(many):
        held.append((name, len(own), own.tobytes()))
        size += 8 * len(own)
        if size > ROWS_BYTES or k == len(many) - 1:
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.array([h[2] for h in held], pa.binary()), pa.array([upper] * len(held))], names=["a", "b", "many", "upper"])
            held, size = [], 0


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _many_rows packed, a row for each name."""
    for batch in batches:
        for part in slices(batch, "many"):
            names = np.frombuffer(b"".join(part.column("many").to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part.column("a").to_numpy(), part.column("b").to_numpy())), pa.array(names)], names=["bucket", "name"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[bytes]] = {}

    def rows(pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(pairs), 100_000):
            p = pairs[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(p[:, 0]), pa.array(p[:, 1]), pa.nulls(len(p), pa.binary()), pa.nulls(len(p), pa.bool_())], names=["a", "b", "many", "upper"])

    for batch in batches:
        for block, packed in zip(batch.column("block").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            if np.frombuffer(packed, np.int32, 1)[0] < 0:
                groups = _unpack_groups(packed)
                yield from rows(np.unique(np.concatenate([_star(own) for _, own in groups]), axis=0))
                yield from _many_rows(groups, False)
            else:
                held.setdefault(block, []).append(packed)
    for block in list(held):
        got = [_unpack(x) for x in held.pop(block)]
        pairs, many = _matches(*(np.concatenate(x) for x in zip(*got, strict=True)))
        yield from rows(pairs)
        yield from _many_rows(many, True)


def _near(bits_a: list[bytes], bits_b: list[bytes], n_a: np.ndarray, n_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs the sizes and the parities of their tokens leave possible, and in how many of these they differ."""
    ok, gap = np.minimum(n_a, n_b) * DEN >= np.maximum(n_a, n_b) * NUM, np.zeros(len(n_a), np.int64)
    most = (n_a + n_b) * (DEN - NUM) // (DEN + NUM)
    for i in np.nonzero(ok)[0].tolist():
        a, b = np.frombuffer(bits_a[i], np.uint64), np.frombuffer(bits_b[i], np.uint64)
        w = min(len(a), len(b))
        gap[i] = np.bitwise_count(fold(a, w) ^ fold(b, w)).sum()
        ok[i] = gap[i] <= most[i]
    return ok, gap


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok, gap = _near(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy())
        yield batch.select(["a", "b", "doc_a", "doc_b"]).append_column("gap", pa.array(gap)).filter(pa.array(ok))


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            sets = shingle_sets(part.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "tokens"])


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(a) + len(b)
    inter = len(np.intersect1d(a, b, assume_unique=True))
    return inter * DEN >= (both - inter) * NUM


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(batch.column("tokens_a").to_pylist(), batch.column("tokens_b").to_pylist(), strict=True)]
        yield batch.select(["doc_a", "doc_b"]).filter(pa.array(ok, pa.bool_()))


def _tile_pairs(rows: pa.Table, every: bool) -> np.ndarray:
    """(a, b, doc_a, doc_b, component_a, component_b, gap) of a tile's rows aside with its other rows, where components differ and the pair is possible.

    Unless every, of a row aside only the likeliest pair with each component.
    """
    at, left = rows.select(["node", "doc_id", "component", "n"]).to_pandas().to_numpy(np.int64), rows.column("left").to_numpy()
    bits, free = rows.column("bits").to_pylist(), ~rows.column("aside").to_numpy()[~left]
    words = min(map(len, bits)) // 8
    bits = np.stack([fold(np.frombuffer(x, np.uint64), words) for x in bits])
    x, y, la, ra, out = bits[left], bits[~left], at[left], at[~left], [np.zeros((0, 7), np.int64)]
    for i, (node, doc, component, n) in enumerate(la.tolist()):
        # Two that are both aside meet in two tiles.
        k = np.nonzero((ra[:, 2] != component) & (free | (ra[:, 0] > node)) & (np.minimum(n, ra[:, 3]) * DEN >= np.maximum(n, ra[:, 3]) * NUM))[0]
        gap = np.bitwise_count(y[k] ^ x[i]).sum(1, dtype=np.int64)
        ok = gap <= (n + ra[k, 3]) * (DEN - NUM) // (DEN + NUM)
        k, gap = k[ok], gap[ok]
        if not every and len(k) > 1:
            order = np.lexsort((ra[k, 0], gap, ra[k, 2]))
            order = order[np.unique(ra[k[order], 2], return_index=True)[1]]
            k, gap = k[order], gap[order]
        if len(k):
            own = np.broadcast_to(la[i, :3], (len(k), 3))
            first, second = np.where((ra[k, 0] > node)[:, None], own, ra[k, :3]), np.where((ra[k, 0] > node)[:, None], ra[k, :3], own)
            out.append(np.concatenate([np.stack([first, second], 2).reshape(len(k), 6), gap[:, None]], 1))
    return np.concatenate(out)


_PAIR = ["a", "b", "doc_a", "doc_b", "component_a", "component_b", "gap"]


def _tiled(every: bool):
    """_tile_pairs of each tile of rows that come sorted by bucket, i and j; pairs met several times between two batches count once."""

    def shown(out: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(map(pa.array, np.unique(np.concatenate(out), axis=0).T)), names=_PAIR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, out, size = None, [], [], 0
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("bucket", "i", "j")], 1)
            cuts = [0, *(np.nonzero((key[1:] != key[:-1]).any(1))[0] + 1).tolist(), len(key)]
            for lo, hi in zip(cuts[: len(cuts) - 1 if len(key) else 0], cuts[1:], strict=False):
                if rows and tuple(key[lo].tolist()) != now:
                    out.append(_tile_pairs(pa.Table.from_batches(rows), every))
                    rows, size = [], size + len(out[-1])
                    if size > PAIRS:
                        yield shown(out)
                        out, size = [], 0
                now = tuple(key[lo].tolist())
                rows.append(batch.slice(lo, hi - lo))
        if rows:
            out.append(_tile_pairs(pa.Table.from_batches(rows), every))
        if out:
            yield shown(out)

    return run


def _verify(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b, doc_a, doc_b) that are linked, as (doc_a, doc_b). Only the texts that they name are read into sets."""
    ids = cut(pairs.select(F.col("doc_a").alias("doc_id")).union(pairs.select("doc_b")).distinct(), "ids")
    wanted = docs.join(F.broadcast(ids) if ids.count() <= MAX_BROADCAST_IDS else ids, "doc_id", "left_semi")
    sets = cut(wanted.select("text").mapInArrow(_set_rows, "node long, tokens binary").dropDuplicates(["node"]), "sets")
    rows = pairs.join(sets.select(F.col("node").alias("b"), F.col("tokens").alias("tokens_b")), "b").join(sets.select(F.col("node").alias("a"), F.col("tokens").alias("tokens_a")), "a")
    out = cut(rows.select("doc_a", "doc_b", "tokens_a", "tokens_b").mapInArrow(_verified, "doc_a long, doc_b long").distinct(), "verified")
    drop_cut(ids, sets)
    return out


def _apart(pairs: DataFrame, part: DataFrame) -> DataFrame:
    """pairs(a, b, doc_a, doc_b, gap) of different components, with these."""
    of = lambda x: part.select(F.col("id").alias(f"doc_{x}"), F.col("component").alias(f"own_{x}"))
    both = pairs.join(of("a"), "doc_a", "left").join(of("b"), "doc_b", "left").withColumns({f"component_{x}": F.coalesce(f"own_{x}", f"doc_{x}") for x in "ab"})
    return both.where("component_a <> component_b").select(*_PAIR)


def join_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), one row for each row of docs. doc_id must be a whole number."""
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = cut(docs.mapInArrow(_nodes, "doc_id long, n_shingles long, node long, bits binary"), "nodes")
    nodes = cut(rows.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n"), F.first("bits").alias("bits")), "classes")
    tokens = nodes.agg(F.sum("n")).first()[0] or 0
    blocks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tokens // BLOCK_SIGNATURES + 1)
    packed = docs.where("doc_id is not null").select("text").mapInArrow(_signed(blocks), "block int, packed binary")
    found = cut(packed.repartition(blocks, "block").mapInArrow(_candidates, "a long, b long, many binary, upper boolean"), "found")
    pairs = found.where("many is null").select("a", "b").distinct()
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("doc_id").alias(f"doc_{x}"), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    possible = cut(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_possible, "a long, b long, doc_a long, doc_b long, gap long"), "possible")
    # First one edge for each node, to the least node that it may be linked with.
    least = possible.groupBy("b").agg(F.min_by(F.struct("a", "doc_a", "doc_b"), "a").alias("x")).select("x.a", "b", "x.doc_a", "x.doc_b")
    first = cut(least, "least")
    links = _verify(docs, first)
    part = components(links.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")))
    # Then whatever else might join different components.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = lambda upper: found.where(f"upper = {upper}").dropDuplicates(["a"]).select("a", "b", "many").mapInArrow(_listed, "bucket long, name long")
    # The likeliest pairs of two components first, then all of those between components that had some and are still apart.
    for likely in (True, False):
        own = nodes.select("node", "doc_id").join(part.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("node", F.coalesce("component", "doc_id").alias("component"))
        named = own if likely else own.join(open_, "component", "left_semi")
        groups = cut(listed("false").withColumnRenamed("name", "node").join(named, "node").select("bucket", "node", "component"), "groups")
        # Only signatures with more than one component are laid out node by node; a group counts by its least and greatest component.
        span = groups.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"))
        entries = listed("true").join(span.withColumnRenamed("bucket", "name"), "name", "left").join(named.withColumnRenamed("node", "name"), "name", "left")
        entries = cut(entries.select("bucket", "name", F.coalesce("low", "component").alias("low"), F.coalesce("high", "component").alias("high"), F.col("low").isNotNull().alias("is_group")).where("low IS NOT NULL"), "entries")
        # A group that a signature names is laid out there.
        alone = span.where("low <> high").select("bucket").join(entries.where("is_group").select(F.col("name").alias("bucket")), "bucket", "left_anti")
        mixed = entries.join(entries.groupBy("bucket").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least <> most").select("bucket"), "bucket", "left_semi")
        laid_out = mixed.where("is_group").select(F.col("bucket").alias("of"), F.col("name").alias("bucket")).join(groups, "bucket").select(F.col("of").alias("bucket"), "node", "component")
        members = cut(groups.join(alone, "bucket", "left_semi").unionByName(laid_out).unionByName(mixed.where("not is_group").select("bucket", F.col("name").alias("node"), F.col("low").alias("component"))).distinct(), "members")
        # Of a signature the nodes aside, which are not of its largest component, are compared with all others.
        sizes = members.groupBy("bucket", "component").agg(F.count("*").alias("k")).groupBy("bucket").agg(F.max_by("component", "k").alias("main"), F.sum("k").alias("all"), F.max("k").alias("of_main"))
        placed = members.join(sizes, "bucket").join(nodes, "node").withColumns({"aside": F.col("component") != F.col("main"), "rows": F.ceil((F.col("all") - F.col("of_main")) / TILE).cast("int"), "columns": F.ceil(F.col("all") / TILE).cast("int")})
        place = lambda of: F.pmod(F.xxhash64("node"), F.col(of)).cast("int")
        along = lambda of, cell: F.transform(F.sequence(F.lit(0), F.col(of) - 1), lambda k: F.struct(*(x.alias(c) for c, x in zip(("i", "j", "left"), cell(k), strict=True))))
        cells = F.concat(along("rows", lambda k: (k, place("columns"), F.lit(False))), F.when(F.col("aside"), along("columns", lambda k: (place("rows"), k, F.lit(True)))).otherwise(F.array().cast("array<struct<i:int,j:int,left:boolean>>")))
        spread = placed.select("bucket", F.explode(cells).alias("cell"), "node", "doc_id", "component", "n", "aside", "bits").select("bucket", "cell.*", "node", "doc_id", "component", "n", "aside", "bits")
        # By number, as bytes say little about a tile's work.
        dealt = spread.repartition(4 * parts, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
        rest = cut(_apart(possible, part).unionByName(dealt.mapInArrow(_tiled(not likely), ", ".join(f"{c} long" for c in _PAIR))).dropDuplicates(["a", "b"]), "rest")
        best = rest.groupBy(F.least("component_a", "component_b"), F.greatest("component_a", "component_b")).agg(F.min_by(F.struct("a", "b", "doc_a", "doc_b"), F.struct("gap", "a", "b")).alias("x")).select("x.*")
        more = cut(best if likely else rest.select("a", "b", "doc_a", "doc_b"), "more")
        if more.limit(1).count():
            links = links.unionByName(_verify(docs, more))
            part = components(links.select(F.col("doc_a").alias("a"), F.col("doc_b").alias("b")))
        open_ = cut(_apart(rest.select("a", "b", "doc_a", "doc_b", "gap"), part).select(F.explode(F.array("component_a", "component_b")).alias("component")).distinct(), "open")
        drop_cut(groups, entries, members, rest, more)
        if not open_.limit(1).count():
            break
    drop_cut(found, possible, first)  # nothing below reads them
    named = nodes.select("node", "doc_id").join(part.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("node", F.coalesce("component", "doc_id").alias("component"))
    out = rows.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i+4], ' ') END AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inter FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inter >= 75 * (x.n + y.n - inter)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (WITH RECURSIVE r(id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE e.b > r.c) SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(r.c, w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN r ON r.id = w.doc_id
"""
