"""Token counts by a finite-state transducer compiled from a BPE vocabulary.

A BPE encoding is the one token sequence in which every adjacent pair is stable (merging the pair's text gives the
pair back). So the last token of each prefix follows from the last tokens of the shorter prefixes that a vocabulary
entry reaches back to, and a left-to-right machine can carry just those: its state is the set of live vocabulary
prefixes, each with the token before it and the tokens counted since. Transitions carry the change of the token
count; a merge may make it negative. States are determinised on demand, as regex engines do. A slice of texts is run in
blocks of ``BLOCK`` symbols; between two of them the table is dropped and begun anew once it holds ``MAX_STATES``, with
the state reached carried over, so it never holds more than ``MAX_STATES + BLOCK`` states.

Texts of a slice are laid end to end and cut into equal chunks, which run side by side in numpy. A chunk's state
map is constant from its first synchronising symbol (a space, a text's start or a character that merges with
nothing). Chunks without one have maps that are evaluated where needed and composed by a parallel prefix scan; then the
heads of the other chunks are run from the states found.

Nulls and empty texts count no tokens. Rows are kept one to one, repeated and null ids too. The largest unit of
work is one text, which a row holds anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import slices, utf8_buffer

SPACE = "▁"
CHUNK = 512
BLOCK = 1 << 20
MAX_STATES = 150_000
#: Up to so many vocabulary entries under a prefix, contexts that allow the same ones count as one.
FEW = 32
OVER_LIMIT = 4096
_BOS = -1


class Machine:
    """A counting transducer, determinised lazily. Build it with :meth:`from_sentencepiece`."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        self.rank = {p: -score for p, score in pieces}
        self.edges: dict[int, tuple[list, list] | None] = {}
        self.names = [p for p, _ in pieces]
        self.weight = [1] * len(pieces)
        ids = {p: i for i, p in enumerate(self.names)}
        letters = {c for p in self.names if len(p) > 1 for c in p} | {SPACE}
        for c in sorted(letters - ids.keys()):  # a letter that has no piece of its own
            ids[c] = len(self.names)
            self.names.append(c)
            self.weight.append(len(c.encode()) if byte_fallback else 1)
        if any(SPACE in p.lstrip(SPACE) for p in self.names):
            raise ValueError("a piece goes on from a letter to a space: words would not synchronise")
        self.children: list[dict[str, int]] = [{}]
        self.token = [-1]
        for p, i in ids.items():
            if len(p) == 1 and p not in letters:
                continue
            node = 0
            for c in p:
                node = self.children[node].setdefault(c, len(self.children))
                if node == len(self.token):
                    self.children.append({})
                    self.token.append(-1)
            self.token[node] = i
        self.below: list[list[int] | None] = [[] for _ in self.token]  # tokens under a node, None where they are many
        for node in range(len(self.token) - 1, -1, -1):  # children come after their parents
            own: list[int] | None = []
            for child in self.children[node].values():
                more = self.below[child]
                if own is None or more is None or len(own) + len(more) >= FEW:
                    own = None
                    break
                own = own + more + ([self.token[child]] if self.token[child] >= 0 else [])
            self.below[node] = own
        self.alike: dict[tuple, int] = {}
        self.kept: dict[tuple[int, int], int | None] = {}
        # Symbol classes: 0 a text's start, 1 a word's first space, 2..5 characters that stand alone and count 1..4, 6 a further
        # space, then letters. Up to 5 the state that follows is the same whatever came before.
        lone = np.full(0x110000, 2, np.uint8)
        if byte_fallback:
            lone[0x80:], lone[0x800:], lone[0x10000:] = 3, 4, 5
        for p in self.names:
            if len(p) == 1:
                lone[ord(p)] = 2
        self.classes = lone.astype(np.uint16)
        self.letters = ["", SPACE, "", "", "", "", SPACE, *sorted(letters - {SPACE})]
        for i, c in enumerate(self.letters[7:], 7):
            self.classes[ord(c)] = i
        self.classes[ord(" ")] = self.classes[ord(SPACE)] = 1
        self.stable: dict[tuple[int, int], bool] = {}
        self.width = len(self.letters)
        self.clear()

    @classmethod
    def from_sentencepiece(cls, path: str) -> Machine:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        return cls([(sp.id_to_piece(i), sp.get_score(i)) for i in plain], any(sp.is_byte(i) for i in range(sp.get_piece_size())))

    def clear(self) -> None:
        self.states: dict[tuple, int] = {}
        self.defs: list[tuple] = []
        self.next = np.full((1024, self.width), -1, np.int32)
        self.delta = np.zeros((1024, self.width), np.int8)
        self.start = self.state(((), _BOS))  # after a symbol that merges with nothing
        self.space = self.state(self.advance((((), _BOS)), SPACE)[0])

    def state(self, key: tuple) -> int:
        if (n := self.states.get(key)) is None:
            n = self.states[key] = len(self.defs)
            self.defs.append(key)
            if n == len(self.next):
                self.next = np.concatenate([self.next, np.full_like(self.next, -1)])
                self.delta = np.concatenate([self.delta, np.zeros_like(self.delta)])
        return n

    def spines(self, tok: int) -> tuple[list, list] | None:
        """What stands at the left and at the right edge of a token while BPE builds it: (text, time formed, time merged). None if it never comes out whole."""
        if tok not in self.edges:
            text, end = self.names[tok], float("inf")
            parts = [(c, -float("inf")) for c in text]
            left, right = [], []
            while len(parts) > 1:
                ranks = [self.rank.get(parts[i][0] + parts[i + 1][0], end) for i in range(len(parts) - 1)]
                best = min(ranks)
                if best == end:
                    break
                i = ranks.index(best)
                time = max(best, parts[i][1], parts[i + 1][1])
                if i == 0:
                    left.append((*parts[0], time))
                if i == len(parts) - 2:
                    right.append((*parts[-1], time))
                parts[i : i + 2] = [(parts[i][0] + parts[i + 1][0], time)]
            whole = (*parts[0], end)
            self.edges[tok] = ([*left, whole], [*right, whole]) if len(parts) == 1 else None
        return self.edges[tok]

    def fits(self, last: int, tok: int) -> bool:
        """Whether BPE leaves a pair of neighbours as it is: no merge over their border comes before the merges that build them."""
        if (ok := self.stable.get((last, tok))) is None:
            after, before = self.spines(tok), None if last == _BOS else self.spines(last)
            ok = after is not None and (last == _BOS or before is not None)
            if ok and before:
                rank = self.rank
                for x, formed_x, merged_x in before[1]:
                    for y, formed_y, merged_y in after[0]:
                        r = rank.get(x + y)
                        if r is not None and (t := max(r, formed_x, formed_y)) < merged_x and t <= merged_y:
                            ok = False
            self.stable[last, tok] = ok
        return ok

    def advance(self, key: tuple, c: str) -> tuple[tuple, int]:
        threads, last = key
        grown, tok, gain = [], None, 0
        for node, before, since in (*threads, (0, last, 0)):
            child = self.children[node].get(c)
            if child is None:
                continue
            grown.append((child, before, since))
            t = self.token[child]
            if t >= 0 and self.fits(before, t):
                if tok is not None:
                    raise ValueError(f"{self.names[t]!r} and {self.names[tok]!r} both end a prefix")
                tok, gain = t, self.weight[t] - since
        if tok is None:
            raise ValueError(f"no token ends a prefix at {c!r}")
        live = tuple((n, k, s + gain) for n, b, s in grown if (k := self.canonical(n, b)) is not None)
        return (live, tok), gain

    def canonical(self, node: int, before: int) -> int | None:
        """One token for all that may stand before the same tokens under a node; None if none of these can follow."""
        if (key := (node, before)) not in self.kept:
            below = self.below[node]
            if below is None:
                self.kept[key] = before
            else:
                can = tuple(t for t in below if self.fits(before, t))
                self.kept[key] = self.alike.setdefault((node, can), before) if can else None
        return self.kept[key]

    def fill(self, state: int, symbol: int) -> None:
        if symbol <= 1:  # nothing spans the start of a text or of a word
            self.next[state, symbol], self.delta[state, symbol] = self.space, 1
        elif symbol <= 5:
            self.next[state, symbol], self.delta[state, symbol] = self.start, symbol - 1
        else:
            key, gain = self.advance(self.defs[state], self.letters[symbol])
            to = self.state(key)
            self.next[state, symbol], self.delta[state, symbol] = to, gain

    def step(self, states: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        flat = states * np.int64(self.width) + symbols
        to = self.next.reshape(-1)[flat]
        if to.size and to.min() < 0:
            for f in np.unique(flat[to < 0]).tolist():
                self.fill(*divmod(f, self.width))
            to = self.next.reshape(-1)[flat]
        return to, self.delta.reshape(-1)[flat]

    def gains(self, symbols: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
        """The change of the token count at each symbol; symbols[0] must be a text's start."""
        gain, state = np.zeros(len(symbols), np.int8), self.start
        block = max(1, BLOCK // chunk) * chunk
        for lo in range(0, len(symbols), block):
            if len(self.defs) > MAX_STATES:
                key = self.defs[state]
                self.clear()
                state = self.state(key)
            gain[lo : lo + block], state = self._block(symbols[lo : lo + block], chunk, state)
        return gain

    def _walk(self, grid: np.ndarray, gain: np.ndarray, lanes: np.ndarray, states: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The states of chunks after their first ``stop`` symbols, begun in ``states``."""
        states = states.copy()
        for k in range(int(stop.max()) if len(lanes) else 0):
            on = stop > k
            states[on], gain[k, lanes[on]] = self.step(states[on], grid[k, lanes[on]])
        return states

    def _block(self, symbols: np.ndarray, chunk: int, state: int) -> tuple[np.ndarray, int]:
        """Changes of the token count and the state at the end. Only the last block of a slice may end amid a chunk."""
        n = len(symbols)
        lanes = -(-n // chunk)
        grid = np.zeros(lanes * chunk, np.uint16)
        grid[:n] = symbols
        grid = np.ascontiguousarray(grid.reshape(lanes, chunk).T)  # a row for each step
        gain = np.zeros((chunk, lanes), np.int8)
        sync = grid <= 5
        synced = sync.any(0)
        first = np.where(synced, sync.argmax(0), chunk)
        # Each chunk from its first synchronising symbol, where the state before doesn't matter: there its map is constant.
        end = np.full(lanes, self.start, np.int64)
        order = np.argsort(first, kind="stable")
        began = np.searchsorted(first[order], np.arange(chunk), side="right")
        for k in range(chunk):
            on = order[: began[k]]
            if len(on) == lanes:
                end, gain[k] = self.step(end, grid[k])
            elif len(on):
                end[on], gain[k, on] = self.step(end[on], grid[k, on])
        self._open_chunks(grid, gain, end, np.nonzero(~synced)[0], state)
        heads = np.nonzero(synced & (first > 0))[0]
        self._walk(grid, gain, heads, np.where(heads > 0, end[heads - 1], state), first[heads])
        return gain.T.reshape(-1)[:n], int(end[-1])

    def _open_chunks(self, grid: np.ndarray, gain: np.ndarray, end: np.ndarray, lanes: np.ndarray, state: int) -> None:
        """Chunks without a synchronising symbol; sets their states in ``end``.

        A chunk's map is known where it was evaluated: at one state each, that which the chunk before reaches when it is
        begun afresh. Neighbours compose where the one's result is the other's argument; a prefix scan, doubling its reach
        at each step, tells for which chunks all maps up to them compose. The others are evaluated anew at the results
        found to their left, until all compose; as machines forget, once is mostly enough.
        """
        if not len(lanes):
            return
        size = len(grid)
        whole = np.full(len(lanes), size)
        head = np.append(True, np.diff(lanes) > 1)  # what comes before is known
        place = np.arange(len(lanes))
        place -= np.maximum.accumulate(np.where(head, place, 0))
        argument = np.where(lanes > 0, end[lanes - 1], state)
        fresh = self._walk(grid, np.zeros_like(gain), lanes, np.full(len(lanes), self.start), whole)
        argument[~head] = fresh[:-1][~head[1:]]
        result, todo = np.zeros_like(argument), np.arange(len(lanes))
        while len(todo):
            result[todo] = self._walk(grid, gain, lanes[todo], argument[todo], whole[todo])
            composes = head.copy()
            composes[1:] |= result[:-1] == argument[1:]
            span = 1
            while span <= place.max():
                further = place >= span
                composes[further] &= composes[np.nonzero(further)[0] - span]
                span *= 2
            todo = np.nonzero(~composes)[0]
            todo = todo[argument[todo] != result[todo - 1]]
            argument[todo] = result[todo - 1]
        end[lanes] = result

    def counts(self, column: pa.Array) -> np.ndarray:
        """Tokens of each text of an Arrow string column."""
        data, _ = utf8_buffer(column)
        chars = pc.fill_null(pc.utf8_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        full = chars > 0
        out = np.zeros(len(chars), np.int64)
        if full.any():
            codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
            starts = np.concatenate([[0], np.cumsum(chars[full])[:-1]])
            symbols = np.insert(self.classes[codes], starts, 0)
            symbols[1:][(symbols[1:] == 1) & (symbols[:-1] <= 1)] = 6
            at = starts + np.arange(len(starts))
            out[full] = np.add.reduceat(self.gains(symbols), at, dtype=np.int64)
        return out


_machines: dict[str, Machine] = {}


def machine(path: str) -> Machine:
    """The worker's machine for a model file; its table stays warm between tasks."""
    if path not in _machines:
        _machines[path] = Machine.from_sentencepiece(path)
    return _machines[path]


def count_tokens(df: DataFrame, model: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``n_bytes`` and ``n_tokens`` of a text column to the columns ``keep`` (all but the text by default).

    model: place of a sentencepiece BPE file, the same on every executor. A kept column that clashes with a new one
    gives way to it.
    """
    keep = [c for c in (keep if keep is not None else [c for c in df.columns if c != text]) if c not in ("n_bytes", "n_tokens")]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = machine(model)
        for batch in batches:
            for part in slices(batch, "__text"):
                size = pc.fill_null(pc.binary_length(part.column("__text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), size, pa.array(m.counts(part.column("__text")))], names=[*keep, "n_bytes", "n_tokens"])

    return df.select(*(df[c] for c in keep), df[text].alias("__text")).mapInArrow(run, schema)


def op1_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ._common import table

    out = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=["doc_id"])
    return out.withColumn("over_limit", out["n_tokens"] > OVER_LIMIT)
