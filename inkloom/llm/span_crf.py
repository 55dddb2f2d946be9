"""Personal data: patterns for what is plain, a semi-Markov conditional random field for what is written around them.

:func:`base_spans` finds addresses, hosts, cards and phones by fixed patterns; they always stay. What lies between
them is searched by the field: a text's islands (clusters of digits, spelled at and dot signs) are cut into tokens, and a
segment of up to ``MAX_TOKENS`` tokens and ``MAX_CHARS`` characters that has the outline of a kind is a candidate. Features
look at the whole span (its digits, checksum, separators, signs, parts) and at the characters around it; one more weight is
for two spans without a token between them. Dynamic programming over token boundaries chooses boundaries and kinds
together; tokens outside a span score nothing, so what lies between islands need not be walked and texts are never cut.

The field is fitted on the corpus itself (``fit``): base spans of a bounded sample of documents, in their surroundings,
are rewritten as people hide them (spelled signs, brackets, other separators, a missing plus) and become spans to find;
the same with a broken checksum, part or form, and all numbers of the sample that are no base spans, become islands
without any. The likelihood is maximised by gradient with forward and backward sums over segmentations. Kinds that the
sample doesn't show get no spans.

A null text is empty and has no spans. Documents with equal ids or texts are handled each. An empty table gives an empty
one; with no base spans to learn from, only base spans are found. Work is in proportion to a text's length.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import slices, table

KINDS = ("email", "ip", "card", "phone")
MAX_TOKENS, MAX_CHARS = 24, 80
#: The sample: documents, examples of each that reach the driver, and islands that the field is fitted on.
MAX_DOCS, MAX_EACH, MAX_EXAMPLES = 4000, 8, 100
CONTEXT = 24
#: Characters behind a span that its features may look at.
AFTER = 8
EPOCHS, RATE, DECAY = 20, 0.5, 1e-3

# --- base spans -----------------------------------------------------------------------------------------------------

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only begin at the first digit of a run, and takes runs whole; said so, no text takes more than linear time.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NO_DIGITS = re.compile(r"[^0-9]+")


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[-1::-2]))) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def _emails(text: str) -> list[tuple[int, int]]:
    """From each at sign outward, so that a long word without one costs nothing."""
    out, end, at = [], 0, text.find("@")
    before = 0
    while at >= 0:
        run = text[max(end, before) : at]
        local = len(run) - len(run.rstrip(_LOCAL))
        if local and (m := _DOMAIN.match(text, at + 1)):
            out.append((at - local, m.end()))
            end = m.end()
        before = at + 1
        at = text.find("@", max(before, end))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of all base spans, in order. Spans of different kinds may overlap."""
    out = [(a, 0, b) for a, b in _emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _NO_DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGITS.sub("", m[0])) <= 15]
    return sorted(out)


# --- candidates -----------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|\s+|.", re.S)
#: Clusters of digits with at most three other characters between them.
_CLUSTER = re.compile(r"[0-9](?:[^0-9A-Za-z]{0,3}[0-9])*+")
_SIGN = re.compile(r"@|[\[({] ?at ?[\])}]|(?<![A-Za-z])dot(?![A-Za-z])", re.I)
_AT = r"(?: ?(?:@|[\[({] ?(?:at|@) ?[\])}]) ?)"
_SPELLED = r"(?: ?[\[({] ?(?:dot|\.) ?[\])}] ?| dot )"
_DOT = rf"(?:\.|{_SPELLED})"
_OUTLINE = (
    # Prose is full of "at" and full stops, so a spelled at sign asks for spelled dots.
    re.compile(rf"[A-Za-z0-9._%+-]+(?:({_AT})[A-Za-z0-9-]+((?:{_DOT}[A-Za-z0-9-]+)+)|( at )[A-Za-z0-9-]+((?:{_SPELLED}[A-Za-z0-9-]+)+))", re.I),
    re.compile(r"[0-9]{1,4}(?:[ \[({]{0,2}\.[ \])}]{0,2}[0-9]{1,4}){3}"),
    re.compile(r"[0-9]{12,19}|[0-9]{3,6}(?:[ .\-]{1,3}[0-9]{3,7}){2,5}"),
    re.compile(r"\+?\(?[0-9]{1,5}(?:[ ().\-/]{1,3}[0-9]{2,5}){1,4}|\+[0-9]{7,15}"),
)
_MORE = re.compile(rf"{_DOT}[A-Za-z0-9]", re.I)
_DIGITS = ((0, 99), (4, 16), (12, 19), (7, 15))
_SEPARATORS = re.compile(r"[^0-9A-Za-z]+")


def islands(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Stretches between the taken ones that may hold a candidate, in order and apart from each other."""
    marks = []
    for m in _CLUSTER.finditer(text):
        groups = len(_SEPARATORS.split(m[0])) if m.end() - m.start() < 7 else 4
        if groups >= 4:
            marks.append((max(0, m.start() - 2), min(len(text), m.end() + 1)))
    for m in _SIGN.finditer(text):
        marks.append((max(0, m.start() - MAX_CHARS), min(len(text), m.end() + MAX_CHARS)))
    out, marks = [], sorted(marks)
    merged: list[tuple[int, int]] = []
    for a, b in marks:
        if merged and a <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(b, merged[-1][1])
        else:
            merged.append((a, b))
    i = 0
    for a, b in merged:
        while i < len(taken) and taken[i][1] <= a:
            i += 1
        k = i
        while k < len(taken) and taken[k][0] < b:
            if taken[k][0] > a:
                out.append((a, taken[k][0]))
            a = max(a, taken[k][1])
            k += 1
        if a < b:
            out.append((a, b))
    return out


def _near(c: str) -> str:
    return "edge" if not c else "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c if c in "+-./\"'=:,;#$&*!|@()[]" else "other"


def _form(mark: str) -> str:
    """A spelled sign without its letters' case and its blanks."""
    return re.sub(r"\s+", "", mark.lower()) or "none"


def features(kind: int, span: str, before: str, after: str, m: re.Match) -> list[str]:
    """What is known of a whole span as one kind, behind a character and before some (none at the text's ends)."""
    name, digits = KINDS[kind], _NO_DIGITS.sub("", span)
    out = ["", f"L{_near(before)}", f"R{_near(after[:1])}", f"first {_near(span[0])}"]
    if kind == 0:
        out.append(f"more {_MORE.match(after) is not None}")
        sign, domain = m[1] or m[3], m[2] or m[4]
        spelled = {_form(x) for x in re.findall(_DOT, domain, re.I)}
        out += [f"at {_form(sign)}", *(f"dot {x}" for x in sorted(spelled)), f"last {'letters' if span[-2:].isalpha() else 'else'}", f"plain {'@' in sign and spelled == {'.'}}"]
    else:
        seps = _SEPARATORS.findall(span)
        kinds = "".join(sorted({c for s in seps for c in s}))
        out += [f"sep {kinds}", f"wide {max(map(len, seps), default=0)}", f"digits {len(digits)}"]
        if kind == 1:
            out.append(f"small {all(map(_small, re.findall('[0-9]+', span)))}")
        elif kind == 2:
            groups = re.findall("[0-9]+", span)
            out += [f"sum {luhn(digits)}", f"even {len({len(g) for g in groups[:-1]}) <= 1}", f"groups {min(len(groups), 6)}"]
        else:
            out += [f"groups {' '.join(str(len(g)) for g in re.findall('[0-9]+', span)[-3:])}", f"paren {'(' in span and ')' in span}"]
    return [f"{name} {x}" for x in out]


@lru_cache(1 << 15)
def _described(span: str, before: str, after: str) -> list[tuple[int, list[str]]]:
    """The kinds whose outline a span has, each with its features."""
    digits, out = sum(c.isdigit() for c in span), []
    for kind, outline in enumerate(_OUTLINE):
        least, most = _DIGITS[kind]
        if least <= digits <= most and (m := outline.fullmatch(span)):
            out.append((kind, features(kind, span, before, after, m)))
    return out


def candidates(text: str, lo: int, hi: int) -> tuple[list[int], list[tuple[int, int, int, list[str]]]]:
    """Token boundaries of an island, and its candidates: (first boundary, last boundary, kind, features)."""
    bounds = [lo, *(m.end() for m in _TOKEN.finditer(text, lo, hi))]
    out = []
    for i, a in enumerate(bounds[:-1]):
        if not (text[a].isalnum() or text[a] in "+(_."):
            continue
        for j in range(i + 1, min(i + MAX_TOKENS, len(bounds) - 1) + 1):
            if (b := bounds[j]) - a > MAX_CHARS:
                break
            if not text[b - 1].isalnum():
                continue
            out += [(i, j, kind, names) for kind, names in _described(text[a:b], text[max(0, a - 1) : a], text[b : b + AFTER])]
    return bounds, out


# --- the field ------------------------------------------------------------------------------------------------------


class Field:
    """Weights by feature, and that of two spans side by side."""

    def __init__(self, weights: dict[str, float] | None = None, beside: float = 0.0) -> None:
        self.weights, self.beside = weights or {}, beside

    def score(self, names: list[str]) -> float:
        get = self.weights.get
        return sum(get(x, 0.0) for x in names)

    def segment(self, n: int, found: list[tuple[int, int, int, float]]) -> list[tuple[int, int, int]]:
        """The best spans (first boundary, last boundary, kind) over n tokens; none where nothing is better."""
        by_end: dict[int, list] = {}
        for i, j, kind, s in found:
            if s > 0:
                by_end.setdefault(j, []).append((i, kind, s))
        if not by_end:
            return []
        best = [(0.0, -1e18)]  # behind a plain token, behind a span
        how: list[tuple | None] = [None]
        for j in range(1, n + 1):
            outside, inside, via = max(best[j - 1]), -1e18, None
            for i, kind, s in by_end.get(j, ()):
                if (x := max(best[i][0], best[i][1] + self.beside) + s) > inside:
                    inside, via = x, (i, kind)
            best.append((outside, inside))
            how.append(via)
        out, j, must = [], n, None
        while j > 0:
            behind_span = best[j][1] > best[j][0] if must is None else must
            if behind_span:
                i, kind = how[j]
                out.append((i, j, kind))
                must = best[i][1] + self.beside > best[i][0]
                j = i
            else:
                j, must = j - 1, None
        return out[::-1]

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end) of what the field adds to the base spans."""
        if not self.weights:
            return []
        taken: list[tuple[int, int]] = []
        for a, _k, b in base:
            if taken and a < taken[-1][1]:
                taken[-1] = taken[-1][0], max(b, taken[-1][1])
            else:
                taken.append((a, b))
        out = []
        for lo, hi in islands(text, taken):
            bounds, found = candidates(text, lo, hi)
            if found:
                scored = [(i, j, kind, self.score(names)) for i, j, kind, names in found]
                out += [(bounds[i], kind, bounds[j]) for i, j, kind in self.segment(len(bounds) - 1, scored)]
        return out


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -1e17 else a


def expected(n: int, found: list[tuple[int, int, int]], scores: list[float], beside: float) -> tuple[float, list[float], float]:
    """Log of the sum over all segmentations of n tokens, the probability of each candidate, the expected number of spans side by side."""
    ends: dict[int, list[int]] = {}
    starts: dict[int, list[int]] = {}
    for k, (i, j, _kind) in enumerate(found):
        ends.setdefault(j, []).append(k)
        starts.setdefault(i, []).append(k)
    plain, span = [0.0], [-1e18]
    for j in range(1, n + 1):
        plain.append(_add(plain[j - 1], span[j - 1]))
        x = -1e18
        for k in ends.get(j, ()):
            i = found[k][0]
            x = _add(x, _add(plain[i], span[i] + beside) + scores[k])
        span.append(x)
    after_plain, after_span = [0.0] * (n + 1), [0.0] * (n + 1)
    for i in range(n - 1, -1, -1):
        x = y = after_plain[i + 1]
        for k in starts.get(i, ()):
            z = after_span[found[k][1]] + scores[k]
            x, y = _add(x, z), _add(y, z + beside)
        after_plain[i], after_span[i] = x, y
    total = after_plain[0]
    chance, side = [], 0.0
    for (i, j, _kind), s in zip(found, scores, strict=True):
        rest = s + after_span[j] - total
        touching = math.exp(min(0.0, span[i] + beside + rest))
        chance.append(math.exp(min(0.0, plain[i] + rest)) + touching)
        side += touching
    return total, chance, side


def fit_field(examples: list[tuple[str, int, int, list[tuple[int, int, int]]]], epochs: int = EPOCHS) -> Field:
    """Fit to examples (text, island's start, its end, true spans as (start, kind, end)); those whose spans are no candidates are left out."""
    numbers: dict[str, int] = {}
    made = []
    for text, lo, hi, truth in examples:
        bounds, found = candidates(text, lo, hi)
        at = {b: i for i, b in enumerate(bounds)}
        want = {(at.get(a), at.get(b), kind) for a, kind, b in truth}
        if found and want <= {c[:3] for c in found}:
            rows = [np.array([numbers.setdefault(x, len(numbers)) for x in names]) for *_, names in found]
            gold = np.array([float(c[:3] in want) for c in found])
            made.append((len(bounds) - 1, [c[:3] for c in found], rows, gold))
    if not any(gold.any() for *_, gold in made):
        return Field()
    w, seen, beside, beside_seen = np.zeros(len(numbers)), np.full(len(numbers), 1e-6), 0.0, 1e-6
    for _ in range(epochs):
        for n, found, rows, gold in made:
            scores = [float(w[r].sum()) for r in rows]
            _total, chance, side = expected(n, found, scores, beside)
            grad = np.zeros(len(numbers))
            for r, g in zip(rows, gold - np.array(chance), strict=True):
                if abs(g) > 1e-4:
                    grad[r] += g
            touched = np.flatnonzero(grad)
            g = grad[touched] - DECAY * w[touched]
            seen[touched] += g * g
            w[touched] += RATE * g / np.sqrt(seen[touched])
            g = -side - DECAY * beside
            beside_seen += g * g
            beside = min(0.0, beside + RATE * g / math.sqrt(beside_seen))
    return Field({x: float(w[k]) for x, k in numbers.items()}, beside)


# --- examples from the corpus ---------------------------------------------------------------------------------------


_PLUS = re.compile(r"\+[0-9]")


def _hidden(kind: int, body: str) -> tuple[list[str], list[str]]:
    """A base span as people hide it, and look-alikes that are no such data."""
    if kind == 0:
        local, _, domain = body.rpartition("@")
        spelled = [f"{local} at {domain.replace('.', ' dot ')}", f"{local}(at){domain}", f"{local} [at] {domain.replace('.', ' [dot] ')}", f"{local} (at) {domain.replace('.', ' (dot) ')}", f"{local}[at]{domain.replace('.', '[dot]')}"]
        return spelled, [f"{local} dot {domain}", f"@{local}", f"{local} @ home. {domain}"]
    if kind == 1:
        p = body.split(".")
        return ["[.]".join(p), "(.)".join(p), ".".join(p[:3]) + "[.]" + p[3]], ["[.]".join([*p[:3], str(int(p[3][-3:]) + 256)]), "[.]".join([*p, "1"]), " ".join(p)]
    digits = _NO_DIGITS.sub("", body)
    fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
    if kind == 2:
        wrong = digits[:-1] + str((int(digits[-1]) + 5) % 10)
        bad = [wrong[i : i + 4] for i in range(0, len(wrong), 4)]
        return [".".join(fours), " - ".join(fours), "  ".join(fours)], [".".join(bad), " - ".join(bad), "  ".join(bad), wrong, " ".join(bad)]
    groups = re.findall("[0-9]+", body)
    if len(groups) < 4:
        return [], [digits]
    country, area, *rest = groups
    return (
        [body, f"({area}) {'-'.join(rest)}", f"00{country} ({area}) {'-'.join(rest)}", f"{area}-{'-'.join(rest)}", f"{country}-{area}-{'-'.join(rest)}", f"{area}.{'.'.join(rest)}"],
        [digits, f"{area}{''.join(rest)}", f"2024-0{1 + int(area[0]) % 9}-1{area[-1]}", f"{area}.{''.join(rest)}", f"{area} {''.join(rest)}{area}", f"1{area[:3]}-{rest[0][:3]}"],
    )


def make_examples(found: list[tuple[int, str, str, str]]) -> list[tuple[str, int, int, list[tuple[int, int, int]]]]:
    """Examples from (kind or -1, text before, span or island, text behind); -1: an island without personal data."""
    out = []
    for kind, before, body, after in found:
        forms = [(body, False)]
        if kind >= 0:
            good, bad = _hidden(kind, body)
            forms = [(x, True) for x in good] + [(x, False) for x in bad]
        for said, true in forms:
            lo, hi = len(before), len(before) + len(said)
            text = before + said + after
            stretch = next(((a, b) for a, b in islands(text, []) if a < hi and b > lo), None)
            if stretch and (kind >= 0 or not _PLUS.search(text)):  # a longer run that begins like a phone may well hold one
                a, b = min(stretch[0], lo), max(stretch[1], hi)
                out.append((text, a, b, [(lo, kind, hi)] if true else []))
    return out


def fit(docs: DataFrame, max_docs: int = MAX_DOCS) -> Field:
    """Learn from max_docs documents, those of the least digests of their ids, and MAX_EACH spans of a kind in each."""
    sample = docs.where("doc_id is not null").select("doc_id").distinct().orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_docs)
    rows = docs.select("doc_id", F.col("text").alias("__text")).join(F.broadcast(sample), "doc_id").select("__text")
    schema = pa.schema([("kind", pa.int32()), ("before", pa.string()), ("body", pa.string()), ("after", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for text in batch.column("__text"):
                text = text.as_py() or ""
                base = base_spans(text)
                stretches = [(kind, a, b) for a, kind, b in base] + [(-1, a, b) for a, b in islands(text, [(a, b) for a, _k, b in base])]
                for kind in range(-1, len(KINDS)):
                    for _k, a, b in [s for s in stretches if s[0] == kind and s[2] - s[1] <= 4 * MAX_CHARS][:MAX_EACH]:
                        got.append({"kind": kind, "before": text[max(0, a - CONTEXT) : a], "body": text[a:b], "after": text[b : b + CONTEXT]})
            yield pa.RecordBatch.from_pylist(got, schema)

    found = rows.mapInArrow(run, "kind int, before string, body string, after string").distinct()
    digest = F.md5(F.concat_ws("\n", "before", "body", "after"))
    place = F.row_number().over(Window.partitionBy("kind").orderBy(digest))
    few = found.withColumn("place", place).where(F.col("place") <= MAX_EXAMPLES).orderBy("place", "kind").collect()
    return fit_field(make_examples([(r.kind, r.before, r.body, r.after) for r in few]))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("base", T.BooleanType())]))


def find(df: DataFrame, field: Field, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text by default) and ``spans``: kind, start, end (code points) and whether it is a base span, by start and kind."""
    keep = [c for c in (keep if keep is not None else [c for c in df.columns if c != text]) if c != "spans"]
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField("spans", SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
    shared = df.sparkSession.sparkContext.broadcast(field)

    def of(said: str | None) -> list[dict]:
        base = base_spans(said) if said else []
        more = shared.value.spans(said, base) if said else []
        both = sorted([(*s, True) for s in base] + [(*s, False) for s in more])
        return [{"kind": KINDS[k], "start": a, "end": b, "base": own} for a, k, b, own in both]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                spans = pa.array([of(x) for x in part.column("__text").to_pylist()], kind)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), spans], names=[*keep, "spans"])

    return df.select(*(df[c] for c in keep), df[text].alias("__text")).mapInArrow(run, schema)


def redacted(df: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """df with every span of its texts replaced by its kind in brackets; of overlapping spans the first says the kind."""
    names = {k: f"[{k}]" for k in KINDS}
    shared = df.sparkSession.sparkContext.broadcast(field)

    def of(said: str | None) -> str | None:
        if not said:
            return said
        base = base_spans(said)
        out, end = [], 0
        for a, k, b in sorted(base + shared.value.spans(said, base)):
            if a >= end:
                out += [said[end:a], names[KINDS[k]]]
            end = max(end, b)
        return "".join([*out, said[end:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield part.set_column(part.schema.get_field_index(text), text, pa.array([of(x) for x in part.column(text).to_pylist()], part.schema.field(text).type))

    return df.mapInArrow(run, df.schema)


def op11_pii_spans(spark, sf_dir: str) -> DataFrame:
    """The counts and the digest are of base spans; spans has those that the field adds as well."""
    docs = table(spark, sf_dir, "documents")
    found = find(docs, fit(docs), keep=["doc_id"])
    own = F.filter("spans", lambda s: s["base"])
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter(own, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(said(own), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))
