"""Operators 11 to 13 against brute force, with the odd cases of their tables."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

from inkloom.llm import dominance, entry, span_crf, turn_repair

# --- 11 ---

PLAIN = [
    (re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), lambda m, d: True),
    (re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), lambda m, d: all(int(x) <= 255 for x in m.split("."))),
    (re.compile(r"[0-9]([\x20-]?[0-9])+"), lambda m, d: 14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0),
    (re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"), lambda m, d: 10 <= len(d) <= 15),
]


def plain_spans(text):
    found = [(m.start(), k, m.end()) for k, (p, good) in enumerate(PLAIN) for m in p.finditer(text or "") if good(m[0], re.sub("[^0-9]", "", m[0]))]
    return sorted(found)


@pytest.mark.parametrize("letters", ["a@@..-+ 01234567%()é\n", "0123456789 -", "+()0123456789. -", "12.", "ab.@"])
def test_base_spans_equal_the_patterns(letters):
    r = random.Random(letters)
    for _ in range(5000):
        text = "".join(r.choices(letters, k=r.randint(0, 60)))
        assert span_crf.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("text", ["a" * 300000, "a" * 100000 + "@" + "b" * 100000, "1" * 300000, "1." * 100000, "@" * 100000, "0" * 9000 + ".1.1.1"])
def test_base_spans_take_linear_time(text):
    import time

    start = time.perf_counter()
    span_crf.base_spans(text)
    assert time.perf_counter() - start < 3


def brute_segmentations(n, found):
    """Every way to lay candidates side by side over n tokens."""
    def go(at):
        if at == n:
            yield ()
            return
        for rest in go(at + 1):
            yield rest
        for c in found:
            if c[0] == at:
                for rest in go(c[1]):
                    yield (c, *rest)

    return set(go(0))


def test_field_sums_and_best_segmentation():
    r = random.Random(3)
    for _ in range(60):
        n = r.randint(1, 6)
        found = list({(i := r.randrange(n), r.randint(i + 1, n), r.randrange(2)) for _ in range(r.randint(1, 6))})
        scores, beside = [r.uniform(-3, 3) for _ in found], r.uniform(-2, 0)
        worth = dict(zip(found, scores, strict=True))
        value = lambda s: sum(worth[c] for c in s) + beside * sum(a[1] == b[0] for a, b in itertools.pairwise(s))
        every = brute_segmentations(n, found)
        total, chance, side = span_crf.expected(n, found, scores, beside)
        weight = {s: np.exp(value(s)) for s in every}
        z = sum(weight.values())
        assert abs(total - np.log(z)) < 1e-9
        for c, p in zip(found, chance, strict=True):
            assert abs(p - sum(w for s, w in weight.items() if c in s) / z) < 1e-9
        assert abs(side - sum(w * sum(a[1] == b[0] for a, b in itertools.pairwise(s)) for s, w in weight.items()) / z) < 1e-9
        best = span_crf.Field(beside=beside).segment(n, [(*c, worth[c]) for c in found])
        assert abs(value(tuple(best)) - max(map(value, every))) < 1e-9


@pytest.fixture(scope="module")
def field(spark):
    return span_crf.fit(spark.read.parquet(f"{SF.replace('0.001', '0.1')}/documents.parquet"))


@pytest.mark.parametrize(
    "text, want",
    [
        ("mail me: joe.doe at example dot com or so", [("email", "joe.doe at example dot com")]),
        ("call (523) 555-1055 now", [("phone", "(523) 555-1055")]),
        ("server 10[.]0[.]3[.]7 up", [("ip", "10[.]0[.]3[.]7")]),
        ("x 4111.1111.1111.1111 y", [("card", "4111.1111.1111.1111")]),
        ("x 4111.1111.1111.1112 y", []),
        ("order 5235551055 of 2024-01-15, version 4.0. and 17 of 1,000,000", []),
        ("meet at noon. The dot is at home", []),
    ],
)
def test_field_finds_hidden_data(field, text, want):
    assert [(span_crf.KINDS[k], text[a:b]) for a, k, b in field.spans(text, span_crf.base_spans(text))] == want


def test_field_leaves_the_corpus_alone_and_holds_out(spark, field):
    """On documents not in the sample: hidden forms are found, numbers that are none are left."""
    texts = [r.text or "" for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("text").collect()]
    base = [(t, s) for t in texts for s in span_crf.base_spans(t)]
    made = span_crf.make_examples([(k, t[max(0, a - 24) : a], t[a:b], t[b : b + 24]) for t, (a, k, b) in base])
    right = sum(sorted(field.spans(text, [])) == sorted(truth) for text, _lo, _hi, truth in made)
    assert len(made) > 50 and right >= 0.9 * len(made)
    assert sum(len(field.spans(t, span_crf.base_spans(t))) for t in texts) <= 0.02 * len(texts)


def test_pii_query(spark):
    got = {r.doc_id: r for r in span_crf.op11_pii_spans(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        base, r = plain_spans(d.text), got[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for _, k, _ in base) for x in range(4)]
        said = [f"{span_crf.KINDS[k]}:{a}:{b}" for a, k, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r.spans.split(",")) | {""}


def test_pii_odd_rows(spark, field):
    odd = [None, "", " \n", "é☃ a@b.c ☃ 1.2.3.4", "x" * 100000, "+1 (523) 555-1055"] * 2
    df = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(odd)], "doc_id long, text string").withColumn("spans", F.lit("clash")).withColumn("kind", F.lit("clash"))
    got = span_crf.find(df, field).collect()
    assert sorted(len(r.spans) for r in got) == [0] * 8 + [1, 1, 2, 2] and got[0].kind == "clash"
    assert [(s.kind, s.start, s.end, s.base) for s in got[3].spans] == [("email", 3, 8, True), ("ip", 11, 18, True)]
    clean = span_crf.redacted(df, field)
    assert clean.columns == df.columns and clean.collect()[3].text == "é☃ [email] ☃ [ip]" and clean.collect()[0].text is None
    empty = spark.createDataFrame([], "doc_id long, text string")
    nothing = span_crf.fit(empty)
    assert not nothing.weights and span_crf.find(empty, nothing).count() == 0
    assert [len(r.spans) for r in span_crf.find(df, nothing).collect()] == [len(span_crf.base_spans(t or "")) for t in odd]


# --- 12 ---


def brute_above(points):
    good = [p for p in points if p[0] is not None and p[1] is not None]
    for s, v, _w in points:
        if s is None or v is None:
            yield None, None
        else:
            above = [p[2] for p in good if p[0] <= s and p[1] > v]
            yield len(above), sum(above)


@pytest.mark.parametrize("inclusive", [False, True])
def test_sweep(inclusive):
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 400):
        cells = np.unique(r.integers(0, max(1, n // 4), (n, 2)), axis=0) if n else np.zeros((0, 2), np.int64)
        amounts = r.integers(1, 9, (len(cells), 2))
        got = dominance.sweep(cells[:, 0], cells[:, 1], amounts, inclusive)
        want = [amounts[((cells[:, 0] < s) | (inclusive & (cells[:, 0] == s))) & (cells[:, 1] > v)].sum(0) for s, v in cells]
        assert np.array_equal(got, np.array(want).reshape(len(cells), 2))


@pytest.mark.parametrize("shape", ["even", "hot slot", "hot level", "hot cell", "one slot", "distinct"])
def test_count_above(spark, shape, monkeypatch):
    monkeypatch.setattr(dominance, "CELLS", 20)
    monkeypatch.setattr(dominance, "HOT", 20)
    r = random.Random(shape)
    points = []
    for i in range(600):
        s, v = r.randint(-30, 30), r.randint(-40, 40)
        if shape == "distinct":
            s, v = i * 7 % 600, i * 11 % 600
        if i % 3 == 0 or shape == "one slot":
            s = 3 if shape in ("hot slot", "hot cell", "one slot") else s
            v = 5 if shape in ("hot level", "hot cell") else v
        points.append((None if i % 50 == 7 else s, None if i % 60 == 8 else v, 1 + i % 2))
    points += points[:20]
    df = spark.createDataFrame([(*p, "x") for p in points], "slot long, level long, w long, n_above string")
    got = dominance.count_above(df, F.col("slot"), F.col("level"), F.col("w")).collect()
    want = [(*p, *x) for p, x in zip(points, brute_above(points), strict=True)]
    key = lambda t: tuple((x is not None, x) for x in t)
    assert sorted(((g.slot, g.level, g.w, g.n_above, g.w_above) for g in got), key=key) == sorted(want, key=key)


def test_count_above_odd_tables(spark):
    schema = "slot long, level long, chunk string, block string"
    for data in ([], [(None, 1, "a", "b"), (1, None, "a", "b")], [(1, 1, "a", "b")] * 3):
        df = spark.createDataFrame(data, schema)
        got = dominance.count_above(df, F.col("slot"), F.col("level"), F.lit(1)).collect()
        assert [(r.n_above, r.chunk) for r in got] == [(None if None in d else 0, "a") for d in data]


def test_dominance_query_in_any_zone(spark, duck):
    want = rows(duck.sql(entry.oracle_sql()["op12_dominance"]).df())
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "Asia/Kolkata")
        assert rows(dominance.op12_dominance(spark, SF).toPandas()) == want
        early = spark.sql("SELECT TIMESTAMP_NTZ'1969-12-31 23:59:59.5' AS t")
        assert early.select(dominance.hour_slot(early, "t")).first()[0] == -1
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


# --- 13 ---

GOAL = re.compile(r"(s?(ua)+)?")


def brute_repair(rows_):
    """Cheapest edits by trying all: rows are (role, text, fault)."""
    best = {}

    def go(i, roles, letters, lines, cost, inserts):
        if i == len(rows_) and GOAL.fullmatch(roles):
            best.setdefault(cost, []).append((letters, lines))
        if inserts < 3 and len(letters) < 2 * len(rows_) + 3:
            for role in ("user", "assistant"):
                go(i, roles + role[0], letters + "I", (*lines, f"{role}:"), cost + 5, inserts + 1)
        if i < len(rows_):
            role, text, fault = rows_[i]
            go(i + 1, roles, letters + "D", lines, cost + 2, inserts)
            if fault not in ("blank", "duplicate"):
                more = 5 * (fault == "truncated")
                go(i + 1, roles + role[:1], letters + "K", (*lines, f"{role}:{text}"), cost + more, inserts)
                for new in ("user", "assistant"):
                    go(i + 1, roles + new[0], letters + "R", (*lines, f"{new}:{text}"), cost + 1 + more, inserts)

    go(0, "", "", (), 0, 0)
    cost = min(best)
    letters, lines = min(best[cost])
    return cost, letters, "\n".join(lines)


def faults_of(said):
    seen, out = set(), []
    for role, text in said:
        last = re.sub(r"[\x20\x09-\x0D]+", "", text)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else "ok"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def test_repair_equals_trying_all(spark):
    r = random.Random(9)
    data, want = [], {}
    for conv in range(120):
        said = [(r.choice(["user", "assistant", "user", "assistant", "system", "tool"]), r.choice(["A b.", "C d!", "no end", "", " \n", "E?", f"x{r.randint(0, 99)}."])) for _ in range(r.randint(0, 4))]
        for turn, (role, text) in enumerate(said):
            data.append((conv, turn * 2, role, text, 1, "clash", "clash"))
        marked = faults_of(said)
        count = lambda f: sum(x[2] == f for x in marked)  # noqa: B023, E731
        cost, letters, lines = brute_repair(marked)
        illegal = sum(a[0][0] + b[0][0] not in ("su", "ua", "au") for a, b in itertools.pairwise(said))
        gaps = max(0, 2 * (len(said) - 1) + 1 - len(said))
        want[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, cost, letters, hashlib.sha256(lines.encode()).hexdigest())
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, times int, code string, kind string")
    heads = spark.createDataFrame([(c,) for c in want] * 2, "conv_id long")
    got = {x.conv_id: tuple(x)[1:] for x in turn_repair.repair(df.drop("code", "kind"), heads).collect()}
    assert got == want


def test_long_conversation_streams():
    """Ten thousand rows: the edits are those of a plain shortest path."""
    r = random.Random(2)
    codes = bytes(r.choice([1, 2, 1, 2, 0, 5, 9, 13, 14, 3]) for _ in range(10000))
    cost, letters, roles = turn_repair.Repair().solve(codes)
    far = 10**9
    here = [0, far, far, far]
    inserts = lambda c: [c[0], c[1], min(c[2], c[0] + 5, c[1] + 5, c[3] + 5), min(c[3], min(c[2], c[0] + 5, c[1] + 5) + 5)]
    for code in codes:
        here = inserts(here)
        fault, letter = divmod(code, 4)
        new = [c + 2 for c in here]
        if fault in (0, 3):
            for q, to, x in ((0, 1, 0), (0, 2, 1), (1, 2, 1), (2, 3, 2), (3, 2, 1)):
                new[to] = min(new[to], here[q] + 5 * (fault == 3) + (x != letter) if x or letter == 0 else far)
        here = new
    here = inserts(here)
    assert cost == min(here[0], here[3]) and sum(x in "KRD" for x in letters) == len(codes) and len(roles) == len(letters)


def plain_damage(rows_):
    out = []
    for conv, turn, role, text in rows_:
        said = lambda x: " " if x is None else str(x)
        what = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        if what:
            role, text = "user" if what == 4 else said(role), "" if what == 1 else re.sub("[.!?]", "", said(text)) if what == 2 else said(text)
            out += [(conv, turn, role, text)] * (2 if what == 3 else 1)
    return out


def test_repair_odd_rows(spark, tmp_path):
    data = [(c, t, r, x, "clash") for c in (None, 1, 2, 3) for t in (None, 0, 1, 1, 7) for r, x in ((None, None), ("user", "é. "), ("", "A."), ("assistant", "z" * 50000 + "!"))]
    data += [(4, 0, "user", "Same.", "clash")] * 500
    path = str(tmp_path / "sf")
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string, times string").write.parquet(f"{path}/conversations.parquet")
    got = {r.conv_id: r for r in turn_repair.op13_turn_repair(spark, path).collect()}
    damaged = plain_damage([d[:4] for d in data])
    assert set(got) == {None, 1, 2, 3, 4}
    for conv, r in got.items():
        own = [d for d in damaged if d[0] == conv]
        blank = sum(not re.search(r"[^\x20\x09-\x0D]", d[3]) for d in own)
        assert r.blank == blank and r.duplicate == len([d for d in own if re.search(r"[^\x20\x09-\x0D]", d[3])]) - len({d[2:] for d in own if re.search(r"[^\x20\x09-\x0D]", d[3])})
        turns = {d[1] for d in own} - {None}
        assert r.gaps == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
    assert got[4].audit.count("K") == 0 or got[4].cost > 0
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(f"{path}0/conversations.parquet")
    assert turn_repair.op13_turn_repair(spark, f"{path}0").count() == 0
