"""The pipeline operators against brute force, round trips and held-out accuracy, with the odd cases of each table."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF, rows
from pyspark.sql import functions as F

import corpus_pipeline
from inkloom.llm import bm25_decontam, chat_format, entry, fst_tokens, jaccard_join, license_scan, multiprobe_lsh, quality_gam, sharding, source_mix, url_filter
from inkloom.llm._common import cut
from inkloom.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " \n\t ", "a", "A b", "x " * 3000, "é ☃ \x00 日本語 <s> ▁x  y", "the cat sat on the mat and the dog sat on the log " * 400, "wordwithoutanyend" * 2000]


def odd_docs(spark, extra=""):
    data = [(i, t, "en", None if i == 3 else f"s{i % 3}", 0) for i, t in enumerate(ODD + ODD)] + [(None, "null id", "en", "s0", 0), (0, None, "en", "s0", 0)]
    return spark.createDataFrame(data, DOCS).withColumn("score", F.lit("clash")).withColumn("slot", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    assert rows(entry.queries()[name](spark, SF).toPandas()) == rows(duck.sql(entry.oracle_sql()[name]).df())


@pytest.fixture(scope="module")
def model():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_tokens_equal_the_library(spark, model):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    got = fst_tokens.count_tokens(odd_docs(spark), model, keep=["doc_id", "n_tokens"]).collect()
    want = sorted((len((t or "").encode()), len(sp.encode(t or ""))) for t in [*ODD, *ODD, "null id", None])
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == want
    real = fst_tokens.op1_token_counts(spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert all(r.n_tokens == len(sp.encode(texts[r.doc_id])) and r.over_limit == (r.n_tokens > 4096) for r in real) and len(real) == len(texts)
    assert fst_tokens.count_tokens(empty_docs(spark), model).count() == 0


def symbols_of(m, text):
    symbols = np.insert(m.classes[np.frombuffer(text.encode("utf-32-le"), np.uint32)], 0, 0)
    symbols[1:][(symbols[1:] == 1) & (symbols[:-1] <= 1)] = 6
    return symbols


@pytest.mark.parametrize("text", ["internationalisation  " * 5 + "x" * 700 + " ab", "".join(random.Random(1).choices("aeioustrnlx", k=5000)), "x" * 3000 + "".join(random.Random(2).choices("abcdefgh ", k=900)) + "ing" * 900])
def test_token_chunks_compose(model, text, monkeypatch):
    """However a text is cut into chunks and blocks, also amid words, the counts are those of the library; dropped tables change nothing."""
    import sentencepiece

    want = len(sentencepiece.SentencePieceProcessor(model_file=model).encode(text))
    m = fst_tokens.Machine.from_sentencepiece(model)
    symbols = symbols_of(m, text)
    assert {int(m.gains(symbols, chunk).sum(dtype=np.int64)) for chunk in (1, 2, 3, 7, 64, 512, 4096)} == {want}
    monkeypatch.setattr(fst_tokens, "BLOCK", 100)
    monkeypatch.setattr(fst_tokens, "MAX_STATES", 50)
    held, clear = [], m.clear
    monkeypatch.setattr(m, "clear", lambda: held.append(len(m.defs)) or clear())
    assert {int(m.gains(symbols, chunk).sum(dtype=np.int64)) for chunk in (1, 7, 50, 512)} == {want}
    assert held and max(held[1:] or [0]) <= 50 + 512 + 2


def test_decontamination(spark):
    random.seed(5)
    say = lambda n: " ".join("".join(random.choices("abcdefgh", k=random.randint(2, 7))) for _ in range(n))
    items = [(i, f"{say(random.randint(8, 120))}. {say(6)}.") for i in range(30)] + [(90, None), (91, ""), (92, "?")]
    docs = []
    for i in range(60):
        body = say(150)
        leak = random.choice(items[:30]) if i % 3 == 0 else None
        docs.append((i, f"{body} {leak[1].upper()} {say(40)}" if leak else body, "en", "s", 0, leak and leak[0]))
    df = spark.createDataFrame([d[:5] for d in docs], DOCS).unionByName(odd_docs(spark).select("doc_id", "text", "lang", "source", "n_chars").withColumn("doc_id", F.col("doc_id") + 1000))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in bm25_decontam.hits(df, bench).collect()}
    assert got == {(d[0], d[5]) for d in docs if d[5] is not None}
    clean = bm25_decontam.drop_leaks(df, bench)
    assert clean.columns == df.columns and clean.count() == df.count() - len({d for d, _ in got})
    assert bm25_decontam.hits(empty_docs(spark), bench).count() == 0
    assert bm25_decontam.hits(df, bench.limit(0)).count() == 0 and bm25_decontam.drop_leaks(df, bench.limit(0)).count() == df.count()


def plain_bm25(units, passage):
    """Every unit's BM25 score for a passage over its score for itself, written out plainly."""
    n, mean = len(units), sum(map(len, units)) / len(units)

    def score(query, unit):
        out = 0.0
        for t in set(query) & set(unit):
            df = sum(t in u for u in units)
            tf = unit.count(t)
            out += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(unit) / mean))
        return out

    return [score(passage, u) / score(u, u) for u in units]


@pytest.mark.parametrize("cells", [1 << 20, 1])
def test_block_max_search_loses_nothing(cells, monkeypatch):
    monkeypatch.setattr(bm25_decontam, "CELLS", cells)
    random.seed(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    units = [random.choices(letters, k=random.randint(1, 48)) for _ in range(100)]
    index = bm25_decontam.Index(list(enumerate(units)), bm25_decontam.Statistics.of(units))
    docs = [random.choices(letters + "!?", k=n) for n in (200, 1, 0, 64, 65, 97)]
    bounds = np.cumsum([0, *map(len, docs)])
    ids = np.array([letters.find(c) if c in letters else index.unknown for d in docs for c in d], np.int64)
    best = {}
    for k, doc in enumerate(docs):
        for at in range(0, max(1, len(doc) - bm25_decontam.PASSAGE + bm25_decontam.STRIDE), bm25_decontam.STRIDE) if doc else ():
            for j, s in enumerate(plain_bm25(units, doc[at : at + bm25_decontam.PASSAGE])):
                best[k, j] = max(best.get((k, j), 0.0), s)
    got = {(d, i): s for d, i, s in index.search(ids, bounds, 0.6)}
    assert got.keys() == {k for k, s in best.items() if s >= 0.6} and len(got) > 20
    assert all(abs(s - best[k]) < 1e-5 for k, s in got.items())


def test_every_word_of_an_item_is_indexed(spark):
    """The tail of an item, items that share an id, items without one, several groups of items."""
    for n in (1, 47, 48, 49, 60, 72, 96, 100, 145):
        units = bm25_decontam.units_of(list(range(n)))
        assert {w for u in units for w in u} == set(range(n)) and max(map(len, units)) <= 48
    random.seed(8)
    say = lambda n: " ".join("".join(random.choices("abcdefgh", k=random.randint(2, 7))) for _ in range(n))
    # The whole is quoted from its second half on: enough of it to be verified, but its first unit isn't there.
    long = [say(70) + "? " + say(20) + "." for _ in range(3)]
    items = [(1, long[0]), (1, long[1]), (None, long[2]), (1, long[0])] + [(k, say(30) + ". " + say(9) + ".") for k in range(10, 40)]
    docs = [(k, f"{say(100)} {' '.join(t.split()[30:])} {say(30)}", "en", "s", 0) for k, t in enumerate(long)] + [(10, say(300), "en", "s", 0)]
    df, bench = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash"))
    got = sorted(((r.doc_id, r.item_id) for r in bm25_decontam.hits(df, bench).collect()), key=str)
    assert got == [(0, 1), (1, 1), (2, None)]
    assert [r.doc_id for r in bm25_decontam.drop_leaks(df, bench).collect()] == [10]
    few = list(bm25_decontam.checkers(bench, group_bytes=1500))
    one = next(bm25_decontam.checkers(bench))
    texts = [d[1] for d in docs]
    assert len(few) > 2 and len(one.ids) == len(items) - 1
    near = lambda found: sorted((d, str(i), round(s, 5), q, a) for d, i, s, q, a in found)
    assert near(one.check(texts)) == near(f for c in few for f in c.check(texts))


def test_overlap_counts_runs():
    """Question and answer overlap against runs counted as tuples."""
    random.seed(12)
    texts = ["a b", "x", "one two three four? yes", *(" ".join(random.choices("abcde", k=40)) + ". " + " ".join(random.choices("abcde", k=5)) + "." for _ in range(20))]
    checker = bm25_decontam.Checker(list(enumerate(texts)), bm25_decontam.Statistics.of([bm25_decontam.words(t) for t in texts]))
    doc = random.choices("abcdexy", k=90) + ["one", "two", "three"]
    ids = checker.numbers(doc)
    runs = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    for (n, r), half in ((p, h) for k, t in enumerate(texts) for p, h in zip(checker.parts[k], bm25_decontam.question_and_answer(t), strict=True)):
        w = bm25_decontam.words(half)
        assert n == min(3, len(w)) and len(r) == (len(runs(w, n)) if n else 0)
        assert int(np.isin(r, checker.runs(ids, n)).sum()) == (len(runs(w, n) & runs(doc, n)) if n else 0)


def test_chat_rotation(spark):
    data = [(1, 0, "system", "be kind"), (1, 1, "ann b", "hi <|end|>"), (1, 2, "bob", None), (1, 2, "bob", None), (1, None, None, "late"), (None, 1, "x", "lost"), (2, 0, "system", "alone")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("clash"))
    got = {r.perspective: r for r in chat_format.rotate(df).collect()}
    assert set(got) == {"ann b", "bob", "unknown"}
    r = got["ann b"]
    assert r.rendered == "<|user name=unknown|>\nlate<|end|>\n<|system|>\nbe kind<|end|>\n<|assistant|>\nhi < |end|><|end|>\n<|user name=bob|>\n<|end|>\n"
    assert [r.rendered[s.start : s.end] for s in r.spans] == ["hi < |end|><|end|>\n"]
    assert chat_format.rotate(df.limit(0)).count() == 0


def test_chat_is_whole_for_every_participant(spark):
    """Far turn numbers, a thousand turns, a silent participant: one row for each speaker; parts laid end to end are the whole."""
    kind = "conv_id long, turn long, role string, text string"
    data = [(1, t, r, r) for t, r in ((1, "a"), (65, "b"), (129, "c"))] + [(2, i, "ab"[i % 2], f"t{i}") for i in range(1000)] + [(2, 1001, "c", "once")]
    data += [(3, i // 50, f"s{i % 3}", f"text {i} " * (1 + i % 9)) for i in range(700)] + [(3, 5, "s1", None), (3, None, "s0", "first"), (3, None, "quiet", "last")]
    df = spark.createDataFrame(data + data[:300], kind)
    whole = {(r.conv_id, r.perspective): r for r in chat_format.rotate(df).collect()}
    assert {k: r.n_turns for k, r in whole.items()} == {**{(1, s): 3 for s in "abc"}, **{(2, s): 1001 for s in "abc"}, **{(3, s): 703 for s in ("s0", "s1", "s2", "quiet")}}
    assert whole[1, "b"].rendered == "<|user name=a|>\na<|end|>\n<|assistant|>\nb<|end|>\n<|user name=c|>\nc<|end|>\n"
    parts = defaultdict(dict)
    for r in chat_format.rotate(df, part_chars=900).collect():
        parts[r.conv_id, r.perspective][r.part] = r
        assert len(r.rendered) < 2000 and all(r.rendered[s.start - r.start : s.end - r.start].endswith("<|end|>\n") for s in r.spans)
    assert parts.keys() == whole.keys()
    for key, rows_ in parts.items():
        assert sorted(rows_) == list(range(len(rows_)))
        assert "".join(rows_[k].rendered for k in sorted(rows_)) == whole[key].rendered
        assert [rows_[k].start for k in sorted(rows_)] == [sum(len(rows_[j].rendered) for j in range(k)) for k in sorted(rows_)]
        assert [s for k in sorted(rows_) for s in rows_[k].spans] == whole[key].spans


def test_chat_parts_match_sql(spark, duck):
    got = chat_format.rotate(spark.read.parquet(f"{SF}/conversations.parquet"), part_chars=200)
    got = got.select("conv_id", "part", "perspective", "start", "n_turns", F.size("spans").alias("n_targets"), F.md5("rendered").alias("rendered_md5"))
    want = duck.sql(f"SELECT conv_id, part, perspective, start, n_turns, n_targets, rendered_md5 FROM ({chat_format.op3_sql(200)})")
    assert rows(got.toPandas()) == rows(want.df())


def test_mix(spark):
    got = source_mix.plan(source_mix.slim_of(odd_docs(spark))).collect()
    assert len(got) == 2 * len(ODD) + 2 and all(0 <= r.copies <= 2 for r in got)
    taken, target = defaultdict(int), {}
    for r in spark.createDataFrame([(i, "w " * (1 + i % 7), "en", "abcd"[min(3, i % 8)], 0) for i in range(4000)], DOCS).transform(lambda d: source_mix.plan(source_mix.slim_of(d))).collect():
        taken[r.source] += r.copies * r.size
        target[r.source] = r.target
    assert all(abs(taken[s] - target[s]) <= 0.02 * target[s] for s in target)
    assert source_mix.plan(source_mix.slim_of(empty_docs(spark))).count() == 0


@pytest.mark.parametrize("ids", ["even", "half null", "half one id", "one id", "one row"])
def test_mix_counts_rows_not_ids(spark, ids):
    """However ids repeat, the mix takes 1.5 times the words (all sources alike here), no row more than twice."""
    name = {"even": "id % 700", "half null": "if(id % 2 = 0, NULL, id)", "half one id": "if(id % 2 = 0, 5, id)", "one id": "5", "one row": "5"}[ids]
    text = "repeat('w ', 1 + cast(id % 5 AS INT))" if ids != "one row" else "'w w w'"
    docs = spark.range(3000).selectExpr(f"CAST({name} AS LONG) AS doc_id", f"{text} AS text", "'en' AS lang", "concat('s', id % 2) AS source", "id AS n_chars" if ids != "one row" else "0L AS n_chars", "'clash' AS size", "'clash' AS target", "'clash' AS copies")
    out = source_mix.take(docs)
    assert out.columns == docs.columns
    words = lambda df: {r.source: r.n for r in df.groupBy("source").agg(F.sum(source_mix.size_of(F.col("text"))).alias("n")).collect()}
    have, got = words(docs), words(out)
    total = sum(have.values())
    assert abs(sum(got.values()) - 1.5 * total) <= 10
    goal = {r.source: r.target for r in source_mix.targets(spark.createDataFrame(list(have.items()), "source string, source_size long")).collect()}
    assert all(abs(got[s] - goal[s]) <= 0.02 * total for s in have)
    if ids not in ("one row",):
        assert out.groupBy("n_chars").count().agg(F.max("count")).first()[0] == 2


@pytest.mark.parametrize("ids", ["half null", "one row"])
def test_mix_query_deals_equal_rows_out(spark, ids, monkeypatch):
    """Rows without an id, and rows alike in all, are one row until the mix unfolds them; what is taken is as much as ever."""
    monkeypatch.setattr(source_mix, "UNFOLD", 100)
    name = "if(id % 2 = 0, NULL, id)" if ids == "half null" else "7"
    text = "repeat('w ', 1 + cast(id % 5 AS INT))" if ids == "half null" else "'w w w'"
    docs = spark.range(3000).selectExpr(f"CAST({name} AS LONG) AS doc_id", f"{text} AS text", "'en' AS lang", "concat('s', id % 2) AS source", "0L AS n_chars")
    slim = source_mix.slim_of(docs)
    assert slim.count() <= (1500 + 5 if ids == "half null" else 2)
    got = source_mix.plan(slim).groupBy("source").agg(F.count("*").alias("rows"), F.sum(F.col("size") * F.col("copies")).alias("taken"), F.max("target").alias("target"), F.max("copies").alias("most")).collect()
    assert len(got) == 2 and all(r.rows == 1500 and abs(r.taken - r.target) <= 10 and r.most <= 2 for r in got)


def test_pipeline_stages_keep_odd_rows(spark):
    """Null and repeated ids, repeated rows, null and empty texts, clashing columns, empty tables."""
    say = lambda k, n=60: " ".join(f"w{k}x{i}" for i in range(n))
    a, b, c = say(1), say(2), say(3)
    data = [(7, a), (7, a), (7, b), (3, a + " end"), (9, b), (None, a), (None, a), (4, ""), (4, None), (5, " "), (2, c), (2, c), (2, c + " tail")]
    docs = spark.createDataFrame([(i, t, "en", "s0" if i else None, k) for k, (i, t) in enumerate(data)], DOCS).withColumn("component_id", F.lit("clash")).withColumn("node", F.lit("clash")).withColumn("slot", F.lit("clash"))
    out = corpus_pipeline.deduplicate(spark, docs, SF)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    # a and a + end: the least id is 3; b under 7 and 9: 7 stays, as its text is another; c: one row of id 2 stays.
    least_c = min((c, c + " tail"), key=lambda t: spark.range(1).select(F.xxhash64(F.lit(t))).first()[0])
    assert got == sorted([(3, a + " end"), (7, b), (None, a), (None, a), (4, ""), (4, None), (5, " "), (2, least_c)], key=str)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        if name != "quality":
            kept = stage(spark, docs, SF)
            assert set(docs.columns) <= set(kept.columns) and stage(spark, empty, SF).count() == 0
    assert corpus_pipeline.mix(spark, docs, SF).where("text is null or trim(text) = ''").count() == 0
    assert {r.doc_id for r in corpus_pipeline.decontaminate(spark, docs, SF).collect()} == {i for i, _ in data}
    labels_free = corpus_pipeline.quality(spark, docs.withColumn("doc_id", F.col("doc_id") + 10**9), SF)
    assert labels_free.columns == docs.columns and labels_free.count() <= docs.count()


def test_licences(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", "text"), ("a/b/c/COPYING", "x " * 50), ("a/c/LICENSE", "Licensed under the Apache License, Version 2.0."), ("a/c/d/y.txt", None), ("z.txt", "hello\nThis work is licensed under the GNU General Public License, version 3.\n"), (None, "Released under the MIT License."), ("q/r.txt", "no licence here, permission slip"), ("a/b/x.txt", "text")]
    got = sorted(((r.path or ""), r.licence, r.via) for r in license_scan.scan(spark.createDataFrame(files, "path string, text string").withColumn("score", F.lit(1))).collect())
    assert got == sorted([("", "MIT", "notice"), ("a/LICENSE", "MIT", "notice"), ("a/b/c/COPYING", "MIT", "directory"), ("a/b/x.txt", "MIT", "directory"), ("a/b/x.txt", "MIT", "directory"), ("a/c/LICENSE", "Apache-2.0", "notice"), ("a/c/d/y.txt", "Apache-2.0", "directory"), ("q/r.txt", None, "none"), ("z.txt", "GPL-3.0", "notice")])
    assert license_scan.scan(spark.createDataFrame([], "path string, text string")).count() == 0


WRAPPED = {
    "MIT": """Copyright (c) 2020 Jane Doe

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:
""",
    "BSD-3-Clause": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:
 *
 * 1. Redistributions of source code must retain the above copyright notice.
""",
    "Apache-2.0": """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION
""",
    "GPL-3.0": """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.
""",
    "LGPL-3.0": """                   GNU LESSER GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 This version of the GNU Lesser General Public License incorporates
the terms and conditions of version 3 of the GNU General Public
License, supplemented by the additional permissions listed below.
""",
    "MPL-2.0": """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
""",
}


def test_licences_in_real_layouts(spark):
    """Wrapped notices amid thousands of other words, without a heading line, notices inside a line, SPDX tags."""
    filler = "\n\n" + "Words that say nothing of the sort go on here for a while.\n" * 300
    files = [(f"{n}/{name}", t + filler, n) for n, t in WRAPPED.items() for name in ("x.c", "COPYING")]
    files += [("a", "// SPDX-License-Identifier: MIT", "MIT"), ("b", "# SPDX-License-Identifier: Apache-2.0", "Apache-2.0"), ("c", "SPDX-License-Identifier: Foo-1.0", None)]
    files += [("d", filler + "Copyright (c) 2020 Jane Doe. Released under the MIT license. And more.", "MIT"), ("e", "Permission is hereby granted, free of charge, to any person obtaining a copy", "MIT"), ("f", "We limit the permit, mit license to roam the public domain of software.", None), ("g", "license " * 2000, None)]
    got = {r.path: r.licence for r in license_scan.scan(spark.createDataFrame([f[:2] for f in files], "path string, text string")).collect()}
    assert got == {f[0]: f[2] for f in files}


GNU_NOTICE = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {} General Public License as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version.\n"


@pytest.mark.parametrize(
    "text, want",
    [
        ("released under the mit license " * 40, "MIT"),
        ("SPDX-License-Identifier: BSD-2-Clause", "BSD-2-Clause"),
        ("SPDX-License-Identifier: BSD-3-Clause", "BSD-3-Clause"),
        ("SPDX-License-Identifier: BSD-4-Clause", None),
        ("SPDX-License-Identifier: GPL-1.0", None),
        ("SPDX-License-Identifier: LGPL-2.1", "LGPL-2.1"),
        ("Licensed under CC BY 4.0.", "CC-BY-4.0"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
        ("Licensed under CC BY-ND 4.0.", "CC-BY-ND-4.0"),
        ("Licensed under CC BY-NC-SA 3.0.", "CC-BY-NC-SA-3.0"),
        ("Licensed under CC BY 2.5.", None),
        (GNU_NOTICE.format("Affero", 3), "AGPL-3.0"),
        (GNU_NOTICE.format("Lesser", 2.1), "LGPL-2.1"),
        (GNU_NOTICE.format("", 3), "GPL-3.0"),
        ("GNU Library GPL version 2", "LGPL-2.0"),
        ("GNU LESSER GENERAL PUBLIC LICENSE\n    Version 2.1, February 1999", "LGPL-2.1"),
        ("GNU AFFERO GENERAL PUBLIC LICENSE\n   Version 3, 19 November 2007", "AGPL-3.0"),
        ("This is not released under the MIT license.", None),
        ("Distributed under the Boost Software License, Version 1.0.", "BSL-1.0"),
    ],
)
def test_confusable_licences(scanned, text, want):
    assert scanned[text] == want


@pytest.fixture(scope="module")
def scanned(spark):
    texts = [m.args[1][k][0] for m in test_confusable_licences.pytestmark for k in range(len(m.args[1]))]
    return {texts[int(r.path)]: r.licence for r in license_scan.scan(spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "path string, text string")).collect()}


def test_licence_anchors_lose_nothing():
    """What is left of a template without its anchors can't reach the threshold."""
    model = license_scan.Model()
    assert all(sum(v * v for t, v in w.items() if t not in model.anchors) < model.threshold**2 for w in model.weights)
    assert not set(model.anchors) & set(license_scan.COMMON)


def test_urls(spark, tmp_path):
    urls = [None, "", "no scheme", "http://", "HTTP://A.Example.NET:80/en/x?y", "http://example.net/en/", "http://net", "http://net/", "http://xnet/", "http://a.org/fr/x#y", "ftp://b.example.com/de/../z", "http://x.net?/en/", "http://example.net/en/a://b.org/fr/"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls + urls)], "page_id long, url string").withColumn("host", F.lit("clash"))
    both = [*url_filter.RULES, ("allow", "net", "/"), ("block", None, "/")]
    table_ = spark.createDataFrame(both, "action string, host string, path string")
    one, many, rows_ = (sorted(map(str, url_filter.judge(df, r, file_bytes=n).collect())) for r, n in ((both, 1 << 20), (both, 1), (table_, 60)))
    assert one == many == rows_ and len(one) == 2 * len(urls)
    assert sorted(map(str, url_filter.judge(df, []).where("rule is null and verdict = 'allow'").select("page_id").collect())) == sorted(map(str, df.select("page_id").collect()))

    def brute(u):
        rest = u.partition("://")[2] if u and "://" in u else ""
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), len(h), h + p, a) for a, h, p in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, *(max(fit)[2:] if fit else (None, "allow")))

    got = url_filter.judge(df, url_filter.RULES).where("page_id < 13").orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [brute(u) for u in urls]
    place = str(tmp_path / "rules")
    url_filter.DigestArray.write(place, list(url_filter._sorted_rules([("block", f"h{i}.org", "/") for i in range(1000)])[0]))
    array = url_filter.DigestArray(place)
    array.digests = np.full(1000, array.digests[0])  # all collide: strings decide
    keys = np.full(1, array.digests[0])
    assert array.string(int(array.lookup(["h77.org/"], [7], keys)[0])) == "h77.org/" and array.lookup(["none/"], [4], keys)[0] == -1
    words_ = ["", "a", "example.net/", "é☃", "x" * 100]
    assert [r[0] % 2**64 for r in spark.createDataFrame([(w,) for w in words_], "s string").select(F.xxhash64("s")).collect()] == [url_filter.digest(w) for w in words_]
    assert url_filter.judge(df.limit(0), url_filter.RULES).count() == 0


def test_sharding(spark, tmp_path):
    owner = sharding.fill([f"shard-{i}" for i in range(7)], 211)
    counts = np.bincount(owner)
    assert counts.max() - counts.min() <= 1 and len(owner) == 211
    fewer = sharding.fill([f"shard-{i}" for i in range(6)], 211)
    assert sum(a != b for a, b in zip(owner, fewer, strict=True) if a != 6) < 0.3 * 211
    docs = odd_docs(spark)
    out = sharding.place(docs, "doc_id", spread=["text"])
    assert out.count() == docs.count() and out.where("shard is null").count() == 0
    hot = spark.range(20000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), F.col("id").alias("v"))
    spread = sharding.place(hot, "k", n_shards=8, spread=["v"], split_hot=True).groupBy("shard").count().agg(F.max("count"), F.min("count")).first()
    assert spread[0] < 1.5 * spread[1]
    sharding.write_shards(out.select("doc_id", "text", "slot", "shard"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == docs.count()
    assert sharding.place(empty_docs(spark), "doc_id", spread=["text"]).count() == 0


def test_hot_ids_are_dealt_out(spark, tmp_path):
    """A third of the rows share an id; neither the query nor the pipeline's stage may place them in one shard."""
    docs = spark.range(6400).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for out in (sharding.op7_sharding(spark, str(tmp_path)), corpus_pipeline.shard(spark, docs, str(tmp_path))):
        counts = [r["count"] for r in out.groupBy("shard").count().collect()]
        assert sum(counts) == 6400 and max(counts) < 200


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(600, 16)) * rng.uniform(0.5, 2, size=(600, 1))
    vectors = [*base.tolist(), *[base[0].tolist()] * 60, None, [0.0] * 16, [None, *[1.0] * 15], [float("nan")] * 16, [float("inf")] * 16, [1.0, 2.0]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)] + [(3, base[3].tolist()), (None, base[4].tolist())], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in multiprobe_lsh.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x = np.array(vectors[:660], float)
    hit = 0
    for q in range(0, 660, 20):
        s = x @ x[q]
        s[q] = -np.inf
        want = np.lexsort((np.arange(660), -np.round(s, 9)))[:20].tolist()
        assert len(got[q]) == 20 and q not in {i for i, _ in got[q]} and all(abs(s[i] - v) < 1e-9 for i, v in got[q])
        hit += len(set(want) & {i for i, _ in got[q]})
    assert hit >= 0.9 * 20 * 33 and set(got) == set(range(0, 660, 20))
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in multiprobe_lsh.nearest(few, F.col("vec_id") == 0).orderBy("rank").collect()] == [(0, 1, 2), (0, 2, 1)]
    assert multiprobe_lsh.nearest(df.limit(0), F.lit(True)).count() == 0


def recall(spark, path):
    """Recall at 20 of the query's search against brute force on a whole table."""
    got = defaultdict(set)
    for r in multiprobe_lsh.op8_multiprobe_lsh(spark, path).collect():
        got[r.query_id].add(r.vec_id)
    rows_ = {r.vec_id: r.embedding for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()}
    fine = {i: v for i, v in rows_.items() if v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    ids, x = np.array(sorted(fine)), np.array([fine[i] for i in sorted(fine)], float)
    hit = n = 0
    for q in (i for i in ids.tolist() if i % 20 == 0):
        s = np.where(ids == q, -np.inf, x @ np.array(fine[q], float))
        want = ids[np.lexsort((ids, -s))[:20]]
        hit, n = hit + len(got[q] & set(want.tolist())), n + 20
    return hit / n


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_on_the_table(spark, sf):
    assert recall(spark, f"/root/testdata/{sf}") >= 0.92


def test_probes_get_fewer_with_more_vectors():
    """The share of vectors that queries are scored with falls as tables grow, at the recall asked for."""
    shares = []
    for n in (2000, 20_000):
        rng = np.random.default_rng(1)
        x = rng.normal(size=(n, 64))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        made = multiprobe_lsh.Tables(x[:2000], 2, 1.0, 20 / n)
        buckets = made.buckets(x)
        made.count([(t, int(b), int(c)) for t, bs in enumerate(buckets) for b, c in zip(*np.unique(bs, return_counts=True), strict=True)])
        made.calibrate(multiprobe_lsh.RECALL)
        q = x[2000:2100] if n > 2000 else x[:100]
        s = q @ x.T
        top = np.argsort(-s, axis=1)[:, 1:21]
        picks = made.probes(q)
        seen = [np.stack([np.isin(bs, p) for p in ps]) for bs, ps in zip(buckets, picks, strict=True)]
        assert np.take_along_axis(np.logical_or(*seen), top, 1).mean() >= 0.9  # the first pass alone
        shares.append(sum(m.mean() for m in seen))
    assert shares[1] < shares[0] < 1.6


def test_neighbours_beside_a_group_of_near_copies(spark):
    """A third of the vectors are near copies of one another; the others have to find their neighbours all the same."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(4000, 64))
    x[::3] = rng.normal(size=64) + 0.01 * rng.normal(size=x[::3].shape)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in multiprobe_lsh.nearest(df, F.col("vec_id") % 20 == 0).collect():
        got[r.query_id].add(r.vec_id)
    share = {True: [], False: []}
    for q in range(0, 4000, 20):
        s = x @ x[q]
        s[q] = -np.inf
        share[q % 3 == 0].append(len(set(np.argsort(-s)[:20].tolist()) & got[q]) / 20)
    assert np.mean(share[True]) >= 0.9 and np.mean(share[False]) >= 0.9


def brute_components(docs):
    parent = {}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = {}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = ({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}) if w else set()
        parent[i] = i
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_jaccard_components(spark):
    random.seed(9)
    docs, texts = [], []
    for _ in range(120):
        texts.append([random.choice("abcdefghijklmnopqrstuvw") * random.randint(1, 2) for _ in range(random.choice([0, 1, 3, 4, 5, 6, 8, 12, 20, 40, 90, 200]))])
    for _ in range(60):  # chains of small edits, and a large group of near copies
        t = list(random.choice(texts))
        for _ in range(random.randint(0, 2)):
            if t:
                t[random.randrange(len(t))] = "edit%d" % random.randrange(99)
        texts.append(t)
    for k in range(60):
        t = list(texts[119]) or ["q"] * 80
        texts.append([*t[:40], f"n{k}", *t[40:]])
    docs = [(i, random.choice([" ", "\n", "  "]).join(t).upper() if i % 5 == 0 else " ".join(t)) for i, t in enumerate(texts)] + [(1000, None), (1001, " ")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(df).collect()}
    assert got == brute_components(docs)
    odd = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard_join.join_components(odd_docs(spark)).collect()}
    assert odd[None, 1] is None and odd[0, 0] == 0
    word = {i for i, t in enumerate(ODD + ODD) if t == "wordwithoutanyend" * 2000}
    assert {odd[i, 1] for i in word} == {min(word)} and len(word) == 2
    assert jaccard_join.join_components(empty_docs(spark)).count() == 0


@pytest.mark.parametrize("parts, broadcast", [(1, 1_000_000), (6, 0)])
def test_jaccard_shared_signatures(spark, parts, broadcast, monkeypatch):
    """Families that share most signatures with one another but are linked only within, in one slice of texts and in several; ids broadcast and not."""
    monkeypatch.setattr(jaccard_join, "MAX_BROADCAST_IDS", broadcast)
    random.seed(11)
    base, docs = [f"w{i}" for i in range(400)], []
    for family in range(60):
        own = list(base)
        for start in random.sample(range(0, 380, 20), 5 + family % 4):
            own[start : start + 20] = [f"f{family}_{start + i}" for i in range(20)]
        for copy in range(1 + family % 5):
            t = list(own)
            if copy:
                t[random.randrange(400)] = f"c{copy}"
            docs.append((len(docs), " ".join(t)))
    random.shuffle(docs)
    got = jaccard_join.join_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)
    assert 20 < len({r.component_id for r in got}) < len(docs)


def test_jaccard_links_beside_the_least(spark, monkeypatch):
    """Near copies that are linked with a few of a large group only, neither with its least ones nor with each other."""
    monkeypatch.setattr(jaccard_join, "TILE", 16)
    random.seed(5)

    def near(k, edits):
        own = [f"w{i}" for i in range(400)]
        for at in random.sample(range(400), edits):
            own[at] = f"d{k}_{at}"
        return " ".join(own)

    far, close = [near(k, 8) for k in range(100)], [near(k, 3) for k in range(100, 400)]
    name = lambda t: jaccard_join.node_of(jaccard_join.shingle_sets(pa.array([t]))[0])
    docs = list(enumerate(far + sorted(close, key=name)[-5:]))
    got = jaccard_join.join_components(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(docs)
    assert len({r.component_id for r in got}) == 1


def test_signatures_meet():
    """Any two sets within the bound share a signature, whatever differs."""
    rng = np.random.default_rng(4)
    edges = np.array(jaccard_join.bands())
    for _ in range(1500):
        n = int(rng.integers(1, 120))
        pool = np.unique(rng.integers(0, 1 << 63, 2 * n + 40).astype(np.uint64))
        common = rng.integers(0, n + 1)
        a = np.sort(pool[:n])
        b = np.sort(np.concatenate([a[: n - common // 4], pool[n : n + int(rng.integers(0, n // 3 + 1))]]))
        if not len(b) or not jaccard_join.linked(a, b):
            continue
        bands = [int(np.searchsorted(edges, len(s), side="right")) - 1 for s in (a, b)]
        low = min(bands)
        assert abs(bands[0] - bands[1]) <= 1
        assert len(np.intersect1d(jaccard_join.signatures(a, low), jaccard_join.signatures(b, low)))


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(8, 40)] + [(3, 3)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{k: 7 for k in range(7, 40)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_quality(spark, monkeypatch):
    got = quality_gam.op10_quality_gam(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.predicted == r.quality for r in held) > 0.95 * len(held)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(20)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = odd_docs(spark)
    model = quality_gam.fit(docs, labels)
    out = quality_gam.score(docs, model).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    many = spark.createDataFrame([(i % 12, f"text {i} " * (1 + i % 12), "en", "s", 0) for i in range(600)], DOCS)
    got, real = [], quality_gam.fit_arrays
    monkeypatch.setattr(quality_gam, "fit_arrays", lambda x, y: got.append(len(x)) or real(x, y))
    quality_gam.fit(many, labels, max_rows=5)
    assert got and got[0] <= 5  # rows that share an id don't multiply
    none = quality_gam.score(docs, quality_gam.fit(docs, labels.limit(0)), keep=["doc_id"]).collect()
    assert {r.score for r in none} == {0.5}
    assert quality_gam.score(empty_docs(spark), model).count() == 0


def plain_gam(x, y, m):
    """The same model written out in loops: cyclic depth-two trees over bins, then over the planes of the best pairs."""
    order = np.lexsort((*x.T, y))
    x, y = x[order], y[order].astype(float)
    share = (y.sum() + 1) / (len(y) + 2)
    z = [math.log(share / (1 - share))] * len(y)
    bins = lambda col, n: [sum(v >= c for c in sorted({sorted(col)[math.ceil(k / n * (len(col) - 1) - 1e-9)] for k in range(1, n)})) for v in col]
    gain = lambda cells: sum(g for g, _ in cells) ** 2 / (sum(h for _, h in cells) + m.RIDGE)

    def cut(cells):
        if len(cells) < 2:
            return 0.0, 0
        each = [gain(cells[:c]) + gain(cells[c:]) - gain(cells) for c in range(1, len(cells))]
        return max(0.0, max(each)), each.index(max(each)) + 1

    def leaf(cells):
        return sum(g for g, _ in cells) / (sum(h for _, h in cells) + m.RIDGE)

    def slopes():
        p = [1 / (1 + math.exp(-v)) for v in z]
        return [(a - b, b * (1 - b)) for a, b in zip(y, p, strict=True)]

    def cells_of(where, n):
        out = [(0.0, 0.0)] * n
        for k, (g, h) in zip(where, slopes(), strict=True):
            out[k] = (out[k][0] + g, out[k][1] + h)
        return out

    fine = [bins(list(c), m.BINS) for c in x.T]
    for _ in range(m.ROUNDS):
        for b in fine:
            cells = cells_of(b, max(b) + 1)
            values = []
            _, k = cut(cells)
            for side in (cells[:k], cells[k:]):
                _, c = cut(side)
                for part in (side[:c], side[c:]):
                    values += [leaf(part)] * len(part)
            z = [v + m.RATE * values[i] for v, i in zip(z, b, strict=True)]
    coarse = [bins(list(c), m.PAIR_BINS) for c in x.T]

    def plane(a, b):
        na, nb = max(coarse[a]) + 1, max(coarse[b]) + 1
        flat = cells_of([i * nb + j for i, j in zip(coarse[a], coarse[b], strict=True)], na * nb)
        grid = [flat[i * nb : (i + 1) * nb] for i in range(na)]
        best, out = -1.0, None
        for turn in (False, True):
            rows_ = [list(r) for r in zip(*grid, strict=True)] if turn else grid
            for k in range(1, len(rows_)):
                total, values = 0.0, []
                for side in (rows_[:k], rows_[k:]):
                    columns = [(sum(r[j][0] for r in side), sum(r[j][1] for r in side)) for j in range(len(side[0]))]
                    more, c = cut(columns)
                    total += more + gain(columns)
                    line = [leaf(columns[:c])] * c + [leaf(columns[c:])] * (len(columns) - c)
                    values += [line] * len(side)
                if total > best + 1e-12:
                    best, out = total, [list(r) for r in zip(*values, strict=True)] if turn else values
        return best - gain(flat), out

    pairs = sorted(((a, b) for a in range(x.shape[1]) for b in range(a + 1, x.shape[1])), key=lambda p: (-round(plane(*p)[0], 9), p))[: m.PAIRS]
    for _ in range(m.PAIR_ROUNDS):
        for a, b in pairs:
            _, values = plane(a, b)
            z = [v + m.RATE * values[i][j] for v, i, j in zip(z, coarse[a], coarse[b], strict=True)]
    return x, [1 / (1 + math.exp(-v)) for v in z], pairs


def test_quality_stage_on_an_empty_table(spark):
    docs = empty_docs(spark)
    out = corpus_pipeline.quality(spark, docs, SF)
    assert out.columns == docs.columns and out.count() == 0


def test_boosting_equals_plain_loops(monkeypatch):
    for name, value in {"ROUNDS": 6, "PAIR_ROUNDS": 4, "PAIRS": 2, "BINS": 8, "PAIR_BINS": 4}.items():
        monkeypatch.setattr(quality_gam, name, value)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 4))
    x[:, 3] = rng.integers(0, 3, 90)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (rng.random(90) < 0.1)).astype(float)
    model = quality_gam.fit_arrays(x, y)
    ordered, want, pairs = plain_gam(x, y, quality_gam)
    assert model.pairs == pairs and (0, 1) in pairs
    assert np.allclose(model.score(ordered), want, atol=1e-9)


def test_features_of_a_slice_equal_those_of_single_texts():
    texts = ["Ab cd\nab cd\n\n!! 12", "", None, "x", "é é é", "\n\nq"]
    together = quality_gam.features(pa.array(texts))
    assert np.allclose(together, np.concatenate([quality_gam.features(pa.array([t], pa.string())) for t in texts]))


def test_pipeline(spark):
    """Every stage, on all that the one before kept, against brute force; run() against the stages."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    model = quality_gam.fit(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    good = {i for i, r in docs.items() if model.score(quality_gam.features(pa.array([r.text], pa.string())))[0] >= 0.5}
    parts = brute_components([(i, docs[i].text) for i in good])
    single = {i for i in good if parts[i][1] == i}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    low = lambda t: " ".join(bm25_decontam.words(t))
    clean = {i for i in single if not any(low(x) in low(docs[i].text) for x in items)}
    now, kept = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        now = cut(stage(spark, now, SF), name)
        kept[name] = sorted(r.doc_id for r in now.select("doc_id").collect())
    assert kept["quality"] == sorted(good) and kept["deduplicate"] == sorted(single) and kept["decontaminate"] == sorted(clean)
    assert kept["shard"] == kept["mix"]
    copies = Counter(kept["mix"])
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", docs[i].text)) for i in clean}
    assert set(copies) <= clean and max(copies.values()) <= 2
    # Each source's words come to its target, but for the document at the end of its queue.
    words, got, most = Counter(), Counter(), Counter()
    for i in clean:
        words[docs[i].source] += size[i]
        got[docs[i].source] += size[i] * copies[i]
        most[docs[i].source] = max(most[docs[i].source], size[i])
    goal = {r.source: r.target for r in source_mix.targets(spark.createDataFrame(list(words.items()), "source string, source_size long")).collect()}
    assert all(abs(got[s] - goal[s]) <= 2 * most[s] for s in goal)
    out = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in out) == copies
    owner = sharding.fill([f"shard-{i}" for i in range(sharding.SHARDS)])
    assert all(owner[r.slot] == r.shard and r.text == docs[r.doc_id].text and r.source == docs[r.doc_id].source for r in out)
