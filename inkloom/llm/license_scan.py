"""Licence scans in DataFrame functions only: TF-IDF cosine of header units and licence files to templates, then
inheritance from the nearest ancestor directory.

A licence has several templates: its SPDX tag, headings, standard notices and first clauses. The units that are scored
are the lines, the blocks (stretches without an empty line) and the sentences of the blocks of a whole text, of any length,
so neither wrapped lines nor words beside a notice dilute it; a licence file, which its name gives away, is a unit as a
whole too. A template that names its licence's version needs it in the unit, and a unit that denies a licence ("is not
released under") is no notice. The best unit at or above the threshold gives a text its licence. A file that has no notice of its own takes
the licence of the nearest directory above it that has a licence file; only the distinct directories, not the files, are
joined with their ancestors' paths.

Units that can't reach the threshold are skipped unscored. By the Cauchy-Schwarz inequality a unit's cosine is no more
than the root of the squared weights of the template's terms that it holds, so it must hold one of the template's
*anchors*: terms chosen such that all others come to less than the threshold squared. Texts without any anchor, most of
them, end at that test. No line is left out for any other reason; the SQL scores all units.

The templates and their term weights are a fixed table inside the plan. Null and empty texts have no notice; null
paths have no directory and inherit nothing. Rows are kept one to one; of several licence files in one directory the
best match stands for it, then the first name. Equal scores go to the first licence by name.
"""

from __future__ import annotations

import json
import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import cut, table

#: Names, versions and dates of the GNU licences, by SPDX name.
GNU = {
    "AGPL-3.0": ("agpl", "affero general", "3", "19 november 2007"),
    "GPL-2.0": ("gpl", "general", "2", "june 1991"),
    "GPL-3.0": ("gpl", "general", "3", "29 june 2007"),
    "LGPL-2.0": ("lgpl", "library general", "2", "june 1991"),
    "LGPL-2.1": ("lgpl", "lesser general", "2.1", "february 1999"),
    "LGPL-3.0": ("lgpl", "lesser general", "3", "29 june 2007"),
}
#: The Creative Commons licences' names by their codes, and what their versions are called.
COMMONS = {"by": "attribution", "by sa": "attribution sharealike", "by nd": "attribution noderivatives", "by nc": "attribution noncommercial", "by nc sa": "attribution noncommercial sharealike", "by nc nd": "attribution noncommercial noderivatives"}
COMMONS_VERSIONS = {"3.0": "unported", "4.0": "international"}
_GRANT = "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
#: Headings, notices and first clauses by SPDX name, in the words of the licences.
OTHERS = {
    "0BSD": ["bsd zero clause license", "zero clause bsd"],
    "Apache-1.1": ["apache software license version 1.1", "licensed under the apache software license version 1.1"],
    "Apache-2.0": ["licensed under the apache license version 2.0", "apache license version 2.0 january 2004", "apache license version 2.0 january 2004 http www.apache.org licenses", "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license"],
    "Artistic-2.0": ["the artistic license 2.0", "licensed under the artistic license 2.0"],
    "BSD-2-Clause": ["bsd 2 clause license", "simplified bsd license", "released under the simplified bsd license", "bsd 2 clause simplified license"],
    "BSD-3-Clause": ["released under the bsd license", "bsd 3 clause license", "bsd 3 clause new or revised license", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "BSL-1.0": ["boost software license version 1.0", "distributed under the boost software license version 1.0"],
    "CC0-1.0": ["dedicated to the public domain under cc0 1.0 universal", "creative commons cc0 1.0 universal", "cc0 1.0 universal public domain dedication", "released into the public domain under cc0"],
    "CDDL-1.0": ["common development and distribution license version 1.0", "common development and distribution license cddl version 1.0"],
    "EPL-1.0": ["eclipse public license v 1.0", "eclipse public license version 1.0"],
    "EPL-2.0": ["eclipse public license v 2.0", "eclipse public license version 2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2.0"],
    "EUPL-1.2": ["european union public licence v 1.2", "licensed under the eupl version 1.2"],
    "ISC": ["isc license", "released under the isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "MIT": ["released under the mit license", "the mit license", "licensed under the mit license", "permission is hereby granted free of charge to any person obtaining a copy", _GRANT],
    "MPL-1.1": ["mozilla public license version 1.1", "the contents of this file are subject to the mozilla public license version 1.1"],
    "MPL-2.0": ["mozilla public license version 2.0", "this source code form is subject to the terms of the mozilla public license v 2.0"],
    "MS-PL": ["microsoft public license ms pl"],
    "OFL-1.1": ["sil open font license version 1.1", "this font software is licensed under the sil open font license version 1.1"],
    "PostgreSQL": ["the postgresql license", "released under the postgresql license"],
    "Python-2.0": ["python software foundation license version 2"],
    "Unlicense": ["this is free and unencumbered software released into the public domain", "released into the public domain under the unlicense"],
    "WTFPL": ["do what the fuck you want to public license"],
    "Zlib": ["zlib license", "released under the zlib license", "in no event will the authors be held liable for any damages arising from the use of this software"],
}


def templates() -> dict[str, list[str]]:
    """All templates by SPDX name; those of families follow from their names and versions. Tags are added to each."""
    out = {k: list(v) for k, v in OTHERS.items()}
    for name, (short, long, version, date) in GNU.items():
        full = f"gnu {long} public license"
        notice = f"redistribute it and or modify it under the terms of the {full} as published by the free software foundation either version {version} of the license"
        out[name] = [f"this work is licensed under the {full} version {version}", f"{full} version {version}", f"{full} version {version} {date}", f"gnu {short} version {version}", f"gnu {short} v {version}", f"gnu {long.replace('general', 'gpl')} version {version}", notice]
    for code, long in COMMONS.items():
        for version, called in COMMONS_VERSIONS.items():
            said = f"creative commons {long} {version} {called}"
            out[f"CC-{code.upper().replace(' ', '-')}-{version}"] = [f"licensed under cc {code} {version}", f"licensed under a {said} license", said]
    return out


THRESHOLD = 0.7
#: Function words. They count as terms of every text, so they weigh least, and none is an anchor.
COMMON = "a all also an and any are as at be been but by can do for from has have he if in into is it its may no nor not of on one or other our out she so such than that the their there these they this those to under was we were which will with you your".split()
TERM = r"[a-z]+|[0-9]+(?:\.[0-9]+)*"
GROUPS = 61
#: A unit that says so is no notice.
DENIED = r"\bnot\s+(?:(?:be|been)\s+)?(?:(?:released|licen[cs]ed|distributed|available|covered|published)\s+)?under\b"
#: What parts blocks from each other, and the sentences of a block; both engines read these alike.
BLOCK, SENTENCE = r"\n[ \t\r\n]*\n", r"[.;!?][ \t\r\n]+"
#: "v. 2.0" is no end of a sentence.
SHORT = r"\bv\. *([0-9])"
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense)[^/]*$"


class Model:
    """Weights of the templates' terms, and the anchors."""

    def __init__(self, given: dict[str, list[str]] | None = None, threshold: float = THRESHOLD):
        self.threshold = threshold
        #: (name, text) of every template; the place in this list is what ties go by.
        self.passages = sorted({(n, t.lower()) for n, ts in (given or templates()).items() for t in [*ts, f"spdx license identifier {n}"]})
        counts = [Counter(re.findall(TERM, t)) for _, t in self.passages]
        #: The version that a template names, by its licence's name: a unit that doesn't hold it is no notice of this version.
        self.musts = [self._version(n, c) for (n, _), c in zip(self.passages, counts, strict=True)]
        df = Counter(t for c in counts for t in c)
        n = len(counts)
        self.idf = {t: 1.0 if t in COMMON else math.log((1 + n) / (1 + df[t])) + 1 for t in sorted({*df, *COMMON})}
        self.unseen = math.log(1 + n) + 1
        raw = [{t: k * self.idf[t] for t, k in c.items()} for c in counts]
        self.weights = [{t: v / math.sqrt(sum(x * x for x in w.values())) for t, v in w.items()} for w in raw]
        self.anchors = self._anchors()

    @staticmethod
    def _version(name: str, terms: Counter) -> str | None:
        """The term of a template that tells its licence's version."""
        m = re.search(r"-([0-9]+(?:\.[0-9]+)?)(?:-Clause)?$", name)
        return next((v for v in (m[1], m[1].removesuffix(".0")) if v in terms), None) if m else None

    def _anchors(self) -> list[str]:
        """Terms without which no template is reached, found greedily: those that cover most of what is left uncovered."""
        chosen: set[str] = set()
        bound = self.threshold**2 * (1 - 1e-6)
        while open_ := [w for w in self.weights if sum(v * v for t, v in w.items() if t not in chosen) >= bound]:
            gain = Counter()
            for w in open_:
                for t, v in w.items():
                    if t not in chosen:
                        gain[t] += v * v * (1e-6 if t in COMMON else 1e-4 if t.isalpha() and len(t) < 3 else 1 if t.isalpha() else 1e-3)
            chosen.add(max(sorted(gain), key=gain.__getitem__))
        return sorted(chosen)

    def has_anchor(self, lower: Column) -> Column:
        """Whether a lower-cased text holds an anchor; of 2.0 the 2 is looked for."""
        return F.arrays_overlap(F.split(lower, "[^a-z0-9]+"), F.array(*map(F.lit, sorted({a.partition(".")[0] for a in self.anchors}))))

    def _look(self):
        """The hit of a term, null if no template holds it. Terms are in small groups, as a map is searched one by one."""
        groups = [{} for _ in range(GROUPS)]
        for t, idf in self.idf.items():
            groups[(ord(t[0]) * 7 + len(t)) % GROUPS][t] = {"idf": idf, "dots": [idf * w.get(t, 0.0) for w in self.weights]}
        known = F.from_json(F.lit(json.dumps(groups)), F.lit("array<map<string,struct<idf:double,dots:array<double>>>>"))  # folds to one literal
        return lambda t: F.get(known, (F.ascii(t) * 7 + F.length(t)) % GROUPS)[t]

    def terms(self, words: Column) -> Column:
        """A unit's terms in order, each with its hit."""
        look = self._look()
        return F.transform(F.sort_array(words), lambda t: F.struct(t.alias("term"), look(t).alias("hit")))

    def scores(self, words: Column, terms: Column) -> Column:
        """(minus the score, name) of the best template for a unit's words and its terms; null where it can't reach the threshold."""
        # Sorted terms: a term's k-th occurrence adds k^2 - (k - 1)^2 to the square of its frequency. Those of templates are kept, with their numbers.
        start = F.struct(F.lit("").alias("term"), F.lit(0.0).alias("run"), F.lit(0.0).alias("square"), F.lit(0.0).alias("known"))

        def add(acc: Column, x: Column) -> Column:
            run = F.when(x["term"] == acc["term"], acc["run"] + 1).otherwise(1.0)
            idf = F.coalesce(x["hit"]["idf"], F.lit(self.unseen))
            more = idf * idf * (2 * run - 1)
            return F.struct(x["term"].alias("term"), run.alias("run"), (acc["square"] + more).alias("square"), (acc["known"] + F.when(x["hit"].isNull(), 0.0).otherwise(more)).alias("known"))

        def best(acc: Column) -> Column:
            # What a unit's known terms weigh bounds its cosine too: only those that may reach the threshold get their dot products.
            norm = F.sqrt(acc["square"])
            hits = F.filter(terms, lambda x: x["hit"].isNotNull())
            dots = F.aggregate(hits, F.array(*(F.lit(0.0) for _ in self.weights)), lambda sums, x: F.zip_with(sums, x["hit"]["dots"], lambda a, b: a + b))
            asked = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).cast("string").alias("must")) for (n, _), v in zip(self.passages, self.musts, strict=True)))
            pairs = F.zip_with(dots, asked, lambda d, n: F.when(n["must"].isNull() | F.array_contains(words, n["must"]), F.struct((-F.round(d / norm, 9)).alias("minus"), n["name"].alias("name"))))
            return F.when(acc["known"] >= acc["square"] * (self.threshold**2 * (1 - 1e-6)), F.array_min(pairs))

        return F.aggregate(terms, start, add, best)


def units(lower: Column, whole: Column, model: Model) -> Column:
    """The distinct units of a lower-cased text that hold an anchor."""
    blocks = F.split(lower, BLOCK)
    sentences = F.flatten(F.transform(blocks, lambda b: F.split(b, SENTENCE)))
    parts = F.filter(F.concat(F.split(lower, "\n"), blocks, sentences), lambda u: model.has_anchor(u) & ~u.rlike(DENIED))
    return F.array_distinct(F.concat(parts, F.filter(F.when(whole, F.array(lower)).otherwise(F.array().cast("array<string>")), model.has_anchor)))


def notices(lower: Column, whole: Column, model: Model) -> Column:
    """The best notice of a lower-cased text that reaches the threshold, as (minus, name), else null. Most texts end at the first test."""
    # One transformation after the other, so that what a lambda names is there and isn't made anew at each use.
    words = F.transform(units(lower, whole, model), lambda u: F.regexp_extract_all(u, F.lit(TERM), F.lit(0)))
    both = F.transform(words, lambda w: F.struct(w.alias("words"), model.terms(w).alias("terms")))
    found = F.transform(both, lambda u: model.scores(u["words"], u["terms"]))
    return F.when(model.has_anchor(lower), F.array_min(F.filter(found, lambda x: x["minus"] <= -model.threshold)))


def ancestors(path: Column) -> Column:
    """The directories above a path, the nearest first; the root is ''."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))


def scan(files: DataFrame, path: str = "path", text: str = "text", model: Model | None = None, keep: list[str] | None = None) -> DataFrame:
    """Add ``licence`` (null: none), ``via`` (notice, directory, none) and ``score`` to the path and the columns ``keep``."""
    model = model or Model()
    keep = [c for c in keep or [] if c not in ("path", "licence", "via", "score")]
    low = files.select(*keep, F.col(path).alias("path"), F.regexp_replace(F.lower(F.col(text)), SHORT, "v $1").alias("__low"))
    named = F.coalesce(F.col("path").rlike(LICENCE_FILE), F.lit(False))
    own = low.select(*keep, "path", notices(F.col("__low"), named, model).alias("own"), F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("dir"))
    own = cut(own, "notices")  # without the texts; it is read three times
    given = own.where(F.col("own").isNotNull() & F.col("path").rlike(LICENCE_FILE)).groupBy(F.col("dir").alias("above")).agg(F.min(F.struct("own.minus", "own.name")).alias("given"))
    dirs = own.where(F.col("path").isNotNull() & F.col("own").isNull()).select("dir").distinct()
    reach = dirs.select("dir", F.explode(ancestors(F.concat("dir", F.lit("/x")))).alias("up")).select("dir", "up.depth", F.col("up.dir").alias("above"))
    inherited = reach.join(given, "above").groupBy("dir").agg(F.max_by("given", "depth").alias("inherited"))
    out = own.join(inherited, "dir", "left")
    pick = F.coalesce(F.col("own"), F.when(F.col("path").isNotNull(), F.col("inherited")))
    via = F.when(F.col("own").isNotNull(), "notice").when(F.col("inherited").isNotNull() & F.col("path").isNotNull(), "directory").otherwise("none")
    return out.select(*keep, "path", pick["name"].alias("licence"), via.alias("via"), F.round(-pick["minus"], 6).alias("score"))


def tree(docs: DataFrame) -> DataFrame:
    """The table of documents as a tree of files: three levels under each source; each first document of a thousand, hundred and ten is its directory's licence file."""
    n = F.col("doc_id")
    name = F.when(n % 10 == 0, "LICENSE").otherwise(F.concat(n.cast("string"), F.lit(".txt")))
    level = F.when(n % 1000 == 0, F.array("source", (n / 1000).cast("long").cast("string"))).when(n % 100 == 0, F.array("source", (n / 1000).cast("long").cast("string"), (n / 100).cast("long").cast("string")))
    full = F.array("source", (n / 1000).cast("long").cast("string"), (n / 100).cast("long").cast("string"), (n / 10).cast("long").cast("string"))
    return docs.select("doc_id", F.array_join(F.array_append(F.coalesce(level, full), name), "/").alias("path"), "text")


def op5_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(tree(table(spark, sf_dir, "documents")), keep=["doc_id"]).select("doc_id", "path", "licence", "via", "score")


def op5_sql() -> str:
    """Scores all units, without anchors."""
    m = Model()
    text = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {text(n)}, {text(must) if must else 'NULL'}, {text(t)}, {v!r}::DOUBLE)" for k, ((n, _), must, w) in enumerate(zip(m.passages, m.musts, m.weights, strict=True)) for t, v in sorted(w.items()))
    idf = ", ".join(f"('{t}', {v!r}::DOUBLE)" for t, v in m.idf.items())
    return rf"""
WITH tpl(p, name, must, term, weight) AS (VALUES {rows}), idf(term, idf) AS (VALUES {idf}),
f AS (SELECT row_number() OVER () AS k, doc_id, regexp_replace(lower(text), '{SHORT}', 'v \1', 'g') AS text, doc_id % 10 = 0 AS is_file,
       source || '/' || doc_id // 1000 || CASE WHEN doc_id % 1000 = 0 THEN '' ELSE '/' || doc_id // 100 || CASE WHEN doc_id % 100 = 0 THEN '' ELSE '/' || doc_id // 10 END END AS dir FROM documents),
b AS (SELECT k, unnest(string_split_regex(text, '{BLOCK}')) AS unit FROM f),
u AS (SELECT k, unit, row_number() OVER () AS i FROM (SELECT k, unit FROM (SELECT k, unnest(string_split(text, chr(10))) AS unit FROM f UNION ALL SELECT k, unit FROM b
      UNION ALL SELECT k, unnest(string_split_regex(unit, '{SENTENCE}')) FROM b) WHERE NOT regexp_matches(unit, '{DENIED}') UNION SELECT k, text FROM f WHERE is_file)),
w AS (SELECT k, i, term, count(*)::DOUBLE AS tf FROM (SELECT k, i, unnest(regexp_extract_all(unit, '[a-z]+|[0-9]+(?:\.[0-9]+)*')) AS term FROM u) GROUP BY ALL),
n AS (SELECT k, i, sqrt(sum((tf * coalesce(idf, {m.unseen!r}::DOUBLE)) ** 2)) AS norm FROM w LEFT JOIN idf USING (term) GROUP BY ALL),
c AS (SELECT k, i, p, name, round(sum(tf * idf * weight) / any_value(norm), 9) AS cos FROM w JOIN n USING (k, i) JOIN idf USING (term) JOIN tpl USING (term) GROUP BY k, i, p, name HAVING any_value(must) IS NULL OR bool_or(term = must)),
own AS (SELECT k, cos, name FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY cos DESC, name) AS r FROM c WHERE cos >= {m.threshold}) WHERE r = 1),
given AS (SELECT dir AS above, cos, name FROM (SELECT dir, cos, name, row_number() OVER (PARTITION BY dir ORDER BY cos DESC, name) AS r FROM f JOIN own USING (k) WHERE is_file) WHERE r = 1),
inh AS (SELECT k, g.cos, g.name FROM (SELECT f.k, g.cos, g.name, row_number() OVER (PARTITION BY f.k ORDER BY length(above) DESC) AS r FROM f JOIN given g ON f.dir = above OR starts_with(f.dir, above || '/')) g WHERE r = 1)
SELECT doc_id, dir || '/' || CASE WHEN is_file THEN 'LICENSE' ELSE doc_id || '.txt' END AS path, coalesce(own.name, inh.name) AS licence,
       CASE WHEN own.name IS NOT NULL THEN 'notice' WHEN inh.name IS NOT NULL THEN 'directory' ELSE 'none' END AS via, round(coalesce(own.cos, inh.cos), 6) AS score
FROM f LEFT JOIN own USING (k) LEFT JOIN inh USING (k)
"""
