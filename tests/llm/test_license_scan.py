import itertools
import random
import re

from pyspark.sql import functions as F

from starlane.llm import license_scan, queries

SF = "/root/testdata/sf0.01"


def test_query_finds_the_planted_lines(spark):
    planted = {
        "Licensed under CC BY-NC 4.0.": "cc",
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Licensed under the Apache License, Version 2.0.": "apache",
        "Released under the MIT License.": "mit",
        "All rights reserved.": "proprietary",
    }
    got = {r.doc_id: r for r in queries.op9_license_scan(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        lines = [x for x in d.text.split("\n") if x in planted]
        assert got[d.doc_id].families == ",".join(sorted({planted[x] for x in lines}))
        assert got[d.doc_id].n_licensed == len(lines)


def test_families_and_unknown(spark):
    said = [(f, s) for f, all_ in license_scan.STATEMENTS.items() for s in all_]
    norm = lambda s: " " + " ".join(re.findall(r"[a-z0-9]+", s.lower())) + " "
    assert all(any(stem in norm(s) for stem in license_scan.STEMS) for _, s in said)
    assert all(any(stem in norm(f"{d} {n}") for stem in license_scan.STEMS) for d in license_scan.DECLARING for ns in license_scan.NAMES.values() for n in ns)
    plain = ["The driver lost the license last week and walked home", "permission to land", "copyright law is a long subject of study", "no stem here"]
    long_line = "word " * 3000 + said[1][1] + " word" * 3000
    rows = [(i, f"intro\n{s} thanks", "f") for i, (_, s) in enumerate(said)]
    rows += [(100 + i, t, "p") for i, t in enumerate(plain)] + [(200, long_line, "l"), (201, None, "l"), (202, "", "l"), (None, said[0][1], "l"), (0, rows[0][1], "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, family string")
    train = spark.createDataFrame([(i, f"some plain text number {i}\nand a library of software work {i}") for i in range(300)], "doc_id long, text string")
    scanner = license_scan.fit(train)
    got = license_scan.scan(docs, scanner).select("row.doc_id", "line", "family", "text").collect()
    found = {(r.doc_id, r.family) for r in got if r.family != "unknown"}
    want = {(i, f) for i, (f, _) in enumerate(said)} | {(200, said[1][0]), (None, said[0][0])}
    assert found == want
    assert {r.doc_id for r in got if r.family == "unknown"} >= {100, 101, 102} and 103 not in {r.doc_id for r in got}
    assert sum(r.doc_id == 0 and r.line is not None for r in got) == 2
    assert license_scan.scan(docs.limit(0), scanner).count() == 0
    assert license_scan.scan(docs, license_scan.fit(train.limit(0))).count() >= len(said)


def test_no_python_in_the_plan(spark, capsys):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    license_scan.scan(docs, license_scan.fit(docs)).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)


#: The standard notices, wrapped as files have them.
WRAPPED = {
    "gpl": """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version.""",
    "bsd": """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:""",
    "apache": """// Licensed under the Apache License, Version 2.0 (the "License");
// you may not use this file except in compliance with the License.
// You may obtain a copy of the License at
//
//     http://www.apache.org/licenses/LICENSE-2.0""",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a
copy of this software and associated documentation files (the "Software"),
to deal in the Software without restriction""",
    "lgpl": """   This library is free software; you can redistribute it and/or
   modify it under the terms of the GNU Lesser General Public
   License as published by the Free Software Foundation""",
    "mpl": """<!-- This Source Code Form is subject to the terms of the Mozilla
Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/. -->""",
}


def test_wrapped_notices_names_and_rows(spark):
    short = {
        "Distributed under the terms of the GPL v3": "gpl",
        "Available under BSD 2-Clause": "bsd",
        "Code released under GPLv2": "gpl",
        "The data are licensed under CC BY 4.0": "cc",
        "published under the MIT licence": "mit",
    }
    prose = "\n".join(f"the harbour was quiet on day {i} and nobody came by the old road" for i in range(12))
    rows = [(f, f"{prose}\n\n{text}\n\n{prose}", f) for f, text in WRAPPED.items()]
    rows += [(f"in {f}", f"{prose}\n{text}\n{prose}", f) for f, text in WRAPPED.items()]
    rows += [(s, f"{prose}\n{s}\n{prose}", f) for s, f in short.items()]
    rows += [("twice", WRAPPED["gpl"], "gpl"), ("twice", "nothing here", None), ("none", None, None), ("empty", "", None), (None, WRAPPED["bsd"], "bsd")]
    rows += [("asides", "he lost the license\nunder the terms of the contract\n\nthe gpl was long\nmit ihm", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, `a.b` string")
    train = spark.createDataFrame([(i, f"some plain text number {i}\nand a library of software work {i}\nthe license of driver {i} ended") for i in range(300)], "doc_id long, text string")
    scanner = license_scan.fit(train)
    got = license_scan.summary(license_scan.scan(docs, scanner)).select("row.*", "n_licensed", "n_unknown", "families").collect()
    families = {(r.doc_id, r["a.b"]): r.families for r in got}
    for name, _, family in rows:
        if family:
            assert families[name, family] == [family], name
    assert families["asides", None] == [] and {("twice", None), ("none", None), ("empty", None)}.isdisjoint(families)
    counts = {(r.doc_id, r["a.b"]): (r.n_licensed, r.n_unknown) for r in got}
    assert counts["asides", None] == (0, 2)
    assert all(counts[s, f] == (1, 0) for s, f in short.items())
    assert all(counts[f, f][0] >= 1 for f in WRAPPED)


def test_query_tells_rows_of_one_id_apart(spark, tmp_path):
    rows = [(1, "Released under the MIT License."), (1, "nothing"), (2, "Licensed under CC BY-NC 4.0."), (2, "Licensed under CC BY-NC 4.0."), (None, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op9_license_scan(spark, str(tmp_path)).collect()]
    want = [(1, 1, 0, "mit"), (1, 0, 0, ""), (2, 1, 0, "cc"), (2, 1, 0, "cc"), (None, 0, 0, "")]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_mentions_and_units_against_brute_force(spark):
    rng = random.Random(5)
    parts = [w for s in license_scan.STEMS for w in s.split()] + ["tümit", "bsd9", "é", "wide", "Example", "cc", "by", "Ünder", "The", "MIT"]
    gaps = [" ", "  ", "-", "\n", "\n\n", "\n * ", ". ", "", "_", " */\n", "\n# ", "\t"]
    texts = ["".join(rng.choice(parts) + rng.choice(gaps) for _ in range(rng.choice([1, 3, 12, 150]))) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "", None, " \n\n\n "])], "doc_id long, text string")

    def tokens(text):
        return ["".join(g) for alnum, g in itertools.groupby(text.lower(), str.isalnum) if alnum]

    def stem(some):
        return any(s in f" {' '.join(some)} " for s in license_scan.STEMS)

    def cut(some):
        size, half = license_scan.SPAN, license_scan.SPAN // 2
        return [some] if len(some) <= size else [some[i : i + size] for i in range(0, len(some) - half, half)]

    want = []
    for i, text in enumerate(texts):
        lines = [re.sub(r"\s*(\*+/|-->)?\s*$", "", re.sub(r"^[ \t]*(/\*+|\*+/|//+|\*+|#+|--+|;+|%+|<!--|>+)?[ \t]*", "", x)) for x in text.split("\n")]
        for blank, run in itertools.groupby(lines, lambda x: not x):
            run = [] if blank else list(run)
            units = [w for x in run for w in cut(tokens(x))] + (cut(tokens("\n".join(run))) if len(run) > 1 else [])
            want += [(i, " ".join(w)) for w in units if stem(w)]
    got = license_scan.units(docs, F.struct("doc_id")).select("row.doc_id", F.trim("small")).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    said = {r.doc_id for r in docs.filter(license_scan.mentions(F.col("text"))).collect()}
    assert said == {i for i, t in enumerate(texts) if stem(tokens(t))}


def test_fit_trains_on_every_unit_of_the_corpus(spark, monkeypatch):
    rng = random.Random(3)
    some = "the of and to you may not this file work library software terms harbour quiet road zebra".split()
    lines = [" ".join(rng.choice(some) for _ in range(rng.choice([1, 4, 9]))) for _ in range(3600)] + [" ".join(rng.choice(some) for _ in range(900))]
    near = [f"he lost the license on day {i}" for i in range(7)]
    rows = [(i, x) for i, x in enumerate([*lines, *near, f"two\nlines\n\n{near[0]}", "Released under the MIT License.", "", None])]
    kept = []
    monkeypatch.setattr(license_scan, "write_and_read", lambda df, name: kept.append(df.cache()) or kept[-1])
    scanner = license_scan.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.kind: (r.n, r.rows) for r in kept[0].groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()}
    windows = len(range(0, 900 - license_scan.SPAN // 2, license_scan.SPAN // 2))
    assert got["plain"][0] == 3600 + windows + 2  # every line, and the windows of a long one
    assert got["near"] == (len(near), len(near))
    assert got["plain"][1] < 3000  # equal rows are one with a weight
    known = set(scanner.vocabulary.vocabulary)
    grams = lambda w: {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)} & known
    words = sorted({w for g in known for w in g.split(" ")})
    said = spark.createDataFrame([(x.split(" "),) for x in lines[:300]], "tokens array<string>")
    for r in said.select("tokens", license_scan._runs(F.col("tokens"), words).alias("runs")).collect():
        assert set().union(*[grams(run.split(" ")) for run in r.runs]) == grams(r.tokens)
    kept[0].unpersist()
