"""License scans: a trained paragraph classifier, confirmed by templates.

A paragraph is a run of lines that are not blank once comment marks are
stripped.  It is judged line by line, and, because statements are often wrapped,
in windows of ``SPAN`` words that run across its lines (half overlapping; a
longer line is cut in the same way).  The sparse word n-grams (one to three
words, lower-cased) of such a unit go through a multinomial logistic regression
over licence families and an unknown class.  The model is trained on the
statements and declarations below, in variants made by a rule (names, years and
versions put in or changed, words added before or after, words left out),
against all units of the corpus that declare nothing: every unit without a
licence stem, and every different one that has a stem and agrees with no
template.  On the held-out half of the latter, and on held-out asides, the unknown
class is calibrated: a family needs the probability ``accept`` that no more than
``ALPHA`` of them reach.  Units of either kind weigh as much as ``WEIGHT`` rows in
all, however many they are, or the statements would weigh nothing against
a large corpus.  Units that hold the same words of the vocabulary in the same runs
are one row with their number as its weight.

A prediction counts when a template of its family agrees: the unit holds
at least ``CONFIRM`` of the distinct words and word pairs of one statement, or a
phrase that declares and a name of the family.  So a paragraph that only
mentions a licence stays unknown.

Everything is DataFrame expressions and the JVM's own feature transformers and
regression.  Units without any of the ``STEMS``, which every statement,
declaration and name holds, are not looked at further, and nothing is shuffled
but the verdicts.  Null and empty texts have no paragraphs.  Rows are judged one
by one: ties, repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizer, CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starlane.session import write_and_read

WEIGHT = 1500  # rows of training that all units of the corpus, of either kind, weigh at most
VARIANTS = 40  # training paragraphs made from each statement
DECLARED = 6  # and from each phrase with a name
VOCABULARY = 20_000
ALPHA = 0.001
CONFIRM = 0.6
SPAN = 64  # words of a window; every statement fits into half of it
UNKNOWN = "unknown"

#: Statements by which texts declare each licence family.
STATEMENTS = {
    "apache": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Available under the Creative Commons Attribution-ShareAlike License",
        "Dedicated to the public domain under CC0 1.0 Universal",
    ],
    "proprietary": [
        "All rights reserved.",
        "This document is confidential and proprietary and may not be copied or distributed without permission",
    ],
}
#: Phrases of other text that share words with statements.
ASIDES = [
    "see the license",
    "the license of the driver",
    "rights of the people",
    "version 2 of the file",
    "a public library",
    "free of charge",
    "work in general",
    "source of the data",
]
#: Phrases that declare a licence, before or after its name.
DECLARING = ("licensed under", "released under", "distributed under", "available under", "published under", "the terms of", "governed by", "covered by")
#: Names of the families, as words.
NAMES = {
    "apache": ("apache license", "apache licence", "apache 2", "apache v2"),
    "mit": ("mit license", "mit licence", "under mit", "the mit"),
    "bsd": ("bsd license", "bsd licence", "bsd style", "2 clause bsd", "3 clause bsd", "bsd 2 clause", "bsd 3 clause"),
    "gpl": ("the gpl", "gnu gpl", "gpl v2", "gpl v3", "gplv2", "gplv3", "gpl 2", "gpl 3"),
    "lgpl": ("the lgpl", "gnu lgpl", "lgpl v2", "lgpl v3", "lgplv2", "lgplv3", "lgpl 2", "lgpl 3"),
    "mpl": ("mozilla public license", "mozilla public licence", "the mpl", "mpl 2", "mpl v2"),
    "cc": ("creative commons", "cc by", "cc0"),
}
#: Stems (between single spaces) of which every statement and name holds one.
STEMS = (
    *("licen", "copyright", "rights reserved", "public domain", "creative commons", "spdx", "proprietary", "redistribut", "permission"),
    *("gpl", " bsd ", " mpl ", " apache ", " under mit ", " the mit ", "mozilla", " cc by ", " cc0 "),
)
#: Parts of stems, quick to look for, and a pattern of the other stems: a text with a stem holds one.
ROOTS = ("licen", "copyright", "reserved", "domain", "commons", "spdx", "proprietary", "redistribut", "permission", "gpl", "mozilla")
SHORT_STEMS = r"(?<![a-z0-9])(?:bsd|mpl|apache|cc0|(?:under|the)[^a-z0-9]+mit|cc[^a-z0-9]+by)(?![a-z0-9])"
#: Marks that open or close a line of a comment.
OPENING, CLOSING = r"(?m)^[ \t]*(?:/\*+|\*+/|//+|\*+|#+|--+|;+|%+|<!--|>+)?[ \t]*", r"(?m)(?<![ \t])[ \t]*+(?:\*+/|-->)?[ \t\r]*+$"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _may_mention(text: Column) -> Column:
    """Holds for every text that ``mentions`` a licence, and for few others."""

    def quick(small: Column) -> Column:
        out = F.contains(small, F.lit(ROOTS[0]))
        for root in ROOTS[1:]:
            out = out | F.contains(small, F.lit(root))
        return out | small.rlike(SHORT_STEMS)

    return F.coalesce(_let(F.lower(text), quick), F.lit(False))


def mentions(text: Column) -> Column:
    """Whether a text holds a licence stem, in any case."""
    small = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "), F.lit(" "))
    return _may_mention(text) & F.coalesce(_let(small, _mentioned), F.lit(False))


def _mentioned(small: Column) -> Column:
    out = F.contains(small, F.lit(STEMS[0]))
    for stem in STEMS[1:]:
        out = out | F.contains(small, F.lit(stem))
    return out


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def paragraphs(text: Column) -> Column:
    """Runs of lines that are not blank without comment marks; blank runs are
    left in as texts without a word."""
    return F.split(F.regexp_replace(F.regexp_replace(text, OPENING, ""), CLOSING, ""), "\n\n")


def _windows(tokens: Column) -> Column:
    """Windows of ``SPAN`` words, half overlapping, as one struct each."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - SPAN // 2, F.lit(1)), F.lit(SPAN // 2))
    return F.when(F.size(tokens) <= SPAN, F.array(tokens)).otherwise(F.transform(starts, lambda i: F.slice(tokens, i, SPAN)))


def _units_of(line: Column, text: Column) -> Column:
    """Units of a text that hold a stem, with ``line``."""
    spaced = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    cut = _let(words(text), _windows)
    each = F.transform(cut, lambda w: F.struct(line.alias("line"), w.alias("tokens"), spaced(w).alias("small")))
    return F.filter(each, lambda u: _mentioned(u.small))


def units(docs: DataFrame, row: Column) -> DataFrame:
    """Units that hold a stem: ``row``, ``paragraph`` (its number), ``line`` (its
    number within; null for a window across lines), ``tokens`` and ``small`` (the
    words between spaces)."""
    whole = docs.filter(mentions(F.col("text"))).select(row.alias("row"), F.posexplode(paragraphs(F.col("text"))).alias("paragraph", "text"))
    whole = whole.filter(mentions(F.col("text")))
    across = _units_of(F.lit(None).cast("int"), F.col("text"))
    several = F.contains(F.trim(F.col("text"), F.lit("\n")), F.lit("\n"))
    single = F.transform(F.split("text", "\n"), lambda x, i: F.when(_may_mention(x), _units_of(i, x)).otherwise(F.array()))
    each = F.concat(F.flatten(single), F.when(several, across).otherwise(F.array()))
    return whole.select("row", "paragraph", F.explode(each).alias("unit")).select("row", "paragraph", "unit.*")


def n_grams(tokens: Column) -> Column:
    """One to three consecutive words, each as one string."""

    def of(n: int) -> Column:
        at = F.sequence(F.lit(1), F.size(tokens) - (n - 1))
        return F.when(F.size(tokens) >= n, F.transform(at, lambda i: F.array_join(F.slice(tokens, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*[of(n) for n in (1, 2, 3)]))


def variants(statement: str, rng: random.Random) -> list[str]:
    """The statement and paragraphs like it."""
    extra = "file project code notice see details copyright holder 2019 2024 by the author authors team inc work data text".split()
    out = [statement]
    for _ in range(VARIANTS - 1):
        tokens = statement.split()
        if len(tokens) > 6 and rng.random() < 0.5:
            del tokens[rng.randrange(len(tokens))]
        before, after = (rng.choices(extra, k=rng.randint(0, 5)) for _ in range(2))
        out.append(" ".join([*before, *tokens, *after]))
    return out


@dataclass
class Scanner:
    vocabulary: CountVectorizerModel
    regression: LogisticRegressionModel
    families: list[str]
    accept: float


def _runs(tokens: Column, known: list[str]) -> Column:
    """The different runs of ``known`` words among ``tokens``, sorted; they hold
    every n-gram of known words that the tokens hold."""
    marked = F.array_join(F.transform(tokens, lambda w: F.when(w.isin(*known), w)), " ", "\n")
    return F.array_sort(F.array_distinct(F.filter(F.split(marked, r"[ \n]*\n[ \n]*"), lambda run: run != "")))


def _plain_units(docs: DataFrame, known: list[str]) -> DataFrame:
    """Every unit of the lines without a licence stem: ``runs`` of known words, and
    the number ``n`` of units that have those."""
    line = docs.select(F.explode(F.split("text", "\n")).alias("text")).filter((F.col("text") != "") & ~mentions(F.col("text")))
    unit = line.select(F.explode(_let(words(F.col("text")), _windows)).alias("tokens"))
    return unit.groupBy(_runs(F.col("tokens"), known).alias("runs")).agg(F.count(F.lit(1)).alias("n"))


def _near_units(docs: DataFrame) -> DataFrame:
    """The ``text`` of every different unit that has a licence stem and agrees with
    no template."""
    near = units(docs.select("text"), F.lit(None).cast("int")).select(F.trim("small").alias("text")).distinct()
    return near.filter(_any_agreement(n_grams(words(F.col("text")))) < CONFIRM)


def _training_rows(spark: SparkSession, seed: int) -> DataFrame:
    rng = random.Random(seed)
    families = [UNKNOWN, *STATEMENTS]
    rows = []
    for family, statements in STATEMENTS.items():
        for statement in statements:
            for i, text in enumerate(variants(statement, rng)):
                rows.append({"label": float(families.index(family)), "held": i % 4 == 3, "text": text})
    for family, names in NAMES.items():
        for phrase in DECLARING:
            for name in names:
                for i, text in enumerate(variants(f"{phrase} {name}", rng)[:DECLARED]):
                    rows.append({"label": float(families.index(family)), "held": i % 4 == 3, "text": text})
    for aside in ASIDES:
        rows += [{"label": 0.0, "held": i % 4 == 3, "text": text} for i, text in enumerate(variants(aside, rng))]
    parsed = F.from_json(F.lit(json.dumps(rows)), "array<struct<label: double, held: boolean, text: string>>")
    return spark.range(1).select(F.inline(parsed))


def fit(docs: DataFrame, seed: int = 11) -> Scanner:
    """Train on the statements, the declarations and all units of ``docs`` that
    declare nothing."""
    families = [UNKNOWN, *STATEMENTS]
    one = F.lit(1).cast("long").alias("n")
    made = _training_rows(docs.sparkSession, seed).select("label", "held", F.lit("made").alias("kind"), one, n_grams(words(F.col("text"))).alias("grams"))
    vocabulary = CountVectorizer(inputCol="grams", outputCol="features", vocabSize=VOCABULARY, minDF=2, binary=True).fit(made.filter("label > 0"))
    known = sorted({w for gram in vocabulary.vocabulary for w in gram.split(" ")})
    grams = F.flatten(F.transform("runs", lambda run: n_grams(F.split(run, " "))))
    plain = _plain_units(docs, known).select(F.lit(0.0).alias("label"), F.lit(False).alias("held"), F.lit("plain").alias("kind"), "n", grams.alias("grams"))
    held = F.pmod(F.xxhash64("text"), F.lit(2)) == 0
    near = _near_units(docs).select(F.lit(0.0).alias("label"), held.alias("held"), F.lit("near").alias("kind"), one, n_grams(words(F.col("text"))).alias("grams"))
    rows = vocabulary.transform(made.unionByName(plain).unionByName(near)).drop("grams")
    rows = write_and_read(rows, "license-training")
    train = rows.filter("NOT held")
    total = {r.kind: r.n for r in train.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    share = F.lit(1.0)
    for kind in ("plain", "near"):
        share = F.when(F.col("kind") == kind, min(1.0, WEIGHT / total.get(kind, 1))).otherwise(share)
    train = train.withColumn("weight", F.col("n") * share)
    regression = LogisticRegression(maxIter=60, regParam=1e-3, family="multinomial", weightCol="weight").fit(train)
    calibrating = regression.transform(rows.filter("held AND label = 0"))
    top = calibrating.select(F.array_max(F.slice(vector_to_array("probability"), 2, len(families) - 1)).alias("p"))
    accept = top.agg(F.percentile(F.round("p", 6), 1 - ALPHA)).first()[0]  # rounded: no more than a million values to hold
    return Scanner(vocabulary, regression, families, max(0.5, min(0.95, float(accept or 0.0))))


def _family_agreement(grams: Column, family: str) -> Column:
    """Best share of a template's distinct words and word pairs found in a
    unit; 1 with a phrase that declares and a name of the family."""
    shares = []
    for statement in STATEMENTS[family]:
        w = "".join(c if c.isalnum() else " " for c in statement.lower()).split()
        parts = sorted({*w, *(f"{a} {b}" for a, b in zip(w, w[1:], strict=False))})
        shares.append(F.size(F.array_intersect(grams, F.array(*[F.lit(x) for x in parts]))) / float(len(parts)))
    if family in NAMES:
        told, named = (F.arrays_overlap(grams, F.array(*[F.lit(x) for x in some])) for some in (DECLARING, NAMES[family]))
        shares.append((told & named).cast("double"))
    return F.greatest(*shares, F.lit(0.0))


def _agreement(grams: Column, family: Column, families: list[str]) -> Column:
    out = F.lit(0.0)
    for name in families[1:]:
        out = F.when(family == name, _family_agreement(grams, name)).otherwise(out)
    return out


def _any_agreement(grams: Column) -> Column:
    return _let(grams, lambda g: F.greatest(*[_family_agreement(g, name) for name in STATEMENTS]))


def scan(docs: DataFrame, scanner: Scanner, keep: list[str] | None = None) -> DataFrame:
    """One row for each unit that holds a licence stem: the kept columns as
    ``row``, ``paragraph`` and ``line`` (see ``units``), ``text`` (its words),
    ``family`` (or ``unknown``), ``probability`` and ``agreement``."""
    columns = docs.columns if keep is None else keep
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`").alias(c) for c in columns])
    parts = units(docs, row).withColumn("grams", n_grams(F.col("tokens")))
    scored = PipelineModel([scanner.vocabulary, scanner.regression]).transform(parts)
    best = F.slice(vector_to_array("probability"), 2, len(scanner.families) - 1)
    scored = scored.select("row", "paragraph", "line", F.trim("small").alias("text"), "grams", best.alias("best")).withColumn("probability", F.array_max("best"))
    names = F.array(*[F.lit(f) for f in scanner.families[1:]])
    guess = F.get(names, (F.array_position("best", F.col("probability")) - 1).cast("int"))
    scored = scored.withColumn("agreement", _agreement(F.col("grams"), guess, scanner.families))
    sure = (F.col("probability") >= scanner.accept) & (F.col("agreement") >= CONFIRM)
    return scored.select("row", "paragraph", "line", "text", F.when(sure, guess).otherwise(UNKNOWN).alias("family"), "probability", "agreement")


def summary(found: DataFrame) -> DataFrame:
    """For each different ``row`` of a ``scan``: ``n_licensed`` (lines that declare
    a family, and families that a paragraph declares only across its lines),
    ``n_unknown`` (paragraphs that mention a licence and declare none) and
    the sorted ``families``.  Equal rows count once."""
    family = F.when(F.col("family") != UNKNOWN, F.col("family"))
    alone = F.col("line").isNotNull()
    by_paragraph = found.groupBy("row", "paragraph").agg(
        F.count_distinct(F.when(family.isNotNull(), F.col("line"))).alias("lines"),
        F.collect_set(F.when(alone, family)).alias("own"),
        F.collect_set(F.when(~alone, family)).alias("joined"),
    )
    declared = F.col("lines") + F.size(F.array_except("joined", "own"))
    return by_paragraph.groupBy("row").agg(
        F.sum(declared).alias("n_licensed"),
        F.count(F.when(declared == 0, 1)).alias("n_unknown"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_union("own", "joined"))))).alias("families"),
    )
