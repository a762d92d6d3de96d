"""License scan with a trained paragraph classifier, in DataFrame operations and JVM models only.

Scored are lines and, where wrapped lines of a paragraph (between blank lines) are joined, windows of its words: short ones for
names, each judged by the marks in its middle so that none is cut off, and long ones for the families' texts. Each is a bag
of hashed unigrams and bigrams; a multinomial logistic regression names its license
family or `unknown`. It is trained on notices made from the names of the families, on their texts, on notices that name none, and
on a bounded sample of the corpus' own paragraphs without any license word. The unknown class is calibrated: a family counts only
above the probability that the training paragraphs held back as unknown do not reach. Then the
prediction must be confirmed by a template: a mark of a name or text of that family and at least three quarters of
its pairs of words. What has no mark of a name or text can therefore not be confirmed, and is not scored.

Rows: a null text has no paragraphs. Rows with the same id and text (repeated rows) give one result row; a null
id is an id. Empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: hashed features; texts, and paragraphs of them, that stand for unlicensed text, at most
FEATURES, CORPUS_TEXTS, CORPUS_ROWS = 2**14, 200, 2_000
CONTAINED, LEAST = 0.75, 0.5
#: words in the middle of a window for names, and words that two windows for texts have in common
NAME_STEP, TEXT_STEP = 8, 32

# Names of licenses by family; the mark is a word that a name is not recognised without.
NAMES = {
    "agpl": [("agpl", "AGPL-3.0"), ("agplv3", "AGPLv3"), ("affero", "GNU Affero General Public License, version 3")],
    "apache": [("apache", "Apache License, Version 2.0"), ("apache", "Apache-2.0 license"), ("apache", "Apache 2"), ("apache2", "Apache2")],
    "bsd": [("bsd", "BSD 3-Clause License"), ("bsd", "BSD-2-Clause license"), ("bsd", "BSD License"), ("bsd", "BSD-3-Clause")],
    "cc-by": [("cc", "CC BY 4.0"), ("creative", "Creative Commons Attribution 4.0 International License")],
    "cc-by-nc": [("nc", "CC BY-NC 4.0"), ("noncommercial", "Creative Commons Attribution NonCommercial 4.0 License")],
    "cc-by-sa": [("sa", "CC BY-SA 4.0"), ("sharealike", "Creative Commons Attribution ShareAlike 4.0 License")],
    "cc0": [("cc0", "CC0 1.0 Universal"), ("cc0", "CC0 public domain dedication")],
    "gpl": [("gpl", "GPL-3.0"), ("gplv2", "GPLv2"), ("gplv3", "GPLv3"), ("gnu", "GNU General Public License, version 3"), ("gnu", "GNU GPL version 2 or later")],
    "isc": [("isc", "ISC License"), ("isc", "ISC licence")],
    "lgpl": [("lgpl", "LGPL-2.1"), ("lgplv2", "LGPLv2.1"), ("lgplv3", "LGPLv3"), ("lesser", "GNU Lesser General Public License, version 2.1")],
    "mit": [("license", "MIT License"), ("licence", "MIT Licence"), ("spdx", "SPDX-License-Identifier: MIT"), ("licensed", "MIT licensed"), ("licensed", "licensed under MIT")],
    "mpl": [("mpl", "MPL-2.0"), ("mozilla", "Mozilla Public License, Version 2.0")],
    "unlicense": [("unlicense", "The Unlicense")],
}
# Texts of the families, a sentence or clause of at most TEXT_STEP words each.
TEXTS = {
    "agpl": ["it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU Affero General Public License along with this program"],
    "apache": [
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES",
    ],
    "cc0": ["has waived all copyright and related or neighboring rights to this work", "has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law"],
    "gpl": ["it under the terms of the GNU General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU General Public License along with this program"],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE",
    ],
    "lgpl": ["it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "You should have received a copy of the GNU Lesser General Public License along with this library"],
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY",
    ],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License", "If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "unlicense": ["This is free and unencumbered software released into the public domain", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"],
}
#: words of the texts; each text has some of them, and is not recognised without any
TEXT_MARKS = ["affero", "compile", "copyright", "disclaims", "distribute", "distributed", "gnu", "hereby", "lesser", "license", "mozilla", "mpl", "redistribution", "redistributions", "software", "sublicense", "unencumbered", "warranties", "warranty"]
FRAMES = (
    "{}", "{}.", "Licensed under {}.", "Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.",
    "This work is licensed under {}.", "This software is distributed under the terms of the {}.", "Published under {}",
    "You may use this file under the {}.", "See the {} for details.", "Copyright 2020 the authors, {}", "License: {}", "SPDX-License-Identifier: {}",
)
NO_NAMES = (
    "terms of the agreement", "proprietary license of the owner", "house rules", "license of the publisher", "terms agreed with the author",
    "driving license", "general terms of public use", "creative work of the authors", "version 3", "version 2.0", "internal license", "commons", "public domain",
)

_MARKS = sorted({mark for names in NAMES.values() for mark, _ in names})
#: a first, cheap test on whole texts and lines
MARKED = r"(?i)(?<![a-z0-9])(?:" + "|".join(sorted({*_MARKS, *TEXT_MARKS})) + r")(?![a-z0-9])"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))


def grams(tokens: Column) -> Column:
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(tokens, pairs)


def training(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(family, held_back, grams)"""
    rows = [(family, False, frame.format(name)) for family, names in NAMES.items() for _, name in names for frame in FRAMES]
    # whole and cut, as long windows have them
    cuts = lambda text: [" ".join(w[a:b]) for w in [text.split()] for a, b in ((0, None), (2, None), (0, -2))]
    rows += [(family, False, cut) for family, texts in TEXTS.items() for text in texts for cut in cuts(text)]
    rows += [(family, False, " ".join(texts)) for family, texts in TEXTS.items()]
    rows += [(UNKNOWN, i % 4 == 0, frame.format(name)) for i, (name, frame) in enumerate((n, f) for n in NO_NAMES for f in FRAMES)]
    made = spark.createDataFrame(rows, "family string, held_back boolean, paragraph string")
    some = docs.select(F.col(text_col).alias("text")).orderBy(F.xxhash64("text"), "text").limit(CORPUS_TEXTS)
    lines = some.select(F.explode(F.split("text", "\n")).alias("paragraph"))
    lines = lines.where((F.length("paragraph") > 0) & ~F.col("paragraph").rlike(MARKED))
    drawn = lines.orderBy(F.xxhash64("paragraph"), "paragraph").limit(CORPUS_ROWS)
    drawn = drawn.select(F.lit(UNKNOWN).alias("family"), (F.pmod(F.xxhash64("paragraph", F.lit(1)), F.lit(4)) == 0).alias("held_back"), "paragraph")
    return made.unionByName(drawn).select("family", "held_back", grams(words(F.col("paragraph"))).alias("grams"))


def fit(docs: DataFrame, text_col: str = "text") -> tuple[PipelineModel, list[str], float]:
    """The classifier, its labels, and the least probability of a family."""
    rows = training(docs.sparkSession, docs, text_col).cache()
    counted = HashingTF(numFeatures=FEATURES, inputCol="grams", outputCol="features")
    labelled = StringIndexer(inputCol="family", outputCol="label", stringOrderType="alphabetAsc")
    regression = LogisticRegression(maxIter=60, regParam=1e-3, family="multinomial")
    model = Pipeline(stages=[labelled, counted, regression]).fit(rows.where("not held_back"))
    labels = model.stages[0].labels
    unknown = labels.index(UNKNOWN)
    back = model.transform(rows.where("held_back")).select(vector_to_array("probability").alias("p"))
    reached = back.agg(F.max(F.array_max(F.filter("p", lambda _, i: i != unknown)))).first()[0]
    rows.unpersist()
    return model, labels, max(LEAST, min(reached or 0.0, 0.9))


def _plain(word: str) -> bool:
    return not word.isdigit() and word != "version"


def _agrees(pairs: Column, text: str) -> Column:
    own = [w for w in "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split() if _plain(w)]
    both = sorted({f"{x} {y}" for x, y in zip(own, own[1:], strict=False)})
    return F.size(F.array_intersect(pairs, F.array(*map(F.lit, both)))) >= CONTAINED * len(both) if both else F.lit(True)


def confirmed(tokens: Column, family: Column, middle: Column | None = None) -> Column:
    """Does a template of the family agree? Compares pairs of words; numbers and "version" do not count. The mark of a
    name must be among the middle words, if they are given."""
    plain = F.filter(tokens, lambda w: ~w.rlike("^[0-9]+$") & (w != "version"))
    pairs = F.filter(grams(plain), lambda g: g.contains(" "))
    middle = tokens if middle is None else middle
    out = F.lit(False)
    for key, names in NAMES.items():
        agree = []
        for mark, name in names:
            # a word that says little alone needs its number
            numbered = F.array_contains(grams(tokens), "apache 2") if name == "Apache 2" else F.lit(True)
            agree.append(F.array_contains(middle, mark) & numbered & _agrees(pairs, name))
        agree += [_agrees(pairs, text) for text in TEXTS.get(key, [])]
        out = out | ((family == key) & reduce(Column.__or__, agree))
    return out


def _windows(tokens: Column, size: int, step: int, before: int) -> Column:
    """(paragraph, middle) for windows of some words; the middle has `step` words after the first `before`."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)), F.lit(step))
    first = lambda i: F.greatest(i - before, F.lit(0))
    cut = lambda i: F.slice(tokens, first(i) + 1, size - before + i - first(i))
    return F.transform(starts, lambda i: F.struct(F.array_join(cut(i), " ").alias("paragraph"), F.slice(tokens, i + 1, F.lit(step)).alias("middle")))


def paragraphs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, n_paragraphs, block, line, paragraph, middle): one row per line, or window of a block, with
    a mark, or one with null. `middle` is null for lines: all words."""
    text = F.col(text_col)
    lines = lambda t: F.split(t, "\n")
    marked = F.when(text.rlike(MARKED), F.filter(F.split(text, r"\n[ \t\r]*\n"), lambda b: b.rlike(MARKED)))
    count = F.size(F.filter(lines(F.coalesce(text, F.lit(""))), lambda p: F.length(p) > 0)).cast("long")
    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), count.alias("n_paragraphs"), marked.alias("_marked"))
    base = base.select("doc_id", "text_hash", "n_paragraphs", F.posexplode_outer("_marked").alias("block", "_block")).withColumn("_words", words(F.coalesce("_block", F.lit(""))))
    some = F.array().cast("array<string>")
    unit = lambda line, paragraph, middle: F.struct(F.lit(line).alias("line"), paragraph.alias("paragraph"), middle.alias("middle"))
    single = F.transform(F.filter(lines(F.col("_block")), lambda p: p.rlike(MARKED)), lambda p: unit(True, p, F.lit(None).cast("array<string>")))
    short = F.filter(_windows(F.col("_words"), 3 * NAME_STEP, NAME_STEP, NAME_STEP), lambda w: F.arrays_overlap(w["middle"], F.array(*map(F.lit, _MARKS))))
    long = F.filter(_windows(F.col("_words"), 2 * TEXT_STEP, TEXT_STEP, 0), lambda w: w["paragraph"].rlike(MARKED))
    units = F.concat(single, F.transform(short, lambda w: unit(False, w["paragraph"], w["middle"])), F.transform(long, lambda w: unit(False, w["paragraph"], some)))
    units = F.when(F.col("_block").isNotNull(), units)
    return base.select("doc_id", "text_hash", "n_paragraphs", "block", F.explode_outer(units).alias("_unit")).select("doc_id", "text_hash", "n_paragraphs", "block", "_unit.*")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Marked lines and windows with predicted family, its probability, and the confirmed family or `unknown`."""
    model, labels, least = fit(docs, text_col)
    own = paragraphs(docs, id_col, text_col).withColumn("tokens", words(F.coalesce("paragraph", F.lit(""))))
    scored = model.stages[2].transform(model.stages[1].transform(own.withColumn("grams", grams(F.col("tokens")))))
    unknown = labels.index(UNKNOWN)
    p = F.transform(vector_to_array("probability"), lambda x, i: F.struct(F.when(i == unknown, -1.0).otherwise(x).alias("p"), i.alias("i")))
    scored = scored.withColumn("best", F.array_max(p)).withColumn("probability", F.col("best.p"))
    scored = scored.withColumn("predicted", F.array(*map(F.lit, labels))[F.col("best.i")])
    sure = (F.col("probability") >= least) & confirmed(F.col("tokens"), F.col("predicted"), F.coalesce("middle", "tokens"))
    family = F.when(F.col("paragraph").isNotNull(), F.when(sure, F.col("predicted")).otherwise(UNKNOWN))
    return scored.select("doc_id", "text_hash", "n_paragraphs", "block", "line", "paragraph", "predicted", "probability", family.alias("family"))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs (lines), n_licensed (lines of a known family, and one for each paragraph whose joined lines
    tell a family that none of its lines does), families (sorted, comma-joined), score (the highest probability of a
    confirmed family, else 0)."""
    known = F.coalesce((F.col("family") != UNKNOWN) & F.col("paragraph").isNotNull(), F.lit(False))
    blocks = scan(docs).groupBy("doc_id", "text_hash", "block").agg(
        F.max("n_paragraphs").alias("n_paragraphs"),
        F.count_if(known & F.col("line")).alias("lines"),
        F.collect_set(F.when(known & F.col("line"), F.col("family"))).alias("own"),
        F.collect_set(F.when(known, F.col("family"))).alias("all"),
        F.max(F.when(known, F.col("probability"))).alias("score"),
    )
    out = blocks.groupBy("doc_id", "text_hash").agg(
        F.max("n_paragraphs").alias("n_paragraphs"),
        F.sum(F.col("lines") + (F.size("all") > F.size("own")).cast("long")).alias("n_licensed"),
        F.array_join(F.sort_array(F.array_distinct(F.flatten(F.collect_set("all")))), ",").alias("families"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"),
    )
    return out.drop("text_hash")
