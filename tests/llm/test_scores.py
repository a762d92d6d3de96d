"""Quality, language and license operators."""

from __future__ import annotations

import random

import numpy as np

from paddock.llm import language, licenses, quality
from tests.llm.conftest import documents

FOLDER = "/root/testdata/sf0.01"


def test_quality_tells_junk(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.report(docs, labels)
    assert out.count() == docs.count()
    n = {(r.quality, r.kept): r["count"] for r in out.join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    assert n[1, True] / (n[1, True] + n.get((1, False), 0)) > 0.95
    assert n[0, False] / (n[0, False] + n.get((0, True), 0)) > 0.85


def test_quality_cases(spark, docs, no_docs, cases):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(20)] + [(30, 0, 0), (None, 1, 0), (31, None, 0)], "doc_id long, quality int, toxic int")
    kept = quality.selected(docs, labels)
    assert kept.columns == docs.columns
    assert not {100, 101, 102} & {r.doc_id for r in kept.select("doc_id").collect()}  # no n-grams
    assert quality.report(docs, labels).count() == len(cases)
    assert quality.report(no_docs, labels).count() == 0
    everything = quality.selected(docs, labels.where("false"))
    assert everything.count() == sum(bool((t or "").strip()) for _, t in cases)


def test_kth_largest(spark):
    values = [random.Random(2).choice([1.0, 2.5, -3e5, 7e-9, 4.0]) + k % 7 for k in range(500)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for k in (1, 3, 77, 499, 500):
        assert quality.kth_largest(frame, "v", k) == sorted(values, reverse=True)[k - 1]


def test_ratio_prefers_target():
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    raw[:2], target[0] = 50, 50
    ratio = quality.log_ratios(raw, target)
    assert ratio[0] > 0 > ratio[1]


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = language.report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert out.where("lang = lang_pred").count() / out.count() > 0.97
    assert out.where("score < 0 or score > 1").count() == 0


def test_language_is_not_told(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(200)
    profiles = language.learn(docs)
    other = docs.selectExpr("doc_id + 7 as doc_id", "text", "'xx' as lang")
    a = {r.doc_id: r.lang_pred for r in language.predict(docs, profiles).collect()}
    b = {r.doc_id: r.lang_pred for r in language.predict(other, profiles).collect()}
    assert all(b[i + 7] == lang for i, lang in a.items())


def test_language_cases(spark, docs, no_docs, cases):
    texts = [(k, t) for k, t in enumerate(["der die das und", "the and of to", "日本語", "12 34", "", None, "É"])] + [(None, "the")]
    some = documents(spark, texts, {0: "de", 1: "en", 2: "de", 6: "de", None: "en"})
    profiles = language.learn(some)
    out = {r.doc_id: (r.lang_pred, r.score) for r in language.predict(some, profiles).collect()}
    assert out[3] == out[4] == out[5] == ("und", 0.0)
    assert out[2][0] in profiles.languages and set(profiles.languages) <= {"de", "en"}
    assert language.report(docs).where("lang_pred <> 'und'").count() == 0  # no labels
    assert language.report(no_docs).count() == 0


def test_out_of_place_distance():
    rows = [("a", ord("x"), 0), ("a", ord("y"), 1), ("b", ord("y"), 0), ("b", ord("x"), 1), ("b", ord("z"), 2)]
    names, score = language.Profiles.of(rows).nearest(["xxy", "yyx", "z", "-"])
    assert names == ["a", "b", "b", "und"]
    assert score[0] == 1 and score[3] == 0


def test_licenses(spark, no_docs):
    texts = [
        (1, "Some text.\nLicensed under the Apache License, Version 2.0.\nmore"), (2, "Released under the MIT License."), (3, "Licensed under CC BY-NC 4.0."),
        (4, "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License."), (5, "ein Satz mit der License und mehr Text"),
        (6, None), (7, ""), (8, "Licensed under the house rules of the owner"), (9, "GNU Lesser General Public License, version 2.1"), (2, "Released under the MIT License."), (None, "BSD 3-Clause License"),
    ]
    docs = documents(spark, texts)
    out = {r.doc_id: r for r in licenses.report(docs).collect()}
    assert len(out) == 10
    assert {i: r.families for i, r in out.items()} == {1: "apache", 2: "mit", 3: "cc-by-nc", 4: "gpl,mit", 5: "", 6: "", 7: "", 8: "", 9: "lgpl", None: "bsd"}
    assert out[4].n_licensed == 2 and out[1].n_paragraphs == 3 and out[6].n_paragraphs == 0
    assert licenses.report(no_docs).count() == 0


def test_license_texts_wrapped_names_and_short_forms(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction"
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted"
    warranty = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY"
    prose = "The harbour was quiet and the boats lay still in the morning light.\nNobody spoke about the software of the port."
    texts = [
        mit, bsd, isc, warranty, f"{prose}\n\n{mit}\n\n{prose}", "This work is licensed under the GNU General Public\nLicense, version 3", "Licensed under CC\nBY-NC 4.0", "GPLv3", "License: LGPLv3",
        "BSD-3-Clause", "Apache 2.0", prose, "The Apache tribe lived there.", "You need a copyright license of the publisher for this software,\nand no warranty is given.",
    ]
    out = {r.doc_id: r for r in licenses.report(documents(spark, list(enumerate(texts)))).collect()}
    assert [out[i].families for i in range(len(texts))] == ["mit", "bsd", "isc", "mit", "mit", "gpl", "cc-by-nc", "gpl", "lgpl", "bsd", "apache", "", "", ""]
    assert out[5].n_licensed == 1 and out[5].n_paragraphs == 2
