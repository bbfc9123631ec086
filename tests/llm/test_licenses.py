import re

from tallyhouse.llm import licenses
from tallyhouse.llm.queries import QUERIES

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def base(text):
    words = SPLIT.findall(lower(text or ""))
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES:
        want = phrase.split()
        at = [i for i in range(len(words) - len(want) + 1) if words[i : i + len(want)] == want]
        starts += at
        if at:
            labels.add(label)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))


def brute_detections(text):
    norm = " " + " ".join(SPLIT.findall(lower(text or ""))) + " "
    found = []
    for r in licenses.rules():
        for m in re.finditer(r.pattern, norm):
            start = norm.count(" ", 0, m.start()) - 1
            found.append((start, start + m[0].count(" "), r.rank, r.number, r.label, m[0]))
    return {
        (d[4], d[2], d[0], d[1], d[5])
        for d in found
        if not any(
            e is not d and e[0] <= d[0] and e[1] >= d[1] and e[2] <= d[2] and ((e[0], -e[1], e[2], e[3]) < (d[0], -d[1], d[2], d[3]))
            for e in found
        )
    }


TEXTS = [
    "Released under the MIT License.",
    "under the\nMIT-license; under the mit license",
    "Apache License, Version 2.0",
    "Licensed under CC BY-NC 4.0. And CC-BY-NC-SA 4.0, CC BY 4.0; cc by nc",
    "SPDX-License-Identifier: GPL-2.0-only\nGNU General Public License version 2 or later",
    "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "ünder the mit license é cc by ncé",
    "under the mit licenses",
    "no words of interest here",
    "",
    None,
    "!!! ...",
    "cc by nc " * 2000,
    "All rights reserved. Dual licensed under the BSD 3-Clause license and the Mozilla Public License 2.0",
]


def test_every_rule_has_a_keyword_and_finds_its_gate():
    made = licenses.rules()
    assert len(made) > 200 and all(len(r.keyword) > 1 for r in made)
    assert len({r.pattern for r in made}) > 200


def test_scan_agrees_with_brute_force(spark):
    docs = spark.createDataFrame([*enumerate(TEXTS), (0, TEXTS[0]), (None, TEXTS[2])], "doc_id long, text string")
    found = licenses.scan_licenses(docs.selectExpr("*", "1 AS rank", "'k' AS keyword"), by=["doc_id"]).collect()
    assert len(found) == len(TEXTS) + 2
    wanted = dict(enumerate(TEXTS)) | {None: TEXTS[2]}
    for r in found:
        text = wanted[r["doc_id"]]
        got = (r["n_words"], r["n_base"], r["first_word"], r["last_word"], ",".join(r["base_labels"]))
        assert got == base(text), text
        assert r["labels"] == sorted({d[0] for d in brute_detections(text)} | set(r["base_labels"]))
        assert 0 <= r["score"] <= 1 and (r["score"] > 0) == bool(r["labels"])


def test_detections_agree_with_brute_force(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    found = {}
    for r in licenses.detections(docs, by=["doc_id"]).collect():
        found.setdefault(r["doc_id"], set()).add((r["label"], r["rank"], r["start"], r["end"], r["matched"]))
    for i, text in enumerate(TEXTS):
        assert found.get(i, set()) == brute_detections(text), text


def test_query_on_a_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    found = QUERIES["op10_licenses"](spark, "/root/testdata/sf0.001").collect()
    assert len(found) == len(docs)
    for r in found:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base(docs[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan_licenses(docs, by=["doc_id"]).count() == 0


def test_a_grant_is_looked_for_only_where_its_name_stands(spark):
    grants = [r for r in licenses.rules() if r.keyword == "under"]
    assert len(grants) > 100 and all(r.also.strip() != "under" for r in grants)
    # whatever a rule matches holds both of its literals
    texts = {"mit": "licensed under mit now", "apache-2": "released under the terms of the apache license version 2 0 x", "gpl-2": "covered under gplv2 y"}
    for label, text in texts.items():
        met = [r for r in grants if r.label == label and re.search(r.pattern, f" {text} ")]
        assert met and all(r.also in f" {text} " for r in met)
