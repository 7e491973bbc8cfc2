import re

from fleetlens.llm import licenses

TEXTS = [
    "Released under the MIT License.", "under the mit license under THE\nmit-license", "Apache License, Version 2.0", "CC BY-NC 4.0 cc by nc",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU big General Public License version 2 now",
    "Permission is hereby granted, free of charge, to any person getting a copy of this software and associated documentation files",
    "nothing here", "", None, "under the mit", "KIT under the MIT License", "ünder the mit license", "words " * 30000 + "cc by nc",
    "permission is hereby granted", "the mit license under",
]


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    found = [
        (i, label)
        for label, phrase in licenses.PHRASES
        for p in [phrase.split()]
        for i in range(len(words) - len(p) + 1)
        if words[i : i + len(p)] == p
    ]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_base_against_brute_force(spark, documents):
    df = documents([*enumerate(TEXTS), (0, TEXTS[0])])
    got = licenses.scan(df).collect()
    assert len(got) == len(TEXTS) + 1
    for r in got:
        assert tuple(r)[1:6] == brute(TEXTS[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_spans_of_the_method(documents):
    got = {r["doc_id"]: r for r in licenses.scan(documents(enumerate(TEXTS))).collect()}
    assert got[4]["labels"] == "gpl-3" and got[5]["labels"] == "gpl-2" and got[6]["labels"] == "mit" and got[6]["base_labels"] == ""
    assert got[6]["score"] < 1 and [s["first"] for s in got[6]["spans"]] == [0]
    assert all(got[i]["labels"] == "" and got[i]["score"] == 0 for i in (7, 8, 9, 10, 12, 14, 15))


def test_labels_of_versions_and_program_notices(documents):
    texts = {
        "licensed under the GNU Lesser General Public License version 3": "lgpl",
        "It is licensed under the GNU Lesser General Public License, version 2.1 or later": "lgpl",
        "licensed under the gnu lesser general public license": "lgpl",
        "licensed under the GNU General Public License version 3, or the GNU Lesser General Public License": "gpl-3,lgpl",
        "// SPDX-License-Identifier: MIT": "mit",
        "# SPDX-License-Identifier: LGPL-3.0-or-later": "lgpl",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that": "bsd",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.": "gpl-3",
        "licensed under the gnu general public license version 2 licensed under the gnu lesser general public license version 3": "gpl-2,lgpl",
    }
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(documents(enumerate(texts))).collect()}
    assert [got[i] for i in range(len(texts))] == list(texts.values())


def test_only_direct_overlaps_are_dropped(documents):
    """a overlaps b and b overlaps c, but a and c stand apart: the middle one, met loosely, goes and both others stay."""
    notices = [("a", "one two three four"), ("b", "three four five six seven x eight nine"), ("c", "seven eight nine ten")]
    text = "one two three four five six seven eight nine ten"
    row = licenses.scan(documents([(1, text), (2, text + " filler " + text)]), [], notices).collect()
    assert {r["doc_id"]: r["labels"] for r in row} == {1: "a,c", 2: "a,c"}
    assert {r["doc_id"]: len(r["spans"]) for r in row} == {1: 2, 2: 4}


def test_empty_table(documents):
    assert licenses.scan(documents([(1, "x")]).limit(0)).count() == 0
