import re

import pytest

from weirflow.llm import licenses as L

LINES = {"apache": "Licensed under the Apache License, Version 2.0.", "mit": "Released under the MIT License.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "gpl": "This work is licensed under the GNU General Public License, version 3."}


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in df.collect()}
    want = {i: {f for f, s in LINES.items() if s in t} for i, t in texts.items()}
    got = {r.doc_id: r for r in L.licence_report(df).collect()}
    assert {i: {f for f in r.families.split(",") if f} for i, r in got.items()} == want and any(want.values())
    word = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    assert all(r.n_paragraphs == sum(bool(word.search(x)) for x in texts[i].split("\n")) for i, r in got.items())


# Phrases, names and sentences that neither the fit nor the calibration has seen.
UNSEEN = ["Source code is made available under the {}.", "Lizenz: {}", "contributions are accepted under {} terms", "see {} for more"]
OTHERS = ["Hippocratic License", "Server Side Public License", "Nokia Open Source License", "Academic Free License", "Do What The License", "Netscape Public License"]
QUIET = ["Please wait for the bus.", "The license plate was stolen.", "He is general manager of the public company.", "Version 2.0 of the game is out.", "The library opens at nine.", "Copyright is a right.", "She studied at mit and works for apache.", "Terms of trade fell in May.", "files and folders are listed below", "Zlib compresses data"]


def called(t):
    return L.fit().call(L._grams(t))[0]


def test_phrases_that_the_fit_has_not_seen():
    rows = [(p.format(n), f) for p in UNSEEN for f in L.FAMILIES for n in L.NAMES[f]]
    got = [(called(t), f) for t, f in rows]
    sure = [(a, b) for a, b in got if a not in (L.NONE, L.UNKNOWN)]
    assert sum(a == b for a, b in sure) / len(sure) > 0.97, [(a, b) for a, b in sure if a != b]
    assert sum(a == b for a, b in got) / len(got) > 0.85, [(t, a) for (t, f), (a, _) in zip(rows, got, strict=True) if a != f]


def test_licences_that_the_fit_has_not_seen():
    got = [called(p.format(n)) for p in UNSEEN for n in OTHERS]
    assert not set(got) & set(L.FAMILIES) and got.count(L.UNKNOWN) > len(got) / 3


def test_plain_sentences():
    assert [called(t) for t in QUIET] == [L.NONE] * len(QUIET)


def test_a_family_without_its_sentences(monkeypatch):
    """With a whole family left out of the fit, its licence is no other family."""
    for gone in ("mpl", "isc", "unlicense"):
        monkeypatch.setattr(L, "_fitted", {})
        with monkeypatch.context() as m:
            m.setattr(L, "FAMILIES", [f for f in L.FAMILIES if f != gone])
            m.setattr(L, "TEXTS", {f: t for f, t in L.TEXTS.items() if f != gone})
            c = L.fit()
            names = [c.call(L._grams(p.format(n)))[0] for p in UNSEEN[:2] for n in L.NAMES[gone]]
        assert not set(names) & set(L.FAMILIES), names
    monkeypatch.setattr(L, "_fitted", {})


TITLES = {"MIT License": "mit", "The MIT License (MIT)": "mit", "ISC License": "isc", "GNU GENERAL PUBLIC LICENSE": "gpl", "Boost Software License - Version 1.0": "boost", "Apache License": "apache", "Mozilla Public License Version 2.0": "mpl", "GNU LESSER GENERAL PUBLIC LICENSE": "lgpl", "Eclipse Public License - v 2.0": "epl", "BSD 3-Clause License": "bsd"}


def test_titles():
    assert {t: called(t) for t in TITLES} == TITLES


@pytest.mark.parametrize("family", L.FAMILIES)
def test_templates_are_their_family(family):
    got = {s: called(s) for s in L.TEMPLATES[family]}
    long = [s for s in got if len(s.split()) > 1]
    assert sum(got[s] == family for s in long) >= 0.8 * len(long) and set(got.values()) <= {family, L.UNKNOWN, L.NONE}, got
    assert {called(f"License: {s}") for s in L.NAMES[family]} <= {family, L.UNKNOWN}


def test_scan_equals_calling_line_by_line(spark):
    import random

    r = random.Random(5)
    lines = [t for t, _ in L._paragraphs(300, 21, L.PHRASES_TWO)] + QUIET
    # lines without a neighbour make no passages
    texts = ["\n\n".join(r.choice(lines) for _ in range(r.randint(0, 9))) for _ in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in L.licence_report(df).collect()}
    m = L.fit()
    for i, t in enumerate(texts):
        calls = [m.call(L._grams(x)) for x in t.split("\n") if len(L._grams(x))]
        found = [(f, p) for f, p in calls if f != L.NONE]
        g = got[i]
        assert (g.n_paragraphs, g.n_licence, g.n_unknown) == (len(calls), len(found), sum(f == L.UNKNOWN for f, _ in found))
        assert g.families == ",".join(sorted({f for f, _ in found} - {L.UNKNOWN})) and (g.score == pytest.approx(max(p for _, p in found), rel=1e-6) if found else g.score is None)


def test_edge_cases(spark, odd, none):
    rows = {r.doc_id: r for r in L.licence_report(odd).collect()}
    assert L.licence_report(odd).count() == odd.count() and L.licence_report(none).count() == 0
    for i in (9001, 9002, 9003):
        assert (rows[i].n_paragraphs, rows[i].families, rows[i].score) == (0, "", None)
    lines = "\n".join(["x y"] * 3 + [LINES["mit"], "", LINES["gpl"]])
    df = spark.createDataFrame([(1, lines), (2, LINES["mit"]), (2, LINES["mit"])], "doc_id long, text string")
    found = [r for r in L.licence_paragraphs(df).collect()]
    assert [(f.paragraph, f.family) for f in found[0].found] == [(3, "mit"), (4, "gpl")] and len(found) == 3


WRAPPED = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
}


def test_hard_wrapped_licences(spark):
    texts = []
    for family, text in WRAPPED.items():
        comment = "\n".join(["/*", *(f" * {x}" for x in text.split("\n")), " */", "int main() {"])
        narrow = re.sub(r"(\S+ \S+ \S+) ", r"\1\n", text.replace("\n", " "))
        texts += [(family, 0, text), (family, 2, f"Some title\nand more of it\n\n{text}\nplain words follow here"), (family, 0, comment), (family, 0, narrow)]
    df = spark.createDataFrame([(i, t) for i, (_, _, t) in enumerate(texts)], "doc_id long, text string").repartition(2)
    report = {r.doc_id: r for r in L.licence_report(df).collect()}
    assert [report[i].families for i in range(len(texts))] == [f for f, _, _ in texts]
    found = {r.doc_id: [(x.paragraph, x.family) for x in r.found if x.family != L.UNKNOWN] for r in L.licence_paragraphs(df).collect()}
    # a line that names the licence is called by itself, others as the passage from its first line
    assert [[f for _, f in found[i]] for i in range(len(texts))] == [[f] for f, _, _ in texts]
    assert all(k <= found[i][0][0] < k + 12 for i, (_, k, _) in enumerate(texts))
    apart = WRAPPED["bsd"].replace("\n", "\n\n")
    assert L.licence_report(spark.createDataFrame([(1, apart)], "doc_id long, text string")).first().families == ""
