import re

import pytest

from souk.llm import licenses
from souk.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def base(t):
    w = words(t)
    return sorted((i, label) for p, label in licenses.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())


def detect(t):
    """Standing matches, straight from the definition."""
    if not t or not re.search(licenses.GATE, t):
        return []
    s = " " + " ".join(words(t)) + " "
    found = [(p, -(m.end() - m.start()), m.start(), m.end(), label, c) for p, label, word, pattern, c in licenses.signature_rules()
             if word in s for m in re.finditer(pattern, s)]
    kept = []
    for _, _, a, b, label, c in sorted(found):
        if not any(x <= a and y >= b for x, y, _, _ in kept):
            kept.append((a, b, label, c))
    return sorted(kept)


TEXTS = [None, "", "no words here", "MIT License, the mit-license. Mit\nLicense", "mit licenses", "Released under the MIT License",
         "Licensed under the Apache License, Version 2.0 (the ..)", "This work is licensed under the GNU General Public License, version 3.",
         "Licensed under CC BY-NC 4.0", "// SPDX-License-Identifier: GNU Lesser General Public License v2.1", "general public license général",
         "apache license mit license general public license " * 40, "LİCENSE mit lİcense", "all rights reserved", "x " * 30_000 + "MIT license",
         "Redistribution and use in source and binary forms, with or without modification, under the 3-clause BSD license",
         "the Mozilla Public License 2.0 and the Apache License 2.0", "copyright 2020 someone. All rights reserved. Licensed under something"]


def test_there_are_hundreds_of_rules_with_valid_patterns():
    rules = licenses.signature_rules()
    assert len(rules) > 300 and len({r[0] for r in rules}) == len(rules)
    for r in rules:
        re.compile(r[3])


def test_scan_equals_brute_force(docs_of, clash):
    rows = list(enumerate(TEXTS))
    for r in licenses.scan_licenses(docs_of(rows, clash)).collect():
        t = TEXTS[r.doc_id]
        assert r.n_words == len(words(t))
        assert sorted((b.word, b.label) for b in r.base) == base(t)
        assert [(d.start, d.end, d.label, d.confidence) for d in r.detections] == detect(t), t


@pytest.mark.parametrize("text,label", [
    ("Released under the MIT License", "mit"), ("licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("licensed under the GNU General Public License, version 3", "gpl-3"), ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    ("under the Mozilla Public License, v. 2.0", "mpl-2.0")])
def test_specific_rule_wins(text, label):
    assert label in {d[2] for d in detect(text)}


def test_query_equals_brute_force(spark, sf_dir, documents):
    text = {r.doc_id: r.text for r in documents.collect()}
    some = 0
    for r in QUERIES["op10_licenses"](spark, sf_dir).collect():
        b, d = base(text[r.doc_id]), detect(text[r.doc_id])
        assert (r.n_words, r.n_base) == (len(words(text[r.doc_id])), len(b))
        assert (r.first_word, r.last_word) == ((b[0][0], b[-1][0]) if b else (None, None))
        assert r.base_labels == ",".join(sorted({x[1] for x in b}))
        assert r.labels == ",".join(sorted({x[1] for x in b} | {x[2] for x in d}))
        assert r.score == max([x[3] for x in d], default=0.0)
        some += bool(b)
    assert some


def test_empty_table(docs_of):
    assert licenses.scan_licenses(docs_of([])).collect() == []


def detect_all(t):
    """Standing matches of all rules, without gate or keyword."""
    s = " " + " ".join(words(t)) + " "
    found = sorted((p, -(m.end() - m.start()), m.start(), m.end(), label, c) for p, label, _, pattern, c in licenses.signature_rules()
                   for m in re.finditer(pattern, s))
    kept = []
    for _, _, a, b, label, c in found:
        if not any(x <= a and y >= b for x, y, _, _ in kept):
            kept.append((a, b, label, c))
    return sorted(kept)


GATED = {"Released under Apache 2.0.": "apache-2.0", "placed in the public\ndomain": "public-domain", "All rights\nreserved": "proprietary",
         "Redistribution and\n * use in source and binary forms, with or without modification": "bsd",
         "Permission to use, copy, modify, and/or distribute this software for any purpose": "isc",
         "it is provided 'as is', without any express or implied warranty": "zlib", "Creative Commons Zero 1.0": "cc0-1.0",
         "Permission\tis hereby granted, free of charge, to any person obtaining a copy": "mit", "subject to Mozilla Public 2.0": "mpl-2.0",
         "CC-BY": "cc-by", "creative\ncommons attribution": "cc-by", "published under WTFPL 2": "wtfpl-2"}


def test_no_gate_is_narrower_than_the_rules(docs_of):
    texts = [*GATED, *TEXTS[:-4], "mit dem Auto, nichts weiter", "see the docs, cc", "python 2.0"]
    got = {r.doc_id: [(d.start, d.end, d.label, d.confidence) for d in r.detections]
           for r in licenses.scan_licenses(docs_of(list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert got[i] == detect_all(t), t
        assert t not in GATED or GATED[t] in {d[2] for d in got[i]}


def test_every_rule_implies_its_keyword():
    for _, _, word, pattern, _ in licenses.signature_rules():
        assert any(word in piece + " " for piece in licenses.literals(pattern)), (word, pattern)
