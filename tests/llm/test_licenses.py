import re

from huetide.llm import licenses
from tests.conftest import SF
from tests.llm.cases import documents, empty
from tests.llm.test_decontaminate import LOWER, WORD


def plain(text):
    w = WORD.findall((text or "").translate(LOWER))
    places = []
    for label, words in licenses.PHRASES:
        p = words.split()
        places += [(i, label) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return len(w), sorted(places)


TEXTS = [
    None,
    "",
    "CC BY cc-by/CC\nBY xcc by cc byé cc cc by",
    "All  Rights, Reserved. all rights reservedx GNU GENERAL public. license",
    "Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3.",
    "// SPDX-License-Identifier: MIT\nReleased under the MIT License.",
    "w " * 50_000 + "Licensed under CC BY-NC 4.0.",
    "Licensed under CC BY-NC 4.0.",
    "é" * 10 + " all rights reserved " * 1000,
]


def test_rules_are_hundreds():
    made = licenses.rules()
    assert len(made) > 300 and all(r.keyword == r.keyword.lower() for r in made)
    assert all(re.compile(r.pattern.pattern) for r in made)


def test_places_and_labels(spark):
    got = sorted(licenses.scan_licenses(documents(spark, TEXTS)).collect(), key=lambda r: r.doc_id)
    assert [(r.n_words, sorted((p.word, p.label) for p in r.places)) for r in got] == [plain(t) for t in TEXTS]
    labels = [sorted({x.label for x in r.detections}) for r in got]
    assert labels[4] == ["apache-2.0"] and labels[5] == ["gpl-3.0"] and labels[6] == ["mit"]
    assert labels[7] == labels[8] == ["cc-by-nc-4.0"] and labels[0] == labels[1] == []
    assert licenses.scan_licenses(empty(spark)).count() == 0


WRAPPED = [
    "Creative Commons Zero",
    "Released under the Creative Commons\n * Zero 1.0",
    "Berkeley Software Distribution License",
    "Creative\n * Commons Attribution 4.0",
    "Licensed under Creative\n# Commons Attribution-ShareAlike 3.0",
    "CC Attribution 4.0",
    "FreeBSD BSD license, BSD-style license, cc0-1.0, cc-by-nc",
]


def test_every_sentence_is_gated_by_a_word_it_holds_and_priority_decides():
    scan = licenses.Scanner().scan
    for label, keyword, sentence in licenses.SENTENCES:
        assert keyword in sentence, (label, keyword)
    kinds = lambda text: [(r.rank, r.label) for _, _, r in scan(text.lower().encode())[1]]
    # a tag beats the name inside it, a grant the name, a sentence the longer name that overlaps it
    assert kinds("SPDX-License-Identifier: MIT License") == [(5, "mit")]
    assert kinds("released under the terms of the Apache License, Version 2.0") == [(4, "apache-2.0")]
    text = "distributed under the Boost Software License, Version 1.0"
    assert kinds(text) == [(4, "boost-1.0")]
    assert kinds("you can redistribute it and/or modify it under the terms of the GNU General Public License v3.0") == [(3, "gpl")]
    found = scan(" ".join(["mit license apache license, version 2.0 cc by-nc 4.0"] * 500).encode())[1]
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False)) and len(found) == 1500


class Ungated:
    def __init__(self, words):
        self.words = list(words)

    def hits(self, lowered):
        return [(0, w) for w in self.words]


def test_the_gate_loses_nothing(spark):
    gated, every = licenses.Scanner(), licenses.Scanner()
    every.gate = Ungated(every.by_word)
    table = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for text in [*TEXTS, *WRAPPED, *table]:
        (places, found), (want, wanted) = (x.scan((text or "").encode().lower()) for x in (gated, every))
        assert places == want and [(a, b, r.label, r.rank) for a, b, r in found] == [(a, b, r.label, r.rank) for a, b, r in wanted]
    labels = [[r.label for _, _, r in gated.scan(t.encode().lower())[1]] for t in WRAPPED]
    assert labels[:6] == [["cc0"], ["cc0-1.0"], ["bsd"], ["cc-by-4.0"], ["cc-by-sa-3.0"], ["cc-by-4.0"]]


def test_query_on_the_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = licenses.op10_license_signatures(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n, places = plain(texts[r.doc_id])
        at = [w for w, _ in places]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (n, len(at), min(at, default=None), max(at, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and 0 <= r.score <= 1
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
