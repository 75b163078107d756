import re

from pairset.llm import licenses

AUTOMATA = [licenses.compiled(*t) for t in licenses.TEMPLATES]
MIT_TEXT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
    'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
    "Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice "
    "shall be included in all copies or substantial portions of the Software."
)


def labels(text):
    return licenses.scan_text(text, AUTOMATA)[5]


def test_optional_and_replaceable_regions():
    assert labels("Licensed under the GNU General Public License, version 3") == "GPL-3.0-only,gpl"
    assert labels("licensed under the terms of the GNU General Public License as published by the Free Software Foundation version 3") == "GPL-3.0-only,gpl"
    assert labels(MIT_TEXT) == "MIT"
    assert labels(MIT_TEXT.replace("hereby granted", "hereby given")) == ""
    bsd = licenses.TEMPLATES[[t[0] for t in licenses.TEMPLATES].index("BSD-3-Clause")][1]
    plain = re.sub(r"\[\[\d\]\]", "", bsd)
    assert "BSD-3-Clause" in labels(plain.replace("{organisation:12}", "the Example Project"))
    assert "BSD-3-Clause" not in labels(plain.replace("{organisation:12}", "x " * 13))


def test_base_places_overlap_and_repeat():
    n_words, n_base, first, last, base, *_ = licenses.scan_text("MIT-License; mit license mit license Apache license", AUTOMATA)
    assert (n_words, n_base, first, last, base) == (8, 4, 0, 6, "apache,mit")


def test_words_keep_characters_above_ascii():
    assert licenses.scan_text("É mit license_x\u0000y", AUTOMATA)[:4] == (5 - 1, 0, None, None)
    assert licenses.scan_text("MİT license", AUTOMATA)[1] == 0


def test_rows(spark, docs):
    long = "word " * 50_000 + "Released under the MIT License."
    got = licenses.scan_documents(docs((1, long), (2, None), (3, ""), (3, ""))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == 4
    assert (by[1].n_words, by[1].first_word, by[1].labels, by[1].score) == (50_005, 50_003, "MIT,mit", 1.0)
    assert [(s.start, s.end, s.label) for s in by[1].spans] == [(50_000, 50_005, "MIT")]
    assert (by[2].n_words, by[2].first_word, by[2].labels, by[2].score, by[2].spans) == (0, None, "", 0.0, [])


def test_empty_table(docs):
    assert licenses.scan_documents(docs().limit(0)).count() == 0
