import re

import pytest

from hetspark.llm import license

APACHE = "Licensed under the Apache License, Version 2.0"


def one(make, text):
    return license.scan(make([(1, text, "s")])).first()


def slow_base(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(license.WORD, low)
    found = [(i, label) for phrase, label in license.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    at = [i for i, _ in found]
    return len(words), len(found), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


ROWS = [
    None, "", " \n", "word", "cc by", "CC-BY cc by cc cc by", "all rights reserved All Rights Reserved. all rights", "x general public license y All-rights/reserved",
    "ccK by", "İ cc by", "é" * 10 + " cc by", "the of " * 20_000 + "cc by", "general public general public license license",
]


def test_base_against_brute_force(make):
    got = {r.doc_id: r for r in license.scan(make([(i, t, "s") for i, t in enumerate(ROWS)])).collect()}
    for i, t in enumerate(ROWS):
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == slow_base(t), t
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


@pytest.mark.parametrize("text", [APACHE, APACHE.upper(), f"intro words {APACHE} tail", "licensed under the new Apache License Version 2.0", "licensed under the apache license version two 2.0", "this is licensed under the apache license version 2.0 and more"])
def test_notices_with_changes(make, text):
    assert one(make, text).labels == "apache-2.0"


@pytest.mark.parametrize(("text", "label"), [
    ("Licensed under Apache License, Version 2.0", "apache-2.0"), ("Licensed under the Apache License 2.0", "apache-2.0"), ("Released under MIT license", "mit"), ("Licensed under CC BY-NC 3.0", "cc-by,cc-by-nc"),
    ("Distributed under the Boost Software License 1.0", "bsl-1.0"), ("under the of the " * 400 + "Released under MIT license", "mit"),
])
def test_short_notices_with_one_word_missing_or_changed(make, text, label):
    assert one(make, text).labels == label


def test_phrases_of_one_word_are_refused():
    with pytest.raises(ValueError, match="two words"):
        license.template_pairs(phrases=(("a", "one"),))


@pytest.mark.parametrize("text", ["the apache came under the bridge version 2", "licensed under the", "license version", "2.0 version license apache the under licensed", "under the " * 50, "the license of the software and the version of the work"])
def test_what_is_no_notice(make, text):
    r = one(make, text)
    assert r.labels == "" and r.score == 0


def test_spans(make):
    rows = license.spans(make([(1, f"a b {APACHE} c {APACHE}", "s")])).where("template is not null").orderBy("start").collect()
    assert [(r.label, r.start, r.end, r.score) for r in rows] == [("apache-2.0", 2, 10, 1.0), ("apache-2.0", 11, 19, 1.0)]


def test_repeated_and_null_ids(make):
    out = license.scan(make([(None, "cc by", "s"), (None, "x", "s"), (2, "cc by", "s"), (2, "cc by", "s")])).collect()
    assert sorted((r.doc_id or 0, r.n_base) for r in out) == [(0, 0), (0, 1), (2, 1), (2, 1)]
    assert license.scan(make([])).count() == 0


def test_native(make):
    plan = license.scan(make([(1, "a", "s")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
