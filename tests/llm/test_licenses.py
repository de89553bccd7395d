"""Every license rule finds an example of its own through the prefilter, and not one with a broken keyword."""

from re import _constants as C
from re import _parser as parser

import pytest

from motorspark.llm import licenses


def example(tree):
    """A short text that the pattern matches."""
    out = ""
    for op, value in tree:
        if op is C.LITERAL:
            out += chr(value)
        elif op is C.IN:
            kind, first = value[0]
            if kind is C.NEGATE:
                out += "x"
            elif kind is C.CATEGORY:
                out += {C.CATEGORY_SPACE: " ", C.CATEGORY_NOT_SPACE: "x", C.CATEGORY_WORD: "a", C.CATEGORY_DIGIT: "1", C.CATEGORY_NOT_WORD: "-"}[first]
            else:
                out += chr(first if kind is C.LITERAL else first[0])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            out += example(value[2]) * value[0]
        elif op is C.SUBPATTERN:
            out += example(value[3])
        elif op is C.BRANCH:
            out += example(value[1][0])
        elif op is C.CATEGORY:
            out += " "
    return out


@pytest.mark.parametrize("number", range(len(licenses.rules())))
def test_rule(number):
    label, priority, pattern = licenses.rules()[number]
    text = f" {example(parser.parse(pattern.pattern))} "
    assert pattern.search(text), (pattern.pattern, text)
    assert (label, priority) in {d[2:] for d in licenses.detections(text)}
    for keywords in licenses.keyword_sets(pattern.pattern):
        broken = text
        for k in keywords:
            broken = broken.replace(k, k[:1] + "ß" + k[1:])
        assert not pattern.search(broken), (pattern.pattern, broken)


@pytest.mark.parametrize(("text", "labels"), [
    ("Do What The Fuck You Want To Public License", "wtfpl"),
    ("the 2-clause license", "bsd-2-clause"),
    ("the PHP licence, the Ruby licence", "php-3.01,ruby"),
    ("Licensed under the MIT.", "mit"),
    ("Licensed under Apache 2.0", "apache-2.0"),
    ("License: BSD-3-Clause", "bsd-3-clause"),
    ("Neither the name of the\nFoo Corp nor the names of\nits contributors may be used to endorse\nor promote products", "bsd-3-clause"),
    ("Permission is hereby granted,\n free of charge, to any person obtaining a copy", "mit"),
    ("he said cc by mistake", ""),
    ("published under the MIT Press", ""),
    ("we permit a limited emit", ""),
    ("CC BY 4.0", "cc-by"),
    ("x" * 2_000_000 + " released under the GPLv3", "gpl-3.0"),
])
def test_texts(text, labels):
    assert licenses.scan(text)[5] == labels


def test_empty_table_and_clashing_names(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "MIT license", "c"), (3, "MIT license", "c"), (None, "MIT license", "d")], "doc_id long, text string, labels string")
    got = licenses.license_scan(df).collect()
    assert sorted((str(r["doc_id"]), r["labels"], r["n_words"]) for r in got) == [("1", "", 0), ("2", "", 0), ("3", "mit", 2), ("3", "mit", 2), ("None", "mit", 2)]
    assert licenses.license_scan(df.where("false")).count() == 0
