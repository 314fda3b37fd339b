"""Answer readers: hand-written cases, and comparison with plain regular expressions on random texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tripleframe.functions import readers
from tripleframe.operators import extract

CASES = [
    # text, reader, status, triples
    ('[["a","b","c"]]', "json", "triples", [["a", "b", "c"]]),
    ("[['a', 'b', 'c'], ['d', 'e', 'f']]", "quoted_lists", "triples", [["a", "b", "c"], ["d", "e", "f"]]),
    ("[['a','b','c']]", "nested_lists", "triples", [["a", "b", "c"]]),
    ('[["a", "b"]]', "json", "triples", [["a", "b"]]),
    ("[]", "json", "empty", []),
    ("1. [a, b, c]", "numbered_lists", "triples", [["a", "b", "c"]]),
    ("Some prose (one, two, three).", "brackets", "triples", [["one", "two", "three"]]),
    ("Nothing here", "none", "empty", []),
    ("", "none", "empty", []),
    ("1. a - b - c\n2. d - e - f", "numbered_dashes", "triples", [["a", "b", "c"], ["d", "e", "f"]]),
    ("Subject: a, Predicate: b, Object: c\nSubject: d, Predicate: e, Object: f", "subject_lines", "triples",
     [["a", "b", "c"], ["d", "e", "f"]]),
    ("Subject: a\n\nPredicate: b\n\nObject: c\n\nSubject: d\n\nPredicate: e\n\nObject: f", "subject_blocks", "triples",
     [["a", "b", "c"], ["d", "e", "f"]]),
    ('See\n```json\n[{"subject": "a", "predicate": "p", "object": null}]\n```\nend', "fenced_json", "triples", [["a", "p", None]]),
    ("['A x', 'b', 'C']", "quoted_lists", "triples", [["A x", "b", "C"]]),
    ('[{"subject": "a", "predicate": "b", "object": "c"}]', "json", "triples", [["a", "b", "c"]]),
    ('[{"Subject": "a", "Predicate": "b", "Object": "c"}]', "json", "triples", [["a", "b", "c"]]),
    ('[{"subject": "a", "relation": "b", "object": "c"}]', "json", "triples", [["a", "b", "c"]]),
    ('{"knowledge_triples": [{"subject": "a", "predicate": "b", "object": "c", "more": 1}]}', "json", "triples", [["a", "b", "c"]]),
    ('{"Triples": []}', "json", "empty", []),
    ('{"triples": [["a", "b", "c"]]}', "json", "unreadable", None),
    ('[["a", "b", "c"], {"subject": "d"}]', "json", "unreadable", None),
    ('[1, 2]', "json", "unreadable", None),
    ('"text"', "json", "unreadable", None),
    ("12", "json", "unreadable", None),
    ('[["a", 5, "c"]]', "json", "triples", [["a", "5", "c"]]),
    ('[["a","b","c"]] and more', "none", "empty", []),
    ("'[[\"a\", \"b\", \"c\"]]'", "literal", "triples", [["a", "b", "c"]]),
    ("{'triples': '[[\"a\", \"b\", \"c\"]]'}", "literal", "triples", [["a", "b", "c"]]),
    ("It is [{'subject': 'a', 'predicate': \"b's\", 'object': 'c'}] then", "dict_list", "triples", [["a", "b's", "c"]]),
    ("It is [{'b', 'a', 'c'}] then", "dict_list", "triples", [["a", "b", "c"]]),
    ("It is [{'x': 1}] then", "dict_list", "unreadable", None),
    ("It is [{'b', 'a', 'c'}, ('x', 'y', 'z',), {'f', 'd', 'd'},] then (a, b, c)", "brackets", "triples", [["'x'", "'y'", "'z',"], ["a", "b", "c"]]),
    ("It is [{'b', 'a', 'c'}, ('x', 'y', 'z',), {'f', 'd', 'd'}] then", "dict_list", "triples", [["a", "b", "c"], ["x", "y", "z"], ["d", "f"]]),
    ('("a", "b", "c"), ("d", "e", "f")', "tuples", "triples", [["a", "b", "c"], ["d", "e", "f"]]),
    ('1. {"subject": "a", "predicate": "b", "object": "c"}\n2. {"subject": "d", "predicate": "e", "object": "f"}', "numbered_dicts",
     "triples", [["a", "b", "c"], ["d", "e", "f"]]),
    ('1. {"subject": "a"\n2. {broken}', "dash_lines", "triples", [["{subject: a"]]),
    ("1. one two\n2. three - four\nend", "numbered_dashes", "triples", [["three", "four"]]),
    ("1. one two\nend", "dash_lines", "triples", [["one two"]]),
    ("  [[\"a\",\"b\",\"c\"]]  ", "json", "triples", [["a", "b", "c"]]),
    ("Answer [[x]] (a, b, c)", "brackets", "triples", [["a", "b", "c"]]),
    ('```\n[\n ["a", "b", "c"]\n]\n```', "fenced_json", "triples", [["a", "b", "c"]]),
    ('{"a": 1, "a": 2}', "json", "unreadable", None),
]

STRICT = [
    ("Answer [[x]] (a, b, c)", "nested_lists", "empty", []),
    ("1. a - b - c\n2. d - e - f", "numbered_dashes", "triples", [["d", "e", "f"]]),
    ("Subject: a, Predicate: b, Object: c\nSubject: d, Predicate: e, Object: f", "subject_lines", "triples", [["a", "b", "c"]]),
    ("Subject: a\n\nPredicate: b\n\nObject: c\n\nSubject: d\n\nPredicate: e\n\nObject: f\n\nend", "subject_blocks", "triples", [["d", "e", "f"]]),
    ('[["a","b","c"]]\nprose', "nested_lists", "empty", []),
    ("It is [{'b', 'a', 'c'}, ('x', 'y', 'z'), {'f', 'd', 'd'}] then", "dict_list", "triples", [["a", "b", "c"], ["d", "f"]]),
    ("It is [{'b', 'a', 'c'}, {'subject': 'x', 'predicate': 'y', 'object': 'z'}] then", "dict_list", "triples", [["a", "b", "c"]]),
    ("It is [{'b', u'a', 'c'}, ('x', 'y', 'z'), {'d'}] then", "dict_list", "triples", [["a", "b", "c"], ["d"]]),
    ("It is [{'subject': 'x', 'predicate': 'y', 'object': 'z', 'more': {'a', 'b'}}] then", "dict_list", "triples", [["x", "y", "z"]]),
]


def read(spark, texts, **options):
    rows = spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)], "run string, doc_id int, generated_text string")
    got = extract.read_texts(rows, **options).collect()
    return {
        r.doc_id: (r.reader, r.status, None if r["items"] is None else [list(i.parts) for i in r["items"]]) for r in got
    }


@pytest.mark.parametrize("cases,strict", [(CASES, False), (STRICT, True)])
def test_cases(spark, cases, strict):
    got = read(spark, [c[0] for c in cases], strict_order=strict)
    for i, (text, reader, status, triples) in enumerate(cases):
        assert got[i] == (reader, status, triples), text


def test_shapes_of_the_knowledge_base_check(spark):
    capitals = '[{"Subject": "a", "Predicate": "b", "Object": "c"}]'
    assert read(spark, [capitals], capitals=False)[0][1] == "unreadable"


def test_numbers_never_match_but_count(spark):
    rows = spark.createDataFrame([("r", 1, '[["A", 5, "c"], ["a", "b"]]')], "run string, doc_id int, generated_text string")
    triples = extract.extract_triples(rows)
    assert [(r.s, r.p, r.o, r.matchable) for r in extract.canonical_triples(triples).collect()] == [("a", "5", "c", False)]
    _, malformed = extract.split_valid(triples)
    assert [list(r.parts) for r in malformed.collect()] == [["a", "b"]]


# The same answer formats as ordinary patterns.
PLAIN = {
    "quoted_lists": (r"\['(.*?)', '(.*?)', '(.*?)'\]", 0, "[]', ab\n"),
    "subject_lines": (r"Subject: (.*?), Predicate: (.*?), Object: (.*?)(?:\n|\Z)", 0, None),
    "tuples": (r'\("([^"]+)", "([^"]+)", "([^"]+)"\)', 0, '()", ab\n'),
    "brackets": (r"\(\s*(.*?)\s*,\s*(.*?)\s*,\s*(.*?)\s*\)", 0, "(), \nab"),
}


@pytest.mark.parametrize("name", PLAIN)
def test_random_texts_agree_with_plain_patterns(spark, name):
    pattern, flags, alphabet = PLAIN[name]
    rng = random.Random(7)
    if alphabet is None:
        bits = ["Subject: ", ", Predicate: ", ", Object: ", "\n", "a", "b, "]
        texts = ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(1500)]
    elif name == "quoted_lists":
        bits = ["['", "', '", "']", "a", "b", "\n", "'"]
        texts = ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(1500)]
    elif name == "tuples":
        bits = ['("', '", "', '")', "a", "b", "\n", '"']
        texts = ["".join(rng.choices(bits, k=rng.randint(1, 14))) for _ in range(1500)]
    else:
        texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 30))) for _ in range(3000)]
    texts = [t.strip() for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = df.select("i", getattr(readers, name)(F.col("t")).alias("x")).collect()
    for row in got:
        expected = [list(m) for m in re.findall(pattern, texts[row.i], flags)]
        assert (row.x or []) == expected, repr(texts[row.i])


def test_unfinished_lists_do_not_stall(spark):
    texts = ["['" + "', '".join("ab" for _ in range(20000)), "(" + ", ".join("ab" for _ in range(20000)),
             "Subject: " + ", Predicate: x" * 20000]
    assert [v[0] for v in read(spark, texts).values()] == ["none", "none", "none"]


def test_fenced_answers(spark):
    texts = ['```json\n[{"subject": "a", "predicate": "b", "object": "c"}]\n```', "no list", '[{"subject": "a"}]', "[]"]
    rows = spark.createDataFrame([("r", i, t) for i, t in enumerate(texts)], "run string, doc_id int, generated_text string")
    got = sorted((r.doc_id, r.status, r.s) for r in extract.extract_fenced_json(rows).collect())
    assert got == [(0, "triples", "a"), (1, "malformed", None), (2, "malformed", None), (3, "triples", None)]
