"""What spares texts the literal parser and the JSON parser, and the white space at the ends of texts."""

import ast
import json
import re

import pytest
from pyspark.sql import functions as F

from tripleframe.functions import literals, readers
from tripleframe.functions.text import strip


PLAIN = ["[{'b', 'a', 'b'}, ('x', 'y'), ['z']]", "[{'subject': 'a', 'object': 'b]'}]", "[{'a'},\n('{', '')]"]
PARSED = ["[{'a'}, 'b']", "[('a')]", "[{'it\\'s'}]", '[{"a"}]', "[{}]", "[{'a': {'b': 'c'}}]", "[{'a' 'b'}]", "[['a',]]", "[{'a'}] ", "[]"]


@pytest.mark.parametrize("text", PLAIN + PARSED)
def test_lists_of_plain_strings_read_as_the_parser_reads_them(text, monkeypatch):
    value = ast.literal_eval(text)
    sets = [item for item in value if isinstance(item, set)]
    expected = json.dumps(literals._plain(value)), json.dumps(literals._plain(sets or value))
    if text in PLAIN:  # these must not need the parser
        monkeypatch.setattr(literals.ast, "literal_eval", None)
    assert literals.span_literal(text) == expected


@pytest.mark.parametrize(
    ("text", "json_like"),
    [("[{'a': 'b'}]", False), ("1. [a, b]", False), ("[\n{\"a\": 1}]", True), ("{ }", True), ("-1.5e3", True), ("null", True), ("[]", True), ('"x"', True), ("3 items]", False)],
)
def test_only_what_begins_like_json_meets_the_json_parser(text, json_like):
    assert bool(re.match(readers.JSON_START, text)) == json_like


@pytest.mark.parametrize("text", ["a", "", " a", "a ", "\x1ca b ", "\n", "　a\x85"])
def test_strip_drops_white_space_of_any_kind(spark, text):
    row = spark.createDataFrame([(text,), (None,)], "t string").select(strip(F.col("t")).alias("t"))
    assert [r["t"] for r in row.collect()] == [text.strip(), None]
