"""Readers that find triples in generated text, one expression per answer format.

Each reader maps a stripped text to ``array<array<string>>``, the parts of every item it finds, or to
NULL when the format does not occur.  The JSON readers return a VARIANT instead, because a JSON answer
may have any shape; ``functions.shapes`` turns it into items.

Cheap ``contains`` tests stand before the patterns, so that prose costs one substring search per reader.
Where the leftmost shortest choice decides the match anyway, groups are atomic ``(?>...)``: a long
unfinished list then fails in one pass instead of trying every pair of separators.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tripleframe.functions.text import FLAGS, let, nonempty, strip

# Patterns of the answer formats.
SUBJECT_LINE = r"Subject: (?>(.*?), Predicate: )(?>(.*?), Object: )(.*?)(?:\n|\z)"
SUBJECT_LINE_CLOSED = r"Subject: (?>(.*?), Predicate: )(?>(.*?), Object: )(.*?)\n"
SUBJECT_BLOCK = r"(?s)Subject: (?>(.*?)\n\nPredicate: )(?>(.*?)\n\nObject: )(.*?)(?:\n\n|\z)"
SUBJECT_BLOCK_CLOSED = r"(?s)Subject: (?>(.*?)\n\nPredicate: )(?>(.*?)\n\nObject: )(.*?)\n\n"
QUOTED_LIST = r"\['(?>(.*?)', ')(?>(.*?)', ')(.*?)'\]"
NESTED_SPAN = r"(?s)\[\[.*?\]\]"
NESTED_ITEM = r"\['(.*?)',\s*'(.*?)',\s*'(.*?)'\]"
DICT_SPAN = r"(?s)\[\s*\{.*?\}\s*\]"
FENCE = r"```(?:json)?\n((?s:.*?))\n```"
TUPLE = r"\(\"([^\"]+)\", \"([^\"]+)\", \"([^\"]+)\"\)"
NUMBERED_LIST = r"\d+\.\s+\[(.*?)\]"
NUMBERED_LINE = r"\d+\.\s*([^\n]+)"
NUMBERED_DICT = r"\d+\.\s+(\{.*?\})"
NUMBERED_CLOSED_LINE = r"\d+\.\s+(.*?)\n"
BRACKETS = r"\(\s*(.*?)\s*,\s*(.*?)\s*,\s*(.*?)\s*\)"
# the same on text without a newline, where the first two commas and the first bracket after them decide
BRACKETS_ONE_LINE = r"\(\s*+([^,]*?)\s*+,\s*+([^,]*?)\s*+,\s*+([^)]*?)\s*+\)"
# how JSON can begin: whatever begins otherwise is spared the parser, which raises an exception for each text it rejects
JSON_START = r'^(?:\[[\[ \t\r\n]*(?:["\]\-0-9tfn]|\{[ \t\r\n]*["}])|\{[ \t\r\n]*["}]|"|(?:-?[0-9][0-9.eE+\-]*|true|false|null)\s*$)'
OBJECTS_START = r'^\[[ \t\r\n]*\{[ \t\r\n]*["}]'
# a newline no bracketed triple can contain: nothing but words on both sides of its white space
WALL = r"(?<=[^(,\s])[^\S\n]*\n\s*(?=[^,)\s])"


def _has(text: Column, *needles: str) -> Column:
    found = F.contains(text, F.lit(needles[0]))
    for needle in needles[1:]:
        found = found & F.contains(text, F.lit(needle))
    return found


def _all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(FLAGS + pattern), F.lit(group))


def _triples(text: Column, pattern: str) -> Column:
    """The three groups of every match."""
    hits = _all(text, pattern, 0)
    return F.transform(hits, lambda hit: F.array(*[F.regexp_extract(hit, FLAGS + pattern, i) for i in (1, 2, 3)]))


def json_value(text: Column) -> Column:
    """The VARIANT of a text that is one JSON value as a whole, else NULL.

    The parser ignores what follows a complete value, so the text is read twice, as the only element of a
    list and as the only field of an object: only a single value fits both.
    """
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    held = F.try_parse_json(F.concat(F.lit('{"v":'), text, F.lit("}")))
    may_be_json = text.rlike(JSON_START) & text.rlike(r'[\]}"0-9el]\s*$')
    both = F.when(may_be_json, F.when(held.isNotNull(), listed))
    return F.try_variant_get(both, "$[0]", "variant")


def subject_lines(text: Column, closed_only: bool = False) -> Column:
    """``Subject: a, Predicate: b, Object: c`` lines; ``closed_only`` wants a newline after each."""
    pattern = SUBJECT_LINE_CLOSED if closed_only else SUBJECT_LINE
    return F.when(_has(text, "Subject: ", ", Predicate: ", ", Object: "), nonempty(_triples(text, pattern)))


def subject_blocks(text: Column, last_closed_only: bool = False) -> Column:
    """``Subject:``, ``Predicate:`` and ``Object:`` paragraphs.

    ``last_closed_only`` keeps one triple: the last that is followed by a blank line.
    """
    found = _triples(text, SUBJECT_BLOCK_CLOSED if last_closed_only else SUBJECT_BLOCK)
    if last_closed_only:
        found = F.slice(found, -1, 1)
    trimmed = F.transform(found, lambda parts: F.transform(parts, strip))
    guard = _has(text, "Subject: ", "\n\nPredicate: ", "\n\nObject: ")
    if last_closed_only:
        guard = guard & (F.size(_all(text, SUBJECT_BLOCK_CLOSED, 0)) > 0)
    return F.when(guard, nonempty(trimmed))


def quoted_lists(text: Column) -> Column:
    """``['a', 'b', 'c']`` anywhere."""
    return F.when(_has(text, "['", "', '", "']"), nonempty(_triples(text, QUOTED_LIST)))


def nested_lists(text: Column, stop_when_empty: bool = False) -> Column:
    """Single-quoted triples inside the first ``[[ ... ]]``.

    ``stop_when_empty`` answers with an empty list, not NULL, when that span holds none.
    """
    span = F.regexp_extract(text, FLAGS + NESTED_SPAN, 0)
    inside = let(span, lambda s: F.when(F.length(s) > 0, _triples(s, NESTED_ITEM)))
    return F.when(_has(text, "[[", "]]"), inside if stop_when_empty else nonempty(inside))


def dict_span(text: Column) -> Column:
    """The first ``[{ ... }]`` of the text, or NULL."""
    span = F.regexp_extract(text, FLAGS + DICT_SPAN, 0)
    return F.when(_has(text, "[", "{", "}", "]"), F.nullif(span, F.lit("")))


def dict_span_json(span: Column) -> Column:
    """VARIANT of a span that reads the same as JSON and as a Python literal, else NULL."""
    same = span.rlike(OBJECTS_START) & ~F.contains(span, F.lit("\\")) & ~span.rlike(r"\b(null|true|false)\b")
    return F.when(same, json_value(span))


def fenced_json(text: Column) -> Column:
    """VARIANT of the last fenced code block, if that is JSON."""
    last = F.try_element_at(_all(text, FENCE, 1), F.lit(-1))
    return F.when(_has(text, "```"), json_value(strip_json_space(last)))


def strip_json_space(text: Column) -> Column:
    """Drop the four white-space characters JSON allows around a value."""
    return F.regexp_replace(text, r"\A[ \t\r\n]+|[ \t\r\n]+\z", "")


def tuples(text: Column) -> Column:
    """``("a", "b", "c")`` anywhere."""
    return F.when(_has(text, '("', '", "', '")'), nonempty(_triples(text, TUPLE)))


def numbered_lists(text: Column) -> Column:
    """``1. [a, b, c]`` items, of any length, single quotes dropped."""
    items = _all(text, NUMBERED_LIST, 1)
    split = F.transform(items, lambda item: F.split(F.replace(item, F.lit("'"), F.lit("")), ", ", -1))
    return F.when(_has(text, ".", "[", "]"), nonempty(split))


def numbered_dashes(text: Column, last_line_only: bool = False) -> Column:
    """``1. a - b - c`` lines, cut into sentences at dots; sentences without a dash are skipped."""
    lines = _all(text, NUMBERED_LINE, 1)
    if last_line_only:
        lines = F.slice(F.concat(F.array(F.lit("")), lines), -1, 1)
    sentences = F.flatten(F.transform(lines, lambda line: F.split(line, r"\.", -1)))
    dashed = F.filter(sentences, lambda sentence: F.contains(sentence, F.lit(" - ")))
    return F.when(_has(text, ".", " - "), nonempty(F.transform(dashed, lambda s: F.split(s, " - ", -1))))


def numbered_dicts(text: Column) -> Column:
    """VARIANT list of ``1. {json}`` items; NULL unless every item is JSON."""
    items = _all(text, NUMBERED_DICT, 1)
    listed = let(
        items,
        lambda found: F.when(
            (F.size(found) > 0) & F.forall(found, lambda item: json_value(item).isNotNull()),
            F.concat(F.lit("["), F.array_join(found, ", "), F.lit("]")),
        ),
    )
    return F.when(_has(text, ".", "{", "}"), F.try_parse_json(listed))


def brackets(text: Column) -> Column:
    """Any ``( a , b , c )``, prose included.

    No match can contain a newline with words on both sides, so the text is cut there first; a piece that
    holds no newline then needs no backtracking.
    """

    def piece(part: Column) -> Column:
        return F.when(F.contains(part, F.lit("\n")), _triples(part, BRACKETS)).otherwise(
            _triples(part, BRACKETS_ONE_LINE)
        )

    pieces = F.filter(F.split(text, FLAGS + WALL, -1), lambda part: _has(part, "(", ",", ")"))
    return F.when(_has(text, "(", ",", ")"), nonempty(F.flatten(F.transform(pieces, piece))))


def dash_lines(text: Column) -> Column:
    """``1. a - b - c`` lines that end in a newline, double quotes dropped, of any length."""
    items = _all(text, NUMBERED_CLOSED_LINE, 1)
    split = F.transform(items, lambda item: F.split(F.replace(item, F.lit('"'), F.lit("")), " - ", -1))
    return F.when(_has(text, ".", "\n"), nonempty(split))
