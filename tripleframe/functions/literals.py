"""Python-literal answers: the part of the reading that has no native expression.

Only rows that passed a native test carry text into this function; all others send NULL, which costs
nothing but the slot in the Arrow batch.
"""

from __future__ import annotations

import ast
import json
import re

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from tripleframe.functions.shipping import ship_by_value

ship_by_value(__name__)

# A string without escapes and what may stand between two; a text of these alone needs no parser.
STRING = r"'[^'\\\r\n\0]*'"
GAP = r"[ \n]*,[ \n]*"
PLAIN_STRING = re.compile(STRING)
PLAIN_ITEM = re.compile(
    rf"(?P<set>\{{{STRING}(?:{GAP}{STRING})*\}})|(?P<dict>\{{{STRING}: ?{STRING}(?:{GAP}{STRING}: ?{STRING})*\}})"
    rf"|(?P<list>\({STRING}(?:{GAP}{STRING})+\)|\[{STRING}(?:{GAP}{STRING})*\])"
)
PLAIN_LIST = re.compile(rf"\[[ \n]*(?:{PLAIN_ITEM.pattern})(?:{GAP}(?:{re.sub(r'[?]P<[a-z]+>', '?:', PLAIN_ITEM.pattern)}))*[ \n]*\]")


def _plain(value):
    """Tuples as lists, sets as sorted lists, so that JSON can hold the value."""
    if isinstance(value, (set, frozenset)):
        return sorted((_plain(item) for item in value), key=str)
    if isinstance(value, (list, tuple)):
        return [_plain(item) for item in value]
    if isinstance(value, dict):
        return {str(key): _plain(item) for key, item in value.items()}
    return value if isinstance(value, (str, int, float, bool)) or value is None else str(value)


def _plain_list(text: str) -> list | None:
    """The value of a list of sets, dicts, tuples and lists of strings without escapes; None for any other text."""
    if not PLAIN_LIST.fullmatch(text):
        return None
    value = []
    for item in PLAIN_ITEM.finditer(text, 1):
        parts = [part[1:-1] for part in PLAIN_STRING.findall(item[0])]
        if item.lastgroup == "dict":
            value.append(dict(zip(parts[::2], parts[1::2])))
        else:
            value.append(set(parts) if item.lastgroup == "set" else parts)
    return value


def whole_literal(text: str | None) -> str | None:
    """JSON text held by a Python string literal, or by the triple field of a Python dict literal."""
    if text is None:
        return None
    try:
        value = text[1:-1] if PLAIN_STRING.fullmatch(text) else ast.literal_eval(text)
        if isinstance(value, dict):
            value = value["triples"] if "triples" in value else value["triple"]
        elif "triple" in value:
            return None  # a string cannot be looked up by key
        return json.dumps(json.loads(value)) if isinstance(value, str) else None
    except Exception:  # any malformed literal means "not this format"
        return None


def span_literal(text: str | None) -> tuple[str | None, str | None]:
    """A Python list literal as JSON text, and the same with nothing but its sets if it holds one."""
    if text is None:
        return None, None
    try:
        value = _plain_list(text)
        if value is None:
            value = ast.literal_eval(text)
            sets = [item for item in value if isinstance(item, set)]
            return json.dumps(_plain(value)), json.dumps(_plain(sets or value))
        whole = json.dumps([sorted(item) if isinstance(item, set) else item for item in value])
        sets = [sorted(item) for item in value if isinstance(item, set)]
        return whole, json.dumps(sets) if sets else whole
    except Exception:  # any malformed literal means "not this format"
        return None, None


@F.pandas_udf(T.StructType([T.StructField(name, T.StringType()) for name in ("whole", "span", "sets")]))
def _literal_json(whole: pd.Series, span: pd.Series) -> pd.DataFrame:
    spans = [span_literal(text) for text in span]
    return pd.DataFrame({"whole": whole.map(whole_literal), "span": [a for a, _ in spans], "sets": [b for _, b in spans]})


# Declared non-deterministic so that the optimizer neither copies it nor moves filters below it: each
# batch goes to Python once.
literal_json = _literal_json.asNondeterministic()


def may_be_literal(text: Column) -> Column:
    """Cheap test before the parser: a quoted text, or a dict that names its triples."""
    quoted = text.rlike(r"^[(\s]*[uUrRfF]?['\"]")
    keyed = text.rlike(r"^[(\s]*\{") & F.contains(text, F.lit("triple"))
    return quoted | keyed
