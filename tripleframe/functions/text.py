"""Text expressions: trimming, case, list and JSON renderings, names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F, types as T

# Java regex flags: (?d) lets '.' exclude only the newline, (?U) makes \s and \d cover all of Unicode.
FLAGS = "(?dU)"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def nonempty(value: Column) -> Column:
    """The array, or NULL when it holds nothing."""
    return let(value, lambda v: F.when(F.size(v) > 0, v))


def strip(text: Column) -> Column:
    """Drop white space of any kind at both ends."""
    # the pattern is tried at every sign, so only texts that need it meet it
    ends = F.concat(F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    bare = F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")
    return F.when(ends.rlike(r"(?U)[\s\x1c-\x1f]"), bare).otherwise(text)


def sentence_case(text: Column) -> Column:
    """Text that does not start with an upper-case letter gets one, and a lower-case rest."""
    head, rest = F.substring(text, 1, 1), F.substr(text, F.lit(2))
    return F.when(text.rlike(r"^\p{Lu}"), text).otherwise(F.concat(F.upper(head), F.lower(rest)))


def list_literal(items: Column, depth: int = 1) -> Column:
    """A list of strings (depth 1) or of string lists (depth 2) in Python-literal form."""

    def one(text: Column) -> Column:
        safe = text
        for raw, shown in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            safe = F.replace(safe, F.lit(raw), F.lit(shown))
        safe = _unprintable_spelled(safe)
        double = F.concat(F.lit('"'), safe, F.lit('"'))
        single = F.concat(F.lit("'"), F.replace(safe, F.lit("'"), F.lit("\\'")), F.lit("'"))
        return F.when(F.contains(text, F.lit("'")) & ~F.contains(text, F.lit('"')), double).otherwise(single)

    inner = one if depth == 1 else (lambda row: list_literal(row, depth - 1))
    return F.concat(F.lit("["), F.array_join(F.transform(items, inner), ", "), F.lit("]"))


# What Python does not print: controls, formats, surrogates, private use, unassigned, and separators but the blank.
UNPRINTABLE = r"[\p{C}\p{Z}&&[^ ]]"


def _unprintable_spelled(text: Column) -> Column:
    """Unprintable characters as ``\\xhh``, ``\\uhhhh`` or ``\\Uhhhhhhhh``."""

    def spelled(char: Column) -> Column:
        code = F.lower(F.hex(F.encode(char, "UTF-32")))
        short, middle = F.concat(F.lit("\\x"), F.substring(code, -2, 2)), F.concat(F.lit("\\u"), F.substring(code, -4, 4))
        long = F.concat(F.lit("\\U"), code)
        return F.when(~char.rlike(f"^{UNPRINTABLE}$"), char).when(code.startswith("000000"), short).when(code.startswith("0000"), middle).otherwise(long)

    return F.when(text.rlike(UNPRINTABLE), F.array_join(F.transform(F.split(text, ""), spelled), "")).otherwise(text)


def json_string(text: Column) -> Column:
    """A JSON string in pure ASCII: everything outside the printable ASCII range as \\uXXXX."""
    safe = text
    for raw, shown in (
        ("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\f", "\\f"), ("\b", "\\b")
    ):
        safe = F.replace(safe, F.lit(raw), F.lit(shown))

    def escaped(char: Column) -> Column:
        units = F.lower(F.hex(F.encode(char, "UTF-16BE")))
        return F.when(char.rlike(r"^[ -~]$"), char).otherwise(F.regexp_replace(units, "(.{4})", r"\\u$1"))

    spelled = F.array_join(F.transform(F.split(safe, ""), escaped), "")
    return F.concat(F.lit('"'), F.when(safe.rlike(r"[^ -~]"), spelled).otherwise(safe), F.lit('"'))


def json_text(value: Column, kind: T.DataType) -> Column:
    """``value`` of type ``kind`` as JSON text with ", " and ": " separators and ASCII-only strings."""
    if isinstance(kind, T.StringType):
        shown = json_string(value)
    elif isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda item: json_text(item, kind.elementType))
        shown = F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        pairs = F.transform(
            F.map_entries(value),
            lambda pair: F.concat(json_string(pair["key"]), F.lit(": "), json_text(pair["value"], kind.valueType)),
        )
        shown = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    elif isinstance(kind, T.StructType):
        fields = [
            F.concat(json_string(F.lit(field.name)), F.lit(": "), json_text(value[field.name], field.dataType))
            for field in kind.fields
        ]
        shown = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    else:
        shown = value.cast("string")
    return F.coalesce(shown, F.lit("null"))


def escape_braces(text: Column) -> Column:
    """Double every brace, for text that will pass through another template."""
    return F.replace(F.replace(text, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def entity_hints(entities: Column) -> Column:
    """The first two characters of every entity."""
    return F.transform(entities, lambda name: F.substring(name, 1, 2))


def id_from_uri(uri: Column) -> Column:
    """The last path segment of a knowledge-base address."""
    return F.substring_index(uri, "/", -1)


def stem(path: Column) -> Column:
    """File name of a path, up to its first dot."""
    return F.substring_index(F.substring_index(path, "/", -1), ".", 1)


def prompt_run_name(template_path: Column, input_path: Column) -> Column:
    """Name of a prompt run: template stem, ``s_``, input stem."""
    return F.concat(stem(template_path), F.lit("s_"), stem(input_path))


def linking_run_name(template_path: Column, extraction_path: Column) -> Column:
    """Name of a linking-prompt run made from an extraction run: its ``KE_`` becomes ``EL_``."""
    return prompt_run_name(template_path, F.replace(extraction_path, F.lit("KE_"), F.lit("EL_")))


def checked_run_name(run: Column, prefix: str) -> Column:
    """Name of a knowledge-base result: ``prefix`` and the run with ``post_processed_`` cut to ``_``."""
    return F.concat(F.lit(prefix), F.replace(run, F.lit("post_processed_"), F.lit("_")))
