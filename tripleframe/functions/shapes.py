"""Shapes of JSON answers: which of them are triples, and how the items look.

An item is ``struct<parts array<string>, all_strings boolean>``.  Parts that are not strings are shown as
JSON text and clear the flag: such an item counts as extracted but can match no gold triple.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tripleframe.fixed import CAPITAL_TRIPLE_KEYS, LIST_KEYS, RELATION_TRIPLE_KEYS, TRIPLE_KEYS
from tripleframe.functions.text import let

ITEMS = "array<struct<parts:array<string>,all_strings:boolean>>"


def _item(values: Column) -> Column:
    """Item from an ``array<variant>``."""
    return F.struct(
        F.transform(values, lambda v: F.try_variant_get(v, "$", "string")).alias("parts"),
        F.forall(values, lambda v: F.schema_of_variant(v) == "STRING").alias("all_strings"),
    )


def _list_items(values: Column) -> Column:
    """Items of a list whose elements are all lists, else NULL."""
    rows = F.transform(values, lambda v: F.try_variant_get(v, "$", "array<variant>"))  # NULL for anything but a list
    return let(rows, lambda rs: F.when(F.forall(rs, lambda r: r.isNotNull()), F.transform(rs, _item)))


def _objects(values: Column) -> Column:
    """The elements as maps, NULL for those that are no objects; read once for all shapes."""
    return F.transform(values, lambda v: F.try_variant_get(v, "$", "map<string,variant>"))


def _dict_items(held: Column, keys: tuple[str, ...]) -> Column:
    """Items of a list whose elements, given by ``_objects``, are all objects with these keys, else NULL."""

    def fits(m: Column) -> Column:
        present = F.map_contains_key(m, keys[0])
        for key in keys[1:]:
            present = present & F.map_contains_key(m, key)
        return F.coalesce(present, F.lit(False))

    def values_of(m: Column) -> Column:
        return let(F.array(*[F.try_element_at(m, F.lit(key)) for key in keys]), _item)

    return F.when(F.forall(held, fits), F.transform(held, values_of))


def variant_items(value: Column, capitals: bool = True) -> Column:
    """Items of a JSON answer, or NULL when no known shape fits all of it.

    ``capitals=False`` leaves out the shape with capitalised keys, as the knowledge-base check does.
    """
    keys = [TRIPLE_KEYS, *([CAPITAL_TRIPLE_KEYS] if capitals else []), RELATION_TRIPLE_KEYS]

    def in_list(values: Column) -> Column:
        objects = let(_objects(values), lambda held: F.coalesce(*[_dict_items(held, k) for k in keys]))
        return F.coalesce(_list_items(values), objects)

    def under_key(whole: Column, key: str) -> Column:
        listed = F.try_variant_get(whole, f"$.{key}", "array<variant>")
        return let(listed, lambda v: F.when(v.isNotNull(), let(_objects(v), lambda held: _dict_items(held, TRIPLE_KEYS))))

    def choose(whole: Column, values: Column) -> Column:
        # a value that is no list has no list form, one that is no object has no field
        return F.when(values.isNotNull(), in_list(values)).otherwise(F.coalesce(*[under_key(whole, key) for key in LIST_KEYS]))

    return let(value, lambda whole: let(F.try_variant_get(whole, "$", "array<variant>"), lambda values: choose(whole, values)))


def string_items(rows: Column) -> Column:
    """Items of ``array<array<string>>``, as the pattern readers return it."""
    return F.transform(rows, lambda parts: F.struct(parts.alias("parts"), F.lit(True).alias("all_strings")))
