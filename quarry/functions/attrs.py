"""Paths ``a/b/c``, attribute maps ``k: v, k: v``, and texts built from items."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.lexicon import UNKNOWN


def segments(path: Column) -> Column:
    """Trimmed, non-empty parts of a path."""
    return F.filter(F.transform(F.split(path, "/"), lambda x: F.trim(x)), lambda x: x != "")


def level(path: Column, n: int, default: str = UNKNOWN) -> Column:
    """The n-th part (from 0) as it stands, ``default`` where the path is shorter or null."""
    return F.coalesce(F.get(F.split(path, "/"), n), F.lit(default))


def entries(attributes: Column) -> Column:
    """Array of (key, value) in order. Parts without a colon are left out; a value runs from the first colon on."""
    parts = F.filter(F.split(F.coalesce(attributes, F.lit("")), ","), lambda x: F.contains(x, F.lit(":")))
    own = F.transform(parts, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value")))
    return F.when(attributes == UNKNOWN, F.array().cast("array<struct<key:string,value:string>>")).otherwise(own)


def value_of(attributes: Column, *keys: str) -> Column:
    """Value of the first key that is there (a repeated key: the last one); empty if none is."""
    of = lambda k: F.try_element_at(F.filter(entries(attributes), lambda e: e["key"] == k), F.lit(-1))["value"]
    return F.coalesce(*[of(k) for k in keys], F.lit(""))


def ordered(attributes: Column) -> Column:
    """(key, value) with each key once, at its first place, with its last value."""
    all_ = entries(attributes)
    keys = F.array_distinct(F.transform(all_, lambda e: e["key"]))
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(all_, lambda e: e["key"] == k), -1)["value"].alias("value")))


def values_text(attributes: Column) -> Column:
    return F.array_join(F.transform(ordered(attributes), lambda e: e["value"]), " ")


def short_text(attributes: Column, n: int = 4) -> Column:
    """The first ``n`` entries as ``k:v; k:v``."""
    return F.array_join(F.transform(F.slice(ordered(attributes), 1, n), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), "; ")


def item_text(title: Column, brand: Column, category: Column, attributes: Column) -> Column:
    """``title | brand | main category | renk:x | mat:y``; unknown and empty parts are skipped, the material is cut to 25."""
    known = lambda c, text=None: F.when((c != "") & (c != UNKNOWN), c if text is None else text)
    colour, material = value_of(attributes, "renk"), value_of(attributes, "materyal bileşeni", "materyal")
    return F.concat_ws(
        " | ", known(title), known(brand), known(F.get(F.split(category, "/"), 0)), known(colour, F.concat(F.lit("renk:"), colour)),
        known(material, F.concat(F.lit("mat:"), F.substring(material, 1, 25))),
    )


def document(*columns: Column) -> Column:
    """One text of several columns; null counts as empty and keeps its place."""
    return F.concat_ws(" ", *[F.coalesce(c.cast("string"), F.lit("")) for c in columns])
