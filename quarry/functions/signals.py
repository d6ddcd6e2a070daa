"""Typed signals of a query and an item: -1 contradicts, +1 agrees, 0 says nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.lexicon import COLOUR_FAMILY, COLOUR_SYNONYM, COLOURS, FOLDED_AGE, FOLDED_COLOURS, FOLDED_GENDER, FOLDED_MATERIALS, FOLDED_STOP, MATERIAL, UNKNOWN, whole_word
from quarry.functions.similarity import coverage
from quarry.functions.text import ascii_tokens, fold, lookup, without


def _any(words: Column, *some: str) -> Column:
    return F.arrays_overlap(words, F.array(*[F.lit(s) for s in some]))


def named(text: Column, *words: str) -> Column:
    """Whether one of the words is in the text as a whole word. The dear pattern is only tried where the letters are there."""
    there = F.contains(text, F.lit(words[0]))
    for w in words[1:]:
        there = there | F.contains(text, F.lit(w))
    return there & text.rlike(whole_word(*words))


def gender_cross(query_text: Column, gender: Column) -> Column:
    """Whole words in the query; a girl's item counts as a woman's."""
    q_w, q_m = named(query_text, "kadın", "bayan"), named(query_text, "erkek")
    i_w, i_m = gender.isin("kadın", "bayan", "kız"), gender == "erkek"
    return F.when((q_w & i_m) | (q_m & i_w), -1.0).when((q_w & i_w) | (q_m & i_m), 1.0).otherwise(0.0)


def gender_flags(query_text: Column, gender: Column) -> tuple[Column, Column]:
    """(match, conflict) by substrings."""
    q_w, q_m = F.contains(query_text, F.lit("kadın")), F.contains(query_text, F.lit("erkek"))
    i_w, i_m = F.contains(gender, F.lit("kadın")), F.contains(gender, F.lit("erkek"))
    return ((q_w & i_w) | (q_m & i_m)).cast("int"), ((q_w & i_m) | (q_m & i_w)).cast("int")


def age_cross(query_text: Column, age: Column) -> Column:
    baby, child, adult = named(query_text, "bebek", "bebekler"), named(query_text, "çocuk", "çocuklar"), named(query_text, "yetişkin")
    a_baby, a_child, a_adult = age.isin("bebek", "bebek & çocuk"), age.isin("çocuk", "bebek & çocuk", "genç"), age == "yetişkin"
    return (
        F.when(age.isNull() | age.isin(UNKNOWN, ""), 0.0)
        .when((baby & a_baby) | (child & a_child) | (adult & a_adult), 1.0)
        .when((baby & a_adult) | (adult & a_baby) | (child & a_adult) | (adult & a_child), -1.0)
        .otherwise(0.0)
    )


def query_colour(words: Column) -> Column:
    """The first colour word, synonyms resolved; null without one."""
    first = F.try_element_at(F.filter(words, lambda w: w.isin(*COLOURS)), F.lit(1))
    return colour_name(first)


def colour_name(c: Column) -> Column:
    return lookup(c, COLOUR_SYNONYM, c)


def colour_family(c: Column) -> Column:
    return lookup(c, COLOUR_FAMILY, c)


def colour_match(query_c: Column, item_c: Column) -> Column:
    """2 the same colour, 1 the same family, -1 another, 0 if either is missing."""
    return F.when(query_c.isNull() | (F.coalesce(item_c, F.lit("")) == ""), 0.0).when(query_c == item_c, 2.0).when(colour_family(query_c) == colour_family(item_c), 1.0).otherwise(-1.0)


def material_match(words: Column, material: Column) -> Column:
    """1 if any material of the query is in the item's."""
    own = F.filter(F.transform(words, lambda w: lookup(w, MATERIAL)), lambda m: m.isNotNull())
    return ((material != "") & F.exists(own, lambda m: F.contains(material, m))).cast("double")


def material_mismatch(words: Column, material: Column) -> Column:
    """Of the query's first material only: 1 found, -1 not found, 0 if either side names none."""
    first = F.try_element_at(F.filter(F.transform(words, lambda w: lookup(w, MATERIAL)), lambda m: m.isNotNull()), F.lit(1))
    return F.when(first.isNull() | (material == ""), 0.0).when(F.contains(material, first), 1.0).otherwise(-1.0)


def sleeve_match(query_text: Column, sleeve: Column) -> Column:
    both = lambda w: F.contains(query_text, F.lit(w)) & F.contains(sleeve, F.lit(w))
    return (both("uzun") | both("kısa") | both("kolsuz")).cast("double")


def codes(words: Column) -> Column:
    return F.array_distinct(F.filter(words, lambda w: w.rlike("[0-9]")))


def code_match(query: Column, target: Column, partial: bool = False) -> Column:
    """Words with digits: 1 all found, -1 none, 0 without any in the query; some found: 0, or their share if ``partial``."""
    q, t = codes(query), codes(target)
    hits = F.size(F.array_intersect(q, t))
    some = (hits / F.size(q)) if partial else F.lit(0.0)
    return F.when(F.size(q) == 0, 0.0).when((F.size(t) == 0) | (hits == 0), -1.0).when(hits == F.size(q), 1.0).otherwise(some)


def containment(a: Column, b: Column) -> Column:
    return (a == b) | F.contains(b, a) | F.contains(a, b)


def phrase_signal(found: Column, item: Column, both_ways: bool) -> Column:
    """0 if the query holds no phrase; 1 if the item has it (``both_ways``: or it has the item's), else -1."""
    hit = ((item != UNKNOWN) & containment(found, item)) if both_ways else F.contains(item, found)
    return F.when(found.isNull(), 0.0).when(hit, 1.0).otherwise(-1.0)


def query_type(text: Column, brand: Column, category: Column) -> Column:
    b, c = brand.isNotNull(), category.isNotNull()
    return (
        F.when(b & (brand == text), "brand_only").when(b & c, "brand_category").when(b, "brand_other").when(c & (category == text), "category_only")
        .when(c, "category_attr").otherwise("other")
    )


# --- on ASCII-folded tokens -------------------------------------------------------------------------------------------


def folded_gender(query_text: Column, gender: Column, title: Column) -> Column:
    q, t, g = ascii_tokens(query_text), ascii_tokens(title), fold(gender)
    q_w, q_m = _any(q, "kadin", "bayan", "kiz"), _any(q, "erkek")
    i_w, i_m = g.isin("kadin", "bayan", "kiz") | _any(t, "kadin", "bayan", "kiz"), (g == "erkek") | _any(t, "erkek")
    return F.when((q_w & i_m) | (q_m & i_w), -1.0).when((q_w & i_w) | (q_m & i_m), 1.0).otherwise(0.0)


def folded_age(query_text: Column, age: Column, title: Column) -> Column:
    q, t, a = ascii_tokens(query_text), ascii_tokens(title), fold(age)
    baby, child, adult = _any(q, "bebek"), _any(q, "cocuk"), _any(q, "yetiskin")
    i_baby, i_child, i_adult = (a == "bebek") | _any(t, "bebek"), a.isin("cocuk", "bebek & cocuk", "genc") | _any(t, "cocuk"), (a == "yetiskin") | _any(t, "yetiskin")
    return (
        F.when((baby & i_baby) | (child & i_child) | (adult & i_adult), 1.0)
        .when((baby & i_adult) | (child & i_adult) | (adult & (i_baby | i_child)), -1.0)
        .otherwise(0.0)
    )


def folded_colour(query_text: Column, target_text: Column) -> Column:
    of = lambda c: F.array_distinct(F.filter(ascii_tokens(c), lambda w: w.isin(*FOLDED_COLOURS)))
    q, t = of(query_text), of(target_text)
    return F.when((F.size(q) == 0) | (F.size(t) == 0), 0.0).when(F.arrays_overlap(q, t), 1.0).otherwise(-1.0)


def folded_product_cover(query_text: Column, title: Column, brand: Column) -> Column:
    q, t, b = ascii_tokens(query_text), ascii_tokens(title), ascii_tokens(brand)
    keep = F.filter(without(q, [*FOLDED_STOP, *FOLDED_GENDER, *FOLDED_AGE, *FOLDED_COLOURS, *FOLDED_MATERIALS]), lambda w: (F.length(w) > 1) & ~F.array_contains(b, w))
    return F.when(F.size(keep) == 0, coverage(q, t)).otherwise(F.size(F.filter(keep, lambda w: F.array_contains(t, w))) / F.size(keep))
