"""Normalisation, tokens, morphology and n-grams as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.lexicon import STOP_FUNCTION, SUFFIXES, suffix_pattern


def lower_tr(c: Column) -> Column:
    """Turkish lower case, trimmed. Null stays null."""
    return F.trim(F.lower(F.translate(c, "İIŞĞÜÖÇ", "iışğüöç")))


def lower_tr_dotless(c: Column) -> Column:
    """Turkish lower case that also drops a combining dot above; not trimmed."""
    return F.replace(F.lower(F.translate(c, "İI", "iı")), F.lit("i̇"), F.lit("i"))


def fold(c: Column) -> Column:
    """ASCII letters, lower case, single spaces, trimmed. Null becomes empty."""
    plain = F.lower(F.translate(F.coalesce(c, F.lit("")), "İIıŞşĞğÜüÖöÇç", "iiissgguuoocc"))
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def tokens(c: Column) -> Column:
    """Words between white space, without empty ones."""
    return F.filter(F.split(F.trim(c), r"\s+"), lambda x: x != "")


def word_tokens(c: Column, least: int = 2) -> Column:
    """Runs of lower-case letters and digits, at least ``least`` characters long."""
    return F.filter(F.split(c, "[^0-9a-zçğıöşü]+"), lambda x: F.length(x) >= least)


def ascii_tokens(c: Column) -> Column:
    return F.regexp_extract_all(fold(c), F.lit("[a-z0-9]+"), F.lit(0))


def stem(word: Column, suffixes: tuple[str, ...] = tuple(SUFFIXES)) -> Column:
    """Without its longest suffix that leaves three characters or more."""
    return F.regexp_replace(word, suffix_pattern(suffixes), "$1")


def stems(words: Column) -> Column:
    return F.transform(words, lambda w: stem(w))


def word_ngrams(words: Column, most: int = 3) -> Column:
    """N-grams of 1 to ``most`` words, shorter ones first, each by position."""
    one = lambda n: F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1))), lambda i: i <= F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " ")
    )
    return F.flatten(F.array(*[one(n) for n in range(1, most + 1)]))


def char_ngrams(words: Column, least: int = 3, most: int = 5) -> Column:
    """Character n-grams inside words that are padded with a space on both sides; a word shorter than n gives itself once."""

    def of(word: Column) -> Column:
        w = F.concat(F.lit(" "), word, F.lit(" "))

        def one(n: int) -> Column:
            own = F.transform(F.sequence(F.lit(1), F.greatest(F.length(w) - n + 1, F.lit(1))), lambda i: F.substring(w, i, F.lit(n)))
            return own if n == least else F.when(F.length(w) > n - 1, own).otherwise(F.array().cast("array<string>"))

        return F.flatten(F.array(*[one(n) for n in range(least, most + 1)]))

    return F.flatten(F.transform(words, of))


def bigrams(words: Column) -> Column:
    return F.filter(word_ngrams(words, 2), lambda g: F.contains(g, F.lit(" ")))


def clean_control(c: Column, most: int = 400) -> Column:
    """Control characters to spaces, cut to ``most`` characters, trimmed."""
    return F.trim(F.substring(F.regexp_replace(c, r"[\x00-\x1f\x7f-\x9f]", " "), 1, most))


def strip_punctuation(c: Column) -> Column:
    return F.regexp_replace(c, r"[^a-z0-9çğıöşü\s]", " ")


def without(words: Column, stop: tuple[str, ...] | list[str]) -> Column:
    drop = F.array(*[F.lit(s) for s in stop])
    return F.filter(words, lambda w: ~F.array_contains(drop, w))


def head_noun(words: Column, stop: tuple[str, ...] = tuple(STOP_FUNCTION)) -> Column:
    """Last word that is no function word and longer than one character; else the last word, empty without words."""
    content = F.filter(without(words, stop), lambda w: F.length(w) > 1)
    return F.coalesce(F.try_element_at(content, F.lit(-1)), F.try_element_at(words, F.lit(-1)), F.lit(""))


def suffixed_ratio(words: Column, suffixes: tuple[str, ...] = tuple(SUFFIXES)) -> Column:
    return F.size(F.filter(words, lambda w: w.rlike(suffix_pattern(suffixes)))) / F.greatest(F.lit(1), F.size(words))


def among(word: Column, words: list[str] | tuple[str, ...]) -> Column:
    return word.isin(*words)


def lookup(word: Column, table: dict[str, str], default: Column | None = None) -> Column:
    """The value of a fixed dictionary; ``default`` (else null) where the word is missing."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    found = F.try_element_at(pairs, word)
    return found if default is None else F.coalesce(found, default)
