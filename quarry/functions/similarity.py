"""Lexical similarity of two texts, as Column expressions; fuzzy ratios as one Pandas UDF."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import attrs
from quarry.functions.lexicon import TURKISH, UNKNOWN, Pack
from quarry.functions.text import head_noun, stem, stems, strip_punctuation, tokens, without


def _share(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if both are empty."""
    return _share(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def coverage(a: Column, b: Column) -> Column:
    """Share of a's distinct members that b has; 0 if a is empty."""
    return _share(F.size(F.array_intersect(a, b)), F.size(F.array_distinct(a)))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def subset(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0).cast("double")


def stemmed(words: Column) -> Column:
    """Words with their stems, (w, s); made once for a term, as stemming is the dear part of matching."""
    return F.transform(words, lambda w: F.struct(w.alias("w"), stem(w).alias("s")))


def content_words(query: Column, pack: Pack = TURKISH) -> Column:
    return stemmed(F.filter(without(query, pack.stop), lambda w: F.length(w) > 1))


def product_words(query: Column, pack: Pack = TURKISH) -> Column:
    """Content words that are no gender, age, colour or material."""
    typed = [*pack.gender, *pack.age, *pack.colours, *pack.materials, *pack.stop]
    return stemmed(F.filter(without(query, typed), lambda w: F.length(w) > 1))


def content_of(words: Column, pack: Pack = TURKISH) -> Column:
    """``content_words`` of words that come with their stems, (w, s)."""
    return F.filter(words, lambda x: ~x["w"].isin(*pack.stop) & (F.length(x["w"]) > 1))


def product_of(words: Column, pack: Pack = TURKISH) -> Column:
    """``product_words`` of words that come with their stems, (w, s)."""
    typed = [*pack.gender, *pack.age, *pack.colours, *pack.materials, *pack.stop]
    return F.filter(words, lambda x: ~x["w"].isin(*typed) & (F.length(x["w"]) > 1))


def head_of(words: Column, pack: Pack = TURKISH) -> Column:
    """``query_head`` of words that come with their stems, (w, s)."""
    last = lambda ws: F.try_element_at(ws, F.lit(-1))
    return F.coalesce(last(content_of(words, pack)), last(words), F.struct(F.lit("").alias("w"), F.lit("").alias("s")))


def word_match(x: Column, words: Column, word_stems: Column) -> Column:
    """A word (w, s) equals one of ``words``, or their stems agree, or one starts with the first five letters of its stem."""
    return F.array_contains(words, x["w"]) | F.array_contains(word_stems, x["s"]) | ((F.length(x["s"]) >= 5) & F.exists(words, lambda y: F.startswith(y, F.substring(x["s"], 1, 5))))


def head_match(query: Column, words: Column, pack: Pack = TURKISH, word_stems: Column | None = None, head: Column | None = None) -> Column:
    """How well the query's head noun is found: 1 as it is, 0.8 by its stem, 0.4 by the stem's first five letters.

    ``word_stems`` and ``head`` (w, s) can be made before pairs are joined, here as below.
    """
    x = head if head is not None else query_head(query, pack)
    own = word_stems if word_stems is not None else stems(words)
    h, s = x["w"], x["s"]
    return (
        F.when(h == "", 0.0).when(F.array_contains(words, h), 1.0).when(F.array_contains(own, s), 0.8)
        .when((F.length(s) >= 5) & F.exists(words, lambda x: F.startswith(x, F.substring(s, 1, 5))), 0.4).otherwise(0.0)
    )


def query_head(query: Column, pack: Pack = TURKISH) -> Column:
    h = head_noun(query, pack.stop)
    return F.struct(h.alias("w"), stem(h).alias("s"))


def weighted_coverage(query: Column, words: Column, pack: Pack = TURKISH, word_stems: Column | None = None, content: Column | None = None) -> Column:
    """Share of the query's content words that match, where the last one counts twice."""
    content = content if content is not None else content_words(query, pack)
    own = word_stems if word_stems is not None else stems(words)
    weight = lambda i: F.when(i == F.size(content) - 1, 2.0).otherwise(1.0)
    hit = F.aggregate(F.transform(content, lambda w, i: F.when(word_match(w, words, own), weight(i)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(content) == 0, coverage(query, words)).otherwise(hit / (F.size(content) + 1.0))


def brand_tokens(brand: Column) -> Column:
    own = F.filter(tokens(strip_punctuation(brand)), lambda t: F.length(t) > 1)
    return F.when((brand == "") | (brand == UNKNOWN), F.array().cast("array<string>")).otherwise(F.array_distinct(own))


def plain_tokens(query_text: Column) -> Column:
    return tokens(strip_punctuation(query_text))


def brand_overlap(query_text: Column, brand: Column, brand_words: Column | None = None, plain: Column | None = None) -> Column:
    return coverage(brand_words if brand_words is not None else brand_tokens(brand), plain if plain is not None else plain_tokens(query_text))


def brand_weight(query: Column, brand: Column, brand_words: Column | None = None) -> Column:
    """Share of the query's words, with repeats, that are brand tokens."""
    b = brand_words if brand_words is not None else brand_tokens(brand)
    return _share(F.size(F.filter(query, lambda t: F.array_contains(b, t))), F.size(query))


def product_cover(query_text: Column, query: Column, words: Column, brand: Column, pack: Pack = TURKISH, word_stems: Column | None = None, product: Column | None = None, brand_words: Column | None = None, plain: Column | None = None) -> Column:
    """Share of the query's product words that match, after typed words and, if it clearly names the brand, brand words are dropped."""
    product, own = product if product is not None else product_words(query, pack), word_stems if word_stems is not None else stems(words)
    b = brand_words if brand_words is not None else brand_tokens(brand)
    b = F.when(brand_overlap(query_text, brand, b, plain) > 0.3, b).otherwise(F.array().cast("array<string>"))
    keep = F.filter(product, lambda x: ~F.array_contains(b, x["w"]))
    return F.when(F.size(keep) == 0, coverage(query, words)).otherwise(F.size(F.filter(keep, lambda x: word_match(x, words, own))) / F.size(keep))


def product_words_cover(query: Column, words: Column, brand: Column, pack: Pack = TURKISH, word_stems: Column | None = None, product: Column | None = None, brand_words: Column | None = None) -> Column:
    """As ``product_cover``, but brand words are always dropped, and a query without product words gives 0."""
    product, own = product if product is not None else product_words(query, pack), word_stems if word_stems is not None else stems(words)
    b = brand_words if brand_words is not None else brand_tokens(brand)
    keep = F.filter(product, lambda x: ~F.array_contains(b, x["w"]))
    return _share(F.size(F.filter(keep, lambda x: word_match(x, words, own))), F.size(keep))


def attribute_jaccard(query: Column, attributes: Column) -> Column:
    """Jaccard with the values of the map; with the raw text where it holds none."""
    has = F.size(attrs.entries(attributes)) > 0
    return F.when(has, jaccard(query, tokens(attrs.values_text(attributes)))).otherwise(jaccard(query, tokens(attributes)))


def attribute_coverage(query: Column, attributes: Column) -> Column:
    return F.when(F.size(attrs.entries(attributes)) > 0, coverage(query, tokens(attrs.values_text(attributes)))).otherwise(0.0)


def contains_known(text: Column, needle: Column, least: int = 1) -> Column:
    """1 if the needle is known, long enough and in the text."""
    return F.coalesce((F.length(needle) >= least) & (needle != UNKNOWN) & F.contains(text, needle), F.lit(False)).cast("double")


def either_contains(brand: Column, words: Column, least: int = 3) -> Column:
    return F.coalesce((F.length(brand) >= least) & F.exists(words, lambda t: (F.length(t) >= least) & (F.contains(t, brand) | F.contains(brand, t))), F.lit(False)).cast("double")


# --- fuzzy ratios: no built-in computes a longest common subsequence ---------------------------------------------------


def _masks(a: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


def lcs(a: str, b: str, masks: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, by bit vectors in one long number; ``masks`` are those of a."""
    masks = masks if masks is not None else _masks(a)
    full = (1 << len(a)) - 1
    v = full
    for c in b:
        u = v & masks.get(c, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def ratio(a: str, b: str) -> float:
    """Indel similarity 2 LCS / (len a + len b); two empty texts are equal."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def _best_window(s: str, t: str, best: float) -> float:
    """Best ratio of s with any window of t of its length, cut at the ends; windows whose characters can't beat ``best`` are skipped.

    The common characters of a window, counted with repeats, bound its subsequence; sliding changes them by one character on each side.
    """
    n, masks, have, common = len(s), _masks(s), dict.fromkeys(s, 0), 0
    for c in s:
        have[c] += 1  # how many of c are still unmatched by the window
    for i in range(1 - n, len(t)):
        if (new := i + n - 1) < len(t) and (c := t[new]) in have:
            common += have[c] > 0
            have[c] -= 1
        if i > 0 and (c := t[i - 1]) in have:
            have[c] += 1
            common -= have[c] > 0
        size = min(new, len(t) - 1) - max(i, 0) + 1
        if 2 * common / (n + size) > best:
            best = max(best, 2 * lcs(s, t[max(i, 0) : i + n], masks) / (n + size))
    return best


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with any window of the longer one, windows at the ends may be cut."""
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if not s:
        return 0.0 if t else 1.0
    if s in t:
        return 1.0
    best = _best_window(s, t, 0.0)
    return _best_window(t, s, best) if len(a) == len(b) else best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """Best ratio among common words, and common words with either rest; 1 if one side's words are all common."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if common and (not left or not right):
        return 1.0
    join = lambda r: f"{common} {r}" if common else r
    best = ratio(join(left), join(right))
    return max(best, ratio(common, join(left)), ratio(common, join(right))) if common else best


#: The longest shorter and longer texts that are compared in bulk, and how many pairs at a time.
BITS, LONG, BULK = 64, 256, 2048


def _coded(rows: list[str], table: np.ndarray, width: int) -> np.ndarray:
    """The characters as codes of ``table``, a column for each text; 0 after its end."""
    out = np.zeros((len(rows), width), np.int64)
    size = np.fromiter(map(len, rows), np.int64, len(rows))
    out[np.arange(width) < size[:, None]] = table[np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)]
    return np.ascontiguousarray(out.T)


def _bulk(short: list[str], long: list[str], windows: bool) -> np.ndarray:
    """For each pair the ratio (``windows``: the best one of the shorter text with a window of the longer), as ``ratio`` and ``_best_window`` give them.

    The bit vectors of a few thousand pairs are advanced together, a character at a time. Pairs come in falling length of the shorter text, so those
    that are done lie at the end.
    """
    n, m = (np.fromiter(map(len, x), np.int64, len(x)) for x in (short, long))
    chars = np.frombuffer("".join(set("".join(short))).encode("utf-32-le", "surrogatepass"), np.uint32)
    table = np.zeros(0x110000, np.uint16)  # other characters match nothing
    table[chars] = np.arange(1, len(chars) + 1)
    rows, width = np.arange(len(n)), len(chars) + 1
    masks = np.zeros((len(n), width), np.uint64)
    for k, c in enumerate(_coded(short, table, int(n[0]))):
        live = np.searchsorted(-n, -k)  # those longer than k
        masks[rows[:live], c[:live]] |= np.uint64(1 << k)
    flat, most = masks.ravel(), int(m.max())
    at = _coded(long, table, most) + rows * width
    full = np.where(n == 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(n, 63).astype(np.uint64)) - np.uint64(1))
    best = np.zeros(len(n))
    for start in range(most if windows else 1):
        if start and (2 * np.clip(m - start, 0, n) <= best * (n + np.clip(m - start, 0, n))).all():
            break  # what is left is too short
        v = full.copy()
        for k in range(min(int(n[0]), most - start) if windows else most):
            live = int(np.searchsorted(-n, -k)) if windows else len(n)
            w = v[:live]
            u = w & flat.take(at[start + k, :live])
            np.bitwise_or(w + u, w - u, out=w)
            if windows and not start:  # windows that begin before the text
                hit = n[:live] - np.bitwise_count(w & full[:live])
                best[:live] = np.maximum(best[:live], np.where(k < m[:live], 2 * hit / (n[:live] + k + 1), 0))
        if start or not windows:
            hit, size = n - np.bitwise_count(v & full), np.minimum(n, m - start) if windows else m
            best = np.maximum(best, np.where(size > 0, 2 * hit / np.maximum(n + size, 1), 0))
    return best


def _in_bulk(pairs: list[tuple[str, str]], windows: bool) -> list[float]:
    """``ratio``, or ``partial_ratio``, of all pairs; very long texts one by one."""
    one = partial_ratio if windows else ratio
    out, todo = [0.0] * len(pairs), []
    for k, (a, b) in enumerate(pairs):
        s, t = (a, b) if len(a) <= len(b) else (b, a)
        if not s or len(s) > BITS or len(t) > LONG:
            out[k] = one(a, b)
        elif windows and s in t:
            out[k] = 1.0
        else:
            todo.append((s, t, k))
            if windows and len(s) == len(t):
                todo.append((t, s, k))
    todo.sort(key=lambda x: (-len(x[0]), len(x[1])))
    for k in range(0, len(todo), BULK):
        short, long, place = zip(*todo[k : k + BULK], strict=True)
        for p, x in zip(place, _bulk(list(short), list(long), windows).tolist(), strict=True):
            out[p] = max(out[p], x)
    return out


def _set_parts(a: str, b: str) -> list[tuple[str, str]] | float:
    """The pairs of which ``token_set_ratio`` is the best ratio, or its value where it needs none."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    common, left, right = " ".join(sorted(x & y)), " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if not common:
        return [(left, right)]
    if not left or not right:
        return 1.0
    left, right = f"{common} {left}", f"{common} {right}"
    return [(left, right), (common, left), (common, right)]


def _ratios(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    """The four ratios; equal pairs of a batch are compared once."""
    all_ = list(zip(a.fillna(""), b.fillna(""), strict=True))
    pairs = list(dict.fromkeys(all_))
    ordered = {x: " ".join(sorted(x.split())) for x in {x for p in pairs for x in p}}
    sets = [_set_parts(*p) for p in pairs]
    asked = [(ordered[x], ordered[y]) for x, y in pairs]
    found = _in_bulk(pairs + asked + [p for s in sets if isinstance(s, list) for p in s], False)
    basic, sort, rest = found[: len(pairs)], found[len(pairs) : 2 * len(pairs)], iter(found[2 * len(pairs) :])
    best = [max(next(rest) for _ in s) if isinstance(s, list) else s for s in sets]
    four = dict(zip(pairs, zip(basic, _in_bulk(pairs, True), sort, best, strict=True), strict=True))
    return pd.DataFrame([four[p] for p in all_], columns=["fuzz_basic", "fuzz_partial", "fuzz_sort", "fuzz_set"], dtype=float)


def fuzzy(a: Column, b: Column) -> Column:
    """A struct of the four ratios of two texts; null counts as empty."""
    return F.pandas_udf(_ratios, "fuzz_basic double, fuzz_partial double, fuzz_sort double, fuzz_set double")(a, b)
