"""Pairwise string and set similarities as column expressions. Two empty sides are alike (1.0), one is not (0.0)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _ratio(a: Column, b: Column, value: Column) -> Column:
    """1.0 if both are empty, 0.0 if one is, else value."""
    return F.when((a == 0) & (b == 0), 1.0).when((a == 0) | (b == 0), 0.0).otherwise(value)


def levenshtein(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def levenshtein_similarity(a: Column, b: Column) -> Column:
    return _ratio(F.length(a), F.length(b), 1.0 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b)))


def char_grams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams; a shorter text is its own only gram."""
    many = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substring(text, i, F.lit(n))))
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).when(F.length(text) <= n, F.array(text)).otherwise(many)


def gram_codes(grams: Column) -> Column:
    """Grams of at most three ASCII characters, as all of normalised texts are, as the numbers that their bytes make: arrays of numbers meet faster."""
    return F.transform(grams, lambda g: F.conv(F.hex(g), 16, 10).cast("int"))


def jaccard_of(n: Column, m: Column, both: Column) -> Column:
    """Of the sizes of two sets and of what they share."""
    return _ratio(n, m, both / (n + m - both))


def dice_of(n: Column, m: Column, both: Column) -> Column:
    return _ratio(n, m, 2.0 * both / (n + m))


def overlap_of(n: Column, m: Column, both: Column) -> Column:
    return _ratio(n, m, both / F.least(n, m))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats."""
    both = F.size(F.array_intersect(a, b))
    return _ratio(F.size(a), F.size(b), both / (F.size(a) + F.size(b) - both))


def dice(a: Column, b: Column) -> Column:
    return _ratio(F.size(a), F.size(b), 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b)))


def overlap(a: Column, b: Column) -> Column:
    return _ratio(F.size(a), F.size(b), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b)))


def numbers(words: Column) -> Column:
    return F.array_distinct(F.filter(words, lambda w: w.rlike("^[0-9]+$")))


def number_overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of the numbers among two lists of words."""
    return overlap(numbers(a), numbers(b))


def jaro_winkler(a: Column, b: Column, p: float = 0.1, longest_prefix: int = 4) -> Column:
    """Jaro-Winkler with half transpositions counted as halves and the prefix bonus always given.

    One pass over a greedily takes, for each character, the first free place in b within the window; what is matched
    on either side in order gives the transpositions.
    """
    n, m = F.length(a), F.length(b)
    window = F.greatest(F.floor(F.greatest(n, m) / 2).cast("int") - 1, F.lit(0))

    def step(state: Column, i: Column) -> Column:
        lo, hi = F.greatest(i - window, F.lit(1)), F.least(i + window, m)
        free = F.filter(F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>")), lambda j: (F.substring(b, j, F.lit(1)) == F.substring(a, i, F.lit(1))) & ~F.array_contains(state["taken"], j))
        found = F.get(free, F.lit(0))
        return F.when(found.isNull(), state).otherwise(F.struct(F.concat(state["chars"], F.substring(a, i, F.lit(1))).alias("chars"), F.array_append(state["taken"], found).alias("taken")))

    start = F.struct(F.lit("").alias("chars"), F.array().cast("array<int>").alias("taken"))

    def score(state: Column) -> Column:
        k = F.length(state["chars"])
        other = F.transform(F.array_sort(state["taken"]), lambda j: F.substring(b, j, F.lit(1)))
        own = F.transform(F.sequence(F.lit(1), k), lambda i: F.substring(state["chars"], i, F.lit(1)))
        moved = F.size(F.filter(F.zip_with(own, other, lambda x, y: x != y), lambda d: d)) / 2.0
        jaro = (k / n + k / m + (k - moved) / k) / 3.0
        same = [F.when((F.least(n, m) >= i) & (F.substring(a, 1, i) == F.substring(b, 1, i)), 1).otherwise(0) for i in range(1, longest_prefix + 1)]
        return F.when(k == 0, 0.0).otherwise(jaro + sum(same[1:], same[0]) * p * (1.0 - jaro))

    found = F.aggregate(F.sequence(F.lit(1), n), start, step, score)
    return F.when(a == b, 1.0).when((n == 0) | (m == 0), 0.0).otherwise(found)
