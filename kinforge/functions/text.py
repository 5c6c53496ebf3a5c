"""Text normalisation as column expressions; nothing leaves the JVM.

Missing text is the empty string throughout: no function here returns null.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# The word lists that results depend on.
MULTI_WORD_SUFFIXES = ("private limited", "pvt ltd", "pvt limited", "co ltd", "pty ltd", "holding corp", "holdings ltd")
SUFFIXES = tuple("inc incorporated corp corporation llc ltd limited pvt private co company llp gmbh sarl sas sa plc nv bv ag sl srl cie".split())
NAME_STOPWORDS = tuple("the a an of and in for on at by with".split())
ANALYSIS_SUFFIXES = tuple("inc incorporated corp corporation llc ltd limited pvt private co company llp gmbh sarl sas sa plc nv bv ag spa".split())
ANALYSIS_PAIRS = ("pvt ltd", "private limited")


@lru_cache(maxsize=1)
def _foldings() -> tuple[str, str, list[tuple[str, str]]]:
    """Code points that compatibility decomposition turns into ASCII: one-to-one as two strings, one-to-many as pairs."""
    one, to, many = [], [], []
    for point in range(0x80, 0x110000):
        if 0xD800 <= point < 0xE000:
            continue
        plain = unicodedata.normalize("NFKD", chr(point)).encode("ascii", "ignore").decode()
        if len(plain) == 1:
            one.append(chr(point))
            to.append(plain)
        elif plain:
            many.append((chr(point), plain))
    return "".join(one), "".join(to), many


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; null becomes empty."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def fold(c: Column) -> Column:
    """The ASCII part of the text's compatibility decomposition."""
    one, to, many = _foldings()
    pairs = F.split(F.lit("\x00".join(a + b for a, b in many)), "\x00")
    replaced = F.aggregate(pairs, c, lambda text, p: F.replace(text, F.substring(p, 1, 1), F.substring(p, F.lit(2), F.length(p))))
    expanded = F.when(c.rlike("[" + "".join(a for a, _ in many) + "]"), replaced).otherwise(c)
    folded = F.regexp_replace(F.translate(expanded, one, to), r"[^\x00-\x7F]", "")
    return F.when(c.rlike(r"[^\x00-\x7F]"), folded).otherwise(c)


def standard(c: Column) -> Column:
    """Folded, lower case, & spelled out, punctuation and white space as single blanks."""
    text = F.replace(F.lower(fold(F.coalesce(c, F.lit("")))), F.lit("&"), F.lit(" and "))
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\w\s]", " "), r"\s+", " "))


def _any(words: Iterable[str]) -> str:
    return "(?:" + "|".join(words) + ")"


def _let(value: Column, then) -> Column:
    """then(value), with value computed once, however often then names it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def business_name(c: Column, remove_suffixes: bool = True, suffixes: Iterable[str] | None = None) -> Column:
    """A standard name without legal suffixes: one of several words at the end, then single ones at either end while a word is left, then those between other words."""
    text = standard(c)
    if not remove_suffixes:
        return text
    single = tuple(suffixes or SUFFIXES)
    if not all(re.fullmatch(r"\w+", x) for x in single):  # patterns, or suffixes of several words
        text = F.regexp_replace(text, f" {_any(MULTI_WORD_SUFFIXES)}$", "")
        text = F.regexp_replace(text, f"^(?:{_any(single)} )+", "")
        text = F.regexp_replace(text, f"(?: {_any(single)})+$", "")
        words = F.split(text, " ")
        return F.when(F.size(words) > 2, F.array_join(F.filter(words, lambda w: ~w.isin(*single)), " ")).otherwise(text)

    def without_pair(words: Column) -> Column:
        n = F.size(words)
        pair = F.concat_ws(" ", F.get(words, n - 2), F.get(words, n - 1))
        return F.when((n > 2) & pair.isin(*MULTI_WORD_SUFFIXES), F.slice(words, F.lit(1), n - 2)).otherwise(words)

    def without_single(words: Column) -> Column:  # of suffixes alone, the last is left
        either = F.array(F.array_join(F.filter(words, lambda w: ~w.isin(*single)), " "), F.element_at(words, -1))
        return F.coalesce(F.get(F.filter(either, lambda x: x != ""), F.lit(0)), F.lit(""))

    return _let(_let(F.split(text, " "), without_pair), without_single)


def address(c: Column) -> Column:
    return standard(c)


def words_of(text: Column, least: int = 2) -> Column:
    """The words of a normalised text that have at least so many characters."""
    return F.filter(F.split(text, " "), lambda w: F.length(w) >= max(1, least))


def name_words(name: Column, least: int = 2, without_stopwords: bool = False) -> Column:
    """Words of a normalised name."""
    words = words_of(name, least)
    return F.filter(words, lambda w: ~w.isin(*NAME_STOPWORDS)) if without_stopwords else words


def analysis_name(c: Column, remove_suffixes: bool = True) -> Column:
    """The analyses' own normaliser: one trailing suffix of two words or else of one, even if nothing is left."""
    text = standard(c)
    if not remove_suffixes:
        return text
    pair = f"(?:^| ){_any(ANALYSIS_PAIRS)}$"
    return F.when(text.rlike(pair), F.regexp_replace(text, pair, "")).otherwise(F.regexp_replace(text, f"(?:^| ){_any(ANALYSIS_SUFFIXES)}$", ""))


def analysis_words(c: Column, least: int = 2) -> Column:
    return words_of(standard(c), least)


def postal_code(c: Column) -> Column:
    """The first word of five or six digits, or empty."""
    return F.coalesce(F.get(F.filter(words_of(standard(c), 1), lambda w: w.rlike("^([0-9]{5}|[0-9]{6})$")), F.lit(0)), F.lit(""))


def country(c: Column) -> Column:
    return F.lower(strip(c))


class Normaliser:
    """The three settings that names and addresses are normalised by; methods return columns."""

    def __init__(self, remove_suffixes: bool = True, least: int = 2, without_stopwords: bool = False):
        self.remove_suffixes, self.least, self.without_stopwords = remove_suffixes, least, without_stopwords

    def name(self, c: Column) -> Column:
        return business_name(c, self.remove_suffixes)

    def address(self, c: Column) -> Column:
        return address(c)

    def name_words(self, c: Column) -> Column:
        return name_words(self.name(c), self.least, self.without_stopwords)

    def address_words(self, c: Column) -> Column:
        return words_of(address(c), self.least)
