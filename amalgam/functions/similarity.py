"""Similarities of two texts: set-based ones as native expressions, edit-based ones as Arrow UDFs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from amalgam.functions.batches import jaro_winkler_ratios, partial_token_set_ratios, ratios
from amalgam.functions.text import char_grams, let, text, token_set, word_sort


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty."""
    of = lambda union, both: F.when(union == 0, 1.0).otherwise(both / F.greatest(union, F.lit(1)))
    return let(lambda x, y: let(of, F.size(F.array_union(x, y)), F.size(F.array_intersect(x, y))), a, b)


def token_jaccard(a: Column, b: Column) -> Column:
    return jaccard(token_set(a), token_set(b))


def _squeezed(c: Column) -> Column:
    return F.replace(F.lower(text(c)), F.lit(" "), F.lit(""))


def trigram_jaccard(a: Column, b: Column) -> Column:
    """Of character trigrams of the lower-cased texts without blanks."""
    return jaccard(char_grams(_squeezed(a), 3), char_grams(_squeezed(b), 3))


def bigram_dice(a: Column, b: Column) -> Column:
    """Of character bigrams of the lower-cased texts, runs of white space as one blank."""
    form = lambda c: F.regexp_replace(F.lower(text(c)), r"(?U)\s\s+", " ")
    of = lambda x, y: 2 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y) + F.lit(1e-8))
    return let(of, char_grams(form(a), 2), char_grams(form(b), 2))


def length_ratio(a: Column, b: Column) -> Column:
    return F.length(text(a)) / F.greatest(F.length(text(b)), F.lit(1))


def token_overlap(n1: Column, a1: Column, n2: Column, a2: Column) -> Column:
    """The number of words of name or address that both records hold, from their sets of words."""
    return F.size(F.array_intersect(F.array_union(n1, a1), F.array_union(n2, a2)))


def prefix_match(a: Column, b: Column, n: int) -> Column:
    return ((F.left(text(a), F.lit(n)) == F.left(text(b), F.lit(n))) & (text(a) != "")).cast("double")


def same_country(a: Column, b: Column) -> Column:
    return ((text(a) == text(b)) & (text(a) != "")).cast("double")


def difficulty(names: Column, addresses: Column, c1: Column, c2: Column) -> Column:
    """How hard a pair is to tell from a match: half the likeness of names, three tenths that of addresses, a fifth the country."""
    low = lambda c: F.lower(text(c))
    return 0.5 * names + 0.3 * addresses + 0.2 * same_country(low(c1), low(c2))


def paired(f: Callable[[list[str], list[str]], np.ndarray]):
    """A function of two lists of texts, as one of two columns."""

    @F.pandas_udf(DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(f(a.tolist(), b.tolist()), dtype="float64")

    return run


_ratio, _jw, _partial = paired(ratios), paired(jaro_winkler_ratios), paired(partial_token_set_ratios)


def ratio(a: Column, b: Column) -> Column:
    return _ratio(text(a), text(b))


def jaro_winkler(a: Column, b: Column) -> Column:
    return _jw(text(a), text(b))


def token_sort_ratio(a: Column, b: Column) -> Column:
    return _ratio(word_sort(a), word_sort(b))


def partial_token_set(a: Column, b: Column) -> Column:
    """The slow branch runs only for pairs without a word in common: the others are settled natively and reach the UDF as nulls."""
    words = lambda c: F.filter(F.split(text(c), r"(?U)\s+"), lambda t: t != "")
    settled = let(lambda x, y: F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).when(F.arrays_overlap(x, y), 1.0), words(a), words(b))
    slow = _partial(F.when(settled.isNull(), text(a)).otherwise(""), F.when(settled.isNull(), text(b)).otherwise(""))
    return F.coalesce(settled, slow)


def register(spark) -> None:
    """The edit-based similarities for SQL users."""
    for name, f in (("lcs_ratio", _ratio), ("jaro_winkler", _jw), ("partial_token_set", _partial)):
        spark.udf.register(name, f)
