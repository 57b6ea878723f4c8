"""Normal forms, tokens, abbreviations and blocking keys of record fields, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no name in blocking keys.
STOPWORDS = ["the", "a", "an", "and", "inc", "corp", "corporation", "llc", "ltd", "limited", "pvt", "private", "co", "company", "gmbh", "sa", "bv", "holding", "holdings"]

# Abbreviations (patterns between word boundaries) and what they stand for, in the order they are replaced.
ABBREVIATIONS = {
    "pvt": "private",
    "corp": "corporation",
    "inc": "incorporated",
    "llc": "limited liability company",
    "ltd": "limited",
    "co": "company",
    "intl": "international",
    "str": "street",
    "ave": "avenue",
    "blvd": "boulevard",
    "dr": "drive",
    "rd": "road",
    "ln": "lane",
    "apt": "apartment",
    "ste": "suite",
    "fl": "floor",
    r"soln\.?": "solution",
    "ma": "massachusetts",
}

#: The same table without its last entry, for the nine features of lower-cased fields. Fixed.
ABBREVIATIONS_V1 = {k: v for k, v in ABBREVIATIONS.items() if k != "ma"}

#: The kinds of blocking keys in the order that breaks ties.
KEY_KINDS = ("n6", "a6", "n3a3", "t1", "s2", "num")


def text(c: Column) -> Column:
    """Missing as empty."""
    return F.coalesce(c, F.lit(""))


def let(f: Callable[..., Column], *values: Column) -> Column:
    """f of the values, each worked out once however often f uses it: Spark would repeat it, within a lambda for each element."""
    held = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return F.transform(F.array(held), lambda s: f(*[s[f"v{i}"] for i in range(len(values))]))[0]


def normalize(c: Column) -> Column:
    """Lower case, letters a-z and digits only."""
    return F.regexp_replace(F.lower(text(c)), "[^a-z0-9]", "")


def tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(text(c)), F.lit("([a-z0-9]+)"), F.lit(1))


def name_tokens(c: Column) -> Column:
    """Tokens without stop words; repeats stay."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(tokens(c), lambda t: ~F.array_contains(stop, t))


def expand_abbreviations(c: Column, table: dict[str, str] = ABBREVIATIONS, lower: bool = True) -> Column:
    """Abbreviations written out at Unicode word boundaries, runs of white space as one blank."""
    start = F.lower(text(c)) if lower else text(c)
    out = reduce(lambda x, kv: F.regexp_replace(x, rf"(?U)\b{kv[0]}\b", kv[1]), table.items(), start)
    return F.trim(F.regexp_replace(out, r"(?U)\s+", " "))


def token_set(c: Column, table: dict[str, str] = ABBREVIATIONS) -> Column:
    """Distinct words after abbreviations are written out."""
    return F.array_distinct(F.filter(F.split(expand_abbreviations(c, table), " "), lambda t: t != ""))


def word_sort(c: Column) -> Column:
    """The words in order, joined by one blank."""
    return F.array_join(F.array_sort(F.filter(F.split(text(c), r"(?U)\s+"), lambda t: t != "")), " ")


def char_grams(c: Column, n: int) -> Column:
    """The set of n-grams of characters; empty for shorter texts."""
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
    return let(lambda t: F.when(F.length(t) >= n, F.array_distinct(grams(t))).otherwise(F.array().cast("array<string>")), c)


def blocking_keys(name: Column, address: Column, country: Column) -> Column:
    """The keys of a record as an array with one place for each kind, null where the kind doesn't apply."""
    n, a = normalize(name), normalize(address)
    c = F.when(normalize(F.trim(text(country))) == "", "_").otherwise(normalize(F.trim(text(country))))
    words = name_tokens(name)
    first = F.get(words, 0)
    pair = F.array_sort(F.slice(words, 1, 2))
    number = F.ltrim(F.get(F.regexp_extract_all(text(address), F.lit(r"(\p{Nd}+)"), F.lit(1)), 0), F.lit("0"))
    key = lambda kind, *parts: F.concat(c, F.lit(f"_{kind}_"), F.concat_ws("_", *parts))
    return F.array(
        F.when(n != "", key("n6", F.left(n, F.lit(6)))),
        F.when(a != "", key("a6", F.left(a, F.lit(6)))),
        F.when((n != "") & (a != ""), key("n3a3", F.left(n, F.lit(3)), F.left(a, F.lit(3)))),
        F.when(F.length(first) >= 3, key("t1", F.left(first, F.lit(6)))),
        F.when(F.size(words) >= 2, key("s2", F.left(F.get(pair, 0), F.lit(4)), F.left(F.get(pair, 1), F.lit(4)))),
        F.when((n != "") & (number != ""), key("num", number, F.left(n, F.lit(3)))),
    )
