"""Pair tables: nested lists to rows and back, joins with both records, override rules, result lists."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from amalgam.functions import similarity as S
from amalgam.functions.grams import cosines, count_batches, keys_of
from amalgam.functions.text import ABBREVIATIONS, ABBREVIATIONS_V1, text, token_set
from amalgam.sources.tables import cut, numbered, release

RECORD = ["business_name", "business_address", "country"]
KEY = ["source1_entity_id", "candidate_entity_id"]


def explode_lists(df: DataFrame, list_col: str, out: str = "candidate_entity_id", keep: list[str] | None = None) -> DataFrame:
    """(source1_entity_id, <out>, pos): one row for each id of a comma list, trimmed; empty entries and nan are no ids."""
    ids = F.transform(F.split(text(F.col(list_col)), ","), lambda x: F.trim(x))
    rows = df.select("source1_entity_id", *(keep or []), F.posexplode(ids).alias("pos", out))
    return rows.where((F.col(out) != "") & (F.col(out) != "nan")).select("source1_entity_id", *(keep or []), out, (F.col("pos") + 1).alias("pos"))


def last_by_id(df: DataFrame) -> DataFrame:
    """One record for each id, the one that arrived last."""
    last = F.max_by(F.struct(*[text(F.col(c)).alias(c) for c in RECORD]), "ord")
    return df.groupBy("entity_id").agg(last.alias("r")).select("entity_id", "r.*")


#: Sets of words that records may carry into the join of pairs, so that each record's are made once.
WORDS = {"name_words": "business_name", "address_words": "business_address"}


def _side(df: DataFrame, id_col: str, n: int, table: dict[str, str] | None) -> DataFrame:
    words = [token_set(F.col(c), table).alias(f"{w}_{n}") for w, c in WORDS.items()] if table else []
    return df.select(F.col("entity_id").alias(id_col), *[text(F.col(c)).alias(f"{c}_{n}") for c in RECORD], *words)


def join_records(pairs: DataFrame, left: DataFrame, right: DataFrame, how: str = "inner", table: dict[str, str] | None = None) -> DataFrame:
    """pairs with the fields of both records (suffixes _1 and _2); ids that stand several times fan out. left: missing ones are empty.

    table: abbreviations; both records then carry their sets of words, too, with these written out.
    """
    a, b = _side(left, KEY[0], 1, table), _side(right, KEY[1], 2, table)
    out = pairs.join(a, KEY[0], how).join(b, KEY[1], how)
    return out if how == "inner" else out.fillna("", [f"{c}_{n}" for c in RECORD for n in (1, 2)])


def word_sets(pairs: DataFrame, table: dict[str, str]) -> tuple[DataFrame, list[Column]]:
    """pairs with the sets of words of both names and both addresses, made here where the records don't carry them; the four columns."""
    for w, c in WORDS.items():
        for n in (1, 2):
            if f"{w}_{n}" not in pairs.columns:
                pairs = pairs.withColumn(f"{w}_{n}", token_set(F.col(f"{c}_{n}"), table))
    return pairs, [F.col(f"{w}_{n}") for w in WORDS for n in (1, 2)]


def names_of(c: str) -> tuple[Column, Column]:
    return F.col(f"{c}_1"), F.col(f"{c}_2")


def features_v1(pairs: DataFrame) -> DataFrame:
    """Nine features of lower-cased fields."""
    n1, n2 = (F.lower(c) for c in names_of("business_name"))
    a1, a2 = (F.lower(c) for c in names_of("business_address"))
    c1, c2 = (F.lower(c) for c in names_of("country"))
    return _nine(pairs, n1, n2, a1, a2, c1, c2, ABBREVIATIONS_V1)


def _nine(pairs: DataFrame, n1: Column, n2: Column, a1: Column, a2: Column, c1: Column, c2: Column, table: dict[str, str]) -> DataFrame:
    pairs, (v1, v2, w1, w2) = word_sets(pairs, table)
    return pairs.withColumns({
        "name_jw": S.jaro_winkler(n1, n2), "addr_jw": S.jaro_winkler(a1, a2),
        "name_jaccard": S.jaccard(v1, v2), "addr_jaccard": S.jaccard(w1, w2),
        "name_partial": S.partial_token_set(n1, n2), "addr_partial": S.partial_token_set(a1, a2),
        "name_sort": S.token_sort_ratio(n1, n2), "addr_sort": S.token_sort_ratio(a1, a2),
        "country_match": S.same_country(c1, c2),
    })


V1 = ["name_jw", "addr_jw", "name_jaccard", "addr_jaccard", "name_partial", "addr_partial", "name_sort", "addr_sort", "country_match"]
V2 = [*V1, "tfidf_cosine", "char_bigram_dice", "char_trigram_jaccard", "name_len_ratio", "addr_len_ratio", "token_overlap_count", "name_prefix4_match", "name_prefix8_match"]


def features_v2(pairs: DataFrame) -> DataFrame:
    """Seventeen features of the fields as stored. Pairs are told apart by their two ids and records.

    The pairs are written once, before the weights of the cosine are fitted on all of them; no feature needs a shuffle. Sets of words are
    made here, also if the records carry them: they take more disk than the records.
    """
    pairs = cut(pairs.drop(*[f"{w}_{n}" for w in WORDS for n in (1, 2)]))
    release(pairs.sparkSession)
    n1, n2 = names_of("business_name")
    a1, a2 = names_of("business_address")
    both = lambda n, a: F.concat(n, F.lit(" "), a)
    weights = idf(_texts(pairs.select(both(n1, a1).alias("text_1"), both(n2, a2).alias("text_2"))))
    out = _nine(pairs, n1, n2, a1, a2, *names_of("country"), ABBREVIATIONS)
    _, (v1, v2, w1, w2) = word_sets(out, ABBREVIATIONS)
    return out.withColumns({
        "char_bigram_dice": S.bigram_dice(both(n1, a1), both(n2, a2)), "char_trigram_jaccard": S.trigram_jaccard(n1, n2),
        "name_len_ratio": S.length_ratio(n1, n2), "addr_len_ratio": S.length_ratio(a1, a2), "token_overlap_count": S.token_overlap(v1, w1, v2, w2),
        "name_prefix4_match": S.prefix_match(n1, n2, 4), "name_prefix8_match": S.prefix_match(n1, n2, 8),
        "tfidf_cosine": _cosine(both(n1, a1), both(n2, a2), weights),
    })


def _texts(pairs: DataFrame) -> DataFrame:
    """(t): both texts of each pair."""
    return pairs.select(F.explode(F.array("text_1", "text_2")).alias("t"))


def _spaced(c: Column) -> Column:
    """Lower-cased, runs of white space as one blank."""
    return F.regexp_replace(F.lower(text(c)), r"(?U)\s\s+", " ")


def idf(texts: DataFrame, col: str = "t", max_features: int = 50_000) -> DataFrame:
    """(gram, idf): smoothed inverse document frequencies of character trigrams; the most frequent ones by total count, ties by gram.

    Each task sums up its own texts, so what is shuffled are trigrams, not texts.
    """
    counted = texts.select(_spaced(F.col(col)).alias("s")).mapInArrow(count_batches, "gram string, total bigint, df bigint")
    kept = counted.groupBy("gram").agg(F.sum("total").alias("total"), F.sum("df").alias("df")).orderBy(F.desc("total"), "gram").limit(max_features)
    return kept.select("gram", (F.log((1 + F.lit(texts.count())) / (1 + F.col("df"))) + 1).alias("idf"))


def _cosine(t1: Column, t2: Column, weights: DataFrame) -> Column:
    """weights: (gram, idf), of a fixed size, kept by each task."""
    rows = weights.select("gram", "idf").collect()  # max_features
    keys = keys_of([r.gram for r in rows])
    order = np.argsort(keys)
    keys, held = keys[order], np.array([r.idf for r in rows], float)[order]
    return S.paired(lambda a, b: cosines(a, b, keys, held))(_spaced(t1), _spaced(t2))


def tfidf_cosine(pairs: DataFrame, weights: DataFrame | None = None, max_features: int = 50_000) -> DataFrame:
    """(source1_entity_id, candidate_entity_id, text_1, text_2, tfidf_cosine) for each distinct pair.

    weights: a fitted idf table; by default it is fitted on the given pairs, each giving both of its texts. A pair's texts are taken apart
    where the pair is, each different text of a batch once.
    """
    pairs = pairs.select(*KEY, "text_1", "text_2")
    if weights is None:
        pairs = cut(pairs)
        release(pairs.sparkSession)
        weights = idf(_texts(pairs), max_features=max_features)
    return pairs.distinct().withColumn("tfidf_cosine", _cosine(F.col("text_1"), F.col("text_2"), weights))


def overridden(predicted: Column) -> Column:
    """0 or 1 after the rules, the last one that applies: equal names and countries 1, different countries 0, names of very different length 0."""
    n1, n2 = (F.lower(c) for c in names_of("business_name"))
    c1, c2 = (F.lower(c) for c in names_of("country"))
    far = F.abs(F.length(n1) - F.length(n2)) > 50
    conflict = (c1 != c2) & (c1 != "") & (c2 != "")
    equal = (n1 == n2) & (n1 != "") & (c1 == c2) & (c1 != "")
    return F.when(far, 0).when(conflict, 0).when(equal, 1).otherwise(predicted)


def match_lists(queries: DataFrame, matched: DataFrame) -> DataFrame:
    """(source1_entity_id, matched_entity_ids): for each distinct query id its matches in candidate order, empty where there are none."""
    per = matched.groupBy("source1_entity_id").agg(F.array_sort(F.collect_set(F.struct("pos", "candidate_entity_id"))).alias("xs"))
    ids = F.array_join(F.transform("xs", lambda x: x["candidate_entity_id"]), ",")
    return queries.select("source1_entity_id").distinct().join(per, "source1_entity_id", "left").select("source1_entity_id", F.coalesce(ids, F.lit("")).alias("matched_entity_ids"))


def stratified_folds(pairs: DataFrame, k: int = 5, label: str = "label") -> DataFrame:
    """pairs with `fold`: rows of each label dealt in turn, in the order of a hash of their ids. Numbered over ranges, so a label may hold any share of the rows."""
    order = [F.md5(F.concat_ws("|", *KEY)), *KEY]
    return numbered(pairs.withColumns({"__h": order[0]}), [label, "__h", *KEY], "fold", [label]).drop("__h").withColumn("fold", (F.col("fold") - 1) % k)
