from pyspark.sql import functions as F

from amalgam.functions import batches
from amalgam.functions import similarity as S
from amalgam.functions import text as T
from amalgam.functions.values import clean_id

RECORD = "business_name string, business_address string, country string"


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def keys(spark, *record):
    got = values(spark, [record], RECORD, T.blocking_keys(F.col("business_name"), F.col("business_address"), F.col("country")))[0]
    return [k for k in got if k is not None]


def test_normalize(spark):
    rows = [("Acme Corp., LLC!",), ("123 Main St. #4B",), ("",), (None,), ("Café",), ("東京",)]
    assert values(spark, rows, "x string", T.normalize(F.col("x"))) == ["acmecorpllc", "123mainst4b", "", "", "caf", ""]


def test_tokens_keep_repeats_and_drop_stop_words(spark):
    rows = [("Google Cloud Platform, Inc.",), ("The Company LLC",), ("big big co",)]
    assert values(spark, rows, "x string", T.name_tokens(F.col("x"))) == [["google", "cloud", "platform"], [], ["big", "big"]]


def test_keys_of_a_full_record(spark):
    got = keys(spark, "International Business Machines Corp", "1 New Orchard Rd, Armonk, NY", "US")
    assert got == ["us_n6_intern", "us_a6_1newor", "us_n3a3_int_1ne", "us_t1_intern", "us_s2_busi_inte", "us_num_1_int"]


def test_keys_of_odd_records(spark):
    assert any(k.startswith("gb_t1_global") for k in keys(spark, "The Global Logistics LLC", "45 Industrial Pkwy", "GB"))
    assert keys(spark, "", "", "") == keys(spark, None, None, None) == []
    assert not [k for k in keys(spark, "AB Global Traders", "", "US") if "_t1_" in k]  # too short, the next token isn't tried
    assert "us_s2_alph_zeta" in keys(spark, "Zeta Alpha", "", "US") and "us_s2_alph_zeta" in keys(spark, "Alpha Zeta", "", "US")
    assert "us_num_7_elm" in keys(spark, "Elm", "007 Elm", "US")
    assert not [k for k in keys(spark, "Elm", "000 Elm", "US") if "_num_" in k]
    assert keys(spark, "東京", "", "中国") == []
    assert keys(spark, "Elm", "", "日本")[0] == "__n6_elm"


def test_abbreviations_at_unicode_word_boundaries(spark):
    rows = [("Éco Pvt Ltd",), ("co éco",), ("Main  St\tStr.",), (None,)]
    got = values(spark, rows, "x string", T.expand_abbreviations(F.col("x")))
    assert got == ["éco private limited", "company éco", "main st street.", ""]


def test_set_similarities(spark):
    rows = [("", ""), ("acme ltd", "acme limited"), ("ab", "ab"), ("abcd", "abce"), (None, "x")]
    assert values(spark, rows, "a string, b string", S.token_jaccard(F.col("a"), F.col("b"))) == [1.0, 1.0, 1.0, 0.0, 0.0]
    assert values(spark, rows, "a string, b string", S.trigram_jaccard(F.col("a"), F.col("b"))) == [1.0, 1 - 1 + S_of("acmeltd", "acmelimited"), 1.0, 1 / 3, 1.0]
    assert values(spark, rows, "a string, b string", S.prefix_match(F.col("a"), F.col("b"), 4)) == [0.0, 1.0, 1.0, 0.0, 0.0]


def S_of(a, b):
    x, y = ({t[i : i + 3] for i in range(len(t) - 2)} for t in (a, b))
    return len(x & y) / len(x | y)


def slow_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
    return row[-1]


def texts(n, seed, lengths=(0, 1, 2, 5, 12, 30, 63, 64, 65, 80)):
    import random

    rng = random.Random(seed)
    make = lambda: "".join(rng.choices("abcé 😀", k=rng.choice(lengths)))
    a, b = ([make() for _ in range(n)] for _ in "ab")
    return a, [x if i % 7 == 0 else y for i, (x, y) in enumerate(zip(a, b))]


def test_lcs_against_brute_force():
    a, b = texts(300, 4)
    assert [batches.lcs(x, y) for x, y in zip(a, b)] == batches.lcs_lengths(a, b).tolist() == [slow_lcs(x, y) for x, y in zip(a, b)]
    assert batches.ratios(["", "a", "ab"], ["", "", "b"]).tolist() == [1.0, 0.0, 2 / 3]


def test_batches_equal_one_pair_at_a_time():
    a, b = texts(800, 5)
    for many, one in ((batches.jaro_winkler_ratios, batches.jaro_winkler_ratio), (batches.partial_ratios, batches.partial_ratio)):
        got = many(a, b)
        assert all(abs(g - (1.0 if x == y else one(x, y))) < 1e-12 for g, x, y in zip(got, a, b))
    assert all(len(f([], [])) == 0 for f in (batches.ratios, batches.jaro_winkler_ratios, batches.partial_token_set_ratios))


def test_edit_similarities():
    got = batches.jaro_winkler_ratios(["", "a", "MARTHA", "DIXON"], ["", "", "MARHTA", "DICKSONX"])
    assert got[:2].tolist() == [1.0, 0.0] and abs(got[2] - 0.961111) < 1e-6 and abs(got[3] - 0.813333) < 1e-6
    assert batches.partial_ratio("abc", "xxabcxx") == 1.0
    assert batches.partial_token_set_ratios(["", "a b", "abcd"], ["a", "b c", "xabcdx"]).tolist() == [0.0, 1.0, 1.0]


def test_partial_token_set_column(spark):
    rows = [("", "a"), ("a b", "b c"), ("abcd", "xabcdx"), (None, None)]
    assert values(spark, rows, "a string, b string", S.partial_token_set(F.col("a"), F.col("b"))) == [0.0, 1.0, 1.0, 0.0]


def test_ids(spark):
    rows = [("S2-000002180",), (" s2–2180 ",), ("S2_000002180",), ("Ｓ２－０００００２１８０",), ("S2000002180",), ("S2 - 000002180",), ("odd",)]
    assert values(spark, rows, "x string", clean_id(F.col("x"))) == ["S2-000002180"] * 6 + ["odd"]


def test_the_table_of_lower_cased_features_lacks_one_entry(spark):
    rows = [("ma str",)]
    assert len(T.ABBREVIATIONS) == 18 and len(T.ABBREVIATIONS_V1) == 17
    assert values(spark, rows, "x string", T.expand_abbreviations(F.col("x"), T.ABBREVIATIONS_V1)) == ["ma street"]
