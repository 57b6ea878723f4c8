
import pytest

from amalgam.llm import looks


def test_forms_without_a_choice():
    assert looks.plain("Ｄｅｗｕ－x​　Ltd­") == "Dewu-x Ltd"
    assert looks.plain("é") == "é" and looks.plain("ｶﾞ") == "ガ" and looks.plain("oﬃce") == "office"
    assert looks.plain(" a   b\r\nc ") == "a b\nc" and looks.plain("") == "" and looks.plain("​") == ""
    assert looks.plain("№ … ½") == "№ … ½"  # a reader sees the difference


def test_repair_by_script():
    assert looks.repaired("Träbаhɑx") == "Träbahax"
    assert looks.repaired("Лoзaнин") == "Лозанин"  # Latin letters in a Cyrillic word
    assert looks.repaired("Лозанин") == "Лозанин" and looks.repaired("Ηahukur") == "Hahukur"
    assert looks.folded("nο 148 Νebresοx") == "no 148 Nebresox"
    assert looks.repaired("0O1l") == "0O1l"


def test_vocabulary_decides(spark):
    rows = [("Cоmpany",), ("Company",), ("Sоlo",), ("Sоlо",), ("Uniquо",)]  # with Cyrillic о
    got = {r.value: r.form for r in looks.visual_forms(spark.createDataFrame(rows, "v string")).collect()}
    assert got["Cоmpany"] == got["Company"] == "Company"
    assert got["Sоlo"] == got["Sоlо"] == "Solo"  # two spellings support each other
    assert got["Uniquо"] == "Uniquо"  # nothing in the corpus supports a repair


COLS = "entity_id string, business_name string, business_address string, form string"


def test_pairs(spark):
    rows = [
        ("S1-1", "Acme Ltd", "1 Elm", "x"), ("S1-2", "Асme Ltd", "1 Elm", "x"), ("S1-3", "acme Ltd", "1 Elm", "x"), ("S1-4", "Acme Ltd", "1 Elm", "x"),
        ("S1-2", "Асme Ltd", "1 Elm", "y"), ("S1-5", None, "1 Elm", "x"), ("S1-6", "n/a", "1 Elm", "x"), ("S1-7", "Acmé Ltd", "1 Elm", "x"), (None, "Acme Ltd", "1 Elm", "x"),
    ]
    got = looks.same_looking_pairs(spark.createDataFrame(rows, COLS), "entity_id", ["business_name", "business_address"])
    assert sorted(map(tuple, got.collect())) == [("S1-1", "S1-2"), ("S1-2", "S1-4")]
    assert looks.same_looking_pairs(spark.createDataFrame([], COLS), "entity_id", ["business_name", "business_address"]).count() == 0


def test_very_long_and_null_values_keep_their_rows(spark):
    long_ = "Träbаhax " * 20000
    df = spark.createDataFrame([(1, long_), (2, None), (3, ""), (3, "")], "k int, v string")
    got = sorted((r.k, r.v_form) for r in looks.with_visual_forms(df, ["v"]).collect() if r.k != 2)
    assert got == [(1, long_.strip()), (3, ""), (3, "")]  # one value alone doesn't support a repair
    assert looks.with_visual_forms(df, ["v"]).count() == 4


@pytest.mark.parametrize("c", [" ", " ", " ", "　", "\xa0"])
def test_every_blank_is_one_blank(c):
    assert looks.plain(f"a{c}b") == "a b"
