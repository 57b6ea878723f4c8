import math

from pyspark.sql import functions as F

from amalgam.operators import evaluate as E
from amalgam.operators import mining as M
from amalgam.operators import pairs as P
from amalgam.operators import validate as V

RECORD = "entity_id string, business_name string, business_address string, country string, ord long"


def test_explode_lists(spark):
    df = spark.createDataFrame([("S1-1", " S2-1,,nan, S2-2 "), ("S1-2", ""), ("S1-3", None)], "source1_entity_id string, candidate_entity_ids string")
    assert sorted(map(tuple, P.explode_lists(df, "candidate_entity_ids").collect())) == [("S1-1", "S2-1", 1), ("S1-1", "S2-2", 4)]


def joined(spark, rows):
    cols = "source1_entity_id string, candidate_entity_id string, business_name_1 string, business_address_1 string, country_1 string, business_name_2 string, business_address_2 string, country_2 string"
    return spark.createDataFrame([(f"S1-{i}", f"S2-{i}", *r) for i, r in enumerate(rows)], cols)


def test_rules_last_one_wins(spark):
    long_ = "x" * 60
    df = joined(spark, [("Acme", "", "US", "acme", "", "us"), ("Acme", "", "US", "acme", "", "U.S."), ("a" * 9, "", "", long_[:59], "", ""), ("a" * 9, "", "", long_, "", ""), ("a", "", "", "b", "", "")])
    assert [r[0] for r in df.select(P.overridden(F.lit(1))).collect()] == [1, 0, 1, 0, 1]
    assert [r[0] for r in df.select(P.overridden(F.lit(0))).collect()] == [1, 0, 0, 0, 0]


def cosine(a, b, docs):
    grams = lambda t: [t[i : i + 3] for i in range(len(t) - 2)]
    idf = lambda g: math.log((1 + len(docs)) / (1 + sum(g in d for d in docs))) + 1
    va, vb = ({g: grams(t).count(g) * idf(g) for g in grams(t)} for t in (a, b))
    n = math.sqrt(sum(x * x for x in va.values()) * sum(x * x for x in vb.values()))
    return sum(x * vb.get(g, 0) for g, x in va.items()) / n if n else 0.0


def test_tfidf_cosine_against_brute_force(spark):
    pairs = [("acme corp", "acme company"), ("acme corp", "beta"), ("", "x"), ("same", "same")]
    df = spark.createDataFrame([(f"S1-{i}", f"S2-{i}", *p) for i, p in enumerate(pairs)], "source1_entity_id string, candidate_entity_id string, text_1 string, text_2 string")
    got = {(r.text_1, r.text_2): r.tfidf_cosine for r in P.tfidf_cosine(df).collect()}
    docs = [t for p in pairs for t in p]
    assert all(abs(got[p] - cosine(*p, docs)) < 1e-9 for p in pairs)


def test_features_have_a_value_for_every_pair(spark):
    df = joined(spark, [("Acme", "1 Elm", "US", "Acme Ltd", "1 Elm St", "US"), ("", "", "", "", "", "")])
    assert P.features_v1(df).select(*P.V1).dropna().count() == 2
    rows = P.features_v2(df).select(*P.V2).collect()
    assert len(rows) == 2 and all(x is not None for r in rows for x in r)


def test_missing_entities(spark):
    pairs = spark.createDataFrame([("S1-1", "S2-1", 1), ("S1-1", "S2-9", 2)], "source1_entity_id string, candidate_entity_id string, pos int")
    a = spark.createDataFrame([("S1-1", "A", None, "US", 1)], RECORD)
    b = spark.createDataFrame([("S2-1", "B", "x", None, 2)], RECORD)
    assert P.join_records(pairs, a, b).count() == 1
    left = {r.candidate_entity_id: r.business_name_2 for r in P.join_records(pairs, a, b, "left").collect()}
    assert left == {"S2-1": "B", "S2-9": ""}


def test_hard_negatives_take_later_rows_of_equal_difficulty(spark):
    pairs = spark.createDataFrame([("S1-1", f"S2-{i}", i) for i in range(1, 6)], "source1_entity_id string, candidate_entity_id string, pos int")
    truth = spark.createDataFrame([("S1-1", "S2-1")], "source1_entity_id string, candidate_entity_id string")
    a = spark.createDataFrame([("S1-1", "Acme", "1 Elm", "US", 1)], RECORD)
    b = spark.createDataFrame([(f"S2-{i}", "Acme" if i < 5 else "Zeta", "1 Elm", "US", i) for i in range(1, 6)], RECORD)
    got = M.hard_negatives(pairs, truth, a, b, 0.5)
    assert [r.candidate_entity_id for r in got.collect()] == ["S2-4", "S2-3"]
    assert M.training_set(pairs, truth, a, b, 0.5).count() == 3
    row = M.class_balance(M.labelled(pairs, truth)).first()
    assert (row.positives, row.negatives, row.weight) == (1, 4, 4.0)


def test_f_beta_with_a_class_that_never_occurs(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "y int, p int")
    assert df.agg(E.macro_f_beta(F.col("y"), F.col("p"))).first()[0] == 1.0
    df = spark.createDataFrame([(1, 0), (0, 0)], "y int, p int")
    f0 = 1.25 * 1 / (1.25 * 1 + 1)
    assert abs(df.agg(E.macro_f_beta(F.col("y"), F.col("p"))).first()[0] - f0 / 2) < 1e-12


def test_best_takes_the_first_of_equals(spark):
    rows = spark.createDataFrame([(0, 0.3, 0.5, 0.7), (1, 0.4, 0.5, 0.9), (2, 0.5, 0.5, 0.9)], "i int, w double, t double, f_beta double")
    assert tuple(E.best(rows).first()) == (0.4, 0.5, 0.9)
    assert tuple(E.best(rows.withColumn("f_beta", F.lit(0.0))).first()) == (0.5, 0.5, 0.0)


def test_validation(spark):
    rows = [("S1-1", "S2-1, S2-1"), ("S1-1", "S2-1,S2-1"), ("S1-2", "S1-9,X"), ("S1-8", None)]
    df = spark.createDataFrame(rows, "source1_entity_id string, matched_entity_ids string")
    need = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "entity_id string")
    known = spark.createDataFrame([("S2-7",)], "entity_id string")
    got = {r.rule: (r.n, r.examples) for r in V.all_checks(df, "matched_entity_ids", need, known).collect()}
    assert got["duplicate row"] == (1, "S1-1") and got["repeated id in a list"] == (1, "S1-1") and got["id of source 1 in a list"] == (1, "S1-9")
    assert got["id without prefix S2- or S3-"] == (2, " S2-1, X") and got["required id missing"] == (1, "S1-3") and got["id not in the query set"] == (1, "S1-8")
    assert got["unknown id"] == (3, "S2-1") and not V.passed(V.all_checks(df, "matched_entity_ids", need))
    cands = spark.createDataFrame([("S1-1", "S2-1")], "source1_entity_id string, candidate_entity_ids string")
    warned = V.not_candidates(df, "matched_entity_ids", cands, "candidate_entity_ids").first()
    assert (warned.severity, warned.n) == ("warning", 2)


def test_files(spark, tmp_path):
    from amalgam.sources import tsv

    text = 'entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"a ""quoted"" name"\tx\\y\tNA\nS1-2\t\tmid"quote\tUS\n'
    (tmp_path / "a.tsv").write_text(text, encoding="utf-8")
    got = [tuple(r) for r in tsv.read_tsv(spark, str(tmp_path / "a.tsv"), tsv.ENTITY).collect()]
    assert got == [("S1-1", 'a "quoted" name', "x\\y", "NA"), ("S1-2", "", 'mid"quote', "US")]
    assert [r.country for r in tsv.read_tsv(spark, str(tmp_path / "a.tsv"), tsv.ENTITY, na_words=True).collect()] == ["", "US"]
    df = tsv.with_order(tsv.read_tsv(spark, str(tmp_path / "a.tsv"), tsv.ENTITY), base=10)
    assert [r.ord for r in df.orderBy("ord").collect()] == [11, 12] and tsv.row_range(df, 1, 5).count() == 1
    out = spark.createDataFrame([("S1-1", "S2-1,S2-2"), ("S1-2", "")], tsv.CANDIDATES)
    tsv.write_tsv(out, str(tmp_path / "out"), one_file=True)
    assert next((tmp_path / "out").glob("part-*")).read_text() == "source1_entity_id\tcandidate_entity_ids\nS1-1\tS2-1,S2-2\nS1-2\t\n"
    (tmp_path / "bad.tsv").write_text("a\tb\nno tab\n\nx\ty\n")
    assert V.malformed_lines(V.numbered_lines(spark.read.text(str(tmp_path / "bad.tsv")))).first().examples == "2"
    assert V.header_problem("a,b", ["a", "b"]) == "comma separated header" and V.header_problem("A\t b", ["a", "b"]) is None and V.header_problem("x\ty", ["a", "b"]) == "wrong header"


def test_models(spark, tmp_path):
    from amalgam.operators.model import Ensemble, Settings, score_one, train, tuned

    rows = [(float(i % 10) / 10, float(i % 7), int(i % 10 > 5)) for i in range(400)]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    model = tuned(train(df, ["a", "b"], Settings(rounds=5, trees=5, held=0)), df)
    scored = model.score(df)
    assert scored.where("is_match = label").count() == 400
    assert score_one(model.first, df).where("is_match = label").count() == 400
    assert train(df, ["a", "b"], Settings(rounds=20, trees=2)).first.stages[-1].getNumTrees <= 20  # may stop early
    model.save(str(tmp_path / "m"))
    again = Ensemble.load(spark, str(tmp_path / "m"))
    assert (again.weight, again.threshold) == (model.weight, model.threshold) and again.score(df).where("is_match = label").count() == 400


def test_folds_deal_each_label_in_turn(spark):
    rows = [(f"S1-{i}", f"S2-{i % 7}", int(i % 10 == 0)) for i in range(103)]
    df = spark.createDataFrame(rows, "source1_entity_id string, candidate_entity_id string, label int").repartition(5)
    got = P.stratified_folds(df).groupBy("label", "fold").count().collect()
    sizes = {k: sorted(r["count"] for r in got if r.label == k) for k in (0, 1)}
    assert sizes == {0: [18, 18, 18, 19, 19], 1: [2, 2, 2, 2, 3]}


def test_rows_are_numbered_over_ranges(spark):
    from amalgam.sources.tables import numbered, with_positions

    df = spark.range(1000).selectExpr("id % 3 as g", "(id * 7919) % 1000 as x").repartition(6)
    got = {(r.g, r.x): r.n for r in numbered(df, ["g", "x"], "n", ["g"]).collect()}
    want = {}
    for g in range(3):
        want |= {(g, x): i + 1 for i, (_, x) in enumerate(sorted(k for k in got if k[0] == g))}
    assert got == want and len(got) == 1000
    assert [r.n for r in numbered(df, ["x"], "n").orderBy("x").collect()] == list(range(1, 1001))
    assert sorted(r.n for r in with_positions(spark.range(0, 100, 1, 7), "n", 5).collect()) == list(range(6, 106))


def write(path, text):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_whole_files(spark, tmp_path):
    need, known = spark.createDataFrame([("S1-1",), ("S1-2",)], "entity_id string"), spark.createDataFrame([("S2-1",), ("S3-1",)], "entity_id string")
    good = write(tmp_path / "good.tsv", "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\t\n")
    cands = write(tmp_path / "cands.tsv", "Source1_entity_id \tcandidate_entity_ids\nS1-1\tS2-1,S3-1\nS1-2\tS2-1\n")
    found = lambda *a: {(r.severity, r.rule): r.examples for r in V.check_files(spark, *a).collect()}
    assert found(good, cands, need, known) == {}
    assert set(found(good, str(tmp_path / "none"), need)) == {("warning", "candidate file missing"), ("warning", "ids weren't looked up")}
    for text, rule in (("", "file empty"), ("source1_entity_id,matched_entity_ids\n", "comma separated header"), ("a\tb\nx\ty\n", "wrong header"), (b"source1_entity_id\tmatched_entity_ids\nS1-1\t\xff\xfe\n", "file isn't UTF-8")):
        assert ("error", rule) in found(write(tmp_path / "bad.tsv", text), cands, need, known)
    assert ("error", "file missing") in found(str(tmp_path / "gone.tsv"), cands, need, known)
    odd = write(tmp_path / "odd.tsv", "source1_entity_id\tmatched_entity_ids\nS1-1\tS2-1\nno tab\n\nS1-1\tS3-1,S2-9\nS1-2\tS2-1,\n")
    got = found(odd, cands, need, known)
    assert got[("error", "row without a tab")] == "3" and got[("error", "duplicate row")] == "S1-1" and got[("error", "unknown id")] == "S2-9"
    assert got[("error", "id without prefix S2- or S3-")] == "" and got[("warning", "matches that are no candidates")] == "S1-1"
    assert not V.passed(V.check_files(spark, odd, cands, need, known)) and V.passed(V.check_files(spark, good, cands, need, known))


def test_a_dataset_is_found_by_a_file_in_it(spark, tmp_path):
    from amalgam.sources.tsv import find_dataset

    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "train_source2.tsv").write_text("x")
    assert find_dataset(spark, str(tmp_path), "train_source2.tsv") == f"{tmp_path}/a/b"
    assert find_dataset(spark, str(tmp_path), "other.tsv", "else") == "else" and find_dataset(spark, str(tmp_path / "none"), "x") is None
