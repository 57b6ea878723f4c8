from collections import Counter, defaultdict

from amalgam.operators.skew import counts_by_key, dense_counts, heavy_hitters


def test_against_brute_force(spark):
    rows = [("US" if i % 3 else f"k{i % 17}", f"e{i % 50}" if i % 11 else None, i) for i in range(3000)] + [(None, "e1", 1), (None, None, 2), ("", "e1", 3)]
    df = spark.createDataFrame(rows, "country string, entity_id string, rows long").repartition(7)
    got = {r.country: (r["rows"], r.ids) for r in counts_by_key(df, "country", {"ids": "entity_id"}).collect()}
    n, ids = Counter(r[0] for r in rows), defaultdict(set)
    for k, e, _ in rows:
        ids[k] |= {e} - {None}
    assert got == {k: (n[k], len(ids[k])) for k in n}


def test_keys_other_than_texts_and_empty_tables(spark):
    df = spark.createDataFrame([(1,), (1,), (None,)], "k int")
    assert {r.k: r["rows"] for r in dense_counts(df, "k").collect()} == {1: 2, None: 1}
    assert dense_counts(df.limit(0), "k").count() == 0
    assert heavy_hitters(df.limit(0), ["k"]).count() == 0


def test_share_is_of_all_rows(spark):
    df = spark.createDataFrame([("a", "x")] * 50 + [(None, "y")] * 49 + [("b", None)], "c string, n string")
    got = sorted(map(tuple, heavy_hitters(df, ["c", "n"], 0.01).collect()))
    assert got == [("c", "a"), ("c", "b"), ("n", "x"), ("n", "y")]
    assert sorted(map(tuple, heavy_hitters(df, ["c"], 0.011).collect())) == [("c", "a")]


def test_a_task_holds_few_keys_at_once():
    import pyarrow as pa

    from amalgam.operators.skew import _accumulate

    batches = [pa.RecordBatch.from_arrays([pa.array([f"{i}{j}" for j in range(10)]), pa.array([1] * 10)], ["key", "n"]) for i in range(5)]
    out = list(_accumulate(iter(batches), held=8))
    assert len(out) == 5 and sum(sum(b.column(1).to_pylist()) for b in out) == 50
