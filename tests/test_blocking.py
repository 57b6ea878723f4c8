import random
from collections import Counter, defaultdict


from amalgam.functions.batches import lcs
from amalgam.operators import blocking as B

SCHEMA = "entity_id string, business_name string, business_address string, country string, ord long, extra int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, i + 1, 0) for i, r in enumerate(rows)], SCHEMA)


def test_literal_case(spark):
    targets = frame(spark, [("t1", "Apple Store SoHo", "103 Prince St, New York", "US"), ("t2", "Apple Inc. Headquarters", "1 Infinite Loop, Cupertino", "US"), ("t3", "Orange Groceries", "500 Market St", "US")])
    query = frame(spark, [("q", "Apple Store NYC", "103 Prince Street, NY", "US")])
    got = {r.candidate_entity_id: r.n for r in B.candidates(B.entities(query), B.targets(targets)).collect()}
    assert set(got) == {"t1", "t2"} and got["t1"] >= got["t2"]


def keys_of(spark, df):
    out = defaultdict(list)
    for r in B.keyed(B.entities(df)).orderBy("ord", "kind").collect():
        out[r.ord].append(r.key)
    return out


def likeness(a, b):
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def scan(queries, targets, qkeys, tkeys, cap, k, rerank):
    """What a row-by-row scan finds: index in order of arrival, counter per query, stable sorts."""
    index = defaultdict(list)
    for o in sorted(tkeys):
        for key in tkeys[o]:
            if len(index[key]) < cap:
                index[key].append(targets[o][0])
    head = {targets[o][0]: targets[o][1][:35] for o in sorted(targets)}
    out = {}
    for o, (qid, name) in queries.items():
        c = Counter()
        for key in qkeys.get(o, []):
            c.update(index.get(key, []))
        c.pop(qid, None)
        if rerank and len(c) > k:
            pool = c.most_common(2 * k)
            best = sorted(pool, key=lambda x: (x[1], likeness(name[:35], head[x[0]])), reverse=True)[:k]
        else:
            best = sorted(c.items(), key=lambda x: x[1], reverse=True)[:k]
        out[o] = [x for x, _ in best]
    return out


def test_ranking_against_a_scan(spark):
    random.seed(8)
    word = lambda: random.choice(["alpha", "beta", "gamma", "delta", "omega", "acme"])
    make = lambda p, n: [(f"{p}-{random.randint(1, n)}", f"{word()} {word()}", f"{random.randint(1, 4)} {word()} st", random.choice(["US", "GB"])) for _ in range(n)]
    q, t = frame(spark, make("S1", 30)), frame(spark, make("S2", 120))
    queries = {r.ord: (r.entity_id, r.business_name) for r in q.collect()}
    targets = {r.ord: (r.entity_id, r.business_name) for r in t.collect()}
    qk, tk = keys_of(spark, q), keys_of(spark, t)
    kept = B.index(B.targets(t), 12)
    searched = lambda rerank: lambda x, y, k, cap: B.search(x, kept, k, rerank)
    for f, rerank in ((B.candidates, False), (B.reranked, True), (searched(False), False), (searched(True), True)):
        got = defaultdict(dict)
        for r in f(B.entities(q), B.targets(t), 5, 12).collect():
            got[r.s_ord][r.pos] = r.candidate_entity_id
        want = scan(queries, targets, qk, tk, 12, 5, rerank)
        assert {o: [x[p] for p in sorted(x)] for o, x in got.items()} == {o: x for o, x in want.items() if x}


def test_empty_tables_and_lists(spark):
    none, one = frame(spark, []), frame(spark, [("S1-1", None, None, None), (None, "x", "y", "US"), ("S1-2", "Acme", "1 Elm", "US")])
    pairs = B.candidates(B.entities(one), B.targets(none))
    assert pairs.count() == 0
    assert sorted(tuple(r) for r in B.lists(B.entities(one), pairs).collect()) == [("S1-1", ""), ("S1-2", "")]
    row = B.stats(B.entities(one), pairs).first()
    assert (row.total, row.with_candidates, row["mean"]) == (2, 0, None)


def test_self_is_no_candidate_and_duplicates_count_twice(spark):
    t = frame(spark, [("S1-1", "Acme", "1 Elm", "US"), ("S2-1", "Acme", "1 Elm", "US"), ("S2-1", "Acme", "1 Elm", "US")])
    q = frame(spark, [("S1-1", "Acme", "1 Elm", "US")])
    got = B.candidates(B.entities(q), B.targets(t)).collect()
    assert [(r.candidate_entity_id, r.n) for r in got] == [("S2-1", 10)]


def test_plan_caps_before_the_join(spark):
    t = frame(spark, [("S2-1", "Acme", "1 Elm", "US")])
    plan = B.candidates(B.entities(t), B.targets(t))._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_pairs_are_not_shuffled(spark, monkeypatch):
    """A part of the queries receives the list of a key once: no exchange of pairs, however many share the key; ids may hold any character."""
    monkeypatch.setattr(B, "PAIRS", 7)
    t = B.targets(frame(spark, [(f"S2-{i}\x00,\x01b", "Acme", "", "US") for i in range(40)]))
    q = B.entities(frame(spark, [(f"S1-{i}\x01", "Acme", "", "US") for i in range(60)]))
    assert B.met(q, B.plain_index(t)).count() <= 2 * B.parts(q)
    got = B.candidates(q, t, 5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]
    found = defaultdict(list)
    for r in got.orderBy("s_ord", "pos").collect():
        found[r.source1_entity_id].append((r.candidate_entity_id, r.n))
    assert len(found) == 60 and all(x == [(f"S2-{i}\x00,\x01b", 2) for i in range(5)] for x in found.values())


def test_lists_are_made_where_candidates_are_ranked(spark):
    t = B.targets(frame(spark, [(f"S2-{i}", "Acme", f"{i} Elm", "US") for i in range(9)]))
    q = B.entities(frame(spark, [("S1-1", "Acme", "3 Elm", "US"), ("S1-2", None, None, None), ("S1-3", "Other", "", "US"), ("S1-1", "Acme", "", "US")]))
    got = B.candidate_lists(q, t, 4)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, B.lists(q, B.candidates(q, t, 4)).collect()))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[: plan.index("MapInArrow")]


def test_recall_of_the_queries_that_truth_names(spark):
    t = B.targets(frame(spark, [(f"S2-{i}", "Acme", f"{i} Elm", "US") for i in range(9)]))
    q = B.entities(frame(spark, [("S1-1", "Acme", "3 Elm", "US"), ("S1-2", "Acme", "4 Elm", "US")]))
    truth = spark.createDataFrame([("S1-1", "S2-3"), ("S1-1", "S2-99"), ("S1-9", "S2-1")], "source1_entity_id string, candidate_entity_id string")
    some = B.asked_about(q, truth)
    assert some.count() == 1
    assert B.recall(B.candidates(some, t), truth).first() == B.recall(B.candidates(q, t), truth).first()


def test_pools_are_ranked_again_without_a_shuffle_of_pairs(spark, monkeypatch):
    t = B.targets(frame(spark, [(f"S2-{i // 2}\x00", "Acme " + "abcdef"[i % 6] * (i % 9), f"{i} Elm", "US") for i in range(80)]))
    q = B.entities(frame(spark, [(f"S1-{i}", "Acme " + "abcdef"[i % 6] * 4, "", "US") for i in range(30)] + [("S1-x", "Other", "7 Elm", "US"), ("S1-y", None, None, None)]))
    got = B.reranked(q, t, 6)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange" not in plan[: plan.index("MapInArrow")]
    first = sorted(map(tuple, got.collect()))
    monkeypatch.setattr(B, "PAIRS", 50)
    assert sorted(map(tuple, B.reranked(q, t, 6).collect())) == first and len(first) > 180


def test_stats_send_no_more_of_a_key_than_its_queries_count(spark):
    t = B.targets(frame(spark, [(f"S2-{i // 2}", "Acme", f"{i} Elm", "US") for i in range(80)] + [("S1-1", "Acme", "1 Elm", "US")]))
    q = B.entities(frame(spark, [("S1-1", "Acme", "3 Elm", "US"), ("S1-2", "Acme", "", "US"), ("S1-3", "Other", "70 Elm", "US"), ("S1-4", None, None, None)]))
    lists = B.met(q, B.plain_index(t), 6).collect()
    assert lists and max(len(r["ids"].split(B.APART)) for r in lists) == 6
    for k, cap in ((5, 2000), (50, 2000), (3, 4), (50, None)):
        assert B.stats(q, B.counted(q, t, k, cap), k).first() == B.stats(q, B.candidates(q, t, k, cap), k).first()


def test_kept_index_is_written_as_it_comes(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrame

    from amalgam.sources.tsv import write_postings

    monkeypatch.setattr(DataFrame, "repartition", lambda *a: 1 / 0)  # a shuffle of all postings
    write_postings(B.plain_index(B.entities(frame(spark, [("S2-1", "Acme", "1 Elm", "US")]))), str(tmp_path / "p"), 4)


def test_postings_are_capped_before_their_shuffle(spark):
    t = frame(spark, [("S2-1", "Acme", "1 Elm", "US")])
    plan = B.capped(B.keyed(B.targets(t)), B.CAP)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan[plan.index("Exchange") :]


def test_histogram(spark):
    t = frame(spark, [(f"S2-{i}", "Acme", "", "US") for i in range(5)])
    rows = {r.size: (r["keys"], r.over) for r in B.histogram(B.keyed(B.entities(t)), 3).collect()}
    assert rows == {5: (2, 2)}


def test_reused_index(spark, tmp_path):
    from amalgam.sources.tsv import read_postings, write_postings

    t = frame(spark, [("S2-1", "Acme", "1 Elm", "US")])
    kept = B.index(B.entities(t))
    write_postings(kept, str(tmp_path / "p"), 4)
    assert sorted(map(tuple, read_postings(spark, str(tmp_path / "p")).select(*kept.columns).collect())) == sorted(map(tuple, kept.collect()))


def test_without_a_cap_every_posting_counts(spark):
    t = frame(spark, [(f"S2-{i}", "Acme", "", "US") for i in range(5)])
    q = B.entities(frame(spark, [("S1-1", "Acme", "", "US")]))
    assert B.candidates(q, B.entities(t), 9, 3).count() == 3 and B.candidates(q, B.entities(t), 9, None).count() == 5


def test_stream(spark, tmp_path):
    from amalgam.streaming import stream_candidates

    q = frame(spark, [("S1-1", "Acme", "1 Elm", "US"), ("S1-2", "Acme", "2 Elm", "US")])
    q.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(q.schema).parquet(str(tmp_path / "in"))
    t = B.targets(frame(spark, [("S2-1", "Acme", "1 Elm", "US")]))
    stream_candidates(stream, B.index(t), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out/*")).select("s_ord", "candidate_entity_id", "n")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, B.candidates(B.entities(q), t).select("s_ord", "candidate_entity_id", "n").collect()))
