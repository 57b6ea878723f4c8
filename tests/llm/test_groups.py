import random

from amalgam.llm import groups

COLS = "source1_entity_id string, matched_entity_ids string, group_id string"


def brute(rows):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, bs in rows:
        a = find(a)
        for b in bs:
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {x: find(x) for x in up}


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], COLS)
    return {r.id: r.group_id for r in groups.connected_components(groups.edges_of_lists(df, "source1_entity_id", "matched_entity_ids")).collect()}


def test_random_graphs_with_a_hub_and_a_chain(spark):
    random.seed(3)
    rows = [(f"S1-{random.randint(100, 199)}", [f"S2-{random.randint(100, 180)}"]) for _ in range(60)]
    rows += [("S1-500", [f"S3-{i}" for i in range(100, 160)])] + [(f"S1-{600 + i}", [f"S1-{601 + i}"]) for i in range(40)] + [("S3-120", ["S1-630"])]
    assert run(spark, [(a, ",".join(b)) for a, b in rows]) == brute(rows)


def test_dirty_lists(spark):
    got = run(spark, [(" S1-1 ", " ,S2-1,, nan"), ("S1-2", None), ("S1-3", ""), ("S1-4", "S1-4,S1-4"), ("S1-1", "S2-1,S2-9"), (None, "S2-7"), ("nan", "nan")])
    assert got == {"S1-1": "S1-1", "S2-1": "S1-1", "S2-9": "S1-1", "S1-2": "S1-2", "S1-3": "S1-3", "S1-4": "S1-4", "S2-7": "S2-7"}


def test_empty(spark):
    assert run(spark, []) == {} and run(spark, [("S1-1", "")]) == {"S1-1": "S1-1"}
