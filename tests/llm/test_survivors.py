import datetime as dt

from amalgam.llm import survivors

COLS = "entity_id string, business_name string, business_address string, country string, updated_at timestamp, ord long, trust int, k int"


def at(day):
    return dt.datetime(2024, 1, day) if day else None


def run(spark, rows):
    df = spark.createDataFrame([(e, n, a, c, at(d), o, 0, 0) for e, n, a, c, d, o in rows], COLS)
    out = survivors.survivors(df, "entity_id", {"name_ord": "business_name", "address_ord": "business_address"}, least_rows=2)
    return {r.entity_id: (r.name_ord, r.address_ord) for r in out.collect()}


def test_rules(spark):
    got = run(spark, [
        ("a", "Acme Ltd", "1 Elm", "US", 1, 1), ("a", "Acme L...", "1 Elm Street", "US", 5, 2), ("a", "n/a", None, "US", 9, 3),  # cut short, missing
        ("b", "X", "Y", "US", 1, 1), ("b", "Z", "Y", "US", None, 2),  # null is the earliest
        ("c", "X", "Y", "US", 2, 7), ("c", "Z", "W", "US", 2, 8),  # ties: larger ord
        ("d", "X", "Y", "US", 2, 7),  # one row only
        ("e", None, "?", "US", 2, 7), ("e", "", "--", "US", 2, 8),  # nothing survives
        ("f", "acme", "A", "US", 1, 1), ("f", "Acme Ltd", "A ", "US", 2, 2), ("f", "acme…", "A...", "US", 3, 3),  # case counts, equal when bare
        ("g", "AB", "q", "US", 9, 1), ("g", "AB C", "q", "US", 8, 2), ("g", "AB D", "q", "US", 7, 3),
    ])
    assert got == {"a": (1, 2), "b": (1, 1), "c": (8, 8), "e": (None, None), "f": (3, 3), "g": (2, 1)}


def test_one_hot_group_over_many_ranges(spark):
    rows = [("hot", f"name {i:05d}", f"addr {i % 7}", "US", 1 + i % 20, i) for i in range(2000)] + [("hot", "name 0", "addr 3 x", "US", 28, 5000)]
    assert run(spark, rows) == {"hot": (1999, 5000)}


def test_empty(spark):
    assert run(spark, []) == {}


def golden(spark, rows):
    df = spark.createDataFrame([(e, n, a, c, at(d), o, 0, 0) for e, n, a, c, d, o in rows], COLS)
    return {r.entity_id: (r.business_name, r.business_address, r.country) for r in survivors.golden_records(df, "entity_id").collect()}


def test_country_goes_with_the_address(spark):
    got = golden(spark, [
        ("a", "N", "1 Elm", "US", 5, 1), ("a", "N", "", "FR", 9, 2),  # the later country belongs to no address
        ("b", "N", "1 Elm", None, 5, 3), ("b", "N", None, "FR", 9, 4),  # no row gives a country with the address
        ("c", "N", "2 Oak", None, 9, 5), ("c", "M", "1 Elm", "US", 5, 6), ("c", "M", "3 Ash", "FR", 7, 7),  # branched: the root has no country
        ("d", "N", "1 Elm", "US", 5, 8), ("d", "N", "1 Elm", "FR", 6, 9), ("d", "N", "2 Oak", "DE", 4, 10),  # an address has one country
        ("e", None, None, "US", 5, 11), ("e", "n/a", "?", " ", 6, 12),
        ("f", "N", "1 Elm...", "US", 9, 13), ("f", "N", "1 Elm Road", None, 5, 14),  # a branch cut short never wins
        ("g", None, None, None, None, 15),
    ])
    assert got == {"a": ("N", "1 Elm", "US"), "b": ("N", "1 Elm", None), "c": ("N", "3 Ash", "FR"), "d": ("N", "1 Elm", "FR"), "e": (None, None, "US"), "f": ("N", "1 Elm Road", None), "g": (None, None, None)}
    assert golden(spark, []) == {}


def test_branch_and_bound_against_all_combinations(spark):
    import random

    rng = random.Random(3)
    rows = [(f"k{rng.randint(0, 40)}", rng.choice(["A", "B", None]), rng.choice(["1 Elm", "2 Oak", "3 Ash", None]), rng.choice(["US", "FR", None]), rng.choice([None, *range(1, 9)]), o) for o in range(200)]
    want = {}
    for k in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == k]
        trust = lambda r: (r[4] or 0, r[5])
        held = {a: max((r for r in own if r[2] == a), key=trust) for a in {r[2] for r in own} - {None}}
        country = {a: max((r for r in own if r[2] == a and r[3]), key=trust, default=None) for a in held}
        best = max(held, key=lambda a: (country[a] is not None, trust(held[a])), default=None)
        name = max((r for r in own if r[1]), key=trust, default=None)
        loose = max((r for r in own if r[3]), key=trust, default=None)
        c = (country[best] if best else loose) or (None,) * 6
        want[k] = (name and name[1], best, c[3])
    assert golden(spark, rows) == want
