import numpy as np

from amalgam.llm import mixing
from amalgam.llm.mixing import Target

COLS = "doc_id long, source string, text string, times int"


def docs(spark, spec):
    rows, i = [], 0
    for source, n, word in spec:
        for _ in range(n):
            i += 1
            rows.append((i, source, f"{word} " * (20 + i % 37), 0))
    rows += [(i + 1, "a", None, 0), (i + 2, "a", "", 0)]
    return spark.createDataFrame(rows, COLS)


def shares(rows):
    total = sum(r.n_tokens * r.times for r in rows)
    out = {}
    for r in rows:
        out[r.source] = out.get(r.source, 0) + r.n_tokens * r.times / total
    return out


def test_shares_and_caps(spark):
    df = docs(spark, [("a", 400, "lighthouse"), ("b", 60, "harbour"), ("c", 300, "bridge"), (None, 6, "bridge"), ("odd", 5, "mill")])
    targets = [Target("a", 0.4, 1), Target("b", 0.3, 3), Target("c", 0.25, 1), Target("gone", 0.05, 9)]
    rows = mixing.mix(df, targets).collect()
    got = shares(rows)
    want = mixing.nearest_shares(np.array([0.4, 0.3, 0.25, 0.05]), np.array([True, True, True, False]))
    assert all(abs(got[s] - w) < 0.02 for s, w in zip("abc", want))
    assert max(r.times for r in rows if r.source == "b") <= 3 and max(r.times for r in rows if r.source != "b") <= 1
    assert len({r.doc_id for r in rows}) == len(rows) and all(r.n_tokens > 0 for r in rows)
    again = mixing.mix(df, targets).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_report(spark):
    df = docs(spark, [("a", 50, "x"), ("b", 50, "y")])
    goal = spark.createDataFrame([("a", 0.7, 2), ("gone", 0.3, 1)], "source string, target_share double, max_repeats int")
    rows = {r.source: r for r in mixing.shares_reached(mixing.mix(df, [Target("a", 0.7, 2), Target("gone", 0.3, 1)]), goal).collect()}
    assert rows["gone"].tokens == 0 and abs(sum(r.actual_share for r in rows.values()) - 1) < 1e-9


def test_nothing_to_draw(spark):
    df = docs(spark, [("a", 3, "x")])
    assert mixing.mix(df, []).count() == 0 and mixing.mix(df, [Target("gone", 1.0, 1)]).count() == 0
    assert mixing.mix(df.limit(0), [Target("a", 1.0, 1)]).count() == 0


def test_classifier_on_held_out_rows():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 3, 900)
    x = rng.poisson(2, (900, mixing.FEATURES)).astype(float)
    for k in range(3):
        x[y == k, k * 5 : k * 5 + 5] += 6
    w = mixing.fit_classifier(x[:600], y[:600], 3)
    assert (mixing._softmax(mixing._scaled(x[600:]) @ w).argmax(1) == y[600:]).mean() > 0.95
