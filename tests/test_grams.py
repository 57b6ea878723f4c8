import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from amalgam.functions import grams as G
from amalgam.operators import pairs as P


def of(t):
    return Counter(t[i : i + 3] for i in range(len(t) - 2))


def invented(n):
    rng = random.Random(7)
    return ["".join(rng.choice("abc é𝒳東") for _ in range(rng.choice([0, 1, 2, 3, 9, 40]))) for _ in range(n)]


def test_counts_and_cosines_against_brute_force(monkeypatch):
    texts = invented(300) * 2
    total, df = Counter(), Counter()
    for t in texts:
        total += of(t)
        df += Counter(dict.fromkeys(of(t), 1))
    weight = {g: math.log((1 + len(texts)) / (1 + n)) + 1 for g, n in df.items() if n > 3}
    keys = G.keys_of(list(weight))
    order = np.argsort(keys)
    a, b = texts, texts[5:] + texts[:5]
    a[:3], b[:3] = ["same abc", "", "ab"], ["same abc", "", "ab"]

    def cosine(s, t):
        v, w = ({g: n * weight[g] for g, n in of(x).items() if g in weight} for x in (s, t))
        size = math.sqrt(sum(x * x for x in v.values()) * sum(x * x for x in w.values()))
        return sum(x * w.get(g, 0) for g, x in v.items()) / size if size else 0.0

    texts = invented(300) * 2
    for characters, held in ((G.CHARACTERS, G.HELD), (50, 40)):  # whole, and in many parts
        monkeypatch.setattr(G, "CHARACTERS", characters)
        monkeypatch.setattr(G, "HELD", held)
        got_total, got_df = Counter(), Counter()
        for out in G.count_batches(iter([pa.RecordBatch.from_arrays([pa.array(texts[i : i + 100], pa.string())], ["s"]) for i in range(0, 600, 100)])):
            for r in out.to_pylist():
                got_total[r["gram"]] += r["total"]
                got_df[r["gram"]] += r["df"]
        assert (got_total, got_df) == (total, df)
        got = G.cosines(a, b, keys[order], np.array(list(weight.values()))[order])
        assert np.abs(got - [cosine(s, t) for s, t in zip(a, b)]).max() < 1e-9 and got[1] == got[2] == 0
    assert not G.cosines(a, b, keys[:0], np.zeros(0)).any() and not list(G.count_batches(iter([])))


def test_features_v2_shuffle_no_pairs(spark):
    cols = "source1_entity_id string, candidate_entity_id string, business_name_1 string, business_address_1 string, country_1 string, business_name_2 string, business_address_2 string, country_2 string"
    rows = [("S1-1", "S2-1", "Acme  Corp", "1 Elm", "US", "ACME Corp", "1 Elm", "US"), ("S1-1", "S2-2", "Acme  Corp", "1 Elm", "US", "Beta", "", "")]
    out = P.features_v2(spark.createDataFrame(rows * 2, cols))
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    got = Counter((r.candidate_entity_id, round(r.tfidf_cosine, 6)) for r in out.collect())
    assert got == {("S2-1", 1.0): 2, ("S2-2", 0.0): 2}  # each row of a pair keeps its features
