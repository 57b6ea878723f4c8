import pytest

from amalgam.llm import pieces, tokens
from amalgam.llm.words import sizes

TEXTS = ["", None, "Hello  world", "don't\n\nstop ", "naïve — 東京タワー　x", "😀" * 30, "x" * 3000, "asdf" * 500, "LOL" * 333, " \t\n ", "a" * 23, "<|endoftext|>", "مرحبا 123456", "é" * 50 + "の魔" * 20, "=" * 200, "word " * 5000]


@pytest.fixture(scope="module")
def library():
    return sizes().library


def test_ids_equal_the_library(spark, library):
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(TEXTS * 2)], "doc_id long, text string, words int")
    got = {r.doc_id: (r.ids, r.words) for r in tokens.encode(df, "text").collect()}
    for i, t in enumerate(TEXTS * 2):
        assert got[i] == (library.encode_ordinary(t or ""), 7), (t or "")[:30]


def test_empty_table(spark):
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string"), "text").count() == 0


def run(spark, texts, limits):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {}
    for r in pieces.split_texts(df, "doc_id", "text", limits).orderBy("doc_id", "limit_name", "piece").collect():
        out.setdefault((r.doc_id, r.limit_name), []).append(r)
    return out


def test_pieces_cover_the_text(spark, library):
    article = "\n\n".join(f"== Part {i} ==\nThe {i}th lighthouse of Nebresox fell. It was rebuilt in {1800 + i}.\nIts keeper left" for i in range(120))
    texts = [*TEXTS, article, "東京塔高" * 700, "😀" * 900]
    limits = [("s", 64, 8), ("w", 256, 0)]
    got = run(spark, texts, limits)
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        for name, most, shared in limits:
            ps = got.get((i, name), [])
            assert bool(ps) == (len(ids) > most)
            if ps:
                assert ps[0].start_token == 0 and ps[-1].end_token == len(ids) and ps[-1].end_char == len(t)
                assert all(p.n_tokens <= most and p.n_tokens == p.end_token - p.start_token and t[p.start_char : p.end_char] == p.text for p in ps)
                assert all(y.start_token == x.end_token - shared and y.overlap == shared for x, y in zip(ps, ps[1:]))
    kinds = [p.boundary for p in got[(len(TEXTS), "w")]][:-1]
    assert set(kinds) <= {"section", "paragraph", "line", "sentence"}


def test_an_edit_moves_few_cuts(spark):
    import random

    random.seed(1)
    words = [random.choice("harbour mill lighthouse keeper bridge river old stone narrow field".split()) for _ in range(6000)]
    text = " ".join(w + (". " if i % 9 == 8 else "") for i, w in enumerate(words))
    edited = text[:9000] + "Something else. " + text[9000:]
    got = run(spark, [text, edited], [("s", 128, 0)])
    a, b = ({p.text for p in got[(i, "s")]} for i in (0, 1))
    assert len(a & b) > 0.8 * len(a)


def test_a_limit_must_leave_room(spark):
    with pytest.raises(ValueError):
        run(spark, ["x"], [("s", 10, 8)])
    assert run(spark, ["x y z"], []) == {}


def test_every_token_that_is_looked_up_is_reached_by_its_merges(tmp_path):
    import json

    from amalgam.llm.tokens import TOKENIZERS, Encoder, unreached

    assert not unreached(f"{TOKENIZERS}/byte_bpe_50k.json")
    letters = tokens._byte_letters()
    base = {c: b for c, b in letters.items()}
    merges = [("a", "b"), ("b", "c"), ("a", "bc")]  # abc contracts to ab, c: the token abc is never reached
    vocab = {**base, "ab": 256, "bc": 257, "abc": 258}
    (tmp_path / "odd.json").write_text(json.dumps({"model": {"vocab": vocab, "merges": [" ".join(m) for m in merges]}}))
    odd = unreached(str(tmp_path / "odd.json"))
    assert odd == {258}
    enc = Encoder(str(tmp_path / "odd.json"), odd)
    enc.learn(["abc", "ab"])
    assert enc.known == {"abc": [256, 99], "ab": [256]}
