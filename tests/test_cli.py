import random

import pytest

from amalgam.cli import main

HEADER = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(3)
    word = lambda: rng.choice("bdfgk") + rng.choice("aeo") + rng.choice(["rano", "tile", "muko"])
    firms = [(f"{word()} {word()}", f"{rng.randint(1, 99)} {word()} St", rng.choice(["US", "GB"])) for _ in range(60)]
    at = tmp_path / "deep" / "data"
    at.mkdir(parents=True)
    for split in ("train", "test"):
        for n, some in ((1, firms), (2, firms[:40]), (3, firms[30:])):
            rows = [f"S{n}-{i}\t{name}{' Ltd' if n > 1 else ''}\t{a}\t{c}\n" for i, (name, a, c) in enumerate(firms) if (name, a, c) in some]
            (at / f"{split}_source{n}.tsv").write_text(HEADER + "".join(rows))
    lists = {i: ",".join([f"S2-{i}"] * (i < 40) + [f"S3-{i}"] * (i >= 30)) for i in range(60)}
    (at / "truth.tsv").write_text("source1_entity_id\tmatched_entity_ids\n" + "".join(f"S1-{i}\t{x}\n" for i, x in lists.items()))
    return at


def text(at):
    return sorted(line for p in at.glob("part-*") for line in p.read_text().splitlines()[1:])


def test_from_blocking_to_validation(spark, folder, capsys):
    run = lambda *args: main(list(map(str, args)), spark)
    for split, mode in (("train", "one_stage"), ("test", "two_stage")):
        out = folder / f"{split}_candidates"
        assert run("block", "--data_dir", folder.parent, "--split", split, "--out_file", out, "--mode", mode, "--gt_file", folder / "truth.tsv", "--one-file") == 0
        kept = folder / f"{split}_kept"
        for _ in range(2):  # written, then used
            assert run("block", "--data_dir", folder, "--split", split, "--out_file", kept, "--mode", mode, "--index_path", folder / f"{split}_index") == 0
        assert text(kept) == text(out) and len(text(out)) == 60
    said = capsys.readouterr().out
    assert "total=60" in said and "recall=1.0" in said
    common = ("--data_dir", folder, "--features", "v1")
    assert run("train", *common, "--candidates_file", folder / "train_candidates", "--gt_file", folder / "truth.tsv", "--model_dir", folder / "model", "--n_splits", 2, "--rounds", 3) == 0
    assert "mean=" in capsys.readouterr().out
    for more in ((), ("--single",)):
        assert run("predict", *common, "--candidates_file", folder / "test_candidates", "--model_dir", folder / "model", "--out_file", folder / "out", "--one_file", *more) == 0
        assert len(text(folder / "out")) == 60
    result, candidates = (next((folder / x).glob("part-*")) for x in ("out", "test_candidates"))
    check = ("validate", "--test_dir", folder, "--candidates", candidates, "--check-ids")
    assert run(*check, "--matching", result) == 0
    edited = folder / "edited.tsv"
    edited.write_text(result.read_text().replace("S1-1\t", "S1-999\t"))
    assert run(*check, "--matching", edited) == 1
    assert "required id missing" in capsys.readouterr().out
    assert run(*check, "--matching", folder / "gone.tsv") == 1
