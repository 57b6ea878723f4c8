"""The linkage pipeline from the command line: python -m amalgam.cli block | train | predict | validate ... (see --help of each).

Files are tab-separated with a header. `block` reads {split}_source1.tsv, {split}_source2.tsv and {split}_source3.tsv of a folder (or of
the folder below it that holds them) and writes candidate lists; `train` and `predict` use them; `validate` ends with status 1 if a result file breaks a rule.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.functions.text import ABBREVIATIONS, ABBREVIATIONS_V1
from amalgam.operators import blocking as B
from amalgam.operators import mining as M
from amalgam.operators import pairs as P
from amalgam.operators import validate as V
from amalgam.sources import tsv
from amalgam.sources.tables import cut

FEATURES = {"v1": (P.features_v1, P.V1, ABBREVIATIONS_V1), "v2": (P.features_v2, P.V2, ABBREVIATIONS)}


def records(spark: SparkSession, folder: str, split: str, na_words: bool = False) -> tuple[DataFrame, DataFrame]:
    """Query records and targets of a split, in the order of their files, source 2 before source 3."""
    folder = tsv.find_dataset(spark, folder, f"{split}_source2.tsv", folder)
    one, two, three = (tsv.read_tsv(spark, f"{folder}/{split}_source{n}.tsv", tsv.ENTITY, na_words) for n in (1, 2, 3))
    two = tsv.with_order(two)
    last = two.agg(F.coalesce(F.max("ord"), F.lit(0)).alias("n")).first().n
    return B.entities(tsv.with_order(one)), B.targets(two, tsv.with_order(three, last))


def truth_of(spark: SparkSession, path: str) -> DataFrame:
    return P.explode_lists(tsv.read_tsv(spark, path, tsv.MATCHES), "matched_entity_ids").select(*P.KEY).distinct()


def pairs_of(spark: SparkSession, path: str) -> DataFrame:
    return P.explode_lists(tsv.read_tsv(spark, path, tsv.CANDIDATES), "candidate_entity_ids")


def show(df: DataFrame) -> None:
    for row in df.collect():  # a few rows of figures
        print("\t".join(f"{k}={v}" for k, v in row.asDict().items()))


def block(spark: SparkSession, a: argparse.Namespace) -> int:
    queries, targets = records(spark, a.data_dir, a.split)
    if a.index_path:
        if not tsv.exists(spark, a.index_path):
            tsv.write_postings(B.index(targets, a.max_block_size), a.index_path)
        pairs = B.search(queries, tsv.read_postings(spark, a.index_path), a.max_candidates, a.mode == "two_stage")
    else:
        find = B.reranked if a.mode == "two_stage" else B.candidates
        pairs = find(queries, targets, a.max_candidates, a.max_block_size)
    pairs = cut(pairs)
    tsv.write_tsv(B.lists(queries, pairs), a.out_file, a.one_file)
    show(B.stats(queries, pairs, a.max_candidates))
    if a.gt_file:
        show(B.recall(pairs, truth_of(spark, a.gt_file)))
    return 0


def featured(spark: SparkSession, pairs: DataFrame, a: argparse.Namespace, split: str) -> tuple[DataFrame, list[str], DataFrame, DataFrame]:
    """pairs with both records and their features; the features' names; queries; targets."""
    queries, targets = records(spark, a.data_dir, split, a.pandas_na)
    make, names, table = FEATURES[a.features]
    return make(P.join_records(pairs, P.last_by_id(queries), P.last_by_id(targets), table=table)), names, queries, targets


def train(spark: SparkSession, a: argparse.Namespace) -> int:
    from amalgam.operators.evaluate import best, cross_validation, grid_scores
    from amalgam.operators.model import Settings
    from amalgam.operators.model import train as fit
    from amalgam.operators.model import tuned

    queries, targets = records(spark, a.data_dir, "train", a.pandas_na)
    chosen = cut(M.training_set(pairs_of(spark, a.candidates_file), truth_of(spark, a.gt_file), queries, targets, a.keep_ratio, a.max_heap_size))
    folds = P.stratified_folds(chosen.select(*P.KEY, "pos", "label"), a.n_splits)
    rows, names, *_ = featured(spark, folds, a, "train")
    rows = cut(rows.select(*P.KEY, "label", "fold", *names))
    settings, scores = Settings(rounds=a.rounds), []
    for k in range(a.n_splits):
        model = fit(rows.where(F.col("fold") != k), names, settings)
        scores.append(best(grid_scores(model.score(rows.where(F.col("fold") == k)))).withColumn("fold", F.lit(k)))
    every = scores[0]
    for s in scores[1:]:
        every = every.unionAll(s)
    show(cross_validation(cut(every)))
    model = tuned(fit(rows.where("fold <> 0"), names, settings), rows.where("fold = 0"))
    model.save(a.model_dir)
    print(f"weight={model.weight}\tthreshold={model.threshold}")
    return 0


def predict(spark: SparkSession, a: argparse.Namespace) -> int:
    from amalgam.operators.model import Ensemble, score_one

    rows, _, queries, _ = featured(spark, pairs_of(spark, a.candidates_file), a, a.split)
    model = Ensemble.load(spark, a.model_dir)
    scored = score_one(model.first, rows, model.threshold) if a.single else model.score(rows)
    if a.single or a.rules:
        scored = scored.withColumn("is_match", P.overridden(F.col("is_match")))
    matched = scored.where("is_match = 1")
    ids = queries.select(F.col("entity_id").alias("source1_entity_id"))
    tsv.write_tsv(P.match_lists(ids, matched), a.out_file, a.one_file)
    return 0


def validate(spark: SparkSession, a: argparse.Namespace) -> int:
    required, targets = records(spark, a.test_dir, "test")
    problems = cut(V.check_files(spark, a.matching, a.candidates, required, targets if a.check_ids else None))
    show(problems)
    return 0 if V.passed(problems) else 1


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="amalgam", description=__doc__)
    sub = top.add_subparsers(required=True)

    def command(f, **options) -> None:
        p = sub.add_parser(f.__name__)
        p.set_defaults(run=f)
        for name, kind in options.items():
            flag = [f"--{name}", f"--{name.replace('_', '-')}"] if "_" in name else [f"--{name}"]
            if kind is bool:
                p.add_argument(*flag, action="store_true")
            elif isinstance(kind, list):
                p.add_argument(*flag, choices=kind, default=kind[0])
            elif kind is None:
                p.add_argument(*flag)
            elif isinstance(kind, type):
                p.add_argument(*flag, type=kind, required=True)
            else:
                p.add_argument(*flag, type=type(kind), default=kind)

    command(block, data_dir=str, split=["train", "test"], out_file=str, max_candidates=B.TOP, max_block_size=B.CAP, index_path=None, gt_file=None, mode=["two_stage", "one_stage"], one_file=bool)
    command(train, data_dir=str, candidates_file=str, gt_file=str, model_dir=str, n_splits=5, keep_ratio=0.5, max_heap_size=10_000_000, rounds=300, features=["v2", "v1"], pandas_na=bool)
    command(predict, data_dir=str, split=["test", "train"], candidates_file=str, model_dir=str, out_file=str, features=["v2", "v1"], single=bool, rules=bool, pandas_na=bool, one_file=bool)
    command(validate, matching=str, candidates=None, test_dir=str, check_ids=bool)
    return top


def main(args: list[str], spark: SparkSession | None = None) -> int:
    a = parser().parse_args(args)
    try:
        return a.run(spark or SparkSession.builder.appName("amalgam").getOrCreate(), a)
    except OSError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
