"""Checks of result files: (severity, rule, n, examples), one row for each rule that is broken, at most five examples each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.functions.text import text
from amalgam.sources.tables import with_positions
from amalgam.sources.tsv import exists


def _found(df: DataFrame, example: Column, rule: str, severity: str = "error") -> DataFrame:
    """The rule's row, if df has any; examples are the least five, kept small on the way."""
    each = df.select(example.cast("string").alias("x"))
    total = each.agg(F.count("*").alias("n"))
    few = each.distinct().orderBy("x").limit(5).agg(F.array_join(F.array_sort(F.collect_list("x")), ", ").alias("examples"))
    return total.crossJoin(few).where("n > 0").select(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), "n", "examples")


def entries(df: DataFrame, list_col: str) -> DataFrame:
    """(source1_entity_id, id): the entries of each list as they stand, none for an empty list."""
    return df.where(text(F.col(list_col)) != "").select("source1_entity_id", F.explode(F.split(F.col(list_col), ",")).alias("id"))


def counts(df: DataFrame, list_col: str) -> DataFrame:
    empty = F.trim(text(F.col(list_col))) == ""
    return df.agg(F.count("*").alias("rows"), F.count_if(empty).alias("empty"), F.count_if(~empty).alias("filled"))


def duplicate_rows(df: DataFrame) -> DataFrame:
    return _found(df.groupBy("source1_entity_id").count().where("count > 1"), F.col("source1_entity_id"), "duplicate row")


def last_of_duplicates(df: DataFrame, list_col: str, line: str) -> DataFrame:
    """One list for each id: the one of its last line."""
    return df.groupBy("source1_entity_id").agg(F.max_by(list_col, line).alias(list_col))


def repeated_ids(df: DataFrame, list_col: str) -> DataFrame:
    ids = F.split(text(F.col(list_col)), ",")
    return _found(df.where((text(F.col(list_col)) != "") & (F.size(ids) != F.size(F.array_distinct(ids)))), F.col("source1_entity_id"), "repeated id in a list")


def own_source(df: DataFrame, list_col: str) -> DataFrame:
    return _found(entries(df, list_col).where(F.startswith("id", F.lit("S1-"))), F.col("id"), "id of source 1 in a list")


def wrong_prefix(df: DataFrame, list_col: str) -> DataFrame:
    odd = ~F.startswith("id", F.lit("S1-")) & ~F.startswith("id", F.lit("S2-")) & ~F.startswith("id", F.lit("S3-"))
    return _found(entries(df, list_col).where(odd), F.col("id"), "id without prefix S2- or S3-")


def unknown_ids(df: DataFrame, list_col: str, known: DataFrame) -> DataFrame:
    named = entries(df, list_col).where(F.startswith("id", F.lit("S2-")) | F.startswith("id", F.lit("S3-")))
    return _found(named.join(known.select(F.col("entity_id").alias("id")).distinct(), "id", "left_anti"), F.col("id"), "unknown id")


def missing_rows(df: DataFrame, required: DataFrame) -> DataFrame:
    need = required.select(F.col("entity_id").alias("source1_entity_id")).distinct()
    return _found(need.join(df.select("source1_entity_id"), "source1_entity_id", "left_anti"), F.col("source1_entity_id"), "required id missing")


def extra_rows(df: DataFrame, required: DataFrame) -> DataFrame:
    need = required.select(F.col("entity_id").alias("source1_entity_id")).distinct()
    return _found(df.select("source1_entity_id").distinct().join(need, "source1_entity_id", "left_anti"), F.col("source1_entity_id"), "id not in the query set")


def not_candidates(df: DataFrame, list_col: str, candidates: DataFrame, candidate_col: str) -> DataFrame:
    """Rows with matches that are no candidates (a warning)."""
    own = df.groupBy("source1_entity_id").agg(F.array_distinct(F.flatten(F.collect_list(F.split(text(F.col(list_col)), ",")))).alias("m"))
    other = candidates.groupBy("source1_entity_id").agg(F.array_distinct(F.flatten(F.collect_list(F.split(text(F.col(candidate_col)), ",")))).alias("c"))
    odd = own.join(other, "source1_entity_id", "left").where(F.size(F.array_except(F.array_remove("m", ""), F.coalesce("c", F.array().cast("array<string>")))) > 0)
    return _found(odd, F.col("source1_entity_id"), "matches that are no candidates", "warning")


def malformed_lines(lines: DataFrame) -> DataFrame:
    """Lines of a text file (value, line) without a tab that aren't blank."""
    return _found(lines.where((F.instr("value", "\t") == 0) & (F.trim("value") != "")), F.col("line"), "row without a tab")


def numbered_lines(df: DataFrame) -> DataFrame:
    """(value, line) of spark.read.text of one file, lines from 1."""
    return with_positions(df, "line")


def header_problem(header: str, expected: list[str]) -> str | None:
    """What is wrong with a file's first line, if anything."""
    if "\t" not in header and "," in header:
        return "comma separated header"
    if [x.strip().lower() for x in header.split("\t")] != expected:
        return "wrong header"
    return None


def all_checks(df: DataFrame, list_col: str, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """All rules on one table."""
    parts = [duplicate_rows(df), repeated_ids(df, list_col), own_source(df, list_col), wrong_prefix(df, list_col), missing_rows(df, required), extra_rows(df, required)]
    if known is not None:
        parts.append(unknown_ids(df, list_col, known))
    return reduce(DataFrame.unionByName, parts)


def _said(spark: SparkSession, severity: str, rule: str, example: str = "") -> DataFrame:
    return spark.createDataFrame([(severity, rule, 1, example)], "severity string, rule string, n bigint, examples string")


# The header that each kind of file must have.
HEADERS = {"matched_entity_ids": ["source1_entity_id", "matched_entity_ids"], "candidate_entity_ids": ["source1_entity_id", "candidate_entity_ids"]}


def read_lists(spark: SparkSession, path: str, list_col: str) -> tuple[DataFrame | None, DataFrame | None]:
    """(rows, problems) of a file of id lists: rows (source1_entity_id, <list>, line) as they stand, none where the file can't be used.

    Missing, empty, not UTF-8, a wrong header: an error, and no rows. A line without a tab that isn't blank: an error, and no row.
    """
    if not exists(spark, path):
        return None, _said(spark, "error", "file missing", path)
    raw = spark.read.format("binaryFile").load(path).select("length").first()
    if raw is None or not raw.length:
        return None, _said(spark, "error", "file empty", path)
    lines = numbered_lines(spark.read.text(path))
    if not lines.where(~F.is_valid_utf8("value")).isEmpty():
        return None, _said(spark, "error", "file isn't UTF-8", path)
    header = lines.where("line = 1").first().value.removeprefix("\ufeff")
    if wrong := header_problem(header, HEADERS[list_col]):
        return None, _said(spark, "error", wrong, header)
    body = lines.where("line > 1")
    parts = F.split(F.col("value"), "\t", 2)
    rows = body.where(F.instr("value", "\t") > 0).select(F.get(parts, 0).alias("source1_entity_id"), F.get(parts, 1).alias(list_col), "line")
    return rows, malformed_lines(body)


def check_file(spark: SparkSession, path: str, list_col: str, required: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame]:
    """(rows, problems) of a file after all rules; of lines with the same id the last one counts in what follows."""
    rows, problems = read_lists(spark, path, list_col)
    if rows is None:
        return None, problems
    return last_of_duplicates(rows, list_col, "line"), problems.unionByName(all_checks(rows, list_col, required, known))


def check_files(spark: SparkSession, matches: str, candidates: str | None, required: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """All problems of a result file and, if it is there, of the candidate file it must follow from.

    known: the targets; without them ids aren't looked up, which is a warning, as is a candidate file that is missing.
    """
    rows, out = check_file(spark, matches, "matched_entity_ids", required, known)
    if known is None:
        out = out.unionByName(_said(spark, "warning", "ids weren't looked up"))
    if candidates is None or not exists(spark, candidates):
        return out.unionByName(_said(spark, "warning", "candidate file missing", candidates or ""))
    other, more = check_file(spark, candidates, "candidate_entity_ids", required, known)
    out = out.unionByName(more)
    if rows is not None and other is not None:
        out = out.unionByName(not_candidates(rows, "matched_entity_ids", other, "candidate_entity_ids"))
    return out


def passed(problems: DataFrame) -> bool:
    """Whether there is no error (warnings don't count)."""
    return problems.where("severity = 'error'").isEmpty()
