"""Queries p1, p2 and p4 to p10 and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from amalgam.functions.values import clean_id
from amalgam.llm import groups, looks, matching, mixing, names, pieces, places, survivors, tokens
from amalgam.llm.values import BLANKS, MISSING
from amalgam.plans.skewed import CLEAN
from amalgam.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return looks.same_looking_pairs(table(spark, sf_dir, "test_source1"), "entity_id", ["business_name", "business_address"])


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "test_source1").select("ord", "entity_id", "business_name", "business_address")
    return looks.with_visual_forms(rows, ["business_name", "business_address"]).select("ord", "entity_id", "business_name_form", "business_address_form")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = groups.edges_of_lists(table(spark, sf_dir, "matching_results"), "source1_entity_id", "matched_entity_ids")
    return groups.connected_components(pairs).select(F.col("id").alias("entity_id"), "group_id")


def _source2(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "test_source2")
    return rows.withColumn("entity_id", clean_id(rows.entity_id))


def p4_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = table(spark, sf_dir, "test_source1"), table(spark, sf_dir, "test_source2")
    out = matching.matches(one, one.entity_id, two, clean_id(two.entity_id))
    return out.select(F.col("id1").alias("source1_entity_id"), F.col("id2").alias("source2_entity_id"), "confidence")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_matches(spark, sf_dir).drop("confidence")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, three = table(spark, sf_dir, "test_source1"), table(spark, sf_dir, "test_source3")
    out = places.same_place_pairs(one, one.entity_id, three, three.entity_id)
    return out.select(F.col("id1").alias("source1_entity_id"), F.col("id2").alias("source3_entity_id"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = table(spark, sf_dir, "test_source1"), table(spark, sf_dir, "test_source2")
    out = names.same_name_pairs(one, one.entity_id, two, clean_id(two.entity_id))
    return out.select(F.col("id1").alias("source1_entity_id"), F.col("id2").alias("source2_entity_id"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.survivors(_source2(spark, sf_dir), "entity_id", {"name_ord": "business_name", "address_ord": "business_address"}, least_rows=2)


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return survivors.golden_records(_source2(spark, sf_dir), "entity_id")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "ids")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = [mixing.Target(r.source, r.target_share, r.max_repeats) for r in table(spark, sf_dir, "mix_targets").collect()]  # parameters, one row each
    return mixing.mix(table(spark, sf_dir, "documents"), targets)


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares_reached(p9_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = [(r.limit_name, r.max_tokens, r.overlap_tokens) for r in table(spark, sf_dir, "split_limits").collect()]  # parameters, one row each
    return pieces.split_texts(table(spark, sf_dir, "documents"), "doc_id", "text", limits)


QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms, "p2_found": p2_found, "p4_found": p4_found, "p4_matches": p4_matches, "p5_found": p5_found, "p7_found": p7_found, "p6_found": p6_found, "p6_records": p6_records, "p8_ids": p8_ids, "p9_mix": p9_mix, "p9_shares": p9_shares, "p10_pieces": p10_pieces}
SPACES = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x0B]+$"


def _kept(field: int, column: str) -> str:
    """SQL: the bare values of a column that say something."""
    words = ", ".join(f"'{w}'" for w in MISSING)
    bare = f"regexp_replace(regexp_replace(regexp_replace({column}, '{SPACES}', ''), '(\\.\\.\\.|…)$', ''), '{SPACES}', '')"
    return f"SELECT id, {field} AS f, ord, updated_at, {bare} AS v FROM r WHERE {column} IS NOT NULL AND lower(trim({column}, '{BLANKS}')) NOT IN ({words})"


WHOLE = f"""r AS MATERIALIZED (SELECT id, ord, updated_at, business_name, business_address, country FROM {CLEAN}),
 v AS MATERIALIZED ({_kept(0, 'business_name')} UNION ALL {_kept(1, 'business_address')}),
 w AS MATERIALIZED (SELECT id, f, v, max(struct_pack(u := coalesce(updated_at, '0001-01-01'::TIMESTAMP), o := ord)) AS t FROM v a
  WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.id = a.id AND b.f = a.f AND b.v <> a.v AND starts_with(b.v, a.v)) GROUP BY 1, 2, 3)"""
SAYS = f"country IS NOT NULL AND lower(trim(country, '{BLANKS}')) NOT IN ({', '.join(repr(w) for w in MISSING)})"

ORACLE: dict[str, str] = {
    "p6_found": f"""WITH {WHOLE}, best AS (SELECT id, f, max(t).o AS ord FROM w GROUP BY 1, 2)
 SELECT id AS entity_id, max(CASE WHEN f = 0 THEN best.ord END) AS name_ord, max(CASE WHEN f = 1 THEN best.ord END) AS address_ord
 FROM (SELECT id FROM r GROUP BY id HAVING count(*) > 1) g LEFT JOIN best USING (id) GROUP BY 1""",
    "p6_records": f"""WITH {WHOLE}, c AS (SELECT v.id, v.v, max(struct_pack(u := coalesce(v.updated_at, '0001-01-01'::TIMESTAMP), o := v.ord, c := trim(r.country))) AS b FROM v JOIN r ON r.ord = v.ord WHERE v.f = 1 AND {SAYS} GROUP BY 1, 2),
 branch AS (SELECT w.id, max(struct_pack(has := c.b IS NOT NULL, t := w.t, c := c.b.c)) AS x FROM w LEFT JOIN c ON c.id = w.id AND c.v = w.v WHERE w.f = 1 GROUP BY 1),
 name AS (SELECT id, max(t).o AS ord FROM w WHERE f = 0 GROUP BY 1),
 loose AS (SELECT id, max(struct_pack(u := coalesce(updated_at, '0001-01-01'::TIMESTAMP), o := ord, c := trim(country))).c AS c FROM r WHERE {SAYS} GROUP BY 1)
 SELECT k.id AS entity_id, n.business_name, a.business_address, CASE WHEN branch.id IS NULL THEN loose.c ELSE branch.x.c END AS country
 FROM (SELECT DISTINCT id FROM r) k LEFT JOIN name ON name.id = k.id LEFT JOIN branch ON branch.id = k.id LEFT JOIN loose ON loose.id = k.id LEFT JOIN r n ON n.ord = name.ord LEFT JOIN r a ON a.ord = branch.x.t.o""",
}
