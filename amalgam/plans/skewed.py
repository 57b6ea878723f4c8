"""Problem 3: per-key results over test_source2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from amalgam.functions.values import NARROW, WIDE, clean_id
from amalgam.operators.skew import counts_by_key, heavy_hitters
from amalgam.sources.tables import table


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_hitters(table(spark, sf_dir, "test_source2"), ["country", "business_name"], 0.01)


def p3_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "test_source2")
    rows = rows.select("country", "business_name", clean_id(rows.entity_id).alias("entity_id"))
    return counts_by_key(rows, "country", {"entity_ids": "entity_id", "names": "business_name"})


def p3_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "test_source2")
    rows = rows.select("business_name", clean_id(rows.entity_id).alias("entity_id"))
    return counts_by_key(rows, "business_name", {"entity_ids": "entity_id"})


QUERIES = {"p3_found": p3_found, "p3_country": p3_country, "p3_name": p3_name}

CLEAN = f"""(SELECT *, CASE WHEN digits <> '' THEN 'S2-' || CASE WHEN length(digits) < 9 THEN lpad(digits, 9, '0') ELSE digits END ELSE trim(entity_id) END AS id FROM
 (SELECT *, regexp_extract(upper(translate(entity_id, '{WIDE}', '{NARROW}')), '^[^0-9A-Z]*S[^0-9A-Z]*2[^0-9A-Z]*([0-9]+)[^0-9A-Z]*$', 1) AS digits FROM test_source2))"""

ORACLE = {
    "p3_found": """WITH k AS (SELECT 'country' AS key_field, country AS key_value, count(*) AS n FROM test_source2 GROUP BY 2
 UNION ALL SELECT 'business_name', business_name, count(*) FROM test_source2 GROUP BY 2)
 SELECT key_field, key_value FROM k WHERE key_value IS NOT NULL AND n >= 0.01 * (SELECT count(*) FROM test_source2)""",
    "p3_country": f"SELECT country, count(*) AS rows, count(DISTINCT id) AS entity_ids, count(DISTINCT business_name) AS names FROM {CLEAN} GROUP BY country",
    "p3_name": f"SELECT business_name, count(*) AS rows, count(DISTINCT id) AS entity_ids FROM {CLEAN} GROUP BY business_name",
}
