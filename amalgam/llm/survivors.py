"""Problem 6: the surviving record of each group of duplicates, by consistent bundles.

Fields that depend on each other form a bundle (a name; an address with its country), and a bundle survives whole. Trust in a row's
bundle is (updated_at, order of arrival). The best choice over all bundles is found by branch and bound. The bound of a node is
the best trust of each bundle on its own: where bundles don't constrain each other (survivors()), the root meets its bound and nothing is
branched; where a dependency holds (address -> country, golden_records()), only keys whose root misses the bound are branched.
Bounds and branches are aggregations with partial results, so a group may hold any share of all rows.

A value cut short (the beginning of another value of the group) is found by sorting: all values that begin with p follow p
directly, so only the next different value needs a look. The rows are range-sorted over all tasks; the first row of each range
is handed to the range before it, so no group is gathered in one task.

Defined results: missing values and values cut short never survive; null updated_at is the earliest; ties are decided by the larger
ord; a group in which nothing survives has null; repeated rows count as rows; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amalgam.llm.values import is_missing
from amalgam.sources.tables import cut, splits


def bare(c: Column) -> Column:
    """Without blanks at the end and without a final ellipsis."""
    end = lambda x: F.regexp_replace(x, r"(?U)\s+$", "")
    return end(F.regexp_replace(end(c), r"(\.\.\.|…)$", ""))


def _bundles(df: DataFrame, key: str, bundles: list[str], updated: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(key, field, ord): for each key and each column in `bundles`, the ord of the row whose value survives; and all values that aren't cut short, (k, f, v, trust)."""
    trust = F.struct(F.col(updated).alias("u"), F.col(order).alias("o"))
    each = df.select(F.col(key).alias("k"), trust.alias("trust"), F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.when(~is_missing(F.col(c)), bare(F.col(c))).alias("v")) for i, c in enumerate(bundles)])).alias("b"))
    each = each.select("k", F.col("b.f").alias("f"), F.col("b.v").alias("v"), "trust").where("v is not null")
    # null timestamps sort first in max()
    each = each.groupBy("k", "f", "v").agg(F.max("trust").alias("trust"))
    ranged = each.repartitionByRange(splits(df.sparkSession), "k", "f", "v").withColumn("part", F.spark_partition_id())
    ranged = cut(ranged)
    firsts = ranged.groupBy("part").agg(F.min(F.struct("k", "f", "v")).alias("first"))  # one row for each range
    after = firsts.select("part", F.lead("first").over(Window.orderBy("part")).alias("after"))
    at = F.lead(F.struct("k", "f", "v")).over(Window.partitionBy("part").orderBy("k", "f", "v"))
    following = ranged.withColumn("next", at).join(F.broadcast(after), "part", "left").withColumn("next", F.coalesce("next", "after"))
    same = (F.col("next.k") == F.col("k")) & (F.col("next.f") == F.col("f")) & F.startswith(F.col("next.v"), F.col("v"))
    whole = following.where(~F.coalesce(same, F.lit(False)))
    return whole.groupBy("k", "f").agg(F.max("trust").alias("t")).select(F.col("k").alias(key), F.col("f").alias("field"), F.col("t.o").alias("ord")), whole


def survivors(df: DataFrame, key: str, bundles: dict[str, str], updated: str = "updated_at", order: str = "ord", least_rows: int = 1) -> DataFrame:
    """(key, <bundle>...): one row for each key with at least `least_rows` rows; bundles maps an output column to the column it is chosen by."""
    best, _ = _bundles(df, key, list(bundles.values()), updated, order)
    chosen = best.groupBy(key).agg(*[F.max(F.when(F.col("field") == i, F.col("ord"))).alias(name) for i, name in enumerate(bundles)])
    counted = df.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") >= least_rows).drop("__n")
    return counted.join(chosen, key, "left")


def golden_records(df: DataFrame, key: str, updated: str = "updated_at", order: str = "ord") -> DataFrame:
    """(key, business_name, business_address, country): one consistent record for each key.

    Bundles are the name, and the address with its country; an address has one country, the most trusted among the rows that hold it. The
    best record fills the most fields, then has the most trusted address, then country. Branch and bound: the root is the most
    trusted address with its own country. A branch (another surviving address) can't fill more than both fields and its address is trusted
    less, so its bound beats the root only where the root has no country; only those keys are branched, and there only the
    addresses that have one.
    """
    best, whole = _bundles(df, key, ["business_name", "business_address"], updated, order)
    roots = best.groupBy(key).agg(*[F.max(F.when(F.col("field") == i, F.col("ord"))).alias(n) for i, n in enumerate(("name_ord", "root_ord"))])
    trust = F.struct(F.col(updated).alias("u"), F.col(order).alias("o"))
    country = F.when(~is_missing(F.col("country")), F.trim("country"))
    rows = df.select(F.col(key).alias("k"), trust.alias("trust"), country.alias("c"), F.when(~is_missing(F.col("business_address")), bare(F.col("business_address"))).alias("v"))
    countries = rows.where("v is not null and c is not null").groupBy("k", "v").agg(F.max(F.struct("trust", "c")).alias("b")).select("k", "v", F.col("b.c").alias("c"), F.col("b.trust").alias("ct"))
    branches = whole.where("f = 1").select("k", "v", "trust").join(countries, ["k", "v"], "left")
    at_root = F.col("trust.o") == F.col("root_ord")
    open_ = branches.join(roots.select(F.col(key).alias("k"), "root_ord"), "k")
    incumbent = open_.where(at_root).select("k", F.col("root_ord").alias("address_ord"), "c")
    bounded = incumbent.where("c is null").select("k")  # keys whose root a branch may beat
    beat = open_.where(~at_root & F.col("c").isNotNull()).join(bounded, "k", "left_semi").groupBy("k").agg(F.max(F.struct("trust", "ct", "c")).alias("b")).select("k", F.col("b.trust.o").alias("better_ord"), F.col("b.c").alias("better_c"))
    chosen = incumbent.join(beat, "k", "left").select(F.col("k").alias(key), F.coalesce("better_ord", "address_ord").alias("address_ord"), F.coalesce("c", "better_c").alias("country"))
    known = rows.where("c is not null").groupBy("k").agg(F.max(F.struct("trust", "c"))["c"].alias("only"))  # for keys without any address
    out = df.select(key).distinct().join(roots, key, "left").join(chosen, key, "left").join(known.withColumnRenamed("k", key), key, "left")
    names = df.select(F.col(order).alias("name_ord"), "business_name")
    addresses = df.select(F.col(order).alias("address_ord"), "business_address")
    out = out.join(names, "name_ord", "left").join(addresses, "address_ord", "left")
    return out.select(key, "business_name", "business_address", F.when(F.col("address_ord").isNull(), F.col("only")).otherwise(F.col("country")).alias("country"))
