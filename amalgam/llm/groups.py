"""Problem 2: one group identifier for all records linked directly or indirectly.

1. Peel: breadth-first joins from the vertex of highest degree collect the giant component. The search goes on while its frontier
   is a fair part of what it has found; edges inside the found set are anti-joined away. If the component isn't exhausted by then
   (a long chain hangs on it), the found set is contracted to one vertex, its smallest id, so no link is lost.
2. The rest is labelled by propagating minima, over stars instead of paths (each vertex is linked to the least vertex near it, in
   turn among larger and smaller neighbours), which halves chains each round instead of walking them.

All steps are joins and aggregations with partial sums; a hub's edges are spread by Spark's skew join. No component is collected.

Defined results: null, empty and `nan` entries are no ids; a row without partners still gives its own id; self links and repeated
links change nothing; an empty table gives no rows; the group id is the least id of the group in string order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from amalgam.sources.tables import cut, drop_cut, numbered

#: The search for the giant component stops once a frontier is smaller than this part of what is found.
THIN = 0.05
MAX_PEEL = 12


def edges_of_lists(df: DataFrame, id_col: str, list_col: str, sep: str = ",") -> DataFrame:
    """(u, v): each id of the list with the row's own id; v is null for a row without partners."""
    own = F.trim(F.regexp_replace(id_col, r"(?U)^\s+|\s+$", ""))
    is_id = lambda x: (x != "") & (F.lower(x) != "nan")
    parts = F.transform(F.split(F.coalesce(list_col, F.lit("")), sep), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    listed = F.array_distinct(F.filter(parts, is_id))
    rows = df.select(F.when(is_id(own), own).alias("u"), listed.alias("vs")).select("u", F.explode_outer("vs").alias("v"))
    return rows.select(F.coalesce("u", "v").alias("u"), F.when(F.col("u").isNotNull(), F.col("v")).alias("v")).where(F.col("u").isNotNull())


def _least(edges: DataFrame, key: str, other: str) -> DataFrame:
    return edges.groupBy(F.col(key).alias("k")).agg(F.min(other).alias("m"))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One half-round on edges (hi, lo), hi > lo, each once."""
    if large:
        both = edges.select(F.col("hi").alias("k"), F.col("lo").alias("x")).unionAll(edges.select(F.col("lo").alias("k"), F.col("hi").alias("x")))
        least = both.groupBy("k").agg(F.least(F.min("x"), F.col("k")).alias("m"))
        # only larger neighbours are linked to the least one
        out = edges.select(F.col("lo").alias("k"), F.col("hi").alias("x")).join(least, "k").select(F.col("x").alias("hi"), F.col("m").alias("lo"))
        # x is larger than k here; a neighbour smaller than k keeps its own link
        return out.where("hi <> lo").distinct()
    least = _least(edges, "hi", "lo")
    joined = edges.select(F.col("hi").alias("k"), "lo").join(least, "k")
    again = joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return again.unionAll(least.select(F.col("k").alias("hi"), F.col("m").alias("lo"))).distinct()


def _peel(edges: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """What the search from the hub found, as (id), and the edges left, with that set contracted to its least id."""
    both = edges.select(F.col("hi").alias("a"), F.col("lo").alias("b")).unionAll(edges.select(F.col("lo").alias("a"), F.col("hi").alias("b")))
    hub = both.groupBy("a").count().orderBy(F.desc("count"), "a").limit(1).select(F.col("a").alias("id"))
    found = cut(hub)
    frontier, n = found, found.count()
    if not n:
        return None, edges
    for _ in range(MAX_PEEL):
        seen = Observation()
        new = cut(both.join(frontier.withColumnRenamed("id", "a"), "a", "left_semi").select(F.col("b").alias("id")).distinct().join(found, "id", "left_anti"), seen, F.count("*").alias("n"))
        k = seen.get["n"]
        if not k:
            break
        found, frontier, n = found.unionAll(new), new, n + k
        if k < THIN * n:
            break
    root = found.agg(F.min("id").alias("root"))  # one row
    inside = found.withColumn("in", F.lit(True))
    marked = edges.join(inside.withColumnRenamed("id", "hi").withColumnRenamed("in", "a"), "hi", "left").join(inside.withColumnRenamed("id", "lo").withColumnRenamed("in", "b"), "lo", "left")
    open_ = marked.where("a is null or b is null").crossJoin(F.broadcast(root))
    ends = open_.select(F.when(F.col("a"), F.col("root")).otherwise(F.col("hi")).alias("x"), F.when(F.col("b"), F.col("root")).otherwise(F.col("lo")).alias("y"))
    rest = ends.select(F.greatest("x", "y").alias("hi"), F.least("x", "y").alias("lo")).where("hi <> lo").distinct()
    return found.crossJoin(F.broadcast(root)), rest


def connected_components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, group_id) of every id in the columns u and v of `pairs`; v may be null (a vertex without links).

    Ids are numbered in their order once, so all rounds carry and compare numbers only.
    """
    ids = cut(numbered(pairs.select(F.explode(F.array("u", "v")).alias("id")).where("id is not null").distinct(), ["id"], "n"))
    named = pairs.where("u <> v").select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).distinct()
    of = lambda c: ids.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"))
    edges = cut(named.join(of("hi"), "hi").join(of("lo"), "lo").select(F.col("nhi").alias("hi"), F.col("nlo").alias("lo")))
    found, rest = _peel(edges)
    at = cut(rest)
    drop_cut(edges)
    before = None
    for _ in range(max_rounds):
        seen = Observation()
        new = cut(_star(_star(at, large=True), large=False), seen, F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("sum"))
        drop_cut(at)
        at = new
        if seen.get == before:
            break
        before = seen.get
    else:
        raise RuntimeError("the stars didn't settle")
    labels = at.select(F.col("hi").alias("n"), F.col("lo").alias("label"))
    if found is not None:
        roots = labels.withColumnRenamed("n", "root").withColumnRenamed("label", "up")
        top = found.join(roots, "root", "left").select(F.col("id").alias("n"), F.coalesce("up", "root").alias("label"))
        root = found.select("root").limit(1).withColumnRenamed("root", "n")
        labels = labels.join(F.broadcast(root), "n", "left_anti").unionAll(top)
    numbers = ids.join(labels, "n", "left").select("id", F.coalesce("label", "n").alias("label"))
    names = ids.select(F.col("n").alias("label"), F.col("id").alias("group_id"))
    return numbers.join(names, "label").select("id", "group_id")
