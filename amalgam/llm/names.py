"""Problem 7: spellings of the name of the same firm or person.

1. Each distinct name is a weighted character n-gram vector (vectors.py). A sparse join over pairs of n-grams (a name's rarest
   features) brings names together; hashed bigrams of both, as bits of a number, drop what can't come near the threshold; the cosine
   of the vectors decides: all pairs of at least LINK are kept. `top` keeps a name's best n only (ties included); the
   query keeps all, since a cap would lose partners.
2. Common words (legal forms, trades, given names) are compared by the roles that the corpus gives them (roles.py): names
   whose words contradict each other are kept apart.
3. Average-linkage clustering over the pairs between the two sources: in each round all clusters that are each other's nearest are
   merged, which gives the same clusters as merging one pair at a time. Once at most REST edges are above the threshold, one task merges
   what is left, pair by pair. It ends when no pair of clusters is left to merge.

Defined results: missing names match nothing; equal names match; names of common words only are compared as written; repeated
rows give a pair once; empty tables give no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from amalgam.llm import linkage as L
from amalgam.llm.records import common_words, folded_records, parsed
from amalgam.llm.roles import Roles, learn
from amalgam.llm.vectors import name_cosines
from amalgam.sources.tables import cut, drop_all, drop_cut, release

#: The least cosine of a pair of names, and the least mean cosine of two clusters.
LINK, JOIN = 0.45, 0.3
#: Least cosine of the sketches of two names, and least product of the cosines of those of their words.
NEAR, NEAR_WORDS = 0.45, 0.3
#: Rounds after which an error is raised; edges above the threshold that one task can merge.
ROUNDS, REST = 200, 200_000
#: Shares of the keys that are joined one after the other.
SHARES = 2


def _near() -> Column:
    """Whether the sketches of two names allow a cosine near LINK; of names of two words each, by words."""
    bits = lambda c: F.bit_count(c).cast("double")
    alike = lambda x, y: bits(x.bitwiseAND(y)) / F.sqrt(F.greatest(bits(x) * bits(y), F.lit(1.0)))
    a, b, c, d = (F.col(f"sketch_{x}{n}") for n in "12" for x in "ab")
    two = F.greatest(alike(a, c) * alike(b, d), alike(a, d) * alike(b, c)) >= NEAR_WORDS
    whole = alike(a.bitwiseOR(b), c.bitwiseOR(d)) >= NEAR
    return F.when((b != 0) & (d != 0), two).otherwise(whole)


def close_names(left: DataFrame, right: DataFrame, roles: Roles, link: float = LINK, top: int | None = None) -> DataFrame:
    """(h1, h2, cosine, marks): names of two tables (h, core, marks, keys, sketch_a, sketch_b; each h once) of at least that cosine, each pair once.

    marks: the level of their common words (roles.level).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cosine = name_cosines(b.column("core1"), b.column("core2"), link)
            kept = pa.RecordBatch.from_arrays([*b.columns, pa.array(cosine)], names=[*b.schema.names, "cosine"]).filter(pa.array(cosine >= link))
            level = [roles.level(tuple(x), tuple(y)) for x, y in zip(kept.column("marks1").to_pylist(), kept.column("marks2").to_pylist())]
            yield pa.RecordBatch.from_arrays([kept.column("h1"), kept.column("h2"), kept.column("cosine"), pa.array(level, pa.int32())], names=["h1", "h2", "cosine", "marks"])

    parts = []
    for k in range(SHARES):  # of the keys, one after the other, so only one share's shuffle is on disk
        own = F.filter("keys", lambda x: F.pmod(x, F.lit(SHARES)) == k)
        keyed = [L.side(x.where("core <> ''").select("h", "sketch_a", "sketch_b", F.explode(own).alias("key")), n) for x, n in zip((left, right), "12")]
        met = keyed[0].join(keyed[1], F.col("key1") == F.col("key2"))
        met = cut(met.where((F.col("h1") == F.col("h2")) | _near()).select("h1", "h2").distinct())
        del keyed  # or their shuffles would stay
        release(left.sparkSession)
        close = met
        for x, n in zip((left, right), "12"):
            close = close.join(L.side(x.select("h", "core", "marks"), n), f"h{n}")
        parts.append(cut(close.mapInArrow(run, "h1 bigint, h2 bigint, cosine double, marks int")))
        del close
        drop_all(met)
    found = reduce(DataFrame.unionAll, parts).distinct()  # a pair of both shares is compared in each, and once is enough
    if top is not None:
        best = [F.rank().over(Window.partitionBy(c).orderBy(F.desc("cosine"))) for c in ("h1", "h2")]
        found = found.withColumns({"r1": best[0], "r2": best[1]}).where((F.col("r1") <= top) | (F.col("r2") <= top)).drop("r1", "r2")
    return found


def name_roles(words: list[str], *tables: DataFrame) -> Roles:
    """What the common words of names mean, from the parsed names of all tables."""
    rare = F.when(F.col("core") != "", F.xxhash64(F.array_sort(F.split("core", " ")))).alias("core")
    every = None
    for t in tables:
        one = t.where("core is not null").select(rare, "marks")
        every = one if every is None else every.unionAll(one)
    return learn(every, words)


def _merge_all(least: float):
    """Merges the clusters of edges (x, y, s, x1, x2, y1, y2), the nearest two first: (old, new)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near: dict[str, dict[str, float]] = {}
        size: dict[str, tuple[int, int]] = {}
        for b in batches:
            for x, y, s, *n in zip(*(b.column(c).to_pylist() for c in ("x", "y", "s", "x1", "x2", "y1", "y2"))):
                near.setdefault(x, {})[y] = near.setdefault(y, {})[x] = s
                size[x], size[y] = tuple(n[:2]), tuple(n[2:])
        mean = lambda x, y: near[x][y] / (size[x][0] * size[y][1] + size[x][1] * size[y][0])
        heap = [(-m, x, y) for x in near for y in near[x] if x < y and (m := mean(x, y)) >= least]
        heapq.heapify(heap)
        into: dict[str, str] = {}
        while heap:
            m, x, y = heapq.heappop(heap)
            if y not in near.get(x, ()) or mean(x, y) != -m:
                continue
            for z, s in near.pop(y).items():
                del near[z][y]
                if z != x:
                    near[x][z] = near[z][x] = near[x].get(z, 0.0) + s
            size[x] = (size[x][0] + size[y][0], size[x][1] + size[y][1])
            into[y] = x
            for z in near[x]:
                if (m := mean(x, z)) >= least:
                    heapq.heappush(heap, (-m, min(x, z), max(x, z)))
        old = list(into)
        for k in old:
            while into[k] in into:
                into[k] = into[into[k]]
        yield pa.RecordBatch.from_arrays([pa.array(old, pa.string()), pa.array([into[k] for k in old], pa.string())], ["old", "new"])

    return run


def average_linkage(edges: DataFrame, least: float) -> DataFrame:
    """(node, cluster) from edges (a, b, s) between nodes of two kinds, a of the first and b of the second; nodes are strings.

    The similarity of two clusters is the mean over all pairs of nodes of different kinds, 0 for pairs without an edge. An edge
    carries the sizes of both its clusters, so a round touches the edges left and the clusters that move, not all nodes.
    """
    first = F.col("a") < F.col("b")
    one = lambda c: F.when(c, 1).otherwise(0)
    at = edges.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"), "s", one(first).alias("x1"), one(~first).alias("x2"), one(~first).alias("y1"), one(first).alias("y2"))
    member = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("cluster", F.col("node"))
    mean = F.col("s") / (F.col("x1") * F.col("y2") + F.col("x2") * F.col("y1"))
    moved = lambda moves: member.join(moves.select("old", "new"), F.col("cluster") == F.col("old"), "left").select("node", F.coalesce("new", "cluster").alias("cluster"))
    counted = at.agg(F.count("*").alias("n"), F.count_if(mean >= least).alias("above")).first()
    if counted.n <= 2 * REST:
        return moved(cut(at.coalesce(1).mapInArrow(_merge_all(least), "old string, new string")))
    left = counted.above
    for _ in range(ROUNDS):
        good = at.withColumn("mean", mean).where(F.col("mean") >= least)
        if left <= REST:  # an edge can only rise above the threshold by a merge if both its ends have one above it
            tips = good.select(F.explode(F.array("x", "y")).alias("t")).distinct()
            seen = Observation()
            rest = cut(at.join(tips, F.col("x") == F.col("t"), "left_semi").join(tips, F.col("y") == F.col("t"), "left_semi"), seen, F.count("*").alias("n"))
            if seen.get["n"] <= 2 * REST:
                return moved(cut(rest.coalesce(1).mapInArrow(_merge_all(least), "old string, new string")))
        ends = [("x", "x1", "x2", "y1", "y2"), ("y", "y1", "y2", "x1", "x2")]
        each = good.select(F.explode(F.array(*[F.struct(F.col(n).alias("node"), F.struct(F.col(a).alias("n1"), F.col(b).alias("n2"), F.col(c).alias("w1"), F.col(d).alias("w2")).alias("z")) for n, a, b, c, d in ends])).alias("e"), F.struct("mean", "x", "y").alias("r"))
        best = each.groupBy("e.node").agg(F.max(F.struct("r", "e.z")).alias("b")).select("node", "b.r.x", "b.r.y", "b.z.*")
        # both ends must agree; the later one moves
        agreed = best.groupBy("x", "y").agg(F.count("*").alias("k"), F.max_by(F.struct("n1", "n2", "w1", "w2"), "node").alias("z")).where("k = 2")
        moves = agreed.select(F.col("y").alias("old"), F.col("x").alias("new"), "z.*")
        seen = Observation()
        moves = cut(moves, seen, F.count("*").alias("n"))
        if not seen.get["n"]:
            return member
        grown = moves.groupBy("new").agg((F.sum("n1") + F.max("w1")).alias("m1"), (F.sum("n2") + F.max("w2")).alias("m2"))
        now = moves.select("old", "new").join(grown, "new").select(F.col("old").alias("was"), "new", "m1", "m2").unionAll(grown.select("new", F.col("new").alias("k"), "m1", "m2"))
        member = moved(moves)
        for c in "xy":
            at = at.join(L.side(now, c), F.col(c) == F.col(f"was{c}"), "left")
        p, q = F.coalesce("newx", "x"), F.coalesce("newy", "y")
        size = {f"{c}{i}": F.coalesce(F.col(f"m{i}{c}"), F.col(f"{c}{i}")) for c in "xy" for i in (1, 2)}
        turned = [F.when(p > q, size[f"{d}{i}"]).otherwise(size[f"{c}{i}"]).alias(f"{c}{i}") for c, d in (("x", "y"), ("y", "x")) for i in (1, 2)]
        above = Observation()
        at = cut(at.where(p != q).select(F.least(p, q).alias("x"), F.greatest(p, q).alias("y"), "s", *turned).groupBy("x", "y").agg(F.sum("s").alias("s"), *[F.max(n).alias(n) for n in size]), above, F.count_if(mean >= least).alias("n"))
        left = above.get["n"]
    raise RuntimeError(f"average linkage: {left} edges above the threshold after {ROUNDS} rounds")


def same_name_pairs(df1: DataFrame, id1, df2: DataFrame, id2) -> DataFrame:
    """(id1, id2) of entities with spellings of the same name."""
    rows = [folded_records(df, id_col, address=False) for df, id_col in ((df1, id1), (df2, id2))]
    distinct = [cut(x.select("name").distinct()) for x in rows]
    ids = [cut(x.select("id", F.xxhash64("name").alias("h"))) for x in rows]
    drop_all(*rows)
    words = common_words(*distinct)
    parts = [parsed(x.withColumn("h", F.xxhash64("name")), words, None) for x in distinct]
    drop_all(*distinct)
    good = close_names(*parts, name_roles(words, *parts)).where("marks < 2")
    edges = cut(good.select(F.concat(F.lit("1"), F.hex("h1")).alias("a"), F.concat(F.lit("2"), F.hex("h2")).alias("b"), F.col("cosine").alias("s")))
    drop_all(*parts)
    clusters = average_linkage(edges, JOIN).select(F.left("node", F.lit(1)).alias("side"), F.conv(F.substring("node", 2, 16), 16, -10).cast("bigint").alias("h"), "cluster")
    clusters = cut(clusters)
    drop_cut(edges)
    of = lambda n: ids[int(n) - 1].join(clusters.where(F.col("side") == n), "h").select(F.col("id").alias(f"id{n}"), "cluster").distinct()
    return of("1").join(of("2"), "cluster").select("id1", "id2").distinct()
