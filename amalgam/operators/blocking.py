"""Candidates by shared blocking keys.

Keys are exploded and postings capped per key in order of arrival before the join (a hot key never meets the query side whole). A key's
list of targets goes once to each part of the queries that has it, and shared keys are counted and the best k of each query kept there, so
pairs are never written or shuffled. Ties: more shared keys first, then the earliest key kind, then the target that arrived first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from amalgam.functions.batches import ratios
from amalgam.functions.text import blocking_keys, text
from amalgam.sources.tables import cut, release, splits

FIELDS = ["business_name", "business_address", "country"]
CAP, TOP, HEAD = 2000, 50, 35
#: Pairs that a task counts at once (a single query may have more).
PAIRS = 1_000_000
#: What ids that are run together are parted by, and what stands before a letter for it.
APART, MARK = "\x00", "\x01"
POOL = "s_ord bigint, source1_entity_id string, candidate_entity_id string, n bigint, pos int, held int"
#: Pools by groups of queries: a query's candidates by their codes within the group, the best first, with the keys they share; or a code and the target it stands for.
PACKED = "group bigint, s_ord bigint, source1_entity_id string, code array<int>, n array<int>, candidate_entity_id string"
_PACKED = ["group", "s_ord", "source1_entity_id", "code", "n", "candidate_entity_id"]
LIMIT = "spark.sql.optimizer.windowGroupLimitThreshold"


def entities(df: DataFrame, *more: str) -> DataFrame:
    """(ord, entity_id, business_name, business_address, country): missing texts empty, rows without an id left out."""
    return df.select("ord", text(F.col("entity_id")).alias("entity_id"), *[text(F.col(c)).alias(c) for c in FIELDS], *more).where("entity_id <> ''")


def targets(*tables: DataFrame) -> DataFrame:
    """All rows of the tables; `ord` puts earlier tables first."""
    out = entities(tables[0])
    for t in tables[1:]:
        out = out.unionByName(entities(t))
    return out


def keyed(df: DataFrame) -> DataFrame:
    """(ord, entity_id, kind, key): one row for each key of each record."""
    keys = blocking_keys(F.col("business_name"), F.col("business_address"), F.col("country"))
    return df.select("ord", "entity_id", F.posexplode(keys).alias("kind", "key")).where("key is not null")


def capped(postings: DataFrame, cap: int = CAP) -> DataFrame:
    """The first `cap` postings of each key. Spark cuts hot keys before the shuffle only up to a threshold (1000), so the session's is raised to the cap."""
    conf = postings.sparkSession.conf
    conf.set(LIMIT, str(max(int(conf.get(LIMIT)), cap)))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("ord"))
    return postings.withColumn("rank", rank).where(F.col("rank") <= cap).drop("rank")


def histogram(postings: DataFrame, cap: int = CAP) -> DataFrame:
    """(size, keys, over): how many keys have each number of postings, and how many of them the cap cuts."""
    return postings.groupBy("key").count().groupBy(F.col("count").alias("size")).agg(F.count("*").alias("keys"), F.sum((F.col("count") > cap).cast("long")).alias("over"))


def index(target_rows: DataFrame, cap: int | None = CAP) -> DataFrame:
    """(key, ord, candidate_entity_id, head): the postings that candidates are looked up in, to be used at once or kept (sources.tsv).

    head: the beginning of the name that the id's last row has, for re-ranking. cap None: all postings, however many a key has.
    """
    keys = keyed(target_rows)
    kept = capped(keys, cap) if cap is not None else keys
    heads = target_rows.groupBy("entity_id").agg(F.max_by(F.left("business_name", F.lit(HEAD)), "ord").alias("head"))
    return kept.select("key", "ord", "entity_id").join(heads, "entity_id").select("key", "ord", F.col("entity_id").alias("candidate_entity_id"), "head")


def _plain(c: Column) -> Column:
    """An id without APART in it."""
    return F.replace(F.replace(c, F.lit(MARK), F.lit(MARK + "a")), F.lit(APART), F.lit(MARK + "b"))


def met(queries: DataFrame, postings: DataFrame, most: int | None = None) -> DataFrame:
    """(part, qs, ids, run together): for each key and each part of the queries, those that have it and, once for all of them, its targets in order of arrival.

    Pairs aren't made here: a query's part receives each list once, however many of its queries share the key. most: only so many different ids of each key (counted()).
    """
    left = keyed(queries).select("key", _part(queries), F.struct(F.col("ord").alias("s_ord"), _plain(F.col("entity_id")).alias("id"), "kind").alias("q"))
    asked = left.repartition("key").groupBy("key", "part").agg(F.collect_list("q").alias("qs"))
    held = postings.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ord", F.col("candidate_entity_id").alias("id")))).alias("ids"))
    ids = F.slice(F.array_distinct("ids.id"), 1, most) if most else F.col("ids.id")
    return asked.join(held.select("key", F.array_join(F.transform(ids, _plain), APART).alias("ids")), "key").select("part", "qs", "ids")


def _part(queries: DataFrame) -> Column:
    return F.pmod(F.xxhash64("ord"), F.lit(parts(queries))).alias("part")


def parts(df: DataFrame) -> int:
    """Parts into which queries are dealt: some for each core, and as many more as the data has; fewer parts receive fewer copies of a list."""
    spark = df.sparkSession
    return max(2 * spark.sparkContext.defaultParallelism, splits(spark) // 4)


def _tops(k: int, listed: bool = False, packed: bool = False):
    """Rows of met() of whole parts -> the k best candidates of each query; listed: as a comma list for each query; packed: as PACKED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code: dict[str, int] = {}

        def coded(ids: pa.Array) -> np.ndarray:
            own = ids.dictionary_encode()
            at = np.fromiter((code.setdefault(x, len(code)) for x in own.dictionary.to_pylist()), np.int32, len(own.dictionary))
            return at[own.indices.to_numpy()]

        lists, sizes, ord_, own_id, kind, of, base, group = [], [], [], [], [], [], 0, None
        for b in batches:
            if group is None and b.num_rows:  # a part is in one task only, so it tells tasks apart
                group = b.column("part")[0].as_py()
            qs, ids = b.column("qs"), pc.split_pattern(b.column("ids"), APART)
            q = qs.flatten()
            lists.append(coded(ids.flatten()))
            sizes.append(np.diff(ids.offsets.to_numpy()))
            of.append(base + np.repeat(np.arange(b.num_rows), np.diff(qs.offsets.to_numpy())))
            ord_.append(q.field("s_ord").to_numpy(zero_copy_only=False)), own_id.append(coded(q.field("id"))), kind.append(q.field("kind").to_numpy(zero_copy_only=False))
            base += b.num_rows
        if not base:
            return
        lists, sizes, ord_, own_id, kind, of = (np.concatenate(x) for x in (lists, sizes, ord_, own_id, kind, of))
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        order = np.lexsort((kind, own_id, ord_))
        ord_, own_id, kind, of = ord_[order], own_id[order], kind[order].astype(np.int64), of[order]
        new = np.concatenate([[True], (ord_[1:] != ord_[:-1]) | (own_id[1:] != own_id[:-1])])
        query = np.cumsum(new) - 1
        ends = np.append(np.flatnonzero(new)[1:], len(ord_))  # of each query's keys
        total = np.cumsum(sizes[of])[ends - 1]
        used = np.zeros(len(code), bool)
        names = np.array([x.replace(MARK + "b", APART).replace(MARK + "a", MARK) if MARK in x else x for x in code], object)
        done = row = 0
        while done < len(ends):
            upto = max(done + 1, int(np.searchsorted(total, (total[done - 1] if done else 0) + PAIRS, "right")))
            at = slice(row, ends[upto - 1])
            n = sizes[of[at]]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            other = lists[np.repeat(starts[of[at]], n) + place]
            mine = np.repeat(np.arange(at.start, at.stop), n)
            keep = (other != own_id[mine]) & (kind[mine] >= 0)
            mine, other, place = mine[keep], other[keep].astype(np.int64), place[keep]
            pair = (query[mine] - done << 32) | other
            by = np.argsort(pair, kind="stable")
            pair, first = pair[by], ((kind[mine] << 32) | place)[by]
            head = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.empty(0, np.int64)
            count = np.diff(np.append(head, len(pair)))
            first = np.minimum.reduceat(first, head) if len(head) else first
            q, other = pair[head] >> 32, pair[head] & 0xFFFFFFFF
            by = np.lexsort((first, -count, q))
            q, other, count = q[by], other[by], count[by]
            begin = np.searchsorted(q, np.arange(upto - done))
            pos = np.arange(len(q)) - begin[q] + 1
            held = np.minimum(np.diff(np.append(begin, len(q))), k)[q]
            best = pos <= k
            if listed:
                each = pa.ListArray.from_arrays(pa.array(np.searchsorted(q[best], np.arange(upto - done + 1)), pa.int32()), pa.array(names[other[best]], pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array(names[own_id[ends[done:upto] - 1]], pa.string()), pc.binary_join(each, ",")], ["source1_entity_id", "ids"])
                done, row = upto, int(ends[upto - 1])
                continue
            if packed:
                used[other[best]] = True
                key, upto_ = ends[done:upto] - 1, pa.array(np.searchsorted(q[best], np.arange(upto - done + 1)), pa.int32())
                each = [pa.ListArray.from_arrays(upto_, pa.array(x[best], pa.int32())) for x in (other, count)]
                rows = pa.RecordBatch.from_arrays([pa.array(np.full(len(key), group), pa.int64()), pa.array(ord_[key], pa.int64()), pa.array(names[own_id[key]], pa.string()), *each, pa.nulls(len(key), pa.string())], _PACKED)
                yield rows.filter(pc.greater(pc.list_value_length(each[0]), 0))
                done, row = upto, int(ends[upto - 1])
                continue
            key = ends[done:upto][q[best]] - 1
            out = [pa.array(ord_[key], pa.int64()), pa.array(names[own_id[key]], pa.string()), pa.array(names[other[best]], pa.string()), pa.array(count[best], pa.int64()), pa.array(pos[best], pa.int32()), pa.array(held[best], pa.int32())]
            yield pa.RecordBatch.from_arrays(out, ["s_ord", "source1_entity_id", "candidate_entity_id", "n", "pos", "held"])
            done, row = upto, int(ends[upto - 1])
        for at in np.array_split(np.flatnonzero(used), used.sum() // PAIRS + 1):
            ones = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1), pa.int32()), pa.array(at, pa.int32()))
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), group), pa.int64()), pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.string()), ones, pa.nulls(len(at), pa.list_(pa.int32())), pa.array(names[at], pa.string())], _PACKED)

    return run


def _again(k: int):
    """Rows (group, s_ord, source1_entity_id, code, n, candidate_entity_id, head) of whole groups -> the k best candidates of each query by shared keys and likeness of names.

    A row with n is a query's pool, one with a candidate_entity_id a target's code and head, any other the head of a query.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, own_head, its = [], {}, {}
        for b in batches:
            pool = pc.is_valid(b.column("n"))
            asked.append(b.filter(pool))
            rest = b.filter(pc.invert(pool))
            for g, o, c, t, h in zip(*(rest.column(x).to_pylist() for x in ("group", "s_ord", "code", "candidate_entity_id", "head"))):
                if t is None:
                    own_head[o] = h
                else:
                    its[g, c[0]] = (t, h or "")
        for whole in asked:
            for at in range(0, whole.num_rows, max(1, PAIRS // (8 * k))):
                b = whole.slice(at, max(1, PAIRS // (8 * k)))
                if not b.num_rows:
                    continue
                size = pc.list_value_length(b.column("n")).to_numpy()
                q = np.repeat(np.arange(b.num_rows), size)
                r1 = np.arange(len(q)) - np.repeat(np.cumsum(size) - size, size)
                n = b.column("n").flatten().to_numpy()
                groups, ords = b.column("group").to_pylist(), b.column("s_ord").to_pylist()
                found = [its[groups[i], c] for i, c in zip(q.tolist(), b.column("code").flatten().to_pylist())]
                like, many = np.zeros(len(q)), np.flatnonzero(size[q] > k)
                if len(many):
                    like[many] = ratios([own_head[ords[i]] for i in q[many].tolist()], [found[i][1] for i in many.tolist()])
                by = np.lexsort((r1, -like, -n, q))
                by = by[r1 < k]  # q is in order, so places within a query stay
                out = [pa.array([ords[i] for i in q[by].tolist()], pa.int64()), b.column("source1_entity_id").take(pa.array(q[by])), pa.array([found[i][0] for i in by.tolist()], pa.string()), pa.array(n[by], pa.int64()), pa.array(r1[r1 < k] + 1, pa.int32())]
                yield pa.RecordBatch.from_arrays(out, ["s_ord", "source1_entity_id", "candidate_entity_id", "n", "pos"])

    return run


def pools(queries: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """(s_ord, source1_entity_id, candidate_entity_id, n, pos, held): the k candidates with most shared keys, pos from 1, and how many of them a query has.

    A target id that stands twice under a key counts twice. Ties: the one that a scan of the query's keys would meet first.
    """
    each = met(queries, postings).repartition(parts(queries), "part")
    return each.mapInArrow(_tops(k), POOL)


def candidate_lists(queries: DataFrame, target_rows: DataFrame, k: int = TOP, cap: int | None = CAP, name: str = "candidate_entity_ids") -> DataFrame:
    """lists() of candidates(), made where the candidates are ranked: each query goes to its part with its keys and once without one, and no list is shuffled."""
    own = queries.select(_part(queries), F.array(F.struct(F.col("ord").alias("s_ord"), _plain(F.col("entity_id")).alias("id"), F.lit(-1).alias("kind"))).alias("qs"), F.lit("").alias("ids"))
    each = met(queries, plain_index(target_rows, cap)).unionAll(own).repartition(parts(queries), "part")
    return each.mapInArrow(_tops(k, True), "source1_entity_id string, ids string").withColumnRenamed("ids", name)


def ranked(queries: DataFrame, postings: DataFrame, k: int = TOP) -> DataFrame:
    """(s_ord, source1_entity_id, candidate_entity_id, n, pos): the k candidates with most shared keys, pos from 1."""
    return pools(queries, postings, k).drop("held")


def plain_index(target_rows: DataFrame, cap: int | None = CAP) -> DataFrame:
    """The postings without heads, where names aren't compared."""
    keys = keyed(target_rows)
    return (capped(keys, cap) if cap is not None else keys).select("key", "ord", F.col("entity_id").alias("candidate_entity_id"))


def candidates(queries: DataFrame, target_rows: DataFrame, k: int = TOP, cap: int | None = CAP) -> DataFrame:
    """ranked() over an index made for this once."""
    return ranked(queries, plain_index(target_rows, cap), k)


def reranked_by(queries: DataFrame, postings: DataFrame, heads: DataFrame, k: int = TOP) -> DataFrame:
    """As ranked(), but a query with more than k candidates has its best 2k ordered again by shared keys and likeness of names.

    heads: (candidate_entity_id, head2), one for each id. A part's pools are written once, as numbers that stand for its targets, and each target's
    head goes once to each part that has it in a pool; names are compared there, so no pair is shuffled with its names.
    """
    each = met(queries, postings).repartition(parts(queries), "part")
    packed = cut(each.mapInArrow(_tops(2 * k, packed=True), PACKED))
    del each  # or its shuffles would stay
    release(packed.sparkSession)
    pool, code = packed.where("n is not null"), packed.where("n is null")
    named = cut(code.join(heads, "candidate_entity_id", "left").select(*_PACKED, F.col("head2").alias("head")))
    release(packed.sparkSession)
    own = pool.select("group", "s_ord").join(queries.select(F.col("ord").alias("s_ord"), F.left("business_name", F.lit(HEAD)).alias("head")), "s_ord")
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in packed.schema}
    own = own.select(*[own[c] if c in ("group", "s_ord") else none[c] for c in _PACKED], "head")
    every = pool.withColumn("head", F.lit(None).cast("string")).unionAll(named).unionAll(own).repartition(4 * parts(queries), "group")  # so that few tasks have several groups
    return every.mapInArrow(_again(k), "s_ord bigint, source1_entity_id string, candidate_entity_id string, n bigint, pos int")


def heads_of(target_rows: DataFrame) -> DataFrame:
    return target_rows.groupBy(F.col("entity_id").alias("candidate_entity_id")).agg(F.max_by(F.left("business_name", F.lit(HEAD)), "ord").alias("head2"))


def reranked(queries: DataFrame, target_rows: DataFrame, k: int = TOP, cap: int | None = CAP) -> DataFrame:
    """reranked_by() over an index made for this once."""
    return reranked_by(queries, plain_index(target_rows, cap), heads_of(target_rows), k)


def search(queries: DataFrame, kept: DataFrame, k: int = TOP, rerank: bool = True) -> DataFrame:
    """candidates() or reranked() from an index that was kept, without the targets themselves."""
    if not rerank:
        return ranked(queries, kept, k)
    heads = kept.select("candidate_entity_id", F.col("head").alias("head2")).dropDuplicates(["candidate_entity_id"])
    return reranked_by(queries, kept, heads, k)


def lists(queries: DataFrame, pairs: DataFrame, name: str = "candidate_entity_ids") -> DataFrame:
    """(source1_entity_id, <name>): a comma list for each query row, empty where there are no pairs."""
    gathered = pairs.groupBy("s_ord").agg(F.array_sort(F.collect_list(F.struct("pos", "candidate_entity_id"))).alias("xs"))
    joined = F.array_join(F.transform("xs", lambda x: x["candidate_entity_id"]), ",")
    return queries.select(F.col("ord").alias("s_ord"), F.col("entity_id").alias("source1_entity_id")).join(gathered, "s_ord", "left").select("source1_entity_id", F.coalesce(joined, F.lit("")).alias(name))


def counted(queries: DataFrame, target_rows: DataFrame, k: int = TOP, cap: int | None = CAP) -> DataFrame:
    """Pairs of which each query has as many as of candidates(), for stats().

    A key with more than k different targets gives each of its queries k candidates or more, whichever they are, so k + 1 of them (one may be the query itself)
    are sent; a query whose keys all have fewer meets all their targets.
    """
    each = met(queries, plain_index(target_rows, cap), k + 1).repartition(parts(queries), "part")
    return each.mapInArrow(_tops(k), POOL)


def stats(queries: DataFrame, pairs: DataFrame, k: int = TOP) -> DataFrame:
    """One row: queries with and without candidates, and mean, median and most candidates of those that have some. pairs: candidates() or counted()."""
    per = pairs.groupBy("s_ord").agg(F.least(F.count("*"), F.lit(k)).alias("c"))
    both = queries.select(F.col("ord").alias("s_ord")).join(per, "s_ord", "left")
    share = 100 * F.count("c") / F.greatest(F.count("*"), F.lit(1))
    return both.agg(F.count("*").alias("total"), F.count("c").alias("with_candidates"), (F.count("*") - F.count("c")).alias("without_candidates"), share.alias("percent"), F.avg("c").alias("mean"), F.median("c").alias("median"), F.max("c").alias("most"))


def recall(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """One row (hits, positives, recall); truth: distinct (source1_entity_id, candidate_entity_id). Candidates of queries that truth doesn't name aren't needed (asked_about)."""
    known = pairs.select("source1_entity_id", "candidate_entity_id").distinct().withColumn("hit", F.lit(1))
    both = truth.distinct().join(known, ["source1_entity_id", "candidate_entity_id"], "left")
    return both.agg(F.count("hit").alias("hits"), F.count("*").alias("positives"), F.try_divide(F.count("hit").cast("double"), F.count("*")).alias("recall"))


def asked_about(queries: DataFrame, truth: DataFrame) -> DataFrame:
    """The queries that truth names: only their candidates can be hits."""
    return queries.join(truth.select(F.col("source1_entity_id").alias("entity_id")).distinct(), "entity_id", "left_semi").select(*queries.columns)
