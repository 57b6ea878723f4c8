"""Queries over the record tables for each operator of the linkage pipeline, and the SQL they are compared with."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from amalgam.functions import similarity as S
from amalgam.functions import text as T
from amalgam.operators import blocking as B
from amalgam.operators import evaluate as E
from amalgam.operators import mining as M
from amalgam.operators import pairs as P
from amalgam.operators import validate as V
from amalgam.sources.tables import cut, release, shared_dir, table
from amalgam.sources.tsv import id_set, read_postings, row_range, write_postings

#: Postings of a key and candidates of a query, as in production.
CAP, TOP = B.CAP, B.TOP

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def s1(spark: SparkSession, d: str) -> DataFrame:
    return B.entities(table(spark, d, "test_source1"))


def s23(spark: SparkSession, d: str) -> DataFrame:
    return B.targets(table(spark, d, "test_source2"), table(spark, d, "test_source3"))


def candidate_pairs(spark: SparkSession, d: str) -> DataFrame:
    return P.explode_lists(table(spark, d, "v2_test_candidates"), "candidate_entity_ids")


def truth(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labelled_pairs").where("label = 1").select(*P.KEY).distinct()


# ---- SQL shared by the comparisons ----
FIELDS = "coalesce(business_name, '') AS business_name, coalesce(business_address, '') AS business_address, coalesce(country, '') AS country"
ENTITIES = f"""s1 AS (SELECT ord, entity_id, {FIELDS} FROM test_source1 WHERE coalesce(entity_id, '') <> ''),
s23 AS (SELECT ord, entity_id, {FIELDS} FROM test_source2 WHERE coalesce(entity_id, '') <> '' UNION ALL SELECT ord, entity_id, {FIELDS} FROM test_source3 WHERE coalesce(entity_id, '') <> '')"""


def norm(x: str) -> str:
    return f"regexp_replace({low(x)}, '[^a-z0-9]', '', 'g')"


STOP = "[" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "]"


def low(x: str) -> str:
    """lower() with the final sigma that the JVM writes."""
    return f"lower(regexp_replace({x}, '(\\p{{L}})Σ([^\\p{{L}}]|$)', '\\1ς\\2', 'g'))"


def words(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9]+'), lambda t: NOT list_contains({STOP}, t))"


def keys(source: str, out: str) -> str:
    """CTEs that give (ord, entity_id, kind, key)."""
    return f"""{out}_n AS (SELECT ord, entity_id, {norm('business_name')} AS n, {norm('business_address')} AS a, CASE WHEN {norm('trim(country)')} = '' THEN '_' ELSE {norm('trim(country)')} END AS c,
 {words('business_name')} AS w, ltrim(regexp_extract(business_address, '(\\p{{Nd}}+)', 1), '0') AS num FROM {source}),
{out}_a AS (SELECT ord, entity_id, [CASE WHEN n <> '' THEN c || '_n6_' || left(n, 6) END, CASE WHEN a <> '' THEN c || '_a6_' || left(a, 6) END,
 CASE WHEN n <> '' AND a <> '' THEN c || '_n3a3_' || left(n, 3) || '_' || left(a, 3) END, CASE WHEN length(w[1]) >= 3 THEN c || '_t1_' || left(w[1], 6) END,
 CASE WHEN len(w) >= 2 THEN c || '_s2_' || left(list_sort(w[1:2])[1], 4) || '_' || left(list_sort(w[1:2])[2], 4) END,
 CASE WHEN n <> '' AND num <> '' THEN c || '_num_' || num || '_' || left(n, 3) END] AS ks FROM {out}_n),
{out} AS (SELECT ord, entity_id, i - 1 AS kind, ks[i] AS key FROM {out}_a, unnest(range(1, 7)) AS r(i) WHERE ks[i] IS NOT NULL)"""


POSTINGS = f"{ENTITIES}, {keys('s23', 'tk')}, post AS (SELECT * FROM tk QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) <= {CAP})"
OVERLAPS = f"""{POSTINGS}, {keys('s1', 'sk')}, met AS (SELECT sk.ord AS s_ord, sk.entity_id AS source1_entity_id, post.entity_id AS candidate_entity_id, count(*) AS n, min(struct_pack(k := sk.kind, o := post.ord)) AS first
 FROM sk JOIN post ON sk.key = post.key WHERE sk.entity_id <> post.entity_id GROUP BY 1, 2, 3),
cands AS (SELECT s_ord, source1_entity_id, candidate_entity_id, n, row_number() OVER (PARTITION BY s_ord, source1_entity_id ORDER BY n DESC, first) AS pos FROM met QUALIFY pos <= {TOP})"""
PAIRS = """pairs AS (SELECT source1_entity_id, trim(ids[i]) AS candidate_entity_id, i AS pos FROM
 (SELECT source1_entity_id, string_split(coalesce(candidate_entity_ids, ''), ',') AS ids FROM v2_test_candidates), unnest(range(1, len(ids) + 1)) AS r(i) WHERE trim(ids[i]) NOT IN ('', 'nan'))"""
JOINED = f"""{ENTITIES}, {PAIRS}, joined AS (SELECT p.*, a.business_name AS n1, a.business_address AS a1, a.country AS c1, b.business_name AS n2, b.business_address AS a2, b.country AS c2
 FROM pairs p JOIN s1 a ON a.entity_id = p.source1_entity_id JOIN s23 b ON b.entity_id = p.candidate_entity_id)"""
TRUTH = "truth AS (SELECT DISTINCT source1_entity_id, candidate_entity_id FROM labelled_pairs WHERE label = 1)"
W = r"\p{L}\p{M}\p{N}\p{Pc}\x{200C}\x{200D}"


def expanded(x: str) -> str:
    """Words and what is between them, each word of the table replaced (word boundaries as in Unicode, which RE2's \\b isn't)."""
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.ABBREVIATIONS.items() if k[0:4] != "soln") + " WHEN 'soln' THEN 'solution'"
    return f"trim(regexp_replace(array_to_string(list_transform(regexp_extract_all({low(x)}, '[{W}]+|[^{W}]+'), lambda t: CASE t {cases} ELSE t END), ''), '[\\t\\n\\x0B\\f\\r \\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+', ' ', 'g'))"


def tset(x: str) -> str:
    return f"list_distinct(list_filter(string_split({expanded(x)}, ' '), lambda t: t <> ''))"


def jac(a: str, b: str) -> str:
    inter, union = f"len(list_intersect({a}, {b}))", f"len(list_distinct(list_concat({a}, {b})))"
    return f"CASE WHEN {union} = 0 THEN 1.0::DOUBLE ELSE {inter}::DOUBLE / {union} END"


def ngrams(x: str, n: int) -> str:
    return f"list_distinct(list_transform(range(1, length({x}) - {n - 2}), lambda i: substr({x}, i, {n})))"


def lcs_ratio(a: str, b: str) -> str:
    """2 LCS / (len a + len b) by the rows of the table of lengths: the first row is zeros, each character of a gives the next one."""
    row = f"list_reduce(list_prepend([0]::INT[], list_transform(range(1, length({b}) + 1), lambda j: [j::INT])), lambda r, j: list_append(r, CASE WHEN unicode(substr({b}, j[1], 1)) = c[1] THEN acc[j[1]] + 1 ELSE greatest(acc[j[1] + 1], r[-1]) END))"
    chars = f"list_transform(range(1, length({a}) + 1), lambda i: [unicode(substr({a}, i, 1))])"
    table = f"list_reduce(list_prepend(list_transform(range(0, length({b}) + 1), lambda j: 0), {chars}), lambda acc, c: {row})"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE 2 * ({table})[-1]::DOUBLE / (length({a}) + length({b})) END"


def sorted_words(x: str) -> str:
    spaces = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
    return f"array_to_string(list_sort(list_filter(regexp_split_to_array({x}, '{spaces}'), lambda t: t <> '')), ' ')"


def jaro_winkler(a: str, b: str) -> str:
    """DuckDB compares bytes, so the characters of each pair are first written as one byte each."""
    chars = f"list_distinct(string_split({a} || {b}, ''))"
    one = "'" + "".join(chr(c) for c in range(33, 127)).replace("'", "''") + "'"
    to = lambda x: f"translate({x}, array_to_string({chars}, ''), substr({one}, 1, len({chars})))"
    return f"CASE WHEN {a} = {b} THEN 1.0::DOUBLE WHEN {a} = '' OR {b} = '' THEN 0.0::DOUBLE ELSE jaro_winkler_similarity({to(a)}, {to(b)}) END"


HEADS = f"(SELECT entity_id, arg_max(left(business_name, {B.HEAD}), ord) AS head FROM s23 GROUP BY 1)"
POOLS = f"""{OVERLAPS}, pool AS (SELECT *, count(*) OVER (PARTITION BY s_ord, source1_entity_id) AS held FROM (SELECT s_ord, source1_entity_id, candidate_entity_id, n, row_number() OVER (PARTITION BY s_ord, source1_entity_id ORDER BY n DESC, first) AS r1 FROM met QUALIFY r1 <= 2 * {TOP})),
few AS (SELECT s_ord, source1_entity_id, candidate_entity_id, n, r1 AS pos FROM pool WHERE held <= {TOP}),
heads AS (SELECT p.*, left(s1.business_name, {B.HEAD}) AS h1, t.head AS h2 FROM pool p JOIN s1 ON s1.ord = p.s_ord JOIN {HEADS} t ON t.entity_id = p.candidate_entity_id WHERE held > {TOP}),
likes AS MATERIALIZED (SELECT h1, h2, {lcs_ratio('h1', 'h2')} AS sim FROM (SELECT DISTINCT h1, h2 FROM heads)), again AS (SELECT heads.*, sim FROM heads JOIN likes USING (h1, h2))"""


# ---- scans ----
@query(f"WITH {ENTITIES} SELECT * FROM s1")
def entity_scan(spark, d):
    return s1(spark, d)


@query(f"WITH {ENTITIES} SELECT * FROM s23")
def target_union(spark, d):
    return s23(spark, d)


@query(f"WITH {ENTITIES} SELECT * FROM s1 ORDER BY ord LIMIT 500 OFFSET 100")
def entity_range(spark, d):
    return row_range(s1(spark, d), 100, 500)


@query("SELECT DISTINCT trim(entity_id) AS entity_id FROM test_source2 WHERE trim(entity_id) <> ''")
def entity_id_set(spark, d):
    return id_set(table(spark, d, "test_source2"), "entity_id")


@query(f"SELECT source1_entity_id, candidate_entity_id, pos FROM (WITH {PAIRS} SELECT * FROM pairs)")
def explode_candidates(spark, d):
    return candidate_pairs(spark, d)


@query("""SELECT DISTINCT source1_entity_id, m AS matched_entity_id FROM (SELECT source1_entity_id, trim(unnest(string_split(coalesce(matched_entity_ids, ''), ','))) AS m FROM matching_results) WHERE m NOT IN ('', 'nan')""")
def ground_truth_scan(spark, d):
    return P.explode_lists(table(spark, d, "matching_results"), "matched_entity_ids", "matched_entity_id").drop("pos").distinct()


# ---- text ----
@query(f"WITH {ENTITIES} SELECT ord, {norm('business_name')} AS name, {norm('business_address')} AS address, {norm('trim(country)')} AS country FROM s1")
def normalize_text(spark, d):
    return s1(spark, d).select("ord", T.normalize(F.col("business_name")).alias("name"), T.normalize(F.col("business_address")).alias("address"), T.normalize(F.trim("country")).alias("country"))


@query(f"WITH {ENTITIES} SELECT ord, array_to_string({words('business_name')}, ' ') AS tokens FROM s23")
def name_tokens(spark, d):
    return s23(spark, d).select("ord", F.array_join(T.name_tokens(F.col("business_name")), " ").alias("tokens"))


@query(f"WITH {ENTITIES} SELECT ord, {expanded('business_name')} AS name, {expanded('business_address')} AS address FROM s1")
def expand_abbrev(spark, d):
    return s1(spark, d).select("ord", T.expand_abbreviations(F.col("business_name")).alias("name"), T.expand_abbreviations(F.col("business_address")).alias("address"))


@query(f"WITH {ENTITIES}, {keys('s1', 'sk')} SELECT ord, kind, key FROM sk")
def blocking_keys(spark, d):
    return B.keyed(s1(spark, d)).select("ord", "kind", "key")


# ---- blocking ----
@query(f"WITH {POSTINGS} SELECT key, kind, ord, entity_id FROM post")
def postings_capped(spark, d):
    return B.capped(B.keyed(s23(spark, d)), CAP).select("key", "kind", "ord", "entity_id")


@query(f"WITH {POSTINGS}, h AS (SELECT key, count(*) AS size FROM tk GROUP BY key) SELECT size, count(*) AS keys, sum(CASE WHEN size > {CAP} THEN 1 ELSE 0 END)::BIGINT AS over FROM h GROUP BY size")
def block_histogram(spark, d):
    return B.histogram(B.keyed(s23(spark, d)), CAP)


@query(f"WITH {OVERLAPS} SELECT s_ord, source1_entity_id, candidate_entity_id, n, pos FROM cands")
def candidates_one_stage(spark, d):
    return B.candidates(s1(spark, d), s23(spark, d), TOP, CAP)


@query(f"WITH {OVERLAPS} SELECT s_ord, source1_entity_id, candidate_entity_id, n, pos FROM cands")
def candidates_kept_index(spark, d):
    """As candidates_one_stage, from an index that was written and is read again."""
    at = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    write_postings(B.plain_index(s23(spark, d), CAP), at)
    release(spark)
    return B.search(s1(spark, d), read_postings(spark, at), TOP, rerank=False)


@query(f"""WITH {POOLS} SELECT s_ord, source1_entity_id, candidate_entity_id, n, pos FROM few
 UNION ALL SELECT s_ord, source1_entity_id, candidate_entity_id, n, row_number() OVER (PARTITION BY s_ord, source1_entity_id ORDER BY n DESC, sim DESC, r1) AS pos FROM again QUALIFY pos <= {TOP}""")
def candidates_two_stage(spark, d):
    return B.reranked(s1(spark, d), s23(spark, d), TOP, CAP)


@query(f"WITH {OVERLAPS}, l AS (SELECT s_ord, string_agg(candidate_entity_id, ',' ORDER BY pos) AS ids FROM cands GROUP BY s_ord) SELECT s1.entity_id AS source1_entity_id, coalesce(ids, '') AS candidate_entity_ids FROM s1 LEFT JOIN l ON l.s_ord = s1.ord")
def candidate_lists(spark, d):
    return B.candidate_lists(s1(spark, d), s23(spark, d), TOP, CAP)


@query(f"""WITH {OVERLAPS}, p AS (SELECT s_ord, least(count(*), {TOP}) AS c FROM cands GROUP BY s_ord), b AS (SELECT s1.ord, c FROM s1 LEFT JOIN p ON p.s_ord = s1.ord)
 SELECT count(*) AS total, count(c) AS with_candidates, count(*) - count(c) AS without_candidates, 100 * count(c) / greatest(count(*), 1) AS percent, avg(c) AS mean, quantile_cont(c, 0.5)::DOUBLE AS median, max(c) AS most FROM b""")
def blocking_stats(spark, d):
    return B.stats(s1(spark, d), B.counted(s1(spark, d), s23(spark, d), TOP, CAP), TOP)


@query(f"WITH {OVERLAPS}, {TRUTH}, k AS (SELECT DISTINCT source1_entity_id, candidate_entity_id, 1 AS hit FROM cands) SELECT count(hit) AS hits, count(*) AS positives, count(hit)::DOUBLE / count(*) AS recall FROM truth LEFT JOIN k USING (source1_entity_id, candidate_entity_id)")
def blocking_recall(spark, d):
    return B.recall(B.candidates(B.asked_about(s1(spark, d), truth(spark, d)), s23(spark, d), TOP, CAP), truth(spark, d))


# ---- pairs ----
def joined(spark, d, how="inner", table=None):
    return P.join_records(candidate_pairs(spark, d), s1(spark, d), s23(spark, d), how, table)


@query(f"WITH {JOINED} SELECT source1_entity_id, candidate_entity_id, pos, n1, a1, c1, n2, a2, c2 FROM joined")
def pair_join(spark, d):
    return joined(spark, d).toDF(*["candidate_entity_id", "source1_entity_id", "pos", "n1", "a1", "c1", "n2", "a2", "c2"])


@query(f"""WITH {ENTITIES}, {PAIRS} SELECT p.*, coalesce(a.business_name, '') AS n1, coalesce(b.business_name, '') AS n2, coalesce(a.country, '') AS c1, coalesce(b.country, '') AS c2
 FROM pairs p LEFT JOIN s1 a ON a.entity_id = p.source1_entity_id LEFT JOIN s23 b ON b.entity_id = p.candidate_entity_id""")
def pair_join_left(spark, d):
    j = joined(spark, d, "left")
    return j.select(*P.KEY, "pos", F.col("business_name_1").alias("n1"), F.col("business_name_2").alias("n2"), F.col("country_1").alias("c1"), F.col("country_2").alias("c2"))


def pair_query(name: str, column, sql: str | None, table: dict[str, str] | None = None) -> None:
    def run(spark, d):
        j = joined(spark, d, table=table)
        c = {k: F.col(v) for k, v in (("n1", "business_name_1"), ("n2", "business_name_2"), ("a1", "business_address_1"), ("a2", "business_address_2"), ("c1", "country_1"), ("c2", "country_2"))}
        if table:
            c |= {f"{w[0]}w{n}": F.col(f"{w}_{n}") for w in P.WORDS for n in (1, 2)}
        return j.select(*P.KEY, "pos", column(c).alias("value"))

    QUERIES[name] = run
    if sql:
        ORACLE[name] = f"WITH {JOINED} SELECT source1_entity_id, candidate_entity_id, pos, {sql} AS value FROM joined"


def squeezed(x: str) -> str:
    return f"replace({low(x)}, ' ', '')"


def spaced(x: str) -> str:
    return f"regexp_replace({low(x)}, '[\\t\\n\\x0B\\f\\r \\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]{{2,}}', ' ', 'g')"


BG1, BG2 = (ngrams(spaced(f"(n{i} || ' ' || a{i})"), 2) for i in (1, 2))
pair_query("sim_token_jaccard", lambda c: S.jaccard(c["nw1"], c["nw2"]), jac(tset("n1"), tset("n2")), T.ABBREVIATIONS)
pair_query("sim_address_jaccard", lambda c: S.jaccard(c["aw1"], c["aw2"]), jac(tset("a1"), tset("a2")), T.ABBREVIATIONS)
pair_query("sim_trigram_jaccard", lambda c: S.trigram_jaccard(c["n1"], c["n2"]), jac(ngrams(squeezed("n1"), 3), ngrams(squeezed("n2"), 3)))
pair_query("sim_bigram_dice", lambda c: S.bigram_dice(F.concat(c["n1"], F.lit(" "), c["a1"]), F.concat(c["n2"], F.lit(" "), c["a2"])), f"2 * len(list_intersect({BG1}, {BG2})) / (len({BG1}) + len({BG2}) + 1e-8)")
pair_query("name_len_ratio", lambda c: S.length_ratio(c["n1"], c["n2"]), "length(n1)::DOUBLE / greatest(length(n2), 1)")
pair_query("addr_len_ratio", lambda c: S.length_ratio(c["a1"], c["a2"]), "length(a1)::DOUBLE / greatest(length(a2), 1)")
pair_query("token_overlap", lambda c: S.token_overlap(c["nw1"], c["aw1"], c["nw2"], c["aw2"]), f"len(list_intersect(list_concat({tset('n1')}, {tset('a1')}), list_concat({tset('n2')}, {tset('a2')})))", T.ABBREVIATIONS)
pair_query("prefix4_match", lambda c: S.prefix_match(c["n1"], c["n2"], 4), "(left(n1, 4) = left(n2, 4) AND n1 <> '')::DOUBLE")
pair_query("prefix8_match", lambda c: S.prefix_match(c["n1"], c["n2"], 8), "(left(n1, 8) = left(n2, 8) AND n1 <> '')::DOUBLE")
pair_query("country_match", lambda c: S.same_country(c["c1"], c["c2"]), "(c1 = c2 AND c1 <> '')::DOUBLE")
pair_query("sim_ratio", lambda c: S.ratio(c["n1"], c["n2"]), lcs_ratio("n1", "n2"))
pair_query("sim_token_sort", lambda c: S.token_sort_ratio(c["n1"], c["n2"]), lcs_ratio(sorted_words("n1"), sorted_words("n2")))
pair_query("sim_jaro_winkler", lambda c: S.jaro_winkler(c["n1"], c["n2"]), jaro_winkler("n1", "n2"))
pair_query("sim_partial_token_set", lambda c: S.partial_token_set(c["n1"], c["n2"]), None)


TEXTS = f"""{JOINED}, d AS MATERIALIZED (SELECT DISTINCT source1_entity_id, candidate_entity_id, pos, n1, a1, n2, a2, n1 || ' ' || a1 AS text_1, n2 || ' ' || a2 AS text_2 FROM joined),
docs AS MATERIALIZED (SELECT text_1 AS t FROM d UNION ALL SELECT text_2 FROM d), times AS MATERIALIZED (SELECT t, count(*) AS m FROM docs GROUP BY t),
gs AS (SELECT t, m, unnest(list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3))) AS gram FROM (SELECT t, m, {spaced('t')} AS x FROM times)),
tf AS MATERIALIZED (SELECT t, m, gram, count(*) AS tf FROM gs GROUP BY ALL),
idf AS MATERIALIZED (SELECT gram, ln((1 + (SELECT count(*) FROM docs)) / (1 + sum(m))) + 1 AS idf FROM tf GROUP BY gram ORDER BY sum(tf * m) DESC, gram LIMIT 50000),
v AS MATERIALIZED (SELECT t, gram, tf * idf AS w FROM tf JOIN idf USING (gram)), norms AS MATERIALIZED (SELECT t, sqrt(sum(w * w)) AS norm FROM v GROUP BY t),
tp AS MATERIALIZED (SELECT DISTINCT text_1, text_2 FROM d), prod AS (SELECT text_1, text_2, sum(x.w * y.w) AS p FROM tp JOIN v x ON x.t = text_1 JOIN v y ON y.t = text_2 AND y.gram = x.gram GROUP BY 1, 2)"""


@query(f"""WITH {TEXTS} SELECT DISTINCT source1_entity_id, candidate_entity_id, round(coalesce(p / (a.norm * b.norm), 0), 6) AS tfidf_cosine, md5(text_1) AS t1, md5(text_2) AS t2
 FROM d LEFT JOIN prod USING (text_1, text_2) LEFT JOIN norms a ON a.t = text_1 LEFT JOIN norms b ON b.t = text_2""")
def tfidf_cosine(spark, d):
    t = lambda n: F.concat(f"business_name_{n}", F.lit(" "), f"business_address_{n}").alias(f"text_{n}")
    rows = joined(spark, d).select(*P.KEY, "pos", *[f"business_{x}_{n}" for x in ("name", "address") for n in (1, 2)], t(1), t(2)).distinct()
    return P.tfidf_cosine(rows.select(*P.KEY, "text_1", "text_2")).select(*P.KEY, F.round("tfidf_cosine", 6).alias("tfidf_cosine"), F.md5("text_1").alias("t1"), F.md5("text_2").alias("t2"))


@query()
def features_v1(spark, d):
    return P.features_v1(joined(spark, d, table=T.ABBREVIATIONS_V1)).select(*P.KEY, "pos", *P.V1)


@query()
def features_v2(spark, d):
    return P.features_v2(joined(spark, d)).select(*P.KEY, "pos", *P.V2)


# ---- training ----
LAST = """l1 AS (SELECT entity_id, arg_max(business_name, ord) AS n1, arg_max(business_address, ord) AS a1, arg_max(country, ord) AS c1 FROM s1 GROUP BY 1),
l2 AS (SELECT entity_id, arg_max(business_name, ord) AS n2, arg_max(business_address, ord) AS a2, arg_max(country, ord) AS c2 FROM s23 GROUP BY 1)"""
SCORED = f"""{ENTITIES}, {PAIRS}, {TRUTH}, {LAST}, marked AS (SELECT p.*, (t.source1_entity_id IS NOT NULL)::INTEGER AS label FROM pairs p LEFT JOIN truth t USING (source1_entity_id, candidate_entity_id)),
scored AS (SELECT m.*, 0.5::DOUBLE * ({jac(tset('n1'), tset('n2'))}) + 0.3::DOUBLE * ({jac(tset('a1'), tset('a2'))}) + 0.2::DOUBLE * (lower(c1) = lower(c2) AND c1 <> '')::DOUBLE AS difficulty
 FROM marked m JOIN l1 ON l1.entity_id = m.source1_entity_id JOIN l2 ON l2.entity_id = m.candidate_entity_id),
hard AS (SELECT source1_entity_id, candidate_entity_id, pos, label, round(difficulty, 9) AS difficulty FROM scored WHERE label = 0 ORDER BY scored.difficulty DESC, source1_entity_id DESC, pos DESC LIMIT 2 * (SELECT count(*) FROM marked WHERE label = 1))"""


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*P.KEY, "pos", "label", F.round("difficulty", 9).alias("difficulty"))


@query(f"WITH {SCORED} SELECT * FROM hard")
def hard_negatives(spark, d):
    return rounded(M.hard_negatives(candidate_pairs(spark, d), truth(spark, d), s1(spark, d), s23(spark, d)))


@query(f"WITH {SCORED} SELECT source1_entity_id, candidate_entity_id, pos, label, round(difficulty, 9) AS difficulty FROM scored WHERE label = 1 UNION ALL SELECT * FROM hard")
def training_set(spark, d):
    return rounded(M.training_set(candidate_pairs(spark, d), truth(spark, d), s1(spark, d), s23(spark, d)))


@query("SELECT sum(label)::BIGINT AS positives, (count(*) - sum(label))::BIGINT AS negatives, avg(label) AS mean_label, CASE WHEN sum(label) = 0 THEN 5.0 ELSE least((count(*) - sum(label)) / sum(label), 100.0) END AS weight FROM labelled_pairs")
def class_balance(spark, d):
    return M.class_balance(table(spark, d, "labelled_pairs"))


@query("SELECT source1_entity_id, candidate_entity_id, label, ((row_number() OVER (PARTITION BY label ORDER BY md5(source1_entity_id || '|' || candidate_entity_id), source1_entity_id, candidate_entity_id)) - 1) % 5 AS fold FROM labelled_pairs")
def stratified_folds(spark, d):
    return P.stratified_folds(table(spark, d, "labelled_pairs"))


def pseudo(spark, d):
    """Labels with two made-up probabilities that follow from the ids."""
    n = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("bigint")
    p1 = (n("source1_entity_id") * 37 % 101) / 100
    p2 = (n("candidate_entity_id") * 53 % 97) / 96
    return table(spark, d, "labelled_pairs").select("label", p1.alias("p1"), p2.alias("p2"))


GRID = "(VALUES " + ", ".join(f"({i}, {w}::DOUBLE, {t}::DOUBLE)" for i, (w, t) in enumerate((w, t) for w in E.WEIGHTS for t in E.THRESHOLDS)) + ") AS g(i, w, t)"
SCORES = f"""s AS (SELECT label, (regexp_extract(source1_entity_id, '([0-9]+)$', 1)::BIGINT * 37 % 101) / 100 AS p1, (regexp_extract(candidate_entity_id, '([0-9]+)$', 1)::BIGINT * 53 % 97) / 96 AS p2 FROM labelled_pairs),
y AS (SELECT i, w, t, label, (w * p1 + (1 - w) * p2 >= t)::INTEGER AS y FROM s, {GRID}),
c AS (SELECT i, w, t, sum((label = 1 AND y = 1)::INT) AS a, sum((label = 1 AND y = 0)::INT) AS b, sum((label = 0 AND y = 1)::INT) AS c, sum((label = 0 AND y = 0)::INT) AS d FROM y GROUP BY 1, 2, 3),
f AS (SELECT i, w, t, (CASE WHEN a + b + c > 0 THEN 1.25 * a / (1.25 * a + 0.25 * b + c) ELSE 0 END + CASE WHEN d + b + c > 0 THEN 1.25 * d / (1.25 * d + 0.25 * c + b) ELSE 0 END) / greatest((a + b + c > 0)::INT + (d + b + c > 0)::INT, 1) AS f_beta FROM c)"""


@query(f"WITH {SCORES} SELECT i, w, t, round(f_beta::DOUBLE, 9) AS f_beta FROM f")
def threshold_grid(spark, d):
    return E.grid_scores(pseudo(spark, d)).withColumn("f_beta", F.round("f_beta", 9))


@query(f"WITH {SCORES} SELECT w, t, round(f_beta::DOUBLE, 9) AS f_beta FROM f ORDER BY f.f_beta DESC, i LIMIT 1")
def best_config(spark, d):
    return E.best(E.grid_scores(pseudo(spark, d))).withColumn("f_beta", F.round("f_beta", 9))


@query(f"WITH {SCORES} SELECT round(f_beta::DOUBLE, 9) AS f_beta FROM f WHERE i = 14")
def fbeta_macro(spark, d):
    p = (0.5 * F.col("p1") + 0.5 * F.col("p2") >= 0.5).cast("int")
    return pseudo(spark, d).agg(F.round(E.macro_f_beta(F.col("label"), p), 9).alias("f_beta"))


FOLDS = f"""l AS (SELECT *, ((row_number() OVER (PARTITION BY label ORDER BY md5(source1_entity_id || '|' || candidate_entity_id), source1_entity_id, candidate_entity_id)) - 1) % 5 AS fold FROM labelled_pairs),
y AS (SELECT fold, label, (0.5 * ((regexp_extract(source1_entity_id, '([0-9]+)$', 1)::BIGINT * 37 % 101) / 100) + 0.5 * ((regexp_extract(candidate_entity_id, '([0-9]+)$', 1)::BIGINT * 53 % 97) / 96) >= 0.5)::INTEGER AS y FROM l),
c AS (SELECT fold, sum((label = 1 AND y = 1)::INT) AS a, sum((label = 1 AND y = 0)::INT) AS b, sum((label = 0 AND y = 1)::INT) AS c, sum((label = 0 AND y = 0)::INT) AS d FROM y GROUP BY 1),
f AS (SELECT (1.25 * a / (1.25 * a + 0.25 * b + c) + 1.25 * d / (1.25 * d + 0.25 * c + b)) / 2 AS f_beta FROM c)"""


@query(f"WITH {FOLDS} SELECT round(avg(f_beta)::DOUBLE, 9) AS mean, round(stddev_pop(f_beta)::DOUBLE, 9) AS deviation FROM f")
def cross_validation(spark, d):
    n = lambda c: F.regexp_extract(c, "([0-9]+)$", 1).cast("bigint")
    p = (0.5 * ((n("source1_entity_id") * 37 % 101) / 100) + 0.5 * ((n("candidate_entity_id") * 53 % 97) / 96) >= 0.5).cast("int")
    folds = P.stratified_folds(table(spark, d, "labelled_pairs")).withColumn("y", p)
    scores = folds.groupBy("fold").agg(E.macro_f_beta(F.col("label"), F.col("y")).alias("f_beta"))
    return E.cross_validation(scores).select(F.round("mean", 9).alias("mean"), F.round("deviation", 9).alias("deviation"))


@query()
def model_score(spark, d):
    """Both models fitted and tuned on four folds of the labelled pairs, scored on the fifth."""
    from amalgam.operators.model import train, tuned

    pairs = P.stratified_folds(table(spark, d, "labelled_pairs"))
    rows = cut(P.features_v1(P.join_records(pairs, P.last_by_id(s1(spark, d)), P.last_by_id(s23(spark, d)), table=T.ABBREVIATIONS_V1)).select(*P.KEY, "label", "fold", *P.V1))
    model = tuned(train(rows.where("fold < 4"), P.V1), rows.where("fold = 3"))
    return model.score(rows.where("fold = 4")).select(*P.KEY, "label", "probability", "is_match")


# ---- rules and results ----
RULED = f"""{ENTITIES}, {PAIRS}, j AS (SELECT p.*, lower(coalesce(a.business_name, '')) AS n1, lower(coalesce(b.business_name, '')) AS n2, lower(coalesce(a.country, '')) AS c1, lower(coalesce(b.country, '')) AS c2
 FROM pairs p LEFT JOIN s1 a ON a.entity_id = p.source1_entity_id LEFT JOIN s23 b ON b.entity_id = p.candidate_entity_id),
ruled AS (SELECT source1_entity_id, candidate_entity_id, pos, CASE WHEN abs(length(n1) - length(n2)) > 50 THEN 0 WHEN c1 <> c2 AND c1 <> '' AND c2 <> '' THEN 0 WHEN n1 = n2 AND n1 <> '' AND c1 = c2 AND c1 <> '' THEN 1
 ELSE (left(n1, 4) = left(n2, 4) AND n1 <> '')::INTEGER END AS is_match FROM j)"""


def ruled(spark, d):
    j = joined(spark, d, "left")
    guess = S.prefix_match(F.lower("business_name_1"), F.lower("business_name_2"), 4).cast("int")
    return j.select(*P.KEY, "pos", P.overridden(guess).alias("is_match"))


@query(f"WITH {RULED} SELECT * FROM ruled")
def rule_overrides(spark, d):
    return ruled(spark, d)


@query(f"WITH {RULED}, m AS (SELECT DISTINCT source1_entity_id, candidate_entity_id, pos FROM ruled WHERE is_match = 1), l AS (SELECT source1_entity_id, string_agg(candidate_entity_id, ',' ORDER BY pos) AS ids FROM m GROUP BY 1) SELECT q.source1_entity_id, coalesce(ids, '') AS matched_entity_ids FROM (SELECT DISTINCT entity_id AS source1_entity_id FROM s1) q LEFT JOIN l USING (source1_entity_id)")
def final_matches(spark, d):
    queries = s1(spark, d).select(F.col("entity_id").alias("source1_entity_id"))
    return P.match_lists(queries, ruled(spark, d).where("is_match = 1"))


# ---- validation ----
def results(spark, d):
    return table(spark, d, "matching_results")


IDS = "e AS (SELECT source1_entity_id, unnest(string_split(matched_entity_ids, ',')) AS id FROM matching_results WHERE coalesce(matched_entity_ids, '') <> '')"
KNOWN = "known AS (SELECT entity_id AS id FROM test_source2 UNION SELECT entity_id FROM test_source3)"


def found(rule: str, severity: str, x: str, source: str, ctes: str = "") -> str:
    return f"""WITH {ctes + ', ' if ctes else ''}x AS (SELECT {x} AS x FROM {source}) SELECT '{severity}' AS severity, '{rule}' AS rule, count(*) AS n, (SELECT string_agg(x, ', ' ORDER BY x) FROM (SELECT DISTINCT x FROM x ORDER BY x LIMIT 5)) AS examples FROM x HAVING count(*) > 0"""


@query("SELECT count(*) AS rows, count_if(trim(coalesce(matched_entity_ids, '')) = '') AS empty, count_if(trim(coalesce(matched_entity_ids, '')) <> '') AS filled FROM matching_results")
def validate_counts(spark, d):
    return V.counts(results(spark, d), "matched_entity_ids")


@query(found("duplicate row", "error", "source1_entity_id", "(SELECT source1_entity_id FROM matching_results GROUP BY 1 HAVING count(*) > 1)"))
def validate_duplicates(spark, d):
    return V.duplicate_rows(results(spark, d))


@query(found("repeated id in a list", "error", "source1_entity_id", "(SELECT source1_entity_id, string_split(matched_entity_ids, ',') AS l FROM matching_results WHERE coalesce(matched_entity_ids, '') <> '') WHERE len(l) <> len(list_distinct(l))"))
def validate_intra_list(spark, d):
    return V.repeated_ids(results(spark, d), "matched_entity_ids")


@query(found("id of source 1 in a list", "error", "id", "e WHERE starts_with(id, 'S1-')", IDS))
def validate_own_source(spark, d):
    return V.own_source(results(spark, d), "matched_entity_ids")


@query(found("id without prefix S2- or S3-", "error", "id", "e WHERE NOT starts_with(id, 'S1-') AND NOT starts_with(id, 'S2-') AND NOT starts_with(id, 'S3-')", IDS))
def validate_prefix(spark, d):
    return V.wrong_prefix(results(spark, d), "matched_entity_ids")


@query(found("unknown id", "error", "id", "e WHERE (starts_with(id, 'S2-') OR starts_with(id, 'S3-')) AND NOT EXISTS (SELECT 1 FROM known k WHERE k.id = e.id)", f"{IDS}, {KNOWN}"))
def validate_unknown(spark, d):
    return V.unknown_ids(results(spark, d), "matched_entity_ids", s23(spark, d))


@query(found("required id missing", "error", "entity_id", "(SELECT DISTINCT entity_id FROM test_source1) s WHERE NOT EXISTS (SELECT 1 FROM matching_results m WHERE m.source1_entity_id = s.entity_id)"))
def validate_missing(spark, d):
    return V.missing_rows(results(spark, d), s1(spark, d))


@query(found("id not in the query set", "error", "source1_entity_id", "(SELECT DISTINCT source1_entity_id FROM matching_results) m WHERE NOT EXISTS (SELECT 1 FROM test_source1 s WHERE m.source1_entity_id = s.entity_id)"))
def validate_extra(spark, d):
    return V.extra_rows(results(spark, d), s1(spark, d))


@query(found("matches that are no candidates", "warning", "source1_entity_id", "m LEFT JOIN c USING (source1_entity_id) WHERE len(list_filter(l, lambda x: x <> '' AND NOT list_contains(coalesce(k, []), x))) > 0",
             """m AS (SELECT source1_entity_id, flatten(list(string_split(coalesce(matched_entity_ids, ''), ','))) AS l FROM matching_results GROUP BY 1), c AS (SELECT source1_entity_id, flatten(list(string_split(coalesce(candidate_entity_ids, ''), ','))) AS k FROM v2_test_candidates GROUP BY 1)"""))  # fmt: skip
def validate_subset(spark, d):
    return V.not_candidates(results(spark, d), "matched_entity_ids", table(spark, d, "v2_test_candidates"), "candidate_entity_ids")
