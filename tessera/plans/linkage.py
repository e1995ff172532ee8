"""Queries over searches of records made of web pages, pair features, stage features and rules, each with its SQL.

A record of an order carries name and address of the part with its customer's number; entities are the parts. For the
searches, pages are records (every fourth an entity): the title is the name, the url's words the address.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import changes
from ..functions import cleaning as C
from ..functions import similarity as S
from ..operators import dense, features, models, rules, scored, search, sparse, validate
from ..sources import tables
from .registry import _EXPECTED, _names, _t, entities, pairs, pairs2, query, truth

_REC = """, rec AS (SELECT o_orderkey AS q, p_name AS nm, lower(p_type) AS ad, CAST(p_size AS VARCHAR) AS n1, o_orderkey % 2 AS src FROM orders JOIN part ON o_custkey = p_partkey),
ent AS (SELECT p_partkey AS s, p_name AS nm, lower(p_type) AS ad, CAST(p_size AS VARCHAR) AS n1 FROM part)
"""


def records(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("o_custkey"), F.col("p_name").alias("nm"), F.lower("p_type").alias("ad"), F.col("p_size").cast("string").alias("n1"))
    return _t(spark, d, "orders").select(F.col("o_orderkey").alias("q"), "o_custkey").join(p, "o_custkey").select("q", "nm", "ad", "n1", (F.col("q") % 2).alias("src"))


def parts(spark, d):
    return _t(spark, d, "part").select(F.col("p_partkey").alias("s"), F.col("p_name").alias("nm"), F.lower("p_type").alias("ad"), F.col("p_size").cast("string").alias("n1"))


# --- searches --------------------------------------------------------------------------------------------------------

_WORDS = "list_filter(string_split(trim(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' '), lambda x: x <> '')"
_PAGES = f""", pg AS (SELECT page_id AS id, regexp_extract(html, 'lang="([a-z]+)"', 1) AS country, {_WORDS.format("regexp_extract(html, '<title>([^<]*)</title>', 1)")} AS nw,
{_WORDS.format("regexp_extract(url, '://([^?#]*)', 1)")} AS aw, page_id % 4 = 0 AS is_s, contains(url, '?') AS noaddr FROM pages),
"""


def _pages(spark, d):
    word = lambda c: C.words(F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " ")))
    return _t(spark, d, "pages").select(F.col("page_id").alias("id"), F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("country"), word(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("nw"), word(F.regexp_extract("url", "://([^?#]*)", 1)).alias("aw"), (F.col("page_id") % 4 == 0).alias("is_s"), F.col("url").contains("?").alias("noaddr"))


def _search_sql(name: str, terms: str, max_df: int | None, min_df: int = 2) -> str:
    """CTEs <name>_w (weighted postings) and <name> (q, s, score of all pairs above the threshold); without max_df over all terms."""
    bounds = "" if max_df is None else f" WHERE df BETWEEN {min_df} AND {max_df}"
    return f"""{name}_tf AS (SELECT id, country, is_s, term, count(*) AS tf FROM (SELECT id, country, is_s, unnest({terms}) AS term FROM pg) GROUP BY ALL),
{name}_idf AS (SELECT country, term, round(ln((1 + n) / (1 + df)) + 1, 9) AS idf FROM (SELECT country, term, count(*) AS df FROM {name}_tf WHERE is_s GROUP BY ALL) JOIN (SELECT country, count(*) AS n FROM pg WHERE is_s GROUP BY 1) USING (country){bounds}),
{name}_w AS (SELECT id, country, is_s, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY country, id)), 9) AS w FROM (SELECT t.*, (1 + ln(tf)) * idf AS x FROM {name}_tf t JOIN {name}_idf USING (country, term))),
{name} AS (SELECT a.id AS q, b.id AS s, round(sum(a.w * b.w), 6) AS score FROM {name}_w a JOIN {name}_w b ON a.country = b.country AND a.term = b.term WHERE NOT a.is_s AND b.is_s GROUP BY ALL HAVING round(sum(a.w * b.w), 6) >= 0.01)"""


_GRAMS3 = "list_transform(generate_series(1, greatest(length(concat(' ', array_to_string(nw, ''), ' ')) - 2, 0)), lambda i: substring(concat(' ', array_to_string(nw, ''), ' '), i, 3))"
_BOTH = "list_concat(nw, aw)"
_W12 = f"list_concat({_BOTH}, CASE WHEN len({_BOTH}) > 1 THEN list_transform(generate_series(1, len({_BOTH}) - 1), lambda i: concat_ws(' ', ({_BOTH})[i], ({_BOTH})[i + 1])) ELSE [] END)"
_BY_NAME = _search_sql("byname", _GRAMS3, search.MAX_DF_NAME)
_BY_ADDR = _search_sql("byaddr", "aw", search.MAX_DF_WORD)
_BY_COMB = _search_sql("bycomb", _W12, search.MAX_DF_WORD)


def _top(name: str, k: str) -> str:
    return f"SELECT q, s, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, s) AS rank FROM {name}) WHERE rank <= {k}"


def _side(spark, d, kind: str):
    """Pages by the text of one of the searches."""
    text = {"name": F.array_join("nw", ""), "addr": F.array_join("aw", " "), "comb": F.array_join(F.concat("nw", "aw"), " ")}[kind]
    return _pages(spark, d).select("id", "country", "is_s", text.alias("name"))


def _search(spark, d, kind: str, k: int):
    """Over terms within the reference's bounds on the document frequency."""
    grams = {"name": "char_grams", "addr": "words", "comb": "word_grams"}[kind]
    return search.topk(_side(spark, d, kind), grams, k, search.MIN_DF, search.MAX_DF_NAME if kind == "name" else search.MAX_DF_WORD)


@query(_PAGES + _search_sql("byname", _GRAMS3, None) + _top("byname", "10"))
def page_name(spark, d):
    """Names as runs of letters, by all their character 3-grams, however many or few entities hold them."""
    return search.topk(_side(spark, d, "name"), "char_grams", 10, 1, sparse.ALL_DF)


@query(_PAGES + _BY_ADDR + _top("byaddr", "10"))
def topk_addr(spark, d):
    return _search(spark, d, "addr", 10)


@query(_PAGES + _BY_COMB + _top("bycomb", "20"))
def page_comb(spark, d):
    return _search(spark, d, "comb", 20)


@query(_PAGES + _BY_NAME + " SELECT q, s, score, rank FROM (SELECT x.*, row_number() OVER (PARTITION BY q ORDER BY score DESC, s) AS rank, noaddr FROM byname x JOIN pg ON q = id) WHERE rank <= CASE WHEN noaddr THEN 30 ELSE 10 END")
def topk_segk(spark, d):
    """Records without an address get more candidates by name."""
    k = _pages(spark, d).select(F.col("id").alias("q"), F.when(F.col("noaddr"), 30).otherwise(10).alias("k"))
    return _search(spark, d, "name", 30).join(k, "q").where("rank <= k").select("q", "s", "score", "rank")


@query(_PAGES + ", ".join((_BY_NAME, _BY_ADDR, _BY_COMB)) + f""", u AS (SELECT q, s, 'name' AS src FROM ({_top("byname", "10")}) UNION ALL SELECT q, s, 'addr' FROM ({_top("byaddr", "10")}) UNION ALL SELECT q, s, 'comb' FROM ({_top("bycomb", "20")}))
SELECT q, s, max(CAST(src = 'name' AS INT)) AS from_name, max(CAST(src = 'addr' AS INT)) AS from_addr, max(CAST(src = 'comb' AS INT)) AS from_comb FROM u GROUP BY q, s""")
def blocking_union(spark, d):
    """The searches' candidates with a flag for each search; one aggregation."""
    return search.union_provenance({"name": _search(spark, d, "name", 10), "addr": topk_addr(spark, d), "comb": page_comb(spark, d)})


_HASHED = "list_transform(list_concat(nw, aw), lambda t: ('0x' || substr(md5(t), 1, 6))::BIGINT)"


@query(_PAGES + _search_sql("byhash", _HASHED, search.MAX_DF_WORD, 1) + _top("byhash", "10"))
def tfidf_hash(spark, d):
    """Terms as one of 2^24 buckets, no least document frequency."""
    docs = _pages(spark, d).select("id", "country", "is_s", F.concat("nw", "aw").alias("name"))
    bucket = lambda c: F.transform(c, lambda t: F.conv(F.substring(F.md5(t), 1, 6), 16, 10))
    return search.topk_join(*search.weighted(search.stored_counts(docs, bucket), 1, search.MAX_DF_WORD), 10)


@query(_PAGES + _search_sql("whole", _GRAMS3, 1 << 40, 1) + f""", {_BY_ADDR}, c AS (SELECT q, s FROM ({_top("byaddr", "10")})) SELECT c.q, c.s, coalesce(round(sum(a.w * b.w), 6), 0) AS cos FROM c LEFT JOIN whole_w a ON a.id = c.q LEFT JOIN whole_w b ON b.id = c.s AND a.term = b.term GROUP BY 1, 2""")
def pair_cosine(spark, d):
    """Name similarity of the address search's candidates over the full vocabulary."""
    docs = _pages(spark, d).select("id", "country", "is_s", F.array_join("nw", "").alias("name"))
    q, e = search.weighted(search.stored_counts(docs, search.char_grams), 1, 1 << 40)
    return features.pair_cosine(topk_addr(spark, d), q.drop("country"), e.drop("country")).select("q", "s", F.round("cos", 6).alias("cos"))


@query(_PAGES + _BY_NAME + " SELECT id, count(w.term) AS kept FROM pg LEFT JOIN byname_w w USING (id) GROUP BY id")
def starved(spark, d):
    """How many grams of each record the search keeps: those with few are found by nothing."""
    q, e = search.weighted(search.stored_counts(_side(spark, d, "name"), search.char_grams), search.MIN_DF, search.MAX_DF_NAME)
    return _pages(spark, d).select("id").join(q.unionByName(e).groupBy("id").agg(F.count("*").alias("kept")), "id", "left").na.fill(0, ["kept"])


@query(_PAGES.rstrip().rstrip(",") + " SELECT id, array_to_string(list_transform(nw, lambda w: substr(w, 1, 1)), '') AS initials FROM pg")
def initials(spark, d):
    return _pages(spark, d).select("id", search.initials(F.array_join("nw", " ")).alias("initials"))


_DENSE = "SELECT a.vec_id AS q, b.vec_id AS s, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0"


@query(f", x AS ({_DENSE}) SELECT q, s, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, s) AS rank FROM x) WHERE rank <= 10")
def topk_dense(spark, d):
    """Exact inner products of the queries (ids divisible by 50) with all other vectors, in blocks."""
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return dense.top_k(v.where("id % 50 = 0"), v, 10)


@query()
def topk_ann(spark, d):
    """Inverted lists: 4 sqrt(n) cells, the nearest of them probed."""
    v = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return dense.ivf_top_k(v.where("id % 50 = 0"), v, 10)


@query(", c AS (SELECT a.vec_id AS q, b.vec_id AS s, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 7) SELECT q, s, round(list_cosine_similarity(x::DOUBLE[], y::DOUBLE[]), 6) AS emb_cos FROM c")
def emb_cos(spark, d):
    """Cosine of given pairs."""
    v = _t(spark, d, "embeddings")
    a, b = v.select(F.col("vec_id").alias("q"), F.col("embedding").alias("x")), v.select((F.col("vec_id") - 7).alias("q"), F.col("vec_id").alias("s"), F.col("embedding").alias("y"))
    return a.join(b, "q").select("q", "s", F.round(dense.cosine(F.col("x"), F.col("y")), 6).alias("emb_cos"))


# --- pair features ---------------------------------------------------------------------------------------------------

_NUMS = "list_filter(list_transform(regexp_extract_all({0}, '[0-9]+'), lambda x: ltrim(x, '0')), lambda x: x <> '')"
_BLOCKS = "FROM part a JOIN (SELECT *, count(*) OVER (PARTITION BY p_brand, p_size) AS block FROM part) b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey AND b.block <= 50"
_NUM_PAIRS = f", n AS (SELECT a.p_partkey AS s, b.p_partkey AS s2, {_NUMS.format('concat(a.p_partkey, chr(32), a.p_size)')} AS x, {_NUMS.format('concat(b.p_partkey, chr(32), b.p_size)')} AS y {_BLOCKS})\n"


def _numbers(spark, d):
    t = _names(spark, d)
    num = lambda c: C.numbers(F.concat_ws(" ", F.col(c).cast("string"), F.col("p_size").cast("string")))
    return t.select("s", "s2", num("s").alias("x"), num("s2").alias("y"))


@query(_NUM_PAIRS + "SELECT s, s2, len(x) AS num_q, len(y) AS num_s, len(list_intersect(x, y)) AS num_common FROM n")
def num_sets(spark, d):
    f = features.number_features(F.col("x"), F.col("y"))
    return _numbers(spark, d).select("s", "s2", *(f[c].alias(c) for c in ("num_q", "num_s", "num_common")))


@query(_NUM_PAIRS + "SELECT s, s2, x[1] = y[1] AS num_first_eq, list_contains(y, x[1]) AS num_first_in, x[1] <> y[1] AND (starts_with(x[1], y[1]) OR starts_with(y[1], x[1])) AS num_first_prefix, round(abs(x[1]::DOUBLE - y[1]::DOUBLE) / greatest(x[1]::DOUBLE, y[1]::DOUBLE, 1), 6) AS num_first_reldiff, levenshtein(x[1], y[1]) AS num_first_lev FROM n")
def num_first(spark, d):
    f = features.number_features(F.col("x"), F.col("y"))
    return _numbers(spark, d).select("s", "s2", *(f[c].alias(c) for c in ("num_first_eq", "num_first_in", "num_first_prefix")), F.round(f["num_first_reldiff"], 6).alias("num_first_reldiff"), F.levenshtein(F.get("x", F.lit(0)), F.get("y", F.lit(0))).alias("num_first_lev"))


@query()
def pair_scores(spark, d):
    """All text similarities of names and addresses of the pairs, each distinct pair of texts compared once."""
    t = pairs(spark, d).select("q", "s").join(records(spark, d).select("q", F.col("nm").alias("qn"), F.col("ad").alias("qa")), "q").join(parts(spark, d).select("s", F.col("nm").alias("sn"), F.col("ad").alias("sa")), "s")
    fns = {"ratio": S.ratio_udf, "tset": S.token_set_udf, "tsort": S.token_sort_udf, "partial": S.partial_udf, "jw": S.jaro_winkler_udf}
    out = t
    for side, (a, b) in (("n", ("qn", "sn")), ("a", ("qa", "sa"))):
        scored_ = S.distinct_pairs(t, a, b, {f"{side}_{k}": f for k, f in fns.items()})
        out = out.join(scored_, [a, b])
    return out.select("q", "s", *(F.round(f"{side}_{k}", 6).alias(f"{side}_{k}") for side in "na" for k in fns), (F.col("qn") == F.col("sn")).alias("name_exact"))


_SIX = ["p", "a", "b", "c", "e", "f"]
_SIX_SQL = ", six AS (SELECT q, s, p, round(1 - p, 6) AS a, (q + s) % 17 / 16.0 AS b, (q * 3 + s) % 11 / 10.0 AS c, s % 5 / 4.0 AS e, (q + 2 * s) % 23 / 22.0 AS f FROM pairs)\n"


def _margin_sql(c: str) -> str:
    top, nxt = f"max({c}) OVER (PARTITION BY q)", f"max(CASE WHEN {c}_rank = 2 THEN {c} END) OVER (PARTITION BY q)"
    return f"round({c} - CASE WHEN count(*) OVER (PARTITION BY q) = 1 THEN 0 WHEN {c} = {top} THEN {nxt} ELSE {top} END, 6) AS {c}_margin, {c}_rank"


@query(_SIX_SQL + ", rk AS (SELECT *, " + ", ".join(f"row_number() OVER (PARTITION BY q ORDER BY {c} DESC, s) AS {c}_rank" for c in _SIX) + " FROM six) SELECT q, s, " + ", ".join(map(_margin_sql, _SIX)) + " FROM rk")
def margins6(spark, d):
    q, s, p = F.col("q"), F.col("s"), F.col("p")
    t = pairs(spark, d).select("q", "s", "p", F.round(1 - p, 6).alias("a"), ((q + s) % 17 / 16.0).alias("b"), ((q * 3 + s) % 11 / 10.0).alias("c"), (s % 5 / 4.0).alias("e"), ((q + 2 * s) % 23 / 22.0).alias("f"))
    t = features.margins_and_ranks(t, _SIX)
    return t.select("q", "s", *(x for c in _SIX for x in (F.round(f"{c}_margin", 6).alias(f"{c}_margin"), f"{c}_rank")))


@query(_REC + """, b AS (SELECT r.q, r.s, r.p, rank_q, src FROM r JOIN rec USING (q)), g AS (SELECT s, src, count(*) AS n FROM b WHERE rank_q = 1 AND p >= 0.5 GROUP BY ALL)
SELECT q, b.s, coalesce(n, 0) - CAST(rank_q = 1 AND p >= 0.5 AS INT) AS s_in_same_src FROM b LEFT JOIN g ON b.s = g.s AND b.src = g.src""")
def same_src(spark, d):
    return features.same_source(pairs(spark, d).join(records(spark, d).select("q", "src"), "q"))


_SIB = _REC + """, t AS (SELECT q, s, p, row_number() OVER (PARTITION BY s ORDER BY p DESC, q) AS k FROM top1),
w AS (SELECT s, max(CASE WHEN k = 1 THEN q END) AS qa, max(CASE WHEN k = 1 THEN p END) AS pa, max(CASE WHEN k = 2 THEN q END) AS qb, max(CASE WHEN k = 2 THEN p END) AS pb FROM t GROUP BY s),
x AS (SELECT a.q, a.s, CASE WHEN qa = a.q THEN qb ELSE qa END AS sib, CASE WHEN qa = a.q THEN pb ELSE pa END AS sib_p FROM pairs a LEFT JOIN w ON a.s = w.s)
"""


@query(_SIB + "SELECT x.q, x.s, sib, sib_p, CAST(a.n1 = b.n1 AS INT) AS sib_num_eq, CAST(a.src = b.src AS INT) AS sib_same_src, CAST(sib IS NULL AS INT) AS sib_missing FROM x JOIN rec a ON a.q = x.q LEFT JOIN rec b ON b.q = sib")
def sibling_feats(spark, d):
    return features.siblings(pairs(spark, d), records(spark, d)).drop("nm", "ad", "sib_nm", "sib_ad")


@query()
def sibling_texts(spark, d):
    t = features.sibling_texts(features.siblings(pairs(spark, d), records(spark, d)))
    return t.select("q", "s", F.round("sib_name_tset", 6).alias("sib_name_tset"), F.round("sib_addr_tset", 6).alias("sib_addr_tset"))


@query(_REC + """, h AS (SELECT t.s, t.q, n1 FROM top1 t JOIN rec USING (q) WHERE p >= 0.5)
SELECT a.q, a.s, round(avg(CAST(h.n1 = r0.n1 AS INT)), 6) AS cons_num_share, CAST(coalesce(sum(CAST(h.n1 = r0.n1 AS INT)), 0) AS BIGINT) AS cons_num_same FROM pairs a JOIN rec r0 ON r0.q = a.q LEFT JOIN h ON a.s = h.s AND a.q <> h.q GROUP BY a.q, a.s""")
def consensus_nums(spark, d):
    return features.peer_numbers(pairs(spark, d), records(spark, d)).select("q", "s", F.round("cons_num_share", 6).alias("cons_num_share"), F.col("cons_num_same").cast("long").alias("cons_num_same"))


@query()
def consensus_texts(spark, d):
    t = features.peer_texts(pairs(spark, d), records(spark, d))
    return t.select("q", "s", *(F.round(c, 6).alias(c) for c in ("cons_name_mean", "cons_name_min", "cons_addr_mean", "cons_addr_min")))


_S3 = ", t3 AS (SELECT a.q, a.s, a.p AS p1, b.p AS p2, (a.q * 7 + a.s) % 101 / 100.0 AS ce FROM pairs a LEFT JOIN pairs2 b USING (q, s))\n"


def _stage3(spark, d):
    t = pairs(spark, d).select("q", "s", F.col("p").alias("p1")).join(pairs2(spark, d).withColumnRenamed("p", "p2"), ["q", "s"], "left")
    return t.withColumn("ce", (F.col("q") * 7 + F.col("s")) % 101 / 100.0)


@query(_S3 + "SELECT q, s, count(*) OVER (PARTITION BY q) AS n_cc, row_number() OVER (PARTITION BY q ORDER BY ce DESC, s) AS ce_rank, CASE WHEN count(*) OVER (PARTITION BY q) > 1 THEN round(2 * ce - sum(ce) OVER (PARTITION BY q), 6) + 0 END AS ce_margin, CASE WHEN count(*) OVER (PARTITION BY q) > 1 THEN round(2 * p2 - sum(p2) OVER (PARTITION BY q), 6) + 0 END AS p2_margin FROM t3")
def s3_feats(spark, d):
    return features.stage3(_stage3(spark, d)).select("q", "s", "n_cc", "ce_rank", (F.round("ce_margin", 6) + 0.0).alias("ce_margin"), (F.round("p2_margin", 6) + 0.0).alias("p2_margin"))


@query(_S3 + """, k3 AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY ce DESC, s) AS kc, row_number() OVER (PARTITION BY q ORDER BY p2 DESC NULLS LAST, s) AS kp, row_number() OVER (PARTITION BY q ORDER BY p1 DESC, s) AS p1_rank FROM t3),
m3 AS (SELECT *, max(ce) OVER w AS c1, max(CASE WHEN kc = 2 THEN ce END) OVER w AS c2, count(ce) OVER w AS cn, max(p2) OVER w AS x1, max(CASE WHEN kp = 2 THEN p2 END) OVER w AS x2, count(p2) OVER w AS xn FROM k3 WINDOW w AS (PARTITION BY q))
SELECT q, s, kc AS ce_rank, p1_rank, CASE WHEN cn > 1 THEN round(ce - CASE WHEN ce = c1 THEN c2 ELSE c1 END, 6) END AS ce_margin, CASE WHEN xn > 1 THEN round(p2 - CASE WHEN p2 = x1 THEN x2 ELSE x1 END, 6) END AS p2_margin FROM m3""")
def s3_extra(spark, d):
    return features.stage3(_stage3(spark, d), True).select("q", "s", "ce_rank", "p1_rank", F.round("ce_margin", 6).alias("ce_margin"), F.round("p2_margin", 6).alias("p2_margin"))


_STACK = _REC + """, st AS (SELECT q, s, CASE WHEN label = 1 OR s % 3 = 0 THEN a.p END AS a, a.p AS b, b.p AS pg, CASE WHEN s % 2 = 0 THEN a.p ELSE a.p / 2 END AS op2, b.p AS gp2 FROM pairs a FULL JOIN pairs2 b USING (q, s)),
o AS (SELECT *, CASE WHEN a IS NOT NULL OR b IS NOT NULL THEN (0.3 * coalesce(a, 0) + 0.7 * coalesce(b, 0)) / (0.3 * CAST(a IS NOT NULL AS INT) + 0.7 * CAST(b IS NOT NULL AS INT)) END AS po FROM st),
u AS (SELECT *, CASE WHEN pg IS NULL THEN po WHEN po IS NULL THEN pg ELSE 0.4 * pg + 0.6 * po END AS p FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, s) AS rank_q, count(*) OVER (PARTITION BY q) AS nq, row_number() OVER (PARTITION BY s ORDER BY p DESC, q) AS rank_s, count(*) OVER (PARTITION BY s) AS ns FROM u),
m AS (SELECT *, max(p) OVER (PARTITION BY q) AS q1, max(CASE WHEN rank_q = 2 THEN p END) OVER (PARTITION BY q) AS q2, max(p) OVER (PARTITION BY s) AS s1, max(CASE WHEN rank_s = 2 THEN p END) OVER (PARTITION BY s) AS s2 FROM k)
SELECT m.q, m.s, round(p, 6) AS p, round(po, 6) AS po, CAST(po IS NOT NULL AS INT) AS has_o, CAST(pg IS NOT NULL AS INT) AS has_g, CAST(abs(b - op2) > 1e-5 AS INT) AS t_o, CAST(abs(pg - gp2) > 1e-5 AS INT) AS t_g, round(po - pg, 6) + 0 AS d_og, round(a - b, 6) + 0 AS d_ab, rank_q, nq, rank_s,
round(p - CASE WHEN rank_q = 1 THEN CASE WHEN nq > 1 THEN q2 ELSE 0 END ELSE q1 END, 6) + 0 AS margin_q, round(p - CASE WHEN rank_s = 1 THEN CASE WHEN ns > 1 THEN s2 ELSE p END ELSE s1 END, 6) + 0 AS margin_s,
rec.n1::DOUBLE - ent.n1::DOUBLE AS hn_d, abs(rec.n1::DOUBLE - ent.n1::DOUBLE) AS hn_abs, CAST(rec.nm = ent.nm AS INT) AS name_eq, 0 AS q_noaddr, 0 AS s_noaddr FROM m JOIN ent ON ent.s = m.s JOIN rec ON rec.q = m.q"""


@query(_STACK)
def stack_feats(spark, d):
    a = pairs(spark, d).select("q", "s", F.col("p").alias("b"), F.when((F.col("label") == 1) | (F.col("s") % 3 == 0), F.col("p")).alias("a"))
    t = a.join(pairs2(spark, d).withColumnRenamed("p", "pg"), ["q", "s"], "full")
    t = t.withColumn("op2", F.when(F.col("s") % 2 == 0, F.col("b")).otherwise(F.col("b") / 2)).withColumn("gp2", F.col("pg"))
    out = features.stacker(t, records(spark, d), parts(spark, d))
    rounded = [(F.round(c, 6) + 0.0).alias(c) for c in ("p", "po", "d_og", "d_ab", "margin_q", "margin_s")]
    return out.select("q", "s", *rounded, "has_o", "has_g", "t_o", "t_g", "rank_q", "nq", "rank_s", "hn_d", "hn_abs", "name_eq", "q_noaddr", "s_noaddr")


# --- rules -----------------------------------------------------------------------------------------------------------


@query(_EXPECTED.replace("FROM top1 WHERE p >= 0.3)", "FROM top1 WHERE p >= 0.3 AND country <> 'c0')") + "SELECT q, s FROM dec UNION ALL SELECT q, s FROM top1 WHERE country = 'c0' AND p >= 0.6")
def finalize(spark, d):
    """A threshold in one country, the default rule elsewhere."""
    return rules.dispatch(pairs(spark, d), {"c0": {"type": "thr", "t": 0.6}, "default": {"type": "expf", "floor": 0.3, "alpha": 1.0}})


@query("SELECT q, s, CASE WHEN a.country IN ('c1', 'c2') THEN least(a.p, coalesce(b.p, 0)) ELSE a.p END AS p FROM pairs a LEFT JOIN pairs2 b USING (q, s)")
def min_rule(spark, d):
    return rules.min_rule(pairs(spark, d).select("q", "s", "p", "country"), pairs2(spark, d), F.col("country").isin("c1", "c2")).select("q", "s", "p")


@query(""", ad AS (SELECT q, s + 1000000 AS s FROM pairs2 WHERE p >= 0.98 UNION SELECT q, s FROM pairs WHERE s % 13 = 0), x AS (SELECT a.*, label = 0 AND a.s % 7 = 0 AS v, a.s % 5 = 0 AS r, ad.q IS NOT NULL AS d FROM pairs a LEFT JOIN ad ON ad.q = a.q AND ad.s = a.s)
SELECT q, s, CASE WHEN d THEN 0.95 WHEN r THEN greatest(CASE WHEN v THEN 0 ELSE p END, 0.95) WHEN v THEN 0 ELSE p END AS p FROM x UNION ALL SELECT q, s, 0.95 FROM ad WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.q = ad.q AND p.s = ad.s)""")
def override_sets(spark, d):
    p = pairs(spark, d)
    add = pairs2(spark, d).where("p >= 0.98").select("q", (F.col("s") + 1000000).alias("s")).unionByName(p.where("s % 13 = 0").select("q", "s"))
    return rules.override_sets(p, p.where("label = 0 AND s % 7 = 0"), p.where("s % 5 = 0"), add)


_BUILDS = """, old_ AS (SELECT q, s FROM top1 WHERE p >= 0.4), best2 AS (SELECT q, s, p FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, s) AS k FROM pairs2) WHERE k = 1), wide AS (SELECT q, s FROM best2 WHERE p >= 0.4),
base AS (SELECT q, s FROM wide WHERE q % 3 <> 0), pt AS (SELECT q, s, (q * 5 + s) % 100 / 100.0 AS pt FROM (SELECT q, s FROM pairs UNION SELECT q, s FROM pairs2))
"""


@query(_BUILDS + """SELECT w.q, w.s, 'removed' AS move FROM wide w ANTI JOIN old_ USING (q, s) SEMI JOIN pairs USING (q, s) SEMI JOIN base USING (q, s) JOIN pt USING (q, s) WHERE pt < 0.5
UNION ALL SELECT o.q, o.s, 'restored' FROM old_ o ANTI JOIN wide USING (q, s) SEMI JOIN top1 USING (q, s) ANTI JOIN base USING (q) JOIN pt USING (q, s) WHERE pt >= 0.8""")
def movers(spark, d):
    p, p2 = pairs(spark, d), pairs2(spark, d)
    old, wide = scored.top_k(p, 1).where("p >= 0.4").select("q", "s"), scored.top_k(p2, 1).where("p >= 0.4").select("q", "s")
    pt = p.select("q", "s").union(p2.select("q", "s")).distinct().withColumn("pt", (F.col("q") * 5 + F.col("s")) % 100 / 100.0)
    return rules.movers(wide.where("q % 3 <> 0"), wide, old, p2, p, pt)


_TAG = "CASE (b.q + b.s) % 4 WHEN 0 THEN 'n_upper' WHEN 1 THEN 'n_swap:desc' WHEN 2 THEN 'a_num_up1' ELSE 'n_legal_drop' END"


@query(_BUILDS + f"SELECT b.q, b.s FROM best2 b ANTI JOIN (SELECT q, s FROM pairs WHERE p >= 0.5) l USING (q, s) ANTI JOIN (SELECT q FROM top1 WHERE p >= 0.7) t USING (q) WHERE b.p >= 0.6 AND NOT regexp_matches({_TAG}, 'n_swap:|n_add:|n_drop:|n_legal_change|n_legal_add|a_num_up')")
def second_recall(spark, d):
    second = scored.top_k(pairs2(spark, d), 1)
    k = (F.col("q") + F.col("s")) % 4
    tags = second.select("q", "s", F.array(F.when(k == 0, "n_upper").when(k == 1, "n_swap:desc").when(k == 2, "a_num_up1").otherwise("n_legal_drop")).alias("tags"))
    base = scored.top_k(pairs(spark, d), 1).where("p >= 0.7")
    return rules.second_recall(second, pairs(spark, d).where("p >= 0.5").select("q", "s"), base, second, tags, "n_swap:|n_add:|n_drop:|n_legal_change|n_legal_add|a_num_up", 0.6)


@query(""", e AS (SELECT p_partkey AS s, concat('c', p_partkey % 3) AS country, concat(p_size, '|', string_split(p_name, ' ')[2]) AS k, p_name AS sn, replace(p_name, ' ', '') AS run FROM part),
b AS (SELECT *, count(*) OVER (PARTITION BY country, k) AS nb FROM e), base AS (SELECT q, s FROM top1 WHERE p >= 0.6),
rc AS (SELECT o_orderkey AS q, concat('c', p_partkey % 3) AS country, concat(p_size, '|', string_split(p_name, ' ')[2]) AS k, p_name AS nm, o_orderkey % 3 AS kind FROM orders JOIN part ON o_custkey = p_partkey WHERE o_orderkey NOT IN (SELECT q FROM base)),
ok AS (SELECT rc.q, b.s, rc.country, rc.k, run FROM rc JOIN b ON b.country = rc.country AND b.k = rc.k AND nb <= 50 AND rc.nm = b.sn AND kind <> 2),
one AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY q) AS n_ok FROM ok) WHERE n_ok = 1),
fr AS (SELECT * FROM one WHERE s % 17 <> 0 AND NOT EXISTS (SELECT 1 FROM pairs2 x WHERE x.q = one.q AND x.s <> one.s AND x.p >= 0.9)),
tw AS (SELECT country, run, string_split(k, '|')[2] AS street, count(*) AS n FROM e GROUP BY ALL)
SELECT q, fr.s FROM fr JOIN tw ON tw.country = fr.country AND tw.run = fr.run AND tw.street = string_split(fr.k, '|')[2] WHERE n = 1 AND fr.s IN (SELECT s FROM base)""")
def same_address(spark, d):
    """Upper-case and plain copies of a name are noise, another legal form is not."""
    p = _t(spark, d, "part")
    k = F.concat_ws("|", F.col("p_size").cast("string"), F.get(F.split("p_name", " "), F.lit(1)))
    e = p.select(F.col("p_partkey").alias("s"), F.concat(F.lit("c"), (F.col("p_partkey") % 3).cast("string")).alias("country"), k.alias("k"), F.concat("p_name", F.lit(" inc")).alias("sn"), F.replace("p_name", F.lit(" "), F.lit("")).alias("run"))
    kind = F.col("q") % 3
    qn = F.when(kind == 0, F.concat("p_name", F.lit(" inc"))).when(kind == 1, F.upper(F.concat("p_name", F.lit(" inc")))).otherwise(F.concat("p_name", F.lit(" llc")))
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("q"), F.col("o_custkey").alias("p_partkey")).join(p, "p_partkey")
    r = o.select("q", F.concat(F.lit("c"), (F.col("p_partkey") % 3).cast("string")).alias("country"), k.alias("k"), qn.alias("qn"))
    base = scored.top_k(pairs(spark, d), 1).where("p >= 0.6").select("q", "s")
    exclude = e.where("s % 17 = 0").select("s").join(r.select("q", "country", "k").join(e.select("country", "k", "s"), ["country", "k"]).select("q", "s"), "s").select("q", "s")
    return rules.same_address(r, e, base, pairs2(spark, d).where("p >= 0.9").select("q", "s"), exclude, changes.noise_udf("qn", "sn"))


@query(""", m AS (SELECT q, s FROM top1 WHERE p >= 0.3), x AS (SELECT q, s FROM pairs WHERE p >= 0.5 UNION SELECT q, s FROM pairs2 SEMI JOIN m USING (q, s) UNION SELECT q, s FROM truth SEMI JOIN m USING (q, s)), l AS (SELECT s, string_agg(CAST(q AS VARCHAR), ',' ORDER BY q) AS candidates FROM x GROUP BY s)
SELECT s, coalesce(candidates, '') AS candidates, (SELECT count(*) FROM m ANTI JOIN x USING (q, s)) AS missing FROM entities LEFT JOIN l USING (s)""")
def candidates_out(spark, d):
    """Candidate lists of all entities, and the number of matched pairs that are no candidates (to be 0 in a release)."""
    matched = scored.top_k(pairs(spark, d), 1).where("p >= 0.3").select("q", "s")
    got, missing = rules.candidate_lists(pairs(spark, d).where("p >= 0.5"), matched, [pairs2(spark, d), truth(spark, d)])
    lists = tables.matching_lists(got, entities(spark, d)).withColumnRenamed("matched", "candidates")
    return lists.join(F.broadcast(missing.agg(F.count("*").alias("missing"))))  # one row


@query(", acc AS (SELECT q, s, p, country, p >= 0.7 AS acc FROM top1), n AS (SELECT country, round(CASE country WHEN 'c0' THEN 0.6 WHEN 'c1' THEN 0.4 END * count(*)) - sum(CAST(acc AS INT)) AS need FROM acc GROUP BY country) SELECT q, s FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY p DESC, q, s) AS k FROM acc WHERE NOT acc) JOIN n USING (country) WHERE k <= need")
def topup(spark, d):
    t = scored.top_k(pairs(spark, d), 1).select("q", "s", "p", "country", (F.col("p") >= 0.7).alias("acc"))
    return scored.top_up(t, {"c0": 0.6, "c1": 0.4})


@query(""", taken AS (SELECT q FROM top1 WHERE p >= 0.7), u AS (SELECT q, s, 'a' AS grp, 0.9::DOUBLE AS est, 0 AS i FROM truth WHERE s % 2 = 0 UNION ALL SELECT q, s, 'b', 0.8, 1 FROM pairs2 WHERE p >= 0.7 UNION ALL SELECT q, s, 'c', 0.5, 2 FROM pairs WHERE p >= 0.5),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY i, s) AS k FROM u ANTI JOIN taken USING (q)) WHERE k = 1), n AS (SELECT s, count(*)::DOUBLE AS m FROM top1 WHERE p >= 0.7 GROUP BY s),
g AS (SELECT q, w.s, grp, est, CASE WHEN m IS NULL THEN 1 ELSE 1 - 1.25 * m / (1.25 * m + 0.25) END AS gain, CASE WHEN m IS NULL THEN 1 ELSE 1 - 1.25 * m / (1.25 * m + 1) END AS loss FROM w LEFT JOIN n ON n.s = w.s)
SELECT q, s, grp, est, round(est * gain - (1 - est) * loss, 6) AS change, round(loss / (gain + loss), 6) AS even FROM g""")
def tier_union(spark, d):
    base = scored.top_k(pairs(spark, d), 1).where("p >= 0.7")
    add = rules.tier_union([("a", 0.9, truth(spark, d).where("s % 2 = 0")), ("b", 0.8, pairs2(spark, d).where("p >= 0.7")), ("c", 0.5, pairs(spark, d).where("p >= 0.5"))], base)
    gain = rules.add_gain(add, base).select("q", "s", F.round("change", 6).alias("change"), F.round("even", 6).alias("even"))
    return add.join(gain, ["q", "s"])


@query(_REC + """, x AS (SELECT r.q, r.s, CAST((r.q * 7 + 3) % 40 AS VARCHAR) AS a, CAST((r.s * 5) % 40 AS VARCHAR) AS b, string_split(rec.nm, ' ') AS qw, string_split(ent.nm, ' ') AS sw FROM r JOIN rec USING (q) JOIN ent USING (s))
SELECT q, s, a <> b AND NOT starts_with(a, b) AND NOT starts_with(b, a) AS num_veto, len(list_filter(qw, lambda w: w IN ('ring', 'bolt', 'gear') AND NOT list_contains(sw, w))) > 0 AND len(list_filter(sw, lambda w: w IN ('ring', 'bolt', 'gear') AND NOT list_contains(qw, w))) > 0 AS desc_veto FROM x""")
def fr_vetoes(spark, d):
    t = pairs(spark, d).select("q", "s").join(records(spark, d).select("q", F.col("nm").alias("qn")), "q").join(parts(spark, d).select("s", F.col("nm").alias("sn")), "s")
    a, b = ((F.col("q") * 7 + 3) % 40).cast("string"), (F.col("s") * 5 % 40).cast("string")
    return t.select("q", "s", rules.number_conflict(a, b).alias("num_veto"), rules.swapped(F.split("qn", " "), F.split("sn", " "), ["ring", "bolt", "gear"]).alias("desc_veto"))


@query(_REC + "SELECT q, s, CASE WHEN b.p >= 0.5 AND a.p < b.p AND rec.n1 = ent.n1 AND rec.ad = ent.ad THEN b.p ELSE a.p END AS p FROM pairs a LEFT JOIN pairs2 b USING (q, s) JOIN rec USING (q) JOIN ent USING (s)")
def street_restore(spark, d):
    t = pairs(spark, d).select("q", "s", "p").join(records(spark, d).select("q", F.col("n1").alias("qh"), F.col("ad").alias("qs")), "q").join(parts(spark, d).select("s", F.col("n1").alias("sh"), F.col("ad").alias("ss")), "s")
    same = (F.col("qh") == F.col("sh")) & (S.token_sort_udf(F.col("qs"), F.col("ss")) >= 85)
    return rules.restore_street(t, pairs2(spark, d), same).select("q", "s", "p")


_BROKEN = """, ln AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 10 = 1 THEN '' WHEN s_suppkey % 10 = 2 THEN concat('S2-', s_suppkey, ',S2-', s_suppkey) WHEN s_suppkey % 10 = 3 THEN 'S1-1' WHEN s_suppkey % 10 = 4 THEN 'X9-1' WHEN s_suppkey % 10 = 5 THEN 'S3-999999' ELSE concat('S2-', s_suppkey) END AS ids FROM supplier)
"""


@query(_BROKEN + """, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE k % 10 = 2) AS two, count(*) FILTER (WHERE k % 10 = 3) AS three, count(*) FILTER (WHERE k % 10 = 4) AS four, count(*) FILTER (WHERE k % 10 = 5) AS five, count(*) FILTER (WHERE k % 10 = 0) AS zero, count(*) FILTER (WHERE k % 10 IN (0, 2) AND k % 20 < 10 OR k % 10 >= 6 AND k % 20 < 10) AS cand, count(*) FILTER (WHERE k % 10 IN (0, 2, 6, 7, 8, 9)) AS known FROM ln)
SELECT unnest(['comma_header', 'wrong_header', 'malformed_row', 'duplicate_entity', 'missing_entity', 'extra_entity', 'duplicate_in_list', 'self_match', 'bad_prefix', 'unknown_record', 'record_twice', 'not_a_candidate']) AS rule,
unnest([0, 1, 1, 1, 1, 1, two, three, four, five, CAST(three > 1 AS BIGINT) + CAST(four > 1 AS BIGINT) + CAST(five > 1 AS BIGINT), known - cand + five]) AS n FROM n""")
def validate_file(spark, d):
    """A submission with one fault of each kind by the supplier's number, as raw lines."""
    k = F.col("s_suppkey")
    own = F.concat(F.lit("S2-"), k.cast("string"))
    ids = F.when(k % 10 == 1, "").when(k % 10 == 2, F.concat_ws(",", own, own)).when(k % 10 == 3, "S1-1").when(k % 10 == 4, "X9-1").when(k % 10 == 5, "S3-999999").otherwise(own)
    sup = _t(spark, d, "supplier")
    entity = F.concat(F.lit("S1-"), k.cast("string"))
    body = sup.select((k + 2).alias("at"), F.concat_ws("\t", entity, ids).alias("value"))
    one = spark.range(1)
    lines = one.select(F.lit(0).cast("long").alias("at"), F.lit("entity\tids").alias("value")).unionByName(body).unionByName(one.select(F.lit(1).cast("long").alias("at"), F.lit("no tab").alias("value")))
    lines = lines.unionByName(one.select(F.lit(-1).cast("long").alias("at"), F.lit("x").alias("value")).where("false")).unionByName(one.select(F.lit(10**9).cast("long").alias("at"), F.lit("S1-0\t").alias("value"))).unionByName(one.select(F.lit(10**9 + 1).cast("long").alias("at"), F.lit("S1-none\t").alias("value")))
    ents = sup.select(entity.alias("id")).unionByName(one.select(F.lit("S1-unlisted").alias("id")))
    known = sup.select(own.alias("id"))
    cands = sup.where((k % 20) < 10).select(entity.alias("s"), own.alias("q"))
    return validate.validate_file(lines, ents, known, cands)


@query(", m AS (SELECT s, count(q) AS n FROM entities LEFT JOIN (SELECT DISTINCT q, s FROM top1 WHERE p >= 0.5) USING (s) GROUP BY s) SELECT count(*) AS rows, count(DISTINCT s) AS entities, CAST(sum(n) AS BIGINT) AS pairs, count(*) FILTER (WHERE n = 0) AS empty, count(*) AS known FROM m")
def validate_fast(spark, d):
    return validate.quick(tables.matching_lists(scored.top_k(pairs(spark, d), 1).where("p >= 0.5"), entities(spark, d)), entities(spark, d))


# --- models ----------------------------------------------------------------------------------------------------------


@query("SELECT q, s, label, s % 3 AS fold, p >= 0.2 AND country <> 'c4' AS eligible FROM pairs")
def attach(spark, d):
    """Label, fold and whether a pair may be trained on."""
    t = pairs(spark, d)
    return t.drop("label").join(truth(spark, d).withColumn("label", F.lit(1)), ["q", "s"], "left").select("q", "s", F.coalesce("label", F.lit(0)).alias("label"), (F.col("s") % 3).alias("fold"), ((F.col("p") >= 0.2) & (F.col("country") != "c4")).alias("eligible"))


@query("SELECT q, s FROM (SELECT *, ('0x' || substr(md5(concat_ws('-', '3', q, s)), 1, 7))::BIGINT / 268435456.0 AS u FROM r) WHERE label = 1 OR u < CASE WHEN rank_q <= 2 THEN 0.15 ELSE 0.015 END")
def neg_sample(spark, d):
    return models.sample_negatives(scored.ranked(pairs(spark, d)), F.col("rank_q") <= 2).select("q", "s")


@query("SELECT round(avg(-label * ln(least(greatest(p, 1e-6), 1 - 1e-6)) - (1 - label) * ln(1 - least(greatest(p, 1e-6), 1 - 1e-6))), 6) AS logloss FROM pairs")
def logloss(spark, d):
    return models.logloss(pairs(spark, d))


@query("SELECT q, s, round((a.p + b.p) / 2, 6) AS ce FROM pairs a JOIN pairs2 b USING (q, s)")
def family_mean(spark, d):
    both = pairs2(spark, d).select("q", "s")
    return features.mean_of([pairs(spark, d).join(both, ["q", "s"], "left_semi"), pairs2(spark, d).join(pairs(spark, d).select("q", "s"), ["q", "s"], "left_semi")]).select("q", "s", F.round("p", 6).alias("ce"))


@query()
def score_mean(spark, d):
    """Mean of the folds' models over every pair."""
    t = pairs(spark, d).join(pairs2(spark, d).withColumnRenamed("p", "p2"), ["q", "s"], "left").na.fill(0.0, ["p2"])
    fitted = models.fold_models(t, ["p", "p2"])
    return models.mean_of_models(t.select("q", "s", "p", "p2"), fitted, ["p", "p2"]).select("q", "s", F.round("p", 6).alias("p"))


@query()
def importance(spark, d):
    """Gain of each feature in a boosted model."""
    t = pairs(spark, d).join(pairs2(spark, d).withColumnRenamed("p", "p2"), ["q", "s"], "left").na.fill(0.0, ["p2"])
    return models.importance(t, ["p", "p2"])


@query(", k AS (SELECT *, coalesce(max(CASE WHEN rank_q = 2 THEN p END) OVER (PARTITION BY q), 0) AS nxt FROM r) SELECT q, s, CASE WHEN rank_q = 1 AND p >= 0.7 AND nxt <= 0.5 THEN 1 ELSE 0 END AS label FROM k WHERE rank_q = 1 AND p >= 0.7 AND nxt <= 0.5 OR p <= 0.2")
def pseudo(spark, d):
    return models.pseudo_labels(pairs(spark, d), 0.7, 0.2, 0.5)
