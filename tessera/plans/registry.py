"""Queries over the driver's tables, by key, each with its SQL where SQL can express it.

Scored pairs come from lineitem: q is the order, s the part, p a fixed function of the lines; the country is a class of
the order's number and the label follows the return flag. Entities and records for the search are documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import similarity as S
from ..operators import models, scored, search, sparse, validate
from ..sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict = {}
FLAGSHIP = "entity_linkage"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            ORACLE_SQL[key] = _WITH + sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_WITH = """WITH li AS (SELECT l_orderkey AS q, l_partkey AS s, CAST(round(l_discount * 100) AS BIGINT) AS d, CAST(round(l_tax * 100) AS BIGINT) AS x,
  CAST(round(l_quantity) AS BIGINT) AS n, l_returnflag AS f FROM lineitem),
pairs AS (SELECT q, s, least(1000, max(d) * 40 + max(x) * 40 + sum(n)) / 1000.0::DOUBLE AS p, CASE WHEN max(f) = 'R' THEN 1 ELSE 0 END AS label,
  concat('c', q % 5) AS country FROM li GROUP BY q, s),
pairs2 AS (SELECT q, s, least(1000, max(x) * 100 + sum(n) * 4) / 1000.0::DOUBLE AS p FROM li WHERE f <> 'A' GROUP BY q, s),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY p DESC, s) AS rank_q FROM pairs),
top1 AS (SELECT * FROM r WHERE rank_q = 1),
truth AS (SELECT q, s FROM pairs WHERE label = 1),
entities AS (SELECT p_partkey AS s FROM part)
"""


def pairs(spark, d, country: bool = True) -> DataFrame:
    li = _t(spark, d, "lineitem")
    t = li.groupBy(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("s")).agg(
        (F.least(F.lit(1000), F.max(F.round(F.col("l_discount") * 100).cast("long")) * 40 + F.max(F.round(F.col("l_tax") * 100).cast("long")) * 40 + F.sum(F.round("l_quantity").cast("long"))) / F.lit(1000.0)).alias("p"),
        (F.max("l_returnflag") == "R").cast("int").alias("label"),
    )
    return t.withColumn("country", F.concat(F.lit("c"), (F.col("q") % 5).cast("string")))


def pairs2(spark, d) -> DataFrame:
    li = _t(spark, d, "lineitem").where("l_returnflag <> 'A'")
    return li.groupBy(F.col("l_orderkey").alias("q"), F.col("l_partkey").alias("s")).agg(
        (F.least(F.lit(1000), F.max(F.round(F.col("l_tax") * 100).cast("long")) * 100 + F.sum(F.round("l_quantity").cast("long")) * 4) / F.lit(1000.0)).alias("p")
    )


def truth(spark, d) -> DataFrame:
    return pairs(spark, d).where("label = 1").select("q", "s")


def entities(spark, d) -> DataFrame:
    return _t(spark, d, "part").select(F.col("p_partkey").alias("s"))


# --- joins -----------------------------------------------------------------------------------------------------------


@query("SELECT a.q, a.s, a.p, b.p AS p2 FROM pairs a JOIN pairs2 b ON a.q = b.q AND a.s = b.s")
def j_inner(spark, d):
    return pairs(spark, d).join(pairs2(spark, d).withColumnRenamed("p", "p2"), ["q", "s"]).select("q", "s", "p", "p2")


@query("SELECT a.q, a.s, a.p, coalesce(b.p, 0) AS p2 FROM pairs a LEFT JOIN pairs2 b ON a.q = b.q AND a.s = b.s")
def j_left(spark, d):
    return pairs(spark, d).join(pairs2(spark, d).withColumnRenamed("p", "p2"), ["q", "s"], "left").select("q", "s", "p", F.coalesce("p2", F.lit(0.0)).alias("p2"))


@query("SELECT q, s, a.p AS p, b.p AS p2 FROM (SELECT q, s, p FROM pairs WHERE p >= 0.3) a FULL JOIN pairs2 b USING (q, s)")
def j_full(spark, d):
    return pairs(spark, d).where("p >= 0.3").select("q", "s", "p").join(pairs2(spark, d).withColumnRenamed("p", "p2"), ["q", "s"], "full")


@query("SELECT q, s, p FROM pairs a WHERE NOT EXISTS (SELECT 1 FROM pairs2 b WHERE a.q = b.q AND a.s = b.s)")
def j_anti(spark, d):
    return pairs(spark, d).join(pairs2(spark, d), ["q", "s"], "left_anti").select("q", "s", "p")


@query("SELECT q, s, p FROM pairs a WHERE EXISTS (SELECT 1 FROM pairs2 b WHERE a.q = b.q)")
def j_semi(spark, d):
    return pairs(spark, d).join(pairs2(spark, d).select("q"), "q", "left_semi").select("q", "s", "p")


@query("SELECT q, s, p FROM pairs WHERE q IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def semi_scan(spark, d):
    some = _t(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("q"))
    return pairs(spark, d).join(some, "q", "left_semi").select("q", "s", "p")


@query(""", n AS (SELECT *, count(*) OVER (PARTITION BY p_brand, p_size) AS n FROM part)
SELECT a.p_partkey AS s, b.p_partkey AS s2 FROM part a JOIN n b ON a.p_brand = b.p_brand AND a.p_size = b.p_size WHERE b.n <= 50 AND a.p_partkey <> b.p_partkey""")
def addr_block(spark, d):
    p = _t(spark, d, "part")
    left = p.select("p_brand", "p_size", F.col("p_partkey").alias("s"))
    right = p.select("p_brand", "p_size", F.col("p_partkey").alias("s2"))
    return search.capped_block(left, right, ["p_brand", "p_size"], 50).where("s <> s2").select("s", "s2")


@query(""", n AS (SELECT s, p_name, count(*) OVER (PARTITION BY p_name, p_size) - 1 AS twins FROM (SELECT p_partkey AS s, p_name, p_size FROM part))
SELECT s, twins FROM n""")
def street_twins(spark, d):
    w = Window.partitionBy("p_name", "p_size")
    return _t(spark, d, "part").select(F.col("p_partkey").alias("s"), (F.count("*").over(w) - 1).alias("twins"))


@query(""", b AS (SELECT *, CAST(floor(round(ln(greatest(least(p, 0.999), 0.001) / (1 - greatest(least(p, 0.999), 0.001))), 9) / 0.5) AS BIGINT) AS bin FROM pairs),
c AS (SELECT country, bin, round(avg(label), 6) AS rate, count(*) AS n FROM b GROUP BY country, bin)
SELECT q, s, rate FROM b JOIN c USING (country, bin)""")
def bin_join(spark, d):
    t = pairs(spark, d)
    p = F.least(F.greatest(F.col("p"), F.lit(0.001)), F.lit(0.999))
    b = t.withColumn("bin", F.floor(F.round(F.log(p / (1 - p)), 9) / 0.5).cast("long"))
    return b.join(models.bin_calibration(t), ["country", "bin"]).select("q", "s", "rate")


@query("SELECT country, CAST(floor(round(ln(greatest(least(p, 0.999), 0.001) / (1 - greatest(least(p, 0.999), 0.001))), 9) / 0.5) AS BIGINT) AS bin, round(avg(label), 6) AS rate, count(*) AS n FROM pairs GROUP BY 1, 2")
def bin_calib(spark, d):
    return models.bin_calibration(pairs(spark, d))


@query("SELECT q, s, round(avg(p), 6) AS p FROM (SELECT q, s, p FROM pairs UNION ALL SELECT q, s, p FROM pairs2) GROUP BY q, s")
def fold_mean(spark, d):
    return pairs(spark, d).select("q", "s", "p").unionByName(pairs2(spark, d)).groupBy("q", "s").agg(F.round(F.avg("p"), 6).alias("p"))


# --- aggregates ------------------------------------------------------------------------------------------------------


@query("SELECT s, count(*) AS n, CAST(sum(CAST(round(p * 1000) AS BIGINT)) AS BIGINT) AS total, CAST(sum(CAST(round(p * 1000) AS BIGINT)) AS DOUBLE) / count(*) AS mean, min(p) AS low, max(p) AS high FROM pairs GROUP BY s")
def agg_basic(spark, d):
    return pairs(spark, d).groupBy("s").agg(F.count("*").alias("n"), F.sum(F.round(F.col("p") * 1000).cast("long")).alias("total"), (F.sum(F.round(F.col("p") * 1000).cast("long")) / F.count("*")).alias("mean"), F.min("p").alias("low"), F.max("p").alias("high"))


@query("SELECT country, round(avg(p) FILTER (WHERE label = 1), 6) AS true_mean, count(*) FILTER (WHERE p >= 0.5) AS high, round(avg(CAST(p >= 0.5 AS INT)), 6) AS high_share FROM pairs GROUP BY country")
def agg_filter(spark, d):
    hi = F.col("p") >= 0.5
    return pairs(spark, d).groupBy("country").agg(F.round(F.avg(F.when(F.col("label") == 1, F.col("p"))), 6).alias("true_mean"), F.count_if(hi).alias("high"), F.round(F.avg(hi.cast("int")), 6).alias("high_share"))


@query("SELECT q, s, coalesce(max(CASE WHEN rank_q = 2 THEN p END) OVER (PARTITION BY q), max(p) OVER (PARTITION BY q)) AS second FROM r")
def second_max(spark, d):
    return scored.second_max(pairs(spark, d), "p", "q").select("q", "s", "second")


@query("SELECT s, string_agg(CAST(q AS VARCHAR), ',' ORDER BY q) AS ids FROM (SELECT DISTINCT q, s FROM pairs) GROUP BY s")
def collect_ids(spark, d):
    t = pairs(spark, d).groupBy("s").agg(F.array_sort(F.collect_set("q")).alias("ids"))
    return t.select("s", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("SELECT count(DISTINCT q) AS qs, count(DISTINCT s) AS ss, (SELECT count(*) FROM (SELECT q, s FROM li GROUP BY q, s HAVING count(*) > 1)) AS repeated FROM pairs")
def distinctness(spark, d):
    li = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_partkey").agg(F.count("*").alias("n"))
    return li.agg(F.count_distinct("l_orderkey").alias("qs"), F.count_distinct("l_partkey").alias("ss"), F.count_if(F.col("n") > 1).alias("repeated"))


@query("SELECT q, s AS best FROM top1")
def argmax(spark, d):
    return pairs(spark, d).groupBy("q").agg(F.max_by("s", F.struct("p", -F.col("s"))).alias("best"))


@query("SELECT s, round(exp(sum(ln(greatest(1e-9, 1 - p)))), 6) AS none FROM pairs GROUP BY s")
def prob_none(spark, d):
    return pairs(spark, d).groupBy("s").agg(F.round(F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("p"))))), 6).alias("none"))


@query("SELECT q, s, p FROM top1")
def top1(spark, d):
    return scored.top_k(pairs(spark, d), 1).select("q", "s", "p")


@query("SELECT country, median(p) AS med, round(quantile_cont(p, 0.9), 6) AS p90, round(stddev_samp(p), 6) AS sd FROM pairs GROUP BY country")
def quantiles(spark, d):
    return pairs(spark, d).groupBy("country").agg(F.median("p").alias("med"), F.round(F.percentile("p", F.lit(0.9)), 6).alias("p90"), F.round(F.stddev("p"), 6).alias("sd"))


@query("SELECT least(greatest(n, 1), 4) AS size, count(*) AS qs FROM (SELECT q, count(*) AS n FROM pairs GROUP BY q) GROUP BY 1")
def group_expr(spark, d):
    n = pairs(spark, d).groupBy("q").agg(F.count("*").alias("n"))
    return n.groupBy(F.least(F.greatest(F.col("n"), F.lit(1)), F.lit(4)).alias("size")).agg(F.count("*").alias("qs"))


@query("SELECT CASE WHEN p <= 0.2 THEN 'a' WHEN p <= 0.5 THEN 'b' WHEN p <= 0.8 THEN 'c' ELSE 'd' END AS band, count(*) AS n FROM pairs GROUP BY 1")
def bins(spark, d):
    p = F.col("p")
    return pairs(spark, d).groupBy(F.when(p <= 0.2, "a").when(p <= 0.5, "b").when(p <= 0.8, "c").otherwise("d").alias("band")).agg(F.count("*").alias("n"))


@query("SELECT country, count(*) FILTER (WHERE label = 0) AS false_pairs, count(*) FILTER (WHERE label = 1) AS true_pairs FROM pairs GROUP BY country")
def pivot(spark, d):
    t = pairs(spark, d).groupBy("country").pivot("label", [0, 1]).count()
    return t.select("country", F.col("0").alias("false_pairs"), F.col("1").alias("true_pairs"))


@query(", n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL) SELECT p_brand, p_type, round(n * sum(n) OVER () / (sum(n) OVER (PARTITION BY p_brand) * sum(n) OVER (PARTITION BY p_type)), 6) AS lift FROM n")
def lift(spark, d):
    n = _t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    a, b, t = n.groupBy("p_brand").agg(F.sum("n").alias("na")), n.groupBy("p_type").agg(F.sum("n").alias("nb")), n.agg(F.sum("n").alias("nt"))
    return n.join(a, "p_brand").join(b, "p_type").join(F.broadcast(t)).select("p_brand", "p_type", F.round(F.col("n") * F.col("nt") / (F.col("na") * F.col("nb")), 6).alias("lift"))


@query(", w AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part), n AS (SELECT w, count(*) AS n FROM w GROUP BY w) SELECT a.w AS a, b.w AS b, count(*) AS both_n, round(any_value(x.n) * any_value(y.n) / (SELECT count(*) FROM part)::DOUBLE, 6) AS expected FROM w a JOIN w b ON a.p_partkey = b.p_partkey AND a.w < b.w JOIN n x ON x.w = a.w JOIN n y ON y.w = b.w GROUP BY 1, 2")
def cooccur(spark, d):
    p = _t(spark, d, "part")
    w = p.select("p_partkey", F.explode(F.array_distinct(F.split("p_name", " "))).alias("w"))
    n = w.groupBy("w").agg(F.count("*").alias("n"))
    pair = w.select("p_partkey", F.col("w").alias("a")).join(w.select("p_partkey", F.col("w").alias("b")), "p_partkey").where("a < b").groupBy("a", "b").agg(F.count("*").alias("both_n"))
    total = F.broadcast(p.agg(F.count("*").alias("t")))
    return pair.join(n.select(F.col("w").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("w").alias("b"), F.col("n").alias("nb")), "b").join(total).select("a", "b", "both_n", F.round(F.col("na") * F.col("nb") / F.col("t"), 6).alias("expected"))


@query("SELECT q, s, greatest(a.p, b.p) AS hi, least(a.p, b.p) AS lo, round((a.p + b.p) / 2, 6) AS mid, a.p >= 0.5 OR b.p >= 0.5 AS any_hi FROM pairs a JOIN pairs2 b USING (q, s)")
def horiz(spark, d):
    a, b = F.col("p"), F.col("p2")
    t = pairs(spark, d).join(pairs2(spark, d).withColumnRenamed("p", "p2"), ["q", "s"])
    return t.select("q", "s", F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"), F.round((a + b) / 2, 6).alias("mid"), ((a >= 0.5) | (b >= 0.5)).alias("any_hi"))


@query("SELECT round(corr(a.p, b.p), 6) AS r FROM pairs a JOIN pairs2 b USING (q, s)")
def corr(spark, d):
    return pairs(spark, d).join(pairs2(spark, d).withColumnRenamed("p", "p2"), ["q", "s"]).agg(F.round(F.corr("p", "p2"), 6).alias("r"))


@query("SELECT coalesce(country, 'all') AS country, count(*) AS n, round(avg(label), 6) AS rate FROM pairs GROUP BY ROLLUP (country)")
def rollup_report(spark, d):
    return pairs(spark, d).rollup("country").agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("rate")).select(F.coalesce("country", F.lit("all")).alias("country"), "n", "rate")


@query("SELECT t.country, round(avg(CAST(b.q IS NOT NULL AS INT)), 6) AS ceiling, count(*) AS n FROM (SELECT q, s, country FROM pairs WHERE label = 1) t LEFT JOIN pairs2 b USING (q, s) GROUP BY 1")
def recall_ceiling(spark, d):
    t = pairs(spark, d).where("label = 1").join(pairs2(spark, d).select("q", "s", F.lit(1).alias("hit")), ["q", "s"], "left")
    return t.groupBy("country").agg(F.round(F.avg(F.coalesce("hit", F.lit(0))), 6).alias("ceiling"), F.count("*").alias("n"))


@query(", n AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY p_brand) AS total, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS k FROM n) SELECT p_brand, p_type, n FROM m WHERE k = 1 AND n >= 0.1 * total")
def learn_map(spark, d):
    n = _t(spark, d, "part").groupBy("p_brand", "p_type").agg(F.count("*").alias("n"))
    w = Window.partitionBy("p_brand")
    m = n.withColumn("total", F.sum("n").over(w)).withColumn("k", F.row_number().over(w.orderBy(F.desc("n"), "p_type")))
    return m.where((F.col("k") == 1) & (F.col("n") >= 0.1 * F.col("total"))).select("p_brand", "p_type", "n")


@query("SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT p, sum(label) AS pos, sum(1 - label) AS neg FROM pairs GROUP BY p))")
def auc(spark, d):
    return models.auc(pairs(spark, d))


# --- windows ---------------------------------------------------------------------------------------------------------


@query("SELECT q, s, rank_q, row_number() OVER (PARTITION BY s ORDER BY p DESC, q) AS rank_s FROM r")
def w_rank(spark, d):
    return scored.ranked(pairs(spark, d)).select("q", "s", "rank_q", F.row_number().over(scored.by_s()).alias("rank_s"))


@query("SELECT q, s, count(*) OVER (PARTITION BY q) AS n, count(*) FILTER (WHERE p >= 0.5) OVER (PARTITION BY q) AS n_hi FROM pairs", name="cand_counts")
def cand_counts(spark, d):
    w = Window.partitionBy("q")
    return pairs(spark, d).select("q", "s", F.count("*").over(w).alias("n"), F.sum((F.col("p") >= 0.5).cast("int")).over(w).alias("n_hi"))


@query("SELECT q, s, count(*) OVER (PARTITION BY s) - 1 AS n_other, round(sum(p) OVER (PARTITION BY s) - p, 6) AS sum_other FROM pairs")
def w_others(spark, d):
    return scored.others(pairs(spark, d)).select("q", "s", "n_other", F.round("sum_other", 6).alias("sum_other"))


@query(", m AS (SELECT *, max(p) OVER (PARTITION BY q) AS m1, max(CASE WHEN rank_q = 2 THEN p END) OVER (PARTITION BY q) AS m2, count(*) OVER (PARTITION BY q) AS n FROM r) SELECT q, s, round(p - CASE WHEN n = 1 THEN 0 WHEN p = m1 THEN m2 ELSE m1 END, 6) AS margin FROM m")
def margin(spark, d):
    return scored.margin(pairs(spark, d)).select("q", "s", F.round("margin", 6).alias("margin"))


@query("SELECT q, s, round(sum(p) OVER (PARTITION BY s ORDER BY p DESC, q ROWS UNBOUNDED PRECEDING), 6) AS cum, row_number() OVER (PARTITION BY s ORDER BY p DESC, q) - 1 AS pos FROM pairs")
def w_cumsum(spark, d):
    w = scored.by_s()
    return pairs(spark, d).select("q", "s", F.round(F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0)), 6).alias("cum"), (F.row_number().over(w) - 1).alias("pos"))


@query("SELECT q, s, p FROM r WHERE rank_q <= 3")
def topk_group(spark, d):
    return scored.top_k(pairs(spark, d), 3).select("q", "s", "p")


@query("SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_type) - 1 AS code, count(*) OVER (PARTITION BY p_name) AS chain FROM part")
def dense_id(spark, d):
    return _t(spark, d, "part").select("p_partkey", (F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_type")) - 1).alias("code"), F.count("*").over(Window.partitionBy("p_name")).alias("chain"))


@query("SELECT q, s, CASE WHEN max(s % 2) OVER (PARTITION BY q) = 0 THEN 'train' WHEN min(s % 2) OVER (PARTITION BY q) = 1 THEN 'eval' ELSE 'mixed' END AS grp FROM pairs")
def grp_label(spark, d):
    w, h = Window.partitionBy("q"), F.col("s") % 2
    return pairs(spark, d).select("q", "s", F.when(F.max(h).over(w) == 0, "train").when(F.min(h).over(w) == 1, "eval").otherwise("mixed").alias("grp"))


# --- sets ------------------------------------------------------------------------------------------------------------


@query("SELECT q, s FROM pairs UNION ALL SELECT q, s FROM pairs2")
def u_all(spark, d):
    return pairs(spark, d).select("q", "s").unionByName(pairs2(spark, d).select("q", "s"))


@query("SELECT q, s FROM pairs WHERE p >= 0.5 UNION SELECT q, s FROM pairs2")
def u_distinct(spark, d):
    return pairs(spark, d).where("p >= 0.5").select("q", "s").union(pairs2(spark, d).select("q", "s")).distinct()


@query("SELECT q, s, 'removed' AS change FROM (SELECT q, s FROM pairs WHERE p >= 0.5 EXCEPT SELECT q, s FROM pairs2) UNION ALL SELECT q, s, 'added' FROM (SELECT q, s FROM pairs2 EXCEPT SELECT q, s FROM pairs WHERE p >= 0.5)")
def set_diff(spark, d):
    a, b = pairs(spark, d).where("p >= 0.5").select("q", "s"), pairs2(spark, d).select("q", "s")
    return a.exceptAll(b).withColumn("change", F.lit("removed")).unionByName(b.exceptAll(a).withColumn("change", F.lit("added")))


@query("SELECT q, s FROM pairs WHERE p >= 0.5 INTERSECT SELECT q, s FROM pairs2")
def set_intersect(spark, d):
    return pairs(spark, d).where("p >= 0.5").select("q", "s").intersect(pairs2(spark, d).select("q", "s"))


@query("SELECT q, s, max(CAST(src = 'a' AS INT)) AS from_a, max(CAST(src = 'b' AS INT)) AS from_b FROM (SELECT q, s, 'a' AS src FROM pairs WHERE p >= 0.5 UNION ALL SELECT q, s, 'b' FROM pairs2) GROUP BY q, s")
def union_prov(spark, d):
    return search.union_provenance({"a": pairs(spark, d).where("p >= 0.5"), "b": pairs2(spark, d)})


@query(", dec AS (SELECT q, s FROM top1 WHERE p >= 0.5), a AS (SELECT q, max(s) AS s FROM pairs2 WHERE p >= 0.9 GROUP BY q), v AS (SELECT q, s FROM pairs WHERE label = 0 AND s % 7 = 0) SELECT q, s FROM (SELECT * FROM dec WHERE q NOT IN (SELECT q FROM a) UNION ALL SELECT q, s FROM a) x WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.q = x.q AND v.s = x.s)")
def apply_sets(spark, d):
    p = pairs(spark, d)
    add = pairs2(spark, d).where("p >= 0.9").groupBy("q").agg(F.max("s").alias("s"))
    return scored.apply_sets(scored.top_k(p, 1).where("p >= 0.5").select("q", "s"), add, p.where("label = 0 AND s % 7 = 0"))


@query(", n AS (SELECT *, count(*) OVER (PARTITION BY country) AS n, row_number() OVER (PARTITION BY country ORDER BY p DESC, q, s) AS k FROM top1) SELECT q, s FROM n WHERE k <= round(CASE country WHEN 'c0' THEN 0.1 WHEN 'c1' THEN 0.5 ELSE 0.25 END * n)")
def topfrac(spark, d):
    return scored.top_fraction(scored.top_k(pairs(spark, d), 1), {"c0": 0.1, "c1": 0.5}, 0.25).select("q", "s")


@query("SELECT q, s, p FROM pairs WHERE country <> 'c1' UNION ALL SELECT q, s, p FROM pairs2 WHERE q % 5 = 1")
def splice(spark, d):
    donor = pairs2(spark, d).withColumn("country", F.concat(F.lit("c"), (F.col("q") % 5).cast("string")))
    return tables.splice(pairs(spark, d).select("q", "s", "p", "country"), donor, "country", ["c1"]).select("q", "s", "p")


# --- competition features --------------------------------------------------------------------------------------------


@query("SELECT q, s, p FROM r WHERE rank_q = 1 OR rank_q = 2 AND p >= 0.3 OR rank_q BETWEEN 3 AND 5 AND p >= 0.25")
def keep_rules(spark, d):
    return scored.keep_top2(pairs(spark, d), 0.3, 0.25).select("q", "s", "p")


@query(", g AS (SELECT q, max(p) AS best, coalesce(max(CASE WHEN rank_q = 2 THEN p END), 0) AS nxt FROM r GROUP BY q) SELECT q, s, p FROM pairs WHERE q IN (SELECT q FROM g WHERE best BETWEEN 0.2 AND 0.6 OR nxt >= 0.55)")
def close_calls(spark, d):
    return scored.close_calls(pairs(spark, d), 0.2, 0.6, 0.55).select("q", "s", "p")


@query(""", b AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY q) > 1 THEN 2 * p - sum(p) OVER (PARTITION BY q) ELSE p END AS p_margin FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY p DESC, q) AS k FROM top1),
g AS (SELECT s, sum(CAST(p >= 0.5 AS INT)) AS cnt, sum(p) AS sm, max(p) AS m1, max(CASE WHEN k = 2 THEN p END) AS m2, count(*) AS n FROM t GROUP BY s)
SELECT q, b.s, p, rank_q, round(p_margin, 6) AS p_margin, CAST(coalesce(cnt, 0) - CAST(rank_q = 1 AND p >= 0.5 AS INT) AS BIGINT) AS s_in_cnt,
round(coalesce(sm, 0) - CASE WHEN rank_q = 1 THEN p ELSE 0 END, 6) AS s_in_sum,
CASE WHEN rank_q = 1 AND p = m1 AND n > 1 THEN m2 WHEN rank_q = 1 AND n = 1 THEN 0 ELSE coalesce(m1, 0) END AS s_in_max_other,
row_number() OVER (PARTITION BY b.s ORDER BY p DESC, q) AS q_rank_in_s, count(*) OVER (PARTITION BY b.s) AS s_base_cnt FROM b LEFT JOIN g ON b.s = g.s""")
def stage2_feats(spark, d):
    return scored.stage2(pairs(spark, d)).withColumn("p_margin", F.round("p_margin", 6)).withColumn("s_in_sum", F.round("s_in_sum", 6))


@query(", t AS (SELECT q, s, row_number() OVER (PARTITION BY s ORDER BY p DESC, q) AS k FROM top1), w AS (SELECT s, max(CASE WHEN k = 1 THEN q END) AS q1, max(CASE WHEN k = 2 THEN q END) AS q2 FROM t GROUP BY s) SELECT a.q, a.s, CASE WHEN q1 = a.q THEN q2 ELSE q1 END AS sib FROM pairs a LEFT JOIN w ON a.s = w.s")
def sibling(spark, d):
    return scored.sibling(pairs(spark, d))


@query(", h AS (SELECT q, s, p FROM top1 WHERE p >= 0.5) SELECT a.q, a.s, count(h.q) AS n_peers, round(avg(h.p), 6) AS peer_mean FROM pairs a LEFT JOIN h ON a.s = h.s AND a.q <> h.q GROUP BY a.q, a.s")
def consensus(spark, d):
    return scored.consensus(pairs(spark, d)).withColumn("peer_mean", F.round("peer_mean", 6))


# --- blends, decisions, metric ---------------------------------------------------------------------------------------


@query("SELECT q, s, round(sum(w * p) / sum(w), 6) AS p FROM (SELECT q, s, p, 0.6 AS w FROM pairs UNION ALL SELECT q, s, p, 0.4 FROM pairs2) GROUP BY q, s")
def blend(spark, d):
    return scored.blend([pairs(spark, d), pairs2(spark, d)], [0.6, 0.4]).withColumn("p", F.round("p", 6))


@query("SELECT a.q, a.s, CASE WHEN t.q IS NULL THEN a.p ELSE coalesce(b.p, 0) END AS p FROM pairs a LEFT JOIN pairs2 b ON a.q = b.q AND a.s = b.s LEFT JOIN (SELECT DISTINCT q FROM pairs2) t ON a.q = t.q")
def override(spark, d):
    return scored.override(pairs(spark, d), pairs2(spark, d))


@query(", sa AS (SELECT q FROM top1 JOIN (SELECT q, s, row_number() OVER (PARTITION BY q ORDER BY p DESC, s) AS k FROM pairs2) b USING (q) WHERE b.k = 1 AND b.s = top1.s) SELECT q, s, p FROM pairs WHERE q IN (SELECT q FROM sa) UNION ALL SELECT q, s, p FROM pairs2 WHERE q NOT IN (SELECT q FROM sa)")
def hybrid(spark, d):
    return scored.hybrid(pairs(spark, d).select("q", "s", "p"), pairs2(spark, d))


@query("SELECT q, s FROM top1 WHERE p >= CASE country WHEN 'c0' THEN 0.4 WHEN 'c1' THEN 0.6 ELSE 0.5 END")
def decide_thr(spark, d):
    return scored.decide_threshold(pairs(spark, d), {"c0": 0.4, "c1": 0.6}, 0.5)


_EXPECTED = """, c AS (SELECT q, s, p, row_number() OVER (PARTITION BY s ORDER BY p DESC, q) AS k, sum(p) OVER (PARTITION BY s ORDER BY p DESC, q ROWS UNBOUNDED PRECEDING) AS cum,
sum(p) OVER (PARTITION BY s) AS tot, exp(sum(ln(greatest(1e-9, 1 - p))) OVER (PARTITION BY s)) AS none FROM top1 WHERE p >= 0.3),
e AS (SELECT *, round(1.25 * cum / (k + 0.25 * tot), 9) AS ef FROM c),
b AS (SELECT s, max(ef) AS ef, any_value(none) AS none FROM e GROUP BY s),
m AS (SELECT e.s, min(k) AS kmax FROM e JOIN b ON e.s = b.s AND e.ef = b.ef WHERE b.ef > round(b.none, 9) GROUP BY e.s),
dec AS (SELECT q, e.s AS s FROM e JOIN m ON e.s = m.s WHERE k <= kmax)
"""
_F05 = """, n AS (SELECT s, (SELECT count(*) FROM dec x WHERE x.s = e.s) AS np, (SELECT count(*) FROM truth t WHERE t.s = e.s) AS nt,
(SELECT count(*) FROM dec x JOIN truth t ON x.q = t.q AND x.s = t.s WHERE x.s = e.s) AS tp FROM entities e),
f AS (SELECT *, CASE WHEN nt = 0 THEN CAST(np = 0 AS DOUBLE) WHEN tp = 0 THEN 0 ELSE 1.25 * (tp / np) * (tp / nt) / (0.25 * (tp / np) + tp / nt) END AS f FROM n)
"""


@query(_EXPECTED + "SELECT q, s FROM dec")
def decide_expf(spark, d):
    return scored.decide_expected(pairs(spark, d), 0.3, 1.0)


@query(_EXPECTED + _F05 + "SELECT round(avg(f), 6) AS macro_f05, count(*) AS n FROM f")
def macro_f05(spark, d):
    return scored.macro_f05(scored.decide_expected(pairs(spark, d)), truth(spark, d), entities(spark, d))


_GRID = (0.3, 0.4, 0.5, 0.6, 0.7)


@query(f""", g AS (SELECT unnest([{', '.join(map(str, _GRID))}])::DOUBLE AS floor), x AS (SELECT floor, e.s, (SELECT count(*) FROM top1 t WHERE t.s = e.s AND t.p >= floor) AS np, (SELECT count(*) FROM truth t WHERE t.s = e.s) AS nt,
(SELECT count(*) FROM top1 t WHERE t.s = e.s AND t.p >= floor AND t.label = 1) AS tp FROM g, entities e),
f AS (SELECT floor, CASE WHEN nt = 0 THEN CAST(np = 0 AS DOUBLE) WHEN tp = 0 THEN 0 ELSE 1.25 * (tp / np) * (tp / nt) / (0.25 * (tp / np) + tp / nt) END AS f FROM x),
m AS (SELECT floor, round(avg(f), 6) AS macro_f05 FROM f GROUP BY floor) SELECT *, row_number() OVER (ORDER BY macro_f05 DESC, floor) = 1 AS best FROM m""")
def tune_grid(spark, d):
    return scored.threshold_grid(pairs(spark, d), truth(spark, d), entities(spark, d), _GRID)


@query(_EXPECTED + _F05 + """, w AS (SELECT q, s, 'wrong' AS kind FROM dec ANTI JOIN truth USING (q, s) UNION ALL SELECT q, s, 'missed' FROM truth ANTI JOIN dec USING (q, s)),
l AS (SELECT w.kind, (1 - f) / count(*) OVER (PARTITION BY w.s) AS loss FROM w JOIN f ON w.s = f.s)
SELECT kind, count(*) AS n, round(sum(loss) / (SELECT count(*) FROM f), 6) AS loss FROM l GROUP BY kind""")
def loss_attr(spark, d):
    dec, tr, ent = scored.decide_expected(pairs(spark, d)), truth(spark, d), entities(spark, d)
    f = scored.f05_by_entity(dec, tr, ent).select("s", "f")
    w = dec.join(tr, ["q", "s"], "left_anti").withColumn("kind", F.lit("wrong")).unionByName(tr.join(dec, ["q", "s"], "left_anti").withColumn("kind", F.lit("missed")))
    share = w.join(f, "s").withColumn("loss", (1 - F.col("f")) / F.count("*").over(Window.partitionBy("s")))
    return share.groupBy("kind").agg(F.count("*").alias("n"), F.sum("loss").alias("loss")).join(F.broadcast(ent.agg(F.count("*").alias("t")))).select("kind", "n", F.round(F.col("loss") / F.col("t"), 6).alias("loss"))


@query("SELECT q, s, n_votes FROM (SELECT q, s, count(*) AS n_votes FROM (SELECT q, s FROM top1 WHERE p >= 0.5 UNION ALL SELECT q, s FROM pairs2 WHERE p >= 0.5 UNION ALL SELECT q, s FROM truth) GROUP BY q, s) WHERE n_votes >= 2")
def vote(spark, d):
    fits = [scored.top_k(pairs(spark, d), 1).where("p >= 0.5"), pairs2(spark, d).where("p >= 0.5"), truth(spark, d)]
    return scored.votes(fits).where("n_votes >= 2")


@query()
def mc_draw(spark, d):
    return scored.monte_carlo(pairs(spark, d), 7)


@query("SELECT s, coalesce(string_agg(CAST(q AS VARCHAR), ',' ORDER BY q), '') AS matched FROM entities LEFT JOIN (SELECT DISTINCT q, s FROM top1 WHERE p >= 0.5) USING (s) GROUP BY s")
def matching_out(spark, d):
    return tables.matching_lists(scored.top_k(pairs(spark, d), 1).where("p >= 0.5"), entities(spark, d))


@query(""", l AS (SELECT DISTINCT q, s FROM pairs2 WHERE p >= 0.6)
SELECT 'duplicate_entity' AS rule, 0::BIGINT AS n UNION ALL SELECT 'missing_entity', 0 UNION ALL SELECT 'extra_entity', 0 UNION ALL SELECT 'duplicate_in_list', 0
UNION ALL SELECT 'record_twice', count(*) FROM (SELECT q FROM l GROUP BY q HAVING count(DISTINCT s) > 1)
UNION ALL SELECT 'unknown_record', count(*) FROM l WHERE q NOT IN (SELECT q FROM top1 WHERE p >= 0.2)""")
def validate_lists(spark, d):
    lists = tables.matching_lists(pairs2(spark, d).where("p >= 0.6"), entities(spark, d))
    return validate.validate(lists, entities(spark, d), scored.top_k(pairs(spark, d), 1).where("p >= 0.2").select("q"))


@query("SELECT CAST(count(*) FILTER (WHERE b.p IS NULL) AS BIGINT) AS only_a, CAST(count(*) FILTER (WHERE a.p IS NULL) AS BIGINT) AS only_b, round(max(abs(a.p - b.p)), 6) AS max_diff FROM pairs a FULL JOIN pairs2 b USING (q, s)")
def compare(spark, d):
    return validate.drift(pairs(spark, d), pairs2(spark, d))


# --- cleaning and scalar features ------------------------------------------------------------------------------------


@query("SELECT c_custkey, array_to_string(list_filter(list_transform(regexp_extract_all(c_name, '\\d+'), lambda x: ltrim(x, '0')), lambda x: x <> ''), '|') AS nums FROM customer")
def addr_nums(spark, d):
    return _t(spark, d, "customer").select("c_custkey", F.array_join(C.numbers(F.col("c_name")), "|").alias("nums"))


@query("SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS flat FROM documents")
def squash(spark, d):
    return _t(spark, d, "documents").select("doc_id", C.squash(F.col("text")).alias("flat"))


@query("SELECT page_id, regexp_replace(url, '^(?:https?://)?(?:www\\.)?([a-z0-9-]+)\\.(?:com|net|org|co|io)\\b.*$', '\\1') AS word FROM pages")
def domain(spark, d):
    return _t(spark, d, "pages").select("page_id", C.domain_words(F.col("url")).alias("word"))


@query("SELECT p_partkey, len(list_distinct(string_split(p_name, ' '))) AS n_words, length(p_name) AS n_chars, levenshtein(p_name, p_type) AS lev, starts_with(p_type, left(p_name, 1)) AS same_start FROM part")
def lens(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.size(F.array_distinct(F.split("p_name", " "))).alias("n_words"), F.length("p_name").alias("n_chars"), F.levenshtein("p_name", "p_type").alias("lev"), F.startswith("p_type", F.substring("p_name", 1, 1)).alias("same_start"))


def _names(spark, d):
    """Pairs of parts of one block; blocks of more than 50 parts make none, as in the reference."""
    p = _t(spark, d, "part")
    a, b = p.select("p_brand", "p_size", F.col("p_partkey").alias("s"), F.col("p_name").alias("a")), p.select("p_brand", "p_size", F.col("p_partkey").alias("s2"), F.col("p_name").alias("b"))
    return search.capped_block(a, b, ["p_brand", "p_size"], search.MAX_BLOCK).where("s < s2")


_NAME_PAIRS = "FROM part a JOIN (SELECT *, count(*) OVER (PARTITION BY p_brand, p_size) AS block FROM part) b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey AND b.block <= 50"


@query("SELECT a.p_partkey AS s, b.p_partkey AS s2, len(list_intersect(list_distinct(string_split(a.p_name, ' ')), list_distinct(string_split(b.p_name, ' ')))) AS common " + _NAME_PAIRS)
def list_fns(spark, d):
    w = lambda c: F.array_distinct(F.split(c, " "))
    return _names(spark, d).select("s", "s2", F.size(F.array_intersect(w("a"), w("b"))).alias("common"))


@query(f"SELECT a.p_partkey AS s, b.p_partkey AS s2, round(CASE WHEN jaro_similarity(a.p_name, b.p_name) > 0.7 THEN jaro_winkler_similarity(a.p_name, b.p_name) ELSE jaro_similarity(a.p_name, b.p_name) END, 6) AS jw {_NAME_PAIRS}")
def jw(spark, d):
    return _names(spark, d).select("s", "s2", F.round(S.jaro_winkler_udf(F.col("a"), F.col("b")), 6).alias("jw"))


@query()
def fuzzy(spark, d):
    a, b = F.col("a"), F.col("b")
    return _names(spark, d).select("s", "s2", F.round(S.ratio_udf(a, b), 6).alias("ratio"), F.round(S.token_sort_udf(a, b), 6).alias("tsort"), F.round(S.token_set_udf(a, b), 6).alias("tset"), F.round(S.partial_udf(a, b), 6).alias("partial"))


@query()
def unaccent(spark, d):
    return _t(spark, d, "documents").select("doc_id", C.unaccent(F.col("text")).alias("plain"))


@query()
def crc_fold(spark, d):
    h = F.crc32(F.concat(F.lit("S1-"), F.col("p_partkey").cast("string")).cast("binary"))
    return _t(spark, d, "part").select("p_partkey", (h % 3).alias("fold"), (h % 1000 < 500).alias("eval_half"))


@query()
def oof(spark, d):
    t = pairs(spark, d).join(pairs2(spark, d).withColumnRenamed("p", "p2"), ["q", "s"], "left").na.fill(0.0, ["p2"])
    return models.out_of_fold(t, ["p", "p2"])


@query()
def isotonic(spark, d):
    return models.isotonic(pairs(spark, d)).select("q", "s", F.round("calibrated", 6).alias("calibrated"))


# --- search ----------------------------------------------------------------------------------------------------------

_SEARCH = """, base AS (SELECT doc_id AS id, lang AS country, list_filter(string_split(lower(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM documents),
docs AS (SELECT id, country, w, id % 4 = 0 AS is_s FROM base),
grams AS (SELECT id, country, is_s, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(generate_series(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1])) ELSE [] END)) AS term FROM docs),
tf AS (SELECT id, country, is_s, term, count(*) AS tf FROM grams GROUP BY ALL),
sizes AS (SELECT country, count(*) AS n FROM docs WHERE is_s GROUP BY country),
idf AS (SELECT country, term, round(ln((1 + n) / (1 + df)) + 1, 9) AS idf FROM (SELECT country, term, count(*) AS df FROM tf WHERE is_s GROUP BY ALL) JOIN sizes USING (country) WHERE df BETWEEN 2 AND 5000),
raw AS (SELECT tf.*, (1 + ln(tf)) * idf AS x FROM tf JOIN idf USING (country, term)),
w AS (SELECT id, country, is_s, term, round(x / sqrt(sum(x * x) OVER (PARTITION BY country, id)), 9) AS w FROM raw),
sc AS (SELECT a.id AS q, b.id AS s, round(sum(a.w * b.w), 6) AS score FROM w a JOIN w b ON a.country = b.country AND a.term = b.term WHERE NOT a.is_s AND b.is_s GROUP BY ALL HAVING round(sum(a.w * b.w), 6) >= 0.01),
found AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, s) AS rank FROM sc QUALIFY rank <= 20)
"""


def _documents(spark, d) -> DataFrame:
    """Documents by the words of their whole texts; every fourth is an entity, the others are records."""
    flat = F.lower(F.regexp_replace("text", r"\s+", " "))
    w = F.filter(F.split(flat, " "), lambda t: t != "")
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("country"), F.array_join(w, " ").alias("name"), (F.col("doc_id") % 4 == 0).alias("is_s"))


def _texts(spark, d) -> DataFrame:
    """The same with white space as it is: the searches take any length of it as one blank."""
    return _t(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("country"), F.lower("text").alias("name"), (F.col("doc_id") % 4 == 0).alias("is_s"))


def _found(spark, d) -> DataFrame:
    """The search by words and pairs of words."""
    return search.topk(_texts(spark, d), "word_grams", 20, search.MIN_DF, search.MAX_DF_WORD)


@query(_SEARCH + "SELECT q, s, score, rank FROM found")
def topk_comb(spark, d):
    return _found(spark, d)


@query(_SEARCH + "SELECT country, term, idf FROM idf")
def tfidf_fit(spark, d):
    ent = _documents(spark, d).where("is_s")
    return search.idf_table(search.counts(ent, search.word_grams(F.col("name"))), ent.groupBy("country").agg(F.count("*").alias("n")), search.MIN_DF, search.MAX_DF_WORD).select("country", "term", "idf")


@query(_SEARCH + """, truth2 AS (SELECT a.id AS q, b.id AS s FROM docs a JOIN docs b ON a.country = b.country AND a.w = b.w WHERE NOT a.is_s AND b.is_s)
SELECT round(avg(CAST(coalesce(rank, 1000) <= 1 AS INT)), 6) AS recall_1, round(avg(CAST(coalesce(rank, 1000) <= 10 AS INT)), 6) AS recall_10, count(*) AS n FROM truth2 LEFT JOIN found USING (q, s)""")
def recall_at_k(spark, d):
    return search.recall_at_k(topk_comb(spark, d), _same_names(spark, d), [1, 10])


def _same_names(spark, d) -> DataFrame:
    docs = _documents(spark, d)
    a, b = docs.where("NOT is_s").select("country", "name", F.col("id").alias("q")), docs.where("is_s").select("country", "name", F.col("id").alias("s"))
    return a.join(b, ["country", "name"]).select("q", "s")


@query(_SEARCH.replace("SELECT id, country, is_s, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(generate_series(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1])) ELSE [] END)) AS term FROM docs",
    "SELECT id, country, is_s, unnest(list_transform(generate_series(1, length(concat(' ', array_to_string(w, ' '), ' ')) - 2), lambda i: substring(concat(' ', array_to_string(w, ' '), ' '), i, 3))) AS term FROM docs").replace("rank <= 20", "rank <= 10").replace("AND 5000", "AND 4000") + "SELECT q, s, score, rank FROM found")
def topk_name(spark, d):
    return search.topk(_texts(spark, d), "char_grams", 10, search.MIN_DF, search.MAX_DF_NAME)


@query()
def topk_bm25(spark, d):
    """Over whole texts; equal ones are one class, so that copies don't count in their terms' document frequency."""
    docs = _documents(spark, d)
    (ent, e_all), (rec, q_all) = (search.text_classes(docs.where(x)) for x in ("is_s", "NOT is_s"))
    return search.topk_of_members(search.topk_bm25(rec, ent, 10), q_all, e_all, 10)


@query(_SEARCH + """, pr AS (SELECT q, s, score AS p FROM found), top AS (SELECT q, s, p, row_number() OVER (PARTITION BY q ORDER BY p DESC, s) AS k1 FROM pr QUALIFY k1 = 1),
c AS (SELECT q, s, p, row_number() OVER (PARTITION BY s ORDER BY p DESC, q) AS k, sum(p) OVER (PARTITION BY s ORDER BY p DESC, q ROWS UNBOUNDED PRECEDING) AS cum, sum(p) OVER (PARTITION BY s) AS tot,
exp(sum(ln(greatest(1e-9, 1 - p))) OVER (PARTITION BY s)) AS none FROM top WHERE p >= 0.3),
e AS (SELECT *, round(1.25 * cum / (k + 0.25 * tot), 9) AS ef FROM c), b AS (SELECT s, max(ef) AS ef, any_value(none) AS none FROM e GROUP BY s),
m AS (SELECT e.s, min(k) AS kmax FROM e JOIN b ON e.s = b.s AND e.ef = b.ef WHERE b.ef > round(b.none, 9) GROUP BY e.s)
SELECT q, e.s AS s FROM e JOIN m ON e.s = m.s WHERE k <= kmax""")
def entity_linkage(spark, d):
    """Clean, search by word grams, decide by expected F0.5."""
    found = _found(spark, d).select("q", "s", F.col("score").alias("p"))
    return scored.decide_expected(found, 0.3, 1.0)
