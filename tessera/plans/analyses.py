"""Queries over analyses of names, words and accepted pairs, each with its SQL where SQL can express it.

Of the words of the parts' names only old and cold resemble each other, so the SQL compares words by equality, these two
aside, where the operators compare them by similarity.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import cleaning as C
from ..functions import similarity as S
from ..operators import analysis as A
from ..operators import scored
from .linkage import _REC, parts, records
from .registry import _EXPECTED, _F05, _t, entities, pairs, pairs2, query, truth

_NP = _REC + """, np AS (SELECT r.q, r.s, r.p, r.label, r.country, r.rank_q, a.nm AS qn, a.ad AS qa, a.n1 AS qnum, a.src, b.nm AS sn, b.ad AS sa, b.n1 AS snum, string_split(a.nm, ' ') AS qw, string_split(b.nm, ' ') AS sw FROM r JOIN rec a ON a.q = r.q JOIN ent b ON b.s = r.s),
df AS (SELECT *, list_filter(qw, lambda w: NOT list_contains(sw, w) AND NOT list_contains(sw, CASE w WHEN 'old' THEN 'cold' WHEN 'cold' THEN 'old' ELSE '' END)) AS added, list_filter(sw, lambda w: NOT list_contains(qw, w) AND NOT list_contains(qw, CASE w WHEN 'old' THEN 'cold' WHEN 'cold' THEN 'old' ELSE '' END)) AS dropped, CASE WHEN qnum = snum THEN 'nsame' ELSE 'ndiff' END AS num FROM np),
pt AS (SELECT *, concat(CASE WHEN len(added) = len(qw) THEN 'other' WHEN len(added) > 0 AND len(dropped) > 0 THEN 'swap' WHEN len(dropped) > 0 THEN 'dropped' WHEN len(added) > 0 THEN 'added' ELSE 'same' END, '|', num) AS pat FROM df)
"""


def named(spark, d):
    """Ranked pairs with the record's and the entity's texts."""
    r = records(spark, d).select("q", F.col("nm").alias("qn"), F.col("ad").alias("qa"), F.col("n1").alias("qnum"), "src")
    e = parts(spark, d).select("s", F.col("nm").alias("sn"), F.col("ad").alias("sa"), F.col("n1").alias("snum"))
    return scored.ranked(pairs(spark, d)).join(r, "q").join(e, "s")


def patterned(spark, d):
    """With the pattern of each pair: every distinct pair of names is compared once."""
    t = named(spark, d)
    kinds = t.select("sn", "qn").distinct().withColumn("kind", A.name_kind_udf()("sn", "qn"))
    return t.join(kinds, ["sn", "qn"]).withColumn("pat", F.concat_ws("|", "kind", A.number_kind(F.col("snum"), F.col("qnum"))))


@query(_NP + "SELECT q, s, pat FROM pt")
def pattern(spark, d):
    return patterned(spark, d).select("q", "s", "pat")


@query(_NP + "SELECT pat, count(*) AS n, round(avg(label), 6) AS rate, round(avg(CAST(p >= 0.5 AS INT)), 6) AS accepted FROM pt WHERE rank_q = 1 GROUP BY pat")
def pattern_rate(spark, d):
    t = patterned(spark, d).where("rank_q = 1")
    return t.groupBy("pat").agg(F.count("*").alias("n"), F.round(F.avg("label"), 6).alias("rate"), F.round(F.avg((F.col("p") >= 0.5).cast("int")), 6).alias("accepted"))


@query(_NP + """, t AS (SELECT *, count(*) OVER (PARTITION BY pat) AS n, row_number() OVER (PARTITION BY pat ORDER BY p DESC, q, s) AS k FROM pt WHERE rank_q = 1), c AS (SELECT pat, avg(label) AS rate, count(*) AS seen FROM pt WHERE rank_q = 1 AND s % 2 = 0 GROUP BY pat)
SELECT q, s FROM t LEFT JOIN c USING (pat) WHERE CASE WHEN seen >= 20 THEN k <= round(round(rate, 6) * n) ELSE p >= 0.5 END""")
def pattern_calib(spark, d):
    """Each pattern keeps the share that is true on labelled pairs; a rare pattern the model's own decision."""
    t = patterned(spark, d).where("rank_q = 1").select("q", "s", "p", "label", "pat")
    rates = {r["pat"]: r["rate"] for r in t.where("s % 2 = 0").groupBy("pat").agg(F.round(F.avg("label"), 6).alias("rate"), F.count("*").alias("n")).where("n >= 20").collect()}  # a row for each pattern
    kept = scored.top_fraction(t, rates, None, "pat")
    rare = t.where(~F.col("pat").isin(list(rates)) & (F.col("p") >= 0.5)) if rates else t.where("p >= 0.5")
    return kept.select("q", "s").unionByName(rare.select("q", "s"))


@query(_NP + "SELECT q, s, array_to_string(added, ' ') AS added, array_to_string(dropped, ' ') AS dropped, qnum = snum AND qa = sa AS same_street FROM df")
def word_diff(spark, d):
    t = named(spark, d)
    diff = t.select("sn", "qn").distinct().withColumn("added", C.joined(A.unmatched_udf()("qn", "sn"))).withColumn("dropped", C.joined(A.unmatched_udf()("sn", "qn")))
    return t.join(diff, ["sn", "qn"]).select("q", "s", "added", "dropped", ((F.col("qnum") == F.col("snum")) & (F.col("qa") == F.col("sa"))).alias("same_street"))


@query(_NP + """, k AS (SELECT s, n1, array_to_string(list_sort(list_distinct(string_split(nm, ' '))), ' ') AS k FROM ent), c AS (SELECT k, count(*) AS n FROM k GROUP BY k), cn AS (SELECT k, n1, count(*) AS n FROM k GROUP BY k, n1)
SELECT np.q, np.s, coalesce(c.n, 0) - CAST(own.k = x.k AS INT) AS twins, coalesce(cn.n, 0) - CAST(own.k = x.k AND own.n1 = qnum AS INT) > 0 AS twin_at_number FROM np JOIN (SELECT q, array_to_string(list_sort(list_distinct(string_split(nm, ' '))), ' ') AS k FROM rec) x ON x.q = np.q JOIN k own ON own.s = np.s LEFT JOIN c ON c.k = x.k LEFT JOIN cn ON cn.k = x.k AND cn.n1 = qnum""")
def name_twins(spark, d):
    """Other entities with the record's words, and whether one has its number; by counts of the key, not by lists of ids."""
    t = named(spark, d).withColumn("qk", A.name_key(F.col("qn"))).withColumn("sk", A.name_key(F.col("sn")))
    e = parts(spark, d).select(A.name_key(F.col("nm")).alias("qk"), F.col("n1").alias("qnum"))
    t = t.join(e.groupBy("qk").agg(F.count("*").alias("n")), "qk", "left").join(e.groupBy("qk", "qnum").agg(F.count("*").alias("m")), ["qk", "qnum"], "left").na.fill(0, ["n", "m"])
    own = F.col("qk") == F.col("sk")
    return t.select("q", "s", (F.col("n") - own.cast("int")).alias("twins"), ((F.col("m") - (own & (F.col("snum") == F.col("qnum"))).cast("int")) > 0).alias("twin_at_number"))


@query(", w AS (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part) SELECT w, count(*) AS df FROM w GROUP BY w")
def word_df(spark, d):
    return _t(spark, d, "part").select(F.explode(F.array_distinct(F.split("p_name", " "))).alias("w")).groupBy("w").agg(F.count("*").alias("df"))


_WC = """, w AS (SELECT unnest(added) AS w, num FROM df), dfr AS (SELECT w, count(*) AS d FROM (SELECT p_partkey, unnest(list_distinct(string_split(p_name, ' '))) AS w FROM part) GROUP BY w),
wc AS (SELECT w, CASE WHEN w IN ('red', 'blue') THEN 'G' WHEN count(*) < 40 THEN 'rare' WHEN round(avg(CAST(num = 'nsame' AS INT)), 9) < 0.08 THEN 'X' WHEN round(avg(CAST(num = 'nsame' AS INT)), 9) >= 0.7 THEN 'N' WHEN round(avg(CAST(num = 'nsame' AS INT)), 9) >= 0.25 AND round(avg(CAST(num = 'nsame' AS INT)), 9) < 0.5 AND any_value(d) >= 100 THEN 'D' ELSE 'M' END AS cls FROM w JOIN dfr USING (w) GROUP BY w)
"""


def _word_classes(spark, d):
    t = named(spark, d)
    diff = t.select("sn", "qn").distinct().withColumn("added", A.unmatched_udf()("qn", "sn"))
    rows = t.join(diff, ["sn", "qn"]).withColumn("w", F.explode("added"))
    by = rows.groupBy("w").agg(F.count("*").alias("n"), F.round(F.avg((F.col("qnum") == F.col("snum")).cast("int")), 9).alias("keep")).join(word_df(spark, d), "w")
    return rows, by.select("w", A.word_class(F.col("n"), F.col("keep"), F.col("df"), F.col("w").isin("red", "blue")).alias("cls"))


@query(_NP + _WC + "SELECT w, cls FROM wc")
def word_class(spark, d):
    return _word_classes(spark, d)[1]


@query(_NP + _WC + ", o AS (SELECT q, s, min(CASE cls WHEN 'X' THEN 1 WHEN 'D' THEN 2 WHEN 'G' THEN 3 WHEN 'M' THEN 4 WHEN 'rare' THEN 5 ELSE 6 END) AS k FROM (SELECT q, s, unnest(added) AS w FROM df) JOIN wc USING (w) GROUP BY q, s) SELECT q, s, (['X', 'D', 'G', 'M', 'rare', 'N'])[k] AS cls FROM o")
def pair_class(spark, d):
    rows, classes = _word_classes(spark, d)
    return A.worst_class(rows.select("q", "s", "w"), classes)


_KEYS = "array_to_string(list_sort(list_distinct({0})), ' ')"


@query(_NP + f", k AS (SELECT *, {_KEYS.format('qw')} AS qk, {_KEYS.format('sw')} AS sk FROM df WHERE rank_q = 1) SELECT q, s, count(*) OVER (PARTITION BY s, qk) AS nsib, count(*) OVER (PARTITION BY s) AS nrec, CAST(sum(CAST(qk = sk AS INT)) OVER (PARTITION BY s) AS BIGINT) AS nsame FROM k")
def sib_key(spark, d):
    """Records of an entity, those with the same changed name, and those with its own name."""
    t = named(spark, d).where("rank_q = 1").withColumn("qk", A.name_key(F.col("qn"))).withColumn("own", (F.col("qk") == A.name_key(F.col("sn"))).cast("long"))
    w = Window.partitionBy("s")
    return t.select("q", "s", F.count("*").over(Window.partitionBy("s", "qk")).alias("nsib"), F.count("*").over(w).alias("nrec"), F.sum("own").over(w).alias("nsame"))


@query(_NP + ", a AS (SELECT *, CAST(starts_with(pat, 'same|') AND p >= 0.3 AS INT) AS acc FROM pt WHERE rank_q = 1) SELECT q, s, CAST(sum(acc) OVER (PARTITION BY s) - acc AS BIGINT) AS oth FROM a")
def oth_count(spark, d):
    t = patterned(spark, d).where("rank_q = 1").withColumn("acc", (F.col("pat").startswith("same|") & (F.col("p") >= 0.3)).cast("long"))
    return t.select("q", "s", (F.sum("acc").over(Window.partitionBy("s")) - F.col("acc")).alias("oth"))


@query()
def nearest_word(spark, d):
    """For each added word: its best own word against the best of the 3,000 most frequent words of nearly its length."""
    top = [r["w"] for r in word_df(spark, d).orderBy(F.desc("df"), "w").limit(3000).collect()]  # the vocabulary is a bounded parameter
    t = named(spark, d).select("sn", "qn").distinct().withColumn("w", F.explode(A.unmatched_udf()("qn", "sn")))
    sim = A.resemblance_udf(top)(F.col("sn"), F.col("w"))
    return t.select("sn", "w").distinct().withColumn("x", sim).select("sn", "w", F.round(F.col("x")[0], 6).alias("own"), F.round(F.col("x")[1], 6).alias("other"))


@query(_NP + """, tw AS (SELECT ad, nm, count(*) AS n FROM ent GROUP BY ALL), ex AS (SELECT x.q, x.s, count(*) AS n FROM np x JOIN ent e ON e.ad = x.sa AND e.nm = x.qn AND e.s <> x.s GROUP BY ALL)
SELECT np.q, np.s, tw.n - 1 AS n_twin, coalesce(ex.n, 0) AS n_rec_twin FROM np JOIN tw ON tw.ad = np.sa AND tw.nm = np.sn LEFT JOIN ex ON ex.q = np.q AND ex.s = np.s""")
def street_core(spark, d):
    """Entities of the same street and name, and other entities of the street that explain the record's name; by counts."""
    t = named(spark, d)
    by = parts(spark, d).groupBy("ad", "nm").agg(F.count("*").alias("n"))
    t = t.join(by.select(F.col("ad").alias("sa"), F.col("nm").alias("sn"), F.col("n").alias("n1")), ["sa", "sn"])
    t = t.join(by.select(F.col("ad").alias("sa"), F.col("nm").alias("qn"), F.col("n").alias("n2")), ["sa", "qn"], "left")
    return t.select("q", "s", (F.col("n1") - 1).alias("n_twin"), (F.coalesce("n2", F.lit(0)) - (F.col("qn") == F.col("sn")).cast("int")).alias("n_rec_twin"))


@query(_NP + """, c AS (SELECT ad, nm, n1, count(*) AS n FROM ent GROUP BY ALL),
m AS (SELECT q, s, c.n, c.nm = sn AND c.n1 = snum AS own, len(added) AS m1, len(list_filter(qw, lambda w: NOT list_contains(string_split(c.nm, ' '), w) AND NOT list_contains(string_split(c.nm, ' '), CASE w WHEN 'old' THEN 'cold' WHEN 'cold' THEN 'old' ELSE '' END))) AS m2 FROM df JOIN c ON c.ad = df.sa AND c.n1 = df.qnum WHERE rank_q = 1)
SELECT x.q, x.s, CAST(coalesce(sum(CASE WHEN m2 <= m1 THEN n - CAST(own AS INT) ELSE 0 END), 0) AS BIGINT) AS n_amb FROM (SELECT q, s FROM np WHERE rank_q = 1) x LEFT JOIN m USING (q, s) GROUP BY x.q, x.s""")
def ambiguity(spark, d):
    """How many other entities of the street with the record's number explain its name at least as well as its own.

    Entities are compared as distinct (street, name, number) with counts.
    """
    t = named(spark, d).where("rank_q = 1").select("q", "s", "qn", "sn", "sa", "qnum", "snum")
    c = parts(spark, d).groupBy(F.col("ad").alias("sa"), F.col("n1").alias("qnum"), F.col("nm").alias("n2")).agg(F.count("*").alias("n"))
    both = t.join(c, ["sa", "qnum"])
    texts = both.select(F.col("qn").alias("x"), F.col("n2").alias("y")).union(t.select("qn", "sn")).distinct().withColumn("miss", F.size(A.unmatched_udf()("x", "y")))
    miss = lambda y, name: texts.select(F.col("x").alias("qn"), F.col("y").alias(y), F.col("miss").alias(name))
    both = both.join(miss("sn", "m1"), ["qn", "sn"]).join(miss("n2", "m2"), ["qn", "n2"])
    own = ((F.col("n2") == F.col("sn")) & (F.col("qnum") == F.col("snum"))).cast("long")
    n = both.where("m2 <= m1").groupBy("q", "s").agg(F.sum(F.col("n") - own).alias("n_amb"))
    return t.select("q", "s").join(n, ["q", "s"], "left").na.fill(0, ["n_amb"])


@query(_REC + """, b AS (SELECT s, nm, ad, n1, count(*) OVER (PARTITION BY n1, ad) AS nb FROM ent) SELECT q, min(b.s) AS best FROM (SELECT * FROM rec WHERE q % 2 = 0) r JOIN b ON b.n1 = r.n1 AND b.ad = r.ad AND b.nm <> r.nm WHERE nb <= 50 GROUP BY q""")
def num_block(spark, d):
    """The entity at the record's house number whose street resembles its own most, among those with another name."""
    r = records(spark, d).where("q % 2 = 0").select("q", F.col("nm").alias("qn"), F.col("ad").alias("qa"), "n1")
    e = parts(spark, d).withColumn("nb", F.count("*").over(Window.partitionBy("n1", "ad"))).where("nb <= 50")
    pair = r.select("qa", "n1").distinct().join(e.select("n1", "ad").distinct(), "n1").withColumn("x", S.ratio_udf(F.col("qa"), F.col("ad"))).where("x >= 80")
    hit = r.join(pair, ["qa", "n1"]).join(e.select("n1", "ad", F.col("nm"), "s"), ["n1", "ad"]).where("nm <> qn")
    return hit.groupBy("q").agg(F.min(F.struct((-F.col("x")).alias("x"), "s")).alias("b")).select("q", F.col("b.s").alias("best"))


@query(_NP + "SELECT q, s, len(list_filter(qw, lambda w: list_contains(sw, w))) = 0 AS replaced, len(list_filter(sw, lambda w: list_contains(qw, w))) AS common FROM np")
def street_repl(spark, d):
    """Whether no word is shared, and how many content words are."""
    x, y = F.split("qn", " "), F.split("sn", " ")
    return named(spark, d).select("q", "s", (~F.arrays_overlap(x, y)).alias("replaced"), F.size(F.filter(y, lambda w: F.array_contains(F.split("qn", " "), w))).alias("common"))


@query("""SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'exact' WHEN 1 THEN 'prefix' WHEN 2 THEN 'mismatch' WHEN 3 THEN 'empty' WHEN 4 THEN 'exact' END AS form FROM part""")
def form_check(spark, d):
    """Web addresses and handles made of a name."""
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    run = F.replace(n, F.lit(" "), F.lit(""))
    text = F.when(k == 0, F.concat(run, F.lit(".com"))).when(k == 1, F.concat(F.lit("@"), run, F.lit("shop"))).when(k == 2, "zzz.fr").when(k == 3, "#").when(k == 4, F.concat(F.lit("#"), run)).otherwise(n)
    variants = F.array(run, F.get(F.split(n, " "), F.lit(0)))
    return _t(spark, d, "part").select("p_partkey", A.form_check(A.web_form(text)[1], variants).alias("form"))


@query("SELECT p_partkey, CAST(p_size AS INT) % 3 AS left_over FROM part")
def segment_dp(spark, d):
    """Letters of a run that neither words nor initials explain: none, one or two of a sign that no name has."""
    run = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.repeat(F.lit("0"), F.col("p_size") % 3))
    return _t(spark, d, "part").select("p_partkey", A.segment_udf()(run, F.col("p_name")).alias("left_over"))


@query(""", x AS (SELECT p_partkey, p_name AS a, lower(p_type) AS b FROM part), l AS (SELECT p_partkey, c, count(*) FILTER (WHERE side = 0) AS na, count(*) FILTER (WHERE side = 1) AS nb FROM (SELECT p_partkey, 0 AS side, unnest(string_split(a, '')) AS c FROM x UNION ALL SELECT p_partkey, 1, unnest(string_split(b, '')) FROM x) GROUP BY ALL)
SELECT p_partkey, round(sum(least(na, nb)) / sum(na), 6) AS recall, round(sum(least(na, nb)) / sum(nb), 6) AS precision FROM l GROUP BY 1""")
def letter_recall(spark, d):
    a, b = F.col("p_name"), F.lower("p_type")
    return _t(spark, d, "part").select("p_partkey", F.round(A.letter_share(a, b), 6).alias("recall"), F.round(A.letter_share(b, a), 6).alias("precision"))


@query("SELECT p_partkey, p_partkey % 4 = 0 AS acronym, p_partkey % 4 IN (1, 2) AS domain FROM part")
def acr_fit(spark, d):
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    initials = C.joined(F.transform(F.split(n, " "), lambda w: F.substring(w, 1, 1)))
    run = F.replace(n, F.lit(" "), F.lit(""))
    short = F.replace(initials, F.lit(" "), F.lit(""))
    text = F.when(k == 0, short).when(k == 1, run).when(k == 2, F.concat(F.substring(n, 1, 1), F.substring_index(n, " ", -1))).otherwise("zqzqzq")
    return _t(spark, d, "part").select("p_partkey", (text == short).alias("acronym"), A.fits_address_udf()(text, n).alias("domain"))


@query(""", m AS (SELECT s, count(*) AS m FROM top1 WHERE p >= 0.5 GROUP BY s), k AS (SELECT s, least(count(*), 4) AS k, round(CAST(sum(CAST(round(p * 1000) AS BIGINT)) AS DOUBLE) / count(*)) / 1000 AS t FROM top1 WHERE p < 0.5 GROUP BY s), x AS (SELECT s, coalesce(m, 0) AS m, k, t FROM k LEFT JOIN m USING (s)),
j AS (SELECT *, unnest(generate_series(0, k)) AS j FROM x), g AS (SELECT *, factorial(CAST(k AS INT)) / (factorial(CAST(j AS INT)) * factorial(CAST(k - j AS INT)))::DOUBLE * pow(t, j) * pow(1 - t, k - j) AS w,
CASE WHEN m + j = 0 THEN 0 ELSE 1.25 * ((m + j) / (m + k)) / (0.25 * ((m + j) / (m + k)) + 1) END - CASE WHEN m + j = 0 THEN 1 WHEN m = 0 THEN 0 ELSE 1.25 * (m / (m + j)) / (0.25 + m / (m + j)) END AS c FROM j)
SELECT s, round(sum(w * c), 6) AS gain FROM g GROUP BY s""")
def row_gain(spark, d):
    t = scored.top_k(pairs(spark, d), 1)
    m = t.where("p >= 0.5").groupBy("s").agg(F.count("*").alias("m"))
    k = t.where("p < 0.5").groupBy("s").agg(F.least(F.count("*"), F.lit(4)).alias("k"), (F.round(F.sum(F.round(F.col("p") * 1000).cast("long")) / F.count("*")) / 1000).alias("t"))
    x = k.join(m, "s", "left").na.fill(0, ["m"])
    return x.select("s", F.round(A.row_gain_column(F.col("m").cast("double"), F.col("k"), F.col("t")), 6).alias("gain"))


@query(", k AS (SELECT q, s, p, count(*) OVER (PARTITION BY s)::DOUBLE AS k FROM top1 WHERE p >= 0.4) SELECT q, s, round(CASE WHEN k = 1 THEN (1 - p) * 0.5 - p ELSE (1 - p) * (1 - 1.25 * ((k - 1) / k) / (0.25 * ((k - 1) / k) + 1)) - p * (1 - 1.25 * ((k - 1) / k) / (0.25 + (k - 1) / k)) END, 6) AS gain FROM k")
def pair_gain(spark, d):
    t = scored.top_k(pairs(spark, d), 1).where("p >= 0.4").withColumn("k", F.count("*").over(Window.partitionBy("s")).cast("double"))
    return t.select("q", "s", F.round(A.veto_gain(F.col("k"), F.col("p"), 0.5), 6).alias("gain"))


@query(""", x AS (SELECT q, s, p, rank_q, p * (1 - p) AS v, sum(p) OVER w AS rt, sum(p * (1 - p)) OVER w AS vt, exp(sum(ln(greatest(1 - p, 1e-12))) OVER w) AS none FROM r WINDOW w AS (PARTITION BY s)),
y AS (SELECT *, row_number() OVER w AS k, sum(p) OVER (w ROWS UNBOUNDED PRECEDING) AS x, sum(v) OVER (w ROWS UNBOUNDED PRECEDING) AS vx FROM x WHERE rank_q = 1 AND p > 0.02 WINDOW w AS (PARTITION BY s ORDER BY p DESC, q)),
z AS (SELECT *, round(1.25 * x / (k + 0.25 * rt) - 0.3125 * (k + 0.25 * (rt - x)) / pow(k + 0.25 * rt, 3) * vx + 0.078125 * x / pow(k + 0.25 * rt, 3) * greatest(vt - vx, 0), 9) AS f FROM y),
b AS (SELECT s, max(f) AS f, any_value(none) AS none FROM z GROUP BY s), m AS (SELECT z.s, min(k) AS kmax FROM z JOIN b ON b.s = z.s AND b.f = z.f WHERE b.f > round(b.none, 9) GROUP BY z.s)
SELECT q, z.s FROM z JOIN m ON m.s = z.s WHERE k <= kmax""")
def expf_delta(spark, d):
    """Expected F0.5 with a second-order correction for the variance of the counts."""
    return A.decide_analytic(pairs(spark, d))


@query(_NP + """, e AS (SELECT DISTINCT array_to_string(list_sort(list_distinct(string_split(nm, ' '))), ' ') AS k, ad FROM ent), h AS (SELECT q, s, qa, sw, array_to_string(list_sort(list_distinct(qw)), ' ') AS k FROM np WHERE rank_q = 1)
SELECT sa AS street, count(*) AS n, CAST(sum(CAST(EXISTS (SELECT 1 FROM e WHERE e.ad = h.qa AND e.k = h.k) AS INT)) AS BIGINT) AS hits FROM h JOIN (SELECT s AS s0, ad AS sa FROM ent) o ON o.s0 = h.s GROUP BY sa""")
def perm_excess(spark, d):
    """How often a record's words are some entity's of its street: the count that shuffled words are held against."""
    t = named(spark, d).where("rank_q = 1").select("q", "s", "sa", F.col("qa").alias("ad"), A.name_key(F.col("qn")).alias("k"))
    e = parts(spark, d).select(A.name_key(F.col("nm")).alias("k"), "ad").distinct().withColumn("hit", F.lit(1))
    return t.join(e, ["k", "ad"], "left").groupBy(F.col("sa").alias("street")).agg(F.count("*").alias("n"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"))


@query(_NP + """, h AS (SELECT q, s, country, qa, qn FROM np WHERE rank_q = 1), a AS (SELECT *, row_number() OVER (PARTITION BY country, qa ORDER BY md5(concat_ws('-', '5a', q, s))) AS k FROM h), b AS (SELECT country, qa, qn AS qn2, row_number() OVER (PARTITION BY country, qa ORDER BY md5(concat_ws('-', '5b', q, s))) AS k FROM h)
SELECT q, s, b.qn2 AS shuffled FROM a JOIN b USING (country, qa, k)""")
def perm_null(spark, d):
    """A rule's chance level: names dealt anew among the records of a country and street."""
    t = named(spark, d).where("rank_q = 1").select("q", "s", "country", "qa", "qn")
    return A.shuffled(t, ["qn"], 5, ["country", "qa"]).select("q", "s", F.col("qn").alias("shuffled"))


_THIN = """, es AS (SELECT s, concat('c', s % 5) AS country FROM entities), rs AS (SELECT DISTINCT q, country FROM pairs),
ks AS (SELECT * FROM es WHERE ('0x' || substr(md5(concat_ws('-', 'tl', s)), 1, 7))::BIGINT / 268435456.0 < CASE country WHEN 'c0' THEN 0.5 ELSE 0.8 END), km AS (SELECT * FROM rs WHERE q IN (SELECT q FROM truth WHERE s IN (SELECT s FROM ks))), kp AS (SELECT * FROM rs WHERE q NOT IN (SELECT q FROM km)),
rt AS (SELECT country, least(1, greatest(0, (CASE country WHEN 'c1' THEN 3 ELSE 2 END * (SELECT count(*) FROM ks x WHERE x.country = c.country) - (SELECT count(*) FROM km x WHERE x.country = c.country)) / (SELECT count(*) FROM kp x WHERE x.country = c.country)::DOUBLE)) AS rate FROM (SELECT DISTINCT country FROM ks) c),
kd AS (SELECT q, country FROM kp JOIN rt USING (country) WHERE ('0x' || substr(md5(concat_ws('-', '11', q)), 1, 7))::BIGINT / 268435456.0 < rate), kq AS (SELECT * FROM km UNION ALL SELECT * FROM kd)
"""


def _thinned(spark, d):
    e = entities(spark, d).withColumn("country", F.concat(F.lit("c"), (F.col("s") % 5).cast("string")))
    r = pairs(spark, d).select("q", "country").distinct()
    return A.thin(e, r, truth(spark, d), {"c0": 0.5}, {"c1": 3.0}, (0.8, 2.0))


@query(_THIN + "SELECT q, s, p, count(*) OVER (PARTITION BY q) AS n_cand, row_number() OVER (PARTITION BY q ORDER BY p DESC, s) AS rank_q FROM pairs WHERE q IN (SELECT q FROM kq) AND s IN (SELECT s FROM ks)")
def density_sim(spark, d):
    """Pairs of a labelled set thinned to another density, group features computed anew."""
    s, q = _thinned(spark, d)
    t = pairs(spark, d).join(q.select("q"), "q", "left_semi").join(s.select("s"), "s", "left_semi")
    return scored.ranked(t).select("q", "s", "p", F.count("*").over(Window.partitionBy("q")).alias("n_cand"), "rank_q")


@query(_THIN + "SELECT 'entity' AS kind, s AS id, country FROM ks UNION ALL SELECT 'record', q, country FROM kq")
def density_split(spark, d):
    """The thinned set itself, to be searched."""
    s, q = _thinned(spark, d)
    return s.select(F.lit("entity").alias("kind"), F.col("s").alias("id"), "country").unionByName(q.select(F.lit("record").alias("kind"), F.col("q").alias("id"), "country"))


@query(", smp AS (SELECT s FROM entities WHERE ('0x' || substr(md5(concat_ws('-', 'cs', s)), 1, 7))::BIGINT / 268435456.0 < 0.3), rs AS (SELECT DISTINCT q FROM pairs) SELECT q FROM rs WHERE q IN (SELECT q FROM truth WHERE s IN (SELECT s FROM smp)) OR q NOT IN (SELECT q FROM truth) AND ('0x' || substr(md5(concat_ws('-', 'cr', q)), 1, 7))::BIGINT / 268435456.0 < 0.3")
def cluster_sample(spark, d):
    """All records of sampled entities, and unmatched records at the same rate (a sample is the feature)."""
    s = entities(spark, d).where(A.hash_unit(F.lit("cs"), F.col("s").cast("string")) < 0.3)
    t, r = truth(spark, d), pairs(spark, d).select("q").distinct()
    mine = r.join(t.join(s, "s", "left_semi").select("q"), "q", "left_semi")
    free = r.join(t.select("q"), "q", "left_anti").where(A.hash_unit(F.lit("cr"), F.col("q").cast("string")) < 0.3)
    return mine.unionByName(free)


_MISTAKES = _EXPECTED + _F05 + """, e1 AS (SELECT q, s, 'remove' AS op FROM dec ANTI JOIN truth USING (q, s)), e2 AS (SELECT q, s, 'add' AS op FROM truth ANTI JOIN dec USING (q, s)),
v AS (SELECT 'decoy' AS kind, q, s FROM dec ANTI JOIN e1 USING (q, s) UNION ALL SELECT 'missed', q, s FROM dec UNION ALL SELECT 'missed', q, s FROM e2),
vn AS (SELECT kind, e.s, (SELECT count(*) FROM v x WHERE x.kind = k.kind AND x.s = e.s) AS np, (SELECT count(*) FROM truth t WHERE t.s = e.s) AS nt, (SELECT count(*) FROM v x JOIN truth t ON t.q = x.q AND t.s = x.s WHERE x.kind = k.kind AND x.s = e.s) AS tp FROM entities e, (VALUES ('decoy'), ('missed')) k(kind)),
vf AS (SELECT kind, round(avg(CASE WHEN nt = 0 THEN CAST(np = 0 AS DOUBLE) WHEN tp = 0 THEN 0 ELSE 1.25 * (tp / np) * (tp / nt) / (0.25 * (tp / np) + tp / nt) END) - (SELECT avg(f) FROM f), 6) AS gain FROM vn GROUP BY kind)
"""


@query(_MISTAKES + "SELECT * FROM vf")
def mistake_gain(spark, d):
    """What the metric gains if one kind of mistake is mended."""
    dec, tr, ent = scored.decide_expected(pairs(spark, d)), truth(spark, d), entities(spark, d)
    wrong, missed = dec.join(tr, ["q", "s"], "left_anti"), tr.join(dec, ["q", "s"], "left_anti")
    mended = {"decoy": dec.join(wrong, ["q", "s"], "left_anti"), "missed": dec.unionByName(missed)}
    base = scored.f05_by_entity(dec, tr, ent).agg(F.avg("f").alias("base"))
    out = None
    for kind, t in mended.items():
        one = scored.f05_by_entity(t, tr, ent).agg(F.avg("f").alias("f")).join(base).select(F.lit(kind).alias("kind"), F.round(F.col("f") - F.col("base"), 6).alias("gain"))  # one row each
        out = one if out is None else out.unionByName(one)
    return out


@query(_EXPECTED + ", miss AS (SELECT q, s FROM truth ANTI JOIN dec USING (q, s)) SELECT concat('c', q % 5) AS country, round(count(*) FILTER (WHERE (q, s) IN (SELECT (q, s) FROM miss)) / (SELECT count(*) FROM miss), 6) AS share, round(count(*) / (SELECT count(*) FROM truth), 6) AS whole FROM truth GROUP BY 1")
def over_repr(spark, d):
    """A segment's share of the missed pairs beside its share of all true pairs."""
    dec = scored.decide_expected(pairs(spark, d)).withColumn("hit", F.lit(1))
    t = truth(spark, d).join(dec, ["q", "s"], "left").withColumn("miss", F.col("hit").isNull().cast("int")).groupBy(F.concat(F.lit("c"), (F.col("q") % 5).cast("string")).alias("country")).agg(F.sum("miss").alias("m"), F.count("*").alias("n"))
    whole = t.agg(F.sum("m").alias("ms"), F.sum("n").alias("ns"))
    return t.join(F.broadcast(whole)).select("country", F.round(F.col("m") / F.col("ms"), 6).alias("share"), F.round(F.col("n") / F.col("ns"), 6).alias("whole"))  # one row


@query("SELECT q, s, p, rank_q FROM r WHERE rank_q <= 5")
def top5_stream(spark, d):
    """Scores are computed and all but five candidates a record dropped in the same pass: nothing in between is kept."""
    return scored.ranked(pairs(spark, d)).where("rank_q <= 5").select("q", "s", "p", "rank_q")


@query(", m AS (SELECT CASE WHEN s % 3 = 0 THEN 'true' WHEN s % 3 = 1 THEN 'decoy' ELSE concat('g', q % 2) END AS grp, CAST(round(CASE WHEN s % 3 = 0 THEN p * 8 WHEN s % 3 = 1 THEN p * 2 ELSE p * 5 END) AS DOUBLE) AS oth FROM pairs), b AS (SELECT grp, count(*) AS n, avg(oth) AS m, stddev_pop(oth) / sqrt(count(*)) AS se, avg(CAST(oth = 0 AS DOUBLE)) AS z FROM m GROUP BY grp), c AS (SELECT *, sqrt(z * (1 - z) / n) AS ze FROM b), t AS (SELECT * FROM c WHERE grp = 'true'), y AS (SELECT * FROM c WHERE grp = 'decoy'), e AS (SELECT c.grp, c.n, (y.m - c.m) / (y.m - t.m) AS a, (y.z - c.z) / (y.z - t.z) AS b, pow((y.m - t.m) / c.se, 2) AS wa, pow((y.z - t.z) / c.ze, 2) AS wb FROM c, t, y WHERE c.grp NOT IN ('true', 'decoy')) SELECT grp, n, round(a, 6) AS by_mean, round(b, 6) AS by_zero, round((wa * a + wb * b) / (wa + wb), 6) AS share FROM e")
def mixture(spark, d):
    k = F.col("s") % 3
    t = pairs(spark, d).select(F.when(k == 0, "true").when(k == 1, "decoy").otherwise(F.concat(F.lit("g"), (F.col("q") % 2).cast("string"))).alias("grp"), F.round(F.when(k == 0, F.col("p") * 8).when(k == 1, F.col("p") * 2).otherwise(F.col("p") * 5)).cast("double").alias("oth"))
    out = A.mixture_share(t, "oth", "grp")
    return out.select("grp", "n", *(F.round(c, 6).alias(c) for c in ("by_mean", "by_zero", "share")))


@query()
def logit_shift(spark, d):
    """The shift of each country's logits at which its mean score is a target."""
    return A.logit_shift(pairs(spark, d), "country", {"c0": 0.4, "c1": 0.5, "c2": 0.6})


@query()
def probe_fit(spark, d):
    """Two parameters fitted to three probes of a metric: aggregates come from the tables, the fit runs on the driver."""
    rows = pairs(spark, d).where("country IN ('c0', 'c1', 'c2')").groupBy("country").agg(F.avg("p").alias("p"), F.avg("label").alias("y")).orderBy("country").collect()  # three rows
    a, b = A.least_squares(spark, [([r["p"]], r["y"]) for r in rows], [0.0, 0.0], lambda v, x: v[0] + v[1] * x[0])
    return spark.createDataFrame([(round(a, 6), round(b, 6))], "a double, b double")


@query(", b AS (SELECT q, s, p, label, CASE WHEN (q * 3) % 40 = (s * 5) % 40 THEN '0' WHEN (q * 3) % 40 - (s * 5) % 40 = 1 THEN '+1' WHEN (q * 3) % 40 - (s * 5) % 40 BETWEEN 2 AND 5 THEN '+2..5' WHEN (q * 3) % 40 - (s * 5) % 40 BETWEEN 6 AND 20 THEN '+6..20' WHEN (q * 3) % 40 - (s * 5) % 40 BETWEEN -20 AND -1 THEN '-1..-20' ELSE 'other' END AS band FROM pairs) SELECT label, band, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM b GROUP BY label, band")
def num_bands(spark, d):
    """House-number differences in bands, by label."""
    x = (F.col("q") * 3) % 40 - (F.col("s") * 5) % 40
    band = F.when(x == 0, "0").when(x == 1, "+1").when(x.between(2, 5), "+2..5").when(x.between(6, 20), "+6..20").when(x.between(-20, -1), "-1..-20").otherwise("other")
    n = pairs(spark, d).groupBy("label", band.alias("band")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("label")), 6))
