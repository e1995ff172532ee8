"""Operators over scored pair tables (q, s, p): ranks, margins, keep rules, blends, decisions, overrides.

A record q has candidates s with score p. Ties are broken by s within q and by q within s. Everything is a window or an
aggregate on q or on s, so a cascade of them costs one shuffle by q and one by s.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_q(order: str = "p"):
    return Window.partitionBy("q").orderBy(F.desc(order), "s")


def by_s(order: str = "p"):
    return Window.partitionBy("s").orderBy(F.desc(order), "q")


def ranked(pairs: DataFrame, col: str = "p", name: str = "rank_q") -> DataFrame:
    return pairs.withColumn(name, F.row_number().over(by_q(col)))


def top_k(pairs: DataFrame, k: int, col: str = "p") -> DataFrame:
    return pairs.withColumn("_r", F.row_number().over(by_q(col))).where(F.col("_r") <= k).drop("_r")


def second_max(pairs: DataFrame, col: str, key: str, name: str = "second") -> DataFrame:
    """Second largest in the group; the only value of a group of one. One sort of the group, no list of it."""
    w = Window.partitionBy(key)
    t = pairs.withColumn("_k", F.row_number().over(w.orderBy(F.desc(col))))
    return t.withColumn(name, F.coalesce(F.max(F.when(F.col("_k") == 2, F.col(col))).over(w), F.max(col).over(w))).drop("_k")


def margin(pairs: DataFrame, col: str = "p", name: str = "margin") -> DataFrame:
    """Value less the best other of the same q: 0 taken for the other of a lone row, and 0 for a tie at the top."""
    w = Window.partitionBy("q")
    top = Window.partitionBy("q").orderBy(F.desc(col), "s")
    t = pairs.withColumn("_m1", F.max(col).over(w)).withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(top))
    t = t.withColumn("_m2", F.max(F.when(F.col("_r") == 2, F.col(col))).over(w))
    other = F.when(F.col("_n") == 1, 0.0).when(F.col(col) == F.col("_m1"), F.col("_m2")).otherwise(F.col("_m1"))
    return t.withColumn(name, F.col(col) - other).drop("_m1", "_m2", "_n", "_r")


def others(pairs: DataFrame, key: str = "s", col: str = "p") -> DataFrame:
    w = Window.partitionBy(key)
    return pairs.withColumn("n_other", F.count("*").over(w) - 1).withColumn("sum_other", F.sum(col).over(w) - F.col(col))


def keep_top2(pairs: DataFrame, least: float = 0.01, later: float = 0.005) -> DataFrame:
    """Rank 1 always, rank 2 from `least` on, ranks 3 to 5 from `later` on."""
    r, p = F.col("rank_q"), F.col("p")
    return ranked(pairs).where((r == 1) | (r == 2) & (p >= least) | r.between(3, 5) & (p >= later))


def close_calls(pairs: DataFrame, lo: float = 0.01, hi: float = 0.995, second: float = 0.2) -> DataFrame:
    """Records whose best score is in [lo, hi], or whose second candidate reaches `second`."""
    t = ranked(pairs)
    g = t.groupBy("q").agg(F.max("p").alias("best"), F.max(F.when(F.col("rank_q") == 2, F.col("p"))).alias("next"))
    return pairs.join(g.where(F.col("best").between(lo, hi) | (F.coalesce("next", F.lit(0.0)) >= second)).select("q"), "q", "left_semi")


def stage2(pairs: DataFrame) -> DataFrame:
    """Counts and sums over other records whose best candidate is the same s, and ranks within s."""
    w = Window.partitionBy("q")
    b = ranked(pairs).withColumn("p_margin", F.when(F.count("*").over(w) > 1, 2 * F.col("p") - F.sum("p").over(w)).otherwise(F.col("p")))
    top = b.where("rank_q = 1")
    ordered = Window.partitionBy("s").orderBy(F.desc("p"), "q")
    r = top.withColumn("_k", F.row_number().over(ordered))
    g = r.groupBy("s").agg(
        F.sum((F.col("p") >= 0.5).cast("int")).alias("cnt"), F.sum("p").alias("sm"), F.max("p").alias("m1"), F.max(F.when(F.col("_k") == 2, F.col("p"))).alias("m2"), F.count("*").alias("n")
    )
    is_top = F.col("rank_q") == 1
    out = b.join(g, "s", "left").withColumn("q_rank_in_s", F.row_number().over(by_s())).withColumn("s_base_cnt", F.count("*").over(Window.partitionBy("s")))
    best_other = F.when(is_top & (F.col("p") == F.col("m1")) & (F.col("n") > 1), F.col("m2")).when(is_top & (F.col("n") == 1), 0.0).otherwise(F.coalesce("m1", F.lit(0.0)))
    return out.select(
        "q", "s", "p", "rank_q", "p_margin",
        (F.coalesce("cnt", F.lit(0)) - (is_top & (F.col("p") >= 0.5)).cast("int")).alias("s_in_cnt"),
        (F.coalesce("sm", F.lit(0.0)) - F.when(is_top, F.col("p")).otherwise(0.0)).alias("s_in_sum"),
        best_other.alias("s_in_max_other"), "q_rank_in_s", "s_base_cnt",
    )


def sibling(pairs: DataFrame) -> DataFrame:
    """The best other top record of the same s."""
    top = ranked(pairs).where("rank_q = 1").select("s", "q", "p").withColumn("_k", F.row_number().over(by_s())).where("_k <= 2")
    two = top.groupBy("s").agg(F.max(F.when(F.col("_k") == 1, F.col("q"))).alias("q1"), F.max(F.when(F.col("_k") == 2, F.col("q"))).alias("q2"))
    return pairs.join(two, "s", "left").select("q", "s", F.when(F.col("q1") == F.col("q"), F.col("q2")).otherwise(F.col("q1")).alias("sib"))


def consensus(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """Mean and count of confident top peers of the same s, self excluded; null without peers."""
    t = ranked(pairs).withColumn("_peer", (F.col("rank_q") == 1) & (F.col("p") >= least))
    w = Window.partitionBy("s")
    n = F.sum(F.col("_peer").cast("int")).over(w) - F.col("_peer").cast("int")
    total = F.sum(F.when(F.col("_peer"), F.col("p")).otherwise(0.0)).over(w) - F.when(F.col("_peer"), F.col("p")).otherwise(0.0)
    return t.withColumn("n_peers", n).select("q", "s", "n_peers", F.when(F.col("n_peers") > 0, total / F.col("n_peers")).alias("peer_mean"))


def decide_threshold(pairs: DataFrame, thresholds: dict[str, float], default: float) -> DataFrame:
    t = F.lit(default)
    for country, value in thresholds.items():
        t = F.when(F.col("country") == country, value).otherwise(t)
    return top_k(pairs, 1).where(F.col("p") >= t).select("q", "s")


def decide_expected(pairs: DataFrame, floor: float = 0.3, alpha: float = 1.0) -> DataFrame:
    """The prefix of each s's records, best first, of greatest expected F0.5, if it beats returning none."""
    c = top_k(pairs, 1).where(F.col("p") >= floor).withColumn("x", F.pow("p", F.lit(alpha)))
    w, whole = by_s(), Window.partitionBy("s")
    t = (
        c.withColumn("k", F.row_number().over(w)).withColumn("cum", F.sum("x").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("tot", F.sum("x").over(whole)).withColumn("none", F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("x")))).over(whole)))
        .withColumn("ef", F.round(1.25 * F.col("cum") / (F.col("k") + 0.25 * F.col("tot")), 9))
    )
    best = t.withColumn("_b", F.max(F.struct("ef", (-F.col("k")).alias("k"))).over(whole))
    return best.where((F.col("_b.ef") > F.round("none", 9)) & (F.col("k") <= -F.col("_b.k"))).select("q", "s")


def macro_f05(decided: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    """Mean over all s of F0.5; 1 where both sets are empty, 0 where nothing is hit."""
    per = f05_by_entity(decided, truth, entities)
    return per.agg(F.round(F.avg("f"), 6).alias("macro_f05"), F.count("*").alias("n"))


def f05_by_entity(decided: DataFrame, truth: DataFrame, entities: DataFrame) -> DataFrame:
    n_p = decided.groupBy("s").agg(F.count("*").alias("np"))
    n_t = truth.groupBy("s").agg(F.count("*").alias("nt"))
    hit = decided.join(truth, ["q", "s"]).groupBy("s").agg(F.count("*").alias("tp"))
    t = reduce(lambda a, b: a.join(b, "s", "left"), (n_p, n_t, hit), entities).na.fill(0, ["np", "nt", "tp"])
    p, r = F.col("tp") / F.col("np"), F.col("tp") / F.col("nt")
    f = F.when(F.col("nt") == 0, (F.col("np") == 0).cast("double")).when(F.col("tp") == 0, 0.0).otherwise(1.25 * p * r / (0.25 * p + r))
    return t.withColumn("f", f)


def blend(tables: list[DataFrame], weights: list[float]) -> DataFrame:
    """Weighted mean over the tables that have the pair: one aggregation of their union, no chain of outer joins."""
    parts = [t.select("q", "s", (F.col("p") * w).alias("wp"), F.lit(w).alias("w")) for t, w in zip(tables, weights)]
    return reduce(DataFrame.unionByName, parts).groupBy("q", "s").agg((F.sum("wp") / F.sum("w")).alias("p"))


def override(base: DataFrame, rescored: DataFrame) -> DataFrame:
    """A record that was rescored takes its new scores; its other rows get 0."""
    new = rescored.select("q", "s", F.col("p").alias("p3"))
    touched = rescored.select("q").distinct().withColumn("_t", F.lit(True))
    p = F.when(F.col("_t"), F.coalesce("p3", F.lit(0.0))).otherwise(F.col("p"))
    return base.join(new, ["q", "s"], "left").join(touched, "q", "left").select("q", "s", p.alias("p"))


def apply_sets(decided: DataFrame, add: DataFrame, veto: DataFrame) -> DataFrame:
    """An added pair moves its record from wherever it was; a vetoed pair goes."""
    moved = decided.join(add.select("q"), "q", "left_anti").unionByName(add.select("q", "s"))
    return moved.join(veto.select("q", "s"), ["q", "s"], "left_anti")


def top_fraction(pairs: DataFrame, rates: dict, default: float | None, key: str = "country", buckets: int = 4096) -> DataFrame:
    """The best round(rate * n) rows of each group, by p, q and s; groups without a rate take the default (None: no row).

    Rows are counted by group and score bucket; whole buckets are kept or dropped, and only the rows of the one bucket in
    which a group's cut lies are ranked, so that a large group isn't sorted in one task.
    """
    rate = F.lit(default).cast("double")
    for c, r in rates.items():
        rate = F.when(F.col(key) == c, float(r)).otherwise(rate)
    return best_rows(pairs, key, lambda n: F.coalesce(F.round(rate * n), F.lit(0)), buckets)


def best_rows(pairs: DataFrame, key: str, most, buckets: int = 4096) -> DataFrame:
    """Of each group the best `most(n)` rows, n being its size."""
    t = pairs.withColumn("_b", F.floor(F.col("p") * buckets).cast("long"))
    down = Window.partitionBy(key).orderBy(F.desc("_b"))
    counts = t.groupBy(key, "_b").agg(F.count("*").alias("_c"))
    counts = counts.withColumn("_above", F.sum("_c").over(down.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy(key)))
    cut = counts.withColumn("_left", most(F.col("_n")) - F.col("_above")).where("_left > 0").select(key, "_b", "_left", "_c")
    kept = t.join(cut, [key, "_b"])
    whole = kept.where("_left >= _c").drop("_b", "_left", "_c")
    w = Window.partitionBy(key).orderBy(F.desc("p"), "q", "s")
    part = kept.where("_left < _c").withColumn("_r", F.row_number().over(w)).where("_r <= _left")
    return whole.unionByName(part.drop("_b", "_left", "_c", "_r"))


def top_up(pairs: DataFrame, targets: dict, key: str = "country") -> DataFrame:
    """Rows (with a boolean `acc`) added so that each group accepts its target share: the best of those not yet accepted."""
    goal = F.lit(None).cast("double")
    for c, r in targets.items():
        goal = F.when(F.col(key) == c, float(r)).otherwise(goal)
    need = pairs.groupBy(key).agg(F.count("*").alias("_all"), F.sum(F.col("acc").cast("int")).alias("_acc")).withColumn("_need", F.round(goal * F.col("_all")) - F.col("_acc"))
    open_ = pairs.where("NOT acc").join(need.where("_need > 0").select(key, "_need"), key)
    w = Window.partitionBy(key)
    limit = open_.withColumn("_b", F.floor(F.col("p") * 4096).cast("long"))
    counts = limit.groupBy(key, "_b").agg(F.count("*").alias("_c"), F.first("_need").alias("_n"))
    cut = counts.withColumn("_left", F.col("_n") - F.sum("_c").over(w.orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_c")).where("_left > 0").select(key, "_b", "_left", "_c")
    kept = limit.join(cut, [key, "_b"])
    part = kept.where("_left < _c").withColumn("_r", F.row_number().over(w.orderBy(F.desc("p"), "q", "s"))).where("_r <= _left")
    return kept.where("_left >= _c").select("q", "s").unionByName(part.select("q", "s"))


def hybrid(a: DataFrame, b: DataFrame) -> DataFrame:
    """Records whose best candidate agrees keep a's rows, all others b's."""
    best = lambda t, n: top_k(t, 1).select("q", F.col("s").alias(n))
    same = best(a, "sa").join(best(b, "sb"), "q").where("sa = sb").select("q")
    return a.join(same, "q", "left_semi").unionByName(b.join(same, "q", "left_anti"))


def votes(fits: list[DataFrame]) -> DataFrame:
    """Pairs with the number of fits that decide for them."""
    return reduce(DataFrame.unionByName, [f.select("q", "s") for f in fits]).groupBy("q", "s").agg(F.count("*").alias("n_votes"))


def monte_carlo(pairs: DataFrame, seed: int) -> DataFrame:
    """One categorical draw for each record from its candidates' scores by running sums; no candidate with the rest."""
    u = F.pmod(F.crc32(F.concat_ws("-", F.col("q").cast("string"), F.lit(str(seed))).cast("binary")), F.lit(1_000_000)) / 1_000_000.0
    w = Window.partitionBy("q").orderBy("s")
    total = F.greatest(F.sum("p").over(Window.partitionBy("q")), F.lit(1.0))
    t = pairs.withColumn("hi", F.sum("p").over(w.rowsBetween(Window.unboundedPreceding, 0)) / total).withColumn("lo", F.col("hi") - F.col("p") / total)
    return t.where((u >= F.col("lo")) & (u < F.col("hi"))).select("q", "s")


def threshold_grid(pairs: DataFrame, truth: DataFrame, entities: DataFrame, grid) -> DataFrame:
    """floor, macro_f05, best: every threshold in one pass; the rules are a literal array on the top rows.

    Entities without decided and true records score 1 and are counted, not listed.
    """
    t = top_k(pairs, 1).join(truth.withColumn("hit", F.lit(1)), ["q", "s"], "left")
    t = t.withColumn("floor", F.explode(F.filter(F.array(*map(F.lit, grid)), lambda x: F.col("p") >= x)))
    per = t.groupBy("floor", "s").agg(F.count("*").alias("np"), F.count("hit").alias("tp")).join(truth.groupBy("s").agg(F.count("*").alias("nt")), "s", "left").na.fill(0, ["nt"])
    p, r = F.col("tp") / F.col("np"), F.col("tp") / F.col("nt")
    f = F.when((F.col("nt") == 0) | (F.col("tp") == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))
    by = per.groupBy("floor").agg(F.sum(f).alias("f"), F.count_if(F.col("nt") == 0).alias("wrong"))
    whole = entities.agg(F.count("*").alias("n")).join(truth.agg(F.count_distinct("s").alias("true")))  # one row
    rules = entities.sparkSession.createDataFrame([(float(g),) for g in grid], "floor double")
    m = rules.join(by, "floor", "left").na.fill(0).join(F.broadcast(whole))
    m = m.select("floor", F.round((F.col("f") + F.col("n") - F.col("true") - F.col("wrong")) / F.col("n"), 6).alias("macro_f05"))
    return m.withColumn("best", F.row_number().over(Window.orderBy(F.desc("macro_f05"), "floor")) == 1)  # a row for each rule
