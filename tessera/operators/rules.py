"""Rules on decided pairs: per-country dispatch, vetoes and overrides, movers, second-source recall, same address, candidates.

Decided pairs are (q, s) with q unique; scores are (q, s, p). A rule returns pairs or scores and never changes its inputs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scored import decide_expected, top_k


def dispatch(scores: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Decides every country by its own rule ({'type': 'thr', 't'} or {'type': 'expf', 'floor', 'alpha'}), others by 'default'.

    Countries with equal rules are decided together: one plan for each distinct rule, not one for each country.
    """
    named = [c for c in rules if c != "default"]
    kinds: dict[tuple, list] = {}
    for c in rules:
        kinds.setdefault(tuple(sorted(rules[c].items())), []).append(c)
    out = []
    for rule, countries in kinds.items():
        rule, known = dict(rule), [c for c in countries if c != "default"]
        mine = F.col("country").isin(known) if known else F.lit(False)
        if "default" in countries:
            mine = mine | ~F.col("country").isin(named) if named else F.lit(True)
        t = scores.where(mine)
        out.append(top_k(t, 1).where(F.col("p") >= rule["t"]).select("q", "s") if rule["type"] == "thr" else decide_expected(t, rule["floor"], rule["alpha"]))
    return reduce(DataFrame.unionByName, out)


def with_flag(scores: DataFrame, pairs: DataFrame, name: str) -> DataFrame:
    return scores.join(pairs.select("q", "s").distinct().withColumn(name, F.lit(True)), ["q", "s"], "left").withColumn(name, F.coalesce(name, F.lit(False)))


def min_rule(scores: DataFrame, other: DataFrame, where: Column) -> DataFrame:
    """Where the condition holds, a pair keeps at most the other model's score (0 if that has none)."""
    t = scores.join(other.select("q", "s", F.col("p").alias("_o")), ["q", "s"], "left")
    return t.withColumn("p", F.when(where, F.least("p", F.coalesce("_o", F.lit(0.0)))).otherwise(F.col("p"))).drop("_o")


def override_sets(scores: DataFrame, veto: DataFrame, raise_: DataFrame, add: DataFrame, floor: float = 0.95) -> DataFrame:
    """Vetoed pairs get 0, raised ones at least `floor`, added ones `floor`, also where they had no score; a veto goes first, an add last."""
    t = with_flag(with_flag(with_flag(scores.select("q", "s", "p"), veto, "_v"), raise_, "_r"), add, "_a")
    p = F.when(F.col("_a"), F.lit(floor)).when(F.col("_r"), F.greatest(F.when(F.col("_v"), 0.0).otherwise(F.col("p")), F.lit(floor))).when(F.col("_v"), 0.0).otherwise(F.col("p"))
    new = add.select("q", "s").distinct().join(scores, ["q", "s"], "left_anti").withColumn("p", F.lit(floor))
    return t.select("q", "s", p.alias("p")).unionByName(new)


def movers(base: DataFrame, wide: DataFrame, old: DataFrame, wide_scores: DataFrame, old_scores: DataFrame, truth_p: DataFrame, remove: float = 0.5, restore: float = 0.8) -> DataFrame:
    """Pairs on which two builds disagree, arbitrated by a calibrated p (truth_p: q, s, pt): q, s, move ('removed' or 'restored').

    Removed: decided by the wide build only, though its entity was in the old list, still in the base, pt below `remove`.
    Restored: decided by the old build only, the record's best in the old scores, unmatched in the base, pt from `restore` on.
    """
    best_old = top_k(old_scores, 1).select("q", F.col("s").alias("_best"))
    adds = wide.join(old, ["q", "s"], "left_anti").join(old_scores.select("q", "s"), ["q", "s"], "left_semi").join(base, ["q", "s"], "left_semi")
    drops = old.join(wide, ["q", "s"], "left_anti").join(best_old, "q").where("_best = s").drop("_best").join(base.select("q"), "q", "left_anti")
    gone = adds.join(truth_p, ["q", "s"]).where(F.col("pt") < remove).select("q", "s", F.lit("removed").alias("move"))
    back = drops.join(truth_p, ["q", "s"]).where(F.col("pt") >= restore).select("q", "s", F.lit("restored").alias("move"))
    return gone.unionByName(back)


def second_recall(second: DataFrame, lists: DataFrame, base: DataFrame, scores: DataFrame, tags: DataFrame, reject: str, least: float = 0.8) -> DataFrame:
    """Pairs of a second source outside our lists whose record is unmatched, whose change tags (q, s, tags) hold no rejected one, scored well."""
    t = second.select("q", "s").join(lists, ["q", "s"], "left_anti").join(base.select("q"), "q", "left_anti")
    t = t.join(scores.select("q", "s", "p"), ["q", "s"]).where(F.col("p") >= least).join(tags, ["q", "s"])
    return t.where(~F.exists("tags", lambda x: x.rlike(reject))).select("q", "s")


def same_address(records: DataFrame, entities: DataFrame, base: DataFrame, elsewhere: DataFrame, exclude: DataFrame, judge: Column, most: int = 50) -> DataFrame:
    """Pairs of unmatched records with the one entity at their address whose name is theirs up to noise.

    records (q, country, k, qn), entities (s, country, k, sn, run): k is an address key 'number|street words', run the squashed
    name. Steps: records matched in `base` go; keys shared by more than `most` entities are skipped; `judge` is asked of each
    pair of qn and sn; a record with two entities left has none; pairs in `exclude` go, records that the second source matches
    `elsewhere` go; entities with a namesake on the same street go; entities without any match in `base` get none.
    """
    block = entities.where("k IS NOT NULL").withColumn("nb", F.count("*").over(Window.partitionBy("country", "k"))).where(F.col("nb") <= most)
    free = records.where("k IS NOT NULL").join(base.select("q"), "q", "left_anti")
    ok = free.join(block.select("country", "k", "s", "sn", "run"), ["country", "k"]).where(judge)
    ok = ok.withColumn("n_ok", F.count("*").over(Window.partitionBy("q"))).where("n_ok = 1")
    ok = ok.join(exclude.select("q", "s"), ["q", "s"], "left_anti")
    moved = ok.select("q", "s").join(elsewhere.select("q", F.col("s").alias("s2")), "q").where("s2 <> s").select("q").distinct()
    ok = ok.join(moved, "q", "left_anti")
    street = F.substring_index("k", "|", -1)
    twins = entities.where("k IS NOT NULL").groupBy("country", "run", street.alias("street")).agg(F.count("*").alias("n_street"))
    ok = ok.withColumn("street", street).join(twins, ["country", "run", "street"]).where("n_street = 1")
    return ok.join(base.select("s"), "s", "left_semi").select("q", "s")


def candidate_lists(scored: DataFrame, matched: DataFrame, extras: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(candidates, matched pairs that are none): scored pairs and those extra pairs that are matched."""
    out = scored.select("q", "s")
    for e in extras:
        out = out.unionByName(e.select("q", "s").join(matched, ["q", "s"], "left_semi"))
    out = out.distinct()
    return out, matched.select("q", "s").join(out, ["q", "s"], "left_anti")


def tier_union(sources: list[tuple[str, float, DataFrame]], taken: DataFrame) -> DataFrame:
    """q, s, grp, est: the first source that names a free record wins; est is the source's true share."""
    parts = [t.select("q", "s", F.lit(g).alias("grp"), F.lit(float(est)).alias("est"), F.lit(i).alias("_i")) for i, (g, est, t) in enumerate(sources)]
    rows = reduce(DataFrame.unionByName, parts).join(taken.select("q"), "q", "left_anti")
    best = Window.partitionBy("q").orderBy("_i", "s")
    return rows.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_i", "_k")


def add_gain(added: DataFrame, matched: DataFrame) -> DataFrame:
    """Expected change of an entity's F0.5 by each added pair (q, s, est) and the true share at which it breaks even.

    k pairs are matched already and taken as true; a true pair that is left out costs recall, a false one precision.
    """
    k = F.coalesce("k", F.lit(0)).cast("double")
    t = added.join(matched.groupBy("s").agg(F.count("*").alias("k")), "s", "left")
    gain = F.when(k == 0, 1.0).otherwise(1 - 1.25 * k / (1.25 * k + 0.25))
    loss = F.when(k == 0, 1.0).otherwise(1 - 1.25 * k / (1.25 * k + 1))
    return t.select("q", "s", "est", gain.alias("gain"), loss.alias("loss")).withColumn("change", F.col("est") * F.col("gain") - (1 - F.col("est")) * F.col("loss")).withColumn("even", F.col("loss") / (F.col("gain") + F.col("loss")))


def number_conflict(a: Column, b: Column) -> Column:
    """Both house numbers are there, differ, and neither begins the other (a cut number is noise)."""
    return a.isNotNull() & b.isNotNull() & (a != b) & ~a.startswith(b) & ~b.startswith(a)


def swapped(a: Column, b: Column, words: list[str], same: list[list[str]] = ()) -> Column:
    """Each name has a descriptor of the list that the other lacks; descriptors of one `same` group count as one."""
    canon = {w: g[0] for g in same for w in g}
    keep = lambda c: F.array_distinct(F.transform(F.filter(c, lambda w: w.isin(words)), lambda w: reduce(lambda x, kv: F.when(w == kv[0], kv[1]).otherwise(x), canon.items(), w)))
    x, y = keep(a), keep(b)
    return (F.size(F.array_except(x, y)) > 0) & (F.size(F.array_except(y, x)) > 0)


def restore_street(scores: DataFrame, first: DataFrame, same_street: Column, least: float = 0.5) -> DataFrame:
    """Pairs that a later model lowered get the first model's score back where number and street agree; scores has the texts."""
    t = scores.join(first.select("q", "s", F.col("p").alias("_g")), ["q", "s"], "left")
    back = (F.col("_g") >= least) & (F.col("p") < F.col("_g")) & same_street
    return t.withColumn("p", F.when(back, F.col("_g")).otherwise(F.col("p"))).drop("_g")
