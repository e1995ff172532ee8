"""Pair features: numbers, margins and ranks of several scores, stage-2, stage-3 and stacker features, siblings, peers.

Pairs are (q, s, p); records (q, nm, ad, n1, src) and entities (s, nm, ad, n1) hold cleaned names and addresses, the first
house number as text and the record's source. Ties go to the smaller id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from .scored import by_s, margin, ranked


def number_features(q: Column, s: Column) -> dict[str, Column]:
    """Sizes, overlap, and how the first numbers of two lists stand to each other; null where a first number is missing."""
    a, b = F.get(q, F.lit(0)), F.get(s, F.lit(0))
    x, y = a.cast("double"), b.cast("double")
    return {
        "num_q": F.size(q), "num_s": F.size(s), "num_common": F.size(F.array_intersect(q, s)),
        "num_first_eq": a == b, "num_first_in": F.array_contains(s, a),
        "num_first_prefix": (a != b) & (a.startswith(b) | b.startswith(a)),
        "num_first_reldiff": F.abs(x - y) / F.greatest(x, y, F.lit(1.0)),
    }


def margins_and_ranks(t: DataFrame, cols: list[str]) -> DataFrame:
    """For each score its margin to the best other of the record and its rank; all windows share one exchange on q."""
    for c in cols:
        t = margin(t, c, f"{c}_margin")
        t = t.withColumn(f"{c}_rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc(c), "s")))
    return t


def same_source(pairs: DataFrame, least: float = 0.5) -> DataFrame:
    """Confident top records of the same entity and source, the row itself left out; pairs has src."""
    t = ranked(pairs)
    top = t.where((F.col("rank_q") == 1) & (F.col("p") >= least)).groupBy("s", "src").agg(F.count("*").alias("_n"))
    own = ((F.col("rank_q") == 1) & (F.col("p") >= least)).cast("long")
    return t.join(top, ["s", "src"], "left").select("q", "s", (F.coalesce("_n", F.lit(0)) - own).alias("s_in_same_src"))


def siblings(pairs: DataFrame, records: DataFrame) -> DataFrame:
    """The best other top record of the same entity and how it agrees: score, number, source, missing; texts for scoring."""
    top = ranked(pairs).where("rank_q = 1").select("s", "q", "p").withColumn("_k", F.row_number().over(by_s())).where("_k <= 2")
    pick = lambda k, c: F.max(F.when(F.col("_k") == k, F.col(c)))
    two = top.groupBy("s").agg(pick(1, "q").alias("qa"), pick(1, "p").alias("pa"), pick(2, "q").alias("qb"), pick(2, "p").alias("pb"))
    own = F.col("qa") == F.col("q")
    t = pairs.join(two, "s", "left").withColumn("sib", F.when(own, F.col("qb")).otherwise(F.col("qa"))).withColumn("sib_p", F.when(own, F.col("pb")).otherwise(F.col("pa")))
    other = records.select(F.col("q").alias("sib"), F.col("nm").alias("sib_nm"), F.col("ad").alias("sib_ad"), F.col("n1").alias("sib_n1"), F.col("src").alias("sib_src"))
    t = t.select("q", "s", "sib", "sib_p").join(records, "q").join(other, "sib", "left")
    return t.select("q", "s", "sib", "sib_p", (F.col("n1") == F.col("sib_n1")).cast("int").alias("sib_num_eq"), (F.col("src") == F.col("sib_src")).cast("int").alias("sib_same_src"), F.col("sib").isNull().cast("int").alias("sib_missing"), "nm", "ad", "sib_nm", "sib_ad")


def sibling_texts(siblings: DataFrame) -> DataFrame:
    """Token-set similarity of name and address to the sibling's; null without a sibling."""
    text = lambda a, b: F.when(F.col("sib").isNotNull(), S.token_set_udf(F.coalesce(F.col(a), F.lit("")), F.coalesce(F.col(b), F.lit(""))))
    return siblings.withColumn("sib_name_tset", text("nm", "sib_nm")).withColumn("sib_addr_tset", text("ad", "sib_ad")).drop("nm", "ad", "sib_nm", "sib_ad")


def _peers(pairs: DataFrame, records: DataFrame, least: float) -> DataFrame:
    return ranked(pairs).where((F.col("rank_q") == 1) & (F.col("p") >= least)).select("s", "q").join(records, "q")


def peer_numbers(pairs: DataFrame, records: DataFrame, least: float = 0.5) -> DataFrame:
    """cons_num_share and cons_num_same over the confident top records of the same entity, the row itself left out.

    Peers are counted by (entity, number) and the row's own part is subtracted, so a popular entity makes no pairs.
    """
    peers = _peers(pairs, records, least)
    of_s = peers.groupBy("s").agg(F.count("n1").alias("_all"))
    of_n = peers.where("n1 IS NOT NULL").groupBy("s", "n1").agg(F.count("*").alias("_same"))
    t = ranked(pairs).join(records.select("q", "n1"), "q").join(of_s, "s", "left").join(of_n, ["s", "n1"], "left")
    own = F.when((F.col("rank_q") == 1) & (F.col("p") >= least) & F.col("n1").isNotNull(), 1).otherwise(0)
    n, same = F.coalesce("_all", F.lit(0)) - own, F.coalesce("_same", F.lit(0)) - own
    ok = F.col("n1").isNotNull() & (n > 0)
    return t.select("q", "s", F.when(ok, same / n).alias("cons_num_share"), F.when(ok, same).otherwise(0).alias("cons_num_same"))


def peer_texts(pairs: DataFrame, records: DataFrame, least: float = 0.5) -> DataFrame:
    """Mean and least token-set similarity of names and addresses to the confident peers, the row itself left out.

    Rows and peers of an entity are compared as distinct texts with counts: copies cost one comparison.
    """
    keep = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    recs = records.select("q", keep("nm"), keep("ad"))
    t = ranked(pairs).withColumn("_own", ((F.col("rank_q") == 1) & (F.col("p") >= least)).cast("long")).join(recs, "q")
    out = t.select("q", "s", "nm", "ad", "_own")
    for col, name in (("nm", "name"), ("ad", "addr")):
        peers = t.where("_own = 1").groupBy("s", F.col(col).alias("_peer")).agg(F.count("*").alias("_n"))
        if name == "addr":
            peers = peers.where("_peer <> ''")
        pair = t.select("s", col).distinct().join(peers, "s").withColumn("_x", S.token_set_udf(F.col(col), F.col("_peer")))
        if name == "addr":
            pair = pair.where(F.col(col) != "")
        own = F.col(col) == F.col("_peer")
        by = pair.groupBy("s", col).agg(F.sum("_n").alias("_all"), F.sum(F.col("_n") * F.col("_x")).alias("_sum"), F.min(F.when(~own, F.col("_x"))).alias("_others"), F.max(F.when(own, F.col("_n"))).alias("_same"), F.max(F.when(own, F.col("_x"))).alias("_self"))
        out = out.join(by, ["s", col], "left")
        n = F.coalesce("_all", F.lit(0)) - F.col("_own") * F.coalesce("_same", F.lit(0)).cast("boolean").cast("long")
        out = out.withColumn("_left", n)
        mean = (F.col("_sum") - F.when((F.col("_own") == 1) & F.col("_same").isNotNull(), F.col("_self")).otherwise(0.0)) / F.col("_left")
        least_ = F.least("_others", F.when(F.coalesce("_same", F.lit(0)) > F.col("_own"), F.col("_self")))
        out = out.withColumn(f"cons_{name}_mean", F.when(F.col("_left") > 0, mean)).withColumn(f"cons_{name}_min", F.when(F.col("_left") > 0, least_)).drop("_all", "_sum", "_others", "_same", "_self", "_left")
    return out.drop("nm", "ad", "_own")


def stage3(t: DataFrame, extra: bool = False) -> DataFrame:
    """t (q, s, p1, p2, ce): n_cc, ce_rank, margins of ce and p2; with `extra` rows the margin is to the best other and p1 has a rank."""
    w = Window.partitionBy("q")
    t = t.withColumn("n_cc", F.count("*").over(w)).withColumn("ce_rank", F.row_number().over(w.orderBy(F.desc("ce"), "s")))
    for c in ("ce", "p2"):
        if extra:
            k = F.row_number().over(w.orderBy(F.col(c).desc_nulls_last(), "s"))
            t = t.withColumn("_k", k).withColumn("_1", F.max(c).over(w)).withColumn("_2", F.max(F.when(F.col("_k") == 2, F.col(c))).over(w)).withColumn("_n", F.count(c).over(w))
            other = F.when(F.col("_n") > 1, F.when(F.col(c) == F.col("_1"), F.col("_2")).otherwise(F.col("_1")))
        else:
            t = t.withColumn("_n", F.count("*").over(w)).withColumn("_1", F.sum(c).over(w))
            other = F.when(F.col("_n") > 1, F.col("_1") - F.col(c))
        t = t.withColumn(f"{c}_margin", F.col(c) - other).drop("_k", "_1", "_2", "_n")
    return t.withColumn("p1_rank", F.row_number().over(w.orderBy(F.desc("p1"), "s"))) if extra else t


def stacker(t: DataFrame, records: DataFrame, entities: DataFrame) -> DataFrame:
    """t (q, s, a, b, pg, op2, gp2): blended scores, flags of what is present or changed, ranks and margins on both sides, numbers, names.

    po blends a and b (0.3, 0.7) over what is present, p blends po and pg (0.6, 0.4).
    """
    present = lambda c: F.col(c).isNotNull().cast("int")
    po = (0.3 * F.coalesce("a", F.lit(0.0)) + 0.7 * F.coalesce("b", F.lit(0.0))) / (0.3 * present("a") + 0.7 * present("b"))
    t = t.withColumn("po", F.when(F.col("a").isNotNull() | F.col("b").isNotNull(), po))
    t = t.withColumn("p", F.when(F.col("pg").isNull(), F.col("po")).when(F.col("po").isNull(), F.col("pg")).otherwise(0.4 * F.col("pg") + 0.6 * F.col("po")))
    moved = lambda x, y: (F.abs(F.col(x) - F.col(y)) > 1e-5).cast("int")
    t = t.withColumns({"has_o": present("po"), "has_g": present("pg"), "t_o": moved("b", "op2"), "t_g": moved("pg", "gp2"), "d_og": F.col("po") - F.col("pg"), "d_ab": F.col("a") - F.col("b")})
    for key, tie in (("q", "s"), ("s", "q")):
        w = Window.partitionBy(key)
        t = t.withColumn(f"rank_{key}", F.row_number().over(w.orderBy(F.desc("p"), tie))).withColumn("_n", F.count("*").over(w))
        t = t.withColumn("_1", F.max("p").over(w)).withColumn("_2", F.max(F.when(F.col(f"rank_{key}") == 2, F.col("p"))).over(w))
        # alone in its record a row has a margin of p, alone with its entity of 0
        lone = F.lit(0.0) if key == "q" else F.col("p")
        t = t.withColumn(f"margin_{key}", F.col("p") - F.when(F.col(f"rank_{key}") == 1, F.when(F.col("_n") > 1, F.col("_2")).otherwise(lone)).otherwise(F.col("_1")))
        t = (t.withColumn("nq", F.col("_n")) if key == "q" else t).drop("_n", "_1", "_2")
    e = entities.select("s", F.col("nm").alias("_sn"), F.col("n1").cast("double").alias("_sh"), (F.coalesce("ad", F.lit("")) == "").cast("int").alias("s_noaddr"))
    r = records.select("q", F.col("nm").alias("_qn"), F.col("n1").cast("double").alias("_qh"), (F.coalesce("ad", F.lit("")) == "").cast("int").alias("q_noaddr"))
    t = t.join(e, "s").join(r, "q", "left")
    return t.withColumn("hn_d", F.col("_qh") - F.col("_sh")).withColumn("hn_abs", F.abs("hn_d")).withColumn("name_eq", (F.col("_qn") == F.col("_sn")).cast("int")).drop("_sn", "_sh", "_qn", "_qh")


def pair_cosine(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Cosine of given pairs from weighted postings (id, term, w): only the pairs' own terms are joined; no shared term is 0."""
    a = pairs.select("q", "s").join(left.select(F.col("id").alias("q"), "term", F.col("w").alias("wq")), "q")
    b = right.select(F.col("id").alias("s"), "term", F.col("w").alias("ws"))
    dot = a.join(b, ["s", "term"]).groupBy("q", "s").agg(F.sum(F.col("wq") * F.col("ws")).alias("cos"))
    return pairs.select("q", "s").join(dot, ["q", "s"], "left").na.fill(0.0, ["cos"])


def mean_of(tables: list[DataFrame], col: str = "p") -> DataFrame:
    """Mean of a score over the members of a family, each of which has every pair."""
    rows = reduce(DataFrame.unionByName, [t.select("q", "s", col) for t in tables])
    return rows.groupBy("q", "s").agg(F.avg(col).alias(col))
