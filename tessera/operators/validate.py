"""Checks of a matching table: one aggregate for each rule, all in one row for each rule."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def validate(lists: DataFrame, entities: DataFrame, records: DataFrame) -> DataFrame:
    """lists (s, matched), entities (s), records (q) -> rule, n: how often each rule is broken."""
    ids = lists.select("s", F.explode(F.split("matched", ",")).alias("q")).where("q <> ''").withColumn("q", F.col("q").cast("long"))
    rules = {
        "duplicate_entity": lists.groupBy("s").count().where("count > 1"),
        "missing_entity": entities.join(lists, "s", "left_anti"),
        "extra_entity": lists.join(entities, "s", "left_anti"),
        "duplicate_in_list": ids.groupBy("s", "q").count().where("count > 1"),
        "record_twice": ids.groupBy("q").agg(F.count_distinct("s").alias("n")).where("n > 1"),
        "unknown_record": ids.join(records, "q", "left_anti"),
    }
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(r).alias("rule"), "n") for r, t in rules.items()])


HEADER = ("source1_entity_id", "matched_entity_ids")


def validate_file(lines: DataFrame, entities: DataFrame, records: DataFrame, candidates: DataFrame, header=HEADER) -> DataFrame:
    """All rules over the raw lines (line number `at` from 0, `value`) of a submission -> rule, n.

    entities (id), records (id), candidates (s, q) hold id strings. The first line must be the header with a tab; every
    other line is `entity <tab> comma list`. A matched pair that is no candidate is a warning of its own rule.
    """
    body = lines.where("at > 0").select("at", F.split("value", "\t").alias("f"))
    rows = body.where("size(f) = 2").select("at", F.trim(F.get("f", F.lit(0))).alias("s"), F.get("f", F.lit(1)).alias("ids"))
    ids = rows.select("s", "at", F.explode(F.filter(F.transform(F.split("ids", ","), lambda x: F.trim(x)), lambda x: x != "")).alias("q"))
    head = lines.where("at = 0")
    tab = F.col("value").contains("\t")
    rules = {
        "comma_header": head.where(~tab & F.col("value").contains(",")),
        "wrong_header": head.where(tab & (F.col("value") != "\t".join(header))),
        "malformed_row": body.where("size(f) <> 2"),
        "duplicate_entity": rows.groupBy("s").count().where("count > 1"),
        "missing_entity": entities.select(F.col("id").alias("s")).join(rows, "s", "left_anti"),
        "extra_entity": rows.join(entities.select(F.col("id").alias("s")), "s", "left_anti"),
        "duplicate_in_list": ids.groupBy("s", "at", "q").count().where("count > 1"),
        "self_match": ids.where(F.col("q").startswith("S1-")),
        "bad_prefix": ids.where(~F.col("q").rlike("^S[123]-")),
        "unknown_record": ids.where(F.col("q").rlike("^S[23]-")).join(records.select(F.col("id").alias("q")), "q", "left_anti"),
        "record_twice": ids.groupBy("q").agg(F.count_distinct("s").alias("n")).where("n > 1"),
        "not_a_candidate": ids.where(F.col("q").rlike("^S[23]-")).select("s", "q").distinct().join(candidates, ["s", "q"], "left_anti"),
    }
    return reduce(DataFrame.unionByName, [t.agg(F.count("*").alias("n")).select(F.lit(r).alias("rule"), "n") for r, t in rules.items()])


def quick(lists: DataFrame, entities: DataFrame) -> DataFrame:
    """The five counts of a fast check, in one row."""
    n = F.size(F.filter(F.split("matched", ","), lambda x: x != ""))
    rows = lists.select("s", n.alias("n")).agg(F.count("*").alias("rows"), F.count_distinct("s").alias("entities"), F.sum("n").alias("pairs"), F.count_if(F.col("n") == 0).alias("empty"))
    known = lists.join(entities, "s", "left_semi").agg(F.count("*").alias("known"))
    return rows.join(F.broadcast(known))  # one row each


def drift(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two score tables: pairs only in one, and the greatest difference in common ones."""
    t = a.select("q", "s", F.col("p").alias("pa")).join(b.select("q", "s", F.col("p").alias("pb")), ["q", "s"], "full")
    return t.agg(
        F.sum(F.col("pb").isNull().cast("int")).alias("only_a"), F.sum(F.col("pa").isNull().cast("int")).alias("only_b"),
        F.round(F.max(F.abs(F.col("pa") - F.col("pb"))), 6).alias("max_diff"),
    )
