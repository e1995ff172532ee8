"""The search in blocks against brute force, whatever the blocks' size and the way frequencies travel."""

import math
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import search, sparse
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


def grams(text, kind):
    w = text.split()
    if kind == "char_grams":
        t = f" {' '.join(w)} "
        return [t[i : i + 3] for i in range(len(t) - 2)]
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])] * (kind == "word_grams")


def brute(rows, kind, k, least, most):
    tf = {(c, i, s): Counter(grams(t or "", kind)) for c, i, t, s in rows}
    n, df = Counter(c for c, _, s in tf if s), Counter((c, t) for (c, _, s), x in tf.items() if s for t in x)
    idf = {x: round(math.log((1 + n[x[0]]) / (1 + m)) + 1, 9) for x, m in df.items() if least <= m <= most}
    w = {}
    for (c, i, s), x in tf.items():
        v = {t: (1 + math.log(m)) * idf[c, t] for t, m in x.items() if (c, t) in idf}
        norm = math.sqrt(sum(a * a for a in v.values()))
        w[c, i, s] = {t: round(a / norm, 9) for t, a in v.items()}
    out = {}
    for (c, q, s), x in w.items():
        if not s:
            score = {e: round(sum(a * y[t] for t, a in x.items() if t in y), 6) for (d, e, is_s), y in w.items() if is_s and d == c}
            best = sorted((e for e in score if score[e] >= 0.01), key=lambda e: (-score[e], e))[:k]
            out |= {(q, e): (score[e], r + 1) for r, e in enumerate(best)}
    return out


def made():
    r = random.Random(7)
    word = [a + b for a in ("de", "en", "es", "stra", "ñu", "日本", "o", "supercalifragilistic") for b in ("", "s", "en", "𝒳")]
    rows = [(r.choice(["de", "en"]), i, r.choice([" ", "\n\t "]).join(r.choices(word, k=r.randint(1, 12))), i % 4 == 0) for i in range(160)]
    return [*rows, ("en", 1000, None, False), ("en", 1004, "", True), (None, 1001, "de en", False), ("fr", 1005, "de en", False)]


def same(got, want):
    got = {(r.q, r.s): (r.score, r["rank"]) for r in got.collect()}
    assert got.keys() == want.keys()
    assert all(got[x][0] == pytest.approx(want[x][0], abs=2e-6) for x in want)
    assert sum(got[x][1] != want[x][1] for x in want) <= len(want) // 100  # sums in another order may round apart


@pytest.mark.parametrize("kind", ["words", "word_grams", "char_grams"])
@pytest.mark.parametrize("small", [False, True])
def test_equals_all_pairs(spark, monkeypatch, kind, small):
    """Small: many slices and blocks, no dense part, sums in parts, a crowded bit table, frequencies by shuffle."""
    if small:
        for name, value in (("SLICE", 200), ("BLOCK", 60), ("DENSE", 0), ("CHUNK", 5), ("BITS", 64), ("TERMS", 0)):
            monkeypatch.setattr(sparse, name, value)
    rows = made()
    docs = spark.createDataFrame(rows, "country string, id long, name string, is_s boolean").repartition(3)
    same(search.topk(docs, kind, 5, 2, 12), brute([x for x in rows if x[0]], kind, 5, 2, 12))


def test_nothing_to_find(spark):
    docs = spark.createDataFrame([("en", 1, "a", False), ("en", 4, None, True)], "country string, id long, name string, is_s boolean")
    assert search.topk(docs, "words", 5, 1, 9).collect() == []
    assert search.topk(docs.where("false"), "words", 5, 1, 9).collect() == []


def test_rows_of_one_id_are_one_document(spark):
    rows = [("en", 1, "a b", False), ("en", 1, "c", False), ("en", 4, "a", True), ("en", 4, "b", True), ("en", 8, "c d", True)]
    got = search.topk(spark.createDataFrame(rows, "country string, id long, name string, is_s boolean"), "words", 5, 1, 9).collect()
    assert [(r.s, r["rank"]) for r in got] == [(4, 1), (8, 2)]


def no_pairs_by_term(df):
    """Nothing is joined on terms, so no table of scored pairs goes through a shuffle."""
    return "term#" not in df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["entity_linkage", "page_name", "blocking_union", "topk_segk", "topk_bm25", "topk_name", "recall_at_k", "topk_comb"])
def test_no_scored_pairs_are_shuffled(spark, name):
    assert no_pairs_by_term(catalog.QUERIES[name](spark, SF))


def test_bm25_in_blocks_equals_the_join_on_terms(spark, monkeypatch):
    monkeypatch.setattr(sparse, "BLOCK", 60)
    docs = spark.createDataFrame([x for x in made() if x[0] and x[1] != 1000], "country string, id long, name string, is_s boolean")
    ent, rec = (docs.where(x).drop("is_s") for x in ("is_s", "NOT is_s"))
    w = search.bm25(search.counts(ent, search.words(F.col("name"))), ent, max_df=12)
    want = search.topk_join(search.counts(rec, search.words(F.col("name"))).withColumn("w", F.lit(1.0)), w, 5)
    same(search.topk_bm25(rec, ent, 5, 12), {(r.q, r.s): (r.score, r["rank"]) for r in want.collect()})


def test_page_name_finds_by_grams_of_many_entities_and_of_one(spark, tmp_path):
    """All grams of the first records are in more entities than MAX_DF_NAME, the second's in one."""
    names = {4 * k: "same" for k in range(search.MAX_DF_NAME + 8)} | {40_000: "sameother", 40_004: "quick", 1: "same", 2: "quick", 3: "Other, same", 5: ""}
    rows = [(i, "http://a.example/b", f'<html lang="en"><title>{t}</title>') for i, t in names.items()]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = catalog.QUERIES["page_name"](spark, str(tmp_path))
    got = {(r.q, r.s): (r.score, r["rank"]) for r in found.collect()}
    assert got == {(q, s): got[q, s] for q, s in [*((q, 4 * k) for q in (1, 3) for k in range(10 if q == 1 else 9)), (2, 40_004), (3, 40_000)]}
    assert [got[1, 4 * k][1] for k in range(10)] == [*range(1, 11)] and got[2, 40_004] == (1.0, 1) and got[3, 40_000][1] == 1
    same(found, brute([("en", i, t.replace(", ", "").lower(), i % 4 == 0) for i, t in names.items()], "char_grams", 10, 1, len(names)))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert {(q, s): (x, r) for q, s, x, r in con.sql(catalog.ORACLE_SQL["page_name"]).select("q, s, score, rank").fetchall()} == got
