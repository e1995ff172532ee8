"""Search: tokenisers, TF-IDF and BM25 postings, capped top-k joins, exact block keys.

Postings are long tables (country, id, term, weight). A term in more than `max_df` entities is dropped before the join,
which bounds the join's rows per query term; the caps are the reference's (`sparse.ALL_DF`: none). Texts are tokenised once: term counts of
entities and records are one stored table, from which document frequencies, norms and both sides of the join are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import tables
from . import sparse

#: The reference's caps on the document frequency of character grams and of words, its least document frequency, and its cap on a block.
MAX_DF_NAME, MAX_DF_WORD, MIN_DF, MAX_BLOCK = 4000, 5000, 2, 50


def _runs(items: Column, n: int, between: str) -> Column:
    """All runs of n neighbours joined to one text: the array is laid beside itself n times, in time linear in its length."""
    out = items
    for k in range(1, n):
        out = F.zip_with(out, F.slice(items, k + 1, F.greatest(F.size(items) - k, F.lit(0))), lambda a, b: F.concat(a, F.lit(between), b))
    return F.filter(out, lambda t: t.isNotNull())


def char_grams(col: Column, n: int = 3) -> Column:
    """Character n-grams of the text padded by a blank on either side."""
    return _runs(F.filter(F.split(F.concat(F.lit(" "), col, F.lit(" ")), ""), lambda c: c != ""), n, "")


def words(col: Column) -> Column:
    return F.filter(F.split(F.trim(col), r"\s+"), lambda t: t != "")


def word_grams(col: Column) -> Column:
    """Words and pairs of neighbouring words."""
    w = words(col)
    return F.concat(w, _runs(w, 2, " "))


def initials(col: Column) -> Column:
    return F.array_join(F.transform(words(col), lambda t: F.substring(t, 1, 1)), "")


def counts(docs: DataFrame, terms: Column) -> DataFrame:
    return docs.select("country", "id", F.explode(terms).alias("term")).groupBy("country", "id", "term").agg(F.count("*").alias("tf"))


def idf_table(entity_counts: DataFrame, sizes: DataFrame, min_df: int, max_df: int) -> DataFrame:
    """Smooth inverse document frequency over entities: ln((1+n)/(1+df))+1; sizes (country, n) has a row for each country."""
    df = entity_counts.groupBy("country", "term").agg(F.count("*").alias("df")).where(F.col("df").between(min_df, max_df))
    return df.join(sizes, "country").select("country", "term", "df", F.round(F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1, 9).alias("idf"))


def stored_counts(docs: DataFrame, grams) -> DataFrame:
    """docs (country, id, name, is_s) -> (country, id, is_s, term, tf), written once; a row with a null term stands for each document."""
    terms = F.concat(F.array(F.lit(None).cast("string")), F.coalesce(grams(F.col("name")), F.array().cast("array<string>")))
    path = tables.scratch(docs.sparkSession)
    docs.select("country", "id", "is_s", F.explode(terms).alias("term")).groupBy("country", "id", "is_s", "term").agg(F.count("*").alias("tf")).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def weighted(stored: DataFrame, min_df: int, max_df: int) -> tuple[DataFrame, DataFrame]:
    """TF-IDF postings of records and of entities over the entities' vocabulary."""
    sizes = stored.where("is_s AND term IS NULL").groupBy("country").agg(F.count("*").alias("n"))
    t = stored.where("term IS NOT NULL")
    idf = idf_table(t.where("is_s"), sizes, min_df, max_df)
    return tfidf(t.where("NOT is_s"), idf), tfidf(t.where("is_s"), idf)


def tfidf(term_counts: DataFrame, idf: DataFrame) -> DataFrame:
    """Sublinear tf times idf, rows scaled to length one; terms without idf drop out."""
    t = term_counts.join(idf, ["country", "term"]).withColumn("w", (1 + F.log("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("country", "id")))
    return t.select("country", "id", "term", F.round(F.col("w") / norm, 9).alias("w"))


def text_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each distinct (country, name), its id the least of its members' ids; and the members (country, class, id)."""
    key = ["country", F.sha2("name", 256).alias("key")]
    same = docs.where("name IS NOT NULL").groupBy(*key).agg(F.min("id").alias("class"), F.collect_list("id").alias("ids"), F.first("name").alias("name"))
    return same.select("country", F.col("class").alias("id"), "name"), same.select("country", "class", F.explode("ids").alias("id"))


def topk_of_members(found: DataFrame, queries: DataFrame, entities: DataFrame, k: int) -> DataFrame:
    """The k best entities of each query from the k best classes of its class; members of a class share its score.

    k classes are enough: each has a member that goes before all members of later classes. Of a class, k members are.
    """
    least = entities.withColumn("_m", F.row_number().over(Window.partitionBy("class").orderBy("id"))).where(F.col("_m") <= k)
    s = found.select("q", F.col("s").alias("class"), "score").join(least.select("class", F.col("id").alias("s")), "class")
    best = s.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "s"))).where(F.col("rank") <= k)
    return best.select(F.col("q").alias("class"), "s", "score", "rank").join(queries.select("class", F.col("id").alias("q")), "class").select("q", "s", "score", "rank")


def bm25(term_counts: DataFrame, entities: DataFrame, k1: float = 1.2, b: float = 0.75, max_df: int = MAX_DF_WORD) -> DataFrame:
    """BM25 weights of entity postings, for binary queries."""
    length = term_counts.groupBy("country", "id").agg(F.sum("tf").alias("len"))
    mean = length.groupBy("country").agg(F.avg("len").alias("mean"), F.count("*").alias("n"))
    df = term_counts.groupBy("country", "term").agg(F.count("*").alias("df")).where(F.col("df") <= max_df)
    t = term_counts.join(df, ["country", "term"]).join(length, ["country", "id"]).join(mean, "country")
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return t.select("country", "id", "term", F.round(w, 9).alias("w"))


def topk_join(queries: DataFrame, entities: DataFrame, k: int | Column, least: float = 0.01) -> DataFrame:
    """The k entities of greatest summed product for each query; ties go to the smaller entity id."""
    q = queries.select("country", F.col("id").alias("q"), "term", F.col("w").alias("wq"), *([c for c in ("k",) if c in queries.columns]))
    s = entities.select("country", F.col("id").alias("s"), "term", F.col("w").alias("ws"))
    score = q.join(s, ["country", "term"]).groupBy("q", "s").agg(F.round(F.sum(F.col("wq") * F.col("ws")), 6).alias("score")).where(F.col("score") >= least)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "s")
    return score.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def topk(docs: DataFrame, kind: str, k: int, min_df: int, max_df: int) -> DataFrame:
    """docs (country, id, name, is_s) -> q, s, score, rank by TF-IDF cosine, in blocks.

    White space of any length is one blank. Rows of one id are one document, even in several countries; where an id repeats,
    postings are joined as a table instead.
    """
    if docs.where("country IS NOT NULL").groupBy("id", "is_s").count().where("count > 1 AND id IS NOT NULL").isEmpty():
        return sparse.top_k(docs, kind, k, min_df, max_df)
    grams = {"words": words, "word_grams": word_grams, "char_grams": char_grams}[kind]
    flat = docs.withColumn("name", F.trim(F.regexp_replace("name", r"\s+", " ")))
    return topk_join(*weighted(stored_counts(flat, grams), min_df, max_df), k).select("q", "s", "score", "rank")


def topk_bm25(records: DataFrame, entities: DataFrame, k: int, max_df: int = MAX_DF_WORD) -> DataFrame:
    """records, entities (country, id, name) -> q, s, score, rank by the words' BM25 weights, in blocks; repeated ids as for topk."""
    docs = entities.withColumn("is_s", F.lit(True)).unionByName(records.withColumn("is_s", F.lit(False)))
    if docs.where("country IS NOT NULL").groupBy("id", "is_s").count().where("count > 1").isEmpty():
        return sparse.top_k(docs, "words", k, 1, max_df, sparse.bm25)
    e, q = bm25(counts(entities, words(F.col("name"))), entities, max_df=max_df), counts(records, words(F.col("name"))).withColumn("w", F.lit(1.0))
    return topk_join(q, e, k).select("q", "s", "score", "rank")


def union_provenance(parts: dict[str, DataFrame]) -> DataFrame:
    """Pairs of several searches with a flag for each search that found them: one aggregation."""
    from functools import reduce

    rows = reduce(DataFrame.unionByName, [t.select("q", "s", F.lit(n).alias("src")) for n, t in parts.items()])
    return rows.groupBy("q", "s").agg(*(F.max((F.col("src") == n).cast("int")).alias(f"from_{n}") for n in parts))


def capped_block(left: DataFrame, right: DataFrame, key: list[str], most: int) -> DataFrame:
    """Equi-join on a block key, only for blocks of at most `most` rows on the right."""
    w = Window.partitionBy(*key)
    small = right.withColumn("_n", F.count("*").over(w)).where(F.col("_n") <= most).drop("_n")
    return left.join(small, key)


def recall_at_k(found: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    t = truth.join(found.select("q", "s", "rank"), ["q", "s"], "left")
    return t.agg(*(F.round(F.avg((F.coalesce("rank", F.lit(1 << 30)) <= k).cast("double")), 6).alias(f"recall_{k}") for k in ks), F.count("*").alias("n"))
