"""Each operator against brute force on a small table with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, bpe, embedding_dedup, lm_score, ngram_join, packing, secrets, suffix_dedup, toxicity, url_filter

RNG = np.random.default_rng(3)
WORDS = ["".join(RNG.choice(list("abcdeéüño"), 1 + int(RNG.integers(7)))) for _ in range(300)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


BASE = prose(80, 1)
PASSAGE = prose(60, 2)
TEXTS = [
    BASE, BASE, BASE.replace(" ", "  ", 1), BASE + " tail", prose(30, 3) + " " + PASSAGE + " " + prose(20, 4), prose(9, 5) + "\n" + PASSAGE, None, "", "  \n", "one", "one two",
    "One TWO", "x " * 3000, "a" * 900, "password=abc12345 and AKIA" + "Z" * 16 + " " + "0af" * 9, 'Token : "abc" secret="q1w2e3r4t5"', "don't <|endoftext|> 日本語  ok\r\n é", prose(4000, 6), prose(40, 7), prose(40, 7) + ".",
]
DOCS = [(i, t, ["en", "de", None][i % 3], i) for i, t in enumerate(TEXTS)] + [(None, "null id", "en", 0), (3, TEXTS[3], "de", 3)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, lang string, score long").repartition(3, "text").cache()


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_bpe_equals_the_library_and_round_trips(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_tokenizer())
    got = Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.bpe_digests(docs).collect())
    want = Counter()
    for i, t, *_ in DOCS:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    assert got == want
    back = {(r.doc_id, r.text) for r in bpe.bpe_decode(bpe.bpe_encode(docs)).collect()}
    assert back == {(i, t or "") for i, t, *_ in DOCS}


def test_packing_covers_every_id_once(docs):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bpe.default_tokenizer())
    rows = packing.packed(docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])).collect()
    for i, t, *_ in DOCS[: len(TEXTS)]:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length, r.window))
    for pieces in by.values():
        end = 0
        for offset, length, window in sorted(pieces):
            assert offset == end
            end += length
        assert end <= window <= 2048


@pytest.mark.parametrize("k,num,den", [(3, 9, 10), (5, 4, 5)])
def test_jaccard_components(docs, k, num, den):
    sets = [(i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w := tokens(t)) >= k else frozenset([tuple(w)] if w else [])) for i, t, *_ in DOCS]
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                up[root(a)] = root(b)
    least = {r: min((sets[m][0] for m in range(len(sets)) if root(m) == r and sets[m][0] is not None), default=None) for r in map(root, range(len(sets)))}
    want = Counter((i, len(s), least[root(n)] if s else i) for n, (i, s) in enumerate(sets))
    assert Counter(map(tuple, ngram_join.jaccard_components(docs, k, num, den).collect())) == want


def test_suffix_dedup(docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/d")
    files = docs.sparkSession.read.parquet(f"{tmp_path}/d")
    n = suffix_dedup.LENGTH
    seen = Counter()
    for _, t, *_ in DOCS:
        b = (t or "").encode()
        seen.update(b[j : j + n] for j in range(len(b) - n + 1))
    want = Counter()
    for i, t, *_ in DOCS:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - n + 1):
            if seen[b[j : j + n]] > 1:
                gone[j : j + n] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want[i, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()] += 1
    got = suffix_dedup.suffix_dedup(files)
    assert "score" in got.columns
    assert Counter(map(tuple, got.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == want


def test_secret_base_spans_and_redaction(docs):
    field = secrets.train(docs)
    rows = {r.doc_id: r for r in secrets.secret_spans(docs, field).collect()}
    assert (rows[14].n_assign, rows[14].n_access, rows[14].n_hex) == (1, 1, 1)
    assert rows[14].spans.startswith("assign:0:17,access:22:42,hex:43:70")
    assert rows[15].n_assign == 1 and rows[6].n_assign == 0
    text = {r.doc_id: r.text for r in secrets.redacted(docs, field).collect()}
    assert "abc12345" not in text[14] and text[0] == BASE and text[6] is None


def test_lm_base_is_exact_and_score_is_a_probability(docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/d")
    got = lm_score.lm_scores(docs.sparkSession.read.parquet(f"{tmp_path}/d")).collect()
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    c = Counter()
    for i, t, *_ in DOCS:
        if not held(i):
            c.update([*tokens(t), None])
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t, *_ in DOCS:
        w = [*tokens(t), None]
        want[i, held(i), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and r.bits_per_byte > 0 for r in got)


def test_toxicity_learns_and_handles_no_labels(spark):
    rows = [(i, prose(30, i) + (" you idiot scum" if i % 4 == 0 else "")) for i in range(400)] + [(None, None), (1000, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("mine"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)] + [(7, None), (8, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.toxicity(docs, toxicity.fit(docs, labels)).collect()}
    assert sum(got[i].predicted == (i % 4 == 0) for i in range(400)) >= 395 and got[1000].predicted == 0
    empty = toxicity.fit(docs, labels.where("false"))
    assert all(r.score == 0 for r in toxicity.toxicity(docs, empty).collect())


def test_url_rules_and_reputation(spark):
    pages = spark.createDataFrame([(1, "http://a.Example.org/es/x?q"), (2, "https://b.com/de/1#t"), (3, None), (4, "no"), (5, "http://bad.net/x"), (6, "ftp://x.org"), (7, "http://example.org/en/12")] + [(k, "http://bad.net/y") for k in range(10, 60)], "page_id long, url string")
    bad = spark.createDataFrame([(k, 1) for k in range(10, 60)] + [(5, 1), (5, 0), (1, 0)], "page_id long, bad int")
    got = {r.page_id: r for r in url_filter.judged(pages, bad).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (got[2].rule, got[2].verdict) == ("com/de/", "block") and got[7].rule == "example.org/en/1"
    assert (got[3].host, got[3].path, got[3].rule) == ("", "", None) and got[4].host == ""
    assert got[5].verdict == "block" and got[6].rule is None


@pytest.fixture(scope="module")
def vectors(spark):
    x = RNG.normal(size=(300, 16))
    x[20:40] = x[0] + 0.05 * RNG.normal(size=(20, 16))
    x[50] = x[51]
    rows = [(i, [float(v) for v in r], "e") for i, r in enumerate(x)] + [(400, None, "e"), (401, [0.0] * 16, "e"), (402, [float("nan")] * 16, "e"), (403, [None] + [1.0] * 15, "e"), (None, [1.0] * 16, "e")]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string"), x


def test_nearest(vectors):
    df, x = vectors
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit, rows = 0, ann.nearest(df, F.col("vec_id") % 50 == 0).collect()
    for q in range(0, 300, 50):
        s = u[q] @ u.T
        s[q] = -2
        hit += len({r.vec_id for r in rows if r.query_id == q} & set(np.argsort(-s)[:5].tolist()))
    assert {r.query_id for r in rows} == set(range(0, 300, 50)) and hit >= 27
    assert all(abs(r.score - float(u[r.query_id] @ u[r.vec_id])) < 1e-12 for r in rows)


def test_embedding_dedup(vectors):
    df, x = vectors
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= 0.9) & ~np.eye(300, dtype=bool)
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df).collect()}
    assert [got[i].n_links for i in range(300)] == link.sum(1).tolist()
    assert got[0].kept and got[25].component_id == 0 and not got[51].kept
    assert all(got[i].n_links == 0 and got[i].kept for i in (400, 401, 402, 403))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert bpe.bpe_digests(docs).count() == packing.packed(docs).count() == 0
    assert ngram_join.jaccard_components(docs).count() == suffix_dedup.suffix_dedup(docs).count() == 0
    assert lm_score.lm_scores(docs).count() == 0 and secrets.secret_spans(docs, secrets.train(docs)).count() == 0
    v = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert ann.nearest(v, F.lit(True)).count() == embedding_dedup.near_duplicates(v).count() == 0


def test_suffix_dedup_keeps_clashing_columns(spark, tmp_path):
    rows = [(k, "ab c" * 60 if k < 2 else f"text {k}", k, "r", "o") for k in range(4)]
    spark.createDataFrame(rows, "doc_id long, text string, rid long, runs string, open string").write.parquet(str(tmp_path / "d"))
    got = sorted(suffix_dedup.suffix_dedup(spark.read.parquet(str(tmp_path / "d"))).collect())
    assert [(r.doc_id, r.rid, r.runs, r.open) for r in got] == [(k, k, "r", "o") for k in range(4)]
    assert [r.n_removed for r in got] == [240, 240, 0, 0]
