"""The BM25 search over whole texts against brute force."""

import math
from collections import Counter

import pytest

from tessera.plans import registry

HEAD = " ".join(f"head{k}" for k in range(20))


def run(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{path}/documents.parquet")
    return registry.topk_bm25(spark, str(path)).collect()


def brute(rows, k=10):
    base = {i: (lang, tuple(t.lower().split())) for i, t, lang in rows if t is not None}
    out = {}
    for country in {c for c, _ in base.values()}:
        ent = {i: w for i, (c, w) in base.items() if c == country and i % 4 == 0}
        texts = set(ent.values())
        df = Counter(t for w in texts for t in set(w))
        mean = sum(map(len, texts)) / max(1, len(texts))
        for q, (c, w) in base.items():
            if c != country or q % 4 == 0:
                continue
            score = {}
            for s, v in ent.items():
                tf = Counter(v)
                x = sum(round(math.log1p((len(texts) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.2 / (tf[t] + 1.2 * (0.25 + 0.75 * len(v) / mean)), 9) * n for t, n in Counter({t: 1 for t in w}).items() if t in tf)
                if round(x, 6) >= 0.01:
                    score[s] = x
            for r, s in enumerate(sorted(score, key=lambda s: (-round(score[s], 6), s))[:k]):
                out[q, s] = (round(score[s], 6), r + 1)
    return out


def test_words_past_a_shared_header_decide(spark, tmp_path):
    tails = ["red apple", "blue sky red", "green sea sea", "old grey stone", "blue apple"]
    rows = [(4 * k, f"{HEAD} {t}", "en") for k, t in enumerate(tails)] + [(4 * k + 1, f"other words {k} {t}", "en") for k, t in enumerate(tails)]
    rows += [(101, f"{HEAD}\n\tSEA", "en"), (102, None, "en"), (103, "", "en"), (104, None, "en"), (105, "sea", "de")]
    got = {(r.q, r.s): (r.score, r["rank"]) for r in run(spark, tmp_path, rows)}
    want = brute(rows)
    assert got.keys() == want.keys() and all(got[x][1] == want[x][1] and got[x][0] == pytest.approx(want[x][0], abs=2e-6) for x in want)
    assert got[9, 8][1] == 1


def test_copies_keep_their_own_terms(spark, tmp_path):
    rows = [(4 * k, "the very same text", "en") for k in range(60)] + [(400 + 4 * k, f"another {k}", "en") for k in range(3)]
    rows += [(1, "same text", "en"), (2, "same text", "en")]
    got = {(r.q, r.s): (r.score, r["rank"]) for r in run(spark, tmp_path, rows)}
    assert got.keys() == {(q, 4 * k) for q in (1, 2) for k in range(10)} and got.keys() == brute(rows).keys()
    assert all(got[q, 4 * k][1] == k + 1 for q in (1, 2) for k in range(10))
