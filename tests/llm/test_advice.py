"""Cases of the first review: each failed before its change."""

import numpy as np
import pyarrow as pa

from tessera.llm import lm_score, ngram_join, secrets


def test_lm_learns_every_bit_of_one_chunk():
    words = pa.array([f"word{k}" for k in range(50)], pa.large_string())
    z = np.zeros(50, np.int64)
    tables = {k: np.zeros(2 << b, np.float32) for k, b in enumerate(lm_score.BITS)}
    lm_score.count_bits(lm_score.Coded(words, z), np.ones(50), range(len(lm_score.BITS)), tables)
    model = lm_score.Model(tables)
    apm = np.zeros(lm_score.GATES * 8 * lm_score.APM_STEPS * 2)
    coded = lm_score.Coded(words, z)
    model.learn(coded, np.ones(50), apm, {})
    mass = apm.reshape(lm_score.GATES, 8, -1).sum((0, 2))
    assert mass.tolist() == [len(coded.b)] * 8


def test_near_copies_link_through_a_null_id(spark):
    w = [f"w{k}" for k in range(120)]
    a, b, c = (" ".join(w[x : x + 100]) for x in (0, 8, 16))  # neighbours 0.85, ends 0.72
    lone = [" ".join(f"v{k}" for k in range(x, x + 100)) for x in (0, 5)]
    rows = [(9, a), (None, b), (5, c), (None, b), (7, lone[0]), (None, lone[1]), (None, "none at all"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").cache()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, 1, 4, 5).collect()), key=str)
    assert got == sorted([(9, 100, 5), (None, 100, 5), (5, 100, 5), (None, 100, 5), (7, 100, 7), (None, 100, 7), (None, 3, None), (None, 0, None)], key=str)


def test_field_spans_extend_base_spans(spark):
    field = secrets.Field()
    field.w[0, (5 * 997 + 31) % secrets.DIM, 1] = 50  # begins at words with a key
    text = "é secret=q1w2e3!r4t5 rest"
    docs = spark.createDataFrame([(1, text), (2, "a secrets b"), (3, 'x "secret=abcdef1"')], "doc_id long, text string")
    got = {r.doc_id: r for r in secrets.secret_spans(docs, field).collect()}
    assert got[1].spans == "assign:2:15,crf:15:20" and got[1].n_assign == 1
    assert got[2].spans == "crf:2:9" and got[3].spans == "crf:2:3,assign:3:17,crf:17:18"
    new = {r.doc_id: r.text for r in secrets.redacted(docs, field).collect()}
    assert "r4t5" not in new[1] and new[1].startswith("é [SECRET]") and new[1].endswith(" rest")


def test_left_over_parts():
    text = "aa bb cc dd"
    assert secrets.left_over(0, 11, [(0, 2, "hex"), (3, 5, "hex"), (4, 8, "hex")], text) == [(9, 11)]
    assert secrets.left_over(3, 8, [(0, 4, "hex"), (9, 11, "hex")], text) == [(4, 8)]
