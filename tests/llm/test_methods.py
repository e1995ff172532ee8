"""Methods against plain loops and enumeration, and paths that small tables don't reach by themselves."""

import itertools
import math
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import ann, bpe, common, components, embedding_dedup, lm_score, ngram_join, packing, secrets, suffix_dedup, toxicity, url_filter
from tessera.llm.vectors import SEED

from .test_operators import prose, tokens


def test_lm_cells_equal_a_plain_loop_over_bits():
    words = ["the", "of", "red", "apple", "tree", "stone"]
    table = pa.table({"word": ["", *words], "c": [3, *range(12, 0, -2)]} | {k: [3, *range(12, 0, -2)] if k == "k1" else [0] * 7 for k in lm_score._CLASS_COLUMNS})
    lex = lm_score.Lexicon(table, 2)
    model = lm_score.Cells(12)
    rng = np.random.default_rng(1)
    lessons = [" ".join(rng.choice(words, 50)) for _ in range(20)]
    for text in lessons:
        model.learn(lm_score.Tokens(pa.array([text], pa.large_string()), lex, learning=True))
    frozen = lm_score.Cells(12, [c.copy() for c in model.counts], model.weights)
    texts = [" ".join(rng.choice([*words, "unseen"], 100)), "", "the red"]
    got = frozen.log10(lm_score.Tokens(pa.array(texts, pa.large_string()), lex))
    for text, value in zip(texts, got):
        t = lm_score.Tokens(pa.array([text], pa.large_string()), lex)
        own, total, at = np.zeros((lm_score.DEPTH, 5)), 0.0, 0
        bounds = [0, *(b for b in lm_score.BLOCKS.tolist() if b < len(t.cell)), len(t.cell)]
        for lo, hi in zip(bounds, bounds[1:]):
            step = np.zeros_like(own)
            for i in range(lo, hi):
                for j in range(lm_score.DEPTH):
                    bit = int(t.cell[i]) >> (lm_score.DEPTH - 1 - j) & 1
                    slots = [int(s[0]) for s in frozen.slots([c[i : i + 1] for c in t.contexts], t.cell[i : i + 1], j)]
                    n = [model.counts[k][2 * s : 2 * s + 2] for k, s in enumerate(slots)]
                    x = [math.log((float(b) + 0.4) / (float(a) + 0.4)) for a, b in n] + [1.0]
                    level = [sum(float(n[k].sum()) >= v for v in (1, 4, 16)) for k in (2, 3)]
                    w = frozen.weights[(level[0] * 4 + level[1]) * lm_score.DEPTH + j] + own[j]
                    s = max(-14.0, min(14.0, sum(a * b for a, b in zip(w, x))))
                    total -= math.log10(1 + math.exp(-s if bit else s))
                    step[j] += (bit - 1 / (1 + math.exp(-s))) * np.array(x)
            own = np.clip(own + lm_score.ADAPT * step / (hi + 50), -0.5, 0.5)
        assert value == pytest.approx(total, rel=1e-4)


def test_lm_cells_of_one_step_sum_to_one():
    lex = lm_score.Lexicon(pa.table({"word": ["", "a", "b"], "c": [1, 5, 5]} | {k: [1, 5, 5] if k == "k1" else [0] * 3 for k in lm_score._CLASS_COLUMNS}), 2)
    frozen = lm_score.Cells(10, lm_score.Cells(10).counts, None)
    t = lm_score.Tokens(pa.array(["a"], pa.large_string()), lex)
    total = 0.0
    for cell in range(lm_score.CELLS):
        p = 1.0
        for j in range(lm_score.DEPTH):
            x, gate = frozen.inputs([c[:1] for c in t.contexts], np.array([cell]), j)
            one = 1 / (1 + math.exp(-float(x[0] @ frozen.weights[gate[0]])))
            p *= one if cell >> (lm_score.DEPTH - 1 - j) & 1 else 1 - one
        total += p
    assert total == pytest.approx(1)


def test_lm_cells_learn_and_score_in_stripes_as_in_one(monkeypatch):
    rng = np.random.default_rng(3)
    words = ["the", "of", "red", "apple", "tree", "stone"]
    counts = {k: [3, *rng.integers(1, 20, 6).tolist()] for k in lm_score._CLASS_COLUMNS}
    lex = lm_score.Lexicon(pa.table({"word": ["", *words], "c": np.sum(list(counts.values()), 0)} | counts), 2)
    lessons = [" ".join(rng.choice([*words, "unseen"], 90)) for _ in range(6)]
    tokens, got = pa.array(lessons, pa.large_string()), []
    for stripe in (1 << 20, 7):
        monkeypatch.setattr(lm_score, "STRIPE", stripe)
        model = lm_score.Cells(12)
        for _ in range(4):
            model.learn(lm_score.Tokens(tokens, lex, learning=True))
        t = lm_score.Tokens(tokens, lex)
        got.append((model.weights, *model.counts, t.z, lm_score.Cells(12, [c.copy() for c in model.counts], model.weights).log10(t)))
    for a, b in zip(*got):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-9)
    # one step against plain sums over the tokens of a gate
    model, t = lm_score.Cells(12), lm_score.Tokens(tokens, lex, learning=True)
    model.learn(t)
    first, j = lm_score.Cells.first_weights(), 2
    x, bit = np.array([0, 0, 0, 0, 1.0]), (t.cell >> (lm_score.DEPTH - 1 - j)) & 1  # nothing is counted yet
    p = 1 / (1 + math.exp(-x @ first[j]))
    curve, slope = len(bit) * p * (1 - p) * np.outer(x, x), (bit - p).sum() * x
    ridge = np.eye(5) * (0.01 * np.trace(curve) / 5 + 1)
    assert np.allclose(model.weights[j], np.clip(first[j] + 0.5 / 1.25 * np.linalg.solve(curve + ridge, slope), -3, 3))


def test_packing_encodes_a_run_in_parts(monkeypatch):
    rng = np.random.default_rng(5)
    text = pa.array(["", *(" ".join(rng.choice(["the", "stone", "über", "42", "x" * 40], int(n))) for n in rng.integers(0, 60, 40)), "é" * 900], pa.large_string())
    monkeypatch.setattr(packing, "ENCODED_BYTES", 500)
    seen = []
    with bpe.encoder(bpe.default_tokenizer(), "merges") as enc:
        whole, offsets = enc.batch(text)
        batch = enc.batch
        monkeypatch.setattr(enc, "batch", lambda t: seen.append(t) or batch(t))
        ids, sizes = packing._closed(enc, text, 1)
    assert len(seen) > 5 and all(len(t) == 1 or sum(len(x.as_py().encode()) for x in t) <= 500 for t in seen)
    assert sizes.tolist() == (np.diff(offsets) + 1).tolist()
    assert ids.tolist() == [x for a, b in zip(offsets, offsets[1:]) for x in [*whole[a:b].tolist(), 1]]


def test_features_of_a_word_do_not_depend_on_its_neighbours():
    words = ["a1", "2b", "x", "", "7", "9z9"]
    alone = [secrets.word_features(pa.array([w], pa.large_string()))[0].tolist() for w in words if w]
    for order in (words, words[::-1]):
        got = dict(zip(order, secrets.word_features(pa.array(order, pa.large_string())).tolist()))
        assert [got[w] for w in words if w] == alone


def test_secrets_found_in_parts_as_in_one(monkeypatch):
    rng = np.random.default_rng(2)
    field = secrets.Field()
    field.w = rng.normal(0, 0.5, field.w.shape)
    text = pa.array([" ".join("".join(rng.choice(list("ab19Z="), 4)) for _ in range(30)) for _ in range(40)], pa.large_string())
    got = []
    for n in (1 << 20, 400):
        monkeypatch.setattr(secrets, "SCANNED", n)
        got.append(secrets.scan(text, field))
    assert got[0] == got[1]


def test_viterbi_and_gradient_against_enumeration():
    rng = np.random.default_rng(2)
    field = secrets.Field()
    field.move[:] = rng.normal(size=(3, 3))
    field.move[0, 2], field.start = -30.0, np.array([0.3, -0.2, -30.0])
    e = rng.normal(size=(5, 3)) * 2

    def value(path):
        return field.start[path[0]] + sum(e[i, t] for i, t in enumerate(path)) + sum(field.move[a, b] for a, b in zip(path, path[1:]))

    best = max(itertools.product(range(3), repeat=5), key=value)
    assert tuple(field.viterbi(e, True)) == best
    # chains are cut at stretches that stay outside: the tags are those of the whole path
    long = rng.normal(size=(40, 3)) - np.array([0, 6, 6]) * (rng.random((40, 1)) < 0.7)
    tags = np.zeros(40, int)
    for begin, part in field.tags(long, np.array([0])):
        tags[begin : begin + len(part)] = part
    assert tags.tolist() == field.viterbi(long, True)
    # one step of training moves the conditional likelihood up
    x, y, valid = rng.integers(0, 50, (6, 4, 3, 9)), np.tile([0, 1, 2, 0], (6, 1)), np.ones((6, 4), bool)

    def likelihood(f):
        out = 0.0
        for seq, gold in zip(x, y):
            s = sum(f.w[k][seq[:, k]].sum(1) for k in range(3)) + f.file[0]
            score = lambda p: f.start[p[0]] + sum(s[i, t] for i, t in enumerate(p)) + sum(f.move[a, b] for a, b in zip(p, p[1:]))  # noqa: B023, E731
            every = np.array([score(p) for p in itertools.product(range(3), repeat=4)])
            out += score(gold) - np.logaddexp.reduce(every)
        return out

    before = likelihood(secrets.Field())
    assert likelihood(secrets.Field().fit(x, np.zeros(6, int), y, valid, rounds=20)) > before + 1


def test_field_finds_keys_of_other_make(spark):
    docs = [(i, prose(60, i)) for i in range(300)] + [(1000 + i, f"{prose(20, i)} password=abc{i}def99 {prose(20, i)}") for i in range(40)]
    field = secrets.train(spark.createDataFrame(docs, "doc_id long, text string"))
    rng = np.random.default_rng(9)
    letters = list("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    keys = [f"{head}{''.join(rng.choice(letters, 36))}" for head in ("ghp_", "sk_live_", "AIza") for _ in range(20)]
    texts = [f"{prose(15, 500 + k)} {key} {prose(15, 600 + k)}" for k, key in enumerate(keys)]
    _, added = secrets.scan(pa.array(texts, pa.large_string()), field)
    hit = sum(any(t[a:b] == key for a, b, _ in spans) for t, key, spans in zip(texts, keys, added))
    assert hit >= 0.9 * len(keys) and sum(map(len, added)) <= hit + 3
    _, clean = secrets.scan(pa.array([prose(60, 2000 + k) for k in range(100)], pa.large_string()), field)
    assert sum(map(len, clean)) <= 2


@pytest.mark.parametrize("block", [2, 1024])
def test_join_in_blocks_and_stars(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(40):  # a chain of near copies, families that share a passage only, and pairs
        rng = np.random.default_rng(k)
        w = base[k : k + 80] if k < 20 else [*base[:40], *(f"x{k // 2}.{j}" for j in range(40))]
        rows.append((k, " ".join("y" if rng.random() < 0.01 else v for v in w)))
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 4, 5).collect()}
    sets = {i: {tuple(w[j : j + 3]) for j in range(len(w) - 2)} for i, t in rows for w in [tokens(t)]}
    want = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                want[a] = want[b] = min(want[a], want[b])
    assert got == want


def test_suffix_dedup_of_long_texts_in_slices(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(suffix_dedup, "SLICE", 700)
    rng = np.random.default_rng(4)
    letters = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared = letters(450)
    rows = [(1, letters(900) + shared + letters(1200)), (2, letters(30) + shared), (3, letters(5000)), (4, shared[:199]), (5, shared[100:300])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    got = {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(spark.read.parquet(f"{tmp_path}/d")).collect()}
    assert got == {1: 450, 2: 450, 3: 0, 4: 0, 5: 200}


def test_suffix_starts_of_a_slice_at_a_time_travel_together(monkeypatch):
    rng = np.random.default_rng(6)
    letters = np.array(list("abcdefgh "))
    batch = pa.RecordBatch.from_pydict({"rid": pa.array(range(7, 807)), "text": pa.array(["".join(rng.choice(letters, int(n))) for n in rng.integers(0, 6000, 800)])})

    def starts(out):
        runs = set()
        for b in out:
            for r in b.to_pylist():
                rid = np.frombuffer(r["rid"], np.int64)[np.frombuffer(r["c"], np.uint32)]
                columns = (np.frombuffer(r[k], t) for k, t in (("rank", np.uint64), ("around", np.uint64), ("i0", np.int64), ("runs", np.uint8)))
                runs |= set(zip([r["part"]] * len(rid), rid.tolist(), *(c.tolist() for c in columns)))
        return runs

    tracemalloc.start()
    out = list(suffix_dedup._emit(8)(iter([batch])))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, out)) <= 2 * 8 and most < 100e6  # two rows for each destination
    got = [starts(out)]
    for n in (8 << 20, 7000):
        monkeypatch.setattr(suffix_dedup, "SLICE", n)
        monkeypatch.setattr(suffix_dedup, "PACKED", 2 * n)
        got.append(starts(suffix_dedup._emit(8)(iter([batch]))))
    assert got[0] == got[1] == got[2] and len(got[0]) > 10000


def test_suffix_tasks_give_their_memory_back(monkeypatch):
    seen = []

    class Held:
        def __del__(self):
            seen.append("freed")

    def run(batches):
        held = Held()  # noqa: F841
        yield from batches

    monkeypatch.setattr(suffix_dedup, "settle", lambda: seen.append("settled"))
    assert list(suffix_dedup._settled(run)(iter([1, 2]))) == [1, 2] and seen == ["freed", "settled"]


def test_nearest_over_several_trees_with_repeated_ids(spark, monkeypatch):
    monkeypatch.setattr(ann, "TREE", 60)
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(40, 16)), 8, 0) + 0.05 * rng.normal(size=(320, 16))
    ids = [k if k != 17 else 0 for k in range(320)]  # the id 0 stands for two rows
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(2)
    df.write.mode("overwrite").parquet("/tmp/checkpoints/ann-test")
    rows = ann.nearest(spark.read.parquet("/tmp/checkpoints/ann-test"), F.col("vec_id") % 40 == 0).collect()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert sorted(r["rank"] for r in rows if r.query_id == 0) == sorted([*range(1, 6)] * 2)
    hit = 0
    for q in range(40, 320, 40):
        s = u[q] @ u.T
        s[q] = -2
        hit += len({r.vec_id for r in rows if r.query_id == q} & {ids[k] for k in np.argsort(-s)[:5]})
    assert hit >= 0.9 * 35
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, -1.0])], "vec_id long, embedding array<double>")
    assert [(r.vec_id, r["rank"]) for r in sorted(ann.nearest(few, F.col("vec_id") == 0).collect(), key=lambda r: r["rank"])] == [(1, 1), (2, 2)]


def test_search_leaves_far_vectors_out():
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(100, 32)), 20, 0) + 0.02 * rng.normal(size=(2000, 32))
    pairs: list = []
    at = np.arange(0, 2000, 50)
    q, row, _ = ann.search(x[at], at, x, np.arange(2000), np.arange(2000), 5, np.random.default_rng(SEED).normal(size=(32, ann.DIMS)), ann.chi_square_quantile(ann.SURE, ann.DIMS), pairs)
    assert sum(pairs) < 0.3 * len(at) * 2000 and (row // 20 == at[q] // 20).mean() > 0.99


def test_embedding_dedup_in_several_cells_with_clashing_ids(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "PER_CELL", 20)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 16)
    rng = np.random.default_rng(7)
    x = np.repeat(rng.normal(size=(30, 16)), 10, 0) + 0.15 * rng.normal(size=(300, 16))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = (u @ u.T >= 0.9) & ~np.eye(300, dtype=bool)
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert sum(got.values()) >= 0.95 * link.sum() and all(got[i] <= link[i].sum() for i in got)
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01])]
    out = sorted((r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert out == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]


def test_components_raise_when_unsettled(spark):
    chain = spark.createDataFrame([(k, k + 1) for k in range(200)], "a long, b long")
    with pytest.raises(RuntimeError):
        components.components(chain, rounds=1)
    assert components.components(chain).select("component").distinct().count() == 1


def test_empty_tables_of_urls_and_toxicity(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judged(pages, spark.createDataFrame([], "page_id long, bad int")).count() == 0
    docs, labels = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.toxicity(docs, toxicity.fit(docs, labels)).count() == 0


def test_url_domains_without_user_and_port(spark):
    t = spark.createDataFrame([("u:p@a.b.co.uk:8080",), ("x.net:1",), ("",)], "h string")
    got = [tuple(r) for r in t.select(url_filter.domain_of(F.col("h")), url_filter.suffix_of(F.col("h"))).collect()]
    assert got == [("b.co.uk", "co.uk"), ("x.net", "net"), ("", "")]


def test_shared_folder_is_asked_for_on_a_cluster():
    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError):
        common.shared_dir(Session)


def test_pipeline_against_brute_force(spark, monkeypatch, tmp_path):
    from tokenizers import Tokenizer

    from tessera.llm import bpe

    monkeypatch.setattr(corpus_pipeline.secrets, "train", lambda docs: secrets.Field())  # an untrained field adds nothing
    passage = prose(70, 900)
    rows = [(i, prose(40, i)) for i in range(30)]
    rows += [(40, rows[3][1]), (41, rows[4][1] + " end"), (42, prose(5, 70) + " " + passage), (43, passage + " " + prose(6, 71)), (44, "key password=abcdef123 done"), (None, prose(30, 99)), (45, None), (46, ""), (3, rows[3][1])]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), 7, "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, rid long, predicted string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w := tokens(t)) >= 5 else {tuple(w)} if w else set() for _, t in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for a, b in itertools.combinations(range(len(rows)), 2):
            if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                group[a] = group[b] = min(group[a], group[b])
    best = {}
    for k, g in enumerate(group):
        key = (rows[k][0] is None, rows[k][0] or 0)
        if g not in best or key < best[g][0]:
            best[g] = (key, k)
    kept = [rows[k] for _, k in best.values()]
    n, seen = suffix_dedup.LENGTH, {}
    for _, t in kept:
        b = (t or "").encode()
        for j in range(len(b) - n + 1):
            seen[b[j : j + n]] = seen.get(b[j : j + n], 0) + 1
    want = {}
    tok = Tokenizer.from_file(bpe.default_tokenizer())
    for i, t in kept:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - n + 1):
            if seen[b[j : j + n]] > 1:
                gone[j : j + n] = True
        text = np.frombuffer(b, np.uint8)[~gone].tobytes().decode("utf-8", "replace")
        text = re.sub(r"password=[a-z0-9]{6,}", "[SECRET]", text)
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [1], "<u4")
        want[i] = (len(ids), zlib.crc32(ids.tobytes()))
    got: dict = {}
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: r.start):
        got.setdefault(r.doc_id, []).append(r)
    assert {i: v[0].doc_tokens for i, v in got.items()} == {i: n for i, (n, _) in want.items()}
    assert all(v[0].ids_crc32 == want[i][1] for i, v in got.items() if len(v) == 1)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    after = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = common.Stored(stage(spark, after, str(tmp_path)), "test").df
    assert after.columns == docs.columns and {(r.rid, r.predicted) for r in after.collect()} == {(7, "x")}
