"""Change detector, text features without SQL, sources and rules on small hand-made cases."""

import itertools

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import changes, fixed
from tessera.functions import cleaning as C
from tessera.functions import similarity as S
from tessera.operators import analysis, dense, features, models, rules, scored
from tessera.plans import catalog
from tessera.sources import tables

STATES = {"oh": "ohio", "mn": "minnesota", "ny": "new york"}


@pytest.mark.parametrize(
    "record,entity,tags",
    [
        ("CARPENTERS LOCAL 438 438", "Carpenters Local 438", {"n_upper", "n_word_dup"}),
        ("Sbiuper 11 Pub Inc", "Super 11 Pub Inc", {"n_typo_multi"}),
        ("unitedfoundation.com", "United Foundation Inc", {"n_domain"}),
        ("National Green Games Ltd", "National Green Games Inc.", {"n_legal_change"}),
        ("Zenith Seaf0od LLC", "Zenith Seafood Inc", {"n_leet", "n_legal_change"}),
        ("Mr Sanjeet Mining Private Ltd", "Sanjeet Mining Private Limited", {"n_add:title", "n_legal_abbrev"}),
        ("Physical Partners Platinum Therapy LLC", "Physical Therapy Platinum Partners LLC", {"n_word_order"}),
        (None, "x", {"n_missing"}),
        ("東京商会", "Tokyo", {"n_script"}),
        ("Acme L.L.C.", "Acme LLC", {"n_legal_dot"}),
        ("Café Rouge", "Cafe Rouge", {"n_acc_add"}),
        ("Acme Bolt", "Acme Gear", {"n_swap:other"}),
        ("AB", "Acme Bolt Ltd", {"n_acronym", "n_upper", "n_legal_drop"}),
    ],
)
def test_name_tags(record, entity, tags):
    assert changes.name_tags(record, entity, STATES) == tags


@pytest.mark.parametrize(
    "record,entity,some",
    [
        ("5299 Royal Arh Cascade Drive, Bldg 45, Dublin, Ohio", "5299 Royal Arch Cascade Drive, Bldg 45, Dublin, OH", {"a_typo", "a_state_expand"}),
        ("MN, BURNSVILLE, 13009 IRVING AVE", "13009 Irving Avenue, MN, Burnsville", {"a_upper", "a_street_abbr", "a_shuffle"}),
        ("95TH STREET, CLEVELAND, OH", "2082 95th Street, Cleveland, OH", {"a_num_missing", "a_upper"}),
        ("325 Napoleon Ave, Columbus, Ohio", "321 Napoleon Avenue, Columbus, OH", {"a_num_up2_5", "a_state_expand", "a_street_abbr"}),
        ("OFFICE NO 25/7, A & B, PUNE", "Office No 25, A & B, Pune", {"a_num_suffix", "a_upper"}),
        (None, "x", {"a_missing"}),
    ],
)
def test_address_tags(record, entity, some):
    assert some <= changes.address_tags(record, entity, STATES)


def test_groups_and_number_state():
    assert changes.signature({"n_upper", "n_legal_change", "a_num_up2_5"}) == "LEGAL_CHANGE|UP2_5"
    assert changes.signature({"n_domain", "a_missing"}) == "DOMAIN|AMISS"
    assert changes.name_groups({"n_tradingas", "n_add:other", "n_typo_subst"}) == {"TRADINGAS", "TYPO"}


def test_address_key(spark):
    cases = {"4 rue du traite de lisbonne, pornic, pays de la loire": "4|lisbonne r traite", "apt 5, 12 main street": "5-12|apt main st", "main street": None, "75011 paris": None, "unit 007, high road, x": "7|high rd unit"}
    t = spark.createDataFrame([(k,) for k in cases], "a string")
    got = {r.a: r.k for r in t.select("a", C.address_key(F.col("a")).alias("k")).collect()}
    assert got == cases


def test_cleaning_words(spark):
    t = spark.createDataFrame([("acme l l c", "12 b / 7 no x", "@my-shop.co.in", "nineteenth 3rd av")], "a string, b string, c string, d string")
    r = t.select(C.name_core(F.col("a")), F.array_join(C.alnum_tokens(F.col("b")), ","), C.domain_name(F.col("c")), C.ordinals(F.col("d")), C.french_address(F.lit("3 bd de st michel, hauts de france"))).first()
    assert tuple(r) == ("acme", "12,7", "my-shop", "19 3 av", "3 boulevard saint michel")
    assert len(fixed.ORDINALS) == 20


def test_partial_equals_all_windows():
    rng = np.random.default_rng(0)
    for _ in range(60):
        a, b = ("".join(rng.choice(list("abc "), rng.integers(1, 9))) for _ in range(2))
        short, long_ = sorted((a, b), key=len)
        n = len(short)
        windows = {long_[max(0, k) : k + n] for k in range(1 - n, len(long_))} - {""}
        assert S.partial(a, b) == pytest.approx(max(S.ratio(short, w) for w in windows))


def _pairs(spark):
    rng = np.random.default_rng(1)
    rows = [(q, s, round(float(rng.random()), 3)) for q in range(30) for s in rng.choice(6, 2, replace=False).tolist()]
    recs = [(q, ["red bolt", "blue bolt", "red gear", None][q % 4], ["a st", "b rd", ""][q % 3], [None, "1", "2"][q % 3], q % 2) for q in range(30)]
    return rows, recs, spark.createDataFrame(rows, "q long, s long, p double"), spark.createDataFrame(recs, "q long, nm string, ad string, n1 string, src long")


def test_peer_texts_against_all_pairs(spark):
    rows, recs, t, r = _pairs(spark)
    text = {q: (nm or "", ad) for q, nm, ad, _, _ in recs}
    best = {q: max(((p, -s) for a, s, p in rows if a == q)) for q in range(30)}
    peers = [(-b, q) for q, (p, b) in best.items() if p >= 0.5]
    want = {}
    for q, s, _ in rows:
        others = [m for e, m in peers if e == s and m != q]
        names = [S.token_set(text[q][0], text[m][0]) for m in others]
        addrs = [S.token_set(text[q][1], text[m][1]) for m in others if text[q][1] and text[m][1]]
        want[q, s] = tuple(None if not v else round(f(v), 6) for v in (names, addrs) for f in (lambda v: sum(v) / len(v), min))
    got = {(x.q, x.s): tuple(None if v is None else round(v, 6) for v in (x.cons_name_mean, x.cons_name_min, x.cons_addr_mean, x.cons_addr_min)) for x in features.peer_texts(t, r).collect()}
    assert got == want


def test_sibling_texts_against_all_pairs(spark):
    rows, recs, t, r = _pairs(spark)
    text = {q: (nm or "", ad) for q, nm, ad, _, _ in recs}
    best = {q: max(((p, -s) for a, s, p in rows if a == q)) for q in range(30)}
    for x in features.sibling_texts(features.siblings(t, r)).collect():
        others = sorted((-p, q) for q, (p, b) in best.items() if -b == x.s and q != x.q)
        sib = others[0][1] if others else None
        assert x.sib == sib and (sib is None or x.sib_name_tset == pytest.approx(S.token_set(text[x.q][0], text[sib][0])))


def test_top_fraction_cuts_inside_a_bucket(spark):
    rows = [(q, 0, 0.5 if q < 10 else 0.9, "a") for q in range(20)] + [(30, 0, 0.1, "b")]
    t = spark.createDataFrame(rows, "q long, s long, p double, country string")
    got = {r.q for r in scored.top_fraction(t, {"a": 0.75}, None).collect()}
    assert got == {*range(10, 20), *range(5)}


def test_dense_top_k_and_cells(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, v array<float>").repartition(3)
    got = {(r.q, r["rank"]): r.s for r in dense.top_k(v.where("id < 5"), v, 3).collect()}
    s = np.round(x[:5].astype(float) @ x.T.astype(float), 6)
    s[np.arange(5), np.arange(5)] = -np.inf
    assert got == {(q, k + 1): int(o) for q in range(5) for k, o in enumerate(np.argsort(-s[q], kind="stable")[:3])}
    near = {(r.q, r.s) for r in dense.ivf_top_k(v.where("id < 5"), v, 3, probes=30).collect()}
    assert len(near & {(q, s) for (q, _), s in got.items()}) >= 10


def test_isotonic_is_monotone_and_cross_fitted(spark):
    t = spark.createDataFrame([(q, q % 60, q / 300, int(q % 300 > 150)) for q in range(300)], "q long, s long, p double, label int")
    rows = sorted(models.isotonic(t).where("fold = 0").collect(), key=lambda r: r.p)
    assert all(a.calibrated <= b.calibrated for a, b in itertools.pairwise(rows)) and rows[0].calibrated < 0.1 < 0.9 < rows[-1].calibrated


def test_sources_round_trip(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(12, dtype=np.float32).reshape(4, 3))
    got = sorted((r.row, list(r.v)) for r in tables.read_npy(spark, str(tmp_path / "v.npy")).collect())
    assert got == [(k, [3.0 * k, 3.0 * k + 1, 3.0 * k + 2]) for k in range(4)]
    t = spark.createDataFrame([(1, "a"), (2, "b")], "x long, c string")
    assert tables.write_missing(t, f"{tmp_path}/p", "c", ["a"]) == ["a"]
    assert tables.write_missing(t, f"{tmp_path}/p", "c", ["a", "b"]) == ["b"]
    tables.write_tsv(spark.createDataFrame([('S1-1', 'say "x"'), ('S1-2', None)], "s string, ids string"), f"{tmp_path}/t")
    assert sorted(tuple(r) for r in tables.read_tsv(spark, f"{tmp_path}/t").collect()) == [("S1-1", 'say "x"'), ("S1-2", None)]
    assert tables.read_tsv(spark, f"{tmp_path}/t", ["ids"]).columns == ["ids"]


def test_estimates():
    assert analysis.row_gain(0, 1, 1.0) == 1.0 and analysis.row_gain(2, 0, 0.5) == 0
    assert analysis.segment("redbolt", "red bolt") == 0 and analysis.segment("rbxx", "red bolt") == 2
    assert analysis.name_kind("red bolt", "rb") == "acronym" and analysis.name_kind("red bolt", "red gear") == "swap"
    a, b = analysis.least_squares(None, [([x], 2 * x + 1) for x in (0.0, 1.0, 2.0)], [0.0, 0.0], lambda v, x: v[0] + v[1] * x[0])
    assert (round(a, 4), round(b, 4)) == (1.0, 2.0)


def test_logit_shift_reaches_its_target(spark):
    t = spark.createDataFrame([(k / 100, "a") for k in range(1, 100)], "p double, country string")
    shift = analysis.logit_shift(t, "country", {"a": 0.7}).first()["shift"]
    z = np.log(np.arange(1, 100) / np.arange(99, 0, -1)) + shift
    assert (1 / (1 + np.exp(-z))).mean() == pytest.approx(0.7, abs=0.01)


def test_dispatch_uses_each_country_s_rule(spark):
    t = spark.createDataFrame([(1, 1, 0.55, "x"), (2, 1, 0.55, "y"), (3, 2, 0.9, "x")], "q long, s long, p double, country string")
    got = {(r.q, r.s) for r in rules.dispatch(t, {"x": {"type": "thr", "t": 0.6}, "default": {"type": "thr", "t": 0.5}}).collect()}
    assert got == {(2, 1), (3, 2)}


SF = "/root/testdata/sf0.001"
SOME = ["src_tsv_typed", "sink_resume", "name_core", "fr_clean", "addr_key", "change_tags", "page_comb", "blocking_union", "pair_cosine", "margins6", "stack_feats", "sibling_feats", "consensus_nums", "finalize", "same_address", "movers", "validate_file", "topup", "pattern_calib", "ambiguity", "row_gain", "expf_delta", "density_sim", "mistake_gain", "tune_grid", "topfrac", "second_max"]


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in "customer supplier part orders lineitem embeddings pages documents".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    plain = lambda v: f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    want = con.sql(catalog.ORACLE_SQL[name])
    columns = sorted(want.columns)
    got = catalog.QUERIES[name](spark, SF).select(columns).collect()
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
