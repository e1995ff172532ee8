from tessera.operators import scored, validate


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def pairs(spark, data):
    return spark.createDataFrame(data, "q long, s long, p double")


def test_margin_of_lone_row_and_of_tie(spark):
    t = scored.margin(pairs(spark, [(1, 1, 0.4), (2, 1, 0.7), (2, 2, 0.7), (3, 1, 0.9), (3, 2, 0.2)]))
    got = {(r.q, r.s): round(r.margin, 6) for r in t.collect()}
    assert got == {(1, 1): 0.4, (2, 1): 0.0, (2, 2): 0.0, (3, 1): 0.7, (3, 2): -0.7}


def test_macro_f05_worked_example(spark):
    pred = spark.createDataFrame([(47, 1), (193, 1), (812, 1)], "q long, s long")
    true = spark.createDataFrame([(47, 1), (812, 1)], "q long, s long")
    f = {r.s: r.f for r in scored.f05_by_entity(pred, true, spark.createDataFrame([(1,), (2,)], "s long")).collect()}
    assert round(f[1], 3) == 0.714 and f[2] == 1.0


def test_expected_f_prefers_none_when_unsure(spark):
    got = rows(scored.decide_expected(pairs(spark, [(1, 1, 0.99), (2, 1, 0.98), (3, 2, 0.31), (4, 3, 0.2)])))
    assert got == [(1, 1), (2, 1)]


def test_pair_sets_move_and_veto(spark):
    d = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "q long, s long")
    add = spark.createDataFrame([(2, 2)], "q long, s long")
    veto = spark.createDataFrame([(3, 2)], "q long, s long")
    assert rows(scored.apply_sets(d, add, veto)) == [(1, 1), (2, 2)]


def test_close_calls_bounds_are_inclusive(spark):
    t = pairs(spark, [(1, 1, 0.01), (2, 1, 0.995), (3, 1, 0.999), (4, 1, 0.999), (4, 2, 0.2), (5, 1, 0.009)])
    assert {r.q for r in scored.close_calls(t).collect()} == {1, 2, 4}


def test_validator_counts_each_break(spark):
    lists = spark.createDataFrame([(1, "1,1,2"), (1, "3"), (9, "2")], "s long, matched string")
    got = {r.rule: r.n for r in validate.validate(lists, spark.createDataFrame([(1,), (2,)], "s long"), spark.createDataFrame([(1,), (2,)], "q long")).collect()}
    assert got == {"duplicate_entity": 1, "missing_entity": 1, "extra_entity": 1, "duplicate_in_list": 1, "record_twice": 1, "unknown_record": 1}
