from pyspark.sql import functions as F

from tessera.functions import cleaning as C
from tessera.functions import similarity as S
from tessera.sources import tables


def test_ratio_family():
    assert S.ratio("abcd", "abxd") == 75.0
    assert S.ratio("", "") == 100.0
    assert S.token_set("big red dog", "dog red") == 100.0
    assert S.token_set("", "x") == 0.0
    assert S.token_sort("b a", "a b") == 100.0
    assert S.partial("abc", "xxabcxx") == 100.0
    assert round(S.jaro_winkler("martha", "marhta"), 6) == 0.961111


def test_cleaning(spark):
    t = spark.createDataFrame([("acme private limited", "eleventh street 007", "x dba acme")], "a string, b string, c string")
    r = t.select(C.name_core(F.col("a")), C.ordinals(F.col("b")), C.drop_alias(F.col("c")), C.numbers(F.col("b")), C.unaccent(F.lit("Crème"))).first()
    assert tuple(r) == ("acme", "11 street 007", "acme", ["7"], "creme")


def test_tsv_keeps_quotes(spark, tmp_path):
    (tmp_path / "a.tsv").write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\t"A" b\tx\tFR\n')
    assert tables.read_tsv(spark, str(tmp_path / "a.tsv")).first()["business_name"] == '"A" b'
