from tessera.plans import registry


def test_unaccent_returns_whole_texts(spark, tmp_path):
    text = "Crème " * 100 + "Fin"
    spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.plain for r in registry.unaccent(spark, str(tmp_path)).collect()} == {1: "creme " * 100 + "fin", 2: None, 3: ""}
