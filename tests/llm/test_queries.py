from tests.compare import duck, rows

from loadweave.llm import queries


def test_sql(spark, sf):
    con = duck(sf)
    for name, sql in queries.SQL.items():
        assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(con.execute(sql).fetch_df())


def test_all_run(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    for name in ("op2_byte_bpe", "op3_source_mix", "op4_lattice_score", "op6_suffix_dedup", "op7_ngram_quality", "op8_site_bayes", "op9_simhash_components"):
        assert queries.QUERIES[name](spark, sf).select("doc_id").distinct().count() == n


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3]
    assert corpus_pipeline.run(spark, sf).count() == sizes[4]
