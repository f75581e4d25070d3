import corpus_pipeline


def test_rows_that_share_an_id_are_told_apart(spark, make, folder):
    a, b, c = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "red orange yellow green blue violet")
    rows = [(3, a), (5, a), (5, b), (7, c), (7, c), (8, b), (None, c), (None, "its own words in this one row"), (9, ""), (9, ""), (10, None)]
    kept = corpus_pipeline.one_of_each_group(spark, make([(i, t, "en", "s", 1) for i, t in rows]).repartition(3), folder)
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert found == sorted([(3, a), (5, b), (7, c), (None, "its own words in this one row"), (9, ""), (9, ""), (10, None)], key=str)


def test_stages_take_odd_and_empty_tables(spark, odd, none, folder):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == corpus_pipeline.COLUMNS and out.count() <= docs.count()
