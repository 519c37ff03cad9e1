"""The pipeline's stages on tables that they may meet: no rows, columns of any name, nulls and repeated rows."""

import pytest
from pyspark.sql import functions as F

SF_COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def stages():
    import corpus_pipeline

    return corpus_pipeline.STAGES


def words(k, n=60):
    return " ".join(f"word{(k * 7 + j * j) % 500}" for j in range(n))


@pytest.mark.parametrize("n", range(5))
def test_no_rows(spark, sf, n):
    docs = spark.createDataFrame([], SF_COLUMNS)
    out = stages()[n][1](spark, docs, sf)
    assert out.count() == 0
    assert n == 4 or out.columns == docs.columns


@pytest.mark.parametrize("n", range(5))
def test_clashing_columns_nulls_and_repeats(spark, sf, n):
    rows = [(k, words(k), "en", f"s{k % 2}", 1) for k in range(12)]
    rows += [
        (None, words(3), None, None, None), (50, None, "en", "s0", 0), (51, "", "de", None, 0), (2, words(2), "en", "s0", 1),
        (2, words(2), "en", "s0", 1), (60, words(1) + " " + words(1), "en", "s1", 1)
    ]
    docs = spark.createDataFrame(rows, SF_COLUMNS)
    names = [
        "found", "cut_id", "row_copies", "row_copy", "row_key", "_copies", "uid", "copies", "h", "p", "size", "group", "fp", "rep", "kept",
        "host", "path", "posterior", "count", "ids"
    ]
    docs = docs.withColumns({c: F.lit(i) for i, c in enumerate(names)})
    out = stages()[n][1](spark, docs, sf)
    got = out.collect()
    if n == 4:
        assert len(got) == len(rows)
        return
    assert out.columns == docs.columns and len(got) > 0
    assert all([r[c] for c in names] == list(range(len(names))) for r in got)
    assert {r["doc_id"] for r in got} <= {r[0] for r in rows}
