import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_in_order(spark):
    """Each stage keeps the columns, and what it drops follows from its own operator."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    columns = docs.columns
    seen = docs
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, seen, "/root/testdata/sf0.001")
        assert out.columns == columns, name
        assert out.select("doc_id").subtract(seen.select("doc_id")).count() == 0
        seen = pipeline.Scratch(spark).cut(out)
    last = pipeline.STAGES[-1][1](spark, seen, "/root/testdata/sf0.001")
    assert last.count() == seen.count()


def test_near_duplicates_leave_one_each(spark):
    text = " ".join(f"w{i}" for i in range(100))
    rows = [(1, text, "en", "s", 1), (2, text + " x", "en", "s", 1), (3, "quite another text of some words", "en", "s", 1), (3, "quite another text of some words", "en", "s", 1), (None, text, "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == [1, 3]


def test_mixing_draws_rows_without_id(spark):
    """A row of null doc_id without words has probability 0; of the others about as many stay as of rows with ids."""
    text = " ".join(f"word{i}" for i in range(20))
    rows = [(None if i < 200 else i, f"{text} n{i}", "en", "s", 1) for i in range(400)] + [(None, "", "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    left = pipeline.mix_to_targets(spark, docs, "")
    assert left.columns == docs.columns
    left = left.collect()
    drawn = pipeline.mixing.mix(docs).where("sampled and doc_id is not null").collect()
    assert {r.doc_id for r in left if r.doc_id is not None} == {r.doc_id for r in drawn}
    assert all(r.text for r in left) and 60 <= sum(r.doc_id is None for r in left) <= 140
