import corpus_pipeline as p
from covara.llm import decontaminate, quality, secrets, simhash

from .conftest import prose


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, expected = docs.columns, {r.doc_id for r in quality.quality_rules(docs).filter("kept").collect()}
    for name, stage in p.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == columns
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        if name == "near_duplicates":
            expected = {r.component_id for r in simhash.near_duplicates(docs).collect()}
        if name == "decontamination":
            expected = expected - {r.doc_id for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
        assert ids == expected
        if name == "secrets":
            assert secrets.scan_secrets(out).filter("size(base) > 0").count() == 0
            assert out.filter("n_chars <> length(text)").count() == 0
        docs = out
    last = {r.doc_id for r in p.STAGES[-1][1](spark, docs, sf).collect()}
    assert last == expected == {r.doc_id for r in p.run(spark, sf).collect()}


def test_edges(spark, edges, empty, sf):
    for df in (edges, empty):
        for _, stage in p.STAGES:
            assert stage(spark, df, sf).count() <= df.count()
    once = p.near_duplicate_stage(spark, edges, sf).collect()
    ids = [r.doc_id for r in once]
    # of the rows without doc_id the one with a text of its own stays
    assert ids.count(6) == 2 and 20 not in ids and ids.count(None) == 1
    assert {r.text for r in once if r.doc_id is None} == {prose(5, 40)}
    clean = p.decontamination_stage(spark, edges, sf).collect()
    assert len(clean) == edges.count()


def test_repeated_ids(spark, sf):
    """Of equal texts of a repeated doc_id the least row stays, whatever the order of the rows; different texts stay each."""
    rows = [(1, prose(1, 60), "en", "b", 9), (1, prose(2, 60), "en", "a", 9), (1, prose(1, 60), None, "b", 9), (2, prose(1, 60), "en", "b", 9), (3, prose(4, 60), "en", "b", 9)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for given in (rows, rows[::-1]):
        out = p.near_duplicate_stage(spark, spark.createDataFrame(given, schema), sf)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert sorted((r.doc_id, r.text, r.lang) for r in out.collect()) == sorted([(1, prose(1, 60), "en"), (1, prose(2, 60), "en"), (3, prose(4, 60), "en")])


def test_other_columns_of_any_type_and_name(spark, sf):
    """Map columns and columns that are named like those of the stages; groups without any doc_id keep one row."""
    rows = [(i, prose(i or 9, 60), "s", {"k": 1}, "x", "y", "z", "v") for i in (None, 1, 1, 2, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, count map<string, int>, row string, component_id string, first string, hash string")
    for name, stage in p.STAGES[1:-1]:
        out = stage(spark, df, sf)
        assert out.columns == df.columns
        assert out.count() == (3 if name == "near_duplicates" else 5)
        assert sorted(str(r.doc_id) for r in out.collect()) == (["1", "2", "None"] if name == "near_duplicates" else ["1", "1", "2", "None", "None"])


def test_rows_without_doc_id_are_decontaminated(spark, sf):
    item = spark.read.parquet(f"{sf}/benchmark.parquet").first().text
    df = spark.createDataFrame([(None, f"x {item} y"), (None, "clean"), (1, None)], "doc_id bigint, text string")
    assert [(r.doc_id, r.text) for r in p.decontamination_stage(spark, df, sf).collect()] == [(None, "clean"), (1, None)]
