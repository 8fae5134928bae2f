"""Operators on items over small fixtures."""

import pytest
from pyspark.sql import functions as F

from covara.functions.coverage import spectrum_sentence
from covara.operators import items as i

ITEMS = "doc int, text string, confidence string, coded boolean, at int"


@pytest.fixture(scope="module")
def originals(spark):
    rows = [(d, t, c, k, n) for d in (1, 2, 3) for n, (t, c, k) in enumerate([("Name the parts", "high", False), ("list  CAUSES", "medium", False), ("scrap", "low", False), ("Coded scrap", "low", True), ("name the parts", "medium", False), ("Other aim", "medium", False)])]
    return spark.createDataFrame(rows, ITEMS)


def test_merge_cleaned(spark, originals):
    cleaned = spark.createDataFrame([(d, t, "medium", False, n) for d in (1, 2) for n, t in enumerate(["List causes", "New aim"])], ITEMS)
    reasons = spark.createDataFrame([(1, "missing"), (2, "messy"), (3, "messy")], "doc int, reason string")
    rows = i.merge_cleaned(originals, cleaned, reasons, "doc", ["at"]).orderBy("doc", "ordinal").collect()
    of = lambda d: [r.text for r in rows if r.doc == d]
    assert of(1) == ["Name the parts", "list  CAUSES", "scrap", "Coded scrap", "Other aim", "New aim"]
    assert of(2) == ["Name the parts", "Coded scrap", "Other aim", "List causes", "New aim"]
    assert of(3) == [r.text for r in originals.filter("doc = 3").orderBy("at").collect()]
    assert i.merge_cleaned(originals.limit(0), cleaned.limit(0), reasons, "doc", ["at"]).count() == 0


def test_with_prior(spark, originals):
    cleaned = spark.createDataFrame([(1, "NAME the parts "), (1, "unknown"), (1, None)], "doc int, text string")
    rows = i.with_prior(cleaned, originals, "doc", ["at"], {"confidence": "low", "at": -1}).collect()
    assert {(r.text, r.confidence, r.at) for r in rows} == {("NAME the parts ", "high", 0), ("unknown", "low", -1), (None, "low", -1)}


def test_needs_review(spark):
    docs = spark.createDataFrame([(n, n != 0, n == 1) for n in range(7)], "doc int, has_sections boolean, topics_only boolean")
    long = "x" * 401
    items = spark.createDataFrame([(3, "a", "low", False, 0), (3, "b", "high", False, 1), (4, "a", "low", False, 0), (4, "b", "high", False, 1), (4, "c", "high", False, 2), (5, long, "medium", False, 0), (6, long, "medium", True, 0)], ITEMS)
    assert {r.doc: r.needs_review for r in i.needs_review(docs, items, "doc").collect()} == {0: False, 1: False, 2: True, 3: True, 4: False, 5: True, 6: False}


def test_captions(spark):
    assets = spark.createDataFrame([("f", "A", 1, "mined"), ("f", "A", 2, "mined"), ("f", "B", 1, "mined"), ("g", "A", None, None)], "filename string, label string, source_index int, mined string")
    rows = spark.createDataFrame([("f", "A", 1, "first", 1), ("f", "A", 1, "last", 2), ("f", "A", None, "any", 3)], "filename string, label string, source_index int, text string, id int")
    found = {(r.filename, r.label, r.source_index): (r.caption, r.has_caption, r.caption_source) for r in i.with_captions(assets, rows, ["id"]).collect()}
    assert found == {("f", "A", 1): ("last", True, "csv"), ("f", "A", 2): ("any", True, "csv"), ("f", "B", 1): ("mined", True, "mined"), ("g", "A", None): (None, False, None)}
    left = i.captions_to_rescue(assets, rows, ["filename", "label", "source_index"], "mined").collect()
    assert {(r.label, r.source_index) for r in left} == {("A", 2), ("B", 1)}


def test_captions_after(spark):
    lines = ["Figure 1", "a caption line that is long enough", "short", "another line that is long enough", "beyond the reach of the figure", "Figure 2", "Figure 3"]
    rows = i.captions_after(spark.createDataFrame([(1, n, x) for n, x in enumerate(lines)], "doc_id int, line_no int, line string"), F.col("line").startswith("Figure"), F.length("line") >= 20).collect()
    assert {r.line: r.caption for r in rows} == {"Figure 1": "a caption line that is long enough another line that is long enough", "Figure 2": None, "Figure 3": None}


def test_in_module(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "course_id int")
    modules = spark.createDataFrame([(1, "M"), (2, "N")], "course_id int, module string")
    of = lambda w: sorted(r.course_id for r in i.in_module(rows, modules, w).collect())
    assert (of("all"), of("M"), of("Unassigned"), of("none")) == ([1, 2, 3], [1], [3], [])


def test_enriched(spark):
    chunks = spark.createDataFrame([(1, "See Figure. The HEART beats."), (2, None)], "chunk int, content string")
    captions = spark.createDataFrame([(1, 2, "Figure 2", "a lung"), (1, 1, "Figure 1", "the heart beats"), (1, 0, "Figure 0", None), (2, 1, "Figure 1", "a lung")], "chunk int, ordinal int, label string, caption string")
    assert {r.chunk: r.embed_text for r in i.enriched(chunks, captions, ["chunk"]).collect()} == {1: "Figure 2: a lung\nSee Figure. The HEART beats.", 2: "Figure 1: a lung"}


def test_sentences(spark):
    rows = spark.createDataFrame([(0, 0, 0), (0, 5, 5), (5, 5, 0), (2, 5, 3)], "addressed long, total long, gap long")
    assert [r.s for r in rows.select(spectrum_sentence(F.col("addressed"), F.col("total"), F.col("gap")).alias("s")).collect()] == [
        "No framework domains to report yet.", "0 of 5 domains addressed — no documents aligned yet.", "All 5 domains addressed.", "2 of 5 domains addressed; 3 need attention.",
    ]
