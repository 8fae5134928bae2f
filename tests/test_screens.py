"""Operators of whole screens over small fixtures."""

import pytest
from pyspark.sql import functions as F

from covara.operators import screens as s


def test_course_summary(spark):
    courses = spark.createDataFrame([(1,), (2,), (3,)], "course_id int")
    documents = spark.createDataFrame([(1, 10), (1, 11), (2, 20)], "course_id int, document_id int")
    links = spark.createDataFrame([(1, "approved", 0.5), (1, None, 1.0)], "course_id int, status string, confidence double")
    rows = spark.createDataFrame([(1, 0), (1, 3), (1, 1), (2, 0)], "course_id int, docs int")
    found = {r.course_id: r for r in s.landing_state(s.course_summary(courses, documents, links, rows)).collect()}
    assert tuple(found[1]) == (1, 2, 2, 1, 0.75, 3, 2, 67, "ready")
    assert tuple(found[2]) == (2, 1, 0, 0, None, 1, 0, 0, "pending")
    assert tuple(found[3]) == (3, 0, 0, 0, None, 0, 0, 0, "empty")


def test_keywords_of(spark):
    rows = [(1, "b", None, 1), (1, "b", "later", 2), (1, "a", "x", 3), (None, "a", "x", 1), (2, "", "x", 1), (2, None, "x", 2), (3, "c", "y", 1)]
    tags = spark.createDataFrame(rows, "chunk int, keyword string, definition string, at int")
    found = {r.chunk: [tuple(k) for k in r.keywords] for r in s.keywords_of(tags, "chunk", ["at"]).collect()}
    assert found == {1: [("a", "x"), ("b", None)], 3: [("c", "y")]}
    assert s.keywords_of(tags.limit(0), "chunk", ["at"]).count() == 0


def test_context_before(spark):
    long = "y" * 120
    lines = spark.createDataFrame([(1, n, x) for n, x in enumerate([long, "a", "b", long, "c", long, long, long])], "doc int, line_no int, line string")
    found = [r.context for r in s.context_before(lines, "doc").orderBy("line_no").collect()]
    assert found == [None, None, "a", "a", "a", "b", "c", "c"]


def test_runs_and_paths(spark):
    attempts = spark.createDataFrame([("a", None), ("a", "bad"), ("a", "bad"), ("b", None), (None, "worse")], "source string, error string")
    assert {tuple(r) for r in s.run_summary(attempts, "source").collect()} == {("a", 3, 1, 2, "bad", True), ("b", 1, 1, 0, "", False), (None, 1, 0, 1, "worse", True)}
    assets = spark.createDataFrame([(1, r"C:\m\7\deck\3.png"), (2, "7/deck/3.png"), (3, "deck.png"), (4, None)], "id int, path string")
    once = s.backfilled(assets, "path")
    assert {(r.id, r.path, r.outcome) for r in once.collect()} == {(1, "7/deck/3.png", "rewritten"), (2, "7/deck/3.png", "unchanged"), (3, "deck.png", "unrecognised"), (4, None, "missing")}
    again = s.backfilled(once.drop("outcome"), "path")
    assert {r.id: r.outcome for r in again.collect()} == {1: "unchanged", 2: "unchanged", 3: "unrecognised", 4: "missing"}


def test_selection(spark):
    links = spark.createDataFrame([(1, "t"), (1, "u"), (2, "t"), (2, None)], "chunk int, topic string")
    assert {r.topic for r in s.linked_side(links, "topic", F.col("chunk") == 1).collect()} == {"t", "u"}
    assert {r.chunk for r in s.linked_side(links, "chunk", F.col("topic") == "t").collect()} == {1, 2}
    assert {r.topic for r in s.linked_side(links, "topic").collect()} == {"t", "u"}
    assert s.require_at_most(links, 4).count() == 4
    with pytest.raises(ValueError):
        s.require_at_most(links, 3)
    documents = spark.createDataFrame([(1,), (3,), (None,)], "chunk int")
    assert {r.chunk for r in s.unprocessed(documents, links, "chunk").collect()} == {3, None}
    assert [tuple(x) for r in s.items_of(links, "chunk", ["topic"]).filter("chunk = 1").collect() for x in r["items"]] == [("t",), ("u",)]


def test_map_shuffles_each_table_once(spark):
    """Whatever a map groups and joins meets by document; an official caption replaces the text of its label, null is no label."""
    from pyspark.sql import functions as F

    from covara.operators import payloads

    make = spark.createDataFrame
    documents = make([(1, 7, 2, "t")], "document_id int, course_id int, case_number int, case_title string")
    chunks = make([(1, 0, "s")], "document_id int, chunk_index int, section string")
    links = make([(1, 0, 5, "0.50", None)], "document_id int, chunk_index int, framework_id int, confidence string, status string")
    media = make([(1, 0, 3, "a", "x", ""), (1, 0, 4, None, "y", "p"), (1, 1, 5, "b", None, None)], "document_id int, chunk_index int, asset_id int, label string, text string, path string")
    captions = make([(1, "a", "z"), (1, "a", "official"), (1, None, "none"), (2, "b", "other")], "document_id int, label string, text string")
    tags = make([(1, 0, 1, "k", "d"), (1, 0, 0, "k", None), (1, 0, 2, "", "e"), (1, None, 0, "m", "n"), (None, None, 0, "q", "r")], "document_id int, chunk_index int, place int, keyword string, definition string")
    goals = make([(1, 0, "EO-0", "g")], "document_id int, ordinal int, code string, text string")
    catalog = make([], "stable_id int, sub_id string, domain string, description string, system string, subdomain string")
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        found = payloads.map_payload(documents, chunks, links, media, captions, tags, goals, catalog, catalog)
        plan = found._jdf.queryExecution().executedPlan().toString()
        rows = sorted((r.part, r.line) for r in found.filter(F.col("part").isin("media", "keywords")).collect())
    finally:
        spark.conf.set(threshold, before)
    assert plan.count("Exchange hashpartitioning") == 11 and "chunk_index" not in "".join(x for x in plan.split("\n") if "Exchange hashpartitioning" in x)
    assert rows == [
        ("keywords", '{"document_id":1,"chunk_index":0,"keywords":[{"keyword":"k","definition":null}]}'), ("keywords", '{"document_id":1,"chunk_index":null,"keywords":[{"keyword":"m","definition":"n"}]}'),
        ("media", '{"document_id":1,"chunk_index":0,"assets":[{"id":3,"label":"a","text":"official","has_file":false},{"id":4,"label":null,"text":"y","has_file":true}]}'),
        ("media", '{"document_id":1,"chunk_index":1,"assets":[{"id":5,"label":"b","text":null,"has_file":false}]}'),
    ]
