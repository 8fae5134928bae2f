"""The text jobs with their own patterns on small invented documents."""

import pytest
from pyspark.sql import functions as F

from covara.operators import chunking, figures, keyed, objectives, rollups
from covara.sources import readers

GUIDE = """Guide to the heart
Contents\t1
Valves\t2
Rhythm ..... 3
Some words before any heading.
Overview:
The heart has four chambers. It beats all day.
Note:
This stays in its section.
Activity 2b: Rounds
One line of text.A second page of it.
Question 1 What is a valve?
"""


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")


def test_chunks_of_a_guide(spark):
    rules = chunking.ChunkRules(floor=1)
    got = [(r.chunk_index, r.block_index, r.section, r.page, r.content) for r in chunking.document_chunks(docs(spark, GUIDE), rules).orderBy("chunk_index").collect()]
    assert got == [
        (0, 0, "Introduction", 1, "Guide to the heart\nSome words before any heading."),
        (1, 1, "Overview:", 1, "The heart has four chambers. It beats all day.\nNote:\nThis stays in its section."),
        (2, 2, "Activity 2b: Rounds", 1, "One line of text."),
        (3, 2, "Activity 2b: Rounds", 2, "A second page of it."),
    ]


def test_chunks_of_odd_texts(spark):
    found = chunking.document_chunks(docs(spark, "", None, " \n ", "no heading here", "Overview", "Overview\nSummary"), chunking.ChunkRules(floor=1)).collect()
    assert sorted((r.doc_id, r.section, r.page, r.content, r.embed_text) for r in found) == [(3, "Document", None, "no heading here", "Document\nno heading here"), (4, "Document", None, "Overview", "Document\nOverview"), (5, "Document", None, "Overview\nSummary", "Document\nOverview\nSummary")]


def test_chunks_do_not_depend_on_segments(spark):
    """A long text is cut into segments of lines; contents lines at the ends of sections and sections of page marks only count as they do in one."""
    mark = chunking.PAGE_MARK
    long = "\n".join(f"Activity {i}: Part\nWords of part {i}.\n{mark if i % 3 else ''} more\n\n" for i in range(40))
    texts = docs(spark, GUIDE, long, f"Overview\n{mark}\nSummary\nThe end.", "a\t1\nb\t2\nc\t3", "Overview\na\t1\nb\t2\nc\t3\nSummary\nlast")

    def chunks(lines):
        found = chunking.document_chunks(texts, chunking.ChunkRules(floor=1, segment_lines=lines))
        return sorted(map(tuple, found.select("doc_id", "chunk_index", "block_index", "section", F.coalesce("page", F.lit(0)), "content").collect()))

    whole = chunks(4096)
    assert chunks(3) == whole
    assert [x[1:] for x in whole if x[0] == 2] == [(0, 1, "Summary", 2, "The end.")]
    assert [x[1:] for x in whole if x[0] == 3] == [(0, 0, "Document", 0, "a\t1\nb\t2\nc\t3")]
    assert [x[1:] for x in whole if x[0] == 4] == [(0, 0, "Summary", 0, "last")]


@pytest.mark.parametrize("budget, overlap", [(6, 3), (8, 0), (5, 5)])
def test_packing(budget, overlap):
    units = [("one two three.", 3), ("four five six.", 3), ("a list item", 3), ("another end.", 2), ("w " * 20 + "end.", 21), ("last one.", 2)]
    parts = chunking.pack(units, budget, overlap)
    assert all(len(p.split()) <= max(budget, budget + overlap) for p in parts)
    assert set(" ".join(x for x, _ in units).split()) == set(" ".join(parts).split())
    assert chunking.pack([], budget, overlap) == [] and chunking.pack([("all in one.", 3)], budget, overlap) == ["all in one."]
    assert chunking.word_windows("a b c d e f g".split(), 4, 1) == ["a b c d", "d e f g"]


LESSON = """Learning Objectives
By the end of this session
1. Describe the flow of blood through
the four chambers of it.
2. Explain why valves close. (EO-0002)
- Describe the flow of blood through the four chambers of it.
Self-Study Topics
Valves of the heart (TO-0001)
Compare both sides of the heart.
Page 3
Activity 1 begins
Describe what is outside of the range.
"""


def test_objectives_of_a_guide(spark):
    found = objectives.extracted(docs(spark, LESSON)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.text, r.code, r.confidence, r.line_no) for r in found] == [
        (1, "Describe the flow of blood through the four chambers of it.", None, "high", 2),
        (2, "Explain why valves close. (EO-0002)", "EO-0002", "high", 4),
        (3, "Compare both sides of the heart.", None, "high", 8),
    ]
    assert [tuple(r) for r in objectives.batch_report(docs(spark, LESSON, "nothing")).select("doc_id", "sections", "objectives").orderBy("doc_id").collect()] == [(None, 1, 3), (0, 1, 3), (1, 0, 0)]
    topics = docs(spark, "Case Specific Objectives\nSelf-Study Topics\nValves of the heart (TO-0001)\nRhythm of it (TO-0002)\nOverview", LESSON, "no range")
    assert [tuple(r) for r in objectives.range_kinds(topics).orderBy("doc_id").collect()] == [(0, True, True), (1, True, False), (2, False, False)]


FIGURES = """A short line
Answer Image 1A: the left chamber seen from above
CHAMBERS
Rationale: it is the larger one
Figure 8.2 valves
more about the valves of the heart, and more
as Figure 8.2 shows
Figure 8.2: again
Answer figure:
Watch this video
https://youtu.be/abc-1
Provided image: x
"""


def test_figures_of_a_guide(spark):
    found = figures.figure_registry(docs(spark, FIGURES)).orderBy("line_no").collect()
    assert [(r.line_no, r.kind, r.label, r.has_caption, r.source_index) for r in found] == [
        (1, "answer_image", "Answer Image 1A", True, 1), (4, "figure", "Figure 8.2", True, 1), (7, "figure", "Figure 8.2", False, 1), (8, "answer_image", "Answer Image", False, 2),
        (9, "video", "Video: https://youtu.be/abc-1", True, None), (10, "video", "Video: https://youtu.be/abc-1", True, None), (11, "provided_image", "Provided image", False, None),
    ]
    assert found[0].text == "the left chamber seen from above CHAMBERS Rationale: it is the larger one" and found[0].section == "A short line"
    chunks = spark.createDataFrame([(0, 0, "see ANSWER  figure 1a"), (0, 1, "figure 8 and more"), (0, 2, "nothing")], "doc_id bigint, chunk_index int, content string")
    labels = spark.createDataFrame([(0, "Answer Image 1A"), (0, "Figure 8.2")], "doc_id bigint, label string")
    assert sorted(map(tuple, figures.mentions(chunks, labels).collect())) == [(0, 0, "Answer Image 1A"), (0, 1, "Figure 8.2")]
    kinds = spark.createDataFrame([(0, "faculty"), (5, "self_study")], "doc_id bigint, kind string")
    files = spark.createDataFrame([(0, 1, "a.png")], "doc_id bigint, source_index int, path string")
    got = {r.doc_id: (r.labels, r.answer_images, r.failures) for r in figures.figure_gate(figures.figure_registry(docs(spark, FIGURES)), kinds, files).collect()}
    assert got == {0: (7, 2, ["Answer Image missing caption text and extracted file"]), 5: (0, 0, [])}


def test_links_off_the_catalog_keep_their_label(spark):
    links = spark.createDataFrame([("USMLE", 1, "Renal — Stones", 7, 1, 1, 1), ("USMLE", 9, "Heart — Gone", 7, 1, 2, 1), ("USMLE", 9, "Heart — Gone", 7, 2, 1, None)], "framework string, framework_id int, label string, course_id int, document_id int, chunk_index int, case_number int")
    catalog = spark.createDataFrame([(1, "Kidney")], "stable_id int, system string")
    got = {(r.framework_id, r.system, r.docs, r.chunks) for r in rollups.topic_partials(links, catalog).collect()}
    assert got == {(1, "Kidney", 1, 1), (9, "Heart", 2, 2)}
    assert {(r.system, r.touched) for r in rollups.case_systems(links, catalog, "course_id").collect()} == {("Kidney", 1), ("Heart", 1)}


def test_restored_values_must_be_readable(spark, tmp_path):
    df = spark.createDataFrame([(1, "[1,2]", "0.50"), (2, None, None)], "id int, v string, c string")
    readers.snapshot({"t": df}, str(tmp_path / "s"))
    back = readers.restore(spark, str(tmp_path / "s"), {"t": "id bigint, v array<float>, c decimal(3,2)"}, str(tmp_path / "r"))["t"]
    assert [(r.id, r.v, str(r.c)) for r in back.orderBy("id").collect()] == [(1, [1.0, 2.0], "0.50"), (2, None, "None")]
    with pytest.raises(Exception, match="t.v"):
        readers.restore(spark, str(tmp_path / "s"), {"t": "v array<array<int>>"})["t"].collect()


def test_isolated_work(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(1, "4"), (2, "x"), (3, None)], "id int, t string")
    got = keyed.isolated(rows, {"n": F.col("t").try_cast("int") * 2}, {"text": F.col("t").isNotNull(), "number": F.col("t").rlike("^[0-9]+$")}).orderBy("id").collect()
    assert [(r.error, r.n) for r in got] == [(None, 8), ("number", None), ("text", None)]


def test_ranges_do_not_depend_on_segments(spark):
    """A range that spans segments of few lines is found as in one segment, with its pages and numbers."""
    text = ("Learning Objectives\n\nObjectives\n" + "1. Describe the flow of blood.\n" * 7 + "Overview\nno range\n") * 3
    both = docs(spark, text, LESSON, "Objectives", "nothing", "")
    want = [tuple(r) for r in objectives.objective_ranges(both).orderBy("doc_id", "range_no").collect()]
    assert len(want) > 3
    for n in (1, 2, 5):
        assert [tuple(r) for r in objectives.objective_ranges(both, segment_lines=n).orderBy("doc_id", "range_no").collect()] == want


def test_a_long_document_spreads_over_tasks(spark):
    from pyspark.sql import functions as F

    from covara.operators import scan

    flip = scan.Automaton(2, 2, lambda s, x: (s ^ x, 1 if s ^ x else 2))
    lines = spark.range(200_000).selectExpr("0 doc_id", "cast(id as int) line_no", "cast(id % 3 = 0 as int) symbol")
    found = scan.scanned(lines, "doc_id", flip, F.col("symbol"), F.col("symbol"), ["symbol"], 1000)
    rows = found.agg(F.sum(F.col("out") * F.col("line_no")).alias("a"), F.max("number").alias("n"), F.max("before").alias("b"), F.max("marks").alias("m")).first()
    state = total = ones = 0
    for i in range(200_000):
        state ^= i % 3 == 0
        ones += state
        total += i * (1 if state else 2)
    assert (rows.a, rows.n, rows.m) == (total, ones, 66_667)
    assert found.groupBy(F.spark_partition_id()).count().count() > 1


def test_sections_and_pages_do_not_depend_on_segments(spark):
    from pyspark.sql import functions as F

    from covara.operators import lines as ln

    texts = ["a\nHEAD\nb|\nc||d\nHEAD\n" * 5 + "x", "no heading", "", "HEAD", "|"]
    rows = ln.lines_of(docs(spark, *texts))
    want = []
    for i, t in enumerate(texts):
        number, section, page, marks = 0, None, 1, t.count("|")
        for j, x in enumerate(t.split("\n")):
            number, section = (number + 1, x) if x == "HEAD" else (number, section)
            want.append((i, j, number, section or ("Introduction" if "HEAD" in t else "Document"), page if marks else None))
            page += x.count("|")
    for n in (1, 3, 4096):
        found = ln.with_pages(ln.with_sections(rows, F.col("line") == "HEAD", segment_lines=n), "|", segment_lines=n)
        assert sorted(map(tuple, found.select("doc_id", "line_no", "section_no", "section", "page").collect()), key=str) == sorted(want, key=str)


def test_ranges_of_short_documents_stay_in_their_rows(spark, monkeypatch):
    """Only documents of several segments are cut into rows of lines, and a report finds the ranges once."""
    spread, found = [], []
    lines, ranges = objectives.lines_of, objectives.objective_ranges
    monkeypatch.setattr(objectives, "lines_of", lambda df, key: spread.append([r[0] for r in df.select(key).collect()]) or lines(df, key))
    monkeypatch.setattr(objectives, "objective_ranges", lambda *x, **y: found.append(1) or ranges(*x, **y))
    guide = "Learning Objectives\n1. Describe the heart and its valves.\n\n2. Explain how blood flows through\nthe lungs.\nOverview\nMore"
    both = docs(spark, guide, "x\n" * 5000 + guide, "no heading", "")
    report = {r["doc_id"]: (r["sections"], r["objectives"]) for r in objectives.batch_report(both).collect()}
    assert report == {0: (1, 2), 1: (1, 2), 2: (0, 0), 3: (0, 0), None: (2, 4)}
    assert spread == [[1]] and found == [1]


def test_parts_of_a_page_meet_in_its_row(spark, monkeypatch):
    """Parts are merged in the row of their page, and a gate makes the pages once."""
    assert chunking.merge_groups([False, False, True, False, True], [False, True, False, False, False]) == [[0, 2, 3], [4]]
    assert chunking.merge_groups([False], [True]) == [] and chunking.merge_groups([False, False], [False, False]) == [[0, 1]]
    pages, real = [], chunking.section_pages
    monkeypatch.setattr(chunking, "section_pages", lambda *x: pages.append(1) or real(*x))
    found = chunking.chunk_gate(docs(spark, GUIDE, "lone text", ""), chunking.ChunkRules(floor=1)).orderBy("doc_id").collect()
    assert pages == [1] and [(r.doc_id, r.sections, r.chunks) for r in found] == [(0, 3, 4), (1, 1, 1), (2, 0, 0)]
