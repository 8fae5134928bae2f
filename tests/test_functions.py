import pytest
from pyspark.sql import functions as F

from covara.functions import coverage, predicates, scalar
from covara.operators import keyed, lines, vectors
from covara.sources import exports, readers
from covara.streaming import streams


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_levels_and_cells(spark):
    docs = [-1, 0, 1, 2, 3, 4, 7, 8, 50]
    got = [r.x for r in spark.createDataFrame([(d,) for d in docs], "d int").select(coverage.level_of(F.col("d")).alias("x")).collect()]
    assert got == ["gap", "gap", "introduced", "reinforced", "reinforced", "strong", "strong", "heavy", "heavy"]
    cells = spark.createDataFrame([(0, 5), (3, 0), (3, 6), (1, 6), (1, 3), (2, 3), (None, 4), (2, None)], "a int, b int")
    assert [r.x for r in cells.select(coverage.heatmap_cell(F.col("a"), F.col("b")).alias("x")).collect()] == ["gap", "gap", "covered", "partial", "partial", "covered", "gap", "gap"]
    counts = spark.createDataFrame([(d, 20) for d in (1, 2, 3, 5, 9)], "docs int, total int")
    assert counts.agg(*coverage.distribution(F.col("docs"), F.col("total"))).first().asDict() == {"total": 20, "addressed": 5, "substantive": 4, "gap": 15, "introduced": 1, "reinforced": 2, "strong": 1, "heavy": 1}


def test_predicates(spark):
    s = spark.createDataFrame([("approved",), ("rejected",), ("pending",), (None,)], "status string")
    assert [r.x for r in s.select(predicates.not_rejected().alias("x")).collect()] == [True, False, True, True]
    assert [r.x for r in s.select(predicates.is_reviewed().alias("x")).collect()] == [True, True, False, False]
    for raw, want in (("0.5", 0.5), ("0.5abc", 0.5), ("abc", None), ("3", None), ("", None), (None, None)):
        assert one(spark, predicates.parse_number(F.lit(raw), 0, 2)) == want


CASES = [
    (lambda: scalar.collapse_label(F.lit("EO1: Heart — Heart")), "EO1: Heart"),
    (lambda: scalar.collapse_label(F.lit("Heart — Lung")), "Heart — Lung"),
    (lambda: scalar.slug(F.lit(" Blood & Lymph: (adult) ")), "blood-and-lymph-adult"),
    (lambda: scalar.system_of(F.lit(None).cast("string"), F.lit("Renal — Stones")), "Renal"),
    (lambda: scalar.normalised(F.lit("\u00a0 A\u00a0 b\n C ")), "a b c"),
    (lambda: scalar.activity_key(F.lit("Activity 12b: Rounds")), "Activity 12B"),
    (lambda: scalar.activity_key(F.lit("Summary")), None),
    (lambda: scalar.objective_code(F.lit("Name the valves (EO-0123)")), "EO-0123"),
    (lambda: scalar.page_label(F.lit("a.PPTX"), F.lit(3)), "Slide 3"),
    (lambda: scalar.page_label(F.lit("a.pdf"), F.lit(None).cast("int")), None),
    (lambda: scalar.locator(F.lit("C:\\x\\12\\guide\\3.png")), "12/guide/3.png"),
    (lambda: scalar.is_absolute(F.lit("\\\\host\\share")), True),
    (lambda: scalar.highlighted(F.lit("a.b AxB a.B"), "a.b"), "<mark>a.b</mark> AxB <mark>a.B</mark>"),
    (lambda: scalar.csv_cell(F.lit('=1+"2"')), '"\'=1+""2"""'),
    (lambda: scalar.framework_of(F.lit("x-EPA-1")), "AAMC_EPA"),
    (lambda: scalar.percent(F.lit(1), F.lit(8)), 13),
    (lambda: scalar.percent(F.lit(1), F.lit(0)), 0),
    (lambda: scalar.vector_to_text(scalar.vector_from_text(F.lit("[1.5,2]"))), "[1.5,2.0]"),
    (lambda: scalar.scope_hint(F.lit("Renal"), F.lit("Renal tract")), None),
    (lambda: scalar.scope_hint(F.lit("Renal"), F.lit("x" * 130)), "x" * 120 + "…"),
    (lambda: scalar.scope_hint(F.lit(None).cast("string"), F.lit("Renal tract")), "Renal tract"),
    (lambda: scalar.scope_hint(F.lit(" "), F.lit("Renal tract")), "Renal tract"),
    (lambda: scalar.page_label(F.lit("a.PDF"), F.lit(3)), "Page 3"),
    (lambda: scalar.page_label(F.lit("a.docx"), F.lit(3)), None),
    (lambda: scalar.marker_count(F.lit("a\ue000b\ue000")), 2),
    (lambda: scalar.extraction_scope(F.lit("faculty"), F.lit("pdf")), "pdf_pending"),
    (lambda: scalar.confidence_text(F.lit(0.456)), "0.46"),
    (lambda: scalar.child_id(F.lit("p" * 110), F.lit("long topic name of many words")), ("p" * 110 + ":long-topic-name-")[:120]),
    (lambda: lines.excerpt(F.lit("a" * 70 + " word " + "b" * 70), F.lit("word"), 5), "…aaaa word bbbb…"),
]


@pytest.mark.parametrize("i", range(len(CASES)))
def test_scalars(spark, i):
    make, want = CASES[i]
    assert one(spark, make()) == want


def test_upsert_and_reconcile(spark):
    old = spark.createDataFrame([(1, None, "a"), (1, 2, "b"), (2, 1, "c")], "d int, k int, v string")
    new = spark.createDataFrame([(1, None, "x"), (1, 3, "y")], "d int, k int, v string")
    assert sorted(keyed.upsert(old, new, ["d", "k"]).collect(), key=str) == sorted([(1, None, "x"), (1, 3, "y"), (1, 2, "b"), (2, 1, "c")], key=str)
    assert {tuple(r) for r in keyed.reconcile(old, spark.createDataFrame([(1, 3, "y")], old.schema), "d", ["k"]).collect()} == {(1, 3, "y"), (2, 1, "c")}
    with pytest.raises(Exception, match="no fresh rows"):
        keyed.reconcile(old, spark.createDataFrame([(2, None, None)], old.schema), "d", ["k"]).collect()
    with pytest.raises(ValueError):
        keyed.require_no_duplicates(old, [F.col("d")])


def test_readers(spark, tmp_path):
    (tmp_path / "c.csv").write_text('Filename , label,text_for_embed,storage_index\na.pdf,"Fig ""1""",text,2\nb.pdf,,x,\nc.pdf,l,t,zz\n')
    got = [tuple(r) for r in readers.captions(spark, str(tmp_path / "c.csv")).collect()]
    assert got == [("a.pdf", 'Fig "1"', "text", 2, True), ("b.pdf", None, "x", None, False), ("c.pdf", "l", "t", None, True)]
    (tmp_path / "bad.csv").write_text("filename,label\na,b\n")
    with pytest.raises(ValueError):
        readers.captions(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "t.json").write_text('{"domains": [{"code": "PC", "name": "Care", "competencies": ["first", "second"]}]}')
    assert [r.stable_id for r in readers.taxonomy(spark, str(tmp_path / "t.json")).collect()] == ["aamc:pc1", "aamc:pc2"]
    sheet = spark.createDataFrame([(0, ["x"]), (1, ["ID", "Keyword"]), (2, ["K1", "heart", "d2", None]), (3, ["k2", "", "x", "y"]), (4, ["Z1", "no"])], "row_no int, cells array<string>")
    assert [tuple(r) for r in readers.keywords(sheet).collect()] == [("K1", "heart", "d2", "aamc-kw:K1")]
    cache = spark.createDataFrame([(0, '{"id":"a","model":"m","dims":2,"vector":[1,2]}'), (1, "broken"), (2, '{"id":"a","model":"m","dims":2,"vector":[3,4]}')], "line_no int, value string")
    assert [tuple(r) for r in readers.embedding_cache(cache, "m", 2).collect()] == [("a", [1.0, 2.0])]
    assert readers.purge_cache(cache, "a").count() == 1
    df = spark.range(5)
    assert readers.snapshot({"r": df}, str(tmp_path / "v1")) == {"r": 5} and readers.restore(spark, str(tmp_path / "v1"), {"r": "id bigint"})["r"].count() == 5
    rows = exports.csv_rows(spark.createDataFrame([(2, "=x"), (1, "a,b")], "n int, t string"), "Note", ["n", "t"], ["n"])
    assert [r.line for r in rows.orderBy("line_no").collect()] == ['"# Note"', "n,t", '"1","a,b"', '"2","\'=x"']


def test_scored_json(spark):
    df = spark.createDataFrame([('{"alignments":[{"id":"a","confidence":0.7}]}',), ("oops",)], "j string").select(F.size(vectors.parse_scored(F.col("j"))).alias("n"))
    assert [r.n for r in df.collect()] == [1, 0]


def test_throttle(spark, sf, tmp_path):
    assert streams.throttle([0, 1, 2], 3, 10)[0] == [True] * 3
    assert streams.throttle([0, 1, 2, 11, 12], 2, 10)[0] == [True, True, False, True, True]
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf}/events.parque[t]")
    out = str(tmp_path / "out")
    streams.run_available(streams.throttle_stream(stream, "user_id", "ts", "event_id", 3, 86400.0), str(tmp_path / "c"), lambda df, n: df.write.mode("append").parquet(out))
    batch = streams.throttle_batch(spark.read.parquet(f"{sf}/events.parquet"), "user_id", "ts", "event_id", 3, 86400.0)
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, batch.collect()))


def test_transitions(spark):
    df = spark.createDataFrame([(1, 1, "queued"), (1, 2, "running"), (1, 3, "queued"), (1, 4, "complete"), (2, 1, "running")], "job int, n int, state string")
    steps = {"": ("queued",), "queued": ("running",), "running": ("complete", "failed")}
    assert [(r.job, r.n) for r in streams.legal_transitions(df, "job", "state", ["n"], steps).orderBy("job", "n").collect()] == [(1, 1), (1, 2)]
