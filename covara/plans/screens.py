"""Queries of whole screens: summaries of courses and systems, nested keywords and items, runs and paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covara.operators import rollups as r
from covara.operators import screens as s
from covara.plans.course import _ROWS, _topic_rows
from covara.plans.items import _ITEMS, _items
from covara.plans.registered import query
from covara.plans.texts import _LINES, _lines
from covara.sources import views as v

_SUMMARY = f"{_ROWS}, per AS (SELECT course_id, count(*) AS documents FROM document GROUP BY ALL), stats AS (SELECT course_id, count(*) AS total, count(*) FILTER (status IN ('approved', 'rejected')) AS reviewed, round(avg(cast(confidence AS double)), 9) AS average_confidence FROM live JOIN document USING (document_id) GROUP BY ALL), t AS (SELECT course_id, count(*) AS topics, count(*) FILTER (docs > 0) AS addressed FROM rows GROUP BY ALL), summary AS (SELECT course_id, code, module, coalesce(documents, 0) AS documents, coalesce(total, 0) AS total, coalesce(reviewed, 0) AS reviewed, average_confidence, coalesce(topics, 0) AS topics, coalesce(addressed, 0) AS addressed, coalesce(cast(floor(addressed * 100.0 / topics + 0.5) AS bigint), 0) AS percent FROM course LEFT JOIN per USING (course_id) LEFT JOIN stats USING (course_id) LEFT JOIN t USING (course_id))"


def _summary(spark: SparkSession, d: str) -> DataFrame:
    links = v.live_links(spark, d).join(v.documents(spark, d), "document_id")
    return s.course_summary(v.courses(spark, d), v.documents(spark, d), links, _topic_rows(spark, d))


@query(f"WITH {_SUMMARY} SELECT * FROM summary")
def course_summary(spark: SparkSession, d: str) -> DataFrame:
    return _summary(spark, d)


@query(f"WITH {_SUMMARY} SELECT course_id, documents, total, addressed, CASE WHEN total > 0 THEN 'ready' WHEN documents > 0 THEN 'pending' ELSE 'empty' END AS state FROM summary")
def landing_stats(spark: SparkSession, d: str) -> DataFrame:
    return s.landing_state(_summary(spark, d)).select("course_id", "documents", "total", "addressed", "state")


@query("WITH docs AS (SELECT system, framework_id, count(DISTINCT document_id) AS docs FROM fact GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY system ORDER BY docs DESC, framework_id) AS n FROM docs) SELECT system, topics, coalesce(addressed, 0) AS addressed, coalesce(courses, 0) AS courses, framework_id AS best_topic, coalesce(docs, 0) AS best_docs FROM (SELECT system, count(*) AS topics FROM topic GROUP BY ALL) LEFT JOIN (SELECT system, count(*) AS addressed FROM docs GROUP BY ALL) USING (system) LEFT JOIN (SELECT system, count(DISTINCT course_id) AS courses FROM fact GROUP BY ALL) USING (system) LEFT JOIN (SELECT * FROM ranked WHERE n = 1) USING (system)")
def program_systems(spark: SparkSession, d: str) -> DataFrame:
    return s.system_summary(v.facts(spark, d), v.topics(spark, d))


@query("WITH tag AS (SELECT l_orderkey AS document_id, l_linenumber AS place, nullif(p_type, 'PROMO') AS keyword, CASE WHEN p_size > 25 THEN p_brand END AS definition FROM lineitem JOIN part ON l_partkey = p_partkey), first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id, keyword ORDER BY place, definition NULLS FIRST) AS n FROM tag WHERE keyword IS NOT NULL) WHERE n = 1) SELECT document_id, count(*) AS n, string_agg(keyword || '=' || coalesce(definition, '?'), ',' ORDER BY keyword) AS keywords FROM first GROUP BY ALL")
def keyword_groups(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of every document; the first line that names one defines it."""
    rows = v.table(spark, d, "lineitem").join(v.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    tags = rows.selectExpr("l_orderkey document_id", "l_linenumber place", "nullif(p_type, 'PROMO') keyword", "if(p_size > 25, p_brand, null) definition")
    shown = F.transform("keywords", lambda x: F.concat(x["keyword"], F.lit("="), F.coalesce(x["definition"], F.lit("?"))))
    return s.keywords_of(tags, "document_id", ["place"]).select("document_id", F.size("keywords").cast("bigint").alias("n"), F.array_join(shown, ",").alias("keywords"))


@query(f"WITH {_ITEMS} SELECT document_id, string_agg(ordinal || '. ' || text, chr(10) ORDER BY ordinal, text) AS items FROM item GROUP BY ALL")
def objectives_nested(spark: SparkSession, d: str) -> DataFrame:
    shown = F.transform("items", lambda x: F.concat(x["ordinal"].cast("string"), F.lit(". "), x["text"]))
    return s.items_of(_items(spark, d), "document_id", ["ordinal"], "text").select("document_id", F.array_join(shown, "\n").alias("items"))


@query(f"WITH {_ITEMS} SELECT code, case_number, document_id, ordinal, text, method, item.confidence, cast(row_number() OVER (PARTITION BY code ORDER BY case_number, document_id, ordinal, text, method NULLS FIRST, item.confidence) AS integer) AS rank FROM item JOIN document USING (document_id) JOIN course USING (course_id)")
def objective_rows(spark: SparkSession, d: str) -> DataFrame:
    """Items of all courses with their place in the export of their course."""
    rows = _items(spark, d).join(v.documents(spark, d), "document_id").join(v.courses(spark, d), "course_id")
    ranked = r.ranked_in_ranges(rows.withColumn("part", F.floor(F.col("document_id") / 4096)), ["code"], ["case_number", "part"], ["document_id", "ordinal", "text", "method", "confidence"])
    return ranked.select("code", "case_number", "document_id", "ordinal", "text", "method", "confidence", "rank")


@query(f"WITH {_ITEMS}, chunks AS (SELECT document_id, count(DISTINCT chunk_index) AS chunks, count(DISTINCT framework_id) AS topics FROM fact GROUP BY ALL), counts AS (SELECT document_id, count(*) AS items FROM item GROUP BY ALL) SELECT document.*, coalesce(chunks, 0) AS chunks, coalesce(topics, 0) AS topics, coalesce(items, 0) AS items FROM document LEFT JOIN chunks USING (document_id) LEFT JOIN counts USING (document_id)")
def map_documents(spark: SparkSession, d: str) -> DataFrame:
    return s.map_documents(v.documents(spark, d), v.facts(spark, d), _items(spark, d))


@query(f"WITH {_LINES}, sized AS (SELECT doc_id, line_no, CASE WHEN length(line) < 120 THEN line END AS line FROM line) SELECT doc_id, cast(line_no AS integer) AS line_no, md5(coalesce(lag(line, 3) OVER w, lag(line, 2) OVER w, lag(line, 1) OVER w)) AS context_md5 FROM sized WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)")
def preceding_context(spark: SparkSession, d: str) -> DataFrame:
    """For every line the first short one of the three before it, as a digest."""
    return s.context_before(_lines(spark, d), "doc_id").select("doc_id", F.col("line_no").cast("int").alias("line_no"), F.md5("context").alias("context_md5"))


@query("SELECT document_id, course_id FROM document WHERE NOT EXISTS (SELECT 1 FROM live WHERE live.document_id = document.document_id AND status IS NOT NULL)")
def unprocessed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents without a link of known state."""
    return s.unprocessed(v.documents(spark, d), v.live_links(spark, d).filter("status is not null"), "document_id").select("document_id", "course_id")


_ERROR = "CASE WHEN text IS NULL THEN 'no text' WHEN length(trim(text)) = 0 THEN 'empty' WHEN n_chars < 200 THEN 'short' WHEN lang IS NULL THEN 'no language' END"


@query(f"SELECT source, count(*) AS attempted, count(*) FILTER (error IS NULL) AS succeeded, count(error) AS failed, coalesce(string_agg(DISTINCT error, ', ' ORDER BY error), '') AS errors, count(error) > 0 AS must_fail FROM (SELECT source, {_ERROR} AS error FROM documents) GROUP BY ALL")
def ingestion_summary(spark: SparkSession, d: str) -> DataFrame:
    """What a run over the documents of each source reports."""
    return s.run_summary(v.table(spark, d, "documents").select("source", F.expr(_ERROR).alias("error")), "source")


@query(r"WITH asset AS (SELECT p_partkey AS asset_id, CASE p_size % 4 WHEN 0 THEN '/srv/media/' || p_partkey || '/' || p_type || '/' || p_size || '.png' WHEN 1 THEN p_partkey || '/' || p_type || '/' || p_size || '.png' WHEN 2 THEN p_name END AS path FROM part), found AS (SELECT *, nullif(regexp_extract(path, '(?:^|/)(\d+/[^/]+/\d+\.[A-Za-z0-9]+)$', 1), '') AS key FROM asset) SELECT asset_id, coalesce(key, path) AS path, CASE WHEN path IS NULL THEN 'missing' WHEN key IS NULL THEN 'unrecognised' WHEN key = path THEN 'unchanged' ELSE 'rewritten' END AS outcome FROM found")
def path_backfill(spark: SparkSession, d: str) -> DataFrame:
    path = "case p_size % 4 when 0 then concat('/srv/media/', p_partkey, '/', p_type, '/', p_size, '.png') when 1 then concat(p_partkey, '/', p_type, '/', p_size, '.png') when 2 then p_name end path"
    return s.backfilled(v.table(spark, d, "part").selectExpr("p_partkey asset_id", path), "path")


@query("SELECT outcome, count(*) AS n FROM (SELECT CASE p_size % 4 WHEN 0 THEN 'rewritten' WHEN 1 THEN 'unchanged' WHEN 2 THEN 'unrecognised' ELSE 'missing' END AS outcome FROM part) GROUP BY ALL")
def path_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """How many paths a backfill rewrote, left or did not know."""
    path = "case p_size % 4 when 0 then concat('/srv/media/', p_partkey, '/', p_type, '/', p_size, '.png') when 1 then concat(p_partkey, '/', p_type, '/', p_size, '.png') when 2 then p_name end path"
    return s.backfilled(v.table(spark, d, "part").selectExpr("p_partkey asset_id", path), "path").groupBy("outcome").agg(F.count("*").alias("n"))


@query("WITH l AS (SELECT DISTINCT document_id, chunk_index, framework_id FROM live) SELECT 'chunk' AS side, framework_id AS id, NULL AS chunk_index FROM l WHERE chunk_index = 2 GROUP BY ALL UNION ALL SELECT 'topic', document_id, chunk_index FROM l JOIN topic ON framework_id = stable_id WHERE system = 'Brand#7' GROUP BY ALL UNION ALL SELECT 'overview', framework_id, NULL FROM l GROUP BY ALL")
def linked_sides(spark: SparkSession, d: str) -> DataFrame:
    """Topics of second chunks, chunks of one system's topics, and all linked topics."""
    links = v.live_links(spark, d).join(v.topics(spark, d).selectExpr("stable_id framework_id", "system"), "framework_id")
    chunks = links.select(F.struct("document_id", "chunk_index").alias("chunk"), "framework_id", "system")
    sides = (("chunk", s.linked_side(chunks, "framework_id", F.col("chunk.chunk_index") == 2)), ("topic", s.linked_side(chunks, "chunk", F.col("system") == "Brand#7")), ("overview", s.linked_side(chunks, "framework_id")))
    shape = lambda name, rows: rows.select(F.lit(name).alias("side"), *((F.col("chunk.document_id").alias("id"), F.col("chunk.chunk_index").alias("chunk_index")) if name == "topic" else (F.col("framework_id").alias("id"), F.lit(None).cast("int").alias("chunk_index"))))
    found = [shape(*x) for x in sides]
    return found[0].unionByName(found[1]).unionByName(found[2])
