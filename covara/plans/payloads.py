"""Queries of composed answers: the map of each course, the exports with their options, the audit's issues, a capped list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covara.functions import coverage as cov
from covara.operators import keyed as k
from covara.operators import payloads as p
from covara.operators import rollups as r
from covara.operators import screens as s
from covara.plans.course import _ROWS, _catalog, _topic_rows
from covara.plans.coverage import _OBJECTIVE, _PAYLOAD, _objectives
from covara.plans.items import _ITEMS, _items
from covara.plans.registered import query
from covara.sources import exports
from covara.sources import views as v
from covara.sources.scratch import copied

_PAD = lambda *c: " || '/' || ".join(f"lpad(cast({x} AS varchar), 12, '0')" for x in c)
_CHUNK = _PAD("document_id", "chunk_index")
_TITLE = "CASE WHEN case_number % 2 = 0 THEN 'Case ' || case_number END"


@query(f"""WITH {_ITEMS}, doc AS (SELECT document_id, course_id, case_number, {_TITLE} AS case_title FROM document),
media AS (SELECT l_orderkey AS document_id, l_linenumber AS chunk_index, l_suppkey AS id, s_name AS label, CASE WHEN l_orderkey % 3 = 0 AND s_nationkey < 9 THEN 'official' WHEN l_quantity > 9 THEN 'mined' END AS text, l_quantity > 25 AS has_file FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
tag AS (SELECT l_orderkey AS document_id, l_linenumber AS chunk_index, p_type AS keyword, CASE WHEN bool_and(p_size > 25) THEN min(p_brand) END AS definition FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type <> 'PROMO' GROUP BY ALL),
entry AS (
SELECT course_id, 'documents' AS part, {_PAD('document_id')} AS key, to_json({{'id': document_id, 'case_number': case_number, 'case_title': case_title}}) AS line FROM doc
UNION ALL SELECT course_id, 'chunks', {_CHUNK}, to_json({{'document_id': document_id, 'chunk_index': chunk_index, 'section': 'Part ' || chunk_index, 'case_number': case_number, 'case_title': case_title}}) FROM (SELECT DISTINCT document_id, chunk_index FROM link) JOIN doc USING (document_id)
UNION ALL SELECT course_id, 'alignments', {_PAD('document_id', 'chunk_index', 'framework_id')}, to_json({{'document_id': document_id, 'chunk_index': chunk_index, 'framework_id': framework_id, 'confidence': cast(confidence AS varchar), 'status': status}}) FROM live JOIN doc USING (document_id)
UNION ALL SELECT course_id, 'media', {_CHUNK}, to_json({{'document_id': document_id, 'chunk_index': chunk_index, 'assets': list({{'id': id, 'label': label, 'text': text, 'has_file': has_file}} ORDER BY id, label, text NULLS FIRST, has_file)}}) FROM media JOIN doc USING (document_id) GROUP BY course_id, document_id, chunk_index
UNION ALL SELECT course_id, 'keywords', {_CHUNK}, to_json({{'document_id': document_id, 'chunk_index': chunk_index, 'keywords': list({{'keyword': keyword, 'definition': definition}} ORDER BY keyword)}}) FROM tag JOIN doc USING (document_id) GROUP BY course_id, document_id, chunk_index
UNION ALL SELECT course_id, 'objectives', {_PAD('document_id')}, to_json({{'document_id': document_id, 'objectives': list({{'code': CASE WHEN coded THEN 'EO-' || ordinal END, 'text': text}} ORDER BY ordinal, CASE WHEN coded THEN 'EO-' || ordinal END NULLS FIRST, text)}}) FROM item JOIN doc USING (document_id) GROUP BY course_id, document_id
UNION ALL SELECT NULL, 'aamc', cast(stable_id AS varchar), to_json({{'stable_id': stable_id, 'sub_id': CASE WHEN stable_id % 2 = 0 THEN 'C' || stable_id END, 'domain': system, 'description': subdomain}}) FROM topic WHERE framework = 'AAMC'
UNION ALL SELECT NULL, 'usmle', cast(stable_id AS varchar), to_json({{'stable_id': stable_id, 'domain': system, 'subdomain': subdomain}}) FROM topic WHERE framework = 'USMLE')
SELECT course_id, part, key, md5(line) AS line_md5 FROM entry""")
def map_payload(spark: SparkSession, d: str) -> DataFrame:
    """The whole map of each course: documents, chunks, links, media with official captions, keywords, objectives and both catalogs. Lines of orders stand for chunks, suppliers for media."""
    documents = v.documents(spark, d).select("document_id", "course_id", "case_number", F.when(F.col("case_number") % 2 == 0, F.concat(F.lit("Case "), "case_number")).alias("case_title"))
    chunks = v.links(spark, d).select("document_id", "chunk_index").repartition("document_id").distinct().withColumn("section", F.concat(F.lit("Part "), "chunk_index"))
    # suppliers are few and meet lines after the shuffle, so their names are not shuffled
    lines = v.table(spark, d, "lineitem").selectExpr("l_orderkey document_id", "l_linenumber chunk_index", "l_suppkey", "l_quantity > 9 mined", "l_quantity > 25 has_file")
    suppliers = copied(v.table(spark, d, "supplier").selectExpr("s_suppkey l_suppkey", "s_name label", "s_nationkey"))
    media = lines.repartition("document_id").join(suppliers, "l_suppkey").selectExpr("document_id", "chunk_index", "l_suppkey asset_id", "label", "if(mined, 'mined', null) text", "if(has_file, 'x.png', '') path", "s_nationkey")
    captions = media.filter("document_id % 3 = 0 and s_nationkey < 9").select("document_id", "label", F.lit("official").alias("text")).distinct()
    parts = v.table(spark, d, "part").selectExpr("p_partkey l_partkey", "nullif(p_type, 'PROMO') keyword", "if(p_size > 25, p_brand, null) definition")
    tags = v.table(spark, d, "lineitem").selectExpr("l_orderkey document_id", "l_linenumber chunk_index", "l_partkey").join(parts, "l_partkey").select("document_id", "chunk_index", F.col("chunk_index").alias("place"), "keyword", "definition")
    goals = _items(spark, d).selectExpr("document_id", "ordinal", "if(coded, concat('EO-', ordinal), null) code", "text")
    topics = v.topics(spark, d)
    found = p.map_payload(documents, chunks, v.live_links(spark, d), media.drop("s_nationkey"), captions, tags, goals, _competencies(topics), topics.filter("framework = 'USMLE'"))
    return found.select("course_id", "part", "key", F.md5("line").alias("line_md5"))


def _competencies(topics: DataFrame) -> DataFrame:
    return topics.filter("framework = 'AAMC'").selectExpr("stable_id", "if(stable_id % 2 = 0, concat('C', stable_id), null) sub_id", "system domain", "subdomain description")


_ORDER = "course_code, case_number, ordinal, objective_id"


@query(f"""WITH {_OBJECTIVE}, named AS (SELECT objective.*, CASE WHEN course_id % 4 <> 0 THEN module END AS listed FROM objective),
chosen AS (SELECT 'course 3' AS options, * FROM named WHERE course_id = 3 UNION ALL SELECT 'ASIA', * FROM named WHERE listed = 'ASIA' UNION ALL SELECT 'Unassigned', * FROM named WHERE listed IS NULL UNION ALL SELECT 'ASIA, course 8', * FROM named WHERE listed = 'ASIA' AND course_id = 8 UNION ALL SELECT 'all', * FROM named)
SELECT options, row_number() OVER (PARTITION BY options ORDER BY {_ORDER}) - 1 AS line_no, course_code, case_number, ordinal, objective_id FROM chosen""")
def objectives_export(spark: SparkSession, d: str) -> DataFrame:
    """Exports of objectives by course and by module, each numbered in its order; every fourth course belongs to no module."""
    rows = _objectives(spark, d)
    modules = v.courses(spark, d).filter("course_id % 4 <> 0").select("course_id", "module")
    found = None
    for name, options in (("course 3", {"course": 3}), ("ASIA", {"module": "ASIA"}), ("Unassigned", {"module": "Unassigned"}), ("ASIA, course 8", {"module": "ASIA", "course": 8}), ("all", {})):
        one = p.objectives_export(rows, modules, **options).select(F.lit(name).alias("options"), "line_no", "course_code", "case_number", "ordinal", "objective_id")
        found = one if found is None else found.unionByName(one)
    return found


@query("""WITH cov AS (SELECT framework, framework_id, count(DISTINCT document_id) AS docs, count(DISTINCT course_id) AS courses FROM fact GROUP BY ALL)
SELECT 'USMLE' AS framework, topic.system, topic.system || ' — ' || subdomain AS topic, coalesce(docs, 0) AS docs, coalesce(courses, 0) AS courses FROM topic LEFT JOIN cov ON framework_id = stable_id AND cov.framework = 'USMLE' WHERE topic.framework = 'USMLE'
UNION ALL SELECT 'AAMC', topic.system, coalesce(CASE WHEN stable_id % 2 = 0 THEN 'C' || stable_id END, cast(stable_id AS varchar)) || ': ' || subdomain, coalesce(docs, 0), coalesce(courses, 0) FROM topic LEFT JOIN cov ON framework_id = stable_id AND cov.framework = 'AAMC' WHERE topic.framework = 'AAMC'""")
def program_exports(spark: SparkSession, d: str) -> DataFrame:
    """The export of the program over both catalogs, each with labels of its own."""
    topics = v.topics(spark, d)
    return p.program_export(v.facts(spark, d), topics.filter("framework = 'USMLE'"), _competencies(topics))


@query("""WITH n AS (SELECT l_orderkey AS document_id, count(*) AS chunks, count(*) FILTER (l_quantity > 5) AS e, count(*) FILTER (l_quantity > 10) AS a FROM lineitem GROUP BY ALL), status AS (SELECT document_id, CASE WHEN coalesce(chunks, 0) = 0 THEN 'empty' WHEN e < chunks THEN 'partial-embed' WHEN a < chunks THEN 'partial-align' ELSE 'complete' END AS state FROM document LEFT JOIN n USING (document_id)),
declared AS (SELECT 'label ' || label AS name, max(vec_id) + 1 AS declared, count(embedding) AS counted FROM embeddings GROUP BY ALL)
SELECT 'total' AS kind, CASE WHEN starts_with(state, 'partial') THEN 'partial' ELSE state END AS name, cast(count(*) AS varchar) AS detail FROM status GROUP BY ALL
UNION ALL SELECT 'partial', cast(document_id AS varchar), state FROM status WHERE starts_with(state, 'partial')
UNION ALL SELECT 'mismatch', name, counted || ' of ' || declared FROM declared WHERE declared <> counted""")
def audit_issues(spark: SparkSession, d: str) -> DataFrame:
    """Documents by state, the list of partial ones, and kinds of vectors whose declared number is not the counted one."""
    chunks = v.table(spark, d, "lineitem").selectExpr("l_orderkey document_id", "l_quantity > 5 embedded", "l_quantity > 10 aligned")
    declared = v.table(spark, d, "embeddings").groupBy(F.concat(F.lit("label "), "label").alias("name")).agg((F.max("vec_id") + 1).alias("declared"), F.count("embedding").alias("counted"))
    return p.audit_issues(k.pipeline_status(v.documents(spark, d), chunks), declared)


@query("SELECT s_suppkey, s_name, (SELECT count(*) > 1 FROM supplier) AS refused_at_one FROM supplier")
def capped_rows(spark: SparkSession, d: str) -> DataFrame:
    """All suppliers, as they are no more than a cap allows, and whether a cap of one is refused as a whole."""
    rows = v.table(spark, d, "supplier").select("s_suppkey", "s_name")
    try:
        refused = s.require_at_most(rows, 1) is None
    except ValueError:
        refused = True
    return s.require_at_most(rows, 10_000_000).withColumn("refused_at_one", F.lit(refused))


@query("""WITH t AS (SELECT framework, count(*) AS n FROM topic GROUP BY ALL), l AS (SELECT framework, row_number() OVER (PARTITION BY framework ORDER BY system, subdomain, stable_id) AS line_no, '{"system":"' || system || '","subdomain":"' || subdomain || '","stable_id":' || stable_id || '}' AS line FROM topic)
SELECT framework, 0 AS line_no, '{"method":"counts","summary":{"topics":' || n || '},"topics":[' AS line FROM t UNION ALL SELECT framework, line_no, line || CASE WHEN line_no < n THEN ',' ELSE '' END FROM l JOIN t USING (framework) UNION ALL SELECT framework, n + 1, ']}' FROM t""")
def json_lines(spark: SparkSession, d: str) -> DataFrame:
    """One JSON document for each framework as lines that no task holds together."""
    found = None
    for name in ("AAMC", "USMLE"):
        rows = v.topics(spark, d).filter(F.col("framework") == name)
        one = exports.json_lines(rows, ["system", "subdomain", "stable_id"], ["system", "subdomain", "stable_id"], "topics", rows.agg(F.count("*").alias("topics")), method="counts").select(F.lit(name).alias("framework"), "line_no", "line")
        found = one if found is None else found.unionByName(one)
    return found


@query("SELECT 'csv' AS sheet, line_no, md5(line) AS line_md5 FROM (SELECT row_number() OVER (ORDER BY doc_id) + 1 AS line_no, '\"' || doc_id || '\",\"' || coalesce(lang, '') || '\"' AS line FROM documents UNION ALL SELECT 0, '\"# Languages\"' UNION ALL SELECT 1, 'doc_id,lang')")
def csv_lines(spark: SparkSession, d: str) -> DataFrame:
    """An export whose lines are numbered from 0 without gaps."""
    rows = exports.csv_rows(v.table(spark, d, "documents").select("doc_id", "lang"), "Languages", ["doc_id", "lang"], ["doc_id"])
    return rows.select(F.lit("csv").alias("sheet"), "line_no", F.md5("line").alias("line_md5"))


@query(f"""WITH {_PAYLOAD}, line AS (SELECT course_id, 'distributions' AS part, [framework] AS o, framework || ':' || addressed || '/' || total AS line FROM dist
UNION ALL SELECT course_id, 'heatmap', [lpad(cast(case_number AS varchar), 9, '0'), system], case_number || ':' || system || ':' || CASE WHEN coalesce(total, 0) = 0 THEN 'gap' WHEN touched * 1.0 / total >= 0.5 THEN 'covered' ELSE 'partial' END FROM touched LEFT JOIN totals USING (course_id, system)
UNION ALL SELECT course_id, 'recent', [lpad(cast(n AS varchar), 9, '0')], document_id || ':' || framework_id FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY created_at DESC, document_id, chunk_index, framework_id) AS n FROM live JOIN document USING (document_id)) WHERE n <= 10
UNION ALL SELECT course_id, 'percents', [system], system || ':' || cast(floor(covered * 100.0 / total + 0.5) AS bigint) FROM p)
SELECT course_id, part, row_number() OVER (PARTITION BY course_id, part ORDER BY o) - 1 AS place, line FROM line""")
def course_payload_lines(spark: SparkSession, d: str) -> DataFrame:
    """Distributions, heatmap, recent links and percents of every course as numbered lines."""
    rows, catalog = _topic_rows(spark, d), _catalog(spark, d)
    sizes = catalog.groupBy("course_id", "framework").agg(F.count("*").alias("total"))
    dist = r.distribution_by(rows.join(sizes, ["course_id", "framework"]), "course_id", "framework")
    facts = v.facts(spark, d)
    touched = facts.select("course_id", "case_number", "system", "framework_id").distinct().groupBy("course_id", "case_number", "system").agg(F.count("*").alias("touched"))
    links = v.live_links(spark, d).join(v.documents(spark, d), "document_id")
    recent = r.top_per_group(links, ["course_id"], [F.desc("created_at"), "document_id", "chunk_index", "framework_id"], 10)
    return p.course_payload(dist, r.case_heatmap(touched, r.scoped_totals(catalog)), recent, r.domain_percent(facts, catalog))


@query(f"WITH {_ROWS} SELECT course_id, row_number() OVER (PARTITION BY course_id ORDER BY framework, system, topic, stable_id) - 1 AS line_no, system || '|' || topic || '|' || docs || '|' || {cov.LEVEL_SQL} AS line FROM rows")
def course_export_lines(spark: SparkSession, d: str) -> DataFrame:
    """The export of each course as numbered lines."""
    return p.course_export(_topic_rows(spark, d))
