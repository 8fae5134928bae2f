"""Course and program queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covara.functions.coverage import DISTRIBUTION_SQL, LEVEL_SQL, level_of
from covara.functions.scalar import topic_label
from covara.operators import rollups as r
from covara.plans.registered import query
from covara.sources import views as v

_CATALOG = "catalog AS (SELECT course_id, topic.* FROM scope JOIN topic USING (system) UNION ALL SELECT course_id, topic.* FROM course, topic WHERE course_id NOT IN (SELECT course_id FROM scope))"
_ROWS = f"{_CATALOG}, counts AS (SELECT course_id, framework_id, count(DISTINCT document_id) AS docs FROM fact GROUP BY ALL), rows AS (SELECT catalog.*, coalesce(docs, 0) AS docs, system || ' — ' || subdomain AS topic FROM catalog LEFT JOIN counts ON catalog.course_id = counts.course_id AND stable_id = framework_id)"


def _catalog(spark: SparkSession, d: str) -> DataFrame:
    return r.catalog_of_courses(v.topics(spark, d), v.courses(spark, d), v.scopes(spark, d))


def _topic_rows(spark: SparkSession, d: str) -> DataFrame:
    return r.course_topic_rows(v.facts(spark, d), _catalog(spark, d))


@query(f"WITH {_ROWS} SELECT course_id, stable_id, system, subdomain, framework, topic, docs, {LEVEL_SQL} AS level FROM rows")
def course_gap_rows(spark: SparkSession, d: str) -> DataFrame:
    return _topic_rows(spark, d).select("course_id", "stable_id", "system", "subdomain", "framework", "topic", "docs", "level")


@query(f"WITH {_ROWS} SELECT course_id, {LEVEL_SQL} AS level, count(*) AS topics FROM rows GROUP BY ALL")
def level_counts(spark: SparkSession, d: str) -> DataFrame:
    return _topic_rows(spark, d).groupBy("course_id", "level").agg(F.count("*").alias("topics"))


@query(f"WITH {_ROWS}, sized AS (SELECT *, count(*) OVER (PARTITION BY course_id, framework) AS total FROM rows) SELECT course_id, framework, {DISTRIBUTION_SQL} FROM sized GROUP BY ALL")
def distribution_by_course(spark: SparkSession, d: str) -> DataFrame:
    sizes = _catalog(spark, d).groupBy("course_id", "framework").agg(F.count("*").alias("total"))
    return r.distribution_by(_topic_rows(spark, d).join(sizes, ["course_id", "framework"]), "course_id", "framework")


@query(f"WITH {_CATALOG}, hit AS (SELECT DISTINCT course_id, framework_id FROM fact) SELECT catalog.course_id, system, count(framework_id) AS covered, count(*) AS total, cast(floor(count(framework_id) * 100.0 / count(*) + 0.5) AS bigint) AS percent FROM catalog LEFT JOIN hit ON catalog.course_id = hit.course_id AND stable_id = framework_id GROUP BY ALL")
def domain_percent(spark: SparkSession, d: str) -> DataFrame:
    return r.domain_percent(v.facts(spark, d), _catalog(spark, d))


_CELLS = "totals AS (SELECT system, count(*) AS total FROM topic GROUP BY ALL), touched AS (SELECT course_id, case_number, system, count(DISTINCT framework_id) AS touched FROM fact GROUP BY ALL), cells AS (SELECT course_id, case_number, system, touched, total, CASE WHEN touched * 1.0 / total >= 0.5 THEN 'covered' ELSE 'partial' END AS status FROM touched JOIN totals USING (system))"


def _cells(spark: SparkSession, d: str) -> DataFrame:
    return r.heatmap(v.facts(spark, d), v.topics(spark, d).groupBy("system").agg(F.count("*").alias("total")), "course_id")


@query(f"WITH {_CELLS} SELECT * FROM cells")
def heatmap_cells(spark: SparkSession, d: str) -> DataFrame:
    return _cells(spark, d)


@query(f"WITH {_CELLS}, grid AS (SELECT DISTINCT c.course_id, c.case_number, t.system FROM cells c, totals t) SELECT course_id, case_number, system, coalesce(status, 'gap') AS status FROM grid LEFT JOIN cells USING (course_id, case_number, system)")
def heatmap_dense(spark: SparkSession, d: str) -> DataFrame:
    return r.dense_heatmap(_cells(spark, d), v.topics(spark, d))


@query(f"WITH docs AS (SELECT system, framework_id, count(DISTINCT document_id) AS docs FROM fact GROUP BY ALL), totals AS (SELECT system, count(*) AS total FROM topic GROUP BY ALL), rows AS (SELECT totals.system, total, coalesce(docs, 0) AS docs FROM totals LEFT JOIN docs USING (system)) SELECT system, {DISTRIBUTION_SQL} FROM rows GROUP BY ALL")
def system_distribution(spark: SparkSession, d: str) -> DataFrame:
    return r.system_distribution(v.facts(spark, d), v.topics(spark, d))


@query(f"WITH spread AS (SELECT framework, unnest(['Entire curriculum', module]) AS scope, framework_id, document_id FROM fact), docs AS (SELECT framework, scope, framework_id, count(DISTINCT document_id) AS docs FROM spread GROUP BY ALL), totals AS (SELECT framework, count(*) AS total FROM topic GROUP BY ALL), rows AS (SELECT * FROM docs JOIN totals USING (framework)) SELECT framework, scope, {DISTRIBUTION_SQL} FROM rows GROUP BY ALL")
def scope_distribution(spark: SparkSession, d: str) -> DataFrame:
    return r.scope_distribution(v.distinct_facts(spark, d, "document_id", "framework_id"), v.topics(spark, d).groupBy("framework").agg(F.count("*").alias("total")))


_PROGRAM = "program AS (SELECT framework, framework_id, count(DISTINCT document_id) AS docs, count(DISTINCT (document_id, chunk_index)) AS chunks, count(DISTINCT course_id) AS courses FROM fact GROUP BY ALL)"


def _linked_chunks(spark: SparkSession, d: str) -> DataFrame:
    return v.distinct_facts(spark, d, "document_id", "chunk_index", "framework_id", counted="chunk_index")


@query(f"WITH {_PROGRAM} SELECT framework, framework_id, docs, chunks FROM program ORDER BY docs DESC, chunks DESC, framework_id LIMIT 8")
def most_covered(spark: SparkSession, d: str) -> DataFrame:
    return r.program_rows(_linked_chunks(spark, d)).orderBy(F.desc("docs"), F.desc("chunks"), "framework_id").limit(8).select("framework", "framework_id", "docs", "chunks")


@query(f"WITH {_PROGRAM}, best AS (SELECT * FROM program ORDER BY docs DESC, chunks DESC, framework_id LIMIT 8) SELECT fact.framework_id, docs, chunks, string_agg(DISTINCT cast(case_number AS varchar), ',' ORDER BY cast(case_number AS varchar)) AS cases FROM fact JOIN best ON fact.framework_id = best.framework_id GROUP BY ALL".replace("string_agg(DISTINCT cast(case_number AS varchar), ',' ORDER BY cast(case_number AS varchar))", "array_to_string(list_sort(list(DISTINCT case_number)), ',')"))
def learning_spiral(spark: SparkSession, d: str) -> DataFrame:
    return r.learning_spiral(v.facts(spark, d), _linked_chunks(spark, d))


@query(f"WITH {_PROGRAM}, rows AS (SELECT topic.framework, system, system || ' — ' || subdomain AS topic, stable_id, coalesce(docs, 0) AS docs, coalesce(courses, 0) AS courses FROM topic LEFT JOIN program ON stable_id = framework_id) SELECT *, {LEVEL_SQL} AS level FROM rows")
def program_export(spark: SparkSession, d: str) -> DataFrame:
    counts = r.program_rows(_linked_chunks(spark, d)).select(F.col("framework_id").alias("stable_id"), "docs", "courses")
    rows = r.with_gaps(v.topics(spark, d), counts, ["stable_id"])
    return rows.select("framework", "system", topic_label(F.col("system"), F.col("subdomain")).alias("topic"), "stable_id", "docs", "courses", level_of(F.col("docs")).alias("level"))


@query("SELECT course_id, count(*) AS total, count(*) FILTER (status IN ('approved', 'rejected')) AS reviewed, round(avg(cast(confidence AS double)), 9) AS average_confidence FROM live JOIN document USING (document_id) GROUP BY ALL")
def alignment_stats(spark: SparkSession, d: str) -> DataFrame:
    return r.link_statistics(v.live_links(spark, d).join(v.documents(spark, d), "document_id"), "course_id")


@query("SELECT course_id, document_id, chunk_index, framework_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY created_at DESC, document_id, chunk_index, framework_id) AS n FROM live JOIN document USING (document_id)) WHERE n <= 10")
def recent_links(spark: SparkSession, d: str) -> DataFrame:
    rows = v.live_links(spark, d).join(v.documents(spark, d), "document_id")
    return r.top_per_group(rows, ["course_id"], [F.desc("created_at"), "document_id", "chunk_index", "framework_id"], 10).select("course_id", "document_id", "chunk_index", "framework_id", "created_at")


@query("SELECT framework, count(*) AS topics, count(DISTINCT system) AS systems FROM topic GROUP BY ALL")
def catalog_totals(spark: SparkSession, d: str) -> DataFrame:
    return v.topics(spark, d).groupBy("framework").agg(F.count("*").alias("topics"), F.count_distinct("system").alias("systems"))


@query("SELECT course.course_id, code, module, document_id, case_number, guide_kind FROM course JOIN document USING (course_id)")
def course_documents(spark: SparkSession, d: str) -> DataFrame:
    return v.courses(spark, d).join(v.documents(spark, d), "course_id").select("course_id", "code", "module", "document_id", "case_number", "guide_kind")


@query("SELECT (SELECT count(*) FROM course) AS courses, (SELECT count(*) FROM document) AS documents, (SELECT count(*) FROM live) AS links")
def program_counters(spark: SparkSession, d: str) -> DataFrame:
    counts = [df.agg(F.count("*").alias(n)) for n, df in (("courses", v.courses(spark, d)), ("documents", v.documents(spark, d)), ("links", v.live_links(spark, d)))]
    return counts[0].join(counts[1]).join(counts[2])


@query("SELECT DISTINCT module, case_number FROM course JOIN document USING (course_id)")
def value_lists(spark: SparkSession, d: str) -> DataFrame:
    return v.courses(spark, d).join(v.documents(spark, d), "course_id").select("module", "case_number").distinct()


@query(f"WITH {_ROWS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY course_id, framework ORDER BY stable_id) AS n, count(*) OVER (PARTITION BY course_id, framework) AS gaps FROM rows WHERE docs = 0) SELECT course_id, framework, stable_id, topic, greatest(0, gaps - 12) AS hidden FROM ranked WHERE n <= 12")
def gap_cards(spark: SparkSession, d: str) -> DataFrame:
    gaps = _topic_rows(spark, d).filter("level = 'gap'")
    hidden = gaps.groupBy("course_id", "framework").agg(F.greatest(F.lit(0), F.count("*") - 12).alias("hidden"))
    return r.top_per_group(gaps, ["course_id", "framework"], ["stable_id"], 12).join(hidden, ["course_id", "framework"]).select("course_id", "framework", "stable_id", "topic", "hidden")


@query(f"WITH {_ROWS} SELECT course_id, stable_id FROM rows WHERE docs = 0")
def unaddressed_topics(spark: SparkSession, d: str) -> DataFrame:
    """Topics of a course without any live link in it, by an anti join."""
    linked = v.facts(spark, d).select("course_id", F.col("framework_id").alias("stable_id"))
    return _catalog(spark, d).join(linked, ["course_id", "stable_id"], "left_anti").select("course_id", "stable_id")
