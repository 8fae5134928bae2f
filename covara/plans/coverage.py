"""Coverage queries over both catalogs. Parts of over size 45 are off the catalog, so links to them have a label only; suppliers stand for topics taught elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covara.functions import coverage as cov
from covara.operators import items as i
from covara.operators import rollups as r
from covara.operators import screens as s
from covara.plans.cases import lenses, rollup_activities
from covara.plans.course import _CATALOG, _CELLS, _ROWS, _catalog, _topic_rows
from covara.plans.items import _ITEMS, _items
from covara.plans.registered import query
from covara.sources import exports
from covara.sources import views as v

_KIND = "CASE WHEN p_type IN ('PROMO', 'ECONOMY') THEN 'AAMC' ELSE 'USMLE' END"
_LABELLED = f"listed AS (SELECT p_partkey AS stable_id, p_brand AS system FROM part WHERE p_size <= 45), labelled AS (SELECT live.*, p_brand || ' — ' || p_name AS label, {_KIND} AS framework, course_id, case_number FROM live JOIN document USING (document_id) JOIN part ON framework_id = p_partkey)"
_PARTIAL = f"{_LABELLED}, known AS (SELECT stable_id, min(system) AS domain FROM listed GROUP BY ALL), partial AS (SELECT framework, framework_id, course_id, min(label) AS label, coalesce(min(domain), split_part(min(label), ' — ', 1)) AS system, count(DISTINCT document_id) AS docs, count(DISTINCT (document_id, chunk_index)) AS chunks FROM labelled LEFT JOIN known ON framework_id = stable_id GROUP BY ALL)"


def _parts(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("p_type").isin("PROMO", "ECONOMY"), "AAMC").otherwise("USMLE")
    return v.table(spark, d, "part").withColumn("framework", kind)


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return _parts(spark, d).filter("p_size <= 45").selectExpr("p_partkey stable_id", "p_brand system")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    parts = _parts(spark, d).select(F.col("p_partkey").alias("framework_id"), F.concat("p_brand", F.lit(" — "), "p_name").alias("label"), "framework")
    return v.live_links(spark, d).join(v.documents(spark, d), "document_id").join(parts, "framework_id")


@query(f"WITH {_PARTIAL} SELECT * FROM partial")
def topic_partials(spark: SparkSession, d: str) -> DataFrame:
    """Documents and chunks of each topic in each course, with label and system, on or off the catalog."""
    return r.topic_partials(_labelled(spark, d), _listed(spark, d))


@query(f"WITH {_PARTIAL}, spread AS (SELECT unnest(['Entire curriculum', module]) AS scope, partial.* FROM partial JOIN course USING (course_id)) SELECT scope, framework, framework_id, cast(sum(docs) AS BIGINT) AS docs, cast(sum(chunks) AS BIGINT) AS chunks, count(DISTINCT course_id) AS courses, min(label) AS label, min(system) AS system FROM spread GROUP BY ALL")
def topics_in_scopes(spark: SparkSession, d: str) -> DataFrame:
    """Those rows added up for the whole curriculum and for each module."""
    return r.topics_in_scopes(r.topic_partials(_labelled(spark, d), _listed(spark, d)), v.courses(spark, d).select("course_id", "module"))


_TOUCHED = f"{_LABELLED}, inner_ AS (SELECT course_id, case_number, framework_id, coalesce(min(listed.system), split_part(min(label), ' — ', 1)) AS system FROM labelled LEFT JOIN listed ON framework_id = stable_id GROUP BY ALL), touched AS (SELECT course_id, case_number, system, count(DISTINCT framework_id) AS touched FROM inner_ GROUP BY ALL)"


@query(f"WITH {_TOUCHED} SELECT * FROM touched")
def case_systems(spark: SparkSession, d: str) -> DataFrame:
    """Topics of each system that each case touches."""
    return r.case_systems(_labelled(spark, d), _listed(spark, d), "course_id")


@query(f"WITH {_TOUCHED}, {_CATALOG}, totals AS (SELECT course_id, system, count(*) AS total FROM catalog GROUP BY ALL) SELECT touched.*, total, CASE WHEN coalesce(total, 0) = 0 THEN 'gap' WHEN touched * 1.0 / total >= 0.5 THEN 'covered' ELSE 'partial' END AS status FROM touched LEFT JOIN totals USING (course_id, system)")
def case_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """Cells of each case against totals cut to its course's scope."""
    return r.case_heatmap(r.case_systems(_labelled(spark, d), _listed(spark, d), "course_id"), r.scoped_totals(_catalog(spark, d)))


_BOTH = f"""usmle AS (SELECT p_partkey AS stable_id, p_brand AS system, p_name AS subdomain, CASE WHEN p_size > 25 THEN p_name || ' ' || p_type ELSE p_type || ' of ' || p_name END AS full_text FROM part WHERE {_KIND} = 'USMLE'),
aamc AS (SELECT p_partkey AS stable_id, CASE WHEN p_size > 10 THEN 'S' || p_size END AS sub_id, p_brand AS domain, p_name AS description FROM part WHERE {_KIND} = 'AAMC'),
docs AS (SELECT course_id, framework_id, count(DISTINCT document_id) AS docs FROM live JOIN document USING (document_id) GROUP BY ALL),
first AS (SELECT course_id, usmle.* FROM usmle JOIN scope USING (system) UNION ALL SELECT course_id, usmle.* FROM usmle, course WHERE course_id NOT IN (SELECT course_id FROM scope)),
rows AS (SELECT f.course_id, 'USMLE' AS framework, system, system || ' — ' || subdomain AS topic, coalesce(docs, 0) AS docs, stable_id, s_name AS elsewhere, CASE WHEN NOT starts_with(lower(full_text), lower(subdomain)) THEN full_text END AS detail FROM first f LEFT JOIN docs ON f.course_id = docs.course_id AND stable_id = framework_id LEFT JOIN supplier ON stable_id = s_suppkey
UNION ALL SELECT c.course_id, 'AAMC', domain, coalesce(sub_id, cast(stable_id AS varchar)) || ': ' || description, coalesce(docs, 0), stable_id, NULL, NULL FROM aamc CROSS JOIN course c LEFT JOIN docs ON c.course_id = docs.course_id AND stable_id = framework_id)"""


@query(f"WITH {_BOTH} SELECT *, CASE WHEN docs > 0 THEN 1 ELSE 0 END AS courses, {cov.LEVEL_SQL} AS level FROM rows")
def course_coverage_rows(spark: SparkSession, d: str) -> DataFrame:
    """Topics of both catalogs for each course, with notes and scope details."""
    parts = _parts(spark, d)
    systems = parts.filter("framework = 'USMLE'").selectExpr("p_partkey stable_id", "p_brand system", "p_name subdomain", "if(p_size > 25, concat(p_name, ' ', p_type), concat(p_type, ' of ', p_name)) full_text")
    competencies = parts.filter("framework = 'AAMC'").selectExpr("p_partkey stable_id", "if(p_size > 10, concat('S', p_size), null) sub_id", "p_brand domain", "p_name description")
    notes = v.table(spark, d, "supplier").selectExpr("s_suppkey stable_id", "s_name elsewhere")
    links = v.live_links(spark, d).join(v.documents(spark, d), "document_id")
    return r.course_coverage_rows(links, v.courses(spark, d), v.scopes(spark, d), systems, competencies, notes)


@query(f"WITH {_ROWS}, counted AS (SELECT course_id, framework, count(*) AS topics, count(*) FILTER (docs = 0) AS gaps, count(*) FILTER (docs = 1) AS introduced FROM rows GROUP BY ALL) SELECT *, greatest(0, gaps - 12) AS hidden FROM counted")
def gap_card_counts(spark: SparkSession, d: str) -> DataFrame:
    """What stands above the cards of gaps: topics, gaps, those only introduced, and gaps beyond the twelve shown."""
    rows = _topic_rows(spark, d).groupBy("course_id", "framework").agg(F.count("*").alias("topics"), F.count_if(F.col("level") == "gap").alias("gaps"), F.count_if(F.col("level") == "introduced").alias("introduced"))
    return rows.withColumn("hidden", F.greatest(F.lit(0), F.col("gaps") - 12))


@query(f"WITH {_ROWS}, sized AS (SELECT *, count(*) OVER (PARTITION BY course_id, framework) AS total FROM rows), dist AS (SELECT course_id, framework, {cov.DISTRIBUTION_SQL} FROM sized GROUP BY ALL) SELECT course_id, framework, CASE WHEN total <= 0 THEN '{cov.NO_TOPICS}' WHEN addressed = 0 THEN '0 of ' || total || ' domains addressed — no documents aligned yet.' WHEN gap = 0 THEN 'All ' || total || ' domains addressed.' ELSE addressed || ' of ' || total || ' domains addressed; ' || gap || ' need attention.' END AS sentence FROM dist")
def spectrum_sentences(spark: SparkSession, d: str) -> DataFrame:
    sizes = _catalog(spark, d).groupBy("course_id", "framework").agg(F.count("*").alias("total"))
    dist = r.distribution_by(_topic_rows(spark, d).join(sizes, ["course_id", "framework"]), "course_id", "framework")
    return dist.select("course_id", "framework", cov.spectrum_sentence(F.col("addressed"), F.col("total"), F.col("gap")).alias("sentence"))


@query(f"WITH {_CELLS}, n AS (SELECT course_id, count(DISTINCT case_number) * (SELECT count(*) FROM totals) AS cells, count(*) AS filled FROM cells GROUP BY ALL), g AS (SELECT course.course_id, coalesce(cells, 0) AS cells, coalesce(cells - filled, 0) AS gaps FROM course LEFT JOIN n USING (course_id)) SELECT course_id, CASE WHEN cells = 0 THEN '{cov.NO_CELLS}' WHEN gaps = 0 THEN '{cov.NO_GAP_CELLS}' ELSE gaps || ' of ' || cells || ' session × system cells show no coverage yet.' END AS sentence FROM g")
def grid_sentences(spark: SparkSession, d: str) -> DataFrame:
    """A sentence on the grid of each course, those without any case too."""
    topics = v.topics(spark, d)
    cells = r.heatmap(v.facts(spark, d), topics.groupBy("system").agg(F.count("*").alias("total")), "course_id")
    counts = v.courses(spark, d).select("course_id").join(i.gap_cells(cells, ["course_id"], "case_number", topics, "system"), "course_id", "left").fillna(0)
    return counts.select("course_id", cov.grid_sentence(F.col("gaps"), F.col("cells")).alias("sentence"))


@query("SELECT document_id, count(*) AS total, count(*) FILTER (status IN ('approved', 'rejected')) AS reviewed, round(avg(cast(confidence AS double)), 9) AS average_confidence FROM live GROUP BY ALL")
def document_stats(spark: SparkSession, d: str) -> DataFrame:
    """Link statistics of each document."""
    return r.link_statistics(v.live_links(spark, d), "document_id")


@query("WITH named AS (SELECT course_id, case_number, CASE WHEN chunk_index > 5 THEN 'Activity ' || chunk_index END AS activity FROM fact) SELECT course_id, case_number, count(activity) = 0 AS activityless FROM named GROUP BY ALL")
def activityless_cases(spark: SparkSession, d: str) -> DataFrame:
    """Cases whose documents are not organised into activities."""
    key = F.when(F.col("chunk_index") > 5, F.concat(F.lit("Activity "), F.col("chunk_index").cast("string")))
    rolled = rollup_activities(v.facts(spark, d).withColumn("activity", key), "course_id", "case_number")
    return s.activityless(rolled, ["course_id", "case_number"])


@query("WITH docs AS (SELECT framework, system, framework_id, count(DISTINCT document_id) AS docs FROM fact GROUP BY ALL), totals AS (SELECT framework, system, count(*) AS total FROM topic GROUP BY ALL), rows AS (SELECT totals.*, coalesce(docs, 0) AS docs FROM totals LEFT JOIN docs USING (framework, system)) SELECT framework, system, " + cov.DISTRIBUTION_SQL + " FROM rows GROUP BY ALL")
def program_system_distribution(spark: SparkSession, d: str) -> DataFrame:
    """The systems of each framework with their distributions, untouched ones too."""
    totals = v.topics(spark, d).groupBy("framework", "system").agg(F.count("*").alias("total"))
    docs = r.documents_per_topic(v.facts(spark, d), "framework", "system")
    return r.distribution_by(totals.join(docs, ["framework", "system"], "left").withColumn("docs", F.coalesce("docs", F.lit(0))), "framework", "system")


_PAYLOAD = f"""{_ROWS}, sized AS (SELECT *, count(*) OVER (PARTITION BY course_id, framework) AS total FROM rows), dist AS (SELECT course_id, framework, max(total) AS total, count(*) FILTER (docs > 0) AS addressed FROM sized GROUP BY ALL),
a AS (SELECT course_id, string_agg(framework || ':' || addressed || '/' || total, ',' ORDER BY framework) AS distributions FROM dist GROUP BY ALL),
touched AS (SELECT course_id, case_number, system, count(DISTINCT framework_id) AS touched FROM fact GROUP BY ALL), totals AS (SELECT course_id, system, count(*) AS total FROM catalog GROUP BY ALL),
b AS (SELECT course_id, string_agg(case_number || ':' || system || ':' || CASE WHEN coalesce(total, 0) = 0 THEN 'gap' WHEN touched * 1.0 / total >= 0.5 THEN 'covered' ELSE 'partial' END, ',' ORDER BY case_number, system) AS heatmap FROM touched LEFT JOIN totals USING (course_id, system) GROUP BY ALL),
c AS (SELECT course_id, string_agg(document_id || ':' || framework_id, ',' ORDER BY n) AS recent FROM (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY created_at DESC, document_id, chunk_index, framework_id) AS n FROM live JOIN document USING (document_id)) WHERE n <= 10 GROUP BY ALL),
p AS (SELECT course_id, system, count(*) FILTER (docs > 0) AS covered, count(*) AS total FROM rows GROUP BY ALL), e AS (SELECT course_id, string_agg(system || ':' || cast(floor(covered * 100.0 / total + 0.5) AS bigint), ',' ORDER BY system) AS percents FROM p GROUP BY ALL)"""


@query(f"WITH {_PAYLOAD} SELECT course_id, distributions, md5(heatmap) AS heatmap_md5, recent, percents FROM course LEFT JOIN a USING (course_id) LEFT JOIN b USING (course_id) LEFT JOIN c USING (course_id) LEFT JOIN e USING (course_id)")
def course_payload(spark: SparkSession, d: str) -> DataFrame:
    """Everything that a course's summary shows besides its counts, in one row for each course."""
    rows, catalog = _topic_rows(spark, d), _catalog(spark, d)
    sizes = catalog.groupBy("course_id", "framework").agg(F.count("*").alias("total"))
    dist = r.distribution_by(rows.join(sizes, ["course_id", "framework"]), "course_id", "framework")
    touched = v.facts(spark, d).select("course_id", "case_number", "system", "framework_id").distinct().groupBy("course_id", "case_number", "system").agg(F.count("*").alias("touched"))
    links = v.live_links(spark, d).join(v.documents(spark, d), "document_id")
    recent = r.top_per_group(links, ["course_id"], [F.desc("created_at"), "document_id", "chunk_index", "framework_id"], 10)
    return s.course_payload(v.courses(spark, d), dist, r.case_heatmap(touched, r.scoped_totals(catalog)), recent, r.domain_percent(v.facts(spark, d), catalog)).select("course_id", "distributions", F.md5("heatmap").alias("heatmap_md5"), "recent", "percents")


@query("WITH media AS (SELECT l_orderkey AS document_id, l_linenumber AS chunk_index, p_partkey AS asset_id, p_name AS label FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT course_id, document_id, chunk_index, array_to_string(list_sort(list(DISTINCT asset_id || ':' || label)), ',') AS assets FROM media JOIN document USING (document_id) GROUP BY ALL")
def map_media(spark: SparkSession, d: str) -> DataFrame:
    """Media linked to each chunk of each course's map, through the links between them."""
    links = v.table(spark, d, "lineitem").selectExpr("l_orderkey document_id", "l_linenumber chunk_index", "l_partkey asset_id")
    assets = v.table(spark, d, "part").selectExpr("p_partkey asset_id", "p_name label")
    found = s.map_media(v.documents(spark, d), links, assets)
    shown = F.array_sort(F.transform("assets", lambda x: F.concat(x["asset_id"].cast("string"), F.lit(":"), x["label"])))
    return found.select("course_id", "document_id", "chunk_index", F.array_join(shown, ",").alias("assets"))


_OBJECTIVE = f"{_ITEMS}, objective AS (SELECT module, code AS course_code, code || ' course' AS course_title, case_number, CASE WHEN guide_kind = 'faculty' THEN 'Case ' || case_number END AS case_title, ordinal, CASE WHEN coded THEN 'EO-' || ordinal END AS objective_code, text AS objective, item.confidence AS section, CASE method WHEN 'llm' THEN 'llm_cleanup' ELSE method END AS extraction_method, item.confidence, guide_kind || '-' || document_id || '.pdf' AS source_filename, CASE WHEN coded THEN ordinal END AS source_page, '=' || text AS source_excerpt, document_id * 10 + ordinal AS objective_id, document_id, course_id FROM item JOIN document USING (document_id) JOIN course USING (course_id))"
_CELL = lambda c: f"'\"' || CASE WHEN regexp_matches(coalesce(cast({c} AS varchar), ''), '^[=+\\-@\t\r]') THEN '''' ELSE '' END || replace(coalesce(cast({c} AS varchar), ''), '\"', '\"\"') || '\"'"


def _objectives(spark: SparkSession, d: str) -> DataFrame:
    rows = _items(spark, d).join(v.documents(spark, d), "document_id").join(v.courses(spark, d), "course_id")
    return rows.selectExpr(
        "module", "code course_code", "concat(code, ' course') course_title", "case_number", "if(guide_kind = 'faculty', concat('Case ', case_number), null) case_title", "ordinal", "if(coded, concat('EO-', ordinal), null) objective_code", "text objective",
        "confidence section", "if(method = 'llm', 'llm_cleanup', method) extraction_method", "confidence", "concat(guide_kind, '-', document_id, '.pdf') source_filename", "if(coded, ordinal, null) source_page", "concat('=', text) source_excerpt",
        "document_id * 10 + ordinal objective_id", "document_id", "course_id",
    )


@query(f"WITH {_OBJECTIVE}, body AS (SELECT {' || chr(44) || '.join(_CELL(c) for c in s.OBJECTIVE_COLUMNS)} AS line FROM objective) SELECT md5(line) AS line_md5, count(*) AS n FROM (SELECT line FROM body UNION ALL SELECT '{','.join(s.OBJECTIVE_COLUMNS)}' UNION ALL SELECT '\"# Objectives of all courses\"') GROUP BY ALL")
def objectives_csv(spark: SparkSession, d: str) -> DataFrame:
    """Lines of the export of objectives: note, header, sixteen guarded cells a row."""
    found = exports.csv_rows(_objectives(spark, d), "Objectives of all courses", list(s.OBJECTIVE_COLUMNS), ["course_code", "case_number", "ordinal", "objective_id"])
    return found.groupBy(F.md5("line").alias("line_md5")).agg(F.count("*").alias("n"))


@query(f"WITH {_OBJECTIVE} SELECT course_code, count(*) AS total, count(*) FILTER (extraction_method = 'regex') AS regex_count, count(*) FILTER (extraction_method = 'llm_cleanup') AS llm_count, (SELECT string_agg(case_number || ':' || n || ':' || coalesce(title, ''), ',' ORDER BY case_number) FROM (SELECT case_number, count(*) AS n, arg_min(coalesce(case_title, ''), objective_id) AS title FROM objective o WHERE o.course_code = objective.course_code GROUP BY ALL)) AS by_case FROM objective GROUP BY ALL")
def objectives_summary(spark: SparkSession, d: str) -> DataFrame:
    """The summary block of each course's export: counts by method and by case, with the first title of each case."""
    found = s.objectives_summary(_objectives(spark, d), "course_code", ["objective_id"])
    shown = F.transform("by_case", lambda x: F.concat(x["case_number"].cast("string"), F.lit(":"), x["count"].cast("string"), F.lit(":"), F.coalesce(x["case_title"], F.lit(""))))
    return found.select("course_code", "total", "regex_count", "llm_count", F.array_join(shown, ",").alias("by_case"))


@query(f"WITH {_ROWS} SELECT course_id, count(*) AS topics, md5(string_agg(system || '|' || topic || '|' || docs || '|' || {cov.LEVEL_SQL}, chr(10) ORDER BY framework, system, topic, stable_id)) AS export_md5 FROM rows GROUP BY ALL")
def course_exports(spark: SparkSession, d: str) -> DataFrame:
    """The export of each course in order of framework, system and topic, canonical columns only."""
    line = F.concat_ws("|", "system", "topic", F.col("docs").cast("string"), "level")
    pieces = F.array_sort(F.collect_list(F.struct("framework", "system", "topic", "stable_id", line.alias("line"))))
    return _topic_rows(spark, d).groupBy("course_id").agg(F.count("*").alias("topics"), F.md5(F.array_join(F.transform(pieces, lambda x: x["line"]), "\n")).alias("export_md5"))


@query("WITH lens AS (SELECT unnest(['all', guide_kind]) AS lens, fact.* FROM fact), totals AS (SELECT system, count(*) AS total FROM topic GROUP BY ALL), touched AS (SELECT lens, course_id, case_number, system, count(DISTINCT framework_id) AS touched FROM lens GROUP BY ALL) SELECT lens, course_id, case_number, system, touched, total, CASE WHEN touched * 1.0 / total >= 0.5 THEN 'covered' ELSE 'partial' END AS status FROM touched JOIN totals USING (system)")
def lens_heatmap(spark: SparkSession, d: str) -> DataFrame:
    """The heatmaps of all courses under each lens."""
    return r.heatmap(lenses(v.facts(spark, d)), v.topics(spark, d).groupBy("system").agg(F.count("*").alias("total")), "lens", "course_id")


@query("WITH x AS (SELECT false AS scoped, course_id, case_number, system, framework_id FROM fact UNION ALL SELECT true, course_id, case_number, system, framework_id FROM fact WHERE course_id NOT IN (SELECT course_id FROM scope) OR (course_id, system) IN (SELECT (course_id, system) FROM scope)) SELECT scoped, course_id, system, count(DISTINCT framework_id) AS topics FROM x GROUP BY ALL")
def scoped_systems(spark: SparkSession, d: str) -> DataFrame:
    """Linked topics of each course and system, of all systems and of those that the course targets."""
    facts = v.facts(spark, d).select("course_id", "system", "framework_id")
    both = [r.in_scope(facts, v.scopes(spark, d), x).withColumn("scoped", F.lit(x)) for x in (False, True)]
    return both[0].unionByName(both[1]).distinct().groupBy("scoped", "course_id", "system").agg(F.count("*").alias("topics"))


@query(f"WITH c AS (SELECT p_partkey AS stable_id, p_brand AS domain FROM part WHERE {_KIND} = 'AAMC'), l AS (SELECT live.*, CASE WHEN chunk_index <= 4 THEN 'AAMC_PCRS' ELSE 'OTHER' END AS framework FROM live), k AS (SELECT DISTINCT course_id FROM document), x AS (SELECT course_id, domain, count(DISTINCT c.stable_id) AS total, count(DISTINCT c.stable_id) FILTER (EXISTS (SELECT 1 FROM l JOIN document USING (document_id) WHERE l.framework_id = c.stable_id AND l.framework IN ('AAMC_PCRS', 'AAMC_EPA') AND document.course_id = k.course_id)) AS covered FROM c, k GROUP BY ALL) SELECT *, cast(floor(covered * 100.0 / total + 0.5) AS bigint) AS percent FROM x")
def competency_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Competencies of each domain that links of their frameworks cover in each course; links of late chunks have another framework."""
    competencies = _parts(spark, d).filter("framework = 'AAMC'").selectExpr("p_partkey stable_id", "p_brand domain")
    links = v.live_links(spark, d).withColumn("framework", F.when(F.col("chunk_index") <= 4, "AAMC_PCRS").otherwise("OTHER"))
    return r.competency_coverage(competencies, links, v.documents(spark, d), ["AAMC_PCRS", "AAMC_EPA"])
