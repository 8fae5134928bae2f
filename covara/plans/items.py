"""Queries of items, captions and links. Link rows serve as objectives: their topic's name is the text, the return flag how they were found, the quantity how sure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covara.operators import items as i
from covara.operators import keyed as k
from covara.operators import rollups as r
from covara.plans.course import _CATALOG, _CELLS, _catalog
from covara.plans.registered import query
from covara.plans.texts import _LINES, _lines
from covara.sources import views as v

_ITEMS = "item AS (SELECT l_orderkey AS document_id, l_linenumber AS ordinal, p_name AS text, CASE l_returnflag WHEN 'R' THEN 'llm' WHEN 'A' THEN 'regex' END AS method, CASE WHEN l_quantity >= 35 THEN 'high' WHEN l_quantity >= 15 THEN 'medium' ELSE 'low' END AS confidence, l_linestatus = 'F' AS coded FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "lineitem").join(v.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.selectExpr(
        "l_orderkey document_id", "l_linenumber ordinal", "p_name text", "case l_returnflag when 'R' then 'llm' when 'A' then 'regex' end method",
        "case when l_quantity >= 35 then 'high' when l_quantity >= 15 then 'medium' else 'low' end confidence", "l_linestatus = 'F' coded",
    )


@query(f"WITH {_ITEMS} SELECT course_id, count(*) AS total, count(*) FILTER (method IS DISTINCT FROM 'llm') AS regex, count(*) FILTER (method = 'llm') AS llm FROM item JOIN document USING (document_id) GROUP BY ALL")
def objective_counts(spark: SparkSession, d: str) -> DataFrame:
    return i.method_counts(_items(spark, d).join(v.documents(spark, d), "document_id"), "course_id")


@query(f"WITH {_ITEMS} SELECT course_id, case_number, count(*) AS total, count(*) FILTER (method = 'regex') AS regex, count(*) FILTER (method = 'llm') AS llm, arg_min(guide_kind, document_id) AS guide_kind FROM item JOIN document USING (document_id) GROUP BY ALL")
def objective_export_summary(spark: SparkSession, d: str) -> DataFrame:
    return i.export_summary(_items(spark, d).join(v.documents(spark, d), "document_id"), ["course_id", "case_number"], "guide_kind", ["document_id"])


@query(f"WITH {_CATALOG}, hit AS (SELECT DISTINCT course_id, framework_id FROM fact), p AS (SELECT catalog.course_id, system, cast(floor(count(framework_id) * 100.0 / count(*) + 0.5) AS bigint) AS percent FROM catalog LEFT JOIN hit ON catalog.course_id = hit.course_id AND stable_id = framework_id GROUP BY ALL), ranked AS (SELECT *, row_number() OVER (PARTITION BY course_id ORDER BY percent, system) AS n FROM p) SELECT course_id, percent, system, system || ' has the lowest coverage at ' || percent || '%.' AS takeaway FROM ranked WHERE n = 1")
def lowest_domain(spark: SparkSession, d: str) -> DataFrame:
    return i.lowest_domain(r.domain_percent(v.facts(spark, d), _catalog(spark, d)), ["course_id"], "system", "percent")


@query(f"WITH {_CELLS} SELECT course_id, count(DISTINCT case_number) * (SELECT count(*) FROM totals) AS cells, count(DISTINCT case_number) * (SELECT count(*) FROM totals) - count(*) AS gaps FROM cells GROUP BY ALL")
def gap_cells(spark: SparkSession, d: str) -> DataFrame:
    topics = v.topics(spark, d)
    cells = r.heatmap(v.facts(spark, d), topics.groupBy("system").agg(F.count("*").alias("total")), "course_id")
    return i.gap_cells(cells, ["course_id"], "case_number", topics, "system")


_CAPTIONS = "caption AS (SELECT p_brand AS filename, p_type AS label, CASE WHEN l_returnflag <> 'N' THEN l_linenumber END AS source_index, p_name || ' ' || l_orderkey AS text, l_orderkey, p_name FROM lineitem JOIN part ON l_partkey = p_partkey)"


def _captions(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "lineitem").join(v.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.selectExpr("p_brand filename", "p_type label", "if(l_returnflag <> 'N', l_linenumber, null) source_index", "concat(p_name, ' ', l_orderkey) text", "l_orderkey", "p_name")


def _assets(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "part").selectExpr("p_partkey asset_id", "p_brand filename", "p_type label", "p_size source_index", "if(p_retailprice > 900.5, p_name, null) mined")


@query(f"WITH {_CAPTIONS}, last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filename, label, source_index ORDER BY l_orderkey DESC, p_name DESC) AS n FROM caption) WHERE n = 1), asset AS (SELECT p_partkey AS asset_id, p_brand AS filename, p_type AS label, p_size AS source_index, CASE WHEN p_retailprice > 900.5 THEN p_name END AS mined FROM part) SELECT asset_id, coalesce(e.text, g.text, mined) AS caption, coalesce(e.text, g.text, mined) IS NOT NULL AS has_caption, CASE WHEN coalesce(e.text, g.text) IS NOT NULL THEN 'csv' WHEN mined IS NOT NULL THEN 'mined' END AS caption_source FROM asset a LEFT JOIN last e ON a.filename = e.filename AND a.label = e.label AND a.source_index = e.source_index LEFT JOIN last g ON a.filename = g.filename AND a.label = g.label AND g.source_index IS NULL")
def caption_override(spark: SparkSession, d: str) -> DataFrame:
    return i.with_captions(_assets(spark, d), _captions(spark, d), ["l_orderkey", "p_name"]).select("asset_id", "caption", "has_caption", "caption_source")


@query(f"WITH {_CAPTIONS} SELECT p_partkey AS asset_id FROM part WHERE p_retailprice > 900.5 AND NOT EXISTS (SELECT 1 FROM caption WHERE filename = p_brand AND label = p_type AND source_index IS NOT DISTINCT FROM p_size)")
def caption_rescue(spark: SparkSession, d: str) -> DataFrame:
    return i.captions_to_rescue(_assets(spark, d), _captions(spark, d), ["filename", "label", "source_index"], "mined").select("asset_id")


@query("SELECT DISTINCT document_id, chunk_index FROM live JOIN topic ON framework_id = stable_id WHERE framework = 'AAMC' AND system = (SELECT min(system) FROM topic)")
def linked_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks linked to any topic of the first system."""
    topics = v.topics(spark, d).filter("framework = 'AAMC'")
    chosen = topics.join(v.topics(spark, d).agg(F.min("system").alias("system")), "system", "left_semi")
    return i.linked(v.live_links(spark, d), chosen.withColumnRenamed("stable_id", "framework_id"), ["framework_id"], ["document_id", "chunk_index"])


@query(f"WITH {_ITEMS}, prior AS (SELECT document_id, text, arg_min(ordinal, (ordinal, confidence)) AS ordinal, arg_min(confidence, (ordinal, confidence)) AS confidence FROM item WHERE method IS DISTINCT FROM 'llm' GROUP BY ALL) SELECT item.document_id, item.text, coalesce(prior.ordinal, -1) AS ordinal, coalesce(prior.confidence, 'medium') AS confidence, count(*) AS n FROM item LEFT JOIN prior USING (document_id, text) WHERE method = 'llm' GROUP BY ALL")
def prior_matches(spark: SparkSession, d: str) -> DataFrame:
    """Cleaned items with the place and confidence of the original they restate."""
    rows = _items(spark, d)
    originals = rows.filter("not method <=> 'llm'")
    found = i.with_prior(rows.filter("method = 'llm'"), originals, "document_id", ["ordinal", "confidence"], {"ordinal": -1, "confidence": "medium"})
    return found.groupBy("document_id", "text", "ordinal", "confidence").agg(F.count("*").alias("n"))


@query(f"WITH {_ITEMS}, new AS (SELECT * FROM item WHERE method = 'llm'), old AS (SELECT i.*, i.document_id IN (SELECT document_id FROM new) AS cleaned, o_orderstatus = 'O' AS missing, EXISTS (SELECT 1 FROM new WHERE new.document_id = i.document_id AND new.text = i.text) AS again FROM item i LEFT JOIN orders ON i.document_id = o_orderkey WHERE method IS DISTINCT FROM 'llm'), pool AS (SELECT document_id, text, ordinal, false AS from_cleaned, NOT cleaned AS as_is FROM old WHERE NOT cleaned OR coalesce(missing, false) OR confidence = 'high' OR coded OR (confidence <> 'low' AND NOT again) UNION ALL SELECT document_id, text, ordinal, true, false FROM new), ranked AS (SELECT *, row_number() OVER (PARTITION BY document_id, text ORDER BY from_cleaned, ordinal) AS n FROM pool) SELECT document_id, cast(row_number() OVER (PARTITION BY document_id ORDER BY from_cleaned, ordinal, text) AS integer) AS ordinal, text, from_cleaned FROM ranked WHERE n = 1 OR as_is")
def merged_objectives(spark: SparkSession, d: str) -> DataFrame:
    """Objectives after cleaning; open orders stand for documents whose items were missing."""
    rows = _items(spark, d)
    reasons = v.table(spark, d, "orders").selectExpr("o_orderkey document_id", "if(o_orderstatus = 'O', 'missing', 'messy') reason")
    return i.merge_cleaned(rows.filter("not method <=> 'llm'").withColumn("text_order", F.col("text")), rows.filter("method = 'llm'").withColumn("text_order", F.col("text")), reasons, "document_id", ["ordinal", "text_order"])


@query(f"WITH {_ITEMS}, per AS (SELECT document_id, count(*) AS n, count(*) FILTER (confidence = 'low') AS low, bool_or(length(text) > 9 AND confidence <> 'high' AND NOT coded) AS long FROM item GROUP BY ALL) SELECT o_orderkey AS document_id, o_orderstatus <> 'P' AND CASE WHEN n IS NULL THEN o_orderstatus <> 'F' ELSE (low > 0 AND low >= 0.5 * n) OR long END AS needs_review FROM orders LEFT JOIN per ON o_orderkey = document_id")
def review_needed(spark: SparkSession, d: str) -> DataFrame:
    documents = v.table(spark, d, "orders").selectExpr("o_orderkey document_id", "o_orderstatus <> 'P' has_sections", "o_orderstatus = 'F' topics_only")
    return i.needs_review(documents, _items(spark, d), "document_id", run_on=9)


@query("WITH next AS (SELECT conv_id, turn - 1 AS turn, role, substr(text, 1, 40) AS caption FROM conversations), head AS (SELECT conv_id, turn, string_agg(next.role || ': ' || caption, chr(10) ORDER BY next.role, caption) AS head FROM next JOIN conversations c USING (conv_id, turn) WHERE caption IS NOT NULL AND NOT contains(lower(c.text), lower(caption)) GROUP BY ALL) SELECT conv_id, turn, md5(concat_ws(chr(10), head, text)) AS embed_md5 FROM conversations LEFT JOIN head USING (conv_id, turn)")
def enriched_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns with the beginning of the next turn as their caption."""
    c = v.table(spark, d, "conversations")
    captions = c.selectExpr("conv_id", "turn - 1 turn", "role ordinal", "role label", "substr(text, 1, 40) caption")
    rows = i.enriched(c.select("conv_id", "turn", F.col("text").alias("content")), captions, ["conv_id", "turn"])
    return rows.select("conv_id", "turn", F.md5("embed_text").alias("embed_md5"))


@query(f"WITH {_LINES}, m AS (SELECT *, length(line) BETWEEN 1 AND 60 AS label, length(line) >= 20 AS wanted FROM line), a AS (SELECT *, lead(line, 1) OVER w AS l1, lead(line, 2) OVER w AS l2, lead(line, 3) OVER w AS l3, coalesce(NOT lead(label, 1) OVER w, false) AS o1, coalesce(NOT lead(label, 2) OVER w, false) AS o2, coalesce(NOT lead(label, 3) OVER w, false) AS o3 FROM m WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)), p AS (SELECT doc_id, line_no, list_filter([CASE WHEN o1 AND length(l1) >= 20 THEN l1 END, CASE WHEN o1 AND o2 AND length(l2) >= 20 THEN l2 END, CASE WHEN o1 AND o2 AND o3 AND length(l3) >= 20 THEN l3 END], lambda x: x IS NOT NULL) AS kept FROM a WHERE label) SELECT doc_id, line_no, CASE WHEN len(kept) > 0 THEN md5(substr(trim(array_to_string(kept, ' '), ' '), 1, 2000)) END AS caption_md5 FROM p")
def line_captions(spark: SparkSession, d: str) -> DataFrame:
    """Short lines with the long lines that follow them."""
    n = F.length("line")
    return i.captions_after(_lines(spark, d), n.between(1, 60), n >= 20).select("doc_id", "line_no", F.md5("caption").alias("caption_md5"))


@query("WITH n AS (SELECT l_orderkey AS document_id, count(*) AS chunks, count(*) FILTER (l_quantity > 5) AS e, count(*) FILTER (l_quantity > 10) AS a FROM lineitem GROUP BY ALL) SELECT course_id, case_number, count(*) AS documents, bool_and(coalesce(chunks > 0 AND e = chunks AND a = chunks, false)) AS complete, coalesce(sum(e) >= 0.9 * sum(chunks) AND sum(chunks) > 0, false) AS embedded FROM document LEFT JOIN n USING (document_id) GROUP BY ALL")
def smoke_cases(spark: SparkSession, d: str) -> DataFrame:
    """Whether the documents of each case are complete."""
    chunks = v.table(spark, d, "lineitem").selectExpr("l_orderkey document_id", "l_quantity > 5 embedded", "l_quantity > 10 aligned")
    documents = v.documents(spark, d)
    return i.smoke(k.pipeline_status(documents, chunks).join(documents, "document_id"), ["course_id", "case_number"])


@query("WITH n AS (SELECT l_orderkey AS document_id, count(*) AS chunks, count(*) FILTER (l_quantity > 5) AS e, count(*) FILTER (l_quantity > 10) AS a FROM lineitem GROUP BY ALL), s AS (SELECT course_id, case_number, bool_and(coalesce(chunks > 0 AND e = chunks AND a = chunks, false)) AS complete, coalesce(sum(e) >= 0.9 * sum(chunks) AND sum(chunks) > 0, false) AS embedded FROM document LEFT JOIN n USING (document_id) GROUP BY ALL), p AS (SELECT course_id, case_number, count(*) FILTER (starts_with(cast(framework_id AS varchar), '19')) AS named FROM live JOIN document USING (document_id) GROUP BY ALL) SELECT course_id, case_number, concat_ws(', ', CASE WHEN NOT complete THEN 'pipeline incomplete' END, CASE WHEN NOT embedded THEN 'too few vectors' END, CASE WHEN coalesce(named, 0) = 0 THEN 'no id begins with 19' END) AS errors FROM s LEFT JOIN p USING (course_id, case_number)")
def smoke_errors(spark: SparkSession, d: str) -> DataFrame:
    """What a smoke test of each case reports."""
    chunks = v.table(spark, d, "lineitem").selectExpr("l_orderkey document_id", "l_quantity > 5 embedded", "l_quantity > 10 aligned")
    documents, keys = v.documents(spark, d), ["course_id", "case_number"]
    checked = i.smoke(k.pipeline_status(documents, chunks).join(documents, "document_id"), keys)
    links = v.live_links(spark, d).join(documents, "document_id")
    return i.smoke_errors(checked, keys, links, "19").select(*keys, F.array_join("errors", ", ").alias("errors"))


@query("SELECT s_suppkey, s_name, CASE WHEN s_acctbal > 5000 THEN 'changed' WHEN s_nationkey > 20 THEN 'new' ELSE 'kept' END AS state FROM supplier")
def change_stamps(spark: SparkSession, d: str) -> DataFrame:
    """Which rows get the time of the run: changed and new ones; the others keep the time that is stored."""
    rows = v.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey", "s_acctbal")
    stored = rows.filter("s_nationkey <= 20 or s_acctbal > 5000").select("s_suppkey", F.when(F.col("s_acctbal") > 5000, "other").otherwise(F.col("s_name")).alias("s_name"), F.to_timestamp(F.lit("2001-01-01")).alias("updated_at"))
    found = i.stamped(rows, stored, ["s_suppkey"], ["s_name"])
    fresh = F.col("updated_at") > F.to_timestamp(F.lit("2002-01-01"))
    return found.select("s_suppkey", "s_name", F.when(fresh & (F.col("s_acctbal") > 5000), "changed").when(fresh, "new").otherwise("kept").alias("state"))
