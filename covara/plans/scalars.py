"""Queries of scalar functions and predicates over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covara.functions import predicates as p
from covara.functions import scalar as s
from covara.operators import items as i
from covara.operators import lines as t
from covara.operators import vectors as x
from covara.plans.items import _ITEMS, _items
from covara.plans.registered import query
from covara.plans.texts import _LINES, _lines
from covara.sources import views as v

_TEXT = "text AS (SELECT doc_id, text, source, n_chars, lang FROM documents WHERE text IS NOT NULL)"


def _text(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "documents").filter("text is not null")


@query("SELECT p_partkey AS id, coalesce(CASE WHEN p_size > 25 THEN p_brand END, trim(split_part(p_name || ' — ' || p_type, ' — ', 1))) AS system, CASE WHEN p_size > 40 THEN p_brand ELSE p_brand || ' — ' || p_name END AS topic, coalesce(CASE WHEN p_size > 10 THEN 'S' || p_size END, cast(p_partkey AS varchar)) || ': ' || p_name AS described, CASE WHEN p_size % 2 = 0 THEN 'X1: ' || p_name ELSE p_name || ' — ' || p_type END AS collapsed, substr(cast(p_partkey AS varchar) || ':' || regexp_replace(regexp_replace(replace(lower(p_name || ' & ' || p_type), '&', 'and'), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 120) AS child_id FROM part")
def topic_names(spark: SparkSession, d: str) -> DataFrame:
    """Systems, labels and ids of topics."""
    c = F.col
    doubled = F.when(c("p_size") % 2 == 0, F.concat(F.lit("X1: "), "p_name", F.lit(" — "), "p_name")).otherwise(F.concat("p_name", F.lit(" — "), "p_type"))
    return v.table(spark, d, "part").select(
        c("p_partkey").alias("id"), s.system_of(F.when(c("p_size") > 25, c("p_brand")), F.concat("p_name", F.lit(" — "), "p_type")).alias("system"), s.topic_label(c("p_brand"), F.when(c("p_size") <= 40, c("p_name"))).alias("topic"),
        s.described_label(F.when(c("p_size") > 10, F.concat(F.lit("S"), "p_size")), c("p_partkey").cast("string"), c("p_name")).alias("described"), s.collapse_label(doubled).alias("collapsed"),
        s.child_id(c("p_partkey").cast("string"), F.concat("p_name", F.lit(" & "), "p_type")).alias("child_id"),
    )


@query(f"WITH {_TEXT}, h AS (SELECT doc_id, trim(text) AS full_text, CASE WHEN n_chars % 3 = 0 THEN '' WHEN n_chars % 3 = 1 THEN substr(trim(text), 1, 9) ELSE source END AS label FROM text) SELECT doc_id, CASE WHEN full_text = '' OR (coalesce(label, '') <> '' AND starts_with(lower(full_text), lower(trim(label)))) THEN NULL WHEN length(full_text) > 120 THEN md5(rtrim(substr(full_text, 1, 120)) || '…') ELSE md5(full_text) END AS hint_md5 FROM h")
def scope_hints(spark: SparkSession, d: str) -> DataFrame:
    """Scope hints of texts under empty, restating and other labels."""
    full = F.trim("text")
    label = F.when(F.col("n_chars") % 3 == 0, "").when(F.col("n_chars") % 3 == 1, F.substring(full, 1, 9)).otherwise(F.col("source"))
    return _text(spark, d).select("doc_id", F.md5(s.scope_hint(label, full)).alias("hint_md5"))


@query("WITH e AS (SELECT event_id, 'Activity ' || (user_id % 30) || CASE WHEN event_id % 2 = 0 THEN 'b: ' ELSE ': ' END || event_type AS section, 'Name it (EO-' || lpad(cast(user_id AS varchar), 4, '0') || ')' || CASE WHEN event_id % 3 = 0 THEN ' later' ELSE '' END AS text FROM events) SELECT event_id, 'Activity ' || regexp_extract(section, '(\\d+)', 1) || CASE WHEN event_id % 2 = 0 THEN 'B' ELSE '' END AS activity, CASE WHEN event_id % 3 <> 0 THEN regexp_extract(text, '(EO-\\d{4})', 1) END AS code FROM e")
def section_keys(spark: SparkSession, d: str) -> DataFrame:
    """Activity keys of sections and codes at the end of objectives."""
    c = F.col
    section = F.concat(F.lit("Activity "), c("user_id") % 30, F.when(c("event_id") % 2 == 0, "b: ").otherwise(": "), c("event_type"))
    text = F.concat(F.lit("Name it (EO-"), F.lpad(c("user_id").cast("string"), 4, "0"), F.lit(")"), F.when(c("event_id") % 3 == 0, " later").otherwise(""))
    return v.table(spark, d, "events").select("event_id", s.activity_key(section).alias("activity"), s.objective_code(text).alias("code"))


_FILES = "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'FacultyGuide-' || o_orderkey || '.PDF' WHEN 'O' THEN 'guide-' || o_orderkey || '.pptx' ELSE 'FacultyGuide-' || o_orderkey || '.docx' END AS filename, CASE WHEN o_orderpriority <> '5-LOW' THEN month(o_orderdate) END AS page, CASE WHEN o_custkey % 2 = 0 THEN 'x-Epa-' ELSE 'pcrs-' END || o_custkey AS stable_id, o_orderstatus FROM orders"


@query(f"WITH f AS ({_FILES}) SELECT id, CASE WHEN o_orderstatus = 'F' THEN 'Page ' || page WHEN o_orderstatus = 'O' THEN 'Slide ' || page END AS label, CASE WHEN contains(filename, 'FacultyGuide') THEN 'faculty' ELSE 'self_study' END AS kind, CASE o_orderstatus WHEN 'F' THEN 'pdf_pending' WHEN 'O' THEN 'self_study' ELSE 'faculty' END AS scope, CASE WHEN contains(lower(stable_id), 'epa') THEN 'AAMC_EPA' ELSE 'AAMC_PCRS' END AS framework, 'Consider adding a case or lecture addressing ' || stable_id || ' to close this coverage gap.' AS action FROM f")
def file_labels(spark: SparkSession, d: str) -> DataFrame:
    """Page labels, guide kinds, extraction scopes, frameworks and suggested actions."""
    o = v.table(spark, d, "orders").selectExpr(
        "o_orderkey id", "case o_orderstatus when 'F' then concat('FacultyGuide-', o_orderkey, '.PDF') when 'O' then concat('guide-', o_orderkey, '.pptx') else concat('FacultyGuide-', o_orderkey, '.docx') end filename",
        "if(o_orderpriority <> '5-LOW', month(o_orderdate), null) page", "concat(if(o_custkey % 2 = 0, 'x-Epa-', 'pcrs-'), o_custkey) stable_id", "case o_orderstatus when 'F' then 'pdf' when 'O' then 'pptx' else 'docx' end type",
    )
    kind = s.guide_kind(F.col("filename"))
    return o.select("id", s.page_label(F.col("filename"), F.col("page")).alias("label"), kind.alias("kind"), s.extraction_scope(kind, F.col("type")).alias("scope"), s.framework_of(F.col("stable_id")).alias("framework"), s.suggested_action(F.col("stable_id")).alias("action"))


@query(f"WITH {_TEXT} SELECT doc_id, len(string_split(text, '&&&')) - 1 AS marks, md5(replace(text, '&&&', '')) AS stripped_md5, len(string_split(lower(text), 'the')) - 1 AS hits, md5(regexp_replace(text, '(the)', '<mark>\\1</mark>', 'gi')) AS shown_md5 FROM text")
def marked_texts(spark: SparkSession, d: str) -> DataFrame:
    """Marker counts, texts without markers, and texts with a query's places marked."""
    n = F.size(F.split(F.lower("text"), "the", -1)) - 1
    return _text(spark, d).select("doc_id", s.marker_count(F.col("text"), "&&&").alias("marks"), F.md5(s.without_markers(F.col("text"), "&&&")).alias("stripped_md5"), n.cast("bigint").alias("hits"), F.md5(s.highlighted(F.col("text"), "the")).alias("shown_md5"))


@query(f"WITH {_LINES} SELECT doc_id, cast(line_no AS integer) AS line_no, cast(coalesce(sum(length(line) + CASE WHEN crlf THEN 2 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS start FROM (SELECT line.*, contains(text, chr(13)) AS crlf FROM line JOIN documents USING (doc_id))")
def line_offsets(spark: SparkSession, d: str) -> DataFrame:
    """The place of the first character of every line, for line ends of one and two characters."""
    return t.with_offsets(_text(spark, d).select("doc_id", "text")).select("doc_id", "line_no", F.col("offset").alias("start"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN 1 - 5 * l_discount >= 0.8 THEN 'high' WHEN 1 - 5 * l_discount >= 0.6 THEN 'medium' ELSE 'low' END AS band, printf('%.2f', cast(1 - 5 * l_discount AS decimal(3, 2))::double) AS shown, CASE WHEN l_quantity BETWEEN 0 AND 25 THEN l_quantity END AS parsed FROM lineitem")
def confidence_texts(spark: SparkSession, d: str) -> DataFrame:
    """Bands and texts of confidences, and numbers parsed from the beginning of texts and checked for their range."""
    c = F.expr("cast(1 - 5 * l_discount as decimal(3, 2))")
    raw = F.concat(F.lit(" "), F.col("l_quantity").cast("string"), F.lit("abc"))
    return v.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", s.confidence_band(c).alias("band"), s.confidence_text(c).alias("shown"), p.parse_number(raw, 0, 25).alias("parsed"))


@query("SELECT vec_id, len(embedding) AS dims, round(list_sum(list_transform(embedding, lambda x: cast(x AS double))), 4) AS total FROM embeddings")
def vector_texts(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as text and read again."""
    read = s.vector_from_text(s.vector_to_text(F.col("embedding")))
    total = F.aggregate(F.transform(read, lambda y: y.cast("double")), F.lit(0.0), lambda a, y: a + y)
    return v.table(spark, d, "embeddings").select("vec_id", F.size(read).cast("bigint").alias("dims"), F.round(total, 4).alias("total"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN event_id % 4 <> 0 THEN event_type || ',x' || user_id END AS ids FROM events")
def scored_documents(spark: SparkSession, d: str) -> DataFrame:
    """Links parsed from JSON documents, every fourth of which is cut short."""
    whole = F.concat(F.lit('{"alignments":[{"id":"'), "event_type", F.lit('","confidence":0.7},{"id":"x'), "user_id", F.lit('","confidence":0.5,"rationale":"r"}]}'))
    text = F.when(F.col("event_id") % 4 == 0, F.substring(whole, 1, 12)).otherwise(whole)
    found = x.parse_scored(text)
    return v.table(spark, d, "events").select("event_id", F.size(found).alias("n"), F.nullif(F.array_join(F.transform(found, lambda y: y["id"]), ","), F.lit("")).alias("ids"))


@query("SELECT p_partkey AS stable_id, p_brand AS system FROM part WHERE p_type <> 'PROMO'")
def catalog_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of the catalog; promotional parts stand for its upper level."""
    rows = v.table(spark, d, "part").selectExpr("p_partkey stable_id", "p_brand system", "if(p_type = 'PROMO', null, p_type) parent_stable_id")
    return rows.filter(p.is_leaf()).select("stable_id", "system")


@query(f"WITH {_ITEMS} SELECT document_id, ordinal, case_number, method FROM item JOIN document USING (document_id) WHERE contains(lower(text), 'bolt') AND case_number = 3 AND method = 'regex'")
def filtered_objectives(spark: SparkSession, d: str) -> DataFrame:
    """Objectives of one case and method that hold a text in any case, as a reader's filter asks for."""
    rows = _items(spark, d).join(v.documents(spark, d), "document_id")
    return rows.filter(p.matches_objective("text", "case_number", "method", "BOLT", 3, "regex")).select("document_id", "ordinal", "case_number", "method")


@query("WITH wanted AS (SELECT unnest(['all', 'Unassigned', 'ASIA', 'ELSEWHERE']) AS wanted), named AS (SELECT document.*, CASE WHEN course_id IN (SELECT course_id FROM scope) THEN module END AS m FROM document JOIN course USING (course_id)) SELECT wanted, document_id, course_id FROM named, wanted WHERE wanted = 'all' OR coalesce(m, 'Unassigned') = wanted")
def module_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of each choice of module; only curated courses have one, and one name is unknown."""
    curated = v.courses(spark, d).join(v.scopes(spark, d).select("course_id").distinct(), "course_id", "left_semi")
    found = [i.in_module(v.documents(spark, d), curated, w).select(F.lit(w).alias("wanted"), "document_id", "course_id") for w in ("all", "Unassigned", "ASIA", "ELSEWHERE")]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@query("SELECT conv_id, turn, " + ", ".join(f"md5(substr(text, 1, {n})) AS first_{n}" for n in (120, 200, 240, 300, 500)) + " FROM conversations")
def turn_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """Excerpts of the lengths that lists, prompts, captions, search results and descriptions show."""
    return v.table(spark, d, "conversations").select("conv_id", "turn", *(F.md5(F.substring("text", 1, n)).alias(f"first_{n}") for n in (120, 200, 240, 300, 500)))


@query(f"WITH {_TEXT}, w AS (SELECT doc_id, text, regexp_extract(lower(text), '\\b(?:nicht|with|pour|para)\\b') AS word FROM text), f AS (SELECT *, length(regexp_extract(lower(text), '(?s)^(.*?)\\b(?:nicht|with|pour|para)\\b', 1)) + 1 AS spot FROM w WHERE word <> '') SELECT doc_id, md5(CASE WHEN spot > 61 THEN '…' ELSE '' END || substr(text, greatest(1, spot - 60), spot + length(word) + 60 - greatest(1, spot - 60)) || CASE WHEN spot + length(word) + 60 <= length(text) THEN '…' ELSE '' END) AS excerpt_md5 FROM f")
def word_excerpts(spark: SparkSession, d: str) -> DataFrame:
    """The surroundings of the first whole word of a few."""
    rows = _text(spark, d).select("doc_id", "text", F.regexp_extract(F.lower("text"), r"(?<![a-z0-9_])(?:nicht|with|pour|para)(?![a-z0-9_])", 0).alias("word")).filter("word <> ''")
    return rows.select("doc_id", F.md5(t.excerpt(F.col("text"), F.col("word"))).alias("excerpt_md5"))
