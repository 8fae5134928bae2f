"""Queries of the figure registry over documents. The rules fit these tables: first words of lines stand for the labels of guides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covara.operators import figures as f
from covara.plans.chunks import _WS
from covara.plans.registered import query
from covara.plans.texts import _LINES, _lines
from covara.sources import views as v

RULES = f.FigureRules(answer=r"^(?:And|Und)\s+(.*)$", answer_prefix=r"^(?:And|Und)\s*", answer_name="", figure=r"^(?:The|Der)\s+(\w+)\s*(.*)$", provided=r"^La\s+(.*)$", video=r"(\w+)@(?:\w+)", watch="Ietzte", address=r"\w+@\S+", explains="^(Of|De)", capitals=r"^[A-Z]{5,}$")

_REGISTRY = f"""fline AS (SELECT doc_id, t AS line, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS line_no FROM (SELECT doc_id, line_no, trim(line, {_WS}) AS t FROM (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL))) WHERE t <> ''),
fk AS (SELECT *, CASE WHEN regexp_matches(line, '{RULES.video}') OR regexp_matches(line, '{RULES.watch}') THEN 'video' WHEN regexp_matches(line, '{RULES.answer}') THEN 'answer_image' WHEN regexp_matches(line, '{RULES.figure}') THEN 'figure' WHEN regexp_matches(line, '{RULES.provided}') THEN 'provided_image' END AS kind FROM fline),
fw AS (SELECT *, lead(line) OVER w AS next, list(line) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before, list({{'line': line, 'label': kind IS NOT NULL}}) OVER (w ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING) AS after FROM fk WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
fs AS (SELECT *, coalesce(list_position(list_transform(after, lambda x: x.label), true), 0) AS stop, trim(CASE kind WHEN 'answer_image' THEN regexp_extract(line, '{RULES.answer}', 1) WHEN 'figure' THEN regexp_extract(line, '{RULES.figure}', 2) ELSE regexp_extract(line, '{RULES.provided}', 1) END, {_WS}) AS tail,
  CASE WHEN kind = 'video' THEN CASE WHEN regexp_matches(line, '{RULES.video}') THEN coalesce(nullif(regexp_extract(line, '{RULES.address}'), ''), '{RULES.video_base}' || regexp_extract(line, '{RULES.video}', 1)) ELSE nullif(regexp_extract(concat_ws(' ', line, next), '{RULES.address}'), '') END END AS url FROM fw WHERE kind IS NOT NULL),
fc AS (SELECT *, list_concat(CASE WHEN length(tail) >= 8 THEN [tail] ELSE []::VARCHAR[] END, list_filter(list_transform(CASE WHEN stop > 0 THEN after[1:stop - 1] ELSE coalesce(after, []) END, lambda x: x.line), lambda x: regexp_matches(x, '{RULES.explains}') OR regexp_matches(x, '{RULES.capitals}') OR length(x) >= 20)) AS parts,
  CASE kind WHEN 'video' THEN coalesce('Video: ' || url, '{RULES.watch_name}') WHEN 'answer_image' THEN trim(regexp_replace(trim(regexp_replace(string_split(line, ':')[1], '\\s+', ' ', 'g'), {_WS}), '{RULES.answer_prefix}', '{RULES.answer_name}'), {_WS}) WHEN 'figure' THEN 'Figure ' || regexp_extract(line, '{RULES.figure}', 1) ELSE '{RULES.provided_name}' END AS label FROM fs),
ft AS (SELECT *, CASE WHEN kind = 'video' THEN url WHEN len(parts) > 0 THEN substr(trim(array_to_string(parts, ' '), {_WS}), 1, 2000) END AS text, min(line_no) OVER (PARTITION BY doc_id, kind, label) AS first_no FROM fc),
registry AS (SELECT doc_id, cast(line_no AS integer) AS line_no, kind, label, list_filter(before, lambda x: length(x) < 120)[1] AS section, CASE WHEN kind = 'video' THEN url IS NOT NULL ELSE coalesce(length(text) >= 8, false) END AS has_caption, text, cast(CASE kind WHEN 'answer_image' THEN row_number() OVER (PARTITION BY doc_id, kind ORDER BY line_no) WHEN 'figure' THEN dense_rank() OVER (PARTITION BY doc_id, kind ORDER BY first_no) END AS integer) AS source_index, url FROM ft)"""


def _registry(spark: SparkSession, d: str) -> DataFrame:
    return f.figure_registry(v.table(spark, d, "documents"), RULES)


@query(f"WITH {_REGISTRY} SELECT doc_id, line_no, kind, label, section, has_caption, md5(text) AS text_md5, source_index, url FROM registry")
def figure_registry(spark: SparkSession, d: str) -> DataFrame:
    """Labels of figures and videos with captions, sections and numbers."""
    return _registry(spark, d).select("doc_id", "line_no", "kind", "label", "section", "has_caption", F.md5("text").alias("text_md5"), "source_index", "url")


@query(f"WITH {_LINES}, {_REGISTRY} SELECT DISTINCT line.doc_id, cast(line.line_no AS integer) AS chunk_index, label FROM line JOIN (SELECT DISTINCT doc_id, label FROM registry) USING (doc_id) WHERE contains(lower(line), trim(regexp_replace(lower(label), '\\s+', ' ', 'g'), {_WS})) OR CASE WHEN regexp_extract(lower(label), 'answer\\s+(?:image|figure)\\s*(\\d+[a-z]?)', 1) <> '' THEN regexp_matches(lower(line), 'answer\\s+(?:image|figure)\\s*' || regexp_extract(lower(label), 'answer\\s+(?:image|figure)\\s*(\\d+[a-z]?)', 1)) WHEN regexp_extract(lower(label), 'figure\\s+(\\d+[a-z]?)', 1) <> '' THEN regexp_matches(lower(line), 'figure\\s+' || regexp_extract(lower(label), 'figure\\s+(\\d+[a-z]?)', 1) || '\\b') ELSE false END")
def mention_links(spark: SparkSession, d: str) -> DataFrame:
    """Lines and the labels of their document that they name."""
    return f.mentions(_lines(spark, d).select("doc_id", F.col("line_no").alias("chunk_index"), F.col("line").alias("content")), _registry(spark, d))


@query(f"WITH {_REGISTRY}, file AS (SELECT doc_id, length(text) % 5 AS source_index, source AS path FROM documents WHERE text IS NOT NULL), doc AS (SELECT doc_id, CASE WHEN lang = 'en' THEN 'faculty' ELSE 'self_study' END AS kind FROM documents), r AS (SELECT registry.*, doc.kind AS guide, trim(coalesce(text, ''), {_WS}) = '' AND coalesce(path, '') = '' AS bare FROM registry JOIN doc USING (doc_id) LEFT JOIN file ON registry.doc_id = file.doc_id AND registry.source_index = file.source_index), n AS (SELECT doc_id, count(*) AS labels, count(*) FILTER (kind = 'answer_image') AS answer_images, count(*) FILTER (kind = 'figure' AND NOT has_caption AND guide = 'self_study') AS image_only, coalesce(string_agg(label || ' missing caption text and extracted file', ', ' ORDER BY line_no) FILTER (kind = 'answer_image' AND guide = 'faculty' AND bare), '') AS failures FROM r GROUP BY ALL) SELECT doc_id, doc.kind, coalesce(labels, 0) AS labels, coalesce(answer_images, 0) AS answer_images, coalesce(image_only, 0) AS image_only, coalesce(failures, '') AS failures FROM doc LEFT JOIN n USING (doc_id)")
def figure_gate(spark: SparkSession, d: str) -> DataFrame:
    """The audit of labels: English documents stand for faculty guides, one file for each document."""
    docs = v.table(spark, d, "documents")
    files = docs.filter("text is not null").selectExpr("doc_id", "length(text) % 5 source_index", "source path")
    kinds = docs.selectExpr("doc_id", "if(lang = 'en', 'faculty', 'self_study') kind")
    return f.figure_gate(_registry(spark, d), kinds, files).withColumn("failures", F.array_join("failures", ", "))


@query(f"WITH {_REGISTRY} SELECT doc_id, line_no, registry.kind, label, CASE WHEN lang = 'en' AND n_chars % 2 = 0 THEN 'pdf_pending' WHEN lang = 'en' AND n_chars % 2 = 1 THEN 'faculty' ELSE 'self_study' END AS extraction_scope FROM registry JOIN documents USING (doc_id)")
def scoped_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels with the scope of their document; English documents stand for faculty guides, those with an even number of characters for PDF files."""
    documents = v.table(spark, d, "documents").selectExpr("doc_id", "if(lang = 'en', 'faculty', 'self_study') kind", "if(n_chars % 2 = 0, 'pdf', 'docx') file_type")
    return f.with_scope(_registry(spark, d), documents).select("doc_id", "line_no", "kind", "label", "extraction_scope")
