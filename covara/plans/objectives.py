"""Queries of the objective job over documents. The rules fit these tables: a line of one word opens a range, one of two words ends it, and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covara.operators import objectives as o
from covara.operators.items import needs_review
from covara.plans.chunks import _WS
from covara.plans.registered import query
from covara.plans.texts import _LINES
from covara.sources import views as v
from covara.sources.scratch import stored

RULES = o.ObjectiveRules(
    section=(r"^\S+\.$", r"^Was "), end=(r"^\S+ \S+\.$", r"^Du "), intro=(r"^The ", r"^Der "), noise=(r"\|", r"^Of "), verb="^[A-F]", bullet=r"^(?:In|En|Le)\s+", code=r"(\w+tion)\.\s*$", topic_code="(keit|ment)",
    topics_header="^Ietzte", media="^[XYZ]", stamp=r"\d{2}:\d{2}$", complete=r"[.!?)]$", page_mark="&&&", most_item=400,
)


def _any(x: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for p in patterns) + ")"


def _clean(x: str) -> str:
    return f"regexp_replace(trim(regexp_replace(trim({x}, {_WS}), '{RULES.bullet}', ''), {_WS}), '\\s+', ' ', 'g')"


def _noise(x: str) -> str:
    return f"(trim({x}, {_WS}) = '' OR (length(trim({x}, {_WS})) < 8 AND NOT regexp_matches(trim({x}, {_WS}), '{RULES.code}')) OR {_any(f'trim({x}, {_WS})', RULES.noise)})"


def _topic(c: str) -> str:
    return f"(regexp_matches({c}, '{RULES.topic_code}') AND (regexp_matches({c}, '{RULES.media}') OR regexp_matches({c}, '{RULES.stamp}') OR (regexp_matches({c}, '{RULES.topic_code}\\s*$') AND NOT regexp_matches({c}, '{RULES.verb}'))))"


def _looks(c: str) -> str:
    """c is a cleaned text."""
    whole = f"CASE WHEN regexp_matches({c}, '{RULES.code}') THEN length({c}) >= 20 ELSE length({c}) <= {RULES.most_item} AND regexp_matches({c}, '{RULES.complete}') AND regexp_matches({c}, '{RULES.verb}') AND length({c}) >= 15 END"
    return f"(NOT {_noise(c)} AND NOT {_any(c, RULES.intro)} AND NOT {_topic(c)} AND {whole})"


_WALK = f"""RECURSIVE {_LINES}, tl AS (SELECT *, trim(line, {_WS}) AS t FROM line), pl AS (SELECT *, {_clean('t')} AS c FROM tl),
fl AS (SELECT *, {_any('t', RULES.section)} AS hd, {_any('t', RULES.end)} AS en, t = '' AS bl, {_any('t', RULES.intro)} AS it, regexp_matches(t, '{RULES.topics_header}') AS tp, regexp_matches(t, '{RULES.topic_code}\\s*$') AS te, regexp_matches(t, '{RULES.code}') AS cd, {_looks(_clean('c'))} AS lk,
  regexp_matches(t, '{RULES.bullet}') AS bu, regexp_matches(c, '{RULES.verb}') OR regexp_matches(c, '{RULES.code}') AS vb, {_any('t', RULES.intro)} OR {_noise('t')} OR {_topic('c')} AS sk,
  len(string_split(line, '&&&')) - 1 AS marks FROM pl),
pg AS (SELECT *, bu OR (lk AND vb) AS bg, CASE WHEN sum(marks) OVER (PARTITION BY doc_id) > 0 THEN 1 + coalesce(sum(marks) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS page FROM fl),
walk AS (SELECT DISTINCT doc_id, CAST(-1 AS BIGINT) AS line_no, 0 AS st, false AS saw, CAST(0 AS BIGINT) AS cs, 0 AS sec, 0 AS opn, 0 AS item, false AS head, false AS inside, false AS own FROM pg
  UNION ALL SELECT doc_id, line_no, CASE WHEN h THEN 1 WHEN outside THEN 0 ELSE eff END, CASE WHEN h THEN false ELSE saw1 END, cs1, sec + h::int, CASE WHEN h OR outside OR bl OR sk THEN 0 WHEN b OR cont THEN CASE WHEN cd THEN 2 ELSE 1 END ELSE opn END, item + b::int, h, NOT outside, b OR cont
  FROM (SELECT *, NOT h AND NOT outside AND NOT (bl OR sk) AND NOT b AND opn = 1 AND NOT en AS cont FROM (SELECT *, NOT h AND NOT outside AND NOT (bl OR sk) AND (bg OR (lk AND (opn <> 1 OR en))) AS b FROM (SELECT *, (eff = 0 OR brk) AND hd AS h, (eff = 0 OR brk) AND NOT hd AS outside FROM (SELECT *, eff = 2 AND ((hd AND line_no > cs1) OR (en AND NOT hd AND NOT (saw1 AND te))) AS brk FROM (
    SELECT pg.*, w.st, w.sec, w.opn, w.item, CASE WHEN w.st = 2 OR (w.st = 1 AND NOT (pg.bl OR pg.it)) THEN 2 ELSE w.st END AS eff, CASE WHEN w.st = 1 AND NOT (pg.bl OR pg.it) THEN pg.line_no ELSE w.cs END AS cs1, CASE WHEN w.st = 2 OR (w.st = 1 AND NOT (pg.bl OR pg.it)) THEN (w.st = 2 AND w.saw) OR pg.tp ELSE w.saw END AS saw1
    FROM walk w JOIN pg ON pg.doc_id = w.doc_id AND pg.line_no = w.line_no + 1)))))),
ln AS (SELECT w.doc_id, w.line_no, w.sec, w.item, w.head, w.own, pg.line, pg.t, pg.page FROM walk w JOIN pg ON pg.doc_id = w.doc_id AND pg.line_no = w.line_no WHERE w.inside),
rg AS (SELECT * FROM (SELECT doc_id, sec, min(t) FILTER (head) AS heading, min(line_no) AS first_line, trim(string_agg(line, chr(10) ORDER BY line_no), {_WS}) AS excerpt, count(*) AS n FROM ln GROUP BY ALL) WHERE length(excerpt) > length(heading) + 5),
raw AS (SELECT doc_id, sec, item, min(heading) AS heading, min(line_no) AS line_no, min(page) AS page, string_agg(t, ' ' ORDER BY line_no) AS raw FROM ln JOIN rg USING (doc_id, sec) WHERE own GROUP BY ALL),
cl AS (SELECT *, {_clean('raw')} AS text FROM raw), kp AS (SELECT *, row_number() OVER (PARTITION BY doc_id, trim(regexp_replace(lower(replace(text, '&&&', '')), '\\s+', ' ', 'g'), {_WS}) ORDER BY line_no) AS n FROM cl WHERE {_looks(_clean('text'))}),
objective AS (SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS integer) AS ordinal, replace(text, '&&&', '') AS text, heading, cast(line_no AS integer) AS line_no, cast(page AS BIGINT) AS page, nullif(regexp_extract(text, '{RULES.code}', 1), '') AS code,
  CASE WHEN length(text) > 500 OR len(string_split_regex(text, '\\.\\s+')) > 4 OR length(text) < 20 THEN 'low' WHEN regexp_matches(text, '{RULES.verb}') OR regexp_matches(text, '{RULES.code}') THEN 'high' ELSE 'medium' END AS confidence FROM kp WHERE n = 1)"""


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "documents")


@query(f"WITH {_WALK} SELECT doc_id, cast(row_number() OVER (PARTITION BY doc_id ORDER BY first_line) AS integer) AS place, heading, cast(first_line AS integer) AS first_line, n AS n_lines, md5(excerpt) AS excerpt_md5 FROM rg")
def objective_ranges(spark: SparkSession, d: str) -> DataFrame:
    """The ranges of lines that hold objectives."""
    found = o.objective_ranges(_docs(spark, d), RULES)
    excerpt = F.regexp_replace(F.array_join(F.transform("lines", lambda x: x["line"]), "\n"), r"^\s+|\s+$", "")
    place = F.size(F.collect_list("range_no").over(o.Window.partitionBy("doc_id").orderBy("range_no")))
    return found.select("doc_id", place.alias("place"), "heading", "first_line", F.size("lines").cast("bigint").alias("n_lines"), F.md5(excerpt).alias("excerpt_md5"))


@query(f"WITH {_WALK} SELECT * FROM objective")
def objectives(spark: SparkSession, d: str) -> DataFrame:
    """Objectives of every document, put together from lines, scored, numbered and without repeats."""
    return o.extracted(_docs(spark, d), RULES)


@query(f"WITH {_WALK}, parts AS (SELECT doc_id, string_agg(trim(replace(excerpt, '&&&', ''), {_WS}), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY first_line) AS e FROM rg GROUP BY ALL) SELECT doc_id, md5(e) AS excerpt_md5 FROM parts")
def review_excerpts(spark: SparkSession, d: str) -> DataFrame:
    return o.review_excerpts(_docs(spark, d), RULES).select("doc_id", F.md5("excerpt").alias("excerpt_md5"))


@query(f"WITH {_WALK}, per AS (SELECT documents.doc_id, coalesce(s, 0) AS sections, coalesce(n, 0) AS objectives, coalesce(t, '') AS texts FROM documents LEFT JOIN (SELECT doc_id, count(*) AS s FROM rg GROUP BY ALL) USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n, string_agg(text, chr(10) ORDER BY ordinal) AS t FROM objective GROUP BY ALL) USING (doc_id)) SELECT doc_id, sections, objectives, md5(texts) AS texts_md5 FROM per UNION ALL SELECT NULL, cast(sum(sections) AS BIGINT), cast(sum(objectives) AS BIGINT), md5('') FROM per")
def objective_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts and texts of each document, and the grand total."""
    return o.batch_report(_docs(spark, d), RULES).select("doc_id", "sections", "objectives", F.md5(F.array_join("texts", "\n")).alias("texts_md5"))


@query(f"WITH {_WALK} SELECT doc_id FROM documents WHERE source IS DISTINCT FROM 'src0' AND doc_id NOT IN (SELECT doc_id FROM objective) AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def objective_gate(spark: SparkSession, d: str) -> DataFrame:
    """Documents of all sources but one without objectives; those labelled as poor are allowed."""
    docs = _docs(spark, d).withColumn("kind", F.when(F.col("source").eqNullSafe("src0"), "faculty").otherwise("self_study"))
    return o.objective_gate(docs, "kind", v.table(spark, d, "labels").filter("quality = 0"), RULES)


@query(f"WITH {_WALK}, b AS (SELECT ln.doc_id, regexp_matches(ln.t, '{RULES.topics_header}') AS header, ({_any('ln.t', RULES.intro)} OR {_noise('ln.t')}) AS skip, {_topic(_clean('ln.t'))} AS topic FROM ln JOIN rg USING (doc_id, sec) WHERE NOT ln.head), k AS (SELECT doc_id, bool_or(header AND NOT skip) AND count(*) FILTER (NOT skip AND NOT header) > 0 AND count(*) FILTER (NOT skip AND NOT header AND NOT topic) = 0 AS topics_only FROM b GROUP BY ALL), n AS (SELECT doc_id, count(*) AS n, count(*) FILTER (confidence = 'low') AS low, bool_or(length(text) > 150 AND confidence <> 'high' AND code IS NULL) AS long FROM objective GROUP BY ALL) SELECT documents.doc_id, documents.doc_id IN (SELECT doc_id FROM rg) AND CASE WHEN n IS NULL THEN NOT coalesce(topics_only, false) ELSE (low > 0 AND low >= 0.5 * n) OR long END AS needs_review FROM documents LEFT JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)")
def objectives_to_review(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose objectives a reviewer should see: none found though ranges hold more than topics, many poor ones, or a run-on of over 150 characters."""
    docs = _docs(spark, d)
    ranges = stored(o.objective_ranges(docs, RULES))
    found = o.extracted_from(ranges, RULES).withColumn("coded", F.col("code").isNotNull())
    return needs_review(o.range_kinds(docs, RULES, ranges=ranges), found, "doc_id", run_on=150)
