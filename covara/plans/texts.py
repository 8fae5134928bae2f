"""Text queries over documents, benchmark and conversations. Patterns are parameters and fit these tables: short lines are headings, `|` parts pages and contents lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covara.operators import lines as t
from covara.plans.registered import query
from covara.sources import views as v

_LINES = r"line AS (SELECT doc_id, unnest(range(len(l))) AS line_no, unnest(l) AS line FROM (SELECT doc_id, string_split_regex(text, '\r?\n') AS l FROM documents WHERE text IS NOT NULL))"
_SECTIONS = f"{_LINES}, marked AS (SELECT *, coalesce(length(trim(line, ' ')) BETWEEN 1 AND 40, false) AS heading FROM line), sectioned AS (SELECT *, cast(sum(heading::int) OVER w AS bigint) AS section_no, coalesce(last_value(CASE WHEN heading THEN trim(line, ' ') END IGNORE NULLS) OVER w, CASE WHEN bool_or(heading) OVER (PARTITION BY doc_id) THEN 'Introduction' ELSE 'Document' END) AS section FROM marked WINDOW w AS (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING))"


def _lines(spark: SparkSession, d: str) -> DataFrame:
    return t.lines_of(v.table(spark, d, "documents").filter("text is not null"))


def _sections(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d)
    return t.with_sections(rows, F.length(F.trim("line")).between(1, 40))


@query(f"WITH {_LINES} SELECT doc_id, count(*) AS n_lines, sum(length(line))::bigint AS n_chars FROM line GROUP BY ALL")
def text_lines(spark: SparkSession, d: str) -> DataFrame:
    return _lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query(f"WITH {_SECTIONS} SELECT doc_id, section_no, min(section) AS section, count(*) AS n_lines FROM sectioned GROUP BY ALL")
def text_sections(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d).groupBy("doc_id", "section_no").agg(F.min("section").alias("section"), F.count("*").alias("n_lines"))


@query(f"WITH {_LINES}, hits AS (SELECT *, line_no - lag(line_no) OVER (PARTITION BY doc_id ORDER BY line_no) > 2 AS jump FROM line WHERE line_no < 300 AND contains(line, '|')), runs AS (SELECT *, sum(coalesce(jump, false)::int) OVER (PARTITION BY doc_id ORDER BY line_no) AS cluster FROM hits), gone AS (SELECT doc_id, line_no, count(*) OVER (PARTITION BY doc_id) AS n FROM runs WHERE cluster = 0) SELECT line.doc_id, count(*) AS n_lines FROM line LEFT JOIN gone ON line.doc_id = gone.doc_id AND line.line_no = gone.line_no AND n >= 3 WHERE gone.doc_id IS NULL GROUP BY ALL")
def contents_strip(spark: SparkSession, d: str) -> DataFrame:
    return t.without_contents(_lines(spark, d), r"\|").groupBy("doc_id").agg(F.count("*").alias("n_lines"))


@query(f"WITH {_LINES}, marks AS (SELECT *, length(line) - length(replace(line, '|', '')) AS n FROM line), paged AS (SELECT *, CASE WHEN sum(n) OVER (PARTITION BY doc_id) > 0 THEN 1 + coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS page FROM marks) SELECT doc_id, cast(page AS bigint) AS page, count(*) AS n_lines FROM paged GROUP BY ALL")
def text_pages(spark: SparkSession, d: str) -> DataFrame:
    return t.with_pages(_lines(spark, d), "|").groupBy("doc_id", "page").agg(F.count("*").alias("n_lines"))


@query(f"WITH {_LINES}, units AS (SELECT doc_id, unnest(list_filter(string_split(regexp_replace(line, '([.!?])[ \\t\\n\\x0B\\f\\r]+', '\\1' || chr(1), 'g'), chr(1)), lambda u: trim(u, ' ') <> '')) AS sentence FROM line) SELECT doc_id, count(*) AS n_sentences, max(length(sentence)) AS longest FROM units GROUP BY ALL")
def text_sentences(spark: SparkSession, d: str) -> DataFrame:
    return t.sentences(_lines(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("sentence")).cast("bigint").alias("longest"))


_MERGED = f"{_SECTIONS}, part AS (SELECT doc_id, section_no, min(section) AS section, string_agg(line, ' ' ORDER BY line_no) AS content FROM sectioned GROUP BY ALL), counted AS (SELECT *, len(list_filter(string_split(content, ' '), lambda w: w <> '')) AS words FROM part), merged AS (SELECT *, greatest(sum((words >= 40)::int) OVER (PARTITION BY doc_id ORDER BY section_no ROWS UNBOUNDED PRECEDING), 1) AS merged_no FROM counted)"


@query(f"WITH {_MERGED} SELECT doc_id, cast(merged_no AS bigint) AS merged_no, md5(string_agg(content, ' ' ORDER BY section_no)) AS content_md5 FROM merged GROUP BY ALL")
def subfloor_merge(spark: SparkSession, d: str) -> DataFrame:
    """Sections under 40 words joined to the one before."""
    pieces = F.array_sort(F.collect_list(F.struct("line_no", "line")))
    parts = _sections(spark, d).groupBy("doc_id", "section_no").agg(F.array_join(F.transform(pieces, lambda x: x["line"]), " ").alias("content"))
    words = F.size(F.filter(F.split("content", " "), lambda w: w != ""))
    return t.merge_small(parts, ["doc_id"], "section_no", "content", words).select("doc_id", "merged_no", F.md5("content").alias("content_md5"))


_LABEL = "(?:with|from|nicht|para|pour) [a-z]+"
_FIGURES = f"{_LINES}, labelled AS (SELECT doc_id, line_no, lower(regexp_extract(line, '(?:with|from|nicht|para|pour) [a-z]+')) AS label FROM line), named AS (SELECT *, min(line_no) OVER (PARTITION BY doc_id, label) AS first_no FROM labelled WHERE label <> '')"


@query(f"WITH {_FIGURES} SELECT doc_id, cast(line_no AS integer) AS line_no, label, cast(dense_rank() OVER (PARTITION BY doc_id ORDER BY first_no) AS integer) AS ordinal FROM named")
def label_registry(spark: SparkSession, d: str) -> DataFrame:
    return t.registry(_lines(spark, d), _LABEL).select("doc_id", "line_no", "label", "ordinal")


@query(f"WITH {_LINES}, a AS (SELECT doc_id, line_no FROM line WHERE length(line) BETWEEN 1 AND 30), b AS (SELECT doc_id, line_no, length(line) AS size FROM line WHERE length(line) >= 200) SELECT a.doc_id, cast(a.line_no AS integer) AS line_no, arg_max(cast(b.line_no AS integer), (size, -b.line_no)) AS near, count(*) AS candidates FROM a JOIN b ON a.doc_id = b.doc_id AND b.line_no BETWEEN a.line_no - 6 AND a.line_no + 6 GROUP BY ALL")
def band_join(spark: SparkSession, d: str) -> DataFrame:
    """The longest of the long lines at most six lines from each short line, the first of equals."""
    rows = _lines(spark, d).withColumn("size", F.length("line"))
    b = rows.filter("size >= 200").select("doc_id", "line_no", "size", F.col("line_no").alias("near"))
    return t.band_join(rows.filter("size between 1 and 30").select("doc_id", "line_no"), b, "doc_id", "line_no", 6, F.struct("size", -F.col("near")), "near")


STOP = ("thing", "thtion", "thble")
_WORDS_OF = lambda x: f"list_distinct(list_filter(string_split_regex(lower({x}), '[^a-z0-9_]+'), lambda w: length(w) >= 5 AND w NOT IN {STOP}))"
_HITS = f"node AS (SELECT item_id AS node, unnest({_WORDS_OF('text')}) AS word FROM benchmark), turn AS (SELECT conv_id * 1000 + turn AS chunk, unnest({_WORDS_OF('text')}) AS word FROM conversations), hits AS (SELECT node, chunk, count(*) AS hits FROM node JOIN turn USING (word) GROUP BY ALL)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    return v.table(spark, d, "conversations").selectExpr("conv_id * 1000 + turn chunk", "text content")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return t.keyword_hits(v.table(spark, d, "benchmark").selectExpr("item_id node", "text label"), _turns(spark, d), stop=STOP)


@query(f"WITH {_HITS} SELECT * FROM hits")
def lexical_hits(spark: SparkSession, d: str) -> DataFrame:
    return _hits(spark, d)


@query(f"WITH {_HITS} SELECT node, count(*) AS chunks, arg_min(chunk, (-hits, chunk)) AS best_chunk, max(hits) AS hits FROM hits GROUP BY ALL")
def gap_triage(spark: SparkSession, d: str) -> DataFrame:
    return t.gap_triage(_hits(spark, d))


@query("SELECT conv_id, string_agg('[' || (turn + 1) || '] ' || role || ': ' || substr(text, 1, 120), chr(10) ORDER BY turn) AS context FROM conversations GROUP BY ALL")
def ordered_context(spark: SparkSession, d: str) -> DataFrame:
    """The turns of each conversation as a numbered list of excerpts."""
    line = F.concat(F.lit("["), (F.col("turn") + 1).cast("string"), F.lit("] "), "role", F.lit(": "), F.substring("text", 1, 120))
    pieces = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return v.table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(pieces, lambda x: x["line"]), "\n").alias("context"))


_FIRST = "list_filter(string_split_regex(lower(label), '[^a-z0-9_]+'), lambda w: list_contains(b.words, w))[1]"  # list_distinct keeps no order


@query(f"WITH gap AS (SELECT item_id AS node, text AS label, {_WORDS_OF('text')} AS k FROM benchmark WHERE item_id NOT IN (SELECT framework_id FROM live WHERE chunk_index = 1 AND framework_id IS NOT NULL)), word AS (SELECT node, unnest(k) AS word FROM gap), turn AS (SELECT conv_id * 1000 + turn AS chunk, unnest({_WORDS_OF('text')}) AS word FROM conversations), m AS (SELECT node, chunk, word FROM word JOIN turn USING (word)), per AS (SELECT node, chunk, count(*) AS hits, list(word) AS words FROM m GROUP BY ALL), b AS (SELECT node, arg_min(chunk, (-hits, chunk)) AS chunk, arg_min(words, (-hits, chunk)) AS words FROM per GROUP BY ALL), u AS (SELECT node, array_to_string(list_sort(list(DISTINCT word)), ',') AS words FROM m GROUP BY ALL), e AS (SELECT b.node, u.words, b.chunk, text, {_FIRST} AS word, length(regexp_extract(lower(text), '(?s)^(.*?)\\b' || {_FIRST} || '\\b', 1)) + 1 AS spot FROM b JOIN u USING (node) JOIN gap USING (node) JOIN conversations ON conv_id * 1000 + turn = b.chunk) SELECT node, words, chunk, md5(CASE WHEN spot > 61 THEN '…' ELSE '' END || substr(text, greatest(1, spot - 60), spot + length(word) + 60 - greatest(1, spot - 60)) || CASE WHEN spot + length(word) + 60 <= length(text) THEN '…' ELSE '' END) AS excerpt_md5 FROM e")
def gap_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Unlinked items whose keywords turns hold, with the best turn and an excerpt of it; links of first chunks count here."""
    nodes = v.table(spark, d, "benchmark").selectExpr("item_id node", "text label")
    linked = v.live_links(spark, d).filter("chunk_index = 1").select(F.col("framework_id").alias("node"))
    return t.gap_candidates(nodes, linked, _turns(spark, d), stop=STOP).select("node", F.array_join("words", ",").alias("words"), "chunk", F.md5("excerpt").alias("excerpt_md5"))


@query(f"WITH {_LINES}, a AS (SELECT doc_id, line_no, lower(line) AS label FROM line WHERE length(line) BETWEEN 1 AND 30), b AS (SELECT doc_id, line_no, length(line) AS size FROM line WHERE length(line) >= 200), m AS (SELECT a.doc_id, label, a.line_no AS spot, b.line_no AS image, size FROM a JOIN b ON a.doc_id = b.doc_id AND b.line_no BETWEEN a.line_no - 6 AND a.line_no + 6) SELECT doc_id, label, cast(arg_min(image, (-size, spot, image)) AS integer) AS image, max(size) AS size FROM m GROUP BY ALL")
def label_images(spark: SparkSession, d: str) -> DataFrame:
    """The longest line near any mention of each short line; long lines stand for images."""
    rows = _lines(spark, d)
    labels = rows.filter(F.length("line").between(1, 30)).select("doc_id", "line_no", F.lower("line").alias("label"))
    images = rows.select("doc_id", "line_no", F.col("line_no").alias("image"), F.length("line").cast("bigint").alias("size"))
    return t.largest_per_label(labels, images, "doc_id", "line_no", least=200)
