"""Results as a screen shows them: summaries of courses and systems, nested keywords and items, outcomes of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covara.functions.scalar import locator, percent
from covara.operators.rollups import documents_per_topic, link_statistics, with_gaps


def course_summary(courses: DataFrame, documents: DataFrame, links: DataFrame, rows: DataFrame) -> DataFrame:
    """One row for each course: its documents, link statistics, and topics of its catalog that documents address.

    rows are topic rows (course_id, docs). A course without documents, links or topics has zeros and a null average.
    """
    per_document = documents.groupBy("course_id").agg(F.count("*").alias("documents"))
    topics = rows.groupBy("course_id").agg(F.count("*").alias("topics"), F.count_if(F.col("docs") > 0).alias("addressed"))
    stats = link_statistics(links, "course_id")
    out = with_gaps(courses, per_document, ["course_id"])
    out = with_gaps(out, stats.drop("average_confidence"), ["course_id"]).join(stats.select("course_id", "average_confidence"), "course_id", "left")
    return with_gaps(out, topics, ["course_id"]).withColumn("percent", percent(F.col("addressed"), F.col("topics")))


def landing_state(summary: DataFrame) -> DataFrame:
    """`pending` while a course has documents and no link yet, `empty` without documents, else `ready`."""
    return summary.withColumn("state", F.when(F.col("total") > 0, "ready").when(F.col("documents") > 0, "pending").otherwise("empty"))


def system_summary(facts: DataFrame, topics: DataFrame) -> DataFrame:
    """One row for each system: size, addressed topics, courses that touch it, and the topic with most documents."""
    sizes = topics.groupBy("system").agg(F.count("*").alias("topics"))
    docs = documents_per_topic(facts, "system")
    best = F.min(F.struct((-F.col("docs")).alias("less"), "framework_id"))
    touched = docs.groupBy("system").agg(F.count("*").alias("addressed"), best.alias("best"))
    courses = facts.select("system", "course_id").distinct().groupBy("system").agg(F.count("*").alias("courses"))
    out = sizes.join(touched, "system", "left").join(courses, "system", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("addressed", "courses")}
    return out.withColumns({**zero, "best_topic": F.col("best.framework_id"), "best_docs": F.coalesce(-F.col("best.less"), F.lit(0))}).drop("best")


def keywords_of(tags: DataFrame, chunk: str | list[str], order: list[str]) -> DataFrame:
    """Keywords of each chunk (a column or several) as an array of (keyword, definition), sorted by keyword.

    Of a chunk's rows for one keyword the first in order gives the definition, be it null; among ties
    null, then the least. Rows without chunk or keyword are dropped; a chunk of several columns is missing where all are null.
    """
    keys = [chunk] if isinstance(chunk, str) else chunk
    known = reduce(Column.__or__, (F.col(c).isNotNull() for c in keys))
    named = tags.filter(known & (F.coalesce("keyword", F.lit("")) != ""))
    first = named.groupBy(*keys, "keyword").agg(F.min(F.struct(*order, "definition"))["definition"].alias("definition"))
    return first.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("keyword", "definition"))).alias("keywords"))


def items_of(items: DataFrame, key: str, order: list[str], *columns: str) -> DataFrame:
    """Items of each key as an array of structs in order."""
    return items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *columns))).alias("items"))


def map_documents(documents: DataFrame, facts: DataFrame, items: DataFrame) -> DataFrame:
    """Every document with the chunks, topics and items that a map of its course shows, zero where it has none."""
    chunks = facts.groupBy("document_id").agg(F.count_distinct("chunk_index").alias("chunks"), F.count_distinct("framework_id").alias("topics"))
    return with_gaps(with_gaps(documents, chunks, ["document_id"]), items.groupBy("document_id").agg(F.count("*").alias("items")), ["document_id"])


def context_before(lines: DataFrame, key: str, most: int = 119, back: int = 3) -> DataFrame:
    """Adds context: the first of the `back` lines before a line that has at most `most` characters."""
    before = F.collect_list("line").over(Window.partitionBy(key).orderBy("line_no").rowsBetween(-back, -1))
    return lines.withColumn("context", F.get(F.filter(before, lambda x: F.length(x) <= most), F.lit(0)))


def unprocessed(documents: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """Documents that no mark names; a null key is never processed."""
    return documents.join(marks.select(key).distinct(), key, "left_anti")


def run_summary(attempts: DataFrame, *keys: str) -> DataFrame:
    """attempts have an error, null where all went well. Counts by key, and whether the run must report failure.

    A failed document doesn't stop the others; every kind of error is named once, in order.
    """
    return attempts.groupBy(*keys).agg(
        F.count("*").alias("attempted"), F.count_if(F.col("error").isNull()).alias("succeeded"), F.count("error").alias("failed"),
        F.array_join(F.array_sort(F.collect_set("error")), ", ").alias("errors"), (F.count("error") > 0).alias("must_fail"),
    )


def backfilled(assets: DataFrame, path: str) -> DataFrame:
    """Paths as locators, and what became of each: rewritten, unchanged, missing or unrecognised (left as it is)."""
    found = locator(F.col(path))
    what = F.when(F.col(path).isNull(), "missing").when(found.isNull(), "unrecognised").when(found == F.col(path), "unchanged").otherwise("rewritten")
    return assets.withColumns({"outcome": what, path: F.coalesce(found, path)})


def require_at_most(rows: DataFrame, most: int) -> DataFrame:
    """The rows, or an error where there are more than allowed; never a part of them."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows")
    return rows


def linked_side(links: DataFrame, wanted: str, condition: Column | None = None) -> DataFrame:
    """Distinct values of one side of the links that meet the condition on the other; all without a condition."""
    return (links if condition is None else links.filter(condition)).select(wanted).filter(F.col(wanted).isNotNull()).distinct()


#: The columns of the export of objectives.
OBJECTIVE_COLUMNS = (
    "module", "course_code", "course_title", "case_number", "case_title", "ordinal", "objective_code", "objective", "section", "extraction_method", "confidence", "source_filename", "source_page", "source_excerpt", "objective_id", "document_id",
)


def activityless(rolled: DataFrame, keys: list[str]) -> DataFrame:
    """Whether each key has no activity but Unassigned; rolled as of rollup_activities."""
    return rolled.groupBy(*keys).agg((F.count_if(F.col("activity") != "Unassigned") == 0).alias("activityless"))


def course_payload(courses: DataFrame, distributions: DataFrame, cells: DataFrame, recent: DataFrame, percents: DataFrame) -> DataFrame:
    """One row for each course: its distributions, heatmap cells, recent links and percents of domains as ordered text lists."""
    of_course = lambda rows, order, text, name: rows.groupBy("course_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("_text")))), lambda x: x["_text"]), ",").alias(name))
    t = lambda *c: F.concat_ws(":", *(F.col(x).cast("string") for x in c))
    out = courses.select("course_id")
    for rows, order, text, name in (
        (distributions, ["framework"], F.concat("framework", F.lit(":"), "addressed", F.lit("/"), "total"), "distributions"),
        (cells, ["case_number", "system"], t("case_number", "system", "status"), "heatmap"),
        (recent, ["rank"], t("document_id", "framework_id"), "recent"),
        (percents, ["system"], t("system", "percent"), "percents"),
    ):
        out = out.join(of_course(rows, order, text, name), "course_id", "left")
    return out


def map_media(documents: DataFrame, links: DataFrame, assets: DataFrame) -> DataFrame:
    """Distinct assets (asset_id, label) of each chunk (document_id, chunk_index) of each course."""
    rows = links.join(documents.select("document_id", "course_id"), "document_id").join(assets, "asset_id")
    return rows.groupBy("course_id", "document_id", "chunk_index").agg(F.array_sort(F.collect_set(F.struct("asset_id", "label"))).alias("assets"))


def objectives_summary(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Counts of each key's objectives by method, and by case with the title of its first row. Only rows that say so count as found by pattern."""
    method = F.col("extraction_method")
    cases = rows.groupBy(key, "case_number").agg(F.count("*").alias("count"), F.min_by("case_title", F.struct(*order)).alias("case_title"), F.count_if(method == "regex").alias("regex"), F.count_if(method == "llm_cleanup").alias("llm"))
    listed = F.array_sort(F.collect_list(F.struct("case_number", "case_title", "count")))
    return cases.groupBy(key).agg(F.sum("count").alias("total"), F.sum("regex").alias("regex_count"), F.sum("llm").alias("llm_count"), listed.alias("by_case"))
