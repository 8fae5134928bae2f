"""Whole answers composed from parts: the map of a course, exports with their options, the program's export, and what an audit reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covara.functions.scalar import described_label, topic_label
from covara.operators.items import in_module
from covara.operators.rollups import with_gaps
from covara.operators.screens import OBJECTIVE_COLUMNS, items_of, keywords_of
from covara.sources.exports import numbered

_CHUNK = ["document_id", "chunk_index"]


def _json(*columns: str | Column) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def map_payload(documents: DataFrame, chunks: DataFrame, links: DataFrame, media: DataFrame, captions: DataFrame, tags: DataFrame, objectives: DataFrame, competencies: DataFrame, topics: DataFrame) -> DataFrame:
    """The map of every course as rows (course_id, part, key, line): what the client of a course reads is its lines, and those without course, by part and key.

    documents (document_id, course_id, case_number, case_title); chunks (document_id, chunk_index, section); links (document_id, chunk_index, framework_id, confidence,
    status); media (document_id, chunk_index, asset_id, label, text, path), of which an official caption (document_id, label, text) replaces the text and of whose path
    only is told whether there is one; tags (document_id, chunk_index, place, keyword, definition), the first of a keyword counts; objectives (document_id, ordinal, code, text). The
    catalogs belong to all courses. A course's map is many small lines, never one value.
    """
    of = documents.select("document_id", "course_id")
    padded = lambda *c: F.array_join(F.array(*(F.lpad(F.col(x).cast("string"), 12, "0") for x in c)), "/")
    line = lambda rows, part, key, json: rows.select("course_id", F.lit(part).alias("part"), key.alias("key"), json.alias("line"))
    chunks, media, captions, tags, objectives = (df.repartition("document_id") for df in (chunks, media, captions, tags, objectives))  # all that follows meets by document, so this is the only shuffle of each

    # media and captions come below each other, not side by side: a join by label too would shuffle both again
    official = captions.select("document_id", "label", F.col("text").alias("_official"), F.lit(True).alias("_caption")).filter("label is not null")
    both = media.withColumn("_caption", F.lit(False)).unionByName(official, allowMissingColumns=True)
    both = both.withColumn("_official", F.when(F.col("label").isNotNull(), F.min("_official").over(Window.partitionBy("document_id", "label")))).filter("not _caption")
    assets = both.select(*_CHUNK, F.struct(F.col("asset_id").alias("id"), "label", F.coalesce("_official", "text").alias("text"), (F.coalesce("path", F.lit("")) != "").alias("has_file")).alias("asset"))
    assets = assets.groupBy(*_CHUNK).agg(F.array_sort(F.collect_set("asset")).alias("assets"))
    words = keywords_of(tags, _CHUNK, ["place"])
    goals = items_of(objectives, "document_id", ["ordinal"], "code", "text").select("document_id", F.transform("items", lambda x: F.struct(x["code"].alias("code"), x["text"].alias("text"))).alias("objectives"))
    parts = [
        line(documents, "documents", padded("document_id"), _json(F.col("document_id").alias("id"), "case_number", "case_title")),
        line(chunks.join(documents, "document_id"), "chunks", padded(*_CHUNK), _json(*_CHUNK, "section", "case_number", "case_title")),
        line(links.join(of, "document_id"), "alignments", padded(*_CHUNK, "framework_id"), _json(*_CHUNK, "framework_id", F.col("confidence").cast("string").alias("confidence"), "status")),
        line(assets.join(of, "document_id"), "media", padded(*_CHUNK), _json(*_CHUNK, "assets")),
        line(words.join(of, "document_id"), "keywords", padded(*_CHUNK), _json(*_CHUNK, "keywords")),
        line(goals.join(of, "document_id"), "objectives", padded("document_id"), _json("document_id", "objectives")),
        line(competencies.withColumn("course_id", F.lit(None).cast(documents.schema["course_id"].dataType)), "aamc", F.col("stable_id").cast("string"), _json("stable_id", "sub_id", "domain", "description")),
        line(topics.withColumn("course_id", F.lit(None).cast(documents.schema["course_id"].dataType)), "usmle", F.col("stable_id").cast("string"), _json("stable_id", F.col("system").alias("domain"), "subdomain")),
    ]
    return reduce(DataFrame.unionByName, parts)


def course_payload(distributions: DataFrame, cells: DataFrame, recent: DataFrame, percents: DataFrame) -> DataFrame:
    """What a course's page shows besides its counts, as rows (course_id, part, place, line), places from 0 in each course and part; never one value for a course.

    distributions (course_id, framework, addressed, total), cells (course_id, case_number, system, status), recent (course_id, rank, document_id, framework_id), percents (course_id, system, percent).
    """
    text = lambda *c: F.concat_ws(":", *(F.col(x).cast("string") for x in c))
    out = []
    for part, rows, order, line in (
        ("distributions", distributions, ["framework"], F.concat("framework", F.lit(":"), "addressed", F.lit("/"), "total")),
        ("heatmap", cells, ["case_number", "system"], text("case_number", "system", "status")),
        ("recent", recent, ["rank"], text("document_id", "framework_id")),
        ("percents", percents, ["system"], text("system", "percent")),
    ):
        placed = numbered(rows.select("course_id", *order, line.alias("line")), order, group="course_id")
        out.append(placed.select("course_id", F.lit(part).alias("part"), F.col("line_no").alias("place"), "line"))
    return reduce(DataFrame.unionByName, out)


def course_export(rows: DataFrame) -> DataFrame:
    """The export of every course as numbered lines: course_id, line_no and line, in order of framework, system, topic and stable_id."""
    line = F.concat_ws("|", "system", "topic", F.col("docs").cast("string"), "level")
    order = ["framework", "system", "topic", "stable_id"]
    return numbered(rows.select("course_id", *order, line.alias("line")), order, group="course_id").select("course_id", "line_no", "line")


def objectives_export(rows: DataFrame, modules: DataFrame, course: int | None = None, module: str = "all") -> DataFrame:
    """The export's columns and line_no, from 0 without gaps, of the objectives (OBJECTIVE_COLUMNS and course_id) of a course, of a module, or of all.

    modules (course_id, module) name the courses of modules; `Unassigned` takes those without one, an unknown module none. Both options may be given.
    """
    chosen = in_module(rows if course is None else rows.filter(F.col("course_id") == course), modules, module)
    return numbered(chosen.select(*OBJECTIVE_COLUMNS), ["course_code", "case_number", "ordinal", "objective_id"])


def program_export(facts: DataFrame, topics: DataFrame, competencies: DataFrame) -> DataFrame:
    """framework, system, topic, docs and courses of every entry of both catalogs, one export below the other; gaps have zeros.

    facts (framework, framework_id, document_id, course_id) are the links that count; topics (stable_id, system, subdomain) are the first catalog, competencies (stable_id,
    sub_id, domain, description) the second, and a link counts in the catalog of its framework only.
    """
    def one(name: str, catalog: DataFrame, system: str, topic: Column) -> DataFrame:
        counts = facts.filter(F.col("framework") == name).groupBy(F.col("framework_id").alias("stable_id")).agg(F.count_distinct("document_id").alias("docs"), F.count_distinct("course_id").alias("courses"))
        return with_gaps(catalog, counts, ["stable_id"]).select(F.lit(name).alias("framework"), F.col(system).alias("system"), topic.alias("topic"), "docs", "courses")

    first = one("USMLE", topics, "system", topic_label(F.col("system"), F.col("subdomain")))
    return first.unionByName(one("AAMC", competencies, "domain", described_label(F.col("sub_id"), F.col("stable_id").cast("string"), F.col("description"))))


def audit_issues(status: DataFrame, declared: DataFrame, owner: str = "document_id") -> DataFrame:
    """kind, name and detail: the number of documents in each state (`total`), the partial ones with their state (`partial`), and catalogs whose declared and counted vectors differ (`mismatch`).

    status as pipeline_status gives it; declared (name, declared, counted). An audit passes if there is no row but totals.
    """
    group = F.when(F.startswith("state", F.lit("partial")), "partial").otherwise(F.col("state"))
    totals = status.groupBy(group.alias("name")).agg(F.count("*").cast("string").alias("detail")).select(F.lit("total").alias("kind"), "name", "detail")
    partial = status.filter(F.startswith("state", F.lit("partial"))).select(F.lit("partial").alias("kind"), F.col(owner).cast("string").alias("name"), F.col("state").alias("detail"))
    differ = declared.filter("declared > 0 and declared <> counted").select(F.lit("mismatch").alias("kind"), "name", F.concat(F.col("counted").cast("string"), F.lit(" of "), F.col("declared").cast("string")).alias("detail"))
    return totals.unionByName(partial).unionByName(differ)
