"""A registry of the figures and videos that texts name, with captions, and what an audit asks of it. Patterns are arguments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covara.functions.scalar import clean, extraction_scope


@dataclass(frozen=True)
class FigureRules:
    """The five kinds of label lines, and which lines after a label are its caption."""

    answer: str = r"(?i)^Answer\s+(?:Image|Figure)\s*(?:\d+[A-Z]?)?\s*:?\s*(.*)$"
    answer_prefix: str = r"(?i)^Answer\s+(?:Image|Figure)\s*"
    answer_name: str = "Answer Image "
    figure: str = r"(?i)^(?:FIGURE|Figure)\s+(\d+(?:\.\d+)?[A-Z]?)\s*:?\s*(.*)$"
    figure_name: str = "Figure "
    provided: str = r"(?i)^Provided image\s*:?\s*(.*)$"
    provided_name: str = "Provided image"
    video: str = r"(?i)(?:https?://)?(?:www\.)?(?:youtube\.com/watch\?v=|youtu\.be/)([\w-]+)"
    video_base: str = "https://youtu.be/"
    watch: str = r"(?i)Watch this video"
    watch_name: str = "Watch this video"
    address: str = r"(?i)https?://\S+"
    explains: str = r"(?i)^(Rationale|Explanation|Clinician Educators|Faculty contacts)"
    capitals: str = r"^[A-Z0-9][A-Z0-9\s/-]{4,}$"
    long_line: int = 20
    least_caption: int = 8
    most_caption: int = 2000
    near: int = 3
    most_section: int = 119


def figure_registry(docs: DataFrame, rules: FigureRules = FigureRules(), key: str = "doc_id") -> DataFrame:
    """key, line_no, kind, label, section, has_caption, text, source_index and url of each label line of docs (key, text).

    Lines are those with text, numbered anew. section is the first of the three lines before that is short. Answer images
    are numbered in order, figures by the first line with their label, so that repeats share a number.
    A caption is what stands after the label and the next three lines that are long, in capitals or explanations,
    up to the next label.
    """
    raw = docs.filter("text is not null").select(key, F.posexplode(F.split("text", r"\n")).alias("n", "line")).withColumn("line", clean(F.col("line"))).filter("line <> ''")
    in_order = Window.partitionBy(key).orderBy("n")
    lines = raw.withColumn("line_no", F.row_number().over(in_order) - 1)
    line = F.col("line")
    kind = F.when(line.rlike(rules.video) | line.rlike(rules.watch), "video").when(line.rlike(rules.answer), "answer_image").when(line.rlike(rules.figure), "figure").when(line.rlike(rules.provided), "provided_image")
    lines = lines.withColumn("kind", kind)
    before = F.collect_list("line").over(in_order.rowsBetween(-rules.near, -1))
    after = F.collect_list(F.struct("line", F.col("kind").isNotNull().alias("label"))).over(in_order.rowsBetween(1, rules.near))
    rows = lines.withColumns({"before": before, "after": after, "next": F.lead("line").over(in_order)}).filter("kind is not null")

    found = lambda text: F.nullif(F.regexp_extract(text, rules.address, 0), F.lit(""))
    named = F.nullif(F.regexp_extract("line", rules.video, 1), F.lit(""))
    url = F.when(line.rlike(rules.video), F.coalesce(found(line), F.concat(F.lit(rules.video_base), named))).otherwise(found(F.concat_ws(" ", "line", "next")))
    tail = clean(F.when(F.col("kind") == "answer_image", F.regexp_extract("line", rules.answer, 1)).when(F.col("kind") == "figure", F.regexp_extract("line", rules.figure, 2)).otherwise(F.regexp_extract("line", rules.provided, 1)))
    stop = F.array_position(F.transform("after", lambda x: x["label"]), True)
    near = F.when(stop > 0, F.slice("after", 1, (stop - 1).cast("int"))).otherwise(F.col("after"))
    told = F.filter(F.transform(near, lambda x: x["line"]), lambda x: x.rlike(rules.explains) | x.rlike(rules.capitals) | (F.length(x) >= rules.long_line))
    parts = F.concat(F.when(F.length(tail) >= rules.least_caption, F.array(tail)).otherwise(F.array().cast("array<string>")), told)
    caption = F.when(F.size(parts) > 0, F.substring(clean(F.array_join(parts, " ")), 1, rules.most_caption))
    answer = clean(F.regexp_replace(clean(F.regexp_replace(F.split_part("line", F.lit(":"), F.lit(1)), r"(?U)\s+", " ")), rules.answer_prefix, rules.answer_name))
    is_video = F.col("kind") == "video"
    rows = rows.withColumn("url", F.when(is_video, url))
    label = (
        F.when(is_video, F.coalesce(F.concat(F.lit("Video: "), "url"), F.lit(rules.watch_name))).when(F.col("kind") == "answer_image", answer)
        .when(F.col("kind") == "figure", F.concat(F.lit(rules.figure_name), F.regexp_extract("line", rules.figure, 1))).otherwise(F.lit(rules.provided_name))
    )
    rows = rows.withColumns({"label": label, "text": F.when(is_video, F.col("url")).otherwise(caption), "section": F.get(F.filter("before", lambda x: F.length(x) <= rules.most_section), F.lit(0))})
    rows = rows.withColumn("first_no", F.min("line_no").over(Window.partitionBy(key, "kind", "label")))
    place = Window.partitionBy(key, "kind")
    number = F.when(F.col("kind") == "answer_image", F.row_number().over(place.orderBy("line_no"))).when(F.col("kind") == "figure", F.dense_rank().over(place.orderBy("first_no")))
    has = F.when(is_video, F.col("url").isNotNull()).otherwise(F.coalesce(F.length("text") >= rules.least_caption, F.lit(False)))
    return rows.select(key, "line_no", "kind", "label", "section", has.alias("has_caption"), "text", number.alias("source_index"), "url")


def with_scope(registry: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """Labels with extraction_scope, which figures of their document's file are taken out; documents (key, kind, file_type). A label without document has none."""
    return registry.join(documents.select(key, extraction_scope(F.col("kind"), F.col("file_type")).alias("extraction_scope")), key, "left")


def mentioned(content: Column, label: Column) -> Column:
    """Whether a text names a label: as it is in any case, or an answer image or figure by its number."""
    text, name = F.lower(content), clean(F.regexp_replace(F.lower(label), r"(?U)\s+", " "))
    answer = F.regexp_extract(name, r"answer\s+(?:image|figure)\s*(\d+[a-z]?)", 1)
    figure = F.regexp_extract(name, r"figure\s+(\d+[a-z]?)", 1)
    by_answer = F.regexp_like(text, F.concat(F.lit(r"answer\s+(?:image|figure)\s*"), answer))
    by_figure = F.regexp_like(text, F.concat(F.lit(r"figure\s+"), figure, F.lit(r"\b")))
    return F.contains(text, name) | F.when(answer != "", by_answer).when(figure != "", by_figure).otherwise(F.lit(False))


def mentions(chunks: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, chunk_index and label of the labels that each chunk of their document names.

    A document's distinct labels travel as one array to its chunks, so that no pair becomes a row before it is found.
    """
    of_document = labels.groupBy(key).agg(F.array_sort(F.collect_set("label")).alias("labels"))
    rows = chunks.join(of_document, key)
    return rows.select(key, "chunk_index", F.explode(F.filter("labels", lambda x: mentioned(F.col("content"), x))).alias("label"))


def figure_gate(registry: DataFrame, documents: DataFrame, files: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each document (key, kind): labels, answer images, self-study figures known as images only, and failures.

    A failure is an answer image of a faculty guide with neither text nor a file (key, source_index, path).
    """
    rows = registry.withColumnRenamed("kind", "reference").join(documents.select(key, "kind"), key).join(files.select(key, "source_index", "path"), [key, "source_index"], "left")
    bare = (F.coalesce(clean(F.col("text")), F.lit("")) == "") & (F.coalesce(F.col("path"), F.lit("")) == "")
    failed = (F.col("reference") == "answer_image") & (F.col("kind") == "faculty") & bare
    image_only = (F.col("reference") == "figure") & ~F.col("has_caption") & (F.col("kind") == "self_study")
    counted = rows.groupBy(key).agg(
        F.count("*").alias("labels"), F.count_if(F.col("reference") == "answer_image").alias("answer_images"), F.count_if(image_only).alias("image_only"),
        F.transform(F.array_sort(F.collect_list(F.when(failed, F.struct("line_no", "label")))), lambda x: F.concat(x["label"], F.lit(" missing caption text and extracted file"))).alias("failures"),
    )
    out = documents.select(key, "kind").join(counted, key, "left").fillna(0, ["labels", "answer_images", "image_only"])
    return out.withColumn("failures", F.coalesce("failures", F.array().cast("array<string>")))
