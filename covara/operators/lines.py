"""Corpus text work on lines: sections, pages, sentences, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEGMENT_LINES = 4096


def lines_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each line (CRLF or LF), numbered from 0."""
    return docs.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("line_no", "line"))


def in_order(key: str = "doc_id") -> Window:
    return Window.partitionBy(key).orderBy("line_no")


def so_far(key: str = "doc_id") -> Window:
    return in_order(key).rowsBetween(Window.unboundedPreceding, 0)


def running(lines: DataFrame, key: str, sums: dict[str, Column], lasts: dict[str, Column], segment_lines: int = SEGMENT_LINES) -> DataFrame:
    """lines (key, line_no) with, for each of sums, its sum up to the line, and its sum over the document as total_<name>; and for each of lasts its last value that is not null up to the line.

    A document's lines meet by segments only: each is summed up, and what comes before it is carried on from those few numbers, so a long document spreads over tasks.
    """
    cut = lines.withColumn("_segment", F.expr(f"line_no div {segment_lines}")).withColumns({f"_s_{k}": c.cast("bigint") for k, c in sums.items()} | {f"_l_{k}": c for k, c in lasts.items()})
    per = cut.groupBy(key, "_segment").agg(*(F.sum(f"_s_{k}").alias(f"_n_{k}") for k in sums), *(F.max_by(f"_l_{k}", F.when(F.col(f"_l_{k}").isNotNull(), F.col("line_no"))).alias(f"_v_{k}") for k in lasts), F.count("*").alias("_lines"))
    before = Window.partitionBy(key).orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        key, "_segment", *(F.coalesce(F.sum(f"_n_{k}").over(before), F.lit(0)).alias(f"_b_{k}") for k in sums), *(F.sum(f"_n_{k}").over(Window.partitionBy(key)).alias(f"total_{k}") for k in sums),
        *(F.last(f"_v_{k}", True).over(before).alias(f"_p_{k}") for k in lasts),
    )
    inside = Window.partitionBy(key, "_segment").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    joined = cut.join(per, [key, "_segment"])
    out = {k: F.col(f"_b_{k}") + F.sum(f"_s_{k}").over(inside) for k in sums} | {k: F.coalesce(F.last(f"_l_{k}", True).over(inside), f"_p_{k}") for k in lasts}
    return joined.select(*lines.columns, *(c.alias(k) for k, c in out.items()), *(f"total_{k}" for k in sums))


def with_sections(lines: DataFrame, heading: Column, key: str = "doc_id", segment_lines: int = SEGMENT_LINES) -> DataFrame:
    """Every line with the number of its section and the heading it stands under; before the first heading it is Introduction, without any Document."""
    marked = running(lines.withColumn("heading", heading), key, {"section_no": F.col("heading").cast("int")}, {"section": F.when(F.col("heading"), F.trim("line"))}, segment_lines)
    return marked.withColumn("section", F.coalesce("section", F.when(F.col("total_section_no") > 0, "Introduction").otherwise("Document"))).drop("total_section_no")


def without_contents(lines: DataFrame, pattern: str, first: int = 300, gap: int = 2, least: int = 3, key: str = "doc_id", text: str = "line") -> DataFrame:
    """lines without a leading run of contents lines: matching lines near the start, at most `gap` apart, `least` or more."""
    hits = lines.filter((F.col("line_no") < first) & F.col(text).rlike(pattern))
    jump = F.coalesce((F.col("line_no") - F.lag("line_no").over(in_order(key)) > gap).cast("int"), F.lit(0))
    run = hits.withColumn("jump", jump).withColumn("cluster", F.sum("jump").over(so_far(key))).filter("cluster = 0")
    gone = run.withColumn("n", F.count("*").over(Window.partitionBy(key))).filter(F.col("n") >= least).select(key, "line_no")
    return lines.join(gone, [key, "line_no"], "left_anti")


def with_pages(lines: DataFrame, marker: str, key: str = "doc_id", segment_lines: int = SEGMENT_LINES) -> DataFrame:
    """Every line with its page: 1 and the markers before it; null in documents without any."""
    n = F.length("line") - F.length(F.replace("line", F.lit(marker), F.lit("")))
    counted = running(lines.withColumn("_marks", (n / len(marker)).cast("int")), key, {"_so_far": F.col("_marks")}, {}, segment_lines)
    return counted.withColumn("page", F.when(F.col("total__so_far") > 0, 1 + F.col("_so_far") - F.col("_marks"))).drop("_marks", "_so_far", "total__so_far")


def with_offsets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every line (key, line_no, line) with the place of its first character, for lines that end in CR LF, LF or CR."""
    ends = F.regexp_extract_all(text, F.lit(r"(\r\n|\n|\r)"), F.lit(1))
    rows = docs.select(key, ends.alias("ends"), F.posexplode(F.split(text, r"\r\n|\n|\r", -1)).alias("line_no", "line"))
    size = F.length("line") + F.length(F.coalesce(F.get("ends", F.col("line_no")), F.lit("")))
    before = F.sum(size).over(in_order(key).rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("offset", F.coalesce(before, F.lit(0)).cast("bigint")).drop("ends")


def sentences(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    parts = F.filter(F.split("line", r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")
    return lines.select(key, "line_no", F.posexplode(parts).alias("sentence_no", "sentence"))


def merge_small(parts: DataFrame, keys: list[str], order: str, text: str, tokens: Column, floor: int = 40) -> DataFrame:
    """Parts under the floor join the part before them; leading ones join the first large part."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    grouped = parts.withColumn("merged_no", F.greatest(F.sum((tokens >= floor).cast("int")).over(w), F.lit(1)))
    pieces = F.array_sort(F.collect_list(F.struct(order, text)))
    return grouped.groupBy(*keys, "merged_no").agg(F.array_join(F.transform(pieces, lambda x: x[text]), " ").alias("content"))


def registry(lines: DataFrame, label: str, key: str = "doc_id") -> DataFrame:
    """Labelled lines with an ordinal for each label in order of first appearance, shared by its repeats, and the first of the three lines before."""
    near = F.collect_list(F.when(F.length("line") < 120, F.col("line"))).over(in_order(key).rowsBetween(-3, -1))
    found = lines.withColumn("label", F.lower(F.regexp_extract("line", label, 0))).withColumn("section", F.get(near, F.lit(0))).filter("label <> ''")
    first = found.withColumn("first_no", F.min("line_no").over(Window.partitionBy(key, "label")))
    return first.withColumn("ordinal", F.dense_rank().over(Window.partitionBy(key).orderBy("first_no")))


def band_join(a: DataFrame, b: DataFrame, key: str, place: str, reach: int, best: Column, value: str) -> DataFrame:
    """For each row of a, the value of the best row of b at most `reach` lines away; an equi-join on the places within reach."""
    near = a.withColumn("__at", F.explode(F.sequence(F.col(place) - reach, F.col(place) + reach)))
    return near.join(b.withColumnRenamed(place, "__at"), [key, "__at"]).groupBy(key, place).agg(F.max_by(value, best).alias(value), F.count("*").alias("candidates"))


def largest_per_label(labels: DataFrame, images: DataFrame, key: str, place: str, reach: int = 6, least: int = 2000) -> DataFrame:
    """For each label (key, place, label) the largest image (key, place, image, size) of at least `least` bytes near any of its mentions.

    Of images of one size the first mentioned, then the nearest to the beginning, counts.
    """
    near = labels.withColumn("__at", F.explode(F.sequence(F.col(place) - reach, F.col(place) + reach)))
    met = near.join(images.filter(F.col("size") >= least).withColumnRenamed(place, "__at"), [key, "__at"])
    return met.groupBy(key, "label").agg(F.min_by("image", F.struct(-F.col("size"), place, "__at")).alias("image"), F.max("size").alias("size"))


def keywords(text: Column, least_chars: int = 5, stop: tuple[str, ...] = (), splitter: str = "[^a-z0-9_]+") -> Column:
    """Distinct words of a text in order, lower-case, long enough and not on the stop list."""
    return F.array_distinct(F.filter(F.split(F.lower(text), splitter), lambda x: (F.length(x) >= least_chars) & ~x.isin(*(stop or ("",)))))


def word_matches(nodes: DataFrame, chunks: DataFrame, least_chars: int = 5, stop: tuple[str, ...] = (), hot: int = 100_000, salts: int = 16) -> DataFrame:
    """node, chunk and word of the node keywords (node, label) in chunks (chunk, content): an equi-join on words.

    Words of more than `hot` chunks, counted first, are dealt to `salts` keys each; the nodes that have them are repeated as often.
    """
    n = nodes.select("node", F.explode(keywords(F.col("label"), least_chars, stop)).alias("word"))
    c = chunks.select("chunk", F.explode(keywords(F.col("content"), least_chars, stop)).alias("word"))
    frequent = c.groupBy("word").agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).select("word", F.lit(True).alias("_hot"))  # at most one word for each `hot` rows
    salted = c.join(frequent, "word", "left").select("word", "chunk", F.when(F.col("_hot"), F.pmod(F.xxhash64("chunk"), F.lit(salts))).otherwise(0).cast("int").alias("_salt"))
    every = F.sequence(F.lit(0), F.when(F.col("_hot"), salts - 1).otherwise(0))
    repeated = n.join(frequent, "word", "left").select("word", "node", F.explode(every).alias("_salt"))
    return repeated.join(salted, ["word", "_salt"]).select("node", "chunk", "word")


def keyword_hits(nodes: DataFrame, chunks: DataFrame, least_chars: int = 5, stop: tuple[str, ...] = ()) -> DataFrame:
    """node, chunk, number of node keywords in the chunk."""
    return word_matches(nodes, chunks, least_chars, stop).groupBy("node", "chunk").agg(F.count("*").alias("hits"))


def gap_triage(hits: DataFrame) -> DataFrame:
    """Each node's number of chunks with hits and its best chunk, the first of equals."""
    return hits.groupBy("node").agg(F.count("*").alias("chunks"), F.min_by("chunk", F.struct(-F.col("hits"), "chunk")).alias("best_chunk"), F.max("hits").alias("hits"))


def gap_candidates(nodes: DataFrame, linked: DataFrame, chunks: DataFrame, least_chars: int = 5, stop: tuple[str, ...] = ()) -> DataFrame:
    """Nodes (node, label) without a link (node) whose keywords chunks hold: node, words, chunk and excerpt, for a reviewer.

    words are all that some chunk holds; the chunk is the first with most of them, the excerpt shows the
    first of the node's keywords in it.
    """
    gaps = nodes.join(linked.select("node").distinct(), "node", "left_anti")
    found = word_matches(gaps, chunks, least_chars, stop)
    per = found.groupBy("node", "chunk").agg(F.count("*").alias("hits"), F.collect_set("word").alias("words"))
    best = per.groupBy("node").agg(F.min_by(F.struct("chunk", "words"), F.struct(-F.col("hits"), "chunk")).alias("best"))
    words = found.select("node", "word").distinct().groupBy("node").agg(F.array_sort(F.collect_list("word")).alias("words"))
    rows = best.join(words, "node").join(gaps.select("node", keywords(F.col("label"), least_chars, stop).alias("order")), "node").withColumn("chunk", F.col("best.chunk"))
    rows = rows.join(chunks.select("chunk", "content"), "chunk")
    first = F.get(F.filter("order", lambda x: F.array_contains("best.words", x)), F.lit(0))
    return rows.select("node", "words", "chunk", excerpt(F.col("content"), first).alias("excerpt"))


def excerpt(text: Column, word: Column, radius: int = 60) -> Column:
    """The surroundings of the first occurrence of a whole word, in any case, with ellipses where text is left out."""
    quoted = F.concat(F.lit(r"(?i)(?<![A-Za-z0-9_])\Q"), word, F.lit(r"\E(?![A-Za-z0-9_])"))
    at = F.regexp_instr(text, quoted)
    begin = F.greatest(F.lit(1), at - radius)
    stop = at + F.length(word) + radius
    cut = F.substr(text, begin, stop - begin)
    return F.when(at > 0, F.concat(F.when(begin > 1, "…").otherwise(""), cut, F.when(stop <= F.length(text), "…").otherwise("")))
