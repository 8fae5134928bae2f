"""Items found in documents (objectives, captions): counts, merges, overrides, and what needs review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covara.functions.scalar import normalised


def in_module(rows: DataFrame, modules: DataFrame, wanted: str = "all", course: str = "course_id") -> DataFrame:
    """rows of the courses of a module (modules: course, module). `Unassigned` takes the courses without one, an unknown module none."""
    if wanted == "all":
        return rows
    named = rows.join(modules.select(course, F.col("module").alias("_module")), course, "left")
    return named.filter(F.coalesce("_module", F.lit("Unassigned")) == wanted).drop("_module")


def method_counts(items: DataFrame, *keys: str) -> DataFrame:
    """Items of each key; what was not found by the model counts as found by pattern."""
    model = F.col("method").eqNullSafe("llm")
    return items.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(~model).alias("regex"), F.count_if(model).alias("llm"))


def export_summary(items: DataFrame, keys: list[str], title: str, order: list[str]) -> DataFrame:
    """Items of each key with its first title; here only items that say so count as found by pattern."""
    return items.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count_if(F.col("method") == "regex").alias("regex"), F.count_if(F.col("method") == "llm").alias("llm"), F.min_by(title, F.struct(*order)).alias(title)
    )


def lowest_domain(rows: DataFrame, keys: list[str], domain: str, percent: str) -> DataFrame:
    """The domain of each key with the lowest percent, the first by name of equals, and a sentence on it."""
    least = rows.groupBy(*keys).agg(F.min(F.struct(percent, domain)).alias("least")).select(*keys, "least.*")
    return least.withColumn("takeaway", F.concat(F.col(domain), F.lit(" has the lowest coverage at "), F.col(percent).cast("string"), F.lit("%.")))


def gap_cells(cells: DataFrame, keys: list[str], case: str, axis: DataFrame, system: str) -> DataFrame:
    """Cells and gap cells of the dense grid of each key: its cases by the systems of the axis; absent cells are gaps."""
    n = axis.agg(F.count_distinct(system).alias("systems"))
    rows = cells.groupBy(*keys).agg(F.count_distinct(case).alias("cases"), F.count_if(F.col("status") != "gap").alias("filled"))
    total = F.col("cases") * F.col("systems")
    return rows.join(n).select(*keys, total.alias("cells"), F.greatest(F.lit(0), total - F.col("filled")).alias("gaps"))  # n is one row


def with_captions(assets: DataFrame, captions: DataFrame, order: list[str], mined: str = "mined") -> DataFrame:
    """assets (filename, label, source_index, mined) with caption, has_caption and caption_source.

    A caption row (filename, label, source_index, text) of the same index comes first, then one without an index, then
    the mined text. Of caption rows with one key the last by `order` counts.
    """
    last = captions.groupBy("filename", "label", "source_index").agg(F.max_by("text", F.struct(*order)).alias("text"))
    exact = last.filter("source_index is not null").withColumnRenamed("text", "_exact")
    general = last.filter("source_index is null").select("filename", "label", F.col("text").alias("_general"))
    found = assets.join(exact, ["filename", "label", "source_index"], "left").join(general, ["filename", "label"], "left")
    official = F.coalesce("_exact", "_general")
    caption = F.coalesce(official, mined)
    return found.withColumns({"caption": caption, "has_caption": caption.isNotNull(), "caption_source": F.when(official.isNotNull(), "csv").when(F.col(mined).isNotNull(), "mined")}).drop("_exact", "_general")


def captions_to_rescue(assets: DataFrame, captions: DataFrame, keys: list[str], caption: str) -> DataFrame:
    """Captioned assets without a caption row of their null-safe key."""
    known = captions.select(*(F.col(c).alias(f"_{c}") for c in keys)).distinct()
    return assets.filter(F.col(caption).isNotNull()).join(known, reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in keys)), "left_anti")


def linked(edges: DataFrame, chosen: DataFrame, by: list[str], other: list[str]) -> DataFrame:
    """The distinct other ends of the edges from the chosen ends."""
    return edges.join(chosen.select(*by).distinct(), by, "left_semi").select(*other).distinct()


def with_prior(cleaned: DataFrame, originals: DataFrame, owner: str, order: list[str], carried: dict[str, object]) -> DataFrame:
    """cleaned items with the carried fields of the first original of the same normalised text, else the given defaults."""
    first = originals.groupBy(owner, normalised(F.col("text")).alias("_key")).agg(F.min_by(F.struct(*carried), F.struct(*order)).alias("_prior"))
    found = cleaned.drop(*carried).withColumn("_key", normalised(F.col("text"))).join(first, [owner, "_key"], "left")
    return found.withColumns({c: F.coalesce(F.col("_prior")[c], F.lit(default)) for c, default in carried.items()}).drop("_key", "_prior")


def merge_cleaned(originals: DataFrame, cleaned: DataFrame, reasons: DataFrame, owner: str, order: list[str]) -> DataFrame:
    """owner, ordinal, text and from_cleaned of the items kept for each owner.

    Items have (owner, text, confidence, coded); reasons (owner, reason) says whether items were `missing` or `messy`.
    Owners without cleaned items keep their originals as they are. Else originals come first and the first of a
    normalised text counts; of messy originals those that are high or coded stay, low ones go, and the others stay
    unless a cleaned item has their text.
    """
    key = normalised(F.col("text")).alias("key")
    new = cleaned.select(owner, "text", key, *order)
    old = originals.join(new.select(owner, F.lit(True).alias("cleaned")).distinct(), owner, "left").join(reasons, owner, "left").withColumn("key", key)
    old = old.join(new.select(owner, "key", F.lit(True).alias("again")).distinct(), [owner, "key"], "left")
    sure = (F.col("confidence") == "high") | F.col("coded")
    stays = F.col("cleaned").isNull() | F.col("reason").eqNullSafe("missing") | sure | ((F.col("confidence") != "low") & F.col("again").isNull())
    old = old.filter(F.coalesce(stays, F.lit(False)))
    shape = [owner, "text", "key", *order]
    rows = old.select(*shape, F.lit(False).alias("from_cleaned"), F.col("cleaned").isNull().alias("as_is")).unionByName(new.select(*shape, F.lit(True).alias("from_cleaned"), F.lit(False).alias("as_is")))
    place = [F.col("from_cleaned"), *(F.col(c) for c in order)]
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy(owner, "key").orderBy(*place))).filter("n = 1 or as_is")
    return ranked.select(owner, F.row_number().over(Window.partitionBy(owner).orderBy(*place)).alias("ordinal"), "text", "from_cleaned")


def needs_review(documents: DataFrame, items: DataFrame, owner: str, run_on: int = 400) -> DataFrame:
    """owner and needs_review: no items (unless the document holds topics only), half or more of low confidence, or a long one that is neither high nor coded.

    documents has owner, has_sections and topics_only; one without sections needs none.
    """
    long = (F.length("text") > run_on) & (F.col("confidence") != "high") & ~F.col("coded")
    per = items.groupBy(owner).agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == "low").alias("low"), F.coalesce(F.bool_or(long), F.lit(False)).alias("long"))
    rows = documents.join(per, owner, "left")
    poor = (F.col("low") > 0) & (F.col("low") >= 0.5 * F.col("n"))
    return rows.select(owner, (F.col("has_sections") & F.when(F.col("n").isNull(), ~F.col("topics_only")).otherwise(poor | F.col("long"))).alias("needs_review"))


def enriched(chunks: DataFrame, captions: DataFrame, keys: list[str], content: str = "content") -> DataFrame:
    """chunks with embed_text: the linked captions (keys, ordinal, label, caption) that the content lacks, in order, as `label: caption` lines, then the content."""
    found = captions.filter("caption is not null").join(chunks.select(*keys, content), keys).filter(~F.coalesce(F.contains(F.lower(content), F.lower("caption")), F.lit(False)))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "label", "caption"))), lambda x: F.concat(x["label"], F.lit(": "), x["caption"]))
    head = found.groupBy(*keys).agg(F.array_join(lines, "\n").alias("_head"))
    return chunks.join(head, keys, "left").withColumn("embed_text", F.concat_ws("\n", "_head", content)).drop("_head")


def captions_after(lines: DataFrame, label: Column, wanted: Column, key: str = "doc_id", reach: int = 3, most_chars: int = 2000) -> DataFrame:
    """Label lines with the wanted ones of the next `reach` lines before another label, joined; null where there are none."""
    marked = lines.withColumns({"_label": F.coalesce(label, F.lit(False)), "_wanted": F.coalesce(wanted, F.lit(False))})
    after = F.collect_list(F.struct("line", "_label", "_wanted")).over(Window.partitionBy(key).orderBy("line_no").rowsBetween(1, reach))
    rows = marked.withColumn("_after", after).filter("_label")
    stop = F.array_position(F.transform("_after", lambda x: x["_label"]), True)
    near = F.when(stop > 0, F.slice("_after", 1, (stop - 1).cast("int"))).otherwise(F.col("_after"))
    kept = F.transform(F.filter(near, lambda x: x["_wanted"]), lambda x: x["line"])
    return rows.select(key, "line_no", "line", F.when(F.size(kept) > 0, F.substring(F.trim(F.array_join(kept, " ")), 1, most_chars)).alias("caption"))


def smoke(status: DataFrame, keys: list[str], least: float = 0.9) -> DataFrame:
    """Whether all documents of each key are complete and enough of their chunks have vectors; status as pipeline_status gives it."""
    all_complete = F.bool_and(F.col("state") == "complete")
    share = F.sum("n_embedded") >= least * F.sum("chunks")
    return status.groupBy(*keys).agg(F.count("*").alias("documents"), all_complete.alias("complete"), (share & (F.sum("chunks") > 0)).alias("embedded"))


def smoke_errors(checked: DataFrame, keys: list[str], labels: DataFrame, prefix: str, known: str = "framework_id") -> DataFrame:
    """checked (smoke) with errors: incomplete documents, too few vectors, and links (keys, id) that none begins with the prefix."""
    per = labels.groupBy(*keys).agg(F.count_if(F.startswith(F.col(known).cast("string"), F.lit(prefix))).alias("_named"))
    rows = checked.join(per, keys, "left")
    errors = F.array_compact(F.array(F.when(~F.col("complete"), "pipeline incomplete"), F.when(~F.col("embedded"), "too few vectors"), F.when(F.coalesce("_named", F.lit(0)) == 0, f"no id begins with {prefix}")))
    return rows.withColumn("errors", errors).drop("_named")


def stamped(rows: DataFrame, stored: DataFrame, keys: list[str], columns: list[str], stamp: str = "updated_at") -> DataFrame:
    """rows with the time of their last change: now where a column differs from what is stored or nothing is, else the stored time."""
    old = stored.select(*keys, F.struct(*columns).alias("_old"), F.col(stamp).alias("_stamp"), F.lit(True).alias("_there"))
    same = F.col("_there") & F.struct(*columns).eqNullSafe(F.col("_old"))
    found = rows.drop(stamp).join(old, keys, "left").withColumn(stamp, F.when(F.coalesce(same, F.lit(False)), F.col("_stamp")).otherwise(F.current_timestamp()))
    return found.drop("_old", "_stamp", "_there")
