"""Readers of caption sheets, keyword sheets, JSON taxonomies and embedding caches, and versioned snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covara.operators.keyed import upsert


def _placed_captions(spark: SparkSession, path: str, required: tuple[str, ...] = ("filename", "label", "text_for_embed"), index: str = "storage_index") -> DataFrame:
    """captions() with _place, which ascends through the files of the sheet by name, each with a header, and through their rows."""
    raw = spark.read.option("header", True).option("escape", '"').csv(path)
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("n"))
    rows = raw.select(*(F.col(f"`{c}`").alias(c.strip().lower()) for c in raw.columns), place.alias("_place"))
    if missing := [c for c in required if c not in rows.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    cells = [F.trim(c).alias(c) for c in required]
    number = F.trim(index).try_cast("int") if index in rows.columns else F.lit(None).cast("int")
    complete = [F.coalesce(F.trim(c), F.lit("")) != "" for c in required]
    return rows.select(*cells, number.alias("source_index"), (complete[0] & complete[1] & complete[2]).alias("complete"), "_place")


def captions(spark: SparkSession, path: str, required: tuple[str, ...] = ("filename", "label", "text_for_embed"), index: str = "storage_index") -> DataFrame:
    """Caption rows by header name, with complete; a missing required column is an error. The index is a number or null."""
    return _placed_captions(spark, path, required, index).drop("_place")


def import_captions(spark: SparkSession, path: str, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(stored captions (filename, label, source_index, text_for_embed) with the complete rows of a sheet put in, one row of counts: upserted and skipped).

    The key is the file, the label and the index, null among them; of rows with one key the last in the sheet counts.
    """
    rows = _placed_captions(spark, path)
    keys = ["filename", "label", "source_index"]
    fresh = rows.filter("complete").select(*keys, "text_for_embed", "_place")
    counts = rows.agg(F.count_if("complete").alias("upserted"), F.count_if(~F.col("complete")).alias("skipped"))
    return upsert(stored.withColumn("_place", F.lit(None).cast(fresh.schema["_place"].dataType)), fresh, keys, ["_place"]).drop("_place"), counts


def taxonomy(spark: SparkSession, path: str, prefix: str = "aamc") -> DataFrame:
    """Leaf rows of nested JSON files {domains: [{code, name, competencies: [text]}]} with made ids."""
    domains = spark.read.schema("domains array<struct<code: string, name: string, competencies: array<string>>>").json(path, multiLine=True).select(F.explode("domains").alias("d"))
    leaves = domains.select("d.code", "d.name", F.posexplode("d.competencies").alias("n", "description"))
    number = (F.col("n") + 1).cast("string")
    return leaves.select(
        F.concat(F.lit(f"{prefix}:"), F.lower("code"), number).alias("stable_id"), F.concat(F.upper("code"), number).alias("sub_id"), F.col("name").alias("domain_name"), "description",
        F.concat("name", F.lit(" — "), "description").alias("full_text"), F.concat(F.lit(f"{prefix}:"), F.lower("code")).alias("parent_stable_id"),
    )


def keywords(rows: DataFrame, prefix: str = "aamc-kw") -> DataFrame:
    """Keywords from numbered sheet rows (row_no, cells): those below the row that begins with ID, with an id like K12."""
    head = rows.filter(F.trim(F.get("cells", F.lit(0))) == "ID").agg(F.min("row_no").alias("head"))
    checked = rows.join(F.broadcast(head)).withColumn("head", F.coalesce("head", F.raise_error(F.lit("no header row")).cast("bigint")))  # one row
    cell = lambda i: F.nullif(F.trim(F.get("cells", F.lit(i))), F.lit(""))
    found = checked.filter("row_no > head").select(cell(0).alias("keyword_id"), cell(1).alias("keyword"), F.coalesce(cell(3), cell(2)).alias("definition"))
    return found.filter(F.col("keyword_id").rlike("(?i)^K\\d+$") & F.col("keyword").isNotNull()).withColumn("stable_id", F.concat(F.lit(f"{prefix}:"), "keyword_id"))


def embedding_cache(lines: DataFrame, model: str, dims: int) -> DataFrame:
    """id and vector from numbered JSON lines (line_no, value) of one model and size; the first of an id counts, malformed lines do not."""
    x = F.from_json("value", "id string, model string, dims int, vector array<float>")
    good = lines.select("line_no", x.alias("x")).select("line_no", "x.*").filter((F.col("model") == model) & (F.col("dims") == dims) & F.col("id").isNotNull() & (F.size("vector") == dims))
    return good.groupBy("id").agg(F.min_by("vector", "line_no").alias("vector"))


def purge_cache(lines: DataFrame, prefix: str) -> DataFrame:
    """Cache lines without those whose id begins so; lines that cannot be read stay."""
    return lines.filter(~F.coalesce(F.startswith(F.get_json_object("value", "$.id"), F.lit(prefix)), F.lit(False)))


def snapshot(tables: dict[str, DataFrame], path: str) -> dict[str, int]:
    """Writes the tables to a new folder, reads them again, and fails if a count differs from that of the rows written."""
    counts = {}
    for name, df in tables.items():
        written = Observation(f"rows of {name}")
        df.observe(written, F.count(F.lit(1)).alias("n")).write.mode("error").parquet(f"{path}/{name}")
        counts[name] = df.sparkSession.read.parquet(f"{path}/{name}").count()
        if counts[name] != written.get["n"]:
            raise RuntimeError(f"{name}: the copy has {counts[name]} rows")
    return counts


def restore(spark: SparkSession, path: str, schemas: dict[str, str], to: str | None = None) -> dict[str, DataFrame]:
    """The tables of a snapshot with the columns and types that schemas (DDL) name: texts become vectors and decimals. Written to a new folder if one is named.

    A vector or number that cannot be read as such is an error, so that no restored table has less than its snapshot.
    """
    out = {}
    for name, ddl in schemas.items():
        raw = spark.read.parquet(f"{path}/{name}")
        have = {f.name: f.dataType for f in raw.schema.fields}
        cells = []
        for f in T.StructType.fromDDL(ddl).fields:
            c = F.col(f.name)
            text = isinstance(have[f.name], T.StringType)
            value = F.from_json(c, f.dataType) if text and isinstance(f.dataType, T.ArrayType) else c.try_cast(f.dataType)
            bad = F.raise_error(F.concat(F.lit(f"{name}.{f.name}: "), c.cast("string"))).cast(f.dataType)
            cells.append(F.when(c.isNotNull() & value.isNull(), bad).otherwise(value).alias(f.name))
        out[name] = raw.select(*cells)
        if to:
            out[name].write.mode("error").parquet(f"{to}/{name}")
            out[name] = spark.read.parquet(f"{to}/{name}")
    return out
