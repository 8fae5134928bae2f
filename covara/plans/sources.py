"""Queries of readers and snapshots: the given tables are written as the files that they read, into the folder that the cluster shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covara.plans.registered import query
from covara.plans.streams import _folder
from covara.sources import readers
from covara.sources import views as v

_SHEET = "sheet AS (SELECT p_partkey AS n, p_brand AS filename, CASE WHEN p_size > 45 THEN '' ELSE p_type END AS label, p_name || ' \"' || p_partkey || '\", x' AS text, CASE WHEN p_size % 3 = 0 THEN p_size END AS source_index FROM part)"


@query(f"WITH {_SHEET}, last AS (SELECT filename, label, source_index, arg_max(text, n) AS text_for_embed FROM sheet WHERE label <> '' GROUP BY ALL), stored AS (SELECT s_name AS filename, 'kept' AS label, NULL AS source_index, 'old' AS text_for_embed FROM supplier) SELECT *, (SELECT count(*) FROM sheet WHERE label <> '') AS upserted, (SELECT count(*) FROM sheet WHERE label = '') AS skipped FROM (SELECT * FROM last UNION ALL SELECT * FROM stored)")
def caption_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Captions after the import of a sheet of several files made of parts, in their order, with the numbers of its rows put in and skipped."""
    folder = _folder(spark)
    parts = v.table(spark, d, "part").repartitionByRange(4, "p_partkey").sortWithinPartitions("p_partkey")
    sheet = parts.select(
        F.col("p_brand").alias(" FileName"), F.when(F.col("p_size") > 45, "").otherwise(F.col("p_type")).alias("Label "), F.concat("p_name", F.lit(' "'), "p_partkey", F.lit('", x')).alias("text_for_embed"),
        F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("string")).otherwise("none").alias("storage_index"),
    )
    sheet.write.option("header", True).option("escape", '"').csv(f"{folder}/sheet")
    stored = v.table(spark, d, "supplier").select(F.col("s_name").alias("filename"), F.lit("kept").alias("label"), F.lit(None).cast("int").alias("source_index"), F.lit("old").alias("text_for_embed"))
    rows, counts = readers.import_captions(spark, f"{folder}/sheet", stored)
    return rows.join(F.broadcast(counts))  # one row


@query("WITH n AS (SELECT n_nationkey, n_name, r_name, row_number() OVER (PARTITION BY r_name ORDER BY n_name) AS i FROM nation JOIN region ON n_regionkey = r_regionkey) SELECT 'aamc:' || lower(substr(r_name, 1, 2)) || i AS stable_id, upper(substr(r_name, 1, 2)) || i AS sub_id, r_name AS domain_name, n_name AS description, r_name || ' — ' || n_name AS full_text, 'aamc:' || lower(substr(r_name, 1, 2)) AS parent_stable_id FROM n")
def taxonomy_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of a nested taxonomy of regions and nations, read from JSON files."""
    folder = _folder(spark)
    rows = v.table(spark, d, "nation").join(v.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    domains = rows.groupBy(F.substring("r_name", 1, 2).alias("code"), F.col("r_name").alias("name")).agg(F.array_sort(F.collect_list("n_name")).alias("competencies"))
    domains.select(F.array(F.struct("code", "name", "competencies")).alias("domains")).repartition(5, "domains").write.option("maxRecordsPerFile", 1).json(f"{folder}/taxonomy")
    return readers.taxonomy(spark, f"{folder}/taxonomy")


@query("SELECT 'K' || p_partkey AS keyword_id, p_name AS keyword, coalesce(CASE WHEN p_size > 25 THEN p_type END, p_brand) AS definition, 'aamc-kw:K' || p_partkey AS stable_id FROM part WHERE p_partkey >= 5 AND p_size <> 7 AND p_size <> 9")
def keyword_sheet(spark: SparkSession, d: str) -> DataFrame:
    """Keywords of a sheet whose header is its sixth row; rows with another kind of id or without a keyword are none."""
    c = F.col
    kind = F.when(c("p_size") == 9, "Z").otherwise("K")
    cells = F.array(F.concat(kind, c("p_partkey").cast("string")), F.when(c("p_size") == 7, "").otherwise(c("p_name")), c("p_brand"), F.when(c("p_size") > 25, c("p_type")))
    head = spark.createDataFrame([(4.5, ["ID", "Keyword", "Short", "Long"])], "row_no double, cells array<string>")
    rows = v.table(spark, d, "part").select(c("p_partkey").cast("double").alias("row_no"), cells.alias("cells")).unionByName(head)
    return readers.keywords(rows).select("keyword_id", "keyword", "definition", "stable_id")


@query("SELECT vec_id // 2 AS id, min(vec_id) AS first FROM embeddings WHERE label < 8 AND vec_id % 5 <> 3 GROUP BY ALL")
def cached_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The first vector of each id of a cache of JSON lines; lines of another model and broken lines do not count, some ids are purged and read again."""
    e = v.table(spark, d, "embeddings")
    whole = F.to_json(F.struct(F.floor(F.col("vec_id") / 2).cast("string").alias("id"), F.when(F.col("label") < 8, "m").otherwise("other").alias("model"), F.lit(64).alias("dims"), F.col("embedding").alias("vector")))
    lines = e.select(F.col("vec_id").alias("line_no"), F.when(F.col("vec_id") % 5 == 3, F.substring(whole, 1, 9)).otherwise(whole).alias("value"))
    kept = readers.purge_cache(lines.unionByName(lines.select("line_no", F.replace("value", F.lit('"id":"'), F.lit('"id":"gone:')).alias("value"))), "gone:")
    found = readers.embedding_cache(kept, "m", 64)
    first = e.select(F.floor(F.col("vec_id") / 2).cast("string").alias("id"), "vec_id", F.col("embedding").alias("own"))
    apart = F.aggregate(F.zip_with("vector", "own", lambda a, b: F.abs(a.cast("double") - b.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    return found.join(first, "id").filter(apart < 1e-4).groupBy(F.col("id").cast("bigint").alias("id")).agg(F.min("vec_id").alias("first"))


@query("SELECT document_id, chunk_index, framework_id, confidence, status FROM link UNION ALL SELECT vec_id, label, len(embedding), cast(round(list_sum(list_transform(embedding, lambda x: cast(x AS double))), 2) AS decimal(12, 2)), 'vector' FROM embeddings")
def restored_tables(spark: SparkSession, d: str) -> DataFrame:
    """Links and vectors after a snapshot in text form was checked, read again with its types, and written anew."""
    folder, c = _folder(spark), F.col
    links = v.links(spark, d).select("document_id", "chunk_index", "framework_id", c("confidence").cast("string").alias("confidence"), "status")
    vectors = v.table(spark, d, "embeddings").select("vec_id", "label", F.to_json("embedding").alias("embedding"))
    readers.snapshot({"links": links, "vectors": vectors}, f"{folder}/snapshot")
    schemas = {"links": "document_id bigint, chunk_index int, framework_id bigint, confidence decimal(3,2), status string", "vectors": "vec_id bigint, label int, embedding array<float>"}
    back = readers.restore(spark, f"{folder}/snapshot", schemas, f"{folder}/restored")
    total = F.round(F.aggregate(F.transform("embedding", lambda x: x.cast("double")), F.lit(0.0), lambda a, x: a + x), 2).cast("decimal(12,2)")
    sizes = back["vectors"].select(c("vec_id").alias("document_id"), c("label").alias("chunk_index"), F.size("embedding").cast("bigint").alias("framework_id"), total.alias("confidence"), F.lit("vector").alias("status"))
    return back["links"].withColumn("confidence", c("confidence").cast("decimal(12,2)")).unionByName(sizes)
