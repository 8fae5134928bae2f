"""Queries of keyed maintenance over links, orders and suppliers."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covara.operators import isolation
from covara.operators import keyed as k
from covara.plans.registered import query
from covara.plans.streams import _folder, _Stopped
from covara.sources import versions
from covara.sources import views as v


@query("WITH ranked AS (SELECT c_custkey AS id, c_nationkey, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal > 5000 DESC, c_custkey) AS place, first_value(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal > 5000 DESC, c_custkey) AS survivor FROM customer) SELECT id, cast(place AS integer) AS place, survivor FROM ranked")
def dedupe_survivors(spark: SparkSession, d: str) -> DataFrame:
    """The customer kept for each nation and segment, one with a high balance if there is one."""
    rows = v.table(spark, d, "customer").withColumnRenamed("c_custkey", "id")
    return k.survivors(rows, [F.col("c_nationkey"), F.col("c_mktsegment")], [F.desc(F.col("c_acctbal") > 5000), F.col("id")]).select("id", "place", "survivor")


@query("WITH ranked AS (SELECT c_custkey, first_value(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal > 5000 DESC, c_custkey) AS survivor FROM customer) SELECT DISTINCT survivor AS o_custkey, o_orderkey FROM orders JOIN ranked ON o_custkey = c_custkey")
def collapse_edges(spark: SparkSession, d: str) -> DataFrame:
    """Orders moved to the surviving customers."""
    rows = v.table(spark, d, "customer").withColumnRenamed("c_custkey", "id")
    edges = v.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return k.collapse(rows, edges, [F.col("c_nationkey"), F.col("c_mktsegment")], [F.desc(F.col("c_acctbal") > 5000), F.col("id")], ["c_name"], [], "o_custkey")[1]


_FRESH = "fresh AS (SELECT s_suppkey, s_name || ' new' AS s_name, s_nationkey, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey + 1000000, s_name, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey % 5 = 0)"


def _fresh(spark: SparkSession, d: str) -> DataFrame:
    s = v.table(spark, d, "supplier")
    changed = s.filter("s_suppkey % 3 = 0").selectExpr("s_suppkey", "concat(s_name, ' new') s_name", "s_nationkey", "s_acctbal + 1 s_acctbal")
    return changed.union(s.filter("s_suppkey % 5 = 0").selectExpr("s_suppkey + 1000000", "s_name", "s_nationkey", "s_acctbal"))


@query(f"WITH {_FRESH} SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM fresh) UNION ALL SELECT * FROM fresh")
def upsert_rows(spark: SparkSession, d: str) -> DataFrame:
    return k.upsert(v.table(spark, d, "supplier"), _fresh(spark, d), ["s_suppkey"])


@query(f"WITH {_FRESH} SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM fresh)")
def vanished_keys(spark: SparkSession, d: str) -> DataFrame:
    return k.vanished(v.table(spark, d, "supplier"), _fresh(spark, d), ["s_suppkey"]).select("s_suppkey")


@query(f"WITH {_FRESH} SELECT * FROM supplier UNION ALL SELECT * FROM fresh WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier)")
def insert_or_ignore(spark: SparkSession, d: str) -> DataFrame:
    return k.insert_or_ignore(v.table(spark, d, "supplier"), _fresh(spark, d), ["s_suppkey"])


_KNOWN = "known AS (SELECT stable_id FROM topic WHERE stable_id % 7 <> 0)"


def _known(spark: SparkSession, d: str) -> DataFrame:
    return v.topics(spark, d).filter("stable_id % 7 <> 0")


@query(f"WITH {_KNOWN} SELECT document_id, chunk_index, framework_id, coalesce(status IN ('approved', 'rejected'), false) AS reviewed FROM link WHERE framework_id NOT IN (SELECT stable_id FROM known)")
def orphan_partition(spark: SparkSession, d: str) -> DataFrame:
    return k.orphans(v.links(spark, d), _known(spark, d)).select("document_id", "chunk_index", "framework_id", "reviewed")


@query(f"WITH {_KNOWN} SELECT framework_id, count(*) AS n FROM link WHERE framework_id NOT IN (SELECT stable_id FROM known) GROUP BY ALL")
def orphan_summary(spark: SparkSession, d: str) -> DataFrame:
    return k.orphan_summary(k.orphans(v.links(spark, d), _known(spark, d)))


@query("WITH safe AS (SELECT DISTINCT document_id, chunk_index FROM link WHERE status IN ('approved', 'rejected')), new AS (SELECT document_id, chunk_index, framework_id + 1 AS framework_id, confidence, 'pending' AS status, created_at FROM link) SELECT link.* FROM link JOIN safe USING (document_id, chunk_index) UNION ALL SELECT new.* FROM new ANTI JOIN safe USING (document_id, chunk_index)")
def review_preserving_relink(spark: SparkSession, d: str) -> DataFrame:
    old = v.links(spark, d)
    new = old.selectExpr("document_id", "chunk_index", "framework_id + 1 framework_id", "confidence", "'pending' status", "created_at")
    return k.relink(old, new, ["document_id", "chunk_index"])


@query(f"WITH {_KNOWN}, per AS (SELECT document_id, chunk_index, bool_or(coalesce(status IN ('approved', 'rejected'), false)) AS reviewed, count(*) FILTER (stable_id IS NULL) AS orphans, count(*) AS n FROM link LEFT JOIN known ON framework_id = stable_id GROUP BY ALL) SELECT *, CASE WHEN reviewed THEN 'keep' WHEN orphans = 0 THEN 'skip' ELSE 'redo' END AS action FROM per")
def relink_plan(spark: SparkSession, d: str) -> DataFrame:
    return k.relink_plan(v.links(spark, d), _known(spark, d), ["document_id", "chunk_index"])


@query("SELECT conv_id, bool_and(NOT (conv_id % 4 = 0 AND turn = 0)) AS reuse FROM conversations GROUP BY ALL")
def resume_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether the turns of each conversation are as stored; the first turn of every fourth one was changed."""
    c = v.table(spark, d, "conversations")
    built = c.withColumn("text", F.when((F.col("conv_id") % 4 == 0) & (F.col("turn") == 0), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return k.resume_gate(c, built, "conv_id", "turn", "text")


@query("WITH n AS (SELECT l_orderkey AS document_id, count(*) AS chunks, count(*) FILTER (l_quantity > 5) AS n_embedded, count(*) FILTER (l_quantity > 10) AS n_aligned FROM lineitem GROUP BY ALL), rows AS (SELECT document_id, coalesce(chunks, 0) AS chunks, coalesce(n_embedded, 0) AS n_embedded, coalesce(n_aligned, 0) AS n_aligned FROM document LEFT JOIN n USING (document_id)) SELECT *, CASE WHEN chunks = 0 THEN 'empty' WHEN n_embedded < chunks THEN 'partial-embed' WHEN n_aligned < chunks THEN 'partial-align' ELSE 'complete' END AS state FROM rows")
def pipeline_status(spark: SparkSession, d: str) -> DataFrame:
    chunks = v.table(spark, d, "lineitem").selectExpr("l_orderkey document_id", "l_quantity > 5 embedded", "l_quantity > 10 aligned")
    return k.pipeline_status(v.documents(spark, d), chunks)


@query("WITH latest AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS decision FROM events GROUP BY ALL) SELECT c_custkey, coalesce(decision, c_mktsegment) AS status FROM customer LEFT JOIN latest ON user_id = c_custkey")
def apply_decisions(spark: SparkSession, d: str) -> DataFrame:
    decisions = v.table(spark, d, "events").select(F.col("user_id").alias("c_custkey"), F.col("event_type").alias("decision"), F.struct("ts", "event_id").alias("decided_at"))
    return k.apply_decisions(v.table(spark, d, "customer").selectExpr("c_custkey", "c_mktsegment status"), decisions, ["c_custkey"])


@query("WITH a AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WHERE role = 'assistant'), b AS (SELECT conv_id, turn AS turn_b, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r, count(*) OVER (PARTITION BY conv_id) AS m FROM conversations WHERE role = 'user') SELECT a.conv_id, turn, turn_b FROM a JOIN b ON a.conv_id = b.conv_id AND a.r = b.r WHERE n <= m")
def tail_join(spark: SparkSession, d: str) -> DataFrame:
    """Answers paired with questions from the end of each conversation."""
    c = v.table(spark, d, "conversations").select("conv_id", "turn", "role")
    return k.tail_join(c.filter("role = 'assistant'").drop("role"), c.filter("role = 'user'").drop("role"), "conv_id", "turn")


@query("SELECT coalesce(a.n_custkey, b.n_custkey) AS o_custkey, coalesce(before, 0) AS before, coalesce(after, 0) AS after, coalesce(after, 0) - coalesce(before, 0) AS delta FROM (SELECT o_custkey AS n_custkey, count(*) AS before FROM orders WHERE year(o_orderdate) = 1996 GROUP BY ALL) a FULL JOIN (SELECT o_custkey AS n_custkey, count(*) AS after FROM orders WHERE year(o_orderdate) = 1997 GROUP BY ALL) b ON a.n_custkey = b.n_custkey")
def replacement_report(spark: SparkSession, d: str) -> DataFrame:
    o = v.table(spark, d, "orders")
    return k.replacement_report(o.filter("year(o_orderdate) = 1996"), o.filter("year(o_orderdate) = 1997"), "o_custkey")


@query("SELECT o_custkey, o_orderpriority, o_orderkey, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS integer) AS ordinal FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) AS n FROM orders) WHERE n = 1")
def first_wins(spark: SparkSession, d: str) -> DataFrame:
    """The first order of each priority of a customer, numbered anew."""
    return k.first_wins(v.table(spark, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey"), "o_custkey", F.col("o_orderpriority"), "o_orderkey")


@query("SELECT n_nationkey, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = v.table(spark, d, "customer").join(v.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return k.duplicate_groups(rows, [F.col("n_nationkey"), F.col("c_mktsegment")])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    gone = v.table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").withColumnRenamed("c_custkey", "o_custkey")
    return k.cascade_delete({"orders": v.table(spark, d, "orders")}, gone, "o_custkey")["orders"].select("o_orderkey", "o_custkey")


@query("WITH ranked AS (SELECT *, first_value(c_custkey) OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY c_acctbal > 5000 DESC, c_custkey) AS survivor FROM (SELECT c_custkey, c_nationkey, c_mktsegment, c_acctbal, CASE WHEN c_acctbal % 2 < 1 THEN c_name END AS c_name, c_acctbal > 9000 AS rich FROM customer)), filled AS (SELECT survivor, arg_min(c_name, c_custkey) FILTER (c_name IS NOT NULL) AS name, bool_or(rich) AS rich FROM ranked GROUP BY ALL) SELECT r.c_custkey AS id, coalesce(r.c_name, name) AS c_name, f.rich FROM ranked r JOIN filled f USING (survivor) WHERE r.c_custkey = r.survivor")
def collapse_rows(spark: SparkSession, d: str) -> DataFrame:
    """The customers kept, with names and flags of those that were dropped for them."""
    rows = v.table(spark, d, "customer").selectExpr("c_custkey id", "c_nationkey", "c_mktsegment", "c_acctbal", "if(c_acctbal % 2 < 1, c_name, null) c_name", "c_acctbal > 9000 rich")
    edges = v.table(spark, d, "orders").select("o_custkey", "o_orderkey")
    kept = k.collapse(rows, edges, [F.col("c_nationkey"), F.col("c_mktsegment")], [F.desc(F.col("c_acctbal") > 5000), F.col("id")], ["c_name"], ["rich"], "o_custkey")[0]
    return kept.select("id", "c_name", "rich")


_CHUNKS = "chunk AS (SELECT l_orderkey * 10 + l_linenumber AS chunk_id, l_partkey AS asset_id, CASE WHEN l_quantity > 10 THEN l_quantity END AS embedding FROM lineitem)"


@query(f"WITH {_CHUNKS}, told AS (SELECT DISTINCT chunk_id FROM chunk JOIN part ON asset_id = p_partkey WHERE p_type = 'PROMO') SELECT chunk_id, CASE WHEN embedding IS NULL THEN 'no vector' ELSE 'caption' END AS reason FROM chunk WHERE embedding IS NULL OR chunk_id IN (SELECT chunk_id FROM told)")
def reembed_set(spark: SparkSession, d: str) -> DataFrame:
    """Chunks to embed again; promotional parts stand for assets with a caption from the sheet."""
    chunks = v.table(spark, d, "lineitem").selectExpr("l_orderkey * 10 + l_linenumber chunk_id", "l_partkey asset_id", "if(l_quantity > 10, l_quantity, null) embedding")
    assets = v.table(spark, d, "part").selectExpr("p_partkey asset_id", "if(p_type = 'PROMO', 'csv', 'mined') caption_source")
    return k.reembed_set(chunks.drop("asset_id"), chunks.select("chunk_id", "asset_id"), assets)


@query("WITH n AS (SELECT l_orderkey AS document_id, count(*) AS chunks, count(*) FILTER (l_quantity > 5) AS e, count(*) FILTER (l_quantity > 10) AS a FROM lineitem GROUP BY ALL) SELECT document_id, course_id FROM document LEFT JOIN n USING (document_id) WHERE NOT coalesce(chunks > 0 AND e = chunks AND a = chunks, false)")
def documents_to_process(spark: SparkSession, d: str) -> DataFrame:
    """Documents that a run takes if it skips complete ones."""
    chunks = v.table(spark, d, "lineitem").selectExpr("l_orderkey document_id", "l_quantity > 5 embedded", "l_quantity > 10 aligned")
    documents = v.documents(spark, d)
    return k.to_process(documents, k.pipeline_status(documents, chunks), "document_id").select("document_id", "course_id")


@query("WITH c AS (SELECT doc_id, CASE WHEN text IS NULL THEN 'text' WHEN NOT coalesce(length(text) >= 200, false) THEN 'length' WHEN NOT coalesce(lang IN ('en', 'de'), false) THEN 'language' END AS error, text FROM documents) SELECT doc_id, error, CASE WHEN error IS NULL THEN len(regexp_extract_all(text, '\\S+')) END AS words FROM c")
def isolated_work(spark: SparkSession, d: str) -> DataFrame:
    """Words of each document that passes its checks, and the first check that the others fail."""
    text = F.col("text")
    found = k.isolated(v.table(spark, d, "documents"), {"words": F.size(F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))).cast("bigint")}, {"text": text.isNotNull(), "length": F.length(text) >= 200, "language": F.col("lang").isin("en", "de")})
    return found.select("doc_id", "error", "words")


_SEED = "old AS (SELECT lower(p_type) || ':' || p_partkey AS stable_id, p_name AS text, CASE WHEN p_size > 25 THEN p_size END AS embedding FROM part), fresh AS (SELECT lower(p_type) || ':' || (p_partkey + CASE WHEN p_size > 40 THEN 1000000 ELSE 0 END) AS stable_id, p_name || ' again' AS text FROM part)"


def _seed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    parts = v.table(spark, d, "part")
    return parts.selectExpr("concat(lower(p_type), ':', p_partkey) stable_id", "p_name text", "if(p_size > 25, p_size, null) embedding"), parts.selectExpr("concat(lower(p_type), ':', p_partkey + if(p_size > 40, 1000000, 0)) stable_id", "concat(p_name, ' again') text", "cast(null as int) embedding")


@query(f"WITH {_SEED} SELECT stable_id, text, embedding FROM old WHERE NOT starts_with(stable_id, 'promo') UNION ALL SELECT stable_id, text, NULL FROM fresh WHERE starts_with(stable_id, 'promo') UNION ALL SELECT 'cache ' || stable_id, NULL, embedding FROM old WHERE embedding IS NOT NULL AND NOT starts_with(stable_id, 'promo')")
def forced_reseed(spark: SparkSession, d: str) -> DataFrame:
    """The catalog and the cache of vectors after one kind of part was seeded anew."""
    old, fresh = _seed(spark, d)
    cache = old.filter("embedding is not null").selectExpr("stable_id id", "embedding vector")
    catalog, rest = k.force_reseed(old, fresh, cache, "promo")
    return catalog.unionByName(rest.select(F.concat(F.lit("cache "), "id").alias("stable_id"), F.lit(None).cast("string").alias("text"), F.col("vector").alias("embedding")))


@query(f"WITH {_SEED}, new AS (SELECT * FROM fresh WHERE stable_id NOT IN (SELECT stable_id FROM old WHERE embedding IS NOT NULL)) SELECT stable_id, text, embedding FROM old WHERE stable_id NOT IN (SELECT stable_id FROM new) UNION ALL SELECT stable_id, text, NULL FROM new")
def upsert_catalog(spark: SparkSession, d: str) -> DataFrame:
    """The catalog with fresh rows put in; rows with a vector stay."""
    return k.upsert_catalog(*_seed(spark, d))


@query("WITH f AS (SELECT l_orderkey AS owner, l_linenumber AS n, l_quantity AS value FROM lineitem), s AS (SELECT owner, n, value + 1 AS value FROM f WHERE n <= 3 AND value > 5 UNION ALL SELECT owner, n + 100, value FROM f WHERE n = 1) SELECT owner, n, value FROM f WHERE value > 5 AND owner IN (SELECT owner FROM f WHERE value > 5) UNION ALL SELECT owner, n, value FROM s WHERE owner NOT IN (SELECT owner FROM f WHERE value > 5)")
def reconciled_rows(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows of each order after its fresh ones replaced them; orders that were not processed keep theirs."""
    fresh = v.table(spark, d, "lineitem").selectExpr("l_orderkey owner", "l_linenumber n", "l_quantity value")
    good = fresh.filter("value > 5")
    stored = good.filter("n <= 3").withColumn("value", F.col("value") + 1).unionByName(fresh.filter("n = 1").withColumn("n", F.col("n") + 100))
    return k.reconcile(stored, good, "owner", ["n"])


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name || p_brand ELSE p_brand END AS stable_id FROM part")
def short_ids(spark: SparkSession, d: str) -> DataFrame:
    """Ids that are all short enough; a longer one would be an error that names it."""
    rows = v.table(spark, d, "part").withColumn("stable_id", F.when(F.col("p_size") > 25, F.concat("p_name", "p_brand")).otherwise(F.col("p_brand")))
    return k.require_short_ids(rows, "stable_id", 120).select("p_partkey", "stable_id")


@query("WITH f AS (SELECT o_orderkey AS document_id FROM orders WHERE o_orderstatus = 'F'), old AS (SELECT l_orderkey AS document_id, count(*) FILTER (l_quantity > 5) AS before, count(*) FILTER (l_linenumber <= 2) AS fresh FROM lineitem GROUP BY ALL) SELECT document_id, coalesce(before, 0) AS before, coalesce(fresh, 0) AS after, coalesce(fresh, 0) - coalesce(before, 0) AS delta FROM f LEFT JOIN old USING (document_id) UNION ALL SELECT -1, sum(before), sum(CASE WHEN document_id IN (SELECT document_id FROM f) THEN fresh ELSE before END), 0 FROM old")
def replaced_documents(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each replaced document before and after their replacement in a store, and of the whole store (-1).

    The first commit is cut off after its files are written: the store still reads as before (else the report is wrong), and the second one counts.
    """
    lines = v.table(spark, d, "lineitem").selectExpr("l_orderkey document_id", "l_linenumber n", "l_quantity value")
    owners = v.table(spark, d, "orders").filter("o_orderstatus = 'F'").selectExpr("o_orderkey document_id")
    store = _Stopped(spark, _folder(spark), {"lines": ("document_id bigint, n int, value double", "document_id")}, buckets=16)
    store.cut = False
    first = lines.filter("value > 5")
    store.replace({"lines": (first, first)})
    fresh = lines.filter("n <= 2").join(owners, "document_id", "left_semi").withColumn("value", F.col("value") + 1)
    store.cut = True
    try:
        store.replace({"lines": (fresh, owners)})
    except RuntimeError:
        half = store.read("lines").count()
    report = versions.replaced_rows(store, "lines", fresh, owners)
    whole = store.read("lines").agg(F.lit(-1).cast("bigint").alias("document_id"), F.lit(half).cast("bigint").alias("before"), F.count("*").alias("after"), F.lit(0).cast("bigint").alias("delta"))
    return report.unionByName(whole)


def _measure(row: dict, attempt: int) -> dict:
    """Words of a text and their mean length; a first attempt does not take long texts."""
    found = re.findall(r"[^\x20\x09-\x0D]+", row["text"])
    if attempt == 1 and len(found) > 300:
        raise MemoryError(f"{len(found)} words")
    return {"words": len(found), "mean": sum(map(len, found)) / len(found)}


@query(r"WITH w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents), c AS (SELECT doc_id, CASE WHEN text IS NULL THEN 'TypeError: expected string or bytes-like object, got ''NoneType''' WHEN len(w) = 0 THEN 'ZeroDivisionError: division by zero' END AS error, len(w) AS n, list_sum(list_transform(w, lambda x: length(x))) AS letters FROM w) SELECT doc_id, cast(CASE WHEN error IS NOT NULL OR n > 300 THEN 2 ELSE 1 END AS integer) AS attempt, error, CASE WHEN error IS NULL THEN n END AS words, CASE WHEN error IS NULL THEN letters / n END AS mean FROM c")
def isolated_documents(spark: SparkSession, d: str) -> DataFrame:
    """Measures of all documents after three runs of work that raises on some: long ones succeed when tried again, those without words stay in quarantine and are not tried a third time."""
    documents = v.table(spark, d, "documents").select("doc_id", "text")
    store = versions.Store(spark, _folder(spark), isolation.tables("doc_id", "bigint", "struct<words: bigint, mean: double>"), buckets=8)
    for _ in range(3):
        isolation.run_isolated(store, documents, "doc_id", ["text"], _measure, most_attempts=2)
    failed = store.read("quarantine").select("doc_id", "attempt", "error", F.lit(None).cast("bigint").alias("words"), F.lit(None).cast("double").alias("mean"))
    return store.read("results").select("doc_id", "attempt", F.lit(None).cast("string").alias("error"), "value.words", "value.mean").unionByName(failed)
