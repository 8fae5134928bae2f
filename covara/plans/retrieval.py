"""Vector queries: embeddings with labels 0-4 stand for chunks, 5-9 for the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covara.functions.predicates import above_similarity, within_distance
from covara.operators import vectors as x
from covara.plans.registered import query
from covara.sources import views as v

_COS = "round(1 - list_cosine_similarity(cast(q.embedding AS double[]), cast(c.embedding AS double[])), 6)"
_NEAR = f"pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS topic_id, {_COS} AS distance FROM embeddings q, embeddings c WHERE q.label < 5 AND c.label >= 5), ranked AS (SELECT *, cast(row_number() OVER (PARTITION BY query_id ORDER BY distance, topic_id) AS integer) AS rank FROM pairs)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = v.table(spark, d, "embeddings")
    return e.filter("label < 5").selectExpr("vec_id query_id", "embedding vector"), e.filter("label >= 5").selectExpr("vec_id topic_id", "embedding vector")


@query(f"WITH {_NEAR} SELECT query_id, topic_id, rank FROM ranked WHERE rank <= 20")
def topk_candidates(spark: SparkSession, d: str) -> DataFrame:
    return x.nearest(*_sides(spark, d), 20).select("query_id", "topic_id", "rank")


@query(f"WITH {_NEAR}, top AS (SELECT *, max(distance <= 0.75) OVER (PARTITION BY query_id) AS any_near FROM ranked WHERE rank <= 5) SELECT query_id, topic_id, rank FROM top WHERE distance <= 0.75 OR (NOT any_near AND rank = 1)")
def topk_search(spark: SparkSession, d: str) -> DataFrame:
    """Five best hits above the similarity floor, or the best one."""
    return x.floor_with_best(x.nearest(*_sides(spark, d), 5), 0.25).select("query_id", "topic_id", "rank")


_TEXT = "terms AS (SELECT item_id AS query_id, list_filter(string_split_regex(lower(text), '[^0-9A-Za-z_]+'), lambda w: length(w) > 4)[1] AS term FROM benchmark), hits AS (SELECT query_id, conv_id * 1000 + turn AS topic_id, row_number() OVER (PARTITION BY query_id ORDER BY conv_id * 1000 + turn) AS rank FROM terms JOIN conversations ON contains(lower(conversations.text), term)), firsts AS (SELECT conv_id * 1000 + turn AS topic_id, row_number() OVER (ORDER BY conv_id * 1000 + turn) AS rank FROM conversations), candidates AS (SELECT query_id, topic_id, rank FROM hits WHERE rank <= 3 UNION ALL SELECT query_id, topic_id, rank FROM terms, firsts WHERE rank <= 3 AND query_id NOT IN (SELECT query_id FROM hits))"


def _text(spark: SparkSession, d: str) -> DataFrame:
    items = v.table(spark, d, "benchmark").selectExpr("item_id query_id", "text")
    turns = v.table(spark, d, "conversations").selectExpr("conv_id * 1000 + turn topic_id", "text label")
    return x.text_candidates(items, turns, 3)


@query(f"WITH {_TEXT} SELECT query_id, topic_id, cast(rank AS integer) AS rank FROM candidates")
def text_fallback(spark: SparkSession, d: str) -> DataFrame:
    return _text(spark, d)


@query(f"WITH {_NEAR}, {_TEXT}, vec AS (SELECT query_id, topic_id, rank, 'vector' AS origin FROM ranked WHERE rank <= 5 AND distance <= 0.6) SELECT * FROM vec UNION ALL SELECT query_id, topic_id, cast(rank AS integer), 'text' FROM candidates WHERE query_id NOT IN (SELECT query_id FROM vec)")
def retrieval_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Vector hits within a distance; queries without any fall back to text."""
    return x.cascade(x.nearest(*_sides(spark, d), 5).filter(within_distance("distance", 0.6)), _text(spark, d))


_ACCEPTED = f"accepted AS (SELECT q.label, q.vec_id AS a, c.vec_id AS b, {_COS} AS distance FROM embeddings q JOIN embeddings c ON c.vec_id = q.vec_id + 1)"


def _accepted(spark: SparkSession, d: str) -> DataFrame:
    e = v.table(spark, d, "embeddings")
    other = e.selectExpr("vec_id b", "vec_id - 1 a", "embedding other")
    pairs = e.selectExpr("label", "vec_id a", "embedding").join(other, "a")
    return pairs.select("label", "a", "b", F.round(1 - x.cosine_similarity(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query(f"WITH {_ACCEPTED} SELECT label, a, b, distance FROM accepted")
def accepted_distances(spark: SparkSession, d: str) -> DataFrame:
    return _accepted(spark, d)


@query("SELECT o_orderpriority, count(*) AS n, min(o_totalprice) AS least, " + ", ".join(f"round(quantile_cont(o_totalprice, {p / 100}), 4) AS p{p}" for p in (5, 10, 50, 90, 95, 99)) + ", max(o_totalprice) AS most FROM orders GROUP BY ALL")
def percentile_report(spark: SparkSession, d: str) -> DataFrame:
    found = x.percentile_report(v.table(spark, d, "orders"), "o_orderpriority", "o_totalprice")
    return found.withColumns({f"p{p}": F.round(f"p{p}", 4) for p in (5, 10, 50, 90, 95, 99)})


_POOL = f"{_NEAR}, pool AS (SELECT label, ranked.* FROM ranked JOIN embeddings ON query_id = vec_id WHERE rank <= 20)"


@query(f"WITH {_ACCEPTED}, {_POOL}, limits AS (SELECT label, ceil(round(max(distance) * 100, 6)) / 100 AS safe, ceil(round(quantile_cont(distance, 0.99) * 100, 6)) / 100 AS tight FROM accepted GROUP BY ALL), a AS (SELECT label, safe, tight, round(avg(CASE WHEN distance <= safe THEN 100.0 ELSE 0 END), 6) AS accepted_safe, round(avg(CASE WHEN distance <= tight THEN 100.0 ELSE 0 END), 6) AS accepted_tight FROM accepted JOIN limits USING (label) GROUP BY ALL), p AS (SELECT label, round(avg(CASE WHEN distance <= safe THEN 100.0 ELSE 0 END), 6) AS pool_safe, round(avg(CASE WHEN distance <= tight THEN 100.0 ELSE 0 END), 6) AS pool_tight FROM pool JOIN limits USING (label) GROUP BY ALL) SELECT * FROM a JOIN p USING (label)")
def calibration(spark: SparkSession, d: str) -> DataFrame:
    """Distance limits of each kind of chunk, with what they keep of accepted links and of the candidates."""
    labels = v.table(spark, d, "embeddings").selectExpr("vec_id query_id", "label")
    pool = x.nearest(*_sides(spark, d), 20).join(labels, "query_id")
    found = x.calibrate(_accepted(spark, d), pool, "label")
    return found.select("label", "safe", "tight", *(F.round(c, 6).alias(c) for c in ("accepted_safe", "accepted_tight", "pool_safe", "pool_tight")))


_BEST = f"{_NEAR}, best AS (SELECT label, query_id, round(1 - distance, 6) AS similarity FROM ranked JOIN embeddings ON query_id = vec_id WHERE rank = 1)"


def _best(spark: SparkSession, d: str) -> DataFrame:
    labels = v.table(spark, d, "embeddings").selectExpr("vec_id query_id", "label")
    return x.nearest(*_sides(spark, d), 1).join(labels, "query_id").select("label", "query_id", F.round(1 - F.col("distance"), 6).alias("similarity"))


@query(f"WITH {_BEST}, f AS (SELECT quantile_cont(similarity, 0.95) FILTER (label < 2) AS off, quantile_cont(similarity, 0.10) FILTER (label >= 2) AS on_ FROM best), g AS (SELECT floor(round((off + on_) / 2 * 100, 6)) / 100 AS floor, off, on_ FROM f) SELECT floor, round(off, 6) AS off, round(on_, 6) AS on_topic, round(avg(CASE WHEN similarity >= floor THEN 100.0 ELSE 0 END) FILTER (label >= 2), 6) AS on_kept, round(avg(CASE WHEN similarity >= floor THEN 100.0 ELSE 0 END) FILTER (label < 2), 6) AS off_kept FROM best, g GROUP BY ALL")
def search_floor(spark: SparkSession, d: str) -> DataFrame:
    """A floor of similarity between what two kinds of queries reach, and what it keeps of each; labels 0 and 1 stand for off-topic queries."""
    rows = _best(spark, d)
    on, off = rows.filter("label >= 2"), rows.filter("label < 2")
    found = x.kept_percents(on, off, x.search_floor(on, off))
    return found.select("floor", F.round("off", 6).alias("off"), F.round("on", 6).alias("on_topic"), F.round("on_kept", 6).alias("on_kept"), F.round("off_kept", 6).alias("off_kept"))


@query(f"WITH {_NEAR} SELECT query_id, round(max(1 - distance) FILTER (rank = 1), 6) AS top1, round(sum(1 - distance) FILTER (rank <= 5), 6) AS top5_sum, count(*) FILTER (rank <= 5) AS n FROM ranked WHERE rank <= 10 GROUP BY ALL")
def top_similarities(spark: SparkSession, d: str) -> DataFrame:
    """Similarities of the best hit and of the five best hits of each query."""
    found = x.top_similarities(x.nearest(*_sides(spark, d), 10))
    total = F.aggregate("top5", F.lit(0.0), lambda a, y: a + y)
    return found.select("query_id", F.round("top1", 6).alias("top1"), F.round(total, 6).alias("top5_sum"), F.size("top5").cast("bigint").alias("n"))


@query(f"WITH {_NEAR}, scored AS (SELECT query_id, CASE WHEN rank <= 5 THEN topic_id END AS domain, topic_id + CASE WHEN rank <= 5 THEN 1 ELSE 0 END AS framework_id, round(1 - distance, 6) AS confidence FROM ranked WHERE rank <= 10), named AS (SELECT query_id, coalesce(domain, framework_id) AS topic_id, confidence FROM scored), candidate AS (SELECT query_id, topic_id FROM ranked WHERE rank <= 7) SELECT query_id, topic_id FROM named SEMI JOIN candidate USING (query_id, topic_id) WHERE confidence >= 0.3")
def link_validation(spark: SparkSession, d: str) -> DataFrame:
    """Scored pairs that are among the seven candidates and confident enough; the scorer names a domain for the best five, an id for all."""
    found = x.nearest(*_sides(spark, d), 10)
    scored = found.select("query_id", F.when(F.col("rank") <= 5, F.col("topic_id")).alias("domain"), (F.col("topic_id") + F.when(F.col("rank") <= 5, 1).otherwise(0)).alias("framework_id"), F.round(1 - F.col("distance"), 6).alias("confidence"))
    return x.validated(x.resolved(scored), found.filter("rank <= 7"), 0.3).select("query_id", "topic_id")


@query(f"WITH {_NEAR}, links AS (SELECT query_id, topic_id, cast(least(1.0, 1 - distance) AS decimal(3, 2)) AS confidence, CASE WHEN contains(lower(cast(topic_id AS varchar)), 'epa') THEN 'AAMC_EPA' ELSE 'AAMC_PCRS' END AS framework, 1 - distance AS similarity FROM ranked WHERE rank <= 10) SELECT query_id, topic_id, confidence, framework FROM links WHERE confidence >= 0.4 AND similarity >= 0.3")
def scored_links(spark: SparkSession, d: str) -> DataFrame:
    """Typed links of the ten candidates of each chunk, scored by their similarity, above a floor and confident enough."""
    found = x.nearest(*_sides(spark, d), 10).filter(above_similarity(1 - F.col("distance"), 0.3))
    return x.validated(x.score_links(found), found, 0.4).select("query_id", "topic_id", "confidence", "framework")


@query(f"WITH {_NEAR}, tagged AS (SELECT vec_id AS query_id FROM embeddings WHERE label IN (0, 3)) SELECT query_id, topic_id, rank FROM ranked ANTI JOIN tagged USING (query_id) WHERE rank <= 5")
def keyword_tagging(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest keywords of chunks that have no tags yet; those of two labels have."""
    queries, catalog = _sides(spark, d)
    tagged = v.table(spark, d, "embeddings").filter("label in (0, 3)").selectExpr("vec_id query_id")
    return x.nearest(queries.join(tagged, "query_id", "left_anti"), catalog, 5).select("query_id", "topic_id", "rank")


@query("SELECT p_partkey, substr(coalesce(nullif(p_name, 'large bolt') || '. ' || p_type, p_brand), 1, 8000) AS text FROM part WHERE p_size > 25 AND p_partkey NOT IN (SELECT vec_id * 3 FROM embeddings)")
def embedding_work(spark: SparkSession, d: str) -> DataFrame:
    """Texts of parts without a vector here or in the cache: name and kind, else the brand, cut at 8,000 characters."""
    rows = v.table(spark, d, "part").withColumn("named", F.concat(F.expr("nullif(p_name, 'large bolt')"), F.lit(". "), F.col("p_type"))).withColumn("embedding", F.when(F.col("p_size") <= 25, F.array(F.lit(0.0))))
    cache = v.table(spark, d, "embeddings").selectExpr("vec_id * 3 p_partkey")
    return x.embedding_work(rows, cache, "p_partkey", ["named", "p_brand"])
