"""Audits and exports."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covara.functions.scalar import normalised, slug, topic_label
from covara.plans.registered import query
from covara.plans.texts import _LINES, _lines
from covara.sources import exports
from covara.sources import views as v


@query("SELECT item_id, length(text) BETWEEN 4 AND 130 AS length_ok, regexp_matches(text, '^[A-Z]') AS starts_ok, regexp_matches(text, '[A-Za-z0-9)]$') AS ends_ok, length(replace(text, '(', '')) = length(replace(text, ')', '')) AS balanced FROM benchmark")
def label_wellformed(spark: SparkSession, d: str) -> DataFrame:
    """Checks of labels; parentheses must balance at every place."""
    depth = F.aggregate(F.split("text", ""), F.struct(F.lit(0).alias("d"), F.lit(True).alias("ok")), lambda a, c: F.struct((a["d"] + F.when(c == "(", 1).when(c == ")", -1).otherwise(0)).alias("d"), (a["ok"] & ((a["d"] > 0) | (c != ")"))).alias("ok")), lambda a: a["ok"] & (a["d"] == 0))
    return v.table(spark, d, "benchmark").select("item_id", F.length("text").between(4, 130).alias("length_ok"), F.col("text").rlike("^[A-Z]").alias("starts_ok"), F.col("text").rlike("[A-Za-z0-9)]$").alias("ends_ok"), depth.alias("balanced"))


@query("""WITH body AS (SELECT '"' || doc_id || '","' || CASE WHEN regexp_matches(coalesce(text, ''), '^[=+\\-@\t\r]') THEN chr(39) ELSE '' END || replace(coalesce(text, ''), '"', '""') || '"' AS line FROM documents) SELECT md5(line) AS line_md5, count(*) AS n FROM (SELECT line FROM body UNION ALL SELECT 'doc_id,text' UNION ALL SELECT '"# All ""quoted"" texts"') GROUP BY ALL""")
def csv_rows(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an export of whole texts: note, header, quoted and guarded cells."""
    rows = exports.csv_rows(v.table(spark, d, "documents"), 'All "quoted" texts', ["doc_id", "text"], ["doc_id"])
    return rows.groupBy(F.md5("line").alias("line_md5")).agg(F.count("*").alias("n"))


@query("""WITH t AS (SELECT framework, string_agg('{"system":"' || system || '","subdomain":"' || subdomain || '","stable_id":' || stable_id || '}', ',' ORDER BY system, subdomain, stable_id) AS rows, count(*) AS n FROM topic GROUP BY ALL) SELECT framework, '{"method":"counts","scope":"' || framework || '","summary":{"topics":' || n || '},"topics":[' || rows || ']}' AS line FROM t""")
def json_documents(spark: SparkSession, d: str) -> DataFrame:
    """One document for each framework: method, scope, summary and topics in order."""
    topics, found = v.topics(spark, d), []
    for name in ("AAMC", "USMLE"):
        rows = topics.filter(F.col("framework") == name)
        document = exports.json_document(rows, ["system", "subdomain", "stable_id"], ["system", "subdomain", "stable_id"], summary=rows.agg(F.count("*").alias("topics")), method="counts", scope=name)
        found.append(document.select(F.lit(name).alias("framework"), "line"))
    return found[0].unionByName(found[1])


@query("""SELECT '{"stable_id":' || stable_id || ',"system":"' || system || '","subdomain":"' || subdomain || '"}' AS line FROM topic""")
def json_rows(spark: SparkSession, d: str) -> DataFrame:
    return exports.json_rows(v.topics(spark, d), ["stable_id", "system", "subdomain"])


@query("SELECT stable_id, system || ' — ' || subdomain AS label, regexp_replace(regexp_replace(lower(system || ' & ' || subdomain), '&', 'and', 'g'), '[^a-z0-9]+', '-', 'g') AS slug FROM topic")
def topic_slugs(spark: SparkSession, d: str) -> DataFrame:
    return v.topics(spark, d).select("stable_id", topic_label(F.col("system"), F.col("subdomain")).alias("label"), slug(F.concat("system", F.lit(" & "), "subdomain")).alias("slug"))


@query("WITH per AS (SELECT document_id, count(framework_id) AS n, count(framework_id) FILTER (status IN ('approved', 'rejected')) AS reviewed FROM document LEFT JOIN link USING (document_id) GROUP BY ALL) SELECT CASE WHEN n = 0 THEN 'no links' WHEN reviewed = 0 THEN 'unreviewed' WHEN reviewed < n THEN 'partly reviewed' ELSE 'reviewed' END AS state, count(*) AS documents FROM per GROUP BY ALL")
def review_audit(spark: SparkSession, d: str) -> DataFrame:
    per = v.documents(spark, d).join(v.links(spark, d), "document_id", "left").groupBy("document_id").agg(F.count("framework_id").alias("n"), F.count_if(F.col("framework_id").isNotNull() & F.coalesce(F.col("status").isin("approved", "rejected"), F.lit(False))).alias("reviewed"))
    state = F.when(F.col("n") == 0, "no links").when(F.col("reviewed") == 0, "unreviewed").when(F.col("reviewed") < F.col("n"), "partly reviewed").otherwise("reviewed")
    return per.groupBy(state.alias("state")).agg(F.count("*").alias("documents"))


@query("SELECT count(*) AS n, count(*) FILTER (embedding IS NOT NULL) AS embedded, count(*) > 0 AND count(*) FILTER (embedding IS NOT NULL) >= count(*) AS complete, label FROM embeddings GROUP BY ALL")
def embedded_counts(spark: SparkSession, d: str) -> DataFrame:
    n, e = F.count("*"), F.count("embedding")
    return v.table(spark, d, "embeddings").groupBy("label").agg(n.alias("n"), e.alias("embedded"), ((n > 0) & (e >= n)).alias("complete"))


@query("WITH total AS (SELECT status, count(*) AS links FROM link GROUP BY ALL), declared AS (SELECT label, max(vec_id) + 1 AS declared, count(embedding) AS counted FROM embeddings GROUP BY ALL) SELECT 'status ' || coalesce(status, 'none') AS what, links AS declared, links AS counted, false AS mismatch FROM total UNION ALL SELECT 'label ' || label, declared, counted, declared <> counted FROM declared")
def consistency_audit(spark: SparkSession, d: str) -> DataFrame:
    """Totals of links by status, and declared against counted vectors of each label; the last id stands for what was declared."""
    links = v.links(spark, d).groupBy("status").agg(F.count("*").alias("n")).select(F.concat(F.lit("status "), F.coalesce("status", F.lit("none"))).alias("what"), F.col("n").alias("declared"), F.col("n").alias("counted"))
    vectors = v.table(spark, d, "embeddings").groupBy("label").agg((F.max("vec_id") + 1).alias("declared"), F.count("embedding").alias("counted")).select(F.concat(F.lit("label "), "label").alias("what"), "declared", "counted")
    return links.unionByName(vectors).withColumn("mismatch", F.col("declared") != F.col("counted"))


_CANDIDATES = "candidate AS (SELECT doc_id, line_no, '  ' || replace(line, ' ', '  ') || chr(10) AS text FROM line UNION ALL SELECT doc_id + 1, 1000000 + line_no, line FROM line)"
_NORMAL = lambda c: f"trim(regexp_replace(lower({c}), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ')"


@query(f"WITH {_LINES}, {_CANDIDATES} SELECT doc_id, cast(line_no AS bigint) AS candidate FROM candidate c JOIN documents d USING (doc_id) WHERE length({_NORMAL('c.text')}) >= 12 AND contains({_NORMAL('d.text')}, {_NORMAL('c.text')})")
def verbatim_items(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that their document holds word for word: its own lines with other spaces, and lines of the document before."""
    rows = _lines(spark, d)
    own = rows.select("doc_id", F.col("line_no").cast("bigint").alias("candidate"), F.concat(F.lit("  "), F.replace("line", F.lit(" "), F.lit("  ")), F.lit("\n")).alias("text"))
    others = rows.select((F.col("doc_id") + 1).alias("doc_id"), (F.col("line_no") + 1000000).cast("bigint").alias("candidate"), F.col("line").alias("text"))
    return verbatim(own.unionByName(others), v.table(spark, d, "documents"), "doc_id").select("doc_id", "candidate")


def verbatim(candidates: DataFrame, documents: DataFrame, key: str, least: int = 12, most: int = 5000) -> DataFrame:
    """Candidates (key, text) of `least` normalised characters or more that the text of their document contains.

    A document's text meets its candidates in arrays of about `most`, not one by one; it is read once for each array, by the candidates' first characters.
    """
    columns = [c for c in candidates.columns if c != key]
    short = candidates.withColumn("_text", normalised(F.col("text"))).filter(F.length("_text") >= least)
    parts = short.groupBy(key).agg(F.ceil(F.count("*") / most).alias("_parts"))
    lists = short.join(parts, key).groupBy(key, F.pmod(F.xxhash64("_text"), F.col("_parts")).alias("_part")).agg(F.collect_list(F.struct("_text", F.struct(*columns).alias("row"))).alias("_all"))
    texts = documents.select(key, normalised(F.col("text")).alias("_source"))

    def held(sources: pd.Series, wanted: pd.Series) -> pd.Series:
        def of(source: str | None, some) -> list[bool]:
            if source is None:
                return [False] * len(some)
            open_, found = {}, set()
            for x in {*some}:
                open_.setdefault(x[:least], []).append(x)
            for i in range(len(source) - least + 1):
                for x in open_.get(source[i : i + least], ()):
                    if source.startswith(x, i):
                        found.add(x)
            return [x in found for x in some]

        return pd.Series([of(s, w) for s, w in zip(sources, wanted)])

    inside = F.pandas_udf(held, "array<boolean>")("_source", F.transform("_all", lambda x: x["_text"]))
    rows = lists.join(texts, key).select(key, F.explode(F.arrays_zip("_all", inside.alias("_held"))).alias("_x")).filter("_x._held")
    return rows.select(key, "_x._all.row.*").select(*candidates.columns)
