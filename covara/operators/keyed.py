"""Keyed maintenance: upserts, reconciliation, duplicate collapse, orphans, relinking, resume decisions.

Nothing is changed in place: every operator returns the new version of a table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covara.functions.predicates import is_reviewed


def _on(keys: list[str], a: str = "a", b: str = "b") -> Column:
    return reduce(Column.__and__, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str], order: list | None = None) -> DataFrame:
    """stored with fresh rows put in by null-safe keys; of fresh rows with one key the last by `order` counts."""
    if order:
        fresh = fresh.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order]))).filter("__n = 1").drop("__n")
    rest = stored.alias("a").join(fresh.select(*keys).alias("b"), _on(keys), "left_anti")
    return rest.unionByName(fresh.select(*stored.columns))


def vanished(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    return stored.alias("a").join(fresh.select(*keys).alias("b"), _on(keys), "left_anti")


def reconcile(stored: DataFrame, fresh: DataFrame, owner: str, keys: list[str]) -> DataFrame:
    """stored with the rows of every owner in fresh replaced; an owner that is known but has no fresh row is an error when read.

    fresh has a row with null keys for an owner that was processed and came out empty.
    """
    counts = fresh.groupBy(owner).agg(F.count(keys[0]).alias("__n"))
    empty = F.raise_error(F.concat(F.lit("no fresh rows for "), F.col(owner).cast("string"))).cast("boolean")
    kept = stored.join(counts, owner, "left").filter(F.when(F.col("__n") == 0, empty).otherwise(F.col("__n").isNull())).select(*stored.columns)
    return kept.unionByName(fresh.filter(F.col(keys[0]).isNotNull()).select(*stored.columns))


def insert_or_ignore(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    new = fresh.dropDuplicates(keys).alias("a").join(stored.select(*keys).alias("b"), _on(keys), "left_anti")
    return stored.unionByName(new.select(*stored.columns))


def survivors(rows: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """rows with survivor (the id kept for its group) and place in the group; order must end in the id."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("place", F.row_number().over(w)).withColumn("survivor", F.first_value("id").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))


def collapse(rows: DataFrame, edges: DataFrame, keys: list[Column], order: list[Column], coalesced: list[str], any_true: list[str], edge_id: str) -> tuple[DataFrame, DataFrame]:
    """(rows without duplicates, edges moved to the survivors and made distinct). Empty fields take the value of the loser with the least id."""
    ranked = survivors(rows, keys, order)
    filled = ranked.groupBy("survivor").agg(*(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("id"))).alias(f"__{c}") for c in coalesced), *(F.bool_or(c).alias(f"__{c}") for c in any_true))
    kept = ranked.filter("place = 1").join(filled, "survivor").select(*(F.coalesce(c, f"__{c}").alias(c) if c in coalesced else F.col(f"__{c}").alias(c) if c in any_true else F.col(c) for c in rows.columns))
    moved = edges.join(ranked.select(F.col("id").alias(edge_id), "survivor"), edge_id).withColumn(edge_id, F.col("survivor")).select(*edges.columns).distinct()
    return kept, moved


def duplicate_groups(rows: DataFrame, keys: list[Column]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def require_no_duplicates(rows: DataFrame, keys: list[Column]) -> None:
    if n := duplicate_groups(rows, keys).count():
        raise ValueError(f"{n} groups of duplicates")


def orphans(links: DataFrame, catalog: DataFrame, link_id: str = "framework_id", topic_id: str = "stable_id") -> DataFrame:
    """Links whose topic is not in the catalog, with reviewed; links without a topic id are none."""
    known = catalog.select(F.col(topic_id).alias(link_id)).distinct()
    return links.filter(F.coalesce(F.col(link_id).cast("string"), F.lit("")) != "").join(known, link_id, "left_anti").withColumn("reviewed", is_reviewed())


def orphan_summary(found: DataFrame, link_id: str = "framework_id") -> DataFrame:
    return found.groupBy(link_id).agg(F.count("*").alias("n")).orderBy(F.desc("n"), link_id)


def apply_decisions(links: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """links with the status of the latest decision (column decided_at) on each."""
    latest = decisions.groupBy(*keys).agg(F.max_by("decision", "decided_at").alias("__decision"))
    return links.join(latest, keys, "left").withColumn("status", F.coalesce("__decision", "status")).drop("__decision")


def relink(stored: DataFrame, fresh: DataFrame, chunk: list[str]) -> DataFrame:
    """Chunks with any reviewed link keep theirs; the others get the fresh links."""
    safe = stored.filter(is_reviewed()).select(*chunk).distinct()
    return stored.join(safe, chunk, "left_semi").unionByName(fresh.select(*stored.columns).join(safe, chunk, "left_anti"))


def relink_plan(stored: DataFrame, catalog: DataFrame, chunk: list[str]) -> DataFrame:
    """What to do with each chunk: keep reviewed ones, skip those whose links all are in the catalog, redo the rest."""
    known = catalog.select(F.col("stable_id").alias("framework_id"), F.lit(True).alias("__known")).distinct()
    per = stored.join(known, "framework_id", "left").groupBy(*chunk).agg(F.bool_or(is_reviewed()).alias("reviewed"), F.count_if(F.col("__known").isNull()).alias("orphans"), F.count("framework_id").alias("n"))
    return per.withColumn("action", F.when(F.col("reviewed"), "keep").when((F.col("n") > 0) & (F.col("orphans") == 0), "skip").otherwise("redo"))


def resume_gate(stored: DataFrame, built: DataFrame, owner: str, index: str, content: str) -> DataFrame:
    """owner and reuse: whether the stored rows are the same sequence as the built ones, and not empty."""
    a = stored.select(owner, index, F.col(content).alias("__old"), F.lit(1).alias("__a"))
    b = built.select(owner, index, F.col(content).alias("__new"), F.lit(1).alias("__b"))
    same = F.col("__a").isNotNull() & F.col("__b").isNotNull() & F.col("__old").eqNullSafe(F.col("__new"))
    return a.join(b, [owner, index], "full").groupBy(owner).agg(F.bool_and(same).alias("reuse"))


def pipeline_status(documents: DataFrame, chunks: DataFrame, owner: str = "document_id") -> DataFrame:
    """Counts of chunks (all, embedded, aligned) and the state of each document; chunks has Booleans embedded and aligned."""
    n = chunks.groupBy(owner).agg(F.count("*").alias("chunks"), F.count_if("embedded").alias("n_embedded"), F.count_if("aligned").alias("n_aligned"))
    rows = documents.select(owner).join(n, owner, "left").fillna(0, ["chunks", "n_embedded", "n_aligned"])
    state = F.when(F.col("chunks") == 0, "empty").when(F.col("n_embedded") < F.col("chunks"), "partial-embed").when(F.col("n_aligned") < F.col("chunks"), "partial-align").otherwise("complete")
    return rows.withColumn("state", state)


def replacement_report(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """Rows of each owner before and after a replacement, and the difference."""
    a, b = (df.groupBy(owner).agg(F.count("*").alias(n)) for df, n in ((old, "before"), (new, "after")))
    return a.join(b, owner, "full").fillna(0, ["before", "after"]).withColumn("delta", F.col("after") - F.col("before"))


def cascade_delete(tables: dict[str, DataFrame], gone: DataFrame, owner: str) -> dict[str, DataFrame]:
    return {k: t.join(gone.select(owner), owner, "left_anti") for k, t in tables.items()}


def tail_join(a: DataFrame, b: DataFrame, owner: str, order: str) -> DataFrame:
    """The last rows of b paired one to one, in order, with the rows of a; nothing for an owner with fewer rows of b than of a."""
    w = Window.partitionBy(owner).orderBy(F.desc(order))
    ra, rb = a.withColumn("__r", F.row_number().over(w)), b.withColumn("__r", F.row_number().over(w))
    enough = a.groupBy(owner).agg(F.count("*").alias("__a")).join(b.groupBy(owner).agg(F.count("*").alias("__b")), owner).filter("__a <= __b").select(owner)
    return ra.join(enough, owner, "left_semi").join(rb.withColumnRenamed(order, f"{order}_b"), [owner, "__r"]).drop("__r")


def first_wins(rows: DataFrame, owner: str, key: Column, order: str, ordinal: str = "ordinal") -> DataFrame:
    """The first row of each key of an owner, numbered anew in order."""
    first = rows.withColumn("__n", F.row_number().over(Window.partitionBy(owner, key).orderBy(order))).filter("__n = 1").drop("__n")
    return first.withColumn(ordinal, F.row_number().over(Window.partitionBy(owner).orderBy(order)))


def require_short_ids(rows: DataFrame, column: str, most: int) -> DataFrame:
    bad = F.raise_error(F.concat(F.lit(f"{column} is longer than {most}: "), F.col(column)))
    return rows.withColumn(column, F.when(F.length(column) > most, bad).otherwise(F.col(column)))


def reembed_set(chunks: DataFrame, links: DataFrame, assets: DataFrame, chunk: str = "chunk_id", asset: str = "asset_id") -> DataFrame:
    """chunk and reason of the chunks to embed: those without a vector, and those linked to an asset whose caption came from the sheet."""
    told = links.join(assets.filter(F.col("caption_source") == "csv").select(asset), asset, "left_semi").select(chunk).distinct().withColumn("_told", F.lit(True))
    rows = chunks.join(told, chunk, "left")
    return rows.filter(F.col("embedding").isNull() | F.col("_told")).select(chunk, F.when(F.col("embedding").isNull(), "no vector").otherwise("caption").alias("reason"))


def to_process(documents: DataFrame, status: DataFrame, owner: str, skip_complete: bool = True, force: bool = False) -> DataFrame:
    """The documents that a run takes: all, or all but the complete ones (status as pipeline_status gives it) unless forced."""
    if force or not skip_complete:
        return documents
    return documents.join(status.filter("state = 'complete'").select(owner), owner, "left_anti")


def isolated(rows: DataFrame, work: dict[str, Column], checks: dict[str, Column]) -> DataFrame:
    """rows with the columns of work and error: the name of the first check that a row fails, null where all hold.

    Work of a row that fails is null, so one bad document does not stop the others.
    """
    error = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()))
    return rows.withColumn("error", error).withColumns({k: F.when(F.col("error").isNull(), c) for k, c in work.items()})


def force_reseed(catalog: DataFrame, fresh: DataFrame, cache: DataFrame, prefix: str, key: str = "stable_id") -> tuple[DataFrame, DataFrame]:
    """(the catalog with its rows of a prefix replaced by the fresh ones, without vectors; the cache (id, vector) without ids of the prefix)."""
    other = catalog.filter(~F.startswith(key, F.lit(prefix)))
    new = fresh.filter(F.startswith(key, F.lit(prefix))).withColumn("embedding", F.lit(None).cast(catalog.schema["embedding"].dataType))
    return other.unionByName(new.select(*catalog.columns)), cache.filter(~F.startswith("id", F.lit(prefix)))


def upsert_catalog(catalog: DataFrame, fresh: DataFrame, key: str = "stable_id") -> DataFrame:
    """The catalog with fresh rows put in by key; rows that have a vector stay as they are."""
    done = catalog.filter("embedding is not null").select(key)
    return upsert(catalog, fresh.join(done, key, "left_anti"), [key])
