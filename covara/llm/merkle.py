"""A Merkle manifest of a dataset: slot pivots make the nodes, and give each leaf the siblings that prove it.

Leaves get their place within a group from one range sort and the row counts of its partitions, so a group with a
third of all rows spreads over many tasks. At every level conditional aggregates spread the children of a parent
into `fanout` columns: their concatenation is the parent's input, and without a child's own slot they are its
siblings. A level has a `fanout`-th of the rows below it; proofs are built downwards, once for each run of
siblings, and never shuffled for each leaf.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import materialise

FIELDS, FANOUT, TAMPER_EVERY, SEED = ("doc_id", "source", "lang", "n_chars", "text"), 16, 5, 20240611
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_STEP = "array<struct<before:string,after:string>>"


def encoded(value: Column) -> Column:
    """`-` for null, else the count of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*inputs: Column) -> Column:
    return F.sha2(F.concat(*inputs), 256)


def numbered(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """rows with index (from 0, in order within the group) and size (of the group).

    rows are sampled for their ranges, so they should be stored. Rows that tie in the whole order are dealt
    to ranges at random, so that many equal rows do not meet in one task; which of them comes first makes no difference.
    """
    dealt = rows.withColumn("_tie", F.rand(SEED)).repartitionByRange(group, *order, "_tie").sortWithinPartitions(group, *order, "_tie")
    placed = materialise(dealt.drop("_tie").withColumn("_place", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_place", 33))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(group, "_part").agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    parts = parts.select(group, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_n").over(Window.partitionBy(group)).alias("size"))
    return placed.join(parts, [group, "_part"]).select(*rows.columns, (F.col("_place") + F.col("_shift")).alias("index"), "size")


def _slots(fanout: int) -> list[str]:
    return [f"slot{j}" for j in range(fanout)]


def spread(nodes: DataFrame, fanout: int) -> DataFrame:
    """A row for each run of `fanout` nodes (group, index, size, hash): the parent's index, size of its level and hash, and the run in slot columns."""
    own = [F.max(F.when(F.col("index") % fanout == j, F.col("hash"))).alias(s) for j, s in enumerate(_slots(fanout))]
    runs = nodes.groupBy("group", F.expr(f"index div {fanout}").alias("index")).agg(F.max("size").alias("size"), *own)
    return runs.withColumn("size", F.expr(f"(size + {fanout - 1}) div {fanout}")).withColumn("hash", F.sha2(F.concat_ws("", *_slots(fanout)), 256))


def tree(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """(the runs of every level from the leaves up, the group and hash of every root) over nodes (group, index, size, hash)."""
    levels, tops = [], [nodes.filter("size = 1")]
    most = nodes.agg(F.max("size")).first()[0] or 0
    while most > 1:
        levels.append(materialise(spread(nodes.filter("size > 1"), fanout)))
        nodes, most = levels[-1], -(-most // fanout)
        tops.append(nodes.filter("size = 1"))
    return levels, reduce(DataFrame.unionByName, (t.select("group", "hash") for t in tops))


def _step(slot: Column, fanout: int) -> Column:
    """The siblings of a slot, as what stands before and what stands after it."""
    before, after = ([F.when(keep(j), F.col(s)) for j, s in enumerate(_slots(fanout))] for keep in (lambda j: slot > j, lambda j: slot < j))
    return F.struct(F.concat_ws("", *before).alias("before"), F.concat_ws("", *after).alias("after"))


def with_paths(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """nodes (group, index, size and others) with path, the steps from the node to the last root, and the other columns of tops.

    tops (group, path and others) has the path of every group's root onwards.
    """
    given = [c for c in tops.columns if c not in ("group", "path")]
    above = None
    for level in reversed(levels):
        runs = level.select("group", "index", "size", *_slots(fanout))
        known = runs.filter("size = 1").join(tops, "group")
        if above is not None:
            known = known.unionByName(runs.filter("size > 1").join(above, ["group", "index"]))
        if level is levels[0]:
            below = known.select("group", F.col("index").alias("_run"), *_slots(fanout), "path", *given)
            slot = F.col("index") % fanout
            found = nodes.filter("size > 1").withColumn("_run", F.expr(f"index div {fanout}")).join(below, ["group", "_run"])
            found = found.withColumn("path", F.concat(F.array(_step(slot, fanout)), "path")).select(*nodes.columns, "path", *given)
            return found.unionByName(nodes.filter("size = 1").join(tops, "group").select(*nodes.columns, "path", *given))
        children = known.select("*", F.explode(F.array(*(F.when(F.col(s).isNotNull(), F.lit(j)) for j, s in enumerate(_slots(fanout))))).alias("_slot")).filter("_slot is not null")
        above = children.select("group", (F.col("index") * fanout + F.col("_slot")).alias("index"), F.concat(F.array(_step(F.col("_slot"), fanout)), "path").alias("path"), *given)
    return nodes.join(tops, "group").select(*nodes.columns, "path", *given)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the path of its siblings lead to."""
    return F.aggregate(path, leaf, lambda hash_, step: digest(step["before"], hash_, step["after"]))


def manifest(rows: DataFrame, leaf: Column, group: Column, order: dict[str, Column], kept: dict[str, Column], fanout: int = FANOUT) -> DataFrame:
    """leaf, subroot, root, path and the columns of `kept` for every row.

    A group's leaves ascend by `order` and then by their hash; nulls come first, and rows equal in both are interchangeable.
    While a group has several nodes, every run of `fanout` of them becomes the hash of their concatenation, the last run though
    it has fewer, even one. What remains is the group's subroot; subroots, ordered by group (null first, bytewise), likewise give the root.
    path holds the siblings level by level from the leaf to the root, empty where a run has no other node. No rows give no rows.
    """
    named = F.coalesce(F.concat(F.lit("="), group.cast("string")), F.lit(""))  # in the order asked for
    stored = materialise(rows.select(named.alias("group"), leaf.alias("hash"), *(c.alias(f"_by{i}") for i, c in enumerate(order.values())), *(c.alias(f"_kept{i}") for i, c in enumerate(kept.values()))))
    leaves = numbered(stored, "group", [*(f"_by{i}" for i in range(len(order))), "hash"])
    leaves = materialise(leaves.select("group", "index", "size", "hash", *(f"_kept{i}" for i in range(len(kept)))))
    levels, subroots = tree(leaves, fanout)
    subroots = materialise(subroots)
    tops = numbered(subroots.select(F.lit("").alias("group"), F.col("group").alias("name"), "hash"), "group", ["name"])
    upper, root = tree(tops, fanout)
    root = root.select("group", F.col("hash").alias("root"), F.array().cast(_STEP).alias("path"))
    starts = with_paths(tops, upper, root, fanout).select(F.col("name").alias("group"), F.col("hash").alias("subroot"), "root", "path")
    found = with_paths(leaves, levels, materialise(starts), fanout)
    return found.select(F.col("hash").alias("leaf"), "subroot", "root", "path", *(F.col(f"_kept{i}").alias(k) for i, k in enumerate(kept)))


def document_manifest(docs: DataFrame, fanout: int = FANOUT, tamper_every: int = TAMPER_EVERY) -> DataFrame:
    """The manifest of docs by source, and whether each document's proof holds after some texts were changed.

    A leaf is the hash of doc_id, source, lang, n_chars and text, each as encoded() gives it, so nulls in any of them and empty
    texts are values of their own. Leaves of a source ascend by doc_id (null first), then by hash: repeated rows are leaves each.
    Where tamper_every divides the crc32 of the decimal doc_id, the text's A-Z are lower-cased before the root is recomputed; a row
    without doc_id is never tampered with. Columns: doc_id, leaf, subroot, root, path, proof_sha256, folded_root, verified.
    Other columns are ignored; no rows give no rows; texts of any length are hashed whole.
    """
    d = docs.select(*(F.col(c).cast("string" if c in ("source", "lang", "text") else "bigint").alias(c) for c in FIELDS))
    leaf = digest(*(encoded(F.col(c)) for c in FIELDS))
    other = digest(*(encoded(F.translate(c, UPPER, LOWER) if c == "text" else F.col(c)) for c in FIELDS))
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % tamper_every == 0, other)
    found = manifest(d, leaf, F.col("source"), {"doc_id": F.col("doc_id")}, {"doc_id": F.col("doc_id"), "tampered": tampered}, fanout)
    proof = F.sha2(F.concat_ws("", F.transform("path", lambda s: F.concat(s["before"], s["after"]))), 256)
    found = found.select("doc_id", "leaf", "subroot", "root", "path", proof.alias("proof_sha256"), folded(F.coalesce("tampered", "leaf"), F.col("path")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_manifest(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("path")


#: crc32 of a decimal number's text.
CRC32_SQL = "xor(list_reduce(list_transform(string_split(cast({} AS varchar), ''), lambda x: cast(ascii(x) AS ubigint)), lambda crc, byte: list_reduce(range(8), lambda a, i: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, xor(crc, byte)), cast(4294967295 AS ubigint)), 4294967295)"
_FIELD = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(cast({0} AS varchar)) || ':' || {0} END"
_LEAF = "sha256(" + " || ".join(_FIELD.format(c) for c in FIELDS[:-1]) + " || " + _FIELD + ")"

ORACLE_SQL = f"""
WITH RECURSIVE leaf AS (
  SELECT row_number() OVER () AS id, coalesce('=' || source, '') AS grp, doc_id, {_LEAF.format('text')} AS hash,
    CASE WHEN {CRC32_SQL.format('doc_id')} % {TAMPER_EVERY} = 0 THEN {_LEAF.format(f"translate(text, '{UPPER}', '{LOWER}')")} END AS other
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, hash, id) - 1 AS i, count(*) OVER (PARTITION BY grp) AS size FROM leaf),
low AS (
  SELECT 0 AS level, grp, i, hash, size FROM placed
  UNION ALL
  SELECT level + 1, grp, i // {FANOUT}, sha256(string_agg(hash, '' ORDER BY i)), (max(size) + {FANOUT - 1}) // {FANOUT} FROM low WHERE size > 1 GROUP BY level, grp, i // {FANOUT}),
subroot AS (SELECT level, grp, hash, row_number() OVER (ORDER BY grp) - 1 AS i, count(*) OVER () AS size FROM low WHERE size = 1),
high AS (
  SELECT 0 AS level, i, hash, size FROM subroot
  UNION ALL
  SELECT level + 1, i // {FANOUT}, sha256(string_agg(hash, '' ORDER BY i)), (max(size) + {FANOUT - 1}) // {FANOUT} FROM high WHERE size > 1 GROUP BY level, i // {FANOUT}),
node AS (
  SELECT low.level, low.grp, low.i, low.hash, low.size > 1 AS inner_, 0 AS base FROM low WHERE size > 1
  UNION ALL SELECT high.level + subroot.level, subroot.grp, high.i, high.hash, true, subroot.level FROM high, subroot WHERE high.size > 1),
start AS (SELECT placed.id, placed.grp, placed.i, subroot.level AS height, subroot.i AS top, placed.hash, coalesce(placed.other, placed.hash) AS now FROM placed JOIN subroot USING (grp)),
fold AS (
  SELECT id, grp, CASE WHEN height = 0 THEN top ELSE i END AS i, height, top, 0 AS level, now, '' AS proof FROM start
  UNION ALL
  SELECT f.id, f.grp, CASE WHEN f.level + 1 = f.height THEN f.top ELSE f.i // {FANOUT} END, f.height, f.top, f.level + 1,
    sha256(string_agg(CASE WHEN n.i = f.i THEN f.now ELSE n.hash END, '' ORDER BY n.i)), f.proof || coalesce(string_agg(CASE WHEN n.i <> f.i THEN n.hash END, '' ORDER BY n.i), '')
  FROM fold f JOIN node n ON n.grp = f.grp AND n.level = f.level AND n.i // {FANOUT} = f.i // {FANOUT} GROUP BY f.id, f.grp, f.i, f.height, f.top, f.level, f.now, f.proof),
done AS (SELECT id, arg_max(now, level) AS now, arg_max(proof, level) AS proof FROM fold GROUP BY id)
SELECT doc_id, placed.hash AS leaf, subroot.hash AS subroot, high.hash AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = high.hash AS verified
FROM placed JOIN subroot USING (grp) JOIN done USING (id) JOIN high ON high.size = 1"""
