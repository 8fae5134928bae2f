"""CSV and JSON exports as rows of text, for df.write.text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from covara.functions.scalar import csv_cell
from covara.sources.scratch import stored


def numbered(rows: DataFrame, order: list[str], first: int = 0, group: str | None = None) -> DataFrame:
    """rows with line_no, their place in the order from `first` on, without gaps, within each value of a group column if one is named.

    Rows are sorted by ranges, each of which begins where the counts of those before it end; a large group spreads over ranges. Null is a group like others.
    """
    rows_ = rows if group else rows.withColumn("_group", F.lit(0))
    by = group or "_group"
    placed = stored(rows_.repartitionByRange(by, *order).sortWithinPartitions(by, *order).withColumn("_place", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_place", 33))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = placed.groupBy(by, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    parts = parts.select(F.col(by).alias("_of"), "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + first).alias("_shift"))  # a row for each range and group in it
    met = placed.alias("a").join(parts.alias("b"), (F.col("a._part") == F.col("b._part")) & F.col(f"a.{by}").eqNullSafe(F.col("b._of")))
    return met.select(*(f"a.{c}" for c in rows.columns), (F.col("_place") + F.col("_shift")).alias("line_no"))


def csv_rows(rows: DataFrame, note: str, columns: list[str], order: list[str]) -> DataFrame:
    """line_no and line: a quoted note (0), the header (1), then the rows in order, all cells quoted and guarded. No task holds all rows."""
    quote = lambda x: '"# ' + x.replace('"', '""') + '"'
    head = rows.sparkSession.createDataFrame([(0, quote(note)), (1, ",".join(columns))], "line_no bigint, line string")
    line = F.concat_ws(",", *(csv_cell(F.col(c)) for c in columns)).alias("line")
    return head.unionByName(numbered(rows.select(*order, line), order, 2).select("line_no", "line"))


def json_rows(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(F.to_json(F.struct(*columns)).alias("line"))


def json_document(rows: DataFrame, columns: list[str], order: list[str], name: str = "topics", summary: DataFrame | None = None, **fields: str) -> DataFrame:
    """One document with the given fields, a summary (one row) and all rows under a name; for results that fit in one value."""
    key = F.struct(*order, *[c for c in columns if c not in order])
    listed = F.transform(F.array_sort(F.collect_list(key)), lambda x: F.struct(*(x[c].alias(c) for c in columns)))
    one = rows.agg(listed.alias("rows"))
    if summary is not None:
        one = one.join(summary.select(F.struct(*summary.columns).alias("summary")))  # one row each
    parts = [F.lit(x).alias(k) for k, x in fields.items()] + ([F.col("summary")] if summary is not None else [])
    return one.select(F.to_json(F.struct(*parts, F.col("rows").alias(name))).alias("line"))


def json_lines(rows: DataFrame, columns: list[str], order: list[str], name: str, summary: DataFrame, **fields: str) -> DataFrame:
    """line_no and line of one JSON document: a first line with the fields and the summary (one row), a line for each row in order, and a last one. No task holds all rows."""
    one = numbered(rows.select(*order, F.to_json(F.struct(*columns)).alias("line")), order, 1).select("line_no", "line")
    n = rows.count()
    opened = F.to_json(F.struct(*(F.lit(x).alias(k) for k, x in fields.items()), F.struct(*summary.columns).alias("summary")))
    head = summary.select(F.lit(0).cast("bigint").alias("line_no"), F.concat(F.substr(opened, F.lit(1), F.length(opened) - 1), F.lit(f',"{name}":[')).alias("line"))
    body = one.select("line_no", F.concat("line", F.when(F.col("line_no") < n, ",").otherwise("")).alias("line"))
    return head.unionByName(body).unionByName(rows.sparkSession.createDataFrame([(n + 1, "]}")], "line_no bigint, line string"))
