"""Mixing sources to target weights: hash-random order within each source, prefix sums, and a cut at the exact budget.

The order within a source is that of a hash of doc_id. Its leading bits cut a source into ranges of about
`range_rows` rows, each a group of its own, so that a source with a third of all rows spreads over many
tasks: a range's sizes are summed before the shuffle, ranges get their offsets by a running sum
over those few totals, and rows are ordered only within their range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textarrays as ta
from .tables import materialise

WEIGHTS, SHARE, MOST_EPOCHS, RANGE_ROWS, MOST_SOURCES, SEED = (3.0, 1.0, 2.0), 1.5, 2.0, 50_000, 100_000, 20240607


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Targets in proportion to the weights, none above `most` times its size; what is cut off goes to the rest by weight."""
    out, free, left = [0.0] * len(sizes), list(range(len(sizes))), total
    while free:
        whole = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / whole > most * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / whole
            break
        for i in over:
            out[i] = most * sizes[i]
        left -= sum(out[i] for i in over)
        gone = set(over)
        free = [i for i in free if i not in gone]
    return out


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in ta.slices(batch):
            data, at = ta.text_bytes(part.column("text"))
            start, _ = ta.runs(~ta.SPACE[data], at)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("source"), pa.array(np.diff(np.searchsorted(start, at)).astype(np.int64))], names=["doc_id", "source", "size"])


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most_epochs: float = MOST_EPOCHS, range_rows: int = RANGE_ROWS) -> DataFrame:
    """How many words of each row of docs (doc_id, text, source) a mix takes: doc_id, source, size, source_size, target, taken.

    Sources in code-point order, null last as a source of its own, take the weights in turn. The targets
    share `share` times all words, capped at `most_epochs` times the source. A source is taken
    whole as often as its target allows; of the last epoch its rows are taken in hash order up to the whole words of
    the target, the last row in part. Null texts have size 0. Repeated rows count each; rows that tie on the
    hash are ordered by doc_id (null first) and size, so reruns agree. An empty table gives no rows.
    There may be at most 100,000 sources (an error above that); other columns are ignored.
    """
    spark = docs.sparkSession
    sized = materialise(docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(source as string) source", "cast(text as string) text").mapInArrow(_sizes, "doc_id bigint, source string, size bigint"))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; weights are for a stated set of sources")
    totals.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    given = [float(weights[i % len(weights)]) for i in range(len(totals))]
    targets = water_fill([r["source_size"] for r in totals], given, share * sum(r["source_size"] for r in totals), most_epochs)
    rows = [(r["source"], r["source_size"], t, epochs := (int(t // r["source_size"]) if r["source_size"] else 0), math.floor(t) - epochs * r["source_size"]) for r, t in zip(totals, targets)]
    plan = F.broadcast(spark.createDataFrame(rows, "source string, source_size bigint, target double, epochs bigint, rest bigint"))  # one row a source: bounded above

    # at least a range for each shuffle partition, so that a small table with one large source is spread too
    bits = math.ceil(math.log2(max(2, sum(r["n"] for r in totals) / range_rows, int(spark.conf.get("spark.sql.shuffle.partitions")))))
    key = F.xxhash64("doc_id", "epochs", F.lit(SEED))
    dealt = (
        sized.alias("s").join(plan.alias("p"), F.col("s.source").eqNullSafe(F.col("p.source")))
        .select("doc_id", F.col("s.source").alias("source"), F.col("s.source").isNull().alias("no_source"), F.coalesce("s.source", F.lit("")).alias("name"), "size", "source_size", "target", "epochs", "rest", key.alias("key"))
        .withColumn("range", F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long"))
    )
    of_range = ["no_source", "name", "range"]
    before = Window.partitionBy("no_source", "name").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy(*of_range).agg(F.sum("size").alias("words")).select(*of_range, F.coalesce(F.sum("words").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*of_range).orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(offsets, of_range).withColumn("start", F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    extra = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("start")))
    return placed.select("doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"))


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
