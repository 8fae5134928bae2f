"""Exact percentiles by selection: counts of ever finer ranges of values, never all values of a key in one place.

A double's bits, put in order, are read 16 at a time. Each round counts the rows of a key by the next 16 bits, which needs one
number for each of at most 65,536 ranges and task, finds the range that holds each wanted rank, and goes on with its rows
only. Four rounds name a value exactly, however many rows a key has and however often a value is repeated.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covara.sources.scratch import stored

STEP = 16
#: Ranges that are copied to all tasks at most, a few numbers each; beyond that Spark joins by shuffle.
MOST_COPIED = 200_000


def _ordered(column: pd.Series) -> pd.Series:
    """Integers in the order of the doubles; -0.0 is 0.0, NaN comes last."""
    x = column.to_numpy(float, na_value=np.nan) + 0.0
    bits = np.where(np.isnan(x), np.float64("nan"), x).view(np.int64)
    return pd.Series(np.where(np.isnan(x), np.iinfo(np.int64).max, np.where(bits < 0, bits ^ np.iinfo(np.int64).max, bits)))


def _same(names: Sequence[str]) -> Column:
    return reduce(Column.__and__, (F.col(f"a.{n}").eqNullSafe(F.col(f"b.{n}")) for n in names))


def _numbered(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value as a double and its bits in order, of the rows that have a value; stored, as every round reads them."""
    number = F.pandas_udf(_ordered, "bigint")(F.col(value).cast("double"))
    return stored(rows.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias(value), number.alias("_bits")))


def _selected(live: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame) -> DataFrame:
    """The columns of ranks (keys, rank from 0, others) with `value`, that of this rank among the key's rows of _numbered()."""
    wanted = stored(ranks.withColumns({"_low": F.lit(0).cast("bigint"), "_left": F.col("rank").cast("bigint")}))
    copied = F.broadcast if wanted.limit(MOST_COPIED + 1).count() <= MOST_COPIED else lambda df: df
    for shift in range(64 - STEP, -1, -STEP):
        parent = F.lit(0).cast("bigint") if shift + STEP == 64 else F.shiftright("_bits", shift + STEP)
        counted = live.groupBy(*keys, parent.alias("_low"), F.shiftright("_bits", shift).alias("_high")).agg(F.count("*").alias("_n"), F.min(value).alias(value))
        over = Window.partitionBy(*keys, "_low").orderBy("_high").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("_before", F.coalesce(F.sum("_n").over(over), F.lit(0)))
        # the ranks of a range meet its counts as one array, so no rank is paired with all of them
        asked = copied(wanted.groupBy(*keys, "_low").agg(F.collect_list(F.struct(*ranks.columns, "_left")).alias("_ranks")))
        inside = lambda r: (r["_left"] >= F.col("_before")) & (r["_left"] < F.col("_before") + F.col("_n"))
        met = counted.alias("a").join(asked.alias("b"), _same([*keys, "_low"])).select("_high", "_before", value, F.explode(F.filter("_ranks", inside)).alias("_r"))
        wanted = stored(met.select(*(F.col(f"_r.{c}").alias(c) for c in ranks.columns), F.col("_high").alias("_low"), (F.col("_r._left") - F.col("_before")).alias("_left"), value))
        if shift:
            wanted = wanted.drop(value)
            ranges = copied(wanted.select(*keys, F.col("_low").alias("_kept")).distinct())
            marked = live.withColumn("_kept", F.shiftright("_bits", shift))
            live = marked.alias("a").join(ranges.alias("b"), _same([*keys, "_kept"]), "left_semi").drop("_kept")
    return wanted.select(*ranks.columns, value)


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, points: Sequence[float]) -> DataFrame:
    """keys, n (values that are not null), least, most and p0, p1, ... for the points from 0 to 1, with linear interpolation between neighbours.

    A key without values has n 0 and nulls; null is a key like others; without keys there is one row. NaN counts as the greatest value.
    """
    names = list(keys) or ["_all"]
    rows = rows if keys else rows.withColumn("_all", F.lit(0))
    live = _numbered(rows, names, value)
    stats = live.groupBy(*names).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))
    empty = rows.filter(F.col(value).isNull()).select(*names).distinct()
    stats = stored(stats.unionByName(empty, allowMissingColumns=True).groupBy(*names).agg(F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("n"), F.max("least").alias("least"), F.max("most").alias("most")))
    rank = lambda p, side: (F.floor if side == 0 else F.ceil)(F.lit(float(p)) * (F.col("n") - 1)).cast("bigint")
    places = F.array(*(F.struct(F.lit(i).alias("point"), F.lit(side).alias("side"), rank(p, side).alias("rank")) for i, p in enumerate(points) for side in (0, 1)))
    ranks = stats.filter("n > 0").select(*names, F.explode(places).alias("x")).select(*names, "x.*")
    found = _selected(live, names, value, ranks)
    sides = [f"_{i}_{side}" for i in range(len(points)) for side in (0, 1)]
    one = found.groupBy(*names).agg(*(F.max(F.when((F.col("point") == i) & (F.col("side") == side), F.col(value))).alias(f"_{i}_{side}") for i in range(len(points)) for side in (0, 1)))
    joined = stats.alias("a").join(one.alias("b"), _same(names), "left").select(*(f"a.{k}" for k in names), "n", "least", "most", *sides)
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    out = [(F.col(f"_{i}_0") + F.when(F.col(f"_{i}_0") == F.col(f"_{i}_1"), 0.0).otherwise((F.col(f"_{i}_1") - F.col(f"_{i}_0")) * (place(p) - F.floor(place(p))))).alias(f"p{i}") for i, p in enumerate(points)]
    return joined.select(*keys, "n", "least", "most", *out)
