"""Work on documents of which some fail: what a document raises stays with it, and the others go on.

Results and failures are committed together, document by document, so a run that is cut off and started again repeats no finished
work; a failed document is tried again in later runs until it has had its attempts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from covara.sources.versions import Store

MOST_ERROR_CHARS = 500


def attempted(rows: DataFrame, key: str, inputs: list[str], work: Callable[[dict[str, Any], int], Any], returns: T.DataType, attempts: str | None = None) -> DataFrame:
    """key, attempt, value and error of each row: value is what work(inputs as a dict, number of the attempt from 1) gives, error `Type: message` of the exception that it raised.

    A value that does not fit `returns` is an error of its row like others. `attempts` names a column of earlier attempts. Rows are read in
    batches and handled one by one; null inputs reach the work as None.
    """
    value_type = to_arrow_type(returns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, errors = [], []
            numbers = [n + 1 for n in batch.column(1).to_pylist()]
            columns = {c: batch.column(2 + i) for i, c in enumerate(inputs)}
            for i, n in enumerate(numbers):
                try:
                    value = pa.array([work({c: x[i].as_py() for c, x in columns.items()}, n)], value_type)[0]
                    error = None
                except Exception as e:  # whatever a document raises is its own
                    value, error = pa.scalar(None, value_type), f"{type(e).__name__}: {e}"[:MOST_ERROR_CHARS]
                values.append(value.as_py())
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(numbers, pa.int32()), pa.array(values, value_type), pa.array(errors, pa.string())], names=["key", "attempt", "value", "error"])

    before = F.coalesce(F.col(attempts), F.lit(0)).cast("int") if attempts else F.lit(0)
    asked = rows.select(F.col(key).alias("key"), before.alias("attempt"), *inputs)
    schema = T.StructType([T.StructField("key", rows.schema[key].dataType), T.StructField("attempt", T.IntegerType()), T.StructField("value", returns), T.StructField("error", T.StringType())])
    return asked.mapInArrow(run, schema).withColumnRenamed("key", key)


def tables(key: str, key_type: str, returns: str) -> dict[str, tuple[str, str]]:
    """The tables of a store for run_isolated."""
    return {"results": (f"{key} {key_type}, attempt int, value {returns}", key), "quarantine": (f"{key} {key_type}, attempt int, error string", key)}


def to_try(store: Store, documents: DataFrame, key: str, most_attempts: int) -> DataFrame:
    """documents without result and with attempts left, with attempt, the number they had."""
    failed = store.read("quarantine").select(key, "attempt")
    rows = documents.join(store.read("results").select(key), key, "left_anti").join(failed, key, "left")
    return rows.withColumn("attempt", F.coalesce("attempt", F.lit(0))).filter(F.col("attempt") < most_attempts)


def run_isolated(store: Store, documents: DataFrame, key: str, inputs: list[str], work: Callable[[dict[str, Any], int], Any], most_attempts: int = 3) -> dict[str, int]:
    """Tries what is to be tried and commits results and quarantine; the numbers of documents that were done and that failed in this run.

    Keys must be distinct and not null. A document that succeeds leaves the quarantine.
    """
    spark = documents.sparkSession
    returns = spark.createDataFrame([], store.tables["results"][0]).schema["value"].dataType
    staged = f"{store.path}/staged/{uuid.uuid4().hex}"
    attempted(to_try(store, documents, key, most_attempts), key, inputs, work, returns, "attempt").write.parquet(staged)
    tried = spark.read.parquet(staged)
    store.replace({"results": (tried.filter("error is null").select(key, "attempt", "value"), tried), "quarantine": (tried.filter("error is not null").select(key, "attempt", "error"), tried)})
    counts = tried.agg(F.count_if(F.col("error").isNull()).alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed")).first()
    fs, at = store._fs(staged)
    fs.delete(at, True)
    return {"done": counts["done"], "failed": counts["failed"]}


def summary(counts: dict[str, int]) -> tuple[str, int]:
    """A line for the log and the exit status of a run."""
    done, failed = counts["done"], counts["failed"]
    return (f"processed {done}, failed {failed}", 1) if failed else (f"processed {done}, all succeeded", 0)
