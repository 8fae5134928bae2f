import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(*x, True) for x in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("node", T.StringType()), ("size", T.StringType()), ("fp", T.StringType()), ("base", T.StringType()), ("kept", T.StringType()), ("spans", T.StringType()), ("block", T.StringType()), ("score", T.StringType()))])

WORDS = "the of and river stone walks under bright morning while seven ships carry letters home über straße niño été 漢字 😀smile".split()


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", "\n", "\t", "  ", "\r\n"]) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows, columns whose names the operators use inside."""
    texts = [None, "", " \n\t ", "one", "Hello, World", prose(1, 30), prose(2, 400), prose(2, 400), prose(3, 60_000), "a" * 5000, "ab " * 900, "x\n\n\nx\nx", "  nbsp", "\x00nul\x0bvt\x0cff"]
    rows = [(i, t, "en", None if i % 4 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(20, prose(2, 400), None, "s1", None), (20, prose(2, 400), None, "s1", None), (None, prose(5, 40), "de", None, None), (None, None, None, None, None), (6, prose(6, 50), "fr", "", 0)]
    return [(*r, *["clash"] * 8) for r in rows]


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def by_id(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(x is not None, x) if not isinstance(x, (list, dict)) else str(x) for x in r])
