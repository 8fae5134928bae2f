import hashlib
import random

import numpy as np
import pytest

from covara.llm import suffixes as s
from covara.llm.blocks import Blocks, _pack_keys, _unpack_keys

from .conftest import prose


def brute(rows, length):
    rows = [(10**18 if i is None else i, (t or "").encode(), i) for i, t in rows]
    first: dict = {}
    for i, b, _ in rows:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = []
    for i, b, shown in rows:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum()) if len(b) else 0
        out.append((shown, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=str)


def run(df, length):
    return sorted((tuple(r) for r in s.remove_repeats(df, length).collect()), key=str)


def test_query_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in s.op10_suffix_dedup(spark, sf).collect()), key=str)
    assert got == brute(rows, 50) and sum(r[2] for r in got) > 0


@pytest.mark.parametrize("length", [4, 7, 50])
def test_random_texts(spark, length):
    r = random.Random(length)
    passages = [prose(900 + i, 12) for i in range(5)]
    rows = []
    for i in range(60):
        text = "".join(r.choice("ab") for _ in range(r.randint(0, 40))) if length < 50 else prose(i, 15) + r.choice(passages) + prose(i + 500, r.randint(0, 9)) + r.choice(["", "z" * 120, passages[0][:55], passages[1][3:] * 2])
        rows.append((r.randint(0, 50), text))
    assert run(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), length) == brute(rows, length)


def test_edges(edges, empty):
    rows = [(r.doc_id, r.text) for r in edges.collect()]
    assert run(edges, 50) == brute(rows, 50)
    assert run(empty, 50) == []


def test_small_blocks_give_the_same(documents):
    texts = documents.limit(60).selectExpr("doc_id", "text").cache()
    whole = run(texts, 50)
    real = s.Blocks
    try:
        s.Blocks = lambda d: real(d, 2000)
        assert run(texts, 50) == whole
    finally:
        s.Blocks = real


def test_key_packing():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64))
    counts = np.arange(len(keys), dtype=np.uint32)
    back = _unpack_keys(_pack_keys(keys, counts), "u4")
    assert (back[0] == keys).all() and (back[1] == counts).all()


def test_table_is_dropped(spark, documents):
    with Blocks(documents.select("doc_id", "text")) as b:
        assert spark.catalog.tableExists(b.name)
    assert not spark.catalog.tableExists(b.name)
