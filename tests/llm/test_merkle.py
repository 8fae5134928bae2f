import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from covara.llm import merkle as m

from ..oracle import connect, differences


def h(x: str) -> str:
    return hashlib.sha256(x.encode()).hexdigest()


def leaf(r, lower=False):
    values = [r.doc_id, r.source, r.lang, r.n_chars, r.text]
    if lower and r.text is not None:
        values[4] = r.text.translate(str.maketrans(m.UPPER, m.LOWER))
    return h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in values))


def steps(hashes, fanout):
    """Siblings (before, after) of every node up to the root, level by level, and the root."""
    at, out, level = list(range(len(hashes))), [[] for _ in hashes], hashes
    while len(level) > 1:
        for i, a in enumerate(at):
            run = level[a - a % fanout : a - a % fanout + fanout]
            out[i].append(("".join(run[: a % fanout]), "".join(run[a % fanout + 1 :])))
            at[i] = a // fanout
        level = [h("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return out, level[0]


def brute(rows, fanout):
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for some in by.values():
        some.sort(key=lambda r: (r.doc_id is not None, r.doc_id, leaf(r)) if r.doc_id is not None else (False, 0, leaf(r)))
    low = {s: steps([leaf(r) for r in by[s]], fanout) for s in names}
    high, root = steps([low[s][1] for s in names], fanout)
    out = []
    for s, above in zip(names, high):
        for r, own in zip(by[s], low[s][0]):
            path = own + above
            now = leaf(r, r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % m.TAMPER_EVERY == 0)
            for before, after in path:
                now = h(before + now + after)
            out.append((r.doc_id, leaf(r), low[s][1], root, h("".join(a + b for a, b in path)), now, now == root))
    return sorted(out, key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("fanout", [2, 3, 16])
def test_against_brute_force(documents, edges, fanout):
    for df in (documents, edges, edges.filter("doc_id = 3"), documents.filter("source = 'src1'")):
        rows = df.collect()
        assert sorted((tuple(r) for r in m.document_manifest(df, fanout).select(COLUMNS).collect()), key=str) == brute(rows, fanout)


def test_only_changed_texts_fail(documents):
    found = m.document_manifest(documents).select("doc_id", "verified").collect()
    texts = {r.doc_id: r.text for r in documents.collect()}
    changed = {i for i, t in texts.items() if zlib.crc32(str(i).encode()) % m.TAMPER_EVERY == 0 and t and t != t.translate(str.maketrans(m.UPPER, m.LOWER))}
    assert changed and {r.doc_id for r in found if not r.verified} == changed


def test_empty(empty):
    assert m.document_manifest(empty).count() == 0


def test_repeated_rows_and_one_group(spark, documents):
    """A group of equal rows is dealt to several ranges and still numbered without gaps."""
    same = spark.range(5000).select(F.lit("g").alias("group"), F.lit(1).alias("by"))
    found = m.numbered(same, "group", ["by"]).collect()
    assert sorted(r["index"] for r in found) == list(range(5000)) and {r["size"] for r in found} == {5000}
    one = documents.limit(1).crossJoin(spark.range(40)).drop("id")
    rows = m.document_manifest(one).collect()
    assert len(rows) == 40 and len({r.leaf for r in rows}) == 1 and len({r.proof_sha256 for r in rows}) <= 2


def test_query_matches_sql(spark, sf):
    assert not differences(m.op11_merkle_manifest(spark, sf), connect(sf), m.ORACLE_SQL)
