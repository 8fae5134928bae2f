import re
from fractions import Fraction

import pytest

from covara.llm import mixing as m


def test_water_fill():
    assert m.water_fill([10, 10], [3, 1], 12, 2) == [9, 3]
    assert m.water_fill([10, 100], [3, 1], 60, 2) == [20, 40]
    assert m.water_fill([1, 1], [1, 1], 10, 2) == [2, 2]
    assert m.water_fill([0, 8], [1, 1], 12, 2) == [0, 12]
    assert m.water_fill([], [], 0, 2) == []


@pytest.mark.parametrize("range_rows", [50_000, 3])
def test_budgets(documents, edges, range_rows):
    for df in (documents, edges):
        rows = m.mix_sources(df, range_rows=range_rows).collect()
        assert len(rows) == df.count()
        whole = sum(r["size"] for r in rows)
        by: dict = {}
        for r in rows:
            by.setdefault(r.source, []).append(r)
            assert 0 <= r.taken <= 2 * r["size"]
        for source, some in by.items():
            assert {x.source_size for x in some} == {sum(x["size"] for x in some)}
            assert abs(sum(x.taken for x in some) - some[0].target) < 1 + 1e-6
            full = int(some[0].target // max(1, some[0].source_size))
            assert sum(x.taken not in (full * x["size"], (full + 1) * x["size"]) for x in some) <= 1
        assert sum(x[0].target for x in by.values()) == pytest.approx(1.5 * whole)
        order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
        free = [(x, w) for x, w in zip(order, (3, 1, 2) * len(order)) if by[x][0].target < 2 * by[x][0].source_size - 1e-9]
        assert len({round(by[x][0].target / w, 6) for x, w in free}) <= 1


def test_reruns_agree(documents):
    first = sorted(map(tuple, m.mix_sources(documents).collect()))
    assert first == sorted(map(tuple, m.mix_sources(documents.repartition(7)).collect()))


def test_empty(empty):
    assert m.mix_sources(empty).count() == 0


def test_taken_matches_a_walk_in_order(spark, documents):
    """Every source's rows in hash order, one after the other, until its target's whole words are taken."""
    from pyspark.sql import functions as F

    rows = documents.select("doc_id", "source", "text").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r.doc_id)
    names = sorted(by, key=lambda x: (x is None, (x or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    whole = {s: sum(size[i] for i in by[s]) for s in names}
    target, left, free = {}, Fraction(3, 2) * sum(whole.values()), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * whole[s]}
        if not over:
            target.update(share)
            break
        target.update({s: Fraction(2 * whole[s]) for s in over})
        left -= sum(target[s] for s in over)
        free -= over
    epochs = {s: int(target[s] // whole[s]) if whole[s] else 0 for s in names}
    key = {(r.doc_id, e): r.k for e in set(epochs.values()) for r in documents.select("doc_id", F.xxhash64("doc_id", F.lit(e).cast("bigint"), F.lit(m.SEED)).alias("k")).collect()}
    want = {}
    for s in names:
        rest = int(target[s] // 1) - epochs[s] * whole[s]
        for i in sorted(by[s], key=lambda i: (key[i, epochs[s]] % 2**64, i, size[i])):  # unsigned: ranges go by the leading bits
            extra = max(0, min(size[i], rest))
            rest -= size[i]
            want[i] = epochs[s] * size[i] + extra
    found = m.mix_sources(documents).collect()
    assert {r.doc_id: r.size for r in found} == size
    assert all(abs(r.target - float(target[r.source])) < 1e-6 * max(1, r.target) for r in found)
    got, wrong = {r.doc_id: r.taken for r in found}, 0
    for s in names:
        assert sum(got[i] for i in by[s]) == sum(want[i] for i in by[s])
        wrong += sum(got[i] != want[i] for i in by[s])
    assert wrong == 0
