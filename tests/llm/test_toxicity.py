from itertools import product

import numpy as np
import pytest

from covara.llm import toxicity as t


def test_marginals_match_enumeration():
    r = np.random.default_rng(1)
    for sizes in ([5], [1, 4, 2], [3, 3, 3, 1]):
        f = t.Field(transitions=r.normal(0, 1, (2, 2)), start=r.normal(0, 1, 2))
        e = r.normal(0, 2, sum(sizes))
        first = np.zeros(len(e), bool)
        first[np.cumsum([0, *sizes[:-1]])] = True
        p, pair = t.marginals(f, e, first)
        at = 0
        for n in sizes:
            weight = {}
            for path in product((0, 1), repeat=n):
                s = f.start[path[0]] + sum(f.transitions[a, b] for a, b in zip(path, path[1:])) + sum(e[at + i] * x for i, x in enumerate(path))
                weight[path] = np.exp(s)
            z = sum(weight.values())
            for i in range(n):
                assert p[at + i] == pytest.approx(sum(w for x, w in weight.items() if x[i]) / z)
                if i:
                    assert pair[at + i, 0, 1] == pytest.approx(sum(w for x, w in weight.items() if (x[i - 1], x[i]) == (0, 1)) / z)
            at += n


def test_long_chains_do_not_depend_on_segments():
    r = np.random.default_rng(3)
    f, e = t.Field(transitions=np.array([[1.0, -1], [-0.5, 2]])), r.normal(-1, 3, 1000)
    first = np.zeros(1000, bool)
    first[[0, 300, 301]] = True
    p, _ = t.marginals(f, e, first)
    before = t.SEGMENT
    try:
        t.SEGMENT = 7
        assert np.allclose(p, t.marginals(f, e, first)[0])
    finally:
        t.SEGMENT = before


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    rows = t.op6_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.9
    assert sum(r.predicted for r in clean) / len(clean) < 0.01
    assert all((r.predicted == 1) == (r.score >= 0.7) for r in rows)


def test_spans(spark):
    texts = ["the good day was long and bright and we walked home", "you are a horrid idiot and the day was long"] * 30
    model = t.fit_field(texts, np.array([False, True] * 30))
    df = spark.createDataFrame([(1, "über the horrid idiot walked", False), (2, "the day was long", False)], "doc_id long, text string, held_out boolean")
    a, b = sorted(t.score_toxicity(df, model).collect())
    assert a.score > 0.7 > b.score and not b.spans
    assert any(s.start <= 9 and s.end >= 21 for s in a.spans)


def test_edges(spark, edges, empty):
    model = t.fit_field(["fine words here"] * 20 + ["vile vile words"] * 20, np.repeat([False, True], 20))
    rows = t.score_toxicity(edges.selectExpr("*", "false held_out"), model).collect()
    assert len(rows) == edges.count() and all(0 <= r.score <= 1 for r in rows)
    assert t.score_toxicity(empty.selectExpr("*", "false held_out"), model).count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert t.fit(edges, none) is None
    assert {r.score for r in t.score_toxicity(edges.selectExpr("*", "false held_out"), None).collect()} == {0.0}
