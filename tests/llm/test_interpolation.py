import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from covara.llm import interpolation as m


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]  # None: the end


def brute(rows):
    crc = lambda i: zlib.crc32(str(i).encode()) if i is not None else None
    held = [crc(i) is None or crc(i) % 5 == 1 for i, _ in rows]
    deleted = [crc(i) is not None and crc(i) % 20 == 0 for i, _ in rows]
    texts = [words(t) for _, t in rows]

    def counts(some):
        w, c, p = Counter(), Counter(), Counter()
        for text, own in zip(texts, some):
            if own:
                w.update(text)
                pairs = list(zip(["<s>", *text], text))
                c.update(a for a, _ in pairs)
                p.update(pairs)
        return w, c, p

    w, c, p = counts([not h for h in held])
    n, v = sum(w.values()), len(w)
    kw, kc, kp = counts([not h and not d for h, d in zip(held, deleted)])
    kn, uniform = sum(kw.values()), 1 / (v + 1)
    bucket = lambda x: 1 + int(math.log2(x)) if x else 0
    grain = lambda x: 10 ** (round(math.log10(x) / m.GRAIN) * m.GRAIN) if x else 0.0
    cells = Counter()
    for text, d in zip(texts, deleted):
        for a, b in zip(["<s>", *text], text) if d else ():
            cells[bucket(kc[a]), grain(kp[a, b] / max(1, kc[a])), grain(kw[b] / max(1, kn))] += 1
    weights = m.learn_weights(np.array([(*k, x) for k, x in cells.items()], float).reshape(-1, 4), uniform)
    out = []
    for (i, _), text, h in zip(rows, texts, held):
        base = sum(math.log10((w[b] + 0.5) / (n + 0.5 * (v + 1))) for b in text)
        score = sum(math.log10(float(np.dot(weights[bucket(c[a])], [p[a, b] / max(1, c[a]), w[b] / max(1, n), uniform]))) for a, b in zip(["<s>", *text], text))
        out.append((i, h, len(text), sum(w[b] > 0 for b in text), n, pytest.approx(base), pytest.approx(score)))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_query_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = m.op4_lm_score(spark, sf).collect()
    same(got, brute(rows))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_edges(spark, edges, empty):
    crc = "crc32(cast(cast(doc_id as string) as binary))"
    run = lambda df: m.score_texts(df, f"{crc} % 5 <> 1", f"{crc} % 20 = 0").collect()
    same(run(edges), brute([(r.doc_id, r.text) for r in edges.collect()]))
    assert run(empty) == []
    nothing = m.score_texts(edges, "false", "true").collect()
    assert {r.train_tokens for r in nothing} == {0} and all(r.score <= 0 for r in nothing)


def test_weights_prefer_what_predicts():
    cells = np.array([(5, 0.2, 0.001, 900), (5, 0.0, 0.001, 100), (1, 0.0, 0.01, 50), (1, 1.0, 0.01, 1), (0, 0, 0.01, 9)])
    w = m.learn_weights(cells, 1e-5)
    assert w.sum(1) == pytest.approx(1) and w[5, 0] > 0.8 and w[1, 0] < 0.1 and w[0, 0] == 0
