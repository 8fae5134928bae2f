import random
import re
import time
from collections import Counter

import numpy as np
import xxhash

from covara.llm import simhash as s
from covara.llm.components import connected_components


def brute(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    ones = Counter(b for x in shingles for b in range(64) if xxhash.xxh64_intdigest(x.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def classes(nodes, most=4):
    """(id, fp) -> smallest id reachable, pair by pair."""
    out = {i: i for i, _ in nodes}
    changed = True
    while changed:
        changed = False
        for i, x in nodes:
            for j, y in nodes:
                if (x ^ y).bit_count() <= most and out[i] != out[j]:
                    out[i] = out[j] = min(out[i], out[j])
                    changed = True
    return out


def test_query_matches_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = {r.doc_id: brute(r.text) for r in rows}
    component = classes(list(want.items()))
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in s.op9_simhash(spark, sf).collect()}
    assert got == {i: (fp, component[i]) for i, fp in want.items()}


def test_edges(edges, empty):
    rows = s.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    fps = {r.doc_id: r.fp & (1 << 64) - 1 for r in rows if r.doc_id is not None}
    assert fps[0] == fps[1] == fps[2] == 0 and {r.component_id for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert {r.component_id for r in rows if r.doc_id in (7, 20)} == {6}
    assert s.near_duplicates(empty).count() == 0


def clusters(seed, n):
    r = random.Random(seed)
    out = set()
    for _ in range(n):
        x = r.getrandbits(64)
        for _ in range(r.choice([1, 1, 2, 5, 150])):
            y = x
            for _ in range(r.randint(0, 6)):
                y ^= 1 << r.randrange(64)
            out.add(y)
            x = y if r.random() < 0.3 else x
    return sorted(out)


def test_links_keep_every_component(spark):
    fps = clusters(4, 12)
    nodes = [(i, x) for i, x in enumerate(fps)]
    df = spark.createDataFrame([(i, x - (1 << 64) if x >> 63 else x) for i, x in nodes], "node long, fp long")
    found = {r.node: r.component for r in connected_components(s.near_links(df)).collect()}
    assert {i: found.get(i, i) for i, _ in nodes} == classes(nodes)


def test_large_groups_by_leaders():
    fps = np.array(clusters(8, 10), np.uint64)
    a, b = s.leader_links(fps, s.pivot_table(fps), 4)
    label = s.local_components(len(fps), a, b)
    assert dict(enumerate(label.tolist())) == classes(list(enumerate(fps.tolist())))
    assert len(a) < 4 * len(fps)


def test_masks_cover_every_link():
    masks, r = s.block_masks(4, 3), random.Random(1)
    for _ in range(300):
        flips = sum(1 << b for b in r.sample(range(64), 4))
        assert any(not flips & m for m in masks)


def test_components_of_chains(spark):
    links = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 500), (7, 7), (600, 700), (700, 650)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "src long, dst long")).collect()}
    assert found == {**{i: 0 for i in range(201)}, 400: 400, 500: 400, 600: 600, 650: 600, 700: 600}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_a_large_group_is_split_without_a_miss():
    """Many different fingerprints that agree on 27 bits, some of them near each other."""
    r = random.Random(4)
    fixed, fps = r.getrandbits(27) << 37, set()
    while len(fps) < 1500:
        x = r.getrandbits(37)
        fps.add(fixed | x)
        if r.random() < 0.3:
            for _ in range(r.randint(1, 5)):
                x ^= 1 << r.randrange(37)
            fps.add(fixed | x)
    fp = np.array(sorted(fps), np.uint64)
    a, b = s.split_links(fp, s.pivot_table(fp), 4)
    near = [(i, j) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp) <= 4).tolist() if j > i]
    want = s.local_components(len(fp), *(np.array(x) for x in zip(*near)))
    assert (s.local_components(len(fp), a, b) == want).all() and len(set(want.tolist())) < len(fp)


def test_large_groups_take_time_in_proportion():
    r = np.random.default_rng(1)
    fp = np.unique(r.integers(0, 2**37, 40_000, dtype=np.uint64)) | np.uint64(5 << 40)
    began = time.time()
    s.split_links(fp, s.pivot_table(fp), 4)
    assert time.time() - began < 60


def test_rows_without_doc_id_join_others(spark, monkeypatch):
    """Fingerprints 3 and 4 bits apart over one that only a row without doc_id has, and a group without any doc_id."""
    rows = [(1, 0b0), (None, 0b111), (3, 0b1111111), (None, 1 << 40), (None, 3 << 40), (9, -1)]
    monkeypatch.setattr(s, "fingerprints", lambda docs, words: docs)
    found = s.fingerprint_groups(spark.createDataFrame(rows, "doc_id long, fp long")).collect()
    assert sorted(((r.doc_id, r.fp, r.component_id) for r in found), key=str) == sorted([(1, 0, 1), (None, 7, 1), (3, 127, 1), (None, 1 << 40, 1), (None, 3 << 40, 1), (9, -1, 9)], key=str)
    lone = s.fingerprint_groups(spark.createDataFrame([(None, 5), (None, 4), (2, -1)], "doc_id long, fp long")).collect()
    assert {(r.fp, r.component_id) for r in lone} == {(5, None), (4, None), (-1, 2)}
