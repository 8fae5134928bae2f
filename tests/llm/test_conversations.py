import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from covara.llm import conversations as c

from ..oracle import connect, differences

SCHEMA = "conv_id long, turn long, role string, text string, path string, turns string, n string, before string"


def brute(rows):
    own = {}
    for r in rows:
        if r["conv_id"] is not None:
            digest = hashlib.sha256(f"{len((r['role'] or '').encode())}:{r['role'] or ''}{r['text'] or ''}".encode()).digest()
            own.setdefault(r["conv_id"], []).append((r["turn"] is not None, r["turn"] or 0, digest, r["role"] or "", r["text"] or ""))
    own = {k: [x[3:] for x in sorted(v)] for k, v in own.items()}
    convs = {}
    for k, v in own.items():
        h = zlib.crc32(str(k).encode()) % 4
        convs[k] = tuple(own.get(k - int(math.fmod(k, 20)), [])[:h] + v[h:])
    members, ends = {}, {}
    for k, v in convs.items():
        for d in range(len(v) + 1):
            members.setdefault(v[:d], []).append(k)
        ends.setdefault(v, []).append(k)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[x] for x in children.get(p, [])) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[x] for x in children.get(p, []))
    sha = {p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest() for p in members}
    return sorted(str((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], sha[p])) for p, m in members.items())


def found(df, **given):
    trie = c.prefix_trie(c.rebuilt(c.turn_sequences(df)), **given)
    return sorted(str(tuple(r)) for r in trie.select("conv_id", "depth", "parent_conv_id", *c._COUNTS, "ends_sha256").collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, *["clash"] * 4) for r in rows], SCHEMA)


def odd_rows():
    rows = [(i, t, "user" if t % 2 else "bot", f"w{t} x") for i in range(70) for t in range(5)]  # copies and the common first turn
    rows += [(i, t, None if t == 2 else "user", None if t == 3 else f"{'a b ' * (i % 3)}{t}") for i in range(80, 100) for t in range(i % 6)]
    rows += [(101, 0, "u", "only"), (119, 0, "u", "one"), (103, None, "u", "first"), (103, None, "b", "also first"), (103, 1, "u", "tie"), (103, 1, "u", "tie"), (103, 1, "b", "tie")]
    rows += [(None, 0, "u", "no conversation"), (None, None, None, None), (-7, 0, "u", "minus"), (120, 0, "", ""), (121, 0, None, None), (140, 0, "u", "word " * 30_000), (141, 0, "u", "word " * 30_000)]
    rows += [(160, t, "u", f"long {t}") for t in range(300)] + [(161, t, "u", f"long {t}") for t in range(200)] + [(180, t, "u", "same") for t in range(50)]
    return rows


@pytest.mark.parametrize("run_turns,ids_per_text", [(200_000, 1000), (1, 1), (7, 3), (60, 2)])
def test_against_brute_force(spark, run_turns, ids_per_text):
    df = frame(spark, odd_rows())
    assert found(df, run_turns=run_turns, ids_per_text=ids_per_text) == brute(df.collect())


def test_given_table(spark, sf):
    df = spark.read.parquet(f"{sf}/conversations.parquet")
    assert found(df, run_turns=40) == found(df.repartition(9)) == brute(df.collect())


def test_hot_sequence(spark):
    """Two thirds of the conversations are copies of one; their ids are hashed from many texts."""
    df = frame(spark, [(20 * i, t, "u", f"copy {t}" if i % 3 else f"{i} {t}") for i in range(400) for t in range(4)])
    assert found(df, run_turns=100, ids_per_text=7) == brute(df.collect())


def test_turnless_and_empty(spark):
    assert c.prefix_trie(c.rebuilt(c.turn_sequences(frame(spark, []).limit(0)))).count() == 0
    only = next(i for i in range(1, 20) if zlib.crc32(str(i).encode()) % 4)
    df = frame(spark, [(only, 0, "u", "gone")])  # its only turn is replaced by those of a conversation that is absent
    assert found(df) == brute(df.collect()) == [str((only, 0, None, 1, 0, 1, 0, hashlib.sha256(str(only).encode()).hexdigest()))]


@pytest.mark.parametrize("seed", range(6))
def test_double_array(seed):
    r = random.Random(seed)
    some = sorted({tuple(r.randint(1, r.choice([2, 30, 400])) for _ in range(r.randint(0, 9))) for _ in range(300)})
    at = np.concatenate([[0], np.cumsum([len(s) for s in some])]).astype(np.int64)
    shared = np.array([0] + [next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))) for a, b in zip(some, some[1:])], np.int64)
    trie = c.DoubleArray(np.array([x for s in some for x in s], np.int64), at, shared)
    nodes = {}
    for d, (own, to) in enumerate(trie.walk(), 1):
        for i, t in zip(own.tolist(), to.tolist()):
            assert nodes.setdefault(t, some[i][:d]) == some[i][:d]
            assert t == trie.base[trie.check[t]] + some[i][d - 1]
    assert len(nodes) == len({s[:d] for s in some for d in range(1, len(s) + 1)}) and 0 not in nodes
    assert len(trie.check) < 4 * (len(nodes) + 401)


def test_query_matches_sql(spark, sf):
    assert not differences(c.op12_prefix_trie(spark, sf), connect(sf), c.ORACLE_SQL)
