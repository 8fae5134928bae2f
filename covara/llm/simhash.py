"""SimHash near-duplicates: fingerprints, pairs by pivot distance tables, components.

Links are wanted between fingerprints that differ in at most `most_bits` bits. Rows with the same
fingerprint are one node from the start. Nodes that agree on `agree` of the blocks of the fingerprint
share a group (with most_bits + agree blocks, every link falls in some group). Inside a group a table of
Hamming distances to fixed reference fingerprints (pivots) orders the nodes by their distance to the first
pivot, discards pairs by the largest coordinate difference (the triangle inequality: it can't exceed the
distance), and the survivors are verified. A large group is split by further blocks of the bits that differ in it, so that
its work grows with its size and not with its pairs. A group passes on only a spanning set of its links.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta
from .components import connected_components
from .jaccard import COPY_WORDS, SIMILARITY, describe, similar_links
from .tables import materialise

WORDS, MOST_BITS, AGREE, PIVOTS, HASH_SEED = 4, 4, 3, 24, 42
_PIVOTS = np.random.Generator(np.random.PCG64(11)).integers(0, 2**63, PIVOTS, dtype=np.uint64) * np.uint64(2) + np.random.Generator(np.random.PCG64(12)).integers(0, 2, PIVOTS, dtype=np.uint64)
#: From this many nodes on, a group is split by further blocks, and what is still so large is worked off by leaders.
LARGE_GROUP = 96
#: Further blocks of a large group; two nodes within reach agree on all but most_bits of them.
FURTHER_BLOCKS = 8


def fingerprint(words: list[bytes], size: int) -> int:
    """Majority bits of the XXH64 values of the shingles, repeats included; 0 without words."""
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(b" ".join(words[i : i + size]), HASH_SEED) for i in range(n)), np.uint64, n)
    return ta.majority_bits(h)


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of each row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch):
                data, at = ta.text_bytes(part.column("text"))
                raw = ta.LOWER[data].tobytes()
                # bytes.split() splits at the six ASCII white-space characters
                fps = np.array([fingerprint(raw[i:j].split(), words) for i, j in zip(at[:-1].tolist(), at[1:].tolist())], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, fp bigint")


def block_masks(most_bits: int, agree: int) -> list[int]:
    """Masks of every choice of `agree` out of most_bits + agree blocks that cover the 64 bits."""
    n = most_bits + agree
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:])]
    return [sum(x) for x in combinations(blocks, agree)]


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index reachable from each of 0..n-1 over the links (a, b)."""
    label = np.arange(n)
    while True:
        old = label.copy()
        np.minimum.at(label, a, old[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == old).all():
            return label


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Hamming distances to the pivots, one row a pivot."""
    return np.stack([np.bitwise_count(fp ^ p).astype(np.int8) for p in _PIVOTS])


def survivors(fp: np.ndarray, table: np.ndarray, a: np.ndarray, b: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) that no pivot discards and whose distance is small enough."""
    for row in table:
        near = np.abs(row[a] - row[b]) <= most_bits
        a, b = a[near], b[near]
    near = np.bitwise_count(fp[a] ^ fp[b]) <= most_bits
    return a[near], b[near]


def group_links(fp: np.ndarray, group: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of each group; equal values of `group` stand together."""
    table = pivot_table(fp)
    order = np.lexsort((table[0], group))
    fp, group, table = fp[order], group[order], table[:, order]
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(first, len(fp)))
    linked_a, linked_b = [], []
    small = np.repeat(sizes < LARGE_GROUP, sizes)
    for d in range(1, int(min(LARGE_GROUP, sizes.max(initial=0)))):
        a = np.flatnonzero((group[:-d] == group[d:]) & small[:-d] & (table[0, d:] - table[0, :-d] <= most_bits))
        if len(a):
            a, b = survivors(fp, table, a, a + d, most_bits)
            linked_a.append(a)
            linked_b.append(b)
    for start, size in zip(first[sizes >= LARGE_GROUP].tolist(), sizes[sizes >= LARGE_GROUP].tolist()):
        a, b = split_links(fp[start : start + size], table[:, start : start + size], most_bits)
        linked_a.append(a + start)
        linked_b.append(b + start)
    if not linked_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    label = local_components(len(fp), np.concatenate(linked_a), np.concatenate(linked_b))
    own = np.flatnonzero(label != np.arange(len(fp)))
    return order[own], order[label[own]]


def split_links(fp: np.ndarray, table: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected in one large group, by the blocks of the bits that differ in it.

    Two nodes within reach differ in at most most_bits blocks, so they agree on the rest and meet in some choice of these. Nodes
    that are connected already are not compared again.
    """
    n, varying = len(fp), [i for i in range(64) if int(np.bitwise_or.reduce(fp ^ fp[0])) >> i & 1]
    parts = FURTHER_BLOCKS
    if len(varying) <= parts or parts <= most_bits:
        return leader_links(fp, table, most_bits)
    cuts = [len(varying) * i // parts for i in range(parts + 1)]
    blocks = [sum(1 << k for k in varying[a:b]) for a, b in zip(cuts, cuts[1:])]
    label = np.arange(n)
    for mask in (sum(x) for x in combinations(blocks, parts - most_bits)):
        key = fp & np.uint64(mask)
        order = np.lexsort((table[0], key))
        first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
        size = np.diff(np.append(first, n))
        run = np.repeat(np.arange(len(first)), size)
        small = np.repeat(size < LARGE_GROUP, size)
        pairs = []
        for d in range(1, int(min(LARGE_GROUP, size.max()))):
            i = np.flatnonzero((run[:-d] == run[d:]) & small[:-d])
            a, b = order[i], order[i + d]
            other = label[a] != label[b]
            if other.any():
                pairs.append(survivors(fp, table, a[other], b[other], most_bits))
        for start, count in zip(first[size >= LARGE_GROUP].tolist(), size[size >= LARGE_GROUP].tolist()):
            own = order[start : start + count]
            if (label[own] != label[own[0]]).any():
                a, b = leader_links(fp[own], table[:, own], most_bits)
                pairs.append((own[a], own[b]))
        if pairs:
            known = np.flatnonzero(label != np.arange(n))
            a, b = (np.concatenate([x, *y]) for x, y in zip((known, label[known]), zip(*pairs)))
            label = local_components(n, a, b)
    own = np.flatnonzero(label != np.arange(n))
    return own, label[own]


def leader_links(fp: np.ndarray, table: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected in one large group.

    Each leader takes all free nodes within reach, so a cluster of near copies costs one pass for each
    leader and not one for each pair. Then clusters whose leaders are near enough and that are not yet
    connected are compared member by member until one link is found.
    """
    n = len(fp)
    leader, leaders, out = np.full(n, -1), [], []
    while True:
        free = np.flatnonzero(leader < 0)
        if not len(free):
            break
        x = free[0]
        a, b = survivors(fp, table, np.full(len(free), x), free, most_bits)
        leader[b] = x
        leaders.append(x)
        out.append((a, b))
    heads = np.array(leaders)
    root = {int(x): int(x) for x in heads}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    members = {int(x): np.flatnonzero(leader == x) for x in heads} if len(heads) < n else {int(x): np.array([x]) for x in heads}
    for i, x in enumerate(heads[:-1].tolist()):
        rest = heads[i + 1 :]
        for y in rest[np.bitwise_count(fp[rest] ^ fp[x]) <= 3 * most_bits].tolist():
            if find(x) == find(y):
                continue
            few, many = sorted((members[x], members[y]), key=len)
            for u in few.tolist():
                a, b = survivors(fp, table, np.full(len(many), u), many, most_bits)
                if len(a):
                    out.append((a[:1], b[:1]))
                    root[find(x)] = find(y)
                    break
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def near_links(nodes: DataFrame, most_bits: int = MOST_BITS, agree: int = AGREE) -> DataFrame:
    """src and dst (node ids) of links that connect all nodes (node, fp; fp distinct) within `most_bits` bits."""
    masks = [x - (1 << 64) if x >> 63 else x for x in block_masks(most_bits, agree)]
    keys = F.explode(F.array(*(F.struct(F.lit(i).cast("tinyint").alias("place"), F.col("fp").bitwiseAND(F.lit(m)).alias("part")) for i, m in enumerate(masks))))
    dealt = nodes.select("node", "fp", keys.alias("k")).select("node", "fp", "k.place", "k.part").repartition("place", "part").sortWithinPartitions("place", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def links() -> pa.RecordBatch:
            node, fp, place, part = (np.concatenate(x) for x in zip(*held))
            group = np.cumsum(np.concatenate([[0], (place[1:] != place[:-1]) | (part[1:] != part[:-1])]))
            some = np.flatnonzero(np.bincount(group)[group] > 1)
            a, b = group_links(fp[some], group[some], most_bits) if len(some) else (some, some)
            ids = node[some]
            pairs = np.unique(np.stack([ids[a], ids[b]]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["src", "dst"])

        for batch in batches:
            if not batch.num_rows:
                continue
            node, fp, place, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            rows = node, fp.view(np.uint64), place, part
            last = np.flatnonzero((place != place[-1]) | (part != part[-1]))
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            goes_on = held and not cut and (held[-1][2][-1], held[-1][3][-1]) == (place[0], part[0])
            if cut or not goes_on:
                held.append(tuple(x[:cut] for x in rows))
                if sum(len(x[0]) for x in held):
                    yield links()
                held = []
            held.append(tuple(x[cut:] for x in rows))
        if held:
            yield links()

    return dealt.mapInArrow(run, "src bigint, dst bigint").distinct()


def fingerprint_groups(docs: DataFrame, words: int = WORDS, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id of its component) of each row of docs (doc_id, text).

    Lower-cases A-Z and hashes shingles of `words` words; a shorter text is one shingle. Null and empty texts
    have fingerprint 0, which links like any other. Repeated rows and equal texts share a node, so groups of
    copies of any size cost one node. A row without doc_id links like others, so it may join two others; its component
    has the smallest doc_id there is, null where there is none.
    Empty tables give no rows; other columns are ignored.
    """
    fps = materialise(fingerprints(docs, words))
    nodes = materialise(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    component = connected_components(near_links(nodes.select(F.col("fp").alias("node"), "fp"), most_bits))
    nodes = nodes.join(component.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    whole = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = nodes.join(whole, "component").select("fp", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def fingerprint_pairs(described: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """a and b (fp) of pairs that connect all shingle sets whose fingerprints (bits, of jaccard.describe()) are within `most_bits` bits; sets with one fingerprint are paired with the first."""
    sets = described.filter("n > 0").select("fp", "bits").distinct()
    nodes = materialise(sets.groupBy("bits").agg(F.min("fp").alias("first")))
    links = near_links(nodes.select(F.col("bits").alias("node"), F.col("bits").alias("fp")), most_bits)
    at = lambda side, name: nodes.select(F.col("bits").alias(side), F.col("first").alias(name))
    other = links.join(at("src", "a"), "src").join(at("dst", "b"), "dst").select("a", "b")
    equal = sets.join(nodes, "bits").filter("fp <> first").select(F.col("first").alias("a"), F.col("fp").alias("b"))
    return other.unionByName(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def near_duplicates(docs: DataFrame, words: int = COPY_WORDS, least: Fraction = SIMILARITY) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id of its component) and first of each row of docs (doc_id, text).

    Links every two texts whose sets of `words`-word shingles have a Jaccard similarity of at least `least`. SimHash fingerprints of
    the sets give the first pairs, by pivot tables (near_links); prefixes of the sets give those that differ in more bits, so none is
    missed (jaccard.py), and each pair counts by its exact similarity. fp is a hash of the set, 0 for null and empty texts, which are copies of each other. first is true
    for rows that stand for their component: those with the smallest doc_id and, where no row has one, those with the
    smallest fp. Texts of any length are read whole; repeated rows and equal texts share a node; an empty table gives no
    rows; other columns are ignored.
    """
    described = materialise(describe(docs, words, least))
    component = connected_components(similar_links(docs, described, fingerprint_pairs(described), words, least).selectExpr("a src", "b dst"))
    fps = described.select("doc_id", "fp")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("least")).join(component.selectExpr("node fp", "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    whole = nodes.groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = nodes.join(whole, "component").select("fp", "component", "component_id")
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id", F.when(F.col("component_id").isNull(), F.col("fp") == F.col("component")).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))).alias("first"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
