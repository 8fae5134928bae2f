"""A prefix trie of conversations as double arrays, one for each run of sequences in order.

Conversations become sequences of turn digests. Distinct sequences are sorted by range, so that those with a common prefix
stand together; a task packs run after run of them, each of a bounded number of turns, into BASE and CHECK arrays over
turn ids that are dense within the run. A node lies in one run alone, unless it is a prefix of the sequences on both sides
of a cut: such upper nodes are marked by a hash of their path, and what runs know of them is summed. Every
quantity of a node is a sum or minimum over runs, because the run where a node comes first owns it.

The ids of conversations with one sequence are hashed in order as texts of up to `ids_per_text` ids, each made where the range sort
has put them; so the one task that chains a hot sequence's hash reads few rows, and holds one at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .merkle import CRC32_SQL
from .tables import copied, materialise

GROUP_SIZE, MOST_HEAD, RUN_TURNS, IDS_PER_TEXT, MOST_OPEN = 20, 4, 200_000, 1_000, 100_000
WORD = r"[^\x20\x09-\x0D]+"
EMPTY = hashlib.sha256(b"").hexdigest()
_COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
NODES = "path binary, above binary, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"


def turn_sequences(turns: DataFrame) -> DataFrame:
    """conv_id and turns, an array of (digest of role and text, words of the text) in order; nothing for rows without conv_id.

    Turns ascend, null first; rows that tie on turn follow their digests. Null roles and texts are empty.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    words = F.regexp_count(text, F.lit(WORD)).cast("bigint")
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").cast("bigint").alias("turn"), digest.alias("digest"), words.alias("words")).alias("turn"))
    ordered = F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words")))
    return rows.groupBy("conv_id").agg(ordered.alias("turns"))


def rebuilt(sequences: DataFrame) -> DataFrame:
    """sequences with the first crc32 mod 4 turns of each conversation taken from the first one of its group of twenty instead (none if that is absent; the remainder takes the sign of conv_id, as in SQL)."""
    head = (F.crc32(F.col("conv_id").cast("string")) % MOST_HEAD).cast("int")
    heads = sequences.filter(F.col("conv_id") % GROUP_SIZE == 0).select(F.col("conv_id").alias("_first"), F.slice("turns", 1, MOST_HEAD - 1).alias("_head"))
    joined = sequences.withColumn("_first", F.col("conv_id") - F.col("conv_id") % GROUP_SIZE).join(heads, "_first", "left")
    taken = F.coalesce(F.slice("_head", F.lit(1), head), F.slice("turns", F.lit(1), F.lit(0)))
    return joined.select("conv_id", F.concat(taken, F.slice("turns", head + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _id_texts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (path, conv_id) as texts of at most `most` ids of a path, with the first id of each."""
    last, ids = None, []

    def done() -> pa.RecordBatch:
        text = ",".join(map(str, ids))
        return pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([ids[0]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([text])], names=["path", "conv_id", "n", "ids"])

    for batch in batches:
        for path, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if ids and (path != last or len(ids) == most):
                yield done()
                ids = []
            last = path
            ids.append(conv)
    if ids:
        yield done()


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (path, conv_id, n, ids) as one row a path: least id, number of ids, hash of the texts joined by commas."""
    last, least, n, running = None, 0, 0, None
    for batch in batches:
        out: list[tuple] = []
        for path, conv, more, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if path != last:
                if running:
                    out.append((last, least, n, running.hexdigest()))
                last, least, n, running = path, conv, 0, hashlib.sha256()
            else:
                running.update(b",")
            running.update(ids.encode())
            n += more
        if out:
            yield _ends(out)
    if running:
        yield _ends([(last, least, n, running.hexdigest())])


def _ends(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], names=["path", "conv_id", "n", "ends_sha256"])


def ends(rows: DataFrame, ids_per_text: int = IDS_PER_TEXT) -> DataFrame:
    """path, least conv_id, number n and ends_sha256 of the conversations (path, conv_id) that have each path as their whole sequence."""
    texts = rows.select("path", "conv_id").repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id")
    texts = texts.mapInArrow(lambda b: _id_texts(b, ids_per_text), "path binary, conv_id bigint, n bigint, ids string")
    return texts.repartition("path").sortWithinPartitions("path", "conv_id").mapInArrow(_chained, "path binary, conv_id bigint, n bigint, ends_sha256 string")


class DoubleArray:
    """A trie over sorted distinct sequences of ids 1 to the alphabet's size, packed into BASE and CHECK.

    A node is a slot; its child by id c is slot base[node] + c if check of that slot is the node. The root is slot 0.
    """

    def __init__(self, ids: np.ndarray, at: np.ndarray, shared: np.ndarray):
        """ids of all sequences, where each starts (and the end), and how many leading ids each shares with the one before it."""
        self.ids, self.at, self.length = ids, at, np.diff(at)
        alphabet, nodes = int(ids.max(initial=0)), int((self.length - shared).sum()) + 1
        size = nodes + alphabet + 1
        self.base, self.check, self.used = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.zeros(size, bool)
        self.used[0] = True
        self._free = 1
        here = np.zeros(len(self.length), np.int64)  # the node that each sequence has reached
        for depth in range(int(self.length.max(initial=0))):
            own = np.flatnonzero(self.length > depth)
            new = own[shared[own] <= depth]  # the first sequence of each node of depth + 1
            parents, labels = here[new], ids[at[new] + depth]
            first = np.concatenate([[0], np.flatnonzero(np.diff(parents)) + 1])
            many = np.diff(np.append(first, len(parents)))
            single = first[many == 1]
            for f, n in zip(first[many > 1].tolist(), many[many > 1].tolist()):
                self._place(int(parents[f]), labels[f : f + n])
            self._place_single(parents[single], labels[single])
            self._grow(int(self.base[parents].max(initial=0)) + alphabet + 1)
            here[own] = self.base[here[own]] + ids[at[own] + depth]

    def _grow(self, size: int) -> None:
        if (more := size + 1 - len(self.check)) > 0:
            more += len(self.check) // 2
            self.base, self.check, self.used = (np.concatenate([x, np.full(more, v, x.dtype)]) for x, v in ((self.base, 0), (self.check, -1), (self.used, False)))

    def _place(self, parent: int, labels: np.ndarray) -> None:
        """Children of a node: the first base from the lowest free slot on at which all their slots are free."""
        while self._free < len(self.used) and self.used[self._free]:
            self._free += 1
        base, low, tries = self._free - int(labels[0]), int(labels[0]), 0
        while True:
            self._grow(base + int(labels[-1]))
            taken = self.used[base + labels]
            if not taken.any():
                break
            tries += 1
            # on to the next free slot for the first label; after many misses, behind all that is used, so that packing stays linear
            free = np.flatnonzero(~self.used[base + low + 1 :][:64]) if tries < 64 else []
            base = base + 1 + int(free[0]) if len(free) else int(np.flatnonzero(self.used)[-1]) + 1 - low
        self.base[parent], self.check[base + labels], self.used[base + labels] = base, parent, True

    def _place_single(self, parents: np.ndarray, labels: np.ndarray) -> None:
        """Only children fill the free slots in order."""
        free = np.flatnonzero(~self.used[self._free :])[: len(parents)] + self._free
        if len(free) < len(parents):
            self._grow(len(self.used) + len(parents))
            free = np.flatnonzero(~self.used[self._free :])[: len(parents)] + self._free
        self.base[parents], self.check[free], self.used[free] = free - labels, parents, True

    def walk(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For depths 1, 2, ...: the sequences that reach it, and their nodes there, found through BASE and CHECK."""
        here = np.zeros(len(self.length), np.int64)
        for depth in range(int(self.length.max(initial=0))):
            own = np.flatnonzero(self.length > depth)
            to = self.base[here[own]] + self.ids[self.at[own] + depth]
            if (self.check[to] != here[own]).any():
                raise ValueError("a sequence leaves its trie")
            here[own] = to
            yield own, to


def run_nodes(digests: np.ndarray, words: np.ndarray, at: np.ndarray, least: np.ndarray, n: np.ndarray, hashes: list[str], before: int, after: int) -> pa.RecordBatch:
    """Rows of NODES of one run of sorted sequences; before and after are how many turns its first and last sequence share with their neighbours outside (-1: there is none)."""
    _, ids = np.unique(digests, return_inverse=True)
    ids, length = ids.ravel().astype(np.int64) + 1, np.diff(at)
    shared = np.zeros(len(length), np.int64)
    for i in range(1, len(length)):
        k = int(min(length[i - 1], length[i]))
        differ = np.flatnonzero(ids[at[i - 1] : at[i - 1] + k] != ids[at[i] : at[i] + k])
        shared[i] = differ[0] if len(differ) else k
    shared[0] = 0
    trie = DoubleArray(ids, at, shared)

    size = len(trie.check)
    conv, count, owned = np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64), np.zeros(size, np.int64)
    word, depth, end = np.zeros(size, np.int64), np.zeros(size, np.int64), np.full(size, -1, np.int64)
    slots, spine = [np.zeros(1, np.int64)], {}
    opened = lambda d, own, to: {int(to[i]): (int(own[i]), d) for i, most in ((0, before), (-1, after)) if own[i] == (0, len(length) - 1)[i] and d <= most}
    everyone = np.arange(len(length))
    for d, (own, to) in enumerate([(everyone, np.zeros(len(length), np.int64)), *trie.walk()]):
        np.minimum.at(conv, to, least[own])
        np.add.at(count, to, n[own])
        depth[to], owned[to] = d, 1
        if d:
            word[to] = words[at[own] + d - 1]
            slots.append(np.unique(to))
        end[to[length[own] == d]] = own[length[own] == d]
        spine |= opened(d, own, to)
        if own[0] == 0 and d <= before:
            owned[to[0]] = 0
    at_depth, slots = slots, np.concatenate(slots)
    children, leaves, saved = np.zeros(size, np.int64), np.zeros(size, np.int64), count * word - owned * word
    np.add.at(children, trie.check[slots[1:]], owned[slots[1:]])
    inner = np.zeros(size, bool)
    inner[trie.check[slots[1:]]] = True
    inner[list(spine)] = True  # a neighbour's sequence differs, so it goes on below
    leaves[slots] = owned[slots] * ~inner[slots]
    for s in at_depth[:0:-1]:
        np.add.at(leaves, trie.check[s], leaves[s])
        np.add.at(saved, trie.check[s], saved[s])

    paths, texts = {}, {}
    for row in {r for r, _ in spine.values()}:
        running, known = hashlib.sha256(), []
        known.append(running.digest())
        for x in digests[at[row] : at[row] + max((d for r, d in spine.values() if r == row), default=0)]:
            running.update(bytes(x))
            known.append(running.digest())
        texts[row] = known
    for slot, (row, d) in spine.items():
        paths[slot] = texts[row][d]
    parent = trie.check[slots]
    above = [paths.get(p) if s else None for s, p in zip(slots.tolist(), parent.tolist())]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([paths.get(s) for s in slots.tolist()], pa.binary()), pa.array(above, pa.binary()), pa.array(conv[slots]), pa.array(depth[slots]), pa.array(np.where(slots == 0, 0, conv[parent]), mask=slots == 0), pa.array(count[slots]),
            pa.array(children[slots]), pa.array(leaves[slots]), pa.array(saved[slots]), pa.array([hashes[e] if e >= 0 else None for e in end[slots].tolist()], pa.string()),
        ],
        names=["path", "above", "conv_id", "depth", "parent_conv_id", *_COUNTS, "ends_sha256"],
    )


def _common(a: np.ndarray, b: np.ndarray) -> int:
    k = min(len(a), len(b))
    differ = np.flatnonzero(a[:k] != b[:k])
    return int(differ[0]) if len(differ) else k


def _runs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Nodes of a partition's sorted rows (turns, conv_id, n, ends_sha256, before, after), run after run of at most `most` turns (one sequence at least)."""
    kept: list[tuple] = []
    turns, before, last_after = 0, -1, -1

    def done(after: int) -> pa.RecordBatch:
        at = np.concatenate([[0], np.cumsum([len(r[0]) for r in kept])]).astype(np.int64)
        digests, words = (np.concatenate([r[i] for r in kept]) for i in (0, 1))
        return run_nodes(digests, words, at, np.array([r[2] for r in kept], np.int64), np.array([r[3] for r in kept], np.int64), [r[4] for r in kept], before, after)

    for batch in batches:
        column = batch.column(0)
        flat, at = column.flatten(), np.concatenate([[0], np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))]).astype(np.int64)
        raw = b"".join(flat.field(0).to_pylist())
        digests, words = np.frombuffer(raw, "V32"), flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
        rest = [c.to_pylist() for c in batch.columns[1:]]
        for i in range(batch.num_rows):
            row = (digests[at[i] : at[i + 1]], words[at[i] : at[i + 1]], rest[0][i], rest[1][i], rest[2][i])
            if not kept:
                before = rest[3][i]
            elif turns + len(row[0]) > most:
                yield done(k := _common(kept[-1][0], row[0]))
                kept, turns, before = [], 0, k
            kept.append(row)
            turns += len(row[0])
            last_after = rest[4][i]
    if kept:
        yield done(last_after)


def _shared_turns(a: Column, b: Column) -> Column:
    """How many leading elements two different arrays share; -1 if one is null."""
    differ = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), F.lit(True)) - 1
    return F.coalesce(differ, F.lit(-1)).cast("bigint")


def prefix_trie(sequences: DataFrame, run_turns: int = RUN_TURNS, ids_per_text: int = IDS_PER_TEXT) -> DataFrame:
    """The nodes of the trie over sequences (conv_id, turns as turn_sequences gives them), one row for each distinct prefix.

    conv_id is a node's smallest member, parent_conv_id its parent's (null for the root), n_convs counts members, n_children and n_leaves nodes,
    saved_tokens sums (n_convs - 1) times the words of the last turn over the subtree, ends_sha256 hashes the ids of members that end here.
    Every conv_id must occur once. Conversations without turns are members of the root only. No rows give no rows, not even a root.
    The digests and word counts of one conversation (40 bytes a turn) are held together, texts are not.
    """
    binary = F.to_binary(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""), F.lit("hex"))
    stored = materialise(sequences.select("conv_id", "turns", F.unhex(F.sha2(binary, 256)).alias("path")))
    distinct = stored.groupBy("path").agg(F.first("turns").alias("turns")).join(ends(stored, ids_per_text), "path")
    ordered = materialise(distinct.select("turns", "conv_id", "n", "ends_sha256")).repartitionByRange("turns").sortWithinPartitions("turns")
    ordered = materialise(ordered.withColumn("_part", F.spark_partition_id()))
    # the cuts between partitions: two sequences for each, whose common length is all that its neighbours need
    parts = ordered.groupBy("_part").agg(F.min("turns").alias("low"), F.max("turns").alias("high"))
    by_part = Window.orderBy("_part")
    cuts = parts.select("_part", _shared_turns(F.lag("high").over(by_part), F.col("low")).alias("before"), _shared_turns(F.col("high"), F.lead("low").over(by_part)).alias("after"))
    cuts = F.broadcast(materialise(cuts))  # three numbers for each shuffle partition
    nodes = ordered.join(cuts, "_part").select("turns", "conv_id", "n", "ends_sha256", "before", "after")
    nodes = materialise(nodes.mapInArrow(lambda b: _runs(b, run_turns), NODES))

    upper = nodes.filter("path is not null").groupBy("path").agg(F.first("above").alias("above"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *(F.sum(c).alias(c) for c in _COUNTS), F.max("ends_sha256").alias("ends_sha256"))
    upper = materialise(upper)
    parents = copied(upper.select(F.col("path").alias("above"), F.col("conv_id").alias("parent_conv_id")), MOST_OPEN)
    out = ["conv_id", "depth", "parent_conv_id", *_COUNTS, "ends_sha256"]
    inside = nodes.filter("path is null and above is null").select(*out)
    below = nodes.filter("path is null and above is not null").drop("parent_conv_id").join(parents, "above").select(*out)
    found = inside.unionByName(below).unionByName(upper.join(parents, "above", "left").select(*out))
    return found.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(turn_sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


ORACLE_SQL = rf"""
WITH turns AS (SELECT conv_id, turn, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS t FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list(t ORDER BY turn NULLS FIRST) AS t, {CRC32_SQL.format('conv_id')} % {MOST_HEAD} AS h FROM turns GROUP BY conv_id),
conv AS (SELECT c.conv_id, list_concat(coalesce(r.t[:c.h], []), c.t[c.h + 1:]) AS t FROM own c LEFT JOIN own r ON r.conv_id = c.conv_id - c.conv_id % {GROUP_SIZE}),
member AS (SELECT conv_id, d AS depth, t[:d] AS path, len(t) = d AS ends FROM conv, unnest(range(len(t) + 1)) AS x(d)),
node AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(cast(conv_id AS varchar), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
  CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(path[depth].text, '{WORD}')) END AS words FROM member GROUP BY path, depth),
child AS (SELECT path[:depth - 1] AS path, depth - 1 AS depth, count(*) AS n FROM node WHERE depth > 0 GROUP BY ALL),
whole AS (SELECT node.*, coalesce(child.n, 0) AS n_children FROM node LEFT JOIN child ON node.depth = child.depth AND node.path = child.path),
up AS (SELECT path[:d] AS path, d AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM whole, unnest(range(depth + 1)) AS x(d) GROUP BY ALL)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, up.n_leaves, cast(up.saved_tokens AS bigint) AS saved_tokens, w.ends_sha256
FROM whole w JOIN up ON up.depth = w.depth AND up.path = w.path LEFT JOIN node p ON p.depth = w.depth - 1 AND p.path = w.path[:w.depth - 1]"""
