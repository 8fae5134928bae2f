"""All pairs of texts whose shingle sets are similar, without a miss: prefix filter, then exact Jaccard similarity.

All shingles have one order: ordinary ones by hash, then those found frequent in a sample, the most frequent last.
Two sets of similarity s or more share one of the first n - ceil(s n) + 1 shingles of each, so texts meet in
groups by these. The order does not touch the result; it keeps passages that many texts share out of the
groups. Pairs by SimHash fingerprints (simhash.fingerprint_pairs) are the first; a small group gives all its pairs, a large one the pairs with two members: its largest, and the one with the
fewest rarer shingles, which is most like the text that the others are copies of. What these leave in
different components is then compared. Parities of the sets bound their difference from below and discard most
pairs, those of large groups before they become rows; a pair that is left counts only when its exact similarity is known.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textarrays as ta
from .components import connected_components
from .tables import copied, materialise

COPY_WORDS, SIMILARITY = 5, Fraction(4, 5)
#: From this many members on, a group is first paired with two of its members only.
LARGE_GROUP = 3
#: Members of a large group that one task compares; a larger group is cut into blocks, and each two blocks are a group.
BLOCK_MEMBERS = 4096
#: Bytes of parities that a member of a large group takes along.
MOST_PARITY = 512
#: Members of a large group that are its pivots at most.
PIVOTS = 8
#: One document of so many is sampled for frequent shingles; how often those occur there at least; how many are kept at most.
SAMPLE, OFTEN, MOST_FREQUENT = 16, 8, 100_000
_STEP = np.uint64(0xD6E8FEB86659FD93)
#: Pairs of a group made at once.
_PAIRS = 1 << 18


def shingle_sets(column: pa.Array, words: int) -> list[np.ndarray]:
    """Ascending distinct hashes of the shingles of each text, A-Z lower-cased; a text of fewer words is one shingle."""
    data, at = ta.text_bytes(column)
    data = ta.LOWER[data]
    start, end = ta.runs(~ta.SPACE[data], at)
    word = ta.string_hashes(data, ta.prefix_sums(data), start, end)
    first = np.searchsorted(start, at)
    size = max(0, len(word) - words + 1)
    window = np.zeros(size, np.uint64)
    for j in range(words):
        window = window * _STEP + word[j : j + size]
    window = ta.mix(window)
    out = []
    for i, j in zip(first[:-1].tolist(), first[1:].tolist()):
        if j - i >= words:
            out.append(np.unique(window[i : j - words + 1]))
        else:
            h = np.zeros(1 if j > i else 0, np.uint64)
            for k in range(i, j):
                h = h * _STEP + word[k] + np.uint64(j - i)
            out.append(ta.mix(h))
    return out


def set_hash(x: np.ndarray) -> int:
    """A hash of a shingle set, 0 for the empty one, as a signed long."""
    return int(ta.mix(np.array([ta.mix(x).sum(dtype=np.uint64) + np.uint64(len(x))], np.uint64)).view(np.int64)[0]) if len(x) else 0


def _texts(docs: DataFrame) -> DataFrame:
    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")


def frequent_shingles(docs: DataFrame, words: int) -> np.ndarray:
    """Shingles frequent in the sample, the rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch):
                sets = shingle_sets(part.column("text"), words)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["shingle"])

    some = _texts(docs).filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)
    counts = some.mapInArrow(run, "shingle bigint").groupBy("shingle").count().filter(F.col("count") >= OFTEN)
    found = counts.orderBy(F.desc("count"), "shingle").limit(MOST_FREQUENT).collect()
    return np.array([r["shingle"] for r in found[::-1]], np.int64).view(np.uint64)


def ordered_prefix(x: np.ndarray, frequent: np.ndarray, by_hash: np.ndarray, least: Fraction) -> np.ndarray:
    """The first len - ceil(least * len) + 1 shingles of an ascending set; by_hash sorts `frequent`."""
    most = len(x) + int(-least * len(x) // 1) + 1
    if not len(x) or not len(frequent):
        return x[:most]
    sorted_hot = frequent[by_hash]
    at = np.minimum(np.searchsorted(sorted_hot, x), len(frequent) - 1)
    hot = sorted_hot[at] == x
    rare = x[~hot]
    if len(rare) >= most:
        return rare[:most]
    return np.concatenate([rare, frequent[np.sort(by_hash[at[hot]])]])[:most]


def parities(x: np.ndarray) -> bytes:
    """For each of m places (m a power of two, twice the size of the set or more) whether an odd number of hashes falls there."""
    m = max(64, 1 << int(2 * len(x)).bit_length())
    return np.packbits(np.bincount((x & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8).tobytes()


def least_difference(u: bytes, v: bytes) -> int:
    """How many elements two sets differ in at least: places of different parity, at the number of places of the smaller."""
    a, b = np.frombuffer(u, np.uint8), np.frombuffer(v, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def set_hashes(text: Column, words: int = COPY_WORDS) -> Column:
    """The hash of each text's shingle set, as fp of describe()."""

    def run(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        return pa.array([set_hash(x) for part in ta.slices(batch) for x in shingle_sets(part.column("text"), words)], pa.int64())

    return F.arrow_udf(run, "bigint")(text)


def describe(docs: DataFrame, words: int = COPY_WORDS, least: Fraction = SIMILARITY) -> DataFrame:
    """doc_id, fp (the hash of its shingle set), bits (the set's SimHash fingerprint), n (its size), head (its prefix), parity and sketch (parity at no more than MOST_PARITY bytes) of each row of docs."""
    frequent = frequent_shingles(docs, words)
    by_hash = np.argsort(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch):
                sets = shingle_sets(part.column("text"), words)
                fps, n = (pa.array([f(x) for x in sets], pa.int64()) for f in (set_hash, len))
                bits = pa.array(np.array([ta.majority_bits(x) for x in sets], np.uint64).view(np.int64))
                heads = pa.array([ordered_prefix(x, frequent, by_hash, least).tobytes() for x in sets], pa.binary())
                parity = [parities(x) for x in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), fps, bits, n, heads, pa.array(parity, pa.binary()), pa.array(map(folded, parity), pa.binary())], names=["doc_id", "fp", "bits", "n", "head", "parity", "sketch"])

    return _texts(docs).mapInArrow(run, "doc_id bigint, fp bigint, bits bigint, n bigint, head binary, parity binary, sketch binary")


def group_pairs(fp: np.ndarray, n: np.ndarray, pos: np.ndarray, a: np.ndarray, b: np.ndarray, least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b) of members that share a shingle, those whose sizes and its places allow the similarity."""
    s, t = least.numerator, least.denominator
    na, nb = n[a], n[b]
    # an overlap of s / (s + t) of both sizes is needed; the shared prefix before the shingle is at most the smaller place
    room = np.minimum(na - pos[a], nb - pos[b]) + np.minimum(pos[a], pos[b])
    ok = (np.minimum(na, nb) * t >= np.maximum(na, nb) * s) & (room * (s + t) >= s * (na + nb)) & (fp[a] != fp[b])
    return a[ok], b[ok]


def folded(parity: bytes, most: int = MOST_PARITY) -> bytes:
    """The parities at fewer places, `most` bytes of them at the largest."""
    a = np.frombuffer(parity, np.uint8)
    while len(a) > most:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a.tobytes()


class _Parities:
    """Parities of the members of a group, side by side at each number of places that occurs, with their distances to pivots."""

    def __init__(self, parity: list[bytes]):
        self.size = np.array([len(x) for x in parity])
        self.at, self.pivots = {}, {}
        for size in np.unique(self.size).tolist():
            rows = np.zeros((len(parity), size), np.uint8)
            large = np.flatnonzero(self.size >= size)
            for i in large.tolist():
                rows[i] = np.frombuffer(folded(parity[i], size), np.uint8)
            self.at[size] = rows
            # the table of distances to pivots, members at even places among those of this size
            self.pivots[size] = np.stack([np.bitwise_count(rows ^ rows[p]).sum(1, dtype=np.int32) for p in large[:: -(-len(large) // PIVOTS)].tolist()])

    def near(self, i: int, others: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which of the others member i can differ from in no more than `most` elements: by the triangle inequality with each pivot, then by all parities."""
        out, size = np.zeros(len(others), bool), np.minimum(self.size[others], self.size[i])
        for k in np.unique(size).tolist():
            own = np.flatnonzero(size == k)
            for row in self.pivots[k]:
                own = own[np.abs(row[others[own]] - row[i]) <= most[own]]
            own = own[np.bitwise_count(self.at[k][others[own]] ^ self.at[k][i]).sum(1) <= most[own]]
            out[own] = True
        return out


def _members(dealt: DataFrame, least: Fraction, all_pairs: bool) -> DataFrame:
    """Pairs (a, b; key null) and, unless all_pairs, members of large groups (key, a = fp, b = size and place) of dealt (key, fp, span, label and, for all_pairs, parity)."""
    s, t = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            if pairs:
                x, y = (np.concatenate(z) for z in zip(*pairs))
                found = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.nulls(found.shape[1], pa.int64()), pa.array(found[0]), pa.array(found[1])], names=["key", "a", "b"])

        def groups(key: np.ndarray, fp: np.ndarray, span: np.ndarray, label: np.ndarray, parity: np.ndarray | None) -> Iterator[pa.RecordBatch]:
            new = np.concatenate([[True], key[1:] != key[:-1], [True]])
            some = ~(new[:-1] & new[1:])  # not alone
            key, fp, span, label = key[some], fp[some], span[some], label[some]
            parity = None if parity is None else parity[some]
            first = np.flatnonzero(new[:-1][some])
            size = np.diff(np.append(first, len(key)))
            n, pos = span >> 32, span & 0xFFFFFFFF
            pairs, made, big = [], 0, size >= LARGE_GROUP
            of = np.repeat(np.arange(len(first)), size)
            for d in range(1, LARGE_GROUP):
                a = np.flatnonzero((of[:-d] == of[d:]) & ~big[of[:-d]]) if len(of) > d else np.zeros(0, np.int64)
                if len(a):
                    a, b = group_pairs(fp, n, pos, a, a + d, least)
                    other = label[a] != label[b]
                    pairs.append((fp[a[other]], fp[b[other]]))
            for start, count in zip(first[big].tolist(), size[big].tolist()):
                own = np.arange(start, start + count)
                if not all_pairs:
                    for head in {int(own[-1]), int(own[np.lexsort((-n[own], pos[own]))[0]])}:
                        a, b = group_pairs(fp, n, pos, np.full(count, head), own, least)
                        pairs.append((fp[a], fp[b]))
                    yield pa.RecordBatch.from_arrays([pa.array(key[own]), pa.array(fp[own]), pa.array(span[own])], names=["key", "a", "b"])
                    continue
                table = _Parities(parity[own].tolist())
                for i in range(count - 1):
                    b = own[i + 1 :]
                    b = b[label[b] != label[start + i]]
                    a, b = group_pairs(fp, n, pos, np.full(len(b), start + i), b, least)
                    if len(b):
                        near = table.near(i, b - start, (n[a] + n[b]) * (t - s) // (t + s))
                        if near.any():
                            pairs.append((fp[a[near]], fp[b[near]]))
                            made += len(pairs[-1][0])
                    if made > _PAIRS:
                        yield from out(pairs)
                        pairs, made = [], 0
            yield from out(pairs)

        held: list[pa.RecordBatch] = []

        def whole() -> tuple:
            table = pa.Table.from_batches(held).combine_chunks()
            columns = [table.column(i).to_numpy() for i in range(4)]
            return *columns, np.array(table.column(4).to_pylist(), object) if all_pairs else None

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            last = np.flatnonzero(key != key[-1])
            cut = int(last[-1]) + 1 if len(last) else 0  # the last group may go on in the next batch
            if held and (cut or held[0].column(0)[0].as_py() != key[-1]):
                held.append(batch.slice(0, cut))
                yield from groups(*whole())
                held = []
            elif cut:
                held = [batch.slice(0, cut)]
                yield from groups(*whole())
                held = []
            held.append(batch.slice(cut))
        if held:
            yield from groups(*whole())

    # in each group by size, then by hash, so that the largest member is last and reruns agree
    rows = dealt.select("key", "fp", "span", "label", *(["parity"] if all_pairs else [])).repartition("key").sortWithinPartitions("key", "span", "fp")
    return rows.mapInArrow(run, "key bigint, a bigint, b bigint")


def in_blocks(large: DataFrame, members: int = BLOCK_MEMBERS) -> DataFrame:
    """The rows (key, fp, ...) of groups, those of groups with more than so many members once for each two blocks they belong to."""
    blocks = large.groupBy("key").agg(F.ceil(F.count("*") / members).alias("blocks"))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = large.join(blocks, "key").withColumn("own", own).withColumn("other", other)
    return dealt.withColumn("key", F.when(F.col("blocks") > 1, F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.col("key"))).drop("blocks", "own", "other")


def exact_links(pairs: DataFrame, sets: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b) whose sets (fp, shingles: ascending longs) reach the similarity."""
    s, t = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                u, v = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                both = len(u) + len(v) - len(np.union1d(u, v))
                keep.append(both * t >= s * (len(u) + len(v) - both))
            part = batch.select(["a", "b"])
            yield part.filter(pa.array(keep, pa.bool_()))

    x, y = (sets.select(F.col("fp").alias(k), F.col("shingles").alias(z)) for k, z in (("a", "x"), ("b", "y")))
    return materialise(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint"))


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each shingle of the prefixes (fp, n, head): key, fp and span (size and place)."""
    for batch in batches:
        for i in range(0, batch.num_rows, 256):
            part = batch.slice(i, 256)
            heads = [np.frombuffer(x.as_buffer(), np.int64) for x in part.column("head")]
            size = np.array([len(x) for x in heads])
            place = np.concatenate([np.arange(k) for k in size])
            n = part.column("n").to_numpy()
            columns = np.concatenate(heads), np.repeat(part.column("fp").to_numpy(), size), np.repeat(n << 32, size) | place
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], names=["key", "fp", "span"])


def possible_pairs(pairs: DataFrame, described: DataFrame, least: Fraction) -> DataFrame:
    """The pairs (a, b) whose parities allow the similarity; no similar pair is lost."""
    s, t = least.numerator, least.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # sets of similarity s / t differ in at most (t - s) / (t + s) of both sizes
            most = (batch.column("m").to_numpy() + batch.column("n").to_numpy()) * (t - s)
            keep = [least_difference(x, y) * (t + s) <= z for x, y, z in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), most.tolist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    x = described.select(F.col("fp").alias("a"), F.col("n").alias("m"), F.col("parity").alias("x"))
    y = described.select(F.col("fp").alias("b"), "n", F.col("parity").alias("y"))
    return materialise(pairs.join(x, "a").join(y, "b").select("a", "b", "m", "n", "x", "y").mapInArrow(run, "a bigint, b bigint"))


def similar_links(docs: DataFrame, described: DataFrame, likely: DataFrame, words: int = COPY_WORDS, least: Fraction = SIMILARITY) -> DataFrame:
    """a and b (hashes of shingle sets) of links that connect all texts whose similarity is `least` or more; described as of describe().

    likely (a < b) are pairs found otherwise, by fingerprints: they are verified with the first pairs of the groups, and members of large groups that they
    connect are not compared again. They do not touch the result.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch):
                sets = shingle_sets(part.column("text"), words)
                yield pa.RecordBatch.from_arrays([pa.array([set_hash(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["fp", "shingles"])

    once = materialise(described.dropDuplicates(["fp"]))  # one row for equal sets, before their prefixes are dealt
    dealt = once.select("fp", "n", "head").mapInArrow(_deal, "key bigint, fp bigint, span bigint").withColumn("label", F.col("fp"))
    found = materialise(_members(dealt, least, False))
    first = materialise(found.filter("key is null").select("a", "b").unionByName(likely).distinct())
    parity = once.select("fp", "n", "parity")

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = possible_pairs(pairs, parity, least)
        used = materialise(pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct())
        # while they are few, the used hashes are copied to the texts, so that only sets that occur in a pair are shuffled
        sets = _texts(docs).mapInArrow(whole, "fp bigint, shingles binary").join(copied(used), "fp", "left_semi").dropDuplicates(["fp"])
        return exact_links(pairs, sets, least)

    links = checked(first)
    large = found.filter("key is not null").selectExpr("key", "a fp", "b span").distinct()
    component = connected_components(links.selectExpr("a src", "b dst"))
    labelled = large.join(component.selectExpr("node fp", "component"), "fp", "left").select("key", "fp", "span", F.coalesce("component", "fp").alias("label"))
    # groups that are one component already are done
    open_groups = labelled.groupBy("key").agg(F.min("label").alias("a"), F.max("label").alias("b")).filter("a <> b").select("key")
    labelled = in_blocks(materialise(labelled.join(open_groups, "key", "left_semi"))).join(once.select("fp", F.col("sketch").alias("parity")), "fp")
    more = materialise(_members(labelled, least, True).select("a", "b").distinct().join(first, ["a", "b"], "left_anti"))
    return links if more.isEmpty() else links.unionByName(checked(more))
