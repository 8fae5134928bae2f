"""Removal of repeated byte strings by prefix doubling.

Equal strings of a length get equal names. Names of twice the length come from pairs of names, (name(p),
name(p + half)); a position whose name is unique cannot repeat at any greater length and is settled. The
doubling stops at the threshold. Two things keep it far below one row for each position and round:

* Half-length names are asked about only at anchors. In each string of the threshold length, the
  half-length string with the least hash is its anchor, so equal strings have equal anchors, and a string whose
  anchor is unique is unique.
* Repeats go on: an anchor with all its surroundings equal to those in an earlier document settles all strings
  around it. Only where one anchor stands in different surroundings are full-length names asked about.

Each round is a Spark shuffle of the names by range and back (see blocks.py).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import textarrays as ta
from .blocks import REQUEST, Blocks, block_requests, read_reply, request_batch
from .tables import materialise

LENGTH = 50
NO_DOC = np.iinfo(np.int64).max
SCHEMA = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"


def sliding(op: np.ufunc, x: np.ndarray, width: int) -> np.ndarray:
    """op over x[i : i + width] for each i where that fits; op is min or max."""
    done, out = 1, x
    while done * 2 <= width:
        out = op(out[: len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return op(out[: len(out) - rest], out[rest:]) if rest else out


class Positions:
    """Anchors and names of the texts of a block."""

    def __init__(self, docs: pa.RecordBatch, length: int):
        self.data, self.at = ta.text_bytes(docs.column("text"))
        self.doc = docs.column("doc_id").fill_null(NO_DOC).to_numpy(zero_copy_only=False)
        self.length, self.half = length, (length + 1) // 2
        n, self.sums = len(self.data), ta.prefix_sums(self.data)
        self.anchor = np.zeros(0, np.int64)
        if n < length:
            return
        place = np.arange(n - self.half + 1)
        self.name = ta.span_hashes(self.sums, place, place + self.half)
        order = (self.name >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        span = length - self.half + 1
        least = sliding(np.minimum, order, span)
        fits = np.zeros(len(least), bool)  # strings that end inside their text
        sizes = np.diff(self.at)
        for a, b in zip(self.at[:-1][sizes >= length].tolist(), self.at[1:][sizes >= length].tolist()):
            fits[a : b - length + 1] = True
        self.least, self.order = np.where(fits, least, np.uint32(0)), order
        most = sliding(np.maximum, np.concatenate([np.zeros(span - 1, np.uint32), self.least, np.zeros(span - 1, np.uint32)]), span)
        self.anchor = np.flatnonzero(most == order)
        self.owner = np.searchsorted(self.at, self.anchor, "right") - 1
        self.low = np.maximum(self.at[self.owner], self.anchor - (length - self.half))
        self.high = np.minimum(self.at[self.owner + 1], self.anchor + length)

    def surroundings(self, some: np.ndarray) -> np.ndarray:
        """Names of everything around these anchors that their strings can cover."""
        low, high, left = self.low[some], self.high[some], self.anchor[some] - self.low[some]
        return ta.mix(ta.span_hashes(self.sums, low, high) + (left + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def strings(self, some: np.ndarray) -> np.ndarray:
        """Start positions of the full-length strings whose anchor is one of these."""
        first, size = self.low[some], np.minimum(self.anchor[some], self.high[some] - self.length) - self.low[some] + 1
        p = np.repeat(first - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        own = self.least[p] == np.repeat(self.order[self.anchor[some]], size)
        return np.unique(p[own])

    def doubled(self, p: np.ndarray) -> np.ndarray:
        """Full-length names as pairs of half-length names (the second may overlap the first if the length is odd)."""
        return ta.mix(self.name[p] * np.uint64(0x9E3779B97F4A7C15) + self.name[p + self.length - self.half])

    def owners(self, p: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, p, "right") - 1


def _grouped(keys: np.ndarray, docs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """Distinct keys, place of each key, counts, least document of each."""
    distinct, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
    least = None
    if docs is not None:
        least = np.full(len(distinct), NO_DOC)
        np.minimum.at(least, place, docs)
    return distinct, place, counts.astype(np.uint32), least


class _State:
    """What a block knows after the rounds whose replies it has."""

    def __init__(self, docs: pa.RecordBatch, length: int, given: list):
        self.pos = pos = Positions(docs, length)
        self.asked: tuple = ()
        self.covered: list[tuple[np.ndarray, np.ndarray]] = []
        if not len(pos.anchor):
            return
        keys, place, counts, _ = _grouped(pos.name[pos.anchor])
        self.asked = (keys, counts)
        if not given:
            return
        total = read_reply(given[0].get(0), "i8")[0][place]
        some = np.flatnonzero(total > 1)
        total = total[some]
        keys, place, counts, least = _grouped(pos.surroundings(some), pos.doc[pos.owner[some]])
        self.asked = (keys, counts, least)
        if len(given) < 2:
            return
        same, first = (x[place] for x in read_reply(given[1].get(0), "i8", "i8"))
        later = pos.doc[pos.owner[some]] > first
        self.covered.append((pos.low[some[later]], pos.high[some[later]]))
        p = pos.strings(some[~later & (same < total)])
        keys, place, _, least = _grouped(pos.doubled(p), pos.doc[pos.owners(p)])
        self.asked = (keys, least)
        if len(given) < 3:
            return
        later = p[pos.doc[pos.owners(p)] > read_reply(given[2].get(0), "i8")[0][place]]
        self.covered.append((later, later + length))


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row of SCHEMA for each row of docs (doc_id, text), texts as UTF-8 bytes.

    A byte is removed if a string of `length` bytes that covers it also starts in a document with a smaller doc_id,
    judged on the input. Strings do not cross documents. Null texts count as empty. A null doc_id counts as
    larger than all others, and rows of one doc_id as one document: repeats among them stay. Texts are whole at any
    length; an empty table gives no rows; other columns are ignored.
    """
    table = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    rounds = ([(np.add, "u4", "i8")], [(np.add, "u4", "i8"), (np.minimum, "i8", "i8")], [(np.minimum, "i8", "i8")])
    with Blocks(table) as blocks:
        buckets = blocks.buckets

        def ask(block: int, docs: pa.RecordBatch, given: list) -> Iterator[pa.RecordBatch]:
            asked = _State(docs, length, given).asked
            yield request_batch(list(block_requests(buckets, 0, block, *asked)) if asked else [])

        replies: list[DataFrame] = []
        for ops in rounds:
            replies.append(blocks.answer(blocks.each(ask, REQUEST, *replies), ops))

        def finish(block: int, docs: pa.RecordBatch, given: list) -> Iterator[pa.RecordBatch]:
            state = _State(docs, length, given)
            data, at = state.pos.data, state.pos.at
            step = np.zeros(len(data) + 1, np.int32)
            for a, b in state.covered:
                np.add.at(step, a, 1)
                np.add.at(step, b, -1)
            gone = np.cumsum(step[:-1]) > 0
            starts, _ = ta.runs(gone, at)
            raw, kept = data.tobytes(), ~gone
            whole = ta.per_text(gone, at)
            digests = [hashlib.sha256(raw[a:b] if not n else data[a:b][kept[a:b]].tobytes()).hexdigest() for a, b, n in zip(at[:-1].tolist(), at[1:].tolist(), whole.tolist())]
            yield pa.RecordBatch.from_arrays([docs.column("doc_id"), pa.array(np.diff(at)), pa.array(whole), pa.array(np.diff(np.searchsorted(starts, at))), pa.array(digests)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

        return materialise(blocks.each(finish, SCHEMA, *replies))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
