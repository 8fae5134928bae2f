"""Benchmark decontamination: pigeonhole edit matching, verified by Myers' bit-parallel distance.

An item may occur in a text with up to k edits. Cut into k + 1 pieces, at least one piece must then occur
unchanged: an automaton finds every occurrence of every piece in one pass over the text, and the
surroundings of each are verified, those that overlap together, so that a text full of hits costs one pass too. The
benchmark is the query set; it is broadcast in blocks of bounded size, one pass over the documents for each.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import materialise

CHARS_PER_EDIT, LEAST_ITEM_CHARS, BLOCK_CHARS = 20, 20, 2_000_000
SCHEMA = "doc_id bigint, item_id bigint, distance bigint, start bigint, end bigint"
_WORDS = regex.compile(r"[\p{L}\p{M}\p{N}]+")


def normalised(text: str | None) -> str:
    """Lower-case words of letters and digits with one space between."""
    return " ".join(_WORDS.findall((text or "").lower()))


def pieces(item: str, edits: int) -> list[tuple[int, str]]:
    """The item cut into edits + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (edits + 1) for i in range(edits + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def best_match(item: str, text: str, most: int) -> tuple[int, int] | None:
    """(distance, end) of the substring of text nearest to item, the first of equals; None if over `most`.

    Myers' algorithm, with a free start in the text: a column of the distance table is two bit vectors.
    """
    m = len(item)
    ones, last = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, c in enumerate(item):
        where[c] = where.get(c, 0) | 1 << i
    plus, minus, score, best, end = ones, 0, m, m + 1, 0
    for j, c in enumerate(text):
        eq = where.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & ones)
        mh = plus & xh
        if ph & last:
            score += 1
        elif mh & last:
            score -= 1
        ph, mh = (ph << 1) & ones, (mh << 1) & ones
        plus, minus = mh | (~(xv | ph) & ones), ph & xv
        if score < best:
            best, end = score, j + 1
    return (best, end) if best <= most else None


def _automaton(items: Iterable[tuple[int, str, int]]):
    found: dict[str, list] = {}
    for k, (_, text, edits) in enumerate(items):
        for offset, piece in pieces(text, edits):
            found.setdefault(piece, []).append((k, offset))
    a = ahocorasick.Automaton()
    for piece, places in found.items():
        a.add_word(piece, (len(piece), places))
    a.make_automaton()
    return a


def matches(text: str, items: list[tuple[int, str, int]], automaton, least: int = LEAST_ITEM_CHARS) -> dict[int, tuple[int, int, int]]:
    """item position -> (distance, start, end) of its best match in a normalised text; start is that of an equally long match.

    Items under `least` characters count only as whole words.
    """
    out: dict[int, tuple[int, int, int]] = {}
    windows: dict[int, tuple[int, int]] = {}

    def verify(k: int) -> None:
        low, high = windows.pop(k)
        item, edits = items[k][1:]
        found = best_match(item, text[low:high], edits)
        if found and (k not in out or (found[0], low + found[1]) < (out[k][0], out[k][2])):
            out[k] = (found[0], max(0, low + found[1] - len(item)), low + found[1])

    for last, (size, places) in automaton.iter(text):
        for k, offset in places:
            if k in out and out[k][0] == 0:
                continue
            _, item, edits = items[k]
            at = last + 1 - size - offset
            if at >= 0 and text.startswith(item, at):
                end = at + len(item)
                if len(item) >= least or (at == 0 or text[at - 1] == " ") and (end == len(text) or text[end] == " "):
                    out[k] = (0, at, end)
                    windows.pop(k, None)
                continue
            if not edits:
                continue
            low, high = max(0, at - edits), at + len(item) + edits
            if k in windows:
                if low <= windows[k][1]:
                    windows[k] = (min(low, windows[k][0]), max(high, windows[k][1]))
                    continue
                verify(k)
            windows[k] = (low, high)
    for k in list(windows):
        verify(k)
    return out


#: The automaton of the benchmark block that this worker used last, so that its tasks build it once.
_built: dict[str, object] = {}


def _kept_automaton(block: str, items: list[tuple[int, str, int]]):
    if block not in _built:
        _built.clear()
        _built[block] = _automaton(items)
    return _built[block]


def _blocks(items: DataFrame, chars_per_edit: int, least: int, block_chars: int) -> Iterator[list[tuple[int, str, int]]]:
    block, size = [], 0
    for row in items.selectExpr("cast(item_id as bigint) item_id", "cast(text as string) text").toLocalIterator():
        text = normalised(row["text"])
        if not text:
            continue
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text, len(text) // chars_per_edit if len(text) >= least else 0))
        size += len(text)
    if block:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, least_item_chars: int = LEAST_ITEM_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row for each document row and benchmark item that occurs in it with at most one edit for each `chars_per_edit` characters.

    Both texts are compared as lower-case words of letters and digits; start and end are places in that form of
    the document. Of equal matches in a document the first counts. Null and empty texts match nothing; items
    under `least_item_chars` normalised characters are matched without any edit, as whole words; texts of any
    length are read whole. Repeated documents give repeated rows, repeated items one row each. Empty tables give
    no rows; other columns are ignored. doc_id and item_id may be null and are passed on. The driver holds one block
    of the benchmark at a time: with several, each block's findings are written to the shared folder.
    """
    spark = docs.sparkSession
    texts = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    found, blocks = [], _blocks(benchmark, chars_per_edit, least_item_chars, block_chars)
    block = next(blocks, None)
    while block:
        sent = spark.sparkContext.broadcast(block)  # at most block_chars characters and one item

        def search(batches: Iterator[pa.RecordBatch], sent=sent, number=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            items = sent.value
            automaton = _kept_automaton(number, items)
            for batch in batches:
                rows = [
                    (doc, items[k][0], *match)
                    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"))
                    if text.is_valid
                    for k, match in sorted(matches(normalised(text.as_py()), items, automaton, least_item_chars).items())
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 5)], names=["doc_id", "item_id", "distance", "start", "end"])

        one, block = texts.mapInArrow(search, SCHEMA), next(blocks, None)
        if block or found:
            one = materialise(one)
            sent.destroy()
        found.append(one)
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], SCHEMA)


def _is_clean(sent: Broadcast, least_item_chars: int):
    number = uuid.uuid4().hex

    def clean(texts: pa.Array) -> pa.Array:
        automaton = _kept_automaton(number, sent.value)
        return pa.array([not matches(normalised(x.as_py()), sent.value, automaton, least_item_chars) for x in texts], pa.bool_())

    return F.arrow_udf(clean, "boolean")


def without_leaks(docs: DataFrame, benchmark: DataFrame, chars_per_edit: int = CHARS_PER_EDIT, least_item_chars: int = LEAST_ITEM_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs in which find_leaks() finds no item, each judged by its own text, so that no text is shuffled.

    Null and empty texts stay; rows without doc_id and rows that repeat one are judged like all others; ties need no
    rule; texts of any length are read whole; an empty table gives no rows; all columns stay as they are.
    """
    spark = docs.sparkSession
    for i, block in enumerate(_blocks(benchmark, chars_per_edit, least_item_chars, block_chars)):
        if i:
            docs = materialise(docs)
            sent.destroy()
        sent = spark.sparkContext.broadcast(block)  # at most block_chars characters and one item
        docs = docs.filter(_is_clean(sent, least_item_chars)(F.col("text").cast("string")))
    return docs


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The leaks of `benchmark` in `documents`: doc_id, item_id, distance and place."""
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
