"""Quality rules: compression bands over whole texts and fixed chunks, after word and line counts.

Text that repeats itself compresses too well, random characters hardly at all; what is usual falls
with length, so every limit belongs to a length band. A text is rejected when its own ratio leaves
the band of its length, or when more than a share of its fixed chunks leave theirs.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta

#: (bytes from, least ratio, largest ratio), zstandard level 3. Prose lies well inside.
BANDS = ((0, 0.20, 1.60), (50, 0.35, 1.30), (150, 0.50, 0.98), (300, 0.51, 0.88), (600, 0.485, 0.80), (1200, 0.455, 0.72), (2500, 0.43, 0.68), (5000, 0.41, 0.66), (10000, 0.39, 0.66), (30000, 0.375, 0.66))
CHUNK_BYTES, LEAST_CHUNK_BYTES, BAD_CHUNK_SHARE, LEVEL = 4096, 1024, 0.25, 3
WINDOW_WORDS, FEWEST_WORDS, MOST_REPEATED_PERCENT = 8, 20, 30
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, whole_ratio double, n_chunks bigint, n_bad_chunks bigint"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def repeats(key: np.ndarray) -> np.ndarray:
    """For each element, whether its value occurs twice or more."""
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def text_counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The counts of each text; words and lines are compared by 64-bit hashes within their own text."""
    n = len(at) - 1
    start, end = ta.runs(~ta.SPACE[data], at)
    of = ta.owners(start, at)
    p = ta.prefix_sums(data)
    word = ta.string_hashes(data, p, start, end)
    texts = np.arange(n, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)

    repeated = np.zeros(n, np.int64)
    w = WINDOW_WORDS
    if len(word) >= w:
        size = len(word) - w + 1
        window = np.zeros(size, np.uint64)
        for j in range(w):
            window = window * np.uint64(0xD6E8FEB86659FD93) + word[j : j + size]
        own = np.flatnonzero(of[:size] == of[w - 1 :])
        twice = own[repeats(ta.mix(window[own]) ^ texts[of[own]])]
        step = np.zeros(len(word) + 1, np.int64)
        np.add.at(step, twice, 1)
        np.add.at(step, twice + w, -1)
        repeated = np.bincount(of[np.cumsum(step[:-1]) > 0], minlength=n)

    breaks = np.flatnonzero(data == 10)
    heads = np.unique(np.concatenate([at[:-1], breaks + 1]))
    heads = heads[heads < len(data)]
    tails = np.minimum(np.append(breaks, len(data))[np.searchsorted(breaks, heads)], at[1:][ta.owners(heads, at)])
    worded = np.searchsorted(start, tails) > np.searchsorted(start, heads)
    heads, tails = heads[worded], tails[worded]
    line_of = ta.owners(heads, at)
    lines = ta.string_hashes(data, p, heads, tails) ^ texts[line_of]
    _, first = np.unique(lines, return_index=True)
    later = np.ones(len(lines), bool)
    later[first] = False
    return {
        "n_words": np.bincount(of, minlength=n),
        "word_chars": ta.per_text(ta.LEAD[data] & ~ta.SPACE[data], at),
        "n_symbols": ta.per_text(_SYMBOL[data], at),
        "n_dup_lines": np.bincount(line_of[later], minlength=n),
        "n_repeat_words": repeated,
    }


def _within(size: int, packed: int, bands: Sequence[tuple[int, float, float]]) -> bool:
    _, low, high = [b for b in bands if b[0] <= size][-1]
    return low <= packed / size <= high


def compression(text: bytes, packer: zstandard.ZstdCompressor, bands: Sequence[tuple[int, float, float]], chunk: int) -> tuple[float, int, int, bool]:
    """(ratio of the whole text, chunks, chunks outside their band, whether the whole is in its band)."""
    if not text:
        return 0.0, 0, 0, False
    whole = len(packer.compress(text))
    inside = _within(len(text), whole, bands)
    if len(text) <= chunk:
        return whole / len(text), 1, int(not inside), inside
    parts = [text[i : i + chunk] for i in range(0, len(text), chunk)]
    parts = parts[:-1] if len(parts[-1]) < LEAST_CHUNK_BYTES else parts
    return whole / len(text), len(parts), sum(not _within(len(x), len(packer.compress(x)), bands) for x in parts), inside


def judge(texts: pa.Array, bands: Sequence[tuple[int, float, float]], chunk_bytes: int, bad_chunk_share: float) -> dict[str, np.ndarray]:
    """Counts, ratios and verdict of each text."""
    data, at = ta.text_bytes(texts)
    packer, raw = zstandard.ZstdCompressor(level=LEVEL), data.tobytes()
    c = {k: x.astype(np.int64) for k, x in text_counts(data, at).items()}
    c["base_failed"] = (c["n_words"] < FEWEST_WORDS) | (100 * c["n_repeat_words"] > MOST_REPEATED_PERCENT * c["n_words"])
    found = [compression(raw[i:j], packer, bands, chunk_bytes) for i, j in zip(at[:-1].tolist(), at[1:].tolist())]
    ratio, chunks, bad, inside = (np.array(x, t) for x, t in zip(zip(*found), (float, np.int64, np.int64, bool)))
    return c | {"kept": ~c["base_failed"] & inside & (bad <= bad_chunk_share * chunks), "whole_ratio": ratio, "n_chunks": chunks, "n_bad_chunks": bad}


def quality_rules(docs: DataFrame, bands: Sequence[tuple[int, float, float]] = BANDS, chunk_bytes: int = CHUNK_BYTES, bad_chunk_share: float = BAD_CHUNK_SHARE) -> DataFrame:
    """One row for each row of docs (doc_id, text), with its counts and verdict.

    kept is false if base_failed (under 20 words, or over 30 % of the words in 8-word windows that
    recur in the text); else it is true if the whole text is in its length's compression band and no
    more than `bad_chunk_share` of its chunks are outside theirs. A null text counts as empty: no
    words, base_failed. Texts are read whole at any length; repeated rows give repeated results;
    ties need no rule, since each row is judged alone; an empty table gives no rows; other columns
    are ignored. doc_id may be null and is passed on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch):
                columns = judge(part.column("text"), bands, chunk_bytes, bad_chunk_share)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns.values())], names=["doc_id", *columns])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA)


def quality_verdict(text: Column) -> Column:
    """The verdict kept of quality_rules() with its default limits, as a Boolean column."""

    def run(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        kept = [judge(part.column("text"), BANDS, CHUNK_BYTES, BAD_CHUNK_SHARE)["kept"] for part in ta.slices(batch)]
        return pa.array(np.concatenate(kept) if kept else np.zeros(0, bool), pa.bool_())

    return F.arrow_udf(run, "boolean")(text)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
