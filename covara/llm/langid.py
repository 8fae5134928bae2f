"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths slide over a fixed-length window, each filter's largest response goes
to a softmax over the learned languages. A text's windows cover it whole; their probabilities are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import textarrays as ta

WINDOW, DIMENSIONS, WIDTHS, FILTERS = 192, 6, (2, 3, 4, 5), 8
#: The network is fitted on at most this many labelled texts of each language, a few windows of each.
TEXTS_PER_LANGUAGE, WINDOWS_PER_TEXT, MOST_LANGUAGES, SPARE = 800, 3, 400, 4
STEPS, BATCH, RATE, SEED = 900, 64, 0.01, 7
SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"
_REACH = max(WIDTHS)
#: Windows judged at once.
STRIP = 8192


@dataclass
class Network:
    languages: list[str]
    embedding: np.ndarray  # byte, dimension
    filters: np.ndarray  # place and dimension, filter
    bias: np.ndarray
    dense: np.ndarray
    offset: np.ndarray

    @classmethod
    def fresh(cls, languages: list[str], rng: np.random.Generator) -> Network:
        n = FILTERS * len(WIDTHS)
        draw = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        net = cls(languages, draw(256, DIMENSIONS, scale=0.5), draw(_REACH * DIMENSIONS, n, scale=0.3), np.zeros(n, np.float32), draw(n, len(languages), scale=0.3), np.zeros(len(languages), np.float32))
        net.filters *= net.mask()
        return net

    @staticmethod
    def mask() -> np.ndarray:
        """1 where a filter's width reaches."""
        width = np.repeat(WIDTHS, FILTERS)
        return (np.repeat(np.arange(_REACH), DIMENSIONS)[:, None] < width).astype(np.float32)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(largest response of each filter, where it is, the unrolled windows) for rows of bytes."""
        e = self.embedding[x]
        n, size, d = e.shape
        unrolled = np.lib.stride_tricks.sliding_window_view(e.reshape(n, size * d), _REACH * d, axis=1)[:, ::d]
        flat = np.ascontiguousarray(unrolled).reshape(-1, _REACH * d)
        r = (flat @ self.filters).reshape(n, -1, self.filters.shape[1])
        at = r.argmax(1) if n <= BATCH else None
        return np.maximum(r.max(1) + self.bias, 0), at, flat.reshape(n, -1, _REACH * d)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.languages)), np.float32)
        for i in range(0, len(x), 128):
            z = self.pooled(x[i : i + 128])[0] @ self.dense + self.offset
            z = np.exp(z - z.max(1, keepdims=True))
            out[i : i + 128] = z / z.sum(1, keepdims=True)
        return out


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], steps: int = STEPS) -> Network:
    """Adam on cross-entropy; every batch draws the languages evenly."""
    rng = np.random.default_rng(SEED)
    net = Network.fresh(languages, rng)
    of = [np.flatnonzero(labels == k) for k in range(len(languages))]
    names = ("embedding", "filters", "bias", "dense", "offset")
    first, second = ({k: np.zeros_like(getattr(net, k)) for k in names} for _ in range(2))
    mask = net.mask()
    for step in range(1, steps + 1):
        y = rng.integers(0, len(languages), BATCH)
        x = windows[[rng.choice(of[k]) for k in y]]
        h, at, unrolled = net.pooled(x)
        z = h @ net.dense + net.offset
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(BATCH), y] -= 1
        p /= BATCH
        g = (p @ net.dense.T) * (h > 0)
        rows = unrolled[np.arange(BATCH)[:, None], at]  # the window that each filter answered to
        back = (g[:, :, None] * net.filters.T[None]).reshape(BATCH, -1, _REACH, DIMENSIONS)
        d_embedding = np.zeros_like(net.embedding)
        np.add.at(d_embedding, x[np.arange(BATCH)[:, None, None], at[:, :, None] + np.arange(_REACH)], back)
        grads = {"embedding": d_embedding, "filters": np.einsum("bf,bfk->kf", g, rows) * mask, "bias": g.sum(0), "dense": h.T @ p, "offset": p.sum(0)}
        for k, d in grads.items():
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            getattr(net, k)[...] -= RATE * (1 - step / steps * 0.9) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
    return net


def window_places(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows of WINDOW bytes that cover each text (the last one ends with it), and the text of each."""
    size = np.diff(at)
    n = -(-size // WINDOW)
    of = np.repeat(np.arange(len(size)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    return at[:-1][of] + np.maximum(0, np.minimum(k * WINDOW, size[of] - WINDOW)), of


def window_rows(data: np.ndarray, at: np.ndarray, start: np.ndarray, of: np.ndarray) -> np.ndarray:
    """The bytes of these windows, zeros behind the end of a short text."""
    place = start[:, None] + np.arange(WINDOW)
    inside = place < at[1:][of][:, None]
    return np.where(inside, data[np.where(inside, place, 0)], 0).astype(np.uint8)


def windows_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of the texts and the text of each."""
    start, of = window_places(at)
    return window_rows(data, at, start, of), of


def fit(docs: DataFrame, texts: int = TEXTS_PER_LANGUAGE, steps: int = STEPS) -> Network | None:
    """A network from docs (doc_id, text, lang): at most `texts` texts a language, those with the least hash of doc_id.

    Only hashes in the first part of their range are ranked, a part that holds about SPARE times as many of the
    language's rows, so that the ranking does not grow with the table. None without any labelled text that has a
    letter. More than 400 languages are an error.
    """
    docs = docs.filter("lang is not null").select("doc_id", "text", "lang")
    numbers = docs.groupBy("lang").count().limit(MOST_LANGUAGES + 1).collect()
    if len(numbers) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not numbers:
        return None
    part = F.create_map(*(F.lit(x) for lang, n in numbers for x in (lang, min(1.0, SPARE * texts / n))))[F.col("lang")]
    order = F.xxhash64("doc_id", F.lit(SEED))
    start = lambda i: (F.lit(1) + F.pmod(F.xxhash64("doc_id", F.lit(SEED), F.lit(i)), F.greatest(F.lit(1), F.length("text") - WINDOW))).cast("int")
    pieces = F.array_distinct(F.array(*(F.substring("text", start(i), F.lit(WINDOW)) for i in range(WINDOWS_PER_TEXT))))
    rows = (
        docs.filter(order / 2.0**64 + 0.5 <= part).filter(F.col("text").rlike("\\p{L}"))
        .select("lang", order.alias("h"), pieces.alias("pieces"))
        .withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h", "pieces"))).filter(F.col("n") <= texts)
        .select("lang", "pieces", "h").collect()
    )
    if not rows:
        return None
    languages = sorted({r["lang"] for r in rows})
    labelled = sorted((r["lang"], r["h"], p) for r in rows for p in r["pieces"])
    data = [ta.LOWER[np.frombuffer(p.encode()[:WINDOW].ljust(WINDOW, b"\0"), np.uint8)] for _, _, p in labelled]
    return train(np.stack(data), np.array([languages.index(x) for x, _, _ in labelled]), languages, steps)


def identify(docs: DataFrame, network: Network | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row of docs (doc_id, text, held_out).

    The score is the mean probability of the predicted language over the windows of the whole text; ties go to
    the first language by name. A null text, or one without a letter, is `und` with score 0, as is every text
    without a network. Repeated rows are judged each; an empty table gives no rows; other columns are
    ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(network)  # some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            for part in ta.slices(batch):
                n = part.num_rows
                predicted, score = [None] * n, np.zeros(n)
                if net:
                    data, at = ta.text_bytes(part.column("text"))
                    data, total = ta.LOWER[data], np.zeros((n, len(net.languages)))
                    start, of = window_places(at)
                    for i in range(0, len(of), STRIP):  # so that a very long text takes no more memory than its bytes
                        own = of[i : i + STRIP]
                        p = net.probabilities(window_rows(data, at, start[i : i + STRIP], own))
                        total += np.stack([np.bincount(own, p[:, k], n) for k in range(p.shape[1])], 1)
                    mean = total / np.maximum(1, np.bincount(of, minlength=n))[:, None]
                    best = mean.argmax(1)
                    predicted, score = [net.languages[k] for k in best], mean[np.arange(n), best]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(predicted, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    # A text without a letter goes to Python as empty: it has no windows and is set to `und` below.
    lettered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(F.col("text").rlike("\\p{L}"), F.col("text")).alias("text"), "held_out")
    found = lettered.mapInArrow(run, SCHEMA)
    und = F.col("lang_pred").isNull() | (F.col("score") <= 0)
    return found.select("doc_id", "held_out", F.when(und, F.lit("und")).otherwise(F.col("lang_pred")).alias("lang_pred"), F.when(und, F.lit(0.0)).otherwise(F.col("score")).alias("score"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held)
    return identify(docs, fit(docs.filter("not held_out")))
