"""Language-model scores by deleted interpolation.

p(w | h) mixes the maximum-likelihood bigram and unigram estimates and a uniform one. The weights belong to
a bucket of the context's training frequency (by powers of two) and are learned by expectation-maximisation
on a deleted part of the training documents, whose own counts are left out of the estimates meanwhile.
Counts cover all training documents; words and pairs are keyed by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta
from .blocks import REQUEST, Blocks, block_requests, pack, read_reply, request_batch, unpack
from .tables import materialise

END, START = np.uint64(0xA3C59AC2F1E7D9B5), np.uint64(0x5DEECE66D1234567)
BUCKETS, ROUNDS = 48, 60
#: Estimates are grouped for the learning of weights in steps of this many tenths of a power of ten.
GRAIN = 0.02
SCHEMA = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
WORD, PAIR = 0, 1


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(token hashes, hashes of (context, token), index of the text) of each text: its words and one end."""
    data, at = ta.text_bytes(column)
    data = ta.LOWER[data]
    start, end = ta.runs(~ta.SPACE[data], at)
    words = ta.string_hashes(data, ta.prefix_sums(data), start, end)
    n = np.diff(np.searchsorted(start, at))
    of = np.repeat(np.arange(len(n)), n + 1)
    token = np.empty(len(of), np.uint64)
    last = np.cumsum(n + 1) - 1
    inner = np.ones(len(of), bool)
    inner[last] = False
    token[last], token[inner] = END, words
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[last - n] = START
    return token, context, of


def _keys(token: np.ndarray, context: np.ndarray) -> tuple[np.ndarray, ...]:
    words, word = np.unique(np.concatenate([token, [START]]), return_inverse=True)
    pairs, pair = np.unique(ta.mix(context * np.uint64(0x9E3779B97F4A7C15) + token), return_inverse=True)
    return words, word[:-1], pairs, pair


def _asking(buckets: int):
    def work(block: int, docs: pa.RecordBatch, _) -> Iterator[pa.RecordBatch]:
        token, context, of = tokens(docs.column("text"))
        words, word, pairs, pair = _keys(token, context)
        train, deleted = (docs.column(c).to_numpy(zero_copy_only=False) for c in ("train", "deleted"))
        rows: list[tuple] = []
        for kind, keys, own in ((WORD, words, word), (PAIR, pairs, pair)):
            counts = [np.bincount(own[some[of]], minlength=len(keys)).astype(np.uint32) for some in (train, deleted)]
            if kind == WORD:  # a start is the context of one token in each text
                counts = [c + np.where(keys == START, np.uint32(some.sum()), np.uint32(0)) for c, some in zip(counts, (train, deleted))]
            rows += block_requests(buckets, kind, block, keys, *counts)
        yield request_batch(rows)

    return work


def _sums(kind: int, whole: list[np.ndarray]) -> bytes:
    """Distinct training keys, training count, deleted count of a key range."""
    return pack(np.array([(whole[0] > 0).sum(), whole[0].sum(), whole[1].sum()], np.int64))


def context_bucket(count: np.ndarray) -> np.ndarray:
    """0 for unseen, else 1 + the whole part of the binary logarithm."""
    return np.minimum(np.where(count > 0, 1 + np.floor(np.log2(np.maximum(count, 1))), 0).astype(np.int64), BUCKETS - 1)


def _looked_up(docs: pa.RecordBatch, given: list) -> tuple[np.ndarray, ...]:
    token, context, of = tokens(docs.column("text"))
    words, word, _, pair = _keys(token, context)
    c_word = np.stack(read_reply(given[0].get(WORD), "i8", "i8"))
    c_pair = np.stack(read_reply(given[0].get(PAIR), "i8", "i8"))
    before = np.searchsorted(words, context)
    return of, c_word[:, word], c_word[:, before], c_pair[:, pair]


def learn_weights(cells: np.ndarray, uniform: float, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of (bigram, unigram, uniform) for each context bucket from rows (bucket, bigram, unigram, n) of held-out tokens.

    A bucket without tokens takes the weights of all together; an unseen context has no bigram estimate.
    """
    def em(rows: np.ndarray, bigram: bool) -> np.ndarray:
        p = np.stack([rows[:, 1] if bigram else np.zeros(len(rows)), rows[:, 2], np.full(len(rows), uniform)])
        w = np.array([1.0, 1.0, 1.0]) if bigram else np.array([0.0, 1.0, 1.0])
        w /= w.sum()
        for _ in range(rounds):
            share = w[:, None] * p
            share /= share.sum(0)
            w = (share * rows[:, 3]).sum(1) / rows[:, 3].sum()
        w = w + np.array([1e-6 * bigram, 1e-6, 1e-6])  # held-out tokens may lack a case that other texts have
        return w / w.sum()

    seen = cells[cells[:, 0] > 0] if len(cells) else cells
    common = em(seen, True) if len(seen) else np.array([0.4, 0.4, 0.2])
    out = np.tile(common, (BUCKETS, 1))
    out[0] = em(cells[cells[:, 0] == 0], False) if len(cells) and (cells[:, 0] == 0).any() else np.array([0.0, 0.7, 0.3])
    for b in np.unique(seen[:, 0]).astype(int) if len(seen) else ():
        out[b] = em(seen[seen[:, 0] == b], True)
    return out


def score_texts(docs: DataFrame, train: str, deleted: str) -> DataFrame:
    """One row of SCHEMA for each row of docs (doc_id, text).

    train and deleted are SQL conditions on docs: the documents to learn from, and of these the part that the
    mixture weights are learned on. held_out is true outside train. A-Z are lower-cased; a text has its words and one end.
    Null texts count as empty: one token. Texts are whole at any length; repeated rows count and score each;
    an empty table gives no rows; other columns are only seen by the conditions. A condition that is null is
    false. doc_id may be null.
    """
    spark = docs.sparkSession
    table = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text", f"coalesce({train}, false) train", f"coalesce({train}, false) and coalesce({deleted}, false) deleted")
    with Blocks(table) as blocks:
        replies = blocks.answer(blocks.each(_asking(blocks.buckets), REQUEST), [(np.add, "u4", "i8"), (np.add, "u4", "i8")], _sums)
        sums = np.array([unpack(r["reply"], "i8")[0] for r in replies.filter(f"block = -1 and kind = {WORD}").select("reply").toLocalIterator()]).reshape(-1, 3).sum(0)
        starts = table.agg(F.count_if("train").alias("n"), F.count_if("deleted").alias("d")).first()
        # START was counted among the words as a context; it is no token.
        distinct, n, gone = int(sums[0]) - (starts["n"] > 0), int(sums[1]) - starts["n"], int(sums[2]) - starts["d"]
        uniform = 1 / (distinct + 1)
        replies = replies.filter("block >= 0")

        def cells(block: int, docs: pa.RecordBatch, given: list) -> Iterator[pa.RecordBatch]:
            of, word, context, pair = _looked_up(docs, given)
            own = docs.column("deleted").to_numpy(zero_copy_only=False)[of]
            word, context, pair = ((x[0] - x[1])[own] for x in (word, context, pair))
            grain = lambda p: np.where(p > 0, np.round(np.log10(np.maximum(p, 1e-300)) / GRAIN), 1).astype(np.int64)
            found, counts = np.unique(np.stack([context_bucket(context), grain(pair / np.maximum(context, 1)), grain(word / max(1, n - gone))]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([*map(pa.array, found), pa.array(counts.astype(np.int64))], names=["bucket", "p2", "p1", "n"])

        # The number of cells is bounded by the grain, whatever the corpus.
        rows = blocks.each(cells, "bucket bigint, p2 bigint, p1 bigint, n bigint", replies).groupBy("bucket", "p2", "p1").agg(F.sum("n").alias("n")).collect()
        value = lambda g: 0.0 if g == 1 else 10 ** (g * GRAIN)
        weights = learn_weights(np.array([[r["bucket"], value(r["p2"]), value(r["p1"]), r["n"]] for r in rows], float).reshape(-1, 4), uniform)

        def score(block: int, docs: pa.RecordBatch, given: list) -> Iterator[pa.RecordBatch]:
            of, word, context, pair = _looked_up(docs, given)
            word, context, pair = word[0], context[0], pair[0]
            w = weights[context_bucket(context)]
            p = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * word / max(1, n) + w[:, 2] * uniform
            base = np.log10((word + 0.5) / (n + 0.5 * (distinct + 1)))
            size = docs.num_rows
            count = lambda x=None: np.bincount(of, x, size)
            held = ~docs.column("train").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays(
                [docs.column("doc_id"), pa.array(held), pa.array(count()), pa.array(np.bincount(of[word > 0], minlength=size)), pa.array(np.full(size, n)), pa.array(count(base)), pa.array(count(np.log10(p)))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

        return materialise(blocks.each(score, SCHEMA, replies))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = "crc32(cast(cast(doc_id as string) as binary))"
    # 0 modulo 20 is 0 modulo 5, so the deleted part is a quarter of a fifth of the documents to learn from.
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{crc} % 5 <> 1", f"{crc} % 20 = 0")
