"""Toxicity by a linear-chain conditional random field over words.

Labels say which documents are toxic, not where. Words (or beginnings of words) that are many times as frequent in
toxic as in clean training documents label tokens; the field learns weights of a token's word, beginnings and ending and
of the transitions between clean and toxic. Forward-backward marginals of every token of a text give its toxic spans,
and their sums and maximum the document's score by a logistic rule learned on the same sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta

#: The field is fitted on at most so many labelled texts of each class, of at most so many characters each.
TOXIC_TEXTS, CLEAN_TEXTS, MOST_CHARS = 600, 1200, 20_000
HASH_BITS, SEGMENT, ROUNDS, RATE, DECAY, SEED = 18, 128, 40, 0.5, 1e-6, 3
LEAST_LIFT, LEAST_TEXTS, LEAST_SHARE = 20.0, 3, 0.003
SPAN_AT, THRESHOLD = 0.5, 0.7
SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int, spans array<struct<start: bigint, end: bigint>>"
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
#: Word, beginnings of 3, 4, 5 bytes, last 3 bytes.
_BEGINNINGS = (3, 4, 5)


@dataclass
class Tokens:
    start: np.ndarray
    end: np.ndarray
    of: np.ndarray
    features: np.ndarray  # one row a feature kind, 64-bit hashes


def tokens(data: np.ndarray, at: np.ndarray) -> Tokens:
    """Runs of letters (bytes outside ASCII count as letters), A-Z lower-cased for the features."""
    start, end = ta.runs(_LETTER[data], at)
    p = ta.prefix_sums(ta.LOWER[data])
    rows = [ta.span_hashes(p, start, end)]
    rows += [np.where(end - start >= k, ta.span_hashes(p, start, np.minimum(end, start + k)), rows[0]) ^ np.uint64(k * 0x1F123BB5) for k in _BEGINNINGS]
    rows.append(ta.span_hashes(p, np.maximum(start, end - 3), end) ^ np.uint64(0x7C159E37))
    return Tokens(start, end, ta.owners(start, at), np.stack(rows))


@dataclass
class Field:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(1 << HASH_BITS))
    bias: float = -3.0
    transitions: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    rule: np.ndarray = field(default_factory=lambda: np.array([-4.0, 4.0, 2.0, 0.0]))

    def emissions(self, slots: np.ndarray) -> np.ndarray:
        return self.weights[slots].sum(0) + self.bias


def slots(features: np.ndarray) -> np.ndarray:
    return (features >> np.uint64(64 - HASH_BITS)).astype(np.int64)


def marginals(f: Field, emission: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(probability of toxic at each token, probabilities of each pair of states before and at it), exact for whole chains.

    All chains stand in one sequence; `first` marks their first tokens, whose step matrix forgets what came before.
    Segments of the sequence are worked off side by side: the product of each one's step matrices, a run over these
    products for the messages at the segments' ends, then messages inside.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((0, 2, 2))
    x = np.exp(np.clip(emission, -30, 30))
    m = np.exp(f.transitions)[None] * np.stack([np.ones(n), x], 1)[:, None, :]
    m[first] = (np.exp(f.start)[None] * np.stack([np.ones(int(first.sum())), x[first]], 1))[:, None, :]
    m /= m.sum((1, 2), keepdims=True)
    rows = -(-n // SEGMENT)
    full = np.tile(np.eye(2) / 2, (rows * SEGMENT, 1, 1))
    full[:n] = m
    full = full.reshape(rows, SEGMENT, 2, 2)
    whole = np.tile(np.eye(2), (rows, 1, 1))
    for j in range(SEGMENT):
        whole = whole @ full[:, j]
        whole /= whole.sum((1, 2), keepdims=True)
    ahead, behind = np.empty((rows, 2)), np.empty((rows, 2))
    a = b = np.ones(2) / 2
    for s in range(rows):
        ahead[s] = a
        a = a @ whole[s]
        a = a / a.sum()
    for s in range(rows - 1, -1, -1):
        behind[s] = b
        b = whole[s] @ b
        b = b / b.sum()
    before, after = np.empty((rows, SEGMENT, 2)), np.empty((rows, SEGMENT, 2))
    for j in range(SEGMENT):
        before[:, j] = ahead
        ahead = (ahead[:, :, None] * full[:, j]).sum(1)
        ahead = ahead / ahead.sum(1, keepdims=True)
    for j in range(SEGMENT - 1, -1, -1):
        after[:, j] = behind
        behind = (full[:, j] * behind[:, None, :]).sum(2)
        behind = behind / behind.sum(1, keepdims=True)
    pair = before.reshape(-1, 2)[:n, :, None] * m * after.reshape(-1, 2)[:n, None, :]
    pair /= pair.sum((1, 2), keepdims=True)
    return pair[:, :, 1].sum(1), pair


def token_labels(t: Tokens, toxic: np.ndarray) -> np.ndarray:
    """1 for tokens of toxic texts whose word or beginning of 4 or 5 bytes occurs in far more toxic than clean texts, by share."""
    out = np.zeros(len(t.of), bool)
    n_toxic, n_clean = toxic.sum(), (~toxic).sum()
    for row in (0, 2, 3):
        keys, place = np.unique(t.features[row], return_inverse=True)
        pairs = np.unique(place * len(toxic) + t.of)
        word, text = pairs // len(toxic), pairs % len(toxic)
        bad, good = (np.bincount(word[toxic[text] == s], minlength=len(keys)) for s in (True, False))
        lift = ((bad + 0.5) / (n_toxic + 1)) / ((good + 0.5) / (n_clean + 1))
        out |= ((lift >= LEAST_LIFT) & (bad >= max(LEAST_TEXTS, LEAST_SHARE * n_toxic)))[place]
    return out & toxic[t.of]


def document_features(p: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """Per text: 1, largest marginal, log of 1 + sum of marginals, log of 1 + number over one half."""
    most = np.zeros(n)
    np.maximum.at(most, of, p)
    return np.stack([np.ones(n), most, np.log1p(np.bincount(of, p * (p > 0.05), n)), np.log1p(np.bincount(of, p > SPAN_AT, n))], 1)


def fit_field(texts: list[str], toxic: np.ndarray, rounds: int = ROUNDS) -> Field:
    """A field and document rule from labelled texts."""
    data, at = ta.text_bytes(pa.array(texts, pa.large_string()))
    t, f = tokens(data, at), Field()
    y = token_labels(t, toxic)
    told = np.zeros(len(texts), bool)
    told[t.of[y]] = True
    use = (told | ~toxic)[t.of]  # a toxic text without a labelled token teaches nothing about tokens
    s, own, y = slots(t.features)[:, use], t.of[use], y[use].astype(float)
    first = np.concatenate([[True], np.diff(own) != 0]) if len(own) else np.zeros(0, bool)
    seen = {k: np.full_like(np.asarray(getattr(f, k), float), 1e-8) for k in ("weights", "bias", "transitions", "start")}
    n = max(1, len(y))
    state = y.astype(int)
    true_pairs = np.zeros((2, 2))
    inner = np.flatnonzero(~first)
    np.add.at(true_pairs, (state[inner - 1], state[inner]), 1)
    true_start = np.bincount(state[first], minlength=2)
    for _ in range(rounds if len(y) else 0):
        p, pair = marginals(f, f.emissions(s), first)
        error = p - y
        grad = {"weights": sum(np.bincount(row, error, 1 << HASH_BITS) for row in s) + DECAY * n * f.weights, "bias": error.sum(), "transitions": pair[inner].sum(0) - true_pairs, "start": pair[first].sum((0, 1)) - true_start}
        for k, g in grad.items():
            seen[k] = seen[k] + np.asarray(g) ** 2
            setattr(f, k, getattr(f, k) - RATE * g / np.sqrt(seen[k]))
    whole_first = np.concatenate([[True], np.diff(t.of) != 0]) if len(t.of) else np.zeros(0, bool)
    p, _ = marginals(f, f.emissions(slots(t.features)), whole_first)
    x = document_features(p, t.of, len(texts))
    w = f.rule.copy()
    for _ in range(25):  # Newton steps of a logistic regression, lightly drawn to the first guess
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(x.shape[1])
        w = w - np.linalg.solve(h, x.T @ (q - toxic) + 0.05 * (w - f.rule))
    f.rule = w
    return f


def fit(docs: DataFrame, labels: DataFrame) -> Field | None:
    """A field from docs (doc_id, text) and labels (doc_id, toxic); the texts with the least hash of doc_id are the sample.

    None if there is no toxic or no clean text. A doc_id with labels that disagree counts as toxic; of repeated rows the least text counts.
    """
    known = labels.filter("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("n", F.xxhash64("doc_id", F.lit(SEED)))
    # The sample is chosen among the labels, so that no text is shuffled for it; some of its texts may be missing or too long.
    first = lambda c, k: known.filter(F.col("toxic") == c).orderBy("n", "doc_id").limit(k)
    chosen = F.broadcast(first(1, TOXIC_TEXTS).unionByName(first(0, CLEAN_TEXTS)))  # a bounded number of ids
    rows = docs.filter(F.length("text") <= MOST_CHARS).join(chosen, "doc_id").groupBy("doc_id", "toxic", "n").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r["toxic"], r["n"], r["doc_id"]))
    toxic = np.array([r["toxic"] == 1 for r in rows], bool)
    return fit_field([r["text"] for r in rows], toxic) if toxic.any() and not toxic.all() else None


def score_toxicity(docs: DataFrame, model: Field | None) -> DataFrame:
    """One row of SCHEMA for each row of docs (doc_id, text, held_out).

    spans are the code-point places of runs of tokens with marginals over one half. Null and empty texts have no token and
    get the rule's score for none; without a model every score is 0. Texts are read whole at any length; repeated rows
    are scored each; an empty table gives no rows; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2**18 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = sent.value
        for batch in batches:
            for part in ta.slices(batch):
                data, at = ta.text_bytes(part.column("text"))
                n = part.num_rows
                score, spans = np.zeros(n), [[] for _ in range(n)]
                if f:
                    t = tokens(data, at)
                    p, _ = marginals(f, f.emissions(slots(t.features)), np.concatenate([[True], np.diff(t.of) != 0]) if len(t.of) else np.zeros(0, bool))
                    score = 1 / (1 + np.exp(-np.clip(document_features(p, t.of, n) @ f.rule, -30, 30)))
                    points = np.concatenate([[0], np.cumsum(ta.LEAD[data])])
                    hot = np.flatnonzero(p > SPAN_AT)
                    last = -2
                    for i, k in zip(hot.tolist(), t.of[hot].tolist()):
                        begin, end = int(points[t.start[i]] - points[at[k]]), int(points[t.end[i]] - points[at[k]])
                        if last == i - 1 and spans[k]:
                            spans[k][-1]["end"] = end
                        else:
                            spans[k].append({"start": begin, "end": end})
                        last = i
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["doc_id", "held_out", "score", "predicted", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), "held_out").mapInArrow(run, SCHEMA)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(True))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held_out", held)
    model = fit(docs.filter("not held_out"), spark.read.parquet(f"{sf_dir}/labels.parquet").filter("crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1"))
    found = score_toxicity(docs, model)
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"].cast("string"), x["end"].cast("string"))), ","))
