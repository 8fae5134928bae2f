"""Secret scans: fixed patterns, and a battery of randomness tests on runs of code-like characters.

A candidate is a run of 16 or more characters of base64 or one of its parts. Its encoding is the least usual alphabet
that holds all of its characters. Three tests compare it with uniform draws from that alphabet: chi-squared of its
symbols and of its character classes, number of runs above and below the middle of the alphabet, and serial
correlation of neighbours. Their sum D is small for random strings and large for words, names and counters; how
large depends on encoding and length. So both laws are simulated once for each encoding and length, with a fixed
seed: random strings, and ordinary ones put together from words and counters in the usual styles of writing. The false-discovery
rate of taking all strings up to D is known from the two laws and a stated prior share of secrets; the largest D
that keeps it under the limit is the limit of that encoding and length. Nothing is learned from the
table, so a text gets the same spans alone and among any others.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textarrays as ta

KINDS = ("assign", "access", "hex", "random")
LEAST_CHARS = 16
#: Largest false-discovery rate, and the share of secrets among candidates that it is reckoned with.
RATE, PRIOR = 0.05, 0.05
#: No limit takes more than this share of random strings, so that D's far tail is never needed.
MOST_TAKEN = 0.998
#: Lengths that are simulated; between them limits are interpolated, above the last they stay.
LENGTHS, SIMULATED, SEED = (16, 20, 24, 32, 40, 64, 128, 256), 2000, 20240611
#: Encodings and their alphabets' sizes. Runs of digits are numbers, never secrets.
ENCODINGS = ("digits", "hex", "letters", "mixed letters", "alphanumeric of one case", "alphanumeric", "base64")
ALPHABETS = np.array([10, 16, 26, 52, 36, 62, 64])
#: Words of four languages and their usual endings, from which ordinary strings are put together (fixed values).
WORDS = (
    "the and that have with this from they would there their what about which when make like time just know take people into year your good some could them other than then look only come over think also back after work first well even want because these give most"
    " responsibility characterization straightforward telecommunication misunderstanding international institution proportion comprehension productive configuration environment application development information management"
    " tion ation ment ness able ing ity ly er re an on in st th he"
    " und der die das nicht mit sich auch auf werden haben einen Geschwindigkeit Verantwortung Wissenschaft Krankenversicherung Arbeitsbedingungen Lebensmittel keit ung heit lich schaft zu ver be ge"
    " les des que pour dans une est pas plus vous avec constitution anticonstitutionnellement eux ment elle oire ais"
    " los las por para una con como pero sus este responsabilidad desafortunadamente extraordinario constitucionalidad dad mente cion ado oso"
).split()
HEX_WORDS = "face feed dead beef cafe babe added decade facade bad fee ace dad cab bed fade abcdef".split()
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Without one of these, in lower case, a text has no assignment and no access key.
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key", b"akia")
_HEX, _CODE = np.zeros(256, bool), np.zeros(256, bool)
_HEX[list(b"0123456789abcdef")] = True
_CODE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
#: Index of a character in base64 order (the URL forms share the last two).
_INDEX = np.zeros(256, np.int64)
for _i, _c in enumerate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"):
    _INDEX[_c] = _i
_INDEX[ord("-")], _INDEX[ord("_")] = 62, 63
#: Classes of characters (capital, small, digit, other) and their shares of each alphabet; vowels.
_CLASS, _VOWEL = np.full(256, 3, np.int8), np.zeros(256, bool)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 0, 1, 2
_VOWEL[list(b"AEIOUaeiou")] = True
_CLASS_SHARES = np.array([[0, 0, 10, 0], [0, 6, 10, 0], [0, 26, 0, 0], [26, 26, 0, 0], [0, 26, 10, 0], [26, 26, 10, 0], [26, 26, 10, 2]]) / ALPHABETS[:, None]


def departure(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(D, index of the encoding) of each row of m, strings of one length as rows of bytes."""
    n, size = m.shape
    index = _INDEX[m]
    upper, lower, digit = (((m >= a) & (m <= b)).sum(1) for a, b in ((65, 90), (97, 122), (48, 57)))
    other = size - upper - lower - digit
    hexa = (((m >= 48) & (m <= 57)) | ((m >= 97) & (m <= 102))).all(1) | (((m >= 48) & (m <= 57)) | ((m >= 65) & (m <= 70))).all(1)
    one, letters = (upper == 0) | (lower == 0), (digit == 0) & (other == 0)
    encoding = np.select([digit == size, hexa, letters & one, letters, (other == 0) & one, other == 0], range(6), 6)
    alphabet = ALPHABETS[encoding].astype(float)
    digits_first, of_one_case = np.isin(encoding, (0, 1, 4)), encoding == 2
    rank = np.where(digits_first[:, None], np.where(index >= 52, index - 52, index % 26 + 10), np.where(of_one_case[:, None], index % 26, index)).astype(float)
    symbols = np.bincount((np.arange(n)[:, None] * 256 + m).ravel(), minlength=n * 256).reshape(n, 256).astype(float)
    chi = alphabet / size * (symbols**2).sum(1) - size
    z_chi = np.maximum(0, (chi - (alphabet - 1)) / np.sqrt(2 * (alphabet - 1) * (1 - 1 / size)))
    share = np.where(letters, 0, 10 / alphabet)
    spread = lambda p: np.sqrt(np.maximum(size * p * (1 - p), 1e-9))
    z_digit = np.where(letters | (encoding == 0), 0, (digit - size * share) / spread(share))
    z_other = np.where(encoding == 6, (other - size * 2 / 64) / spread(2 / 64), 0)
    z_case = np.where(np.isin(encoding, (3, 5, 6)), (upper - lower) / np.sqrt(np.maximum(1, upper + lower)), 0)
    vowel = _VOWEL[m].sum(1)
    z_vowel = np.where((encoding >= 2) & (upper + lower > 0), (vowel - (upper + lower) * 10 / 52) / np.sqrt(np.maximum(upper + lower, 1) * 10 / 52 * 42 / 52), 0)
    shares = _CLASS_SHARES[encoding]
    q = 1 - (shares**2).sum(1)
    kind = _CLASS[m]
    z_changes = ((kind[:, 1:] != kind[:, :-1]).sum(1) - (size - 1) * q) / np.sqrt(np.maximum((size - 1) * q * (1 - q), 0.25)) * (q > 0)
    high = rank >= alphabet[:, None] / 2
    up = high.sum(1)
    mean = 2 * up * (size - up) / size + 1
    var = np.maximum((mean - 1) * (mean - 2) / (size - 1), 0.25)
    z_runs = ((high[:, 1:] != high[:, :-1]).sum(1) + 1 - mean) / np.sqrt(var)
    c = rank - rank.mean(1, keepdims=True)
    z_serial = (c[:, 1:] * c[:, :-1]).sum(1) / np.maximum((c * c).sum(1), 1e-9) * np.sqrt(size)
    return z_chi**2 + z_digit**2 + z_other**2 + z_case**2 + np.maximum(0, z_vowel) ** 2 + np.minimum(0, z_changes) ** 2 + z_runs**2 + z_serial**2, encoding


def _departures(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out, kind, size = np.zeros(len(start)), np.zeros(len(start), np.int64), end - start
    for k in np.unique(size).tolist():
        own = np.flatnonzero(size == k)
        for i in range(0, len(own), max(1, 200_000 // k)):
            some = own[i : i + max(1, 200_000 // k)]
            out[some], kind[some] = departure(data[start[some][:, None] + np.arange(k)])
    return out, kind


def _random_strings(encoding: int, size: int, rng: np.random.Generator) -> np.ndarray:
    digits, low, up = b"0123456789", bytes(range(97, 123)), bytes(range(65, 91))
    alphabet = (digits, digits + b"abcdef", low, up + low, low + digits, up + low + digits, up + low + digits + b"+/")[encoding]
    return np.frombuffer(alphabet, np.uint8)[rng.integers(0, len(alphabet), (SIMULATED, size))]


@functools.cache
def _ordinary_text(encoding: int) -> np.ndarray:
    """Words one after the other, with counters, capitals and joints as the encoding has them, in pieces of one style each."""
    rng, pieces = np.random.default_rng(SEED + encoding), []
    words = np.array(HEX_WORDS if encoding == 1 else WORDS)
    numbers, joints = encoding in (1, 4, 5, 6), "_-/" if encoding == 6 else " "
    for style in range(12):
        joint, capital = joints[style % len(joints)].strip(), encoding in (3, 5) or encoding == 6 and style % 2
        for word in rng.choice(words, 600):
            pieces.append(word.title() if capital else word.lower())
            if numbers and rng.random() < 0.3:
                pieces.append(str(rng.integers(0, 10 ** int(rng.integers(1, 5)))) if rng.random() < 0.5 else str(1970 + rng.integers(0, 60)))
            pieces.append(joint)
    return np.frombuffer("".join(pieces).encode(), np.uint8)


def _ordinary_strings(encoding: int, size: int, rng: np.random.Generator) -> np.ndarray:
    text = _ordinary_text(encoding)
    return text[rng.integers(0, len(text) - size, SIMULATED)[:, None] + np.arange(size)]


@functools.cache
def random_limits(rate: float = RATE, prior: float = PRIOR) -> np.ndarray:
    """The largest D of a secret for each encoding and length up to the last simulated one; -1 where none keeps the rate.

    The lower tail of D of ordinary strings is a normal law of ln D, fitted to the mean and to the spread below it.
    """
    rng, out = np.random.default_rng(SEED), np.full((len(ENCODINGS), LENGTHS[-1] + 1), -1.0)
    for e in range(1, len(ENCODINGS)):
        known = []
        for size in LENGTHS:
            d, kind = departure(_random_strings(e, size, rng))
            random = np.sort(d[kind == e])[: int(MOST_TAKEN * (kind == e).sum())]
            d, kind = departure(_ordinary_strings(e, size, rng))
            plain = np.log(d[kind == e] if (kind == e).sum() >= 50 else d)
            level = plain.mean()
            spread = math.sqrt(((plain[plain < level] - level) ** 2).mean())
            tail = np.array([0.5 * math.erfc((level - x) / spread / math.sqrt(2)) for x in np.log(random)])
            taken = np.arange(1, len(random) + 1) / len(random)
            ok = np.flatnonzero((1 - prior) * tail <= rate * ((1 - prior) * tail + prior * taken))
            known.append(random[ok[-1]] if len(ok) else -1.0)
        out[e, LENGTHS[0] :] = np.interp(np.log(np.arange(LENGTHS[0], LENGTHS[-1] + 1)), np.log(LENGTHS), known)
    return out


def pattern_spans(text: str) -> list[tuple[int, int, str]]:
    """Spans of assignments and access keys, in code points; those too short are dropped."""
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    return found + [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]


_SPANS = "array<struct<start: bigint, end: bigint, kind: string>>"
_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))


def scan_texts(column: pa.Array, limits: np.ndarray) -> tuple[list[list], list[list]]:
    """For each text its base spans and its random ones, as (start, end, kind) in code points."""
    data, at = ta.text_bytes(column)
    raw, n = data.tobytes(), len(at) - 1
    base: list[list] = [[] for _ in range(n)]
    random: list[list] = [[] for _ in range(n)]
    points = np.concatenate([[0], np.cumsum(ta.LEAD[data])])
    low, hot = raw.lower(), set()
    for w in _WORDS:
        i = low.find(w)
        while i >= 0:
            k = int(np.searchsorted(at, i, "right")) - 1
            hot.add(k)
            i = low.find(w, int(at[k + 1]))
    for k in hot:
        base[k] += pattern_spans(raw[at[k] : at[k + 1]].decode())
    start, end = ta.runs(_HEX[data], at)
    own = np.flatnonzero(end - start >= 24)
    of = np.searchsorted(at, start[own], "right") - 1
    for s, e, k in zip((points[start[own]] - points[at[of]]).tolist(), (points[end[own]] - points[at[of]]).tolist(), of.tolist()):
        base[k].append((s, e, "hex"))
    start, end = ta.runs(_CODE[data], at)
    own = end - start >= LEAST_CHARS
    start, end = start[own], end[own]
    d, encoding = _departures(data, start, end)
    own = d <= limits[encoding, np.minimum(end - start, limits.shape[1] - 1)]
    start, end = start[own], end[own]
    of = np.searchsorted(at, start, "right") - 1
    for s, e, k in zip((points[start] - points[at[of]]).tolist(), (points[end] - points[at[of]]).tolist(), of.tolist()):
        random[k].append((s, e, "random"))
    return base, random


def _lists(rows: list[list]) -> pa.Array:
    return pa.array([[{"start": s, "end": e, "kind": k} for s, e, k in v] for v in rows], _ARROW)


def _ordered(spans: Column) -> Column:
    place = F.array(*map(F.lit, KINDS))
    keyed = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.array_position(place, x["kind"]).alias("at"), x["end"].alias("end"), x["kind"].alias("kind")))
    return F.transform(F.array_sort(keyed), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))


def scan_secrets(docs: DataFrame, rate: float = RATE, prior: float = PRIOR) -> DataFrame:
    """One row for each row of docs (doc_id, text): doc_id, base and spans as arrays of (start, end, kind).

    base holds the fixed patterns; spans adds the kind random. Offsets are code points, ends exclusive.
    A null or empty text has no spans. Texts are read whole at any length, in time in proportion to it. Repeated
    rows are scanned each; spans that tie on start are ordered by kind as listed. An empty table gives no rows; other
    columns are ignored. doc_id may be null.
    """
    limits = random_limits(rate, prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in ta.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(_lists, scan_texts(part.column("text"), limits))], names=["doc_id", "base", "random"])

    found = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, f"doc_id bigint, base {_SPANS}, random {_SPANS}")
    return found.select("doc_id", _ordered(F.col("base")).alias("base"), _ordered(F.concat("base", "random")).alias("spans"))


def redact_secrets(docs: DataFrame, rate: float = RATE, mark: str = "[SECRET]", prior: float = PRIOR) -> DataFrame:
    """docs with every secret span of text replaced by the mark, overlapping ones by one; n_chars, if there is one, becomes the new length.

    All rows and columns stay, repeated rows and columns of any other name among them; each row is judged alone, so ties
    need no rule. A null text stays null, an empty one empty; texts of any length are read whole; an empty table
    gives no rows.
    """
    limits = random_limits(rate, prior)

    def cut(column: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([column], names=["text"])
        parts = []
        for part in ta.slices(batch):
            texts, changed = part.column(0), {}
            for i, both in enumerate(zip(*scan_texts(texts, limits))):
                if spans := sorted(x[:2] for found in both for x in found):
                    text, out, at = texts[i].as_py(), [], 0
                    for s, e in spans:
                        if s >= at:
                            out += [text[at:s], mark]
                        at = max(at, e)
                    changed[i] = "".join(out) + text[at:]
            if changed:
                values = texts.to_pylist()
                for i, x in changed.items():
                    values[i] = x
                texts = pa.array(values, pa.string())
            parts.append(texts.cast(pa.string()))
        return pa.concat_arrays(parts) if parts else column.cast(pa.string())

    clean = F.arrow_udf(cut, "string")(F.col("text").cast("string"))
    out = docs.withColumn("text", clean)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def joined(spans: Column | str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    count = lambda spans, kind: F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")
    return found.select("doc_id", *(count("base", k).alias(f"n_{k}") for k in KINDS[:3]), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), count("spans", "random").alias("n_random"))
