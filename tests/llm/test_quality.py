import random
import re
from collections import Counter

import zstandard

from covara.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    words = WORD.findall(t)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def check(df):
    rows, found = df.select("doc_id", "text").collect(), q.quality_rules(df).collect()
    assert sorted(((r.doc_id, *brute(r.text)) for r in rows), key=str) == sorted((tuple(r)[:7] for r in found), key=str)
    assert not any(r.kept and r.base_failed for r in found)
    return found


def test_counts_match_brute_force(documents, edges, empty):
    check(documents)
    check(edges)
    assert check(empty) == []


def test_bands():
    r = random.Random(3)
    packer = zstandard.ZstdCompressor(level=q.LEVEL)
    words = ["".join(r.choice("etaoinshrdlu") for _ in range(r.randint(1, 9))) for _ in range(3000)]
    prose = " ".join(r.choice(words) for _ in range(3000)).encode()
    noise = bytes(r.randrange(33, 127) for _ in range(20_000))
    assert q.compression(prose, packer, q.BANDS, q.CHUNK_BYTES)[3]
    assert not q.compression(noise, packer, q.BANDS, q.CHUNK_BYTES)[3]
    assert not q.compression(b"spam eggs " * 2000, packer, q.BANDS, q.CHUNK_BYTES)[3]
    _, chunks, bad, _ = q.compression(prose + b"spam eggs " * 900, packer, q.BANDS, q.CHUNK_BYTES)
    assert bad >= 2 and chunks > bad


def test_verdict_follows_labels(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {(r.quality, r.kept): r["count"] for r in q.quality_rules(docs).join(labels, "doc_id").groupBy("quality", "kept").count().collect()}
    good, junk = got.get((1, True), 0) / (got.get((1, True), 0) + got.get((1, False), 0)), got.get((0, False), 0) / (got.get((0, False), 0) + got.get((0, True), 0))
    assert good > 0.9 and junk > 0.6


def test_verdict_column_agrees(documents, edges):
    for df in (documents, edges):
        assert df.filter(q.quality_verdict(df["text"])).count() == q.quality_rules(df).filter("kept").count()


def test_regular_lines_are_told_apart():
    """A Thue-Morse word and its complement have one polynomial value modulo 2**64 from 1,024 characters on."""
    import numpy as np
    import pyarrow as pa

    from covara.llm import quality, textarrays

    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    data, at = textarrays.text_bytes(pa.array([f"{word}\n{other}\n{word}", f"{word} {other}"]))
    counts = quality.text_counts(data, at)
    assert counts["n_dup_lines"].tolist() == [1, 0] and counts["n_words"].tolist() == [3, 2]
    start, end = textarrays.runs(~textarrays.SPACE[data], at)
    assert len(np.unique(textarrays.string_hashes(data, textarrays.prefix_sums(data), start, end))) == 2
