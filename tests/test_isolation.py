"""Work that raises, exact percentiles, and jobs as state machines, on small inputs against plain Python."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from covara.operators import isolation
from covara.operators.quantiles import percentiles
from covara.sources.versions import Store
from covara.streaming import jobs


def test_a_raising_document_does_not_stop_the_others(spark, tmp_path):
    docs = spark.createDataFrame([(1, "10"), (2, "x"), (3, None), (4, "0"), (5, "300")], "doc_id bigint, text string")
    calls = tmp_path / "calls"

    def work(row, attempt):
        with calls.open("a") as f:
            f.write(f"{row['text']} {attempt}\n")
        if row["text"] == "0" and attempt < 3:
            raise RuntimeError("later")
        return int(row["text"])

    tried = isolation.attempted(docs, "doc_id", ["text"], work, T.ByteType()).collect()
    tried.sort(key=lambda r: r.doc_id)
    assert [r.value for r in tried] == [10, None, None, None, None] and [(r.error or "").split(":")[0] for r in tried] == ["", "ValueError", "TypeError", "RuntimeError", "ArrowInvalid"]
    store = Store(spark, str(tmp_path / "s"), isolation.tables("doc_id", "bigint", "bigint"), buckets=2)
    assert [isolation.run_isolated(store, docs, "doc_id", ["text"], work) for _ in range(4)] == [{"done": 2, "failed": 3}, {"done": 0, "failed": 3}, {"done": 1, "failed": 2}, {"done": 0, "failed": 0}]
    assert sorted(map(tuple, store.read("results").collect())) == [(1, 1, 10), (4, 3, 0), (5, 1, 300)]
    assert sorted((r.doc_id, r.attempt) for r in store.read("quarantine").collect()) == [(2, 3), (3, 3)]
    assert calls.read_text().count("10 1\n") == 2  # once for attempted, once for the store
    assert isolation.summary({"done": 2, "failed": 3}) == ("processed 2, failed 3", 1) and isolation.summary({"done": 2, "failed": 0})[1] == 0


def test_a_run_that_is_cut_off_repeats_nothing_that_was_committed(spark, tmp_path, monkeypatch):
    docs = spark.range(6).selectExpr("id doc_id", "cast(id as string) text")
    store = Store(spark, str(tmp_path / "s"), isolation.tables("doc_id", "bigint", "bigint"), buckets=2)
    isolation.run_isolated(store, docs.filter("doc_id < 2"), "doc_id", ["text"], lambda r, n: 7)
    monkeypatch.setattr(store, "_publish", lambda d: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        isolation.run_isolated(store, docs, "doc_id", ["text"], lambda r, n: 8)
    monkeypatch.undo()
    assert isolation.run_isolated(store, docs, "doc_id", ["text"], lambda r, n: 9) == {"done": 4, "failed": 0}
    assert {r.value for r in store.read("results").filter("doc_id < 2").collect()} == {7} and {r.value for r in store.read("results").filter("doc_id >= 2").collect()} == {9}


def plain(values, p):
    v = sorted(values)
    at = p * (len(v) - 1)
    low, high = v[int(at)], v[min(len(v) - 1, int(at) + (at != int(at)))]
    return low if low == high else low + (high - low) * (at - int(at))


def test_percentiles(spark):
    r = random.Random(5)
    points = [0, 0.05, 0.25, 0.5, 0.9, 0.99, 1]
    values = {
        "hot": [r.choice([1.5, 2.5, r.uniform(-1e3, 1e3)]) for _ in range(30_000)], "same": [0.1] * 500, "wide": [r.choice([-1, 1]) * 10 ** r.uniform(-300, 300) for _ in range(900)], "one": [3.0], "two": [-0.0, 1e-310],
        None: [float(i) for i in range(100)], "infinite": [float("-inf"), 0.0, 1.0, float("inf")], "close": [1 + i * 2.0**-52 for i in range(64)],
    }
    rows = [(k, x) for k, some in values.items() for x in some] + [("none", None), ("one", None)]
    r.shuffle(rows)
    found = {x.key: x for x in percentiles(spark.createDataFrame(rows, "key string, x double").repartition(5), ["key"], "x", points).collect()}
    assert found["none"].n == 0 and found["none"].p3 is None and found["none"].least is None and len(found) == len(values) + 1
    for k, some in values.items():
        assert (found[k].n, found[k].least, found[k].most) == (len(some), min(some), max(some))
        for i, p in enumerate(points):
            if k != "infinite" or p in (0, 1):
                assert found[k][f"p{i}"] == pytest.approx(plain(some, p), rel=1e-12, abs=1e-12), (k, p)
    whole = percentiles(spark.createDataFrame(rows, "key string, x double").filter("key = 'hot'"), [], "x", [0.5]).collect()
    assert len(whole) == 1 and whole[0].p0 == found["hot"].p3
    assert percentiles(spark.createDataFrame(rows, "key string, x double").filter("key = '-'"), ["key"], "x", [0.5]).count() == 0


RULES = jobs.JobRules({"": ("queued",), "queued": ("running",), "running": ("complete", "failed")}, 100)


def fold(events):
    state, since, out = "", None, []
    for at, n, to in sorted(events):
        if since is not None and state in ("queued", "running") and at > since + 100e6:
            out.append((None, "abandoned", state, True))
            state = "abandoned"
        ok = to in {"": ["queued"], "queued": ["running"], "running": ["complete", "failed"]}.get(state, [])
        out.append((n, to, state, ok))
        state, since = (to, at) if ok else (state, since)
    return out, state, since


def test_the_last_accepted_state_judges(spark):
    events = [(1, 0, 0, "queued"), (1, 1, 1, "complete"), (1, 2, 2, "running"), (1, 3, 3, "running"), (1, 4, 4, "failed"), (1, 5, 5, "queued"), (2, 6, 0, "running"), (2, 7, 1, "queued"), (2, 8, 200, "running"), (3, 9, 0, "queued"), (4, 10, 199, "queued")]
    df = spark.createDataFrame(events, "job bigint, n bigint, s bigint, state string").selectExpr("job", "n", "state", "timestamp_seconds(s) t")
    got = jobs.judged(df, "job", "n", "t", "state", RULES).collect()
    want = []
    for k in (1, 2, 3, 4):
        out, state, since = fold([(s * 10**6, n, x) for j, n, s, x in events if j == k])
        want += [(k, *x) for x in out]
        if state in ("queued", "running") and since + 100e6 < 200e6:
            want.append((k, None, "abandoned", state, True))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want)) and (3, None, "abandoned", "queued", True) in want and (2, None, "abandoned", "queued", True) in want
    assert jobs.judged(df.limit(0), "job", "n", "t", "state", RULES).count() == 0


def test_streams_over_several_batches_and_a_restart(spark, tmp_path):
    from covara.plans.streams import _rocksdb
    from covara.streaming.streams import run_available

    r = random.Random(3)
    events = [(r.randint(1, 5), i, 1000 + 7 * i, r.choice(["queued", "running", "complete", "failed"])) for i in range(120)]
    df = spark.createDataFrame(events, "job bigint, n bigint, s bigint, state string").selectExpr("job", "n", "state", "timestamp_seconds(s) t")
    for i in range(3):  # each batch later than the one before
        df.filter(F.col("n").between(40 * i, 40 * i + 39)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        with _rocksdb(spark):
            run_available(jobs.judged_stream(stream, "job", "n", "t", "state", RULES), str(tmp_path / "c"), lambda x, n: x.write.mode("append").parquet(str(tmp_path / "out")))
    want = sorted(map(str, map(tuple, jobs.judged(df, "job", "n", "t", "state", RULES).collect())))
    assert sorted(map(str, map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))) == want
