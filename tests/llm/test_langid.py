import numpy as np

from covara.llm import langid as g


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    found = g.op5_language_id(spark, d)
    lang = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang")
    rows = found.join(lang, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == lang.count() and len(held) > 200
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)


def test_windows_cover_whole_texts():
    sizes = [0, 1, g.WINDOW, g.WINDOW + 1, 1000]
    data = np.concatenate([np.arange(s) % 250 + 1 for s in sizes]).astype(np.uint8)
    at = np.concatenate([[0], np.cumsum(sizes)])
    x, of = g.windows_of(data, at)
    assert np.bincount(of, minlength=5).tolist() == [0, 1, 1, 2, 6]
    assert (x[of == 1][0] == [1] + [0] * (g.WINDOW - 1)).all()
    long = x[of == 4]
    assert (np.concatenate([long[:-1].ravel()[: 1000 - g.WINDOW], long[-1]]) == data[-1000:]).all()


def test_gradients():
    """The loss falls on two languages that differ only in one pair of bytes."""
    r = np.random.default_rng(2)
    y = r.integers(0, 2, 400)
    x = r.integers(97, 123, (400, g.WINDOW)).astype(np.uint8)
    x[y == 1, 50:52] = (200, 201)
    net = g.train(x, y, ["a", "b"], 300)
    assert (net.probabilities(x).argmax(1) == y).mean() > 0.97


def test_sample_is_the_least_hashes(spark, monkeypatch):
    """The ranked part of the hashes holds the whole sample."""
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('text ', id) as text", "if(id % 4 = 0, 'a', 'b') as lang")
    seen = []
    monkeypatch.setattr(g, "train", lambda x, y, languages, steps: seen.append({bytes(w).rstrip(b"\0") for w in x}))
    g.fit(docs, texts=50)
    ranked = docs.selectExpr("text", "row_number() over (partition by lang order by xxhash64(doc_id, 7)) as n").filter("n <= 50").collect()
    assert seen[0] == {r["text"].encode() for r in ranked}


def test_edges(spark, edges, empty):
    texts = [("en", "the weather this morning was bright and the walk was long"), ("de", "das Wetter heute Morgen war schön und der Weg war lang")]
    docs = spark.createDataFrame([(i, t, x) for i, (x, t) in enumerate(texts * 4)], "doc_id long, text string, lang string")
    net = g.fit(docs, steps=60)
    assert net.languages == ["de", "en"]
    rows = g.identify(edges.selectExpr("*", "false held_out"), net).collect()
    assert len(rows) == edges.count()
    assert {r.lang_pred for r in rows if r.doc_id in (0, 1, 2)} == {"und"} and {r.score for r in rows if r.doc_id in (0, 1, 2)} == {0.0}
    assert g.fit(empty) is None
    assert {r.lang_pred for r in g.identify(edges.selectExpr("*", "true held_out"), None).collect()} == {"und"}
    assert g.identify(empty.selectExpr("*", "true held_out"), net).count() == 0


def test_strips_of_windows_give_the_same_rows():
    """Every window holds the bytes of its place, and windows cover each text."""
    texts = [b"", b"abc", bytes(range(256)) * 5, b"x" * g.WINDOW, b"y" * (g.WINDOW + 1)]
    data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    rows, of = g.windows_of(data, at)
    start, _ = g.window_places(at)
    for row, k, s in zip(rows, of, start):
        own = data[s : min(s + g.WINDOW, at[k + 1])].tobytes()
        assert row.tobytes() == own.ljust(g.WINDOW, b"\0") and at[k] <= s
    for k, t in enumerate(texts):
        covered = set().union(*(range(s, min(s + g.WINDOW, at[k + 1])) for s, o in zip(start, of) if o == k)) if t else set()
        assert covered == set(range(at[k], at[k + 1]))
