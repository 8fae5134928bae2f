import random

import corpus_pipeline as p
from covara.llm import jaccard, simhash

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingles(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1


def near_copies(seed, bases, copies, shared=0):
    """Random texts and copies of them with some words replaced, so that similarities lie around 0.8; `shared` words open every text."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    head = [word() for _ in range(shared)]
    texts = ["", "   ", "one two", "One  two", "one two three"]
    for _ in range(bases):
        base = head + [word() for _ in range(r.choice([8, 30, 100, 200, 400]))]
        for _ in range(copies):
            own = list(base)
            for _ in range(r.randint(0, max(1, len(own) // 30))):
                own[r.randrange(len(own))] = word()
            texts.append(" ".join(own))
    r.shuffle(texts)
    return texts


def brute_components(texts):
    sets, out = [shingles(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b) and out[i] != out[j]:
                low, high = sorted((out[i], out[j]))
                out = [low if x == high else x for x in out]
    return out


def test_stage_misses_no_pair_of_similarity_0_8(spark, sf):
    texts = near_copies(3, 40, 4)
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(sets)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    close = [(i, j) for i, j in pairs if similarity(sets[i], sets[j]) < 0.95]
    assert len(close) > 20
    want = brute_components(texts)
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA)
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    assert [found[i] for i in range(len(texts))] == want
    assert {r.doc_id for r in p.near_duplicate_stage(spark, df, sf).collect()} == set(want)


def test_large_groups_and_shared_passages(spark, monkeypatch):
    """Groups are larger than LARGE_GROUP, with and without knowledge of frequent shingles."""
    texts = near_copies(5, 12, 12, shared=40)
    want = brute_components(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for often in (10**9, 2):
        monkeypatch.setattr(jaccard, "OFTEN", often)
        monkeypatch.setattr(jaccard, "SAMPLE", 1)
        found = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
        assert [found[i] for i in range(len(texts))] == want


def test_groups_in_blocks(spark, monkeypatch):
    """Star-like groups of near copies of one text, of which most are not near each other; groups are cut into blocks."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(150)]
    texts = [" ".join(base)]
    for _ in range(40):
        own = list(base)
        for _ in range(4):
            own[r.randrange(len(own))] = word()
        texts.append(" ".join(own))
    texts += [" ".join(base[:60] + [word() for _ in range(90)]) for _ in range(20)]
    want = brute_components(texts)
    monkeypatch.setattr(jaccard, "in_blocks", lambda large, f=jaccard.in_blocks: f(large, members=7))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    found = {x.doc_id: x.component_id for x in simhash.near_duplicates(df).collect()}
    assert [found[i] for i in range(len(texts))] == want


def test_fingerprints_give_the_first_pairs(spark):
    """Without the groups by prefixes, texts whose fingerprints are near are found by pivot tables, and only those that are similar enough count."""
    texts, r = near_copies(11, 8, 2), random.Random(12)
    for i in range(10):
        words = [f"w{r.randrange(10**6)}" for _ in range(800)]
        texts += [" ".join(words), " ".join([*words[:300], "other", *words[301:]])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r.fp: r for r in jaccard.describe(df).filter("n > 0").collect()}
    by_text = {r.doc_id: r.fp for r in jaccard.describe(df).collect()}
    pairs = simhash.fingerprint_pairs(jaccard.describe(df)).collect()
    label = {x: x for x in rows}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for r in pairs:
        label[find(r.a)] = find(r.b)
    near = [(x, y) for x in rows for y in rows if x < y and ((rows[x].bits ^ rows[y].bits) & (2**64 - 1)).bit_count() <= simhash.MOST_BITS]
    assert len(near) > 4 and all(find(x) == find(y) for x, y in near)
    none = jaccard._members
    try:
        jaccard._members = lambda dealt, least, all_pairs: spark.createDataFrame([], "key bigint, a bigint, b bigint")
        found = {r.doc_id: r.component_id for r in simhash.near_duplicates(df).collect()}
    finally:
        jaccard._members = none
    sets = {by_text[i]: shingles(t) for i, t in enumerate(texts) if by_text[i]}
    first = {x: min(i for i, y in by_text.items() if y == x) for x in sets}
    linked = [(r.a, r.b) for r in pairs if similarity(sets[r.a], sets[r.b]) >= 0.8]
    assert linked and all(found[first[a]] == found[first[b]] for a, b in linked)
    assert len(set(found.values())) < len(rows)
