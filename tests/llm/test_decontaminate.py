import random
import time

from covara.llm import decontaminate as d

from .conftest import prose


def distance(item, text):
    """Least edit distance of item to any substring, by the plain table."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_myers_matches_the_plain_table():
    r = random.Random(1)
    for _ in range(150):
        item = "".join(r.choice("ab ") for _ in range(r.randint(1, 70)))
        text = "".join(r.choice("ab ") for _ in range(r.randint(0, 120)))
        found = d.best_match(item, text, 10**6)
        assert (found[0] if found else len(item)) == min(distance(item, text), len(item))


def edited(text, n, r):
    out = list(text)
    for _ in range(n):
        i = r.randrange(len(out))
        out[i : i + 1] = r.choice([[], [r.choice("abcde")], [out[i], r.choice("abcde")]])
    return "".join(out)


def test_every_match_within_the_budget_is_found(spark):
    r = random.Random(2)
    items = [(i, d.normalised(prose(100 + i, 25))) for i in range(6)]
    docs = [(i, d.normalised(prose(500 + i, 30)) + " " + (edited(items[i % 6][1], i % 9, r) if i % 3 else "") + " " + d.normalised(prose(700 + i, 30))) for i in range(40)]
    got = {(x.doc_id, x.item_id): x.distance for x in d.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_chars=300).collect()}
    want = {}
    for i, text in docs:
        for k, item in items:
            n = distance(item, d.normalised(text))
            if n <= len(item) // d.CHARS_PER_EDIT:
                want[i, k] = n
    assert got == want and len(want) > 15


def test_real_tables(spark, sf):
    rows = d.op1_decontaminate(spark, sf).collect()
    items = {r.item_id: d.normalised(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    texts = {r.doc_id: d.normalised(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    exact = {(i, k) for i, t in texts.items() for k, item in items.items() if item in t}
    assert exact and exact == {(r.doc_id, r.item_id) for r in rows if r.distance == 0}


def test_short_items_match_whole_words_without_edits(spark):
    docs = spark.createDataFrame([(1, "He said: short answer!"), (2, "a shortanswer"), (3, "short answers"), (4, "Short, answer")], "doc_id long, text string")
    found = d.find_leaks(docs, spark.createDataFrame([(7, "Short answer"), (8, "?!")], "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id, r.distance) for r in found.collect()) == [(1, 7, 0), (4, 7, 0)]


def test_periodic_texts_take_time_in_proportion():
    item = "ab " * 29 + "cd ab ab ab ab ab ab ab ab ab ab ab ab"
    items = [(1, item, len(item) // d.CHARS_PER_EDIT)]
    automaton, text = d._automaton(items), "ab " * 100_000
    began = time.time()
    assert d.matches(text, items, automaton) == {0: (2, *d.matches(text[:600], items, automaton)[0][1:])}
    assert time.time() - began < 20


def test_edges(spark, edges, empty):
    bench = spark.createDataFrame([(1, prose(2, 60)), (1, prose(2, 60)), (2, None), (3, ""), (None, prose(5, 40)), (4, "short")], "item_id long, text string")
    found = d.find_leaks(edges, bench).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(6, 1), (7, 1), (20, 1), (None, None)}
    assert sum(r.doc_id == 20 for r in found) == 4
    assert d.find_leaks(empty, bench).count() == 0
    assert d.find_leaks(edges, bench.filter("false")).count() == 0
