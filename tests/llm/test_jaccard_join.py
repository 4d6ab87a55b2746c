import random
import re

import numpy as np

from cohortveil.llm import jaccard_join as J
from cohortveil.llm.components import components
from tests.llm.conftest import DOCS, words


def shingles(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """{id: (class, links)} by comparing all pairs."""
    ids = [r[0] for r in rows]
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if (a or b) and len(a & b) / len(a | b) >= 0.8 or not a and not b and (rows[i][1] or "") == (rows[j][1] or ""):
                links[i] += 1
                links[j] += 1
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(ids[i])
    return {ids[i]: (min(groups[find(i)]), links[i]) for i in range(len(rows))}


def near_rows():
    rng = random.Random(3)
    base = words(rng, 120)
    rows, n = [], 0
    for k in range(60):  # one group of near copies, many pairs around the threshold
        text = base[:]
        for _ in range(rng.randrange(6)):
            text[rng.randrange(len(text))] = words(rng, 1)[0]
        rows.append((n, " ".join(text)))
        n += 1
    for _ in range(30):
        own = " ".join(words(rng, rng.randrange(1, 80)))
        for _ in range(rng.choice([1, 1, 2, 3])):
            rows.append((n, own if rng.random() < 0.5 else own.upper() + "!"))
            n += 1
    return rows + [(n, ""), (n + 1, ""), (n + 2, "%%"), (n + 3, None), (n + 4, "##")]


def got(df):
    return {r.doc_id: (r.class_id, r.links) for r in df.collect()}


def test_links_and_classes_equal_brute_force(spark, monkeypatch):
    rows = near_rows()
    docs = spark.createDataFrame([(a, b, None, None, None) for a, b in rows], DOCS)
    assert got(J.near_duplicates(docs)) == brute(rows)
    monkeypatch.setattr(J, "BLOCK", 16)  # the large group in several blocks
    assert got(J.near_duplicates(docs)) == brute(rows)


def test_whole_table_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert got(J.near_duplicates(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_linked_pairs_across_slabs_and_sides():
    rng = np.random.default_rng(1)
    pool = np.sort(rng.integers(0, 2 ** 62, 9000).astype(np.uint64))
    sets = [np.unique(rng.choice(pool, 8000, replace=False)) for _ in range(6)] + [pool[:5], pool[:4]]
    want = {(i, j) for i in range(8) for j in range(i + 1, 8)
            if len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j])) >= 0.8}
    assert want and set(zip(*map(list, J.linked_pairs(sets, 0, 0.8)))) == want
    assert set(zip(*map(list, J.linked_pairs(sets, 3, 0.8)))) == {(i, j) for i, j in want if i < 3 <= j}


def test_recall_decides_the_prefix():
    assert J.prefix_recall(0.8, J.prefix_depth()) >= J.TARGET_RECALL > J.prefix_recall(0.8, J.prefix_depth() + 1)
    assert J.prefix_depth(0.8, 0.5) > J.prefix_depth(0.8, 0.9999)


def test_odd_documents_and_none(odd_documents, no_documents):
    found = {}
    for r in J.near_duplicates(odd_documents).collect():
        found.setdefault(r.doc_id, []).append((r.class_id, r.links, r.copies))
    assert found[6] == [(6, 1, 2)] * 2 and found[8] == [(8, 1, 2)] and found[9] == [(8, 1, 2)]
    assert found[2] == [(2, 1, 2)] and found[3] == [(2, 1, 2)] and found[4] == [(4, 0, 1)] and found[None] == [(None, 0, 1)]
    kept = J.keep_one(odd_documents)
    assert kept.columns == odd_documents.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 4, 5, 6, 7, 8]
    assert J.near_duplicates(no_documents).count() == 0 and J.keep_one(no_documents).count() == 0


def test_one_row_of_every_class_stays_with_null_and_repeated_ids(spark):
    rng = random.Random(9)
    texts = [" ".join(words(rng, 40)) for _ in range(9)]
    near = texts[0].rsplit(" ", 1)[0] + " other"
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (1, near),  # a null id in the class of 1
            (4, texts[3]), (4, texts[4]), (4, texts[5] + "!"), (5, texts[5]), (6, texts[6]), (6, texts[6]),
            (None, ""), (None, None), (None, "%%"), (7, "%%")]
    docs = spark.createDataFrame([(a, b, None, None, None) for a, b in rows], DOCS).repartition(3)
    kept = sorted(((r.doc_id, r.text or "") for r in J.keep_one(docs).collect()), key=str)
    assert kept == sorted([(1, near), (None, texts[1]), (None, texts[2]), (4, texts[3]), (4, texts[4]), (4, texts[5] + "!"),
                           (6, texts[6]), (None, ""), (7, "%%")], key=str)
    found = J.near_duplicates(docs).collect()
    assert len(found) == len(rows) and len({r.class_key for r in found}) == len(kept)
    assert sorted((r.links, r.copies) for r in found if r.class_id is None) == [(0, 1)] + [(1, 2)] * 4


def test_components_of_long_chains(spark):
    chain = [(f"{i:04d}", f"{i + 1:04d}") for i in range(0, 60)] + [("a", "b"), ("c", "b"), ("z", "z"), (None, "q")]
    out = {r.node: r.label for r in components(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert set(out.values()) == {"0000", "a"} and len(out) == 64


def test_columns_of_any_type_are_kept(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text, {"a": 1}), (1, text, {"a": 1}), (2, text.upper(), {"b": 2}), (3, "other words", None)],
                                 "doc_id long, text string, tags map<string, int>")
    assert sorted((r.doc_id, str(r.tags)) for r in J.keep_one(docs).collect()) == [(1, "{'a': 1}"), (3, "None")]
