import random
import re

import pytest
from cohortveil.llm import decontaminate as D
from tests.llm.conftest import words


def split(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def least_distance(item, text):
    """Least edit distance of an item to any stretch of a text, in words."""
    line = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(line[j - 1] + (t != w), line[j] + 1, new[j - 1] + 1))
        line = new
    return min(line)


def edited(rng, item, edits):
    out = list(item)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out[at] = "zz" + words(rng, 1)[0]
        elif kind == 1:
            out.insert(at, "zz" + words(rng, 1)[0])
        else:
            del out[at]
    return out


def test_edited_items_are_found_and_nothing_else(spark):
    rng = random.Random(9)
    items = [words(rng, rng.randrange(12, 70), rng.randrange(3, 8)) for _ in range(40)]
    docs, want = [], {}
    for d in range(240):
        text = words(rng, rng.randrange(20, 300))
        if d % 2:
            i = rng.randrange(40)
            piece = edited(rng, items[i], rng.randrange(int(0.3 * len(items[i])) + 1))
            at = rng.randrange(len(text))
            text[at:at] = piece
        docs.append((d, " ".join(text)))
        for i, item in enumerate(items):
            distance = least_distance(item, text)
            if distance <= int(0.2 * len(item)):
                want[d, i] = distance
    documents = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    rows = D.find(documents, bench).collect()
    got = {(r.doc_id, r.item_id): r.distance for r in rows}
    assert set(got) <= set(want) and len(got) >= 0.99 * len(want)
    assert all(got[k] >= want[k] for k in got) and sum(got[k] == want[k] for k in got) >= 0.97 * len(got)
    texts = dict(docs)
    for r in rows:  # spans are code points and align with the reported distance
        piece = split(texts[r.doc_id][r.start:r.start + r.length])
        item = items[r.item_id]
        assert least_distance(item, piece) == r.distance and abs(len(piece) - len(item)) <= r.distance
    kept = {r.doc_id for r in D.clean(documents, bench).collect()}
    assert kept == set(texts) - {k[0] for k in got}


def test_every_length_of_items_aims_at_the_target():
    rng = random.Random(12)
    shared = words(rng, 200)
    items = [words(rng, rng.randrange(10, 60)) for _ in range(150)] + [shared + words(rng, 200) for _ in range(6)]
    texts = [(i, " ".join(words(rng, 5) + edited(rng, items[i], int(0.2 * len(items[i]))) + words(rng, 5)))
             for i in range(150, 156) for _ in range(30)]
    with pytest.warns(UserWarning, match="256 to 511 words"):
        index = D.build_index([" ".join(x) for x in items])
    assert all(r >= D.TARGET_RECALL for c, r in index.recall.items() if c < 256) and index.repeats[256] == D.MOST_REPEATS
    met = {(int(t), int(i)) for t, i, _ in zip(*D.candidates(D.Words([t for _, t in texts]), index))}
    share = sum((k, i) in met for k, (i, _) in enumerate(texts)) / len(texts)
    assert share >= 0.93 and abs(share - index.recall[256]) <= 0.04


def test_a_missed_target_is_warned_of(monkeypatch):
    monkeypatch.setattr(D, "MOST_REPEATS", 1)
    with pytest.warns(UserWarning, match="short of"):
        index = D.build_index([" ".join(words(random.Random(1), 300))])
    assert index.recall[256] < D.TARGET_RECALL


def test_exact_passages_of_the_tables_all_found(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in D.find(docs, bench).where("distance = 0").collect()}
    texts = [(r.doc_id, " " + " ".join(split(r.text)) + " ") for r in docs.collect()]
    want = {(d, r.item_id) for r in bench.collect() for d, t in texts if f" {' '.join(split(r.text))} " in t}
    assert got == want and want


def test_several_passes_give_the_same(spark, sf, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    once = sorted(map(tuple, D.find(docs, bench).collect()))
    monkeypatch.setattr(D, "ITEMS_PER_PASS", 15)
    assert sorted(map(tuple, D.find(docs, bench).collect())) == once


def test_odd_documents_items_and_none(spark, odd_documents, no_documents):
    items = spark.createDataFrame([(1, "one two"), (2, None), (3, ""), (4, "%%%"), (None, "text in two rows of different ids"),
                                   (6, "text in two rows of different ids"), (7, "cat")], "item_id long, text string")
    rows = sorted((str(r.doc_id), str(r.item_id), r.distance) for r in D.find(odd_documents, items).collect())
    assert rows == sorted([("6", "1", 0)] * 2 + [(d, i, 0) for d in "89" for i in ("None", "6")] + [("1", "7", 0)])
    kept = D.clean(odd_documents, items)
    assert kept.columns == odd_documents.columns and kept.count() == 6
    assert D.find(no_documents, items).count() == 0 and D.find(odd_documents, items.limit(0)).count() == 0
    assert D.clean(odd_documents, items.limit(0)).count() == 11
