import hashlib
import random
import re
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from cohortveil.llm import queries as Q
from cohortveil.llm import word_runs as R
from tests.llm.conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w, least=12):
    """{(start, length, period)}: every period extended as far as it goes, smallest period kept."""
    found = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, 2 * p):
                found.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in found.items())


def collapsed(w, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def edited(doc_id, w):
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if doc_id is None or h % 10 or not n:
        return w
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def as_set(w, least=12):
    out = R.runs_of(R.symbols_of([[x.encode() for x in w]]), least)
    return list(zip(*(c.tolist() for c in out)))


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70), st.sampled_from([2, 3, 7, 12, 25]))
def test_runs_equal_brute_force(letters, least):
    w = ["abc"[k] for k in letters]
    assert as_set(w, least) == brute(w, least)


def test_periodic_and_nested_texts():
    rng = random.Random(2)
    one, two = ["a"], ["a", "b"]
    for _ in range(9):
        one, two = two, two + one
    cases = [["x"] * 50, ["x"] * 11, ["x"] * 12, ["a", "b"] * 30 + ["c"], two, words(rng, 40) * 3, list("abcabcabcabx" * 4)]
    for _ in range(60):
        w = []
        while len(w) < 120:
            w += words(rng, rng.randrange(1, 6), 1) * rng.randrange(1, 6)
        cases.append(w)
    for w in cases:
        assert as_set(w) == brute(w), w


def test_texts_of_one_batch_do_not_meet(monkeypatch):
    rng = random.Random(3)
    texts = [words(rng, 3, 1) * rng.randrange(1, 9) for _ in range(40)] + [[], ["x"] * 30, ["x"] * 30]
    for slab in (1 << 20, 7):
        monkeypatch.setattr(R, "SLAB", slab)
        start, length, period = R.runs_of(R.symbols_of([[x.encode() for x in w] for w in texts]))
        base, want = 0, []
        for w in texts:
            want += [(base + s, n, p) for s, n, p in brute(w)]
            base += len(w) + 1
        assert list(zip(start.tolist(), length.tolist(), period.tolist())) == sorted(want)
    assert R.least_depth(12) == 4 and R.least_depth(2) == 1 and len(R.runs_of(np.zeros(0, np.int64))[0]) == 0


def test_a_long_periodic_text_takes_few_steps():
    n = 200_000
    assert as_set(["x"] * n) == [(0, n, 1)]
    rng = random.Random(4)
    w = words(rng, 5000) * 21
    assert as_set(w) == [(0, len(w), 5000)]


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: r for r in Q.QUERIES["op11_word_runs"](spark, sf).collect()}
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        w = edited(d.doc_id, WORD.findall(d.text or ""))
        runs = brute(w) if len(w) < 3000 else None
        r = got[d.doc_id]
        if runs is None:
            continue
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2])) if runs else (None, None, None)
        some += bool(runs)
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        lines = "".join(f"{s},{n},{p}\n" for s, n, p in runs)
        assert r.runs_sha256 == hashlib.sha256(lines.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(w, runs).encode()).hexdigest()
    assert some > 10


def test_odd_documents_and_none(spark, odd_documents, no_documents):
    rows = R.periodic_runs(odd_documents).collect()
    assert len(rows) == 11 and all(r.runs == [] for r in rows)
    assert sorted(r.n_words for r in rows if r.doc_id in (2, 3, 4, 6)) == [0, 0, 2, 2, 3]
    assert R.periodic_runs(no_documents).count() == 0
    docs = spark.createDataFrame([(1, "a\u00a0b\u2003c " * 12 + "z"), (None, "q\x0bq\x0c" * 8)], "doc_id long, text string")
    got = {r.doc_id: r for r in R.periodic_runs(docs).collect()}
    assert [tuple(x) for x in got[1].runs] == [(0, 12, 1)] and got[1].collapsed == "a\u00a0b\u2003c z"
    assert [tuple(x) for x in got[None].runs] == [(0, 16, 1)] and got[None].collapsed == "q"


def test_the_tail_of_a_tenth_becomes_periodic(spark):
    rng = random.Random(6)
    rows = [(k, " ".join(words(rng, rng.randrange(1, 60)))) for k in range(300)] + [(7, None), (8, " \t"), (None, "a b")]
    out = spark.createDataFrame(rows, "doc_id long, text string").select(
        "doc_id", "text", Q.repeated_words(Q.F.col("text"), Q.F.col("doc_id")).alias("e")).collect()
    for r in out:
        assert WORD.findall(r.e or "") == edited(r.doc_id, WORD.findall(r.text or ""))
    assert sum(r.e != r.text for r in out) > 10
