import random

import numpy as np
import xxhash

from cohortveil.llm import queries as Q
from cohortveil.llm import simhash as S
from tests.llm.conftest import DOCS, words

SPACE = " \t\n\x0b\x0c\r"


def brute_code(text):
    w, at = [], ""
    for c in (text or "") + " ":
        if c in SPACE:
            w += [at] if at else []
            at = ""
        else:
            at += chr(ord(c) + 32) if "A" <= c <= "Z" else c
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(codes):
    """{code: least code reachable} over all pairs."""
    codes = sorted(set(codes))
    label = {c: c for c in codes}

    def find(c):
        while label[c] != c:
            c = label[c]
        return c

    for i, a in enumerate(codes):
        for b in codes[:i]:
            if (a ^ b).bit_count() <= 3:
                x, y = sorted((find(a), find(b)))
                label[y] = x
    return {c: find(c) for c in codes}


def brute(rows):
    codes = [brute_code(t) for _, t in rows]
    root = brute_components(codes)
    least = {}
    for (i, _), c in zip(rows, codes):
        if i is not None:
            least[root[c]] = min(i, least.get(root[c], i))
    return sorted(((i, f"{c:016x}", least.get(root[c])) for (i, _), c in zip(rows, codes)), key=str)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=str)


def near_codes(rng, n):
    """Clusters of codes a few bits apart, chains, and codes alone."""
    out = []
    while len(out) < n:
        c = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 5, 40])):
            out.append(c)
            for _ in range(rng.randrange(0, 6)):
                c ^= 1 << rng.randrange(64)
    return sorted(set(out))


def spark_components(spark, codes):
    frame = spark.createDataFrame([(S._signed(c),) for c in codes], "code long")
    edges = [(r.a % 2 ** 64, r.b % 2 ** 64) for r in S.links(frame).collect()]
    assert all((a in set(codes)) and (b in set(codes)) for a, b in edges)
    at = {c: k for k, c in enumerate(sorted(codes))}
    label = S.least_linked(len(at), np.array([at[a] for a, _ in edges], int), np.array([at[b] for _, b in edges], int))
    low = sorted(codes)
    return {c: low[label[k]] for c, k in at.items()}


def test_links_equal_all_pairs_at_every_level(spark, monkeypatch):
    rng = random.Random(5)
    codes = near_codes(rng, 500)
    # one key holds very many: they share the upper half of their bits
    codes = sorted({*codes, *(rng.getrandbits(14) | 0xABCDEF0 << 32 for _ in range(300)), 0, 2 ** 64 - 1, 7})
    want = brute_components(codes)
    assert 10 < len(set(want.values())) < len(codes)
    assert spark_components(spark, codes) == want
    monkeypatch.setattr(S, "LIMIT", 512)  # the last level holds at most 2^9
    assert len(S._levels()) == 3
    held = S._levels()
    monkeypatch.setattr(S, "_levels", lambda: held)
    monkeypatch.setattr(S, "LIMIT", 3)  # nearly every group is keyed again
    assert spark_components(spark, codes) == want


def test_every_near_pair_shares_a_key():
    rng = random.Random(8)
    for masks in (S.block_masks(), S.block_masks(0xFFFF00000000FFFF)):
        assert len(masks) == 20
        covered = 0 if masks[0] != masks[0] | 0xFFFF00000000FFFF else 0xFFFF00000000FFFF
        free = [k for k in range(64) if not covered >> k & 1]
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for k in rng.sample(free, 3):
                b ^= 1 << k
            assert any(a & m == b & m for m in masks)


def test_query_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert got(Q.QUERIES["op13_simhash"](spark, sf)) == brute([(d.doc_id, d.text) for d in docs])


def test_near_copies_and_odd_texts(spark):
    rng = random.Random(4)
    base = words(rng, 400)
    rows = []
    for k in range(60):
        text = base[:]
        for _ in range(rng.randrange(4)):
            text[rng.randrange(len(text))] = words(rng, 1)[0]
        rows.append((k, " ".join(text)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, "One TWO"), (104, "one two"), (105, "Ünö"), (106, "ÜNÖ"), (None, "one two"),
             (None, "x y z w"), (103, "One TWO"), (None, None), (107, "a b"), (108, "%%% ###")]
    docs = spark.createDataFrame([(a, b, None, None, None) for a, b in rows], DOCS).repartition(3)
    assert got(S.near_duplicates(docs)) == brute(rows)
    kept = {r.doc_id: r.component_id for r in S.near_duplicates(docs).collect()}
    assert kept[101] == kept[102] == 100 and kept[104] == 103 and kept[105] != kept[106]


def test_odd_documents_and_none(odd_documents, no_documents):
    rows = [(r.doc_id, r.text) for r in odd_documents.collect()]
    assert got(S.near_duplicates(odd_documents)) == brute(rows)
    assert S.near_duplicates(no_documents).count() == 0


def test_hash_is_that_of_sql(spark):
    """XXH64 with seed 42 is also Spark's own xxhash64."""
    row = spark.sql("select xxhash64('some three words') as h").first()
    assert row.h % 2 ** 64 == S.fingerprint(b"Some  three\nWORDS")
