import hashlib
import re

from cohortveil.llm import spot_signatures as S
from pyspark.sql import functions as F
from tests.llm.conftest import DOCS


def chains(text):
    """Signatures of a text by plain loops, as tuples."""
    anchors = set(S.ANCHORS)
    out, lead, content = set(), [], []
    for w in re.findall(r"[^\W_]+", (text or "").lower()):
        if w in anchors:
            lead.append(w)
        else:
            content.append((tuple(lead), w))
            lead = []
    if lead:  # anchors at the end: the last stands as a word of its own
        content.append((tuple(lead[:-1]), lead[-1]))
    for i, (lead, w) in enumerate(content):
        if lead:
            out.add((lead, w, *(x for _, x in content[i + 1:i + S.CHAIN])))
    return out


def jaccard(a, b):
    return len(a & b) / len(a | b)


def edited(texts, i):
    n, other = len(texts[i]), texts[(i + 1) % len(texts)]
    return texts[i][:n - n // 2] + other[:n // 2]


def test_digest_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    rows = sorted(S.edited_fingerprints(docs).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in rows] == list(range(200))
    seen = {}
    for i, r in enumerate(rows):
        change, other = edited(texts, i), texts[(i + 1) % 200]
        assert r.n_chars == len(texts[i]) and r.edited_sha256 == hashlib.sha256(change.encode()).hexdigest()
        a, b, c = chains(texts[i]), chains(change), chains(other)
        if a and b:
            assert abs(r.near_edited - jaccard(a, b)) < 1e-12
        if a and c:
            assert abs(r.near_next - jaccard(a, c)) < 1e-12
        assert seen.setdefault(texts[i], r.fingerprint) == r.fingerprint and len(r.fingerprint) == S.DIGITS * max(1, len(a))


def test_signatures_of_special_texts(spark):
    texts = ["", None, "%%% ###", "%%%", "word", "the", "the of", "the house of the big dog", "THE House, of the: big dog!",
             "no anchors here"[3:], "a\0b", "l'été de la mer~x"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select(
        "i", S.signatures(F.col("text")).alias("s"), S.fingerprint(S.signatures(F.col("text"))).alias("f")).orderBy("i").collect()
    sets = [tuple(r.s) for r in rows]
    assert all(sets) and sets[0] == sets[1] and len({*sets[1:6]}) == 5 and sets[7] == sets[8]
    assert len(sets[7]) == len(chains(texts[7])) == 2


def runs(text):
    w = re.findall(r"[^\W_]+", text.lower())
    return {tuple(w[i:i + S.CHAIN]) for i in range(len(w) - S.CHAIN + 1)}


def test_texts_without_anchors_count_whole(spark):
    head = "alpha beta gamma "
    texts = [head + " ".join(f"k{i}x" for i in range(90)), head + " ".join(f"k{i}x" for i in range(60)) + " other end", "two words"]
    rows = sorted(S.edited_fingerprints(spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS)).collect())
    for i in range(2):
        assert not chains(texts[i]) and not chains(edited(texts, i))
        assert abs(rows[i].near_edited - jaccard(runs(texts[i]), runs(edited(texts, i)))) < 1e-12 and rows[i].near_edited < 1
    assert abs(rows[0].near_next - jaccard(runs(texts[0]), runs(texts[1]))) < 1e-12
    assert rows[0].fingerprint != rows[1].fingerprint and rows[1].near_next == 0


def test_similar_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(8)
    sets, n = [], 0
    for _ in range(12):
        base = rng.sample(range(100_000), rng.randrange(3, 60))
        for _ in range(6):
            own = [x for x in base if rng.random() > 0.06] + rng.sample(range(100_000), rng.randrange(3))
            sets.append((n, sorted(set(own) or {1})))
            n += 1
    frame = spark.createDataFrame(sets, "member long, signatures array<long>")
    got = {(r.a, r.b) if r.a < r.b else (r.b, r.a): r.similarity for r in S.similar_pairs(frame).collect()}
    first = {}
    for m, s in sets:
        first.setdefault(tuple(s), m)
    want = {(a, b): jaccard(set(x), set(y)) for x, a in first.items() for y, b in first.items()
            if a < b and jaccard(set(x), set(y)) >= 0.8}
    assert want and got == want
    assert {(r.member, r.first) for r in S.classes(frame).collect()} == {(m, first[tuple(s)]) for m, s in sets}


def test_odd_documents_and_none(odd_documents, no_documents):
    rows = S.edited_fingerprints(odd_documents).collect()
    assert len(rows) == 11 and sum(r.doc_id == 6 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    by = {r.doc_id: r for r in rows}
    assert by[2].n_chars == by[3].n_chars == 0 and by[2].fingerprint == by[3].fingerprint and by[2].near_next == 1.0
    # after the last comes the first
    assert by[None].edited_sha256 == hashlib.sha256(("id is null here"[:8] + "The cat"[:7]).encode()).hexdigest()
    assert S.edited_fingerprints(no_documents).count() == 0


def test_one_document_follows_itself(spark):
    row, = S.edited_fingerprints(spark.createDataFrame([(1, "The cat and the dog", "en", "a", 1)], DOCS)).collect()
    assert row.near_next == 1.0 and row.edited_sha256 == hashlib.sha256(b"The cat anThe cat a").hexdigest()


def test_marks_in_texts_are_no_anchors(spark):
    texts = ["alpha~beta gamma delta", "alpha beta gamma delta", "alpha\u0001beta gamma delta", "the~alpha beta gamma", "the alpha beta gamma"]
    sets = [tuple(r.s) for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").select(
        "i", S.signatures(F.col("text")).alias("s")).orderBy("i").collect()]
    assert sets[0] == sets[1] == sets[2] and len(sets[0]) == 2 and sets[3] == sets[4] and len(sets[3]) == 1


def test_every_text_meets_the_next_one_across_ranges(spark):
    texts = {k: f"the word{k} of the end{k} " * (1 + k % 3) for k in range(97)}
    rows = [(k, t, "en", "a", 1) for k, t in texts.items()] + [(5, texts[5], "en", "b", 2)] * 2
    got = sorted((r.doc_id, r.edited_sha256) for r in S.edited_fingerprints(spark.createDataFrame(rows, DOCS).repartition(5)).collect())
    want = [(k, hashlib.sha256((t[:len(t) - len(t) // 2] + texts[(k + 1) % 97][:len(t) // 2]).encode()).hexdigest()) for k, t in texts.items()]
    assert got == sorted(want + [want[5]] * 2)
