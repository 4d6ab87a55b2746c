import bisect
import random
import struct
import zlib

import numpy as np
import pytest

from cohortveil.llm import packing as P


def best_fit_decreasing(sizes, capacity):
    gaps, opened = [], 0
    for size in sorted(sizes, reverse=True):
        at = bisect.bisect_left(gaps, size)
        if at < len(gaps):
            gap = gaps.pop(at)
        else:
            gap, opened = capacity, opened + 1
        bisect.insort(gaps, gap - size)
    return opened


@pytest.mark.parametrize("seed", range(6))
def test_plan_is_gapless_and_as_tight_as_best_fit_decreasing(seed):
    rng = np.random.default_rng(seed)
    capacity = [64, 64, 1024, 1024, 10, 1][seed]
    sizes = [rng.integers(1, 65, 900), rng.integers(1, 5, 900), rng.integers(1, 1025, 2000), np.full(50, 300),
             rng.integers(1, 11, 300), np.ones(9, int)][seed]
    counts = {int(k): int(v) for k, v in zip(*np.unique(sizes, return_counts=True))}
    plan = P.plan(counts, capacity)
    runs = sorted(zip(plan.length, plan.first, plan.sequence, plan.offset))
    held = {}
    for (length, first, sequence, offset), after in zip(runs, [*runs[1:], (None, 0, 0, 0)]):
        until = after[1] if after[0] == length else counts[length]
        for rank in range(first, until):
            held.setdefault(sequence + rank - first, []).append((offset, length))
    assert sum(map(len, held.values())) == len(sizes)
    for pieces in held.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= capacity
    assert len(held) == plan.sequences <= best_fit_decreasing(sizes, capacity) + 1


def reference_ids(texts):
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(P.tokenizer_path())
    held.encode_special_tokens = True
    return [e.ids for e in held.encode_batch(texts, add_special_tokens=False)]


def test_ids_equal_those_of_tokenizers(spark):
    rng = random.Random(2)
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    alphabet = list("ab 's'll 12½²٣é中ß\n\t\r  \x1c.,!_-<|endoftext|>  😀é")
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["", " ", "  ", "\n", " \n", "\n ", "a  b", "a \nb", "a\n b", " a", "a ", "<|endoftext|> x", "it's  we'll"]
    path = P.tokenizer_path()
    for text, ids in zip(texts, reference_ids(texts)):
        assert P.token_bytes(text, path) == struct.pack(f"<{len(ids)}I", *ids), repr(text)


def test_added_tokens_in_texts_are_those_of_tokenizers(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    mark = "<|endoftext|>"
    texts = ["a <|endoftext|> b", mark, mark * 3, f" {mark}", f"{mark} ", f"\n{mark}\n\n x  {mark}y", "<|endoftext|", f"<{mark}>", f"é{mark}'s"]
    texts += ["".join(rng.choice([mark, " ", "  ", "\n", "ab", "'ll", "é", "<|", "|>", "12"]) for _ in range(rng.randrange(20)))
              for _ in range(500)]
    held = Tokenizer.from_file(P.tokenizer_path())  # as it is: added tokens in texts are recognised
    want = [e.ids for e in held.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275]
    rows = P.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = want[r.doc_id] + [2]
        assert r.length == len(ids) and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)), texts[r.doc_id]


def test_pieces_and_places_of_the_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = P.pack(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = dict(zip(texts, (x + [2] for x in reference_ids(list(texts.values())))))
    by_document, by_sequence = {}, {}
    for r in rows:
        by_document.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_document) == set(texts)
    for doc, own in by_document.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own)))
        assert all(r.length == 1024 for r in own[1:]) and sum(r.length for r in own) == len(ids[doc])
        at = 0
        for r in own:
            part = ids[doc][at:at + r.length]
            assert r.start == at and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(part)}I", *part))
            at += r.length
    for own in by_sequence.values():
        end = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 1024
    assert len(by_sequence) <= 1.05 * -(-sum(map(len, ids.values())) // 1024)


def test_odd_documents_and_none(odd_documents, no_documents):
    rows = P.pack(odd_documents).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, []).append(r.length)
    assert found[2] == [1] and found[3] == [1] and len(found[6]) == 2 and None in found and len(found[5]) > 10
    assert P.pack(no_documents).count() == 0


def test_only_short_parts_are_remembered():
    """Parts were bounded in number but not in length: a worker held every long one."""
    path = P.tokenizer_path()
    long = "ab" * 5000
    ids = P.token_bytes(f"one {long} word {long}", path)
    assert ids == P._bytes(P._encoding(path).encode_ordinary(f"one {long} word {long}"))
    held = P._memory(path)
    assert "word" in held and long not in held and max(map(len, held)) <= P.LONGEST
