"""SimHash near-duplicates, joined on pigeonhole blocks.

A text's fingerprint has a bit set where more than half of the hashes of its 3-word
shingles have it.  Two fingerprints that differ in at most three bits touch at most
three of six segments, so they agree on three whole ones: every fingerprint gets a
key for each of the twenty triples of segments, and only fingerprints under one
key are compared, bit by bit.

Equal fingerprints are one member from the start.  A key with more than ``LIMIT``
members is not compared as a whole: its free bits are split into six segments once
more, and again after that, where at most 2^9 members can share a key.  So no
group is unbounded, no pair becomes a row (each group returns a spanning forest of its
links), and nothing is left out.

Edge cases: words are runs of bytes other than blank, tab, newline, vertical tab,
form feed and carriage return; only A to Z are folded.  A text of one or two words has
one shingle of all of them.  Null, empty and wordless texts have fingerprint zero, which
links like any other.  Repeated rows come out as often as they came in.  Null ids are
kept; a component is named by its least id that is not null, or null if it has none.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .components import components

#: Words of a shingle, seed of its hash, bits of a fingerprint, and differing bits of a link.
WIDTH, SEED, BITS, APART = 3, 42, 64, 3
#: Segments of the free bits; the keys are all choices of ``SEGMENTS - APART`` of them.
SEGMENTS = 6
#: Members of a key that are compared in one task; more are keyed again by their free bits.
LIMIT = 1024
#: Hashes whose bits are spread out at a time.
SLAB = 1 << 17


def fingerprint(text: bytes) -> int:
    """Fingerprint of a text as an unsigned number."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < WIDTH:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[k:] for k in range(WIDTH))))
    hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles], np.uint64)
    counts = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), SLAB):
        bits = np.unpackbits(hashes[a:a + SLAB].astype("<u8").view(np.uint8), bitorder="little")
        counts += bits.reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(2 * counts > len(hashes)).tolist())


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, code): every document's fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = np.array([fingerprint(t or b"") for t in batch.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes)], names=["id", "code"])

    schema = T.StructType([T.StructField("id", documents.schema[id_col].dataType), T.StructField("code", T.LongType())])
    return documents.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("binary")).mapInArrow(run, schema)


def block_masks(covered: int = 0) -> list[int]:
    """Bits of every key over the bits outside ``covered``, together with those."""
    free = [k for k in range(BITS) if not covered >> k & 1]
    segments = [sum(1 << int(k) for k in part) for part in np.array_split(free, SEGMENTS)]
    return [covered | sum(chosen) for chosen in combinations(segments, SEGMENTS - APART)]


def _signed(number: int) -> int:
    return number - (1 << BITS) if number >> (BITS - 1) else number


def _levels() -> list[list[int]]:
    """Masks of the keys at each level: 20, then 20 for each of those, and so on until ``LIMIT`` holds."""
    levels = [block_masks()]
    while max(BITS - m.bit_count() for m in levels[-1]) > LIMIT.bit_length() - 1:
        levels.append([m for covered in levels[-1] for m in block_masks(covered)])
    return levels


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n members over the links (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == before).all():
            break
    return label


def forest(codes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (code, least code) that tie together the members of each group within ``APART`` bits.

    Rows of a group are next to each other; row i is compared with row i + k for all k in turn.
    """
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, k = np.arange(len(codes)), 1
    while len(at):
        at = at[at + k < len(codes)]
        at = at[group[at] == group[at + k]]
        near = at[np.bitwise_count(codes[at] ^ codes[at + k]) <= APART]
        one.append(near)
        two.append(near + k)
        k += 1
    label = least_linked(len(codes), np.concatenate(one), np.concatenate(two))
    tied = np.flatnonzero(label != np.arange(len(codes)))
    return codes[tied], codes[label[tied]]


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of every key's members; about a million members are held at a time."""
    for batch in batches:
        lists = batch.column(0)
        sizes = np.diff(np.asarray(lists.offsets))
        codes = np.asarray(lists.flatten()).astype(np.int64).view(np.uint64)
        group = np.repeat(np.arange(len(sizes)), sizes)
        a, b = forest(codes, group)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def links(codes: DataFrame) -> DataFrame:
    """(a, b): links that join exactly the distinct ``code`` values within ``APART`` bits of each other into components."""
    levels, found = _levels(), None
    first = F.array(*(F.lit(_signed(m)) for m in levels[0]))
    masked = codes.select("code", F.posexplode(first).alias("key", "mask"))
    for depth, masks in enumerate(levels):
        if depth:
            # a fixed number of masks: 400, then 8000
            table = codes.sparkSession.createDataFrame(
                [(k // len(levels[0]), k, _signed(m)) for k, m in enumerate(masks)], "path int, key int, mask long")
            masked = rows.join(F.broadcast(table), "path")
        keyed = masked.select("code", "key", F.col("code").bitwiseAND(F.col("mask")).alias("value"))
        if depth == len(levels) - 1:
            groups = keyed.groupBy("key", "value").agg(F.collect_list("code").alias("codes")).where(F.size("codes") > 1)
            big = None
        else:
            counts = cut(keyed.groupBy("key", "value").agg(F.count("*").alias("n")).where("n > 1"))
            small, big = counts.where(F.col("n") <= LIMIT), counts.where(F.col("n") > LIMIT)
            groups = keyed.join(small.drop("n"), ["key", "value"]).groupBy("key", "value").agg(F.collect_list("code").alias("codes"))
        own = groups.select("codes").mapInArrow(_compare, "a long, b long")
        found = own if found is None else found.union(own)
        if big is None or big.isEmpty():
            break
        rows = keyed.join(big.drop("n"), ["key", "value"]).select("code", F.col("key").alias("path"))
    return found.distinct()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, fingerprint (16 hexadecimal digits) and component id."""
    docs = cut(fingerprints(documents, id_col, text_col))
    members = cut(docs.groupBy("code").agg(F.min("id").alias("first")))
    tied = components(links(members))
    named = members.join(tied, members.code == tied.node, "left").select(
        "code", "first", F.coalesce("label", "code").alias("label"))
    least = named.groupBy("label").agg(F.min("first").alias("component_id"))
    # one label or code may stand for very many rows: only minima meet, and joins may be split
    return docs.join(named.join(least, "label").select("code", "component_id"), "code").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
