"""Best-fit packing of tokenised documents into sequences of bounded length.

Documents become pieces of at most ``capacity`` tokens.  Pieces are range-sorted
by length and ranked inside each length, so a piece is known by (length, rank) and
a gap by (size, rank): pieces of one length, and gaps of one size, are
interchangeable.  Supersteps then run on these sorted runs: in a sweep every
length proposes to its successor, the smallest gap that holds it; where several
lengths meet at one gap size, ranks decide (longer ones first); won gaps shrink,
and the next superstep begins.  Lengths that have no successor open new sequences.
A superstep exchanges at most ``capacity`` runs, never documents; the rows are
placed once, in parallel, by their ranks.

Edge cases: a null text is an empty one and still has the end token.  Only
documents longer than ``capacity`` are cut: all their pieces but the first are
full.  Very long texts are tokenised whole.  An added token of the file that stands
literally in a text is that one token, as in the library.  Equal texts and repeated rows are
packed once per row (each row's pieces carry its id).  An empty table gives an
empty result.
"""

from __future__ import annotations

import array
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scans import rank_rows
from ..session import cut

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 1024, 2
#: Parts of a text that a worker remembers the ids of, at most, and their longest length.
REMEMBERED, LONGEST = 400_000, 64
# White space other than the plain space and the line feed; next to it, or where two
# meet, a text is not split at its spaces before it is tokenised.
_OTHER_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0  -     　]")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """Byte behind each character of a byte-level vocabulary: printable bytes stand for
    themselves, the others for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def _encoding(path: str):
    """The vocabulary of a byte-level BPE file, run by tiktoken.

    Ids of such a file follow the order of its merges, so they serve as ranks.
    """
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    byte = _byte_of_char()
    held = Tokenizer.from_file(path)
    vocabulary = held.get_vocab(with_added_tokens=False)
    special = {t.content for t in held.get_added_tokens_decoder().values()}
    ranks = {bytes(byte[c] for c in token): i for token, i in vocabulary.items() if token not in special}
    return tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=2)
def _added(path: str) -> tuple[re.Pattern | None, dict[str, int]]:
    """Pattern and ids of the tokens that the file adds to its vocabulary."""
    from tokenizers import Tokenizer

    held = Tokenizer.from_file(path).get_added_tokens_decoder()
    if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in held.values()):
        raise ValueError(f"added tokens of {path} are not plain strings")
    ids = {t.content: i for i, t in held.items()}
    # the longest first: of several that begin at one place the library takes it
    longest = sorted(ids, key=len, reverse=True)
    return re.compile(f"({'|'.join(map(re.escape, longest))})") if ids else None, ids


class _Remembered(dict):
    """Ids, as little-endian bytes, of the parts of a text that follow a space."""

    def __init__(self, encoding):
        super().__init__()
        self.encode = encoding.encode_ordinary

    def __missing__(self, part: str) -> bytes:
        ids = _bytes(self.encode(" " + part))
        if len(part) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[part] = ids
        return ids


def _bytes(ids: list[int]) -> bytes:
    return array.array("I", ids).tobytes()


@lru_cache(maxsize=2)
def _memory(path: str) -> _Remembered:
    return _Remembered(_encoding(path))


def token_bytes(text: str, path: str) -> bytes:
    """Ids of a text without added tokens as unsigned little-endian 32-bit numbers, without the end token.

    No token crosses a space, except in runs of white space; texts without such
    runs are looked up part by part.
    """
    memory = _memory(path)
    if "  " in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text):
        return _bytes(memory.encode(text))
    first, *rest = text.split(" ")
    return b"".join([_bytes(memory.encode(first)), *map(memory.__getitem__, rest)])


def text_bytes(text: str, path: str) -> bytes:
    """As ``token_bytes``, for any text: it is split at added tokens first, and they give their own ids."""
    pattern, added = _added(path)
    if pattern is None or not pattern.search(text):
        return token_bytes(text, path)
    return b"".join(_bytes([added[part]]) if part in added else token_bytes(part, path) for part in pattern.split(text) if part)


def pieces(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
           path: str | None = None, end: int = END) -> DataFrame:
    """One row per piece: document id, number, first token, tokens, CRC-32 of the ids."""
    path = path or tokenizer_path()
    tail = _bytes([end])
    schema = (T.StructType().add("doc_id", documents.schema[id_col].dataType).add("piece", "integer")
              .add("start", "long").add("length", "long").add("ids_crc32", "long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, piece, start, length, crc = ([] for _ in range(5))
            for i, text in enumerate(batch.column(1)):
                ids = text_bytes(text.as_py() or "", path) + tail
                total = len(ids) // 4
                at = 0
                number = -(-total // capacity)
                for k in range(number):
                    size = total - (number - 1) * capacity if k == 0 else capacity
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(ids[4 * at:4 * (at + size)]))
                    at += size
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=schema.names)

    return documents.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


@dataclass
class Plan:
    """Where runs of (length, rank) go: piece ``rank`` to sequence ``sequence + rank - first``."""

    length: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    sequence: list[int] = field(default_factory=list)
    offset: list[int] = field(default_factory=list)
    sequences: int = 0


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Supersteps of best fit over runs; ``counts`` has the pieces of each length."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    placed = np.zeros(capacity + 1, np.int64)
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # size → runs of (sequence, number)
    free = np.zeros(capacity + 1, np.int64)
    out = Plan()

    def place(length: int, sequence: int, number: int, gap: int) -> None:
        out.length.append(length)
        out.first.append(int(placed[length]))
        out.sequence.append(sequence)
        out.offset.append(capacity - gap)
        placed[length] += number
        left[length] -= number

    while left.any():
        # sweep: the successor of every length among the gap sizes, from the largest down
        successor = np.where(free > 0, np.arange(capacity + 1), capacity + 1)
        successor = np.minimum.accumulate(successor[::-1])[::-1]
        shrunk: list[tuple[int, int, int]] = []
        opened = False
        for length in np.flatnonzero(left)[::-1].tolist():
            gap = int(successor[length])
            if gap > capacity:
                # no gap holds it: it opens sequences, as many as its own pieces fill.  Lengths up to
                # half the capacity wait for the gaps of longer ones that open in this superstep.
                if opened and 2 * length <= capacity:
                    continue
                opened = True
                number = -(-int(left[length]) // (capacity // length))
                place(length, out.sequences, number, capacity)
                shrunk.append((capacity - length, out.sequences, number))
                out.sequences += number
                continue
            while left[length] and gaps[gap]:
                sequence, number = gaps[gap].pop()
                now = min(number, int(left[length]))
                if now < number:
                    gaps[gap].append((sequence + now, number - now))
                place(length, sequence, now, gap)
                free[gap] -= now
                shrunk.append((gap - length, sequence, now))
        for gap, sequence, number in shrunk:
            if gap and number:
                gaps[gap].append((sequence, number))
                free[gap] += number
    return out


def pack(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         path: str | None = None, end: int = END) -> DataFrame:
    """The pieces with ``sequence_id`` and ``offset``."""
    held = cut(pieces(documents, id_col, text_col, capacity, path, end))
    counts = {r.length: r["count"] for r in held.groupBy("length").count().collect()}  # at most ``capacity`` rows
    runs = plan(counts, capacity)
    order = np.lexsort((runs.first, runs.length))
    table = [np.array(x, np.int64)[order] for x in (runs.length, runs.first, runs.sequence, runs.offset)]
    shared = documents.sparkSession.sparkContext.broadcast(table)
    ranked = rank_rows(held, ["doc_id", "piece", "start", "ids_crc32"], ["length"], "rank")
    schema = T.StructType([*held.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, offset = shared.value
        base = np.int64(1) << np.int64(44)
        for batch in batches:
            rank = batch.column(5).to_numpy() - 1
            at = np.searchsorted(length * base + first, batch.column(3).to_numpy() * base + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])], names=schema.names)

    return ranked.select(*held.columns, "rank").mapInArrow(run, schema)
