"""Periodic runs of words, by an enhanced suffix array.

A run is a stretch of consecutive words with a smallest period q, at least
``least`` words and 2q words long, that no neighbouring word extends.  The texts of
a batch are handled together: every word becomes a symbol of its text, every text
ends in a symbol of its own, so no repeat crosses two texts.

Blocks of 1, 2, 4, ... symbols are ranked by doubling; the last ranks are the
inverse suffix array (ISA), and the levels give every LCP and every comparison of two
blocks.  For an LCP interval of depth d, a suffix i of one child with i + d in another
child begins a branching square: d words, the same d words again, and then a word
that ends the repeat.  Only the suffixes of the smaller children ask whether
ISA[i + d] and ISA[i - d] lie in the interval, which finds every pair in
O(n log n) questions without a tree node.  A run ends in branching squares of its
period and of multiples of it; rotating a square to the left as far as its words
repeat gives the whole run, and squares of one run are merged.

Edge cases: a word is a run of bytes other than blank, tab, newline, vertical tab,
form feed and carriage return.  Null, empty and wordless texts have no runs, and
their collapsed text is empty.  Repeated rows and null ids are rows like any other.
A text is never split: memory follows the longest text (about 200 bytes a word).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Least number of words of a run.
LEAST = 12
#: Bytes of texts handled at a time, and suffixes asked at a time.
CHUNK_BYTES, SLAB = 1_000_000, 1 << 20


def least_depth(least: int = LEAST) -> int:
    """Depth from which LCP intervals give every run of ``least`` words.

    A run of period p holds squares of every multiple k * p up to half its length,
    so one of the largest multiple that fits into half of ``least`` words, or p.
    """
    half = max(1, least // 2)
    return min(p * (half // p) for p in range(1, half + 1))


def symbols_of(texts: Sequence[list[bytes]]) -> np.ndarray:
    """Dense numbers of (text, word), and one more of its own after each text."""
    parts, base = [], 0
    for words in texts:
        index: dict[bytes, int] = {}
        own = [index.setdefault(w, len(index)) for w in words]
        own.append(len(index))
        parts.append(np.array(own, np.int64) + base)
        base += len(index) + 1
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def rank_levels(symbols: np.ndarray) -> list[np.ndarray]:
    """Ranks of the blocks of 1, 2, 4, ... symbols from each place; all of the last level differ.

    A rank is the number of blocks before the first equal one.  Only blocks that
    still have equals are sorted again.
    """
    counts = np.bincount(symbols)
    rank = (np.cumsum(counts) - counts)[symbols]
    levels, width = [rank], 1
    equal = np.flatnonzero(counts[symbols] > 1)
    while len(equal):
        order = np.argsort(rank[equal] * len(rank) + rank[equal + width], kind="stable")
        place = equal[order]
        one, two = rank[place], rank[place + width]
        head = np.ones(len(place), bool)
        head[1:] = one[1:] != one[:-1]
        new = head.copy()
        new[1:] |= two[1:] != two[:-1]
        at = np.arange(len(place))
        shift = np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(head, at, 0))
        rank = rank.copy()
        rank[place] = one + shift
        levels.append(rank)
        alone = new & np.append(new[1:], True)
        equal = place[~alone]
        width *= 2
    return levels


def common_prefix(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of equal symbols from places a and b on (a differs from b)."""
    length = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 2, -1, -1):
        same = levels[k][a + length] == levels[k][b + length]
        length += same.astype(np.int64) << k
    return length


def rotated_left(levels: list[np.ndarray], start: np.ndarray, period: np.ndarray) -> np.ndarray:
    """First place from which the words before ``start`` keep repeating at ``period``."""
    at = start.copy()
    for k in range(len(levels) - 2, -1, -1):
        step = at - (1 << k)
        inside = np.maximum(step, 0)
        same = (step >= 0) & (levels[k][inside] == levels[k][inside + period])
        at = np.where(same, step, at)
    return at


def _enclosing(place: list[int], depth: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """For every boundary of the suffix array, the nearest boundaries of lesser depth on both sides."""
    left, right = [0] * len(place), [0] * len(place)
    held: list[int] = []
    floor = last = -2
    for i, (p, d) in enumerate(zip(place, depth)):
        if p != last + 1:
            for h in held:
                right[h] = last + 1
            held.clear()
            floor = p - 1
        while held and depth[held[-1]] > d:
            right[held.pop()] = p
        if not held:
            left[i] = floor
        elif depth[held[-1]] == d:
            left[i] = left[held[-1]]
        else:
            left[i] = place[held[-1]]
        held.append(i)
        last = p
    for h in held:
        right[h] = last + 1
    return np.array(left, np.int64), np.array(right, np.int64)


def branching_squares(levels: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, half) of the squares that the next word ends, with halves of at least ``least`` words."""
    isa = levels[-1]
    n = len(isa)
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    near = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    depth = common_prefix(levels, sa[near - 1], sa[near])
    place, depth = near[depth >= least], depth[depth >= least]
    if not len(place):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    left, right = _enclosing(place.tolist(), depth.tolist())
    order = np.lexsort((place, depth, left))
    place, depth, left, right = place[order], depth[order], left[order], right[order]
    head = np.ones(len(place), bool)
    head[1:] = (left[1:] != left[:-1]) | (depth[1:] != depth[:-1])
    interval = np.cumsum(head) - 1
    tail = np.append(head[1:], True)
    # the child that begins at each boundary, and each interval's first child
    begin = np.concatenate((place, left[head]))
    end = np.concatenate((np.where(tail, right, np.append(place[1:], 0)), place[head]))
    interval = np.concatenate((interval, np.arange(head.sum())))
    low, high, deep = left[head], right[head], depth[head]
    size = end - begin
    ranked = np.lexsort((-size, interval))
    largest = np.ones(len(ranked), bool)
    largest[1:] = interval[ranked][1:] != interval[ranked][:-1]
    small = ranked[~largest]
    starts, halves = [], []
    reach = np.cumsum(size[small])
    cuts = np.unique(np.searchsorted(reach, np.arange(0, (reach[-1] if len(reach) else 0) + SLAB, SLAB)))
    for a, b in zip(cuts[:-1], cuts[1:]):
        child = small[a:b]
        own = np.repeat(child, size[child])
        within = np.arange(len(own)) - np.repeat(np.cumsum(size[child]) - size[child], size[child])
        i = sa[begin[own] + within]
        d, lo, hi = deep[interval[own]], low[interval[own]], high[interval[own]]
        for sign in (1, -1):
            j = i + sign * d
            there = (j >= 0) & (j < n)
            y = isa[np.where(there, j, 0)]
            found = there & (y >= lo) & (y < hi) & ((y < begin[own]) | (y >= end[own]))
            starts.append((i if sign == 1 else j)[found])
            halves.append(d[found])
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(starts), np.concatenate(halves)


def runs_of(symbols: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start and period; every text must end in a symbol of its own."""
    none = np.zeros(0, np.int64)
    if len(symbols) <= least:
        return none, none, none
    levels = rank_levels(symbols)
    start, half = branching_squares(levels, least_depth(least))
    end = start + 2 * half
    order = np.lexsort((half, end))
    start, half, end = start[order], half[order], end[order]
    found = []
    while len(start):
        first = np.ones(len(end), bool)
        first[1:] = end[1:] != end[:-1]
        begin = rotated_left(levels, start[first], half[first])
        found.append((begin, end[first] - begin, half[first]))
        # a later square of this end inside the run is the same run at a multiple of its period
        length = np.repeat(end[first] - begin, np.diff(np.append(np.flatnonzero(first), len(end))))
        rest = 2 * half > length
        start, half, end = start[rest], half[rest], end[rest]
    if not found:
        return none, none, none
    start, length, period = (np.concatenate(c) for c in zip(*found))
    # runs of short periods may be met at a multiple first
    for p in range(least // 4, 0, -1):
        near = np.flatnonzero((period % p == 0) & (period > p) & (period <= least // 2))
        if len(near):
            same = common_prefix(levels, start[near], start[near] + p) >= length[near] - p
            period[near[same]] = p
    long = length >= least
    order = np.lexsort((period[long], start[long]))
    return start[long][order], length[long][order], period[long][order]


def _answers(texts: list[bytes], least: int) -> Iterator[tuple[int, list, bytes]]:
    """Number of words, runs and collapsed text of each text of a chunk."""
    split = [t.split() for t in texts]
    start, length, period = runs_of(symbols_of(split), least)
    sizes = np.array([len(w) for w in split], np.int64)
    base = np.cumsum(sizes + 1) - sizes - 1
    edge = np.searchsorted(start, np.append(base, base[-1] + sizes[-1] + 1))
    for k, words in enumerate(split):
        a, b = edge[k], edge[k + 1]
        if a == b:
            yield len(words), [], b" ".join(words)
            continue
        own = start[a:b] - base[k]
        turns = np.zeros(len(words) + 1, np.int64)
        np.add.at(turns, own + period[a:b], 1)
        np.add.at(turns, own + length[a:b], -1)
        kept = np.flatnonzero(np.cumsum(turns)[:-1] == 0)
        runs = [{"start": s, "length": n, "period": p}
                for s, n, p in zip(own.tolist(), length[a:b].tolist(), period[a:b].tolist())]
        yield len(words), runs, b" ".join([words[i] for i in kept.tolist()])


def periodic_runs(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """One row per document: its id, number of words, runs (by start, then period) and collapsed text.

    The collapsed text keeps the first period of every run and the words outside runs.
    """
    run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def chunks(batch: pa.RecordBatch) -> Iterator[tuple[int, list[bytes]]]:
        at, held, size = 0, [], 0
        for i, text in enumerate(batch.column(1).to_pylist()):
            text = text or b""
            if held and size + len(text) > CHUNK_BYTES:
                yield at, held
                at, held, size = i, [], 0
            held.append(text)
            size += len(text)
        if held:
            yield at, held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, held in chunks(batch):
                counts, runs, texts = zip(*_answers(held, least))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(held)), pa.array(counts, pa.int64()), pa.array(runs, run_type),
                     pa.array(texts, pa.binary())], names=["id", "n_words", "runs", "collapsed"])

    spans = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([T.StructField("id", documents.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(spans)), T.StructField("collapsed", T.BinaryType())])
    rows = documents.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("binary"))
    return rows.mapInArrow(run, schema).select(
        F.col("id").alias(id_col), "n_words", "runs", F.col("collapsed").cast("string").alias("collapsed"))
