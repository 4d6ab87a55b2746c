"""Benchmark decontamination by edit distance.

Items and documents are sequences of words.  A random walk (CGK embedding) reads a
window of words: step j writes the current word and moves on or stays, decided by
a random bit of (j, word).  Windows at a small edit distance walk apart only
briefly, so their embeddings agree at most places (Hamming distance), and a few
sampled places serve as a locality-sensitive key.  Keys repeat with fresh walks
until simulated edits of the items are found with the target recall, in every class
of item lengths on its own.  A class that the limit of repetitions ends short of the
target is warned of.  Candidates are then verified with exact edit distance.

Windows are as long as the item counted from one of its anchor words, and every
key includes place 0 of the embedding, which is the window's first word.  So a
document word that begins no item window cannot match any key, and no walk starts
there: an exact shortcut, not a filter.

Edge cases: an item or a document that is null, empty or without words matches
nothing.  Items of any length are searched; an item of n words may differ in
floor(max_edits · n) words.  Equal items are reported each under its own id.
Null ids are kept as they are.  Repeated document rows are reported once each.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textarrays import Words, chunks, mix

#: Share of an item's words that may be inserted, deleted or replaced.
MAX_EDITS = 0.2
#: Windows per item, each from another anchor word of its first half.
ANCHORS = 4
#: Places of the embedding in a key, beside place 0.
SAMPLED = 3
#: Repetitions are added until simulated edits are found this often, up to the limit.
TARGET_RECALL, MOST_REPEATS = 0.995, 48
#: Items searched in one pass over the documents; more items take more passes.
ITEMS_PER_PASS = 20_000
_BLOOM_BITS = 22


def _odd(*parts: int) -> np.uint64:
    value = 1
    for p in parts:
        value = int(mix(np.array([(value * 1_000_003 + p + 1) % (1 << 64)], np.uint64))[0])
    return np.uint64(value | 1)


def sampled_places(steps: int, repeat: int) -> list[int]:
    """Places of the embedding in a key, drawn once per window class and repetition."""
    if steps <= 1:
        return []
    rng = np.random.default_rng([steps, repeat])
    return sorted(int(x) for x in rng.choice(np.arange(1, steps), min(SAMPLED, steps - 1), replace=False))


def walk_keys(words: np.ndarray, start: np.ndarray, end: np.ndarray, steps: int, repeat: int) -> np.ndarray:
    """LSH keys of the windows that begin at ``start``; past ``end`` the walk reads 0."""
    at = start.copy()
    key = words[start] * _odd(steps, repeat)
    places = sampled_places(steps, repeat)
    now = 0
    for place in places:
        while now < place:
            w = words[np.minimum(at, len(words) - 1)]
            # the random bit of (step, word)
            at += ((w * _odd(7, repeat, now)) >> np.uint64(63)).astype(np.int64) & (at < end)
            now += 1
        symbol = np.where(at < end, words[np.minimum(at, len(words) - 1)], np.uint64(0))
        key = mix(key + symbol) * np.uint64(3)
    return mix(key)


def window_steps(length: int) -> int:
    """Embedding length of a window class: windows of [2^c, 2^(c+1)) words share 2^c steps."""
    return 1 << (int(length).bit_length() - 1)


def anchor_places(item: np.ndarray, lengths: np.ndarray) -> list[int]:
    """Word offsets of an item's windows: the longest words of its first half (rarest, as a rule)."""
    half = max(1, math.ceil(len(item) / 2))
    order = sorted(range(half), key=lambda i: (-int(lengths[i]), i))
    taken, seen = [], set()
    for i in order:
        if int(item[i]) not in seen:
            seen.add(int(item[i]))
            taken.append(i)
    return taken[:ANCHORS]


@dataclass
class Index:
    """Keys of one pass's items (bounded by ITEMS_PER_PASS)."""

    items: list[np.ndarray]
    anchors: dict[int, np.ndarray]  # steps → sorted anchor words
    bloom: np.ndarray
    keys: np.ndarray  # sorted
    item: np.ndarray
    offset: np.ndarray
    repeats: dict[int, int]  # steps → most repetitions of its windows
    recall: dict[int, float]  # class of item lengths → simulated recall


def _simulated(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    """The item with some words replaced, dropped or added, between other words."""
    words = list(item)
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(len(words)))
        fresh = np.uint64(rng.integers(1, 2 ** 63))
        if kind == 0:
            words[at] = fresh
        elif kind == 1:
            words.insert(at, fresh)
        elif len(words) > 1:
            del words[at]
    tail = rng.integers(1, 2 ** 63, len(item) + 4).astype(np.uint64)
    return np.concatenate((np.array(words, np.uint64), tail))


def build_index(texts: list[str], max_edits: float = MAX_EDITS, target: float = TARGET_RECALL,
                trials: int = 400) -> Index:
    """Windows and keys of the items, with as many repetitions as the target recall takes.

    Recall is simulated in every class of item lengths (``window_steps``) on
    ``trials`` edited items (a fixed number: it sets only the number of
    repetitions), each with the most edits allowed.  A trial is found by a key of
    its own item and offset only, at a place that verification starts from.
    """
    items, windows = [], []
    for at, held in chunks(texts):
        w = Words(held)
        length = w.end - w.begin
        for i in range(len(held)):
            a, b = w.first[i], w.first[i + 1]
            items.append(w.hash[a:b])
            windows += [(at + i, o, window_steps(b - a - o)) for o in (anchor_places(w.hash[a:b], length[a:b]) if b > a else [])]
    anchors: dict[int, set[int]] = {}
    for i, o, steps in windows:
        anchors.setdefault(steps, set()).add(int(items[i][o]))
    held_anchors = {s: np.array(sorted(a), np.uint64) for s, a in sorted(anchors.items())}
    bloom = np.zeros(1 << _BLOOM_BITS, bool)
    for a in held_anchors.values():
        bloom[a >> np.uint64(64 - _BLOOM_BITS)] = True

    if not windows:
        none = np.zeros(0, np.int64)
        return Index(items, {}, bloom, none.astype(np.uint64), none, none, {}, {})
    who, off, step = (np.array(x, np.int64) for x in zip(*windows))
    kind = np.array([window_steps(len(items[i])) for i in who])
    rng = np.random.default_rng(11)
    keys, at, repeats, recall = [], [], {}, {}
    for c in np.unique(kind).tolist():
        mine = np.flatnonzero(kind == c)
        tries = [(i, _simulated(items[i], int(max_edits * len(items[i])), rng)) for i in rng.choice(np.unique(who[mine]), trials)]
        flat = np.concatenate([t for _, t in tries])
        ends = np.cumsum([len(t) for _, t in tries])
        parts = []
        for s in np.unique(step[mine]).tolist():
            own = mine[step[mine] == s]
            words = np.concatenate([items[i] for i in who[own]])
            base = np.cumsum([0, *(len(items[i]) for i in who[own])])
            parts.append((s, own, words, base[:-1] + off[own], base[1:], *_meetings(tries, ends, items, own, who, off, max_edits)))
        found = np.zeros(trials, bool)
        repeat = 0
        while repeat < MOST_REPEATS and found.mean() < target:
            for s, own, words, start, end, place, trial, window in parts:
                key = walk_keys(words, start, end, s, repeat)
                keys.append(key)
                at.append(own)
                if len(place):
                    found[trial[walk_keys(flat, place, ends[trial], s, repeat) == key[window]]] = True
            repeat += 1
        recall[c] = float(found.mean())
        if recall[c] < target:
            warnings.warn(f"items of {c} to {2 * c - 1} words: {MOST_REPEATS} repetitions reach recall {recall[c]:.4f}, "
                          f"short of {target}", stacklevel=2)
        for s, *_ in parts:
            repeats[s] = max(repeats.get(s, 0), repeat)
    flat_keys, at = np.concatenate(keys), np.concatenate(at)
    order = np.argsort(flat_keys, kind="stable")
    return Index(items, held_anchors, bloom, flat_keys[order], who[at][order], off[at][order], repeats, recall)


def _meetings(tries: list, ends: np.ndarray, items: list[np.ndarray], own: np.ndarray, who: np.ndarray, off: np.ndarray,
              max_edits: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, trial, index in ``own``) where a window's anchor word stands within the edits of its offset in a trial of its item."""
    of: dict[int, list[int]] = {}
    for k, w in enumerate(own.tolist()):
        of.setdefault(int(who[w]), []).append(k)
    out = []
    for t, (i, words) in enumerate(tries):
        edits = int(max_edits * len(items[i]))
        for k in of.get(int(i), ()):
            o = int(off[own[k]])
            low = max(0, o - edits)
            near = np.flatnonzero(words[low:o + edits + 1] == items[i][o]) + low
            out += [(int(ends[t]) - len(words) + p, t, k) for p in near.tolist()]
    return tuple(np.array(out, np.int64).reshape(-1, 3).T)


def candidates(words: Words, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (text, item, word at which the item would begin) that share a key."""
    h = words.hash
    maybe = np.flatnonzero(index.bloom[h >> np.uint64(64 - _BLOOM_BITS)])
    if not len(maybe):
        return maybe, maybe, maybe
    text = np.searchsorted(words.first, maybe, "right") - 1
    end = words.first[text + 1]
    out = []
    for steps, anchors in index.anchors.items():
        place = np.minimum(np.searchsorted(anchors, h[maybe]), len(anchors) - 1)
        own = anchors[place] == h[maybe]
        start, stop, of = maybe[own], end[own], text[own]
        if not len(start):
            continue
        for repeat in range(index.repeats[steps]):
            key = walk_keys(h, start, stop, steps, repeat)
            low, high = np.searchsorted(index.keys, key), np.searchsorted(index.keys, key, "right")
            n = high - low
            hit = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append(np.stack((np.repeat(of, n), index.item[hit], np.repeat(start, n) - index.offset[hit])))
    if not out:
        return (maybe[:0],) * 3
    found = np.unique(np.concatenate(out, axis=1), axis=1)
    return found[0], found[1], found[2]


def _best_ends(item: np.ndarray, segments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edit distance of the item to a stretch of each row, and the end of the first best stretch."""
    rows, width = segments.shape
    steps = np.arange(width + 1)
    line = np.zeros((rows, width + 1), np.int64)  # a stretch may begin anywhere
    for i, word in enumerate(item, 1):
        new = np.empty_like(line)
        new[:, 0] = i
        new[:, 1:] = np.minimum(line[:, :-1] + (segments != word), line[:, 1:] + 1)
        line = np.minimum.accumulate(new - steps, axis=1) + steps
    end = line.argmin(axis=1)
    return line[np.arange(rows), end], end


def verify(words: Words, index: Index, text: np.ndarray, item: np.ndarray, start: np.ndarray,
           max_edits: float = MAX_EDITS) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, begin, end), in words, of the candidates within their edit limit.

    Of overlapping places of one item in one text, the one of least distance stays
    (ties: the first).
    """
    out = set()
    for i in np.unique(item):
        mine = np.flatnonzero(item == i)
        words_of = index.items[i]
        n, k = len(words_of), int(max_edits * len(words_of))
        for part in np.array_split(mine, math.ceil(len(mine) / 2000)):
            first, last = words.first[text[part]], words.first[text[part] + 1]
            at = np.maximum(start[part] - k, first)[:, None] + np.arange(n + 3 * k + 1)
            inside = at < last[:, None]
            # a word no item has stands for what lies past the end of the text
            rows = np.where(inside, words.hash[np.minimum(at, len(words.hash) - 1)], np.uint64(0))
            distance, end = _best_ends(words_of, rows)
            good = np.flatnonzero(distance <= k)
            if not len(good):
                continue
            # the begin is found by the same search on reversed words that end at the best end
            width = n + k
            back = end[good][:, None] - 1 - np.arange(width)
            mirrored = np.where(back >= 0, rows[good[:, None], np.maximum(back, 0)], np.uint64(0))
            anchored = _prefix_distance(words_of[::-1], mirrored)
            length = (anchored == distance[good][:, None]).argmax(axis=1)
            for g, size in zip(good, length):
                stop = at[g, 0] + end[g]
                out.add((int(text[part[g]]), int(i), int(distance[g]), int(stop - size), int(min(stop, last[g]))))
    # the same place can be reached from several windows: the best alignment of overlapping ones stays
    kept: dict[tuple[int, int], list] = {}
    for t, i, d, a, b in sorted(out, key=lambda r: (r[2], r[3], r[4])):
        mine = kept.setdefault((t, i), [])
        if all(b <= x[3] or a >= x[4] for x in mine):
            mine.append((t, i, d, a, b))
    return sorted(r for mine in kept.values() for r in mine)


def _prefix_distance(item: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Edit distance of the item to every prefix of each row."""
    steps = np.arange(rows.shape[1] + 1)
    line = np.broadcast_to(steps, (len(rows), len(steps))).copy()
    for i, word in enumerate(item, 1):
        new = np.empty_like(line)
        new[:, 0] = i
        new[:, 1:] = np.minimum(line[:, :-1] + (rows != word), line[:, 1:] + 1)
        line = np.minimum.accumulate(new - steps, axis=1) + steps
    return line


def _indexes(items: DataFrame, id_col: str, text_col: str, max_edits: float) -> Iterator[tuple[list, Index]]:
    """The items pass by pass, each pass bounded."""
    passes = max(1, math.ceil(items.count() / ITEMS_PER_PASS))
    part = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(passes))
    for k in range(passes):
        rows = items.where(part == k).select(id_col, text_col).collect()
        rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
        yield [r[0] for r in rows], build_index([r[1] or "" for r in rows], max_edits)


def find(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
         item_id: str = "item_id", item_text: str = "text", max_edits: float = MAX_EDITS) -> DataFrame:
    """One row per place where a document holds an item: document id, item id, distance, start, length.

    ``distance`` counts words, ``start`` and ``length`` code points of the text.
    """
    kinds = {f.name: f.dataType for f in documents.schema.fields}, {f.name: f.dataType for f in items.schema.fields}
    schema = (T.StructType().add("doc_id", kinds[0][id_col]).add("item_id", kinds[1][item_id])
              .add("distance", "integer").add("start", "integer").add("length", "integer"))
    spark, out = documents.sparkSession, None
    for ids, index in _indexes(items, item_id, item_text, max_edits):
        shared = spark.sparkContext.broadcast((ids, index))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            names, held = shared.value
            for batch in batches:
                rows = []
                keys = batch.column(0).to_pylist()
                for at, texts in chunks(batch.column(1).to_pylist()):
                    w = Words(texts)
                    for t, i, d, a, b in verify(w, held, *candidates(w, held), max_edits):
                        lo, hi = int(w.begin[a] - w.base[t]), int(w.end[b - 1] - w.base[t])
                        rows.append((keys[at + t], names[i], d, lo, hi - lo))
                columns = list(zip(*rows)) if rows else [[]] * 5
                kind = pa_schema
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, kind)], schema=kind)

        pa_schema = _arrow_schema(schema)
        found = documents.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def clean(documents: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
          item_text: str = "text", max_edits: float = MAX_EDITS) -> DataFrame:
    """The documents that hold no item, all columns kept; rows are judged one by one."""
    out = documents
    for _, index in _indexes(items, item_id, item_text, max_edits):
        shared = documents.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for at, texts in chunks(batch.column(text_col).to_pylist()):
                    w = Words(texts)
                    for t, *_ in verify(w, shared.value, *candidates(w, shared.value), max_edits):
                        keep[at + t] = False
                yield batch.filter(pa.array(keep))

        out = out.mapInArrow(run, documents.schema)
    return out
