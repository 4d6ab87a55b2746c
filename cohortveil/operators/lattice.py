"""All group-bys of a view in one job.

Rows meet their person once: they are partitioned by person, and each task adds its
persons up to states of cells, so that no row per person and grouping set leaves it.
Dimensions that are joined to the base table rarely differ between a person's rows.  A
person who has one combination of them is summed once per set of the other dimensions;
the state of such a cell, under the whole combination, is then folded into every grouping
set that holds a part of it.  Anyone else is summed for each grouping set.  What is
shuffled is one row per person and finest combination, and then states of cells, one a task.
"""

from __future__ import annotations

import math
import sys
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import cut
from ..study import PERSON, split_ref
from .measures import power
from .views import Workspace

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows per person and grouping set, or dimension, that one task makes; its hash tables hold that many without spilling.
ROWS_PER_TASK = 2_000_000
#: A sweep's tasks hold their rows as arrays in Python and get one in so many of those.
SWEEP_SHARE = 4


def key_sets(dims, widest: int = 3, narrowest: int = 0) -> list[tuple[str, ...]]:
    """Every group-by of up to ``widest`` of the dimensions, in a fixed order."""
    dims = sorted(dims)
    return [c for k in range(narrowest, widest + 1) for c in combinations(dims, k)]


def parents(dims, widest: int, levels: dict[str, int]) -> dict[tuple[str, ...], list[tuple[str, ...]]]:
    """Wide set → the grouping sets summed from it.

    Wide sets have two keys more than the widest grouping set.  They are picked one by
    one, the one first that holds most sets still without a parent for its size; each set
    then takes the smallest of those that hold it.
    """
    dims = sorted(dims)
    width = min(len(dims), widest + 2)

    def size(keys) -> int:
        out = 1
        for k in keys:
            out *= levels[k]
        return out

    wide = list(combinations(dims, width))
    open_, picked = set(combinations(dims, min(widest, len(dims)))), []
    while open_:
        best = max(wide, key=lambda w: (sum(set(s) <= set(w) for s in open_) / size(w) ** 0.25, w))
        picked.append(best)
        open_ = {s for s in open_ if not set(s) <= set(best)}
    plan: dict[tuple[str, ...], list] = {w: [] for w in picked}
    for keys in key_sets(dims, widest):
        plan[min((w for w in picked if set(keys) <= set(w)), key=lambda w: (size(w), w))].append(keys)
    return {w: sets for w, sets in plan.items() if sets}


def _mask(dims: list[str], keys) -> int:
    return sum(1 << i for i, d in enumerate(dims) if d in keys)


def _masked(rows: DataFrame, dims: list[str], keep: list[str]) -> DataFrame:
    """Dimensions outside ``_mask`` become NULL."""
    inside = lambda i: F.col("_mask").bitwiseAND(F.lit(1 << i)) != 0
    return rows.select(*keep, *(F.when(inside(i), F.col(d)).alias(d) for i, d in enumerate(dims)))


def by_person(rows: DataFrame, times: int) -> DataFrame:
    """Rows partitioned by person, for a step that makes ``times`` as many of each task's rows.

    The rows are small beside what is made of them, so the number of tasks follows the
    latter; Spark would choose it by the size of what it shuffles.
    """
    held = cut(rows)
    tasks = math.ceil(held.count() * times / ROWS_PER_TASK)
    return held.repartition(max(tasks, held.sparkSession.sparkContext.defaultParallelism), F.col(PERSON))


def grouping_text(mask: Column, dims) -> Column:
    """Names of the dimensions in a grouping set."""
    return F.concat_ws("+", *(F.when(mask.bitwiseAND(F.lit(1 << i)) != 0, F.lit(d)) for i, d in enumerate(sorted(dims))))


# -- a task's persons, added up to cells ---------------------------------------------

def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Values as numbers, and the values; a missing one is a value too."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def _joint(codes: list[np.ndarray], rows: int) -> np.ndarray:
    """One number per combination, under 2³¹ as long as there are fewer rows."""
    out, size = np.zeros(rows, np.int64), 1
    for c in codes:
        k = int(c.max()) + 1
        out, size = out * k + c, size * k
        if size >= 1 << 31:
            known, out = np.unique(out, return_inverse=True)
            size = len(known)
    return out


def _numbers(column: pa.ChunkedArray) -> np.ndarray:
    """Amounts as doubles or whole numbers (of the last decimal place).

    Whole numbers that may add up to more than 64 bits hold are Python's.
    """
    flat = column.combine_chunks()
    if pa.types.is_floating(flat.type):
        return flat.to_numpy(zero_copy_only=False)
    if pa.types.is_decimal(flat.type):
        words = np.frombuffer(flat.buffers()[1], np.int64).reshape(-1, 2)[flat.offset:flat.offset + len(flat)]
        out = words[:, 0].copy()
        if (words[:, 1] != out >> 63).any():
            return np.array([(int(high) << 64) + (int(low) & 2 ** 64 - 1) for low, high in words], dtype=object)
    else:
        out = flat.to_numpy(zero_copy_only=False)
    return out if np.abs(out.astype(float)).sum() < 2 ** 62 else out.astype(object)


def _column(values: np.ndarray, kind: pa.DataType, absent: np.ndarray | None = None) -> pa.Array:
    """The reverse of :func:`_numbers`."""
    if not pa.types.is_decimal(kind):
        return pa.array(values if values.dtype != object else values.tolist(), kind, mask=absent)
    if values.dtype == object:
        words = b"".join(int(v).to_bytes(16, "little", signed=True) for v in values)
    else:
        words = np.stack([values, values >> 63], axis=1).tobytes()
    held = None if absent is None else pa.array(~absent).buffers()[1]
    return pa.Array.from_buffers(kind, len(values), [held, pa.py_buffer(words)])


def _starts(sorted_: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])


def _two_largest(amounts: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest and, where there are two, second largest of each run."""
    one = np.maximum.reduceat(amounts, first)
    run = np.repeat(np.arange(len(first)), size)
    top = one[run]
    at = np.flatnonzero((amounts == top) | ((amounts != amounts) & (top != top)))
    rest = amounts.copy()
    rest[at[_starts(run[at])]] = -np.inf if amounts.dtype.kind == "f" else np.iinfo(np.int64).min if amounts.dtype.kind == "i" else -(1 << 126)
    return one, np.maximum.reduceat(rest, first)


def _states_of(cell: np.ndarray, person: np.ndarray, counts: dict, amounts: dict, two: bool) -> tuple[np.ndarray, dict]:
    """A row of each cell, and the cell's state."""
    many = int(person.max()) + 1
    key = cell * many + person
    order = np.argsort(key)
    key = key[order]
    per = _starts(key)                               # first row of each person in a cell
    first = _starts(key[per] // many)                # first person of each cell
    size = np.diff(np.r_[first, len(per)])
    out = {"_persons": size}
    for name, v in counts.items():
        mine = np.add.reduceat(v[order], per)
        out[name] = np.add.reduceat(mine, first)
        if name == "_k":
            out["_k_persons"] = np.add.reduceat((mine > 0).astype(np.int64), first)
    for name, v in amounts.items():
        mine = np.add.reduceat(v[order], per)
        out[name + "_total"] = np.add.reduceat(mine, first)
        out[name + "_largest"] = np.maximum.reduceat(np.abs(mine), first)
        out[name + "_magnitude"] = np.add.reduceat(np.abs(mine), first)
        if two:
            out[name + "_one"], out[name + "_two"] = _two_largest(mine, first, size)
    return order[per[first]], out


def _fold(schema: pa.Schema, dims: list[str], fixed: list[str], widest: int, two: bool):
    """Arrow batches of whole persons → states of cells."""
    bits = {d: 1 << i for i, d in enumerate(dims)}
    free = [d for d in dims if d not in fixed]
    all_fixed = sum(bits[d] for d in fixed)
    sets = lambda of: [c for k in range(widest + 1) for c in combinations(of, k)]

    def run(table):
        rows = table.num_rows
        coded = {d: _codes(table.column(d)) for d in dims}
        levels = {d: c for d, (c, _) in coded.items()}
        person, _ = _codes(table.column(PERSON))
        counts = {c: table.column(c).to_numpy() for c in ("_n", "_k") if c in table.column_names}
        amounts = {c: _numbers(table.column(c)) for c in table.column_names if c.startswith("_c")}
        group = _joint([levels[d] for d in fixed], rows)
        low, high = np.full(person.max() + 1, group.max()), np.zeros(person.max() + 1, np.int64)
        np.minimum.at(low, person, group)
        np.maximum.at(high, person, group)
        settled = (low == high)[person]
        for some, plan in ((settled, [(s, bool(fixed) and len(s) < widest) for s in sets(free)]),
                           (~settled, [(s, False) for s in sets(dims)])):
            if not some.any():
                continue
            at = np.flatnonzero(some)
            part = lambda v: v if len(at) == rows else v[at]
            who, which = part(person), part(group)
            mine = {d: part(c) for d, c in levels.items()}
            n, c = {k: part(v) for k, v in counts.items()}, {k: part(v) for k, v in amounts.items()}
            for keys, wide in plan:
                cell = _joint([mine[d] for d in keys] + [which] * wide, len(at))
                spot, state = _states_of(cell, who, n, c, two)
                mask = sum(bits[d] for d in keys) | all_fixed * wide
                out = {"_mask": np.full(len(spot), mask, np.int32), "_wide": np.full(len(spot), wide), **state}
                columns = []
                for field in schema:
                    if field.name not in bits:
                        alone = state["_persons"] < 2 if field.name.endswith("_two") else None
                        columns.append(_column(out[field.name], field.type, alone))
                    elif mask & bits[field.name]:
                        columns.append(coded[field.name][1].take(pa.array(mine[field.name][spot])).cast(field.type))
                    else:
                        columns.append(pa.nulls(len(spot), field.type))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    def fold(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            yield from run(pa.Table.from_batches(held))

    return fold


# -- the sweep -------------------------------------------------------------------------

def joined_dims(ws: Workspace, view: str, dims) -> list[str]:
    """Dimensions from other tables than the base, or all of a rollup's; they tend to be a person's own."""
    v = ws.study.view(view)
    source = {**v.columns, **v.unit_columns}
    return [d for d in dims if v.is_rollup or split_ref(source[d])[0] != v.base]


def merged_states(states: DataFrame, keys) -> DataFrame:
    """States of the same cell added up."""
    def term(c: str) -> Column:
        if c.endswith("_two"):
            return F.slice(F.sort_array(F.flatten(F.collect_list(c)), False), 1, 2)
        return F.max(c) if c.endswith("_largest") else F.sum(c)

    return states.groupBy(*keys).agg(*(term(c).alias(c) for c in states.columns if c not in keys))


def sweep_persons(ws: Workspace, view: str, column: str, dims=None, widest: int = 3,
                  filters=(), degrees=(1,), hits: str | None = None, named: bool = True, two: bool = False) -> DataFrame:
    """Per-person sums for every group-by, added up to cells: grouping, dims…, _n, _persons
    and, of each power's sums, _c1_total, _c1_largest, _c1_magnitude….

    ``hits`` names a boolean column whose true rows are counted as ``_k``, in ``_k_persons``.
    With ``two``, ``_c1_two`` holds the two largest sums.  Unless ``named``, grouping is the
    set's number, for :func:`grouping_text`.
    """
    dims = sorted(dims or ws.study.view(view).dims)
    # only shares are read off higher powers here, so those add up as doubles
    term = lambda c, k: power(c.cast("double") if k > 1 else c, k)

    def terms(col) -> dict[str, Column]:
        out = {"_n": F.count(F.lit(1)), **{f"_c{k}": F.sum(term(col(column), k)) for k in degrees}}
        return {**out, "_k": F.count_if(F.coalesce(col(hits), F.lit(False)))} if hits else out

    rows, _ = ws.leaves(view, dims, tuple(filters), (column,), terms)
    powers = [f"_c{k}" for k in degrees]
    names = ["_n", *powers, *(["_k"] if hits else [])]
    # the one exchange of rows; a person with very many is added up before Python reads them
    held = by_person(rows.select(*dims, PERSON, *names), SWEEP_SHARE).groupBy(*dims, PERSON).agg(*(F.sum(c).alias(c) for c in names))
    fixed = joined_dims(ws, view, dims)
    kind = lambda t: T.DecimalType(38, t.scale) if isinstance(t, T.DecimalType) else t
    schema = T.StructType([T.StructField("_mask", T.IntegerType()), T.StructField("_wide", T.BooleanType())]
                          + [T.StructField(d, held.schema[d].dataType) for d in dims]
                          + [T.StructField(c, T.LongType()) for c in ("_n", "_persons", *(["_k", "_k_persons"] if hits else []))]
                          + [T.StructField(c + x, kind(held.schema[c].dataType)) for c in powers
                             for x in ("_total", "_largest", "_magnitude", *(("_one", "_two") if two else ()))])
    states = held.mapInArrow(_fold(to_arrow_schema(schema), dims, fixed, widest, two), schema)
    for c in powers if two else ():
        pair = F.when(F.col(c + "_two").isNull(), F.array(c + "_one")).otherwise(F.array(c + "_one", c + "_two"))
        states = states.withColumn(c + "_two", pair).drop(c + "_one")
    states = merged_states(states, ["_mask", "_wide", *dims])
    free = [d for d in dims if d not in fixed]
    parts = {_mask(dims, [*s, *fixed]): [_mask(dims, [*s, *p]) for p in key_sets(fixed, widest - len(s))]
             for s in key_sets(free, widest - 1)}
    if fixed:
        inside = F.create_map(*(F.lit(x) if isinstance(x, int) else F.array(*map(F.lit, x)) for pair in parts.items() for x in pair))
        each = F.when(F.col("_wide"), F.element_at(inside, F.col("_mask"))).otherwise(F.array("_mask"))
        rest = [c for c in states.columns if c not in (*dims, "_mask", "_wide")]
        states = states.select(*dims, *rest, F.explode(each).alias("_mask"))
        states = merged_states(_masked(states, dims, ["_mask", *rest]), ["_mask", *dims])
    label = grouping_text(F.col("_mask"), dims) if named else F.col("_mask")
    return states.select(label.alias("grouping"), *(c for c in states.columns if c not in ("_mask", "_wide")))
