"""Registered measures: what a cell computes and how one person contributes.

A procedure supplies Column expressions only.  ``parts`` are summed per person
and cell; ``value`` combines the cell totals.  Adding a measure means adding
one object to :data:`PROCEDURES`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..study import View, _need

INFINITY = float("inf")


def power(c: Column, k: int) -> Column:
    # exact decimal products fit for squares; higher powers go through double
    base = c.cast("double") if k > 2 else c
    out = base
    for _ in range(k - 1):
        out = out * base
    return out


def ratio(num: Column, den: Column) -> Column:
    """num / den as double, NULL when the divisor is zero or missing."""
    n, d = num.cast("double"), den.cast("double")
    return F.when(d != 0.0, n / F.when(d != 0.0, d))


@dataclass(frozen=True)
class Count:
    fn: str = "count"
    witness = None
    value_class = "count"

    def check(self, m, view: View) -> None:
        _need(m.column is None and m.x is None and m.y is None, "count takes no column")

    def guards(self, m) -> tuple[str, ...]:
        return ()

    def parts(self, m, column) -> dict[str, Column]:
        return {}

    def configs(self, view: View):
        yield {"fn": "count"}


@dataclass(frozen=True)
class PowerSum:
    """Sum (or mean) of a power of one column; contribution = per-person sum."""

    fn: str
    degree: int
    value_class: str
    averaged: bool = False
    witness = "dominance"

    def check(self, m, view: View) -> None:
        _need(m.x is None and m.y is None, f"{self.fn} takes one column")
        _need(m.column in view.measures, f"measure column {m.column!r} is not allowed")

    def guards(self, m) -> tuple[str, ...]:
        return (m.column,)

    def parts(self, m, column) -> dict[str, Column]:
        return {"_c": power(column(m.column), self.degree)}

    def configs(self, view: View):
        for column in sorted(view.measures):
            yield {"fn": self.fn, "column": column}


@dataclass(frozen=True)
class Correlation:
    fn: str = "corr"
    value_class: str = "statistic"
    witness = "influence"

    def check(self, m, view: View) -> None:
        allowed = set(view.measures) | set(view.internal_measures)
        _need(m.column is None, "corr takes x and y")
        _need(m.x in allowed and m.y in allowed, "corr columns are not allowed measures")
        _need(m.x != m.y, "corr needs two different columns")

    def guards(self, m) -> tuple[str, ...]:
        return (m.x, m.y)

    def states(self, m, column) -> dict[str, Column]:
        """Row count, means and centred second moments; Spark merges them pairwise."""
        x, y = column(m.x).cast("double"), column(m.y).cast("double")
        return {"_n": F.count(F.lit(1)), "_mx": F.avg(x), "_my": F.avg(y),
                "_vx": F.var_pop(x), "_vy": F.var_pop(y), "_cxy": F.covar_pop(x, y)}

    def about(self, x: Column, y: Column) -> dict[str, Column]:
        """A state as sums of deviations from (x, y), which add up over states."""
        n, dx, dy = F.col("_n"), F.col("_mx") - x, F.col("_my") - y
        return {"_x": n * dx, "_y": n * dy, "_xx": n * (F.col("_vx") + dx * dx),
                "_yy": n * (F.col("_vy") + dy * dy), "_xy": n * (F.col("_cxy") + dx * dy)}

    def configs(self, view: View):
        pool = sorted(set(view.measures) | set(view.internal_measures))
        for i, x in enumerate(pool):
            for y in pool[i + 1:]:
                yield {"fn": "corr", "x": x, "y": y}


PROCEDURES = {p.fn: p for p in (
    Count(),
    PowerSum("mean", 1, "magnitude", averaged=True),
    PowerSum("sum", 1, "magnitude"),
    PowerSum("sum_sq", 2, "moment2"),
    PowerSum("sum_cube", 3, "moment3"),
    PowerSum("sum_quad", 4, "moment4"),
    Correlation(),
)}


# A variance below the first share of the whole cell's second moment, or a spread
# below the second share of its mean, is rounding noise.
LOST, NOISE = 1e-12, 1e-14


def pearson(n: Column, x: Column, y: Column, xx: Column, yy: Column, xy: Column, scale) -> Column:
    """Pearson r from sums of deviations, up to rounding; NULL when a variance is zero or lost in rounding.

    ``scale`` holds for x and y the second moment and the mean that bound the rounding noise.
    """
    vx, vy = n * xx - x * x, n * yy - y * y
    seen = F.lit(True)
    for v, (moment, mean) in ((vx, scale[0]), (vy, scale[1])):
        seen = seen & (v > LOST * n * moment) & (v > F.pow(NOISE * n * mean, 2))
    return (n * xy - x * y) / F.sqrt(F.when(seen, vx)) / F.sqrt(vy)


def dominance(largest: Column, magnitude: Column, total: Column) -> Column:
    """Worse of the largest share of the magnitude and of the released total;
    infinite when either is zero or cannot be resolved."""
    worst = F.greatest(ratio(largest, magnitude), ratio(largest, F.abs(total)))
    ok = (total.cast("double") != 0.0) & (magnitude.cast("double") != 0.0) & ~F.isnan(worst)
    return F.coalesce(F.when(ok, worst), F.lit(INFINITY))
