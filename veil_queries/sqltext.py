"""Shared pieces of the checking SQL."""

from __future__ import annotations

SALES = """
sales AS (
  SELECT o.o_orderkey, o.o_custkey AS person, r.r_name, n.n_name, c.c_mktsegment, o.o_orderpriority,
         o.o_orderstatus, CAST(year(o.o_orderdate) AS INTEGER) AS order_year,
         CAST(month(o.o_orderdate) AS INTEGER) AS order_month,
         o.o_orderpriority = '1-URGENT' AS is_urgent,
         CAST(o.o_totalprice AS DECIMAL(12,2)) AS o_totalprice,
         CAST(floor(c.c_acctbal) AS INTEGER) AS balance,
         CAST(c.c_acctbal AS DECIMAL(12,2)) AS c_acctbal
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

CUSTOMER_SALES = """
customer_sales AS (
  SELECT c.c_custkey AS person, r.r_name, n.n_name, c.c_mktsegment,
         CAST(c.c_acctbal AS DECIMAL(12,2)) AS c_acctbal,
         SUM(CASE WHEN o.o_orderstatus IN ('F','O','P') THEN CAST(o.o_totalprice AS DECIMAL(12,2)) ELSE 0 END) AS total_price,
         SUM(CASE WHEN o.o_orderstatus IN ('O','P') THEN CAST(o.o_totalprice AS DECIMAL(12,2)) ELSE 0 END) AS open_price,
         CAST(SUM(CASE WHEN o.o_orderstatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS open_orders,
         CAST(SUM(CASE WHEN o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS urgent_orders
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN orders o ON c.c_custkey = o.o_custkey
  GROUP BY c.c_custkey, r.r_name, n.n_name, c.c_mktsegment, c.c_acctbal)"""

LINES = """
lines AS (
  SELECT o.o_custkey AS person, l.l_returnflag, l.l_linestatus, c.c_mktsegment,
         CAST(year(l.l_shipdate) AS INTEGER) AS ship_year,
         CAST(l.l_quantity AS DECIMAL(12,2)) AS l_quantity,
         CAST(l.l_extendedprice AS DECIMAL(12,2)) AS l_extendedprice,
         CAST(l.l_discount AS DECIMAL(12,2)) AS l_discount
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey)"""

CLICKS = """
clicks AS (
  SELECT user_id AS person, event_type, CAST(floor(hour(ts) / 6) AS INTEGER) AS hour_band,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS day,
         CAST(value AS DECIMAL(12,2)) AS value
  FROM events)"""


def half_up(total: str, count: str) -> str:
    """total / count to two places, ties away from zero, in integer arithmetic.

    ``total`` has two decimals."""
    cents = f"CAST(({total}) * 100 AS BIGINT)"
    return (f"(sign({cents}) * ((2 * abs({cents}) + {count}) // (2 * {count}))) / 100.0")


def share(c: str) -> str:
    """Dominance of per-person sums ``c``: infinite when a total is zero."""
    return (f"CASE WHEN SUM(abs({c})) = 0 OR SUM({c}) = 0 OR SUM({c}) IS NULL THEN CAST('Infinity' AS DOUBLE) "
            f"ELSE GREATEST(CAST(MAX(abs({c})) AS DOUBLE) / CAST(SUM(abs({c})) AS DOUBLE), "
            f"CAST(MAX(abs({c})) AS DOUBLE) / CAST(abs(SUM({c})) AS DOUBLE)) END")


def cells(source: str, keys: str, column: str, where: str = "TRUE", value: str = "sum",
          c: str | None = None, name: str = "cells") -> str:
    """A cell table with value, n, n_persons and dominance as two CTEs."""
    group = f"{keys}, " if keys else ""
    tail = f"GROUP BY {keys}" if keys else ""
    c = c or column
    val = {"sum": "SUM(c)", "mean": half_up("SUM(c)", "SUM(rows)")}[value]
    return f"""
{name}_p AS (SELECT {group}person, COUNT(*) AS rows, SUM({c}) AS c
  FROM {source} WHERE ({where}) AND {column} IS NOT NULL GROUP BY {group}person),
{name} AS (SELECT {group}{val} AS value, CAST(SUM(rows) AS BIGINT) AS n, COUNT(*) AS n_persons,
  {share('c')} AS dominance FROM {name}_p {tail})"""


def ring(n: str, base: int = 5) -> str:
    return f"CAST(round({n} / {base}.0) * {base} AS BIGINT)"


def complementary(source: str, keys: list[str], sweeps: int = 4, base: int = 5) -> tuple[str, str]:
    """Unrolled complementary suppression over a table with a boolean ``out``.

    Returns (CTEs, name of the last one).  Extra sweeps change nothing.
    """
    text = " || '|' || ".join(f"coalesce(CAST({k} AS VARCHAR), '')" for k in keys)
    parts, prev = [], source
    margins = [[]] if len(keys) == 1 else [[k] for k in keys] * sweeps
    for i, margin in enumerate(margins):
        over = f"PARTITION BY {margin[0]}" if margin else ""
        order = f"{over} ORDER BY out, round(n / {base}.0), {text}"
        parts.append(f"""
cs{i} AS (SELECT * EXCLUDE (gone, pick), out OR (gone = 1 AND pick = 1 AND NOT out) AS out_next FROM (
  SELECT *, SUM(CASE WHEN out THEN 1 ELSE 0 END) OVER ({over}) AS gone,
         row_number() OVER ({order}) AS pick FROM {prev})),
cn{i} AS (SELECT * EXCLUDE (out, out_next), out_next AS out FROM cs{i})""")
        prev = f"cn{i}"
    return ",".join(parts), prev


def canon(x: str) -> str:
    """A number's text as sign, digits and exponent, from whatever text SQL gives it."""
    return (f"list_transform(list_transform(list_transform([CAST({x} AS VARCHAR)], "
            "lambda t: {'m': replace(split_part(lower(t), 'e', 1), '-', ''), "
            "'e': coalesce(TRY_CAST(replace(split_part(lower(t), 'e', 2), '+', '') AS INTEGER), 0), "
            "'s': CASE WHEN starts_with(t, '-') THEN '-' ELSE '' END}), "
            "lambda q: {'a': ltrim(replace(q.m, '.', ''), '0'), 'x': q.e - length(split_part(q.m, '.', 2)), 's': q.s}), "
            "lambda r: CASE WHEN r.a = '' THEN '0e0' ELSE r.s || rtrim(r.a, '0') || 'e' || "
            "CAST(r.x + length(r.a) - length(rtrim(r.a, '0')) AS VARCHAR) END)[1]")


def field(text: str) -> str:
    """Text with its length before it, or a tilde."""
    return f"coalesce(CAST(length({text}) AS VARCHAR) || ':' || {text}, '~')"


def row_text(columns: dict[str, str]) -> str:
    """Names and values of a row: column → SQL of its canonical text."""
    return " || ".join(f"'{len(c)}:{c}' || {field(columns[c])}" for c in sorted(columns))


def digest_of(source: str, columns: dict[str, str], group: str = "") -> str:
    """SELECT of a table's digest: group, rows, digest."""
    lead, tail = (f"{group}, ", f"GROUP BY {group}") if group else ("", "")
    parts = ", ".join(f"SUM(CAST('0x' || substr(d, {1 + 15 * i}, 15) AS BIGINT)) AS p{i}" for i in range(4))
    return (f"SELECT {lead}rows, sha256(CAST(rows AS VARCHAR) || '|' || coalesce(p0, 0) || '|' || coalesce(p1, 0) || '|' || coalesce(p2, 0) || '|' "
            f"|| coalesce(p3, 0)) AS digest FROM (SELECT {lead}COUNT(*) AS rows, {parts} FROM (SELECT {lead}sha256({row_text(columns)}) AS d FROM {source}) {tail})")
