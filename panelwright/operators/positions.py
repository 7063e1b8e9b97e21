"""Exact positions of values inside groups of any size.

A window over a whole group puts that group into one task, which fails when one group holds a third of
the table. Here a group that is large gets cut into value ranges first:

1. a row-hash sample of each key gives the cut points (at most `max_splits` per key; a key with fewer than
   about `rows_per_split` rows normally gets none and stays whole);
2. every row finds its range; a value drawn more than once in the sample is a heavy tie and gets a range of
   its own, spread over `tie_salts` tasks;
3. one window per (key, range) gives local ranks, and range counts give the offsets.

The sample only decides how the work is spread. It depends on the rows' own hashes, never on partition
order, so a recomputed task sees the same cuts and positions are exact for any sample.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from panelwright.operators.chunks import Cell, Spots, once_per_row, with_spots
from panelwright.session import cut_lineage


@dataclass(frozen=True)
class SplitPlan:
    rows_per_split: int = 1 << 20
    max_splits: int = 1024
    tie_salts: int = 64


DEFAULT_PLAN = SplitPlan()
# Rows with all their columns go into the ranges of a numbering, so ranges are small: the largest of many drawn at random
# is several times the mean.
NUMBERING = SplitPlan(rows_per_split=1 << 16, max_splits=1 << 13)
_STEP = 32  # cuts are searched in two steps of at most about sqrt(max_splits) comparisons

# Written as SQL text: one statement is one call into the JVM and one analysis.
_CUTS = """
drawn AS (
  SELECT <keys>, min_by(<value>, _hash) AS _cut
  FROM (SELECT *, xxhash64(<ids>) AS _hash FROM known) WHERE pmod(_hash, <rows_per_split>L) = 0
  GROUP BY <keys>, pmod(xxhash64(<ids>, 1), <max_splits>L)),
sorted AS (SELECT <keys>, sort_array(collect_list(_cut)) AS _drawn FROM drawn GROUP BY <keys>),
cuts AS (
  SELECT <keys>, array_distinct(_drawn) AS _cuts,
         array_distinct(filter(_drawn, (x, i) -> get(_drawn, i - 1) = x)) AS _heavy,
         filter(array_distinct(_drawn), (x, i) -> i % <step> = <step> - 1) AS _coarse
  FROM sorted)"""

_PLACED = """
searched AS (
  SELECT known.*, _cuts, size(filter(_coarse, x -> x < <value>)) AS _skip, array_contains(_heavy, <value>) AS _tied
  FROM known LEFT JOIN cuts ON <same_cuts>),
placed AS (
  SELECT <columns>, _cuts IS NOT NULL AS _was_cut,
         CASE WHEN _cuts IS NULL THEN 0L ELSE 2L * (_skip * <step>
              + size(filter(slice(_cuts, _skip * <step> + 1, <step>), x -> x < <value>))) + cast(_tied AS bigint) END AS _range,
         CASE WHEN _tied THEN pmod(xxhash64(<ids>), <tie_salts>L) ELSE 0L END AS _salt
  FROM searched),
counted AS (SELECT <keys>, _range, count(*) AS _in_range FROM placed WHERE _was_cut GROUP BY <keys>, _range),
summed AS (
  SELECT *, sum(_in_range) OVER (PARTITION BY <keys> ORDER BY _range) - _in_range AS _offset,
         sum(_in_range) OVER (PARTITION BY <keys>) AS _in_key
  FROM counted),
ranges AS (
  SELECT <keys>, _range AS _at_range, _in_range, _offset, _in_key,
         explode(sequence(0L, CASE WHEN _range % 2 = 1 THEN <tie_salts>L - 1 ELSE 0L END)) AS _at_salt
  FROM summed)"""

_SPLIT = f"{_CUTS},{_PLACED}"
_WITH_WRITTEN_CUTS = f"cuts AS (SELECT * FROM {{cuts}}),{_PLACED}"

_POSITIONS = """
WITH known AS (SELECT * FROM {rows} WHERE <value> IS NOT NULL), <split>,
local AS (
  SELECT *, rank() OVER (PARTITION BY <keys>, _range, _salt ORDER BY <value>) AS _rank,
         count(*) OVER (PARTITION BY <keys>, _range, _salt ORDER BY <value>
                        RANGE BETWEEN CURRENT ROW AND CURRENT ROW) AS _same,
         count(*) OVER (PARTITION BY <keys>, _range, _salt) AS _rows
  FROM placed)
SELECT <local_columns>,
       coalesce(_offset, 0L) + CASE WHEN _range % 2 = 1 THEN 0L ELSE _rank - 1L END AS _before,
       CASE WHEN _range % 2 = 1 THEN _in_range ELSE _same END AS _ties,
       coalesce(_in_key, _rows) AS _n
FROM local LEFT JOIN ranges ON _range = _at_range AND _salt = _at_salt AND <same_ranges>"""

_ROW_NUMBER = """
WITH known AS (SELECT * FROM {rows}), <split>,
local AS (
  SELECT *, row_number() OVER (PARTITION BY <keys>, _range, _salt ORDER BY <value>) AS _row FROM placed)
SELECT <local_columns>, cast(coalesce(_offset, 0L) + _row AS int) AS <name>
FROM local LEFT JOIN ranges ON _range = _at_range AND _salt = _at_salt AND <same_ranges>"""


def quoted(names: list[str]) -> str:
    return ", ".join(f"`{n}`" for n in names)


def _fill(text: str, rows: DataFrame, keys: list[str], value: str, ids: list[str], plan: SplitPlan, **more: str) -> str:
    parts = {
        "split": _SPLIT,
        "columns": quoted(rows.columns),
        "local_columns": ", ".join(f"local.`{c}`" for c in rows.columns),
        "same_cuts": " AND ".join(f"known.`{k}` <=> cuts.`{k}`" for k in keys),
        "same_ranges": " AND ".join(f"local.`{k}` <=> ranges.`{k}`" for k in keys),
        "keys": quoted(keys),
        "value": f"`{value}`",
        "ids": quoted(ids),
        "step": str(_STEP),
        "rows_per_split": str(plan.rows_per_split),
        "max_splits": str(plan.max_splits),
        "tie_salts": str(plan.tie_salts),
        **more,
    }
    for name, part in parts.items():
        text = text.replace(f"<{name}>", part)
    return text


def _cuts(rows: DataFrame, keys: list[str], value: str, ids: list[str], plan: SplitPlan) -> DataFrame:
    """The cut points of large keys. Written, so that their size is known before the rows meet them: joined as a plan of
    unknown size, they would have all rows shuffled by key first."""
    text = "WITH known AS (SELECT * FROM {rows} WHERE <value> IS NOT NULL), <split> SELECT * FROM cuts"
    return cut_lineage(rows.sparkSession.sql(_fill(text, rows, keys, value, ids, plan, split=_CUTS), rows=rows))


def with_positions(
    rows: DataFrame, keys: list[str], value: str, ids: list[str], plan: SplitPlan = DEFAULT_PLAN
) -> DataFrame:
    """Keep rows with a value and add, per key: `_before` (rows with a smaller value), `_ties` (rows with the
    same value, itself included) and `_n` (rows). NULL is a key like any other; `ids` identify a row."""
    return rows.sparkSession.sql(_fill(_POSITIONS, rows, keys, value, ids, plan, split=_WITH_WRITTEN_CUTS), rows=rows, cuts=_cuts(rows, keys, value, ids, plan))


def with_row_number(
    rows: DataFrame, keys: list[str], order: list[str], ids: list[str], name: str, plan: SplitPlan = DEFAULT_PLAN
) -> DataFrame:
    """Row number per key over a full order: the `order` expressions must end in something unique per key."""
    ordered = rows.selectExpr("*", "struct(" + ", ".join(f"{c} AS o{i}" for i, c in enumerate(order)) + ") AS _order")
    text = _fill(_ROW_NUMBER, ordered, keys, "_order", ids, plan, split=_WITH_WRITTEN_CUTS, name=f"`{name}`")
    return rows.sparkSession.sql(text, rows=ordered, cuts=_cuts(ordered, keys, "_order", ids, plan)).drop("_order")


def add_percentiles(
    df: DataFrame,
    keys: list[str],
    ids: list[str],
    columns: dict[str, str],
    plan: SplitPlan = DEFAULT_PLAN,
    narrower: dict[str, dict[str, str]] | None = None,
) -> DataFrame:
    """Add percentile columns `{name: source}` within `keys`: average rank over the number of known values, in
    (0, 1]; missing values stay missing.

    `narrower` adds columns ranked within `keys` plus one more column. Values and positions of all columns travel as
    arrays (operators/chunks.py). `df` is read more than once, so pass a written table. Rows of one `ids` share the
    greatest of their percentiles; rows with a NULL in `ids` have none."""
    cells = [Cell(name, source, tuple(keys)) for name, source in columns.items()]
    for extra, more in (narrower or {}).items():
        cells += [Cell(name, source, (*keys, extra)) for name, source in more.items()]
    kept = df.columns

    def put(table: pa.Table, spots: list[Spots]) -> pa.Table:
        ranked = {}
        for cell, s in zip(cells, spots):
            percentile = (s.before + (s.ties + 1) / 2.0) / np.maximum(s.n, 1)
            ranked[cell.name] = pa.array(percentile, mask=~s.known)
        _, number, ranked = once_per_row(table, ids, ranked)
        whole = pc.invert(functools.reduce(pc.or_, [pc.is_null(table.column(c).combine_chunks()) for c in ids]))
        out = [pc.if_else(whole, a.take(pa.array(number)), None) for a in ranked.values()]
        return pa.table([*(table.column(c) for c in kept), *out], names=[*kept, *ranked])

    schema = StructType([*df.schema.fields, *[StructField(c.name, DoubleType()) for c in cells]])
    return with_spots(df, cells, ids, put, schema, plan.rows_per_split, plan.max_splits)


def quantiles(
    rows: DataFrame,
    keys: list[str],
    value: str,
    ids: list[str],
    fractions: dict[str, tuple[int, int]],
    plan: SplitPlan = DEFAULT_PLAN,
) -> DataFrame:
    """Exact linearly interpolated quantiles per key; `{name: (numerator, denominator)}`.

    Picks the values at the two neighbouring positions, so no group is ever held in memory."""
    spots = with_positions(rows.select(*dict.fromkeys([*keys, *ids, value])), keys, value, ids, plan)
    picks, out = [], []
    for name, (num, den) in fractions.items():
        low = f"({num} * (_n - 1) div {den})"
        for side, position in (("lo", low), ("hi", f"least({low} + 1, _n - 1)")):
            here = f"_before <= {position} AND {position} < _before + _ties"
            picks.append(F.expr(f"max(CASE WHEN {here} THEN `{value}` END) AS `_{name}_{side}`"))
        picks.append(F.expr(f"max(({num} * (_n - 1)) % {den} / cast({den} as double)) AS `_{name}_part`"))
        out.append(f"`_{name}_lo` + (`_{name}_hi` - `_{name}_lo`) * `_{name}_part` AS `{name}`")
    return spots.groupBy(*keys).agg(*picks).selectExpr(*[f"`{k}`" for k in keys], *out)


def medians(rows, keys, value, ids, name, plan: SplitPlan = DEFAULT_PLAN) -> DataFrame:
    return quantiles(rows, keys, value, ids, {name: (1, 2)}, plan)
