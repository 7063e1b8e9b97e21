"""Exact positions of many columns at once, with values and positions travelling as arrays.

In long form a cell of a wide table carries its keys, its row and its column name through every shuffle. Here rows are
dealt over chunks by a hash of their ids. A chunk sends, per key and column, one sorted array of its distinct values with
counts; a task that has all arrays of a key and column (or of one value range of it, where a key is large) sends back how
many rows lie before each value; and the chunk puts the positions on its rows, which it finds again by sorting the same
way. Ties are counts, so a heavy tie is one entry per chunk.

The arrays of all columns of a large table would fill the disk several times over. Beyond BATCH_CELLS cells they are sent some
columns at a time, and only the positions, a few bytes a cell, are kept until the rows get them."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.session import cut_lineage

CHUNK_ROWS = 1 << 15
BATCH_CELLS = 1 << 29


@dataclass(frozen=True)
class Cell:
    """A column to rank and the keys it is ranked within."""

    name: str
    source: str
    keys: tuple[str, ...]


@dataclass(frozen=True)
class Spots:
    """Per row of a chunk: rows with a smaller value, rows with the same value, rows of the key; where `known`."""

    known: np.ndarray
    value: np.ndarray
    before: np.ndarray
    ties: np.ndarray
    n: np.ndarray


def _sorted(table: pa.Table, source: str, label: str) -> tuple:
    """(known rows in the order of label and value, their labels as codes, labels, starts of distinct values, values)."""
    column = table.column(source).combine_chunks().cast(pa.float64())
    held = table.column(label).combine_chunks().dictionary_encode()
    known = np.flatnonzero(pc.is_valid(column).to_numpy(zero_copy_only=False))
    value = pc.fill_null(column, 0.0).to_numpy(zero_copy_only=False)[known]
    code = held.indices.to_numpy(zero_copy_only=False)[known]
    order = np.lexsort((value, code))
    value, code = value[order], code[order]
    other = (value[1:] != value[:-1]) & ~(np.isnan(value[1:]) & np.isnan(value[:-1]))
    start = np.flatnonzero(np.r_[len(value) > 0, (code[1:] != code[:-1]) | other])
    return known[order], code, held.dictionary, start, value


def _lists(flat: np.ndarray, begin: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[begin, len(flat)].astype(np.int32)), pa.array(flat))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(all elements, lengths) of a column of arrays."""
    lists = column.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


def _sent(cells: dict[int, Cell], label: dict[tuple[str, ...], str]):
    def send(table: pa.Table) -> pa.Table:
        chunk, parts = table.column("_chunk")[0].as_py(), []
        for i, cell in cells.items():
            _, code, labels, start, value = _sorted(table, cell.source, label[cell.keys])
            if not len(start):
                continue
            code = code[start]
            begin = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            times = np.diff(np.r_[start, len(value)]).astype(np.int64)
            columns = [labels.take(pa.array(code[begin])), pa.array(np.full(len(begin), i, dtype=np.int32)), pa.array(np.full(len(begin), chunk, dtype=np.int64))]
            parts.append(pa.table([*columns, _lists(value[start], begin), _lists(times, begin)], schema=_SENT))
        return pa.concat_tables(parts) if parts else _SENT.empty_table()

    return send


_SENT = pa.schema([("_label", pa.string()), ("_cell", pa.int32()), ("_chunk", pa.int64()), ("_values", pa.list_(pa.float64())), ("_times", pa.list_(pa.int64()))])
_SENT_SQL = "_label string, _cell int, _chunk long, _values array<double>, _times array<long>"
_BACK_SQL = "_label string, _cell int, _range int, _chunk long, _before array<long>, _ties array<long>, _in_range long"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrays of large keys in the pieces that their cuts make."""
    for batch in batches:
        rows = {k: [] for k in ("_label", "_cell", "_range", "_chunk", "_values", "_times")}
        for label, cell, chunk, cuts, values, times in zip(*(batch.column(c) for c in ("_label", "_cell", "_chunk", "_cuts", "_values", "_times"))):
            v, t = values.values.to_numpy(), times.values.to_numpy()
            at = np.searchsorted(v, cuts.values.to_numpy(), side="right") if cuts.is_valid else np.zeros(0, dtype=np.int64)
            ends = np.r_[0, at, len(v)]
            for i in np.flatnonzero(np.diff(ends)):
                for k, x in (("_label", label.as_py()), ("_cell", cell.as_py()), ("_range", int(i)), ("_chunk", chunk.as_py())):
                    rows[k].append(x)
                rows["_values"].append(v[ends[i] : ends[i + 1]])
                rows["_times"].append(t[ends[i] : ends[i + 1]])
        types = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64())]
        yield pa.record_batch([pa.array(x, type=t) for x, t in zip(rows.values(), types)], names=list(rows))


def _counted(table: pa.Table) -> pa.Table:
    """Rows before each value of each array, as steps from value to value, and rows that share it."""
    value, size = _flat(table.column("_values"))
    times, _ = _flat(table.column("_times"))
    order = np.argsort(value, kind="stable")
    value = value[order]
    new = np.r_[True, (value[1:] != value[:-1]) & ~(np.isnan(value[1:]) & np.isnan(value[:-1]))]
    total = np.add.reduceat(times[order], np.flatnonzero(new))
    before, ties, which = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64), np.cumsum(new) - 1
    before[order], ties[order] = (np.cumsum(total) - total)[which], total[which]
    begin = np.cumsum(size) - size
    steps = np.diff(before, prepend=0)
    steps[begin] = before[begin]
    n = pa.array(np.full(table.num_rows, total.sum(), dtype=np.int64))
    columns = [table.column(c) for c in ("_label", "_cell", "_range", "_chunk")]
    names = ["_label", "_cell", "_range", "_chunk", "_before", "_ties", "_in_range"]
    return pa.table([*columns, _lists(steps, begin), _lists(ties, begin), n], names=names)


def _found(table: pa.Table, back: pa.Table, i: int, cell: Cell, label: str) -> Spots:
    """The positions of a cell on the rows of its chunk."""
    rows, code, labels, start, _ = _sorted(table, cell.source, label)
    size = table.num_rows
    spots = Spots(np.zeros(size, dtype=bool), np.zeros(size), *(np.zeros(size, dtype=np.int64) for _ in range(3)))
    if not len(start):
        return spots
    mine = back.filter(pc.equal(back.column("_cell"), i))
    codes = pc.index_in(mine.column("_label"), value_set=labels).to_numpy()
    mine = mine.take(pa.array(np.lexsort((mine.column("_range").to_numpy(), codes))))
    steps, lengths = _flat(mine.column("_before"))
    if len(steps) != len(start):
        raise ValueError("rows of a chunk changed between two reads: rank a written table")
    begin = np.cumsum(lengths) - lengths
    run = np.cumsum(steps)
    before = run - np.repeat(run[begin] - steps[begin], lengths) + np.repeat(mine.column("_offset").to_numpy(), lengths)
    each = np.diff(np.r_[start, len(rows)])
    spots.known[rows] = True
    spots.before[rows] = np.repeat(before, each)
    spots.ties[rows] = np.repeat(_flat(mine.column("_ties"))[0], each)
    spots.n[rows] = np.repeat(np.repeat(mine.column("_n").to_numpy(), lengths), each)
    spots.value[rows] = table.column(cell.source).combine_chunks().cast(pa.float64()).take(pa.array(rows)).to_numpy(zero_copy_only=False)
    return spots


def _answers(chunks: DataFrame, cells: dict[int, Cell], label: dict[tuple[str, ...], str], hashed: Column, whole_keys: bool, rows_per_split: int, max_splits: int) -> DataFrame:
    """What chunks get back for these cells; `whole_keys` if no key has more than `rows_per_split` rows."""
    sent = chunks.groupBy("_chunk").applyInArrow(_sent(cells, label), _SENT_SQL)
    if whole_keys:
        pieces = sent.withColumn("_range", F.lit(0))
    else:
        drawn = chunks.select("*", hashed.alias("_hash")).where(F.pmod("_hash", F.lit(rows_per_split)) == 0)
        stacked = ", ".join(f"{i}, `{label[c.keys]}`, cast(`{c.source}` as double)" for i, c in cells.items())
        bucket = F.pmod(F.xxhash64("_hash"), F.lit(max_splits)).alias("_bucket")
        drawn = drawn.select("_hash", bucket, F.expr(f"stack({len(cells)}, {stacked}) as (_cell, _label, _value)")).where("_value is not null")
        drawn = drawn.groupBy("_label", "_cell", "_bucket").agg(F.min_by("_value", "_hash").alias("_value"))
        cuts = drawn.groupBy("_label", "_cell").agg(F.sort_array(F.collect_set("_value")).alias("_cuts"))
        types = "_label string, _cell int, _range int, _chunk long, _values array<double>, _times array<long>"
        pieces = sent.join(cuts, ["_label", "_cell"], "left").mapInArrow(_cut, types)
    back = pieces.groupBy("_label", "_cell", "_range").applyInArrow(_counted, _BACK_SQL)
    if whole_keys:
        return back.select("*", F.lit(0).cast("long").alias("_offset"), F.col("_in_range").alias("_n"))
    total = F.aggregate("_times", F.lit(0).cast("long"), lambda a, x: a + x)
    counts = pieces.select("_label", "_cell", "_range", total.alias("_t")).groupBy("_label", "_cell", "_range").agg(F.sum("_t").alias("_t"))
    ordered = "over (partition by _label, _cell order by _range)"
    whole = counts.selectExpr("_label", "_cell", "_range", f"sum(_t) {ordered} - _t as _offset", "sum(_t) over (partition by _label, _cell) as _n")
    return back.join(whole, ["_label", "_cell", "_range"])


def with_spots(
    df: DataFrame, cells: list[Cell], ids: list[str], put: Callable[[pa.Table, list[Spots]], pa.Table], schema: str, rows_per_split: int, max_splits: int, chunk_rows: int = CHUNK_ROWS, batch_cells: int = BATCH_CELLS
) -> DataFrame:
    """What `put` makes of each chunk's rows and the positions of its cells. `df` is read more than once and must give the
    same rows each time, so pass a written table or something made from one row by row."""
    label = {keys: f"_label{i}" for i, keys in enumerate(dict.fromkeys(c.keys for c in cells))}
    # A key as text: NULL stays apart from every value.
    named = [F.to_json(F.array(*[F.col(f"`{k}`").cast("string") for k in keys])).alias(name) for keys, name in label.items()]
    n = df.count()
    hashed = F.xxhash64(*[F.col(f"`{c}`") for c in ids])
    chunks = df.select("*", *named, F.pmod(hashed, F.lit(max(1, -(-n // chunk_rows)))).alias("_chunk"))
    numbered = list(enumerate(cells))
    some = max(1, batch_cells // max(n, 1))
    if some >= len(cells):
        back = _answers(chunks, dict(numbered), label, hashed, n <= rows_per_split, rows_per_split, max_splits)
    else:
        parts = []
        for at in range(0, len(cells), some):
            batch = dict(numbered[at : at + some])
            read = dict.fromkeys([*ids, *[c.source for c in batch.values()], *[label[c.keys] for c in batch.values()], "_chunk"])
            narrow = chunks.select(*[F.col(f"`{c}`") for c in read])
            parts.append(cut_lineage(_answers(narrow, batch, label, hashed, n <= rows_per_split, rows_per_split, max_splits)))
        back = functools.reduce(DataFrame.unionByName, parts)

    def give(table: pa.Table, answers: pa.Table) -> pa.Table:
        return put(table, [_found(table, answers, i, c, label[c.keys]) for i, c in enumerate(cells)])

    return chunks.groupBy("_chunk").cogroup(back.groupBy("_chunk")).applyInArrow(give, schema)


def once_per_row(table: pa.Table, keys: list[str], found: dict[str, pa.Array]) -> tuple[np.ndarray, np.ndarray, dict[str, pa.Array]]:
    """(first row of each distinct `keys`, number of each row's keys, the greatest of what its rows found)."""
    rows = table.select(keys).append_column("_at", pa.array(np.arange(table.num_rows)))
    groups = rows.group_by(keys, use_threads=False).aggregate([("_at", "list")]).column("_at_list").combine_chunks()
    at, size = _flat(pa.chunked_array([groups]))
    number = np.empty(table.num_rows, dtype=np.int64)
    number[at] = np.repeat(np.arange(len(groups)), size)
    first = at[np.cumsum(size) - size]
    if len(groups) == table.num_rows:
        return first, number, {k: v.take(pa.array(first)) for k, v in found.items()}
    grouped = pa.table({"_g": pa.array(number), **found}).group_by("_g", use_threads=False).aggregate([(k, "max") for k in found]).sort_by("_g")
    return first, number, {k: grouped.column(f"{k}_max").combine_chunks() for k in found}
