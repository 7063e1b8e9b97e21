"""Mixing sources to target weights.

Sources in code-point order (NULL last) weigh 1, 2, 3, 1, 2, 3, ... and share all words by weight; a source's target
stops at `max_epochs` times its words and what is left over is shared again by weight. A source is then repeated in
whole epochs, and the rest of its target is filled with documents in the order of their hashed keys: keys cut a source
into ranges, sums of ranges give each range its offset, and a running sum inside a range places each document. The
document in which the budget ends gives only its first words, so a source's mix ends exactly at its budget.

A document with a NULL doc_id is keyed by its size, so that those of one size are alike. NULL and empty texts have size 0
and give nothing; a source without words has target 0. Ties in keys are broken by doc_id and size, then by a hash of the row
where rows are kept; equal rows of one doc_id by nothing: one of them comes first. No source is ever held by one task: the number of ranges grows with its documents."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from panelwright.llm.words import pieces, word_counts
from panelwright.session import cut_lineage

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
RANGE_ROWS = 20_000  # documents of one key range, about
SEED = "mix-1"


def sizes(docs: DataFrame, text: str = "text", keep: bool = False) -> DataFrame:
    """(doc_id, source, size): words of every whole text; with `keep` also `row`, a struct of all columns."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, "text"):
            size = pa.array(word_counts(piece.column("text")), type=pa.int64())
            yield pa.record_batch([*(piece.column(c) for c in names), size], names=[*names, "size"])

    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select("doc_id", F.col("source").cast("string"), *([held] if keep else []), F.col(f"`{text}`").alias("text"))
    names = rows.columns[:-1]
    schema = StructType([*rows.schema.fields[:-1], StructField("size", LongType())])
    return rows.mapInArrow(count, schema)


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_docs, target), one row per source.

    Sharing again until no source is above its stop ends at min(stop, weight * level) for one level. In the order of
    stop / weight the stopped sources come first, so running sums over the one row per source give the level."""
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*[F.lit(w) for w in weights]), F.pmod(place, F.lit(len(weights))))
    rows = totals.select("*", weight.cast("long").alias("weight"), (F.col("source_size") * max_epochs).alias("stop"))
    order = Window.orderBy((F.col("stop") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # With the sources before this one stopped, what would a unit of weight get?
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("stop").over(before), F.lit(0))) / F.sum("weight").over(rest)
    rows = rows.withColumn("level", level.cast("double"))
    stopped = F.col("stop") <= F.col("level") * F.col("weight")
    rows = rows.withColumn("level", F.min(F.when(~stopped, F.struct(F.col("stop") / F.col("weight"), "level"))).over(everything)["level"])
    target = F.least(F.col("stop").cast("double"), F.coalesce(F.col("level") * F.col("weight"), F.col("stop").cast("double")))
    return rows.select("source", "source_size", "n_docs", target.alias("target"))


def key(seed: str = SEED) -> Column:
    """Hash of doc_id, or of the size where that is NULL."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("size "), F.col("size").cast("string")))))


def mix(sized: DataFrame, goals: DataFrame, seed: str = SEED, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) for every document, and its `row` where that was kept."""
    held = ["row"] if "row" in sized.columns else []
    goal = goals.select(F.col("source").alias("__source"), "source_size", "n_docs", "target")
    rows = sized.join(goal, F.col("source").eqNullSafe(F.col("__source"))).withColumn("key", key(seed))
    # The first 7 hex digits of the key in equal steps: as many ranges as the source's documents need.
    ranges = F.least(F.ceil(F.col("n_docs") / range_rows), F.lit(1 << 28))
    lead = F.conv(F.substring("key", 1, 7), 16, 10).cast("long")
    rows = rows.withColumn("range", F.floor(lead * ranges / F.lit(float(1 << 28))))
    parts = rows.groupBy("__source", "range").agg(F.sum("size").alias("words"))
    offset = F.sum("words").over(Window.partitionBy("__source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(F.col("__source").alias("__s"), F.col("range").alias("__r"), F.coalesce(offset, F.lit(0)).alias("offset"))
    rows = rows.join(parts, F.col("__source").eqNullSafe(F.col("__s")) & (F.col("range") == F.col("__r")))
    inside = Window.partitionBy("__source", "range").orderBy("key", "doc_id", "size", *[F.xxhash64(c) for c in held]).rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.floor("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    left = budget - epochs * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), left - before))
    return rows.select("doc_id", "source", *held, "size", "source_size", "target", (epochs * F.col("size") + part).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, text: str = "text", seed: str = SEED, range_rows: int = RANGE_ROWS, keep: bool = False) -> DataFrame:
    """Sizes are written once, so that texts are counted once; totals, ranges and sums read the small columns. With
    `keep` rows travel with their sizes, so that no id is needed to find them again."""
    sized = cut_lineage(sizes(docs, text, keep))
    return mix(sized, targets(sized), seed, range_rows)


def taken_text(text: Column, size: Column, taken: Column) -> Column:
    """A document as often as the mix takes it, and the first words of the last time."""
    whole = F.when(size > 0, F.floor(taken / size)).otherwise(0).cast("int")
    words = F.filter(F.split(text, r"[ \t-\r]+"), lambda w: w != "")
    part = F.array_join(F.slice(words, 1, (taken - whole * size).cast("int")), " ")
    return F.concat_ws("\n", F.array_repeat(text, whole), F.when(part != "", part))
