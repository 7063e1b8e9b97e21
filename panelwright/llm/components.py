"""Connected components of a table of links, without collecting them: by alternating stars for any links, and by
jumping to parents' parents where every row has one parent at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in links (a, b).

    Each round hangs larger neighbours on a node's smallest one, then smaller ones, until no link changes; the number
    of rounds grows with the logarithm of the longest chain. NULL ends and self-links are left out."""
    edges = cut_lineage(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u"))).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("low")).select(F.col("u").alias("n"), F.least("low", "u").alias("low"))
        large = both.join(low, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("low")).withColumnRenamed("u", "n")
        hung = large.join(least, F.col("u") == F.col("n"))
        small = hung.select(F.col("v").alias("u"), F.col("low").alias("v")).where("u > v").union(least.select("n", "low"))
        edges = cut_lineage(small.distinct().toDF("u", "v"))
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def forest_roots(parents: DataFrame) -> DataFrame:
    """(id, root) for parents (id, parent): one row for each id, no cycles, no NULLs.

    Each round takes the rows whose root is not known one parent's jump further, which doubles the way; the number of
    rounds grows with the logarithm of the deepest tree. Rows that have reached their root are only looked up. A cycle
    is an error."""
    todo, known, rounds = cut_lineage(parents.select("id", "parent")), None, 0
    while not todo.isEmpty():
        rounds += 1
        if rounds > 64:
            raise ValueError("the parents have a cycle")
        table = todo if known is None else known.union(todo)
        above = table.select(F.col("id").alias("parent"), F.col("parent").alias("above"))
        moved = cut_lineage(todo.join(above, "parent", "left").select("id", "parent", "above"))
        reached = moved.where("above is null").select("id", "parent")
        known = reached if known is None else known.union(reached)
        todo = moved.where("above is not null").select("id", F.col("above").alias("parent"))
    rows = todo if known is None else known
    return rows.select("id", F.col("parent").alias("root"))
