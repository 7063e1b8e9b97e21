"""A hash tree over a table's rows, with proofs and with one version of the tree per changed row.

Leaves are ordered within their group and cut into aligned blocks of 8^4. A block's inner nodes are made in one task;
the block roots are the leaves of the next round, until each group has one node, its subroot. Subroots, ordered by
group, are the leaves of a last tree of the same kind. Rounds grow with the logarithm of the rows.

Going down again, every block gets the nodes beside its path to the root, once for all its leaves. There each changed
leaf becomes a version: it shares all nodes of the block, copies only the leaf's ancestors, and carries on with the
upper ancestors from the path that the block was handed, so upper versions are made where the leaf lies and no task ever
holds the versions of a whole group.

Defined cases: NULL groups and NULL ids come first; rows with one id are ordered by their leaf, so equal rows are leaves of
their own; a table without rows has no leaves and no root (no rows come back). Columns not named as fields are not
looked at. Texts of any length are hashed as they stand."""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.session import cut_lineage

FAN = 8
DEPTH = 4
BLOCK = FAN**DEPTH

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_STEP = "struct<left:string,right:string>"
_STEPS = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def digest(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def leaf_of(*fields: Column) -> Column:
    """Digest of the fields, each `-` if NULL, else its UTF-8 byte count, `:` and itself."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


class Tree:
    """The nodes of one block, level by level; `levels` levels up, or up to a single node if None."""

    def __init__(self, leaves: list[str], levels: int | None):
        self.nodes = [leaves]
        while levels is not None and len(self.nodes) <= levels or levels is None and len(self.nodes[-1]) > 1:
            last = self.nodes[-1]
            self.nodes.append([digest(last[i : i + FAN]) for i in range(0, len(last), FAN)])

    @property
    def top(self) -> str:
        return self.nodes[-1][0]

    def siblings(self, place: int) -> list[dict[str, str]]:
        """The rest of each run on the way from a leaf to the top."""
        steps = []
        for level in self.nodes[:-1]:
            low = place - place % FAN
            steps.append({"left": "".join(level[low:place]), "right": "".join(level[place + 1 : low + FAN])})
            place //= FAN
        return steps

    def version(self, place: int, leaf: str) -> list[str]:
        """The nodes that a tree with another leaf does not share with this one, from that leaf to the top."""
        copied = [leaf]
        for level in self.nodes[:-1]:
            low = place - place % FAN
            copied.append(digest([*level[low:place], copied[-1], *level[place + 1 : low + FAN]]))
            place //= FAN
        return copied


def place_rows(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows of (grp, digest, ..) with index (long, from 0 in the group's order) and total. Written once.

    Ranges of (grp, by) are sorted by tasks; counts per range and group, at most ranges + groups of them, give each
    range its first index. Equal rows are told apart by where they stood, so that they fill several ranges."""
    keys = [F.col(c).asc_nulls_first() for c in ("grp", *by, "stood")]
    stood = rows.withColumn("stood", F.monotonically_increasing_id())
    ranged = stood.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("stood")
    ranged = cut_lineage(ranged.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)))
    counts = ranged.groupBy("grp", "part").agg(F.min("at").alias("low"), F.count("*").alias("n"))
    group = Window.partitionBy("grp")
    before = F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    firsts = counts.select(F.col("grp").alias("g"), F.col("part").alias("p"), "low", F.coalesce(before, F.lit(0)).alias("before"), F.sum("n").over(group).alias("total"))
    joined = ranged.join(firsts, F.col("grp").eqNullSafe(F.col("g")) & (F.col("part") == F.col("p")))
    return joined.withColumn("index", F.col("at") - F.col("low") + F.col("before")).drop("at", "part", "low", "before", "g", "p")


def _levels(total: int) -> int | None:
    return DEPTH if total > BLOCK else None


def _blocks(nodes: DataFrame):
    return nodes.withColumn("block", F.floor(F.col("index") / BLOCK)).groupBy("grp", "block")


def block_roots(nodes: DataFrame) -> DataFrame:
    """The next round's nodes (grp, index, total, digest) of (grp, index, total, digest)."""
    schema = pa.schema([("grp", pa.string()), ("index", pa.int64()), ("total", pa.int64()), ("digest", pa.string())])

    def lift(block: pa.Table) -> pa.Table:
        block = block.sort_by("index")
        total = block.column("total")[0].as_py()
        tree = Tree(block.column("digest").to_pylist(), _levels(total))
        row = [block.column("grp")[0].as_py(), block.column("block")[0].as_py(), -(-total // BLOCK), tree.top]
        return pa.table([pa.array([v], type=f.type) for v, f in zip(row, schema)], schema=schema)

    return _blocks(nodes.select("grp", "index", "total", "digest")).applyInArrow(lift, "grp string, index long, total long, digest string")


def rounds(leaves: DataFrame) -> list[DataFrame]:
    """Tables of nodes, from the leaves up to one node per group."""
    tables = [leaves]
    while (tables[-1].agg(F.max("total")).first()[0] or 1) > 1:
        tables.append(cut_lineage(block_roots(tables[-1])))
    return tables


def paths_down(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """(grp, index, steps, subroot, root) of nodes, from the same of the round above."""
    schema = pa.schema([("grp", pa.string()), ("index", pa.int64()), ("steps", _STEPS), ("subroot", pa.string()), ("root", pa.string())])

    def down(block: pa.Table, upper: pa.Table) -> pa.Table:
        if not block.num_rows:
            return schema.empty_table()
        block = block.sort_by("index")
        tree = Tree(block.column("digest").to_pylist(), _levels(block.column("total")[0].as_py()))
        rest = upper.column("steps")[0].as_py()
        n = block.num_rows
        steps = [tree.siblings(i) + rest for i in range(n)]
        ends = [pa.repeat(upper.column(c)[0], n) for c in ("subroot", "root")]
        return pa.table([block.column("grp"), block.column("index"), pa.array(steps, type=_STEPS), *ends], schema=schema)

    left = _blocks(nodes.select("grp", "index", "total", "digest"))
    right = above.withColumnRenamed("index", "block").groupBy("grp", "block")
    return left.cogroup(right).applyInArrow(down, f"grp string, index long, steps array<{_STEP}>, subroot string, root string")


def tree_paths(tables: list[DataFrame], top: DataFrame) -> DataFrame:
    """Paths for the blocks of the first of `tables`, given those of the one node of each group."""
    for nodes in reversed(tables[1:]):
        top = cut_lineage(paths_down(nodes, top))
    return top


def manifest(leaves: DataFrame) -> DataFrame:
    """Proofs and versions of leaves (grp string, id long, digest, later string or NULL if the row is as it was).

    Columns: grp, id, index, digest, subroot, root, proof (digests beside the way to the root, level by level, left to
    right, in one string), version (of a changed leaf: the nodes it does not share, from the leaf to its root), folded_root
    (from the later or else the first leaf and the proof), verified (folded_root is root)."""
    placed = cut_lineage(place_rows(cut_lineage(leaves.select("grp", "id", "digest", "later")), ["id", "digest"]))
    tables = rounds(placed)
    # One node per group is left; with a single row per group that is the leaf itself, and there is no other table.
    subroots = tables[-1].select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("of"), "digest")
    groups = rounds(cut_lineage(place_rows(subroots, ["of"])))
    root = groups[-1].select("grp", F.lit(0).cast("long").alias("index"), F.array().cast(f"array<{_STEP}>").alias("steps"), F.lit("").alias("subroot"), F.col("digest").alias("root"))
    ways = paths_down(groups[0], tree_paths(groups, root)) if len(groups) > 1 else root
    named = groups[0].select(F.col("index").alias("i"), F.col("of").alias("g"), F.col("digest").alias("subroot"))
    top = ways.drop("grp", "subroot").join(named, F.col("index") == F.col("i"))
    top = cut_lineage(top.select(F.col("g").alias("grp"), F.lit(0).cast("long").alias("index"), "steps", "subroot", "root"))
    # Blocks of leaves stand below the table after the first, which `tree_paths` ends with.
    return versions(placed, tree_paths(tables, top) if len(tables) > 1 else top)


def versions(leaves: DataFrame, above: DataFrame) -> DataFrame:
    schema = pa.schema(
        [("grp", pa.string()), ("id", pa.int64()), ("index", pa.int64()), ("digest", pa.string()), ("subroot", pa.string()), ("root", pa.string())]
        + [("proof", pa.string()), ("version", pa.list_(pa.string())), ("folded_root", pa.string()), ("verified", pa.bool_())]
    )

    def prove(block: pa.Table, upper: pa.Table) -> pa.Table:
        if not block.num_rows:
            return schema.empty_table()
        block = block.sort_by("index")
        leaves = block.column("digest").to_pylist()
        tree = Tree(leaves, _levels(block.column("total")[0].as_py()))
        rest, subroot, root = (upper.column(c)[0].as_py() for c in ("steps", "subroot", "root"))
        after = "".join(s["left"] + s["right"] for s in rest)
        proofs, copied, folded = [], [], []
        for i, (leaf, later) in enumerate(zip(leaves, block.column("later").to_pylist())):
            proofs.append("".join(s["left"] + s["right"] for s in tree.siblings(i)) + after)
            nodes = tree.version(i, leaf if later is None else later)
            for s in rest:
                nodes.append(digest([s["left"], nodes[-1], s["right"]]))
            copied.append(None if later is None else nodes)
            folded.append(nodes[-1])
        n = len(leaves)
        columns = [block.column(c) for c in ("grp", "id", "index", "digest")]
        columns += [[subroot] * n, [root] * n, proofs, copied, folded, [f == root for f in folded]]
        return pa.table([c if isinstance(c, pa.ChunkedArray) else pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)

    right = above.withColumnRenamed("index", "block").groupBy("grp", "block")
    kinds = "grp string, id long, index long, digest string, subroot string, root string, proof string, version array<string>, folded_root string, verified boolean"
    return _blocks(leaves).cogroup(right).applyInArrow(prove, kinds)
