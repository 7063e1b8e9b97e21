"""N-gram Jaccard join: a grouped prefix join, and the components of its links.

A text's set holds its distinct runs of `n` words (A-Z lower-cased), as 64-bit hashes; a shorter text is one run.
Texts link when 100 * common >= percent * united.

Sets are ordered rarest first by a sketch of counts over all texts (any order gives the same links; this one keeps
common phrases out of prefixes). Two linked sets share a run in their prefixes. Texts with equal sets are one
representative; representatives with equal prefixes and sizes are one group, and groups meet by the runs of their prefix.

1. Each group meets only its neighbour and the first group under a run, and is verified against the one of these that
   shares most of its prefix, which joins the members of a large group of near copies by a number of pairs in proportion to its size.
2. The same with neighbours of other components in some more orders, drawn by hash: families whose members are linked
   with many others, but not with that one, become few components, again by a number of pairs in proportion to their size.
3. Then only groups of different components meet, under runs that can be the first common one of a link. A pair whose
   shared prefix runs leave room for a link is expanded to members and verified. So no link between components is
   missed, and copies are never expanded into pairs. Components are then joined by the links between them.

NULL, empty and wordless texts have empty sets and are linked with nothing. doc_id identifies a text; repeated rows
repeat in the result."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.llm.components import components, forest_roots
from panelwright.llm.words import Words, mixed, pieces, runs, within, words_of
from panelwright.session import cut_lineage

SKETCH_BITS = 22  # counters of the sketch: 16 MB whatever the input
BLOCK = 1 << 14  # counters that are summed together
FILTER_BITS = 23  # of the filter of ids: 1 MB whatever the input
ORDERS = 8  # of the groups under a run, in which neighbours are verified before all pairs of components meet
TURNS = 3  # of drawing and joining


@dataclass(frozen=True)
class Likeness:
    n: int = 5
    percent: int = 80

    def least(self, size: Column) -> Column:
        """Common runs that a set of this size needs."""
        return F.ceil(size * self.percent / 100)

    def prefix(self, size: Column) -> Column:
        return size - self.least(size) + 1

    def sizes_fit(self, a: Column, b: Column) -> Column:
        return (F.least(a, b) * 100 >= F.greatest(a, b) * self.percent) & a.isNotNull() & b.isNotNull()

    def common(self, a: Column, b: Column) -> Column:
        return F.ceil((a + b) * self.percent / (100 + self.percent))

    def linked(self, a: Column, b: Column, common: Column) -> Column:
        return common * 100 >= (a + b - common) * self.percent


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct runs of every text, rows in order."""
    whole = within(words, n)
    key, row = runs(words.hash, n)[whole], words.row[: len(whole)][whole]
    size = np.diff(words.first)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        extra = np.zeros(len(short), dtype=np.uint64)
        for k in range(n - 1):
            have = size[short] > k
            extra[have] = mixed(extra[have] + words.hash[words.first[short[have]] + k])
        key, row = np.r_[key, mixed(extra + size[short].astype(np.uint64))], np.r_[row, short]
    order = np.lexsort((key, row))
    key, row = key[order], row[order]
    new = np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])] if len(row) else np.zeros(0, dtype=bool)
    return row[new], key[new]


def count_sketch(docs: DataFrame, n: int) -> np.ndarray:
    """How many texts hold a run, by the upper bits of its hash. Blocks of counters are summed by Spark; what comes to
    the driver has a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
        for piece in pieces(batches):
            _, key = shingles(words_of(piece.column("text"), lower=True), n)
            np.add.at(total, (key >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        blocks = np.flatnonzero(total.reshape(-1, BLOCK).any(axis=1))
        packed = [zlib.compress(total[b * BLOCK : (b + 1) * BLOCK].tobytes(), 1) for b in blocks.tolist()]
        yield pa.record_batch([pa.array(blocks, type=pa.int64()), pa.array(packed, type=pa.binary())], names=["block", "counts"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, block = np.zeros(BLOCK, dtype=np.uint64), None
        for batch in batches:
            for b, packed in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist()):
                block = b
                total += np.frombuffer(zlib.decompress(packed), dtype=np.uint32)
        packed = zlib.compress(np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes(), 1)
        yield pa.record_batch([pa.array([block], type=pa.int64()), pa.array([packed], type=pa.binary())], names=["block", "counts"])

    rows = docs.select("text").mapInArrow(count, "block long, counts binary")
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint32)
    for block, packed in rows.groupBy("block").applyInArrow(merge, "block long, counts binary").collect():
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(zlib.decompress(bytes(packed)), dtype=np.uint32)
    return out


def profiles(docs: DataFrame, like: Likeness) -> DataFrame:
    """(doc_id, size, set_a, set_b, prefix_a, prefix_b, prefix) of every document; equal sets have equal digests."""
    sketch = docs.sparkSession.sparkContext.broadcast(count_sketch(docs, like.n))
    n, percent = like.n, like.percent

    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        for piece in pieces(batches):
            row, key = shingles(words_of(piece.column("text"), lower=True), n)
            order = np.lexsort((key, counts[(key >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)], row))
            row, key = row[order], key[order]
            size = np.bincount(row, minlength=piece.num_rows)
            first = np.r_[0, np.cumsum(size)]
            length = np.where(size > 0, size - (-(-size * percent // 100)) + 1, 0)
            inside = np.arange(len(row)) - first[row] < length[row]
            columns = [piece.column("doc_id"), pa.array(size, type=pa.int64())]
            for keep in (slice(None), inside):
                for salt in (1, 2):
                    sums = np.r_[np.uint64(0), np.cumsum(mixed(key[keep] * np.uint64(2 * salt + 1) + np.uint64(salt)), dtype=np.uint64)]
                    ends = np.searchsorted(row[keep], np.arange(piece.num_rows + 1))
                    columns.append(pa.array((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64)))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(length)], type=pa.int32()), pa.array(key[inside].view(np.int64)))
            yield pa.record_batch([*columns, lists], names=["doc_id", "size", "set_a", "set_b", "prefix_a", "prefix_b", "prefix"])

    kinds = "doc_id long, size long, set_a long, set_b long, prefix_a long, prefix_b long, prefix array<long>"
    return docs.select("doc_id", "text").mapInArrow(profile, kinds)


def sets_of(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """(doc_id, keys) for at least the documents in ids(doc_id). A filter of fixed size picks them where the texts lie,
    so texts are not shuffled; a full filter costs speed only, since a join on the ids follows."""
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(1 << FILTER_BITS))
    words = ids.select((bit / 64).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(xxhash64(doc_id), {1 << FILTER_BITS}) % 64 as int))").alias("bit"))
    held = np.zeros(1 << (FILTER_BITS - 6), dtype=np.int64)
    for word, bits in words.groupBy("word").agg(F.bit_or("bit")).collect():  # one row for each of 131,072 words at most
        held[word] = bits
    shared = docs.sparkSession.sparkContext.broadcast(np.unpackbits(held.view(np.uint8), bitorder="little"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            picked = batch.filter(pa.array(shared.value[batch.column("bit").to_numpy()].astype(bool)))
            for piece in pieces(iter([picked])):
                row, key = shingles(words_of(piece.column("text"), lower=True), n)
                ends = np.searchsorted(row, np.arange(piece.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), pa.array(key.view(np.int64)))
                yield pa.record_batch([piece.column("doc_id"), lists], names=["doc_id", "keys"])

    return docs.select("doc_id", "text", bit.alias("bit")).mapInArrow(sets, "doc_id long, keys array<long>")


def sets_of_pairs(docs: DataFrame, pairs: DataFrame, like: Likeness) -> DataFrame:
    """(doc_id, keys) of the documents in written pairs (a, b)."""
    ids = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b"))).distinct()
    return cut_lineage(sets_of(docs, ids, like.n).join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"]))


def linked_pairs(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """The rows of pairs (a, b, ...) whose whole sets link, where both are in sets."""
    a = sets.select(F.col("doc_id").alias("a"), F.col("keys").alias("keys_a"))
    b = sets.select(F.col("doc_id").alias("b"), F.col("keys").alias("keys_b"))
    rows = pairs.join(a, "a").join(b, "b")
    common = F.size(F.array_intersect("keys_a", "keys_b"))
    return rows.where(like.linked(F.size("keys_a"), F.size("keys_b"), common)).select(*pairs.columns)


def verified(docs: DataFrame, pairs: DataFrame, like: Likeness) -> DataFrame:
    """The rows of pairs (a, b, ...) whose whole sets link."""
    pairs = cut_lineage(pairs)
    return linked_pairs(pairs, sets_of_pairs(docs, pairs, like), like)


def possible(pairs: DataFrame, heads: DataFrame, like: Likeness) -> DataFrame:
    """The rows of pairs (gid_a, size_a, gid_b, size_b, ...) whose prefixes leave room for a link."""
    rows = cut_lineage(pairs.distinct())
    for side in ("a", "b"):
        rows = rows.join(heads.select(F.col("gid").alias(f"gid_{side}"), F.col("prefix").alias(f"prefix_{side}")), f"gid_{side}")
    # Runs outside the prefix that ends first in the order: no more than these can be common besides the shared ones.
    beyond = F.greatest(*[F.col(c) - like.prefix(F.col(c)) for c in ("size_a", "size_b")])
    shared = F.size(F.array_intersect("prefix_a", "prefix_b"))
    return rows.where(shared + beyond >= like.common(F.col("size_a"), F.col("size_b"))).select(*pairs.columns)


def room(like: Likeness) -> Column:
    """Before the first common run there is none, so from its places on both sets must have room for all common runs."""
    return F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b")) >= like.common(F.col("size_a"), F.col("size_b"))


def drawn_pairs(rows: DataFrame, like: Likeness, turn: int) -> DataFrame:
    """(a, b, component_a, component_b, gid_a, size_a, gid_b, size_b): each group's best neighbour of another component
    in each of `ORDERS` orders of the groups under a run."""
    orders = [Window.partitionBy("token").orderBy(F.xxhash64("gid", F.lit(turn * ORDERS + k)), "gid", "component") for k in range(ORDERS)]
    unit = F.struct("rep", "gid", "size", "pos", "component")
    met = rows.select("*", F.array(*[F.lag(unit).over(order) for order in orders]).alias("others"))
    met = met.select("rep", "gid", "size", "pos", "component", F.posexplode("others").alias("order", "other")).where("other.component <> component")
    names = ("rep", "gid", "size", "pos", "component")
    met = met.select("order", *[F.col(c).alias(f"{c}_a") for c in names], *[F.col(f"other.{c}").alias(f"{c}_b") for c in names])
    met = met.where(like.sizes_fit(F.col("size_a"), F.col("size_b")))
    other = F.struct(F.col("rep_b").alias("rep"), F.col("gid_b").alias("gid"), F.col("size_b").alias("size"), F.col("component_b").alias("component"))
    mine = ["order", "rep_a", "gid_a", "size_a", "component_a"]
    tried = met.groupBy(*mine, other.alias("other")).agg(F.count(F.lit(1)).alias("n"), F.max(room(like)).alias("fits")).where("fits")
    best = tried.groupBy(*mine).agg(F.max(F.struct("n", "other")).alias("best")).select(*mine, "best.other.*")
    return best.select(
        F.col("rep_a").alias("a"), F.col("rep").alias("b"), "component_a", F.col("component").alias("component_b"),
        "gid_a", "size_a", F.col("gid").alias("gid_b"), F.col("size").alias("size_b"),
    ).distinct()


def relabelled(rows: DataFrame, label: DataFrame) -> DataFrame:
    """rows with the component that label (id, component) has for theirs, if any."""
    label = label.select(F.col("id"), F.col("component").alias("new"))
    named = rows.join(label, F.col("component") == F.col("id"), "left").withColumn("component", F.coalesce("new", "component"))
    return cut_lineage(named.select(*rows.columns))


def several_components(rows: DataFrame) -> DataFrame:
    """The rows under runs that have groups of two components or more."""
    runs_left = rows.groupBy("token").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("token")
    return cut_lineage(rows.join(runs_left, "token"))


def link_components(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs(doc_id, text).

    Rows of one doc_id are one document in links, also if their texts differ; each row keeps its own size."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    base = cut_lineage(profiles(docs, like))
    digest = ["size", "set_a", "set_b"]
    reps = base.where("size > 0").groupBy(*digest).agg(F.min("doc_id").alias("rep"), F.first("prefix_a").alias("prefix_a"), F.first("prefix_b").alias("prefix_b"))
    reps = cut_lineage(reps)
    alike = ["size", "prefix_a", "prefix_b"]
    groups = reps.groupBy(*alike).agg(F.min("rep").alias("gid"), F.count(F.lit(1)).alias("members"))
    members = cut_lineage(reps.join(groups.where("members > 1").drop("members"), alike, "left").select("rep", "size", F.coalesce("gid", "rep").alias("gid")))

    leaders = members.where("rep = gid").select(F.col("gid").alias("doc_id"))
    heads = base.join(leaders, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    heads = cut_lineage(heads.select(F.col("doc_id").alias("gid"), "size", "prefix"))
    tokens = heads.select("gid", "size", F.posexplode("prefix").alias("pos", "token"))
    under = Window.partitionBy("token").orderBy("size", "gid")
    met = tokens.select(
        "token", "gid", "size", "pos",
        F.lag(F.struct("gid", "size")).over(under).alias("near"),
        F.first(F.struct("gid", "size")).over(under).alias("head"),
        F.lead("gid").over(under).alias("after"),
    )
    met = cut_lineage(met.where("near is not null or after is not null").drop("after"))

    hubs = met.select("gid", "size", "token", F.explode(F.array_distinct(F.array("near", "head"))).alias("hub"))
    hubs = hubs.where(F.col("hub").isNotNull() & (F.col("hub.gid") != F.col("gid"))).where(like.sizes_fit(F.col("size"), F.col("hub.size")))
    strong = hubs.groupBy(F.col("hub.gid").alias("a"), F.col("gid").alias("b"), "size").agg(F.count(F.lit(1)).alias("n"))
    strong = strong.where(F.col("n") * 4 >= like.prefix(F.col("size")))
    # One partner each is enough here: what it leaves apart meets in steps 2 and 3.
    strong = strong.groupBy("b").agg(F.max(F.struct("n", (-F.col("a")).alias("from"))).alias("best")).select((-F.col("best.from")).alias("a"), "b")
    inner = members.where("rep <> gid").select(F.col("gid").alias("a"), F.col("rep").alias("b"))
    # Every text hangs on one that is earlier by size and id, so these links are a forest.
    links = verified(docs, strong.union(inner), like)
    label = forest_roots(links.select(F.col("b").alias("id"), F.col("a").alias("parent")))

    placed = members.join(label, F.col("rep") == F.col("id"), "left").select("rep", "size", "gid", F.coalesce("root", "rep").alias("component"))
    placed = cut_lineage(placed)
    units = placed.groupBy("gid", "component").agg(F.min("rep").alias("rep"))
    rows = several_components(met.select("token", "gid", "size", "pos").join(units, "gid"))
    sets = None
    for turn in range(TURNS):
        drawn = cut_lineage(possible(drawn_pairs(rows, like, turn), heads, like))
        # Texts are read in the first turn only; a pair with a text that is new in a later turn waits for step 3.
        sets = sets_of_pairs(docs, drawn, like) if sets is None else sets
        links = linked_pairs(drawn, sets, like).select(F.col("component_a").alias("a"), F.col("component_b").alias("b"))
        label = components(links)
        placed, rows = relabelled(placed, label), several_components(relabelled(rows, label))

    one = rows.select("token", *[F.col(c).alias(f"{c}_a") for c in ("gid", "size", "pos", "component")])
    two = rows.select("token", *[F.col(c).alias(f"{c}_b") for c in ("gid", "size", "pos", "component")])
    meet = one.join(two, "token").where("component_a < component_b").where(like.sizes_fit(F.col("size_a"), F.col("size_b")) & room(like))
    meet = possible(meet.select("gid_a", "component_a", "size_a", "gid_b", "component_b", "size_b"), heads, like)
    meet = meet.select("gid_a", "component_a", "gid_b", "component_b")
    units = placed.select("gid", "component").distinct()
    several = units.groupBy("gid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gid")
    parts = units.join(several, "gid")
    same = parts.select(F.col("gid").alias("gid_a"), F.col("component").alias("component_a")).join(
        parts.select(F.col("gid").alias("gid_b"), F.col("component").alias("component_b")), F.col("gid_a") == F.col("gid_b")
    )
    meet = meet.union(same.where("component_a < component_b").select("gid_a", "component_a", "gid_b", "component_b"))
    a = placed.select(F.col("gid").alias("gid_a"), F.col("component").alias("component_a"), F.col("rep").alias("a"))
    b = placed.select(F.col("gid").alias("gid_b"), F.col("component").alias("component_b"), F.col("rep").alias("b"))
    pairs = meet.join(a, ["gid_a", "component_a"]).join(b, ["gid_b", "component_b"]).select("a", "b", "component_a", "component_b").distinct()
    # Links between components are links of the components themselves.
    more = verified(docs, pairs, like).select(F.col("component_a").alias("a"), F.col("component_b").alias("b"))
    joined = components(more)

    whole = placed.join(joined.withColumnRenamed("component", "joined"), F.col("component") == F.col("id"), "left")
    whole = whole.select("rep", F.coalesce("joined", "component").alias("whole"))
    final = whole.join(whole.groupBy("whole").agg(F.min("rep").alias("component_id")), "whole").select("rep", "component_id")
    final = final.groupBy("rep").agg(F.min("component_id").alias("component_id"))
    named = reps.join(final, "rep").select(*digest, "component_id")
    # Equal texts by the thousand share one digest: the small side is split over them by adaptive execution.
    out = base.select("doc_id", *digest).join(named, digest, "left")
    return out.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
