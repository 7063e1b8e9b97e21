"""Benchmark decontamination by a positional inverted index, with DataFrame functions only.

The terms of the tests are counted over all documents. Of each test phrase (a window of words) the two rarest terms
are chosen, and the postings of the chosen terms (document, position, and for the rarest the words around it) are
stored. A phrase's occurrences are its rarest term's postings, shifted by the term's place in the phrase, that the
second term's shifted postings also hold and whose words are the phrase's.

NULL or wordless texts have no words and no hits; a test without words gives no phrase, one with fewer words than a
window is one phrase. A document is a row: doc_id and a hash of the text tell rows apart, so rows with a NULL or repeated
doc_id have their own hits and equal rows have equal ones. Columns other than doc_id and text are not looked at. Tables of terms and phrases are sent to all tasks only if a count shows them
to be small, and shuffled otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.session import cut_lineage

WINDOW = 10
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SMALL_ROWS = 500_000  # terms or phrases that are sent to all tasks, about 50 MB


def words(text: str) -> Column:
    """A-Z lower-cased; runs of a-z, 0-9 and all characters beyond ASCII."""
    lowered = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(lowered, GAPS), lambda w: w != "")


def small(rows: DataFrame) -> DataFrame:
    """Written, counted, and marked for broadcast if there are few."""
    rows = cut_lineage(rows)
    return F.broadcast(rows) if rows.count() <= SMALL_ROWS else rows


def phrases(tests: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, terms): every window of every test."""
    rows = tests.select("item_id", words("text").alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - window + 1, F.lit(1)))
    return rows.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, window))).alias("terms"))


def document() -> Column:
    """What a row's postings are kept under; NULL fields of structs are equal to one another."""
    return F.struct("doc_id", F.xxhash64("text").alias("mark")).alias("doc")


def positions(docs: DataFrame) -> DataFrame:
    """(doc, w, pos, term)."""
    rows = docs.select(document(), words("text").alias("w"))
    return rows.select("doc", "w", F.posexplode("w").alias("pos", "term"))


def rarest_terms(listed: DataFrame, docs: DataFrame) -> DataFrame:
    """(terms, term_1, off_1, term_2, off_2) of the distinct phrases all of whose terms occur in the documents."""
    vocabulary = listed.select(F.explode("terms").alias("term")).distinct()
    counted = positions(docs).select("term").join(small(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    placed = listed.select("terms").distinct().select("terms", F.posexplode("terms").alias("off", "term"))
    ranked = placed.join(counted, "term").groupBy("terms").agg(F.sort_array(F.collect_list(F.struct("n", "off", "term"))).alias("by"))
    ranked = ranked.where(F.size("by") == F.size("terms"))
    one, two = F.get("by", F.lit(0)), F.coalesce(F.get("by", F.lit(1)), F.get("by", F.lit(0)))
    return ranked.select("terms", one["term"].alias("term_1"), one["off"].alias("off_1"), two["term"].alias("term_2"), two["off"].alias("off_2"))


def store_index(docs: DataFrame, chosen: DataFrame, radius: int) -> DataFrame:
    """(term, doc, pos, around, from): postings of the chosen terms; `around` are the words from place `from`, up to
    `radius` on both sides of a term that is the rarest of some phrase."""
    terms = chosen.select(F.col("term_1").alias("term"), F.lit(True).alias("rarest")).union(chosen.select("term_2", F.lit(False)))
    terms = terms.groupBy("term").agg(F.max("rarest").alias("rarest"))
    begin = F.greatest(F.col("pos") - radius, F.lit(0))
    around = F.when(F.col("rarest"), F.slice("w", begin + 1, F.col("pos") - begin + radius + 1))
    rows = positions(docs).join(small(terms), "term")
    return cut_lineage(rows.select("term", "doc", "pos", around.alias("around"), begin.alias("from")))


def exact_matches(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc, start, terms): every occurrence of every chosen phrase."""
    first = index.where("around is not null").join(chosen, F.col("term") == F.col("term_1"))
    first = first.withColumn("start", F.col("pos") - F.col("off_1"))
    first = first.where((F.col("start") >= F.col("from")) & (F.slice("around", F.greatest(F.col("start") - F.col("from") + 1, F.lit(1)), F.size("terms")) == F.col("terms")))
    first = first.select("doc", "start", "terms", "term_2", (F.col("start") + F.col("off_2")).alias("pos_2"))
    second = index.select(F.col("doc").alias("__d"), F.col("term").alias("__t"), F.col("pos").alias("__p"))
    held = (F.col("doc") == F.col("__d")) & (F.col("term_2") == F.col("__t")) & (F.col("pos_2") == F.col("__p"))
    return first.join(second, held, "left_semi").select("doc", "start", "terms")


def near_matches(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """(doc, pos, terms): places of a phrase's rarest term that have all its other terms around them, in any order,
    within the radius of the index."""
    rows = index.where("around is not null").join(chosen, F.col("term") == F.col("term_1"))
    return rows.where(F.size(F.array_except("terms", "around")) == 0).select("doc", "pos", "terms")


def decontaminate(docs: DataFrame, tests: DataFrame, window: int = WINDOW, keep: Column | None = None) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) for every document; `keep`, of docs, goes with it."""
    listed = cut_lineage(phrases(tests, window))
    chosen = small(rarest_terms(listed, docs))
    found = cut_lineage(exact_matches(store_index(docs, chosen, window - 1), chosen).distinct())
    hit = (
        found.select("doc", F.explode(F.sequence("start", F.col("start") + F.size("terms") - 1)).alias("place"))
        .distinct()
        .groupBy("doc")
        .agg(F.count(F.lit(1)).alias("n_hit"))
    )
    owners = listed.groupBy("terms").agg(F.collect_set(F.col("item_id").cast("string")).alias("items"))
    items = found.select("doc", "terms").distinct().join(owners, "terms").select("doc", F.explode("items").alias("item")).distinct()
    items = items.groupBy("doc").agg(F.sort_array(F.collect_list("item")).alias("items"))
    kept = [] if keep is None else [keep]
    rows = docs.select(document(), F.size(words("text")).cast("long").alias("n_words"), *kept)
    rows = rows.join(hit.join(items, "doc"), "doc", "left")
    none = F.array().cast("array<string>")
    return rows.select(
        "doc.doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        *rows.columns[2 : 2 + len(kept)],
    )
