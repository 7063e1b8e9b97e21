"""Substring dedup with repeated-phrase automata.

A window is 13 consecutive words of one document. A word goes if a window over it also starts in a document with a
smaller doc_id.

1. Anchors. Of the 4-word runs inside a window the one with the least hash is its anchor, so equal windows have equal
   anchors. Anchors found in two documents or more mark the only places where windows can recur.
2. Segments. The windows of a document that share one anchor there form a segment of at most 22 words. Segments go to
   cells by their anchor; there are as many cells as the counted segments need. Segments of an anchor with more than
   `hot` of them are cut into windows, which go to shards by their own hash; a window that is found more than `hot`
   times has its occurrences dealt over several parts of its shard, and each of them knows the window.
3. Automata. A cell picks the windows that two documents have, compiles them into an Aho-Corasick automaton over the
   letters that its words were given, and runs all its segments through it in one pass. What the automaton finds gives
   the first document of each window and the places to remove. In a shard the windows and their first documents come
   from an aggregate, as no part of it sees every occurrence.
4. The matches give each document's ranges of words to remove.

Words are told apart by 64-bit hashes. A row is known by its doc_id and a hash of its text: rows of one doc_id with
different texts keep results of their own and, as their doc_id is not smaller, remove nothing from each other; equal
rows lose the same ranges. Rows with a NULL doc_id lose nothing and take nothing from others. NULL and empty texts have
no words, texts under 13 words lose nothing. Columns besides doc_id and the text are not looked at."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.words import SPACE, Words, mixed, pieces, runs, within, word_starts, words_of
from panelwright.session import cut_lineage

WINDOW = 13
GRAM = 4
HOT = 20_000  # segments of one anchor that a cell takes up whole
CELL = 20_000  # segments of one cell, about
LETTERS = 0x110000 - 0x800 - 2  # letters beside the one between segments and the one of words found once


def row_key() -> Column:
    """Tells rows of one doc_id apart."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))


def anchors(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each run of `gram` words, whether a window starts at each place, place of its anchor)."""
    grams, starts = runs(words.hash, gram), within(words, window)
    n = len(starts)
    least, place = grams[:n].copy(), np.arange(n)
    for i in range(1, window - gram + 1):
        other = grams[i : i + n]
        less = other < least
        least[less] = other[less]
        place[less] = np.flatnonzero(less) + i
    return grams, starts, place


def recurring_anchors(docs: DataFrame, window: int, gram: int, hot: int) -> DataFrame:
    """(anchor, doc_id, row, times, parts): anchors of two documents or more, and how often a row has them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words = words_of(piece.column("text"))
            grams, starts, place = anchors(words, window, gram)
            place = place[starts]
            place = place[np.r_[True, place[1:] != place[:-1]]] if len(place) else place
            row, key = words.row[place], grams[place]
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            new = np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])] if len(row) else np.zeros(0, dtype=bool)
            held = piece.select(["doc_id", "row"]).take(pa.array(row[new]))
            times = np.diff(np.r_[np.flatnonzero(new), len(row)])
            yield pa.record_batch([*held.columns, pa.array(key[new].view(np.int64)), pa.array(times)], names=["doc_id", "row", "anchor", "times"])

    found = docs.mapInArrow(find, "doc_id long, row long, anchor long, times long")
    parts = F.when(F.col("n") > hot, F.ceil(F.col("n") * (window - gram + 1) / hot)).otherwise(1)
    shared = (
        found.groupBy("anchor")
        .agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.sum("times").alias("n"))
        .where("low < high")
        .select("anchor", parts.cast("long").alias("parts"))
    )
    return found.join(shared, "anchor")


def segments(docs: DataFrame, shared: DataFrame, cells: int, window: int, gram: int) -> DataFrame:
    """(cell, parts, doc_id, row, start, salt, text): stretches of words whose windows may recur. Cells below 0 are one
    hot anchor each. The salt only numbers what a task gives."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words = words_of(piece.column("text"))
            grams, starts, place = anchors(words, window, gram)
            at = np.flatnonzero(starts)
            if not len(at):
                continue
            anchor = place[at]
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1)]
            begin, stop = at[new], at[np.r_[np.flatnonzero(new)[1:] - 1, len(at) - 1]] + window
            key, row = grams[anchor[new]], words.row[begin]
            listed = piece.column("anchors")
            wanted = pc.struct_field(listed.flatten(), "anchor").to_numpy(zero_copy_only=False).view(np.uint64)
            parts = pc.struct_field(listed.flatten(), "parts").to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(listed)), pc.list_value_length(listed).to_numpy(zero_copy_only=False))
            tag = lambda k, r: mixed(k + mixed(r.astype(np.uint64)))  # noqa: E731  an anchor in one row
            known = tag(wanted, owner)
            order = np.argsort(known)
            known, parts = known[order], parts[order]
            asked = tag(key, row)
            spot = np.minimum(np.searchsorted(known, asked), len(known) - 1)
            hit = known[spot] == asked
            begin, stop, key, row, parts = begin[hit], stop[hit], key[hit], row[hit], parts[spot[hit]]
            cell = np.where(parts > 1, -1 - (key >> np.uint64(1)).astype(np.int64), (key % np.uint64(cells)).astype(np.int64))
            held = piece.select(["doc_id", "row"]).take(pa.array(row)).columns
            text = pa.array([x.decode() for x in words.spans(begin, stop)], type=pa.string())
            columns = [pa.array(cell), pa.array(parts), *held, pa.array(begin - words.first[row]), pa.array(np.arange(len(row))), text]
            yield pa.record_batch(columns, names=["cell", "parts", "doc_id", "row", "start", "salt", "text"])

    lists = shared.groupBy("doc_id", "row").agg(F.collect_set(F.struct("anchor", "parts")).alias("anchors"))
    rows = docs.join(lists, ["doc_id", "row"])
    return rows.mapInArrow(cut, "cell long, parts long, doc_id long, row long, start long, salt long, text string")


def single_windows(hot_segments: DataFrame, window: int) -> DataFrame:
    """Every window of the segments as a segment of its own, with `key`, the hash of its words."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            words = words_of(piece.column("text"))
            at = np.flatnonzero(within(words, window))
            if not len(at):
                continue
            row = words.row[at]
            held = piece.select(["cell", "parts", "doc_id", "row", "salt"]).take(pa.array(row)).columns
            start = piece.column("start").to_numpy()[row] + at - words.first[row]
            key = runs(words.hash, window)[at].view(np.int64)
            text = pa.array([x.decode() for x in words.spans(at, at + window)], type=pa.string())
            yield pa.record_batch([*held, pa.array(start), pa.array(key), text], names=["cell", "parts", "doc_id", "row", "salt", "start", "key", "text"])

    return hot_segments.mapInArrow(split, "cell long, parts long, doc_id long, row long, salt long, start long, key long, text string")


def letters(words: Words, times: np.ndarray) -> str:
    """One letter per word and one after every text. Words found once, where each text counts as often as `times` says,
    share a letter: no recurring window has them."""
    kinds, number = np.unique(words.hash, return_inverse=True)
    again = np.bincount(number, weights=times[words.row], minlength=len(kinds)) > 1
    letter = np.where(again, np.cumsum(again) + 1, 1)
    if len(letter) and letter.max() > LETTERS:
        raise ValueError(f"more than {LETTERS} words in a cell")
    letter += 0x800 * (letter >= 0xD800)  # there are no letters among surrogates
    out = np.zeros(len(words.hash) + len(words.first) - 1, dtype="<u4")
    out[np.arange(len(words.hash)) + words.row] = letter[number]
    return out.tobytes().decode("utf-32-le")


def located(found: DataFrame, window: int, hot: int) -> DataFrame:
    """(doc_id, row, ranges): ranges of words that recur from an earlier document, by the automaton of each cell."""
    import ahocorasick

    def run(here: pa.Table, given: pa.Table) -> pa.Table:
        none = pa.table({"doc_id": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "range": pa.array([], span)})
        if not here.num_rows:
            return none
        # Equal segments go through the automaton once.
        ids, held = here.column("doc_id").to_numpy(), pa.concat_arrays(here.column("text").chunks).dictionary_encode()
        kind, n = held.indices.to_numpy(), len(held.dictionary)
        least, most = np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(least, kind, ids)
        np.maximum.at(most, kind, ids)
        words = words_of(pa.concat_arrays([held.dictionary, *given.column("text").chunks]))
        line = letters(words, np.r_[np.bincount(kind, minlength=n), np.ones(given.num_rows, dtype=np.int64)])
        if given.num_rows:
            place, row = words.first[n:-1], np.arange(n, n + given.num_rows)
            low = given.column("low").to_numpy()
        else:  # the cell holds every document of its anchors
            at = np.flatnonzero(within(words, window))
            key = runs(words.hash, window)[at]
            order = np.argsort(key, kind="stable")
            new, text = np.flatnonzero(np.r_[len(at) > 0, np.diff(key[order]) != 0]), words.row[at[order]]
            two = np.minimum.reduceat(least[text], new) < np.maximum.reduceat(most[text], new)
            place = at[order[new[two]]]
            row, low = words.row[place], None
        if not len(place):
            return none
        automaton = ahocorasick.Automaton()
        for i, a in enumerate((place + row).tolist()):
            automaton.add_word(line[a : a + window], i)
        automaton.make_automaton()
        match = np.fromiter(chain.from_iterable(automaton.iter(line, 0, int(words.first[n]) + n)), dtype=np.int64)
        end, phrase = match.reshape(-1, 2).T
        begins = words.first[:n] + np.arange(n)  # of each text, among the letters
        text = np.searchsorted(begins, end, side="right") - 1
        if low is None:
            low = np.full(len(place), np.iinfo(np.int64).max)
            np.minimum.at(low, phrase, least[text])
        # The matches of a text for every segment that has it.
        times = np.bincount(text, minlength=n)
        each = times[kind]
        segment = np.repeat(np.arange(len(kind)), each)
        found_at = np.arange(len(segment)) + np.repeat((np.cumsum(times) - times)[kind] - (np.cumsum(each) - each), each)
        gone = low[phrase[found_at]] < ids[segment]
        segment, a = segment[gone], (end - window + 1 - begins[text])[found_at[gone]]
        new = np.flatnonzero(np.r_[len(a) > 0, (segment[1:] != segment[:-1]) | (a[1:] > a[:-1] + window)])
        if not len(new):
            return none
        first, last, segment = a[new], a[np.r_[new[1:] - 1, len(a) - 1]], segment[new]
        shift = here.column("start").to_numpy()[segment]
        ranges = pa.StructArray.from_arrays([pa.array(first + shift), pa.array(last + shift + window)], names=["a", "b"])
        return pa.table({"doc_id": pa.array(ids[segment]), "row": pa.array(here.column("row").to_numpy()[segment]), "range": ranges})

    span = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    shard = F.pmod("key", "parts").alias("part")
    windows = single_windows(found.where("cell < 0"), window)
    known = windows.groupBy("cell", "key").agg(
        F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.max("parts").alias("parts"), F.ceil(F.count(F.lit(1)) / hot).alias("copies"), F.first("text").alias("text")
    )
    known = known.where("low < high")
    dealt = windows.join(known.select("cell", "key", "copies"), ["cell", "key"])
    dealt = dealt.select("cell", shard, F.pmod("salt", "copies").alias("copy"), "doc_id", "row", "start", "text")
    given = known.select("cell", shard, F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), "low", "text")
    whole = found.where("cell >= 0").select("cell", F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("copy"), "doc_id", "row", "start", "text")
    group = ("cell", "part", "copy")
    both = whole.unionByName(dealt).groupBy(*group).cogroup(given.groupBy(*group))
    ranges = both.applyInArrow(run, "doc_id long, row long, range struct<a:long,b:long>")
    return ranges.groupBy("doc_id", "row").agg(F.collect_set("range").alias("ranges"))


def removal_ranges(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, cell: int = CELL) -> DataFrame:
    """(doc_id, row, ranges array<struct<a, b>>) for the rows that lose words; `row` is `row_key`."""
    docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text")
    # Written because the number of cells is counted from it and the texts are joined to it.
    shared = cut_lineage(recurring_anchors(docs, window, gram, hot))
    counted = shared.where("parts = 1").agg(F.sum("times")).first()[0] or 0
    # Written because hot anchors and all others read it; the anchors and texts behind it are done with then.
    return located(cut_lineage(segments(docs, shared, max(1, -(-counted // cell)), window, gram)), window, hot)


def digest_kept(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            ids, rows = piece.column("doc_id"), []
            for text, spans in zip(piece.column("text").to_pylist(), piece.column("ranges").to_pylist()):
                words = (text or "").encode().split()
                kept = words
                if spans:
                    keep = np.ones(len(words), dtype=bool)
                    for span in spans:
                        keep[span["a"] : span["b"]] = False
                    kept = [w for w, k in zip(words, keep.tolist()) if k]
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            n, gone, sha = zip(*rows)
            yield pa.record_batch([ids, pa.array(n, type=pa.int64()), pa.array(gone, type=pa.int64()), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key().alias("row"), "text")
    rows = rows.join(ranges, ["doc_id", "row"], "left").select("doc_id", "text", "ranges")
    return rows.mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_ranges(docs: DataFrame, ranges: DataFrame) -> DataFrame:
    """The documents with all their columns, the removed words cut out of the text and other bytes as they were."""
    columns = docs.columns
    own = "_"  # begins no name of theirs
    while any(c.startswith(own) for c in columns):
        own += "_"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            texts, spans = piece.column("text").to_pylist(), piece.column(f"{own}ranges").to_pylist()
            out = [_cut(t, s) if s else t for t, s in zip(texts, spans)]
            held = {c: piece.column(c) for c in columns}
            held["text"] = pa.array(out, type=pa.string())
            yield pa.RecordBatch.from_arrays([held[c] for c in columns], names=columns)

    gone = ranges.select(*[F.col(c).alias(own + c) for c in ("doc_id", "row", "ranges")])
    same = (F.col("doc_id").cast("long") == F.col(f"{own}doc_id")) & (row_key() == F.col(f"{own}row"))
    rows = docs.join(gone, same, "left").drop(f"{own}doc_id", f"{own}row")
    return rows.mapInArrow(cut, docs.schema)


def _cut(text: str, spans: list[dict]) -> str:
    data, _, start, end = word_starts(pa.array([text]))
    keep = np.ones(len(data), dtype=bool)
    for span in spans:
        a, b = span["a"], span["b"]
        # The words and the white space up to the next word.
        keep[start[a] : start[b] if b < len(start) else len(data)] = False
    out = data[keep].tobytes().decode()
    return out if SPACE[data[-1]] else out.rstrip(" \t\n\x0b\f\r")
