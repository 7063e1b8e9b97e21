"""Documents as token ids, packed into windows by the sum-of-squares rule.

A document is its text's ids and an end id; NULL is the empty text. Its whole windows are sequences of their own. What
is left over (fewer ids than a window) is placed online: of all fill levels it fits on, a new window among them, the one
that leaves the least sum of squared counts of partially filled windows takes it, the fullest of equal ones. The state
is one array with the count of windows per level.

Windows still open when a task's rows end would be padded. So the task always holds back the newest rests until they
have as many ids as the open windows have room; at the end they are cut to fill exactly that room. Of what then is left,
whole windows come first and the last ids stand in sequences whose lengths are powers of two, which need no padding.

Every task packs the rows it read: nothing is shuffled, and a task that runs again gives the same sequences. Its memory
is the level array, one number per open window, the rests held back and one piece of texts. Every row is a document of
its own, also with a NULL or repeated doc_id; a table without rows gives no pieces; columns other than doc_id and text are
not looked at; a long text is encoded as a whole."""

from __future__ import annotations

import os
import re
import unicodedata
from array import array
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.llm.words import pieces as text_pieces

WINDOW = 1024
END_ID = 0

# The published splitting pattern of byte-level BPE vocabularies (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The same for texts whose characters are all among PLAIN: there the classes of `re`, which is faster, mean the same.
PLAIN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
PLAIN = r"\t-\r -~\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧€"

# Words whose ids are remembered by a worker; then it starts anew.
REMEMBERED = 1_000_000
# Characters whose words are held at once.
PART = 1 << 20

PIECES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("ids", pa.binary()),
    ]
)


class Ids:
    """Ids of texts as little-endian unsigned 32-bit numbers, by a byte-level BPE file of `tokenizers`.

    Such a vocabulary encodes the words of its splitting pattern one by one, so each word is encoded once. Code points
    that are newer than this Python's Unicode tables can be split in another way by the library; what holds one goes
    through it whole. Strings of special tokens are ordinary text."""

    def __init__(self, file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.tokenizer.encode_special_tokens = True
        self.known: dict[str, bytes] = {}
        self.split, self.plain_split = regex.compile(SPLIT).findall, re.compile(PLAIN_SPLIT).findall
        self.other = re.compile(f"[^{PLAIN}]").search

    def of_all(self, texts: list[str]) -> list[bytes]:
        found: list[list[bytes]] = [[] for _ in texts]
        waiting, held = [], 0
        for i, text in enumerate(texts):
            for part in parts_of(text):
                waiting.append((found[i], self.words(part)))
                held += len(part)
                if held >= PART:
                    self.look_up(waiting)
                    waiting, held = [], 0
        self.look_up(waiting)
        return [b"".join(f) for f in found]

    def words(self, part: str) -> list[str]:
        if not self.other(part):
            return self.plain_split(part)
        if any(unicodedata.category(c) == "Cn" for c in set(part)):
            return [part]
        return self.split(part)

    def look_up(self, waiting: list[tuple[list[bytes], list[str]]]) -> None:
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        new = list(set().union(*(words for _, words in waiting)).difference(self.known))
        for word, code in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            self.known[word] = array("I", code.ids).tobytes()
        for found, words in waiting:
            found.append(b"".join(map(self.known.__getitem__, words)))


def parts_of(text: str) -> Iterator[str]:
    """A long text in parts of about PART characters, cut before single spaces, where a new word begins in any case."""
    begin = 0
    while len(text) - begin > PART:
        cut = text.find(" ", begin + PART)
        while cut > 0 and (cut + 1 == len(text) or text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut = text.find(" ", cut + 1)
        if cut < 0:
            break
        yield text[begin:cut]
        begin = cut
    yield text[begin:]


_loaded: dict[str, Ids] = {}


def ids_of(file: str) -> Callable[[list[str]], list[bytes]]:
    if file not in _loaded:
        # One core per task: Spark runs as many tasks as there are cores.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _loaded[file] = Ids(file)
    return _loaded[file].of_all


class Levels:
    """Open windows by fill level, and the sum-of-squares choice among them."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, dtype=np.int64)
        self.open: dict[int, list[int]] = {}
        self.room = 0
        self.made = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def choose(self, size: int) -> int:
        """The level to place `size` ids on, 0 for a new window. Squares change by 2 count + 1 where a window comes to
        and by 1 - 2 count where it leaves; the empty and the full level are not counted."""
        last = self.window - size
        after = 2 * self.count[size:] + 1
        after[-1] = 0
        change = after[: last + 1] - 2 * self.count[: last + 1] + 1
        change[0] -= 1
        usable = self.count[: last + 1] > 0
        usable[0] = True
        change[~usable] = np.iinfo(np.int64).max
        return last - int(np.argmin(change[::-1]))

    def place(self, size: int) -> tuple[int, int]:
        """(window, offset) for `size` ids, fewer than a window."""
        level = self.choose(size)
        if level == 0:
            at = self.new()
            self.room += self.window
        else:
            at = self.open[level].pop()
            self.count[level] -= 1
        self.room -= size
        if level + size < self.window:
            self.open.setdefault(level + size, []).append(at)
            self.count[level + size] += 1
        return at, level

    def left_open(self) -> list[tuple[int, int]]:
        """(window, fill) of all open windows, the fullest first."""
        return [(at, level) for level in sorted(self.open, reverse=True) for at in self.open[level]]


class Packer:
    """Pieces (doc, start, ids, doc_tokens, window, offset) of documents that come one after the other."""

    def __init__(self, window: int = WINDOW):
        self.levels = Levels(window)
        self.rests: deque[tuple] = deque()
        self.held = 0

    def add(self, doc, ids: bytes) -> Iterator[tuple]:
        """Ids are given as 4 bytes each."""
        window, n = self.levels.window, len(ids) // 4
        whole = n - n % window
        for start in range(0, whole, window):
            yield doc, start, ids[4 * start : 4 * (start + window)], n, self.levels.new(), 0
        if whole < n:
            self.rests.append((doc, whole, ids[4 * whole :], n))
            self.held += n - whole
        # A rest may open a window, so that much more is held back.
        while self.rests and self.held - len(self.rests[0][2]) // 4 >= self.levels.room + window:
            doc, start, ids, n = self.rests.popleft()
            self.held -= len(ids) // 4
            yield doc, start, ids, n, *self.levels.place(len(ids) // 4)

    def end(self) -> Iterator[tuple]:
        for at, level in self.levels.left_open():
            yield from self._cut(at, level, self.levels.window - level)
        while self.held:
            # Whole windows, then the powers of two that the rest is the sum of.
            yield from self._cut(self.levels.new(), 0, min(self.levels.window, 1 << (self.held.bit_length() - 1)))

    def _cut(self, at: int, offset: int, size: int) -> Iterator[tuple]:
        """The next `size` of the ids held back, into window `at`."""
        self.held -= size
        while size:
            doc, start, ids, n = self.rests.popleft()
            take = min(size, len(ids) // 4)
            yield doc, start, ids[: 4 * take], n, at, offset
            if 4 * take < len(ids):
                self.rests.appendleft((doc, start + take, ids[4 * take :], n))
            offset, size = offset + take, size - take


def pack(docs: DataFrame, tokenizer_file: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces with their ids (little-endian unsigned 32-bit): doc_id, start, length, doc_tokens, sequence_id, offset, ids.
    `window` is a power of two."""
    if window < 1 or window & (window - 1):
        raise ValueError("the window must be a power of two")
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, packer = ids_of(tokenizer_file), Packer(window)
        first = TaskContext.get().partitionId() << 40

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            docs, starts, ids, sizes, at, offsets = zip(*rows)
            sequences = [first + a for a in at]
            columns = [docs, starts, [len(i) // 4 for i in ids], sizes, sequences, offsets, ids]
            return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(columns, PIECES)], schema=PIECES)

        for batch in text_pieces(batches):
            texts = pc.fill_null(batch.column("text"), "").to_pylist()
            rows = [r for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(texts)) for r in packer.add(doc, ids + end)]
            if rows:
                yield batch_of(rows)
        rows = list(packer.end())
        if rows:
            yield batch_of(rows)

    kinds = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, kinds)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids, documents): the windows themselves. A group is one window."""
    part = F.struct("offset", "ids", "doc_id", "start")
    windows = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(part)).alias("parts"))
    return windows.select(
        "sequence_id",
        "length",
        F.aggregate("parts", F.lit(b""), lambda held, p: F.concat(held, p["ids"])).alias("ids"),
        F.transform("parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["start"].alias("start"), p["offset"].alias("offset"))).alias("documents"),
    )
