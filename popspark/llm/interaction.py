"""Filter interaction audit: what each filter removes in every order of the filters.

A table-driven byte transducer reads the UTF-8 of many texts in one pass and marks words, capitals,
code points and symbols; the word spans it finds go into a hash table that compares bytes, which
counts distinct words.  Filters then are conditions on these counts, and only how many documents fail
which set of filters matters for the orders.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, slices, utf8

FILTERS = {
    "A": "n_words < 100",
    "B": "100 * n_distinct < 80 * n_words",
    "C": "100 * n_capitals > 10 * n_chars",
    "D": "n_symbols > 0",
}
COPY = "E"  # a text that a smaller id has

# Byte classes, and what the transducer writes when it reads a byte.
SPACE, CAPITAL, SYMBOL, OTHER, MORE, LEAD2, LEAD3, LEAD4 = range(8)
BEGINS, ENDED, IS_CAPITAL, IS_SYMBOL, IS_CHAR = 1, 2, 4, 8, 16
SYMBOLS = b"#$%&*|"

BACK = 4  # bytes after which the state no longer depends on where reading began
STEPS = 256  # bytes of a lane
LONG = 64  # bytes of a word beyond which it is hashed by itself


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[[0x20, *range(0x09, 0x0E)]] = SPACE
    out[ord("A") : ord("Z") + 1] = CAPITAL
    out[list(SYMBOLS)] = SYMBOL
    out[0x80:0xC0], out[0xC0:0xE0], out[0xE0:0xF0], out[0xF0:] = MORE, LEAD2, LEAD3, LEAD4
    return out


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state times 8, and what is written, by state times 8 plus class.

    A state says whether a word is open and how many bytes of a character are to come.  A stray
    continuation byte is a character.
    """
    moves, writes = np.zeros(64, np.uint8), np.zeros(64, np.uint8)
    for word in (0, 1):
        for awaited in range(4):
            for kind in range(8):
                inside = kind == MORE and awaited > 0
                left = awaited - 1 if inside else {LEAD2: 1, LEAD3: 2, LEAD4: 3}.get(kind, 0)
                now = int(kind != SPACE)
                out = 0 if inside else IS_CHAR
                out |= BEGINS if now and not word else ENDED if word and not now else 0
                out |= {CAPITAL: IS_CAPITAL, SYMBOL: IS_SYMBOL}.get(kind, 0)
                at = (word * 4 + awaited) * 8 + kind
                moves[at], writes[at] = (now * 4 + left) * 8, out
    return moves, writes


CLASS = _classes()
MOVES, WRITES = _tables()


def transduce(data: np.ndarray) -> np.ndarray:
    """What the transducer writes for each byte of ``data``.

    Lanes of STEPS bytes are read side by side; each begins BACK bytes early, which settles its state.
    """
    lanes = max(1, -(-len(data) // STEPS))
    kinds = np.full(BACK + lanes * STEPS, SPACE, np.uint8)
    kinds[BACK : BACK + len(data)] = CLASS[data]
    rows = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(kinds, BACK + STEPS)[::STEPS].T)
    out = np.empty((STEPS, lanes), np.uint8)
    state = np.zeros(lanes, np.uint8)
    for k in range(BACK + STEPS):
        at = state + rows[k]
        state = MOVES[at]
        if k >= BACK:
            out[k - BACK] = WRITES[at]
    return out.T.reshape(-1)[: len(data)]


class Words:
    """Spans of words in a buffer, with a hash of each, compared by bytes."""

    def __init__(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, of: np.ndarray):
        self.raw = data.tobytes() + bytes(8)
        self.eight = np.ndarray(len(data) + 1, "<u8", self.raw, strides=(1,))  # the eight bytes from each place on
        self.start, self.size, self.of = start, end - start, of

    def chunk(self, words: np.ndarray, k: int) -> np.ndarray:
        """Bytes 8k to 8k + 7 of the words, as a number; beyond a word's end they are zero."""
        rest = np.clip(self.size[words] - 8 * k, 0, 8)
        at = np.minimum(self.start[words] + 8 * k, len(self.eight) - 1)
        mask = np.where(rest == 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * np.minimum(rest, 7)).astype(np.uint64)) - np.uint64(1))
        return self.eight[at] & mask

    def bytes(self, word: int) -> bytes:
        return self.raw[self.start[word] : self.start[word] + self.size[word]]

    def hashes(self) -> np.ndarray:
        out = self.of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.size.astype(np.uint64)
        long = self.size > LONG
        words = np.flatnonzero(~long)
        for k in range(LONG // 8):
            words = words[self.size[words] > 8 * k]
            if not len(words):
                break
            h = (out[words] ^ self.chunk(words, k)) * np.uint64(0xFF51AFD7ED558CCD)
            out[words] = h ^ (h >> np.uint64(32))
        for word in np.flatnonzero(long):
            out[word] ^= np.uint64(hash(self.bytes(word)) & 0xFFFFFFFFFFFFFFFF)
        return out ^ (out >> np.uint64(29))

    def equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether words ``a`` and ``b`` are of one text and equal."""
        same = (self.of[a] == self.of[b]) & (self.size[a] == self.size[b])
        pairs = np.flatnonzero(same & (a != b))
        for k in range(LONG // 8):
            pairs = pairs[self.size[a[pairs]] > 8 * k]
            if not len(pairs):
                return same
            differ = self.chunk(a[pairs], k) != self.chunk(b[pairs], k)
            same[pairs[differ]] = False
            pairs = pairs[~differ]
        for p in pairs[self.size[a[pairs]] > LONG]:
            same[p] = self.bytes(a[p]) == self.bytes(b[p])
        return same

    def distinct(self, texts: int) -> np.ndarray:
        """Distinct words of each text: all words look for a place in one open table, in rounds.

        A word takes a free place, or ends at one that an equal word holds, or goes on to the next.
        """
        size = 1 << max(4, int(2 * len(self.start)).bit_length())
        table = np.full(size, -1, np.int64)
        place = (self.hashes() & np.uint64(size - 1)).astype(np.int64)
        words, found = np.arange(len(self.start)), np.zeros(texts, np.int64)
        while len(words):
            free = table[place] < 0
            table[place[free]] = words[free]
            held = table[place]
            found += np.bincount(self.of[words[held == words]], minlength=texts)
            go = ~self.equal(words, held)
            words, place = words[go], (place[go] + 1) & (size - 1)
        return found


def counts(texts: list[bytes]) -> list[np.ndarray]:
    """Words, distinct words, capitals, code points and symbols of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=bounds[1:])
    marks = transduce(data)
    start, end = np.flatnonzero(marks & BEGINS), np.flatnonzero(marks & ENDED)
    many = np.diff(np.searchsorted(start, bounds))
    of = np.repeat(np.arange(len(texts)), many)
    among = lambda bit: np.diff(np.searchsorted(np.flatnonzero(marks & bit), bounds))
    words = Words(data, start, end, of)
    return [many, words.distinct(len(texts)), among(IS_CAPITAL), among(IS_CHAR) - 1, among(IS_SYMBOL)]


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """For each row: doc_id, part, digest (of the text), n_words, n_distinct, n_capitals, n_chars and n_symbols.

    Null text is empty, a null part the empty string; a null id stays null.  Whole texts are read, some
    megabytes at a time and one text at least.
    """
    names = ("n_words", "n_distinct", "n_capitals", "n_chars", "n_symbols")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 2 << 20):
            found = [pa.array(c.astype(np.int64)) for c in counts(utf8(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *found], names=["doc_id", "part", "digest", *names])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text"))
    return rows.mapInArrow(count, "doc_id long, part string, digest binary, " + ", ".join(f"{n} long" for n in names))


def failures(measured: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, copy: str = COPY) -> DataFrame:
    """(part, mask, good, toxic, n): how many rows fail just the filters of the mask, bit k for the k-th of ``filters`` and ``copy`` last.

    A row fails ``copy`` if a smaller id has its text; a null id counts as the largest, and rows of one
    id are no copies of each other.  Labels are (doc_id, quality, toxic); of several for one id any 1 counts.
    A text's copies are added up by what else counts before its smallest id is sought, so they meet no
    task as rows.
    """
    mask = reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.expr(c), 1 << k).otherwise(0) for k, c in enumerate(filters.values())], F.lit(0))
    rows = saved(measured.select("doc_id", "part", "digest", mask.alias("mask")))
    known = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    no = F.lit(False)
    named = rows.filter("doc_id is not null").join(known, "doc_id", "left").withColumn("good", F.coalesce("good", no)).withColumn("toxic", F.coalesce("toxic", no))
    what = ["digest", "part", "mask", "good", "toxic"]
    cells = named.groupBy("doc_id", *what).agg(F.count("*").alias("n"))
    nameless = rows.filter("doc_id is null").select("doc_id", "digest", "part", "mask", no.alias("good"), no.alias("toxic"), F.lit(1).cast("long").alias("n"))
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n")))
    cells = cells.unionByName(nameless).groupBy(*what).agg(F.sum("n").alias("n"), least.alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))
    originals = F.when(first.isNull(), F.col("n")).when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    split = cells.withColumn("originals", originals).select(
        "part", "good", "toxic",
        F.explode(F.array(
            F.struct(F.col("mask"), F.col("originals").alias("n")),
            F.struct(F.col("mask").bitwiseOR(F.lit(1 << len(filters))).alias("mask"), (F.col("n") - F.col("originals")).alias("n")),
        )).alias("x"),
    )
    return split.filter("x.n > 0").groupBy("part", F.col("x.mask").alias("mask"), "good", "toxic").agg(F.sum("x.n").alias("n"))


def orders(failed: DataFrame, names: str = "".join(FILTERS) + COPY) -> DataFrame:
    """A row for each part, order of the filters and step, with what the step's filter does there.

    All counts follow from the rows of ``failures``, of which a part has 4 times 2 to the number of filters at most.
    """
    alphabet, step = F.lit(names), F.col("step")
    rows = failed.withColumn("filter_order", F.explode(F.split(F.lit(",".join(map("".join, permutations(names)))), ",")))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(names)))))
    rows = rows.withColumn("filter", F.substr("filter_order", step, F.lit(1)))

    def bits(which) -> Column:
        return reduce(lambda a, b: a.bitwiseOR(b), [F.when(which(F.instr("filter_order", c)), 1 << k).otherwise(0) for k, c in enumerate(names)])

    rows = rows.withColumn("bit", F.lit(1) * F.pow(F.lit(2), F.instr(alphabet, F.col("filter")) - 1).cast("int")).withColumn("before", bits(lambda at: at < step))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("mask").bitwiseAND(F.col("before")) != 0
    many = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0)).cast("long")
    table = rows.groupBy("part", "filter_order", "step", "filter").agg(
        many(~fails & ~gone).alias("kept"),
        many(fails & ~gone).alias("removed"),
        many(fails & gone).alias("redundant"),
        many(F.col("mask") == F.col("bit")).alias("unique_fails"),
        many(fails & ~gone & F.col("good")).alias("good_lost"),
        many(fails & ~gone & F.col("toxic")).alias("toxic_lost"),
    )
    return table.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, str] = FILTERS, copy: str = COPY, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """For each part, order of the filters (letters) and step: kept, removed, redundant (fails, but was
    removed before), unique_fails (fails this filter alone), good_lost, toxic_lost and shapley (removed,
    summed over all orders).

    Filters are conditions on the columns of ``measures``, ``copy`` is the letter of the one for copied
    texts.  Nulls, repeated rows and ids are as in ``measures`` and ``failures``; an empty table gives
    an empty one, and other columns play no part.
    """
    return orders(failures(measures(docs, id_col, text_col, part_col), labels, filters, copy), "".join(filters) + copy).drop("filter")
