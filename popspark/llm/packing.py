"""Packing documents into sequences: Martello-Toth reduction, then best fit.

Only how many pieces of each length there are matters for the packing, at most ``capacity`` numbers
however many documents; the driver packs these.  It gives *shares*: of the pieces of one length,
ranked anyhow, the ranks from .. to go to the sequences from .. to, at this offset.  Spark ranks the
pieces and looks up the shares.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Remembered, saved, slices, utf8

CAPACITY = 2048
TOKENIZER = "byte_bpe_50k.json"
END = 0  # the identifier after each document
CHUNK = 1000  # pieces that are ranked together, about
SLICE = 2 << 20  # bytes of texts whose words are cut out together


class Share(NamedTuple):
    """Of the pieces of one length the ranks first .. first + many - 1: ``each`` of them to a
    sequence, from number ``sequence`` on, one after the other from ``offset`` on."""

    length: int
    first: int
    many: int
    each: int
    sequence: int
    offset: int


class _Instance:
    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = np.zeros(capacity + 1, np.int64)
        for length, many in counts.items():
            if not 1 <= length <= capacity:
                raise ValueError(f"length {length} with capacity {capacity}")
            self.left[length] = many
        self.done = np.zeros(capacity + 1, np.int64)
        self.shares: list[Share] = []
        self.sequences = 0

    def give(self, length: int, many: int, each: int, sequence: int, offset: int) -> None:
        self.shares.append(Share(length, int(self.done[length]), many, each, sequence, offset))
        self.done[length] += many
        self.left[length] -= many

    def fix(self, lengths: list[int], times: int) -> None:
        """``times`` sequences with just these pieces."""
        offset = 0
        for length in lengths:
            self.give(length, times, 1, self.sequences, offset)
            offset += length
        self.sequences += times


def reduce_instance(own: _Instance, at_once: bool = True) -> None:
    """Fix every set that provably dominates all other sets with its longest piece; equal sets
    ``at_once``, as long as enough of each length is left for the same reasons to hold.

    From the longest piece j on, with room r beside it: alone, if nothing fits; with the longest
    piece a that fits, if no two others fit, if it fills the sequence, or if it is as long as the
    longest two that fit together (when no three do); with a and the longest b that fits beside
    both, if no three fit and every two that fit are at most a and b.  In each case what any other
    set has beside j can be exchanged for what this one has.
    """
    left, capacity = own.left, own.capacity
    for j in range(capacity, 0, -1):
        while left[j]:
            left[j] -= 1  # j itself is not beside j
            room = capacity - j
            have = np.flatnonzero(left[: room + 1])
            smallest: list[int] = []
            for x in have[:3]:
                smallest += [int(x)] * int(min(3, left[x]))
            smallest = smallest[:3]
            fits = sum(1 for k in range(len(smallest)) if sum(smallest[: k + 1]) <= room)
            best: list[int] | None = None
            if fits == 0:
                best = [j]
            else:
                a = int(have[-1])
                if fits == 1 or a == room:
                    best = [j, a]
                elif fits == 2:
                    left[a] -= 1
                    rest = np.flatnonzero(left[: room - a + 1])
                    left[a] += 1
                    b = int(rest[-1]) if len(rest) else 0
                    above = np.flatnonzero(left[b + 1 : room + 1]) + b + 1
                    two = [int(x) for x in above[:2] for _ in range(int(min(2, left[x])))][:2]
                    if b and (len(two) < 2 or sum(two) > room):
                        best = [j, a, b]
                    elif _longest_two(left, have, room) <= a:
                        best = [j, a]
            left[j] += 1
            if best is None:
                break
            need = {x: best.count(x) for x in best}
            times = max(1, min((int(left[x]) - 4) // n for x, n in need.items())) if at_once else 1
            own.fix(best, int(left[j]) if len(best) == 1 and at_once else times)


def _longest_two(left: np.ndarray, have: np.ndarray, room: int) -> int:
    """The largest length of two pieces that fit together."""
    best, lo, hi = 0, 0, len(have) - 1
    while lo <= hi:
        total = int(have[lo] + have[hi])
        if total > room:
            hi -= 1
        elif lo == hi and left[have[lo]] < 2:
            break
        else:
            best = max(best, total)
            lo += 1
    return best


def best_fit(own: _Instance) -> None:
    """The remaining pieces, longest first, each into the fullest open sequence that has room."""
    capacity = own.capacity
    opened: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room: (first sequence, how many)
    for length in range(capacity, 0, -1):
        while (todo := int(own.left[length])) > 0:
            room = next((r for r in range(length, capacity) if opened[r]), capacity)
            each = room // length
            if room == capacity:
                start, many = own.sequences, max(1, todo // each)
                own.sequences += many
            else:
                start, many = opened[room].pop()
            used = min(many, max(1, todo // each))
            given = min(todo, used * each)
            own.give(length, given, each, start, capacity - room)
            if many > used:
                opened[room].append((start + used, many - used))
            opened[room - given // used * length].append((start, used))


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Share], int]:
    """The shares of all lengths, and the number of sequences.  No pieces give no shares; a length
    below 1 or above ``capacity`` is refused."""
    own = _Instance(counts, capacity)
    reduce_instance(own)
    best_fit(own)
    return own.shares, own.sequences


class ByteIds:
    """Identifiers of texts under a byte-level vocabulary, as little-endian 32-bit numbers.

    The vocabulary's words come from a fixed pattern and are encoded one by one.  Many texts are cut
    into words at once, by the kinds of adjacent bytes; of equal words one is looked up, and the
    identifiers of a word that comes again are remembered.  Texts with other characters than those
    the pattern is sure to split as the library does (controls, letters beyond Latin) or with the
    end-of-text mark go to the library as a whole.
    """

    _LETTERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ"
    _NUMBERS = "0-9²³¹¼-¾"
    _SPACES = "\t\n\r "
    _SURE = "\t\n\r -~¡-¬®-ɏ"
    LETTER, NUMBER, MARK, BLANK, UNSURE, BETWEEN = range(6)

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        if self.library.normalizer is not None:
            raise ValueError("the vocabulary changes texts before it splits them")
        self.model = self.library.model
        self.kinds = np.full(0x280, self.UNSURE, np.uint8)  # by code point, as far as a lead byte of ɏ goes
        for kind, among in ((self.MARK, self._SURE), (self.LETTER, self._LETTERS), (self.NUMBER, self._NUMBERS), (self.BLANK, self._SPACES)):
            self.kinds[[c for c in range(0x280) if re.match(f"[{among}]", chr(c))]] = kind
        self.bytes = np.where(np.arange(256) < 0x80, self.kinds[:256], self.UNSURE)
        # The vocabulary's characters for bytes: those that can be printed stand for themselves, the others for 256, 257, ..
        shown = np.isin(np.arange(256), [*range(33, 127), *range(161, 173), *range(174, 256)])
        self.letters = np.where(shown, np.arange(256), 255 + (~shown).cumsum()).astype("<u4")
        self.ids = Remembered(None)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _known(self, words: list[bytes]) -> list[bytes]:
        """The identifiers of different words."""
        out = list(map(self.ids.get, words))
        new = [k for k, found in enumerate(out) if found is None]
        text = self.letters[np.frombuffer(b"".join([words[k] for k in new]), np.uint8)].tobytes().decode("utf-32-le")
        flat: list[int] = []
        at, stops = 0, [0]
        for k in new:
            word, at = text[at : at + len(words[k])], at + len(words[k])
            flat += [t.id for t in self.model.tokenize(word)]
            stops.append(len(flat))
        found = np.array(flat, "<u4").tobytes()
        for k, start, stop in zip(new, stops, stops[1:], strict=False):
            out[k] = found[4 * start : 4 * stop]
            self.ids.keep(words[k], out[k])
        return out

    def _starts(self, data: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Where words start.  They are runs of one kind, with a space before them, if there is one;
        the white space before that; and what stands for a verb after an apostrophe."""
        starts = np.ones(len(data), bool)
        np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
        starts[kinds == self.BETWEEN] = True
        last = np.flatnonzero((kinds[:-1] == self.BLANK) & (kinds[1:] < self.BLANK))
        starts[last] = True
        starts[last + 1] = data[last] != 32
        at = np.flatnonzero(data == ord("'"))
        at = at[starts[at]]
        one, two = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
        size = np.where(np.isin(one, list(b"stmd")), 2, 0)
        for a, b in (b"re", b"ve", b"ll"):
            size[(one == a) & (two == b)] = 3
        at, size = at[size > 0], size[size > 0]
        starts[at + 1] = False
        starts[at + size] = True
        return starts

    def encode(self, texts: list[bytes], end: int) -> list[memoryview]:
        """The identifiers of each text, and ``end``."""
        if not texts:
            return []
        tail = int(end).to_bytes(4, "little")
        ends = np.cumsum([len(t) + 1 for t in texts]) - 1
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        kinds = self.bytes[data]
        pair = np.flatnonzero((data >= 0xC2) & (data <= 0xC9))  # lead bytes of U+0080 to U+027F
        pair = pair[data[pair + 1] & 0xC0 == 0x80]
        kinds[pair] = kinds[pair + 1] = self.kinds[(data[pair] & 0x1F).astype(np.int64) << 6 | data[pair + 1] & 0x3F]
        kinds[ends] = self.BETWEEN
        unsure = kinds == self.UNSURE
        unsure[:-1] |= (data[:-1] == ord("<")) & (data[1:] == ord("|"))
        odd = set(np.searchsorted(ends, np.flatnonzero(unsure)).tolist())
        if odd:
            out = self.encode([b"" if k in odd else t for k, t in enumerate(texts)], end)
            for k in odd:
                out[k] = memoryview(self.whole(texts[k].decode()) + tail)
            return out
        offsets = np.append(np.flatnonzero(self._starts(data, kinds)), len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        codes = words.indices.to_numpy()
        known = self._known(words.dictionary.to_pylist())
        known[codes[-1]] = tail  # the word between texts
        length = np.fromiter(map(len, known), np.int64, len(known)) // 4
        many = length[codes]
        stop = many.cumsum()
        place = np.repeat((length.cumsum() - length)[codes] - (stop - many), many) + np.arange(stop[-1])
        ids = memoryview(np.frombuffer(b"".join(known), "<u4")[place].tobytes())
        edges = (4 * stop[codes == codes[-1]]).tolist()
        return [ids[a:b] for a, b in zip([0, *edges], edges, strict=False)]


@lru_cache(2)
def byte_ids(path: str) -> ByteIds:
    return ByteIds(path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The pieces of each document: its identifiers and ``end``, cut into pieces of ``capacity`` if
    there are more; then the first piece takes what is over.  Null text is empty: the end alone.  A
    null id stays null, repeated rows are cut each, an empty table gives an empty one."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        own = byte_ids(tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer))
        for batch in slices(batches, "text", SLICE):
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), own.encode(utf8(batch.column(1)), end), strict=True):
                total = len(ids) // 4
                first = total % capacity or capacity
                for piece, start in enumerate([0, *range(first, total, capacity)]):
                    size = first if not piece else capacity
                    rows.append((doc, piece, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pieces, PIECES)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens.

    Returns per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset.  Only longer
    documents are cut.  Null text is empty: one token, the end.  A null id stays null; repeated rows
    are packed each; an empty table gives an empty one.  Other columns play no part.
    """
    pieces = saved(cut(docs, id_col, text_col, tokenizer, capacity, end))
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    shares, _ = plan(counts, capacity)
    spark = docs.sparkSession
    # A row for each of at most ``capacity`` lengths: a length has chunks as it has pieces.
    deals = spark.createDataFrame([(length, many // CHUNK + 1) for length, many in counts.items()], "length long, chunks long")
    # By their places in the written table, so that any number of equal rows is dealt out as well.
    dealt = pieces.withColumn("place", F.xxhash64(F.monotonically_increasing_id())).join(F.broadcast(deals), "length")
    dealt = dealt.withColumn("chunk", F.pmod("place", "chunks")).drop("place", "chunks")
    many = dealt.groupBy("length", "chunk").agg(F.count("*").alias("many"))
    before = Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    many = many.select("length", "chunk", F.coalesce(F.sum("many").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("at", F.row_number().over(inside) - 1).join(many, ["length", "chunk"]).withColumn("rank", F.col("base") + F.col("at"))
    # A few shares for each of at most ``capacity`` lengths.
    table = spark.createDataFrame([tuple(s) for s in shares], "length long, first long, many long, each long, sequence long, place long")
    table = F.broadcast(table.withColumnRenamed("length", "of"))
    k = F.col("rank") - F.col("first")
    return ranked.join(table, (F.col("length") == F.col("of")) & (k >= 0) & (k < F.col("many"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("sequence") + F.expr("(rank - first) div each")).alias("sequence_id"),
        (F.col("place") + k % F.col("each") * F.col("length")).alias("offset"),
    )
