"""Token counts by heap-and-linked-list byte-pair merging."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, slices

MODEL = "piece_bpe_32k.model"
LIMIT = 4096
SPACE = "▁"  # stands for a space in the vocabulary


class PieceCounter:
    """Counts the tokens of a text under a piece vocabulary.

    A space becomes SPACE, and one stands before the text.  The symbols are the characters.  The
    adjacent pair whose joint piece ranks lowest (of equals the leftmost) merges first: the pairs
    wait in a heap, the symbols in a doubly linked list.  A merge takes one symbol away, so the
    count is the initial symbols minus the merges; a character that is no piece counts its UTF-8
    bytes, as byte pieces stand in for it.  No identifier is ever looked up.

    No piece has SPACE after another character and none holds a line break, so that no merge
    crosses such a place, and the words between them can be counted one by one.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        scores = {}
        for i in range(model.get_piece_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
                scores[model.id_to_piece(i)] = -model.get_score(i)
        order = {score: k for k, score in enumerate(sorted(set(scores.values())))}
        self.rank = {piece: order[score] for piece, score in scores.items()}  # equal scores, equal ranks
        self.single = {piece for piece in scores if len(piece) == 1}
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in scores):
            raise ValueError("the vocabulary has pieces across words")
        self._word = Remembered(lambda w: self.merged(SPACE + w))
        self._rest = Remembered(self.merged)
        self._chunk = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")

    def merged(self, text: str) -> int:
        """The tokens of ``text`` as it is (spaces are SPACE already)."""
        n, get = len(text), self.rank.get
        count = n if self.single.issuperset(text) else sum(1 if c in self.single else len(c.encode()) for c in text)
        # An entry is rank * n + the position of the left symbol: lowest rank first, then leftmost.
        heap = [r * n + i for i in range(n - 1) if (r := get(text[i : i + 2])) is not None]
        heapify(heap)
        symbol = list(text)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            r, i = divmod(heappop(heap), n)
            left, j = symbol[i], after[i]
            if not left or j == n or get(piece := left + symbol[j]) != r:
                continue  # one of the two has merged meanwhile
            symbol[i], symbol[j] = piece, ""
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if (r := get(piece + symbol[k])) is not None:
                    heappush(heap, r * n + i)
            if (h := before[i]) >= 0 and (r := get(symbol[h] + piece)) is not None:
                heappush(heap, r * n + h)
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        total, first = -1, True
        for line in text.split("\n"):
            total += 1  # the line break: no piece, one byte
            parts = line.split(" ")
            if SPACE in line or "" in parts:  # runs of spaces, or the sign itself
                chunk = (SPACE if first else "") + line.replace(" ", SPACE)
                total += sum(self._rest[c] for c in self._chunk.findall(chunk))
            else:
                if not first:
                    total += self._rest[parts[0]]
                    del parts[0]
                total += sum(map(self._word.__getitem__, parts))
            first = False
        return total


@lru_cache(2)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, limit: int = LIMIT) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens and over_limit (more than ``limit``).

    model: a path, or a file name in the installed tokenizers.  Null text counts as empty and has no
    token; a null id stays null; repeated rows give repeated rows; an empty table an empty one.
    Other columns play no part.  Each row is counted by itself, whole, whatever its length.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        own = counter(model if "/" in model else public_tokenizers.path(model))
        for batch in slices(batches, "text"):
            sums = [own.count(x or "") for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sums, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
