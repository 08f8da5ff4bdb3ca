"""Exact removal of repeated passages, by suffix arrays over shards of the corpus.

A byte goes if a string of ``span`` bytes that covers it also starts in a document with a smaller
id.  Shards have to hold equal strings together, so they are cut by content:

1. ``_pack``: documents become blocks of some megabytes, compressed, written once.
2. ``_fingerprints``: each block sends the hashes of the minimizers of its windows (windows.py) to
   hash buckets, each hash once; a bucket answers with a bit for each: do two documents have it?
   Only windows whose minimizer is shared can repeat.  It also names the hot ones, which have many runs.
3. ``_pieces``: each block sends the bytes of those runs of windows, each distinct string once with
   its smallest and largest document id, to the shard its minimizer names.  Of a hot minimizer, each
   window goes by itself, to the shard that its bytes name.
4. ``_shard``: a shard builds the suffix array of its strings (suffix.py) and the permuted common
   prefixes; suffixes that share ``span`` bytes form a group, whose smallest document id is the
   answer for the windows that begin there.
5. ``_apply``: each block marks the windows whose answer is smaller than their document's id.

What a task holds is bounded by the block (or one document, if that is longer: some tens of bytes for
each of its bytes) and by the shard, whose number follows the input; the strings around a common
phrase, of which each document has its own, are dealt out by windows.  A passage that any number of
documents share comes once from each block.  Blocks meet their answers by the block's number, so no
step depends on how many rows a key has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from . import suffix, windows
from .common import released, saved, slices, utf8

SPAN = 50
BLOCK = 8 << 20  # bytes of text in a block
BUCKET = 1_000_000  # hashes in a bucket, about
SHARD = 5 << 20  # bytes of strings sent to a shard, about
HOT = 4096  # runs of a minimizer from which its windows are dealt out
FEW = 16  # runs of a minimizer in a block that count as one
LAST = np.iinfo(np.int64).max  # the id that a null id counts as

ROW = "key long, src long, kind int, weight long, payload binary"
_ROW = pa.schema([("key", pa.int64()), ("src", pa.int64()), ("kind", pa.int32()), ("weight", pa.int64()), ("payload", pa.binary())])


def _dump(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed string."""
    head = np.array([len(arrays), *(a.nbytes for a in arrays)], np.int64).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + b"".join(a.tobytes() for a in arrays))


def _load(payload: bytes, *kinds: type) -> list[np.ndarray]:
    raw = memoryview(zstandard.ZstdDecompressor().decompress(payload))
    n = len(kinds)
    sizes = np.frombuffer(raw[8 : 8 + 8 * n], np.int64)
    out, at = [], 8 + 8 * n
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.frombuffer(raw[at : at + size], kind))
        at += int(size)
    return out


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(_ROW)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _ROW, strict=True)], schema=_ROW)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (n, id, extra, text) into blocks; a block's number is its first row's."""
    held: list[tuple[int, int, bytes, bytes]] = []
    size = 0

    def block() -> pa.RecordBatch:
        numbers, ids, extra, texts = zip(*held, strict=True)
        lengths = np.array([len(x) for x in texts], np.int64)
        payload = _dump(
            np.array(ids, np.int64), lengths, np.frombuffer(b"".join(texts), np.uint8),
            np.array([len(x) for x in extra], np.int64), np.frombuffer(b"".join(extra), np.uint8),
        )
        return _rows([(numbers[0], -1, 0, int(lengths.sum()), payload)])

    for batch in slices(batches, "text"):
        ids = batch.column(1).fill_null(LAST).to_pylist()
        for row in zip(batch.column(0).to_pylist(), ids, utf8(batch.column(2)), utf8(batch.column(3)), strict=True):
            held.append(row)
            size += len(row[3])
            if size >= BLOCK:
                yield block()
                held, size = [], 0
    if held:
        yield block()
    held = []
    released(None)


class _Block:
    """A block's documents and the runs of their windows."""

    def __init__(self, payload: bytes, span: int, buckets: int):
        self.ids, self.lengths, self.data, self.extra_lengths, self.extra = _load(payload, np.int64, np.int64, np.uint8, np.int64, np.uint8)
        self.runs = r = windows.runs(self.data, self.lengths, span)
        # Minimizers are the smallest of many hashes; mixed anew, they are spread evenly over the buckets.
        spread = windows.mix(r.hash.copy())
        bucket = ((spread >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        key = (bucket << np.uint64(32)) | (spread & np.uint64(0xFFFFFFFF))
        order = np.argsort(key)
        sorted_key = key[order]
        begin = np.flatnonzero(np.r_[True, sorted_key[1:] != sorted_key[:-1]]) if len(key) else order
        self.key = sorted_key[begin]
        doc = r.doc[order]
        self.many = np.diff(np.r_[begin, len(key)]) if len(key) else order
        self.several = np.minimum.reduceat(doc, begin) != np.maximum.reduceat(doc, begin) if len(key) else np.zeros(0, bool)
        self.number = np.empty(len(key), np.int64)
        self.number[order] = np.cumsum(np.r_[True, sorted_key[1:] != sorted_key[:-1]]) - 1 if len(key) else 0

    def forget(self) -> None:
        """Of the block only its documents are needed from now on."""
        del self.runs, self.key, self.many, self.several, self.number

    def by_bucket(self) -> Iterator[tuple[int, slice]]:
        bucket = (self.key >> np.uint64(32)).astype(np.int64)
        some, first, many = np.unique(bucket, return_index=True, return_counts=True)
        for b, f, m in zip(some.tolist(), first.tolist(), many.tolist(), strict=True):
            yield b, slice(f, f + m)


def _fingerprints(span: int, buckets: int) -> Callable:
    def sent(key: int, payload: bytes) -> pa.RecordBatch:
        block = _Block(payload, span, buckets)
        low = (block.key & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        rows = []
        for b, s in block.by_bucket():
            often = np.flatnonzero(block.many[s] > FEW)
            counts = often.astype(np.int32).tobytes() + block.many[s][often].astype(np.int32).tobytes()
            rows.append((b, key, 1, s.stop - s.start, np.packbits(block.several[s]).tobytes() + low[s].tobytes() + counts))
        return _rows(rows)

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                yield released(sent(key, payload.as_py()))

    return fingerprints


def _shared(hot: int) -> Callable:
    def shared(key: tuple, table: pa.Table) -> pa.Table:
        return released(_answers(key, table, hot))

    return shared


def _answers(key: tuple, table: pa.Table, hot: int) -> pa.Table:
    """For each block's hashes in a bucket: a bit if more than one document has it; then the numbers of the hot ones."""
    sizes = table.column("weight").to_pylist()
    low, several, runs = [], [], []
    for size, payload in zip(sizes, table.column("payload"), strict=True):
        raw, bits = payload.as_buffer(), -(-size // 8)
        several.append(np.unpackbits(np.frombuffer(raw, np.uint8, bits), count=size).astype(bool))
        low.append(np.frombuffer(raw, np.uint32, size, bits))
        often, counts = np.frombuffer(raw.to_pybytes()[bits + 4 * size :], np.int32).reshape(2, -1)
        runs.append(np.ones(size, np.int64))
        runs[-1][often] = counts
    value = np.concatenate(low)
    order = np.argsort(value, kind="stable")
    new = np.r_[True, np.diff(value[order]) != 0]
    begin = np.flatnonzero(new)
    many = np.diff(np.r_[begin, len(value)])
    shared = (many > 1) | np.logical_or.reduceat(np.concatenate(several)[order], begin)
    bit, is_hot = np.empty(len(value), bool), np.empty(len(value), bool)
    bit[order] = np.repeat(shared, many)
    is_hot[order] = np.repeat(shared & (np.add.reduceat(np.concatenate(runs)[order], begin) > hot), many)
    rows, at, bucket = [], 0, key[0].as_py()
    for src, size in zip(table.column("src").to_pylist(), sizes, strict=True):
        own = bit[at : at + size]
        rows.append((src, bucket, 1, int(own.sum()), np.packbits(own).tobytes() + np.flatnonzero(is_hot[at : at + size]).astype(np.int32).tobytes()))
        at += size
    return pa.Table.from_batches([_rows(rows)])


class _Pieces:
    """The distinct strings of a block's runs whose minimizer is shared, sorted by shard: of a hot one, each window by itself."""

    def __init__(self, block: _Block, answers: dict[int, bytes], span: int, shards: int):
        shared, hot = block.several.copy(), np.zeros(len(block.several), bool)
        for b, s in block.by_bucket():
            if b in answers:
                many = s.stop - s.start
                bits = -(-many // 8)
                shared[s] |= np.unpackbits(np.frombuffer(answers[b], np.uint8, bits), count=many).astype(bool)
                hot[s.start + np.frombuffer(answers[b][bits:], np.int32)] = True
        r = block.runs
        run = np.flatnonzero(shared[block.number]) if len(block.number) else np.zeros(0, np.int64)
        each = np.where(hot[block.number[run]], (r.last - r.first)[run] + 1, 1)
        alone = np.repeat(hot[block.number[run]], each)
        self.begin = np.repeat(r.first[run] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        run = np.repeat(run, each)
        self.doc = r.doc[run]
        self.width = width = -(-(2 * span - windows.GRAM) // 8) * 8
        size = np.where(alone, 0, (r.last - r.first)[run]) + span
        data = np.concatenate([block.data, np.zeros(width, np.uint8)])
        rows = windows.padded(data, self.begin, size, width)
        one, number = windows.distinct(rows, size)
        doc = block.ids[self.doc]
        low, high = np.full(len(one), LAST), np.full(len(one), np.iinfo(np.int64).min)
        np.minimum.at(low, number, doc)
        np.maximum.at(high, number, doc)
        hashes = r.hash[run][one]
        own = np.flatnonzero(alone[one])
        for word in rows[one[own]].view("<u8").T:
            hashes[own] = (hashes[own] * np.uint64(0x9FB21C651E98DF25) + word) ^ (hashes[own] >> np.uint64(28))
        hashes = windows.mix(hashes)
        shard = (((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.rows, self.size, self.low, self.high, self.shard = rows[one[order]], size[one[order]], low[order], high[order], shard[order]
        self.piece = place[number]  # of each string of the block, at ``begin`` in ``doc``

    def by_shard(self) -> Iterator[tuple[int, slice]]:
        some, first, many = np.unique(self.shard, return_index=True, return_counts=True)
        for b, f, m in zip(some.tolist(), first.tolist(), many.tolist(), strict=True):
            yield b, slice(f, f + m)


def _with_answers(blocks: pa.Table, answers: pa.Table) -> tuple[bytes, dict[int, bytes], dict[int, bytes]]:
    """The block's payload, what the buckets said and what the shards said."""
    said: tuple[dict, dict] = ({}, {})
    for src, kind, payload in zip(answers.column("src").to_pylist(), answers.column("kind").to_pylist(), answers.column("payload"), strict=True):
        said[kind - 1][src] = payload.as_py()
    return blocks.column("payload")[0].as_py(), *said


def _pieces(span: int, buckets: int, shards: int) -> Callable:
    def pieces(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        return released(sent(key, blocks, answers))

    def sent(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        payload, bits, _ = _with_answers(blocks, answers)
        p = _Pieces(_Block(payload, span, buckets), bits, span, shards)
        rows = []
        for shard, s in p.by_shard():
            size = p.size[s]
            text = p.rows[s][np.arange(p.width) < size[:, None]]
            rows.append((shard, key[0].as_py(), 2, len(size), _dump(text, size.astype(np.int16), p.low[s], p.high[s])))
        return pa.Table.from_batches([_rows(rows)])

    return pieces


def _shard(span: int) -> Callable:
    def shard(key: tuple, table: pa.Table) -> pa.Table:
        return released(found(key, table))

    def found(key: tuple, table: pa.Table) -> pa.Table:
        loaded = [_load(x.as_py(), np.uint8, np.int16, np.int64, np.int64) for x in table.column("payload")]
        text, size, low, high = (np.concatenate(x) for x in zip(*loaded, strict=True))
        size = size.astype(np.int64)
        begin = np.cumsum(size) - size
        width = -(-(2 * span - windows.GRAM) // 8) * 8
        text = np.concatenate([text, np.zeros(width, np.uint8)])
        one, number = windows.distinct(windows.padded(text, begin, size, width), size)
        least = np.full(len(one), LAST)
        np.minimum.at(least, number, low)

        # The distinct strings one after the other, each with a separator.
        # Places fit 32 bits, as they do in the suffix array.
        own = size[one]
        at = np.cumsum(own + 1) - own - 1
        total = int((own + 1).sum())
        of = np.repeat(np.arange(len(one), dtype=np.int32), own + 1)
        where = np.arange(total, dtype=np.int32)
        where += (begin[one] - at).astype(np.int32)[of]
        t = text[np.minimum(where, len(text) - 1, out=where)].astype(np.int16)
        t += np.int16(2)
        t[at + own] = 1
        where = np.arange(total, dtype=np.int32)
        is_start = where <= (at + own - span).astype(np.int32)[of]
        del text, where

        sa = suffix.suffix_array(np.r_[t, np.int16(0)], span)
        data = np.r_[np.where(t > 1, t - 2, 0).astype(np.uint8), np.zeros(span + 8, np.uint8)]
        prefix = suffix.common_prefixes(data, np.r_[is_start, False], sa, span)
        order = sa[np.r_[is_start, False][sa]]
        begins = np.flatnonzero(prefix[order] < span)
        group = np.minimum.reduceat(least[of[order]], begins)
        answer = np.empty(total, np.int64)
        answer[order] = np.repeat(group, np.diff(np.r_[begins, len(order)]))

        # Stretches of one answer in each distinct string.
        start = np.flatnonzero(is_start)
        value, owner = answer[start], of[start]
        cut = np.r_[True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])]
        s = np.flatnonzero(cut)
        value, owner, first = value[s], owner[s], start[s] - at[owner[s]]
        last = start[np.r_[s[1:], len(start)] - 1] - at[owner]
        many = np.bincount(owner, minlength=len(one))
        base = np.cumsum(many) - many

        rows, entry = [], 0
        for src, (_, sizes, _, top) in zip(table.column("src").to_pylist(), loaded, strict=True):
            n = number[entry : entry + len(sizes)]
            each = many[n]
            index = np.repeat(base[n] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
            mine = np.repeat(np.arange(len(n)), each)
            hit = value[index] < top[mine]
            if hit.any():
                i = index[hit]
                rows.append((src, key[0].as_py(), 2, int(hit.sum()), _dump(mine[hit].astype(np.int32), first[i].astype(np.int16), last[i].astype(np.int16), value[i])))
            entry += len(sizes)
        return pa.Table.from_batches([_rows(rows)])

    return shard


def _removed(block: _Block, bits: dict[int, bytes], found: dict[int, bytes], span: int, shards: int) -> np.ndarray:
    """True for each byte of the block that goes."""
    # Stretches of windows begin at different bytes and end at different ones, so a byte lies in few of them.
    change = np.zeros(len(block.data) + 1, np.int16)
    if found:
        p = _Pieces(block, bits, span, shards)
        pieces, first, last, value = [], [], [], []
        for shard, s in p.by_shard():
            if shard in found:
                a, b, c, d = _load(found[shard], np.int32, np.int16, np.int16, np.int64)
                for to, x in ((pieces, a.astype(np.int64) + s.start), (first, b), (last, c), (value, d)):
                    to.append(x)
        piece, first, last, value = (np.concatenate(x) for x in (pieces, first, last, value))
        order = np.argsort(piece, kind="stable")
        piece, first, last, value = piece[order], first[order], last[order], value[order]
        many = np.bincount(piece, minlength=len(p.size))
        base = np.cumsum(many) - many
        each = many[p.piece]
        index = np.repeat(base[p.piece] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        string = np.repeat(np.arange(len(p.piece)), each)
        hit = value[index] < block.ids[p.doc[string]]
        index, begin = index[hit], p.begin[string[hit]]
        change[begin + first[index]] += 1
        change[begin + last[index] + span] -= 1
    return np.cumsum(change[:-1], dtype=np.int16) > 0


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary, extra string"
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary()), ("extra", pa.string())])


def _apply(span: int, buckets: int, shards: int, texts: bool) -> Callable:
    def apply(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        return released(judged(key, blocks, answers))

    def judged(key: tuple, blocks: pa.Table, answers: pa.Table) -> pa.Table:
        payload, bits, found = _with_answers(blocks, answers)
        block = _Block(payload, span, buckets)
        gone = _removed(block, bits, found, span, shards)
        del payload, bits, found
        block.forget()
        ends = np.cumsum(block.lengths)
        begins = ends - block.lengths
        extra_ends = np.cumsum(block.extra_lengths)
        kept, digests, removed, spans = [], [], [], []
        for a, b in zip(begins.tolist(), ends.tolist(), strict=True):
            data, own = block.data[a:b], gone[a:b]
            removed.append(int(np.count_nonzero(own)))
            spans.append(int(own[0]) + int(np.count_nonzero(own[1:] > own[:-1])) if removed[-1] else 0)
            rest = (data[~own] if removed[-1] else data).tobytes()
            digests.append(hashlib.sha256(rest).hexdigest())
            if texts:
                kept.append(_whole(data, own) if removed[-1] else rest)
        extra = [bytes(block.extra[b - n : b]).decode() for b, n in zip(extra_ends.tolist(), block.extra_lengths.tolist(), strict=True)]
        ids = pa.array(block.ids, mask=block.ids == LAST)
        cols = [ids, block.lengths, removed, spans, digests, kept or [None] * len(digests), extra]
        return pa.Table.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(cols, _RESULT, strict=True)], schema=_RESULT)

    return apply


def _whole(data: np.ndarray, gone: np.ndarray) -> bytes:
    """The remaining bytes; of a character that only partly goes, all bytes stay."""
    lead = (data & 0xC0) != 0x80
    char = np.cumsum(lead) - 1
    all_gone = np.logical_and.reduceat(gone, np.flatnonzero(lead))
    return data[~all_gone[char]].tobytes()


LONGEST = 32_767  # bytes of a string between two windows

# How other columns are written down: to the microsecond, in one time zone, and with nulls told from missing values.
WRITTEN = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timeZone": "UTC", "ignoreNullFields": "false"}


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _numbered(docs: DataFrame, names: list[str]) -> StructType:
    return StructType([StructField(f"c{k}", docs.schema[n].dataType) for k, n in enumerate(names)])


def carried(docs: DataFrame, names: list[str]) -> dict[str, Column]:
    """The columns ``names`` of ``docs`` as they were, out of the column extra of ``remove_repeats``."""
    read = F.from_json("extra", _numbered(docs, names), WRITTEN | {"mode": "FAILFAST"})
    return {n: read[f"c{k}"] for k, n in enumerate(names)}


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, texts: bool = False, extra: list[str] | None = None, hot: int = HOT) -> DataFrame:
    """Remove each byte covered by a ``span``-byte string that also starts in a document with a smaller id.

    Returns for each row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256, kept (with ``texts``: the remaining bytes, whole characters only) and extra (the
    columns named in ``extra``, to be read by ``carried``).  Minimizers with more than about ``hot`` runs are dealt out by windows.

    Texts count as UTF-8 bytes, null as empty; matches never cross documents, and are judged on the
    input.  Rows of one id don't take from each other.  A null id counts as larger than all others,
    and comes back as null.  A text shorter than ``span`` is never changed; an empty table gives an
    empty one.  Other columns of ``docs`` play no part, whatever their names.
    """
    if span < windows.GRAM + 6:
        raise ValueError("span is too short for the minimizers")
    if 2 * span > LONGEST:
        raise ValueError("lengths of strings would not fit")
    # By number, as names may hold anything.
    packed = F.to_json(F.struct(*(F.col(_quoted(c)).alias(f"c{k}") for k, c in enumerate(extra))), WRITTEN) if extra else F.lit("")
    rows = docs.select(F.monotonically_increasing_id().alias("n"), F.col(id_col).cast("long").alias("id"), packed.alias("extra"), F.col(text_col).alias("text"))
    blocks = saved(rows.mapInArrow(_pack, ROW))
    total = blocks.agg(F.sum("weight")).first()[0] or 0
    buckets = max(16, total // 12 // BUCKET)
    sent = blocks.select("key", "payload").mapInArrow(_fingerprints(span, buckets), ROW)
    bits = saved(sent.groupBy("key").applyInArrow(_shared(hot), ROW))
    shared = bits.agg(F.sum("weight")).first()[0] or 0
    shards = max(24, shared * 100 // SHARD)
    bits = bits.filter("weight > 0")

    def meet(answers: DataFrame, what: Callable, schema: str) -> DataFrame:
        """Each block with its answers; a block without any is there as well."""
        none = blocks.selectExpr("key", "-1L src", "0 kind", "0L weight", "cast(null as binary) payload").limit(0)
        return blocks.groupBy("key").cogroup(answers.unionByName(none).groupBy("key")).applyInArrow(what, schema)

    pieces = meet(bits, _pieces(span, buckets, shards), ROW)
    found = pieces.groupBy("key").applyInArrow(_shard(span), ROW)
    return meet(bits.unionByName(found), _apply(span, buckets, shards, texts), RESULT)
