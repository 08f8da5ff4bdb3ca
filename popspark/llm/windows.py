"""Fixed-length byte windows grouped by minimizer, as NumPy arrays.

Every window of ``span`` bytes has one minimizer: of the hashes of its ``gram``-byte strings the
smallest, the leftmost among equals.  It depends on the window's bytes alone, so equal windows of
two documents have equal minimizers.  Consecutive windows mostly share one: a *run* of them needs
one hash and its bytes once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

GRAM = 26
SEGMENT = 1 << 18  # windows handled at once; positions in a segment need fewer than POSITION bits
POSITION = 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    out = []
    for base in (_BASE, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes (in place)."""
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    return h


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A hash of the ``gram`` bytes from each position on."""
    n = len(data)
    up, down = _powers(1 << (n - 1).bit_length() if n else 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = sums[gram:] - sums[:-gram]
    h *= down[: len(h)]
    return mix(h)


def _window_min(a: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        a = np.minimum(a[:-have], a[have:])
        have *= 2
    if have < width:
        a = np.minimum(a[: -(width - have)], a[width - have :])
    return a


@dataclass
class Runs:
    """Windows ``first`` to ``last`` (both included; byte offsets of their starts), their minimizer's
    64-bit hash and the index of their document."""

    first: np.ndarray
    last: np.ndarray
    hash: np.ndarray
    doc: np.ndarray


def runs(data: np.ndarray, lengths: np.ndarray, span: int, gram: int = GRAM) -> Runs:
    """The runs of all windows inside the documents that follow each other in ``data``.

    A document of fewer than ``span`` bytes has none.  A run never crosses the edge of a document or
    of a segment.
    """
    lengths = lengths.astype(np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    many = np.maximum(lengths - span + 1, 0)
    total = len(data)
    parts: list[tuple] = []
    for s in range(0, max(total - span + 1, 0), SEGMENT):
        stop = min(s + SEGMENT, total - span + 1)  # windows s .. stop - 1
        h = gram_hashes(data[s : stop + span - 1], gram)
        keyed = (h >> np.uint64(POSITION)) << np.uint64(POSITION)
        keyed |= np.arange(len(h), dtype=np.uint64)
        at = (_window_min(keyed, span - gram + 1) & np.uint64((1 << POSITION) - 1)).astype(np.int32)
        cut = np.empty(len(at), bool)
        cut[0] = True
        np.not_equal(at[1:], at[:-1], out=cut[1:])
        a, b = np.searchsorted(ends, s, "right"), np.searchsorted(begins, stop, "left")
        edges = np.r_[begins[a:b], begins[a:b] + many[a:b]] - s
        cut[edges[(edges >= 0) & (edges < len(at))]] = True
        first = np.flatnonzero(cut)
        last = np.r_[first[1:], len(at)] - 1
        doc = np.searchsorted(ends, first + s, "right")
        inside = first + s < (begins + many)[doc]
        first, last = first[inside], last[inside]
        parts.append((first + s, last + s, h[at[first]], doc[inside]))
    if not parts:
        return Runs(*(np.zeros(0, k) for k in (np.int64, np.int64, np.uint64, np.int64)))
    return Runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def padded(data: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """The ``size`` bytes from each ``first`` on as rows of ``width`` bytes with zeros after them.

    data: with ``width`` more bytes at the end.
    """
    out = np.lib.stride_tricks.sliding_window_view(data, width)[first]
    out[np.arange(width) >= size[:, None]] = 0
    return out


def distinct(rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ``padded`` rows: one index for each distinct string, and each row's number among these.

    Strings are sorted by a hash and told apart by their bytes.
    """
    words = rows.view("<u8")
    h = size.astype(np.uint64)
    for k in range(words.shape[1]):
        h = h * np.uint64(0x9FB21C651E98DF25) + words[:, k]
        h ^= h >> np.uint64(28)
    order = np.argsort(mix(h), kind="stable")
    if not len(order):
        return order, order
    new = np.ones(len(order), bool)
    a, b = order[1:], order[:-1]
    new[1:] = (size[a] != size[b]) | (words[a] != words[b]).any(axis=1)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number
