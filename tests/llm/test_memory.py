"""What tasks hold at once, as traced by Python (NumPy's arrays included)."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import zstandard

from popspark.llm import neardup, substring


def _traced(what, *args):
    tracemalloc.start()
    try:
        out = what(*args)
        return out, tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_blocks_and_shards_are_held_in_a_few_arrays():
    rng = np.random.default_rng(3)
    letters = lambda n: rng.integers(97, 123, n, dtype=np.uint8).tobytes().decode()
    texts = [letters(2000) for _ in range(1000)]
    texts += [t[:500] + letters(1500) for t in texts]
    n, size = len(texts), 4_000_000
    rows = pa.RecordBatch.from_arrays([pa.array(range(n), pa.int64())] * 2 + [pa.array([""] * n), pa.array(texts)], names=["n", "id", "extra", "text"])
    blocks, key = pa.Table.from_batches(list(substring._pack(iter([rows])))), (pa.scalar(0),)
    sent = substring._pieces(50, 16, 1)(key, blocks, blocks.slice(0, 0))
    found, most = _traced(substring._shard(50), key, sent)
    assert most < 36 * size  # 44 times before, 28 now
    out, most = _traced(substring._apply(50, 16, 1, True), key, blocks, found)
    assert most < 20 * size  # 32 times before, 14 now
    assert all(500 <= k < 510 for k in out.column("n_removed").to_pylist()[n // 2 :])
    assert set(out.column("n_spans").to_pylist()[: n // 2]) == {0} and set(out.column("n_spans").to_pylist()[n // 2 :]) == {1}


def test_long_texts_are_confirmed_a_few_at_a_time():
    rng = np.random.default_rng(4)
    words = [f"w{k}" for k in range(5000)]
    texts = [" ".join(rng.choice(words, 50_000)) for _ in range(80)]
    z = [zstandard.ZstdCompressor(level=1).compress(t.encode()) for t in texts]
    one = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array(range(40, 80)), pa.array(z[:40]), pa.array(z[:15] + z[55:])], names=["u", "v", "zu", "zv"])
    out, most = _traced(lambda: pa.Table.from_batches(neardup._confirm(5, 80)(iter([one]))))
    assert out.column("u").to_pylist() == list(range(15))
    assert most < 80 << 20
