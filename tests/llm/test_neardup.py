"""Blocks in which near-duplicate candidates meet: all pairs of different components, and no component itself."""

import random

import pytest

from popspark.llm import neardup


@pytest.mark.parametrize("sizes", [(30,), (1, 1), (25, 1), (9, 14, 2, 1, 1, 3), (2,) * 12])
def test_blocks_bring_different_components_together(spark, monkeypatch, sizes):
    monkeypatch.setattr(neardup, "BLOCK", 4)
    rng = random.Random(3)
    rows = [(g, 1000 * g + 100 * k, rng.randrange(1 << 40), 1.0) for g in (1, 2) for k, n in enumerate(sizes) for _ in range(n)]
    out = neardup._in_blocks(spark.createDataFrame(rows, "cluster long, root long, rep long, weight double"), "cluster").collect()
    meetings, copies = {}, {}
    for r in out:
        meetings.setdefault((r.cluster, r.lo, r.hi), []).append(r)
        copies.setdefault(r.rep, set()).add((r.lo, r.hi))
    met = {(a.rep, b.rep) for own in meetings.values() for a in own if a.block == a.lo for b in own if b.block == b.hi}
    for g, root, rep, _ in rows:
        for g2, root2, rep2, _ in rows:
            assert g != g2 or root == root2 or (rep, rep2) in met or (rep2, rep) in met
    # A component of many blocks meets the few others, not itself.
    if sizes == (25, 1):
        assert all(len(copies[rep]) == 1 for _, root, rep, _ in rows if root % 1000 == 0)
    if sizes == (30,):
        assert not out


def drawn(rng, docs):
    """Texts in which many are alike: some linked, some just below the threshold."""
    vocabulary = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(3000)]
    out = []
    while len(out) < docs:
        words = rng.choices(vocabulary, k=rng.randint(20, 90))
        for _ in range(rng.randint(1, 9)):
            mine = list(words)
            for _ in range(rng.randint(0, 5)):
                mine[rng.randrange(len(mine))] = rng.choice(vocabulary)
            out.append(" ".join(mine))
    return out[:docs]


def expected(texts):
    sets = [{tuple(t.split()[k : k + 4]) for k in range(len(t.split()) - 3)} for t in texts]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


@pytest.mark.parametrize(("block", "loaded", "hot"), [(512, 1 << 18, 1000), (8, 150, 3)])
def test_links_whatever_is_held_at_once(spark, monkeypatch, block, loaded, hot):
    """Small blocks, sets in small parts and hot keys dealt out: the same components as of all pairs."""
    for name, value in (("BLOCK", block), ("LOADED", loaded), ("HOT", hot), ("FEWEST", 3)):
        monkeypatch.setattr(neardup, name, value)
    texts = drawn(random.Random(8), 160)
    texts += [texts[0]] * 60 + [texts[5]] * 9
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(docs, shingle=4).collect()}
    assert [got[i] for i in range(len(texts))] == expected(texts)


def test_links_of_two_blocks(monkeypatch):
    """The blocks of a cluster by themselves: each two components that a pair links are joined, in parts of any size."""
    import numpy as np
    import pyarrow as pa
    import zstandard

    texts = [t.encode() for t in drawn(random.Random(9), 60)]
    sets = neardup.shingle_sets(texts, 4)
    minima = neardup._Minima()
    table = pa.table({
        "block": [k % 2 for k in range(60)], "root": list(range(60)), "n_shingles": [len(s) for s in sets],
        "signature": pa.array([(minima(s) & np.uint32(0xFF)).astype(np.uint8).tobytes() for s in sets], pa.binary()), "z": pa.array([zstandard.ZstdCompressor().compress(t) for t in texts], pa.binary()),
    })
    linked = {(i, j) for i in range(0, 60, 2) for j in range(1, 60, 2) for c in [len(np.intersect1d(sets[i], sets[j]))] if 100 * c >= 80 * (len(sets[i]) + len(sets[j]) - c)}

    def joined(pairs):
        own = neardup._Joined()
        for a, b in pairs:
            own.join(a, b)
        return [own.find(i) for i in range(60)]

    for loaded in (1, 100, 1 << 18):
        monkeypatch.setattr(neardup, "LOADED", loaded)
        out = neardup._links(4, 80)((), table).to_pydict()
        pairs = set(zip(out["u"], out["v"], strict=True))
        assert pairs <= linked and joined(pairs) == joined(linked) and linked
