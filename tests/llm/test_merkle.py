"""The Merkle manifest against whole trees in plain Python, and its layout against the recursive definition."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from popspark.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, tree int, size double, place int, leaf string"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def lowered(text):
    return None if text is None else "".join(c.lower() if c in CAPITALS else c for c in text)


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest("".join(out[-1][k : k + 16])) for k in range(0, len(out[-1]), 16)])
    return out


def way_up(levels, i):
    for nodes in levels[:-1]:
        start = i - i % 16
        yield "".join(nodes[start:i]), "".join(nodes[i + 1 : start + 16])
        i //= 16


def expected(rows):
    by = {}
    for r in rows:
        own, other = (digest("".join(map(field, (r[0], r[3], r[2], r[4], t)))) for t in (r[1], lowered(r[1])))
        tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
        by.setdefault(r[3], []).append((r[0] is not None, r[0] or 0, own, other if tampered else own))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = [levels_of([x[2] for x in sorted(by[s])]) for s in sources]
    top = levels_of([t[-1][0] for t in trees]) if trees else []
    out = Counter()
    for k, s in enumerate(sources):
        for i, (named, doc, own, claimed) in enumerate(sorted(by[s])):
            steps = [*way_up(trees[k], i), *way_up(top, k)]
            folded = claimed
            for a, b in steps:
                folded = digest(a + folded + b)
            root = top[-1][0]
            out[doc if named else None, own, trees[k][-1][0], root, digest("".join(a + b for a, b in steps)), folded, folded == root] += 1
    return out


def audited(spark, rows, levels):
    docs = spark.createDataFrame([(*r, "r", 1, 0.5, 2, "l") for r in rows], SCHEMA).repartition(5)
    lower = F.translate("text", CAPITALS, CAPITALS.lower())
    handed = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lower).otherwise(F.col("text"))
    return merkle.manifest(docs, handed_in={"text": handed}, levels=levels)


def some(n, sources, seed):
    rng = random.Random(seed)
    names = [None, *(f"s{k}é" for k in range(sources))]
    rows = [(i, rng.choice(["Ab c", None, "", "é日 Text", "x" * 3000]), rng.choice(["en", None]), "s0é" if i % 3 == 0 else rng.choice(names), rng.choice([None, i])) for i in range(n)]
    return rows + [rows[0], rows[0], (None, "X", None, None, None), (None, "X", None, None, None), (None, None, None, "s0é", 3)]


# Blocks of 1, 16 or 256 leaves, so trees have several tiers; a lone leaf, a lone source, many sources.
@pytest.mark.parametrize(("rows", "levels"), [([], 4), ([(1, "A", "en", "s", 1)], 4), ([(k, "A", "en", "s", 1) for k in range(17)], 2), (some(1500, 3, 1), 2), (some(700, 300, 2), 3), (some(300, 20, 3), 4)])
def test_manifest(spark, rows, levels):
    m = audited(spark, rows, levels)
    out = merkle.audit(m)
    assert Counter(tuple(r) for r in out.collect()) == expected(rows)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def test_manifest_of_large_groups(spark):
    rows = [(i, "Text" if i % 2 else "text", "en", "hot" if i % 3 else "cold", i) for i in range(9000)]
    m = audited(spark, rows, 3)
    most = max(r.n for t in m.tiers for r in t.collect())
    assert most <= 256 and len(m.tiers) == 2  # a task holds a block, whatever a source has
    assert Counter(tuple(r) for r in merkle.audit(m).collect()) == expected(rows)


def test_layout():
    def order(levels, n, root=(0, 0)):
        """Nodes (depth, number) in the order of the layout, by its definition over single nodes."""
        depth, number = root
        if levels == 1:
            return [root]
        top = levels // 2
        exists = lambda d, i: i < merkle.width(n, total - 1 - d)
        under = [(depth + top, number * 16**top + k) for k in range(16**top)]
        return order(top, n, root) + [x for r in under if exists(*r) for x in order(levels - top, n, r)]

    for total, n in [(1, 1), (2, 1), (2, 16), (3, 17), (3, 256), (4, 257), (4, 1000), (4, 4096), (5, 4097)]:
        listed = [x for x in order(total, n) if x[1] < merkle.width(n, total - 1 - x[0])]
        places = {x: k for k, x in enumerate(listed)}
        assert len(places) == merkle.nodes(total, n)
        for depth in range(total):
            numbers = np.arange(merkle.width(n, total - 1 - depth))
            assert merkle.address(total, n, depth, numbers).tolist() == [places[depth, i] for i in numbers.tolist()]


def test_ways_survive_packing():
    rng = random.Random(4)
    steps = [(bytes(rng.choice(b"0123456789abcdef") for _ in range(64 * a)), bytes(rng.choice(b"0123456789abcdef") for _ in range(64 * b))) for a, b in ((0, 0), (3, 12), (15, 0), (0, 15))]
    assert merkle.unpacked(merkle.packed(steps)) == steps
