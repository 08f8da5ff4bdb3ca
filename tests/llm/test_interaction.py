"""The filter audit against plain loops over documents and orders."""

import random
import re
from collections import Counter
from itertools import permutations

import pytest

from popspark.llm import interaction

WORD = re.compile(rb"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, part string, n double, digest string, mask int, good string"


def measure(text):
    words = WORD.findall(text)
    return len(words), len(set(words)), sum(65 <= c <= 90 for c in text), len(text.decode()), sum(c in b"#$%&*|" for c in text)


def test_transducer_and_table():
    rng = random.Random(3)
    pool = ["a", "B", "é", "日", "😀", " ", "\n", "#", "|", "\x0b", "\x1f", "\x00", "abc", "x" * 70, "y" * 70 + "z", "x" * 69 + "q", " "]
    for _ in range(200):
        texts = ["".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 5, 50, 700]))).encode() for _ in range(rng.randint(1, 12))]
        assert list(zip(*(c.tolist() for c in interaction.counts(texts)), strict=True)) == [measure(t) for t in texts]


def test_words_of_equal_hashes_are_told_apart(monkeypatch):
    import numpy as np

    monkeypatch.setattr(interaction.Words, "hashes", lambda self: np.zeros(len(self.start), np.uint64))
    texts = [b"a b c a " + b"w" * 80 + b" " + b"w" * 81, b"b a b", b""]
    assert interaction.counts(texts)[1].tolist() == [5, 2, 0]


def expected(rows, labels):
    first = {}
    for r in rows:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    quality, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    docs = []
    for r in rows:
        n, distinct, capitals, chars, symbols = measure((r[1] or "").encode())
        least = first.get(r[1] or "")
        copy = least is not None and (r[0] is None or r[0] > least)
        fails = {k for k, bad in zip("ABCDE", (n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * chars, symbols > 0, copy), strict=True) if bad}
        docs.append((r[2] or "", fails, r[0] in quality, r[0] in toxic))
    out, removed_by = {}, Counter()
    for part in {d[0] for d in docs}:
        for order in permutations("ABCDE"):
            left = [d for d in docs if d[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                removed = [d for d in left if f in d[1]]
                left = [d for d in left if f not in d[1]]
                removed_by[part, f] += len(removed)
                row = (len(left), len(removed), sum(f in d[1] for d in gone), sum(d[0] == part and d[1] == {f} for d in docs), sum(d[2] for d in removed), sum(d[3] for d in removed))
                out[part, "".join(order), step] = row
                gone += removed
    return {k: (*v, removed_by[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    prose = lambda n, pool: " ".join(rng.choice(pool) for _ in range(n))
    wide = [f"w{k}" for k in range(4000)]
    out = []
    for i in range(150):
        text = rng.choice([prose(120, wide), prose(99, wide), prose(150, wide[:60]), prose(130, wide).upper(), prose(110, wide) + " # x", "", None, "same text", "é日 " * 60, "A"])
        out.append((i, text, rng.choice(["en", "de", "", None])))
    out += [out[3], out[3], (None, "same text", None), (None, "only here", "en"), (None, "only here", "en"), (151, "y " * 40000, "en"), (152, "z" * 300000, "de")]
    return out


def test_audit(spark, rows):
    rng = random.Random(6)
    labels = [(rng.randrange(160), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(120)] + [(None, 1, 1)]
    docs = spark.createDataFrame([(*r, "p", 0.5, "d", 1, "g") for r in rows], SCHEMA).repartition(4)
    out = interaction.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r)[:3]: tuple(r)[3:] for r in out.collect()} == expected(rows, labels)
    assert out.count() == 120 * 5 * 3  # null and the empty string are one part


def test_audit_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert interaction.audit(none, labels).count() == 0
    one = spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string")
    assert {tuple(r)[:3]: tuple(r)[3:] for r in interaction.audit(one, labels).collect()} == expected([(1, None, None)], [])


def test_copies_do_not_meet_as_rows(spark):
    rows = [(i, "one text", "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    failed = interaction.failures(interaction.measures(docs), labels).collect()
    assert sorted((r.mask, r.n) for r in failed) == [(1, 1), (1 + 16, 2999)]
