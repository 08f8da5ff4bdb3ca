"""Personal data: forms against plain patterns, disclosure against counts over all documents in plain Python."""

import hashlib
import math
import random
import re
import time

import pytest

from popspark.llm import oracles, privacy

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = str.maketrans(CAPITALS, CAPITALS.lower())
SCHEMA = "doc_id long, text string, digest string, salt string, base int, spans int"


def luhn(text):
    digits = [int(c) for c in text if c in "0123456789"][::-1]
    return 16 <= len(digits) <= 19 and (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def plain(text):
    return [
        [m.span() for m in EMAIL.finditer(text)],
        [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))],
        [m.span() for m in CARD.finditer(text) if luhn(m.group())],
        [m.span() for m in PHONE.finditer(text) if 8 <= sum(c in "0123456789" for c in m.group()) <= 15],
    ]


@pytest.mark.parametrize("alphabet", ["a.@-_ é", "0123.25 ", "0123456789 -", "+0123 ().-", "a@.0+ -19é日😀"])
def test_forms(alphabet):
    rng, hits = random.Random(2), 0
    for _ in range(8000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        assert privacy.find(text) == plain(text), text
        hits += any(plain(text))
    assert hits > 20


@pytest.mark.parametrize("unit", ["@a.b", "1", "a", "@", "1.", "+1 ", "a.b@", "+1((((", "1-", "a@b", "4111 1111 1111 1111 "])
def test_time_follows_the_length(unit):
    text = unit * (1_000_000 // len(unit))
    start = time.time()
    privacy.context(text, privacy.find(text))
    assert time.time() - start < 15


def disclosed(rows):
    """(entity, term) -> kind, by counting in all documents."""
    texts = [r[1] or "" for r in rows]
    near, mentioned, words = {}, {}, []
    for t in texts:
        spans = plain(t)
        covered = {i for kind in spans for a, b in kind for i in range(a, b)}
        tokens = [m.span() for m in TERM.finditer(t) if m.end() - m.start() >= 3]
        free = [s for s in tokens if not covered & set(range(*s))]
        found, entities = set(), set()
        for kind, mentions in zip(privacy.KINDS, spans, strict=True):
            for a, b in mentions:
                e = privacy.entity(kind, t[a:b])
                entities.add(e)
                before, after = [s for s in free if s[0] < a][-8:], [s for s in free if s[0] >= a][:8]
                found |= {(e, t[x:y].translate(LOWER)) for x, y in before + after}
        found |= {(e, w[:3] + "*") for e, w in found}
        for e in entities:
            mentioned[e] = mentioned.get(e, 0) + 1
        for pair in found:
            near.setdefault(pair, []).append(t)
        own = {t[a:b].translate(LOWER) for a, b in tokens}
        words.append(own | {w[:3] + "*" for w in own})

    def tells(e, unit):
        both = near.get((e, unit), [])
        if len(set(both)) < privacy.SUPPORT or mentioned[e] == len(texts):
            return False
        many = sum(unit in w for w in words)
        return math.log(len(texts) * len(both) / (mentioned[e] * many)) >= privacy.DISCLOSES * math.log(len(texts) / mentioned[e])

    return {(e, w): "removed" if tells(e, w[:3] + "*") else "generalised" for e, w in near if not w.endswith("*") and tells(e, w)}


def expected(rows):
    known = disclosed(rows)
    out = []
    for doc, text in rows:
        t = text or ""
        spans = plain(t)
        base = ",".join(f"{k}:{a}:{b}" for k, s in zip(privacy.KINDS, spans, strict=True) for a, b in s)
        hits = {}
        for e, w, a, b in privacy.context(t, spans):
            if kind := known.get((e, w)):
                hits[a, b] = max(kind, hits.get((a, b), ""))
        method = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted((k, a, b) for (a, b), k in hits.items()))
        out.append((doc, *map(len, spans), hashlib.sha256(base.encode()).hexdigest(), ",".join(x for x in (base, method) if x)))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randint(3, 8))) for _ in range(150)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = [prose(rng.randint(20, 60)) for _ in range(60)]
    # 'zyrkon' stands by one address only; 'zyxum' too, but other words begin as it does.
    texts += [f"{prose(9)} Zyrkon zyxum mail to Ann@Example.org {prose(9)}" for _ in range(5)]
    texts += [f"{prose(12)} zyxoo {prose(5)}" for _ in range(30)]
    # An address in copies of one text tells nothing about the words beside it.
    texts += [f"{prose(9)} qwertz bob@example.net {prose(9)}"] * 6
    texts += ["+1 (499) 555-6503, 4111 1111 1111 1111 and 188.54.39.104; not 300.1.1.1, 4111 1111 1111 1112", "", None, "é日😀 a.b@c.de", "x" * 100_000 + "@y.zz", "a@b.c@d.e"]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[61]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, "d", "s", 1, 2) for r in rows], SCHEMA).repartition(4).persist()


def test_scan(docs, rows, monkeypatch):
    out = privacy.scan(docs)
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    want = expected(rows)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == want
    assert any("removed" in r[-1] for r in want) and any("generalised" in r[-1] for r in want)
    assert not any("removed" in r[-1] or "generalised" in r[-1] for r in want if r[1:5] == (0, 0, 0, 0))
    monkeypatch.setattr(privacy, "FEW_UNITS", 0)  # terms beyond what is sent to every task
    assert sorted((tuple(r) for r in privacy.scan(docs).collect()), key=repr) == want


def test_sql_agrees(rows):
    """The query's SQL over documents in which terms are generalised and removed."""
    import duckdb
    import pyarrow as pa

    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())})  # noqa: F841
    cursor = duckdb.connect().execute(oracles.ORACLE["op13_personal_data"])
    assert [d[0] for d in cursor.description] == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    assert sorted(cursor.fetchall(), key=repr) == expected(rows)


def test_sanitise(docs, rows):
    out = {r.doc_id: r for r in privacy.sanitise(docs).collect() if r.doc_id is not None}
    assert "[email]" in out[61].text and "[...]" in out[61].text and "zyx*" in out[61].text and "yrkon" not in out[61].text
    assert out[5].text == rows[5][1] and out[5].spans == ""
    assert privacy.mask("call +1 23 now", "card:5:9,phone:5:10") == "call [card] now"  # what overlaps is masked to its end
    nulls = [r for r in privacy.sanitise(docs).collect() if r.text is None]
    assert len(nulls) == sum(r[1] is None for r in rows)


def test_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert privacy.scan(none).count() == 0 and privacy.sanitise(none).count() == 0
