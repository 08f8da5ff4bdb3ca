"""License spans: verified by cover, place and order; held against plain loops and the SQL."""

import random

import pytest

from popspark.llm import licenses
from popspark.llm.licenses import COVER, GRAM, LOOSE, PHRASES, TEMPLATES

NOTICE = TEMPLATES[0][0].split()


def scanned(spark, texts, **kinds):
    out = licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **kinds).collect()
    return {r.doc_id: r for r in out}


def plain(text):
    """Labels and score by loops over all places and diagonals."""
    words, labels, score = text.split(), set(), 0.0
    for t, (template, label) in enumerate(PHRASES + TEMPLATES):
        own = template.split()
        where = {}
        for i in range(len(words) - GRAM + 1):
            for j in range(len(own) - GRAM + 1):
                if words[i : i + GRAM] == own[j : j + GRAM]:
                    where.setdefault(i - j, set()).update(range(j, j + GRAM))
        for d in where:
            loose = 0 if t < len(PHRASES) else LOOSE
            share = len(set().union(*(p for e, p in where.items() if d <= e <= d + loose))) / len(own)
            score = max(score, share)
            if share >= (1 if t < len(PHRASES) else COVER):
                labels.add(label)
    return ",".join(sorted(labels)), score


def test_spans_against_plain_loops(spark):
    rng = random.Random(8)
    pieces = [t.split() for t, _ in PHRASES + TEMPLATES]
    texts = ["", "a"]
    for _ in range(120):
        words = []
        for _ in range(rng.randint(1, 5)):
            own = rng.choice(pieces)
            a = rng.randrange(len(own))
            own = own[a : a + rng.randint(2, 30)]
            for _ in range(rng.randint(0, 5)):
                own.insert(rng.randrange(len(own) + 1), rng.choice(["x", "the", "license", "software"]))
            words += own + ["y"] * rng.randint(0, 4)
        texts.append(" ".join(words))
    got = scanned(spark, texts)
    for i, text in enumerate(texts):
        labels, score = plain(text)
        assert got[i].labels == labels and abs(got[i].score - score) < 1e-12, text


def test_scattered_words_do_not_match(spark):
    apart = " ".join(" ".join(NOTICE[i : i + 3]) + " and here something else stands for a while" for i in range(0, len(NOTICE), 3))
    half = len(NOTICE) // 2
    turned = " ".join(NOTICE[half:] + NOTICE[:half])
    a_few_more = " ".join(NOTICE[:9] + ["very"] + NOTICE[9:18] + ["much"] + NOTICE[18:])
    # A chain of scattered places before the notice does not hide it.
    chained = " ".join(["to deal in the software"] * 12) + " " + " ".join(NOTICE)
    got = scanned(spark, [apart, turned, a_few_more, chained])
    assert [got[i].labels for i in range(4)] == ["", "", "mit", "mit"]
    assert got[0].score < 0.3 and got[1].score < COVER and got[2].score >= COVER and got[3].score == 1
    (span,) = got[2].spans
    assert (span.label, span.first, span.last) == ("mit", 0, len(NOTICE) + 1)
    assert got[3].spans[0].first >= 60 and got[3].spans[0].last == 60 + len(NOTICE) - 1


def test_templates_that_do_not_fit_are_refused(spark):
    with pytest.raises(ValueError):
        scanned(spark, ["a"], templates=(("word " * 63, "long"),))
    with pytest.raises(ValueError):
        scanned(spark, ["a"], phrases=(("two words", "short"),))
    longest = " ".join(f"w{i}" for i in range(62))
    assert scanned(spark, [longest], templates=((longest, "long"),))[0].labels == "long"
