"""run() against brute force: every stage again in plain Python, over nulls, repeats, odd texts and clashing columns."""

import datetime
import hashlib
import re
import zlib
from collections import Counter
from decimal import Decimal

import numpy as np
import public_tokenizers
from pyspark.sql import Row
from test_llm import WORD, corpus, plain_best_fit

import corpus_pipeline
from popspark.llm import mixing, packing, quality, substring

EXTRA = "id int, row string, size double, n int, extra string, rep long, carried string, `of` string, copy int, text_hash long, salt int, kept boolean, `c.d` timestamp, `q``t` decimal(20,3), deep struct<a:array<int>,`x.y`:map<string,double>>, raw binary, day date, there timestamp_ntz"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + EXTRA


def good(rows):
    """Measures, votes, expectation-maximisation and posteriors."""
    names, votes, failed = list(quality.RULES), [], []
    for r in rows:
        text = r[1] or ""
        w = WORD.findall(text)
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        lines = [x for x in text.split("\n") if WORD.search(x)]
        count = lambda chars: sum(ch in chars for ch in text)  # noqa: B023, E731
        m = {
            "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": count(quality.SYMBOLS), "n_symbol_words": sum(x[-1] in quality.SYMBOLS for x in w),
            "n_symbol_kinds": len(set(text) & set(quality.SYMBOLS)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)),
            "n_repeat_words": len({p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}),
            "n_capitals": count("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), "n_shouts": count("!"), "n_ends": count(".?!"),
        }
        holds = lambda rule: eval(re.sub(r"(?<![<>])=", "==", rule), {}, m)  # noqa: B023, E731, S307
        votes.append([-1 if holds(bad) else 1 if holds(fine) else 0 for bad, fine in quality.RULES.values()])
        failed.append(m["n_words"] < 50 or 100 * m["n_repeat_words"] > 50 * m["n_words"])
    v = np.array(votes)
    share, right, wrong = quality.GOOD_SHARE, np.full(len(names), quality.RIGHT_GOOD), np.full(len(names), quality.RIGHT_BAD)
    for k in range(quality.ROUNDS + 1):
        a = share * np.where(v == 1, right, np.where(v == -1, 1 - right, 1)).prod(axis=1)
        b = (1 - share) * np.where(v == -1, wrong, np.where(v == 1, 1 - wrong, 1)).prod(axis=1)
        p = a / (a + b)
        if k < quality.ROUNDS:
            clip = lambda x: np.clip(x, quality.LOW, quality.HIGH)
            share = clip(p.mean())
            right = clip((((v == 1) * p[:, None]).sum(axis=0) + quality.RIGHT_GOOD * 2) / (((v != 0) * p[:, None]).sum(axis=0) + 2))
            wrong = clip((((v == -1) * (1 - p[:, None])).sum(axis=0) + quality.RIGHT_BAD * 2) / (((v != 0) * (1 - p[:, None])).sum(axis=0) + 2))
    return [r for r, x, bad in zip(rows, p, failed, strict=True) if x >= quality.KEEP and not bad]


def one_of_each(rows, shingle=5):
    sets = []
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    root = {r[0]: r[0] for r in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            x, y = rows[i][0], rows[j][0]
            if x is not None and y is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
    return [r for r in rows if r[0] is None or find(r[0]) == r[0]]


def without_repeats(rows, span=substring.SPAN):
    key = lambda r: (1, 0) if r[0] is None else (0, r[0])
    first = {}
    for r in sorted(rows, key=key):
        b = (r[1] or "").encode()
        for i in range(len(b) - span + 1):
            first.setdefault(b[i : i + span], key(r))
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] < key(r):
                gone[i : i + span] = b"\1" * span
        rest, at = "", 0
        for ch in r[1] or "":  # a character stays unless all its bytes go
            size = len(ch.encode())
            rest += "" if all(gone[at : at + size]) else ch
            at += size
        out.append((r[0], rest, r[2], r[3], len(rest), *r[5:]))
    return out


def mixed(rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[k % len(mixing.WEIGHTS)] for k, s in enumerate(order)}
    capped = set()
    while True:
        rest = mixing.SHARE * sum(sizes.values()) - sum(mixing.MOST * sizes[s] for s in capped)
        goal = {s: mixing.MOST * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order}
        over = {s for s in order if goal[s] > mixing.MOST * sizes[s] + 1e-9}
        if not over:
            break
        capped |= over
    out = []
    for r in rows:
        rate = goal[r[3]] / sizes[r[3]] if sizes[r[3]] else 0.0
        u = int(hashlib.md5(f"{mixing.SEED}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16) / 2**32
        out += [r] * (int(rate) + (u < rate - int(rate)))
    return out


def pieces(rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    out = Counter()
    for r in rows:
        ids = [*library.encode(r[1], add_special_tokens=False).ids, packing.END]
        first = len(ids) % packing.CAPACITY or packing.CAPACITY
        for piece, start in enumerate([0, *range(first, len(ids), packing.CAPACITY)]):
            part = ids[start : first + piece * packing.CAPACITY]
            out[r[0], piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return out


def hashable(value):
    if isinstance(value, tuple | list):
        return tuple(map(hashable, value))
    return tuple(sorted(value.items())) if isinstance(value, dict) else bytes(value) if isinstance(value, bytearray) else value


def test_run_against_brute_force(spark, tmp_path):
    at = datetime.datetime(2024, 2, 29, 23, 59, 58, 456789)
    deep = Row(**{"a": [1, None, 3], "x.y": {"k.`": 0.1, "n": float("inf")}})
    extra = (1, "r", 0.5, 2, "{}", 3, None, "o", 4, 5, 6, True, at, Decimal("12345678901234567.891"), deep, b"\x00\xff", at.date(), at)
    rows = [(*r[:4], len(r[1] or ""), *(extra if r[0] is None or r[0] % 2 else (None,) * len(extra))) for r in corpus(3)]
    rows.append((len(rows) + 5, "Ünïcödé ¡½¾ wörds " * 3 + rows[8][1], "en", "b", 0, *extra))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    docs, expected = spark.read.parquet(f"{tmp_path}/documents.parquet"), rows
    plain = [good, one_of_each, without_repeats, mixed]
    for (name, stage), again in zip(corpus_pipeline.STAGES[:-1], plain, strict=True):
        before, expected = len(expected), again(expected)
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and Counter(map(hashable, out.collect())) == Counter(map(hashable, expected)), name
        assert len(expected) != before or again is without_repeats  # each decision takes effect
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert any(len(r[1]) < len(o[1]) for r in expected for o in rows if o[1] and o[0] == r[0])  # texts have been cut
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == pieces(expected)
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len(places) <= plain_best_fit([r.length for r in out], packing.CAPACITY)
    for own in places.values():
        ends = [sum(n for o, n in own if o < offset) for offset, _ in own]
        assert ends == [offset for offset, _ in own] and sum(n for _, n in own) <= packing.CAPACITY
