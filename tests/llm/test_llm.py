"""The training-data operators against brute force, round trips, held-out accuracy and odd tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from popspark.llm import components, html, licenses, media, mixing, neardup, packing, quality, substring, suffix, tokens, urls

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id int, row string, size double, n int"


def corpus(seed=1, docs=60):
    """Prose with copies, near copies, shared passages, odd and empty texts, and null values."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage = prose(30)
    texts = [prose(rng.randint(60, 300)) for _ in range(docs)]
    texts += [texts[0], texts[0], texts[1] + " tail", texts[2] + "\n" + passage, passage + texts[3], "", " \n\t", None, "one two", "one two", "ONE Two", "x" * 3000, "é" * 200, prose(4000)]
    texts += ["Released under the MIT License. " + texts[5], texts[6] + "\nLicensed under CC BY-NC 4.0.", "<|endoftext|> a\x00b", "### $$$ %%% " * 60]
    rows = [(i, t, "en", rng.choice(["a", "b", None]), len(t or ""), 1, "r", 0.5, 2) for i, t in enumerate(texts)]
    words = texts[7].split()
    words[3] = "changed"
    rows.append((len(rows), " ".join(words), "en", "a", 0, 1, "r", 0.5, 2))
    rows += [rows[4], (None, texts[8], None, "b", None, None, None, None, None), (None, None, None, None, None, None, None, None, None)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_suffix_arrays():
    rng = np.random.default_rng(1)
    for _ in range(100):
        t = np.r_[rng.integers(1, rng.integers(2, 5), rng.integers(0, 60)), 0]
        s = bytes(t.astype(np.uint8))
        assert suffix.suffix_array(t).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_quality(docs, rows, empty):
    def measure(text):
        w = WORD.findall(text or "")
        grams = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {p for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in text or ""), len(lines) - len(set(lines)), len(covered)

    out = quality.judge(docs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    assert by_row(out, "doc_id", *names) == Counter((r[0], *measure(r[1])) for r in rows)
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert all(kept[i] for i in range(60)) and not kept[rows[-4][0] - 1]
    assert quality.judge(empty).count() == 0


def test_mixing(docs, rows, empty, spark):
    out = mixing.mixture(docs).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = [*sorted(s for s in sizes if s is not None), None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal, capped = {}, set()
    while True:  # reshare by weight what is above a limit, until nothing is
        rest = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in capped)
        goal = {s: 2 * sizes[s] if s in capped else rest * weight[s] / sum(weight[x] for x in order if x not in capped) for s in order}
        over = {s for s in order if goal[s] > 2 * sizes[s] + 1e-9}
        if not over:
            break
        capped |= over
    assert all(abs(r.target - goal[r.source]) < 1e-6 and r.source_size == sizes[r.source] for r in out)
    assert all(r.copies in (int(r.rate), int(r.rate) + 1) and r.taken <= 2 * r["size"] for r in out)
    assert mixing.emit(docs).count() == sum(r.copies for r in out)
    assert sorted(mixing.mixture(docs).select("doc_id", "taken").collect(), key=repr) == sorted(((r.doc_id, r.taken) for r in out), key=repr)
    assert mixing.mixture(empty).count() == 0 and mixing.emit(empty).count() == 0
    many = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("source"))
    for r in mixing.mixture(many).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken / r.target - 1) < 0.02


def test_token_counts(docs, rows, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.MODEL))
    expected = Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in rows)
    assert by_row(tokens.count_tokens(docs), "doc_id", "n_bytes", "n_tokens") == expected
    own = tokens.counter(public_tokenizers.path(tokens.MODEL))
    rng = random.Random(5)
    for _ in range(500):
        text = "".join(rng.choice(" \n\tabthe▁<0x>é日😀") for _ in range(rng.randint(0, 50)))
        assert own.count(text) == len(library.encode(text)), text
    assert tokens.count_tokens(empty).count() == 0


def without_repeats(rows, span=50):
    last = 1 << 70
    order = sorted(rows, key=lambda r: last if r[0] is None else r[0])
    first, out = {}, Counter()
    for r in order:
        k, b = last if r[0] is None else r[0], (r[1] or "").encode()
        for i in range(len(b) - span + 1):
            first.setdefault(b[i : i + span], k)
    for r in order:
        k, b = last if r[0] is None else r[0], (r[1] or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if first[b[i : i + span]] < k:
                gone[i : i + span] = b"\1" * span
        rest = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[(r[0], len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest())] += 1
    return out


def test_repeats(docs, rows, empty):
    out = substring.remove_repeats(docs)
    assert by_row(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == without_repeats(rows)
    assert substring.remove_repeats(empty).count() == 0


def test_repeats_with_hot_minimizers(docs, rows):
    out = substring.remove_repeats(docs, hot=2)
    assert by_row(out, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == without_repeats(rows)


def test_strings_around_a_common_phrase_are_dealt_out():
    rng = np.random.default_rng(4)
    letters = lambda n: bytes(rng.integers(97, 123, n).astype(np.uint8))
    texts = [letters(60) + b"a phrase of forty-eight characters, which all have" + letters(60) for _ in range(300)]
    packed = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(range(300)), pa.array([""] * 300), pa.array([x.decode() for x in texts])], names=["n", "id", "extra", "text"])
    (blocks,) = substring._pack([packed])
    sent = pa.Table.from_batches(substring._fingerprints(50, 1)([pa.RecordBatch.from_arrays([blocks.column("key"), blocks.column("payload")], names=["key", "payload"])]))
    block = substring._Block(blocks.column("payload")[0].as_py(), 50, 1)
    share = {}
    for hot in (20, 10_000):
        answer = substring._shared(hot)((pa.scalar(0),), sent).column("payload")[0].as_py()
        p = substring._Pieces(block, {0: answer}, 50, 24)
        share[hot] = np.bincount(p.shard, minlength=24).max() / len(p.shard)
        assert (p.shard < 24).all() and len(p.begin) == len(p.piece)
    assert share[20] < 0.1 and share[10_000] > 0.3


def plain_best_fit(lengths, capacity):
    """Sequences that best fit takes, longest first, without any reduction before."""
    rooms = []
    for x in sorted(lengths, reverse=True):
        fits = [k for k, room in enumerate(rooms) if room >= x]
        if fits:
            rooms[min(fits, key=rooms.__getitem__)] -= x
        else:
            rooms.append(capacity - x)
    return len(rooms)


def test_packing_ids(docs, rows, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    out = packing.pack(docs).collect()
    expected, places, total = Counter(), {}, 0
    for r in rows:
        ids = [*library.encode(r[1] or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        first = len(ids) % packing.CAPACITY or packing.CAPACITY
        for piece, start in enumerate([0, *range(first, len(ids), packing.CAPACITY)]):
            part = ids[start : first + piece * packing.CAPACITY]
            expected[r[0], piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == expected
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert -(-total // packing.CAPACITY) <= len(places) <= plain_best_fit([r.length for r in out], packing.CAPACITY)
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert packing.pack(empty).count() == 0


def test_reduction_costs_no_sequence():
    def least(items, capacity):
        best = [len(items)]

        def go(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(items):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + items[i] <= capacity:
                    bins[k] += items[i]
                    go(i + 1, bins)
                    bins[k] -= items[i]
            go(i + 1, [*bins, items[i]])

        go(0, [])
        return best[0]

    rng = random.Random(2)
    for _ in range(150):
        capacity = rng.randint(5, 30)
        items = sorted((rng.randint(1, capacity) for _ in range(rng.randint(0, 8))), reverse=True)
        own = packing._Instance(dict(Counter(items)), capacity)
        packing.reduce_instance(own)
        rest = [x for x in range(capacity, 0, -1) for _ in range(int(own.left[x]))]
        assert own.sequences + least(rest, capacity) == least(items, capacity)


def test_main_text(spark, empty):
    page = (
        '<html><head><title>t</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav><div class="cookie-notice">We use cookies</div>'
        '<article><h1>Title &amp; more</h1><p>First paragraph of the article,<br>with enough text to count.<p>Short.<div class="ad">Buy</div><script>var a="<p>x</p>";</script><p>Last one.'
        '<section id="comments"><p>Nice</p></section></article><aside>Side</aside><form>q</form><footer>End</footer></body>'
    )
    assert html.main_text(page) == "Title & more\n\nFirst paragraph of the article, with enough text to count.\n\nShort.\n\nLast one."
    assert html.main_text("") == "" and html.main_text("<p>a<b>b") == "ab" and html.main_text("<![foo x") == "<![foo x"
    df = spark.createDataFrame([(1, "u", page), (None, None, None)], "page_id long, url string, html string")
    assert {(r.page_id, r.n_chars) for r in html.extract(df).collect()} == {(1, len(html.main_text(page))), (None, 0)}
    assert html.extract(df.limit(0)).count() == 0


def test_names_of_wrappers_do_not_drop_the_article():
    article = "<h1>Title</h1><p>First paragraph of the article, with enough text to count as content.</p><p>A second one, which is just about as long as the first.</p>"
    text = "Title\n\nFirst paragraph of the article, with enough text to count as content.\n\nA second one, which is just about as long as the first."
    side = '<div class="sidebar"><p>Something about the side.</p></div><div class="cookie-notice"><p>We use cookies.</p></div>'
    for name in ("content-sidebar-wrap", "has-sidebar", "elementor-widget-container", "social-science", "with-banner"):
        assert html.main_text(f'<body><nav>Home</nav><div class="{name}">{article}{side}</div><footer>End</footer></body>') == text, name
        assert html.main_text(f'<body><div id="{name}"><div class="widget">{article}</div>{side}</div></body>') == text, name
    # A section whose name only looks like a menu's stays, though it is not most of the page.
    assert html.main_text(f'<body>{article}<div class="social-science"><p>A short part.</p></div></body>') == text + "\n\nA short part."
    # Comments longer than the article are still comments.
    comments = "<p>Some reader says a lot about this article, and then says it all again.</p>" * 9
    assert html.main_text(f'<body>{article}<div class="comments">{comments}</div></body>') == text
    # Content in parts that are all marked by names is better than nothing.
    assert html.main_text(f'<div class="widget"><p>{"one " * 30}</p></div><div class="widget"><p>{"two " * 30}</p></div>') == "one " * 29 + "one\n\n" + "two " * 29 + "two"



def test_urls(spark):
    rng = random.Random(4)
    made = [f"http://{rng.choice(['www.', 'm.', ''])}{rng.choice('abc')}.example.{rng.choice(['com', 'net'])}/{rng.choice(['en', 'fr', 'es'])}/{i}?a={i % 3}" for i in range(600)]
    odd = [None, "", "nothing", "HTTP://WWW.Example.COM/en/x#f", "http://example.net", "ftp://a.b/://c"]
    df = spark.createDataFrame(list(enumerate(made + odd)), "page_id long, url string")
    got = {r.page_id: r for r in urls.judge(df).collect()}
    for i, url in enumerate(made + odd):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best.name if best else None)
        assert got[i].verdict == best.verdict if best else got[i].verdict in ("allow", "block")
    assert all(r.verdict == "allow" for r in got.values() if r.rule is None)  # no model
    assert urls.judge(df.limit(0)).count() == 0


def test_url_trees_block_what_they_have_shown_to_know(spark):
    rng = random.Random(7)
    kinds = lambda i: "".join(rng.choice("0123456789") for _ in range(12)) if i % 3 == 0 else rng.choice(["news", "about", "people", "places"])
    made = [(i, f"https://{rng.choice(['a', 'b', 'c'])}.example.org/{kinds(i)}/{i % 7}", i % 3 == 0) for i in range(3000)]
    pages = spark.createDataFrame([(i, u) for i, u, _ in made], "page_id long, url string")

    def trained(label):
        labels = spark.createDataFrame([(i, int(not label(x)), 0) for i, _, x in made if i % 2], "doc_id long, quality int, toxic int")
        return urls.train(urls.labelled_urls(pages, labels), trees=5)

    model = trained(lambda bad: bad if rng.random() < 0.95 else not bad)  # one label in twenty is wrong
    assert model.held_out.informative and model.held_out.right > 0.85 > 0.75 > model.held_out.base and model.threshold
    got = {r.page_id: r.verdict for r in urls.judge(pages, rules=(), model=model).collect()}
    assert sum((got[i] == "block") == bad for i, _, bad in made if i % 2 == 0) > 0.95 * 1500  # urls without a label
    # Labels that the urls say nothing about: no gain on the held-out part, so nothing is blocked.
    model = trained(lambda bad: rng.random() < 0.3)
    assert model.held_out.urls > 100 and model.threshold is None
    assert urls.judge(pages, rules=(), model=model).filter("verdict = 'block'").count() == 0
    for model in (urls.train(urls.labelled_urls(pages.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int"))), trained(lambda bad: True)):
        assert model.threshold is None and urls.judge(pages, rules=(), model=model).filter("verdict = 'block'").count() == 0
    odd = spark.createDataFrame([(0, None, None), (1, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert [tuple(r) for r in urls.labelled_urls(pages, odd).collect()] == [(made[1][1], 1.0)]


def test_urls_are_labelled_by_their_pages(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    good = lambda: "".join(f"<p>{' '.join(word() for _ in range(40))}. {word()} goes on.</p>" for _ in range(5))
    rows = [(i, f"https://site.example.org/{'x9' * 9 if i % 3 == 0 else word()}/{i}", f"<article>{'<p>Buy $$$ ### now!!!</p>' * 4 if i % 3 == 0 else good()}</article>") for i in range(900)]
    rows += [(1000, rows[1][1], "<p>later page of a url</p>"), (1001, None, "<p>x</p>"), (1002, "https://empty.example.org/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.url: r.label for r in urls.content_labels(pages).collect()}
    assert got == {u: float(i % 3 == 0) for i, u, _ in rows[:900]} | {"https://empty.example.org/": 1.0}
    few = urls.content_labels(pages, sample=100).collect()
    assert len(few) == 100 and all(got[r.url] == r.label for r in few)
    model = urls.train(urls.content_labels(pages), trees=5)
    assert model.held_out.informative and model.threshold
    blocked = {r.page_id for r in urls.judge(pages, rules=(), model=model).collect() if r.verdict == "block"}
    assert len(blocked ^ set(range(0, 900, 3))) < 20
    assert urls.content_labels(pages.limit(0)).count() == 0


def test_url_features(spark):
    made = ["https://www.a1.example.com/en/x.html?a=1&b=2#top", "http://b.net", "HTTPS://C.org/?q", "", None, "no url", "ftp://d/é/日?=#=", "http://e.f/" + "9" * 3000]
    df = urls.with_features(urls.split_url(spark.createDataFrame(list(enumerate(made)), "i long, url string"), "url"), "url")
    for r in df.collect():
        url = made[r.i] or ""
        rest = url.split("://", 1)[1] if "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path, tail = re.match(r"[^?#]*", rest[len(host) :])[0], re.sub(r"^[^?#]*", "", rest)
        entropy = -sum(n / len(url) * math.log2(n / len(url)) for n in Counter(url).values())
        digits = lambda t: sum(c in "0123456789" for c in t) / max(len(t), 1)
        want = (len(url), len(host), len(path), host.count("."), path.count("/"), digits(url), digits(host), entropy, tail.count("="), "#" in tail, url.lower().startswith("https:"), len(path.split("/")[-1]))
        own = (r.n_chars, r.host_chars, r.path_chars, r.domains, r.depth, r.digits, r.host_digits, r.entropy, r.parameters, r.has_fragment, r.secure, r.last_part_chars)
        assert np.allclose(own, want), url
        assert r.suffix == host.split(".")[-1]
    rated = urls._rated(df.limit(2), [("com", 0.75)], 0.25).collect()
    assert {r.suffix: r.suffix_rate for r in rated} == {"com": 0.75, "net": 0.25}


def test_media(docs, rows, empty):
    out = media.media_columns(docs, with_media=True).collect()
    assert len(out) == len(rows)
    texts = {r[0]: (r[1] or "").encode() for r in rows if r[0] is not None}
    for r in out:
        back = media.decode(bytes(r.media))
        assert len(back) % 192 == 0 and len(back) == r.payload_bytes and hashlib.sha256(back).hexdigest() == r.payload_sha256
        assert r.doc_id is None or back == media.payload(texts[r.doc_id])
        assert r.fingerprints == sorted(r.fingerprints)
    assert len({r.feature for r in out if r.doc_id in (0, 60, 61)}) == 1
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 / 8000 * np.arange(4000))).astype(np.uint8).tobytes()
    assert Counter(media.peaks(tone)[1].tolist()).most_common(1)[0][0] == 32  # 1000 Hz of 8000 in 256 bins
    assert media.media_columns(empty).count() == 0


def test_fingerprints_against_plain_loops(docs):
    for r in media.media_columns(docs.filter("doc_id in (3, 65, 70, 72)"), with_media=True).collect():
        back = media.decode(bytes(r.media))
        x = (np.frombuffer(back, np.uint8).astype(np.float32) - 128) / 128
        peaks, start = [], 0
        while True:
            frame = np.zeros(media.FRAME, np.float32)
            frame[: len(x[start : start + media.FRAME])] = x[start : start + media.FRAME]
            power = np.round(np.abs(np.fft.rfft(frame * np.hanning(media.FRAME).astype(np.float32))), 3).tolist()
            tops = sorted((-power[k], k) for k in range(1, len(power) - 1) if power[k] > power[k - 1] and power[k] > power[k + 1])[: media.PEAKS]
            peaks += [(start // media.HOP, k) for k in sorted(k for _, k in tops)]
            start += media.HOP
            if start + media.FRAME - media.HOP >= len(x):
                break
        pairs = [(t, f, g, u - t) for i, (t, f) in enumerate(peaks) for u, g in peaks[i + 1 : i + 1 + media.FAN] if 0 < u - t <= media.AHEAD]
        assert r.fingerprints == sorted(t << 32 | f << 16 | g << 8 | gap for t, f, g, gap in pairs)


@pytest.mark.parametrize("shingle", [4, 5])
def test_near_duplicates(docs, rows, empty, shingle):
    sets = []
    for r in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or ""))
        sets.append({tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} if len(w) >= shingle else {tuple(w)} if w else set())
    ids = [r[0] for r in rows]
    root = {i: i for i in ids if i is not None}
    for _ in rows:
        for i, a in zip(ids, sets, strict=True):
            for j, b in zip(ids, sets, strict=True):
                if i is not None and j is not None and a and b and 100 * len(a & b) >= 80 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
        break
    for _ in range(5):
        root = {i: root[root[i]] for i in root}
    expected = Counter((i, len(s), root.get(i), i is None or root[i] == i) for i, s in zip(ids, sets, strict=True))
    assert by_row(neardup.near_duplicates(docs, shingle=shingle), "doc_id", "n_shingles", "component_id", "kept") == expected
    assert neardup.near_duplicates(empty).count() == 0


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 540)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(find(n) == r for n, r in got.items())
    assert all(n in got or find(n) == n for n in root)


def test_licenses(docs, rows, empty):
    def places(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        hits = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        at = [i for i, _ in hits]
        return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))

    out = licenses.scan(docs)
    assert by_row(out, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == Counter((r[0], *places(r[1])) for r in rows)
    assert all(0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) for r in out.collect())
    assert licenses.scan(empty).count() == 0


def test_license_with_a_word_more(spark):
    text = "this work is hereby licensed under the gnu general public license version 3"
    row = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.labels == "gpl-3" and row.n_base == 0 and 0.75 <= row.score <= 1


def test_pipeline(spark, tmp_path, rows, empty):
    own = [r for r in rows if r[0] is not None]
    spark.createDataFrame(own, SCHEMA).select("doc_id", "text", "lang", "source", "n_chars").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.count()
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert name.startswith("mixing") or docs.count() <= before
    assert docs.filter("length(text) <> n_chars").count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == packing.pack(docs).count()
    bare = empty.select("doc_id", "text", "lang", "source", "n_chars")
    assert all(stage(spark, bare, "").count() == 0 for _, stage in corpus_pipeline.STAGES)
