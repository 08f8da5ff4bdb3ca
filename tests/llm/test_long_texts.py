"""Texts of tens of megabytes beside short ones, through every operator."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from popspark.llm import interaction, licenses, media, merkle, mixing, neardup, packing, privacy, quality, substring, tokens, urls

SIZE = 12 << 20


@pytest.fixture(scope="module")
def text():
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
    lines, size = [], 0
    while size < SIZE:
        lines.append(" ".join(rng.choices(words, k=40)) + ".")
        size += len(lines[-1]) + 1
    lines[7] = "Released under the MIT License"
    return "\n".join(lines)


@pytest.fixture(scope="module")
def docs(spark, text):
    rows = [(1, text, "a"), (2, "short", "a"), (3, text[:-9] + "otherwise", "b"), (4, text[100:400], "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4).persist()


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_counts_of_long_texts(docs, text):
    n = len(text.split())
    judged = by_id(quality.judge(docs))
    assert judged[1].n_words == n and judged[1].n_dup_lines == 0 and judged[1].n_capitals == 5
    assert by_id(mixing.mixture(docs).drop("source"))[1]["size"] == n
    scanned = by_id(licenses.scan(docs))
    assert scanned[1].n_words == n and scanned[1].labels == "mit" and scanned[1].first_word == 7 * 40 + 1
    media_ = by_id(media.media_columns(docs.filter("doc_id in (1, 2)")))
    assert media_[1].payload_sha256 == hashlib.sha256(media.payload(text.encode())).hexdigest() and len(media_[1].fingerprints) > SIZE // media.HOP


def test_tokens_of_long_texts(docs, text):
    import sentencepiece
    from tokenizers import Tokenizer

    counted = by_id(tokens.count_tokens(docs))
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(tokens.MODEL))
    assert counted[1].n_tokens == len(library.encode(text)) and counted[1].over_limit
    pieces = sorted((r for r in packing.pack(docs.filter("doc_id < 3")).collect() if r.doc_id == 1), key=lambda r: r.piece)
    ids = np.array([*Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)).encode(text, add_special_tokens=False).ids, packing.END], "<u4")
    assert sum(r.length for r in pieces) == len(ids) and pieces[-1].start + pieces[-1].length == len(ids)
    assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in pieces)


def test_repeats_in_long_texts(docs, text):
    cut = by_id(substring.remove_repeats(docs))
    size = len(text)
    assert cut[1].n_removed == 0 and (cut[3].n_removed, cut[3].n_spans) == (size - 9, 1) and cut[4].n_removed == 300
    near = by_id(neardup.near_duplicates(docs))
    assert near[1].n_shingles == len({tuple(w) for w in zip(*(text.split()[k:] for k in range(5)), strict=False)})
    assert (near[3].component_id, near[3].kept, near[4].component_id) == (1, False, 4)


def test_long_urls(spark):
    url = "https://www.example.com/en/" + "x1?" * 2_000_000
    (row,) = urls.judge(spark.createDataFrame([(1, url)], "page_id long, url string")).collect()
    assert (row.host, row.path, row.verdict) == ("www.example.com", re.match("[^?]*", url[23:])[0], "allow")


def test_manifest_filters_and_personal_data_of_long_texts(docs, text):
    measured = by_id(interaction.measures(docs.withColumn("lang", F.lit("en"))))
    assert (measured[1].n_words, measured[1].n_distinct, measured[1].n_chars, measured[1].n_capitals) == (len(text.split()), len(set(text.split())), len(text), 5)
    checked = merkle.audit(merkle.manifest(docs.withColumn("lang", F.lit("en")).withColumn("n_chars", F.length("text")))).collect()
    leaf = hashlib.sha256(f"1:1{1}:a2:en{len(str(len(text)))}:{len(text)}{len(text)}:{text}".encode()).hexdigest()
    assert len(checked) == 4 and all(r.verified for r in checked) and leaf in {r.leaf for r in checked}
    found = by_id(privacy.scan(docs.withColumn("text", F.concat("text", F.lit(" ann@example.org")))))
    assert all(r.n_email == 1 for r in found.values()) and found[1].spans.startswith(f"email:{len(text) + 1}:{len(text) + 16}")
