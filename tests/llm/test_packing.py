"""Fixing many equal sets at once against one by one; texts cut into words at once against the library."""

import random

import numpy as np
import public_tokenizers

from popspark.llm import packing


def test_sets_fixed_at_once_are_those_fixed_one_by_one():
    rng = random.Random(9)
    at_once = 0
    for _ in range(400):
        capacity = rng.randint(6, 40)
        counts = {x: rng.choice([1, 2, 3, 5, 8, 20, 60]) for x in rng.sample(range(1, capacity + 1), rng.randint(1, min(12, capacity)))}
        together, single = packing._Instance(counts, capacity), packing._Instance(counts, capacity)
        packing.reduce_instance(together)
        packing.reduce_instance(single, at_once=False)
        assert (together.sequences, together.left.tolist()) == (single.sequences, single.left.tolist()), counts
        at_once += len(together.shares) < len(single.shares)
        # Every piece is given once, and sequences hold what they can.
        room = {}
        for s in together.shares:
            for k in range(s.many):
                room[s.sequence + k // s.each] = room.get(s.sequence + k // s.each, 0) + s.length
        assert all(x <= capacity for x in room.values())
        assert all(together.done[x] + together.left[x] == n for x, n in counts.items())
    assert at_once > 100


def test_words_of_many_texts_are_those_of_the_library(monkeypatch):
    rng = random.Random(5)
    own = packing.ByteIds(public_tokenizers.path(packing.TOKENIZER))
    expected = lambda t: np.array([*own.library.encode(t, add_special_tokens=False).ids, 7], "<u4").tobytes()
    sure = [*"aZq09'-.!<|%$ \t\n\r", *"' stmdrevl" * 2, "  ", "\n\n", " \n", "'re", "'ll", "'S", "the", "nicht", *"ªµº²³¹¼¾¡¬®¿×÷Àßéÿ", "Ā", "ƻ", "ǃ", "ɏ"]
    other = ["\0", "\x0b", "\x1c", "\x7f", "\x85", "\xa0", "\xad", "ɐ", "ʰ", "Ω", "中", "😀", "’", " ", "é", "<|endoftext|>"]
    texts = ["".join(rng.choices(sure, k=rng.randint(0, 30))) for _ in range(6000)]
    texts += ["".join(rng.choices(sure + other, k=rng.randint(0, 30))) for _ in range(2000)]
    texts += ["a" * 70_000, " " * 5000, "\n" * 5000 + "a", "'s" * 3000, "", "", "\0"]
    rng.shuffle(texts)
    for among in (texts, [""], ["", ""], ["'"], ["\0"], []):
        assert [bytes(x) for x in own.encode([t.encode() for t in among], 7)] == [expected(t) for t in among]
    # The library splits no text but those with other characters, and no single word.
    asked = []
    monkeypatch.setattr(packing.ByteIds, "whole", lambda self, text: asked.append(text) or b"")
    own = packing.ByteIds(public_tokenizers.path(packing.TOKENIZER))
    own.encode([b"some words, and words again", "中 word".encode(), b"it's more", b""], 0)
    assert asked == ["中 word"]
