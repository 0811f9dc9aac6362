"""Ids of words, many at a time (F2)."""

from __future__ import annotations

import numpy as np
import pytest

from tallyspark.llm.packing import Letters, Tokenizer


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Refused:
    def tokenize(self, word):
        raise AssertionError("asked word by word")


def test_words_of_letters_are_encoded_together(vocabulary):
    """No word of ASCII letters, with signs or without, costs a call of its own."""
    from tokenizers import Tokenizer as Public

    public, ours = Public.from_file(vocabulary), Tokenizer(vocabulary)
    ours.model = Refused()
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzETAOIN"), rng.integers(1, 14))) for _ in range(3000)] + ["a" * 256]
    texts = [" ".join(words[k::7]) + ", " + "; ".join(words[k::11]) for k in range(7)]
    for t, ids in zip(texts, ours.ids([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == public.encode(t, add_special_tokens=False).ids


def test_signs_are_parted_as_the_tokenizer_does(vocabulary):
    from tokenizers import Tokenizer as Public

    public = Public.from_file(vocabulary)
    ours, few = Tokenizer(vocabulary), Tokenizer(vocabulary)
    few.remembered = 1
    rng = np.random.default_rng(6)
    pieces = ["a", "THE", "st", "é", "E\u0301", "É", "ÿ", "×", "÷", "İ", "ı", "ŉ", "ſ", "Σ", "ß", "日", "'s", "'", "’", ".", ",", "%%", "<", "|", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "5", "١", "\u0338", "=", "-", "ﬁ", "\u0130", "\x00", "\x0b", "\u00a0", "\u2003", "a" * 257]
    texts = [" ".join("".join(rng.choice(pieces, rng.integers(1, 5))) for _ in range(rng.integers(0, 60))) for _ in range(300)]
    for k in range(0, 300, 3):
        for made in (ours, few):
            for t, ids in zip(texts[k : k + 3], made.ids([t.encode() for t in texts[k : k + 3]]), strict=True):
                assert np.frombuffer(ids, "<u4").tolist() == public.encode(t, add_special_tokens=False).ids, t


def test_ranks_give_what_the_merges_give(vocabulary):
    """Of every token that letters make, merges alone give that token again: so no pair but the listed one ever makes it, and ranks may stand for merges."""
    from tokenizers import Tokenizer as Public

    public = Public.from_file(vocabulary)
    tokens = [t.removesuffix("</w>") for t in public.get_vocab(with_added_tokens=False) if t.endswith("</w>")]
    tokens = [t for t in tokens if t.isascii() and t.isalpha() and t.islower()]
    ids, many = Letters(public.get_vocab(with_added_tokens=False)).encode("".join(t[:-1] + t[-1].upper() for t in tokens))
    assert len(tokens) > 20_000 and (many == 1).all()
    assert [public.model.token_to_id(t + "</w>") for t in tokens] == ids.tolist()
    assert all(len(public.model.tokenize(t)) == 1 for t in tokens)
