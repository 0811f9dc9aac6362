"""The score is the marginal over all segmentations, with existing vocabulary scores; bad answers are noticed."""

import functools
import re

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm.lattice import read_vocabulary, start_probabilities
from tallyspark.llm.lm_score import answer, lm_scores

TEXTS = ["the cat sat on the mat", "The dog, the log!", None, "", "é ß日本 ǅungle", "the the the", "unseenword here", "the cat sat on the mat"]
SCHEMA = "doc_id long, text string, key long, score double"


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def test_enumerated(spark, path):
    docs = spark.createDataFrame([*((i, t, 1, 0.0) for i, t in enumerate(TEXTS)), (None, "the end", 1, 0.0)], SCHEMA).repartition(3)
    got = {r.doc_id: r for r in lm_scores(docs, "doc_id < 6", path, rounds=0).collect()}
    pieces, scores = read_vocabulary(path)
    p = dict(zip(pieces, start_probabilities(scores) * 0.999, strict=True))

    @functools.cache
    def ways(s):
        if not s:
            return 1.0
        total = sum(p[s[:k]] * ways(s[k:]) for k in range(1, len(s) + 1) if s[:k] in p)
        return total + (0 if s[0] in p else (0.001 / 256) ** len(s[0].encode()) * ways(s[1:]))

    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    n_train = sum(len(words(t)) + 1 for t in TEXTS[:6])
    end = 6.5 / (n_train + 1)
    for i, t in [*enumerate(TEXTS), (None, "the end")]:
        expected = sum(np.log10(ways("▁" + w)) for w in words(t)) + len(words(t)) * np.log10(1 - end) + np.log10(end)
        assert abs(got[i].score - expected) < 1e-6 and got[i].train_tokens == n_train


def test_learning_raises_what_was_learnt(spark, path):
    docs = spark.createDataFrame([(i, "qzx vkj qzx vkj", 1, 0.0) for i in range(20)], SCHEMA)
    before, after = (lm_scores(docs, "true", path, rounds=k).first().score for k in (0, 2))
    assert after > before + 1


def test_empty(spark, path):
    empty = spark.createDataFrame([], SCHEMA)
    assert lm_scores(empty, "true", path).count() == 0
    one = lm_scores(spark.createDataFrame([(1, "a b", 1, 0.0)], SCHEMA), "false", path).first()
    assert (one.n_tokens, one.n_known, one.train_tokens) == (3, 0, 0) and one.score < 0


def test_answers_for_other_words():
    docs = pa.table({"check": np.array([5], np.int64), "asked": pa.array([b"\0\0\0\0"], pa.binary()), "doc_id": [1], "n_tokens": [1], "n_known": [0], "base": [0.0], "model": [0.0]})
    words = pa.table({"key": np.array([6], np.int64), "n": [1], "log_p": [-1.0]})
    with pytest.raises(RuntimeError):
        answer((), docs, words)
