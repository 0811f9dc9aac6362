"""Scores of the fitted models against their definitions, worked out one text at a time on whole tables."""

import math

import numpy as np
import pyarrow as pa

from tallyspark.llm import quality_fm, toxicity
from tallyspark.llm import text as tx
from tallyspark.llm.common import table

SF = "/root/testdata/sf0.001"


def kept_results(monkeypatch, module, name):
    """What a function of a module gives from now on."""
    real, seen = getattr(module, name), []

    def spy(*args, **kwargs):
        seen.append(real(*args, **kwargs))
        return seen[-1]

    monkeypatch.setattr(module, name, spy)
    return seen


def test_every_pair_of_features(spark, monkeypatch):
    """The sum-of-squares identity gives what the sum over all pairs gives."""
    seen = kept_results(monkeypatch, quality_fm, "fit")
    docs = table(spark, SF, "documents")
    got = {r.doc_id: r.score for r in quality_fm.quality(docs, table(spark, SF, "labels")).collect()}
    [model] = seen
    assert len(got) == docs.count() and np.abs(model.v).max() > 0.05
    for r in docs.select("doc_id", "text").collect():
        number, value, _ = quality_fm.features(*tx.text_bytes(pa.array([r.text], pa.string())))
        of_pairs = (model.v[number] @ model.v[number].T) * np.outer(value, value)
        raw = model.w0 + model.w[number] @ value + np.triu(of_pairs, 1).sum()
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-raw))) < 1e-9


def matches(text, weights):
    """(start, weight) of what counts: entries looked for one by one at every place."""
    points = np.array([ord(c) for c in text], np.uint32)
    low = "".join(map(chr, toxicity.folded(points))) if text else ""
    solid = [c.isalnum() for c in text] + [False]
    words, stems = {}, {}
    for entry, weight in weights.items():
        (stems if entry.endswith("*") else words)[toxicity.plain(entry.rstrip("*"))] = weight
    exempt, found = [], []
    for at in range(len(low)):
        if at and solid[at - 1]:
            continue
        for phrase in map(toxicity.plain, toxicity.EXCEPTIONS):
            if low.startswith(phrase, at) and not solid[at + len(phrase)]:
                exempt.append((at, at + len(phrase)))
        for entry in words.keys() | stems.keys():
            if low.startswith(entry, at):
                whole = not solid[at + len(entry)]
                weight = words.get(entry) if whole and entry in words else stems.get(entry)
                if weight is not None:
                    found.append((at, weight))
    return [(at, w) for at, w in found if not any(a <= at < b for a, b in exempt)]


def test_lexicon_word_by_word(spark, monkeypatch):
    entries, fits = kept_results(monkeypatch, toxicity, "learnt_entries"), kept_results(monkeypatch, toxicity, "fit")
    planted = ["you 1d10t, shut up", "a clown fish and a class clown, clown", "trash trashy trash-can trash can", "МОRON mоrоn", "x" * 60 + " idiot", None, "", "ab ab"]
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(spark.createDataFrame([(10**6 + i, t) for i, t in enumerate(planted)], "doc_id long, text string"))
    got = {r.doc_id: r for r in toxicity.toxicity(docs, table(spark, SF, "labels")).collect()}
    weights = {toxicity.plain(w): toxicity.SEED_WEIGHT for w in toxicity.SEED_WORDS} | entries[0]
    weights = {w: x for w, x in weights.items() if x > 0}
    b = fits[0]
    assert len(got) == docs.count() and sum(r.n_matches > 0 for r in got.values()) > 5
    for r in docs.collect():
        mine = matches(r.text or "", weights)
        total = sum(w for _, w in mine)
        n_words = sum(1 for w in "".join(c if ord(c) > 32 else " " for c in r.text or "").split(" ") if w)
        one = got[r.doc_id]
        line = b[0] + b[1] * math.log1p(total) + b[2] * math.log1p(100 * total / max(n_words, 1))
        assert (one.n_matches, one.n_words) == (len(mine), n_words) and abs(one.weight - total) < 1e-9 and abs(one.score - 1 / (1 + math.exp(-line))) < 1e-9


def test_entries_have_any_length():
    long = "x" * 80
    assert toxicity.entries_of("ab") == ["ab"] and toxicity.entries_of(long)[0] == long and f"{long[:8]}*" in toxicity.entries_of(long)
