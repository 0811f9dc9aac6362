"""Language identification by n-gram membership in bit-sliced Bloom filters.

Training counts character n-grams per language over all labelled documents. A language's set holds
the n-grams that make up at least ``MIN_SHARE`` of it, so no set can have more than 1 / MIN_SHARE
entries whatever the corpus holds, and that are not far more frequent in another language, so
mislabelled documents do not fill a set with another language's n-grams. The filters of all languages
are bit-sliced: slot i of one array has bit l set if filter l has bit i set, so the AND of a few slots
returns every language that contains an n-gram. Each language's popcount of hits is corrected for the false
positives that its filter's fill makes likely, and the largest corrected count decides.

Null text, or one without a letter: ``und`` with score 0. Documents with a null language are
predicted but not learnt from. With nothing to learn from all predictions are ``und``. A tie goes to
the alphabetically first language. Repeated rows are predicted alike; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import text as tx
from tallyspark.llm.common import fold, table

#: An n-gram's least share of its language's n-grams.
MIN_SHARE = 1e-5
#: An n-gram's least share relative to the language where its share is largest.
MIN_RATIO = 0.15
SLOTS = 1 << 20
PROBES = 4
#: Bits of a slot. More languages than that take further arrays.
SLOT_BITS = 64
UNKNOWN = "und"
#: Distinct n-grams that a task holds before it passes its counts on.
HELD = 1 << 20


def grams(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash for each letter, of it and its neighbours (one before, two after, within the word), and each text's range of them."""
    code = tx.letters(points)
    n = len(code)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, np.uint64)
    before[1:] = code[:-1]
    before[edge[:-1]] = 0
    after = np.zeros(n, np.uint64)
    after[:-1] = code[1:]
    after[edge[1:]] = 0
    second = np.zeros(n, np.uint64)
    second[:-1] = after[1:]
    second[after == 0] = 0
    at = np.flatnonzero(code)
    key = (before[at] * np.uint64(tx.BASE) + code[at]) * np.uint64(tx.BASE) + after[at]
    return tx.mix(key * np.uint64(tx.BASE) + second[at]), np.searchsorted(at, offsets)


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of the texts, summed up within the task as far as memory allows."""
    held: dict[str, list] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            keys, counts = merged(parts)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(keys), pa.string()), "gram": keys.view(np.int64), "n": counts})
        held.clear()

    for batch in tx.chunks(batches):
        keys, first = grams(*tx.code_points(*tx.text_bytes(batch.column("text"))))
        langs = np.array(batch.column("lang").to_pylist(), object)
        for lang in set(langs):
            mine = np.repeat(langs == lang, np.diff(first))
            held.setdefault(lang, []).append(np.unique(keys[mine], return_counts=True))
            if len(held[lang]) >= 8:
                held[lang] = [merged(held[lang])]
        size = sum(len(k) for parts in held.values() for k, _ in parts)
        if size > HELD:
            yield from flush()
    yield from flush()


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    counts = np.bincount(back, np.concatenate([n for _, n in parts]), len(keys))
    return keys, counts.astype(np.int64)


def language_sets(train: DataFrame, min_share: float = MIN_SHARE, min_ratio: float = MIN_RATIO) -> DataFrame:
    """(gram, langs): each kept n-gram with the languages whose sets hold it; at most 1 / min_share rows a language."""
    counts = train.select("text", "lang").mapInArrow(count_grams, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(totals, "lang").select("gram", "lang", (F.col("n") / F.col("total")).alias("share"))
    frequent = shares.filter(F.col("share") >= min_share)
    grouped = frequent.groupBy("gram").agg(F.max("share").alias("top"), F.collect_list(F.struct("lang", "share")).alias("each"))
    near = F.filter("each", lambda x: x["share"] >= F.col("top") * min_ratio)
    return grouped.select("gram", F.transform(near, lambda x: x["lang"]).alias("langs"))


def probes(keys: np.ndarray, slots: int = SLOTS) -> Iterator[np.ndarray]:
    step = (keys >> np.uint64(32)) | np.uint64(1)
    for k in range(PROBES):
        yield ((keys + np.uint64(k) * step) & np.uint64(slots - 1)).astype(np.int64)


def bits(masks: np.ndarray, lang: int) -> np.ndarray:
    """The language's bit of each mask."""
    kind = masks.dtype.type
    return (masks >> kind(lang % SLOT_BITS)) & kind(1)


class BloomSlices:
    """Bloom filters of all languages: bit l of a slot is language l's; beyond 64 languages in several arrays."""

    def __init__(self, langs: list[str], slots: int = SLOTS):
        self.langs, self.slots = langs, slots
        sizes = [min(SLOT_BITS, len(langs) - k) for k in range(0, max(1, len(langs)), SLOT_BITS)]
        self.masks = [np.zeros(slots, next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(t).bits >= n)) for n in sizes]

    def add(self, lang: int, keys: np.ndarray) -> None:
        mask = self.masks[lang // SLOT_BITS]
        for at in probes(keys, self.slots):
            mask[at] |= mask.dtype.type(1 << lang % SLOT_BITS)

    def false_rates(self) -> np.ndarray:
        return np.array([np.mean(bits(self.masks[k // SLOT_BITS], k)) ** PROBES for k in range(len(self.langs))])

    def containing(self, keys: np.ndarray) -> list[np.ndarray]:
        """Bitmasks of the languages whose filters hold each n-gram, of 64 languages each."""
        held = [mask[next(probes(keys, self.slots))] for mask in self.masks]
        for at in probes(keys, self.slots):
            for found, mask in zip(held, self.masks, strict=True):
                found &= mask[at]
        return held


def build(train: DataFrame, **how: float) -> BloomSlices:
    """Learn the filters; what reaches the driver is bounded by languages / MIN_SHARE rows."""
    found = language_sets(train, **how).select(F.explode("langs").alias("lang"), "gram").toArrow()
    coded = pa.chunked_array(found.column("lang"), pa.string()).combine_chunks().dictionary_encode()  # numbers, not a text a row
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    keys = found.column("gram").to_numpy().view(np.uint64)
    model = BloomSlices(sorted(names))
    for k, lang in enumerate(model.langs):
        model.add(k, keys[codes == names.index(lang)])
    return model


def judge(model: BloomSlices, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Language and score of each text."""
    false = model.false_rates()
    keys, first = grams(*tx.code_points(*tx.text_bytes(texts)))
    n = np.diff(first)
    held = model.containing(keys)
    share = np.zeros((len(model.langs), len(texts)))
    for k in range(len(model.langs)):
        hits = tx.sums(bits(held[k // SLOT_BITS], k).astype(np.int64), first)
        share[k] = (hits / np.maximum(n, 1) - false[k]) / max(1e-9, 1 - false[k])
    known = (n > 0) & bool(model.langs)
    best = np.argmax(share, axis=0) if model.langs else np.zeros(len(texts), int)
    score = np.where(known, np.clip(share[best, np.arange(len(texts))], 0, 1), 0.0) if model.langs else np.zeros(len(texts))
    return np.where(known, np.array([*model.langs, UNKNOWN], object)[best], UNKNOWN), score


def identify(docs: DataFrame, train: DataFrame) -> DataFrame:
    """doc_id, lang_pred and score of every document, learnt from text and lang of ``train``."""
    model = docs.sparkSession.sparkContext.broadcast(build(train.filter("lang is not null")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches):
            lang, score = judge(model.value, batch.column("text"))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array(lang.tolist(), pa.string()), "score": score})

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def recognised(docs: DataFrame, train: DataFrame, least_score: float = 0.3) -> DataFrame:
    """``docs``, with all columns, without those in no learnt language: ``und``, or a score below ``least_score``.

    The score is the share of a text's n-grams in the best language's set, freed of false positives. Texts of a learnt language have nearly all
    of theirs there, others those alone that languages have in common, so the default lies between the two.
    """
    model = docs.sparkSession.sparkContext.broadcast(build(train.filter("lang is not null")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tx.chunks(batches):
            lang, score = judge(model.value, batch.column("text"))
            yield batch.filter(pa.array((lang != UNKNOWN) & (score >= least_score)))

    return docs.mapInArrow(run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, docs.filter(fold("doc_id", 4) != 2))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
