"""Language-model scores from a subword lattice.

Words are generated piece by piece from a given vocabulary, which is not trained here. A piece's probability starts
from its vocabulary score and is re-estimated from the training documents' words by expected
counts over all segmentations (forward and backward recursion in log space), until a round gains less than ``GAIN``; ``rounds`` sets their
number instead, and 0 leaves the existing scores as they are. A
text's score is its marginal probability: the sum, over its words, of the log of the probability over all ways through the word's lattice, given
that a word comes rather than the end, and of the end at last. The base score is a smoothed count of whole words and
has no part in the score.

Word counts cover all documents: each task counts the distinct words that it reads, Spark sums the counts by
word, and expected counts are summed over that table, so what reaches the driver is one number a
vocabulary piece. To score, a task reduces the documents it reads to blocks of word numbers and asks, once a
block, for its distinct words; answers are joined by word and meet their block again, where a checksum of the words tells whether
they are the block's own. A word is known by its 64-bit hash. The words that make up
``FREQUENT`` or more of all tokens, at most 1 / FREQUENT of them, are broadcast and never asked for, so no word is hot.

Null or empty text: the end alone. Documents with a null id are scored, not learnt from. Repeated rows are
scored alike and all are learnt from. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import text as tx
from tallyspark.llm.common import cut, fold, table
from tallyspark.llm.lattice import Lattice, read_vocabulary, start_probabilities

#: Rounds go on until one gains less than this share of the log likelihood of the words.
GAIN = 0.001
FREQUENT = 1e-4
#: Added to each piece's expected count.
SMOOTHING = 0.01
#: Bytes of text in a block, and distinct words that a task holds before it passes counts on.
BLOCK_BYTES = 16 << 20
HELD = 500_000

_lattices: dict[str, tuple[Lattice, np.ndarray]] = {}


def lattice(path: str) -> tuple[Lattice, np.ndarray]:
    if path not in _lattices:
        pieces, scores = read_vocabulary(path)
        _lattices[path] = Lattice(pieces), scores
    return _lattices[path]


def lowered(words: tx.Words) -> pa.Array:
    """The words themselves, A-Z lower-cased."""
    ends = np.zeros(len(words.starts) + 1, np.int64)
    np.cumsum(words.ends - words.starts, out=ends[1:])
    data = tx.LOWER[words.raw[words.inside]]
    return pa.Array.from_buffers(pa.large_binary(), len(words.starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


class Vocabulary:
    """Distinct words seen so far, with counts."""

    def __init__(self) -> None:
        self.keys, self.counts, self.words = np.zeros(0, np.uint64), np.zeros(0, np.int64), pa.array([], pa.large_binary())

    def add(self, keys: np.ndarray, counts: np.ndarray, words: pa.Array) -> None:
        both = np.concatenate([self.keys, keys])
        self.keys, first, back = np.unique(both, return_index=True, return_inverse=True)
        self.counts = np.bincount(back, np.concatenate([self.counts, counts]), len(self.keys)).astype(np.int64)
        self.words = pa.concat_arrays([self.words, words]).take(pa.array(first))


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, word, n): distinct words of all texts with how often training texts have them."""
    held = Vocabulary()

    def take() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"key": held.keys.view(np.int64), "word": held.words.cast(pa.binary()), "n": held.counts})

    for batch in tx.chunks(batches):
        words = tx.Words(*tx.text_bytes(batch.column("text")))
        learn = batch.column("learn").to_numpy(zero_copy_only=False)
        keys, first, back = np.unique(words.hashes(), return_index=True, return_inverse=True)
        weight = np.repeat(learn, np.diff(words.first)).astype(np.float64)
        held.add(keys, np.bincount(back, weight, len(keys)).astype(np.int64), lowered(words).take(pa.array(first)))
        if len(held.keys) > HELD:
            yield take()
            held = Vocabulary()
    yield take()


#: Stands for a piece where the log likelihood of all words is told.
WORDS = -1


def expectations(path: str, shared: Callable[[], np.ndarray]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = lattice(path)
        total, likelihood = np.zeros(model.n + 1), 0.0
        for batch in batches:
            words = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            more, of_words = model.expectation(words, batch.column("n").to_numpy().astype(np.float64), shared())
            total, likelihood = total + more, likelihood + of_words
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"piece": np.append(used, WORDS).astype(np.int64), "n": np.append(total[used], likelihood)})

    return run


def likelihoods(path: str, shared: Callable[[], np.ndarray]) -> Callable:
    """log10 of the probability of each word, over all its segmentations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, _ = lattice(path)
        for batch in batches:
            words = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            log_p = model.forward(words, shared())
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "n": batch.column("n"), "log_p": log_p / np.log(10)})

    return run


def block_of(part: int, number: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{part}/{number}".encode(), digest_size=8).digest(), "little", signed=True)


def blocks(frequent: Callable[[], tuple[np.ndarray, np.ndarray, np.ndarray]], asking: bool) -> Callable:
    """Either the distinct words that each block asks for, or the block itself.

    Both runs read the same partitions in the same order, so their blocks are the same.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        known, counts, log_ps = frequent()
        values = ((counts > 0).astype(np.float64), counts_log(counts), log_ps)
        held: list = []
        size = 0

        def take() -> pa.RecordBatch:
            block = block_of(part, number)
            keys = np.unique(np.concatenate([h[0] for h in held]))
            if asking:
                return pa.RecordBatch.from_pydict({"block": np.full(len(keys), block), "key": keys.view(np.int64)})
            columns = [pa.concat_arrays([pa.array(h[i]) for h in held]) for i in range(1, 6)]
            asked = pa.concat_arrays([as_lists(np.searchsorted(keys, h[0]).astype(np.uint32).tobytes(), h[6], 4) for h in held])
            names = ["doc_id", "n_tokens", "n_known", "base", "model"]
            check = np.full(len(asked), np.bitwise_xor.reduce(keys)).view(np.int64)
            return pa.RecordBatch.from_pydict({"block": np.full(len(asked), block), "check": check} | dict(zip(names, columns, strict=True)) | {"asked": asked})

        for batch in tx.chunks(batches):
            words = tx.Words(*tx.text_bytes(batch.column("text")))
            keys = words.hashes()
            if asking:
                keys = np.unique(keys)
            place = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            common = known[place] == keys if len(known) else np.zeros(len(keys), bool)
            if asking:
                held.append((keys[~common],))
            else:
                owner, n, place = words.owner(), batch.num_rows, place[common]
                summed = [np.bincount(owner[common], v[place], n) if len(known) else np.zeros(n) for v in values]
                rare = ~common
                first = np.append(0, np.cumsum(np.bincount(owner[rare], minlength=n)))
                held.append((keys[rare], batch.column("doc_id"), np.diff(words.first).astype(np.int64), summed[0].astype(np.int64), summed[1], summed[2], first))
            size += len(words.raw)
            if size >= BLOCK_BYTES:
                yield take()
                held, size, number = [], 0, number + 1
        if held:
            yield take()

    return run


def counts_log(counts: np.ndarray) -> np.ndarray:
    return np.log10(counts + 0.5)


def as_lists(data: bytes, firsts: np.ndarray, width: int) -> pa.Array:
    """Binary values from one run of numbers and the numbers' offsets by row."""
    offsets = (firsts * width).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def answer(_: tuple, docs: pa.Table, words: pa.Table) -> pa.Table:
    """Add what a block's words bring to its documents' sums."""
    keys = words.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    if not (docs.column("check").to_numpy().view(np.uint64) == np.bitwise_xor.reduce(keys)).all():
        raise RuntimeError("a block got answers for other words than its own")
    counts, log_ps = words.column("n").to_numpy()[order], words.column("log_p").to_numpy()[order]
    asked = docs.column("asked").to_pylist()
    at = np.frombuffer(b"".join(asked), np.uint32)
    first = np.append(0, np.cumsum([len(x) // 4 for x in asked]))
    add = lambda name, values: docs.column(name).to_numpy() + tx.sums(values, first)
    return pa.table(
        {
            "doc_id": docs.column("doc_id"),
            "n_tokens": docs.column("n_tokens"),
            "n_known": (docs.column("n_known").to_numpy() + tx.sums((counts[at] > 0).astype(np.int64), first)).astype(np.int64),
            "base": add("base", counts_log(counts)[at]),
            "model": add("model", log_ps[at]),
        }
    )


def train(words: DataFrame, path: str, rounds: int | None = None) -> np.ndarray:
    """Natural logs of the pieces' probabilities; the last is a byte's. A word counts as often as training documents have it.

    The likelihood can't fall from round to round (smoothing aside), and is below 0, so rounds come to an end.
    """
    context = words.sparkSession.sparkContext
    model, scores = lattice(path)
    p = np.append(start_probabilities(scores) * 0.999, 0.001 / 256)
    learnt = words.filter("n > 0").select("word", "n")
    before = None
    for _ in count() if rounds is None else range(rounds):
        shared = context.broadcast(np.log(p))
        rows = learnt.mapInArrow(expectations(path, lambda s=shared: s.value), "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        piece, n = (rows.column(k).to_numpy() for k in ("piece", "n"))
        now = n[piece == WORDS].sum()
        if not now or rounds is None and before is not None and now - before < GAIN * -before:
            break
        before = now
        weight = np.full(model.n + 1, SMOOTHING)
        weight[piece[piece != WORDS]] += n[piece != WORDS]
        p = weight / weight.sum()
        p[-1] /= 256  # what bytes have together is shared out evenly
    return np.log(p)


def lm_scores(docs: DataFrame, learn: str, vocabulary: str, rounds: int | None = None) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each document; ``learn`` is the SQL condition of training rows."""
    spark = docs.sparkSession
    marked = docs.select("doc_id", "text", F.coalesce(F.expr(learn), F.lit(False)).alias("learn"))
    counted = marked.select("text", "learn").mapInArrow(count_words, "key long, word binary, n long")
    words = cut(counted.groupBy("key").agg(F.first("word").alias("word"), F.sum("n").alias("n")))
    n_ends = marked.filter("learn").count()
    totals = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n_train, n_distinct = totals.n + n_ends, totals.v + (n_ends > 0)
    shared = spark.sparkContext.broadcast(train(words, vocabulary, rounds))
    valued = cut(words.mapInArrow(likelihoods(vocabulary, lambda: shared.value), "key long, n long, log_p double"))
    top = valued.filter(F.col("n") >= max(1.0, FREQUENT * n_train)).toArrow().sort_by("key") if n_train else valued.limit(0).toArrow()
    keys = top.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    frequent = spark.sparkContext.broadcast((keys[order], top.column("n").to_numpy()[order], top.column("log_p").to_numpy()[order]))
    source = docs.select("doc_id", "text")
    asked = source.mapInArrow(blocks(lambda: frequent.value, True), "block long, key long")
    held = source.mapInArrow(blocks(lambda: frequent.value, False), "block long, check long, doc_id long, n_tokens long, n_known long, base double, model double, asked binary")
    answers = asked.join(valued, "key").select("block", "key", "n", "log_p")
    summed = held.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answer, "doc_id long, n_tokens long, n_known long, base double, model double")
    below = float(np.log10(n_train + 0.5 * (n_distinct + 1)))
    end_base, end_known = float(np.log10(n_ends + 0.5)), int(n_ends > 0)
    # How likely the end is, and with it, that a word comes instead; both may come if nothing was learnt.
    end = (n_ends + 0.5) / (n_train + 1)
    n_tokens = F.col("n_tokens") + 1
    return summed.select(
        "doc_id",
        n_tokens.alias("n_tokens"),
        (F.col("n_known") + end_known).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + end_base - n_tokens * below).alias("base_score"),
        (F.col("model") + F.col("n_tokens") * float(np.log10(1 - end)) + float(np.log10(end))).alias("score"),
    )


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    scored = lm_scores(docs, "crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1", public_tokenizers.path("piece_bpe_32k.model"))
    return scored.withColumn("held_out", fold("doc_id", 5) == 1).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
