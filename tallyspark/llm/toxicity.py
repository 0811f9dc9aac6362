"""Toxicity from a weighted lexicon matched with an Aho-Corasick automaton.

Text is folded first: lower case, look-alike letters to a-z, digits and signs that stand for letters to
those letters. Folding keeps one character for one, so matches can be checked against the unfolded
text: a match counts if no letter or digit stands before it nor, unless the entry is a stem, behind it.
Exception phrases are patterns of the same automaton; matches inside them do not count.

The lexicon is a short list of insults plus the words and stems that labelled documents show to be used in
toxic texts. Toxic uses are counted by different contexts (word before, word, word after) of first uses:
copies of one document give one context, so a document with many copies does not make its words look
toxic. The score is a logistic function of the summed weights and of the same per 100 words, fitted
on the same bounded sample.

Null or empty text: no match, the lowest score. Repeated rows are scored alike; columns other than
doc_id and text are ignored. Without labels the default weights and coefficients hold.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import text as tx
from tallyspark.llm.common import cut, fold, table
from tallyspark.llm.labelled import FIT_ROWS, fit_sample

SEED_WORDS = ("bastard", "clown", "creep", "crap", "cretin", "degenerate", "despicable", "disgusting", "dumbass", "fool", "garbage", "halfwit", "hateful", "idiot", "idiotic", "imbecile", "jackass", "jerk", "loser", "lunatic", "moron", "moronic", "nitwit", "pathetic", "pig", "psycho", "repulsive", "scum", "scumbag", "shit", "shut up", "slut", "stupid", "subhuman", "trash", "vermin", "vile", "weirdo", "whore", "worthless")
EXCEPTIONS = ("clown fish", "class clown", "trash can", "trash bin", "garbage can", "garbage collection", "garbage collector", "idiot proof", "pathetic fallacy", "guinea pig", "worthless stock", "jerk chicken", "fool proof", "creep up", "take out the trash", "sore loser")
SEED_WEIGHT = 3.0
#: Contexts in toxic documents that a word or stem needs, and its least log-odds and z-score, to enter the lexicon.
LEAST_CONTEXTS, LEAST_ODDS, LEAST_Z = 12, 2.5, 6.0
#: Lengths of stems that are tried.
STEMS = range(4, 9)
#: Entries whose counts a task holds before it passes them on.
HELD = 1 << 18
#: Intercept, per summed weight (logarithmic), per weight per 100 words (logarithmic); before any fit.
DEFAULT_COEFFICIENTS = (-3.0, 2.5, 0.5)
#: Folding, as "what it becomes": what is written for it. Fixed values.
LOOK_ALIKES = {
    "a": "4@аαɑ", "b": "8вβ", "c": "сϲ", "d": "ԁ", "e": "3еεё", "g": "9ɡ", "h": "һн",
    "i": "1!|іιıї", "j": "ј", "k": "кκ", "l": "ӏ", "m": "м", "n": "ηո", "o": "0оοøօ", "p": "рρ",
    "q": "ԛ", "s": "5$ѕ", "t": "7+тτ", "u": "υս", "v": "νѵ", "w": "ѡԝ", "x": "хχ", "y": "уγ", "z": "2",
}

_fold: list[np.ndarray] = []


def folded(points: np.ndarray) -> np.ndarray:
    """One code point for each: lower-cased, look-alikes resolved."""
    if not _fold:
        out = tx.kinds()[0].copy()
        written = {ord(x): ord(to) for to, many in LOOK_ALIKES.items() for x in many}
        for i in range(tx.TABLED):
            if int(out[i]) in written:
                out[i] = written[int(out[i])]
        _fold.append(out)
    return np.where(points < tx.TABLED, _fold[0][np.minimum(points, tx.TABLED - 1)], points).astype(np.uint32)


def plain(word: str) -> str:
    return folded(np.array([ord(c) for c in word], np.uint32)).tobytes().decode("utf-32-le")


class Matcher:
    """The lexicon as an automaton over folded text."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = EXCEPTIONS):
        self.automaton = ahocorasick.Automaton()
        entries: dict[str, list] = {}  # by text: weight as a word, weight as a stem, is it an exception
        for word, weight in weights.items():
            entries.setdefault(plain(word.rstrip("*")), [None, None, False])[word.endswith("*")] = float(weight)
        for phrase in exceptions:
            entries.setdefault(plain(phrase), [None, None, False])[2] = True
        for entry, kinds in entries.items():
            self.automaton.add_word(entry, (len(entry), *kinds))
        if len(self.automaton):
            self.automaton.make_automaton()

    def matches(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and weight of each match that stands alone in its text and outside the exceptions."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not len(self.automaton) or not len(points):
            return none
        found = [(end + 1 - n, end + 1, *kinds) for end, (n, *kinds) in self.automaton.iter(folded(points).tobytes().decode("utf-32-le", "surrogatepass"))]
        if not found:
            return none
        starts, ends = np.array([x[0] for x in found]), np.array([x[1] for x in found])
        word, stem = (np.array([np.nan if x[k] is None else x[k] for x in found]) for k in (2, 3))
        solid = np.ones(len(points) + 2, bool)  # is a letter or digit, one further right than in the text
        solid[1:-1] = tx.kinds()[2][np.minimum(points, tx.TABLED - 1)] | (points >= tx.TABLED)
        owner = np.searchsorted(offsets, starts, "right") - 1
        closed = (ends == offsets[owner + 1]) | ~solid[np.minimum(ends + 1, len(solid) - 1)]
        weights = np.where(closed & ~np.isnan(word), word, stem)
        exempt = np.array([x[4] for x in found]) & closed
        whole = (ends <= offsets[owner + 1]) & ((starts == offsets[owner]) | ~solid[starts]) & (exempt | ~np.isnan(weights))
        starts, ends, weights, exempt = starts[whole], ends[whole], weights[whole], exempt[whole]
        weights[exempt] = np.nan
        spared = np.isnan(weights)
        if spared.any():
            inside = np.zeros(len(points) + 1, np.int64)
            np.add.at(inside, starts[spared], 1)
            np.add.at(inside, ends[spared], -1)
            spared |= np.cumsum(inside)[starts] > 0
        return starts[~spared], ends[~spared], weights[~spared]


def word_count(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    solid = (points > 32).astype(np.int64)
    begin = solid.copy()
    begin[1:] &= solid[:-1] == 0
    inner = offsets[:-1][np.diff(offsets) > 0]
    begin[inner] = solid[inner]
    return tx.sums(begin, offsets)


def match_features(matcher: Callable[[], Matcher], keep: tuple[str, ...]) -> Callable:
    """n_matches, weight and n_words of each text, beside the columns of ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = matcher()
        for batch in tx.chunks(batches):
            points, offsets = tx.code_points(*tx.text_bytes(batch.column("text")))
            starts, _, weights = model.matches(points, offsets)
            owner = np.searchsorted(offsets, starts, "right") - 1
            yield pa.RecordBatch.from_pydict(
                {k: batch.column(k) for k in keep}
                | {
                    "n_matches": np.bincount(owner, minlength=batch.num_rows).astype(np.int64),
                    "weight": np.bincount(owner, weights, batch.num_rows).astype(np.float64),
                    "n_words": word_count(points, offsets),
                }
            )

    return run


def entries_of(word: str) -> list[str]:
    """The word and its stems (marked with a star) as the lexicon would have them."""
    return [word, *(f"{word[:k]}*" for k in STEMS if k <= len(word))]


def words_of(text: str) -> list[str]:
    """Runs of letters and digits, folded."""
    points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(tx.kinds()[2][np.minimum(points, tx.TABLED - 1)], folded(points), 32).astype(np.uint32).tobytes().decode("utf-32-le", "replace").split()


def toxic_uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, context of its first use in a text), distinct within each run of texts."""
    for batch in tx.chunks(batches):
        rows = set()
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            first: dict[str, int] = {}
            for i in range(len(words) - 1, -1, -1):
                first.update(dict.fromkeys(entries_of(words[i]), i))
            rows.update((e, zlib.crc32(" ".join(words[max(0, i - 1) : i + 2]).encode("utf-8", "replace"))) for e, i in first.items())
        entry, context = zip(*rows, strict=True) if rows else ((), ())
        yield pa.RecordBatch.from_pydict({"entry": pa.array(entry, pa.string()), "context": pa.array(context, pa.int64())})


def other_uses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(entry, texts that use it), summed up within the task as far as memory allows."""
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_pydict({"entry": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})
        counts.clear()
        return out

    for batch in tx.chunks(batches):
        for text in batch.column("text").to_pylist():
            counts.update({e for w in set(words_of(text)) for e in entries_of(w)})
            if len(counts) > HELD:
                yield flush()
    yield flush()


def closed(entries: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Weights by entry, of (toxic uses, weight): a stem gives way to a longer entry that covers nearly all its uses, any other longer entry to its stem."""
    kept: dict[str, float] = {}
    longest: dict[str, int] = {}
    for entry, (uses, _) in entries.items():
        for k in STEMS:
            if f"{entry.rstrip('*')[:k]}*" != entry and k <= len(entry.rstrip("*")):
                longest[f"{entry.rstrip('*')[:k]}*"] = max(longest.get(f"{entry.rstrip('*')[:k]}*", 0), uses)
    for entry, (uses, weight) in sorted(entries.items(), key=lambda x: (len(x[0]), x[0])):
        covered = any(f"{entry[:k]}*" in kept for k in STEMS if k < len(entry) and f"{entry[:k]}*" != entry)
        if not covered and longest.get(entry, 0) < 0.97 * uses:
            kept[entry] = weight
    return kept


def learnt_entries(sample: DataFrame) -> dict[str, float]:
    """Weights of all words and stems that toxic documents of the sample use in many contexts and others hardly.

    Spark counts and weighs every entry; only those that pass come back, so the sample's size bounds them. A word of the
    default list that is seen often enough to tell, but no more in toxic texts, gets weight 0.
    """
    toxic = sample.filter("label = 1").mapInArrow(toxic_uses, "entry string, context long").distinct()
    uses = toxic.groupBy("entry").agg(F.count("*").alias("a")).filter(F.col("a") >= LEAST_CONTEXTS)
    others = sample.filter("label <> 1").select("text").mapInArrow(other_uses, "entry string, n long")
    both = uses.withColumn("n", F.lit(0).cast("long")).unionByName(others.withColumn("a", F.lit(0).cast("long")))
    seeds = sorted({plain(w) for w in SEED_WORDS})
    counted = both.groupBy("entry").agg(F.sum("a").alias("a"), F.sum("n").alias("b")).filter((F.col("a") > 0) | F.col("entry").isin(seeds))
    size = sample.agg(F.count_if(F.col("label") == 1).alias("toxic"), F.count_if(F.col("label") != 1).alias("other")).first()
    p, q = (F.col("a") + 0.5) / (size.toxic + 1), (F.col("b") + 0.5) / (size.other + 1)
    common = (F.col("a") + F.col("b") + 1) / (size.toxic + size.other + 2)
    z = (p - q) / F.sqrt(common * (1 - common) * (1 / (size.toxic + 1) + 1 / (size.other + 1)))
    passes = (F.log(p / q) >= LEAST_ODDS) & (z >= LEAST_Z) & (F.col("a") >= LEAST_CONTEXTS)
    weighed = counted.select("entry", "a", (F.col("a") + F.col("b")).alias("seen"), F.least(F.log(p / q), F.lit(6.0)).alias("weight"), passes.alias("passes"))
    rows = weighed.filter(F.col("passes") | (F.col("entry").isin(seeds) & (F.col("seen") >= LEAST_CONTEXTS))).collect()
    return {r.entry: 0.0 for r in rows if not r.passes} | closed({r.entry: (r.a, r.weight) for r in rows if r.passes})


def signals(weight: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Intercept, summed weight, and weight per 100 words, the latter two on a logarithmic scale."""
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / np.maximum(n_words, 1))], axis=1)


def fit(x: np.ndarray, y: np.ndarray, prior: tuple[float, ...] = DEFAULT_COEFFICIENTS, strength: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method, held near the default coefficients."""
    b = np.array(prior)
    for _ in range(30 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + strength * np.eye(len(b)), x.T @ (p - y) + strength * (b - prior))
        b = b - step
        if np.abs(step).max() < 1e-8:
            break
    return b


def toxicity(docs: DataFrame, labels: DataFrame | None, label: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, n_matches, weight, n_words and score of each document."""
    context = docs.sparkSession.sparkContext
    weights = dict.fromkeys(SEED_WORDS, SEED_WEIGHT)
    b = np.array(DEFAULT_COEFFICIENTS)
    sample = None
    if labels is not None:
        # Read four times below; written once, so that documents are not joined and scanned for each.
        sample = cut(fit_sample(docs, labels, label, fit_rows))
        weights = {plain(w): x for w, x in weights.items()} | learnt_entries(sample)
        weights = {w: x for w, x in weights.items() if x > 0}
    matcher = context.broadcast(weights)
    build = lambda: Matcher(matcher.value)
    if sample is not None:
        rows = sample.mapInArrow(match_features(build, ("label",)), "label int, n_matches long, weight double, n_words long").toPandas()
        b = fit(signals(rows.weight.to_numpy(), rows.n_words.to_numpy()), (rows.label == 1).to_numpy(float))
    found = docs.select("doc_id", "text").mapInArrow(match_features(build, ("doc_id",)), "doc_id long, n_matches long, weight double, n_words long")
    per_100 = 100 * F.col("weight") / F.greatest(F.col("n_words"), F.lit(1))
    line = F.lit(float(b[0])) + float(b[1]) * F.log1p("weight") + float(b[2]) * F.log1p(per_100)
    return found.withColumn("score", 1 / (1 + F.exp(-line)))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"), "n_matches")
