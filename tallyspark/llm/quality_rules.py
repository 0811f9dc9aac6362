"""Quality rules with thresholds learnt from mergeable quantile sketches.

Each document gets a few shape metrics. For every (lang, source) group a KLL sketch of each metric
is built with partial aggregation, so a source with a third of all rows costs one sketch a task.
Sketches of a language's sources are merged into one for the language, and those into one for all;
a group's quantiles are drawn towards those of its language, and these towards those of all, by weights n / (n + ``PRIOR_DOCS``), so
few documents say little and no number of them is a switch. A threshold is an
outlier fence around the middle half of the group, so it moves with what is usual there and
junk that makes up less than a quarter of a group can't move it.

Null or empty text: no words, so ``base_failed``. Null lang or source: a group of its own. Repeated
rows are judged one by one and alike. Columns other than doc_id, text, lang, source are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import text as tx
from tallyspark.llm.common import cut, table

#: Documents at which a group's own quantiles count half, and those of its language, or of all, the other half.
PRIOR_DOCS = 200
#: Middle halves that a value may lie outside the middle half.
FENCE = 3.0
#: Per metric: the least width that the middle half is taken to have, and the sides on which it is fenced.
METRICS = {
    "mean_word": (0.7, "both"),
    "symbol_share": (0.03, "upper"),
    "dup_line_share": (0.07, "upper"),
    "repeat_share": (0.05, "upper"),
    "upper_share": (0.05, "upper"),
}
SKETCH_K = 400
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[list(b"#*$%&|<>")] = 1
UPPER = np.zeros(256, np.int64)
UPPER[ord("A") : ord("Z") + 1] = 1
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SHAPE = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long"


def surplus(keys: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """By owner: how many of its keys equal an earlier one."""
    order = np.lexsort((keys, owner))
    k, o = keys[order], owner[order]
    again = np.zeros(len(k), bool)
    again[1:] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    return np.bincount(o[again], minlength=n)


def repeated_words(hashes: np.ndarray, owner: np.ndarray, n: int, size: int = 3) -> np.ndarray:
    """By text: the words inside runs of ``size`` words that the text has twice or more."""
    runs = tx.windows(hashes, size)
    if not len(runs):
        return np.zeros(n, np.int64)
    whole = owner[size - 1 :] == owner[: len(runs)]
    at = np.flatnonzero(whole)
    key = tx.mix(runs[at] ^ tx.mix(owner[at].astype(np.uint64)))
    order = np.argsort(key)
    k = key[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    twice = at[order[same[:-1] | same[1:]]]
    covered = np.zeros(len(hashes), bool)
    for i in range(size):
        covered[twice + i] = True
    return np.bincount(owner[covered], minlength=n)


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tx.chunks(batches):
        raw, offsets = tx.text_bytes(batch.column("text"))
        n = batch.num_rows
        words = tx.Words(raw, offsets)
        owner = words.owner()
        hashes = words.hashes(lower=False)
        heads = (raw & 0xC0) != 0x80
        # Lines are "words" parted by newlines; those without a word inside don't count.
        newline = np.zeros(256, bool)
        newline[10] = True
        lines = tx.Words(raw, offsets, newline)
        filled = np.searchsorted(words.starts, lines.starts) < np.searchsorted(words.starts, lines.ends)
        line_owner, line_hash = lines.owner()[filled], lines.hashes(lower=False)[filled]
        counts = {
            "n_words": np.diff(words.first),
            "word_chars": tx.sums(heads & words.inside, offsets),
            "n_symbols": tx.sums(SYMBOLS[raw], offsets),
            "n_dup_lines": surplus(line_hash, line_owner, n),
            "n_repeat_words": repeated_words(hashes, owner, n),
            "n_lines": np.bincount(line_owner, minlength=n),
            "n_upper": tx.sums(UPPER[raw], offsets),
        }
        yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in ("doc_id", "lang", "source")} | {k: pa.array(v, pa.int64()) for k, v in counts.items()})


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def metrics(docs: DataFrame) -> DataFrame:
    """Counts of each document and the shares that thresholds are learnt for."""
    counted = docs.select("doc_id", "text", "lang", "source").mapInArrow(measure, SHAPE)
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return counted.select(
        "*",
        (F.col("word_chars") / n).alias("mean_word"),
        (F.col("n_symbols") / n).alias("symbol_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_share"),
        (F.col("n_repeat_words") / n).alias("repeat_share"),
        (F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))).alias("upper_share"),
        base_failed().alias("base_failed"),
    )


def thresholds(measured: DataFrame, prior_docs: float = PRIOR_DOCS) -> DataFrame:
    """(lang, source) -> low_ and high_ fence of each metric, from sketches of documents that pass the base rules."""
    sketched = (
        measured.filter(~F.col("base_failed"))
        .groupBy("lang", "source")
        .agg(F.count("*").alias("n"), *(F.kll_sketch_agg_double(m, SKETCH_K).alias(m) for m in METRICS))
    )
    sketched = cut(sketched)
    merged = [F.sum("n").alias("n"), *(F.kll_merge_agg_double(m, SKETCH_K).alias(m) for m in METRICS)]
    by_lang = sketched.groupBy("lang").agg(*merged)
    overall = sketched.agg(*merged).filter("n > 0")

    def fences(level: str) -> list[Column]:
        q = lambda m, p: F.kll_sketch_get_quantile_double(F.col(m), F.lit(p))
        return [F.struct(q(m, 0.25).alias("q1"), q(m, 0.75).alias("q3")).alias(f"{level}_{m}") for m in METRICS]

    groups = measured.select("lang", "source").distinct()
    own = sketched.select(F.col("lang").alias("own_lang"), F.col("source").alias("own_source"), F.col("n").alias("own_n"), *fences("own"))
    mid = by_lang.select(F.col("lang").alias("mid_lang"), F.col("n").alias("mid_n"), *fences("mid"))
    joined = (
        groups.join(own, F.col("lang").eqNullSafe(F.col("own_lang")) & F.col("source").eqNullSafe(F.col("own_source")), "left")
        .join(mid, F.col("lang").eqNullSafe(F.col("mid_lang")), "left")
        .join(overall.select(F.lit(1).alias("one"), *fences("all")), F.lit(1) == F.col("one"), "left")
    )
    out = [F.col("lang").alias("t_lang"), F.col("source").alias("t_source")]
    for m, (least, _) in METRICS.items():
        q1, q3 = (drawn(*((F.col(f"{level}_{m}")[q], F.col(f"{level}_n")) for level in ("own", "mid")), (F.col(f"all_{m}")[q], None), prior=prior_docs) for q in ("q1", "q3"))
        width = F.greatest(q3 - q1, F.lit(least)) * FENCE
        out += [(q1 - width).alias(f"low_{m}"), (q3 + width).alias(f"high_{m}")]
    return joined.select(*out)


def drawn(value: tuple[Column, Column | None], *wider: tuple[Column, Column | None], prior: float) -> Column:
    """A level's value drawn towards that of the wider ones; a level without documents says nothing."""
    own, n = value
    if not wider:
        return own
    rest = drawn(*wider, prior=prior)
    return F.coalesce((own * n + rest * prior) / (n + prior), rest)


def quality_rules(docs: DataFrame, prior_docs: float = PRIOR_DOCS) -> DataFrame:
    """One row a document: its counts, metrics, fences, ``base_failed`` and ``kept``."""
    measured = cut(metrics(docs))
    fenced = measured.join(
        thresholds(measured, prior_docs),
        F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")),
        "left",
    ).drop("t_lang", "t_source")
    fits = F.lit(True)
    for m, (_, sides) in METRICS.items():
        fits = fits & F.coalesce(F.col(m) <= F.col(f"high_{m}"), F.lit(True))
        if sides == "both":
            fits = fits & F.coalesce(F.col(m) >= F.col(f"low_{m}"), F.lit(True))
    return fenced.withColumn("kept", ~F.col("base_failed") & fits)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).select("doc_id", *COUNTS, "base_failed", "kept")
