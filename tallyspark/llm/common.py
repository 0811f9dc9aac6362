"""What the operators share: reading tables, folds, and where lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: str | Column, parts: int) -> Column:
    """crc32 of the id's text modulo ``parts``; -1 for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(column.cast("string").cast("binary")) % parts, F.lit(-1))


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of this machine's own only where that is unset and the master is local, as in tests."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(given or tempfile.mkdtemp(prefix="checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


#: Bytes of an Arrow batch; a batch exceeds them by one row at most, however long texts are.
BATCH_BYTES = 4 << 20
BATCHES = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Let rows travel to Python workers in batches of ``size`` bytes, for this session; Spark's own bound is 64 MB for each task."""
    spark.conf.set(BATCHES, f"{size}b")


#: What stands for a null document id; it comes before all others.
NULL_ID = -(1 << 63)


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns in a struct, doc, which no name of theirs can clash with, and id (never null) and is (a hash of the text), which tell rows of different texts apart."""
    return docs.select(F.struct(*(F.col(f"`{k}`") for k in docs.columns)).alias("doc"), F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("is"))


def unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns of what ``packed`` gave, some ``changed``."""
    return rows.select(*(changed[k].alias(k) if k in changed else F.col("doc")[k].alias(k) for k in columns))


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it from there."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder that all executors share and read it from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bits of the filter that ``maybe_in`` broadcasts: 2 MB at most, whatever is in it.
FILTER_BITS = 1 << 24
#: Bits of ``bitmap``: 8 a wanted key, within these bounds (128 KB to 16 MB).
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 27


def bitmap(wanted: DataFrame, key: str) -> np.ndarray:
    """A bitmap of the keys (a column of longs, taken as unsigned) of ``wanted``, modulo its length, which is at most ``MOST_BITS``.

    The driver holds those bits alone. More keys than bits let more of other keys through, so what is let through must be joined.
    """
    n_bits = LEAST_BITS
    while n_bits < min(MOST_BITS, 8 * wanted.count()):
        n_bits *= 2
    spot = F.col(key).bitwiseAND(F.lit(n_bits - 1))
    packed = wanted.groupBy(F.bitmap_bucket_number(spot + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot + 1)).alias("bits"))
    out = np.zeros(n_bits // 8, np.uint8)
    for row in packed.toArrow().to_pylist():
        part = np.frombuffer(row["bits"], np.uint8)[: len(out)]
        out[(row["bucket"] - 1) * len(part) :][: len(part)] = part
    return out


def maybe_in(rows: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """``rows`` with a column ``maybe_``, false only where ``wanted`` has no row with these columns.

    It spares most rows a shuffle to a join with ``wanted``. The bitmap has a fixed size; the more is
    wanted, the more rows pass, and the join behind it decides.
    """
    spot = F.pmod(F.xxhash64(*key), F.lit(FILTER_BITS))
    bits = wanted.select(spot.alias("spot_")).groupBy(F.bitmap_bucket_number("spot_").alias("bucket_")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot_")).alias("bits_"))
    placed = rows.withColumn("spot_", spot).withColumns({"of_": F.bitmap_bucket_number("spot_"), "bit_": F.bitmap_bit_position("spot_").cast("int")})
    byte = F.expr("cast(conv(hex(substring(bits_, bit_ div 8 + 1, 1)), 16, 10) as int)")
    joined = placed.join(F.broadcast(bits), F.col("of_") == F.col("bucket_"), "left").withColumn("byte_", byte)
    return joined.withColumn("maybe_", F.coalesce(F.expr("shiftright(byte_, bit_ % 8) & 1 = 1"), F.lit(False))).drop("spot_", "of_", "bit_", "bucket_", "bits_", "byte_")
