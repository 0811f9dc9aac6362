"""Large mixed groups are compared in full, also where two classes have no second band in common."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tallyspark.llm import near_dup
from tallyspark.llm import text as tx


def test_one_band_in_common(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 2)
    monkeypatch.setattr(near_dup, "PARTED", 1)
    rng = np.random.default_rng(7)
    base = " ".join(f"w{k}" for k in range(40))
    texts = [base, f"{base} end", *(" ".join(f"t{i}x{k}" for k in range(40)) for i in range(9))]
    sketches = rng.integers(0, 1 << 16, (len(texts), near_dup.BUCKETS)).astype(np.uint16)
    sketches[:, : near_dup.ROWS] = sketches[0, : near_dup.ROWS]
    # Three of four registers agree in each further band, so the estimate is high and no band but the first is shared.
    other = sketches[1].copy()
    sketches[1] = sketches[0]
    sketches[1, near_dup.ROWS :: near_dup.ROWS] = other[near_dup.ROWS :: near_dup.ROWS]
    sizes = [len(x) for x in near_dup.shingle_sets(*tx.text_bytes(pa.array(texts)))]
    docs = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    rows = [(i, bytes([i]), n, x.tobytes()) for i, (n, x) in enumerate(zip(sizes, sketches, strict=True))]
    classes = spark.createDataFrame(rows, "doc_id long, class binary, n_shingles long, sketch binary").join(docs, "doc_id")
    classes = classes.select("class", "n_shingles", "sketch", F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("is")).alias("rep"))
    members = near_dup.mixed(near_dup.banded(classes.withColumn("root", F.col("class")), "root"))
    assert members.count() == len(texts)
    found = near_dup.cross_links(classes, members, docs).collect()
    assert [(bytes(r.a), bytes(r.b)) for r in found] == [(bytes([0]), bytes([1]))]
