"""Front words of lines in pieces of bytes (F1)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tallyspark.llm import line_dedup as ld


def test_front_words_travel_in_pieces(monkeypatch):
    """Rows come by bucket, in order, each once, and none of words that occur once; before, each row came alone."""
    monkeypatch.setattr(ld, "SENT", 500)
    text = "\n".join(" ".join(f"w{(7 * i + j * j) % 300}" for j in range(12)) + f" once{i}" for i in range(300))
    batch = pa.RecordBatch.from_pydict({"id": [1, 2], "is": [1, 2], "text": [text, "a b c d e\na b c d f"]})
    counted = [x for x in ld.occurrences(1)(iter([batch])) if x.column("counts").null_count == 0 and x.num_rows]
    counts = np.zeros((ld.COUNTERS // ld.COUNTER_BLOCK, ld.COUNTER_BLOCK), np.int64)
    for x in counted:
        for block, some in zip(x.column("block").to_pylist(), x.column("counts").to_pylist(), strict=True):
            counts[block] += np.frombuffer(some, np.int64)
    assert counts.sum() == 300 * 13 + 10
    ranks = np.minimum(255, np.floor(8 * np.log2(np.maximum(counts.ravel(), 1)))).astype(np.uint8)
    sent = list(ld.fronts(lambda: (ranks, 255), 1)(iter([batch.select(["text"])])))
    rows = np.concatenate([ld.numbers(x) for x in sent])
    assert len(np.unique(rows, axis=0)) == len(rows) and sum(x.num_rows for x in sent) <= len(rows)
    assert (ranks[(rows[:, 1] % np.uint64(ld.COUNTERS)).astype(np.int64)] > 0).all()
    for x in sent:
        bucket = np.repeat(x.column("spot").to_numpy(), [len(r) // 48 for r in x.column("rows").to_pylist()])
        assert (bucket == (ld.numbers(x)[:, 0] >> np.uint64(64 - ld.BUCKET_BITS)).astype(np.int32)).all()
