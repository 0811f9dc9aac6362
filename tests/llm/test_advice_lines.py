"""Lines of any number of words are compared, by the query and by the pipeline's stage."""

import re
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tallyspark.llm.line_dedup import op6_line_dedup


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(8)
    lines = ["All rights reserved.", "all RIGHTS reserved.", "home", "a b c d", "a b c d e", "a b c e", "a b", "w x y z", "w x y z v u", "to be or not to be to be or not to be", ""]
    texts = ["\n".join(rng.choice(lines, int(rng.integers(1, 6)))) for _ in range(60)]
    out = str(tmp_path_factory.mktemp("lines"))
    spark.createDataFrame([*enumerate(texts), (100, None), (101, "")], "doc_id long, text string").repartition(3).write.parquet(f"{out}/documents.parquet")
    return out


def expected(rows):
    place = defaultdict(list)
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            if s := frozenset(re.findall(r"[^\x20\x09-\x0D]+", line.lower())):
                place[s].append((i, k))
    gone = defaultdict(set)
    for s, at in place.items():
        first = min(min(place[o]) for o in place if 100 * len(s & o) >= 80 * len(s | o))
        for i, k in at:
            if (i, k) > first:
                gone[i].add(k)
    return gone


def test_lines_of_few_words(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = [tuple(r) for r in docs.collect()]
    gone = expected(rows)
    got = {r.doc_id: [int(k) for k in r.removed.split(",") if k] for r in op6_line_dedup(spark, folder).collect()}
    assert got == {i: sorted(gone[i]) for i, _ in rows}
    left = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, folder).collect()}
    for i, t in rows:
        text = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) if t else t
        assert left.get(i) == (None if gone[i] and not text.strip() else text)
