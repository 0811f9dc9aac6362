"""Extra columns may have any name that an operator uses itself; windows may be looked up by a shuffle; large groups of lines are compared in blocks."""

import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import decontamination, line_dedup
from tallyspark.llm.decontamination import decontaminate, scan
from tallyspark.llm.line_dedup import op6_line_dedup, remove_lines, removed_lines
from tallyspark.llm.near_dup import deduplicate

NAMES = ["key", "size", "at", "w", "h", "e", "row", "n_words", "items", "spans", "window", "item_ids", "of_key", "base", "doc", "id", "is", "maybe_", "gone", "numbers", "left", "spot_", "bits_", "a.b", "id_"]
TEXTS = ["one two three four five six seven", "one two three four five six seven", "Some item of the benchmark, in full.", None, "", "x " * 400 + "some item of the benchmark in full " + "y " * 400]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").select("*", *(F.lit(k).alias(n) for k, n in enumerate(NAMES)))


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "some item of the benchmark in full"), (2, "y y y y y y y y y y y"), (3, None)], "item_id long, text string")


def test_names(docs, bench):
    for got, kept in ((decontaminate(docs, bench), {0, 1, 3, 4}), (decontaminate(docs, bench, "spans"), set(range(6))), (remove_lines(docs), {0, 2, 3, 4, 5}), (deduplicate(docs), {0, 2, 3, 4, 5})):
        assert got.columns == docs.columns
        rows = got.collect()
        assert {r.doc_id for r in rows} == kept
        assert all(list(r)[2:] == list(range(len(NAMES))) for r in rows)


def test_shuffled_windows(docs, bench, monkeypatch):
    near = sorted(map(str, scan(docs, bench).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 0)
    assert sorted(map(str, scan(docs, bench).collect())) == near


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "PIECE", 3)
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(list("abc"), int(n))) for n in rng.integers(0, 60, 40)]
    items = [(k, " ".join(rng.choice(list("abc"), int(n)))) for k, n in enumerate((2, 4, 10, 12, 14))]
    found = scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    for r in found:
        w, hit, which = texts[r.doc_id].split(), set(), set()
        for i, t in items:
            v = t.split()
            size = min(10, len(v))
            for k in range(len(v) - size + 1):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == v[k : k + size]:
                        hit |= set(range(p, p + size))
                        which.add(str(i))
        assert {p for s in r.spans for p in range(s["first"] - 1, s["last"])} == hit and r["items"] == sorted(which) and r.n_words == len(w)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Lines with one word in common that is rare, in many sets of near sizes, and near copies of them."""
    rng = np.random.default_rng(11)
    words = [f"w{k}" for k in range(60)]
    lines = [" ".join(["rare", *rng.choice(words, int(rng.integers(4, 14)), replace=False)]) for _ in range(90)]
    lines += [" ".join([*x.split()[:-1], "last"]) for x in lines[:60]]
    lines += [" ".join(f"v{k + s}" for k in range(40)) for s in range(12)]
    texts = ["\n".join(rng.choice(lines, int(rng.integers(1, 9)))) for _ in range(80)]
    out = str(tmp_path_factory.mktemp("blocks"))
    spark.createDataFrame([*enumerate(texts), (None, texts[0]), (3, texts[3])], "doc_id long, text string").repartition(5).write.parquet(f"{out}/documents.parquet")
    return out


@pytest.mark.parametrize("changed", [{}, {"BLOCK": 4}, {"FREQUENT": 8, "SHARE": 0}])
def test_lines_by_blocks(spark, folder, monkeypatch, changed):
    for name, value in changed.items():
        monkeypatch.setattr(line_dedup, name, value)
    rows = [(-(1 << 63) if r.doc_id is None else r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    place, links = defaultdict(list), defaultdict(int)
    for i, t in set(rows):
        for k, line in enumerate(t.split("\n")):
            place[frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))].append((i, k))
    gone = defaultdict(set)
    for s, at in place.items():
        near = [o for o in place if 100 * len(s & o) >= 80 * len(s | o)]
        links[s] = len(near) - 1
        for i, k in at:
            if (i, k) > min(min(place[o]) for o in near):
                gone[i].add(k)
    assert sum(links.values()) > 20
    got = {r.id: r for r in removed_lines(spark.read.parquet(f"{folder}/documents.parquet"), 1).collect()}
    assert {i: r.numbers for i, r in got.items() if r.numbers} == {i: sorted(v) for i, v in gone.items()}
    assert op6_line_dedup(spark, folder).count() == len(rows)
    of_doc = {i: sum(links[frozenset(re.findall(r"[^\x20\x09-\x0D]+", line))] for line in t.split("\n")) for i, t in rows if i not in (3,)}
    assert {i: n for i, n in of_doc.items() if n} == {i: r.n_links for i, r in got.items() if r.n_links and i not in (3,)}
