"""The registered queries on test tables: against their SQL, against plain Python, and by held-out accuracy."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from tallyspark.llm import registry
from tallyspark.llm.common import table

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def collected(spark, name, sf):
    return {r.doc_id: r for r in registry.QUERIES[name](spark, sf).collect()}


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings", "conversations"):
        con.sql(f"create view {t} as select * from '{LARGER}/{t}.parquet'")
    df = registry.QUERIES[name](spark, LARGER)
    theirs = con.sql(registry.ORACLE_SQL[name])
    assert sorted(theirs.columns) == sorted(df.columns)
    places = [theirs.columns.index(c) for c in df.columns]
    assert Counter(map(tuple, df.collect())) == Counter(tuple(r[i] for i in places) for r in theirs.fetchall())


@pytest.fixture(scope="module")
def small(spark):
    return [(r.doc_id, r.text or "") for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]


def test_base_score(spark, small):
    tokens = {i: [*words(t.translate(LOWER)), None] for i, t in small}
    counts = Counter(w for i, ts in tokens.items() if fold(i, 5) != 1 for w in ts)
    total, distinct = sum(counts.values()), len(counts)
    got = collected(spark, "op3_lm_score", SMALL)
    assert set(got) == set(tokens)
    for i, ts in tokens.items():
        r = got[i]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ts)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(i, 5) == 1, len(ts), sum(counts[w] > 0 for w in ts), total)
        assert abs(r.base_score - base) < 1e-6 * max(1, -base) and r.score <= 0


def test_base_counts(spark, small):
    got = collected(spark, "op4_quality_rules", SMALL)
    assert len(got) == len(small)
    for i, text in small:
        w, seen, repeated = words(text), set(), 0
        for line in text.split("\n"):
            if words(line):
                repeated += line in seen
                seen.add(line)
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        hit = {p for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for p in range(k, k + 3)}
        failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(hit))
        assert r.base_failed == failed and not (failed and r.kept)


def luhn(digits):
    return sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


PLAIN = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(?:\.[0-9]+){3}", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", lambda m: 14 <= len(d := re.sub(r"[^0-9]", "", m)) <= 19 and luhn(d)),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub(r"[^0-9]", "", m)) <= 15),
}


def test_base_spans(spark, small):
    got = collected(spark, "op5_pii", SMALL)
    assert len(got) == len(small)
    for i, text in small:
        spans = [(m.start(), n, m.end(), kind) for n, (kind, (pattern, fits)) in enumerate(PLAIN.items()) for m in re.finditer(pattern, text) if fits(m.group())]
        counts = Counter(s[3] for s in spans)
        told = [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(spans)]
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(counts[k] for k in PLAIN)
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert set(told) <= set(r.spans.split(",")) | {""}


def test_held_out_languages(spark):
    langs = {r.doc_id: r.lang for r in table(spark, LARGER, "documents").select("doc_id", "lang").collect()}
    got = [r for r in collected(spark, "op1_language_id", LARGER).values() if r.held_out and langs[r.doc_id]]
    assert len(got) > 50 and all(fold(r.doc_id, 4) == 2 and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang_pred == langs[r.doc_id] for r in got) >= 0.95 * len(got)


def ranked_right(scores):
    """The share of pairs of a positive and a negative that are in order (ties by half)."""
    on, off = [s for s, y in scores if y], [s for s, y in scores if not y]
    return sum((a > b) + 0.5 * (a == b) for a in on for b in off) / (len(on) * len(off))


@pytest.mark.parametrize(("name", "label", "least"), [("op8_quality_fm", "quality", 0.95), ("op10_toxicity", "toxic", 0.85)])
def test_held_out_labels(spark, name, label, least):
    truth = {r.doc_id: r[label] for r in table(spark, LARGER, "labels").collect() if r[label] is not None}
    got = collected(spark, name, LARGER)
    held = [(r.score, truth[i]) for i, r in got.items() if r.held_out and i in truth]
    assert all(r.held_out == (fold(i, 5) == 0) and 0 <= r.score <= 1 for i, r in got.items())
    assert {y for _, y in held} == {0, 1} and ranked_right(held) >= least
