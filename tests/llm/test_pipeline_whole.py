"""The whole pipeline, and quality rules, against plain Python that looks at all pairs."""

import re
import zlib
from collections import defaultdict

import corpus_pipeline
from tallyspark.llm.common import table
from tallyspark.llm.language_id import identify
from tallyspark.llm.quality_rules import FENCE, METRICS, PRIOR_DOCS, metrics, quality_rules

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))


def similar(sets, hundredths):
    """For each key those keys whose sets have so many hundredths of their union in common; by the sets' elements, so that all pairs that share any are seen."""
    holding = defaultdict(set)
    for k, s in sets.items():
        for x in s:
            holding[x].add(k)
    return {k: {o for o in set().union(*(holding[x] for x in s)) if 100 * len(s & sets[o]) >= hundredths * len(s | sets[o])} for k, s in sets.items() if s}


def lines_removed(texts):
    place = defaultdict(list)
    for i, t in texts.items():
        for k, line in enumerate(t.split("\n")):
            if words(line):
                place[frozenset(words(line))].append((i, k))
    alike = similar({s: s for s in place}, 80)
    gone = defaultdict(set)
    for s, at in place.items():
        first = min(min(place[o]) for o in alike[s])
        for i, k in at:
            if (i, k) > first:
                gone[i].add(k)
    left = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in texts.items()}
    return {i: t for i, t in left.items() if not gone[i] or words(t)}


def near_removed(texts):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    alike = similar(sets, 75)
    kept, seen = {}, set()
    for i in sorted(texts):
        if i in seen:
            continue
        kept[i] = texts[i]
        todo = [i]
        while todo:  # all that can be reached go with the least
            for o in alike.get(todo.pop(), ()):
                if o not in seen:
                    seen.add(o)
                    todo.append(o)
    return kept


def leaks_removed(texts, items):
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(LOWER))
    asked = set()
    for t in items:
        w = tokens(t)
        asked |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(a) for a in asked}
    out = {}
    for i, t in texts.items():
        w = tokens(t)
        if not any(tuple(w[k : k + n]) in asked for n in sizes for k in range(len(w) - n + 1)):
            out[i] = t
    return out


def test_pipeline(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    docs = table(spark, SF, "documents")
    spoken = {r.doc_id for r in identify(docs, docs).filter("lang_pred <> 'und' and score >= 0.3").collect()}
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect() if r.doc_id in spoken}
    n = [len(texts)]
    for step in (lines_removed, near_removed, lambda t: leaks_removed(t, [r.text or "" for r in table(spark, SF, "benchmark").collect()])):
        texts = step(texts)
        n.append(len(texts))
    assert n == sorted(n, reverse=True) and n[-1] < n[0]
    made = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*made.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in corpus_pipeline.run(spark, SF).collect():
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert set(pieces) == set(ids)
    for i, mine in pieces.items():
        at = 0
        for r in sorted(mine, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids[i])
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[i][at : at + r.length]))
            at += r.length
        assert at == len(ids[i])
    for mine in sequences.values():
        at = 0
        for r in sorted(mine, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096


def test_quality_verdicts(spark):
    """Groups of so few documents have exact quantiles in their sketches, so every verdict can be told."""
    docs = table(spark, SF, "documents")
    rows = metrics(docs).collect()
    good = [r for r in rows if not r.base_failed]

    def quartile(some, metric, part):
        values = sorted(r[metric] for r in some)
        return values[-(-part * len(values) // 4) - 1]

    def drawn(r, metric, part):
        value = quartile(good, metric, part)
        for some in ([x for x in good if x.lang == r.lang], [x for x in good if (x.lang, x.source) == (r.lang, r.source)]):
            if some:
                value = (quartile(some, metric, part) * len(some) + value * PRIOR_DOCS) / (len(some) + PRIOR_DOCS)
        return value

    def kept(r):
        for metric, (least, sides) in METRICS.items():
            q1, q3 = (drawn(r, metric, part) for part in (1, 3))
            width = FENCE * max(q3 - q1, least)
            if r[metric] > q3 + width or sides == "both" and r[metric] < q1 - width:
                return False
        return not r.base_failed

    want = {r.doc_id: kept(r) for r in rows}
    got = {r.doc_id: r.kept for r in quality_rules(docs).collect()}
    assert got == want and 0 < sum(want.values()) < len(want)
