"""Hard negatives, best-fit packing and the prefix trie: whole queries against SQL and plain Python, and awkward tables."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from tallyspark.llm import best_fit, hard_negatives, prefix_trie
from tallyspark.llm.common import table

SMALL = "/root/testdata/sf0.001"


# --- prefix trie

CONVERSATION = "conv_id long, turn long, role string, text string, depth long, digest string, part int, row int, node long, rep long, h long, n long"


def conversations(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 1, 1, 1, 1, 1, 1) for r in rows], CONVERSATION)


def paths_of(rows, rebuild):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            d = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[c].append(((t is not None, t or 0, d), (role, text)))
    own = {c: [x for _, x in sorted(v)] for c, v in turns.items()}
    if not rebuild:
        return own
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        donor = own.get(c - int(math.fmod(c, 5)), [])
        out[c] = donor[:h] + mine[h:]
    return out


def trie_of(paths):
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
    rows = []
    for path, convs in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(q[: len(p)] == p and len(q) == len(p) + 1 for q in members)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = sorted(c for c in convs if len(paths[c]) == len(path))
        rows.append((min(convs), len(path), min(members[path[:-1]]) if path else None, len(convs), len(kids), len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(rows, key=str)


def nodes_of(trie):
    joined = trie.nodes.join(prefix_trie.end_digests(trie.ends), ["conv_id", "depth"], "left").collect()
    empty = hashlib.sha256(b"").hexdigest()
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256 or empty) for r in joined), key=str)


def awkward_conversations():
    rng = random.Random(5)
    rows = []
    for c in [*range(-12, 60), 10**15, 10**15 + 3]:
        for t in range(rng.randint(1, 9)):
            rows.append((c, None if rng.random() < 0.1 else t, rng.choice(["user", "assistant", None]), rng.choice(["a", "b", "", None, "ü€"])))
    rows += [(7, 3, "user", "same")] * 3 + [(None, 0, "user", "gone")]  # alike in all; no conversation
    rows += [(c, t, "user", "copy") for c in range(100, 140) for t in range(4)]  # a group of copies
    return rows


def test_trie_against_plain_python(spark):
    rows = awkward_conversations()
    df = conversations(spark, rows)
    assert nodes_of(prefix_trie.prefix_trie(df)) == trie_of(paths_of(rows, False))
    turns, convs = prefix_trie.rebuilt(prefix_trie.ordered(df))
    assert nodes_of(prefix_trie.build(turns, convs)) == trie_of(paths_of(rows, True))


def test_trie_of_one_long_conversation(spark):
    """Its nodes need no round each, and it may lie in several parts of the sort."""
    rows = [(1, t, "user", f"t{t % 7}") for t in range(3000)] + [(2, 0, "user", "t0")]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    got = nodes_of(prefix_trie.prefix_trie(conversations(spark, rows)))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(got) == 3001 and max(r[1] for r in got) == 3000
    by_depth = {r[1]: r for r in got}
    assert by_depth[0][3:7] == (2, 1, 1, 2) and by_depth[1][3:7] == (2, 1, 1, 2) and by_depth[2][3:7] == (1, 1, 1, 0) and by_depth[3000][4] == 0


def test_trie_texts_and_empty(spark):
    df = conversations(spark, [(1, 0, "user", "hello"), (1, 1, None, "x"), (2, 0, "user", "hello")])
    nodes = prefix_trie.prefix_trie(df).nodes
    named = {(r.conv_id, r.depth): (r.role, r.text) for r in nodes.join(prefix_trie.texts(df), "digest").collect()}
    assert named == {(1, 1): ("user", "hello"), (1, 2): ("", "x")}
    none = prefix_trie.prefix_trie(df.limit(0))
    assert none.nodes.count() == 0 and prefix_trie.end_digests(none.ends).count() == 0


# --- hard negatives

VECTORS = "vec_id long, embedding array<double>, label int, key string, cell string, lot int, band long, bands string, score long, part int, d double, q double"


def mined(rows, every):
    kept = {}
    for v, x, y in rows:
        if v is None or y is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        q = tuple(math.floor(256 * c) for c in x)
        if sum(c * c for c in q) < 1 << 62:
            kept[v, y, q] = None
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for v, y, q in kept:
        if v % every:
            continue
        others = [(-dot(q, b), w, z) for w, z, b in kept if w != v]
        for s, p, _ in sorted(o for o in others if o[2] == y)[:5]:
            fits = sorted(o for o in others if o[2] != y and 50 * -s <= 100 * -o[0] <= 95 * -s)[:3]
            out += [(v, p, k, n, -s, -t) for k, (t, n, _) in enumerate(fits, 1)]
    return sorted(out)


def awkward_vectors():
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], rng.randint(0, 3)) for i in range(180)]
    common = [rng.gauss(0, 1) for _ in range(6)]
    rows += [(1000 + i, common, rng.choice([1, 1, 1, 2])) for i in range(120)]  # one very common vector
    rows += [(0, rows[0][1], rows[0][2])] * 4  # repeated rows
    rows += [(2000, None, 1), (2010, [1.0, None], 1), (2020, [float("nan")] * 6, 1), (2030, [float("inf")] * 6, 1), (2040, [1e300] * 6, 1), (2050, [1e8, 1e8], 1), (2060, [1.0] * 6, None), (None, [1.0] * 6, 1)]
    rows += [(2070, [], 1), (2080, [0.0] * 6, 2), (2090, [1.0, 2.0], 2), (2100, [1.0] * 9, 3), (-10, [0.5] * 6, 1)]
    return rows


@pytest.mark.parametrize("sizes", [{}, {"BLOCK": 16, "PART": 4, "PAGE": 3}, {"PIVOTS": 1}])
def test_negatives_against_plain_python(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(hard_negatives, name, value)
    rows = awkward_vectors()
    df = spark.createDataFrame([(*r, "x", "x", 1, 1, "x", 1, 1, 0.0, 0.0) for r in rows], VECTORS)
    got = hard_negatives.hard_negatives(df, every=10).collect()
    want = mined(rows, 10)
    assert len(want) > 100 and sorted(map(tuple, got)) == want


def test_negatives_of_little(spark):
    df = spark.createDataFrame([(*r, "x", "x", 1, 1, "x", 1, 1, 0.0, 0.0) for r in awkward_vectors()], VECTORS)
    for some in (df.limit(0), df.filter("vec_id = 0"), df.filter("vec_id = 2080"), df.filter("vec_id >= 2000 and vec_id < 2070")):
        assert hard_negatives.hard_negatives(some).count() == 0


def test_brackets_hold(spark):
    """Every score lies in its bracket."""
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.integers(-300, 300, (200, 8))
    x[50:90] = x[3]
    vecs = [r.astype("<i4").tobytes() for r in x]
    norm = (x * x).sum(1)
    pivots = hard_negatives.Pivots(vecs[:64], int(norm.max()), 8)
    d, q = pivots.rows(x), pivots.queries(x, norm)
    least, most = hard_negatives.brackets(q, d, d, norm, pivots)
    scores = x @ x.T
    assert (least <= scores).all() and (scores <= most).all() and (most - least).mean() < 2 * norm.max()


# --- best-fit packing


def test_matching_is_close_to_the_least():
    rng = random.Random(3)
    for n in (0, 1, 3, 2000):
        for top in (2047, 900, 120):
            lengths = sorted((rng.randint(1, top) for _ in range(n)), reverse=True)
            bins = best_fit.matched(lengths)
            assert sorted(i for b in bins for i in b) == list(range(n)) and all(sum(lengths[i] for i in b) <= 2048 for b in bins)
            assert all(sum(3 * lengths[i] > 2048 for i in b) <= 2 for b in bins)
            halves = sum(2 * x > 2048 for x in lengths)
            assert len(bins) <= max(halves, -(-sum(lengths) // 2048)) * 1.02 + 1


def public_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*made.encode(t or "", add_special_tokens=False).ids, 0] for t in texts]


def check_pieces(rows, want):
    """``want``: (doc_id, ids) of all documents."""
    whole = defaultdict(list)
    for doc_id, ids in want:
        cut = len(ids) % 2048 or min(len(ids), 2048)
        edges = [0, *range(cut, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            whole[doc_id, k, a, b - a, zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[a:b]))].append(1)
    got = defaultdict(list)
    places = defaultdict(list)
    for r in rows:
        got[r.doc_id, r.piece, r.start, r.length, r.ids_crc32].append(1)
        places[r.sequence_id].append((r.offset, r.length))
    assert got == whole
    for at in places.values():
        assert [o for o, _ in sorted(at)] == [sum(n for _, n in sorted(at)[:k]) for k in range(len(at))] and sum(n for _, n in at) <= 2048
    return len(places)


def test_packing_whole_table(spark):
    docs = table(spark, SMALL, "documents").select("doc_id", "text").collect()
    want = list(zip([r.doc_id for r in docs], public_ids([r.text for r in docs]), strict=True))
    n = check_pieces(best_fit.op12_best_fit(spark, SMALL).collect(), want)
    assert n <= 1.01 * sum(len(i) for _, i in want) / 2048 + 1


def test_packing_awkward_texts(spark):
    import public_tokenizers as public

    texts = [None, "", "a", "<|endoftext|> b <|endoftext|>", "  two  spaces \n\n x", "é汉😀 １   z", "w " * 5000, "word " * 2047, "word " * 2046 + "w", " " * 1_500_000, "x" * 30_000]
    texts += ["copy of one text, a short one"] * 40
    rows = [(None if i == 3 else i % 45, t, i, "x", 1, 1, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lot int, spot string, length long, piece long, sequence_id long").repartition(5)
    pack = lambda docs: best_fit.pack(docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
    check_pieces(pack(df).collect(), [(r[0], ids) for r, ids in zip(rows, public_ids(texts), strict=True)])
    assert pack(df.limit(0)).count() == 0


# --- personal data behind disguises


DISGUISES = [
    ("email", "john [at] example [dot] com"), ("email", "john at example dot com"), ("email", "jоhn@exаmple.com"), ("email", "john＠example.com"), ("email", "john dot doe＠example.com"), ("email", "j.d(at)host{dot}org"),
    ("ip", "１０.0.0.25"), ("ip", "10 dot 0 dot 0 dot 25"), ("card", "４556 7375 8689 9855"), ("phone", "+1 five five five one two three four five six seven"), ("phone", "plus 49 one seven one 2345678"),
]
CLEAN = ["meet me at noon", "look at the dot", "é à ü ç", "a (b) c", "почта@mail.ru", "пишите на иванова@yandex.ru сегодня", "дом 5", "voilà où à la gare", "x < y > z", "", None]


def test_spans_of_planted_disguises(spark):
    """All disguises planted in texts of every kind are found where they are, and nothing else."""
    from tallyspark.llm.pii import find_pii, listed
    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows, want = [], {}
    for i in range(400):
        text, spans = "", []
        for _ in range(rng.randint(0, 4)):
            kind, shown = rng.choice(DISGUISES)
            text += (rng.choice(CLEAN) or "") + rng.choice([". ", "; ", "\n"])
            spans.append(f"{kind}:{len(text)}:{len(text) + len(shown)}")
            text += shown + rng.choice([". ", "; ", "\n"])
        text += rng.choice(CLEAN) or ""
        rows.append((i, text or None))
        want[i] = ",".join(spans)
    got = find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", listed(F.concat("base", "added")).alias("spans"), F.size("base").alias("n"))
    assert {r.doc_id: r.spans for r in got.collect()} == want and got.agg(F.sum("n")).first()[0] == 0


def test_very_long_texts_take_little_memory():
    from tallyspark.llm.pii import Rewriting, disguised_spans, plain_spans

    text = "lorem ipsum dolor sit amet " * 100_000
    assert disguised_spans(text, plain_spans(text)) == []
    way = Rewriting(text)
    assert way.starts.nbytes == 0  # nothing is kept for a text in which nothing is rewritten
    way.replace([(0, 5, "L"), (12, 17, "DOLORES")])
    assert way.text.startswith("L ipsum DOLORES sit") and len(way.text) == len(way.starts) == len(way.ends)
    assert way.starts.itemsize == way.ends.itemsize == 4 and (way.starts[0], way.ends[0], way.starts[8], way.ends[14]) == (0, 5, 12, 17)
    spelled = text + "john at example dot com " + text
    [(a, kind, b)] = disguised_spans(spelled, plain_spans(spelled))
    assert spelled[a:b] == "john at example dot com" and kind == 0
