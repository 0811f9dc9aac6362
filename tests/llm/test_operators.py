"""Operators against brute force, on fixtures with nulls, empty and long texts, ties, repeated rows and extra columns."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tallyspark.llm import text as tx
from tallyspark.llm.common import fold, maybe_in
from tallyspark.llm.components import components
from tallyspark.llm.decontamination import decontaminate, scan
from tallyspark.llm.language_id import UNKNOWN, BloomSlices, bits, identify, recognised
from tallyspark.llm.lattice import Lattice
from tallyspark.llm.line_dedup import Lines, removed_lines, remove_lines
from tallyspark.llm.lm_score import lm_scores
from tallyspark.llm.near_dup import deduplicate, estimate, near_duplicates, shingle_sets, sketch
from tallyspark.llm.packing import Packer, Tokenizer, pack
from tallyspark.llm.pii import KINDS, digest, disguised_spans, find_pii, plain_spans
from tallyspark.llm.quality_fm import Machine, quality
from tallyspark.llm.quality_rules import quality_rules
from tallyspark.llm.toxicity import Matcher, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, id long, score double"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n, stems=("tha", "ing", "er", "on", "re", "st", "nd", "ou", "ti", "ha")):
    return " ".join("".join(rng.choice(stems, rng.integers(1, 4))) for _ in range(n))


def texts():
    rng = np.random.default_rng(5)
    base = [prose(rng, int(rng.integers(6, 90))) for _ in range(40)]
    out = list(base)
    for t in base[:15]:
        w = t.split()
        out += [t, " ".join(w[:-1]), " ".join(["x", *w]), " ".join(w[: len(w) * 3 // 4]), t.upper()]
    out += ["\n".join(base[i] for i in rng.integers(0, 40, 6)) for _ in range(10)]
    return [*out, None, "", " \n\t ", "one", "one", "É ß 日本 ǅ", "a b c d", "a b c d", "x" * 5000, " ".join(["long"] * 3000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}", 1, 2, 3, 0.5) for i, t in enumerate(texts())]
    return spark.createDataFrame([*rows, rows[3], rows[3], (None, "no id here at all", None, None, None, None, None, None)], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def shingles(t):
    w = words(t)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_words_and_hashes():
    data = [None, "", "  Ab c\n", "ab C", "日本 x", "\t"]
    w = tx.Words(*tx.text_bytes(pa.array(data, pa.string())))
    assert np.diff(w.first).tolist() == [0, 0, 2, 2, 2, 0]
    h = w.hashes()
    assert h[0] == h[2] and h[1] == h[3] and len({*h.tolist()}) == 4
    cased = w.hashes(lower=False)
    assert cased[0] != cased[2]


def test_near_duplicates(spark, docs, empty):
    rows = docs.select("doc_id", "text").collect()
    sets = {(r.doc_id, r.text): shingles(r.text) for r in rows}
    keys = list(sets)
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                parent[find(a)] = find(b)
    least = defaultdict(list)
    for k in keys:
        least[find(k)].append(k[0])
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    for k in keys:
        own = [i for i in least[find(k)] if i is not None]
        assert by_id[k[0]].component_id == (min(own) if own else None)
        assert by_id[k[0]].n_shingles == len(sets[k])
    left = deduplicate(docs)
    assert left.columns == docs.columns
    kept = [r.doc_id for r in left.collect()]
    assert sorted(kept, key=str) == sorted({r.doc_id for r in got if r.kept}, key=str)
    assert near_duplicates(empty).count() == 0 and deduplicate(empty).count() == 0


def test_sketches_estimate_jaccard():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        pool = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
        n = int(4000 * share)
        a, b = np.unique(pool[: n + (4000 - n) // 2]), np.unique(np.concatenate([pool[:n], pool[n + (4000 - n) // 2 :]]))
        assert abs(float(estimate(sketch(a)[None], sketch(b)[None])[0]) - share) < 0.2
    assert len(shingle_sets(*tx.text_bytes(pa.array(["a b c", None, "a b c d e f"])))[2]) == 2


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}


def test_line_dedup(spark, docs, empty):
    rows = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    place = defaultdict(list)
    order = lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        for k, line in enumerate((t or "").split("\n")):
            s = frozenset(words(line))
            if s:  # whatever its number of words
                place[s].append((order(i), k))
    gone = defaultdict(set)
    for s, at in place.items():
        first = min(min(place[o]) for o in place if 100 * len(s & o) >= 80 * len(s | o))
        for i, k in at:
            if (i, k) > first:
                gone[i].add(k)
    got = {r.id: r.numbers for r in removed_lines(docs).collect() if r.numbers}
    assert got == {i: sorted(v) for i, v in gone.items()}
    left = remove_lines(docs)
    assert left.columns == docs.columns
    texts_left = {r.doc_id: r.text for r in left.collect()}
    for i, t in rows:
        lines = [x for k, x in enumerate((t or "").split("\n")) if k not in gone[order(i)]]
        if gone[order(i)] and not words("\n".join(lines)):
            assert i not in texts_left
        else:
            assert texts_left[i] == (t if not gone[order(i)] else "\n".join(lines))
    assert removed_lines(empty).count() == 0 and remove_lines(empty).count() == 0


def test_lines_of_texts():
    lines = Lines(*tx.text_bytes(pa.array(["a b\n\nc", None, "", "\n", "d"])), None)
    assert lines.owner.tolist() == [0, 0, 0, 1, 2, 3, 3, 4] and lines.number.tolist() == [0, 1, 2, 0, 0, 0, 1, 0]
    assert lines.n.tolist() == [2, 0, 1, 0, 0, 0, 0, 1]


def test_language(spark, empty):
    rng = np.random.default_rng(3)
    de = ("ung", "sch", "keit", "ein", "ver", "ü", "ß", "lich")
    rows = [(i, prose(rng, 30) if i % 2 else prose(rng, 30, de), "en" if i % 2 else "de", "s", 1, 1, 1, 0.1) for i in range(80)]
    rows += [(100, None, "en", None, 1, 1, 1, 0.1), (101, "12 !!", None, None, 1, 1, 1, 0.1), (102, "", None, None, 1, 1, 1, 0.1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in identify(df, df.filter("doc_id < 60")).collect()}
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") and 0 <= got[i].score <= 1 for i in range(80))
    assert all(got[i].lang_pred == UNKNOWN for i in (100, 101, 102))
    assert recognised(df, df).count() == 80 and recognised(df, df).columns == df.columns
    assert identify(empty, empty).count() == 0
    assert {r.lang_pred for r in identify(df, empty).collect()} == {UNKNOWN}


def test_bloom_slices():
    model = BloomSlices(["a", "b"])
    keys = tx.mix(np.arange(1, 5001, dtype=np.uint64))
    model.add(0, keys[:3000])
    model.add(1, keys[2000:4000])
    (held,) = model.containing(keys)
    assert (held[:3000] & 1).all() and (held[2000:4000] & 2).all()
    assert (held[4000:] == 0).mean() > 0.99 and (model.false_rates() < 0.01).all()


def test_more_languages_than_bits(spark):
    names = [f"l{k:02}" for k in range(70)]
    model = BloomSlices(names)
    keys = tx.mix(np.arange(1, 7001, dtype=np.uint64))
    for k in range(70):
        model.add(k, keys[100 * k : 100 * k + 100])
    held = model.containing(keys)
    assert len(held) == 2 and all(bits(held[k // 64], k)[100 * k : 100 * k + 100].all() for k in range(70))
    assert all(bits(held[k // 64], k).mean() < 0.02 for k in range(70)) and len(model.false_rates()) == 70
    # Each language writes in two letters of its own.
    texts = [(k, " ".join(f"{chr(0x4E00 + 2 * k)}{chr(0x4E01 + 2 * k)}" * n for n in range(1, 9)), names[k]) for k in range(70)]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in identify(df, df).collect()} == dict(enumerate(names))


def test_lm_scores(spark, docs):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = docs.select("doc_id", "text", (fold("doc_id", 5) != 1).alias("learn")).collect()
    got = {r.doc_id: r for r in lm_scores(docs, "crc32(cast(cast(doc_id as string) as binary)) % 5 <> 1", path, rounds=1).collect()}
    counts = Counter()
    for r in rows:
        if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 != 1:
            counts.update([*words(r.text), "\n"])
    n, v = sum(counts.values()), len(counts)
    for r in rows:
        w = [*words(r.text), "\n"]
        base = sum(np.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        x = got[r.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (len(w), sum(counts[y] > 0 for y in w), n)
        assert abs(x.base_score - base) < 1e-6 and x.score < 0


def test_lattice_sums_all_segmentations():
    pieces = ["▁", "▁a", "a", "b", "ab", "▁ab", "ba"]
    p = np.log(np.array([0.2, 0.1, 0.2, 0.1, 0.1, 0.1, 0.1, 1e-4]))
    model = Lattice(pieces)

    def brute(s):
        if not s:
            return 1.0
        total = sum(np.exp(p[k]) * brute(s[len(x) :]) for k, x in enumerate(pieces) if s.startswith(x))
        return total + (np.exp(p[-1] * len(s[0].encode())) * brute(s[1:]) if s[0] not in pieces else 0)

    some = ["ab", "aab", "", "abé", "b" * 40, "日a"]
    assert np.allclose(model.forward(some, p), [np.log(brute("▁" + w)) for w in some])
    used = model.expected(["ab"], np.array([2.0]), p)
    assert abs((used[:-1] * [len(x) for x in pieces]).sum() - 2 * 3) < 1e-9


def test_quality_rules(spark, empty):
    rng = np.random.default_rng(4)
    rows = [(i, prose(rng, 80), "en", "s", 1, 1, 1, 0.1) for i in range(60)]
    rows += [(100, " ".join(w + "###" for w in prose(rng, 80).split()), "en", "s", 1, 1, 1, 0.1), (101, None, None, None, 1, 1, 1, 0.1), (102, "x y z " * 40, "en", "s", 1, 1, 1, 0.1), (103, "a\n \nb\na\na", "en", None, 1, 1, 1, 0.1)]
    got = {r.doc_id: r for r in quality_rules(spark.createDataFrame(rows, SCHEMA), prior_docs=20).collect()}
    assert all(got[i].kept for i in range(60)) and not got[100].kept and not got[100].base_failed
    assert got[101].base_failed and got[102].base_failed and got[102].n_repeat_words == 120
    assert got[103].n_dup_lines == 2 and got[100].n_symbols == 240
    assert quality_rules(empty).count() == 0


EMAIL, CARD = "john@example.com", "4556737586899855"


def test_pii():
    plain = f"mail {EMAIL} from 10.0.0.256 or 10.0.0.25 and +1 (555) 123-4567, card {CARD}."
    assert [(KINDS[k], plain[a:b]) for a, k, b in plain_spans(plain)] == [("email", EMAIL), ("ip", "10.0.0.25"), ("phone", "+1 (555) 123-4567"), ("card", CARD)]
    for disguised in ("john [at] example [dot] com", "john at example dot com", "jоhn@exаmple.com", "john＠example.com", "１０.0.0.25", "10 dot 0 dot 0 dot 25", "+1 five five five one two three four five six seven"):
        text = f"see {disguised} now"
        spans = disguised_spans(text, plain_spans(text))
        assert [text[a:b] for a, _, b in spans] == [disguised], disguised
    for clean in ("meet me at noon", "look at the dot", "one two three", "é à ü", "a (b) c"):
        assert disguised_spans(clean, plain_spans(clean)) == []
    assert plain_spans("a" * 200_000) == [] and plain_spans("1" * 200_000) == []


def test_pii_frame(spark, docs, empty):
    got = find_pii(docs).collect()
    assert len(got) == docs.count() and find_pii(empty).count() == 0
    assert digest([(3, 2, 9), (3, 0, 5)]) == "email:3:5,card:3:9"


def test_decontamination(spark, docs, empty):
    source = [r.text for r in docs.select("text").collect() if r.text and len(r.text.split()) > 30]
    items = [(1, " ".join(source[0].upper().split()[3:16])), (2, "one"), (3, None), (4, " - "), (5, "a b c d"), (None, "é ß")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    tokens = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for i, t in items:
        w = tokens(t)
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if w else 0):
            windows[tuple(w[k : k + size])].add(i)
    found = scan(docs, bench).collect()
    assert len(found) == docs.count()
    by_id = {r.doc_id: r for r in found}
    for r in docs.select("doc_id", "text").collect():
        w, hit, which = tokens(r.text), set(), set()
        for size in {len(x) for x in windows}:
            for k in range(len(w) - size + 1):
                if tuple(w[k : k + size]) in windows:
                    hit |= set(range(k, k + size))
                    which |= windows[tuple(w[k : k + size])]
        got = by_id[r.doc_id]
        assert got.n_words == len(w)
        assert {p for s in got.spans for p in range(s["first"] - 1, s["last"])} == hit
        assert got["items"] == sorted(str(i) for i in which if i is not None)
    clean = decontaminate(docs, bench)
    assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in found if not r.spans}
    spans = {r.doc_id: r.text for r in decontaminate(docs, bench, "spans").collect()}
    assert all(not r.spans for r in scan(docs.sparkSession.createDataFrame(list(spans.items()), "doc_id long, text string"), bench.filter("item_id = 1")).collect())
    assert scan(empty, bench).count() == 0 and decontaminate(docs, bench.limit(0)).count() == docs.count()


def labelled(spark, good, bad, column):
    rng = np.random.default_rng(9)
    rows = [(i, (good if i % 3 else bad)(rng), "en", "s", 1, 1, 1, 0.1) for i in range(150)]
    labels = [(i, int(bool(i % 3) == (column == "quality"))) for i in range(150)]
    return spark.createDataFrame([*rows, (900, None, None, None, None, None, None, None), (901, "", None, None, None, None, None, None)], SCHEMA), spark.createDataFrame([*labels, (None, 1), (3, None)], f"doc_id long, {column} int")


def test_toxicity(spark, empty):
    df, labels = labelled(spark, lambda r: prose(r, 60), lambda r: f"{prose(r, 30)} grobble{r.choice(list('abc'))} {prose(r, 30)}", "toxic")
    scored = toxicity(df, labels)
    got = {r.doc_id: r.score for r in scored.collect()}
    assert all((got[i] >= 0.5) == (i % 3 == 0) for i in range(150)) and got[900] < 0.5 and got[901] < 0.5
    assert toxicity(empty, None).count() == 0 and toxicity(df, None).count() == df.count()
    assert toxicity(df, labels.limit(0)).count() == df.count()


def test_matcher():
    model = Matcher({"idiot": 3.0, "scum": 2.0, "grob*": 1.0}, ("idiot proof",))
    found = lambda t: model.matches(*tx.code_points(*tx.text_bytes(pa.array(t))))[2].tolist()
    assert found(["You 1D10T!"]) == [3.0] and found(["idiots", "idiot proof", "xidiot", None]) == []
    assert found(["grobble grob ungrob"]) == [1.0, 1.0] and found(["idi", "ot"]) == [] and found(["ѕcum***"]) == [2.0]


def test_machine_uses_pairs():
    rng = np.random.default_rng(0)
    v, w = rng.normal(size=(6, 3)), rng.normal(size=6)
    number, value = np.array([0, 2, 5, 1, 4]), rng.normal(size=5)
    raw, _ = Machine(0.3, w, v).raw(number, value, np.array([0, 3, 5]))
    for out, at in zip(raw, (range(3), range(3, 5)), strict=True):
        pairs = sum(v[number[i]] @ v[number[j]] * value[i] * value[j] for i in at for j in at if i < j)
        assert abs(out - (0.3 + sum(w[number[i]] * value[i] for i in at) + pairs)) < 1e-9


def test_quality(spark, empty):
    df, labels = labelled(spark, lambda r: prose(r, 60), lambda r: " ".join(w + "$$$" for w in prose(r, 60).split()), "quality")
    got = {r.doc_id: r.score for r in quality(df, labels).collect()}
    assert all((got[i] >= 0.3) == bool(i % 3) for i in range(150)) and 0 <= got[900] <= 1 and 0 <= got[901] <= 1
    assert quality(empty, labels).count() == 0
    assert {r.score for r in quality(df, labels.limit(0)).collect()} == {0.5}


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def test_tokenizer(vocabulary):
    from tokenizers import Tokenizer as Public

    public, ours = Public.from_file(vocabulary), Tokenizer(vocabulary)
    some = ["Don't <|endoftext|> <|ENDOFTEXT|> x.", "É é ﬁ İ ß a\x0bb", "Σας 日本 ١٢", "", "a" * 300, "we'll... 12%%% ok!", "don'中​<|endoftext|>"]
    for t, ids in zip(some, ours.ids([t.encode() for t in some]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == public.encode(t, add_special_tokens=False).ids


def test_tokenizer_learns_new_words_alone(vocabulary):
    """Texts of odd words have the public ids, also when words are forgotten; what is remembered is not gone through for each chunk."""
    from tokenizers import Tokenizer as Public

    class Asked(dict):
        def keys(self):
            raise AssertionError("gone through")

        __iter__ = keys

    public, ours, few = Public.from_file(vocabulary), Tokenizer(vocabulary), Tokenizer(vocabulary)
    ours.known, ours.plain, few.remembered = Asked(), Asked(), 50
    rng = np.random.default_rng(8)
    pieces = ["a", "The", "the", "st", "é", "e\u0301", "É", "ß", "İ", "Σ", "ñ", "日本", "中", "'s", "'", "’", ".", "%%%", "...", "$", "<|", "|>", "<|endoftext|>", "<|ENDOFTEXT|>", "7", "١", "\u0338", "=", "_", "-", "ﬁ", "\u200b"]
    texts = [" ".join("".join(rng.choice(pieces, rng.integers(1, 5))) for _ in range(40)) for _ in range(60)]
    for t in texts:
        expected = public.encode(t, add_special_tokens=False).ids
        for made in (ours, few):
            assert np.frombuffer(made.ids([t.encode()])[0], "<u4").tolist() == expected


def test_packing(spark, docs, empty, vocabulary):
    from tokenizers import Tokenizer as Public

    public = Public.from_file(vocabulary)
    rows = pack(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), vocabulary).toPandas()
    for r in docs.select("doc_id", "text").collect():
        if r.doc_id is None:
            continue
        ids = np.array([*public.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        own = rows[rows.doc_id == r.doc_id].sort_values("start")
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and own.length.sum() == len(ids) == own.doc_tokens.iloc[0]
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(own.start, own.length, strict=True)] == own.ids_crc32.tolist()
    for _, s in rows.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 4096
    assert pack(empty, vocabulary).count() == 0


def test_packer_pads_little():
    rng = np.random.default_rng(6)
    packer = Packer(0)
    for i, n in enumerate(rng.integers(1, 9000, 500)):
        packer.add(i, bytes(4 * int(n)))
    packer.finish()
    batch = packer.take().to_pandas()
    sizes = batch.groupby("sequence_id").length.sum()
    pad = sum(0 if n & (n - 1) == 0 else 4096 - n for n in sizes)
    assert pad < 0.01 * sizes.sum() and sizes.max() <= 4096


def test_filter_misses_nothing(spark):
    wanted = spark.range(0, 100_000, 7).withColumnRenamed("id", "k")
    rows = maybe_in(spark.range(100_000).withColumnRenamed("id", "k"), wanted, "k")
    assert rows.filter("k % 7 = 0 and not maybe_").count() == 0
    assert rows.filter("k % 7 <> 0 and maybe_").count() < 1000
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
