"""Near-duplicate documents by HyperMinHash.

A document's set is its distinct word shingles. Documents with equal sets form one class at once. Each class
gets a HyperMinHash sketch: shingle hashes fall into ``BUCKETS`` buckets, and of each bucket's
smallest hash the count of leading zeros and the ``MANTISSA`` bits behind the first one are stored in 16 bits.
Empty buckets borrow from others in a fixed random order, so small sets can be compared as well. Bands
of ``ROWS`` registers propose candidates; a pair goes on if its estimated Jaccard index, corrected
for registers that agree by chance, is not far below the threshold; what goes on is verified on full
shingle sets, so every link is exact.

Classes are compared in three steps, never all with all. First each class is paired with one other, the least that leads
one of its bands' groups, which joins a large group of copies by as many pairs as it has members. Verified links
give components. Groups that then hold more than one component are gone through again: their members are paired with
the group's first and with the one before, where these lie in other components. What groups still are mixed are compared
in full, whatever their size: blocks of about ``BLOCK`` classes (fewer if their sets are large) with their texts meet inside a
task, which verifies the pairs of different components whose estimate is high enough and passes on no more links than it takes
to join what is linked. Those complete the components.

Null, empty or wordless text: the empty set, linked with nothing, its own component. Repeated rows have equal
sets and so one component. A null id stays null in ``component_id`` unless its component has another id.
Columns other than doc_id and text are ignored; ``deduplicate`` keeps all.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm import text as tx
from tallyspark.llm.common import NULL_ID, cut, maybe_in, packed, table, unpacked
from tallyspark.llm.components import components

SHINGLE = 5
#: Two sets are linked if NUMERATOR / DENOMINATOR of their union is in both.
NUMERATOR, DENOMINATOR = 75, 100
BUCKETS, ROWS = 128, 4
BANDS = BUCKETS // ROWS
MANTISSA = 10
#: Standard errors that an estimate may lie below the threshold before a pair is dropped unverified.
SLACK = 5
#: Classes of a block, one or two of which are compared within one task; neighbours are sought in parts of about PARTED such.
BLOCK, PARTED = 1024, 4
#: Shingles of a block, about, so that long texts make blocks of fewer classes.
BLOCK_SHINGLES = 1 << 20
SKETCHED = "doc_id long, is long, n_shingles long, class binary, sketch binary"


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer words has one, of all its words."""
    words = tx.Words(raw, offsets)
    hashes = words.hashes()
    runs = tx.windows(hashes, size)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= size:
            out.append(np.unique(runs[a : b - size + 1]))
        else:
            out.append(tx.windows(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def donors() -> np.ndarray:
    """For each bucket the order in which it borrows from the others."""
    rng = np.random.default_rng(20)
    return np.stack([rng.permutation(BUCKETS) for _ in range(BUCKETS)])


_donors: list[np.ndarray] = []


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Registers of a sorted set of hashes."""
    if not _donors:
        _donors.append(donors())
    shift = np.uint64(64 - (BUCKETS - 1).bit_length())
    bucket = (hashes >> shift).astype(np.int64)
    first = np.searchsorted(bucket, np.arange(BUCKETS))
    filled = np.diff(np.append(first, len(hashes))) > 0
    rest = hashes[np.minimum(first, len(hashes) - 1)] << (np.uint64(64) - shift)
    zeros = np.where(rest > 0, 63 - np.floor(np.log2(np.maximum(rest, np.uint64(1)).astype(np.float64))).clip(0, 63), 63).astype(np.uint64)
    zeros = np.where((rest << zeros) >> np.uint64(63) == 0, zeros + np.uint64(1), zeros).clip(0, 63)  # log2 rounds up near a power of two
    mantissa = ((rest << zeros) << np.uint64(1)) >> np.uint64(64 - MANTISSA)
    registers = (zeros << np.uint64(MANTISSA)) | mantissa
    if not filled.all():
        order = _donors[0]
        lender = order[np.arange(BUCKETS), np.argmax(filled[order], axis=1)]
        # A borrowed register is mixed with its bucket, so that it agrees only with one borrowed alike.
        registers = np.where(filled, registers, (registers[lender] * np.uint64(40503) + np.arange(BUCKETS, dtype=np.uint64)) & np.uint64(0xFFFF))
    return registers.astype(np.uint16)


def collision_rate() -> float:
    """How often registers of different minima agree: both have the same zeros and mantissa."""
    return sum(4.0**-z for z in range(1, 60)) / (1 << MANTISSA)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard index from sketches, freed of the agreement that chance makes."""
    chance = collision_rate()
    return np.maximum(0, (np.mean(a == b, axis=-1) - chance) / (1 - chance))


def least_estimate() -> float:
    t = NUMERATOR / DENOMINATOR
    return t - SLACK * (t * (1 - t) / BUCKETS) ** 0.5


def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in tx.chunks(batches):
        sets = shingle_sets(*tx.text_bytes(batch.column("text")))
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": batch.column("doc_id"),
                "is": batch.column("is"),
                "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                "class": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                "sketch": pa.array([sketch(s).tobytes() if len(s) else None for s in sets], pa.binary()),
            }
        )


def banded(classes: DataFrame, *keep: str) -> DataFrame:
    """(key, class, n_shingles, ...): one row for each class and band."""
    keys = [F.xxhash64(F.lit(k), F.substring("sketch", 2 * ROWS * k + 1, 2 * ROWS)) for k in range(BANDS)]
    return classes.select(F.explode(F.array(*keys)).alias("key"), "class", "n_shingles", *keep)


def close_sizes(a: str, b: str) -> Column:
    return (DENOMINATOR * F.least(a, b)) >= (NUMERATOR * F.greatest(a, b))


def paired(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def leader_pairs(bands: DataFrame) -> DataFrame:
    """(a, b): each class with the least class that leads one of its bands' groups; one pair a class at most."""
    leads = cut(bands.groupBy("key").agg(F.min(F.struct("class", "n_shingles")).alias("lead"), F.count("*").alias("size")).filter("size > 1").drop("size"))
    shared = maybe_in(bands, leads, "key").filter("maybe_").drop("maybe_").join(leads, "key")
    near = shared.filter(F.col("class") > F.col("lead.class")).filter(close_sizes("n_shingles", "lead.n_shingles"))
    return near.groupBy("class").agg(F.min("lead.class").alias("other")).select(*paired("class", "other"))


def neighbour_pairs(members: DataFrame) -> DataFrame:
    """(a, b): members with the first of their group and the one before, by set size, where these are of other components.

    Large groups are dealt into parts of about ``BLOCK * PARTED``.
    """
    salt = F.pmod(F.xxhash64("class"), F.ceil(F.col("size") / (BLOCK * PARTED)))
    order = Window.partitionBy("key", "salt").orderBy("n_shingles", "class")
    whole = F.struct("class", "n_shingles", "root")
    near = members.withColumn("salt", salt).select("class", "n_shingles", "root", F.lag(whole).over(order).alias("before"), F.first(whole).over(order).alias("hub")).filter("before is not null")
    both = near.select("class", "n_shingles", "root", F.explode(F.array("before", "hub")).alias("other")).filter(F.col("root") != F.col("other.root"))
    return both.filter(close_sizes("n_shingles", "other.n_shingles")).select(*paired("class", "other.class")).distinct()


def likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose estimate is high enough to be worth verifying."""
    least = least_estimate()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, BUCKETS) for k in ("sketch_a", "sketch_b"))
            yield batch.filter(pa.array(estimate(a, b) >= least)).select(["a", "b"])

    one = lambda k: classes.select(F.col("class").alias(k), F.col("sketch").alias(f"sketch_{k}"))
    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "sketch_a", "sketch_b").mapInArrow(judge, "a binary, b binary")


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs that are linked, by their full sets. ``rep`` of a class names one document, whose text stands for it."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = pc.binary_length(batch.column("text_a")).to_numpy(zero_copy_only=False) + pc.binary_length(batch.column("text_b")).to_numpy(zero_copy_only=False)
            ends, row = np.cumsum(size), 0
            while row < batch.num_rows:
                stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + tx.CHUNK_BYTES, "right")))
                some = batch.slice(row, stop - row)
                left, right = (shingle_sets(*tx.text_bytes(some.column(k))) for k in ("text_a", "text_b"))
                linked = []
                for x, y in zip(left, right, strict=True):
                    both = np.sort(np.concatenate([x, y]))
                    common = int(np.count_nonzero(both[1:] == both[:-1]))
                    linked.append(DENOMINATOR * common >= NUMERATOR * (len(x) + len(y) - common))
                yield some.filter(pa.array(linked)).select(["a", "b"])
                row = stop

    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classes, "class"), docs)
    one = lambda k: texts.select(F.col("class").alias(k), F.col("text").alias(f"text_{k}"))
    return pairs.join(one("a"), "a").join(one("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(judge, "a binary, b binary")


def texts_of(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(class, text): the text that stands for each class."""
    named = cut(classes.select("class", "rep.id", "rep.is"))
    return maybe_in(identified(docs), named, "id", "is").filter("maybe_").join(named, ["id", "is"]).select("class", "text").dropDuplicates(["class"])


def identified(docs: DataFrame, *keep: str) -> DataFrame:
    """id (never null) and a hash of the text, which together tell rows of different texts apart."""
    return docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("is"), "text", *keep)


def compare(_: tuple, group: pa.Table) -> pa.Table:
    """Links that join classes of different components, from one or two blocks: pairs of close sizes and a high estimate, verified on full sets."""
    part, n, names = (group.column(k).to_pylist() for k in ("part", "n_shingles", "class"))
    registers = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint16).reshape(-1, BUCKETS)
    sets: list[np.ndarray] = []
    for batch in tx.chunks(iter(group.select(["text"]).to_batches())):
        sets += shingle_sets(*tx.text_bytes(batch.column("text")))
    part, n = np.array(part), np.array(n)
    root = np.unique(np.array(group.column("root").to_pylist(), object), return_inverse=True)[1]
    least, a, b = least_estimate(), [], []
    two = part.min() != part.max()
    for i in range(len(n)):
        others = np.flatnonzero(root != root[i])
        others = others[part[others] > part[i]] if two else others[others > i]
        others = others[DENOMINATOR * np.minimum(n[others], n[i]) >= NUMERATOR * np.maximum(n[others], n[i])]
        others = others[estimate(registers[others], registers[i]) >= least] if len(others) else others
        if not len(others):
            continue
        theirs = np.concatenate([sets[j] for j in others])
        place = np.minimum(np.searchsorted(sets[i], theirs), len(sets[i]) - 1)
        common = tx.sums((sets[i][place] == theirs).astype(np.int64), np.append(0, np.cumsum(n[others])))
        for j in others[DENOMINATOR * common >= NUMERATOR * (n[i] + n[others] - common)]:
            if root[j] != root[i]:  # one link joins two components, more would tell nothing
                a.append(min(names[i], names[j]))
                b.append(max(names[i], names[j]))
                root[root == root[j]] = root[i]
    return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def mixed(members: DataFrame) -> DataFrame:
    """Members of groups with more than one component, with the size of their group; of groups with the same members one is enough."""
    groups = cut(members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"), F.sum("n_shingles").alias("weight")).filter("low <> high").select("key", "size", "weight"))
    found = cut(maybe_in(members, groups, "key").filter("maybe_").drop("maybe_").join(groups, "key"))
    sums = [F.sum(F.shiftright(F.xxhash64("class", F.lit(salt)), 24)).alias(f"sum_{salt}") for salt in (1, 2, 3)]
    alike = found.groupBy("key").agg(F.first("size").alias("size"), *sums)
    chosen = alike.groupBy("size", "sum_1", "sum_2", "sum_3").agg(F.min("key").alias("key")).select("key")
    return cut(found.join(chosen, "key"))


def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the component of their class, which is the class itself where it has no link."""
    return rows.join(roots.select(F.col("node").alias("class"), "root"), "class", "left").withColumn("root", F.coalesce("root", "class"))


def cross_links(classes: DataFrame, members: DataFrame, docs: DataFrame) -> DataFrame:
    """(a, b): links that join classes that share a band but not yet a component."""
    n_parts = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("weight") / BLOCK_SHINGLES)).cast("int")
    laid = members.select("key", "class", "root", F.pmod(F.xxhash64("class"), n_parts).cast("int").alias("part"), (n_parts - 1).alias("last"))
    dealt = laid.select("key", "class", "root", "part", F.explode(F.sequence(F.lit(0), "last")).alias("with"))
    dealt = dealt.select("key", "root", "part", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"), "class")
    needed = classes.join(members.select("class").distinct(), "class", "left_semi")
    full = dealt.join(needed.select("class", "n_shingles", "sketch").join(texts_of(needed, docs), "class"), "class")
    return full.groupBy("key", "i", "j").applyInArrow(compare, "a binary, b binary").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, is (hash of its text), n_shingles, component_id and kept."""
    marked = docs.select("doc_id", F.xxhash64("text").alias("is"), "text")
    sketched = cut(marked.mapInArrow(sketches, SKETCHED))
    rep = F.min(F.struct(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "is")).alias("rep")
    classes = cut(sketched.filter("class is not null").groupBy("class").agg(rep, F.min("doc_id").alias("least_id"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")))
    bands = banded(classes)
    links = cut(verified(cut(likely(leader_pairs(bands), classes)), classes, docs))
    roots = components(links)
    members = mixed(banded(cut(rooted(classes.select("class", "n_shingles", "sketch"), roots)), "root"))
    near = cut(verified(cut(likely(neighbour_pairs(members), classes)), classes, docs))
    tied = lambda more: more.unionByName(roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")))
    if not near.isEmpty():
        # Known components go on as stars, so that only what joins them is sought.
        roots = components(tied(near))
        members = mixed(rooted(members.drop("root", "size", "weight"), roots))
    if not members.isEmpty():
        across = cut(cross_links(classes, members, docs))
        if not across.isEmpty():
            roots = components(tied(across))
    placed = classes.join(roots.withColumnRenamed("node", "class"), "class", "left").select("class", "least_id", F.coalesce("root", "class").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = placed.join(ids, "root").select("class", "component_id")
    found = sketched.select("doc_id", "is", "n_shingles", "class").join(named, "class", "left")
    component = F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "is", "n_shingles", component.alias("component_id"), "class").withColumn("kept", F.col("class").isNull() | F.col("doc_id").eqNullSafe(F.col("component_id"))).drop("class")


def deduplicate(docs: DataFrame) -> DataFrame:
    """One document of each component, with all columns of ``docs``; of equal rows one stays, unless they have no words."""
    found = cut(near_duplicates(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), "is", "n_shingles", "kept"))
    gone = found.filter("not kept").select("id", "is").distinct()
    twice = found.filter("kept and n_shingles > 0").groupBy("id", "is").agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    touched = cut(gone.withColumn("gone", F.lit(True)).unionByName(twice.withColumn("gone", F.lit(False))))
    marked = maybe_in(packed(docs), touched, "id", "is")
    asked = marked.filter("maybe_").join(touched, ["id", "is"], "left")
    single = asked.filter("gone is null").unionByName(asked.filter("not gone").dropDuplicates(["id", "is"]))
    return unpacked(marked.filter("not maybe_"), docs.columns).unionByName(unpacked(single, docs.columns))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


OP2_SQL = r"""
WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, array_to_string(list_slice(w, pos, pos + 4), ' ') AS shingle
    FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS pos FROM d WHERE len(w) > 0)
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id
), links AS (
    SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 75 * (x.n + y.n - shared.n)
), edges AS (
    SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached(doc_id, other) AS (
    SELECT doc_id, doc_id FROM d
    UNION
    SELECT reached.doc_id, edges.b FROM reached JOIN edges ON edges.a = reached.other
), least AS (
    SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d JOIN least USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""
