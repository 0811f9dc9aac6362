"""Prefix trie of conversations, built level by level.

A node is a distinct sequence of first turns; the root has none. Node names: depth and the smallest conversation
whose turns begin so, which no two nodes of a depth share. Conversations with the same turns form one class first, named by
the smallest, so copies cost nothing more. Then, a depth at a time, live classes are grouped by (parent node, next turn); the
least conversation of a group names its node. A class that is alone in its node leaves the levels: the rest of its path has
no branch, and its nodes follow from its turns. So there are as many rounds as the longest run of first turns that two
different conversations share. Afterwards joins from the deepest level up give children, leaves and savings.

No step needs a conversation or a node in one place. Turns are put in order by a range sort, and numbered within its parts and
from part to part; classes are known by parities of hashes of (place, turn), which are summed up where the turns lie. Turns are
compared by SHA-256 of role and text; texts are never shuffled (``texts`` gives them back). The digest of the conversations that
end in a node is one hash over all their ids, so its bytes pass through one task, as a sorted stream of strings of at
most 65,536 ids, never held together.

Order of turns: by number, null first; equal numbers by the SHA-256 of role and text; rows that are alike in all are turns of their
own. Null role or text is empty. Rows with a null conv_id take no part. An empty table has no node, not even a root.
Columns other than conv_id, turn, role and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import cut, table

#: Conversations borrow from the one whose id is the next lower multiple of GROUP, at most HEADS - 1 turns.
GROUP, HEADS = 5, 9
#: Ids of a string that goes into an end digest share all but their last bits.
CHUNK_BITS = 16
#: Hashes whose parities tell classes apart.
SALTS = (1, 2, 3)


def digest() -> Column:
    """SHA-256 of a turn's role and text."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))


def texts(conversations: DataFrame) -> DataFrame:
    """(digest, role, text) of all distinct turns; joined with nodes, it gives each node's last turn."""
    found = conversations.filter("conv_id is not null").select(digest().alias("digest"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return found.dropDuplicates(["digest"])


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, bytes, upto): turns numbered from 1, with the bytes of text in each and up to its end."""
    turns = conversations.filter("conv_id is not null").select("conv_id", "turn", digest().alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"))
    order = [F.col("turn").asc_nulls_first(), F.col("digest").asc(), F.col("row").asc()]
    # Parts of a range sort may end within a conversation, so that no task has to hold a long one.
    sorted_ = cut(turns.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(F.col("conv_id").asc(), *order)).withColumn("part", F.spark_partition_id())
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sorted_.groupBy("conv_id", "part").agg(F.count("*").alias("n"), F.sum("bytes").alias("b"))
    carried = parts.select("conv_id", "part", F.sum("n").over(before).alias("turns_before"), F.sum("b").over(before).alias("bytes_before")).filter("turns_before > 0")
    within = Window.partitionBy("part", "conv_id").orderBy(*order)
    placed = sorted_.withColumns({"depth": F.row_number().over(within), "upto": F.sum("bytes").over(within.rowsBetween(Window.unboundedPreceding, 0))})
    # Only the first conversation of a part can have begun before it: one row a part at most.
    joined = placed.join(F.broadcast(carried), ["conv_id", "part"], "left")
    since = lambda c, b: (F.col(c) + F.coalesce(b, F.lit(0))).cast("long")
    return joined.select("conv_id", since("depth", "turns_before").alias("depth"), "digest", "bytes", since("upto", "bytes_before").alias("upto"))


def rebuilt(turns: DataFrame, group: int = GROUP, heads: int = HEADS) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another: (the turns, as ``turns``; all conv_ids, turnless ones too).

    Conversation c takes the first h turns of c - c % group, then its own after the first h; h is crc32 of its id modulo ``heads``.
    """
    head = F.when(F.col("depth") < heads, F.struct("depth", "digest", "bytes", "upto"))
    convs = cut(turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(head)).alias("head")))  # fewer than ``heads`` structs each
    asked = convs.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads, "donor": F.col("conv_id") - F.col("conv_id") % group})
    given = asked.join(convs.select(F.col("conv_id").alias("donor"), F.col("head").alias("lent")), "donor", "left")
    first = lambda c: F.filter(F.coalesce(c, F.array().cast("array<struct<depth:bigint,digest:binary,bytes:bigint,upto:bigint>>")), lambda x: x["depth"] <= F.col("h"))
    last = lambda c: F.coalesce(F.try_element_at(c, F.lit(-1))["upto"], F.lit(0))
    plan = given.select("conv_id", "h", first(F.col("lent")).alias("lent"), first(F.col("head")).alias("left_out"))
    plan = cut(plan.select("conv_id", "h", "lent", (F.size("lent") - F.col("h")).alias("shift"), (last(F.col("lent")) - last(F.col("left_out"))).alias("bytes_shift")))
    lent = plan.select("conv_id", F.inline("lent"))
    own = turns.join(plan.select("conv_id", "h", "shift", "bytes_shift"), "conv_id").filter(F.col("depth") > F.col("h"))
    own = own.select("conv_id", (F.col("depth") + F.col("shift")).alias("depth"), "digest", "bytes", (F.col("upto") + F.col("bytes_shift")).alias("upto"))
    return cut(lent.unionByName(own)), plan.select("conv_id")


@dataclass
class Trie:
    """nodes: conv_id, depth, parent_conv_id, digest (of the last turn), n_convs, n_children, n_leaves, saved_tokens.

    ends: conv_id and the node in which that conversation ends: node (its conv_id) and depth.
    """

    nodes: DataFrame
    ends: DataFrame


def classes_of(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes: rep, n, size, total bytes; members: conv_id, rep) of conversations with the same turns."""
    parities = [F.bit_xor(F.xxhash64(F.lit(s), "depth", "digest")).alias(f"x{s}") for s in SALTS]
    key = ["size", *(f"x{s}" for s in SALTS)]
    summed = turns.groupBy("conv_id").agg(F.count("*").alias("size"), F.max("upto").alias("total"), *parities)
    known = cut(convs.join(summed, "conv_id", "left").fillna(0, [*key, "total"]))
    classes = cut(known.groupBy(*key).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n"), F.max("total").alias("total")))
    return classes.select("rep", "n", "size", "total"), known.join(classes.select(*key, "rep"), key).select("conv_id", "rep")


def build(turns: DataFrame, convs: DataFrame) -> Trie:
    """The trie of all ``convs``, whose turns (as of ``ordered``) are in ``turns``."""
    classes, members = classes_of(turns, convs)
    one = classes.select(F.col("rep").alias("conv_id"), "n", "size", "total")
    paths = turns.join(one, "conv_id").select(F.col("conv_id").alias("rep"), "depth", "digest", "bytes", "n", "size", (F.col("total") - F.col("upto") + F.col("bytes")).alias("rest"))
    paths = cut(paths.repartitionByRange("depth", "rep"))
    root = classes.agg(F.min("rep").alias("node"), F.sum("n").alias("n_convs")).filter("node is not null")
    root = cut(root.select(F.lit(None).cast("long").alias("parent"), F.lit(None).cast("binary").alias("digest"), "node", F.lit(2).cast("long").alias("n_classes"), "n_convs", F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("rest")))
    live = classes.select("rep", "n").crossJoin(F.broadcast(root.select(F.col("node").alias("parent"))))  # the root is one row
    levels, ended = [root], []
    for depth in count(1):
        here = paths.filter(F.col("depth") == depth).select("rep", "digest", "bytes", "rest")
        step = cut(live.join(here, "rep", "left"))
        ended.append(step.filter("digest is null").select("rep", F.col("parent").alias("node"), F.lit(depth - 1).cast("long").alias("depth")))
        found = step.filter("digest is not null").groupBy("parent", "digest")
        nodes = cut(found.agg(F.min("rep").alias("node"), F.count("*").alias("n_classes"), F.sum("n").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("rest").alias("rest")))
        levels.append(nodes)
        shared = nodes.filter("n_classes > 1")
        if shared.isEmpty():
            break
        live = step.select("rep", "n", "parent", "digest").join(shared.select("parent", "digest", "node"), ["parent", "digest"]).select("rep", "n", F.col("node").alias("parent"))
    heads = union([x.filter("n_classes = 1").select(F.col("node").alias("rep"), "parent", F.lit(d).cast("long").alias("start")) for d, x in enumerate(levels)])
    heads = cut(heads)
    tails = paths.join(heads, "rep").filter("depth >= start")
    tails = tails.select(
        F.col("rep").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("start"), F.col("parent")).otherwise(F.col("rep")).alias("parent_conv_id"), "digest",
        F.col("n").alias("n_convs"), (F.col("depth") < F.col("size")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), ((F.col("n") - 1) * F.col("rest")).alias("saved_tokens"),
    )
    ends = union(ended).unionByName(classes.join(heads, "rep").select("rep", F.col("rep").alias("node"), F.col("size").alias("depth")))
    return Trie(union([*rolled_up(levels), tails]), members.join(ends, "rep").select("conv_id", "node", "depth"))


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def rolled_up(levels: list[DataFrame]) -> list[DataFrame]:
    """The nodes that several classes share, from the deepest level up, with what their subtrees hold."""
    out, below = [], None
    for depth in range(len(levels) - 1, -1, -1):
        shared = levels[depth].filter("n_classes > 1")
        own = (F.col("n_convs") - 1) * F.col("bytes")
        if below is None:
            full = shared.withColumns({"n_children": F.lit(0).cast("long"), "n_leaves": F.lit(1).cast("long"), "saved_tokens": own})
        else:
            joined = shared.join(below.withColumnRenamed("parent", "node"), "node", "left")
            full = joined.withColumns({"n_children": F.coalesce("children", F.lit(0)), "n_leaves": F.coalesce("leaves", F.lit(1)), "saved_tokens": own + F.coalesce("saved", F.lit(0))})
        full = cut(full.select(F.col("node").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "digest", "n_convs", "n_children", "n_leaves", "saved_tokens"))
        out.append(full)
        single = levels[depth].filter("n_classes = 1").select("parent", F.lit(1).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("rest")).alias("saved_tokens"))
        every = full.select(F.col("parent_conv_id").alias("parent"), "n_leaves", "saved_tokens").unionByName(single)
        below = every.groupBy("parent").agg(F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    return out


def end_digests(ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256): SHA-256 of the ids of the conversations that end in a node, ascending and comma-joined."""
    chunk = F.shiftright("conv_id", CHUNK_BITS)
    strings = ends.groupBy("node", "depth", chunk.alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, so_far = None, None
        for batch in batches:
            done = []
            for *node, ids in zip(*(batch.column(k).to_pylist() for k in ("node", "depth", "ids")), strict=True):
                if node != at:
                    if at:
                        done.append((*at, so_far.hexdigest()))
                    at, so_far = node, hashlib.sha256(ids.encode())
                else:
                    so_far.update(f",{ids}".encode())
            yield rows(done)
        yield rows([(*at, so_far.hexdigest())] if at else [])

    def rows(done: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 3
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["conv_id", "depth", "ends_sha256"])

    laid = strings.repartition("node", "depth").sortWithinPartitions("node", "depth", "chunk").select("node", "depth", "ids")
    return laid.mapInArrow(digests, "conv_id long, depth long, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> Trie:
    """The trie of conversations as they are."""
    turns = cut(ordered(conversations))
    return build(turns, turns.select("conv_id").distinct())


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = rebuilt(cut(ordered(table(spark, sf_dir, "conversations"))))
    trie = build(turns, convs)
    nodes = trie.nodes.drop("digest").join(end_digests(trie.ends), ["conv_id", "depth"], "left")
    empty = F.sha2(F.lit("").cast("binary"), 256)
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", empty).alias("ends_sha256"))


OP13_SQL = """
WITH crcs AS (
    SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n)) AS entry
), turns AS (
    SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
    FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
    SELECT conv_id, conv_id - conv_id % 5 AS donor,
        xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c // 256, entry[xor(c % 256, b) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM turns), crcs
), built AS (
    SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.donor AND t.pos <= c.h
    UNION ALL
    SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
), whole AS (
    SELECT c.conv_id, coalesce(list(struct_pack(role := role, text := text) ORDER BY part, pos) FILTER (pos IS NOT NULL), []) AS path
    FROM convs c LEFT JOIN built USING (conv_id) GROUP BY c.conv_id
), prefixes AS (
    SELECT conv_id, d AS depth, list_slice(path, 1, d) AS path, len(path) = d AS ends
    FROM (SELECT conv_id, path, unnest(range(len(path) + 1)) AS d FROM whole)
), nodes AS (
    SELECT min(conv_id) AS conv_id, depth, path, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
        (count(*) - 1) * CASE WHEN depth > 0 THEN strlen(path[depth].text) ELSE 0 END AS saved
    FROM prefixes GROUP BY depth, path
), children AS (
    SELECT depth - 1 AS depth, list_slice(path, 1, depth - 1) AS path, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
), marked AS (
    SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.path = n.path
), subtrees AS (
    SELECT depth, path, sum(saved) AS saved_tokens, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves
    FROM (SELECT u.d AS depth, list_slice(m.path, 1, u.d) AS path, saved, n_children FROM marked m, LATERAL (SELECT unnest(range(m.depth + 1)) AS d) u) GROUP BY depth, path
)
SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, m.n_convs, CAST(m.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
    CAST(s.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM marked m JOIN subtrees s ON s.depth = m.depth AND s.path = m.path LEFT JOIN nodes p ON p.depth = m.depth - 1 AND p.path = list_slice(m.path, 1, m.depth - 1)
"""
