"""Connected components by alternating large-star and small-star (Kiveris et al., 2014) on DataFrames.

Edges are first dealt into parts of about ``PART``, and each task turns its part into stars, so that the rounds begin with at most
one edge a node and part. Of one part the stars are the components.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import cut


#: Edges that a task turns into stars at once.
PART = 1 << 18


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b): of the edges of each ``PART`` or less, every node that is not the least it reaches there, with that least one."""

    def found(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        above: dict = {}

        def root(x):
            top = x
            while (up := above.get(top, top)) != top:
                top = up
            while (up := above.get(x, top)) != top:
                above[x], x = top, up
            return top

        for batch in held:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = root(a), root(b)
                if x != y:
                    above[max(x, y)] = min(x, y)
        return pa.RecordBatch.from_pydict({"a": pa.array(above, held[0].schema.field("a").type), "b": pa.array(map(root, list(above)), held[0].schema.field("b").type)})

    held, n = [], 0
    for batch in batches:
        for row in range(0, batch.num_rows, PART):
            some = batch.slice(row, PART)
            if n + some.num_rows > PART:
                yield found(held)
                held, n = [], 0
            held.append(some)
            n += some.num_rows
    if n:
        yield found(held)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge. ``edges`` has columns a and b of any ordered type; they are read twice.

    Each round is two shuffles of the edges and is cut off in the checkpoint folder; rounds grow with
    the logarithm of the longest path. Nodes and edges never meet on the driver, nor in a task if they are more than ``PART``.
    """
    edges = edges.filter("a <> b").select("a", "b")
    parts = -(-edges.count() // PART)
    # Links of a part lie where the round-robin puts them; no more than its share meets in a task.
    edges = cut(edges.repartition(max(1, parts)).mapInArrow(stars, edges.schema))
    if parts <= 1:
        return with_roots(edges)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Large star: neighbours above a node are tied to the least of its neighbourhood.
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: neighbours below a node, and the node, are tied to the least of them.
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lower, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(lower.select("a", F.col("m").alias("b"))).distinct()
        edges = cut(small)
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if now == before:
            break
        before = now
    return with_roots(edges)


def with_roots(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
