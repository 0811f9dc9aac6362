"""Hard negatives by a pivot table.

Vectors of integers are augmented by one coordinate, so that all have the same length: x gets sqrt(M - |x|^2), where M is the
largest |x|^2, and a query q gets 0. Then |q - x|^2 = |q|^2 + M - 2 q.x, and a large inner product is a small distance. A
few pivots are chosen from a bounded sample, and every row stores its distance to each. By the triangle inequality
the distances of a query and a row to one pivot bracket their own distance, and so their score: between pivots the
tightest bracket counts. Rows whose bracket misses what is sought are left out, the others are scored exactly.

Rows of a label whose nearest pivots are the same form a cell, cells of more than ``BLOCK`` rows are dealt into blocks, and a
block keeps the least and greatest distance to each pivot. So whole blocks are left out by the same rule, and an anchor goes
only to blocks that may hold what it seeks. Two passes: each anchor first searches its most promising block, which gives
it a bar; then the other blocks that may beat the bar. Anchors come in parts of about ``PART``; a task has one
block and one part. An anchor seeks by bands of scores: its positives in one band without limits among its own
label, then its negatives, a band a positive, among the other labels.

Rows with a null vec_id, label or vector or a null or non-finite component take no part, nor those whose squared length reaches 2^62,
for their scores need not fit a long. Vectors of different lengths are compared as if zeros followed the shorter, empty
ones too. Rows alike in id, label and vector count once; different rows of one vec_id stay apart, none is its own partner, and ties
of score and id go by a hash of label and vector. Columns other than vec_id, embedding and label are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyspark.llm.common import cut, table

#: Pivots, and the rows (those with the least hash) from which they are chosen.
PIVOTS, SAMPLE = 8, 512
#: Rows of a block and anchors of a part, about; blocks' summaries travel in pages of about PAGE.
BLOCK, PART, PAGE = 1024, 2048, 256
#: Anchors that are compared at once within a task.
TILE = 128
#: Distances are taken to be wrong by this share of the largest at most.
SLACK = 1e-6
#: Squared lengths stay below, so that every score fits a long.
LONGEST = 1 << 62
POSITIVES, NEGATIVES = 5, 3
#: A negative's score is between these hundredths of the positive's.
LOW, HIGH = 50, 95
ROW = "key long, vec_id long, label long, vec binary, norm long"


def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components as floor(256 * x), in 32 bits, and their squared length; rows that take no part go."""
    for batch in batches:
        batch = batch.filter(pc.is_valid(batch.column("embedding")))
        if not batch.num_rows:
            continue
        lists = batch.column("embedding")
        values = np.floor(256 * pc.fill_null(lists.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False))
        ends = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        vecs, norms, stay = [], [], []
        for stop, size in zip(ends, np.diff(ends, prepend=0), strict=True):
            v = values[stop - size : stop]
            fits = bool(np.isfinite(v).all() and v @ v < 2.0 * LONGEST)
            v = v.astype(np.int64) if fits else v
            norm = sum(int(x) * int(x) for x in v) if fits and v @ v < 0 else int(v @ v) if fits else LONGEST
            stay.append(0 <= norm < LONGEST)
            norms.append(norm if stay[-1] else 0)
            vecs.append(v.astype("<i4").tobytes() if stay[-1] else b"")
        yield pa.RecordBatch.from_pydict({"vec_id": batch.column("vec_id"), "label": batch.column("label"), "vec": pa.array(vecs, pa.binary()), "norm": pa.array(norms, pa.int64())}).filter(pa.array(stay))


def vectors(rows: DataFrame) -> DataFrame:
    """(key, vec_id, label, vec, norm) of the rows that take part, each once; key tells different rows apart."""
    asked = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").filter("vec_id is not null and label is not null")
    found = asked.mapInArrow(quantised, "vec_id long, label long, vec binary, norm long").dropDuplicates(["vec_id", "label", "vec"])
    return found.select(F.xxhash64("vec_id", "label", "vec").alias("key"), "vec_id", "label", "vec", "norm")


def matrix(vecs: list[bytes], width: int | None = None) -> np.ndarray:
    """Vectors as rows of 64-bit integers, zeros behind shorter ones."""
    sizes = {len(v) for v in vecs}
    width = max([0, *sizes]) // 4 if width is None else width
    if sizes == {4 * width}:
        return np.frombuffer(b"".join(vecs), "<i4").reshape(len(vecs), width).astype(np.int64)
    out = np.zeros((len(vecs), width), np.int64)
    for row, v in zip(out, vecs, strict=True):
        part = np.frombuffer(v, "<i4")[:width]
        row[: len(part)] = part
    return out


def products(a: np.ndarray, b: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of rows, exact: in floating point where no partial sum can pass 2^53. ``bound``: of the product of lengths."""
    width = max(a.shape[1], b.shape[1])
    a, b = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))
    return (a.astype(float) @ b.T.astype(float)).astype(np.int64) if bound < 1 << 53 else a @ b.T


class Pivots:
    """Chosen rows; M is the largest squared length. Distances are between augmented vectors."""

    def __init__(self, vecs: list[bytes], largest: int, n: int):
        self.largest = float(largest)
        x = matrix(vecs)
        chosen, nearest = [0] if len(vecs) else [], np.full(len(vecs), np.inf)
        while chosen:
            nearest = np.minimum(nearest, self.between(x, x[chosen[-1:]])[:, 0])
            if len(chosen) == n or nearest.max() <= 0:
                break
            chosen.append(int(nearest.argmax()))
        self.points = x[chosen]

    def between(self, x: np.ndarray, points: np.ndarray) -> np.ndarray:
        lengths = [np.maximum(self.largest - np.einsum("ij,ij->i", v.astype(float), v.astype(float)), 0) for v in (x, points)]
        dots = products(x, points, self.largest).astype(float)
        return np.sqrt(np.maximum(2 * self.largest - 2 * dots - 2 * np.sqrt(np.outer(*lengths)), 0))

    def rows(self, x: np.ndarray) -> np.ndarray:
        """Distances of rows to the pivots."""
        return self.between(x, self.points)

    def queries(self, x: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Distances of queries, whose added coordinate is 0."""
        return np.sqrt(np.maximum(norm[:, None].astype(float) + self.largest - 2 * products(x, self.points, self.largest), 0))

    def scores(self, distance: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """The inner product that goes with a distance from queries."""
        return (norm[:, None].astype(float) + self.largest - distance * distance) / 2

    @property
    def slack(self) -> float:
        return SLACK * (2 * self.largest) ** 0.5 + 1e-9


def stored(vecs: DataFrame, pivots: Pivots, depth: int) -> DataFrame:
    """``vecs`` with their distances as a row and as a query, and the cell: the ``depth`` nearest pivots in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, norm = matrix(batch.column("vec").to_pylist()), batch.column("norm").to_numpy()
            d, q = pivots.rows(x), pivots.queries(x, norm)
            cell = np.argsort(d, axis=1, kind="stable")[:, :depth].astype("u1")
            more = {"cell": pa.array([c.tobytes() for c in cell], pa.binary()), "d": pa.array(list(d), pa.list_(pa.float64())), "q": pa.array(list(q), pa.list_(pa.float64()))}
            yield pa.RecordBatch.from_pydict({k: batch.column(k) for k in batch.schema.names} | more)

    return vecs.mapInArrow(run, f"{ROW}, cell binary, d array<double>, q array<double>")


def brackets(q: np.ndarray, low: np.ndarray, high: np.ndarray, norm: np.ndarray, pivots: Pivots) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score of each query with anything whose distances to the pivots are between ``low`` and ``high``."""
    near, far = np.zeros((len(q), len(low))), np.full((len(q), len(low)), np.inf)
    for k in range(q.shape[1]):
        mine = q[:, k, None]
        np.maximum(near, np.maximum(mine - high[None, :, k], low[None, :, k] - mine), out=near)
        np.minimum(far, mine + high[None, :, k], out=far)
    s = pivots.slack
    return pivots.scores(far + s, norm) - 1, pivots.scores(np.maximum(near - s, 0), norm) + 1


def bands_of(table_: pa.Table) -> np.ndarray:
    """(name, least, greatest score) of the queries' first bands, then of their second, and so on; what a query lacks holds no score."""
    bands = table_.column("bands").to_pylist()
    out = np.tile(np.array([0, 1, 0]), (max([0, *map(len, bands)]), len(bands), 1))
    for i, mine in enumerate(bands):
        for t, b in enumerate(mine):
            out[t, i] = b["band"], b["low"], b["high"]
    return out


def may_hold(bands: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which brackets meet one of their query's bands."""
    out = np.zeros(least.shape, bool)
    for b in bands:
        out |= (most >= b[:, 1:2]) & (least <= b[:, 2:3])
    return out


def best(scores: np.ndarray, allowed: np.ndarray, k: int, *ties: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each row's ``k`` largest allowed scores, ties by what is least."""
    if scores.shape[1] > k:  # those below the k-th score go before ties are looked at
        held = np.where(allowed, scores, np.iinfo(np.int64).min)
        allowed = allowed & (scores >= np.partition(held, -k, axis=1)[:, -k, None])
    i, j = np.nonzero(allowed)
    order = np.lexsort((*(t[j] for t in reversed(ties)), -scores[i, j], i))
    i, j = i[order], j[order]
    stay = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[stay], j[stay]


def array_of(table_: pa.Table, name: str, kind: str = "f8") -> np.ndarray:
    return np.array(table_.column(name).to_pylist(), kind).reshape(table_.num_rows, -1)


def apart(df: DataFrame) -> DataFrame:
    """``df`` with columns of its own, so that it can be grouped beside what it was made from."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def search(anchors: DataFrame, rows: DataFrame, pivots: Pivots, same: bool, k: int) -> DataFrame:
    """(key, band, score, vec_id, other): each anchor's first ``k`` rows in each of its ``bands``.

    anchors: key, vec_id, label, vec, norm, q, part and bands (band, low, high); ``same``: rows of the anchor's label, else of others.
    """
    block = ["label", "cell", "lot"]
    n_pivots = len(pivots.points)
    extremes = [F.array(*(f(F.col("d")[i]) for i in range(n_pivots))).cast("array<double>").alias(name) for f, name in ((F.min, "low"), (F.max, "high"))]
    summaries = cut(rows.groupBy(*block).agg(*extremes))
    pages = max(1, -(-summaries.count() // PAGE))
    paged = summaries.withColumn("page", F.pmod(F.xxhash64(*block), F.lit(pages)).cast("int"))
    parts = anchors.select("part").distinct()
    # Each part of the anchors meets each page of summaries, both of about a known size.
    with_parts = paged.join(parts.withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1)))), "page")
    asking = anchors.select("key", "label", "norm", "q", "bands", "part", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("page"))

    def route(key: tuple, asks: pa.Table, there: pa.Table) -> pa.Table:
        empty = {"key": pa.array([], pa.int64()), "label": pa.array([], pa.int64()), "cell": pa.array([], pa.binary()), "lot": pa.array([], pa.int32()), "best": pa.array([], pa.float64()), "least": pa.array([], pa.float64())}
        if not asks.num_rows or not there.num_rows:
            return pa.table(empty)
        norm = asks.column("norm").to_numpy()
        least, most = brackets(array_of(asks, "q"), array_of(there, "low"), array_of(there, "high"), norm, pivots)
        wanted = may_hold(bands_of(asks), least, most)
        alike = asks.column("label").to_numpy()[:, None] == there.column("label").to_numpy()[None, :]
        i, j = np.nonzero(wanted & (alike == same))
        return pa.table({"key": asks.column("key").take(pa.array(i)), **{c: there.column(c).take(pa.array(j)) for c in block}, "best": pa.array(most[i, j]), "least": pa.array(least[i, j])})

    def exact(_: tuple, asks: pa.Table, there: pa.Table) -> pa.Table:
        out: list[np.ndarray] = []
        if asks.num_rows and there.num_rows:
            x, d, ids = matrix(there.column("vec").to_pylist()), array_of(there, "d"), there.column("vec_id").to_numpy()
            others = there.column("key").to_numpy()
            longest = int(there.column("norm").to_numpy().max())
            for first in range(0, asks.num_rows, TILE):
                some = asks.slice(first, TILE)
                norm, mine, keys = (some.column(c).to_numpy() for c in ("norm", "vec_id", "key"))
                least, most = brackets(array_of(some, "q"), d, d, norm, pivots)
                bands = bands_of(some)
                wanted = may_hold(bands, least, most)
                wanted &= mine[:, None] != ids[None, :]
                columns = np.flatnonzero(wanted.any(axis=0))
                if not len(columns):
                    continue
                scores = products(matrix(some.column("vec").to_pylist()), x[columns], float(longest) ** 0.5 * float(norm.max()) ** 0.5)
                for b in bands:
                    i, j = best(scores, wanted[:, columns] & (scores >= b[:, 1:2]) & (scores <= b[:, 2:3]), k, ids[columns], others[columns])
                    out.append(np.stack([keys[i], b[i, 0], scores[i, j], ids[columns[j]], others[columns[j]]], 1))
        found = np.concatenate(out) if out else np.zeros((0, 5), np.int64)
        return pa.table({name: pa.array(found[:, c].astype(np.int64)) for c, name in enumerate(("key", "band", "score", "vec_id", "other"))})

    found_schema = "key long, band long, score long, vec_id long, other long"
    routes = cut(apart(asking).groupBy("part", "page").cogroup(with_parts.groupBy("part", "page")).applyInArrow(route, "key long, label long, cell binary, lot int, best double, least double"))

    def searched(asked: DataFrame, chosen: DataFrame) -> DataFrame:
        """What anchors (with their bands as they are now) find in the blocks that were chosen for them."""
        asks = chosen.join(asked.select("key", "vec_id", "norm", "q", "vec", "bands", "part"), "key")
        needed = asks.select(*block, "part").distinct()
        laid = rows.join(needed, block)
        return apart(asks).groupBy(*block, "part").cogroup(laid.groupBy(*block, "part")).applyInArrow(exact, found_schema)

    first = Window.partitionBy("key").orderBy(F.col("best").desc(), *block)
    ranked = routes.withColumn("turn", F.row_number().over(first))
    probed = cut(searched(anchors, ranked.filter("turn = 1").drop("turn", "best", "least")))
    # The bar of a band: the k-th score that the first block gave.
    bars = probed.groupBy("key", "band").agg(F.min("score").alias("bar"), F.count("*").alias("n")).filter(F.col("n") >= k)
    opened = anchors.select("key", F.explode("bands").alias("b")).select("key", "b.*").join(bars, ["key", "band"], "left")
    raised = opened.groupBy("key").agg(F.collect_list(F.struct("band", F.greatest("low", F.coalesce("bar", "low")).alias("low"), "high")).alias("bands"))
    barred = cut(anchors.drop("bands").join(raised, "key"))
    may = lambda b: (F.col("best") >= b["low"]) & (F.col("least") <= b["high"])
    rest = ranked.filter("turn > 1").join(barred.select("key", "bands"), "key").filter(F.exists("bands", may)).drop("turn", "best", "least", "bands")
    both = probed.unionByName(searched(barred, rest))
    order = Window.partitionBy("key", "band").orderBy(F.col("score").desc(), "vec_id", "other")
    return both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, every: int = 1, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); anchors: rows whose vec_id ``every`` divides."""
    vecs = cut(vectors(rows))
    told = vecs.agg(F.count("*").alias("n"), F.max("norm").alias("largest"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
    sample = vecs.orderBy(F.xxhash64(F.lit(11), "key"), "key").limit(SAMPLE).select("vec").collect()
    pivots = Pivots([bytes(r.vec) for r in sample], told.largest or 0, PIVOTS)
    depth = 0
    while len(pivots.points) > 1 and depth < len(pivots.points) and told.n > BLOCK * 10 * len(pivots.points) ** depth:
        depth += 1
    placed = cut(stored(vecs, pivots, depth))
    sizes = placed.groupBy("label", "cell").agg(F.count("*").alias("size"))
    lot = F.pmod(F.xxhash64(F.lit(5), "key"), F.ceil(F.col("size") / BLOCK)).cast("int").alias("lot")
    laid = cut(placed.join(sizes, ["label", "cell"]).select("key", "vec_id", "label", "vec", "norm", "cell", "d", "q", lot))
    part = F.pmod(F.xxhash64(F.lit(7), "key"), F.lit(max(1, -(-told.anchors // PART)))).cast("int").alias("part")
    anchors = cut(laid.filter(F.col("vec_id") % every == 0).select("key", "vec_id", "label", "vec", "norm", "q", part))
    open_band = F.array(F.struct(F.lit(0).cast("long").alias("band"), F.lit(-LONGEST).cast("long").alias("low"), F.lit(LONGEST).cast("long").alias("high")))
    near = cut(search(anchors.withColumn("bands", open_band), laid, pivots, True, positives))
    # low * p <= 100 * n <= high * p has no whole n for a negative p.
    limits = near.filter("score >= 0").select("key", F.col("rank").cast("long").alias("band"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    hundredth = lambda c, up: ((F.col("positive_score").cast("decimal(38,0)") * c + (99 if up else 0)) / 100).cast("decimal(38,6)")
    bounded = limits.select("key", F.struct("band", F.floor(hundredth(low, True)).cast("long").alias("low"), F.floor(hundredth(high, False)).cast("long").alias("high")).alias("b"))
    seeking = cut(anchors.join(bounded.filter("b.low <= b.high").groupBy("key").agg(F.collect_list("b").alias("bands")), "key"))
    far = search(seeking, laid, pivots, False, negatives).select("key", "band", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    found = far.join(limits, ["key", "band"]).join(anchors.select("key", F.col("vec_id").alias("anchor_id")), "key")
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def relabelled(rows: DataFrame) -> DataFrame:
    """Where vec_id is divisible by 7, label becomes (label + 1) % 10."""
    label = F.col("label").cast("long")
    return rows.select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")), every=50)


OP11_SQL = """
WITH v AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
    FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
    FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
), positives AS (
    SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS INTEGER) AS rank,
    other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
