"""Line deduplication by an exact set-similarity join.

A line's set is its distinct words, A-Z lower-cased. Lines without words are left alone, as are those of fewer
distinct words than ``least_words`` where a caller asks for more than one. Two lines match if ``NUMERATOR / DENOMINATOR`` of their union is in both; of matching lines all but
the first, by document id, text hash and line number, are removed.

Lines with equal sets form one class at once, known by two 64-bit hashes. A line's words are ordered by rarity, from counts of all lines'
words in a table of hashed counters whose size is fixed; any order gives right results, a good one gives few
candidates. Two matching sets share a word within their first n - ceil(t n) + 1 words. The join has two steps, and
neither writes out pairs:

1. ``promising``: one small row for each class and front word is dealt by word, many in one piece of bytes. Rows of a word that no other row of it could match, by
   size, position, a parity bitmap of the sets, and the word before (two sets that also share that one meet there), go. Words
   so frequent that they could fill a task are dealt in parts, and their rows all stay.
2. ``neighbours``: what stays is joined with its full sets and dealt by word again, large groups in pairs of blocks. A
   task verifies the pairs of sets whose first word in common is the group's, so that each pair counts once, and returns for each class
   how many match it there and the first place of those.

Null or empty text: no lines. Rows of equal id and text keep the same lines. A null id comes first. Columns
other than doc_id and text are ignored, whatever their names; ``remove_lines`` keeps all and drops documents of which no words are left.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import text as tx
from tallyspark.llm.common import NULL_ID, bitmap, cut, maybe_in, packed, table, unpacked

NUMERATOR, DENOMINATOR = 80, 100
LEAST_WORDS = 1
#: The least size of a set that can match a different one: n of n + 1 words.
LEAST_JOINED = -(-NUMERATOR // (DENOMINATOR - NUMERATOR))
#: Counters that words are counted in; of each, the logarithm is broadcast in a byte. They travel in blocks.
COUNTERS, COUNTER_BLOCK = 1 << 20, 1 << 12
#: Words whose counter is over so many, and over SHARE times the mean, are dealt in parts of about so many rows.
FREQUENT, SHARE = 1 << 16, 16
#: The largest size and place that a row of a front word can tell.
FULL = (1 << 14) - 1
#: Rows of a word up to which they are tried against each other in ``promising``; of more, all stay.
TRIED = 1 << 14
#: Sets of a block; one or two blocks are compared within one task.
BLOCK = 1024
#: Rows that are looked at together, pairs likewise, and words of pairs that are verified together.
ROWS, PAIRS, VERIFIED = 1 << 16, 1 << 20, 1 << 22
PLACE = ("id", "is", "number")
#: What a row of a front word has, in numbers of 64 bits; such rows go to 2^BUCKET_BITS buckets by the top of the first, about SENT at a time.
ROW = ("spot", "word", "key", "before", "low", "high")
BUCKET_BITS, SENT = 12, 1 << 18


class Lines:
    """Lines of a run of texts with their distinct words, ordered by line, rarity and hash."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, ranks: np.ndarray | None):
        words = tx.Words(raw, offsets)
        newlines = np.flatnonzero(raw == 10)
        # A line begins at each text and behind each newline; empty texts have one empty line.
        starts = np.sort(np.concatenate([offsets[:-1], newlines + 1]), kind="stable")
        self.owner = np.repeat(np.arange(len(offsets) - 1), 1 + np.searchsorted(newlines, offsets[1:]) - np.searchsorted(newlines, offsets[:-1]))
        head = np.searchsorted(self.owner, np.arange(len(offsets) - 1))
        self.number = np.arange(len(self.owner)) - head[self.owner]
        of_line = np.searchsorted(starts, words.starts, "right") - 1
        self.words = hashes = words.hashes()
        rank = ranks[(hashes % np.uint64(COUNTERS)).astype(np.int64)] if ranks is not None else None
        order = sorted_words(of_line, rank, hashes)
        line, hashes = of_line[order], hashes[order]
        new = np.ones(len(line), bool)
        new[1:] = (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])
        self.line, self.hashes = line[new], hashes[new]
        self.rank = rank[order][new] if ranks is not None else None
        self.first = np.searchsorted(self.line, np.arange(len(self.owner) + 1))
        self.n = np.diff(self.first)
        self.n_lines = np.bincount(self.owner, minlength=len(offsets) - 1)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Two hashes of each line's set, which do not depend on the order of its words."""
        return tuple(tx.mix(tx.sums(tx.mix(self.hashes ^ np.uint64(salt)), self.first)) for salt in (tx.MIX_1, tx.MIX_2))


class Seen:
    """Keys that a task has had, forgotten when there are many."""

    def __init__(self):
        self.keys = self.more = np.zeros(0, np.uint64)

    def new(self, keys: np.ndarray, more: np.ndarray) -> np.ndarray:
        """One row of each key that has not been had."""
        order = np.lexsort((more, keys))
        keys, more = keys[order], more[order]
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (more[1:] != more[:-1])
        if len(self.keys):
            spot = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            first &= (self.keys[spot] != keys) | (self.more[spot] != more)
        keys, more = keys[first], more[first]
        if len(self.keys) < 1 << 20:
            keys, more = np.append(self.keys, keys), np.append(self.more, more)
        by_key = np.argsort(keys, kind="stable")
        self.keys, self.more = keys[by_key], more[by_key]
        return order[first]


def sorted_words(line: np.ndarray, rank: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    """The order of words by line, rank and hash."""
    if len(line) and line[-1] < 1 << 14:
        packed = (line.astype(np.uint64) << np.uint64(50)) | (hashes >> np.uint64(14))
        if rank is not None:
            packed = (line.astype(np.uint64) << np.uint64(50)) | (rank.astype(np.uint64) << np.uint64(42)) | (hashes >> np.uint64(22))
        order = np.argsort(packed)
        alike = np.flatnonzero(packed[order[1:]] == packed[order[:-1]])
        if (hashes[order[alike]] == hashes[order[alike + 1]]).all():
            return order
    return np.lexsort((hashes, np.zeros(len(line), np.uint8) if rank is None else rank, line))


def parity(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set, 128 bits each of which says if an odd number of its words fall there; sets differ in at least as many words as bits."""
    filled = np.flatnonzero(np.diff(first) > 0)
    spot = hashes >> np.uint64(57)
    ones = np.uint64(1) << (spot & np.uint64(63))
    out = np.zeros((2, len(first) - 1), np.uint64)
    for k in range(2) if len(filled) else ():
        out[k, filled] = np.bitwise_xor.reduceat(np.where(spot >> np.uint64(6) == k, ones, np.uint64(0)), first[:-1][filled])
    return out[0], out[1]


def apart(x: tuple[np.ndarray, ...], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bits in which the parities of sets i and j differ."""
    return sum(np.bitwise_count(k[i] ^ k[j]).astype(np.int64) for k in x)


def front(n: np.ndarray) -> np.ndarray:
    """Words among which two matching sets must share one."""
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def common_words(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Words that sets of n and m words must share to match."""
    return -(-NUMERATOR * (n + m) // (NUMERATOR + DENOMINATOR))


def identified(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("is"), "text")


# --- words and classes


def add_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of a task, summed as they come."""
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            total[block] = total.get(block, 0) + np.frombuffer(counts, np.int64)
    yield pa.RecordBatch.from_pydict({"block": pa.array(total, pa.int32()), "counts": pa.array([x.tobytes() for x in total.values()], pa.binary())})


def word_ranks(counted: DataFrame) -> tuple[np.ndarray, int]:
    """The logarithm of each counter, in steps of an eighth of a doubling, and the least one of frequent words. ``COUNTERS`` numbers come to the driver."""
    summed = counted.repartition("block").mapInArrow(add_counts, "block int, counts binary")
    counts = np.zeros(COUNTERS, np.int64)
    for row in summed.toArrow().to_pylist():
        counts[row["block"] * COUNTER_BLOCK :][:COUNTER_BLOCK] = np.frombuffer(row["counts"], np.int64)
    ranks = np.minimum(255, np.floor(8 * np.log2(np.maximum(counts, 1)))).astype(np.uint8)
    return ranks, int(np.ceil(8 * np.log2(max(FREQUENT, SHARE * counts.mean()))))


OCCURRENCES = "id long, is long, number int, key long, more long, block int, counts binary"


def occurrences(least_words: int) -> Callable:
    """A row for each line; and of each task, behind them, its counts of words in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in tx.chunks(batches):
            lines = Lines(*tx.text_bytes(batch.column("text")), None)
            total += np.bincount((lines.words % np.uint64(COUNTERS)).astype(np.int64), minlength=COUNTERS)
            a, b = lines.keys()
            long = np.flatnonzero(lines.n >= max(1, least_words))
            at = pa.array(lines.owner[long])
            found = {"id": batch.column("id").take(at), "is": batch.column("is").take(at), "number": lines.number[long].astype(np.int32), "key": a[long].view(np.int64), "more": b[long].view(np.int64)}
            yield pa.RecordBatch.from_pydict(found | {"block": pa.nulls(len(long), pa.int32()), "counts": pa.nulls(len(long), pa.binary())})
        blocks = total.reshape(-1, COUNTER_BLOCK)
        some = np.flatnonzero(blocks.any(axis=1)).astype(np.int32)
        none = {k: pa.nulls(len(some), pa.int32() if k == "number" else pa.int64()) for k in ("id", "is", "number", "key", "more")}
        yield pa.RecordBatch.from_pydict(none | {"block": some, "counts": pa.array([blocks[k].tobytes() for k in some], pa.binary())})

    return run


# --- step 1: rows of front words that could match another


def fronts(ranks: Callable[[], tuple[np.ndarray, int]], least_words: int) -> Callable:
    """Rows for the front words of each line, once a task for lines with equal sets, but for words that occur once in all texts, which no other line has.

    Rows travel as bytes of numbers, as ``ROW`` names them, many of a bucket (``spot`` of the output) together. Their own ``spot`` has, from the top, 36 bits of a hash that the row is dealt by, then 14 each for the size of the set and the place of the word. A
    size of ``FULL`` stands for all from there on, and for rows of frequent words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        table, frequent = ranks()
        held: list[np.ndarray] = []
        for batch in tx.chunks(batches):
            lines = Lines(*tx.text_bytes(batch.column("text")), table)
            keys, more = lines.keys()
            fit = np.flatnonzero(lines.n >= max(LEAST_JOINED, least_words))
            chosen = fit[seen.new(keys[fit], more[fit])]
            many = front(lines.n[chosen])
            place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            of = np.repeat(chosen, many)
            at = lines.first[of] + place
            again = lines.rank[at] > 0
            of, at, place = of[again], at[again], place[again]
            before = np.where(place > 0, lines.hashes[at - 1], np.uint64(0))
            # A part of about FREQUENT rows of a frequent word; other words have one part.
            often = np.flatnonzero(lines.rank[at] >= frequent)
            parts = (np.exp2((lines.rank[at[often]].astype(np.float64) + 1) / 8) // FREQUENT + 1).astype(np.uint64)
            word = lines.hashes[at]
            dealt = tx.mix(word)
            dealt[often] = tx.mix(word[often] + np.uint64(tx.BASE) * (keys[of[often]] % parts))
            n = np.minimum(lines.n[of], FULL).astype(np.uint64)
            n[often] = FULL
            low, high = (x[of] for x in parity(lines.hashes, lines.first))
            columns = {"spot": (dealt >> np.uint64(28) << np.uint64(28)) | (n << np.uint64(14)) | np.minimum(place, FULL).astype(np.uint64), "word": word, "key": keys[of], "before": before, "low": low, "high": high}
            held.append(np.stack([columns[k] for k in ROW], axis=1))
            if sum(map(len, held)) >= SENT:
                yield from bucketed(np.concatenate(held))
                held = []
        if held:
            yield from bucketed(np.concatenate(held))

    return run


def bucketed(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(spot, rows): the rows of each bucket as bytes."""
    for begin in range(0, len(rows), 8 * SENT):
        some = rows[begin : begin + 8 * SENT]
        some = some[np.argsort(some[:, 0], kind="stable")]
        bucket = (some[:, 0] >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)
        first = np.flatnonzero(np.diff(bucket, prepend=-1))
        offsets = (np.append(first, len(some)) * 8 * len(ROW)).astype(np.int32)
        data = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(some)])
        yield pa.RecordBatch.from_pydict({"spot": bucket[first], "rows": data})


def groups(batches: Iterator[pa.RecordBatch], size: Callable[[pa.RecordBatch], int] = lambda batch: batch.num_rows) -> Iterator[pa.RecordBatch]:
    """Tables of about ``ROWS`` rows, or of one group; batches come sorted by ``spot``, and no group, which is one spot, is parted. ``size``: the rows of a batch."""
    held: list[pa.RecordBatch] = []

    def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += size(batch)
        if rows < ROWS:
            continue
        whole = joined(held)
        spot = whole.column("spot").to_numpy()
        last = spot == spot[-1]
        begin = whole.num_rows - int(np.argmin(last[::-1])) if not last.all() else 0
        if begin:
            yield whole.slice(0, begin)
        held = [whole.slice(begin)]
        # A group that alone fills a table is looked at again when as many more rows have come.
        rows = size(held[0]) if begin else 0
    if held and sum(b.num_rows for b in held):
        yield joined(held)
    tx.give_back()


def close_pairs(group: np.ndarray, n: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j), i < j, of one group and near enough in size, in slabs; rows are sorted by group and n."""
    far = int(n.max()) + 2
    spot = group * far + n
    ends = np.searchsorted(spot, group * far + np.minimum(DENOMINATOR * n // NUMERATOR, far - 1), "right")
    many = ends - np.arange(len(n)) - 1
    total = np.cumsum(many)
    row = 0
    while row < len(n):
        stop = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + PAIRS, "right")))
        some = many[row:stop]
        i = np.repeat(np.arange(row, stop), some)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(some) - some, some)
        if len(i):
            yield i, j
        row = stop


def group_numbers(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.cumsum(new)


def numbers(batch: pa.RecordBatch) -> np.ndarray:
    """The rows that ``bucketed`` made bytes of."""
    data = batch.column("rows")
    offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
    return np.frombuffer(data.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(np.uint64).reshape(-1, len(ROW))


def promising_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, key) of rows that another row of their word could match."""
    for batch in groups(batches, lambda batch: len(numbers(batch))):
        columns = [*np.ascontiguousarray(numbers(batch).T)]
        order = np.lexsort((columns[2], columns[0]))
        columns = [c[order] for c in columns]
        new = np.zeros(len(order), bool)
        new[:1] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        spot, word, key, before, low, high = (c[new] for c in columns)
        n, place = ((spot >> np.uint64(s)).astype(np.int64) & FULL for s in (14, 0))
        group = group_numbers(spot >> np.uint64(28))
        size = np.bincount(group)[group]
        stays = (n == FULL) | (size > TRIED)
        tried = np.flatnonzero(~stays & (size > 1))
        group, n, place, before, low, high = (x[tried] for x in (group, n, place, before, low, high))
        for i, j in close_pairs(group, n) if len(tried) else ():
            common = common_words(n[i], n[j])
            fits = np.minimum(n[i] - place[i], n[j] - place[j]) >= common
            fits &= (before[i] != before[j]) | (place[i] == 0) | (place[j] == 0)
            i, j, common = i[fits], j[fits], common[fits]
            fits = apart((low, high), i, j) <= n[i] + n[j] - 2 * common
            stays[tried[i[fits]]] = True
            stays[tried[j[fits]]] = True
        yield pa.RecordBatch.from_pydict({"word": word[stays].view(np.int64), "key": key[stays].view(np.int64)})


def promising(docs: DataFrame, ranks: Callable[[], tuple[np.ndarray, int]], least_words: int) -> DataFrame:
    rows = docs.select("text").mapInArrow(fronts(ranks, least_words), "spot int, rows binary")
    return rows.repartition("spot").sortWithinPartitions("spot").mapInArrow(promising_rows, "word long, key long")


# --- step 2: full sets, verified


def wanted_sets(ranks: Callable[[], tuple[np.ndarray, int]], wanted: Callable[[], np.ndarray]) -> Callable:
    """(key, more, words) of lines that ``wanted`` may hold, once a task; words in the order of rarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        bits = wanted()
        for batch in tx.chunks(batches):
            lines = Lines(*tx.text_bytes(batch.column("text")), ranks()[0])
            keys, more = lines.keys()
            spot = keys % np.uint64(8 * len(bits))
            fit = np.flatnonzero((lines.n >= LEAST_JOINED) & ((bits[(spot >> np.uint64(3)).astype(np.int64)] >> (spot & np.uint64(7)).astype(np.uint8)) & 1 == 1))
            chosen = fit[seen.new(keys[fit], more[fit])]
            words = pa.array([lines.hashes[lines.first[i] : lines.first[i + 1]].tobytes() for i in chosen], pa.binary())
            yield pa.RecordBatch.from_pydict({"key": keys[chosen].view(np.int64), "more": more[chosen].view(np.int64), "words": words})

    return run


class Sets:
    """Sets of words of a table, with words numbered so that a set and a word make one number."""

    def __init__(self, words: pa.Array):
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        raw = np.frombuffer(words.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        self.hashes = np.frombuffer(raw.tobytes(), np.uint64)
        self.first = (offsets - offsets[0]) // 8
        self.n = np.diff(self.first)
        self.owner = np.repeat(np.arange(len(self.n)), self.n)
        self.place = np.arange(len(self.hashes)) - self.first[self.owner]
        found, self.number = np.unique(self.hashes, return_inverse=True)
        self.distinct = len(found)

    def kept(self, place: np.ndarray) -> np.ndarray:
        """Sorted numbers of (set, word) for the words before ``place`` of each set."""
        some = self.place < place[self.owner]
        return np.sort(self.owner[some] * self.distinct + self.number[some])

    def common(self, x: np.ndarray, y: np.ndarray, place: np.ndarray, numbers: np.ndarray) -> np.ndarray:
        """Of pairs, how many of the words of y before its ``place`` are in x, among ``numbers``."""
        many = place[y]
        at = np.repeat(self.first[y], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        asked = np.repeat(x, many) * self.distinct + self.number[at]
        spot = np.minimum(np.searchsorted(numbers, asked), len(numbers) - 1)
        return tx.sums((numbers[spot] == asked).astype(np.int64) if len(numbers) else np.zeros(len(asked), np.int64), np.append(0, np.cumsum(many)))

    def table(self, rows: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Sets of ``rows`` by the words, before ``place`` of each set, that at least two of them have."""
        some = np.concatenate([np.arange(self.first[r], self.first[r] + place[r]) for r in rows]).astype(np.int64)
        numbers, spot, many = np.unique(self.number[some], return_inverse=True, return_counts=True)
        column = np.cumsum(many > 1) - 1
        shared = many[spot] > 1
        out = np.zeros((len(rows), int((many > 1).sum())), np.float32)
        out[np.searchsorted(rows, self.owner[some[shared]]), column[spot[shared]]] = 1
        return out


def verified(sets: Sets, group: np.ndarray, part: np.ndarray, two: np.ndarray, upto: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Matching pairs (x, y) of rows, sorted by group and size, whose first word in common is the group's.

    ``upto`` is the place of the group's word in each set; where ``two`` is true, only rows of different parts are pairs. Large groups are
    compared as products of tables of words, others pair by pair.
    """
    n = sets.n
    size = np.bincount(group)
    large = size >= 64
    for g in np.flatnonzero(large):
        rows = np.flatnonzero(group == g)
        whole, before = sets.table(rows, n), sets.table(rows, upto)
        for a in range(0, len(rows), 512):
            some = rows[a : a + 512]
            common = whole[a : a + 512] @ whole.T
            linked = (DENOMINATOR + NUMERATOR) * common >= NUMERATOR * (n[some][:, None] + n[rows][None, :])
            linked &= before[a : a + 512] @ before.T == 0
            linked &= rows[None, :] > some[:, None]
            if two[rows[0]]:
                linked &= part[rows][None, :] != part[some][:, None]
            x, y = np.nonzero(linked)
            yield some[x], rows[y]
    small = np.flatnonzero(~large[group])
    if not len(small):
        return
    bits = parity(sets.hashes, sets.first)
    all_, before = sets.kept(n), sets.kept(upto)
    for i, j in close_pairs(group[small], n[small]):
        x, y = small[i], small[j]
        common = common_words(n[x], n[y])
        fits = (~two[x] | (part[x] != part[y])) & (apart(bits, x, y) <= n[x] + n[y] - 2 * common)
        x, y = x[fits], y[fits]
        ends = np.cumsum(n[y])
        row = 0
        while row < len(x):
            stop = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + VERIFIED, "right")))
            a, b = x[row:stop], y[row:stop]
            first = sets.common(a, b, upto, before) == 0
            a, b = a[first], b[first]
            linked = (DENOMINATOR + NUMERATOR) * sets.common(a, b, n, all_) >= NUMERATOR * (n[a] + n[b])
            yield a[linked], b[linked]
            row = stop


def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set of a group: how many sets it matches there, and the first place of those."""
    for batch in groups(batches):
        sets = Sets(batch.column("words"))
        word, i, j, part, key, more = (batch.column(k).to_numpy() for k in ("word", "i", "j", "part", "key", "more"))
        is_word = sets.hashes == word.view(np.uint64)[sets.owner]
        upto = np.full(len(word), -1)
        upto[sets.owner[is_word]] = sets.place[is_word]
        order = np.lexsort((more, key, sets.n, j, i, word))
        new = np.ones(len(order), bool)
        for k, x in enumerate((word, i, j, key, more)):
            new[1:] = (x[order[1:]] != x[order[:-1]]) if not k else new[1:] | (x[order[1:]] != x[order[:-1]])
        # Only a set whose 64-bit key is another's as well lacks the word.
        order = order[new & (upto[order] >= 0)]
        batch = batch.take(pa.array(order))
        if not batch.num_rows:
            continue
        sets = Sets(batch.column("words"))
        word, i, j, part = (x[order] for x in (word, i, j, part))
        place = [batch.column(k).to_numpy() for k in PLACE]
        by_place = np.lexsort(place[::-1])
        rank = np.empty(len(order), np.int64)
        rank[by_place] = np.arange(len(order))
        links, least = np.zeros(len(order), np.int64), np.full(len(order), len(order))
        for x, y in verified(sets, group_numbers(word, i, j), part, i != j, upto[order]):
            links += np.bincount(x, minlength=len(links)) + np.bincount(y, minlength=len(links))
            np.minimum.at(least, x, rank[y])
            np.minimum.at(least, y, rank[x])
        found = np.flatnonzero(links)
        theirs = batch.take(pa.array(by_place[least[found]]))
        yield pa.RecordBatch.from_pydict({"key": batch.column("key").take(pa.array(found)), "more": batch.column("more").take(pa.array(found)), "links": links[found], **{k: theirs.column(k) for k in PLACE}})


def neighbours(docs: DataFrame, rows: DataFrame, ranks: Callable, classes: DataFrame) -> DataFrame:
    """(key, more, links, theirs): how many sets match each set that any does, and the first place of those.

    ``rows`` are the promising ones; ``classes`` has the first place of each of their sets.
    """
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(rows, "key"))
    sets = docs.select("text").mapInArrow(wanted_sets(ranks, lambda: bits.value), "key long, more long, words binary").dropDuplicates(["key", "more"])
    placed = sets.join(classes.select("key", "more", "first"), ["key", "more"])
    large = rows.groupBy("word").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")).filter("parts > 1")
    laid = rows.join(large, "word", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    laid = laid.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    dealt = laid.select("word", "key", "part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("with"))
    dealt = dealt.select("word", "key", "part", F.least("part", "with").alias("i"), F.greatest("part", "with").alias("j"))
    full = dealt.join(placed, "key").select(F.xxhash64("word", "i", "j").alias("spot"), "word", "i", "j", "part", "key", "more", "first.id", "first.is", "first.number", "words")
    found = full.repartition("spot").sortWithinPartitions("spot").mapInArrow(compare, "key long, more long, links long, id long, is long, number int")
    return found.groupBy("key", "more").agg(F.sum("links").alias("links"), F.min(F.struct(*PLACE)).alias("theirs"))


# --- lines to remove


def removed_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, is, numbers, n_links): lines to remove from each document that has any, from 0; and how many other sets its sets match."""
    read = cut(identified(docs).mapInArrow(occurrences(least_words), OCCURRENCES))
    shared = docs.sparkSession.sparkContext.broadcast(word_ranks(read.filter("counts is not null").select("block", "counts")))
    lines = read.filter("counts is null").select(*PLACE, "key", "more")
    ranks = lambda: shared.value
    rows = cut(promising(docs, ranks, least_words))
    place = F.struct(*PLACE)
    classes = lines.groupBy("key", "more").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    # Sets that occur once and that no other could match go no further.
    classes = cut(maybe_in(classes, rows, "key").filter("n > 1 or maybe_").drop("maybe_"))
    bounds = classes.join(neighbours(docs, rows, ranks, classes), ["key", "more"], "left").filter("n > 1 or links is not null")
    bounds = cut(bounds.select("key", "more", F.least("first", F.coalesce("theirs", "first")).alias("bound"), F.coalesce("links", F.lit(0)).alias("links")))
    lines = maybe_in(lines, bounds, "key").filter("maybe_").drop("maybe_")
    later = lines.join(bounds, ["key", "more"]).withColumn("gone", place > F.col("bound"))
    return later.groupBy("id", "is").agg(F.sort_array(F.collect_set(F.when(F.col("gone"), F.col("number")))).alias("numbers"), F.sum("links").alias("n_links"))


def without(text: Column, numbers: Column) -> Column:
    return F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(numbers, i)), "\n")


def remove_lines(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the later matching lines, and without documents that lose all their words that way."""
    gone = cut(removed_lines(docs, least_words).filter(F.size("numbers") > 0).select("id", "is", "numbers"))
    marked = maybe_in(packed(docs), gone, "id", "is")
    asked = marked.filter("maybe_").join(gone, ["id", "is"], "left")
    text = F.col("doc.text")
    asked = asked.withColumn("left", F.when(F.col("numbers").isNull(), text).otherwise(without(text, F.col("numbers"))))
    changed = asked.filter(F.col("numbers").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    return unpacked(marked.filter("not maybe_"), docs.columns).unionByName(unpacked(changed, docs.columns, text=F.col("left")))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed, n_links (matching other sets of its lines) and the removed lines' numbers from 0."""
    docs = table(spark, sf_dir, "documents")
    found = removed_lines(docs, least_words=1)
    n_lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(1 + F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))))
    rows = docs.select("doc_id", F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("is"), n_lines.cast("long").alias("n_lines"))
    joined = rows.join(found, ["id", "is"], "left")
    numbers = F.coalesce("numbers", F.expr("cast(array() as array<int>)"))
    return joined.select(
        "doc_id",
        "n_lines",
        F.size(numbers).cast("long").alias("n_removed"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.array_join(F.transform(numbers, lambda k: k.cast("string")), ",").alias("removed"),
    )


OP6_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(text, '') AS t FROM documents
), split AS (
    SELECT doc_id, string_split(t, chr(10)) AS parts FROM d
), numbered AS (
    SELECT doc_id, k - 1 AS number, regexp_extract_all(translate(parts[k], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS k FROM split)
), lines AS (
    SELECT doc_id, number, array_to_string(list_sort(list_distinct(w)), ' ') AS words FROM numbered WHERE len(w) > 0
), sets AS (
    SELECT words, row_number() OVER (ORDER BY words) AS s, min((doc_id, number)) AS first FROM lines GROUP BY words
), members AS (
    SELECT s, len(string_split(words, ' ')) AS n, unnest(string_split(words, ' ')) AS word FROM sets
), counts AS (
    SELECT word, count(*) AS c FROM members GROUP BY word
), placed AS (
    SELECT s, n, word, row_number() OVER (PARTITION BY s ORDER BY c, word) AS place FROM members JOIN counts USING (word)
), front AS (
    SELECT s, n, word FROM placed WHERE place <= n - (4 * n + 4) // 5 + 1
), candidates AS (
    SELECT DISTINCT x.s AS a, y.s AS b, x.n AS n_a, y.n AS n_b FROM front x JOIN front y ON x.word = y.word AND x.s < y.s AND 5 * x.n >= 4 * y.n AND 5 * y.n >= 4 * x.n
), matched AS (
    SELECT a, b FROM candidates JOIN members x ON x.s = a JOIN members y ON y.s = b AND y.word = x.word
    GROUP BY a, b, n_a, n_b HAVING 100 * count(*) >= 80 * (n_a + n_b - count(*))
), pairs AS (
    SELECT a, b FROM matched UNION ALL SELECT b, a FROM matched
), theirs AS (
    SELECT a AS s, count(*) AS links, min(sets.first) AS first FROM pairs JOIN sets ON sets.s = b GROUP BY a
), bounds AS (
    SELECT words, coalesce(links, 0) AS links, least(sets.first, coalesce(theirs.first, sets.first)) AS bound FROM sets LEFT JOIN theirs USING (s)
), found AS (
    SELECT doc_id, sum(links) AS n_links, count(*) FILTER (WHERE (doc_id, number) > bound) AS n_removed,
           string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) FILTER (WHERE (doc_id, number) > bound) AS removed
    FROM lines JOIN bounds USING (words) GROUP BY doc_id
)
SELECT doc_id, CAST(CASE WHEN t = '' THEN 0 ELSE 1 + len(t) - len(replace(t, chr(10), '')) END AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, coalesce(removed, '') AS removed
FROM d LEFT JOIN found USING (doc_id)
"""
