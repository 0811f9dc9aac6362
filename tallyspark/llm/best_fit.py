"""Best-fit packing of tokenised documents into as few sequences of at most ``capacity`` tokens as it can.

Large-item matching: no sequence holds more than two pieces of over a third of the capacity, so these are matched first: from the
longest on, each takes the longest other that still fits beside it. Smaller pieces then go, from the longest on, where the least
room is left over, and open a sequence where none has room.

Only lengths matter to packing, so tokens stay where they are made: a first pass reads the texts and keeps a short row
for each piece (place, length, checksum), and these are dealt by a hash into lots of about ``LOT``. Each lot is matched on its own,
and leaves one or two sequences half filled. The hash is of the place where a piece was made, so copies and hot documents spread.

A document's ids are its token ids and one ``END``. One of more than ``capacity`` ids is cut into pieces of ``capacity``,
of which only the first may be shorter; others are one piece. Null or empty text: the single id ``END``. Repeated rows are packed each
for itself. Sequence ids: the lot and a counter, below zero for pieces that fill a sequence alone; the same on each run over
the same written pieces. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm import text as tx
from tallyspark.llm.common import cut, table

CAPACITY = 2048
#: Documents' last id.
END = 0
#: Pieces that are matched together, about.
LOT = 16384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, spot long"
PACKED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
SPOT_BITS, COUNTER_BITS = 33, 32

class ByteTokenizer:
    """Ids of texts, as little-endian 32-bit bytes.

    ``tiktoken`` encodes with the same vocabulary in the form of ranks several times as fast as ``tokenizers``, which takes
    texts that hold the name of a special token, or white space too long for the other's pattern.
    """

    def __init__(self, path: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer as Public

        self.public = Public.from_file(path)
        self.special = [x.content for x in self.public.get_added_tokens_decoder().values()]
        with open(ranks, "rb") as lines:
            found = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=found, special_tokens={})

    def ids(self, text: str) -> bytes:
        if not any(x in text for x in self.special):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()
            except ValueError:  # its regular expressions ran out of stack
                pass
        return np.array(self.public.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


_tokenizers: dict[str, ByteTokenizer] = {}
tx.KEPT.append(_tokenizers)


def pieces_of(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row a piece; ``spot`` is where it was made, and no other piece has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _tokenizers:
            _tokenizers[vocabulary] = ByteTokenizer(vocabulary, ranks, pattern)
        tokenizer = _tokenizers[vocabulary]
        last = np.array([end], "<u4").tobytes()
        spot = TaskContext.get().partitionId() << SPOT_BITS
        for batch in tx.chunks(batches, keep=True):
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = tokenizer.ids(text or "") + last
                total = len(ids) // 4
                edges = [0, *range(total % capacity or min(total, capacity), total + 1, capacity)]
                for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                    rows.append((doc_id, piece, a, b - a, zlib.crc32(ids[4 * a : 4 * b]), spot))
                    spot += 1
            yield batch_of(rows, PIECES)

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_pydict({name: pa.array(c, pa.int32() if kind == "int" else pa.int64()) for (name, kind), c in zip(fields, columns, strict=True)})


def matched(lengths: list[int], capacity: int = CAPACITY) -> list[list[int]]:
    """Sequences, as lists of places in ``lengths``, which go down."""
    large = [i for i, n in enumerate(lengths) if 3 * n > capacity]
    waiting: dict[int, list[int]] = {}  # by length, in reverse, so that the first is taken first
    for i in reversed(large):
        waiting.setdefault(lengths[i], []).append(i)
    held = sum(1 << n for n in waiting)  # bit n: one of length n waits

    def take(n: int) -> int:
        nonlocal held
        i = waiting[n].pop()
        if not waiting[n]:
            held &= ~(1 << n)
        return i

    bins: list[list[int]] = []
    room: dict[int, list[int]] = {}  # by tokens that are left, the sequences
    free = 0  # bit n: a sequence has room for n

    def put(b: int, left: int) -> None:
        nonlocal free
        if left:
            room.setdefault(left, []).append(b)
            free |= 1 << left

    while held:
        n = held.bit_length() - 1
        mine = [take(n)]
        fitting = held & ((1 << (capacity - n + 1)) - 1)
        if fitting:
            m = fitting.bit_length() - 1
            mine.append(take(m))
            n += m
        put(len(bins), capacity - n)
        bins.append(mine)
    for i in range(len(large), len(lengths)):
        n = lengths[i]
        fitting = free >> n
        if fitting:
            left = n + (fitting & -fitting).bit_length() - 1
            b = room[left].pop()
            if not room[left]:
                free &= ~(1 << left)
            bins[b].append(i)
            put(b, left - n)
        else:
            put(len(bins), capacity - n)
            bins.append([i])
    return bins


def pack(docs: DataFrame, vocabulary: str, ranks: str, pattern: str, capacity: int = CAPACITY, end: int = END, lot: int = LOT) -> DataFrame:
    """One row a piece: where it lies in its document and in its sequence.

    ``vocabulary`` and ``ranks`` (the same vocabulary for ``tokenizers`` and ``tiktoken``) must be at those paths on every machine.
    """

    def match(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("spot", "ascending")])
        lengths = group.column("length").to_pylist()
        place, sequence, offset = [], [], []
        for number, mine in enumerate(matched(lengths, capacity)):
            at = 0
            for i in mine:
                place.append(i)
                sequence.append((key[0].as_py() << COUNTER_BITS) + number)
                offset.append(at)
                at += lengths[i]
        kept = group.select(["doc_id", "piece", "start", "length", "ids_crc32"]).take(pa.array(place, pa.int64()))
        return kept.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    pieces = cut(pieces_of(docs, vocabulary, ranks, pattern, capacity, end))
    shorter = pieces.filter(F.col("length") < capacity)
    lots = max(1, -(-shorter.count() // lot))
    dealt = shorter.withColumn("lot", F.pmod(F.xxhash64("spot"), F.lit(lots)))
    whole = pieces.filter(F.col("length") == capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("spot")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return dealt.groupBy("lot").applyInArrow(match, PACKED).unionByName(whole)


def op12_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    return pack(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
