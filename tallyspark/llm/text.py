"""Vectorised access to the text of an Arrow batch.

Texts are read from the Arrow buffer as one byte array with document offsets, so that splitting
into words and hashing them costs a few numpy passes a byte and no Python object a word.
UTF-8 never uses ASCII bytes inside a longer character, so ASCII separators can be found on bytes.
"""

from __future__ import annotations

import contextlib
import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
#: Odd multipliers of the 64-bit hashes.
BASE = 0x9E3779B97F4A7C15
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

#: Bytes that part words where a word is ``[^\x20\x09-\x0D]+``.
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: The first bytes of eight, by how many.
HEAD = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)
#: Bytes of a word that are hashed along with other words'; the rest of longer ones is hashed word by word.
LONG_WORD = 64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all bits depend on all others (splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_2)
    return h ^ (h >> np.uint64(31))


#: What one operator remembers in a worker; it goes when the worker reads texts for another.
KEPT: list[dict] = []


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds one row, or at most ``size`` bytes of text. Unless ``keep``, what is ``KEPT`` is forgotten first."""
    if not keep and any(KEPT):
        for held in KEPT:
            held.clear()
        give_back()
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(batch.column(text).fill_null("")).to_numpy(zero_copy_only=False))
        row = 0
        while row < batch.num_rows:
            used = ends[row - 1] if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, used + size, "right")))
            yield batch.slice(row, stop - row)
            row = stop
    give_back()


def give_back() -> None:
    """Return memory that is free again to the system; a worker lives on after its task and may wait beside others."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after another, and the n + 1 offsets of the texts; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE ** i`` and its inverse modulo 2^64, for i < n."""
    if len(_powers[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


class Words:
    """Words of a run of texts: byte spans, and the range of words that belongs to each text."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACES):
        self.raw, self.offsets = raw, offsets
        inside = (raw != 0x20) & (raw - np.uint8(9) > 4) if separators is SPACES else ~separators[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before = np.empty(len(raw), bool)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty(len(raw), bool)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.inside = inside
        #: word i belongs to text d if first[d] <= i < first[d + 1]
        self.first = np.searchsorted(self.starts, offsets)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word, with A-Z lower-cased unless ``lower`` is false."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        data = np.zeros(len(self.raw) + 8, np.uint8)
        data[:-8] = self.raw
        if lower:
            data[:-8] += (self.raw - np.uint8(65) < 26).view(np.uint8) << np.uint8(5)
        # Eight bytes from each place; of those at a word's begin, what is behind its end is masked.
        eight = np.ndarray(len(self.raw) + 1, "<u8", data, strides=(1,))
        size = self.ends - self.starts
        out = mix((eight[self.starts] & HEAD[np.minimum(size, 8)]) + size.astype(np.uint64) * np.uint64(BASE))
        at = np.flatnonzero(size > 8)
        done = 8
        while len(at) and done < LONG_WORD:
            out[at] = mix(out[at] * np.uint64(BASE) ^ (eight[self.starts[at] + done] & HEAD[np.minimum(size[at] - done, 8)]))
            done += 8
            at = at[size[at] > done]
        for i in at:
            rest = hashlib.blake2b(data[self.starts[i] + done : self.ends[i]].tobytes(), digest_size=8).digest()
            out[i] ^= np.frombuffer(rest, np.uint64)[0]
        return out

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), np.diff(self.first))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of ``values[first[i]:first[i + 1]]``; empty ranges give 0."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind in "fiu" and values.dtype.itemsize == 8 else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words, by its first word; runs cross texts, callers mask them."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * np.uint64(BASE) + hashes[k : k + n]
    return mix(total ^ np.uint64(size))


def code_points(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, and the offsets of the texts among them."""
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=heads[1:])
    return points, heads[offsets]


#: Characters below this have their own entry in the tables of case and kind.
TABLED = 0x20000
#: Those from TABLED to here are ideographs; beyond are tags and private signs.
IDEOGRAPHS = 0x40000
_kinds: list[np.ndarray] = []


def kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code point below ``TABLED``: the lower-case code point, is it a letter, is it a letter or digit."""
    if not _kinds:
        chars = [chr(i) for i in range(TABLED)]
        lowered = [c.lower() for c in chars]
        _kinds.append(np.array([ord(x) if len(x) == 1 else i for i, x in enumerate(lowered)], np.uint32))
        _kinds.append(np.array([c.isalpha() for c in chars]))
        _kinds.append(np.array([c.isalnum() for c in chars]))
    return tuple(_kinds)


def letters(points: np.ndarray) -> np.ndarray:
    """Lower-cased code points where they are letters (ideographs beyond the tables are, tags and private signs are not), else 0."""
    lower, letter, _ = kinds()
    low = np.minimum(points, TABLED - 1)
    far = points >= TABLED
    return np.where(far, np.where(points < IDEOGRAPHS, points, 0), np.where(letter[low], lower[low], 0)).astype(np.uint32)
