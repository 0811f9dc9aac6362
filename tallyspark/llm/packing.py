"""Harmonic packing of tokenised documents into sequences of at most ``capacity`` tokens.

Class k of the capacity C takes pieces of C / k tokens, rounded down, and fills each of its sequences
with exactly k of them. A document is cut into whole sequences and then, greedily, into the longest
piece of a class that fits its rest; what is left below C / LAST_CLASS tokens goes to the last class,
which is filled piece after piece. Each task packs the documents that it reads on its own, so nothing
is shuffled and no worker waits for another. Sequences that a task can't fill are laid one after another
and cut anew; its one remaining sequence is parted into powers of two, which need no padding.

A document's ids are its token ids and one ``END``. Every id lies in exactly one piece. Null or empty
text: the single id ``END``. Repeated rows are packed each for itself. Sequence ids are the task's partition
number in the upper bits and a counter below, so a task that runs again gives the same ids.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tallyspark.llm import text as tx
from tallyspark.llm.common import table

CAPACITY = 4096
#: Documents' last id.
END = 2
#: Pieces shorter than capacity / LAST_CLASS are not classed.
LAST_CLASS = 64
#: Distinct words whose ids a worker remembers at most, about; a new one takes the place of another.
REMEMBERED = 1 << 20
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Below a task's partition number: sequences that it may make; numbers up to 2^31 fit above.
COUNTER_BITS = 32


#: ASCII signs but the apostrophe; the tokenizer parts a word at those behind a letter or digit.
SIGNS = np.array([0x21 <= x < 0x7F and x != 0x27 and not chr(x).isalnum() for x in range(256)])
ALNUM = np.array([x < 0x80 and chr(x).isalnum() for x in range(256)])
LETTER = np.array([x < 0x80 and chr(x).isalpha() for x in range(256)])
SMALL = frozenset(b"abcdefghijklmnopqrstuvwxyz")
#: How the tokenizer's model writes bytes: printable ones as the character of that number, the others, in order, from 256 on.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARACTERS = dict(zip(sorted(set(range(256)) - set(PRINTABLE)), range(256, 512), strict=False))
#: Bytes of a word up to which it is encoded along with others.
LONGEST = 256
#: Ids that are stored before all are forgotten, for each place of a word.
STORED = 4
#: What the vocabulary's tokens that end a word end in.
WORD_END = "</w>"


def modelled(word: bytes) -> str | None:
    """A lower-case word of letters alone, null for any other."""
    if word.isalpha():  # bytes: ASCII letters alone
        return word.decode()
    if word.isascii():
        return None
    text = word.decode("utf-8", "replace")
    return text if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text) else None


class Letters:
    """Ids of words that ``modelled`` lets pass and that end in a-z, many in one call.

    The vocabulary's merges stand in the order of their ids, so ``tiktoken`` takes the ids as ranks, and gives the same. A token that ends a word
    has its last letter as a capital, which is in no such word: so words lie one after another in one text, and each end tells.
    """

    def __init__(self, vocabulary: dict[str, int]):
        import tiktoken

        raw = {chr(c): b for b, c in BYTE_CHARACTERS.items()} | {chr(b): b for b in PRINTABLE}
        ranks = {}
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, rank in vocabulary.items():
            stem = token.removesuffix(WORD_END)
            if not stem or any(c not in raw for c in stem) or any("A" <= c <= "Z" for c in stem):
                continue
            data = bytes(raw[c] for c in stem)
            if stem == token:
                ranks[data] = rank
            elif data[-1] in SMALL:
                ranks[data[:-1] + data[-1:].upper()] = rank
                self.last[rank] = True
        self.fast = tiktoken.Encoding("letters", pat_str="[^A-Z]*[A-Z]", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words that are written so, and how many each has."""
        ids = self.fast.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)
        return ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)


def spread(first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...``, ``many[i]`` of them, for each i."""
    return np.repeat(first - (np.cumsum(many) - many), many) + np.arange(many.sum())


class Tokenizer:
    """Ids of texts, as little-endian 32-bit bytes.

    The tokenizer drops white space, lower-cases and never joins what it parts, so a text's ids are its
    words' ids one after another. Signs at a word's end count as a word of their own where the tokenizer parts them too. A word is known by 63 bits
    of a hash; its ids are remembered in a table with one place a hash, where the latest stays, so nothing is gone through to find or add some. Words of
    ASCII letters pass the tokenizer's first steps unchanged but for case and need its merges only.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Public

        self.public = Public.from_file(path)
        self.special = os.path.commonprefix([x.content for x in self.public.get_added_tokens_decoder().values()]).encode()
        self.model = self.public.model
        self.letters = Letters(self.public.get_vocab(with_added_tokens=False))
        self.remembered = REMEMBERED

    @property
    def remembered(self) -> int:
        return len(self.keys)

    @remembered.setter
    def remembered(self, most: int) -> None:
        places = 1 << max(0, most - 1).bit_length()
        if places != len(getattr(self, "keys", ())):
            self.keys, self.many, self.first = np.zeros(places, np.uint64), np.zeros(places, np.int64), np.zeros(places, np.int64)
            self.store, self.filled = np.zeros(0, np.uint32), 0

    def keep(self, ids: np.ndarray) -> int:
        """Where ``ids`` begin in the store."""
        begin, self.filled = self.filled, self.filled + len(ids)
        if self.filled > len(self.store):
            self.store = np.concatenate([self.store, np.zeros(self.filled, np.uint32)])
        self.store[begin : self.filled] = ids
        return begin

    def words(self, raw: np.ndarray, offsets: np.ndarray) -> tx.Words:
        """Words of texts, with signs at an end parted where the tokenizer parts them."""
        words = tx.Words(raw, offsets)
        starts, ends = words.starts, words.ends
        if not len(starts):
            return words
        stem = np.maximum.accumulate(np.where(SIGNS[raw], 0, np.arange(1, len(raw) + 1)))[ends - 1]
        last, before = raw[np.maximum(stem - 1, 0)], raw[np.maximum(stem - 2, 0)]
        # Letters of Latin-1 and Latin Extended-A; not the two signs there, and not the one that gets a mark in lower case.
        latin = (before == 0xC3) & (last != 0x97) & (last != 0xB7) | (before == 0xC4) & (last != 0xB0) | (before == 0xC5)
        parted = (stem > starts) & (stem < ends) & (ALNUM[last] | (last >= 0x80) & latin)
        if self.odd(raw):
            special = np.zeros(len(raw) + 1, np.int64)
            hit = (raw[:-1] == self.special[0]) & (raw[1:] == self.special[1])
            np.cumsum(np.append(hit, False), out=special[1:])
            parted &= special[ends] == special[starts]
        here = np.flatnonzero(parted)
        words.starts = np.insert(starts, here + 1, stem[here])
        words.ends = np.insert(ends, here, stem[here])
        words.first = np.searchsorted(words.starts, offsets)
        return words

    def odd(self, raw: np.ndarray) -> bool:
        """May the texts hold the name of a special token, which the tokenizer looks for in the text as it stands?"""
        return self.special[:2] in raw.tobytes()

    def encode(self, words: list[bytes]) -> list[list[int] | np.ndarray]:
        out: list = [None] * len(words)
        fast, rest = [], []
        for i, w in enumerate(words):
            low = w.lower()  # bytes: A-Z alone
            if (text := modelled(low)) is None:
                rest.append(i)
            elif low[-1] in SMALL and len(low) <= LONGEST:
                fast.append((i, text[:-1] + text[-1].upper()))
            else:
                out[i] = [x.id for x in self.model.tokenize(low.decode("latin-1").translate(BYTE_CHARACTERS))]
        if fast:
            ids, many = self.letters.encode("".join([text for _, text in fast]))
            for (i, _), mine in zip(fast, np.split(ids, np.cumsum(many)[:-1]), strict=True):
                out[i] = mine
        found = self.public.encode_batch_fast([words[i].decode("utf-8", "replace") for i in rest], add_special_tokens=False) if rest else []
        for i, x in zip(rest, found, strict=True):
            out[i] = x.ids
        return out

    def learn(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Store the ids of words: where they begin, and how many each has."""
        first, many = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        letters = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(LETTER[raw], out=letters[1:])
        size = ends - starts
        plain = (letters[ends] - letters[starts] == size) & (size <= LONGEST)
        some = np.flatnonzero(plain)
        if len(some):
            text = raw[spread(starts[some], size[some])] | np.uint8(0x20)
            text[np.cumsum(size[some]) - 1] ^= 0x20
            ids, many[some] = self.letters.encode(text.tobytes().decode())
            first[some] = self.keep(ids) + np.cumsum(many[some]) - many[some]
        others = np.flatnonzero(~plain)
        if len(others):
            found = self.encode([raw[a:b].tobytes() for a, b in zip(starts[others].tolist(), ends[others].tolist(), strict=True)])
            many[others] = [len(x) for x in found]
            first[others] = self.keep(np.concatenate(found).astype(np.uint32)) + np.cumsum(many[others]) - many[others]
        return first, many

    def ids(self, texts: list[bytes]) -> list[bytes]:
        raw = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.append(0, np.cumsum([len(t) for t in texts])).astype(np.int64)
        words = self.words(raw, offsets)
        # Names of special tokens are other words in other case; texts without any never meet them.
        hashes = words.hashes(lower=not self.odd(raw)) | np.uint64(1)
        place = (hashes >> np.uint64(1)).astype(np.int64) & (len(self.keys) - 1)
        first, many = self.first[place], self.many[place]
        new = np.flatnonzero(self.keys[place] != hashes)
        if len(new):
            found, one, of = np.unique(hashes[new], return_index=True, return_inverse=True)
            one = new[one]
            begin, n = self.learn(raw, words.starts[one], words.ends[one])
            first[new], many[new] = begin[of], n[of]
            at = place[one]
            at, own = np.unique(at, return_index=True)  # of several words for one place one stays
            self.keys[at], self.first[at], self.many[at] = found[own], begin[own], n[own]
        ids = self.store[spread(first, many)].astype("<u4", copy=False).tobytes()
        if self.filled > STORED * len(self.keys):
            self.keys[:], self.filled, self.store = 0, 0, np.zeros(0, np.uint32)
        cuts = (4 * np.append(0, np.cumsum(many))[words.first]).tolist()
        return [ids[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


_tokenizers: dict[str, Tokenizer] = {}


def tokenizer(path: str) -> Tokenizer:
    """The worker's tokenizer for a vocabulary file. It goes, with its words, when the worker turns to another operator."""
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer(path)
    return _tokenizers[path]


tx.KEPT.append(_tokenizers)


class Packer:
    """Packs documents one after another; holds what its open sequences hold."""

    def __init__(self, prefix: int, capacity: int = CAPACITY, last_class: int = LAST_CLASS):
        self.capacity, self.last_class = capacity, last_class
        self.next = prefix << COUNTER_BITS
        self.open: dict[int, list] = {}  # by class: pieces of its open sequence
        self.short: list = []
        self.short_tokens = 0
        self.rows: list[tuple] = []

    def close(self, pieces: list) -> None:
        offset = 0
        for doc_id, total, start, ids in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, zlib.crc32(ids), total, self.next, offset))
            offset += n
        self.next += 1

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total = len(ids) // 4
        start = 0
        while start < total:
            rest = total - start
            k = max(1, -(-self.capacity // rest))
            n = self.capacity // k
            if k > self.last_class:
                self.add_short((doc_id, total, start, ids[4 * start :]), rest)
                return
            piece = (doc_id, total, start, ids[4 * start : 4 * (start + n)])
            if k == 1:
                self.close([piece])
            else:
                mine = self.open.setdefault(k, [])
                mine.append(piece)
                if len(mine) == k:
                    self.close(self.open.pop(k))
            start += n

    def add_short(self, piece: tuple, n: int) -> None:
        if self.short_tokens + n > self.capacity:
            self.close(self.short)
            self.short, self.short_tokens = [], 0
        self.short.append(piece)
        self.short_tokens += n

    def finish(self) -> None:
        """Lay all open sequences one after another, cut them at the capacity, and the last at powers of two."""
        left = [p for k in sorted(self.open) for p in self.open[k]] + self.short
        total = sum(len(p[3]) // 4 for p in left)
        sizes = [self.capacity] * (total // self.capacity)
        sizes += [1 << b for b in range(total.bit_length() - 1, -1, -1) if (total % self.capacity) >> b & 1]
        i = cut = 0
        for size in sizes:
            mine = []
            while size:
                doc_id, of, start, ids = left[i]
                n = min(size, len(ids) // 4 - cut)
                mine.append((doc_id, of, start + cut, ids[4 * cut : 4 * (cut + n)]))
                size, cut = size - n, cut + n
                if 4 * cut == len(ids):
                    i, cut = i + 1, 0
            self.close(mine)
        self.open, self.short, self.short_tokens = {}, [], 0

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [()] * 7
        self.rows = []
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in zip(names, columns, strict=True)})


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, last_class: int = LAST_CLASS, end: int = END, remembered: int = REMEMBERED) -> DataFrame:
    """One row a piece: where it lies in its document and in its sequence. ``vocabulary`` must be at that path on every machine.

    ``remembered``: distinct words whose ids a worker holds (about 40 bytes each); fewer cost time, not results.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), capacity, last_class)
        last = np.array([end], "<u4").tobytes()
        words = tokenizer(vocabulary)
        words.remembered = remembered
        for batch in tx.chunks(batches, keep=True):
            texts = batch.column("text").cast(pa.large_binary()).fill_null(b"").to_pylist()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.ids(texts), strict=True):
                packer.add(doc_id, ids + last)
            yield packer.take()
        packer.finish()
        yield packer.take()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
