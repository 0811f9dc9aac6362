"""Subword lattices: the probability of a word as a sum over all its segmentations into vocabulary pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from tallyspark.llm import text as tx

#: Stands before a word, as in the vocabulary's pieces.
MARK = 0x2581
BITS = 21
#: Cells (words times positions) that are worked on at once.
CELLS = 1 << 18
NEVER = -np.inf


def read_vocabulary(path: str) -> tuple[list[str], np.ndarray]:
    """Pieces of a sentencepiece file (without control and byte pieces) and their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    kept = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return [model.id_to_piece(i) for i in kept], np.array([model.get_score(i) for i in kept])


def start_probabilities(scores: np.ndarray) -> np.ndarray:
    """Shares by rank of the score (Zipf), since the scores of a merge-based vocabulary are ranks themselves."""
    rank = np.argsort(np.argsort(-scores, kind="stable"), kind="stable")
    weight = 1.0 / (rank + 10.0)
    return weight / weight.sum()


class Lattice:
    """Forward and backward recursions, in log space, over many words at a time.

    A word's arcs are the pieces found in it, followed from each position only as far as some piece goes on.
    Piece ``n`` (one beyond the vocabulary) stands for a byte of a character that has no piece of its own.
    """

    def __init__(self, pieces: list[str]):
        self.n = len(pieces)
        self.longest = max(map(len, pieces))
        number = {p: i for i, p in enumerate(pieces)}
        prefixes = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)})
        self.piece = np.array([number.get(p, -1) for p in prefixes], np.int64)
        self.keys = np.array([int(tx.mix(np.array([self.hash(p)], np.uint64) + np.uint64(len(p)))[0]) for p in prefixes], np.uint64)
        slots = self.slots(self.keys)
        self.heads = np.full(1 << BITS, -1, np.int32)
        self.after = np.full(len(prefixes), -1, np.int32)
        for i, slot in enumerate(slots.tolist()):  # prefixes that share a slot are chained
            self.after[i], self.heads[slot] = self.heads[slot], i

    @staticmethod
    def hash(text: str) -> np.uint64:
        points = np.array([ord(c) for c in text], np.uint64)
        return np.sum(points * tx.powers(len(points))[0], dtype=np.uint64)

    @staticmethod
    def slots(keys: np.ndarray) -> np.ndarray:
        return (keys >> np.uint64(64 - BITS)).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are prefixes of pieces, and those prefixes."""
        found = self.heads[self.slots(keys)]
        at = np.flatnonzero(found >= 0)
        node = found[at]
        while True:
            wrong = np.flatnonzero((node >= 0) & (self.keys[node] != keys[at]))
            if not len(wrong):
                break
            node[wrong] = self.after[node[wrong]]
        return at[node >= 0], node[node >= 0]

    def runs(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, points, lengths): words of similar length as a matrix of code points with the mark in front."""
        lengths = np.array([len(w) + 1 for w in words])
        order = np.argsort(lengths, kind="stable")
        a = 0
        while a < len(order):
            b = min(len(order), a + max(1, CELLS // int(lengths[order[a]])))
            while b - a > 1 and (b - a) * int(lengths[order[b - 1]]) > 2 * CELLS:
                b = a + max(1, (b - a) // 2)
            rows = order[a:b]
            width = int(lengths[rows[-1]])
            flat = np.frombuffer("".join(words[i].ljust(width - 1, "\0") for i in rows).encode("utf-32-le", "surrogatepass"), np.uint32)
            points = np.full((len(rows), width), MARK, np.uint64)
            points[:, 1:] = flat.reshape(len(rows), width - 1)
            yield rows, points, lengths[rows]
            a = b

    def arcs(self, points: np.ndarray, lengths: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, ...]:
        """Row, start, end, piece (``n`` for bytes), how many bytes, and cost of all arcs."""
        width = points.shape[1]
        flat = points.ravel()
        spot = np.flatnonzero((np.arange(width) < lengths[:, None]).ravel())  # where an arc may start
        room = np.repeat(lengths, lengths) - spot % width
        base = tx.powers(self.longest)[0]
        key = np.zeros(len(spot), np.uint64)
        known = np.zeros(len(flat), bool)
        parts = []
        for size in range(1, self.longest + 1):
            fits = room >= size
            spot, room, key = spot[fits], room[fits], key[fits]
            if not len(spot):
                break
            key = key + flat[spot + size - 1] * base[size - 1]
            at, node = self.find(tx.mix(key + np.uint64(size)))
            if size == 1:
                everywhere = spot
            spot, room, key = spot[at], room[at], key[at]
            piece = self.piece[node]
            whole = piece >= 0
            if size == 1:
                known[spot[whole]] = True
            parts.append((spot[whole], np.full(whole.sum(), size), piece[whole]))
        bare = everywhere[~known[everywhere]]
        code = flat[bare]
        n_bytes = 1 + (code >= 0x80).astype(np.int64) + (code >= 0x800) + (code >= 0x10000)
        spot, size, piece = (np.concatenate([p[k] for p in parts] + [x]) for k, x in ((0, bare), (1, np.ones(len(bare), np.int64)), (2, np.full(len(bare), self.n))))
        n_bytes = np.concatenate([np.ones(len(spot) - len(bare), np.int64), n_bytes])
        start = spot % width
        return spot // width, start, start + size, piece, n_bytes, log_p[piece] * n_bytes

    @staticmethod
    def sweep(known: np.ndarray, row: np.ndarray, source: np.ndarray, target: np.ndarray, cost: np.ndarray, steps: range) -> None:
        """Fill ``known[:, target]`` step by step with the log of the sum over arcs of exp(known[:, source] + cost)."""
        order = np.lexsort((row, target))
        row, source, target, cost = row[order], source[order], target[order], cost[order]
        bounds = np.searchsorted(target, np.arange(known.shape[1] + 1))
        for j in steps:
            a, b = bounds[j], bounds[j + 1]
            if a == b:
                continue
            rows, value = row[a:b], known[row[a:b], source[a:b]] + cost[a:b]
            first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            top = np.maximum.reduceat(value, first)
            shift = np.where(np.isfinite(top), top, 0.0)
            with np.errstate(divide="ignore"):
                known[rows[first], j] = shift + np.log(np.add.reduceat(np.exp(value - np.repeat(shift, np.diff(np.append(first, len(rows))))), first))

    def alpha(self, shape: tuple[int, int], arcs: tuple[np.ndarray, ...]) -> np.ndarray:
        out = np.full((shape[0], shape[1] + 1), NEVER)
        out[:, 0] = 0.0
        self.sweep(out, arcs[0], arcs[1], arcs[2], arcs[5], range(1, shape[1] + 1))
        return out

    def beta(self, shape: tuple[int, int], lengths: np.ndarray, arcs: tuple[np.ndarray, ...]) -> np.ndarray:
        out = np.full((shape[0], shape[1] + 1), NEVER)
        out[np.arange(shape[0]), lengths] = 0.0
        self.sweep(out, arcs[0], arcs[2], arcs[1], arcs[5], range(shape[1] - 1, -1, -1))
        return out

    def forward(self, words: list[str], log_p: np.ndarray) -> np.ndarray:
        """Natural log of each word's probability over all its segmentations."""
        out = np.zeros(len(words))
        for rows, points, lengths in self.runs(words):
            out[rows] = self.alpha(points.shape, self.arcs(points, lengths, log_p))[np.arange(len(rows)), lengths]
        return out

    def expected(self, words: list[str], counts: np.ndarray, log_p: np.ndarray) -> np.ndarray:
        """How often each piece (and byte) is expected to be used in the words, each taken ``counts`` times."""
        return self.expectation(words, counts, log_p)[0]

    def expectation(self, words: list[str], counts: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, float]:
        """What ``expected`` gives, and the log of the words' probability."""
        total, likelihood = np.zeros(self.n + 1), 0.0
        for rows, points, lengths in self.runs(words):
            arcs = self.arcs(points, lengths, log_p)
            a, b = self.alpha(points.shape, arcs), self.beta(points.shape, lengths, arcs)
            row, start, end, piece, n_bytes, cost = arcs
            whole = a[np.arange(len(rows)), lengths]
            share = np.exp(a[row, start] + cost + b[row, end] - whole[row]) * counts[rows][row] * n_bytes
            total += np.bincount(piece, share, self.n + 1)
            likelihood += float(whole @ counts[rows])
        return total, likelihood
