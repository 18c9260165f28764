"""Words as lattices of pieces of a fixed public vocabulary; sums over all their segmentations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from .bpe import read_ranks

#: Cells (words x places x lengths) that are looked up at a time.
CELLS = 1_500_000
_BASE, _MIX = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)


def tiktoken_pieces(path: str) -> list[bytes]:
    """Tokens of a rank file; all single bytes are among them."""
    return sorted(read_ranks(path))


def sentencepiece_pieces(path: str, longest: int) -> list[bytes]:
    """Pieces of a sentencepiece model as bytes, with a space where words begin, and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    own = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            own.add(model.id_to_piece(i).replace("▁", " ").encode())
    return sorted(p for p in own if 0 < len(p) <= longest)


class Lattice:
    """Finds the pieces within words; pieces are known by their place in the list."""

    def __init__(self, pieces: list[bytes]):
        self.size, self.longest = len(pieces), max(map(len, pieces))
        keys = np.zeros(len(pieces), np.uint64)
        for i, p in enumerate(pieces):
            h = 0
            for b in p:
                h = (h * int(_BASE) + b + 1) & 0xFFFFFFFFFFFFFFFF
            keys[i] = h
        if len(np.unique(keys)) < len(keys):
            raise ValueError("two pieces have the same hash")
        bits = int(np.ceil(np.log2(len(pieces)))) + 3
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, at, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(left):
            self.probes += 1
            free = self.values[at] < 0
            slots, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.keys[slots], self.values[slots] = keys[left[won]], left[won]
            stay = np.ones(len(left), bool)
            stay[won] = False
            left, at = left[stay], (at[stay] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * _MIX) >> self.shift).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        got = self.values[at]
        same = self.keys[at] == keys
        out = np.where(same, got, -1)
        todo = np.flatnonzero(~same & (got >= 0))
        at = at[todo]
        for _ in range(1, self.probes):
            if not len(todo):
                break
            at = (at + 1) & self.mask
            got, same = self.values[at], self.keys[at] == keys[todo]
            out[todo[same]] = got[same]
            on = ~same & (got >= 0)
            todo, at = todo[on], at[on]
        return out

    def groups(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places of words, their lengths, ids): ids[k][w, i] is the piece of k + 1 bytes that starts at byte i, or -1."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        lo = 0
        while lo < len(order):
            width = int(lengths[order[lo]])
            width += max(0, width // 8)
            hi = int(np.searchsorted(lengths[order], width, "right"))
            hi = min(hi, lo + max(1, CELLS // max(1, width * min(width, self.longest))))
            at = order[lo:hi]
            own = lengths[at]
            width = max(1, int(own.max()))
            chars = np.zeros((len(at), width), np.uint64)
            chars[np.arange(width) < own[:, None]] = np.frombuffer(b"".join(words[i] for i in at), np.uint8)
            chars[np.arange(width) < own[:, None]] += np.uint64(1)
            ids, h = [], np.zeros_like(chars)
            with np.errstate(over="ignore"):
                for k in range(min(self.longest, width)):
                    h = h[:, : width - k] * _BASE + chars[:, k:]
                    ids.append(self._find(h.ravel()).reshape(h.shape))
            yield at, own, ids
            lo = hi

    def forward(self, own: np.ndarray, ids: list[np.ndarray], logp: np.ndarray) -> np.ndarray:
        """Log-probabilities [place, word, class] of all segmentations up to each place. logp: [piece + 1, class], the last row -inf."""
        n, width = ids[0].shape
        out = np.full((width + 1, n, logp.shape[1]), -np.inf)
        out[0] = 0
        for j in range(1, width + 1):
            terms = np.stack([out[j - k] + logp[ids[k - 1][:, j - k]] for k in range(1, min(len(ids), j) + 1)])
            top = terms.max(0)
            safe = np.where(np.isfinite(top), top, 0)
            with np.errstate(divide="ignore"):
                out[j] = np.log(np.exp(terms - safe).sum(0)) + safe
        return out

    def scores(self, words: list[bytes], logp: np.ndarray) -> np.ndarray:
        """Log-probability [word, class] of each word, over all its segmentations."""
        out = np.zeros((len(words), logp.shape[1]))
        for at, own, ids in self.groups(words):
            f = self.forward(own, ids, logp)
            out[at] = f[own, np.arange(len(at))]
        return out

    def expected(self, words: list[bytes], weights: np.ndarray, logp: np.ndarray) -> np.ndarray:
        """How often each piece occurs in words with these weights, in expectation over segmentations. logp: [piece + 1]."""
        return self.expected_fit(words, weights, logp)[0]

    def expected_fit(self, words: list[bytes], weights: np.ndarray, logp: np.ndarray) -> tuple[np.ndarray, float]:
        """Those counts, and the log-probability of all words with their weights."""
        counts, fit = np.zeros(self.size + 1), 0.0
        lp = logp[:, None]
        for at, own, ids in self.groups(words):
            n, width = ids[0].shape
            f = self.forward(own, ids, lp)[:, :, 0]
            b = np.full((width + 1, n), -np.inf)
            b[own, np.arange(n)] = 0
            w = weights[at]
            total = f[own, np.arange(n)]
            fit += float(total @ w)
            for i in range(width - 1, -1, -1):
                terms = np.stack([b[i + k] + logp[ids[k - 1][:, i]] for k in range(1, min(len(ids), width - i) + 1)])
                top = terms.max(0)
                safe = np.where(np.isfinite(top), top, 0)
                with np.errstate(divide="ignore"):
                    fresh = np.log(np.exp(terms - safe).sum(0)) + safe
                b[i] = np.where(i == own, 0.0, fresh) if (own == i).any() else fresh
                share = np.exp(f[i] + terms - total) * w
                here = np.concatenate([ids[k][:, i] for k in range(len(terms))])
                on = here >= 0
                np.add.at(counts, here[on], share.ravel()[on])
        return counts[: self.size], fit


def log_table(counts: np.ndarray, floor: float) -> np.ndarray:
    """Counts as log-probabilities with an added floor; one more place, -inf, for no piece."""
    p = counts + floor
    return np.append(np.log(p / p.sum()), -np.inf)
