"""Byte-pair merges of many words at once, for tokenizer files with word ends.

All words lie end to end in arrays; one round merges the leftmost pair of lowest rank in every word that still has a
ranked pair, so each word goes through just the merges that it would go through alone.
"""

from __future__ import annotations

import json

import numpy as np

_NONE = np.int64(2**62)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes stand for
    themselves and the others, in order, for the letters from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + n)
            n += 1
    return out


class IdRows:
    """Rows of ids, end to end in one array."""

    def __init__(self, flat: np.ndarray | None = None, size: np.ndarray | None = None):
        self.flat = np.zeros(0, "<u4") if flat is None else flat
        self.size = np.zeros(0, np.int32) if size is None else size.astype(np.int32, copy=False)
        self.ends = np.cumsum(self.size, dtype=np.int64)

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> IdRows:
        return cls(np.concatenate([np.zeros(0, "<u4"), *rows]), np.array([*map(len, rows)], np.int32))

    def __len__(self) -> int:
        return len(self.size)

    def __add__(self, other: IdRows) -> IdRows:
        return IdRows(np.concatenate([self.flat, other.flat]), np.concatenate([self.size, other.size])) if len(self) else other

    def take(self, at: np.ndarray) -> IdRows:
        """The rows of those numbers, which may repeat."""
        size = self.size[at]
        ends = np.cumsum(size, dtype=np.int64)
        return IdRows(self.flat[np.repeat(self.ends[at] - ends, size) + np.arange(ends[-1] if len(ends) else 0)], size)

    def joined(self, rows: np.ndarray) -> IdRows:
        """So many rows, one after the other, as one."""
        return IdRows(self.flat, np.diff(np.append(0, self.ends)[np.append(0, np.cumsum(rows))]))

    def bytes(self) -> list[bytes]:
        """Each row as little-endian 32-bit ids."""
        raw, cuts = self.flat.tobytes(), (np.append(0, self.ends) * 4).tolist()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


class WordMerger:
    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.width = np.int64(max(vocab.values()) + 1)
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int64)
        self.last = np.array([vocab.get(c + suffix, -1) for c in letters], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * int(self.width) + vocab[b] for a, b in merges], np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        # open addressing: a power of two of slots, under a quarter full
        self.bits = int(np.ceil(np.log2(4 * max(len(keys), 1))))
        self.slots = np.full(1 << self.bits, -1, np.int64)
        self.ranks = np.zeros(1 << self.bits, np.int64)
        mask = (1 << self.bits) - 1
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist())):
            while self.slots[at] >= 0 and self.slots[at] != key:
                at = (at + 1) & mask
            if self.slots[at] < 0:
                self.slots[at], self.ranks[at] = key, rank
        # ranks of byte pairs, within a word and at its end
        letters = np.arange(1 << 16)
        self.first = self._rank(self.inner[letters >> 8], self.inner[letters & 255]), self._rank(self.inner[letters >> 8], self.last[letters & 255])

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, or _NONE."""
        keys = a * self.width + b
        at = self._slot(keys)
        out = np.full(len(keys), _NONE)
        todo = np.arange(len(keys))
        mask = (1 << self.bits) - 1
        while len(todo):
            slot = self.slots[at]
            hit = slot == keys[todo]
            out[todo[hit]] = self.ranks[at[hit]]
            on = ~hit & (slot >= 0)
            todo, at = todo[on], (at[on] + 1) & mask
        return out

    def encode(self, words: list[bytes]) -> IdRows:
        """The ids of each word, given as its UTF-8 bytes (none may be empty)."""
        size = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(size)
        starts = ends - size
        symbol = self.inner[raw]
        symbol[ends - 1] = self.last[raw[ends - 1]]
        n = len(raw)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        after[ends - 1] = -1
        before[starts] = -1
        alive = np.ones(n, bool)
        value = np.full(n, _NONE)
        inner = np.flatnonzero(after >= 0)

        def put(at: np.ndarray, rank: np.ndarray) -> None:
            value[at] = np.where(rank == _NONE, _NONE, (rank << 32) + at)  # the lowest rank, then the leftmost

        pair = raw[inner].astype(np.int64) << 8 | raw[inner + 1]
        put(inner, np.where(after[inner + 1] < 0, self.first[1][pair], self.first[0][pair]))
        active = np.flatnonzero(size > 1)
        while len(active):
            # the places of the words that are still at work, end to end
            length = size[active]
            offset = np.cumsum(length) - length
            place = np.repeat(starts[active] - offset, length) + np.arange(length.sum())
            low = np.minimum.reduceat(value[place], offset)
            on = low != _NONE
            active, low = active[on], low[on]
            if not len(active):
                break
            at = low & 0xFFFFFFFF
            gone = after[at]
            symbol[at] = self.made[low >> 32]
            alive[gone] = False
            value[gone] = _NONE
            follow = after[gone]
            after[at] = follow
            has = follow >= 0
            before[follow[has]] = at[has]
            value[at[~has]] = _NONE
            prior = before[at]
            changed = np.concatenate([at[has], prior[prior >= 0]])
            put(changed, self._rank(symbol[changed], symbol[after[changed]]))
        return IdRows(symbol[alive].astype("<u4"), np.add.reduceat(alive.astype(np.int32), starts) if len(starts) else None)
