"""Cutting texts into the matches of the tokenizers' pattern, and byte-pair merging of the distinct ones."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Callable, Sequence

import numpy as np
import regex

from evidex.llm.common import codepoints, ends, gather, mix, run_hash

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """Class of every code point by the pattern's own property names."""
    if not _CLASSES:
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        table = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
            table[codepoints("".join(regex.findall(pattern, every)))] = kind
        _CLASSES.append(table)
    return _CLASSES[0]


def starts(code: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Marks where a match of ``public_tokenizers.PATTERN`` starts; ``bounds`` are the texts' ends.

    A match is a run of letters, numbers or other signs with the blank before it, or white
    space up to the last one before a sign, or an apostrophe with one of seven endings.
    """
    n = len(code)
    kind = classes()[code]
    fresh = np.zeros(n + 4, bool)  # a text starts here
    fresh[bounds] = True
    fresh[n:] = True
    space = np.concatenate([kind == SPACE, np.ones(4, bool)])
    blank = np.zeros(n + 4, bool)
    blank[:n] = code == 32
    run = fresh[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    glued = np.concatenate([[False], blank[:n - 1]])[:n] & ~fresh[:n]
    last = space[:n] & ~space[1:n + 1] & ~fresh[1:n + 1]
    start = run & (space[:n] | ~glued) | last
    pad = np.concatenate([code, np.zeros(4, code.dtype)])
    letter = np.concatenate([kind == LETTER, np.zeros(4, bool)])
    at = np.flatnonzero((code == 39) & run & ~glued & letter[1:n + 1] & ~fresh[1:n + 1])
    if len(at):
        one, two, inner = pad[at + 1], pad[at + 2], letter[at + 2] & ~fresh[at + 2]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = inner & ((one == ord("r")) & (two == ord("e")) | (one == ord("v")) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        for hit, size in ((at[single], 2), (at[double & ~single], 3)):
            start[hit + 1] = False
            after = hit + size
            after = after[letter[after] & ~fresh[after]]
            start[after] = True
    return start


class Pieces:
    """Ids of texts by way of the distinct pieces; ``encode`` maps a list of byte pieces to id arrays.

    Pieces are looked up by a 64-bit hash in a table that lives as long as the Python worker
    and is emptied once it holds ``limit`` pieces.
    """

    def __init__(self, encode: Callable[[list[bytes]], list[np.ndarray]], limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.keys, self.start, self.length = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.pool = np.empty(0, np.int32)

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        if len(self.keys) + len(keys) > self.limit:
            self._clear()
        made = self.encode(pieces)
        length = np.fromiter(map(len, made), np.int64, len(made))
        start = len(self.pool) + np.cumsum(length) - length
        self.pool = np.concatenate([self.pool, *made]).astype(np.int32)
        at = np.searchsorted(self.keys, keys)
        self.keys, self.start, self.length = (np.insert(a, at, b) for a, b in ((self.keys, keys), (self.start, start), (self.length, length)))

    def ids(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text starts and the total)."""
        whole = "".join(texts)
        if not whole:
            return np.empty(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        code, bounds = codepoints(whole), ends(map(len, texts))
        at = np.flatnonzero(starts(code, bounds))
        data = np.frombuffer(whole.encode(), np.uint8)
        byte = np.concatenate([[0], np.cumsum(1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))]).astype(np.int64)
        begin = byte[at]
        end = np.append(begin[1:], len(data))
        distinct, first, inverse = np.unique(run_hash(data, begin, end), return_index=True, return_inverse=True)
        spot = np.searchsorted(self.keys, distinct)
        known = self.keys[np.minimum(spot, len(self.keys) - 1)] == distinct if len(self.keys) else np.zeros(len(distinct), bool)
        if not known.all():
            if len(self.keys) + (~known).sum() > self.limit:  # all of this chunk anew
                self._clear()
                known[:] = False
            new = first[~known]
            raw = data.tobytes()
            self._learn(distinct[~known], [raw[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)])
            spot = np.searchsorted(self.keys, distinct)
        start, length = self.start[spot][inverse], self.length[spot][inverse]
        total = np.concatenate([[0], np.cumsum(length)])
        return gather(self.pool, start, length), total[np.searchsorted(at, bounds)]


class BytePairs:
    """Byte-pair merging by ranks, as a table of pairs and matrices of equally long pieces."""

    EMPTY, NONE = -1, np.iinfo(np.int32).max
    #: Pieces of more bytes are merged one by one with a heap.
    WIDEST = 2048

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        tokens = sorted(self.ranks, key=self.ranks.get)
        self.tokens = tokens
        top = max(self.ranks.values()) + 1
        self.first = np.full(256, -1, np.int32)
        for b in range(256):
            self.first[b] = self.ranks[bytes([b])]
        size = np.zeros(top, np.int64)
        for t in tokens:
            size[self.ranks[t]] = len(t)
        self.token_length, self.token_start = size, np.cumsum(size) - size
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        said = [b",%d" % i for i in range(top)]
        self.said_length = np.fromiter(map(len, said), np.int64, top)
        self.said_start = np.cumsum(self.said_length) - self.said_length
        self.said = np.frombuffer(b"".join(said), np.uint8)
        left, right, whole = [], [], []
        get = self.ranks.get
        for t, rank in self.ranks.items():
            for cut in range(1, len(t)):
                a, b = get(t[:cut]), get(t[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    whole.append(rank)
        self._table(self._key(np.array(left), np.array(right)), np.array(whole, np.int32))

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a.astype(np.int64) << 32 | b.astype(np.int64)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def _table(self, keys: np.ndarray, values: np.ndarray) -> None:
        """An open-addressed table at a quarter of its size, filled a probe at a time."""
        self.mask = (1 << int(np.ceil(np.log2(4 * len(keys) + 1)))) - 1
        self.slots, self.values = np.full(self.mask + 1, self.EMPTY, np.int64), np.full(self.mask + 1, self.NONE, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.slots[slot] == self.EMPTY)
            free = free[np.unique(slot[free], return_index=True)[1]]
            self.slots[slot[free]], self.values[slot[free]] = keys[free], values[free]
            rest = np.setdiff1d(np.arange(len(keys)), free, assume_unique=True)
            keys, values, slot = keys[rest], values[rest], slot[rest] + 1 & self.mask

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank, which is the merged id, of each pair; NONE where there is none or a is padding."""
        key = self._key(a, b).ravel()
        out = np.full(len(key), self.NONE, np.int32)
        open_ = np.flatnonzero((a.ravel() >= 0) & (b.ravel() >= 0))
        slot = self._slot(key[open_])
        while len(open_):
            got = self.slots[slot]
            hit = got == key[open_]
            out[open_[hit]] = self.values[slot[hit]]
            go = ~hit & (got != self.EMPTY)
            open_, slot = open_[go], slot[go] + 1 & self.mask
        return out.reshape(a.shape)

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, merged in matrices of pieces of similar length."""
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        low, widths = 0, [1, 2, 3, 4, 6, 8, 12, 16, 24, 32, 64, 128, 256, 512, 1024, self.WIDEST]
        for width in widths:
            mine = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            step = max(1, (1 << 20) // width)
            for at in range(0, len(mine), step):
                part = mine[at:at + step]
                for i, ids in zip(part.tolist(), self._merge([pieces[i] for i in part], lengths[part], width), strict=True):
                    out[i] = ids
        for i in np.flatnonzero(lengths > self.WIDEST):
            out[i] = self._merge_long(pieces[i])
        return out

    def _merge(self, pieces: list[bytes], lengths: np.ndarray, width: int) -> list[np.ndarray]:
        """Each round every row merges its leftmost pair of least rank; finished rows leave the matrix."""
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.first[np.frombuffer(b"".join(pieces), np.uint8)]
        out: list[np.ndarray] = [np.empty(0, np.int32)] * len(pieces)
        row = np.arange(len(pieces))
        ranks = self.pair_ranks(ids[:, :-1], ids[:, 1:])
        while True:
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(ids), np.int64)
            least = ranks[np.arange(len(ids)), at] if ranks.shape[1] else np.full(len(ids), self.NONE, np.int32)
            done = least == self.NONE
            if done.any():
                for i, line in zip(row[done].tolist(), ids[done], strict=True):
                    out[i] = line[line >= 0]
                live = ~done
                ids, ranks, row, at, least = ids[live], ranks[live], row[live], at[live], least[live]
            if not len(row):
                return out
            every = np.arange(len(row))
            ids[every, at] = least
            keep = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, keep + (keep > at[:, None]), 1)
            keep = keep[:-1]
            ranks = np.take_along_axis(ranks, keep + (keep > at[:, None]), 1)
            for spot in (at - 1, at):
                ok = (spot >= 0) & (spot < ranks.shape[1])
                i, j = every[ok], spot[ok]
                ranks[i, j] = self.pair_ranks(ids[i, j], ids[i, j + 1])

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges on a linked list with a heap of (rank, place)."""
        ids = self.first[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        first = self.pair_ranks(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i) for i, r in enumerate(first) if r != self.NONE]
        heapq.heapify(heap)

        def rank(i: int) -> int | None:
            j = after[i] if i >= 0 else -1
            return None if j < 0 else self.ranks.get(self.tokens[ids[i]] + self.tokens[ids[j]])

        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for k in (before[i], i):
                got = rank(k) if k >= 0 else None
                if got is not None:
                    heapq.heappush(heap, (got, k))
        return np.array([i for i in ids if i >= 0], np.int32)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of all ids, one after the other."""
        return gather(self.token_bytes, self.token_start[ids], self.token_length[ids])

    def decimals(self, ids: np.ndarray) -> np.ndarray:
        """A comma and the decimal number of each id, as bytes."""
        return gather(self.said, self.said_start[ids], self.said_length[ids])
