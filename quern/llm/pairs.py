"""Merging byte pairs by rank with segment trees; what the BPE operator and the JSON vocabularies share."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

NONE = np.int64(1 << 33)  # no pair here


class Memo(dict):
    """What was made of each string so far: join(parts) gives, for each list of strings, their makings put together.

    make(strings) works on many at once. Above `limit` strings the memory is emptied before the next call.
    """

    def __init__(self, make: Callable[[list[str]], list[bytes]], limit: int):
        super().__init__()
        self.make, self.limit = make, limit
        self.made: list[bytes] = []
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        i = self[key] = len(self.made) + len(self.new)
        self.new.append(key)
        return i

    def join(self, parts: list[list[str]]) -> list[bytes]:
        if len(self) > self.limit or self.new:  # or a call before broke off
            self.clear()
            self.made, self.new = [], []
        at = [list(map(self.__getitem__, p)) for p in parts]
        if self.new:
            self.made += self.make(self.new)
            self.new = []
        get = self.made.__getitem__
        return [b"".join(map(get, i)) for i in at]


class BytePairs:
    """Merges by rank. pairs: rows (left id, right id, rank); merged: the id that a rank's merge gives.

    first and last: the ids of a single byte within a piece and at its end; whole: pieces that are one id without any merge.
    """

    def __init__(self, pairs: np.ndarray, merged: np.ndarray, first: np.ndarray, last: np.ndarray, whole: dict[bytes, int] | None = None):
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.values = np.append(keys[order], np.int64(-1)), np.append(pairs[order, 2], NONE)
        self.by_pair = dict(zip(keys.tolist(), pairs[:, 2].tolist(), strict=True))
        self.merged, self.first, self.last, self.whole = merged, first, last, whole or {}
        self.merged_list = merged.tolist()

    @classmethod
    def of_ranks(cls, ranks: dict[bytes, int]) -> BytePairs:
        """Any two tokens whose bytes together are a token merge to it; a token's rank is its id."""
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        single = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int64)
        if (single < 0).any():
            raise ValueError("every single byte must have a rank")
        return cls(np.array(pairs, dtype=np.int64).reshape(-1, 3), np.arange(max(ranks.values()) + 1), single, single, ranks)

    def _ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of many pairs of ids; NONE for no token, or where an id is missing (-1)."""
        keys = left << 32 | right
        at = np.searchsorted(self.keys[:-1], keys)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.values[at], NONE)

    def encode_short(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of similar, small lengths, one merge in each at a step: all their ids, and how many each has."""
        n = len(pieces)
        lens = np.fromiter(map(len, pieces), dtype=np.int64, count=n)
        width = 1 << max(1, (int(lens.max()) - 1).bit_length())
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), dtype=np.uint8).reshape(n, width)
        at = np.arange(width)
        ids = np.where(at < lens[:, None] - 1, self.first[flat], np.where(at < lens[:, None], self.last[flat], -1))
        right = np.full_like(ids, -1)
        right[:, :-1] = ids[:, 1:]
        # A leaf's key orders by rank, then position: rank * width + position; NONE ones stay above all others.
        tree = np.empty((n, 2 * width), dtype=np.int64)
        tree[:, width:] = self._ranks_of(ids, right) * width + np.arange(width)
        level = width
        while level > 1:
            level //= 2
            tree[:, level : 2 * level] = np.minimum(tree[:, 2 * level : 4 * level : 2], tree[:, 2 * level + 1 : 4 * level : 2])
        nxt = np.broadcast_to(np.arange(1, width + 1), ids.shape).copy()
        prv = np.broadcast_to(np.arange(-1, width - 1), ids.shape).copy()
        limit = NONE * width
        rows = np.flatnonzero(tree[:, 1] < limit)

        def put(r: np.ndarray, pos: np.ndarray, key: np.ndarray) -> None:
            node = pos + width
            tree[r, node] = key
            while node[0] > 1:
                node = node >> 1
                tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])

        while len(rows):
            top = tree[rows, 1]
            pos, rank = top % width, top // width
            gone = nxt[rows, pos]
            after = nxt[rows, gone]
            made = self.merged[rank]
            ids[rows, pos] = made
            ids[rows, gone] = -1
            nxt[rows, pos] = after
            inside = after < width
            prv[rows[inside], after[inside]] = pos[inside]
            follower = np.where(inside, ids[rows, np.minimum(after, width - 1)], -1)
            put(rows, gone, np.full(len(rows), limit))
            put(rows, pos, self._ranks_of(made, follower) * width + pos)
            before = prv[rows, pos]
            has = before >= 0
            if has.any():
                r, p = rows[has], before[has]
                put(r, p, self._ranks_of(ids[r, p], made[has]) * width + p)
            rows = rows[tree[rows, 1] < limit]
        kept = ids >= 0
        return ids[kept], kept.sum(axis=1)

    def encode_long(self, piece: bytes) -> np.ndarray:
        """One piece of any length: n leaves, at most n merges of a logarithmic cost."""
        n = len(piece)
        width = 1 << max(1, (n - 1).bit_length())
        limit, get, merged = int(NONE) * width, self.by_pair.get, self.merged_list
        raw = np.frombuffer(piece, dtype=np.uint8)
        ids = [*self.first[raw[:-1]].tolist(), int(self.last[raw[-1]])]
        leaves = np.full(width, limit, dtype=np.int64)
        arr = np.asarray(ids, dtype=np.int64)
        leaves[: n - 1] = self._ranks_of(arr[:-1], arr[1:]) * width + np.arange(n - 1)
        levels = [leaves]
        while len(levels[0]) > 1:
            levels.insert(0, np.minimum(levels[0][::2], levels[0][1::2]))
        tree = [0, *np.concatenate(levels).tolist()]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(pos: int, key: int) -> None:
            node = pos + width
            tree[node] = key
            while node > 1:
                other, node = tree[node ^ 1], node >> 1
                best = key if key < other else other
                if tree[node] == best:
                    return
                tree[node] = key = best

        while tree[1] < limit:
            rank, pos = divmod(tree[1], width)
            gone = nxt[pos]
            after = nxt[gone]
            made = merged[rank]
            ids[pos], ids[gone], nxt[pos] = made, -1, after
            put(gone, limit)
            if after < n:
                prv[after] = pos
                r = get(made << 32 | ids[after])
                put(pos, limit if r is None else r * width + pos)
            else:
                put(pos, limit)
            if (before := prv[pos]) >= 0:
                r = get(ids[before] << 32 | made)
                put(before, limit if r is None else r * width + before)
        return np.asarray([i for i in ids if i >= 0], dtype=np.int64)

    def encode(self, pieces: list[bytes], dtype: np.dtype = np.dtype("<u4")) -> list[bytes]:  # noqa: B008
        """The ids of each piece, as little-endian integers."""
        out = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (r := self.whole.get(p)) is not None:
                out[i] = r.to_bytes(dtype.itemsize, "little")
            elif len(p) > 64:
                out[i] = self.encode_long(p).astype(dtype).tobytes()
            elif p:
                by_width.setdefault((len(p) - 1).bit_length(), []).append(i)
        for at in by_width.values():
            for k in range(0, len(at), 16384):
                some = at[k : k + 16384]
                ids, n = self.encode_short([pieces[i] for i in some])
                blob, begin = ids.astype(dtype).tobytes(), 0
                for i, end in zip(some, (np.cumsum(n) * dtype.itemsize).tolist(), strict=True):
                    out[i] = blob[begin:end]
                    begin = end
        return out
