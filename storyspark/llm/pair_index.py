"""Byte-pair merging by a pair occurrence index.

The different pieces of a batch are laid out once, one symbol after another. An index maps every pair
of neighbouring symbols that has a rank to all its positions; ranks come off a heap in ascending
order, each is applied at all positions of its pair, from the left, and only the lists of the
neighbours that a merge changes are updated. Many short pieces are merged faster without the index,
length by length (``merge_by_length``).
"""

from __future__ import annotations

import json
from heapq import heappop, heappush

import numpy as np

SHIFT = 20
#: Binary logarithm of the number of hashed slots.
SLOTS = 20
#: Pieces in one index; the arrays over them take some tens of MB.
AT_ONCE = 50_000
#: Bytes of the longest piece that is merged length by length.
SHORT = 64
#: In place of a rank: no pair.
NO_RANK = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in a vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 256
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b], more = chr(more), more + 1
    return out


class PairIndex:
    """Vocabulary and merges of a byte-level BPE file, with or without a suffix that marks word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        back = {c: b for b, c in enumerate(letters)}
        suffix = spec["model"].get("end_of_word_suffix")
        self.of_byte = np.array([vocab[c] for c in letters])
        self.of_last = np.array([vocab[c + suffix] for c in letters]) if suffix else None
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: By rank: the two symbols and what they become.
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.made = np.array([c for _, _, c in self.merges], np.int32)
        keys = np.array([a << SHIFT | b for a, b, _ in self.merges], np.int64)
        self.rank_of = np.argsort(keys, kind="stable")
        self.keys = keys[self.rank_of]
        #: A hashed slot for each pair; pairs that share one are found in the sorted keys.
        self.slot_key = np.full(1 << SLOTS, -1, np.int64)
        self.slot_rank = np.zeros(1 << SLOTS, np.int32)
        at = self.slot(self.keys)
        self.slot_key[at], self.slot_rank[at] = self.keys, self.rank_of
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {} if suffix else {i: bytes(back[c] for c in t) for t, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}

    @staticmethod
    def slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOTS)

    def ranked(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these neighbours are pairs with a rank, and those pairs' ranks."""
        keys = (left.astype(np.int64) << SHIFT) | right
        at = self.slot(keys)
        found = self.slot_key[at]
        same = found == keys
        ranks = np.where(same, self.slot_rank[at], -1)
        other = np.flatnonzero(~same & (found >= 0))
        if len(other):
            k = keys[other]
            i = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            ranks[other] = np.where(self.keys[i] == k, self.rank_of[i], -1)
        hit = np.flatnonzero(ranks >= 0)
        return hit, ranks[hit]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each of these neighbours, or NO_RANK."""
        out = np.full(left.size, NO_RANK, np.int32)
        hit, ranks = self.ranked(left.ravel(), right.ravel())
        out[hit] = ranks
        return out.reshape(left.shape)

    def merge_by_length(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces, one piece behind the other, and how many each has.

        Pieces of as many symbols are rows of one grid. From the greatest length down, every row's pair of
        least rank, the first of several, becomes one symbol, and the row goes on among those one
        shorter; a row without such a pair is done. Pieces of more than SHORT bytes go by the index.
        """
        done = [self._merge_by_length(pieces[i : i + AT_ONCE]) for i in range(0, len(pieces), AT_ONCE)]
        none = np.zeros(0, "<u4"), np.zeros(0, np.int64)
        return np.concatenate([none[0]] + [ids for ids, _ in done]), np.concatenate([none[1]] + [sizes for _, sizes in done])

    def _merge_by_length(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        coded = [p.encode("utf-8", "surrogatepass") for p in pieces]
        lengths = np.fromiter(map(len, coded), np.int64, len(coded))
        raw = np.frombuffer(b"".join(coded), np.uint8)
        ends = np.cumsum(lengths)
        symbols = self.of_byte[raw].astype(np.int32)
        if self.of_last is not None:
            last = ends[lengths > 0] - 1
            symbols[last] = self.of_last[raw[last]]
        long = np.flatnonzero(lengths > SHORT)
        done = [(long[k : k + 1], np.frombuffer(x, "<u4")[None]) for k, x in enumerate(self._merge([pieces[i] for i in long]))] if len(long) else []
        widest = int(lengths[lengths <= SHORT].max(initial=0))
        who, grid, ranks = np.zeros(0, np.int64), np.zeros((0, widest), np.int32), np.zeros((0, max(0, widest - 1)), np.int32)
        for width in range(widest, 0, -1):
            own = np.flatnonzero(lengths == width)
            fresh = symbols[(ends[own] - width)[:, None] + np.arange(width)]
            who, grid = np.concatenate([who, own]), np.concatenate([grid, fresh])
            ranks = np.concatenate([ranks, self.ranks(fresh[:, :-1], fresh[:, 1:])])
            if width == 1:
                done.append((who, grid))
                break
            at = ranks.argmin(1)
            least = ranks[np.arange(len(who)), at]
            over, on = np.flatnonzero(least == NO_RANK), np.flatnonzero(least < NO_RANK)
            done.append((who[over], grid[over]))
            who, grid, ranks, at = who[on], grid[on], ranks[on], at[on]
            rows = np.arange(len(who))
            grid[rows, at] = self.made[least[on]]
            stay = np.ones(grid.shape, bool)
            stay[rows, at + 1] = False
            grid = grid[stay].reshape(len(who), width - 1)
            stay = np.ones(ranks.shape, bool)
            stay[rows, at] = False
            ranks = ranks[stay].reshape(len(who), width - 2)
            for shift, some in ((-1, np.flatnonzero(at > 0)), (0, np.flatnonzero(at < width - 2))):
                first = at[some] + shift
                ranks[some, first] = self.ranks(grid[some, first], grid[some, first + 1])
        sizes = np.zeros(len(pieces), np.int64)
        for who, grid in done:
            sizes[who] = grid.shape[1]
        starts = np.cumsum(sizes) - sizes
        ids = np.zeros(int(sizes.sum()), "<u4")
        for who, grid in done:
            ids[starts[who][:, None] + np.arange(grid.shape[1])] = grid
        return ids, sizes

    def merge_all(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece, as little-endian unsigned 32-bit integers; AT_ONCE pieces share an index."""
        return [ids for i in range(0, len(pieces), AT_ONCE) for ids in self._merge(pieces[i : i + AT_ONCE])]

    def _merge(self, pieces: list[str]) -> list[bytes]:
        coded = [p.encode("utf-8", "surrogatepass") for p in pieces]
        # a byte 255 ends each piece (it is in no UTF-8); no pair reaches over it
        raw = np.frombuffer(b"\xff".join(coded) + b"\xff\xff", np.uint8)
        symbols = np.where(raw == 255, -1, self.of_byte[raw]).astype(np.int32)
        ends = np.flatnonzero(raw == 255)[: len(pieces)]
        if self.of_last is not None:
            last = ends[np.diff(ends, prepend=-1) > 1] - 1
            symbols[last] = self.of_last[raw[last]]
        n = len(symbols)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        after[-1] = n - 1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def note(ranks: np.ndarray, places: np.ndarray) -> None:
            """Adds places to the lists of their pairs, which go by rank."""
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = [0, *(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for x, y, r in zip(cuts, cuts[1:], ranks[cuts[:-1]].tolist(), strict=False):
                if r in index:
                    index[r].append(places[x:y])
                else:
                    index[r] = [places[x:y]]
                    heappush(active, r)

        first = np.flatnonzero((symbols[:-1] >= 0) & (symbols[1:] >= 0))
        hit, ranks = self.ranked(symbols[first], symbols[first + 1])
        if len(hit):
            note(ranks, first[hit])
        while active:
            rank = heappop(active)
            lists = index.pop(rank)
            a, b, new = self.merges[rank]
            i = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            j = after[i]
            ok = (symbols[i] == a) & (symbols[j] == b)  # an earlier merge may have taken one of the two
            if not ok.all():
                i, j = i[ok], j[ok]
            if a == b and len(i) > 1:  # in a run of equal symbols, from the left
                free, kept = -1, []
                for k, (x, y) in enumerate(zip(i.tolist(), j.tolist(), strict=True)):
                    if x != free:
                        kept.append(k)
                        free = y
                i, j = i[kept], j[kept]
            if not len(i):
                continue
            symbols[i], symbols[j] = new, -2
            k = after[j]
            after[i], before[k] = k, i
            h = before[i]
            left, right = np.concatenate([symbols[h], np.full(len(i), new)]), np.concatenate([np.full(len(i), new), symbols[k]])
            places = np.concatenate([h, i])
            real = np.flatnonzero((left >= 0) & (right >= 0))
            if len(real):
                hit, ranks = self.ranked(left[real], right[real])
                if len(hit):
                    note(ranks, places[real[hit]])
        kept = np.flatnonzero(symbols >= 0)
        ids = symbols[kept].astype("<u4").tobytes()
        bounds = [0, *(np.searchsorted(kept, ends) * 4).tolist()]
        return [ids[x:y] for x, y in zip(bounds, bounds[1:], strict=False)]
