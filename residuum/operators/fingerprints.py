"""Exact nearest fingerprints of two blocks of packed rows, by counting bits side by side.

A block of source rows is turned into one bitmap a position. The positions that a query
has are added up over its bitmaps with full adders, 64 rows a word, so the shared
positions of a query with all rows of a block stand in a few planes of binary digits.
A comparison of these planes with the least count that can still reach the query's k
best leaves the rows whose distance is worked out.
"""

from __future__ import annotations

import numpy as np

BLOCK_ROWS = 8_192  # source rows whose positions are added up at once
BATCH_QUERIES = 64  # queries added up side by side
SEED_WORDS = 32  # words of rows that give a query its first k distances
STEP = 16  # positions that one round of adders takes
RUN_WORDS = 4  # words of rows of about one size that share the count they must reach


def bitmaps(rows: np.ndarray) -> np.ndarray:
    """One bitmap a position of packed ``rows``, 64 rows a word; the last bitmap is empty."""
    words = -(-len(rows) // 64)
    out = np.zeros((rows.shape[1] * 8 + 1, words * 8), dtype=np.uint8)
    for start in range(0, len(rows), 2048):
        part = np.packbits(np.unpackbits(rows[start : start + 2048], axis=1), axis=0, bitorder="little")
        out[:-1, start // 8 : start // 8 + len(part)] = part.T
    return out.view(np.uint64)


def positions(rows: np.ndarray) -> np.ndarray:
    """Numbers of the positions that each packed row has, filled with the number behind the last one."""
    on, at = np.nonzero(np.unpackbits(rows, axis=1))
    sizes = np.bincount(on, minlength=len(rows))
    out = np.full((len(rows), max(STEP, -(-int(sizes.max()) // STEP) * STEP)), rows.shape[1] * 8, dtype=np.int64)
    out[on, np.arange(len(on)) - (np.cumsum(sizes) - sizes)[on]] = at
    return out


class Counter:
    """Adds up bitmaps; ``planes`` hold the digits of the sums, the lowest first."""

    def __init__(self, shape: tuple[int, int], most: int):
        self.planes = [np.zeros(shape, np.uint64) for _ in range(4 + (most // STEP).bit_length())]
        self.left, self.right, self.scratch, self.spare = (np.empty(shape, np.uint64) for _ in range(4))
        # two carries of each level wait for each other
        self.carries = [[np.empty(shape, np.uint64), np.empty(shape, np.uint64)] for _ in range(4)]

    def full_adder(self, total: np.ndarray, a: np.ndarray, b: np.ndarray, carry: np.ndarray) -> None:
        np.bitwise_xor(total, a, out=self.scratch)
        np.bitwise_and(total, a, out=carry)
        np.bitwise_xor(self.scratch, b, out=total)
        np.bitwise_and(self.scratch, b, out=self.scratch)
        np.bitwise_or(carry, self.scratch, out=carry)

    def add(self, level: int, maps: np.ndarray, wanted: np.ndarray, carry: np.ndarray) -> None:
        """Add 2 ** (level + 1) bitmaps; what overflows ``planes[level]`` goes to ``carry``."""
        if level == 0:
            maps.take(wanted[:, 0], axis=0, out=self.left, mode="clip")
            maps.take(wanted[:, 1], axis=0, out=self.right, mode="clip")
            self.full_adder(self.planes[0], self.left, self.right, carry)
            return
        first, second = self.carries[level - 1]
        half = wanted.shape[1] // 2
        self.add(level - 1, maps, wanted[:, :half], first)
        self.add(level - 1, maps, wanted[:, half:], second)
        self.full_adder(self.planes[level], first, second, carry)

    def count(self, maps: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
        """Planes of how many of the ``wanted`` positions of each query each row has."""
        for plane in self.planes:
            plane[...] = 0
        used = 4
        for start in range(0, wanted.shape[1], STEP):
            carry, spare = self.carries[3]
            self.add(3, maps, wanted[:, start : start + STEP], carry)
            used = 4 + (start // STEP + 1).bit_length()
            for plane in self.planes[4:used]:
                np.bitwise_and(plane, carry, out=spare)
                np.bitwise_xor(plane, carry, out=plane)
                carry, spare = spare, carry
        return self.planes[:used]

    def reaching(self, planes: list[np.ndarray], least: np.ndarray) -> np.ndarray:
        """Bitmap of the rows whose count is at least ``least`` of their query and run of words."""
        found = np.full(planes[0].shape, ~np.uint64(0))
        spread = lambda runs: np.repeat(runs, RUN_WORDS, axis=1)[:, : found.shape[1]]
        for i, plane in enumerate(planes):
            clear = spread(np.where((least >> i) & 1, np.uint64(0), ~np.uint64(0)))
            np.bitwise_or(plane, found, out=self.scratch)
            np.bitwise_and(self.scratch, clear, out=self.scratch)
            np.bitwise_and(plane, found, out=found)
            np.bitwise_or(found, self.scratch, out=found)
        found[spread((least >> len(planes)) > 0)] = 0
        return found


def tanimoto(shared: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Distance from shared positions and the sum of both sizes."""
    union = (sizes - shared).astype(np.float64)
    return 1.0 - np.divide(shared, union, out=np.zeros_like(union), where=union > 0.0)


def _first(row: np.ndarray, col: np.ndarray, far: np.ndarray, order: np.ndarray, k: int):
    """The k nearest of each row, ties by ``order``, in that order."""
    ranked = np.lexsort((order[col], far, row))
    row = row[ranked]
    keep = np.arange(len(row)) - np.searchsorted(row, row, side="left") < k
    return row[keep], col[ranked][keep], far[ranked][keep]


def nearest_fingerprints(left: np.ndarray, right: np.ndarray, order: np.ndarray, k: int):
    """Row and column numbers and Tanimoto distances of the k nearest packed rows of ``right``, ties by ``order``."""
    size, width = np.bitwise_count(left).sum(1, dtype=np.int64), np.bitwise_count(right).sum(1, dtype=np.int64)
    by_size = np.lexsort((order, width))
    k = min(k, len(right))
    blocks = []
    # blocks of equal length: a short last one would cost as many steps as a full one
    count = -(-len(right) // BLOCK_ROWS)
    for names in np.array_split(by_size, max(count, 1)):
        blocks.append((names, width[names], bitmaps(right[names]), names[np.argsort(order[names], kind="stable")[:k]]))
    turn, found = np.argsort(size, kind="stable"), []
    for start in range(0, len(left), BATCH_QUERIES):
        batch = turn[start : start + BATCH_QUERIES]
        row, col, far = _batch(left[batch], size[batch], blocks, width, order, k)
        found.append((batch[row], col, far))
    return tuple(np.concatenate(x) for x in zip(*found))


def _batch(left: np.ndarray, size: np.ndarray, blocks: list, width: np.ndarray, order: np.ndarray, k: int):
    wanted, counters = positions(left), {}
    best = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    limit = np.full(len(left), np.inf)
    middle = int(np.median(size))
    # rows of about a query's size come first: they are near, and the limits they set rule out most others
    for names, widths, maps, early in sorted(blocks, key=lambda b: max(b[1][0] - middle, middle - b[1][-1], 0)):
        least, most = widths[0], widths[-1]
        apart = np.where(size < least, least, size), np.where(size > most, most, size)
        nearest = 1.0 - np.minimum(size, apart[1]) / np.maximum(np.maximum(size, apart[0]), 1)
        if (nearest > limit + 1e-9).all():
            continue
        shape = (len(left), maps.shape[1])
        counter = counters.get(shape) or counters.setdefault(shape, Counter(shape, wanted.shape[1]))
        planes = counter.count(maps, wanted)
        if np.isinf(limit).any():
            limit = np.minimum(limit, _seed(planes, size, widths, middle, k))
        similar = np.where(np.isinf(limit), 0.0, 1.0 - np.minimum(limit, 1.0))
        runs = widths[:: RUN_WORDS * 64]  # rows go by size: the least one of each run
        count = np.ceil((similar / (1.0 + similar))[:, None] * (size[:, None] + runs) - 1e-6).astype(np.int64)
        # rows that share nothing are all equally far: only the first k of them can be neighbours
        mask = counter.reaching(planes, np.maximum(count, 1))
        at, word = np.nonzero(mask)
        hit, bit = np.nonzero(np.unpackbits(mask[at, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        at, word = at[hit], word[hit]
        shared = np.zeros(len(at), np.int64)
        for i, plane in enumerate(planes):
            shared |= ((plane[at, word] >> bit.astype(np.uint64)) & np.uint64(1)).astype(np.int64) << i
        col = names[word * 64 + bit]
        distance = tanimoto(shared, size[at] + width[col])
        near = distance <= limit[at]
        at, col, distance = at[near], col[near], distance[near]
        none = np.flatnonzero(limit >= 1.0)
        if len(none):
            # early rows that do share a position are among those above
            rows, cols = np.repeat(none, len(early)), np.tile(early, len(none))
            fresh = ~np.isin(rows * len(width) + cols, at * len(width) + col)
            at, col = np.r_[at, rows[fresh]], np.r_[col, cols[fresh]]
            distance = np.r_[distance, np.ones(int(fresh.sum()))]
        best = _first(*(np.r_[old, new] for old, new in zip(best, (at, col, distance))), order, k)
        ends = np.searchsorted(best[0], np.arange(len(left)), side="right")
        full = np.bincount(best[0], minlength=len(left)) >= k
        limit = np.where(full, np.minimum(limit, best[2][ends - 1]), limit)
    return best


def _seed(planes: list[np.ndarray], size: np.ndarray, widths: np.ndarray, middle: int, k: int) -> np.ndarray:
    """The k-th distance of each query among some rows of a block, infinite where these are fewer than k."""
    words = planes[0].shape[1]
    first = max(0, min(int(np.searchsorted(widths, middle)) // 64 - SEED_WORDS // 2, words - SEED_WORDS))
    shared = np.zeros((len(size), min(SEED_WORDS, words) * 64), np.int64)
    for i, plane in enumerate(planes):
        part = np.ascontiguousarray(plane[:, first : first + SEED_WORDS]).view(np.uint8)
        shared |= np.unpackbits(part, axis=1, bitorder="little").astype(np.int64) << i
    widths = widths[first * 64 : (first + SEED_WORDS) * 64]
    if len(widths) < k:
        return np.full(len(size), np.inf)
    distance = tanimoto(shared[:, : len(widths)], size[:, None] + widths[None, :])
    return np.partition(distance, k - 1, axis=1)[:, k - 1]
