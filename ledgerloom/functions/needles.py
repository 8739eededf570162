"""Many needles in many texts at once: which of a block of texts stand anywhere in each row of an Arrow column.

The first bytes of a needle are its anchor: as many as the largest power of two that it has, 32 at most. Anchors of all places of a text are array
programs over pieces of bounded size, looked up in one table of bits for each length; where one is found, whole needles are compared.
"""

from __future__ import annotations

import secrets
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Bytes that are hashed at a time, and the cost of a comparison in bytes compared.
PIECE, CALL = 1 << 18, 256
LONGEST = 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; nulls are empty."""
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, places, data = column.buffers()
    offsets = np.frombuffer(places, kind, len(column) + 1, column.offset * kind().itemsize).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


class Anchors:
    """The anchors of one length: their hashes in order, and a table of bits by hash that tells most other places off."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.shift = U64(64 - max(12, min(22, int(len(hashes)).bit_length() + 5)))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[self.slot(hashes)] = True

    def slot(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes * U64(0x9E3779B97F4A7C15)) >> self.shift

    def found(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, anchors) of the hashes that are an anchor's."""
        at = np.flatnonzero(self.seen[self.slot(hashes)])
        which = np.minimum(np.searchsorted(self.hashes, hashes[at]), len(self.hashes) - 1)
        same = self.hashes[which] == hashes[at]
        return at[same], which[same]


class Needles:
    """A block of distinct texts, none empty, that are searched together."""

    def __init__(self, texts: list[str]):
        self.mixers = [U64(secrets.randbits(63) << 1 | 1) for _ in range(4)]
        needles = sorted({t.encode("utf-8", "surrogatepass") for t in texts} - {b""})
        by_size: dict[int, list[bytes]] = {}
        for x in needles:
            by_size.setdefault(1 << (min(len(x), LONGEST).bit_length() - 1), []).append(x)
        self.anchors: dict[int, Anchors] = {}
        self.groups: dict[int, list[Group]] = {}
        for size, mine in by_size.items():
            body = np.frombuffer(b"".join(x[:size] for x in mine), np.uint8)
            hashes = next(h for s, h in self.hashed(body, {size}) if s == size)[::size]
            every, which = np.unique(hashes, return_inverse=True)
            members: list[list[bytes]] = [[] for _ in every]
            for x, k in zip(mine, which.tolist()):
                members[k].append(x)
            self.anchors[size], self.groups[size] = Anchors(every), [Group(m) for m in members]

    def hashed(self, body: np.ndarray, sizes) -> Iterator[tuple[int, np.ndarray]]:
        """(size, hash of the ``size`` bytes at each place that has as many) for each size, by doubling."""
        n = len(body)
        padded = np.concatenate([body, np.zeros(7, np.uint8)])
        words = np.ndarray((n,), "<u8", padded, 0, (1,)).astype(U64)
        for size in (1, 2, 4, 8):
            if size in sizes and n >= size:
                yield size, words[: n - size + 1] & U64((1 << 8 * size) - 1)
        have, k = words[: max(n - 7, 0)], 0
        for size in (16, 32):
            if not any(s >= size for s in sizes) or n < size:
                return
            half = size // 2
            have = have[: len(have) - half] * self.mixers[k] + have[half:] * self.mixers[k + 1]
            have ^= have >> U64(31)
            k += 2
            if size in sizes:
                yield size, have

    def held(self, column: pa.Array) -> np.ndarray:
        """How many needles each text of a column holds."""
        data, offsets = text_bytes(column)
        counts = np.zeros(len(offsets) - 1, np.int64)
        lo = 0
        while lo < len(counts):  # rows of about a piece together, a longer one alone
            hi = max(int(np.searchsorted(offsets, offsets[lo] + PIECE, side="right")) - 1, lo + 1)
            counts[lo:hi] = self._held(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            lo = hi
        return counts

    def _held(self, body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        counts = np.zeros(len(offsets) - 1, np.int64)
        pieces = range(0, len(body), PIECE)
        text = None
        seen: set[tuple[int, bytes]] = set()
        for a in pieces:
            for size, hashes in self.hashed(body[a : a + PIECE + LONGEST - 1], self.anchors):
                at, which = self.anchors[size].found(hashes[:PIECE])
                if not len(at):
                    continue
                at = at + a
                row = np.searchsorted(offsets, at, side="right") - 1
                inside = at + size <= offsets[row + 1]
                at, which, row = at[inside], which[inside], row[inside]
                order = np.lexsort((at, which, row))
                at, which, row = at[order], which[order], row[order]
                edges = np.flatnonzero(np.r_[True, (which[1:] != which[:-1]) | (row[1:] != row[:-1])]) if len(at) else at
                text = body.tobytes() if text is None else text
                for first, last in zip(edges.tolist(), [*edges[1:].tolist(), len(at)]):
                    r = int(row[first])
                    got = self.groups[size][int(which[first])].found(text, at[first:last], int(offsets[r + 1]))
                    if len(pieces) == 1:
                        counts[r] += len(got)
                    else:  # the same needle may stand in several pieces of a long text
                        seen.update((r, x) for x in got)
        for r, _ in seen:
            counts[r] += 1
        return counts


class Group:
    """The needles of one anchor, in order; ``inner`` has the place of the longest other one that each begins with, or -1."""

    def __init__(self, members: list[bytes]):
        self.members, self.longest, self.inner = members, max(map(len, members)), []
        above: list[int] = []
        for k, x in enumerate(members):
            while above and not x.startswith(members[above[-1]]):
                above.pop()
            self.inner.append(above[-1] if above else -1)
            above.append(k)

    def found(self, text: bytes, places: np.ndarray, end: int) -> set[bytes]:
        """The needles that begin at one of the places, in order, and stand in the text before ``end``."""
        first, last = int(places[0]), int(places[-1])
        stop = min(end, last + self.longest)
        if len(self.members) * (stop - first + CALL) <= len(places) * (min(self.longest, end - first) + CALL):
            return {x for x in self.members if text.find(x, first, min(end, last + len(x))) >= 0}
        got: set[bytes] = set()
        for p in places.tolist():
            if len(self.members) == 1:
                if p + self.longest <= end and text.startswith(self.members[0], p):
                    return {self.members[0]}
                continue
            here = text[p : min(end, p + self.longest)]
            # All that it begins with are the last needle not above it, or begin that one.
            k = bisect_right(self.members, here) - 1
            while k >= 0:
                if self.members[k] in got:
                    break  # with all that it begins with
                if here.startswith(self.members[k]):
                    got.add(self.members[k])
                k = self.inner[k]
        return got
