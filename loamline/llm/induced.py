"""External induced sorting of suffixes with common-prefix values.

The order is found as in SA-IS and its external form eSAIS (Bingmann, Fischer and Osipov, 2013): suffixes
that are smaller than their right neighbour and follow a larger one (LMS) are sorted first, by naming
their substrings and recursing on the string of names; all others are induced from them, the larger ones
(L) in one rising scan and the smaller ones (S) in one falling scan. A scan is a monotone priority
queue: tuples (suffix, common prefix with the one before) are keyed by their first character and, within
it, by arrival, which is the order of the suffixes one character on. The queue holds blocks of tuples and
moves them to disk beyond its budget, so a shard may be far larger than memory. The common prefix
of two induced neighbours is one more than the least common prefix between the suffixes that induced
them; it is carried block by block with a running minimum for each first character. Values stop at a cap,
which is all that a search for long repeats needs.

All loops run over blocks, not over suffixes. The text is an array of non-negative whole numbers; its end
counts as smaller than any character.
"""

from __future__ import annotations

import heapq
import os
from collections.abc import Iterator

import numpy as np

BLOCK = 1 << 16
#: Tuples that a queue holds in memory; the rest is on disk.
HELD = 1 << 21
#: Names that are ranked in memory by doubling; longer strings of names are induced again.
IN_MEMORY = 1 << 24


class Runs:
    """Blocks of (suffix, common prefix) by key, first in, first out; the oldest go to disk beyond the
    budget. With rank, keys come out in rising (1) or falling (-1) order."""

    def __init__(self, folder: str, rank: int = 0, held: int = HELD):
        self.folder, self.rank, self.budget = folder, rank, held
        self.parts: dict[int, list] = {}  # arrays, or (offset, count) once on disk
        self.heap: list[int] = []
        self.size, self.end, self.path = 0, 0, None

    def push(self, key: int, pos: np.ndarray, lcp: np.ndarray) -> None:
        if key not in self.parts:
            self.parts[key] = []
            if self.rank:
                heapq.heappush(self.heap, key * self.rank)
        self.parts[key].append((pos, lcp))
        self.size += len(pos)
        if self.size > self.budget:
            self.spill()

    def spill(self) -> None:
        if self.path is None:
            self.path = os.path.join(self.folder, f"runs-{id(self)}-{os.getpid()}")
        with open(self.path + ".pos", "ab") as p, open(self.path + ".lcp", "ab") as q:
            for key, parts in self.parts.items():
                out, i = [], 0
                while i < len(parts):
                    if isinstance(parts[i][0], int):
                        out.append(parts[i])
                        i += 1
                        continue
                    j = i
                    while j < len(parts) and not isinstance(parts[j][0], int):
                        j += 1
                    pos, lcp = (np.concatenate([x[k] for x in parts[i:j]]) for k in (0, 1))
                    pos.astype(np.int64).tofile(p)
                    lcp.astype(np.uint8).tofile(q)
                    out.append((self.end, len(pos)))
                    self.end += len(pos)
                    i = j
                self.parts[key] = out
        self.size = 0

    def read(self, part) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        at, count = part
        if not isinstance(at, int):
            self.size -= len(at)
            for i in range(0, len(at), BLOCK):
                yield at[i : i + BLOCK], count[i : i + BLOCK]
            return
        for i in range(at, at + count, BLOCK):
            n = min(BLOCK, at + count - i)
            yield np.fromfile(self.path + ".pos", np.int64, n, offset=8 * i), np.fromfile(self.path + ".lcp", np.uint8, n, offset=i)

    def next_key(self) -> int | None:
        return self.heap[0] * self.rank if self.heap else None

    def drain(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The key's blocks, with those that are pushed to it meanwhile, until none is left."""
        while parts := self.parts.get(key):
            self.parts[key] = []
            if len(parts) > 1 and all(not isinstance(p[0], int) for p in parts):
                parts = [(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))]
            for part in parts:
                yield from self.read(part)
        if key in self.parts:
            del self.parts[key]
        if self.rank and self.heap and self.heap[0] == key * self.rank:
            heapq.heappop(self.heap)

    def backwards(self, key: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The key's tuples from the last to the first."""
        for part in reversed(self.parts.pop(key, [])):
            at, count = part
            if not isinstance(at, int):
                self.size -= len(at)
                for i in range(len(at), 0, -BLOCK):
                    yield at[max(0, i - BLOCK) : i][::-1], count[max(0, i - BLOCK) : i][::-1]
            else:
                for i in range(at + count, at, -BLOCK):
                    n = min(BLOCK, i - at)
                    yield np.fromfile(self.path + ".pos", np.int64, n, offset=8 * (i - n))[::-1], np.fromfile(self.path + ".lcp", np.uint8, n, offset=i - n)[::-1]

    def close(self) -> None:
        if self.path:
            for end in (".pos", ".lcp"):
                os.remove(self.path + end)


def least_between(lcp: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minimum of lcp[low..high] for each pair, both ends included, by powers of two."""
    levels = [lcp]
    while 2 << (len(levels) - 1) <= len(lcp):
        half = 1 << (len(levels) - 1)
        levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
    width = np.log2(high - low + 1).astype(np.int64)
    out = np.empty(len(low), lcp.dtype)
    for k in range(len(levels)):
        at = np.flatnonzero(width == k)
        if len(at):
            out[at] = np.minimum(levels[k][low[at]], levels[k][high[at] - (1 << k) + 1])
    return out


class Sorter:
    def __init__(self, text: np.ndarray, folder: str, cap: int, held: int = HELD, in_memory: int = IN_MEMORY):
        """cap: common prefixes count up to so many characters, at most 254; 0 for none."""
        self.text, self.folder, self.cap, self.held, self.in_memory = text, folder, cap, held, in_memory
        self.n = len(text)

    def lms_blocks(self) -> Iterator[np.ndarray]:
        """LMS positions in falling blocks."""
        text, n, step = self.text, self.n, 1 << 22
        after_small = False  # whether the suffix that starts right of the block is smaller than its follower
        for end in range(n, 0, -step):
            start = max(0, end - step)
            part = np.asarray(text[start : min(n, end + 1)]).astype(np.int64)
            if end == n:
                part = np.append(part, -1)
            rise = np.sign(np.diff(part))  # 1: smaller than its right neighbour
            at = np.where(rise != 0, np.arange(len(rise)), len(rise))
            at = np.minimum.accumulate(at[::-1])[::-1]
            small = np.append(rise > 0, after_small)[at]
            # The type of the character left of the block; the first suffix of all is never LMS.
            c, first = (int(text[start - 1]), int(part[0])) if start else (-1, 0)
            left = np.concatenate(([c < first or (c == first and bool(small[0]))], small[:-1]))
            after_small = bool(small[0])
            yield np.flatnonzero(small & ~left) + start

    def seam(self, i: int, j: int) -> int:
        """Common prefix of two suffixes, up to the cap."""
        k, text, n = 0, self.text, self.n
        while k < self.cap and i + k < n and j + k < n and text[i + k] == text[j + k]:
            k += 1
        return k

    def scan(self, key: int, pos: np.ndarray, lcp: np.ndarray, queue: Runs, larger: bool, same: bool, since: np.ndarray | None) -> None:
        """Push what the block's suffixes induce: their left neighbours whose first character is larger
        (or smaller), or equal too if same."""
        inside = pos > 0
        c = np.asarray(self.text[np.maximum(pos - 1, 0)]).astype(np.int64)
        wanted = inside & ((c > key) if larger else (c < key)) if not same else inside & ((c >= key) if larger else (c <= key))
        at = np.flatnonzero(wanted)
        if since is None:
            if len(at):
                order = np.argsort(c[at].astype(self.text.dtype), kind="stable")  # few values: a radix sort
                chars, rows = c[at][order], pos[at][order] - 1
                edges = np.concatenate(([0], np.flatnonzero(np.diff(chars)) + 1, [len(chars)]))
                zero = np.zeros(len(rows), np.uint8)
                for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    queue.push(int(chars[a]), rows[a:b], zero[a:b])
            return
        lowest = int(lcp.min())
        if not len(at):
            np.minimum(since, lowest, out=since)
            return
        order = np.argsort(c[at].astype(np.uint8), kind="stable")
        where = at[order]
        chars = c[where]
        first = np.concatenate(([True], chars[1:] != chars[:-1]))
        low = np.where(first, 0, np.concatenate(([0], where[:-1] + 1)))
        least = least_between(lcp, low, where)
        least[first] = np.minimum(least[first], since[chars[first]])
        np.minimum(since, lowest, out=since)
        last = np.concatenate((first[1:], [True]))
        tail = np.minimum.accumulate(lcp[::-1])[::-1]
        ends = where[last]
        since[chars[last]] = np.where(ends + 1 < len(lcp), np.append(tail, 255)[np.minimum(ends + 1, len(lcp))], 255)
        new = np.minimum(self.cap, least.astype(np.int64) + 1).astype(np.uint8)
        rows = pos[where] - 1
        edges = np.concatenate((np.flatnonzero(first), [len(chars)]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            queue.push(int(chars[a]), rows[a:b], new[a:b])

    def induce(self, seeds: Runs, lcps: bool) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
        """(character, smaller type, suffixes, common prefix with the one given before) in falling order.
        seeds: by first character, the LMS suffixes in rising order."""
        rising, kept = Runs(self.folder, 1, self.held), Runs(self.folder, 0, self.held)
        since = np.full(256, 255, np.uint8) if lcps else None
        rising.push(int(self.text[self.n - 1]), np.array([self.n - 1]), np.zeros(1, np.uint8))
        pending = sorted(seeds.parts, reverse=True)
        chars = []
        while rising.heap or pending:
            key = min(x for x in (rising.next_key(), pending[-1] if pending else None) if x is not None)
            chars.append(key)
            last, fresh = -1, True
            if rising.next_key() == key:
                for pos, lcp in rising.drain(key):
                    if lcps and fresh:
                        lcp = lcp.copy()
                        lcp[0] = 0
                    fresh, last = False, int(pos[-1])
                    kept.push(key, pos, lcp)
                    self.scan(key, pos, lcp, rising, True, True, since)
            if pending and pending[-1] == key:
                pending.pop()
                begun = False
                for pos, lcp in seeds.drain(key):
                    if lcps and not begun:
                        lcp = lcp.copy()
                        lcp[0] = 0 if fresh else self.seam(last, int(pos[0]))
                    begun = True
                    self.scan(key, pos, lcp, rising, True, False, since)
        rising.close()
        falling = Runs(self.folder, -1, self.held)
        since = np.full(256, 255, np.uint8) if lcps else None
        while falling.heap or chars:
            key = max(x for x in (falling.next_key(), chars[-1] if chars else None) if x is not None)
            last, fresh = -1, True
            if falling.next_key() == key:
                for pos, lcp in falling.drain(key):
                    if lcps and fresh:
                        lcp = lcp.copy()
                        lcp[0] = 0
                    fresh, last = False, int(pos[-1])
                    yield key, True, pos, lcp
                    self.scan(key, pos, lcp, falling, False, True, since)
            if chars and chars[-1] == key:
                chars.pop()
                carried = None
                for pos, lcp in kept.backwards(key):
                    if lcps:
                        # A tuple has the prefix shared with the one below it; it is due one later.
                        begin = carried if carried is not None else (0 if fresh else self.seam(last, int(pos[0])))
                        carried = int(lcp[-1])
                        lcp = np.concatenate(([begin], lcp[:-1])).astype(np.uint8)
                    yield key, False, pos, lcp
                    self.scan(key, pos, lcp, falling, False, False, since)
        falling.close()
        kept.close()

    def by_char(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> Runs:
        out = Runs(self.folder, 0, self.held)
        for pos, lcp in blocks:
            raw = np.asarray(self.text[pos])
            c, order = raw.astype(np.int64), np.argsort(raw, kind="stable")
            edges = np.concatenate(([0], np.flatnonzero(np.diff(c[order])) + 1, [len(c)]))
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                out.push(int(c[order[a]]), pos[order[a:b]], lcp[order[a:b]])
        return out

    def same_until(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """Length of the common prefix of the suffixes a and b, pair by pair, up to each limit."""
        out = np.zeros(len(a), np.int64)
        limit = np.minimum(limit, self.n - np.maximum(a, b))
        at = np.flatnonzero(limit > 0)
        if self.text.dtype == np.uint8 and self.n >= 8:
            # Eight characters at a time, read as one number with the first character highest.
            words = np.ndarray((self.n - 7,), ">u8", self.text.data, 0, (1,))
            far = np.maximum(a, b)
            while len(at := at[far[at] + out[at] < len(words)]):
                differ = words[a[at] + out[at]].astype(np.uint64) ^ words[b[at] + out[at]].astype(np.uint64)
                same = differ == 0
                run = np.full(len(at), 8, np.int64)
                # The highest bit that differs is in the first byte that does.
                run[~same] = 7 - (np.frexp((differ[~same] >> np.uint64(8)).astype(np.float64))[1] + 7) // 8
                high = differ[~same] >= np.uint64(1 << 56)
                run[np.flatnonzero(~same)[high]] = 0
                out[at] = np.minimum(out[at] + run, limit[at])
                at = at[same & (out[at] < limit[at])]
            at = np.flatnonzero((out < limit) & (far + out >= self.n - 7))
        while len(at):
            alike = np.asarray(self.text[a[at] + out[at]]) == np.asarray(self.text[b[at] + out[at]])
            at = at[alike]
            out[at] += 1
            at = at[out[at] < limit[at]]
        return out

    def sorted_lms(self) -> np.ndarray:
        """All LMS suffixes in rising order (to the depth that the cap needs)."""
        found = [b for b in self.lms_blocks()][::-1]
        lms = np.concatenate(found) if found else np.zeros(0, np.int64)
        m = len(lms)
        if m < 2:
            return lms
        none = np.zeros(BLOCK, np.uint8)
        seeds = self.by_char((lms[i : i + BLOCK], none[: len(lms[i : i + BLOCK])]) for i in range(0, m, BLOCK))
        order = []
        for key, small, pos, _ in self.induce(seeds, False):
            if small:
                left = np.asarray(self.text[np.maximum(pos - 1, 0)])
                order.append(pos[(pos > 0) & (left > key)])
        seeds.close()
        order = np.concatenate(order)[::-1]
        # Names: equal substrings, from an LMS character to the next one, share one.
        length = np.append(np.diff(lms) + 1, self.n - lms[-1] + 1)
        place = np.empty(self.n, np.int32 if m < 1 << 31 else np.int64)
        place[lms] = np.arange(m)
        which = place[order]
        mine = length[which]
        new = np.ones(m, bool)
        for i in range(1, m, BLOCK):
            j = min(m, i + BLOCK)
            alike = mine[i:j] == mine[i - 1 : j - 1]
            k = np.flatnonzero(alike) + i
            shared = self.same_until(order[k], order[k - 1], mine[k])
            new[k] = shared < mine[k]
        names = np.cumsum(new) - 1
        string = np.empty(m, np.int64)
        string[which] = names
        if names[-1] + 1 == m:
            return order
        if m <= self.in_memory:
            return lms[doubled(string, self.cap)]
        below = Sorter(string, self.folder, 0, self.held, self.in_memory)
        found = [pos for _, _, pos, _ in below.all()]
        return lms[np.concatenate(found)[::-1]]

    def all(self) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
        lms = self.sorted_lms()

        def blocks():
            for i in range(0, len(lms), BLOCK):
                pos = lms[i : i + BLOCK]
                if not self.cap:
                    yield pos, np.zeros(len(pos), np.uint8)
                    continue
                before = np.concatenate((lms[max(0, i - 1) : i] if i else pos[:1], pos[:-1]))
                lcp = self.same_until(pos, before, np.full(len(pos), self.cap))
                if i == 0:
                    lcp[0] = 0
                yield pos, lcp.astype(np.uint8)

        seeds = self.by_char(blocks())
        yield from self.induce(seeds, bool(self.cap))
        seeds.close()

    def falling(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All suffixes from the largest to the smallest, each with its common prefix with the one given
        before it, up to the cap."""
        if self.n:
            for _, _, pos, lcp in self.all():
                yield pos, lcp


def doubled(string: np.ndarray, cap: int) -> np.ndarray:
    """Order of a name string's suffixes by their first names, as many as the cap's characters need (a
    name stands for two characters at least); all of them if cap is 0. Each round looks only at suffixes
    that others still tie with."""
    m, h = len(string), 1
    order = np.argsort(string, kind="stable")
    rank = np.empty(m, np.int64)  # place of the first suffix of the same first names
    new = np.concatenate(([True], np.diff(string[order]) != 0))
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(m), 0))
    while not cap or h < cap:
        alone = new & np.append(new[1:], True)
        at = np.flatnonzero(~alone)  # places in the order that are shared
        if not len(at):
            break
        tied = order[at]
        right = np.where(tied + h < m, rank[np.minimum(tied + h, m - 1)] + 1, 0)
        by = np.argsort(rank[tied] * (m + 1) + right, kind="stable")
        tied, right = tied[by], right[by]
        order[at] = tied
        split = np.concatenate(([True], (np.diff(right) != 0) | (np.diff(rank[tied]) != 0)))
        new[at] = split
        rank[tied] = at[np.maximum.accumulate(np.where(split, np.arange(len(at)), 0))]
        h *= 2
    return order
