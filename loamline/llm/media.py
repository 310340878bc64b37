"""Local image descriptors for media columns: cropped and edited copies.

An image (portable graymap or pixmap, or PNG of 8 bits a channel) is scaled down by halves; corners are
local maxima of the Harris response at each scale; the patch around each is turned by the direction of
its intensity centroid and read as 128 comparisons of pixel pairs. Descriptors are cut into four 32-bit
words, one table each, so two that differ in up to three bits share one. Images that share a word are
candidates, and a pair of them is decided by all its corners: those that share a word and are close by the
Hamming distance vote for a similarity transform (scale step, turn, shift), and enough different corners
must agree on one. Of each word all images first meet the same few; then images in different parts
that share enough words are compared, group by group, each image's corners sent once a group, so that
rows grow with the images and not with the square of a group of edited copies. Images alike in every
byte are one from the start.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, drop, pick
from .graph import connected_components

SCALES = 2
RADIUS = 6
TURNS = 16
TESTS = 128
LEAST_RESPONSE = 2.0e5
APART = 12
LEAST_VOTES = 4
#: Shifts within so many pixels of each other agree.
GRID = 3
#: An image of more pixels is not read: it would not fit a task.
MOST_PIXELS = 1 << 26


def decode(raw: bytes | None) -> np.ndarray | None:
    """Gray values as rows of floats, or None for null, empty or unreadable data, and for what isn't read:
    palettes, 16 bits a channel, interlaced images, other formats, more than MOST_PIXELS pixels."""
    try:
        if not raw:
            return None
        if raw[:2] in (b"P5", b"P6"):
            head, at = [], 2
            while len(head) < 3:
                while raw[at : at + 1].isspace():
                    at += 1
                if raw[at : at + 1] == b"#":
                    at = raw.index(b"\n", at)
                    continue
                end = at
                while raw[end : end + 1].isdigit():
                    end += 1
                head.append(int(raw[at:end]))
                at = end
            width, height, top = head
            depth = 1 if raw[:2] == b"P5" else 3
            if width * height > MOST_PIXELS:
                return None
            pixels = np.frombuffer(raw, np.uint8, width * height * depth, at + 1).reshape(height, width, depth)
            return pixels.mean(2, dtype=np.float32) * (255.0 / top) if 0 < top < 256 and pixels.size else None
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(raw)
    except (ValueError, IndexError, TypeError, OverflowError, struct.error, zlib.error):
        pass
    return None


def _png(raw: bytes) -> np.ndarray | None:
    at, data, head = 8, b"", None
    while at < len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data += body
        at += 12 + size
    width, height, bits, color, _, _, laced = head
    depth = {0: 1, 2: 3, 4: 2, 6: 4}.get(color)
    if bits != 8 or depth is None or laced or not 0 < width * height <= MOST_PIXELS:
        return None
    size = height * (1 + width * depth)
    lines = np.frombuffer(zlib.decompressobj().decompress(data, size), np.uint8).reshape(height, 1 + width * depth)
    out = np.zeros((height + 1, (width + 1) * depth), np.uint8)
    for y in range(height):
        how, line, up, now = int(lines[y, 0]), lines[y, 1:], out[y], out[y + 1]
        if how == 0:
            now[depth:] = line
        elif how == 2:
            now[depth:] = line + up[depth:]
        else:
            for x in range(depth, len(now)):
                a, b, c = int(now[x - depth]), int(up[x]), int(up[x - depth])
                near = a if how == 1 else (a + b) // 2 if how == 3 else min((a, b, c), key=lambda v: abs(a + b - c - v))
                now[x] = (int(line[x - depth]) + near) & 255
    pixels = out[1:, depth:].reshape(height, width, depth)
    return pixels[:, :, : 1 if depth < 3 else 3].mean(2, dtype=np.float32)


def _framed(a: np.ndarray, r: int, value: float) -> np.ndarray:
    out = np.full((a.shape[0] + 2 * r, a.shape[1] + 2 * r), value)
    out[r:-r, r:-r] = a
    return out


def _sums(a: np.ndarray) -> np.ndarray:
    """Sum over the nine pixels around each; beyond the edge counts as 0."""
    p = _framed(a, 1, 0.0)
    rows = p[:-2] + p[1:-1] + p[2:]
    return rows[:, :-2] + rows[:, 1:-1] + rows[:, 2:]


def _peak(a: np.ndarray, r: int) -> np.ndarray:
    """Largest value in the square of radius r around each pixel."""
    p = _framed(a, r, -np.inf)
    rows = np.maximum.reduce([p[k : k + a.shape[0]] for k in range(2 * r + 1)])
    return np.maximum.reduce([rows[:, k : k + a.shape[1]] for k in range(2 * r + 1)])


def _layout() -> tuple[np.ndarray, np.ndarray]:
    """By turn, the offsets of the tests' two pixels: (turn, test, 2) each. Drawn once from a fixed seed."""
    rng = np.random.default_rng(7)
    ends = np.clip(rng.normal(0, RADIUS / 2.2, (2, TESTS, 2)), -RADIUS + 1, RADIUS - 1)
    angle = np.arange(TURNS) * 2 * np.pi / TURNS
    turn = np.stack([np.stack([np.cos(angle), -np.sin(angle)], 1), np.stack([np.sin(angle), np.cos(angle)], 1)], 1)
    return tuple(np.clip(np.rint(np.einsum("tij,nj->tni", turn, e)), -RADIUS, RADIUS).astype(np.int64) for e in ends)


FIRST_END, SECOND_END = _layout()
_Y, _X = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1]
DISC = (_X**2 + _Y**2 <= RADIUS**2).astype(np.float32)


#: Pixels of images of one width that are looked at together; a larger image is alone.
TILE = 1 << 16


def corners(image: np.ndarray | None) -> tuple[np.ndarray, ...]:
    """(scale, x, y, turn, descriptor as four unsigned words) of all corners."""
    return corners_of([image])[0]


def corners_of(images: list[np.ndarray | None]) -> list[tuple[np.ndarray, ...]]:
    """corners() of each image. Images of one width stand below each other, so far apart that none is in
    the reach of another, and are looked at in one pass of array operations."""
    none = (*(np.zeros(0, np.int64) for _ in range(4)), np.zeros((0, 4), np.int64))
    out, tiles = [none] * len(images), {}
    for k, image in enumerate(images):
        if image is not None and min(image.shape) >= 1:
            of_width = tiles.setdefault(image.shape[1], [[]])
            if of_width[-1] and sum(images[i].shape[0] + RADIUS for i in of_width[-1]) * image.shape[1] >= TILE:
                of_width.append([])
            of_width[-1].append(k)
    for tile in (tile for of_width in tiles.values() for tile in of_width):
        owner, *found = _tile_corners([images[k] for k in tile])
        order = np.argsort(owner, kind="stable")
        ends = np.cumsum(np.bincount(owner, minlength=len(tile)))[:-1]
        for k, *parts in zip(tile, *(np.split(f[order], ends) for f in found), strict=True):
            out[k] = tuple(parts)
    return out


def _tile_corners(images: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """(number of the image, scale, x, y, turn, words) of all corners of images of one width, scale by scale."""
    found = []
    numbers, heights = np.arange(len(images)), np.array([len(image) for image in images])
    # Doubles hold all sums of these quarters exactly, so a patch gives the same wherever it stands.
    lines = np.floor(np.concatenate(images)).astype(np.float64)
    for scale in range(SCALES):
        first = np.cumsum(heights + RADIUS) - heights
        at = np.repeat(first - np.cumsum(heights) + heights, heights) + np.arange(len(lines))
        image = np.full((int(first[-1] + heights[-1]), lines.shape[1]), 128.0)
        image[at] = lines
        of, above, below = np.full(len(image), -1), np.arange(len(image)), np.arange(len(image))
        of[at] = np.repeat(np.arange(len(heights)), heights)
        above[at], below[at] = np.maximum(at - 1, np.repeat(first, heights)), np.minimum(at + 1, np.repeat(first + heights - 1, heights))
        p = np.concatenate((image[:, :1], image, image[:, -1:]), 1)
        dx, dy = (p[:, 2:] - p[:, :-2]) / 2, (image[below] - image[above]) / 2
        xx, yy, xy = _sums(dx * dx), _sums(dy * dy), _sums(dx * dy)
        response = xx * yy - xy * xy - 0.0625 * (xx + yy) ** 2
        response[of < 0] = -np.inf
        y, x = np.nonzero((response >= _peak(response, 3)) & (response > LEAST_RESPONSE))
        if len(y):
            p = _framed(image, RADIUS, 128.0)
            patch = np.lib.stride_tricks.sliding_window_view(p, (2 * RADIUS + 1, 2 * RADIUS + 1))[y, x] - 128
            turn = np.rint(np.arctan2((patch * (DISC * _Y)).sum((1, 2)), (patch * (DISC * _X)).sum((1, 2))) * TURNS / (2 * np.pi)).astype(np.int64) % TURNS
            a, b = FIRST_END[turn] + RADIUS, SECOND_END[turn] + RADIUS
            rows = np.arange(len(y))[:, None]
            bits = patch[rows, a[..., 1], a[..., 0]] < patch[rows, b[..., 1], b[..., 0]]
            words = np.packbits(bits, axis=1).view(">u4").astype(np.int64)
            found.append((numbers[of[y]], np.full(len(y), scale), x, y - first[of[y]], turn, words))
        # Halves: an odd last line or column has none.
        left, w = heights >= 2, lines.shape[1] // 2 * 2
        if not left.any() or not w:
            break
        top = np.repeat(np.cumsum(heights) - heights, heights // 2)
        numbers, heights = numbers[left], heights[left] // 2
        top = top + 2 * (np.arange(len(top)) - np.repeat(np.cumsum(heights) - heights, heights))
        lines = (lines[top, 0:w:2] + lines[top + 1, 0:w:2] + lines[top, 1:w:2] + lines[top + 1, 1:w:2]) / 4
    if not found:
        return (*(np.zeros(0, np.int64) for _ in range(5)), np.zeros((0, 4), np.int64))
    return tuple(np.concatenate([f[k] for f in found]) for k in range(6))


#: Bits of a packed place: turn, x and y; the scale is above them.
TURN_BITS, SIDE_BITS = 4, 24
#: Bits of a key: a table and its word.
KEY_BITS = 34
#: A corner as it is kept: its packed place and its four words.
CORNER = np.dtype([("place", "<i8"), ("words", "<u4", 4)])
#: Images of a key that all others meet first, and how many of those met most are decided.
HUBS, MOST_MET = 4, 2
#: Images of a block that is compared at once.
BLOCK = 1024
#: Rows of a key up to which they are compared with each other before anything else.
FEW = 256
#: Corners of the groups that are read together, and corner pairs that are looked at together.
TOGETHER, PAIRS = 1 << 16, 1 << 15


def _corner_lists(batches):
    """Rows of (id, digest, shown, image) with the image's corners in its place; they are null for an image
    without any or that the task lately had, and where there is no id."""
    seen = set()
    for batch in batches:
        for i in range(0, batch.num_rows, 128):
            part = batch.slice(i, 128)
            digests, raws = part.column(1).to_pylist(), part.column(3).to_pylist()
            fresh, lists = [], [None] * part.num_rows
            for k, known in enumerate(part.column(0).is_valid().to_pylist()):
                if known and raws[k] and digests[k] not in seen:
                    if len(seen) >= 1 << 16:
                        seen.clear()
                    seen.add(digests[k])
                    fresh.append(k)
            for k, (scale, x, y, turn, words) in zip(fresh, corners_of([decode(raws[k]) for k in fresh]), strict=True):
                if len(scale):
                    held = np.zeros(len(scale), CORNER)
                    held["place"] = (((scale << SIDE_BITS | x) << SIDE_BITS | y) << TURN_BITS) | turn
                    held["words"] = words
                    lists[k] = held.tobytes()
            yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(3)), pa.array(lists, pa.binary())], names=["id", "digest", "shown", "corners"])


def _words(batches, tables=range(4)):
    """A row a corner and table: the table and its word in one number, the image, the corner's number."""
    tables = np.array(tables)
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            nodes = batch.column(0).slice(i, 1024).to_numpy()
            lists = [np.frombuffer(raw, CORNER) for raw in batch.column(1).slice(i, 1024).to_pylist()]
            if not lists:
                continue
            counts = [len(held) for held in lists]
            words = np.concatenate(lists)["words"][:, tables].astype(np.int64) | tables << 32
            spot = np.concatenate([np.arange(n, dtype=np.int32) for n in counts])
            yield pa.RecordBatch.from_arrays([pa.array(words.ravel()), pa.array(np.repeat(np.repeat(nodes, counts), len(tables))), pa.array(np.repeat(spot, len(tables)))], names=["key", "node", "spot"])


def _kept_corners(batches):
    """Rows of (node, digest, corners, spots) with only the corners of these numbers, in order."""
    for batch in batches:
        lists = []
        for raw, spots in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            lists.append(np.frombuffer(raw, CORNER)[np.unique(np.array(spots, np.int64))].tobytes())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lists, pa.binary()), *batch.columns[4:]], names=[n for n in batch.schema.names if n != "spots"])


def _entries(batches):
    """Rows of (node, corners, entries) as a row an entry, with its corner's descriptor in two numbers. An entry is, from
    its low bits up, a key, whether it is one of few rows, and the corner's number; it becomes its place among those left."""
    for batch in batches:
        for i in range(0, batch.num_rows, 1024):
            part = batch.slice(i, 1024)
            nodes, words = part.column(0).to_numpy(), []
            counts, entries = part.column(2).value_lengths().to_numpy(), part.column(2).flatten().to_numpy()
            spot, at = (entries >> (KEY_BITS + 1)).astype(np.int32), 0
            for raw, n in zip(part.column(1).to_pylist(), counts.tolist(), strict=True):
                spot[at : at + n] = np.unique(spot[at : at + n], return_inverse=True)[1]
                words.append(np.frombuffer(raw, CORNER)["words"][spot[at : at + n]])
                at += n
            if at:
                halves = np.ascontiguousarray(np.concatenate(words)).view("<i8")
                key, few = entries & ((1 << KEY_BITS) - 1), (entries >> KEY_BITS & 1).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (key, np.repeat(nodes, counts), spot, few, halves[:, 0].copy(), halves[:, 1].copy())], names=["key", "node", "spot", "few", "one", "two"])


def _near(key: np.ndarray, node: np.ndarray, few: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether a corner of another image with the same key differs in at most APART bits, for rows in order of the
    key; true where the key isn't one of few rows."""
    near, at, d = ~few, np.flatnonzero(few), 0
    one, two = one.view(np.uint64), two.view(np.uint64)  # of a signed number the bits of its absolute value would count
    while len(at):
        d += 1
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        other = at + d
        close = at[(np.bitwise_count(one[at] ^ one[other]) + np.bitwise_count(two[at] ^ two[other]) <= APART) & (node[at] != node[other])]
        near[close] = near[close + d] = True
    return near


def _near_rows(batches):
    """The rows (key, node, spot) of _near() of rows in order of the key."""
    held = None

    def of(part):
        near = _near(part[0], part[1], *part[3:])
        return pa.RecordBatch.from_arrays([pa.array(v[near]) for v in part[:3]], names=["key", "node", "spot"])

    for batch in batches:
        part = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)]
        part = part if held is None else [np.concatenate(both) for both in zip(held, part, strict=True)]
        if len(part[0]):
            # The last key may go on in the next batch.
            end = int(np.searchsorted(part[0], part[0][-1])) if part[3][-1] else len(part[0])
            held = [v[end:] for v in part]
            yield of([v[:end] for v in part])
    if held is not None:
        yield of(held)


def _shared(groups: np.ndarray, label: np.ndarray, lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Per corner and table a number that equal words of a group have in common, and whether another part of
    the group has that word too."""
    owner = np.repeat(np.arange(len(lists)), [len(held) for held in lists])
    key = (groups[owner][:, None] << 34 | np.arange(4) << 32 | np.concatenate(lists)["words"].astype(np.int64)).ravel()
    order = np.argsort(key, kind="stable")
    sorted_key, part = key[order], np.repeat(label[owner], 4)[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))
    mixed = np.minimum.reduceat(part, starts) != np.maximum.reduceat(part, starts)
    shared = np.empty(len(key), bool)
    shared[order] = np.repeat(mixed, np.diff(np.append(starts, len(key))))
    return key, shared


def _agreed(pair: np.ndarray, cell: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Pairs of images of which LEAST_VOTES corners of each are in one cell."""
    _, code = np.unique(pair, return_inverse=True)
    for side in cell:
        side = side - side.min()
        _, code = np.unique(code * (int(side.max()) + 1) + side, return_inverse=True)
    enough = np.ones(int(code.max()) + 1, bool)
    for end in (p, q):
        size = int(end.max()) + 1
        enough &= np.bincount(np.unique(code * size + end) // size, minlength=len(enough)) >= LEAST_VOTES
    return np.unique(pair[enough[code]])


def linked(groups: list[int], parts: list[int], lists: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Numbers of images of a group that are linked, until no two parts of it are left to join. Two images are
    linked if LEAST_VOTES corners of each, which pairwise share a table's word and differ in at most APART bits,
    agree on one similarity transform: equal scale step and turn, and shifts in one cell of 2 * GRID pixels on
    one of four grids that are shifted by GRID, so that shifts within GRID of each other share a cell.

    Groups are numbered from 0. All of them are compared at once, PAIRS corner pairs at a time."""
    groups, numbers = np.array(groups, np.int64), np.arange(len(lists))
    label = np.unique(groups * len(lists) + np.unique(np.array(parts), return_inverse=True)[1], return_inverse=True)[1]
    while True:  # those without hope go, which may leave others without
        key, shared = _shared(groups, label, lists)
        ends = np.cumsum([len(held) for held in lists])
        hope = np.add.reduceat(shared.reshape(-1, 4).any(1).astype(np.int64), np.concatenate(([0], ends[:-1]))) >= LEAST_VOTES
        if not hope.any():
            return [], []
        if hope.all():
            break
        groups, label, numbers, lists = groups[hope], label[hope], numbers[hope], [lists[k] for k in np.flatnonzero(hope)]
    every = np.concatenate(lists)
    owner = np.repeat(np.arange(len(lists)), [len(held) for held in lists])
    words, place = every["words"], every["place"]
    turn, side = place & ((1 << TURN_BITS) - 1), (1 << SIDE_BITS) - 1
    scale = place >> (TURN_BITS + 2 * SIDE_BITS)
    x, y = ((place >> shift & side) * 2.0**scale for shift in (TURN_BITS + SIDE_BITS, TURN_BITS))
    # In the order of words and parts, a corner's partners are those of its word in the parts before its own.
    entries = np.flatnonzero(shared)
    key, part = key[entries], label[owner[entries >> 2]]
    order = np.lexsort((part, key))
    another = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    fresh = another | np.concatenate(([True], part[order][1:] != part[order][:-1]))
    spots = np.arange(len(order))
    low, many = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    low[order] = np.maximum.accumulate(np.where(another, spots, 0))
    many[order] = np.maximum.accumulate(np.where(fresh, spots, 0))
    many -= low
    order, total = entries[order], np.concatenate(([0], np.cumsum(many)))
    edge = np.searchsorted(entries, 4 * np.concatenate(([0], ends)))

    def met(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Close corners of the entries from lo to hi and their partners, each pair by its first table."""
        n = many[lo:hi]
        q = np.repeat(entries[lo:hi], n)
        p = order[np.arange(len(q)) - np.repeat(total[lo:hi] - total[lo], n) + np.repeat(low[lo:hi], n)]
        table, q, p = q & 3, q >> 2, p >> 2
        apart = label[owner[q]] != label[owner[p]]
        table, q, p = table[apart], q[apart], p[apart]
        bits = words[p] ^ words[q]
        fits = (np.bitwise_count(bits).sum(1) <= APART) & ((bits == 0).argmax(1) == table)
        return p[fits], q[fits]

    a, b, i = [], [], 0
    while i < len(lists):
        j = max(i + 1, int(np.searchsorted(total[edge], total[edge[i]] + PAIRS, "right")) - 1)
        found, lo = [], int(edge[i])
        while lo < edge[j]:
            hi = min(int(edge[j]), max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, "right")) - 1))
            found.append(met(lo, hi))
            lo = hi
        i = j
        if not found:
            continue
        p, q = (np.concatenate([pairs[k] for pairs in found]) for k in (0, 1))
        pair = owner[q] * len(lists) + owner[p]
        _, which, n = np.unique(pair, return_inverse=True, return_counts=True)
        often = n[which] >= LEAST_VOTES
        p, q, pair = p[often], q[often], pair[often]
        if not len(p):
            continue
        step, turned = scale[q] - scale[p], (turn[q] - turn[p]) % TURNS
        _, which, n = np.unique((pair * (2 * SCALES) + step + SCALES) * TURNS + turned, return_inverse=True, return_counts=True)
        often = n[which] >= LEAST_VOTES
        p, q, pair, step, turned = p[often], q[often], pair[often], step[often], turned[often]
        if not len(p):
            continue
        angle, size = turned * (2 * np.pi / TURNS), 2.0**step
        sx = x[q] - size * (x[p] * np.cos(angle) - y[p] * np.sin(angle))
        sy = y[q] - size * (x[p] * np.sin(angle) + y[p] * np.cos(angle))
        across, down = ([np.floor((shift + u * GRID) / (2 * GRID)).astype(np.int64) for u in (0, 1)] for shift in (sx, sy))
        agreed = np.concatenate([_agreed(pair, [step, turned, across[u], down[v]], p, q) for u in (0, 1) for v in (0, 1)])
        for one, other in zip(*(side.tolist() for side in np.divmod(np.unique(agreed), len(lists))), strict=True):
            if label[one] != label[other]:
                a.append(int(numbers[one]))
                b.append(int(numbers[other]))
                label[label == label[other]] = label[one]
    return a, b


def _edges(groups: list[int], nodes: list[int], parts: list[int], lists: list[bytes]) -> pa.RecordBatch:
    a, b = linked(groups, parts, [np.frombuffer(raw, CORNER) for raw in lists])
    return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in a], pa.int64()), pa.array([nodes[i] for i in b], pa.int64())], names=["a", "b"])


def _compared(rows):
    """Edges of rows of (key, node, part, corners) in order of the key; whole groups are compared together until
    they have TOGETHER corners."""
    last, size, groups, nodes, parts, lists = None, 0, [], [], [], []
    for at, node, part, raw in rows:
        if at != last and size >= TOGETHER:
            yield _edges(groups, nodes, parts, lists)
            size, groups, nodes, parts, lists = 0, [], [], [], []
        groups.append((groups[-1] + (at != last)) if groups else 0)
        last = at
        size += len(raw) // CORNER.itemsize
        nodes.append(node)
        parts.append(part)
        lists.append(raw)
    if nodes:
        yield _edges(groups, nodes, parts, lists)


def _pairs(batches):
    def rows():
        for batch in batches:
            for x, y, p, q in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                yield (x, y), x, x, p
                yield (x, y), y, y, q

    return _compared(rows())


def _groups(batches):
    """Over rows of (key, i, j, node, part, corners) in order."""

    def rows():
        for batch in batches:
            for *at, node, part, raw in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                yield at, node, part, raw

    return _compared(rows())


def _first_links(members: DataFrame, images: DataFrame) -> DataFrame:
    """Edges of each image with those it meets most of a few images of each of its keys, the least by each of
    some hashes, so that keys with like members have like ones to meet."""
    hubs = members.groupBy("key").agg(F.array_distinct(F.array(*(F.min_by("node", F.xxhash64("node", F.lit(k))) for k in range(HUBS)))).alias("hubs"))
    met = members.join(hubs, "key").select("node", F.explode("hubs").alias("hub")).where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("n"))
    most = met.groupBy("node").agg(*(F.max_by("hub", F.struct("n", F.xxhash64("hub", F.lit(k)))).alias(f"y{k}") for k in range(MOST_MET)))
    pairs = most.select("node", F.explode(F.array_distinct(F.array(*(f"y{k}" for k in range(MOST_MET))))).alias("y")).select(F.least("node", "y").alias("x"), F.greatest("node", "y").alias("y")).distinct()
    left, right = (images.select(F.col("node").alias(n), F.col("corners").alias(c)) for n, c in (("x", "p"), ("y", "q")))
    return cut(pairs.join(left, "x").join(right, "y").select("x", "y", "p", "q").mapInArrow(_pairs, "a long, b long"))


def _rarest(rows: DataFrame) -> DataFrame:
    """rows (key, node, spot, part) without each image's most frequent words as long as they are words of fewer
    than LEAST_VOTES of its corners. Linked images share words of LEAST_VOTES corners of each; the first of these
    words in an order that is the same for all images is left in both. Words of about as many rows are in the
    order of the corner where they are first, so that a corner's words go together."""
    order = F.struct(F.floor(F.log2(F.count("*"))).alias("n"), F.min(F.struct("node", "spot")).alias("at"), F.col("key").alias("last"))
    ordered = cut(rows.join(rows.groupBy("key").agg(order.alias("rank")), "key"))
    tops = ordered.groupBy("node", "spot").agg(F.max("rank").alias("top"))
    least = tops.groupBy("node").agg(F.sort_array(F.collect_list("top"), False).alias("tops")).select("node", F.get("tops", F.lit(LEAST_VOTES - 1)).alias("top"))
    return ordered.join(least, "node").where(F.col("rank") <= F.col("top")).select(*rows.columns)


def _other_links(members: DataFrame, parts: DataFrame, images: DataFrame) -> DataFrame:
    """Edges that join the parts of each key's members as all pairs of them would. Only images with
    LEAST_VOTES corners whose keys another part has too can be linked, and share one of their rarer keys; of
    keys with the same such members one is enough. A key of more than BLOCK images is cut into blocks, each of which meets each."""
    rows = members.join(parts.toDF("of", "part"), F.col("node") == F.col("of"), "left").select("key", "node", "spot", F.coalesce("part", "node").alias("part"))
    mixed = rows.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    shared = cut(rows.join(mixed, "key", "left_semi"))
    enough = shared.select("node", "spot").distinct().groupBy("node").count().where(F.col("count") >= LEAST_VOTES).select("node")
    rows = cut(shared.join(enough, "node", "left_semi"))
    drop(shared)
    placed = cut(_rarest(rows).select("key", "node", "part").distinct())
    drop(rows)
    mark = lambda seed: F.sum(F.xxhash64("node", F.lit(seed)).cast("decimal(38,0)"))
    sizes = placed.groupBy("key").agg(F.count("*").alias("members"), mark(0).alias("one"), mark(1).alias("two"), F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high")
    kept = sizes.groupBy("members", "one", "two").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("members") / BLOCK).alias("n"))
    k = F.pmod(F.xxhash64("node"), F.col("n"))
    dealt = placed.join(kept, "key").withColumn("k", k)
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda j: F.struct(F.least("k", j).alias("i"), F.greatest("k", j).alias("j")))
    named = dealt.select("key", F.explode(meets).alias("at"), F.col("node").alias("of"), "part")
    held = named.join(images.select("node", "corners"), F.col("of") == F.col("node")).select("key", "at.i", "at.j", "node", "part", "corners")
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = cut(held.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(_groups, "a long, b long"))
    drop(placed)
    return out


def _with_near_corners(images: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, node, spot) of corners that have the word in common with one of another image that differs in at most
    APART bits, and (node, digest, corners) of images with LEAST_VOTES such corners, which alone can be linked, with
    these corners. A word alone says little in a large corpus, where many that share it are not close. All rows of
    words of more than FEW rows stay."""
    found = []
    for tables in ((0, 1), (2, 3)):  # half at a time, for what lies on disk at once
        keyed = images.select("node", "corners").mapInArrow(lambda batches, tables=tables: _words(batches, tables), "key long, node long, spot int")
        # Most words are one image's alone; they are counted before anything else of them moves.
        counts = keyed.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"), F.count("*").alias("n")).where("low <> high")
        shared = cut(counts.select("key", (F.col("n") <= FEW).cast("long").alias("few")))
        found.append(cut(keyed.join(shared, "key")))
        drop(shared)
    entry = F.shiftleft(F.col("spot").cast("long"), KEY_BITS + 1).bitwiseOR(F.shiftleft("few", KEY_BITS)).bitwiseOR(F.col("key"))
    entries = found[0].unionByName(found[1]).select(F.col("node").alias("of"), entry.alias("entry")).groupBy("of").agg(F.collect_list("entry").alias("entries"))
    entries = entries.withColumn("spots", F.array_distinct(F.transform("entries", lambda e: F.shiftright(e, KEY_BITS + 1)))).where(F.size("spots") >= LEAST_VOTES)
    kept = images.join(entries, F.col("node") == F.col("of")).select("node", "digest", "corners", "spots", "entries")
    some = cut(kept.mapInArrow(_kept_corners, "node long, digest binary, corners binary, entries array<long>"))
    drop(*found, images)
    rows = some.select("node", "corners", "entries").mapInArrow(_entries, "key long, node long, spot int, few boolean, one long, two long")
    n = int(images.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "key", F.when(~F.col("few"), F.col("node"))).sortWithinPartitions("key")
    near = cut(dealt.mapInArrow(_near_rows, "key long, node long, spot int"))
    spots = near.groupBy(F.col("node").alias("of")).agg(F.collect_set("spot").alias("spots")).where(F.size("spots") >= LEAST_VOTES)
    left = some.select("node", "digest", "corners").join(spots, F.col("node") == F.col("of")).select("node", "digest", "corners", "spots")
    left = cut(left.mapInArrow(_kept_corners, "node long, digest binary, corners binary"))
    drop(some)
    return near, left


def image_copies(media: DataFrame, id_col: str = "doc_id", image_col: str = "image") -> DataFrame:
    """id, component_id (smallest id that links reach, itself included) and n_images (rows of that
    component) of each row.

    Null, empty and unreadable images are linked to nothing, as are images with too few corners unless
    they are alike in every byte. Rows with a null id, and rows that repeat one, come out as often as
    they go in; a null id belongs to no group. Ids must be whole numbers. An empty table gives an empty
    result; extra columns are left out.
    """
    rows = pick(media, id=id_col, image=image_col)
    shown = rows.select("id", F.unhex(F.sha2("image", 256)).alias("digest"), (F.octet_length("image") > 0).alias("shown"), "image")
    # An image is read once, for its digest and its corners.
    read = cut(shown.mapInArrow(_corner_lists, f"id {rows.schema['id'].dataType.simpleString()}, digest binary, shown boolean, corners binary"))
    once = read.where("corners is not null").groupBy("digest").agg(F.first("corners").alias("corners"))
    images = cut(once.withColumn("node", F.monotonically_increasing_id()))
    digests = cut(read.select("id", "digest", "shown"))
    drop(read)
    members, images = _with_near_corners(images)
    first = _first_links(members, images)
    parts = cut(connected_components(first))
    parts = cut(connected_components(first.unionByName(_other_links(members, parts, images))))
    known = images.select("digest", "node").join(parts.toDF("of", "part"), F.col("node") == F.col("of")).select(F.col("digest").alias("d"), "part")
    # Images alike in every byte that are linked to no other are a part of their own, told by the digest.
    whole = digests.where("id is not null and shown").join(known, F.col("digest") == F.col("d"), "left").groupBy("digest").agg(F.first("part").alias("part"), F.min("id").cast("long").alias("first"), F.count("*").alias("n"))
    group = cut(whole.withColumn("part", F.coalesce(F.col("part").cast("string"), F.hex("digest"))))
    lowest = group.groupBy("part").agg(F.min("first").alias("component_id"), F.sum("n").alias("n_images"))
    of = group.join(lowest, "part").select(F.col("digest").alias("d"), "component_id", "n_images")
    in_group = F.col("id").isNotNull() & F.col("shown")
    out = digests.where(in_group).join(of, F.col("digest") == F.col("d")).select("id", "component_id", "n_images")
    alone = digests.where(~F.coalesce(in_group, F.lit(False))).select("id", F.col("id").cast("long").alias("component_id"), F.lit(1).cast("long").alias("n_images"))
    return out.unionByName(alone).withColumnRenamed("id", id_col)


WIDTH = 32


def drawn(text: str | None) -> bytes:
    """The whole text as a graymap: a pixel a word, gray by the word's checksum, WIDTH words a row, each
    line of the text from a new row. A picture for tables that have none: edits move some pixels of a
    row, excerpts are crops."""
    rows = []
    for line in (text or "").split("\n"):
        # No word holds a newline, so all of a line's are encoded at once.
        words = "\n".join(line.split()).encode("utf-8", "surrogatepass").split(b"\n") if line else []
        grays = bytes(zlib.crc32(w) >> 24 for w in words) if words != [b""] else b""
        rows += [grays[at : at + WIDTH].ljust(WIDTH, b"\x80") for at in range(0, len(grays), WIDTH)]
    return b"P5 %d %d 255\n" % (WIDTH, len(rows)) + b"".join(rows) if rows else b""


def pictures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, image) with each row's whole text drawn; null, empty and blank texts have an empty image. Repeated
    rows come out as often as they go in; an empty table gives an empty result."""
    rows = pick(docs, id=id_col, text=text_col)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([drawn(t) for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "image"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, image binary").toDF(id_col, "image")
