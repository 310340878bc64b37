"""Exact-substring dedup over shards that are suffix-sorted by external induction.

Every ``length``-byte string (a window) is routed by content: its anchor is its leftmost k-gram of least
hash, so equal windows have equal anchors and meet in one shard, wherever they stand. Consecutive
windows with one anchor travel as one record of at most 2 * length - GRAM bytes. Anchors that occur once
can't hold a repeat and go no further than (hash, document, place); the others' records are
cut from the texts, alike ones are united as they leave and as they arrive (the earliest place is kept),
and each shard's records are put behind one another in a file and sorted by induced.Sorter. Neighbours
with a common prefix of ``length`` are one string; all but its earliest occurrence is removed. A shard's size is set by
the number of shards, which grows with the records; a record that copies share by the thousand is in
it once.
"""

from __future__ import annotations

import hashlib
import os
import shutil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, drop, pick, scratch_dir, text_bytes
from .induced import Sorter

LENGTH = 100
GRAM = 32
#: Bytes of a text that are hashed at a time; neighbours overlap by length - 1.
CHUNK = 1 << 20
PLACE_BITS = 21
#: Bytes of records that a shard is made for.
SHARD_BYTES = 12 << 20
#: Records that a task unites before they leave.
UNITED = 100_000


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first window start, last window start) of each run of windows with one anchor."""
    hashes, firsts, lasts = [], [], []
    for at in range(0, len(raw) - length + 1, CHUNK):
        part = np.frombuffer(raw[at : at + CHUNK + length - 1], np.uint8)
        n = len(part)
        words = np.ndarray((n - 7,), "<u8", part.data, 0, (1,)).astype(np.uint64)
        h = np.zeros(n - gram + 1, np.uint64)
        for k in range(0, gram, 8):
            h = (h ^ words[k : k + len(h)]) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)
            h ^= h >> np.uint64(29)
        low = (h & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(len(h), dtype=np.uint64)
        width, span = length - gram + 1, 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if width > span:
            low = np.minimum(low[: len(low) - (width - span)], low[width - span :])
        place = (low & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        edge = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        hashes.append(h[place[edge]].view(np.int64))
        firsts.append(edge + at)
        lasts.append(np.append(edge[1:], len(place)) - 1 + at)
    if not hashes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(firsts), np.concatenate(lasts)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, key (id, or the largest long for null), sum (0; of the text if rows share an id), text."""
    rows = pick(docs, id=id_col, text=text_col)
    if rows.schema["id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError("ids must be whole numbers: they say which copy is the earliest")
    keyed = rows.select("id", F.coalesce(F.col("id").cast("long"), F.lit((1 << 63) - 1)).alias("key"), F.lit(0).cast("long").alias("sum"), "text")
    return keyed.withColumn("sum", F.xxhash64("text")) if _has_repeated_rows(keyed) else keyed


def _anchor_rows(length: int):
    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                key, total, text = (part.column(k) for k in range(3))
                found = [anchors(text_bytes(t), length) for t in text.to_pylist()]
                counts = [len(h) for h, _, _ in found]
                if sum(counts):
                    cols = [np.concatenate([f[k] for f in found]) for k in range(3)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0]), pa.array(np.repeat(key.to_numpy(), counts)), pa.array(np.repeat(total.to_numpy(), counts)), pa.array(cols[1]), pa.array((cols[2] - cols[1]).astype(np.int32))], names=["h", "key", "sum", "first", "more"]
                    )

    return run


def _record_rows(length: int):
    """Records of the repeated anchors; a task unites alike ones and keeps the earliest place."""

    def run(batches):
        held: dict[tuple[int, bytes], tuple[int, int, int]] = {}

        def out():
            keys = list(held)
            places = list(held.values())
            yield pa.RecordBatch.from_arrays(
                [pa.array([h for h, _ in keys], pa.int64()), pa.array([r for _, r in keys], pa.binary()), *(pa.array([p[k] for p in places], pa.int64()) for k in range(3))], names=["h", "record", "key", "sum", "first"]
            )
            held.clear()

        for batch in batches:
            cols = [batch.column(k) for k in range(batch.num_columns)]
            for i in range(batch.num_rows):
                key, total, raw = cols[0][i].as_py(), cols[1][i].as_py(), text_bytes(cols[2][i].as_py())
                for h, first, more in zip(cols[3][i].values.to_numpy().tolist(), cols[4][i].values.to_numpy().tolist(), cols[5][i].values.to_numpy().tolist(), strict=True):
                    at = (h, raw[first : first + more + length])
                    place = (key, total, first)
                    old = held.get(at)
                    if old is None or place < old:
                        held[at] = place
                if len(held) >= UNITED:
                    yield from out()
        if held:
            yield from out()

    return run


def _sort_shard(length: int):
    """Over records in order of (h, record, place): for each different record its earliest place and which
    of its windows occur earlier in another record."""

    def run(batches):
        folder = scratch_dir()
        try:
            keys, totals, firsts, starts, size = [], [], [], [], 0
            last = None
            with open(os.path.join(folder, "text"), "wb") as f:
                for batch in batches:
                    h, record, key, total, first = (batch.column(k) for k in range(5))
                    new, pieces = [], []
                    for i, now in enumerate(zip(h.to_pylist(), record.to_pylist(), strict=True)):
                        if now != last:
                            last = now
                            new.append(i)
                            pieces.append(now[1])
                    if not new:
                        continue
                    # UTF-8 has no byte over 0xF4, so each may go up by one and 0 ends a record.
                    raw = np.frombuffer(b"\xff".join(pieces) + b"\xff", np.uint8) + np.uint8(1)
                    raw.tofile(f)
                    starts.append(size + np.concatenate(([0], np.cumsum([len(p) + 1 for p in pieces[:-1]], dtype=np.int64))))
                    size += len(raw)
                    for rows, col in ((keys, key), (totals, total), (firsts, first)):
                        rows.append(col.to_numpy()[new])
            if not size:
                return
            keys, totals, firsts, starts = (np.concatenate(x) for x in (keys, totals, firsts, starts))
            repeat = _repeats(np.memmap(os.path.join(folder, "text"), np.uint8, "r"), folder, length, keys, totals, firsts, starts)
            for at in range(0, len(keys), 50_000):
                end = min(len(keys), at + 50_000)
                low, high = int(starts[at]), int(starts[end]) if end < len(starts) else size
                marks = np.flatnonzero(np.diff(np.concatenate(([0], repeat[low:high], [0])).astype(np.int8))) + low
                begin, stop = marks[::2], marks[1::2]
                owner = np.searchsorted(starts, begin, "right") - 1
                counts = np.bincount(owner - at, minlength=end - at) if len(owner) else np.zeros(end - at, np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                a, b = begin - starts[owner] + firsts[owner], stop - 1 - starts[owner] + firsts[owner]
                yield pa.RecordBatch.from_arrays([pa.array(keys[at:end]), pa.array(totals[at:end]), pa.array(firsts[at:end]), pa.ListArray.from_arrays(offsets, pa.array(a)), pa.ListArray.from_arrays(offsets, pa.array(b))], names=["key", "sum", "first", "lows", "highs"])
        finally:
            shutil.rmtree(folder, ignore_errors=True)

    return run


def _repeats(text: np.ndarray, folder: str, length: int, keys: np.ndarray, totals: np.ndarray, firsts: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Flags, by place in the shard's text, of windows that another record has earlier."""
    flags = np.memmap(os.path.join(folder, "flags"), np.uint8, "w+", shape=(len(text),))
    ends = np.append(starts[1:], len(text)) - 1
    rank = np.empty(len(keys), np.int64)
    order = np.lexsort((totals, keys))
    rank[order] = np.cumsum(np.concatenate(([0], (np.diff(keys[order]) != 0) | (np.diff(totals[order]) != 0))))

    def settle(pos: np.ndarray, group: np.ndarray) -> None:
        owner = np.searchsorted(starts, pos, "right") - 1
        whole = pos + length <= ends[owner]
        pos, group, owner = pos[whole], group[whole], owner[whole]
        by = np.lexsort((pos - starts[owner] + firsts[owner], rank[owner], group))
        later = np.concatenate(([False], group[by][1:] == group[by][:-1])) if len(by) else np.zeros(0, bool)
        flags[pos[by[later]]] = 1

    open_pos: list[np.ndarray] = []  # the suffixes of the string that the last block ended in
    sorter = Sorter(text, folder, length)
    for pos, lcp in sorter.falling():
        joined = lcp >= length
        if open_pos and not joined.all():
            k = int(np.argmin(joined))
            whole = np.concatenate([*open_pos, pos[:k]])
            if len(whole) > 1:
                settle(whole, np.zeros(len(whole), np.int64))
            open_pos, pos, joined = [], pos[k:], joined[k:]
        elif open_pos:
            open_pos.append(pos)
            continue
        group = np.cumsum(~joined)
        tail = group == group[-1]
        open_pos = [pos[tail]]
        pos, group = pos[~tail], group[~tail]
        if len(pos):
            shared = np.concatenate((group[1:] == group[:-1], [False]))
            shared |= np.concatenate(([False], group[1:] == group[:-1]))
            settle(pos[shared], group[shared])
    if open_pos and sum(map(len, open_pos)) > 1:
        whole = np.concatenate(open_pos)
        settle(whole, np.zeros(len(whole), np.int64))
    return flags


def _kept_rows(length: int):
    """Per document: sizes, spans and the digest of what stays."""

    def run(batches):
        for batch in batches:
            out = {"n_bytes": [], "n_removed": [], "starts": [], "ends": [], "kept_sha256": []}
            col = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                raw = text_bytes(col["text"][i].as_py())
                first = col["firsts"][i].values
                if first is None:
                    starts = ends = np.zeros(0, np.int64)
                else:
                    starts, ends = covered(first.to_numpy(), col["mores"][i].values.to_numpy(), col["own"][i].as_py() or [], length)
                digest, at = hashlib.sha256(), 0
                for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                    digest.update(raw[at:a])
                    at = b
                digest.update(raw[at:])
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(int((ends - starts).sum()))
                out["starts"].append(starts.tolist())
                out["ends"].append(ends.tolist())
                out["kept_sha256"].append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays(
                [col["id"], pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["starts"], pa.list_(pa.int64())), pa.array(out["ends"], pa.list_(pa.int64())), pa.array(out["kept_sha256"], pa.string())], names=["id", "n_bytes", "n_removed", "starts", "ends", "kept_sha256"]
            )

    return run


def covered(first: np.ndarray, more: np.ndarray, own: list[dict], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal removed byte runs. first, more: the repeated anchors' window runs; own: those whose record
    is here first of all, with the windows that occur earlier in other records."""
    mine = {o["first"]: o for o in own}
    lows, highs = [], []
    for a, m in zip(first.tolist(), more.tolist(), strict=True):
        o = mine.get(a)
        if o is None:
            lows.append(a)
            highs.append(a + m + length)
        else:
            lows += o["lows"]
            highs += [b + length for b in o["highs"]]
    if not lows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    low, high = np.array(lows), np.array(highs)
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order])
    edge = np.concatenate(([True], low[1:] > high[:-1]))
    return low[edge], high[np.append(np.flatnonzero(edge)[1:] - 1, len(low) - 1)]


def repeated_substrings(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """id, n_bytes, n_removed, starts and ends (removed byte runs) and kept_sha256 of each row.

    A byte of the UTF-8 text is removed if a ``length``-byte string over it starts earlier too, in a
    document of a smaller id or in the same one. Null and empty texts have 0 bytes. A null id comes after
    all others. Rows that share an id are ordered by their texts' hashes; rows alike in id and text are
    one document, whose result each of them gets. Extra columns are left out; an empty table gives an
    empty result. Ids must be whole numbers.
    """
    if not GRAM + 8 <= length <= 254:
        raise ValueError(f"length must be from {GRAM + 8} to 254")
    rows = _keyed(docs, id_col, text_col)
    repeated = _has_repeated_rows(rows)
    spots = rows.select("key", "sum", "text").where(F.octet_length("text") >= length).mapInArrow(_anchor_rows(length), "h long, key long, sum long, first long, more int")
    spots = spots.distinct() if repeated else spots
    # Counted before they move, and joined back in a way that Spark can split: a common line's anchor is no task's alone.
    shared = cut(spots.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    again = spots.join(shared, "h", "left_semi")
    grouped = again.groupBy("key", "sum").agg(F.collect_list(F.struct("h", "first", "more")).alias("spots"))
    grouped = cut(grouped.select("key", "sum", F.col("spots.h").alias("hs"), F.col("spots.first").alias("firsts"), F.col("spots.more").alias("mores")))
    drop(shared)
    total = grouped.agg(F.sum(F.aggregate("mores", F.lit(0).cast("long"), lambda a, m: a + m + length))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total // shard_bytes) + 1)
    texts = rows.select("key", "sum", "text").dropDuplicates(["key", "sum"]) if repeated else rows.select("key", "sum", "text")
    held = texts.join(grouped, ["key", "sum"]).select("key", "sum", "text", "hs", "firsts", "mores")
    records = held.mapInArrow(_record_rows(length), "h long, record binary, key long, sum long, first long")
    shard = records.repartition(shards, "h").sortWithinPartitions("h", "record", "key", "sum", "first")
    found = shard.mapInArrow(_sort_shard(length), "key long, sum long, first long, lows array<long>, highs array<long>")
    own = cut(found.groupBy("key", "sum").agg(F.collect_list(F.struct("first", "lows", "highs")).alias("own")))
    ranges = grouped.drop("hs").join(own, ["key", "sum"], "left")
    met = rows.join(ranges, ["key", "sum"], "left").select("id", "text", "firsts", "mores", "own")
    id_type = rows.schema["id"].dataType.simpleString()
    out = met.mapInArrow(_kept_rows(length), f"id {id_type}, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept_sha256 string")
    return out.withColumnRenamed("id", id_col)


def _has_repeated_rows(rows: DataFrame) -> bool:
    return not rows.groupBy("key", "sum").count().where("count > 1").isEmpty()
