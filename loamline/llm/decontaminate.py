"""Benchmark decontamination by a broadcast set of normalised item n-grams.

Windows of ``window`` consecutive words (a shorter item is one window) are numbered by the item words
and hashed; each task rolls the same hash over its documents' words, looks the sums up, and compares the
words themselves on every hit. A benchmark whose windows outgrow ``max_windows`` is sent in several
passes whose hits are united, so the broadcast stays bounded whatever the benchmark's size.
"""

from __future__ import annotations

import re
from uuid import uuid4

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, pick, place_of, plain, text_bytes

#: Byte to byte: A-Z become a-z, ASCII that is no word character becomes a space, the rest stays.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
FACTOR = np.uint64(0x9E3779B97F4A7C15)
MAX_WINDOWS = 2_000_000
#: Words handled at a time; neighbours overlap by a window.
CHUNK = 1 << 18


def words_of(text: str | None) -> list[bytes]:
    return text_bytes(text).translate(NORMAL).split()


def windows_of(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    n = min(window, len(words))
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


class Windows:
    """The searchable set: by length, sorted sums, and the words behind each sum."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        """items: (item id, normalised words joined by spaces)."""
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, joined in items:
            for w in windows_of(joined.split(), window):
                owners.setdefault(tuple(self.ids.setdefault(x, len(self.ids)) for x in w), set()).add(item)
        self.by_length = {}
        for n in sorted({len(k) for k in owners}):
            keys = [k for k in owners if len(k) == n]
            sums = self.roll(np.array(keys, dtype=np.int64).reshape(-1), n)[::n]
            order = np.argsort(sums, kind="stable")
            few = np.zeros(1 << 16, dtype=bool)
            few[(sums >> np.uint64(48)).astype(np.int64)] = True
            self.by_length[n] = (sums[order], [keys[i] for i in order], [sorted(owners[keys[i]]) for i in order], few)

    @staticmethod
    def roll(ids: np.ndarray, n: int) -> np.ndarray:
        """Sum of each n consecutive ids by powers of FACTOR, mixed so that high bits are even."""
        x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        total = np.zeros(len(ids) - n + 1, dtype=np.uint64)
        for k in range(n):
            total = total * FACTOR + x[k : len(x) - n + 1 + k]
        return total ^ (total >> np.uint64(29))

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items whose windows occur."""
        hit, items = np.zeros(len(words), dtype=bool), set()
        overlap = max(self.by_length, default=1) - 1
        for at in range(0, len(words), CHUNK):
            part = words[at : at + CHUNK + overlap]
            ids = np.fromiter(map(self.ids.get, part, [-1] * len(part)), np.int64, len(part))
            for n, (sums, keys, owners, few) in self.by_length.items():
                if len(part) < n:
                    continue
                rolled = self.roll(ids, n)
                maybe = np.flatnonzero(few[(rolled >> np.uint64(48)).astype(np.int64)])
                if not len(maybe):
                    continue
                first = np.searchsorted(sums, rolled[maybe])
                for i, j in zip(maybe.tolist(), first.tolist(), strict=True):
                    while j < len(sums) and sums[j] == rolled[i]:
                        if tuple(ids[i : i + n].tolist()) == keys[j]:  # verified word by word
                            hit[at + i : at + i + n] = True
                            items.update(owners[j])
                        j += 1
        return hit, items


#: The last set that this worker has built, by its name; its next tasks need not build it again.
_BUILT: dict[str, Windows] = {}


def built(name: str, items: list[tuple[str, bytes]], window: int) -> Windows:
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Windows(items, window)
    return _BUILT[name]


def spans_of(hit: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of hit words as (first, end)."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _passes(benchmark: DataFrame, item_col: str, text_col: str, max_windows: int) -> list[list[tuple[str, bytes]]]:
    """The items in passes of at most max_windows windows each, as far as a single item allows."""
    rows = pick(benchmark, item=item_col, text=text_col)
    passes, held = [[]], 0
    for item, text in rows.select(F.coalesce(F.col("item").cast("string"), F.lit("")).alias("item"), "text").orderBy("item", "text").toLocalIterator():
        joined = b" ".join(words_of(text))
        if not joined:
            continue
        n = joined.count(b" ") + 1
        if passes[-1] and held + n > max_windows:
            passes.append([])
            held = 0
        passes[-1].append((item, joined))
        held += n
    return passes


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_windows: int = MAX_WINDOWS) -> DataFrame:
    """doc id, n_words, hit spans (array of first and end word) and items (sorted strings) of each row.

    Null and empty texts have no words. A null item id counts as the item ''. Rows with one item id are
    one item. Rows are judged one by one, whatever their ids: each goes through all passes with its hits
    so far. An empty benchmark hits nothing.
    """
    sc = docs.sparkSession.sparkContext
    rows = pick(docs, id=id_col, text=text_col)
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, text string, n_words long, spans array<struct<first:long,end:long>>, items array<string>"
    rows = rows.select("id", F.col("text").cast("string").alias("text"), F.array().cast("array<struct<first:long,end:long>>").alias("spans"), F.array().cast("array<string>").alias("items"))
    for part in _passes(benchmark, item_col, item_text_col, max_windows):
        shared, name = sc.broadcast(part), uuid4().hex

        def task(shared=shared, name=name):
            found = built(name, shared.value, window)

            def each(c):
                out = {"id": c["id"], "text": c["text"], "n_words": [], "spans": [], "items": []}
                for text, spans, before in zip(c["text"], c["spans"], c["items"], strict=True):
                    words = words_of(text)
                    hit, items = found.find(words)
                    out["n_words"].append(len(words))
                    out["spans"].append(spans + [{"first": a, "end": b} for a, b in spans_of(hit)])
                    out["items"].append(sorted(items.union(before)))
                return out

            return each

        rows = arrow_map(rows, task, schema)
    return rows.select(F.col("id").alias(id_col), "n_words", F.array_distinct("spans").alias("spans"), "items")


def hit_words(spans: str = "spans"):
    """Number of words that the spans cover; spans of several passes may overlap."""
    merged = F.aggregate(
        F.array_sort(spans),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end")),
        lambda acc, s: F.struct((acc["n"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(s["first"], acc["end"]))).alias("n"), F.greatest(acc["end"], s["end"]).alias("end")),
        lambda acc: acc["n"],
    )
    return merged


def without_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 10, drop_share: float = 0.0, text_col: str = "text", **options) -> DataFrame:
    """docs without leaks. A row whose hit words are more than drop_share of its words goes; of other
    rows the hit words go, with what stands between them. With drop_share 0, each row that is hit goes.
    Rows without hits, null texts included, stay as they are; all columns are kept. A benchmark of
    several passes is taken pass by pass, the shares of each pass by themselves.
    """
    sc = docs.sparkSession.sparkContext
    passes = _passes(benchmark, options.get("item_col", "item_id"), options.get("item_text_col", "text"), options.get("max_windows", MAX_WINDOWS))
    out, at = plain(docs), place_of(docs, text_col)
    for part in passes:
        if not part:
            continue
        shared, name = sc.broadcast(part), uuid4().hex

        def clean(batches, shared=shared, name=name):
            import pyarrow as pa

            found = built(name, shared.value, window)
            for batch in batches:
                keep, texts = [], []
                for text in batch.column(at).to_pylist():
                    words = words_of(text)
                    hit, _ = found.find(words)
                    n = int(hit.sum())
                    keep.append(not n or n <= drop_share * len(words))
                    texts.append(cut_spans(text, spans_of(hit)) if n and keep[-1] else text)
                cols = list(batch.columns)
                cols[at] = pa.array(texts, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays(cols, schema=batch.schema).filter(pa.array(keep, pa.bool_()))

        out = out.mapInArrow(clean, out.schema)
    return out.toDF(*docs.columns)


#: A word as words_of takes it, before A-Z are lowered.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the characters from each span's first word to its last word."""
    at = [m.span() for m in WORD.finditer(text)]
    out, end = [], 0
    for a, b in spans:
        out.append(text[end : at[a][0]])
        end = at[b - 1][1]
    return "".join(out) + text[end:]


def items_digest(items: str = "items"):
    return F.sha2(F.array_join(items, ",").cast("binary"), 256)
