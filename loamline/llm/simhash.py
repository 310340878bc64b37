"""SimHash near duplicates by pigeonhole blocks.

Fingerprints with at most ``distance`` differing bits, cut into m blocks, agree in at least
m - distance of them. Each choice of that many blocks is a table whose key is the chosen bits; two
close fingerprints share a key in some table, and every shared key is verified by the Hamming distance.
m grows with the number of different fingerprints so that a key has about one of them by chance at any
size. A key that more than ``wide`` different fingerprints share (a large group of near copies) isn't
joined pair by pair: any two of its fingerprints within distance 2k share a midpoint within k bits of
both, so each points at the smallest fingerprint around each of its midpoints, which links the same
components with rows in proportion to the group.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import blake2b
from itertools import combinations
from math import comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .base import SLICE_ROWS, arrow_map, cut, drop, pick, place_of, plain, text_bytes
from .graph import connected_components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SEED = 42
BITS = 64
#: Shingles hashed at a time.
CHUNK = 1 << 16
#: Different fingerprints that may share a key before midpoints take the place of pairs.
WIDE = 512


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of independent hashes; the first is the hash itself."""
    if not k:
        return hashes
    x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ones_of(hashes: np.ndarray, family: int = 1) -> np.ndarray:
    """How many of the hashes have each bit, highest first, for each of ``family`` hashes made from them."""
    ones = np.zeros(BITS * family, np.int64)
    for at in range(0, len(hashes), CHUNK):
        raw = np.stack([mixed(hashes[at : at + CHUNK], k) for k in range(family)], axis=1)
        bits = np.unpackbits(raw.astype(">u8").view(np.uint8), axis=1)
        for k in range(0, len(bits), 255):  # up to 255 ones fit a byte, whose sums are the fastest
            ones += bits[k : k + 255].sum(0, dtype=np.uint8)
    return ones


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of all shingles in text order; a text of fewer words is one shingle, a blank one has none."""
    words = text_bytes(text).translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: max(1, len(words) - shingle + 1)].tolist()
    ends = ends[min(shingle, len(words)) - 1 :].tolist()
    return np.fromiter((hash64(joined[i:j], SEED) for i, j in zip(starts, ends, strict=True)), np.uint64, len(starts))


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """Unsigned SimHash of 64 bits: a bit is set if over half of all shingles' hashes have it."""
    hashes = shingle_hashes(text, shingle)
    return int.from_bytes(np.packbits(ones_of(hashes) * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): fp is the fingerprint's 64 bits as a signed long. Null and empty texts have 0."""
    rows = pick(docs, id=id_col, text=text_col)

    def task():
        def each(c):
            fps = [fingerprint(t, shingle) for t in c["text"]]
            return {"id": c["id"], "fp": [x - (1 << 64) if x >> 63 else x for x in fps]}

        return each

    return arrow_map(rows, task, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def block_masks(blocks: int) -> list[int]:
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def tables_for(n: int, distance: int) -> list[int]:
    """Masks of the tables for n different fingerprints: the fewest blocks whose keys have log2(n) bits."""
    for blocks in range(distance + 1, BITS + 1):
        chosen = blocks - distance
        if BITS * chosen // blocks >= log2(max(2, n)) or blocks >= distance + 6:
            break
    masks = block_masks(blocks)
    tables = [sum(c) for c in combinations(masks, chosen)]
    assert len(tables) == comb(blocks, chosen)
    return tables


def links(fps: DataFrame, distance: int = 4, wide: int = WIDE) -> DataFrame:
    """Edges (a, b) between different fingerprints of column fp; their components are those of all pairs
    within the distance. Pairs within it are all there, except inside keys that more than ``wide`` share."""
    fps = cut(fps.select("fp").where("fp is not null").distinct())
    tables = tables_for(fps.count(), distance)
    masks = F.array(*(F.lit(signed(m)) for m in tables))
    keyed = fps.select("fp", F.posexplode(masks).alias("t", "mask")).select("fp", "t", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
    crowded = keyed.groupBy("t", "key").count().where(F.col("count") > wide).select("t", "key")
    hot = cut(keyed.join(crowded, ["t", "key"], "left_semi"))
    calm = keyed if hot.isEmpty() else keyed.join(crowded, ["t", "key"], "left_anti")
    x, y = calm.alias("x"), calm.alias("y")
    apart = F.col("x.fp").bitwiseXOR(F.col("y.fp"))
    pairs = x.join(y, (F.col("x.t") == F.col("y.t")) & (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (F.bit_count(apart) <= distance)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))
    if hot.isEmpty():
        return pairs.distinct()
    # Within distance d, some midpoint is at most d // 2 bits from the one and at most the rest from the other.
    near = distance // 2
    flips = F.array(*(F.struct(F.lit(signed(sum(1 << i for i in c))).alias("flip"), F.lit(k <= near).alias("close")) for k in range(distance - near + 1) for c in combinations(range(BITS), k)))
    spread = hot.select("fp").distinct().select("fp", F.explode(flips).alias("e")).select("fp", F.col("fp").bitwiseXOR(F.col("e.flip")).alias("mid"), "e.close")
    # A midpoint has at most as many fingerprints around it as there are flips, so no window is larger than that.
    hub = F.min(F.when(F.col("close"), F.col("fp"))).over(Window.partitionBy("mid"))
    stars = spread.select(F.col("fp").alias("a"), hub.alias("b")).where("a <> b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, id_col: str = "doc_id", text_col: str = "text", wide: int = WIDE) -> DataFrame:
    """id, fp (signed long) and component_id, the smallest id that links reach, of each row.

    Null, empty and blank texts have fingerprint 0, linked like any other. Rows with a null id get the
    component of their fingerprint; null only if no member has an id. Repeated rows come out as often
    as they go in; extra columns are left out; an empty table gives an empty result.
    """
    prints = cut(fingerprints(docs, shingle, id_col, text_col))
    first = cut(prints.groupBy("fp").agg(F.min("id").alias("first")))
    parts = cut(connected_components(links(first, distance, wide)))
    group = first.join(parts, first["fp"] == parts["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("group"))
    lowest = group.groupBy("group").agg(F.min("first").alias("component_id"))
    of = group.join(lowest, "group").select("fp", "component_id")
    return prints.join(of, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


#: For similar(): the least Jaccard similarity, as a fraction of whole numbers so that nothing is rounded.
NUMERATOR, DENOMINATOR = 4, 5
#: Shingles are counted by their highest bits; the counts only set which shingles are looked at first.
SKETCH_BITS = 16
#: Words of a wide fingerprint. Of its 512 bits, 77.6 differ on average (deviation 8.1) at the least
#: similarity; a pair with over six deviations more is no candidate. Sets of fewer than SMALL shingles,
#: whose bits don't follow that rule, are not judged by it.
FAMILY, APART, SMALL = 8, 126, 64
PRINT = [f"f{k}" for k in range(FAMILY)]
#: Differing bits of 64 within which the pigeonhole tables lead sets to each other.
NEAR = 4
#: Members of a key that all others meet first, and how many of the closest of them are decided.
HUBS, CLOSEST = 8, 2
#: Parts that may share a key before it is put behind the others; shingles of a block that is compared at once.
CROWD, BLOCK = 2048, 2_000_000


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """Hashes of the different shingles, rising."""
    return np.unique(shingle_hashes(text, shingle).view(np.int64))


def similar(docs: DataFrame, shingle: int = 5, id_col: str = "doc_id", text_col: str = "text", wide: int = CROWD) -> DataFrame:
    """(id, component_id): groups of near copies, the components of all pairs of texts whose sets of
    shingles have a Jaccard similarity of 0.8 or more.

    Fingerprints of 64 bits meet in the pigeonhole tables of links(), as in near_duplicates(), and what is
    within NEAR bits there is decided by the whole sets. At 0.8 about ten bits differ, so these tables alone
    would miss pairs; the rest are found by shingles. Of two such sets with their shingles in one common order, the first fifths (and one more) share a
    shingle; these are the keys, at any size of the table. The order is rare shingles first, by a sketch
    of their counts, so that common lines and templates are seldom keys. Texts of one key are compared by
    sizes and places, then by the Hamming distance of wide SimHash fingerprints, and what is left is
    decided by the whole sets. Each text first meets a few members of each key, the same ones for all, and
    the closest are decided; then all members of a key that are still in different parts, each text
    sent once a key. A key with over ``wide`` such parts is put behind all others in the order, and the
    texts that hold one are keyed anew, which again misses no pair; only keys that stay as wide for want
    of other shingles are compared whole, in blocks of bounded size.

    Exact copies (of the shingles) are one from the start. Null, empty and blank texts have no group:
    their component_id is their own id. Rows with a null id are left out; repeated rows come out as often
    as they go in; an empty table gives an empty result.
    """
    rows = pick(docs, id=id_col, text=text_col).where("id is not null")
    kind = rows.schema["id"].dataType.simpleString()
    read = cut(rows.mapInArrow(_read(shingle), f"id {kind}, node binary, size int, {', '.join(f'{f} long' for f in PRINT)}, counts binary"))
    ids = read.where("counts is null").select("id", "node")
    firsts = cut(read.where("node is not null").groupBy("node").agg(F.min("id").alias("first"), F.struct(F.first("size").alias("size"), *(F.first(f).alias(f) for f in PRINT)).alias("print")))
    order = docs.sparkSession.sparkContext.broadcast(_counts(read))
    # The tables' sizes decide no join with texts: they always move once, so that all sizes behave alike.
    texts = (rows if ids.groupBy("id").count().where("count > 1").isEmpty() else rows.dropDuplicates(["id", "text"])).hint("merge")
    members = _members(rows.mapInArrow(_keys(shingle, order), KEYED), firsts)
    linked = _decided(_by_tables(firsts).unionByName(_closest(members)).distinct(), firsts, texts, shingle)
    parts = cut(connected_components(linked))
    low = None
    while True:
        placed, crowded = _placed(members, parts, wide)
        old = low
        if crowded is not None:
            low = cut(crowded if low is None else crowded.unionByName(low).distinct())
        last = crowded is None or (old is not None and crowded.join(old, "key", "left_anti").isEmpty())
        met = _across(placed if last else placed.join(crowded, "key", "left_anti"), firsts, texts, shingle)
        linked = cut(linked.unionByName(met))
        parts = cut(connected_components(linked))
        drop(members, met)
        if last:
            break
        again = placed.join(crowded, "key", "left_semi").select(F.col("own.node").alias("node")).distinct()
        members = _members(_rekeyed(_sets(again, firsts, texts, shingle), low, order), firsts)
        drop(placed)
    group = cut(firsts.select("node", "first").join(parts.toDF("of", "part"), F.col("node") == F.col("of"), "left").select("node", "first", F.coalesce("part", "node").alias("part")))
    lowest = group.groupBy("part").agg(F.min("first").alias("component_id"))
    of = group.join(lowest, "part").select("node", "component_id")
    named = ids.where("node is not null").join(of, "node").select("id", "component_id")
    return named.unionByName(ids.where("node is null").select("id", F.col("id").alias("component_id"))).toDF(id_col, "component_id")


def _node(held: np.ndarray) -> bytes | None:
    """The digest by which equal sets are one; an empty set has none."""
    return blake2b(held.tobytes(), digest_size=16).digest() if len(held) else None


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes.view(np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _read(shingle: int):
    """Per row its id, node, size and wide fingerprint; and at the end of a task, a row with its counts."""

    def run(batches):
        counts, schema = np.zeros(1 << SKETCH_BITS, np.int64), None
        names = ["id", "node", "size", *PRINT, "counts"]
        for batch in batches:
            schema = batch.schema
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                sets = [shingles(t, shingle) for t in part.column(1).to_pylist()]
                counts += np.bincount(_bucket(np.concatenate(sets)), minlength=len(counts))
                prints = np.stack([np.packbits(ones_of(h.view(np.uint64), FAMILY) * 2 > len(h)).view(">i8").astype(np.int64) for h in sets])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([_node(h) for h in sets], pa.binary()), pa.array([len(h) for h in sets], pa.int32()), *(pa.array(prints[:, k]) for k in range(FAMILY)), pa.nulls(len(sets), pa.binary())], names=names
                )
        if schema is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, schema.field(0).type), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), *(pa.nulls(1, pa.int64()) for _ in PRINT), pa.array([counts.tobytes()], pa.binary())], names=names)

    return run


def _counts(read: DataFrame) -> np.ndarray:
    """How many shingles of all texts have each pattern of highest bits."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                counts += np.frombuffer(raw, np.int64)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["at", "n"])

    total = np.zeros(1 << SKETCH_BITS, np.int64)
    for row in read.where("counts is not null").select("counts").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[row["at"]] = row["n"]
    return total


KEYED = "key long, node binary, size int, place int"


def _first_fifth(held: np.ndarray, node: bytes, counts: np.ndarray, low: np.ndarray | None = None) -> pa.RecordBatch:
    """The set's keys as rows of KEYED. low: shingles that are behind all others."""
    few = len(held) - -(-len(held) * NUMERATOR // DENOMINATOR) + 1
    behind = np.zeros(len(held), bool) if low is None else np.isin(held, low)
    keys = held[np.lexsort((held, counts[_bucket(held)], behind))[:few]]
    return pa.RecordBatch.from_arrays([pa.array(keys), pa.array([node] * few, pa.binary()), pa.array(np.full(few, len(held), np.int32)), pa.array(np.arange(few, dtype=np.int32))], names=["key", "node", "size", "place"])


def _keys(shingle: int, order):
    """All texts' keys; a set that the task lately had is left out."""

    def run(batches):
        counts, seen = order.value, set()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                out = []
                for text in batch.column(1).slice(at, SLICE_ROWS).to_pylist():
                    held = shingles(text, shingle)
                    node = _node(held)
                    if node is None or node in seen:
                        continue
                    if len(seen) >= CHUNK:
                        seen.clear()
                    seen.add(node)
                    out.append(_first_fifth(held, node, counts))
                if out:
                    yield pa.Table.from_batches(out).combine_chunks().to_batches()[0]

    return run


def _rekeyed(sets: DataFrame, low: DataFrame, order) -> DataFrame:
    """The sets' keys with the shingles of low (key) behind all others."""
    has = sets.select("node", F.explode("held").alias("key")).join(low, "key", "left_semi").groupBy("node").agg(F.collect_list("key").alias("low"))

    def run(batches):
        counts = order.value
        for batch in batches:
            for node, held, behind in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                yield _first_fifth(held.values.to_numpy(), node, counts, behind.values.to_numpy())

    return sets.join(has, "node").select("node", "held", "low").mapInArrow(run, KEYED)


def _members(keyed: DataFrame, firsts: DataFrame) -> DataFrame:
    """(key, own) of keys that several nodes share. own: node, size, place of the key, wide fingerprint."""
    by = Window.partitionBy("key").orderBy("node")
    met = keyed.withColumn("before", F.lag("node").over(by)).withColumn("head", F.first(F.struct("node", "size", "place")).over(by))
    met = met.where("before is not null and before <> node").select("key", "node", "place", (F.col("before") == F.col("head.node")).alias("second"), "head")
    # The smallest node of a key is told by the row of the one after it.
    everyone = met.select("key", F.explode(F.when(F.col("second"), F.array(F.struct("node", "place"), F.struct("head.node", "head.place"))).otherwise(F.array(F.struct("node", "place")))).alias("o"))
    held = everyone.select("key", F.col("o.node").alias("of"), "o.place").join(firsts.select("node", "print"), F.col("of") == F.col("node"))
    return cut(held.select("key", F.struct("node", "print.size", "place", "print").alias("own")))


def _may_reach(x: str, y: str):
    """Whether two sets that share a key as the first of all may have the least similarity: the shared are
    at least NUMERATOR / (NUMERATOR + DENOMINATOR) of both sizes together, and at most what follows."""
    left = F.least(F.col(f"{x}.size") - F.col(f"{x}.place"), F.col(f"{y}.size") - F.col(f"{y}.place"))
    return left * (NUMERATOR + DENOMINATOR) >= (F.col(f"{x}.size") + F.col(f"{y}.size")) * NUMERATOR


def _differ(x: str, y: str):
    return sum(F.bit_count(F.col(f"{x}.print.{f}").bitwiseXOR(F.col(f"{y}.print.{f}"))) for f in PRINT)


def _near(x: str, y: str):
    return _may_reach(x, y) & ((F.least(f"{x}.size", f"{y}.size") < SMALL) | (_differ(x, y) <= APART))


def _by_tables(firsts: DataFrame) -> DataFrame:
    """(x, y), x > y: sets whose 64-bit fingerprints the pigeonhole tables link. The least set of a
    fingerprint stands for it, and meets the others that have the same."""
    prints = firsts.select("node", F.col("print.f0").alias("fp"))
    least = cut(prints.groupBy("fp").agg(F.min("node").alias("lead")))
    same = prints.join(least, "fp").where("node <> lead").select(F.col("node").alias("x"), F.col("lead").alias("y"))
    of = lambda end, name: least.select(F.col("fp").alias(end), F.col("lead").alias(name))
    apart = links(least, NEAR).join(of("a", "p"), "a").join(of("b", "q"), "b").select(F.greatest("p", "q").alias("x"), F.least("p", "q").alias("y"))
    return same.unionByName(apart)


def _closest(members: DataFrame) -> DataFrame:
    """(x, y): each node with the closest few of those it meets. Of each key all members meet the same few,
    the least by each of some hashes, so that keys with like members have like ones to meet."""
    # Dealt by key once for both sides, as a member's row is many times what is asked of it.
    members = members.repartition(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")
    hubs = members.groupBy("key").agg(F.array_distinct(F.array(*(F.min_by("own", F.xxhash64("own.node", F.lit(k))) for k in range(HUBS)))).alias("hubs"))
    met = members.join(hubs, "key").select("own", F.explode("hubs").alias("hub")).where((F.col("own.node") != F.col("hub.node")) & _near("own", "hub"))
    pairs = met.groupBy(F.col("own.node").alias("x"), F.col("hub.node").alias("y")).agg(F.min(_differ("own", "hub")).alias("differ"))
    best = pairs.groupBy("x").agg(*(F.min_by("y", F.struct("differ", F.xxhash64("y", F.lit(k)))).alias(f"y{k}") for k in range(CLOSEST)))
    return best.select("x", F.explode(F.array_distinct(F.array(*(f"y{k}" for k in range(CLOSEST))))).alias("y")).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()


def _placed(members: DataFrame, parts: DataFrame, wide: int) -> tuple[DataFrame, DataFrame | None]:
    """(key, own, part) of members of a key that another part's member may be similar to, and the keys that
    have over ``wide`` parts of them."""
    with_part = lambda rows: rows.join(parts.toDF("of", "part"), F.col("own.node") == F.col("of"), "left").withColumn("part", F.coalesce("part", "own.node")).drop("of")
    slim = with_part(members.select("key", F.struct("own.node").alias("own")))
    mixed = slim.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low <> high").select("key")
    x = cut(with_part(members.join(mixed, "key", "left_semi")))
    y = x.toDF("ykey", "other", "ypart")
    # Only whether there is one is asked, so no pair becomes a row.
    placed = cut(x.join(y, (F.col("key") == F.col("ykey")) & (F.col("part") != F.col("ypart")) & _near("own", "other"), "left_semi"))
    drop(x)
    crowded = cut(placed.select("key", "part").distinct().groupBy("key").count().where(F.col("count") > wide).select("key"))
    return placed, None if crowded.isEmpty() else crowded


def _with_text(nodes: DataFrame, firsts: DataFrame, texts: DataFrame, node: str, text: str) -> DataFrame:
    """nodes with the text that first has the set ``node``; texts of other rows with its id come along."""
    reps = firsts.select(F.col("node").alias("rep_node"), F.col("first").alias("rep"))
    named = nodes.join(reps, F.col(node) == F.col("rep_node")).drop("rep_node")
    return named.join(texts.select("id", F.col("text").alias(text)), F.col("rep") == F.col("id")).drop("rep", "id")


def _set_of(shingle: int):
    """From (node, text) to the set, or None if the text is another's; the last ones are kept."""

    @lru_cache(maxsize=256)
    def held(node: bytes, text: str) -> np.ndarray | None:
        found = shingles(text, shingle)
        return found if _node(found) == node else None

    return held


def _sets(nodes: DataFrame, firsts: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(node, held): whole sets."""

    def run(batches):
        of = _set_of(shingle)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                got = [(n, h) for n, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if (h := of(n, t)) is not None]
                yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.binary()), pa.array([h for _, h in got], pa.list_(pa.int64()))], names=["node", "held"])

    return cut(_with_text(nodes, firsts, texts, "node", "text").select("node", "text").mapInArrow(run, "node binary, held array<long>"))


def _alike(shared, one, other):
    return shared * (NUMERATOR + DENOMINATOR) >= (one + other) * NUMERATOR


def _decided(pairs: DataFrame, firsts: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Edges (a, b): the pairs (x, y) whose sets have the least Jaccard similarity."""

    def run(batches):
        of = _set_of(shingle)
        for batch in batches:
            keep = []
            for x, y, p, q in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                one, two = of(x, p), of(y, q)
                keep.append(one is not None and two is not None and bool(_alike(len(np.intersect1d(one, two, True)), len(one), len(two))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = _with_text(cut(pairs), firsts, texts, "x", "p")
    return cut(_with_text(left, firsts, texts, "y", "q").select("x", "y", "p", "q").mapInArrow(run, "a binary, b binary").distinct())


def _across(placed: DataFrame, firsts: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """Edges (a, b) that join the parts of each key's members as all pairs of them would. Members that keys
    lead to from each other are a neighbourhood; one of at most BLOCK shingles is compared whole, each text sent
    once. A larger one goes key by key, of keys with the same members one is enough, and a key of more than
    BLOCK shingles is cut into blocks, each of which meets each."""
    slim = cut(placed.select("key", F.col("own.node").alias("node"), F.col("own.size").alias("size"), "part"))
    least = slim.groupBy("key").agg(F.min("node").alias("b"))
    around = connected_components(slim.join(least, "key").select(F.col("node").alias("a"), "b").where("a <> b").distinct())
    near = cut(slim.select("node", "size", "part").distinct().join(around.toDF("of", "around"), F.col("node") == F.col("of")).select("node", "size", "part", "around"))
    large = cut(near.groupBy("around").agg(F.sum(F.col("size").cast("long")).alias("n")).where(F.col("n") > BLOCK).select("around"))
    # Two neighbourhoods with one hash would only be compared together.
    named = near.join(large, "around", "left_anti").select(F.xxhash64("around").alias("key"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), "node", "part")
    if not large.isEmpty():
        named = named.unionByName(_by_key(slim.join(near.join(large, "around", "left_semi").select("node"), "node", "left_semi")))
    rows = _with_text(named, firsts, texts, "node", "text").select("key", "i", "j", "node", "part", "text")
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = cut(rows.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "node").mapInArrow(_joined(shingle), "a binary, b binary").distinct())
    drop(slim, around, near, large)
    return out


def _by_key(slim: DataFrame) -> DataFrame:
    """(key, i, j, node, part): each member of a key in each pair of blocks that its own is one of."""
    mark = lambda seed: F.sum(F.xxhash64("node", F.lit(seed)).cast("decimal(38,0)"))
    sizes = slim.groupBy("key").agg(F.ceil(F.sum(F.col("size").cast("long")) / BLOCK).alias("n"), F.count("*").alias("members"), mark(0).alias("one"), mark(1).alias("two"))
    kept = sizes.groupBy("members", "one", "two").agg(F.min(F.struct("key", "n")).alias("kept")).select("kept.key", "kept.n")
    dealt = slim.join(kept, "key").withColumn("k", F.pmod(F.xxhash64("node"), F.col("n")))
    meets = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda j: F.struct(F.least("k", j).alias("i"), F.greatest("k", j).alias("j")))
    return dealt.select("key", F.explode(meets).alias("at"), "node", "part").select("key", "at.i", "at.j", "node", "part")


def _joined(shingle: int):
    def run(batches):
        of, last, nodes, parts, sets = _set_of(shingle), None, [], [], []

        def edges():
            a, b = _edges(parts, sets)
            return pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in a], pa.binary()), pa.array([nodes[i] for i in b], pa.binary())], names=["a", "b"])

        for batch in batches:
            for *at, node, part, text in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
                if at != last and nodes:
                    yield edges()
                    nodes, parts, sets = [], [], []
                last = at
                held = of(node, text)
                if held is not None and (not nodes or nodes[-1] != node):
                    nodes.append(node)
                    parts.append(part)
                    sets.append(held)
        if nodes:
            yield edges()

    return run


def _edges(parts: list[bytes], sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    """Members whose similarity joins their parts, until none is left to join. Shingles that one member has
    are in no overlap; the others are bits."""
    sizes = np.array([len(h) for h in sets])
    _, label = np.unique(np.array(parts, object), return_inverse=True)
    found, inverse, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    column = np.cumsum(times > 1) - 1
    owner = np.repeat(np.arange(len(sets)), sizes)[times[inverse] > 1]
    at = column[inverse[times[inverse] > 1]]
    bits = np.zeros((len(sets), int((times > 1).sum()) // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (owner, at >> 6), np.uint64(1) << (at & 63).astype(np.uint64))
    a, b = [], []
    for i in range(1, len(sets)):
        other = np.flatnonzero(label[:i] != label[i])
        fits = _alike(np.minimum(sizes[other], sizes[i]), sizes[other], sizes[i])
        for low in range(0, len(other := other[fits]), 256):
            some = other[low : low + 256]
            for j in some[_alike(np.bitwise_count(bits[some] & bits[i]).sum(1, dtype=np.int64), sizes[some], sizes[i])].tolist():
                if label[j] != label[i]:
                    a.append(i)
                    b.append(j)
                    label[label == label[j]] = label[i]
    return a, b


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs, all columns, with the row of the smallest id of each group of similar(). Rows with a null id
    stay, as do null, empty and blank texts; of rows that repeat an id, one stays. An empty table gives an
    empty result."""
    at = f"c{place_of(docs, id_col)}"
    groups = similar(docs, id_col=id_col, text_col=text_col, **options).toDF("of", "component_id")
    lead = cut(groups.where("of = component_id").groupBy("of").count())
    kept = plain(docs).join(lead, F.col(at) == lead["of"])
    named = kept.where("count = 1").select(*plain(docs).columns)
    again = kept.where("count > 1").select(*plain(docs).columns).dropDuplicates([at])
    return named.unionByName(again).unionByName(plain(docs).where(F.col(at).isNull())).toDF(*docs.columns)
