"""URL filters, mixing, SimHash, components, images and the pipeline."""

from __future__ import annotations

import itertools
import random
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loamline.llm import graph, media, mixing, simhash, urls

from .conftest import prose

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def joined(nodes, edges):
    parent = {n: n for n in nodes}
    for a, b in edges:
        x, y = find(parent, a), find(parent, b)
        parent[max(x, y)] = min(x, y)
    return {n: find(parent, n) for n in nodes}


@pytest.mark.parametrize("edges", [[], [(1, 1), (None, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 60)], [(60 - i, 0) for i in range(1, 60)] + [(100, 101), (101, 100), (100, 101)], [(random.Random(i).randrange(80), random.Random(-i).randrange(80)) for i in range(60)]])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == joined({n for e in real for n in e}, real)


def judged(spark, pages, rules=RULES, **options):
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r["page_id"]: r for r in urls.judge(frame, rules, **options).collect()}


def test_url_parts_and_rules(spark):
    got = judged(spark, [("HTTP://WWW.Example.ORG/es/x?a=/b#c", None), ("http://example.org/en/12", ""), ("https://a.com/fr/", ""), ("x://a.com/de/1", ""), ("http://notexample.org", ""), ("http://org/", ""), (None, None), ("no scheme", "x"), ("http://xorg/", ""), ("http://a.net/\n/z", "")])
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for _, r in sorted(got.items())] == [
        ("www.example.org", "/es/x", "example.org/es/", "block"), ("example.org", "/en/12", "example.org/en/1", "block"), ("a.com", "/fr/", "com/fr/", "allow"), ("a.com", "/de/1", "com/de/", "block"),
        ("notexample.org", "", None, "allow"), ("org", "/", "org/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("xorg", "/", None, "allow"), ("a.net", "/\n/z", None, "allow"),
    ]


def test_blocks_follow_aliases_and_allow_stands(spark):
    canonical = '<head><LINK href="{0}" rel=canonical></head>'
    refresh = "<meta http-equiv='Refresh' content='0; URL={0}'>"
    got = judged(spark, [
        ("http://a.net/1", canonical.format("http://b.com/de/1")), ("http://c.net/2", refresh.format("//a.net/1")), ("http://d.net/x/3", canonical.format("4")), ("http://d.net/x/4", refresh.format("http://c.net/2")),
        ("http://e.net/5", canonical.format("http://b.com/de/9") + refresh.format("http://b.com/fr/1")), ("http://b.com/fr/2", canonical.format("http://b.com/de/1")), ("http://f.net/6", canonical.format("http://g.net/7")), ("http://h.net/8", "<link rel='stylesheet' href='http://b.com/de/1'>"),
        ("https://c.net/2#part", ""),
    ])
    assert [r["verdict"] for _, r in sorted(got.items())] == ["allow"] * 7 + ["allow", "allow"]  # b.com/fr/2 joins its allow to them all
    got = judged(spark, [("http://a.net/1", canonical.format("http://b.com/de/1")), ("http://c.net/2", refresh.format("//a.net/1")), ("http://d.net/x/3", canonical.format("/2")), ("http://e.net/9", "")], redirects=spark.createDataFrame([("http://e.net/9", "http://c.net/2")], "from_url string, to_url string"))
    assert [(r["verdict"], r["via"]) for _, r in sorted(got.items())] == [("block", "alias"), ("block", "alias"), ("allow", "default"), ("block", "alias")]


def test_many_rules_are_joined(spark):
    pages = [("http://x.example.org/es/1", ""), ("http://h7.net/a/b", ""), ("http://z.net/", ""), (None, ""), ("http://s.h7.net/a", "")]
    many = (*RULES, *(("block", f"h{i}.net", "/a") for i in range(300)))
    assert [r["rule"] for _, r in sorted(judged(spark, pages, many).items())] == ["example.org/es/", "h7.net/a", None, None, "h7.net/a"]
    few = (*RULES, ("block", "h7.net", "/a"))
    assert [r["verdict"] for _, r in sorted(judged(spark, pages, many).items())] == [r["verdict"] for _, r in sorted(judged(spark, pages, few).items())]


def test_url_odd_tables(spark):
    frame = spark.createDataFrame([(1, "http://a.com/de/", None, "x", "y")] * 2 + [(None, None, None, None, None)], "page_id long, url string, html string, URL string, host string")
    assert sorted(r["verdict"] for r in urls.judge(frame, RULES).collect()) == ["allow", "block", "block"]
    assert urls.judge(frame.limit(0), RULES).count() == 0 and urls.judge(frame, ()).where("verdict = 'block'").count() == 0


def fair(sizes, weights, cap=3):
    """Targets by pouring until none is above its cap."""
    order = sorted((s is None, s) for s in sizes)
    weight = {s: weights[i % 3] for i, (_, s) in enumerate(order)}
    held, left = {}, float(sum(sizes.values()))
    while True:
        open_ = [s for s in sizes if s not in held]
        over = [s for s in open_ if weight[s] * left / sum(weight[o] for o in open_) > cap * sizes[s]]
        if not over:
            return held | {s: weight[s] * left / sum(weight[o] for o in open_) for s in open_}
        for s in over:
            held[s] = float(cap * sizes[s])
        left = sum(sizes.values()) - sum(held.values())


def test_mix_meets_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a"] * 8 + ["b", "c", "dd", None])) for i in range(3000)]
    got = mixing.copies(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = {}
    for r in got:
        sizes[r["source"]] = sizes.get(r["source"], 0) + r["size"]
    want = fair(sizes, mixing.WEIGHTS)
    for s, target in want.items():
        mine = [r for r in got if r["source"] == s]
        assert all(r["target"] == pytest.approx(target) and r["source_size"] == sizes[s] for r in mine)
        assert sum(r["taken"] for r in mine) == pytest.approx(target, abs=130)
    assert all(r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"] for r in got)
    again = mixing.copies(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_mix_emits_copies(spark, odd):
    plan = mixing.copies(odd)
    assert plan.count() == odd.count() and plan.where("size = 0 and taken <> 0").count() == 0
    out = mixing.mix(odd)
    assert out.columns == [c for c in odd.columns if c != "copy"] + ["copy"]
    assert out.count() == plan.agg({"copies": "sum"}).first()[0]
    assert mixing.copies(odd.limit(0)).count() == mixing.mix(odd.limit(0)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r["target"], r["copies"]) for r in mixing.copies(blank).collect()} == {(0.0, 0)}


def plain_print(text, n=4):
    words = re.findall("[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@pytest.mark.parametrize(("wide", "distance"), [(512, 4), (2, 4), (2, 3)])
def test_near_duplicates_are_those_of_all_pairs(spark, wide, distance):
    texts = [None, "", "One", "one", "a b c d", "A b c  d", "a b c d e", "naïve Ä x y z"]
    for seed in range(6):
        base = prose(seed, 150).split()
        texts.append(" ".join(base))
        for k in range(12):
            base[k * 7] = f"edit{k}"
            texts.append(" ".join(base))
    rows = list(enumerate(texts))
    prints = {i: plain_print(t) for i, t in rows}
    want = joined(prints, [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= distance])
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), wide=wide, distance=distance).collect()
    assert {r["doc_id"]: r["fp"] % (1 << 64) for r in got} == prints
    assert {r["doc_id"]: r["component_id"] for r in got} == want and len(set(want.values())) < len(rows) - 20


def test_tables_hold_every_close_pair():
    rng = random.Random(0)
    for n in (2, 10**5, 10**7, 10**9, 10**12):
        tables = simhash.tables_for(n, 4)
        for _ in range(300):
            apart = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not apart & mask for mask in tables)


def test_simhash_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    of = {r["doc_id"]: r["component_id"] for r in got}
    assert of[1] == of[2] == of[3] == 1 and of[5] == of[6] == 5 and of[None] is None
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


def test_one_of_each_group_stays(odd, spark):
    kept = simhash.one_of_each(odd)
    ids = sorted((r[0] is not None, r[0] or 0) for r in kept.toDF(*(f"k{i}" for i in range(len(kept.columns)))).select("k0").collect())
    assert [i for known, i in ids if known] == [1, 2, 3, 4, 5, 8, 9, 10, 11] and len(ids) == 10 and kept.columns == odd.columns
    assert simhash.one_of_each(odd.limit(0)).count() == 0


def test_large_group_of_near_copies(spark):
    base = prose(1, 200).split()
    rows = [(i, " ".join([*base[: i % 150], f"x{i}", *base[i % 150 + 1 :]])) for i in range(300)] + [(1000 + i, prose(100 + i, 200)) for i in range(20)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {got[i] for i in range(300)} == {0} and all(got[1000 + i] == 1000 + i for i in range(20))


def versions(seed, share, n=200):
    """Two texts of n words whose sets of five-word shingles have about this similarity, and that similarity."""
    rng = random.Random(seed)
    one = prose(seed, n).split()
    two, at = list(one), rng.sample(range(n), n)
    while alike(one, two) > share:
        two[at.pop()] = f"new{rng.random()}"
    return " ".join(one), " ".join(two), alike(one, two)


def alike(one, two):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (one, two))
    return len(a & b) / len(a | b)


def groups_of(spark, texts, **options):
    got = simhash.similar(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), **options).collect()
    return {r["doc_id"]: r["component_id"] for r in got}


def test_every_pair_at_the_least_similarity(spark):
    """Pairs from 0.76 to 0.86: those at 0.8 or more are joined, all of them, and no others."""
    pairs = [versions(i, 0.76 + i % 10 / 100, 400) for i in range(200)]
    got = groups_of(spark, [t for a, b, _ in pairs for t in (a, b)])
    assert {i for i in range(200) if got[2 * i + 1] == got[2 * i]} == {i for i, p in enumerate(pairs) if p[2] >= 0.8}
    assert 40 < sum(p[2] >= 0.8 for p in pairs) < 160 and all(got[2 * i] == 2 * i for i in range(200))


def test_pairs_at_the_least_similarity_at_every_size(spark):
    """The same pairs, alone and among more texts than 2^12, where keys once grew longer and found less."""
    pairs = [p for p in (versions(i, 0.805, 400) for i in range(150)) if p[2] >= 0.8]
    texts = [t for a, b, _ in pairs for t in (a, b)]
    for more in (0, 5000):
        got = groups_of(spark, texts + [prose(10_000 + i, 12) for i in range(more)])
        assert len(pairs) > 50 and [got[2 * i + 1] for i in range(len(pairs))] == [2 * i for i in range(len(pairs))]
        assert all(got[i] == i for i in range(len(texts), len(texts) + more))


@pytest.mark.parametrize("wide", [512, 3])
def test_true_pairs_among_relatives(spark, wide, monkeypatch):
    """Texts of one template that are mostly no copies of each other, against all pairs by brute force; with
    keys compared as they are, and with all but the least ones put behind the others."""
    rng, base, texts = random.Random(5), prose(9, 60).split(), []
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(60), rng.randint(1, 3)):
            words[at] = f"own{rng.randrange(3)}x{at}"
        texts.append(" ".join(words))
    split = [t.split() for t in texts]
    want = joined(range(400), [(a, b) for a, b in itertools.combinations(range(400), 2) if alike(split[a], split[b]) >= 0.8])
    assert groups_of(spark, texts, wide=wide) == want and len(set(want.values())) > 20
    monkeypatch.setattr(simhash, "BLOCK", 2000)
    monkeypatch.setattr(simhash, "HUBS", 1)
    assert wide < 512 or groups_of(spark, texts) == want


def test_near_copies_meet_in_the_tables_of_fingerprints(spark, monkeypatch):
    """With nothing met by shingles first, the pairs to decide are those that brute force finds within four bits."""
    texts = [t for i in range(60) for t in versions(i, 0.97, 400)[:2]] + [prose(900 + i, 50) for i in range(40)]
    sets = [simhash.shingles(t) for t in texts]
    prints = [int.from_bytes(np.packbits(simhash.ones_of(h.view(np.uint64)) * 2 > len(h)).tobytes(), "big") for h in sets]
    pair = lambda i, j: tuple(sorted((simhash._node(sets[i]), simhash._node(sets[j])), reverse=True))
    want = {pair(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if (prints[i] ^ prints[j]).bit_count() <= 4}
    asked, decided = [], simhash._decided
    monkeypatch.setattr(simhash, "_closest", lambda members: members.select(F.col("own.node").alias("x"), F.col("own.node").alias("y")).limit(0))
    monkeypatch.setattr(simhash, "_decided", lambda pairs, *rest: asked.extend((bytes(r["x"]), bytes(r["y"])) for r in pairs.collect()) or decided(pairs, *rest))
    got = groups_of(spark, texts)
    assert set(asked) == want and len(want) > 20
    assert all(got[2 * i + 1] == 2 * i for i in range(60))


def test_a_passage_that_all_texts_share(spark):
    """Its keys are crowded; the pairs of near copies among its texts are found by their other shingles."""
    passage, texts = prose(1, 60), []
    for i in range(60):
        own = prose(100 + i, 90).split()
        texts += [" ".join(own) + " " + passage, " ".join([*own[:40], "changed", *own[41:]]) + " " + passage] if i % 3 else [" ".join(own[:30]) + " " + passage]
    split = [t.split() for t in texts]
    n = len(texts)
    want = joined(range(n), [(a, b) for a, b in itertools.combinations(range(n), 2) if alike(split[a], split[b]) >= 0.8])
    assert groups_of(spark, texts, wide=4) == groups_of(spark, texts) == want and len(set(want.values())) == 60


def gray(image):
    return b"P5 %d %d 255\n" % (image.shape[1], image.shape[0]) + image.astype(np.uint8).tobytes()


def png(image, how):
    rows, last = b"", np.zeros(image.shape[1], int)
    for line in image.astype(int):
        left, corner = np.concatenate(([0], line[:-1])), np.concatenate(([0], last[:-1]))
        near = np.array([min((a, b, c), key=lambda v, a=a, b=b, c=c: abs(a + b - c - v)) for a, b, c in zip(left, last, corner, strict=True)])
        rows += bytes([how]) + ((line - (0, left, last, (left + last) // 2, near)[how]) % 256).astype(np.uint8).tobytes()
        last = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", image.shape[1], image.shape[0], 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("how", range(5))
def test_png_filters(how):
    image = np.random.default_rng(how).integers(0, 256, (9, 7))
    assert (media.decode(png(image, how)) == image).all() and (media.decode(gray(image)) == image).all()


@pytest.mark.parametrize("raw", [None, b"", b"P5", b"P5 3 3 255\nab", b"\x89PNG\r\n\x1a\nxx", b"GIF89a", b"P6 1 1 255\nabc", b"\x89PNG\r\n\x1a\n", b"P5 99999999999999 99999999999999 255\n", b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">IIBBBBB", 90000, 90000, 8, 0, 0, 0, 0) + b"0000"])
def test_unreadable_images(raw):
    got = media.decode(raw)
    assert got is None or got.shape == (1, 1)


def test_crops_edits_and_turns_are_found(spark):
    rng = np.random.default_rng(0)
    picture = lambda: np.kron(rng.integers(0, 256, (24, 30)), np.ones((4, 4))).astype(np.uint8)
    one, other = picture(), picture()
    edited = one.copy()
    edited[30:50, 40:60] = 7
    rows = [(3, gray(one)), (4, gray(one[8:80, 12:110])), (5, gray(edited)), (6, gray(other)), (7, gray(other)), (8, None), (9, b"no image"), (None, gray(one)), (11, gray(np.rot90(one))), (12, gray(picture())), (4, gray(one[8:80, 12:110])), (13, b"")]
    frame = spark.createDataFrame([(i, b, "x") for i, b in rows], "doc_id long, image binary, IMAGE string")
    got = media.image_copies(frame).collect()
    assert len(got) == len(rows)
    of = {r["doc_id"]: r["component_id"] for r in got}
    assert of == {3: 3, 4: 3, 5: 3, 6: 6, 7: 6, 8: 8, 9: 9, None: None, 11: 3, 12: 12, 13: 13}
    assert media.image_copies(frame.limit(0)).count() == 0


def blocky(rng, size=12):
    return np.kron(rng.integers(0, 256, (size, size)), np.ones((4, 4)))


def copies_of(spark, images):
    rows = [(i, gray(image)) for i, image in enumerate(images)]
    got = media.image_copies(spark.createDataFrame(rows, "doc_id long, image binary").repartition(8)).collect()
    return {r["doc_id"]: (r["component_id"], r["n_images"]) for r in got}


def test_large_group_of_edited_pictures(spark):
    """A thousand copies, each with its own noise in one corner: all are one group."""
    rng = np.random.default_rng(3)
    base, images = blocky(rng), []
    for _ in range(1000):
        images.append(base.copy())
        images[-1][36:, 36:] = rng.integers(0, 256, (12, 12))
    got = copies_of(spark, images + [blocky(rng) for _ in range(20)])
    assert all(got[i] == (0, 1000) for i in range(1000)) and all(got[1000 + i] == (1000 + i, 1) for i in range(20))


def plain_links(images):
    """All pairs of images by all pairs of corners, whatever words they share: a corner of each within APART
    bits, LEAST_VOTES different ones on one step and turn with all shifts within GRID of one of them."""
    found, out = [media.corners(i) for i in images], set()
    for i, j in itertools.combinations(range(len(images)), 2):
        votes = {}
        for p, q in zip(*np.nonzero(np.bitwise_count(found[i][4][:, None] ^ found[j][4][None]).sum(2) <= media.APART), strict=True):
            (a, x, y, t), (b, u, v, s) = ([int(found[k][c][at]) for c in range(4)] for k, at in ((i, p), (j, q)))
            angle, size = (s - t) % media.TURNS * 2 * np.pi / media.TURNS, 2.0 ** (b - a)
            shift = (u * 2**b - size * (x * 2**a * np.cos(angle) - y * 2**a * np.sin(angle)), v * 2**b - size * (x * 2**a * np.sin(angle) + y * 2**a * np.cos(angle)))
            votes.setdefault((b - a, (s - t) % media.TURNS), []).append((shift, p, q))
        for same in votes.values():
            near = [[(p, q) for d, p, q in same if max(abs(d[0] - c[0]), abs(d[1] - c[1])) <= media.GRID / 2] for c, _, _ in same]
            if any(min(len({p for p, _ in n}), len({q for _, q in n})) >= media.LEAST_VOTES for n in near):
                out.add((i, j))
    return out


def test_links_of_all_pairs_are_found(spark):
    """Sixty pictures with noise, crops, turns and their like, against all pairs of all corners."""
    rng, images = np.random.default_rng(5), []
    for _ in range(15):
        base = blocky(rng)
        noisy = np.clip(base + rng.integers(-3, 4, base.shape), 0, 255)
        images += [base, noisy, base[6:, 4:], np.rot90(noisy).copy()]
    want, got = plain_links(images), copies_of(spark, images)
    found = sum(got[i][0] == got[j][0] for i, j in want)
    print(f"{found} of {len(want)} links")
    assert len(want) > 40 and found >= 0.9 * len(want)
    assert all(got[i][0] // 4 == i // 4 for i in range(60))  # no group holds two pictures


def test_images_in_blocks(spark, monkeypatch):
    """The same groups where images meet no hub of theirs first and groups are cut into blocks."""
    rng = np.random.default_rng(7)
    base, images = blocky(rng), []
    for _ in range(40):
        images.append(base.copy())
        images[-1][36:, 36:] = rng.integers(0, 256, (12, 12))
    want = copies_of(spark, images)
    monkeypatch.setattr(media, "BLOCK", 10)
    monkeypatch.setattr(media, "_first_links", lambda members, images: members.sparkSession.createDataFrame([], "a long, b long"))
    assert copies_of(spark, images) == want == {i: (0, 40) for i in range(40)}


def test_drawn_texts(odd):
    assert media.image_copies(media.pictures(odd)).count() == odd.count()


def test_pipeline_stages(spark, tmp_path):
    """Planted cases go, clean rows stay, in each stage on what the one before kept."""
    import corpus_pipeline as pipeline

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "simhash near-dedup", "benchmark decontamination", "pii", "mixing to target weights"]
    item = spark.read.parquet(f"{folder}/benchmark.parquet").first()["text"]
    clean = [(9000 + i, prose(i, 80) + " 4111111111111111", "en", "s", 1) for i in range(4)]
    planted = [(9100, prose(0, 80) + " 4111111111111111", "en", "s", 1), (9101, prose(77, 30) + " " + item, "en", "s", 1)]
    extra = spark.createDataFrame(clean + planted, "doc_id long, text string, lang string, source string, n_chars long")
    kept = simhash.one_of_each(extra.unionByName(docs.select(extra.columns)))
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert {9000, 9001, 9002, 9003, 9101} <= ids and 9100 not in ids
    left = pipeline.drop_leaks(spark, extra, folder)
    assert {r["doc_id"] for r in left.collect()} == {9000, 9001, 9002, 9003, 9100}
    hidden = pipeline.hide_numbers(spark, extra, folder)
    assert hidden.columns == extra.columns and hidden.where("text like '%4111111111111111%'").count() == 0
    out = pipeline.run(spark, folder)
    assert 0 < out.count() and set(docs.columns) < set(out.columns)


def test_registered_queries_run_on_the_smallest_tables(spark):
    from loamline.llm import queries

    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES if n.startswith("op")] == list(range(1, 11)) and "pipeline" in queries.QUERIES
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def _corners_of(text):
    scale, x, y, turn, words = media.corners(media.decode(media.drawn(text)))
    held = np.zeros(len(scale), media.CORNER)
    held["place"] = (((scale << media.SIDE_BITS | x) << media.SIDE_BITS | y) << media.TURN_BITS) | turn
    held["words"] = words
    return held


def _plainly_linked(one, other):
    """Every corner of the one image with every corner of the other."""
    side, cells = (1 << media.SIDE_BITS) - 1, {}
    for p, a in enumerate(one):
        for q, b in enumerate(other):
            if not (a["words"] == b["words"]).any() or sum(bin(int(v)).count("1") for v in a["words"] ^ b["words"]) > media.APART:
                continue
            (sa, xa, ya, ta), (sb, xb, yb, tb) = ((int(c) >> 52, (int(c) >> 28) & side, (int(c) >> 4) & side, int(c) & 15) for c in (a["place"], b["place"]))
            step, turned = sb - sa, (tb - ta) % media.TURNS
            angle, size = turned * 2 * np.pi / media.TURNS, 2.0**step
            xa, ya, xb, yb = xa * 2.0**sa, ya * 2.0**sa, xb * 2.0**sb, yb * 2.0**sb
            sx, sy = xb - size * (xa * np.cos(angle) - ya * np.sin(angle)), yb - size * (xa * np.sin(angle) + ya * np.cos(angle))
            for u in (0, 1):
                for v in (0, 1):
                    cell = (step, turned, u, v, np.floor((sx + u * media.GRID) / (2 * media.GRID)), np.floor((sy + v * media.GRID) / (2 * media.GRID)))
                    ends = cells.setdefault(cell, (set(), set()))
                    ends[0].add(p)
                    ends[1].add(q)
    return any(min(len(ps), len(qs)) >= media.LEAST_VOTES for ps, qs in cells.values())


def _classes(parts, edges):
    label = list(parts)
    for i, j in edges:
        old, label = label[j], [label[i] if v == label[j] else v for v in label]
    return [label.index(v) for v in label]


@pytest.mark.parametrize("pairs", [7, 300, 1 << 15])
def test_linked_images_are_those_of_a_plain_comparison(monkeypatch, pairs):
    monkeypatch.setattr(media, "PAIRS", pairs)
    rng = np.random.default_rng(3)
    groups = []
    for _ in range(4):
        bases = [[f"w{n}" for n in rng.integers(0, 5000, 500)] for _ in range(3)]
        lists = []
        for k in range(9):
            text = list(bases[k % 3])
            for at in rng.integers(0, 500, 6 * k):
                text[at] = "other"
            lists.append(_corners_of(" ".join(text)))
        groups.append(([0, 0, *range(1, 8)], lists))
    every = [(g, part, held) for g, (parts, lists) in enumerate(groups) for part, held in zip(parts, lists, strict=True)]
    a, b = media.linked(*(list(side) for side in zip(*every, strict=True)))
    joined = 0
    for g, (parts, lists) in enumerate(groups):
        plain = [(i, j) for j in range(9) for i in range(j) if _plainly_linked(lists[i], lists[j])]
        own = [(i - 9 * g, j - 9 * g) for i, j in zip(a, b, strict=True) if i // 9 == g]
        assert _classes(parts, own) == _classes(parts, plain)
        joined += len(own)
    assert joined and all(i // 9 == j // 9 for i, j in zip(a, b, strict=True))


def test_linked_images_of_nothing_shared():
    lists = [_corners_of(" ".join(f"{k}x{n}" for n in range(400))) for k in range(3)]
    assert media.linked([0, 0, 0], [0, 1, 2], lists) == ([], [])
    assert media.linked([0, 1], [0, 1], [lists[0], lists[0]]) == ([], [])


def test_corners_of_many_images_are_those_of_each():
    """Images that are looked at together, of few lines, odd sides and no corners, against each alone."""
    rng = np.random.default_rng(11)
    images = [rng.integers(0, 256, (int(h), int(w))).astype(np.float32) for h, w in zip(rng.integers(1, 30, 80), rng.integers(1, 6, 80) * 7 - 6, strict=True)]
    images += [None, np.zeros((0, 5), np.float32), np.full((9, 8), 128.0), *(blocky(rng) for _ in range(60))]
    together = media.corners_of(images)
    assert len(together) == len(images) and sum(len(found[0]) for found in together) > 1000
    for image, found in zip(images, together, strict=True):
        assert all(one.shape == other.shape and (one == other).all() for one, other in zip(media.corners(image), found, strict=True))


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_rows_of_words_without_close_corners_go(size):
    """All pairs of rows of each key, whatever batches they come in; rows of keys that aren't few stay."""
    rng = np.random.default_rng(size)
    key, node = np.sort(rng.integers(0, 60, 400)), rng.integers(0, 9, 400)
    base = rng.integers(-(1 << 63), (1 << 63) - 1, (4, 2))
    halves = base[rng.integers(0, 4, 400)] ^ (1 << rng.integers(0, 63, (400, 2))) ^ np.where(rng.random((400, 2)) < 0.5, rng.integers(0, 1 << 12, (400, 2)), 0)
    few = key % 7 != 0
    rows = pa.RecordBatch.from_arrays([pa.array(v) for v in (key, node, np.arange(400, dtype=np.int32), few, halves[:, 0].copy(), halves[:, 1].copy())], names=["key", "node", "spot", "few", "one", "two"])
    bits = lambda i, j: sum((int(a) ^ int(b)).__and__((1 << 64) - 1).bit_count() for a, b in zip(halves[i], halves[j], strict=True))
    want = [i for i in range(400) if not few[i] or any(key[i] == key[j] and node[i] != node[j] and bits(i, j) <= media.APART for j in range(400))]
    got = [i for batch in media._near_rows(rows.slice(at, size) for at in range(0, 400, size)) for i in batch.column(2).to_pylist()]
    assert got == want and 100 < len(want) < 380
