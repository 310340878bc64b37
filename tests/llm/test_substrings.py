from __future__ import annotations

import hashlib
import random
import tempfile

import numpy as np
import pytest

from loamline.llm import induced, substrings


def common(b, i, j, cap):
    k = 0
    while k < cap and i + k < len(b) and j + k < len(b) and b[i + k] == b[j + k]:
        k += 1
    return k


@pytest.mark.parametrize("seed", range(40))
def test_order_and_common_prefixes(seed, monkeypatch):
    """Any text, with blocks and budgets so small that queues go to disk and names recurse."""
    rng = np.random.default_rng(seed)
    text = rng.integers(0, rng.integers(1, 6), rng.integers(1, 160)).astype(np.uint8)
    if seed % 3 == 0:
        text = np.tile(text[: max(1, len(text) // 4)], 4)
    monkeypatch.setattr(induced, "BLOCK", int(rng.choice([1, 4, 1 << 16])))
    cap = int(rng.choice([5, 100, 254]))
    with tempfile.TemporaryDirectory() as folder:
        got = list(induced.Sorter(text, folder, cap, int(rng.choice([3, 1 << 20])), int(rng.choice([1, 1 << 20]))).falling())
    pos, lcp = (np.concatenate([g[k] for g in got]).tolist() for k in (0, 1))
    raw = text.tobytes()
    assert sorted(pos) == list(range(len(raw)))
    for k in range(1, len(pos)):
        shared = common(raw, pos[k], pos[k - 1], cap)
        assert lcp[k] == shared
        assert shared == cap or raw[pos[k] :] < raw[pos[k - 1] :]


def plainly(docs, length=100):
    """Every window in a set, in order of id and text."""
    seen, out = set(), {}
    for i, text in docs:
        raw = text.encode()
        hit = np.zeros(len(raw) + 1, int)
        for s in range(len(raw) - length + 1):
            w = raw[s : s + length]
            if w in seen:
                hit[s] += 1
                hit[s + length] -= 1
            seen.add(w)
        gone = np.cumsum(hit)[:-1] > 0
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[i] = (len(raw), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def held(frame):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["starts"]), r["kept_sha256"]) for r in frame.collect()}


def test_same_as_a_set_of_all_windows(spark):
    rng = random.Random(1)
    base = "".join(rng.choice("ab c") for _ in range(900))
    docs = [(0, base), (1, base[100:460] + "X" + base[300:700]), (2, "ä" * 400), (3, "ab" * 150 + base[:250]), (4, base), (5, "short"), (6, base[:99]), (7, base[5:105]), (8, "zz" + base[500:] + base[:300])]
    docs += [(10 + i, "".join(rng.choice("abcd ") for _ in range(150)) + base[i * 30 : i * 30 + 99 + i]) for i in range(12)]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert held(substrings.repeated_substrings(frame)) == plainly(docs)
    assert held(substrings.repeated_substrings(frame, shard_bytes=1000)) == plainly(docs)


def test_chunks_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 300)
    text = "".join(random.Random(2).choice("abcde ") for _ in range(2500))
    raw = text.encode()
    h, first, last = substrings.anchors(raw)
    assert sorted(s for a, b in zip(first, last, strict=True) for s in range(a, b + 1)) == list(range(len(raw) - 99))
    assert {raw[a : a + 100]: x for a, x in zip(first.tolist(), h.tolist(), strict=True)} == {raw[a : a + 100]: x for a, x in zip(first.tolist(), h.tolist(), strict=True)}


def test_odd_rows(spark, odd):
    got = substrings.repeated_substrings(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["n_bytes"] == by[2][0]["n_bytes"] == 0 and by[2][0]["kept_sha256"] == hashlib.sha256(b"").hexdigest()
    assert by[5][0]["n_removed"] == 0 and all(r["n_removed"] == r["n_bytes"] for r in by[6])  # alike rows are one document
    assert by[8][0]["n_removed"] == 30_000 - 1 and 0 < by[7][0]["n_removed"] < by[7][0]["n_bytes"]
    assert substrings.repeated_substrings(odd.limit(0)).count() == 0
    with pytest.raises(TypeError):
        substrings.repeated_substrings(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
