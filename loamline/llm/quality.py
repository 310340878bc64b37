"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader.

A text's words give two sequences: the words themselves (lower case, without marks at their ends) and
their shapes (runs of upper case, lower case, digits and each mark). Unigrams and bigrams of the first
and n-grams up to three of the second are hashed into 2**bits weights; a feature's value is its share of
the text's words. FTRL-proximal (McMahan et al., 2013) updates only the weights of a row's own
features. A score is the sparse dot product, squashed; only non-zero weights are broadcast, at most
2**bits of them.
"""

from __future__ import annotations

import math
import re

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, pick
from .labelled import held_out, sample

BITS = 18
#: Labelled rows that a fit sees at most.
FIT_ROWS = 12_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.15, 1.0, 0.02, 0.5
#: A feature's value is its share of the words times this.
SCALE = 20.0
CACHED = 400_000
EDGES = re.compile(r"^\W+|\W+$")
#: Words handled at a time.
CHUNK = 1 << 17


def shape_of(word: str) -> str:
    """'Xx+.' for 'The.': classes in order, '+' after a run of more than one."""
    out, last, run = [], "", 0
    for c in word:
        k = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if k == last:
            run += 1
            if run == 2:
                out.append("+")
        else:
            out.append(k)
            last, run = k, 1
    return "".join(out)


class Hasher:
    """Feature numbers of a text; numbers the words it meets and keeps their hashes in arrays."""

    def __init__(self, bits: int = BITS):
        self.shift, self.known = np.uint64(64 - bits), {}
        self.words, self.shapes = np.zeros(CACHED + CHUNK, np.uint64), np.zeros(CACHED + CHUNK, np.uint64)

    def numbers(self, words: list[str]) -> np.ndarray:
        if len(self.known) >= CACHED:
            self.known.clear()
        ids = np.fromiter(map(self.known.get, words, [-1] * len(words)), np.int64, len(words))
        for i in np.flatnonzero(ids < 0).tolist():
            word = words[i]
            n = self.known.get(word)
            if n is None:
                n = self.known[word] = len(self.known)
                self.words[n] = xxhash.xxh64_intdigest(EDGES.sub("", word).lower().encode("utf-8", "surrogatepass"), 1)
                self.shapes[n] = xxhash.xxh64_intdigest(shape_of(word).encode("utf-8", "surrogatepass"), 2)
            ids[i] = n
        return ids

    def features(self, text: str | None):
        """Arrays of feature numbers, part by part, and the number of words in each part."""
        words = (text or "").split()
        for at in range(0, len(words), CHUNK):
            part = words[at : at + CHUNK]
            ids = self.numbers(part)
            w, s = self.words[ids], self.shapes[ids]
            a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
            two = s[:-1] * b + s[1:]
            grams = [w * a, s * a, (w[:-1] * b + w[1:]) * a, two * a, (two[:-1] * b + s[2:]) * a]
            yield (np.concatenate(grams) >> self.shift).astype(np.int64), len(part)


def squash(z: float) -> float:
    return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, z))))


class Model:
    def __init__(self, weights: np.ndarray, bias: float, bits: int = BITS):
        self.weights, self.bias, self.hasher = weights.astype(np.float32), bias, Hasher(bits)

    def score(self, text: str | None) -> float:
        total, n = 0.0, 0
        for grams, words in self.hasher.features(text):
            total += float(self.weights[grams].sum(dtype=np.float64))
            n += words
        return squash(self.bias + (SCALE * total / n if n else 0.0))


def fit(rows: list[tuple[str | None, int]], bits: int = BITS, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias after ``epochs`` passes over (text, label) in the order given."""
    hasher, kept = Hasher(bits), []
    for text, label in rows:
        parts = list(hasher.features(text))
        n = sum(k for _, k in parts)
        at, count = np.unique(np.concatenate([g for g, _ in parts]), return_counts=True) if n else (np.zeros(0, np.int64), np.zeros(0))
        kept.append((at.astype(np.int32), (count * (SCALE / max(1, n))).astype(np.float32), label))
    z, n2 = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z = bias_n = 0.0
    ones = sum(y for _, _, y in kept)
    # Both classes weigh alike, else the rare one would hardly pull.
    weight = (len(kept) / (2 * max(1, len(kept) - ones)), len(kept) / (2 * max(1, ones)))

    def solve(z, n2):
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n2)) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, y in kept:
            w = solve(z[at], n2[at])
            b = -bias_z / ((BETA + math.sqrt(bias_n)) / ALPHA)
            slope = (squash(b + float(w @ x)) - y) * weight[y]
            g = slope * x
            sigma = (np.sqrt(n2[at] + g * g) - np.sqrt(n2[at])) / ALPHA
            z[at] += g - sigma * w
            n2[at] += g * g
            sigma = (math.sqrt(bias_n + slope * slope) - math.sqrt(bias_n)) / ALPHA
            bias_z += slope - sigma * b
            bias_n += slope * slope
    return solve(z, n2), -bias_z / ((BETA + math.sqrt(bias_n)) / ALPHA)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fit_rows: int = FIT_ROWS, bits: int = BITS, id_col: str = "doc_id", text_col: str = "text") -> tuple[np.ndarray, float]:
    """Weights and bias, fitted in one task on the bounded sample in the order of its ids' hashes. No
    labelled row gives all zeros."""
    rows = sample(docs, labels, label_col, fit_rows, id_col, text_col).select("turn", "label", "text").repartition(1).sortWithinPartitions("turn", "label", "text")

    def run(batches):
        import pyarrow as pa

        held = [(t, y) for b in batches for t, y in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True)]
        if held:
            weights, bias = fit(held, bits)
            at = np.flatnonzero(weights)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *at.tolist()], pa.int64()), pa.array([bias, *weights[at].tolist()], pa.float64())], names=["at", "weight"])

    weights, bias = np.zeros(1 << bits), 0.0
    for at, w in rows.mapInArrow(run, "at long, weight double").collect():
        if at < 0:
            bias = w
        else:
            weights[at] = w
    return weights, bias


def quality_scores(docs: DataFrame, labels: DataFrame, label_col: str = "quality", fit_rows: int = FIT_ROWS, bits: int = BITS, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of each row's whole text.

    Only words go into a score. Null, empty and blank texts have no features and score what the bias
    says; rows with a null id are scored too and counted to the fold of the empty id; repeated rows come
    out as often as they go in; without any labelled row all scores are 0.5.
    """
    weights, bias = train(docs, labels, label_col, fit_rows, bits, id_col, text_col)
    at = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((at, weights[at], bias))  # at most 2**bits weights
    rows = pick(docs, id=id_col, text=text_col)

    def task():
        at, values, bias = shared.value
        weights = np.zeros(1 << bits)
        weights[at] = values
        model = Model(weights, bias, bits)
        return lambda c: {"id": c["id"], "score": [model.score(t) for t in c["text"]]}

    out = arrow_map(rows, task, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
