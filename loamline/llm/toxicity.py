"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Words are looked up in a lexicon: a small fixed list of insults, and words that the labelled sample has
far more often in toxic rows. Written with look-alike signs, split by dots or with letters drawn out,
they count as obfuscated. The features are densities of both lists over the whole text, the densest
stretch, nearness of second-person words to hits, capitals, punctuation and obfuscation rates. Trees are
grown on one fold of the labelled sample and calibrated on another; the held-out fold is never read.
"""

from __future__ import annotations

import re
import string

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import arrow_map, cut, pick, place_of, plain, text_bytes
from .labelled import fold, held_out, sample

#: Labelled rows that a fit sees at most, about half of them for the trees.
FIT_ROWS = 20_000
#: Learned lexicon: size, least toxic rows with the word, least share of toxic rows, least log odds.
LEARNED, LEAST_ROWS, LEAST_SHARE, LEAST_ODDS = 256, 4, 0.004, 3.0
TREES, DEPTH, RATE, BINS, LEAST_LEAF = 60, 3, 0.2, 32, 5
#: Words before and after a hit that count as near.
NEAR = 5
STRETCH = 50
CACHED = 400_000
#: Words handled at a time.
CHUNK = 1 << 17

#: Insults, and second-person words of the four languages.
INSULTS = frozenset(
    "idiot idiots idiotic moron morons stupid dumb dumbass fool imbecile loser losers pathetic worthless trash garbage scum clown disgusting bastard bitch asshole"
    " cretin jerk vermin filth degenerate retard connard salaud abruti imbécile pauvre-type dummkopf arschloch trottel vollidiot abschaum estúpido estúpida imbécil basura escoria".split()
)
SECOND = frozenset("you your yours yourself you're u tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch usted ustedes ti tus vosotros".split())
#: Signs that stand for letters.
SIGNS = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l"})
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
MARKS = string.punctuation
SIGN_SET = frozenset("013457@$!|")
DRAWN = re.compile(r"(.)\1{2,}")
FEATURES = 15
HIT, LEARNT, OBFUSCATED, MASKED, STRETCHED, PERSON, CAPITALS = (1 << i for i in range(7))


class Reader:
    """Feature rows of texts; remembers what it has worked out for a word."""

    def __init__(self, learned: frozenset[str] | set[str] = frozenset()):
        self.learned, self.known = learned, {}

    def code(self, word: str) -> int:
        if len(self.known) >= CACHED:
            self.known.clear()
        core = word.strip(MARKS)
        if not core.isalnum():
            core = EDGES.sub("", core)
        low = core.lower()
        code = 0
        if low in INSULTS:
            code |= HIT
        elif low in self.learned:
            code |= LEARNT
        if low in SECOND:
            code |= PERSON
        if len(core) > 1 and core.isupper():
            code |= CAPITALS
        if not low.isalpha() and any(map(str.isalpha, low)):
            code |= MASKED
        if not low.isdigit() and DRAWN.search(low):
            code |= STRETCHED
        if not code & (HIT | LEARNT):
            forms = {DRAWN.sub(r"\1", low), DRAWN.sub(r"\1\1", low)} if code & STRETCHED else set()
            if code & MASKED or not SIGN_SET.isdisjoint(word):
                raw = word.lower().strip(".,;:?\"'()")
                read = raw.translate(SIGNS)
                forms |= {read, EDGES.sub("", read), re.sub(r"[\W_]+", "", raw), re.sub(r"[\W_]+", "", read)}
            if any(f != low and len(f) > 3 and (f in INSULTS or f in self.learned) for f in forms):
                code |= OBFUSCATED
        if len(word) <= 64:
            self.known[word] = code
        return code

    def features(self, text: str | None) -> list[float]:
        words = (text or "").split()
        n = len(words)
        if not n:
            return [0.0] * FEATURES
        codes = np.empty(n, np.int64)
        get, code = self.known.get, self.code
        for at in range(0, n, CHUNK):
            part = words[at : at + CHUNK]
            codes[at : at + len(part)] = [code(w) if c is None else c for w, c in zip(part, map(get, part))]
        hits = np.flatnonzero(codes & (HIT | OBFUSCATED))
        any_hit = np.flatnonzero(codes & (HIT | LEARNT | OBFUSCATED))
        persons = np.flatnonzero(codes & PERSON)
        near = 0.0
        if len(any_hit) and len(persons):
            near = float((np.searchsorted(persons, any_hit + NEAR, "right") > np.searchsorted(persons, any_hit - NEAR, "left")).mean())
        densest = int((np.searchsorted(any_hit, any_hit + STRETCH, "left") - np.arange(len(any_hit))).max()) if len(any_hit) else 0
        raw = text_bytes(text)
        size = len(raw)
        upper = size - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        shouts = raw.count(b"!") + raw.count(b"?")
        marks = size - len(raw.translate(None, b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"))
        rate = lambda bit: float(np.count_nonzero(codes & bit)) / n
        return [rate(HIT), rate(LEARNT), rate(OBFUSCATED), rate(MASKED), rate(STRETCHED), rate(PERSON), near, rate(CAPITALS), upper / size, shouts / size, marks / size, float(np.log1p(n)), float(np.log1p(len(hits))), float(np.log1p(len(any_hit))), float(densest)]


class Trees:
    """Boosted trees of fixed depth on logistic loss, split on histogram bins."""

    def __init__(self, start: float, trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """trees: by node in heap order, feature (-1: none) and threshold; by node, value."""
        self.start, self.trees = start, trees

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, value in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = feature[at]
                right = x[rows, np.maximum(f, 0)] > threshold[at]
                at = np.where(f < 0, at, 2 * at + 1 + right)
            out += value[at]
        return out

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray) -> Trees:
        share = min(max(y.mean() if len(y) else 0.5, 1e-3), 1 - 1e-3)
        model = cls(float(np.log(share / (1 - share))), [])
        if not len(y) or y.min() == y.max():
            return model
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
        # Rare values sit above the quantiles, so non-zero ones get edges of their own.
        edges = [np.unique(np.concatenate([e, [0.0], np.quantile(v, np.linspace(0, 1, 9)[:-1])])) if len(v := x[x[:, f] > 0, f]) else e for f, e in enumerate(edges)]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        width = max(len(e) for e in edges) + 1
        raw = np.full(len(y), model.start)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-raw))
            g, h = y - p, p * (1 - p)
            nodes = (1 << (DEPTH + 1)) - 1
            feature, threshold, value = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
            at = np.zeros(len(y), np.int64)
            for node in range(nodes):
                mine = np.flatnonzero(at == node)
                if not len(mine):
                    continue
                G, H = g[mine].sum(), h[mine].sum()
                value[node] = RATE * G / (H + 1.0)
                if node >= (1 << DEPTH) - 1 or len(mine) < 2 * LEAST_LEAF:
                    continue
                best = (1e-6, -1, 0)
                for f in range(x.shape[1]):
                    b = binned[mine, f]
                    cg, ch, cn = (np.cumsum(np.bincount(b, v, width))[:-1] for v in (g[mine], h[mine], np.ones(len(mine))))
                    gain = cg**2 / (ch + 1) + (G - cg) ** 2 / (H - ch + 1) - G**2 / (H + 1)
                    gain[(cn < LEAST_LEAF) | (len(mine) - cn < LEAST_LEAF)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], f, k)
                _, f, k = best
                if f >= 0 and k < len(edges[f]):
                    feature[node], threshold[node] = f, edges[f][k]
                    at[mine] = 2 * node + 1 + (x[mine, f] > edges[f][k])
            tree = (feature, threshold, value)
            model.trees.append(tree)
            raw += cls(0.0, [tree]).raw(x)
        return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: raw scores and the rising probabilities at them, one a block end."""
    if not len(y):
        return np.array([0.0]), np.array([0.5])
    levels, inverse = np.unique(raw, return_inverse=True)
    blocks: list[list[float]] = []  # sum, count, first, last
    for level, s, n in zip(levels.tolist(), np.bincount(inverse, y).tolist(), np.bincount(inverse).tolist(), strict=True):
        blocks.append([s, n, level, level])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, n, _, last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], last]
    at = np.array([x for b in blocks for x in ((b[2],) if b[2] == b[3] else (b[2], b[3]))])
    p = np.array([v for b in blocks for v in [b[0] / b[1]] * (1 if b[2] == b[3] else 2)])
    return at, p


#: Share of the uncalibrated probability in a score; it orders rows that calibration makes equal.
BLEND = 0.01


class Model:
    def __init__(self, learned: frozenset[str], trees: Trees, at: np.ndarray, p: np.ndarray):
        self.reader, self.trees, self.at, self.p = Reader(learned), trees, at, p

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        raw = self.trees.raw(np.array([self.reader.features(t) for t in texts]))
        return (1 - BLEND) * np.interp(raw, self.at, self.p) + BLEND / (1 + np.exp(-raw))


def learned_words(rows: DataFrame) -> frozenset[str]:
    """Words of toxic rows far above their rate elsewhere; rows has text and label."""
    words = F.array_distinct(F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), r"\s+"), lambda w: F.regexp_replace(w, r"^[\W_]+|[\W_]+$", "")))
    sums = rows.agg(F.count("*"), F.sum("label")).first()
    n, ones = sums[0], sums[1] or 0
    if not ones or ones == n:
        return frozenset()
    per = rows.select("label", F.explode(words).alias("word")).where("word <> ''").groupBy("word").agg(F.sum("label").alias("bad"), F.count("*").alias("all"))
    odds = F.log((F.col("bad") + 0.5) / (ones + 1)) - F.log((F.col("all") - F.col("bad") + 0.5) / (n - ones + 1))
    top = per.where(F.col("bad") >= max(LEAST_ROWS, LEAST_SHARE * ones)).withColumn("odds", odds).where(F.col("odds") >= LEAST_ODDS).orderBy(F.desc("bad"), "word").limit(LEARNED)
    return frozenset(r["word"] for r in top.collect())


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Trees on the fold 0 of the bounded sample, calibration on its fold 2. Only feature rows, at most
    fit_rows of them, come to the driver."""
    rows = sample(docs, labels, label_col, fit_rows, id_col, text_col).select("id", "turn", fold(F.col("id")).alias("fold"), "label", "text")
    rows = cut(rows)
    learned = learned_words(rows.where("fold = 0"))

    def task():
        read = Reader(learned).features
        return lambda c: {"turn": c["turn"], "fold": c["fold"], "label": c["label"], "x": [read(t) for t in c["text"]]}

    got = arrow_map(rows.select("turn", "fold", "label", "text"), task, "turn long, fold long, label int, x array<double>").collect()
    got.sort(key=lambda r: (r["turn"], r["label"], r["x"]))
    x, y = np.array([r["x"] for r in got]).reshape(-1, FEATURES), np.array([r["label"] for r in got], dtype=float)
    first = np.array([r["fold"] == 0 for r in got], dtype=bool)
    trees = Trees.fit(x[first], y[first])
    return Model(learned, trees, *isotonic(trees.raw(x[~first]), y[~first]))


def _shared(docs: DataFrame, model: Model):
    parts = (model.reader.learned, model.trees, model.at, model.p)  # bounded: LEARNED words, TREES trees
    return docs.sparkSession.sparkContext.broadcast(parts)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", fit_rows: int = FIT_ROWS, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, held_out, score and predicted of each row's whole text.

    Null, empty and blank texts have all features 0 and a score like any row; rows with a null id are
    scored too and counted to the fold of the empty id; repeated rows come out as often as they go in;
    without any labelled row every score is 0.5; an empty table gives an empty result.
    """
    shared = _shared(docs, train(docs, labels, label_col, fit_rows, id_col, text_col))
    rows = pick(docs, id=id_col, text=text_col)

    def task():
        model = Model(*shared.value)
        return lambda c: {"id": c["id"], "score": model.scores(c["text"]).tolist()}

    out = arrow_map(rows, task, f"id {rows.schema['id'].dataType.simpleString()}, score double")
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", fit_rows: int = FIT_ROWS, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, all columns, without the rows that score at least the threshold."""
    shared = _shared(docs, train(docs, labels, label_col, fit_rows, id_col, text_col))
    rows, at = plain(docs), place_of(docs, text_col)

    def keep(batches):
        import pyarrow as pa

        model = Model(*shared.value)
        for batch in batches:
            scores = [model.scores(batch.column(at).slice(i, 512).to_pylist()) for i in range(0, batch.num_rows, 512)]
            yield batch.filter(pa.array(np.concatenate([*scores, np.zeros(0)]) < threshold))

    return rows.mapInArrow(keep, rows.schema).toDF(*docs.columns)
