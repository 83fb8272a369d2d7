"""Text quality by a generalised additive model with pairwise interactions.

Features are shape statistics of the whole text, computed for a batch of texts by
numpy.  The model is a lookup table per feature and per chosen pair of features:
boosting goes round the features in turn, each step fitting a tree of ``LEAVES``
leaves on one feature's bins to the gradient of the log loss and adding it, shrunk,
to that feature's table (Lou et al., 2012, 2013).  Then the pairs whose joint bins
explain most of what is left are boosted the same way.  A score is a sum of table
entries, so scoring is ``searchsorted`` and additions over arrays.

The model is fitted on at most ``TRAIN_ROWS`` labelled documents, all documents are
scored, and nothing is shuffled.

Cases: a null or empty text has zero features and a score like any other; a null
doc_id takes part (it is never labelled); repeated rows each get a row; with no
training row of one of the classes every score is the share of the other; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit
from .labels import fold, only, training_rows

#: Bound of the labelled rows that the model is fitted on.
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, LEAVES = 64, 8, 4
ROUNDS, PAIR_ROUNDS, PAIRS, RATE = 150, 60, 10, 0.1
#: predicted = score >= THRESHOLD.
THRESHOLD = 0.3

FEATURES = ("bytes", "words", "word_bytes", "upper", "digit", "symbol", "shout", "bar", "beyond_ascii", "white",
            "lines", "words_a_line", "distinct_words", "top_word", "same_neighbour", "longest_run", "distinct_pairs",
            "short_words", "stops", "capital_starts", "first_half_symbols", "first_half_upper")


def _bytes_in(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[[ord(c) for c in chars]] = True
    return t


UPPER, DIGIT = _bytes_in("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _bytes_in("0123456789")
SYMBOL = _bytes_in("#$%&*+<=>@^_`{|}~\\")


def features(texts: list[bytes]) -> np.ndarray:
    """A row of FEATURES for each text."""
    w = kit.Words(texts)
    n = len(texts)
    a = np.frombuffer(w.buf, np.uint8)
    size = np.array([len(t) for t in texts], float)

    def share(mask: np.ndarray, lo=None, hi=None) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        lo, hi = w.base[:-1] if lo is None else lo, w.base[:-1] + size.astype(np.int64) if hi is None else hi
        return (total[hi] - total[lo]) / np.maximum(hi - lo, 1)

    count = np.diff(w.first).astype(float)
    own = w.owner()
    each = np.maximum(count, 1)
    length = (w.end - w.start).astype(float)
    per = lambda x: np.bincount(own, x, minlength=n)
    order = np.lexsort((w.hash, own))
    h, o = w.hash[order], own[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, o[at], runs)
    same = np.zeros(len(own), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (own[1:] == own[:-1])
    begin = np.flatnonzero(~same)
    longest = np.zeros(n)
    np.maximum.at(longest, own[begin], np.diff(np.append(begin, len(own))))
    g, where = w.grams(2)
    pair = np.unique(np.column_stack((own[where].astype(np.uint64), g)), axis=0) if len(g) else np.zeros((0, 2), np.uint64)
    distinct_pairs = np.bincount(pair[:, 0].astype(np.int64), minlength=n) / np.maximum(count - 1, 1)
    lines = share(a == 10) * size + 1
    last = a[np.maximum(w.end - 1, 0)] if len(own) else np.zeros(0, np.uint8)
    stops = (last == 46) | (last == 63)
    half = w.base[:-1] + size.astype(np.int64) // 2
    return np.column_stack((
        np.log1p(size), np.log1p(count), per(length) / each, share(UPPER[a]), share(DIGIT[a]), share(SYMBOL[a]),
        share(a == 33), share(a == 124), share(a >= 128), share(kit.WHITE[a]), np.log(lines), np.log1p(count / lines),
        np.bincount(o[at], minlength=n) / each, top / each, per(same.astype(float)) / each, np.log1p(longest), distinct_pairs,
        per((length <= 3).astype(float)) / each, per(stops.astype(float)) / each,
        per(UPPER[a[w.start]].astype(float) if len(own) else np.zeros(0)) / each,
        share(SYMBOL[a], None, half), share(UPPER[a], None, half)))


def _leaf_values(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values over ordered bins of a tree of LEAVES leaves, grown best split first."""
    cg, ch = np.concatenate(([0.0], np.cumsum(g))), np.concatenate(([0.0], np.cumsum(h)))
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + 1.0)

    def best(a: int, b: int):
        if b - a < 2:
            return 0.0, a
        c = np.arange(a + 1, b)
        s = gain(a, c) + gain(c, b) - gain(a, b)
        ok = (ch[c] - ch[a] > 0.5) & (ch[b] - ch[c] > 0.5)
        s = np.where(ok, s, 0.0)
        k = int(s.argmax())
        return float(s[k]), int(c[k])
    parts = [(0, len(g))]
    while len(parts) < LEAVES:
        found = [(*best(a, b), i) for i, (a, b) in enumerate(parts)]
        s, c, i = max(found)
        if s <= 1e-9:
            break
        a, b = parts.pop(i)
        parts += [(a, c), (c, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + 1.0)
    return out


@dataclass
class Model:
    start: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)  # by feature
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)  # features and table over coarse bins

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)])

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        if self.edges and len(x):
            b = self.bins(x)
            for k, t in enumerate(self.tables):
                total += t[b[:, k]]
            coarse = b * PAIR_BINS // BINS
            for i, j, t in self.pairs:
                total += t[coarse[:, i], coarse[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def train(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost the tables, features first, then the pairs."""
    p = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(float(np.log(p / (1 - p))))
    if not len(y) or y.min() == y.max():
        return model
    for k in range(x.shape[1]):
        model.edges.append(np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])))
    b = model.bins(x)
    model.tables = [np.zeros(BINS) for _ in model.edges]
    total = np.full(len(y), model.start)

    def gradient():
        q = 1 / (1 + np.exp(-total))
        return y - q, q * (1 - q)
    for _ in range(ROUNDS):
        for k, t in enumerate(model.tables):
            g, h = gradient()
            step = RATE * _leaf_values(np.bincount(b[:, k], g, minlength=BINS), np.bincount(b[:, k], h, minlength=BINS))
            t += step
            total += step[b[:, k]]
    coarse = b * PAIR_BINS // BINS
    g, h = gradient()
    gains = []
    for i in range(x.shape[1]):
        for j in range(i):
            cell = coarse[:, i] * PAIR_BINS + coarse[:, j]
            cg, ch = (np.bincount(cell, v, minlength=PAIR_BINS ** 2) for v in (g, h))
            gains.append((float(np.sum(cg ** 2 / (ch + 5.0))), i, j))
    for _, i, j in sorted(gains, reverse=True)[:PAIRS]:
        model.pairs.append((i, j, np.zeros((PAIR_BINS, PAIR_BINS))))
    for _ in range(PAIR_ROUNDS):
        for i, j, t in model.pairs:
            g, h = gradient()
            cell = coarse[:, i] * PAIR_BINS + coarse[:, j]
            cg, ch = (np.bincount(cell, v, minlength=PAIR_BINS ** 2).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h))
            # One split on the first feature, a tree on the second on either side.
            best, step = -1.0, None
            for c in range(1, PAIR_BINS):
                s = np.empty_like(t)
                for rows in (slice(0, c), slice(c, None)):
                    s[rows] = _leaf_values(cg[rows].sum(axis=0), ch[rows].sum(axis=0))
                gain = float(np.sum(s * cg - 0.5 * s * s * ch))
                if gain > best:
                    best, step = gain, s
            t += RATE * step
            total += RATE * step.ravel()[cell]
    return model


def _rows(frames):
    """(frame, features) in chunks of bounded text."""
    for f in frames:
        f = f.reset_index(drop=True)
        texts = kit.to_bytes(f["text"])
        for a, b in kit.chunks(texts):
            yield f.iloc[a:b], features(texts[a:b])


def _training(frames):
    for f, x in _rows(frames):
        yield pd.DataFrame({"doc_id": f["doc_id"], "y": f["y"], "x": list(x)})


def fit(docs: DataFrame, labels: DataFrame, keep=None, rows: int = TRAIN_ROWS) -> Model:
    """Learn from at most ``rows`` labelled documents whose id passes ``keep``."""
    ids = training_rows(labels, "quality", F.lit(True) if keep is None else keep, rows)
    got = kit.map_texts(only(docs, ids), _training, "doc_id long, y int, x array<double>").toPandas()
    got = got.sort_values("doc_id", kind="stable")  # the same sums in the same order, whatever the partitions
    x = np.array(got["x"].tolist()).reshape(-1, len(FEATURES))
    order = np.lexsort((*x.T, got["doc_id"].to_numpy())) if len(x) else []
    return train(x[order], got["y"].to_numpy(float)[order])


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) per row."""
    def run(frames):
        for f, x in _rows(frames):
            p = model.score(x)
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64").array, "score": p, "predicted": (p >= THRESHOLD).astype(np.int32)})
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return kit.map_texts(d, run, "doc_id long, score double, predicted int")


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Quality of every document; labels of the rows held out are never read."""
    docs = kit.table(spark, sf_dir, "documents")
    model = fit(docs, kit.table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    got = scores(docs, model)
    return got.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
