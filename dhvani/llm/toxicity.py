"""Toxicity by maximum-scoring segments.

Learning: for each token (a run of letters and digits, A-Z lower-cased) count
the toxic and the clean training documents that hold it, and compare both with
the informative Dirichlet prior that the sum of the classes gives (Monroe et
al., 2008).  Tokens that a share ``SUPPORT`` of the documents of a class holds and
whose log-odds differ by ``Z`` standard errors enter the model, the ``MAX_TOKENS``
most certain ones; all other tokens share the log-odds of the remaining mass, which
is below zero.

Scoring: the token scores of a text form a sequence, and one linear scan
(Ruzzo and Tompa, 1999) finds all its disjoint maximal-scoring segments.  Under
clean text the best segment of n tokens follows an extreme-value law,
P(S < x) = exp(-K n exp(-lambda x)) (Karlin and Altschul, 1990): lambda solves
sum p(s) exp(lambda s) = 1 over the clean training tokens, K is its maximum-
likelihood value over the clean training documents.  A segment with an
expected count K n exp(-lambda S) of ``SIGNIFICANCE`` at most is a passage.
The document's evidence lambda S - ln(K n) is mapped to a probability by a
logistic curve in it and ln n over the training documents.

Cases: a null or empty text, or one without tokens, has no passage and the
evidence of a text of one token and no segment; a null doc_id takes part (it
is never labelled); repeated rows each get a row; with no training row of one
of the classes every score is 0; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit
from .labels import fold, only, training_rows

#: Bound of the labelled rows that the model is fitted on.
TRAIN_ROWS = 20_000
#: Bound of the tokens in the model.
MAX_TOKENS = 50_000
#: Standard errors that a token's log-odds must differ from zero by.
Z = 4.5
#: Share of the documents of a class that must hold a token for it to enter the model.
SUPPORT = 0.02
#: Dirichlet prior: pseudo-counts of a token over both classes.
PRIOR = 2.0
#: Largest |score| of a token.
CLIP = 8.0
#: Expected number of such segments in a clean text of the same length.
SIGNIFICANCE = 0.05
#: predicted = score >= THRESHOLD.
THRESHOLD = 0.7


@dataclass
class Model:
    tokens: np.ndarray  # sorted uint64 hashes
    scores: np.ndarray  # float64, of the tokens
    rest: float  # score of any other token, below zero
    lam: float
    k: float
    curve: tuple[float, float, float]  # logistic curve: intercept, evidence, ln of the tokens

    def token_scores(self, words: kit.Words) -> np.ndarray:
        """Score of each word; NaN marks the rest."""
        out = np.full(len(words.hash), np.nan)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, words.hash), len(self.tokens) - 1)
            hit = np.flatnonzero(self.tokens[at] == words.hash)
            out[hit] = self.scores[at[hit]]
        return out

    def evidence(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.lam * best - np.log(self.k * np.maximum(n, 1))

    def probability(self, best: np.ndarray, n: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * self.evidence(best, n) + c * np.log(np.maximum(n, 1)), -30, 30)))


def segments(places: np.ndarray, scores: np.ndarray, rest: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (first, last, score) of a sequence that has
    ``scores`` at ``places`` (ascending) and ``rest`` < 0 everywhere else."""
    found: list[list] = []  # first, last, sum before it, sum up to its end
    total, before = 0.0, -1
    for p, s in zip(places.tolist(), scores.tolist()):
        total += rest * (p - before - 1)
        before = p
        if s <= 0:
            total += s
            continue
        new = [p, p, total, total + s]
        total += s
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= new[2]:
                # Entries whose left sum isn't smaller can never be extended to the right.
                if found[j][4] < 0:
                    j = -1
                else:
                    j = found[j][4]
            if j < 0 or found[j][3] >= new[3]:
                found.append([*new[:4], j])
                break
            new = [found[j][0], new[1], found[j][2], new[3]]
            del found[j:]
    return [(f, l, r - b) for f, l, b, r, _ in found]


def _best(model: Model, words: kit.Words) -> Iterator[tuple[int, int, list[tuple[int, int, float]]]]:
    """(text, its tokens, its segments) of each text."""
    score = model.token_scores(words)
    hit = np.flatnonzero(~np.isnan(score))
    lo = np.searchsorted(hit, words.first)
    for i in range(len(words.first) - 1):
        at = hit[lo[i]:lo[i + 1]]
        n = int(words.first[i + 1] - words.first[i])
        yield i, n, segments(at - words.first[i], score[at], model.rest) if len(at) else []


def _pieces(frames: Iterator[pd.DataFrame]):
    """(frame, words) in chunks of bounded text."""
    for f in frames:
        f = f.reset_index(drop=True)
        texts = kit.to_bytes(f["text"], lower=True)
        for a, b in kit.chunks(texts):
            yield f.iloc[a:b], kit.Words(texts[a:b], kit.NOT_WORD)


def _count(frames):
    for f, w in _pieces(frames):
        y = f["y"].to_numpy()
        own = w.owner()
        order = np.lexsort((own, w.hash))
        h, o = w.hash[order], own[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
        h, toxic = h[new], y[o[new]]
        tok, at = np.unique(h, return_index=True)
        t = np.add.reduceat(toxic, at) if len(at) else np.zeros(0, np.int64)
        n = np.diff(np.append(at, len(h)))
        yield pd.DataFrame({"tok": tok.view(np.int64), "t": t.astype(np.int64), "c": (n - t).astype(np.int64)})


def _histogram(model: Model):
    """Per training document: label, tokens, best segment; and counts of clean token scores."""
    def run(frames):
        for f, w in _pieces(frames):
            y = f["y"].to_numpy()
            rows = [(int(y[i]), n, max((s[2] for s in seg), default=0.0)) for i, n, seg in _best(model, w)]
            yield pd.DataFrame(rows, columns=["y", "n", "best"])
    return run


def fit(docs: DataFrame, labels: DataFrame, keep=None, rows: int = TRAIN_ROWS) -> Model:
    """Learn from at most ``rows`` labelled documents whose id passes ``keep``."""
    keep = F.lit(True) if keep is None else keep
    ids = training_rows(labels, "toxic", keep, rows)
    train = only(docs, ids)
    toxic, clean = sum(ids.values()), len(ids) - sum(ids.values())
    none = Model(np.zeros(0, np.uint64), np.zeros(0), -1.0, 1.0, 1.0, (-30.0, 0.0, 0.0))
    if not toxic or not clean:
        return none
    counts = kit.map_texts(train, _count, "tok long, t long, c long")
    counts = counts.groupBy("tok").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    sums = counts.agg(F.sum("t"), F.sum("c")).first()
    if not sums[0] or not sums[1]:
        return none
    nt, nc = float(sums[0]), float(sums[1])
    # Pseudo-counts that leave a token without evidence at the ratio of the classes.
    at, ac = PRIOR * nt / (nt + nc), PRIOR * nc / (nt + nc)
    odds = F.log((F.col("t") + at) / nt) - F.log((F.col("c") + ac) / nc)
    err = F.sqrt(1 / (F.col("t") + at) + 1 / (F.col("c") + ac))
    cand = counts.withColumn("odds", odds).withColumn("z", F.abs(odds / err))
    known = (F.col("t") >= max(SUPPORT * toxic, 3)) | (F.col("c") >= max(SUPPORT * clean, 3))
    chosen = (cand.where(known & (F.col("z") >= Z))
              .orderBy(F.desc("z"), "tok").limit(MAX_TOKENS).select("tok", "t", "c", "odds").collect())
    tok = np.array([r["tok"] for r in chosen], np.int64).view(np.uint64)
    order = np.argsort(tok)
    t = np.array([r["t"] for r in chosen], float)[order]
    c = np.array([r["c"] for r in chosen], float)[order]
    score = np.clip(np.array([r["odds"] for r in chosen], float)[order], -CLIP, CLIP)
    rest_t, rest_c = (nt - t.sum()) / nt, (nc - c.sum()) / nc
    rest = min(float(np.log(max(rest_t, 1e-6) / max(rest_c, 1e-6))), -0.02)
    p = np.append(c / nc, max(rest_c, 1e-6))
    s = np.append(score, rest)
    model = Model(tok[order], score, rest, _lambda(p / p.sum(), s), 1.0, (0.0, 0.0, 0.0))
    got = kit.map_texts(train, _histogram(model), "y int, n long, best double").toPandas()
    return _calibrate(model, got["y"].to_numpy(), got["n"].to_numpy(), got["best"].to_numpy())


def _lambda(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 (1 where there is none)."""
    f = lambda x: float(np.sum(p * np.exp(np.minimum(x * s, 500)))) - 1
    if not (s > 0).any() or float(np.sum(p * s)) >= 0:
        return 1.0
    hi = 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    lo = 0.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return max(hi, 0.05)


def _calibrate(model: Model, y: np.ndarray, n: np.ndarray, best: np.ndarray) -> Model:
    """K from the clean documents, then the logistic curve over all (Newton's steps)."""
    clean = y == 0
    model.k = float(clean.sum() / max(np.sum(np.maximum(n[clean], 1) * np.exp(-model.lam * best[clean])), 1e-9))
    x = model.evidence(best, n)
    X = np.column_stack([np.ones(len(x)), x, np.log(np.maximum(n, 1))])
    w = np.zeros(3)
    ridge = np.diag([1e-3] * 3)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(X @ w, -30, 30)))
        step = np.linalg.solve((X * (p * (1 - p) + 1e-6)[:, None]).T @ X + ridge, X.T @ (y - p) - ridge @ w)
        w = w + np.clip(step, -2, 2)
    model.curve = (float(w[0]), float(max(w[1], 0.0)), float(w[2]))
    return model


def passages(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs``: doc_id, n_tokens, score, predicted and ``passages``,
    the significant segments as (start, end, score), start and end being byte
    places in the UTF-8 text."""
    def run(frames):
        for f, w in _pieces(frames):
            rows, best, size = [], [], []
            for i, n, seg in _best(model, w):
                top = max((s[2] for s in seg), default=0.0)
                e = [s for s in seg if model.k * n * np.exp(-model.lam * s[2]) <= SIGNIFICANCE]
                b = w.first[i]
                rows.append([{"start": int(w.start[b + s[0]] - w.base[i]), "end": int(w.end[b + s[1]] - w.base[i]),
                              "score": float(s[2])} for s in e])
                best.append(top)
                size.append(n)
            p = model.probability(np.array(best, float), np.array(size, float))
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64").array, "n_tokens": size, "score": p,
                                "predicted": (p >= THRESHOLD).astype(np.int32), "passages": rows})
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return kit.map_texts(d, run, "doc_id long, n_tokens long, score double, predicted int, "
                              "passages array<struct<start: long, end: long, score: double>>")


def train_fold(doc_id):
    return fold(doc_id, 3) != 1


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document; labels of the rows held out are never read."""
    docs = kit.table(spark, sf_dir, "documents")
    model = fit(docs, kit.table(spark, sf_dir, "labels"), train_fold(F.col("doc_id")))
    got = passages(docs, model)
    return got.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted",
                      F.size("passages").cast("long").alias("n_passages"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, with all their columns.

    The verdict is made beside the text in one pass: nothing is shuffled."""
    model = fit(docs, kit.table(spark, sf_dir, "labels"), train_fold(F.col("doc_id")))

    def judge():
        def passes(texts):
            data, mask = kit.to_bytes(texts, lower=True), np.ones(len(texts), bool)
            for a, b in kit.chunks(data):
                w = kit.Words(data[a:b], kit.NOT_WORD)
                best = np.array([max((s[2] for s in seg), default=0.0) for _, _, seg in _best(model, w)], float)
                mask[a:b] = model.probability(best, np.diff(w.first)) < THRESHOLD
            return mask
        return passes
    return kit.keep_rows(docs, judge)
