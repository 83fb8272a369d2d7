"""Hard negatives by LEMP-style pruning of lengths and coordinates.

For every anchor: its best ``positives`` rows of the same label by inner product, and for
each of them the best ``negatives`` rows of other labels whose score lies between two
shares of the positive's.  Both are one search: a query brings *windows* (lowest and highest
score), and of each window the best rows are wanted, of its own label or of any other.

*   Length buckets.  Rows are put into buckets of lengths that differ by at most a tenth,
    and a bucket of many rows is cut by a hash of the id into pages of about ``PAGE``
    rows.  A query whose length times the bucket's greatest length stays below its
    threshold isn't sent to the bucket.
*   Thresholds.  The first pass asks one page of each bucket, which gives each window a
    k-th score; the second pass takes the best of that and the window's lower end to the
    other pages.  Every row is read by one of the two.
*   Coordinate lists.  A page keeps its unit vectors' coordinates sorted.  If cos(q, p) must
    be t or more, then p_f = cos b with |a - b| <= arccos t for q_f = cos a: a feasible
    range of each coordinate f.  The ranges of the query's ``FOCUS`` greatest coordinates
    are found in the lists by binary search, the shortest is read and intersected with
    the others, and what is left is verified by exact integer products.  Where even the
    shortest range holds most of the page, the page is multiplied as a whole.

A task holds one page and one block of about ``QUERIES`` queries.  Blocks are numbered among
the queries that ask for a bucket, so a bucket's rows are sent once for each ``QUERIES``
queries that need them.  For rows of the same label, buckets are also kept apart by a hash of
the label (``GROUPS``).  The driver holds the list of buckets: lengths of 64-bit vectors
have under 1,000 of them, times ``GROUPS``.

Cases: rows with a null id, label or vector, or with a null or non-finite component, take
no part; vectors of different lengths are compared over the components that both have; a row that
repeats an id, label and vector counts once; of several rows of an anchor's id the one of
the smallest label, then vector, is the anchor, and no row of that id is its positive or
negative; ties go to the smaller id; a positive with a negative score has no feasible
negatives; fewer rows: all; an empty table: no rows.  Scores are exact while they fit 64 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kit

#: The parameters of the query.
SCALE = 256
POSITIVES = 5
NEGATIVES = 3
LOW, HIGH = 50, 95
#: Rows of a page, queries of a block (as expected values of a hash).
PAGE = 1 << 15
QUERIES = 1 << 13
#: Groups of labels that are searched apart.
GROUPS = 64
#: Lengths of a bucket differ by this factor at most.
RATIO = 1.1
#: Coordinates of a query whose ranges are intersected.
FOCUS = 6
#: Slack of bounds, for rounding.
SLACK = 1e-9

ROW = "id long, label long, length double, v binary"
HIT = "q long, w int, id long, score long"


def pack(q: np.ndarray) -> bytes:
    """Integers as bytes: two each if they fit, else eight; the first byte tells."""
    small = not len(q) or (q.min() >= -(1 << 15) and q.max() < 1 << 15)
    return b"\2" + q.astype("<i2").tobytes() if small else b"\x08" + q.astype("<i8").tobytes()


def unpack(values) -> np.ndarray:
    """Packed vectors as rows of int64, with zeros where one is shorter."""
    values = list(values)
    if values and len({(v[0], len(v)) for v in values}) == 1:
        a = np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)[:, 1:]
        return np.ascontiguousarray(a).view(f"<i{values[0][0]}").astype(np.int64)
    rows = [np.frombuffer(v, f"<i{v[0]}", offset=1) for v in values]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int64)
    for k, r in enumerate(rows):
        out[k, :len(r)] = r
    return out


def _quantise(scale: int):
    def run(frames):
        for f in frames:
            rows = []
            for i, label, x in zip(f["id"].tolist(), f["label"].tolist(), f["v"]):
                try:
                    x = np.asarray(x, float)
                except (TypeError, ValueError):
                    continue  # a null component
                if not np.isfinite(x).all():
                    continue
                q = np.floor(scale * x).astype(np.int64)
                rows.append((i, label, math.sqrt(float(q.astype(float) @ q.astype(float))), pack(q)))
            yield pd.DataFrame(rows, columns=["id", "label", "length", "v"])
    return run


def quantised(df: DataFrame, scale: int = SCALE) -> DataFrame:
    """(id, label, length, v) of the rows (id, label, v: array) that take part; component x becomes floor(scale x)."""
    known = df.where("id is not null and label is not null and v is not null")
    return known.select(F.col("id").cast("long"), F.col("label").cast("long"), "v").mapInPandas(_quantise(scale), ROW)


class Page:
    """Rows of one length bucket with sorted coordinate lists."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, v: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, self.v = ids[order], labels[order], v[order]
        if len(ids) > 1:  # repeated rows
            seen: set = set()
            keep = np.ones(len(ids), bool)
            for k in np.flatnonzero(np.isin(self.ids, self.ids[1:][self.ids[1:] == self.ids[:-1]])):
                row = (self.ids[k], self.labels[k], self.v[k].tobytes())
                keep[k] = row not in seen
                seen.add(row)
            self.ids, self.labels, self.v = self.ids[keep], self.labels[keep], self.v[keep]
        self.float = self.v.astype(float)
        self.length = np.sqrt(np.einsum("ij,ij->i", self.float, self.float))
        self.longest = float(self.length.max(initial=0))
        self.unit = self.float / np.maximum(self.length, 1)[:, None]
        self.lists: dict[int, tuple] = {}
        self.verified = 0

    def _list(self, f: int) -> tuple:
        if f not in self.lists:
            order = np.argsort(self.unit[:, f]).astype(np.int32)
            self.lists[f] = order, self.unit[order, f]
        return self.lists[f]

    def candidates(self, q: np.ndarray, length: float, least: float) -> np.ndarray | None:
        """Rows that can score ``least`` with q (None: no range is short)."""
        if least <= 0:
            return None
        reach = length * self.longest
        t = least / reach if reach else 2.0
        if t > 1 + SLACK:
            return np.zeros(0, np.int64)
        gamma = math.acos(min(t, 1.0)) + 1e-7
        focus = np.argsort(-np.abs(q))[:FOCUS]
        ranges = []
        for f in focus.tolist():
            a = math.acos(max(-1.0, min(1.0, q[f] / length)))
            low, high = math.cos(min(math.pi, a + gamma)) - SLACK, math.cos(max(0.0, a - gamma)) + SLACK
            order, values = self._list(f)
            x, y = np.searchsorted(values, low), np.searchsorted(values, high, side="right")
            ranges.append((int(y - x), int(x), f, low, high))
        ranges.sort()
        n, x, f, _, _ = ranges[0]
        if 2 * n > len(self.ids):
            return None
        rows = self._list(f)[0][x:x + n]
        for _, _, f, low, high in ranges[1:]:
            at = self.unit[rows, f]
            rows = rows[(at >= low) & (at <= high)]
        return np.sort(rows)

    def search(self, own: np.ndarray, labels: np.ndarray, v: np.ndarray, windows: list, k: int, same: bool):
        """(query number, window number, id, score) of the best k rows in each window, given
        as (number, lowest, highest) for each query."""
        d = max(v.shape[1], self.v.shape[1])
        if v.shape[1] < d:
            v = np.pad(v, ((0, 0), (0, d - v.shape[1])))
        if self.v.shape[1] < d:
            more = ((0, 0), (0, d - self.v.shape[1]))
            self.v, self.float, self.unit = (np.pad(x, more) for x in (self.v, self.float, self.unit))
            self.lists = {}
        length = np.sqrt(np.einsum("ij,ij->i", v.astype(float), v.astype(float)))
        exact = self.longest * length.max(initial=0) < 2 ** 53
        dense = []
        for i in range(len(own)):
            rows = self.candidates(v[i].astype(float), length[i], min(w[1] for w in windows[i]))
            if rows is None:
                dense.append(i)
            elif len(rows):
                self.verified += len(rows)
                yield from self._best(i, rows, self.v[rows] @ v[i], own, labels, windows, k, same)
        step = max((1 << 22) // max(len(self.ids), 1), 1)
        every = np.arange(len(self.ids))
        for a in range(0, len(dense), step):
            part = dense[a:a + step]
            self.verified += len(part) * len(every)
            scores = (v[part].astype(float) @ self.float.T).astype(np.int64) if exact else v[part] @ self.v.T
            for i, s in zip(part, scores):
                yield from self._best(i, every, s, own, labels, windows, k, same)

    def _best(self, i, rows, scores, own, labels, windows, k, same):
        least, most = min(w[1] for w in windows[i]), max(w[2] for w in windows[i])
        fits = (scores >= least) & (scores <= most) & ((self.labels[rows] == labels[i]) == same) & (self.ids[rows] != own[i])
        rows, scores = rows[fits], scores[fits]
        if not len(rows):
            return
        order = np.lexsort((self.ids[rows], -scores))
        rows, scores = rows[order], scores[order]
        for number, low, high in windows[i]:
            a = np.searchsorted(-scores, -high)
            for at in range(a, min(a + k, len(rows))):
                if scores[at] < low:
                    break
                yield i, number, int(self.ids[rows[at]]), int(scores[at])


def _searched(k: int, same: bool):
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        hits = []
        if len(rows) and len(queries):
            page = Page(rows["id"].to_numpy(), rows["label"].to_numpy(), unpack(rows["v"]))
            own = queries["q"].to_numpy()
            windows = [[(int(w["w"]), int(w["low"]), int(w["high"])) for w in ws] for ws in queries["windows"]]
            found = page.search(own, queries["label"].to_numpy(), unpack(queries["v"]), windows, k, same)
            hits = [(int(own[i]), w, who, s) for i, w, who, s in found]
        return pd.DataFrame(hits, columns=["q", "w", "id", "score"])
    return run


def best(hits: DataFrame, k: int) -> DataFrame:
    """The best k of each window, with rank n."""
    order = W.partitionBy("q", "w").orderBy(F.desc("score"), "id")
    return hits.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def search(rows: DataFrame, queries: DataFrame, k: int, same: bool) -> DataFrame:
    """(q, w, id, score): of each window of ``queries`` (q, label, length, v, windows:
    array of w, low, high) the best ``k`` of ``rows`` (id, label, length, v)."""
    spark = rows.sparkSession
    group = F.pmod(F.xxhash64("label"), F.lit(GROUPS)).cast("int") if same else F.lit(0)
    bucket = F.floor(F.log(F.greatest(F.col("length"), F.lit(1.0))) / math.log(RATIO)).cast("int")
    rows = rows.withColumn("group", group).withColumn("bucket", bucket)
    # Columns of their own, also where the queries are some of the rows.
    queries = queries.select(*[F.col(c).alias(c) for c in ("q", "label", "length", "v", "windows")]).withColumn("group", group)
    # Bounded: a bucket for each factor of RATIO that a length can have, times GROUPS.
    listed = rows.groupBy("group", "bucket").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest")).collect()
    pages = spark.createDataFrame([(r["group"], r["bucket"], -(-r["n"] // PAGE), r["longest"]) for r in listed],
                                  "group int, bucket int, pages int, longest double")

    def passed(first: bool, asked: DataFrame) -> DataFrame:
        low = F.array_min(F.transform("windows", lambda w: w["low"]))
        reach = F.col("length") * F.col("longest") * (1 + SLACK)
        wanted = asked.join(F.broadcast(pages if first else pages.where("pages > 1")), "group").where(low <= reach)
        counts = wanted.groupBy("group", "bucket").count().collect()
        blocks = F.broadcast(spark.createDataFrame([(r["group"], r["bucket"], -(-r["count"] // QUERIES)) for r in counts],
                                                   "group int, bucket int, blocks int"))
        wanted = wanted.join(blocks, ["group", "bucket"]).withColumn("block", F.pmod(F.xxhash64("q"), F.col("blocks")))
        numbers = F.array(F.lit(0)) if first else F.sequence(F.lit(1), F.col("pages") - 1)
        wanted = wanted.withColumn("page", F.explode(numbers)).select("group", "bucket", "page", "block", "q", "label", "v", "windows")
        given = rows.join(F.broadcast(pages), ["group", "bucket"]).withColumn("page", F.pmod(F.xxhash64("id"), F.col("pages")).cast("int"))
        given = given.where("page = 0" if first else "page > 0").join(blocks, ["group", "bucket"])
        given = given.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - F.lit(1).cast("long"))))
        key = ("group", "bucket", "page", "block")
        given = given.select(*key, "id", "label", "v")
        return given.groupBy(*key).cogroup(wanted.groupBy(*key)).applyInPandas(_searched(k, same), HIT)

    hits = best(passed(True, queries), k).drop("n").checkpoint()
    if max((r["n"] for r in listed), default=0) <= PAGE:
        return hits
    # The k-th score so far is a window's threshold; equal scores may have a smaller id.
    least = hits.groupBy("q", "w").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") == k)
    flat = queries.select("q", F.explode("windows").alias("x")).select("q", "x.w", "x.low", "x.high")
    flat = flat.join(least, ["q", "w"], "left").select("q", F.struct("w", F.coalesce("kth", "low").alias("low"), "high").alias("x"))
    again = queries.drop("windows").join(flat.groupBy("q").agg(F.collect_list("x").alias("windows")), "q")
    return best(hits.unionAll(passed(False, again.checkpoint())), k).drop("n")


def hard_negatives(rows: DataFrame, anchors, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the
    ``rows`` (id, label, length, v) that the condition ``anchors`` on id holds for; a negative scores from
    ``low`` to ``high`` hundredths of its positive."""
    rows = rows.checkpoint()
    first = rows.where(anchors).groupBy(F.col("id").alias("q")).agg(F.min(F.struct("label", "v", "length")).alias("x"))
    first = first.select("q", "x.label", "x.length", "x.v").checkpoint()
    ends = "array(named_struct('w', 0, 'low', {}, 'high', {}))".format("-9223372036854775807L", "9223372036854775807L")
    pos = best(search(rows, first.withColumn("windows", F.expr(ends)), positives, True), positives)
    pos = pos.select("q", F.col("n").alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    pos = pos.where("positive_score >= 0").checkpoint()
    window = F.struct("w", F.expr(f"({low} * positive_score + 99) div 100").alias("low"), F.expr(f"{high} * positive_score div 100").alias("high"))
    asked = first.join(pos.groupBy("q").agg(F.collect_list(window).alias("windows")), "q").checkpoint()
    neg = best(search(rows, asked, negatives, False), negatives)
    out = pos.join(neg, ["q", "w"])
    return out.select(F.col("q").alias("anchor_id"), "positive_id", F.col("n").alias("rank"), F.col("id").alias("negative_id"),
                      "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose id is divisible by 50; every seventh id has a spoilt label."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = kit.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), label.alias("label"), F.col("embedding").alias("v"))
    return hard_negatives(quantised(rows), F.col("id") % 50 == 0)


#: The query by its definition; sums of whole numbers are exact in doubles here.
SQL = """
WITH e AS (SELECT DISTINCT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS q, r.id, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score
  FROM e a JOIN e r ON a.id <> r.id WHERE a.id % 50 = 0),
p AS (SELECT q, id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY q ORDER BY score DESC, id) <= 5),
n AS (SELECT p.q AS anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.q, p.id ORDER BY s.score DESC, s.id) AS k
  FROM p JOIN s ON p.q = s.q AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3
"""
