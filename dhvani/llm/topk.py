"""Exact top-k inner products by best-first search of M-trees.

A component x counts as floor(1024 x).  The search for the largest inner product is
made a metric one: with M^2 the largest squared norm of the table, a vector v becomes
(v, sqrt(M^2 - |v|^2)) and a query q becomes (q, 0), and then
|q' - v'|^2 = |q|^2 + M^2 - 2 q v: nearest is best.

*   Root.  ``PIVOTS`` vectors, the smallest by a hash, are the routing objects of the
    root.  Every row goes to the nearest one; the root entry keeps the covering radius
    and the number of rows.  A pivot of many rows is cut by a hash of the id into
    subtrees of about ``SUBTREE`` rows, so a crowded region (or a vector that a third
    of the rows repeat) isn't one task's.
*   First pass.  Each query searches one subtree of its nearest pivot, which gives it
    a k-th score.
*   Second pass.  It goes on to the other subtrees whose root entry can hold a better
    score, by the triangle inequality.
*   A subtree is an M-tree in a task: pages of routing objects with covering radii
    and distances to the parent; best-first search leaves out nodes and entries by
    |d(q, parent) - d(parent, child)| before it computes a distance.

Queries are dealt in blocks of about ``QUERIES``, so a task holds SUBTREE rows and
QUERIES queries whatever the table's size.  Ties go to the smaller vec_id.

Cases: rows with a null id or vector, or with a null or non-finite component, take no
part; vectors of different lengths are compared over the components that both have;
a row that repeats an id and its vector counts once; of several vectors of a query's
id the smallest is the query; all rows with the query's id are its own; fewer than k
candidates: all.  Scores are exact while they fit 64 bits.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kit

#: Routing objects of the root: the bounded sample that the index is fitted on.
PIVOTS = 64
#: Rows of a subtree, queries of a block (as expected values of a hash).
SUBTREE = 4096
QUERIES = 1024
#: Entries of a leaf page.
PAGE = 128
#: Relative slack of bounds, for rounding.
SLACK = 1e-9


def quantise(frames):
    """(vec_id, v, norm, dim) of the rows that take part; v: int64 components as bytes."""
    for f in frames:
        rows = []
        for i, x in zip(f["vec_id"].tolist(), f["embedding"]):
            if x is None or pd.isna(i):
                continue
            try:
                x = np.asarray(x, float)
            except (TypeError, ValueError):
                continue  # a null component
            if not np.isfinite(x).all():
                continue
            q = np.floor(1024 * x).astype(np.int64)
            rows.append((int(i), q.tobytes(), float(q.astype(float) @ q.astype(float)), len(q)))
        yield pd.DataFrame(rows, columns=["vec_id", "v", "norm", "dim"])


def matrix(values, dim: int) -> np.ndarray:
    """Vectors as rows of int64, with zeros where one is shorter."""
    out = np.zeros((len(values), dim), np.int64)
    for i, b in enumerate(values):
        x = np.frombuffer(b, np.int64)
        out[i, :len(x)] = x
    return out


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    """Vectors in the metric space."""
    x = x.astype(float)
    return np.column_stack((x, np.sqrt(np.maximum(top - np.einsum("ij,ij->i", x, x), 0))))


class Node:
    __slots__ = ("centre", "radius", "to_parent", "children", "rows", "far")

    def __init__(self, centre, radius, to_parent):
        self.centre, self.radius, self.to_parent = centre, radius, to_parent
        self.children, self.rows, self.far = [], None, None


class MTree:
    """An M-tree over the rows of ``x`` (in the metric space), loaded in bulk."""

    def __init__(self, x: np.ndarray):
        self.x = x
        self.root = self._node(np.arange(len(x)), 0, 0.0)

    def _node(self, rows: np.ndarray, centre: int, to_parent: float) -> Node:
        far = np.linalg.norm(self.x[rows] - self.x[centre], axis=1)
        node = Node(centre, float(far.max(initial=0)), to_parent)
        if len(rows) <= PAGE:
            node.rows, node.far = rows, far
            return node
        a = rows[int(far.argmax())]
        da = np.linalg.norm(self.x[rows] - self.x[a], axis=1)
        b = rows[int(da.argmax())]
        db = np.linalg.norm(self.x[rows] - self.x[b], axis=1)
        left = da <= db
        if left.all():  # equal points
            left = np.arange(len(rows)) < len(rows) // 2
        for c, part, d in ((a, left, far), (b, ~left, far)):
            own = float(np.linalg.norm(self.x[c] - self.x[centre]))
            node.children.append(self._node(rows[part], c, own))
        return node

    def search(self, q: np.ndarray, own: int, v: np.ndarray, ids: np.ndarray, norm: float, top: float, k: int,
               least: float) -> list[tuple[int, int]]:
        """The k best (score, -vec_id) of the rows with another id than ``own`` and a
        score of ``least`` or more; ``q``: the query's integers."""
        point = np.append(q.astype(float), 0.0)
        best: list[tuple[int, int]] = []
        reach = lambda s: np.sqrt(max(norm + top - 2 * s, 0)) * (1 + SLACK) + 1e-6  # noqa: E731  the distance of a score
        limit = reach(least) if least > -np.inf else np.inf
        d = float(np.linalg.norm(self.x[self.root.centre] - point))
        heap = [(max(0.0, d - self.root.radius), 0, d, self.root)]
        n = 0
        while heap:
            bound, _, d, node = heapq.heappop(heap)
            if bound > limit:
                break
            for c in node.children:
                if abs(d - c.to_parent) - c.radius > limit:
                    continue  # by the stored distance alone
                dc = float(np.linalg.norm(self.x[c.centre] - point))
                low = max(bound, dc - c.radius)
                if low <= limit:
                    n += 1
                    heapq.heappush(heap, (low, n, dc, c))
            if node.rows is None:
                continue
            rows = node.rows[np.abs(d - node.far) <= limit]
            rows = rows[ids[rows] != own]
            if not len(rows):
                continue
            score = v[rows] @ q
            if len(best) == k:
                fit = score >= best[0][0]
                rows, score = rows[fit], score[fit]
            for s, i in zip(score.tolist(), ids[rows].tolist()):
                if s < least:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (s, -i))
                elif (s, -i) > best[0]:
                    heapq.heapreplace(best, (s, -i))
            if len(best) == k:
                limit = min(limit, reach(best[0][0]))
        return best


def _cell(dim: int, top: float, k: int):
    """Search a block of queries in a subtree."""
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(rows):
            rows = rows.drop_duplicates(["vec_id", "v"])
            v, ids = matrix(rows["v"], dim), rows["vec_id"].to_numpy(np.int64)
            tree = MTree(lifted(v, top))
            for i, q, least in zip(queries["vec_id"].tolist(), matrix(queries["v"], dim), queries["least"].tolist()):
                norm = float(q.astype(float) @ q.astype(float))
                got = tree.search(q, i, v, ids, norm, top, k, -np.inf if pd.isna(least) else least)
                out += [(i, -m, s) for s, m in got]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")
    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows (vec_id, embedding) that fulfil
    ``is_query``, against all rows."""
    from ..session import ensure_checkpoint_dir

    spark = vectors.sparkSession
    ensure_checkpoint_dir(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.mapInPandas(quantise, "vec_id long, v binary, norm double, dim long")
    top, dim = rows.agg(F.max("norm"), F.max("dim")).first()
    found_schema = "query_id long, vec_id long, score long"
    if dim is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    pivots = [r["v"] for r in rows.orderBy(F.xxhash64("v", "vec_id"), "vec_id").limit(PIVOTS).select("v").collect()]

    def assign(frames):
        """Nearest pivot of each row and the distance to it; and of the query's point."""
        at = lifted(matrix(pivots, dim), top)
        square = np.einsum("ij,ij->i", at, at)
        for f in frames:
            x = lifted(matrix(f["v"], dim), top)
            far = np.maximum(np.einsum("ij,ij->i", x, x)[:, None] + square - 2 * x @ at.T, 0)
            f = f[["vec_id", "v", "norm"]].copy()
            f["pivot"] = far.argmin(axis=1)
            f["far"] = np.linalg.norm(x - at[f["pivot"].to_numpy()], axis=1) if len(f) else np.zeros(0)
            yield f

    tree = rows.mapInPandas(assign, "vec_id long, v binary, norm double, pivot long, far double").checkpoint()
    # The root's entries: at most PIVOTS rows.
    root = {r["pivot"]: (r["n"], r["r"]) for r in tree.groupBy("pivot").agg(F.count("*").alias("n"), F.max("far").alias("r")).collect()}
    parts = {p: max(1, -(-n // SUBTREE)) for p, (n, _) in root.items()}
    cuts = F.element_at(F.create_map(*[F.lit(int(x)) for kv in parts.items() for x in kv]), F.col("pivot").cast("int"))
    tree = tree.withColumn("sub", F.pmod(F.xxhash64("vec_id"), cuts.cast("long")))
    queries = tree.where(is_query).groupBy("vec_id").agg(F.min_by(F.struct("v", "norm", "pivot", "sub"), "v").alias("q")).select("vec_id", "q.*")
    blocks = max(1, -(-queries.count() // QUERIES))
    queries = queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(blocks)))

    def search(asked: DataFrame, where: DataFrame) -> DataFrame:
        data = where.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        key = ["pivot", "sub", "block"]
        return (asked.select(*key, "vec_id", "v", "least").groupBy(*key)
                .cogroup(data.select(*key, "vec_id", "v").groupBy(*key)).applyInPandas(_cell(dim, top, k), found_schema))

    first = search(queries.withColumn("least", F.lit(None).cast("double")), tree).checkpoint()
    known = _best(first, k).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("least"))
    asked = queries.join(known.withColumnRenamed("query_id", "vec_id"), "vec_id", "left")

    def onward(frames):
        """The other subtrees that may hold a score of ``least`` or more."""
        at = lifted(matrix(pivots, dim), top)
        entries = sorted(root.items())
        for f in frames:
            out = []
            for i, v, norm, pivot, sub, block, least in f[["vec_id", "v", "norm", "pivot", "sub", "block", "least"]].itertuples(index=False):
                q = np.append(matrix([v], dim)[0].astype(float), 0.0)
                d = np.linalg.norm(at - q, axis=1)
                reach = np.inf if pd.isna(least) else np.sqrt(max(norm + top - 2 * least, 0)) * (1 + SLACK) + 1e-6
                for p, (_, radius) in entries:
                    if d[p] - radius <= reach:
                        out += [(i, v, p, s, block, least) for s in range(parts[p]) if (p, s) != (pivot, sub)]
            yield pd.DataFrame(out, columns=["vec_id", "v", "pivot", "sub", "block", "least"])

    asked = asked.mapInPandas(onward, "vec_id long, v binary, pivot long, sub long, block long, least double")
    return _best(first.unionAll(search(asked, tree)), k).select("query_id", "rank", "vec_id", "score")


def op2_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The ten best of all rows for every row whose id is divisible by 100."""
    return top_k(kit.table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(100)) == 0)


SQL = """
WITH x AS (SELECT vec_id, embedding FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
e AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS v FROM x),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
