"""Quantile bins and exact, seeded, repeatable splits.

Split sizes follow the reference's library rules; membership follows the
seeded order of :mod:`dhvani.operators.rank`.  Small tables (quantile edges,
per-bin quotas: at most five rows) are computed with DataFrame aggregates and
reach the row-level plan as scalar subqueries or broadcast joins of bounded
size.  No step gathers rows into one task or onto the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .manifest import MIN_DUR
from .quantile import exact_quantiles
from .rank import SEED, seed_hash, seeded_rank

QUANTILES = (0.0, 0.2, 0.4, 0.6, 0.8, 1.0)


def duration_edges(df: DataFrame, min_dur: float = MIN_DUR, col: str = "duration_sec") -> DataFrame:
    """One row, ``edges ARRAY<DOUBLE>``: exact 0/20/.../100 % quantiles
    (linear interpolation) of ``max(duration, min_dur)``, duplicates dropped, found by
    radix selection (:mod:`dhvani.operators.quantile`): no task merges the values."""
    d = F.greatest(F.col(col), F.lit(float(min_dur)))
    q = exact_quantiles(df.select(d.alias("_d")), "_d", QUANTILES)
    return q.select(F.array_distinct("quantiles").alias("edges"))


def bin_of(x: Column, edges: Column) -> Column:
    """Right-closed bins, lowest edge included: 1 + #interior edges below x.

    Written without a lambda (there are at most ``len(QUANTILES) - 2``
    interior edges) so ``edges`` may be a scalar subquery."""
    n = F.size(edges)
    below = [F.when((n - 1 > i) & (F.element_at(edges, i + 1) < x), 1).otherwise(0)
             for i in range(1, len(QUANTILES) - 1)]
    total = below[0]
    for b in below[1:]:
        total = total + b
    return (F.lit(1) + total).cast("int")


def duration_bins(df: DataFrame, min_dur: float = MIN_DUR, col: str = "duration_sec",
                  bin_col: str = "dur_bin") -> DataFrame:
    """Add the quantile bin (1..5) of each row; edges come in as a scalar subquery."""
    edges = duration_edges(df, min_dur, col).scalar()
    return df.withColumn(bin_col, bin_of(F.greatest(F.col(col), F.lit(float(min_dur))), edges))


def _apportion(counts: DataFrame, grp: str, cnt: str, total: Column, out: str) -> DataFrame:
    """Largest-remainder apportionment of ``total`` over groups by ``cnt``.

    Integer arithmetic throughout: floor(total*c/n) plus one unit for the
    groups with the largest remainders (total*c mod n), ties to the lower id.
    ``counts`` has at most a handful of rows (one per bin)."""
    w_all = Window.partitionBy()
    x = (counts.withColumn("_n", F.sum(cnt).over(w_all))
         .withColumn("_t", total)
         .withColumn("_fl", F.when(F.col("_n") > 0, F.expr(f"(_t * `{cnt}`) div _n")).otherwise(0))
         .withColumn("_rem", F.when(F.col("_n") > 0, F.expr(f"(_t * `{cnt}`) % _n")).otherwise(0)))
    x = x.withColumn("_short", F.col("_t") - F.sum("_fl").over(w_all))
    x = x.withColumn("_r", F.row_number().over(Window.orderBy(F.col("_rem").desc(), F.col(grp))))
    x = x.withColumn(out, (F.col("_fl") + F.when(F.col("_r") <= F.col("_short"), 1).otherwise(0)).cast("long"))
    return x.drop("_n", "_t", "_fl", "_rem", "_short", "_r")


def split_sizes(n: Column, val_frac: float, test_frac: float):
    """(rest, test) sizes: rest = ceil((val+test)*n), test = ceil(test/(val+test)*rest)."""
    vt = float(val_frac) + float(test_frac)
    rest = F.ceil(F.lit(vt) * n).cast("long")
    test = F.ceil(F.lit(float(test_frac) / vt) * rest).cast("long")
    return rest, test


def stratified_split(df: DataFrame, val_frac: float = 0.05, test_frac: float = 0.05,
                     seed: int = SEED, key_cols: Sequence[str] = ("wav_path",),
                     min_dur: float = MIN_DUR, unique_key: bool = False,
                     split_col: str = "split") -> DataFrame:
    """Three-way split stratified by duration quintile; ``split`` in
    {train, val, test}.  Without ``duration_sec`` it is :func:`random_split`.

    Per bin b with c_b rows: rest_b and test_b are apportioned exactly; rows
    ranked 1..test_b in the seeded order go to test, up to rest_b to val, the
    others to train.  ``dur_bin`` is dropped from the output.
    """
    if "duration_sec" not in df.columns:
        return random_split(df, val_frac, test_frac, seed, key_cols, unique_key, split_col)
    cols = df.columns
    x = duration_bins(df, min_dur)
    counts = x.groupBy("dur_bin").agg(F.count(F.lit(1)).alias("_c"))
    n = F.sum("_c").over(Window.partitionBy())
    rest, test = split_sizes(n, val_frac, test_frac)
    q = _apportion(counts, "dur_bin", "_c", rest, "_rest_b")
    q = _apportion(q, "dur_bin", "_rest_b", test, "_test_b")
    q = q.select("dur_bin", F.col("_test_b").alias("_q1"), F.col("_rest_b").alias("_q2"))
    if unique_key:
        return _label_by_cutoffs(x, q, key_cols, seed, "dur_bin", split_col).select(*cols, split_col)
    ranked = seeded_rank(x, key_cols, seed, by=["dur_bin"], rank_col="_rank", few_groups=True)
    y = ranked.join(F.broadcast(q), "dur_bin")
    label = (F.when(F.col("_rank") <= F.col("_q1"), "test")
             .when(F.col("_rank") <= F.col("_q2"), "val").otherwise("train"))
    return y.select(*cols, label.alias(split_col))


CUT_DIGITS = 4


def _label_by_cutoffs(df: DataFrame, quotas: DataFrame, key_cols: Sequence[str], seed: int, by: str,
                      split_col: str) -> DataFrame:
    """Label rows of unique keys: the first ``_q1`` of each group in the seeded order are
    test, up to ``_q2`` val, the others train (``quotas``: by, _q1, _q2; a few rows).

    Only the hash at each quota is looked for: counts by the first hash digits (16^4 a
    group) tell the bucket that holds it, that bucket alone is ranked, and then each row
    compares its own hash.  No other column is shuffled."""
    h = seed_hash(key_cols, seed)
    slim = df.select(by, h.alias("_h"), F.substring(h, 1, CUT_DIGITS).alias("_b"))
    sizes = slim.groupBy(by, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    wanted = quotas.select(by, F.inline(F.array(*[F.struct(F.lit(k).alias("_k"), F.col(f"_q{k}").alias("_q")) for k in (1, 2)])))
    at = sizes.join(F.broadcast(wanted), by).filter((F.col("_off") < F.col("_q")) & (F.col("_q") <= F.col("_off") + F.col("_n")))
    found = slim.join(F.broadcast(at.select(by, "_b", "_off", "_k", "_q")), [by, "_b"])  # two buckets a group at most
    place = F.row_number().over(Window.partitionBy(by, "_b", "_k").orderBy("_h"))
    found = found.withColumn("_r", F.col("_off") + place).filter(F.col("_r") == F.col("_q"))
    cuts = found.groupBy(by).agg(*[F.max(F.when(F.col("_k") == k, F.col("_h"))).alias(f"_cut{k}") for k in (1, 2)])
    y = df.join(F.broadcast(cuts), by, "left")
    label = F.when(h <= F.col("_cut1"), "test").when(h <= F.col("_cut2"), "val").otherwise("train")
    return y.withColumn(split_col, label).drop("_cut1", "_cut2")


def random_split(df: DataFrame, val_frac: float = 0.05, test_frac: float = 0.05,
                 seed: int = SEED, key_cols: Sequence[str] = ("wav_path",),
                 unique_key: bool = False, split_col: str = "split") -> DataFrame:
    """Unstratified three-way split with the same sizes."""
    cols = df.columns
    if unique_key:
        # One group for all rows, as a column (0: hex digits hold no x) so that joins have a key.
        x = df.withColumn("_all", F.instr(seed_hash(key_cols, seed), "x"))
        rest, test = split_sizes(F.count(F.lit(1)), val_frac, test_frac)
        quotas = x.groupBy("_all").agg(test.alias("_q1"), rest.alias("_q2"))
        return _label_by_cutoffs(x, quotas, key_cols, seed, "_all", split_col).select(*cols, split_col)
    n = df.select(F.count(F.lit(1))).scalar()
    rest, test = split_sizes(n, val_frac, test_frac)
    ranked = seeded_rank(df, key_cols, seed, rank_col="_rank")
    label = (F.when(F.col("_rank") <= test, "test")
             .when(F.col("_rank") <= rest, "val").otherwise("train"))
    return ranked.select(*cols, label.alias(split_col))


def parallel_split_sizes(n: Column):
    """val = test = max(100, floor(0.1 n)); train = max(0, n - val - test)."""
    nv = F.greatest(F.lit(100), F.floor(F.lit(0.10) * n)).cast("long")
    nt = nv
    ntr = F.greatest(F.lit(0), n - nv - nt).cast("long")
    return ntr, nv, nt


def parallel_split(df: DataFrame, seed: int = SEED, key_cols: Sequence[str] | None = None,
                   split_col: str = "split") -> DataFrame:
    """Seeded shuffle, then consecutive slices train, val, test.

    With fewer than 200 rows train is empty and test takes what is left."""
    cols = df.columns
    key_cols = list(key_cols or cols)
    n = df.select(F.count(F.lit(1))).scalar()
    ntr, nv, nt = parallel_split_sizes(n)
    ranked = seeded_rank(df, key_cols, seed, rank_col="_rank")
    r = F.col("_rank")
    label = (F.when(r <= ntr, "train").when(r <= ntr + nv, "val")
             .when(r <= ntr + nv + nt, "test"))
    return ranked.select(*cols, label.alias(split_col)).filter(F.col(split_col).isNotNull())


# Top-k merges (n x input partitions) rows in one task, so it is used only
# for small n (the few displayed examples); larger samples use the rank.
TOPK_LIMIT = 100


def sample_n(df: DataFrame, n: int, seed: int = SEED, key_cols: Sequence[str] | None = None) -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement in the seeded order.

    Small ``n`` plans as a top-k (``TakeOrderedAndProject``: each task keeps n
    rows, no full sort); large ``n`` uses the distributed rank."""
    cols = df.columns
    key_cols = list(key_cols or cols)
    if n <= TOPK_LIMIT:
        return (df.withColumn("_h", seed_hash(key_cols, seed))
                .orderBy("_h", *cols).limit(int(n)).drop("_h"))
    ranked = seeded_rank(df, key_cols, seed, rank_col="_rank")
    return ranked.filter(F.col("_rank") <= n).select(*cols)
