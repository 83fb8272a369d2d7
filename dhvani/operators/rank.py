"""Seeded order keys and exact global ranks without a global sort.

The reference shuffles with a seeded permutation.  Here the permutation is the
order of ``md5(key | seed)`` hex strings, which DuckDB reproduces, so every
split is value-checkable.

Scale design (``seeded_rank``):

* Rows are bucketed by the first ``prefix_len`` hex digits of the hash
  (65,536 buckets by default).  Bucket sizes are aggregated (a tiny shuffle
  after map-side combine), prefix-summed over at most ``16**prefix_len`` rows
  per group and broadcast back: the broadcast side is bounded by
  ``16**prefix_len * groups`` rows, independent of the data volume.
* Within a bucket a windowed running sum gives the local rank.  Buckets are a
  uniform hash of the key, so no bucket is hot unless keys repeat.
* Repeated keys (exact copies, or many rows sharing one key) are first
  collapsed map-side into one row with a count, ranked as a range, and then
  re-expanded in chunks of ``CHUNK`` ranks, each chunk in its own task, so a
  group of copies holding a third of all rows never lands in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42
CHUNK = 1 << 16  # ranks materialised per task when a collapsed group is re-expanded


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def seed_hash(cols: Sequence, seed: int = SEED) -> Column:
    """``md5(k1 | '|' | k2 | ... | '|' | seed)`` with nulls read as ''."""
    parts: list[Column] = []
    for c in cols:
        parts += [F.coalesce(_as_col(c).cast("string"), F.lit("")), F.lit("|")]
    return F.md5(F.concat(*parts, F.lit(str(seed))))


def seeded_rank(df: DataFrame, key_cols: Sequence, seed: int = SEED,
                by: Sequence[str] = (), rank_col: str = "rank",
                copies: str = "collapse", prefix_len: int = 4,
                few_groups: bool = False) -> DataFrame:
    """Add ``rank_col`` = 1-based position of each row in the seeded order.

    The order is ``md5(keys|seed)``, ties broken by the remaining columns.
    Ranks are dense and exact within each ``by`` group.  The bucket offsets
    (``16**prefix_len`` rows per group) are broadcast only when there is no
    group or the caller states ``few_groups`` (e.g. five duration bins);
    otherwise the join is left to the planner.  For many groups, prefer
    :func:`rank_within`.

    ``copies='collapse'`` (default) merges rows that share the key hash and all
    other column values map-side before any shuffle and expands them again in
    chunks.  ``copies='unique'`` skips that pass when the caller knows the key
    is unique.
    """
    by = list(by)
    data_cols = [c for c in df.columns]
    x = df.withColumn("_h", seed_hash(key_cols, seed))
    if copies == "collapse":
        x = x.groupBy(*data_cols, "_h").agg(F.count(F.lit(1)).alias("_n"))
    elif copies == "unique":
        x = x.withColumn("_n", F.lit(1).cast("long"))
    else:
        raise ValueError(f"copies must be 'collapse' or 'unique', not {copies!r}")
    x = x.withColumn("_b", F.substring("_h", 1, prefix_len))

    sizes = x.groupBy(*by, "_b").agg(F.sum("_n").alias("_bn"))
    wo = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_b", F.coalesce(F.sum("_bn").over(wo), F.lit(0)).alias("_off"))

    tiebreak = [c for c in data_cols if c not in by]
    wb = (Window.partitionBy(*by, "_b").orderBy("_h", *tiebreak)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("_cum", F.sum("_n").over(wb))
    bounded = not by or few_groups
    x = x.join(F.broadcast(offsets) if bounded else offsets, [*by, "_b"], "inner")
    x = x.withColumn("_hi", F.col("_off") + F.col("_cum"))

    if copies == "unique":
        out = x.withColumn(rank_col, F.col("_hi"))
    else:
        out = expand_range(x, lo=F.col("_hi") - F.col("_n") + 1, hi=F.col("_hi"),
                           out_col=rank_col)
    return out.select(*data_cols, rank_col)


def expand_range(df: DataFrame, lo: Column, hi: Column, out_col: str) -> DataFrame:
    """One output row per integer in ``[lo, hi]``.

    Ranges of at most ``CHUNK`` values are exploded where they are.  Longer
    ranges (a hot group of copies) are first cut into chunk rows, which are
    hash-shuffled on (lo, chunk) so each chunk is exploded by its own task.
    """
    x = df.withColumn("_lo", lo).withColumn("_hi2", hi)
    small = x.filter(F.col("_hi2") - F.col("_lo") < CHUNK).withColumn(
        out_col, F.explode(F.sequence(F.col("_lo"), F.col("_hi2"))))
    big = (x.filter(F.col("_hi2") - F.col("_lo") >= CHUNK)
           .withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"),
                                                 F.floor((F.col("_hi2") - F.col("_lo")) / CHUNK))))
           .repartition("_lo", "_c")
           .withColumn("_s", F.col("_lo") + F.col("_c") * CHUNK)
           .withColumn(out_col, F.explode(F.sequence(
               F.col("_s"), F.least(F.col("_hi2"), F.col("_s") + CHUNK - 1))))
           .drop("_c", "_s"))
    return small.unionByName(big).drop("_lo", "_hi2")


def num_partitions(df: DataFrame, default: int) -> int:
    """Partitions of a bare scan (``default`` when it cannot be asked).  Only for
    scans: below an exchange the question would run the stages before it."""
    try:
        return df.rdd.getNumPartitions()
    except Exception:  # e.g. sessions without RDD access
        return default


def rank_within(df: DataFrame, by: Sequence[str], key_cols: Sequence, seed: int = SEED,
                rank_col: str = "rank", sub_len: int = 2) -> DataFrame:
    """1-based rank of each row within its ``by`` group (any number of
    groups) in the seeded order of ``key_cols``.

    Within one group the order is by ``md5(keys|seed)``, so sub-buckets on the
    first ``sub_len`` hex digits are ranges of that order: a group holding a
    third of all rows is split over ``16**sub_len`` window partitions, and the
    per-(group, sub-bucket) counts that place them (at most ``16**sub_len``
    rows per group) are prefix-summed per group.  Exact copies are collapsed
    map-side first and re-expanded in chunks, as in :func:`seeded_rank`."""
    by = list(by)
    data_cols = list(df.columns)
    x = df.withColumn("_h", seed_hash(key_cols, seed))
    x = x.groupBy(*data_cols, "_h").agg(F.count(F.lit(1)).alias("_n"))
    x = x.withColumn("_sb", F.substring("_h", 1, sub_len))
    sizes = x.groupBy(*by, "_sb").agg(F.sum("_n").alias("_bn"))
    wo = Window.partitionBy(*by).orderBy("_sb").rowsBetween(Window.unboundedPreceding, -1)
    offs = sizes.select(*by, "_sb", F.coalesce(F.sum("_bn").over(wo), F.lit(0)).alias("_off"))
    tiebreak = [c for c in data_cols if c not in by]
    wb = (Window.partitionBy(*by, "_sb").orderBy("_h", *tiebreak)
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("_cum", F.sum("_n").over(wb)).join(offs, [*by, "_sb"], "inner")
    x = x.withColumn("_hi", F.col("_off") + F.col("_cum"))
    out = expand_range(x, lo=F.col("_hi") - F.col("_n") + 1, hi=F.col("_hi"), out_col=rank_col)
    return out.select(*data_cols, rank_col)


def dense_row_ids(df: DataFrame, order: str = "line_ord", out: str = "row_id") -> DataFrame:
    """Row ids 0, 1, 2 ... of a file scan, in the order of its files and of the rows in
    them; ``order`` is the struct (file f, split b, increasing number i) that
    ``sources.transcripts.read_csv`` attaches.

    The numbers of a split are consecutive, so a row's place in it is i minus the
    split's smallest; the splits' counts (a row a split) are summed up and joined
    back.  Rows aren't sorted."""
    x = df.withColumn("_f", F.col(order)["f"]).withColumn("_b", F.col(order)["b"]).withColumn("_i", F.col(order)["i"])
    splits = x.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_low"))
    before = Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_f", "_b", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    x = x.join(splits, ["_f", "_b"])
    return x.withColumn(out, F.col("_before") + F.col("_i") - F.col("_low")).drop("_f", "_b", "_i", "_low", "_before")
