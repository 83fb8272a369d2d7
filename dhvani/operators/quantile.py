"""Exact quantiles (linear interpolation) by radix selection.

``percentile`` merges every distinct value of a group in one task.  Here a double becomes a
64-bit whole number of the same order, equal values are counted (combined
map-side), and the numbers are written once.  Four passes look at 16 bits each: the
counts of the 65,536 buckets at most below a prefix are summed up, which finds the
bucket of every wanted order statistic, and the next pass goes on only inside
those.  So the work is the same for any distribution: one outlier or a crowded
range changes nothing, and no window sees more than 65,536 rows.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..session import cut_lineage

#: Bits of a pass.
BITS = 16


@F.pandas_udf(LongType())
def order_key(v: pd.Series) -> pd.Series:
    """Whole numbers in the order of doubles: the bits, all but the sign turned where it is set.
    Both zeros are one value."""
    x = v.to_numpy(np.float64) + 0.0
    bits = x.view(np.int64)
    return pd.Series(bits ^ ((bits >> 63) & np.int64(0x7FFFFFFFFFFFFFFF)))


def order_statistics(counts: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``wanted`` (keys, _r) with ``_p``, the key of the row of rank ``_r`` (from 0) in its group of
    ``counts`` (keys, _k, _c), by descent through four digits."""
    keys = list(keys)
    t = wanted.withColumn("_p", F.lit(0).cast("long"))
    for level in range(64 // BITS):
        low = 64 - BITS * (level + 1)
        prefix = F.lit(0).cast("long") if level == 0 else F.shiftright("_k", low + BITS)
        part = counts.select(*keys, prefix.alias("_p"), F.shiftright("_k", low).alias("_b"), "_c")
        if level:
            part = part.join(t.select(*keys, "_p").distinct(), [*keys, "_p"], "left_semi")
        part = part.groupBy(*keys, "_p", "_b").agg(F.sum("_c").alias("_c"))
        before = Window.partitionBy(*keys, "_p").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        part = part.withColumn("_s", F.coalesce(F.sum("_c").over(before), F.lit(0)))
        # The bucket of each wanted rank; then its rank in there.
        t = t.join(part, [*keys, "_p"]).where((F.col("_r") >= F.col("_s")) & (F.col("_r") < F.col("_s") + F.col("_c")))
        t = t.select(*[c for c in wanted.columns if c != "_r"], (F.col("_r") - F.col("_s")).alias("_r"), F.col("_b").alias("_p"))
    return t


def exact_quantiles(df: DataFrame, col: str, qs: Sequence[float], by: Sequence[str] = (),
                    out: str = "quantiles") -> DataFrame:
    """One row per ``by`` group: ``out ARRAY<DOUBLE>`` with the exact
    quantiles ``qs`` of ``col`` (nulls and NaN ignored)."""
    keys = ["_g", *[f"_g{i}" for i in range(len(by))]]
    v = F.col(col).cast("double")
    # Groups by value, null too: null is a key like others in joins on this struct.
    groups = [F.struct(F.col(c).alias("v")).alias(k) for c, k in zip(by, keys[1:])]
    vals = df.where(v.isNotNull() & ~F.isnan(v)).select(F.lit(0).alias("_g"), *groups, v.alias("_v"))
    counts = vals.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    counts = cut_lineage(counts.select(*keys, order_key("_v").alias("_k"), "_v", "_c"))

    stats = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    pos = [F.lit(float(q)) * (F.col("_n") - 1) for q in qs]
    ranks = F.array(*[F.struct(F.lit(i).alias("qi"), (p - F.floor(p)).alias("frac"), F.lit(w).alias("w"), (F.floor(p) if w == 0 else F.ceil(p)).cast("long").alias("r"))
                      for i, p in enumerate(pos) for w in (0, 1)])
    wanted = stats.select(*keys, F.explode(ranks).alias("_t")).select(*keys, "_t.qi", "_t.frac", "_t.w", F.col("_t.r").alias("_r"))
    x = order_statistics(counts, wanted, keys).withColumnRenamed("_p", "_k").join(counts.select(*keys, "_k", F.col("_v").alias("x")), [*keys, "_k"])
    x = x.groupBy(*keys, "qi", "frac").agg(F.max(F.when(F.col("w") == 0, F.col("x"))).alias("x0"), F.max(F.when(F.col("w") == 1, F.col("x"))).alias("x1"))
    value = F.when(F.col("x0") == F.col("x1"), F.col("x0")).otherwise(F.col("x0") + (F.col("x1") - F.col("x0")) * F.col("frac"))
    res = x.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("qi", value.alias("val")))), lambda t: t["val"]).alias(out))
    return res.select(*[F.col(k)["v"].alias(c) for c, k in zip(by, keys[1:])], out)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
