"""Exact prefix sums over a unique integer order key without a global window.

Only the key and the values to sum are windowed; whatever else the rows carry is
joined back by key at the end, so no text is ever sorted.  Keys fall into buckets of
65,536 neighbouring values (``key >> 16``), buckets into larger ones (``>> 32``,
``>> 48``); each window sees one bucket's rows, at most 65,536, for any 64-bit key.

``text_blocks`` cuts concatenated texts into blocks without knowing any row's offset
beforehand: rows are put into ranges of the key, the ranges' lengths are summed up, and the
task that holds a range goes through it from its start.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import sliced
from ..session import cut_lineage

SHIFT = 16
LEVELS = 64 // SHIFT


def prefix_sums(df: DataFrame, key: str, values: Sequence[str], outs: Sequence[str]) -> DataFrame:
    """Add, for each ``values[i]``, ``outs[i]`` = its sum over all rows with a
    smaller ``key`` (exclusive running total; 0 for the first row)."""
    n = len(values)
    sums = [f"_v{i}" for i in range(n)]
    rows = df.select(F.col(key).alias("_k"), *[F.col(v).cast("long").alias(s) for v, s in zip(values, sums)])
    # From the rows up: the total of each bucket.
    levels = [rows]
    for _ in range(1, LEVELS):
        low = levels[-1]
        levels.append(low.groupBy(F.shiftright("_k", SHIFT).alias("_k")).agg(*[F.sum(s).alias(s) for s in sums]))
    # From the top down: what stands before each bucket, then before each row in it.
    before = None
    for table in reversed(levels):
        # The top buckets, of both signs, are one window: 65,536 at most.
        table = table.withColumn("_up", F.lit(0) if before is None else F.shiftright("_k", SHIFT))
        w = Window.partitionBy("_up").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
        inside = table.select("_k", "_up", *[F.coalesce(F.sum(s).over(w), F.lit(0)).alias(s) for s in sums])
        if before is None:
            before = inside.select("_k", *sums)
        else:
            b = before.select(F.col("_k").alias("_up"), *[F.col(s).alias("_b" + s) for s in sums])
            before = inside.join(b, "_up").select("_k", *[(F.col(s) + F.col("_b" + s)).alias(s) for s in sums])
    offsets = before.select(F.col("_k").alias(key), *[F.col(s).cast("long").alias(o) for s, o in zip(sums, outs)])
    return df.join(offsets, key)


def prefix_sum(df: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """Single-column form of :func:`prefix_sums`."""
    return prefix_sums(df, key, [value], [out])


#: Bytes of text that are cut at a time (or one row).
SLICE = 1 << 20


def _cut(size: int):
    def run(batches):
        now, at = None, [0, 0]
        for batch in batches:
            for f in sliced(batch, SLICE):
                out = []
                for part, sa, sb, a, b in zip(*(f[c].to_pylist() for c in ("part", "s0", "s1", "t0", "t1"))):
                    if part != now:
                        now, at = part, [sa, sb]
                    for side, text in ((0, a), (1, b)):
                        k = 0
                        while k < len(text):
                            s = at[side] + k
                            n = size - s % size
                            out.append((s // size, side, s, text[k:k + n]))
                            k += n
                        at[side] += len(text)
                columns = zip(*out) if out else ((), (), (), ())
                types = (pa.int64(), pa.int32(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["blk", "side", "s", "piece"])
    return run


#: Neighbouring keys of a range, as bits.
RANGE_BITS = 7


def text_blocks(df: DataFrame, key: str, texts: tuple[str, str], size: int) -> DataFrame:
    """``(blk, side, s, piece)``: both text columns, each concatenated in the order of the
    unique whole-number ``key``, cut at every multiple of ``size`` characters; ``s`` is the
    piece's place in its corpus, ``blk`` is s div size.

    ``df`` is read twice, for the ranges' lengths (written, a row a range) and for the pieces, and
    its texts are shuffled once before they are cut."""
    x = df.select(F.col(key).cast("long").alias("k"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(texts)])
    x = x.withColumn("part", F.shiftright("k", RANGE_BITS))
    total = cut_lineage(x.groupBy("part").agg(*[F.sum(F.length(f"t{i}")).cast("long").alias(f"n{i}") for i in (0, 1)]))
    start = prefix_sums(total, "part", ["n0", "n1"], ["s0", "s1"]).select("part", "s0", "s1")
    # Not a broadcast: the ranges grow with the rows, and the join deals the texts by range.
    x = x.join(start.hint("shuffle_hash"), "part").sortWithinPartitions("part", "k")
    return x.select("part", "s0", "s1", "t0", "t1").mapInArrow(_cut(size), "blk long, side int, s long, piece string")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
