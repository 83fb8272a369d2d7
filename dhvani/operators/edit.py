"""Edit distances of very long pairs, shared by many tasks.

A pair's table is cut into blocks of ``BLOCK`` x ``BLOCK`` cells.  A block needs the differences
along its left and its upper border and yields those along its right and its lower one,
as two bits a cell, so the blocks of an anti-diagonal are independent.  Each
anti-diagonal is one pass: the blocks are joined with the borders that the pass before has
written, and dealt to the tasks.  A task holds one block and its borders, whatever the pair.

Only blocks that a band around the corner diagonals touches are filled.  Missing borders
rise by one a cell, as along the table's own border, which never makes a distance smaller;
the result is exact once it is small enough that no path of that cost leaves the band, and
until then the band grows.
"""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import _masks, block_distance
from ..session import cut_lineage

#: Cells of a block's side.
BLOCK = 1 << 16
#: Pairs whose shorter side has more tokens than this are cut into blocks.
HUGE = 1 << 18
#: The band's growth.
GROWTH = 4

BORDER = "h long, i int, j int, axis int, plus binary, minus binary, rise long"


def token_count(text: Column, unit: str) -> Column:
    return F.length(text) if unit == "char" else F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))


def _pieces(text: Column, unit: str) -> Column:
    if unit == "char":
        return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))
    words = F.split(text, " ")
    starts = F.sequence(F.lit(0), F.floor((F.size(words) - 1) / BLOCK).cast("int"))
    return F.transform(starts, lambda k: F.array_join(F.slice(words, k * BLOCK + 1, BLOCK), " "))


def _step(unit: str):
    def tokens(text):
        return text if unit == "char" else text.split(" ")

    def ones(n):
        return (1 << n) - 1

    def run(frames):
        for f in frames:
            out = []
            for b in f.itertuples(index=False):
                rows, cols = tokens(b.rows), tokens(b.cols)
                vp, vn = (int.from_bytes(b.vp, "little"), int.from_bytes(b.vn, "little")) if b.vp is not None else (ones(len(rows)), 0)
                hp, hn = (int.from_bytes(b.hp, "little"), int.from_bytes(b.hn, "little")) if b.hp is not None else (ones(len(cols)), 0)
                vp, vn, hp, hn = block_distance(_masks(rows, set(cols)), len(rows), cols, vp, vn, hp, hn)
                for axis, plus, minus, n in ((0, vp, vn, len(rows)), (1, hp, hn, len(cols))):
                    width = (n + 7) // 8
                    out.append((b.h, b.i, b.j, axis, plus.to_bytes(width, "little"), minus.to_bytes(width, "little"),
                                plus.bit_count() - minus.bit_count()))
            yield pd.DataFrame(out, columns=["h", "i", "j", "axis", "plus", "minus", "rise"])
    return run


def block_distances(pairs: DataFrame, unit: str = "char") -> DataFrame:
    """(h, distance) of ``pairs`` (h, ref, hyp), none of them empty; h tells the pairs apart.

    Words are separated by one space each."""
    spark = pairs.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, 2)
    pairs = cut_lineage(pairs.select("h", "ref", "hyp", token_count(F.col("ref"), unit).alias("m"), token_count(F.col("hyp"), unit).alias("n")))
    rows = cut_lineage(pairs.select("h", "m", "n", F.posexplode(_pieces(F.col("ref"), unit)).alias("i", "rows")))
    cols = cut_lineage(pairs.select("h", F.posexplode(_pieces(F.col("hyp"), unit)).alias("j", "cols")))
    todo, e, done = pairs.select("h", "m", "n"), BLOCK, None
    while True:
        size = todo.agg(F.max("m").alias("m"), F.max("n").alias("n")).first()
        if size["m"] is None:
            return done if done is not None else todo.select("h", F.lit(0).cast("long").alias("distance"))
        waves = -(-size["m"] // BLOCK) + -(-size["n"] // BLOCK) - 1
        band_rows = rows.join(todo.select("h"), "h", "left_semi")
        d = F.col("m") - F.col("n")
        low, high = F.least(d, F.lit(0)) - e, F.greatest(d, F.lit(0)) + e
        bottoms, borders = [], None
        for w in range(waves):
            j = F.lit(w) - F.col("i")
            near = ((F.col("i") + 1 - j) * BLOCK >= low) & ((F.col("i") - j - 1) * BLOCK <= high)
            b = band_rows.where((j >= 0) & near).withColumn("j", j.cast("int")).join(cols, ["h", "j"])
            if borders is None:
                nothing = F.lit(None).cast("binary")
                b = b.select("*", nothing.alias("vp"), nothing.alias("vn"), nothing.alias("hp"), nothing.alias("hn"))
            else:
                left = borders.where("axis = 0").select("h", "i", (F.col("j") + 1).alias("j"), F.col("plus").alias("vp"), F.col("minus").alias("vn"))
                above = borders.where("axis = 1").select("h", (F.col("i") + 1).alias("i"), "j", F.col("plus").alias("hp"), F.col("minus").alias("hn"))
                b = b.join(left, ["h", "i", "j"], "left").join(above, ["h", "i", "j"], "left")
            b = b.select("h", "i", "j", "rows", "cols", "vp", "vn", "hp", "hn").repartition(tasks)
            borders = cut_lineage(b.mapInPandas(_step(unit), BORDER))
            bottoms.append(borders.where("axis = 1").select("h", "i", "j", "rise"))
        bottom = bottoms[0]
        for x in bottoms[1:]:
            bottom = bottom.unionAll(x)
        # Along the lower edge of what was filled: down borders that rise by one a cell, and
        # along the lowest block of each column.
        lowest = bottom.groupBy("h", "j").agg(F.max_by("rise", "i").alias("rise")).groupBy("h").agg(F.sum("rise").alias("rise"))
        sums = todo.join(lowest, "h").select("h", "m", "n", (F.col("m") + F.col("rise")).cast("long").alias("distance"))
        sums = cut_lineage(sums)
        exact = F.col("distance") <= F.abs(d) + 2 * e + 1
        found = sums.where(exact).select("h", "distance")
        done = found if done is None else done.unionAll(found)
        todo, e = cut_lineage(sums.where(~exact).select("h", "m", "n")), e * GROWTH


cloudpickle.register_pickle_by_value(sys.modules[__name__])
