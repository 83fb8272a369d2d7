"""Helpers shared by the operators: tables, vectorised word hashes, components.

Word hashes are 64-bit and the same on every machine: eight bytes of a word
are read at a time as a little-endian integer, so a batch of texts costs a few
numpy passes over its bytes.  Every operator cuts its Arrow batches to
``CHUNK_BYTES`` of text at most (one text may be longer), so memory follows
the chunk and the longest text, never the partition.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy pass handles; its arrays take about forty times as much.
CHUNK_BYTES = 3 << 19
#: Words longer than this many bytes are hashed by a digest of the whole word.
LONG_WORD = 64

U64 = np.uint64
_C1, _C2 = U64(0x9E3779B97F4A7C15), U64(0xBF58476D1CE4E5B9)
_S29, _S32 = U64(29), U64(32)
#: Bytes that separate words: space and \t \n \v \f \r.
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Every ASCII byte but letters and digits, for word-character tokens.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of a driver table by a path that only Spark need read."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    h = h * _C1
    h ^= h >> _S29
    h *= _C2
    return h ^ (h >> _S32)


def chunks(texts: list, limit: int = CHUNK_BYTES):
    """(first, last) index ranges of at most ``limit`` bytes, one text at least."""
    first = size = 0
    for i, t in enumerate(texts):
        n = len(t)
        if size and size + n > limit:
            yield first, i
            first, size = i, 0
        size += n
    if len(texts) > first:
        yield first, len(texts)


def to_bytes(values, lower: bool = False) -> list[bytes]:
    """UTF-8 of each text (null: empty); ``lower`` maps A-Z only."""
    out = [v.encode("utf-8", "surrogatepass") if isinstance(v, str) else b"" for v in values]
    return [b.lower() for b in out] if lower else out


class Words:
    """Words of a list of byte texts: ``hash`` (uint64), ``start`` and ``end``
    (byte places in ``buf``), ``first`` (the words of text i are
    ``first[i]:first[i + 1]``) and ``base`` (byte place of each text)."""

    def __init__(self, texts: list[bytes], sep: np.ndarray = WHITE):
        buf = b" ".join(texts) + b" " * 9
        self.buf = buf
        a = np.frombuffer(buf, np.uint8)
        word = ~sep[a]
        word[-9:] = False
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(a) and word[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts)) + 1
        self.base = np.concatenate(([0], np.cumsum(sizes)))
        self.first = np.searchsorted(self.start, self.base)
        self.hash = self._hash(a)

    def _hash(self, a: np.ndarray) -> np.ndarray:
        eight = np.ndarray((len(a) - 7,), "<u8", buffer=self.buf, strides=(1,))
        size = self.end - self.start
        keep = np.array([0] + [(1 << (8 * k)) - 1 for k in range(1, 9)], np.uint64)
        h = mix(size.astype(np.uint64) + U64(1))
        left, at, who = size, self.start, None
        for _ in range(LONG_WORD // 8):
            x = eight[at] & keep[np.minimum(left, 8)]
            if who is None:
                h = mix(h ^ x)
            else:
                h[who] = mix(h[who] ^ x)
            more = np.flatnonzero(left > 8)
            if not len(more):
                return h
            who = more if who is None else who[more]
            left, at = left[more] - 8, at[more] + 8
        for i in who:
            d = hashlib.blake2b(self.buf[self.start[i]:self.end[i]], digest_size=8).digest()
            h[i] = int.from_bytes(d, "little")
        return h

    def owner(self) -> np.ndarray:
        """The text that each word stands in."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, index of its first word) of all runs of ``n`` words of one text."""
        h = self.hash
        if len(h) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        own = self.owner()
        at = np.flatnonzero(own[n - 1:] == own[:len(own) - n + 1])
        g = h[at]
        for k in range(1, n):
            g = mix(g) ^ h[at + k]
        return mix(g), at


def map_texts(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInPandas(run, schema)`` for rows with a column text, whose frames hold
    ``CHUNK_BYTES`` of text (or one text) at most: an Arrow batch is cut before any of
    it becomes Python objects.  Whole numbers keep their value beside nulls."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(schema))

    def frames(batches):
        import pandas as pd
        import pyarrow as pa
        import pyarrow.compute as pc

        whole = {pa.int64(): pd.Int64Dtype()}.get
        for b in batches:
            total = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            first = 0
            while first < b.num_rows:
                before = total[first - 1] if first else 0
                last = max(int(np.searchsorted(total, before + CHUNK_BYTES, side="right")), first + 1)
                yield b.slice(first, last - first).to_pandas(types_mapper=whole)
                first = last

    def arrow(batches):
        import pyarrow as pa

        for f in run(frames(batches)):
            yield pa.RecordBatch.from_pandas(f, schema=out, preserve_index=False)
    return df.mapInArrow(arrow, schema)


def keep_rows(docs: DataFrame, judge) -> DataFrame:
    """The rows of ``docs`` that pass, with every column as it is.  ``judge()`` is
    called once in a task and returns a function texts -> mask of those that pass;
    Arrow batches are filtered whole, so other columns' values aren't touched."""
    def run(batches):
        import pyarrow as pa

        passes = judge()
        for b in batches:
            yield b.filter(pa.array(passes(b.column("text").to_pylist()), pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b: long): (node, comp), comp being
    the smallest node.  Nodes without an edge are not listed.

    Each round points every node at its smallest neighbour, halves the paths once, and
    renames the edges by what they point at; loops and repeats go.  The number of
    edges falls by a factor each round.  The tables are cut by ``checkpoint()`` into the
    shared folder.  Hot nodes are combined map-side (min) or split by AQE (joins with a
    unique side); nothing is broadcast."""
    from ..session import ensure_checkpoint_dir  # the tasks that carry this module don't have the package

    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = edges.distinct().checkpoint()
    nodes = None
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("to")).checkpoint()
        q = p.select(F.col("node").alias("to"), F.col("to").alias("next"))
        p = p.join(q.hint("merge"), "to").select("node", F.col("next").alias("to")).checkpoint()
        if nodes is None:
            nodes = p.select("node", F.col("to").alias("comp"))
        else:
            step = p.select(F.col("node").alias("comp"), "to")
            nodes = nodes.join(step.hint("merge"), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")).checkpoint()
        pa, pb = (p.select(F.col("node").alias(c), F.col("to").alias("t" + c)).hint("merge") for c in "ab")
        edges = edges.join(pa, "a").join(pb, "b").where("ta <> tb")
        edges = edges.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct().checkpoint()
    return nodes if nodes is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("comp"))
