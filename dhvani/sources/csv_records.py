"""Quoted CSV that is read in splits, line ends inside fields included.

Spark reads a CSV file whose fields may hold line ends (``multiLine``) as one task.  Here
such a file is scanned as lines, in as many tasks as it has splits:

1.  *States.*  Whether a line begins inside a quoted field depends on all lines before it.
    Each split works out, from its lines that hold a quote, how it ends if it begins outside
    and how it ends if it begins inside a field.  One row per split goes on.
2.  *Prefix.*  These functions of two values are composed along each file by a window
    over the splits, which tells how every split begins.
3.  *Records.*  Each split is scanned again with its known beginning and cut into records.
    What it holds of a record that began in an earlier split, and of one that goes on in
    the next, are fragments; only those are shuffled, to be put together.  A
    file without a field across a split border has none, and that step is left out.

Quotes count as RFC 4180 says: one opens a field only at its begin, two inside stand for
one.  A quote elsewhere is a character like others.  Records are parsed by ``from_csv``
with the options of ``multiLine`` reading, so the columns are the same.

Blank lines between records are skipped, the first record of a file is its header, a
quote that is never closed takes the rest of its file (without the last line end), lines
end with \\n or \\r\\n.
"""

from __future__ import annotations

import re
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

#: A quoted field (group 1 is empty if it isn't closed) or a line end; and the rest of a quoted field.
FIELD = re.compile(rb'(?:\A|(?<=[,\n]))"[^"]*+(?:""[^"]*+)*+("|\Z)|\n')
REST = re.compile(rb'[^"]*+(?:""[^"]*+)*+("|\Z)')
#: Up to this number, the stretches of splits that begin inside a field are broadcast: a row for one split
#: or more, so a million are over 100 TB of text.
BROADCAST_ROWS = 1 << 20

PARSE = {"multiLine": "true", "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def cuts(lines: bytes, inside: bool) -> tuple[list[int], bool]:
    """Places of the line ends that end a record, and whether the end is inside a field."""
    at = 0
    if inside:
        m = REST.match(lines)
        if not m.group(1):
            return [], True
        at = m.end()
    out = []
    for m in FIELD.finditer(lines, at):
        if m.group(1) is None:
            out.append(m.start())
        elif not m.group(1):
            return out, True
    return out, False


def one_end(record: bytes) -> bytes:
    """The record without its line end's \\r; if it has one, line ends inside are made \\n too."""
    return record[:-1].replace(b"\r\n", b"\n") if record.endswith(b"\r") else record


def one_end_column(record: Column) -> Column:
    plain = F.replace(F.regexp_replace(record, r"\r\z", ""), F.lit("\r\n"), F.lit("\n"))
    return F.when(record.endswith("\r"), plain).otherwise(record)


def _by_split(batches, columns: int):
    """((file, block, ...), lines) of each stretch of one split in the batches."""
    import numpy as np

    for b in batches:
        keys = [b.column(0).dictionary_encode().indices.to_numpy(), *(b.column(k).to_numpy(zero_copy_only=False) for k in range(1, columns))]
        new = np.zeros(b.num_rows + 1, bool)
        new[[0, -1]] = True
        for k in keys:
            new[1:-1] |= k[1:] != k[:-1]
        at = np.flatnonzero(new).tolist()
        for a, z in zip(at, at[1:]):
            yield tuple(b.column(k)[a].as_py() for k in range(columns)), b.column(columns).slice(a, z - a).to_pylist()


def _states(batches):
    """(f, b, out0, out1) of each split, from its lines that hold a quote."""
    import pyarrow as pa

    ends: dict[tuple, list[bool]] = {}
    for key, lines in _by_split(batches, 2):
        text = b"\n".join(lines)
        ends[key] = [cuts(text, s)[1] for s in ends.get(key, (False, True))]
    rows = [list(x) for x in zip(*((f, b, *s) for (f, b), s in ends.items()))] or [[], [], [], []]
    types = (pa.string(), pa.int64(), pa.bool_(), pa.bool_())
    yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types)], ["f", "b", "out0", "out1"])


def _records(fragments: bool):
    """Whole records (kind 2), or what is left at the head (0) and tail (1) of the splits."""
    def run(batches):
        import pyarrow as pa

        def put(key, start, kinds, texts):
            n = len(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(range(start, start + n), pa.int64()),
                 pa.array(kinds, pa.int32()), pa.array(texts, pa.binary())], ["f", "b", "i", "kind", "record"])

        key, head, inside, held, count = None, False, False, [], 0

        def rest():
            if fragments and key is not None and held:
                yield put(key, count, [0 if head else 1], [b"\n".join(held)])
        for now, lines in _by_split(batches, 3):
            if now != key:
                yield from rest()
                key, head, inside, held, count = now, now[2], now[2], [], 0
            if inside or any(b'"' in x for x in lines):
                text = b"\n".join(lines) + b"\n"
                at, inside = cuts(text, inside)
                a, whole = 0, []
                for z in at:
                    whole.append(b"\n".join([*held, text[a:z]]) if held else text[a:z])
                    held, a = [], z + 1
                if a < len(text):
                    held.append(text[a:-1])
            else:
                whole = lines
            if head and whole:
                if fragments:
                    yield put(key, 0, [0], whole[:1])
                whole, head = whole[1:], False
            whole = [x for x in map(one_end, whole) if x]
            if whole and not fragments:
                yield put(key, count, [2] * len(whole), whole)
            count += len(whole)
        yield from rest()
    return run


def read_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(line_ord, record) of CSV files; ``line_ord`` orders the records as the files list them."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), "value", F.monotonically_increasing_id().alias("at"))
    quoted = lines.where(F.col("value").contains('"')).select("f", "b", F.col("value").cast("binary"))
    states = quoted.mapInArrow(_states, "f string, b long, out0 boolean, out1 boolean")
    # Composition: a constant split sets the state, a swapping one turns it.
    order = Window.partitionBy("f").orderBy("b")
    constant, swap = F.col("out0") == F.col("out1"), (F.col("out0") & ~F.col("out1")).cast("int")
    turns = F.sum(swap).over(order.rowsBetween(Window.unboundedPreceding, 0)) % 2
    states = states.withColumn("turns", turns).withColumn("set", F.when(constant, F.col("out0").cast("int").bitwiseXOR(F.col("turns").cast("int"))))
    last = F.last("set", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ends = F.coalesce(last, F.lit(0)).bitwiseXOR(F.col("turns").cast("int"))
    spans = states.select("f", F.col("b").alias("after"), ends.alias("open"), F.lead("b").over(order).alias("until")).where("open = 1")
    spans = cut_lineage(spans.drop("open"))
    open_splits = spans.count()
    rows = "f string, b long, i long, kind int, record binary"
    text = F.col("value").cast("binary")
    if not open_splits:
        known = lines.select("f", "b", F.lit(False).alias("inside"), text)
        return _ordered(known.mapInArrow(_records(False), rows))
    small = open_splits <= BROADCAST_ROWS
    spans = spans.withColumnRenamed("f", "g").hint("broadcast" if small else "merge")
    within = (F.col("f") == F.col("g")) & (F.col("b") > F.col("after")) & (F.col("b") <= F.coalesce("until", F.lit(2 ** 62)))
    known = lines.join(spans, within, "left")
    if not small:
        known = known.repartition("f", "b").sortWithinPartitions("f", "b", "at")
    known = known.select("f", "b", F.col("g").isNotNull().alias("inside"), text)
    left = known.mapInArrow(_records(True), rows)
    # A head or a split without a record's end belongs to the last tail before it.
    seen = Window.partitionBy("f").orderBy("b", "kind").rowsBetween(Window.unboundedPreceding, 0)
    owner = F.last(F.when(F.col("kind") == 1, F.struct("b", "i")), ignorenulls=True).over(seen)
    left = left.select("f", owner.alias("o"), "b", "kind", "record")
    joined = left.groupBy("f", "o").agg(F.array_sort(F.collect_list(F.struct("b", "kind", F.col("record").cast("string").alias("r")))).alias("parts"))
    joined = joined.select("f", "o.b", "o.i", F.lit(2).alias("kind"), one_end_column(F.array_join("parts.r", "\n")).cast("binary").alias("record"))
    return _ordered(known.mapInArrow(_records(False), rows).unionByName(joined))


def _ordered(records: DataFrame) -> DataFrame:
    return records.select(F.struct("f", "b", "i").alias("line_ord"), F.col("record").cast("string").alias("record"))


def header_names(record: str) -> list[str]:
    """Column names as Spark gives them: a name for an empty one, a number behind a repeated one."""
    import csv
    import io

    names = next(csv.reader(io.StringIO(record)), [])
    low = [n.lower() for n in names]
    return [f"_c{k}" if not n else (f"{n}{k}" if low.count(n.lower()) > 1 else n) for k, n in enumerate(names)]


def is_header() -> Column:
    return (F.col("line_ord.b") == 0) & (F.col("line_ord.i") == 0)


def first_header(records: DataFrame) -> list[str]:
    first = records.where(is_header()).select("record").take(1)
    return header_names(first[0]["record"]) if first else []


def parsed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """The records after each file's header as columns of ``schema``, with ``line_ord`` last."""
    ddl = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
    row = F.from_csv("record", ddl, PARSE)
    return records.where(~is_header()).select(row.alias("r"), "line_ord").select("r.*", "line_ord")


def fields(record: Column) -> Column:
    """How many fields a record has."""
    plain = F.regexp_replace(record, '(^|,)"[^"]*+(?:""[^"]*+)*+"', "$1")
    return F.length(plain) - F.length(F.replace(plain, F.lit(","), F.lit(""))) + 1


def unclosed(record: Column) -> Column:
    """Whether a record ends inside a quoted field."""
    return F.regexp_replace(record, '(^|,)"[^"]*+(?:""[^"]*+)*+"', "$1").rlike('(^|,)"')


def inferred(strings: DataFrame) -> T.StructType:
    """Types of the string columns ``strings``, in one aggregate: the first that all values can be cast to."""
    kinds = [("int", T.IntegerType()), ("bigint", T.LongType()), ("double", T.DoubleType()), ("date", T.DateType()),
             ("timestamp", T.TimestampType()), ("boolean", T.BooleanType())]
    checks = []
    for k, c in enumerate(strings.columns):
        value = F.col(f"`{c.replace('`', '``')}`")
        checks.append(F.count(value).alias(f"n{k}"))
        for name, _ in kinds:
            bad = value.isNotNull() & value.try_cast(name).isNull()
            if name in ("date", "timestamp"):
                bad = value.isNotNull() & ~(value.rlike(r"^\d{4}-\d{2}-\d{2}" + ("$" if name == "date" else "")) & value.try_cast(name).isNotNull())
            if name == "boolean":
                bad = value.isNotNull() & ~F.lower(value).isin("true", "false")
            checks.append(F.count_if(bad).alias(f"{name}{k}"))
    got = strings.agg(*checks).first()
    types = [next((t for name, t in kinds if got[f"n{k}"] and got[f"{name}{k}"] == 0), T.StringType()) for k in range(len(strings.columns))]
    return T.StructType([T.StructField(c, t) for c, t in zip(strings.columns, types)])


def read_quoted_csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, infer: bool = False) -> DataFrame:
    """Columns of CSV files with a header, and ``line_ord``.  Without ``schema`` the header names the
    columns, strings or, with ``infer``, of the types that their values allow."""
    records = read_records(spark, path)
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if schema is None:
        schema = T.StructType([T.StructField(c, T.StringType()) for c in first_header(records)])
        if infer and schema.fields:
            schema = inferred(parsed(records, schema).drop("line_ord"))
    return parsed(records, schema)


cloudpickle.register_pickle_by_value(sys.modules[__name__])
