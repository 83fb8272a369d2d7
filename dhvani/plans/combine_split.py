"""Combine manifests, filter by duration, stratified split, summary.

The winners of the keep-first dedupe are found on slim rows (path, duration, order),
filtered, and written once (``checkpoint``): edges, bin counts, cutoffs and labels all
read that table.  Only the final join brings the other columns, once per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.manifest import MAX_DUR, MIN_DUR, duration_filter, keep_first, split_summary, union_inputs
from ..operators.rank import SEED
from ..operators.split import stratified_split
from ..session import cut_lineage

ORDER = ("src_ord", "row_ord")


def split_labels(union: DataFrame, val_frac: float = 0.05, test_frac: float = 0.05, seed: int = SEED,
                 min_dur: float = MIN_DUR, max_dur: float = MAX_DUR) -> DataFrame:
    """``split`` of each row of the combined, deduplicated, filtered manifest, with the
    row's path, duration and order."""
    slim = [c for c in ("wav_path", "duration_sec", *ORDER) if c in union.columns]
    kept = cut_lineage(duration_filter(keep_first(union.select(*slim), "wav_path"), min_dur, max_dur))
    # wav_path is unique after the keep-first dedupe, so cutoffs label the rows.
    return stratified_split(kept, val_frac, test_frac, seed, key_cols=("wav_path",), min_dur=min_dur, unique_key=True)


def combine_filter_split(inputs: Sequence[tuple[DataFrame, str, Column]], **kw) -> DataFrame:
    """Combined, deduplicated, filtered manifest with a ``split`` column."""
    union = union_inputs(inputs)
    labels = split_labels(union, **kw).select(*[F.col(c).alias(f"_{c}") for c in ORDER], "split")
    same = (union["src_ord"] == labels["_src_ord"]) & (union["row_ord"] == labels["_row_ord"])
    return union.join(labels, same).drop(*ORDER, "_src_ord", "_row_ord")


def split_report(inputs, **kw) -> DataFrame:
    """Rows, hours and mean duration per split; reads no other column."""
    return split_summary(split_labels(union_inputs(inputs), **kw))
