"""All registered queries and oracles (imports every query module)."""

from __future__ import annotations

from . import q_align, q_ingest, q_manifest, q_plans, q_score, q_signal, q_stream, q_text  # noqa: F401
from .catalog import ORACLE, QUERIES

# The written-and-read-back split must equal the split itself.
ORACLE.setdefault("split_roundtrip", ORACLE["stratified_split"])

__all__ = ["QUERIES", "ORACLE"]
