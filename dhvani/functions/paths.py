"""Path expressions (POSIX paths held in string columns)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_stem(p: Column) -> Column:
    """Last path component without its last suffix:
    a/b.tar.gz -> b.tar, .bashrc -> .bashrc, x/a. -> a., a/b/ -> b."""
    name = F.regexp_extract(p, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def path_basename(p: Column) -> Column:
    """Text after the last '/' (empty for a trailing slash)."""
    return F.regexp_extract(p, r"[^/]*$", 0)


def resolve_path(p: Column, csv_path: str) -> Column:
    """Absolute paths are kept; others become ``dirname(csv)/basename(p)``."""
    base = csv_path.rsplit("/", 1)[0] if "/" in csv_path else ""
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(base + "/"), path_basename(p)))


def proc_path(p: Column, input_dir: str, out_dir: str, suffix: str = "_proc.wav") -> Column:
    """``<out>/<dir of p relative to input_dir>/<stem>_proc.wav``; null when
    ``p`` is not under ``input_dir``."""
    root = input_dir.rstrip("/")
    rel = F.regexp_extract(p, "^" + re.escape(root) + "/+(.*)$", 1)
    parent = F.regexp_extract(rel, r"^(.*)/[^/]*$", 1)
    out = F.concat_ws("/", F.lit(out_dir.rstrip("/")), F.nullif(parent, F.lit("")),
                      F.concat(path_stem(rel), F.lit(suffix)))
    return F.when(rel != "", out)
