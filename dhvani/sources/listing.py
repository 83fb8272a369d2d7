"""Files below folders, as they are found: nothing holds all of their names."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator, Sequence
from itertools import islice

from pyspark.sql import SparkSession


def _hidden(name: str) -> bool:
    """Names that Spark's own listing leaves out."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _local(folder: str) -> Iterator[tuple[str, str, bool]]:
    # Hadoop makes an array of a whole local folder
    with os.scandir(folder) as found:
        for e in found:
            if e.is_dir() or e.is_file():  # a link to nothing is neither
                yield "file:" + e.path, e.name, e.is_dir()


def _stored(fs, folder) -> Iterator[tuple[str, str, bool]]:
    found = fs.listStatusIterator(folder)  # a page at a time
    while found.hasNext():
        s = found.next()
        p = s.getPath()
        yield p.toString(), p.getName(), s.isDirectory()


def files_below(spark: SparkSession, paths: Sequence[str], names: str) -> Iterator[str] | None:
    """Paths of the files with names like ``names`` anywhere below folders (or patterns of folders), each once and by
    the rules of ``recursiveFileLookup``; ``None`` where a path leads nowhere."""
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    fits = re.compile(jvm.org.apache.hadoop.fs.GlobPattern(names).compiled().pattern(), re.DOTALL).fullmatch
    roots = {}
    for path in map(jvm.org.apache.hadoop.fs.Path, paths):
        fs = path.getFileSystem(conf)
        found = list(fs.globStatus(fs.makeQualified(path)) or [])
        if not found:
            return None
        roots |= {s.getPath().toString(): (fs, s.isDirectory()) for s in found}

    def below(fs, folder: str) -> Iterator[str]:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        uri = path.toUri()
        for p, name, is_dir in _local(uri.getPath()) if uri.getScheme() == "file" else _stored(fs, path):
            if p in roots or _hidden(name):  # a root below another one is listed on its own
                continue
            if is_dir:
                yield from below(fs, p)
            elif fits(name):
                yield p

    def walk() -> Iterator[str]:
        for root, (fs, is_dir) in roots.items():
            if is_dir:
                yield from below(fs, root)
            elif fits(root.rsplit("/", 1)[-1]):
                yield root

    return walk()


def batches(items: Iterator[str], n: int) -> Iterator[list[str]]:
    """Lists of ``n`` items, the last one shorter."""
    return iter(lambda: list(islice(items, n)), [])


__all__ = ["files_below", "batches"]
