"""Fixtures and brute-force versions for the corpus operators."""

from __future__ import annotations

import os
import random
import re

import pyarrow as pa
import pyarrow.parquet as pq

SF = "/root/testdata/sf0.001"

LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(40_000))
EDGE = [
    (1, "One two three four five six seven eight nine ten."),
    (2, "One two three four five six seven eight nine ten."),
    (None, "One two three four five six seven eight nine ten."),
    (3, None), (4, ""), (5, " \n\t "), (6, "word"), (7, "word"), (7, "word"), (8, "two words"),
    (9, LONG), (10, LONG + " end"), (11, "x" * 5000), (12, "Ünï çödé Σας ẞ ﬁ <|endoftext|> it's 'RE 123 …"), (2 ** 62, "large id"),
]


def write(folder: str, **tables) -> str:
    """Parquet tables (lists of dicts with a schema) in ``folder``."""
    for name, (rows, schema) in tables.items():
        pq.write_table(pa.Table.from_pylist(rows, schema), os.path.join(folder, f"{name}.parquet"))
    return folder


DOCS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64()),
                  ("cls", pa.string()), ("row", pa.int32()), ("s", pa.string()), ("score", pa.float64())])
LABELS = pa.schema([("doc_id", pa.int64()), ("quality", pa.int32()), ("toxic", pa.int32())])
ITEMS = pa.schema([("item_id", pa.int64()), ("text", pa.string())])


def docs_of(rows) -> tuple:
    return [{"doc_id": i, "text": t, "n_chars": None if t is None else len(t), "row": k} for k, (i, t) in enumerate(rows)], DOCS


def read(name: str, sf: str = SF):
    return pq.read_table(f"{sf}/{name}.parquet").to_pylist()


def ascii_words(text: str | None, lower: bool) -> list[bytes]:
    b = (text or "").encode("utf-8", "surrogatepass")
    return re.findall(rb"[^\x20\x09-\x0D]+", b.lower() if lower else b)


def shingles(text: str | None, n: int) -> frozenset:
    w = ascii_words(text, True)
    if 0 < len(w) < n:
        return frozenset([tuple(w)])
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1))


def near_groups(rows, n: int, num: int) -> dict[int, tuple[int, int]]:
    """{row number: (set size, smallest id of its group)}; all pairs."""
    sets = [shingles(t, n) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            o = len(a & b)
            if a and b and 100 * o >= num * (len(a) + len(b) - o):
                up[find(i)] = find(j)
    low: dict[int, int] = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return {k: (len(sets[k]), low.get(find(k)) if sets[k] else rows[k][0]) for k in range(len(rows))}


def cut_words(rows, window: int) -> list[list[bool]]:
    """Which words go, by row."""
    low: dict[tuple, int] = {}
    words = [ascii_words(t, False) for _, t in rows]
    for (i, _), w in zip(rows, words):
        if i is not None:
            for k in range(len(w) - window + 1):
                x = tuple(w[k:k + window])
                low[x] = min(low.get(x, i), i)
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        if i is not None:
            for k in range(len(w) - window + 1):
                if low[tuple(w[k:k + window])] < i:
                    gone[k:k + window] = [True] * window
        out.append(gone)
    return out


def edited(text: str, share: float, r: random.Random) -> str:
    """The text with about a ``share`` of its words replaced, dropped or doubled."""
    out = []
    for w in text.split():
        k = r.choice("sdi") if r.random() < share else ""
        out += {"": [w], "s": [f"zq{r.randrange(99)}"], "d": [], "i": [w, "zq"]}[k]
    return " ".join(out)
