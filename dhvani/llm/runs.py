"""Periodic runs of words by recompression.

A run is a stretch of consecutive words of one text with smallest period q (words q
apart are identical) that no neighbouring word extends; ``find_runs`` returns those of
``exponent`` periods and ``shortest`` words at least, and the text without their
repetitions: a word goes if a run contains it after that run's first q words.

*   Grammar.  The word sequences of a chunk of texts are rewritten level by level.  Block
    compression names each maximal block a^r; pair compression splits the names into a
    left and a right half by a hash and names each pair of a left and a right one.  The
    texts stand between separators that occur once, so nothing matches across them.
*   LCE.  What two equal stretches become differs only at their borders, by one name or
    one rest of a block a level.  So a query for the longest common extension of two
    places climbs while the names agree, stepping over at most one name a level to reach
    a common boundary, and comes down where they differ: O(levels), for a whole array of
    queries at a time.  Extensions to the left are asked of the mirrored grammar.
*   Harmonic grid.  Where a run of period q and ``exponent`` e begins to repeat, words q
    apart agree in (e - 1) q places in a row, one of which is a multiple of (e - 1) q.
    Those grid places, n / ((e - 1) q) for each q and O(n log n) in all, are compared by
    one word; the few that agree are extended exactly.  Grid places inside a known run
    whose period divides q would find that run again and are left out.

Words are numbered by a dictionary of the chunk, so equal numbers are equal words.
Texts are independent: a scan without a shuffle, in chunks of ``kit.CHUNK_BYTES`` or
one text; a text of n words takes about 80 n bytes beside its words.

Cases: null or empty text: no words and no runs; fewer words than ``shortest``: no
runs; rows that repeat an id or a text are judged each by itself; a null id stays null
(the query rewrites nothing in such a row); other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

#: A run has so many words at least, and so many periods.
SHORTEST = 6
EXPONENT = 4
#: Grid places that are looked at together.
SLICE = 1 << 20
#: Words that are joined together when a text is put out.
PIECE = 1 << 16

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


class Level:
    """Names ``sym``; ``child[i]:child[i + 1]`` are those that name i of the next level
    stands for; ``block``: by block compression."""

    __slots__ = ("sym", "child", "block")

    def __init__(self, sym: np.ndarray, child: np.ndarray | None = None, block: bool = False):
        self.sym, self.child, self.block = sym, child, block


class Grammar:
    """A run-length grammar of ``sym``, which begins and ends with names that occur once."""

    def __init__(self, sym: np.ndarray | None, single: int = 0):
        self.levels: list[Level] = []
        self.top = sym
        if sym is None:
            return
        names, seed = int(sym.max(initial=0)) + 1, 0
        while len(self.top) > 2 * single and seed < 64:
            names = self._blocks(names)
            names = self._pairs(names, seed)
            seed += 1

    def _put(self, child: np.ndarray, named: np.ndarray, keys: np.ndarray, names: int, block: bool) -> int:
        """The next level: first children keep their names but for ``named``, which are named by their keys."""
        _, ids = np.unique(keys, return_inverse=True)
        sym = self.top[child]
        sym[named] = (names + ids).astype(np.int32)
        self.levels.append(Level(self.top, np.append(child, len(self.top)).astype(np.int32), block))
        self.top = sym
        return names + int(ids.max()) + 1

    def _blocks(self, names: int) -> int:
        t = self.top
        child = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
        size = np.diff(np.append(child, len(t)))
        named = np.flatnonzero(size > 1)
        if not len(named):
            return names
        return self._put(child, named, (t[child[named]].astype(np.int64) << 32) | size[named], names, True)

    def _pairs(self, names: int, seed: int) -> int:
        t = self.top
        right = (kit.mix(t.astype(np.uint64) ^ np.uint64((seed + 1) << 40)) >> np.uint64(63)).astype(bool)
        turn = np.flatnonzero(right[1:] != right[:-1])
        rising = right[turn + 1]
        if 2 * np.count_nonzero(rising) < len(turn):
            rising = ~rising
        at = turn[rising]
        if not len(at):
            return names
        first = np.ones(len(t), bool)
        first[at + 1] = False
        child = np.flatnonzero(first)
        keys = (t[at].astype(np.int64) << 32) | t[at + 1]
        return self._put(child, np.searchsorted(child, at), keys, names, False)

    def mirror(self) -> Grammar:
        """The grammar of the reversed sequence."""
        out = Grammar(None)
        out.top = self.top[::-1]
        out.levels = [Level(v.sym[::-1], (len(v.sym) - v.child[::-1]).astype(np.int32), v.block) for v in self.levels]
        return out

    def lce(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many names agree from each i and each j on (i and j differ)."""
        at, p, q = np.arange(len(i)), i, j
        differ: list[list[tuple]] = [[] for _ in range(len(self.levels) + 1)]
        for k, level in enumerate(self.levels):
            same = level.sym[p] == level.sym[q]
            differ[k].append((at[~same], p[~same], q[~same]))
            at, p, q = at[same], p[same], q[same]
            up = np.searchsorted(level.child, p, side="right") - 1
            uq = np.searchsorted(level.child, q, side="right") - 1
            inside = (level.child[up] != p) | (level.child[uq] != q)
            if level.block:
                rp, rq = level.child[up + 1] - p, level.child[uq + 1] - q
                uneven = inside & (rp != rq)
                step = np.minimum(rp, rq)[uneven]
                differ[k].append((at[uneven], p[uneven] + step, q[uneven] + step))
                at, up, uq, inside = at[~uneven], up[~uneven], uq[~uneven], inside[~uneven]
            p, q = up + inside, uq + inside
        while len(at):
            same = self.top[p] == self.top[q]
            differ[-1].append((at[~same], p[~same], q[~same]))
            at, p, q = at[same], p[same] + 1, q[same] + 1
        at = p = q = np.zeros(0, np.int64)
        for k in range(len(self.levels), -1, -1):
            for more in differ[k]:
                at, p, q = (np.concatenate(x) for x in zip((at, p, q), more))
            if k:
                level = self.levels[k - 1]
                a, b = level.child[p], level.child[q]
                step = np.minimum(level.child[p + 1] - a, level.child[q + 1] - b) if level.block else 1
                same = level.sym[a] == level.sym[b]
                p, q = a + same * step, b + same * step
        out = np.zeros(len(i), np.int64)
        out[at] = p - i[at]
        return out


def runs_of(ids: np.ndarray, first: np.ndarray, shortest: int = SHORTEST, exponent: int = EXPONENT):
    """(text, start, length, period) of the runs of the word numbers ``ids``, where text d
    has the words ``first[d]:first[d + 1]``; by text, start and period."""
    size = np.diff(first)
    none = tuple(np.zeros(0, np.int64) for _ in range(4))
    keep = np.flatnonzero(size >= max(shortest, exponent))
    if not len(keep):
        return none
    # The texts that can hold a run, each after a separator, and one separator behind.
    n = size[keep]
    base = np.cumsum(n + 1) - n
    single = len(keep) + 1
    sym = np.empty(int(n.sum()) + single, np.int32)
    words = np.ones(len(sym), bool)
    words[base - 1] = False
    words[-1] = False
    member = np.zeros(len(size), bool)
    member[keep] = True
    sym[words] = ids[np.repeat(member, size)]
    sym[~words] = int(ids.max()) + 1 + np.arange(single)

    # (text, period) pairs, by period.
    periods = n // exponent
    text = np.repeat(np.arange(len(n)), periods)
    q = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    order = np.argsort(q, kind="stable")
    text, q = text[order], q[order]
    grid = (exponent - 1) * q
    places = -(-(n[text] - q) // grid)
    total = np.cumsum(places)

    forward = backward = None
    # Of the known runs over a place, the end and the period of the one that reaches farthest.
    reach, step = np.zeros(len(sym), np.int32), np.ones(len(sym), np.int32)
    found = [np.zeros((0, 3), np.int64)]  # start, end, period
    lo = 0
    while lo < len(q):
        before = total[lo - 1] if lo else 0
        hi = max(int(np.searchsorted(total, before + SLICE, side="right")), lo + 1)
        m = places[lo:hi]
        pair = np.repeat(np.arange(lo, hi), m)
        i = base[text[pair]] + (np.arange(len(pair)) - np.repeat(np.cumsum(m) - m, m)) * grid[pair]
        j = i + q[pair]
        lo = hi
        fresh = (sym[i] == sym[j]) & ((j >= reach[i]) | ((j - i) % step[i] != 0))
        i, j = i[fresh], j[fresh]
        if not len(i):
            continue
        if forward is None:
            forward = Grammar(sym, single)
            backward = forward.mirror()
        s = i - backward.lce(len(sym) - i, len(sym) - j)
        e = j + forward.lce(i, j)
        ok = e - s >= np.maximum(shortest, exponent * (j - i))
        new = np.unique(np.column_stack((s, e, j - i))[ok], axis=0)
        for a, b, p in new.tolist():
            now = reach[a:b] < b
            reach[a:b][now], step[a:b][now] = b, p
        found.append(new)
    # A stretch has its smallest period; multiples of it span the same stretch.
    out = np.unique(np.concatenate(found), axis=0)
    out = out[np.concatenate(([True], (out[1:, :2] != out[:-1, :2]).any(axis=1)))[:len(out)]]
    out = out[np.lexsort((out[:, 2], out[:, 0]))]
    d = np.searchsorted(base, out[:, 0], side="right") - 1
    return keep[d], out[:, 0] - base[d], out[:, 1] - out[:, 0], out[:, 2]


def numbered(texts: list[bytes]):
    """(word numbers, first word of each text and the end, the words by number)."""
    ids: defaultdict = defaultdict()
    ids.default_factory = ids.__len__
    parts, first = [], [0]
    for t in texts:
        words = t.split()
        parts.append(np.fromiter(map(ids.__getitem__, words), np.int32, len(words)))
        first.append(first[-1] + len(words))
    return np.concatenate(parts or [np.zeros(0, np.int32)]), np.array(first), list(ids)


def joined(ids: np.ndarray, words: list[bytes]) -> str:
    """The words of these numbers with one space between."""
    pieces = (b" ".join(map(words.__getitem__, ids[a:a + PIECE].tolist())) for a in range(0, len(ids), PIECE))
    return b" ".join(pieces).decode("utf-8", "surrogatepass")


def dropped(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which of n words a run contains after its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, start + period, 1)
    np.add.at(edge, start + length, -1)
    return np.cumsum(edge[:-1]) > 0


def find_runs(docs: DataFrame, shortest: int = SHORTEST, exponent: int = EXPONENT, rewrite=None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of each row's text: the runs by start and
    period, and the words that stay with one space between.  ``rewrite(doc_id, n)`` may
    give (a, p): word i >= a is then the text's word a + (i - a) % p."""
    if shortest < 2 or exponent < 2:
        raise ValueError("a run has 2 words and 2 periods at least")

    def scan(frames):
        for f in frames:
            owner = f["doc_id"].tolist()
            ids, first, words = numbered(kit.to_bytes(f["text"].tolist()))
            if rewrite is not None:
                for k, who in enumerate(owner):
                    how = rewrite(who, int(first[k + 1] - first[k])) if who is not pd.NA else None
                    if how is not None:
                        own = ids[first[k]:first[k + 1]]
                        i = np.arange(len(own))
                        own[:] = own[np.where(i < how[0], i, how[0] + (i - how[0]) % how[1])]
            d, start, length, period = runs_of(ids, first, shortest, exponent)
            cut = np.searchsorted(d, np.arange(len(owner) + 1))
            runs, kept = [], []
            for k in range(len(owner)):
                a, b = cut[k], cut[k + 1]
                own = ids[first[k]:first[k + 1]]
                if b > a:
                    own = own[~dropped(len(own), start[a:b], length[a:b], period[a:b])]
                runs.append([{"start": x, "length": y, "period": z} for x, y, z in
                             zip(start[a:b].tolist(), length[a:b].tolist(), period[a:b].tolist())])
                kept.append(joined(own, words))
            yield pd.DataFrame({"doc_id": f["doc_id"], "n_words": np.diff(first), "runs": runs, "collapsed": kept})

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return kit.map_texts(docs, scan, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def planted(doc_id: int, n: int):
    """The query's rewriting: one text in ten repeats itself from some word on."""
    import zlib

    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document."""
    found = find_runs(kit.table(spark, sf_dir, "documents"), rewrite=planted)
    # The greatest of these: longest, then first, then of the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    found = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.floor(1000 * F.col("best.length") / (-F.col("best.period"))).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(listed, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
