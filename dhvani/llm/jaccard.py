"""Near-duplicate groups by a count-vector R-tree join on word n-gram sets.

A document's set holds the 64-bit hashes of its distinct n-word shingles.  Two
documents link when |A n B| >= t |A u B|; equal sets form a class, and the join
works on one representative of each class.

1.  *Routing, without loss.*  A linked pair differs in at most
    D = (1 - t) / (1 + t) (|A| + |B|) shingles.  Hash the shingles into more
    than D groups and at least one group has the same content in both sets.  The
    number of groups follows from the size class of the pair (sizes whose ratio
    is t or more lie in one class or in neighbours), so a set signs its groups
    for its own class and for the one below.  The group may be empty in both
    sets; as the pair then touches every group that holds a shingle, a set with no
    more of those than a pair may differ in also signs its |A| - ceil(t |A|) + 1
    smallest shingles, of which linked sets share one.  A first pass over the texts finds
    the signatures that occur twice; a bitmap of fixed size holds them (it may
    pass more, never fewer), and only those travel with their sets' points.
    Sets that share a signature and whose points allow a link (see 3) are
    connected in a graph of candidates; texts that share a passage are not.  The
    points of this step have more groups the larger a set is, as minima of large
    counts tell unrelated sets no longer apart.
2.  *Pages.*  The candidates' sets are dealt to pages of about ``PAGE`` sets, a
    candidate component to one page.  A component of more than ``PAGE`` sets is
    cut into blocks, and each pair of blocks is a page, so a large group of near
    copies never meets in one task.
3.  *Count-vector R-tree.*  In a page, the shingles are hashed into ``GROUPS``
    groups; the counts of its groups make a set a point.  Points are packed into
    nodes of ``FANOUT``, each with the largest count per group.  A set descends
    where min(q, bound) summed over the coordinates reaches the least overlap
    that a link needs; pairs of points that pass the same test are verified
    exactly.  Pairs already connected in the page are skipped, and only links that
    connect are returned.
4.  The links' components give the classes' groups.

Cases: a text without words, or null, has size 0 and links with nothing; with
fewer words than n the whole sequence is its one shingle; a null doc_id keeps
its row, lends no id to its group (a group of only such rows has a null
component); rows with the same text, repeated ids included, are one class; other
columns are ignored.  Hashes have 64 bits: two different sets are taken for
equal, or shingles of one pair confused, with a chance of about pairs / 2^64.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

#: Sets of a page; a page of two blocks holds up to twice as many.
PAGE = 512
#: Coordinates of a point.
GROUPS = 64
#: Shingles a coordinate of the points that travel with signatures, at most: larger sets
#: have twice as many coordinates, and so on.
LOAD = 12
#: Counts from here on are kept as this one, and bound nothing.
MOST = 255
#: Entries of an R-tree node.
FANOUT = 16
#: Bits of the filters that hold repeated signatures and candidate classes: 8 MB each at any size.
SIGNATURE_BITS, FILTER_BITS = 26, 26
#: Bytes of a signature in the first pass (its bucket adds some bits).
SHORT = 5
#: Buckets that the signatures are dealt to, for each default partition of a shuffle.
BUCKETS = 2
#: A signature of at most so many classes has all its pairs tried at once.
FEW = 8
#: Pairs whose points are compared at once.
PAIRS = 1 << 15


def shingle_sets(w: kit.Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): the distinct n-word shingles of text i, ascending, are
    ``hashes[first[i]:first[i + 1]]``."""
    g, at = w.grams(n)
    own = np.searchsorted(w.first, at, side="right") - 1
    size = np.diff(w.first)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        h = size[short].astype(np.uint64)
        for k in range(n - 1):
            has = size[short] > k
            h[has] = kit.mix(h[has]) ^ w.hash[w.first[short[has]] + k]
        g, own = np.concatenate((g, kit.mix(h + np.uint64(1)))), np.concatenate((own, short))
    order = np.lexsort((g, own))
    g, own = g[order], own[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (own[1:] != own[:-1])
    g, own = g[new], own[new]
    return g, np.searchsorted(own, np.arange(len(size) + 1))


def class_keys(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit key of each set (0 for the empty one)."""
    size = np.diff(first)
    place = np.arange(len(g)) - np.repeat(first[:-1], size)
    x = kit.mix(g ^ kit.mix(place.astype(np.uint64) + np.uint64(7)))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)))
    key = kit.mix((total[first[1:]] - total[first[:-1]]) ^ size.astype(np.uint64))
    key = np.where(size > 0, key | np.uint64(1), np.uint64(0))
    return key.view(np.int64)


def _sets(frames, n: int, text: str = "text"):
    """(frame, hashes, first, class keys) in chunks of bounded text."""
    for f in frames:
        f = f.reset_index(drop=True)
        texts = kit.to_bytes(f[text], lower=True)
        for a, b in kit.chunks(texts):
            g, first = shingle_sets(kit.Words(texts[a:b]), n)
            yield f.iloc[a:b], g, first, class_keys(g, first)


def size_class(size: np.ndarray, t: float) -> np.ndarray:
    """Sizes a <= b with a >= t b lie in one class or in neighbours."""
    return np.floor(np.log(np.maximum(size, 1)) / -math.log(t) + 1e-9).astype(np.int64)


def groups_of(cls: np.ndarray, t: float) -> np.ndarray:
    """Groups that a pair out of class ``cls``, or of it and the next, needs: one
    more than the shingles that a linked pair of them may differ in."""
    top = np.exp((cls + 2) * -math.log(t)) + 1  # above any size of the next class
    low = np.minimum(top, np.exp((cls + 1) * -math.log(t)) + 1)  # and of this one
    return np.floor((1 - t) / (1 + t) * (top + low)).astype(np.int64) + 1


def most_apart(size: np.ndarray, cls: np.ndarray, below: int, t: float) -> np.ndarray:
    """Shingles that a set and one that it links with may differ in at most: sets of
    class ``cls`` when ``below``, else any."""
    top = size / t
    if below:
        top = np.minimum(top, np.exp((cls + 1) * -math.log(t)) + 1)
    return np.floor((1 - t) / (1 + t) * (size + top) + 1e-6).astype(np.int64)


def signatures(g: np.ndarray, first: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(signature, set) of all groups that hold a shingle, for both size classes, and of
    the smallest shingles of the sets whose groups may all be touched."""
    size = np.diff(first)
    num = round(t * 100)
    place = np.arange(len(g)) - np.repeat(first[:-1], size)
    small = place <= np.repeat(size - -(-num * size // 100), size)
    own = np.repeat(np.arange(len(size)), size)
    cls = size_class(size, t)
    out = []
    for below in (0, 1):
        c = cls - below
        k = groups_of(c, t)[own].astype(np.uint64)
        grp = kit.mix(g ^ np.uint64(0xA5A5)) % k
        order = np.lexsort((grp, own))  # g ascends within a set already; lexsort is stable
        o, q, x = own[order], grp[order], g[order]
        new = np.ones(len(x), bool)
        new[1:] = (o[1:] != o[:-1]) | (q[1:] != q[:-1])
        at = np.flatnonzero(new)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(kit.mix(x), dtype=np.uint64)))
        end = np.append(at[1:], len(x))
        content = total[end] - total[at]
        tag = q[at] + (c[o[at]] + 1).astype(np.uint64) * np.uint64(1 << 32)
        out.append((kit.mix(kit.mix(content) ^ tag), o[at]))
        short = np.bincount(o[at], minlength=len(size)) <= most_apart(size, c, below, t)
        at = np.flatnonzero(small & short[own])
        tag = (c[own[at]] + 1).astype(np.uint64) * np.uint64(1 << 32) ^ np.uint64(0x5A5A << 16)
        out.append((kit.mix(kit.mix(g[at]) ^ tag), own[at]))
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _signed(frames, n: int, t: float):
    """(hashes, first, classes, signature, set) of each chunk, copies once."""
    for _, g, first, key in _sets(frames, n):
        _, one = np.unique(key, return_index=True)
        one = one[key[one] != 0]
        if len(one):
            at = np.concatenate([np.arange(first[i], first[i + 1]) for i in one])
            g, first, key = g[at], np.concatenate(([0], np.cumsum(np.diff(first)[one]))), key[one]
            yield g, first, key, *signatures(g, first, t)


def _bucket(sig: np.ndarray, buckets: int) -> np.ndarray:
    return (sig >> np.uint64(8 * SHORT)).astype(np.int64) % buckets


def _runs(x: np.ndarray):
    """(value, first, end) of the runs of equal neighbours."""
    at = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return x[at], at, np.append(at[1:], len(x))


def _short(sig: np.ndarray) -> bytes:
    return np.ascontiguousarray(sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHORT]).tobytes()


def _long(parts) -> np.ndarray:
    x = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, SHORT)
    out = np.zeros((len(x), 8), np.uint8)
    out[:, :SHORT] = x
    return out.view("<u8").ravel()


def _first_pass(n: int, t: float, buckets: int):
    """Signatures of each chunk by bucket: those of one class, those of more."""
    def run(frames):
        for *_, sig, own in _signed(frames, n, t):
            order = np.lexsort((own, _bucket(sig, buckets), sig))
            sig, own = sig[order], own[order]
            value, lo, hi = _runs(sig)
            more = own[lo] != own[hi - 1]
            b = _bucket(value, buckets)
            order = np.argsort(b, kind="stable")
            value, more, b = value[order], more[order], b[order]
            yield pd.DataFrame([(int(q), _short(value[x:y][~more[x:y]]), _short(value[x:y][more[x:y]])) for q, x, y in zip(*_runs(b))],
                               columns=["bucket", "one", "more"])
    return run


def _twice(f: pd.DataFrame) -> pd.DataFrame:
    """Places in the filter of the signatures that occur twice."""
    sig = np.concatenate((_long(f["one"]), np.repeat(_long(f["more"]), 2)))
    sig.sort()
    x = np.unique(sig[1:][sig[1:] == sig[:-1]] & np.uint64((1 << SIGNATURE_BITS) - 1))
    return pd.DataFrame({"x": x.astype(np.int64)})


def count_vectors(g: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The point of each set: how many of its shingles fall into each group."""
    own = np.repeat(np.arange(len(first) - 1), np.diff(first))
    cell = own * GROUPS + (kit.mix(g) % np.uint64(GROUPS)).astype(np.int64)
    return np.bincount(cell, minlength=(len(first) - 1) * GROUPS).reshape(-1, GROUPS)


def levels(size: np.ndarray) -> np.ndarray:
    """How often the coordinates of each set's fine point are doubled."""
    return np.ceil(np.log2(np.maximum(size / (GROUPS * LOAD), 1))).astype(np.int64)


def fine_points(g: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(counts, start): the fine point of set i is ``counts[start[i]:start[i + 1]]``, a byte a
    coordinate.  Those of sets of another level are compared by adding up its halves."""
    size = np.diff(first)
    width = GROUPS << levels(size)
    start = np.concatenate(([0], np.cumsum(width)))
    cell = np.repeat(start[:-1], size) + (kit.mix(g) & np.repeat(width - 1, size).astype(np.uint64)).astype(np.int64)
    return np.minimum(np.bincount(cell, minlength=start[-1]), MOST).astype(np.uint8), start


class FinePoints:
    """The fine points of sets of given sizes, one after the other in ``counts``."""

    def __init__(self, size: np.ndarray, counts: np.ndarray):
        self.size, self.level = size, levels(size)
        start = np.cumsum(GROUPS << self.level) - (GROUPS << self.level)
        self.place, self.rows = np.zeros(len(size), np.int64), {}
        for k in np.unique(self.level).tolist():
            at = np.flatnonzero(self.level == k)
            self.place[at] = np.arange(len(at))
            self.rows[k] = counts[start[at][:, None] + np.arange(GROUPS << k)]

    def folded(self, who: np.ndarray, level: int, to: int) -> np.ndarray:
        """Points of the sets ``who`` of one level with as few coordinates as level ``to``."""
        x = self.rows[level][self.place[who]].astype(np.int32)
        x[x == MOST] = 1 << 20
        return x.reshape(len(who), -1, GROUPS << to).sum(axis=1)

    def coarse(self, who: np.ndarray) -> np.ndarray:
        out = np.zeros((len(who), GROUPS), np.int64)
        for k in np.unique(self.level[who]).tolist():
            at = np.flatnonzero(self.level[who] == k)
            out[at] = self.folded(who[at], k, 0)
        return out

    def may_link(self, i: np.ndarray, j: np.ndarray, t: float) -> np.ndarray:
        """Whether the summed minima of each pair reach the overlap of a link."""
        ok = np.zeros(len(i), bool)
        kind = self.level[i] * 64 + self.level[j]
        for k in np.unique(kind).tolist():
            a, b = divmod(k, 64)
            all_, to = np.flatnonzero(kind == k), min(a, b)
            step = max(PAIRS >> max(a, b), 1)
            for x in range(0, len(all_), step):
                at = all_[x:x + step]
                shared = np.minimum(self.folded(i[at], a, to), self.folded(j[at], b, to)).sum(axis=1)
                ok[at] = shared >= least_overlap(self.size[i[at]], self.size[j[at]], t)
        return ok


def _second_pass(n: int, t: float, buckets: int, maps):
    """The repeated signatures of each chunk by bucket, with the classes, sizes and
    points of the sets that have one there."""
    def run(frames):
        table = _bits(maps.value, SIGNATURE_BITS)
        for g, first, key, sig, own in _signed(frames, n, t):
            ok = _has(table, sig, SIGNATURE_BITS)
            sig, own = sig[ok], own[ok]
            size, (counts, start) = np.diff(first), fine_points(g, first)
            b = _bucket(sig, buckets)
            order = np.argsort(b, kind="stable")
            b, sig, own = b[order], sig[order], own[order]
            rows = []
            for q, x, y in zip(*_runs(b)):
                used, index = np.unique(own[x:y], return_inverse=True)
                points = b"".join(counts[start[i]:start[i + 1]].tobytes() for i in used)
                rows.append((int(q), sig[x:y].tobytes(), index.astype(np.int32).tobytes(), key[used].tobytes(),
                             size[used].tobytes(), zlib.compress(points, 1)))
            yield pd.DataFrame(rows, columns=["bucket", "sig", "own", "cls", "size", "points"])
    return run


def _candidate_edges(t: float):
    """Edges that connect, within a bucket, the sets that share a signature and whose
    points allow a link."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        cls, size = (np.frombuffer(b"".join(f[c]), np.int64) for c in ("cls", "size"))
        points = FinePoints(size, np.frombuffer(b"".join(map(zlib.decompress, f["points"])), np.uint8))
        base = np.cumsum([0] + [len(b) // 8 for b in f["cls"]])
        own = np.concatenate([np.frombuffer(b, np.int32) + base[i] for i, b in enumerate(f["own"])])
        sig = np.frombuffer(b"".join(f["sig"]), np.uint64)
        cls, at, back = np.unique(cls, return_index=True, return_inverse=True)  # copies of different chunks
        size, who, own = size[at], at, back[own]  # who: the place of a class's point
        order = np.lexsort((own, sig))
        sig, own = sig[order], own[order]
        new = np.ones(len(sig), bool)
        new[1:] = (sig[1:] != sig[:-1]) | (own[1:] != own[:-1])
        sig, own = sig[new], own[new]
        _, lo, hi = _runs(sig)
        many = hi - lo
        pairs = []
        for k in range(2, FEW + 1):
            at = lo[many == k]
            pairs += [np.column_stack((own[at + i], own[at + j])) for i in range(k) for j in range(i + 1, k)]
        pairs = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
        pairs = np.unique(pairs[:, 0] * len(cls) + pairs[:, 1])
        groups, edges = Groups(len(cls)), []
        for k in range(0, len(pairs), PAIRS):
            i, j = np.divmod(pairs[k:k + PAIRS], len(cls))
            ok = points.may_link(who[i], who[j], t)
            edges += [(a, b) for a, b in zip(i[ok].tolist(), j[ok].tolist()) if groups.join(a, b)]
        for x, y in zip(lo[many > FEW].tolist(), hi[many > FEW].tolist()):
            members = own[x:y]
            left = {groups.find(i) for i in members.tolist()}
            if len(left) == 1:
                continue
            coarse = points.coarse(who[members])
            tree = RTree(coarse, size[members])
            for i, q in zip(members.tolist(), coarse):
                near = members[tree.search(q, int(size[i]), t)]
                mine = groups.find(i)
                near = np.array([j for j in near.tolist() if groups.find(j) != mine], np.int64)
                for j in near[points.may_link(np.full(len(near), who[i]), who[near], t)].tolist():
                    a, b = groups.find(i), groups.find(j)
                    if groups.join(i, j):
                        edges.append((i, j))
                        left -= {a, b}
                        left.add(groups.find(i))
                if len(left) == 1:
                    break
        e = np.array(edges, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": cls[e[:, 0]], "b": cls[e[:, 1]]})
    return run


class Groups:
    """Union and find."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, i: int, j: int) -> bool:
        """Whether the two were apart."""
        a, b = self.find(i), self.find(j)
        self.up[b] = a
        return a != b


def least_overlap(a, b, t: float):
    """Shared shingles that sets of sizes a and b need, in exact integers:
    den * o >= num * (a + b - o) with t = num / den."""
    num, den = round(t * 100), 100
    return -(-num * (a + b) // (num + den))


class RTree:
    """Count vectors packed into nodes of ``FANOUT``, level by level; a node knows
    the largest count per group and the sizes below it."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        # Sort-tile order: by size, then by the groups that vary most.
        spread = np.argsort(-points.std(axis=0))[:2] if len(points) else []
        slab = np.argsort(sizes, kind="stable")
        self.order = np.concatenate([s[np.lexsort([points[s, c] for c in spread])]
                                     for s in np.array_split(slab, max(1, len(slab) // (FANOUT * 8)))])
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels = []  # from the leaves up: (largest counts, smallest size, largest size)
        hi, lo_n, hi_n = self.points, self.sizes, self.sizes
        while len(hi) > FANOUT:
            at = np.arange(0, len(hi), FANOUT)
            hi = np.maximum.reduceat(hi, at)
            lo_n, hi_n = np.minimum.reduceat(lo_n, at), np.maximum.reduceat(hi_n, at)
            self.levels.append((hi, lo_n, hi_n))

    def search(self, q: np.ndarray, n: int, t: float) -> np.ndarray:
        """Entries whose summed minima with ``q`` reach the overlap of a link."""
        if self.levels:
            node = np.arange(len(self.levels[-1][0]))
        else:
            node = np.arange(len(self.points))
        for k in range(len(self.levels) - 1, -1, -1):
            hi, lo_n, hi_n = self.levels[k]
            # The smallest partner below the node asks for the least overlap.
            least = least_overlap(np.maximum(lo_n[node], math.floor(t * n)), n, t)
            ok = (hi_n[node] >= t * n - 1e-9) & (lo_n[node] * t <= n + 1e-9)
            ok &= np.minimum(hi[node], q).sum(axis=1) >= least
            below = len(self.levels[k - 1][0]) if k else len(self.points)
            node = (node[ok][:, None] * FANOUT + np.arange(FANOUT)).ravel()
            node = node[node < below]
        ok = np.minimum(self.points[node], q).sum(axis=1) >= least_overlap(self.sizes[node], n, t)
        return self.order[node[ok]]


def page_links(left: list[np.ndarray], right: list[np.ndarray] | None, t: float) -> list[tuple[int, int]]:
    """Links (i, j) that connect the sets of a page, by R-tree search and exact
    check.  ``right`` None: among ``left``; else between the two, j counted on
    from the end of ``left``."""
    sets = left + (right or [])
    size = np.array([len(s) for s in sets], np.int64)
    if len(sets) < 2:
        return []
    flat = np.concatenate(sets)
    first = np.concatenate(([0], np.cumsum(size)))
    points = count_vectors(flat, first)
    ids = np.unique(flat, return_inverse=True)[1]
    mark = np.zeros(ids.max() + 1, bool)
    base = 0 if right is None else len(left)
    tree = RTree(points[base:], size[base:])
    groups, out = Groups(len(sets)), []
    for i in range(len(left)):
        near = tree.search(points[i], int(size[i]), t) + base
        if right is None:
            near = near[near > i]
        mine = groups.find(i)
        near = np.array([j for j in near.tolist() if groups.find(j) != mine], np.int64)
        if not len(near):
            continue
        mark[ids[first[i]:first[i + 1]]] = True
        at = np.concatenate([np.arange(first[j], first[j + 1]) for j in near])
        hits = np.add.reduceat(mark[ids[at]], np.concatenate(([0], np.cumsum(size[near])[:-1])), dtype=np.int64)
        mark[ids[first[i]:first[i + 1]]] = False
        for j in near[hits >= least_overlap(size[near], size[i], t)].tolist():
            if groups.join(i, j):
                out.append((i, j))
    return out


def _page(t: float):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        cls = f["cls"].to_numpy()
        sets = [np.frombuffer(b, np.uint64) for b in f["grams"]]
        side = f["side"].to_numpy()
        if (side >= 0).any():  # two blocks of one component
            lo, hi = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            got = page_links([sets[i] for i in lo], [sets[i] for i in hi], t)
            who = np.concatenate((lo, hi))
        else:
            got, who = page_links(sets, None, t), np.arange(len(sets))
        a = np.array([who[i] for i, _ in got], np.int64)
        b = np.array([who[j] for _, j in got], np.int64)
        return pd.DataFrame({"a": cls[a], "b": cls[b]})
    return run


def _bitmap(places: DataFrame) -> list[tuple[int, bytes]]:
    """Bitmap of the places x: 4 KB rows, 2^(bits - 15) of them at most."""
    rows = (places.select(F.shiftright("x", 15).alias("k"), F.col("x").bitwiseAND((1 << 15) - 1).alias("p"))
            .groupBy("k").agg(F.expr("bitmap_construct_agg(p)").alias("bits")).collect())
    return [(r["k"], bytes(r["bits"])) for r in rows]


def _bits(maps, bits: int) -> np.ndarray:
    table = np.zeros((1 << bits) // 8, np.uint8)
    for k, b in maps:
        table[k << 12:(k + 1) << 12] = np.frombuffer(b, np.uint8)
    return table


def _has(table: np.ndarray, x: np.ndarray, bits: int) -> np.ndarray:
    x = (x.view(np.int64) & ((1 << bits) - 1))
    return (table[x >> 3] >> (x & 7).astype(np.uint8)) & 1 == 1


def candidate_graph(texts: DataFrame, n: int, t: float) -> DataFrame:
    """(a, b): edges that connect all classes that may be linked."""
    spark = texts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    short = kit.map_texts(texts, _first_pass(n, t, BUCKETS * parts), "bucket long, one binary, more binary")
    maps = spark.sparkContext.broadcast(_bitmap(short.groupBy("bucket").applyInPandas(_twice, "x long")))
    signed = kit.map_texts(texts, _second_pass(n, t, max(parts // 2, 1), maps),
                               "bucket long, sig binary, own binary, cls binary, size binary, points binary")
    return signed.groupBy("bucket").applyInPandas(_candidate_edges(t), "a long, b long")


def _candidate_sets(maps, n: int):
    """(cls, grams) of the classes that the filter may hold, once per chunk."""
    def run(frames):
        table = _bits(maps.value, FILTER_BITS)
        for _, g, first, key in _sets(frames, n):
            ok = np.flatnonzero(_has(table, key, FILTER_BITS) & (key != 0))
            _, one = np.unique(key[ok], return_index=True)
            ok = ok[one]
            yield pd.DataFrame({"cls": key[ok], "grams": [g[first[i]:first[i + 1]].tobytes() for i in ok]})
    return run


def links(texts: DataFrame, n: int, t: float) -> DataFrame:
    """(a, b): links of different classes that connect all that are connected."""
    spark = texts.sparkSession
    cand = kit.components(candidate_graph(texts, n, t))
    sizes = cand.groupBy("comp").agg(F.count("*").alias("m"))
    total = cand.count()
    pages = max(1, -(-total // PAGE))
    cand = cand.join(sizes.hint("merge"), "comp")
    # A hot component is dealt by the hash of the class into m / PAGE blocks; block
    # i meets block j on the page (i, j), so each row goes to as many pages as blocks.
    blocks = F.greatest(F.ceil(F.col("m") / PAGE), F.lit(1)).cast("int")
    block = F.pmod(F.xxhash64("node", F.lit(3)), blocks).cast("int")
    other = F.explode(F.when(blocks == 1, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), blocks - 1)))
    cand = cand.withColumn("blocks", blocks).withColumn("block", block).select("node", "comp", "block", "blocks", other.alias("other"))
    small = F.col("blocks") == 1
    page = F.when(small, F.struct(F.lit(0).cast("long").alias("c"), F.pmod(F.xxhash64("comp"), F.lit(pages)).cast("int").alias("i"),
                                  F.lit(-1).alias("j")))
    page = page.otherwise(F.struct(F.col("comp").alias("c"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))
    side = F.when(small | (F.col("block") == F.col("other")), F.lit(-1)).otherwise((F.col("block") > F.col("other")).cast("int"))
    cand = cand.select(F.col("node").alias("cls"), page.alias("page"), side.alias("side"))
    maps = spark.sparkContext.broadcast(_bitmap(cand.select(F.col("cls").bitwiseAND((1 << FILTER_BITS) - 1).alias("x"))))
    sets = kit.map_texts(texts, _candidate_sets(maps, n), "cls long, grams binary")
    # Copies in different chunks bring the same set: the first one serves.
    sets = sets.groupBy("cls").agg(F.first("grams").alias("grams"))
    dealt = sets.join(cand, "cls")
    return dealt.groupBy("page").applyInPandas(_page(t), "a long, b long")


def _doc_classes(n: int):
    def run(frames):
        for f, _, first, key in _sets(frames, n):
            yield pd.DataFrame({"doc_id": f["doc_id"].astype("Int64").array, "row": f["row"].array, "n_shingles": np.diff(first), "cls": key})
    return run


def _grouped(docs: DataFrame, n: int, t: float, row) -> DataFrame:
    """(doc_id, row, n_shingles, cls, comp, component_id) per row of ``docs`` (doc_id, text):
    ``row`` tells rows apart, comp is the component itself (null for an empty set)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row.alias("row"), "text")
    texts = docs.select("text")
    from ..session import ensure_checkpoint_dir

    ensure_checkpoint_dir(docs.sparkSession)
    rows = kit.map_texts(docs, _doc_classes(n), "doc_id long, row long, n_shingles long, cls long").checkpoint()
    found = kit.components(links(texts, n, t))
    # A class's smallest id, then that of its component: min is combined map-side.
    mins = rows.where("cls <> 0").groupBy("cls").agg(F.min("doc_id").alias("low"))
    mins = mins.join(found.withColumnRenamed("node", "cls").hint("merge"), "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    best = mins.groupBy("comp").agg(F.min("low").alias("component_id"))
    by_class = mins.join(best.hint("merge"), "comp").select("cls", "comp", "component_id")
    out = rows.join(by_class.hint("merge"), "cls", "left")
    return out.withColumn("component_id", F.when(F.col("cls") == 0, F.col("doc_id")).otherwise(F.col("component_id")))


def near_groups(docs: DataFrame, n: int, t: float) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs`` (doc_id, text)."""
    return _grouped(docs, n, t, F.lit(0).cast("long")).select("doc_id", "n_shingles", "component_id")


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.9, over all documents."""
    return near_groups(kit.table(spark, sf_dir, "documents"), 3, 0.9)


def _held(docs: DataFrame, place: str, maps, want: bool) -> DataFrame:
    """Rows whose ``place`` is in the filter, or those without (null places are not in it)."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        table = _bits(maps.value, FILTER_BITS)
        for b in batches:
            x = b.column(b.schema.get_field_index(place))
            has = _has(table, pc.fill_null(x, 0).to_numpy(zero_copy_only=False), FILTER_BITS) & x.is_valid().to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(has == want))
    return docs.mapInArrow(run, docs.schema)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (five words, similarity 0.8): of those with
    the smallest id the one with the smallest hash.  Rows without an id stay.

    Rows are known by id and a hash of all their columns, so what becomes of one
    text doesn't touch another text of the same id."""
    id_, row = kit.free_name(docs, "id"), kit.free_name(docs, "row")
    key = F.xxhash64(*[f.name for f in docs.schema if "map<" not in f.dataType.simpleString()])
    rows = _grouped(docs, 5, 0.8, key).where("doc_id is not null and comp is not null")
    rows = rows.groupBy("comp", "doc_id", "row").agg(F.count("*").alias("copies")).checkpoint()
    best = rows.groupBy("comp").agg(F.min(F.struct("doc_id", "row", "copies")).alias("best"))
    gone = rows.join(best.hint("merge"), "comp").where("doc_id <> best.doc_id or row <> best.row")
    gone = gone.select(F.col("doc_id").alias(id_), F.col("row").alias(row))
    copies = best.where("best.copies > 1").select(F.col("best.doc_id").alias(id_), F.col("best.row").alias(row))
    keyed = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(row, key)
    # Only rows that a filter of fixed size holds are shuffled; it may hold more than are asked for, never fewer.
    touched = gone.unionAll(copies).checkpoint()
    place = F.xxhash64(id_, row).bitwiseAND((1 << FILTER_BITS) - 1)
    maps = spark.sparkContext.broadcast(_bitmap(touched.select(place.alias("x"))))
    named = kit.free_name(keyed, "place")
    keyed = keyed.withColumn(named, F.when(F.col(id_).isNotNull(), place))
    free, held = (_held(keyed, named, maps, want).drop(named) for want in (False, True))
    out = free.unionByName(held.join(touched.hint("merge"), [id_, row], "left_anti"))
    if not copies.isEmpty():  # copies of a whole row are combined map-side
        out = out.unionByName(held.join(copies.hint("merge"), [id_, row], "left_semi").dropDuplicates([id_, row]))
    return out.select(*docs.columns)


#: The query by its definition: all pairs that share a shingle, and reachability.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
             ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) END AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS root FROM s UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY node)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, component_id FROM s JOIN c ON c.node = s.doc_id
"""
