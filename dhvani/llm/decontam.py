"""Benchmark decontamination by CGK embedding, bit-sampling LSH and edit distance.

The CGK embedding (Chakraborty, Goldenberg and Koucky, 2016) walks over a
sequence: step j emits the word at the pointer and moves the pointer on if a
random bit of (j, word) is 1.  Two sequences of small edit distance fall into
step again after an edit, so their walks differ in few places: edit distance
becomes Hamming distance.  Here the sequence is words, and one walk starts at
each word of a document and at each word of a benchmark item, so a passage is
met wherever an unspoilt stretch of it begins.

Each repetition samples some places of the walk.  The samples are compared one
by one, as a path in a trie of the items' samples: nearly all windows leave it
after one or two, so walking all windows of the corpus costs little more than
hashing its words.  A window that follows a path to its end proposes the
item-sized window at the same offset; it counts if the edit distance (Myers'
bit-parallel recurrence with free ends, over lower-cased characters with white
space collapsed) is at most ``1 - SIMILARITY`` of the item's length.

The items are worked in blocks of ``BLOCK_ITEMS`` rows and ``BLOCK_BYTES`` bytes
(as expected values of a hash partition), each block against all documents, so
what tasks hold is bounded whatever the size of the benchmark.  Documents are
not shuffled.

Besides, each item is cut into one run of words more than a fifth of its words (one
word at least), and a window that holds a whole run proposes its item, too.

Recall: if at most one word in five (one at least) was replaced, dropped or added, one
of the runs is unspoilt, so the passage is always met, whatever the item's length; the
walks meet most of those with more such words.  An item of one word is met as it is.
Measured against brute force in tests/llm.

Cases: null or empty documents and items match nothing; an item of fewer words
than a sample is compared by the words it has; repeated rows are judged alike; a
null doc_id or item_id is kept as null; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

#: Repetitions: the walk is sampled every so many steps, until so many different
#: words have been sampled (a pointer may rest on a word for several samples).
REPETITIONS = ((2, 4), (3, 5), (4, 5))
#: Samples of a walk at most: chances that a path needs more are below 1 in 1000.
LEVELS = 20
#: Least edit similarity of a passage.
SIMILARITY = 0.8
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20
#: Characters whose counts a window is judged by first: no other character's lower case holds
#: them (i and k have such).
COUNTED = "abcdefghjlmnopqrstuvwxyz0123456789"
#: Words whose counts are held at once.
COUNT_WORDS = 1 << 16
#: Bits of the table that a partial path is looked up in first.
TABLE_BITS = 20


def _coin(h: np.ndarray, seed: int) -> np.ndarray:
    """Random bit of (seed, word)."""
    return ((kit.mix(h ^ np.uint64(seed * 0x9E3779B9 + 0x51ED27)) >> np.uint64(17)) & np.uint64(1)).astype(np.int64)


def walk(h: np.ndarray, at: np.ndarray, end: np.ndarray, rep: int):
    """Yields (rows, key, words sampled, inside) at each sampled step of the walks
    from ``at``; send back the rows that go on.  Past ``end`` a walk emits zeros."""
    stride = REPETITIONS[rep][0]
    at, last = at.copy(), np.full(len(at), -1)
    rows, words = np.arange(len(at)), np.zeros(len(at), np.int64)
    key = np.full(len(at), rep + 1, np.uint64)
    for j in range(LEVELS * stride):
        inside = at < end
        word = np.where(inside, h[np.minimum(at, len(h) - 1)], np.uint64(0))
        move = _coin(word, rep * 1000 + j)
        if j % stride == 0:
            key = kit.mix(key ^ word)
            words = words + (inside & (at != last))
            last = at
            keep = yield rows, key, words, inside
            rows, key, at, end, move = rows[keep], key[keep], at[keep], end[keep], move[keep]
            words, last = words[keep], last[keep]
        at = at + move


def run_lengths(offset: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Length of the run that starts at word ``offset`` of an item of ``size`` words, or 0."""
    runs = np.where(size > 1, np.maximum(size // 5, 1) + 1, 1)
    k = -(-offset * runs // size)
    return np.where(k * size // runs == offset, (k + 1) * size // runs - offset, 0)


class Index:
    """Tries of the items' samples, a level for each sample, and the items' runs.

    A path ends where it has sampled the words it needs, or leaves its item (then
    only if it began at the item's first word, for items of few words), or at the
    last level."""

    def __init__(self, items: list[tuple]):
        self.items = [(i, " ".join(t.lower().split())) for i, t in items]
        self.limit = np.array([int((1 - SIMILARITY) * len(t) + 1e-9) for _, t in self.items], np.int64)
        self.counts = [np.array([t.count(c) for _, t in self.items], np.int64) for c in COUNTED]
        w = kit.Words(kit.to_bytes([t for _, t in items], lower=True))
        own = w.owner()
        self.offset = np.arange(len(own)) - w.first[own]
        self.own, self.size = own, np.diff(w.first)
        length, self.runs = run_lengths(self.offset, self.size[own]), []  # by length: (length, table of the keys, keys, first words)
        for n in np.unique(length[length > 0]).tolist():
            key, at = w.grams(n)
            key, at = key[length[at] == n], at[length[at] == n]
            table = np.zeros(1 << TABLE_BITS, bool)
            table[(key & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)] = True
            order = np.argsort(key, kind="stable")
            self.runs.append((n, table, key[order], at[order]))
        self.tries = []  # by repetition: (table of the paths that go on, ends, their words, ended inside) of each level
        for rep, (_, need) in enumerate(REPETITIONS):
            walker, keep, trie = walk(w.hash, np.arange(len(own)), w.first[own + 1], rep), None, []
            before = np.zeros(0, np.uint64)
            for level in range(LEVELS):
                rows, key, words, inside = next(walker) if keep is None else walker.send(keep)
                if level:  # those that have left a short item end one level up
                    out = ~inside & (self.offset[rows] == 0)
                    trie[-1][1].append((before[out], rows[out]))
                done = inside & ((words >= need) | (level == LEVELS - 1))
                keep = np.flatnonzero(inside & ~done)
                table = np.zeros(1 << TABLE_BITS, bool)
                table[(key[keep] & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)] = True
                trie.append((table, [(key[done], rows[done])]))
                before = key[keep]
                if not len(keep):
                    break
            ends = []
            for table, parts in trie:
                key, rows = (np.concatenate(x) for x in zip(*parts))
                order = np.argsort(key, kind="stable")
                ends.append((table, key[order], rows[order]))
            self.tries.append(ends)

    def candidates(self, w: kit.Words):
        """(text, item, word that the item's first word falls on) of the proposed windows, once each."""
        if not len(w.hash) or not len(self.own):
            return np.zeros((0, 3), np.int64)
        own = w.owner()
        end = w.first[own + 1]
        mask = np.uint64((1 << TABLE_BITS) - 1)
        found = []

        def propose(p, key, keys, places, inside=True):
            lo, hi = np.searchsorted(keys, key, "left"), np.searchsorted(keys, key, "right")
            n = np.where(inside, hi - lo, 0)
            hit = np.repeat(np.arange(len(p)), n)
            which = places[np.arange(len(hit)) - np.repeat(np.cumsum(n) - n, n) + lo[hit]]
            p = p[hit]
            found.append(np.column_stack((own[p], self.own[which], p - w.first[own[p]] - self.offset[which])))
        for n, table, keys, places in self.runs:
            key, p = w.grams(n)
            ok = np.flatnonzero(table[(key & mask).astype(np.int64)])
            propose(p[ok], key[ok], keys, places)
        for rep, trie in enumerate(self.tries):
            walker, keep = walk(w.hash, np.arange(len(own)), end, rep), None
            for table, keys, places in trie:
                rows, key, _, inside = next(walker) if keep is None else walker.send(keep)
                if len(keys):
                    propose(rows, key, keys, places, inside)
                keep = np.flatnonzero(inside & table[(key & mask).astype(np.int64)])
                if not len(keep):
                    break
        x = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
        x = x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))]
        new = np.ones(len(x), bool)
        new[1:] = (x[1:] != x[:-1]).any(axis=1)
        return x[new]

    def windows(self, w: kit.Words, found: np.ndarray) -> np.ndarray:
        """(text, item, start, first word, end word) of the candidates whose window has the item's
        characters: an edit supplies one that is missing, so more than the edits that a
        passage may differ in can't be missing."""
        d, i, start = found.T
        size = self.size[i]
        slack = np.maximum(2, size // 4)
        a = np.maximum(w.first[d] + start - slack, w.first[d])
        b = np.minimum(w.first[d] + start + size + slack + slack // 2, w.first[d + 1])
        ok = np.zeros(len(found), bool)
        order = np.argsort(a, kind="stable")
        byte = np.frombuffer(w.buf, np.uint8)
        x = 0
        while x < len(order):
            base = a[order[x]]
            y = int(np.searchsorted(a[order], base + COUNT_WORDS, side="left"))
            at = order[x:y]
            top = b[at].max()
            edge = np.append(w.start[base:top], w.end[top - 1]) - w.start[base] if top > base else np.zeros(1, np.int64)
            part = byte[w.start[base]:w.end[top - 1]] if top > base else byte[:0]
            item, lo, hi = i[at], a[at] - base, b[at] - base
            left = self.limit[item]  # missing characters that a window may still have
            for k, c in enumerate(COUNTED):
                upto = np.searchsorted(np.flatnonzero(part == ord(c)), edge)
                left = left - np.maximum(self.counts[k][item] - (upto[hi] - upto[lo]), 0)
                live = left >= 0
                if 2 * np.count_nonzero(live) < len(live):
                    at, item, lo, hi, left = at[live], item[live], lo[live], hi[live], left[live]
            ok[at[left >= 0]] = True
            x = y
        return np.column_stack((found, a, b))[ok]

    def matches(self, texts: list[str]):
        """(text, item, distance, first word, last word + 1) of the best passage of each pair."""
        w = kit.Words(kit.to_bytes(texts, lower=True))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        done: tuple[int, int, int] = (-1, -1, 0)
        for d, i, start, a, b in self.windows(w, self.candidates(w)).tolist():
            size = int(self.size[i])
            slack = max(2, size // 4)
            if (d, i) == done[:2] and start - done[2] <= slack // 2:
                continue  # the window just verified holds this one
            done = (d, i, start)
            first = int(w.first[d])
            words = [w.buf[w.start[k]:w.end[k]].decode("utf-8", "replace").lower() for k in range(a, b)]
            item = self.items[i][1]
            limit = int(self.limit[i])
            dist, at = nearest(item, " ".join(words))
            if dist <= limit and ((d, i) not in best or dist < best[d, i][0]):
                ends = np.cumsum([len(x) + 1 for x in words])
                stop = a + int(np.searchsorted(ends, at)) + 1
                best[d, i] = (dist, max(a - first, stop - first - size), stop - first)
        return [(d, i, *v) for (d, i), v in best.items()]


def nearest(item: str, text: str) -> tuple[int, int]:
    """(distance, end) of the passage of ``text`` nearest to ``item``: the least edit
    distance over all passages, and where its first one ends."""
    m = len(item)
    if not m:
        return 0, 0
    masks: dict[str, int] = {}
    for k, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << k
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


def item_blocks(benchmark: DataFrame):
    """Lists of (item_id, text) of bounded size; the number of blocks follows the benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length(F.trim("text")) > 0)
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def _frames(frames):
    for f in frames:
        f = f.reset_index(drop=True)
        texts = [t if isinstance(t, str) else "" for t in f["text"]]
        for a, b in kit.chunks(texts, kit.CHUNK_BYTES // 2):
            yield f.iloc[a:b], texts[a:b]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, distance, similarity, first_word, end_word): the best passage
    of each document and item that it holds."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, distance long, similarity double, first_word long, end_word long"
    out = None
    for items in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(frames, shared=shared):
            index = Index(shared.value)
            for f, texts in _frames(frames):
                ids = f["doc_id"].tolist()
                rows = [(None if pd.isna(ids[d]) else int(ids[d]), index.items[i][0], dist,
                         1 - dist / len(index.items[i][1]), a, b) for d, i, dist, a, b in index.matches(texts)]
                got = pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "similarity", "first_word", "end_word"])
                yield got.astype({"doc_id": "Int64", "item_id": "Int64"})
        part = kit.map_texts(docs, run, schema)
        out = part if out is None else out.unionAll(part)
    return out


def op8_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """All passages of ``benchmark`` in ``documents``: a row for each document and item."""
    return contaminated(kit.table(spark, sf_dir, "documents"), kit.table(spark, sf_dir, "benchmark"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark, with all their columns."""
    for items in item_blocks(kit.table(spark, sf_dir, "benchmark")):
        shared = spark.sparkContext.broadcast(items)

        def judge(shared=shared):
            index = Index(shared.value)

            def passes(texts):
                texts = [t if isinstance(t, str) else "" for t in texts]
                mask = np.ones(len(texts), bool)
                for a, b in kit.chunks(texts, kit.CHUNK_BYTES // 2):
                    mask[[a + m[0] for m in index.matches(texts[a:b])]] = False
                return mask
            return passes
        docs = kit.keep_rows(docs, judge)
    return docs
