"""Exact substring dedup with prefix-partitioned suffix trees over words.

A window is ``window`` consecutive words of one document.  A word goes if some
window over it has a word sequence that also starts in a document with a smaller
doc_id.

1.  *Anchors.*  The smallest hash of the 16-word runs inside a window depends on
    its words alone, so a window that occurs in two documents has an anchor that
    does.  One pass gathers the anchors (about one for 18 words), a bitmap of fixed
    size holds those seen in two documents, and only suffixes whose window has such
    an anchor go on.  The bitmap may pass more, never fewer.
2.  *Prefix partition.*  Suffixes are dealt to subtrees by a prefix of variable
    length: the shortest of ``PREFIXES`` words whose bucket, counted over the whole
    corpus, fits ``SUBTREE`` suffixes.  Small buckets share a group.  Suffixes that
    begin with the same window share every prefix, so they meet in one subtree.
3.  *Subtrees.*  A subtree's leaves are sorted by their path of ``window`` words
    (a 64-bit hash of it).  Leaves with the same path hang below one internal node
    of that depth or more: a repeat.  The smallest doc_id below the node keeps it;
    in all other documents the window is marked.
4.  Marked windows are gathered by document, merged into maximal spans, and joined
    with the texts, the only time that texts are shuffled.

Leaves travel packed (key, document, place), one row for each chunk of text and
subtree, so a passage that a third of the documents share costs 12 bytes a
document.  Copies of a text inside one chunk are marked at once.

Cases: null or empty text: no words; a null doc_id is neither smaller nor greater
than another: nothing of it goes and nothing goes for it; rows that repeat an id
are one document, judged by their own texts; fewer words than a window: nothing
goes; other columns are ignored (``stage`` keeps them).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

#: Words of a window.
WINDOW = 50
#: Words of an anchor run.
RUN = 16
#: Bits of the anchors' filter: 8 MB at any size.
FILTER_BITS = 26
#: Lengths of the prefixes that suffixes are dealt by; the last is the whole window.
PREFIXES = (1, 2, 4, 8)
#: Buckets of a prefix length, as bits.
PREFIX_BITS = 13
#: Suffixes of a subtree.
SUBTREE = 1 << 20

_R = np.uint64(0xD1342543DE82EF95)


class Powers:
    """Powers of the odd base of the rolling hash and of its inverse."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            size = 1 << max(16, (n - 1).bit_length())
            up = np.full(size, _R)
            up[0] = 1
            down = np.full(size, np.uint64(pow(int(_R), -1, 1 << 64)))
            down[0] = 1
            self.up, self.down = np.cumprod(up), np.cumprod(down)
        return self.up[:n], self.down[:n]


def run_hashes(h: np.ndarray, n: int, powers: Powers) -> np.ndarray:
    """Hash of the ``n`` words from each place that has as many after it."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    up, down = powers.get(len(h))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up, dtype=np.uint64)))
    return kit.mix((total[n:] - total[:-n]) * down[:len(h) - n + 1])


def sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    """Smallest of each ``n`` neighbours, by doubling."""
    if len(x) < n:
        return x[:0]
    step = 1
    while step * 2 <= n:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    return np.minimum(x[:len(x) - (n - step)], x[n - step:]) if n > step else x


class Chunk:
    """Windows of a chunk of texts: word place, text and window number of each;
    copies of an earlier text (by smaller doc_id) are set aside in ``copies``."""

    def __init__(self, ids: np.ndarray, texts: list[bytes], window: int, powers: Powers):
        self.words = w = kit.Words(texts)
        size = np.diff(w.first)
        self.ids, self.window, self.powers = ids, window, powers
        if len(w.hash):
            place = np.arange(len(w.hash)) - np.repeat(w.first[:-1], size)
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(kit.mix(w.hash ^ kit.mix(place.astype(np.uint64))), dtype=np.uint64)))
        else:
            total = np.zeros(1, np.uint64)
        self.cls = kit.mix((total[w.first[1:]] - total[w.first[:-1]]) ^ size.astype(np.uint64)).view(np.int64)
        order = np.lexsort((ids, self.cls))
        same = np.zeros(len(ids), bool)
        same[order[1:]] = self.cls[order[1:]] == self.cls[order[:-1]]
        head = np.empty(len(ids), np.int64)
        head[order] = ids[order][np.maximum.accumulate(np.where(same[order], 0, np.arange(len(order))))]
        self.copies = np.flatnonzero(same & (ids > head) & (size >= window))
        again = same & (ids == head)  # a repeated row: its twin speaks for it
        live = (size >= window) & ~again
        live[self.copies] = False
        owner = np.repeat(np.arange(len(size)), size)
        left = np.repeat(w.first[1:], size) - np.arange(len(owner))
        self.at = np.flatnonzero(live[owner] & (left >= window)) if len(owner) else np.zeros(0, np.int64)
        self.owner = owner[self.at] if len(owner) else self.at

    def anchors(self) -> np.ndarray:
        """Anchor of each window."""
        runs = run_hashes(self.words.hash, RUN, self.powers)
        return sliding_min(runs, self.window - RUN + 1)[self.at] if len(self.at) else np.zeros(0, np.uint64)

    def prefix(self, n: int, at: np.ndarray) -> np.ndarray:
        return run_hashes(self.words.hash, n, self.powers)[at] if len(at) else np.zeros(0, np.uint64)


def _chunks(frames, window: int):
    powers = Powers()
    for f in frames:
        f = f[f["doc_id"].notna()].reset_index(drop=True)
        ids = f["doc_id"].to_numpy(np.int64)
        texts = kit.to_bytes(f["text"])
        for a, b in kit.chunks(texts):
            yield Chunk(ids[a:b], texts[a:b], window, powers)


def _anchor_rows(window: int, buckets: int):
    """Anchors of a chunk by bucket: those of one document, those of more."""
    def run(frames):
        for c in _chunks(frames, window):
            a = c.anchors()
            new = np.ones(len(a), bool)
            new[1:] = (a[1:] != a[:-1]) | (c.owner[1:] != c.owner[:-1])
            a, o = a[new], c.ids[c.owner[new]]
            order = np.lexsort((o, a))
            a, o = a[order], o[order]
            new = np.ones(len(a), bool)
            new[1:] = a[1:] != a[:-1]
            at = np.flatnonzero(new)
            more = o[np.append(at[1:], len(a)) - 1] != o[at] if len(a) else np.zeros(0, bool)
            a = a[at]
            b = (a >> np.uint64(44)).astype(np.int64) % buckets
            order = np.argsort(b, kind="stable")
            a, b, more = a[order], b[order], more[order]
            where, lo = np.unique(b, return_index=True)
            hi = np.append(lo[1:], len(b))
            yield pd.DataFrame({"bucket": where, "one": [a[x:y][~more[x:y]].tobytes() for x, y in zip(lo, hi)],
                                "more": [a[x:y][more[x:y]].tobytes() for x, y in zip(lo, hi)]})
    return run


def _repeated(f: pd.DataFrame) -> pd.DataFrame:
    """Places in the filter of the bucket's anchors that stand in two documents."""
    one = np.concatenate([np.frombuffer(b"".join(f["one"]), np.uint64), np.repeat(np.frombuffer(b"".join(f["more"]), np.uint64), 2)])
    one.sort()
    a = np.unique(one[1:][one[1:] == one[:-1]]) & np.uint64((1 << FILTER_BITS) - 1)
    return pd.DataFrame({"x": np.unique(a).astype(np.int64)})


def repeated_anchors(docs: DataFrame, window: int) -> list[tuple[int, bytes]]:
    """The filter: 2^(FILTER_BITS - 15) bitmaps of 4 KB at most."""
    n = 2 * max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    rows = kit.map_texts(docs, _anchor_rows(window, n), "bucket long, one binary, more binary")
    places = rows.groupBy("bucket").applyInPandas(_repeated, "x long")
    maps = (places.select(F.shiftright("x", 15).alias("k"), F.col("x").bitwiseAND((1 << 15) - 1).alias("p"))
            .groupBy("k").agg(F.expr("bitmap_construct_agg(p)").alias("bits")).collect())
    return [(r["k"], bytes(r["bits"])) for r in maps]


class Filter:
    def __init__(self, maps):
        self.table = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
        for k, b in maps:
            self.table[k << 12:(k + 1) << 12] = np.frombuffer(b, np.uint8)

    def has(self, x: np.ndarray) -> np.ndarray:
        x = x & np.uint64((1 << FILTER_BITS) - 1)
        return (self.table[(x >> np.uint64(3)).astype(np.int64)] >> (x & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _counts(window: int, maps):
    """Suffixes that go on, by prefix length and bucket."""
    def run(frames):
        filt = Filter(maps.value)
        total = np.zeros((len(PREFIXES) + 1, 1 << PREFIX_BITS), np.int64)
        for c in _chunks(frames, window):
            at = c.at[filt.has(c.anchors())]
            for k, n in enumerate((*PREFIXES, window)):
                total[k] += np.bincount(_bucket(c.prefix(n, at)), minlength=1 << PREFIX_BITS)
        k, b = np.nonzero(total)
        yield pd.DataFrame({"k": k, "b": b, "n": total[k, b]})
    return run


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - PREFIX_BITS)).astype(np.int64)


def partition(counts: list[tuple[int, int, int]], subtree: int) -> np.ndarray:
    """group[k, b]: the subtree of suffixes whose prefix of length k has bucket b,
    -1 where the bucket is too large and a longer prefix decides."""
    total = np.zeros((len(PREFIXES) + 1, 1 << PREFIX_BITS), np.int64)
    for k, b, n in counts:
        total[k, b] = n
    group = np.full(total.shape, -1, np.int64)
    g = filled = 0
    for k in range(len(total)):
        for b in np.flatnonzero(total[k]).tolist():
            n = total[k, b]
            if n > subtree and k < len(total) - 1:
                continue
            if filled and filled + n > subtree:
                g, filled = g + 1, 0
            group[k, b] = g
            filled += n
    return group


def _leaves(window: int, maps, group):
    """Leaves of a chunk, packed by subtree; copies inside the chunk as marks."""
    def run(frames):
        filt, table = Filter(maps.value), group.value
        for c in _chunks(frames, window):
            ok = filt.has(c.anchors())
            at, own = c.at[ok], c.owner[ok]
            key = c.prefix(window, at)
            g = np.full(len(at), -1)
            for k, n in enumerate((*PREFIXES, window)):
                open_ = np.flatnonzero(g < 0)
                if len(open_):
                    g[open_] = table[k, _bucket(c.prefix(n, at[open_]) if k < len(PREFIXES) else key[open_])]
            order = np.argsort(g, kind="stable")
            g, key, own = g[order], key[order], own[order]
            place = (at[order] - c.words.first[own]).astype(np.int32)
            where, lo = np.unique(g, return_index=True)
            hi = np.append(lo[1:], len(g))
            rows = [(int(q), key[x:y].tobytes(), *_docs(c, own[x:y]), place[x:y].tobytes()) for q, x, y in zip(where, lo, hi)]
            if len(c.copies):
                # A whole text that a smaller document has: a mark for each window end to end.
                size = np.diff(c.words.first)[c.copies]
                step = [np.unique(np.append(np.arange(0, s - window, window), s - window)) for s in size]
                own = np.repeat(c.copies, [len(x) for x in step])
                rows.append((-1, b"", *_docs(c, own), np.concatenate(step).astype(np.int32).tobytes()))
            yield pd.DataFrame(rows, columns=["g", "key", "ids", "cls", "own", "place"])
    return run


def _docs(c: Chunk, own: np.ndarray):
    """(ids, classes, index into them of each leaf) as bytes."""
    used, index = np.unique(own, return_inverse=True)
    return c.ids[used].tobytes(), c.cls[used].tobytes(), index.astype(np.int32).tobytes()


def _unpack(f: pd.DataFrame):
    ids, cls = np.frombuffer(b"".join(f["ids"]), np.int64), np.frombuffer(b"".join(f["cls"]), np.int64)
    base = np.concatenate(([0], np.cumsum([len(b) // 8 for b in f["ids"]])))
    own = np.concatenate([np.frombuffer(b, np.int32).astype(np.int64) + base[i] for i, b in enumerate(f["own"])])
    return ids, cls, own, np.frombuffer(b"".join(f["place"]), np.int32)


def _repeats(buckets: int):
    """Leaves below a deep node with a smaller document, packed by document bucket."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        ids, cls, own, place = _unpack(f)
        if f["g"].iloc[0] >= 0:
            key = np.frombuffer(b"".join(f["key"]), np.uint64)
            doc = ids[own]
            order = np.lexsort((doc, key))
            k, d = key[order], doc[order]
            new = np.ones(len(k), bool)
            new[1:] = k[1:] != k[:-1]
            low = d[np.flatnonzero(new)][np.cumsum(new) - 1]
            keep = order[d > low]
            own, place = own[keep], place[keep]
        b = (kit.mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)[own]
        order = np.lexsort((place, own, b))
        b, own, place = b[order], own[order], place[order]
        where, lo = np.unique(b, return_index=True)
        hi = np.append(lo[1:], len(b))
        rows = []
        for q, x, y in zip(where, lo, hi):
            used, index = np.unique(own[x:y], return_inverse=True)
            rows.append((int(q), ids[used].tobytes(), cls[used].tobytes(), index.astype(np.int32).tobytes(), place[x:y].tobytes()))
        return pd.DataFrame(rows, columns=["b", "ids", "cls", "own", "place"])
    return run


def _spans(window: int):
    """Marked windows of a bucket's documents, merged into maximal spans."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        ids, cls, own, place = _unpack(f)
        doc, c = ids[own], cls[own]
        order = np.lexsort((place, c, doc))
        doc, c, place = doc[order], c[order], place[order].astype(np.int64)
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (c[1:] != c[:-1])
        gap = new.copy()
        gap[1:] |= place[1:] > place[:-1] + window
        at = np.flatnonzero(gap)
        start, end = place[at], place[np.append(at[1:], len(place)) - 1] + window
        cut = np.flatnonzero(new[at])
        hi = np.append(cut[1:], len(at))
        return pd.DataFrame({"doc_id": doc[at[cut]], "cls": c[at[cut]],
                             "spans": [np.column_stack((start[x:y], end[x:y])).ravel().tolist() for x, y in zip(cut, hi)]})
    return run


def repeats(docs: DataFrame, window: int = WINDOW, subtree: int = SUBTREE) -> DataFrame:
    """(doc_id, cls, spans): the word ranges [start, end, start, end, ...] of each
    document that go; cls is the hash of the text's word sequence."""
    spark = docs.sparkSession
    if window < RUN:
        raise ValueError(f"a window has {RUN} words at least")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    maps = spark.sparkContext.broadcast(repeated_anchors(docs, window))
    counts = kit.map_texts(docs, _counts(window, maps), "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n"))
    group = spark.sparkContext.broadcast(partition([tuple(r) for r in counts.collect()], subtree))
    leaves = kit.map_texts(docs, _leaves(window, maps, group), "g long, key binary, ids binary, cls binary, own binary, place binary")
    n = 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    # Marks of copies need no subtree: they are dealt freely.
    dealt = leaves.groupBy("g", F.when(F.col("g") < 0, F.pmod(F.xxhash64("ids"), F.lit(n))).otherwise(0).alias("free"))
    marks = dealt.applyInPandas(_repeats(n), "b long, ids binary, cls binary, own binary, place binary")
    return marks.groupBy("b").applyInPandas(_spans(window), "doc_id long, cls long, spans array<long>")


def judged(docs: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """``docs`` with the list ``name`` of (cls, spans) of its id (null: none)."""
    key = kit.free_name(docs, "_id")
    per_id = spans.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("cls", "spans")).alias(name))
    return docs.join(per_id, docs["doc_id"].cast("long") == per_id[key], "left").drop(key)


def _own_spans(texts: list[str | None], lists, window: int, powers: Powers):
    """(first row, byte texts, words, spans of each text) in chunks."""
    data = kit.to_bytes(texts)
    for a, b in kit.chunks(data):
        c = Chunk(np.arange(b - a), data[a:b], window, powers)
        found = []
        for key, given in zip(c.cls.tolist(), lists[a:b]):
            mine = [s["spans"] for s in given if s["cls"] == key] if given is not None else []
            found.append(np.asarray(mine[0], np.int64).reshape(-1, 2).tolist() if mine else [])
        yield a, data[a:b], c.words, found


def _digest(window: int):
    def run(frames):
        powers = Powers()
        for f in frames:
            rows = []
            for _, texts, _, found in _own_spans(f["text"].tolist(), f["_spans"].tolist(), window, powers):
                for t, spans in zip(texts, found):
                    words = t.split()
                    kept, last = [], 0
                    for s, e in spans:
                        kept += words[last:s]
                        last = e
                    kept += words[last:]
                    rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            out = pd.DataFrame(rows, columns=["n_words", "n_removed", "kept_sha256"])
            out.insert(0, "doc_id", f["doc_id"].astype("Int64").array)
            yield out
    return run


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """50-word windows over all documents."""
    docs = kit.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return kit.map_texts(judged(docs, repeats(docs), "_spans"), _digest(WINDOW), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with repeated words cut out of their texts; a text that nothing
    goes from stays as it is, one that all goes from becomes empty.  n_chars follows."""
    schema, name = docs.schema, kit.free_name(docs, "_spans")

    def run(batches):
        import pyarrow as pa

        powers = Powers()
        for batch in batches:
            text = batch.column("text").to_pylist()
            cut: dict[int, str] = {}
            for first_row, texts, w, found in _own_spans(text, batch.column(name).to_pylist(), WINDOW, powers):
                for i, spans in enumerate(found):
                    if not spans:
                        continue
                    t, base, first = texts[i], w.base[i], w.first[i]
                    n, out, last = w.first[i + 1] - first, [], 0
                    for s, e in spans:
                        out.append(t[last:w.start[first + s] - base])
                        last = w.start[first + e] - base if e < n else len(t)
                    cut[first_row + i] = (b"".join(out) + t[last:]).decode("utf-8", "surrogatepass")
            columns = {}
            for c in schema.names:
                values = batch.column(c)
                if cut and c in ("text", "n_chars"):
                    old = values.to_pylist()
                    for i, t in cut.items():
                        old[i] = t if c == "text" else len(t)
                    values = pa.array(old, values.type)
                columns[c] = values
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    return judged(docs, repeats(docs), name).mapInArrow(run, schema)


#: The query by its definition: every window of every document.
SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM d WHERE len(w) >= 50),
x AS (SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h FROM k),
m AS (SELECT h, min(doc_id) AS low FROM x GROUP BY h),
g AS (SELECT DISTINCT x.doc_id, x.p + o.i AS spot FROM x JOIN m USING (h), (SELECT unnest(range(50)) AS i) o WHERE m.low < x.doc_id),
r AS (SELECT doc_id, list(spot) AS gone, count(*) AS n FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN r.n IS NULL THEN w ELSE list_filter(w, lambda v, i: NOT list_contains(r.gone, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN r USING (doc_id)
"""
