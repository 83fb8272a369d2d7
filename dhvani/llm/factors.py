"""Exact substring dedup with longest-previous-factor arrays over bytes.

The places of a corpus are ordered by (doc_id, byte).  LPF[i] is the length of the longest
string at place i that also begins at an earlier place; a byte goes if it lies in a string
of ``length`` bytes at a place with LPF >= ``length``, so the first copy stays.  Only the suffixes
that can share ``length`` bytes have to meet, cut off at that length:

1.  *Anchors.*  Of the 16-byte grams of a window of ``length`` bytes, the one with the
    smallest hash is its anchor; grams that are very common in the corpus come last, as
    told by a counter array of fixed size.  Equal windows have equal anchors.  Windows that
    follow each other mostly share theirs (about 43 do) and are a *segment* of about 142 bytes.
2.  *Candidates.*  The anchors' hashes meet in groups, which tell the documents which of their
    segments have an anchor that occurs again.  Only those segments' bytes are sent, to the
    groups of their anchors.
3.  *Suffix order.*  A group's suffixes at the anchors are sorted by their bytes, with
    their common prefixes.  The suffixes one byte before are induced from that: a stable
    sort by that byte, and a common prefix one longer than the least between.  So
    it goes to the windows that begin furthest before their anchors.
4.  *LPF.*  In each of these orders the previous and the next smaller place are found by
    doubling jumps that carry the least common prefix on the way; the greater of the two
    is LPF.  Jumps end where it falls below ``length``.
5.  The windows found, as byte ranges, are gathered by document, merged, and joined
    with the texts.

Steps 3 and 4 also run before each shuffle, over the segments of ``FLUSH`` bytes of text: a
segment all of whose windows occur earlier there has been judged and isn't sent.  So a
passage that a third of the documents share is sent once for each ``FLUSH`` bytes, and its
common grams go through ``SALTS`` groups first, of which each passes on what is new
to it.  A phrase that is common in different contexts is seldom an anchor, because
common grams come last.  The texts are shuffled once, for the join with the candidates and the
one with the ranges.

Cases: null or empty text: no bytes; fewer than ``length`` bytes: nothing goes; a null doc_id
comes after all others; rows that repeat a doc_id are one document whose texts all begin
at byte 0: equal rows have equal results; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kit

#: Bytes of a string that counts as a copy.
LENGTH = 100
#: Bytes of a gram.
GRAM = 16
#: Bytes of text whose segments are looked at together before they are sent.
FLUSH = 4 * kit.CHUNK_BYTES
#: Bytes of segments in a group (as an expected value).
GROUP = 1 << 24
#: Counters of grams, as bits, and how many times the mean makes a counter's grams common ones.
COUNTER_BITS = 18
COMMON = 16
#: Groups that a common gram's segments go through first.
SALTS = 16

_PLACE = np.uint64((1 << 21) - 1)
_HASH = ~_PLACE & np.uint64((1 << 63) - 1)


def grams(buf: bytes) -> np.ndarray:
    """Hash of the gram at each place of ``buf``."""
    n = len(buf) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.ndarray((n + 8,), "<u8", buffer=buf, strides=(1,))
    return kit.mix(kit.mix(eight[:n].copy()) ^ eight[8:])


def pieces(texts: list[bytes], length: int):
    """Lists of (text number, offset, bytes) of ``kit.CHUNK_BYTES`` or so.  A long text is cut so that each
    string of ``length`` bytes begins in one piece."""
    out, size = [], 0
    for k, t in enumerate(texts):
        for at in range(0, max(len(t) - length + 1, 0), kit.CHUNK_BYTES):
            piece = t[at:at + kit.CHUNK_BYTES + length - 1]
            if out and size + len(piece) > kit.CHUNK_BYTES:
                yield out
                out, size = [], 0
            out.append((k, at, piece))
            size += len(piece)
    if out:
        yield out


def segments(part: list, length: int, common: np.ndarray | None):
    """(bytes, columns) of the pieces ``part``: own, the text; place, the anchor in it; begin and at, the
    first window and the anchor in the bytes; lo and hi, the least and greatest distance from a window's
    begin to the anchor; hash, of the anchor; hot, whether it is a common gram."""
    buf = b"".join(p[2] for p in part)
    size = np.array([len(p[2]) for p in part])
    end = np.cumsum(size)
    h = grams(buf)
    key = (h & _HASH) | np.arange(len(h), dtype=np.uint64)
    if common is not None:
        key |= common[(h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(63)
    window, width = length - GRAM + 1, 1
    while 2 * width <= window:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < window:
        key = np.minimum(key[:width - window], key[window - width:])
    whole = np.ones(len(key), bool)  # windows of one piece
    for e in end[:-1].tolist():
        whole[max(e - length + 1, 0):e] = False
    first = np.ones(len(key), bool)
    first[1:] = (key[1:] != key[:-1]) | ~whole[:-1]
    begin = np.flatnonzero(first & whole)
    stop = np.append(begin[1:], len(key))
    cut = np.append(np.flatnonzero(~whole), len(key))  # a run ends where windows cross a border
    stop = np.minimum(stop, cut[np.searchsorted(cut, begin)])
    at = (key[begin] & _PLACE).astype(np.int64)
    piece = np.searchsorted(end, begin, side="right")
    own, offset = np.array([p[0] for p in part]), np.array([p[1] for p in part])
    return np.frombuffer(buf, np.uint8), {
        "own": own[piece], "place": at - (end - size)[piece] + offset[piece], "begin": begin, "at": at,
        "lo": at - (stop - 1), "hi": at - begin, "hash": h[at], "hot": (key[begin] >> np.uint64(63)).astype(bool)}


def least(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of ``values[a:b]`` for each pair (a < b)."""
    out = values[a]
    wide = np.flatnonzero(b - a > 1)
    if len(wide):
        at = np.column_stack((a[wide], b[wide])).ravel()
        out[wide] = np.minimum.reduceat(np.append(values, np.iinfo(values.dtype).max), at)[::2]
    return out


def smaller(place: np.ndarray, common: np.ndarray, length: int) -> np.ndarray:
    """Common prefix with the previous smaller place in this order, 0 if shorter than ``length``;
    ``common[i]`` is that of i - 1 and i."""
    to, got = np.arange(len(place)) - 1, common.copy()
    go = np.flatnonzero((got >= length) & (place[to] >= place))
    while len(go):
        via = to[go]
        got[go], to[go] = np.minimum(got[go], got[via]), to[via]
        go = go[(got[go] >= length) & (place[to[go]] >= place[go])]
    got[got < length] = 0
    return got


def factors(data: np.ndarray, at: np.ndarray, lo: np.ndarray, hi: np.ndarray, place: np.ndarray, length: int) -> np.ndarray:
    """LPF, where it is ``length``, of the windows of segments, as a table of flags: row s, column o tells of
    the window that begins o bytes before the anchor ``at[s]``.  ``place`` orders the anchors."""
    wide = length - GRAM + 1
    out = np.zeros((len(at), wide), bool)
    if len(at) < 2:
        return out
    # Suffixes at the anchors, in byte order; of those that end within the segment shorter ones first.
    known = length - lo
    order = np.argsort(known, kind="stable")
    rows = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(length, np.uint8)), length)[at[order]]
    rows[np.arange(length) >= known[order][:, None]] = 0
    by = np.argsort(rows.view(f"S{length}").ravel(), kind="stable")
    order, rows = order[by], rows[by]
    differ = rows[1:] != rows[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    lcp = np.append(0, np.minimum(lcp, np.minimum(known[order[1:]], known[order[:-1]])))
    group = np.zeros(len(at), np.int64)
    group[order] = np.cumsum(lcp < GRAM)
    del rows, differ
    for o in range(wide):
        if o:
            stay = np.flatnonzero(hi[order] >= o)
            key = (group[order[stay]] << 8) | data[at[order[stay]] - o]
            by = np.argsort(key, kind="stable")
            new, key = stay[by], key[by]
            together = np.flatnonzero(key[1:] == key[:-1]) + 1
            after = np.zeros(len(new), lcp.dtype)
            after[together] = 1 + least(lcp, new[together - 1] + 1, new[together] + 1)
            order, lcp = order[new], after
        # Left and anchor must agree with a neighbour, or no window further left has a copy.
        near = np.maximum(lcp, np.append(lcp[1:], 0))
        stay = np.flatnonzero(near >= GRAM + o)
        if not len(stay):
            break
        if len(stay) < len(order):
            gap = np.append(0, least(lcp, stay[:-1] + 1, stay[1:] + 1)) if len(stay) > 1 else np.zeros(1, lcp.dtype)
            order, lcp = order[stay], gap
        rank = place[order]
        before = smaller(rank, lcp, length)
        behind = smaller(rank[::-1], np.append(0, lcp[:0:-1]), length)[::-1]
        found = np.maximum(before, behind) >= length
        out[order[found], o] = True
    spot = np.arange(wide)
    out &= (spot >= lo[:, None]) & (spot <= hi[:, None])
    return out


class Segments:
    """Segments of texts, each known by the columns id, none (no id) and cls."""

    def __init__(self, id, none, cls, place, lo, hi, hash, hot, size, data):
        self.id, self.none, self.cls, self.place, self.lo, self.hi = id, none, cls, place, lo, hi
        self.hash, self.hot, self.size, self.data = hash, hot, size, data
        self.begin = np.cumsum(size, dtype=np.int64) - size

    COLUMNS = (("id", "<i8"), ("none", "?"), ("cls", "<i8"), ("place", "<i8"), ("lo", "u1"), ("hi", "u1"), ("hash", "<u8"), ("hot", "?"), ("size", "<u2"))

    def take(self, at: np.ndarray) -> Segments:
        columns = [getattr(self, c)[at] for c, _ in self.COLUMNS]
        size = columns[-1].astype(np.int64)
        spot = np.arange(int(size.sum()), dtype=np.int32)
        spot += np.repeat((self.begin[at] - (np.cumsum(size) - size)).astype(np.int32), size)
        return Segments(*columns, self.data[spot])

    def pack(self) -> bytes:
        import pyarrow as pa

        head = b"".join(np.ascontiguousarray(getattr(self, c)).astype(t).tobytes() for c, t in self.COLUMNS)
        raw = len(self.id).to_bytes(8, "little") + head + self.data.tobytes()
        return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)

    @classmethod
    def unpack(cls, blobs) -> Segments:
        import pyarrow as pa

        lists: list[list] = [[] for _ in range(len(cls.COLUMNS) + 1)]
        for b in blobs:
            raw = pa.decompress(b[8:], int.from_bytes(b[:8], "little"), codec="zstd", asbytes=True)
            n, at = int.from_bytes(raw[:8], "little"), 8
            for parts, (_, t) in zip(lists, cls.COLUMNS):
                parts.append(np.frombuffer(raw, t, n, at))
                at += n * np.dtype(t).itemsize
            lists[-1].append(np.frombuffer(raw, np.uint8, offset=at))
        return cls(*(np.concatenate(parts) for parts in lists))

    def judged(self, length: int) -> tuple[pd.DataFrame, np.ndarray]:
        """Byte ranges (id, none, cls, start, stop) with an earlier copy among these segments, and the
        segments that have a window without one."""
        _, which, n = np.unique(self.hash, return_inverse=True, return_counts=True)
        some = np.flatnonzero(n[which] > 1)
        left = np.ones(len(self.id), bool)
        left[some] = False
        # By place; segments of repeated rows once.
        some = some[np.lexsort([getattr(self, c)[some] for c in ("lo", "cls", "place", "id", "none")])]
        new, other = np.zeros(len(some), bool), np.ones(len(some), bool)
        for c in ("place", "id", "none"):
            new[1:] |= getattr(self, c)[some[1:]] != getattr(self, c)[some[:-1]]
        other[1:] = new[1:] | (self.cls[some[1:]] != self.cls[some[:-1]]) | (self.lo[some[1:]] != self.lo[some[:-1]])
        some, rank = some[other], np.cumsum(new)[other]
        part = self.take(some)
        lo, hi = part.lo.astype(np.int64), part.hi.astype(np.int64)
        flags = factors(part.data, part.begin + hi, lo, hi, rank, length)
        left[some] = flags.sum(axis=1) < hi - lo + 1
        edge = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
        edge[:, 1:-1] = flags
        s, near = np.nonzero(np.diff(edge, axis=1) == 1)
        _, far = np.nonzero(np.diff(edge, axis=1) == -1)
        spans = pd.DataFrame({"id": part.id[s], "none": part.none[s], "cls": part.cls[s], "start": part.place[s] - (far - 1), "stop": part.place[s] - near + length})
        return spans, np.flatnonzero(left)


SENT = "g long, salt int, data binary"


def sent_spans(spans: pd.DataFrame, groups: int) -> pd.DataFrame:
    """Ranges in rows by a hash of their text: g below zero marks them."""
    if not len(spans):
        return pd.DataFrame({"g": np.zeros(0, np.int64), "salt": np.zeros(0, np.int32), "data": np.zeros(0, object)})
    g = (spans["cls"].to_numpy().astype(np.uint64) % np.uint64(groups)).astype(np.int64)
    order = np.argsort(g, kind="stable")
    cut = np.flatnonzero(np.append(True, g[order][1:] != g[order][:-1]))
    rows = []
    for x, y in zip(cut, np.append(cut[1:], len(order))):
        part = spans.iloc[order[x:y]]
        rows.append(b"".join(part[c].to_numpy().astype(t).tobytes() for c, t in SPAN))
    return pd.DataFrame({"g": -1 - g[order[cut]], "salt": np.zeros(len(cut), np.int32), "data": rows})


SPAN = (("id", "<i8"), ("none", "?"), ("cls", "<i8"), ("start", "<i8"), ("stop", "<i8"))


def read_spans(blobs) -> pd.DataFrame:
    out = []
    for b in blobs:
        n, at, columns = len(b) // 33, 0, {}
        for c, t in SPAN:
            columns[c] = np.frombuffer(b, t, n, at)
            at += n * np.dtype(t).itemsize
        out.append(pd.DataFrame(columns))
    return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, t) for c, t in SPAN})


def sent(segs: Segments, at: np.ndarray, groups: int, salt: int) -> pd.DataFrame:
    """The segments ``at`` in rows by the group of their anchor; those of common grams by ``salt`` too, if it isn't 0."""
    hot = segs.hot[at] if salt else np.zeros(len(at), bool)
    g = (segs.hash[at] % np.uint64(groups)).astype(np.int64) * 2 + hot
    order = np.argsort(g, kind="stable")
    cut = np.flatnonzero(np.append(True, g[order][1:] != g[order][:-1])) if len(order) else order
    rows = [segs.take(at[order[x:y]]).pack() for x, y in zip(cut, np.append(cut[1:], len(order)))]
    first = g[order[cut]]
    return pd.DataFrame({"g": first // 2, "salt": (first % 2 * salt).astype(np.int32), "data": np.array(rows, object)})


def asked(segs: Segments, at: np.ndarray, groups: int) -> tuple[pd.DataFrame, pd.DataFrame]:
    """Of the segments ``at``: the places (as ranges that stop at -1) of those whose anchors occur twice among
    them, and rows that ask about the others, by the group of the hash: hash, text and place, and the
    texts.  A hash that occurs twice is in the rows once, without a text."""
    _, first, which, n = np.unique(segs.hash[at], return_index=True, return_inverse=True, return_counts=True)
    twice = at[n[which] > 1]
    known = pd.DataFrame({"id": segs.id[twice], "none": segs.none[twice], "cls": segs.cls[twice], "start": segs.place[twice], "stop": np.full(len(twice), -1)})
    at, witness = at[first], n > 1
    g = (segs.hash[at] % np.uint64(groups)).astype(np.int64)
    order = np.lexsort((segs.cls[at], segs.id[at], g))
    at, witness, g = at[order], witness[order], g[order]
    cut = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else g
    rows = [packed(segs, at[x:y], witness[x:y]) for x, y in zip(cut, np.append(cut[1:], len(g)))]
    return known, pd.DataFrame({"g": g[cut], "salt": np.zeros(len(cut), np.int32), "data": np.array(rows, object)})


def packed(segs: Segments, at: np.ndarray, witness: np.ndarray) -> bytes:
    """Hashes, text numbers (-1: none) and places of the segments ``at``, ordered by text, and a table of the texts."""
    import pyarrow as pa

    own = at[~witness]
    keys = [getattr(segs, c)[own] for c in ("id", "none", "cls")]
    new = np.ones(len(own), bool)
    new[1:] = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])
    text = np.full(len(at), -1, "<i4")
    text[~witness] = np.cumsum(new) - 1
    parts = [segs.hash[at].astype("<u8"), text, segs.place[at].astype("<i8"), *(k[new].astype(t) for k, t in zip(keys, ("<i8", "?", "<i8")))]
    raw = len(at).to_bytes(8, "little") + b"".join(x.tobytes() for x in parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpacked(blob: bytes):
    """(hash, text number, place, id, none, cls) of ``packed``."""
    import pyarrow as pa

    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    m, out, at = (len(raw) - 8 - 20 * n) // 17, [], 8
    for t, k in (("<u8", n), ("<i4", n), ("<i8", n), ("<i8", m), ("?", m), ("<i8", m)):
        out.append(np.frombuffer(raw, t, k, at))
        at += k * np.dtype(t).itemsize
    return out


class Flush:
    """Segments of the texts of a task, gathered until they are of ``FLUSH`` bytes of text."""

    def __init__(self, length: int, common: np.ndarray):
        self.length, self.common, self.held, self.size = length, common, [], 0

    def add(self, f: pd.DataFrame):
        """Full flushes of the frame's texts (id, none, cls, text), those with ``places`` by these anchors only."""
        id, none, cls = f["id"].to_numpy(np.int64), f["none"].to_numpy(bool), f["cls"].to_numpy(np.int64)
        for part in pieces(kit.to_bytes(f["text"].tolist()), self.length):
            buf, columns = segments(part, self.length, self.common)
            if "places" in f:
                keep = np.zeros(len(columns["own"]), bool)
                cut = np.searchsorted(columns["own"], [p[0] for p in part] + [part[-1][0] + 1])
                for (k, _, _), x, y in zip(part, cut, cut[1:]):
                    for places in f["places"].iat[k]:
                        keep[x:y] |= np.isin(columns["place"][x:y], places)
                columns = {c: v[keep] for c, v in columns.items()}
            own = columns.pop("own")
            self.held.append((buf, columns | {"id": id[own], "none": none[own], "cls": cls[own]}))
            self.size += len(buf)
            if self.size >= FLUSH:
                yield self.end()

    def end(self) -> Segments:
        bufs, parts = zip(*self.held)
        self.held, self.size = [], 0
        shift = np.cumsum([0, *map(len, bufs)])[:-1]
        columns = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}
        columns["size"] = columns["hi"] - columns["lo"] + self.length
        out = Segments(*(columns[c] for c, _ in Segments.COLUMNS), np.concatenate(bufs))
        out.begin = np.concatenate([p["begin"] + s for p, s in zip(parts, shift)])
        return out

    def all(self, frames):
        for f in frames:
            yield from self.add(f)
        if self.held:
            yield self.end()


def _candidates(length: int, groups: int, common):
    """What a flush finds by itself, and the questions that it has."""
    def run(frames):
        for segs in Flush(length, common.value).all(frames):
            spans, left = segs.judged(length)
            known, rows = asked(segs, left, groups)
            yield sent_spans(pd.concat([spans, known]), groups)
            yield rows
    return run


def _answered(groups: int):
    """Places of the segments whose anchors occur twice."""
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            return f
        parts = [unpacked(b) for b in f["data"]]
        shift = np.cumsum([0, *(len(p[3]) for p in parts)])
        hash, place = (np.concatenate([p[k] for p in parts]) for k in (0, 2))
        id, none, cls = (np.concatenate([p[k] for p in parts]) for k in (3, 4, 5))
        text = np.concatenate([np.where(p[1] < 0, -1, p[1] + s) for p, s in zip(parts, shift)])
        _, which, n = np.unique(hash, return_inverse=True, return_counts=True)
        some = np.flatnonzero((n[which] > 1) & (text >= 0))
        t = text[some]
        return sent_spans(pd.DataFrame({"id": id[t], "none": none[t], "cls": cls[t], "start": place[some], "stop": np.full(len(some), -1)}), groups)
    return run


def _sent(length: int, groups: int, common):
    def run(frames):
        for segs in Flush(length, common.value).all(f[f["places"].notna()] for f in frames):
            if len(segs.id):
                spans, left = segs.judged(length)
                yield sent_spans(spans, groups)
                yield sent(segs, left, groups, 1 + int(segs.hash[0] % np.uint64(SALTS)))
    return run


def _judged(length: int, groups: int):
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        g, salt = key
        if g < 0:
            return f
        segs = Segments.unpack(f["data"])
        spans, left = segs.judged(length)
        out = [sent_spans(spans, groups)]
        if salt:
            out.append(sent(segs, left, groups, 0))
        return pd.concat(out)
    return run


def _gathered(length: int):
    """Disjoint ranges of each text, in order, and the places of its candidates."""
    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            spans = read_spans(f["data"])
        else:
            spans, _ = Segments.unpack(f["data"]).judged(length)
        if not len(spans):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "none": np.zeros(0, bool), "cls": np.zeros(0, np.int64),
                                 "spans": np.zeros(0, object), "places": np.zeros(0, object)})
        id, none, cls, start, stop = (spans[c].to_numpy() for c, _ in SPAN)
        order = np.lexsort((start, cls, none, id))
        id, none, cls, start, stop = (c[order] for c in (id, none, cls, start, stop))
        first = np.append(True, (id[1:] != id[:-1]) | (none[1:] != none[:-1]) | (cls[1:] != cls[:-1]))
        text, texts = np.cumsum(first) - 1, int(first.sum())
        place = stop < 0
        places = np.split(start[place], np.searchsorted(text[place], np.arange(1, texts)))
        t, start, stop = text[~place], start[~place], stop[~place]
        ranges: list = [np.zeros(0, np.int64)] * texts
        if len(t):
            far = np.maximum.accumulate((t << 40) + stop)  # each text in a stretch of its own
            new = np.flatnonzero(np.append(True, (t[1:] << 40) + start[1:] > far[:-1]))
            stop = far[np.append(new[1:], len(far)) - 1] - (t[new] << 40)
            ranges = np.split(np.column_stack((start[new], stop)).ravel(), 2 * np.searchsorted(t[new], np.arange(1, texts)))
        return pd.DataFrame({"id": id[first], "none": none[first], "cls": cls[first], "spans": ranges, "places": places})
    return run


def _counted(length: int):
    def run(frames):
        total = np.zeros(1 << COUNTER_BITS, np.int64)
        size = 0
        for f in frames:
            for part in pieces(kit.to_bytes(f["text"].tolist()), length):
                for _, _, piece in part:
                    size += len(piece)
                h = np.concatenate([grams(p[2]) for p in part])
                total += np.bincount((h >> np.uint64(64 - COUNTER_BITS)).astype(np.int64), minlength=len(total))
        some = np.flatnonzero(total)
        yield pd.DataFrame({"k": np.append(some, -1), "n": np.append(total[some], size)})
    return run


def keyed(docs: DataFrame) -> DataFrame:
    """(id, none, cls, text): the doc_id, zero where there is none, and a hash of the text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("id"), "text")
    none = F.col("id").isNull()
    return docs.select(F.coalesce("id", F.lit(0).cast("long")).alias("id"), none.alias("none"), F.xxhash64("text").alias("cls"), "text")


FOUND = "id long, none boolean, cls long, spans array<long>, places array<long>"
KEY = ["id", "none", "cls"]


def repeats(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(id, none, cls, spans) of the ``keyed`` texts, in one row or more for a text: byte ranges start, stop, start, stop ..."""
    if length < GRAM or length > 255:
        raise ValueError(f"a string has {GRAM} to 255 bytes")
    spark = texts.sparkSession
    long = texts.where(F.octet_length("text") >= length)
    counts = kit.map_texts(long, _counted(length), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    size = int(counts.loc[counts["k"] < 0, "n"].sum())
    counts = counts[counts["k"] >= 0]
    common = np.zeros(1 << COUNTER_BITS, bool)
    common[counts["k"][counts["n"] > COMMON * max(size >> COUNTER_BITS, 1)]] = True
    common = spark.sparkContext.broadcast(common)
    groups = max(-(-size // GROUP), 1)
    # What the texts ask for, and what they know already.
    rows = kit.map_texts(long, _candidates(length, groups, common), SENT)
    rows = rows.groupBy("g").applyInPandas(_answered(groups), SENT)
    found = rows.groupBy("g").applyInPandas(_gathered(length), FOUND).checkpoint()
    wanted = found.where(F.size("places") > 0).groupBy(*KEY).agg(F.collect_list("places").alias("places"))
    # The join's exchange of the texts is the same as that of the ranges' join, and is made once.
    rows = kit.map_texts(texts.join(wanted.hint("shuffle_hash"), KEY, "left"), _sent(length, groups, common), SENT)
    rows = rows.groupBy("g", "salt").applyInPandas(_judged(length, groups), SENT)
    rest = rows.groupBy("g").applyInPandas(_gathered(length), FOUND)
    return found.unionAll(rest).where(F.size("spans") > 0).select(*KEY, "spans")


def _kept(frames):
    for f in frames:
        rows = []
        for t, lists in zip(kit.to_bytes(f["text"].tolist()), f["lists"]):
            spans = sorted((int(x[i]), int(x[i + 1])) for x in lists for i in range(0, len(x), 2)) if lists is not None else []
            merged: list[list[int]] = []
            for a, b in spans:
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], b)
                else:
                    merged.append([a, b])
            ends = [0, *(x for s in merged for x in s), len(t)]
            kept = b"".join(t[a:b] for a, b in zip(ends[::2], ends[1::2]))
            rows.append((len(t), [{"start": a, "stop": b} for a, b in merged], kept))
        out = pd.DataFrame(rows, columns=["n_bytes", "spans", "kept"])
        out.insert(0, "doc_id", f["id"].astype("Int64").mask(f["none"]).array)
        yield out


def first_copies(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of each row: the byte ranges that go, maximal and in order, and the bytes
    that stay."""
    texts = keyed(docs)
    spans = repeats(texts, length).groupBy(*KEY).agg(F.collect_list("spans").alias("lists"))
    return kit.map_texts(texts.join(spans.hint("shuffle_hash"), KEY, "left"), _kept, "doc_id long, n_bytes long, spans array<struct<start:bigint,stop:bigint>>, kept binary")


def op12_first_copies(spark, sf_dir: str) -> DataFrame:
    """100-byte strings over all documents."""
    out = first_copies(kit.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
                      F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: The query by its definition: every 100-byte string of every document, in hexadecimal digits.
SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT r, doc_id, 400 * k AS o, substring(x, 800 * k + 1, 998) AS y FROM (SELECT r, doc_id, x, unnest(range(0, (len(x) // 2 + 399) // 400)) AS k FROM d)),
w AS (SELECT r, doc_id, o + p AS p, md5(substring(y, 2 * p + 1, 200)) AS h
  FROM (SELECT r, doc_id, o, y, unnest(range(0, len(y) // 2 - 99)) AS p FROM c WHERE len(y) >= 200)),
f AS (SELECT h, min((doc_id IS NULL, coalesce(doc_id, 0), p)) AS first FROM w GROUP BY h),
g AS (SELECT r, p FROM w JOIN f USING (h) WHERE (doc_id IS NULL, coalesce(doc_id, 0), p) > first),
n AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM g),
s AS (SELECT r, k, min(p) AS a, max(p) + 100 AS b FROM (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS k FROM n) GROUP BY r, k),
t AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
u AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS last, list((before, a) ORDER BY a) AS gaps FROM t GROUP BY r)
SELECT doc_id, CAST(len(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN u.r IS NULL THEN x ELSE array_to_string(list_transform(gaps, lambda g: x[2 * g[1] + 1:2 * g[2]]), '') || x[2 * last + 1:] END)) AS kept_sha256
FROM d LEFT JOIN u USING (r)
"""
