"""Arrow-batched kernels where the built-ins are asymptotically slower.

N-gram statistics: per row, the clipped n-gram matches of BLEU and chrF
(sum over n-grams of min(hyp count, ref count)), with n-grams packed into
integers and counted by vectorised sorts.  Spark's ``substring`` walks UTF-8 text from its start, so
native n-gram arrays cost O(L^2) per row; counting here keeps it O(L) and
returns a fixed-size array per row that Spark sums with a partial aggregate
(no n-gram is ever shuffled).

Edit distance: Spark's ``levenshtein`` fills the full n*m table one cell at a
time.  The bit-parallel algorithms (Myers 1999; Hyyro 2003) process a whole column
of the table with a few wide integer operations and work on any token
alphabet, so words need no recoding to characters.  Only a band around the
diagonal is filled, which grows until it proves its result, so the cost
follows n times the distance.  The kernel runs inside Spark tasks on Arrow batches; Spark
partitions the pairs.  ``block_distance`` is the step of :mod:`dhvani.operators.edit`,
which cuts very long pairs into blocks.

This module is pickled by value, so executors need no installed package.
"""

from __future__ import annotations

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType


def _common_prefix(a, b) -> int:
    """Length of the common prefix (binary search over C-level slice compares)."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _common_suffix(a, b) -> int:
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if a[len(a) - mid:] == b[len(b) - mid:]:
            lo = mid
        else:
            hi = mid - 1
    return lo


def _masks(tokens, wanted) -> dict:
    """For each token of ``wanted`` the places where it stands in ``tokens``, as bits."""
    if len(tokens) < 256:
        out: dict = {}
        for i, tok in enumerate(tokens):
            out[tok] = out.get(tok, 0) | (1 << i)
        return out
    import numpy as np
    ids = {tok: k for k, tok in enumerate(wanted)}
    at = np.fromiter((ids.get(tok, -1) for tok in tokens), np.int64, len(tokens))
    order = np.argsort(at, kind="stable")
    cut = np.searchsorted(at[order], np.arange(len(ids) + 1))
    out = {}
    for tok, k in ids.items():
        if cut[k + 1] > cut[k]:
            bits = np.zeros(len(tokens), np.uint8)
            bits[order[cut[k]:cut[k + 1]]] = 1
            out[tok] = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
    return out


#: Columns that share a cut-out of the row masks.
STRIPE = 1024


def banded_distance(a, b, e: int, masks: dict | None = None) -> int | None:
    """Distance of a and b (a not shorter), if it is at most ``len(a) - len(b) + 2 e + 1``, else None.

    Such a distance is reached by paths that leave the two corner diagonals by ``e`` cells at
    most, so only that band is filled, a column for each token of b.  The band is a bit
    vector that moves down one row with each column (Hyyro 2003): its cost is
    len(b) * (len(a) - len(b) + 2 e) / 64."""
    m, n = len(a), len(b)
    bound = m - n + 2 * e + 1
    low = min(m - n + e, m)          # rows below the main diagonal
    up = min(e, n)                   # rows above it
    width = low + up + 1
    mask, last = (1 << width) - 1, 1 << (width - 1)
    rows = masks if masks is not None else _masks(a, set(b))
    vp, vn = mask & ~((1 << up) - 1), 0
    score, limit = low, bound + e
    wide = (1 << (width + STRIPE)) - 1
    cut: dict = {}
    for j in range(n):
        k = j % STRIPE
        if not k:
            cut = {}
        tok = b[j]
        eq = cut.get(tok)
        if eq is None:
            eq = rows.get(tok, 0)
            base = j - k - up        # row of the lowest bit
            eq = cut[tok] = ((eq >> base) if base >= 0 else (eq << -base)) & wide
        eq = (eq >> k) & mask
        d0 = ((((eq & vp) + vp) ^ vp) | eq | vn) & mask
        hp = vn | (mask ^ (d0 | vp))
        hn = d0 & vp
        if j < m - low:              # along the lowest diagonal ...
            if not d0 & last:
                score += 1
                if score > limit:
                    return None
        else:                        # ... then along the last row
            bit = 1 << (m - 1 - j + up)
            if hp & bit:
                score += 1
            elif hn & bit:
                score -= 1
        d1 = d0 >> 1
        vp = hn | (mask ^ (d1 | hp))
        vn = d1 & hp
    return score if score <= bound else None


def block_distance(masks: dict, size: int, columns, vp: int, vn: int, hp: int, hn: int):
    """One block of the table: ``size`` rows given by their masks, one column for each of
    ``columns``.  (vp, vn) are the differences down its left border and (hp, hn) those along its upper
    border, as bits of +1 and -1; returns those of the right and the lower border (Myers 1999)."""
    mask, top = (1 << size) - 1, 1 << (size - 1)
    get = masks.get
    plus, minus = bytearray((len(columns) + 7) // 8), bytearray((len(columns) + 7) // 8)
    up = hp.to_bytes(len(plus), "little")
    down = hn.to_bytes(len(plus), "little")
    for j, tok in enumerate(columns):
        byte, bit = j >> 3, 1 << (j & 7)
        eq = get(tok, 0)
        xv = eq | vn
        less = down[byte] & bit
        if less:
            eq |= 1
        xh = (((eq & vp) + vp) ^ vp) | eq
        ph = vn | (mask ^ (mask & (xh | vp)))
        mh = vp & xh
        if ph & top:
            plus[byte] |= bit
        elif mh & top:
            minus[byte] |= bit
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        if less:
            mh |= 1
        elif up[byte] & bit:
            ph |= 1
        vp = mh | (mask ^ (mask & (xv | ph)))
        vn = ph & xv
    return vp, vn, int.from_bytes(plus, "little"), int.from_bytes(minus, "little")


#: First half-width of the band beyond the difference of the lengths, and its growth.
BAND, GROWTH = 32, 4


def edit_distance_seq(a, b) -> int:
    """Levenshtein distance between two sequences of hashable tokens: bands of growing
    width until one proves its result, so the cost follows the distance."""
    # a common prefix or suffix never changes the distance
    k = _common_prefix(a, b)
    a, b = a[k:], b[k:]
    k = _common_suffix(a, b)
    if k:
        a, b = a[:len(a) - k], b[:len(b) - k]
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    masks, e = _masks(a, set(b)), BAND
    while True:
        got = banded_distance(a, b, min(e, len(b)), masks)
        if got is not None:
            return got
        e *= GROWTH


#: A first band has at least this part of a pair's columns on both sides: a wider band costs less than a second one.
NEAR = 48
#: Words of all band vectors of a batch, at most; bits of a pair's token masks and bytes of a batch's, at most.
BATCH_WORDS, PAIR_BITS, MASK_BYTES = 1 << 14, 1 << 22, 1 << 25


def _token_ids(a, b):
    """Tokens as numbers, those of ``b`` from 0; -1 in a: not in b.  With how many numbers there are."""
    import numpy as np
    if isinstance(a, str):
        a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), "<u4") for t in (a, b))
        known, ib = np.unique(b, return_inverse=True)
        at = np.minimum(np.searchsorted(known, a), len(known) - 1)
        return np.where(known[at] == a, at, -1), ib, len(known)
    ids: dict = {}
    ib = np.fromiter((ids.setdefault(t, len(ids)) for t in b), np.int64, len(b))
    return np.fromiter((ids.get(t, -1) for t in a), np.int64, len(a)), ib, len(ids)


def _carry(total, over):
    """Add the carries of a sum of many words: ``over`` says which words send one to the next."""
    import numpy as np
    while True:
        upper = total[1:]
        upper += over
        over &= upper == 0           # a full word hands its carry on
        if not over.any():
            return
        some = np.argwhere(over[:-1])
        if len(some) <= 12:
            for w, p in some.tolist():
                w += 2
                while w < len(total):
                    x = total[w, p] = (int(total[w, p]) + 1) & 0xFFFFFFFFFFFFFFFF
                    if x:
                        break
                    w += 1
            return
        over[1:] = over[:-1].copy()
        over[0] = False


def _banded_batch(items, e: int, words: int):
    """Distances of pairs ``(a's numbers, b's numbers, how many)``, sorted by falling length of b, in one band of
    ``64 words`` diagonals for all: as :func:`banded_distance`, a column of each pair at a time, the words of the
    vectors in the first dimension.  The distance is read off along the diagonal of the last cell."""
    import numpy as np
    m, n = (np.array([len(x[k]) for x in items]) for k in (0, 1))
    total = (int(max(m.max() + e, n.max())) >> 6) + words + 2
    masks, columns, base = [np.zeros((1, total), np.uint64)], np.zeros((int(n[0]), len(items)), np.int64), 1
    for p, (ia, ib, size) in enumerate(items):
        bits = np.zeros((size, 64 * total), np.uint8)
        at = np.flatnonzero(ia >= 0)
        bits[ia[at], at + e] = 1
        masks.append(np.packbits(bits, axis=1, bitorder="little").view("<u8"))
        columns[:len(ib), p] = ib + base
        base += size
    rows = np.ascontiguousarray(np.concatenate(masks).T)
    first = [((1 << 64) - 1) & ~((1 << min(max(e - 64 * w, 0), 64)) - 1) for w in range(words)]
    vp = np.repeat(np.array(first, np.uint64)[:, None], len(items), axis=1)
    vn = np.zeros_like(vp)
    score, done, last = m - n, [], n
    word, bit = (m - n + e) >> 6, ((m - n + e) & 63).astype(np.uint64)
    at = word * len(items) + np.arange(len(items))
    one, high = np.uint64(1), np.uint64(63)
    space = None
    for j in range(int(n[0])):
        if last[-1] <= j:            # the shortest pairs have ended
            left = int(np.searchsorted(-last, -j))
            if left <= 0.8 * len(last):
                done.append(score[left:])
                score, last, word, bit = score[:left], last[:left], word[:left], bit[:left]
                vp, vn, columns = vp[:, :left].copy(), vn[:, :left].copy(), columns[:, :left]
                at, space = word * left + np.arange(left), None
        if space is None:
            space = [np.empty_like(vp) for _ in range(6)]
            eq, total, d0, hp, hn, d1 = space
            seen = np.empty((words + 1, vp.shape[1]), np.uint64)
        q, r = j >> 6, j & 63
        rows[q:q + words + 1].take(columns[j], axis=1, out=seen, mode="clip")
        np.right_shift(seen[:-1], np.uint64(r), out=eq)
        if r:
            np.left_shift(seen[1:], np.uint64(64 - r), out=d0)
            eq |= d0
        np.bitwise_and(eq, vp, out=total)
        total += vp
        if words > 1:
            _carry(total, total[:-1] < vp[:-1])
        np.bitwise_xor(total, vp, out=d0)
        d0 |= eq
        d0 |= vn
        np.bitwise_or(d0, vp, out=hp)
        np.invert(hp, out=hp)
        hp |= vn
        np.bitwise_and(d0, vp, out=hn)
        score += ((d0.reshape(-1).take(at) >> bit) & one == 0) & (last > j)
        np.right_shift(d0, one, out=d1)
        np.left_shift(d0[1:], high, out=eq[1:])
        d1[:-1] |= eq[1:]
        np.bitwise_or(d1, hp, out=vp)
        np.invert(vp, out=vp)
        vp |= hn
        np.bitwise_and(d1, hp, out=vn)
    return np.concatenate([score, *reversed(done)])


def _band_words(m: int, n: int, e: int) -> int:
    return (m - n + 2 * e) // 64 + 1


def edit_distances(pairs) -> list[int]:
    """:func:`edit_distance_seq` of each pair of sequences.

    Pairs of like sizes are filled together, a column of all of them a step, so a step costs little more than
    for one.  The first band is the narrowest that could prove a distance, as tokens that only one side
    has set a least one; a pair without a proof gets a wider one.  Pairs that have too few like them go alone."""
    import numpy as np
    out, todo = [0] * len(pairs), []
    for k, (a, b) in enumerate(pairs):
        i = _common_prefix(a, b)
        a, b = a[i:], b[i:]
        i = _common_suffix(a, b)
        if i:
            a, b = a[:len(a) - i], b[:len(b) - i]
        if len(a) < len(b):
            a, b = b, a
        if not len(b):
            out[k] = len(a)
            continue
        ia, ib, size = _token_ids(a, b)
        both = np.minimum(np.bincount(ia[ia >= 0], minlength=size), np.bincount(ib, minlength=size)).sum()
        m, n = len(a), len(b)
        e = min(max(BAND, n // NEAR, -(-(n - int(both) - 1) // 2)), n)
        todo.append((k, a, b, (ia, ib, size), e))
    while todo:
        # Bands of like widths, in steps of a quarter or so, then like lengths.
        def kind(x):
            return round(4 * np.log(_band_words(len(x[1]), len(x[2]), x[4])))
        todo.sort(key=lambda x: (kind(x), -len(x[2])))
        again, start = [], 0
        while start < len(todo):
            group, wide, slant, bytes_ = [], 0, 0, 0
            for x in todo[start:]:
                m, n, e, size = len(x[1]), len(x[2]), x[4], x[3][2]
                w, s = max(wide, e), max(slant, m - n)
                words = (s + 2 * w) // 64 + 1
                bytes_ += size * (m + w + 64 * words + 128) // 8
                if group and (words * (len(group) + 1) > max(BATCH_WORDS, 2 * words) or bytes_ > MASK_BYTES or kind(x) != kind(group[0]) or 2 * n < len(group[0][2])):
                    break
                group.append(x)
                wide, slant = w, s
            start += len(group)
            words = (slant + 2 * wide) // 64 + 1
            together = len(group[0][2]) * (40 + 0.02 * words * len(group))    # microseconds, about
            alone = sum(len(x[2]) * (1.4 + 0.02 * _band_words(len(x[1]), len(x[2]), x[4])) for x in group)
            if together > alone or any(x[3][2] * (len(x[1]) + wide + 64 * words + 128) > PAIR_BITS for x in group):
                for k, a, b, _, _ in group:
                    out[k] = edit_distance_seq(a, b)
                continue
            for x, got in zip(group, _banded_batch([x[3] for x in group], wide, words).tolist()):
                k, a, b, ids, _ = x
                if got <= len(a) - len(b) + 2 * wide + 1:
                    out[k] = got
                else:
                    again.append((k, a, b, ids, min(GROWTH * wide, max(len(b), wide + 1))))
        todo = again
    return out


#: Bytes of text whose distances are computed at a time (or one row).
SLICE = 1 << 25


def sliced(batch, limit: int):
    """An Arrow batch in slices of rows whose strings have ``limit`` bytes at most (or of one row)."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    size = np.zeros(batch.num_rows, np.int64)
    for c in batch.columns:
        if pa.types.is_string(c.type) or pa.types.is_large_string(c.type):
            size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    upto, first = np.cumsum(size), 0
    while first < batch.num_rows:
        before = upto[first - 1] if first else 0
        end = max(int(np.searchsorted(upto, before + limit, "right")), first + 1)
        yield batch.slice(first, end - first)
        first = end


def edit_counts(units, huge: int):
    """For batches of texts (ref, hyp): of each unit the edits and the reference tokens (w_edits, w_ref, c_edits,
    c_ref); no edits where both sides have more than ``huge`` tokens."""
    def run(batches):
        import pyarrow as pa
        for batch in batches:
            for part in sliced(batch, SLICE):
                refs, hyps, columns = part["ref"].to_pylist(), part["hyp"].to_pylist(), {}
                for u in units:
                    r, h = ([[w for w in t.split(" ") if w] for t in x] if u == "word" else x for x in (refs, hyps))
                    found = [None] * len(r)
                    near = [k for k in range(len(r)) if min(len(r[k]), len(h[k])) <= huge]
                    for k, d in zip(near, edit_distances([(r[k], h[k]) for k in near])):
                        found[k] = d
                    columns[f"{u[0]}_edits"] = pa.array(found, pa.int64())
                    columns[f"{u[0]}_ref"] = pa.array([len(x) for x in r], pa.int64())
                yield pa.RecordBatch.from_pydict(columns)
    return run


@F.pandas_udf(LongType())
def _char_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edit_distance_seq(x, y) for x, y in zip(a, b)],
                     dtype="Int64")


@F.pandas_udf(LongType())
def _word_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    def words(s):
        return [w for w in s.split(" ") if w]
    return pd.Series([None if x is None or y is None else edit_distance_seq(words(x), words(y))
                      for x, y in zip(a, b)], dtype="Int64")


def char_edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over code points (same value as ``levenshtein``)."""
    return _char_distance(a, b)


def word_edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over space-separated words (empty words ignored)."""
    return _word_distance(a, b)


#: Pairs of characters that are kept before their counts go out.
PAIRS = 1 << 18


def facing_counts(batches):
    """(t, p, n) of batches of equally placed texts (rc, hc): how often character t stands
    over p, up to the end of the shorter one; one row for each pair of characters and task, or ``PAIRS`` of them."""
    import numpy as np
    import pyarrow as pa

    def codes(text):
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)

    def table(pair, n):
        return pa.RecordBatch.from_pydict({"t": [chr(x) for x in (pair >> 21).tolist()], "p": [chr(x) for x in (pair & 0x1FFFFF).tolist()], "n": n})
    pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for part in sliced(batch, 1 << 20):
            parts = []
            for rc, hc in zip(part["rc"].to_pylist(), part["hc"].to_pylist()):
                k = min(len(rc), len(hc))
                parts.append((codes(rc[:k]) << 21) | codes(hc[:k]))
            more, times = np.unique(np.concatenate(parts), return_counts=True)
            pair, which = np.unique(np.concatenate([pair, more]), return_inverse=True)
            n = np.bincount(which, np.concatenate([n, times])).astype(np.int64)
            if len(pair) > PAIRS:
                yield table(pair, n)
                pair, n = pair[:0], n[:0]
    if len(pair):
        yield table(pair, n)


def ngram_stats(ref, hyp, orders: int) -> list[int]:
    """[hyp_total, ref_total, matches] for n = 1..orders, flattened; ``ref``
    and ``hyp`` are strings (character n-grams) or token lists (word n-grams).

    Tokens get dense per-row ids; n-grams are packed exactly into unsigned
    64-bit codes (when id bits x orders <= 63) and counted with sorts;
    otherwise hash counters are used."""
    import numpy as np
    vocab: dict = {}
    r_ids = np.fromiter((vocab.setdefault(t, len(vocab) + 1) for t in ref), dtype=np.uint64, count=len(ref))
    h_ids = np.fromiter((vocab.setdefault(t, len(vocab) + 1) for t in hyp), dtype=np.uint64, count=len(hyp))
    bits = max(1, len(vocab).bit_length())
    if bits * orders > 63:
        return _ngram_stats_counter(ref, hyp, orders)
    out: list[int] = []
    rc, hc = r_ids.copy(), h_ids.copy()
    shift = np.uint64(bits)
    for n in range(1, orders + 1):
        if n > 1:
            rc = (rc[:-1] << shift) | r_ids[n - 1:] if len(rc) > 1 else rc[:0]
            hc = (hc[:-1] << shift) | h_ids[n - 1:] if len(hc) > 1 else hc[:0]
        m = 0
        if len(rc) and len(hc):
            ur, cr = np.unique(rc, return_counts=True)
            uh, ch = np.unique(hc, return_counts=True)
            _, ir, ih = np.intersect1d(ur, uh, assume_unique=True, return_indices=True)
            m = int(np.minimum(cr[ir], ch[ih]).sum())
        out += [max(len(hyp) - n + 1, 0), max(len(ref) - n + 1, 0), m]
    return out


def _ngram_stats_counter(ref, hyp, orders: int) -> list[int]:
    from collections import Counter
    out: list[int] = []
    for n in range(1, orders + 1):
        rc = Counter(tuple(ref[i:i + n]) for i in range(len(ref) - n + 1))
        hc = Counter(tuple(hyp[i:i + n]) for i in range(len(hyp) - n + 1))
        m = sum(min(c, rc[g]) for g, c in hc.items() if g in rc)
        out += [max(len(hyp) - n + 1, 0), max(len(ref) - n + 1, 0), m]
    return out


def _stats_udf(orders: int, unit: str):
    @F.pandas_udf(ArrayType(LongType()))
    def stats(a: pd.Series, b: pd.Series) -> pd.Series:
        res = []
        for r, h in zip(a, b):
            r, h = r or "", h or ""
            if unit == "word":
                r, h = [w for w in r.split(" ") if w], [w for w in h.split(" ") if w]
            res.append(ngram_stats(r, h, orders))
        return pd.Series(res)
    return stats


def word_ngram_stats(ref_tokens: Column, hyp_tokens: Column, orders: int = 4) -> Column:
    """Per row (space-separated tokens): [hyp_total, ref_total, matches] x orders."""
    return _stats_udf(orders, "word")(ref_tokens, hyp_tokens)


def char_ngram_stats(ref: Column, hyp: Column, orders: int = 6) -> Column:
    """Per row (characters): [hyp_total, ref_total, matches] x orders."""
    return _stats_udf(orders, "char")(ref, hyp)


import sys as _sys  # noqa: E402

cloudpickle.register_pickle_by_value(_sys.modules[__name__])
