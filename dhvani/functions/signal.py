"""Waveform expressions on ``samples ARRAY<FLOAT>`` columns (one clip per row).

All are built-in array functions evaluated per row: a clip is a bounded unit
(30 s at 16 kHz is 480,000 samples), so no clip is ever split or shuffled.

Lambda discipline: a lambda body may use its own parameters, column
references and literals only.  A lambda re-evaluates any other expression it
captures once per element (and the optimiser inlines single-use columns into
lambdas), so per-row values such as a peak enter through
``zip_with(array, array_repeat(value, n), ...)`` instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8
TARGET_SR = 16000
WIN = 400
HOP = 160
AMIN = 1e-10


def as_double(s: Column) -> Column:
    return F.transform(s, lambda x: x.cast("double"))


def with_each(s: Column, value: Column, fn) -> Column:
    """``fn(element, value)`` over the array, ``value`` evaluated once per row."""
    return F.zip_with(s, F.array_repeat(value, F.size(s)), fn)


def mono_mix(channels: Column) -> Column:
    """``ARRAY<ARRAY<FLOAT>>`` [channel][sample] -> mean over channels
    (``channels`` must be a column reference)."""
    n = F.size(F.element_at(channels, 1))
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.aggregate(
        channels, F.lit(0.0), lambda acc, c: acc + F.element_at(c, i).cast("double")) / F.size(channels))


def peak(s: Column) -> Column:
    """max |sample|."""
    return F.array_max(F.transform(s, lambda x: F.abs(x.cast("double"))))


def scale(s: Column, by: Column) -> Column:
    """Each sample divided by the per-row value ``by``."""
    return with_each(s, by.cast("double"), lambda x, b: x.cast("double") / b)


def peak_normalize(s: Column) -> Column:
    """``s / (max|s| + 1e-8)``."""
    return scale(s, peak(s) + F.lit(EPS))


def pcm16(s: Column, full_scale: int = 32767) -> Column:
    """Clamp to [-1, 1] and quantise to 16-bit integers (round half to even)."""
    return F.transform(s, lambda x: F.rint(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double")))
                                           * full_scale).cast("smallint"))


def pad_cut(s: Column, n: Column | int) -> Column:
    """Zero-pad at the end or cut to exactly ``n`` samples."""
    nn = F.lit(n) if isinstance(n, int) else n
    zeros = F.array_repeat(F.lit(0.0).cast("float"), F.greatest(nn - F.size(s), F.lit(0)))
    return F.slice(F.concat(s, zeros), 1, nn)


def duration(s: Column, sr: Column | int) -> Column:
    """Samples / rate rounded to milliseconds (HALF_UP)."""
    r = F.lit(sr) if isinstance(sr, int) else sr
    return F.round(F.size(s) / r, 3)


def too_short(s: Column, sr: Column | int, min_sec: float = 0.3) -> Column:
    """Fewer than ``int(min_sec * sr)`` samples."""
    r = F.lit(sr) if isinstance(sr, int) else sr
    return F.size(s) < F.floor(F.lit(min_sec) * r)


def _sumsq(s: Column, start0: Column, length: Column) -> Column:
    return F.aggregate(F.slice(s, start0 + 1, length), F.lit(0.0),
                       lambda a, v: a + v.cast("double") * v.cast("double"))


def frame_energies(s: Column, win: int = WIN, hop: int = HOP) -> Column:
    """Mean square of frames starting at 0, hop, 2*hop, ... (< n); the last
    frames are shorter and averaged over their own length.  ``s`` must be a
    column reference."""
    n = F.size(s)
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(hop))
    e = F.transform(starts, lambda i: _sumsq(s, i, F.lit(win)) / F.least(F.lit(win), F.size(s) - i))
    return F.when(n > 0, e).otherwise(F.array().cast("array<double>"))


def centered_energies(s: Column, win: int = WIN, hop: int = HOP) -> Column:
    """Mean square of centred, zero-padded frames: frame k covers samples
    [k*hop - win/2, k*hop + win/2), k = 0..n div hop, divided by ``win``.
    ``s`` must be a column reference."""
    half = win // 2

    def energy(k):
        lo = F.greatest(k * hop - half, F.lit(0))
        hi = F.least(k * hop + half, F.size(s))
        return _sumsq(s, lo, F.greatest(hi - lo, F.lit(0))) / win

    return F.transform(F.sequence(F.lit(0), (F.size(s) / hop).cast("int")), energy)
