"""Fits and signal measures: slopes, lags, medians, envelopes."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def weighted_slope(x: Column, y: Column, w: Column) -> Column:
    """Aggregate: slope of the weighted least-squares line."""
    n, sx, sy = F.sum(w), F.sum(w * x), F.sum(w * y)
    return (F.sum(w * x * y) - sx * sy / n) / F.nullif(F.sum(w * x * x) - sx * sx / n, F.lit(0.0))


def weighted_mean(x: Column, w: Column) -> Column:
    return F.sum(w * x) / F.sum(w)


def majority(flag: Column, hits: Column) -> Column:
    """Aggregate: whether flagged rows have strictly more hits than the others."""
    return F.sum(F.when(flag, hits).otherwise(0)) > F.sum(F.when(flag, 0).otherwise(hits))


def theil_sen(df: DataFrame, keys: Sequence[str], x: str, y: str, most: int = 2000) -> DataFrame:
    """``(keys, slope, pairs)``: median of the slopes of all pairs of points of each key.

    Pairs are formed within a key only; a key of over ``most`` points is an error
    that names it, as its pairs would not fit, not a reason to leave points out.
    """
    held = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))).alias("p"))
    held = held.withColumn("p", F.when(F.size("p") > most, F.raise_error(F.format_string(f"a key of theil_sen has %d points, over {most}", F.size("p")))).otherwise(F.col("p")))
    a = held.select(*keys, "p", F.posexplode("p").alias("i", "a"))
    b = a.select(*keys, "a", F.explode(F.slice("p", F.col("i") + 2, F.size("p"))).alias("b")).where("a.x <> b.x")
    slope = (F.col("b.y") - F.col("a.y")) / (F.col("b.x") - F.col("a.x"))
    return b.groupBy(*keys).agg(F.percentile(slope, F.lit(0.5)).alias("slope"), F.count("*").alias("pairs"))


def best_lag(a: DataFrame, b: DataFrame, keys: Sequence[str], most: int) -> DataFrame:
    """``(keys, lag, corr)``: the shift of ``b (keys, i, v)`` against ``a`` of highest correlation; ties to the least."""
    shifts = F.explode(F.sequence(F.lit(-most), F.lit(most)))
    moved = b.select(*keys, F.col("v").alias("w"), "i").withColumn("lag", shifts).withColumn("i", F.col("i") - F.col("lag"))
    by = a.join(moved, [*keys, "i"]).groupBy(*keys, "lag").agg(F.corr("v", "w").alias("corr"))
    return by.groupBy(*keys).agg(F.max(F.struct("corr", (-F.col("lag")).alias("l"))).alias("x")).select(*keys, (-F.col("x.l")).alias("lag"), F.col("x.corr").alias("corr"))


def local_peaks(cells: DataFrame, keys: Sequence[str], near_frames: int, near_bins: int, floor: float) -> DataFrame:
    """Cells ``(keys, frame, bin, power)`` at ``floor`` or above that exceed all others of their neighbourhood.

    The maximum over bins is taken first, then that over frames, both as window
    frames. It is taken with ties to the last and to the first place: a cell that
    shares the maximum with another wins only one of the two, and is no peak.
    """
    from pyspark.sql.window import Window

    bins = Window.partitionBy(*keys, "frame").orderBy("bin").rangeBetween(-near_bins, near_bins)
    frames = Window.partitionBy(*keys, "bin").orderBy("frame").rangeBetween(-near_frames, near_frames)
    last = F.struct("power", "frame", "bin")
    first = F.struct("power", (-F.col("frame")).alias("f"), (-F.col("bin")).alias("b"))
    best = cells.withColumns({"__last": F.max(last).over(bins), "__first": F.max(first).over(bins)})
    best = best.withColumns({"__last": F.max("__last").over(frames), "__first": F.max("__first").over(frames)})
    return best.where((F.col("power") >= floor) & (F.col("__last") == last) & (F.col("__first") == first)).select(*keys, "frame", "bin", "power")


# -- arrays ---------------------------------------------------------------------


def stft_power(samples: np.ndarray, size: int = 1024, hop: int = 128) -> np.ndarray:
    """Power of Hann-windowed frames, plus 1e-20; a trailing partial frame is dropped."""
    n = 1 + (len(samples) - size) // hop if len(samples) >= size else 0
    if not n:
        return np.zeros((0, size // 2 + 1))
    frames = np.lib.stride_tricks.sliding_window_view(samples, size)[::hop][:n]
    return np.abs(np.fft.rfft(frames * np.hanning(size + 1)[:-1], axis=1)) ** 2 + 1e-20


def sliding_max(x: np.ndarray, reach: int, axis: int) -> np.ndarray:
    """Maximum over ``reach`` cells on either side, by doubling."""
    x = np.moveaxis(x, axis, 0)
    width, n = 2 * reach + 1, len(x)
    pad = np.full((reach, *x.shape[1:]), -np.inf)
    run, have = np.concatenate([pad, x, pad]), 1
    while have * 2 <= width:
        run = np.maximum(run[: len(run) - have], run[have:])
        have *= 2
    if have < width:
        run = np.maximum(run[: len(run) - (width - have)], run[width - have :])
    return np.moveaxis(run[:n], 0, axis)


def pick_peaks(power: np.ndarray, low_bin: int = 5, high_bin: int = 500, reach: tuple[int, int] = (12, 12), floor_db: float = -10.0) -> list[tuple[int, int, int, int]]:
    """``(frame, frame64, bin64, half_db)`` of strict local maxima, places refined by a parabola; in order of frame and bin."""
    band = power[:, low_bin:high_bin]
    if not len(band):
        return []
    top = sliding_max(sliding_max(band, reach[0], 0), reach[1], 1)
    at = np.argwhere((band == top) & (10 * np.log10(band) >= floor_db))
    out = []
    for f, b in at:
        around = band[max(0, f - reach[0]) : f + reach[0] + 1, max(0, b - reach[1]) : b + reach[1] + 1]
        if (around == band[f, b]).sum() > 1:
            continue
        level = lambda i, j: 10 * np.log10(power[i, j])
        k = b + low_bin
        df = vertex(*(level(i, k) for i in (f - 1, f, f + 1))) if 0 < f < len(power) - 1 else 0.0
        db = vertex(*(level(f, j) for j in (k - 1, k, k + 1))) if 0 < k < power.shape[1] - 1 else 0.0
        out.append((int(f), round((f + df) * 64), round((k + db) * 64), round(2 * level(f, k))))
    return out


def vertex(a: float, b: float, c: float) -> float:
    """Place of a parabola's top through three values, within half a step."""
    bend = a - 2 * b + c
    return 0.0 if bend >= 0 else float(np.clip(0.5 * (a - c) / bend, -0.5, 0.5))


def harmonic_percussive(power: np.ndarray, width: int = 17) -> tuple[np.ndarray, np.ndarray]:
    """Soft masks of what lasts over time and of what spreads over bins, by median filters."""
    half = width // 2

    def medians(x, axis):
        pad = [(half, half) if i == axis else (0, 0) for i in range(2)]
        view = np.lib.stride_tricks.sliding_window_view(np.pad(x, pad, mode="edge"), width, axis=axis)
        return np.median(view, axis=-1)

    h, p = medians(power, 0) ** 2, medians(power, 1) ** 2
    return h / (h + p + 1e-30), p / (h + p + 1e-30)


def onset_envelope(power: np.ndarray) -> np.ndarray:
    """Positive spectral flux of log power, a value for each frame."""
    log = np.log10(power)
    return np.concatenate([[0.0], np.maximum(np.diff(log, axis=0), 0).sum(1)]) if len(power) else np.zeros(0)


def beat_period(envelope: np.ndarray, rate: float = 100.0, bpm: tuple[float, float] = (120.0, 190.0)) -> float:
    """Seconds of a beat: the strongest autocorrelation in the range, refined eight beats out."""
    e = envelope - envelope.mean()
    n = len(e)
    auto = np.correlate(e, e, "full")[n - 1 :]
    low, high = int(np.ceil(rate * 60 / bpm[1])), int(np.floor(rate * 60 / bpm[0]))
    if high + 1 >= n:
        return float("nan")
    best = low + int(np.argmax(auto[low : high + 1]))
    far = 8 * best
    if far + 5 < n:
        near = np.arange(far - 4, far + 5)
        k = int(near[np.argmax(auto[near])])
        return (k + vertex(auto[k - 1], auto[k], auto[k + 1])) / 8 / rate
    return (best + vertex(auto[best - 1], auto[best], auto[best + 1])) / rate


def drop_time(envelope: np.ndarray, rate: float = 100.0, span: float = 8.0) -> int:
    """Frame of the largest rise of the mean over ``span`` seconds after against before."""
    w = int(span * rate)
    if len(envelope) < 2 * w:
        return -1
    run = np.concatenate([[0.0], np.cumsum(envelope)])
    at = np.arange(w, len(envelope) - w + 1)
    return int(at[np.argmax((run[at + w] - run[at]) - (run[at] - run[at - w]))])


def grid_fit(q: np.ndarray, ref: np.ndarray, speeds: Sequence[float], within: float = 2.0) -> tuple[float, float, int]:
    """Speed and offset of a grid whose densest run of residuals is longest; ties to the first speed."""
    best = (float("nan"), float("nan"), 0)
    for s in speeds:
        d = np.sort(ref - s * q)
        size = np.searchsorted(d, d + within, "right") - np.arange(len(d))
        k = int(size.argmax())
        if size[k] > best[2]:
            best = (s, float(d[k : k + size[k]].mean()), int(size[k]))
    return best
