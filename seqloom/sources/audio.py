"""Audio files to peaks: WAV decoding, analysis in blocks, rendering at a speed."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.scalars import BINS, FFT_SIZE, HOP, SAMPLE_RATE
from seqloom.operators.fits import pick_peaks, stft_power


def read_wav(content: bytes) -> tuple[int, np.ndarray, float]:
    """Sample rate, samples x channels in -1..1, and the length in seconds that the header declares."""
    f = io.BytesIO(content)
    if f.read(4) != b"RIFF" or f.read(8)[4:] != b"WAVE":
        raise ValueError("not a WAV file")
    rate = width = channels = kind = None
    while len(head := f.read(8)) == 8:
        name, size = struct.unpack("<4sI", head)
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", f.read(size)[:16])
            width = bits // 8
        elif name == b"data":
            raw = f.read(size)
            raw = raw[: len(raw) // (width * channels) * width * channels]
            if kind == 3:
                x = np.frombuffer(raw, f"<f{width}").astype(np.float32)
            elif width == 1:
                x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
            elif width == 3:
                b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
                x = (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8) >> 8).astype(np.float32) / 2**23
            else:
                x = np.frombuffer(raw, f"<i{width}").astype(np.float32) / 2 ** (8 * width - 1)
            return rate, x.reshape(-1, channels), size / (width * channels * rate)
        else:
            f.seek(size + size % 2, 1)
    raise ValueError("a WAV file without data")


def resampled(x: np.ndarray, rate: int, to: int = SAMPLE_RATE) -> np.ndarray:
    """Linear interpolation after a moving average over the samples that fall together."""
    if rate == to or not len(x):
        return x
    if rate > to:
        w = max(1, round(rate / to))
        x = np.convolve(x, np.ones(w) / w, "same")
    return np.interp(np.arange(int(len(x) * to / rate)) * rate / to, np.arange(len(x)), x)


def at_speed(x: np.ndarray, speed: float) -> np.ndarray:
    """As a turntable plays it: time and pitch by ``speed``."""
    return np.interp(np.arange(int(len(x) / speed)) * speed, np.arange(len(x)), x) if len(x) else x


def excerpt(x: np.ndarray, rate: int, start_s: float = 0.0, length_s: float | None = None) -> np.ndarray:
    a = int(start_s * rate)
    return x[a:] if length_s is None else x[a : a + int(length_s * rate)]


def analyse(samples: np.ndarray, block_frames: int = 4096, reach: int = 12) -> list[tuple[int, int, int, int]]:
    """Peaks of 8 kHz mono samples, a block of frames at a time; blocks overlap by the neighbourhood, so the cut does not show."""
    n = max(0, 1 + (len(samples) - FFT_SIZE) // HOP)
    out = []
    for lo in range(0, n, block_frames):
        a, b = max(0, lo - reach - 1), min(n, lo + block_frames + reach + 1)
        power = stft_power(samples[a * HOP : (b - 1) * HOP + FFT_SIZE])
        out += [(f + a, f64 + a * 64, b64, db) for f, f64, b64, db in pick_peaks(power, *BINS, (reach, reach)) if lo <= f + a < lo + block_frames]
    return out


_PEAKS = "path string, seq int, frame64 long, bin64 int, mag_half_db int"
_HEADS = "path string, seconds double, declared double, rate int, channels int, error string"


def _mono(content: bytes) -> tuple[np.ndarray, int, float, int]:
    rate, x, declared = read_wav(content)
    return resampled(x.mean(1), rate), rate, declared, x.shape[1]


def _peaks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for path, content in zip(pdf.path, pdf.content):
            try:
                samples, *_ = _mono(content)
            except (ValueError, struct.error, TypeError):
                continue  # told by heads()
            rows = analyse(samples)
            yield pd.DataFrame([(path, i, *r[1:]) for i, r in enumerate(rows)], columns=["path", "seq", "frame64", "bin64", "mag_half_db"])


def _heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        out = []
        for path, content in zip(pdf.path, pdf.content):
            try:
                samples, rate, declared, channels = _mono(content)
                out.append((path, len(samples) / SAMPLE_RATE, declared, rate, channels, None))
            except (ValueError, struct.error, TypeError) as e:
                out.append((path, None, None, None, None, str(e) or "cannot be read"))
        yield pd.DataFrame(out, columns=["path", "seconds", "declared", "rate", "channels", "error"])


def wav_files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.wav").load(root)


def heads(files: DataFrame) -> DataFrame:
    """Length, declared length and format of each file, or why it can't be read."""
    return files.select("path", "content").mapInPandas(_heads, _HEADS)


def peaks(files: DataFrame) -> DataFrame:
    """``(path, seq, frame64, bin64, mag_half_db)`` of every file that can be read."""
    return files.select("path", "content").mapInPandas(_peaks, _PEAKS)


def truncated(heads_: DataFrame, share: float = 0.98) -> DataFrame:
    """Files that hold less than they declare."""
    return heads_.where(F.col("error").isNull() & (F.col("seconds") < share * F.col("declared")))


def channel_stats(files: DataFrame) -> DataFrame:
    """``(path, correlation, side_mid_db, silent)`` of two-channel files."""

    def run(frames):
        for pdf in frames:
            out = []
            for path, content in zip(pdf.path, pdf.content):
                try:
                    _, x, _ = read_wav(content)
                except (ValueError, struct.error, TypeError):
                    continue
                if x.shape[1] == 2 and len(x):
                    l, r = x[:, 0].astype(float), x[:, 1].astype(float)  # noqa: E741
                    power = [float((v**2).mean()) for v in (l, r, (l + r) / 2, (l - r) / 2)]
                    corr = float((l * r).mean() / np.sqrt(power[0] * power[1] + 1e-30))
                    out.append((path, corr, float(10 * np.log10((power[3] + 1e-20) / (power[2] + 1e-20))), min(power[:2]) < 1e-8 < max(power[:2])))
            yield pd.DataFrame(out, columns=["path", "correlation", "side_mid_db", "silent"])

    return files.select("path", "content").mapInPandas(run, "path string, correlation double, side_mid_db double, silent boolean")
