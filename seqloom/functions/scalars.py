"""Scalar expressions on columns: time codes, names, levels, quantisers and units."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The analysis profile (samples a second, FFT size, hop, bins kept).
SAMPLE_RATE, FFT_SIZE, HOP, BINS = 8000, 1024, 128, (5, 500)
#: Frames a second and frames of a 10 s window.
FRAMES_PER_SECOND, WINDOW_FRAMES = SAMPLE_RATE / HOP, 625
#: Least hits, windows and possible hits of a confident level, by the pass that gave the evidence.
CONFIDENT = {"ladder": (200, 3, 60), "fitted": (240, 3, 60)}
LEVELS = ("weak", "possible", "confident")
#: Upper edges of octave bands, Hz.
OCTAVES = (125, 250, 500, 1000, 2000, 4000)


# -- time codes -------------------------------------------------------------


def parse_timecode(text: Column) -> Column:
    """Seconds of ``S``, ``M:S`` or ``H:M:S``, the seconds with an optional fraction; null for anything else.

    Fields are digits only, of any number; below the leading one they are under 60.
    Times of 2^64 seconds or more are null.
    """
    whole, last = r"(\d+)", r"(\d+(?:\.\d+)?)"
    field = lambda pattern, k: F.try_element_at(F.regexp_extract_all(F.trim(text, F.lit(" \t\r\n")), F.lit(pattern), F.lit(k)), F.lit(1)).cast("double")
    alone = field(f"^{last}$", 1)
    m, ms = (field(f"^{whole}:{last}$", k) for k in (1, 2))
    h, hm, hs = (field(f"^{whole}:{whole}:{last}$", k) for k in (1, 2, 3))
    seconds = F.coalesce(alone, F.when(ms < 60, m * 60 + ms), F.when((hm < 60) & (hs < 60), h * 3600 + hm * 60 + hs))
    return F.when(seconds < F.lit(float(1 << 64)), seconds)


def format_timecode(seconds: Column) -> Column:
    """``M:SS``, from an hour on ``H:MM:SS``; fractions are cut off, negative times are null."""
    s = F.floor(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    minutes, rest = F.floor(s / 60).cast("long"), s % 60
    short = F.concat(minutes.cast("string"), F.lit(":"), two(rest))
    long = F.concat(F.floor(s / 3600).cast("long").cast("string"), F.lit(":"), two(minutes % 60), F.lit(":"), two(rest))
    return F.when(s >= 3600, long).when(s >= 0, short)


def frames_to_seconds(frame: Column) -> Column:
    return frame / F.lit(FRAMES_PER_SECOND)


def seconds_to_frames(seconds: Column) -> Column:
    return seconds * F.lit(FRAMES_PER_SECOND)


def bin_to_hz(b: Column) -> Column:
    return b * F.lit(SAMPLE_RATE / FFT_SIZE)


def window_of(frame: Column, frames: int = WINDOW_FRAMES) -> Column:
    """Number of the tumbling window that a frame is in."""
    return F.floor(frame / frames).cast("long")


# -- names -----------------------------------------------------------------


def normalise(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one blank; null where nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c), F.lit("")) for c in columns))


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def track_name(artist: Column, title: Column, path: Column) -> Column:
    """``artist - title``, the title alone, else the file's stem."""
    a, t = first_filled(artist), first_filled(title)
    return F.when(t.isNull(), file_stem(path)).otherwise(F.concat_ws(" - ", a, t))


def extension_in(path: Column, extensions: list[str]) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin([e.lower() for e in extensions])


# -- levels ----------------------------------------------------------------


def level_rank(hits: Column, windows: Column, passed: Column | str = "ladder") -> Column:
    """2 confident, 1 possible, 0 weak."""
    passed = F.lit(passed) if isinstance(passed, str) else passed

    def of(name):
        h, w, p = CONFIDENT[name]
        return F.when((hits >= h) & (windows >= w), 2).when(hits >= p, 1).otherwise(0)

    return F.when(passed == "fitted", of("fitted")).otherwise(of("ladder"))


def level(rank: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, LEVELS)), (rank + 1).cast("int"))


def span_level(hits: Column, span_s: Column, passed: str = "ladder", least_span_s: float = 20.0) -> Column:
    """The rule variant that asks for a span of seconds instead of windows."""
    h, _, p = CONFIDENT[passed]
    return level(F.when((hits >= h) & (span_s >= least_span_s), 2).when(hits >= p, 1).otherwise(0))


def shortfall(hits: Column, windows: Column, passed: Column | str = "ladder") -> Column:
    """The next level and what a candidate lacks for it under the rule of its pass; empty for a confident one."""
    passed = F.lit(passed) if isinstance(passed, str) else passed

    def of(name):
        h, w, p = CONFIDENT[name]
        more_h = F.when(hits < h, F.concat((h - hits).cast("string"), F.lit(" more hits")))
        more_w = F.when(windows < w, F.concat((w - windows).cast("string"), F.lit(" more window"), F.when(w - windows == 1, "").otherwise("s")))
        weak = F.concat(F.lit("possible: "), (p - hits).cast("string"), F.lit(" more hits"))
        return F.when((hits >= h) & (windows >= w), "").when(hits >= p, F.concat(F.lit("confident: "), F.concat_ws(", ", more_h, more_w))).otherwise(weak)

    return F.when(passed == "fitted", of("fitted")).otherwise(of("ladder"))


# -- quantisers --------------------------------------------------------------


def decibels(power: Column) -> Column:
    return 10 * F.log10(power)


def anchor_level(b: Column) -> Column:
    """Linear to bin 50, then in steps of 2 %; 255 at most."""
    return F.least(F.lit(255), F.round(F.when(b < 50, b).otherwise(50 + F.log(b / 50) / F.log(F.lit(1.02)))).cast("int"))


def octave_band(hz: Column) -> Column:
    """Number of the first band whose upper edge lies above, the last for what is beyond."""
    return reduce(lambda rest, i: F.when(hz < OCTAVES[i], i).otherwise(rest), reversed(range(len(OCTAVES))), F.lit(len(OCTAVES)))


def varint_length(value: Column) -> Column:
    """Bytes of a non-negative integer in seven-bit groups."""
    return reduce(lambda rest, n: F.when(value < (1 << 7 * n), n).otherwise(rest), reversed(range(1, 9)), F.lit(9))


def rarity_weight(length: Column) -> Column:
    return 1 / F.log(F.lit(2.718281828459045) + length)


def track_length_ok(seconds: Column, least: float | None, most: float | None, margin: float = 1.0) -> Column:
    """Whether a length is within limits; ``margin`` widens both for lengths that are only declared."""
    ok = F.lit(True)
    if least is not None:
        ok = ok & (seconds * margin >= least)
    if most is not None:
        ok = ok & (seconds <= most * margin)
    return ok


def channel_class(correlation: Column, delay: Column, side_mid_db: Column, silent: Column) -> Column:
    """First that applies: one-channel, inverted, delayed, else by side over mid."""
    return (
        F.when(silent, "one-channel")
        .when(correlation <= -0.8, "inverted")
        .when(delay != 0, "delayed")
        .otherwise(width_class(side_mid_db))
    )


def width_class(side_mid_db: Column) -> Column:
    """How wide a source is by its side over its mid, in dB."""
    return F.when(side_mid_db <= -40, "mono").when(side_mid_db <= -20, "nearly-mono").when(side_mid_db <= -10, "narrow").otherwise("wide")


# -- pair hashes -------------------------------------------------------------


def pair_hash(level_: Column, dbin: Column, dframe: Column) -> Column:
    """21 bits: 8 of the anchor level, 7 of the bin step, 6 of the frame step."""
    return F.shiftleft(level_.cast("int"), 13).bitwiseOR(F.shiftleft((dbin + 63).cast("int"), 6)).bitwiseOR(dframe.cast("int"))


def pair_parts(h: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(h, 13), F.shiftright(h, 6).bitwiseAND(127) - 63, h.bitwiseAND(63)


def near_hashes(h: Column) -> Column:
    """The hash and its neighbours one step away in any component, those in range."""
    a, b, f = pair_parts(h)
    out = []
    for da in (-1, 0, 1):
        for db in (-1, 0, 1):
            for df in (-1, 0, 1):
                x, y, z = a + da, b + db, f + df
                out.append(F.when(x.between(0, 255) & y.between(-63, 63) & z.between(1, 63), pair_hash(x, y, z)))
    return F.array_compact(F.array(*out))
