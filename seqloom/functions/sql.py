"""The scalar functions under names that SQL can call, as SQL functions that Catalyst inlines; and peaks as a table function."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

#: name, parameters, result, body.
FUNCTIONS = [
    ("pair_hash", "level INT, dbin INT, dframe INT", "INT", "shiftleft(level, 13) | shiftleft(dbin + 63, 6) | dframe"),
    ("normalise_name", "name STRING", "STRING", r"nullif(trim(regexp_replace(lower(name), '[^\\p{L}\\p{N}]+', ' ')), '')"),
    ("evidence_level", "hits BIGINT, windows BIGINT", "STRING", "CASE WHEN hits >= 200 AND windows >= 3 THEN 'confident' WHEN hits >= 60 THEN 'possible' ELSE 'weak' END"),
    ("same_passage", "a0 DOUBLE, a1 DOUBLE, b0 DOUBLE, b1 DOUBLE", "BOOLEAN", "greatest(0, least(a1, b1) - greatest(a0, b0)) >= 0.5 * least(a1 - a0, b1 - b0)"),
    ("zero_time", "start DOUBLE, track_start DOUBLE, speed DOUBLE", "DOUBLE", "start - track_start / speed"),
    ("rarity_weight", "len BIGINT", "DOUBLE", "1 / ln(e() + len)"),
]


@udtf(returnType="seq int, frame64 long, bin64 int, mag_half_db int")
class WavPeaks:
    """``SELECT * FROM wav_peaks(content)``: peaks of one WAV file's bytes; none if it can't be read."""

    def eval(self, content: bytes):
        import struct

        from seqloom.functions.scalars import SAMPLE_RATE
        from seqloom.sources.audio import analyse, read_wav, resampled

        try:
            rate, x, _ = read_wav(content)
        except (ValueError, struct.error, TypeError):
            return
        for i, (_, frame, b, db) in enumerate(analyse(resampled(x.mean(1), rate, SAMPLE_RATE))):
            yield i, frame, b, db


def register(spark: SparkSession) -> None:
    """Makes the functions known to a session."""
    for name, parameters, result, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {result} RETURN {body}")
    spark.udtf.register("wav_peaks", WavPeaks)
