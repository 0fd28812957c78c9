"""What is written for people and other programs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqloom.functions.scalars import format_timecode


def quoted(c: Column) -> Column:
    """A CSV field: quoted where it holds a comma, a quote or a line end."""
    text = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(text.rlike("[\",\\r\\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_lines(df: DataFrame, decimals: dict[str, int]) -> DataFrame:
    """``line``: the columns of each row as CSV, doubles with fixed decimals."""
    of = lambda c: F.format_string(f"%.{decimals[c]}f", F.col(c)) if c in decimals else F.col(c)
    return df.select(F.concat_ws(",", *(quoted(F.when(F.col(c).isNull(), F.lit(None)).otherwise(of(c))) for c in df.columns)).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def cue_line(track: Column, title: Column, frame: Column) -> Column:
    """Lines of a cue sheet for a track that starts at a frame (75 a second)."""
    at = F.format_string("%02d:%02d:%02d", F.floor(frame / 4500).cast("int"), (F.floor(frame / 75) % 60).cast("int"), (frame % 75).cast("int"))
    return F.concat(F.format_string("  TRACK %02d AUDIO\n", track.cast("int")), F.lit('    TITLE "'), F.replace(title, F.lit('"'), F.lit("'")), F.lit('"\n    INDEX 01 '), at)


def timeline(start: Column, end: Column, total: Column, width: int = 60) -> Column:
    """A bar of ``width`` characters with the interval filled, at least one."""
    a = F.floor(start / total * width).cast("int")
    b = F.greatest(a + 1, F.ceil(end / total * width).cast("int"))
    return F.concat(F.repeat(F.lit("."), a), F.repeat(F.lit("#"), b - a), F.repeat(F.lit("."), F.greatest(F.lit(0), width - b)))


def table_line(start: Column, end: Column, level: Column, name: Column) -> Column:
    return F.concat(F.lpad(format_timecode(start), 8, " "), F.lit(" "), F.lpad(format_timecode(end), 8, " "), F.lit("  "), F.rpad(level, 10, " "), name)
