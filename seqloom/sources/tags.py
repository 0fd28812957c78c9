"""Titles, artists and albums that audio files carry: WAV INFO chunks, ID3 frames, Vorbis comments of FLAC."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.functions.scalars import track_name
from seqloom.sources.library import EXTENSIONS

FIELDS = ("artist", "title", "album")
#: What the formats call these fields.
INFO = {b"IART": "artist", b"INAM": "title", b"IPRD": "album"}
FRAMES = {b"TPE1": "artist", b"TIT2": "title", b"TALB": "album"}
ENCODINGS = ("latin-1", "utf-16", "utf-16-be", "utf-8")


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, begin and end of RIFF chunks."""
    while at + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, at)
        yield name, at + 8, min(end, at + 8 + size)
        at += 8 + size + size % 2


def _wav(data: bytes) -> dict[str, str]:
    out = {}
    for name, a, b in _chunks(data, 12, len(data)):
        if name == b"LIST" and data[a : a + 4] == b"INFO":
            out |= {INFO[n]: data[x:y].split(b"\0")[0].decode("utf-8", "replace") for n, x, y in _chunks(data, a + 4, b) if n in INFO}
    return out


def _seven(raw: bytes) -> int:
    """A size in seven-bit groups."""
    return sum(b << 7 * k for k, b in enumerate(reversed(raw)))


def _id3(data: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    at, end = 10, min(len(data), 10 + _seven(data[6:10]))
    while at + 10 <= end and data[at] != 0:
        name = data[at : at + 4]
        size = _seven(data[at + 4 : at + 8]) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : min(end, at + 10 + size)]
        if name in FRAMES and body and body[0] < len(ENCODINGS):
            out[FRAMES[name]] = body[1:].decode(ENCODINGS[body[0]], "replace").split("\0")[0]
        at += 10 + size
    return out


def _flac(data: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    at, last = 4, False
    while not last and at + 4 <= len(data):
        kind, size = data[at] & 127, int.from_bytes(data[at + 1 : at + 4], "big")
        last, body, at = data[at] >= 128, data[at + 4 : at + 4 + size], at + 4 + size
        if kind == 4:
            place = 4 + int.from_bytes(body[:4], "little")
            for _ in range(int.from_bytes(body[place : place + 4], "little")):
                place += 4
                n = int.from_bytes(body[place : place + 4], "little")
                field, _, value = body[place + 4 : place + 4 + n].decode("utf-8", "replace").partition("=")
                place += n
                if field.lower() in FIELDS:
                    out.setdefault(field.lower(), value)
    return out


def read_tags(data: bytes) -> dict[str, str]:
    """The fields that a file's bytes name; empty for other formats, and for what a broken file lacks."""
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        return _wav(data)
    if data[:3] == b"ID3":
        return _id3(data)
    if data[:4] == b"fLaC":
        return _flac(data)
    if len(data) >= 128 and data[-128:-125] == b"TAG":
        return {f: data[-128 + a : -128 + a + 30].split(b"\0")[0].decode("latin-1").strip() for f, a in (("title", 3), ("artist", 33), ("album", 63))}
    return {}


def audio_files(spark: SparkSession, root: str) -> DataFrame:
    """Every audio file below ``root`` with its content; files that vanish while they are read are passed over."""
    pattern = "*.{" + ",".join([*EXTENSIONS, *(e.upper() for e in EXTENSIONS)]) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("ignoreMissingFiles", "true").option("pathGlobFilter", pattern).load(root)


def tags(files: DataFrame) -> DataFrame:
    """``(path, artist, title, album, note)`` of files ``(path, content)``: null for a field that is not there, ``note`` says if none is."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [read_tags(c or b"") for c in pdf.content]
            yield pd.DataFrame({"path": pdf.path, **{f: [x.get(f) or None for x in found] for f in FIELDS}, "note": [None if any(x.values()) else "no tags" for x in found]})

    return files.select("path", "content").mapInPandas(run, "path string, artist string, title string, album string, note string")


def named(tags_: DataFrame) -> DataFrame:
    """Tags with the ``name`` of the track: by artist and title, else by the file."""
    return tags_.withColumn("name", track_name(F.col("artist"), F.col("title"), F.col("path")))
