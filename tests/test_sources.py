"""Files in and out: WAV to peaks and back to a track, listings, manifests, streams."""

import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqloom.functions.scalars import FRAMES_PER_SECOND
from seqloom.operators import index
from seqloom.plans import compose
from seqloom.sources import audio, configs, library
from seqloom.streaming import plays as streams


def wav(path, x, rate=8000, declared=None):
    raw = (np.clip(x, -1, 1) * 32767).astype("<i2").tobytes()
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(raw), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", declared or len(raw))
    path.write_bytes(head + raw)


def tune(seed, seconds):
    """Notes that change every quarter second."""
    rng = np.random.default_rng(seed)
    t = np.arange(int(seconds * 8000)) / 8000
    out = np.zeros(len(t))
    for k in range(int(seconds * 4)):
        part = slice(k * 2000, (k + 1) * 2000)
        env = np.exp(-np.arange(2000) / 700)
        for f in rng.uniform(150, 3500, 4):
            out[part] += 0.2 * np.sin(2 * np.pi * f * t[part]) * env[: len(out[part])]
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("library")
    a, b = tune(1, 45), tune(2, 45)
    wav(root / "a.wav", a)
    wav(root / "b.wav", b)
    (root / "bad.wav").write_bytes(b"RIFF....nothing")
    wav(root / "cut.wav", tune(3, 4), declared=200_000)
    (root / ".hidden.wav").write_bytes(b"")
    (root / "notes.txt").write_text("x")
    return root, a, b


def test_peaks_do_not_depend_on_blocks(folder):
    _, a, _ = folder
    assert audio.analyse(a[:80000], 4096) == audio.analyse(a[:80000], 97)
    assert audio.analyse(np.zeros(100)) == []


def test_wav_round_trip(folder, spark):
    root, a, _ = folder
    rate, x, declared = audio.read_wav((root / "a.wav").read_bytes())
    assert rate == 8000 and declared == 45.0 and np.abs(x[:, 0] - np.clip(a, -1, 1)).max() < 1e-3
    heads = {r.path.split("/")[-1]: r for r in audio.heads(audio.wav_files(spark, str(root))).collect()}
    assert heads["bad.wav"].error and heads["a.wav"].error is None
    cut = audio.truncated(audio.heads(audio.wav_files(spark, str(root)))).collect()
    assert [r.path.split("/")[-1] for r in cut] == ["cut.wav"]


@pytest.mark.parametrize("speed", [1.0, 1.03])
def test_a_track_played_in_a_mix_is_found(folder, spark, speed, tmp_path):
    root, a, b = folder
    mix = np.concatenate([tune(9, 10), audio.at_speed(audio.excerpt(a, 8000, 5, 35), speed), tune(8, 12)])
    wav(tmp_path / "mix.wav", mix)
    heads, peaks = compose.ingest(spark, str(root))
    _, query = compose.ingest(spark, str(tmp_path))
    query = query.withColumn("query_id", F.lit(0).cast("long")).drop("asset_id")
    ladder = index.speed_ladder(spark, 0.98, 0.01, 7, ["turntable"])
    hashes = compose.query_hashes(query, ladder)
    from seqloom.operators import align

    found = align.search(hashes, compose.build_index(peaks)).join(heads, "asset_id").orderBy(F.desc("hits")).collect()
    best = found[0]
    assert best.path.endswith("/a.wav") and abs(best.speed - speed) < 0.003
    assert abs(best.start / FRAMES_PER_SECOND - 10) < 5 and abs(best.end / FRAMES_PER_SECOND - 10 - 35 / speed) < 5
    assert not [r for r in found if not r.path.endswith("/a.wav") and r.hits > best.hits / 3]


def test_listing_and_survey(folder, spark):
    root, _, _ = folder
    scanned = library.scan(library.listing(spark, str(root)), ["cut*"])
    assert sorted(r.path for r in library.assets(scanned).collect()) == ["a.wav", "b.wav", "bad.wav"]
    why = {r.reason: r["count"] for r in library.skipped(scanned).collect()}
    assert why["ignored"] == 1 and why["extension"] == 1
    stored = library.assets(scanned).where("path <> 'b.wav'").select("path", F.when(F.col("path") == "a.wav", F.col("size")).otherwise(0).alias("size"), "modified").unionByName(spark.createDataFrame([("gone.wav", 1)], "path string, size long").withColumn("modified", F.current_timestamp()))
    state = {r.path: r.state for r in library.survey(scanned, stored).collect()}
    assert state["a.wav"] == "current" and state["bad.wav"] == "stale" and state["b.wav"] == "unindexed" and state["gone.wav"] == "orphan"
    assert [r.path for r in library.pruned(stored, scanned).collect()] == ["gone.wav"]
    none = spark.createDataFrame([], "path string, size long, modified timestamp, seconds double")
    assert sorted(r.path for r in library.to_index(library.assets(scanned), stored, none, None, None).collect()) == ["b.wav", "bad.wav"]


def test_library_map_uses_each_file_once(spark):
    s = "path string, size int, seconds int, digest int"
    a = spark.createDataFrame([("a1", 5, 1, 1), ("a2", 6, 1, 1), ("a3", 9, 2, 2)], s)
    b = spark.createDataFrame([("b1", 6, 1, 1), ("b2", 7, 1, 1), ("b3", 7, 1, 1)], s)
    assert {(r.a_path, r.b_path) for r in library.library_map(a, b).collect()} == {("a2", "b1"), ("a1", "b2")}


def test_manifests_and_judgments(spark, tmp_path):
    (tmp_path / "set.toml").write_text('title = "T"\naudio = "mix.wav"\n[[track]]\nposition = 1\nartist = "A"\ntitle = "B"\nstart = "1:30"\nreference = ["a.wav"]\n[[track]]\nposition = 2\nstart = "5:00"\n')
    m = configs.read_manifests(spark, [str(tmp_path / "set.toml")])
    assert [(r.position, r.start_s, list(r.references)) for r in m.orderBy("position").collect()] == [(1, 90.0, ["a.wav"]), (2, 300.0, [])]
    assert configs.unknown_references(m, spark.createDataFrame([("b.wav",)], "path string")).count() == 1
    (tmp_path / "v.txt").write_text("# note\nsame\ta\tb\n\ndifferent\ta\tc\n")
    assert {tuple(r) for r in configs.read_judgments(spark, str(tmp_path / "v.txt")).collect()} == {("same", "a", "b"), ("different", "a", "c")}


def test_reports(spark, tmp_path):
    text = '{"schema_version": 3, "query": {"path": "m", "size": 1}, "plays": [{"asset_id": 1, "start": 5, "end": 2, "hits": 3}]}\n{"schema_version": 2, "query": {"path": "n"}}\n{"schema_version": 3, "query": {"path": "o"}}\n'
    (tmp_path / "r.json").write_text(text)
    got = {r.path: r.fault for r in configs.validity(configs.read_reports(spark, str(tmp_path / "r.json"))).collect()}
    assert got == {"m": "play", "n": "version"}


def test_streamed_plays(spark, tmp_path):
    rows = [(1, 1, 0, 50, 5), (1, 1, 100, 150, 6), (1, 1, 400, 410, 7), (2, 1, 20, 30, 1), (1, 9, 9000, 9001, 1)]
    stamp = lambda s: pd.Timestamp(s + 10**6, unit="s")
    for n, part in enumerate((rows[:3], rows[3:])):
        pd.DataFrame([(q, a, stamp(s), stamp(e), h) for q, a, s, e, h in part], columns=["query_id", "asset_id", "start", "end", "hits"]).astype({"start": "datetime64[us]", "end": "datetime64[us]"}).to_parquet(tmp_path / f"{n}.parquet")
    source = spark.readStream.schema("query_id long, asset_id long, start timestamp, end timestamp, hits long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path))
    q = streams.streamed_plays(source).writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.query_id, r.asset_id, r.start.timestamp(), r.end.timestamp(), r.hits) for r in spark.table("streamed").collect())
    zone = got[0][2] - 0  # the driver's own zone
    assert [(a, b, c - zone, d - zone, h) for a, b, c, d, h in got] == [(1, 1, 0, 150, 11), (1, 1, 400, 410, 7), (2, 1, 20, 30, 1)]


def test_growing_table(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "path string, modified long, seconds double"
    for n, rows in enumerate(([("a", 1, 5.0), ("b", 1, 6.0)], [("a", 2, 7.0)])):
        pd.DataFrame(rows, columns=["path", "modified", "seconds"]).to_parquet(tmp_path / "in" / f"{n}.parquet")
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streams.growing(stream, str(tmp_path / "t"), str(tmp_path / "ck"), "path", "modified").awaitTermination(120)
    assert {(r.path, r.seconds) for r in streams.current(spark, str(tmp_path / "t"), "path", "modified").collect()} == {("a", 7.0), ("b", 6.0)}


def riff(*chunks):
    body = b"".join(n + len(c).to_bytes(4, "little") + c + b"\0" * (len(c) % 2) for n, c in chunks)
    return b"RIFF" + (len(body) + 4).to_bytes(4, "little") + b"WAVE" + body


def id3(version, *frames):
    size = lambda n: bytes(n >> 7 * k & 127 for k in (3, 2, 1, 0)) if version == 4 else n.to_bytes(4, "big")
    body = b"".join(n + size(len(c)) + b"\0\0" + c for n, c in frames) + b"\0" * 20
    return b"ID3" + bytes([version, 0, 0]) + bytes(len(body) >> 7 * k & 127 for k in (3, 2, 1, 0)) + body


def flac(*comments):
    texts = b"".join(len(c).to_bytes(4, "little") + c for c in comments)
    block = (4).to_bytes(4, "little") + b"made" + len(comments).to_bytes(4, "little") + texts
    return b"fLaC" + b"\0\0\0\x02ab" + b"\x84" + len(block).to_bytes(3, "big") + block


def test_tags(spark, tmp_path):
    from seqloom.sources import tags

    info = riff((b"fmt ", b"x" * 16), (b"LIST", b"INFO" + b"INAM" + (4).to_bytes(4, "little") + b"One\0" + b"IART" + (3).to_bytes(4, "little") + b"Ann\0"))
    files = {
        "a.wav": (info, ("Ann", "One", None, None, "Ann - One")),
        "b.mp3": (id3(3, (b"TIT2", b"\x00Caf\xe9"), (b"TXXX", b"\0x"), (b"TALB", b"\x01" + "Ünder".encode("utf-16"))), (None, "Café", "Ünder", None, "Café")),
        "c.MP3": (id3(4, (b"TPE1", b"\x03Zo\xc3\xab\0more"), (b"TIT2", b"\x03" + b"t" * 200)), ("Zoë", "t" * 200, None, None, "Zoë - " + "t" * 200)),
        "d.flac": (flac(b"TITLE=Deep", b"artist=Dee", b"ARTIST=Other", b"x=y"), ("Dee", "Deep", None, None, "Dee - Deep")),
        "e.mp3": (b"\xff\xfb" * 100 + b"TAG" + b"Old".ljust(30, b"\0") + b"Who".ljust(30) + b"\0" * 65, ("Who", "Old", None, None, "Who - Old")),
        "f.m4a": (b"\0\0\0\x18ftypM4A ", (None, None, None, "no tags", "f")),
        "g.wav": (b"R", (None, None, None, "no tags", "g")),
        "h.mp3": (b"ID3\x03\0\0\0\0\x7f\x7fTIT2\0\0", (None, None, None, "no tags", "h")),
    }
    for name, (data, _) in files.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "notes.txt").write_text("no audio")
    got = {r.path.rsplit("/")[-1]: (r.artist, r.title, r.album, r.note, r.name) for r in tags.named(tags.tags(tags.audio_files(spark, str(tmp_path)))).collect()}
    assert got == {n: want for n, (_, want) in files.items()}


def test_vanished_files_are_counted(spark):
    listed = spark.createDataFrame([("a", None), ("b", None), ("c", "ignored")], "path string, reason string")
    assert [r.path for r in library.vanished(listed, spark.createDataFrame([("a",)], "path string")).collect()] == ["b"]


def test_written_tables_can_be_discarded(spark):
    import os

    from seqloom.session import discard, materialise

    path = materialise(spark.range(3), "kept").inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path) and discard(spark) >= 1
    assert not os.path.exists(os.path.dirname(path)) and discard(spark) == 0


def test_settings_by_layer(tmp_path):
    path = tmp_path / "settings.toml"
    path.write_text('playback = "turntable"\nmin_track = 5.0\n')
    got = configs.settings({"min_track": None, "peaks_dir": "x"}, {"playback": "key-locked"}, str(path))
    assert got == {**configs.DEFAULTS, "playback": "key-locked", "min_track": 5.0, "peaks_dir": "x"}
    assert configs.settings({}) == configs.DEFAULTS
    with pytest.raises(ValueError, match="no file can be a track"):
        configs.settings({"min_track": configs.DEFAULTS["max_track"]})
    path.write_text("speed = 3\n")
    with pytest.raises(ValueError, match="unknown settings: speed"):
        configs.settings({}, file=str(path))


def test_strongest_traces(spark):
    from seqloom.operators.align import strongest_traces

    rows = [(1, 7, 30), (1, 7, 5), (1, 8, 30), (1, 9, 12), (2, 9, 1)]
    got = strongest_traces(spark.createDataFrame(rows, "query_id int, asset_id int, hits int"), 2).collect()
    assert sorted(map(tuple, got)) == [(1, 7, 5), (1, 7, 30), (1, 8, 30), (2, 9, 1)]
