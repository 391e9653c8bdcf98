"""Recordings read from files and written to them, and logs of one file a recording."""

import struct
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators.report import COLUMNS
from tidemark.sources import containers, sinks
from tidemark.sources.containers import recordings

FRAMES = "stream_id long, frame_index long, height int, width int, n_channels int, data binary"


def films(spark, sizes):
    rng, rows = np.random.default_rng(1), []
    for s, (n, h, w, c) in sizes.items():
        rows += [(s, i, h, w, c, bytearray(rng.integers(0, 256, h * w * c, np.uint8).tobytes())) for i in range(n)]
    return spark.createDataFrame(rows, FRAMES)


def read(spark, path, view, **options):
    return recordings(spark, str(path), view, **options)


def test_frames_come_back(spark, tmp_path):
    frames = films(spark, {1: (40, 5, 7, 3), 2: (3, 4, 4, 1), 3: (1, 1, 1, 3)})
    sinks.write_avi(frames, f"{tmp_path}/a", 12.5)
    assert sorted(x.name for x in Path(f"{tmp_path}/a").iterdir()) == ["1.avi", "2.avi", "3.avi"]
    found = read(spark, f"{tmp_path}/a", "frames", split=500)
    assert found.rdd.getNumPartitions() > 10

    def plain(df):
        return sorted(tuple(bytes(v) if isinstance(v, (bytes, bytearray)) else v for v in r) for r in df.collect())

    columns = ["frame_index", "height", "width", "n_channels", "data"]
    assert plain(found.select(F.col("stem").cast("long"), *columns)) == plain(frames.select("stream_id", *columns))
    head = {r.stem: r for r in read(spark, f"{tmp_path}/a", "headers").collect()}
    assert (head["1"].width, head["1"].height, head["1"].frame_count, head["1"].fps, head["1"].error) == (7, 5, 40, 12.5, None)
    assert [r.pts_ms for r in read(spark, f"{tmp_path}/a/2.avi", "stamps").orderBy("frame").collect()] == [0, 80, 160]


def test_bounds_are_pushed_down(spark, tmp_path):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        sinks.write_avi(films(spark, {1: (30, 2, 2, 1)}), str(tmp_path), 10.0)
        found = read(spark, tmp_path, "frames").where("frame_index >= 4 and frame_index < 9 and frame_index != 6")
        assert sorted(r.frame_index for r in found.collect()) == [4, 5, 7, 8]
        assert sorted(r.frame for r in read(spark, tmp_path, "stamps").where("frame = 29").collect()) == [29]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_files_cut_off_or_of_another_kind(spark, tmp_path):
    sinks.write_avi(films(spark, {1: (10, 4, 4, 1)}), str(tmp_path), 10.0)
    whole = (tmp_path / "1.avi").read_bytes()
    at = whole.index(b"movi") + 4 + 3 * 24 + 10
    (tmp_path / "cut.avi").write_bytes(whole[:at])
    for name, data in {"short.avi": whole[:30], "empty.avi": b"", "other.mp4": b"no film at all", "none.mov": b"", "notes.txt": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    head = {r.stem: r for r in read(spark, tmp_path, "headers").collect()}
    assert set(head) == {"1", "cut", "short", "empty", "other", "none"} and head["cut"].frame_count == 10
    assert all(head[k].error and head[k].width is None for k in ("short", "empty", "other", "none"))
    got = read(spark, tmp_path, "frames").where("stem = 'cut'").orderBy("frame_index").collect()
    assert [r.data is not None for r in got] == [True, True, True, False]
    with pytest.raises(Exception, match="none of"):
        read(spark, tmp_path, "pixels").count()


def mp4_file(gaps, scale, shift=None, sound_first=True):
    def box(name, *parts):
        body = b"".join(parts)
        return struct.pack(">I4s", 8 + len(body), name) + body

    def runs(name, values, kind):
        return box(name, b"\0" * 4, struct.pack(">I", len(values)), b"".join(struct.pack(">I" + kind, 1, v) for v in values))

    def track(handler, *tables):
        return box(b"trak", box(b"mdia", box(b"mdhd", b"\0" * 12, struct.pack(">II", scale, sum(gaps)), b"\0" * 4), box(b"hdlr", b"\0" * 8, handler, b"\0" * 12), box(b"minf", box(b"stbl", *tables))))

    entry = box(b"avc1", b"\0" * 24, struct.pack(">HH", 640, 360), b"\0" * 50)
    film = track(b"vide", box(b"stsd", b"\0" * 4, struct.pack(">I", 1), entry), runs(b"stts", gaps, "I"), *([runs(b"ctts", shift, "i")] if shift else []))
    return box(b"ftyp", b"isom") + box(b"mdat", b"\0" * 100) + box(b"moov", *([track(b"soun")] if sound_first else []), film)


def test_stamps_of_mp4(spark, tmp_path):
    (tmp_path / "steady.mp4").write_bytes(mp4_file([40] * 25, 1000))
    (tmp_path / "mixed.mov").write_bytes(mp4_file([10, 30, 20, 20], 100, [20, 40, 0, 10], sound_first=False))
    head = {r.stem: r for r in read(spark, tmp_path, "headers").collect()}
    assert (head["steady"].width, head["steady"].height, head["steady"].frame_count, head["steady"].fps, head["steady"].end_ms) == (640, 360, 25, 25.0, 960.0)
    assert bytes(int(head["steady"].code).to_bytes(4, "little")) == b"avc1"
    assert [r.pts_ms for r in read(spark, tmp_path / "mixed.mov", "stamps").orderBy("frame").collect()] == sorted([200, 500, 400, 700])
    assert read(spark, tmp_path, "frames").count() == 0


LOG = "stream_id long, number int, event string, start_video_time string, end_video_time string, duration_s double, start_wall_clock string, end_wall_clock string, confidence_pct int, status string, detector string, notes string"


def test_logs_of_one_file_a_recording(spark, tmp_path):
    rows = [(1, 2, "b", "1", "2", 1.5, "", "", 90, "detected", "d", 'a "quote", and\nline'), (1, 1, "a", "0", "1", 1.0, "", "", 50, "needs review", "d", ""), (2, 1, "c", "0", "1", 1.0, "", "", 50, "needs review", "d", "é")]
    files = spark.createDataFrame([(1, "one.csv"), (2, "two.csv"), (3, "none.csv")], "stream_id long, file string")
    sinks.write_logs(spark.createDataFrame(rows, LOG), files, str(tmp_path))
    head = ",".join(COLUMNS) + "\r\n"
    assert sorted(x.name for x in tmp_path.iterdir()) == ["none.csv", "one.csv", "two.csv"]
    assert (tmp_path / "none.csv").read_bytes().decode() == head
    assert (tmp_path / "one.csv").read_bytes().decode() == head + 'a,0,1,1.0,,,50,needs review,d,\r\nb,1,2,1.5,,,90,detected,d,"a ""quote"", and\nline"\r\n'
    assert "é" in (tmp_path / "two.csv").read_text()


def test_failed_jobs_leave_no_file(spark, tmp_path):
    frames = films(spark, {1: (5, 2, 2, 1), 2: (5, 2, 2, 1), 3: (5, 2, 2, 1)})
    bad = frames.withColumn("width", F.when((F.col("stream_id") == 3) & (F.col("frame_index") == 4), 3).otherwise(F.col("width")))
    with pytest.raises(Exception, match="not of its recording's size"):
        sinks.write_avi(bad, str(tmp_path), 10.0)
    assert list(tmp_path.iterdir()) == []
    sinks.write_avi(frames, str(tmp_path), 10.0)
    assert len(list(tmp_path.iterdir())) == 3


def test_small_splits_of_large_files_are_bounded(tmp_path, monkeypatch):
    for k, size in enumerate((40_000, 10_000, 10)):
        (tmp_path / f"{k}.avi").write_bytes(b"x" * size)

    def pieces(split):
        found = containers.RecordingReader(str(tmp_path), "frames", split).partitions()
        assert {(p.path, p.number) for p in found} == {(p.path, i) for p in found for i in range(p.of)}
        return len(found)

    assert pieces(1024) == 40 + 10 + 1
    monkeypatch.setattr(containers, "MOST_PIECES", 20)
    assert 17 <= pieces(1024) <= 23 and pieces(10_000) == 6
    monkeypatch.setattr(containers, "SPLIT_BYTES", 100)
    assert pieces(1024) == 51  # no split grows beyond the size that a task reads by default
