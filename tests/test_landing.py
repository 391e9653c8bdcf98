"""Files that come in, a batch that fails and is repeated, and the purge."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from tests.test_containers import films, mp4_file
from tidemark.sources import sinks
from tidemark.streaming import landing


def test_files_land_once(spark, tmp_path, monkeypatch):
    sinks.write_avi(films(spark, {1: (5, 4, 4, 1), 2: (3, 2, 6, 3)}), f"{tmp_path}/made", 10.0)
    inn = tmp_path / "in"
    (inn / "sub").mkdir(parents=True)
    for name, to in (("1.avi", "a.avi"), ("2.avi", "sub/b.AVI")):
        shutil.copy(tmp_path / "made" / name, inn / to)
    (inn / "c.mp4").write_bytes(mp4_file([40] * 5, 1000))
    (inn / "d.mkv").write_bytes(b"some other kind")
    for name, data in {"e.exe": b"x", "f.avi": b"no film", "g.mp4": b"", "h.avi": b"RIFF" * 5000}.items():
        (inn / name).write_bytes(data)
    where = [str(tmp_path / x) for x in ("in", "store", "records", "check")]
    calls = []
    real = landing.RECORD

    def broken(*a, **k):
        calls.append(1)
        raise RuntimeError("the executor is lost")

    monkeypatch.setattr(landing, "taken", broken)
    q = landing.land(spark, *where, most_bytes=10_000)
    with pytest.raises(Exception, match="the executor is lost"):
        q.awaitTermination()
    monkeypatch.undo()
    for _ in range(2):  # the batch again, and then nothing new
        landing.land(spark, *where, most_bytes=10_000).awaitTermination()
    got = {r.path.rsplit("/", 1)[-1]: r for r in spark.read.parquet(where[2]).collect()}
    assert len(got) == 7 == spark.read.schema(real).parquet(where[2]).count()
    assert {k for k, r in got.items() if r.file} == {"a.avi", "b.AVI", "c.mp4", "d.mkv"}
    assert (got["a.avi"].width, got["a.avi"].frame_count, got["b.AVI"].height, got["c.mp4"].fps) == (4, 5, 2, 25.0)
    assert "not accepted" in got["e.exe"].refused and "cannot be read" in got["f.avi"].refused and "g.mp4" not in got and "too large" in got["h.avi"].refused  # Spark does not offer empty files
    kept = sorted(p.name for p in (tmp_path / "store").iterdir())
    assert kept == sorted(r.file for r in got.values() if r.file) and all(len(r.file.split(".")[0]) == 32 for r in got.values() if r.file)
    assert (tmp_path / "store" / got["a.avi"].file).read_bytes() == (inn / "a.avi").read_bytes()
    # Another file under an old name is another file.
    shutil.copy(tmp_path / "made" / "2.avi", inn / "later.avi")
    landing.land(spark, *where, most_bytes=10_000).awaitTermination()
    assert len(list((tmp_path / "store").iterdir())) == 5


def test_purge_is_repeatable(spark, tmp_path):
    store = tmp_path / "store"
    store.mkdir()
    for name in ("old", "new", "again", "orphan"):
        (store / name).write_bytes(b"x")
    now = dt.datetime(2026, 3, 4, 12)
    used = spark.createDataFrame([("old", now - dt.timedelta(hours=30)), ("new", now - dt.timedelta(hours=2)), ("again", now - dt.timedelta(hours=90)), ("again", now), ("gone", now - dt.timedelta(hours=99))], "file string, used_at timestamp_ntz")
    at = F.lit(now).cast("timestamp_ntz")
    assert {tuple(r) for r in landing.purge(spark, str(store), used, at).collect()} == {("old", "expired"), ("orphan", "no record")}
    assert sorted(p.name for p in store.iterdir()) == ["again", "new"]
    assert landing.purge(spark, str(store), used, at).count() == 0
    assert landing.purge(spark, str(tmp_path / "none"), used, at).count() == 0
