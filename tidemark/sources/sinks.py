"""Sinks that write one file a recording, through a data source of Spark's: event logs as CSV, frames as uncompressed AVI.

A task writes beside its target, under a name of its own attempt; files get their names when all tasks have succeeded, and a job that fails leaves none. So a task that runs twice, or dies half-way, changes nothing."""

import csv
import io
import struct
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from tidemark.operators.report import COLUMNS
from tidemark.sources.containers import file_system

PENDING = "_pending"


@dataclass
class Written(WriterCommitMessage):
    #: (where it is, where it goes)
    files: list[tuple[str, str]] = field(default_factory=list)


class OneFileEach(DataSourceWriter):
    """Rows (file name first) come sorted by file; `rows_of` writes those of one file."""

    suffix = ""

    def __init__(self, path: str, options: dict):
        self.path, self.options, self.job = path, dict(options), uuid.uuid4().hex

    def _folder(self) -> tuple[pafs.FileSystem, str, str]:
        fs, path = file_system(self.path)
        return fs, path, f"{path}/{PENDING}-{self.job}"

    def write(self, rows) -> Written:
        fs, path, pending = self._folder()
        fs.create_dir(pending, recursive=True)
        own, name, out, done = uuid.uuid4().hex, None, None, Written()
        try:
            for row in rows:
                if row[0] != name:
                    if out:
                        self.end(out)
                    name, at = row[0], f"{pending}/{own}-{len(done.files)}"
                    out = self.begin(fs.open_output_stream(at))
                    done.files.append((at, f"{path}/{name}{self.suffix}"))
                self.add(out, row[1:])
            if out:
                self.end(out)
        except BaseException:
            for at, _ in done.files:
                if fs.get_file_info(at).type == pafs.FileType.File:
                    fs.delete_file(at)
            raise
        return done

    def commit(self, messages) -> None:
        fs, _, pending = self._folder()
        for m in messages:
            for at, to in m.files if m else ():
                fs.move(at, to)
        if fs.get_file_info(pending).type == pafs.FileType.Directory:
            fs.delete_dir(pending)

    def abort(self, messages) -> None:
        fs, _, pending = self._folder()
        if fs.get_file_info(pending).type == pafs.FileType.Directory:
            fs.delete_dir(pending)


class LogWriter(OneFileEach):
    def begin(self, stream):
        text = io.TextIOWrapper(stream, "utf-8", newline="")
        csv.writer(text, lineterminator="\r\n").writerow(COLUMNS)
        return text

    def add(self, text, row) -> None:
        if row[0] is not None:  # a recording without events has the header alone
            csv.writer(text, lineterminator="\r\n").writerow(["" if v is None else v for v in row[1:]])

    def end(self, text) -> None:
        text.close()


class AviWriter(OneFileEach):
    """Uncompressed frames of one size, grey or blue, green, red. The header needs the number of frames, which comes with the rows, so that frames are written as they come."""

    suffix = ".avi"

    def begin(self, stream):
        return {"stream": stream, "at": 4, "index": []}

    def add(self, out, row) -> None:
        i, n, fps, height, width, channels, data = row
        stride = -(-width * channels // 4) * 4
        if not out["index"]:
            out |= {"size": (height, width, channels), "n": n}
            out["stream"].write(avi_header(n, fps, height, width, channels))
        if (height, width, channels) != out["size"] or len(data) != height * width * channels:
            raise ValueError(f"frame {i} is not of its recording's size")
        levels = np.zeros((height, stride), np.uint8)
        levels[:, : width * channels] = np.frombuffer(data, np.uint8).reshape(height, width * channels)[::-1]
        out["stream"].write(struct.pack("<4sI", b"00db", levels.size) + levels.tobytes())
        out["index"].append((out["at"], levels.size))
        out["at"] += 8 + levels.size

    def end(self, out) -> None:
        if len(out["index"]) != out["n"]:
            raise ValueError(f"{len(out['index'])} frames of {out['n']}")
        rows = b"".join(struct.pack("<4sIII", b"00db", 0x10, at, n) for at, n in out["index"])
        out["stream"].write(struct.pack("<4sI", b"idx1", len(rows)) + rows)
        out["stream"].close()


def avi_header(n: int, fps: float, height: int, width: int, channels: int) -> bytes:
    """All that stands before the first frame."""

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack("<4sI", name, len(body)) + body + b"\0" * (len(body) % 2)

    frame = -(-width * channels // 4) * 4 * height
    palette = b"".join(bytes((k, k, k, 0)) for k in range(256)) if channels == 1 else b""
    main = struct.pack("<14I", round(1e6 / fps), round(frame * fps), 0, 0x10, n, 0, 1, frame, width, height, 0, 0, 0, 0)
    head = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"DIB ", 0, 0, 0, 0, 1000, round(1000 * fps), 0, n, frame, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 * channels, 0, frame, 0, 0, 256 if palette else 0, 0) + palette
    lists = chunk(b"LIST", b"hdrl" + chunk(b"avih", main) + chunk(b"LIST", b"strl" + chunk(b"strh", head) + chunk(b"strf", form)))
    movie = 4 + n * (8 + frame)
    if 4 + len(lists) + 8 + movie + 8 + 16 * n >= 1 << 32:
        raise ValueError("an AVI file holds 4 GB at most")
    return struct.pack("<4sI4s", b"RIFF", 4 + len(lists) + 8 + movie + 8 + 16 * n, b"AVI ") + lists + struct.pack("<4sI4s", b"LIST", movie, b"movi")


class LogSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_log"

    def writer(self, schema, overwrite) -> LogWriter:
        return LogWriter(self.options["path"], self.options)


class AviSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "avi"

    def writer(self, schema, overwrite) -> AviWriter:
        return AviWriter(self.options["path"], self.options)


def write_logs(rows: DataFrame, recordings: DataFrame, path: str) -> None:
    """Writes the log of each recording to its own file: rows as of report.export_rows, recordings (stream_id, file: its file's name). A recording without events has a file with a header."""
    rows.sparkSession.dataSource.register(LogSink)
    logs = recordings.select("stream_id", "file").join(rows, "stream_id", "left").select("file", "number", *COLUMNS)
    logs.repartition("file").sortWithinPartitions("file", "number").write.format("event_log").mode("append").save(path)


def as_bytes(frames: DataFrame) -> DataFrame:
    """frames with their pixels (whole grey levels) as n_channels and data."""
    kept = [c for c in frames.columns if c not in ("pixels", "n_channels")]

    def run(batches):
        for batch in batches:
            levels = batch.column("pixels")
            flat, at = levels.values.to_numpy(zero_copy_only=False).astype(np.uint8), levels.offsets.to_numpy()
            data = [flat[a:b].tobytes() if ok else None for a, b, ok in zip(at[:-1], at[1:], levels.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([1] * len(data), pa.int32()), pa.array(data, pa.binary())], [*kept, "n_channels", "data"])

    schema = frames.select(*kept, F.lit(None).cast("int").alias("n_channels"), F.lit(None).cast("binary").alias("data")).schema
    return frames.select(*kept, "pixels").mapInArrow(run, schema)


def write_avi(frames: DataFrame, path: str, fps: float) -> None:
    """Writes the frames of each stream (stream_id, frame_index, height, width, and n_channels and data, or pixels of whole grey levels) to <stream_id>.avi. All frames must be readable, and of one size in a stream."""
    frames.sparkSession.dataSource.register(AviSink)
    if "data" not in frames.columns:
        frames = as_bytes(frames)
    n = frames.groupBy("stream_id").agg(F.count("*").alias("n"))
    rows = frames.join(n, "stream_id").select(F.col("stream_id").cast("string").alias("file"), "frame_index", "n", F.lit(float(fps)).alias("fps"), *(F.col(c).cast("int") for c in ("height", "width", "n_channels")), "data")
    rows.repartition("file").sortWithinPartitions("file", "frame_index").write.format("avi").mode("append").save(path)
