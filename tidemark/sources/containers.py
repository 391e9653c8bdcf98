"""Recordings in AVI and MP4 files as tables, through a data source of Spark's: headers, stamps of frames, and frames that need no codec.

    recordings(spark, folder, "frames")

One row a file (`headers`), one a frame (`stamps`), or one a frame with its levels (`frames`, uncompressed AVI). A file is cut into ranges of frames by its size, so that one long recording is read by several tasks; where the
session has filter pushdown for Python sources on, bounds on frame numbers are pushed down, and what lies outside is not read. Executors open files by themselves, from the local or a mounted file system, HDFS or an object store."""

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SUFFIXES = (".avi", ".mp4", ".m4v", ".mov")
SCHEMAS = {
    "headers": "path string, stem string, container string, code long, width int, height int, frame_count long, fps double, end_ms double, error string",
    "stamps": "path string, stem string, frame long, pts_ms double",
    "frames": "path string, stem string, frame_index long, height int, width int, n_channels int, data binary",
}
#: Bytes of a file that one task reads of its frames, and tasks among which smaller splits are dealt out at most: each reads its file's index, and costs more than it reads if it is small.
SPLIT_BYTES, MOST_PIECES = 128 << 20, 1000


class BrokenFile(ValueError):
    pass


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path there. Hadoop writes local URIs with one slash."""
    if path.startswith("file:/") and not path.startswith("file:///"):
        path = "file://" + path.removeprefix("file:")
    return pafs.FileSystem.from_uri(path)


def _take(f, at: int, n: int) -> bytes:
    f.seek(at)
    got = f.read(n)
    if len(got) < n:
        raise BrokenFile(f"cut off at byte {at + len(got)}")
    return got


def riff_chunks(f, at: int, end: int) -> Iterator[tuple[bytes, bytes, int, int]]:
    """(name, list type or b'', first byte, length) of the chunks between two places; a file that is cut off ends there."""
    while at + 8 <= end:
        try:
            name, n = struct.unpack("<4sI", _take(f, at, 8))
            kind = _take(f, at + 8, 4) if name in (b"RIFF", b"LIST") and n >= 4 else b""
        except BrokenFile:
            return
        yield name, kind, at + 8, n
        at += 8 + n + n % 2


@dataclass
class Avi:
    code: int
    width: int
    height: int
    count: int
    fps: float
    bits: int
    compression: int
    movie: tuple[int, int]
    #: First byte of each frame's levels, where the file's index or the frames' equal sizes give them.
    places: np.ndarray


def avi(f, size: int, with_places: bool = True) -> Avi:
    """What the header of an AVI file says; the first video stream counts."""
    if size < 12 or _take(f, 0, 4) != b"RIFF" or _take(f, 8, 4) != b"AVI ":
        raise BrokenFile("no AVI file")
    found, streams, movie, index = None, 0, None, None
    for name, kind, at, n in riff_chunks(f, 12, size):
        if kind == b"hdrl":
            for own, own_kind, p, m in riff_chunks(f, at + 4, at + n):
                if own_kind != b"strl":
                    continue
                parts = {x: (a, k) for x, _, a, k in riff_chunks(f, p + 4, p + m)}
                if found is None and b"strh" in parts and b"strf" in parts and _take(f, parts[b"strh"][0], 4) == b"vids":
                    head, form = _take(f, parts[b"strh"][0], 36), _take(f, parts[b"strf"][0], 20)
                    scale, rate, _, length = struct.unpack("<4I", head[20:36])
                    width, height, _, bits, compression = struct.unpack("<iiHHI", form[4:20])
                    code = compression or int.from_bytes(head[4:8], "little")
                    found = (streams, code, width, height, length, rate / scale if scale else 0.0, bits, compression)
                streams += 1
        elif kind == b"movi":
            movie = (at, n)
        elif name == b"idx1" and at + n <= size:
            index = (at, n)
    if found is None or movie is None:
        raise BrokenFile("no video stream")
    number, code, width, height, length, fps, bits, compression = found
    places = np.zeros(0, np.int64)
    if with_places:
        names = {b"%02ddb" % number, b"%02ddc" % number}
        if index:
            rows = np.frombuffer(_take(f, *index), np.dtype([("name", "S4"), ("flags", "<u4"), ("at", "<u4"), ("n", "<u4")]))
            own = rows[np.isin(rows["name"], list(names))]["at"].astype(np.int64)
            # Places count from the list's type, or from the start of the file.
            base = movie[0] if len(own) and own[0] < movie[0] else 0
            places = own + base + 8
        else:
            places = np.array([a for x, _, a, _ in riff_chunks(f, movie[0] + 4, movie[0] + movie[1]) if x in names], np.int64)
    return Avi(code, width, height, length, fps, bits, compression, movie, places)


def avi_frame(f, head: Avi, i: int) -> tuple[int, int, int, bytes] | None:
    """Height, width, channels and levels of an uncompressed frame, by row from the top; None if it is cut off."""
    channels, height = head.bits // 8, abs(head.height)
    stride = -(-head.width * head.bits // 32) * 4
    try:
        rows = np.frombuffer(_take(f, int(head.places[i]), stride * height), np.uint8).reshape(height, stride)
    except BrokenFile:
        return None
    if head.height > 0:  # stored from the bottom
        rows = rows[::-1]
    return height, head.width, channels, np.ascontiguousarray(rows[:, : head.width * channels]).tobytes()


def boxes(f, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, first byte, end) of the boxes of an MP4 file between two places."""
    while at + 8 <= end:
        n, name = struct.unpack(">I4s", _take(f, at, 8))
        first = at + 8
        if n == 1:
            n, first = struct.unpack(">Q", _take(f, at + 8, 8))[0], at + 16
        stop = end if n == 0 else at + n
        if stop < first:
            raise BrokenFile(f"a box without length at byte {at}")
        yield name, first, min(stop, end)
        at = stop


@dataclass
class Mp4:
    code: int
    width: int
    height: int
    count: int
    fps: float
    end_ms: float
    stamps: np.ndarray


def mp4(f, size: int) -> Mp4:
    """The first video track: codec, size, and when each sample is shown, in order of time."""
    top = {name: (a, b) for name, a, b in boxes(f, 0, size)}
    if b"moov" not in top:
        raise BrokenFile("no index of samples")
    for name, a, b in boxes(f, *top[b"moov"]):
        if name != b"trak":
            continue
        media = {n: (x, y) for n, x, y in boxes(f, *dict((n, (x, y)) for n, x, y in boxes(f, a, b)).get(b"mdia", (0, 0)))}
        if b"hdlr" not in media or _take(f, media[b"hdlr"][0] + 8, 4) != b"vide":
            continue
        table = dict((n, (x, y)) for n, x, y in boxes(f, *dict((n, (x, y)) for n, x, y in boxes(f, *media[b"minf"]))[b"stbl"]))
        head = _take(f, media[b"mdhd"][0], 24)
        scale = struct.unpack(">I", head[20:24] if head[0] else head[12:16])[0]
        x = table[b"stsd"][0]
        entry = _take(f, x + 8, 36)
        width, height = struct.unpack(">HH", entry[32:36])
        gaps = _runs(f, table[b"stts"][0], ">u4")
        stamps = np.concatenate([[0], np.cumsum(gaps)])[: len(gaps)]
        if b"ctts" in table:
            shift = _runs(f, table[b"ctts"][0], ">i4")[: len(stamps)]
            stamps = np.sort(stamps[: len(shift)] + shift)
        ms = stamps * 1000.0 / max(1, scale)
        total = gaps.sum() / max(1, scale)
        return Mp4(int.from_bytes(entry[4:8], "little"), width, height, len(ms), len(ms) / total if total else 0.0, float(ms[-1]) if len(ms) else 0.0, ms)
    raise BrokenFile("no video track")


def _runs(f, at: int, kind: str) -> np.ndarray:
    n = struct.unpack(">I", _take(f, at + 4, 4))[0]
    rows = np.frombuffer(_take(f, at + 8, 8 * n), np.dtype([("k", ">u4"), ("v", kind)]))
    return np.repeat(rows["v"].astype(np.int64), rows["k"])


@dataclass
class Piece(InputPartition):
    path: str
    size: int
    number: int
    of: int

    def __hash__(self):
        return hash((self.path, self.number))


class RecordingReader(DataSourceReader):
    def __init__(self, path: str, view: str, split: int):
        self.path, self.view, self.split = path, view, split
        self.low, self.high = 0, 1 << 62

    def partitions(self) -> list[Piece]:
        fs, path = file_system(self.path)
        info = fs.get_file_info(path)
        files = [info] if info.type == pafs.FileType.File else fs.get_file_info(pafs.FileSelector(path, recursive=True))
        files = [x for x in files if x.type == pafs.FileType.File and x.path.lower().endswith(SUFFIXES)]
        split = max(self.split, min(SPLIT_BYTES, -(-sum(x.size for x in files) // MOST_PIECES)))
        pieces = [(x, -(-x.size // split) if self.view == "frames" else 1) for x in sorted(files, key=lambda x: x.path)]
        return [Piece(x.path, x.size, i, max(1, n)) for x, n in pieces for i in range(max(1, n))]

    def read(self, piece: Piece) -> Iterator[tuple]:
        fs, _ = file_system(self.path)
        stem = piece.path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
        is_avi = piece.path.lower().endswith(".avi")
        with fs.open_input_file(piece.path) as f:
            try:
                head = avi(f, piece.size, self.view != "headers") if is_avi else mp4(f, piece.size)
            except (BrokenFile, struct.error, KeyError, ValueError) as e:
                if self.view == "headers":
                    yield (piece.path, stem, "avi" if is_avi else "mp4", None, None, None, None, None, None, str(e) or type(e).__name__)
                return
            if self.view == "headers":
                end = None if is_avi else head.end_ms
                yield (piece.path, stem, "avi" if is_avi else "mp4", head.code, head.width, abs(head.height), head.count, head.fps, end, None)
                return
            n = len(head.places) if is_avi else head.count
            low, high = max(self.low, n * piece.number // piece.of), min(self.high + 1, n * (piece.number + 1) // piece.of)
            if self.view == "stamps":
                for i in range(low, high):
                    yield (piece.path, stem, i, i * 1000.0 / head.fps if is_avi else float(head.stamps[i]))
            elif is_avi and head.compression == 0 and head.bits in (8, 24, 32):
                for i in range(low, high):
                    yield (piece.path, stem, i, *(avi_frame(f, head, i) or (None, None, None, None)))


class PushingReader(RecordingReader):
    """A reader that takes bounds on frame numbers; Spark refuses it where pushdown is off."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        column = ("frame_index",) if self.view == "frames" else ("frame",)
        for x in filters:
            whole = isinstance(getattr(x, "value", None), int) and getattr(x, "attribute", None) == column and self.view != "headers"
            if whole and isinstance(x, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, x.value + isinstance(x, GreaterThan))
            if whole and isinstance(x, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, x.value - isinstance(x, LessThan))
            if not (whole and isinstance(x, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))):
                yield x


class RecordingSource(DataSource):
    """Options: path (a file or folder), view (headers, stamps or frames), split (bytes of frames a task), pushdown (whether the session has it on)."""

    @classmethod
    def name(cls) -> str:
        return "recording"

    def _view(self) -> str:
        view = self.options.get("view", "headers")
        if view not in SCHEMAS:
            raise ValueError(f"view = {view!r} is none of {', '.join(SCHEMAS)}")
        return view

    def schema(self) -> str:
        return SCHEMAS[self._view()]

    def reader(self, schema) -> RecordingReader:
        kind = PushingReader if self.options.get("pushdown", "false") == "true" else RecordingReader
        return kind(self.options["path"], self._view(), int(self.options.get("split", SPLIT_BYTES)))


def recordings(spark: SparkSession, path: str, view: str = "headers", split: int = SPLIT_BYTES) -> DataFrame:
    """The files under a path: one row a file, or one a frame."""
    spark.dataSource.register(RecordingSource)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("recording").option("view", view).option("split", split).option("pushdown", pushdown).load(path)
