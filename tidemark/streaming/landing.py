"""Recordings as they come in: a stream of files of which the acceptable ones are taken into the store, and the purge of those nobody uses.

A file is taken if its suffix and size are allowed and its header can be read. It gets a generated name, made of nothing but its path and what was there, so that a batch that is repeated after a failure writes the same
files and the same records. What is refused is recorded with the reason and left where it is."""

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.containers import BrokenFile, avi, file_system, mp4
from tidemark.sources.probe import expired

#: Suffixes that are accepted, bytes of a file, hours that an unused file stays.
SUFFIXES = (".mp4", ".m4v", ".mov", ".avi", ".mkv", ".mpg", ".mpeg", ".wmv", ".webm")
MOST_BYTES, RETENTION_H = 4096 << 20, 24.0
#: Suffixes whose headers are read here; others are taken as they are.
READ = (".avi", ".mp4", ".m4v", ".mov")
INCOMING = "path string, modificationTime timestamp, length long, content binary"
RECORD = "path string, file string, bytes long, width int, height int, frame_count long, fps double, refused string"


def taken(rows: Iterator[pd.DataFrame], store: str, most_bytes: int, suffixes: tuple[str, ...]) -> Iterator[pd.DataFrame]:
    """Files (path, length, at: what tells one content of a path from another) copied into the store, with their records."""
    names = [c.split()[0] for c in RECORD.split(", ")]
    to_fs, folder = file_system(store)
    for pdf in rows:
        yield pd.DataFrame([one(p, n, at, to_fs, folder, most_bytes, suffixes) for p, n, at in zip(pdf["path"], pdf["length"], pdf["at"])], columns=names).astype({c: "Int64" for c in ("width", "height", "frame_count")})


def one(path: str, length: int, at: str, to_fs: pafs.FileSystem, folder: str, most_bytes: int, suffixes: tuple[str, ...]) -> tuple:
    suffix = "." + path.rsplit("/", 1)[-1].rpartition(".")[2].lower()
    nothing = (None, None, None, None)
    if suffix not in suffixes:
        return (path, None, length, *nothing, "this kind of file is not accepted")
    if length == 0 or length > most_bytes:
        return (path, None, length, *nothing, "the file is empty" if length == 0 else "the file is too large")
    fs, here = file_system(path)
    try:
        with fs.open_input_file(here) as f:
            head = (avi(f, length, False) if suffix == ".avi" else mp4(f, length)) if suffix in READ else None
            name = hashlib.sha256(f"{path}\0{at}\0{length}".encode()).hexdigest()[:32] + suffix
            target = f"{folder}/{name}"
            if to_fs.get_file_info(target).size != length:  # not there from a batch that failed
                to_fs.create_dir(folder, recursive=True)
                f.seek(0)
                with to_fs.open_output_stream(target + ".part") as out:
                    while piece := f.read(8 << 20):
                        out.write(piece)
                to_fs.move(target + ".part", target)
    except FileNotFoundError:
        return (path, None, length, *nothing, "the file is gone")
    except (BrokenFile, KeyError, ValueError) as e:
        return (path, None, length, *nothing, f"the file cannot be read: {e}")
    return (path, name, length, *((head.width, abs(head.height), head.count, head.fps) if head else nothing), None)


def land(spark: SparkSession, incoming: str, store: str, records: str, checkpoint: str, most_bytes: int = MOST_BYTES, suffixes: tuple[str, ...] = SUFFIXES, clean: str = "off", archive: str | None = None, **trigger) -> StreamingQuery:
    """Starts taking files from `incoming` into `store`, with a record each in `records`, partitioned by batch. `clean` says what becomes of files that were looked at: off, delete, or archive (to the folder `archive`)."""
    source = spark.readStream.format("binaryFile").schema(INCOMING).option("recursiveFileLookup", True).option("cleanSource", clean)
    source = source.option("sourceArchiveDir", archive) if archive else source

    def batch(files: DataFrame, number: int) -> None:
        # Contents are copied by the tasks themselves, piece by piece, and never become rows.
        rows = files.select("path", "length", F.col("modificationTime").cast("string").alias("at"))
        rows = rows.repartition(max(1, min(200, rows.count())))
        found = rows.mapInPandas(lambda b: taken(b, store, most_bytes, suffixes), RECORD)
        found.withColumn("at", F.current_timestamp()).write.mode("overwrite").parquet(f"{records}/batch={number}")

    return source.load(incoming).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def purge(spark: SparkSession, store: str, used: DataFrame, now, hours: float = RETENTION_H) -> DataFrame:
    """Deletes the files (used: file, used_at) that were last used more than `hours` before now, and those of which no use is known, and says which: file, reason. A file that is gone already is no error, so that it may be repeated."""
    fs, folder = file_system(store)
    there = [x.base_name for x in fs.get_file_info(pafs.FileSelector(folder)) if x.type == pafs.FileType.File] if fs.get_file_info(folder).type == pafs.FileType.Directory else []
    stored = spark.createDataFrame([(x,) for x in there], "file string")
    old = expired(used.groupBy("file").agg(F.max("used_at").alias("used_at")), "used_at", now, hours).select("file", F.lit("expired").alias("reason"))
    gone = stored.join(used.select("file"), "file", "left_anti").select("file", F.lit("no record").alias("reason"))

    def delete(batches):
        own, path = file_system(store)
        for pdf in batches:
            for name in pdf["file"]:
                if own.get_file_info(f"{path}/{name}").type == pafs.FileType.File:
                    own.delete_file(f"{path}/{name}")
            yield pdf

    doomed = old.join(stored, "file", "left_semi").unionByName(gone)
    return spark.createDataFrame(doomed.mapInPandas(delete, "file string, reason string").collect(), "file string, reason string")
