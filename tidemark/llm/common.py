"""What the corpus operators share: table access and lineage cuts in the shared folder."""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.stored import stored as materialize  # noqa: F401
from tidemark.sources.stored import scratch, shared_dir  # noqa: F401

#: Broadcast sides have at most this many rows of fixed width; beyond it a shuffled join is used.
BROADCAST_ROWS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_ids(df: DataFrame, name: str = "_tm_row") -> DataFrame:
    """df with a number for each row that is the same whenever the row is read: from its file and its place there, or, where df is no plain scan of files, by writing it once."""
    try:
        return df.withColumn(name, F.xxhash64(F.col("_metadata.file_path"), F.col("_metadata.row_index")))
    except AnalysisException:
        return materialize(df.withColumn(name, F.xxhash64(F.monotonically_increasing_id())), "rows")


def bounded_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """df marked for broadcast if its counted rows are within the bound, else df as it is (a shuffled join)."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def crc_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as the text ''."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))
