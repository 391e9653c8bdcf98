"""Importance resampling towards a target: documents drawn by how much likelier their features are in a target corpus than in their own.

Features are runs of one and two words, hashed to BUCKETS. Both corpora are counted whole, bucket by bucket; the gain of a bucket, a smoothed log ratio, stands in an array that workers
index with a document's features. A document's weight is the floored mean of its gains, and Gumbel noise from its id makes the highest scores a weighted draw without replacement.
The cutoff is found by bisection of the numbers: count jobs over the written scores halve the interval, several times a job, until the score is found at which the draw ends; rows tied
there are cut by doc_id, and rows alike in both by row number, in the same way. Rows before the cutoff are sorted by ranges for their ranks; nothing is sorted that is not drawn.

Defined results: a null or empty text has no feature and weight 0; a null doc_id has the noise of '' and stands after all others of its score; repeated rows count each; an empty target
gives gains from the documents alone; an empty table gives no rows; texts of any length are read whole.
"""

from math import floor, log
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, table, with_row_ids

BUCKETS, SEED = 10_000, 7
#: Least words of a document that can be drawn, and how many of a hundred are.
LEAST_WORDS, PERCENT = 20, 25
#: Numbers that one count job tries; an interval is cut into one more.
PROBES = 15
LAST = (1 << 63) - 1

#: Bytes of words, A-Z in lower case; all others become spaces.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: bytes | None) -> tuple[np.ndarray, int]:
    """The buckets of a text's features, and its words. The checksum of two words goes on from that of the first."""
    words = (text or b"").translate(_WORD).split()
    one = list(map(crc32, words))
    two = map(crc32, [b" " + w for w in words[1:]], one)
    return np.array([*one, *two], np.int64) % BUCKETS, len(words)


def counted(texts: DataFrame, text: str = "text") -> np.ndarray:
    """How often each bucket occurs in all texts."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in batch.column(0).to_pylist():
                total += np.bincount(features(t)[0], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    found = texts.select(F.col(text).cast("binary")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(BUCKETS, np.int64)
    for bucket, n in found.collect():  # BUCKETS rows at most
        counts[bucket] = n
    return counts


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    own_all, target_all = int(own.sum()), int(target.sum())
    return np.array([floor(1000 * log((t + 1) * (own_all + BUCKETS) / ((s + 1) * (target_all + BUCKETS)))) for s, t in zip(own.tolist(), target.tolist())], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, text: str = "text") -> DataFrame:
    """docs with _tm_features, _tm_words and _tm_weight."""
    kept = docs.columns
    picked = docs.withColumn("_tm_text", F.col(text).cast("binary"))
    picked = picked.select(*(c for c in kept if c != text), text, "_tm_text")

    def run(batches):
        for batch in batches:
            n, words, weight = [], [], []
            for t in batch.column("_tm_text").to_pylist():
                at, k = features(t)
                n.append(len(at)), words.append(k), weight.append(int(gain[at].sum()) // max(1, len(at)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(x, pa.int64()) for x in (n, words, weight))], [*kept, "_tm_features", "_tm_words", "_tm_weight"])

    schema = docs.select(*kept, *(F.lit(0).cast("long").alias(c) for c in ("_tm_features", "_tm_words", "_tm_weight"))).schema
    return picked.mapInArrow(run, schema)


def noise(doc_id: str, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, the same for an id at every run."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))


def nth(rows: DataFrame, key: Column, n: int) -> tuple[int, int, int]:
    """The n-th least value of an integer key (n from 1), how many rows are below it, and how many have it. Each job counts the rows up to PROBES numbers between the bounds."""
    low, high = rows.agg(F.min(key), F.max(key)).first()
    under, upto = 0, None  # rows below low, rows up to high
    while low < high:
        span = high - low
        probes = sorted({low + span * (i + 1) // (PROBES + 1) for i in range(PROBES)})
        counts = rows.agg(*[F.count_if(key <= p) for p in probes]).first()
        for p, k in zip(probes, counts):
            if k >= n:
                high, upto = p, k
                break
            low, under = p + 1, k
    if upto is None:
        upto = rows.where(key <= low).count()
    return low, under, upto - under


def drawn(rows: DataFrame, share: int = PERCENT) -> DataFrame:
    """rows (stored; _tm_score, _tm_id, _tm_row, _tm_open) with _tm_rank: 1, 2, ... for the floor of `share` hundredths of the open rows, those of the highest scores; null for others."""
    open_ = rows.where("_tm_open")
    n = open_.count() * share // 100
    keys = [-F.col("_tm_score"), F.coalesce(F.col("_tm_id"), F.lit(LAST)), F.col("_tm_row")]
    none = F.lit(None).cast("long").alias("_tm_rank")
    if not n:
        return rows.select("*", none)
    before, tied = F.lit(False), F.lit(True)
    for key in keys:
        at, under, having = nth(open_.where(tied), key, n)
        before, tied, n = before | (tied & (key < at)), tied & (key == at), n - under
        if having == n:
            break
    taken = F.col("_tm_open") & (before | tied)
    parted = rows.where(taken).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The lower 33 bits of the running number count the rows of a sorted partition.
    parted = materialize(parted.withColumns({"_tm_part": F.spark_partition_id(), "_tm_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}), "drawn")
    sizes = parted.groupBy("_tm_part").agg(F.count("*").alias("n"))  # one row for each partition
    starts = sizes.select("_tm_part", F.coalesce(F.sum("n").over(Window.orderBy("_tm_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_tm_start"))
    ranked = parted.join(F.broadcast(starts), "_tm_part").select(*rows.columns, (F.col("_tm_start") + F.col("_tm_at") + 1).alias("_tm_rank"))
    return rows.where(~taken).select("*", none).unionByName(ranked)


def scored(docs: DataFrame, target: DataFrame, columns: list[str], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The named columns of docs with _tm_features, _tm_weight, _tm_score, _tm_id, _tm_row and _tm_open (whether it can be drawn), written once."""
    gain = gains(counted(docs, text), counted(target))
    # The id again, under a name of our own: it may be among the columns.
    rows = docs if "_tm_row" in docs.columns else with_row_ids(docs)
    rows = rows.select(*columns, F.col(doc_id).cast("long").alias("_tm_id"), "_tm_row", F.col(text).alias("_tm_whole"))
    rows = weighted(rows, gain, "_tm_whole").drop("_tm_whole")
    rows = rows.withColumns({"_tm_score": F.col("_tm_weight") + noise("_tm_id"), "_tm_open": F.col("_tm_words") >= LEAST_WORDS}).drop("_tm_words")
    return materialize(rows, "scores")


def resampled(docs: DataFrame, target: DataFrame, share: int = PERCENT) -> DataFrame:
    """The drawn rows of docs (doc_id, text, and any others), whole, with _tm_rank."""
    rows = with_row_ids(docs)
    ranks = drawn(scored(rows, target, []), share).where("_tm_rank is not null").select("_tm_row", "_tm_rank")
    return rows.join(ranks, "_tm_row").select(*docs.columns, "_tm_rank")


def op11(spark, sf_dir) -> DataFrame:
    found = drawn(scored(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), ["doc_id"]))
    return found.select("doc_id", *(F.col(f"_tm_{c}").cast("long").alias(a) for c, a in (("features", "n_features"), ("weight", "weight"), ("score", "score"), ("rank", "rank"))))


#: Checksums by the table of their polynomial, of different features only.
OP11_SQL = r"""
WITH RECURSIVE bits AS (SELECT i, i AS c, 0 AS k FROM range(0, 256) g(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
df AS (SELECT r, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM b),
o AS (SELECT r, f, count(*) AS n FROM df GROUP BY ALL),
ob AS (SELECT f, count(*) AS n FROM bf GROUP BY ALL),
hx AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM o UNION SELECT f FROM ob)),
fs AS (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(0, len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda a, e: xor(tab[(xor(a, e) & 255) + 1], a >> 8)), 4294967295) % 10000 AS bucket FROM hx, tab),
own AS (SELECT bucket, sum(n) AS s FROM o JOIN fs USING (f) GROUP BY 1),
goal AS (SELECT bucket, sum(n) AS t FROM ob JOIN fs USING (f) GROUP BY 1),
g AS (SELECT i AS bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM own) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM goal) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM range(0, 10000) x(i) LEFT JOIN own ON own.bucket = i LEFT JOIN goal ON goal.bucket = i),
wt AS (SELECT r, sum(n)::BIGINT AS n_features, floor(sum(n * gain)::DOUBLE / sum(n))::BIGINT AS weight FROM o JOIN fs USING (f) JOIN g USING (bucket) GROUP BY 1),
sc AS (SELECT r, doc_id, len(w) >= 20 AS open, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, ('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM d LEFT JOIN wt USING (r)),
s AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM sc),
k AS (SELECT *, row_number() OVER (PARTITION BY open ORDER BY score DESC, doc_id ASC NULLS LAST) AS place, count(*) OVER (PARTITION BY open) AS n FROM s)
SELECT doc_id, n_features, weight, score, CASE WHEN open AND place <= 25 * n // 100 THEN place END AS rank FROM k
"""
