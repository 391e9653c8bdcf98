"""Shards of near equal bytes by histogram sort.

Rows get a 96-bit sort key: a hash of the text in the upper 32 bits, so that equal texts (a group) stand together, a hash of the doc_id in the next
32, and a row number that is the same at every reading in the last 32, so that even rows alike in everything can be cut anywhere. Rounds of exact counts of the bytes below
candidate boundaries, summed over all partitions, narrow each splitter's interval by STEP_BITS until it holds no more bytes
than the tolerance; a group of at most GROUP of a shard's bytes is never cut: the splitter goes to its nearer edge. Then rows are exchanged once, each
shard as as many parts as its bytes ask for, sorted by key, and numbered.

Defined results: a null text has no bytes and crc32 0, and is a group of its own; a null doc_id is a value like any other; repeated rows are rows, and
may lie in several shards if they are many; an empty table gives no rows.
"""

from bisect import bisect_right
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_broadcast, materialize, table, with_row_ids

SHARDS = 24
#: Most bytes that a splitter may be off, and most bytes of a group that is never cut, as shares of a shard's bytes.
TOLERANCE, GROUP = 0.001, 0.05
#: Bytes of an exchanged part, and least parts of a shard.
PART_BYTES, LEAST_PARTS = 128 << 20, 4
#: Bits of the key, of its part below the text's hash, and of the first and later rounds.
BITS, GROUP_BITS, FIRST_BITS, STEP_BITS = 96, 64, 16, 8


def keyed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with _tm_key (the upper 64 bits) and _tm_bytes (UTF-8 bytes and 8)."""
    high = F.shiftleft(F.shiftright(F.xxhash64(text), 32), 32)
    low = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit("shard")), 32)
    return docs.withColumns({"_tm_key": high.bitwiseOR(low), "_tm_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8})


def _prefix(shift: int) -> list:
    """The key without its last `shift` bits, as columns."""
    return [F.shiftright("_tm_key", shift - 32)] if shift >= 32 else [F.col("_tm_key"), F.shiftright("_tm_tie", shift)]


def _within(prefixes: list[int], shift: int):
    if shift >= 32:
        return F.shiftright("_tm_key", shift - 32).isin(prefixes)
    bits = 32 - shift
    return reduce(or_, [(F.col("_tm_key") == p >> bits) & (F.shiftright("_tm_tie", shift) == p & ((1 << bits) - 1)) for p in prefixes])


def splitters(keys: DataFrame, goals: list[float], tolerance: float, group: float) -> list[int]:
    """For each goal, in ascending order, a key such that the bytes of the smaller keys are the goal, to the tolerance, half a row or, where a group of at most `group` bytes would be cut, half of it.

    The driver holds 2 ** FIRST_BITS counts at first, then 2 ** STEP_BITS for each goal still open."""
    shift = BITS - FIRST_BITS
    # Of each open goal: the interval's prefix (None: all keys) and the bytes below it.
    open_: dict[int, tuple[int | None, int]] = {j: (None, 0) for j in range(len(goals))}
    last_shift, out = BITS, [0] * len(goals)
    while open_:
        prefixes = sorted({p for p, _ in open_.values() if p is not None})
        part = keys.where(_within(prefixes, last_shift)) if prefixes else keys
        counts: dict[int | None, list[tuple[int, int]]] = {}
        for *p, n in part.groupBy(*_prefix(shift)).agg(F.sum("_tm_bytes").alias("n")).collect():
            whole = p[0] if len(p) == 1 else (p[0] << (32 - shift)) + p[1]
            counts.setdefault(whole >> (last_shift - shift) if prefixes else None, []).append((whole, n))
        still = {}
        for j, (prefix, below) in open_.items():
            own, sums = sorted(counts[prefix]), [below]
            for _, n in own:
                sums.append(sums[-1] + n)
            k = min(max(0, bisect_right(sums, goals[j]) - 1), len(own) - 1)
            p, n = own[k]
            if n > (group if shift == GROUP_BITS else tolerance) and shift:
                still[j] = (p, sums[k])
            else:
                out[j] = (p if goals[j] - sums[k] <= n / 2 else p + 1) << shift
        open_, last_shift, shift = still, shift, max(0, shift - STEP_BITS)
    return sorted(out)


def placed(rows: DataFrame, order: list[str], shards: int = SHARDS) -> DataFrame:
    """rows (with _tm_key, _tm_bytes and _tm_row, the same at every reading) with _tm_shard and _tm_slot, the row's place in its shard: by part, then by key and the named columns."""
    columns = rows.columns
    rows = rows.withColumn("_tm_tie", F.shiftrightunsigned(F.xxhash64("_tm_row", F.lit("tie")), 32))
    keys = materialize(rows.select("_tm_key", "_tm_tie", "_tm_bytes"), "shard-keys")
    total = keys.agg(F.coalesce(F.sum("_tm_bytes"), F.lit(0))).first()[0]
    m = max(LEAST_PARTS, -(-total // (PART_BYTES * shards)))
    each = total / shards
    cuts = splitters(keys, [each * j for j in range(1, shards)], TOLERANCE * each, GROUP * each) if total else []
    # A cut above the greatest key leaves nothing beyond it.
    above = [(F.col("_tm_key") > c >> 32) | ((F.col("_tm_key") == c >> 32) & (F.col("_tm_tie") >= c & 0xFFFFFFFF)) for c in cuts if c >> 32 < 1 << 63]
    shard = sum((a.cast("int") for a in above), F.lit(0))
    part = shard * m + F.pmod(F.xxhash64("_tm_key", "_tm_tie"), F.lit(m)).cast("int")

    sizes = keys.groupBy(part.alias("_tm_part")).agg(F.count("*").alias("n")).withColumn("_tm_shard", F.floor(F.col("_tm_part") / m).cast("int"))
    before = Window.partitionBy("_tm_shard").orderBy("_tm_part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select("_tm_part", "_tm_shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_tm_first"))
    out = rows.withColumn("_tm_part", part).repartitionById(shards * m, "_tm_part").sortWithinPartitions("_tm_key", *order)
    # A partition is one part; the lower 33 bits of the id number its rows.
    out = out.withColumn("_tm_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    return out.join(bounded_broadcast(first, m * shards), "_tm_part").select(*columns, "_tm_shard", (F.col("_tm_first") + F.col("_tm_at")).alias("_tm_slot"))


def op7(spark, sf_dir) -> DataFrame:
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    docs = with_row_ids(keyed(table(spark, sf_dir, "documents").select("doc_id", "text"))).select("doc_id", "_tm_key", "_tm_bytes", crc.alias("_tm_crc"), "_tm_row")
    rows = placed(materialize(docs, "shard-rows"), ["doc_id", "_tm_bytes", "_tm_crc"])
    return rows.select("doc_id", F.col("_tm_bytes").alias("size"), F.col("_tm_crc").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("_tm_shard").cast("int").alias("shard"), F.col("_tm_slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def sharded(docs: DataFrame) -> DataFrame:
    """docs with shard and slot; columns of these names that docs has already give way."""
    kept = [c for c in docs.columns if c.lower() not in ("shard", "slot")]
    return placed(with_row_ids(keyed(docs)), ["doc_id"]).select(*kept, F.col("_tm_shard").cast("int").alias("shard"), F.col("_tm_slot").cast("long").alias("slot"))
