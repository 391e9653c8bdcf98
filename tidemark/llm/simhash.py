"""SimHash near-duplicate groups, compared on vertical bit planes.

Fingerprints that differ in at most RADIUS bits agree on at least two of six bit blocks (pigeonhole), so the
15 pairs of blocks are 15 exact tables: no link is missed. Many fingerprints take seven or eight blocks, and longer keys of three or four of them. Within a bucket of a table the bit planes of 64
fingerprints are held as 64 words; one XOR a plane updates 64 distances at once, carry-save counters hold the
sums, and a block of lanes is abandoned as soon as all its lanes exceed the radius. A bucket yields a forest
that spans its links, not its pairs. Buckets over BLOCK rows are dealt out as pairs of sub-blocks.
Components are then found by alternating star contraction over the forests.

Defined results: a null text has no words and, like an empty one, fingerprint zero; ties and repeated rows keep one row
each; component_id is null only where every doc_id of a component is null; an empty table gives an empty result.
"""

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_broadcast, materialize

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Most fingerprints for which six and seven blocks do: keys have 20 bits at least with six, 27 with seven, 32 with eight.
SIX, SEVEN = 1 << 24, 1 << 31
#: Rows of a sub-block of a large bucket.
BLOCK = 1024
#: Links of a node that a star step handles in one piece: at least so many, and at least all links over MOST_HUBS, so that fewer nodes than
#: 2 * MOST_HUBS have more and their list can be broadcast at every size.
PIECE, MOST_HUBS = 128, 25_000
#: Rows of one fingerprint that one task joins with its answer.
ALIKE = 250_000


def masks(n: int) -> list[int]:
    """Keys of the tables for n fingerprints: the 64 bits fall into blocks, and all blocks but RADIUS, as one mask, key one table."""
    blocks = 6 if n <= SIX else 7 if n <= SEVEN else 8
    edges = [64 * i // blocks for i in range(blocks + 1)]
    return [sum(((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in kept) for kept in combinations(range(blocks), blocks - RADIUS)]


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    line, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        h = np.array([digest(line[a:b], SEED) for a, b in zip(starts[k : k + 65536], stops[k : k + 65536])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def _signed(values: np.ndarray) -> np.ndarray:
    return values.astype("<u8").view("<i8")


def with_fingerprints(docs: DataFrame, columns: list[str], text: str = "text") -> DataFrame:
    """The named columns of docs, and _tm_fp, the fingerprint as a signed long."""
    picked = docs.select(*columns, F.col(text).cast("binary").alias("_tm_text"))

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(x) for x in batch.column("_tm_text").to_pylist()], "<u8")
            kept = [batch.column(c) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(_signed(fp))], [*columns, "_tm_fp"])

    return picked.mapInArrow(run, picked.select(*columns).withColumn("_tm_fp", F.lit(0).cast("long")).schema)


def planes_of(fp: np.ndarray) -> np.ndarray:
    """Bit planes: row b, word w holds bit b of fingerprints 64 w to 64 w + 63."""
    padded = np.zeros(-(-len(fp) // 64) * 64, "<u8")
    padded[: len(fp)] = fp
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def close_lanes(planes: np.ndarray, query: np.ndarray, word: np.ndarray, lanes: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """For each task (query fingerprint, word of 64 lanes): the lanes within the radius. Returns tasks that have any, and their lanes.

    The carry-save counters hold the lanes' distances bit by bit, `over` what outgrew them; every 8 planes the counters are held against the radius, and tasks whose lanes all exceed it are dropped."""
    at = np.arange(len(query))
    counts = [np.zeros(len(query), "<u8") for _ in range(radius.bit_length())]
    over = ~lanes
    for b in range(64):
        carry = planes[b][word] ^ np.where((query >> np.uint64(b)) & np.uint64(1), ONES, np.uint64(0))
        for c in counts:
            both = c & carry
            c ^= carry
            carry = both
        over |= carry
        if b % 8 == 7:
            equal = ONES
            for j in range(len(counts) - 1, -1, -1):
                if radius >> j & 1:
                    equal = equal & counts[j]
                else:
                    over |= equal & counts[j]
                    equal = equal & ~counts[j]
            alive = over != ONES
            if not alive.all():
                at, query, word, over = (v[alive] for v in (at, query, word, over))
                counts = [c[alive] for c in counts]
            if not len(at):
                break
    return at, ~over


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n-1 and links a-b: the smallest node of each one's component."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def _below(upto: np.ndarray) -> np.ndarray:
    """Words whose lowest `upto` bits (0 to 64) are ones."""
    return np.where(upto >= 64, ONES, (np.uint64(1) << np.minimum(upto, 63).astype("<u8")) - np.uint64(1))


def link_sorted(fp: np.ndarray, group: np.ndarray, cross: np.ndarray, side: np.ndarray, tasks: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Rows stand sorted by group. Links each row to the smallest row of its component in the group; in cross groups only pairs of different sides are compared."""
    n = len(fp)
    first = np.searchsorted(group, group, "left")
    last = np.searchsorted(group, group, "right")
    planes, rows = planes_of(fp), np.arange(n)
    sides = planes_of_flags(side)
    w0, w1 = (rows + 1) // 64, np.maximum(last - 1, rows) // 64
    spans = np.where(last > rows + 1, w1 - w0 + 1, 0)
    done, parent = 0, rows.copy()
    bounds = np.cumsum(spans)
    while done < n:
        # whole rows up to about `tasks` tasks at a time
        upto = max(done + 1, int(np.searchsorted(bounds, (bounds[done - 1] if done else 0) + tasks, "right")))
        k = spans[done:upto]
        q = np.repeat(rows[done:upto], k)
        word = np.repeat(w0[done:upto], k) + np.arange(len(q)) - np.repeat(np.cumsum(k) - k, k)
        lanes = _below(last[q] - 64 * word) & ~_below(np.maximum(q + 1 - 64 * word, 0))
        lanes &= np.where(cross[q], np.where(side[q], ~sides[word], sides[word]), ONES)
        at, hit = close_lanes(planes, fp[q], word, lanes)
        if len(at):
            bits = np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            t, lane = np.nonzero(bits)
            parent = spanning(n, np.concatenate([q[at][t], rows]), np.concatenate([64 * word[at][t] + lane, parent]))
        done = upto
    parent = spanning(n, rows, parent)
    linked = parent != rows
    return fp[linked], fp[parent[linked]]


def planes_of_flags(flags: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-max(1, len(flags)) // 64) * 64, bool)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view("<u8")


def links(fps: DataFrame) -> DataFrame:
    """From distinct fingerprints _tm_fp, stored: pairs (u, v), u > v, that span the same components as all pairs within the radius."""
    tables = masks(fps.count())
    keyed = fps.select("_tm_fp", F.posexplode(F.array(*[F.col("_tm_fp").bitwiseAND(F.lit(_as_long(m))) for m in tables])).alias("t", "key"))
    counted = materialize(keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    large = counted.where(F.col("n") > BLOCK).select("t", "key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    n_large = large.count()
    rows = keyed.join(counted.select("t", "key"), ["t", "key"], "left_semi")
    if n_large:
        rows = rows.join(bounded_broadcast(large, n_large), ["t", "key"], "left")
    else:
        rows = rows.withColumn("parts", F.lit(None).cast("int"))
    mine = F.pmod(F.xxhash64("_tm_fp", F.lit(7)), F.coalesce("parts", F.lit(1))).cast("int")
    rows = rows.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    rows = rows.select("_tm_fp", F.xxhash64("t", "key", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), (F.col("mine") != F.col("other")).alias("cross"), (F.col("mine") > F.col("other")).alias("side"))

    def run(batches):
        held: list[pd.DataFrame] = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) >= 200_000:  # all but the last group, which may go on
                now = pd.concat(held)
                cut = int(np.searchsorted(now["g"].to_numpy(), now["g"].iloc[-1], "left"))
                if cut:
                    yield _linked(now[:cut])
                    held = [now[cut:]]
                else:
                    held = [now]
        if held:
            yield _linked(pd.concat(held))

    return rows.repartition("g").sortWithinPartitions("g").mapInPandas(run, "u long, v long").distinct()


def _linked(pdf: pd.DataFrame) -> pd.DataFrame:
    a, b = link_sorted(pdf["_tm_fp"].to_numpy().view("<u8"), pdf["g"].to_numpy(), pdf["cross"].to_numpy(bool), pdf["side"].to_numpy(bool))
    a, b = _signed(a), _signed(b)
    return pd.DataFrame({"u": np.maximum(a, b), "v": np.minimum(a, b)})


def _as_long(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (u, v): root is the smallest node of its component. Alternates large-star and small-star steps until nothing changes."""
    edges = materialize(edges.where("u != v"), "links")
    while True:
        both = edges.union(edges.select("v", "u").toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = edges_to(both.where("v > u"), low, edges.count()).distinct()
        large = materialize(large, "large-star")
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        star = edges_to(down, low, large.count()).union(low.select("u", "m").toDF("u", "v")).distinct()
        star = materialize(star, "small-star")
        # Stars only: no node is both a child and a root, and no child has two roots.
        shape = star.groupBy("u").agg(F.countDistinct("v").alias("k")).where("k > 1").limit(1).count()
        nested = shape or star.select("u").join(star.select(F.col("v").alias("u")).distinct(), "u", "left_semi").limit(1).count()
        edges = star
        if not nested:
            return edges.toDF("node", "root")


def edges_to(edges: DataFrame, low: DataFrame, total: int) -> DataFrame:
    """Moves the far end of each link (u, v) to u's minimum: (v, m), from low (u, m, n: its links). The links of a hub are dealt out in pieces; there are `total` links."""
    piece = max(PIECE, -(-total // MOST_HUBS))
    parts = F.ceil(F.col("n") / piece).cast("int")
    hubs = F.broadcast(low.where(F.col("n") > piece).select("u", parts.alias("parts")))
    dealt = edges.join(hubs, "u", "left").select("u", "v", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1)).cast("long")).cast("int").alias("part"))
    lows = low.select("u", "m", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return dealt.join(lows, ["u", "part"]).where("v != m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))


def near_duplicates(docs: DataFrame, columns: list[str], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The named columns, _tm_fp, _tm_row (a row number that is stored, so stable) and _tm_component, _tm_keep: the smallest doc_id of the row's component, and the row that stands for it."""
    rows = with_fingerprints(docs, columns, text).withColumn("_tm_row", F.monotonically_increasing_id())
    rows = materialize(rows, "fingerprints")
    first = F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("_tm_row").alias("row"))).alias("first")
    fps = materialize(rows.groupBy("_tm_fp").agg(first, F.count("*").alias("n")), "distinct-fingerprints")
    found = components(links(fps.select("_tm_fp")))
    rooted = fps.join(found, fps["_tm_fp"] == found["node"], "left").select("_tm_fp", "first", "n", F.coalesce("root", "_tm_fp").alias("root"))
    rooted = materialize(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("first").alias("least"))
    answer = rooted.join(least, "root").select("_tm_fp", F.col("least.id").alias("_tm_component"), F.col("least.row").alias("_tm_keep"), F.ceil(F.col("n") / ALIKE).cast("int").alias("_tm_parts"))
    # The rows of a fingerprint that very many share are dealt out to several tasks.
    hot = fps.where(F.col("n") > ALIKE).select("_tm_fp", F.ceil(F.col("n") / ALIKE).cast("int").alias("_tm_parts"))
    if n_hot := hot.count():
        dealt = rows.join(bounded_broadcast(hot, n_hot), "_tm_fp", "left").withColumn("_tm_part", F.pmod("_tm_row", F.coalesce("_tm_parts", F.lit(1))).cast("int")).drop("_tm_parts")
        answer = answer.withColumn("_tm_part", F.explode(F.sequence(F.lit(0), F.col("_tm_parts") - 1)))
        return dealt.join(answer, ["_tm_fp", "_tm_part"]).select(*rows.columns, "_tm_component", "_tm_keep")
    return rows.join(answer, "_tm_fp").select(*rows.columns, "_tm_component", "_tm_keep")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate group: that of the smallest doc_id."""
    columns = docs.columns
    return near_duplicates(docs, columns).where(F.col("_tm_row") == F.col("_tm_keep")).select(*columns)


def op6(spark, sf_dir) -> DataFrame:
    from tidemark.llm.common import table

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", F.lpad(F.lower(F.hex("_tm_fp")), 16, "0").alias("fingerprint"), F.col("_tm_component").alias("component_id"))
