"""SimHash near-dedup for texts that are similar as sets of five-word shingles, by 0.8 or more, where fingerprints differ in too many bits for exact block tables.

Texts with equal sets are one node. Bands of hash minima (BANDS of DEPTH) block the texts: two of similarity s share a band
with probability 1 - (1 - s^DEPTH)^BANDS, 0.9998 at 0.8. Texts that bands connect form a candidate group; within a group the SimHash fingerprints of all pairs are
compared on bit planes, and pairs within RADIUS bits that are not connected yet are compared exactly. At 0.8 two fingerprints differ in 9.7 bits on average (the angle
between the sets, 64 acos(2s / (1 + s)) / pi), with a deviation of 2.9; RADIUS lies five deviations above, and pairs of one group that share nothing lie at 32. Bits of small
sets are not that even: a pair of which one has fewer than SMALL shingles is compared exactly, whatever its fingerprints. The rule is the same in groups of every size.
Groups over BLOCK texts or LONG shingles are dealt out as pairs of sub-blocks, so every pair meets.

Words are as for fingerprints (ASCII case and spaces); a text of fewer than SHINGLE words is one shingle; a null text, like an empty one, has none.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_broadcast, materialize
from tidemark.llm.simhash import ONES, close_lanes, components, planes_of

SHINGLE, BANDS, DEPTH = 5, 16, 4
#: Texts are linked from this similarity on, as a fraction.
SHARE, OF = 4, 5
#: Bits in which the fingerprints of compared texts may differ, and shingles from which on they are looked at.
RADIUS, SMALL = 24, 64
#: Texts, and their shingles, of a sub-block of a large group.
BLOCK, LONG = 512, 2_000_000
_RANDOM = np.random.default_rng(5)
FACTORS, TERMS = (_RANDOM.integers(0, 1 << 64, (BANDS * DEPTH, 1), "u8") for _ in range(2))
FACTORS |= np.uint64(1)


def shingles(text: bytes | None) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    line, n = b" ".join(words), max(1, len(words) - SHINGLE + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts, stops = [0, *(ends[: n - 1] + 1).tolist()], ends[min(SHINGLE, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(starts, stops)], "<u8"))


def bands(found: np.ndarray) -> list[int]:
    """One key a band: the hash of its DEPTH least values."""
    if not len(found):
        return []
    least = np.full(BANDS * DEPTH, np.iinfo("u8").max, "<u8")
    for k in range(0, len(found), 4096):
        np.minimum(least, (found[k : k + 4096] * FACTORS + TERMS).min(axis=1), out=least)
    raw, width = least.tobytes(), 8 * DEPTH
    return [xxhash.xxh64_intdigest(raw[b * width : (b + 1) * width], b) for b in range(BANDS)]


def with_sets(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _tm_set (a hash of the set of shingles), _tm_n (their number) and _tm_bands."""
    columns = docs.columns
    picked = docs.withColumn("_tm_text", F.col(text).cast("binary"))

    def run(batches):
        for batch in batches:
            found = [shingles(x) for x in batch.column("_tm_text").to_pylist()]
            key = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in found], "<u8").view("<i8")
            keys = [np.array(bands(s), "<u8").view("<i8") for s in found]
            new = [pa.array(key), pa.array([len(s) for s in found], pa.int64()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *new], [*columns, "_tm_set", "_tm_n", "_tm_bands"])

    schema = picked.select(*columns, F.lit(0).cast("long").alias("_tm_set"), F.lit(0).cast("long").alias("_tm_n"), F.array().cast("array<long>").alias("_tm_bands")).schema
    return picked.mapInArrow(run, schema)


def candidates(sets: DataFrame) -> DataFrame:
    """(node, root) of every set that shares a band with another, directly or through others.

    Band keys and sets are sorted by ranges of both, so that a key of very many sets lies in several tasks; each task links the sets of a key to the first one it meets, and the
    first and last rows of the tasks link what stands on both sides of a border."""

    def run(batches):
        key = head = None
        edge = None
        for batch in batches:
            u, v = (batch.column(c).to_numpy() for c in ("u", "v"))
            if not len(u):
                continue
            new = np.concatenate([[u[0] != key], u[1:] != u[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(u)), -1))
            heads = np.where(first < 0, v[0] if head is None else head, v[np.maximum(first, 0)])
            linked = ~new & (heads != v)
            rows = [(0, np.maximum(v[linked], heads[linked]), np.minimum(v[linked], heads[linked]))]
            if edge is None:
                rows.append((1, u[:1], heads[:1]))
            edge = key, head = u[-1], heads[-1]
            yield as_rows(rows)
        if edge is not None:
            yield as_rows([(1, np.array([key]), np.array([head]))])

    def as_rows(parts):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.full(len(a), k) for k, a, _ in parts])), pa.array(np.concatenate([a for _, a, _ in parts])), pa.array(np.concatenate([b for *_, b in parts]))], ["kind", "u", "v"])

    keyed = sets.select(F.explode("_tm_bands").alias("u"), F.col("_tm_set").alias("v"))
    links = materialize(keyed.repartitionByRange("u", "v").sortWithinPartitions("u", "v").mapInArrow(run, "kind long, u long, v long"), "bands")
    # Two rows a task.
    borders = links.where("kind = 1").select("u", "v", F.lag("v").over(Window.partitionBy("u").orderBy("v")).alias("w")).where("w is not null and v != w")
    edges = links.where("kind = 0").select("u", "v").union(borders.select(F.greatest("v", "w"), F.least("v", "w"))).distinct()
    found = materialize(components(edges), "candidates")
    return found.union(found.select("root", "root").distinct())


def fingerprint(found: np.ndarray) -> int:
    """The SimHash of a set of shingle hashes: a bit is 1 if it is set in over half of them."""
    counts = np.zeros(64, np.int64)
    for k in range(0, len(found), 65536):
        counts += np.unpackbits(found[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(found), bitorder="little").tobytes(), "little")


def close_pairs(sets: list[np.ndarray]) -> np.ndarray:
    """Whether two sets are to be compared: one is small, or their fingerprints differ in at most RADIUS bits. All pairs of a sub-block at once, 64 in a word of the bit planes."""
    n = len(sets)
    fp = np.array([fingerprint(s) for s in sets], "<u8")
    words = -(-n // 64)
    query, word = np.repeat(np.arange(n), words), np.tile(np.arange(words), n)
    full = np.where((word == words - 1) & (n % 64 > 0), (np.uint64(1) << np.uint64(n % 64)) - np.uint64(1), ONES)
    at, hit = close_lanes(planes_of(fp), fp[query], word, full, RADIUS)
    near = np.zeros((n, 64 * words), bool)
    bits = np.unpackbits(hit.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    near.reshape(n * words, 64)[at] = bits
    small = np.array([len(s) < SMALL for s in sets])
    return near[:, :n] | small[:, None] | small[None, :]


def linked(sets: list[np.ndarray], cross: bool, side: np.ndarray) -> list[tuple[int, int]]:
    """Links that span the same components as all pairs of sets (in cross groups: of different sides) from the similarity on."""
    n, size = len(sets), np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    flat = np.unique(np.concatenate(sets), return_inverse=True)[1]
    near = close_pairs(sets)
    mark, label, links = np.zeros(flat.max() + 1, bool), np.arange(n), []
    for i in range(n - 1):
        open_ = (label != label[i]) & (OF * np.minimum(size, size[i]) >= SHARE * np.maximum(size, size[i]))
        open_ &= near[i]
        open_[: i + 1] = False
        if cross:
            open_ &= side != side[i]
        at = np.flatnonzero(open_)
        if not len(at):
            continue
        mine = flat[start[i] : start[i] + size[i]]
        mark[mine] = True
        if 4 * len(at) > n:
            shared = np.add.reduceat(mark[flat], start)[at]
        else:
            shared = np.array([np.count_nonzero(mark[flat[start[j] : start[j] + size[j]]]) for j in at])
        mark[mine] = False
        # shared / (a + b - shared) >= SHARE / OF
        at = at[(SHARE + OF) * shared >= SHARE * (size[at] + size[i])]
        joined, first = np.unique(label[at], return_index=True)
        links += [(i, int(j)) for j in at[first]]
        label[np.isin(label, joined)] = label[i]
    return links


def verified(rows: DataFrame, sets: DataFrame, found: DataFrame, text: str = "text") -> DataFrame:
    """Links (u, v), u > v, of sets whose similarity reaches the bound, which span the components of all such pairs in the candidate groups (node, root)."""
    members = materialize(sets.join(found, sets["_tm_set"] == found["node"]).select("_tm_set", "root", "_tm_n", F.col("first.row").alias("_tm_row")), "members")
    n_members = members.count()
    parts = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("_tm_n") / LONG)).cast("int")
    large = materialize(members.groupBy("root").agg(parts.alias("parts")).where("parts > 1"), "large-groups")
    members = members.join(bounded_broadcast(large, large.count()), "root", "left")
    texts = rows.select("_tm_row", F.col(text).cast("binary").alias("_tm_text")).join(bounded_broadcast(members, n_members), "_tm_row")
    mine = F.pmod(F.xxhash64("_tm_set", F.lit(7)), F.coalesce("parts", F.lit(1))).cast("int")
    dealt = texts.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
    dealt = dealt.select("_tm_set", "_tm_text", F.xxhash64("root", F.least("mine", "other"), F.greatest("mine", "other")).alias("g"), (F.col("mine") != F.col("other")).alias("cross"), (F.col("mine") > F.col("other")).alias("side"))

    def links_of(held):
        if len(held) < 2:
            return []
        return [(max(a, b), min(a, b)) for a, b in ((held[i][0], held[j][0]) for i, j in linked([s for _, s, _, _ in held], held[0][2], np.array([x for _, _, _, x in held])))]

    def run(batches):
        group, held = None, []
        for pdf in batches:
            out = []
            for key, t, g, cross, side in zip(*(pdf[c].tolist() for c in ("_tm_set", "_tm_text", "g", "cross", "side"))):
                if g != group:
                    out += links_of(held)
                    group, held = g, []
                held.append((key, shingles(t), cross, side))
            yield pd.DataFrame(out, columns=["u", "v"], dtype="int64")
        yield pd.DataFrame(links_of(held), columns=["u", "v"], dtype="int64")

    return dealt.repartition("g").sortWithinPartitions("g").mapInPandas(run, "u long, v long").distinct()


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id."""
    columns = docs.columns
    rows = materialize(with_sets(docs).withColumn("_tm_row", F.monotonically_increasing_id()), "shingle-sets")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("_tm_row").alias("row"))).alias("first")
    sets = materialize(rows.groupBy("_tm_set").agg(first, F.min("_tm_n").alias("_tm_n"), F.first("_tm_bands").alias("_tm_bands")), "distinct-sets")
    found = components(verified(rows, sets, candidates(sets)))
    rooted = sets.join(found, sets["_tm_set"] == found["node"], "left").select("first", F.coalesce("root", "_tm_set").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_tm_row"))
    return rows.join(kept, "_tm_row", "left_semi").select(*columns)
