"""The trie of conversation prefixes: each distinct sequence of first turns is a node, with its members, its children, and what its whole subtree holds.

Turns get their place, and prefixes their keys (the exclusive or of the digests of turn and place), in range sorts, whose partitions a long conversation may span; a node is named by its smallest member and
its depth, and so a conversation owns one chain of nodes, which ends in its last turn. Owned chains give every node the size of its subtree: the chain's rest, and the whole chains of other members.

Totals of subtrees are summed by centroid decomposition of the forest of parent edges. In a component, the nodes that hold over half of it in their subtrees are the path from its centroid up to its top: the
deepest of them is the centroid. What stands at and below the centroid is one total, which every node of that path gets; then the centroid goes, each of its children is the top of a component
of its own, and the nodes above keep their sizes less the centroid's. All components take this step at once, as joins and sums, until they have at most SMALL nodes; the tasks that get such a
component whole go on in the same way. Every step halves the largest component, so a trie of any depth and shape takes few of them.

Defined results: turns that are alike in conversation and number stand by role and text; a null conv_id is one conversation, which keeps its own turns, stands after all others and is written as null in
conv_id and as '' in digests; a conversation that is rebuilt without turns is a member of the root; an empty table gives no rows; texts of any length count whole. The digest of a node's
ends is by nature one stream: its ids come to one task as sorted pieces, which it holds one at a time.
"""

from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_broadcast, materialize, table

#: Rebuilding: conversations of one base, and most turns taken from it.
FAMILY, TURNS = 5, 8
#: Nodes of a component that one task takes whole.
SMALL = 2000
LAST = (1 << 63) - 1


def running(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (c, x1, x2, ...) with at, k1, k2: the place in c, from 1, and the exclusive or of x1 and x2 so far, in that order (c first), which no task sees whole."""
    kept = [n for n in rows.columns if n not in ("x1", "x2", "turn", "role", "text")]

    def run(batches):
        key, state = None, np.zeros(3, np.int64)
        for batch in batches:
            c = batch.column("c").to_numpy()
            if not len(c):
                continue
            new = np.concatenate([[c[0] != key], c[1:] != c[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(c)), 0))
            x = np.stack([np.ones(len(c), np.int64), batch.column("x1").to_numpy(), batch.column("x2").to_numpy()])
            so_far = np.concatenate([np.cumsum(x[:1], axis=1), np.bitwise_xor.accumulate(x[1:], axis=1)])
            # What came before the conversation's first row in this batch, if it does not go on from the last one.
            before = np.concatenate([np.zeros((3, 1), np.int64), so_far[:, :-1]], axis=1)[:, first]
            out = np.concatenate([so_far[:1] - before[:1], so_far[1:] ^ before[1:]])
            goes_on = (first == 0) & ~new[0]
            out[0, goes_on] += state[0]
            out[1:, goes_on] ^= state[1:, None]
            key, state = c[-1], out[:, -1].copy()
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in [*kept, "part"]), *map(pa.array, out)], [*kept, "part", "at", "k1", "k2"])

    parted = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*kept, "x1", "x2", F.spark_partition_id().alias("part"))
    schema = parted.select(*kept, "part", *(F.lit(0).cast("long").alias(n) for n in ("at", "k1", "k2"))).schema
    found = materialize(parted.mapInArrow(run, schema), "running")
    # Conversations that several partitions share: fewer rows than twice the partitions.
    ends = found.groupBy("c", "part").agg(F.max("at").alias("n"), F.max_by(F.struct("k1", "k2"), "at").alias("k"))
    ends = ends.join(ends.groupBy("c").agg(F.count("*").alias("parts")).where("parts > 1").select("c"), "c")
    before = Window.partitionBy("c").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = ends.select("c", "part", F.sum("n").over(before).alias("s"), F.bit_xor("k.k1").over(before).alias("s1"), F.bit_xor("k.k2").over(before).alias("s2"))
    found = found.join(F.broadcast(shift), ["c", "part"], "left").drop("part")
    zero = F.lit(0)
    return found.select(*kept, (F.col("at") + F.coalesce("s", zero)).alias("at"), F.col("k1").bitwiseXOR(F.coalesce("s1", zero)).alias("k1"), F.col("k2").bitwiseXOR(F.coalesce("s2", zero)).alias("k2"))


def placed(turns: DataFrame) -> DataFrame:
    """turns (conv_id, turn, role, text) as c, at, t1, t2 (digests of role and text) and size (bytes of the text)."""
    rows = turns.select(F.coalesce(F.col("conv_id").cast("long"), F.lit(LAST)).alias("c"), "turn", *(F.coalesce(F.col(n).cast("string"), F.lit("")).alias(n) for n in ("role", "text")))
    rows = rows.withColumns({"t1": F.xxhash64("role", "text"), "t2": F.xxhash64(F.lit("2"), "role", "text"), "size": F.octet_length("text").cast("long"), "x1": F.lit(0).cast("long"), "x2": F.lit(0).cast("long")})
    return running(rows, ["c", "turn", "role", "text"]).select("c", "at", "t1", "t2", "size")


def taken(c: Column) -> Column:
    """How many of a conversation's first turns come from its base."""
    return F.when(c == LAST, 0).otherwise(F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(TURNS + 1)))


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From placed(): turns (c, d, t1, t2, size, n: turns of the rebuilt conversation) and conversations (c, n)."""
    sizes = materialize(own.groupBy("c").agg(F.count("*").alias("own")).withColumns({"h": taken(F.col("c")), "base": F.col("c") - F.col("c") % FAMILY}), "conversations")
    bases = sizes.select(F.col("c").alias("base"), F.col("own").alias("there"))
    convs = sizes.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0))))
    convs = materialize(convs.select("c", "base", "h", "m", (F.col("m") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("n")), "rebuilt")
    some = bounded_broadcast(convs, convs.count())
    heads = own.where((F.col("at") <= TURNS) & (F.col("c") % FAMILY == 0)).withColumnRenamed("c", "base").join(convs.where("m > 0"), "base").where("at <= m")
    tails = own.join(some, "c").where("at > h").withColumn("at", F.col("at") - F.col("h") + F.col("m"))
    columns = ["c", F.col("at").cast("int").alias("d"), "t1", "t2", "size", "n"]
    return heads.select(*columns).unionByName(tails.select(*columns)), convs.select("c", "n")


def paths(turns: DataFrame, root: int) -> DataFrame:
    """From rebuilt(): for each conversation and depth the smallest member r of its node, and pr of its parent; size, n, members."""
    keyed = running(turns.withColumns({"x1": F.xxhash64("d", "t1", "t2"), "x2": F.xxhash64(F.lit("2"), "d", "t2", "t1")}).drop("t1", "t2"), ["c", "d"])
    keyed = materialize(keyed, "keys")
    nodes = keyed.groupBy("d", "k1", "k2").agg(F.min("c").alias("r"), F.count("*").alias("members"))
    # Only nodes of several members: the others' only member is the row itself.
    shared = materialize(nodes.where("members > 1"), "shared-nodes")
    rows = keyed.join(bounded_broadcast(shared, shared.count()), ["d", "k1", "k2"], "left")
    rows = materialize(rows.select("c", "d", F.coalesce("r", "c").alias("r"), F.coalesce("members", F.lit(1)).alias("members"), "size", "n"), "members")
    above = rows.select("c", (F.col("d") + 1).alias("d"), F.col("r").alias("pr"))
    return materialize(rows.join(above, ["c", "d"], "left").withColumn("pr", F.when(F.col("d") == 1, F.lit(root)).otherwise(F.col("pr"))), "paths")


def trie(found: DataFrame, convs: DataFrame, root: int) -> DataFrame:
    """From paths(): one row a node: r, d, pr, members, size (bytes of its last text), below (nodes of its subtree)."""
    chains = found.groupBy("c").agg(F.count_if(F.col("r") == F.col("c")).alias("owned"))
    more = found.where("r < c").join(chains, "c").groupBy("r", "d").agg(F.sum("owned").alias("more"))
    nodes = found.where("r = c").select("r", "d", "pr", "members", "size", "n").join(more, ["r", "d"], "left")
    nodes = nodes.select("r", "d", "pr", "members", "size", (F.col("n") - F.col("d") + 1 + F.coalesce("more", F.lit(0))).alias("below"))
    long = lambda x: F.lit(x).cast("long")
    all_nodes, all_convs = found.where("r = c").count() + 1, convs.count()
    top = found.sparkSession.range(1).select(long(root).alias("r"), F.lit(0).alias("d"), long(root).alias("pr"), long(all_convs).alias("members"), long(0).alias("size"), long(all_nodes).alias("below"))
    return materialize(nodes.unionByName(top), "nodes")


def component_steps(comp: np.ndarray, parent: np.ndarray, depth: np.ndarray, below: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values (rows by columns) over all subtrees of whole components; comp: the place of each node's top, parent: that of its parent, its own for tops."""
    n = len(comp)
    total, comp, parent, below, open_ = np.zeros_like(values), comp.copy(), parent.copy(), below.copy(), np.ones(n, bool)
    while open_.any():
        at = np.flatnonzero(open_)
        on_path = at[2 * below[at] > below[comp[at]]]
        deepest = np.full(n, -1)
        order = on_path[np.argsort(depth[on_path], kind="stable")]
        deepest[comp[order]] = order  # the last one written is the deepest
        centroid = deepest[comp[at]]
        # Pointers up, which stop at tops, at centroids and at their children, are doubled until all have stopped.
        up = parent.copy()
        is_centroid = np.zeros(n, bool)
        is_centroid[centroid] = True
        stays = at[is_centroid[at] | is_centroid[parent[at]] | (comp[at] == at)]
        up[stays] = stays
        while True:
            further = up[up[at]]
            if (further == up[at]).all():
                break
            up[at] = further
        end = up[at]
        lower = (end != at) | (comp[at] != at)
        lower &= is_centroid[parent[end]] & (parent[end] == centroid) & (end != centroid)
        sums = np.zeros_like(values)
        np.add.at(sums, comp[at[lower | (at == centroid)]], values[at[lower | (at == centroid)]])
        total[on_path] += sums[comp[on_path]]
        above = on_path[on_path != deepest[comp[on_path]]]
        below[above] -= below[deepest[comp[above]]]
        open_[centroid] = False
        comp[at[lower]] = end[lower]
        parent[end[lower]] = end[lower]
    return total


def summed_whole(rows: DataFrame) -> DataFrame:
    """r, d, leaves, saved of components (r, d, pr, cr, cd, below, leaf, worth, leaves, saved) of at most SMALL nodes, each in one task."""

    def run(batches):
        held = []
        for pdf in batches:
            held.append(pdf)
            if sum(map(len, held)) < 4 * SMALL:
                continue
            rows = pd.concat(held, ignore_index=True)
            last = (rows["cr"] == rows["cr"].iloc[-1]) & (rows["cd"] == rows["cd"].iloc[-1])
            held = [rows[last]]
            yield solved(rows[~last])
        if held:
            yield solved(pd.concat(held, ignore_index=True))

    def solved(rows):
        rows = rows.reset_index(drop=True)
        place = pd.Series(np.arange(len(rows)), index=pd.MultiIndex.from_frame(rows[["r", "d"]]))
        comp = place.reindex(pd.MultiIndex.from_frame(rows[["cr", "cd"]])).to_numpy(np.int64)
        parent = place.reindex(pd.MultiIndex.from_arrays([rows["pr"], rows["d"] - 1])).to_numpy()
        own = np.arange(len(rows))
        # A parent outside the component went with an earlier step.
        parent = np.where(np.isnan(parent) | (comp == own), own, np.nan_to_num(parent)).astype(np.int64)
        total = component_steps(comp, parent, rows["d"].to_numpy(), rows["below"].to_numpy(), rows[["leaf", "worth"]].to_numpy(np.int64))
        out = rows[["r", "d"]].copy()
        out["leaves"], out["saved"] = rows["leaves"] + total[:, 0], rows["saved"] + total[:, 1]
        return out

    return rows.repartition("cr", "cd").sortWithinPartitions("cr", "cd", "d").mapInPandas(run, "r long, d int, leaves long, saved long")


def rolled_up(nodes: DataFrame, found: DataFrame, root: int, small: int = SMALL) -> DataFrame:
    """r, d, leaves (childless nodes of the subtree) and saved (its sum of size by members less one) of trie() and paths()."""
    zero = F.lit(0).cast("long")
    rows = nodes.select(
        "r", "d", "pr", F.lit(root).alias("cr"), F.lit(0).alias("cd"), "below", (F.col("below") == 1).cast("long").alias("leaf"), F.when(F.col("d") == 0, zero).otherwise((F.col("members") - 1) * F.col("size")).alias("worth"), zero.alias("leaves"), zero.alias("saved")
    )
    columns, comp = rows.columns, ["cr", "cd"]
    whole, done = [], []
    while True:
        large = materialize(rows.groupBy(*comp).agg(F.max("below").alias("all")).where(F.col("all") > small), "large")
        n = large.count()
        if not n:
            break
        of = rows.join(bounded_broadcast(large, n), comp, "left")
        whole.append(of.where("all is null").select(*columns))
        of = of.where("all is not null")
        on_path = F.col("below") * 2 > F.col("all")
        centroids = of.where(on_path).groupBy(*comp).agg(F.max(F.struct("d", "r", "below")).alias("v"))
        centroids = materialize(centroids.select(*comp, F.col("v.d").alias("vd"), F.col("v.r").alias("vr"), F.col("v.below").alias("v_below")), "centroids")
        of = of.join(bounded_broadcast(centroids, n), comp)
        # A node under the centroid's depth stands under it if its conversation goes through it, and then the conversation's next node is the top of its new component.
        next_ = found.select(F.col("c").alias("r"), F.col("d").alias("at"), F.col("r").alias("nr"), F.col("pr").alias("npr"))
        of = of.withColumn("at", F.when(F.col("d") > F.col("vd"), F.col("vd") + 1)).join(next_, ["r", "at"], "left")
        of = of.withColumns({"path": on_path, "lower": F.coalesce(F.col("npr") == F.col("vr"), F.lit(False)), "gone": (F.col("r") == F.col("vr")) & (F.col("d") == F.col("vd"))})
        of = materialize(of.select(*columns, "vd", "v_below", "nr", "path", "lower", "gone"), "step")
        sums = of.where("lower or gone").groupBy(*comp).agg(F.sum("leaf").alias("s_leaf"), F.sum("worth").alias("s_worth"))
        of = of.join(bounded_broadcast(materialize(sums, "sums"), n), comp)
        of = of.withColumns({"leaves": F.col("leaves") + F.when(F.col("path"), F.col("s_leaf")).otherwise(0), "saved": F.col("saved") + F.when(F.col("path"), F.col("s_worth")).otherwise(0)})
        done.append(of.where("gone").select("r", "d", "leaves", "saved"))
        moved = {"below": F.col("below") - F.when(F.col("path"), F.col("v_below")).otherwise(0), "cr": F.when(F.col("lower"), F.col("nr")).otherwise(F.col("cr")), "cd": F.when(F.col("lower"), F.col("vd") + 1).otherwise(F.col("cd"))}
        rows = of.where("not gone").withColumns(moved).select(*columns)
    out = summed_whole(_union([*whole, rows]))
    return _union([out, *done])


def _union(frames: list[DataFrame]) -> DataFrame:
    first, *rest = frames
    for f in rest:
        first = first.unionByName(f)
    return first


def digests(ends: DataFrame) -> DataFrame:
    """ends (r, d, c) -> r, d, ends_sha256 of the decimal c, ascending, comma-joined. Sorted ids are packed into pieces where they are, so that a node of very many ends comes as few rows."""

    def pack(batches):
        for batch in batches:
            pdf = batch.to_pandas()
            text = pdf["c"].astype(str).mask(pdf["c"] == LAST, "")
            found = text.groupby([pdf["d"], pdf["r"]], sort=False).agg(",".join)
            first = pdf.groupby(["d", "r"], sort=False)["c"].min()
            d, r = (found.index.get_level_values(k).to_numpy() for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), pa.array(d, pa.int32()), pa.array(first.to_numpy(), pa.int64()), pa.array(found.tolist(), pa.string())], ["r", "d", "first", "ids"])

    def digest(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for r, d, ids in zip(*(batch.column(c).to_pylist() for c in ("r", "d", "ids"))):
                if (r, d) == node:
                    state.update(f",{ids}".encode())
                    continue
                if node:
                    out.append((*node, state.hexdigest()))
                node, state = (r, d), sha256(ids.encode())
            yield rows(out)
        if node:
            yield rows([(*node, state.hexdigest())])

    def rows(out):
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string()))], ["r", "d", "ends_sha256"])

    packed = ends.repartitionByRange("d", "r", "c").sortWithinPartitions("d", "r", "c").mapInArrow(pack, "r long, d int, first long, ids string")
    return packed.repartition("r", "d").sortWithinPartitions("r", "d", "first").mapInArrow(digest, "r long, d int, ends_sha256 string")


def prefix_trie(turns: DataFrame, small: int = SMALL) -> DataFrame:
    """turns (conv_id, turn, role, text) -> the nodes of the trie of the rebuilt conversations."""
    own = materialize(placed(turns), "turns")
    root = own.agg(F.min("c")).first()[0]
    rows, convs = rebuilt(own)
    root = 0 if root is None else root
    found = paths(rows, root)
    nodes = trie(found, convs, root).where("members > 0")  # no conversation, no root
    totals = materialize(rolled_up(nodes, found, root, small), "totals")
    children = nodes.where("d > 0").groupBy(F.col("pr").alias("r"), (F.col("d") - 1).alias("d")).agg(F.count("*").alias("children"))
    ends = digests(found.where("d = n").select("r", "d", "c").unionByName(convs.where("n = 0").select(F.lit(root).alias("r"), F.lit(0).alias("d"), "c")))
    out = nodes.join(totals, ["r", "d"]).join(children, ["r", "d"], "left").join(ends, ["r", "d"], "left")

    def shown(c):
        return F.when(F.col(c) != LAST, F.col(c))

    parent = F.when(F.col("d") > 0, shown("pr"))
    return out.select(
        shown("r").alias("conv_id"), F.col("d").cast("long").alias("depth"), parent.alias("parent_conv_id"), F.col("members").cast("long").alias("n_convs"), F.coalesce("children", F.lit(0)).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op12(spark, sf_dir) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: The checksum is worked out bit by bit; prefixes are compared as whole lists of turns; every node adds to all nodes above it.
OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn ASC NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations),
c AS (
  SELECT conv_id, max(pos) AS n, CASE WHEN conv_id IS NULL THEN 0 ELSE xor(list_reduce(
    list_concat([4294967295], flatten(list_transform(range(1, len(conv_id::VARCHAR) + 1), lambda i: list_concat([ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
    lambda a, e: CASE WHEN e >= 0 THEN xor(a, e) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 9 END AS h
  FROM t GROUP BY conv_id),
b AS (SELECT c.conv_id, c.h, least(c.h, coalesce(o.n, 0)) AS m FROM c LEFT JOIN c o ON o.conv_id = c.conv_id - c.conv_id % 5),
rt AS (
  SELECT b.conv_id, pos AS d, r, x FROM b JOIN t ON t.conv_id = b.conv_id - b.conv_id % 5 AND pos <= m
  UNION ALL SELECT b.conv_id, pos - h + m, r, x FROM b JOIN t ON t.conv_id IS NOT DISTINCT FROM b.conv_id AND pos > h
  UNION ALL SELECT conv_id, 0, '', '' FROM b),
k AS (SELECT conv_id, d, x, list(struct_pack(r := r, x := x)) OVER (PARTITION BY conv_id ORDER BY d) AS path FROM rt),
i AS (SELECT conv_id, d, x, min(conv_id) OVER (PARTITION BY path) AS id, count(*) OVER (PARTITION BY path) AS members FROM k),
p AS (SELECT *, lag(id) OVER (PARTITION BY conv_id ORDER BY d) AS pid, d = max(d) OVER (PARTITION BY conv_id) AS last FROM i),
node AS (
  SELECT id, d, any_value(pid) AS pid, any_value(members) AS members, (any_value(members) - 1) * CASE WHEN d = 0 THEN 0 ELSE any_value(octet_length(encode(x))) END AS worth,
         sha256(coalesce(string_agg(coalesce(conv_id::VARCHAR, ''), ',' ORDER BY conv_id ASC NULLS LAST) FILTER (WHERE last), '')) AS ends
  FROM p GROUP BY id, d),
kid AS (SELECT pid AS id, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
u AS (SELECT node.*, coalesce(kid.n, 0) AS n FROM node LEFT JOIN kid ON kid.id IS NOT DISTINCT FROM node.id AND kid.d = node.d),
s AS (SELECT a.id, a.d, sum((u.n = 0)::INT) AS leaves, sum(u.worth) AS saved FROM u JOIN p a ON a.conv_id IS NOT DISTINCT FROM u.id AND a.d <= u.d GROUP BY a.id, a.d)
SELECT u.id AS conv_id, u.d::BIGINT AS depth, pid AS parent_conv_id, members::BIGINT AS n_convs, n::BIGINT AS n_children, leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, ends AS ends_sha256
FROM u JOIN s ON s.id IS NOT DISTINCT FROM u.id AND s.d = u.d
"""
