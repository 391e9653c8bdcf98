"""A mix of sources to target weights: hash-random order, a range sort, distributed prefix sums, a cut at the exact budget.

Each row has a random key, an MD5 of seed, doc_id and text, and a row number, the same at every reading, that orders rows alike. Within each source rows are sorted by ranges of the key: a source
has as many ranges as its rows ask for, and a key of very many rows is cut by row number. Prefix sums of the ranges' words, and of the words inside
each range, give every row the words before it in its source; the row in which the rest of the source's budget ends is the cut. A budget over the source's size takes
whole epochs first. The mix is then a comparison of each row with its source's cut, so no text is ever moved.

Targets: sources by code point, null last, have weights 5, 2, 1, repeating, and share SHARE of all words; a target stops at
CAP times its source's size and the excess goes to the others by weight, until none is above.

Defined results: a null text has size 0; a null source is one source; repeated rows count each; rows of size 0 are never
taken; an empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_broadcast, materialize, table, with_row_ids

WEIGHTS, SHARE, CAP, SEED = (5, 2, 1), 1.5, 2, "mix-1"
SPACE = " \t\n\x0b\f\r"
#: Rows that one range of a source should have.
RANGE_ROWS = 100_000
#: Hexadecimal digits of the key that make ranges.
DIGITS = 7


def words(text: str):
    """The number of runs of other characters than SPACE."""
    trimmed = F.btrim(text, F.lit(SPACE))
    return F.when(F.coalesce(F.length(trimmed), F.lit(0)) == 0, 0).otherwise(F.size(F.split(trimmed, "[ \\t-\\r]+"))).cast("long")


def with_keys(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with _tm_size and _tm_key."""
    digest = F.md5(F.coalesce(text, F.lit("")).cast("binary"))
    return docs.withColumns({"_tm_size": words(text), "_tm_key": F.md5(F.concat_ws(":", F.lit(SEED), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), digest).cast("binary"))})


def running(rows: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """rows with the named sums over all rows before, in a total order that no single task sees: a range sort, sums of its partitions, and sums inside them."""
    columns = rows.columns
    parted = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    parted = materialize(parted.withColumns({"_tm_part": F.spark_partition_id(), "_tm_at": F.monotonically_increasing_id()}), "running")
    # One row for each partition.
    totals = parted.groupBy("_tm_part").agg(*[F.sum(c).alias(f"_tm_{name}") for name, c in sums.items()])
    before = Window.orderBy("_tm_part").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("_tm_part").orderBy("_tm_at").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_tm_part", *[F.coalesce(F.sum(f"_tm_{name}").over(before), F.lit(0)).alias(f"_tm_{name}") for name in sums])
    found = parted.join(F.broadcast(starts), "_tm_part")
    return found.select(*columns, *[(F.col(f"_tm_{name}") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(name) for name, c in sums.items()])


def targets(sizes: DataFrame) -> DataFrame:
    """From (_tm_source, _tm_of), a source and its size: the target of each. One row a source."""
    rank = running(sizes, [F.col("_tm_source").asc_nulls_last()], {"rank": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    rows = materialize(rank.select("_tm_source", "_tm_of", weight.alias("w"), (CAP * F.col("_tm_of").cast("double")).alias("cap")), "mix-weights")
    words, weights = rows.agg(F.sum("_tm_of"), F.sum("w")).first()
    # Those with the least cap by weight are capped first: the level is that of the first row that stays under its cap.
    ratio = F.col("cap") / F.col("w")
    under = running(rows, [ratio.asc(), F.col("_tm_source").asc_nulls_last()], {"caps": F.col("cap"), "ws": F.col("w")})
    level = (F.lit(SHARE * float(words or 0)) - F.col("caps")) / (F.lit(float(weights or 0)) - F.col("ws"))
    found = under.select(F.min(F.when(level <= ratio, F.struct(ratio.alias("ratio"), level.alias("level"))))["level"]).first()[0]
    return rows.select("_tm_source", "_tm_of", F.least("cap", F.lit(found if found is not None else 0.0) * F.col("w")).alias("_tm_target"))


def budgets(docs: DataFrame, source: str) -> DataFrame:
    """One row a source: its size, target, whole epochs, and the row (key and number) in which the rest of the budget ends, with the words it gives. docs are stored digests, with _tm_size, _tm_key and _tm_row."""
    rows = docs.where("_tm_size > 0").select(F.col(source).alias("_tm_source"), "_tm_size", "_tm_key", "_tm_row")
    sizes = materialize(docs.groupBy(F.col(source).alias("_tm_source")).agg(F.sum("_tm_size").alias("_tm_of"), F.count("*").alias("n")), "mix-sizes")
    goal = targets(sizes.select("_tm_source", "_tm_of"))
    size = F.greatest("_tm_of", F.lit(1))
    goal = goal.withColumn("_tm_epochs", F.floor(F.floor("_tm_target") / size)).withColumn("_tm_rest", F.floor("_tm_target") - F.col("_tm_epochs") * F.col("_tm_of"))
    parts = sizes.select(F.col("_tm_source").alias("s"), F.ceil(F.col("n") / RANGE_ROWS).alias("parts"))
    goal = materialize(goal.join(parts, goal["_tm_source"].eqNullSafe(parts["s"])).drop("s"), "mix-goals")

    # Ranges of the key, by source; a key of more rows than a range is a range by itself, cut into 256 by row number.
    hot = rows.groupBy("_tm_source", "_tm_key").agg(F.count("*").alias("n")).where(F.col("n") > RANGE_ROWS).groupBy(F.col("_tm_source").alias("h")).agg(F.array_sort(F.collect_list("_tm_key")).alias("_tm_hot"))
    ranges = goal.join(hot, goal["_tm_source"].eqNullSafe(F.col("h")), "left").select(F.col("_tm_source").alias("s"), "parts", F.coalesce("_tm_hot", F.array().cast("array<string>")).alias("_tm_hot"))
    ranges = materialize(ranges, "mix-ranges")
    rows = rows.join(bounded_broadcast(ranges, ranges.count()), rows["_tm_source"].eqNullSafe(ranges["s"]))
    whole = F.conv(F.substring("_tm_key", 1, DIGITS), 16, 10).cast("long")
    is_hot = F.array_contains("_tm_hot", F.col("_tm_key"))
    rows = rows.withColumns(
        {
            "_tm_range": F.floor(whole * F.col("parts") / F.lit(16**DIGITS)),
            "_tm_step": F.when(F.size("_tm_hot") == 0, 0).otherwise(2 * F.size(F.filter("_tm_hot", lambda h: h < F.col("_tm_key"))) + is_hot.cast("int")),
            "_tm_piece": F.when(is_hot, F.shiftright("_tm_row", 56)).otherwise(F.lit(0).cast("long")),
        }
    ).select("_tm_source", "_tm_size", "_tm_key", "_tm_row", "_tm_range", "_tm_step", "_tm_piece")
    bins = ["_tm_source", "_tm_range", "_tm_step", "_tm_piece"]
    sums = rows.groupBy(*bins).agg(F.sum("_tm_size").alias("n"))
    in_source = Window.partitionBy("_tm_source").orderBy(*bins[1:]).rowsBetween(Window.unboundedPreceding, -1)
    sums = materialize(sums.withColumn("below", F.coalesce(F.sum("n").over(in_source), F.lit(0))), "mix-prefixes")
    starts = sums.select(*[F.col(c).alias(c + "_e") for c in bins], "below")
    same = [rows[c].eqNullSafe(starts[c + "_e"]) for c in bins]
    in_range = Window.partitionBy(*bins).orderBy("_tm_key", "_tm_row").rowsBetween(Window.unboundedPreceding, -1)
    summed = rows.withColumn("inside", F.coalesce(F.sum("_tm_size").over(in_range), F.lit(0))).join(bounded_broadcast(starts, sums.count()), same)
    rest = goal.select(F.col("_tm_source").alias("g"), "_tm_rest")
    summed = summed.join(bounded_broadcast(rest, ranges.count()), F.col("_tm_source").eqNullSafe(F.col("g"))).withColumn("before", F.col("below") + F.col("inside"))
    cut = summed.where((F.col("before") <= F.col("_tm_rest")) & (F.col("_tm_rest") < F.col("before") + F.col("_tm_size")))
    cut = cut.select(F.col("_tm_source").alias("s"), F.col("_tm_key").alias("_tm_cut_key"), F.col("_tm_row").alias("_tm_cut_row"), (F.col("_tm_rest") - F.col("before")).alias("_tm_cut_words"))
    return materialize(goal.join(cut, F.col("_tm_source").eqNullSafe(F.col("s")), "left").drop("s", "parts", "_tm_rest"), "mix-budgets")


def mixed(docs: DataFrame, digests: DataFrame, source: str = "source") -> DataFrame:
    """docs (with _tm_size, _tm_key and _tm_row, as in the stored digests) with _tm_of, _tm_target, _tm_epochs (whole repeats) and _tm_last (words of the cut epoch)."""
    goal = budgets(digests, source)
    rows = docs.join(bounded_broadcast(goal, goal.count()), docs[source].eqNullSafe(goal["_tm_source"]))
    key, row = F.col("_tm_cut_key"), F.col("_tm_cut_row")
    below = (F.col("_tm_key") < key) | ((F.col("_tm_key") == key) & (F.col("_tm_row") < row))
    # No cut: all sizes are 0.
    last = F.when(below, F.col("_tm_size")).when((F.col("_tm_key") == key) & (F.col("_tm_row") == row), F.col("_tm_cut_words")).otherwise(0)
    return rows.select(*docs.columns, "_tm_of", "_tm_target", "_tm_epochs", last.alias("_tm_last"))


def repeated(docs: DataFrame, source: str = "source", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The mix as rows: each one once for every epoch that takes it. The row in which a budget ends is whole where at least half of it is within, else left out."""
    columns = docs.columns
    rows = with_row_ids(with_keys(docs, text, doc_id))
    rows = mixed(rows, materialize(rows.select(source, "_tm_size", "_tm_key", "_tm_row"), "mix-rows"), source)
    times = F.col("_tm_epochs") + (F.col("_tm_last") * 2 >= F.col("_tm_size")).cast("int")
    rows = rows.where("_tm_size > 0").withColumn("_tm_times", F.array_repeat(F.lit(1), times.cast("int")))
    return rows.withColumn("_tm_copy", F.explode("_tm_times")).select(*columns)


def op8(spark, sf_dir) -> DataFrame:
    docs = with_row_ids(with_keys(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    docs = materialize(docs.select("doc_id", "source", "_tm_size", "_tm_key", "_tm_row"), "mix-rows")
    taken = F.col("_tm_epochs") * F.col("_tm_size") + F.col("_tm_last")
    return mixed(docs, docs).select("doc_id", F.col("_tm_size").alias("size"), F.col("_tm_of").alias("source_size"), F.col("_tm_target").alias("target"), taken.cast("long").alias("taken"))


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
src AS (
  SELECT source, sum(size)::BIGINT AS n, [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3)::INT]::DOUBLE AS w
  FROM sized GROUP BY source),
ordered AS (
  SELECT source, n, w, 2 * n::DOUBLE AS cap,
         (1.5::DOUBLE * sum(n::DOUBLE) OVER ()
          - coalesce(sum(2 * n::DOUBLE) OVER (ORDER BY 2 * n::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 2 * n::DOUBLE / w, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM src),
goal AS (
  SELECT source, n, least(cap, w * (SELECT arg_min(level, cap / w) FROM ordered WHERE level <= cap / w)) AS target FROM ordered),
cut AS (
  SELECT source, n, target, floor(floor(target) / greatest(n, 1))::BIGINT AS epochs,
         (floor(target) - floor(floor(target) / greatest(n, 1)) * n)::BIGINT AS rest FROM goal),
run AS (
  SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized)
SELECT doc_id, size::BIGINT AS size, n::BIGINT AS source_size, target::DOUBLE AS target,
       (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
FROM run JOIN cut ON run.source IS NOT DISTINCT FROM cut.source
"""
