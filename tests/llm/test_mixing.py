from collections import Counter, defaultdict

import duckdb
import pytest

from tidemark.llm import mixing


def literal_targets(sizes):
    """Capped one round after the other, as the rule is stated."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        if not free:
            return fixed
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 2.0 * sizes[s] for s in over}


def write(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, source string, text string, target int").repartition(3).write.parquet(f"{path}/documents.parquet")


def rows():
    out = [(i, f"s{i % 7}" if i % 3 else "hot", "w " * (i % 23)) for i in range(900)]
    out += [(None, None, "a b c"), (None, "s1", None), (7, "s1", " \n"), (8, "solo", "x\ty\x0bz"), (8, "solo", "x\ty\x0bz"), (9, "Ünd", "v " * 5000), (10, "empty", "")]
    return [(*r, 1) for r in out]


def test_against_sql_and_the_rule(spark, tmp_path):
    write(spark, tmp_path, rows())
    got = mixing.op8(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    got = [tuple(r) for r in got.collect()]
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duckdb.sql(mixing.OP8_SQL).fetchall()
    assert Counter(got) == Counter(want)
    size, taken = Counter(), defaultdict(int)
    for d, s, t, _ in rows():
        size[s] += len((t or "").split())
    goal = literal_targets(size)
    for d, n, all_, target, k in got:
        assert 0 <= k <= 2 * n
        taken[all_, target] += k
    assert sorted((size[s], round(g, 6)) for s, g in goal.items()) == sorted(x for s in goal for x in {(a, round(b, 6)) for _, _, a, b, _ in got if (a, round(b, 6)) == (size[s], round(goal[s], 6))})
    for (of, target), k in taken.items():
        same = sum(1 for s in goal if size[s] == of and abs(goal[s] - target) < 1e-6)
        assert abs(k - same * target) <= same


def test_small_ranges_and_a_key_of_many_rows(spark, tmp_path, monkeypatch):
    """Many ranges a source, and rows alike that are more than a range, cut by the partitions they are stored in."""
    monkeypatch.setattr(mixing, "RANGE_ROWS", 20)
    data = [*rows(), *[(77, "hot", "one two three", 1)] * 400, *[(78, None, "four five", 1)] * 300]
    write(spark, tmp_path, data)
    got = Counter(tuple(r) for r in mixing.op8(spark, str(tmp_path)).collect())
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == Counter(duckdb.sql(mixing.OP8_SQL).fetchall())


def test_running_sums(spark):
    rows = [(f"k{i * 7919 % 500:03}", i % 11) for i in range(500)] + [(None, 3)]
    df = spark.createDataFrame(rows, "k string, n long")
    from pyspark.sql import functions as F

    got = {r.k: (r.rank, r.upto) for r in mixing.running(df, [F.col("k").asc_nulls_last()], {"rank": F.lit(1), "upto": F.col("n")}).collect()}
    upto = 0
    for i, (k, n) in enumerate(sorted(rows, key=lambda r: (r[0] is None, r[0]))):
        assert got[k] == (i, upto)
        upto += n


def test_rows_of_the_mix(spark):
    df = spark.createDataFrame(rows(), "doc_id long, source string, text string, target int")
    out = mixing.repeated(df)
    assert out.columns == df.columns
    given = Counter(tuple(r) for r in df.collect())
    for r, n in Counter(tuple(r) for r in out.collect()).items():
        assert n <= 2 * given[r]
    assert mixing.repeated(df.limit(0)).count() == 0


@pytest.mark.parametrize("text,n", [("", 0), (" a ", 1), ("a\x0bb\fc\rd", 4), ("a b", 1), ("\x1ca", 1), (None, 0)])
def test_words(spark, text, n):
    assert spark.createDataFrame([(text,)], "t string").select(mixing.words("t")).first()[0] == n
