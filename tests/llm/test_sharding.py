import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tidemark.llm import sharding
from tidemark.llm.common import with_row_ids


def rows():
    out = [(i, f"text {i} " * (1 + i % 37), "x") for i in range(3000)]
    out += [(10_000 + i, "a text of which there are very many copies", "y") for i in range(1500)]
    out += [(20_000 + i, f"pair {i // 2} of two", "y") for i in range(600)]
    return [*out, (None, "no id", None), (None, None, None), (5, "text", "z"), (5, "text", "z"), (6, "", "z"), (7, "long " * 3000, "z")]


def frame(spark, data):
    return spark.createDataFrame(data, "doc_id long, text string, shard string")


def placed(df):
    return sharding.placed(with_row_ids(sharding.keyed(df)), ["doc_id"])


def check(out, data):
    """Against plain sums: all rows, sizes near equal, gapless slots, contiguous keys, cuts where they belong, groups in one shard unless they are large."""
    assert Counter((r.doc_id, r.text, r.shard) for r in out) == Counter(data)
    assert all(r._tm_bytes == len((r.text or "").encode()) + 8 for r in out)
    size, slots, groups = Counter(), defaultdict(list), defaultdict(lambda: defaultdict(int))
    for r in out:
        size[r._tm_shard] += r._tm_bytes
        slots[r._tm_shard].append(r._tm_slot)
        groups[r._tm_key >> 32][r._tm_shard] += r._tm_bytes
    total = sum(size.values())
    mean = total / 24
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    spans = sorted((s, min(r._tm_key for r in out if r._tm_shard == s), max(r._tm_key for r in out if r._tm_shard == s)) for s in size)
    assert all(a[2] <= b[1] for a, b in zip(spans, spans[1:]))
    split = {g: p for g, p in groups.items() if len(p) > 1}
    assert all(sum(p.values()) > sharding.GROUP * mean for p in split.values())
    below = 0
    for s in range(23):
        below += size[s]
        goal = mean * (s + 1)
        # off by the tolerance, half a group that is kept whole, or half a row
        row = max((r._tm_bytes for r in out if r._tm_shard in (s, s + 1)), default=0)
        assert abs(below - goal) <= max(sharding.TOLERANCE * mean, sharding.GROUP * mean / 2, row), s
    return size, split


def test_placement_against_plain_sums(spark):
    df = frame(spark, rows())
    out = placed(df).collect()
    size, split = check(out, rows())
    assert set(size) == set(range(24))
    assert {r.text for r in out if r._tm_key >> 32 in split} <= {"a text of which there are very many copies"} | {r.text for r in out if r._tm_bytes > 5000}
    again = {(r.doc_id, r.text): r._tm_shard for r in placed(df.repartition(7)).collect()}
    assert all(again[r.doc_id, r.text] == r._tm_shard for r in out if (r.doc_id, r.text) != (5, "text"))


def test_rows_alike_in_everything_are_shared_out(spark):
    data = [(i, f"text {i}", "x") for i in range(4000)] + [(77, "the same row", "y")] * 20_000
    size, split = check(placed(frame(spark, data)).collect(), data)
    assert set(size) == set(range(24)) and max(size.values()) < 1.1 * min(size.values()) and len(split) == 1


def test_splitters_meet_their_goals(spark):
    keys = sharding.keyed(frame(spark, rows())).withColumn("_tm_tie", F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 32)).select("_tm_key", "_tm_tie", "_tm_bytes")
    held = sorted((k * 2**32 + t, n) for k, t, n in keys.collect())
    total = sum(n for _, n in held)
    goals = [total * j / 50 for j in range(1, 50)]
    for goal, cut in zip(goals, sharding.splitters(keys, goals, 200, 0)):
        assert abs(sum(n for k, n in held if k < cut) - goal) <= 200 or any(abs(sum(n for k, n in held if k < cut) - goal) <= n for _, n in held if n > 200)


def test_query_columns_and_empty(spark, tmp_path):
    frame(spark, rows()).write.parquet(f"{tmp_path}/documents.parquet")
    out = sharding.op7(spark, str(tmp_path))
    assert out.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]
    assert Counter((r.doc_id, r.text_crc32) for r in out.collect()) == Counter((d, zlib.crc32((t or "").encode())) for d, t, _ in rows())
    assert placed(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    # A scan of files has row numbers of its own: nothing but keys is written.
    data = [(i, f"text {i}", "x") for i in range(2000)] + [(77, "the same row", "y")] * 9000
    frame(spark, data).repartition(3).write.parquet(f"{tmp_path}/alike")
    check(placed(spark.read.parquet(f"{tmp_path}/alike")).collect(), data)
    kept = sharding.sharded(frame(spark, rows()))
    assert kept.columns == ["doc_id", "text", "shard", "slot"] and kept.count() == len(rows())
