import hashlib
import math
import random
import re
import zlib

import pytest

from tests.oracle import compare, connection
from tidemark.llm import resampling
from tidemark.llm.resampling import drawn, nth, resampled, scored


def brute(docs, items, share=25):
    """Row number -> (n_features, weight, score, rank), straight from the definition."""

    def runs(text):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]], len(words)

    own, goal = [0] * 10000, [0] * 10000
    for counts, texts in ((own, [t for _, t in docs]), (goal, items)):
        for t in texts:
            for b in runs(t)[0]:
                counts[b] += 1
    s, t = sum(own), sum(goal)
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (s + 10000) / ((own[b] + 1) * (t + 10000)))) for b in range(10000)]
    out, able = {}, []
    for i, (d, text) in enumerate(docs):
        found, words = runs(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out[i] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        if words >= 20:
            able.append(i)
    able.sort(key=lambda i: (-out[i][2], docs[i][0] is None, docs[i][0] or 0))
    for rank, i in enumerate(able[: share * len(able) // 100], 1):
        out[i][3] = rank
    return [tuple(out[i]) for i in range(len(docs))]


def texts(n, seed=1):
    rng = random.Random(seed)
    words = ["Alpha", "beta", "gámma", "x1", "delta", "é", "über", "THE", "of", "zwei"] + [f"w{i}" for i in range(60)]
    return [" ".join(rng.choice(words) + rng.choice(["", ",", "...", "\n"]) for _ in range(rng.randint(15, 60))) for _ in range(n)]


def test_against_brute_force(spark):
    docs = [(i * 3, t) for i, t in enumerate(texts(200))] + [(1000, None), (1001, ""), (1002, "--- !!! "), (1003, "one " * 5000)]
    items = texts(10, 2) + [None, ""]
    got = drawn(scored(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in items], "text string"), ["doc_id"])).collect()
    want = dict(zip([d for d, _ in docs], brute(docs, items)))
    assert {r["doc_id"]: (r["_tm_features"], r["_tm_weight"], r["_tm_score"], r["_tm_rank"]) for r in got} == want
    assert any(r["_tm_rank"] for r in got)


def test_ties_repeated_rows_and_null_ids(spark):
    same = "the same words again and again " * 5
    docs = [(7, same)] * 40 + [(None, same)] * 20 + [(8, same)] * 20
    got = drawn(scored(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(same,)], "text string"), ["doc_id"]), 80).collect()
    ranks = sorted((r["_tm_rank"], r["doc_id"]) for r in got if r["_tm_rank"])
    assert [k for k, _ in ranks] == list(range(1, 65))
    assert [(n, d) for _, n, d in sorted((r["_tm_rank"], r["_tm_score"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got if r["_tm_rank"])] == sorted(((r["_tm_score"], -1 if r["doc_id"] is None else r["doc_id"]) for r in got if r["_tm_rank"]), key=lambda x: -x[0])


def test_rows_tied_in_score_are_cut_by_id(spark):
    rows = [(5, i, 100 + i, True) for i in (9, 3, 7, 1)] + [(5, None, 1, True), (6, 50, 2, True), (9, 1, 3, False)]
    got = drawn(spark.createDataFrame(rows, "_tm_score long, _tm_id long, _tm_row long, _tm_open boolean"), 67).collect()
    assert sorted((r["_tm_rank"], r["_tm_id"]) for r in got if r["_tm_rank"]) == [(1, 50), (2, 1), (3, 3), (4, 7)]


@pytest.mark.parametrize("values", [[5], [3, 3, 3], [-(1 << 63), 0, (1 << 63) - 1], list(range(100))])
def test_nth_by_bisection(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    for n in {1, len(values) // 2 + 1, len(values)}:
        at = sorted(values)[n - 1]
        assert nth(rows, rows["v"], n) == (at, sum(v < at for v in values), values.count(at))


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    docs = spark.createDataFrame([(1, texts(1)[0], "x", 4)], "doc_id long, text string, _tm_part string, n long")
    assert drawn(scored(none, none, ["doc_id"])).count() == 0
    assert [r["_tm_rank"] for r in drawn(scored(docs, none, ["doc_id"])).collect()] == [None]
    assert [r["n"] for r in resampled(docs, none, 100).collect()] == [4]


def test_draw_leans_to_the_target(spark):
    a, b = [f"alpha{i}" for i in range(40)], [f"beta{i}" for i in range(40)]
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices(a if i % 4 == 0 else b, k=40))) for i in range(400)]
    target = spark.createDataFrame([(" ".join(rng.choices(a, k=60)),) for _ in range(20)], "text string")
    ids = [r["doc_id"] for r in resampled(spark.createDataFrame(docs, "doc_id long, text string"), target).collect()]
    assert len(ids) == 100 and sum(i % 4 == 0 for i in ids) > 60


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    got = sorted(tuple(r) for r in resampling.op11(spark, sf).select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert [r[1:] for r in got] == [w for _, w in sorted(zip([d for d, _ in docs], brute(docs, items)))]


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    compare(resampling.op11(spark, sf), connection(sf), resampling.OP11_SQL)
