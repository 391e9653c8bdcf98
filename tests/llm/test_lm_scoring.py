import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import lm_scoring
from tidemark.llm.lm_scoring import HIGH, LOW, Runs, bits, head_words, levels, op13, scored, split

SCHEMA = "doc_id long, text string"


def folds(d):
    return zlib.crc32(("" if d is None else str(d)).encode()) % 5


def tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w] + [""]


def brute(docs, prior=lm_scoring.PRIOR):
    """doc_id -> (n_tokens, n_known, train_tokens, base, score), with exact counts cut to their levels and no filter."""
    one, two = Counter(), Counter()
    for d, t in docs:
        if folds(d) != 1:
            w = tokens(t)
            one.update(w)
            two.update(zip(["", *w], w))
    n, v = sum(one.values()), len(one)

    def low(c):
        return 0 if c == 0 else max(int(x) for x in LOW if x <= c)

    def high(c):
        return 0 if c == 0 else min(int(x) for x in HIGH if x >= c)

    out = {}
    for d, t in docs:
        w = tokens(t)
        total = n + 0.5 * (v + 1)
        base = sum(math.log10((one[x] + 0.5) / total) for x in w)
        score = 0.0
        for a, b in zip(["", *w], w):
            p = (low(one[b]) + 0.5) / total
            score += math.log10((low(two[a, b]) + prior * p) / (high(one[a]) + prior))
        out[d] = (len(w), sum(x in one for x in w), n, base, score)
    return out


def texts(n, seed):
    rng = random.Random(seed)
    words = [f"Wort{i}é" for i in range(300)]
    out = []
    for _ in range(n):
        at, line = rng.randrange(300), []
        for _ in range(rng.randint(0, 80)):
            at = (at * 7 + rng.choice([1, 1, 1, 2, 50])) % 300
            line.append(words[at] + rng.choice([" ", " ", "\n", " \t "]))
        out.append("".join(line))
    return out


DOCS = [*enumerate(texts(200, 1)), (1000, None), (1001, ""), (1002, "rare one Wort1é " * 300), (None, "Wort1é Wort8é")]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_base_is_exact_and_scores_follow_exact_counts(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA)
    want = brute(DOCS)
    for head in (200_000, 20, 0):  # all words in the table, some, none
        got = by_id(scored(docs, ["doc_id"], head=head))
        assert got.keys() == want.keys()
        off = []
        for d, (n, known, train, base, score) in want.items():
            r = got[d]
            assert (r["_tm_tokens"], r["_tm_known"], r["_tm_train"]) == (n, known, train) and r["_tm_held_out"] == (folds(d) == 1)
            assert math.isclose(r["_tm_base"], base, rel_tol=1e-9)
            assert r["_tm_score"] >= score - 0.02 * n - 0.5  # a wrong hit makes a token likelier, or its context a little more frequent
            off.append(abs(r["_tm_score"] - score) / n)
        assert np.mean(off) < 0.02


def test_exchange_gives_the_scores_of_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", 500)
    docs = spark.createDataFrame(DOCS, SCHEMA)
    for order in (1, 2, 3):
        a, b = (by_id(scored(docs, ["doc_id"], order=order, most_broadcast=m)) for m in (1 << 30, 0))
        assert a.keys() == b.keys() and all(math.isclose(a[d]["_tm_score"], b[d]["_tm_score"], rel_tol=1e-12) for d in a)


def test_texts_ask_groups_of_many_blocks_in_bounded_batches(spark, monkeypatch):
    batch = pa.RecordBatch.from_pylist([{"_tm_row": i, "_tm_text": t.encode()} for i, t in enumerate(texts(2000, 3))])
    monkeypatch.setattr(lm_scoring, "CHUNK", 1 << 16)
    most = [(b.num_rows, b.nbytes) for b in lm_scoring.questions([batch], 1024, 4)]
    assert len(most) > 50 and max(rows for rows, _ in most) < 1000 and max(size for _, size in most) < 100_000
    assert sum(rows for rows, _ in most) <= 4 * 2000
    # The same scores, whatever the groups: of many blocks each, of one.
    monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", 200)
    docs = spark.createDataFrame(DOCS, SCHEMA)
    want = by_id(scored(docs, ["doc_id"]))
    for size in (1 << 20, 4000, 1):
        monkeypatch.setattr(lm_scoring, "GROUP_BYTES", size)
        got = by_id(scored(docs, ["doc_id"], most_broadcast=0))
        assert got.keys() == want.keys() and all(math.isclose(got[d]["_tm_score"], want[d]["_tm_score"], rel_tol=1e-12) for d in want)


def test_filter_never_misses_and_rarely_errs():
    rng = np.random.default_rng(2)
    runs = np.unique(rng.integers(0, 1 << 63, 20000).astype(np.uint64) * np.uint64(2))
    level = rng.integers(1, 9, len(runs))
    number = np.concatenate([np.arange(1, q + 1) for q in level])
    words = np.zeros(len(number) * lm_scoring.BITS // 64, np.uint64)
    place, mask = bits(np.repeat(runs, level), number, np.full(len(number), len(words)))
    np.bitwise_or.at(words, place, mask)
    start = np.array([0, len(words)])
    got = levels(runs, words, start)
    assert (got >= level).all() and np.mean(got > level) < 0.03
    assert np.mean(levels(runs + np.uint64(1), words, start) > 0) < 0.03


def test_levels_bound_counts():
    for c in [*range(1, 500), 10**6, 10**12]:
        q = np.searchsorted(LOW, c, "right")
        assert LOW[q - 1] <= c <= HIGH[q - 1] and q == 1 + math.floor(math.log(c, 1.5) + 1e-9)


def test_probabilities_after_a_context_sum_to_at_most_one():
    train = [split(t.encode()) for t in texts(300, 4)]
    runs, k = np.unique(np.concatenate([Runs([t]).counted() for t in train]), return_counts=True)
    exact = dict(zip(runs.tolist(), k.tolist()))

    def level_of(x):
        return np.searchsorted(LOW, [exact.get(r, 0) for r in x.tolist()], "right") * np.array([r in exact for r in x.tolist()])

    vocabulary = sorted({w for t in train for w in t})
    n = sum(len(t) + 1 for t in train)
    total = n + 0.5 * (len(vocabulary) + 2)
    for context in (vocabulary[0], vocabulary[100], b"unknown"):
        before = Runs([[context]]).scores(level_of, total, 1)[0]
        # p(context, w, end) / p(end | w), over all w and the end after the context
        mass = 0.0
        for w in [*vocabulary, b"never seen"]:
            r = Runs([[context, w]])
            whole = r.scores(level_of, total, 1)[0]
            alone = Runs([[w]])
            last = alone.scores(level_of, total, 1)[0] - first_of(alone, level_of, total)
            mass += 10 ** (whole - last - first_of(Runs([[context]]), level_of, total))
        mass += 10 ** (before - first_of(Runs([[context]]), level_of, total))
        assert 0.5 < mass <= 1 + 1e-9


def first_of(runs, level_of, total):
    """log10 of the first token's probability after the start."""
    runs.token = runs.token & (np.arange(len(runs.token)) == 1)
    return runs.scores(level_of, total, 1)[0]


def test_held_out_texts_are_likelier_than_shuffled_and_than_base(spark):
    docs = list(enumerate(texts(1500, 6)))
    rng = random.Random(1)
    mixed = [(d + 10**6, " ".join(rng.sample(t.split(), len(t.split())))) for d, t in docs if folds(d + 10**6) == 1]
    got = by_id(scored(spark.createDataFrame(docs + mixed, SCHEMA), ["doc_id"]))
    plain = [r for d, r in got.items() if d < 10**6 and r["_tm_held_out"]]
    assert sum(r["_tm_score"] for r in plain) > sum(r["_tm_base"] for r in plain)
    per = lambda rows: sum(r["_tm_score"] for r in rows) / sum(r["_tm_tokens"] for r in rows)
    assert per(plain) > per([r for d, r in got.items() if d >= 10**6]) + 0.1


def test_head_is_bounded(spark):
    counts = spark.createDataFrame([(f"w{i}".encode(), 1 + i % 40) for i in range(400)] + [(b"x" * 1000, 10**6)], "word binary, n long")
    for most in (0, 10, 100, 400):
        assert len(head_words(counts, most)) <= most
    assert len(head_words(counts, 400)) == 400


@pytest.mark.parametrize("rows", [[], [(1, "only held out?")], [(3, None)]])
def test_edges(spark, rows):
    got = by_id(scored(spark.createDataFrame(rows, SCHEMA), ["doc_id"]))
    want = brute(rows)
    assert got.keys() == want.keys()
    assert all(math.isclose(got[d]["_tm_base"], want[d][3], abs_tol=1e-12) and math.isclose(got[d]["_tm_score"], want[d][4], abs_tol=1e-9) for d in want)


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "z", 3, 4)], SCHEMA + ", word string, n long, levels long")
    assert [tuple(r)[:3] for r in scored(docs, ["doc_id", "word", "n"]).collect()] == [(1, "z", 3)]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(docs)
    got = op13(spark, sf).collect()
    assert len(got) == len(docs)
    assert all((r["n_tokens"], r["n_known"], r["train_tokens"]) == want[r["doc_id"]][:3] and math.isclose(r["base_score"], want[r["doc_id"]][3], rel_tol=1e-9) for r in got)


def test_exchange_asks_for_many_texts_at_once(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", 200)
    monkeypatch.setattr(lm_scoring, "GROUP_BYTES", 500)
    docs = spark.createDataFrame(DOCS, SCHEMA).coalesce(2)
    calls, plain = spark.sparkContext.accumulator(0), lm_scoring.levels

    def counted(*given):
        calls.add(1)
        return plain(*given)

    for order, most in ((2, 8000), (3, 12_000)):  # shorter runs go by broadcast, those of full order by exchange
        want = by_id(scored(docs, ["doc_id"], order=order))
        before = calls.value
        with monkeypatch.context() as m:
            m.setattr(lm_scoring, "levels", counted)
            got = by_id(scored(docs, ["doc_id"], order=order, most_broadcast=most))
        assert 0 < calls.value - before < len(DOCS)
        assert got.keys() == want.keys() and all(math.isclose(got[d]["_tm_score"], want[d]["_tm_score"], rel_tol=1e-12) for d in want)


def test_packed_runs_come_back():
    runs = Runs([split(t.encode()) for t in texts(50, 5)], 3)
    for k, run in runs.runs.items():
        assert (lm_scoring.unpacked(lm_scoring.packed(run)) == run).all() and (run >> np.uint64(63) == (k == 3)).all()
    assert lm_scoring.packed(np.zeros(0, np.uint64)) == b"" and len(lm_scoring.unpacked(b"")) == 0
