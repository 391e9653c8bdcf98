import random

import numpy as np

from tidemark.llm import langid

SOURCE = "/root/testdata/sf0.001/documents.parquet"


def test_held_out_accuracy_and_mixtures(spark):
    docs = spark.read.parquet(SOURCE)
    out = langid.op10(spark, "/root/testdata/sf0.001")
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    got = {r.doc_id: r for r in out.collect()}
    held = [(r.lang, got[r.doc_id].lang_pred) for r in docs.collect() if got[r.doc_id].held_out]
    assert len(held) > 20 and sum(a == b for a, b in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())
    text = {r.lang: r.text for r in docs.where("n_chars > 1500").collect()}
    model = langid.train(docs)
    one, two = text["en"][:1500], text["fr"][:1500]
    share, _, _ = langid.infer([one.encode(), (one + " " + two).encode()], model)
    at = [model.langs.index(x) for x in ("en", "fr")]
    assert share[0][at[0]] == 1 and share[0].sum() == 1
    assert all(0.3 < share[1][i] < 0.7 for i in at)


def test_edges(spark):
    text = spark.read.parquet(SOURCE).where("lang = 'en' and n_chars > 300").first().text
    rows = [(1, None, "en", "x"), (2, "", "en", None), (3, "12 34 -- !!", "en", "x"), (None, text, None, "x"), (None, text, None, "x"), (4, text, "en", "x"), (5, "é", None, "x"), (6, text * 300, "en", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    both = df.unionByName(spark.read.parquet(SOURCE).selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source as score"))
    out = langid.identified(df, langid.train(both), ["doc_id", "score"]).collect()
    assert [r._tm_lang for r in out] == ["und", "und", "und", "en", "en", "en", out[6]._tm_lang, "en"] and out[6]._tm_lang != "und"
    kept = langid.accepted(both)
    assert kept.columns == df.columns
    assert kept.where("doc_id is null or doc_id < 10").count() == 4 + kept.where("doc_id = 5").count()
    assert langid.accepted(df.limit(0)).count() == 0
    none = df.selectExpr("doc_id", "text", "cast(null as string) lang", "score")
    assert {r._tm_lang for r in langid.identified(none, langid.train(none), ["doc_id"]).collect()} == {"und"}


def test_words_of_one_letter_are_predicted(spark):
    texts = ["a", "I", "5 a", "x 1 y 2", "12", None, "é", "?? z ??", "1 2 3"]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    model = langid.train(spark.read.parquet(SOURCE))
    out = {r.doc_id: r for r in langid.identified(df.coalesce(1), model, ["doc_id"]).collect()}
    for i, t in enumerate(texts):
        assert (out[i]._tm_lang == "und") == (t is None or not any(c.isalpha() for c in t)), t
        assert (out[i]._tm_score > 0) == (out[i]._tm_lang != "und")


def test_accepts_mixed_texts_and_rejects_unknown_ones(spark):
    docs = spark.read.parquet(SOURCE)
    part = [r.text[:900] for r in docs.where("n_chars > 1500 and lang is not null").dropDuplicates(["lang"]).collect()]
    r = random.Random(3)
    rows = [(90_000, " ".join(part[:3])), (90_001, " ".join(part)), (90_002, "".join(r.choices("abcdefghijklmnopqrstuvwxyz    ", k=1500))), (90_003, "η γλώσσα είναι ελληνική και δεν την ξέρει κανείς εδώ " * 5), (90_004, part[0])]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x.doc_id for x in langid.accepted(docs.unionByName(more, allowMissingColumns=True)).collect()}
    assert kept & {k for k, _ in rows} == {90_000, 90_001, 90_004}


def test_em_against_a_dense_loop(monkeypatch):
    """The same steps for one text after another, gram by gram."""
    rng = np.random.default_rng(2)
    k, grams = 3, 50
    seen = rng.random((grams, k)) < 0.7
    model = langid.Model(["a", "b", "c"], *np.nonzero(seen), rng.integers(1, 100, seen.sum()), grams)
    log_p = model.of(np.arange(grams), np.arange(k)).astype(float)
    assert np.allclose(np.exp(log_p).sum(axis=0), 1, atol=1e-5) and (log_p <= model.top[:, None] + 1e-6).all()
    counts = [{int(g): int(n) for g, n in zip(rng.choice(grams, 12, replace=False), rng.integers(1, 9, 12))} for _ in range(5)]
    begin = np.full((5, k), 1 / k, np.float32)
    begin[3] = [0.5, 0.5, 0]
    flat = [(t, g, n) for t, c in enumerate(counts) for g, n in sorted(c.items())]
    text, gram, count = (np.array(x) for x in zip(*flat))
    start = np.searchsorted(text, np.arange(5))
    share, ll = langid.fit(gram, count.astype(np.float32), start, text, begin, model)
    monkeypatch.setattr(langid, "CELLS", 2 * len(gram))  # two languages at a time
    again, ll2 = langid.fit(gram, count.astype(np.float32), start, text, begin, model)
    assert np.allclose(share, again, atol=1e-6) and np.allclose(ll, ll2, rtol=1e-6)
    for t, c in enumerate(counts):
        own = begin[t].astype(float)
        for _ in range(langid.STEPS):
            new = np.zeros(k)
            for g, n in c.items():
                part = np.exp(log_p[g]) * own
                new += n * part / part.sum()
            own = new / sum(c.values())
        assert np.allclose(share[t], own, atol=1e-4)
        assert np.isclose(ll[t], sum(n * np.log((np.exp(log_p[g]) * own).sum()) for g, n in c.items()), rtol=1e-4)


def test_thousands_of_languages(spark):
    """All are learned, and a worker needs little more memory for them."""
    import resource

    rng = random.Random(4)
    rows = []
    for k in range(2000):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyz", 9)
        words = ["".join(rng.choices(letters, k=5)) for _ in range(12)]
        rows += [(3 * k + i, " ".join(rng.choices(words, k=40)), f"l{k:04}") for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = langid.train(df.where("doc_id % 3 < 2"))
    assert len(model.langs) == 2000
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    texts = [t.encode() for _, t, _ in rows[2:300:3]] + [(" ".join(t for _, t, _ in rows[:3000])).encode()]
    share, _, _ = langid.infer(texts[:-1], model)
    assert np.mean([model.langs[i] == rows[3 * j][2] for j, i in enumerate(share.argmax(axis=1))]) > 0.9
    long, _, _ = langid.infer(texts[-1:], model)  # a thousand languages in one text
    assert np.isclose(long.sum(), 1)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 600_000
