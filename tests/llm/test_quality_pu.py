import numpy as np

from tidemark.llm import quality_pu


def test_held_out_ranking(spark):
    sf = "/root/testdata/sf0.01"
    out = quality_pu.op9(spark, sf)
    assert out.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    label = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in out.collect() if r.held_out and r.doc_id in label]
    good, bad = (np.array([r.score for r in rows if label[r.doc_id] == k]) for k in (1, 0))
    assert (good[:, None] > bad).mean() > 0.95
    assert np.mean([r.predicted == label[r.doc_id] for r in rows]) > 0.9


def test_edges(spark):
    rows = [(i, f"Some words of prose number {i}, as people write them.", "z") for i in range(60)] + [(60 + i, "### $$$ %%% " * (i + 3), "z") for i in range(20)]
    rows += [(None, None, None), (200, "", None), (200, "", None), (201, "long words " * 40000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(3, 0), (60, 0), (61, 0), (None, 1), (7, None), (62, 0)], "doc_id long, quality int")
    out = quality_pu.scored(docs, quality_pu.train(docs, labels), ["doc_id", "score"])
    assert out.columns == ["doc_id", "score", "_tm_score"] and out.where("_tm_score between 0 and 1").count() == len(rows)
    assert {r._tm_score for r in quality_pu.scored(docs, quality_pu.train(docs, labels.limit(0)), ["doc_id"]).collect()} == {0.5}
    assert quality_pu.scored(docs.limit(0), quality_pu.train(docs.limit(0), labels), ["doc_id"]).count() == 0


def planted(rng, n, share, apart):
    def draw(k, good):
        return rng.normal(size=(k, 4)) + (np.array([apart, 0, 0, 0]) if good else 0)

    u = np.vstack([draw(int(n * share), True), draw(n - int(n * share), False)])
    rng.shuffle(u)
    return draw(n, True), u


def test_prior_of_planted_mixtures():
    rng = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.8):
        p, u = planted(rng, 3000, share, 3.5)
        mean, std = u.mean(axis=0), u.std(axis=0)
        assert abs(quality_pu.class_prior(quality_pu.expanded(p, mean, std), quality_pu.expanded(u, mean, std)) - share) < 0.08
    assert quality_pu.class_prior(np.ones((1, 3)), np.ones((1, 3))) == 0.5


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(6)
    p, u, w = rng.normal(size=(30, 5)), rng.normal(size=(50, 5)), rng.normal(size=5)
    _, _, plus, minus = quality_pu.gradient(p, u, w, 0.4)
    for i in range(5):
        step = np.eye(5)[i] * 1e-6
        up, down = quality_pu.gradient(p, u, w + step, 0.4), quality_pu.gradient(p, u, w - step, 0.4)
        assert abs((up[0] - down[0]) / 2e-6 - plus[i]) < 1e-6 and abs((up[1] - down[1]) / 2e-6 - minus[i]) < 1e-6


def test_separates_without_negatives():
    rng = np.random.default_rng(7)
    p, u = planted(rng, 2000, 0.5, 3.5)
    mean, std, w = quality_pu.fit(p, u)
    good, bad = planted(rng, 500, 0, 3.5)
    score = lambda x: quality_pu.expanded(x, mean, std) @ w
    assert (score(good) > 0).mean() + (score(bad) < 0).mean() > 1.8


def test_a_repeated_trusted_row_is_one_row_of_the_sample(spark):
    docs = spark.createDataFrame([(1, "the same text again")] * 3000 + [(i, f"text {i}") for i in range(2, 40)], "doc_id long, text string")
    assert len(quality_pu._sample(docs, "text")) <= 39
    assert len(quality_pu._sample(docs.limit(0), "text")) == 0
