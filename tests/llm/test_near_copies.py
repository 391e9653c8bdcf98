import random

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import near_copies


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_kept(rows):
    """Brute-force Jaccard over all pairs; the smallest doc_id of each component."""
    sets, root = [plain_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= 0.8 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(d, least.get(find(i), d))
    return sorted(least.values())


def edited(rng, words, edits):
    out = list(words)
    for at in rng.sample(range(len(out)), edits):
        out[at] = f"new{rng.randrange(10**6)}"
    return out


def planted():
    """60 texts of 40 to 200 words, each with copies of which up to 4 in 100 words are changed, some with a passage moved or cut."""
    rng, texts = random.Random(3), []
    for _ in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 200))]
        texts.append(words)
        texts += [edited(rng, words, rng.randrange(0, max(1, len(words) // 25) + 1)) for _ in range(4)]
        texts += [words[len(words) // 10 :], words[: len(words) // 2], words[20:] + words[:20]]
    rng.shuffle(texts)
    rows = [(i, " ".join(w)) for i, w in enumerate(texts)]
    return rows + [(1000, ""), (1001, None), (1002, "one two"), (1003, "One  two"), (1004, "one three")]


@pytest.mark.parametrize("block", [near_copies.BLOCK, 3])
def test_stage_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_copies, "BLOCK", block)
    rows = planted()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = corpus_pipeline.near_dedup(spark, df, "")
    assert got.columns == ["doc_id", "text"]
    assert sorted(r.doc_id for r in got.collect()) == plain_kept(rows)


def test_empty_table(spark):
    assert near_copies.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_close_pairs_against_plain_distances():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**64, 300, "u8")
    sets = [np.unique(np.concatenate([base[: 300 - k], rng.integers(0, 2**64, k, "u8")])) for k in range(0, 300, 2)]
    fp = [near_copies.fingerprint(s) for s in sets]
    near = near_copies.close_pairs(sets)
    assert near.tolist() == [[(a ^ b).bit_count() <= near_copies.RADIUS for b in fp] for a in fp]
    few = [s[:20] for s in sets[:5]]
    assert near_copies.close_pairs([*few, *sets[-3:]])[:5].all()
    assert near_copies.fingerprint(np.zeros(0, "<u8")) == 0


@pytest.mark.parametrize("size", [4, 5, 9, 20, 63, 64, 100, 300, 1000])
def test_recall_of_planted_pairs(size):
    """Pairs just at the similarity, in groups of two and of many: nothing is lost, and what is linked does not depend on the group."""
    rng = np.random.default_rng(size)
    shared = -(-8 * size // 9)  # both of `size`, so that shared / (2 size - shared) >= 0.8
    pairs, found = [], 0
    for _ in range(150):
        common = rng.integers(0, 2**64, shared, "u8")
        pairs.append([np.unique(np.concatenate([common, rng.integers(0, 2**64, size - shared, "u8")])) for _ in range(2)])
    alone = [bool(near_copies.linked(p, False, np.zeros(2, bool))) for p in pairs]
    assert np.mean(alone) >= 0.99
    flat = [s for p in pairs for s in p]
    together = {(min(a, b), max(a, b)) for a, b in near_copies.linked(flat, False, np.zeros(len(flat), bool))}
    assert [(2 * i, 2 * i + 1) in together for i in range(len(pairs))] == alone
