import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows):
    """rows: (doc_id, text). Brute force over all pairs of different fingerprints."""
    fp = [plain_fingerprint(t) for _, t in rows]
    root = {f: f for f in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = sorted(root)
    for i, a in enumerate(every):
        for b in every[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    least = {}
    for (d, _), f in zip(rows, fp):
        if d is not None:
            least[find(f)] = min(d, least.get(find(f), d))
    return sorted((str(d), f"{f:016x}", str(least.get(find(f)))) for (d, _), f in zip(rows, fp))


def got(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, root string, n int").repartition(3)
    from pyspark.sql import functions as F

    out = simhash.near_duplicates(df, ["doc_id"]).select("doc_id", F.lpad(F.lower(F.hex("_tm_fp")), 16, "0"), "_tm_component")
    return sorted((str(a), b, str(c)) for a, b, c in out.collect())


@pytest.mark.parametrize("alike", [simhash.ALIKE, 2])
def test_against_brute_force(spark, monkeypatch, alike):
    monkeypatch.setattr(simhash, "ALIKE", alike)
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(60):
        base = [words[k] for k in rng.integers(0, 400, int(rng.integers(1, 200)))]
        rows.append((i * 10, " ".join(base)))
        for j in range(int(rng.integers(0, 5))):
            copy = list(base)
            copy[int(rng.integers(0, len(copy)))] = "Ünd"
            rows.append((i * 10 + j + 1, " \n".join(copy).upper() if j == 2 else " ".join(copy)))
    rows += [(9001, None), (9002, ""), (9003, " \n"), (None, rows[0][1]), (5, rows[0][1]), (5, rows[0][1]), (None, "alone among the rows")]
    rows.append((9004, "long " * 70000 + "end"))
    assert got(spark, [(*r, "x", 1) for r in rows]) == plain_components(rows)


@pytest.mark.parametrize(("block", "piece", "six", "seven", "tables"), [(8, 1, 1 << 24, 0, 15), (1024, 128, 0, 1 << 24, 35), (1024, 128, 0, 0, 70)])
def test_links_of_planted_fingerprints(spark, monkeypatch, block, piece, six, seven, tables):
    monkeypatch.setattr(simhash, "SIX", six)
    monkeypatch.setattr(simhash, "SEVEN", seven)
    assert len(simhash.masks(1000)) == tables
    monkeypatch.setattr(simhash, "BLOCK", block)
    monkeypatch.setattr(simhash, "PIECE", piece)
    rng = np.random.default_rng(5)
    fps = [int(x) for x in rng.integers(0, 2**63, 300)]
    for f in fps[:40]:
        g = f
        for _ in range(12):  # chains whose ends are far apart
            for b in rng.integers(0, 64, 4):
                g ^= 1 << int(b)
            fps.append(g)
    fps = sorted(set(fps))
    df = spark.createDataFrame([(simhash._as_long(f),) for f in fps], "_tm_fp long")
    roots = dict(simhash.components(simhash.links(df)).collect())
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 4:
                root[find(a)] = find(b)
    groups, want = {}, {}
    for f in fps:
        groups.setdefault(roots.get(simhash._as_long(f), simhash._as_long(f)), set()).add(f)
        want.setdefault(find(f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_one_document_of_each_group_stays(spark):
    same = "the same words stand here in each of these rows again"
    rows = [(2, same, "a", 1), (1, same, "b", 2), (1, same, "b", 2), (None, same, None, None), (3, "other words that nobody repeats at all today", "c", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, root string, n int")
    out = simhash.deduplicated(df)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == [(1, same, "b", 2), rows[-1]]


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.deduplicated(df).count() == 0
