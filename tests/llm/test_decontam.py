import hashlib
import re

import numpy as np
import pytest

from tidemark.llm import decontam


def plain(docs: list[tuple], items: list[tuple]) -> list[tuple]:
    """The same by brute force, for tests."""
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))

    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, it in items:
            x = words(it)
            n = min(10, len(x))
            runs = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in runs:
                    hit.update(range(k, k + n))
                    ids.add("" if i is None else str(i))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(ids)))
    return out


def fixture():
    rng = np.random.default_rng(2)
    vocab = [f"w{i}" for i in range(60)] + ["ünïcode", "averyveryverylongwordindeed1", "averyveryverylongwordindeed2", "averyveryXverylongwordindeed1"]
    pick = lambda n: [vocab[i] for i in rng.integers(0, len(vocab), n)]
    items = [(i, " ".join(pick(int(rng.integers(1, 40))))) for i in range(3, 40)] + [(None, " ".join(pick(15))), (50, None), (51, ""), (52, "one"), (53, "two words"), (3, " ".join(pick(12)))]
    docs = []
    for i in range(150):
        w = pick(int(rng.integers(0, 120)))
        for _ in range(int(rng.integers(0, 3))):
            x = (items[int(rng.integers(0, 40))][1] or "").split()
            a, n = int(rng.integers(0, max(1, len(x)))), int(rng.integers(5, 30))
            k = int(rng.integers(0, len(w) + 1))
            w[k:k] = x[a : a + n]
        docs.append((i, rng.choice([" ", ", ", "\n"]).join(w).upper() if i % 3 else " ".join(w)))
    docs += [(None, docs[1][1]), (200, None), (201, ""), (202, "...."), (1, docs[1][1]), (1, docs[1][1]), (203, "one"), (204, "Two  WORDS!"), (205, "filler " * 50000 + (items[0][1] or ""))]
    return docs, items


@pytest.mark.parametrize("block", [8 << 20, 600])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(decontam, "BLOCK_BYTES", block)
    monkeypatch.setattr(decontam, "CHUNK", 3000)
    docs, items = fixture()
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, n_words int").repartition(3)
    i = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontam.digest(decontam.marked(d, i, ["doc_id"])).collect()]
    assert sorted(got, key=str) == sorted(plain(docs, items), key=str)
    left = decontam.decontaminated(d, i)
    assert left.columns == d.columns
    assert left.count() == sum(not r[-1] for r in plain(docs, items))


def test_empty_tables(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs[:5], "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    none = [tuple(r) for r in decontam.digest(decontam.marked(d, i.limit(0), ["doc_id"])).collect()]
    assert sorted(none, key=str) == sorted(plain(docs[:5], []), key=str)
    assert decontam.decontaminated(d.limit(0), i).count() == 0


def test_repeated_words_take_linear_work():
    """Every window of item and document alike, and windows that share their rarest shingle."""
    import resource
    import time

    same = b"a " * 20_000
    shared = b" ".join(b"x y z " + b" ".join(b"w%d" % (k * 7 + i) for i in range(7)) for k in range(3000))
    for item, doc, hit in ((same, same, 20_000), (shared, (b"x y z " * 7000) + shared, None)):
        began, held = time.process_time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
        index = decontam.Index([("i", item), ("j", item)])
        words = decontam.Words([doc])
        index.order(index.count(words))
        start, window = index.hits(words)
        assert time.process_time() - began < 1
        assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - held < 200_000
        spans = decontam._merged([], start, start + index.length[window])
        assert index.items_of(window) == ["i", "j"]
        assert hit is None or spans == [0, hit]
        if hit is None:
            n = len(doc.split())
            assert spans[-1] == n and spans[0] >= n - len(item.split()) - 10


def test_items_that_tie_and_repeat(spark):
    items = [(1, "a b " * 30), (2, "b a " * 30), (1, "a b " * 30), (3, "a b " * 30), (4, "a " * 9 + "b")]
    docs = [(1, "a b " * 400), (2, "a " * 300 + "b"), (3, "b " * 50)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontam.digest(decontam.marked(d, i, ["doc_id"])).collect()]
    assert sorted(got) == sorted(plain(docs, items))
