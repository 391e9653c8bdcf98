from collections import Counter

import duckdb
import numpy as np

from tests.oracle import compare, connection
from tidemark.llm import quality_rules, queries


def rows():
    rng = np.random.default_rng(1)
    vocab = [f"word{i}" for i in range(300)]
    prose = lambda n: " ".join(vocab[i] for i in rng.integers(0, 300, n)) + "."
    out = [(i, "\n".join(prose(int(rng.integers(1, 30))) for _ in range(int(rng.integers(1, 9))))) for i in range(60)]
    out += [(100, None), (101, ""), (102, " \n\t"), (103, "few words"), (104, (prose(12) + "\n") * 6), (105, "a b c d e " * 4), (106, "a | b | c | d\ne | f | g | h\ni | j | k | l"), (107, "LOUD!! WORDS!! ALL!! OVER!! THE!! PAGE!! AND!! MORE!! OF!! THEM!!")]
    out += [(108, prose(40) + "\nHome | News | About\nAll rights reserved. Privacy policy."), (109, "x### y$$$ z*** " * 10), (110, "été über\x0bçà\x1cfoo… " * 2 + prose(80)), (None, prose(20)), (5, out[5][1]), (5, out[5][1])]
    out.append((111, " ".join(f"u{i}" for i in range(5000)) + " " + "again and again this run " * 3))
    return [(*r, True) for r in out]


def test_against_sql(spark, tmp_path):
    spark.createDataFrame(rows(), "doc_id long, text string, kept boolean").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = quality_rules.op5(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = [tuple(r) for r in got.collect()]
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = duckdb.sql(quality_rules.OP5_SQL).fetchall()
    assert Counter(got) == Counter(want)
    kept = {r[0]: r[-1] for r in got}
    assert not any(kept[i] for i in (100, 101, 102, 103, 104, 105, 106, 107, 109))
    assert kept[108] and kept[110] and kept[111] and all(kept[r[0]] for r in got if r[0] is not None and r[0] < 60 and r[1] >= 40)


def test_failing_lines_go(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, kept boolean")
    out = quality_rules.cleaned(df)
    assert out.columns == df.columns
    text = {r.doc_id: r.text for r in out.collect()}
    assert "Home" not in text[108] and "reserved" not in text[108] and len(text[108].split()) == 40
    assert quality_rules.cleaned(df.limit(0)).count() == 0


def test_cleaned_documents_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    compare(queries.queries()["cleaned_documents"](spark, sf), connection(sf), quality_rules.CLEANED_SQL)
