from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import line_dedup


def rows():
    out = []
    for i in range(90):
        url = f"https://user@Host{i % 4}.example.com:80/p/{i}?q#x" if i % 10 else f"http://lone{i}.org"
        body = f"<nav>Home | News</nav><script>var a='<p>';\nb()</script><p>Own  line {i}</p><p>O<b>wn</b>  line <a href='/x'>{i}</a></p><br/><!-- c -->" + ("<p>rare</p>" if i % 9 == 0 else "") + "<style>p{}</style><footer>Imprint\n </footer>"
        out.append((i, url, body))
    out += [(None, None, None), (100, "no host", "<p>a</p>"), (100, "no host", "<p>a</p>"), (101, "x://", ""), (102, None, "<p>a</p>"), (104, "https://u.org", "<p>a<b <i>b</p>x < y<p>c</p><script>var <p>d</p>"), (105, "https://u.org", "<p>a</p><!-- b <p>c</p>"), (106, "https://u.org", "<style <p>x</p>"), (103, "https://host0.example.com", "Home | News\n" * 20000)]
    return [(*r, "n") for r in out]


@pytest.mark.parametrize("most", [500_000, 0])
def test_against_sql(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", most)
    spark.createDataFrame(rows(), "page_id long, url string, html string, host string").repartition(3).write.parquet(f"{tmp_path}/pages.parquet")
    got = Counter(tuple(r) for r in line_dedup.op3(spark, str(tmp_path)).collect())
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert got == Counter(duckdb.sql(line_dedup.OP3_SQL).fetchall())
    text = {r[0]: r[4] for r in got}
    assert text[1] == "Own  line 1\nOwn  line 1" and text[103] == "" and text[101] == ""
    assert "Home" in text[10] and text[100] == ""


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert line_dedup.marked(df).count() == 0


@pytest.mark.parametrize("part", ["<", "<a ", "<script ", "<!-- ", "<style>", "</script ", "<a x='", "<b", "< ", "<script></script "])
def test_hard_pages_take_time_of_their_length(spark, part):
    import time

    html = part * (1_000_000 // len(part))
    df = spark.createDataFrame([(1, "https://a.org", html)], "page_id long, url string, html string").select("page_id", line_dedup.lines(F.col("html")).alias("l"))
    df.where("page_id = 0").collect()
    began = time.time()
    df.collect()
    assert time.time() - began < 2
