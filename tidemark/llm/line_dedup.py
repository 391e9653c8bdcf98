"""Line dedup by site-relative frequency.

Lines are the texts between a page's tags, those of inline elements (links, emphasis, spans) left out of account. A line's frequency is the number of its host's pages that contain it, divided by
the host's pages; lines over RATIO, on at least PAGES pages, are boilerplate and go. A host's boilerplate lines are at
most (mean lines of a page) / RATIO, so they travel as one array a host, broadcast if their counted number is small, else
joined with pages salted over SALTS parts, so that no host is handled by one task.

Defined results: null html has no lines; a script, style or comment that is not closed hides the rest of its page, and a tag that is not closed before the next one is text; a url without a host belongs to the host ''; repeated rows count as pages and keep one
row each; blank lines are no lines; an empty table gives no rows.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_broadcast, materialize, table

RATIO, PAGES = 0.2, 3
#: Lines that are broadcast at most, and parts of a host beyond that.
BROADCAST_LINES, SALTS = 500_000, 32

#: Raw text and comments, which go with their tags; without an end they hide the rest of the page.
HIDDEN = r"(?is)<script\b.*?(?:</script\s*>|\z)|<style\b.*?(?:</style\s*>|\z)|<!--.*?(?:-->|\z)"
#: A tag ends before the next `<`: what is not closed until then is text. So every page is read in time of its length.
TAG = "<[^<>]*>"

#: Tags that do not end a line.
INLINE = r"(?i)</?(?:a|abbr|b|bdi|bdo|big|cite|code|del|dfn|em|font|i|ins|kbd|label|mark|q|s|samp|small|span|strike|strong|sub|sup|time|tt|u|var)(?:\s[^<>]*)?>"


def lines(html: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n"), INLINE, "")
    bare = F.regexp_replace(bare, TAG, "\n")
    return F.filter(F.transform(F.split(bare, "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\f\r"))), lambda x: x != "")


def host(url: Column) -> Column:
    """The lower-case host of a url, without port and user; '' if there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def boilerplate(pages: DataFrame) -> DataFrame:
    """From _tm_host and _tm_lines: the hosts that have boilerplate lines, with their hashes."""
    sizes = pages.groupBy("_tm_host").agg(F.count("*").alias("pages"))
    each = pages.select("_tm_host", F.explode(F.array_distinct(F.transform("_tm_lines", lambda x: F.xxhash64(x)))).alias("line"))
    counts = each.groupBy("_tm_host", "line").agg(F.count("*").alias("n")).where(F.col("n") >= PAGES)
    # One row a host: a shuffled join of very many hosts can split the lines of a large one.
    sizes = materialize(sizes, "hosts")
    over = counts.join(bounded_broadcast(sizes, sizes.count()), "_tm_host").where(F.col("n") > RATIO * F.col("pages"))
    return over.groupBy("_tm_host").agg(F.collect_list("line").alias("_tm_drop"))


def marked(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """pages with _tm_host, _tm_lines and _tm_drop, the hashes of the host's boilerplate lines."""
    rows = pages.withColumns({"_tm_host": host(F.col(url)), "_tm_lines": lines(F.col(html))})
    drop = materialize(boilerplate(rows.select("_tm_host", "_tm_lines")), "boilerplate")
    n = drop.agg(F.coalesce(F.sum(F.size("_tm_drop")), F.lit(0))).first()[0]
    if n <= BROADCAST_LINES:
        found = rows.join(F.broadcast(drop), "_tm_host", "left")
    else:
        parts = drop.withColumn("_tm_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("_tm_salt", F.pmod(F.xxhash64(url, html), F.lit(SALTS)).cast("int"))
        found = salted.join(parts, ["_tm_host", "_tm_salt"], "left").drop("_tm_salt")
    return found.withColumn("_tm_drop", F.coalesce("_tm_drop", F.array().cast("array<bigint>")))


def kept_lines() -> Column:
    return F.filter("_tm_lines", lambda x: ~F.array_contains("_tm_drop", F.xxhash64(x)))


def op3(spark, sf_dir) -> DataFrame:
    found = marked(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("_tm_kept", kept_lines())
    return found.select("page_id", F.col("_tm_host").alias("host"), F.size("_tm_lines").cast("long").alias("n_lines"), (F.size("_tm_lines") - F.size("_tm_kept")).cast("long").alias("n_dropped"), F.array_join("_tm_kept", "\n").alias("text"))


OP3_SQL = r"""
WITH p AS (
  SELECT row_number() OVER () AS r, page_id, lower(coalesce(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '')) AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '@HIDDEN@', chr(10), 'g'), '@INLINE@', '', 'g'), '<[^<>]*>', chr(10), 'g'), chr(10)),
      lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))), lambda x: x <> '') AS lines
  FROM pages),
h AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
d AS (SELECT host, list(line) AS drops FROM c JOIN h USING (host) WHERE n >= 3 AND n > 0.2::DOUBLE * pages GROUP BY host),
k AS (SELECT page_id, host, lines, list_filter(lines, lambda x: NOT list_contains(coalesce(drops, []), x)) AS kept FROM p LEFT JOIN d USING (host))
SELECT page_id, host, len(lines)::BIGINT AS n_lines, (len(lines) - len(kept))::BIGINT AS n_dropped, array_to_string(kept, chr(10)) AS text FROM k
""".replace("@INLINE@", INLINE).replace("@HIDDEN@", HIDDEN)
