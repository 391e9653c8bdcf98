"""Line-first cleaning, in SQL functions only.

Each line is held against punctuation, navigation and boilerplate rules; failing lines are removed, and a document that loses
more than LOSS of its characters that way is rejected. Counts of words, symbols, equal lines and repeated 5-word windows
come from the same words; windows are compared by 64-bit hashes, and only documents in which hashes repeat sort them.

Defined results: a null text has no words and fails; ties and repeated rows keep one row each; all of a text is read.
"""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table

WINDOW = 5
#: A document may lose this share of its characters (those of words).
LOSS = 0.5
SYMBOLS = "#*$%&|<>"
#: Share of a line's characters that symbols may be, in percent.
MOST_SYMBOLS = 8
#: Phrases of notices and menus, in lines of fewer than PHRASE_WORDS words.
PHRASES = "(?i)all rights reserved|terms of (use|service)|privacy policy|cookie|javascript|click here|sign (up|in)|log in|subscribe|newsletter|share (this|on)|read more|skip to (main )?content"
PHRASE_WORDS = 30
ENDS = r"[.!?:;,)\]\x22'…»。]\z"
#: Every phrase holds one of these, in lower case.
HINTS = ("rights reserved", "terms of ", "privacy policy", "cookie", "javascript", "click here", "sign ", "log in", "subscribe", "newsletter", "share ", "read more", "skip to ")
BARS = "|»›·•"
SPACE = "[ \\t-\\r]+"


def _count(text: Column, chars: str) -> Column:
    """How many characters of text are in the class."""
    return F.size(F.split(text, f"[{chars}]")) - 1


def _inked(text: Column) -> Column:
    """Code points in words."""
    return F.length(F.array_join(F.split(text, SPACE), ""))


def words(text: Column) -> Column:
    """The words of a text that begins and ends with none but words' characters; none if it is empty."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, SPACE))


LOOKS = ("_tm_symbolic", "_tm_barred", "_tm_loud", "_tm_upper", "_tm_short", "_tm_hinted")


def looks(whole: Column) -> dict[str, Column]:
    """One look at the whole text for each rule that most texts cannot break: false if no line can."""
    low = F.lower(whole)
    hint = reduce(or_, [low.contains(h) for h in HINTS])
    return {
        "_tm_symbolic": whole.rlike(f"[{SYMBOLS}]"),
        "_tm_barred": reduce(or_, [whole.contains(c) for c in BARS]),
        "_tm_loud": whole.contains("!"),
        # A line with over twice as many capitals as small letters has two capitals without a small letter between, or no small letter.
        "_tm_upper": whole.rlike(r"[A-Z][^a-z\n]*[A-Z]") | whole.rlike(r"(?md)^[^a-zA-Z\n]*+[A-Z][^a-z\n]*+$"),
        "_tm_short": whole.rlike(r"(?md)^[ \t\x0b-\r]*[^ \t-\r]++(?:[ \t\x0b-\r]++[^ \t-\r]++){0,2}[ \t\x0b-\r]*$"),
        "_tm_hinted": hint & whole.rlike(PHRASES),
    }


def line_fails(line: Column) -> Column:
    """Whether a line (with a word) breaks a rule; beside the columns of looks, which spare it the rules that no line of its text breaks."""
    symbolic, barred, loud_text, upper, short_line, hinted = map(F.col, LOOKS)

    def judge(bare):
        n = F.size(F.split(bare, SPACE))
        symbols = symbolic & bare.rlike(f"[{SYMBOLS}]") & (_count(bare, SYMBOLS) * 100 > _inked(bare) * MOST_SYMBOLS)
        short = short_line & ~bare.rlike(ENDS) & (n < 4)
        loud = loud_text & (n >= 4) & (_count(bare, "!") > n)
        capitals = upper & (bare.rlike("[A-Z][^a-z]*[A-Z]") | ~bare.rlike("[a-z]")) & (n >= 5) & (_count(bare, "A-Z") > _count(bare, "a-z") * 2)
        navigation = barred & (_count(bare, BARS) >= 2) & (_count(bare, BARS) * 4 >= n)
        return symbols | short | loud | capitals | navigation | (hinted & bare.rlike(PHRASES) & (n < PHRASE_WORDS))

    return judge(F.btrim(line, F.lit(" \t\n\x0b\f\r")))


def covered(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""

    def of_sorted(s):
        twice = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]).eqNullSafe(True) | (F.get(s, k + 1)["h"] == x["h"]).eqNullSafe(True))
        starts = F.array_sort(F.transform(twice, lambda x: x["i"]))
        steps = lambda p: F.aggregate(F.transform(p, lambda x, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - x, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
        return F.transform(F.array(starts), steps)[0]

    placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return F.transform(F.array(placed), of_sorted)[0]


def judged(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _tm_words (their number), _tm_chars, _tm_symbols, _tm_dup_lines, _tm_repeat, _tm_lines and _tm_bad (those that fail), _tm_base_failed and _tm_kept."""
    columns = docs.columns
    whole = F.coalesce(F.col(text), F.lit(""))
    blank = F.split(whole, "\n")
    # Only where a line is blank must lines be looked through.
    lines = F.when(whole.rlike(r"(?:\A|\n)[ \t\x0b-\r]*(?:\n|\z)"), F.filter(blank, lambda x: x.rlike("[^ \\t-\\r]"))).otherwise(blank)
    docs = docs.withColumns({"_tm_w": words(F.btrim(whole, F.lit(" \t\n\x0b\f\r"))), "_tm_lines": lines, **looks(whole)})
    docs = docs.withColumn("_tm_wh", F.transform("_tm_w", lambda x: F.xxhash64(x)))
    w = F.col("_tm_wh")
    hashes = F.when(F.size(w) >= WINDOW, F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    suspect = reduce(or_, map(F.col, LOOKS))
    bad = F.when(suspect, F.filter("_tm_lines", line_fails)).otherwise(F.array().cast("array<string>"))
    docs = docs.withColumns({"_tm_h": hashes, "_tm_bad": bad})
    repeats = F.when(F.size(F.array_distinct("_tm_h")) < F.size("_tm_h"), covered(F.col("_tm_h"))).otherwise(0)
    docs = docs.select(
        *columns,
        "_tm_lines",
        "_tm_bad",
        *LOOKS,
        F.size("_tm_w").cast("long").alias("_tm_words"),
        F.length(F.array_join("_tm_w", "")).cast("long").alias("_tm_chars"),
        F.when(F.col("_tm_symbolic"), _count(whole, SYMBOLS)).otherwise(0).cast("long").alias("_tm_symbols"),
        (F.size("_tm_lines") - F.size(F.array_distinct("_tm_lines"))).cast("long").alias("_tm_dup_lines"),
        repeats.cast("long").alias("_tm_repeat"),
        F.when(F.size("_tm_bad") > 0, _inked(F.array_join("_tm_bad", " "))).otherwise(0).cast("long").alias("_tm_lost"),
    )
    failed = (F.col("_tm_words") < 10) | (100 * F.col("_tm_repeat") > 20 * F.col("_tm_words"))
    return docs.withColumns({"_tm_base_failed": failed, "_tm_kept": ~failed & (F.col("_tm_lost") <= LOSS * F.col("_tm_chars"))})


def cleaned(docs: DataFrame, text: str = "text") -> DataFrame:
    """The kept documents, without their failing lines."""
    # The row number keeps the condition above the expressions that it is made of, which would be worked out again in it, word by word.
    found = judged(docs, text).withColumn("_tm_row", F.monotonically_increasing_id()).where("_tm_kept and _tm_row >= 0")
    bad = F.size("_tm_bad") > 0
    return found.withColumn(text, F.array_join(F.filter("_tm_lines", lambda x: ~(bad & line_fails(x))), "\n")).select(*docs.columns)


def op5(spark, sf_dir) -> DataFrame:
    found = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.col("_tm_words").alias("n_words"), F.col("_tm_chars").alias("word_chars"), F.col("_tm_symbols").alias("n_symbols"), F.col("_tm_dup_lines").alias("n_dup_lines"), F.col("_tm_repeat").alias("n_repeat_words"), F.col("_tm_base_failed").alias("base_failed"), F.col("_tm_kept").alias("kept"))


OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT r, i, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
rep AS (SELECT r, count(DISTINCT i + k) AS n FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) x, range(0, 5) g(k) WHERE c > 1 GROUP BY r),
line AS (SELECT r, trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b FROM (SELECT r, unnest(lines) AS l FROM w)),
m AS (SELECT r, b, len(regexp_extract_all(b, '[^\x20\x09-\x0D]+')) AS n, length(regexp_replace(b, '[\x20\x09-\x0D]', '', 'g')) AS size,
             len(regexp_extract_all(b, '[#*$%&|<>]')) AS symbols, len(regexp_extract_all(b, '[|»›·•]')) AS bars,
             len(regexp_extract_all(b, '[A-Z]')) AS up, len(regexp_extract_all(b, '[a-z]')) AS low, len(regexp_extract_all(b, '!')) AS shouts FROM line),
lost AS (SELECT r, sum(size) AS n FROM m
  WHERE symbols * 100 > size * 8 OR (n < 4 AND NOT regexp_matches(b, '[.!?:;,)\]\x22''…»。]$')) OR (n >= 4 AND shouts > n) OR (n >= 5 AND up > low * 2)
     OR (bars >= 2 AND bars * 4 >= n) OR (n < 30 AND regexp_matches(b, '@PHRASES@'))
  GROUP BY r),
f AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
             len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0) AS lost
      FROM w LEFT JOIN rep USING (r) LEFT JOIN lost USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
       NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * lost <= word_chars AS kept
FROM f
""".replace("@PHRASES@", PHRASES)

_FAILS = OP5_SQL[OP5_SQL.index("WHERE symbols") + 6 : OP5_SQL.index("  GROUP BY r),\nf AS")]
#: The same rules, with the lines that pass in their order.
CLEANED_SQL = (
    OP5_SQL[: OP5_SQL.rindex("SELECT doc_id, n_words")]
    .replace("SELECT r, unnest(lines) AS l FROM w", "SELECT r, unnest(lines) AS l, generate_subscripts(lines, 1) AS i FROM w")
    .replace("line AS (SELECT r, trim(", "line AS (SELECT r, i, l, trim(")
    .replace("m AS (SELECT r, b,", "m AS (SELECT r, i, l, b,")
    .replace("f AS (SELECT doc_id,", "f AS (SELECT w.r AS r, doc_id,")
    .rstrip()
    + f""",
good AS (SELECT r, string_agg(l, chr(10) ORDER BY i) AS text FROM m WHERE NOT ({_FAILS}) GROUP BY r)
SELECT doc_id, coalesce(text, '') AS text FROM f LEFT JOIN good USING (r) WHERE NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND 2 * lost <= word_chars
"""
)
