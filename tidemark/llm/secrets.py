"""Secret scans on whole texts, in SQL functions only.

Base kinds are patterns; the method adds candidate strings of one character class in which the Shannon entropy of some
window of WINDOW characters reaches the class's limit. Entropy slides: a string holds the window's counts, one letter for each character of
the class, and one character in and one out change the sum of c log2 c by two terms each. Candidates of too few different characters are
not folded, and a fold stands still once it has reached the limit. An allow-list cuts sample values and plain words out of a candidate before its windows
are looked at; it never takes away a base span. Parts of addresses, paths and identifiers are allowed too: pieces between other characters that are words, also joined with capitals, with
a number of up to four digits behind, or numbers of up to eight. A candidate without a digit must have both cases and LETTERS bits; what is a word in this sense, such as a key of letters of one case, is not found.

Defined results: a null text is empty; repeated rows keep one row each; every length is scanned whole; spans that begin together stand in the order of their kinds.
Addresses and paths are no secrets by themselves; a key in one is found like any other.
"""

from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import table

ASSIGN = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Fixed patterns of the base kinds, in the order in which kinds are listed, with the least length of what counts.
BASE = {"assign": (ASSIGN, 6), "access": ("AKIA[A-Z0-9]+", 20), "hex": ("[0-9a-f]+", 24)}
WINDOW = 20
#: Character classes: pattern, least entropy of a window in bits (log2(20) = 4.32 at most).
CLASSES = {"ehex": (r"[0-9A-Fa-f]{20,}+", 2.95), "ealnum": (r"[0-9A-Za-z]{20,}+", 3.55), "ebase64": (r"[0-9A-Za-z+/_=-]{20,}+", 3.65)}
#: Least entropy of a window without digits.
LETTERS = 3.9
#: Matches that are placed in one piece.
PIECE = 256
#: Values that documents use in place of secrets.
ALLOWED = "(?i)example|sample|placeholder|changeme|dummy|redacted|0123456789|1234567890|abcdefgh|x{6}|0{12}"
#: A piece that is words or a number; bounded, so that it takes no stack on long runs.
WORDS = r"(?<![A-Za-z0-9])(?:(?:[A-Z]?+[a-z]{2,}+|[A-Z]{1,5}(?![a-z])){1,40}+[0-9]{0,4}+|[0-9]{1,8}+)(?![A-Za-z0-9])"
SPAN = "struct<start:int,end:int,kind:string,m:string>"


def matches(text: Column, pattern: str) -> Column:
    """Gaps and matches in turn: all leftmost matches that do not overlap, each with what stands before it.

    The end of the text matches too, empty, so that the search never starts anew within the rest."""
    gapped = F.lit(rf"(?s)(.*?)({pattern}|\z)")
    return F.arrays_zip(F.regexp_extract_all(text, gapped, F.lit(1)).alias("gap"), F.regexp_extract_all(text, gapped, F.lit(2)).alias("m"))


def places(found: Column, kind: str, counts) -> Column:
    """Spans in code points, end exclusive, of the matches that count: every gap and match moves the running place, only those that count are kept."""
    none = F.array().cast(f"array<{SPAN}>")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["m"].alias("m"))
        return F.struct(end.alias("at"), F.when(counts(x["m"]), F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def pieced(found):
        def piece(acc, k):
            # Spans are gathered by pieces: adding to one array would copy all of it each time.
            got = F.aggregate(F.slice(found, k * PIECE + 1, PIECE), F.struct(acc["at"].alias("at"), none.alias("out")), step)
            return F.transform(F.array(got), lambda g: F.struct(g["at"].alias("at"), F.concat(acc["outs"], F.array(g["out"])).alias("outs")))[0]

        nothing = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<array<{SPAN}>>").alias("outs"))
        return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(found) / PIECE).cast("int")), nothing, piece, lambda acc: F.flatten(acc["outs"]))

    return F.transform(F.array(found), pieced)[0]  # a one-element array binds the matches once for all pieces


def base_spans(text: Column, kind: str) -> Column:
    pattern, least = BASE[kind]
    if kind == "assign":  # a match that fails still takes up its text
        return places(matches(text, pattern), kind, lambda m: F.length(F.regexp_extract(m, f"^{pattern}$", 2)) >= least)
    # Runs are matched whole, so those that are too short need no match.
    longer = {"access": "AKIA[A-Z0-9]{%d,}+" % (least - 4), "hex": "[0-9a-f]{%d,}+" % least}[kind]
    return places(matches(text, longer), kind, lambda m: F.length(m) >= least)


#: c log2 c of the counts in a window.
TERMS = [0.0] + [c * log2(c) for c in range(1, WINDOW + 1)]
#: Codes of the class characters ('+' to 'z'), with the code of what stands for a cut first.
FIRST, LAST = ord("*"), ord("z")


def reaches(text: Column, least: Column) -> Column:
    """Whether any WINDOW consecutive characters of text, none of them '*', have an entropy of `least` bits. One pass with incremental counts."""
    terms = F.lit(TERMS)

    def step(acc, x):
        # x: a character's place among the codes, and 1 if it comes in or -1 if it goes out
        c = F.ascii(F.substring(acc["counts"], x["at"], 1)) - 65
        s = acc["s"] + F.get(terms, c + x["by"]) - F.get(terms, c)
        run = F.when(x["by"] < 0, acc["run"]).when(x["at"] == 1, 0).otherwise(acc["run"] + 1)
        done = (x["by"] > 0) & (run >= WINDOW) & (F.lit(log2(WINDOW)) - s / WINDOW >= acc["least"] - 1e-9)
        moved = F.struct(F.overlay(acc["counts"], F.char(c + x["by"] + 65), x["at"], 1).alias("counts"), s.alias("s"), run.alias("run"), done.alias("done"), acc["least"].alias("least"))
        return F.when(acc["done"], acc).otherwise(moved)

    def folded(places):
        def events(p, i):
            entering = F.struct(p.alias("at"), F.lit(1).alias("by"))
            return F.when(i < WINDOW, F.array(entering)).otherwise(F.array(F.struct(F.get(places, i - WINDOW).alias("at"), F.lit(-1).alias("by")), entering))

        zero = F.struct(F.repeat(F.lit("A"), LAST - FIRST + 1).alias("counts"), F.lit(0.0).alias("s"), F.lit(0).alias("run"), F.lit(False).alias("done"), least.alias("least"))
        return F.aggregate(F.flatten(F.transform(places, events)), zero, step, lambda acc: acc["done"])

    # One-element arrays bind the characters once for all steps.
    places = F.transform(F.array(F.split(text, "")), lambda chars: F.transform(chars, lambda ch: F.ascii(ch) - FIRST + 1))
    return F.transform(places, lambda p: F.when(F.size(F.array_distinct(p)) >= F.pow(F.lit(2.0), least) - 1e-6, folded(p)).otherwise(F.lit(False)))[0]


def entropy_spans(text: Column, kind: str) -> Column:
    pattern, least = CLASSES[kind]

    def judge(m):
        need = F.when(m.rlike("[0-9]") & m.rlike("[A-Za-z]"), F.lit(least)).when(m.rlike("[a-z]") & m.rlike("[A-Z]"), F.lit(max(least, LETTERS)))
        return F.transform(F.array(need), lambda n: F.when(n.isNotNull(), reaches(m, n)).otherwise(F.lit(False)))[0]

    def suspicious(s):
        return F.transform(F.array(F.regexp_replace(F.regexp_replace(s["m"], ALLOWED, "*"), WORDS, "*")), judge)[0]

    return F.filter(places(matches(text, pattern), kind, lambda m: m != ""), suspicious)


def scanned(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with _tm_base and _tm_added, arrays of spans (start, end, kind, m): by start, then by kind as listed."""
    kinds = [*BASE, *CLASSES]
    whole = F.coalesce(F.col(text), F.lit(""))
    # Most texts have no candidate at all; the quick look spares them the scan for places.
    def seen(pattern, spans):
        return F.when(whole.rlike(pattern), spans).otherwise(F.array().cast(f"array<{SPAN}>"))

    looks = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}", **{k: p for k, (p, _) in CLASSES.items()}}
    for kind in BASE:
        docs = docs.withColumn(f"_tm_{kind}", seen(looks[kind], base_spans(whole, kind)))
    for kind in CLASSES:
        docs = docs.withColumn(f"_tm_{kind}", seen(looks[kind], entropy_spans(whole, kind)))
    rank = F.array(*[F.lit(k) for k in kinds])

    def ordered(parts):
        keyed = F.transform(F.concat(*[F.col(f"_tm_{k}") for k in parts]), lambda s: F.struct(s["start"].alias("start"), F.array_position(rank, s["kind"]).alias("rank"), s.alias("s")))
        return F.transform(F.array_sort(keyed), lambda x: x["s"])

    docs = docs.withColumns({"_tm_base": ordered(BASE), "_tm_added": ordered(CLASSES), "_tm_all": ordered(kinds)})
    return docs.drop(*[f"_tm_{k}" for k in kinds])


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with every span of the text replaced by its kind in brackets."""
    found = scanned(docs, text)
    # Overlapping spans are merged by the running end.
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(F.col(text), acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"]))
        mark = F.when(s["start"] >= acc["at"], F.concat(gap, F.lit("["), s["kind"], F.lit("]"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], mark).alias("out"))

    clean = F.aggregate("_tm_all", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col(text), acc["at"] + 1, F.length(text))))
    return found.withColumn(text, F.when(F.size("_tm_all") > 0, clean).otherwise(F.col(text))).select(*docs.columns)


def op2(spark, sf_dir) -> DataFrame:
    found = scanned(table(spark, sf_dir, "documents").select("doc_id", "text"))

    def count(kind):
        return F.size(F.filter("_tm_base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(listed("_tm_base").cast("binary"), 256).alias("base_sha256"), listed("_tm_all").alias("spans"))
