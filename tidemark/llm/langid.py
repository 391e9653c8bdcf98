"""Language ID as inference of a mixture: a document's language proportions by EM, its language set by penalised likelihood.

The model is the share of each hashed byte trigram in each language, counted over all training documents. For a document,
EM finds proportions over all languages; sets of the likeliest one, two, ... languages are then fitted anew, and the set
with the best log likelihood less PENALTY * log(trigrams) for each language is chosen. Documents are handled
in chunks as one sparse table of (document, trigram, count).

Defined results: null and empty texts, and texts without a letter, are `und` with score 0; so is every text where nothing
can be learned; a single letter is a word of its own and is predicted; repeated rows keep one row each; a null doc_id counts as ''; of equally likely languages the first by
name is taken. Every language of a training row is learned: the model has one entry for each trigram that a language was seen with, at most GRAMS of them, and workers make the
rows they need of it, CELLS numbers at a time, whatever the number of languages.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import bounded_broadcast, crc_mod, materialize, table

FOLDS, HELD_OUT = 4, 2
#: Hashed trigrams; the model has so many rows for each language.
GRAMS = 1 << 15
SMOOTHING, PENALTY, STEPS = 0.5, 3.0, 8
#: Overlapping trigrams are not independent: evidence counts by this share in the posterior.
EVIDENCE = 1 / 3
#: A second language below this proportion of the first fit is not tried.
LEAST_SHARE = 0.03
CHUNK = 512 << 10
#: Numbers (trigrams of a chunk by languages) that are looked at in one piece.
CELLS = 4 << 20
#: A text is accepted if its language, or languages, have at least this part of the evidence, and if its trigrams are at most so much less likely (in nats a
#: trigram) than those that its languages were learned from; short texts vary more, by SPREAD over the root of their trigrams.
LEAST_EVIDENCE, LEAST_FIT, SPREAD = 0.35, -3.0, 8.0

_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91], _FOLD[97:123] = np.arange(97, 123), np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hashed trigrams of letters and single spaces of some texts, and each one's text: those of two letters or more, and words of one letter."""
    sizes = np.array([len(t) + 3 for t in texts])
    raw = _FOLD[np.frombuffer(b" " + b"   ".join([*texts, b""]) + b"   ", np.uint8)].astype(np.uint32)
    a, b, c = raw[:-2], raw[1:-1], raw[2:]
    keep = (((a != 32).astype(np.uint8) + (b != 32) + (c != 32)) >= 2) | ((a == 32) & (b != 32) & (c == 32))
    h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA6B)) ^ (c * np.uint32(0xC2B2AE35))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    text = np.repeat(np.arange(len(texts)), sizes)[: len(h)]
    text = np.concatenate([text, np.full(len(h) - len(text), len(texts) - 1)]) if len(text) < len(h) else text
    at = np.flatnonzero(keep)
    return (h[at] >> np.uint32(17)).astype(np.int64) % GRAMS, text[at]


def chunks(texts: list[bytes | None], size: int = CHUNK):
    """Ranges of about `size` bytes."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or b"")
        if held >= size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


class Model:
    """Log shares of trigrams in languages: entries for those seen, by trigram, and one value a language for all others."""

    def __init__(self, langs: list[str], gram: np.ndarray, lang: np.ndarray, count: np.ndarray, grams: int = GRAMS):
        order = np.lexsort((lang, gram))
        gram, lang, count = gram[order], lang[order].astype(np.int32), count[order].astype(np.float64)
        total = np.bincount(lang, count, len(langs)) + SMOOTHING * grams
        self.langs, self.lang = langs, lang
        self.first = np.searchsorted(gram, np.arange(grams + 1))
        log_p, self.default = np.log((count + SMOOTHING) / total[lang]), np.log(SMOOTHING / total).astype(np.float32)
        #: The mean of the log shares over each language's own texts.
        self.expected = (np.bincount(lang, count * log_p, len(langs)) / np.maximum(np.bincount(lang, count, len(langs)), 1)).astype(np.float32)
        self.log_p = log_p.astype(np.float32)
        #: No log share of a trigram is above this.
        self.top = np.full(grams, self.default.max(initial=-np.inf), np.float32)
        np.maximum.at(self.top, gram, self.log_p)

    def of(self, gram: np.ndarray, langs: np.ndarray) -> np.ndarray:
        """The log shares of some trigrams (rows) in some languages (columns, ascending)."""
        out = np.repeat(self.default[None, langs], len(gram), axis=0)
        n = self.first[gram + 1] - self.first[gram]
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - self.first[gram], n)
        place = np.full(len(self.default), -1)
        place[langs] = np.arange(len(langs))
        column, row = place[self.lang[at]], np.repeat(np.arange(len(gram)), n)
        some = column >= 0
        out[row[some], column[some]] = self.log_p[at[some]]
        return out


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """From counts over all rows of docs with a language and a text."""

    def run(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in chunks(texts):
                gram, at = trigrams(texts[a:b])
                names, number = np.unique(np.array(langs[a:b], object), return_inverse=True)
                key, n = np.unique(number[at] * GRAMS + gram, return_counts=True)
                name = pa.DictionaryArray.from_arrays(pa.array(key // GRAMS, pa.int32()), pa.array(names, pa.string())).cast(pa.string())
                yield pa.RecordBatch.from_arrays([name, pa.array(key % GRAMS), pa.array(n)], ["lang", "gram", "n"])

    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string"), F.col(text).cast("binary"))
    counts = materialize(known.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "trigrams")
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    numbers = docs.sparkSession.createDataFrame(list(enumerate(langs)), "k int, lang string")
    rows = counts.join(bounded_broadcast(numbers, len(langs)), "lang").select("gram", "k", "n").toArrow()  # at most GRAMS rows a language
    return Model(langs, *(rows.column(c).to_numpy() for c in ("gram", "k", "n")))


def fit(gram, count, start, text, share, model):
    """EM steps over a sparse table; share: the proportions at first, zero for languages that are not in a text's set. Returns proportions and log likelihoods."""
    langs = np.flatnonzero(share.any(axis=0))
    different, at = np.unique(gram, return_inverse=True)
    top = model.top[different]
    wide = max(1, CELLS // max(1, len(gram)))
    parts = [langs[i : i + wide] for i in range(0, len(langs), wide)]
    n = np.add.reduceat(count, start)[:, None]

    def shares_of(some):
        return np.exp(model.of(different, some) - top[:, None])[at]

    held = shares_of(parts[0]) if len(parts) == 1 else None

    def explained(some):
        return (shares_of(some) if held is None else held) * share[text][:, some]

    for _ in range(STEPS):
        found = [explained(parts[0])] if held is not None else None
        whole = sum((p.sum(axis=1) for p in (found or map(explained, parts))), np.zeros(len(gram), np.float32))
        weight = (count / np.maximum(whole, 1e-30))[:, None]
        new = np.zeros_like(share)
        for i, some in enumerate(parts):
            new[:, some] = np.add.reduceat((found[i] if found else explained(some)) * weight, start, axis=0) / n
        share = new
    whole = sum((explained(some).sum(axis=1) for some in parts), np.zeros(len(gram), np.float32))
    ll = np.add.reduceat(count * (np.log(np.maximum(whole, 1e-30)) + top[at]), start)
    return share, ll


def infer(texts: list[bytes], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions of the chosen languages (texts by languages, all zero for texts without trigrams), the evidence for the likeliest language against all,
    and the log likelihood a trigram, less what is expected of the chosen languages and allowed for the text's length."""
    k = len(model.langs)
    gram, at = trigrams(texts)
    out, evidence, fits = np.zeros((len(texts), k), np.float32), np.zeros(len(texts)), np.full(len(texts), -np.inf)
    if not len(gram):
        return out, evidence, fits
    key = np.sort(at * GRAMS + gram)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(first, len(key))).astype(np.float32)
    gram, at = key[first] % GRAMS, key[first] // GRAMS
    seen, start, text = np.unique(at, return_index=True, return_inverse=True)
    n = np.add.reduceat(count, start)
    different, place = np.unique(gram, return_inverse=True)
    wide = max(1, CELLS // len(gram))
    single = np.concatenate([np.add.reduceat(count[:, None] * model.of(different, np.arange(i, min(k, i + wide)))[place], start, axis=0, dtype=np.float64) for i in range(0, k, wide)], axis=1)
    share, _ = fit(gram, count, start, text, np.full((len(seen), k), 1 / k, np.float32), model)
    order = np.argsort(-share, axis=1, kind="stable")
    best = single.argmax(axis=1)
    chosen = np.zeros_like(share)
    chosen[np.arange(len(seen)), best] = 1
    likelihood = single.max(axis=1)
    value = likelihood - PENALTY * np.log(n + 1)
    for size in range(2, k + 1):
        some = np.flatnonzero(np.take_along_axis(share, order[:, size - 1 : size], 1)[:, 0] >= LEAST_SHARE)
        if not len(some):
            break
        use = np.isin(text, some)
        sub, sub_start, sub_text = np.unique(text[use], return_index=True, return_inverse=True)
        begin = np.zeros((len(sub), k), np.float32)
        np.put_along_axis(begin, order[sub, :size], 1 / size, 1)
        got, ll = fit(gram[use], count[use], sub_start, sub_text, begin, model)
        better = ll - size * PENALTY * np.log(n[sub] + 1) > value[sub]
        chosen[sub[better]] = got[better]
        likelihood[sub[better]] = ll[better]
        value[sub[better]] = (ll - size * PENALTY * np.log(n[sub] + 1))[better]
    rival = np.exp(np.minimum(0, EVIDENCE * (single - single.max(axis=1, keepdims=True)))).sum(axis=1)
    out[seen], evidence[seen] = chosen, 1 / rival
    fits[seen] = likelihood / n - chosen @ model.expected + SPREAD / np.sqrt(n)
    return out, evidence, fits


def identified(docs: DataFrame, model: Model, columns: list[str], text: str = "text") -> DataFrame:
    """The named columns of docs, _tm_lang, _tm_score, _tm_evidence and _tm_fit (see infer) and _tm_shares (language -> proportion)."""
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        langs = given.value.langs
        size = CHUNK * 8 // max(8, len(langs))
        for batch in batches:
            texts = batch.column("_tm_text").to_pylist()
            lang, shares = ["und"] * len(texts), [[] for _ in texts]
            score, evidence, fits = (np.zeros(len(texts)) for _ in range(3))
            for a, b in chunks(texts, size) if langs else ():
                part, sure, near = infer([t or b"" for t in texts[a:b]], given.value)
                for i in np.flatnonzero(part.any(axis=1)):
                    if any(ch.isalpha() for ch in texts[a + i].decode("utf-8", "replace")):
                        top = part[i].argmax()
                        lang[a + i], score[a + i] = langs[top], min(1.0, part[i, top] * sure[i])
                        evidence[a + i], fits[a + i] = sure[i], near[i]
                        shares[a + i] = [(langs[j], float(part[i, j])) for j in np.flatnonzero(part[i])]
            new = [pa.array(lang), pa.array(score), pa.array(evidence), pa.array(fits), pa.array(shares, pa.map_(pa.string(), pa.float64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *new], [*columns, "_tm_lang", "_tm_score", "_tm_evidence", "_tm_fit", "_tm_shares"])

    picked = docs.select(*columns, F.col(text).cast("binary").alias("_tm_text"))
    schema = picked.select(*columns, F.lit("").alias("_tm_lang"), *(F.lit(0.0).alias(c) for c in ("_tm_score", "_tm_evidence", "_tm_fit")), F.create_map().cast("map<string,double>").alias("_tm_shares")).schema
    return picked.mapInArrow(run, schema)


def accepted(docs: DataFrame) -> DataFrame:
    """docs in one or more languages that were found with LEAST_EVIDENCE and that explain their text (LEAST_FIT); where no row teaches a language, all that have a letter."""
    model = train(docs.where(crc_mod("doc_id", FOLDS) != HELD_OUT))
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = identified(docs, model, docs.columns)
    return found.where((F.col("_tm_lang") != "und") & (F.col("_tm_evidence") >= LEAST_EVIDENCE) & (F.col("_tm_fit") >= LEAST_FIT)).select(*docs.columns)


def op10(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(crc_mod("doc_id", FOLDS) != HELD_OUT))
    found = identified(docs, model, ["doc_id"])
    return found.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("_tm_lang").alias("lang_pred"), F.col("_tm_score").alias("score"))
