"""Benchmark decontamination: a prefix-filtered set join of item windows and documents.

An item's windows are its runs of WINDOW consecutive words (a shorter item is one window). A window is held whole
or not at all, so of its shingles, ordered by rarity in the documents, the rarest one alone is its necessary
prefix. One pass over the documents counts the items' shingles; a second one joins document shingles with
the prefixes, keeps starts where the window lies inside the document (positional and length bounds) and
verifies all words exactly: by the hash of the whole window, of which each start has at most one, then word by word, so that the work is
linear in the text however often words repeat. Items are broadcast in blocks of about BLOCK_BYTES of text. Where there are several blocks, one pass first sets
aside all documents none of whose windows is in a bit filter of all items' windows (of fixed size, exact for what it sets aside), so that only suspects are read once a block.

Defined results: a null or empty text has no words; repeated documents keep one row each; repeated items and item ids
count once; rows that tie in rarity take the leftmost shingle; a null item id reads as ''; no items, or no documents, give zero counts or no rows.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, table

WINDOW, SHINGLE = 10, 3
BLOCK_BYTES = 16 << 20
#: Bytes of documents that are handled as one array.
CHUNK = 1 << 20
#: Candidates that are verified at a time.
PIECE = 1 << 18
#: Bits of the filter of all windows, as a power of two.
FILTER_BITS = 27

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0-9, a-z and all bytes of characters beyond ASCII.
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


class Words:
    """The words of some texts: first and last 8 bytes and length, which tell words of up to 16 bytes exactly, and their text's number."""

    def __init__(self, texts: list[bytes | None]):
        sizes = np.array([len(t or b"") for t in texts], np.int64)
        raw = np.frombuffer(b"\0".join([*(t or b"" for t in texts), b"\0" * 16]), np.uint8)
        self.bytes = raw = _LOWER[raw]
        inside = _IS_WORD[raw]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        n = self.size = self.end - self.start
        eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
        mask = np.where(n >= 8, np.uint64(0xFFFFFFFFFFFFFFFF), (np.uint64(1) << (8 * np.minimum(n, 7)).astype("<u8")) - np.uint64(1))
        self.first = eight[self.start] & mask
        self.last = eight[np.maximum(self.end - 8, self.start)] & mask
        h = (self.first * _A) ^ (self.last * _B) ^ (n.astype("<u8") * _C)
        self.hash = (h ^ (h >> np.uint64(29))) * _D
        # offsets[i] is the number of the first word of text i
        ends = np.cumsum(sizes + 1)
        self.offsets = np.concatenate([[0], np.searchsorted(self.start, ends)])

    def shingles(self, k: int) -> np.ndarray:
        """A hash for each run of k words, those over the border of two texts included."""
        h = self.hash
        out = h[: max(0, len(h) - k + 1)].copy()
        for i in range(1, k):
            out = (out ^ (out >> np.uint64(31))) * _A + h[i : len(h) - k + 1 + i]
        return out

    def word(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.end[i]].tobytes()


def _ragged(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The ranges of n numbers from each first one, in a row."""
    return np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())


class Index:
    """The different windows of a block of items, by their length and prefix."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.ids = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.ids)}
        self.words = w = Words([t for _, t in items])
        n = np.diff(w.offsets)
        length = np.minimum(WINDOW, n)
        windows = np.where(n > 0, n - length + 1, 0)
        start, length, item = _ragged(w.offsets[:-1], windows), np.repeat(length, windows), np.repeat([number[name] for name, _ in items], windows).astype(np.int64)
        key = np.zeros(len(start), "<u8")
        for size in np.unique(length):
            own = length == size
            key[own] = w.shingles(size)[start[own]]
        # Equal windows are one; windows of equal hash and other words stay apart.
        order = np.lexsort((item, key, length))
        start, length, item, key = start[order], length[order], item[order], key[order]
        new = np.ones(len(start), bool)
        if len(start) > 1:
            new[1:] = (length[1:] != length[:-1]) | (key[1:] != key[:-1]) | ~same_words(w, start[1:], w, start[:-1], length[1:])
        at = np.flatnonzero(new)
        self.start, self.length, self.key = start[at], length[at], key[at]
        self.items, self.first = item, np.append(at, len(item))
        self.kinds = {}  # by shingle length: hashes of the windows' shingles, sorted and different
        for k in range(1, SHINGLE + 1):
            if len(own := np.flatnonzero(np.minimum(self.length, SHINGLE) == k)):
                self.kinds[k] = np.unique(w.shingles(k)[_ragged(self.start[own], self.length[own] - k + 1)])
        self.filters = {k: _filter(h) for k, h in self.kinds.items()}
        self.prefix = {}

    def count(self, words: Words) -> dict[int, np.ndarray]:
        out = {}
        for k, known in self.kinds.items():
            _, rank = self.found(words, k, known, self.filters[k])
            out[k] = np.bincount(rank, minlength=len(known))
        return out

    @staticmethod
    def found(words: Words, k: int, known: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of known shingles, and which they are."""
        h = words.shingles(k)
        at = np.flatnonzero(mask[(h >> np.uint64(44)).astype(np.int64)])
        rank = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
        same = known[rank] == h[at]
        return at[same], rank[same]

    def order(self, counts: dict[int, np.ndarray]) -> None:
        """Chooses each window's rarest shingle, the leftmost of equals, as its prefix."""
        for size in np.unique(self.length):
            k = min(int(size), SHINGLE)
            known, own, h = self.kinds[k], np.flatnonzero(self.length == size), self.words.shingles(k)
            best, offset = np.full(len(own), np.iinfo(np.int64).max), np.zeros(len(own), np.int64)
            for o in range(size - k + 1):
                n = counts[k][np.searchsorted(known, h[self.start[own] + o])]
                offset, best = np.where(n < best, o, offset), np.minimum(n, best)
            # A prefix and its place in the window: at most WINDOW pairs a prefix.
            pairs = np.unique(np.stack([h[self.start[own] + offset], offset.astype("<u8")], 1), axis=0)
            distinct, first = np.unique(pairs[:, 0], return_index=True)
            self.prefix[int(size)] = (distinct, _filter(distinct), pairs[:, 1].astype(np.int64), np.append(first, len(pairs)), own)

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Windows that occur: the number of their first word, and the window."""
        text_of = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
        starts, wins = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for size, (known, mask, offset, first, own) in self.prefix.items():
            at, rank = self.found(words, min(size, SHINGLE), known, mask)
            whole, keys = words.shingles(size) if len(at) else None, self.key[own]
            for a in range(0, len(at), PIECE):
                n = first[rank[a : a + PIECE] + 1] - first[rank[a : a + PIECE]]
                place = np.repeat(at[a : a + PIECE], n)
                s = place - offset[_ragged(first[rank[a : a + PIECE]], n)]
                t = text_of[place]
                s = np.unique(s[(s >= words.offsets[t]) & (s + size <= words.offsets[t + 1])])  # positional and length bounds
                low = np.searchsorted(keys, whole[s])
                n = np.searchsorted(keys, whole[s], "right") - low
                s, w = np.repeat(s, n), own[_ragged(low, n)]
                same = same_words(words, s, self.words, self.start[w], self.length[w])
                starts.append(s[same]), wins.append(w[same])
        return np.concatenate(starts), np.concatenate(wins)

    def items_of(self, windows: np.ndarray) -> list[str]:
        """The ids of the items that have one of these windows."""
        windows = np.unique(windows)
        return [self.ids[i] for i in np.unique(self.items[_ragged(self.first[windows], self.first[windows + 1] - self.first[windows])])]


def same_words(a: Words, s: np.ndarray, b: Words, t: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the `length` words from s in a are those from t in b, letter by letter."""
    same = np.ones(len(s), bool)
    for o in range(int(length.max(initial=0))):
        at = np.flatnonzero(same & (o < length))
        i, j = s[at] + o, t[at] + o
        equal = (a.first[i] == b.first[j]) & (a.last[i] == b.last[j]) & (a.size[i] == b.size[j])
        for k in np.flatnonzero(equal & (a.size[i] > 16)):  # first and last 8 bytes tell all of the shorter ones
            equal[k] = a.word(i[k]) == b.word(j[k])
        same[at] = equal
    return same


def _filter(hashes: np.ndarray) -> np.ndarray:
    mask = np.zeros(1 << 20, bool)
    mask[(hashes >> np.uint64(44)).astype(np.int64)] = True
    return mask


def _chunks(texts: list[bytes | None]):
    """Ranges of texts of about CHUNK bytes."""
    first, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or b"")
        if held >= CHUNK:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _rarity(docs: DataFrame, text: str, index: Index) -> dict[int, np.ndarray]:
    """How often each shingle of the items stands in all documents. What is collected is bounded by the block of items."""
    given = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        index, total = given.value, {}
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in _chunks(texts):
                for k, n in index.count(Words(texts[a:b])).items():
                    total[k] = total.get(k, 0) + n
        for k, n in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(n[at])], ["k", "rank", "n"])

    counts = docs.select(F.col(text).cast("binary")).mapInArrow(run, "k long, rank long, n long").groupBy("k", "rank").agg(F.sum("n").alias("n"))
    out = {k: np.zeros(len(h), np.int64) for k, h in index.kinds.items()}
    for k, rank, n in counts.collect():
        out[k][rank] = n
    return out


def marked(docs: DataFrame, items: DataFrame, columns: list[str], text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The named columns of docs, and _tm_n (words), _tm_spans (merged hit ranges of word numbers, flat) and _tm_items (ids of items with windows that occur)."""
    spark = docs.sparkSession
    items = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(item_text), F.lit("")).cast("binary").alias("t")).distinct()
    weight = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    blocks = max(1, -(-weight // BLOCK_BYTES))
    if blocks > 1:
        items = materialize(items, "items")
    out = docs.select(*columns, F.col(text).cast("binary").alias("_tm_text"), F.lit(0).cast("long").alias("_tm_n"), F.array().cast("array<long>").alias("_tm_spans"), F.array().cast("array<string>").alias("_tm_items"))
    aside = None
    if blocks > 1:
        looked = materialize(_filtered(out, items), "looked")
        aside, out = looked.where("_tm_text is null"), looked.where("_tm_text is not null")
        docs, text = out, "_tm_text"
    for block in range(blocks):
        part = items.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == block)
        index = Index([(i, bytes(t)) for i, t in part.collect()])
        index.order(_rarity(docs, text, index))
        out = out.mapInArrow(_marker(spark.sparkContext.broadcast(index)), out.schema)
        if block < blocks - 1:
            out = materialize(out, "marked")  # one block's workers at a time
    return (out.union(aside) if aside is not None else out).drop("_tm_text")


def _window_bits(words: Words, sizes: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places in the filter of all runs of these many words that lie within a text, and each one's text."""
    places, texts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    text_of = np.repeat(np.arange(len(words.offsets) - 1), np.diff(words.offsets))
    for size in sizes:
        h = words.shingles(size)
        own = text_of[: len(h)]
        within = np.arange(len(h)) + size <= words.offsets[own + 1]
        places.append(((h ^ np.uint64(size)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)[within])
        texts.append(own[within])
    return np.concatenate(places), np.concatenate(texts)


def _filtered(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs with _tm_n, and with _tm_text kept only where a window may be an item's."""

    def bits(batches):
        for batch in batches:
            texts = batch.column("t").to_pylist()
            for a, b in _chunks(texts):
                words = Words(texts[a:b])
                n = np.diff(words.offsets)
                for size in range(1, WINDOW + 1):
                    place, text = _window_bits(words, [size])
                    place = np.unique(place[(n[text] == size) | ((size == WINDOW) & (n[text] > size))])
                    yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(np.full(len(place), size))], ["place", "size"])

    found = materialize(items.mapInArrow(bits, "place long, size long").distinct(), "item-windows")
    sizes = sorted(r.size for r in found.select("size").distinct().collect())
    # At most 2 ** (FILTER_BITS - 6) rows of 64 bits.
    rows = found.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 AS int))")).alias("bits")).toPandas()
    words = np.zeros(1 << (FILTER_BITS - 6), "<i8")
    words[rows["word"]] = rows["bits"]
    given = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        known = given.value.view("<u8")
        for batch in batches:
            names, texts = batch.schema.names, batch.column("_tm_text").to_pylist()
            n, suspect = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
            for a, b in _chunks(texts):
                words = Words(texts[a:b])
                n[a:b] = np.diff(words.offsets)
                place, text = _window_bits(words, sizes)
                hit = (known[place >> 6] >> (place & 63).astype("<u8")) & np.uint64(1)
                suspect[a + text[hit > 0]] = True
            new = {"_tm_n": pa.array(n), "_tm_text": pa.array([t if s else None for t, s in zip(texts, suspect)], pa.binary())}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names)

    return docs.mapInArrow(run, docs.schema)


def _marker(given):
    def run(batches):
        index = given.value
        for batch in batches:
            names = batch.schema.names
            texts, spans, ids = (batch.column(c).to_pylist() for c in ("_tm_text", "_tm_spans", "_tm_items"))
            counts = np.zeros(len(texts), np.int64)
            for a, b in _chunks(texts):
                words = Words(texts[a:b])
                counts[a:b] = np.diff(words.offsets)
                start, window = index.hits(words)
                text_of = np.searchsorted(words.offsets, start, "right") - 1
                by = np.argsort(text_of, kind="stable")
                start, window, text_of = start[by], window[by], text_of[by]
                edges = np.flatnonzero(np.diff(text_of, prepend=-1, append=len(texts)))
                for i, j in zip(edges[:-1], edges[1:]):
                    t = text_of[i]
                    at = start[i:j] - words.offsets[t]
                    spans[a + t] = _merged(spans[a + t], at, at + index.length[window[i:j]])
                    ids[a + t] = sorted({*ids[a + t], *index.items_of(window[i:j])})
            new = {"_tm_n": pa.array(counts), "_tm_spans": pa.array(spans, pa.list_(pa.int64())), "_tm_items": pa.array(ids, pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([new.get(c, batch.column(c)) for c in names], names)

    return run


def _merged(old: list[int], start: np.ndarray, end: np.ndarray) -> list[int]:
    start, end = np.concatenate([old[0::2], start]).astype(np.int64), np.concatenate([old[1::2], end]).astype(np.int64)
    by = np.argsort(start, kind="stable")
    start, end = start[by], np.maximum.accumulate(end[by])
    new = np.concatenate([[True], start[1:] > end[:-1]])
    first = np.flatnonzero(new)
    return np.stack([start[first], end[np.append(first[1:], len(start)) - 1]], 1).ravel().tolist()


def decontaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those in which a window of an item occurs."""
    return marked(docs, items, docs.columns).where(F.size("_tm_items") == 0).select(*docs.columns)


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate("_tm_spans", F.lit(0).cast("long"), lambda acc, x: x - acc)  # b2-(a2-(b1-(a1-0))): the sum of end - start
    return found.select("doc_id", F.col("_tm_n").alias("n_words"), hit.alias("n_hit"), F.size("_tm_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", F.array_sort("_tm_items")).cast("binary"), 256).alias("items_sha256"), (F.size("_tm_items") > 0).alias("contaminated"))


def op4(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return digest(marked(docs, table(spark, sf_dir, "benchmark"), ["doc_id"]))
