"""Log probabilities of texts under an n-gram model whose counts live in a log-frequency Bloom filter.

Training counts runs of up to ORDER tokens over all training texts. A count is kept as its level, 1 + floor(log of the count to the base STEP), and a run of level q puts q events in
the filter: (run, 1), ..., (run, q). Reading asks for one level after the other until one is not there; a miss is certain, a hit is wrong once in some hundred. An event's HASHES bits lie in one word
of 64. Probabilities are those of each order smoothed by the order below, down to the add-half share of single tokens; counts of a run are rounded down to their level and counts of what stands
before it up, so that the probabilities of all tokens after a context never sum above 1 but for wrong hits.

The filter is cut into blocks by the first bits of a run's hash, as many as the training tokens ask for, each made by one task; the very first bit says whether the run is of ORDER tokens. Filters of at most
BROADCAST_BYTES go to the workers by broadcast. Of larger ones, only the blocks of shorter runs do: the runs of ORDER tokens go to groups of blocks, with the levels of the shorter runs that their probabilities take,
and only sums come back, by some hundred texts at a time, which gives the same scores. Should the shorter runs alone exceed it, their levels come back to the texts by exchange first. Single-token counts of the base score are exact: words of high count travel as one table of at most
HEAD words, all others are joined, and none of those has over about N / HEAD tokens.

Words are runs of other characters than ASCII spaces, A-Z in lower case; each text is followed by one end token, which also stands before its first word as context.

Defined results: a null text is empty, and both are one end token; repeated rows are learned and scored each; a null doc_id counts as ''; without training texts every token has the same probability; an empty table
gives no rows; texts of any length are counted and scored whole.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import crc_mod, materialize, table, with_row_ids

FOLDS, HELD_OUT = 5, 1
ORDER = 2
#: Weight of the order below, in counts.
PRIOR = 40.0
STEP, BITS, HASHES = 1.5, 10, 4
#: Tokens whose runs one block holds, bytes of text that are counted or scored at once, and the largest filter that is broadcast.
BLOCK_TOKENS, CHUNK, BROADCAST_BYTES = 1 << 20, 2 << 20, 128 << 20
#: Tasks that make or ask the blocks; a task holds one block at a time, or, where texts ask, blocks of about so many bytes.
MOST_TASKS, GROUP_BYTES = 20_000, 16 << 20
#: Words of the table that is broadcast at most, and the bytes of one.
HEAD, HEAD_BYTES = 200_000, 256

#: Least count of each level from 1 on, and the greatest.
LOW = np.array([int(np.ceil(round(STEP**j, 9))) for j in range(100)], np.int64)
HIGH = np.append(LOW[1:] - 1, np.iinfo(np.int64).max)
#: A hash ends with 16 bits of 0, which are not exchanged.
_KEPT, _FULL = np.uint64(0xFFFFFFFFFFFF0000), np.uint64(1 << 63)
_P, _Q, _R = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _Q
    x = (x ^ (x >> np.uint64(27))) * _R
    return x ^ (x >> np.uint64(31))


def smoothed(level: np.ndarray, before: np.ndarray | None, p: np.ndarray | None, total: float) -> np.ndarray:
    """The probability of runs by their level, the level of what stands before their last token, and the probability by the order below; of single tokens by their share of the total."""
    count = np.where(level > 0, LOW[level - 1], 0)
    if p is None:
        return (count + 0.5) / total
    return (count + PRIOR * p) / (np.where(before > 0, HIGH[before - 1], 0).astype(np.float64) + PRIOR)


def split(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def packed(runs: np.ndarray) -> bytes:
    return runs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


class Runs:
    """The tokens of some texts with the hashes of the runs that end in each; runs[k] are of k tokens, and of `long[k]` tokens only they are whole. The first bit of a hash says whether the run is of `order` tokens."""

    def __init__(self, texts: list[list[bytes]], order: int = ORDER):
        digest = xxhash.xxh64_intdigest
        sizes = np.array([len(t) + 2 for t in texts])
        start = np.cumsum(sizes) - sizes
        token = np.zeros(sizes.sum(), np.uint64)
        inner = np.ones(len(token), bool)
        inner[start] = inner[start + sizes - 1] = False
        token[inner] = np.fromiter((digest(w) for t in texts for w in t), np.uint64, int(inner.sum()))
        place = np.arange(len(token)) - np.repeat(start, sizes)
        self.text, self.token = np.repeat(np.arange(len(texts)), sizes), place > 0
        self.order, self.runs, self.long = order, {1: self._marked(mixed(token * _P + np.uint64(1)), order == 1)}, {1: np.ones(len(token), bool)}
        for k in range(2, order + 1):
            before = np.concatenate([np.zeros(1, np.uint64), self.runs[k - 1][:-1]])
            self.runs[k], self.long[k] = self._marked(mixed(before * _P + self.runs[1] + np.uint64(k)), k == order), place >= k - 1

    @staticmethod
    def _marked(runs: np.ndarray, full: bool) -> np.ndarray:
        runs = (runs >> np.uint64(1)) & _KEPT
        return runs | _FULL if full else runs

    def counted(self) -> np.ndarray:
        """All runs, as often as they occur: those of single tokens without the start."""
        return np.concatenate([self.runs[k][self.token & self.long[k]] for k in self.runs])

    def asked(self, orders: range | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The different runs of each text whose counts scores need, of all orders or of these: (text, run), sorted; and where each stands among them, one order after the other."""
        orders = self.runs if orders is None else orders
        text, run = (np.concatenate(x) for x in zip(*((self.text[self.long[k]], self.runs[k][self.long[k]]) for k in orders)))
        order = np.lexsort((run, text))
        text, run = text[order], run[order]
        fresh = np.concatenate([[True], (text[1:] != text[:-1]) | (run[1:] != run[:-1])])
        at = np.zeros(len(run), np.int64)
        at[order] = np.cumsum(fresh) - 1
        return text[fresh], run[fresh], at

    def chances(self, level: dict[int, np.ndarray], total: float) -> np.ndarray:
        """The probability of each token by the runs of the orders that have levels."""
        p = before = None
        for k, of_run in level.items():
            here = smoothed(of_run, before, p, total)
            p = here if p is None else np.where(self.long[k], here, p)
            # What stands before the next token; an end is the start of the next text there, and is not looked at.
            before = np.concatenate([[0], of_run[:-1]])
        return p

    def scores(self, level_of, total: float, n_texts: int) -> np.ndarray:
        """log10 probabilities of the texts; level_of gives the levels of runs, total is what single tokens share."""
        p = self.chances({k: level_of(run) for k, run in self.runs.items()}, total)
        logs = np.where(self.token, np.log10(p), 0.0)
        return np.bincount(self.text, logs, n_texts)


def chunks(texts: list, size: int):
    first = held = 0
    for i, t in enumerate(texts):
        held += len(t or b"")
        if held >= size:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def bits(run: np.ndarray, level: int | np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of an event in a block of so many words, and its bits there."""
    e = mixed(run + _P * np.asarray(level, np.uint64))
    place = ((e >> np.uint64(32)) * words.astype(np.uint64)) >> np.uint64(32)
    mask = np.zeros(len(e), np.uint64)
    for i in range(HASHES):
        mask |= np.uint64(1) << ((e >> np.uint64(6 * i)) & np.uint64(63))
    return place.astype(np.int64), mask


def block_of(runs: np.ndarray, n: int) -> np.ndarray:
    """The block of each run, of n, a power of two; sorted runs have sorted blocks."""
    return (runs >> np.uint64(64 - (n.bit_length() - 1))).astype(np.int64) if n > 1 else np.zeros(len(runs), np.int64)


def levels(runs: np.ndarray, flat: np.ndarray, start: np.ndarray, n: int | None = None, first_block: int = 0) -> np.ndarray:
    """The levels of runs in a filter: its words, and where each block starts in them; or in the part of a filter of n blocks that begins with first_block."""
    block = block_of(runs, n or len(start) - 1) - first_block
    words, first = np.diff(start)[block], start[:-1][block]
    level, at = np.zeros(len(runs), np.int64), np.flatnonzero(words)
    for j in range(1, len(LOW) + 1):
        place, mask = bits(runs[at], j, words[at])
        at = at[flat[first[at] + place] & mask == mask]
        if not len(at):
            break
        level[at] = j
    return level


def filter_blocks(docs: DataFrame, n: int, order: int = ORDER, text: str = "text") -> DataFrame:
    """(block, words) of the filter of all runs in the texts of docs, in n blocks."""

    def count(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in chunks(texts, CHUNK):
                runs, k = np.unique(Runs([split(t) for t in texts[a:b]], order).counted(), return_counts=True)
                block, first = np.unique(block_of(runs, n), return_index=True)
                ends = [*first[1:], len(runs)]
                data, k = packed(runs), k.astype("<u4")
                parts = [(data[6 * i : 6 * j], k[i:j].tobytes()) for i, j in zip(first, ends)]
                yield pa.RecordBatch.from_arrays([pa.array(block), *(pa.array([p[c] for p in parts], pa.binary()) for c in (0, 1))], ["block", "runs", "k"])

    def build(batches):
        block, held = None, []
        for batch in batches:
            for b, r, k in zip(*(batch.column(c).to_pylist() for c in ("block", "runs", "k"))):
                if b != block and held:
                    yield built(block, held)
                    held = []
                block = b
                held.append((r, k))
        if held:
            yield built(block, held)

    def built(block, held):
        runs = unpacked(b"".join(r for r, _ in held))
        k = np.frombuffer(b"".join(x for _, x in held), "<u4").astype(np.int64)
        order_ = np.argsort(runs, kind="stable")
        runs = runs[order_]
        first = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1]]))
        level = np.searchsorted(LOW, np.add.reduceat(k[order_], first), "right")
        # Events are (run, 1) to (run, level).
        number = np.arange(level.sum()) - np.repeat(np.cumsum(level) - level, level) + 1
        size = max(16, -(-len(number) * BITS // 64))
        words = np.zeros(size, np.uint64)
        place, mask = bits(np.repeat(runs[first], level), number, np.full(len(number), size))
        np.bitwise_or.at(words, place, mask)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([words.tobytes()], pa.binary())], ["block", "words"])

    counted = docs.select(F.col(text).cast("binary")).mapInArrow(count, "block long, runs binary, k binary")
    return by_block(counted, n).sortWithinPartitions("block").mapInArrow(build, "block long, words binary")


def by_block(rows: DataFrame, n: int, block: str = "block") -> DataFrame:
    """rows with every block whole in one partition, and the blocks dealt out evenly."""
    parts = min(n, MOST_TASKS)
    return rows.repartitionById(parts, F.pmod(block, F.lit(parts)).cast("int"))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, n) of all texts, exactly; the end is the empty word."""

    def run(batches):
        held: Counter = Counter()
        for batch in batches:
            for t in batch.column(0).to_pylist():
                held.update(split(t))
                held[b""] += 1
                if len(held) > 300_000:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    def rows(held):
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

    return docs.select(F.col(text).cast("binary")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def head_words(counts: DataFrame, most: int = HEAD) -> dict[bytes, int]:
    """Words of the highest counts, at most so many: those of the highest levels that fit, by a histogram of levels."""
    level = sum((F.col("n") >= int(x)).cast("int") for x in LOW[:64])
    short = counts.where(F.octet_length("word") <= HEAD_BYTES)
    found, least = 0, None
    for at, n in sorted(short.groupBy(level.alias("level")).agg(F.count("*")).collect(), reverse=True):
        if found + n > most:
            break
        found, least = found + n, int(LOW[at - 1])
    return {} if least is None else {bytes(w): n for w, n in short.where(F.col("n") >= least).collect()}


def broadcast_filter(blocks: DataFrame, n: int):
    """The words of the filter and where each block starts, for workers."""
    sizes = dict(blocks.select("block", F.octet_length("words")).collect())
    start = np.concatenate([[0], np.cumsum([sizes.get(b, 0) // 8 for b in range(n)])]).astype(np.int64)
    flat = np.zeros(start[-1], np.uint64)  # BROADCAST_BYTES at most, filled by one partition after the other
    for b, words in blocks.select("block", "words").toLocalIterator():
        flat[start[b] : start[b + 1]] = np.frombuffer(words, np.uint64)
    return blocks.sparkSession.sparkContext.broadcast((flat, start))


def groups_of(n: int, size: int) -> int:
    """Groups of the n blocks of a filter, half of which hold `size` bytes: of about GROUP_BYTES each, two at least."""
    return min(n, 2 << max(0, int(np.ceil(np.log2(max(1, size / GROUP_BYTES))))))


def met(asked: DataFrame, blocks: DataFrame, n: int, groups: int, answers, schema: str) -> DataFrame:
    """What answers(rows, levels) gives for rows of `asked` (grp, data: packed runs, ...) of one group of blocks, and the levels of all their runs. blocks are the first or the second half of a filter of n blocks in so many groups."""
    per, names = n // groups, asked.columns

    def run(batches):
        group, held, flat, start, waiting, used = None, {}, None, None, [], 0

        def answered():
            runs = unpacked(b"".join(x["data"] for x in waiting))
            return answers(waiting, levels(runs, flat, start, n, group * per))

        for batch in batches:
            block_of_row = batch.column("block").to_pylist()
            for i, (g, data) in enumerate(zip(batch.column("grp").to_pylist(), batch.column("data"))):
                if waiting and (g != group or used >= CHUNK // 8):
                    yield answered()
                    waiting, used = [], 0
                if g != group:
                    group, held, flat = g, {}, None
                if block_of_row[i] is not None:
                    held[block_of_row[i] - g * per] = np.frombuffer(data.as_py(), np.uint64)
                    continue
                if flat is None:
                    start = np.concatenate([[0], np.cumsum([len(held.get(k, ())) for k in range(per)])]).astype(np.int64)
                    flat, held = np.concatenate([np.zeros(0, np.uint64), *(held[k] for k in sorted(held))]), {}
                waiting.append({c: batch.column(c)[i].as_py() for c in names})
                used += len(waiting[-1]["data"]) // 6
        if waiting:
            yield answered()

    rows = asked.withColumn("block", F.lit(None).cast("long"))
    words = blocks.select(F.floor(F.col("block") / per).alias("grp"), F.col("words").alias("data"), "block")
    both = by_block(rows.unionByName(words, allowMissingColumns=True), max(1, groups // 2), "grp")
    return both.sortWithinPartitions(F.col("grp"), F.col("block").asc_nulls_last()).mapInArrow(run, schema)


def questions(batches, n: int, groups: int, order: int = ORDER, orders: range | None = None):
    """(grp, _tm_row, data) of batches (_tm_row, _tm_text): the text's different runs of these orders, sorted, a row for each group of blocks that they fall into; batches of at most CHUNK / 8 bytes of text, or of one text."""
    for batch in batches:
        ids, texts = batch.column("_tm_row").to_pylist(), batch.column("_tm_text").to_pylist()
        for a, b in chunks(texts, CHUNK // 8):
            text, runs, _ = Runs([split(t) for t in texts[a:b]], order).asked(orders)
            group, data = block_of(runs, n) // (n // groups), packed(runs)
            first = np.flatnonzero(np.concatenate([[True], (text[1:] != text[:-1]) | (group[1:] != group[:-1])]))
            parts = [data[6 * i : 6 * j] for i, j in zip(first, [*first[1:], len(runs)])]
            yield pa.RecordBatch.from_arrays([pa.array(group[first], pa.int64()), pa.array([ids[a + i] for i in text[first]], pa.int64()), pa.array(parts, pa.binary())], ["grp", "_tm_row", "data"])


def exchanged_levels(rows: DataFrame, blocks: DataFrame, n: int, order: int, size: int) -> DataFrame:
    """(_tm_row, levels) of rows (_tm_row, _tm_text): the levels of the text's different runs of lower orders, sorted, one byte each. Runs go to their groups of blocks (of `size` bytes in all), and levels come back."""
    groups = groups_of(n, size)

    def ask(batches):
        return questions(batches, n, groups, order, range(1, order))

    def answers(waiting, level):
        ends = np.cumsum([len(x["data"]) // 6 for x in waiting])
        got = np.split(level.astype(np.uint8), ends[:-1])
        return pa.RecordBatch.from_pylist([{"_tm_row": x["_tm_row"], "grp": x["grp"], "levels": v.tobytes()} for x, v in zip(waiting, got)], pa.schema([("_tm_row", pa.int64()), ("grp", pa.int64()), ("levels", pa.binary())]))

    asked = rows.select("_tm_row", "_tm_text").mapInArrow(ask, "grp long, _tm_row long, data binary")
    got = met(asked, blocks, n, groups, answers, "_tm_row long, grp long, levels binary")
    by_row = got.groupBy("_tm_row").agg(F.array_sort(F.collect_list(F.struct("grp", "levels"))).alias("parts"))  # as long as the text
    return by_row.select("_tm_row", F.expr("aggregate(parts, binary(''), (a, p) -> concat(a, p.levels))").alias("levels"))


def exchanged_scores(rows: DataFrame, blocks: DataFrame, n: int, order: int, size: int, total: float, given) -> DataFrame:
    """(_tm_row, _tm_score) of rows (_tm_row, _tm_text, and the levels of lower orders where these are not `given`, by broadcast). The runs of full order go to their groups of blocks (of `size` bytes in all), each with two levels
    for every order below: of the run that ends with it, and of the one that ends before its last token. A message has the runs of some texts that fall into one group, and is answered by a sum for each of the texts."""
    groups = groups_of(n, size)
    lower, per = range(1, order), n // groups
    types = {"grp": pa.int64(), "data": pa.binary(), "lower": pa.binary(), "counts": pa.binary(), "part": pa.int64(), "ids": pa.binary(), "more": pa.binary()}

    def ask(batches):
        for batch in batches:
            ids, texts = batch.column("_tm_row").to_pylist(), batch.column("_tm_text").to_pylist()
            found = batch.column("levels").to_pylist() if given is None and order > 1 else None
            for a, b in chunks(texts, CHUNK // 8):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(messages(ids[a:b], texts[a:b], found and found[a:b]), types.values())], list(types))

    def messages(ids, texts, found):
        runs, level = Runs([split(t) for t in texts], order), {}
        if found:
            level = answered_levels(runs, lower, found)
        elif order > 1:
            for k in lower:
                different, at = np.unique(runs.runs[k], return_inverse=True)
                level[k] = levels(different, *given.value)[at]
        whole = runs.token & runs.long[order]
        alone = np.flatnonzero(runs.token & ~whole)
        more = np.bincount(runs.text[alone], np.log10(runs.chances(level, total)[alone]), len(texts)) if len(alone) else np.zeros(len(texts))
        at = np.flatnonzero(whole)
        group = block_of(runs.runs[order][at], n) // per
        by_group = np.argsort(group, kind="stable")
        at, group = at[by_group], group[by_group]
        data, text = packed(runs.runs[order][at]), runs.text[at]
        low = np.stack([*(level[k][at] for k in lower), *(level[k][at - 1] for k in lower)]).astype(np.uint8) if order > 1 else np.zeros((0, len(at)), np.uint8)
        different, first = np.unique(group, return_index=True)
        spans = list(zip(different.tolist(), first, [*first[1:], len(at)])) or [(groups // 2, 0, 0)]
        rest = [None] * (len(spans) - 1)
        return (
            [g for g, _, _ in spans], [data[6 * i : 6 * j] for _, i, j in spans], [low[:, i:j].tobytes() for _, i, j in spans], [np.bincount(text[i:j], minlength=len(texts)).astype("<u4").tobytes() for _, i, j in spans],
            [ids[0]] * len(spans), [np.array(ids, "<i8").tobytes(), *rest], [more.astype("<f8").tobytes(), *rest],
        )

    def answers(waiting, level):
        out, end = [], 0
        size = [len(x["data"]) // 6 for x in waiting]
        low = np.concatenate([np.frombuffer(x["lower"], np.uint8).reshape(2 * len(lower), m) for x, m in zip(waiting, size)], axis=1).astype(np.int64)
        p = before = None
        for k, here in enumerate([*low[: len(lower)], level]):
            p = smoothed(here, before, p, total)
            before = low[len(lower) + k] if k < len(lower) else None
        logs = np.log10(p)
        for x, m in zip(waiting, size):
            counts = np.frombuffer(x["counts"], "<u4")
            sums = np.bincount(np.repeat(np.arange(len(counts)), counts), logs[end : end + m], len(counts))
            out.append((x["part"], x["grp"], (sums if x["more"] is None else sums + np.frombuffer(x["more"], "<f8")).astype("<f8").tobytes(), x["ids"]))
            end += m
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["part", "grp", "sums", "ids"])

    def add(batches):
        part, ids, sums = None, None, None
        for batch in batches:
            done = []
            for p, x, i in zip(*(batch.column(c).to_pylist() for c in ("part", "sums", "ids"))):
                x = np.frombuffer(x, "<f8")
                if p == part:
                    sums = sums + x
                else:
                    done += [] if part is None else [(ids, sums)]
                    part, ids, sums = p, i, x  # the first message of a part has its ids
            yield scores(done)
        yield scores([] if part is None else [(ids, sums)])

    def scores(done):
        ids = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(i, "<i8") for i, _ in done)])
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.concatenate([np.zeros(0), *(x for _, x in done)]))], ["_tm_row", "_tm_score"])

    used = ["_tm_row", "_tm_text", *(["levels"] if given is None and order > 1 else [])]
    asked = rows.select(*used).mapInArrow(ask, "grp long, data binary, lower binary, counts binary, part long, ids binary, more binary")
    got = met(asked, blocks, n, groups, answers, "part long, grp long, sums binary, ids binary")
    return got.repartition("part").sortWithinPartitions("part", "grp").mapInArrow(add, "_tm_row long, _tm_score double")


def answered_levels(runs: Runs, orders: range, found: list[bytes]) -> dict[int, np.ndarray]:
    """The levels of the runs of these orders, from those of each text's different runs."""
    _, _, at = runs.asked(orders)
    got, end, level = np.frombuffer(b"".join(found), np.uint8).astype(np.int64)[at], 0, {}
    for k in orders:
        level[k] = np.zeros(len(runs.token), np.int64)
        m = int(runs.long[k].sum())
        level[k][runs.long[k]] = got[end : end + m]
        end += m
    return level


def scored(docs: DataFrame, columns: list[str], text: str = "text", doc_id: str = "doc_id", order: int = ORDER, most_broadcast: int = BROADCAST_BYTES, head: int = HEAD) -> DataFrame:
    """The named columns of docs with _tm_held_out, _tm_tokens, _tm_known, _tm_train (tokens), _tm_base and _tm_score."""
    spark = docs.sparkSession
    train = docs.where(crc_mod(doc_id, FOLDS) != HELD_OUT)
    counts = materialize(word_counts(train, text), "words")
    n_train, n_words = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total = n_train + 0.5 * (n_words + 1)
    n = 1 << max(1, int(np.ceil(np.log2(max(1, n_train / BLOCK_TOKENS)))))
    blocks = materialize(filter_blocks(train, n, order, text), "filter")
    of_half = [F.coalesce(F.sum(F.when(half, F.octet_length("words"))), F.lit(0)) for half in (F.col("block") < n // 2, F.col("block") >= n // 2)]
    lower_size, full_size = blocks.agg(*of_half).first()
    whole = lower_size + full_size <= most_broadcast
    frequent = spark.sparkContext.broadcast(head_words(counts, head))

    rows = with_row_ids(docs).select(*columns, crc_mod(doc_id, FOLDS).alias("_tm_fold"), "_tm_row", F.col(text).cast("binary").alias("_tm_text"))
    given = sums = None
    if whole:
        given = broadcast_filter(blocks, n)
    else:
        lower, full = (blocks.where(x) for x in (F.col("block") < n // 2, F.col("block") >= n // 2))
        asking = rows.select("_tm_row", "_tm_text")
        if lower_size <= most_broadcast:
            given = broadcast_filter(lower, n)
        elif order > 1:
            asking = asking.join(exchanged_levels(asking, lower, n, order, lower_size), "_tm_row")
        sums = exchanged_scores(asking, full, n, order, full_size, total, given)
    kept = [*columns, "_tm_fold", "_tm_row"]

    def run(batches):
        for batch in batches:
            texts = batch.column("_tm_text").to_pylist()
            for a, b in chunks(texts, CHUNK):
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *part(texts[a:b])], [*kept, "_tm_tokens", "_tm_known", "_tm_base", "_tm_score", "_tm_rare"])

    def part(texts):
        words = [split(t) for t in texts]
        score = np.zeros(len(texts))
        if whole:
            runs, flat, start = Runs(words, order), *given.value

            def level_of(x):
                different, at = np.unique(x, return_inverse=True)
                return levels(different, flat, start)[at]

            score = runs.scores(level_of, total, len(texts))
        base, known, rare, often, ends = [], [], [], [], [0]
        for w in words:
            each = Counter(w)
            each[b""] = 1
            n_of = np.fromiter((frequent.value.get(x, -1) for x in each), np.int64, len(each))
            k = np.fromiter(each.values(), np.int64, len(each))
            is_head = n_of >= 0
            base.append(float((k[is_head] * (np.log10(n_of[is_head] + 0.5) - np.log10(total))).sum()))
            known.append(int(k[is_head].sum()))
            rare += [x for x, seen in zip(each, is_head) if not seen]
            often.append(k[~is_head])
            ends.append(len(rare))
        pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(np.concatenate(often))], ["word", "k"])
        tokens = pa.array([len(w) + 1 for w in words], pa.int64())
        return [tokens, pa.array(known, pa.int64()), pa.array(base, pa.float64()), pa.array(score, pa.float64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)]

    schema = rows.select(*kept, *(F.lit(0).cast("long").alias(c) for c in ("_tm_tokens", "_tm_known")), *(F.lit(0.0).alias(c) for c in ("_tm_base", "_tm_score")), F.array().cast("array<struct<word:binary,k:bigint>>").alias("_tm_rare")).schema
    first = materialize(rows.mapInArrow(run, schema), "scored")
    if sums is not None:
        first = first.drop("_tm_score").join(materialize(sums, "sums"), "_tm_row")
    each = first.select("_tm_row", F.explode("_tm_rare").alias("x")).select("_tm_row", "x.word", "x.k").join(counts, "word", "left")
    rest = each.groupBy("_tm_row").agg(F.sum(F.when(F.col("n").isNotNull(), F.col("k")).otherwise(0)).alias("more"), F.sum(F.col("k") * (F.log10(F.coalesce("n", F.lit(0)) + 0.5) - float(np.log10(total)))).alias("logs"))
    out = first.drop("_tm_rare").join(rest, "_tm_row", "left")
    return out.select(
        *columns, (F.col("_tm_fold") == HELD_OUT).alias("_tm_held_out"), "_tm_tokens", (F.col("_tm_known") + F.coalesce("more", F.lit(0))).alias("_tm_known"), F.lit(int(n_train)).cast("long").alias("_tm_train"),
        (F.col("_tm_base") + F.coalesce("logs", F.lit(0.0))).alias("_tm_base"), "_tm_score",
    )


def op13(spark, sf_dir) -> DataFrame:
    found = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"])
    return found.select("doc_id", *(F.col(f"_tm_{c}").alias(a) for c, a in (("held_out", "held_out"), ("tokens", "n_tokens"), ("known", "n_known"), ("train", "train_tokens"), ("base", "base_score"), ("score", "score"))))
