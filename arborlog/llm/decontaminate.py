"""Operator 2: benchmark decontamination by random-walk embedding, repeated bit sampling and exact edit verification."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import LOWER, chunks, code_point_offsets, map_batches, mix, shingle_hashes, text_buffer, word_hashes, word_spans

#: Here a word is a run of letters and digits; punctuation and case do not count.
PLAIN = np.zeros(256, bool)
PLAIN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Benchmark items that one pass over the documents looks for.
BLOCK = 20_000
#: Items of fewer words have an index of their own, as their bound on shared word pairs says little.
FEW_WORDS = 8
#: Repetitions of the embedding at least, each with a walk and sampled steps of its own.
REPETITIONS = 64
#: Cells (repetitions x windows) that are embedded at a time.
CELLS = 1 << 16
_ODD = np.uint64(0xBF58476D1CE4E5B9)


def plain_words(b: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end byte of each plain word, and the offsets by document."""
    starts, ends, at = word_spans(b, o, PLAIN)
    return word_hashes(LOWER[b], starts, ends), starts, ends, at


def n_steps(n: int) -> int:
    """Steps of a walk over n words that bits are sampled from: a walk reads a word in two steps on average."""
    return max(1, 2 * n - 4)


def walk_seeds(repetitions: int, n: int) -> np.ndarray:
    """The random bits of the walks: (repetition x step) seeds, the same for every n up to its steps."""
    grid = np.arange(repetitions, dtype=np.uint64)[:, None] << np.uint64(32) | np.arange(n_steps(n), dtype=np.uint64)
    return mix(grid + np.uint64(0x5851F42D4C957F2D))


def sampled_steps(repetitions: int, bits: int, n: int) -> np.ndarray:
    """(repetition x step) of the sampled steps, ``bits`` in each repetition."""
    key = mix(walk_seeds(repetitions, n) ^ np.uint64(0x14057B7EF767814F))
    return key <= np.sort(key, axis=1)[:, min(bits, key.shape[1]) - 1][:, None]


def walk(windows: np.ndarray, repetitions: int):
    """The embedding, step by step: what each walk reads in each window, (repetition x window).

    At a step a walk outputs the word that it stands at and then stays or goes on, by a random bit of the
    word and the step, so two texts that differ by few edits fall into step again after each.
    """
    m, n = windows.shape
    seeds = walk_seeds(repetitions, n)
    flat = np.concatenate((windows, np.zeros((m, 1), np.uint64)), axis=1).ravel()
    at = np.repeat(np.arange(m)[None, :] * (n + 1), repetitions, axis=0)
    last = at + n
    for j in range(seeds.shape[1]):
        word = flat[at]
        yield j, word
        at += (((word ^ seeds[:, j : j + 1]) * _ODD) >> np.uint64(63)).astype(np.int64)
        np.minimum(at, last, out=at)


def embedding(item: np.ndarray, repetitions: int) -> np.ndarray:
    """(step x repetition) words of one item's walks."""
    return np.stack([word[:, 0] for _, word in walk(item[None, :], repetitions)])


def collides(known: np.ndarray, windows: np.ndarray, sampled: np.ndarray) -> np.ndarray:
    """For each window and item of its length, whether all sampled steps of some repetition read the same as the item's ``known``."""
    repetitions = len(sampled)
    step = max(1, CELLS // repetitions)
    out = []
    for a in range(0, len(windows), step):
        part = windows[a : a + step]
        same = np.ones((repetitions, len(part)), bool)
        for j, word in walk(part, repetitions):
            if (take := sampled[:, j]).any():
                same[take] &= word[take] == known[j][take, None]
        out.append(same.any(axis=0))
    return np.concatenate(out) if out else np.empty(0, bool)


@lru_cache(maxsize=None)
def sampling(n: int, edits: int, recall: float, trials: int = 150) -> tuple[int, int]:
    """(repetitions, bits) by which windows at the full edit budget collide with probability ``recall`` at least.

    Measured on random items with ``edits`` deletions, and with as many insertions, which shift a walk and
    so cost most: the most bits that reach it; where one bit does not, the repetitions are doubled.
    """
    if not edits:
        return REPETITIONS, min(4, n_steps(n))
    rng = np.random.default_rng(n)
    words = lambda k: rng.integers(1, 1 << 63, k, dtype=np.uint64)
    items, kinds = words(trials * n).reshape(trials, n), {"d": [], "i": []}
    for item in items:
        kinds["d"].append(np.concatenate((np.delete(item, rng.choice(n, edits, replace=False)), words(edits))))
        kinds["i"].append(np.insert(item, rng.integers(0, n, edits), words(edits))[:n])
    repetitions = REPETITIONS
    while True:
        for bits in (4, 3, 2, 1):
            sampled = sampled_steps(repetitions, bits, n)
            worst = 1.0
            for found in kinds.values():
                same = np.ones((repetitions, trials), bool)
                for (j, x), (_, y) in zip(walk(items, repetitions), walk(np.stack(found), repetitions)):
                    same &= (x == y) | ~sampled[:, j, None]
                worst = min(worst, same.any(axis=0).mean())
            if worst >= recall:
                return repetitions, bits
        if repetitions >= 1024:
            return repetitions, 1
        repetitions *= 2


def _rounded(n: int) -> int:
    """n or the next longer length that is measured: lengths of a grid of half octaves."""
    size = 8
    while size < n:
        size = size * 3 // 2 if size & (size - 1) == 0 else size * 4 // 3
    return size


@dataclass
class Index:
    """Items of a benchmark, by their word pairs and by their walks.

    A part of a text within d edits of an item of n words keeps n - 1 - 3 d of its word pairs at least in the
    n words from its start on: an edit costs two of them, or one and a shifted end.  So windows that keep
    fewer need no embedding, and none within d edits is lost by that.  Windows that collide with the item
    in a repetition are verified by exact edit distance.
    """

    ids: list
    words: list
    ratio: float
    recall: float = 0.98

    def __post_init__(self):
        self.lengths = sorted({len(w) for w in self.words})
        self.edits = {n: int(n * self.ratio) for n in self.lengths}
        self.sampling = {n: sampling(m := _rounded(n), int(m * self.ratio), self.recall) if self.edits[n] else sampling(n, 0, self.recall) for n in self.lengths}
        #: pairs that a window of n words keeps at least
        self.need = {n: max(1, n - 1 - 3 * self.edits[n]) for n in self.lengths}
        long = [n for n in self.lengths if n > 1]
        self.fewest = min((self.need[n] for n in long), default=1)
        self.span = max(1, min(long, default=2) - 1)
        self.dense = min((-(-self.need[n] // -(-(n - 1) // self.span)) for n in long), default=1)
        pairs = [np.unique(shingle_hashes(w, 2)) for w in self.words]
        every, item = np.concatenate(pairs), np.repeat(np.arange(len(pairs)), [len(p) for p in pairs])
        order = np.argsort(every, kind="stable")
        #: the items of pair k are ``holders[first[k] : first[k + 1]]``
        self.pairs, first = np.unique(every[order], return_index=True)
        self.first, self.holders = np.append(first, len(every)), item[order]
        one = [i for i, w in enumerate(self.words) if len(w) == 1]
        #: items of one word, which have no pair
        self.single = np.array(sorted(int(self.words[i][0]) for i in one), np.uint64)
        self.single_item = sorted(one, key=lambda i: int(self.words[i][0]))

    def hits(self, pairs: np.ndarray) -> np.ndarray:
        """For each pair of words its place in ``pairs``, or -1."""
        if not len(self.pairs):
            return np.full(len(pairs), -1)
        at = np.searchsorted(self.pairs, pairs)
        at[at == len(self.pairs)] = 0
        at[self.pairs[at] != pairs] = -1
        return at

    def near(self, hits: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Documents (offsets ``at``) in which enough hits stand close together for some item."""
        c = np.concatenate(([0], np.cumsum(hits >= 0)))
        close = c[np.minimum(np.arange(len(c)) + self.span, len(c) - 1)] - c >= self.dense
        docs = np.unique(np.searchsorted(at, np.flatnonzero(close), "right") - 1)
        return docs[docs < len(at) - 1]

    def candidates(self, hits: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """item -> runs (first, last) of the starts of all windows of one text that keep enough of its pairs."""
        at = np.flatnonzero(hits >= 0)
        if len(at) < self.fewest:
            return {}
        k = hits[at]
        n_holders = self.first[k + 1] - self.first[k]
        begin = np.cumsum(n_holders) - n_holders
        item = self.holders[np.repeat(self.first[k] - begin, n_holders) + np.arange(n_holders.sum())]
        order = np.argsort(item, kind="stable")
        item, places = item[order], np.repeat(at, n_holders)[order]
        of, lo = np.unique(item, return_index=True)
        out = {}
        for i, a, b in zip(of.tolist(), lo.tolist(), [*lo[1:].tolist(), len(item)]):
            n = len(self.words[i])
            p, need = places[a:b], self.need[n]
            if len(p) < need:
                continue
            one, other = p[: len(p) - need + 1], p[need - 1 :]
            ok = other - one <= n - 2
            runs: list[tuple[int, int]] = []
            for x, y in zip(np.maximum(0, other[ok] - (n - 2)).tolist(), one[ok].tolist()):
                if runs and x <= runs[-1][1] + 1:
                    runs[-1] = (runs[-1][0], y)
                else:
                    runs.append((x, y))
            if runs:
                out[i] = runs
        return out

    def colliding(self, item: int, words: np.ndarray, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Runs of the starts among ``runs`` whose window of the item's length collides with it in some repetition."""
        mine = self.words[item]
        n = len(mine)
        repetitions, bits = self.sampling[n]
        cache = self.__dict__.setdefault("_embedded", {})
        if item not in cache:
            if len(cache) > 256:
                cache.clear()
            cache[item] = embedding(mine, repetitions)
        sampled = self.__dict__.setdefault("_sampled", {})
        if n not in sampled:
            sampled[n] = sampled_steps(repetitions, bits, n)
        out: list[tuple[int, int]] = []
        step = max(1, (1 << 20) // n)
        for first, last in runs:
            for a in range(first, last + 1, step):
                b = min(last + 1, a + step)
                part = words[a : b + n - 1]
                part = np.concatenate((part, np.zeros(b - a + n - 1 - len(part), np.uint64)))
                for s in (np.flatnonzero(collides(cache[item], np.lib.stride_tricks.sliding_window_view(part, n), sampled[n])) + a).tolist():
                    if out and s <= out[-1][1] + n:
                        out[-1] = (out[-1][0], s)
                    else:
                        out.append((s, s))
        return out

    def verify(self, item: int, words: np.ndarray, runs: list[tuple[int, int]]) -> tuple[int, int, int] | None:
        """(distance, first word, word after the last) of the item's best part near one of the runs; of equal ones the first."""
        mine, best = self.words[item], None
        n = len(mine)
        d = self.edits[n]
        for first, last in runs:
            for lo in range(max(0, first - d), last + 1, 8 * n):
                dist, a, b = best_match(mine, words[lo : min(last, lo + 8 * n) + n + d])
                if dist <= d:
                    best = min(best or (n, 0, 0), (dist, lo + a, lo + b))
        return best

    def search(self, words: np.ndarray, hits: np.ndarray):
        """(item, distance, first word, word after the last) of each item that stands in one text."""
        for item, runs in self.candidates(hits).items():
            best = self.verify(item, words, self.colliding(item, words, runs))
            if best:
                yield item, *best


def best_match(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(edit distance, start, end) of the part of text that is nearest to item; exact, by dynamic programming.

    A cell is distance * 2^32 + start, so the least cell has the least distance and then the first start;
    a row is one pass over the text, its insertions a running minimum.
    """
    one = 1 << 32
    row = np.arange(len(text) + 1)
    ramp = row * one
    for word in item:
        up = row + one
        np.minimum(up[1:], row[:-1] + (text != word) * one, out=up[1:])
        up -= ramp
        np.minimum.accumulate(up, out=up)
        up += ramp
        row = up
    distance = row >> 32
    end = int(distance.argmin())
    return int(distance[end]), int(row[end] & (one - 1)), end


def _matches(texts: pa.Array, indexes: list[Index]):
    """(row, item_id, distance, start, end) of the items that stand in the texts of a batch; places in code points."""
    for a, _, b, o in chunks(*text_buffer(texts)):
        words, starts, ends, at = plain_words(b, o)
        found = []
        for index in indexes:
            if len(index.single):
                k = np.minimum(np.searchsorted(index.single, words), len(index.single) - 1)
                seen = set()
                for j in np.flatnonzero(index.single[k] == words).tolist():
                    i = int(np.searchsorted(at, j, "right")) - 1
                    for x in range(np.searchsorted(index.single, words[j]), np.searchsorted(index.single, words[j], "right")):
                        if (i, x) not in seen:
                            seen.add((i, x))
                            found.append((i, index.ids[index.single_item[x]], 0, j, j + 1))
            if len(words) < 2 or not len(index.pairs):
                continue
            hits = index.hits(shingle_hashes(words, 2))
            for i in index.near(hits, at).tolist():
                lo, hi = int(at[i]), int(at[i + 1])
                for item, distance, x, y in index.search(words[lo:hi], hits[lo : max(lo, hi - 1)]):
                    found.append((i, index.ids[item], distance, lo + x, lo + y))
        for i, item_id, distance, x, y in sorted(found):
            points = code_point_offsets(b[o[i] : o[i + 1]])
            yield a + i, item_id, distance, int(points[starts[x] - o[i]]), int(points[ends[y - 1] - o[i]])


def _indexes(benchmark: DataFrame, ratio: float, recall: float, shortest: int):
    """The indexes of each block of items: one for very short items, one for all others."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).distinct()
    n_blocks = -(-items.count() // BLOCK)
    for k in range(n_blocks):
        rows = sorted(items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == k).collect(), key=lambda r: (r["item_id"], r["text"] or ""))
        buf, off = text_buffer(pa.array([r["text"] for r in rows], pa.string()))
        known: dict[bool, tuple[list, list]] = {}
        for a, _, b, o in chunks(buf, off):
            h, _, _, at = plain_words(b, o)
            for i in range(len(o) - 1):
                if (n := int(at[i + 1] - at[i])) >= max(1, shortest):
                    ids, words = known.setdefault(n >= FEW_WORDS, ([], []))
                    ids.append(rows[a + i]["item_id"])
                    words.append(h[at[i] : at[i + 1]])
        if known:
            yield [Index(ids, words, ratio, recall) for _, (ids, words) in sorted(known.items())]


def leaks(docs: DataFrame, benchmark: DataFrame, ratio: float = 0.15, recall: float = 0.98, shortest: int = 1) -> DataFrame:
    """(doc_id, item_id, distance, start, end): benchmark items (item_id, text) that stand in documents (doc_id, text).

    An item of n words stands in a text if some part of it is within int(ratio * n) word edits; case
    and punctuation do not count, so items of up to six words match exactly.  Windows of the item's length
    that share enough word pairs with it are embedded by random walks, which make edits positions; those
    that agree with the item in all sampled bits of a repetition are verified by exact edit distance, and
    the nearest part comes back with its code points, of equal ones the first.  Bits and repetitions are
    chosen for each length so that a part at the full edit budget collides with probability ``recall``.

    Every distinct (item_id, text) with ``shortest`` words at least is looked for; null and empty texts match
    nothing; documents without an id come back with a null id; rows that repeat a doc_id come back each, and so do
    items that repeat an item_id with other texts; other columns are ignored; an empty table gives no rows.
    Items are taken BLOCK at a time, each block in one pass without a shuffle.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, distance int, start long, end long")
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
    for indexes in _indexes(benchmark, ratio, recall, shortest):

        def f(batch, indexes=indexes):
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[r[0]], *r[1:]) for r in _matches(batch.column("text"), indexes)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "item_id", "distance", "start", "end"])

        out = out.unionByName(map_batches(docs, f, "doc_id long, item_id long, distance int, start long, end long"))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, ratio: float = 0.15, recall: float = 0.98, shortest: int = 5) -> DataFrame:
    """docs without the rows in whose text a benchmark item of ``shortest`` words at least stands.

    A phrase of fewer words stands in ordinary prose by chance, so it drops no document.  Each row is judged by
    its own text, whatever its id; all columns come back; an empty benchmark drops none.
    """
    for indexes in _indexes(benchmark, ratio, recall, shortest):

        def f(batch, indexes=indexes):
            keep = np.ones(batch.num_rows, bool)
            for row, *_ in _matches(batch.column("text"), indexes):
                keep[row] = False
            yield batch.filter(pa.array(keep))

        docs = map_batches(docs, f, docs.schema)
    return docs


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
