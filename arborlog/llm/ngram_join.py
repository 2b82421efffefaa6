"""Operator 1: n-gram Jaccard join with multiple-global-order filtering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .components import connected_components, merged_components
from .textkit import LOWER, chunks, fold, give_back, lighten, map_batches, mix, release, shingle_hashes, small, small_batches, text_buffer, word_hashes, word_spans, written

#: Seeds of the token orders.  The first deals out candidates, the others must confirm them.  The second is by hash
#: alone, the others have rare tokens first.
ORDER_SEEDS = (0x51ED270B0A1F39C1, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25)
#: Seeds of the hash orders whose first tokens alone make the first round of candidates.
FIRST_SEEDS = (ORDER_SEEDS[1], 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63)
#: Shingles among which a task looks for frequent ones at a time.
BLOCK = 2_000_000
#: Tokens at most in the list of frequent ones, which come last in every order.
FREQUENT = 1 << 18


def document_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    buf, off = text_buffer(texts)
    out: list[np.ndarray] = []
    for _, _, b, o in chunks(buf, off):
        b = LOWER[b]
        starts, ends, at = word_spans(b, o)
        words = word_hashes(b, starts, ends)
        shingles = shingle_hashes(words, k)
        for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
            if j - i >= k:
                s = np.sort(shingles[i : j - k + 1])
                out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
            else:
                out.append(np.array([fold(words[i:j])] if j > i else [], np.uint64))
    return out


def needed(n, percent: int):
    """The least intersection of a set of n with any set that it links with: ceil(percent * n / 100)."""
    return -(-n * percent // 100)


NONE = np.empty(0, np.uint64)


def prefix(tokens: np.ndarray, seed: int, percent: int, frequent: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The first n - needed + 1 tokens in one global order: rare ones by a seeded hash, then frequent ones by class."""
    n = len(tokens)
    order = mix(tokens ^ np.uint64(seed)) >> np.uint64(6)
    if len(frequent):
        i = np.searchsorted(frequent, tokens)
        i[i == len(frequent)] = 0
        order |= np.where(frequent[i] == tokens, rank[i], 0).astype(np.uint64) << np.uint64(58)
    p = n - needed(n, percent) + 1
    first = np.argpartition(order, p - 1)[:p] if p < n else np.arange(n)
    return tokens[first[np.argsort(order[first])]]


def as_long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    off = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(x) for x in parts], out=off[1:])
    flat = np.concatenate(parts) if parts else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(kind)))


def describe(docs: DataFrame, k: int) -> DataFrame:
    """Of every document its size, a 128-bit signature of its set and its first tokens in some hash orders; of every BLOCK shingles the frequent ones."""
    schema = "doc_id long, n long, s1 long, s2 long, firsts array<long>"
    names = ["doc_id", "n", "s1", "s2", "firsts"]

    def rows(batch, sets):
        n = np.array([len(s) for s in sets], np.int64)
        s1 = np.array([s.sum(dtype=np.uint64) for s in sets], np.uint64)
        s2 = np.array([mix(s ^ np.uint64(ORDER_SEEDS[2])).sum(dtype=np.uint64) for s in sets], np.uint64)
        firsts = _lists([np.array([mix(s ^ np.uint64(seed)).min() for seed in FIRST_SEEDS], np.uint64) if len(s) else NONE for s in sets], np.int64)
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), as_long(s1), as_long(s2), firsts], names)

    def frequent(sets):
        # an eighth of the hash range at a time, so the sorted copy is small
        cuts = np.arange(1, 8, dtype=np.uint64) << np.uint64(61)
        at = [np.concatenate(([0], np.searchsorted(s, cuts), [len(s)])) for s in sets]
        for q in range(8):
            every = np.sort(np.concatenate([s[a[q] : a[q + 1]] for s, a in zip(sets, at)]))
            if not len(every):
                continue
            first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1], [True])))
            count = np.diff(first)
            top = count >= 3
            t, c = every[first[:-1][top]], count[top]
            none = pa.nulls(len(t), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(-c), as_long(t), none, pa.nulls(len(t), pa.list_(pa.int64()))], names)

    def run(it):
        held, size = [], 0
        for batch in it:
            if not batch.num_rows:
                continue
            sets = document_sets(batch.column("text"), k)
            yield rows(batch, sets)
            held += sets
            size += sum(map(len, sets))
            if size > BLOCK:
                yield from frequent(held)
                held, size = [], 0
        if held:
            yield from frequent(held)
        give_back()

    return small_batches(docs).mapInArrow(run, schema)


def prefix_rows(docs: DataFrame, k: int, percent: int, frequent: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(token, n, pos, doc_id) for each prefix token of each document in the first order."""

    def f(batch):
        sets = document_sets(batch.column("text"), k)
        ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
        some = [i for i, s in enumerate(sets) if len(s)]
        parts = [prefix(sets[i], ORDER_SEEDS[0], percent, frequent, rank) for i in some]
        if not parts:
            return
        size = np.array([len(p) for p in parts])
        n = np.repeat(np.array([len(sets[i]) for i in some], np.int32), size)
        pos = np.concatenate([np.arange(x, dtype=np.int32) for x in size])
        table = pa.RecordBatch.from_arrays([as_long(np.concatenate(parts)), pa.array(n), pa.array(pos), pa.array(np.repeat(ids[some].astype(np.int64), size))], ["token", "n", "pos", "doc_id"])
        for a in range(0, table.num_rows, 100_000):
            yield table.slice(a, 100_000)

    return map_batches(docs, f, "token long, n int, pos int, doc_id long")


def bitmap(tokens: np.ndarray) -> bytes:
    """A bitmap of four to eight bits for each token: a power of two of bits, set at the hash's upper bits."""
    size = max(64, 1 << (4 * max(1, len(tokens)) - 1).bit_length())
    bits = np.zeros(size, bool)
    bits[(tokens >> np.uint64(24)) & np.uint64(size - 1)] = True
    return np.packbits(bits).tobytes()


def most_shared(x: bytes, nx: int, y: bytes, ny: int) -> int:
    """An upper bound of two sets' intersection: a bit that only one has is a token that only one has."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    while len(a) > len(b):
        a = a[: len(a) // 2] | a[len(a) // 2 :]
    while len(b) > len(a):
        b = b[: len(b) // 2] | b[len(b) // 2 :]
    return min(nx - int(np.bitwise_count(a & ~b).sum()), ny - int(np.bitwise_count(b & ~a).sum()))


def short_prefix(tokens: np.ndarray, seed: int, percent: int, frequent: np.ndarray, rank: np.ndarray) -> bytes:
    """The prefix in one order, 16 bits of each token: sets whose prefixes share no token may seem to, never the reverse."""
    return np.unique((prefix(tokens, seed, percent, frequent, rank) >> np.uint64(48)).astype("<u2")).tobytes()


def share(x: bytes, y: bytes) -> bool:
    a, b = np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2")
    at = a.searchsorted(b)
    at[at == len(a)] = 0
    return bool((a[at] == b).any())


def filter_rows(docs: DataFrame, k: int, percent: int, frequent: np.ndarray, rank: np.ndarray) -> DataFrame:
    """(doc_id, n, short prefixes of the second and third order, bitmap) of each document."""
    orders = ((ORDER_SEEDS[1], NONE, NONE), (ORDER_SEEDS[2], frequent, rank))

    def f(batch):
        sets = document_sets(batch.column("text"), k)
        n = pa.array(np.array([len(s) for s in sets], np.int64))
        binary = [pa.array([g(s) for s in sets], pa.binary()) for g in (*(lambda s, o=o: short_prefix(s, o[0], percent, *o[1:]) for o in orders), bitmap)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, *binary], ["doc_id", "n", "second", "third", "bits"])

    return map_batches(docs, f, "doc_id long, n long, second binary, third binary, bits binary")


def set_rows(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, tokens): the whole set of each document."""

    def f(batch):
        sets = document_sets(batch.column("text"), k)
        table = pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], ["doc_id", "tokens"])
        for a in range(0, table.num_rows, 500):
            yield table.slice(a, 500)

    return map_batches(docs, f, "doc_id long, tokens binary")


def possible(n1, pos1, n2, pos2, percent: int):
    """Whether two sets can link if their first shared token stands at these positions (length and position bounds)."""
    most = 1 + np.minimum(n1 - pos1, n2 - pos2) - 1
    lo, hi = np.minimum(n1, n2), np.maximum(n1, n2)
    return (100 * lo >= percent * hi) & ((100 + percent) * most >= percent * (n1 + n2))


def shared_tokens(rows: DataFrame) -> DataFrame:
    """Rows of tokens that two documents at least have.

    Input is sorted by token; memory is one batch however many documents share a token.
    """

    def run(it):
        held, last = None, None
        for batch in it:
            if held is not None:
                batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                held = None
            if not batch.num_rows:
                continue
            t = batch.column("token").to_numpy()
            run_id = np.cumsum(np.concatenate(([True], t[1:] != t[:-1]))) - 1
            keep = np.bincount(run_id)[run_id] > 1
            if last is not None and last == t[0]:
                keep |= run_id == 0
            if keep[-1]:
                last = t[-1]
            else:
                held, last = batch.slice(batch.num_rows - 1), None
            yield batch.filter(pa.array(keep))
        give_back()

    return small_batches(rows).mapInArrow(run, rows.schema)


def first_round(per_doc: DataFrame, percent: int, block: int = 1000) -> DataFrame:
    """Each document with the shortest that has the same first token in a hash order, and with the next shorter one.

    The second kind is taken within blocks of about ``block`` documents of a group, so no group is one task's.
    """
    rows = per_doc.select("doc_id", "n", F.posexplode("firsts").alias("o", "token"))
    heads = rows.groupBy("o", "token").agg(F.min(F.struct("n", "doc_id")).alias("head"), F.count("*").alias("c")).where("c > 1").select("o", "token", "c", F.col("head.n").alias("hn"), F.col("head.doc_id").alias("hd"))
    met = rows.join(heads, ["o", "token"])
    near = Window.partitionBy("o", "token", F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("c") / block))).orderBy("n", F.xxhash64("doc_id", "o"))
    met = met.withColumns({"pn": F.lag("n").over(near), "pd": F.lag("doc_id").over(near)})
    pairs = met.select("doc_id", "n", F.explode(F.array(F.struct(F.col("hn").alias("n"), F.col("hd").alias("d")), F.struct(F.col("pn").alias("n"), F.col("pd").alias("d")))).alias("x"))
    pairs = pairs.where((F.col("doc_id") != F.col("x.d")) & (100 * F.col("x.n") >= percent * F.col("n")))
    return pairs.select(F.least("doc_id", "x.d").alias("a"), F.greatest("doc_id", "x.d").alias("b")).distinct()


#: Documents of a token that one task meets with each other; those of a token with more are dealt out to pairs of parts.
PART = 4096


def open_tokens(rows: DataFrame, part: int = PART) -> DataFrame:
    """rows (token, n, pos, doc_id, comp) of the tokens whose documents are of several components, with ``i``, ``j``, ``c``.

    A token's documents are hashed to parts of about ``part`` documents; a document of part c comes back
    for each pair (i, j) of parts with c, so a task holds two parts, and every two documents meet once.
    """
    several = rows.groupBy("token").agg(F.min("comp").alias("__lo"), F.max("comp").alias("__hi"), F.count("*").alias("__m")).where("__lo < __hi").select("token", F.ceil(F.col("__m") / part).cast("int").alias("parts"))
    kept = rows.join(several, "token").withColumn("c", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    pairs = kept.withColumn("o", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    return pairs.select("token", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"), "n", "pos", "doc_id", "comp", "c")


def crossings(rows: DataFrame, percent: int, few: int = 0, part: int = PART, tasks: int = 1) -> DataFrame:
    """All pairs of documents of different components that meet at a token and can link there.

    few: at one of ``few`` tokens only, each document outside a part's largest component with one of
    that component's documents, so rows are no more than the input's.  tasks: partitions at least, as
    a byte of these rows costs far more time than one of a plain shuffle.
    """
    keys = ("token", "i", "j")
    rows = open_tokens(rows.where(F.pmod("token", F.lit(few)) == 0) if few > 1 else rows, part)
    rows = rows.where("i = j") if few else rows
    tasks = max(tasks, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(tasks, *keys).sortWithinPartitions(*keys, "n").select(*keys, "n", "pos", "doc_id", "comp", "c")

    def some(token, n, pos, doc, comp, c):
        comps, count = np.unique(comp, return_counts=True)
        inside = comp == comps[count.argmax()]
        d = doc[inside]
        other = doc[~inside]
        d = d[(mix((other ^ token ^ few).astype(np.uint64)) % np.uint64(len(d))).astype(np.int64)]
        yield np.minimum(d, other), np.maximum(d, other)

    def pairs(token, n, pos, doc, comp, c):
        across = c[0] != c[-1] or (c != c[0]).any()
        for i in range(len(n) - 1):
            end = int(np.searchsorted(n, n[i] * 100 // percent, side="right"))
            if end <= i + 1:
                continue
            j = slice(i + 1, end)
            ok = (comp[j] != comp[i]) & possible(n[i], pos[i], n[j], pos[j], percent)
            if across:
                ok &= c[j] != c[i]
            if ok.any():
                d = doc[j][ok]
                yield np.minimum(d, doc[i]), np.maximum(d, doc[i])

    meet = some if few else pairs

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[k] for x in found])) for k in (0, 1)], ["a", "b"])

    def run(it):
        held, found, size = None, [], 0

        def group(cols):
            if len(cols[0]) > 1 and (cols[6] != cols[6][0]).any():
                yield from meet(cols[0][0], *cols[3:])

        for batch in it:
            cols = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(8)]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols)]
            cut = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0) | (np.diff(cols[2]) != 0)) + 1
            at = [0, *cut.tolist()]
            for x, y in zip(at[:-1], at[1:]):
                for p in group([c[x:y] for c in cols]):
                    found.append(p)
                    size += len(p[0])
                    if size > 50_000:
                        yield out(found)
                        found, size = [], 0
            held = [c[at[-1] :] for c in cols]
        if held is not None:
            found += group(held)
        if found:
            yield out(found)
        give_back()

    return small_batches(rows).mapInArrow(run, "a long, b long")


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Documents whose id is (left_semi) or is not (left_anti) among ids, which are counted before any broadcast."""
    return docs.join(small(ids, ids.count()), "doc_id", how)


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int, frequent: np.ndarray, rank: np.ndarray) -> DataFrame:
    """Pairs that share prefix tokens under the other orders too and whose whole sets reach the Jaccard threshold.

    The orders' filters are intersected on the short prefixes, together with the bitmaps' bound; whole
    sets are made and travel only of documents in a pair that is left.
    """

    def ends(pairs):
        return written(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())

    def side(table, x):
        return table.select(*(F.col(c).alias(x if c == "doc_id" else f"{c}_{x}") for c in table.columns))

    ids = ends(pairs)
    filters = written(filter_rows(_only(docs, ids, "left_semi"), k, percent, frequent, rank))

    def worth(batch):
        x = [batch.column(i).to_pylist() for i in range(2, 10)]
        keep = [share(p2, q2) and share(p3, q3) and 100 * (m := most_shared(p, i, q, j)) >= percent * (i + j - m) for i, p2, p3, p, j, q2, q3, q in zip(*x)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    met = pairs.join(side(filters, "a"), "a").join(side(filters, "b"), "b").select("a", "b", *(f"{c}_{x}" for x in "ab" for c in filters.columns[1:]))
    left = written(map_batches(met, worth, "a long, b long"))

    def f(batch):
        x = ([np.frombuffer(t, np.uint64) for t in batch.column(c).to_pylist()] for c in ("tokens_a", "tokens_b"))
        size = [(len(np.intersect1d(p, q, assume_unique=True)), len(p) + len(q)) for p, q in zip(*x)]
        keep = pa.array([100 * m >= percent * (total - m) for m, total in size], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array([m for m, _ in size], pa.int64())], ["a", "b", "shared"]).filter(keep)

    kept = ends(left)
    sets = written(set_rows(_only(docs, kept, "left_semi"), k))
    both = left.join(side(sets, "a"), "a").join(side(sets, "b"), "b").select("a", "b", "tokens_a", "tokens_b")
    links = written(map_batches(both, f, "a long, b long, shared long"))
    release(ids, filters, left, kept, sets)
    lighten(docs.sparkSession)
    return links


def _classes(docs: DataFrame, k: int):
    """(described documents, membership, ids that are copies, one text of each class, frequent tokens, their ranks)."""
    lighten(docs.sparkSession)
    known = written(describe(docs, k))
    per_doc = known.where("n >= 0").select("doc_id", "n", "s1", "s2")
    total = per_doc.count()
    top = known.where("n < 0").groupBy(F.col("s1").alias("token")).agg(F.sum(-F.col("n")).alias("c")).where(F.col("c") >= max(6, total // 100_000)).orderBy(F.desc("c"), "token").limit(FREQUENT).collect()
    frequent = np.array(sorted(r["token"] & (1 << 64) - 1 for r in top), np.uint64)
    by = {r["token"] & (1 << 64) - 1: min(63, int(r["c"]).bit_length()) for r in top}
    rank = np.array([by[t] for t in frequent.tolist()], np.int64)

    classes = written(per_doc.where("n > 0 and doc_id is not null").groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"))
    n_classes = classes.count()
    members = per_doc.join(small(classes, n_classes), ["n", "s1", "s2"], "left").select("doc_id", "n", F.coalesce("rep", "doc_id").alias("class_id"))
    copies = members.where("class_id <> doc_id").select("doc_id").distinct()
    texts = _only(docs.where("doc_id is not null"), copies, "left_anti")
    return known, members, copies, texts, frequent, rank


def ngram_links(docs: DataFrame, k: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """(links, membership): every link between documents of different sets, and who is of which class.

    links: a, b (a < b, the smallest ids of two classes), shared (size of the intersection).
    membership: doc_id, n_shingles, class_id, n_links: the documents other than itself that the document
    links with, those of its own set included, as if copies were written out.

    Every two classes that share a prefix token of the first order are met, whether other links
    join them or not, so rows grow with the links; ``ngram_jaccard_join`` gives the components alone for less.
    A null or empty text has no links and a null doc_id none either; rows that repeat a doc_id and a text
    count once; an id should name one text, as of a copy's id other texts are not met; other columns are
    ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    known, members, _, texts, frequent, rank = _classes(docs, k)
    rows = prefix_rows(texts, k, percent, frequent, rank)
    rows = written(shared_tokens(rows.repartition("token").sortWithinPartitions("token")))
    lighten(spark)
    met = written(crossings(rows.withColumn("comp", F.col("doc_id")), percent, tasks=-(-rows.count() // 100_000)).distinct())
    found = verified(texts, met, k, percent, frequent, rank)
    links, members = written(found.distinct()), written(members.distinct())
    release(rows, met, found, known)
    size = members.where("n > 0 and doc_id is not null").groupBy("class_id").agg(F.count("*").alias("__size"))
    ends = links.select(F.col("a").alias("x"), F.col("b").alias("y")).union(links.select("b", "a"))
    near = ends.join(size, F.col("y") == F.col("class_id")).groupBy(F.col("x").alias("class_id")).agg(F.sum("__size").alias("__near"))
    counts = size.join(near, "class_id", "left").select("class_id", (F.col("__size") - 1 + F.coalesce("__near", F.lit(0))).alias("__links"))
    out = members.join(counts, "class_id", "left").select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.coalesce("__links", F.lit(0))).otherwise(0).alias("n_links"))
    return links, out


def ngram_jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per document: doc_id, n_shingles, class_id (smallest id with the same set), component_id (smallest id reachable by links).

    Two documents link when 100 * intersection >= percent * union of their sets of k-word shingles
    (A-Z lower-cased; fewer than k words: the whole sequence as one).  Documents with equal sets are
    one class, met once.  Classes become candidates when they share a prefix token in a first global
    order under the length and position bounds; of those, the ones that share prefix tokens under two
    further orders too are verified on their whole sets.  Tokens that many documents have come last in all
    orders, so a common passage is in few prefixes.  Candidates are dealt out in rounds: each
    document with some that have the same very first token in a hash order; after components are
    taken, documents outside a token's largest component with some inside; after components are taken
    again, all pairs of different components that share a prefix token of the first order; so a family of copies costs rows in proportion to its size, and
    pairs that are not compared are in one component already.

    Null and empty texts have no shingles and link with nothing; a null doc_id never links and comes
    back as it is; rows that repeat a doc_id link as copies do; an empty table gives no rows; other
    columns are ignored.  Sets are of 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark = docs.sparkSession
    known, members, copies, texts, frequent, rank = _classes(docs, k)
    rows = prefix_rows(texts, k, percent, frequent, rank)
    rows = written(shared_tokens(rows.repartition("token").sortWithinPartitions("token")))
    lighten(spark)
    alone = known.where("n > 0 and doc_id is not null").select("doc_id", "n", "firsts")
    first = written(first_round(alone.join(small(copies, copies.count()), "doc_id", "left_anti"), percent))
    links = verified(texts, first, k, percent, frequent, rank)
    found = written(connected_components(links))
    tested, done, tasks = first, [rows, first, links], -(-rows.count() // 100_000)
    for few in (4, 1, 0):
        n_found = found.count()
        comp = rows.join(small(found, n_found), rows.doc_id == found.node, "left").select("token", "n", "pos", "doc_id", F.coalesce("component", "doc_id").alias("comp"))
        more = written(crossings(comp, percent, few, tasks=tasks).distinct().join(tested, ["a", "b"], "left_anti"))
        done.append(more)
        if not more.isEmpty():
            tested = tested.union(more)
            links = verified(texts, more, k, percent, frequent, rank)
            done.append(links)
            if not links.isEmpty():
                done.append(found)
                found = merged_components(found, links)
    release(*done)
    return (
        members.join(small(found, found.count()), F.col("class_id") == F.col("node"), "left")
        .select("doc_id", F.col("n").alias("n_shingles"), "class_id", F.coalesce("component", "class_id").alias("component_id"))
    )


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return ngram_jaccard_join(docs).select("doc_id", "n_shingles", "component_id", "class_id")
