"""Operator 7: personal data by patterns, and information-theoretic sanitisation of terms that reveal it."""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import LOWER, chunks, code_point_offsets, map_batches, release, small, text_buffer, word_hashes, word_spans, written

#: Kinds in the order in which spans of one start are listed; the first four are the base.
KINDS = ("email", "ip", "card", "phone", "secret", "term", "removed")
BASE = KINDS[:4]
#: Terms at most that are looked up in memory; more are joined, behind a bitmap of their hashes.
IN_MEMORY = 1_000_000
#: log2 of the bits of that bitmap.
BITMAP_BITS = 25

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CODE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_ANY = np.zeros(256, bool)
_ANY[list(b"@0123456789")] = True


def _emails(text: str):
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of emails, addresses, cards and phones, in code points, end exclusive; each kind for itself."""
    found = [(a, b, "email") for a, b in _emails(text)] if "@" in text else []
    if "." in text:
        found += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0])
        if 14 <= len(d) <= 19 and _luhn(d):
            found.append((m.start(), m.end(), "card"))
    if "+" in text:
        found += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def secret_spans(text: str, bits: float = 80.0) -> list[tuple[int, int, str]]:
    """Codes of letters and digits whose characters carry ``bits`` of information at least: keys and tokens."""
    out = []
    for m in _CODE.finditer(text):
        s = m[0]
        n = len(s)
        mixed = sum(("0" <= a <= "9") != ("0" <= b <= "9") for a, b in zip(s, s[1:]))
        if mixed >= 6 and n * -sum(c / n * math.log2(c / n) for c in Counter(s).values()) >= bits:
            out.append((m.start(), m.end(), "secret"))
    return out


def _without_overlaps(first: list, more: list) -> list:
    """first and those of more that overlap none of it."""
    ends: list[int] = []
    starts: list[int] = []
    for a, e, _ in sorted(first):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(a)
            ends.append(e)

    def free(s) -> bool:
        k = bisect.bisect_right(ends, s[0])
        return k == len(starts) or starts[k] >= s[1]

    return first + [s for s in more if free(s)]


def known_spans(text: str) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    return sorted(_without_overlaps(base, secret_spans(text)), key=lambda s: (s[0], KINDS.index(s[2])))


class Words:
    """Words of one chunk of texts: their lower-cased hashes, code point spans and offsets by document."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        starts, ends, self.at = word_spans(buf, off)
        self.hash = word_hashes(LOWER[buf], starts, ends)
        points = code_point_offsets(buf)
        base = np.repeat(points[off[:-1]], np.diff(self.at))
        self.start, self.end = points[starts] - base, points[ends] - base


def _private_texts(b: np.ndarray, o: np.ndarray):
    """(index, text) of the texts of a chunk that hold an @ or a digit; all kinds but no others need one."""
    marks = np.zeros(len(b) + 1, np.int64)
    np.cumsum(_ANY[b], out=marks[1:])
    for i in np.flatnonzero(marks[o[1:]] > marks[o[:-1]]).tolist():
        yield i, b[o[i] : o[i + 1]].tobytes().decode("utf-8", "replace")


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)


def contexts(docs: DataFrame) -> DataFrame:
    """(entity, term, n): in how many documents of a batch a term stands beside an entity; term 0 is the entity itself.

    An entity is one personal datum's lower-cased text; its terms are the words of the whole document that
    overlap no personal datum.  A row with a null entity counts documents.
    """

    def f(batch):
        pairs: Counter = Counter()
        for _, _, b, o in chunks(*text_buffer(batch.column("text"))):
            for i, text in _private_texts(b, o):
                spans = known_spans(text)
                if not spans:
                    continue
                w = Words(b[o[i] : o[i + 1]], np.array([0, o[i + 1] - o[i]]))
                free = np.ones(len(w.hash), bool)
                for start, end, _ in spans:
                    free[np.searchsorted(w.end, start, "right") : np.searchsorted(w.start, end)] = False
                terms = np.unique(w.hash[free].view(np.int64)).tolist()
                seen = set()
                for entity in {_digest(text[start:end].lower()) for start, end, _ in spans}:
                    seen.add((entity, 0))
                    seen.update((entity, t) for t in terms)
                pairs.update(seen)
        keys = list(pairs)
        entity = pa.array([None, *(k[0] for k in keys)], pa.int64())
        yield pa.RecordBatch.from_arrays([entity, pa.array([0, *(k[1] for k in keys)], pa.int64()), pa.array([batch.num_rows, *pairs.values()], pa.int64())], ["entity", "term", "n"])

    return map_batches(docs.select("text"), f, "entity long, term long, n long")


def _bitmap(terms: DataFrame) -> np.ndarray:
    """BITMAP_BITS of the terms' hashes: a word whose bit is not set is no term."""
    place = F.shiftrightunsigned("term", 64 - BITMAP_BITS)
    words = terms.select(F.shiftright(place, 6).alias("w"), F.expr(f"shiftleft(1L, cast(shiftrightunsigned(term, {64 - BITMAP_BITS}) & 63 as int))").alias("bit"))
    got = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy()
    return out.view(np.uint64)


def _maybe(h: np.ndarray, bitmap: np.ndarray) -> np.ndarray:
    at = h.view(np.uint64) >> np.uint64(64 - BITMAP_BITS)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def term_counts(docs: DataFrame, terms: np.ndarray | None, bitmap: np.ndarray | None = None) -> DataFrame:
    """(term, n): the number of documents that have a term; of the given sorted terms, or of all words in the bitmap."""

    def f(batch):
        parts = []
        for _, _, b, o in chunks(*text_buffer(batch.column("text"))):
            w = Words(b, o)
            doc = np.repeat(np.arange(len(o) - 1, dtype=np.int64), np.diff(w.at))
            h = w.hash.view(np.int64)
            if terms is not None:
                if not len(terms):
                    continue
                at = np.searchsorted(terms, h)
                at[at == len(terms)] = 0
                hit = terms[at] == h
            else:
                hit = _maybe(h, bitmap)
            h, doc = h[hit], doc[hit]
            order = np.lexsort((doc, h))
            h, doc = h[order], doc[order]
            if len(h):
                first = np.concatenate(([True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])))
                parts.append(h[first])
        if parts:
            t, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], ["term", "n"])

    return map_batches(docs.select("text"), f, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _chance(n_et, n_e, n, total: float):
    """ln of a bound on the chance that n_et or more of an entity's n_e documents hold a term of n: Hoeffding's, by relative entropy."""
    a, p = n_et / n_e, n / F.lit(total)
    return -n_e * (a * F.ln(a / p) + F.when((a < 1) & (p < 1), (1 - a) * F.ln((1 - a) / (1 - p))).otherwise(0.0))


def disclosing_terms(docs: DataFrame, alpha: float = 0.05, bits: float = 1.0, removed_bits: float = 0.6) -> DataFrame:
    """(term, removed): terms that reveal an entity, by co-occurrence over the whole corpus.

    In documents, PMI(entity; term) = log2(N n(e,t) / (n(e) n(t))), and log2(N / n(e)) is the entity's own
    information; the difference, -log2 P(e|t), is what a reader of the term still lacks.  P is shrunk by
    one document more that has the term without the entity, n(e,t) / (n(t) + 1), so a few common documents
    reveal less than many.  A term discloses an entity if no more than ``bits`` are lacking, and if so many
    common documents would come by chance with ``alpha`` at most, over all terms of the entity together.
    Entities of one document count too.  removed: ``removed_bits`` at most are lacking, so a more
    general word would not do.
    """
    found = written(contexts(docs).groupBy("entity", "term").agg(F.sum("n").alias("n")))
    total = float(found.where("entity is null").agg(F.sum("n")).first()[0] or 0)
    entities = found.where("entity is not null").groupBy("entity").agg(F.max(F.when(F.col("term") == 0, F.col("n"))).alias("n_e"), F.sum(F.when(F.col("term") != 0, 1).otherwise(0)).alias("n_terms"))
    likely = lambda n: F.ln("n_terms") + _chance(F.col("n_et"), F.col("n_e"), F.col(n), total) <= math.log(alpha)
    # a term has n_et documents at least: what may be chance with so few will not do
    both = written(found.where("entity is not null and term <> 0").withColumnRenamed("n", "n_et").join(entities, "entity").where((F.col("n_e") < total) & likely("n_et")).select("entity", "term", "n_et", "n_e", "n_terms"))
    candidates = both.select("term").distinct()
    if candidates.count() <= IN_MEMORY:
        counts = term_counts(docs, np.sort(candidates.toArrow().column("term").to_numpy()))
    else:
        counts = term_counts(docs, None, _bitmap(candidates)).join(candidates, "term", "left_semi")
    lacking = -F.log2(F.col("n_et") / (F.col("n") + 1))
    terms = written(both.join(counts, "term").withColumn("lacking", lacking).where((F.col("lacking") <= bits) & likely("n")).groupBy("term").agg((F.min("lacking") <= removed_bits).alias("removed")))
    release(found, both)
    return terms


def _listed(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


class Terms:
    """Terms that are looked up in memory: sorted hashes, and whether each is to be removed."""

    def __init__(self, rows: pa.Table):
        term = rows.column("term").to_numpy()
        order = np.argsort(term)
        self.term, self.removed = term[order], np.asarray(rows.column("removed"), bool)[order]

    def hits(self, b: np.ndarray, o: np.ndarray):
        """document -> (start, end, kind) of its words in a chunk that are terms."""
        out: dict[int, list] = {}
        if not len(self.term):
            return out
        w = Words(b, o)
        h = w.hash.view(np.int64)
        at = np.searchsorted(self.term, h)
        at[at == len(self.term)] = 0
        for j in np.flatnonzero(self.term[at] == h).tolist():
            out.setdefault(int(np.searchsorted(w.at, j, "right")) - 1, []).append((int(w.start[j]), int(w.end[j]), "removed" if self.removed[at[j]] else "term"))
        return out


def _text_key():
    return F.concat_ws(" ", F.xxhash64("text"), F.xxhash64(F.lit(1), "text"), F.length("text"))


def _found_terms(df: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, hits): by _text_key, (start, end, removed) of the terms in a text that has some, by a join on the words in the terms' bitmap."""
    bitmap = _bitmap(terms)

    def f(batch):
        keys = batch.column("key")
        for a, _, b, o in chunks(*text_buffer(batch.column("text"))):
            w = Words(b, o)
            h = w.hash.view(np.int64)
            j = np.flatnonzero(_maybe(h, bitmap))
            doc = np.searchsorted(w.at, j, "right") - 1 + a
            for i in range(0, len(j), 50_000):
                k = j[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(doc[i : i + 50_000])), pa.array(h[k]), pa.array(w.start[k]), pa.array(w.end[k])], ["key", "term", "start", "end"])

    words = map_batches(df.select("text", _text_key().alias("key")), f, "key string, term long, start long, end long")
    return words.join(terms, "term").groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end", "removed"))).alias("hits"))


def _span_batches(df: DataFrame, terms: DataFrame, f, schema) -> DataFrame:
    """f(batch, spans of each row) -> batch, for the spans of all kinds.

    Up to IN_MEMORY terms are looked up in the same pass.  Of more, what is found comes back to the texts by a join.
    """
    columns = df.columns
    joined = terms.count() > IN_MEMORY
    inside = Terms(terms.limit(0).toArrow() if joined else terms.toArrow())
    if joined:
        found = written(_found_terms(df, terms))
        rows = df.withColumn("__key", _text_key())
        df = rows.join(small(found, found.count()), rows["__key"] == found["key"], "left").select(*columns, F.col("hits").alias("__hits"))

    def g(batch):
        every: list[list] = [[] for _ in range(batch.num_rows)]
        for a, _, b, o in chunks(*text_buffer(batch.column("text"))):
            for i, text in _private_texts(b, o):
                every[a + i] = known_spans(text)
            for i, hits in inside.hits(b, o).items():
                every[a + i] = _without_overlaps(every[a + i], hits)
        if joined:
            for i, hits in enumerate(batch.column("__hits").to_pylist()):
                if hits:
                    every[i] = _without_overlaps(every[i], [(x["start"], x["end"], "removed" if x["removed"] else "term") for x in hits])
        yield f(batch.select(columns), [sorted(x, key=lambda s: (s[0], KINDS.index(s[2]))) for x in every])

    return map_batches(df, g, schema)


def private_spans(docs: DataFrame, **kw) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, n_secret, n_term, n_removed, base (its spans), spans (all spans).

    Spans are ``kind:start:end`` in code points, end exclusive, by start, then kind as in KINDS, joined
    by commas.  Base kinds are leftmost matches that pass their checks; added are codes of high
    information and terms that reveal an entity over the corpus, where they overlap no other span.
    Null and empty texts have no spans; repeated rows come back as often, and count as documents; other
    columns are ignored; an empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    terms = disclosing_terms(docs, **kw)

    def f(batch, spans):
        counts = [pa.array([sum(s[2] == k for s in x) for x in spans], pa.int64()) for k in KINDS]
        base = [_listed(s for s in x if s[2] in BASE) for x in spans]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(base, pa.string()), pa.array([_listed(x) for x in spans], pa.string())], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])

    return _span_batches(docs, terms, f, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")


def generalised(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with personal data as its kind in brackets, revealing terms as the shape of a word, name or number, or without them."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start < at:
            at = max(at, end)
            continue
        s = text[start:end]
        parts.append(text[at:start])
        if kind != "removed":
            shape = kind.upper() if kind != "term" else "NUMBER" if any(c.isdigit() for c in s) else "NAME" if s[:1].isupper() else "WORD"
            parts.append(f"[{shape}]")
        at = end
    return "".join(parts) + text[at:]


def sanitise(docs: DataFrame, **kw) -> DataFrame:
    """docs with personal data and revealing terms generalised or removed in ``text``; ``n_chars``, if there, is the new length.

    All rows and columns come back; a null text stays null; an empty table gives no rows; repeated rows count as documents.
    """
    terms = disclosing_terms(docs, **kw)

    def f(batch, spans):
        i = batch.schema.get_field_index("text")
        col = batch.column(i)
        texts = [generalised(x.as_py(), s) if s else None for x, s in zip(col, spans)]
        changed = pa.array([t is not None for t in texts])
        return batch.set_column(i, batch.schema.field(i), pc.if_else(changed, pa.array(texts, col.type), col))

    out = _span_batches(docs, terms, f, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = private_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans", "n_secret", "n_term", "n_removed", sum((F.col(f"n_{k}") for k in KINDS[1:5]), F.col("n_email")).alias("n_known"))
