"""Operator 8: quality classifier, a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import text_counts
from .textkit import LOWER, chunks, crc_remainder, map_batches, per_document, row_hash, sample_keys, text_buffer, word_hashes, word_spans

#: log2 of the number of word features, and the bins of each structure statistic.
WORD_BITS, BINS = 14, 12
STATISTICS = ("words", "word_length", "symbols", "dup_lines", "repeats", "line_words", "capitals", "digits", "marks", "distinct", "short", "bytes")
N_WORDS = 1 << WORD_BITS
N_FEATURES = N_WORDS + BINS * len(STATISTICS)


def _byte_set(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CAPITAL, _DIGIT, _MARK = (_byte_set(bytes(range(65, 91))), _byte_set(b"0123456789"), _byte_set(b"!?.,;:\"'()-"))


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, value, offsets by document): hashed distinct words of weight 1/sqrt(their number), and one bin of each statistic."""
    counts = text_counts(texts)
    buf, off = text_buffer(texts)
    word_feature, word_doc, n_distinct, extra = [], [], [], []
    for a, _, b, o in chunks(buf, off):
        starts, ends, at = word_spans(b, o)
        bucket = word_hashes(LOWER[b], starts, ends) >> np.uint64(64 - WORD_BITS)
        doc = np.repeat(np.arange(len(o) - 1), np.diff(at)).astype(np.uint64)
        key = np.unique((doc << np.uint64(WORD_BITS)) | bucket)
        word_feature.append((key & np.uint64(N_WORDS - 1)).astype(np.int64))
        word_doc.append((key >> np.uint64(WORD_BITS)).astype(np.int64) + a)
        n_distinct.append(np.bincount(word_doc[-1] - a, minlength=len(o) - 1))
        short = per_document(ends - starts <= 3, at)
        extra.append(np.stack([per_document(s[b], o) for s in (_CAPITAL, _DIGIT, _MARK)] + [short], axis=1))
    n = len(off) - 1
    distinct = np.concatenate(n_distinct) if n else np.empty(0, np.int64)
    capitals, digits, marks, short = (np.concatenate(extra) if n else np.empty((0, 4), np.int64)).T
    words, chars = np.maximum(1, counts["n_words"]), np.maximum(1, counts["word_chars"])
    lines = np.maximum(1, counts["n_lines"])
    values = (
        np.log2(1 + counts["n_words"]) / 1.5,
        chars / words,
        8 * counts["n_symbols"] / chars,
        BINS * counts["n_dup_lines"] / lines,
        BINS * counts["n_repeat_words"] / words,
        np.log2(1 + words / lines) * 1.5,
        BINS * capitals / chars,
        4 * BINS * digits / chars,
        2 * BINS * marks / chars,
        BINS * distinct / words,
        BINS * short / words,
        np.log2(1 + np.diff(off)) / 1.8,
    )
    bins = np.stack([np.clip(v, 0, BINS - 1).astype(np.int64) for v in values], axis=1) + N_WORDS + BINS * np.arange(len(STATISTICS))
    doc = np.concatenate([*word_doc, np.repeat(np.arange(n), len(STATISTICS))])
    feature = np.concatenate([*word_feature, bins.ravel()])
    value = np.concatenate([1 / np.sqrt(np.maximum(1, distinct))[d] for d in word_doc] + [np.ones(n * len(STATISTICS))])
    order = np.argsort(doc, kind="stable")
    return feature[order], value[order], np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=n))))


class FactorisationMachine:
    """w0 + sum w x + 1/2 sum_f ((sum v x)^2 - sum v^2 x^2), in time linear in a document's features."""

    def __init__(self, rank: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.bias, self.w, self.v = 0.0, np.zeros(N_FEATURES), rng.normal(0, 0.05, (N_FEATURES, rank))

    def _sums(self, feature, value, off):
        vx = self.v[feature] * value[:, None]
        first = np.add.reduceat(vx, off[:-1]) if len(off) > 1 else np.zeros((0, self.v.shape[1]))
        second = np.add.reduceat(vx * vx, off[:-1]) if len(off) > 1 else first
        linear = np.add.reduceat(self.w[feature] * value, off[:-1]) if len(off) > 1 else np.zeros(0)
        return first, self.bias + linear + 0.5 * (first * first - second).sum(axis=1)

    def score(self, feature, value, off) -> np.ndarray:
        """Probability of label 1; every document has its statistics' features, so none is empty."""
        return 1 / (1 + np.exp(-np.clip(self._sums(feature, value, off)[1], -30, 30)))

    def fit(self, feature, value, off, y, epochs: int = 12, batch: int = 256, rate: float = 0.05, decay: float = 1e-5, seed: int = 9) -> None:
        """Logistic loss by AdaGrad over shuffled batches."""
        rng = np.random.default_rng(seed)
        prior = np.clip(y.mean(), 0.01, 0.99)
        self.bias = float(np.log(prior / (1 - prior)))
        gw, gv, gb = np.full(self.w.shape, 1e-4), np.full(self.v.shape, 1e-4), 1e-4
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                pick = order[i : i + batch]
                size = (off[1:] - off[:-1])[pick]
                o = np.concatenate(([0], np.cumsum(size)))
                at = np.repeat(off[:-1][pick] - o[:-1], size) + np.arange(o[-1])
                f, x = feature[at], value[at]
                first, z = self._sums(f, x, o)
                err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
                e = np.repeat(err, size) * x
                dw = np.zeros_like(self.w)
                np.add.at(dw, f, e)
                dv = np.zeros_like(self.v)
                np.add.at(dv, f, e[:, None] * (np.repeat(first, size, axis=0) - self.v[f] * x[:, None]))
                dw += decay * self.w
                dv += decay * self.v
                gw += dw * dw
                gv += dv * dv
                gb += err.sum() ** 2
                self.w -= rate * dw / np.sqrt(gw)
                self.v -= rate * dv / np.sqrt(gv)
                self.bias -= rate * err.sum() / np.sqrt(gb)


def fit_quality_model(docs: DataFrame, labels: DataFrame, sample: int = 8000, **fit) -> FactorisationMachine:
    """A model from documents (doc_id, text) and labels (doc_id, quality); without labels it scores by its prior.

    It learns from ``sample`` labelled documents at most, those of the least hash of id and text; of those
    alone the features come to the driver.  A document with several labels counts by their mean; repeated
    rows count once; rows without an id have no label.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    rows = docs.select("doc_id", "text").join(known, "doc_id")
    chosen = sample_keys(rows, sample)
    rows = rows.withColumn("__h", row_hash()).join(F.broadcast(chosen), "__h").select("doc_id", "text", "y", "__h")

    def f(batch):
        feature, value, off = features(batch.column("text"))
        lists = [pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(x)) for x in (feature.astype(np.int32), value.astype(np.float32))]
        yield pa.RecordBatch.from_arrays([batch.column("__h"), batch.column("y"), *lists], ["h", "y", "f", "x"])

    got = map_batches(rows, f, "h long, y int, f array<int>, x array<float>").dropDuplicates(["h"]).toArrow().sort_by("h")
    model = FactorisationMachine()
    if got.num_rows:
        off = np.concatenate(([0], np.cumsum([len(x) for x in got.column("f")])))
        feature, value = (np.asarray(got.column(c).combine_chunks().flatten()) for c in ("f", "x"))
        model.fit(feature.astype(np.int64), value.astype(np.float64), off, np.asarray(got.column("y")).astype(np.float64), **fit)
    return model


def quality_classifier(docs: DataFrame, labels: DataFrame, held_out: int = 0, folds: int = 5, at_least: float = 0.3) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= at_least).

    Labels are learnt from rows whose crc32(doc_id) modulo ``folds`` is not ``held_out``.  Inputs of a
    score are the whole text's words, its structure and its length alone.  Null and empty texts are scored
    by their (empty) statistics; repeated rows and null ids come back as often; without labels every score is
    the prior's; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", crc_remainder("doc_id", folds) == held_out)
    model = fit_quality_model(rows.where("not held_out"), labels.where(crc_remainder("doc_id", folds) != held_out))

    def f(batch):
        for a in range(0, batch.num_rows, 2000):
            part = batch.slice(a, 2000)
            score = model.score(*features(part.column("text")))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score), pa.array((score >= at_least).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return map_batches(rows, f, "doc_id long, held_out boolean, score double, predicted int")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
