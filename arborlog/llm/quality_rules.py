"""Operator 5: quality rules with thresholds from mergeable quantile sketches per language and source."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkit import chunks, code_point_offsets, map_batches, per_document, shingle_hashes, text_buffer, word_hashes, word_spans, written

SYMBOLS = "[#*$%&|<>]"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
#: Buckets of the sketch grow by this factor: quantiles are right within half a percent.
GAMMA = 1.01
#: Feature -> (part, whole, guard: the limit of a group in which the feature is as good as never above 0).
FEATURES = {
    "symbol_rate": ("n_symbols", "n_words", 0.01),
    "dup_line_rate": ("n_dup_lines", "n_lines", 0.01),
    "repeat_rate": ("n_repeat_words", "n_words", 0.01),
    "word_length": ("word_chars", "n_words", 0.0),
}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def repeated_words(words: np.ndarray, at: np.ndarray, width: int = 8) -> np.ndarray:
    """Per document, its words inside windows of ``width`` words that its text holds twice at least."""
    hashes = shingle_hashes(words, width)
    mark = np.zeros(len(words) + 1, np.int64)
    for i, j in zip(at[:-1].tolist(), at[1:].tolist()):
        if j - i <= width:
            continue
        h = hashes[i : j - width + 1]
        order = np.argsort(h, kind="stable")
        s = h[order]
        same = s[1:] == s[:-1]
        if not same.any():
            continue
        twice = np.zeros(len(h), bool)
        twice[1:] = same
        twice[:-1] |= same
        starts = order[twice] + i
        np.add.at(mark, starts, 1)
        np.add.at(mark, starts + width, -1)
    return per_document((np.cumsum(mark[:-1]) > 0).astype(np.int64), at)


def line_counts(text: bytes) -> tuple[int, int]:
    """Lines with a word, and those of them that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and x.strip(b"\t\n\x0b\x0c\r ")]
    return len(lines), len(lines) - len(set(lines))


def text_counts(texts: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS of each text; all 0 for a null or empty one."""
    buf, off = text_buffer(texts)
    parts: dict[str, list] = {c: [] for c in COUNTS}
    for _, _, b, o in chunks(buf, off):
        starts, ends, at = word_spans(b, o)
        words = word_hashes(b, starts, ends)
        points = code_point_offsets(b)
        parts["n_words"].append(np.diff(at))
        parts["word_chars"].append(per_document(points[ends] - points[starts], at))
        parts["n_symbols"].append(per_document(_IS_SYMBOL[b], o))
        parts["n_repeat_words"].append(repeated_words(words, at))
        raw = b.tobytes()
        lines = np.array([line_counts(raw[i:j]) for i, j in zip(o[:-1].tolist(), o[1:].tolist())], np.int64).reshape(-1, 2)
        parts["n_lines"].append(lines[:, 0])
        parts["n_dup_lines"].append(lines[:, 1])
    return {c: np.concatenate(p).astype(np.int64) if p else np.empty(0, np.int64) for c, p in parts.items()}


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and COUNTS of every document."""

    def f(batch):
        counts = text_counts(batch.column("text"))
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "lang", "source")] + [pa.array(counts[c]) for c in COUNTS], ["doc_id", "lang", "source", *COUNTS])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return map_batches(docs, f, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


def _rate(name: str):
    part, whole, _ = FEATURES[name]
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, feature, bucket, c): log-bucket quantile sketches, which merge by adding counts."""
    pairs = counts.select("lang", "source", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), _rate(f).alias("x")) for f in FEATURES))).alias("p"))
    bucket = F.when(F.col("p.x") <= 1e-4, F.lit(0)).otherwise(F.ceil(F.log(F.col("p.x") / 1e-4) / float(np.log(GAMMA))))
    return pairs.select("lang", "source", F.col("p.feature").alias("feature"), bucket.cast("int").alias("bucket")).groupBy("lang", "source", "feature", "bucket").agg(F.count("*").alias("c"))


def _quantile(q: float):
    return f"cast(element_at(filter(h, x -> x.upto >= {q} * total), 1).bucket as int)"


def _quantile_above_zero(q: float):
    return f"cast(get(filter(h, x -> x.bucket > 0 and x.upto - zeros >= {q} * (total - zeros)), 0).bucket as int)"


def thresholds(sketch: DataFrame, prior: float = 200.0, fences: float = 3.0) -> DataFrame:
    """(lang, source, max and min of each feature): the quartiles plus and minus ``fences`` interquartile ranges.

    The range counts as one bucket at least, as the sketch sees no less.  Where the upper quartile is 0, so
    that most documents have none of the feature, the maximum is the median of those that have some.  Only a limit below the guard is raised to it.  The minimum is that of the lower fence, 0 for rates.

    Limits of a group of n documents are shrunk toward its language's with the weight of ``prior`` documents,
    (n own + prior language) / (n + prior), and a language's in the same way toward the whole corpus's: the
    sketches of larger groups are sums of the small ones' buckets.
    """
    rolled = sketch.groupBy("feature", "lang", "source", "bucket").agg(F.sum("c").alias("c"))
    by_lang = rolled.groupBy("feature", "lang", "bucket").agg(F.sum("c").alias("c"))
    by_all = by_lang.groupBy("feature", "bucket").agg(F.sum("c").alias("c"))

    def limits(level: DataFrame, keys: list[str], name: str) -> DataFrame:
        hist = level.groupBy("feature", *keys).agg(F.sort_array(F.collect_list(F.struct("bucket", "c"))).alias("b"), F.sum("c").alias("total"), F.sum(F.when(F.col("bucket") == 0, F.col("c")).otherwise(0)).alias("zeros"))
        summed = "transform(sequence(1, size(b)), i -> named_struct('bucket', b[i - 1].bucket, 'upto', aggregate(slice(b, 1, i), 0L, (s, x) -> s + x.c)))"
        hist = hist.withColumn("h", F.expr(summed))
        value = lambda bucket: F.when(F.coalesce(F.expr(bucket), F.lit(0)) == 0, F.lit(0.0)).otherwise((1 + 1e-9) * 1e-4 * F.pow(F.lit(GAMMA), F.expr(bucket)))
        guard = F.create_map(*(x for f, (_, _, low) in FEATURES.items() for x in (F.lit(f), F.lit(low))))[F.col("feature")]
        low, high = value(_quantile(0.25)), value(_quantile(0.75))
        fence = fences * F.greatest(high - low, (GAMMA - 1) * high)
        most = F.greatest(guard, F.when(high > 0, high + fence).otherwise(value(_quantile_above_zero(0.5))))
        return hist.select("feature", *keys, F.col("total").alias(f"n_{name}"), most.alias(f"max_{name}"), F.greatest(F.lit(0.0), low - fence).alias(f"min_{name}"))

    own, lang, every = limits(rolled, ["lang", "source"], "own"), limits(by_lang, ["lang"], "lang"), limits(by_all, [], "all")
    joined = own.alias("o").join(lang.alias("l"), (F.col("o.feature") == F.col("l.feature")) & F.col("o.lang").eqNullSafe(F.col("l.lang"))).join(every.alias("e"), F.col("o.feature") == F.col("e.feature"))

    def shrunk(end: str):
        of_lang = (F.col("n_lang") * F.col(f"{end}_lang") + prior * F.col(f"{end}_all")) / (F.col("n_lang") + prior)
        return (F.col("n_own") * F.col(f"{end}_own") + prior * of_lang) / (F.col("n_own") + prior)

    flat = joined.select("o.lang", "o.source", F.col("o.feature").alias("feature"), shrunk("max").alias("most"), shrunk("min").alias("least"))
    return flat.groupBy("lang", "source").agg(*(F.max(F.when(F.col("feature") == f, F.col(c))).alias(f"{end}_{f}") for f in FEATURES for end, c in (("max", "most"), ("min", "least"))))


def quality_rules(docs: DataFrame, prior: float = 200.0, fences: float = 3.0) -> DataFrame:
    """Per document: doc_id, COUNTS, base_failed, kept, and failed (the rules that it breaks).

    base_failed: fewer than 20 words, or over 30 % of the words in repeated 8-word windows.  kept: not
    base_failed and no feature above (``failed`` names it) or below (``low_`` and its name) the adaptive
    limits of its language and source.

    Null and empty texts have 0 everywhere and fail the base; a null language or source is a group of
    its own; repeated rows come back as often; other columns are ignored; an empty table gives no rows.
    Sketches are summed before they are shuffled, so a source with a third of all rows is a few hundred
    buckets from each task.
    """
    counts = written(measured(docs))
    ends = [f"{end}_{f}" for f in FEATURES for end in ("max", "min")]
    limits = thresholds(sketches(counts), prior, fences).select(F.col("lang").alias("l"), F.col("source").alias("s"), *ends)
    joined = counts.join(limits, F.col("lang").eqNullSafe(F.col("l")) & F.col("source").eqNullSafe(F.col("s")), "left")
    rules = [F.when(_rate(f) > F.col(f"max_{f}"), F.lit(f)) for f in FEATURES] + [F.when(_rate(f) < F.col(f"min_{f}"), F.lit(f"low_{f}")) for f in FEATURES]
    failed = F.filter(F.array(*rules), lambda x: x.isNotNull())
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return joined.select("doc_id", *COUNTS, base.alias("base_failed"), failed.alias("failed")).withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
