"""Operator 10: language identification by a bidirectional gated recurrent network over bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textkit import crc_remainder, give_back, row_hash, sample_keys, small_batches, text_buffer

#: Bytes of a text whose outputs one window gives, and the bytes on either side over which its states are run in.
WINDOW, EDGE = 192, 32
#: Windows that run side by side.
LANES = 1024
#: Bytes of a training excerpt.
EXCERPT = 64
UNKNOWN = "und"


def windows(buf: np.ndarray, off: np.ndarray, size: int = WINDOW, edge: int = EDGE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window x byte) matrix over all texts, each window's document and the bytes that it gives outputs for.

    A window is ``edge`` bytes before, ``size`` bytes and ``edge`` bytes after, of the same text; beyond a text's
    ends all bytes are 0.
    """
    length = np.diff(off)
    count = -(-length // size)
    doc = np.repeat(np.arange(len(length)), count)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    start = off[:-1][doc] + start * size
    used = np.minimum(size, off[1:][doc] - start)
    padded = np.concatenate((np.zeros(edge, np.uint8), buf, np.zeros(size + edge, np.uint8)))
    out = padded[start[:, None] + np.arange(size + 2 * edge)]
    if edge:
        first = np.flatnonzero(start - off[:-1][doc] < edge)
        out[first, :edge] *= np.arange(edge) >= edge - (start - off[:-1][doc])[first, None]
    left = off[1:][doc] - start + edge
    short = np.flatnonzero(left < size + 2 * edge)
    out[short] *= np.arange(size + 2 * edge) < left[short, None]
    return out, doc, used


def squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|): smooth, of slope 1 / (1 + |x|)^2, from -1 to 1."""
    return x / (1 + np.abs(x))


def slope(x: np.ndarray) -> np.ndarray:
    y = 1 + np.abs(x)
    return 1 / (y * y)


class BytesGru:
    """Two gated recurrent layers over bytes, one in each direction, and a softmax over languages at every byte.

    Gates are 1/2 + squash/2 and candidates squash, whose slopes are exact.  ``table`` is the input's
    part of the gates for each byte (bias included), ``u`` the state's part; rows are update, reset, candidate.
    """

    def __init__(self, languages: list[str], hidden: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.p = {
            "table": rng.normal(0, 0.6, (2, 3 * hidden, 256)).astype(np.float32),
            "u": rng.normal(0, 1.2 / np.sqrt(hidden), (2, 3 * hidden, hidden)).astype(np.float32),
            "out": rng.normal(0, 0.5, (2, len(languages), hidden)).astype(np.float32),
            "bias": np.zeros((len(languages), 1), np.float32),
        }

    def logits(self, x: np.ndarray) -> np.ndarray:
        """(byte, language, window) scores for a (window x byte) matrix."""
        h_size, p = self.hidden, self.p
        lanes, steps = x.shape
        xt = np.ascontiguousarray(x.T).astype(np.intp)
        states = np.empty((2, steps, h_size, lanes), np.float32)
        h = np.zeros((2, h_size, lanes), np.float32)
        a = np.empty((2, 3 * h_size, lanes), np.float32)
        g = np.empty((2, 3 * h_size, lanes), np.float32)
        for t in range(steps):
            np.take(p["table"][0], xt[t], axis=1, out=g[0], mode="clip")
            np.take(p["table"][1], xt[steps - 1 - t], axis=1, out=g[1], mode="clip")
            np.matmul(p["u"], h, out=a)
            zr = g[:, : 2 * h_size]
            zr += a[:, : 2 * h_size]
            w = np.abs(zr, out=a[:, : 2 * h_size])
            w += 1
            zr /= w
            zr += 1
            zr *= 0.5
            c = a[:, 2 * h_size :]
            c *= zr[:, h_size:]
            c += g[:, 2 * h_size :]
            w = np.abs(c, out=g[:, 2 * h_size :])
            w += 1
            c /= w
            c -= h
            c *= zr[:, :h_size]
            h += c
            states[0, t] = h[0]
            states[1, steps - 1 - t] = h[1]
        out = np.matmul(p["out"][0], states[0])
        out += np.matmul(p["out"][1], states[1])
        out += p["bias"]
        return out

    @staticmethod
    def softmax(logits: np.ndarray) -> np.ndarray:
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        return logits

    def gradients(self, x: np.ndarray, used: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and its gradients by backpropagation through time, every byte labelled with its text's language."""
        hs, p = self.hidden, self.p
        lanes, steps = x.shape
        mask = (np.arange(steps)[:, None] < used).astype(np.float32)
        total = max(1.0, float(mask.sum()))
        hist = [[], []]
        states = np.zeros((2, steps, hs, lanes), np.float32)
        for d in (0, 1):
            h = np.zeros((hs, lanes), np.float32)
            for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
                g, a = p["table"][d][:, x[:, t]], p["u"][d] @ h
                s = g[: 2 * hs] + a[: 2 * hs]
                zr = 0.5 + 0.5 * squash(s)
                z, r = zr[:hs], zr[hs:]
                q = g[2 * hs :] + r * a[2 * hs :]
                c = squash(q)
                hist[d].append((t, h, s, z, r, a[2 * hs :], q, c))
                h = h + z * (c - h)
                states[d, t] = h
        logits = np.matmul(p["out"][0], states[0]) + np.matmul(p["out"][1], states[1]) + p["bias"]
        prob = self.softmax(logits)
        lane = np.arange(lanes)
        loss = float(-(np.log(prob[:, y, lane] + 1e-9) * mask).sum() / total)
        delta = prob
        delta[:, y, lane] -= 1
        delta *= mask[:, None, :] / np.float32(total)
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["bias"] = delta.sum(axis=(0, 2), keepdims=True)[0]
        for d in (0, 1):
            grad["out"][d] = np.einsum("tkb,thb->kh", delta, states[d])
            back = np.matmul(p["out"][d].T, delta)
            dh = np.zeros((hs, lanes), np.float32)
            by_byte = np.zeros((256, 3 * hs), np.float32)
            for t, h, s, z, r, uh, q, c in reversed(hist[d]):
                dh += back[t]
                dq = dh * z * slope(q)
                ds = np.concatenate((dh * (c - h), dq * uh)) * slope(s) * np.float32(0.5)
                da = np.concatenate((ds, dq * r))
                grad["u"][d] += da @ h.T
                np.add.at(by_byte, x[:, t], np.concatenate((ds, dq)).T)
                dh = dh * (1 - z) + p["u"][d].T @ da
            grad["table"][d] = by_byte.T
        return loss, grad

    def fit(self, x: np.ndarray, used: np.ndarray, y: np.ndarray, steps: int = 240, batch: int = 192, rate: float = 0.02, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(w) for k, w in self.p.items()} for _ in range(2))
        for i in range(1, steps + 1):
            pick = rng.integers(0, len(y), batch)
            _, grad = self.gradients(x[pick], used[pick], y[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
            step = rate * (1 - (i - 1) / steps) + 1e-4
            for k, g in grad.items():
                g = g * min(1.0, 1.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                self.p[k] = (self.p[k] - step * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)

    def pooled(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(text x language) mean of the probabilities at all bytes; 0 for an empty text."""
        out = np.zeros((len(off) - 1, len(self.languages)))
        lo = 0
        while lo < len(off) - 1:
            hi = max(lo + 1, int(np.searchsorted(off, off[lo] + (1 << 20), side="right")) - 1)
            x, doc, used = windows(buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            for i in range(0, len(x), LANES):
                prob = self.softmax(self.logits(x[i : i + LANES])[EDGE : EDGE + WINDOW])
                u = used[i : i + LANES]
                total = prob.sum(axis=0)
                for j in np.flatnonzero(u < WINDOW).tolist():
                    total[:, j] = prob[: u[j], :, j].sum(axis=0)
                for k in range(len(self.languages)):
                    out[lo:hi, k] += np.bincount(doc[i : i + LANES], total[k], hi - lo)
            lo = hi
        return out / np.maximum(1, np.diff(off))[:, None]


def fit_language_model(labelled: DataFrame, per_language: int = 1500, excerpts: int = 3, **fit) -> BytesGru | None:
    """A model from (doc_id, text, lang) rows, or None where no row has a language and text.

    The sample is bounded: of each language ``per_language`` documents at most, those of the least hash of
    id and text (repeated rows count once), and ``excerpts`` excerpts of EXCERPT characters from hashed places of each.
    """
    rows = labelled.where("lang is not null and length(text) > 0").select("doc_id", "text", "lang")
    chosen = sample_keys(rows, per_language, "lang")
    rows = rows.withColumn("__h", row_hash()).join(F.broadcast(chosen), ["__h", "lang"])
    place = [F.expr(f"substring(text, 1 + cast(pmod(xxhash64(__h, {i}), greatest(1, length(text) - {EXCERPT})) as int), {EXCERPT})") for i in range(excerpts)]
    sample = rows.select("__h", "lang", F.posexplode(F.array(*place)).alias("i", "part")).distinct().collect()
    sample = sorted((r["__h"], r["i"], r["lang"], r["part"]) for r in sample)
    if not sample:
        return None
    languages = sorted({s[2] for s in sample})
    buf, off = text_buffer(pa.array([s[3].encode()[:EXCERPT].decode(errors="ignore") for s in sample]))
    x, doc, used = windows(buf, off, EXCERPT, 0)
    y = np.array([languages.index(s[2]) for s in sample])[doc]
    model = BytesGru(languages)
    weight = np.array([1 / (y == k).sum() if (y == k).any() else 0 for k in range(len(languages))])[y]
    pick = np.random.default_rng(3).choice(len(y), size=len(y), p=weight / weight.sum())
    model.fit(x[pick], used[pick], y[pick], **fit)
    return model


def predict_language(docs: DataFrame, model: BytesGru | None, lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with the predicted language and its pooled probability; ``und`` and 0 for a text that is null or has no letter.

    All rows and columns come back, but for columns of the two new names, which are replaced; without a
    model every document is ``und``; an empty table gives no rows.
    """
    docs = docs.drop(lang_col, score_col)
    fields = docs.schema.fields
    schema = T.StructType([*fields, T.StructField(lang_col, T.StringType()), T.StructField(score_col, T.DoubleType())])
    at = docs.columns.index("text")
    # the last column says whether the text has a letter, whatever the others are called
    docs = docs.select("*", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))

    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            letters = batch.column(len(fields)).to_numpy(zero_copy_only=False)
            if model is None:
                lang, score = np.full(batch.num_rows, UNKNOWN, object), np.zeros(batch.num_rows)
            else:
                prob = model.pooled(*text_buffer(batch.column(at)))
                best = prob.argmax(axis=1)
                lang = np.where(letters, np.array(model.languages, object)[best], UNKNOWN)
                score = np.where(letters, np.clip(prob[np.arange(len(best)), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(fields))), pa.array(lang, pa.string()), pa.array(score)], schema.names)
        give_back()

    return small_batches(docs).mapInArrow(run, schema)


def language_id(docs: DataFrame, held_out: int = 2, folds: int = 4) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score.

    The model learns from rows with a language whose crc32(doc_id) modulo ``folds`` is not ``held_out``,
    and is applied to whole texts.  Null and empty texts and those without a letter are ``und`` with score 0;
    repeated rows and null ids come back as often; other columns, whatever their names, are ignored; an empty
    table gives no rows, and without any language every document is ``und``.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), (crc_remainder("doc_id", folds) == held_out).alias("held_out"))
    model = fit_language_model(rows.where("not held_out"))
    return predict_language(rows.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(spark.read.parquet(f"{sf_dir}/documents.parquet"))
