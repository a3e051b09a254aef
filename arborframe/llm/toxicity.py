"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, their stems (four leading bytes), its pairs of
neighbours and its pairs with one or two words between.  Training reads a bounded sample of labelled rows (`sample`, by hash of the id); the L1 term
leaves few weights, and only those are broadcast.

Edge cases: a null or wordless text has no features and gets the intercept's score; null labels and ids are
not learned from; several labels of one id count as toxic if one of them is; with no labelled rows every
score is just under 0.5 (predicted 0); repeated rows are scored alike.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from arborframe.llm.common import anonymous, remainder, settle_memory, table, texts
from arborframe.llm.decontaminate import words

BITS = 22
#: Labelled rows that training may read.
SAMPLE = 8_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
#: Sampled texts that a feature must be in to be learned.
LEAST = 3
STEM = 4
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class _Hashes(dict):
    """64-bit hashes of words; emptied when it has grown, so a worker's memory stays bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        x = self[word] = xxhash.xxh64_intdigest(word)
        return x


def features(text: bytes, hashes: dict) -> np.ndarray:
    """Hashed features in order of place, with repeats."""
    w = words(text)
    h = np.fromiter(map(hashes.__getitem__, w), np.uint64, len(w))
    stems = np.fromiter((hashes[b"^" + x[:STEM]] for x in w), np.uint64, len(w))
    out = [h * _MIX[0], stems * _MIX[0]]
    for gap in (1, 2, 3):
        if len(h) > gap:
            out.append((h[:-gap] * _MIX[0] + h[gap:] * _MIX[1] + np.uint64(gap)) * _MIX[0])
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int64)


def fit(rows, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """FTRL-proximal over (text, label) rows: indexes and values of the weights that L1 leaves, intercept."""
    z0 = n0 = w0 = 0.0
    hashes = _Hashes()
    # the features of all sampled texts as compact integer arrays, then as places among those that are learned
    data = [(np.unique(features(t, hashes)).astype(np.int32), float(y)) for t, y in rows]
    del hashes
    count = np.zeros(1 << BITS, np.int32)
    for i, _ in data:
        count[i] += 1
    learned = np.flatnonzero(count >= LEAST)
    for j, (i, y) in enumerate(data):
        data[j] = (np.searchsorted(learned, i[count[i] >= LEAST]).astype(np.int32), y)
    del count
    z, n = np.zeros(len(learned)), np.zeros(len(learned))
    for _ in range(epochs):
        for i, y in data:
            zi, ni = z[i], n[i]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + root) / ALPHA + L2))
            w0 = -z0 / ((BETA + math.sqrt(n0)) / ALPHA + L2)
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, w0 + float(w.sum())))))
            g = p - y
            sigma = (np.sqrt(ni + g * g) - root) / ALPHA
            z[i] = zi + g - sigma * w
            n[i] = ni + g * g
            s0 = (math.sqrt(n0 + g * g) - math.sqrt(n0)) / ALPHA
            z0, n0 = z0 + g - s0 * w0, n0 + g * g
    k = np.flatnonzero(np.abs(z) > L1)
    return learned[k].astype(np.int64), (np.sign(z[k]) * L1 - z[k]) / ((BETA + np.sqrt(n[k])) / ALPHA + L2), -z0 / ((BETA + math.sqrt(n0)) / ALPHA + L2) if data else -1e-6


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, train_rows=None):
    """Fits on at most about `sample` labelled rows of docs whose id passes `train_rows` (a Column function)."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_y")).where("_id is not null and _y is not null")
    if train_rows is not None:
        known = known.where(train_rows(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y"))
    total = known.count()
    place = F.pmod(F.xxhash64("_id"), F.lit(1 << 32))
    if total > sample:
        known = known.where(place < int((1 << 32) * sample / total))
    picked = known.limit(sample + sample // 10)  # the hash leaves about `sample` rows: the proof of the bound
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").cast("binary").alias("_t")).join(F.broadcast(picked), "_id")
    found = sorted(((r[0], bytes(r[1] or b""), r[2]) for r in rows.select("_id", "_t", "_y").toLocalIterator(prefetchPartitions=True)), key=lambda r: (xxhash.xxh64_intdigest(str(r[0]).encode()), r[1]))
    return fit((t, 1 if y else 0) for _, t, y in found)


def scores(docs: DataFrame, model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of every row with its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [f"_k{i}" for i in range(len(keep))]
    kept = "".join(f"{k} {docs.schema[c].dataType.simpleString()}, " for c, k in zip(keep, columns))

    def run(batches):
        index, value, base = shared.value
        weight = np.zeros(1 << BITS, np.float32)
        weight[index] = value
        hashes = _Hashes()
        for batch in batches:
            out = np.full(batch.num_rows, base)
            body = batch.column(batch.num_columns - 1)
            for at in range(0, batch.num_rows, 256):
                for i, t in enumerate(texts(body.slice(at, 256)), at):
                    if t:
                        f = features(t, hashes)
                        f = np.unique(f[weight[f] != 0])
                        out[i] = base + float(weight[f].sum(dtype=np.float64))
            out = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out)], names=[*columns, "score"])
        settle_memory()

    out = docs.select(*[docs[c].alias(k) for c, k in zip(keep, columns)], docs[text].alias("_text")).mapInArrow(run, kept + "score double")
    return out.select(*[F.col(k).alias(c) for k, c in zip(columns, keep)], "score")


def _train_rows(doc_id):
    return remainder(doc_id, 5) != 0


def op10(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"), train_rows=_train_rows)
    found = scores(docs, model, ["doc_id"])
    return found.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents predicted toxic go; the rest keep all their columns, whatever their names.

    Rows of null or empty text stay (the intercept's score is under 0.5), null ids are scored like others, repeated
    rows stay or go together, and an empty table gives an empty result.
    """
    model = train(docs, table(spark, sf_dir, "labels"), train_rows=_train_rows)
    body, names = anonymous(docs)
    found = scores(body, model, body.columns, text=names["text"])
    return found.where("score < 0.5").drop("score").toDF(*docs.columns)
