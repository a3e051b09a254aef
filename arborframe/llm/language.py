"""Language identification by a bidirectional gated recurrent network over bytes, in numpy.

Two gated recurrent layers read windows of a text's bytes from both ends; every position gets a softmax over the
languages, and a text's probabilities are the mean over all its positions.  Training is backpropagation through
time with Adam on windows of a bounded sample (SAMPLE texts a language, by hash of the id, WINDOWS windows each).

Edge cases: a null text or one without a letter is `und`, score 0; null languages and ids are not learned from;
without anything to learn from every text is `und`; very long texts are read whole, window by window; repeated
rows are judged alike.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from arborframe.llm.common import remainder, table, texts

SAMPLE, WINDOWS, LENGTH = 120, 12, 48
HIDDEN, STEPS, BATCH, RATE = 8, 220, 128, 0.02
#: Bytes in a window at prediction, and windows that one step computes together.
SPAN, WIDE = 128, 4096
_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (_LETTER.search(text) is not None or any(c.isalpha() for c in text.decode("utf-8", "replace")))


def _sigmoid(x):
    np.multiply(x, 0.5, out=x)
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _step(x, h, u, k):
    """One gated step: x (n, 3k) holds the input's part, h (n, k) the state before."""
    hu = h @ u
    gates = _sigmoid(x[:, : 2 * k] + hu[:, : 2 * k])
    z, r = gates[:, :k], gates[:, k:]
    part = hu[:, 2 * k :]
    new = np.tanh(x[:, 2 * k :] + r * part)
    return new + z * (h - new), (h, z, r, part, new)


def train_network(windows: np.ndarray, labels: np.ndarray, classes: int, seed: int = 7) -> dict[str, np.ndarray]:
    """windows: (n, LENGTH) bytes; labels: (n,).  Backpropagation through time with Adam."""
    rng = np.random.default_rng(seed)
    k, t = HIDDEN, windows.shape[1]
    p = {f"e{d}": rng.normal(0, 0.3, (256, 3 * k)) for d in "fb"} | {f"u{d}": rng.normal(0, 0.3, (k, 3 * k)) for d in "fb"}
    p |= {"v": rng.normal(0, 0.3, (2 * k, classes)), "c": np.zeros(classes)}
    first, second = ({n: np.zeros_like(x) for n, x in p.items()} for _ in range(2))
    for step in range(1, STEPS + 1):
        pick = rng.integers(0, len(windows), BATCH)
        x, y = windows[pick], labels[pick]
        g = {n: np.zeros_like(a) for n, a in p.items()}
        states, kept = {}, {}
        for d, times in (("f", range(t)), ("b", range(t - 1, -1, -1))):
            h, states[d], kept[d] = np.zeros((BATCH, k)), np.empty((t, BATCH, k)), {}
            for i in times:
                h, kept[d][i] = _step(p[f"e{d}"][x[:, i]], h, p[f"u{d}"], k)
                states[d][i] = h
        both = np.concatenate((states["f"], states["b"]), axis=2)
        o = both @ p["v"] + p["c"]
        o = np.exp(o - o.max(axis=2, keepdims=True))
        o /= o.sum(axis=2, keepdims=True)
        o[:, np.arange(BATCH), y] -= 1
        o /= BATCH * t
        g["v"] = both.reshape(-1, 2 * k).T @ o.reshape(-1, classes)
        g["c"] = o.sum(axis=(0, 1))
        back = o @ p["v"].T
        for d, times, side in (("f", range(t - 1, -1, -1), slice(0, k)), ("b", range(t), slice(k, 2 * k))):
            dh = np.zeros((BATCH, k))
            for i in times:
                before, z, r, part, new = kept[d][i]
                dh = dh + back[i][:, side]
                dn = dh * (1 - z) * (1 - new * new)
                dz = dh * (before - new) * z * (1 - z)
                dr = dn * part * r * (1 - r)
                dx = np.concatenate((dz, dr, dn), axis=1)
                du = np.concatenate((dz, dr, dn * r), axis=1)
                np.add.at(g[f"e{d}"], x[:, i], dx)
                g[f"u{d}"] += before.T @ du
                dh = dh * z + du @ p[f"u{d}"].T
        norm = np.sqrt(sum(float((a * a).sum()) for a in g.values()))
        rate = RATE * min(1.0, 1.2 - step / STEPS) / max(1.0, norm)
        for n in p:
            first[n] = 0.9 * first[n] + 0.1 * g[n]
            second[n] = 0.99 * second[n] + 0.01 * g[n] ** 2
            p[n] -= rate * (first[n] / (1 - 0.9**step)) / (np.sqrt(second[n] / (1 - 0.99**step)) + 1e-8)
    return {n: a.astype(np.float32) for n, a in p.items()}


def _sums(net: dict, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per window of x (n, t; n in order of falling length), the sum of its positions' probabilities."""
    n, t = x.shape
    k, classes = HIDDEN, len(net["c"])
    x = np.ascontiguousarray(x.T)
    live = [int(np.searchsorted(-lengths, -i, "left")) for i in range(t)]  # windows longer than i
    h, forward = np.zeros((n, k), np.float32), []
    for i in range(t):
        m = live[i]
        if not m:
            break
        h, _ = _step(net["ef"][x[i, :m]], h[:m], net["uf"], k)
        forward.append(h)
    out, h = np.zeros((n, classes), np.float32), np.zeros((n, k), np.float32)
    for i in range(len(forward) - 1, -1, -1):
        m = live[i]
        now, _ = _step(net["eb"][x[i, :m]], h[:m], net["ub"], k)
        h[:m] = now
        o = forward[i] @ net["v"][:k]
        o += now @ net["v"][k:]
        o += net["c"]
        np.exp(np.clip(o, -40, 40, out=o), out=o)
        o /= o.sum(axis=1, keepdims=True)
        out[:m] += o
    return out


def probabilities(net: dict, bodies: list[bytes]) -> np.ndarray:
    """Mean over all positions of each text, in bounded steps."""
    out = np.zeros((len(bodies), len(net["c"])))
    owner = np.repeat(np.arange(len(bodies)), [-(-len(b) // SPAN) for b in bodies])
    data = np.frombuffer(b"".join(bodies), np.uint8)
    begins = np.concatenate([np.arange(0, len(b), SPAN) + at for b, at in zip(bodies, np.cumsum([0, *map(len, bodies)]))]) if len(owner) else np.zeros(0, np.int64)
    ends = np.minimum(begins + SPAN, np.cumsum(list(map(len, bodies)))[owner]) if len(owner) else begins
    data = np.concatenate((data, np.zeros(SPAN, np.uint8)))
    for at in range(0, len(owner), WIDE):
        b, n, o = begins[at : at + WIDE], (ends - begins)[at : at + WIDE], owner[at : at + WIDE]
        by = np.argsort(-n, kind="stable")
        np.add.at(out, o[by], _sums(net, data[b[by][:, None] + np.arange(SPAN)], n[by]))
    return out / np.maximum(1, [len(b) for b in bodies])[:, None]


def sampled(docs: DataFrame, train_rows=None, text: str = "text") -> list:
    """(language, window) rows of the bounded sample: at most SAMPLE texts a language, WINDOWS windows each."""
    known = docs.select("doc_id", "lang").where("doc_id is not null and lang is not null")
    if train_rows is not None:
        known = known.where(train_rows(F.col("doc_id")))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= SAMPLE).select(F.col("doc_id").alias("_id")).distinct()

    def run(batches):
        for batch in batches:
            langs, out = [], []
            for i, lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2))):
                if not has_letter(t):
                    continue
                rng = np.random.default_rng(i & (2**63 - 1))
                for at in rng.integers(0, max(1, len(t) - LENGTH + 1), WINDOWS).tolist():
                    langs.append(lang)
                    out.append((t[at : at + LENGTH] * (LENGTH // max(1, len(t[at : at + LENGTH])) + 1))[:LENGTH])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(out, pa.binary())], names=["lang", "window"])

    rows = docs.select("doc_id", "lang", F.col(text).alias("_t")).where("lang is not null").join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).select("doc_id", "lang", "_t")
    return rows.mapInArrow(run, "lang string, window binary").orderBy("lang", "window").collect()


def fit(docs: DataFrame, train_rows=None):
    rows = sampled(docs, train_rows)
    langs = sorted({r[0] for r in rows})
    if not langs:
        return langs, None
    windows = np.frombuffer(b"".join(bytes(r[1]) for r in rows), np.uint8).reshape(len(rows), LENGTH)
    # languages weigh alike however unlike their samples are
    by = [np.flatnonzero(np.array([r[0] for r in rows]) == x) for x in langs]
    most = max(map(len, by))
    pick = np.concatenate([np.resize(b, most) for b in by])
    return langs, train_network(windows[pick], np.repeat(np.arange(len(langs)), most), len(langs))


def predict(docs: DataFrame, model, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of every row with lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = [f"_k{i}" for i in range(len(keep))]
    kept = "".join(f"{k} {docs.schema[c].dataType.simpleString()}, " for c, k in zip(keep, columns))

    def run(batches):
        langs, net = shared.value
        for batch in batches:
            body, out, scores = batch.column(batch.num_columns - 1), [], []
            at = 0
            while at < batch.num_rows:
                some, size = [], 0
                for t in texts(body.slice(at, 256)):
                    some.append(t if net is not None and has_letter(t) else b"")
                    size += len(some[-1])
                    if size > 2_000_000:
                        break
                at += len(some)
                p = probabilities(net, some) if size else None
                for i, t in enumerate(some):
                    best = int(p[i].argmax()) if t else -1
                    out.append(langs[best] if t else "und")
                    scores.append(min(1.0, float(p[i][best])) if t else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.string()), pa.array(scores, pa.float64())], names=[*columns, "lang_pred", "score"])

    out = docs.select(*[docs[c].alias(k) for c, k in zip(keep, columns)], docs[text].alias("_text")).mapInArrow(run, kept + "lang_pred string, score double")
    return out.select(*[F.col(k).alias(c) for k, c in zip(columns, keep)], "lang_pred", "score")


def op9(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs, lambda i: remainder(i, 4) != 2)
    found = predict(docs, model, ["doc_id"])
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
