r"""Language-model scoring by a probabilistic suffix tree over bytes.

A text is its A-Z-lowered words joined by single spaces and closed by one newline, so that a text's probability
is that of its tokens (the words, then one end).  Training counts every context of up to DEPTH bytes with the byte
after it over all training texts.  A context seen LEAST times or more is retained if its next-byte distribution
diverges enough from its suffix's, which must be retained too; nothing else bounds the model, so it grows with the
corpus.  Distributions are smoothed by absolute discounting with the suffix's; a byte is scored by its longest
retained suffix.

Only contexts of up to SHALLOW bytes (bounded by the bytes there are) are broadcast, with a bitmap of fixed size that
tells which deeper ones may be retained.  The deeper ones are decided on where they are counted and stay there, in
buckets of their three nearest bytes: a block of texts sends its distinct (longest maybe retained context, next byte)
keys to the buckets, gets their log probabilities back, and applies them to its own positions.

The unigram base needs each word's training count beside each text.  Words travel in blocks, too: a block of texts
sends its distinct words with their counts, gets the corpus counts back, and applies them to its own words, so
a word of any frequency is one entry a block.

Edge cases: a null or wordless text is one end token; null ids are training rows if crc32 of the empty text says
so; without training rows c, N and V are 0, every byte is alike likely and so is, for the base, every token;
repeated rows are scored alike and each count; very long texts are read whole; only named columns are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from arborframe.llm.common import SLICES, bucket_count, by_bucket, discard, joined, packed, remainder, settle_memory, stored, table, texts, unpacked
from arborframe.llm.words import SEEDS, hashes, inverse, spans

DEPTH, SHALLOW, LEAST = 6, 2, 5
#: Nats that retaining a context must gain, for each symbol seen after it, times the log of all positions.
DIVERGENCE = 0.1
#: What each symbol seen after a context gives up of its count, to be shared out as the suffix says.
DISCOUNT = 0.75
#: Bytes of text in a block, and bytes that are counted or scored at once.
BLOCK, PIECE = 6_000_000, 2_000_000
#: Bytes of input for each bucket, and the most bits of the bitmap of retained contexts (16 a context, up to so many).
BUCKET, FILTER = 2_000_000, 1 << 26
_PAD = b"\n" * DEPTH


def normal(text: bytes | None) -> tuple[list[bytes], bytes]:
    words = text.lower().split() if text else []
    return words, b" ".join(words) + b"\n"


def _blocks(batches, columns: int, most: int = BLOCK):
    """Batches regrouped as (rows of the columns before the last, texts) of about `most` bytes."""
    rows, size = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            kept = [part.column(i).to_pylist() for i in range(columns)]
            for i, t in enumerate(texts(part.column(columns))):
                rows.append((*[k[i] for k in kept], t))
                size += len(t or b"")
                if size >= most or len(rows) >= 60_000:
                    yield rows
                    rows, size = [], 0
    if rows:
        yield rows


def _pieces(bodies: list[bytes], most: int = PIECE):
    at = 0
    while at < len(bodies):
        end, size = at, 0
        while end < len(bodies) and size < most:
            size += len(bodies[end])
            end += 1
        yield bodies[at:end]
        at = end


def _reduced(keys: np.ndarray, counts: np.ndarray | None = None):
    """Distinct sorted keys and their summed counts."""
    if counts is None:
        keys = np.sort(keys)
    else:
        by = np.argsort(keys, kind="stable")
        keys, counts = keys[by], counts[by]
    cut = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    if counts is None:
        return keys[cut], np.diff(np.append(cut, len(keys)))
    return keys[cut], np.add.reduceat(counts, cut) if len(cut) else counts


def position_keys(bodies: list[bytes]) -> np.ndarray:
    """The (context, next byte) key of every position of normalized texts, nearest context byte highest."""
    data = b"\n\n" + _PAD + _PAD.join(bodies)
    # read backwards, the eight bytes after a byte are its context, nearest first
    back, n = data[::-1], len(data)
    context = np.ndarray((n - 7,), ">u8", back, strides=(1,))[1 : n - 7][::-1].astype(np.uint64)
    key = context & np.uint64(0xFFFFFFFFFFFF0000) | np.frombuffer(data, np.uint8)[8:]
    inside = np.ones(n, bool)
    begins = np.cumsum([8] + [len(t) + DEPTH for t in bodies[:-1]])[1:]
    for j in range(1, DEPTH + 1):
        inside[begins - j] = False
    return key[inside[8:]]


def grams(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of normalized texts and their counts."""
    return _reduced(position_keys(bodies))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (((keys >> np.uint64(40)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def _mask(depth: int) -> np.uint64:
    """Of a key, the next byte and so many context bytes."""
    return np.uint64(((1 << 8 * depth) - 1) << (64 - 8 * depth) | 0xFF)


def gather(docs: DataFrame, train, text: str, buckets: int) -> DataFrame:
    """Keys and counts by bucket of the three nearest context bytes, of all training texts: a row for each bucket."""

    def run(batches):
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out():
            bucket = _bucket(keys, buckets)
            by = np.argsort(bucket, kind="stable")
            cut = np.searchsorted(bucket[by], np.arange(buckets + 1))
            some = [b for b in range(buckets) if cut[b] < cut[b + 1]]
            runs = [by[cut[b] : cut[b + 1]] for b in some]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packed(keys[r]) for r in runs], pa.binary()), pa.array([packed(counts[r]) for r in runs], pa.binary())], names=["bucket", "keys", "counts"])

        held, size = [], 0
        for rows in _blocks(batches, 0, PIECE):
            held.append(grams([normal(t)[1] for (t,) in rows]))
            size += len(held[-1][0])
            if size > 2 * PIECE:
                keys, counts = _reduced(*(np.concatenate(x) for x in zip((keys, counts), *held)))
                held, size = [], 0
            if len(keys) > 4 * PIECE:
                yield out()
                keys, counts = keys[:0], counts[:0]
        keys, counts = _reduced(*(np.concatenate(x) for x in zip((keys, counts), *held)))
        if len(keys):
            yield out()
        settle_memory()

    def merge(batches):
        bucket, keys, counts = None, np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def out():
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([packed(keys)], pa.binary()), pa.array([packed(counts)], pa.binary()), pa.array([int(counts.sum())], pa.int64())], names=["bucket", "keys", "counts", "n"])

        for batch in batches:
            for b, k, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if b != bucket:
                    if bucket is not None:
                        yield out()
                    bucket, keys, counts = b, keys[:0], counts[:0]
                keys, counts = _reduced(np.concatenate((keys, unpacked(k.as_py(), np.uint64))), np.concatenate((counts, unpacked(c.as_py(), np.int64))))
        if bucket is not None:
            yield out()
        settle_memory()

    sent = docs.where(train).select(docs[text].alias("_text")).mapInArrow(run, "bucket int, keys binary, counts binary")
    return by_bucket(sent).mapInArrow(merge, "bucket int, keys binary, counts binary, n bigint")


def shallow(merged: DataFrame) -> DataFrame:
    """(depth, context, next, count) of depths up to SHALLOW, summed over the buckets."""

    def run(batches):
        for batch in batches:
            for k, c in zip(batch.column(0), batch.column(1)):
                keys, counts = unpacked(k.as_py(), np.uint64), unpacked(c.as_py(), np.int64)
                out = []
                for d in range(1, SHALLOW + 1):
                    k, c = _reduced(keys & _mask(d), counts)
                    out.append((np.full(len(k), d), k >> np.uint64(8), k & np.uint64(255), c))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[i] for o in out]).astype(np.int64)) for i in range(4)], names=["depth", "context", "next", "count"])
        settle_memory()

    part = merged.select("keys", "counts").mapInArrow(run, "depth bigint, context bigint, next bigint, count bigint")
    return part.groupBy("depth", "context", "next").agg(F.sum("count").alias("count"))


class Tree:
    """Dense tables of the automaton over prefixes of retained shallow contexts."""

    def __init__(self, rows, positions: int):
        by: dict[tuple, dict[int, int]] = {(): {}}
        for depth, context, byte, count in rows:
            key = tuple((context >> (48 - 8 * j)) & 0xFF for j in range(depth))  # nearest byte first
            by.setdefault(key, {})[byte] = count
        for key, following in list(by.items()):
            if len(key) == 1:
                for byte, count in following.items():
                    by[()][byte] = by[()].get(byte, 0) + count
        self.seen = sorted(by[()])
        kind = np.full(256, len(self.seen))
        kind[self.seen] = np.arange(len(self.seen))
        self.kind = kind.astype(np.int64)
        width = len(self.seen) + 1

        def vector(key):
            v = np.zeros(width)
            for byte, count in by.get(key, {}).items():
                v[kind[byte]] = count
            return v

        root = vector(())
        root = (root + 0.5) / (root.sum() + 128)  # the last kind: any one byte never seen
        dist = {(): root}
        cost = DIVERGENCE * math.log(max(positions, 2))
        for key in sorted(by, key=lambda k: (len(k), k)):
            if not key or key[:-1] not in dist:
                continue
            v = vector(key)
            n = v.sum()
            if n < LEAST:
                continue
            p, q = v / n, dist[key[:-1]]
            on = p > 0
            gain = n * float((p[on] * np.log(p[on] / q[on])).sum()) - cost * on.sum()
            if gain >= 0:
                dist[key] = (np.maximum(v - DISCOUNT, 0) + DISCOUNT * on.sum() * q) / n
        self.retained = len(dist) - 1
        # in order of time, with all prefixes, so that reading on always finds the longest suffix
        states = {()}
        for key in dist:
            s = key[::-1]
            states.update(s[:i] for i in range(len(s) + 1))
        index = {s: i for i, s in enumerate(sorted(states, key=lambda s: (len(s), s)))}
        below: dict[int, list[int]] = {}
        for s in index:
            if s:
                below.setdefault(index[s[:-1]], []).append(s)
        self.move = np.zeros((len(index), width), np.int32)
        self.log = np.zeros((len(index), width), np.float32)
        self.level = np.zeros(len(index), np.int64)  # bytes of the state's longest retained suffix
        for s, i in index.items():  # shorter ones first
            self.level[i] = next(d for d in range(len(s), -1, -1) if s[::-1][:d] in dist)
            self.log[i] = np.log10(dist[s[::-1][: self.level[i]]])
            if s:
                self.move[i] = self.move[index[next(s[d:] for d in range(1, len(s) + 1) if s[d:] in index)]]
            for child in below.get(i, ()):
                self.move[i, kind[child[-1]]] = index[child]

    def plain(self) -> tuple:
        return self.kind, self.move, self.log, self.level


def _shallow_odds(model: tuple, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probability of each key's next byte by its shallow contexts, and whether the longest of them is retained."""
    kind, move, log, level = model
    state = np.zeros(len(keys), np.int64)
    for d in range(SHALLOW, 0, -1):  # in order of time
        state = move[state, kind[(keys >> np.uint64(64 - 8 * d) & np.uint64(255)).astype(np.int64)]]
    return 10.0 ** log[state, kind[(keys & np.uint64(255)).astype(np.int64)]].astype(np.float64), level[state] == SHALLOW


def _contexts(k: np.ndarray, c: np.ndarray):
    """Of sorted keys of one depth: each context, where its keys begin, its count, and the number of its next bytes."""
    context = k >> np.uint64(8)
    begin = np.flatnonzero(np.r_[True, context[1:] != context[:-1]][: len(k)])
    total = np.add.reduceat(c, begin) if len(begin) else np.zeros(0, np.int64)
    return context[begin], begin, total, np.diff(np.r_[begin, len(k)])


def retained(model: tuple, positions: int, seen: np.ndarray, counts: np.ndarray):
    """For each depth beyond SHALLOW the keys and counts of the retained contexts of a bucket, from all its keys."""
    cost = DIVERGENCE * math.log(max(positions, 2))
    above, _ = _reduced(seen & _mask(SHALLOW), counts)
    q, alive = _shallow_odds(model, above)
    for d in range(SHALLOW + 1, DEPTH + 1):
        k, c = _reduced(seen & _mask(d), counts)
        at = np.searchsorted(above, k & _mask(d - 1))
        q, alive = q[at], alive[at]  # by the suffix
        _, begin, n, symbols = _contexts(k, c)
        gain = np.add.reduceat(c * np.log(c / np.repeat(n, symbols) / q), begin) - cost * symbols if len(begin) else n
        alive = np.repeat(alive[begin] & (n >= LEAST) & (gain >= 0), symbols)
        q = np.where(alive, (c + DISCOUNT * (np.repeat(symbols, symbols) * q - 1)) / np.repeat(n, symbols), q)
        yield k[alive], c[alive]
        above = k


def log_odds(model: tuple, kept: list, keys: np.ndarray) -> np.ndarray:
    """log10 probability of each key's next byte by its longest retained suffix; a key holds its depth, and `kept` the
    retained() of its bucket."""
    depth, keys = keys >> np.uint64(8) & np.uint64(255), keys & ~np.uint64(0xFF00)
    p, _ = _shallow_odds(model, keys)
    for d, (k, c) in enumerate(kept, SHALLOW + 1):
        distinct, _, n, symbols = _contexts(k, c)
        if not len(distinct):
            break
        mine = keys & _mask(d)
        at = np.minimum(np.searchsorted(distinct, mine >> np.uint64(8)), len(distinct) - 1)
        on = np.flatnonzero((distinct[at] == mine >> np.uint64(8)) & (depth >= d))
        at, mine = at[on], mine[on]
        own = np.minimum(np.searchsorted(k, mine), len(k) - 1)
        p[on] = (np.where(k[own] == mine, c[own] - DISCOUNT, 0) + DISCOUNT * symbols[at] * p[on]) / n[at]
    return np.log10(p)


def _spots(context: np.ndarray, depth: int, bits: int) -> np.ndarray:
    """Places in the bitmap of contexts (keys less their next byte) of one depth."""
    x = (context ^ context >> np.uint64(29)) * np.uint64(0x9E3779B97F4A7C15 + 2 * depth)
    return ((x ^ x >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def tagged(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Keys cut to the longest context that may be retained, with its depth."""
    out = keys & _mask(SHALLOW) | np.uint64(SHALLOW << 8)
    on = np.arange(len(keys))
    for d in range(SHALLOW + 1, DEPTH + 1):
        spot = _spots((keys & _mask(d)) >> np.uint64(8), d, 8 * len(bits))
        may = np.flatnonzero(bits[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1)
        on, keys = on[may], keys[may]
        out[on] = keys & _mask(d) | np.uint64(d << 8)
    return out


class Model:
    """The deeper contexts as a stored table by bucket, the shallow ones' automaton, and the bitmap of retained ones."""

    def __init__(self, docs: DataFrame, train, text: str, buckets: int):
        merged = stored(gather(docs, train, text, buckets))
        positions = int(merged.agg(F.sum("n")).first()[0] or 0)
        rows = shallow(merged).toArrow()
        self.shallow = Tree(zip(*[c.to_pylist() for c in rows.columns]), positions).plain()
        shared = docs.sparkSession.sparkContext.broadcast(self.shallow)
        names = [f"{x}{d}" for d in range(SHALLOW + 1, DEPTH + 1) for x in ("k", "c")]

        def keep(batches):
            for batch in batches:
                for b, k, c in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                    found = list(retained(shared.value, positions, unpacked(k.as_py(), np.uint64), unpacked(c.as_py(), np.int64)))
                    n = sum(len(_contexts(*x)[0]) for x in found)
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([n], pa.int64()), *[pa.array([packed(x)], pa.binary()) for pair in found for x in pair]], names=["bucket", "contexts", *names])
            settle_memory()

        self.table = stored(merged.select("bucket", "keys", "counts").mapInArrow(keep, "bucket int, contexts bigint, " + ", ".join(f"{n} binary" for n in names)))
        discard(merged)
        self.contexts = int(self.table.agg(F.sum("contexts")).first()[0] or 0)
        bits = min(FILTER, 1 << max(20, (16 * self.contexts).bit_length()))

        def mark(batches):
            seen = np.zeros(bits, bool)
            for batch in batches:
                for i in range(batch.num_rows):
                    for d in range(SHALLOW + 1, DEPTH + 1):
                        keys = unpacked(batch.column(d - SHALLOW - 1)[i].as_py(), np.uint64)
                        seen[_spots(keys >> np.uint64(8), d, bits)] = True
            parts = np.split(np.packbits(seen), SLICES)
            some = [k for k in range(SLICES) if parts[k].any()]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packed(parts[k]) for k in some], pa.binary())], names=["slice", "part"])
            settle_memory()

        self.bits = joined(self.table.select(names[::2]).mapInArrow(mark, "slice int, part binary"), bits // 8, np.uint8, np.bitwise_or)

    def answers(self, blocks: DataFrame) -> DataFrame:
        """For each block and bucket, the log10 probabilities of its keys in order."""
        shared = blocks.sparkSession.sparkContext.broadcast(self.shallow)

        def run(key, asked, trained):
            held = [unpacked(x.as_py(), np.uint64) for x in asked.column("grams")]
            logs = [b""] * len(held)
            if held:
                keys, place = np.unique(np.concatenate(held), return_inverse=True)
                row = [trained.column(i)[0].as_py() for i in range(trained.num_columns)] if trained.num_rows else []
                kept = [(unpacked(k, np.uint64), unpacked(c, np.int64)) for k, c in zip(row[::2], row[1::2])]
                each = log_odds(shared.value, kept, keys).astype(np.float32)[place]
                logs = [packed(x) for x in np.split(each, np.cumsum([len(h) for h in held])[:-1])]
            settle_memory()
            return pa.table({"block": asked.column("block"), "bucket": asked.column("bucket"), "logs": pa.array(logs, pa.binary())})

        asked = blocks.where("grams is not null").select("block", "bucket", "grams")
        trained = self.table.drop("contexts").withColumnRenamed("bucket", "_bucket")
        return asked.groupBy("bucket").cogroup(trained.groupBy("_bucket")).applyInArrow(_without_key(run), "block bigint, bucket int, logs binary")


def _without_key(run):
    return lambda key, asked, trained: run(key, asked, trained.drop_columns(["_bucket"]))


def _worded(body: bytes):
    """Of a body's words: their starts and sizes, where the distinct ones occur and their hashes, in order of the
    hash, and each word's place among them."""
    data = body + bytes(8)
    starts, sizes = spans(np.frombuffer(data, np.uint8)[:-8])
    (h,) = hashes(data, starts, sizes, SEEDS[:1])
    first, place = inverse(h)
    return starts, sizes, first, h[first], place


def posted(docs: DataFrame, keep: list[str], train, text: str, buckets: int, bits: np.ndarray) -> DataFrame:
    """Per block one row of its texts and a row for each bucket of its words and keys."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    columns = [f"_k{i}" for i in range(len(keep))]
    kept = T.StructType([T.StructField(k, docs.schema[c].dataType) for c, k in zip(keep, columns)] + [T.StructField("train", T.BooleanType()), T.StructField("n_tokens", T.LongType())])
    schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("bucket", T.IntegerType()), *[T.StructField(n, T.BinaryType()) for n in ("words", "counts", "grams", "body")], T.StructField("rows", T.ArrayType(kept))])
    rows_type = pa.list_(to_arrow_type(kept))

    def run(batches):
        zip_ = zstandard.ZstdCompressor(3)
        for serial, rows in enumerate(_blocks(batches, len(columns) + 1)):
            block = (TaskContext.get().partitionId() << 24) + serial
            bodies = [normal(r[-1])[1] for r in rows]
            whole = b"".join(bodies)
            starts, sizes, first, h, place = _worded(whole)
            counts = np.diff(np.searchsorted(starts, np.cumsum([0] + [len(t) for t in bodies])))
            lengths = (counts + 1).tolist()
            listed = [whole[a : a + n] for a, n in zip(starts[first].tolist(), sizes[first].tolist())]
            # the bucket grows with the hash
            cut = np.searchsorted((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
            trained = np.bincount(place[np.repeat([bool(r[len(columns)]) for r in rows], counts)], minlength=len(listed))
            keys = _reduced(np.concatenate([_reduced(tagged(grams(some)[0], shared.value))[0] for some in _pieces(bodies)]))[0]
            keys = keys[(keys >> np.uint64(8) & np.uint64(255)) > SHALLOW]  # the others need no bucket
            of = _bucket(keys, buckets)
            keys = keys[np.argsort(of, kind="stable")]
            ends = np.searchsorted(np.sort(of), np.arange(buckets + 1))
            body = zip_.compress(whole)
            some = [b for b in range(buckets) if cut[b] < cut[b + 1] or ends[b] < ends[b + 1]]
            told = [{**dict(zip(columns, r)), "train": r[len(columns)], "n_tokens": n} for r, n in zip(rows, lengths)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block] * (len(some) + 1), pa.int64()),
                    pa.array([*some, None], pa.int32()),
                    pa.array([*[b"\n".join(listed[cut[b] : cut[b + 1]]) or None for b in some], None], pa.binary()),
                    pa.array([*[packed(trained[cut[b] : cut[b + 1]]) if cut[b] < cut[b + 1] else None for b in some], None], pa.binary()),
                    pa.array([*[packed(keys[ends[b] : ends[b + 1]]) if ends[b] < ends[b + 1] else None for b in some], None], pa.binary()),
                    pa.array([*[None] * len(some), body], pa.binary()),
                    pa.array([*[None] * len(some), told], rows_type),
                ],
                names=["block", "bucket", "words", "counts", "grams", "body", "rows"],
            )
        settle_memory()

    return docs.select(*[docs[c].alias(k) for c, k in zip(keep, columns)], train.alias("_train"), docs[text].alias("_text")).mapInArrow(run, schema)


def corpus_counts(blocks: DataFrame) -> DataFrame:
    """For each block and bucket, its words' corpus counts in order; a row without a block holds the bucket's
    share of V."""

    def run(key, data):
        ids: dict[bytes, int] = {}
        places, totals = [], np.zeros(1024, np.int64)
        for w, c in zip(data.column("words"), data.column("counts")):
            place = np.array([ids.setdefault(x, len(ids)) for x in w.as_py().split(b"\n")], np.int64)
            if len(ids) > len(totals):
                totals = np.concatenate((totals, np.zeros(len(ids), np.int64)))
            totals[place] += unpacked(c.as_py(), np.int64)  # a block holds a word once
            places.append(place)
        n = data.num_rows
        return pa.table(
            {
                "block": pa.array([*data.column("block").to_pylist(), None], pa.int64()),
                "bucket": pa.array([*data.column("bucket").to_pylist(), None], pa.int32()),
                "corpus": pa.array([*[packed(totals[p]) for p in places], None], pa.binary()),
                "distinct": pa.array([*[0] * n, int((totals > 0).sum())], pa.int64()),
            }
        )

    words = blocks.where("words is not null").select("block", "bucket", "words", "counts")
    return words.groupBy("bucket").applyInArrow(run, "block bigint, bucket int, corpus binary, distinct bigint")


def evaluate(docs: DataFrame, train, keep: list[str], text: str = "text") -> DataFrame:
    """Columns `keep` of every row with held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    buckets = bucket_count(docs, BUCKET)
    model = Model(docs, train, text, buckets)
    blocks = stored(posted(docs, keep, train, text, buckets, model.bits))
    logs = stored(model.answers(blocks))
    back = stored(corpus_counts(blocks))
    bodies = blocks.where("bucket is null").select("block", "rows", "body")
    ends, words = bodies.select(F.explode("rows").alias("r")).where("r.train").agg(F.count("*"), F.sum("r.n_tokens")).first()
    tokens = int(words or 0)
    distinct = int(back.agg(F.sum("distinct")).first()[0] or 0) + (1 if ends else 0)
    listed = lambda df, column: df.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", column))).alias("x")).select(F.col("block").alias(f"_{column}"), F.col(f"x.{column}").alias(column))
    corpus = listed(back.where("block is not null"), "corpus")
    whole = bodies.join(corpus, F.col("block") == F.col("_corpus"), "left").join(listed(logs, "logs"), F.col("block") == F.col("_logs"), "left").select("rows", "corpus", "body", "logs")
    columns = [f"_k{i}" for i in range(len(keep))]
    shared = spark.sparkContext.broadcast((model.shallow, model.bits))

    def scores(bodies, logs):
        tables, bits = shared.value
        parts = []
        for some in _pieces(bodies, PIECE // 4):
            k = position_keys(some)
            first, place = inverse(k)
            parts.append((some, tagged(k[first], bits), place))
        keys = _reduced(np.concatenate([k for _, k, _ in parts]))[0]
        deep = (keys >> np.uint64(8) & np.uint64(255)) > SHALLOW
        each = np.empty(len(keys))
        each[~deep] = np.log10(_shallow_odds(tables, keys[~deep])[0])
        answered = np.empty(int(deep.sum()))
        answered[np.argsort(_bucket(keys[deep], buckets), kind="stable")] = np.concatenate([np.zeros(0, np.float32), *[unpacked(x, np.float32) for x in logs or ()]])
        each[deep] = answered
        return np.concatenate([np.add.reduceat(each[np.searchsorted(keys, k)][place], np.r_[0, np.cumsum([len(t) for t in some])[:-1]]) for some, k, place in parts])

    def run(batches):
        unzip = zstandard.ZstdDecompressor()
        for batch in batches:
            for i in range(batch.num_rows):
                rows, body = batch.column(0)[i].values, unzip.decompress(batch.column(2)[i].as_py())
                lengths = np.asarray(rows.field("n_tokens"))
                place = _worded(body)[-1]
                doc = np.repeat(np.arange(len(rows)), lengths - 1)
                corpus = np.concatenate([np.zeros(0, np.int64), *[unpacked(x, np.int64) for x in batch.column(1)[i].as_py() or ()]])[place]
                known = np.bincount(doc, corpus > 0, len(rows))
                base = np.bincount(doc, np.log10(corpus + 0.5), len(rows)) + math.log10(ends + 0.5) - lengths * math.log10(tokens + 0.5 * (distinct + 1))
                bodies = [t + b"\n" for t in body.split(b"\n")[:-1]]
                del body
                yield pa.RecordBatch.from_arrays(
                    [*[rows.field(c) for c in columns], pa.array([not t for t in rows.field("train").to_pylist()]), rows.field("n_tokens"), pa.array((known + (ends > 0)).astype(np.int64)), pa.array(np.full(len(rows), tokens, np.int64)), pa.array(base), pa.array(scores(bodies, batch.column(3)[i].as_py()))],
                    names=[*columns, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
        settle_memory()

    kinds = [T.StructField(k, docs.schema[c].dataType) for c, k in zip(keep, columns)]
    told = [T.StructField(n, t()) for n, t in (("held_out", T.BooleanType), ("n_tokens", T.LongType), ("n_known", T.LongType), ("train_tokens", T.LongType), ("base_score", T.DoubleType), ("score", T.DoubleType))]
    out = whole.mapInArrow(run, T.StructType([*kinds, *told]))
    return out.select(*[F.col(k).alias(c) for k, c in zip(columns, keep)], *[f.name for f in told])


def op3(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return evaluate(docs, remainder(F.col("doc_id"), 5) != 1, ["doc_id"])
