"""SimHash near-duplicates found by pigeonring filtering.

A fingerprint's 64 bits are a ring of five segments.  If two fingerprints differ in at most t = 4 bits, some
segment starts a chain in which the first l segments differ in at most l * t / 5 bits, for every l: so that
segment is equal, and the next differs in at most one bit, which leaves one of its halves equal.  Candidates meet
under ten keys (segment, half of the next); in each, the rest of the chain is tested before the full distance.

Equal fingerprints are one node from the start.  A key of many fingerprints is dealt out as tiles of two bounded
parts, and a tile returns a spanning forest of its links, never all pairs.

Edge cases: null and wordless texts have fingerprint zero and are linked like any other; fewer than four words
make one shingle; rows repeated count as documents of their own; null ids are never the smallest unless a
component has no other; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from arborframe.llm.common import anonymous, components, materialize, settle_memory, stored, table, texts

SHINGLE, SEED, DISTANCE = 4, 42, 4
#: (offset, width) of the ring's segments.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_OFFSETS = np.array([s[0] for s in SEGMENTS], np.uint64)
_MASKS = np.array([(1 << s[1]) - 1 for s in SEGMENTS], np.uint64)
#: Fingerprints of one key in one part of a tile.
PART = 16_384


def fingerprint(text: bytes | None) -> int:
    w = text.lower().split() if text else []
    if not w:
        return 0
    line = b" ".join(w)
    n = len(w)
    if n <= SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, w), np.int64, n) + 1) - 1
    begins = np.concatenate(([0], ends[: n - SHINGLE] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(line[a:b], SEED) for a, b in zip(begins, ends[SHINGLE - 1 :].tolist())), np.uint64, n - SHINGLE + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 4096):
        ones += np.unpackbits(h[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns _k0.. of `keep`, and fp: the fingerprint as a signed long."""
    columns = [f"_k{i}" for i in range(len(keep))]
    kept = "".join(f"{k} {docs.schema[c].dataType.simpleString()}, " for c, k in zip(keep, columns))

    def run(batches):
        for batch in batches:
            body, fps = batch.column(batch.num_columns - 1), []
            for at in range(0, batch.num_rows, 512):
                fps += map(fingerprint, texts(body.slice(at, 512)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.array(fps, np.uint64).view(np.int64))], names=[*columns, "fp"])
        settle_memory()

    return docs.select(*[docs[c].alias(k) for c, k in zip(keep, columns)], docs[text].alias("_text")).mapInArrow(run, kept + "fp bigint")


def _segment(i: int):
    offset, width = SEGMENTS[i % len(SEGMENTS)]
    return F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit((1 << width) - 1))


def keys() -> list:
    """The ten candidate keys of the column fp."""
    out = []
    for i in range(len(SEGMENTS)):
        width = SEGMENTS[(i + 1) % len(SEGMENTS)][1]
        low = _segment(i + 1).bitwiseAND(F.lit((1 << width // 2) - 1))
        high = F.shiftright(_segment(i + 1), width // 2)
        out += [F.shiftleft(F.lit(2 * i + h).cast("bigint"), 40).bitwiseOR(F.shiftleft(_segment(i), 20)).bitwiseOR(half) for h, half in ((0, low), (1, high))]
    return out


def _viable(x: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Indexes of the differences x (as bits) that are chains within their budgets from segment `start` on.  Each
    segment is counted only for what the ones before have left; all five together are the full Hamming check."""
    left, total = np.arange(len(x)), np.zeros(len(x), np.int64)
    for length in range(1, len(SEGMENTS) + 1):
        at = (start + length - 1) % len(SEGMENTS)
        total = total + np.bitwise_count(x >> _OFFSETS[at] & _MASKS[at])
        on = np.flatnonzero(total * len(SEGMENTS) <= length * DISTANCE)
        left, total, x, start = left[on], total[on], x[on], start[on]
    return left


def _forest(fp: np.ndarray, start: int) -> np.ndarray:
    """Index of each fingerprint's seed: those linked by a chain from segment `start` share one.  Each is compared once
    with those still unseen."""
    seed, left = np.full(len(fp), -1, np.int64), np.arange(len(fp))
    while len(left):
        first, left = left[0], left[1:]
        seed[first] = first
        front = fp[first : first + 1]
        while len(front) and len(left):
            near = np.zeros(len(left), bool)
            for f in front:
                near[_viable(fp[left] ^ f, np.full(len(left), start))] = True
                if len(front) > 64 and near.all():
                    break
            found, left = left[near], left[~near]
            seed[found] = first
            front = fp[found]
    return seed


def _links_of_small(key: np.ndarray, fp: np.ndarray, size: int):
    """All links within groups of equal key, sorted, of at most `size`."""
    a, b = [], []
    for d in range(1, size):
        same = key[d:] == key[:-d]
        if not same.any():
            break
        i = np.flatnonzero(same)
        i = i[_viable(fp[i] ^ fp[i + d], (key[i] >> 41).astype(np.int64))]  # a key's number is twice its segment's
        a.append(fp[i])
        b.append(fp[i + d])
    return (np.concatenate(a), np.concatenate(b)) if a else (fp[:0], fp[:0])


def links(fps: DataFrame, part: int = PART) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp): enough to connect all that are linked."""
    keyed = fps.select("fp", F.explode(F.array(*keys())).alias("key"))
    big = keyed.groupBy("key").count().where(F.col("count") > part).select(F.col("key").alias("_key"), F.ceil(F.col("count") / part).cast("int").alias("parts"))
    dealt = keyed.join(big, F.col("key") == F.col("_key"), "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    dealt = dealt.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other")).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")

    def run(batches):
        def flush(key, fp, own, cut):
            """Links of sorted rows; cut: starts of the groups."""
            sizes = np.diff(np.append(cut, len(key)))
            small = np.repeat(sizes <= 48, sizes)
            a, b = _links_of_small(key[small], fp[small], 48)
            a, b = [a], [b]
            for at, n in zip(cut[sizes > 48], sizes[sizes > 48]):
                f, o = fp[at : at + n], own[at : at + n]
                start = int(key[at] >> 41)
                whole = _forest(f, start)
                if o[0] == o[-1]:
                    k = np.flatnonzero(whole != np.arange(n))
                    a.append(f[k])
                    b.append(f[whole[k]])
                    continue
                # two parts: each one's own links come from its own tile, so only its seeds are linked here
                for side in np.unique(o):
                    at_ = np.flatnonzero(o == side)
                    seeds = at_[np.unique(_forest(f[at_], start))]
                    seeds = seeds[whole[seeds] != seeds]
                    a.append(f[seeds])
                    b.append(f[whole[seeds]])
            a, b = np.concatenate(a), np.concatenate(b)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        held = None
        for batch in batches:
            now = [np.asarray(c) for c in batch.columns]
            now = now if held is None else [np.concatenate(x) for x in zip(held, now)]
            key, i, j = now[:3]
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(key) else np.array([], np.int64)
            if len(cut) < 2:
                held = now
                continue
            done = cut[-1]
            yield flush(key[:done], now[4][:done].view(np.uint64), now[3][:done], cut[:-1])
            held = [c[done:].copy() for c in now]
        if held is not None and len(held[0]):
            yield flush(held[0], held[4].view(np.uint64), held[3], np.array([0]))

    def full(batches):
        yield from run(batches)

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "own", "fp").mapInArrow(full, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, keep: list[str], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Columns `keep` of every row with fp, component_id, the smallest id that links reach, and root, the
    component's smallest fingerprint."""
    at = f"_k{keep.index(doc_id)}"
    marked = stored(fingerprints(docs, keep, text))
    nodes = materialize(marked.groupBy("fp").agg(F.min(at).alias("least")))
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    of = rooted.select(F.col("fp").alias("_fp"), "root").join(named, "root")
    out = marked.join(of, F.col("fp") == F.col("_fp"))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], "fp", "component_id", "root")


def op7(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each group the row with the smallest id stays (null ids last; one row, if it is repeated).

    Groups are told apart by their smallest fingerprint, so null and repeated ids join none.  Null and wordless texts
    are one group; an empty table gives an empty result; all columns are kept, whatever their names.
    """
    body, names = anonymous(docs)
    doc_id = names["doc_id"]
    # xxhash64 passes over nulls, so where they stand is hashed too
    body = body.withColumn("_h", F.xxhash64(*[F.col(c).cast("string") for c in body.columns], *[F.col(c).isNull() for c in body.columns]))
    found = near_duplicates(body, [doc_id, "_h"], doc_id, names["text"])
    first = found.groupBy("root").agg(F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), "_h")).alias("r"))
    stay = first.select(F.col("r.id").alias("_id"), F.col("r._h").alias("_hash"))
    kept = body.join(stay, F.col(doc_id).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_hash")))
    # only identical rows share id and hash: one of them stays
    return kept.dropDuplicates([doc_id, "_h"]).select(list(names.values())).toDF(*docs.columns)
