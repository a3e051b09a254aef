r"""Benchmark decontamination by Wu-Manber search over words.

Letters of the search are words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased.  A pattern is a
window of eight consecutive words of a benchmark item, or a whole shorter item.  Patterns of equal length m
share one table set: blocks of B words (2; 1 where m is 1) give a shift table, blocks at a pattern's end give
the suffix buckets, and a direct comparison confirms an occurrence.

Edge cases: null or wordless texts have no words and no hits; null or wordless items have no window; rows
repeated in either table count as they stand (an item_id counts once a document); null item_ids match but are
left out of n_items and of the hash.
"""

from __future__ import annotations

from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arborframe.llm.common import anonymous, discard, stored, table, texts

WINDOW = 8
#: Patterns that one pass holds in memory; a larger benchmark is searched in further passes.
PATTERNS_A_PASS = 400_000
_FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


def windows(text: bytes, width: int = WINDOW) -> list[tuple[bytes, ...]]:
    w = words(text)
    if not w:
        return []
    return [tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))]


class WuManber:
    """Tables for patterns (tuples of words) of one length, each with the indexes of its items."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]]):
        self.m = m = len(next(iter(patterns)))
        self.b = b = min(2, m)
        self.default = m - b + 1
        self.shift: dict = {}
        self.bucket: dict = defaultdict(list)
        for p, items in patterns.items():
            for end in range(b, m + 1):
                block = p[end - b : end] if b > 1 else p[end - 1]
                self.shift[block] = min(self.shift.get(block, self.default), m - end)
            self.bucket[p[m - b :] if b > 1 else p[m - 1]].append((list(p), items))

    def search(self, w: list[bytes]):
        """(first word, length, items) for every occurrence in w."""
        m, b, get, default, n = self.m, self.b, self.shift.get, self.default, len(w)
        i = m
        while i <= n:
            block = (w[i - 2], w[i - 1]) if b > 1 else w[i - 1]
            skip = get(block, default)
            if skip:
                i += skip
                continue
            start = i - m
            found = w[start:i]
            for p, items in self.bucket[block]:
                if p == found:
                    yield start, m, items
            i += 1


def _tables(patterns: list[tuple[tuple[bytes, ...], list[int]]]) -> list[WuManber]:
    by = defaultdict(dict)
    for p, items in patterns:
        by[len(p)][p] = items
    return [WuManber(x) for x in by.values()]


def matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: list[str] | None = None, width: int = WINDOW, a_pass: int = PATTERNS_A_PASS) -> DataFrame:
    """The columns `keep` of every row of docs, with n_words, n_hit, n_items, items (ids as strings, sorted),
    spans (first word and end, disjoint, in order).

    The benchmark is read to the driver in parts of at most `a_pass` windows, of which it holds two at a time.  Each
    part is a pass of its own: the rows found so far are written before the next part's tables are made, so a task holds
    the tables of one part only.
    """
    keep = keep if keep is not None else [c for c in docs.columns if c != text]
    spark = docs.sparkSession

    def parts():
        patterns: dict = {}
        ids: list = []
        for item in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("binary")).toLocalIterator():
            ids.append(item[0])
            for p in windows(bytes(item[1] or b""), width):
                patterns.setdefault(p, []).append(len(ids) - 1)
            if len(patterns) >= a_pass:
                yield list(patterns.items()), ids
                patterns, ids = {}, []
        yield list(patterns.items()), ids

    def scan(held, last):
        made_once: list = []

        def built(held):
            if not made_once:
                made_once.append((_tables(held.value[0]), held.value[1]))
            return made_once[0]

        def of(batch):
            texts_, before = texts(batch.column(batch.schema.get_field_index("_text"))), batch.column(batch.schema.get_field_index("_found")).to_pylist()
            machines, names = built(held)
            out = []
            for t, was in zip(texts_, before):
                w = words(t) if t else []
                items = set(was["items"]) if was else set()
                spans = [tuple(x.values()) for x in was["spans"]] if was else []
                for machine in machines:
                    for start, m, found in machine.search(w):
                        spans.append((start, start + m))
                        items.update(names[k] for k in found if names[k] is not None)
                out.append((len(w), items, _merged(spans)))
            made = {c: batch.column(batch.schema.get_field_index(f"_k{i}")) for i, c in enumerate(columns)}
            spans_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
            spans_ = pa.array([[{"begin": a, "end": b} for a, b in x[2]] for x in out], spans_type)
            items_ = pa.array([sorted(x[1]) for x in out], pa.list_(pa.string()))
            if not last:
                return made | {"_text": batch.column(batch.schema.get_field_index("_text")), "_found": pa.StructArray.from_arrays([items_, spans_], names=["items", "spans"])}
            return made | {
                "n_words": pa.array([x[0] for x in out], pa.int64()),
                "n_hit": pa.array([sum(b - a for a, b in x[2]) for x in out], pa.int64()),
                "n_items": pa.array([len(x[1]) for x in out], pa.int64()),
                "items": items_,
                "spans": spans_,
            }

        return of

    columns = [f"_k{i}" for i in range(len(keep))]
    found = "struct<items:array<string>,spans:array<struct<begin:bigint,end:bigint>>>"
    now = docs.select(*[docs[c].alias(k) for c, k in zip(keep, columns)], docs[text].alias("_text"), F.expr(f"cast(null as {found})").alias("_found"))
    kept = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for c, k in zip(keep, columns))
    coming = parts()
    x, before = next(coming), None
    while x is not None:
        following = next(coming, None)
        last = following is None
        tail = "n_words bigint, n_hit bigint, n_items bigint, items array<string>, spans array<struct<begin:bigint,end:bigint>>" if last else f"_text {dict(now.dtypes)['_text']}, _found {found}"
        names = columns + (["n_words", "n_hit", "n_items", "items", "spans"] if last else ["_text", "_found"])
        held = spark.sparkContext.broadcast(x)
        function = scan(held, last)

        def run(batches, function=function, names=names):
            for batch in batches:
                if batch.num_rows:
                    made = function(batch)
                    yield pa.RecordBatch.from_arrays([made[n] for n in names], names=names)

        now = now.mapInArrow(run, f"{kept}, {tail}" if kept else tail)
        if not last:
            now = stored(now)
            held.unpersist()
            if before is not None:
                discard(before)
            before = now
        x = following
    return now.select(*[F.col(k).alias(c) for k, c in zip(columns, keep)], "n_words", "n_hit", "n_items", "items", "spans")


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def op6(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of matches() over all documents."""
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_items") >= 2).alias("contaminated")
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: contaminated documents (two items or more) go; the rest keep all their columns, whatever their
    names.  Null and wordless texts stay, repeated rows stay or go together, an empty table gives an empty result."""
    body, names = anonymous(docs)
    found = matches(body, table(spark, sf_dir, "benchmark"), text=names["text"], keep=body.columns)
    return found.where("n_items < 2").select(body.columns).toDF(*docs.columns)
