"""Line dedup by an exact set-similarity join.

A line is the set of its words, A-Z lower-cased.  Lines of equal sets are collapsed first, by 128-bit hash.  Distinct
sets order their words by rarity (counts in a fixed table of hashes, broadcast: TABLE entries), and meet under the
words of their prefixes; length, position and parity-signature filters (each an exact bound on the overlap) leave
candidates, whose Jaccard similarity is then verified on the words themselves.  A line goes if an equal or similar
line stands before it, in order of (doc_id, line number, text's hash; of similar lines in equal places, the set's
place in its table); whether that one goes too does not matter.

A set's nearest candidate is verified first, then its others; where a set has more than were listed and none
settles it, it is compared with all sets that hold a word of its prefix, in one pass, or, if those sets are too many, a
further search lists eight times as many, until all have been verified, so none is lost.  Rows travel
as packed blocks in buckets whose number grows with the data; a worker holds one bucket at a time, and a word under
which very many sets meet is dealt out as tiles.

Sets of fewer than MEETS words are similar to none but an equal one, so they are collapsed and meet no others.

Edge cases: lines without words stay; null texts have no lines and stay null; null ids stand
last; rows with an equal id and text are one document and keep the same lines; very long lines are compared whole;
an empty table gives an empty result; only the named columns are read, and columns carried along may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from arborframe.llm.common import SLICES, bucket_count, by_bucket, discard, joined, packed, settle_memory, stored, table, texts, unpacked
from arborframe.llm.words import SEEDS, hashes, mix, spans

SIMILARITY, LEAST = 0.8, 1
#: Words of the smallest set that can be similar to a larger one: 4 of 5.
MEETS = 4
TABLE = 1 << 22
#: Sets meeting under one word in one tile.
TILE = 20_000
#: Candidates of a set that one search lists, how many times as many if its nearest may well not be similar, and how
#: many times as many the next search lists.
FEW, WIDE, GROWTH = 8, 32, 8
#: Unsettled sets, bytes of their lines and pairs to be compared, up to which one pass settles them.
OPEN, OPEN_BYTES, OPEN_PAIRS = 1000, 4_000_000, 2_000_000
#: Bytes of text that are split at once, bytes of lines and records that are sent at once, pairs that are held at once.
PIECE, SENT, RECORDS, HELD = 1 << 18, 12_000_000, 300_000, 1_000_000
#: Bytes of input for each bucket.
BUCKET = 4_000_000
#: Bits of the filters for sets that are in some pair (8 an id, up to so many) and for the words and sizes that unsettled
#: sets meet under (8,192 a set, up to so many); what passes in vain is only shuffled.
FILTER = 1 << 26
_RECORD = np.dtype([("key", "<u4"), ("at", "<u2"), ("size", "<u4"), ("sign", "<u8"), ("more", "<u8"), ("doc", "<i8"), ("line", "<u4"), ("id", "<i8")])
_PLACE = [("doc", "<i8"), ("tie", "<i8"), ("line", "<i4")]
_HEAD = np.dtype([("a", "<u8"), ("b", "<u8"), *_PLACE, ("bytes", "<i4")])
_GONE = np.dtype(_PLACE)
_U = np.uint64


def line_sets(bodies: list[bytes | None], identity: bool = True, levels: np.ndarray | None = None):
    """(text's index, line number, id's two halves, where its words begin) for lines that take part, and all words'
    hashes; a line's distinct hashes, in order of rarity if levels are given, end where the next one's begin.  Without
    identity the halves are None."""
    bodies = [t or b"" for t in bodies]
    data = b"\n".join([*bodies, bytes(8)]).lower()
    raw = np.frombuffer(data, np.uint8)[:-8]
    starts, sizes = spans(raw)
    hashed = hashes(data, starts, sizes, SEEDS[: 2 if identity else 1])
    new = np.flatnonzero(raw == 10)
    line = np.repeat(np.arange(len(new)), np.diff(np.r_[0, np.searchsorted(starts, new)]))
    room = _U(max(1, len(new).bit_length()))  # bits of a line's number; the others sort its words
    key = line.astype(np.uint64) << (_U(64) - room)
    if levels is None:
        key |= hashed[0] >> room
    else:
        key |= levels[hashed[0] % _U(TABLE)].astype(np.uint64) << (_U(54) - room) | hashed[0] >> (room + _U(10))
    by = np.argsort(key)
    line, words = line[by], hashed[0][by]
    fresh = np.r_[True, (line[1:] != line[:-1]) | (words[1:] != words[:-1])][: len(by)]
    line, words = line[fresh], words[fresh]
    begin = np.flatnonzero(np.r_[True, line[1:] != line[:-1]][: len(line)])
    cut = np.r_[begin, len(line)]
    one = two = None
    if identity:
        count = np.diff(cut).astype(np.uint64)
        one, two = (mix(np.add.reduceat(mix(h + _U(SEEDS[0])), begin) + count) if len(begin) else np.zeros(0, np.uint64) for h in (words, hashed[1][by][fresh]))
    # the number of a text's first line: newlines before it, each text being closed by one
    at = np.cumsum([0] + [len(t) + 1 for t in bodies])[:-1]
    first = np.searchsorted(new, at)
    owner = np.searchsorted(first, line[begin], "right") - 1
    return owner, line[begin] - first[owner], (one, two), cut, words


def _pieces(batch):
    """Slices of a batch whose texts (the last column) have about PIECE bytes, at least one text each."""
    begin, size = 0, 0
    for i, t in enumerate(bodies := texts(batch.column(batch.num_columns - 1))):
        if i > begin and size + len(t or b"") > PIECE:
            yield batch.slice(begin, i - begin), bodies[begin:i]
            begin, size = i, 0
        size += len(t or b"")
    if begin < len(bodies):
        yield batch.slice(begin), bodies[begin:]


def _earliest(head: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of each set's first line, in order of the sets' ids, and the places of the other lines."""
    by = np.lexsort((head["tie"], head["line"], head["doc"], head["b"], head["a"]))
    now = head[by]
    fresh = np.r_[True, (now["a"][1:] != now["a"][:-1]) | (now["b"][1:] != now["b"][:-1])][: len(by)]
    first = now[fresh][np.cumsum(fresh) - 1]
    other = (now["doc"] != first["doc"]) | (now["line"] != first["line"]) | (now["tie"] != first["tie"])  # else a row repeated
    gone = np.zeros(int(other.sum()), _GONE)
    for n in _GONE.names:
        gone[n] = now[n][other]
    return by[fresh], gone


def _bucketwise(batches):
    """Lists of the rows (without the bucket) of each bucket."""
    held, now = [], None
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(1, batch.num_columns)]
        for bucket, *row in zip(batch.column(0).to_pylist(), *columns):
            if bucket != now and held:
                yield held
                held = []
            now = bucket
            held.append(row)
    if held:
        yield held


def _order(docs: DataFrame):
    return F.coalesce(docs["doc_id"].try_cast("bigint"), F.lit(2**63 - 1)).alias("doc")


def _sets(docs: DataFrame, text: str) -> DataFrame:
    """Distinct sets (id, place of their first line, its text), the places of lines equal to an earlier one (without
    id and text), and slices (numbered by `line`) of a table with the number of sets that hold a word.  Equal sets are
    collapsed before and after the shuffle."""
    buckets = bucket_count(docs, BUCKET)

    def deal(batches):
        zip_, serial = zstandard.ZstdCompressor(1), TaskContext.get().partitionId()
        heads, lines, held = [], [], 0

        def out():
            head = np.concatenate(heads)
            by, gone = _earliest(head)
            # the bucket grows with the id
            bucket = ((head["a"][by] >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
            cut = np.searchsorted(bucket, np.arange(buckets + 1))
            some = [b for b in range(buckets) if cut[b] < cut[b + 1]]
            runs = [by[cut[b] : cut[b + 1]] for b in some]
            numbers, blocks = [*some], [packed(head[r]) for r in runs]
            bodies = [zip_.compress(b"".join([lines[i] for i in r])) for r in runs]
            if len(gone):
                numbers.append(serial % buckets)
                blocks.append(packed(gone))
                bodies.append(None)
            return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(blocks, pa.binary()), pa.array(bodies, pa.binary())], names=["bucket", "head", "body"])

        for batch in batches:
            for part, bodies in _pieces(batch):
                owner, line, (one, two), _, _ = line_sets(bodies)
                split = [t.split(b"\n") if t else () for t in bodies]
                now = [split[o][k] for o, k in zip(owner.tolist(), line.tolist())]
                head = np.zeros(len(now), _HEAD)
                head["a"], head["b"], head["doc"], head["tie"], head["line"] = one, two, part.column(0).to_numpy()[owner], part.column(1).to_numpy()[owner], line
                head["bytes"] = [len(x) for x in now]
                heads.append(head)
                lines += now
                held += int(head["bytes"].sum())
                if held > SENT:
                    yield out()
                    heads, lines, held = [], [], 0
                    serial += 7919
        if heads:
            yield out()
        settle_memory()

    def collapse(batches):
        unzip = zstandard.ZstdDecompressor()
        number = TaskContext.get().partitionId() << 33
        counts = np.zeros(TABLE, np.uint32)

        def united(heads, lines):
            head = np.concatenate(heads)
            by, gone = _earliest(head)
            return [head[by]], [lines[i] for i in by.tolist()], gone

        def rows(head, gone, lines):
            nonlocal number
            n, m = len(head), len(gone)
            ids = pa.array([*range(number, number + n), *[None] * m], pa.int64())
            number += n
            places = [pa.array(np.concatenate((head[x], gone[x]))) for x in ("doc", "tie", "line")]
            return pa.RecordBatch.from_arrays([ids, *places, pa.array([*lines, *[None] * m], pa.binary()), pa.nulls(n + m, pa.binary())], names=["id", "doc", "tie", "line", "body", "counts"])

        for held in _bucketwise(batches):
            heads, lines, size = [np.zeros(0, _HEAD)], [], 0
            for head, body in held:
                if body is None:
                    yield rows(np.zeros(0, _HEAD), unpacked(head, _GONE), [])
                    continue
                head, body = unpacked(head, _HEAD), unzip.decompress(body)
                at = np.r_[0, np.cumsum(head["bytes"], dtype=np.int64)].tolist()
                heads.append(head)
                lines += [body[x:y] for x, y in zip(at, at[1:])]
                size += len(body)
                if size > SENT:  # many blocks of one bucket: copies go before more are read
                    heads, lines, gone = united(heads, lines)
                    yield rows(np.zeros(0, _HEAD), gone, [])
                    size = sum(map(len, lines)) // 2
            if lines:
                (head,), lines, gone = united(heads, lines)
                for k in range(0, len(head), 1024):
                    _, _, _, cut, words = line_sets(lines[k : k + 1024], False)
                    size = np.diff(cut)
                    entry, n = np.unique((words[np.repeat(size >= MEETS, size)] % _U(TABLE)).astype(np.int64), return_counts=True)
                    counts[entry] += n.astype(np.uint32)
                    yield rows(head[k : k + 1024], gone[:0], lines[k : k + 1024])
                yield rows(head[:0], gone, [])
        some = [k for k, part in enumerate(np.split(counts, SLICES)) if part.any()]
        none, parts = pa.nulls(len(some), pa.int64()), pa.array([packed(np.split(counts, SLICES)[k]) for k in some], pa.binary())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(some, pa.int32()), pa.nulls(len(some), pa.binary()), parts], names=["id", "doc", "tie", "line", "body", "counts"])
        settle_memory()

    sent = docs.select(_order(docs), F.xxhash64(docs[text]).alias("tie"), docs[text].alias("_t")).mapInArrow(deal, "bucket int, head binary, body binary")
    return by_bucket(sent).mapInArrow(collapse, "id bigint, doc bigint, tie bigint, line int, body binary, counts binary")


def _counts(held: DataFrame) -> np.ndarray:
    """Sets that hold a word, by the word's entry in the table."""
    parts = held.where("counts is not null").select("line", "counts")
    return joined(parts, TABLE, np.uint32, lambda x, y: np.minimum(x.astype(np.int64) + y, 2**32 - 1).astype(np.uint32))


def _levels(counts: np.ndarray) -> np.ndarray:
    """Rarity on a scale of 10 bits; 0 for words that no other set holds."""
    return np.floor(30 * np.log2(np.maximum(counts, 1))).astype(np.uint16)


def _records(ids, docs, lines, cut: np.ndarray, words: np.ndarray, counts: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """Prefix records of sets given by their words in one order of all: rarer first, then by hash."""
    size = np.diff(cut)
    large = size >= MEETS
    if not large.all():
        words = words[np.repeat(large, size)]
        ids, docs, lines, size = ids[large], docs[large], lines[large], size[large]
    if not len(size):
        return np.zeros(0, _RECORD)
    begins = np.r_[0, np.cumsum(size)[:-1]]
    spot = mix(words) >> _U(57)
    bit = _U(1) << (spot & _U(63))
    sign = [np.bitwise_xor.reduceat(np.where(half, bit, _U(0)), begins) for half in (spot < 64, spot >= 64)]
    owner = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(words)) - begins[owner]
    prefix = size - np.ceil(SIMILARITY * size - 1e-9).astype(np.int64) + 1
    near = np.flatnonzero(at < prefix[owner])
    near = near[levels[words[near] % _U(TABLE)] > 0]  # what no other set holds meets nothing
    owner = owner[near]
    out = np.zeros(len(near), _RECORD)
    out["key"], out["at"], out["size"], out["sign"], out["more"] = words[near] >> _U(32), np.minimum(at[near], 65535), size[owner], sign[0][owner], sign[1][owner]
    out["id"], out["doc"], out["line"] = ids[owner], docs[owner], lines[owner]
    parts = -(-counts[words[near] % _U(TABLE)].astype(np.int64) // TILE)
    if (parts == 1).all():
        return out
    # words of many sets: a record goes to every tile of its own part
    one, c = out[parts > 1], parts[parts > 1]
    other = np.concatenate([np.arange(n) for n in c])
    more, c = np.repeat(one, c), np.repeat(c, c)
    own = (mix(more["id"].astype(np.uint64)) % c.astype(np.uint64)).astype(np.int64)
    tile = np.minimum(own, other) * c + np.maximum(own, other) + 1
    more["key"] = (mix(more["key"].astype(np.uint64) + (tile.astype(np.uint64) << _U(32))) >> _U(32)).astype(np.uint32)
    return np.concatenate((out[parts == 1], more))


def _few(a, b, differ, sure, few):
    """The nearest partners of each b, their differences, whether they are surely similar, and whether b has others:
    `few` of them where the nearest is well within the bound, else WIDE times as many."""
    if not len(b):
        return a, b, differ, sure, np.zeros(0, bool)
    by = np.lexsort((a, differ, b))
    by = by[np.r_[True, (b[by][1:] != b[by][:-1]) | (a[by][1:] != a[by][:-1])]]
    a, b, differ, sure = a[by], b[by], differ[by], sure[by]
    first = np.searchsorted(b, b)
    most = np.where(sure[first], few, few * WIDE)
    more = np.searchsorted(b, b, "right") - first > most
    within = np.arange(len(b)) - first < most
    return a[within], b[within], differ[within], sure[within], more[within]


def _meet(r: np.ndarray, few: int, wanted):
    """Candidates among records of equal key: (a, b, differ, more), a standing before b; wanted says which ids may
    be b."""
    # larger groups first, and the sets of a group by size
    _, group, n = np.unique(r["key"], return_inverse=True, return_counts=True)
    meets = n > 1
    want = np.ones(len(r), bool) if wanted is None else wanted(r["id"])
    if wanted is not None:
        meets &= np.bincount(group, want, len(n)) > 0
    on = meets[group]
    r, group, want = r[on], group[on], want[on]
    by = np.lexsort((r["size"], group, -n[group]))
    r, group, want = r[by], group[by], want[by]
    n = n[group]
    rank = np.empty(len(r), np.int64)
    rank[np.lexsort((r["id"], r["line"], r["doc"]))] = np.arange(len(r))
    ids, size, at = (r[x].astype(np.int64) for x in ("id", "size", "at"))
    sign, second = r["sign"].copy(), r["more"].copy()
    # two sets of this size or less differ in so many words at most
    most = np.minimum(np.floor(2 * size * (1 - SIMILARITY) / (1 + SIMILARITY) + 1e-9), 255).astype(np.uint8)
    last = np.flatnonzero(np.r_[group[1:] != group[:-1], True]) if len(r) else group
    end = np.repeat(last, np.diff(np.r_[-1, last])) if len(r) else group  # the last of each record's group
    held, total = [], 0

    def fold():
        return _few(*(np.concatenate(x) for x in zip(*held)), few + 1)[:4]

    for d in range(1, int(n[0]) if len(n) else 0):
        m = int(np.searchsorted(-n, -d))  # records of groups of more than d
        differ = np.bitwise_count(sign[d:m] ^ sign[: m - d]) + np.bitwise_count(second[d:m] ^ second[: m - d])
        i = np.flatnonzero(differ <= most[d:m])
        i = i[end[i] >= i + d]
        j = i + d
        both, differ = size[i] + size[j], differ[i].astype(np.int64)
        need = np.ceil(SIMILARITY / (1 + SIMILARITY) * both - 1e-9)
        # a pair need only be seen at its first common word, so no word before it is common
        reach = np.minimum(size[i] - at[i], size[j] - at[j])
        ok = (size[i] >= SIMILARITY * size[j] - 1e-9) & (reach >= need) & (both - differ >= 2 * need)
        i, j, differ, sure = i[ok], j[ok], differ[ok], (2 * differ <= both - 2 * need)[ok]
        swap = rank[i] > rank[j]
        a, b = np.where(swap, j, i), np.where(swap, i, j)
        ok = want[b] & (ids[a] != ids[b])
        if ok.any():
            held.append((ids[a[ok]], ids[b[ok]], differ[ok], sure[ok]))
            total += int(ok.sum())
            if total > HELD:
                held, total = [fold()], 0
    if not held:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, bool),)
    a, b, differ, _, more = _few(*(np.concatenate(x) for x in zip(*held)), few)
    return a, b, differ, more


def _is_set(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bits[at >> 3] >> (7 - (at & 7)) & 1).astype(bool)


def _bitmap(rows: DataFrame, spots, bits: int) -> np.ndarray:
    """Packed bits, set at what spots(batch) gives for the batches of rows."""

    def make(batches):
        seen = np.zeros(bits, bool)
        for batch in batches:
            seen[spots(batch)] = True
        parts = np.split(np.packbits(seen), SLICES)
        some = [k for k in range(SLICES) if parts[k].any()]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packed(parts[k]) for k in some], pa.binary())], names=["slice", "part"])
        settle_memory()

    return joined(rows.mapInArrow(make, "slice int, part binary"), bits // 8, np.uint8, np.bitwise_or)


def _id_spot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (mix(ids.astype(np.uint64)) % _U(bits)).astype(np.int64)


def _id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap that holds all of the ids, and few others."""
    bits = min(FILTER, 1 << max(16, (8 * ids.count()).bit_length()))
    return _bitmap(ids, lambda batch: _id_spot(batch.column(0).to_numpy(), bits), bits)


def _classes(size: np.ndarray) -> np.ndarray:
    """Sizes on a scale on which sets that can be similar are at most 2 apart."""
    return np.log(size) * (2 / -np.log(SIMILARITY))


def _spot(key: np.ndarray, level: np.ndarray, bits: int) -> np.ndarray:
    return (mix(key.astype(np.uint64) << _U(32) | level.astype(np.uint64)) % _U(bits)).astype(np.int64)


def _recorded(batch, counts, levels):
    """Records of the sets (id, doc, line, body) of a batch, piece by piece."""
    for part, bodies in _pieces(batch):
        owner, _, _, cut, words = line_sets(bodies, False, levels)
        yield _records(*(part.column(k).to_numpy()[owner] for k in range(3)), cut, words, counts, levels)


def _meeting(sets: DataFrame, counts, wanted, number: int) -> np.ndarray:
    """A bitmap of the keys and sizes with which the wanted sets meet others."""
    bits = min(FILTER, 1 << max(22, (8192 * number).bit_length()))

    def spots(batch):
        mine = batch.filter(pa.array(_is_set(wanted.value, _id_spot(batch.column(0).to_numpy(), 8 * len(wanted.value)))))
        out, levels = [np.zeros(0, np.int64)], _levels(counts.value) if mine.num_rows else None
        for r in _recorded(mine, counts.value, levels):
            scale = _classes(r["size"]) + 2  # from 0
            low, high = np.floor(scale - 2 - 1e-6).astype(np.int64), np.floor(scale + 2 + 1e-6).astype(np.int64)
            out += [_spot(r["key"], np.minimum(low + k, high), bits) for k in range(6)]
        return np.concatenate(out)

    return _bitmap(sets.select("id", "doc", "line", "body"), spots, bits)


def _candidates(sets: DataFrame, counts, few: int, buckets: int, only: DataFrame | None = None) -> DataFrame:
    """Pairs of set ids, a standing before b, with their differences and whether b has others; with `only`, for the
    b of its ids (and for some others).  `counts` is the broadcast table of counts."""
    context = sets.sparkSession.sparkContext
    wanted = context.broadcast(None if only is None else _id_filter(only))
    meeting = context.broadcast(None if only is None else _meeting(sets, counts, wanted, only.count()))

    def deal(batches):
        held, size, levels = [], 0, _levels(counts.value)

        def out():
            r = np.concatenate(held)
            # the bucket grows with the key's hash; sorted records pack well
            spot = mix(r["key"].astype(np.uint64)) >> _U(32)
            r = r[np.argsort(spot << _U(16) | np.minimum(r["size"], 65535).astype(np.uint64), kind="stable")]
            cut = np.searchsorted((mix(r["key"].astype(np.uint64)) >> _U(32)) * _U(buckets) >> _U(32), np.arange(buckets + 1, dtype=np.uint64))
            some = [b for b in range(buckets) if cut[b] < cut[b + 1]]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([packed(r[cut[b] : cut[b + 1]]) for b in some], pa.binary())], names=["bucket", "records"])

        for batch in batches:
            for r in _recorded(batch, counts.value, levels):
                if meeting.value is not None:
                    level = np.floor(_classes(r["size"]) + 2)
                    r = r[_is_set(meeting.value, _spot(r["key"], level, 8 * len(meeting.value)))]
                held.append(r)
                size += len(r)
                if size > RECORDS:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()
        settle_memory()

    def meet(batches):
        only_ = None if wanted.value is None else lambda ids: _is_set(wanted.value, _id_spot(ids, 8 * len(wanted.value)))
        for held in _bucketwise(batches):
            a, b, differ, more = _meet(np.concatenate([unpacked(x, _RECORD) for (x,) in held]), few, only_)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(differ.astype(np.int32)), pa.array(more)], names=["a", "b", "differ", "more"])
        settle_memory()

    sent = sets.select("id", "doc", "line", "body").mapInArrow(deal, "bucket int, records binary")
    return by_bucket(sent).mapInArrow(meet, "a bigint, b bigint, differ int, more boolean")


def _listed(pairs: DataFrame, few: int) -> DataFrame:
    """For each b its candidates in order of difference, and whether there are more."""
    c = F.sort_array(F.collect_set(F.struct("differ", "a")))
    return pairs.groupBy("b").agg(c.alias("c"), F.max("more").alias("more")).select("b", F.transform("c", lambda x: x["a"]).alias("c"), "more")


def _words(line: bytes) -> set[bytes]:
    return set(line.lower().split())


def _similar(x: set[bytes], y: set[bytes]) -> bool:
    common = len(x & y)
    return common >= SIMILARITY * (len(x) + len(y) - common) - 1e-9


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Ids b of the pairs (a, b) whose words reach the similarity, stored.  Only lines that are in pairs are shuffled, and
    all lines are read once."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    shared = sets.sparkSession.sparkContext.broadcast(_id_filter(ends))

    def keep(batches):
        for batch in batches:
            yield batch.filter(pa.array(_is_set(shared.value, _id_spot(batch.column(0).to_numpy(), 8 * len(shared.value)))))

    def run(batches):
        for batch in batches:
            out = []
            for b, x, y in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                if _similar(_words(x.as_py()), _words(y.as_py())):
                    out.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["id"])
        settle_memory()

    held = stored(sets.select("id", "body").mapInArrow(keep, "id bigint, body binary"))
    first = pairs.join(held.select(F.col("id").alias("a"), F.col("body").alias("x")), "a").select("b", "x")
    both = first.join(held.select(F.col("id").alias("b"), F.col("body").alias("y")), "b")
    out = stored(both.select("b", "x", "y").mapInArrow(run, "id bigint").distinct())
    discard(held)
    return out


def _compared(sets: DataFrame, wanted: DataFrame, counts: np.ndarray) -> DataFrame | None:
    """Ids of the wanted sets that are similar to an earlier one, by comparing them with all sets that hold a word of
    their prefixes; None if that would be too many."""
    if wanted.count() > OPEN:
        return None
    mine = stored(sets.join(F.broadcast(wanted), "id", "left_semi"))
    rows = mine.collect() if mine.agg(F.sum(F.length("body"))).first()[0] <= OPEN_BYTES else None
    discard(mine)
    if rows is None:
        return None
    pairs, own, under = 0, [], {}
    for r in rows:
        words = sorted(all_ := _words(bytes(r.body)))
        sizes = np.array([len(w) for w in words])
        entry = counts[hashes(b"".join([*words, bytes(8)]), np.cumsum(sizes) - sizes, sizes, SEEDS[:1])[0] % _U(TABLE)]
        # a set that holds none of these has too few of the words
        prefix = np.argsort(entry, kind="stable")[: len(words) - int(np.ceil(SIMILARITY * len(words) - 1e-9)) + 1]
        pairs += int(entry[prefix].sum(dtype=np.int64))
        for k in prefix.tolist():
            under.setdefault(words[k], []).append(len(own))
        own.append(((r.doc, r.line, r.id), all_))
    if pairs > OPEN_PAIRS:
        return None
    shared = sets.sparkSession.sparkContext.broadcast((own, under, frozenset(under)))

    def run(batches):
        own, under, keys = shared.value
        for batch in batches:
            out = set()
            for *place, body in zip(*(batch.column(n).to_pylist() for n in ("doc", "line", "id", "body"))):
                words = body.lower().split()
                if met := keys.intersection(words):
                    words, place = set(words), tuple(place)
                    out.update(own[k][0][2] for k in {k for w in met for k in under[w]} if place < own[k][0] and _similar(words, own[k][1]))
            yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.int64())], names=["id"])
        settle_memory()

    return sets.select("doc", "line", "id", "body").mapInArrow(run, "id bigint").distinct()


def repeated_sets(held: DataFrame, buckets: int, few: int = FEW) -> DataFrame:
    """Ids of the sets of _sets() that are similar to an earlier one."""
    sets = held.where("id is not null").select("id", "doc", "line", "body")
    counts = sets.sparkSession.sparkContext.broadcast(_counts(held))
    found = stored(_listed(_candidates(sets, counts, few, buckets), few))
    settled = _verified(found.select("b", F.col("c")[0].alias("a")), sets)
    while True:
        open_ = found.where((F.size("c") > 1) | F.col("more")).join(settled, F.col("b") == F.col("id"), "left_anti")
        rest = stored(open_.select("b", F.explode(F.slice("c", 2, F.size("c"))).alias("a"))) if few == FEW else stored(open_.select("b", F.explode("c").alias("a")))
        if not rest.isEmpty():
            settled = stored(settled.unionByName(_verified(rest, sets)).distinct())
        discard(rest)
        wanted = stored(found.where("more").select(F.col("b").alias("id")).join(settled, "id", "left_anti"))
        if wanted.isEmpty():
            discard(found, wanted)
            return settled
        last = _compared(sets, wanted, counts.value)
        if last is not None:
            settled = stored(settled.unionByName(last).distinct())
            discard(found, wanted)
            return settled
        few *= GROWTH
        again = _listed(_candidates(sets, counts, few, buckets, wanted), few)
        found, before = stored(again.join(wanted, F.col("b") == F.col("id"), "left_semi")), found
        discard(before, wanted)


def removed_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc, tie (hash of the text) and lines, the numbers of the lines that go, for documents that lose any."""
    held = stored(_sets(docs, text))
    repeated = repeated_sets(held, 4 * bucket_count(docs, BUCKET)).withColumnRenamed("id", "_r")
    similar = held.where("id is not null").select("id", "doc", "tie", "line").join(repeated, F.col("id") == F.col("_r"), "left_semi").select("doc", "tie", "line")
    gone = similar.unionByName(held.where("id is null and counts is null").select("doc", "tie", "line"))
    return gone.groupBy("doc", "tie").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """All columns of docs with the text less its repeated lines, and removed, their numbers (from 0), which
    replaces a column of that name."""
    names, at = docs.columns, docs.columns.index(text)
    columns = [f"_k{i}" for i in range(len(names))]
    gone = removed_lines(docs, text).select(F.col("doc").alias("_doc"), F.col("tie").alias("_tie"), F.col("lines").alias("_lines"))
    body = docs.select(*[docs[c].alias(k) for c, k in zip(names, columns)], _order(docs).alias("_at"), F.xxhash64(docs[text]).alias("_hash"))
    out = body.join(gone, (F.col("_at") == F.col("_doc")) & (F.col("_hash") == F.col("_tie")), "left").select(*columns, "_lines")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            kept, lines = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            for i, some in enumerate(lines):
                if some and kept[i] is not None:
                    some = set(some)
                    kept[i] = "\n".join([x for k, x in enumerate(kept[i].split("\n")) if k not in some])
            arrays = batch.columns[:-1]
            arrays[at] = pa.array(kept, batch.column(at).type)
            removed = pa.array([x or [] for x in lines], batch.column(batch.num_columns - 1).type)
            yield pa.RecordBatch.from_arrays([*arrays, removed], names=[*columns, "_lines"])
        settle_memory()

    schema = T.StructType([T.StructField(k, docs.schema[c].dataType) for c, k in zip(names, columns)] + [T.StructField("_lines", T.ArrayType(T.IntegerType()))])
    out = out.mapInArrow(run, schema)
    return out.select(*[F.col(k).alias(c) for c, k in zip(names, columns) if c != "removed"], F.col("_lines").alias("removed"))


def op5(spark, sf_dir: str) -> DataFrame:
    """Per document: its lines, how many go, and their numbers."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = removed_lines(docs).select(F.col("doc").alias("_doc"), F.col("tie").alias("_tie"), "lines")
    at = docs.select("doc_id", _order(docs), F.xxhash64("text").alias("tie"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("bigint").alias("n_lines"))
    out = at.join(gone, (F.col("doc") == F.col("_doc")) & (F.col("tie") == F.col("_tie")), "left")
    return out.select("doc_id", "n_lines", F.coalesce(F.size("lines"), F.lit(0)).cast("bigint").alias("n_removed"), F.coalesce(F.concat_ws(",", F.col("lines").cast("array<string>")), F.lit("")).alias("removed"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: repeated lines go, and with them documents of which no word is left.

    Null and wordless texts stay; rows with an equal id and text lose the same lines, so they stay or go together;
    null ids stand last; an empty table gives an empty result; all columns are kept, whatever their names.
    """
    names = docs.columns
    columns = [f"_k{i}" for i in range(len(names))]
    body = docs.select(*[docs[c].alias(c if c in ("doc_id", "text") else k) for c, k in zip(names, columns)])
    out = dedup(body)
    emptied = (F.size("removed") > 0) & (F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")) == 0)
    kept = out.where(~F.coalesce(emptied, F.lit(False)))
    return kept.select(*[F.col(c if c in ("doc_id", "text") else k).alias(c) for c, k in zip(names, columns)])
