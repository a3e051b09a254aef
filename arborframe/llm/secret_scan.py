r"""Secret scan over an incremental blob ledger.

Every text is addressed by its SHA-256.  A ledger row says what one version of one rule found in one blob
(possibly nothing); a run scans only the pairs of blob and rule version that the ledger lacks, each distinct
blob once however many rows hold it, and joins the findings back to all rows.

BASE are the contract's three rules; ADDED finds private keys, logins in addresses, tokens of known forms, and long
runs of mixed characters whose entropy is that of chance.  update() keeps a ledger in a folder from run to run.  The
query is two versions of a history: the ledger of a run with the base rules is stored, and the run with all rules adds
only the pairs that it lacks.

Spans are (start, end) in code points, end exclusive.  A null text is the empty blob; repeated rows each get
their blob's findings; an empty table gives an empty report and an empty ledger; very long texts are scanned
whole; extra columns of the documents are carried or ignored, never looked up by name.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from arborframe.llm.common import settle_memory, stored, table, texts

ASSIGN = re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
_KEYS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_IS_HEX = bytes(49 if c in b"0123456789abcdef" else 48 for c in range(256))


def _assign(text: bytes):
    low = text.lower()
    if any(k in low for k in _KEYS):
        yield from (m.span() for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6)


def _access(text: bytes):
    if b"AKIA" in text:
        yield from (m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 20)


def _hex(text: bytes):
    if b"1" * 24 in text.translate(_IS_HEX):
        yield from (m.span() for m in HEX.finditer(text) if m.end() - m.start() >= 24)


_PRIVATE = re.compile(rb"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----(?:[^-]|-(?!----))*(?:-----END [A-Z0-9 ]*PRIVATE KEY-----)?")
_SCHEME = re.compile(rb"[A-Za-z][A-Za-z0-9+.-]*$")
_LOGIN = re.compile(rb"://[^\s/:@]++:[^\s/@]++@[^\s/?#]+")
_TOKEN = re.compile(rb"gh[pousr]_[A-Za-z0-9]{36,}|xox[abprs]-[A-Za-z0-9-]{10,}|eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}")


def _private(text: bytes):
    if b"PRIVATE KEY-----" in text:
        yield from (m.span() for m in _PRIVATE.finditer(text))


def _login(text: bytes):
    if b"://" in text and b"@" in text:
        for m in _LOGIN.finditer(text):
            scheme = _SCHEME.search(text, max(0, m.start() - 32), m.start())
            if scheme:
                yield scheme.start(), m.end()


def _token(text: bytes):
    if b"eyJ" in text or b"gh" in text or b"xox" in text:
        yield from (m.span() for m in _TOKEN.finditer(text))


#: Characters and bits a character from which a run of letters of both cases and digits counts as drawn by chance.
RUN, BITS = 32, 4.3
_CHANCE = re.compile(rb"[A-Za-z0-9+/_-]{%d,}+" % RUN)
_IN_RUN = bytes(49 if _CHANCE.fullmatch(bytes([c]) * RUN) else 48 for c in range(256))
_MIXED = [re.compile(x) for x in (rb"[A-Z]", rb"[a-z]", rb"[0-9]")]


def _chance(text: bytes):
    if b"1" * RUN in text.translate(_IN_RUN):
        for m in _CHANCE.finditer(text):
            run = m.group()
            if all(r.search(run) for r in _MIXED) and sum(n * math.log2(len(run) / n) for n in Counter(run).values()) >= BITS * len(run):
                yield m.span()


#: kind -> (version, function from the UTF-8 text to byte spans); kinds in this order break ties of start.
BASE = {"assign": (1, _assign), "access": (1, _access), "hex": (1, _hex)}
ADDED = {"private_key": (1, _private), "login": (1, _login), "token": (1, _token), "chance": (1, _chance)}
RULES = BASE | ADDED
LEDGER = "blob string, kind string, version int, spans array<struct<begin:bigint,end:bigint>>"


def scan_blob(text: bytes, kind: str, rules=RULES) -> list[tuple[int, int]]:
    out, at, points = [], 0, 0
    for a, b in rules[kind][1](text):
        points += len(text[at:a].decode("utf-8", "replace"))
        at = a
        out.append((points, points + len(text[a:b].decode("utf-8", "replace"))))
    return out


def address(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("blob", F.sha2(F.coalesce(docs[text], F.lit("")).cast("binary"), 256))


def new_entries(docs: DataFrame, ledger: DataFrame | None = None, rules=RULES, text: str = "text") -> DataFrame:
    """Ledger rows for the pairs of blob and rule version that the ledger lacks."""
    body = docs.select(F.coalesce(docs[text], F.lit("")).alias("text"))
    blobs = address(body).groupBy("blob").agg(F.first("text").alias("text"))
    wanted = F.array(*[F.lit(f"{k}@{v}") for k, (v, _) in rules.items()])
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.collect_set(F.format_string("%s@%d", "kind", "version")).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").select("blob", "text", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
        blobs = blobs.where(F.size("todo") > 0)
    else:
        blobs = blobs.select("blob", "text", wanted.alias("todo"))

    def run(batches):
        kind_of = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            rows = []
            for blob, t, todo in zip(batch.column(0).to_pylist(), texts(batch.column(1)), batch.column(2).to_pylist()):
                for x in todo:
                    kind, version = x.split("@")
                    rows.append((blob, kind, int(version), [{"begin": a, "end": b} for a, b in scan_blob(t, kind, rules)]))
            b, k, v, s = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(b, pa.string()), pa.array(k, pa.string()), pa.array(v, pa.int32()), pa.array(s, kind_of)], names=["blob", "kind", "version", "spans"])
        settle_memory()

    return blobs.mapInArrow(run, LEDGER)


def update(docs: DataFrame, path: str, rules=RULES, text: str = "text") -> DataFrame:
    """The ledger kept at `path`, a shared folder, after a run over docs that adds what it lacks.

    Each run is a folder of its own below `path`, written whole or not at all, so that a run that failed is run again;
    pairs that two runs at one time both scanned are in it twice and reported once.  The first run starts with no
    ledger.
    """
    spark = docs.sparkSession
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    glob = f"{path}/run-*"

    def whole():
        done = files.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{glob}/_SUCCESS"))
        return [str(x.getPath().getParent().toString()) for x in done or []]

    def read(runs):
        return spark.read.schema(LEDGER).parquet(*runs) if runs else None

    new_entries(docs, read(whole()), rules, text).write.parquet(f"{path}/run-{uuid.uuid4().hex}")
    return read(whole())


def report(docs: DataFrame, ledger: DataFrame, rules=RULES, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Columns `keep` of every row with its findings: array of (begin, kind's rank, kind, end), sorted.

    Only blobs with findings are joined, by content address; AQE splits a hot blob's rows.
    """
    keep = keep if keep is not None else [c for c in docs.columns if c != text]
    order = F.create_map(*[x for i, k in enumerate(rules) for x in (F.lit(k), F.lit(i))])
    current = F.lit(False)
    for k, (v, _) in rules.items():
        current = current | ((F.col("kind") == k) & (F.col("version") == v))
    found = (
        ledger.where(current & (F.size("spans") > 0))
        .groupBy(F.col("blob").alias("_blob"))
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("spans", lambda s: F.struct(s["begin"].alias("begin"), order[F.col("kind")].alias("rank"), F.col("kind").alias("kind"), s["end"].alias("end"))))))).alias("findings"))
    )
    paths = docs.select(*keep, F.sha2(F.coalesce(docs[text], F.lit("")).cast("binary"), 256).alias("_blob"))
    return paths.join(found, "_blob", "left").drop("_blob")


def op8(spark, sf_dir: str) -> DataFrame:
    """The contract's digest, after a run with the base rules and one with all rules that scans what the first did not."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ledger = stored(new_entries(docs, rules=BASE))
    ledger = ledger.unionByName(stored(new_entries(docs, ledger)))
    found = report(docs, ledger, keep=["doc_id"])

    def listed(kinds):
        some = F.filter("findings", lambda x: x["kind"].isin(*kinds))
        return F.coalesce(F.concat_ws(",", F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["begin"].cast("string"), x["end"].cast("string")))), F.lit(""))

    count = lambda k: F.coalesce(F.size(F.filter("findings", lambda x: x["kind"] == k)), F.lit(0)).cast("bigint")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in BASE], F.sha2(listed(BASE), 256).alias("base_sha256"), listed(RULES).alias("spans"))
