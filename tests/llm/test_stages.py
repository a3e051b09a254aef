"""The pipeline's stages and run() on nulls, repeated rows, empty tables and clashing column names."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from arborframe.llm import decontaminate, lines, mixing, simhash, toxicity

CLASHES = ["_doc", "_tie", "_h", "_scored", "_searched", "_id", "_k0", "_d0", "score", "removed", "n_items", "fp", "root", "size", "_text", "_at"]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{c} string" for c in CLASHES)
WORDS = "amber birch cedar dune ember fjord grove heath islet jetty knoll ledge marsh notch oasis plain quarry ridge shoal tundra".split()


def clean(k: int) -> str:
    return " ".join(f"{WORDS[(k * 7 + i * (k % 5 + 1)) % 20]}{k}" for i in range(12))


@pytest.fixture()
def sf(spark, tmp_path):
    rows = [(i, clean(i), "en" if i % 2 else None, [None, "a", "b"][i % 3], 1) for i in range(40)]
    rows += [(100 + i, f"you idiot {clean(60 + i)}", "en", "a", 1) for i in range(30)]
    rows += [(None, clean(200), "en", "a", 1), (None, clean(201), None, None, None), (300, None, "en", "a", 1), (301, "", "en", "b", 1)]
    rows += [(302, clean(5) + "\n" + clean(302), "en", "a", 1), (303, clean(6), "de", "b", 1), (303, clean(6), "de", "b", 1), (304, f"{clean(310)} {clean(311)} leaked {clean(400)} and {clean(401)}", "en", "a", 1)]
    docs = spark.createDataFrame([(*r, *[c for c in CLASHES]) for r in rows], SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, int(i >= 100)) for i in [*range(40), *range(100, 130)]], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, clean(400)), (2, clean(401)), (3, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def ids(df):
    return Counter(r.doc_id for r in df.collect())


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    every = ids(docs)
    for stage in (toxicity.stage, lines.stage, simhash.stage, decontaminate.stage):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        assert all(r[c] == c for r in out.collect() for c in CLASHES)
        assert stage(spark, docs.limit(0), sf).count() == 0
    kept = ids(toxicity.stage(spark, docs, sf))
    assert all(i is None or not 100 <= i < 130 for i in kept) and kept == Counter({k: n for k, n in every.items() if k is None or not 100 <= k < 130})
    kept = {(r.doc_id, r.text) for r in lines.stage(spark, docs, sf).collect()}
    assert (302, clean(302)) in kept and 303 not in {i for i, _ in kept} and {(300, None), (301, ""), (None, clean(200)), (None, clean(201))} <= kept
    kept = ids(simhash.stage(spark, docs, sf))
    assert kept[None] == 2 and kept[6] == 1 and 303 not in kept and kept[300] == 1 and 301 not in kept
    kept = ids(decontaminate.stage(spark, docs, sf))
    assert kept == Counter({k: n for k, n in every.items() if k != 304})
    mixed = mixing.stage(spark, docs, sf)
    assert ids(mixed) == every and mixing.stage(spark, docs.limit(0), sf).count() == 0


def test_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    want = [*range(40), None, None, 300, 302]
    assert Counter(r.doc_id for r in rows) == Counter(want)
    # the mix, from its definition: shares by weight, capped at 3 times a source's size
    size = Counter()
    for r in rows:
        size[r.source] += r["size"]
    weight = dict(zip(sorted((s for s in size if s is not None)) + [None], (1, 2, 3)))
    target, capped = {}, set()
    while True:
        rest = sum(size.values()) - sum(3 * size[s] for s in capped)
        target = {s: 3.0 * size[s] if s in capped else rest * weight[s] / sum(w for t, w in weight.items() if t not in capped) for s in size}
        over = {s for s in size if s not in capped and target[s] > 3 * size[s]}
        if not over:
            break
        capped |= over
    for s in size:
        mine = [r for r in rows if r.source == s]
        assert mine[0].target == pytest.approx(target[s]) and all(r.taken <= 3 * r["size"] for r in mine)
        assert sum(r.taken for r in mine) == pytest.approx(target[s], rel=0.05)


def test_run_on_empty_tables(spark, sf, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").where(F.lit(False)).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
