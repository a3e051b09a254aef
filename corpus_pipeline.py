"""The training-data pipeline: toxicity, line dedup, near-duplicates, decontamination, source mix."""

from __future__ import annotations

import os
import uuid

from arborframe.llm import decontaminate, lines, mixing, simhash, toxicity
from arborframe.llm.common import checkpoint_dir, table

STAGES = [
    ("toxicity", toxicity.stage),
    ("line_dedup", lines.stage),
    ("near_duplicates", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("source_mix", mixing.stage),
]

#: A trained model decides in the first stage, so SQL cannot say what the rows are.
ORACLE_SQL = None


def run(spark, sf_dir: str):
    """Applies the stages to documents; each one's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        where = os.path.join(checkpoint_dir(spark), f"pipeline-{uuid.uuid4().hex}-{name}")
        stage(spark, docs, sf_dir).write.parquet(where)
        docs = spark.read.parquet(where)
    return docs
