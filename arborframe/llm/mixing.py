r"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

Every slot i of the schedule is a golden-ratio point (an exact 32-bit Fibonacci step), mapped through the
cumulative targets to a source; slots are ranked within their source.  Each source's documents stand in the
order of a hash, as one stream of words, cut into blocks of equally many words; the slot of rank r takes block
r mod n of its source's n blocks.  A source of fewer than FEW blocks, for which a slot or a short last block would
be too coarse, takes its target's words outright: whole rounds of its stream, then its first words.  Ranks and word offsets come from two-level running sums (within a piece of a
source, then over the pieces), so a source of any size is spread over many tasks.

A text's size is its words `[^\x20\x09-\x0D]+`; null texts have size 0 and are never taken.  Sources stand by
code point, null last.  Repeated rows are documents of their own; an empty table gives an empty result; if all
sizes are 0 every target is 0.  Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from arborframe.llm.common import WORD, stored, table

WEIGHTS = (1, 2, 3)
LIMIT = 3
#: A block has total / SLOTS words, but no more than BLOCK; pieces are what one task of a running sum orders.
SLOTS, BLOCK = 1 << 18, 4096
PIECES = 256
FEW = 256
STEP, POINTS = 2654435769, 1 << 32  # 2^32 over the golden ratio, odd: i * STEP mod 2^32 visits every point once


def sizes(docs: DataFrame, keep: list[str], text: str = "text", source: str = "source") -> DataFrame:
    """Columns _k0.. of `keep`, source, size, and a hash by which documents are shuffled."""
    body = F.coalesce(docs[text], F.lit(""))
    return docs.select(
        *[docs[c].alias(f"_k{i}") for i, c in enumerate(keep)],
        docs[source].cast("string").alias("source"),
        F.regexp_count(body, F.lit(WORD)).cast("bigint").alias("size"),
        F.conv(F.substring(F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit("|"), body)), 1, 15), 16, 10).cast("bigint").alias("place"),
    )


def targets(sized: DataFrame) -> DataFrame:
    """A row for each source: source, source_size, weight, target, low and high (its share of the 2^32 points).

    Targets are min(LIMIT * size, level * weight) for the one level at which they add up to all sizes: what
    resharing the excess by weight until none is above ends in.  One row a source; nothing larger is ordered here.
    """
    every = Window.partitionBy(F.lit(0))
    total = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    total = total.withColumn("n", F.row_number().over(by_name) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("n") % len(WEIGHTS) + 1).cast("int")).cast("double"))
    total = total.withColumn("cap", F.col("source_size") * F.lit(float(LIMIT)))
    full = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "n")
    before = full.rowsBetween(Window.unboundedPreceding, -1)
    # the level if the sources before this one are at their caps and this and the later ones are not
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    total = total.withColumn("level", level)
    # it grows while the next source's cap lies under it and falls after, so the right one is the largest
    total = total.withColumn("level", F.max("level").over(every))
    total = total.withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
    share = F.sum("target").over(by_name) / F.greatest(F.sum("target").over(every), F.lit(1e-300))
    total = total.withColumn("high", F.when(F.col("n") == F.max("n").over(every), F.lit(POINTS)).otherwise(F.floor(share * POINTS)).cast("bigint"))
    total = total.withColumn("low", F.coalesce(F.lag("high").over(by_name), F.lit(0)))
    all_ = F.sum("source_size").over(every)
    return total.select("source", "source_size", "weight", "target", "n", "low", "high", all_.alias("total"))


def _running(df: DataFrame, group: list[str], piece: str, order: list, amount, name: str) -> DataFrame:
    """Adds the sum of `amount` over the rows before, in order of (piece, order) within the group."""
    parts = df.groupBy(*group, piece).agg(F.sum(amount).alias("_part"))
    over = Window.partitionBy(*group).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col(piece).alias("_piece"), F.coalesce(F.sum("_part").over(over), F.lit(0)).alias("_start"))
    same = F.col(piece) == F.col("_piece")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    inside = Window.partitionBy(*group, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(parts, same)
    return out.withColumn(name, F.col("_start") + F.col("_inside")).drop("_start", "_inside", "_piece", *[f"_g{i}" for i in range(len(group))])


def schedule(goals: DataFrame) -> DataFrame:
    """slot, n (its source's number), rank in its source, words in a block; one row a slot."""
    spark = goals.sparkSession
    block = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.col("total") / SLOTS))).cast("bigint")
    frame = goals.agg(F.sort_array(F.collect_list(F.struct("low", "high", "n"))).alias("shares"), F.max("total").alias("total")).withColumn("block", block).where("total > 0")
    slots = frame.select("shares", "block", "total", F.explode(F.sequence(F.lit(0), F.floor((F.col("total") / F.col("block") - 1) / PIECES).cast("bigint"))).alias("run")).repartition(spark.sparkContext.defaultParallelism * 2, "run")
    slots = slots.select("shares", "block", "total", "run", F.explode(F.sequence(F.col("run") * PIECES, F.col("run") * PIECES + PIECES - 1)).alias("slot")).where(F.col("slot") < F.ceil(F.col("total") / F.col("block")))
    point = F.pmod(F.col("slot") * STEP, F.lit(POINTS))
    held = F.filter("shares", lambda s: (s["low"] <= point) & (point < s["high"]))
    slots = slots.select("slot", "block", "run", F.get(held, F.lit(0))["n"].alias("n"), F.lit(1).cast("bigint").alias("_one"))
    # runs are gathered into pieces so that a running sum over the pieces of a source stays short
    slots = slots.withColumn("piece", F.floor(F.col("run") / 64).cast("bigint"))
    return _running(slots, ["n"], "piece", ["slot"], F.col("_one"), "rank").select("slot", "n", "rank", "block")


def mix(docs: DataFrame, keep: list[str], text: str = "text", source: str = "source") -> DataFrame:
    """Every row's columns `keep`, size, source_size, target and taken (words the mix takes, repeats counted)."""
    sized = stored(sizes(docs, keep, text, source))  # the texts are read once
    goals = stored(targets(sized))
    number = goals.select(F.col("source").alias("_source"), "n", "source_size", "target", F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.col("total") / SLOTS))).cast("bigint").alias("block"))
    placed = sized.join(F.broadcast(number) if goals.count() <= 100_000 else number, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    # the 60 bits of the shuffling hash in PIECES ranges
    placed = placed.withColumn("piece", F.shiftright("place", 60 - (PIECES - 1).bit_length()))
    keys = [c for c in sized.columns if c.startswith("_k")]
    placed = _running(placed, ["n"], "piece", ["place", *keys], F.col("size"), "start")

    # uses of each block: full rounds of the source's blocks and a part of the next; the round's last block may be short
    used = schedule(goals).join(F.broadcast(number.select("n", "source_size")) if goals.count() <= 100_000 else number.select("n", "source_size"), "n").where("source_size > 0")
    blocks = F.ceil(F.col("source_size") / F.col("block")).cast("bigint")
    # rank r stands at word r * block of the endlessly repeated stream; what lies above LIMIT rounds is cut
    used = used.withColumn("round", F.floor(F.col("rank") / blocks).cast("bigint")).where(F.col("round") < LIMIT)
    used = used.groupBy("n", F.pmod("rank", blocks).alias("no")).agg(F.count("*").alias("uses"))

    pieces = placed.where("size > 0").select("n", "start", "size", "block", F.explode(F.sequence(F.floor(F.col("start") / F.col("block")), F.floor((F.col("start") + F.col("size") - 1) / F.col("block")))).alias("no"))
    overlap = F.least(F.col("start") + F.col("size"), (F.col("no") + 1) * F.col("block")) - F.greatest("start", F.col("no") * F.col("block"))
    taken = pieces.join(used, ["n", "no"]).groupBy(F.col("n").alias("_n"), F.col("start").alias("_at")).agg(F.sum(overlap * F.col("uses")).alias("taken"))
    # a document of words is alone at its offset; one without words is never taken
    out = placed.join(taken, (F.col("n") == F.col("_n")) & (F.col("start") == F.col("_at")) & (F.col("size") > 0), "left")
    small = (F.col("block") > 1) & (F.col("source_size") < FEW * F.col("block"))
    goal, whole = F.round("target").cast("bigint"), F.greatest("source_size", F.lit(1))
    outright = F.floor(goal / whole).cast("bigint") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("start") + F.col("size"), goal % whole) - F.col("start"))
    out = out.withColumn("taken", F.when(small, outright).otherwise(F.col("taken")))
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)], F.col("size").alias("size"), "source_size", F.col("target").cast("double").alias("target"), F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def op4(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), ["doc_id"])


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline's last stage: what the mix takes of every document it was given."""
    return mix(docs, ["doc_id", "source"])
