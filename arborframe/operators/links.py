"""Pointers and unions."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from arborframe.plans.places import ranged, starts


def dictionary(df: DataFrame, columns: list[str], name: str = "_pos") -> tuple[DataFrame, DataFrame]:
    """(df with positions for the columns, the table of their distinct values): equal values share a position.

    The position is a 64-bit hash, so that no rank over all values is needed.
    """
    target = df.select(*columns).distinct().withColumn(name, F.xxhash64(*columns))
    return df.withColumn(name, F.xxhash64(*columns)).drop(*columns), target


def deref(df: DataFrame, pointer: str, target: DataFrame, position: str, fields: list[str], nullable: bool = True) -> DataFrame:
    """The target's fields beside each pointer.  Spark broadcasts the target only if its size is known to be small."""
    to = target.select(F.col(position).alias("_at"), *fields)
    return df.join(to, df[pointer] == F.col("_at"), "left" if nullable else "inner").drop("_at")


def chase(spark, nodes: DataFrame, node: str, edge: str, start: int, most: int = 1000) -> DataFrame:
    """(depth, node) along an internal pointer from a start, by a recursive query that ends at null or after `most`."""
    view = f"_chased_{uuid.uuid4().hex}"
    nodes.select(F.col(node).alias("_node"), F.col(edge).cast("bigint").alias("_edge")).where("_edge is not null").createOrReplaceTempView(view)
    try:
        return spark.sql(f"""with recursive p(depth, node) max recursion level {int(most) + 1} as (select 0, cast({int(start)} as bigint) union all
            select depth + 1, _edge from p join {view} on _node = p.node where depth < {int(most)})
            select depth, node from p""")
    finally:
        spark.catalog.dropTempView(view)  # the query holds its plan


def union(*cases: tuple[Column, Column]) -> Column:
    """A tagged value: the first (condition, value) that holds; null if none does."""
    tag = F.lit(None).cast("tinyint")
    for i, (c, _) in reversed([*enumerate(cases)]):
        tag = F.when(c, F.lit(i).cast("tinyint")).otherwise(tag)
    out = F.struct(tag.alias("tag"), *[F.when(tag == i, v).alias(f"u{i}") for i, (_, v) in enumerate(cases)])
    return F.when(tag.isNotNull(), out)


def case(u: Column, i: int) -> Column:
    return u["tag"] == i


def cast(u: Column, i: int) -> Column:
    return F.when(u["tag"] == i, u[f"u{i}"]).when(u.isNotNull(), F.raise_error(F.lit(f"the value is not alternative {i}")))


def common(u: Column, dtype: T.StructType, name: str | None = None, to: str = "double") -> Column:
    """The value, or a field all alternatives have, as one type."""
    parts = [u[f.name] if name is None else u[f.name][name] for f in dtype.fields if f.name != "tag"]
    return F.coalesce(*[p.cast(to) for p in parts])


def _comparable(a: T.DataType, b: T.DataType) -> bool:
    return a == b or isinstance(a, T.NumericType) and isinstance(b, T.NumericType)


def equal(u: Column, dtype: T.StructType, other: Column, other_type: T.DataType) -> Column:
    """Whether a union's value equals another's, or a plain value: alternatives of kinds that cannot be equal are
    unequal, and two nulls are equal."""
    mine = [f for f in dtype.fields if f.name != "tag"]
    if isinstance(other_type, T.StructType) and "tag" in other_type.names:
        theirs = [f for f in other_type.fields if f.name != "tag"]
        pairs = [(u["tag"] == i) & (other["tag"] == j) & u[f.name].eqNullSafe(other[g.name]) for i, f in enumerate(mine) for j, g in enumerate(theirs) if _comparable(f.dataType, g.dataType)]
    else:
        pairs = [(u["tag"] == i) & u[f.name].eqNullSafe(other) for i, f in enumerate(mine) if _comparable(f.dataType, other_type)]
    some = functools.reduce(lambda a, b: a | b, pairs, F.lit(False))
    return F.coalesce(some, F.lit(False)) | (u.isNull() & other.isNull())


def counts_to_offsets(df: DataFrame, count: str, order: str) -> DataFrame:
    """start and stop of each list of `count` items laid end to end: running sums within ranges of the order, and over
    the ranges (one row each)."""
    parts = ranged(df, order)
    within = Window.partitionBy("_part").orderBy("_in").rowsBetween(Window.unboundedPreceding, 0)
    out = parts.withColumn("_sum", F.sum(count).over(within)).join(F.broadcast(starts(parts, F.sum(count))), F.col("_part") == F.col("_p"))
    return out.withColumn("stop", F.col("_start") + F.col("_sum")).withColumn("start", F.col("stop") - F.col(count)).drop("_part", "_p", "_in", "_sum", "_start")


def union_offsets(df: DataFrame, tag: str, order: str) -> DataFrame:
    """Each row's place among those of its tag; a tag of many rows is spread over ranges of the order."""
    parts = ranged(df, tag, order)
    place = F.row_number().over(Window.partitionBy("_part", tag).orderBy("_in"))
    out = parts.withColumn("_place", place).join(starts(parts, F.count("*"), tag), (F.col("_part") == F.col("_p")) & F.col(tag).eqNullSafe(F.col("_g0")))
    return out.withColumn("offset", (F.col("_start") + F.col("_place") - 1).cast("int")).drop("_part", "_p", "_g0", "_in", "_place", "_start")
