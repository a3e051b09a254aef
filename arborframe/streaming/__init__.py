"""Row-local operators on streams.

Every operator of NestedFrame but reduce, split of rows and positions is row-local, so a frame over a streaming
DataFrame works as it is; running() is reduce as a keyless streaming aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from arborframe.functions.translate import Tally, Untranslatable, column
from arborframe.operators.frame import NestedFrame


def running(frame: NestedFrame, tally, fcn, args=(), at: str = "") -> DataFrame:
    """A frame's fold by +, min or max as an aggregate for update or complete output."""
    df, item, dtype = frame._items(at)
    made = frame._function(fcn, args, dtype)(item, Tally())
    if not isinstance(made, Tally) or made.kind is None:
        raise Untranslatable("only folds by +, min and max run on streams")
    got = getattr(F, made.kind)(column(made.value))
    start = F.lit(tally)
    value = start + F.coalesce(got, F.lit(0)) if made.kind == "sum" else (F.least if made.kind == "min" else F.greatest)(start, got)
    return df.agg(value.alias("tally"))
